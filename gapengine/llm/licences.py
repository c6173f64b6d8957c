"""Licence scan: ordered signature rules over the words of a text, with containment suppression.

Column expressions only.  A text is lower-cased (A-Z) and rewritten as its
words, each with a space on either side, so a rule is a regular expression
over whole words and punctuation, line breaks and comment marks don't matter.
Rules come from a table of licences and a list of sentence forms; a rule's
pattern runs only where its keyword occurs.  A detection lies inside another
one of at least its priority is suppressed: "gnu lesser general public
license" is no general public license.  The base phrases are rules whose
detections are counted before suppression and whose labels always stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gapengine.llm.common import C

# Words are runs of these characters after lower-casing A-Z.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# label, words of its name as a pattern, words of its short identifier, a word of every name, words of its address
LICENCES = (
    ("mit", "mit", "mit", "mit", "opensource org licenses mit"),
    ("apache", "apache( software)?", "apache( license)?", "apache", "apache org licenses"),
    ("gpl", "(gnu )?general public", "gpl", "general", "gnu org licenses gpl"),
    ("lgpl", "(gnu )?(lesser|library) general public", "lgpl", "general", "gnu org licenses lgpl"),
    ("agpl", "(gnu )?affero general public", "agpl", "affero", "gnu org licenses agpl"),
    ("gfdl", "(gnu )?free documentation", "gfdl", "documentation", "gnu org licenses fdl"),
    ("bsd", "(new |modified |simplified )?(bsd|berkeley software distribution)", "bsd( [0234] clause)?", "bsd", "opensource org licenses bsd"),
    ("mpl", "mozilla public", "mpl", "mozilla", "mozilla org mpl"),
    ("epl", "eclipse public", "epl", "eclipse", "eclipse org legal epl"),
    ("cddl", "common development and distribution", "cddl", "distribution", "opensource org licenses cddl"),
    ("cpl", "common public", "cpl", "common", "opensource org licenses cpl"),
    ("isc", "isc", "isc", "isc", "opensource org licenses isc"),
    ("zlib", "zlib( libpng)?", "zlib", "zlib", "zlib net zlib license"),
    ("artistic", "(perl )?artistic", "artistic", "artistic", "opensource org licenses artistic"),
    ("boost", "boost software", "bsl", "boost", "boost org license"),
    ("unlicense", "unlicense", "unlicense", "unlicense", "unlicense org"),
    ("wtfpl", "do what the fuck you want to public", "wtfpl", "want", "wtfpl net"),
    ("python", "python( software foundation)?", "(python|psf)", "python", "python org psf license"),
    ("ruby", "ruby", "ruby", "ruby", "ruby lang org( [^ ]+){0,4} license"),
    ("php", "php", "php", "php", "php net license"),
    ("openssl", "openssl", "openssl", "openssl", "openssl org source license"),
    ("eupl", "european union public", "eupl", "union", "joinup ec europa eu( [^ ]+){0,4} eupl"),
    ("osl", "open software", "osl", "software", "opensource org licenses osl"),
    ("afl", "academic free", "afl", "academic", "opensource org licenses afl"),
    ("ms-pl", "microsoft public", "ms pl", "microsoft", "opensource org licenses ms pl"),
    ("ofl", "(sil )?open font", "ofl", "font", "scripts sil org ofl"),
    ("odbl", "open (data commons open )?database", "odbl", "database", "opendatacommons org licenses odbl"),
    ("postgresql", "postgresql", "postgresql", "postgresql", "opensource org licenses postgresql"),
    ("ncsa", "(university of illinois )?ncsa( open source)?", "ncsa", "ncsa", "opensource org licenses ncsa"),
    ("curl", "curl", "curl", "curl", "curl se docs copyright"),
    ("unicode", "unicode( data files and software)?", "unicode( dfs)?", "unicode", "unicode org copyright"),
    ("latex", "latex project public", "lppl", "latex", "latex project org lppl"),
    ("cecill", "cecill( free software)?", "cecill", "cecill", "cecill info licences"),
    ("upl", "universal permissive", "upl", "universal", "opensource org licenses upl"),
    ("cc-by", "creative commons attribution", "cc by", "by", "creativecommons org licenses by [0-9]"),
    ("cc-by-sa", "creative commons attribution share ?alike", "cc by sa", "by", "creativecommons org licenses by sa"),
    ("cc-by-nc", "creative commons attribution non ?commercial", "cc by nc", "nc", "creativecommons org licenses by nc [0-9]"),
    ("cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike", "cc by nc sa", "nc", "creativecommons org licenses by nc sa"),
    ("cc-by-nd", "creative commons attribution no ?deriv(ative)?s", "cc by nd", "nd", "creativecommons org licenses by nd"),
    ("cc-by-nc-nd", "creative commons attribution non ?commercial no ?deriv(ative)?s", "cc by nc nd", "nc", "creativecommons org licenses by nc nd"),
    ("cc0", "creative commons (zero|cc0)", "cc0", "cc0", "creativecommons org publicdomain zero"),
)
VERSION = "( (version|v) ?[0-9]+( [0-9]+)?| v?[0-9]+( [0-9]+)?)?"
GRANTED = "(licensed|released|distributed|available|published|provided) under"
# form, pattern with {name} {id} {url}, keyword (None: the licence's own), priority, confidence
# A keyword is a piece of the spaced text that every match holds: a word with its spaces, or the beginning of one.
FORMS = (
    ("identifier", "spdx license identifier {id}" + VERSION, " spdx ", 4, 1.0),
    ("grant", GRANTED + " (the )?(terms of )?(the )?{name} licen[cs]e" + VERSION, " under ", 3, 0.95),
    ("short grant", GRANTED + " (the )?{id}" + VERSION, " under ", 3, 0.9),
    ("address", "{url}", None, 3, 0.9),
    ("name", "{name} licen[cs]e" + VERSION, None, 2, 0.8),
    ("label", "licen[cs]e {id}" + VERSION, " licen", 1, 0.6),
)
# Sentences that name no licence: label, pattern, keyword, priority, confidence.
SENTENCES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", " hereby ", 3, 0.95),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", " permission ", 3, 0.95),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", " redistribution ", 3, 0.95),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors", " warranty ", 3, 0.9),
    ("public-domain", "(dedicated to|released into|placed in) the public domain", " domain ", 3, 0.9),
    ("all-rights-reserved", "all rights reserved", " reserved ", 1, 0.5),
    ("copyright", "copyright (c )?[0-9]{4}", " copyright ", 0, 0.3),
)
# Every text with a detection holds one of these, or a grant.
HINTS = (
    "licen", "spdx", "copyright", "hereby", "permission", "redistribution", "warranty", "domain", "reserved", "creativecommons", "wtfpl", "joinup",
    "mozilla", "eclipse", "latex", "scripts",
)
GRANT_HINT = "(?:licensed|released|distributed|available|published|provided)[^a-z0-9]+under[^a-z0-9]"
BASE_PRIORITY, BASE_CONFIDENCE = 2, 0.8
TOP_PRIORITY = 4


def rules() -> list[tuple[str, str, str, str, int, float]]:
    """(rule, label, pattern, keyword, priority, confidence), in order: every licence in every form, then the sentences."""
    out = [(f"base {label}", label, phrase, " license ", BASE_PRIORITY, BASE_CONFIDENCE) for phrase, label in BASE]
    for label, name, short, own, url in LICENCES:
        # The name's own word, where every form of the name has it.
        of_name = " licen" if "|" in name.replace("(lesser|library)", "").replace("(zero|cc0)", "") else f" {name.split()[0]} " if name.startswith("creative") else f" {own} "
        for form, pattern, keyword, priority, confidence in FORMS:
            filled = pattern.replace("{name}", name).replace("{id}", short).replace("{url}", url)
            own_keyword = f" {url.split()[0]} " if form == "address" else of_name
            out.append((f"{form} {label}", label, filled, keyword or own_keyword, priority, confidence))
    out += [(f"sentence {label}", label, pattern, keyword, priority, confidence) for label, pattern, keyword, priority, confidence in SENTENCES]
    return out


def _spaced(pattern: str) -> str:
    """A rule over words as a pattern over the spaced text: a space between words is two there, optional parts included."""
    return " " + pattern.replace(" ?", "(  )?").replace(" ", "\0").replace("(\0\0)?", "(  )?").replace("\0", "  ") + " "


def spaced_words(text: Column) -> Column:
    """Lower-cased words, each with one space before and one behind; empty if there are none."""
    inner = F.btrim(F.regexp_replace(F.translate(text, UPPER, LOWER), NOT_WORD, "  "))
    return F.when(inner != "", F.concat(F.lit(" "), inner, F.lit(" "))).otherwise("")


_SPAN = "struct<start:int,end:int,label:string,rule:string,priority:int,confidence:double>"


def _matches(spaced: Column, rule: Column) -> Column:
    """All detections of one rule, as positions of words: what precedes a match counts two spaces for each word."""
    pattern = rule.getField("pattern")
    between = F.call_function("split", spaced, pattern, F.lit(-1))
    hits = F.regexp_extract_all(spaced, pattern, F.lit(0))
    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(hits)), hits, lambda gap, m: F.struct(_words(gap).alias("gap"), _words(m).alias("m")))

    def walk(state: Column, pair: Column) -> Column:
        start = state.getField("at") + pair.getField("gap")
        end = start + pair.getField("m")
        span = F.struct(
            start.alias("start"), end.alias("end"), rule.getField("label").alias("label"), rule.getField("rule").alias("rule"),
            rule.getField("priority").alias("priority"), rule.getField("confidence").alias("confidence"),
        )
        return F.struct(end.alias("at"), F.concat(state.getField("spans"), F.array(span)).alias("spans"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans"))
    return F.aggregate(pairs, first, walk, lambda state: state.getField("spans"))


def _words(spaced: Column) -> Column:
    return F.floor((F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("int")


def _unsuppressed(found: Column) -> Column:
    """Detections not inside one of higher priority, or of equal priority and longer or listed first.

    In order of start, the longer and higher first, whatever contains a
    detection comes before it; so the farthest end seen at each priority decides.
    """
    ordered = F.array_sort(
        F.transform(found, lambda s: F.struct(
            s.getField("start").alias("start"), (-s.getField("end")).alias("back"), (-s.getField("priority")).alias("after"), s.alias("span"))),
    )
    reach = [f"reach{p}" for p in range(TOP_PRIORITY + 1)]
    first = F.struct(*[F.lit(-1).alias(r) for r in reach], F.array().cast(f"array<{_SPAN}>").alias("kept"))

    def walk(state: Column, x: Column) -> Column:
        span = x.getField("span")
        end, priority = span.getField("end"), span.getField("priority")
        inside = F.lit(False)
        for p, r in enumerate(reach):
            inside = inside | ((F.lit(p) >= priority) & (state.getField(r) >= end))
        ends = [F.when(priority == p, F.greatest(state.getField(r), end)).otherwise(state.getField(r)).alias(r) for p, r in enumerate(reach)]
        kept = F.when(inside, state.getField("kept")).otherwise(F.concat(state.getField("kept"), F.array(span)))
        return F.struct(*ends, kept.alias("kept"))

    return F.aggregate(ordered, first, walk, lambda state: state.getField("kept"))


def scan_licences(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` (every place of a base phrase) and ``licences`` (detections left after suppression).

    Both are arrays of (start, end, label, rule, priority, confidence), starts
    and ends counted in words from 0, end exclusive.  Null and empty texts have
    none.  Texts are read whole.  Repeated rows get equal results; other columns
    pass through, ones named ``base`` or ``licences`` are replaced.
    """
    table = rules()
    listed = F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(label).alias("label"), F.lit(_spaced(p)).alias("pattern"), F.lit(k).alias("keyword"),
                 F.lit(priority).alias("priority"), F.lit(float(c)).alias("confidence"))
        for r, label, p, k, priority, c in table
    ])
    keywords = sorted({k for _, _, _, k, _, _ in table})
    # Most texts have none of the hints and are not rewritten.
    low = C("_low")
    gate = reduce(lambda a, b: a | b, [low.contains(h) for h in HINTS]) | (low.contains("under") & low.rlike(GRANT_HINT))
    rows = docs.withColumn("_text", F.coalesce(C(text_col).cast("string"), F.lit("")))
    rows = rows.withColumn("_low", F.lower("_text"))
    rows = rows.withColumn("_spaced", F.when(gate, spaced_words(C("_text"))).otherwise(""))
    # Which keywords a text has is found once for all rules that share one.
    present = F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(C("_spaced"), k))
    rows = rows.withColumn("_present", F.when(C("_spaced") != "", present))
    chosen = F.filter(listed, lambda r: F.array_contains(C("_present"), r.getField("keyword")))
    none = F.array().cast(f"array<{_SPAN}>")
    rows = rows.withColumn("_found", F.when(F.size("_present") > 0, F.flatten(F.transform(chosen, lambda r: _matches(C("_spaced"), r)))).otherwise(none))
    base = F.array_sort(F.filter("_found", lambda s: s.getField("rule").startswith("base ")))
    kept = F.when(F.size("_found") > 0, _unsuppressed(C("_found"))).otherwise(none)
    return rows.withColumns({"base": base, "licences": kept}).drop("_text", "_low", "_spaced", "_present", "_found")


def licence_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, labels and score of each row of ``docs``; see ``scan_licences``.

    ``score`` is the confidence of the strongest detection, 0 without any.
    """
    rows = scan_licences(docs.select(C(id_col).alias("doc_id"), C(text_col).alias("text")))
    label = lambda s: s.getField("label")
    base = F.array_sort(F.array_distinct(F.transform("base", label)))
    every = F.array_sort(F.array_distinct(F.concat(F.transform("base", label), F.transform("licences", label))))
    sure = F.transform(F.concat("base", "licences"), lambda s: s.getField("confidence"))
    starts = F.transform("base", lambda s: s.getField("start"))
    return rows.select(
        "doc_id", F.coalesce(F.regexp_count("text", F.lit(ANY_WORD)), F.lit(0)).cast("bigint").alias("n_words"),
        F.size("base").cast("bigint").alias("n_base"), F.array_min(starts).cast("bigint").alias("first_word"),
        F.array_max(starts).cast("bigint").alias("last_word"), F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"), F.coalesce(F.array_max(sure), F.lit(0.0)).alias("score"),
        F.array_join(F.transform("licences", lambda s: F.concat_ws(":", label(s), s.getField("start"), s.getField("end"))), ",").alias("detections"),
    )
