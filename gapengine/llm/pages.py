"""Main text of web pages: lines by markup, then differencing against the nearest page of the same host.

A page becomes lines, one for each block of text, each with the zone it stands
in.  Pages of a host are ordered by the path of their URL; a page's nearest
neighbours in that order, copies passed over, very likely share its template.  The lines of both
are aligned by their longest common subsequence, and lines in it are template
and deleted.  Lines inside an article or main element are the page's own and
only lose shared lines that are mere links; what markup names as menu, header,
footer, advert, form, comment and so on is never text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gapengine.llm.common import C, ranked, stored

# Names from the mark-up language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas audio video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
NOT_TEXT = frozenset("head nav footer aside form button select menu dialog fieldset header".split())
MAIN = frozenset("article main".split())
# An element with one of these words in its class, id or role is not text.
NAMED = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menubar|header|masthead|footer|sidebar|side-bar|aside|complementary|contentinfo|ad|ads|adbox|advert|adverts|"
    r"advertisement|advertising|adsense|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|gdpr|notice|notices|alert|newsletter|subscribe|"
    r"subscription|signup|popup|modal|overlay|comment|comments|disqus|respond|replies|share|sharing|social|related|recommended|breadcrumb|"
    r"breadcrumbs|pagination|pager|widget|toolbar|search|login)(?:$|[\s_-]|\d)", re.IGNORECASE)

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_END = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in RAW}
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSHOWN = re.compile(r"display\s*:\s*none", re.IGNORECASE)
# Words about the layout around an element, not about what it holds.
_LAYOUT = re.compile(r"(?:with|has|no)-.*|.*-(?:layout|page)", re.IGNORECASE)
_TALK = re.compile(r"(?:^|[_-])(?:comments?|disqus|respond|replies)(?:$|[_-]|\d)", re.IGNORECASE)

OWN, LOOSE, LINK = 0, 1, 2
# Why an element is silent: a name that an article or main element inside overrules, or what it is.
SOFT, HARD = 1, 2


def _silence(attributes: str) -> int:
    """0, SOFT for a name in class or id, HARD for a role, comments and what is hidden."""
    found = 0
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "style" and _UNSHOWN.search(value)) or (name == "aria-hidden" and value.strip().lower() == "true"):
            return HARD
        if name in ("class", "id", "role"):
            for word in value.split():
                if NAMED.search(word) and not _LAYOUT.fullmatch(word):
                    found = max(found, HARD if name == "role" or _TALK.search(word) else SOFT)
    return found


def page_lines(html: str) -> list[tuple[str, int]]:
    """Blocks of text in page order, with their zone.

    Zones: OWN inside an article or main element, LINK there if all its text is
    links, LOOSE elsewhere.  Text of elements that are not text is left out.
    Unclosed and stray tags are allowed: an end tag closes the nearest open
    element of its name, if any, with all inside it.
    """
    lines: list[tuple[str, int]] = []
    stack: list[tuple[str, int, bool, bool]] = []  # name, silence, inside main, inside link
    piece: list[str] = []
    plain = 0

    def flush(main: bool) -> None:
        nonlocal plain
        text = " ".join("".join(piece).split())
        if text:
            lines.append((text, (OWN if plain else LINK) if main else LOOSE))
        piece.clear()
        plain = 0

    at, n = 0, len(html)
    silent, main, link = 0, False, False
    while at < n:
        token = TOKEN.search(html, at)
        stop = token.start() if token else n
        if stop > at and not silent:
            text = unescape(html[at:stop])
            piece.append(text)
            plain += not link and not text.isspace()
        if token is None:
            break
        at = token.end()
        if token[2] is None:
            continue
        name = token[2].lower()
        if name not in INLINE:
            flush(main)
        if token[1]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    del stack[depth:]
                    break
        elif name in RAW:
            if not token[3].endswith("/"):
                end = _END[name].search(html, at)
                at = end.end() if end else n
            continue
        elif name not in VOID and not token[3].endswith("/"):
            if name in ("p", "li", "td", "tr", "option") or (name not in INLINE and stack and stack[-1][0] == "p"):
                # A new paragraph or item ends the open one.
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == name or (name not in INLINE and stack[depth][0] == "p"):
                        del stack[depth:]
                        break
                    if stack[depth][0] not in INLINE:
                        break
                silent, main, link = stack[-1][1:] if stack else (0, False, False)
            named = _silence(token[3]) if token[3] and name not in ("html", "body") else 0
            inner = name in MAIN and not named
            # The heading of an article stands in its own header.
            quiet = HARD if name in NOT_TEXT and not (name == "header" and main) else named
            # A wrapper's name doesn't speak for the article inside.
            around = 0 if inner and silent == SOFT else silent
            stack.append((name, max(around, quiet), (main or inner), link or name == "a"))
        silent, main, link = stack[-1][1:] if stack else (0, False, False)
    flush(main)
    return lines


def common_lines(a: list, b: list) -> set[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``, by bit-parallel dynamic programming.

    One integer of len(b) bits for each element of ``a``: memory is the product of the
    lengths in bits.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = {*range(head), *range(len(a) - tail, len(a))}
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    row, full = (1 << len(b)) - 1, (1 << len(b)) - 1
    rows = [row]
    for x in a:
        match = row & where.get(x, 0)
        row = ((row + match) | (row - match)) & full
        rows.append(row)
    # A zero bit j of rows[i] says that column j adds one to the length for the first i of a.
    i, j = len(a), len(b)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif rows[i - 1] >> (j - 1) & 1:
            found.add(head + i - 1)
            i, j = i - 1, j - 1
        else:
            i -= 1
    return found


def _outlined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        lines = [page_lines(h) for h in frame["html"]]
        keys = [[int.from_bytes(blake2b(t.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True) for t, _ in x] for x in lines]
        yield frame.drop(columns="html").assign(keys=keys, open=[[i for i, (_, z) in enumerate(x) if z != OWN] for x in lines])


def _shared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        shared = []
        for keys, before, after in zip(frame["keys"], frame["before"], frame["after"], strict=True):
            mine, found = list(keys), set()
            for other in (before, after):
                if other is not None and len(other):
                    found |= common_lines(mine, list(other))
            shared.append(sorted(found))
        yield pd.DataFrame({"host": frame["host"], "lines": frame["lines"], "shared": shared})


def _texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        texts = []
        for html, shared in zip(frame["html"], frame["shared"], strict=True):
            gone = set() if shared is None else set(shared)
            texts.append(" ".join(t for i, (t, z) in enumerate(page_lines(html)) if i not in gone or z == OWN))
        yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": pd.Series(texts, dtype=object), "n_chars": [len(t) for t in texts]})


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of ``pages``.

    Blocks are joined in page order by one space, white space inside a block
    is one space, character references are decoded; nothing is cut.  Null and
    empty html has empty text.  A null or hostless URL makes its page a
    neighbour of other such pages.  Pages of a host with the same lines are
    copies, which can't tell template from text: a run of them is one place in
    the order, compared with the nearest other lines on either side, and all
    copies of a host lose what one of their places shares.  A host that holds
    nothing but copies keeps its text.  Other columns are not read.

    Only hashes of lines are ordered and joined.  The html is parsed once for
    them and once for the text, and moves only if many pages lose lines.
    """
    url = F.coalesce(C(url_col), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_replace(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), "/+$", "")
    html = F.coalesce(C(html_col), F.lit(""))
    rows = pages.select(C(id_col).cast("bigint").alias("page_id"), C(url_col).alias("url"), F.xxhash64(html).alias("name"), html.alias("html"))
    outline = pages.select(
        C(id_col).cast("bigint").alias("page_id"), url.alias("url"), F.regexp_replace(host, r"^www\.", "").alias("host"), path.alias("path"),
        F.xxhash64(html).alias("name"), html.alias("html"),
    ).mapInPandas(_outlined, "page_id bigint, url string, host string, path string, name bigint, keys array<bigint>, open array<int>")
    outline = stored(outline.withColumn("lines", F.xxhash64("keys")))
    # Copies at one path are one row.
    distinct = outline.groupBy("host", "path", "lines").agg(F.min("url").alias("url"), F.first("keys").alias("keys"), F.max(F.size("open")).alias("n_open"))
    # One order over all hosts, in ranges: a host with many pages spans many tasks.
    order = [C("host"), C("path"), C("url"), C("lines")]
    placed = ranked(distinct, order, "place")
    earlier = placed.select((C("place") + 1).alias("place"), C("host").alias("host1"), C("lines").alias("lines1"))
    # The first place of every run of copies, numbered again: places side by side have different lines.
    first = placed.join(earlier, "place", "left").filter(~(C("host").eqNullSafe(C("host1")) & C("lines").eqNullSafe(C("lines1"))))
    runs = stored(ranked(first.select("place", "host", "lines", "keys"), [C("place")], "run"))
    near = runs.select("run", C("host").alias("near_host"), C("keys").alias("near_keys"))
    before = near.select((C("run") + 1).alias("run"), C("near_host").alias("host1"), C("near_keys").alias("keys1"))
    after = near.select((C("run") - 1).alias("run"), C("near_host").alias("host2"), C("near_keys").alias("keys2"))
    asked = distinct.filter(C("n_open") > 0).select("host", "lines").distinct()
    pairs = runs.join(asked, ["host", "lines"], "left_semi").join(before, "run", "left").join(after, "run", "left").select(
        "host", "lines", "keys", F.when(C("host") == C("host1"), C("keys1")).alias("before"), F.when(C("host") == C("host2"), C("keys2")).alias("after"),
    )
    found = pairs.mapInPandas(_shared, "host string, lines bigint, shared array<int>")
    shared = found.select("host", "lines", F.explode("shared").alias("line")).groupBy("host", "lines").agg(F.collect_set("line").alias("shared"))
    losing = outline.filter(F.size("open") > 0).select("page_id", "name", "host", "lines").join(shared, ["host", "lines"])
    # Equal html at several hosts under one id: one of its results, always the same.
    lost = stored(losing.groupBy(C("page_id").alias("id"), C("name").alias("of")).agg(F.max(F.array_sort("shared")).alias("shared")))
    return rows.join(lost, (C("name") == C("of")) & C("page_id").eqNullSafe(C("id")), "left").select("page_id", "url", "html", "shared").mapInPandas(
        _texts, "page_id bigint, url string, text string, n_chars bigint"
    )
