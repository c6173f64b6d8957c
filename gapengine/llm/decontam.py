"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ten words.  A window is a set of shingles
(three words in a row); a document can only hold it if it holds all of them, so
one shingle, the necessary prefix, is enough to find every candidate.  Shingles
are ordered by rarity over all documents, and a window is joined on its rarest
one; a window with a shingle that no document has is left out.  What meets must
leave room for the whole window before and behind the shared shingle (bounds on
position and length), and is then verified word by word.

Documents are read once.  A bitmap of fixed size holds the shingles of all
items; only passages in which as many shingles in a row pass as a window has
are kept, with their words.  Equal passages are matched once, whatever number
of documents repeats them; joins back to the documents are salted where one
passage is that frequent.  Items are carried as classes of windows with the
same items, and sets of classes are resolved once each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gapengine.llm.common import C, discard, id_filter, in_filter, partitions, stored
from gapengine.llm.wordhash import CHUNK_BYTES, MULTIPLIER, buffers, chunks, mix

WINDOW = 10
SHINGLE = 3

# Words are runs of these bytes: digits, letters and everything outside ASCII.
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_PLAIN = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if _IN_WORD[b] else 0x20 for b in range(256))
_VALUES = mix(np.frombuffer(_PLAIN, np.uint8).astype(np.uint64) + np.uint64(0x2545F4914F6CDD1D))
_VALUES[~_IN_WORD] = 0


class _Words:
    """Words of a run of texts: byte ranges, hashes, and the first word of each text (and one past the last)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        pieces = [self._piece(data, offsets, a, b) for a, b in self._cuts(data)]
        self.starts, self.ends, self.hashes = (np.concatenate([p[i] for p in pieces]) if pieces else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.uint64)))
        self.bounds = np.searchsorted(self.starts, offsets)

    @staticmethod
    def _cuts(data: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of about ``CHUNK_BYTES`` that end between words, so that long texts need little more than their words."""
        start = 0
        while start < len(data):
            stop = min(len(data), start + CHUNK_BYTES)
            while stop < len(data) and _IN_WORD[data[stop]]:
                more = np.flatnonzero(~_IN_WORD[data[stop : stop + CHUNK_BYTES]])
                stop = stop + int(more[0]) if len(more) else min(len(data), stop + CHUNK_BYTES)
            yield start, stop
            start = stop

    @staticmethod
    def _piece(data: np.ndarray, offsets: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        part = data[a:b]
        inside = _IN_WORD[part]
        first = np.zeros(len(part) + 1, dtype=bool)
        here = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, side="right")] - a
        first[here] = True
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | first[1:-1]
        stops[:-1] &= ~inside[1:] | first[1:-1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        if not len(starts):
            return starts, ends, np.zeros(0, np.uint64)
        powers = np.full(int((ends - starts).max()), MULTIPLIER, dtype=np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        at = np.arange(len(part)) - starts[np.maximum(np.cumsum(begins) - 1, 0)]
        values = np.where(inside, _VALUES[part] * powers[np.clip(at, 0, len(powers) - 1)], np.uint64(0))
        return starts + a, ends + a, mix(np.add.reduceat(values, starts))

    def shingles(self, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each word on; the last ones of a text run over its end and mean nothing."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = mix(self.hashes[:n] + np.uint64(size))
        for i in range(1, size):
            out = mix(out * MULTIPLIER + self.hashes[i : n + i])
        return out


def _words_between(data: np.ndarray, start: int, stop: int) -> str:
    """Words of a byte range, lower-cased, one space between two."""
    return b" ".join(data[start:stop].tobytes().translate(_PLAIN).split()).decode()


def _runs(passing: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Ranges of at least ``least`` true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], passing, [False]]).astype(np.int8)))
    for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if stop - start >= least:
            yield start, stop


# ------------------------------------------------------------------------- items

_WINDOWS = "item string, words string, length int, size int, shingles array<bigint>"
_WINDOWS_SCHEMA = pa.schema([
    ("item", pa.string()), ("words", pa.string()), ("length", pa.int32()), ("size", pa.int32()), ("shingles", pa.list_(pa.int64())),
])


def _item_windows(window: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            words = _Words(data, offsets)
            of_size = {size: words.shingles(size).view(np.int64) for size in range(1, shingle + 1)}
            for k, item in enumerate(batch.column(0).to_pylist()):
                first, last = int(words.bounds[k]), int(words.bounds[k + 1])
                length = min(window, last - first)
                if not length:
                    continue
                size = min(shingle, length)
                hashes = of_size[size]
                for at in range(first, last - length + 1, 1000):
                    yield pa.RecordBatch.from_pylist(
                        [
                            {"item": item, "words": _words_between(data, words.starts[i], words.ends[i + length - 1]), "length": length, "size": size,
                             "shingles": hashes[i : i + length - size + 1].tolist()}
                            for i in range(at, min(at + 1000, last - length + 1))
                        ],
                        schema=_WINDOWS_SCHEMA,
                    )

    return run


def _classes(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct windows with the class of their items, and the items of each class.

    A class stands for all windows that the same items hold: their number and
    two checksums name it, so no list of items is gathered for a window.
    """
    held = windows.select("words", "item").distinct()
    name = F.concat_ws(
        ":", F.count("item"), F.coalesce(F.bit_xor(F.when(C("item").isNotNull(), F.xxhash64("item"))), F.lit(0)),
        F.coalesce(F.bit_xor(F.when(C("item").isNotNull(), F.xxhash64("item", F.lit("again")))), F.lit(0)),
    )
    shape = windows.groupBy("words").agg(F.first("length").alias("length"), F.first("size").alias("size"), F.first("shingles").alias("shingles"))
    distinct = stored(shape.join(held.groupBy("words").agg(name.alias("class")), "words"))
    one = distinct.groupBy("class").agg(F.min("words").alias("words"))
    members = stored(one.join(held.filter(C("item").isNotNull()), "words").select("class", "item"))
    return distinct, members


# --------------------------------------------------------------------- documents

_REGION = pa.struct([("start", pa.int64()), ("size", pa.int32()), ("words", pa.string())])
_SCANNED = "key bigint, n_words bigint, regions array<struct<start: bigint, size: int, words: string>>"


def _scan(bitmap: np.ndarray, least: dict[int, int]):
    """Words of each text, and the passages in which enough shingles in a row may belong to an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            counts, found = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
            for start, stop in chunks(offsets):
                own = offsets[start : stop + 1] - offsets[start]
                part = data[offsets[start] : offsets[stop]]
                words = _Words(part, own)
                counts[start:stop] = np.diff(words.bounds)
                for size, run_length in least.items():
                    hashes = words.shingles(size)
                    passing = in_filter(bitmap, pa.array(hashes.view(np.int64)))
                    for back in range(1, size):
                        # A shingle must not run into the next text; those of the last text end with the array.
                        over = words.bounds[1:-1] - back
                        passing[over[(over >= 0) & (over < len(passing))]] = False
                    for a, b in _runs(passing, run_length):
                        # Runs of single words may span texts.
                        text = int(np.searchsorted(words.bounds, a, side="right")) - 1
                        while a < b:
                            end = min(b, int(words.bounds[text + 1]))
                            if end - a >= run_length:
                                found[start + text].append({
                                    "start": a - int(words.bounds[text]), "size": size,
                                    "words": _words_between(part, words.starts[a], words.ends[end + size - 2]),
                                })
                            a, text = end, text + 1
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(counts), pa.array(found, pa.list_(_REGION))], ["_id", "key", "n_words", "regions"]
            )

    return run


_SHINGLED = "region binary, words string, n bigint, shingles array<bigint>"
_SHINGLED_SCHEMA = pa.schema([("region", pa.binary()), ("words", pa.string()), ("n", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of the size each passage was found with."""
    for batch in batches:
        data, offsets = buffers(batch.column(1))
        words, sizes = _Words(data, offsets), batch.column(3).to_numpy()
        hashes = {size: words.shingles(size).view(np.int64) for size in np.unique(sizes).tolist()}
        lists = [hashes[s][a : b - s + 1] for s, a, b in zip(sizes.tolist(), words.bounds[:-1], words.bounds[1:])]
        yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(lists, pa.list_(pa.int64()))], schema=_SHINGLED_SCHEMA)


_OCCURRENCES = "region binary, shingle bigint, at int, before int, context string"
_OCCURRENCES_SCHEMA = pa.schema([("region", pa.binary()), ("shingle", pa.int64()), ("at", pa.int32()), ("before", pa.int32()), ("context", pa.string())])


def _occurrences(bitmap: np.ndarray, window: int):
    """Places of a passage where a prefix may stand, with as many words on both sides as a window can reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for region, text, shingles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                hashes, words = shingles.values, text.split(" ")
                places = np.flatnonzero(in_filter(bitmap, hashes)).tolist()
                for start in range(0, len(places), 1000):
                    some = places[start : start + 1000]
                    first = [max(0, at - window + 1) for at in some]
                    yield pa.record_batch(
                        [
                            pa.array([region] * len(some), pa.binary()), hashes.take(pa.array(some)), pa.array(some, pa.int32()),
                            pa.array([at - f for at, f in zip(some, first)], pa.int32()),
                            pa.array([" ".join(words[f : at + window]) for at, f in zip(some, first)], pa.string()),
                        ],
                        schema=_OCCURRENCES_SCHEMA,
                    )

    return run


def _hot(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Keys that hold more than the n-th part of all rows, so fewer than n, and into how many parts to split them."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    return counts.join(F.broadcast(total)).filter(C("_n") * n > C("_total")).select(  # one row
        key, F.ceil(C("_n") * n / C("_total")).cast("int").alias("_parts")
    )


def _spread_join(rows: DataFrame, values: DataFrame, key: str, salt: list[Column], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``values`` (one row for each key); frequent keys are split over several tasks."""
    hot = stored(_hot(rows.filter(C(key).isNotNull()), key, partitions(rows.sparkSession)))
    parts = F.coalesce("_parts", F.lit(1))
    left = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(F.xxhash64(*salt), parts).cast("int"))  # fewer rows than partitions
    right = values.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.drop("_parts").join(right.drop("_parts"), [key, "_salt"], how).drop("_salt")


def _disjoint(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans cut so that no two of a key overlap; what earlier ones cover is dropped."""
    before = Window.partitionBy(*keys).orderBy("from", "to").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("from", F.greatest("from", F.max("to").over(before))).filter(C("from") < C("to"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, shingle: int = SHINGLE,
) -> DataFrame:
    """(id_col, n_words, n_hit, spans, items) for every document.

    Words are runs of digits, letters and characters outside ASCII, A-Z lower-
    cased.  A window is ``window`` consecutive words of an item; an item of
    fewer words is one window.  ``spans`` are disjoint ranges [from, to) of the
    document's words that lie in occurrences of windows, in order, ``n_hit`` the
    number of such words, ``items`` the ids of all items with an occurring
    window, as texts in ascending order.

    Null and empty texts have no words; no windows, no hits: ``spans`` and
    ``items`` are empty then.  An item without id marks words but is not listed;
    rows that share an item id are one item.  Texts of any length are searched
    whole.  Every row of ``docs`` gives one row, also where ids are null or
    repeat.  An empty benchmark or table is allowed.  Other columns are not
    read.
    """
    items = benchmark.select(C(item_col).cast("string").alias("item"), C(item_text_col).cast("string").alias("text"))
    windows = stored(items.mapInArrow(_item_windows(window, shingle), _WINDOWS))
    distinct, members = _classes(windows)
    # Few rows: one for each size of shingles.
    least = {r["size"]: r["least"] for r in distinct.groupBy("size").agg(F.min(F.size("shingles")).alias("least")).collect()}
    bitmap = id_filter(distinct.select(F.explode("shingles").alias("x")))

    read = docs.select(C(id_col).alias("_id"), F.xxhash64(text_col).alias("key"), C(text_col).cast("string").alias("text"))
    id_type = read.schema["_id"].dataType.simpleString()
    scanned = stored(read.mapInArrow(_scan(bitmap, least), f"_id {id_type}, {_SCANNED}"))
    name = F.unhex(F.sha2(F.concat_ws(" ", "r.size", "r.words"), 256))
    # Rows that repeat an id and a text have the same passages.
    places = stored(
        scanned.filter(F.size("regions") > 0).select("_id", "key", F.explode("regions").alias("r"))
        .select("_id", "key", C("r.start").alias("start"), name.alias("region"), C("r.size").alias("size"), C("r.words").alias("words")).distinct()
    )
    regions = places.groupBy("region").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
    regions = stored(regions.mapInArrow(_shingled, _SHINGLED))

    # Rarity over all documents; the rarest shingle of each window that may occur at all.
    rarity = regions.select(F.explode("shingles").alias("shingle"), "n").groupBy("shingle").agg(F.sum("n").alias("n"))
    parts = distinct.select("words", "length", "class", F.size("shingles").alias("n_shingles"), F.posexplode("shingles").alias("offset", "shingle"))
    prefixes = stored(
        parts.join(rarity, "shingle").groupBy("words", "length", "class", "n_shingles")
        .agg(F.count(F.lit(1)).alias("there"), F.min(F.struct("n", "shingle", "offset")).alias("rarest"))
        .filter(C("there") == C("n_shingles")).select(C("words").alias("window"), "length", "class", "rarest.shingle", "rarest.offset")
    )
    wanted = id_filter(prefixes.select("shingle"))
    inside = stored(regions.select("region", "words", "shingles").mapInArrow(_occurrences(wanted, window), _OCCURRENCES))
    # Where the window starts, in the context and in the passage.
    begin, start = C("before") - C("offset"), (C("at") - C("offset")).cast("bigint")
    words = F.split("context", " ")
    matches = stored(
        inside.join(prefixes, "shingle").filter((begin >= 0) & (begin + C("length") <= F.size(words)))
        .filter(F.array_join(F.slice(words, F.greatest(begin + 1, F.lit(1)), C("length")), " ") == C("window"))
        .select("region", start.alias("from"), (start + C("length")).alias("to"), "class")
    )
    covered = _disjoint(matches.select("region", "from", "to").distinct(), ["region"]).groupBy("region").agg(F.collect_list(F.struct("from", "to")).alias("covered"))
    found = stored(covered.join(matches.groupBy("region").agg(F.collect_set("class").alias("classes")), "region"))

    hits = stored(_spread_join(places.select("_id", "key", "start", "region"), found, "region", [C("_id"), C("key"), C("start")]))
    spans = hits.select("_id", "key", "start", F.explode("covered").alias("c")).select(
        "_id", "key", (C("start") + C("c.from")).alias("from"), (C("start") + C("c.to")).alias("to")
    )
    spans = _disjoint(spans, ["_id", "key"]).groupBy("_id", "key").agg(
        F.sum(C("to") - C("from")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("from", "to"))).alias("spans")
    )
    # The items of each set of classes are looked up once, not for each document that has the set.
    sets = hits.groupBy("_id", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("classes")))).alias("classes"))
    sets = stored(sets.withColumn("set", F.unhex(F.sha2(F.array_join("classes", " "), 256))))
    known = sets.groupBy("set").agg(F.first("classes").alias("classes")).select("set", F.explode("classes").alias("class"))
    listed = stored(known.join(members, "class").groupBy("set").agg(F.array_sort(F.collect_set("item")).alias("items")))
    same = sets["_id"].eqNullSafe(spans["_id"]) & (sets["key"] == spans["key"])
    results = spans.join(sets, same).select(spans["_id"], spans["key"], "n_hit", "spans", "set")
    results = stored(_spread_join(results, listed, "set", [C("_id"), C("key")], "left"))

    everything = scanned.select("_id", "key", "n_words")
    same = everything["_id"].eqNullSafe(results["_id"]) & (everything["key"] == results["key"])
    out = stored(
        everything.join(results, same, "left").select(
            everything["_id"].alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
            F.coalesce("spans", F.array().cast(results.schema["spans"].dataType)).alias("spans"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )
    for used in (windows, distinct, members, scanned, places, regions, prefixes, inside, matches, found, hits, sets, listed, results):
        discard(used)
    return out


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Hit words and items of each document, the items as one digest."""
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (C("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
v AS (
  SELECT DISTINCT item_id, n, array_to_string(words[i : i + n - 1], ' ') AS window
  FROM (SELECT item_id, words, n, unnest(generate_series(1, len(words) - n + 1)) AS i FROM (SELECT *, least(10, len(words)) AS n FROM b) WHERE n > 0)),
o AS (
  SELECT r, i, n, array_to_string(words[i : i + n - 1], ' ') AS window
  FROM (SELECT r, words, n, unnest(generate_series(1, len(words) - n + 1)) AS i FROM w JOIN (SELECT DISTINCT n FROM v) ON len(words) >= n)),
m AS (SELECT r, i, o.n, item_id FROM o JOIN v ON o.n = v.n AND o.window = v.window),
h AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS place FROM (SELECT DISTINCT r, i, n FROM m)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
