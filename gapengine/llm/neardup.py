"""Near-duplicate documents: SuperMinHash signatures, banding, verification on whole sets, grouping.

Every text becomes the set of its distinct word shingles.  A signature value
is the least of ``r + j`` over the set's elements, ``j`` the step at which an
element's own random permutation visits the position and ``r`` a fraction in
[0, 1).  One permutation serves all positions, so values are spread more
evenly than with independent hashes, and an element stops as soon as ``j``
exceeds the largest value the document still holds.

Documents with equal sets form one class and go on as one.  Classes that share
a band meet in that band's bucket.  First each is compared with the bucket's
smallest member, its pivot, only: connected classes need no more comparison, so
thousands of near copies cost a line and not a square.  Those still apart are
compared by their differences from the pivot where a prefix bound on these
leaves a link possible; documents far from their pivot meet the bucket's others
under a bound on sizes and single-bit signatures.  All links are confirmed on
full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gapengine.llm.common import C, id_filter, in_filter, stored
from gapengine.llm.components import components
from gapengine.llm.wordhash import CHUNK_BYTES, Words, buffers, chunks, mix

U = np.uint64
_COMBINE = U(0xD6E8FEB86659FD93)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and how many each has.

    A text with fewer words than a shingle has its whole sequence as its one
    element; a text without words has the empty set.
    """
    w = Words(data, offsets)
    sets, sizes = [], np.zeros(len(offsets) - 1, dtype=np.int64)
    h = w.hashes
    rolled = np.zeros(max(0, len(h) - words + 1), dtype=U)
    for t in range(words):
        rolled = rolled * _COMBINE + h[t : t + len(rolled)]
    rolled = mix(rolled + U(words))
    for i, (s, e) in enumerate(zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True)):
        if e - s >= words:
            run = np.sort(rolled[s : e - words + 1])
            keep = np.empty(len(run), dtype=bool)
            keep[0] = True
            np.not_equal(run[1:], run[:-1], out=keep[1:])
            run = run[keep]
        elif e > s:
            value = np.array([e - s], dtype=U)
            for x in h[s:e]:
                value = value * _COMBINE + x
            run = mix(value)
        else:
            continue
        sets.append(run)
        sizes[i] = len(run)
    return np.concatenate(sets) if sets else np.zeros(0, U), sizes


def super_minhash(elements: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """Signatures (documents x ``length``); documents with an empty set keep infinite values."""
    n = len(sizes)
    signature = np.full((n, length), np.inf)
    flat = signature.reshape(-1)
    doc = np.repeat(np.arange(n), sizes)
    active, order = elements, None
    for j in range(length):
        random = mix(active + U((j * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        fraction = (random >> U(11)).astype(np.float64) * 2.0**-53
        pick = j + (mix(random) % U(length - j)).astype(np.int64)
        if j == 0:
            place = pick
        else:
            rows = np.arange(len(active))
            place = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[:, j]
        value, slot = fraction + j, doc * length + place
        better = value < flat[slot]
        np.minimum.at(flat, slot[better], value[better])
        if j + 1 == length:
            break
        unfinished = signature.max(axis=1) > j + 1
        keep = unfinished[doc]
        if not keep.any():
            break
        if j == 0:
            # The first swap of each permutation; position 0 is never read again.
            doc, active, pick = doc[keep], active[keep], pick[keep]
            order = np.tile(np.arange(length, dtype=np.uint8 if length <= 256 else np.uint16), (len(active), 1))
            order[np.arange(len(active)), pick] = 0
        elif not keep.all():
            doc, active, order = doc[keep], active[keep], order[keep]
    return signature


def _band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    bits = signature.view(U).reshape(len(signature), bands, -1)
    out = np.tile(mix(np.arange(1, bands + 1, dtype=U)), (len(signature), 1))
    for t in range(bits.shape[2]):
        out = mix(out * _COMBINE + bits[:, :, t])
    return out.view(np.int64)


def _single_bits(signature: np.ndarray) -> np.ndarray:
    """One bit of each signature value, packed into 64-bit numbers."""
    ones = (mix(signature.view(U)) >> U(63)).astype(np.uint8)
    short = -ones.shape[1] % 64
    return np.packbits(np.pad(ones, ((0, 0), (0, short))), axis=1).view(np.int64)


def _signed(schema: pa.Schema, words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for a, b in chunks(offsets):
                part = data[offsets[a] : offsets[b]]
                elements, sizes = shingle_sets(part, offsets[a : b + 1] - offsets[a], words)
                signature = super_minhash(elements, sizes, bands * rows)
                full = np.flatnonzero(sizes)
                starts = (np.cumsum(sizes) - sizes)[full]
                digests = []
                for salt in (1, 2):
                    sums = np.zeros(b - a, dtype=U)
                    if len(full):
                        sums[full] = np.add.reduceat(mix(elements ^ mix(np.full(1, salt, U))), starts)
                    digests.append(sums.view(np.int64))
                keys, bits = _band_keys(signature, bands), _single_bits(signature)
                yield pa.record_batch([
                    batch.column(0).slice(a, b - a), pa.array(sizes), pa.array(digests[0]), pa.array(digests[1]),
                    _lists(bits), _lists(keys),
                ], schema=schema)

    return run


def _lists(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(rows.reshape(-1)))


def _sets(words: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_filter(wanted.value, batch.column(0))))
            data, offsets = buffers(batch.column(1))
            for a, b in chunks(offsets, CHUNK_BYTES):
                elements, sizes = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                ends = np.zeros(b - a + 1, dtype=np.int32)
                np.cumsum(sizes, out=ends[1:])
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(elements.view(np.int64)))],
                    names=["id", "elements"],
                )

    return run


def _possible(a: str, b: str, percent: int, length: int):
    """Bounds that no pair at the wanted similarity fails: the smaller set is at
    least that share of the larger one; and differing signature bits, half of
    the differing values, lie within six deviations of what is expected."""
    similarity = percent / 100
    differ = length * (1 - similarity) / 2
    most = differ + 6 * (length * (1 - similarity) / 2 * (1 + similarity) / 2) ** 0.5
    n = -(-length // 64)
    apart = sum((F.bit_count(C(f"{a}.bits")[i].bitwiseXOR(C(f"{b}.bits")[i])) for i in range(n)), F.lit(0))
    return (
        (F.least(f"{a}.n", f"{b}.n") * 100 >= F.greatest(f"{a}.n", f"{b}.n") * percent) & (apart <= int(most))
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80,
    bands: int = 32, rows: int = 4,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``.

    Linked are documents whose shingle sets (``words`` words, A-Z lower-cased,
    words split at ASCII white space) have ``100 * intersection >= percent *
    union``.  ``component_id`` is the smallest id reachable over links, ``kept``
    says that it is the document's own.  With 32 bands of 4 rows a pair at
    similarity 0.8 shares no band with probability 5e-8.

    Null, empty and blank texts have no shingles and link with nothing.  A row
    without id links with nothing, has no component and is kept.  Repeated rows
    get equal results.  Rows that repeat an id with another text are one vertex
    of the graph.  Other columns, whatever their names, are not read.
    """
    source = docs.select(C(id_col).cast("bigint").alias("id"), C(text_col).cast("string").alias("text"))
    fields = "id bigint, n bigint, d1 bigint, d2 bigint, bits array<bigint>, bands array<bigint>"
    schema = pa.schema([
        ("id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()),
        ("bits", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64())),
    ])
    signed = stored(source.mapInArrow(_signed(schema, words, bands, rows), fields))
    linkable = signed.filter(C("id").isNotNull() & (C("n") > 0))
    # One row for each different set; classes of one document stay out of the join at the end.
    classes = stored(
        linkable.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.first("bits").alias("bits"), F.first("bands").alias("bands"))
    )
    banded = classes.select(F.explode("bands").alias("key"), C("rep").alias("id"))
    buckets = banded.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).filter(C("pivot") < C("last")).select("key", "pivot")
    outline = classes.select(C("rep").alias("id"), F.struct(C("rep").alias("id"), "n", "bits").alias("outline"))
    others = banded.join(buckets, "key").filter(C("id") != C("pivot"))
    meeting = stored(
        others.join(outline.select("id", C("outline").alias("member")), "id").join(outline.select(C("id").alias("pivot"), C("outline").alias("first")), "pivot")
        .withColumn("possible", _possible("first", "member", percent, bands * rows)).select("key", "pivot", "id", "member", "possible")
    )
    star = stored(_compared(source, stored(meeting.filter("possible").select(C("pivot").alias("a"), C("id").alias("b")).distinct()), words, percent))
    links = star.filter("linked").select("a", "b")
    grouped = stored(components(links))
    more = stored(
        _inside_stars(star, grouped, percent)
        .union(_outside_stars(source, meeting, grouped, words, percent, bands * rows)).distinct()
    )
    found = components(links.union(more)) if more.limit(1).count() else grouped
    labels = (
        classes.join(found, C("rep") == C("id"), "left")
        .filter((C("rep") != C("last")) | C("component").isNotNull())
        .select("d1", "d2", "n", F.coalesce("component", "rep").alias("component"))
    )
    out = signed.select("id", "n", "d1", "d2").join(stored(labels), ["d1", "d2", "n"], "left")
    component = F.when(C("n") > 0, F.coalesce("component", "id")).otherwise(C("id"))
    component = F.when(C("id").isNotNull(), component)
    return out.select(
        C("id").alias("doc_id"), C("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(C("id")).alias("kept")
    )


def _compared(source: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Full sets of the pairs (a, b) compared: sizes, whether they link, and ``delta``, the elements only one of them has."""
    ids = pairs.select(C("a").alias("id")).union(pairs.select("b"))
    # Texts stay where they are: only the sets of the wanted documents, and of few others, are shuffled.
    wanted = source.sparkSession.sparkContext.broadcast(id_filter(ids))
    sets = stored(source.mapInArrow(_sets(words, wanted), "id bigint, elements array<bigint>").distinct())
    both = pairs.join(sets.select(C("id").alias("a"), C("elements").alias("left")), "a").join(
        sets.select(C("id").alias("b"), C("elements").alias("right")), "b"
    )
    delta = F.concat(F.array_except("left", "right"), F.array_except("right", "left"))
    return both.select(
        "a", "b", F.size("left").alias("na"), F.size("right").alias("nb"), delta.alias("delta"),
    ).withColumn("linked", _links(C("na"), C("nb"), F.size("delta"), percent))


def _links(na, nb, apart, percent: int):
    """Similarity from the set sizes and the number of elements that only one set has (both sides doubled)."""
    return (na + nb - apart) * 100 >= (na + nb + apart) * percent


def _inside_stars(star: DataFrame, grouped: DataFrame, percent: int) -> DataFrame:
    """Links between documents of one star that its own links have not connected.

    Each document is known by its difference from the pivot.  Two linked ones
    differ in at most ``r * (n1 + n2)`` elements, so their differences from
    the pivot, a and b elements, share t = (a + b - r * (n1 + n2)) / 2 or more.
    Ordered from rare to common, the first a - t + 1 elements of one and the
    first b - t + 1 of the other then have an element in common, and from it on
    both still have t or more: only such pairs are compared, exactly, by their
    differences.
    """
    r = (100 - percent) / (100 + percent)
    group = grouped.select(C("id").alias("b"), C("component").alias("own"))
    members = star.join(group, "b", "left").select(
        "a", C("b").alias("x"), C("nb").alias("n"), "delta", F.size("delta").alias("d"), "linked", F.coalesce("own", "b").alias("group")
    )
    stars = members.groupBy("a").agg(
        F.min("group").alias("lo"), F.max("group").alias("hi"), F.max("n").alias("most"), F.min(F.when(~C("linked"), C("d"))).alias("nearest")
    ).filter(C("lo") < C("hi")).select("a", "most", "nearest")
    reach = (C("n") + F.least(C("most"), C("n") * 100 / percent)) * r + 1e-6
    shared = F.when(C("linked"), F.ceil((C("nearest") + C("d") - reach) / 2)).otherwise(F.ceil(C("d") - reach))
    members = stored(
        members.join(stars, "a").withColumn("t", shared).withColumn("free", ~C("linked") & (C("t") < 1)).withColumn("t", F.greatest("t", F.lit(1)))
        .filter(C("free") | (C("t") <= C("d"))).drop("most", "nearest")
    )
    element = members.select("a", "x", "group", "linked", "n", "d", "t", F.explode("delta").alias("element"))
    often = element.groupBy("a", "element").agg(F.count(F.lit(1)).alias("often"))
    place = F.row_number().over(Window.partitionBy("a", "x").orderBy("often", "element"))
    front = stored(
        element.join(often, ["a", "element"]).withColumn("place", place).filter((C("place") <= C("d") - C("t") + 1) & (C("often") > 1))
        .select("a", "element", "x", "group", "linked", "n", "d", "place")
    )
    left = front.filter(~C("linked"))
    right = front.select("a", "element", C("x").alias("y"), *[C(c).alias(f"{c}2") for c in ("group", "linked", "n", "d", "place")])
    once = C("linked2") | (C("x") < C("y"))
    # From their first common element on, both must have enough elements left.
    left_over = F.least(C("d") - C("place"), C("d2") - C("place2")) + 1
    enough = left_over >= (C("d") + C("d2") - (C("n") + C("n2")) * r) / 2 - 1e-6
    near = left.join(right, ["a", "element"]).filter((C("group") != C("group2")) & once & enough).select("a", "x", "y")
    # Documents for which no bound holds (sizes far apart) meet all of their star that lie in reach.
    free = members.filter("free").select("a", "x", "group", "n", "d")
    other = members.select("a", C("x").alias("y"), C("group").alias("group2"), C("n").alias("n2"), C("d").alias("d2"))
    far = free.join(other, "a").filter((C("group") != C("group2")) & (F.abs(C("d") - C("d2")) <= (C("n") + C("n2")) * r)).select("a", "x", "y")
    one = members.select("a", "x", "n", C("delta").alias("delta1"))
    two = members.select("a", C("x").alias("y"), C("n").alias("n2"), C("delta").alias("delta2"))
    pairs = near.union(far).distinct().join(one, ["a", "x"]).join(two, ["a", "y"])
    apart = F.size("delta1") + F.size("delta2") - 2 * F.size(F.array_intersect("delta1", "delta2"))
    return pairs.filter(_links(C("n"), C("n2"), apart, percent)).select(C("x").alias("a"), C("y").alias("b"))


def _outside_stars(source: DataFrame, meeting: DataFrame, grouped: DataFrame, words: int, percent: int, length: int) -> DataFrame:
    """Links of documents too far from their bucket's pivot with the bucket's others."""
    group = grouped.select("id", "component")
    rows = meeting.select("key", "member", "possible").join(group, C("member.id") == C("id"), "left").select(
        "key", "member", "possible", F.coalesce("component", C("member.id")).alias("group")
    )
    left = rows.filter(~C("possible")).select("key", C("member").alias("first"), C("group").alias("group1"))
    right = rows.select("key", "member", C("possible").alias("known"), "group")
    once = C("known") | (C("first.id") < C("member.id"))
    pairs = left.join(right, "key").filter((C("group1") != C("group")) & once & _possible("first", "member", percent, length))
    pairs = stored(pairs.select(C("first.id").alias("a"), C("member.id").alias("b")).distinct())
    return _compared(source, pairs, words, percent).filter("linked").select("a", "b")


# Brute force over all pairs that share a shingle, for tables of test size.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM k WHERE 100 * k >= 80 * (na + nb - k)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept FROM s LEFT JOIN m ON a = doc_id
"""
