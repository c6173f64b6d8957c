"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed hash.  A source's share of the mix is a number of
whole passes over it plus the documents whose hash lies below a threshold.
The threshold is found without sorting: word counts are summed by source and
leading bits of the hash, the bucket in which the budget runs out is the only
one refined by further bits, and so on down to one hash value.  A smaller
budget has a smaller threshold, so its mix is contained in the larger one's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gapengine.llm.common import C, ranked, stored

WORD = r"[^\x20\x09-\x0D]+"
# 60 bits of the hash, twelve at a time.
HASH_BITS = 60
LEVEL_BITS = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def document_hash(doc_id: Column) -> Column:
    """The leading 60 bits of the id's md5; rows without id share one value."""
    hexed = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(hexed, 1, 15), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int], repeats: int, share: float) -> DataFrame:
    """``sizes`` (source, source_size, place) with ``target``, the words each source shall give.

    ``place`` 0, 1, 2, ... takes the weights in turn.  ``share`` of all words is
    dealt by weight; a source gives ``repeats`` times its size at most, and what
    it can't give is dealt among the others, until none is above.  The common
    level (words for each unit of weight) is found by repeated sums; only two
    numbers of each round reach the driver.
    """
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    weighted = stored(
        sizes.withColumn("weight", F.element_at(cycle, (C("place") % len(weights) + 1).cast("int"))).withColumn("most", C("source_size") * repeats)
    )
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    budget, level = total * share, -1.0
    while True:
        above = C("most") < C("weight") * F.lit(level)
        given, open_ = weighted.agg(F.sum(F.when(above, C("most"))), F.sum(F.when(~above, C("weight")))).first()
        rest, open_ = budget - (given or 0), open_ or 0
        if not open_ or rest / open_ <= level:
            break
        level = rest / open_
    dealt = C("weight") * F.lit(float(rest)) / F.lit(float(open_)) if open_ else C("most").cast("double")
    return weighted.withColumn("target", F.least(dealt, C("most").cast("double"))).drop("weight", "most")


def _boundary(rows: DataFrame, goals: DataFrame, keys: list[str], shift: int) -> DataFrame:
    """The bucket of each key in which its ``rest`` runs out: (keys, bucket, inside = words in it, rest within it)."""
    sums = rows.groupBy(*keys, F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("inside"))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("inside").over(before), F.lit(0)))
    return sums.join(goals, keys).filter((C("before") <= C("rest")) & (C("rest") < C("before") + C("inside"))).withColumn(
        "rest", C("rest") - C("before")
    ).drop("before")


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, budget, threshold): documents with a smaller hash make up ``rest`` words best.

    ``goals``: source, budget, rest, with 0 <= rest < the source's size.  Only
    the first level reads all documents; each next one reads the documents of
    the boundary buckets, 1 in 4096 of those before.
    """
    shift = HASH_BITS - LEVEL_BITS
    # Sums of whole sources serve all budgets; the histogram is small, as it combines map-side.
    edge = stored(_boundary(sized, goals, ["source"], shift))
    rows = stored(sized.join(edge.select("source", "budget", "bucket"), (C("bucket") == F.shiftright("hash", shift)) & (sized.source == edge.source))
                  .select(edge.source, "budget", "hash", "size"))
    keys = ["source", "budget"]
    while shift:
        shift -= LEVEL_BITS
        goal = edge.select(*keys, "rest")
        edge = stored(_boundary(rows, goal, keys, shift))
        rows = rows.join(edge.select(*keys, "bucket"), keys).filter(C("bucket") == F.shiftright("hash", shift)).drop("bucket")
        rows = stored(rows) if shift else rows
    # The last bucket is one hash value: in if that comes nearer.
    return edge.select(*keys, F.when(C("rest") * 2 > C("inside"), C("bucket") + 1).otherwise(C("bucket")).alias("threshold"))


def with_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = (5, 2, 1), repeats: int = 3, shares: Sequence[float] = (1.0,),
) -> DataFrame:
    """``docs`` with size, source_size, target, times and times_by_share.

    ``size`` counts the text's words (null: 0).  Sources in code-point order,
    null last, take ``weights`` in turn; see ``source_targets``.  ``times`` is
    how often the mix takes the row, ``repeats`` times at most; it and
    ``target`` hold for the last of ``shares``, and ``times_by_share`` has all
    of them, each mix containing those of smaller shares.

    A null source is a source; a null id is an id.  Rows with equal ids fall on
    the same side of a threshold.  A source without words has target 0 and
    is not taken.  Results depend on ids and texts alone, so reruns agree.  An
    empty table gives no rows.  Columns of ``docs`` with the names of the
    result's are replaced.
    """
    docs = docs.drop("size", "source_size", "target", "times", "times_by_share")
    keyed = docs.withColumns({
        "_source": F.coalesce(F.concat(F.lit("s"), C(source_col).cast("string")), F.lit("\U0010ffff")),
        "size": word_count(C(text_col)), "_hash": document_hash(C(id_col)),
    })
    sized = stored(keyed.select(C("_source").alias("source"), "size", C("_hash").alias("hash")))
    sizes = stored(ranked(sized.groupBy("source").agg(F.sum("size").alias("source_size")), [C("source")], "place"))
    goals = None
    for i, share in enumerate(shares):
        t = source_targets(sizes, weights, repeats, share).select("source", "source_size", F.lit(i).alias("budget"), "target")
        goals = t if goals is None else goals.union(t)
    passes = F.when(C("source_size") > 0, F.floor(C("target") / C("source_size"))).otherwise(0)
    goals = stored(goals.withColumn("passes", passes.cast("bigint")).withColumn("rest", C("target") - C("passes") * C("source_size")))
    found = thresholds(sized, goals.filter(C("rest") > 0).select("source", "budget", "rest"))
    step = F.struct("budget", "passes", F.coalesce("threshold", F.lit(0)).alias("threshold"), "target")
    plan = goals.join(found, ["source", "budget"], "left").groupBy("source", "source_size").agg(F.array_sort(F.collect_list(step)).alias("_plan"))
    # One row for each source, its size known to Spark from the stored table.
    out = keyed.join(stored(plan.withColumnRenamed("source", "_source")), "_source")
    times = F.transform("_plan", lambda p: p.getField("passes") + (C("_hash") < p.getField("threshold")).cast("bigint"))
    return out.withColumn("target", F.element_at("_plan", -1).getField("target")).withColumn("times_by_share", times).withColumn(
        "times", F.element_at("times_by_share", -1)
    ).drop("_source", "_hash", "_plan")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row for each row of ``docs``; ``taken`` is ``times`` its size, see ``with_mix``."""
    narrow = docs.select(C(id_col).alias("doc_id"), C(text_col).alias("text"), C(source_col).alias("source"))
    return with_mix(narrow, **settings).select("doc_id", "size", "source_size", "target", (C("times") * C("size")).alias("taken"))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, 3 * source_size / w AS ratio, (SELECT sum(size) FROM d) AS total,
         row_number() OVER (ORDER BY 3 * source_size / w, source) AS place FROM s),
c AS (
  SELECT *, coalesce(sum(3 * source_size) OVER before, 0) AS given, sum(w) OVER after AS open_w
  FROM o WINDOW before AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                after AS (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
lv AS (SELECT total - given AS rest, open_w FROM c WHERE (total - given) / open_w <= ratio ORDER BY place LIMIT 1),
t AS (
  SELECT source, source_size,
         least(coalesce(w * CAST((SELECT rest FROM lv) AS DOUBLE) / CAST((SELECT open_w FROM lv) AS DOUBLE), 3.0 * source_size), CAST(3 * source_size AS DOUBLE)) AS target
  FROM o),
g AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM t),
h AS (
  SELECT source, h, sum(size) AS inside,
         coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d GROUP BY source, h),
e AS (
  SELECT g.source, CASE WHEN 2 * (g.target - g.passes * g.source_size - h.before) > h.inside THEN h.h + 1 ELSE h.h END AS threshold
  FROM g JOIN h ON g.source IS NOT DISTINCT FROM h.source
  WHERE h.before <= g.target - g.passes * g.source_size AND g.target - g.passes * g.source_size < h.before + h.inside
    AND g.target - g.passes * g.source_size > 0)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, g.source_size, g.target,
       CAST(d.size * (g.passes + CASE WHEN d.h < coalesce(e.threshold, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
