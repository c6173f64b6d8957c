"""Connected components of an edge list, with DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gapengine.llm.common import C, discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of ``edges`` (a, b); component is the smallest id reachable.

    Each round hangs every vertex's larger neighbours, then its smaller ones,
    onto its smallest neighbour.  Edges never become more, the depth of the
    trees shrinks by a constant factor, and the loop ends when every tree is a
    star.  Minima combine map-side, so a vertex with very many neighbours is no
    hot task.  Loops and repeated or null edges are allowed and change nothing;
    no edges give no rows.
    """
    ends = edges.filter(C("a") != C("b"))
    now = stored(ends.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("w")).distinct())
    mark = _mark(now)
    while True:
        both = now.select(C("v").alias("u"), C("w").alias("x")).union(now.select(C("w"), C("v")))
        least = both.groupBy("u").agg(F.min("x").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(C("x") > C("u")).join(least, "u").select(C("x").alias("v"), C("m").alias("w")).distinct()
        large = stored(large)
        # Each v has only smaller neighbours now: hang them and v onto the smallest.
        least = large.groupBy("v").agg(F.min("w").alias("m"))
        hung = large.join(least, "v").filter(C("w") != C("m")).select(C("w").alias("v"), C("m").alias("w"))
        small = stored(hung.union(least.select("v", C("m").alias("w"))).distinct())
        discard(large)
        discard(now)
        now, before, mark = small, mark, _mark(small)
        if mark == before:
            break
    return now.select(C("v").alias("id"), C("w").alias("component")).union(now.select("w", "w").distinct())


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and an order-free checksum of them."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "w").cast("decimal(38,0)"))).first())
