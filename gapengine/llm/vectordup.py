"""Embedding near-duplicates: a small-world graph per shard, queried with every vector, cosines verified, links united.

Equal vectors are one class and go on as one.  Classes are dealt evenly into
shards; each shard's graph is built once and stored.  Every pair of shards is
one task: the vectors of one search the graph of the other.  A task audits
itself, comparing a sample of its queries with all rows of the shard, and
widens the beam until the recall of links suffices.  A query whose beam is
full of links is compared with the whole shard instead, so no number of
partners is too many.  A task returns counts and a spanning forest of its
links, never the links of a dense group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from gapengine.llm.common import C, partitions, stored
from gapengine.llm.components import components
from gapengine.llm.smallworld import Graph, unit_rows

# Room between single and double precision.
SLACK = 1e-4
BLOCK = 256


class _Forest:
    """Union-find over row numbers, whole neighbourhoods at a time."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        up = self.parent[rows]
        while True:
            higher = self.parent[up]
            if np.array_equal(higher, up):
                break
            up = higher
        self.parent[rows] = up
        return up

    def unite(self, rows: np.ndarray) -> None:
        roots = np.unique(self.roots(rows))
        self.parent[roots] = roots[0]


def linked(
    graph: Graph, queries: np.ndarray, rows: np.ndarray, same: bool, weights: tuple[np.ndarray, np.ndarray], threshold: float,
    beam: int, audit: int, recall: float,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weight linked to each query, weight linked to each row, parents over queries then rows).

    ``queries`` and ``rows`` are unit vectors in double precision; ``same`` says
    that they are the same ones, whose own pairs don't count.
    """
    nq, nr = len(queries), len(rows)
    sample = np.unique(np.linspace(0, nq - 1, min(audit, nq)).astype(int))
    truth = queries[sample] @ rows.T >= threshold
    if same:
        truth[np.arange(len(sample)), sample] = False
    while True:
        ids, sims = graph.search(queries, beam)
        full = (sims >= threshold - SLACK).all(axis=1) & (len(rows) > beam)
        hits = np.zeros_like(truth)
        maybe = (ids[sample] >= 0) & (sims[sample] >= threshold - SLACK)
        hits[np.nonzero(maybe)[0], ids[sample][maybe]] = True
        missed = (truth & ~hits & ~full[sample, None]).sum()
        if missed <= (1 - recall) * truth.sum() or beam >= nr:
            break
        beam *= 2
    to_query, to_row = np.zeros(nq), np.zeros(nr)
    offset = 0 if same else nq
    forest = _Forest(nr + offset)
    q, slot = np.nonzero((sims >= threshold - SLACK) & (ids >= 0) & ~full[:, None])
    r = ids[q, slot]
    sure = np.concatenate([np.einsum("ij,ij->i", queries[q[s : s + 65536]], rows[r[s : s + 65536]]) for s in range(0, len(q), 65536)] or [np.zeros(0)]) >= threshold
    q, r = q[sure], r[sure]
    if same:
        # Found from either side; pairs with a full query are counted by that one.
        keep = (q != r) & ~full[r]
        pairs = np.unique(np.minimum(q[keep], r[keep]) * nr + np.maximum(q[keep], r[keep]))
        q, r = pairs // nr, pairs % nr
        q, r = np.concatenate([q, r]), np.concatenate([r, q])
    np.add.at(to_query, q, weights[1][r])
    if not same:
        np.add.at(to_row, r, weights[0][q])
    for a, b in zip(q.tolist(), r.tolist(), strict=True):
        forest.unite(np.array([a, b + offset]))
    wide = np.flatnonzero(full)
    for s in range(0, len(wide), BLOCK):
        block = wide[s : s + BLOCK]
        near = queries[block] @ rows.T >= threshold
        if same:
            near[np.arange(len(block)), block] = False
        to_query[block] += near @ weights[1]
        if same:
            narrow = ~full
            to_query[narrow] += weights[1][block] @ near[:, narrow]
        else:
            to_row += weights[0][block] @ near
        for i, line in zip(block.tolist(), near, strict=True):
            forest.unite(np.append(np.flatnonzero(line) + offset, i))
    return to_query, to_row, forest.roots(np.arange(len(forest.parent)))


_SHARD = "shard bigint, ids binary, sizes binary, units binary, layers array<binary>, links array<binary>"


def _built(degree: int, beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        ids = np.concatenate([b.column(0).to_numpy() for b in parts] or [np.zeros(0, np.int64)])
        if not len(ids):
            return
        sizes = np.concatenate([b.column(1).to_numpy() for b in parts]).astype(np.float64)
        order = np.argsort(ids)
        units = unit_rows(np.concatenate([b.column(2).flatten().to_numpy() for b in parts]).reshape(len(ids), -1))[order]
        graph = Graph(units, ids[order], degree, beam)
        yield pa.RecordBatch.from_pylist([{
            "shard": TaskContext.get().partitionId(), "ids": ids[order].tobytes(), "sizes": sizes[order].tobytes(), "units": units.tobytes(),
            "layers": [rows.tobytes() for rows, _ in graph.layers], "links": [links[rows].tobytes() for rows, links in graph.layers],
        }], schema=pa.schema([("shard", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("units", pa.binary()),
                              ("layers", pa.list_(pa.binary())), ("links", pa.list_(pa.binary()))]))

    return run


def _restored(pair: dict, units: np.ndarray, degree: int) -> Graph:
    layers = []
    for i, (rows, links) in enumerate(zip(pair["layers"], pair["links"], strict=True)):
        rows = np.frombuffer(rows, np.int64)
        whole = np.full((len(units), 2 * degree if i == 0 else degree), -1, dtype=np.int32)
        whole[rows] = np.frombuffer(links, np.int32).reshape(len(rows), -1)
        layers.append((rows, whole))
    return Graph.restored(units, degree, 512, layers)


def _joined(degree: int, threshold: float, beam: int, audit: int, recall: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pair = batch.slice(i, 1).to_pylist()[0]
                ids, sizes = np.frombuffer(pair["ids"], np.int64), np.frombuffer(pair["sizes"])
                rows = np.frombuffer(pair["units"]).reshape(len(ids), -1)
                same = pair["qids"] is None
                qids, qsizes = (ids, sizes) if same else (np.frombuffer(pair["qids"], np.int64), np.frombuffer(pair["qsizes"]))
                queries = rows if same else np.frombuffer(pair["qunits"]).reshape(len(qids), -1)
                to_query, to_row, roots = linked(
                    _restored(pair, rows, degree), queries, rows, same, (qsizes, sizes), threshold, beam, audit, recall)
                names = ids if same else np.concatenate([qids, ids])
                count = to_query if same else np.concatenate([to_query, to_row])
                some = np.flatnonzero(count)
                yield pa.record_batch([
                    pa.array(names[some]), pa.array(count[some].astype(np.int64)), pa.array(names[roots[some]]),
                ], names=["id", "n", "root"])

    return run


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, shard_rows: int = 16_384,
    degree: int = 16, beam: int = 32, audit: int = 256, recall: float = 0.99,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``vectors``.

    Linked are vectors with cosine (double precision) of ``threshold`` or more,
    found by graphs whose ``audit`` sample reaches ``recall`` of all links in
    its shard.  ``n_links`` counts the other rows linked, ``component_id`` is
    the smallest id reachable, ``kept`` says that it is the row's own.

    A null, empty or zero vector, and one that holds a null or a value that is
    not finite, links with nothing; so does one whose length differs from the
    table's most common one, and a row without id, which is kept and has no
    component.  Repeated rows are linked copies of each other.  Other columns
    are not read.
    """
    spark = vectors.sparkSession
    x = C("v")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(x, lambda e: e != 0)
    rows = vectors.select(C(id_col).cast("bigint").alias("vec_id"), C(vector_col).cast("array<double>").alias("v"))
    usable = C("vec_id").isNotNull() & C("v").isNotNull() & F.coalesce(finite, F.lit(False))
    rows = stored(rows.select(
        "vec_id", F.when(usable, C("v")).alias("v"), F.when(usable, F.xxhash64(F.lit(1), "v")).alias("h1"), F.when(usable, F.xxhash64(F.lit(2), "v")).alias("h2")))
    used = rows.filter(C("v").isNotNull())
    common = used.groupBy(F.size("v").alias("width")).count().orderBy(C("count").desc(), "width").first()
    classes = stored(
        used.filter(F.size("v") == (common["width"] if common else 0)).groupBy("h1", "h2")
        .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    )
    n_shards = max(1, math.ceil(classes.count() / shard_rows))
    shards = stored(classes.select("rep", "copies", "v").repartition(n_shards).mapInArrow(_built(degree, 2 * beam), _SHARD))
    # Every pair of shards once: the lower one's vectors search the higher one's graph.
    queries = shards.select(C("shard").alias("q"), C("ids").alias("qids"), C("sizes").alias("qsizes"), C("units").alias("qunits"))
    pairs = shards.withColumn("q", F.explode(F.sequence(F.lit(0), C("shard").cast("int")).cast("array<bigint>"))).join(
        queries, "q"
    )
    own = C("q") == C("shard")
    pairs = pairs.select(
        "ids", "sizes", "units", "layers", "links",
        *[F.when(~own, C(c)).alias(c) for c in ("qids", "qsizes", "qunits")],
    ).repartition(min(n_shards * (n_shards + 1) // 2, 16 * partitions(spark)))
    found = stored(pairs.mapInArrow(_joined(degree, threshold, beam, audit, recall), "id bigint, n bigint, root bigint"))
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    grouped = components(found.select(C("id").alias("a"), C("root").alias("b")))
    results = stored(
        classes.join(links, C("rep") == links.id, "left").drop("id").join(grouped, C("rep") == grouped.id, "left")
        .filter((C("copies") > 1) | C("n").isNotNull())
        .select("h1", "h2", (F.coalesce("n", F.lit(0)) + C("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    )
    out = rows.select("vec_id", "h1", "h2").join(results, ["h1", "h2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), component.eqNullSafe(C("vec_id")).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN m ON m.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
