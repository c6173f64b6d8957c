"""Merkle manifest of a dataset: one tree for each group of rows, and one over the groups' roots.

Nodes of a level are rows (tree, place, digest).  Each level is one equality
join of the level with itself: a node's sibling has a place that follows from
its own, ``place XOR 1`` in a binary tree, the next slots of its run otherwise.
The nodes in slot 0 then hold everything their parent needs and emit it.  Runs
are filled from the left; a run that is not full is hashed as it is, and a tree
ends with its first level of one node.

Every level is stored with its siblings, so proofs are read off top-down: a
node's proof is its own siblings and then its parent's proof.  Levels shrink by
the fan-out, so all of them together are little more than the lowest.  Places
come from ranges of the whole table, so a group of any size spans many tasks;
texts are hashed where they are read and never shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from gapengine.llm.common import C, discard, ranked, stored

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def framed(value: Column) -> Column:
    """A value with its length in front, so that no two rows give the same bytes; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """SHA-256 (32 bytes) of texts written one after another."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def hex_of(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def leaf_of(fields: dict[str, Column] | list[str]) -> Column:
    columns = list(fields.values()) if isinstance(fields, dict) else [C(f) for f in fields]
    return digest(*[framed(c) for c in columns])


def _level(nodes: DataFrame, fanout: int) -> DataFrame:
    """``nodes`` with ``left`` and ``right``: the digests of the run's others, before and after each node."""
    slot, start = C("place") % fanout, C("place") - C("place") % fanout
    out = nodes
    for offset in range(1, fanout):
        # The place of the node that has this one as its sibling ``offset`` slots on.
        if fanout == 2:
            seen_from = C("place").bitwiseXOR(F.lit(1).cast("bigint"))
        else:
            seen_from = start + F.pmod(slot - offset, F.lit(fanout))
        sibling = nodes.select("tree", seen_from.alias("place"), C("digest").alias(f"_sibling{offset}"))
        out = out.join(sibling, ["tree", "place"], "left")
    slot = slot.cast("int")
    others = F.array(*[C(f"_sibling{o}") for o in range(1, fanout)])

    def text(some: Column) -> Column:
        return F.array_join(F.transform(F.filter(some, lambda x: x.isNotNull()), hex_of), "")

    left, right = F.slice(others, F.lit(fanout) - slot, slot), F.slice(others, F.lit(1), F.lit(fanout - 1) - slot)
    return out.select("tree", "place", "n", "digest", F.unhex(text(left)).alias("left"), F.unhex(text(right)).alias("right"))


def _grow(leaves: DataFrame, most: int, fanout: int) -> list[DataFrame]:
    """All levels, the lowest first; ``most`` is the number of leaves of the largest tree."""
    levels, nodes = [], leaves
    while True:
        levels.append(stored(_level(nodes, fanout)))
        if most <= 1:
            return levels
        whole = F.concat(hex_of(C("digest")), hex_of(C("right")))
        nodes = levels[-1].filter((C("n") > 1) & (C("place") % fanout == 0)).select(
            "tree", F.floor(C("place") / fanout).alias("place"), F.ceil(C("n") / fanout).alias("n"), digest(whole).alias("digest")
        )
        most = math.ceil(most / fanout)


def _step() -> Column:
    return F.array(F.struct("left", "right"))


def _proofs(levels: list[DataFrame], fanout: int) -> DataFrame:
    """(tree, place, proof) of the lowest level: each node's siblings up to the root of its tree."""
    proofs = None
    for level in reversed(levels):
        own = F.when(C("n") > 1, _step()).otherwise(F.array().cast("array<struct<left:binary,right:binary>>"))
        here = level.select("tree", "place", "n", own.alias("own"), F.floor(C("place") / fanout).alias("up"))
        if proofs is None:
            proofs = here.select("tree", "place", C("own").alias("proof"))
            continue
        above = proofs.select("tree", C("place").alias("up"), "proof")
        joined = here.join(above, ["tree", "up"], "left")
        # A tree that ends here has no parent of its own.
        proof = F.when(C("n") > 1, F.concat("own", "proof")).otherwise(C("own"))
        proofs = joined.select("tree", "place", proof.alias("proof"))
    return proofs


def _roots(levels: list[DataFrame]) -> DataFrame:
    found = None
    for level in levels:
        top = level.filter("n = 1").select("tree", C("digest").alias("subroot"))
        found = top if found is None else found.unionByName(top)
    return found


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda at, step: digest(hex_of(step["left"]), hex_of(at), hex_of(step["right"])))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings of a proof, from the leaf up and from left to right."""
    return digest(F.array_join(F.transform(proof, lambda s: F.concat(hex_of(s["left"]), hex_of(s["right"]))), ""))


def merkle_manifest(
    rows: DataFrame, fields: list[str] | None = None, id_col: str = "doc_id", group_col: str = "lang", fanout: int = 2,
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """(id_col, group_col, carried columns, place, leaf, proof, subroot, root) for every row.

    ``leaf`` hashes ``fields``, each as its byte count, a colon and its value.
    Leaves of a group ascend by id, and groups by their value (bytewise).
    ``proof`` lists, from the leaf to ``root``, what stands left and right of
    the node in its run, so ``folded(leaf, proof)`` is ``root``.  ``carry``
    names more columns, computed where the rows are read.

    Null fields have a mark of their own.  Rows without id come first in their
    group, rows without group form the first group.  Rows that share an id
    ascend by leaf; equal rows are leaves of their own.  Empty and very long
    texts are hashed whole.  A group of one row has that leaf as its root; a
    table of one group has its subroot as root.  An empty table gives no rows.
    Other columns are not read.
    """
    fields, carry = fields or FIELDS, carry or {}
    kept = rows.select(
        C(id_col).alias("_id"), C(group_col).alias("_group"), leaf_of(fields).alias("_leaf"), *[c.alias(f"_c_{name}") for name, c in carry.items()]
    )
    placed = stored(ranked(kept, [C("_group").asc_nulls_first(), C("_id").asc_nulls_first(), C("_leaf").asc()], "_rank"))
    groups = placed.groupBy("_group").agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("n"))
    groups = stored(ranked(groups, [C("_group").asc_nulls_first()], "tree"))
    n_trees, most = groups.agg(F.count(F.lit(1)), F.max("n")).first()
    same = placed["_group"].eqNullSafe(groups["_group"])
    leaves = stored(
        placed.join(groups.select("_group", "_first", "n", "tree"), same).select(
            placed["_group"], "_id", *[f"_c_{name}" for name in carry], "tree", (C("_rank") - C("_first")).alias("place"), "n", C("_leaf").alias("digest")
        )
    )
    levels = _grow(leaves.select("tree", "place", "n", "digest"), most or 0, fanout)
    subroots = stored(_roots(levels))
    upper = _grow(
        subroots.select(F.lit(0).cast("bigint").alias("tree"), C("tree").alias("place"), F.lit(n_trees).cast("bigint").alias("n"), C("subroot").alias("digest")),
        n_trees, fanout,
    )
    root = _roots(upper).select(C("subroot").alias("root"))
    above = _proofs(upper, fanout).select(C("place").alias("tree"), C("proof").alias("above"))
    tops = stored(subroots.join(above, "tree").join(F.broadcast(root)))  # one row
    out = (
        leaves.join(_proofs(levels, fanout), ["tree", "place"]).join(tops, "tree")
        .select(
            C("_id").alias(id_col), C("_group").alias(group_col), *[C(f"_c_{name}").alias(name) for name in carry],
            "place", C("digest").alias("leaf"), F.concat("proof", "above").alias("proof"), "subroot", "root",
        )
    )
    result = stored(out)
    for used in (placed, groups, leaves, subroots, tops, *levels, *upper):
        discard(used)
    return result


def merkle_report(docs: DataFrame, fanout: int = 2) -> DataFrame:
    """Per document: its leaf, its tree's and the whole root, and whether its copy still proves to be in the dataset.

    Copies whose id has a CRC-32 divisible by 7 have one character more counted
    than the original (no count, no change; no id, no change), and must fail.
    """
    changed = F.crc32(C("doc_id").cast("string").cast("binary")) % 7 == 0
    fields = {f: C(f) for f in FIELDS} | {"n_chars": C("n_chars") + 1}
    made = merkle_manifest(docs, fanout=fanout, carry={"copy": F.when(changed, leaf_of(fields))})
    root = folded(F.coalesce("copy", "leaf"), C("proof"))
    return made.withColumn("_folded", root).select(
        "doc_id", hex_of(C("leaf")).alias("leaf"), hex_of(C("subroot")).alias("subroot"), hex_of(C("root")).alias("root"),
        hex_of(proof_digest(C("proof"))).alias("proof_sha256"), hex_of(C("_folded")).alias("folded_root"), (C("_folded") == C("root")).alias("verified"),
    )


# crc32 runs bit by bit over the decimal digits; levels are built by recursion over places.
ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, lang,
    coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
    n_chars, coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail,
    xor(list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), list_transform(generate_series(0, 8 * length(CAST(doc_id AS VARCHAR)) - 1),
        lambda i: CASE WHEN i % 8 = 0 THEN CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i // 8 + 1 AS INTEGER), 1)) AS BIGINT) ELSE CAST(0 AS BIGINT) END)),
      lambda c, x: CASE WHEN xor(c, x) % 2 = 1 THEN xor(xor(c, x) // 2, CAST(3988292384 AS BIGINT)) ELSE xor(c, x) // 2 END
    ), CAST(4294967295 AS BIGINT)) % 7 = 0 AS changed
  FROM documents),
e AS (
  SELECT doc_id, lang, sha256(head || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN changed THEN sha256(head || coalesce(length(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) END AS copy FROM d),
g AS (SELECT coalesce('v' || lang, '') AS k, CAST(count(*) AS BIGINT) AS n, CAST(row_number() OVER (ORDER BY coalesce('v' || lang, '')) - 1 AS BIGINT) AS t FROM e GROUP BY 1),
l AS (
  SELECT e.*, g.t, g.n, CAST(row_number() OVER (PARTITION BY g.t ORDER BY doc_id, leaf) - 1 AS BIGINT) AS p FROM e JOIN g ON coalesce('v' || lang, '') = k),
lower_(lev, t, p, n, h, s) AS (
  SELECT 0, t, p, n, leaf, coalesce(CASE WHEN p % 2 = 0 THEN lead(leaf) OVER w ELSE lag(leaf) OVER w END, '') FROM l WINDOW w AS (PARTITION BY t ORDER BY p)
  UNION ALL
  SELECT lev, t, p, n, h, coalesce(CASE WHEN p % 2 = 0 THEN lead(h) OVER w ELSE lag(h) OVER w END, '')
  FROM (SELECT lev + 1 AS lev, t, p // 2 AS p, (n + 1) // 2 AS n, sha256(h || s) AS h FROM lower_ WHERE n > 1 AND p % 2 = 0) WINDOW w AS (PARTITION BY t ORDER BY p)),
sub AS (SELECT t, h AS subroot FROM lower_ WHERE n = 1),
upper_(lev, p, n, h, s) AS (
  SELECT 0, t, (SELECT count(*) FROM sub), subroot, coalesce(CASE WHEN t % 2 = 0 THEN lead(subroot) OVER w ELSE lag(subroot) OVER w END, '') FROM sub WINDOW w AS (ORDER BY t)
  UNION ALL
  SELECT lev, p, n, h, coalesce(CASE WHEN p % 2 = 0 THEN lead(h) OVER w ELSE lag(h) OVER w END, '')
  FROM (SELECT lev + 1 AS lev, p // 2 AS p, (n + 1) // 2 AS n, sha256(h || s) AS h FROM upper_ WHERE n > 1 AND p % 2 = 0) WINDOW w AS (ORDER BY p)),
top AS (SELECT h AS root FROM upper_ WHERE n = 1),
walk(doc_id, t, leaf, subroot, lev, p, n, h, proof) AS (
  SELECT doc_id, l.t, leaf, subroot, 0, p, n, coalesce(copy, leaf), '' FROM l JOIN sub ON l.t = sub.t
  UNION ALL
  SELECT w.doc_id, w.t, w.leaf, w.subroot, w.lev + 1, w.p // 2, (w.n + 1) // 2,
    sha256(CASE WHEN w.p % 2 = 0 THEN w.h || x.s ELSE x.s || w.h END), w.proof || x.s
  FROM walk w JOIN lower_ x ON w.n > 1 AND x.lev = w.lev AND x.t = w.t AND x.p = w.p),
climb(doc_id, leaf, subroot, lev, p, n, h, proof) AS (
  SELECT doc_id, leaf, subroot, 0, t, (SELECT count(*) FROM sub), h, proof FROM walk WHERE n = 1
  UNION ALL
  SELECT w.doc_id, w.leaf, w.subroot, w.lev + 1, w.p // 2, (w.n + 1) // 2,
    sha256(CASE WHEN w.p % 2 = 0 THEN w.h || x.s ELSE x.s || w.h END), w.proof || x.s
  FROM climb w JOIN upper_ x ON w.n > 1 AND x.lev = w.lev AND x.p = w.p)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified FROM climb, top WHERE n = 1
"""
