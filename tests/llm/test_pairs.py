"""Near-duplicates, components and vectors against brute force."""

import itertools
import random
import re

import numpy as np
import pytest

from gapengine.llm.bitsliced import exact_top_k
from gapengine.llm.components import components
from gapengine.llm.neardup import near_duplicates, super_minhash
from gapengine.llm.vectordup import near_vectors


def grouped(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_match_brute_force(docs_of, k):
    rng = random.Random(k)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = [(i, edited(rng, base, rng.randrange(14))) for i in range(60)]
    # A chain: each a few edits from the one before, the ends far apart.
    text = [f"c{j}" for j in range(100)]
    for i in range(60, 75):
        rows.append((i, " ".join(text)))
        text = edited(rng, text, 4 if k == 2 else 1).split()
    rows += [(80, None), (81, ""), (82, " \n\t"), (83, "One"), (84, "one"), (85, "one two"), (86, "One  TWO"), (87, "É one"), (88, "é one")]
    rows += [(90, " ".join(base)), (91, " ".join(base).upper()), (91, " ".join(base).upper()), (92, "long " * 30_000)]
    got = near_duplicates(docs_of(*rows, (None, "one two"), (None, None)), words=k).collect()
    sets = {i: shingles(t, k) for i, t in rows}
    links = [
        (a, b) for a, b in itertools.combinations(sets, 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    root = grouped(sets, links)
    assert len(got) == len(rows) + 2 and links
    for row in got:
        if row.doc_id is None:
            assert row.component_id is None and row.kept
        else:
            assert (row.n_shingles, row.component_id, row.kept) == (len(sets[row.doc_id]), root[row.doc_id], root[row.doc_id] == row.doc_id)


def test_near_duplicates_of_nothing(docs_of, spark):
    assert near_duplicates(docs_of((1, "a b")).limit(0)).collect() == []


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    both = rng.integers(0, 2**63, 800, dtype=np.uint64)
    a, b = np.concatenate([both, rng.integers(0, 2**63, 100, dtype=np.uint64)]), np.concatenate([both, rng.integers(0, 2**63, 100, dtype=np.uint64)])
    s = super_minhash(np.concatenate([a, b]), np.array([900, 900]), 256)
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.1
    # Early stopping changes nothing: every value is the least over all elements.
    alone = np.stack([super_minhash(a[i : i + 1], np.array([1]), 256)[0] for i in range(0, 900)])
    assert np.array_equal(alone.min(axis=0), s[0])
    assert sorted(np.floor(alone[0]).astype(int)) == list(range(256))


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200 + i) for i in range(30)]
    edges += [(5, 5), (None, 3), *edges[:5]]
    real = [(a, b) for a, b in edges if a is not None]
    root = grouped({x for e in real for x in e}, real)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: root[i] for a, b in real if a != b for i in (a, b)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, "q") for i, v in rows], "vec_id bigint, embedding array<float>, label int, n string")


def odd_vectors():
    return [(1000, None), (1001, [0.0] * 8), (1002, [1.0] * 7 + [None]), (1003, [float("nan")] * 8), (1004, [float("inf")] * 8), (1005, [])]


def test_near_vectors_match_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + rng.normal(size=8) * (0.02 + 0.03 * (i % 5))).astype(np.float32).tolist()) for i in range(500)]
    rows += [(500 + i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(100)]
    rows += [(700 + i, rows[3][1]) for i in range(20)] + [rows[7]]
    units = np.array([v for _, v in rows], dtype=np.float64)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    near = units @ units.T >= 0.95
    np.fill_diagonal(near, False)
    ids = [i for i, _ in rows]
    root = grouped(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))])
    expected = sorted((i, int(n), root[i], root[i] == i) for i, n in zip(ids, near.sum(axis=1)))
    got = near_vectors(vectors_of(spark, [*rows, *odd_vectors(), (None, rows[0][1])]), shard_rows=150, beam=8, audit=10_000, recall=1.0).collect()
    plain = sorted(tuple(r) for r in got if r.vec_id is not None and r.vec_id < 1000)
    assert plain == expected
    assert all((r.n_links, r.component_id, r.kept) == (0, r.vec_id, True) for r in got if r.vec_id is None or r.vec_id >= 1000)
    assert near_vectors(vectors_of(spark, odd_vectors())).count() == 6
    assert near_vectors(vectors_of(spark, [])).count() == 0


def test_exact_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=8) * 10.0 ** rng.integers(-3, 3)).astype(np.float32).tolist()) for i in range(180)]
    rows += [(200 + i, rows[50][1]) for i in range(12)] + [rows[9], (300, [0.5, -0.5])]
    values = {k: [int(np.floor(256 * float(np.float32(x)))) for x in v] for k, v in rows}
    expected = {}
    for q in sorted({i for i, _ in rows if i % 50 == 0}):
        scores = [(-sum(a * b for a, b in zip(values[q], values[i])), i) for i, _ in rows if i != q]
        expected[q] = [(i, -s) for s, i in sorted(scores)[:5]]
    got = exact_top_k(vectors_of(spark, [*rows, *[(i, v) for i, v in odd_vectors() if i not in (1001, 1005)], (None, rows[0][1])]), block_rows=40, block_queries=2).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found == expected
    assert exact_top_k(vectors_of(spark, [])).count() == 0
    assert exact_top_k(vectors_of(spark, rows[50:51])).count() == 0
    # Scores that leave 64 bits take no part; the largest that fit are exact.
    huge = [(0, [1e30, 1.0]), (1, [-1e30]), (50, [2.0**22, -1.0]), (51, [2.0**22, 2.0]), (52, [-(2.0**22), 0.0])]
    top = {(r.query_id, r.vec_id): r.score for r in exact_top_k(vectors_of(spark, huge)).collect()}
    assert top == {(50, 51): (1 << 60) - 256 * 512, (50, 52): -(1 << 60)}
