"""Hard negatives, Merkle manifests and decontamination against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from gapengine.llm.decontam import contamination, contamination_report
from gapengine.llm.hardneg import exact_scores, hard_negatives, primes_for, relabelled, residues
from gapengine.llm.merkle import merkle_manifest, merkle_report

# ------------------------------------------------------------------ hard negatives


@pytest.mark.parametrize("size", [1, 2**7, 2**15, 2**27])
def test_scores_from_residues_are_exact(size):
    rng = np.random.default_rng(size)
    a, b = rng.integers(-size, size + 1, (7, 150)), rng.integers(-size, size + 1, (9, 150))
    a[0], b[0] = size, -size
    bound = 150 * size * size
    primes = primes_for(bound)
    assert np.prod([float(p) for p in primes]) > 2 * bound
    got = exact_scores(residues(a, primes), residues(b, primes), primes)
    want = [[sum(int(x) * int(y) for x, y in zip(r, c)) for c in b] for r in a]
    assert got.tolist() == want


def vectors_of(spark, rows):
    full = [(i, v, label, "x", 7, "y") for i, v, label in rows]
    return spark.createDataFrame(full, "vec_id bigint, embedding array<float>, label int, values string, place int, id string")


def mined(rows):
    ok = [
        (i, [int(np.floor(256 * float(np.float32(x)))) for x in v], label) for i, v, label in rows
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)
    ]
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, va, la in sorted({(i, tuple(v), label) for i, v, label in ok if i % 50 == 0}):
        best = lambda same: sorted((-score(va, v), i) for i, v, label in ok if (label == la) == same and i != a)
        for ps, p in best(True)[:5]:
            inside = [(-s, n) for s, n in best(False) if 50 * -ps <= 100 * -s <= 95 * -ps][:3]
            out += [(a, p, k + 1, n, -ps, s) for k, (s, n) in enumerate(inside)]
    return sorted(out)


def odd_vectors():
    return [(900, None, 1), (901, [1.0] * 7 + [None], 1), (902, [float("nan")] * 8, 2), (903, [float("inf")] * 8, 1), (904, [], 1), (905, [0.3] * 8, None),
            (None, [0.3] * 8, 1), (906, [0.5, -0.5], 2), (950, [], 3)]


@pytest.mark.parametrize("scale", [0.1, 3000.0])
def test_hard_negatives_match_brute_force(spark, scale):
    rng = np.random.default_rng(int(scale) + 1)
    centre = rng.normal(size=8)
    rows = [(i, ((centre + rng.normal(size=8)) * scale).astype(np.float32).tolist(), int(rng.integers(4))) for i in range(250)]
    rows += [(300 + i, rows[50][1], i % 3) for i in range(12)] + [rows[50], rows[100], (150, rows[3][1], 9), *odd_vectors()]
    want = mined(rows)
    assert len(want) > 30
    got = hard_negatives(vectors_of(spark, rows), block_rows=40).collect()
    assert sorted(tuple(r) for r in got) == want


def test_hard_negatives_by_copied_anchors(spark, monkeypatch):
    from gapengine.llm import hardneg

    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist(), int(rng.integers(3))) for i in range(400)]
    monkeypatch.setattr(hardneg, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(hardneg, "BLOCK_ANCHORS", 3)
    assert sorted(tuple(r) for r in hard_negatives(vectors_of(spark, rows), block_rows=90).collect()) == mined(rows)


def test_hard_negatives_of_little(spark):
    from pyspark.sql import functions as F

    assert hard_negatives(vectors_of(spark, [])).count() == 0
    assert hard_negatives(vectors_of(spark, [(50, [1.0], 1), (51, [1.0], 1)])).count() == 0
    # Too long for 64-bit scores: takes no part; the other rows are served.
    rows = [(50, [1.0, 0.0], 1), (51, [1.0, 0.0], 1), (52, [0.7, 0.0], 2), (53, [1e30, 0.0], 2), (54, [1e30, 0.0], 1)]
    assert [tuple(r) for r in hard_negatives(vectors_of(spark, rows)).collect()] == [(50, 51, 1, 52, 65536, 256 * 179)]
    labels = vectors_of(spark, [(7, [1.0], 9), (8, [1.0], 9), (14, [1.0], None)]).select(relabelled(F.col("label"), F.col("vec_id"))).collect()
    assert [r[0] for r in labels] == [0, 9, None]


# -------------------------------------------------------------------------- Merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes, k):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(*last[i : i + k]) for i in range(0, len(last), k)])
    return levels


def path(levels, at, k):
    out = []
    for level in levels[:-1]:
        start = at - at % k
        out.append(("".join(level[start:at]), "".join(level[at + 1 : start + k])))
        at //= k
    return out


def manifest(rows, k=2):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in groups[g]], k)
    top = tree([trees[g][-1][0] for g in order], k)
    out = []
    for t, g in enumerate(order):
        for at, r in enumerate(groups[g]):
            steps = path(trees[g], at, k) + path(top, t, k)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            now = leaf((*r[:3], r[3] + 1, r[4])) if changed else leaf(r)
            for left, right in steps:
                now = H(left, now, right)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], H(*[a + b for a, b in steps]), now, now == top[-1][0]))
    return out


def documents(spark, rows):
    return spark.createDataFrame([(*r, "a", 1, "b") for r in rows], "doc_id bigint, source string, lang string, n_chars bigint, text string, place string, n int, digest string")


def some_rows(n):
    rng = random.Random(n)
    rows = [(i, f"s{i % 3}", rng.choice(["en", "en", "en", "de", "fr", "É", "", None]), rng.choice([None, i]), f"text ü {i}") for i in range(n)]
    return rows + [(None, None, None, None, None), (None, "s", "en", 3, ""), (3, "s", "xx", 4, "long " * 50_000), *rows[:3], rows[0]]


@pytest.mark.parametrize("k", [2, 3, 5])
def test_manifest_matches_brute_force(spark, k):
    rows = some_rows(75)
    got = sorted((tuple(r) for r in merkle_report(documents(spark, rows), fanout=k).collect()), key=str)
    assert got == sorted(manifest(rows, k), key=str)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("rows", [[], [(4, "s", "en", 1, "a")], [(4, "s", "en", 1, "a"), (5, None, "de", 2, "b")], [(i, "s", None, i, "x") for i in range(9)]])
def test_small_manifests(spark, rows):
    got = sorted((tuple(r) for r in merkle_report(documents(spark, rows)).collect()), key=str)
    assert got == sorted(manifest(rows), key=str)


def test_manifest_of_other_columns(spark):
    df = spark.createDataFrame([(i, f"v{i}", i % 2) for i in range(6)], "k int, v string, g int")
    rows = merkle_manifest(df, ["k", "v"], "k", "g").collect()
    assert len({bytes(r.root) for r in rows}) == 1 and len({bytes(r.subroot) for r in rows}) == 2
    assert sorted((r.g, r.place, r.k) for r in rows) == [(0, 0, 0), (0, 1, 2), (0, 2, 4), (1, 0, 1), (1, 1, 3), (1, 2, 5)]


# ----------------------------------------------------------------- decontamination


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def hits(docs, items):
    windows = {}
    for item, text in items:
        w = words_of(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = []
    for i, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in lengths:
            for at in range(len(w) - n + 1):
                if (held := windows.get(tuple(w[at : at + n]))) is not None:
                    hit |= set(range(at, at + n))
                    found |= held
        found = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def bench_of(spark, items):
    return spark.createDataFrame([(i, t, "k", 1, "c") for i, t in items], "item_id bigint, text string, key string, n int, class string")


def material(rng):
    word = lambda: rng.choice(["w%d" % rng.randrange(60), "É%d" % rng.randrange(5), "o"])
    items = [(i, " ".join(word() for _ in range(rng.randrange(0, 30)))) for i in range(40)]
    items += [(100, None), (101, ""), (102, "..."), (103, "zz"), (104, "alpha Beta"), (105, "q r s"), (None, "lonely item of exactly ten words that has no id"),
              (7, items[3][1]), (200, "hot " * 40), (201, "Hot, hot! hot? hot hot hot hot hot hot hot"), *items[:2]]
    docs = []
    for i in range(150):
        parts = []
        for _ in range(rng.randrange(4)):
            w = words_of(rng.choice(items)[1])
            a, b = sorted((rng.randrange(len(w) + 1), rng.randrange(len(w) + 1)))
            if rng.random() < 0.5:
                a, b = 0, len(w)
            parts += [word() for _ in range(rng.randrange(6))] + [x.upper() if x.isascii() and rng.random() < 0.2 else x for x in w[a:b]]
            parts += [word() for _ in range(rng.randrange(6))]
        docs.append((i, rng.choice([" ", "  ", "\n", "-", ", "]).join(parts)))
    passage = items[5][1] + " " + items[6][1]
    docs += [(500 + i, f"n{i} {passage} tail") for i in range(80)]
    docs += [(900, None), (901, ""), (902, " \n"), (903, "zz"), (904, "x alpha. beta y"), (905, "q r s q r s"), (906, "hot " * 9), (907, "hot " * 5000),
             (None, "zz zz"), (None, None), (5, "zz"), docs[0], docs[0], (908, ("filler " * 30_000) + passage), (909, "A lonely item of exactly ten words that has no id.")]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_contamination_matches_brute_force(spark, docs_of, seed):
    docs, items = material(random.Random(seed))
    got = [tuple(r) for r in contamination_report(docs_of(*docs), bench_of(spark, items)).collect()]
    want = hits(docs, items)
    assert sorted(got, key=str) == want
    assert sum(r[5] for r in want) > 80


def test_spans_and_items(spark, docs_of):
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "TWO three")]
    text = "start one two three four five six seven eight nine ten eleven. two three two"
    row = contamination(docs_of((1, text)), bench_of(spark, items)).collect()[0]
    covered = sorted(x for a, b in row.spans for x in range(a, b))
    assert covered == [*range(1, 12), 12, 13] and row.n_hit == 13 and row["items"] == ["1", "2"]


def test_contamination_of_nothing(spark, docs_of):
    assert contamination(docs_of((1, "a")).limit(0), bench_of(spark, [(1, "a")])).count() == 0
    got = contamination_report(docs_of((1, "a b"), (2, None)), bench_of(spark, [])).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in got) == [(1, 2, 0, False), (2, 0, 0, False)]


def test_words_of_pieces(monkeypatch):
    from gapengine.llm import decontam

    texts = ["alpha beta", "gamma", "", "Gamma delta" * 20, "é ü", " x "]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *[len(t.encode()) for t in texts]])
    whole = decontam._Words(data, offsets)
    monkeypatch.setattr(decontam, "CHUNK_BYTES", 7)
    parts = decontam._Words(data, offsets)
    for a, b in ((whole.starts, parts.starts), (whole.ends, parts.ends), (whole.hashes, parts.hashes)):
        assert np.array_equal(a, b)
    assert np.diff(whole.bounds).tolist() == [len(words_of(t)) for t in texts]
