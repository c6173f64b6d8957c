"""The word model against its formula, and text whose words are ordinary but whose order isn't."""

from collections import Counter

import numpy as np
import pytest

from gapengine.llm.kneserney import score_quality
from gapengine.llm.wordmodel import word_scores


def plain_perplexity(texts, judged, own=None):
    """Log perplexity of ``judged`` under all ``texts``; ``own``: without n-grams only text number ``own`` has."""
    lines = [["<", "<", *t.lower().split(), "<"] for t in texts]
    where, three = {}, Counter()
    for i, x in enumerate(lines):
        for gram in zip(x, x[1:], x[2:]):
            three[gram] += 1
            for part in (("3", *gram), ("3c", *gram[:2]), ("2", *gram[1:]), ("2c", gram[1]), ("1", gram[2])):
                where.setdefault(part, set()).add(i)
    two = Counter(x[1:] for x in three)
    one = Counter(x[1:] for x in two)
    gone = lambda part: own is not None and where.get(part) == {own}

    def discounts(c):
        n = [max(1, sum(v == k for v in c.values())) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k) for k in (1, 2, 3)]

    def prob(gram, tables, names):
        if not tables:
            return 1 / (len(one) + 1)
        c, lower = tables[0], prob(gram[1:], tables[1:], names[1:])
        d = discounts(c)
        around = [v for k, v in c.items() if k[:-1] == gram[:-1]]
        if not around or (gram[:-1] and gone((names[0] + "c", *gram[:-1]))):
            return lower
        cut = lambda v: d[min(v, 3) - 1]
        n = 0 if gone((names[0], *gram)) else c.get(gram, 0)
        return ((n - cut(n)) if n else 0) / sum(around) + sum(map(cut, around)) / sum(around) * lower

    x = ["<", "<", *judged.lower().split(), "<"]
    logs = [np.log(prob(g, [three, two, one], ["3", "2", "1"])) for g in zip(x, x[1:], x[2:])]
    return -sum(logs) / len(logs)


def test_word_model_follows_its_formula(spark):
    texts = ["The cat sat on the mat", "the dog sat on the log", "a cat and a dog ran", "the the the cat", "a remarkable cat sat on a log"]
    others = ["the cat ran on a mat", "nothing here is known", "remarkable dog"]
    rows = spark.createDataFrame([(i, 0, t) for i, t in enumerate([*texts, *others, "", None])], "id bigint, name bigint, text string")
    got = {r.id: r for r in word_scores(rows.repartition(3), spark.range(len(texts)).toDF("id")).collect()}
    assert len(got) == 10 and got[8].plain is None and got[9].plain is None
    for i, t in enumerate([*texts, *others]):
        assert got[i].n_words == len(t.split()) and got[i].plain == pytest.approx(plain_perplexity(texts, t), abs=1e-4)
    for i, t in enumerate(texts):
        assert got[i].others == pytest.approx(plain_perplexity(texts, t, i), abs=1e-4)


def test_words_of_ordinary_shape_in_no_ordinary_text(docs_of):
    rng = np.random.default_rng(3)
    short = "the of and to in a is that for it with as was on be by at this from".split()
    long = ["".join(rng.choice(list("abcdefgh"), 7)) for _ in range(60)]
    line = lambda names: " ".join(f"{short[i % 19]} {names[i % len(names)]}" for i in rng.integers(0, 1000, 150))
    good = [line(long) for _ in range(100)]
    # Words of the same lengths that no trusted text holds.
    foreign = [line(["".join(rng.choice(list("mnopqrst"), 7)) for _ in range(60)]) for _ in range(5)]
    docs = docs_of(*enumerate(good), *[(500 + i, t) for i, t in enumerate(foreign)])
    got = {r.doc_id: r.kept for r in score_quality(docs, docs.select("doc_id").filter("doc_id < 80")).collect()}
    assert all(got[i] for i in range(100)) and not any(got[500 + i] for i in range(5))


def test_short_texts_have_thresholds_of_their_own(spark):
    rng = np.random.default_rng(5)
    words = "the of and to in a is that for it with as was on be by at this from".split()
    good = [" ".join(rng.choice(words, rng.integers(8, 30))) for _ in range(150)]
    junk = ["zq## xv## jk## " * 4, "vvqx wwqz kkqj " * 5]
    rows = [(i, t, "en") for i, t in enumerate(good)] + [(900 + i, t, "en") for i, t in enumerate(junk)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in score_quality(docs, spark.range(120).toDF("doc_id")).collect()}
    assert all(r.threshold is not None for r in got.values())
    assert sum(got[i].kept for i in range(150)) >= 148 and not any(got[900 + i].kept for i in range(2))


def test_rounds_and_lists_change_no_score(spark, monkeypatch):
    from gapengine.llm import wordmodel

    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(40)]
    rows = spark.createDataFrame([(i, i, " ".join(rng.choice(words, 30))) for i in range(24)], "id bigint, name bigint, text string").repartition(6)
    scores = lambda: sorted(map(tuple, word_scores(rows, spark.range(12).toDF("id")).collect()))
    whole = scores()
    monkeypatch.setattr(wordmodel, "ROUND_WORDS", 200)  # 24 * 30 words: four rounds
    assert len(whole) == 24 and scores() == whole
    numbers = np.sort(rng.integers(0, 1 << 63, 500).astype(np.uint64))
    for arrays in ([numbers, np.arange(7, dtype=np.float32)], [numbers[:0], np.zeros(0, np.float32)]):
        got = wordmodel.unpack(wordmodel.pack(*arrays), ("u8", "f4"))
        assert all(np.array_equal(a, b) for a, b in zip(arrays, got, strict=True))


def test_stored_tables_leave_no_shuffle_files(spark):
    import glob
    import time

    from gapengine.llm.common import stored

    files = lambda: set(glob.glob(f"{spark.conf.get('spark.local.dir')}/**/shuffle_*.data", recursive=True))
    before = files()
    kept = stored(spark.range(1000).selectExpr("id % 7 AS a").groupBy("a").count())
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.2)  # they are deleted in the background
    assert not files() - before and kept.count() == 7
