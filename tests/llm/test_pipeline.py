"""The whole pipeline against a plain version of each stage."""

import collections
import hashlib
import random
import re

import corpus_pipeline
from gapengine.llm.pieces import Pieces
from gapengine.llm.queries import VOCABULARY


def plain_mix(docs):
    """{doc_id: times} for (doc_id, text, source)."""
    size = collections.Counter()
    for _, t, s in docs:
        size[s] += len(t.split())
    names = sorted(size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    open_, left, target = set(names), sum(size.values()), {}
    while True:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * left / w > 3 * size[s]}
        if not over:
            break
        open_ -= over
        left -= sum(3 * size[s] for s in over)
        target |= {s: 3 * size[s] for s in over}
    target |= {s: weight[s] * left / w for s in open_}
    times = {}
    for s in names:
        whole = int(target[s] // size[s])
        rest = target[s] - whole * size[s]
        mine = sorted((int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), i, len(t.split())) for i, t, x in docs if x == s)
        before = 0
        for _, i, n in mine:
            # The document at which the rest runs out is in if that comes nearer.
            inside = before + n <= rest or (before <= rest and 2 * (rest - before) > n)
            times[i] = whole + (rest > 0 and inside)
            before += n
    return times


def test_pipeline_matches_plain_stages(spark, tmp_path):
    rng = random.Random(4)
    words = "the of and to in a is that for it with as was on be by at this from".split() + [f"{a}{b}{c}" for a in ("tra", "mon", "vel") for b in ("di", "so", "ra") for c in ("tion", "ing", "er")]
    good = {i: " ".join(rng.choice(words) for _ in range(rng.randrange(150, 400))) for i in range(80)}
    good[7] += " write to joe@mail.example.org or 10.0.0.1"
    texts = dict(good)
    texts[200] = good[3].upper()
    texts[201] = good[5] + " one more"
    texts[300], texts[301] = "buy## now## " * 80, "same " * 300
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in texts.items()]
    spark.createDataFrame([*rows, rows[0]], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in good], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = {i: re.sub("10.0.0.1", "[IP]", re.sub("joe@mail.example.org", "[EMAIL]", t)) for i, t in good.items()}
    times = plain_mix([(i, t, f"s{i % 4}") for i, t in kept.items()])
    pieces = Pieces.load(VOCABULARY)
    assert collections.Counter(r.doc_id for r in got) == +collections.Counter(times)
    assert all(r.exact and pieces.decode(r.ids) == kept[r.doc_id] and r.n_pieces == len(r.ids) for r in got)
    assert [name for name, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None
