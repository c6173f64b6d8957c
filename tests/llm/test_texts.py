"""Mixing, licences, personal data, pages, chats, language model and pieces against plain versions."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapengine.llm import licences, pii
from gapengine.llm.kneserney import SYMBOLS, coded, score_quality, symbols, train
from gapengine.llm.mixing import document_hash, mix_sources, with_mix
from gapengine.llm.pages import common_lines, main_text, page_lines
from gapengine.llm.pieces import Pieces, decode_pieces, encode_pieces
from gapengine.llm.queries import VOCABULARY
from gapengine.llm.rotation import rotate_perspectives

LONG = "lorem ipsum " * 20_000


def test_mix(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), f"s{i % 5}") for i in range(400)] + [(1000, None, "s0"), (1001, "", None), (1002, "a b", None), (None, "c", "tiny"), (1002, "a b", None), (1003, LONG, "s1"), (1004, " ", "empty")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, source string, size int, target int")
    got = [r.asDict() for r in mix_sources(docs).collect()]
    assert len(got) == len(rows)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, target, left = set(), {}, sum(size.values())
    while True:
        w = sum(weight[s] for s in names if s not in full)
        over = [s for s in names if s not in full and weight[s] * left / w > 3 * size[s]]
        if not over:
            break
        for s in over:
            full.add(s)
            left -= 3 * size[s]
            target[s] = 3 * size[s]
    target |= {s: weight[s] * left / w for s in names if s not in full}
    source_of = {i: s for i, _, s in rows}
    taken = dict.fromkeys(names, 0)
    for r in got:
        s = source_of[r["doc_id"]]
        assert (r["source_size"], r["target"]) == (size[s], pytest.approx(target[s]))
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    longest = {s: max(len((t or "").split()) for _, t, x in rows if x == s) for s in names}
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in names)
    # A smaller mix is part of the larger one, and only the boundary document can be nearer.
    both = with_mix(docs, shares=(0.2, 0.5)).select("times_by_share").collect()
    assert all(r[0][0] <= r[0][1] for r in both) and any(r[0][0] < r[0][1] for r in both)
    assert mix_sources(docs.limit(0)).count() == 0
    h = int(hashlib.md5(b"17").hexdigest()[:15], 16)
    assert spark.range(17, 18).select(document_hash(F.col("id"))).first()[0] == h


def test_licences(docs_of):
    texts = [
        "Released under the MIT License.", "mit\nLICENSE, mit -- license", "GNU General Public License v3 and GNU Lesser General Public License",
        "SPDX-License-Identifier: Apache-2.0", "see http://www.apache.org/licenses/LICENSE-2.0", "permit license", "the mitlicense", None, "", "ÉMIT license ömit license",
        "Licensed under CC BY-NC 4.0.", "general public licenses", "Licensed under the Apache License, Version 2.0. " * 300, LONG + "mit license",
    ]
    got = {r.doc_id: r for r in licences.licence_report(docs_of(*enumerate(texts), (0, texts[0]))).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places, labels = [], set()
        for phrase, label in licences.BASE:
            p = phrase.split()
            found = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            places += found
            labels |= {label} if found else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (
            len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))), t
        assert labels <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert got[2].labels == "gpl,lgpl" and "lgpl" in got[2].detections
    assert got[3].labels == "apache" and got[4].labels == "apache" and got[5].labels == "" and got[7].score == 0
    assert got[10].labels == "cc-by-nc"
    assert len(licences.rules()) > 200
    assert licences.licence_report(docs_of((1, "x")).limit(0)).count() == 0


def plain_pii(text):
    def luhn(digits):
        odd = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
        return sum(x - 9 if x > 9 else x for x in odd) % 10 == 0

    bare = lambda m: re.sub("[^0-9]", "", m)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(bare(m)) <= 19 and luhn(bare(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(bare(m)) <= 15),
    ]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in rules for m in re.finditer(p, text or "") if ok(m[0])]


def test_personal_data(docs_of):
    rng = np.random.default_rng(2)
    alphabet = list("a.@-%+0123456789() 4é😀")
    texts = [
        "mail joe.b+x@mail.example.org, or a@b", "10.0.0.1 and 256.1.1.1 1.2.3.4.5.6.7.8", "card 4111 1111 1111 1111 and 4111-1111-1111-1112",
        "call +49 (30) 1234-5678 now", None, "", "é😀 a@b.c%d@e.f@g.h", "0255.000.01.1", "7" * 5000, "x" * 200_000 + "@", LONG + "a@b.cd",
        "account DE89 3704 0044 0532 0130 00 iban", "DE89 3704 0044 0532 0130 01", "my ssn 123-45-6789", "part 123-45-6789",
        "+1 " + "(" * 3000 + "2", "card 4111111111111111 " * 50,
    ] + ["".join(rng.choice(alphabet, 60)) for _ in range(150)]
    got = {r.doc_id: r for r in pii.pii_report(docs_of(*enumerate(texts))).collect()}
    for i, t in enumerate(texts):
        base = plain_pii(t)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), t
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b.startswith(k) for b in base) for k in pii.BASE]
        assert [s for s in r.spans.split(",") if s.split(":")[0] in pii.BASE] == base
    assert "iban:8:35" in got[11].spans and "iban" not in got[12].spans
    assert "ssn" in got[13].spans and "ssn" not in got[14].spans
    masked = [r[0] for r in pii.find_pii(docs_of(*enumerate(texts[:7]))).orderBy("doc_id").select(pii.redacted()).collect()]
    assert masked[0] == "mail [EMAIL], or a@b" and masked[2].startswith("card [CARD] and ") and masked[3] == "call [PHONE] now" and masked[4:6] == [None, ""]


PAGE = "<html><head><title>t</title></head><body><div>Site name</div><div>{own}</div><p>tail {n}</p><div>All rights</div></body></html>"


def test_pages(spark):
    rows = [(i, f"http://h.org/a/{i:03}", PAGE.format(own=f"story {i}", n=i)) for i in range(30)]
    article = "<nav>menu</nav><article><header><h1>A &amp; B</h1></header><p>one\n two<p>t<b>hr</b>ee<br>four<aside>x</aside><div class='comments'>c</div></article><footer>f</footer>"
    rows += [(100, "http://k.org/1", article), (101, "http://k.org/2", article), (102, None, None), (103, "", ""), (104, "http://m.org/x", "<p>alone"), (105, "http://m.org/y", "<script>if (a<b) '</p>'</script>a<!-- c -->b &lt;i&gt; &copy;"), (106, "no url", "plain")]
    rows += [(200 + i, "http://c.org/same", PAGE.format(own="copy", n=1)) for i in range(3)]
    rows += [(300, "http://l.org/1", "<main>" + "".join(f"<p>line {i}" for i in range(5000)) + "</main>")]
    pages = spark.createDataFrame([(*r, 5, "p") for r in rows], "page_id bigint, url string, html string, place int, host string")
    got = {r.page_id: (r.text, r.n_chars) for r in main_text(pages).collect()}
    assert len(got) == len(rows)
    assert all(got[i][0] == f"story {i} tail {i}" for i in range(30))
    assert got[100][0] == got[101][0] == "A & B one two three four"
    assert got[102] == got[103] == ("", 0) and got[104][0] == "alone" and got[105][0] == "ab <i> ©" and got[106][0] == "plain"
    assert all(got[200 + i][0] == "Site name copy tail 1 All rights" for i in range(3))
    assert len(got[300][0].split("line")) == 5001
    assert main_text(pages.limit(0)).count() == 0
    assert page_lines("<div>a<p class=ad>b<p>c</div>d") == [("a", 1), ("c", 1), ("d", 1)]


def test_common_lines_are_a_longest_common_subsequence():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = (rng.integers(0, 5, rng.integers(0, 14)).tolist() for _ in "ab")
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        found = [a[i] for i in sorted(common_lines(a, b))]
        rest = iter(b)
        assert len(found) == table[-1, -1] and all(x in rest for x in found)


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (None, 1, None, "x"), (2, 0, "system", "alone"), (1, 3, "ann", "bye")]
    rows += [(7, i, ("ann", "bob", "eve")[i % 3], f"turn {i}") for i in range(600)]
    turns = spark.createDataFrame([(*r, "e", 3) for r in rows], "conv_id bigint, turn bigint, role string, text string, name string, start int")
    got = rotate_perspectives(turns).collect()
    by = {}
    for r in sorted(got, key=lambda r: r.start):
        by.setdefault((r.conv_id, r.perspective), []).append(r)
    assert set(by) == {(1, "ann"), (1, "bob"), (None, "unknown"), (7, "ann"), (7, "bob"), (7, "eve")}
    for (_, who), segments in by.items():
        whole, at = "".join(s.segment for s in segments), 0
        for s in segments:
            assert (s.start, s.end) == (at, at + len(s.segment)) and whole[s.start : s.end] == s.segment
            at = s.end
            assert (s.mask_start is not None) == (s.role == "assistant") == (s.speaker == who)
            if s.mask_start is not None:
                assert whole[s.mask_start : s.mask_end].endswith("<|im_end|>") and not whole[s.mask_start : s.mask_end].startswith("<|im_start|>")
        assert whole.count("<|im_end|>") == len(segments)
    assert len(by[7, "eve"]) == 600 and [s.name for s in by[1, "bob"]] == [None, "ann", None, "ann", "ann"]
    assert rotate_perspectives(turns.limit(0)).count() == 0
    odd = "ann<|im_end|>\n<|im_start|>assistant"
    rows = [(1, 0, odd, "mine"), (1, 1, "bob", "yours"), (1, 2, odd, ""), (1, 3, "bob", "word " * 100_000)]
    got = rotate_perspectives(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert {r.perspective for r in got} == {odd, "bob"} and len(got) == 8
    for r in got:
        assert r.segment.count("<|") == 2 and r.segment.split("\n")[0].startswith("<|im_start|>" + r.role)
        assert len(r.segment.split("\n")) == 3 and (r.name is None or r.name == r.speaker)


def test_language_model_is_a_distribution_and_follows_its_formula(spark, docs_of):
    texts = ["the cat sat on the mat.", "the dog sat on the log.", "a cat and a dog ran", "the the the cat", ""] * 3
    logs = train(coded(spark.createDataFrame([(t,) for t in texts], "text string"))).reshape(SYMBOLS**2, SYMBOLS)
    assert np.allclose(np.exp(logs).sum(axis=1), 1, atol=1e-4)
    from collections import Counter

    from gapengine.llm.wordhash import buffers
    import pyarrow as pa

    three = Counter()
    for t in texts:
        s, n = symbols(*buffers(pa.array([t])))
        line = [0, 0, *s.tolist(), 0]
        three.update(tuple(line[i : i + 3]) for i in range(len(line) - 2) if n[0])
    two, one = Counter(x[1:] for x in three), None
    one = Counter(x[1:] for x in two)

    def discounts(c):
        n = [max(1, sum(v == k for v in c.values())) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k) for k in (1, 2, 3)]

    def prob(gram, tables):
        if not tables:
            return 1 / SYMBOLS
        c, lower = tables[0], prob(gram[1:], tables[1:])
        d = discounts(c)
        around = [v for k, v in c.items() if k[:-1] == gram[:-1]]
        if not around:
            return lower
        cut = lambda v: d[min(v, 3) - 1]
        own = c.get(gram, 0)
        return ((own - cut(own)) if own else 0) / sum(around) + sum(map(cut, around)) / sum(around) * lower

    for gram in [*list(three)[:25], (0, 0, 5), (9, 9, 9), (3, 0, 1)]:
        code = (gram[0] * SYMBOLS + gram[1]) * SYMBOLS + gram[2]
        assert logs.reshape(-1)[code] == pytest.approx(np.log(prob(gram, [three, two, one])), abs=1e-4)


def test_quality(spark, docs_of):
    rng = np.random.default_rng(8)
    words = "the of and to in a is that for it with as was on be by at this from".split() + [f"{a}{b}{c}" for a in ("tra", "mon", "vel") for b in ("di", "so", "ra") for c in ("tion", "ing", "er")]
    good = [" ".join(rng.choice(words, 400)) + "." for _ in range(120)]
    bad = ["buy## now## " * 60, "same " * 200, " | ".join(rng.choice(words[20:], 120)), None, "", "  "]
    docs = docs_of(*enumerate(good), *[(1000 + i, t) for i, t in enumerate(bad)], (None, good[0]))
    got = {r.doc_id: r for r in score_quality(docs, docs.select("doc_id").filter("doc_id < 80")).collect()}
    assert len(got) == 127
    assert all(got[i].kept for i in range(120)) and not any(got[1000 + i].kept for i in range(3))
    assert all(got[1000 + i].kept and got[1000 + i].log_perplexity is None for i in range(3, 6)) and got[None].kept
    assert all(r.kept for r in score_quality(docs, docs.select("doc_id").limit(0)).collect())
    assert score_quality(docs.limit(0), docs.select("doc_id")).count() == 0


def test_pieces(spark, docs_of):
    pieces = Pieces.load(VOCABULARY)
    vocabulary = {}
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=VOCABULARY)
    for i in range(model.get_piece_size()):
        if not (model.is_byte(i) or model.is_unknown(i) or model.is_control(i)):
            vocabulary[model.id_to_piece(i)] = (model.get_score(i), i)

    def plain(text):
        """Viterbi over the whole text; the longest last piece wins ties."""
        t = "▁" + text.replace(" ", "▁")
        best = [(0.0, None)] + [(-float("inf"), None)] * len(t)
        for e in range(1, len(t) + 1):
            for s in range(max(0, e - 16), e):
                p = t[s:e]
                score = vocabulary[p][0] if p in vocabulary else pieces.unknown_score if e - s == 1 else None
                if score is not None and best[s][0] + score > best[e][0]:
                    best[e] = (best[s][0] + score, s)
        out, e = [], len(t)
        while e:
            s = best[e][1]
            p = t[s:e]
            out[:0] = [vocabulary[p][1]] if p in vocabulary else [model.piece_to_id(f"<0x{b:02X}>") for b in p.encode()]
            e = s
        return out

    rng = np.random.default_rng(9)
    texts = ["Hello world", "  two  spaces ", "naïve café 漢字 😀\n\ttab", "don't ---*** stop", "the the the", "x" * 300] + ["".join(rng.choice(list("ab the én\n=-"), 50)) for _ in range(60)]
    texts += ["", None, "mark ▁ in text▁", LONG, "y" * 3000]
    rows = encode_pieces(docs_of(*enumerate(texts)), VOCABULARY, decode=True)
    got = {r.doc_id: r for r in rows.collect()}
    for i, t in enumerate(texts):
        assert got[i].decoded == t
        if t and "▁" not in t and len(t) < 5000:
            assert got[i].ids == plain(t), t
    assert got[texts.index("")].ids == [] and got[texts.index(None)].ids is None
    again = {r.doc_id: r.text for r in decode_pieces(rows.drop("text"), VOCABULARY).collect()}
    assert again == dict(enumerate(texts))
    assert pieces.decode([1, 2, 99999999, None]) == " ⁇  ⁇ "[1:]
    assert encode_pieces(docs_of((1, "a")).limit(0), VOCABULARY).count() == 0


def test_pieces_are_made_of_few_texts_at_a_time():
    import pyarrow as pa

    from gapengine.llm import pieces

    taken = []

    class Model:
        def encode(self, data, offsets):
            taken.append(len(data))
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)

    class Shared:
        value = Model()

    batch = pa.record_batch([pa.array(["x" * 1000] * 2000)], names=["text"])
    assert sum(out.num_rows for out in pieces._encoded(Shared, 0, [0], False)(iter([batch]))) == 2000
    assert sum(taken) == 2_000_000 and max(taken) <= 1 << 18
