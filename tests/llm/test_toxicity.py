import itertools
import math
import random
import re
import zlib

import numpy as np

from ledgerlens.llm import queries
from ledgerlens.llm import toxicity as x


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    t = np.array([[0.7, 0.2], [1.1, 0.4]])
    e = np.array([np.nan, 2.0, 0.3, 5.0, np.nan, np.nan, 0.1, *rng.gamma(1, 1, 6), np.nan])
    left, right = x.forward_backward(e, *x.chains(e), t)
    for a, b in ((1, 4), (6, 13)):
        weight = {}
        for states in itertools.product((0, 1), repeat=b - a):
            w = (t[0, 1] / t[0, 0]) ** states[0]
            for k, s in enumerate(states):
                w *= e[a + k] ** s * (t[states[k - 1], s] if k else 1)
            weight[states] = w
        total = sum(weight.values())
        for k in range(b - a):
            p = sum(w for s, w in weight.items() if s[k]) / total
            odds = left[a + k] * right[a + k]
            assert abs(odds / (1 + odds) - p) < 1e-9


def test_training_finds_planted_words_and_spans(spark):
    rng = random.Random(1)
    plain = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    texts, toxic = [], []
    for k in range(600):
        words = [rng.choice(plain) for _ in range(40)]
        toxic.append(int(k % 5 == 0))
        if toxic[-1]:
            words[7] = words[30] = rng.choice(["zzvile", "zzvilest"])
        texts.append(" ".join(words) + ".")
    field = x.train(texts, toxic, [1.0] * 600)
    rows = [(1, "Ünd ZZVILE abc. Now zzvilest. x", "s"), (2, "abc def", "s"), (3, None, "s"), (4, "", "s"), (5, "123 !!", "s"), (1, "Ünd ZZVILE abc. Now zzvilest. x", "s"), (None, "word " * 40000, "s"),
            (6, "word " * 10000, "s"), (7, " ".join(rng.choice(plain) for _ in range(20000)), "s"), (8, "İİİ x zzvile", "s")]
    out = x.score(spark.createDataFrame(rows, "doc_id long, text string, toxicity string"), field)
    assert out.columns == ["doc_id", "text", "toxicity", "_toxicity"]
    got = out.collect()
    assert len(got) == 10
    for r in got:
        assert 0 <= r._toxicity.score <= 1
        assert (r._toxicity.score >= 0.3) == (r.doc_id in (1, 8))
        assert [(s.start, s.end) for s in r._toxicity.spans] == {1: [(4, 10), (20, 28)], 8: [(6, 12)]}.get(r.doc_id, [])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert x.score(empty, field).count() == 0
    none = x.fit(spark.createDataFrame(rows, "doc_id long, text string, z string"), spark.createDataFrame([(1, None), (None, 1), (77, 1)], "doc_id long, toxic int"))
    assert {r.toxicity.score for r in x.score(spark.createDataFrame(rows[:4], "doc_id long, text string, z string"), none).collect()} == {0.0}


def plain_score(field, text):
    """The score of one document, sentence by sentence and word by word."""
    p, (a, b), (c, d) = [], *field.transitions.tolist()
    for sentence in re.split(r"[.!?\n]", text):
        e = [math.exp(min(60.0, field.bias + sum(field.weights.get(f, 0.0) for f in x.features(w.lower())))) for w in re.findall(r"[^\W\d_]+", sentence)]
        ahead = []
        for k, odds in enumerate(e):
            ahead.append(odds * (b / a if k == 0 else (b + d * ahead[-1]) / (a + c * ahead[-1])))
        back = 1.0
        for k in range(len(e) - 1, -1, -1):
            p.append(ahead[k] * back / (1 + ahead[k] * back))
            back = (c + d * e[k] * back) / (a + b * e[k] * back)
    none = sum(math.log1p(-min(q, 1 - 1e-9)) for q in sorted(p)[-x.EVIDENCE:])
    raw = math.log(max(-math.expm1(none), 1e-12)) - max(none, -30)
    return 1 / (1 + math.exp(-(field.line[0] * min(12.0, max(-12.0, raw)) + field.line[1])))


def test_fitted_scores_equal_plain_recomputation(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    field = x.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = x.score(docs, field, into="t").select("doc_id", "text", "t.score").collect()
    once = sorted((r.doc_id, round(r.score, 9)) for r in x.fit_and_score(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect())
    assert once == sorted((r.doc_id, round(r.score, 9)) for r in rows)
    assert len(rows) == 1000 and len({round(r.score, 6) for r in rows}) > 5
    for r in rows:
        assert abs(r.score - plain_score(field, r.text or "")) < 1e-9


def test_sample_keeps_long_documents(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(x, "train", lambda texts, toxic, weight: taken.append((texts, toxic, weight)) or x.Field({}, 0.0, np.eye(2), None))
    docs = [(k, "a " * (50 if k % 10 else 20000)) for k in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)], "doc_id long, toxic int")
    x.fit(frame, labels)
    assert sum(len(t) > 12000 for t in taken[0][0]) == sum(zlib.crc32(str(k).encode()) % 4 != 2 for k in range(0, 300, 10))
    x.fit(frame, labels, train_chars=200_000)
    assert sum(map(len, taken[1][0])) < 700_000 and set(taken[1][1]) <= {0, 1}


def test_query_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.QUERIES["op1_toxicity"](spark, sf).drop("spans").collect()
    assert len(rows) == 10_000 and all(r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    judged = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    hit = sum(a and b for a, b in judged)
    assert hit >= 0.85 * sum(a for a, _ in judged) and hit >= 0.85 * sum(b for _, b in judged)
