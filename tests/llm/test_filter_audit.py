import random
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.llm import filter_audit as a
from ledgerlens.llm import term_matrix


def brute(docs, labels):
    """The audit row by row: each order removes rows one step after another."""
    least, rows = {}, []
    for key, text, _ in docs:
        if key is not None:
            least[text or ""] = min(least.get(text or "", key), key)
    for key, text, part in docs:
        text = text or ""
        w = text.encode().split()
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
                 "D": any(c in "#$%&*|" for c in text), "E": key is not None and least[text] < key}
        mine = [x for x in labels if x[0] == key and key is not None]
        rows.append((part or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = gone = None
            left, gone = [r for r in rows if r[0] == part], []
            for step, f in enumerate(order, 1):
                here = [r for r in left if r[1][f]]
                redundant = sum(r[1][f] for r in gone)
                left, gone = [r for r in left if not r[1][f]], gone + here
                unique = sum(r[0] == part and [x for x in "ABCDE" if r[1][x]] == [f] for r in rows)
                out[part, "".join(order), step] = [len(left), len(here), redundant, unique, sum(r[2] for r in here), sum(r[3] for r in here)]
                shapley[part, f] = shapley.get((part, f), 0) + len(here)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def corpus():
    rng = random.Random(5)
    docs = [(None, None, None), (1, "", "en"), (2, None, None), (None, "", "en"), (9, "x " * 30000, "en"), (9, "x " * 30000, "en"), (8, "x " * 30000, "")]
    for k in range(20, 140):
        n = rng.choice([3, 150, 199, 200, 260])
        words = [rng.choice(["a", "B", "Ü", "c#", "é\u00a0f", "C"]) if rng.random() < 0.6 else f"w{rng.randint(0, 400)}" for _ in range(n)]
        docs.append((k, rng.choice([" ", "\n", "\t\x0b"]).join(words), rng.choice(["en", "fr", None])))
    docs += [(k + 500, docs[rng.randrange(30)][1], "fr") for k in range(40)] + [docs[12], (docs[12][0], docs[12][1], "fr"), (None, docs[13][1], "en")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 600, 2)] + [(30, 1, 0), (30, 0, 1), (None, 1, 1), (9, 1, 1)]
    rng.shuffle(docs)
    return docs, labels


def test_audit_equals_row_by_row_removal(spark):
    docs, labels = corpus()
    df = spark.createDataFrame([(k, t, p, "z", 1) for k, t, p in docs], "doc_id long, text string, lang string, part string, key int").repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in a.audit(df, marks).collect()}
    assert got == brute(docs, labels)
    assert a.audit(df.where("false"), marks).count() == 0
    assert a.audit(df, marks.where("false")).agg(F.sum("good_lost")).first()[0] == 0


def test_matrix_counts_every_word_under_one_id(spark):
    docs, _ = corpus()
    df = spark.createDataFrame([(k, t, "n", "s") for k, t, _ in docs], "doc_id long, text string, n_words string, shard string").repartition(3)
    for limits in ({}, {"shard_bytes": 3000}, {"shard_rows": 1}):
        matrix = term_matrix.Matrix(df, "text", **limits)
        word = {r.id: bytes(r.word) for r in matrix.dictionary.collect()}
        assert len(word) == matrix.dictionary.count() == len(set(word.values()))
        got = []
        for r in matrix.shards().collect():
            starts, cells, counts = (np.frombuffer(x, np.int64) for x in (r.starts, r.ids, r.counts))
            assert len(starts) == len(r.rows) + 1 and starts[-1] == len(cells)
            got += [(x.doc_id, sorted((word[i], n) for i, n in zip(cells[s:e].tolist(), counts[s:e].tolist(), strict=True))) for x, s, e in zip(r.rows, starts, starts[1:], strict=False)]
        wanted = [(k, sorted((w, ws.count(w)) for w in set(ws))) for k, ws in ((k, (t or "").encode().split()) for k, t, _ in docs)]
        assert sorted(got, key=str) == sorted(wanted, key=str)
    sums = matrix.row_statistics(total="total", distinct="different")
    assert sums.columns == ["doc_id", "n_words", "shard", "n_bytes", "total", "different"]
    assert sums.agg(F.sum("total")).first()[0] == sum(len((t or "").encode().split()) for _, t, _ in docs)
    none = term_matrix.Matrix(df.where("false"), "text")
    assert none.shards().count() == none.dictionary.count() == none.row_statistics().count() == 0
