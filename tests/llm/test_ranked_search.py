import math
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import ranked_search as r


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, queries, k):
    """Every document's score for every query."""
    counted = [(key, Counter(words(t))) for key, t in docs]
    n_docs = sum(bool(c) for _, c in counted)
    n_terms = sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in queries:
        scored = []
        for key, c in counted:
            m = 75 + (25 * c.total() * n_docs) // n_terms if n_terms else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in words(text) if c[t])
            if s > 0:
                scored.append((-s, key is None, key))
        out += [(item, at, key, -s) for at, (s, _, key) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefg"), max_size=12), min_size=1, max_size=60), st.dictionaries(st.sampled_from("abcdefgh"), st.integers(0, 5), max_size=6), st.integers(1, 6), st.randoms())
def test_best_positions_equal_full_scores(docs, query, k, rng):
    shard = r._Builder()
    for d in docs:
        shard.add(" ".join(d).encode())
    made = shard.columns()
    ends = np.concatenate([[0], np.cumsum(np.asarray(made["held"][0].values))]).astype(int)
    spans = {t.as_py(): (ends[j], ends[j + 1]) for j, t in enumerate(made["terms"][0].values)}
    blob = lambda c, t: np.frombuffer(made[c][0].as_py(), t)
    lists = r.Lists(blob("lengths", np.int64), blob("docs", np.int32), blob("counts", np.int32), spans, 100, 1000)
    order = np.array(rng.sample(range(len(docs)), len(docs)))
    found, read = r.best_positions(lists, {t.encode(): w for t, w in query.items()}, order, k, first_rows=1)
    scores = [(sum(w * ((10**9 * d.count(t)) // (1000 * d.count(t) + 12 * int(lists.m[j]))) for t, w in query.items() if t in d), j) for j, d in enumerate(docs)]
    assert found == sorted([x for x in scores if x[0] > 0], key=lambda x: (-x[0], order[x[1]]))[:k]
    assert read <= sum(b - a for a, b in spans.values())


def test_search_stops_before_the_lists_end():
    rng = random.Random(2)
    shard = r._Builder()
    for j in range(4000):
        shard.add(" ".join(["x", "y", "z"][: 1 + j % 3] * (30 if j % 600 == 2 else 1) + [rng.choice("abc") for _ in range(rng.randint(5, 60))]).encode())
    made = shard.columns()
    ends = np.concatenate([[0], np.cumsum(np.asarray(made["held"][0].values))]).astype(int)
    spans = {t.as_py(): (ends[j], ends[j + 1]) for j, t in enumerate(made["terms"][0].values)}
    lists = r.Lists(np.frombuffer(made["lengths"][0].as_py(), np.int64), *(np.frombuffer(made[c][0].as_py(), np.int32) for c in ("docs", "counts")), spans, 4000, 150000)
    found, read = r.best_positions(lists, {b"x": 3, b"y": 40, b"z": 90}, np.arange(4000), 5)
    assert [d for _, d in found] and all(d % 600 == 2 for _, d in found) and read < 1000


def test_frame_edges_ties_shards_and_blocks(spark):
    rng = random.Random(9)
    vocabulary = ["a", "b", "É", "x1", "y-z", "W", "the", "café", "q"] + [f"w{k}" for k in range(30)]
    docs = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))) for k in range(200)]
    docs += [(None, docs[3][1]), (300, docs[3][1]), (3, docs[3][1]), (301, None), (302, ""), (303, "!?"), (304, "the " * 60000), (None, None)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 9)))) for k in range(12)] + [(50, None), (51, ""), (52, "nowhere"), (None, "a B"), (0, None), (60, "q " * 3000)]
    df = spark.createDataFrame([(k, t, "s", 1) for k, t in docs], "doc_id long, text string, score string, rank int").repartition(4)
    bench = spark.createDataFrame([(k, t, "z") for k, t in items + [items[1]]], "item_id long, text string, rank string")
    rows = lambda out: sorted((tuple(x) for x in out.collect()), key=str)
    wanted = brute(docs, items, 7)
    whole = r.search(r.index(df), bench, k=7)
    assert whole.columns == ["item_id", "rank", "doc_id", "score"] and rows(whole) == wanted
    assert rows(r.search(r.index(df, shard_bytes=400), bench, k=7, block_bytes=300)) == wanted
    assert r.search(r.index(df.where("false")), bench).count() == 0
    assert r.search(r.index(df), bench.where("false")).count() == 0
    assert r.search(r.index(df.where("text is null or text = ''")), bench).count() == 0
