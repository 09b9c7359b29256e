import hashlib
import random
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import suffix_dedup as d

SF = "/root/testdata/sf0.001"


def brute(docs, length=50):
    """doc_id -> covered byte positions, for documents with distinct ids."""
    first = {}
    for k, data in docs:
        for p in range(len(data) - length + 1):
            s = data[p:p + length]
            first[s] = min(first.get(s, k), k)
    return {k: {q for p in range(len(data) - length + 1) if first[data[p:p + length]] < k for q in range(p, p + length)} for k, data in docs}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=30).map(lambda b: bytes(x % 3 + 97 for x in b)), min_size=1, max_size=20), st.sampled_from([9, 20, 26, 31]))
def test_sorting_orders_strings_and_numbers_equal_ones_alike(parts, length):
    data = b"".join(p * 3 for p in parts) + b"a" * length
    starts = np.arange(len(data) - length + 1)
    order, number = d.sorted_strings(np.frombuffer(data, np.uint8), starts, length, shallow=16)
    strings = [data[k:k + length] for k in order]
    assert strings == sorted(strings) and sorted(order.tolist()) == starts.tolist()
    assert all((a == b) == (x == y) for a, b, x, y in zip(strings, strings[1:], number, number[1:], strict=False))


def check(spark, rows):
    out = d.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, kept string")).collect()
    assert len(out) == len(rows)
    expected = brute(list({(k, (t or "").encode()) for k, t, _ in rows if k is not None}))
    texts = {k: (t or "").encode() for k, t, _ in rows}
    for r in out:
        gone = {q for s in r.removed for q in range(s.start, s.end)}
        assert gone == (expected[r.doc_id] if r.doc_id is not None else set()), r.doc_id
        assert all(a.end < b.start for a, b in zip(r.removed, r.removed[1:], strict=False))
        if r.doc_id is not None:
            assert r.n_bytes == len(texts[r.doc_id]) and bytes(r.kept) == bytes(x for q, x in enumerate(texts[r.doc_id]) if q not in gone)


def test_planted_repeats_copies_and_edges(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (9, 12, 14, 30, 100)]
    rows = []
    for k in range(60):
        body = text(rng.randint(0, 80))
        for p in rng.sample(passages, rng.randint(0, 3)):
            at = rng.randint(0, len(body))
            body = body[:at] + p[rng.randint(0, 5):len(p) - rng.randint(0, 5)] + body[at:]
        rows.append((rng.randint(0, 10**6) * 100 + k, body, "x"))
    rows += [(7, rows[3][1], "x"), (8, rows[3][1], "x"), (None, rows[3][1], "x"), (9, None, "x"), (10, "", "x"), (11, "ab " * 900, "x"), (12, "ab " * 300 + "c" * 200, "x"), (13, "c" * 49, "x"), (14, "c" * 50, "x"), (14, "c" * 50, "x")]
    check(spark, rows)
    assert d.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_of_one_id_with_other_texts_do_not_crash(spark):
    a, b = "x y z " * 30, "other " * 50
    out = d.deduplicate(spark.createDataFrame([(1, a), (2, a), (2, b), (3, b)], "doc_id long, text string")).collect()
    assert len(out) == 4 and all(s.end <= r.n_bytes for r in out for s in r.removed)


def test_query_against_brute_force(spark):
    from ledgerlens.llm import queries

    docs = [(r.doc_id, r.text.encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    expected = brute(docs)
    got = {r.doc_id: r for r in queries.QUERIES["op7_suffix_dedup"](spark, SF).collect()}
    assert len(got) == len(docs)
    for k, data in docs:
        kept = bytes(x for q, x in enumerate(data) if q not in expected[k])
        r = got[k]
        runs = sum(q - 1 not in expected[k] for q in expected[k])
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(data), len(expected[k]), runs, hashlib.sha256(kept).hexdigest())


def phrases(seed, n, size, shared):
    """``n`` rows whose texts have the pieces of ``shared`` between noise of ``size`` bytes that no two rows have alike."""
    rng = random.Random(seed)
    noise = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size))
    return [(k, noise().join(["", *rng.sample(shared, len(shared)), ""]), "x") for k in range(n)]


def test_texts_are_dealt_by_document_once(spark):
    rng = random.Random(3)
    passages = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (80, 120)]
    rows = [*phrases(1, 30, 60, passages), (None, passages[0] * 2, "x")]
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        df = d.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, kept string"))
        assert len(df.collect()) == 31 and sum(len(r.removed) for r in df.collect()) > 0
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set(key, before)
    assert "ReusedExchange" in plan and sum("SortMergeJoin" in line for line in plan.splitlines()) == 2, plan


def test_contexts_that_share_no_more_than_half_a_string_are_not_cut(spark, monkeypatch):
    cut, real = [], d.compared

    def counted(rows, length):
        cut.append(rows.count())
        return real(rows, length)

    monkeypatch.setattr(d, "compared", counted)
    # 24 bytes hold anchors of 16 but no side: the half of the other 34 bytes is not common.
    check(spark, phrases(2, 40, 70, ["the quick brown fox jumpe", "one two three four five s"]))
    assert cut == [0]
    check(spark, phrases(4, 40, 70, ["the quick brown fox jumps over the lazy dog and then it sleeps"]))
    assert cut[1] > 0


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([(50, 16), (51, 16), (16, 16), (17, 16), (20, 8), (66, 10)]))
def test_equal_strings_share_a_side_of_their_anchor(seed, sizes):
    length, gram = sizes
    rng = random.Random(seed)
    piece = lambda n: bytes(rng.choice(b"abcde") for _ in range(n))
    common = [piece(n) for n in (length - 1, length, length + 1, 2 * length, 3 * length)]
    texts = [b"".join(rng.choice([rng.choice(common), piece(rng.randint(0, 40))]) for _ in range(rng.randint(0, 6))) for _ in range(6)]
    held = {}
    for t, lo, count, h, _, left, right in zip(*(x.tolist() for x in d.anchored([*texts, None], length, gram)), strict=True):
        for p in range(lo, lo + count):
            held.setdefault(texts[t][p:p + length], []).append((h, left, right))
    assert sum(map(len, held.values())) == sum(max(0, len(t) - length + 1) for t in texts)
    for rows in held.values():
        h, left, right = map(set, zip(*rows, strict=True))
        assert len(h) == 1 and (len(left) == 1 and 0 not in left or len(right) == 1 and 0 not in right)


def test_packed_rows_come_back():
    rng = np.random.default_rng(1)
    n = 1000
    part = rng.integers(0, 7, n).astype(np.int32)
    columns = [rng.integers(0, 2**32, n, np.uint64), rng.integers(0, 2**56, n, np.uint64), rng.integers(0, 2**16, n).astype(np.uint16), rng.integers(0, 2**16, n).astype(np.uint16), rng.integers(0, 2**37, n), rng.integers(-2**63, 2**63 - 1, n)]
    parts, rows = d.packed(part, columns)
    assert parts.tolist() == sorted(set(part.tolist()))
    for p, value in zip(parts.tolist(), rows.to_pylist(), strict=True):
        half = len(value) // 28
        assert half == (part == p).sum()
        assert all((x == y[part == p]).all() for x, y in zip(d.unpacked([value]), columns, strict=True))
    assert len(d.packed(part[:0], [x[:0] for x in columns])[0]) == 0


def test_rows_without_an_id_stay_whole_whatever_their_key(spark):
    text = "a text that is long enough to be repeated elsewhere, and then some more of it"
    key = spark.createDataFrame([(text,)], "t string").selectExpr("xxhash64(cast(t as binary)) as k").first().k
    check(spark, [(key, text, "x"), (key - 1, text, "x"), (None, text, "x"), (key + 1, "other " * 20, "x")])


def test_shuffle_files_of_the_anchors_do_not_stay(spark):
    spark._jvm.System.gc()
    tracker = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def files():
        found = tracker.getAllFiles()
        return {found.apply(k).getName() for k in range(found.size()) if found.apply(k).getName().startswith("shuffle_")}

    before = files()
    df = d.deduplicate(spark.createDataFrame(phrases(6, 30, 60, ["some passage that is long enough to be found in several of the rows"]), "doc_id long, text string, kept string"))
    until = time.time() + 10  # they are deleted in the background
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before  # the anchors are written out now, nothing else has run
    assert len(df.collect()) == 30 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None
