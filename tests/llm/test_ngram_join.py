import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.llm import ngram_join as x
from ledgerlens.llm.common import small_batches
from ledgerlens.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """(doc_id, size, component) of rows with distinct ids or equal texts per id."""
    sets = [(k, shingles(t)) for k, t in rows if k is not None]
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if (a or b) and 100 * len(a & b) >= 75 * len(a | b) and a and b:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(sets):
        least[find(i)] = min(k, least.get(find(i), k))
    out = {(k, len(s), least[find(i)]) for i, (k, s) in enumerate(sets)}
    return out | {(None, len(shingles(t)), None) for k, t in rows if k is None}


def near_copies(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    rows, opener = [], "a common line of every document here."
    for family in range(12):
        base = [word() for _ in range(rng.choice([3, 5, 7, 20, 60, 200]))]
        for _ in range(rng.choice([1, 2, 5, 25])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                at = rng.randrange(len(copy))
                copy[at:at + 1] = [word()] * rng.randint(0, 2)
            rows.append((opener + "\n" if family % 3 == 0 else "") + " ".join(copy))
    rng.shuffle(rows)
    return [(k * 3 + 5, t.upper() if k % 4 == 0 else t) for k, t in enumerate(rows)]


def test_components_equal_brute_force_with_and_without_tiles(spark):
    rows = near_copies(11) + [(900, None), (901, ""), (902, " \t\n"), (903, "w"), (904, "W"), (None, "a b c d e f"), (906, "x " * 4000), (907, "x " * 4000), (5, near_copies(11)[0][1])]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, n_shingles int")
    expected = sorted(brute(rows), key=str)
    for options in ({}, {"tile": 4, "parts": 3}):
        out = x.near_duplicates(df, **options)
        got = out.collect()
        assert out.columns == ["doc_id", "n_shingles", "component_id"] and len(got) == len(rows)
        assert sorted({tuple(r) for r in got}, key=str) == expected
    assert x.near_duplicates(df.where("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.booleans())
def test_tree_join_loses_no_link(seed, across):
    rng = np.random.default_rng(seed)
    base = [np.unique(rng.integers(0, 400, rng.integers(3, 60)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(6)]
    sets = []
    for _ in range(90):
        b = base[rng.integers(len(base))]
        keep = b[rng.random(len(b)) > rng.choice([0, 0.05, 0.15])]
        sets.append(np.unique(np.append(keep, rng.integers(0, 2**60, rng.integers(0, 3)).astype(np.uint64))))
    sets = [s for s in sets if len(s)]
    side = rng.integers(0, 2, len(sets)).astype(np.int8) if across else np.zeros(len(sets), np.int8)
    if across and len(set(side.tolist())) < 2:
        return
    linked = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))
    every = {(i, j) for i in range(len(sets)) for j in range(i) if (not across or side[i] != side[j]) and linked(sets[i], sets[j])}
    made = x.links(np.arange(len(sets)), list(sets), np.array([len(s) for s in sets]), side, 75)
    assert all((max(e), min(e)) in every for e in made)

    def partition(edges):
        root = list(range(len(sets)))
        for a, b in edges:
            ra, rb = root[a], root[b]
            root = [ra if r == rb else r for r in root]
        return {tuple(k for k, r in enumerate(root) if r == v) for v in set(root)}

    assert partition(every) == partition(made)


def test_components_of_paths_stars_and_nulls(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3), (200, 201), (201, 200), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 130)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_checkpoints_of_few_edges_are_few_files(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 12)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        made = components(spark.createDataFrame([(k, k + 1) for k in range(20)], "a long, b long"))
        assert {r.component for r in made.collect()} == {0}
        assert made.rdd.getNumPartitions() == 2
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    files = {d.name: len(list(d.glob("part-*"))) for d in Path(folder.removeprefix("file:")).glob("rdd-*")}
    first, *steps = (files[k] for k in sorted(files, key=lambda k: int(k[4:])))
    assert first == 12 and steps and set(steps) == {1}


def test_documents_that_share_no_shingle(spark):
    rows = [(3, "a b c d e f g"), (2, "h i j k l m"), (9, "w"), (4, None)]
    got = x.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(2, 2, 2), (3, 3, 3), (4, 0, 4), (9, 1, 9)]


def test_count_of_a_part_comes_in_batches(spark, monkeypatch):
    monkeypatch.setattr(x, "CLASSES", 3)
    rows = near_copies(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted({tuple(r) for r in x.near_duplicates(docs, parts=2).collect()}) == sorted(brute(rows))
    packed = x.dealt(docs.select(F.col("text").cast("binary").alias("text")), 5, 2)

    class Plain:
        def __getattr__(self, name):
            return lambda *a: self if name != "mapInArrow" else a[0]

    batches = packed.where("part = 0").toArrow().to_batches()
    made = list(x.shared_shingles(Plain())(iter(batches)))
    assert len(made) > 5 and max(b.num_rows for b in made) == 3 and sum(b.num_rows for b in made) == x.shared_shingles(packed).where("part = 0").count()


def test_arrow_batches_of_long_rows_are_few_bytes(spark):
    small_batches(spark)
    long = spark.range(0, 400, 1, 1).selectExpr("repeat(cast(id as string), 40000) as text")
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches)
    assert max(r.n for r in long.mapInArrow(sizes, "n long").collect()) < 9 << 20
