import random

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import decontaminate as d

WORDS = st.lists(st.sampled_from([b"a", b"b", b"c", b"dd"]), max_size=40)


def brute(items, words, window):
    hit, owners = set(), set()
    for item, text in items:
        w = d.words_of(text)
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            for at in range(len(words) - size + 1):
                if words[at:at + size] == w[k:k + size]:
                    hit.update(range(at, at + size))
                    owners.add(item)
    return hit, owners


@settings(max_examples=300, deadline=None)
@given(st.lists(WORDS, max_size=5), WORDS, st.integers(1, 6))
def test_search_equals_brute_force(patterns, words, window):
    items = [(str(k), b" ".join(p)) for k, p in enumerate(patterns)]
    spans, owners = d.search(d.build(items, window), words)
    hit, expected = brute(items, words, window)
    assert {p for a, b in spans for p in range(a, b)} == hit and set(owners) == expected
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_frame_edges_and_many_passes(spark):
    rng = random.Random(7)
    base = [rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(400)]
    items = [(k, " ".join(base[k * 9:k * 9 + 20])) for k in range(30)] + [(None, "ax by"), (77, None), (78, "!!")]
    docs = [(k, " ".join(base[k * 20:k * 20 + 60]).upper() + " É") for k in range(20)] + [(None, None), (5, ""), (5, ""), (6, "é" * 9000)]
    df = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, scan string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = d.scan(df, bench, window=13)
    assert one.columns[-1] == "_scan"
    many = d.scan(df, bench, window=13, block_bytes=500, into="found")
    rows = lambda out, c: sorted(((r.doc_id, r.text, r[c].n_words, [tuple(h) for h in r[c].hits], r[c]["items"]) for r in out.collect()), key=str)
    assert rows(one, "_scan") == rows(many, "found")
    for _, text, n_words, hits, found in rows(one, "_scan"):
        words = d.words_of((text or "").encode())
        hit, owners = brute([(None if i is None else str(i), (t or "").encode()) for i, t in items], words, 13)
        assert n_words == len(words) and {p for a, b in hits for p in range(a, b)} == hit
        assert found == sorted(o for o in owners if o is not None)
    none = d.scan(df, bench.where("false"), into="found").select("found.*").collect()
    assert len(none) == len(docs) and all(not r.hits and not r["items"] for r in none)
    assert d.scan(df.where("false"), bench).count() == 0
