import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.llm import url_rules as u

HOSTS = st.lists(st.sampled_from(["a", "b", "org", ""]), max_size=4).map(".".join)
PATHS = st.text("/ab", max_size=6)
RULES = st.lists(st.tuples(HOSTS, PATHS, st.sampled_from(["allow", "block"])), max_size=12)


def brute(rules, host, path):
    """(rule, verdict) of the longest fitting entry, by comparing texts."""
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (h in ("", host) or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else None


@settings(max_examples=400, deadline=None)
@given(RULES, HOSTS, PATHS)
def test_trie_equals_brute_force(rules, host, path):
    found = u.Trie(rules).find(host, path)
    assert (found and found[1:]) == brute(rules, host, path)


def split(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    return "".join(c.lower() if c.isascii() else c for c in host), path.split("#")[0].split("?")[0]


def test_frame_edges_broadcast_and_join(spark):
    rng = random.Random(3)
    name = lambda: ".".join(rng.choice(["a", "b", "org", "example"]) for _ in range(rng.randint(1, 4)))
    where = lambda: "".join(rng.choice(["/", "x", "en/", "1"]) for _ in range(rng.randint(0, 4)))
    rules = [(name(), "/" + where(), rng.choice(["allow", "block"])) for _ in range(60)] + [("B.org", "/", "block"), ("b.org", "/", "allow"), ("", "", "allow"), ("a", None, "block"), (None, "/", "block"), ("a", "/", "?")]
    urls = [f"{rng.choice(['http', 'x'])}://{name().upper()}{rng.choice(['/', '?', '#', ''])}{where()}{rng.choice(['', '?q=/x://y', '#z', ':80'])}" for _ in range(300)]
    urls += [None, "", "no host/x", "://", "://a", "a://b://c/", "http://Ä.org/é\nx", "http://a.org/" + "x/" * 20000, "http://x/\n?", urls[0]]
    df = spark.createDataFrame([(k, x, "r", "j") for k, x in enumerate(urls)], "page_id int, url string, rule string, judged string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    real = [(h.lower(), p, v) for h, p, v in rules if h is not None and p is not None and v != "?"]
    for size in (1 << 20, 0):
        out = u.judge(df, table, F.col("url"), default="block", trie_bytes=size)
        assert out.columns == [*df.columns, "_judged"]
        got = {r.page_id: r for r in out.collect()}
        assert len(got) == len(urls)
        for k, url in enumerate(urls):
            assert tuple(got[k]._judged) == (brute(real, *split(url)) or (None, "block"))
        assert {r.judged for r in got.values()} == {"j"}
        assert u.judge(df.where("false"), table, F.col("url"), trie_bytes=size).count() == 0
    none = u.judge(df, table.where("false"), F.col("url")).select("_judged.*").distinct().collect()
    assert [tuple(r) for r in none] == [(None, "allow")]
    parts = df.select("page_id", u.host(F.col("url")).alias("h"), u.path(F.col("url")).alias("p")).collect()
    assert all((r.h, r.p) == split(urls[r.page_id]) for r in parts)
