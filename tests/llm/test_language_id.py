import math
import re

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.llm import language_id as x
from ledgerlens.llm import queries

SF = "/root/testdata/sf0.01"


def test_fusion_equals_plain_python(spark):
    rows = []
    for k in range(60):
        language = ("en", "fr", "de")[k % 3]
        words = {"en": "the house and this thing", "fr": "la maison et cette chose", "de": "das haus und dieses ding"}[language]
        rows.append((k, words + f" {k}x", language if k % 7 else "en-GB", f"h{k % 4}.{language if k % 5 else 'com'}"))
    rows += [(100, None, "en", "h1.com"), (101, "", None, None), (102, "12 !", "fr", ""), (103, "la maison", "??", "new.fr"), (1, *rows[1][1:])]
    df = spark.createDataFrame(rows, "id int, text string, lang string, host string")
    args = {"text_col": "text", "declared": F.col("lang"), "host": F.col("host"), "temper": 0.02}
    model = x.fit_text(df, "text", F.col("lang"))
    assert model.languages == ["de", "en", "fr"]
    flags = x.held([t.encode() if t else None for _, t, _, _ in rows])
    tag = [m[1] if (m := re.match(r"^([a-z]{2,3})(-GB)?$", lang or "")) else None for _, _, lang, _ in rows]
    seen = np.array([0.5 + flags[[t == k for t in tag]].sum(0) for k in model.languages])
    assert np.allclose(model.log_p, np.log(seen / seen.sum(1, keepdims=True)), atol=1e-5)
    score = flags @ np.log(seen / seen.sum(1, keepdims=True)).T * 0.02
    label = [model.languages[int(s.argmax())] if f.any() else None for s, f in zip(score, flags, strict=True)]
    count = lambda keep: np.array([sum(1 for i, lb in enumerate(label) if lb == k and keep(i)) for k in model.languages], float)
    everything = count(lambda i: True) + 1
    p_all = everything / everything.sum()
    host = [h for _, _, _, h in rows]

    def prior(h):
        if not h or not count(lambda i: host[i] == h).sum():
            return p_all
        p = p_all
        for part in (lambda z: z.rsplit(".", 1)[-1], lambda z: ".".join(z.rsplit(".", 2)[-2:]), lambda z: z):
            n = count(lambda i, part=part: bool(host[i]) and part(host[i]) == part(h))
            p = (n + 5 * p) / (n.sum() + 5)
        return p

    confusion = {}
    for d in model.languages:
        confusion[d] = []
        for k in model.languages:
            n = {e: sum(1 for t, lb in zip(tag, label, strict=True) if t == e and lb == k) for e in model.languages}
            confusion[d].append(math.log((n[d] + (1 if d == k else 0.1)) / (sum(n.values()) + 1.3)))
    got = {r.id: r for r in x.identify(df, into="l", **args).collect()}
    for i, (k, *_rest) in enumerate(rows):
        total = score[i] + np.log(prior(host[i])) + (confusion[tag[i]] if tag[i] in confusion else 0)
        p = np.exp(total - total.max())
        r = got[k].l
        assert r.language == model.languages[int(total.argmax())] and abs(r.probability - 1 / p.sum()) < 1e-4
        assert r.accepted == (bool(flags[i].any()) and r.probability >= 0.5)
    many = {r.id: r.l for r in x.identify(df, into="l", broadcast_hosts=0, **args).collect()}
    assert all(many[k].language == got[k].l.language and abs(many[k].probability - got[k].l.probability) < 1e-6 for k in got)


def test_edges(spark):
    empty = spark.createDataFrame([], "text string, lang string, language string")
    out = x.identify(empty, text_col="text", declared=F.col("lang"), host=F.lit(None).cast("string"))
    assert out.columns[-1] == "_language" and out.count() == 0
    none = spark.createDataFrame([("text", None), (None, "12345")], "text string, lang string")
    assert [(r.l.language, r.l.accepted) for r in x.identify(none, text_col="text", declared=F.col("lang"), host=F.col("lang"), into="l").collect()] == [("und", False)] * 2


def test_pages_against_the_language_in_their_path(spark):
    rows = queries.QUERIES["op3_language_id"](spark, SF).collect()
    assert len(rows) == 250
    right = [r.language == re.search(r"//[^/]+/(\w+)/", r.url)[1] for r in rows]
    assert sum(right) >= 0.99 * len(rows) and sum(r.accepted for r in rows) >= 0.99 * len(rows)


def test_rare_undeclared_and_unmodelled_languages(spark):
    words = {"en": "the house and this thing of that which was there", "de": "das haus und dieses ding von dem was dort nicht", "cy": "mae llyfrgell gymraeg yng nghaerdydd wrth ymyl"}
    spoken = lambda language, k: " ".join(words[language].split()[k % 4:]) + " " + words[language]
    rows = [(k, spoken(("en", "de")[k % 2], k), ("en", "de")[k % 2]) for k in range(250_000)]
    rows += [(300_000 + k, spoken("cy", k), "cy") for k in range(22)] + [(400_000, spoken("cy", 1), "xx"), (400_001, spoken("en", 1), "xx"), (400_002, spoken("en", 1), None)]
    rows += [(500_000, "qzx vkj wqp xxj zzv jqk pvw kzq xqv wjz vvx qqj zkw jxp wvk bqz", "en"), (500_001, "gwj zrlx hdwq ykvp oqbz nxjf cmqg uvzk bhxw tqpd", None)]
    df = spark.createDataFrame(rows, "id int, text string, lang string").repartition(8)
    out = x.identify(df, text_col="text", declared=F.col("lang"), host=F.lit("h.org"), into="l")
    got = {r.id: r.l for r in out.where("id >= 300000").collect()}
    assert all((got[300_000 + k].language, got[300_000 + k].accepted) == ("cy", True) for k in range(22))  # under 1e-4 of the rows
    for k in (400_000, 400_001, 500_000, 500_001):
        assert (got[k].language, got[k].accepted) == ("und", False), k
    assert (got[400_002].language, got[400_002].accepted) == ("en", True)
    assert out.where("id < 300000 and not (l.accepted and l.language = lang)").count() == 0


def test_only_texts_go_to_python_and_once(spark):
    df = spark.createDataFrame([(k, "the house", "en", "x" * 50) for k in range(30)], "id int, text string, lang string, other string")
    model = x.fit_text(df, "text", F.col("lang"))
    scored = x.scored(df, model, "text", "s", 1.0)
    plans = [scored, scored.where("s.n > 0").select("id", "s.n", "s.score"), x.identify(df, text_col="text", declared=F.col("lang"), host=F.lit("h"), text_model=model, into="l").where("l.accepted")]
    for plan in (f._jdf.queryExecution().optimizedPlan().toString() for f in plans):
        assert plan.count("ArrowEvalPython") == 1 and "MapInArrow" not in plan
    assert {(r.n, len(r.score)) for r in plans[1].collect()} == {(9, 1)}
    for odd in ([], [("a", None), (None, "en")]):
        out = x.scored(spark.createDataFrame(odd, "text string, lang string"), model, "text", "s", 1.0).collect()
        assert [len(r.s.score) for r in out] == [1] * len(odd)
