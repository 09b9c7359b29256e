import html
import itertools
import math
import re

from ledgerlens.llm import html_extract as x
from ledgerlens.llm import queries

SF = "/root/testdata/sf0.01"


def test_marginals_equal_enumeration():
    model = x.Model(x.counted(["<body><nav><li>a</li></nav><article><p>long text here</p><aside>b</aside></article></body>"] * 3))
    nodes, _ = x.tree("<body><nav><ul><li><a>x</a></ul></nav><div class=ad>y</div><main><h1>t</h1><p>some words</main>")
    own = [-60.0 if n.marked or n.inside else sum(model.unary.get(f, 0.0) for f in x.features(n)) for n in nodes]
    weight = {}
    for states in itertools.product((0, 1), repeat=len(nodes)):
        total = own[0] * states[0] + math.log(0.05) * states[0]
        for k in range(1, len(nodes)):
            parent = nodes[k].parent
            total += own[k] * states[k] + model.edge[x.kind_of(nodes[k]), states[parent]][states[k]]
        weight[states] = math.exp(total)
    z = sum(weight.values())
    for k, p in enumerate(model.marginals(nodes)):
        assert abs(p - sum(w for s, w in weight.items() if s[k]) / z) < 1e-9


def test_query_against_the_marked_article(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.QUERIES["op10_html_extraction"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)[^>]*>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


PAGES = [
    (1, "<html><body><header>Site</header><nav><a href=/>Home</a></nav><main><h1>T &amp; t</h1><p>One\n  two<br>three <b>bold</b>, four.</p><ul><li>item a<li>item b</ul><blockquote>quote</blockquote></main>"
        "<section id='comments'><div class=comment><p>First! A long comment of a reader that looks like text.</p></div></section><form><label>Mail</label><input></form><aside><p>More</p></aside><footer>&copy; x</footer></body></html>",
     "T & t\nOne two three bold, four.\nitem a\nitem b\nquote"),
    (2, "<article><p>cut off <b>here <p>next<script>var a='</p>'; <p>no", "cut off here\nnext"),
    (3, "<article><div class='cookie-notice'><p>We use cookies</p></div><p>Text 1 &lt; 2 <!-- hidden <p>x</p> --> end</p><div class=\"ad\">Buy</div>after</article>", "Text 1 < 2 end\nafter"),
    (9, "<body><article><h1>A</h1><div class=comments><div><div><p>Nice text, I liked it very much.</p></div></div></div><table><tr><td>x<td>y</table></article><div class=related><p>Also read</p></div></body>", "A\nx\ny"),
    (10, "<body><div id=menu><a href=1>One</a></div><div class=content><p>No article tag here, but running text in a paragraph.</p></div><div class=footer><p>Imprint</p></div></body>", "No article tag here, but running text in a paragraph."),
    (4, None, ""), (5, "", ""), (6, "<<>> < a & b", None), (7, "<nav>" * 3000, ""), (8, "<article><p>" + "word " * 60000 + "</p></article>", ("word " * 60000).strip()),
]


def test_edges(spark):
    train = spark.read.parquet(f"{SF}/pages.parquet")
    model = x.fit(train)
    df = spark.createDataFrame([(k, h, "m") for k, h, _ in PAGES] + [(2, PAGES[1][1], "m")], "page_id int, html string, main string")
    out = x.extract(df, model=model)
    assert out.columns == ["page_id", "html", "main", "_main"]
    got = {r.page_id: r._main.text for r in out.collect()}
    for k, _, text in PAGES:
        assert text is None or got[k] == text, (k, got[k][:300])
    assert x.extract(df.where("false")).count() == 0
    assert x.extract(df.where("page_id in (4, 5, 6)")).count() == 3  # nothing to train on


SLUGS = "<body><nav><a href=/>Home</a></nav><article class='post no-comments'>Own text.<h2 id='related-work'>Related work</h2><p class='ad-hoc'>Ad hoc.</p>" \
    "<section id='social-history'><h2 id=search>Search</h2><p>Short.</p></section><div class='share-buttons'><p>Tweet</p></div><p class=ad>Buy</p></article></body>"


def test_article_blocks_with_slug_ids_and_modifier_classes(spark):
    for model in (x.fit(spark.read.parquet(f"{SF}/pages.parquet")), x.Model(x.Counter())):
        assert x.extracted(SLUGS, model, 0.5)[0] == "Own text.\nRelated work\nAd hoc.\nSearch\nShort."


def test_marked_parts_are_never_returned():
    part = lambda name, n: f"<{name}>" + "<p>A long remark of a reader, an offer or a hint that looks like running text.</p>" * n + f"</{name.split()[0]}>"
    body = "<h1>T</h1><p>Text of it.</p>"
    plain = f"<body class='search page'><nav><a href=/>x</a></nav><article>{body}</article></body>"
    for attribute in ("class=comments", "class=ad", "class='notice big'", "id=newsletter", "role=complementary", "class=related-posts", "class=comment-list", "class='cookie-banner'", "class=sponsored"):
        held = plain.replace("</article>", part(f"div {attribute}", 3) + "</article>")
        for model in (x.Model(x.counted([plain] * 200)), x.Model(x.counted([held] * 200)), x.Model(x.counted([plain, held] * 100))):
            for n in (1, 4, 8, 30):
                inside = plain.replace("</article>", part(f"div {attribute}", n) + "<p>After.</p></article>")
                outside = plain.replace("</body>", part(f"section {attribute}", n) + "</body>")
                nested = plain.replace("</article>", f"<div {attribute}><article>" + part("div", n) + "</article></div></article>")
                assert x.extracted(inside, model, 0.5)[0] == "T\nText of it.\nAfter.", (attribute, n)
                assert x.extracted(outside, model, 0.5)[0] == x.extracted(nested, model, 0.5)[0] == "T\nText of it.", (attribute, n)
