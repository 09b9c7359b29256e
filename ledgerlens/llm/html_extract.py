"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of its block elements. Each node is content or boilerplate; a node's features (tag, class and id
names, share of linked characters, amount of text) give its unary potential, and each parent-child edge a potential
that depends on whether the parent is a non-article part by its tag or its names. Sum-product messages go up the tree and down
again, and a node whose marginal probability of content is at least ``threshold`` keeps its text.

The potentials are counts from labelled pages: pages that mark their article (``<article>``, ``<main>``), whose nodes
inside it, apart from marked parts, are content. A node is marked by its tag (``<nav>``), or by a class, id or role that names
such a part as a whole (``comments``, ``ad``, ``related-posts``; not ``related-work``, no id of a heading, no name of the page's body): it is clamped to
boilerplate, however much text it holds and wherever it stands, and what is under it goes with it. Counting runs on a hash sample of about ``train_pages`` of these pages
(a bound on the cost of training); small prior counts cover names that no labelled page has.

Blocks keep page order; character references are decoded, white space in a block becomes one space, empty blocks
vanish, and blocks join by a newline. Null or empty html gives an empty text; unclosed tags, comments and scripts
end at the end of the page. Repeated rows give repeated results, an empty table an empty result; extra columns pass.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_struct, fresh_name

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<", re.S)
NAMED = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br".split())
RAW = frozenset("script style".split())
MARKED_TAGS = frozenset("nav header footer aside form script style noscript template head title iframe button select option textarea dialog menu svg object canvas".split())
CLOSED_BY = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
             "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
             "option": frozenset(["option"])}
KEEPS_OPEN = frozenset("article section div body main table ul ol dl blockquote nav aside header footer form".split())
MARKED_NAMES = frozenset("""ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus
    disclaimer footer gdpr header masthead menu modal nav navbar navigation newsletter notice notification pagination popup promo promoted related respond
    share sharing sidebar social sponsor sponsored subscribe toolbar widget contentinfo complementary search""".split())
#: Pieces that leave a marked name what it is: ``share-buttons``, ``site-footer``.
LAYOUT_NAMES = frozenset("""area bar block body bottom box button buttons col column container content footer form group head icon icons inner item items left link links
    list main outer page panel post posts primary right row secondary section signup site slot title top unit wrap wrapper""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN_NAMES = frozenset("article content entry main post story text".split())
MAIN_TAGS = frozenset(["article", "main"])
#: Prior counts of (feature, label): what any page would teach.
PRIOR = {(("name", "marked"), 0): 50.0, (("name", "main"), 1): 50.0, **{(("tag", f"{t}:0"), 1): 20.0 for t in ("p", "h1", "h2", "h3", "blockquote", "pre")}}
CLAMP = -60.0
#: Elements whose names speak of the page as a whole.
PAGE_TAGS = frozenset(["html", "body", "main"])

RESULT = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("blocks", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("content", T.DoubleType())]))),
])


def pieces_of(name: str) -> list[str]:
    return [p for p in re.split("[_-]+", name) if p]


def marks(names: set[str]) -> bool:
    """Whether a name as a whole says that a part is no article: a marked name, alone or among layout words."""
    return any(not MARKED_NAMES.isdisjoint(p) and all(x in MARKED_NAMES or x in LAYOUT_NAMES for x in p) for p in map(pieces_of, names))


class Node:
    __slots__ = ("tag", "parent", "inside", "marked", "named", "main", "chars", "linked", "all_chars", "all_linked", "run")

    def __init__(self, tag: str, parent: int, names: set[str], inside: bool = False):
        self.tag, self.parent, self.inside = tag, parent, inside  # a node above is marked
        self.named = tag not in MARKED_TAGS and tag not in PAGE_TAGS and marks(names)
        self.marked = tag in MARKED_TAGS or self.named
        self.main = tag in MAIN_TAGS or any(not MAIN_NAMES.isdisjoint(p) and MARKED_NAMES.isdisjoint(p) for p in map(pieces_of, names))
        self.chars = self.linked = 0
        self.run: list[str] | None = None


def tree(page: str) -> tuple[list[Node], list[tuple[int, list[str]]]]:
    """Nodes in page order (a parent before its children) and the text runs as (node, pieces)."""
    nodes, runs = [Node("#page", -1, set())], []
    open_tags: list[tuple[str, int]] = [("#page", 0)]  # tag, node that text under it belongs to
    links = at = 0

    def text(piece: str) -> None:
        node = nodes[open_tags[-1][1]]
        if node.run is None:
            if not piece.strip():
                return
            node.run = []
            runs.append((open_tags[-1][1], node.run))
        node.run.append(html.unescape(piece))
        size = len(piece)
        node.chars += size
        node.linked += size if links else 0

    def boundary() -> None:
        for _, k in open_tags:
            nodes[k].run = None

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0] == "<":
                text("<")
            continue
        inline = tag in INLINE
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            depth = next((k for k in range(len(open_tags) - 1, 0, -1) if open_tags[k][0] == tag), 0)
            if not inline:
                boundary()
            if depth and not (inline and any(t not in INLINE for t, _ in open_tags[depth + 1:])):
                del open_tags[depth:]
            continue
        if tag == "br":
            text(" ")
            continue
        if not inline:
            boundary()
            links = 0
            for k in range(len(open_tags) - 1, 0, -1):
                above = open_tags[k][0]
                if tag in CLOSED_BY.get(above, ()):
                    del open_tags[k:]
                    break
                if above in KEEPS_OPEN:
                    break
        if tag in VOID or m[3].endswith("/"):
            continue
        found = NAMED.findall(m[3]) if "=" in m[3] else []
        names = {w for kind, *value in found if not (kind.lower() == "id" and tag in HEADINGS) for w in "".join(value).lower().split()}
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        parent = open_tags[-1][1]
        if inline and not marks(names):
            open_tags.append((tag, parent))
        else:
            open_tags.append((tag, len(nodes)))
            above = nodes[parent]
            nodes.append(Node(tag, parent, names, above.inside or above.marked))
        links += tag == "a"
    for n in nodes:
        n.all_chars, n.all_linked = n.chars, n.linked
    for n in reversed(nodes[1:]):
        nodes[n.parent].all_chars += n.all_chars
        nodes[n.parent].all_linked += n.all_linked
    return nodes, runs


def features(node: Node) -> list[tuple[str, str]]:
    """Tag with the share of linked characters under it (in thirds), marks, amount of own text."""
    out = [("tag", f"{node.tag}:{min(3, 4 * node.all_linked // node.all_chars) if node.all_chars else ''}")]
    if node.named:
        out.append(("name", "marked"))
    elif node.main:
        out.append(("name", "main"))
    if node.chars:
        out.append(("size", str(min(4, int(math.log(node.chars, 4))))))
    return out


def labels(nodes: list[Node]) -> list[int] | None:
    """Content labels of a page that marks its article, else None; marked parts and all under them are no content."""
    starts = [n.tag in MAIN_TAGS and not n.marked and not n.inside for n in nodes]
    if not any(starts):
        return None
    out: list[int] = []
    for n, start in zip(nodes, starts, strict=True):
        above = n.parent >= 0 and out[n.parent]
        out.append(int(not n.marked and not n.inside and bool(above or start)))
    return out


class Model:
    """Log potentials from counts of (feature, label), and of (edge kind, parent label, child label)."""

    def __init__(self, counts: Counter):
        seen = Counter({("f", *k): v for k, v in PRIOR.items()})
        seen.update(counts)
        kinds = {"tag", "name", "size"}
        total = {(kind, y): sum(v for k, v in seen.items() if k[0] == "f" and k[1][0] == kind and k[2] == y) for kind in kinds for y in (0, 1)}
        width = {kind: 1 + len({k[1] for k in seen if k[0] == "f" and k[1][0] == kind}) for kind in kinds}
        names = {k[1] for k in seen if k[0] == "f"}
        self.unary = {f: self._ratio(seen, total, width, f) for f in names}
        self.edge = {}
        for kind in ("in", "marked", "open"):
            for a in (0, 1):
                n = [seen["e", kind, a, b] + (1.0 if b == a or (kind == "marked" and a) else 1e-9 if kind == "in" or (kind == "open" and a) else 0.1) for b in (0, 1)]
                self.edge[kind, a] = [math.log(x / sum(n)) for x in n]

    @staticmethod
    def _ratio(seen: Counter, total: dict, width: dict, f: tuple) -> float:
        """How much likelier the feature is under content (log ratio); amounts count half as they go together."""
        p = [(seen["f", f, y] + 1) / (total[f[0], y] + width[f[0]]) for y in (0, 1)]
        return (1.0 if f[0] != "size" else 0.5) * math.log(p[1] / p[0])

    def own(self, node: Node) -> float:
        return CLAMP if node.marked or node.inside else sum(self.unary.get(f, 0.0) for f in features(node))

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content of each node: messages from the leaves up, then from the root down."""
        n = len(nodes)
        own = [self.own(node) for node in nodes]
        below = [[0.0, x] for x in own]  # log potentials with all messages from below
        up = [[0.0, 0.0]] * n
        for k in range(n - 1, 0, -1):
            node = nodes[k]
            message = []
            for a in (0, 1):
                e = self.edge[kind_of(node), a]
                message.append(log_sum(e[0] + below[k][0], e[1] + below[k][1]))
            up[k] = message
            to = below[node.parent]
            to[0] += message[0]
            to[1] += message[1]
        belief = [[below[0][0], below[0][1] + math.log(0.05)], *([None] * (n - 1))]
        out = [share(*belief[0])]
        for k in range(1, n):
            node = nodes[k]
            rest = [belief[node.parent][a] - up[k][a] for a in (0, 1)]
            e = [self.edge[kind_of(node), a] for a in (0, 1)]
            down = [log_sum(rest[0] + e[0][b], rest[1] + e[1][b]) for b in (0, 1)]
            belief[k] = [below[k][b] + down[b] for b in (0, 1)]
            out.append(share(*belief[k]))
        return out


def kind_of(node: Node) -> str:
    """Kind of the edge above a node: in a marked part, of a marked node, or open."""
    return "in" if node.inside else "marked" if node.marked else "open"


def log_sum(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a >= b else b + math.log1p(math.exp(a - b))


def share(no: float, yes: float) -> float:
    return 1 / (1 + math.exp(min(700.0, no - yes)))


def extracted(page: str, model: Model, threshold: float) -> tuple[str, list[dict]]:
    nodes, runs = tree(page)
    content = model.marginals(nodes)
    blocks = [{"text": " ".join("".join(pieces).split()), "content": content[k]} for k, pieces in runs]
    blocks = [b for b in blocks if b["text"]]
    return "\n".join(b["text"] for b in blocks if b["content"] >= threshold), blocks


def counted(pages: list[str]) -> Counter:
    out: Counter = Counter()
    for page in pages:
        nodes, _ = tree(page)
        y = labels(nodes)
        if y is None:
            continue
        for k, node in enumerate(nodes):
            for f in features(node):
                out["f", f, y[k]] += 1
            if k:
                out["e", kind_of(node), y[node.parent], y[k]] += 1
    return out


def fit(pages: DataFrame, html_col: str = "html", *, train_pages: int = 2000) -> Model:
    """Potentials from a hash sample of about ``train_pages`` labelled pages; only counts come to the driver."""
    html_text = F.col(f"`{html_col}`")
    labelled = pages.select(html_text.alias("html")).where(html_text.rlike("(?i)<(?:article|main)[\\s>]"))
    total = labelled.count()
    keep = min(1 << 20, math.ceil((train_pages << 20) / max(1, total)))
    schema = "kind string, a string, b string, y int, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            seen.update(counted([x.decode("utf-8", "replace") for x in batch.column(0).to_pylist()]))
        rows = [("f", k[1][0], k[1][1], k[2], n) if k[0] == "f" else ("e", k[1], str(k[2]), k[3], n) for k, n in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64()))], names=["kind", "a", "b", "y", "n"])

    sample = labelled.where(F.pmod(F.xxhash64("html"), F.lit(1 << 20)) < keep).select(F.col("html").cast("binary").alias("html"))
    rows = sample.mapInArrow(run, schema).groupBy("kind", "a", "b", "y").agg(F.sum("n").alias("n")).collect()
    return Model(Counter({("f", (r.a, r.b), r.y) if r.kind == "f" else ("e", r.a, int(r.b), r.y): r.n for r in rows}))


def extract(pages: DataFrame, html_col: str = "html", *, into: str | None = None, threshold: float = 0.5, model: Model | None = None) -> DataFrame:
    """``pages`` with struct ``into``: the main ``text`` and all ``blocks`` with their content probability."""
    model = model or fit(pages, html_col)

    def run(texts: list) -> pa.StructArray:
        made = [extracted(x.decode("utf-8", "replace"), model, threshold) if x else ("", []) for x in texts]
        block = pa.struct([("text", pa.string()), ("content", pa.float64())])
        return pa.StructArray.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.list_(block))], names=["text", "blocks"])

    return append_struct(pages, html_col, run, RESULT, into or fresh_name(pages, "main"))
