"""URL filters: allow and block entries in a trie over reversed host labels and path segments.

An entry is a host and a path. It fits a URL whose host is that host or a subdomain of it and whose path starts with
the entry's path; of all entries that fit, the longest (host and path together, then the longer host) gives the verdict, and a
URL that none fits gets ``default``. Of equal entries with different verdicts the blocking one holds.

Hosts are what stands between the first ``://`` and the next ``/``, ``?``, ``#`` or end, A-Z lower-cased, paths what follows up to
``?``, ``#`` or end. A null URL, or one without ``://``, has an empty host and path, which only entries with an empty host fit.
Entries with a null host, path or verdict are ignored, as are ones without any URL; repeated URLs are judged row by
row; an empty table of URLs or entries is fine, and all columns of the rows pass through.

The trie is broadcast where the entries' bytes, counted by Spark, are at most ``trie_bytes``. Beyond that nothing is broadcast: every distinct host
and path meets the entries in a join on (host suffix, path prefix), for the lengths that entries have.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, small_batches

VERDICT = "struct<rule:string,verdict:string>"
#: Text of the entries that may be broadcast as a trie; a trie of short entries takes about 20 times its text in a Python worker.
TRIE_BYTES = 8 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """The URL's host, empty where there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """The URL's path, empty where there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Node:
    """A host label or a path segment: ``below`` has the next ones, ``rules`` the entries that end inside the next segment by the text they end with."""

    __slots__ = ("below", "paths", "rules", "widths")

    def __init__(self) -> None:
        self.below: dict[str, Node] = {}
        self.paths: Node | None = None
        self.rules: dict[str, tuple[int, str, str]] = {}
        self.widths: list[int] = []

    def child(self, key: str) -> Node:
        return self.below.setdefault(key, Node())


class Trie:
    """Entries by their host labels, last one first, and below each host by the segments of their path."""

    def __init__(self, entries: Iterable[tuple[str, str, str]]) -> None:
        self.root = Node()
        for name, where, verdict in entries:
            node = self.root
            for label in reversed(name.split(".")) if name else ():
                node = node.child(label)
            node.paths = node.paths or Node()
            node = node.paths
            *whole, rest = where.split("/")
            for segment in whole:
                node = node.child(segment)
            held = node.rules.get(rest)
            if held is None or verdict == "block":
                node.rules[rest] = (len(name) + len(where), name + where, verdict)
                node.widths = sorted({len(r) for r in node.rules})

    def find(self, name: str, where: str) -> tuple[int, str, str] | None:
        """The longest entry that fits; of equally long ones that with the longer host, which is met last."""
        segments = where.split("/")
        node, best = self.root, None
        for label in [None, *reversed(name.split("."))]:
            if label is not None:
                node = node.below.get(label)
                if node is None:
                    break
            # Down the segments: an entry fits if it ends with a prefix of the segment that comes next.
            at, depth = node.paths, 0
            while at is not None:
                segment = segments[depth]
                for width in at.widths:
                    found = at.rules.get(segment[:width]) if width <= len(segment) else None
                    if found is not None and (best is None or found[0] >= best[0]):
                        best = found
                depth += 1
                at = at.below.get(segment) if depth < len(segments) else None
        return best


def _by_trie(df: DataFrame, at: str, entries: list[tuple[str, str, str]], default: str, into: str) -> DataFrame:
    """``at``: a struct column of host and path; it goes, and the verdict comes in its place."""
    spark = df.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(entries)
    names = [*[c for c in df.columns if c != at], into]
    kept = [k for k, c in enumerate(df.columns) if c != at]
    place = df.columns.index(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value)
        for batch in batches:
            column = batch.column(place)
            rules, verdicts = [], []
            for name, where in zip(column.field(0).to_pylist(), column.field(1).to_pylist(), strict=True):
                found = trie.find(name, where)
                rules.append(found[1] if found else None)
                verdicts.append(found[2] if found else default)
            made = pa.StructArray.from_arrays([pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], names=["rule", "verdict"])
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], made], names=names)

    fields = df.select(*[F.col(f"`{c}`") for c in names[:-1]], F.lit(None).cast(VERDICT).alias(into)).schema
    return df.mapInArrow(run, fields)


def _by_join(df: DataFrame, at: str, rules: DataFrame, default: str, into: str) -> DataFrame:
    """The same through a join on every (host suffix, path prefix) of the distinct hosts and paths."""
    spark = df.sparkSession
    # Lengths of entries' paths: at most as many as the longest path has characters.
    widths = [r[0] for r in rules.select(F.length("path")).distinct().collect()]
    urls = df.select(F.col(at)["host"].alias("host"), F.col(at)["path"].alias("path")).distinct()
    labels = F.split("host", r"\.")
    suffixes = F.array_append(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")), F.lit(""))
    cuts = F.array(*[F.lit(w) for w in sorted(widths)]).cast("array<int>")
    prefixes = F.transform(F.filter(cuts, lambda w: w <= F.length("path")), lambda w: F.substring("path", F.lit(1), w))
    keys = urls.withColumn("h", F.explode(F.array_distinct(suffixes))).withColumn("p", F.explode(prefixes))
    met = keys.join(rules.select(F.col("host").alias("h"), F.col("path").alias("p"), "verdict"), ["h", "p"])
    longest = F.struct((F.length("h") + F.length("p")).alias("a"), F.length("h").alias("b"), F.concat("h", "p").alias("rule"), F.col("verdict"))
    found = met.groupBy("host", "path").agg(F.max(longest).alias("best"))
    found = found.select(F.struct("host", "path").alias("_at"), F.struct(F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict")).alias("_best"))
    key, best = fresh_name(df, "_at"), fresh_name(df, "_best")
    found = found.withColumnsRenamed({"_at": key, "_best": best}) if (key, best) != ("_at", "_best") else found
    out = df.join(found, F.col(at) == F.col(key), "left")
    verdict = F.struct(F.col(best)["rule"].alias("rule"), F.coalesce(F.col(best)["verdict"], F.lit(default)).alias("verdict"))
    return out.withColumn(into, verdict).select(*[F.col(f"`{c}`") for c in df.columns if c != at], into)


def judge(df: DataFrame, rules: DataFrame, url: Column, *, default: str = "allow", into: str = "judged", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """``df`` with struct column ``into`` (rule: host and path of the entry that decides, or null; verdict: ``allow`` or ``block``).

    ``rules`` has the columns host, path and verdict.
    """
    into = fresh_name(df, into)
    rules = rules.where("host is not null and path is not null and verdict in ('allow', 'block')")
    rules = rules.groupBy(F.translate("host", UPPER, LOWER).alias("host"), "path").agg(F.max("verdict").alias("verdict"))  # block is the larger
    size = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 8)).first()[0] or 0
    at = fresh_name(df, "_url_at")
    rows = df.withColumn(at, F.struct(host(url).alias("host"), path(url).alias("path")))
    if size > trie_bytes:
        return _by_join(rows, at, rules, default, into)
    return _by_trie(rows, at, [tuple(r) for r in rules.select("host", "path", "verdict").collect()], default, into)
