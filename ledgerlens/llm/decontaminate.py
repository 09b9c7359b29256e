"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of ``window`` consecutive words of the benchmark items (an item with fewer words, but
not none, is one window). Patterns of one length form a table: the shift table maps a block of ``block`` words to the
distance by which the search may move on, blocks at a pattern's end (shift 0) select a bucket, and the bucket's
patterns are compared word for word. A block that occurs in no pattern moves the search by ``length - block + 1``
words, so most of a clean text is never looked at.

The patterns are built on the driver from the benchmark, in blocks of at most ``block_bytes`` of item text; each block
is broadcast and searched in its own pass over the documents, and the passes of a document are united. The
broadcast is therefore bounded whatever the size of the benchmark.

Null or empty texts have no words and no hits. Null items, or items without words, have no window. Items with a null
id count as hits of words but are not listed. Repeated rows give repeated results; an empty table gives an empty
result; with an empty benchmark nothing is hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_struct, fresh_name

# Fixed value: the word pattern of the contract, on UTF-8 bytes after lower-casing A-Z.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []  # bytes.lower() changes A-Z only


class WuManber:
    """Search tables for patterns of one length (``length`` words)."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list], block: int = 3):
        self.length, self.block = length, min(block, length)
        self.default = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list] = {}
        for pattern, owners in patterns.items():
            for end in range(self.block, length + 1):
                key = pattern[end - self.block:end]
                self.shift[key] = min(self.shift.get(key, self.default), length - end)
            self.bucket.setdefault(pattern[length - self.block:], []).append((list(pattern), owners))

    def search(self, words: list[bytes]) -> Iterable[tuple[int, list]]:
        """(start, owners) of each occurrence."""
        shift, block, length, default = self.shift.get, self.block, self.length, self.default
        at, n = length, len(words)  # ``at`` is the end of the window under the search
        while at <= n:
            key = tuple(words[at - block:at])
            step = shift(key, default)
            if step:
                at += step
                continue
            for pattern, owners in self.bucket[key]:
                if words[at - length:at] == pattern:
                    yield at - length, owners
            at += 1


def build(items: list[tuple], window: int) -> list[WuManber]:
    """Tables by pattern length for (item id, text bytes) pairs."""
    by_length: dict[int, dict] = {}
    for item, text in items:
        words = words_of(text)
        if not words:
            continue
        length = min(window, len(words))
        found = by_length.setdefault(length, {})
        for k in range(len(words) - length + 1):
            owners = found.setdefault(tuple(words[k:k + length]), [])
            if item not in owners:
                owners.append(item)
    return [WuManber(length, patterns) for length, patterns in sorted(by_length.items())]


def search(tables: list[WuManber], words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
    """Maximal hit runs as (start, end) word positions, and the owners found."""
    spans, owners = [], set()
    for t in tables:
        for start, who in t.search(words):
            spans.append((start, start + t.length))
            owners.update(who)
    return merged(spans), owners


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def scan(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
         window: int = 13, block_bytes: int = 16 << 20, into: str | None = None) -> DataFrame:
    """``docs`` with a struct column ``into``: ``n_words``, ``hits`` (maximal word runs), ``items`` (ids as text, sorted)."""
    spark = docs.sparkSession
    into = into or fresh_name(docs, "scan")
    pairs = items.select(F.col(f"`{item_id}`").cast("string").alias("id"), F.col(f"`{item_text}`").cast("binary").alias("text")).where("text is not null")
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 64
    total = pairs.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()["bytes"]
    parts = 1 + int(total // block_bytes)
    part = F.pmod(F.xxhash64("id", "text"), F.lit(parts))
    made, out = [], docs
    for k in range(parts):
        made.append(into if parts == 1 else fresh_name(out, f"scan_{k}"))
        block = [tuple(r) for r in pairs.where(part == k).distinct().collect()]
        out = _one_pass(out, text_col, block, window, made[-1], spark)
    return out if parts == 1 else out.select(*[F.col(f"`{c}`") for c in docs.columns], _united(made).alias(into))


def _one_pass(docs: DataFrame, text_col: str, block: list[tuple], window: int, into: str, spark) -> DataFrame:
    tables = spark.sparkContext.broadcast(build([(i, bytes(t)) for i, t in block], window))

    def run(texts: list) -> pa.StructArray:
        n_words, hits, found = [], [], []
        for text in texts:
            words = words_of(text)
            spans, owners = search(tables.value, words) if words else ([], ())
            n_words.append(len(words))
            hits.append([{"start": a, "end": b} for a, b in spans])
            found.append(sorted(o for o in owners if o is not None))
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        return pa.StructArray.from_arrays(
            [pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(span)), pa.array(found, pa.list_(pa.string()))],
            names=["n_words", "hits", "items"])

    return append_struct(docs, text_col, run, RESULT, into)


def _united(made: list[str]) -> F.Column:
    """One scan struct from those of several passes: runs merged where they meet, items united."""
    spans = F.array_sort(F.concat(*[F.col(c)["hits"] for c in made]))

    def add(acc, s):
        last = F.element_at(acc, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(F.size(acc) == 0, F.array(s)).when(s["start"] <= last["end"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(s)))

    empty = F.from_json(F.lit("[]"), RESULT["hits"].dataType)
    return F.struct(F.col(made[0])["n_words"].alias("n_words"), F.aggregate(spans, empty, add).alias("hits"),
                    F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(c)["items"] for c in made])))).alias("items"))


def n_hit(scan_col: str) -> F.Column:
    """Number of hit words of a scan struct."""
    return F.aggregate(F.col(scan_col)["hits"], F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))


def contaminated(n_words: F.Column, hit: F.Column) -> F.Column:
    """At least one word in twenty is hit."""
    return (hit > 0) & (hit * 20 >= n_words)
