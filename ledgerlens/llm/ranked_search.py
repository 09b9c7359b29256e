"""Ranked lexical search by the Best Position Algorithm over impact lists.

``index`` stores an inverted index in shards of documents: per shard its documents, their lengths, and for each term the documents that hold
it with their counts. ``search`` ranks all documents for each query: in a shard, every term of a query has an impact list, its documents by
falling impact. Rows of all lists are read side by side (sorted access); every document met is looked up in all
other lists at once (direct access), which marks its position there as seen too. A list's best position ends its run of seen
positions from the top; what no list has shown yet scores at most the sum of the lists' impacts right after their best
positions, and the shard is done when that bound is strictly below its k-th best score (an equal score could still win by its
smaller key). Spark merges the shards' k best by rank. A term that every document holds is spread over all shards, so no list is one task's.

Score of a document: sum over the query's terms, repeats included, of w * ((10**9 * tf) div (1000 * tf + 12 * m)), with
w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))) and m = 75 + (25 * n * N) div L; N documents have terms, L terms in all, n in the document.

Documents are rows: repeated ones are ranked each, null and empty texts hold no term and are never returned, null keys come last among
equal scores. Queries are the distinct (id, text) pairs; null or empty ones return nothing. Empty tables are fine. No list, candidate or text is
cut. Queries go out in blocks of about ``block_bytes`` of text (one larger query is a block), each a pass of its own over the index.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, written

SHARD_BYTES = 16 << 20
SHARD_ROWS = 50_000
BLOCK_BYTES = 1 << 20

_TERM_BYTES = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: Each byte of a term as itself with A-Z lower-cased, all others as blanks.
_FOLD = bytes(b if _TERM_BYTES.match(bytes([b])) else 32 for b in range(256)).lower()


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class _Builder:
    def __init__(self) -> None:
        self.codes: dict[bytes, int] = {}
        self.found: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes | None) -> None:
        codes, words = self.codes, terms_of(text)
        self.found.append(np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words)))
        self.size += len(text or b"")

    def columns(self) -> dict[str, pa.Array]:
        """Postings by term, then document."""
        lengths = np.array([len(f) for f in self.found], np.int64)
        wide = max(1, len(self.found))
        rows = np.repeat(np.arange(len(self.found)), lengths)
        cells, counts = np.unique((np.concatenate(self.found) if self.found else np.zeros(0, np.int64)) * wide + rows, return_counts=True)
        held = np.diff(np.searchsorted(cells, np.arange(len(self.codes) + 1) * wide))
        blob = lambda x: pa.array([x.tobytes()], pa.binary())
        listed = lambda x: pa.ListArray.from_arrays([0, len(x)], x)
        return {"lengths": blob(lengths), "terms": listed(pa.array(list(self.codes), pa.binary())), "held": listed(pa.array(held, pa.int64())),
                "docs": blob((cells % wide).astype(np.int32)), "counts": blob(counts.astype(np.int32)),
                "n_docs": pa.array([int((lengths > 0).sum())], pa.int64()), "n_terms": pa.array([int(lengths.sum())], pa.int64())}


def index(docs: DataFrame, *, key: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The stored index: a row per shard with ``keys`` and the columns of ``_Builder``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text_col}`").cast("binary").alias("utf8"))
    kind = rows.schema["key"].dataType
    arrow = {"binary": ("lengths", "docs", "counts"), "long": ("n_docs", "n_terms")}
    schema = T.StructType([T.StructField("keys", T.ArrayType(kind)), *[T.StructField(c, T.BinaryType()) for c in arrow["binary"]], T.StructField("terms", T.ArrayType(T.BinaryType())),
                           T.StructField("held", T.ArrayType(T.LongType())), *[T.StructField(c, T.LongType()) for c in arrow["long"]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys = _Builder(), []

        def flush() -> pa.RecordBatch:
            nonlocal shard, keys
            every = pa.concat_arrays(keys)
            made = {"keys": pa.ListArray.from_arrays([0, len(every)], every), **shard.columns()}
            shard, keys = _Builder(), []
            return pa.RecordBatch.from_arrays([made[c] for c in schema.names], names=schema.names)

        for batch in batches:
            since = 0
            for k, text in enumerate(batch.column(1)):
                text = text.as_py()
                if shard.found and (shard.size + len(text or b"") > shard_bytes or len(shard.found) >= shard_rows):
                    if k > since:
                        keys.append(batch.column(0).slice(since, k - since))
                    yield flush()
                    since = k
                shard.add(text)
            if batch.num_rows > since:
                keys.append(batch.column(0).slice(since))
        if shard.found:
            yield flush()

    return written(docs.sparkSession, rows.mapInArrow(run, schema), "index", rows_per_file=4)


class Lists:
    """The impact lists of a shard for the terms of a block of queries."""

    def __init__(self, lengths: np.ndarray, docs: np.ndarray, counts: np.ndarray, spans: dict[bytes, tuple[int, int]], total_docs: int, total_terms: int) -> None:
        self.m = np.array([75 + (25 * int(n) * total_docs) // total_terms for n in lengths], np.int64) if total_terms else np.zeros(len(lengths), np.int64)
        self.docs, self.counts, self.spans, self.made = docs, counts, spans, {}
        self.n = len(lengths)

    def of(self, term: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents ascending, their impacts, their positions in the list by falling impact)."""
        if term not in self.made:
            a, b = self.spans[term]
            docs, tf = self.docs[a:b].astype(np.int64), self.counts[a:b].astype(np.int64)
            impacts = (1_000_000_000 * tf) // (1000 * tf + 12 * self.m[docs])
            place = np.empty(b - a, np.int64)
            place[np.argsort(-impacts, kind="stable")] = np.arange(b - a)
            self.made[term] = docs, impacts, place
        return self.made[term]


def best_positions(lists: Lists, query: dict[bytes, int], order: np.ndarray, k: int, *, first_rows: int = 32) -> tuple[list[tuple[int, int]], int]:
    """((score, document) of the k best above 0, rows read from the lists). ``query``: weight of each term; ``order``: rank of each document among equal scores."""
    held = [(w, *lists.of(t)) for t, w in query.items() if w > 0 and t in lists.spans]
    if not held:
        return [], 0
    sizes = np.array([len(h[1]) for h in held])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    weights = np.array([h[0] for h in held], np.int64)
    keys = np.concatenate([h[1] + j * lists.n for j, h in enumerate(held)])  # of direct access
    gains = np.concatenate([h[0] * h[2] for h in held])
    place = np.concatenate([h[3] + starts[j] for j, h in enumerate(held)])
    listed, falling = np.empty(starts[-1], np.int64), np.empty(starts[-1], np.int64)  # of sorted access
    listed[place], falling[place] = np.concatenate([h[1] for h in held]), gains
    shown, met = np.zeros(starts[-1], bool), np.zeros(lists.n, bool)
    best = starts[:-1].copy()  # the first position not seen, right after the best one
    top_scores, top_docs = np.zeros(0, np.int64), np.zeros(0, np.int64)
    depth, rows, read = 0, first_rows, 0
    base = np.arange(len(weights))[:, None] * lists.n
    while True:
        met_now = np.concatenate([listed[a + depth:min(a + depth + rows, b)] for a, b in zip(starts[:-1], starts[1:], strict=True) if a + depth < b])
        read += len(met_now)
        new = np.unique(met_now[~met[met_now]])
        met[new] = True
        # Direct access, a bounded number of (list, document) pairs at a time.
        step = max(1, (1 << 20) // len(weights))
        for at in range(0, len(new), step):
            some = new[at:at + step]
            wanted = base + some[None, :]
            found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            there = keys[found] == wanted
            shown[place[found[there]]] = True
            top_scores = np.concatenate([top_scores, np.where(there, gains[found], 0).sum(axis=0)])
            top_docs = np.concatenate([top_docs, some])
            ahead = np.lexsort((order[top_docs], -top_scores))[:k]
            top_scores, top_docs = top_scores[ahead], top_docs[ahead]
        bound = 0
        for j, end in enumerate(starts[1:]):
            if best[j] < end:
                rest = shown[best[j]:end]
                hop = int(rest.argmin())
                best[j] = end if rest[hop] else best[j] + hop
            if best[j] < end:
                bound += int(falling[best[j]])
        depth += rows
        rows *= 2
        if depth >= sizes.max() or (len(top_scores) >= k and bound < top_scores[-1]):
            return [(int(s), int(d)) for s, d in zip(top_scores, top_docs, strict=True) if s > 0], read


def weight(total_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * total_docs + 2) / (2 * df + 1)))


def _pass(stored: DataFrame, queries: list[tuple[int, bytes]], total_docs: int, total_terms: int, k: int) -> DataFrame:
    """(number of the query, key, score): each shard's k best of each query of a block."""
    spark = stored.sparkSession
    wanted = [(q, Counter(terms_of(text))) for q, text in queries]
    vocabulary = sorted({t for _, terms in wanted for t in terms})
    if not vocabulary:
        return spark.createDataFrame([], T.StructType([T.StructField("query", T.LongType()), T.StructField("key", stored.schema["keys"].dataType.elementType), T.StructField("score", T.LongType())]))
    known = F.broadcast(spark.createDataFrame([(bytearray(t),) for t in vocabulary], "term binary"))  # at most the block's bytes
    held = stored.select(F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("held").alias("held")))).join(known, "term").groupBy("term").agg(F.sum("held").alias("df"))
    weights = {bytes(r.term): weight(total_docs, r.df) for r in held.collect()}
    plans = [(q, {t: n * weights[t] for t, n in terms.items() if t in weights}) for q, terms in wanted]
    shared = spark.sparkContext.broadcast((vocabulary, plans))
    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("key", stored.schema["keys"].dataType.elementType), T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, plans = shared.value
        value_set = pa.array(vocabulary, pa.binary())
        for batch in batches:
            for at in range(batch.num_rows):
                one = lambda c: batch.column(c)[at]  # noqa: B023, E731
                keys, terms = one("keys").values, one("terms").values
                ends = np.concatenate([[0], np.cumsum(np.asarray(one("held").values))]).astype(np.int64)
                here = np.flatnonzero(np.asarray(pc.is_in(terms, value_set=value_set)))
                spans = {terms[int(t)].as_py(): (int(ends[t]), int(ends[t + 1])) for t in here}
                lengths = np.frombuffer(one("lengths").as_py(), np.int64)
                lists = Lists(lengths, *(np.frombuffer(one(c).as_py(), np.int32) for c in ("docs", "counts")), spans, total_docs, total_terms)
                order = np.empty(len(keys), np.int64)
                order[np.asarray(pc.sort_indices(keys, null_placement="at_end"))] = np.arange(len(keys))
                out_query, out_doc, out_score = [], [], []
                for q, plan in plans:
                    found, _ = best_positions(lists, plan, order, k)
                    out_query += [q] * len(found)
                    out_score += [s for s, _ in found]
                    out_doc += [d for _, d in found]
                yield pa.RecordBatch.from_arrays([pa.array(out_query, pa.int64()), keys.take(pa.array(out_doc, pa.int64())), pa.array(out_score, pa.int64())], names=schema.names)

    return stored.select("keys", "lengths", "docs", "counts", "terms", "held").mapInArrow(run, schema)


def search(stored: DataFrame, queries: DataFrame, *, key: str = "item_id", text_col: str = "text", k: int = 20, into_key: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` best documents of each query: its key, rank from 1, the document's key (``into_key``) and score."""
    spark = stored.sparkSession
    totals = stored.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    asked = queries.select(F.col(f"`{key}`").alias("asked"), F.col(f"`{text_col}`").cast("binary").alias("utf8")).where("utf8 is not null").distinct()
    size = asked.agg(F.sum(F.octet_length("utf8") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    # The number of a query is a column of a stored table, so that it stays the same in every pass.
    numbered = written(spark, asked.select(F.monotonically_increasing_id().alias("query"), "asked", "utf8", F.pmod(F.xxhash64("asked", "utf8"), F.lit(blocks)).alias("block")), "queries")
    found = None
    for b in range(blocks):
        rows = [(r.query, bytes(r.utf8)) for r in numbered.where(F.col("block") == b).select("query", "utf8").collect()]
        made = _pass(stored, rows, *totals, k)
        found = made if found is None else found.unionByName(made)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last()))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    out = best.join(numbered.select("query", "asked"), "query")
    return out.select(F.col("asked").alias(key), "rank", F.col("key").alias(into_key), "score")
