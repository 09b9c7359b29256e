"""Sparse document-term matrix: words encoded by a dictionary over all documents, rows in compressed (CSR) shards.

A shard holds the rows of about ``shard_bytes`` bytes of text that one task read one after another (a longer text is a shard of its
own). The first pass codes a shard's words by the shard's own vocabulary and stores it. Spark then brings the equal words of all
vocabularies together, numbers them (the dictionary), and takes the numbers back to each shard, whose codes become global ids. So what is
shuffled by word is one row per word and shard, never one per occurrence, and no vocabulary has to fit in one place but a shard's.

Null texts count as empty: their rows of the matrix are empty. Repeated rows, null keys and all other columns are kept
as they are. An empty table has no shards and an empty dictionary.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_name, small_batches, written

SHARD_BYTES = 16 << 20
#: Rows of a shard at most, for tables of very short texts.
SHARD_ROWS = 50_000


class Shard:
    """Rows coded by a vocabulary of their own."""

    def __init__(self) -> None:
        self.codes: defaultdict[bytes, int] = defaultdict()
        self.codes.default_factory = self.codes.__len__  # a new word gets the next code
        self.words: list[np.ndarray] = []
        self.size = 0

    def add(self, words: list[bytes]) -> None:
        self.words.append(np.fromiter(map(self.codes.__getitem__, words), np.int32, len(words)))

    def csr(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start of each row, columns of its entries in ascending order, their counts)."""
        rows = np.repeat(np.arange(len(self.words)), [len(w) for w in self.words])
        wide = max(1, len(self.codes))
        cells, counts = np.unique(rows * wide + np.concatenate(self.words) if self.words else np.zeros(0, np.int64), return_counts=True)
        starts = np.searchsorted(cells, np.arange(len(self.words) + 1) * wide)
        return starts.astype(np.int32), cells % wide, counts


def _blob(values: np.ndarray) -> pa.Array:
    return pa.array([values.tobytes()], pa.binary())


def _shards(df: DataFrame, text_col: str, words: Callable[[bytes], list[bytes]], derive: Callable[[bytes], tuple], derived: T.StructType, shard_bytes: int, shard_rows: int) -> DataFrame:
    """(shard, rows: the kept columns and the derived ones, vocabulary, starts, codes, counts), a row per shard."""
    small_batches(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name != text_col]
    schema = T.StructType([
        T.StructField("shard", T.LongType()), T.StructField("rows", T.ArrayType(T.StructType([*kept, *derived.fields]))),
        T.StructField("vocabulary", T.ArrayType(T.BinaryType())), *[T.StructField(c, T.BinaryType()) for c in ("starts", "codes", "counts")],
    ])
    source = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId() << 32, 0
        shard, held, made = Shard(), [], []

        def flush() -> pa.RecordBatch:
            nonlocal number, shard, held, made
            structs = pa.concat_arrays([pa.StructArray.from_arrays([*b.columns, *[pa.array(c) for c in zip(*m, strict=True)]], names=[*b.schema.names, *derived.names]) for b, m in zip(held, made, strict=True)])
            vocabulary = pa.array(list(shard.codes), pa.binary())
            starts, codes, counts = shard.csr()
            lists = [pa.ListArray.from_arrays([0, len(x)], x) for x in (structs, vocabulary)]
            out = pa.RecordBatch.from_arrays([pa.array([part + number], pa.int64()), *lists, _blob(starts), _packed(codes), _packed(counts)], names=schema.names)
            number, shard, held, made = number + 1, Shard(), [], []
            return out

        for batch in batches:
            plain = batch.select(source)
            since, values = 0, []
            for k, text in enumerate(batch.column(batch.num_columns - 1)):
                text = text.as_py() or b""
                if shard.words and (shard.size + len(text) > shard_bytes or len(shard.words) >= shard_rows):
                    if values:
                        held.append(plain.slice(since, k - since))
                        made.append(values)
                    yield flush()
                    since, values = k, []
                shard.add(words(text))
                shard.size += len(text)
                values.append(derive(text))
            if values:
                held.append(plain.slice(since))
                made.append(values)
        if shard.words:
            yield flush()

    rows = df.select(*[F.col(f"`{c}`") for c in source], F.col(f"`{text_col}`").cast("binary").alias(fresh_name(df, "_utf8")))
    return rows.mapInArrow(run, schema)


def _numbered(coded: DataFrame) -> DataFrame:
    """(shard, code, id, word where it is the id's first row) of (shard, code, word): rows of a word lie together in one sorted partition, and get its number there."""
    schema = T.StructType([coded.schema["shard"], coded.schema["code"], T.StructField("id", T.LongType()), T.StructField("word", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last = (TaskContext.get().partitionId() << 33) - 1, None
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column("word")
            first = np.ones(len(words), bool)
            first[1:] = np.asarray(pc.not_equal(words[1:], words[:-1]))
            first[0] = words[0].as_py() != last
            ids = number + np.cumsum(first)
            number, last = int(ids[-1]), words[-1].as_py()
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("code"), pa.array(ids), pc.if_else(pa.array(first), words, pa.scalar(None, words.type))], names=schema.names)

    return coded.repartition("word").sortWithinPartitions("word").select("shard", "code", "word").mapInArrow(run, schema)


def _packed(values: np.ndarray) -> pa.Array:
    """Non-negative numbers as compressed differences, after a byte that tells their width."""
    narrow = values.astype(np.min_scalar_type(int(values.max(initial=0))))
    steps = np.diff(narrow, prepend=narrow.dtype.type(0))
    return pa.array([bytes([narrow.itemsize]) + pa.compress(steps.tobytes(), codec="zstd", asbytes=True)], pa.binary())


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    steps = np.frombuffer(pa.decompress(blob[1:], decompressed_size=n * blob[0], codec="zstd", asbytes=True), f"<u{blob[0]}")
    return np.cumsum(steps, dtype=steps.dtype)


class Matrix:
    """A document-term matrix over the rows of ``df``, in shards.

    ``rows`` of a shard has the other columns of ``df`` and the values that ``derive`` makes of a text (their types in ``derived``; its
    number of bytes if not given).
    """

    def __init__(self, df: DataFrame, text_col: str, words: Callable[[bytes], list[bytes]] = bytes.split, *, derive: Callable[[bytes], tuple] = lambda text: (len(text),),
                 derived: T.StructType | None = None, keep_words: bool = True, shard_bytes: int = SHARD_BYTES, shard_rows: int = SHARD_ROWS) -> None:
        derived = derived or T.StructType([T.StructField(fresh_name(df, "n_bytes"), T.LongType())])
        self._local = written(df.sparkSession, _shards(df, text_col, words, derive, derived, shard_bytes, shard_rows), "shards", rows_per_file=2)
        self._numbered = _numbered(self._local.select("shard", F.posexplode("vocabulary").alias("code", "word")))
        #: (word as bytes, id) of all words, ids distinct but not without gaps; stored, or None without ``keep_words``.
        self.dictionary = None
        if keep_words:
            self._numbered = written(df.sparkSession, self._numbered, "dictionary")
            self.dictionary = self._numbered.where("word is not null").select("word", "id")

    def _finished(self, finish: Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], pa.Table], schema: T.StructType) -> DataFrame:
        """Each shard with its global ids through ``finish`` (shard, starts, ids, counts), in one task."""

        def translated(known: pa.Table, shard: pa.Table) -> pa.Table:
            table = np.empty(known.num_rows, np.int64)
            table[np.asarray(known.column("code"))] = np.asarray(known.column("id"))
            starts = np.frombuffer(shard.column("starts")[0].as_py(), np.int32).astype(np.int64)
            codes, counts = (_unpacked(shard.column(c)[0].as_py(), int(starts[-1])) for c in ("codes", "counts"))
            return finish(shard, starts, table[codes], counts)

        blobs = self._local.select("shard", "rows", "starts", "codes", "counts")
        return self._numbered.select("shard", "code", "id").groupBy("shard").cogroup(blobs.groupBy("shard")).applyInArrow(translated, schema)

    def shards(self) -> DataFrame:
        """A row per shard: ``rows``, and as little-endian bytes ``starts`` (int64, one more than rows), ``ids`` (int64, the words of each row
        in no certain order) and ``counts`` (int64)."""
        schema = T.StructType([self._local.schema["shard"], self._local.schema["rows"], *[T.StructField(c, T.BinaryType()) for c in ("starts", "ids", "counts")]])
        return self._finished(lambda shard, *csr: pa.table([shard.column("shard"), shard.column("rows"), *[_blob(x.astype(np.int64)) for x in csr]], names=schema.names), schema)

    def row_statistics(self, *, total: str = "n_words", distinct: str = "n_distinct") -> DataFrame:
        """A row per row of the matrix: its columns, the sum of its counts and the number of its entries."""
        row = self._local.schema["rows"].dataType.elementType
        schema = T.StructType([*row.fields, T.StructField(total, T.LongType()), T.StructField(distinct, T.LongType())])

        def finish(shard: pa.Table, starts: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> pa.Table:
            sums = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[starts]
            rows = shard.column("rows").combine_chunks().flatten()
            return pa.table([*rows.flatten(), pa.array(np.diff(sums)), pa.array(np.diff(starts))], names=schema.names)

        return self._finished(finish, schema)
