"""Removal of repeated byte strings by suffix sorting: shallow multikey sorting, then blind tries.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller doc_id. Strings are
judged on the input; matches never cross documents.

Sorting the suffixes of all documents in one place is not possible, so equal strings are first brought together: every string
of ``length`` bytes is assigned to its anchor, the leftmost of its ``gram``-byte parts with the smallest hash, which equal
strings share. A document's strings of one anchor are a run of neighbouring starts, and lie in one context of at
most ``2 * length - gram`` bytes. Rows (anchor hash, context hash, hashes of both sides, doc_id, place) are shuffled by anchor
hash, many in one packed value. There
 - contexts of an anchor that only one document holds are dropped,
 - of equal contexts, all but those of the smallest doc_id are covered whole,
 - a string reaches half of what is left of ``length`` over its anchor to the left, or else to the right; contexts that share
   neither such side with one of another document have no string in common with it and are dropped,
 - the contexts that are left are cut from the texts, shuffled by anchor hash, and their
   strings are sorted: multikey sorting on eight bytes at a time to the depth ``shallow``, then a blind trie per group
   of equal prefixes. Equal strings lie together, and all but those of the smallest doc_id are covered.
Covered runs go back to their documents. Texts are dealt by document once, for the cutting and for this.

Null or empty texts have no bytes. Rows with a null doc_id are neither earlier nor later than others: they stay whole and
remove nothing. Repeated rows of a doc_id do not repeat each other; rows of one doc_id with different texts are one
document whose covered places are united. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffles_dropped, slices, small_batches, written

ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
WHOLE, ASK = 0, 1
#: Bytes of the columns of a packed row: anchor hash beside its part, context hash, sides, place, doc_id.
WIDTHS = (4, 7, 2, 2, 5, 8)

RESULT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
                       T.StructField("kept", T.BinaryType())])


def words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one big-endian number."""
    x = data.astype(np.uint64)
    for step, shift in ((1, 8), (2, 16), (4, 32)):
        x = x[:-step] << np.uint64(shift) | x[step:]
    return x


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` (8 or more) bytes from each position."""
    x = words8(data)
    n = len(data) - gram + 1
    h = np.zeros(n, np.uint64)
    for at in sorted({*range(0, gram - 7, 8), gram - 8}):
        h = (h ^ x[at:at + n]) * ODD[0]
        h ^= h >> np.uint64(29)
    h *= ODD[2]
    return h ^ h >> np.uint64(32)


def leftmost_least(h: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest value of each run of ``width`` values."""
    at, held = np.arange(len(h)), 1
    while held < width:
        step = min(held, width - held)
        a, b = at[:-step], at[step:]
        at = np.where(h[a] <= h[b], a, b)
        held += step
    return at


def sides(h: np.ndarray, anchor: np.ndarray, start: np.ndarray, count: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (1 to 65535) of the bytes left and right of each anchor that its strings have if they reach so far; 0 where none does.

    ``start`` and ``count`` are the strings of the anchor. Each of them has the left side or, if not, the right one.
    """
    left = (length - gram + 1) // 2
    right = length - gram - left + 1

    def side(has: np.ndarray, offsets: list[int]) -> np.ndarray:
        x = np.zeros(int(has.sum()), np.uint64)
        for at in offsets:
            x = (x ^ h[anchor[has] + at]) * ODD[1]
        out = np.zeros(len(has), np.uint16)
        out[has] = (x >> np.uint64(32)) % np.uint64(65535) + np.uint64(1)
        return out

    return side(anchor - start >= left, [-k for k in range(left, 0, -gram)]), side(anchor - (start + count - 1) < left, list(range(right, 0, -gram)))


def anchored(texts: list[bytes | None], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text index, first start, number of starts, anchor hash, context hash, left side, right side) of every anchor of the texts."""
    sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
    data = b"".join(t for t in texts if t)
    if len(data) < length:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint16, np.uint16))
    h = gram_hashes(np.frombuffer(data, np.uint8), gram)
    anchor = leftmost_least(h, length - gram + 1)
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)[:len(anchor)]
    start = np.flatnonzero(np.arange(len(anchor)) + length <= (begin + sizes)[owner])
    anchor, owner = anchor[start], owner[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    lo = start[first]
    context = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(lo.tolist(), (lo + count - 1 + length).tolist(), strict=True)), np.uint64, len(lo))
    return owner[first], lo - begin[owner[first]], count, h[anchor[first]], context >> np.uint64(8), *sides(h, anchor[first], lo, count, length, gram)


def packed(part: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, pa.Array]:
    """(parts, their rows): the lowest ``WIDTHS`` bytes of the columns of each part's rows, all first bytes, all second bytes and so on."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(part)))
    wide = sum(WIDTHS)
    at = np.arange(len(part)) + np.repeat(first * (wide - 1), size)
    step = np.repeat(size, size)
    out = np.empty(len(part) * wide, np.uint8)
    for column, width in zip(columns, WIDTHS, strict=True):
        octets = np.ascontiguousarray(column[order]).view(np.uint8).reshape(len(part), column.dtype.itemsize)
        for k in range(width):
            out[at] = octets[:, k]
            at += step
    offsets = (np.append(first, len(part)) * wide).astype(np.int64)
    return part[first], pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(out)]).cast(pa.binary())


def unpacked(values: list[bytes]) -> list[np.ndarray]:
    """The columns of packed rows."""
    octets = np.concatenate([np.frombuffer(v, np.uint8).reshape(sum(WIDTHS), -1) for v in values], axis=1)
    columns, at = [], 0
    for width in WIDTHS:
        wide = np.zeros((octets.shape[1], 2 if width == 2 else 8), np.uint8)
        wide[:, :width] = octets[at:at + width].T
        columns.append(wide.view(np.uint16 if width == 2 else np.int64).ravel())
        at += width
    return columns


def anchors(docs: DataFrame, length: int, gram: int, parts: int) -> DataFrame:
    """(part, rows): packed rows of anchor hash, context hash, left and right side, place (first start * 64 + number of starts) and doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, size in slices(b.column(1), 4 << 20):
                owner, lo, count, h, c, left, right = anchored(b.column(1).slice(at, size).to_pylist(), length, gram)
                mixed = h * ODD[2]  # the hash itself is a minimum, its high bits are mostly zeros
                part = ((mixed >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int32)
                doc = b.column(0).slice(at, size).to_numpy(zero_copy_only=False)[owner]
                numbers, rows = packed(part, [mixed >> np.uint64(8), c, left, right, lo * 64 + count, doc])
                yield pa.RecordBatch.from_arrays([pa.array(numbers), rows], names=["part", "rows"])

    return docs.mapInArrow(run, "part int, rows binary")


def shared(rows: DataFrame) -> DataFrame:
    """(kind, h, doc, at): WHOLE for contexts that a smaller doc_id has too, ASK (with the anchor's hash) for those to compare string by string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for b in batches:
            for number, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if number != part and held:
                    yield settled(part, held)
                    held = []
                part = number
                held.append(value)
        if held:
            yield settled(part, held)

    def settled(part: int, held: list[bytes]) -> pa.RecordBatch:
        h, c, left, right, at, doc = unpacked(held)
        order = np.argsort(h)
        again = h[order][1:] == h[order][:-1]
        order = order[np.append(again, False) | np.append(False, again)]  # an anchor of one row is of no use
        order = order[np.lexsort((doc[order], c[order], h[order]))]
        h, c, left, right, at, doc = (x[order] for x in (h, c, left, right, at, doc))
        if not len(h):
            return made(part, h, at, doc, np.zeros(0, bool))
        new_h = np.append(True, h[1:] != h[:-1])
        new_c = new_h | np.append(True, c[1:] != c[:-1])
        of_h, of_c = np.cumsum(new_h) - 1, np.cumsum(new_c) - 1
        first_h, first_c = np.flatnonzero(new_h), np.flatnonzero(new_c)
        whole = doc > doc[first_c][of_c]
        contexts = np.bincount(of_h[first_c])
        many_docs = np.minimum.reduceat(doc, first_h) < np.maximum.reduceat(doc, first_h)
        able = np.flatnonzero(~whole & (contexts > 1)[of_h] & many_docs[of_h])
        ask = np.zeros(len(h), bool)
        for side in (left, right):
            own = able[side[able] > 0]
            key = of_h[own] << 16 | side[own]
            by = np.argsort(key)
            key, own = key[by], own[by]
            if len(own):
                new = np.append(True, key[1:] != key[:-1])
                first = np.flatnonzero(new)
                ask[own] |= (np.minimum.reduceat(doc[own], first) < np.maximum.reduceat(doc[own], first))[np.cumsum(new) - 1]
        keep = np.flatnonzero(whole | ask)
        keep = keep[np.argsort(doc[keep])]
        return made(part, h[keep], at[keep], doc[keep], ask[keep])

    def made(part: int, h: np.ndarray, at: np.ndarray, doc: np.ndarray, ask: np.ndarray) -> pa.RecordBatch:
        kind = np.where(ask, ASK, WHOLE).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (kind, np.where(ask, h | part << 32, 0), doc, at)], names=["kind", "h", "doc", "at"])

    return rows.repartition(F.col("part")).sortWithinPartitions("part").mapInArrow(run, "kind int, h long, doc long, at long")


class BlindTrie:
    """Strings as numbers of ``size`` bytes; a search compares branching bytes only, then once with the string it ends at."""

    def __init__(self, size: int):
        self.size, self.root = size, None

    def insert(self, value: int, who: int) -> None:
        """Nodes are [depth, children by byte]; leaves are [value, holders] with depth ``size`` implied."""
        size = self.size
        if self.root is None:
            self.root = (size, value, [who])
            return
        node = self.root
        while node[0] < size:
            node = node[1].get(value >> 8 * (size - 1 - node[0]) & 255) or next(iter(node[1].values()))
        differ = node[1] ^ value
        if not differ:
            node[2].append(who)
            return
        depth = size - 1 - (differ.bit_length() - 1) // 8
        shift = 8 * (size - 1 - depth)
        leaf, parent, at, above = (size, value, [who]), None, self.root, 0
        while at[0] < depth:
            parent, above = at, value >> 8 * (size - 1 - at[0]) & 255
            at = at[1][above]
        if at[0] == depth:
            at[1][value >> shift & 255] = leaf
            return
        joint = (depth, {node[1] >> shift & 255: at, value >> shift & 255: leaf})
        if parent is None:
            self.root = joint
        else:
            parent[1][above] = joint

    def groups(self) -> Iterator[list[int]]:
        """Holders of each string, strings in order."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] == self.size:
                yield node[2]
            else:
                stack += [node[1][k] for k in sorted(node[1], reverse=True)]


def sorted_strings(data: np.ndarray, starts: np.ndarray, length: int, shallow: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """(order, string number) of the ``length``-byte strings from ``starts``: sorted, equal strings with one number.

    Multikey sorting takes eight bytes at a time as long as a group has more than one string; from depth ``shallow`` on a blind
    trie orders each group that is left.
    """
    order = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64)
    x = words8(np.concatenate([data, np.zeros(8, np.uint8)]))
    depth = 0
    while depth < shallow and depth + 8 <= length:
        word = x[starts[order] + depth]
        alone = np.ones(len(order), bool)
        alone[1:] &= group[1:] != group[:-1]
        alone[:-1] &= group[:-1] != group[1:]
        part = np.flatnonzero(~alone)
        moved = part[np.lexsort((word[part], group[part]))]
        order[part], word[part] = order[moved], word[moved]
        new = np.ones(len(order), bool)
        new[1:] = (group[1:] != group[:-1]) | (word[1:] != word[:-1])
        group = np.cumsum(new) - 1
        depth += 8
    bounds = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    ends = np.append(bounds[1:], len(group)).astype(np.int64)
    number = np.zeros(len(order), np.int64)
    deep = ends - bounds > 1
    new = np.ones(len(order), bool)
    raw = data.tobytes()
    for a, b in zip(bounds[deep].tolist(), ends[deep].tolist(), strict=True):
        trie = BlindTrie(length - depth)
        for who in order[a:b].tolist():
            at = int(starts[who])
            trie.insert(int.from_bytes(raw[at + depth:at + length], "big"), who)
        k = a
        for holders in trie.groups():
            order[k:k + len(holders)] = holders
            new[k + 1:k + len(holders)] = False
            k += len(holders)
    number = np.cumsum(new) - 1
    return order, number


def compared(rows: DataFrame, length: int, flush: int = 200_000) -> DataFrame:
    """(doc, at): covered runs of starts, from rows (h, doc, at, context) with the rows of an anchor in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= flush:
                table = pa.Table.from_batches(held).combine_chunks()
                h = table["h"].to_numpy()
                cut = int(np.searchsorted(h, h[-1], "left"))  # rows are sorted by h: the last anchor may go on
                if cut:
                    yield covered(table.slice(0, cut))
                    held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield covered(pa.Table.from_batches(held))

    def covered(table: pa.Table) -> pa.RecordBatch:
        doc, at = table["doc"].to_numpy(), table["at"].to_numpy()
        lo, count = at >> 6, at & 63
        contexts = table["context"].to_pylist()
        data = np.frombuffer(b"".join(contexts), np.uint8)
        begin = np.cumsum([0, *map(len, contexts)])[:-1]
        row = np.repeat(np.arange(len(doc)), count)
        within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        order, number = sorted_strings(data, begin[row] + within, length)
        first = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        least = np.minimum.reduceat(doc[row[order]], first)
        hit = np.zeros(len(row), bool)
        hit[order] = doc[row[order]] > least[number]
        # Runs of covered starts of one row.
        edge = hit.copy()
        edge[1:] &= ~(hit[:-1] & (row[1:] == row[:-1]))
        start = np.flatnonzero(edge)
        run_of = np.cumsum(edge) - 1
        size = np.bincount(run_of[hit], minlength=len(start)) if len(start) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(doc[row[start]]), pa.array((lo[row[start]] + within[start]) * 64 + size)], names=["doc", "at"])

    return rows.mapInArrow(run, "doc long, at long")


def contexts(docs: DataFrame, length: int) -> DataFrame:
    """(h, doc, at, context) of the asked places (doc, text, asked: array of h, at, or null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, text, asked in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                for x in asked or ():
                    lo, count = x["at"] >> 6, x["at"] & 63
                    context = text[lo:lo + count - 1 + length]
                    if len(context) == count - 1 + length:  # else it belongs to another text of the doc_id
                        out.append((x["h"], doc, x["at"], context))
                if len(out) >= 50_000:
                    yield made(out)
                    out = []
            yield made(out)

    def made(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["h", "doc", "at", "context"])

    return docs.mapInArrow(run, "h long, doc long, at long, context binary")


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text_col: str = "text", length: int = 50, gram: int = 16) -> DataFrame:
    """(doc_id, n_bytes, removed, kept) for every row: covered byte runs, and the bytes that are left."""
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    # Eight parts of anchors a shuffle partition: a task holds one at a time.
    rows = anchors(source.where("doc is not null"), length, gram, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    with shuffles_dropped(spark):
        found = written(spark, shared(rows), "shared")
    # Both joins read one exchange of the texts. Its key is never null: else the inner join alone would leave out rows without it, and deal the rest anew.
    dealt = source.withColumn("key", F.coalesce("doc", F.xxhash64("text")))
    asked = found.where(F.col("kind") == ASK).groupBy(F.col("doc").alias("key")).agg(F.collect_list(F.struct("h", "at")).alias("asked"))
    cut = contexts(dealt.join(asked, "key").select("doc", "text", of_doc("asked")), length)
    partial = compared(cut.repartition(F.col("h")).sortWithinPartitions("h", "doc"), length)
    covered = found.where(F.col("kind") == WHOLE).select("doc", "at").union(partial).groupBy(F.col("doc").alias("key")).agg(F.collect_list("at").alias("runs"))
    rows = dealt.join(covered, "key", "left").select("doc", "text", of_doc("runs"))
    return removed_from(rows, length).select(F.col("doc").alias("doc_id"), "r.n_bytes", "r.removed", "r.kept")


def of_doc(column: str) -> F.Column:
    """``column`` of rows with a doc_id; a key made for a row without one may be a doc_id too."""
    return F.when(F.col("doc").isNotNull(), F.col(column)).alias(column)


def removed_from(rows: DataFrame, length: int) -> DataFrame:
    """``rows`` (doc, text, runs) with struct ``r``."""
    schema = T.StructType([T.StructField("doc", T.LongType()), T.StructField("r", RESULT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        for b in batches:
            for at, size in slices(b.column(1), 4 << 20):
                part = b.slice(at, size)
                n, removed, kept = [], [], []
                for text, runs in zip(part.column(1).to_pylist(), part.column(2), strict=True):
                    text = text or b""
                    gone = spans(np.asarray(runs.values), length, len(text)) if runs.is_valid and text else []
                    n.append(len(text))
                    removed.append([{"start": s, "end": e} for s, e in gone])
                    kept.append(b"".join(text[e:s] for e, s in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(text)], strict=True)))
                struct = pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(removed, pa.list_(span)), pa.array(kept, pa.binary())], names=RESULT.names)
                yield pa.RecordBatch.from_arrays([part.column(0), struct], names=["doc", "r"])

    return rows.select("doc", "text", "runs").mapInArrow(run, schema)


def spans(runs: np.ndarray, length: int, size: int) -> list[tuple[int, int]]:
    """Maximal covered byte runs from packed runs of starts."""
    start = np.sort(runs)
    lo = start >> 6
    end = np.minimum(np.maximum.accumulate(lo + (start & 63) - 1 + length), size)
    keep = lo < size
    lo, end = lo[keep], end[keep]
    new = np.flatnonzero(np.append(True, lo[1:] > end[:-1])) if len(lo) else np.zeros(0, np.int64)
    return list(zip(lo[new].tolist(), end[np.append(new[1:], len(lo)) - 1].tolist(), strict=True)) if len(lo) else []


