"""Near duplicates by n-gram Jaccard similarity, joined through a count-vector R-tree.

A document's set holds its distinct ``n``-word shingles (as 64-bit hashes). Equal sets are one class. Two classes link if
``100 * intersection >= similarity * union``; the result is every row's set size and the smallest doc_id of its component.

1. Shared shingles. The shingles of all classes are dealt by hash, packed, and counted: those that only one class holds go.
   A class links only if at least ``similarity`` % of its set is left, which few other classes reach; an intersection
   is one of shared shingles, so only these are kept from here on.
2. Groups. In an order of all shingles that is the same for all classes, rarest first, two linked sets share a shingle among
   the first ``size - ceil(similarity * size) + 1`` of each (prefix principle). Classes that share one are put in one
   group, by components over one star per shingle. Lines and passages that many documents hold come last in the order, so
   they seldom gather unrelated documents.
3. R-tree. Within a group each set hashes its shingles into cells and is indexed as the point of its cell counts. The
   sum of coordinate minima of two points bounds their intersection from above, and so does the sum of minima
   of a point and the upper corner of a tree node's box; nodes and points under the needed intersection are skipped.
   Surviving pairs are verified on the sets. Pairs of one component need no verification, as only components are asked.
   A group of more than ``tile`` classes is cut into size bands of ratio ``similarity`` (linked sets lie in the same or
   neighbouring bands) and tiles of about ``tile`` classes; each pair of tiles is a task of its own.
4. Components over the links.

Hashes are 64 bits for classes; shingles have 32 bits beside the number of their part (``parts``, as many as the session's
shuffle partitions, at least 64), so two different shingles of a pair of documents agree by chance with a probability under 1e-11.

Null, empty or blank texts have the empty set and link with nothing. Rows with a null doc_id have no component (null) and
link with nothing. Repeated rows count once and each gets the result; rows of one doc_id with different texts are judged
row by row. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, small_batches, written
from .components import components

# Fixed value of the contract, on UTF-8 bytes after lower-casing A-Z.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
REMEMBER = 200_000
CLASSES = 1 << 14  # of a batch that a part's count returns


class Shingler:
    """Sets of hashed shingles; word hashes are remembered."""

    def __init__(self, n: int = 5):
        self.n, self.known = n, {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBER:
            known.clear()
        out = list(map(known.get, words))
        if None in out:
            for k, w in enumerate(words):
                if out[k] is None:
                    out[k] = xxhash.xxh3_64_intdigest(w)
                    if len(w) <= 32:
                        known[w] = out[k]
        return np.array(out, np.uint64)

    def set_of(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct shingle hashes."""
        words = WORD.findall(text.lower()) if text else []
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.n:
            return np.array([xxhash.xxh3_64_intdigest(b"\x00".join(words), seed=len(words))], np.uint64)
        w = self.hashes(words)
        m = len(w) - self.n + 1
        h = np.zeros(m, np.uint64)
        for k in range(self.n):
            part = w[k:k + m] * ODD[k % len(ODD)]
            h = (h ^ (part ^ part >> np.uint64(29))) * ODD[(k + 1) % len(ODD)]
            h ^= h >> np.uint64(32)
        return np.unique(h)


def class_of(shingles: np.ndarray) -> int:
    """64-bit identity of a set, as a signed integer."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=len(shingles)))))


def needed(x, y, similarity: int):
    """Least intersection of sets of sizes x and y that link."""
    return -(-similarity * (x + y) // (100 + similarity))


def heads_of(docs: DataFrame, n: int) -> DataFrame:
    """(id, n, h): doc_id, set size and class of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for b in batches:
            for at, length in slices(b.column(1), 4 << 20):
                sets = [shingler.set_of(t) for t in b.column(1).slice(at, length).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, length), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.int64())], names=["id", "n", "h"])

    return docs.mapInArrow(run, "id long, n long, h long")


def dealt(docs: DataFrame, n: int, parts: int) -> DataFrame:
    """(part, h, n, shingles): packed per part, the classes, set sizes, numbers of shingles there, and low 32 hash bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for b in batches:
            for at, length in slices(b.column(0), 4 << 20):
                sets = [s for t in b.column(0).slice(at, length).to_pylist() if len(s := shingler.set_of(t))]
                if not sets:
                    continue
                sizes = np.array([len(s) for s in sets], np.int64)
                h = np.array([class_of(s) for s in sets], np.int64)
                _, first = np.unique(h, return_index=True)  # equal sets of a batch go once
                sets, sizes, h = [sets[k] for k in first], sizes[first], h[first]
                flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
                part = ((flat >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")  # within a part, classes stay in order
                flat, owner, part = flat[order].astype(np.uint32), owner[order], part[order]
                edge = np.searchsorted(part, np.arange(parts + 1))
                rows = []
                for k in range(parts):
                    who, held = np.unique(owner[edge[k]:edge[k + 1]], return_counts=True)
                    rows.append((k, h[who].tobytes(), sizes[who].astype("<u4").tobytes() + held.astype("<u4").tobytes(), flat[edge[k]:edge[k + 1]].tobytes()))
                kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["part", "h", "n", "shingles"])

    return docs.select("text").mapInArrow(run, "part int, h binary, n binary, shingles binary")


def shared_shingles(packed: DataFrame) -> DataFrame:
    """(h, n, part, shingles, held): per class and part, the shingles that other classes hold too, and by how many (log)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                if row[0] != part and held:
                    yield from counted(part, held)
                    held = []
                part = row[0]
                held.append(row[1:])
        if held:
            yield from counted(part, held)

    def counted(part: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate([np.frombuffer(r[0], np.int64) for r in rows])
        sizes = np.concatenate([np.frombuffer(r[1], "<u4", len(r[0]) // 8) for r in rows])
        count = np.concatenate([np.frombuffer(r[1], "<u4", -1, len(r[0]) // 2) for r in rows])
        flat = np.concatenate([np.frombuffer(r[2], np.uint32) for r in rows])
        rows.clear()  # else the part lies here twice while it is sorted
        # Equal classes of several batches count once.
        _, first = np.unique(h, return_index=True)
        once = np.zeros(len(h), bool)
        once[first] = True
        flat, owner = flat[np.repeat(once, count)], np.repeat(np.flatnonzero(once).astype(np.int32), count[once])
        if not len(flat):
            return
        order = np.argsort(flat)
        ordered = flat[order]
        times = np.diff(np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])))
        often = np.empty(len(flat), np.uint8)
        often[order] = np.repeat(np.minimum(255, 16 * np.log2(times)).astype(np.uint8), times)
        del order, ordered
        many = often > 0  # 0: of one class alone
        flat, owner, often = flat[many], owner[many], often[many]
        begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
        who = owner[begin]
        edge = np.append(begin, len(flat))
        for k in range(0, len(who), CLASSES):
            few, at = who[k:k + CLASSES], edge[k:k + CLASSES + 1]
            offsets = (at - at[0]).astype(np.int32)
            lists = [pa.Array.from_buffers(pa.binary(), len(few), [None, pa.py_buffer(offsets * np.int32(c.itemsize)), pa.py_buffer(c[at[0]:at[-1]])]) for c in (flat, often)]
            yield pa.RecordBatch.from_arrays([pa.array(h[few]), pa.array(sizes[few].astype(np.int64)), pa.array(np.full(len(few), part, np.int32)), *lists], names=["h", "n", "part", "shingles", "held"])

    return packed.repartition(F.col("part")).sortWithinPartitions("part").mapInArrow(run, "h long, n long, part int, shingles binary, held binary")


def able(shared: DataFrame, similarity: int) -> DataFrame:
    """(h, n, shingles, keys): the classes with enough shared shingles, these as numbers of 8 bytes, and the prefix keys."""
    gathered = shared.groupBy("h").agg(F.min("n").alias("n"), F.sum(F.octet_length("held")).alias("left"), F.collect_list(F.struct("part", "shingles", "held")).alias("parts"))
    gathered = gathered.where(F.col("left") * 100 >= F.col("n") * similarity).select("h", "n", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shingles, keys = [], []
            for size, parts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                s = np.concatenate([np.frombuffer(p["shingles"], np.uint32).astype(np.uint64) | np.uint64(p["part"] << 32) for p in parts])
                often = np.concatenate([np.frombuffer(p["held"], np.uint8) for p in parts])
                # Shingles of one class alone are the rarest: they fill the first places of the prefix.
                take = size - (similarity * size + 99) // 100 + 1 - (size - len(s))
                keys.append(s[np.lexsort((s, often))[:max(0, take)]].view(np.int64))
                shingles.append(np.sort(s).tobytes())
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]).astype(np.int32)), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shingles, pa.binary()), lists], names=["h", "n", "shingles", "keys"])

    return gathered.mapInArrow(run, "h long, n long, shingles binary, keys array<long>")


class RTree:
    """Points of cell counts in leaves of ``fan`` under nodes of ``fan`` leaves, each with the upper corner of its box."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, fan: int = 32):
        self.points, self.sizes, self.fan = points, sizes, fan
        self.leaves = np.stack([points[k:k + fan].max(0) for k in range(0, len(points), fan)])
        self.nodes = np.stack([self.leaves[k:k + fan].max(0) for k in range(0, len(self.leaves), fan)])
        self.least = np.array([sizes[k:k + fan].min() for k in range(0, len(sizes), fan)])
        self.node_least = np.array([self.least[k:k + fan].min() for k in range(0, len(self.least), fan)])

    def near(self, point: np.ndarray, size: int, similarity: int, stop: int) -> np.ndarray:
        """Indices under ``stop`` of points that may link with ``point``."""
        fan, n = self.fan, min(stop, len(self.points))
        count = -(-n // fan)
        node_ok = np.minimum(self.nodes, point).sum(1, dtype=np.int64) >= needed(size, self.node_least, similarity)
        leaf = np.flatnonzero(np.repeat(node_ok, fan)[:count])
        leaf = leaf[np.minimum(self.leaves[leaf], point).sum(1, dtype=np.int64) >= needed(size, self.least[leaf], similarity)]
        at = (leaf[:, None] * fan + np.arange(fan)).ravel()
        at = at[at < n]
        return at[np.minimum(self.points[at], point).sum(1, dtype=np.int64) >= needed(size, self.sizes[at], similarity)]


def cells(sets: list[np.ndarray], dims: int) -> np.ndarray:
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    cell = (np.concatenate(sets) * ODD[3] >> np.uint64(40)).astype(np.int64) % dims
    return np.bincount(owner * dims + cell, minlength=len(sets) * dims).reshape(len(sets), dims).astype(np.uint16 if max(map(len, sets)) < 60_000 else np.uint32)


def links(ids: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray, side: np.ndarray, similarity: int) -> list[tuple[int, int]]:
    """Links that join all sets which links join; ``sizes`` are those of the whole sets, of which ``sets`` are the shared parts.

    Sets of one side (0) and the other (1) are compared across only; with one side (all 0), all pairs are.
    """
    dims = 1 << int(np.clip(np.log2(max(8.0, float(sizes.mean()) / 2)), 4, 9))
    across = bool(side.any())
    points = cells(sets, dims)
    # Similar points lie together: by size, then by the coordinates of the fullest cells.
    order = np.lexsort([*(points[:, k] for k in np.argsort(-points.max(0))[:4][::-1]), sizes])
    ids, sets, side, sizes, points = ids[order], [sets[k] for k in order], side[order], sizes[order], points[order]
    of = [np.flatnonzero(side == 0), np.flatnonzero(side == 1)] if across else [np.arange(len(sets))] * 2
    tree = RTree(points[of[0]], sizes[of[0]])
    found, component = [], np.arange(len(sets))
    for place, q in enumerate(of[1]):
        near = tree.near(points[q], int(sizes[q]), similarity, len(of[0]) if across else place)
        near = of[0][near]
        while len(near := near[component[near] != component[q]]):
            other, near = near[-1], near[:-1]
            both = len(np.intersect1d(sets[q], sets[other], assume_unique=True))
            if 100 * both >= similarity * (sizes[q] + sizes[other] - both):
                found.append((int(ids[q]), int(ids[other])))
                component[component == component[other]] = component[q]
    return found


def linked(members: DataFrame, similarity: int) -> DataFrame:
    """(a, b) links from rows (task, side, h, n, shingles); a task's rows are neighbours in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows = None, []

        def done() -> pa.RecordBatch:
            side, ids, sizes = (np.array([r[c] for r in rows], np.int64) for c in range(3))
            made = links(ids, [np.frombuffer(r[3], np.uint64) for r in rows], sizes, side, similarity) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([m[c] for m in made], pa.int64()) for c in (0, 1)], names=["a", "b"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                if row[0] != task and rows:
                    yield done()
                    rows = []
                task = row[0]
                rows.append(row[1:])
        if rows:
            yield done()

    return members.mapInArrow(run, "a long, b long")


def placed(members: DataFrame, similarity: int, tile: int) -> DataFrame:
    """``members`` (h, n, group, ...) with ``places``: the (task, side) pairs that a class takes part in.

    A small group is one task; a large one has a task for each pair of tiles that may link.
    """
    counted = members.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(100 / similarity)).cast("long"))
    per_band = counted.groupBy("group", "band").agg(F.count("*").alias("rows"))
    totals = per_band.groupBy("group").agg(F.sum("rows").alias("total"))
    large = per_band.join(totals, "group").where(F.col("total") > tile).select("group", "band", F.ceil(F.col("rows") / tile).cast("int").alias("tiles"))
    above = large.select("group", (F.col("band") - 1).alias("band"), F.col("tiles").alias("tiles_above"))
    below = large.select("group", (F.col("band") + 1).alias("band"), F.col("tiles").alias("tiles_below"))
    plan = large.join(above, ["group", "band"], "left").join(below, ["group", "band"], "left")
    rows = counted.join(plan, ["group", "band"], "left")
    own, b, zero = F.pmod(F.xxhash64("h"), F.col("tiles")).cast("int"), F.col("band"), F.lit(0)
    # (band, tile) of both sides name a task; side 0 is the lower one.
    name = lambda b0, t0, b1, t1: F.xxhash64("group", b0, t0, b1, t1)
    place = lambda task, side: F.struct(task.alias("task"), side.cast("int").alias("side"))
    here = F.transform(F.sequence(zero, F.col("tiles") - 1), lambda t: place(name(b, F.least(t, own), b, F.greatest(t, own)), t < own))
    up = F.transform(F.sequence(zero, F.col("tiles_above") - 1), lambda t: place(name(b, own, b + 1, t), zero))
    down = F.transform(F.sequence(zero, F.col("tiles_below") - 1), lambda t: place(name(b - 1, t, b, own), F.lit(1)))
    none = F.array().cast("array<struct<task:bigint,side:int>>")
    alone = F.array(place(F.xxhash64("group"), zero))
    places = F.when(F.col("tiles").isNull(), alone).otherwise(F.concat(here, F.coalesce(up, none), F.coalesce(down, none)))
    return rows.select(*members.columns, places.alias("places"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text_col: str = "text", n: int = 5, similarity: int = 75, parts: int | None = None, tile: int = 4096) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    parts = parts or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shared = shared_shingles(dealt(source.where("doc_id is not null"), n, parts))
    classes = written(spark, able(shared, similarity), "classes")

    # One star per prefix shingle, around its smallest class.
    keys = classes.select("h", F.explode("keys").alias("key"))
    stars = keys.withColumn("hub", F.min("h").over(Window.partitionBy("key"))).where("h <> hub").select("h", "hub")
    groups = written(spark, components(stars, "h", "hub").select(F.col("node").alias("h"), F.col("component").alias("group")), "groups")
    chosen = placed(classes.select("h", "n").join(groups, "h"), similarity, tile).select("h", F.explode("places").alias("p"))
    rows = classes.select("h", "n", "shingles").join(chosen, "h").select("p.task", "p.side", "h", "n", "shingles")
    pairs = linked(rows.repartition(F.col("task")).sortWithinPartitions("task"), similarity)

    heads = written(spark, heads_of(source, n), "heads")
    least = heads.where("id is not null and n > 0").groupBy("h").agg(F.min("id").alias("doc_id"))
    joined = least.join(components(pairs).withColumnRenamed("node", "h"), "h", "left").select("h", "doc_id", F.coalesce("component", "h").alias("root"))
    smallest = joined.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = heads.join(joined.join(smallest, "root").select("h", "component_id"), "h", "left")
    component = F.when(F.col("n") == 0, F.col("id")).when(F.col("id").isNotNull(), F.col("component_id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))
