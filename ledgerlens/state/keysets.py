"""Exact distinct keys as bitmaps: one set per day, merged for any window, and the day each key was first seen.

Keys (wallets, deployers) get dense numbers from a dictionary in the order of their first day, 32,768 to a bucket. Tables, by day:
``days`` (bucket, bitmap of the keys active that day; bucket -1 marks rows without a key) and ``firsts`` (bucket, bitmap of the keys first
seen that day). Sets merge exactly (``bitmap_or_agg``), so distinct counts of any run of whole days, cohorts and first-seen splits
come from bitmaps of 4 kB per 32,768 keys, and facts are read only for days that changed and for the parts of days at
a window's ends.

A refresh rebuilds the sets of changed days only. A key whose first row came late moves to the earlier day; a key that lost the
row of its first day moves to the next day that still has it, found in the bitmaps of its bucket. Other keys' firsts are not touched.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.joins import bounded
from ..functions.exprs import period
from ..timeframe import Timeframe, as_datetime, ntz, shift, truncate
from . import manifest
from .versions import Commit, Versions

BUCKET = 32_768  # bits of a bitmap
NO_KEY = -1
SCHEMAS = {"keys": "key string, id long", "days": "bucket long, bitmap binary", "firsts": "bucket long, bitmap binary", "files": "file string, modified timestamp, size long, day date"}
#: (since, until) -> rows ``key, ts`` with since <= ts < until (None: no bound), reading only those days' partitions.
Source = Callable[[dt.datetime | None, dt.datetime | None], DataFrame]


def _bucket(id_: Column) -> Column:
    return F.floor(id_ / BUCKET).cast("long")


def _byte(bitmap: str, number: Column) -> Column:
    return F.conv(F.hex(F.substring(F.col(bitmap), number, F.lit(1))), 16, 10).cast("int")


def _has(bitmap: str, id_: str) -> Column:
    """Whether the bitmap of the key's bucket holds the key."""
    byte = _byte(bitmap, (F.floor(F.col(id_) % BUCKET / 8) + 1).cast("int"))
    return F.floor(byte / F.pow(F.lit(2), F.col(id_) % 8)).cast("int") % 2 == 1


def _ids(sets: DataFrame) -> DataFrame:
    """(block_date, id) of every key in (block_date, bucket, bitmap)."""
    used = F.filter(F.sequence(F.lit(1), F.lit(BUCKET // 8)), lambda k: F.substring(F.col("bitmap"), k, F.lit(1)) != F.lit(b"\0"))
    bytes_ = sets.filter(F.col("bucket") >= 0).select("block_date", "bucket", "bitmap", F.explode(used).alias("_k")).withColumn("_v", _byte("bitmap", F.col("_k")))
    bits = F.expr("filter(sequence(0, 7), b -> shiftright(_v, b) & 1 = 1)")
    return bytes_.select("block_date", "bucket", "_k", F.explode(bits).alias("_b")).select("block_date", (F.col("bucket") * BUCKET + (F.col("_k") - 1) * 8 + F.col("_b")).alias("id"))


def _sets(ids: DataFrame, *by: str) -> DataFrame:
    """Bitmaps of ``id`` per ``by`` and bucket. Ids are dealt before a bitmap is made of them: every task would make 4 kB for each
    day and bucket of which it holds an id. An id comes once, so a day's bucket is at most ``BUCKET`` rows."""
    bits = ids.select(*by, _bucket(F.col("id")).alias("bucket"), (F.col("id") % BUCKET).cast("int").alias("_bit"))
    return bits.repartition(*by, "bucket").groupBy(*by, "bucket").agg(F.bitmap_construct_agg(F.col("_bit").cast("long")).alias("bitmap"))


def runs_of(days: set[dt.date], most: int = 32) -> list[tuple[dt.datetime, dt.datetime]]:
    """Runs of neighbouring days as (start, end); the smallest gaps are closed if there are more than ``most``."""
    out: list[list[dt.datetime]] = []
    for day in sorted(days):
        start = as_datetime(day)
        if out and out[-1][1] == start:
            out[-1][1] = start + dt.timedelta(days=1)
        else:
            out.append([start, start + dt.timedelta(days=1)])
    while len(out) > most:
        k = min(range(1, len(out)), key=lambda k: out[k][0] - out[k - 1][1])
        out[k - 1][1] = out.pop(k)[1]
    return [(a, b) for a, b in out]


class KeySets:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.store = spark, Versions(spark, root, SCHEMAS)
        self.commit = self.store.latest()

    # --- refresh ---------------------------------------------------------------------------------------------------

    @property
    def until(self) -> dt.datetime | None:
        """All days before this one are stored."""
        stored = self.commit.facts.get("until")
        return dt.datetime.fromisoformat(stored) if stored else None

    def seen_files(self) -> DataFrame:
        return self.store.read_parts("files", self.commit.live["files"])

    def refresh(self, source: Source, closed: dt.datetime, changed: list[dt.date] | None = None, files: DataFrame | None = None, digested: bool = False) -> list[dt.date]:
        """Rebuild the ``changed`` days before ``closed`` (None: all) and store the manifest ``files``; returns the days rebuilt.
        ``digested``: the manifest is the digest of the keys of the days built, from the same pass over the facts."""
        spark, store, was = self.spark, self.store, self.commit
        version = store.new_version()
        staged = lambda df, name: self._staged(df, f"{version}/{name}")
        if changed is None or self.until is None:
            rows = source(None, closed)
            days = None
        else:
            days = {d for d in changed if as_datetime(d) < closed}
            if self.until < closed:  # days since the last refresh, whether a file was noticed or not
                days |= {(self.until + dt.timedelta(days=k)).date() for k in range((closed - self.until).days)}
            if not days:
                return []
            rows = reduce(DataFrame.unionByName, [source(a, b) for a, b in runs_of(days)])
            rows = rows.filter(F.to_date("ts").isin(sorted(days)))
        active = staged(rows.groupBy("key", F.to_date("ts").alias("block_date")).agg(F.count(F.lit(1)).alias("n")), "active")
        if digested:
            files = manifest.of_digests(active.select(F.col("block_date").alias("day"), F.col("n").alias("size"), (F.col("n") * manifest.row_digest("key")).alias("digest")))
        rebuilt = {r[0] for r in active.select("block_date").distinct().collect()}
        days = rebuilt | {d for d in was.live["days"] if as_datetime(d) < closed} if days is None else days

        # New keys are numbered in the order of their first day, so that a day's new keys share buckets.
        known = store.read_parts("keys", was.live["keys"])
        base = int(was.facts.get("keys", 0))
        fresh = active.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("block_date").alias("d")).join(known, "key", "left_anti")
        ordered = fresh.repartitionByRange("d", "key").sortWithinPartitions("d", "key")
        numbered = staged(ordered.select("key", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("k")), "numbered")
        starts, total = [], base
        for part, n in sorted(tuple(r) for r in numbered.groupBy("part").count().collect()):  # one row per partition
            starts.append((part, total))
            total += n
        offsets = bounded(spark.createDataFrame(starts, "part int, base long"))
        live = {t: dict(d) for t, d in was.live.items()}
        store.add_part("keys", version, numbered.join(offsets, "part").select("key", (F.col("base") + F.col("k")).alias("id")), live["keys"])
        keys = store.read_parts("keys", live["keys"])
        ids = staged(active.filter(F.col("key").isNotNull()).join(keys, "key").select("id", "block_date"), "ids")

        no_key = active.filter(F.col("key").isNull()).select("block_date", F.lit(NO_KEY).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("bitmap"))
        have = store.write("days", version, _sets(ids, "block_date").unionByName(no_key))
        for day in days:
            live["days"].pop(day, None)
        live["days"].update(dict.fromkeys(have, version))

        moves = staged(self._moves(ids, base, days, live), "moves")
        touched = {r.day for r in moves.select(F.explode(F.array("was", "now")).alias("day")).distinct().collect() if r.day is not None}
        stay = _ids(store.read("firsts", was).filter(F.col("block_date").isin(sorted(touched)))) if touched else None
        come = moves.filter("now is not null").select(F.col("now").alias("block_date"), "id")
        if stay is not None:
            left = moves.select("id", F.col("was").alias("block_date"))
            come = stay.join(left, ["id", "block_date"], "left_anti").select("block_date", "id").unionByName(come)
        have = store.write("firsts", version, _sets(come, "block_date"))
        for day in touched:
            live["firsts"].pop(day, None)
        live["firsts"].update(dict.fromkeys(have, version))

        if files is not None:
            live["files"] = {}
            store.add_part("files", version, files, live["files"])
        store.publish(version, Commit(live, {"keys": str(total), "until": max(closed, self.until or closed).isoformat()}))
        self.commit = store.latest()
        return sorted(days)

    def _staged(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.store.root}/staging/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _moves(self, ids: DataFrame, base: int, days: set[dt.date], live: dict) -> DataFrame:
        """(id, was, now): first days that change; ``was`` is null for new keys, ``now`` where no row is left."""
        firsts = self.store.read("firsts", self.commit)
        least = ids.groupBy("id").agg(F.min("block_date").alias("least"))
        new = least.filter(F.col("id") >= base).select("id", F.lit(None).cast("date").alias("was"), F.col("least").alias("now"))
        if not self.commit.live["firsts"]:
            return new
        old = least.filter(F.col("id") < base).withColumn("bucket", _bucket(F.col("id")))
        held = old.join(firsts.withColumnRenamed("block_date", "was"), "bucket", "left").filter("bitmap is not null").filter(_has("bitmap", "id"))
        # Keys of the dictionary that had lost all their rows and have one again are in no set of firsts.
        back = old.join(held.select("id"), "id", "left_anti").select("id", F.lit(None).cast("date").alias("was"), F.col("least").alias("now"))
        earlier = held.filter(F.col("least") < F.col("was")).select("id", "was", F.col("least").alias("now"))
        # Keys whose first day was rebuilt without them.
        lost = _ids(firsts.filter(F.col("block_date").isin(sorted(days)))).join(ids, ["id", "block_date"], "left_anti").select("id", F.col("block_date").alias("was"))
        after = self.store.read("days", Commit(live, {}))
        again = lost.withColumn("bucket", _bucket(F.col("id"))).join(after.filter(F.col("bucket") >= 0).withColumnRenamed("block_date", "day"), "bucket", "left")
        now = F.min(F.when(_has("bitmap", "id"), F.col("day")))
        moved = again.groupBy("id", "was").agg(now.alias("now"))
        return new.unionByName(back).unionByName(moved).unionByName(earlier.join(lost.select("id"), "id", "left_anti"))

    # --- reading ---------------------------------------------------------------------------------------------------

    def _need(self, cut: dt.datetime) -> None:
        if self.until is None or self.until < cut:
            raise ValueError(f"the stored sets end at {self.until}; refresh them up to {cut}")

    def days(self) -> DataFrame:
        return self.store.read("days", self.commit)

    def firsts(self) -> DataFrame:
        return self.store.read("firsts", self.commit)

    def merged(self, sets: DataFrame, *by: Column | str) -> DataFrame:
        return sets.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))

    def per_period(self, tf: Timeframe | str, before: dt.datetime, out: str) -> DataFrame:
        """Distinct keys per period before ``before`` (a day's start): ``_period, {out}``."""
        self._need(before)
        days = self.days().filter(F.col("block_date") < F.lit(before.date()))
        sets = self.merged(days, period(F.col("block_date"), tf).alias("_period"))
        n = F.when(F.col("bucket") >= 0, F.bitmap_count("bitmap")).otherwise(0)
        return sets.groupBy("_period").agg(F.sum(n).cast("bigint").alias(out))

    def in_windows(self, source: Source, as_of: dt.datetime, windows: dict[str, tuple[dt.datetime, dt.datetime | None]]) -> DataFrame:
        """One row: distinct keys in each window ``[start, end)``; an ``end`` of None is ``as_of`` itself, included.

        Whole stored days come from the bitmaps. The parts of days at the ends, and days not stored yet, are read from the
        facts: at most one day's partition per end.
        """
        midnight = truncate(as_of, Timeframe.DAY)
        stored = min(self.until or dt.datetime.min, midnight)
        day = dt.timedelta(days=1)
        whole: dict[str, tuple[dt.date, dt.date]] = {}
        live: set[dt.date] = set()
        for name, (start, end) in windows.items():
            last = midnight if end is None else truncate(end, Timeframe.DAY)
            first = truncate(start, Timeframe.DAY)
            first += day if first < start else dt.timedelta()
            top = min(last, stored)
            whole[name] = (first.date(), max(first, top).date())
            if first > start:
                live.add(truncate(start, Timeframe.DAY).date())
            live |= {(d).date() for d in _span(max(first, top), last)}
            if end is None or last < end:
                live.add(last.date())
        rows = reduce(DataFrame.unionByName, [source(a, b) for a, b in runs_of(live)]) if live else None
        days = self.days().filter(F.col("bucket") >= 0)
        named = F.array_compact(F.array(*[F.when((F.col("block_date") >= F.lit(a)) & (F.col("block_date") < F.lit(b)), F.lit(w)) for w, (a, b) in whole.items()]))
        low, high = min(a for a, _ in whole.values()), max(b for _, b in whole.values())
        sets = days.filter((F.col("block_date") >= F.lit(low)) & (F.col("block_date") < F.lit(high))).select(F.explode(named).alias("w"), "bucket", "bitmap")
        loose = None
        if rows is not None:
            inside = [(w, (F.col("ts") >= ntz(a)) & ((F.col("ts") < ntz(b)) if b is not None else (F.col("ts") <= ntz(as_of)))) for w, (a, b) in windows.items()]
            spans = reduce(lambda x, y: x | y, [c for _, c in inside])
            per_key = rows.filter(F.col("key").isNotNull() & spans).groupBy("key").agg(*[F.bool_or(c).alias(w) for w, c in inside])
            flags = F.array_compact(F.array(*[F.when(F.col(w), F.lit(w)) for w in windows]))
            met = per_key.join(self.store.read_parts("keys", self.commit.live["keys"]), "key").select("id", F.explode(flags).alias("w"))
            sets = sets.unionByName(_sets(met, "w").select("w", "bucket", "bitmap"))
            # Keys that are in no dictionary yet: all keys of the ends less the known ones.
            every = per_key.select(F.explode(flags).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
            loose = every.unionByName(met.groupBy("w").agg((-F.count(F.lit(1))).alias("n")))
        counts = self.merged(sets, "w").select("w", F.bitmap_count("bitmap").alias("n"))
        counts = counts if loose is None else counts.unionByName(loose)
        return counts.agg(*[F.coalesce(F.sum(F.when(F.col("w") == w, F.col("n"))), F.lit(0)).cast("bigint").alias(w) for w in windows])

    def cohorts(self, tf: Timeframe | str, as_of: dt.datetime, scope: int) -> DataFrame:
        """(cohort, k, num_users): keys first seen in a period of the scope that are active ``k`` periods later. Reads the sets
        of the scope's days only."""
        tf = Timeframe.parse(tf)
        cut, first = truncate(as_of, tf), truncate(shift(as_of, -scope, tf), tf)
        self._need(cut)
        inside = (F.col("block_date") >= F.lit(first.date())) & (F.col("block_date") < F.lit(cut.date())) & (F.col("bucket") >= 0)
        when = period(F.col("block_date"), tf)
        starts = self.merged(self.firsts().filter(inside), when.alias("cohort"))
        active = self.merged(self.days().filter(inside), when.alias("p")).withColumnRenamed("bitmap", "_active")
        met = starts.join(active, "bucket").filter("p >= cohort")
        both = met.select("cohort", "p", "bucket", F.explode(F.array("bitmap", "_active")).alias("bitmap"))
        shared = both.groupBy("cohort", "p", "bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"))
        counts = shared.groupBy("cohort", "p").agg(F.sum(F.bitmap_count("bitmap")).alias("num_users")).filter("num_users > 0")
        return counts.select("cohort", F.expr(f"CAST(timestampdiff({tf.value.upper()}, cohort, p) AS INT)").alias("k"), "num_users")

    def first_seen_split(self, tf: Timeframe | str, before: dt.datetime, unit: Timeframe | str = Timeframe.WEEK) -> DataFrame:
        """(_period, is_new, num_accounts): distinct keys per period whose ``unit`` is (not) the one of their first row. A key can be in both
        classes of a period of several units."""
        self._need(before)
        days = self.days().filter(F.col("block_date") < F.lit(before.date()))
        when, part = period(F.col("block_date"), tf).alias("_period"), period(F.col("block_date"), unit).alias("_unit")
        sets = self.merged(days.filter("bucket >= 0"), when, part)
        firsts = self.merged(self.firsts(), part).withColumnRenamed("bitmap", "_first")
        by = ["_period", "_unit", "bucket"]
        new = sets.join(firsts, ["_unit", "bucket"]).select(*by, F.explode(F.array("bitmap", "_first")).alias("bitmap")).groupBy(*by).agg(F.bitmap_and_agg("bitmap").alias("bitmap"))
        # Keys active in the period's other units; a new key that is in none of them is not a returning one.
        units = sets.select("_period", F.col("_unit").alias("_other"), "bucket")
        others = sets.join(units, ["_period", "bucket"]).filter("_unit <> _other").groupBy("_period", F.col("_other").alias("_unit"), "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
        only = new.unionByName(others).groupBy(*by).agg(F.bitmap_or_agg("bitmap").alias("bitmap")).join(new.select(*by), by, "left_semi")
        count = lambda df, is_new, sign: df.select("_period", F.lit(is_new).alias("is_new"), (F.lit(sign) * F.bitmap_count("bitmap")).alias("n"))
        pieces = [count(new, True, 1), count(self.merged(sets, "_period"), False, 1), count(only, False, -1), count(others.join(new.select(*by), by, "left_semi"), False, 1)]
        got = reduce(DataFrame.unionByName, pieces).groupBy("_period", "is_new").agg(F.sum("n").alias("num_accounts")).filter("num_accounts > 0")
        # Rows without a key count no account, but keep their period and class (one row per period and unit).
        bare = days.filter(F.col("bucket") == NO_KEY).select(when, part).distinct()
        least = F.min("_unit").over(Window.partitionBy())
        zero = bare.select("_period", (F.col("_unit") == least).alias("is_new"), F.lit(0).cast("long").alias("num_accounts"))
        return got.unionByName(zero).groupBy("_period", "is_new").agg(F.sum("num_accounts").alias("num_accounts"))


def _span(first: dt.datetime, last: dt.datetime) -> list[dt.datetime]:
    return [first + dt.timedelta(days=k) for k in range(max(0, (last - first).days))]
