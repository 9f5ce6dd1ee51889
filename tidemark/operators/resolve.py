"""Versions to rows: the relational core, as functions from DataFrames to DataFrames.

A version log has ``key``, ``ts`` and value columns (one or more); a deletion is a version whose first
value column is null.  Every function leaves optimisation to Catalyst: key bounds and ``ts`` limits
are plain comparisons below the aggregation, so they reach the Parquet scan, and the choice of the newest
version is an aggregate with a partial step, so a hot key is shrunk before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import ALL_KEYS, KeyRange

#: A private write is newer than any commit.
LOCAL_TS = (1 << 63) - 1


#: Bins of the key space in an overlap join; length of a slice of time in a sweep for conflicts.
BINS, SLICE = 64, 1 << 16


def visible(log: DataFrame, read_ts: int | None = None, keys: KeyRange = ALL_KEYS) -> DataFrame:
    """Versions inside the key range that a reader at read_ts may see."""
    out = log.where(keys.predicate(F.col("key")))
    return out if read_ts is None else out.where(F.col("ts") <= F.lit(read_ts))


def newest(log: DataFrame, by: str | Column = "ts", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The newest version of each key, deletions included.

    The value columns travel as one struct through max_by, so a null value wins like any other and columns
    of one version stay together.
    """
    rest = [c for c in log.columns if c != "key" and (keep is None or c in keep)]
    best = F.max_by(F.struct(*rest), F.col(by) if isinstance(by, str) else by)
    return log.groupBy("key").agg(best.alias("_v")).select("key", *[F.col("_v")[c].alias(c) for c in rest])


def live(log: DataFrame, value: str = "value") -> DataFrame:
    """Drops deletions; only ever applied above the choice of version."""
    return log.where(F.col(value).isNotNull())


def snapshot(log: DataFrame, read_ts: int | None = None, keys: KeyRange = ALL_KEYS, value: str = "value") -> DataFrame:
    """What a reader at read_ts sees: newest visible version of each key, deleted keys left out."""
    return live(newest(visible(log, read_ts, keys)), value)


def point(log: DataFrame, key, read_ts: int | None = None, value: str = "value") -> DataFrame:
    """The row of one key: a top-1 over the few versions that the pushed equality lets through."""
    rows = log.where(F.col("key") == F.lit(key))
    rows = rows if read_ts is None else rows.where(F.col("ts") <= F.lit(read_ts))
    return live(rows.orderBy(F.desc("ts")).limit(1), value)


def first_n(log: DataFrame, n: int, read_ts: int | None = None, keys: KeyRange = ALL_KEYS, value: str = "value") -> DataFrame:
    """The first n rows of a scan in key order (TakeOrderedAndProject, no full sort)."""
    return snapshot(log, read_ts, keys, value).orderBy("key").limit(n)


def history(log: DataFrame, key=None) -> DataFrame:
    """All stored versions in storage order, deletions included."""
    rows = log if key is None else log.where(F.col("key") == F.lit(key))
    return rows.orderBy("key", F.desc("ts"))


# -- merging sorted runs


def merge_runs(runs: list[DataFrame], on: tuple[str, ...] = ("key",)) -> DataFrame:
    """Newest-wins merge of runs given newest first: of equal keys the row of the earliest run in the
    list stays, deletions included."""
    marked = [r.withColumn("_prio", F.lit(i)) for i, r in enumerate(runs)]
    union = reduce(DataFrame.unionByName, marked)
    rest = [c for c in runs[0].columns if c not in on]
    best = F.min_by(F.struct(*rest), F.col("_prio"))
    return union.groupBy(*on).agg(best.alias("_v")).select(*on, *[F.col("_v")[c].alias(c) for c in rest])


def newest_run(log: DataFrame, run: str = "run_id", value: str = "value") -> DataFrame:
    """Reading without timestamps: the row of the newest run counts, and within it the newest ts."""
    return live(newest(log, F.struct(run, "ts")), value)


def overlay(base: DataFrame, writes: DataFrame, value: str = "value") -> DataFrame:
    """A snapshot's rows under a transaction's own writes, own deletions included."""
    top = writes.withColumn("ts", F.lit(LOCAL_TS).cast("long"))
    columns = ["key", "ts", *[c for c in writes.columns if c not in ("key", "ts")]]
    return live(newest(base.select(*columns).unionByName(top.select(*columns))), value)


# -- garbage collection


def prefix_match(prefixes: list, key: Column | None = None) -> Column:
    key = F.col("key") if key is None else key
    return reduce(lambda a, b: a | b, [F.startswith(key, F.lit(p)) for p in prefixes], F.lit(False))


def collect(log: DataFrame, watermark: int, bottom: bool, prefixes: list | None = None, value: str = "value") -> DataFrame:
    """Versions that survive a rewrite.

    Above the watermark all stay.  At or below it only a key's newest does, unless a prefix filter
    matches its key, or it is a deletion, the rewrite reaches the bottom and nothing newer of the key is in
    the rewrite.  One window sorts by (key, ts), so both facts come from a single shuffle; a key's versions
    are together anyway, as they go to one file.
    """
    by = Window.partitionBy("key").orderBy(F.desc("ts"))
    below = (F.col("ts") <= F.lit(watermark)).cast("int")
    marked = log.withColumn("_rn", F.row_number().over(by)).withColumn("_below", F.sum(below).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    survivor = F.col("_below") == 1
    if prefixes:
        survivor = survivor & ~prefix_match(prefixes)
    if bottom:
        survivor = survivor & ~(F.col(value).isNull() & (F.col("_rn") == 1))
    return marked.where((F.col("_below") == 0) | survivor).drop("_rn", "_below")


def collect_unversioned(runs: list[DataFrame], bottom: bool, value: str = "value") -> DataFrame:
    """The same for tables without timestamps: newest run wins, deletions go at the bottom."""
    merged = merge_runs(runs)
    return live(merged, value) if bottom else merged


# -- facts about files, and choosing among them


def run_stats(log: DataFrame, run: str = "run_id") -> DataFrame:
    """One row a run: first and last key, newest and oldest ts, rows."""
    return log.groupBy(run).agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.count("*").alias("n_rows"))


def runs_with_key(stats: DataFrame, key) -> DataFrame:
    return stats.where((F.col("first_key") <= F.lit(key)) & (F.col("last_key") >= F.lit(key)))


def runs_in_range(stats: DataFrame, keys: KeyRange) -> DataFrame:
    """Runs whose span of keys meets the range."""
    out = stats
    if not keys.lower.open:
        out = out.where(F.col("last_key") >= F.lit(keys.lower.key) if keys.lower.inclusive else F.col("last_key") > F.lit(keys.lower.key))
    if not keys.upper.open:
        out = out.where(F.col("first_key") <= F.lit(keys.upper.key) if keys.upper.inclusive else F.col("first_key") < F.lit(keys.upper.key))
    return out


def overlapping_runs(stats: DataFrame, run: str = "run_id") -> DataFrame:
    """Pairs of runs (a < b) whose key spans meet.  File metadata only: a row a file.

    Spans are filed under bins of the key space, whose edges are quantiles of the first keys, and meet in the
    bin in which the later of them starts; so runs that lie apart are never compared, however many there are."""
    number = _key_numbers(stats)
    edges = stats.agg(F.percentile_approx(number("first_key"), [k / BINS for k in range(1, BINS)])).first()[0] or []
    edges = sorted(set(edges))
    bin_of = lambda c: F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= number(c))) if edges else F.lit(0)
    spans = stats.select(run, "first_key", "last_key", bin_of("first_key").alias("_from"), bin_of("last_key").alias("_to"))
    filed = spans.withColumn("_bin", F.explode(F.sequence("_from", "_to")))
    a = filed.select("_bin", F.col(run).alias("run_a"), F.col("first_key").alias("fa"), F.col("last_key").alias("la"), F.col("_from").alias("_a"))
    b = filed.select("_bin", F.col(run).alias("run_b"), F.col("first_key").alias("fb"), F.col("last_key").alias("lb"), F.col("_from").alias("_b"))
    meet = (F.col("fa") <= F.col("lb")) & (F.col("fb") <= F.col("la")) & (F.col("run_a") < F.col("run_b"))
    return a.join(b, "_bin").where(meet & (F.col("_bin") == F.greatest("_a", "_b"))).select("run_a", "run_b")


def _key_numbers(stats: DataFrame):
    """A function from a key column to an integer in the order of keys: the 7 bytes behind what all first and last
    keys have in common."""
    low, high = (r if r is None else bytes(r) if isinstance(r, bytearray | bytes) else r.encode() for r in stats.agg(F.min("first_key"), F.max("last_key")).first())
    shared = 0
    while low and high and shared < min(len(low), len(high)) and low[shared] == high[shared]:
        shared += 1
    digits = lambda c: F.substring(F.rpad(F.hex(F.col(c).cast("binary")), 2 * shared + 14, "0"), 2 * shared + 1, 14)
    return lambda c: F.conv(digits(c), 16, 10).cast("long")


def space(log: DataFrame, value: str = "value") -> DataFrame:
    """Stored versions against live rows: what a full rewrite would save.  One shuffle, by key."""
    keys = log.groupBy("key").agg(F.count("*").alias("n"), F.max_by(F.struct(value), "ts").alias("_v"))
    return keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("stored"), F.count_if(F.col("_v")[value].isNotNull()).alias("live"))


# -- change and conflict


def diff(log: DataFrame, old_ts: int, new_ts: int, value: str = "value") -> DataFrame:
    """Keys whose visible value differs between two snapshots: key, old_value, new_value, change.

    One pass: both values are conditional aggregates of the same shuffle."""
    rows = log.where(F.col("ts") <= F.lit(max(old_ts, new_ts)))
    at = lambda ts: F.max_by(F.struct(value), F.when(F.col("ts") <= F.lit(ts), F.col("ts")))[value]
    both = rows.groupBy("key").agg(at(old_ts).alias("old_value"), at(new_ts).alias("new_value"))
    change = F.when(F.col("old_value").isNull(), "insert").when(F.col("new_value").isNull(), "delete").otherwise("update")
    return both.where(~F.col("old_value").eqNullSafe(F.col("new_value"))).withColumn("change", change)


def conflicts(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """Transactions (txn, read_ts, key read) that must abort: a key they read was committed after they
    began.  reads: txn, read_ts, commit_ts, key; writes: commit_ts, key.

    A sweep in time, not a join: the last write of the key before a transaction commits decides.  Times are cut in
    slices of SLICE, inside which a window runs; of each slice its last write is handed to the next ones,
    so a hot key spreads over as many tasks as it has slices."""
    marks = reads.select("key", F.col("commit_ts").alias("at"), "txn", "read_ts", F.lit(None).cast("long").alias("wrote"))
    marks = marks.unionByName(writes.select("key", F.col("commit_ts").alias("at"), F.lit(None).cast(reads.schema["txn"].dataType).alias("txn"), F.lit(None).cast("long").alias("read_ts"), F.col("commit_ts").cast("long").alias("wrote")))
    marks = marks.withColumn("slice", F.floor(F.col("at") / SLICE))
    slices = marks.groupBy(F.col("key").alias("_k"), F.col("slice").alias("_s")).agg(F.max("wrote").alias("_last"))
    earlier = Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("_k", "_s", F.max("_last").over(earlier).alias("_before"))
    inside = Window.partitionBy("key", "slice").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    seen = marks.withColumn("_near", F.max("wrote").over(inside)).where(F.col("read_ts").isNotNull())
    seen = seen.join(slices, F.col("key").eqNullSafe(F.col("_k")) & (F.col("slice") == F.col("_s")))
    return seen.where(F.greatest("_near", "_before") > F.col("read_ts")).select("txn").distinct()


def dedupe_batch(records: DataFrame, ordinal: str = "ord") -> DataFrame:
    """Of a batch's records for a key the last one counts."""
    return newest(records, ordinal)
