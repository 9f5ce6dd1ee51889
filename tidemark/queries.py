"""The engine's operators on the generated ``events`` table, each with SQL for DuckDB.

The version log: a key per user, the event number as commit timestamp, 500 events a run, errors as
deletions.  Constants follow the table's size through the log itself (``last``, the newest timestamp).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.keys import ALL_KEYS, Delete, KeyRange, Put, excluded, included, prefix_range
from .operators import resolve
from .operators.split import with_file
from .plans.layout import NoCompaction
from .plans.leveled import Leveled
from .plans.simple import SimpleLeveled
from .plans.tiered import Tiered
from .sources.table import ConflictError, Options, VersionedTable


def version_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    value = F.when(F.col("event_type") != "error", F.concat("event_type", F.lit(":"), F.col("event_id").cast("string")))
    return e.select(F.lpad(F.col("user_id").cast("string"), 10, "0").alias("key"), (F.col("event_id") + 1).alias("ts"), F.floor(F.col("event_id") / 500).cast("long").alias("run_id"), value.alias("value"))


LOG = """log AS (SELECT lpad(cast(user_id AS varchar), 10, '0') AS key, event_id + 1 AS ts, cast(floor(event_id / 500) AS bigint) AS run_id,
       CASE WHEN event_type = 'error' THEN NULL ELSE concat(event_type, ':', cast(event_id AS varchar)) END AS value FROM events)"""


def newest_sql(where: str = "TRUE", order: str = "ts DESC", source: str = "log") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {order}) AS rn FROM {source} WHERE {where}) n WHERE rn = 1"


def snap_sql(where: str, columns: str = "key, ts, value") -> str:
    return f"WITH {LOG} SELECT {columns} FROM ({newest_sql(where)}) s WHERE value IS NOT NULL"


def last_ts(log: DataFrame) -> int:
    return log.agg(F.coalesce(F.max("ts"), F.lit(0))).first()[0]


KVT = ("key", "ts", "value")
HALF = "(SELECT cast(floor(max(ts) * 0.5) AS bigint) FROM log)"
NEAR = "(SELECT cast(floor(max(ts) * 0.98) AS bigint) FROM log)"


def snapshot_scan(spark, sf):
    log = version_log(spark, sf)
    return resolve.snapshot(log, last_ts(log) // 2).select(*KVT)


def latest_scan(spark, sf):
    return resolve.snapshot(version_log(spark, sf)).select(*KVT)


def _range(lower, upper):
    def query(spark, sf):
        return resolve.snapshot(version_log(spark, sf), None, KeyRange(lower, upper)).select(*KVT)

    return query


ENDS = {"included": (included("0000000003"), included("0000000012")), "excluded": (excluded("0000000003"), excluded("0000000012")), "unbounded": (KeyRange().lower, KeyRange().upper)}
SQL_LOW = {"included": "key >= '0000000003'", "excluded": "key > '0000000003'", "unbounded": "TRUE"}
SQL_HIGH = {"included": "key <= '0000000012'", "excluded": "key < '0000000012'", "unbounded": "TRUE"}


def range_scan(spark, sf):
    log = version_log(spark, sf)
    return resolve.snapshot(log, last_ts(log) // 2, KeyRange(excluded("0000000010"), included("0000000050"))).select(*KVT)


def inverted_range(spark, sf):
    return resolve.snapshot(version_log(spark, sf), None, KeyRange(included("0000000012"), included("0000000003"))).select(*KVT)


def point_get(spark, sf):
    log = version_log(spark, sf)
    return resolve.point(log, "0000000002", last_ts(log) // 2).select(*KVT)


def seek(spark, sf):
    return resolve.first_n(version_log(spark, sf), 1, None, KeyRange(included("0000000010x"), ALL_KEYS.upper)).select(*KVT)


def first_n(spark, sf):
    return resolve.first_n(version_log(spark, sf), 10, None, KeyRange(excluded("0000000002"), ALL_KEYS.upper)).select(*KVT)


def prefix_scan(spark, sf):
    r = prefix_range(b"000000001")
    return resolve.snapshot(version_log(spark, sf), None, KeyRange(included(r.lower.key.decode()), excluded(r.upper.key.decode()))).select(*KVT)


def key_only_scan(spark, sf):
    return resolve.snapshot(version_log(spark, sf)).select("key")


def version_history(spark, sf):
    return resolve.history(version_log(spark, sf), "0000000002").select(*KVT)


def version_count(spark, sf):
    return version_log(spark, sf).groupBy("key").agg(F.count("*").alias("n_versions"), F.count_if(F.col("value").isNull()).alias("n_deletions"), F.max("ts").alias("max_ts"))


def newest_run_wins(spark, sf):
    return resolve.newest_run(version_log(spark, sf)).select("key", "run_id", "value")


def run_merge(spark, sf):
    log = version_log(spark, sf)
    runs = [resolve.newest(log.where((F.col("run_id") % 3) == i)).select("key", "value") for i in range(3)]
    return resolve.merge_runs(runs)


def two_way_merge(spark, sf):
    log = version_log(spark, sf)
    half = last_ts(log) // 2
    newer, older = (resolve.newest(x).select("key", "value") for x in (log.where(F.col("ts") > half), log.where(F.col("ts") <= half)))
    return resolve.merge_runs([newer, older])


def txn_overlay(spark, sf):
    log = version_log(spark, sf)
    half = last_ts(log) // 2
    own = resolve.newest(log.where((F.col("ts") > half) & (F.col("ts") <= half + 100))).select("key", "value")
    return resolve.overlay(resolve.newest(resolve.visible(log, half)), own).select("key", "value")


def _gc(bottom: bool, prefixes: tuple[str, ...] = ()):
    def query(spark, sf):
        log = version_log(spark, sf)
        return resolve.collect(log, int(last_ts(log) * 0.98), bottom, list(prefixes)).select(*KVT)

    return query


def _gc_sql(bottom: bool, prefix: str = "") -> str:
    skip = f" AND NOT starts_with(key, '{prefix}')" if prefix else ""
    gone = " AND NOT (value IS NULL AND ts = mx)" if bottom else ""
    return f"""WITH {LOG}, w AS (SELECT *, {NEAR} AS w FROM log), m AS (SELECT *, row_number() OVER (PARTITION BY key, ts <= w ORDER BY ts DESC) AS rn, max(ts) OVER (PARTITION BY key) AS mx FROM w)
SELECT key, ts, value FROM m WHERE ts > w OR (rn = 1{skip}{gone})"""


def gc_unversioned(spark, sf):
    log = version_log(spark, sf)
    runs = [resolve.newest(log.where((F.col("run_id") % 2) == i)).select("key", "value") for i in range(2)]
    return resolve.collect_unversioned(runs, True)


def run_meta(spark, sf):
    return resolve.run_stats(version_log(spark, sf))


def run_prune(spark, sf):
    return resolve.runs_with_key(resolve.run_stats(version_log(spark, sf)), "0000000000").select("run_id")


def run_prune_range(spark, sf):
    return resolve.runs_in_range(resolve.run_stats(version_log(spark, sf)), KeyRange(excluded("0000000010"), excluded("0000000011"))).select("run_id")


def run_overlap(spark, sf):
    return resolve.overlapping_runs(resolve.run_stats(version_log(spark, sf)))


def occ_conflicts(spark, sf):
    """Each event is a transaction that began 40 events before and read its user's key."""
    log = version_log(spark, sf)
    reads = log.select(F.col("ts").alias("txn"), (F.col("ts") - 40).alias("read_ts"), F.col("ts").alias("commit_ts"), "key")
    return resolve.conflicts(reads, log.select(F.col("ts").alias("commit_ts"), "key"))


def batch_last_wins(spark, sf):
    """Runs as batches: of a batch's records for a key the last counts."""
    log = version_log(spark, sf).select("run_id", "key", F.col("ts").alias("ord"), "value")
    by = log.withColumn("k", F.struct("run_id", "key")).select(F.col("k").alias("key"), "ord", "value")
    return resolve.dedupe_batch(by, "ord").select(F.col("key.run_id").alias("run_id"), F.col("key.key").alias("key"), "ord", "value")


def out_split(spark, sf):
    return with_file(version_log(spark, sf), 16 * 1024).select("key", "key_bytes", "file_no")


def space_amp(spark, sf):
    return resolve.space(version_log(spark, sf))


def time_travel_diff(spark, sf):
    log = version_log(spark, sf)
    last = last_ts(log)
    return resolve.diff(log, last // 2, int(last * 0.6))


def latest_by_user_typed(spark, sf):
    """Typed values instead of bytes: several value columns of one version stay together."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    log = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("ts"), "event_type", F.col("value").alias("amount"))
    return resolve.newest(log).select(F.col("key").alias("user_id"), F.col("ts").alias("event_id"), "event_type", "amount")


def _workdir(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a temporary one only where they are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"


def _binary(log: DataFrame) -> DataFrame:
    return log.select("key", "ts", "value")


def table_scan(spark, sf):
    """Four sorted runs written through the table, read by a pruned, merged scan."""
    log = version_log(spark, sf)
    last = last_ts(log)
    t = VersionedTable.at(spark, _workdir(spark), Options())
    for i in range(4):
        t.load_versions(_binary(log.where((F.col("ts") > last * i // 4) & (F.col("ts") <= last * (i + 1) // 4))))
    return t.scan(KeyRange(excluded(b"0000000002"), ALL_KEYS.upper)).select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def table_compacted(spark, sf):
    """The versions left by a full compaction while a snapshot is open."""
    log = version_log(spark, sf)
    half = last_ts(log) // 2
    t = VersionedTable.at(spark, _workdir(spark), Options(policy=NoCompaction(), file_bytes=64 << 10))
    t.load_versions(_binary(log.where(F.col("ts") <= half)))
    with t.begin():
        t.load_versions(_binary(log.where(F.col("ts") > half)))
        t.full_compaction()
        out = t.versions().select(F.col("key").cast("string").alias("key"), "ts", F.col("value").cast("string").alias("value"))
    return out


def table_leveled(spark, sf):
    """Bulk batches and leveled compactions; every batch has one timestamp."""
    log = version_log(spark, sf)
    t = VersionedTable.at(spark, _workdir(spark), Options(policy=Leveled(base_level_size_mb=1)))
    last = last_ts(log)
    for i in range(3):
        t.write_frame(log.where((F.col("ts") > last * i // 3) & (F.col("ts") <= last * (i + 1) // 3)).select("key", "value", "ts"), "load", i, "ts")
        t.maintain()
    return t.scan().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def _compacted_by(policy):
    def query(spark, sf):
        log = version_log(spark, sf)
        t = VersionedTable.at(spark, _workdir(spark), Options(policy=policy))
        last = last_ts(log)
        for i in range(6):
            t.write_frame(log.where((F.col("ts") > last * i // 6) & (F.col("ts") <= last * (i + 1) // 6)).select("key", "value", "ts"), "load", i, "ts")
            t.maintain()
        return t.scan().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))

    return query


def _loaded(spark: SparkSession, sf: str, n: int = 4, **options) -> tuple[VersionedTable, int]:
    """A table of n sorted runs with the log's own timestamps, and the newest of them."""
    log = version_log(spark, sf)
    last = last_ts(log)
    t = VersionedTable.at(spark, _workdir(spark), Options(**options))
    for i in range(n):
        t.load_versions(_binary(log.where((F.col("ts") > last * i // n) & (F.col("ts") <= last * (i + 1) // n))))
    return t, last


def _text(rows: DataFrame) -> DataFrame:
    """Keys and values as text again."""
    return rows.select(*[F.col(c).cast("string").alias(c) if kind == "binary" else F.col(c) for c, kind in rows.dtypes])


def table_range(spark, sf):
    """A bounded scan of a past snapshot; key span and timestamp prune files, then row groups."""
    t, last = _loaded(spark, sf)
    return _text(t.scan(KeyRange(excluded(b"0000000010"), included(b"0000000050")), read_ts=last // 2))


def table_seek(spark, sf):
    return _text(_loaded(spark, sf)[0].seek("0000000010x"))


def table_prefix(spark, sf):
    return _text(_loaded(spark, sf)[0].prefix("000000001"))


def table_history(spark, sf):
    t, _ = _loaded(spark, sf)
    return _text(resolve.history(t.versions(keys=KeyRange(included(b"0000000002"), included(b"0000000002")))))


def table_diff(spark, sf):
    t, last = _loaded(spark, sf)
    return _text(t.diff(last // 2, int(last * 0.6)))


def table_get(spark, sf):
    """Point reads at three snapshots; a key that is deleted or absent has no value."""
    t, last = _loaded(spark, sf)
    got = [(k, at, t.get(k, read_ts=ts)) for k in ("0000000002", "0000000010x") for at, ts in (("start", 0), ("half", last // 2), ("end", last))]
    return spark.createDataFrame([(k, at, v and v.decode()) for k, at, v in got], "key string, as_of string, value string")


def table_facts(spark, sf):
    """What the manifest says of the files of all runs together."""
    t, _ = _loaded(spark, sf)
    d = t.describe().where("place != 'buffer'")
    return _text(d.agg(F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"), F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"), F.sum("n_rows").alias("n_rows")))


def table_source(spark, sf):
    """The table as another process reads it, through the data source."""
    from .sources.datasource import register

    register(spark)
    t, last = _loaded(spark, sf)
    rows = spark.read.format("tidemark").option("path", t.path).option("read_ts", str(last // 2)).load()
    return _text(resolve.snapshot(rows).select("key", "value"))


def table_vacuumed(spark, sf):
    """Compactions, then only the files still named, opened anew from the log."""
    t, _ = _loaded(spark, sf, 6, policy=SimpleLeveled())
    t.maintain()
    t.vacuum(0)
    t.close()
    return _text(VersionedTable.at(spark, t.path, Options(policy=SimpleLeveled())).scan())


def ingest_stream(spark, sf):
    """The events as a stream, each micro-batch one commit."""
    from .streaming.ingest import ingest

    path = f"{sf}/events.parquet"
    # A pattern, as a stream's plain path must be a folder and the table may be one file.
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf}/events.parque[t]")
    value = F.when(F.col("event_type") != "error", F.concat("event_type", F.lit(":"), F.col("event_id").cast("string")))
    rows = events.select(F.lpad(F.col("user_id").cast("string"), 10, "0").alias("key"), value.alias("value"), F.col("event_id").alias("ord"))
    t = VersionedTable.at(spark, _workdir(spark), Options(policy=Leveled()))
    ingest(rows, t, "events", f"{t.path}-progress", "ord").awaitTermination()
    return _text(t.scan())


def _type_counts(spark: SparkSession, sf: str) -> dict[str, int]:
    """Events of each type; as few rows as there are types, whatever the table's size."""
    rows = spark.read.parquet(f"{sf}/events.parquet").where(F.col("event_type").isNotNull()).groupBy("event_type").count().collect()
    return {r["event_type"]: r["count"] for r in rows}


def _batches(spark: SparkSession, sf: str, flush: bool = False, **options) -> VersionedTable:
    """A batch of the counts by type, then one that deletes those that are even."""
    counts = _type_counts(spark, sf)
    t = VersionedTable.at(spark, _workdir(spark), Options(**options))
    for batch in ([Put(k, str(n)) for k, n in counts.items()], [Put("~end", "x"), *(Delete(k) for k, n in counts.items() if n % 2 == 0)]):
        t.write_batch(batch)
        if flush:
            t.flush()
    return t


def buffer_scan(spark, sf):
    """Batches that no file holds yet."""
    return _text(_batches(spark, sf).scan())


def buffer_get(spark, sf):
    t = _batches(spark, sf)
    got = [(k, t.get(k)) for k in [*_type_counts(spark, sf), "~absent"]]
    return spark.createDataFrame([(k, v and v.decode()) for k, v in got], "key string, value string")


def recovered_scan(spark, sf):
    """A table that nobody closed, opened again: rows and timestamp come from the log."""
    t = _batches(spark, sf)
    again = VersionedTable.at(spark, t.path)
    return _text(again.scan()).withColumn("latest_ts", F.lit(again.state.latest_ts).cast("long"))


def flushed_files(spark, sf):
    """A file a flushed batch, with its key span, timestamps and rows."""
    d = _batches(spark, sf, flush=True).describe().where("place = 'l0'")
    return _text(d.select("first_key", "last_key", "min_ts", "max_ts", "n_rows"))


def txn_scan(spark, sf):
    """A snapshot under a transaction's own writes; runs loaded after its start do not show."""
    log = version_log(spark, sf)
    half = last_ts(log) // 2
    t = VersionedTable.at(spark, _workdir(spark), Options())
    t.load_versions(_binary(log.where(F.col("ts") <= half)))
    txn = t.begin()
    t.load_versions(_binary(log.where(F.col("ts") > half)))
    txn.put("0000000002", "own")
    txn.delete("0000000003")
    return _text(txn.scan())


def txn_commit(spark, sf):
    """Without validation the last commit wins, over a run loaded after the transaction's start."""
    log = version_log(spark, sf)
    half = last_ts(log) // 2
    t = VersionedTable.at(spark, _workdir(spark), Options())
    t.load_versions(_binary(log.where(F.col("ts") <= half)))
    with t.begin() as txn:
        txn.put("0000000002", "own")
        txn.delete("0000000003")
        t.load_versions(_binary(log.where(F.col("ts") > half)))
    return _text(t.scan())


def txn_conflicts(spark, sf):
    """A serializable transaction for each type of event reads the type's key and writes another; a
    batch between changes the keys of even counts."""
    counts = _type_counts(spark, sf)
    t = VersionedTable.at(spark, _workdir(spark), Options(serializable=True))
    t.write_batch([Put(k, str(n)) for k, n in counts.items()])
    txns = {k: t.begin() for k in counts}
    for k, txn in txns.items():
        txn.get(k)
        txn.put(f"seen {k}", "x")
    t.write_batch([Put("~end", "x"), *(Put(k, "new") for k, n in counts.items() if n % 2 == 0)])

    def commits(txn) -> bool:
        try:
            txn.commit()
        except ConflictError:
            return False
        return True

    return spark.createDataFrame([(k, commits(txn), t.get(f"seen {k}") is not None) for k, txn in txns.items()], "key string, committed boolean, visible boolean")


def txn_scan_conflicts(spark, sf):
    """The same for transactions that scan from their type's key onwards: a batch conflicts if it changes any
    key that the scan returned."""
    counts = _type_counts(spark, sf)
    t = VersionedTable.at(spark, _workdir(spark), Options(serializable=True))
    t.write_batch([Put(k, str(n)) for k, n in counts.items()])
    txns = {k: t.begin() for k in counts}
    for k, txn in txns.items():
        txn.scan(KeyRange(included(k.encode()), ALL_KEYS.upper))
        txn.put(f" {k}", "x")
    t.write_batch([Put("~end", "x"), *(Put(k, "new") for k, n in counts.items() if n % 2 == 0)])
    out = []
    for k, txn in txns.items():
        try:
            txn.commit()
            out.append((k, True))
        except ConflictError:
            out.append((k, False))
    return spark.createDataFrame(out, "key string, committed boolean")


QUERIES = {f.__name__: f for f in (snapshot_scan, latest_scan, range_scan, inverted_range, point_get, seek, first_n, prefix_scan, key_only_scan, version_history, version_count, newest_run_wins, run_merge, two_way_merge, txn_overlay, gc_unversioned, run_meta, run_prune, run_prune_range, run_overlap, occ_conflicts, batch_last_wins, out_split, space_amp, time_travel_diff, latest_by_user_typed, table_scan, table_compacted, table_leveled, table_range, table_seek, table_prefix, table_history, table_diff, table_get, table_facts, table_source, table_vacuumed, ingest_stream, buffer_scan, buffer_get, recovered_scan, flushed_files, txn_scan, txn_commit, txn_conflicts, txn_scan_conflicts)}
QUERIES |= {f"bounds_{low}_{high}": _range(ENDS[low][0], ENDS[high][1]) for low in ENDS for high in ENDS}
QUERIES |= {"table_simple": _compacted_by(SimpleLeveled()), "table_tiered": _compacted_by(Tiered(num_tiers=3))}
QUERIES |= {"gc_nonbottom": _gc(False), "gc_bottom": _gc(True), "gc_filter": _gc(True, ("000000001",))}

SQL = {
    "snapshot_scan": snap_sql(f"ts <= {HALF}"),
    "latest_scan": snap_sql("TRUE"),
    "range_scan": snap_sql(f"ts <= {HALF} AND key > '0000000010' AND key <= '0000000050'"),
    "inverted_range": snap_sql("key >= '0000000012' AND key <= '0000000003'"),
    "point_get": snap_sql(f"ts <= {HALF} AND key = '0000000002'"),
    "seek": snap_sql("key >= '0000000010x'") + " ORDER BY key LIMIT 1",
    "first_n": snap_sql("key > '0000000002'") + " ORDER BY key LIMIT 10",
    "prefix_scan": snap_sql("starts_with(key, '000000001')"),
    "key_only_scan": snap_sql("TRUE", "key"),
    "version_history": f"WITH {LOG} SELECT key, ts, value FROM log WHERE key = '0000000002'",
    "version_count": f"WITH {LOG} SELECT key, count(*) AS n_versions, count(*) FILTER (value IS NULL) AS n_deletions, max(ts) AS max_ts FROM log GROUP BY key",
    "newest_run_wins": f"WITH {LOG} SELECT key, run_id, value FROM ({newest_sql('TRUE', 'run_id DESC, ts DESC')}) s WHERE value IS NOT NULL",
    "run_merge": f"WITH {LOG}, a AS (SELECT *, run_id % 3 AS prio FROM log), b AS (SELECT *, row_number() OVER (PARTITION BY key, prio ORDER BY ts DESC) AS r FROM a) SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY prio) AS q FROM b WHERE r = 1) c WHERE q = 1",
    "two_way_merge": f"WITH {LOG} SELECT key, value FROM ({newest_sql()}) s",
    "txn_overlay": f"WITH {LOG} SELECT key, value FROM ({newest_sql(f'ts <= {HALF} + 100')}) s WHERE value IS NOT NULL",
    "gc_unversioned": f"WITH {LOG}, a AS (SELECT *, run_id % 2 AS prio FROM log) SELECT key, value FROM ({newest_sql('TRUE', 'prio, ts DESC', 'a')}) c WHERE value IS NOT NULL",
    "run_meta": f"WITH {LOG} SELECT run_id, min(key) AS first_key, max(key) AS last_key, min(ts) AS min_ts, max(ts) AS max_ts, count(*) AS n_rows FROM log GROUP BY run_id",
    "run_prune": f"WITH {LOG} SELECT run_id FROM log GROUP BY run_id HAVING min(key) <= '0000000000' AND max(key) >= '0000000000'",
    "run_prune_range": f"WITH {LOG} SELECT run_id FROM log GROUP BY run_id HAVING max(key) > '0000000010' AND min(key) < '0000000011'",
    "run_overlap": f"WITH {LOG}, r AS (SELECT run_id, min(key) AS f, max(key) AS l FROM log GROUP BY run_id) SELECT a.run_id AS run_a, b.run_id AS run_b FROM r a JOIN r b ON a.f <= b.l AND b.f <= a.l AND a.run_id < b.run_id",
    "occ_conflicts": f"WITH {LOG} SELECT DISTINCT t.ts AS txn FROM log t JOIN log w ON t.key = w.key AND w.ts > t.ts - 40 AND w.ts < t.ts",
    "batch_last_wins": f"WITH {LOG} SELECT run_id, key, ts AS ord, value FROM (SELECT *, row_number() OVER (PARTITION BY run_id, key ORDER BY ts DESC) AS rn FROM log) s WHERE rn = 1",
    "out_split": f"WITH {LOG}, k AS (SELECT key, cast(sum(length(key) + coalesce(length(value), 0) + 8) AS bigint) AS key_bytes FROM log GROUP BY key) SELECT key, key_bytes, cast(floor(coalesce(sum(key_bytes) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 16384) AS bigint) AS file_no FROM k",
    "space_amp": f"WITH {LOG} SELECT (SELECT count(*) FROM log) AS stored, (SELECT count(*) FROM ({newest_sql()}) s WHERE value IS NOT NULL) AS live",
    "time_travel_diff": f"""WITH {LOG}, o AS (SELECT key, value FROM ({newest_sql(f'ts <= {HALF}')}) a), n AS (SELECT key, value FROM ({newest_sql('ts <= (SELECT cast(floor(max(ts) * 0.6) AS bigint) FROM log)')}) b)
SELECT n.key, o.value AS old_value, n.value AS new_value, CASE WHEN o.value IS NULL THEN 'insert' WHEN n.value IS NULL THEN 'delete' ELSE 'update' END AS change FROM n LEFT JOIN o ON n.key = o.key WHERE o.value IS DISTINCT FROM n.value""",
    "latest_by_user_typed": "SELECT user_id, event_id, event_type, value AS amount FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) s WHERE rn = 1",
    "table_scan": snap_sql("key > '0000000002'", "key, value"),
    "table_compacted": f"WITH {LOG}, w AS (SELECT *, {HALF} AS w FROM log), m AS (SELECT *, row_number() OVER (PARTITION BY key, ts <= w ORDER BY ts DESC) AS rn, max(ts) OVER (PARTITION BY key) AS mx FROM w) SELECT key, ts, value FROM m WHERE ts > w OR (rn = 1 AND NOT (value IS NULL AND ts = mx))",
    "table_leveled": snap_sql("TRUE", "key, value"),
    "table_simple": snap_sql("TRUE", "key, value"),
    "table_tiered": snap_sql("TRUE", "key, value"),
    "gc_nonbottom": _gc_sql(False),
    "gc_bottom": _gc_sql(True),
    "gc_filter": _gc_sql(True, "000000001"),
}
TYPES = "t AS (SELECT event_type AS key, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type)"
BATCHES = "SELECT key, cast(n AS varchar) AS value FROM t WHERE n % 2 = 1 UNION ALL SELECT '~end', 'x'"
AT = "SELECT * FROM (VALUES ('start', 0), ('half', (SELECT cast(floor(max(ts) * 0.5) AS bigint) FROM log)), ('end', (SELECT max(ts) FROM log))) a(as_of, at_ts)"
OWN = "SELECT key, value FROM s WHERE value IS NOT NULL AND key NOT IN ('0000000002', '0000000003') UNION ALL SELECT '0000000002', 'own'"
SQL |= {
    "table_range": snap_sql(f"ts <= {HALF} AND key > '0000000010' AND key <= '0000000050'", "key, value"),
    "table_seek": snap_sql("key >= '0000000010x'", "key, value") + " ORDER BY key LIMIT 1",
    "table_prefix": snap_sql("starts_with(key, '000000001')", "key, value"),
    "table_history": SQL["version_history"],
    "table_diff": SQL["time_travel_diff"],
    "table_get": f"WITH {LOG}, a AS ({AT}), k AS (SELECT unnest(['0000000002', '0000000010x']) AS key) SELECT k.key, a.as_of, (SELECT max_by(coalesce(l.value, '-'), l.ts) FROM log l WHERE l.key = k.key AND l.ts <= a.at_ts) AS v FROM k, a",
    "table_facts": f"WITH {LOG} SELECT min(key) AS first_key, max(key) AS last_key, min(ts) AS min_ts, max(ts) AS max_ts, cast(count(*) AS bigint) AS n_rows FROM log",
    "table_source": snap_sql(f"ts <= {HALF}", "key, value"),
    "table_vacuumed": snap_sql("TRUE", "key, value"),
    "ingest_stream": snap_sql("TRUE", "key, value"),
    "buffer_scan": f"WITH {TYPES} {BATCHES}",
    "buffer_get": f"WITH {TYPES} SELECT key, CASE WHEN n % 2 = 1 THEN cast(n AS varchar) END AS value FROM t UNION ALL SELECT '~absent', NULL",
    "recovered_scan": f"WITH {TYPES} SELECT key, value, cast(2 AS bigint) AS latest_ts FROM ({BATCHES}) b",
    "flushed_files": f"WITH {TYPES}, b AS (SELECT cast(1 AS bigint) AS ts, key FROM t UNION ALL SELECT 2, key FROM t WHERE n % 2 = 0 UNION ALL SELECT 2, '~end') SELECT min(key) AS first_key, max(key) AS last_key, ts AS min_ts, ts AS max_ts, count(*) AS n_rows FROM b GROUP BY ts",
    "txn_scan": f"WITH {LOG}, s AS ({newest_sql(f'ts <= {HALF}')}) {OWN}",
    "txn_commit": f"WITH {LOG}, s AS ({newest_sql()}) {OWN}",
    "txn_conflicts": f"WITH {TYPES} SELECT key, n % 2 = 1 AS committed, n % 2 = 1 AS visible FROM t",
    "txn_scan_conflicts": f"WITH {TYPES} SELECT key, NOT EXISTS (SELECT 1 FROM t u WHERE u.key >= t.key AND u.n % 2 = 0) AS committed FROM t",
}
SQL["table_get"] = f"SELECT key, as_of, CASE WHEN v <> '-' THEN v END AS value FROM ({SQL['table_get']}) g"
SQL |= {f"bounds_{low}_{high}": snap_sql(f"{SQL_LOW[low]} AND {SQL_HIGH[high]}") for low in ENDS for high in ENDS}
