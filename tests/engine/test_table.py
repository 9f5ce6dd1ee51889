"""Tables: write, flush, reopen, compact, vacuum, corrupt logs."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.functions.keys import ALL_KEYS, BatchError, Delete, KeyRange, Put, excluded, included
from tidemark.operators import resolve
from tidemark.plans.leveled import Leveled
from tidemark.plans.simple import SimpleLeveled
from tidemark.plans.tiered import Tiered
from tidemark.sources.log import CorruptLog
from tidemark.sources.table import ClosedError, Options, VersionedTable


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


def rows(df):
    return [(bytes(r["key"]).decode(), bytes(r["value"]).decode()) for r in df.collect()]


def stored(t):
    return " ".join(bytes(r["key"]).decode() + (bytes(r["value"]).decode() if r["value"] is not None else "_") for r in resolve.history(t.versions()).collect())


def test_scan_over_buffer_and_files(spark, path):
    t = VersionedTable.at(spark, path)
    t.write_batch([Put("0", "2333333"), Put("00", "2333333"), Put("4", "23")])
    t.flush()
    t.write_batch([Delete("4")])
    t.flush()
    t.write_batch([Put("1", "233"), Put("2", "2333"), Put("00", "2333")])
    t.freeze()
    t.write_batch([Put("3", "23333"), Delete("1")])
    at = lambda low, high: rows(t.scan(KeyRange(low, high)))
    assert rows(t.scan()) == [("0", "2333333"), ("00", "2333"), ("2", "2333"), ("3", "23333")]
    assert at(included(b"1"), included(b"2")) == [("2", "2333")]
    assert at(excluded(b"1"), excluded(b"3")) == [("2", "2333")]
    assert at(included(b"0"), included(b"1")) == [("0", "2333333"), ("00", "2333")]
    assert at(excluded(b"0"), included(b"1")) == [("00", "2333")]
    assert at(included(b"3"), included(b"0")) == []
    assert (t.get("0"), t.get("1"), t.get("4"), t.get("3"), t.get("x")) == (b"2333333", None, None, b"23333", None)
    assert rows(t.seek("01")) == [("2", "2333")] and rows(t.prefix("0")) == [("0", "2333333"), ("00", "2333")]


def test_one_timestamp_a_batch(spark, path):
    t = VersionedTable.at(spark, path)
    assert t.write_batch([Put("a", "1"), Put("b", "1")]) == 1
    assert t.write_batch([Put("a", "9"), Put("a", "2"), Delete("b")]) == 2
    assert t.write_batch([]) == 2
    assert stored(t) == "a2 a1 b_ b1" and rows(t.scan()) == [("a", "2")]


@pytest.mark.parametrize("bad", [Put("", "1"), Put("a", ""), Put("k" * 65_536, "1"), Put("a", "v" * 65_536), Delete("")])
def test_batches_are_checked_whole(spark, path, bad):
    t = VersionedTable.at(spark, path)
    with pytest.raises(BatchError):
        t.write_batch([Put("ok", "1"), bad])
    assert t.get("ok") is None and t.state.latest_ts == 0
    t.write_batch([Put("k" * 65_535, "v" * 65_535)])
    assert len(t.get("k" * 65_535)) == 65_535


@pytest.mark.parametrize("durable", [True, False])
def test_reopen(spark, path, durable):
    t = VersionedTable.at(spark, path, Options(policy=SimpleLeveled(), durable_writes=durable))
    for i in range(7):
        t.write_batch([Put("0", f"v{i}"), Put("1", f"v{i}") if i % 2 == 0 else Delete("1"), Put("2", f"v{i}") if i % 2 else Delete("2")])
        t.freeze()
        if i in (2, 4):
            t.maintain()
    t.close()
    with pytest.raises(ClosedError):
        t.put("0", "x")
    t = VersionedTable.at(spark, path, Options(policy=SimpleLeveled(), durable_writes=durable))
    assert (t.get("0"), t.get("1"), t.get("2"), t.state.latest_ts) == (b"v6", b"v6", None, 7)
    assert t.write_batch([Put("3", "x")]) == 8


def test_buffer_without_log_is_lost_with_the_process(spark, path):
    t = VersionedTable.at(spark, path, Options(durable_writes=False))
    t.put("a", "1")
    t.sync()
    t.put("b", "2")
    t = VersionedTable.at(spark, path, Options(durable_writes=False))
    assert rows(t.scan()) == [("a", "1")]


def test_reopen_after_full_compaction(spark, path):
    t = VersionedTable.at(spark, path)
    for i in range(3):
        t.write_batch([Put("a", str(i)), Put(f"b{i}", "1")])
        t.flush()
    t.full_compaction()
    assert stored(t) == "a2 b01 b11 b21"
    assert t._sorted_once(t.state, ALL_KEYS)
    plan = t.scan()._jdf.queryExecution().executedPlan().toString()
    assert "max_by" not in plan  # one sorted run with a key once: nothing to resolve
    t = VersionedTable.at(spark, path)
    assert rows(t.scan()) == [("a", "2"), ("b0", "1"), ("b1", "1"), ("b2", "1")]
    with pytest.raises(ValueError):
        VersionedTable.at(spark, path + "x", Options(policy=Tiered())).full_compaction()


def test_garbage_collection_follows_open_snapshots(spark, path):
    t = VersionedTable.at(spark, path)
    s0 = t.begin()
    t.put("a", "1"), t.put("b", "1")
    s1 = t.begin()
    t.put("a", "2"), t.put("d", "2")
    s2 = t.begin()
    t.put("a", "3"), t.delete("d")
    s3 = t.begin()
    t.put("c", "4"), t.delete("a")
    t.flush()
    for drop, want in ((None, "a_ a3 a2 a1 b1 c4 d_ d2"), (s0, "a_ a3 a2 a1 b1 c4 d_ d2"), (s1, "a_ a3 a2 b1 c4 d_ d2"), (s2, "a_ a3 b1 c4"), (s3, "b1 c4")):
        if drop:
            assert rows(drop.scan()) == {s0: [], s1: [("a", "1"), ("b", "1")], s2: [("a", "2"), ("b", "1"), ("d", "2")], s3: [("a", "3"), ("b", "1")]}[drop]
            drop.rollback()
        t.full_compaction()
        assert stored(t) == want


def test_compaction_filter(spark, path):
    t = VersionedTable.at(spark, path)
    keys = [f"{p}_{k}" for p in ("table1", "table2") for k in "abc"]
    t.write_batch([Put(k, "1") for k in keys])
    snapshot = t.begin()
    t.write_batch([Delete(k) if k.endswith("b") else Put(k, "2") for k in keys])
    t.flush()
    t.add_filter("table2_")
    t.full_compaction()
    assert stored(t) == "table1_a2 table1_a1 table1_b_ table1_b1 table1_c2 table1_c1 table2_a2 table2_b_ table2_c2"
    snapshot.rollback()
    t.full_compaction()
    assert stored(t) == "table1_a2 table1_c2"


@pytest.mark.parametrize("policy", [SimpleLeveled(), Tiered(num_tiers=3), Leveled(base_level_size_mb=1)], ids=lambda p: p.name)
def test_policies_keep_what_a_dict_keeps(spark, path, policy):
    t, model, rng = VersionedTable.at(spark, path, Options(policy=policy, file_bytes=4000)), {}, random.Random(5)
    for r in range(5):
        batch = []
        for _ in range(120):
            k = f"{rng.randrange(50 * r, 50 * r + 120):010}"
            if rng.random() < 0.2:
                batch.append(Delete(k))
                model.pop(k, None)
            else:
                batch.append(Put(k, f"{r}-{rng.random()}"))
                model[k] = batch[-1].value
        t.write_batch(batch)
        t.maintain()
    assert rows(t.scan()) == sorted(model.items())
    for k in rng.sample(sorted(model), 3):
        assert t.get(k).decode() == model[k]
    files = t.state.layout.files()
    assert all(f.first_key <= f.last_key for f in files)
    assert {p for p, _ in t.log.data_files()} >= {f.path.replace("file:///", "file:/") for f in files}
    t = VersionedTable.at(spark, path, Options(policy=policy, file_bytes=4000))
    assert rows(t.scan()) == sorted(model.items())


def test_a_key_never_straddles_files(spark, path):
    t = VersionedTable.at(spark, path, Options(file_bytes=20_000))
    keep = t.begin()
    for i in range(40):
        t.write_batch([Put("0", random.Random(i).randbytes(2000)), Put(f"k{i}", random.Random(-i).randbytes(2000))])
    t.flush_all()
    t.full_compaction()
    files = t.state.layout.level(1)
    assert len(files) > 1 and sum(f.first_key <= b"0" <= f.last_key for f in files) == 1
    assert sum(f.rows for f in files) == 80
    keep.rollback()


def test_bulk_writes(spark, path):
    t = VersionedTable.at(spark, path)
    df = spark.range(1000).selectExpr("lpad(id % 700, 5, '0') AS key", "CAST(id AS string) AS value", "id")
    assert t.write_frame(df, "job", 0, "id") == 1
    assert t.write_frame(df, "job", 0, "id") is None
    t.put("00001", "new")
    assert t.write_frame(spark.sql("SELECT '00002' AS key, CAST(NULL AS string) AS value")) == 3
    got = dict(rows(t.scan()))
    assert len(got) == 699 and got["00000"] == "700" and got["00001"] == "new" and got["00699"] == "699"
    assert {r["ts"] for r in t.versions().select("ts").collect()} == {1, 2, 3}
    with pytest.raises(BatchError):
        t.write_frame(spark.sql("SELECT '' AS key, 'x' AS value"))
    t.flush()
    t.full_compaction()
    assert dict(rows(VersionedTable.at(spark, path).scan())) == got


def test_pruning_reads_fewer_files(spark, path):
    t = VersionedTable.at(spark, path)
    for i in range(4):
        t.write_batch([Put(f"{j:03}", "x") for j in range(i * 10, i * 10 + 10)])
        t.flush()
    inputs = lambda df: len(df.inputFiles())
    assert inputs(t.scan()) == 4 and inputs(t.scan(KeyRange(included(b"015"), excluded(b"020")))) == 1
    assert inputs(t.versions(read_ts=2)) == 2


def test_vacuum_spares_open_snapshots(spark, path):
    t = VersionedTable.at(spark, path)
    t.put("a", "1")
    t.flush()
    s = t.begin()
    t.put("a", "2")
    t.flush()
    t.full_compaction()
    assert len(t.vacuum(0)) == 1 and rows(s.scan()) == [("a", "1")]
    assert t.vacuum(3600) == []
    s.rollback()
    assert len(t.vacuum(0)) == 1 and t.get("a") == b"2"


def log_file(path, n):
    return path.removeprefix("file://") + f"/_log/{n:020d}.json"


def test_torn_and_corrupt_logs(spark, path):
    t = VersionedTable.at(spark, path)
    for i in range(3):
        t.put("a", str(i))
    whole = open(log_file(path, 2), "rb").read()
    local = path.removeprefix("file://")
    for f in __import__("glob").glob(f"{local}/_log/.*.crc"):
        __import__("os").remove(f)
    for cut in (0, 3, len(whole) - 1):
        open(log_file(path, 2), "wb").write(whole[:cut])
        assert VersionedTable.at(spark, path).get("a") == b"1"  # the torn file is dropped
        open(log_file(path, 2), "wb").write(whole)
    for i in range(0, len(whole), 17):
        bad = bytearray(whole)
        bad[i] ^= 0x10
        open(log_file(path, 2), "wb").write(bad)
        try:
            assert VersionedTable.at(spark, path).get("a") == b"1"
        except CorruptLog:
            pass
    open(log_file(path, 2), "wb").write(whole)
    open(log_file(path, 1), "wb").write(whole[:10])
    with pytest.raises(CorruptLog):
        VersionedTable.at(spark, path)
    __import__("os").remove(log_file(path, 1))
    with pytest.raises(CorruptLog):
        VersionedTable.at(spark, path)


def test_orphans_and_missing_files(spark, path):
    t = VersionedTable.at(spark, path)
    t.put("a", "1")
    t.flush()
    spark.range(3).write.parquet(f"{path}/data/orphan")
    assert rows(VersionedTable.at(spark, path).scan()) == [("a", "1")]
    t.log.delete(t.state.layout.l0[0].path)
    with pytest.raises(Exception):
        VersionedTable.at(spark, path).scan().collect()


def test_two_writers(spark, path):
    a, b = VersionedTable.at(spark, path), VersionedTable.at(spark, path)
    assert a.put("x", "1") == 1
    assert b.put("x", "2") == 2  # loses the race for version 0, takes the next
    assert a.put("y", "3") == 3 and a.get("x") == b"2"


def test_state_files(spark, path):
    t = VersionedTable.at(spark, path)
    for i in range(70):
        t.put(f"k{i % 5}", str(i))
    t.flush()
    assert t.log.versions("state") == [32, 64]
    again = VersionedTable.at(spark, path)
    assert again.state == t.state and again.get("k4") == b"69"


def test_describe(spark, path):
    t = VersionedTable.at(spark, path)
    t.put("a", "1")
    t.flush()
    assert {r["place"] for r in t.describe().collect()} == {"buffer", "l0"}


def test_many_loads_are_one_scan(spark, tmp_path):
    """The plan of a read does not grow with the loads that are not compacted yet."""
    t = VersionedTable.at(spark, f"file://{tmp_path}/a table, 100%", Options())
    for i in range(12):
        t.write_frame(spark.createDataFrame([(f"k{j}", f"v{i}.{j}") for j in range(i, i + 3)], "key string, value string"))
    got = t.scan()
    assert {bytes(r["key"]).decode(): bytes(r["value"]).decode() for r in got.collect()} == {f"k{j}": f"v{min(j, 11)}.{j}" for j in range(14)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("] parquet") == 1
    assert sorted((bytes(r["key"]), r["ts"]) for r in t.versions().collect()) == sorted((f"k{j}".encode(), i + 1) for i in range(12) for j in range(i, i + 3))
    t.close()


def test_background_failures_reach_the_caller(spark, tmp_path, monkeypatch):
    t = VersionedTable.at(spark, f"file://{tmp_path}/t", Options())
    monkeypatch.setattr(t, "maintain", lambda: 1 / 0)
    t.start_background()
    t._thread.join(10)
    with pytest.raises(RuntimeError):
        t.get("a")
    t.close()


def test_vacuum_keeps_live_files_of_folders_with_blanks(spark, tmp_path):
    t = VersionedTable.at(spark, f"file://{tmp_path}/a table, 100%", Options())
    for i in range(2):
        t.write_frame(spark.createDataFrame([("a", str(i))], "key string, value string"))
    t.full_compaction()
    assert len(t.vacuum(0)) == 2 and t.get("a") == b"1"
    t.close()


def rows_read(df):
    """Rows that the plan's scans let out, after row groups and pages are left out."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        p = todo.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif p.nodeName().endswith("QueryStage"):
            todo.append(p.plan())
        elif p.nodeName().startswith("Scan parquet"):
            out += p.metrics().apply("numOutputRows").value()
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return out


def test_row_groups_are_left_out(spark, tmp_path):
    """A Bloom filter answers for a key inside a file's span that the file has not; statistics cut a range."""
    t = VersionedTable.at(spark, f"file://{tmp_path}/t")
    n = 50_000
    t.load_versions(spark.range(n).select(F.format_string("%08d", F.col("id") * 2).alias("key"), (F.col("id") + 1).alias("ts"), F.lit("v").alias("value")))
    absent, present = (t.versions(keys=KeyRange(included(k), included(k))) for k in (b"00050001", b"00050000"))
    assert rows_read(t.versions()) == n
    assert rows_read(absent) == 0 and absent.count() == 0
    assert 0 < rows_read(present) < n and present.count() == 1


def test_write_frame_reads_its_input_once_and_decides_ties(spark, tmp_path):
    t = VersionedTable.at(spark, f"file://{tmp_path}/t")
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = [("a", "1"), ("a", "3"), ("a", None), ("a", "2"), ("b", None)]
    t.write_frame(spark.createDataFrame(rows, "key string, value string").mapInPandas(look, "key string, value string"))
    assert seen.value == len(rows)
    assert [(bytes(r["key"]), bytes(r["value"])) for r in t.scan().collect()] == [(b"a", b"3")]
    for bad in ("NULL AS key, 'x' AS value", "'k' AS key, '' AS value"):
        with pytest.raises(BatchError):
            t.write_frame(spark.sql(f"SELECT {bad}"))
    assert t.state.latest_ts == 1
