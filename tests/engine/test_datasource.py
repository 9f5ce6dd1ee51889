import pytest

from tidemark.functions.keys import Delete, Put
from tidemark.operators import resolve
from tidemark.plans.leveled import Leveled
from tidemark.sources.datasource import register
from tidemark.sources.table import Options, VersionedTable


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    register(spark)
    t = VersionedTable.at(spark, f"file://{tmp_path_factory.mktemp('ds')}/t", Options(policy=Leveled(base_level_size_mb=1)))
    for i in range(4):
        t.write_batch([Put(f"k{i}", str(i)), Put("a", str(i)), Delete(f"k{i - 1}") if i else Put("z", "0")])
        t.flush()
        t.maintain()
    t.write_frame(spark.createDataFrame([("m", "bulk"), ("a", "bulk")], "key string, value string"))
    t.put("k9", "buffered")
    return t


def test_versions(spark, table):
    got = spark.read.format("tidemark").option("path", table.path).load()
    plain = lambda df: sorted((bytes(r["key"]), r["ts"], None if r["value"] is None else bytes(r["value"])) for r in df.collect())
    assert plain(got) == plain(table.versions())
    assert plain(resolve.snapshot(got)) == plain(resolve.snapshot(table.versions()))
    early = spark.read.format("tidemark").option("path", table.path).option("read_ts", "2").option("lower", "a").option("upper", "k0").load()
    assert plain(early) == [r for r in plain(table.versions()) if r[1] <= 2 and b"a" <= r[0] <= b"k0"]


def test_filters_prune_files(spark, table):
    df = spark.read.format("tidemark").option("path", table.path).load().where("key = X'6D'")
    assert [bytes(r["value"]) for r in df.collect()] == [b"bulk"]


def test_state_files_torn_tails_and_retired_logs(spark, tmp_path):
    """Another process's table: opened from a state file, without retired records, and with a torn last one."""
    register(spark)
    plain = lambda df: sorted((bytes(r["key"]), r["ts"], None if r["value"] is None else bytes(r["value"])) for r in df.collect())
    root = tmp_path / "a table, 100%"
    t = VersionedTable.at(spark, f"file://{root}", Options(policy=Leveled(base_level_size_mb=1)))
    for i in range(70):
        t.write_batch([Put(f"k{i % 9}", str(i))])
        if i % 20 == 19:
            t.flush()
    load = lambda: spark.read.format("tidemark").option("path", t.path).load()
    whole = plain(t.versions())
    assert plain(load()) == whole
    logs = root / "_log"
    before = len(list(logs.glob("*.json")))
    assert len(list(logs.glob("*.state"))) >= 2 and t.log.retire(3600) == 0 and t.log.retire(0) > 20
    assert len(list(logs.glob("*.json"))) < before - 20
    assert plain(load()) == whole == plain(VersionedTable.at(spark, t.path, Options(policy=Leveled(base_level_size_mb=1))).versions())
    last = max(logs.glob("*.json"))
    torn = logs / f"{int(last.stem) + 1:020d}.json"
    torn.write_bytes(last.read_bytes()[:-4])
    assert plain(load()) == whole
    torn.unlink()
    last.write_bytes(last.read_bytes()[:-4] + b"zzzz")
    with pytest.raises(Exception, match="checksum"):
        load().collect()
