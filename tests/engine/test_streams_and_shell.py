import uuid

from tidemark import cli
from tidemark.plans.simple import SimpleLeveled
from tidemark.sources.table import Options, VersionedTable
from tidemark.streaming.ingest import ingest, latest_values


def write(spark, folder, rows):
    spark.createDataFrame(rows, "key string, value string, n long").coalesce(1).write.mode("append").parquet(folder)


def test_ingest_is_exactly_once(spark, tmp_path):
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    write(spark, source, [("a", "1", 1), ("b", "1", 2), ("a", "2", 3)])
    t = VersionedTable.at(spark, f"file://{tmp_path}/t", Options(policy=SimpleLeveled()))
    stream = lambda: spark.readStream.schema("key string, value string, n long").parquet(source)
    ingest(stream(), t, "job", check, "n").awaitTermination()
    write(spark, source, [("b", None, 4), ("c", "3", 5)])
    ingest(stream(), t, "job", check, "n").awaitTermination()
    want = {b"a": b"2", b"c": b"3"}
    got = lambda: {bytes(r["key"]): bytes(r["value"]) for r in t.scan().collect()}
    assert got() == want and dict(t.state.apps) == {"job": 1} and t.state.latest_ts == 2
    # A replay from the start, as after a lost checkpoint, commits nothing again.
    ingest(stream(), t, "job", str(tmp_path / "check2"), "n").awaitTermination()
    assert got() == want and t.state.latest_ts == 2


def test_latest_values(spark, tmp_path):
    source = str(tmp_path / "in")
    kind = "key string, ts long, value string"
    spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, None)], kind).coalesce(1).write.parquet(source)
    name = "latest_" + uuid.uuid4().hex
    q = latest_values(spark.readStream.schema(kind).parquet(source)).writeStream.outputMode("update").format("memory").queryName(name).start()
    q.processAllAvailable()
    spark.createDataFrame([("a", 2, "late"), ("b", 5, "z")], kind).coalesce(1).write.mode("append").parquet(source)
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table(name).collect()} == {("a", 3, "y"), ("b", 2, None), ("b", 5, "z")}


def test_shell(spark, tmp_path):
    t = VersionedTable.at(spark, f"file://{tmp_path}/t")
    said = []
    cli.run(t, ["fill 1 12", "del 3", "get 3", "get 4", "scan 10 2", "flush", "scan", "full_compaction", "dump", "nonsense", "quit"], said.append)
    assert said[0] == "round 0 wrote 12 rows"
    assert "3 does not exist" in said and "4=value4@0" in said
    # Keys are text: 10, 11, 12, 2 lie between "10" and "2".
    assert said[said.index("rows in range: 4") - 1] == "2=value2@0" and "rows in range: 11" in said
    assert said[-1] == "not a command: nonsense" and not t.open
