import uuid

import pytest

from tidemark.functions.keys import Delete, KeyRange, Put, excluded, included
from tidemark.sources.table import ClosedError, ConflictError, Options, VersionedTable, Watermark


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable.at(spark, f"file://{tmp_path}/{uuid.uuid4().hex}", Options(serializable=True))


def rows(df):
    return [(bytes(r["key"]).decode(), bytes(r["value"]).decode()) for r in df.collect()]


def start(t):
    t.write_batch([Put("key1", "1"), Put("key2", "2")])


def test_overlay(table):
    t1, t2 = table.begin(), table.begin()
    t1.put("test1", "233")
    t2.put("test2", "233")
    t3 = table.begin()
    t1.commit(), t2.commit()
    assert rows(t3.scan()) == [] and t3.get("test1") is None
    t4 = table.begin()
    assert rows(t4.scan()) == [("test1", "233"), ("test2", "233")]
    t4.put("test2", "2333")
    assert t4.get("test2") == b"2333" and rows(t4.scan()) == [("test1", "233"), ("test2", "2333")]
    t4.delete("test2")
    assert rows(t4.scan()) == [("test1", "233")] and t4.get("test2") is None
    table.flush()
    assert rows(t3.scan()) == []


def test_write_skew_aborts(table):
    start(table)
    t1, t2 = table.begin(), table.begin()
    t1.put("key1", t1.get("key2"))
    t2.put("key2", t2.get("key1"))
    t1.commit()
    with pytest.raises(ConflictError):
        t2.commit()
    with pytest.raises(ClosedError):
        t2.get("key1")
    assert (table.get("key1"), table.get("key2")) == (b"2", b"2")


def test_blind_writes_commit(table):
    t1, t2 = table.begin(), table.begin()
    t1.put("key1", "1"), t2.put("key1", "2")
    t1.commit(), t2.commit()
    assert table.get("key1") == b"2"


def test_later_transactions_do_not_conflict(table):
    start(table)
    t1 = table.begin()
    t1.put("key1", t1.get("key2"))
    t1.commit()
    t2 = table.begin()
    t2.put("key2", t2.get("key1"))
    t2.commit()
    assert (table.get("key1"), table.get("key2")) == (b"2", b"2")


@pytest.mark.parametrize("flush", [False, True])
def test_scans_are_reads(table, flush):
    start(table)
    if flush:
        table.flush()
    t1, t2 = table.begin(), table.begin()
    t2.scan()
    t1.put("key1", "9")
    t1.commit()
    t2.put("key2", "3")
    with pytest.raises(ConflictError):
        t2.commit()


def test_readers_always_commit(table):
    start(table)
    t1 = table.begin()
    t1.get("key1")
    table.put("key1", "9")
    t1.commit()
    with pytest.raises(ClosedError):
        t1.commit()


def test_phantoms_only_conflict_under_range_isolation(spark, tmp_path):
    for isolation in ("keys", "range"):
        t = VersionedTable.at(spark, f"file://{tmp_path}/{isolation}", Options(serializable=True, isolation=isolation))
        start(t)
        t1 = t.begin()
        t1.scan(KeyRange(included(b"key1"), excluded(b"key2")))
        t.put("key11", "new")
        t1.put("z", "1")
        if isolation == "range":
            with pytest.raises(ConflictError):
                t1.commit()
        else:
            t1.commit()


@pytest.mark.parametrize("key, conflict", [("key1", True), ("other", False)])
def test_bulk_loads_conflict_too(spark, table, key, conflict):
    start(table)
    t1 = table.begin()
    t1.get("key1")
    t1.put("z", "1")
    table.write_frame(spark.createDataFrame([(key, "9"), ("a", "1"), ("zz", "2")], "key string, value string"))
    if conflict:
        with pytest.raises(ConflictError):
            t1.commit()
    else:
        t1.commit()


def test_empty_value_deletes_in_transactions(table):
    start(table)
    table.put("key1", "")
    assert table.get("key1") is None


def test_conflicts_across_processes(spark, tmp_path):
    path, o = f"file://{tmp_path}/two", Options(serializable=True)
    a, b = VersionedTable.at(spark, path, o), VersionedTable.at(spark, path, o)
    start(a)
    b._catch_up()
    t = b.begin()
    t.get("key1")
    t.put("key2", "x")
    a.put("key1", "changed")
    with pytest.raises(ConflictError):
        t.commit()


def test_watermark():
    w = Watermark()
    for ts in (2000, 2000, 2001):
        w.add(ts)
    assert (w.lowest(), len(w)) == (2000, 2)
    w.remove(2000)
    assert w.lowest() == 2000
    w.remove(2000)
    assert w.lowest() == 2001
    w.remove(2001)
    assert w.lowest() is None


def test_readers_leave_when_dropped(table):
    start(table)
    t = table.begin()
    table.put("key1", "7")
    assert table.watermark() == 1
    del t
    __import__("gc").collect()
    assert table.watermark() == 2


def test_context_manager(table):
    with table.begin() as t:
        t.put("a", "1")
    assert table.get("a") == b"1"
    with pytest.raises(RuntimeError), table.begin() as t:
        t.put("a", "2")
        raise RuntimeError
    assert table.get("a") == b"1" and len(table.readers) == 0


def test_many_written_keys_are_checked_by_one_join(spark, tmp_path):
    t = VersionedTable.at(spark, f"file://{tmp_path}/t", Options(serializable=True))
    t.write_frame(spark.createDataFrame([(f"k{i:05}", "0") for i in range(50)], "key string, value string"))
    for written, fails in (([f"n{i:05}" for i in range(10_000)], False), ([f"n{i:05}" for i in range(9_999)] + ["k00007"], True)):
        a, b = t.begin(), t.begin()
        a.scan().count()
        a.put("own", "1")
        for k in written:
            b.put(k, "2")
        b.commit()
        t.get = lambda *_: pytest.fail("a job a key")
        try:
            if fails:
                with pytest.raises(ConflictError):
                    a.commit()
            else:
                a.commit()
                t.full_compaction()
                t.write_batch([Delete(k) for k in written])
        finally:
            del t.get
    t.close()
