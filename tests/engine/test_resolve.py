"""Version resolution on the golden tables of the survey, and against plain Python."""

import random

import pytest

from tidemark.functions.keys import KeyRange, excluded, included, prefix_range
from tidemark.operators import resolve
from tidemark.operators.split import with_file


def frame(spark, rows, kind="key string, ts long, value string"):
    return spark.createDataFrame(rows, kind)


def pairs(df):
    return [(r["key"], r["value"]) for r in df.orderBy("key").collect()]


SNAPSHOTS = [("a", 1, "1"), ("b", 2, "1"), ("a", 3, "2"), ("b", 4, None), ("c", 5, "1"), ("a", 6, "3"), ("b", 7, "3"), ("a", 8, "4"), ("b", 9, None), ("c", 10, "5")]


@pytest.mark.parametrize("ts, want", [(2, "a1 b1"), (3, "a2 b1"), (5, "a2 c1"), (7, "a3 b3 c1"), (8, "a4 b3 c1"), (10, "a4 c5")])
def test_snapshots(spark, ts, want):
    assert " ".join(k + v for k, v in pairs(resolve.snapshot(frame(spark, SNAPSHOTS), ts))) == want


@pytest.mark.parametrize("low, high, want", [(included, included, "abc"), (included, excluded, "ab"), (excluded, included, "bc"), (excluded, excluded, "b")])
def test_bounds(spark, low, high, want):
    log = frame(spark, [("a", 1, "1"), ("b", 2, "2"), ("c", 3, "3")])
    assert "".join(k for k, _ in pairs(resolve.snapshot(log, None, KeyRange(low("a"), high("c"))))) == want


def test_merge_prefers_the_first_run(spark):
    i1, i2, i3 = ([("a", "1.1"), ("b", "2.1"), ("c", "3.1"), ("e", None)], [("a", "1.2"), ("b", "2.2"), ("c", "3.2"), ("d", "4.2")], [("b", "2.3"), ("c", "3.3"), ("d", "4.3")])
    runs = [frame(spark, r, "key string, value string") for r in (i1, i2, i3)]
    assert pairs(resolve.merge_runs(runs)) == [("a", "1.1"), ("b", "2.1"), ("c", "3.1"), ("d", "4.2"), ("e", None)]
    assert pairs(resolve.merge_runs([runs[2], runs[0], runs[1]])) == [("a", "1.1"), ("b", "2.3"), ("c", "3.3"), ("d", "4.3"), ("e", None)]


GC = [("a", 1, "1"), ("b", 2, "1"), ("a", 3, "2"), ("d", 4, "2"), ("a", 5, "3"), ("d", 6, None), ("c", 7, "4"), ("a", 8, None)]


@pytest.mark.parametrize("mark, want", [(0, "a_ a3 a2 a1 b1 c4 d_ d2"), (2, "a_ a3 a2 a1 b1 c4 d_ d2"), (4, "a_ a3 a2 b1 c4 d_ d2"), (6, "a_ a3 b1 c4"), (8, "b1 c4")])
def test_garbage_collection(spark, mark, want):
    kept = resolve.history(resolve.collect(frame(spark, GC), mark, True)).collect()
    assert " ".join(r["key"] + (r["value"] or "_") for r in kept) == want


def collect_by_hand(rows, mark, bottom, prefixes):
    """One pass over versions in storage order, with the state the rule names."""
    out, seen_key, seen_below = [], set(), set()
    for key, ts, value in sorted(rows, key=lambda r: (r[0], -r[1])):
        first = key not in seen_key
        seen_key.add(key)
        if ts > mark:
            out.append((key, ts, value))
            continue
        if key in seen_below:
            continue
        seen_below.add(key)
        if any(key.startswith(p) for p in prefixes) or (bottom and value is None and first):
            continue
        out.append((key, ts, value))
    return out


def test_garbage_collection_of_random_histories(spark):
    rng = random.Random(4)
    for _ in range(6):
        rows = [(f"k{rng.randrange(9)}", ts, None if rng.random() < 0.3 else str(ts)) for ts in range(1, 60)]
        mark, bottom, prefixes = rng.randrange(60), rng.random() < 0.5, rng.choice([[], ["k1"], ["k"]])
        got = [tuple(r) for r in resolve.history(resolve.collect(frame(spark, rows), mark, bottom, prefixes)).collect()]
        assert got == collect_by_hand(rows, mark, bottom, prefixes)


def test_deletion_below_the_mark_with_a_newer_version_stays(spark):
    rows = [("a", 1, "1"), ("a", 2, None), ("a", 9, "9")]
    assert resolve.collect(frame(spark, rows), 5, True).count() == 2


def test_filters_reach_only_settled_versions(spark):
    rows = [("table2_a", 1, "1"), ("table2_a", 9, "2"), ("table1_a", 1, "1")]
    got = resolve.history(resolve.collect(frame(spark, rows), 5, False, ["table2_"])).collect()
    assert [(r["key"], r["ts"]) for r in got] == [("table1_a", 1), ("table2_a", 9)]


def test_overlay_reads_own_writes(spark):
    base = frame(spark, [("a", 1, "1"), ("b", 2, "2"), ("c", 3, None)])
    own = frame(spark, [("b", None), ("c", "9"), ("d", "7")], "key string, value string")
    assert pairs(resolve.overlay(base, own)) == [("a", "1"), ("c", "9"), ("d", "7")]


def test_filters_are_pushed_below_the_choice_of_version(spark, tmp_path):
    frame(spark, SNAPSHOTS).write.parquet(str(tmp_path / "log"))
    df = resolve.snapshot(spark.read.parquet(str(tmp_path / "log")), 5, KeyRange(included("a"), excluded("c")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key,a)" in plan and "LessThan(key,c)" in plan and "LessThanOrEqual(ts,5)" in plan
    assert "partial_max_by" in plan


def test_files_cut_at_key_boundaries(spark):
    rows = [(f"k{i % 40:02}", i, "v" * 50) for i in range(400)]
    files = {r["key"]: (r["file_no"], r["key_bytes"]) for r in with_file(frame(spark, rows), 2000).collect()}
    run = 0
    for key in sorted(files):
        assert files[key] == (run // 2000, 610)
        run += 610


def test_prefix_range():
    assert prefix_range(b"ab") == KeyRange(included(b"ab"), excluded(b"ac"))
    assert prefix_range(b"a\xff") == KeyRange(included(b"a\xff"), excluded(b"b"))
    assert prefix_range(b"\xff").upper.open
    r = KeyRange(excluded(b"b"), included(b"d"))
    assert [r.contains(k) for k in (b"b", b"c", b"d", b"e")] == [False, True, True, False]
    assert not r.overlaps(b"a", b"b") and r.overlaps(b"a", b"b0") and r.overlaps(b"d", b"z") and not r.overlaps(b"d0", b"z")


def test_diff(spark):
    got = {(r["key"], r["old_value"], r["new_value"], r["change"]) for r in resolve.diff(frame(spark, SNAPSHOTS), 3, 5).collect()}
    assert got == {("b", "1", None, "delete"), ("c", None, "1", "insert")}


def test_overlapping_runs_meet_in_one_bin(spark):
    rng = random.Random(31)
    runs = []
    for r in range(300):
        a, b = sorted((rng.randrange(10_000), rng.randrange(10_000)) if r % 9 == 0 else (x := rng.randrange(9_990), x + rng.randrange(10)))
        runs.append((r, f"user{a:06}", f"user{b:06}"))
    runs += [(300, "user000005", "user000005"), (301, "user000005", "user000005"), (302, "u", "v")]
    df = spark.createDataFrame(runs, "run_id long, first_key string, last_key string")
    want = sorted((a, b) for a, fa, la in runs for b, fb, lb in runs if a < b and fa <= lb and fb <= la)
    for d in (df, df.selectExpr("run_id", "cast(first_key AS binary) first_key", "cast(last_key AS binary) last_key")):
        assert sorted(map(tuple, resolve.overlapping_runs(d).collect())) == want
    assert resolve.overlapping_runs(df.limit(0)).count() == 0


def test_conflicts_by_sweep(spark, monkeypatch):
    """Against all pairs, with slices shorter than transactions, ties, a hot key and keys nobody wrote."""
    monkeypatch.setattr(resolve, "SLICE", 16)
    rng = random.Random(32)
    reads = [(t, (c := rng.randrange(400)) - rng.randrange(1, 60), c, rng.choice(["hot", "hot", "a", "b", "c", "none"])) for t in range(400)]
    writes = [(rng.randrange(400), rng.choice(["hot", "a", "b", "c", "d"])) for _ in range(120)]
    got = resolve.conflicts(spark.createDataFrame(reads, "txn long, read_ts long, commit_ts long, key string"), spark.createDataFrame(writes, "commit_ts long, key string"))
    want = sorted({t for t, r, c, k in reads if any(k == kw and r < w < c for w, kw in writes)})
    assert sorted(r["txn"] for r in got.collect()) == want and 0 < len(want) < 400
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "SortMergeJoin" not in got._jdf.queryExecution().analyzed().toString()
