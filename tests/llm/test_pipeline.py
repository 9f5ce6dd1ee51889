"""The pipeline stage by stage against plain Python, and the registered queries against DuckDB."""

import collections
import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tidemark.llm import bpe, queries

from .test_groups import W, dedup_by_hand, find_components, fingerprint
from .test_rows import base_measures

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no generated tables")


def run_stage(spark, k, docs):
    out = corpus_pipeline.STAGES[k][1](spark, docs, DATA)
    return out, out.collect()


def test_stages(spark, corpus):
    seen, rows = set(), []
    for r in corpus:
        if r[0] is not None and r[0] not in seen:
            seen.add(r[0])
            rows.append(r)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    docs, got = run_stage(spark, 0, docs)
    kept = {r["doc_id"] for r in got}
    assert not any(base_measures(t)[5] for i, t, *_ in rows if i in kept)
    rows = [tuple(r) for r in got]

    docs, got = run_stage(spark, 1, docs)
    want = dedup_by_hand(rows)
    assert {r["doc_id"]: r["text"] for r in got} == {i: want[(i, t)] for i, t, *_ in rows}
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    rows = [tuple(r) for r in got]

    docs, got = run_stage(spark, 2, docs)
    fps = [(i, fingerprint(t)) for i, t, *_ in rows]
    whole = find_components({i for i, _ in fps}, [(a, b) for a, x in fps for b, y in fps if (x ^ y).bit_count() <= 3])
    assert {r["doc_id"] for r in got} == set(whole.values()) and len(got) == len(set(whole.values()))
    rows = [tuple(r) for r in got]

    docs, got = run_stage(spark, 3, docs)
    times = collections.Counter(r["doc_id"] for r in got)
    assert set(times) <= {r[0] for r in rows} and max(times.values()) <= 3
    assert sum(len(W.findall(r["text"])) for r in got) <= sum(len(W.findall(r[1])) for r in rows)
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    out, got_ids = run_stage(spark, 4, docs)
    b = bpe.SegmentTreeBpe(bpe.default_path())
    assert collections.Counter((r["doc_id"], r["n_tokens"]) for r in got_ids) == collections.Counter((r["doc_id"], len(b.library.encode(r["text"], add_special_tokens=False).ids)) for r in got)


@tables
def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 50 and corpus_pipeline.ORACLE_SQL is None
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in ("documents", "pages", "conversations"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return c


@tables
@pytest.mark.parametrize("name", queries.SQL)
def test_sql(spark, duck, name):
    want = duck.execute(queries.SQL[name])
    columns = [d[0] for d in want.description]
    plain = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert plain(map(tuple, queries.QUERIES[name](spark, DATA).select(*columns).collect())) == plain(want.fetchall())


@tables
def test_all_queries_are_registered(spark):
    names = entry.queries()
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names


def test_nothing_else_needs_this_package():
    import subprocess
    import sys

    code = "import sys; sys.modules['tidemark.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.abspath(entry.__file__)), capture_output=True, text=True)
    assert said.returncode == 0 and int(said.stdout) > 30, said.stderr
