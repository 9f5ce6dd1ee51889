"""The registered queries that SQL cannot express, and the pipeline, on a whole generated table against plain
Python, types included."""

import collections
import hashlib
import os
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from tidemark.llm import bpe, mixing, quality, tokens

from .test_groups import dedup_by_hand, find_components, fingerprint, remove_by_hand
from .test_similar import five_words, jaccard

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no generated tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in ("documents", "embeddings"):
        c.execute(f"CREATE TABLE {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return c


@pytest.fixture(scope="module")
def texts(duck):
    return duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


def rows(spark, name, types):
    out = entry.queries()[name](spark, DATA)
    kinds = dict(out.dtypes)
    assert {c: kinds[c] for c in types} == types
    return sorted(map(tuple, out.select(*types).collect()))


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def test_op2(spark, texts):
    t, want, at = library(tokens.default_path()), [], 0
    for i, text in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert rows(spark, "op2_token_range_coder", {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}) == want


def spelled(t, text):
    ids = t.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))


def test_op3(spark, texts):
    t = library(bpe.default_path())
    want = [(i, *spelled(t, text)) for i, text in texts]
    assert rows(spark, "op3_bpe_segment_tree", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}) == want


def test_op5(spark, texts):
    want = [(i, n, n - len(kept), len(spans), sha(kept)) for i, n, spans, kept in remove_by_hand(texts)]
    assert rows(spark, "op5_suffix_merge", {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}) == want


def test_op7(spark, texts):
    fps = [(i, fingerprint(t)) for i, t in texts]
    whole = find_components([i for i, _ in fps], [(a, b) for k, (a, x) in enumerate(fps) for b, y in fps[:k] if (x ^ y).bit_count() <= 3])
    want = sorted((i, f"{f:016x}", whole[i]) for i, f in fps)
    assert rows(spark, "op7_simhash_pivots", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}) == want


def test_op10(spark, duck):
    found = duck.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    good = [(i, np.array(v, float)) for i, v in found if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    u = np.stack([v / np.linalg.norm(v) for _, v in good])
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    links = dict(zip([i for i, _ in good], hit.sum(1).tolist(), strict=True))
    whole = find_components([i for i, _ in found], [(good[a][0], good[b][0]) for a, b in zip(*np.nonzero(hit), strict=True)])
    want = sorted((i, links.get(i, 0), whole[i], whole[i] == i) for i, _ in found)
    assert rows(spark, "op10_embedding_itq", {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"}) == want


def test_pipeline(spark, duck):
    """Every stage's decisions, by SQL or plain Python, against the rows of the whole run."""
    kept = {i for (i,) in duck.execute(f"SELECT doc_id FROM ({quality.SQL}) x WHERE kept").fetchall()}
    docs = [r for r in duck.execute("SELECT doc_id, text, source FROM documents ORDER BY doc_id").fetchall() if r[0] in kept]
    clean = dedup_by_hand([(i, t) for i, t, _ in docs])
    docs = [(i, clean[(i, t)], s) for i, t, s in docs]
    sets = [five_words(t) for _, t, _ in docs]
    whole = find_components(range(len(docs)), [(a, b) for a in range(len(docs)) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8])
    docs = [docs[k] for k in sorted(set(whole.values()))]
    duck.execute("CREATE TABLE last (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    duck.executemany("INSERT INTO last VALUES (?, ?, ?)", docs)
    taken = {i: n for i, n in duck.execute(f"SELECT doc_id, taken // size FROM ({mixing.SQL.replace('FROM documents', 'FROM last')}) x WHERE taken > 0").fetchall()}
    t = library(bpe.default_path())
    want = collections.Counter()
    for i, text, _ in docs:
        if i in taken:
            want[(i, *spelled(t, text))] += int(taken[i])
    got = rows(spark, "pipeline", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"})
    assert collections.Counter(got) == want and len(got) > 50
