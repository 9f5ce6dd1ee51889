"""The coder that Spark's JVM runs, against numpy's, by the files it writes and reads."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import jvm_coder, rangecoder, tokens
from tidemark.llm.common import new_path


@pytest.fixture(scope="module")
def phrases(spark):
    rng = random.Random(17)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    lines = [[words[min(int(rng.paretovariate(0.7)), 2999)] for _ in range(rng.randrange(3, 30))] for _ in range(300)]
    texts = [" ".join(w for _ in range(rng.randrange(60)) for w in rng.choice(lines)) + rng.choice(["", "\n日本", "<|endoftext|>"]) for _ in range(400)]
    return spark.createDataFrame(list(enumerate([*texts, None, ""])), "doc_id long, text string").repartition(5).cache()


def segments(manifest):
    return [(r, *tokens.read_segment(r["path"], r["at"])) for r in manifest.orderBy("shard", "segment").collect()]


def test_files_are_byte_for_byte_as_by_numpy(spark, phrases, monkeypatch):
    monkeypatch.setattr(tokens, "SEGMENT_IDS", 20_000)
    monkeypatch.setattr(tokens, "SLICE_BYTES", 10_000)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        manifest = tokens.write_shards(phrases, new_path(spark, "ids"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    b, found, blocks = tokens.ByteBpe(tokens.default_path()), [], 0
    for row, docs, counts, prior, facts, coded in segments(manifest):
        table = np.frombuffer(facts, "<u4").reshape(3, -1)
        ends = np.cumsum(table[0])
        ids = rangecoder.decode(prior, [coded[z - s : z] for s, z in zip(table[0].tolist(), ends.tolist(), strict=True)], *table[1:].tolist())
        raw, by_numpy, lengths, checks = rangecoder.encode(ids)
        assert raw == prior and b"".join(by_numpy) == coded and [list(map(len, by_numpy)), lengths, checks] == table.tolist()
        assert (row["docs"], row["ids"]) == (len(docs), len(ids))
        found += [(d, p.tolist()) for d, p in zip(docs.tolist(), np.split(ids, np.cumsum(counts)[:-1]), strict=True)]
        blocks += len(by_numpy)
    assert manifest.count() > manifest.select("path").distinct().count() == 2 and blocks > 20
    assert found == [(r["doc_id"], [*b.library.encode(r["text"] or "", add_special_tokens=False).ids, 0]) for r in phrases.orderBy("doc_id").collect()]
    got = tokens.read_shards(manifest).orderBy("start").collect()
    assert [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got] == found


def test_damage_in_a_block_is_found(spark, phrases):
    manifest = tokens.write_shards(phrases, new_path(spark, "ids"))
    path = manifest.first()["path"].removeprefix("file://")
    with open(path, "r+b") as f:
        f.seek(-500, 2)
        byte = f.read(1)
        f.seek(-500, 2)
        f.write(bytes([byte[0] ^ 1]))
    with pytest.raises(Exception, match="block [0-9]+ is damaged"):
        tokens.read_shards(manifest).collect()


def test_new_words_in_groups_and_a_memory_that_fills(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBER", 50)
    import pyarrow as pa

    rng, b = random.Random(3), tokens.ByteBpe(tokens.default_path())
    assert b.between is not None
    for n in (0, 1, 30, 400):
        texts = [" ".join("".join(rng.choice("aeé'1 !日") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(n + 1))) for _ in range(6)] + ["", None]
        ids, at = b.encode(pa.array(texts, pa.string()), 0)
        assert [ids[a:z].tolist() for a, z in zip(at, at[1:], strict=False)] == [[*b.library.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def test_odd_streams_of_ids(spark):
    rng = np.random.default_rng(6)
    x = [[5], [65_535, 0, 1, 2], [0] * 9000, rng.integers(0, 65_536, 9000), np.minimum(rng.zipf(1.3, 9000), 65_535), np.tile(np.arange(300), 40), np.arange(2 * rangecoder.BLOCK) % 7, np.repeat(rng.permutation(65_536), 2), rng.integers(0, 2, 30_000) * 40_000]
    x = [np.array(ids, np.int64) for ids in x]
    whole = [rangecoder.encode(ids) for ids in x]
    url, one = new_path(spark, "ids") + "/odd.ids", np.array([1], "<i8").tobytes()
    rows = [(k, url, k == len(x) - 1, one, np.array([len(ids)], "<i8").tobytes(), w[0], ids.astype("<u2").tobytes()) for k, (ids, w) in enumerate(zip(x, whole, strict=True))]
    df = spark.createDataFrame(rows, "k long, path string, last boolean, docs binary, counts binary, prior binary, ids binary").coalesce(1)
    at = df.select("k", jvm_coder.store(spark, *map(F.col, df.columns[1:])).alias("at")).collect()
    assert len(at) == len(x) and at[0]["at"] == 0
    for (k, start), ids, (prior, blocks, lengths, checks) in zip(at, x, whole, strict=True):
        docs, counts, *found = tokens.read_segment(url, start)
        facts = np.array([list(map(len, blocks)), lengths, checks], "<u4").tobytes()
        assert found == [prior, facts, b"".join(blocks)] and counts.tolist() == [len(ids)], k
        df = spark.createDataFrame([(*found, counts.tobytes())], "prior binary, facts binary, blocks binary, counts binary")
        assert bytes(df.select(jvm_coder.decode(spark, *map(F.col, df.columns))).first()[0][0]) == ids.astype("<u4").tobytes(), k
