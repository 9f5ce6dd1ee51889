"""SimHash near-duplicates by pivot distance tables.

A fingerprint's row in the pivot table holds its Hamming distances to ``PIVOTS`` reference fingerprints.
By the triangle inequality two fingerprints that differ in ``bits`` places differ by at most that much in
every coordinate.

* Keys.  Distances to references alone cannot part a corpus: nearly all fingerprints lie 24 to 40 bits from
  any reference.  So fingerprints are first dealt out by blocks of their bits: within 3 bits they agree
  on one of 4 blocks, on 2 of 5, on 3 of 6, and are filed under every choice of so many blocks.  The number of
  fingerprints picks the shape that keeps keys small; each misses no pair.
* Candidates.  Rows under a key are sorted by their first coordinate, and a row's candidates are those in the
  range that the limit allows.
* Discarding.  Pairs whose largest difference over all coordinates is above the limit go, and the survivors
  are verified on the fingerprints.  This is the same for every number of rows under a key.

A key of more than ``BLOCK`` rows is dealt out as pairs of parts.  Only distinct fingerprints are filed.  Of a
key's links only a spanning forest leaves the task, never the pairs of a group; connected components then run
over the whole corpus.

Null and empty texts have fingerprint zero.  Equal rows link.  Null ids count as the largest id and
come back as null.  Rows with equal doc_id and other texts are documents of their own, linked by fingerprint
alone.  Extra columns are not read by :func:`link`, and pass through :func:`keep_one`, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, cut, mixed, table, text_slices
from .graph import components, local_labels
from .pairs import dealt, whole_keys, windows

BITS, WORDS, PIVOTS = 3, 3, 16
#: (blocks, blocks that agree within BITS bits) and the rows by chance under a key that call for the next one.
SHAPES, CROWD = ((4, 1), (5, 2), (6, 3)), 1024
SLICE_BYTES, BLOCK = 4_000_000, 1024
NO_ID = (1 << 63) - 1


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The XXH64 (seed 42) of a text's word shingles, in order, repeats included; of fewer words the whole
    sequence, of none nothing."""
    import xxhash

    parts = text.lower().split()
    if not parts:
        return np.empty(0, U64)
    joined = b" ".join(parts)
    if len(parts) < words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], U64)
    long = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(long) - 1
    starts = (ends - long + 1)[: len(parts) - words + 1].tolist()
    f = xxhash.xxh64_intdigest
    return np.array([f(joined[s:e], 42) for s, e in zip(starts, ends[words - 1 :].tolist(), strict=True)], U64)


def majority(h: np.ndarray) -> np.ndarray:
    """For rows of 64-bit words: the words whose bits are set in over half of the rows."""
    count, bits = np.zeros(64 * h.shape[1], np.int64), np.ascontiguousarray(h, "<u8").view(np.uint8)
    for at in range(0, len(h), 255):  # so many fit a byte's sum
        part = bits[at : at + 255]
        count += np.add.reduce(np.unpackbits(part.reshape(-1), bitorder="little").reshape(len(part), -1), 0, np.uint8)
    return np.packbits(2 * count > len(h), bitorder="little").view("<u8")


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Majority bits of the hashes of a text's word shingles."""
    h = shingles(text, words)
    return int(majority(h[:, None])[0]) if len(h) else 0


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed bigint) and on request the text's MD5 of every row."""

    def run(batches):
        for b in batches:
            texts, others = b.column(1).fill_null(""), [b.column(0), *b.columns[2:]]
            for at, to in text_slices(texts, SLICE_BYTES):
                fps = np.array([fingerprint(t.encode(), words) for t in texts.slice(at, to - at).to_pylist()], U64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*[c.slice(at, to - at) for c in others], pa.array(fps)], names=names)

    more = [_digest(text_col)] if digest else []
    names = ["doc_id", *["digest"] * digest, "fp"]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col, *more).mapInArrow(run, "doc_id bigint, " + "digest string, " * digest + "fp bigint")


def _digest(text_col: str) -> F.Column:
    return F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("digest")


# -- the pivot table


def pivots() -> np.ndarray:
    return mixed(np.arange(1, PIVOTS + 1, dtype=U64))


def shape(n: int) -> tuple[int, int]:
    """Number of blocks and of those that agree, for n fingerprints."""
    return next((s for s in SHAPES if n >> 64 * s[1] // s[0] <= CROWD), SHAPES[-1])


def keys_of(fps: np.ndarray, blocks: int = 6, agree: int = 3) -> np.ndarray:
    """The keys of each fingerprint, one column for each choice of blocks: its number and their bits."""
    edge = [64 * k // blocks for k in range(blocks + 1)]
    part = [(fps >> U64(a)) & U64((1 << b - a) - 1) for a, b in zip(edge, edge[1:], strict=False)]
    out = []
    for number, picked in enumerate(combinations(range(blocks), agree)):
        key = np.full(len(fps), number, U64)
        for k in picked:
            key = key << U64(edge[k + 1] - edge[k]) | part[k]
        out.append(key.view(np.int64))
    return np.stack(out, 1)


def forest(keys: np.ndarray, fps: np.ndarray, bits: int) -> np.ndarray:
    """For rows sorted by key: each row's representative row in its component within its key."""
    dist = np.bitwise_count(fps[:, None] ^ pivots()).astype(np.int8)
    place = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]])) << 8 | dist[:, 0]
    order = np.argsort(place, kind="stable")
    place, dist, fps = place[order], np.ascontiguousarray(dist[order].T), fps[order]
    run = np.arange(len(keys))
    for i, j in windows(place, place + bits):
        for coordinate in dist[1:]:
            ok = np.abs(coordinate[i] - coordinate[j]) <= bits
            i, j = i[ok], j[ok]
        ok = np.bitwise_count(fps[i] ^ fps[j]) <= bits
        run = local_labels(len(run), i[ok], j[ok], run)
    label = np.empty_like(run)
    label[order] = order[run]
    return label


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints fp that connect what links within bits."""
    if bits > BITS:
        raise ValueError(f"keys are complete up to {BITS} bits")
    how = shape(fps.count())

    def file(batches):
        for b in batches:
            fps = b.column(0).to_numpy().view(U64)
            keys = keys_of(fps, *how)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(fps.view(np.int64), keys.shape[1]))], names=["key", "fp"])

    def run(batches):
        for keys, fps in whole_keys(batches):
            label = forest(keys, fps.view(U64), bits)
            own = label != np.arange(len(label))
            yield pa.RecordBatch.from_arrays([pa.array(fps[own]), pa.array(fps[label[own]])], names=["a", "b"])

    filed = dealt(fps.select("fp").mapInArrow(file, "key bigint, fp bigint"), "fp", BLOCK)
    return filed.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint")


def _labelled(docs: DataFrame, bits: int, words: int, id_col: str, text_col: str, digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of every row, null ids as NO_ID; and of each distinct fingerprint fp its rep (the
    smallest doc_id) and the label of its component."""
    fps = cut(fingerprints(docs, words, id_col, text_col, digest).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))), "simhash")
    reps = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    found = components(links(reps, bits))
    return fps, cut(reps.join(found, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("label")), "simhash-labels")


def link(docs: DataFrame, bits: int = BITS, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component (the smallest doc_id reachable) of every row."""
    fps, named = _labelled(docs, bits, words, id_col, text_col)
    least = cut(named.groupBy(F.col("label").alias("_l")).agg(F.min("rep").alias("component")), "simhash-least")
    of = named.join(least, F.col("label") == F.col("_l")).select(F.col("fp").alias("_f"), "component")
    back = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    return fps.join(of, F.col("fp") == F.col("_f")).select(back("doc_id"), "fp", back("component"))


def keep_one(docs: DataFrame, bits: int = BITS, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component: that with the smallest id, of equal ids the text with the smallest MD5."""
    fps, named = _labelled(docs, bits, words, id_col, text_col, digest=True)
    least = fps.groupBy("fp").agg(F.min(F.struct("doc_id", "digest")).alias("r"))
    least = named.select(F.col("fp").alias("_f"), "label").join(least, F.col("_f") == F.col("fp")).groupBy("label").agg(F.min("r").alias("r"))
    stay = cut(least.select(F.col("r.doc_id").alias("_id"), F.col("r.digest").alias("_digest")), "simhash-stay")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_mine"), _digest(text_col).alias("_text"))
    kept = rows.join(stay.hint("merge"), (F.col("_mine") == F.col("_id")) & (F.col("_text") == F.col("_digest")), "left_semi")
    # Only if rows with one id and text occur do the texts go through a second shuffle.
    if not fps.groupBy("doc_id", "digest").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["_mine", "_text"])
    return kept.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def op7_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
