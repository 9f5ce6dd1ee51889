"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

1. Equal vectors become one class (smallest vec_id, number of copies) by a partial aggregate.  A class has a
   number of its own, so vectors that share an id, or have none, stay apart.
2. Rotations for balanced binary codes are learnt by iterative quantisation (Gong and Lazebnik 2011)
   on at most ``SAMPLE`` classes, those of smallest hash, less those within ``APART`` of another, so that a
   large group counts once and no balance is sought inside it.  That is the one bounded fit here; every
   class is coded and indexed.
3. The code is cut into tables of ``w`` bits, as many as leave a pair at the threshold a chance of ``MISS`` to
   agree in none.  How often bits of such a pair differ is measured on the sample, as it is more than the angle
   says where vectors share a direction.
4. Classes that agree in a table are compared by their original vectors in double precision; a spanning forest
   of the links leaves each table's bucket, never its pairs.  Connected components of these links are the groups.
5. Links are counted by comparing all pairs of a group.  Buckets and groups of more than ``BLOCK`` classes are
   dealt out as pairs of parts, each its own unit of work, so no task holds a large one.

Vectors that are null, empty, zero, or that hold null or non-finite components, link with nothing; vectors of
different lengths do not link, and each length has an index of its own.  Null ids count as the largest and come
back as null; a row's component and links are those of its vector.  Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .graph import components, local_labels
from .pairs import dealt, parts_of, windows

COSINE, SAMPLE, APART, MISS, BLOCK, ROWS, FEW, VALUES = 0.95, 8192, 0.90, 0.02, 256, 512, 32, 1 << 22
#: Chance that a bit of a pair at the threshold differs, where vectors have no direction in common.
FLIP = math.acos(COSINE) / math.pi
NO_ID = (1 << 63) - 1


def thinned(sample: np.ndarray) -> np.ndarray:
    """The unit vectors of a sample that lie apart from all before them."""
    kept = np.empty((0, sample.shape[1]))
    for at in range(0, len(sample), ROWS):
        part = sample[at : at + ROWS]
        if len(kept):
            part = part[(part @ kept.T).max(1) < APART]
        near, stay = part @ part.T >= APART, []
        for i in range(len(part)):
            if not near[i, stay].any():
                stay.append(i)
        kept = np.concatenate([kept, part[stay]])
    return kept


def fit(sample: np.ndarray, bits: int, rounds: int = 20, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(projection, thresholds) of a code of that many bits, from unit vectors in rows."""
    rng, d = np.random.default_rng(seed), sample.shape[1]
    if not bits:
        return np.zeros((d, 0)), np.zeros(0)
    centre = sample.mean(0)
    x = sample - centre
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    z, columns = x @ axes, []
    for _ in range(-(-bits // d)):
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(z @ r >= 0, 1.0, -1.0).T @ z)
            r = vt.T @ u.T
        columns.append(axes @ r)
    w = np.concatenate(columns, 1)[:, :bits]
    return w, np.median(sample @ w, 0)


def shape(classes: int, flip: float = FLIP) -> tuple[int, int]:
    """Bits of a table and number of tables for so many classes: the least work for filing and comparing.  Few
    classes have one table of no bits, that is all pairs."""

    def tables(w: int) -> int:
        return 1 if not w else math.ceil(math.log(MISS) / math.log1p(-((1 - flip) ** w)))

    w = min(range(29), key=lambda w: tables(w) * (1 + classes / 2**w / FEW))
    return w, tables(w)


def flips(apart: np.ndarray, sample: np.ndarray, cosine: float, seed: int = 11) -> float:
    """How often the bits of a short code, fitted on vectors that lie apart, differ between unit vectors of the
    sample and others at the threshold from them, on the way to another vector of it."""
    project, at = fit(apart, 4 * sample.shape[1])
    other = sample[np.random.default_rng(seed).permutation(len(sample))]
    side = other - (other * sample).sum(1, keepdims=True) * sample
    size = np.linalg.norm(side, axis=1, keepdims=True)
    ok = size[:, 0] > 1e-6
    if not ok.any():
        return FLIP
    near = cosine * sample[ok] + math.sqrt(1 - cosine**2) * side[ok] / size[ok]
    measured = ((sample[ok] @ project >= at) != (near @ project >= at)).mean()
    return float(min(max(measured, FLIP), 0.4))


def unit(vectors: pa.Array) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def forest(keys: np.ndarray, v: np.ndarray, cosine: float) -> np.ndarray:
    """For unit vectors in rows sorted by key: each row's representative row in its component within its key."""
    n = len(keys)
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(edge, n))
    place, few = np.repeat(np.arange(len(edge)), size), np.flatnonzero(np.repeat(size <= FEW, size))
    label = np.arange(n)
    for i, j in windows(place[few], place[few], max(1, VALUES // v.shape[1])):
        i, j = few[i], few[j]
        ok = np.einsum("ij,ij->i", v[i], v[j]) >= cosine
        label = local_labels(n, i[ok], j[ok], label)
    for start, m in zip(edge[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
        part, run = v[start : start + m], np.arange(m)
        for at in range(0, m, ROWS):
            for lo in range(at, m, ROWS):
                a, b = np.nonzero(part[at : at + ROWS] @ part[lo : lo + ROWS].T >= cosine)
                run = local_labels(m, a + at, b + lo, run)
        label[start : start + m] = start + run
    return label


def by_key(columns: int, work):
    """A mapInArrow function over partitions sorted by their first column: work(rows of whole keys)
    gets lists of numpy or Arrow columns and returns a record batch; a key's rows are never split."""

    def run(batches):
        parts: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0).to_numpy()
            start = int(np.searchsorted(keys, keys[-1], "left"))
            if start == 0 and (not parts or parts[-1].column(0)[-1].as_py() == keys[-1]):
                parts.append(b)
                continue
            yield work([pa.chunked_array([p.column(c) for p in [*parts, b.slice(0, start)]]).combine_chunks() for c in range(columns)])
            parts = [b.slice(start)]
        if parts:
            yield work([pa.chunked_array([p.column(c) for p in parts]).combine_chunks() for c in range(columns)])

    return run


def groups(classes: DataFrame, n: int, cosine: float = COSINE) -> DataFrame:
    """(node, component) of classes that links found by the tables connect; classes is (rep, vec), of one length."""
    sample = classes.select("vec").orderBy(F.xxhash64("vec"), "rep").limit(SAMPLE).toArrow()["vec"].combine_chunks()
    sample = unit(sample)
    apart = thinned(sample)
    w, tables = shape(n, flips(apart, sample, cosine))
    project, at = fit(apart, w * tables)
    power = 1 << np.arange(w, dtype=np.int64)

    def code(batches):
        for b in batches:
            if not b.num_rows:
                continue
            up = unit(b.column(1)) @ project >= at
            keys = up.reshape(len(up), tables, w) @ power + (np.arange(tables, dtype=np.int64) << w)
            for at_ in range(0, b.num_rows, ROWS):
                some = np.repeat(np.arange(at_, min(at_ + ROWS, b.num_rows)), tables)
                yield pa.RecordBatch.from_arrays([pa.array(keys[at_ : at_ + ROWS].reshape(-1)), b.column(0).take(pa.array(some)), b.column(1).take(pa.array(some))], names=["key", "rep", "vec"])

    def near(cols):
        keys, reps = cols[0].to_numpy(), cols[1].to_numpy()
        label = forest(keys, unit(cols[2]), cosine)
        own = label != np.arange(len(label))
        return pa.RecordBatch.from_arrays([pa.array(reps[own]), pa.array(reps[label[own]])], names=["a", "b"])

    kind = classes.schema["vec"].dataType.simpleString()
    filed = dealt(classes.select("rep", "vec").mapInArrow(code, f"key bigint, rep bigint, vec {kind}"), "rep", BLOCK)
    filed = filed.repartition(F.col("key")).sortWithinPartitions("key")
    return components(filed.mapInArrow(by_key(3, near), "a bigint, b bigint"))


def rerank(classes: DataFrame, found: DataFrame, cosine: float) -> DataFrame:
    """Units of work on groups: rows (rep, links), links a sum for rep over its unit's pairs."""
    group = found.select(F.col("component").alias("g"), F.col("node").alias("r"))
    group = group.unionByName(found.select(F.col("component").alias("g"), F.col("component").alias("r")).distinct())
    sizes = group.groupBy(F.col("g").alias("_g")).agg(F.count("*").alias("n"))
    rows = classes.join(group, F.col("rep") == F.col("r")).join(sizes, F.col("g") == F.col("_g"))
    rows = rows.withColumn("blocks", parts_of(F.col("n"), BLOCK // 2)).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("mine"), o).alias("x"), F.greatest(F.col("mine"), o).alias("y")))
    rows = rows.withColumn("pair", F.explode(pair)).select(F.xxhash64("g", "pair").alias("key"), "g", "pair.x", "pair.y", "mine", "rep", "copies", "vec")

    def work(cols):
        key, g, x, y, mine, rep, copies = (c.to_numpy(zero_copy_only=False) for c in cols[:7])
        v = unit(cols[7])
        out_rep, out_links = [], []
        order = np.lexsort((y, x, g))
        cuts = np.flatnonzero(np.any([np.diff(c[order]) != 0 for c in (g, x, y)], 0)) + 1
        for rows in np.split(order, cuts):
            one, two = rows[mine[rows] == x[rows[0]]], rows[mine[rows] == y[rows[0]]]
            same = x[rows[0]] == y[rows[0]]
            m, all_rows = len(one), np.concatenate([one, two]) if not same else one
            sums = np.zeros(len(all_rows), np.int64)
            for at in range(0, m, ROWS):
                hit = v[one[at : at + ROWS]] @ v[two].T >= cosine
                if same:
                    hit[np.arange(len(hit)), np.arange(at, at + len(hit))] = False
                sums[at : at + len(hit)] += hit @ copies[two]
                if not same:
                    sums[m:] += copies[one[at : at + len(hit)]] @ hit
            out_rep.append(rep[all_rows])
            out_links.append(sums)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (out_rep, out_links)], names=["rep", "links"])

    rows = rows.repartition(F.col("key")).sortWithinPartitions("key")
    return rows.mapInArrow(by_key(8, work), "rep bigint, links bigint")


def link(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    v = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(vec_col).alias("vec"))
    finite = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists("vec", lambda c: c != 0)
    v = cut(v.withColumn("ok", F.coalesce(finite, F.lit(False))), "vectors")
    good = v.where("ok").groupBy("vec").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    # Numbers of classes are settled by writing them.
    classes = cut(good.withColumn("rep", F.monotonically_increasing_id()), "vector-classes")
    found = ranked = None
    for d, n in sorted(map(tuple, classes.groupBy(F.size("vec")).count().where("count > 1").collect())):  # a row a length
        mine = classes.where(F.size("vec") == d)
        whole = groups(mine, n, cosine)
        links = rerank(mine, whole, cosine)
        found, ranked = (whole, links) if found is None else (found.unionByName(whole), ranked.unionByName(links))
    told = classes.withColumn("label", F.col("rep")).withColumn("links", F.lit(0).cast("long"))
    if found is not None:
        sums = ranked.groupBy(F.col("rep").alias("_r")).agg(F.sum("links").alias("_links"))
        told = classes.join(sums, F.col("rep") == F.col("_r"), "left").join(found, F.col("rep") == F.col("node"), "left")
        told = cut(told.select(*classes.columns, F.coalesce("component", "rep").alias("label"), F.coalesce("_links", F.lit(0)).alias("links")), "vector-links")
    least = told.groupBy(F.col("label").alias("_l")).agg(F.min("least").alias("component_id"))
    told = told.join(least, F.col("label") == F.col("_l")).select(F.col("vec").alias("_v"), (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    told = cut(told, "vector-told")
    out = v.withColumn("key", F.when(F.col("ok"), F.col("vec"))).join(told, F.col("key") == F.col("_v"), "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    back = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return out.select(back("id").alias(id_col), "n_links", back("component_id").alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"))


def op10_embedding_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))
