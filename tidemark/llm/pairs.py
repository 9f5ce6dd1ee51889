"""What the pair operators share: hot keys dealt out in blocks, pairs under a key in bounded batches, and
forests of the pairs that hold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, cut
from .graph import local_labels

#: Pairs worked on at once; rows of hot keys that are broadcast at most.
PAIRS, MANY_KEYS = 1 << 19, 100_000


def parts_of(n, least: int):
    """Number of parts of a group of n rows, of ``least`` rows or, in large groups, of the root of n times 4: a row
    is copied once a part, so neither units nor copies may grow in proportion."""
    return F.ceil(n / F.greatest(F.lit(float(least)), 4 * F.sqrt(n))).cast("int")


def dealt(filed: DataFrame, member: str, block: int) -> DataFrame:
    """filed (key, member, more) with every key of more than ``block`` rows cut into units of about that many
    or more, each holding two parts of the key's members; all pairs of a key still meet in a unit.  Counts come from a
    partial aggregate, so no task sees a hot key whole.  Units are named by a hash; should two names meet, rows
    of two keys share a unit, which costs work and changes no result."""
    hot = cut(filed.groupBy(F.col("key").alias("_hot")).agg(F.count("*").alias("_n")).where(F.col("_n") > block), "hot-keys")
    n = hot.count()
    if n == 0:
        return filed
    rows = filed.join(bounded_broadcast(hot, n, MANY_KEYS), F.col("key") == F.col("_hot"), "left")
    parts = F.greatest(F.lit(2), parts_of(F.col("_n"), block // 2))  # one part would have no other to meet
    mine = F.pmod(F.xxhash64(member), parts).cast("int")
    others = F.filter(F.sequence(F.lit(0), parts - 1), lambda o: o != F.col("_mine"))
    units = F.transform(others, lambda o: F.xxhash64("key", F.least("_mine", o), F.greatest("_mine", o)))
    rows = rows.withColumn("_mine", mine)
    rows = rows.withColumn("_unit", F.explode(F.when(F.col("_n").isNull(), F.array("key")).otherwise(units)))
    return rows.select(F.col("_unit").alias("key"), *filed.columns[1:])


def whole_keys(batches):
    """Lists of numpy columns of partitions sorted by their first column, cut where a key ends."""
    parts: list[list[np.ndarray]] = []
    joined = lambda: [np.concatenate(c) for c in zip(*parts, strict=True)]
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        last = int(np.searchsorted(cols[0], cols[0][-1], "left"))
        if last == 0 and (not parts or parts[-1][0][-1] == cols[0][0]):
            parts.append(cols)
            continue
        parts.append([c[:last] for c in cols])
        yield joined()
        parts = [[c[last:] for c in cols]]
    if parts:
        yield joined()


def windows(low: np.ndarray, high: np.ndarray, most: int | None = None):
    """Batches of pairs i < j with low[j] <= high[i], for ascending low; about ``most`` at once (PAIRS), and of
    one i all at least."""
    most = most or PAIRS
    n = len(low)
    count = np.searchsorted(low, high, "right") - np.arange(1, n + 1)
    ends = np.cumsum(count)
    at = 0
    while at < n:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        c = count[at:to]
        if len(c) and int(ends[to - 1]) > before:
            i = np.repeat(np.arange(at, to), c)
            j = np.arange(len(i)) - np.repeat(ends[at:to] - c - before, c) + i + 1
            yield i, j
        at = to


def spanning(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Places of the pairs (i, j) that make a forest of least d over n items: every tree's shortest way out
    joins it with another until none is left."""
    label, out, left = np.arange(n), [], np.arange(len(i))
    while True:
        left = left[label[i[left]] != label[j[left]]]
        if not len(left):
            return np.concatenate(out) if out else left
        # Ties go by place, so that the shortest ways of all trees hold no circle of equals.
        order = left[np.lexsort((left, d[left]))]
        first = np.full(n, len(order))
        for side in (i, j):
            np.minimum.at(first, label[side[order]], np.arange(len(order)))
        best = order[np.unique(first[first < len(order)])]
        out.append(best)
        label = local_labels(n, i[best], j[best], label)
