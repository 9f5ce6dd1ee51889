"""Connected components of a distributed edge list, by alternating large and small stars.

Kiveris et al. 2014 ("Connected Components in MapReduce and Beyond").  Every round is two joins on
node; a hub's edges spread because the minimum comes from a partial aggregate and the join that uses it
is one Spark splits when skewed.  Rounds start from written tables, so lineage stays short and an
executor lost in round k costs no earlier round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _least(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of each node; written, so that the join with it has two plain shuffles,
    the form in which Spark can split a hub's partition."""
    return cut(edges.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")), "least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both).select("n", F.least("n", "m").alias("m"))
    return both.join(least, F.col("a") == F.col("n")).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down)
    joined = down.join(least, F.col("a") == F.col("n"))
    return joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b) of bigint, component the smallest node
    reachable; nodes that are their own component and have no edge are not listed."""
    state, before = cut(edges.where("a <> b").distinct(), "edges"), None
    while True:
        sign = state.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if sign == before or sign[0] == 0:
            return state.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = sign
        state = cut(_small_star(_large_star(state)), "edges")


def local_labels(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest member of each of n items' component under the links (i, j), and under those that made label."""
    top = np.arange(n)
    if label is not None:  # links join whole components: work on their names
        i, j = label[i], label[j]
    while len(i):
        low = np.minimum(top[i], top[j])
        old = top.copy()
        for to in (old[i], old[j], i, j):
            np.minimum.at(top, to, low)
        while (top[top] != top).any():
            top = top[top]
        if (top == old).all():
            break
    return top if label is None else top[label]
