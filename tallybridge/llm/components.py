"""Connected components by alternating large and small stars.

Every round joins edges with the least neighbour of a node and writes its edges to the shared folder, which cuts lineage
and survives lost executors. Least neighbours are pre-aggregated, the edges of a node with very many
neighbours are dealt over tasks (``join_listed``), and nothing but two numbers per round reaches the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybridge.operators.stored import Workspace


#: Keys that hold more than one of so many rows are hot, so there are fewer of them than that.
HEAVY = 1000
#: Tasks over which the rows of a hot key are dealt.
SALTS = 64


def join_listed(rows: DataFrame, listed: DataFrame, on: list[str], size: str, total: int, spread: str) -> DataFrame:
    """``rows`` with the columns of ``listed``, which has one row per key ``on`` and how many rows of the key there
    are (``size``, out of ``total``). Rows of a hot key are dealt by the column ``spread``, and its one listed row is
    written for each part; which keys are hot, fewer than ``HEAVY``, is broadcast."""
    hot = F.col(size) > max(1, total // HEAVY)
    keys = F.broadcast(listed.where(hot).select(*on, F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    salts = F.when(hot, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    parts = listed.withColumn("_salt", F.explode(F.coalesce(salts, F.array(F.lit(0).cast("long"))))).drop(size)
    return rows.join(keys, on, "left").withColumn("_salt", salt).drop("_hot").join(parts, [*on, "_salt"]).drop("_salt")


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("a", "m"))
    out = join_listed(both, least, ["a"], "n", 2 * total, "b").where("b > a")
    return out.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Edges point from the larger node to a smaller one."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    out = join_listed(edges, least, ["a"], "n", total, "b")
    moved = out.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, workspace: Workspace) -> DataFrame:
    """``(id, component)`` of all nodes of edges ``(a, b)``; the component is its least node."""
    known = workspace.store(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = None
    while True:
        row = known.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(row) == mark or row[0] == 0:
            break
        mark = tuple(row)
        # a large star makes no more edges than there are
        known = workspace.store(_small_star(_large_star(known, row[0]), row[0]))
    nodes = known.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = known.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return nodes.unionAll(roots)


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row of each of ``n`` rows' component, for pairs of rows inside one task."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before, root)
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
        if np.array_equal(root, before):
            break
    return root
