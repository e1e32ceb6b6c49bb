"""Embedding near-duplicates by collision-counting projections.

1. Vectors with equal label and components are one class, represented by the least id.
2. Classes are sorted along a first random projection, by ranges over the cluster, and cut into strips of at most
   ``STRIP`` rows. Two strips meet if the window around one reaches into the other, and every two strips meet once.
3. Where strips meet, the rows are sorted along each of ``COUNTED`` further projections, and a pair collides on one if it lies in the
   window centred on either, which is a range of ranks. Pairs with enough collisions are verified by their cosine in double
   precision. Windows and count are calibrated (``calibrated``): a pair at the threshold passes the count with a probability
   of 1 - 1e-5, and lies in the first window with one of 1 - 7e-6; a closer pair does so more surely.
4. A task gives sums of links and a spanning forest, never the links themselves, so a group of copies of any size is
   counted in pieces of bounded size.

One projection tells pairs apart only as the ratio of their distances, here about 1 to 4, so the first window holds most pairs
of vectors that are unrelated: work grows with the square of a label. It is spent on ranks of two bytes, in memory.

Defined results: a vector that is null, empty, zero, or holds null or non-finite components, or has a null label or a null id, links
with nothing and is kept; rows that share an id share their links; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybridge.operators.stored import Workspace

from .batches import add_columns
from .components import connected_components, join_listed, roots_of
from .shipping import ship

COSINE = 0.93
COUNTED = 24
#: Half a window, in distances at the threshold: of the projections that count, and of the one that sorts.
WINDOW, REACH = 2.0, 4.5
MISSED = 1e-5
#: Rows of a strip, and how many of them are compared with another strip at a time.
STRIP, TILE = 4096, 256
#: Strips that one task cuts.
STRIPS_A_TASK = 4
SEED = 20


def distance_at(cosine: float) -> float:
    """Between two unit vectors with this cosine."""
    return math.sqrt(max(0.0, 2 - 2 * cosine))


def calibrated(counted: int = COUNTED, window: float = WINDOW, missed: float = MISSED) -> int:
    """The most collisions that a pair at the threshold reaches with probability ``1 - missed``."""
    # a projection's difference is normal with the pair's distance as its deviation
    p = math.erf(window / math.sqrt(2))
    below, least = 0.0, 0
    for k in range(counted + 1):
        below += math.comb(counted, k) * p**k * (1 - p) ** (counted - k)
        if below > missed:
            break
        least = k + 1
    return least


def _projections(dimension: int) -> np.ndarray:
    """Directions as columns: the one that sorts, then those that count."""
    return np.random.default_rng([SEED, dimension]).normal(size=(dimension, 1 + COUNTED))


def _unit(vectors: np.ndarray) -> np.ndarray:
    # the largest component first, or the squares of large or small ones leave the range of doubles
    vectors = vectors / np.abs(vectors).max(axis=1)[:, None]
    return vectors / np.linalg.norm(vectors, axis=1)[:, None]


def _sorted(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every projection (a column) in order, and each row's rank in it; projections are rows of the answer."""
    order = np.argsort(lines, axis=0, kind="stable").T
    ranks = np.empty(order.shape, np.uint16 if len(lines) < 1 << 16 else np.uint32)
    np.put_along_axis(ranks, order, np.arange(len(lines), dtype=ranks.dtype)[None, :], axis=1)
    return np.take_along_axis(lines.T, order, axis=1), ranks


def _count(left: np.ndarray, line: np.ndarray, ranks: np.ndarray, columns: slice, width: float) -> np.ndarray:
    """Collisions of rows of ``left`` with some rows of a sorted side."""
    counts = np.zeros((len(left), ranks[:, columns].shape[1]), np.uint8)
    for k in range(left.shape[1]):
        first = np.searchsorted(line[k], left[:, k] - width, "left").astype(ranks.dtype)
        many = np.searchsorted(line[k], left[:, k] + width, "right").astype(ranks.dtype) - first
        # a rank before the window wraps around to a large number
        counts += (ranks[k, columns][None, :] - first[:, None]) < many[:, None]
    return counts


def collisions(left: np.ndarray, right: np.ndarray, width: float) -> np.ndarray:
    """How many projections have each pair of rows within the window; projections are columns."""
    return _count(left, *_sorted(right), slice(None), width)


def _links_of_unit(cosine: float, kind: str):
    """The links between two strips, or inside one."""
    least, window, reach = calibrated(), WINDOW * distance_at(cosine), REACH * distance_at(cosine)

    def run(table):
        import pyarrow as pa

        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        lead, sides = table.column("lead").to_numpy(), table.column("side").to_numpy()
        order = np.lexsort((ids, lead, sides))
        packed = b"".join(table.column("packed").to_pylist())
        unit = _unit(np.frombuffer(packed, kind).astype(np.float64).reshape(len(ids), -1)[order])
        ids, copies, lead, sides = ids[order], copies[order], lead[order], sides[order]
        split = int((sides == 0).sum())
        within = bool(table.column("within")[0].as_py())
        start = 0 if within else split
        lines = unit @ _projections(unit.shape[1])[:, 1:]
        line, ranks = _sorted(lines[start:])
        links, pairs = np.zeros(len(ids), np.int64), []
        for top in range(0, split, TILE):
            rows = slice(top, min(top + TILE, split))
            a = max(top if within else 0, int(np.searchsorted(lead[start:], lead[rows.start] - reach, "left")))
            b = int(np.searchsorted(lead[start:], lead[rows.stop - 1] + reach, "right"))
            if a >= b:
                continue
            close = _count(lines[rows], line, ranks, slice(a, b), window) >= least
            close &= np.abs(lead[rows][:, None] - lead[start + a : start + b][None, :]) <= reach
            i, j = np.nonzero(close)
            i, j = i + top, j + start + a
            if within:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), 1 << 14):  # bounded memory, however many pairs pass
                p, q = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
                linked = np.einsum("ij,ij->i", unit[p], unit[q]) >= cosine
                p, q = p[linked], q[linked]
                np.add.at(links, p, copies[q])
                np.add.at(links, q, copies[p])
                pairs.append((p, q))
            if sum(len(p) for p, _ in pairs) > 1 << 20:  # a forest stands for the links so far
                pairs = [_forest(len(ids), pairs)]
        p, q = _forest(len(ids), pairs)
        root = np.arange(len(ids))
        root[p] = q
        told = np.flatnonzero((links > 0) | (root != np.arange(len(ids))))
        return pa.table(
            {"a": pa.array(ids[told], pa.int64()), "b": pa.array(ids[root[told]], pa.int64()),
             "links": pa.array(links[told], pa.int64())}
        )

    return run


def _forest(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows linked to another, and the least row of what they are part of."""
    none = np.zeros(0, np.int64)
    root = roots_of(n, np.concatenate([none, *(p for p, _ in pairs)]), np.concatenate([none, *(q for _, q in pairs)]))
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def _meetings(placed: DataFrame, reach: float) -> DataFrame:
    """``(label, width, strip, i, j, side, within)``: in which pairs of strips the rows of a strip take part, and as which side."""
    bounds = placed.groupBy("label", "width", "strip").agg(F.min("lead").alias("low"), F.max("lead").alias("high"))
    later = bounds.select("label", "width", F.col("strip").alias("j"), F.col("low").alias("from"))
    # strips are numbered in the order of the projection
    pairs = bounds.withColumnRenamed("strip", "i").join(later, ["label", "width"]).where(
        (F.col("i") <= F.col("j")) & (F.col("from") - F.col("high") <= reach)
    )
    sides = [F.struct(F.col("i").alias("strip"), F.lit(0).alias("side")),
             F.when(F.col("i") < F.col("j"), F.struct(F.col("j").alias("strip"), F.lit(1).alias("side")))]
    taken = pairs.select(
        "label", "width", "i", "j", (F.col("i") == F.col("j")).alias("within"), F.explode(F.array_compact(F.array(*sides))).alias("s")
    )
    return taken.select("label", "width", "i", "j", "within", "s.strip", "s.side")


def near_duplicates(
    vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """``(id, n_links, component_id, kept)``, one row per row of ``vectors``; the id keeps its name."""
    ship(vectors.sparkSession)
    workspace = Workspace(vectors.sparkSession)
    components = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{label}`").cast("string").alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector"),
    )
    infinite = F.exists(
        "vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    usable = F.coalesce(
        F.col("label").isNotNull() & F.col("id").isNotNull() & ~infinite & F.exists("vector", lambda x: x != 0), F.lit(False)
    )
    rows = components.withColumn("usable", usable)
    rows = rows.withColumns(
        {"k1": F.xxhash64("vector"), "k2": F.xxhash64(F.lit(1), F.reverse("vector"))}
    )
    identity = ["label", "k1", "k2"]
    classes = workspace.store(
        rows.where("usable").groupBy(identity).agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    )
    # one row per class; an id may come more than once
    least = classes.withColumnRenamed("class_id", "id")
    first = rows.where("usable").join(least, [*identity, "id"]).dropDuplicates([*identity, "id"])

    # components travel packed, as floats where they were floats
    element = vectors.schema[vector].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"

    def start():
        directions = {}

        def pack(values: list) -> tuple:
            n = len(values)
            if n not in directions:
                directions[n] = _projections(n)[:, 0].copy()
            numbers = np.array(values, np.float64)
            return float(_unit(numbers[None, :])[0] @ directions[n]), n, numbers.astype(kind).tobytes()

        return pack

    added = T.StructType(
        [T.StructField("lead", T.DoubleType()), T.StructField("width", T.IntegerType()), T.StructField("packed", T.BinaryType())]
    )
    lined = workspace.store(add_columns(first, ["vector"], added, start, keep=["id", "label", "copies"]))
    ranges = max(1, math.ceil(lined.count() / (STRIP * STRIPS_A_TASK)))
    line = ["label", "width", "lead", "id"]
    # The running number starts anew in every range, at a multiple of 2**33, so a strip never goes over two.
    placed = workspace.store(
        lined.repartitionByRange(ranges, *line)
        .sortWithinPartitions(*line)
        .withColumn("strip", F.expr(f"monotonically_increasing_id() div {STRIP}"))
    )
    met = placed.join(_meetings(placed, REACH * distance_at(cosine)), ["label", "width", "strip"])
    found = workspace.store(
        met.groupBy("label", "width", "i", "j").applyInArrow(
            _links_of_unit(cosine, kind), "a long, b long, links long"
        )
    )
    parts = connected_components(found.select("a", "b"), workspace)
    linked = found.groupBy(F.col("a").alias("class_id")).agg(F.sum("links").alias("links"))
    told = (
        classes.join(linked, "class_id", "left")
        .join(parts.select(F.col("id").alias("class_id"), "component"), "class_id", "left")
        .select(
            *identity,
            "copies",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
            F.coalesce("component", "class_id").alias("component_id"),
        )
    )
    total = classes.agg(F.sum("copies")).first()[0] or 0
    answer = join_listed(rows.where("usable").select("id", *identity), told, identity, "copies", total, "id")
    answer = answer.select("id", "n_links", "component_id")
    alone = rows.where("not usable").select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")
    )
    return answer.unionAll(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
