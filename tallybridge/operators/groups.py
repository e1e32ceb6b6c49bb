"""Group primitives that hold when one group is a third of the table.

A plain window or equi-join sends a whole group to one task. The operators here
split such groups instead, and stay exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.cells import FIXED_WIDTH, FLOATS, as_text, digest

# A group is ranked in this many slices, so a task holds at most a thousandth of it.
SLICES = 1024
# Of a longer list the largest are broadcast; every other key holds under 1/1024 of the rows.
HEAVY_KEYS = 1024
# A list of this many identities, at 32 bytes each, is broadcast whole: two megabytes.
BROADCAST_KEYS = 65_536
# Bits for each key of a longer list, and bits in all: 16 MB.
SLOTS_PER_KEY, MOST_SLOTS = 16, 1 << 27
# Copies of one row that a single task writes in place; beyond it they are spread out.
COPIES_IN_PLACE = 10_000


def slice_of(col: Column) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(SLICES)).cast("int")


def identity_columns(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """What a group is recognised by: the columns themselves when they are short and of
    fixed width, otherwise one 32-byte digest, so neither a shuffle nor a broadcast grows
    with the length of the texts."""
    types = {f.name: f.dataType for f in df.schema}
    if len(columns) <= 4 and all(isinstance(types[c], FIXED_WIDTH) for c in columns):
        return [F.col(c) for c in columns]
    # Adding zero makes -0.0 and 0.0, which are one group, one text.
    cells = [F.col(c) + F.lit(0.0) if isinstance(types[c], FLOATS) else F.col(c) for c in columns]
    return [digest([as_text(cell, types[c]) for c, cell in zip(columns, cells)])]


def add_identity(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Add the identity of a group as columns ``_g0``, ``_g1``, …"""
    names = []
    for i, col in enumerate(identity_columns(df, columns)):
        names.append(f"_g{i}")
        df = df.withColumn(f"_g{i}", col)
    return df, names


def group_sizes(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rows per group, combined before the shuffle, so a hot group is one row per task."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))


def rows_in_groups(
    rows: DataFrame, groups: DataFrame, on: Sequence[str], hot: DataFrame | None = None
) -> DataFrame:
    """All ``rows`` whose group is listed in ``groups`` (columns ``on`` and a size ``n``).

    ``on`` are identities (see :func:`add_identity`), so a list of known length has a
    known size. The list is counted first; it is read more than once, so it should be a written table.
    None: no row is read. Up to ``BROADCAST_KEYS``: a broadcast, and no row is shuffled. Beyond that a
    bitmap of the listed groups keeps most other rows out of the shuffle, and groups that hold more than
    1/HEAVY_KEYS of the listed rows, fewer than HEAVY_KEYS, are matched by broadcast. ``hot`` names more groups to
    be dealt with that way (``on`` and ``listed``): large ones that are not asked for, as far as they are
    known. NULL is a group of its own.
    """
    on = list(on)
    length, total = groups.agg(F.count(F.lit(1)), F.sum("n")).first()
    if length == 0:
        return rows.where(F.lit(False))
    listed = groups.select(*on)
    if length <= BROADCAST_KEYS:
        return _null_safe_join(rows, F.broadcast(listed), on, "left_semi")
    is_heavy = F.col("n") * HEAVY_KEYS > total
    heavy = groups.where(is_heavy).select(*on)
    apart = heavy if hot is None else heavy.unionAll(hot.where("not listed").select(*on))
    candidates = _possibly_listed(rows, groups.where(~is_heavy), on, length)
    if apart.isEmpty():
        return _null_safe_join(candidates, listed, on, "left_semi")
    hot_rows = _null_safe_join(rows, F.broadcast(heavy), on, "left_semi")
    cold_rows = _null_safe_join(candidates, F.broadcast(apart), on, "left_anti")
    light = groups.where(~is_heavy).select(*on)
    return hot_rows.unionAll(_null_safe_join(cold_rows, light, on, "left_semi"))


def _possibly_listed(rows: DataFrame, groups: DataFrame, on: list[str], length: int) -> DataFrame:
    """``rows`` without most of those whose group is not listed: a bitmap of hashes, of at most ``MOST_SLOTS`` bits."""
    slots = 1 << 15
    while slots < min(MOST_SLOTS, length * SLOTS_PER_KEY):
        slots *= 2
    slot = F.pmod(F.xxhash64(*on, *[F.col(c).isNull() for c in on]), F.lit(slots)) + 1
    bitmaps = groups.groupBy(F.bitmap_bucket_number(slot).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("_bits")
    )
    place = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("_bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0
    tagged = rows.withColumn("_bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(bitmaps), "_bucket")
    return tagged.where(is_set).select(*rows.columns)


def _null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    renamed = right.toDF(*[f"_r_{c}" for c in on])
    condition = None
    for c in on:
        same = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        condition = same if condition is None else condition & same
    return left.join(renamed, condition, how)


def repeated_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All rows whose values in ``columns`` occur more than once; every column is kept."""
    tagged, group = add_identity(df, columns)
    repeated = group_sizes(tagged, group).where("n > 1")
    return rows_in_groups(tagged, repeated, group).drop(*group)


def ranked(
    df: DataFrame, group: Sequence[str], slice_col: str, order: Sequence[Column], rank: str
) -> DataFrame:
    """``row_number`` within ``group``, ordered by (``slice_col``, ``order``), without ever
    holding a whole group in one task.

    Rows per (group, slice) are counted first; a running sum over the slices (at most as
    many rows per group as there are slices) gives each slice its offset, and rows are
    numbered inside their slice. ``group`` columns must not be NULL.
    """
    key = [*group, slice_col]
    before = (
        Window.partitionBy(*group)
        .orderBy(slice_col)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(*key, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*key).orderBy(*order)
    return (
        df.join(offsets, key)
        .withColumn(rank, F.col("_before") + F.row_number().over(within))
        .drop("_before")
    )


def repeat_rows(df: DataFrame, count: str, copy: str, start: Column | None = None) -> DataFrame:
    """Write each row ``count`` times, numbering the copies in column ``copy`` from ``start``.

    Rows with very many copies are first cut into blocks that are spread over the
    cluster, so one hot row does not become one task's output.
    """
    start = F.lit(1).cast("long") if start is None else start
    few = df.where(F.col(count).between(1, COPIES_IN_PLACE)).withColumn("_first", start)
    few = few.withColumn("_last", F.col("_first") + F.col(count) - 1)
    many = df.where(F.col(count) > COPIES_IN_PLACE).withColumn("_begin", start)
    many = many.withColumn("_end", F.col("_begin") + F.col(count) - 1)
    many = many.withColumn(
        "_first", F.explode(F.sequence("_begin", "_end", F.lit(COPIES_IN_PLACE).cast("long")))
    )
    many = many.withColumn(
        "_last", F.least(F.col("_first") + (COPIES_IN_PLACE - 1), F.col("_end"))
    ).drop("_begin", "_end")
    blocks = few.unionByName(many.repartition("_first"))
    return blocks.withColumn(copy, F.explode(F.sequence("_first", "_last"))).drop(
        "_first", "_last", count
    )


