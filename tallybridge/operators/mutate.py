"""Seeded synthetic changes, for tests of a comparison."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.cells import quoted

# A rule gives the new value of a cell from the row's id and a random non-negative long.
Rule = Callable[[Column, Column], Column]
# Rows are bucketed by the leading 20 of 63 hash bits.
BUCKET_SHIFT = 43


def template(text: str) -> Rule:
    """Text with ``{}`` replaced by the row's id."""
    before, after = text.split("{}")
    return lambda row_id, draw: F.concat(F.lit(before), row_id.cast("string"), F.lit(after))


def pick(values: Sequence[object]) -> Rule:
    """One of a list of values; it may be the one already there."""
    return lambda row_id, draw: F.element_at(
        F.array(*[F.lit(v) for v in values]), (draw % len(values) + 1).cast("int")
    )


def number_text(prefix: str, low: int, high: int) -> Rule:
    """A prefix followed by a whole number between ``low`` and ``high``."""
    return lambda row_id, draw: F.concat(
        F.lit(prefix), (draw % (high - low + 1) + low).cast("string")
    )


# The rules of the people-table example.
PEOPLE_RULES: dict[str, Rule] = {
    "Name": template("Updated_{}"),
    "Email": template("updated{}@example.com"),
    "Telephone": number_text("9876", 100000, 999999),
    "City": pick(["Sydney", "Dubai", "Toronto", "Madrid", "Rome"]),
    "Country": pick(["Australia", "UAE", "Canada", "Spain", "Italy"]),
    "Gender": pick(["M", "F"]),
}


def _draw(seed: int, *parts: Column) -> Column:
    return F.xxhash64(F.lit(seed), *parts).bitwiseAND(F.lit((1 << 63) - 1))


def sample_rows(df: DataFrame, row_id: str, count: int, seed: int) -> DataFrame:
    """Mark exactly ``count`` rows, those with the least hash of their id: ``_picked``.

    The hash and id of the last one are looked for first, and the rows are told by comparing with
    them. Rows per hash bucket are counted (at most 2^20 numbers); only the boundary bucket is ordered.
    """
    if count <= 0:
        return df.withColumn("_picked", F.lit(False))
    row = quoted(row_id)
    draw = _draw(seed, row)
    bucket = F.shiftright(draw, BUCKET_SHIFT)
    sizes = df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    up_to = Window.partitionBy(F.lit(0)).orderBy("bucket")
    boundary = (
        sizes.withColumn("through", F.sum("n").over(up_to))
        .where(F.col("through") >= count)
        .orderBy("bucket")
        .first()
    )
    if boundary is None:
        return df.withColumn("_picked", F.lit(True))
    missing = count - (boundary["through"] - boundary["n"])
    last = (
        df.where(bucket == boundary["bucket"])
        .select(draw.alias("draw"), row.alias("id"))
        .orderBy("draw", "id")
        .limit(missing)
        .agg(F.max(F.struct("draw", "id")).alias("last"))
        .first()["last"]
    )
    id_type = df.schema[row_id].dataType
    tie = row.isNull() if last["id"] is None else row.isNull() | (row <= F.lit(last["id"]).cast(id_type))
    return df.withColumn("_picked", (draw < last["draw"]) | ((draw == last["draw"]) & tie))


def mutate(
    df: DataFrame,
    rules: Mapping[str, Rule],
    *,
    row_id: str,
    fraction: float = 0.05,
    cells: int = 2,
    seed: int = 0,
) -> DataFrame:
    """Change ``cells`` distinct cells, chosen per row, in a fraction of the rows.

    ``row_id`` is unique. The same seed gives the same changes whatever the layout.
    """
    count = int(df.count() * fraction)
    marked = sample_rows(df, row_id, count, seed)
    row = quoted(row_id)
    ranked_columns = F.array_sort(
        F.array(*[F.struct(_draw(seed + 1, row, F.lit(c)).alias("d"), F.lit(c).alias("c")) for c in rules])
    )
    chosen = F.transform(F.slice(ranked_columns, 1, cells), lambda x: x["c"])
    marked = marked.withColumn("_chosen", F.when(F.col("_picked"), chosen))
    out = []
    for f in df.schema:
        cell = quoted(f.name)
        if f.name in rules:
            value = rules[f.name](row, _draw(seed + 2, row, F.lit(f.name)))
            value = value if isinstance(f.dataType, T.StringType) else value.cast(f.dataType)
            hit = F.coalesce(F.array_contains("_chosen", f.name), F.lit(False))
            cell = F.when(hit, value).otherwise(cell)
        out.append(cell.alias(f.name))
    return marked.select(*out)
