"""Schema comparison and per-column profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import as_text, hashable, internal_names, missing_to_null, positional, without_nan

COLUMN_NAME = T.StructType([T.StructField("column_name", T.StringType())])
# A column is skipped without an exact count only when its estimate is at most half of
# the rows: 25 standard errors away from unique.
ESTIMATE_ERROR = 0.02
CLEARLY_REPEATED = 0.5
ROW_FORMATS = {"csv", "json", "text", "xml"}


def added_columns(original: DataFrame, new: DataFrame) -> list[str]:
    return sorted(set(new.columns) - set(original.columns))


def deleted_columns(original: DataFrame, new: DataFrame) -> list[str]:
    return sorted(set(original.columns) - set(new.columns))


def common_columns(original: DataFrame, new: DataFrame) -> list[str]:
    return sorted(set(original.columns) & set(new.columns))


def column_name_frame(spark, names: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], COLUMN_NAME)


def profile_uniqueness(df: DataFrame, one_scan: bool | None = None) -> DataFrame:
    """Duplicates per column: (ordinal, column_name, duplicate_count, total_rows).

    ``count(*) - count(distinct c)``, so every missing cell counts as a duplicate. From a columnar source one
    branch per column reads only that column and shuffles only its distinct values. Where a branch would
    parse whole rows again (``one_scan``; by default where a text format is read), all columns come from one
    scan as (column, digest of 128 bits) pairs, which combine before their one shuffle.
    """
    if one_scan is None:
        one_scan = _reads_rows(df)
    return _profile(df, range(len(df.columns)), one_scan)


def _profile(df: DataFrame, ordinals: Sequence[int], one_scan: bool) -> DataFrame:
    return (_profile_in_one_scan if one_scan and len(ordinals) > 1 else _exact_profile)(df, ordinals)


def _reads_rows(df: DataFrame) -> bool:
    """Whether a leaf of the plan is a file whose rows can only be read whole."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves().mkString("\n").splitlines()
    return any(leaf.startswith("Relation") and leaf.rsplit(" ", 1)[-1] in ROW_FORMATS for leaf in leaves)


def _profile_in_one_scan(df: DataFrame, ordinals: Sequence[int]) -> DataFrame:
    cells = missing_to_null(positional(df))
    digests = []
    for i in ordinals:
        dtype = cells.schema[i].dataType
        value = as_text(F.col(f"c{i}"), dtype) if _without_order(dtype) else hashable(F.col(f"c{i}"), dtype)
        # two hashes by different functions: equal pairs of unequal cells are out of reach at any size
        pair = F.struct(F.xxhash64(value).alias("a"), F.xxhash64(F.lit(i), F.lit("b"), value).alias("b"))
        digests.append(F.struct(F.lit(i).alias("ordinal"), F.when(F.col(f"c{i}").isNotNull(), pair).alias("digest")))
    each = cells.select(F.inline(F.array(*digests))).groupBy("ordinal", "digest").agg(F.count(F.lit(1)).alias("rows"))
    counts = each.groupBy("ordinal").agg(
        (F.sum("rows") - F.count("digest")).alias("duplicate_count"), F.sum("rows").alias("total_rows")
    )
    # an empty table has a line per column too
    names = df.sparkSession.createDataFrame(
        [(i, df.columns[i]) for i in ordinals], "ordinal int, column_name string"
    )
    return names.join(F.broadcast(counts), "ordinal", "left").select(
        "ordinal",
        "column_name",
        F.coalesce("duplicate_count", F.lit(0)).cast("long").alias("duplicate_count"),
        F.coalesce("total_rows", F.lit(0)).cast("long").alias("total_rows"),
    )


def _exact_profile(df: DataFrame, ordinals: Sequence[int]) -> DataFrame:
    cells = missing_to_null(positional(df))
    branches = None
    for i in ordinals:
        name, dtype = df.columns[i], cells.schema[i].dataType
        col = F.col(f"c{i}")
        if _without_order(dtype):
            col = as_text(col, dtype)
        branch = cells.agg(
            F.lit(i).alias("ordinal"),
            F.lit(name).alias("column_name"),
            (F.count(F.lit(1)) - F.count_distinct(col)).alias("duplicate_count"),
            F.count(F.lit(1)).alias("total_rows"),
        )
        branches = branch if branches is None else branches.unionAll(branch)
    return branches


def _without_order(dtype: T.DataType) -> bool:
    """Whether cells can be told apart only as texts."""
    return "map<" in dtype.simpleString() or isinstance(dtype, T.VariantType)


def best_candidate(profile: DataFrame) -> DataFrame:
    """The column with the fewest duplicates, the leftmost of several."""
    return profile.orderBy("duplicate_count", "ordinal").limit(1)


def accepted_key(profile: DataFrame) -> DataFrame:
    """The best candidate, if it has no duplicates and the table has rows."""
    return best_candidate(profile).where("duplicate_count = 0 and total_rows > 0")


def unique_column(df: DataFrame) -> str | None:
    """The leftmost column whose values are all present and different.

    One pass estimates the distinct count of all columns. Columns with a missing cell
    or with clearly repeated values are out; the others are counted exactly.
    """
    cells = missing_to_null(positional(df))
    estimates = [F.count(F.lit(1)).alias("rows")]
    for f in cells.schema:
        col = F.col(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            col = as_text(col, f.dataType)
        estimates.append(F.count(col).alias(f"n_{f.name}"))
        estimates.append(F.approx_count_distinct(col, ESTIMATE_ERROR).alias(f"d_{f.name}"))
    seen = cells.agg(*estimates).first()
    if not seen["rows"]:
        return None
    plausible = [
        i
        for i, c in enumerate(internal_names(df))
        if seen[f"n_{c}"] == seen["rows"] and seen[f"d_{c}"] > CLEARLY_REPEATED * seen["rows"]
    ]
    if not plausible:
        return None
    found = accepted_key(_profile(df, plausible, _reads_rows(df))).first()
    return found["column_name"] if found else None


def column_widths(df: DataFrame) -> DataFrame:
    """Display width per column: the longest text or the name, plus two.

    All columns in one aggregate; a missing cell has length zero. No rows for an empty
    table.
    """
    cells = positional(df)
    longest = [
        F.max(F.coalesce(F.length(as_text(without_nan(F.col(f.name), f.dataType), f.dataType)), F.lit(0)))
        for f in cells.schema
    ]
    rows = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(name).alias("column_name"),
            (F.greatest(width, F.lit(len(name))) + 2).alias("width"),
        )
        for i, (name, width) in enumerate(zip(df.columns, longest))
    ]
    profile = cells.agg(F.count(F.lit(1)).alias("rows"), F.array(*rows).alias("widths"))
    return profile.where("rows > 0").select(F.inline("widths"))
