"""Compare an original with a new version of a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.cells import quoted
from ..functions.text import percent_text
from ..operators.columns import (
    added_columns,
    column_name_frame,
    column_widths,
    common_columns,
    deleted_columns,
    unique_column,
)
from ..operators.keyed import NEW, OLD, KeyedComparison
from ..operators.keyless import KeylessComparison

KEY, ASSUMED_KEY, NO_KEY = "key", "assumed_key", "no_key"
SUMMARY_COUNTS = (
    "added_columns_count",
    "deleted_columns_count",
    "added_rows_count",
    "deleted_rows_count",
    "updated_rows_count",
    "duplicate_rows_in_source_count",
    "duplicate_rows_in_target_count",
)
# Names of the report rows.
ROWS_ONLY_IN_TARGET = "Rows_only_in_target"
ROWS_ONLY_IN_SOURCE = "Rows_only_in_source"
MISMATCHED = "Mismatch_rows_from_source_to_target"
MATCHED = "Matched_rows_from_source_to_target"
TOTAL_IN_SOURCE = "Total_rows_in_source"
TOTAL_IN_TARGET = "Total_rows_in_target"
# Fixed value: a count above this share of the source rows is severe.
SEVERE_SHARE = 0.05


def compare(
    original: DataFrame,
    new: DataFrame,
    key: str | Sequence[str] | None = None,
    *,
    discover: bool = False,
    nulls: str = "safe",
    match_null_keys: bool = False,
    align_types: bool = False,
    threshold: float = 2 / 7,
    matcher: str = "auto",
    order_by: str | Sequence[str] | None = None,
) -> Diff:
    """Compare two tables.

    With ``key``, rows are matched by it. With ``discover=True`` and no key, the leftmost
    column of the original whose values are all present and different is taken. Without
    a key, equal rows are matched first and then the most similar ones.

    ``order_by`` names position columns (on both sides) for everything that depends on
    row order: the last of several rows with one key counts, the first copies of a
    repeated row match first, and ``row_index`` is reported. Without it such choices
    follow the rows' content.
    """
    if nulls not in ("safe", "unequal"):
        raise ValueError("nulls must be 'safe' or 'unequal'")
    method = KEY
    keys = [key] if isinstance(key, str) else list(key or ())
    if not keys:
        method = NO_KEY
        found = unique_column(original) if discover else None
        if found is not None and found in new.columns:
            keys, method = [found], ASSUMED_KEY
    order = [order_by] if isinstance(order_by, str) else list(order_by or ())
    if keys:
        comparison = KeyedComparison(
            original,
            new,
            keys,
            nulls=nulls,
            match_null_keys=match_null_keys,
            align_types=align_types,
            order_by=order,
        )
    else:
        if len(order) > 1:
            raise ValueError("without a key, order_by is one position column")
        comparison = KeylessComparison(
            original,
            new,
            threshold=threshold,
            matcher=matcher,
            align_types=align_types,
            order_by=order[0] if order else None,
        )
    return Diff(comparison, method)


class Diff:
    """The result of a comparison. Every row result is a lazy DataFrame; with a key, the first one asked for
    runs the pass that lists the keys which differ. ``close()`` drops that list."""

    def __init__(self, comparison: KeyedComparison | KeylessComparison, method: str):
        self.comparison, self.method = comparison, method
        self.original, self.new = comparison.original, comparison.new
        self.spark = self.original.sparkSession
        self._kept: dict[str, DataFrame] = {}

    # -- columns --------------------------------------------------------------------

    @property
    def key(self) -> list[str]:
        return getattr(self.comparison, "key", [])

    @property
    def added_columns(self) -> list[str]:
        return added_columns(self.original, self.new)

    @property
    def deleted_columns(self) -> list[str]:
        return deleted_columns(self.original, self.new)

    def columns_only_in_target(self) -> DataFrame:
        return column_name_frame(self.spark, self.added_columns)

    def columns_only_in_source(self) -> DataFrame:
        return column_name_frame(self.spark, self.deleted_columns)

    @property
    def common_columns(self) -> list[str]:
        return common_columns(self.original, self.new)

    # -- rows -----------------------------------------------------------------------

    def added_rows(self) -> DataFrame:
        return self._answer("added_rows")

    def deleted_rows(self) -> DataFrame:
        return self._answer("deleted_rows")

    def updated_rows(self) -> DataFrame:
        return self._answer("updated_rows")

    def updated_details(self) -> DataFrame:
        return self._answer("updated_details")

    def cell_changes(self) -> DataFrame:
        return self._answer("cell_changes")

    def rendered_updates(self, missing: str = "") -> DataFrame:
        return self._answer("rendered_updates", missing)

    def duplicates_in_source(self) -> DataFrame:
        return self._answer("duplicate_rows", OLD)

    def duplicates_in_target(self) -> DataFrame:
        return self._answer("duplicate_rows", NEW)

    def _answer(self, name: str, *arguments: str) -> DataFrame:
        kept = self._kept.get(" ".join([name, *arguments]))
        return kept if kept is not None else getattr(self.comparison, name)(*arguments)

    def detach(self) -> Diff:
        """Keep all results, so that they outlive a change of the two inputs; ``close()`` drops
        them. Only rows that differ or repeat are written."""
        self.store()
        workspace = self.comparison.workspace
        wanted = [("added_rows",), ("deleted_rows",), ("updated_rows",), ("updated_details",),
                  ("cell_changes",), ("rendered_updates", ""), ("duplicate_rows", OLD),
                  ("duplicate_rows", NEW)]
        counts = workspace.store(self.counts())
        for name, *arguments in wanted:
            rows = self._answer(name, *arguments)
            # stored under plain names, since a table's own may differ in case only
            plain = workspace.store(rows.toDF(*[f"c{i}" for i in range(len(rows.columns))]))
            self._kept[" ".join([name, *arguments])] = plain.toDF(*rows.columns)
        self._kept["counts"] = counts
        return self

    # -- counts ---------------------------------------------------------------------

    def counts(self) -> DataFrame:
        """One row: the seven summary counts, matched_keys, source_rows, target_rows."""
        if "counts" in self._kept:
            return self._kept["counts"]
        counts = self.comparison.counts()
        return counts.select(
            F.lit(len(self.added_columns)).cast("long").alias("added_columns_count"),
            F.lit(len(self.deleted_columns)).cast("long").alias("deleted_columns_count"),
            "*",
        )

    @cached_property
    def count_values(self) -> dict[str, int]:
        return self.counts().first().asDict()

    def summary(self) -> DataFrame:
        return self.counts().select(*SUMMARY_COUNTS)

    def change_score(self) -> DataFrame:
        """One row: the sum of the seven summary counts."""
        total = F.lit(0).cast("long")
        for c in SUMMARY_COUNTS:
            total = total + F.col(c)
        return self.counts().select(total.alias("change_score"))

    def reconciliation(self, matched: str = "net") -> DataFrame:
        """Six rows: details, count, percentage (of the source rows, as number and text).

        ``matched="net"``: source rows that were neither updated nor deleted.
        ``matched="less_added"`` subtracts the added rows as well.
        """
        if matched not in ("net", "less_added"):
            raise ValueError("matched must be 'net' or 'less_added'")
        source, target = F.col("source_rows"), F.col("target_rows")
        equal = source - F.col("updated_rows_count") - F.col("deleted_rows_count")
        if matched == "less_added":
            equal = equal - F.col("added_rows_count")
        lines = [
            (ROWS_ONLY_IN_TARGET, F.col("added_rows_count")),
            (ROWS_ONLY_IN_SOURCE, F.col("deleted_rows_count")),
            (MISMATCHED, F.col("updated_rows_count")),
            (MATCHED, equal),
            (TOTAL_IN_SOURCE, source),
            (TOTAL_IN_TARGET, target),
        ]
        rows = F.array(
            *[
                F.struct(
                    F.lit(i).alias("line"),
                    F.lit(name).alias("details"),
                    count.alias("count"),
                    F.when(source > 0, count / source * 100).alias("percent"),
                    source.alias("source_rows"),
                )
                for i, (name, count) in enumerate(lines, 1)
            ]
        )
        return (
            self.counts()
            .select(F.inline(rows))
            .select(
                "line", "details", "count", "percent",
                percent_text(F.col("percent")).alias("percentage"), "source_rows",
            )
        )

    def severity(self, matched: str = "net") -> DataFrame:
        """The report lines 1 to 4 with a band: high over five percent of the source rows,
        none at zero, else low. Totals have no band."""
        count = F.col("count")
        band = (
            F.when(count > F.col("source_rows") * SEVERE_SHARE, "high")
            .when(count == 0, "none")
            .otherwise("low")
        )
        return self.reconciliation(matched).select(
            "details", "count", F.when(F.col("line") <= 4, band).otherwise("total").alias("severity")
        )

    def outcome_share(self, matched: str = "net") -> DataFrame:
        """The report lines 1 to 4 as shares of their sum."""
        lines = self.reconciliation(matched).where("line <= 4")
        # Over these four rows the sum is source rows plus, for "net", the added rows.
        total = F.sum("count").over(_whole_report())
        return lines.select(
            "details", "count", F.when(total != 0, F.col("count") / total).alias("share")
        )

    # -- reports --------------------------------------------------------------------

    def preview(self, rows: int = 5, duplicates: int = 4) -> DataFrame:
        """The first rows of each category as JSON, and how many more there are."""
        self.store()
        counts = self.count_values
        parts = [
            ("added", self.added_rows(), counts["added_rows_count"], rows),
            ("deleted", self.deleted_rows(), counts["deleted_rows_count"], rows),
            ("updated", self.updated_details(), counts["updated_rows_count"], rows),
            ("duplicate_in_source", self.duplicates_in_source(),
             counts["duplicate_rows_in_source_count"], duplicates),
            ("duplicate_in_target", self.duplicates_in_target(),
             counts["duplicate_rows_in_target_count"], duplicates),
        ]
        shown = None
        for category, df, total, n in parts:
            lines = _as_json(df, self.key).orderBy("place", "row").limit(n)
            lines = lines.select(
                F.lit(category).alias("category"),
                "row",
                F.lit(max(0, total - n)).cast("long").alias("remaining"),
            )
            shown = lines if shown is None else shown.unionAll(lines)
        return shown

    def tables(self) -> dict[str, DataFrame]:
        """The report: eight tables by name."""
        return {
            "columns_only_in_target": self.columns_only_in_target(),
            "columns_only_in_source": self.columns_only_in_source(),
            "rows_only_in_target": self.added_rows(),
            "rows_only_in_source": self.deleted_rows(),
            "duplicate_rows_in_source": self.duplicates_in_source(),
            "duplicate_rows_in_target": self.duplicates_in_target(),
            "mismatched_rows": self.rendered_updates(),
            "summary": self.reconciliation().select("details", "count", "percentage"),
        }

    def table_widths(self) -> DataFrame:
        """Display width of every column of every report table that has rows."""
        self.store()
        widths = None
        for name, df in self.tables().items():
            part = column_widths(df).select(F.lit(name).alias("table"), "*")
            widths = part if widths is None else widths.unionAll(part)
        return widths

    def store(self) -> Diff:
        """Keep the differing rows as an intermediate table, so that a report of many parts
        reads the two inputs once. Keyless comparisons always do."""
        if isinstance(self.comparison, KeyedComparison):
            self.comparison.store()
        return self

    def close(self) -> None:
        """Drop the intermediate tables; results that were not written are gone."""
        self.comparison.close()
        self._kept.clear()

    def __enter__(self) -> Diff:
        return self

    def __exit__(self, *error) -> None:
        self.close()


def _whole_report() -> Window:
    # At most six report lines: the single partition is bounded.
    return Window.partitionBy(F.lit(0))


def _as_json(df: DataFrame, key: list[str]) -> DataFrame:
    place: list[Column] = [quoted(k) for k in key if k in df.columns]
    return df.select(
        (F.struct(*place) if place else F.lit(0)).alias("place"),
        F.to_json(F.struct(*[quoted(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("row"),
    )
