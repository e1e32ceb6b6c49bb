"""Comparison of two tables whose rows have no identity but their content.

Exact phase: one aggregate over the union of both sides counts every distinct row; the
k-th copy in the original matches the k-th copy in the new table. Similar phase: what
is left over is matched one to one, most similar first (see ``similar.py``).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import (
    FIXED_WIDTH,
    FLOATS,
    INTEGRALS,
    canonical,
    digest,
    missing_to_null,
    positional,
    similarity,
    wider_type,
    without_nan,
)
from ..functions.text import rendered_change
from .columns import common_columns
from .groups import SLICES, ranked, repeat_rows, rows_in_groups
from .similar import SimilarRows
from .stored import Workspace

OLD, NEW = "o", "n"


class KeylessComparison:
    """Multiset comparison on the common columns, as text, followed by similarity matching.

    ``order_by`` names an integral column of row positions on both sides. It takes no
    part in the comparison; it decides which copies of a repeated row match first and is
    reported as ``row_index``.
    """

    def __init__(
        self,
        original: DataFrame,
        new: DataFrame,
        *,
        threshold: float = 2 / 7,
        matcher: str = "auto",
        align_types: bool = False,
        order_by: str | None = None,
        workspace: Workspace | None = None,
    ):
        self.original, self.new = original, new
        self.threshold, self.matcher, self.align_types = threshold, matcher, align_types
        self.order_by = order_by
        self.common = [c for c in common_columns(original, new) if c != order_by]
        self.workspace = workspace or Workspace(original.sparkSession)
        self._cells = [f"t{i}" for i in range(len(self.common))]
        if order_by is not None:
            for df in (original, new):
                if not isinstance(df.schema[order_by].dataType, INTEGRALS):
                    raise ValueError(f"{order_by!r} must hold integral row positions")

    def close(self) -> None:
        """Drop the intermediate tables."""
        self.workspace.drop()

    # -- exact phase ----------------------------------------------------------------

    def _typed(self, side: str) -> list[tuple[Column, T.DataType]]:
        """The common cells of a positionally named frame of one side, with their types."""
        typed = []
        for c in self.common:
            i, j = self.original.columns.index(c), self.new.columns.index(c)
            old_type, new_type = self.original.schema[i].dataType, self.new.schema[j].dataType
            cell, dtype = (F.col(f"c{i}"), old_type) if side == OLD else (F.col(f"c{j}"), new_type)
            common = wider_type(old_type, new_type) if self.align_types else None
            if common is not None and common != dtype:
                cell, dtype = cell.cast(common), common
            typed.append((cell, dtype))
        return typed

    def _texts(self, side: str) -> list[Column]:
        """The canonical common cells of a positionally named frame of one side."""
        return [canonical(cell, dtype).alias(name) for name, (cell, dtype) in zip(self._cells, self._typed(side))]

    def _side(self, side: str) -> DataFrame:
        return positional(self.original if side == OLD else self.new)

    def contents(self) -> DataFrame:
        """Every distinct row (columns t0…) with its copies on both sides: n_old, n_new.

        One shuffle for both tables together; copies are combined before it.
        """
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        sides = self._typed(OLD), self._typed(NEW)
        # Cells of one short type on both sides are counted as they are: each value has a text of its own, which only
        # the rows asked for need. Zeros are told apart beside them, as 0.0 and -0.0 are one group of two texts.
        plain = [o == n and isinstance(o, FIXED_WIDTH) for (_, o), (_, n) in zip(*sides)]
        keys: list[list[Column]] = [[], []]
        texts = []
        for i, name in enumerate(self._cells):
            dtype = sides[0][i][1]
            signed = plain[i] and isinstance(dtype, FLOATS)
            for side, of in zip(sides, keys):
                cell = without_nan(side[i][0], dtype) if plain[i] else canonical(*side[i])
                of.append(cell.alias(name))
                if signed:
                    negative = F.when(cell == 0, cell.cast("string").startswith("-")).otherwise(False)
                    of.append(negative.alias(f"{name}_negative"))
            text = canonical(F.col(name), dtype) if plain[i] else F.col(name)
            if signed:
                text = F.when(F.col(f"{name}_negative"), F.lit("-0.0")).otherwise(text)
            texts.append(text.alias(name))
        old = self._side(OLD).select(*keys[0], one.alias("oc"), none.alias("nc"))
        new = self._side(NEW).select(*keys[1], none.alias("oc"), one.alias("nc"))
        return (
            old.unionAll(new)
            .groupBy(*old.columns[:-2])
            .agg(F.sum("oc").alias("n_old"), F.sum("nc").alias("n_new"))
            .select(*texts, "n_old", "n_new")
        )

    def exact_matches(self) -> DataFrame:
        """Rows found on both sides, each as often as both have it (INTERSECT ALL)."""
        matched = self.contents().withColumn("n", F.least("n_old", "n_new"))
        return self._repeated(matched)

    def unmatched(self, side: str) -> DataFrame:
        """Rows of one side beyond the copies the other side has (EXCEPT ALL)."""
        mine, other = ("n_old", "n_new") if side == OLD else ("n_new", "n_old")
        return self._repeated(self.contents().withColumn("n", F.col(mine) - F.col(other)))

    def _repeated(self, contents: DataFrame) -> DataFrame:
        rows = contents.where("n > 0").select(*self._cells, "n")
        return repeat_rows(rows, "n", "copy").select(*self._cells).toDF(*self.common)

    @cached_property
    def _uneven(self) -> DataFrame:
        """Stored: the distinct rows that do not pair off one to one.

        Everything else is one row on each side. Differences and duplicates alike are
        answered from here, so both tables are read once.
        """
        return self.workspace.store(self.contents().where("n_old <> n_new or n_old > 1"))

    @cached_property
    def _leftover(self) -> DataFrame:
        """Stored: one row per unmatched copy, with cells, copy number and side."""
        surplus = self._uneven.where("n_old <> n_new").select(
            F.array(*self._cells).cast("array<string>").alias("cells"),
            (F.col("n_new") > F.col("n_old")).alias("is_new"),
            F.abs(F.col("n_new") - F.col("n_old")).alias("n"),
            F.least("n_old", "n_new").alias("matched"),
        )
        rows = repeat_rows(surplus, "n", "copy", start=F.col("matched") + 1)
        # The id only has to be unique. It is fixed by the write; no order depends on it.
        return self.workspace.store(
            rows.select(
                F.monotonically_increasing_id().alias("rid"),
                "is_new",
                "cells",
                "copy",
                F.xxhash64("cells", "copy").alias("place"),
            )
        )

    # -- similar phase --------------------------------------------------------------

    @cached_property
    def similar(self) -> SimilarRows:
        return SimilarRows(
            self._leftover,
            len(self.common),
            threshold=self.threshold,
            matcher=self.matcher,
            workspace=self.workspace,
        )

    def similar_matches(self) -> DataFrame:
        """Matched pairs of unequal rows: similarity, old and new common cells as structs."""
        return self.similar.matches().select(
            similarity(F.col("old_cells"), F.col("new_cells")).alias("similarity"),
            self._named("old_cells").alias("old"),
            self._named("new_cells").alias("new"),
        )

    def matches(self) -> DataFrame:
        """Exact and similar matches together, told apart by ``match_kind``."""
        exact = self.exact_matches()
        row = F.struct(*[F.col(c).alias(n) for c, n in zip(self._cells, self.common)])
        exact = exact.toDF(*self._cells).select(
            F.lit("exact").alias("match_kind"),
            F.lit(1.0).alias("similarity"),
            row.alias("old"),
            row.alias("new"),
        )
        return exact.unionByName(
            self.similar_matches().withColumn("match_kind", F.lit("similar"))
        )

    def _named(self, cells: str) -> Column:
        return F.struct(*[F.col(cells)[i].alias(c) for i, c in enumerate(self.common)])

    def added_rows(self) -> DataFrame:
        return self._remaining(is_new=True)

    def deleted_rows(self) -> DataFrame:
        return self._remaining(is_new=False)

    def _remaining(self, is_new: bool) -> DataFrame:
        rows = self.similar.unmatched().where(F.col("is_new") == F.lit(is_new))
        return rows.select(*[F.col("cells")[i] for i in range(len(self.common))]).toDF(*self.common)

    # -- changes --------------------------------------------------------------------

    def _changes(self) -> Column:
        entries = [
            F.when(
                F.col("old_cells")[i] != F.col("new_cells")[i],
                F.struct(
                    F.lit(c).alias("key"),
                    F.struct(
                        F.col("old_cells")[i].alias("old"), F.col("new_cells")[i].alias("new")
                    ).alias("value"),
                ),
            )
            for i, c in enumerate(self.common)
        ]
        return F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))

    def _matches_with_index(self) -> DataFrame:
        pairs = self.similar.matches()
        if self.order_by is None:
            return pairs.withColumn("row_index", F.lit(None).cast("long"))
        return pairs.withColumn("d", _cells_digest("new_cells", len(self.common))).join(
            self._positions(pairs), ["d", "new_copy"]
        )

    def _positions(self, pairs: DataFrame) -> DataFrame:
        """Positions (row_index) of the new-side copies whose content was matched."""
        position = F.col(f"c{self.new.columns.index(self.order_by)}").cast("long")
        rows = self._side(NEW).select(
            digest(self._texts(NEW)).alias("d"), position.alias("row_index")
        )
        wanted = pairs.groupBy(_cells_digest("new_cells", len(self.common)).alias("d")).agg(
            F.max("new_copy").alias("n")
        )
        rows = rows_in_groups(rows, wanted, ["d"])
        # Slices hold about equally many rows, wherever the positions lie.
        shares = [i / SLICES for i in range(1, SLICES)]
        bounds = self._side(NEW).agg(
            F.percentile_approx(position, F.lit(shares), F.lit(10 * SLICES)).alias("b")
        ).first()["b"]
        bounds = sorted(set(bounds or []))
        rows = rows.withColumn("slice", _bounds_below(F.col("row_index"), bounds))
        return ranked(rows, ["d"], "slice", [F.col("row_index")], "new_copy").select(
            "d", F.col("new_copy").cast("long").alias("new_copy"), "row_index"
        )

    def updated_details(self) -> DataFrame:
        """row_index, the changes as a map, and the new row's common cells as ``row_data``."""
        return self._matches_with_index().select(
            "row_index", self._changes().alias("changes"), self._named("new_cells").alias("row_data")
        )

    def updated_rows(self) -> DataFrame:
        cells = [F.col("new_cells")[i] for i in range(len(self.common))]
        return self.similar.matches().select(*cells).toDF(*self.common)

    def cell_changes(self) -> DataFrame:
        """One row per changed cell: row_index, column_name, old_value, new_value."""
        return (
            self._matches_with_index()
            .select("row_index", F.explode(self._changes()).alias("column_name", "v"))
            .select(
                "row_index",
                "column_name",
                F.col("v.old").alias("old_value"),
                F.col("v.new").alias("new_value"),
            )
        )

    def rendered_updates(self, missing: str = "") -> DataFrame:
        cells = []
        for i in range(len(self.common)):
            old, new = F.col("old_cells")[i], F.col("new_cells")[i]
            cells.append(F.when(old != new, rendered_change(old, new, missing)).otherwise(new))
        return self.similar.matches().select(*cells).toDF(*self.common)

    # -- duplicates and counts ------------------------------------------------------

    def duplicate_rows(self, side: str) -> DataFrame:
        """All rows of one side whose common cells occur more than once there; every
        column of that side, native types."""
        df = self.original if side == OLD else self.new
        count = "n_old" if side == OLD else "n_new"
        repeated = self._uneven.where(F.col(count) > 1).select(
            digest([F.col(c) for c in self._cells]).alias("d"), F.col(count).alias("n")
        )
        rows = self._side(side).withColumn("d", digest(self._texts(side)))
        rows = rows_in_groups(rows, repeated, ["d"]).drop("d")
        return missing_to_null(rows).toDF(*df.columns)

    def counts(self) -> DataFrame:
        """One row of counts."""
        spark = self.original.sparkSession
        repeated = self._uneven.agg(
            F.sum(F.when(F.col("n_old") > 1, F.col("n_old"))).alias("old"),
            F.sum(F.when(F.col("n_new") > 1, F.col("n_new"))).alias("new"),
        ).first()
        updated = self.similar.pair_count
        source, target = self.original.count(), self.new.count()
        deleted, added = self.similar.old_count - updated, self.similar.new_count - updated
        row = {
            "added_rows_count": added,
            "deleted_rows_count": deleted,
            "updated_rows_count": updated,
            "duplicate_rows_in_source_count": repeated["old"] or 0,
            "duplicate_rows_in_target_count": repeated["new"] or 0,
            "matched_keys": source - deleted - updated,
            "source_rows": source,
            "target_rows": target,
        }
        schema = T.StructType([T.StructField(k, T.LongType()) for k in row])
        return spark.createDataFrame([tuple(row.values())], schema)


def _cells_digest(cells: str, width: int) -> Column:
    return digest([F.col(cells)[i] for i in range(width)])


def _bounds_below(value: Column, bounds: list[int], step: int = 32) -> Column:
    """How many of the ascending bounds are at most the value: every 32nd first, then those after."""

    def below(some: Column) -> Column:
        return F.size(F.filter(some, lambda x: x <= value))

    every = F.array(*[F.lit(x) for x in bounds]).cast("array<long>")
    coarse = F.array(*[F.lit(x) for x in bounds[step - 1 :: step]]).cast("array<long>")
    passed = below(coarse) * step
    return passed + below(F.slice(every, passed + 1, F.lit(step)))
