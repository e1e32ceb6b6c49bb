"""Comparison of two tables whose rows are identified by key columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import (
    NESTED,
    as_text,
    differs,
    hashable_pair,
    missing_to_null,
    positional,
    wider_type,
)
from ..functions.text import rendered_change
from .columns import common_columns
from .groups import HEAVY_KEYS, add_identity, rows_in_groups
from .stored import Workspace

OLD, NEW = "o", "n"


def _last(row: str, dtype: T.DataType, places: int) -> Column:
    """The greatest row: by its place, then by its content; rows holding maps, which have no
    order, go by the hash of their text where their places are equal."""
    if "map<" in dtype.simpleString() or "variant" in dtype.simpleString():
        order = F.struct(
            *[F.col(f"{row}.p{i}") for i in range(places)], F.xxhash64(as_text(F.col(row), dtype))
        )
        return F.max_by(row, F.when(F.col(row).isNotNull(), order))
    return F.max(row)


class KeyedComparison:
    """Two tables brought together with one shuffle.

    Both sides are reduced to one row per key (its last row and its row count) by a
    single aggregate over their union. Rows are combined before the shuffle, so a key
    that holds a third of a table arrives as one row per task; there is no join, and
    nothing can multiply when a key repeats on both sides.
    """

    def __init__(
        self,
        original: DataFrame,
        new: DataFrame,
        key: Sequence[str],
        *,
        nulls: str = "safe",
        match_null_keys: bool = False,
        align_types: bool = False,
        order_by: Sequence[str] = (),
    ):
        self.original, self.new, self.key = original, new, list(key)
        self.nulls, self.align_types = nulls, align_types
        self.match_null_keys = match_null_keys
        self.order_by = list(order_by)
        self.common = common_columns(original, new)
        missing = [k for k in self.key if k not in self.common]
        if missing or not self.key:
            raise ValueError(f"key columns must be on both sides, missing: {missing}")
        self._old = missing_to_null(positional(original))
        self._new = missing_to_null(positional(new))
        self._key_names = [f"k{i}" for i in range(len(self.key))]
        self._old_keys, self._new_keys = self._aligned_keys()
        self._stored: DataFrame | None = None
        self._open: DataFrame | None = None
        self.workspace: Workspace | None = None

    def open_keys(self) -> DataFrame:
        """:meth:`profile` without the keys that are one equal row on each side, as a written table.

        Digests tell which keys to look at; only their rows are brought together. The first result asked for
        runs this one pass, which also counts what it leaves out; all others start from the list.
        """
        if self._open is None:
            self.workspace = self.workspace or Workspace(self.original.sparkSession)
            passed = Observation()
            profile = self.profile().observe(
                passed,
                F.count(F.when(F.col("equal"), 1)).alias("equal"),
                F.count(F.when((F.col("o_rows") > 1) | (F.col("n_rows") > 1), 1)).alias("repeated"),
            )
            self._open = self.workspace.store(profile.where(~F.col("equal")))
            found = passed.get
            self._equal_keys, self._repeated_keys = found.get("equal") or 0, found.get("repeated") or 0
        return self._open

    def store(self, workspace: Workspace | None = None) -> None:
        """Keep every key that is not one equal row on each side as a table.

        Later results are answered from it, so a report of many parts reads the two
        tables once.
        """
        if self._stored is None:
            self.workspace = self.workspace or workspace
            uneven = ~F.col("is_common") | (F.col("o_rows") > 1) | (F.col("n_rows") > 1)
            keys = self.keys().where(uneven | self._changed())
            self._stored = self.workspace.store(keys)

    def close(self) -> None:
        """Drop the intermediate tables; lazy results that were not written are gone."""
        if self.workspace is not None:
            self.workspace.drop()
        self.workspace = self._open = self._stored = None

    # -- the joined form ------------------------------------------------------------

    def _aligned_keys(self) -> tuple[list[Column], list[Column]]:
        """Key expressions of both sides, of one type so that they can share a shuffle."""
        old_keys, new_keys = [], []
        for name, key in zip(self._key_names, self.key):
            (oc, ot), (nc, nt) = self._cell(OLD, key), self._cell(NEW, key)
            common = wider_type(ot, nt)
            if common is not None:
                oc, nc = oc.cast(common), nc.cast(common)
                if isinstance(common, NESTED):
                    oc, nc = as_text(oc, common), as_text(nc, common)
            else:
                oc, nc = as_text(oc, ot), as_text(nc, nt)
                if not self.align_types:
                    # Text and number never match: keep the two sides apart.
                    oc, nc = F.concat(F.lit("o:"), oc), F.concat(F.lit("n:"), nc)
            old_keys.append(oc.alias(name))
            new_keys.append(nc.alias(name))
        return old_keys, new_keys

    def _cell(self, side: str, column: str, prefix: str = "") -> tuple[Column, T.DataType]:
        df, frame = (self.original, self._old) if side == OLD else (self.new, self._new)
        i = df.columns.index(column)
        return F.col(f"{prefix}c{i}"), frame.schema[i].dataType

    def _one_side(
        self, side: str, payload: Sequence[str], among: DataFrame | None = None
    ) -> DataFrame:
        """Keys and one struct ``row`` = (place, cells) whose maximum is the last row.

        "Last" follows ``order_by``; rows without an order, or equal in it, go by their
        content. The compared cells lead the struct, so the choice is the same however
        many of the other columns a result needs.
        """
        frame = self._old if side == OLD else self._new
        if among is not None:
            frame = self._rows_of(side, among)
        keys = self._old_keys if side == OLD else self._new_keys
        place = [
            self._cell(side, c)[0].alias(f"p{i}") for i, c in enumerate(self.order_by)
        ]
        cells = [F.col(c) for c in payload] or [F.lit(0).alias("c")]
        return frame.select(*keys, F.struct(*place, *cells).alias("row"))

    # -- digests --------------------------------------------------------------------

    def _digests(self, side: str) -> list[Column]:
        """Two hashes of the compared cells, equal where no cell differs, and whether one is missing."""
        cells = [self._pair(c)[side == NEW] for c in self.compared]
        missing = [self._cell(side, c)[0].isNull() for c in self.compared]
        any_missing = F.lit(False)
        for m in missing:
            any_missing = any_missing | m
        return [
            F.xxhash64(F.lit(1), *cells, *missing),
            F.xxhash64(F.lit(2), *reversed(cells), *missing),
            any_missing.cast("int"),
        ]

    def _pair(self, column: str) -> tuple[Column, Column]:
        """Both sides' cells of a column, as values whose hashes are equal where the cells are."""
        (oc, ot), (nc, nt) = self._cell(OLD, column), self._cell(NEW, column)
        return hashable_pair(oc, ot, nc, nt, align_types=self.align_types)

    def profile(self) -> DataFrame:
        """One row per key: k0…, o_rows, n_rows, is_added, is_deleted, is_common, n (rows of
        both sides), ``equal`` (one row on each side, the same cells) and ``single`` (one row on
        each side, whatever its cells).

        Rows are reduced to two hashes before the shuffle, and both sides of it aggregate by hash:
        nothing is sorted, and no cell of a row that did not change is moved.
        """
        names = ["d1", "d2", "m"]
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")

        def side(frame, keys, which, other):
            own = [d.alias(f"{which}{name}") for d, name in zip(self._digests(which), names)]
            empty = [
                F.lit(None).cast("int" if name == "m" else "long").alias(f"{other}{name}")
                for name in names
            ]
            rows = [(one if w == which else none).alias(f"{w}c") for w in (OLD, NEW)]
            columns = own + empty if which == OLD else empty + own
            return frame.select(*keys, *rows, *columns)

        both = side(self._old, self._old_keys, OLD, NEW).unionAll(
            side(self._new, self._new_keys, NEW, OLD)
        )
        grouped = both.groupBy(*self._key_names).agg(
            F.sum("oc").alias("o_rows"),
            F.sum("nc").alias("n_rows"),
            *[F.bit_xor(f"{w}{d}").alias(f"{w}{d}") for w in (OLD, NEW) for d in ("d1", "d2")],
            F.max("om").alias("om"),
            F.max("nm").alias("nm"),
        )
        single = F.col("is_common") & (F.col("o_rows") == 1) & (F.col("n_rows") == 1)
        same = (F.col("od1") == F.col("nd1")) & (F.col("od2") == F.col("nd2"))
        if self.nulls == "unequal":  # two missing cells are a change, which digests do not show
            unsure = (F.col("om") == 1) & (F.col("nm") == 1)
            same, single = same & ~unsure, single & ~unsure
        return (
            self._classified(grouped)
            .withColumn("n", F.col("o_rows") + F.col("n_rows"))
            .withColumn("single", F.coalesce(single, F.lit(False)))
            .withColumn("equal", F.col("single") & F.coalesce(same, F.lit(False)))
            .drop("od1", "od2", "nd1", "nd2", "om", "nm")
        )

    def _payload(self, side: str, columns: Sequence[str] | None) -> list[str]:
        df = self.original if side == OLD else self.new
        leading = [f"c{df.columns.index(c)}" for c in self.compared]
        if columns is None:
            columns = [f"c{i}" for i in range(len(df.columns))]
        return [c for c in leading if c in columns] + [c for c in columns if c not in leading]

    def keys(
        self, old_payload=None, new_payload=None, every: bool = False, common: bool = False
    ) -> DataFrame:
        """One row per key that is not one equal row on each side: k0…, o, n (last rows), o_rows, n_rows,
        is_added, is_deleted, is_common. Once stored, keys that turned out unchanged are left out too, unless
        ``every`` key is asked for, and keys of one side alone where only ``common`` ones are."""
        if self._stored is not None and not every:
            return self._stored
        payloads = {OLD: self._payload(OLD, old_payload), NEW: self._payload(NEW, new_payload)}
        open_keys = self.open_keys().where("is_common") if common else self.open_keys()
        repeated = (F.col("o_rows") > 1) | (F.col("n_rows") > 1)
        single = self._classified(self._paired(payloads, open_keys.where(~repeated)))
        if not self._repeated_keys:
            return single
        return single.unionByName(self._classified(self._last_rows(payloads, open_keys.where(repeated))))

    def _paired(self, payloads: dict[str, list[str]], among: DataFrame) -> DataFrame:
        """Keys with at most one row on each side: both rows side by side, nothing to choose."""
        names = self._key_names
        old, new = (self._one_side(side, payloads[side], among) for side in (OLD, NEW))
        old = old.select(*names, F.col("row").alias(OLD))
        new = new.select(*[F.col(k).alias(f"_{k}") for k in names], F.col("row").alias(NEW))
        same = F.lit(True)
        for k in names:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        both = old.join(new, same, "full_outer")
        # Where the old row is missing its key is too, and null otherwise only if the new one is.
        return both.select(
            *[F.coalesce(k, f"_{k}").alias(k) for k in names],
            OLD,
            NEW,
            F.col(OLD).isNotNull().cast("long").alias("o_rows"),
            F.col(NEW).isNotNull().cast("long").alias("n_rows"),
        )

    def _last_rows(self, payloads: dict[str, list[str]], among: DataFrame) -> DataFrame:
        """Repeated keys: their last row on each side, chosen by one aggregate over both, before and after the
        shuffle, so that a key that holds a third of a table arrives as one row per task."""
        old, new = (self._one_side(side, payloads[side], among) for side in (OLD, NEW))
        empty_old = F.lit(None).cast(old.schema["row"].dataType)
        empty_new = F.lit(None).cast(new.schema["row"].dataType)
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        k = self._key_names
        both = old.select(
            *k, F.col("row").alias(OLD), empty_new.alias(NEW), one.alias("oc"), none.alias("nc")
        ).unionAll(
            new.select(
                *k, empty_old.alias(OLD), F.col("row").alias(NEW), none.alias("oc"), one.alias("nc")
            )
        )
        return both.groupBy(*k).agg(
            _last(OLD, old.schema["row"].dataType, len(self.order_by)).alias(OLD),
            _last(NEW, new.schema["row"].dataType, len(self.order_by)).alias(NEW),
            F.sum("oc").alias("o_rows"),
            F.sum("nc").alias("n_rows"),
        )

    def key_counts(self) -> DataFrame:
        """Keys and row counts of both sides: reads and shuffles only the key columns."""
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        both = self._old.select(*self._old_keys, one.alias("oc"), none.alias("nc")).unionAll(
            self._new.select(*self._new_keys, none.alias("oc"), one.alias("nc"))
        )
        grouped = both.groupBy(*self._key_names).agg(
            F.sum("oc").alias("o_rows"), F.sum("nc").alias("n_rows")
        )
        return self._classified(grouped)

    def _classified(self, grouped: DataFrame) -> DataFrame:
        in_old, in_new = F.col("o_rows") > 0, F.col("n_rows") > 0
        matchable = F.lit(True) if self.match_null_keys else ~self._null_key()
        return (
            grouped.withColumn("is_common", in_old & in_new & matchable)
            .withColumn("is_added", in_new & ~F.col("is_common"))
            .withColumn("is_deleted", in_old & ~F.col("is_common"))
        )

    def _null_key(self) -> Column:
        missing = F.lit(False)
        for k in self._key_names:
            missing = missing | F.col(k).isNull()
        return missing

    # -- cell comparison ------------------------------------------------------------

    @property
    def compared(self) -> list[str]:
        return [c for c in self.common if c not in self.key]

    def _cell_differs(self, column: str) -> Column:
        (oc, ot), (nc, nt) = self._cell(OLD, column, "o."), self._cell(NEW, column, "n.")
        return differs(oc, ot, nc, nt, nulls=self.nulls, align_types=self.align_types)

    def _changed(self) -> Column:
        changed = F.lit(False)
        for c in self.compared:
            changed = changed | self._cell_differs(c)
        return F.col("is_common") & changed

    def _changes(self) -> Column:
        """Map from column to (old, new) as text, holding only the changed cells."""
        entries = []
        for c in self.compared:
            (oc, ot), (nc, nt) = self._cell(OLD, c, "o."), self._cell(NEW, c, "n.")
            entry = F.struct(
                F.lit(c).alias("key"),
                F.struct(as_text(oc, ot).alias("old"), as_text(nc, nt).alias("new")).alias("value"),
            )
            entries.append(F.when(self._cell_differs(c), entry))
        if not entries:
            return F.lit(None).cast("map<string,struct<old:string,new:string>>")
        return F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))

    def _payloads_for_cells(self) -> tuple[list[str], list[str]]:
        old = [f"c{self.original.columns.index(c)}" for c in self.compared]
        new = [f"c{self.new.columns.index(c)}" for c in self.compared]
        return old, new

    def _key_output(self) -> list[Column]:
        """The key of an updated row with its own names and new-side types."""
        return [self._cell(NEW, k, "n.")[0].alias(k) for k in self.key]

    # -- results --------------------------------------------------------------------

    def statuses(self) -> DataFrame:
        """Every key with its status: added, deleted, updated or matched."""
        status = F.when(self._changed(), "updated").otherwise("matched")
        names = [*self._key_names, "o_rows", "n_rows"]
        both = self.keys(*self._payloads_for_cells(), every=True, common=True).select(*names, status.alias("status"))
        # A missing key is one added and one deleted entry, hence the small explode.
        sides = F.array_compact(
            F.array(F.when(F.col("is_added"), F.lit("added")), F.when(F.col("is_deleted"), F.lit("deleted")))
        )
        one = self.open_keys().where("not is_common").select(*names, F.explode(sides).alias("status"))
        equal = self.profile().where("equal").select(*names, F.lit("matched").alias("status"))
        return both.unionByName(one).unionByName(equal).select(
            *[F.col(k).alias(name) for k, name in zip(self._key_names, self.key)],
            "status",
            F.col("o_rows").alias("source_rows"),
            F.col("n_rows").alias("target_rows"),
        )

    def added_rows(self) -> DataFrame:
        return self._one_sided_rows(NEW, "is_added", "n_rows")

    def deleted_rows(self) -> DataFrame:
        return self._one_sided_rows(OLD, "is_deleted", "o_rows")

    def _one_sided_rows(self, side: str, flag: str, rows: str) -> DataFrame:
        """All occurrences of the keys that only one side has, with all its columns.

        The keys are found first, then their rows by membership. Stored keys with one row have it at
        hand already.
        """
        df, frame = (self.original, self._old) if side == OLD else (self.new, self._new)
        groups = self.open_keys().where(flag).select(*self._key_names, F.col(rows).alias("n"))
        if self._stored is None:
            return self._rows_of(side, groups).toDF(*df.columns)
        single = self._stored.where(F.col(flag) & (F.col(rows) == 1))
        single = single.select(*[F.col(f"{side}.{c}") for c in frame.columns])
        return single.unionAll(self._rows_of(side, groups.where("n > 1"))).toDF(*df.columns)

    def _rows_of(self, side: str, groups: DataFrame) -> DataFrame:
        """All rows of one side whose key is listed in ``groups``, a part of :meth:`open_keys`."""
        frame = self._old if side == OLD else self._new
        keys = self._old_keys if side == OLD else self._new_keys
        tagged, identity = add_identity(frame.select("*", *keys), self._key_names)
        listed, _ = add_identity(groups, self._key_names)
        # Only repeated keys can be large, and these are all open.
        repeated = self.open_keys().where("o_rows > 1 or n_rows > 1").select(*self._key_names, "n")
        large, _ = add_identity(repeated.orderBy(F.desc("n"), *self._key_names).limit(HEAVY_KEYS), self._key_names)
        asked = listed.select(*identity).withColumn("listed", F.lit(True))
        same = F.lit(True)
        for c in identity:
            same = same & large[c].eqNullSafe(asked[c])
        hot = None
        if self._repeated_keys:
            hot = large.join(asked, same, "left").select(
                *[large[c] for c in identity], F.col("listed").isNotNull().alias("listed")
            )
        return rows_in_groups(tagged, listed, identity, hot).select(*frame.columns)

    def updated_rows(self) -> DataFrame:
        """New-side rows with at least one changed cell."""
        row = [F.col(f"n.c{i}") for i in range(len(self.new.columns))]
        return (
            self.keys(self._payloads_for_cells()[0], common=True)
            .where(self._changed())
            .select(*row)
            .toDF(*self.new.columns)
        )

    def updated_details(self) -> DataFrame:
        """Key columns, the changes as a map, and the full new row as ``row_data``."""
        row = F.struct(
            *[F.col(f"n.c{i}").alias(c) for i, c in enumerate(self.new.columns)]
        )
        return (
            self.keys(self._payloads_for_cells()[0], common=True)
            .where(self._changed())
            .select(*self._key_output(), self._changes().alias("changes"), row.alias("row_data"))
        )

    def updated_pairs(self) -> DataFrame:
        """Key columns with both full rows, native types: ``old`` and ``new`` structs."""
        old = F.struct(*[F.col(f"o.c{i}").alias(c) for i, c in enumerate(self.original.columns)])
        new = F.struct(*[F.col(f"n.c{i}").alias(c) for i, c in enumerate(self.new.columns)])
        return (
            self.keys(common=True)
            .where(self._changed())
            .select(*self._key_output(), old.alias("old"), new.alias("new"))
        )

    def cell_changes(self) -> DataFrame:
        """One row per changed cell: key columns, column_name, old_value, new_value."""
        old, new = self._payloads_for_cells()
        key_positions = [f"c{self.new.columns.index(k)}" for k in self.key]
        changed = self.keys(old, list(dict.fromkeys(new + key_positions)), common=True).where(self._changed())
        names = [f"_k{i}" for i in range(len(self.key))]
        keys = [k.alias(name) for k, name in zip(self._key_output(), names)]
        cells = changed.select(*keys, F.explode(self._changes()).alias("_column", "_v"))
        return cells.select(*names, "_column", "_v.old", "_v.new").toDF(
            *self.key, "column_name", "old_value", "new_value"
        )

    def rendered_updates(self, missing: str = "") -> DataFrame:
        """New rows in which each changed cell reads ``old → new``; all columns as text."""
        cells = []
        for i, c in enumerate(self.new.columns):
            cell, dtype = F.col(f"n.c{i}"), self._new.schema[i].dataType
            text = as_text(cell, dtype)
            if c in self.compared:
                oc, ot = self._cell(OLD, c, "o.")
                change = rendered_change(as_text(oc, ot), text, missing)
                text = F.when(self._cell_differs(c), change).otherwise(text)
            cells.append(text)
        changed = self.keys(self._payloads_for_cells()[0], common=True).where(self._changed())
        return changed.select(*cells).toDF(*self.new.columns)

    def duplicate_rows(self, side: str) -> DataFrame:
        """All rows of one side whose key occurs more than once there."""
        df = self.original if side == OLD else self.new
        repeated = F.col("o_rows" if side == OLD else "n_rows")
        groups = self.open_keys().where(repeated > 1)
        groups = groups.select(*self._key_names, repeated.alias("n"))
        return self._rows_of(side, groups).toDF(*df.columns)

    def counts(self) -> DataFrame:
        """One row of counts, from one pass over both tables, the one that lists the keys that differ; this runs it.

        Only keys that repeat need their rows looked at, to compare the last ones.
        """

        def total(condition: Column, amount: Column) -> Column:
            return F.coalesce(F.sum(F.when(condition, amount)), F.lit(0)).cast("long")

        o, n, one = F.col("o_rows"), F.col("n_rows"), F.lit(1)
        looked_at = F.col("is_common") & ~F.col("single")
        row = self.open_keys().agg(
            total(F.col("is_added"), n).alias("added_rows_count"),
            total(F.col("is_deleted"), o).alias("deleted_rows_count"),
            total(F.col("single") & ~F.col("equal"), one).alias("updated_rows_count"),
            total(o > 1, o).alias("duplicate_rows_in_source_count"),
            total(n > 1, n).alias("duplicate_rows_in_target_count"),
            total(F.col("is_common"), one).alias("matched_keys"),
            total(o > 0, o).alias("source_rows"),
            total(n > 0, n).alias("target_rows"),
            total(looked_at, one).alias("open_keys"),
        ).first().asDict()
        for name in ("matched_keys", "source_rows", "target_rows"):
            row[name] += self._equal_keys
        if row.pop("open_keys"):
            keys = self._stored if self._stored is not None else self.keys(*self._payloads_for_cells(), common=True)
            uneven = (F.col("o_rows") > 1) | (F.col("n_rows") > 1)
            if self.nulls == "unequal":  # the digests decide on none of those with missing cells
                row["updated_rows_count"] = keys.where(self._changed()).count()
            else:
                row["updated_rows_count"] += keys.where(uneven & self._changed()).count()
        row["matched_keys"] -= row["updated_rows_count"]
        schema = T.StructType([T.StructField(k, T.LongType()) for k in row])
        return self.original.sparkSession.createDataFrame([tuple(row.values())], schema)
