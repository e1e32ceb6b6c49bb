"""Columns computed in Python, batch by batch, beside all columns a table has."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shipping import ship

#: Rows handed to Python at a time, so that only so many texts exist twice.
ROWS = 256


def fresh_name(df: DataFrame, wish: str) -> str:
    """A column name that the table does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The table without columns of these names, in any case."""
    gone = {n.lower() for n in names}
    return df.select([f"`{c}`" for c in df.columns if c.lower() not in gone])


def give_back() -> None:
    """Return to the system what finished work has left in this process's allocators."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def started(start: Callable[[], Callable[..., tuple]]) -> Callable[..., tuple]:
    """The function of a task's rows. A vocabulary that the worker has kept from other work, and this task does not open, goes."""
    bpe = sys.modules.get(f"{__package__}.bpe")
    before = bpe and bpe.opened.cache_info()
    function = start()
    if bpe and before.currsize and bpe.opened.cache_info() == before:
        bpe.opened.cache_clear()
        give_back()
    return function


def add_columns(
    df: DataFrame,
    sources: list[str],
    added: T.StructType,
    start: Callable[[], Callable[..., tuple]],
    keep: list[str] | None = None,
) -> DataFrame:
    """``added`` columns, computed row by row from the ``sources`` columns.

    ``start`` runs once per task and gives the function of one row's values. ``keep`` names the
    columns to carry along (all by default). A column that has the name of an added one gives way.
    """
    ship(df.sparkSession)
    wanted = df.columns if keep is None else keep
    gone = {f.name.lower() for f in added.fields}
    kept = [c for c in wanted if c.lower() not in gone]
    # Names of its own, as those given may hold dots.
    names = [f"c{i}" for i in range(len(kept))]
    both = df.select(
        *[df[f"`{c}`"].alias(n) for c, n in zip(kept, names)],
        *[df[f"`{c}`"].alias(f"__source_{i}") for i, c in enumerate(sources)],
    )
    schema = T.StructType(both.schema.fields[: len(kept)] + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in added.fields]
        function = started(start)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                values = [part.column(len(kept) + i).to_pylist() for i in range(len(sources))]
                rows = [function(*row) for row in zip(*values)]
                new = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(kept))] + new, names=schema.names
                )
        give_back()

    return both.mapInArrow(run, schema).toDF(*kept, *added.names)
