"""What is known of a group, beside each of its rows, however large one group is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group with more than this share of the rows is looked up by broadcast: there are fewer than that many.
HEAVY_SHARE = 1024


def look_up(rows: DataFrame, groups: DataFrame, on: str, size: str, total: int) -> DataFrame:
    """``rows`` with the other columns of ``groups``, null where the group is not listed or ``on`` is null.

    ``groups`` has one row per value of ``on`` and says in ``size`` how many rows ask for it, ``total`` in all. Groups
    above ``total / HEAVY_SHARE`` are broadcast, fewer than ``HEAVY_SHARE`` rows; the others go by a shuffle in which
    none is larger. Rows that ask for nothing are not moved. Both tables should be written ones, as they are read more than once.
    """
    found = [c for c in groups.columns if c not in (on, size)]
    is_heavy = F.col(size) * HEAVY_SHARE > total
    heavy = F.broadcast(groups.where(is_heavy).select(on, *found, F.lit(True).alias("_heavy")))
    light = groups.where(~F.coalesce(is_heavy, F.lit(False))).select(on, *found)
    marked = rows.join(heavy, on, "left").select(*[rows[c] for c in rows.columns], *found, "_heavy")
    here = F.col("_heavy").isNotNull() | F.col(on).isNull()
    done = marked.where(here).drop("_heavy")
    rest = marked.where(~here).select(*rows.columns)
    return done.unionByName(rest.join(light, on, "left").select(*rows.columns, *found))
