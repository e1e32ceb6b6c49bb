"""Bounded samples of labelled rows, and folds by a hash of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RANGE = 1 << 32
#: So many labels at most are learned, the most frequent ones; documents of rarer ones are not sampled.
MOST_LABELS = 100


def fold(id_col: Column, modulus: int) -> Column:
    """The remainder of the CRC-32 of the id as text; null for a null id."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(modulus))


def drawn(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """About ``rows`` rows, chosen by a hash of the id, without a sort; the number is binomial around the bound."""
    n = df.count()
    share = min(1.0, rows / n) if n else 1.0
    return df.where(F.pmod(F.xxhash64(df[f"`{id_col}`"]), F.lit(_RANGE)) < share * _RANGE)


def sampled(df: DataFrame, label: str, id_col: str, per_label: int) -> tuple[DataFrame, dict]:
    """About ``per_label`` rows of each of the ``MOST_LABELS`` most frequent labels (of equally frequent ones the
    lesser), chosen by a hash of the id, and these labels' row counts.

    The number of rows is binomial around the bound, so it does not follow the input.
    """
    known = df.where(df[f"`{label}`"].isNotNull()).groupBy(df[f"`{label}`"].alias("label")).count()
    found = known.orderBy(F.desc("count"), "label").limit(MOST_LABELS).collect()
    counts = {r["label"]: r["count"] for r in found}
    if not counts:
        return df.limit(0), counts
    share = F.create_map(
        *[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_label / n) * _RANGE)]
    )
    draw = F.pmod(F.xxhash64(df[f"`{id_col}`"]), F.lit(_RANGE))
    return df.where(draw < F.element_at(share, df[f"`{label}`"])), counts
