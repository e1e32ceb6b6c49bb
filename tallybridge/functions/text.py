"""Small text expressions shared by reports and sinks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ARROW = " → "


def percent_text(ratio_percent: Column) -> Column:
    """A percentage as text with four decimals; NULL stays NULL."""
    return F.when(ratio_percent.isNotNull(), F.format_string("%.4f%%", ratio_percent))


def safe_table_name(name: str) -> str:
    """Each character that is neither alphanumeric nor an underscore becomes one."""
    return "".join(ch if ch.isalnum() or ch == "_" else "_" for ch in name)


def safe_table_name_expr(col: Column) -> Column:
    return F.regexp_replace(col, r"[^\p{L}\p{N}_]", "_")


def quote_identifier(name: str) -> str:
    """Back-tick one identifier; names holding back-ticks or control characters are refused."""
    if not name or "`" in name or re.search(r"[\x00-\x1f]", name):
        raise ValueError(f"not a usable identifier: {name!r}")
    return f"`{name}`"


def rendered_change(old: Column, new: Column, missing: str = "") -> Column:
    """``old → new`` as one text cell."""
    return F.concat(F.coalesce(old, F.lit(missing)), F.lit(ARROW), F.coalesce(new, F.lit(missing)))


def split_change(cell: Column) -> Column:
    """Old and new text of a rendered change, NULL unless there are exactly two parts."""
    parts = F.split(cell, ARROW)
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("old"), parts[1].alias("new")))
