"""Write a table only if the comparison with what it replaces says so."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..sources import tables
from .compare import SUMMARY_COUNTS, Diff, compare

IF_CHANGED, ALWAYS, NEVER = "if_changed", "always", "never"
Policy = str | Callable[[dict[str, int]], bool]


@dataclass
class GateResult:
    """What was decided; ``diff`` still answers after the write, until ``close()``."""

    diff: Diff
    change_score: int
    written: bool

    def close(self) -> None:
        self.diff.close()

    def __enter__(self) -> GateResult:
        return self

    def __exit__(self, *error) -> None:
        self.close()


def write_if_changed(
    df: DataFrame,
    table: str,
    original: DataFrame,
    *,
    database: str | None = None,
    policy: Policy = IF_CHANGED,
    **compare_options,
) -> GateResult:
    """Compare ``df`` with ``original``, then replace the table as the policy decides.

    ``policy`` is ``if_changed``, ``always``, ``never``, or a function of the summary
    counts. ``original`` is usually the table itself, so the new one is written beside
    it and swapped in, and what the comparison found is kept first. Close the result to drop that.
    """
    diff = compare(original, df, **compare_options)
    counts = diff.count_values
    score = sum(counts[c] for c in SUMMARY_COUNTS)
    if callable(policy):
        wanted = bool(policy({c: counts[c] for c in SUMMARY_COUNTS}))
    elif policy in (IF_CHANGED, ALWAYS, NEVER):
        wanted = policy == ALWAYS or (policy == IF_CHANGED and score > 0)
    else:
        raise ValueError(f"unknown policy {policy!r}")
    if wanted:
        diff.detach()
        tables.replace_table(df, table, database)
    return GateResult(diff, score, wanted)
