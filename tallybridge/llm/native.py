"""Small column helpers for operators that use Spark's own functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space, which separates words.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def count_of(text: Column, characters: str) -> Column:
    """How many characters of a text are among the given ones."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running sums (or greatest values, …) of a list of ints: each value is combined with the one before, then with the
    one two places before, then four, …; so many passes as the list's length has binary digits."""

    def passed(v: Column, digit: Column) -> Column:
        reach = F.call_function("shiftleft", F.lit(1), digit)
        nothing = F.array_repeat(F.lit(None).cast("int"), reach)
        before = F.concat(nothing, F.slice(v, F.lit(1), F.size(v) - reach))
        wider = F.zip_with(v, before, lambda x, y: F.when(y.isNull(), x).otherwise(combine(x, y)))
        return F.when(F.size(v) > reach, wider).otherwise(v)

    return F.aggregate(F.sequence(F.lit(0), F.lit(30)), values, passed)
