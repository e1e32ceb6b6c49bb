"""Quality rules, line first: lines are judged and removed, then documents that lost too much.

A line goes if it holds no word, is navigation (many separators for its words), boilerplate (a fixed phrase),
mostly signs instead of text, stutters, or is a copy of an earlier line. A document goes if it fails the base rules (fewer than
``LEAST_WORDS`` words; more than ``MOST_REPEATED`` percent of its words in 8-word windows that occur
twice), or if less than ``LEAST_LEFT`` percent of the characters in its words are left.

Everything is evaluated inside the row by Spark's own functions: no shuffle, no Python. Windows are
compared by a 64-bit hash first; only rows where two hashes agree compare the windows themselves, so that the
counts are exact.

Defined results: a null or empty text has no words and fails; repeated rows are judged each; other columns stay, and give
way to an added column of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import fresh_name
from .native import WHITE, WORD, bound, count_of

SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•·¦>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
LEAST_LEFT = 50
#: A line is navigation with this many separators, if they are also this share of its words.
NAVIGATION, NAVIGATION_SHARE = 3, 0.3
#: A line is signs instead of text if they are more than this share of the characters in its words.
SIGN_SHARE = 0.25
#: A line stutters if more than this share of its words equal the word before.
STUTTER_SHARE = 0.4
# Fixed phrases of boilerplate lines, in lower case.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service",
    "accept cookies", "we use cookies", "enable javascript", "lorem ipsum", "click here to",
    "sign up for", "subscribe to our", "share this page", "back to top", "skip to content",
)


def words_of(text: Column) -> Column:
    """The words of a text, by splitting it, which costs less than finding them."""
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def _shifted(name: str, value: Column, bits: Column) -> Column:
    """``shiftleft`` or ``shiftright`` by a number of bits that is a column."""
    return F.call_function(name, value, bits)


def _window_hashes(words: Column, window: int) -> Column:
    """A hash of every window, by doubling: two words, four, …, and at last two overlapping stretches."""

    def widened(hashes: Column, by: int) -> Column:
        """Where the list ends the second stretch is missing; those places are cut off in the end."""
        following = F.slice(hashes, F.lit(by + 1), F.greatest(F.lit(0), F.size(hashes) - by))
        return F.zip_with(hashes, following, lambda a, b: F.xxhash64(a, b))

    hashes, length = F.transform(words, lambda w: F.xxhash64(w)), 1
    while length < window:
        by = min(length, window - length)
        hashes = bound(hashes, lambda h, by=by: widened(h, by))
        length += by
    return F.slice(hashes, F.lit(1), F.greatest(F.lit(0), F.size(words) - window + 1))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words in windows that occur twice or more, each counted once."""

    def twins(sorted_: Column, value) -> Column:
        """Those of a sorted list whose value occurs twice."""
        return F.filter(
            sorted_,
            lambda x, k: (
                ((k > 0) & (value(F.get(sorted_, k - 1)) == value(x)))
                | F.coalesce(value(F.get(sorted_, k + 1)) == value(x), F.lit(False))
            ),
        )

    def covered(same: Column) -> Column:
        places = F.sort_array(F.transform(same, lambda x: x["at"]))
        first = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("words"))
        return F.aggregate(
            places,
            first,
            lambda a, at: F.struct(
                at.alias("last"),
                (a["words"] + F.least(F.lit(window), at - a["last"])).alias("words"),
            ),
            lambda a: a["words"],
        )

    def exact(words: Column, hashes: Column) -> Column:
        """The windows themselves are compared only where their hashes agree."""

        def candidates(bits: Column) -> Column:
            # The place takes as many low bits of the hash as it needs, so that plain numbers are sorted.
            low = _shifted("shiftleft", F.lit(1).cast("long"), bits) - 1
            high = F.bitwise_not(low)

            def twins_among(sorted_: Column) -> Column:
                """The places of neighbours with one hash: both of them, as the bits of a pair say."""
                pairs = F.zip_with(
                    sorted_, F.slice(sorted_, 2, F.greatest(F.lit(0), F.size(sorted_) - 1)),
                    lambda a, b: F.when(a.bitwiseXOR(b).bitwiseAND(high) == 0, F.array(a, b)),
                )
                return F.array_distinct(F.flatten(F.array_compact(pairs)))

            packed = F.transform(hashes, lambda h, i: h.bitwiseAND(high).bitwiseOR(i.cast("long")))
            return F.transform(bound(F.sort_array(packed), twins_among), lambda v: v.bitwiseAND(low).cast("int"))

        places = bound(F.length(F.bin(F.size(hashes))), candidates)
        windows = F.transform(
            places,
            # word by word, as a slice walks through the whole list each time
            lambda at: F.struct(F.concat_ws(" ", *[F.get(words, at + i) for i in range(window)]).alias("w"), at.alias("at")),
        )
        return covered(bound(F.sort_array(windows), lambda x: twins(x, lambda v: v["w"])))

    def count(words: Column) -> Column:
        return bound(
            _window_hashes(words, window),
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact(words, h)),
        )

    return bound(words, count)


def _any_phrase(lowered: Column) -> Column:
    found = F.lit(False)
    for phrase in BOILERPLATE:
        found = found | lowered.contains(phrase)
    return found


def _same_as_before(words: Column) -> Column:
    """How many words equal the word before."""
    return F.size(F.filter(words, lambda x, k: (k > 0) & (F.get(words, k - 1) == x)))


def passing_lines(lines: Column, may: dict[str, Column]) -> Column:
    """The lines that pass. ``may`` says of the whole text whether it has what a rule looks for (``signs``, ``bars``,
    ``phrase``, ``stutter``); lines are asked about nothing that the text does not have."""

    def fails(line: Column, has: Column) -> Column:
        signs = count_of(line, SYMBOLS) > SIGN_SHARE * F.length(F.translate(line, WHITE, ""))

        def navigation(bars: Column) -> Column:
            return (bars >= NAVIGATION) & (bars >= NAVIGATION_SHARE * F.size(words_of(line)))

        return (
            (has["signs"] & signs)
            | (has["phrase"] & _any_phrase(F.lower(line)))
            | (has["bars"] & bound(count_of(line, SEPARATORS), navigation))
            | (has["stutter"] & bound(words_of(line), lambda w: _same_as_before(w) > STUTTER_SHARE * F.size(w)))
        )

    flags = F.struct(*[flag.alias(name) for name, flag in may.items()])
    return bound(flags, lambda has: F.filter(lines, lambda line: ~fails(line, has)))


def clean(
    docs: DataFrame, text: str = "text", cleaned: str = "cleaned", keep: list[str] | None = None
) -> DataFrame:
    """Counts, the text without its failed lines, and the verdict, beside the columns of ``docs``.

    Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``, the column
    named by ``cleaned``, and ``kept``.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
             cleaned, "kept"]
    source = fresh_name(docs, "whole_text")
    kept = [c for c in (keep or docs.columns) if c.lower() not in {a.lower() for a in added}]
    whole = F.coalesce(docs[f"`{text}`"], F.lit(""))
    df = docs.select(*[docs[f"`{c}`"] for c in kept], whole.alias(source))
    lines, first, counts, passing, special = (
        fresh_name(docs, n) for n in ("all_lines", "first_lines", "word_counts", "passing_lines", "special")
    )
    df = df.withColumns(
        {
            lines: F.filter(F.split(F.col(source), "\n"), lambda x: x.rlike(WORD)),
            special: count_of(F.col(source), "".join(dict.fromkeys(SYMBOLS + SEPARATORS))) > 0,
            counts: bound(
                words_of(F.col(source)),
                lambda words: F.struct(
                    F.size(words).cast("long").alias("words"),
                    F.length(F.array_join(words, "")).cast("long").alias("characters"),
                    repeated_words(words).cast("long").alias("repeated"),
                    (_same_as_before(words) > 0).alias("stutter"),
                ),
            ),
        }
    )
    symbols = count_of(F.col(source), SYMBOLS).cast("long")
    df = df.withColumns(
        {
            first: F.array_distinct(lines),
            "n_symbols": F.when(F.col(special), symbols).otherwise(0).cast("long"),
        }
    )
    may = {
        "signs": F.col("n_symbols") > 0,
        "bars": F.col(special),
        "phrase": bound(F.lower(source), _any_phrase),
        "stutter": F.col(f"{counts}.stutter"),
    }
    df = df.withColumn(passing, passing_lines(F.col(first), may))
    whole = F.size(passing) == F.size(lines)
    df = df.select(
        *[df[f"`{c}`"] for c in kept],
        F.col(f"{counts}.words").alias("n_words"),
        F.col(f"{counts}.characters").alias("word_chars"),
        "n_symbols",
        (F.size(lines) - F.size(first)).cast("long").alias("n_dup_lines"),
        F.col(f"{counts}.repeated").alias("n_repeat_words"),
        F.array_join(passing, "\n").alias(cleaned),
        whole.alias(lines),
    )
    # What was removed is looked for only where a line was.
    left = F.when(F.col(lines), F.col("word_chars")).otherwise(F.length(F.translate(cleaned, WHITE, "")))
    base_failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )
    df = df.withColumn("base_failed", base_failed).withColumn(
        "kept", ~F.col("base_failed") & (100 * left >= LEAST_LEFT * F.col("word_chars"))
    )
    return df.select(*[f"`{c}`" for c in kept], *added)
