"""Secret scans: base patterns, and character Markov models of random strings and identifiers.

Two first-order character models, one of random strings and one of ordinary identifiers, are trained by
counting character pairs in labelled samples. A run of characters as secrets are made of is a
secret if the sum of the log-likelihood ratios of its pairs exceeds ``MARGIN``, the log of the odds
against a run being one.

Everything on the main path is Spark's own functions: patterns are found by ``regexp_extract_all``, their places
follow from the lengths of what lies between them, and the table of ratios is a literal of
66 x 66 numbers, whatever the data. Only that table passes the driver, as bounded sums.

Kinds, in this order: ``assign`` (a value assigned to a telling name), ``access`` (access keys),
``hex`` (long runs of hexadecimal digits), ``random`` (found by the models). Places are code points, the end is
exclusive.

Defined results: a null text counts as empty and has no spans; repeated rows are scanned each; other columns stay, and give
way to an added column of the same name. Without a sample of either label nothing is added by the models.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import fresh_name
from .native import bound, running
from .samples import drawn

# The base patterns. Matches that fail the length are dropped, not retried.
ASSIGN = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
#: The longest runs first met are the runs themselves, so the length can stand in the pattern.
HEX = r"[0-9a-f]{24,}"
BASE = [("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24)]

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_-]{4,}"
#: The log of the odds against a run being a secret: one in about sixty thousand.
MARGIN = 11.0
#: About so many documents, chosen by a hash of their ids, give labelled samples.
SAMPLE_DOCUMENTS = 2_000
#: Added to every count of a pair.
SMOOTHING = 0.5


def _places(text: Column, pattern: str, group: int, least: int) -> Column:
    """``(start, end)`` of all matches whose group has the least length."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    sizes = F.transform(whole, F.length)
    # What lies before a match, and the match, move the end on; a list of ends is never grown one by one.
    steps = F.zip_with(F.transform(F.split(text, pattern, -1), F.length), sizes, lambda gap, size: gap + size)
    ends = running(F.filter(steps, lambda step: step.isNotNull()), lambda x, y: x + y)
    found = F.filter(
        F.arrays_zip(ends.alias("end"), sizes.alias("size"), F.transform(value, F.length).alias("value")),
        lambda x: x["value"] >= least,
    )
    places = F.transform(
        found, lambda x: F.struct((x["end"] - x["size"]).alias("start"), x["end"].alias("end"))
    )
    return F.when(text.rlike(pattern), places).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def samples_from(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Labelled samples ``(sample, random)`` from a bounded number of documents.

    Random are the values that the base patterns find, and digests of the ids in three
    alphabets; ordinary are the words of the texts without what the base patterns find.
    """
    given = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    some = drawn(given, "id", SAMPLE_DOCUMENTS).where("text is not null")
    digest = F.sha2(F.concat_ws(" ", F.col("id").cast("string"), "text"), 256)
    base64 = F.translate(F.base64(F.unhex(digest)), "\r\n=", "")
    random = F.concat(
        F.array(digest, base64, F.translate(base64, "+/", "-_"), F.substring(F.upper(base64), 1, 24)),
        F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)),
        F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)),
        F.regexp_extract_all("text", F.lit(HEX), F.lit(0)),
    )
    rest = F.col("text")
    for _, pattern, _, _ in BASE:
        rest = F.regexp_replace(rest, pattern, " ")
    ordinary = F.regexp_extract_all(rest, F.lit(IDENTIFIER), F.lit(0))

    def labelled(values: Column, label: bool) -> Column:
        return F.transform(
            values, lambda x: F.struct(x.alias("sample"), F.lit(label).alias("random"))
        )

    both = F.concat(labelled(random, True), labelled(ordinary, False))
    return some.select(F.explode(both).alias("s")).select("s.sample", "s.random")


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of character pairs, row by row of the alphabet; all 0 without samples."""
    n = len(ALPHABET)
    pairs = F.transform(
        F.sequence(F.lit(1), F.length("sample") - 1), lambda i: F.substring("sample", i, 2)
    )
    counts = (
        samples.where(F.length("sample") > 1)
        .select("random", F.explode(pairs).alias("pair"))
        .groupBy("random", "pair")
        .count()
        .select(
            "random",
            (F.instr(F.lit(ALPHABET), F.substring("pair", 1, 1)) - 1).alias("a"),
            (F.instr(F.lit(ALPHABET), F.substring("pair", 2, 1)) - 1).alias("b"),
            "count",
        )
        .where("a >= 0 and b >= 0")
        .collect()
    )  # at most 2 * 66 * 66 rows
    table = {True: [SMOOTHING] * (n * n), False: [SMOOTHING] * (n * n)}
    seen = {True: 0, False: 0}
    for row in counts:
        table[row.random][row.a * n + row.b] += row["count"]
        seen[row.random] += row["count"]
    if not all(seen.values()):
        return [0.0] * (n * n)
    ratios = []
    for a in range(n):
        row = slice(a * n, a * n + n)
        total = {k: sum(v[row]) for k, v in table.items()}
        for r, o in zip(table[True][row], table[False][row]):
            ratios.append(round(math.log(r / total[True]) - math.log(o / total[False]), 4))
    return ratios


def log_ratio(run: Column, ratios: list[float]) -> Column:
    """The log-likelihood ratio of a text of the alphabet, random against ordinary."""
    table = F.split(F.lit(" ".join(map(repr, ratios))), " ").cast("array<double>")
    n = len(ALPHABET)

    def summed(codes: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.size(codes) - 1),
            F.lit(0.0),
            lambda a, i: a + F.get(table, F.get(codes, i - 1) * n + F.get(codes, i)),
        )

    characters = F.filter(F.split(run, ""), lambda c: c != "")
    codes = F.transform(characters, lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return F.when(F.length(run) > 1, bound(codes, summed)).otherwise(F.lit(0.0))


def _random_places(text: Column, ratios: list[float]) -> Column:
    """Runs that the models take for random strings."""
    if not any(ratios):
        return F.array().cast("array<struct<start:int,end:int>>")
    runs = F.regexp_extract_all(text, F.lit(RUN), F.lit(0))
    scored = F.transform(
        F.arrays_zip(_places(text, RUN, 0, 0).alias("at"), runs.alias("run")),
        lambda x: F.struct(x["at"].alias("at"), log_ratio(x["run"], ratios).alias("ratio")),
    )
    found = F.transform(F.filter(scored, lambda x: x["ratio"] > MARGIN), lambda x: x["at"])
    return F.when(text.rlike(RUN), found).otherwise(
        F.array().cast("array<struct<start:int,end:int>>")
    )


def scan(
    docs: DataFrame,
    ratios: list[float],
    text: str = "text",
    spans: str = "spans",
    keep: list[str] | None = None,
) -> DataFrame:
    """An array of ``(start, kind, end)`` in order beside the columns; kinds by their place in the list."""
    kept = [c for c in (keep or docs.columns) if c.lower() != spans.lower()]
    whole = F.coalesce(docs[f"`{text}`"], F.lit(""))

    def of_kind(places: Column, kind: int) -> Column:
        return F.transform(
            places, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"))
        )

    places = [_places(whole, p, g, n) for _, p, g, n in BASE] + [_random_places(whole, ratios)]
    kinds = [of_kind(place, kind) for kind, place in enumerate(places)]
    return docs.select(
        *[docs[f"`{c}`"] for c in kept], F.sort_array(F.concat(*kinds)).alias(spans)
    )


KINDS = [kind for kind, *_ in BASE] + ["random"]


def rendered(spans: Column, kinds: list[str] = KINDS) -> Column:
    """``kind:start:end`` of the given kinds, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    wanted = F.filter(spans, lambda x: F.get(names, x["kind"]).isin(kinds))
    return F.array_join(
        F.transform(wanted, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])),
        ",",
    )


def redact(
    docs: DataFrame, ratios: list[float], text: str = "text", mask: str = "[SECRET]"
) -> DataFrame:
    """The same columns and rows, every stretch that spans cover replaced by one mask."""
    spans = fresh_name(docs, "secret_spans")
    found = scan(docs, ratios, text, spans)

    def covered(furthest: Column) -> Column:
        """Stretches that spans cover, merged: where a span begins behind all before it, up to where the next such one does."""
        firsts = F.filter(
            F.transform(F.col(spans), lambda x, i: F.struct(x["start"].alias("a"), i.alias("i"))),
            lambda x: (x["i"] == 0) | (x["a"] > F.get(furthest, x["i"] - 1)),
        )
        return bound(
            firsts,
            lambda f: F.transform(
                f,
                lambda x, k: F.struct(
                    x["a"].alias("a"),
                    F.get(furthest, F.coalesce(F.get(f, k + 1)["i"], F.size(furthest)) - 1).alias("b"),
                ),
            ),
        )

    def marks(stretches: Column, length: Column) -> Column:
        """For every character 0 if it stays, 1 if a mask takes its place, else 2."""

        def around(x: Column, k: Column) -> Column:
            before = F.coalesce(F.when(k > 0, F.get(stretches, k - 1)["b"]), F.lit(0))
            return F.concat(
                F.array_repeat(F.lit(0), x["a"] - before), F.array(F.lit(1)), F.array_repeat(F.lit(2), x["b"] - x["a"] - 1)
            )

        last = F.element_at(stretches, -1)["b"]
        return F.concat(F.flatten(F.transform(stretches, around)), F.array_repeat(F.lit(0), length - last))

    def masked(characters: Column) -> Column:
        furthest = running(F.transform(F.col(spans), lambda x: x["end"]), lambda x, y: F.greatest(x, y))
        stretches = bound(furthest, covered)
        flags = bound(stretches, lambda s: marks(s, F.size(characters)))
        kept = F.zip_with(
            characters, flags, lambda c, m: F.when(m == 0, c).when(m == 1, F.lit(mask)).otherwise(F.lit(""))
        )
        return F.array_join(kept, "")

    masked = bound(F.split(F.col(f"`{text}`"), ""), masked)
    new = F.when(F.size(spans) > 0, masked).otherwise(F.col(f"`{text}`"))
    return found.select(
        *[new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    )
