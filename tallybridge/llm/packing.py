"""Packing: shallow length combinations solved by non-negative least squares.

1. Every document is encoded and closed with an end id, then cut into full windows and a tail.
2. The tails' lengths make a histogram with less than ``window`` bins.
3. All combinations of at most three lengths that fill a window exactly are columns of a
   0/1/2/3 matrix; repeat counts come from non-negative least squares against the histogram and are rounded
   down to what the histogram holds.
4. What is left is packed greedily, longest tails first: tails are laid end to end and cut at the
   window's edge, so that only the very last sequence is not full.

Only the histogram and the table of repeats reach the driver; both are bounded by the window and the
number of combinations, whatever the input. Tails find their place by arithmetic on their rank among tails of
equal length. Ranks are counted within slices of a length, so a length that a third of all documents
share is spread over ``SLICES`` tasks, and no sequence is ever gathered.

Defined results: a null or empty text is its end id alone; repeated rows are packed each; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallybridge.operators.stored import Workspace

from .batches import give_back
from .bpe import ID_BYTES, opened, resolved
from .shipping import ship

WINDOW = 1024
SLICES = 256
#: Projected coordinate steps over all combinations.
SWEEPS = 60

PIECE = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, slice int, ids binary"
RESULT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def combinations(window: int, step: int = 1, held: np.ndarray | None = None) -> np.ndarray:
    """Lengths in descending order that fill a window: single, pairs and triples, 0 where absent.

    With a ``step`` the longest of three is a multiple of it; given a histogram ``held``, all lengths occur in it.
    """
    pairs = [(a, window - a, 0) for a in range((window + 1) // 2, window)]
    triples = [
        (a, b, window - a - b)
        for a in range(step, window, step)
        for b in range(max(1, (window - a + 1) // 2), min(a, window - a - 1) + 1)
    ]
    combos = np.array(pairs + triples, np.int64).reshape(-1, 3)
    if held is None:
        return combos
    return combos[np.all((combos == 0) | (held[combos] > 0), axis=1)]


def solve_repeats(histogram: np.ndarray, combos: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Whole repeat counts: NNLS by projected coordinate descent, then rounded into the histogram.

    ``histogram[n]`` is the number of tails of length n. A column has at most three entries, so a
    step costs three additions; a sweep goes over the combinations from the scarcest length on.
    """
    left = histogram.astype(float)
    usable = np.flatnonzero(np.all((combos == 0) | (histogram[combos] > 0), axis=1))
    repeats = np.zeros(len(combos))
    columns = []
    for c in usable:
        lengths, times = np.unique(combos[c][combos[c] > 0], return_counts=True)
        columns.append((c, lengths.tolist(), times.tolist(), float((times**2).sum())))
    for _ in range(sweeps):
        moved = 0.0
        for c, lengths, times, norm in columns:
            step = sum(t * left[n] for n, t in zip(lengths, times)) / norm
            new = max(0.0, repeats[c] + step)
            change = new - repeats[c]
            if change:
                for n, t in zip(lengths, times):
                    left[n] -= t * change
                repeats[c] = new
                moved = max(moved, abs(change))
        if moved < 0.5:
            break
    whole, rest = np.zeros(len(combos), np.int64), histogram.astype(np.int64).copy()
    order = sorted(columns, key=lambda x: -repeats[x[0]])
    for down in (True, False):  # as solved, rounded down; then one more each, while it lasts
        for c, lengths, times, _ in order:
            want = int(repeats[c]) if down else int(np.ceil(repeats[c]) - int(repeats[c]))
            can = min(want, *(int(rest[n]) // t for n, t in zip(lengths, times)))
            whole[c] += can
            for n, t in zip(lengths, times):
                rest[n] -= t * can
    return whole


def plan(histogram: np.ndarray, combos: np.ndarray, window: int) -> list[tuple]:
    """Where the tails of each length go, as intervals of their rank.

    (length, first rank, last rank, sequence of the first, ranks per sequence, offset, step,
    residual): tails of a combination are ``per`` to a sequence, ``step`` ids apart; a residual one lies at
    ``offset + (rank - first) * length`` of the laid-out rest, whose sequences follow the others.
    """
    repeats = solve_repeats(histogram, combos)
    used, sequence, rows = np.zeros(len(histogram), np.int64), 0, []
    for c in np.flatnonzero(repeats):
        offset = 0
        lengths, times = np.unique(combos[c][combos[c] > 0], return_counts=True)
        for n, t in zip(lengths.tolist()[::-1], times.tolist()[::-1]):
            many = int(repeats[c]) * t
            rows.append((n, int(used[n]), int(used[n]) + many, sequence, t, offset, n, False))
            used[n] += many
            offset += n * t
        sequence += int(repeats[c])
    laid = 0
    for n in range(len(histogram) - 1, 0, -1):
        rest = int(histogram[n] - used[n])
        if rest > 0:
            rows.append((n, int(used[n]), int(used[n]) + rest, sequence, 1, laid, n, True))
            laid += rest * n
    return rows


PLACE = "length int, first long, last long, sequence long, per int, at long, step int, residual boolean"


def _cut(docs: DataFrame, tokenizer: str, window: int, end_id: int, slices: int) -> DataFrame:
    """Pieces of all documents; only tails carry their ids."""

    def cut(batches):
        import pyarrow as pa

        bpe = opened(resolved(tokenizer))
        end, width = end_id.to_bytes(ID_BYTES, "little"), window * ID_BYTES
        schema = pa.schema(
            [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()),
             ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("slice", pa.int32()),
             ("ids", pa.binary())]
        )
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = bpe.encode(text or "") + end
                    slice_ = zlib.crc32(str(doc).encode()) % slices
                    for start in range(0, len(ids), width):
                        piece = ids[start : start + width]
                        rows.append(
                            (doc, start // ID_BYTES, len(piece) // ID_BYTES, zlib.crc32(piece),
                             len(ids) // ID_BYTES, slice_, piece if len(piece) < width else None)
                        )
                columns = zip(*rows) if rows else [[]] * len(schema)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema
                )
        give_back()

    return docs.mapInArrow(cut, PIECE)


def _cut_rest(laid: DataFrame, window: int) -> DataFrame:
    """Residual tails, cut where a window of the laid-out rest ends."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def cut(batches):
        import pyarrow as pa

        names = RESULT
        for batch in batches:
            rows = []
            for doc, start, n, tokens, ids, sequence, at in zip(*(c.to_pylist() for c in batch.columns)):
                done = 0
                while done < n:
                    offset = (at + done) % window
                    take = min(n - done, window - offset)
                    part = ids[done * ID_BYTES : (done + take) * ID_BYTES]
                    rows.append(
                        (doc, start + done, take, zlib.crc32(part), tokens,
                         sequence + (at + done) // window, offset)
                    )
                    done += take
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names)

    return laid.mapInArrow(cut, schema)


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = WINDOW,
    end_id: int = 0,
    slices: int = SLICES,
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    spark: SparkSession = docs.sparkSession
    ship(spark)
    workspace = Workspace(spark)
    given = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")
    )
    pieces = _cut(given, tokenizer, window, end_id, slices)
    # One shuffle: a piece meets the pieces of its length and slice, and learns its rank there.
    group = Window.partitionBy("length", "slice")
    pieces = workspace.store(
        pieces.withColumn("in_slice", F.row_number().over(group.orderBy("doc_id", "start")) - 1)
    )
    counts = pieces.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("pieces"))
    before = Window.partitionBy("length").orderBy("slice")
    slots = workspace.store(
        counts.withColumn("before", F.sum("pieces").over(before) - F.col("pieces"))
    )  # at most window * slices rows
    totals = slots.groupBy("length").agg(F.sum("pieces").alias("pieces")).collect()
    histogram = np.zeros(window + 1, np.int64)
    for row in totals:
        histogram[row.length] = row.pieces
    full = int(histogram[window])
    histogram[window] = 0
    rows = plan(histogram, combinations(window, held=histogram), window)
    rows = [(n, a, b, full + s, per, at, step, rest) for n, a, b, s, per, at, step, rest in rows]
    rows.append((window, 0, full, 0, 1, 0, window, False))
    places = spark.createDataFrame(rows, PLACE)
    ranked = (
        pieces.join(F.broadcast(slots.select("length", "slice", "before")), ["length", "slice"])
        .withColumn("rank", F.col("before") + F.col("in_slice"))
        .drop("before", "in_slice")
    )
    placed = ranked.join(F.broadcast(places), "length").where("rank >= first and rank < last")
    turn = F.col("rank") - F.col("first")
    whole = placed.where("not residual").select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.expr("(rank - first) div per")).alias("sequence_id"),
        (F.col("at") + F.pmod(turn, F.col("per")) * F.col("step")).cast("long").alias("offset"),
    )
    rest = placed.where("residual").select(
        "doc_id", "start", "length", "doc_tokens", "ids", "sequence",
        (F.col("at") + turn * F.col("step")).alias("at"),
    )
    return whole.select(RESULT).unionAll(_cut_rest(rest, window).select(RESULT))
