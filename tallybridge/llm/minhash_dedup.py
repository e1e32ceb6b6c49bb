"""MinHash near-duplicates: circulant signatures, bands, exact Jaccard verification.

1. A text is the set of its five-word shingles as 64-bit hashes. Texts with equal sets are one class,
   represented by its least id; only representatives go on.
2. Two permutations make the signature: ``sigma`` shuffles the universe once, ``pi`` is shifted circularly by one for each
   coordinate, so coordinate k is the least ``pi(sigma(x) + k)``.
3. Coordinates are banded in rows of ``ROWS``, in as many bands as a pair at the threshold needs to be missed with a
   probability of at most ``MISSED``, a closer one less often: 32 at 0.85, 50 at 0.80. Members of a bucket are
   linked to its least id, so a bucket of n makes n - 1 candidate links.
4. Components of candidate links are groups. Inside a group *all* pairs are verified on full sets, so
   linking buckets as stars loses nothing. A large group is dealt into blocks, and each pair of blocks is a
   task of bounded size; texts whose sizes differ too much for the threshold never meet. A task gives a spanning forest of
   its links, not its pairs.
5. Components of the verified links are the result.

Defined results: a text without words (null, empty) has no shingles and links with nothing; rows that share an
id are one document; ties do not matter, as all is by sets and least ids; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybridge.operators.stored import Workspace

from .batches import add_columns
from .components import connected_components, join_listed, roots_of

SHINGLE = 5
#: Links need this many hundredths of intersection over union.
PERCENT = 85
BANDS, ROWS = 32, 6
#: A pair at the threshold may be missed this often.
MISSED = 3e-7
#: A block of a group holds about so many texts, and so many shingles, at most half as much again.
BLOCK_TEXTS, BLOCK_SHINGLES = 256, 1 << 18
REMEMBERED = 1 << 18

_MASK = (1 << 64) - 1


class _Words(dict):
    """Hashes of words, bounded."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = value
        return value


def shingles(text: str | None, words: dict, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    # bytes.lower() lowers A-Z only, and bytes.split() splits at the six ASCII white spaces
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    many = max(1, len(found) - size + 1)
    width = min(size, len(found))
    mixed = np.full(many, 0x9E3779B97F4A7C15 * width & _MASK, np.uint64)
    for k in range(width):
        mixed = (mixed ^ hashes[k : k + many]) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def _permuted(x: np.ndarray, keys: tuple[int, int]) -> np.ndarray:
    """A permutation of the 32-bit numbers; works in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(keys[0] | 1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(keys[1] | 1)
    x ^= x >> np.uint32(16)
    return x


SIGMA, PI = (0x7FEB352D, 0x846CA68B), (0x21F0AAAD, 0xD35A2D97)


def signature(values: np.ndarray, length: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash of a set of 64-bit hashes."""
    universe = (values ^ (values >> np.uint64(32))).astype(np.uint32)
    start = _permuted(universe, SIGMA)
    least = np.full(length, 0xFFFFFFFF, np.uint32)
    shifts = np.arange(length, dtype=np.uint32)
    for at in range(0, len(start), 512):
        shifted = start[at : at + 512, None] + shifts[None, :]
        np.minimum(least, _permuted(shifted, PI).min(axis=0), out=least)
    return least


def bands_for(percent: int) -> int:
    """The least number of bands that misses a pair at the threshold with a probability of at most ``MISSED``."""
    if percent >= 100:
        return 1
    return math.ceil(math.log(MISSED) / math.log1p(-((percent / 100) ** ROWS)))


def band_keys(values: np.ndarray, bands: int = BANDS) -> list[int]:
    """One signed 64-bit key per band."""
    rows = signature(values, bands * ROWS).reshape(bands, ROWS)
    return [
        xxhash.xxh3_64_intdigest(row.tobytes(), seed=i) - (1 << 63) for i, row in enumerate(rows)
    ]


def _verified(left: list, right: list | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside ``left``, or between ``left`` and ``right``, as row numbers of both in turn."""
    sets = left + (right or [])
    n, split = len(sets), len(left)
    sizes = np.array([len(s) for s in sets], np.int64)
    rows = np.repeat(np.arange(n), sizes)
    _, columns, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[columns] > 1
    rows, columns = rows[shared], columns[shared]
    _, columns = np.unique(columns, return_inverse=True)
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    common = np.zeros((split, n if right is None else n - split), np.float32)
    width = 4096
    for at in range(0, int(columns[-1]) + 1 if len(columns) else 0, width):
        a, b = np.searchsorted(columns, [at, at + width])
        part = np.zeros((n, width), np.float32)
        part[rows[a:b], columns[a:b] - at] = 1
        used = part[:, : int(columns[b - 1]) - at + 1] if b > a else part[:, :0]
        common += used[:split] @ (used if right is None else used[split:]).T
    both = common.astype(np.int64)
    others = sizes if right is None else sizes[split:]
    linked = 100 * both >= percent * (sizes[:split, None] + others[None, :] - both)
    if right is None:
        linked = np.triu(linked, 1)
    i, j = np.nonzero(linked)
    return i, j if right is None else j + split


def _links_of_unit(percent: int):
    """A spanning forest of a unit's verified links."""

    def run(table):
        import pyarrow as pa

        ids = table.column("id").to_numpy()
        sides = table.column("side").to_numpy()
        order = np.lexsort((ids, sides))
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        sets, ids, sides = [sets[i] for i in order], ids[order], sides[order]
        split = int((sides == 0).sum())
        if table.column("single")[0].as_py():
            i, j = _verified(sets, None, percent)
        elif 0 < split < len(sets):
            i, j = _verified(sets[:split], sets[split:], percent)
        else:
            i = j = np.zeros(0, np.int64)
        root = roots_of(len(sets), i, j)
        moved = np.flatnonzero(root != np.arange(len(sets)))
        return pa.table({"a": pa.array(ids[moved], pa.int64()), "b": pa.array(ids[root[moved]], pa.int64())})

    return run


def _profiles(docs: DataFrame, bands: int = BANDS) -> DataFrame:
    """``id, n_shingles, k1, k2, bands``: size, identity of the set, and band keys."""
    added = T.StructType(
        [
            T.StructField("n_shingles", T.LongType()),
            T.StructField("k1", T.LongType()),
            T.StructField("k2", T.LongType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
        ]
    )

    def start():
        words, last = _Words(), {}

        def profile(text: str | None) -> tuple:
            values = shingles(text, words)
            if not len(values):
                return 0, None, None, None
            raw = xxhash.xxh3_128_intdigest(values.tobytes())
            k1, k2 = (raw >> 64) - (1 << 63), (raw & _MASK) - (1 << 63)
            if last.get("key") != raw:  # copies often follow each other
                last.update(key=raw, bands=band_keys(values, bands))
            return len(values), k1, k2, last["bands"]

        return profile

    return add_columns(docs, ["text"], added, start, ["id"])


def _sets(docs: DataFrame) -> DataFrame:
    """A binary column of the sorted shingles in place of the text."""

    def start():
        words = _Words()
        return lambda text: (shingles(text, words).tobytes(),)

    added = T.StructType([T.StructField("shingles", T.BinaryType())])
    return add_columns(docs, ["text"], added, start, [c for c in docs.columns if c != "text"])


def near_duplicates(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", percent: int = PERCENT
) -> DataFrame:
    """``(id, n_shingles, component_id, kept)``, one row per row of ``docs``; the id keeps its name."""
    workspace = Workspace(docs.sparkSession)
    given = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")
    )
    profiles = workspace.store(_profiles(given, bands_for(percent)))
    filled = profiles.where("n_shingles > 0")
    classes = workspace.store(
        filled.groupBy("k1", "k2").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    )
    # -- candidate links: each bucket as a star around its least representative
    first = classes.select(F.col("class_id").alias("id")).distinct()
    buckets = filled.join(first, "id", "left_semi").select("id", F.explode("bands").alias("key")).distinct()
    stars = workspace.store(
        buckets.groupBy("key")
        .agg(F.min("id").alias("m"), F.max("id").alias("most"), F.count(F.lit(1)).alias("texts"))
        .where("m < most")
        .drop("most")
    )
    in_stars = stars.agg(F.sum("texts")).first()[0] or 0
    met = join_listed(buckets, stars, ["key"], "texts", in_stars, "id")
    candidates = met.where("id <> m").select(F.col("id").alias("a"), F.col("m").alias("b"))
    groups = connected_components(candidates, workspace)
    # -- verification: texts of a group meet in blocks, those of close sizes only
    width = math.log(100 / percent) * (1 + 1e-9)  # links are within one class or between neighbours
    sized = workspace.store(
        groups.join(filled.select("id", "n_shingles").distinct(), "id").withColumn(
            "size_class",
            F.floor(F.log(F.col("n_shingles").cast("double")) / width).cast("int"),
        )
    )
    cells = workspace.store(
        sized.groupBy("component", "size_class").agg(
            F.greatest(
                F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)
            ).alias("blocks"),
            F.count(F.lit(1)).alias("texts"),
        )
    )

    def beside(step: int, name: str) -> DataFrame:
        return cells.select(
            "component", (F.col("size_class") - step).alias("size_class"), F.col("blocks").alias(name)
        )

    place = ["component", "size_class"]
    dealt = (
        sized.join(cells, place)
        .join(beside(1, "above"), place, "left")
        .join(beside(-1, "below"), place, "left")
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        .withColumn("units", _units())
        .where(F.size("units") > 0)
        .select("id", "component", "units")
    )
    sets = _sets(dealt.join(given, "id"))
    met = sets.select("id", "component", "shingles", F.explode("units").alias("u")).select(
        "id", "component", "shingles", "u.*"
    )
    links = met.groupBy("component", "class", "i", "j", "across").applyInArrow(
        _links_of_unit(percent), "a long, b long"
    )
    found = connected_components(links, workspace).select(
        F.col("id").alias("class_id"), F.col("component").alias("linked")
    )
    # -- every row: classes find their component, rows their class
    told = classes.join(found, "class_id", "left").select(
        "k1", "k2", "copies", F.coalesce("linked", "class_id").alias("component")
    )
    rows = classes.agg(F.sum("copies")).first()[0] or 0
    linked = join_listed(filled.drop("bands"), told, ["k1", "k2"], "copies", rows, "id")
    alone = profiles.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component"))
    return linked.select("id", "n_shingles", "component").unionAll(alone).select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


def _units():
    """The pairs of blocks a text takes part in: of its own size class, the one above, the one below."""

    def unit(size_class, i, j, across, side, single):
        return F.struct(
            size_class.cast("int").alias("class"), i.cast("long").alias("i"), j.cast("long").alias("j"),
            F.lit(across).alias("across"), side.cast("int").alias("side"), single.alias("single"),
        )

    own_class, block, no = F.col("size_class"), F.col("block"), F.lit(False)

    def each(blocks: str, body):
        return F.transform(F.sequence(F.lit(0), F.col(blocks) - 1), body)

    own = each(
        "blocks",
        lambda j: unit(
            own_class, F.least(block, j), F.greatest(block, j), False, F.when(block <= j, 0).otherwise(1), block == j
        ),
    )
    above = each("above", lambda j: unit(own_class, block, j, True, F.lit(0), no))
    below = each("below", lambda j: unit(own_class - 1, j, block, True, F.lit(1), no))
    nothing = F.filter(own, lambda x: F.lit(False))
    return F.concat(
        F.when(F.col("texts") > 1, own).otherwise(nothing),
        F.coalesce(above, nothing),
        F.coalesce(below, nothing),
    )
