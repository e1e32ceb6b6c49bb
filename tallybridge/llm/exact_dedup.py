"""Exact duplicates by progressive refinement: length, then a hash of the beginning, then a hash of the whole text.

The first pass over the texts takes their length and a hash of their first ``PREFIX`` characters, both at hand without
looking at the rest, and counts the rows of each (length, beginning). A length that occurs once ends there, and so does a
beginning that no other text of its length shares. What survives goes into a bitmap of at most ``MOST_SLOTS`` bits, which
is broadcast (16 MB at most, whatever the input); a slot taken by two keys only means that a text is hashed needlessly.
The second pass hashes the whole of the surviving texts, by SHA-256, and writes id and hash, never the text. Groups are then
counted on those narrow rows, combined before the shuffle, and looked up without ever bringing a large group together.

Defined results: a null text equals the empty one; of equal texts the row with the largest id stays, null being the least
id, and of several such rows (the same row repeated) exactly one; other columns stay, and give way to an added column of the
same name; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybridge.operators.stored import Workspace

from .lookup import look_up

#: Characters that the second refinement looks at.
PREFIX = 256
#: Bits for each surviving key, and bits in all.
BITS_PER_KEY, MOST_SLOTS = 64, 1 << 27
ADDED = ["keep_id", "group_size", "kept"]


def _beginning(text: Column) -> Column:
    """The key of the first two refinements."""
    return F.xxhash64(F.octet_length(text), F.substring(text, 1, PREFIX))


def surviving(docs: DataFrame, text: str, workspace: Workspace) -> DataFrame:
    """``(length, beginning, n)``: the lengths and beginnings that more than one text has."""
    whole = F.coalesce(docs[f"`{text}`"], F.lit(""))
    keys = docs.select(F.octet_length(whole).alias("length"), _beginning(whole).alias("beginning"))
    return workspace.store(keys.groupBy("length", "beginning").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))


def _bitmap(keys: DataFrame) -> tuple[DataFrame, int]:
    """Bitmaps of 4,096 bytes by number, and how many slots they have in all."""
    slots = 1 << 15
    wanted = min(MOST_SLOTS, keys.count() * BITS_PER_KEY)
    while slots < wanted:
        slots *= 2
    slot = F.pmod("beginning", F.lit(slots)) + 1
    bits = keys.groupBy(F.bitmap_bucket_number(slot).alias("_bucket"))
    return bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("_bits")), slots


def exact_duplicates(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", keep: list[str] | None = None
) -> DataFrame:
    """Every row with ``keep_id`` (the id of the row that stays), ``group_size`` and ``kept``.

    ``keep`` names the columns to carry along, by default all but the text.
    """
    workspace = Workspace(docs.sparkSession)
    wanted = [c for c in docs.columns if c != text] if keep is None else keep
    kept = [c for c in wanted if c.lower() not in ADDED]
    names = [f"c{i}" for i in range(len(kept))]
    bitmaps, slots = _bitmap(surviving(docs, text, workspace))
    slot = F.pmod(F.col("_key"), F.lit(slots)) + 1
    place = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("_bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    whole = F.coalesce(docs[f"`{text}`"], F.lit(""))
    rows = docs.select(
        *[docs[f"`{c}`"].alias(n) for c, n in zip(kept, names)],
        docs[f"`{id_col}`"].alias("_id"),
        whole.alias("_text"),
        _beginning(whole).alias("_key"),
    ).withColumn("_bucket", F.bitmap_bucket_number(slot))
    rows = rows.join(F.broadcast(bitmaps), "_bucket", "left")
    survives = F.col("_bits").isNotNull() & (byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0)
    # The row's own number makes exactly one of several equal rows stay.
    narrow = workspace.store(
        rows.select(
            *names,
            "_id",
            F.monotonically_increasing_id().alias("_row"),
            F.when(survives, F.unhex(F.sha2("_text", 256))).alias("_hash"),
        )
    )
    sizes = narrow.where("_hash is not null").groupBy("_hash").agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.struct("_id", "_row")).alias("_keep")
    )
    groups = workspace.store(
        sizes.where("_n > 1").select("_hash", "_n", F.col("_n").alias("_size"), "_keep._id", "_keep._row")
        .toDF("_hash", "_n", "_size", "_keep_id", "_keep_row")
    )
    found = look_up(narrow, groups, "_hash", "_n", narrow.count())
    return found.select(
        *[F.col(n).alias(c) for c, n in zip(kept, names)],
        F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep_id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("_size").isNull() | (F.col("_row") == F.col("_keep_row"))).alias("kept"),
    )


def without_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents that stay, with their texts, which are written once to the shared folder."""
    return exact_duplicates(docs, text, id_col, keep=docs.columns).where("kept").select(
        *[f"`{c}`" for c in docs.columns if c.lower() not in ADDED]
    )
