from __future__ import annotations

import zlib

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

# What every operator must take: null, empty and long texts, ties, repeated rows, special strings.
ODD_TEXTS = [
    None,
    "",
    " ",
    "\n\n\t ",
    "a",
    "The cat's hat, it's 12 o'clock!!  \n\n x",
    "élan 日本語 🙂 ﷺ",
    "one<|endoftext|>two  <|endoftext|>",
    "<|endoftext",
    "x" * 70_000,
    " " * 70_000 + "end",
    "word and 'll " * 9_000,
    "!" * 66_000 + "<|endoftext|>" + "\n" * 66_000,
    "same text", "same text",
]


def documents(spark, rows, clash=False):
    """Documents of (id, text[, lang]) rows; ``clash`` adds columns named like an operator's own."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCUMENTS)
    if clash:
        for name in ("score", "ids", "n_tokens", "kept", "component_id", "spans", "Host", "words"):
            df = df.selectExpr("*", f"'other' as {name}")
    return df


def remainder(doc_id: int, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus


@pytest.fixture(scope="session")
def odd(spark):
    return documents(spark, [*enumerate(ODD_TEXTS), (3, "\n\n\t ")], clash=True)


@pytest.fixture(scope="session")
def empty(spark):
    return documents(spark, [])
