"""Exact duplicates beside grouping by the text itself."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallybridge.llm import exact_dedup
from tallybridge.llm.lookup import look_up
from tallybridge.operators.stored import Workspace

from .conftest import documents


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    return {t: (max(ids, key=lambda i: (i is not None, i)), len(ids)) for t, ids in groups.items()}


def check(spark, rows, **options):
    df = documents(spark, rows, clash=True)
    got = exact_dedup.exact_duplicates(df, keep=["doc_id", "text", "kept"], **options)
    assert got.columns == ["doc_id", "text", "keep_id", "group_size", "kept"]
    found = got.collect()
    expected = brute([r[:2] for r in rows])
    assert sorted(map(str, ((r.doc_id, r.text) for r in found))) == sorted(map(str, (tuple(r[:2]) for r in rows)))
    stay = defaultdict(int)
    for r in found:
        assert (r.keep_id, r.group_size) == expected[r.text or ""]
        stay[r.text or ""] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(stay.values()) <= {1}


def test_odd_texts(spark):
    from .conftest import ODD_TEXTS

    texts = ODD_TEXTS + ODD_TEXTS[::-1] + ["x" * 70_000 + "y", "y" + "x" * 70_000]
    check(spark, [(i, t) for i, t in enumerate(texts)])


def test_same_length_and_beginning(spark):
    start = "b" * exact_dedup.PREFIX
    texts = [start + t for t in ("aa", "ab", "ab", "ba", "a", "a", "")] + ["c" * len(start) + "ab"]
    check(spark, [(i, t) for i, t in enumerate(texts)])


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "c"), (None, "c"), (2, "c"), (5, None), (4, "")]
    check(spark, rows)


def test_a_third_is_one_text(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 == 0 else str(rng.randrange(600))) for i in range(3_000)]
    check(spark, rows)


def test_full_bitmaps_only_hash_more(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_SLOTS", 1)
    monkeypatch.setattr(exact_dedup, "BITS_PER_KEY", 0)
    rng = random.Random(2)
    check(spark, [(i, str(rng.randrange(900))) for i in range(1_500)])


def test_only_survivors_are_hashed_whole(spark):
    df = documents(spark, [(1, "one"), (2, "three"), (3, "three"), (4, "thrxx")])
    keys = exact_dedup.surviving(df, "text", Workspace(spark))
    assert [(r.length, r.n) for r in keys.collect()] == [(5, 2)]


def test_empty_table_and_default_columns(spark, empty):
    got = exact_dedup.exact_duplicates(empty)
    assert got.count() == 0
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "keep_id", "group_size", "kept"]


def test_documents_that_stay(spark):
    df = documents(spark, [(1, "a"), (2, "a"), (3, None), (4, "")])
    kept = exact_dedup.without_copies(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(2, "a"), (4, "")]


@pytest.mark.parametrize("hot", [1, 500])
def test_look_up(spark, hot):
    rows = spark.range(2_000).select(
        "id", F.when(F.col("id") < hot, F.lit(None)).otherwise(F.col("id") % 1_300 * (F.col("id") % 4)).alias("g")
    )
    groups = rows.where("g is not null").groupBy("g").count().withColumn("twice", F.col("g") * 2).where("g % 3 = 0")
    got = look_up(rows, groups, "g", "count", 2_000)
    assert got.columns == ["id", "g", "twice"] and got.count() == 2_000
    wrong = got.where(~F.col("twice").eqNullSafe(F.when(F.col("g") % 3 == 0, F.col("g") * 2)))
    assert wrong.count() == 0
