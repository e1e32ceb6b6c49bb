"""Group primitives on tables of which one group is a large part."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallybridge.operators import groups
from tallybridge.operators.groups import ranked, repeat_rows, repeated_rows, rows_in_groups


@pytest.fixture(scope="module")
def hot(spark):
    """5,000 rows; a third share one value, one value is missing in 500."""
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 10 == 1, None).otherwise(F.col("id"))
    return spark.range(5000).select("id", key.alias("k"))


def test_ranked_equals_row_number(spark, hot):
    rows = hot.where("k is not null").withColumn("slice", (F.col("id") / 50).cast("int"))
    got = {tuple(r) for r in ranked(rows, ["k"], "slice", [F.col("id")], "n").select("id", "n").collect()}
    plain = rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("id")))
    assert got == {tuple(r) for r in plain.select("id", "n").collect()}


@pytest.mark.parametrize("heavy, broadcast", [(1, 0), (3, 0), (10_000, 0), (1, 10_000)])
def test_repeated_rows_whatever_is_heavy(spark, monkeypatch, heavy, broadcast):
    monkeypatch.setattr(groups, "HEAVY_KEYS", heavy)
    monkeypatch.setattr(groups, "BROADCAST_KEYS", broadcast)
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 10 == 1, None).otherwise(F.col("id") % 900)
    hot = spark.range(5000).select("id", key.alias("k"))
    got = sorted(r["id"] for r in repeated_rows(hot, ["k"]).collect())
    plain = hot.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("k"))).where("n > 1")
    assert got == sorted(r["id"] for r in plain.collect())


def test_rows_in_no_group(hot):
    none = hot.select("k").withColumn("n", F.lit(1)).where("false")
    assert rows_in_groups(hot, none, ["k"]).count() == 0


def test_repeated_rows_by_text(spark):
    df = spark.createDataFrame(
        [("ab", "c", 1), ("a", "bc", 2), ("ab", "c", 3), (None, "", 4), ("", None, 5), (None, "", 6)],
        "x string, y string, i int",
    )
    assert sorted(r["i"] for r in repeated_rows(df, ["x", "y"]).collect()) == [1, 3, 4, 6]


def test_repeat_rows_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(groups, "COPIES_IN_PLACE", 10)
    df = spark.createDataFrame([("a", 3), ("b", 95), ("c", 0), ("d", 10), ("e", 11)], "v string, n bigint")
    copies = repeat_rows(df, "n", "copy", start=F.lit(5).cast("long")).groupBy("v").agg(
        F.count(F.lit(1)), F.count_distinct("copy"), F.min("copy"), F.max("copy")
    )
    assert sorted(tuple(r) for r in copies.collect()) == [
        ("a", 3, 3, 5, 7), ("b", 95, 95, 5, 99), ("d", 10, 10, 5, 14), ("e", 11, 11, 5, 15)
    ]


def test_zeros_of_either_sign_are_one_group(spark):
    df = spark.createDataFrame([("a", 0.0, 1), ("a", -0.0, 2), ("b", 0.0, 3)], "x string, y double, i int")
    assert sorted(r["i"] for r in repeated_rows(df, ["x", "y"]).collect()) == [1, 2]
