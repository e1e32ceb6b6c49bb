"""Hot keys are dealt over tasks without losing or repeating a row."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tallybridge.llm import components, minhash_dedup
from tallybridge.operators.stored import Workspace

from .conftest import documents
from .test_dedup import brute_components


def test_join_listed_equals_a_join(spark):
    rows = spark.range(30_000).select(
        "id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).alias("key"), (F.col("id") % 2).alias("other")
    )
    listed = rows.where("key <> 11").groupBy("key", "other").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("most"))
    got = components.join_listed(rows, listed, ["key", "other"], "n", 30_000, "id")
    expected = rows.join(listed.drop("n"), ["key", "other"])
    assert got.columns == expected.columns
    assert got.count() == expected.count() and not got.exceptAll(expected).take(1)


def test_a_hot_key_goes_to_many_tasks(spark):
    rows = spark.range(40_000).select("id", F.lit(1).alias("key"))
    listed = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("most"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = components.join_listed(rows, listed, ["key"], "n", 40_000, "id")
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) > 4 and max(r["count"] for r in sizes) < 20_000


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(components, "HEAVY", 10)
    pick = random.Random(3)
    links = [(0, i) for i in range(2, 900)] + [(5000, i) for i in range(800, 1500)]
    links += [(pick.randrange(6000, 9000), pick.randrange(6000, 9000)) for _ in range(900)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.id: r.component for r in components.connected_components(df, Workspace(spark)).collect()}
    links = [x for x in links if x[0] != x[1]]
    assert got == brute_components({x for link in links for x in link}, links)


def test_a_hot_text_and_null_ids(spark):
    rows = [(i, "same words in all of these rows " * 3) for i in range(3000)]
    rows += [(3000 + i, None if i % 2 else " ") for i in range(3000)]
    rows += [(None, "a text without an id and without a copy"), (None, "same words in all of these rows " * 3)]
    rows += [(9000, "one two three four five six seven"), (9001, "One two three four five six seven")]
    out = minhash_dedup.near_duplicates(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    same = [r for r in out if r.doc_id is not None and r.doc_id < 3000]
    assert {r.component_id for r in same} == {0} and sum(r.kept for r in same) == 1
    empty = [r for r in out if r.doc_id is not None and 3000 <= r.doc_id < 9000]
    assert len(empty) == 3000 and all(r.kept and r.n_shingles == 0 and r.component_id == r.doc_id for r in empty)
    assert [r.component_id for r in out if r.doc_id in (9000, 9001)] == [9000, 9000]
    assert sorted((r.component_id is None, r.kept) for r in out if r.doc_id is None) == [(False, False), (True, True)]
