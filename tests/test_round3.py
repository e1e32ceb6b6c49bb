"""Pins: swaps that keep the table, samples without a join, row numbers without a sort."""

from __future__ import annotations

import contextlib
import io
import re

import pytest

import tallybridge as tb
from tallybridge.operators import mutate as changes
from tallybridge.sources import tables


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture
def database(spark):
    spark.sql("create database if not exists round3")
    yield "round3"
    spark.sql("drop database round3 cascade")


def test_a_swap_keeps_the_table(spark, database):
    spark.sql("create table round3.t (k int comment 'the ''key''', v string, p int) using orc partitioned by (p) "
              "comment 'a \\\\ table' tblproperties ('owner.team' = 'x''y', 'z' = '1')")  # fmt: skip
    spark.sql("insert into round3.t values (1, 'a', 1), (2, 'b', 2)")
    tb.declare_key(spark, "t", ["k"], database)
    before = tables.definition(spark, "t", database)
    new = tb.select(spark, "t", database).where("k = 2").selectExpr("k", "'c' as v", "p", "true as extra")
    with tb.write_if_changed(new, "t", tb.select(spark, "t", database), database=database, key="k") as result:
        assert result.written
    assert tables.definition(spark, "t", database) == before
    assert (before.fmt.lower(), before.partitions, before.properties["owner.team"]) == ("orc", ["p"], "x'y")
    assert before.column_comments == {"k": "the 'key'"} and before.comment == "a \\ table"
    assert tb.declared_key(spark, "t", database) == ["k"]
    got = tb.select(spark, "t", database)
    assert sorted(got.columns) == ["extra", "k", "p", "v"] and got.select("k", "v", "p").collect() == [(2, "c", 2)]
    assert [r.table_name for r in tb.show_tables(spark, database).collect()] == ["t"]


def test_a_swap_without_the_columns_of_the_definition(spark, database):
    spark.range(5).selectExpr("id", "id % 2 as p", "id as b").write.partitionBy("p").bucketBy(2, "b").saveAsTable("round3.t")
    tb.declare_key(spark, "t", ["b"], database)
    tables.replace_table(spark.range(3), "t", database)
    assert tables.definition(spark, "t", database).partitions == []
    assert tb.declared_key(spark, "t", database) == [] and tb.select(spark, "t", database).count() == 3
    tables.replace_table(spark.range(4), "t", database, fmt="json")
    assert tables.definition(spark, "t", database).fmt.lower() == "json"


@pytest.mark.parametrize("count", [0, 1, 7, 500, 999, 1000, 2000])
def test_exact_samples_without_a_join(spark, monkeypatch, count):
    monkeypatch.setattr(changes, "BUCKET_SHIFT", 60)  # few buckets, so that the boundary one is large
    df = spark.range(1000).selectExpr("case when id > 0 then concat('r', id) end as r")
    marked = changes.sample_rows(df, "r", count, seed=3)
    assert "Join" not in plan(marked)
    picked = {r.r for r in marked.where("_picked").collect()}
    assert len(picked) == min(count, 1000)
    assert marked.count() == 1000 and marked.where("_picked is null").count() == 0
    other = changes.sample_rows(df.repartition(9), "r", count, seed=3).where("_picked").collect()
    assert {r.r for r in other} == picked


def test_mutation_has_no_join(spark):
    df = spark.range(100).selectExpr("id", "concat('n', id) as Name", "'x' as City")
    out = tb.mutate(df, {k: changes.PEOPLE_RULES[k] for k in ("Name", "City")}, row_id="id", fraction=0.1)
    assert "Join" not in plan(out)
    assert out.where("Name like 'Updated%'").count() == 10


def test_row_numbers_take_no_sort_of_rows(spark, tmp_path):
    spark.range(10_000).selectExpr("id", "repeat('x', 50) as t").repartition(7).sortWithinPartitions("id").write.parquet(f"{tmp_path}/d")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        numbered = tb.with_row_index(spark.read.parquet(f"{tmp_path}/d"))
        text = plan(numbered)
        # windows run over counts of blocks and files; rows are joined, not ordered by their running number
        assert not re.search(r"Sort \[[^\]]*_place", text)
        rows = numbered.select("id", "_row_idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r._row_idx for r in rows) == list(range(10_000))
    by_place = [r.id for r in sorted(rows, key=lambda r: r._row_idx)]
    assert sum(a > b for a, b in zip(by_place, by_place[1:])) == 6  # ascending inside each of seven files
