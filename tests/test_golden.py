"""A five-row table edited by hand, compared with and without its key."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import tallybridge as tb

ROWS = [
    (101, "Alice", 25, "New York"),
    (102, "Bob", 30, "Los Angeles"),
    (103, "Charlie", 35, "Chicago"),
    (104, "David", 40, "Houston"),
    (105, "Eve", 22, "Miami"),
]


@pytest.fixture(scope="module")
def tables(spark):
    original = spark.createDataFrame(ROWS, "ID bigint, Name string, Age bigint, City string")
    edited = original.withColumn("Age", F.when(F.col("Name") == "Bob", 32).otherwise(F.col("Age")))
    edited = edited.withColumn(
        "City", F.when(F.col("Name") == "David", "San Diego").otherwise(F.col("City"))
    )
    frank = spark.createDataFrame([(106, "Frank", 28, "Seattle")], original.schema)
    edited = edited.unionByName(frank, allowMissingColumns=True).where("ID <> 105")
    return original, edited.withColumnRenamed("City", "Location")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_with_key(tables):
    diff = tb.compare(*tables, key="ID")
    assert diff.method == "key"
    assert (diff.added_columns, diff.deleted_columns) == (["Location"], ["City"])
    assert rows(diff.added_rows()) == [(106, "Frank", 28, "Seattle")]
    assert rows(diff.deleted_rows()) == [(105, "Eve", 22, "Miami")]
    assert rows(diff.updated_rows()) == [(102, "Bob", 32, "Los Angeles")]
    assert rows(diff.cell_changes()) == [(102, "Age", "30", "32")]
    assert rows(diff.rendered_updates()) == [("102", "Bob", "30 → 32", "Los Angeles")]
    detail = diff.updated_details().first()
    assert detail["ID"] == 102 and detail["row_data"]["Location"] == "Los Angeles"
    assert {c: tuple(v) for c, v in detail["changes"].items()} == {"Age": ("30", "32")}
    assert diff.change_score().first()[0] == 5


def test_without_key(tables):
    diff = tb.compare(*tables)
    assert diff.method == "no_key"
    assert diff.comparison.common == ["Age", "ID", "Name"]
    assert rows(diff.added_rows()) == [("28", "106", "Frank")]
    assert rows(diff.deleted_rows()) == [("22", "105", "Eve")]
    assert rows(diff.updated_rows()) == [("32", "102", "Bob")]
    assert diff.comparison.similar_matches().first()["similarity"] == pytest.approx(2 / 3)
    assert [tuple(r)[1:] for r in diff.cell_changes().collect()] == [("Age", "30", "32")]
    assert diff.change_score().first()[0] == 5


@pytest.mark.parametrize("key", ["ID", None])
def test_report(tables, key):
    diff = tb.compare(*tables, key=key)
    report = {r["details"]: r for r in diff.reconciliation().collect()}
    assert report["Matched_rows_from_source_to_target"]["count"] == 3
    assert report["Matched_rows_from_source_to_target"]["percentage"] == "60.0000%"
    assert report["Total_rows_in_target"]["percentage"] == "100.0000%"
    less = {r["details"]: r for r in diff.reconciliation("less_added").collect()}
    assert less["Matched_rows_from_source_to_target"]["percentage"] == "40.0000%"
    bands = [r["severity"] for r in diff.severity().collect()]
    assert bands == ["high", "high", "high", "high", "total", "total"]
    shares = [r["share"] for r in diff.outcome_share().collect()]
    assert shares == pytest.approx([1 / 6, 1 / 6, 1 / 6, 3 / 6])


def test_stored_results_equal_direct_ones(tables):
    with tb.compare(*tables, key="ID").store() as stored:
        direct = tb.compare(*tables, key="ID")
        assert stored.count_values == direct.count_values
        for name, df in direct.tables().items():
            assert rows(stored.tables()[name]) == rows(df), name


def test_report_files(tables, spark, tmp_path):
    with tb.compare(*tables, key="ID") as diff:
        written = tb.write_report(diff, str(tmp_path / "report"), placeholder=True)
    assert len(written) == 8
    none = spark.read.parquet(written["duplicate_rows_in_source"]).first()["Message"]
    assert none == "There are no records in duplicate_rows_in_source"
    assert spark.read.parquet(written["mismatched_rows"]).first()["Age"] == "30 → 32"


def test_json_records(tables, spark, tmp_path):
    with tb.compare(*tables, key="ID") as diff:
        written = tb.write_json(diff, str(tmp_path / "json"))
    assert spark.read.json(written["summary"]).first()["added_rows_count"] == 1
    assert spark.read.json(written["added_columns"]).first()["column_name"] == "Location"
    assert spark.read.json(written["updated_rows"]).first()["Age"] == 32


def test_preview_and_widths(tables):
    diff = tb.compare(*tables, key="ID")
    shown = {r["category"]: r for r in diff.preview(rows=1).collect()}
    assert set(shown) == {"added", "deleted", "updated"}
    assert shown["added"]["remaining"] == 0
    widths = {(r["table"], r["column_name"]): r["width"] for r in diff.table_widths().collect()}
    assert widths["mismatched_rows", "Age"] == len("30 → 32") + 2
    assert widths["rows_only_in_target", "Location"] == len("Location") + 2
    assert ("duplicate_rows_in_source", "ID") not in widths


def test_gated_write(tables, spark):
    original, edited = tables
    database = tb.use_database(spark, "gate_check", "new")
    tb.write_table(original, "people", database)
    tb.declare_key(spark, "people", ["ID"], database)
    stored = tb.select(spark, "people", database)
    never = tb.write_if_changed(edited, "people", stored, database=database, policy="never", key="ID")
    assert (never.change_score, never.written) == (5, False)
    same = tb.write_if_changed(stored, "people", stored, database=database, key="ID")
    assert (same.change_score, same.written) == (0, False)
    picky = tb.write_if_changed(
        edited, "people", stored, database=database, key="ID",
        policy=lambda counts: counts["deleted_rows_count"] == 0,
    )
    assert not picky.written
    done = tb.write_if_changed(edited, "people", stored, database=database, key="ID")
    assert done.written
    assert rows(tb.select(spark, "people", database)) == rows(edited)
    assert tb.declared_key(spark, "people", database) == ["ID"]
    # What is written may be computed from the table it replaces.
    again = tb.select(spark, "people", database).where("ID <> 101")
    tb.write_if_changed(again, "people", tb.select(spark, "people", database), database=database, key="ID")
    assert tb.select(spark, "people", database).count() == 4
    spark.sql("DROP DATABASE gate_check CASCADE")
