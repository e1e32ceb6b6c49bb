"""Column profiles from one scan, and declared constraints as data."""

from __future__ import annotations

import contextlib
import io

import tallybridge as tb
from tallybridge.operators import columns
from tallybridge.sources import tables

KINDS = """
    select * from values
        (1, 'a', double('NaN'), 0.0d, array(1, null), map('k', 1), named_struct('x', array(array(1), array(2)))),
        (2, 'a', 1.0d, -0.0d, array(null, 1), map('k', 1), named_struct('x', array(array(1, 2)))),
        (2, '', null, 1.0d, array(1), map('k', 2), null),
        (null, null, 1.0d, null, array(), null, named_struct('x', cast(null as array<array<int>>)))
        as t(whole, text, missing, zero, list, map, nested)
"""


def plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def facts(df):
    return sorted(map(tuple, df.collect()))


def test_one_scan_counts_what_a_scan_a_column_counts(spark):
    df = spark.sql(KINDS)
    for many in (df, df.unionAll(df), df.limit(0)):
        assert facts(tb.profile_uniqueness(many, one_scan=True)) == facts(tb.profile_uniqueness(many, one_scan=False))
    lists = tb.profile_uniqueness(df, one_scan=True).where("column_name = 'list'").first()
    assert (lists.duplicate_count, lists.total_rows) == (0, 4)


def test_wide_csv_is_parsed_once(spark, tmp_path):
    wide = spark.range(500).selectExpr("id", *[f"id % {i + 2} as c{i}" for i in range(20)])
    tb.write_files(wide, f"{tmp_path}/wide", "csv")
    wide.write.parquet(f"{tmp_path}/columnar")
    read = spark.read.csv(f"{tmp_path}/wide", header=True)
    profile = tb.profile_uniqueness(read)
    assert plan(profile).count("Scan csv") == 2  # once in the tree and once in its list of details
    assert [r.duplicate_count for r in profile.orderBy("ordinal").collect()] == [0, *[500 - i - 2 for i in range(20)]]
    assert tb.unique_column(read) == "id"
    assert not columns._reads_rows(spark.read.parquet(f"{tmp_path}/columnar"))


def test_constraints_as_data(spark):
    spark.sql("drop database if exists constraint_check cascade")
    tb.use_database(spark, "constraint_check", "new")
    try:
        for name in ("t", "u", "bare"):
            tb.write_table(spark.sql("select 1 as `a,b`, 2 as `c's`, 3 as d"), name, "constraint_check")
        tb.declare_key(spark, "t", ["d", "a,b"], "constraint_check")
        tb.declare_unique(spark, "t", ["c's"], "constraint_check")
        tb.declare_unique(spark, "u", ["d"], "constraint_check")
        usage, constraints = tb.constraints(spark, "constraint_check")
        assert facts(usage.select("TABLE_NAME", "COLUMN_NAME", "ORDINAL_POSITION")) == [
            ("t", "a,b", 2), ("t", "c's", 1), ("t", "d", 1), ("u", "d", 1)]
        assert facts(tables.key_columns(usage, constraints)) == [("t", "a,b", 2), ("t", "d", 1)]
        assert tb.declared_key(spark, "t", "constraint_check") == ["d", "a,b"]
        assert tables.key_columns(usage, constraints, "u").count() == 0
    finally:
        spark.sql("drop database constraint_check cascade")


def test_constraints_of_one_name_in_two_tables(spark):
    usage = spark.createDataFrame([("n", "t", "a", 1), ("n", "u", "b", 1)], tables.KEY_COLUMN_USAGE)
    constraints = spark.createDataFrame([("n", "t", "PRIMARY KEY"), ("n", "u", "UNIQUE")], tables.TABLE_CONSTRAINTS)
    assert facts(tables.key_columns(usage, constraints)) == [("t", "a", 1)]
