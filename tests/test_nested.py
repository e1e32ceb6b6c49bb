"""Nested cells: counts, lazy and stored results agree on what changed."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import tallybridge as tb

#: (type, old, new, changed), as SQL texts.
CELLS = [
    ("array<int>", "array(1, null)", "array(null, 1)", True),
    ("array<int>", "array(1, 2)", "array(1, null, 2)", True),
    ("array<int>", "array(null)", "array()", True),
    ("array<int>", "null", "array()", True),
    ("array<int>", "array(1, null)", "array(1, null)", False),
    ("array<double>", "array(0.0d)", "array(-0.0d)", False),
    ("array<double>", "array(double('NaN'))", "array(double('NaN'))", False),
    ("struct<a:int,b:int>", "named_struct('a', 1, 'b', null)", "named_struct('a', null, 'b', 1)", True),
    ("struct<a:int,b:int>", "named_struct('a', null, 'b', null)", "null", True),
    ("struct<a:int,b:int>", "named_struct('a', 1, 'b', null)", "named_struct('a', 1, 'b', null)", False),
    ("array<array<string>>", "array(array('a'), array('b'))", "array(array('a', 'b'))", True),
    ("array<array<string>>", "array(array(), array('b'))", "array(array('b'), array())", True),
    ("array<array<string>>", "array(array('a'), null)", "array(array('a'), array())", True),
    ("array<array<string>>", "array(array('a', 'b'))", "array(array('a', 'b'))", False),
    ("array<string>", "array('ab', 'c')", "array('a', 'bc')", True),
    ("array<struct<a:array<int>>>", "array(named_struct('a', array(1)), named_struct('a', array(2)))",
     "array(named_struct('a', array(1, 2)), named_struct('a', array()))", True),
    ("map<string,array<int>>", "map('x', array(1), 'y', array(2))", "map('y', array(2), 'x', array(1))", False),
    ("map<string,array<int>>", "map('x', array(1), 'y', array(2))", "map('x', array(2), 'y', array(1))", True),
    ("map<string,int>", "map('x', null)", "map()", True),
]


def tables(spark, kind, old, new):
    def one(cell):
        rows = spark.sql(f"select 1 as k, cast({cell} as {kind}) as v union all select 2, cast({old} as {kind})")
        return rows.unionAll(spark.sql(f"select 3, cast({cell} as {kind}) union all select 3, cast({cell} as {kind})"))

    return one(old), one(new)


@pytest.mark.parametrize("kind,old,new,changed", CELLS)
def test_counts_lazy_and_stored_results_agree(spark, kind, old, new, changed):
    keys = [1, 3] if changed else []
    with tb.compare(*tables(spark, kind, old, new), key="k") as diff:
        assert diff.count_values["updated_rows_count"] == len(keys)
        assert sorted(r.k for r in diff.cell_changes().collect()) == keys
        assert sorted(r.k for r in diff.updated_rows().collect()) == keys
        status = {r.k: r.status for r in diff.comparison.statuses().collect()}
        assert status == {k: "updated" if k in keys else "matched" for k in (1, 2, 3)}
        diff.store()
        assert sorted(r.k for r in diff.cell_changes().collect()) == keys
        assert sorted(r.k for r in diff.updated_details().collect()) == keys
        assert diff.counts().first()["updated_rows_count"] == len(keys)


LITERALS = [
    "array(1, 2)",
    "array(array(1), array(2, 3))",
    "named_struct('a', 1, 'b', array('x'))",
    "array(named_struct('a', 1, 'b', 'x'))",
    "map('x', 1, 'y', 2)",
    "array(cast(1.5 as decimal(5,2)))",
]


@pytest.mark.parametrize("cell", LITERALS)
def test_a_literal_equals_itself_from_a_file(spark, tmp_path, cell):
    old = spark.sql(f"select 1 as k, {cell} as v")
    old.write.parquet(f"{tmp_path}/t")
    new = spark.read.parquet(f"{tmp_path}/t")
    assert old.schema["v"].dataType != new.schema["v"].dataType
    with tb.compare(old, new, key="k") as diff:
        assert diff.count_values["updated_rows_count"] == 0 and diff.cell_changes().count() == 0
    with tb.compare(old, new, key="v") as diff:
        assert diff.count_values["matched_keys"] == 1


def test_elements_compare_by_value(spark):
    old = spark.sql("select 1 as k, array(1, 2) as v, array(cast(1.50 as decimal(5,2))) as d, named_struct('a', 1) as s")
    new = spark.sql("select 1 as k, array(1.0d, 2.5d) as v, array(cast(1.5 as decimal(10,4))) as d, named_struct('b', 1) as s")
    with tb.compare(old, new, key="k") as diff:
        assert sorted(r.column_name for r in diff.cell_changes().collect()) == ["s", "v"]


def test_gated_write_sees_nested_changes(spark):
    spark.sql("create database if not exists nested_gate")
    try:
        spark.sql("select 1 as k, array(1, null) as v").write.mode("overwrite").saveAsTable("nested_gate.t")
        new = spark.sql("select 1 as k, array(cast(null as int), 1) as v")
        stored = tb.select(spark, "t", "nested_gate")
        with tb.write_if_changed(new, "t", stored, database="nested_gate", key="k") as result:
            assert result.written and result.diff.cell_changes().count() == 1
        assert tb.select(spark, "t", "nested_gate").first()["v"] == [None, 1]
    finally:
        spark.sql("drop database nested_gate cascade")


def test_hashes_of_many_shapes_differ(spark):
    from pyspark.sql import types as T

    from tallybridge.functions.cells import hashable

    inner = ["null", "array()", "array(null)", "array(1)", "array(1, null)", "array(null, 1)", "array(1, 1)", "array(null, null)"]
    outer = ["null", "array()", *[f"array({x})" for x in inner], *[f"array({x}, {y})" for x in inner for y in inner]]
    rows = spark.sql(" union all ".join(f"select cast({x} as array<array<int>>) as v" for x in outer))
    kind = T.ArrayType(T.ArrayType(T.IntegerType()))
    found = rows.select(F.xxhash64(hashable(F.col("v"), kind), F.col("v").isNull()).alias("h"))
    assert found.distinct().count() == len(outer)
