"""Pins: complete matching, loading without loss, injective texts, results that last."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import tallybridge as tb
from tallybridge.functions.cells import canonical
from tallybridge.operators.keyless import _bounds_below


@pytest.mark.parametrize("width", [7, 11, 14])
def test_every_acceptable_partner_is_found(spark, width):
    pick = random.Random(width)
    need = -(-2 * width // 7)
    old, new = [], []
    for r in range(60):
        o, n = ([f"{side}{r}_{c}" for c in range(width)] for side in "on")
        for c in pick.sample(range(width), need):
            o[c] = n[c] = f"s{r}_{c}"
        old.append(o)
        new.append(n)
    names = [f"c{i}" for i in range(width)]
    with tb.compare(spark.createDataFrame(old, names), spark.createDataFrame(new, names)) as diff:
        counts = diff.count_values
    assert (counts["updated_rows_count"], counts["added_rows_count"]) == (60, 0)


def test_frequent_cells_leave_no_acceptable_pair(spark, monkeypatch):
    monkeypatch.setattr("tallybridge.operators.similar.PAIRS_PER_ROW", 1)
    pick = random.Random(8)
    rows = [[[pick.randrange(3) for _ in range(9)] + [f"{side}{i}", f"{side}{i}"] for i in range(150)] for side in "on"]
    names = [f"c{i}" for i in range(11)]
    old, new = (spark.createDataFrame([list(map(str, r)) for r in side], names) for side in rows)
    with tb.compare(old, new, threshold=6 / 11) as diff:
        pairs = diff.comparison.similar_matches().collect()
        left = [[tuple(r) for r in df.collect()] for df in (diff.deleted_rows(), diff.added_rows())]
    agree = [sum(a == b for a, b in zip(p.old, p.new)) for p in pairs]
    assert agree and min(agree) >= 6
    assert len({tuple(p.old) for p in pairs}) == len(pairs) == 150 - len(left[0]) == 150 - len(left[1])
    assert not any(sum(a == b for a, b in zip(x, y)) >= 6 for x in left[0] for y in left[1])
    best = max(sum(a == b for a, b in zip(x, y)) for x in rows[0] for y in rows[1])
    assert max(agree) == best


FILES = {
    "two_on_a_line.json": ('{"a":1}{"a":2}', None),
    "two_objects.json": ('{\n"a":1\n}\n{\n"a":2\n}', None),
    "two_arrays.json": ('[{"a":1}]\n[{"a":2}]', None),
    "broken.json": ('[{"a":1}', None),
    "mixed.json": ("[[1], 2]", None),
    "scalars.json": ("[1, 2.5, null]", [(1.0,), (2.5,), (None,)]),
    "texts.json": ('["p", "q"]', [("p",), ("q",)]),
    "lists.json": ('[["x", 1], ["y", 2, true]]', [("x", 1, None), ("y", 2, True)]),
    "records.json": ('[{"a":1},{"a":2}]', [(1,), (2,)]),
    "columns.json": ('{"a":[1,2],"b":["x"]}', [(1, "x"), (2, None)]),
    "surplus.csv": ("x,y\n1,2\n3,4,,99\n", None),
    "blank_surplus.csv": ("x,y\n1,2,\n", None),
    "short.csv": ("x,y\n1,2\n3\n", [(1, 2.0), (3, None)]),
    "quoted.csv": ('x,y\n1,"a,b"\n3,"c,"",d"\n', [(1, "a,b"), (3, 'c,",d')]),
}


def test_nothing_is_lost_on_load(spark, tmp_path):
    for name, (text, _) in FILES.items():
        (tmp_path / name).write_text(text)
    loaded = tb.load_files(spark, folder=str(tmp_path))
    status = {r.path.rsplit("/", 1)[1]: (r.status, r.name) for r in loaded.manifest().collect()}
    for name, (_, rows) in FILES.items():
        assert status[name][0] == ("failed" if rows is None else "loaded"), name
        if rows is not None:
            assert [tuple(r) for r in loaded.frames[status[name][1]].collect()] == rows


@pytest.fixture
def new_york(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_different_instants_have_different_texts(spark, new_york):
    at = "select 1 as k, timestamp_seconds({}) as t, {} as n"
    first, second = 1762061400, 1762065000  # 05:30 and 06:30 UTC on the day clocks go back
    old, new = (spark.sql(at.format(s, "1")) for s in (first, second))
    assert tb.compare(old, new, "k").count_values["updated_rows_count"] == 1
    with tb.compare(old, new, threshold=0.5) as diff:
        assert diff.count_values["updated_rows_count"] == 1
    with tb.compare(old.unionAll(new), old) as diff:
        assert diff.count_values["duplicate_rows_in_source_count"] == 0
    with tb.compare(old, old) as diff:
        assert diff.count_values["matched_keys"] == 1


@pytest.mark.parametrize("shape", ["struct({})", "array({})", "map('a', {})"])
def test_a_microsecond_inside_a_nested_cell_counts(spark, shape):
    text = "select 1 as k, 'x' as b, {} as v"
    old, new = (
        spark.sql(text.format(shape.format(f"timestamp '2024-05-06 07:08:09.00000{d}'"))) for d in (1, 2)
    )
    assert tb.compare(old, new, "k").count_values["updated_rows_count"] == 1
    with tb.compare(old, new, threshold=0.5) as diff:
        assert diff.count_values["updated_rows_count"] == 1


def test_the_order_of_map_entries_does_not_count(spark):
    old = spark.sql("select 1 as k, map('a', map(1, 'x', 2, 'y'), 'b', map(3, 'z')) as m")
    new = spark.sql("select 1 as k, map('b', map(3, 'z'), 'a', map(2, 'y', 1, 'x')) as m")
    assert tb.compare(old, new, "k").count_values["updated_rows_count"] == 0
    with tb.compare(old, new) as diff:
        assert diff.count_values["matched_keys"] == 1
    nothing = spark.sql("select cast(null as map<string,int>) as m").select(
        canonical(F.col("m"), spark.sql("select map('a', 1) as m").schema["m"].dataType).alias("t")
    )
    assert nothing.first().t == ""


def test_decimals_that_fit_no_common_type(spark):
    old = spark.sql("select 1 as k, cast('12345678901234567890123456789012345678' as decimal(38,0)) as v "
                    "union all select 2, cast(5 as decimal(38,0)) union all select 3, cast(null as decimal(38,0))")
    new = spark.sql("select 1 as k, cast('1.5' as decimal(38,10)) as v "
                    "union all select 2, cast(5 as decimal(38,10)) union all select 3, cast(null as decimal(38,10))")
    changes = tb.compare(old, new, "k").cell_changes().collect()
    assert [(r.k, r.column_name) for r in changes] == [(1, "v")]


def test_statuses_do_not_depend_on_store(spark):
    old = spark.range(50).selectExpr("id", "id % 7 as v")
    new = spark.range(3, 60).selectExpr("id", "case when id % 10 = 3 then -1 else id % 7 end as v")
    with tb.compare(old, new, "id") as diff:
        before = sorted(map(tuple, diff.comparison.statuses().collect()))
        diff.store()
        assert sorted(map(tuple, diff.comparison.statuses().collect())) == before


def test_order_by_is_obeyed_beside_maps(spark):
    rows = [(1, p, {"a": p}) for p in range(1, 5)]
    old = spark.createDataFrame(rows, "k int, p int, m map<string,int>")
    new = spark.createDataFrame([(1, 4, {"a": 4})], "k int, p int, m map<string,int>")
    for order in (old, old.orderBy(F.desc("p"))):
        assert tb.compare(order, new, "k", order_by="p").cell_changes().count() == 0


@pytest.mark.parametrize("key", ["v", "column_name", "old_value", "a.b"])
def test_any_name_may_be_a_key(spark, key):
    old, new = (spark.createDataFrame([(1, x)], "k int, x int").toDF(key, "x") for x in (1, 2))
    rows = tb.compare(old, new, key).cell_changes()
    assert rows.columns == [key, "column_name", "old_value", "new_value"]
    assert tuple(rows.first()) == (1, "x", "1", "2")


@pytest.mark.parametrize("key", ["k", None])
def test_a_gate_result_answers_after_the_write(spark, key):
    spark.sql("create database if not exists round2_gate")
    try:
        old = spark.createDataFrame([(i, f"a{i}", f"b{i}") for i in range(6)] + [(0, "a0", "b0")], "k int, a string, b string")
        old.write.mode("overwrite").saveAsTable("round2_gate.t")
        spark.range(1).write.mode("overwrite").saveAsTable("round2_gate.t__retired")
        original = tb.select(spark, "t", "round2_gate")
        new = original.where("k > 1").withColumn("b", F.when(F.col("k") == 3, "new").otherwise(F.col("b")))
        with tb.write_if_changed(new, "t", original, database="round2_gate", key=key) as result:
            assert result.written
            changes = result.diff.cell_changes().collect()
            assert [(r.column_name, r.new_value) for r in changes] == [("b", "new")]
            assert result.diff.deleted_rows().count() == 3
            assert result.diff.duplicates_in_source().count() == 2
            assert result.diff.summary().first().updated_rows_count == 1
            assert result.diff.reconciliation().count() == 6
        names = {r.table_name for r in tb.show_tables(spark, "round2_gate").collect()}
        assert names == {"t", "t__retired"} and spark.table("round2_gate.t").count() == 4
    finally:
        spark.sql("drop database round2_gate cascade")


def test_one_outlier_position(spark):
    rows = [("same", "x", i) for i in range(40)] + [("same", "x", 10**12)]
    old = spark.createDataFrame(rows, "a string, b string, p long")
    new = spark.createDataFrame([*rows, ("same", "x", 50)], "a string, b string, p long")
    with tb.compare(old, new.withColumn("b", F.when(F.col("p") >= 39, "y").otherwise(F.col("b"))), order_by="p") as diff:
        found = sorted(r.row_index for r in diff.cell_changes().collect())
    assert found == [39, 50] or len(found) == 2 and set(found) <= {39, 50, 10**12}
    bounds = [1, 5, 9, *range(100, 300, 2)]
    values = [0, 1, 4, 9, 100, 101, 163, 10**12]
    got = spark.createDataFrame([(v,) for v in values], "v long").select(_bounds_below(F.col("v"), bounds).alias("n"))
    assert [r.n for r in got.collect()] == [sum(b <= v for b in bounds) for v in values]
