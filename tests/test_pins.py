"""Small pins of the comparison's semantics."""

from __future__ import annotations

import pytest

import tallybridge as tb

KV = "k bigint, v string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def diff_of(spark, old, new, schema=KV, **options):
    return tb.compare(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), **options)


def test_copies_match_one_to_one(spark):
    diff = diff_of(spark, [("x",), ("x",), ("y",), ("z",)], [("x",), ("y",), ("y",), ("w",)], "c string")
    assert rows(diff.comparison.exact_matches()) == [("x",), ("y",)]
    assert rows(diff.deleted_rows()) == [("x",), ("z",)]
    assert rows(diff.added_rows()) == [("w",), ("y",)]
    assert diff.count_values["duplicate_rows_in_source_count"] == 2
    assert diff.count_values["duplicate_rows_in_target_count"] == 2


def test_last_of_a_repeated_key_counts(spark):
    schema = "i bigint, k bigint, v string"
    diff = diff_of(
        spark,
        [(0, 1, "a"), (1, 1, "b"), (2, 2, "c")],
        [(0, 1, "b"), (2, 2, "c"), (3, 2, "d")],
        schema,
        key="k",
        order_by="i",
    )
    changes = [r for r in rows(diff.cell_changes()) if r[1] == "v"]
    assert changes == [(2, "v", "c", "d")]
    assert [r[1] for r in rows(diff.duplicates_in_source())] == [1, 1]
    assert [r[1] for r in rows(diff.duplicates_in_target())] == [2, 2]


def test_missing_cells_with_key(spark):
    assert diff_of(spark, [(1, None)], [(1, None)], key="k").count_values["updated_rows_count"] == 0
    unequal = diff_of(spark, [(1, None)], [(1, None)], key="k", nulls="unequal")
    assert unequal.count_values["updated_rows_count"] == 1
    detail = unequal.updated_details().first()
    assert tuple(detail["changes"]["v"]) == (None, None)


def test_nan_is_missing(spark):
    schema = "k bigint, v double"
    assert diff_of(spark, [(1, float("nan"))], [(1, None)], schema, key="k").count_values["updated_rows_count"] == 0


def test_missing_equals_empty_without_key(spark):
    diff = diff_of(spark, [("a", None)], [("a", "")], "a string, b string")
    assert diff.comparison.exact_matches().count() == 1
    assert diff.change_score().first()[0] == 0


@pytest.mark.parametrize("match, expected", [(False, (1, 1)), (True, (0, 0))])
def test_missing_keys(spark, match, expected):
    diff = diff_of(spark, [(None, "a")], [(None, "a")], key="k", match_null_keys=match)
    counts = diff.count_values
    assert (counts["added_rows_count"], counts["deleted_rows_count"]) == expected
    assert (diff.added_rows().count(), diff.deleted_rows().count()) == expected
    statuses = sorted(r["status"] for r in diff.comparison.statuses().collect())
    assert statuses == (["matched"] if match else ["added", "deleted"])


def test_several_missing_keys_are_duplicates(spark):
    diff = diff_of(spark, [(None, "a"), (None, "b")], [(1, "c")], key="k")
    assert diff.duplicates_in_source().count() == 2
    assert rows(diff.deleted_rows()) == [(None, "a"), (None, "b")]


def test_no_common_key(spark):
    diff = diff_of(spark, [(1, "a")], [(2, "a")], key="k")
    assert diff.count_values["added_rows_count"] == diff.count_values["deleted_rows_count"] == 1
    assert diff.updated_rows().count() == 0


@pytest.mark.parametrize("key", ["k", None])
def test_empty_source(spark, key):
    diff = diff_of(spark, [], [(1, "a")], key=key)
    assert diff.count_values["added_rows_count"] == 1
    assert all(r["percentage"] is None for r in diff.reconciliation().collect())
    assert diff.outcome_share().count() == 4


@pytest.mark.parametrize("key", ["k", None])
def test_both_empty(spark, key):
    assert diff_of(spark, [], [], key=key).change_score().first()[0] == 0


def test_threshold_includes_two_of_seven(spark):
    schema = ", ".join(f"c{i} string" for i in range(7))
    old = [("a", "b", "c", "d", "e", "f", "g")]
    two = diff_of(spark, old, [("a", "b", "1", "2", "3", "4", "5")], schema)
    assert two.count_values["updated_rows_count"] == 1
    one = diff_of(spark, old, [("a", "0", "1", "2", "3", "4", "5")], schema)
    assert one.count_values["updated_rows_count"] == 0


def test_zero_threshold_matches_anything(spark):
    diff = diff_of(spark, [(1, "a"), (2, "b")], [(3, "c")], threshold=0)
    assert diff.count_values["updated_rows_count"] == 1
    assert diff.count_values["deleted_rows_count"] == 1


def test_names_differ_by_case(spark):
    old = spark.createDataFrame([(1, 2)], "k int, a int")
    new = spark.createDataFrame([(1, 2)], "k int, A int")
    diff = tb.compare(old, new, key="k")
    assert (diff.added_columns, diff.deleted_columns) == (["A"], ["a"])
    assert diff.count_values["updated_rows_count"] == 0


def test_awkward_column_names(spark):
    names = ["no.of.days", "Experience (Years)", "a`b"]
    old = spark.createDataFrame([(1, 2, 3)], "x int, y int, z int").toDF(*names)
    new = spark.createDataFrame([(1, 5, 3)], "x int, y int, z int").toDF(*names)
    diff = tb.compare(old, new, key="no.of.days")
    assert rows(diff.cell_changes()) == [(1, "Experience (Years)", "2", "5")]
    assert diff.updated_rows().columns == names
    assert tb.compare(old, new).count_values["updated_rows_count"] == 1


def test_types_in_key_mode(spark):
    old = spark.createDataFrame([(1, 1, "1")], "k int, a int, b string")
    new = spark.createDataFrame([(1, 1.0, 1)], "k bigint, a double, b int")
    assert rows(tb.compare(old, new, key="k").cell_changes()) == [(1, "b", "1", "1")]
    assert tb.compare(old, new, key="k", align_types=True).count_values["updated_rows_count"] == 0


def test_booleans_are_numbers(spark):
    old = spark.createDataFrame([(1, True, False)], "k int, a boolean, b boolean")
    new = spark.createDataFrame([(1, 1, 0.5)], "k int, a int, b double")
    assert [r[1] for r in rows(tb.compare(old, new, key="k").cell_changes())] == ["b"]


def test_text_and_number_keys_never_match(spark):
    old = spark.createDataFrame([("1", "a")], "k string, v string")
    new = spark.createDataFrame([(1, "a")], KV)
    counts = tb.compare(old, new, key="k").count_values
    assert (counts["added_rows_count"], counts["deleted_rows_count"]) == (1, 1)
    assert tb.compare(old, new, key="k", align_types=True).count_values["matched_keys"] == 1


def test_integers_and_floats_without_key(spark):
    old = spark.createDataFrame([(1, "a")], KV)
    new = spark.createDataFrame([(1.0, "a")], "k double, v string")
    assert tb.compare(old, new).comparison.exact_matches().count() == 0
    assert tb.compare(old, new, align_types=True).comparison.exact_matches().count() == 1


def test_nested_cells(spark):
    schema = "k int, tags array<string>, extra map<string,int>"
    old = [(1, ["a", "b"], {"x": 1}), (2, ["a"], {"y": 1})]
    new = [(1, ["a", "c"], {"x": 1}), (2, ["a"], {"y": 2})]
    diff = diff_of(spark, old, new, schema, key="k")
    assert [r[:2] for r in rows(diff.cell_changes())] == [(1, "tags"), (2, "extra")]
    assert diff_of(spark, old, new, schema).count_values["updated_rows_count"] == 2


def test_row_index_of_copies(spark):
    """The first copies match; the later ones are the rows that changed."""
    schema = "i bigint, a string, b string, c string"
    same = ("p", "q", "r")
    old = [(0, *same), (1, "p", "q", "old")]
    new = [(10, *same), (11, *same)]
    diff = diff_of(spark, old, new, schema, order_by="i")
    assert [(r["row_index"], r["column_name"], r["old_value"]) for r in diff.cell_changes().collect()] == [
        (11, "c", "old")
    ]


def test_discovered_key(spark):
    old = spark.createDataFrame([("a", 1, 7), ("a", 2, 7)], "x string, y int, z int")
    diff = tb.compare(old, old, discover=True)
    assert (diff.method, diff.key) == ("assumed_key", ["y"])
    none = tb.compare(old.drop("y"), old.drop("y"), discover=True)
    assert (none.method, none.key) == ("no_key", [])
    assert tb.unique_column(old.limit(0)) is None


def test_arguments(spark):
    df = spark.createDataFrame([(1, "a")], KV)
    for options in ({"key": "nope"}, {"nulls": "x"}, {"order_by": "v"}, {"order_by": ["k", "v"]}):
        with pytest.raises(ValueError):
            tb.compare(df, df, **options)
