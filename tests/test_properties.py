"""Laws of the comparison on generated tables."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import tallybridge as tb

COMMON = dict(
    max_examples=4, deadline=None, derandomize=True,
    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow],
)
cell = st.one_of(st.none(), st.sampled_from(["a", "b", "", "NaN"]))
keyed = st.dictionaries(st.integers(0, 20), st.tuples(cell, cell), max_size=15)
bag = st.lists(st.tuples(cell, cell, cell), max_size=15)


def keyed_frame(spark, rows):
    return spark.createDataFrame([(k, *v) for k, v in rows.items()], "k bigint, x string, y string")


def bag_frame(spark, rows):
    return spark.createDataFrame(rows, "x string, y string, z string")


@settings(**COMMON)
@given(old=keyed, new=keyed)
def test_keyed_laws(spark, old, new):
    a, b = keyed_frame(spark, old), keyed_frame(spark, new)
    forth, back = tb.compare(a, b, key="k").count_values, tb.compare(b, a, key="k").count_values
    assert forth["added_rows_count"] == back["deleted_rows_count"] == len(new.keys() - old.keys())
    assert forth["deleted_rows_count"] == back["added_rows_count"] == len(old.keys() - new.keys())
    changed = sum(old[k] != new[k] for k in old.keys() & new.keys())
    assert forth["updated_rows_count"] == back["updated_rows_count"] == changed
    assert len(new) == len(old) - forth["deleted_rows_count"] + forth["added_rows_count"]
    same = tb.compare(a, a, key="k").change_score().first()[0]
    assert same == 0


@settings(**COMMON)
@given(old=bag, new=bag)
def test_keyless_laws(spark, old, new):
    a, b = bag_frame(spark, old), bag_frame(spark, new)
    diff = tb.compare(a, b)
    counts = diff.count_values
    matched = len(old) - counts["deleted_rows_count"]
    assert matched == len(new) - counts["added_rows_count"]
    assert diff.comparison.matches().count() == matched
    assert diff.added_rows().count() == counts["added_rows_count"]
    assert diff.deleted_rows().count() == counts["deleted_rows_count"]


@settings(**COMMON)
@given(rows=bag)
def test_a_table_matches_itself(spark, rows):
    df = bag_frame(spark, rows)
    counts = tb.compare(df, df).count_values
    assert counts["added_rows_count"] == counts["deleted_rows_count"] == counts["updated_rows_count"] == 0
    texts = [tuple("" if c is None else c for c in r) for r in rows]
    repeated = sum(texts.count(t) > 1 for t in texts)
    assert counts["duplicate_rows_in_source_count"] == repeated


def test_mutations_are_found_again(spark):
    people = spark.range(2000).select(
        "id",
        *[F.concat(F.lit(c), F.col("id")).alias(c) for c in ("Name", "Email", "Telephone")],
        *[F.lit("Rome").alias("City"), F.lit("Italy").alias("Country"), F.lit("F").alias("Gender")],
        F.lit("2000-01-01").alias("Date Of Birth"),
    )
    from tallybridge.operators.mutate import PEOPLE_RULES

    mutated = tb.mutate(people, PEOPLE_RULES, row_id="id", seed=3)
    again = tb.mutate(people.repartition(7, "Name"), PEOPLE_RULES, row_id="id", seed=3)
    assert sorted(map(tuple, mutated.collect())) == sorted(map(tuple, again.collect()))
    changes = tb.compare(people, mutated, key="id").cell_changes()
    per_row = {r["id"]: r["n"] for r in changes.groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert set(per_row.values()) <= {1, 2}
    # A pick may draw the value already there; the text rules always change the cell.
    texts = changes.where("column_name in ('Name', 'Email', 'Telephone')")
    rows_with_text_rule = texts.select("id").distinct().count()
    assert 60 <= rows_with_text_rule <= len(per_row) <= 100
    for r in texts.collect():
        expected = {"Name": f"Updated_{r['id']}", "Email": f"updated{r['id']}@example.com"}
        value = r["new_value"]
        assert value == expected.get(r["column_name"], value)
        if r["column_name"] == "Telephone":
            assert value.startswith("9876") and 100000 <= int(value[4:]) <= 999999


def test_exact_sample_size(spark):
    from tallybridge.operators.mutate import sample_rows

    df = spark.range(1000)
    for count in (0, 1, 50, 999, 1000, 2000):
        picked = sample_rows(df, "id", count, seed=1).where("_picked")
        assert (picked.count(), picked.select("id").distinct().count()) == (min(count, 1000),) * 2
