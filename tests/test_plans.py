"""What plans and library code must not contain."""

from __future__ import annotations

import contextlib
import io
import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
import tallybridge as tb
from tallybridge.operators import groups

SF = "/root/testdata/sf0.001"
PACKAGE = Path(entry.__file__).parent / "tallybridge"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("name", [
    "keyed_summary", "keyed_added", "keyed_cell_changes", "keyed_composite", "null_keys_matched",
    "repeated_key_rows", "nokey_exact_matches", "nokey_unmatched_target", "duplicates_by_content",
    "uniqueness_profile", "reconciliation", "row_index",
])
def test_no_nested_loops(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_keyed_digests_take_one_exchange_and_no_sort(spark):
    text = plan(entry._orders_diff(spark, SF).comparison.profile())
    assert "Join" not in text and "Sort" not in text
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
    assert "SortAggregate" not in plan(entry.keyed_summary(spark, SF))


def test_exact_matching_takes_one_exchange_of_rows(spark):
    diff = entry._orders_nokey(spark, SF)
    text = plan(diff.comparison.contents())
    assert "Join" not in text
    assert len(re.findall(r"Exchange", text)) == 1
    assert "SortAggregate" not in text


def test_only_needed_columns_are_read(spark):
    diff = entry._orders_diff(spark, SF)
    reads = re.findall(r"ReadSchema: struct<([^>]*)", plan(diff.comparison.key_counts()))
    assert reads and all(re.findall(r"(\w+):", r) == ["o_orderkey"] for r in reads)


def test_rows_of_few_keys_are_not_shuffled(spark):
    text = plan(entry.keyed_added(spark, SF))
    assert "Exchange hashpartitioning" not in text
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


@pytest.mark.parametrize("name", ["keyed_updated", "keyed_cell_changes", "keyed_statuses", "keyed_updated_details"])
def test_changed_rows_take_no_sorted_aggregate(spark, name):
    assert "SortAggregate" not in plan(entry.queries()[name](spark, SF))


@pytest.mark.parametrize("name,inputs", [("keyed_added", 1), ("keyed_updated", 2), ("duplicates_by_key", 1)])
def test_long_key_lists_read_each_input_at_most_twice(spark, monkeypatch, name, inputs):
    expected = sorted(map(str, entry.queries()[name](spark, SF).collect()))
    monkeypatch.setattr(groups, "BROADCAST_KEYS", 0)
    result = entry.queries()[name](spark, SF)
    text = plan(result)
    # a table is told by its columns; lists of keys are read apart
    scans = [r for r in re.findall(r"ReadSchema: struct<([^>]*)", text) if "o_orderkey" in r]
    assert 0 < len(scans) <= 2 * 2 * inputs  # the changed version reads its table twice by itself
    assert sorted(map(str, result.collect())) == expected


@pytest.mark.parametrize("bound", [0, 2, 10**9])
def test_hot_keys_in_long_lists(spark, monkeypatch, bound):
    """A third of each side is one key; matched, repeated, added, deleted and missing keys beside it."""
    monkeypatch.setattr(groups, "BROADCAST_KEYS", bound)
    old = spark.range(3000).selectExpr("case when id % 3 = 0 then 7 when id = 10 then null else id * 10 end as k", "id % 5 as v")
    new = spark.range(3000).selectExpr(
        "case when id % 3 = 0 then 7 when id % 11 = 1 then id * 10 + 1 when id in (20, 25) then null else id * 10 end as k",
        "case when id % 3 = 0 then 9 when id % 7 = 1 then 8 else id % 5 end as v")
    # keys that are large and not asked for, and long lists of small ones
    with tb.compare(old, new, key="k") as diff:
        o, n = ([tuple(r) for r in df.collect()] for df in (old, new))
        last = [dict(sorted((r for r in side if r[0] is not None), key=lambda r: (r[0], r[1]))) for side in (o, n)]
        updated = sorted((k, last[1][k]) for k in set(last[0]) & set(last[1]) if last[0][k] != last[1][k])
        added = sorted((r for r in n if r[0] is None or r[0] not in last[0]), key=str)
        deleted = sorted((r for r in o if r[0] is None or r[0] not in last[1]), key=str)
        for _ in range(2):
            assert sorted(tuple(r) for r in diff.updated_rows().collect()) == updated
            assert sorted((tuple(r) for r in diff.added_rows().collect()), key=str) == added
            assert sorted((tuple(r) for r in diff.deleted_rows().collect()), key=str) == deleted
            assert diff.duplicates_in_source().count() == 1000
            diff.store()
        counts = diff.counts().first()
        assert counts["updated_rows_count"] == len(updated) and counts["added_rows_count"] == len(added)
        assert counts["source_rows"] == counts["target_rows"] == 3000


def test_profile_reads_one_column_per_branch(spark):
    reads = re.findall(r"ReadSchema: struct<([^>]*)", plan(entry.uniqueness_profile(spark, SF)))
    assert len(reads) == 6 and all(len(re.findall(r"(\w+):", r)) == 1 for r in reads)


def test_library_stays_on_the_cluster():
    """No rows to the driver, no row-wise Python, no local checkpoints."""
    banned = [r"\.toPandas\(", r"localCheckpoint", r"\.rdd\b", r"crossJoin", r"F\.udf", r"\bcollect_list\b",
              r"collect_set", r"\.toLocalIterator"]
    # Bounded collects: file paths, key column names. Operators of llm/ have a choice of style.
    allowed = {"files.py": 1, "jdbc.py": 1}
    for path in PACKAGE.rglob("*.py"):
        if path.parent.name == "llm":
            continue
        text = path.read_text()
        for pattern in banned:
            assert not re.search(pattern, text), (path.name, pattern)
        assert len(re.findall(r"\.collect\(\)", text)) == allowed.get(path.name, 0), path.name
