"""Similarity matching against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import tallybridge as tb
from tallybridge.operators import similar
from tallybridge.operators.similar import columns_needed, minhash_signature


def table(rng, n, width, values):
    return [tuple(str(rng.randrange(values)) for _ in range(width)) for _ in range(n)]


def schema(width):
    return ", ".join(f"c{i:02d} string" for i in range(width))


def agree(a, b):
    return sum(x == y for x, y in zip(a, b))


def outcome(spark, old, new, width, **options):
    """Matched pairs and the rows left on either side."""
    diff = tb.compare(spark.createDataFrame(old, schema(width)), spark.createDataFrame(new, schema(width)), **options)
    pairs = [(tuple(r["old"]), tuple(r["new"])) for r in diff.comparison.matches().collect()]
    deleted = [tuple(r) for r in diff.deleted_rows().collect()]
    added = [tuple(r) for r in diff.added_rows().collect()]
    return pairs, deleted, added


@pytest.mark.parametrize("seed, width, values", [(1, 3, 3), (2, 4, 4), (3, 5, 6), (4, 4, 2)])
def test_no_acceptable_pair_is_left_and_better_ones_come_first(spark, seed, width, values):
    rng = random.Random(seed)
    old, new = table(rng, 40, width, values), table(rng, 35, width, values)
    pairs, deleted, added = outcome(spark, old, new, width)
    need = columns_needed(2 / 7, width)
    # Every row is used once.
    assert sorted([o for o, _ in pairs] + deleted) == sorted(old)
    assert sorted([n for _, n in pairs] + added) == sorted(new)
    assert all(agree(o, n) >= need for o, n in pairs)
    assert not [1 for o in deleted for n in added if agree(o, n) >= need]
    # Exact matches are as many as brute force finds.
    left, exact = list(old), 0
    for n in new:
        if n in left:
            left.remove(n)
            exact += 1
    assert sum(o == n for o, n in pairs) == exact
    # Most similar first: no two pairs' rows agree more with each other than both pairs do.
    for i, (o1, n1) in enumerate(pairs):
        for o2, n2 in pairs[i + 1 :]:
            for o, n in ((o1, n2), (o2, n1)):
                assert agree(o, n) <= max(agree(o1, n1), agree(o2, n2))
    # A row left over agrees with nobody's partner more than the partner does.
    for o, n in pairs:
        assert all(agree(d, n) <= agree(o, n) for d in deleted)
        assert all(agree(o, a) <= agree(o, n) for a in added)


def test_result_does_not_depend_on_row_order(spark, monkeypatch):
    rng = random.Random(5)
    old, new = table(rng, 60, 4, 5), table(rng, 60, 4, 5)
    first = outcome(spark, old, new, 4)
    monkeypatch.setattr(similar, "BLOCKS_PER_ARRAY", 2)
    rng.shuffle(old)
    rng.shuffle(new)
    assert [sorted(x) for x in outcome(spark, old, new, 4)] == [sorted(x) for x in first]


def test_one_block_holds_everything(spark):
    """Two columns agree in all rows, so a block is the whole table."""
    old = [("x", "y", f"o{i}") for i in range(3000)]
    new = [("x", "y", f"n{i}") for i in range(2500)]
    pairs, deleted, added = outcome(spark, old, new, 3)
    assert (len(pairs), len(deleted), len(added)) == (2500, 500, 0)


def test_many_copies_of_one_row(spark):
    old = [("x", "y", "z")] * 400 + [("p", "q", "r")]
    new = [("x", "y", "w")] * 300 + [("x", "y", "z")] * 50
    pairs, deleted, added = outcome(spark, old, new, 3)
    assert len(pairs) == 350 and sum(o == n for o, n in pairs) == 50
    assert sorted(deleted) == [("p", "q", "r")] + [("x", "y", "z")] * 50
    assert added == []


def test_bands_on_a_wide_table(spark):
    """12 columns, up to four changed cells: bands find nearly all partners, and every
    pair reaches the threshold."""
    rng = random.Random(9)
    old = [(f"id{i}", *row) for i, row in enumerate(table(rng, 300, 11, 50))]
    new = []
    for i, row in enumerate(old):
        cells = list(row)
        for c in rng.sample(range(1, 12), 1 + i % 4):
            cells[c] = f"new{i}"
        new.append(tuple(cells))
    pairs, deleted, added = outcome(spark, old, new, 12)
    need = columns_needed(2 / 7, 12)
    assert all(agree(o, n) >= need for o, n in pairs)
    assert sum(o[0] == n[0] for o, n in pairs) >= 285
    assert sorted([o for o, _ in pairs] + deleted) == sorted(old)


def test_matchers_by_name(spark):
    rows = [("a", "b", "c", "d")]
    changed = [("a", "b", "c", "x")]
    for matcher in ("subset", "lsh"):
        assert len(outcome(spark, rows, changed, 4, matcher=matcher)[0]) == 1
    with pytest.raises(ValueError):
        outcome(spark, rows, changed, 4, matcher="other")


def test_signatures_estimate_the_overlap(spark):
    df = spark.createDataFrame(
        [(["a", "b", "c", "d"], ["d", "c", "b", "a"], ["a", "b", "x", "y"])],
        "p array<string>, q array<string>, r array<string>",
    )
    same = lambda x, y: F.size(F.filter(F.zip_with(x, y, lambda a, b: a == b), lambda e: e))
    sig = [minhash_signature(F.col(c)) for c in "pqr"]
    tagged = [minhash_signature(F.col(c), tagged=True) for c in "pq"]
    row = df.select(same(sig[0], sig[1]), same(sig[0], sig[2]), same(*tagged), F.size(sig[0])).first()
    assert row[0] == row[3] == 64
    assert 10 <= row[1] <= 34  # overlap 2 of 6
    assert row[2] < 10


def similar_rows(spark, old, new, width):
    diff = tb.compare(spark.createDataFrame(old, schema(width)), spark.createDataFrame(new, schema(width)))
    return diff.comparison.similar


def test_first_level_shuffles_no_cells(spark):
    """One long is kept per cell, and the cells of the first level are ordered without a shuffle of rows."""
    rng = random.Random(11)
    rows = similar_rows(spark, table(rng, 200, 5, 30), table(rng, 180, 5, 30), 5)
    hashed = rows._hashed()
    assert hashed.columns == ["rid", "is_new", "place", *[f"x{i}" for i in range(5)]]
    stored = rows.workspace.store(hashed)
    rough = rows._roughly_live(stored)
    plan = rough._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    # No live cell is missed, and no row.
    exact = {r.rid: set(r.live) for r in rows._live(stored).collect()}
    found = {r.rid: (r.live, r.m) for r in rough.collect()}
    assert found.keys() == exact.keys()
    assert all(exact[i] <= set(live) and m == len(live) == len(set(live)) for i, (live, m) in found.items())


@pytest.mark.parametrize("name, value", [("BUCKETS", 8), ("MOST_COLUMNS", 0), ("BROADCAST_KEYS", 0)])
def test_limits_do_not_matter(spark, monkeypatch, name, value):
    """Hardly any buckets, none, and no short lists: still no acceptable pair is left, and better ones come first."""
    monkeypatch.setattr(similar, name, value)
    rng = random.Random(12)
    old, new = table(rng, 60, 4, 5), table(rng, 50, 4, 5)
    pairs, deleted, added = outcome(spark, old, new, 4)
    assert sorted([o for o, _ in pairs] + deleted) == sorted(old)
    assert sorted([n for _, n in pairs] + added) == sorted(new)
    assert not [1 for o in deleted for n in added if agree(o, n) >= columns_needed(2 / 7, 4)]
    for i, (o1, n1) in enumerate(pairs):
        for o2, n2 in pairs[i + 1 :]:
            for o, n in ((o1, n2), (o2, n1)):
                assert agree(o, n) <= max(agree(o1, n1), agree(o2, n2))
