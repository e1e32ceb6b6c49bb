"""Queries on rows that larger tables hold: copies under other keys, wide derived rows, repeated keys."""

from __future__ import annotations

import contextlib
import io
import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
import tallybridge as tb
from tallybridge.operators import similar
from tallybridge.operators.keyed import KeyedComparison
from tallybridge.operators.similar import SimilarRows


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def folder(spark, tmp_path, **rows) -> str:
    """A folder of the tables the queries read, those not given without rows."""
    for name in entry.TABLES:
        df = rows.get(name, spark.createDataFrame([], "x int"))
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def test_changed_names_are_cells_too(spark, tmp_path):
    """Two customers of one content, one deleted, one added under a longer name: the name is what changed."""
    customers = spark.createDataFrame(
        [(7, "Jo", 1, 2.5, "A"), (50, "Jo", 1, 2.5, "A"), (11, "Al", 2, None, "B"), (12, "Bo", 2, 4.0, "B")], CUSTOMER
    )
    sf = folder(spark, tmp_path, customer=customers)
    cells = entry.nokey_cell_changes(spark, sf).collect()
    assert sorted(map(tuple, cells)) == [
        (11, "c_acctbal", None, -1000011.0), (10000007, "c_name", None, None)
    ]
    balances = entry.similar_matches(spark, sf).select("old_balance", "new_balance").collect()
    assert sorted(map(tuple, balances), key=str) == [(2.5, 2.5), (None, -1000011.0)]


def test_signatures_are_not_sent_to_the_driver(spark, tmp_path):
    customers = spark.range(300).selectExpr(
        "id as c_custkey", "concat('C', id) as c_name", "cast(id % 25 as int) as c_nationkey",
        "id * 1.5D as c_acctbal", "'A' as c_mktsegment",
    )
    found = entry.minhash_estimates(spark, folder(spark, tmp_path, customer=customers))
    assert "Broadcast" not in plan(found)
    assert found.count() == 294 and found.where("not within").count() == 0


def test_counts_with_repeated_keys_make_one_pass(spark, monkeypatch):
    old = spark.range(60).selectExpr("id % 40 as k", "id as v")
    new = spark.range(60).selectExpr("id % 40 + 3 as k", "id + id % 2 as v")
    passes = []
    profile = KeyedComparison.profile
    monkeypatch.setattr(KeyedComparison, "profile", lambda self: passes.append(1) or profile(self))
    with tb.compare(old, new, key="k", order_by=["v"]) as diff:
        counts = diff.counts().first()
    assert len(passes) == 1
    # 37 common keys, whose last rows differ: 20 repeat on the left (0-19), 20 on the right (3-22).
    assert (counts["added_rows_count"], counts["deleted_rows_count"]) == (3, 6)
    assert counts["updated_rows_count"] == 37 and counts["source_rows"] == counts["target_rows"] == 60
    assert counts["duplicate_rows_in_source_count"] == counts["duplicate_rows_in_target_count"] == 40


def _alike(spark, rows: int, side: str):
    """Rows that agree with many of the other side in two columns of few values, and seldom in more."""
    few = [f"cast(pmod(xxhash64(id, '{side}', {c}), {3 + c}) as string) as c{c}" for c in range(6)]
    own = [f"concat('{side}', id, '-', {c}) as d{c}" for c in range(4)]
    return spark.range(rows).selectExpr(*few, *own)


def test_bands_try_a_window_of_partners_at_once(spark, monkeypatch):
    turns = []
    choices = SimilarRows._choices
    monkeypatch.setattr(SimilarRows, "_choices", lambda self, *args: turns.append(1) or choices(self, *args))
    diff = tb.compare(_alike(spark, 150, "o"), _alike(spark, 150, "n"), matcher="lsh", threshold=0.3)
    pairs = diff.comparison.similar_matches().collect()
    assert all(r["similarity"] >= 0.3 for r in pairs)
    assert len(turns) <= 12


def test_matched_rows_are_taken_out_by_one_join_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(similar, "BROADCAST_KEYS", 0, raising=False)
    diff = tb.compare(_alike(spark, 40, "o"), _alike(spark, 40, "n"), threshold=0.3)
    matching = diff.comparison.similar
    assert len(matching._run[0]) > 1
    text = plan(matching._without_matched(matching.rows, matching._run[0]))
    assert "Broadcast" not in text and text.count("Join") == 1
    left = matching.unmatched().count()
    assert left == matching.old_count + matching.new_count - 2 * matching.pair_count


def most_joined_rows(df) -> int:
    """The most rows that any join made when ``df`` was collected."""

    def nodes(node):
        yield node
        kind = node.getClass().getSimpleName()
        inner = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("StageExec") else []
        children = node.children()
        for child in [*inner, *[children.apply(i) for i in range(children.size())]]:
            yield from nodes(child)

    made = [0]
    for node in nodes(df._jdf.queryExecution().executedPlan()):
        rows = node.metrics().get("numOutputRows")
        if "Join" in node.nodeName() and rows.isDefined():
            made.append(rows.get().value())
    return max(made)


def test_rows_left_that_share_one_frequent_cell_are_not_paired(spark, monkeypatch):
    """600 rows of each side agree in one cell of two values, two are needed: 180,000 pairs that nobody asked for."""
    parts = ["cast(id % 2 as string) as a", *[f"concat('{{side}}', id, '-', {c}) as c{c}" for c in range(4)]]
    old, new = (spark.range(600).selectExpr(*[p.format(side=side) for p in parts]) for side in "on")
    diff = tb.compare(old, new)
    stored = []
    store = diff.comparison.workspace.store

    def counted(df):
        kept = store(df)
        stored.append(kept.count())
        return kept

    monkeypatch.setattr(diff.comparison.workspace, "store", counted)
    facts = entry._matching_facts(diff)
    assert facts.collect() == [(600, 600, True, True, 0)]
    # A row is in ten nodes of two of five cells at most.
    assert max(stored) <= 12_000 and most_joined_rows(facts) <= 12_000


def test_acceptable_pairs_left_are_counted_as_by_brute_force(spark):
    rng = random.Random(3)
    old, new = ([tuple(str(rng.randrange(4)) for _ in range(5)) for _ in range(n)] for n in (60, 50))
    new += new[:3]
    frames = [spark.createDataFrame(rows, "a string, b string, c string, d string, e string") for rows in (old, new)]
    # At this threshold nothing but equal rows is matched.
    diff = tb.compare(*frames, threshold=1.0)
    left = [[tuple(r) for r in rows.collect()] for rows in (diff.deleted_rows(), diff.added_rows())]
    for need in (1, 2, 4, 5):
        expected = sum(sum(x == y for x, y in zip(o, n)) >= need for o in left[0] for n in left[1])
        assert entry._acceptable_left(diff, need).first()[0] == expected
    assert expected == 0


ZEROS = "values (0.0D, float(0), 1, true, 'a'), (double('-0.0'), float('-0.0'), 2, null, ''), " \
    "(double('NaN'), float('NaN'), 3, false, null), (null, null, 3, false, ''), (0.1D, float('0.1'), null, null, 'b') as t(d, f, i, b, s)"  # fmt: skip


def test_numbers_are_counted_as_they_are_and_compared_as_text(spark):
    old, new = spark.sql(f"select * from {ZEROS}"), spark.sql(f"select * from {ZEROS} where i > 1 or i is null")
    contents = tb.compare(old, new).comparison.contents()
    rows = {tuple(r)[:-2]: tuple(r)[-2:] for r in contents.collect()}
    assert rows == {
        ("true", "0.0", "0.0", "1", "a"): (1, 0), ("", "-0.0", "-0.0", "2", ""): (1, 1),
        ("false", "", "", "3", ""): (2, 2), ("", "0.1", "0.1", "", "b"): (1, 1),
    }
    # The texts are made above the exchange, of the rows that are asked for.
    orders = spark.range(10).selectExpr("id as k", "id * 1.5D as price", "timestamp_seconds(id) as at")
    below = plan(tb.compare(orders, orders.limit(5)).comparison.contents()).split("Exchange hashpartitioning", 1)[1]
    assert " as string) AS" not in below


def test_turns_of_bands_shuffle_no_signatures(spark, monkeypatch):
    """Rows of 64 values are joined by bands once a level; in its turns only ids, blocks and the rows that met travel."""
    wide = []
    without_matched = SimilarRows._without_matched

    def recorded(self, rows, pairs):
        wide.extend(pairs if "x0" in rows.columns else [])
        return without_matched(self, rows, pairs)

    monkeypatch.setattr(SimilarRows, "_without_matched", recorded)
    monkeypatch.setattr(similar, "BROADCAST_KEYS", 0)
    old, new = (_alike(spark, 150, side) for side in "on")
    matching = tb.compare(old, new, matcher="lsh", threshold=0.3).comparison.similar
    assert matching.pair_count > 0 and not wide
    left = matching.unmatched().count()
    assert left == matching.old_count + matching.new_count - 2 * matching.pair_count


def test_signatures_of_bands_are_those_of_the_cells(spark, monkeypatch):
    names = [f"c{i}" for i in range(32)]
    rows = [tuple(str(i * j % 7) for j in range(32)) for i in range(9)]
    old, new = (spark.createDataFrame(r, ", ".join(f"{c} string" for c in names)) for r in (rows, [("x", *r[1:]) for r in rows]))
    matching = tb.compare(old, new, matcher="lsh").comparison.similar
    values = F.array(*[F.col(f"x{i}") for i in range(64)])
    found = {r.rid: r.v for r in matching._hashed().select("rid", values.alias("v")).collect()}
    expected = matching.rows.select("rid", similar.minhash_signature(F.col("cells"), tagged=True).alias("v")).collect()
    assert len(found) == 18 and found == {r.rid: r.v for r in expected}


def test_cells_of_small_nodes_are_not_written(spark, monkeypatch):
    """Rows that differ in one cell meet by rare cells: their nodes list pairs at once, and no table of nodes is stored."""
    old = spark.range(80).selectExpr("concat('a', id) as a", "concat('b', id) as b", "id % 7 as c", "id % 3 as d", "0 as e")
    new = old.withColumn("c", F.col("c") + 1)
    diff = tb.compare(old, new)
    stored = []
    store = diff.comparison.workspace.store

    def recorded(df):
        stored.append(df.columns)
        return store(df)

    monkeypatch.setattr(diff.comparison.workspace, "store", recorded)
    pairs = diff.comparison.similar_matches().collect()
    assert len(pairs) == 80 and all(r["old"]["a"] == r["new"]["a"] for r in pairs)
    assert stored and not [columns for columns in stored if "live" in columns]
