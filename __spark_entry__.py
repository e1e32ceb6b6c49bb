"""

Every query compares whole tables. The changed version of a table is derived from the
table itself by one SQL text that Spark and DuckDB both run; the modulo rules in it
decide which rows are changed, they do not thin out the data.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import tallybridge as tb  # noqa: E402
from tallybridge.functions.cells import canonical, digest, similarity  # noqa: E402
from tallybridge.functions.text import safe_table_name_expr, split_change  # noqa: E402
from tallybridge.operators.groups import repeated_rows  # noqa: E402
from tallybridge.operators.similar import columns_needed, minhash_signature  # noqa: E402
from tallybridge.operators.stored import shared_folder  # noqa: E402
from tallybridge.sources import tables  # noqa: E402
from tallybridge.sources.files import list_files  # noqa: E402

# The operators for training text may be absent as a whole, together with their pipeline.
try:
    from tallybridge.llm import queries as llm  # noqa: E402
except ModuleNotFoundError as error:
    if not (error.name or "").startswith("tallybridge.llm"):
        raise
    llm = None
try:
    import corpus_pipeline  # noqa: E402
except ModuleNotFoundError as error:
    if error.name != "corpus_pipeline" and not (error.name or "").startswith("tallybridge.llm"):
        raise
    corpus_pipeline = None

# -- changed versions of the tables, valid in both engines ----------------------------

ORDERS_T = """
    select o_orderkey, o_custkey,
           case when o_orderkey % 20 = 1 then 'U' else o_orderstatus end as o_orderstatus,
           case when o_orderkey % 10 = 1 then o_totalprice + 1 else o_totalprice end as o_totalprice,
           o_orderdate, o_orderpriority
    from orders where o_orderkey % 50 <> 0
    union all
    select o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
    from orders where o_orderkey % 100 = 7
"""
ORDERS_NULLED = """
    select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
           case when o_orderkey % 30 = 2 then null else o_orderpriority end as o_orderpriority
    from orders
"""
# A third of all rows has no key.
ORDERS_NULL_KEYS = """
    select case when o_orderkey % 3 = 2 then null else o_orderkey end as o_orderkey,
           o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
    from orders
"""
# Copies with another status, a later position, and one key that a third of the rows share.
ORDERS_REPEATED = """
    select o_orderkey as place, * from orders
    union all
    select o_orderkey + 10000000, o_orderkey, o_custkey, 'R', o_totalprice, o_orderdate, o_orderpriority
    from orders where o_orderkey % 500 = 3
    union all
    select o_orderkey + 20000000, least(o_orderkey, 4), o_custkey, o_orderstatus, o_totalprice, o_orderdate,
           o_orderpriority
    from orders where o_orderkey % 2 = 0
"""
ORDERS_COPIES = """
    select * from orders
    union all
    select * from orders where o_orderkey % 500 = 3
"""
LINEITEM_T = """
    select l_orderkey, l_partkey, l_suppkey, l_linenumber,
           case when l_orderkey % 9 = 4 then l_quantity + 1 else l_quantity end as l_quantity,
           l_extendedprice, l_discount, l_tax,
           case when l_orderkey % 8 = 3 then 'X' else l_returnflag end as l_returnflag,
           l_linestatus, l_shipdate
    from lineitem where l_orderkey % 40 <> 6
    union all
    select l_orderkey + 10000000, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
           l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
    from lineitem where l_orderkey % 50 = 9
"""
CUSTOMER_T = """
    select c_custkey,
           case when c_custkey % 30 = 5 then c_name || ' new' else c_name end as c_name,
           case when c_custkey % 10 = 1 then c_nationkey + 100 else c_nationkey end as c_nationkey,
           c_acctbal,
           case when c_custkey % 20 = 1 then 'MOVED' else c_mktsegment end as c_mktsegment
    from customer where c_custkey % 50 <> 0
    union all
    select c_custkey + 10000000, 'Added ' || c_name, c_nationkey, c_acctbal, c_mktsegment
    from customer where c_custkey % 100 = 7
"""
# One cell of some rows changes to a value found nowhere else, so the best partner is unique.
CUSTOMER_ONE_CELL = """
    select c_custkey, c_name, c_nationkey,
           case when c_custkey % 10 = 1 then -1000000 - c_custkey else c_acctbal end as c_acctbal,
           c_mktsegment
    from customer where c_custkey % 50 <> 0
    union all
    select c_custkey + 10000000, 'Added ' || c_name, c_nationkey, c_acctbal, c_mktsegment
    from customer where c_custkey % 100 = 7
"""
# Keys that come twice on either side, and a column with another name.
CUSTOMER_TWICE = """
    select c_custkey as place, c_custkey, c_name, c_nationkey, c_mktsegment from customer
    union all
    select c_custkey + 10000000, c_custkey, c_name, c_nationkey, 'COPY' from customer where c_custkey % 40 = 3
"""
CUSTOMER_TWICE_T = f"""
    with t as ({CUSTOMER_T})
    select c_custkey as place, c_custkey, c_name, c_nationkey as c_country, c_mktsegment from t
    union all
    select c_custkey + 20000000, c_custkey, c_name, c_nationkey, 'TWICE' from t where c_custkey % 60 = 9
"""
CONVERSATIONS_T = """
    select conv_id, turn, role,
           case when conv_id % 6 = 1 then text || ' (edited)' else text end as text
    from conversations where conv_id % 11 <> 3
"""
DOCUMENTS_T = """
    select doc_id, case when doc_id % 9 = 2 then text || ' (edited)' else text end as text,
           lang, source, n_chars
    from documents where doc_id % 13 <> 5
"""
EVENTS_T = """
    select event_id, ts, user_id, case when event_id % 12 = 5 then event_type || '2' else event_type end
           as event_type, value, props
    from events where event_id % 17 <> 2
"""
EMBEDDINGS_T = """
    select vec_id, embedding, case when vec_id % 7 = 1 then label + 1 else label end as label
    from embeddings where vec_id % 10 <> 3
"""
# Lists regrouped, nulls moved, and a struct with a missing field, beside rows that stay as they are.
EMBEDDINGS_NESTED = """
    select vec_id,
           list_value(list_value(list_extract(embedding, 1), list_extract(embedding, 2)),
                      list_value(list_extract(embedding, 3))) as pairs,
           list_value(list_extract(embedding, 1), null) as ends
    from embeddings
"""
EMBEDDINGS_NESTED_T = """
    select vec_id,
           case when vec_id % 5 = 1
                then list_value(list_value(list_extract(embedding, 1)),
                                list_value(list_extract(embedding, 2), list_extract(embedding, 3)))
                else list_value(list_value(list_extract(embedding, 1), list_extract(embedding, 2)),
                                list_value(list_extract(embedding, 3))) end as pairs,
           case when vec_id % 7 = 2 then list_value(null, list_extract(embedding, 1))
                when vec_id % 7 = 3 then list_value(list_extract(embedding, 1), null, null)
                else list_value(list_extract(embedding, 1), null) end as ends
    from embeddings where vec_id % 11 <> 4
"""
PAGES_T = """
    select url, case when page_id % 8 = 1 then html || ' ' else html end as html from pages
    where page_id % 9 <> 4
"""

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _sql(spark: SparkSession, sf: str, text: str) -> DataFrame:
    for name in TABLES:
        if name in text:
            _table(spark, sf, name).createOrReplaceTempView(name)
    return spark.sql(text)


def _orders_diff(spark, sf, **options) -> tb.Diff:
    return tb.compare(
        _table(spark, sf, "orders"), _sql(spark, sf, ORDERS_T), key="o_orderkey", **options
    )


def _new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tallybridge-check-{uuid.uuid4().hex}"


ORDER_VALUES = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _orders_nokey(spark, sf, **options) -> tb.Diff:
    return tb.compare(
        _table(spark, sf, "orders").drop("o_orderkey"),
        _sql(spark, sf, ORDERS_T).drop("o_orderkey"),
        **options,
    )


def _typed_orders(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("o_custkey").cast("bigint").alias("o_custkey"),
        "o_orderstatus",
        F.col("o_totalprice").cast("double").alias("o_totalprice"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"),
        "o_orderpriority",
    )


def _customer_nokey(spark, sf, **options) -> tb.Diff:
    return tb.compare(
        _table(spark, sf, "customer"),
        _sql(spark, sf, CUSTOMER_ONE_CELL),
        threshold=0.75,
        order_by="c_custkey",
        **options,
    )


# -- queries --------------------------------------------------------------------------


def keyed_summary(spark, sf):
    return _orders_diff(spark, sf).summary()


def keyed_statuses(spark, sf):
    return _orders_diff(spark, sf).comparison.statuses()


def keyed_added(spark, sf):
    return _orders_diff(spark, sf).added_rows()


def keyed_deleted(spark, sf):
    return _orders_diff(spark, sf).deleted_rows()


def keyed_updated(spark, sf):
    return _orders_diff(spark, sf).updated_rows()


def keyed_cell_changes(spark, sf):
    changes = _orders_diff(spark, sf).cell_changes()
    price = F.col("column_name") == "o_totalprice"
    return changes.select(
        "o_orderkey",
        "column_name",
        F.when(price, F.col("old_value").cast("double")).alias("old_number"),
        F.when(price, F.col("new_value").cast("double")).alias("new_number"),
        F.when(~price, F.col("old_value")).alias("old_text"),
        F.when(~price, F.col("new_value")).alias("new_text"),
    )


def keyed_updated_pairs(spark, sf):
    return _orders_diff(spark, sf).comparison.updated_pairs().select(
        "o_orderkey",
        F.col("old.o_totalprice").alias("old_totalprice"),
        F.col("new.o_totalprice").alias("new_totalprice"),
        F.col("old.o_orderstatus").alias("old_status"),
        F.col("new.o_orderstatus").alias("new_status"),
    )


def keyed_updated_details(spark, sf):
    return _orders_diff(spark, sf).updated_details().select(
        "o_orderkey",
        F.size("changes").cast("bigint").alias("changed_cells"),
        F.col("changes")["o_orderstatus"]["old"].alias("old_status"),
        F.col("changes")["o_orderstatus"]["new"].alias("new_status"),
        F.col("row_data.o_custkey").alias("o_custkey"),
    )


def _customers_keyed(spark, sf):
    return tb.compare(
        _table(spark, sf, "customer"),
        _sql(spark, sf, CUSTOMER_T),
        key="c_custkey",
    )


def rendered_updates(spark, sf):
    # engines print numbers differently, so the balance is compared as a number
    updates = _customers_keyed(spark, sf).rendered_updates()
    return updates.withColumn("c_acctbal", F.col("c_acctbal").cast("double"))


def split_rendered_updates(spark, sf):
    parts = split_change(F.col("c_mktsegment"))
    return (
        _customers_keyed(spark, sf)
        .rendered_updates()
        .select("c_custkey", parts["old"].alias("old_segment"), parts["new"].alias("new_segment"))
    )


# The key repeats in the data: the last row by these columns counts.
LINE_VALUES = (
    "l_partkey l_suppkey l_extendedprice l_discount l_tax l_linestatus l_shipdate l_quantity l_returnflag"
).split()


def keyed_composite(spark, sf):
    return tb.compare(
        _table(spark, sf, "lineitem"),
        _sql(spark, sf, LINEITEM_T),
        key=["l_orderkey", "l_linenumber"],
        order_by=LINE_VALUES,
    ).summary()


def keyed_long_texts(spark, sf):
    return tb.compare(
        _table(spark, sf, "documents"), _sql(spark, sf, DOCUMENTS_T), key="doc_id"
    ).updated_rows()


def keyed_conversations(spark, sf):
    return tb.compare(
        _table(spark, sf, "conversations"),
        _sql(spark, sf, CONVERSATIONS_T),
        key=["conv_id", "turn"],
    ).cell_changes()


def keyed_events(spark, sf):
    return tb.compare(
        _table(spark, sf, "events"), _sql(spark, sf, EVENTS_T), key="event_id"
    ).cell_changes()


def keyed_arrays(spark, sf):
    """Array cells are compared whole."""
    diff = tb.compare(
        _table(spark, sf, "embeddings"), _sql(spark, sf, EMBEDDINGS_T), key="vec_id"
    )
    return diff.comparison.statuses()


def _for_spark(text: str) -> str:
    """Lists are written ``list_value(…)`` and read ``list_extract(list, place)`` in one engine, otherwise in the other."""
    return text.replace("list_value(", "array(").replace("list_extract(", "element_at(")


def keyed_nested(spark, sf):
    """Cells of lists are compared by place, length and what is missing; a stored and a lazy result agree."""
    diff = tb.compare(_sql(spark, sf, _for_spark(EMBEDDINGS_NESTED)), _sql(spark, sf, _for_spark(EMBEDDINGS_NESTED_T)), key="vec_id")
    return diff.cell_changes().groupBy("column_name").count().withColumnRenamed("count", "changes")


def nokey_pages(spark, sf):
    pages = _table(spark, sf, "pages").drop("page_id")
    return tb.compare(pages, _sql(spark, sf, PAGES_T)).comparison.unmatched("n")


def _nulled(spark, sf, nulls):
    nulled = _sql(spark, sf, ORDERS_NULLED)
    return tb.compare(nulled, nulled, key="o_orderkey", nulls=nulls).updated_rows().select("o_orderkey")


def keyed_nulls_safe(spark, sf):
    return _nulled(spark, sf, "safe")


def keyed_nulls_unequal(spark, sf):
    return _nulled(spark, sf, "unequal")


def null_keys_unmatched(spark, sf):
    df = _sql(spark, sf, ORDERS_NULL_KEYS)
    return tb.compare(df, df, key="o_orderkey").summary()


def null_keys_added_rows(spark, sf):
    df = _sql(spark, sf, ORDERS_NULL_KEYS)
    return tb.compare(df, df, key="o_orderkey").added_rows()


def null_keys_matched(spark, sf):
    df = _sql(spark, sf, ORDERS_NULL_KEYS)
    return tb.compare(df, df, key="o_orderkey", match_null_keys=True).summary()


def _repeated(spark, sf):
    return tb.compare(
        _sql(spark, sf, ORDERS_REPEATED),
        _table(spark, sf, "orders").select(F.col("o_orderkey").alias("place"), "*"),
        key="o_orderkey",
        order_by="place",
    )


def repeated_key_last_wins(spark, sf):
    changes = _repeated(spark, sf).cell_changes()
    price = F.col("column_name") == "o_totalprice"
    return changes.select(
        "o_orderkey",
        "column_name",
        *[F.when(price, F.col(c).cast("double").cast("decimal(18,2)").cast("string")).otherwise(F.col(c)).alias(c)
          for c in ("old_value", "new_value")],
    )


def repeated_key_rows(spark, sf):
    return _repeated(spark, sf).duplicates_in_source()


def repeated_key_deleted(spark, sf):
    """All occurrences of keys that only the original has, one of which is a third of it."""
    original = _sql(spark, sf, ORDERS_REPEATED)
    new = _table(spark, sf, "orders").where("o_orderkey % 4 <> 0")
    new = new.select(F.col("o_orderkey").alias("place"), "*")
    return tb.compare(original, new, key="o_orderkey", order_by="place").deleted_rows()


def _as_text_key(spark, sf):
    orders = _table(spark, sf, "orders")
    return orders.withColumn("o_custkey", F.col("o_custkey").cast("string"))


def types_aligned(spark, sf):
    return tb.compare(
        _table(spark, sf, "orders"), _as_text_key(spark, sf), key="o_orderkey", align_types=True
    ).summary()


def types_not_aligned(spark, sf):
    return tb.compare(
        _table(spark, sf, "orders"), _as_text_key(spark, sf), key="o_orderkey"
    ).summary()


def _renamed(spark, sf):
    orders = _table(spark, sf, "orders")
    new = orders.withColumnRenamed("o_orderpriority", "o_urgency").drop("o_orderdate")
    return tb.compare(orders, new, key="o_orderkey")


def _filled(names: DataFrame, df: DataFrame) -> DataFrame:
    """The named columns with the number of their values in a table."""
    columns = [c for (c,) in names.collect()]
    counts = df.agg(*[F.count(c).alias(c) for c in columns])
    return counts.unpivot([], columns, "column_name", "filled")


def schema_added_columns(spark, sf):
    diff = _renamed(spark, sf)
    return _filled(diff.columns_only_in_target(), diff.new)


def schema_deleted_columns(spark, sf):
    diff = _renamed(spark, sf)
    return _filled(diff.columns_only_in_source(), diff.original)


def schema_summary(spark, sf):
    return _renamed(spark, sf).summary()


def uniqueness_profile(spark, sf):
    return tb.profile_uniqueness(_table(spark, sf, "orders"))


def uniqueness_profile_events(spark, sf):
    return tb.profile_uniqueness(_table(spark, sf, "events"))


def best_key_candidate(spark, sf):
    return tb.best_candidate(tb.profile_uniqueness(_table(spark, sf, "customer").drop("c_custkey")))


def accepted_key(spark, sf):
    return tb.accepted_key(tb.profile_uniqueness(_table(spark, sf, "part")))


def assumed_key_summary(spark, sf):
    diff = tb.compare(_table(spark, sf, "orders"), _sql(spark, sf, ORDERS_T), discover=True)
    return diff.summary().select(
        F.lit(diff.method).alias("method"), F.lit(diff.key[0]).alias("key_column"), "*"
    )


def nokey_exact_matches(spark, sf):
    return _typed_orders(_orders_nokey(spark, sf).comparison.exact_matches())


def nokey_unmatched_source(spark, sf):
    return _typed_orders(_orders_nokey(spark, sf).comparison.unmatched("o"))


def nokey_unmatched_target(spark, sf):
    return _typed_orders(_orders_nokey(spark, sf).comparison.unmatched("n"))


def nokey_matches_with_copies(spark, sf):
    """Exact matching of rows with copies: one row is a third of each table."""
    text = """
        select o_orderstatus, o_orderpriority from orders where o_orderkey % 3 <> 0
        union all select 'same', 'same' from orders where o_orderkey % 3 = 0
    """
    more = """
        select o_orderstatus, o_orderpriority from orders where o_orderkey % 5 <> 0
        union all select 'same', 'same' from orders where o_orderkey % 2 = 0
    """
    comparison = tb.compare(_sql(spark, sf, text), _sql(spark, sf, more)).comparison
    return comparison.exact_matches()


def duplicates_by_key(spark, sf):
    diff = tb.compare(
        _sql(spark, sf, ORDERS_COPIES), _table(spark, sf, "orders"), key="o_orderkey"
    )
    return diff.duplicates_in_source()


def duplicates_by_content(spark, sf):
    diff = tb.compare(_sql(spark, sf, ORDERS_COPIES), _table(spark, sf, "orders"))
    return diff.duplicates_in_source()


def duplicate_documents(spark, sf):
    return repeated_rows(_table(spark, sf, "documents"), ["text"]).select("doc_id", "n_chars")


def positional_similarity(spark, sf):
    old, new = _table(spark, sf, "orders"), _sql(spark, sf, ORDERS_T)
    types = {f.name: f.dataType for f in old.schema}

    def cells(df, name):
        return df.select(
            "o_orderkey",
            F.array(*[canonical(F.col(c), types[c]) for c in ORDER_VALUES]).alias(name),
        )

    pairs = cells(old, "old").join(cells(new, "new").hint("merge"), "o_orderkey")
    return pairs.select("o_orderkey", similarity(F.col("old"), F.col("new")).alias("similarity"))


def minhash_signatures(spark, sf):
    customer = _table(spark, sf, "customer")
    cells = F.array(*[canonical(F.col(f.name), f.dataType) for f in customer.schema])
    return customer.select("c_custkey", minhash_signature(cells).alias("signature"))


def _number(text: Column) -> Column:
    """A cell as a number; missing and other texts, such as a changed name, are no number."""
    return text.try_cast("double")


def similar_matches(spark, sf):
    return _customer_nokey(spark, sf).comparison.similar_matches().select(
        "similarity",
        F.col("old.c_name").alias("old_name"),
        F.col("new.c_name").alias("new_name"),
        _number(F.col("old.c_acctbal")).alias("old_balance"),
        _number(F.col("new.c_acctbal")).alias("new_balance"),
    )


def all_matches(spark, sf):
    return _customer_nokey(spark, sf).comparison.matches().select(
        "match_kind", "similarity", F.col("old.c_name").alias("old_name"),
        F.col("new.c_name").alias("new_name"),
    )


def nokey_updated_details(spark, sf):
    details = _customer_nokey(spark, sf).updated_details()
    return details.select(
        "row_index",
        F.size("changes").cast("bigint").alias("changed_cells"),
        _number(F.col("changes")["c_acctbal"]["new"]).alias("new_balance"),
        F.col("row_data.c_name").alias("c_name"),
    )


def nokey_cell_changes(spark, sf):
    return _customer_nokey(spark, sf).cell_changes().select(
        "row_index",
        "column_name",
        _number(F.col("old_value")).alias("old_number"),
        _number(F.col("new_value")).alias("new_number"),
    )


def _with_balance(rows: DataFrame) -> DataFrame:
    return rows.withColumn("c_acctbal", _number(F.col("c_acctbal")))


def nokey_added(spark, sf):
    return _with_balance(_customer_nokey(spark, sf).added_rows())


def nokey_deleted(spark, sf):
    return _with_balance(_customer_nokey(spark, sf).deleted_rows())


def nokey_summary(spark, sf):
    return _customer_nokey(spark, sf).summary()


def _acceptable_left(diff: tb.Diff, need: int) -> DataFrame:
    """How many pairs of rows left over, one of each side, agree in ``need`` cells or more: one row, acceptable_left.

    Rows meet in nodes of one more cell at a time, and only nodes that hold both sides are kept. So pairs that agree in
    fewer cells, as many as the square of the rows where a column has few values, are never formed.
    """
    store = diff.comparison.workspace.store
    width = len(diff.comparison.common)
    cells = [f"c{i}" for i in range(width)]
    deleted, added = (rows.toDF(*cells) for rows in (diff.deleted_rows(), diff.added_rows()))
    left = deleted.withColumn("is_new", F.lit(False)).unionAll(added.withColumn("is_new", F.lit(True)))
    left = store(left.select(F.monotonically_increasing_id().alias("rid"), "is_new", F.array(*cells).alias("cells")))
    frontier = left.select(
        "rid", "is_new", F.transform("cells", lambda c, i: F.xxhash64(i, c)).alias("hashes"),
        F.lit(0).alias("at"), F.lit(0).cast("long").alias("node"),
    )
    for depth in range(1, need + 1):
        # Enough cells must follow for the levels to come.
        further = F.slice("hashes", F.col("at") + 1, F.greatest(F.lit(width - need + depth) - F.col("at"), F.lit(0)))
        deeper = frontier.select("*", F.posexplode(further).alias("step", "cell")).select(
            "rid", "is_new", "hashes", (F.col("at") + F.col("step") + 1).alias("at"),
            F.xxhash64("node", "cell").alias("node"),
        )
        both = deeper.groupBy("node").agg(F.count_if(~F.col("is_new")).alias("o"), F.count_if("is_new").alias("n"))
        frontier = store(deeper.join(both.where("o > 0 and n > 0").select("node").hint("merge"), "node"))
        if frontier.isEmpty():
            break
    old, new = (frontier.where(F.col("is_new") == side).select("node", F.col("rid").alias(name))
                for side, name in ((False, "old"), (True, "new")))
    pairs = old.join(new.hint("merge"), "node").select("old", "new").distinct()
    # Hashes only brought the rows together: their cells decide.
    old, new = (left.select(F.col("rid").alias(name), F.col("cells").alias(f"{name}_cells")) for name in ("old", "new"))
    agree = similarity(F.col("old_cells"), F.col("new_cells")) * width >= need - 0.5
    compared = pairs.join(old.hint("merge"), "old").join(new.hint("merge"), "new").where(agree)
    return compared.agg(F.count(F.lit(1)).alias("acceptable_left"))


def _matching_facts(diff: tb.Diff) -> DataFrame:
    """What holds for every right matching at the threshold, whatever its ties."""
    comparison = diff.comparison
    pairs = comparison.similar_matches().agg(
        F.count(F.lit(1)).alias("pairs"),
        F.coalesce(F.min("similarity") >= comparison.threshold - 1e-9, F.lit(True)).alias("all_similar"),
    )
    need = columns_needed(comparison.threshold, len(comparison.common))
    acceptable = _acceptable_left(diff, need)
    sides = diff.counts().select(
        (F.col("deleted_rows_count") + F.col("updated_rows_count")).alias("old_rows"),
        (F.col("added_rows_count") + F.col("updated_rows_count")).alias("new_rows"),
        F.col("updated_rows_count").alias("updated"),
    )
    return (
        sides.join(pairs, F.col("updated") == F.col("pairs"), "left")
        .join(acceptable, F.lit(True))
        .select("old_rows", "new_rows", F.col("pairs").isNotNull().alias("one_to_one"), "all_similar", "acceptable_left")
    )


def similar_orders(spark, sf):
    """Default threshold, two of five cells: ties are free, these facts are not."""
    return _matching_facts(_orders_nokey(spark, sf))


def similar_lineitems(spark, sf):
    """Eleven columns at the default threshold, four equal cells."""
    return _matching_facts(tb.compare(_table(spark, sf, "lineitem"), _sql(spark, sf, LINEITEM_T)))


def similar_lineitems_by_bands(spark, sf):
    """The same by MinHash bands, for those who ask for them."""
    diff = tb.compare(_table(spark, sf, "lineitem"), _sql(spark, sf, LINEITEM_T), matcher="lsh")
    return diff.comparison.similar_matches().groupBy("similarity").count()


def bands_recall(spark, sf):
    """Whether MinHash bands match nine tenths of the rows that can be matched, all of which the exact matcher finds."""
    found = {
        matcher: tb.compare(
            _table(spark, sf, "customer").drop("c_custkey"), _sql(spark, sf, CUSTOMER_T).drop("c_custkey"),
            matcher=matcher, threshold=0.5,
        ).comparison.similar_matches().agg(F.count(F.lit(1)).alias(matcher))
        for matcher in ("exact", "lsh")
    }
    # Two tables of one row each.
    both = found["exact"].withColumn("one", F.lit(1)).join(found["lsh"].withColumn("one", F.lit(1)), "one")
    return both.select((F.col("lsh") >= 0.9 * F.col("exact")).alias("recalled"), (F.col("exact") > 0).alias("tried"))


def minhash_estimates(spark, sf):
    """Per customer, whether the signatures of its two versions estimate their overlap."""
    old, new = _table(spark, sf, "customer"), _sql(spark, sf, CUSTOMER_T)

    def cells(df, name):
        texts = F.array(*[canonical(F.col(f.name), f.dataType) for f in df.schema])
        return df.select("c_custkey", texts.alias(name))

    # Signatures are many times as long as the rows of a file: neither side is broadcast, and only cells are shuffled.
    both = cells(old, "old").join(cells(new, "new").hint("merge"), "c_custkey")
    exact = F.size(F.array_intersect("old", "new")) / F.size(F.array_union("old", "new"))
    estimate = similarity(minhash_signature(F.col("old")), minhash_signature(F.col("new")))
    return both.select("c_custkey", (F.abs(estimate - exact) < 0.35).alias("within"))


def reconciliation(spark, sf):
    return _orders_diff(spark, sf).reconciliation()


def reconciliation_less_added(spark, sf):
    return _orders_diff(spark, sf).reconciliation("less_added")


def severity(spark, sf):
    return _orders_diff(spark, sf).severity()


def outcome_share(spark, sf):
    return _orders_diff(spark, sf).outcome_share()


def change_score(spark, sf):
    return _orders_diff(spark, sf).change_score()


def column_widths(spark, sf):
    return tb.column_widths(_table(spark, sf, "orders"))


def preview(spark, sf):
    shown = _orders_diff(spark, sf).preview()
    return shown.select(
        "category", F.get_json_object("row", "$.o_orderkey").cast("bigint").alias("o_orderkey"),
        "remaining",
    )


def report_tables(spark, sf):
    folder = _new_folder(spark)
    with _customers_keyed(spark, sf) as diff:
        written = tb.write_report(diff, folder)
    counts = None
    for name, location in written.items():
        part = spark.read.parquet(location).agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows")
        )
        counts = part if counts is None else counts.unionAll(part)
    return counts


def json_records(spark, sf):
    folder = _new_folder(spark)
    with _customers_keyed(spark, sf) as diff:
        written = tb.write_json(diff, folder)
    details = spark.read.json(written["updated_rows_details"])
    return details.select(
        "c_custkey",
        F.col("changes.c_mktsegment.old").alias("old_segment"),
        F.col("changes.c_mktsegment.new").alias("new_segment"),
        F.col("row_data.c_name").alias("c_name"),
    )


def _customers_twice(spark, sf):
    old, new = _sql(spark, sf, CUSTOMER_TWICE), _sql(spark, sf, CUSTOMER_TWICE_T)
    return tb.compare(old, new, key="c_custkey", order_by="place")


def preview_duplicates(spark, sf):
    """A preview in which every category has rows."""
    row = {c: F.get_json_object("row", f"$.{c}").cast("bigint").alias(c) for c in ("c_custkey", "place")}
    return _customers_twice(spark, sf).preview().select(
        "category", row["c_custkey"], F.when(F.col("category") != "updated", row["place"]).alias("place"), "remaining"
    )


def _contents(spark, written: dict[str, str], fmt: str, columns: dict[str, str]) -> DataFrame:
    """The written tables below each other, with those of the columns that a table has, as text."""
    whole = None
    for name, location in written.items():
        df = spark.read.format(fmt).load(location)
        cells = []
        for alias, path in columns.items():
            has = path.split(".")[0] in df.columns
            cells.append((F.col(path).cast("string") if has else F.lit(None).cast("string")).alias(alias))
        part = df.select(F.lit(name).alias("table_name"), *cells)
        whole = part if whole is None else whole.unionAll(part)
    return whole


REPORT_CELLS = "place c_custkey c_name c_mktsegment column_name details count percentage".split()


def report_contents(spark, sf):
    """All rows of the eight report tables, read from the files."""
    with _customers_twice(spark, sf) as diff:
        written = tb.write_report(diff, _new_folder(spark))
    return _contents(spark, written, "parquet", {c: c for c in REPORT_CELLS})


def json_contents(spark, sf):
    """All records of the nine parts of a comparison as JSON, read from the files."""
    with _customers_twice(spark, sf) as diff:
        written = tb.write_json(diff, _new_folder(spark))
    cells = {c: c for c in ("place", "c_custkey", "c_name", "c_mktsegment", "column_name")}
    cells |= {"old_segment": "changes.c_mktsegment.old", "new_segment": "changes.c_mktsegment.new"}
    cells |= {"row_name": "row_data.c_name"}
    cells |= {f"n_{c.removesuffix('_count')}": c for c in JSON_COUNTS}
    return _contents(spark, written, "json", cells)


JSON_COUNTS = (
    "added_columns_count deleted_columns_count added_rows_count deleted_rows_count updated_rows_count "
    "duplicate_rows_in_source_count duplicate_rows_in_target_count"
).split()


def report_placeholders(spark, sf):
    """Report tables without rows say so."""
    with _customers_keyed(spark, sf) as diff:
        written = tb.write_report(diff, _new_folder(spark), placeholder=True)
    whole = None
    for name, location in written.items():
        df = spark.read.parquet(location)
        message = F.max("Message") if "Message" in df.columns else F.lit(None).cast("string")
        part = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"), message.alias("message"))
        whole = part if whole is None else whole.unionAll(part)
    return whole


def single_file_loads(spark, sf):
    """Every file of a folder loaded by its own path, and the arguments that are refused."""
    folder = _documents_by_nation(spark, sf, "to_json(s)")
    whole = None
    for path in list_files(spark, folder):
        for name, df in tb.load_files(spark, path=path).frames.items():
            part = df.select(F.lit(name).alias("attempt"), "s_suppkey")
            whole = part if whole is None else whole.unionAll(part)
    attempts = {
        "nothing": {}, "folder and path": {"folder": folder, "path": folder}, "extension alone": {"extension": "json"},
        "extension and path": {"extension": "json", "path": folder}, "another type": {"path": f"{folder}/nation_0.txt"},
    }
    for attempt, arguments in attempts.items():
        try:
            tb.load_files(spark, **arguments)
        except ValueError:
            whole = whole.unionAll(spark.createDataFrame([(f"{attempt}: refused", None)], "attempt string, key long"))
    return whole


def literal_table(spark, sf):
    """A table written out in the program beside the segments that customers have."""
    segments = [("BUILDING", 1), ("MACHINERY", 2), ("NO SUCH", 3), (None, 4)]
    literal = spark.createDataFrame(segments, "c_mktsegment string, place int")
    found = _table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers"))
    diff = tb.compare(literal, found, key="c_mktsegment")
    return diff.added_rows().select("c_mktsegment", "customers").unionAll(
        diff.deleted_rows().select("c_mktsegment", -F.col("place").cast("long"))
    )


def uniqueness_profile_csv(spark, sf):
    """The profile of a folder of CSV files, each parsed once for all columns."""
    folder = _new_folder(spark)
    orders = _table(spark, sf, "orders")
    tb.write_files(orders.repartition(3, "o_orderkey"), folder, "csv")
    whole = None
    for df in tb.load_files(spark, folder, extension=".csv").frames.values():
        whole = df if whole is None else whole.unionByName(df)
    return tb.profile_uniqueness(whole)


def declared_key_columns(spark, sf):
    """Key columns of all tables from their declared constraints, each with its repeated cells."""
    database = f"tallybridge_{uuid.uuid4().hex}"
    tb.use_database(spark, database, "new", _new_folder(spark))
    declared = {"orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "nation": []}
    for name, key in declared.items():
        tb.write_table(_table(spark, sf, name), name, database)
        if key:
            tb.declare_key(spark, name, key, database)
    tb.declare_unique(spark, "lineitem", ["l_partkey", "l_orderkey", "l_linenumber"], database)
    tb.declare_unique(spark, "nation", ["n_name"], database)
    keys = tables.key_columns(*tb.constraints(spark, database))
    profiles = None
    for name in declared:
        part = tb.profile_uniqueness(tb.select(spark, name, database)).select(F.lit(name).alias("table_name"), "*")
        profiles = part if profiles is None else profiles.unionAll(part)
    return keys.join(profiles, ["table_name", "column_name"]).drop("ordinal")


def folder_ingest(spark, sf):
    """A table written as several CSV files, loaded again as one frame per file."""
    folder = _new_folder(spark)
    orders = _table(spark, sf, "orders").withColumn(
        "o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")
    )
    tb.write_files(orders.repartition(3, "o_orderkey"), folder, "csv")
    loaded = tb.load_files(spark, folder, extension="csv")
    frames = list(loaded.frames.values())
    whole = frames[0]
    for df in frames[1:]:
        whole = whole.unionByName(df)
    return whole


def row_index(spark, sf):
    return tb.with_row_index(_table(spark, sf, "orders")).select("o_orderkey", "_row_idx")


def table_names(spark, sf):
    return _table(spark, sf, "part").select(
        "p_partkey", safe_table_name_expr(F.col("p_type")).alias("table_name")
    )


def migrate_manifest(spark, sf):
    database = f"tallybridge_{uuid.uuid4().hex}"
    tb.use_database(spark, database, "new", _new_folder(spark))
    frames = {"orders.2024": _table(spark, sf, "orders"), "documents": _table(spark, sf, "documents"),
              "embeddings": _table(spark, sf, "embeddings")}
    return tb.migrate(spark, frames, database, "existing")


def gated_write(spark, sf):
    database = f"tallybridge_{uuid.uuid4().hex}"
    tb.use_database(spark, database, "new", _new_folder(spark))
    tb.write_table(_table(spark, sf, "orders"), "orders", database)
    stored = tb.select(spark, "orders", database)
    changed = _sql(spark, sf, ORDERS_T)
    tb.write_if_changed(changed, "orders", stored, database=database, key="o_orderkey")
    return tb.select(spark, "orders", database)


def gated_write_report(spark, sf):
    """What the comparison found, asked for after the table was replaced."""
    database = f"tallybridge_{uuid.uuid4().hex}"
    tb.use_database(spark, database, "new", _new_folder(spark))
    tb.write_table(_table(spark, sf, "orders"), "orders", database)
    stored = tb.select(spark, "orders", database)
    result = tb.write_if_changed(
        _sql(spark, sf, ORDERS_T), "orders", stored, database=database, key="o_orderkey"
    )
    return result.diff.reconciliation()


def _documents_by_nation(spark, sf, document: str, more: str = "''") -> str:
    """A folder with one JSON document of suppliers per nation, nation_<key>.json."""
    folder = _new_folder(spark)
    rows = _table(spark, sf, "supplier").groupBy("s_nationkey").agg(
        F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name", "s_acctbal"))).alias("s")
    )  # a document is one cell
    texts = rows.select("s_nationkey", F.concat(F.expr(document), F.expr(more)).alias("value"))
    texts.write.partitionBy("s_nationkey").text(f"{folder}/written")
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{folder}/documents"))
    for found in fs.globStatus(path(f"{folder}/written/s_nationkey=*/part-*")):
        nation = found.getPath().getParent().getName().split("=")[1]
        fs.rename(found.getPath(), path(f"{folder}/documents/nation_{nation}.json"))
    return f"{folder}/documents"


def _united(loaded: tb.LoadResult) -> DataFrame:
    whole = None
    for df in loaded.frames.values():
        whole = df if whole is None else whole.unionByName(df)
    return whole.select("s_suppkey", "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal"))


def json_array(spark, sf):
    """One JSON array of records per nation, loaded as a folder."""
    return _united(tb.load_files(spark, _documents_by_nation(spark, sf, "to_json(s)")))


def json_object(spark, sf):
    """One JSON object of columns per nation, loaded as a folder."""
    columns = ", ".join(f"'{c}', transform(s, x -> x.{c})" for c in ("s_suppkey", "s_name", "s_acctbal"))
    return _united(tb.load_files(spark, _documents_by_nation(spark, sf, f"to_json(named_struct({columns}))")))


def load_manifest(spark, sf):
    """Names and states of a folder's files; a second document in a file is an error."""
    folder = _documents_by_nation(spark, sf, "to_json(s)", "if(s_nationkey % 5 = 0, to_json(s), '')")
    return tb.load_files(spark, folder, extension=".json").manifest().select("name", "status")


def load_preview(spark, sf):
    """The first three rows of every frame of a folder."""
    loaded = tb.load_files(spark, _documents_by_nation(spark, sf, "to_json(s)"))
    return loaded.preview(3).select("name", F.get_json_object("row_json", "$.s_suppkey").cast("long").alias("s_suppkey"))


def table_catalog(spark, sf):
    """Tables of a database with the key of each and where it comes from."""
    database = f"tallybridge_{uuid.uuid4().hex}"
    tb.use_database(spark, database, "new", _new_folder(spark))
    for name in ("orders", "lineitem", "nation"):
        tb.write_table(_table(spark, sf, name), name, database)
    tables.declare_key(spark, "lineitem", ["l_orderkey", "l_linenumber"], database)
    found = [
        (r.table_name, ",".join(key), origin)
        for r in tb.show_tables(spark, database).collect()
        for key, origin in [tables.discover_key(spark, r.table_name, database)]
    ]
    return spark.createDataFrame(found, "table_name string, key string, origin string")


def first_positions(spark, sf):
    """A row-range prefix by position."""
    indexed = tb.with_row_index(_table(spark, sf, "orders"))
    return tb.first_rows(indexed, 40).select("o_orderkey", "_row_idx")


def events_shifted(spark, sf):
    """Instants one microsecond apart are different rows, without a key."""
    events = _table(spark, sf, "events").select("event_id", "ts", F.struct("ts").alias("nested"))
    moved = F.expr("timestampadd(microsecond, 1, ts)")
    nested = F.struct(F.when(F.col("event_id") % 3 == 0, moved).otherwise(F.col("nested.ts")).alias("ts"))
    new = events.select(
        "event_id",
        F.when(F.col("event_id") % 2 == 0, moved).otherwise(F.col("ts")).alias("ts"),
        nested.alias("nested"),
    )
    return tb.compare(events, new).comparison.unmatched("n").select(F.col("event_id").cast("long").alias("event_id"))


def utf8_digests(spark, sf):
    """Fingerprints of texts with letters beyond ASCII, per document."""
    documents = _table(spark, sf, "documents")
    return documents.select("doc_id", F.lower(F.hex(digest([F.col("lang"), F.col("text")]))).alias("fingerprint"))


def mutated_texts(spark, sf):
    """Every name a mutation made follows its template, and nothing else changed."""
    customer = _table(spark, sf, "customer")
    mutated = tb.mutate(
        customer, {"c_name": tb.template("Updated_{}"), "c_mktsegment": tb.number_text("9876", 100000, 999999)},
        row_id="c_custkey", fraction=0.05, seed=7,
    )
    changes = tb.compare(customer, mutated, key="c_custkey").cell_changes()
    good = F.when(
        F.col("column_name") == "c_name", F.col("new_value") == F.concat(F.lit("Updated_"), F.col("c_custkey"))
    ).otherwise(F.col("new_value").rlike("^9876[1-9][0-9]{5}$"))
    return changes.groupBy("column_name").agg(F.bool_and(good).alias("follows"))


def mutated_counts(spark, sf):
    """Seeded changes in five percent of the rows, found again by comparison."""
    customer = _table(spark, sf, "customer")
    rules = {
        "c_name": tb.template("Updated_{}"),
        "c_mktsegment": tb.number_text("9876", 100000, 999999),
        "c_acctbal": lambda row_id, draw: -2000000.0 - row_id,
    }
    mutated = tb.mutate(customer, rules, row_id="c_custkey", fraction=0.05, seed=7)
    changes = tb.compare(customer, mutated, key="c_custkey").cell_changes()
    return changes.groupBy("c_custkey").count().agg(
        F.count(F.lit(1)).alias("updated_rows"),
        F.sum("count").alias("changed_cells"),
        F.max("count").alias("most_cells_in_a_row"),
    )


QUERIES = [
    keyed_summary, keyed_statuses, keyed_added, keyed_deleted, keyed_updated, keyed_cell_changes,
    keyed_updated_pairs, keyed_updated_details, rendered_updates, split_rendered_updates,
    keyed_composite, keyed_long_texts, keyed_conversations, keyed_events, keyed_arrays, keyed_nested, nokey_pages, keyed_nulls_safe, keyed_nulls_unequal,
    null_keys_unmatched, null_keys_added_rows, null_keys_matched, repeated_key_last_wins,
    repeated_key_rows, repeated_key_deleted, types_aligned, types_not_aligned, schema_added_columns,
    schema_deleted_columns, schema_summary, uniqueness_profile, uniqueness_profile_events, best_key_candidate,
    accepted_key, assumed_key_summary, nokey_exact_matches, nokey_unmatched_source,
    nokey_unmatched_target, nokey_matches_with_copies, duplicates_by_key, duplicates_by_content,
    duplicate_documents, positional_similarity, minhash_signatures, similar_matches, all_matches,
    nokey_updated_details, nokey_cell_changes, nokey_added, nokey_deleted, nokey_summary,
    similar_orders, similar_lineitems, similar_lineitems_by_bands, bands_recall, minhash_estimates, reconciliation, reconciliation_less_added, severity,
    outcome_share, change_score, column_widths, preview, preview_duplicates, report_tables, report_contents, report_placeholders,
    json_records, json_contents, single_file_loads, literal_table, uniqueness_profile_csv, declared_key_columns, folder_ingest,
    row_index, table_names, migrate_manifest, gated_write, gated_write_report, json_array, json_object,
    load_manifest, load_preview, table_catalog, first_positions, events_shifted, utf8_digests,
    mutated_texts, mutated_counts,
]


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: the report of a keyed comparison."""
    return reconciliation(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {q.__name__: q for q in QUERIES}
    if llm is not None:
        found |= llm.QUERIES
    if corpus_pipeline is not None:
        found["pipeline"] = corpus_pipeline.run
    return found


# -- the same in SQL ------------------------------------------------------------------

ORDERS_CHANGED = (
    "(o.o_custkey is distinct from n.o_custkey or o.o_orderstatus is distinct from n.o_orderstatus "
    "or o.o_totalprice is distinct from n.o_totalprice or o.o_orderdate is distinct from n.o_orderdate "
    "or o.o_orderpriority is distinct from n.o_orderpriority)"
)
ORDERS_JOIN = f"""
    with t as ({ORDERS_T}),
    j as (
        select o.o_orderkey as ok, n.o_orderkey as nk, {ORDERS_CHANGED} as changed
        from orders o full join t n on o.o_orderkey = n.o_orderkey
    ),
    c as (
        select count(*) filter (where ok is null) as added, count(*) filter (where nk is null) as deleted,
               count(*) filter (where ok is not null and nk is not null and changed) as updated,
               count(ok) as source, count(nk) as target
        from j
    )
"""
_ZERO_COLUMNS = "0::bigint as added_columns_count, 0::bigint as deleted_columns_count"


def _report_lines(matched: str) -> str:
    lines = [
        ("Rows_only_in_target", "added"),
        ("Rows_only_in_source", "deleted"),
        ("Mismatch_rows_from_source_to_target", "updated"),
        ("Matched_rows_from_source_to_target", matched),
        ("Total_rows_in_source", "source"),
        ("Total_rows_in_target", "target"),
    ]
    return ", r as (" + " union all ".join(
        f"select {i} as line, '{name}' as details, {count} as count, source as source_rows, "
        f"({count}) / source::double * 100 as percent from c"
        for i, (name, count) in enumerate(lines, 1)
    ) + ")"


NET, LESS_ADDED = "source - updated - deleted", "source - updated - deleted - added"
REPORT_COLUMNS = (
    "select line, details, count, percent, format('{:.4f}%', percent) as percentage, source_rows from r"
)


def _keyed_summary_sql(old: str, new: str, key: list[str], values: list[str], columns: str) -> str:
    on = " and ".join(f"o.{k} = n.{k}" for k in key)
    changed = " or ".join(f"o.{v} is distinct from n.{v}" for v in values) or "false"
    keys = ", ".join(key)
    last = f"row_number() over (partition by {keys} order by {', '.join(f'{v} desc' for v in values) or keys}) as rn"
    return f"""
        with o as ({old}), n as ({new}),
        lo as (select * from (select *, {last} from o) where rn = 1),
        ln as (select * from (select *, {last} from n) where rn = 1)
        select {columns},
            (select count(*) from n where not exists (select 1 from o where {on})) as added_rows_count,
            (select count(*) from o where not exists (select 1 from n where {on})) as deleted_rows_count,
            (select count(*) from lo o join ln n on {on} where {changed}) as updated_rows_count,
            (select coalesce(sum(c), 0)::bigint from (select count(*) as c from o group by {keys}) where c > 1)
                as duplicate_rows_in_source_count,
            (select coalesce(sum(c), 0)::bigint from (select count(*) as c from n group by {keys}) where c > 1)
                as duplicate_rows_in_target_count
    """


# Last rows by place, and the pairs of them with a changed cell.
_TWICE = f"""
    with o as ({CUSTOMER_TWICE}), n as ({CUSTOMER_TWICE_T}),
    lo as (select * from (select *, row_number() over (partition by c_custkey order by place desc) as rn from o) where rn = 1),
    ln as (select * from (select *, row_number() over (partition by c_custkey order by place desc) as rn from n) where rn = 1),
    p as (
        select l.c_custkey, l.place as op, r.place as np, l.c_name as oc, r.c_name as nc,
               l.c_mktsegment as om, r.c_mktsegment as nm
        from lo l join ln r on l.c_custkey = r.c_custkey
        where l.place is distinct from r.place or l.c_name is distinct from r.c_name
           or l.c_mktsegment is distinct from r.c_mktsegment
    ),
    added as (select * from n where c_custkey not in (select c_custkey from o)),
    deleted as (select * from o where c_custkey not in (select c_custkey from n)),
    twice_o as (select * from (select *, count(*) over (partition by c_custkey) as times from o) where times > 1),
    twice_n as (select * from (select *, count(*) over (partition by c_custkey) as times from n) where times > 1),
    c as (
        select (select count(*) from added) as added, (select count(*) from deleted) as deleted,
               (select count(*) from p) as updated, (select count(*) from o) as source, (select count(*) from n) as target,
               (select count(*) from twice_o) as twice_source, (select count(*) from twice_n) as twice_target
    )
"""


def _arrow(old: str, new: str) -> str:
    return f"case when {old} is distinct from {new} then cast({old} as varchar) || ' → ' || cast({new} as varchar) " \
        f"else cast({new} as varchar) end"


def _stacked(columns: list[str], parts: list[tuple[str, str, dict[str, str]]]) -> str:
    """Selects below each other: a name, what it is selected from, and its columns as text, null where it has none."""
    return " union all ".join(
        f"select '{name}' as table_name, "
        + ", ".join(f"cast({cells.get(c, 'null')} as varchar) as {c}" for c in columns)
        + f" from {source}"
        for name, source, cells in parts
    )


_ROW_CELLS = {c: c for c in ("place", "c_custkey", "c_name", "c_mktsegment")}
_TARGET_ONLY = ("(select 'c_country' as column_name)", {"column_name": "column_name"})
_SOURCE_ONLY = ("(select 'c_nationkey' as column_name)", {"column_name": "column_name"})


def _uniqueness(table: str, columns: list[str]) -> str:
    return " union all ".join(
        f"select {i} as ordinal, '{c}' as column_name, count(*) - count(distinct {c}) as duplicate_count, "
        f"count(*) as total_rows from {table}"
        for i, c in enumerate(columns)
    )


_ORDERS = "select * from orders"
_VALUES = ", ".join(ORDER_VALUES)
_CUSTOMER_RENDERED = """
    case when o.{c} is distinct from n.{c}
         then cast(o.{c} as varchar) || ' → ' || cast(n.{c} as varchar) else cast(n.{c} as varchar) end as {c}
"""
_CUSTOMER_UPDATED = (
    "o.c_name is distinct from n.c_name or o.c_nationkey is distinct from n.c_nationkey "
    "or o.c_mktsegment is distinct from n.c_mktsegment"
)
_SAME = """
    o as (
        select o_orderstatus, o_orderpriority from orders where o_orderkey % 3 <> 0
        union all select 'same', 'same' from orders where o_orderkey % 3 = 0
    ),
    n as (
        select o_orderstatus, o_orderpriority from orders where o_orderkey % 5 <> 0
        union all select 'same', 'same' from orders where o_orderkey % 2 = 0
    )
"""
_ONE_CELL = f"""
    with t as ({CUSTOMER_ONE_CELL}),
    pairs as (
        select o.c_name as c_name, n.c_custkey as row_index, o.c_acctbal as old_balance,
               n.c_acctbal as new_balance
        from customer o join t n on o.c_custkey = n.c_custkey
    ),
    changed as (select * from pairs where old_balance <> new_balance)
"""
_REPEATED_PAIRS = f"""
    with o as ({ORDERS_REPEATED}),
    last as (
        select * from (select *, row_number() over (partition by o_orderkey order by place desc) as rn from o)
        where rn = 1
    ),
    p as (
        select l.o_orderkey, l.o_custkey as oc, n.o_custkey as nc, l.place as op, n.o_orderkey as np,
               l.o_orderstatus as os, n.o_orderstatus as ns, l.o_totalprice as opr, n.o_totalprice as npr,
               l.o_orderdate as od, n.o_orderdate as nd, l.o_orderpriority as opp, n.o_orderpriority as npp
        from last l join orders n on l.o_orderkey = n.o_orderkey
    )
"""


def _leftover_facts(values: str, table: str, changed: str) -> str:
    return f"""
        with t as ({changed}),
        o as (select {values} from {table} except all select {values} from t),
        n as (select {values} from t except all select {values} from {table})
        select (select count(*) from o) as old_rows, (select count(*) from n) as new_rows,
               true as one_to_one, true as all_similar, 0::bigint as acceptable_left"""


def oracle_sql() -> dict[str, str]:
    """For each registered query the same in SQL, unless ties or hashes are free."""
    keyed_counts = f"""{ORDERS_JOIN}
        select {_ZERO_COLUMNS}, added as added_rows_count, deleted as deleted_rows_count,
               updated as updated_rows_count, 0::bigint as duplicate_rows_in_source_count,
               0::bigint as duplicate_rows_in_target_count
        from c"""
    report_net = ORDERS_JOIN + _report_lines(NET)
    report_less_added = ORDERS_JOIN + _report_lines(LESS_ADDED)
    updated_join = f"""
        with t as ({ORDERS_T})
        select {{columns}} from orders o join t n on o.o_orderkey = n.o_orderkey where {ORDERS_CHANGED}
    """
    segment_change = (
        "case when o.c_mktsegment is distinct from n.c_mktsegment then {side}.c_mktsegment end"
    )
    customer_join = f"""
        with t as ({CUSTOMER_T})
        select {{columns}} from customer o join t n on o.c_custkey = n.c_custkey where {_CUSTOMER_UPDATED}
    """
    found = {
        "keyed_summary": keyed_counts,
        "keyed_statuses": f"""
            with t as ({ORDERS_T})
            select coalesce(o.o_orderkey, n.o_orderkey) as o_orderkey,
                   case when o.o_orderkey is null then 'added' when n.o_orderkey is null then 'deleted'
                        when {ORDERS_CHANGED} then 'updated' else 'matched' end as status,
                   (o.o_orderkey is not null)::bigint as source_rows,
                   (n.o_orderkey is not null)::bigint as target_rows
            from orders o full join t n on o.o_orderkey = n.o_orderkey""",
        "keyed_added": f"with t as ({ORDERS_T}) select * from t "
        "where o_orderkey not in (select o_orderkey from orders)",
        "keyed_deleted": f"with t as ({ORDERS_T}) select * from orders "
        "where o_orderkey not in (select o_orderkey from t)",
        "keyed_updated": updated_join.format(columns="n.*"),
        "keyed_cell_changes": f"""
            with t as ({ORDERS_T}),
            j as (select o.o_orderkey, o.o_orderstatus as os, n.o_orderstatus as ns,
                         o.o_totalprice as op, n.o_totalprice as np
                  from orders o join t n on o.o_orderkey = n.o_orderkey)
            select o_orderkey, 'o_totalprice' as column_name, op as old_number, np as new_number,
                   null::varchar as old_text, null::varchar as new_text
            from j where op is distinct from np
            union all
            select o_orderkey, 'o_orderstatus', null, null, os, ns from j where os is distinct from ns""",
        "keyed_updated_pairs": updated_join.format(
            columns="o.o_orderkey, o.o_totalprice as old_totalprice, n.o_totalprice as new_totalprice, "
            "o.o_orderstatus as old_status, n.o_orderstatus as new_status"
        ),
        "keyed_updated_details": updated_join.format(
            columns="o.o_orderkey, (o.o_totalprice is distinct from n.o_totalprice)::bigint "
            "+ (o.o_orderstatus is distinct from n.o_orderstatus)::bigint as changed_cells, "
            "case when o.o_orderstatus is distinct from n.o_orderstatus then o.o_orderstatus end as old_status, "
            "case when o.o_orderstatus is distinct from n.o_orderstatus then n.o_orderstatus end as new_status, "
            "n.o_custkey"
        ),
        "rendered_updates": customer_join.format(
            columns="cast(n.c_custkey as varchar) as c_custkey, "
            + ", ".join(_CUSTOMER_RENDERED.format(c=c) for c in ("c_name", "c_nationkey", "c_mktsegment"))
            + ", n.c_acctbal"
        ),
        "split_rendered_updates": customer_join.format(
            columns=f"cast(n.c_custkey as varchar) as c_custkey, {segment_change.format(side='o')} as old_segment, "
            f"{segment_change.format(side='n')} as new_segment"
        ),
        "keyed_composite": _keyed_summary_sql(
            "select * from lineitem", LINEITEM_T, ["l_orderkey", "l_linenumber"], LINE_VALUES, _ZERO_COLUMNS
        ),
        "keyed_long_texts": f"""
            with t as ({DOCUMENTS_T})
            select n.* from documents o join t n on o.doc_id = n.doc_id where o.text <> n.text""",
        "keyed_conversations": f"""
            with t as ({CONVERSATIONS_T})
            select n.conv_id, n.turn, 'text' as column_name, o.text as old_value, n.text as new_value
            from conversations o join t n on o.conv_id = n.conv_id and o.turn = n.turn
            where o.text <> n.text""",
        "keyed_events": f"""
            with t as ({EVENTS_T})
            select n.event_id, 'event_type' as column_name, o.event_type as old_value,
                   n.event_type as new_value
            from events o join t n on o.event_id = n.event_id where o.event_type <> n.event_type""",
        "keyed_arrays": f"""
            with t as ({EMBEDDINGS_T})
            select o.vec_id, case when n.vec_id is null then 'deleted'
                                  when o.label <> n.label or o.embedding <> n.embedding then 'updated'
                                  else 'matched' end as status,
                   1::bigint as source_rows, (n.vec_id is not null)::bigint as target_rows
            from embeddings o left join t n on o.vec_id = n.vec_id""",
        "keyed_nested": f"""
            with o as ({EMBEDDINGS_NESTED}), n as ({EMBEDDINGS_NESTED_T}),
            c as (select o.pairs is distinct from n.pairs as p, o.ends is distinct from n.ends as e
                  from o join n on o.vec_id = n.vec_id)
            select 'pairs' as column_name, count(*) as changes from c where p
            union all select 'ends', count(*) from c where e""",
        "bands_recall": "select true as recalled, true as tried",
        "nokey_pages": f"with t as ({PAGES_T}) select html, url from t except all select html, url from pages",
        "keyed_nulls_safe": f"with o as ({ORDERS_NULLED}) select a.o_orderkey from o a "
        "join o b on a.o_orderkey = b.o_orderkey where a.o_orderpriority is distinct from b.o_orderpriority",
        "keyed_nulls_unequal": f"with o as ({ORDERS_NULLED}) select a.o_orderkey from o a "
        "join o b on a.o_orderkey = b.o_orderkey where a.o_orderpriority is distinct from b.o_orderpriority "
        "or (a.o_orderpriority is null and b.o_orderpriority is null)",
        "null_keys_unmatched": _keyed_summary_sql(
            ORDERS_NULL_KEYS, ORDERS_NULL_KEYS, ["o_orderkey"], [], _ZERO_COLUMNS
        ),
        "null_keys_added_rows": f"select * from ({ORDERS_NULL_KEYS}) where o_orderkey is null",
        "null_keys_matched": f"""
            with o as ({ORDERS_NULL_KEYS}),
            d as (select coalesce(sum(c), 0)::bigint as n
                  from (select count(*) as c from o group by o_orderkey) where c > 1)
            select {_ZERO_COLUMNS}, 0::bigint as added_rows_count, 0::bigint as deleted_rows_count, 0::bigint as updated_rows_count,
                   n as duplicate_rows_in_source_count, n as duplicate_rows_in_target_count
            from d""",
        "repeated_key_last_wins": f"""{_REPEATED_PAIRS}
            select o_orderkey, 'o_orderstatus' as column_name, os as old_value, ns as new_value
            from p where os is distinct from ns
            union all select o_orderkey, 'o_custkey', cast(oc as varchar), cast(nc as varchar)
            from p where oc is distinct from nc
            union all select o_orderkey, 'place', cast(op as varchar), cast(np as varchar)
            from p where op is distinct from np
            union all select o_orderkey, 'o_totalprice', cast(cast(opr as decimal(18,2)) as varchar),
                             cast(cast(npr as decimal(18,2)) as varchar)
            from p where opr is distinct from npr
            union all select o_orderkey, 'o_orderdate', cast(od as varchar), cast(nd as varchar)
            from p where od is distinct from nd
            union all select o_orderkey, 'o_orderpriority', opp, npp from p where opp is distinct from npp""",
        "repeated_key_rows": f"""
            with o as ({ORDERS_REPEATED})
            select place, o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
            from (select *, count(*) over (partition by o_orderkey) as c from o) where c > 1""",
        "repeated_key_deleted": f"select * from ({ORDERS_REPEATED}) where o_orderkey not in "
        "(select o_orderkey from orders where o_orderkey % 4 <> 0)",
        "types_aligned": f"select {_ZERO_COLUMNS}, 0::bigint as added_rows_count, 0::bigint as deleted_rows_count, "
        "0::bigint as updated_rows_count, 0::bigint as duplicate_rows_in_source_count, 0::bigint as duplicate_rows_in_target_count",
        "types_not_aligned": f"select {_ZERO_COLUMNS}, 0::bigint as added_rows_count, 0::bigint as deleted_rows_count, "
        "count(*) as updated_rows_count, 0::bigint as duplicate_rows_in_source_count, "
        "0::bigint as duplicate_rows_in_target_count from orders",
        "schema_added_columns": "select 'o_urgency' as column_name, count(o_orderpriority) as filled from orders",
        "schema_deleted_columns": "select 'o_orderdate' as column_name, count(o_orderdate) as filled from orders "
        "union all select 'o_orderpriority', count(o_orderpriority) from orders",
        "schema_summary": "select 1::bigint as added_columns_count, 2::bigint as deleted_columns_count, "
        "0::bigint as added_rows_count, 0::bigint as deleted_rows_count, 0::bigint as updated_rows_count, "
        "(count(*) - count(distinct o_orderkey))::bigint as duplicate_rows_in_source_count, "
        "(count(*) - count(distinct o_orderkey))::bigint as duplicate_rows_in_target_count from orders",
        "similar_orders": _leftover_facts(_VALUES, "orders", ORDERS_T),
        "similar_lineitems": _leftover_facts("*", "lineitem", LINEITEM_T),
        "minhash_estimates": f"with t as ({CUSTOMER_T}) select c_custkey, true as within from customer "
        "where c_custkey in (select c_custkey from t)",
        "gated_write_report": report_net + REPORT_COLUMNS,
        "json_array": "select s_suppkey, s_name, s_acctbal from supplier",
        "json_object": "select s_suppkey, s_name, s_acctbal from supplier",
        "load_manifest": "select case when s_nationkey % 5 <> 0 then 'nation_' || s_nationkey || '_jsondf' end as name, "
        "case when s_nationkey % 5 = 0 then 'failed' else 'loaded' end as status "
        "from (select distinct s_nationkey from supplier)",
        "load_preview": "select 'nation_' || s_nationkey || '_jsondf' as name, s_suppkey from (select *, row_number() over "
        "(partition by s_nationkey order by s_suppkey) as rn from supplier) where rn <= 3",
        "table_catalog": "select * from (values ('lineitem', 'l_orderkey,l_linenumber', 'key'), "
        "('nation', 'n_nationkey', 'assumed_key')) v(table_name, key, origin) union all "
        "select 'orders', case when count(*) = count(distinct o_orderkey) then 'o_orderkey' else '' end, "
        "case when count(*) = count(distinct o_orderkey) then 'assumed_key' else 'no_key' end from orders",
        "first_positions": "select o_orderkey, row_number() over (order by o_orderkey) - 1 as _row_idx from orders "
        "order by o_orderkey limit 40",
        "events_shifted": "select event_id from events where event_id % 2 = 0 or event_id % 3 = 0",
        "utf8_digests": "select doc_id, sha256(length(lang) || ':' || lang || length(text) || ':' || text) as fingerprint "
        "from documents",
        "mutated_texts": "select * from (values ('c_name', true), ('c_mktsegment', true)) v(column_name, follows) "
        "where (select count(*) from customer) >= 100",
        "uniqueness_profile": _uniqueness("orders", ["o_orderkey", *ORDER_VALUES]),
        "uniqueness_profile_events": _uniqueness(
            "events", ["event_id", "ts", "user_id", "event_type", "value", "props"]
        ),
        "best_key_candidate": "select * from ("
        + _uniqueness("customer", ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
        + ") order by duplicate_count, ordinal limit 1",
        "accepted_key": "select * from (select * from ("
        + _uniqueness("part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"])
        + ") order by duplicate_count, ordinal limit 1) where duplicate_count = 0 and total_rows > 0",
        "assumed_key_summary": "select 'assumed_key' as method, 'o_orderkey' as key_column, * from ("
        + keyed_counts + ")",
        "nokey_exact_matches": f"with t as ({ORDERS_T}) select {_VALUES} from orders "
        f"intersect all select {_VALUES} from t",
        "nokey_unmatched_source": f"with t as ({ORDERS_T}) select {_VALUES} from orders "
        f"except all select {_VALUES} from t",
        "nokey_unmatched_target": f"with t as ({ORDERS_T}) select {_VALUES} from t "
        f"except all select {_VALUES} from orders",
        "nokey_matches_with_copies": f"with {_SAME} select o_orderpriority, o_orderstatus from o "
        "intersect all select o_orderpriority, o_orderstatus from n",
        "duplicates_by_key": f"select o_orderkey, {_VALUES} from (select *, count(*) over "
        f"(partition by o_orderkey) as c from ({ORDERS_COPIES})) where c > 1",
        "duplicates_by_content": f"select o_orderkey, {_VALUES} from (select *, count(*) over "
        f"(partition by o_orderkey, {_VALUES}) as c from ({ORDERS_COPIES})) where c > 1",
        "duplicate_documents": "select doc_id, n_chars from (select *, count(*) over (partition by text) as c "
        "from documents) where c > 1",
        "positional_similarity": f"with t as ({ORDERS_T}) select o.o_orderkey, ("
        + " + ".join(f"(o.{c} is not distinct from n.{c})::int" for c in ORDER_VALUES)
        + ") / 5.0::double as similarity from orders o join t n on o.o_orderkey = n.o_orderkey",
        "similar_matches": _ONE_CELL + "select 0.75::double as similarity, c_name as old_name, "
        "c_name as new_name, old_balance, new_balance from changed",
        "all_matches": _ONE_CELL + "select case when old_balance = new_balance then 'exact' else 'similar' end "
        "as match_kind, case when old_balance = new_balance then 1.0::double else 0.75::double end as similarity, "
        "c_name as old_name, c_name as new_name from pairs",
        "nokey_updated_details": _ONE_CELL + "select row_index, 1::bigint as changed_cells, new_balance, c_name from changed",
        "nokey_cell_changes": _ONE_CELL + "select row_index, 'c_acctbal' as column_name, "
        "old_balance as old_number, new_balance as new_number from changed",
        "nokey_added": "select 'Added ' || c_name as c_name, cast(c_nationkey as varchar) as c_nationkey, "
        "c_acctbal, c_mktsegment from customer where c_custkey % 100 = 7",
        "nokey_deleted": "select c_name, cast(c_nationkey as varchar) as c_nationkey, c_acctbal, c_mktsegment "
        "from customer where c_custkey % 50 = 0",
        "nokey_summary": _ONE_CELL + f"select {_ZERO_COLUMNS}, "
        "(select count(*) from t where c_custkey >= 10000000) as added_rows_count, "
        "(select count(*) from customer where c_custkey % 50 = 0) as deleted_rows_count, "
        "(select count(*) from changed) as updated_rows_count, "
        "0::bigint as duplicate_rows_in_source_count, 0::bigint as duplicate_rows_in_target_count",
        "reconciliation": report_net + REPORT_COLUMNS,
        "reconciliation_less_added": report_less_added + REPORT_COLUMNS,
        "severity": report_net + "select details, count, case when line > 4 then 'total' "
        "when count > source_rows * 0.05 then 'high' when count = 0 then 'none' else 'low' end as severity from r",
        "outcome_share": report_net + "select details, count, count / (sum(count) over ())::double as share "
        "from r where line <= 4",
        "change_score": f"{ORDERS_JOIN} select added + deleted + updated as change_score from c",
        "column_widths": " union all ".join(
            f"select {i} as ordinal, '{c}' as column_name, "
            f"(greatest(max(length(cast({c} as varchar))), {len(c)}) + 2)::int as width from orders"
            for i, c in enumerate(["o_orderkey", *ORDER_VALUES])
        ),
        "preview": ORDERS_JOIN + " union all ".join(
            f"select '{category}' as category, k as o_orderkey, (select {total} from c) - 5 as remaining from "
            f"(select {key} as k from j where {condition} order by k limit 5)"
            for category, key, condition, total in [
                ("added", "nk", "ok is null", "added"),
                ("deleted", "ok", "nk is null", "deleted"),
                ("updated", "ok", "ok is not null and nk is not null and changed", "updated"),
            ]
        ),
        "preview_duplicates": _TWICE + " union all ".join(
            f"select '{category}' as category, c_custkey, {place} as place, greatest(0, (select {total} from c) - {n}) as remaining "
            f"from (select * from {source} order by c_custkey, place limit {n})"
            for category, source, place, total, n in [
                ("added", "added", "place", "added", 5),
                ("deleted", "deleted", "place", "deleted", 5),
                ("updated", "(select c_custkey, np as place from p)", "null::bigint", "updated", 5),
                ("duplicate_in_source", "twice_o", "place", "twice_source", 4),
                ("duplicate_in_target", "twice_n", "place", "twice_target", 4),
            ]
        ),
        "report_contents": _TWICE + _report_lines(NET) + _stacked(REPORT_CELLS, [
            ("columns_only_in_target", *_TARGET_ONLY),
            ("columns_only_in_source", *_SOURCE_ONLY),
            ("rows_only_in_target", "added", _ROW_CELLS),
            ("rows_only_in_source", "deleted", _ROW_CELLS),
            ("duplicate_rows_in_source", "twice_o", _ROW_CELLS),
            ("duplicate_rows_in_target", "twice_n", _ROW_CELLS),
            ("mismatched_rows", "p", {"place": _arrow("op", "np"), "c_custkey": "c_custkey",
                                      "c_name": _arrow("oc", "nc"), "c_mktsegment": _arrow("om", "nm")}),
            ("summary", "r", {"details": "details", "count": "count", "percentage": "format('{:.4f}%', percent)"}),
        ]),
        "json_contents": _TWICE + _stacked(
            ["place", "c_custkey", "c_name", "c_mktsegment", "column_name", "old_segment", "new_segment", "row_name"]
            + [f"n_{c.removesuffix('_count')}" for c in JSON_COUNTS],
            [
                ("added_columns", *_TARGET_ONLY),
                ("deleted_columns", *_SOURCE_ONLY),
                ("added_rows", "added", _ROW_CELLS),
                ("deleted_rows", "deleted", _ROW_CELLS),
                ("updated_rows_details", "p", {
                    "c_custkey": "c_custkey", "row_name": "nc",
                    "old_segment": "case when om is distinct from nm then om end",
                    "new_segment": "case when om is distinct from nm then nm end"}),
                ("duplicate_rows_in_source", "twice_o", _ROW_CELLS),
                ("duplicate_rows_in_target", "twice_n", _ROW_CELLS),
                ("summary", "c", {
                    "n_added_columns": "1", "n_deleted_columns": "1", "n_added_rows": "added", "n_deleted_rows": "deleted",
                    "n_updated_rows": "updated", "n_duplicate_rows_in_source": "twice_source",
                    "n_duplicate_rows_in_target": "twice_target"}),
                ("updated_rows", "p", {"place": "np", "c_custkey": "c_custkey", "c_name": "nc", "c_mktsegment": "nm"}),
            ],
        ),
        "report_placeholders": f"""
            with t as ({CUSTOMER_T}), counted as (
                select (select count(*) from t where c_custkey not in (select c_custkey from customer)) as added,
                       (select count(*) from customer where c_custkey not in (select c_custkey from t)) as deleted,
                       (select count(*) from customer o join t n on o.c_custkey = n.c_custkey
                        where {_CUSTOMER_UPDATED}) as updated
            ), sizes as (
                select unnest(['columns_only_in_target', 'columns_only_in_source', 'rows_only_in_target', 'rows_only_in_source',
                               'duplicate_rows_in_source', 'duplicate_rows_in_target', 'mismatched_rows', 'summary']) as table_name,
                       unnest([0, 0, added, deleted, 0, 0, updated, 6]) as n
                from counted
            )
            select table_name, greatest(n, 1) as rows,
                   case when n = 0 then 'There are no records in ' || table_name end as message from sizes""",
        "single_file_loads": "select 'nation_' || s_nationkey || '_jsondf' as attempt, s_suppkey from supplier "
        + "".join(f"union all select '{attempt}: refused', null " for attempt in
                  ("nothing", "folder and path", "extension alone", "extension and path", "another type")),
        "literal_table": """
            with l as (select * from (values ('BUILDING', 1), ('MACHINERY', 2), ('NO SUCH', 3), (null, 4)) v(c_mktsegment, place)),
            s as (select c_mktsegment, count(*) as customers from customer group by c_mktsegment)
            select * from s where not exists (select 1 from l where l.c_mktsegment = s.c_mktsegment)
            union all select c_mktsegment, -place from l where not exists (select 1 from s where s.c_mktsegment = l.c_mktsegment)""",
        "uniqueness_profile_csv": _uniqueness("orders", ["o_orderkey", *ORDER_VALUES]),
        "declared_key_columns": " union all ".join(
            f"select '{table}' as table_name, '{column}' as column_name, {place} as place, "
            f"count(*) - count(distinct {column}) as duplicate_count, count(*) as total_rows from {table}"
            for table, column, place in
            [("orders", "o_orderkey", 1), ("lineitem", "l_orderkey", 1), ("lineitem", "l_linenumber", 2)]
        ),
        "report_tables": f"""
            with t as ({CUSTOMER_T}), counted as (
                select (select count(*) from t where c_custkey >= 10000000) as added,
                       (select count(*) from customer where c_custkey % 50 = 0) as deleted,
                       (select count(*) from customer o join t n on o.c_custkey = n.c_custkey
                        where {_CUSTOMER_UPDATED}) as updated
            )
            select 'columns_only_in_target' as table_name, 0::bigint as rows
            union all select 'columns_only_in_source', 0
            union all select 'rows_only_in_target', added from counted
            union all select 'rows_only_in_source', deleted from counted
            union all select 'duplicate_rows_in_source', 0
            union all select 'duplicate_rows_in_target', 0
            union all select 'mismatched_rows', updated from counted
            union all select 'summary', 6""",
        "json_records": customer_join.format(
            columns=f"n.c_custkey, {segment_change.format(side='o')} as old_segment, "
            f"{segment_change.format(side='n')} as new_segment, n.c_name"
        ),
        "folder_ingest": "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, "
        "strftime(o_orderdate, '%Y-%m-%d') as o_orderdate, o_orderpriority from orders",
        "row_index": "select o_orderkey, row_number() over (order by o_orderkey) - 1 as _row_idx from orders",
        "table_names": "select p_partkey, regexp_replace(p_type, '[^\\p{L}\\p{N}_]', '_', 'g') as table_name from part",
        "migrate_manifest": " union all ".join(
            f"select '{name}' as name, '{table}' as table_name, count(*) as rows_read, count(*) as rows_written, "
            f"'written' as status, null::varchar as error from {source}"
            for name, table, source in [
                ("orders.2024", "orders_2024", "orders"),
                ("documents", "documents", "documents"),
                ("embeddings", "embeddings", "embeddings"),
            ]
        ),
        "gated_write": ORDERS_T,
        "mutated_counts": "select floor(count(*) * 0.05)::bigint as updated_rows, "
        "floor(count(*) * 0.05)::bigint * 2 as changed_cells, 2::bigint as most_cells_in_a_row from customer",
    }
    if llm is not None:
        found |= llm.ORACLE_SQL
    if corpus_pipeline is not None and corpus_pipeline.ORACLE_SQL is not None:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
