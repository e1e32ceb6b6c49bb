"""Time whole comparisons, reports included, and print one JSON line.

Settings: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all cores).
As in the published configuration, a quarter of the rows differ with a key and five
percent, in two cells each, without one.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import tallybridge as tb  # noqa: E402
from tallybridge.operators.stored import shared_folder  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 4)

CHANGED = {
    "orders": """
        select o_orderkey, o_custkey,
               case when o_orderkey % {n} = 1 then 'U' else o_orderstatus end as o_orderstatus,
               case when o_orderkey % {n} = 1 then o_totalprice + 1 else o_totalprice end as o_totalprice,
               o_orderdate, o_orderpriority
        from orders""",
    "lineitem": """
        select l_orderkey, l_partkey, l_suppkey, l_linenumber,
               case when l_orderkey % {n} = 1 then l_quantity + 1000 else l_quantity end as l_quantity,
               l_extendedprice, l_discount, l_tax,
               case when l_orderkey % {n} = 1 then 'X' else l_returnflag end as l_returnflag,
               l_linestatus, l_shipdate
        from lineitem""",
    # The published shape: 400,000 rows of seven columns, at sf0.1.
    "shape7": """
        select row_id, l_partkey, l_suppkey, l_linenumber,
               case when row_id % {n} = 1 then l_quantity + 1000 else l_quantity end as l_quantity,
               case when row_id % {n} = 1 then 'X' else l_returnflag end as l_returnflag, l_shipdate
        from shape7""",
}
KEYS = {
    "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
    "shape7": ["row_id"],
}


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("tallybridge-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tables(spark: SparkSession, name: str, changed_one_in: int, sf: str = SF_DIR):
    original = spark.read.parquet(f"{sf}/{'lineitem' if name == 'shape7' else name}.parquet")
    if name == "shape7":
        original = original.where("l_orderkey % 3 <> 0").selectExpr(
            "xxhash64(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate) as row_id",
            "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate",
        )
    original.createOrReplaceTempView(name)
    return original, spark.sql(CHANGED[name].format(n=changed_one_in))


def report(spark: SparkSession, name: str, key: list[str] | None, changed_one_in: int, sf: str = SF_DIR):
    original, new = tables(spark, name, changed_one_in, sf)
    with tb.compare(original, new, key=key) as diff:
        tb.write_report(diff, f"{shared_folder(spark)}/report-{uuid.uuid4().hex}")


def main() -> None:
    spark = session()
    report(spark, "orders", KEYS["orders"], 4, os.path.join(os.path.dirname(SF_DIR), "sf0.001"))

    def counts(name):
        original, new = tables(spark, name, 4)
        tb.compare(original, new, key=KEYS[name]).counts().collect()

    runs = {
        "keyed_counts_orders": lambda: counts("orders"),
        "keyed_counts_lineitem": lambda: counts("lineitem"),
        "keyed_report_orders": lambda: report(spark, "orders", KEYS["orders"], 4),
        "keyed_report_lineitem": lambda: report(spark, "lineitem", KEYS["lineitem"], 4),
        "keyed_report_shape7": lambda: report(spark, "shape7", KEYS["shape7"], 4),
        "nokey_report_shape7": lambda: report(spark, "shape7", None, 20),
        "nokey_report_orders": lambda: report(spark, "orders", None, 20),
        "nokey_report_lineitem": lambda: report(spark, "lineitem", None, 20),
        "uniqueness_profile_lineitem": lambda: tb.profile_uniqueness(
            tables(spark, "lineitem", 4)[0]
        ).collect(),
        "discovered_key_orders": lambda: tb.unique_column(tables(spark, "orders", 4)[0]),
    }
    seconds, rows_per_second = {}, {}
    for name, run in runs.items():
        started = time.time()
        run()
        seconds[name] = round(time.time() - started, 3)
        rows = tables(spark, name.rsplit("_", 1)[1], 4)[0].count()
        rows_per_second[name] = round(rows / seconds[name])
    print(
        json.dumps(
            {
                "metric": "total seconds of all comparisons",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_second": rows_per_second,
                "cpus": int(CPUS),
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
