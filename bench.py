"""Headline jobs, timed. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores. Each job runs once to warm up and is then timed ``RUNS`` times;
the median counts. Results go to Spark's no-op sink, or to the store where
writing is the job.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import functions as F

from millrace.operators.asof import asof_join
from millrace.operators.coerce import coerce_types, typed_rows
from millrace.operators.profile import common_values, data_dictionary
from millrace.operators.sql import sql_query
from millrace.operators.staging import stage
from millrace.operators.validate import error_summary, with_errors
from millrace.plans.relations import project
from millrace.schema import TableSchema
from millrace.session import local_session, scratch_dir
from millrace.sources.csv import read_csv_source
from millrace.sources.store import Backend, WritePolicy

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

ORDERS = {
    "properties": {
        "o_orderkey": {"type": "integer", "PrimaryKey": True},
        "o_custkey": {"type": "integer"},
        "o_orderstatus": {"type": "string"},
        "o_totalprice": {"type": "number"},
        "o_orderpriority": {"type": "string"},
    }
}
LINES = TableSchema(
    {
        "properties": {
            "l_orderkey": {"type": "integer", "minimum": 0},
            "l_partkey": {"type": "integer", "minimum": 0},
            "l_linenumber": {"type": "integer", "minimum": 1, "maximum": 6},
            "l_quantity": {"type": "number", "maximum": 49},
            "l_extendedprice": {"type": "number", "minimum": 0},
            "l_discount": {"type": ["number", "null"], "maximum": 0.09},
            "l_returnflag": {"type": "string", "enum": ["A", "N"]},
            "l_linestatus": {"type": "string", "pattern": "^[FO]$"},
        },
        "required": ["l_orderkey", "l_linenumber"],
    }
)


def main() -> None:
    spark = local_session(CPUS, shuffle_partitions=int(CPUS) if CPUS.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")

    def table(name):
        return spark.read.parquet(f"{SF}/{name}.parquet")

    def drain(df):
        df.write.format("noop").mode("overwrite").save()

    orders = table("orders").drop("o_orderdate")
    raised = F.col("o_totalprice") + 1
    # About a tenth of the orders change, and as many are new.
    changed = orders.filter("o_totalprice < 50000").withColumn("o_totalprice", raised)
    arrivals = changed.withColumn("o_orderkey", -1 - F.col("o_orderkey"))
    update = changed.unionByName(arrivals)

    def store(backend=Backend.PARQUET, **options):
        made = project(spark, "bench", {"orders": ORDERS}, backend=backend, **options)
        made.store.commit_table("orders", orders)
        return made.store

    def merging(backend, policy):
        """Timed: one commit onto a fresh copy of the orders."""

        def prepare():
            fresh = store(backend)
            return lambda: fresh.commit_table("orders", update, policy)

        return prepare

    def always(job):
        return lambda: job

    history = store(Backend.PARQUET_VERSIONED)
    for i in range(9):
        history.commit_table("orders", changed.withColumn("o_totalprice", raised + i))

    text = scratch_dir(spark, "bench-text")
    texts = [F.col(c).cast("string") for c in LINES.columns]
    spread = spark.sparkContext.defaultParallelism  # the given file is one row group
    table("lineitem").select(*texts).repartition(spread).write.parquet(text)
    lines = spark.read.parquet(text)
    csv = scratch_dir(spark, "bench-csv")
    table("lineitem").write.option("header", True).csv(csv)
    events = table("events").select("event_id", "user_id", "ts", "event_type")
    tables = {n: table(n) for n in ("orders", "customer", "lineitem")}

    def sql(text):
        return always(lambda: drain(sql_query(spark, text, tables)))

    jobs = {
        "first_write": lambda: lambda: store(),
        "upsert_by_key": merging(Backend.PARQUET, WritePolicy.UPSERT),
        "append_by_key": merging(Backend.PARQUET, WritePolicy.APPEND),
        "upsert_partial_sql": merging(Backend.SQL, WritePolicy.UPSERT),
        "ver_upsert": merging(Backend.PARQUET_VERSIONED, WritePolicy.UPSERT),
        "ver_current_view_10_commits": always(lambda: drain(history.read_table("orders"))),
        "ver_history_10_commits": always(
            lambda: drain(history.version_history("orders", ["o_totalprice"]))
        ),
        "csv_scan": always(lambda: drain(read_csv_source(spark, csv))),
        "row_number_stage": always(
            lambda: drain(stage(table("lineitem"), order_by=["l_orderkey", "l_linenumber"]))
        ),
        "coerce_types": always(lambda: drain(typed_rows(coerce_types(lines, LINES), LINES))),
        "validate": always(lambda: drain(error_summary(with_errors(lines, LINES)))),
        "data_dictionary": always(lambda: drain(data_dictionary(table("documents")))),
        "common_values": always(lambda: drain(common_values(table("lineitem")))),
        "asof_join": always(
            lambda: drain(
                asof_join(
                    events.drop("event_type"),
                    events.filter("event_type = 'purchase'"),
                    "user_id",
                    "ts",
                    ["event_id"],
                )
            )
        ),
        "sql_join_group": sql(
            "SELECT c.c_mktsegment, l.l_returnflag, count(*) AS n, sum(l.l_extendedprice) AS total "
            "FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey "
            "JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment, l.l_returnflag"
        ),
        "sql_window_rank": sql(
            "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS rk FROM orders"
        ),
    }
    only = sys.argv[1:]
    seconds = {}
    for name, prepare in jobs.items():
        if only and name not in only:
            continue
        times = []
        for _ in range(RUNS + 1):
            job = prepare()
            start = time.perf_counter()
            job()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline jobs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
