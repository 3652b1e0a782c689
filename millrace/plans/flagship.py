"""The flagship flow: commit, update, query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.plans.relations import T1, T2, batch, project, table


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Commit the customers, upsert an update batch, ask SQL per segment."""
    made = project(spark, "flagship")
    made.store.commit_table("customer", table(spark, sf, "customer"), commit_time=T1)
    made.store.commit_table("customer", batch(spark, sf), commit_time=T2)
    return made.sql(
        'SELECT "c_mktsegment" AS segment, count(*) AS n, min(c_acctbal) AS lo, '
        "max(c_acctbal) AS hi FROM customer GROUP BY c_mktsegment"
    )
