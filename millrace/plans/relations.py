"""Relations derived from the given tables, in Spark and as SQL.

* ``batch``: an update of the customers. Two segments change, one is sent
  again unchanged, and every supplier arrives as a new customer (with negative
  keys, which no customer has).
* ``dupbatch``: the batch with a second, later row for indebted customers.
* ``hist``: the customers as version 1 and what the batch adds.
* ``raw``: every customer as untidy text, numbered by ``Row``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.project import Project
from millrace.session import scratch_dir
from millrace.sources.csv import missing_to_null

T1, T2, T3 = "2024-01-01T00:00:00", "2024-02-01T00:00:00", "2024-03-01T00:00:00"

CUSTOMER = {
    "type": "object",
    "properties": {
        "c_custkey": {"type": "integer", "PrimaryKey": True},
        "c_name": {"type": "string"},
        "c_nationkey": {"type": "integer"},
        "c_acctbal": {"type": "number"},
        "c_mktsegment": {"type": "string"},
    },
}
NATION = {
    "properties": {
        "n_nationkey": {"type": "integer", "PrimaryKey": True},
        "n_name": {"type": "string"},
        "n_regionkey": {"type": "integer"},
    }
}
LINES = {
    "properties": {
        "l_orderkey": {"type": "integer"},
        "l_linenumber": {"type": "integer"},
    }
}
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
STAGED = {
    "type": "object",
    "properties": {
        "id": {"type": "integer", "PrimaryKey": True},
        "nation": {"type": ["integer", "null"], "minimum": 0},
        "bal": {"type": "number"},
        "segment": {"type": "string", "enum": SEGMENTS},
        "flag": {"type": ["boolean", "null"]},
        "tags": {"type": ["array", "null"]},
    },
    "required": ["id"],
}

COMMIT_SQL = """WITH cust AS (
  SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment
    FROM customer
),
batch AS (
  SELECT c_custkey, c_name, c_nationkey, c_acctbal + 100 AS c_acctbal, c_mktsegment
    FROM cust WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
  UNION ALL
  SELECT * FROM cust WHERE c_mktsegment = 'FURNITURE'
  UNION ALL
  SELECT -1 - s_suppkey, s_name, CAST(s_nationkey AS BIGINT), s_acctbal, 'BUILDING' FROM supplier
),
dupbatch AS (
  SELECT *, 1 AS ord FROM batch
  UNION ALL
  SELECT c_custkey, c_name, c_nationkey, c_acctbal + 1, c_mktsegment, 2
    FROM batch WHERE c_acctbal < 0
),
hist AS (
  SELECT *, CAST(1 AS BIGINT) AS _version, false AS _deleted,
         '{"timestamp": "2024-01-01T00:00:00"}' AS _metadata FROM cust
  UNION ALL
  SELECT b.*, CAST(CASE WHEN c.c_custkey IS NULL THEN 1 ELSE 2 END AS BIGINT), false,
         '{"timestamp": "2024-02-01T00:00:00"}'
    FROM batch b LEFT JOIN cust c ON b.c_custkey = c.c_custkey
   WHERE c.c_custkey IS NULL OR b.c_acctbal IS DISTINCT FROM c.c_acctbal
)"""

STAGED_SQL = """WITH raw AS (
  SELECT c_custkey + 1 AS "Row",
    CASE WHEN c_custkey % 41 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN '  ' || CAST(c_custkey AS VARCHAR) || ' '
         ELSE CAST(c_custkey AS VARCHAR) END AS id,
    CASE WHEN c_custkey % 11 = 0 THEN 'N/A' WHEN c_custkey % 13 = 0 THEN '-3'
         ELSE CAST(c_nationkey AS VARCHAR) END AS nation,
    CASE WHEN c_custkey % 17 = 0 THEN '1e5' WHEN c_custkey % 19 = 0 THEN 'abc'
         ELSE CAST(c_acctbal AS VARCHAR) END AS bal,
    CASE WHEN c_custkey % 23 = 0 THEN 'RETAIL' ELSE c_mktsegment END AS segment,
    CASE c_custkey % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'FALSE' WHEN 2 THEN 'yes' ELSE '' END AS flag,
    CASE c_custkey % 3 WHEN 0 THEN '["a", ''b'', c]' WHEN 1 THEN 'a, b' ELSE 'a' END AS tags
  FROM customer
),
typed AS (
  SELECT "Row",
    CASE WHEN regexp_full_match(trim(id), '[+-]?[0-9]+') THEN CAST(trim(id) AS BIGINT) END AS id,
    CASE WHEN regexp_full_match(nation, '[+-]?[0-9]+') THEN CAST(nation AS BIGINT) END AS nation,
    CASE WHEN regexp_full_match(bal, '[+-]?[0-9]+') OR bal LIKE '%.%' THEN TRY_CAST(bal AS DOUBLE) END AS bal,
    segment,
    CASE lower(flag) WHEN 'true' THEN true WHEN 'false' THEN false END AS flag,
    flag AS flag_txt, bal AS bal_txt, tags
  FROM raw
),
errors AS (
  SELECT "Row", 'id' AS path, 'type' AS keyword FROM typed WHERE id IS NULL
  UNION ALL SELECT "Row", 'nation', 'minimum' FROM typed WHERE nation < 0
  UNION ALL SELECT "Row", 'bal', 'type' FROM typed WHERE bal IS NULL
  UNION ALL SELECT "Row", 'segment', 'enum' FROM typed
    WHERE segment NOT IN ('AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY')
  UNION ALL SELECT "Row", 'flag', 'type' FROM typed WHERE flag IS NULL AND flag_txt <> ''
  UNION ALL SELECT "Row", 'tags', 'type' FROM typed WHERE tags NOT LIKE '[%]' AND tags NOT LIKE '%,%'
),
edits AS (
  SELECT "Row", CASE WHEN c_mktsegment = 'BUILDING' THEN r.segment ELSE r.segment || '_E' END AS segment
    FROM raw r JOIN customer c ON c.c_custkey + 1 = r."Row" WHERE c.c_acctbal < 0
)"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def project(spark: SparkSession, label: str, schemas: dict | None = None, **options) -> Project:
    """A new project in the shared scratch folder."""
    made = Project(spark, scratch_dir(spark, label), **options)
    for name, document in (schemas or {"customer": CUSTOMER}).items():
        made.store.put_schema(name, document)
    return made


def batch_of(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    """The update of the customers; works on batch and streaming frames."""
    segment = F.col("c_mktsegment")
    moved = segment.isin("BUILDING", "MACHINERY")
    updates = customer.filter(moved | (segment == "FURNITURE")).withColumn(
        "c_acctbal",
        F.when(moved, F.col("c_acctbal") + 100).otherwise(F.col("c_acctbal")),
    )
    arrivals = supplier.select(
        (-1 - F.col("s_suppkey")).alias("c_custkey"),
        F.col("s_name").alias("c_name"),
        F.col("s_nationkey").alias("c_nationkey"),
        F.col("s_acctbal").alias("c_acctbal"),
        F.lit("BUILDING").alias("c_mktsegment"),
    )
    return updates.unionByName(arrivals)


def batch(spark: SparkSession, sf: str) -> DataFrame:
    return batch_of(table(spark, sf, "customer"), table(spark, sf, "supplier"))


def dupbatch(spark: SparkSession, sf: str) -> DataFrame:
    first = batch(spark, sf).withColumn("ord", F.lit(1))
    again = first.filter(F.col("c_acctbal") < 0).select(
        "c_custkey",
        "c_name",
        "c_nationkey",
        (F.col("c_acctbal") + 1).alias("c_acctbal"),
        "c_mktsegment",
        F.lit(2).alias("ord"),
    )
    return first.unionByName(again)


def raw(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as untidy source text."""
    key = F.col("c_custkey")
    text = key.cast("string")
    flag = key % 4
    tags = key % 3
    return table(spark, sf, "customer").select(
        (key + 1).alias("Row"),
        F.when(key % 41 == 0, "")
        .when(key % 7 == 0, F.concat(F.lit("  "), text, F.lit(" ")))
        .otherwise(text)
        .alias("id"),
        F.when(key % 11 == 0, "N/A")
        .when(key % 13 == 0, "-3")
        .otherwise(F.col("c_nationkey").cast("string"))
        .alias("nation"),
        F.when(key % 17 == 0, "1e5")
        .when(key % 19 == 0, "abc")
        .otherwise(F.col("c_acctbal").cast("string"))
        .alias("bal"),
        F.when(key % 23 == 0, "RETAIL").otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(flag == 0, "True")
        .when(flag == 1, "FALSE")
        .when(flag == 2, "yes")
        .otherwise("")
        .alias("flag"),
        F.when(tags == 0, "[\"a\", 'b', c]").when(tags == 1, "a, b").otherwise("a").alias("tags"),
    )


def staged(spark: SparkSession, sf: str) -> DataFrame:
    """The raw batch as a CSV read would give it: missing tokens are null."""
    return missing_to_null(raw(spark, sf))


def edits(spark: SparkSession, sf: str) -> DataFrame:
    """A reviewer's edits of the segment of indebted customers."""
    debtors = table(spark, sf, "customer").filter("c_acctbal < 0")
    segment = F.when(F.col("c_custkey") % 23 == 0, "RETAIL").otherwise(F.col("c_mktsegment"))
    return debtors.select(
        (F.col("c_custkey") + 1).alias("Row"),
        F.when(F.col("c_mktsegment") == "BUILDING", segment)
        .otherwise(F.concat(segment, F.lit("_E")))
        .alias("segment"),
    )
