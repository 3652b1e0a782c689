"""Queries over the store: scans, commits, versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.merge import unseen
from millrace.operators.shape import (
    STAGING_COLUMNS,
    conform,
    drop_helpers,
    pad_missing,
    schema_order,
    union_by_name,
)
from millrace.operators.staging import stage
from millrace.operators.validate import with_errors
from millrace.operators.versions import committed_at, compare_with_latest
from millrace.operators.review import kept_rows, reject_error_rows
from millrace.plans.registry import query
from millrace.plans.relations import (
    COMMIT_SQL,
    CUSTOMER,
    LINES,
    NATION,
    STAGED,
    STAGED_SQL,
    T1,
    T2,
    T3,
    batch,
    batch_of,
    dupbatch,
    project,
    raw,
    staged,
    table,
)
from millrace.schema import TableSchema
from millrace.session import scratch_dir
from millrace.sources.csv import read_csv_source, write_csv
from millrace.sources.store import Backend, BackupPolicy, WritePolicy
from millrace.streaming.commit import stream_commit

VERSIONED = {"backend": Backend.PARQUET_VERSIONED}
ROWS = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"


def with_customers(spark, sf, label, **options):
    """A project whose store holds the customers."""
    made = project(spark, label, **options)
    made.store.commit_table("customer", table(spark, sf, "customer"), commit_time=T1)
    return made


def with_history(spark, sf, label):
    made = with_customers(spark, sf, label, **VERSIONED)
    made.store.commit_table("customer", batch(spark, sf), commit_time=T2)
    return made


# -- sources and sinks ---------------------------------------------------------


@query("csv_scan", 'SELECT "Row", NULLIF(nation, \'N/A\') AS nation, bal FROM raw', STAGED_SQL)
def csv_scan(spark, sf):
    path = scratch_dir(spark, "csv")
    write_csv(raw(spark, sf), path, keep_helpers=True)
    return read_csv_source(spark, path).select(
        F.col("Row").cast("long").alias("Row"), "nation", "bal"
    )


@query("table_scan", "SELECT * FROM orders")
def table_scan(spark, sf):
    made = project(spark, "scan", {"nation": NATION})
    made.store.commit_table("orders", table(spark, sf, "orders"))
    return made.store.read_table("orders")


@query("column_scan", "SELECT c_mktsegment FROM customer")
def column_scan(spark, sf):
    return with_customers(spark, sf, "column").store.read_table_column("customer", "c_mktsegment")


@query(
    "current_view",
    "SELECT c_custkey, c_acctbal FROM (SELECT *, row_number() OVER "
    "(PARTITION BY c_custkey ORDER BY _version DESC) rn FROM hist WHERE NOT _deleted) WHERE rn = 1",
    COMMIT_SQL,
)
def current_view(spark, sf):
    made = with_history(spark, sf, "current")
    return made.store.read_table("customer").select("c_custkey", "c_acctbal")


LATEST = (
    "(SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY _version DESC) rn FROM hist WHERE NOT _deleted)"
)


@query("ver_column_scan", f"SELECT c_mktsegment FROM {LATEST} WHERE rn = 1", COMMIT_SQL)
def ver_column_scan(spark, sf):
    """One column of a versioned table."""
    return with_history(spark, sf, "vercolumn").store.read_table_column("customer", "c_mktsegment")


@query("ver_primary_keys", f"SELECT c_custkey FROM {LATEST} WHERE rn = 1", COMMIT_SQL)
def ver_primary_keys(spark, sf):
    return with_history(spark, sf, "verkeys").store.primary_keys("customer")


@query(
    "sql_versioned",
    f"SELECT c_mktsegment, count(*) AS n FROM {LATEST} WHERE rn = 1 GROUP BY c_mktsegment",
    COMMIT_SQL,
)
def sql_versioned(spark, sf):
    """SQL over a versioned table reads its current rows."""
    made = with_history(spark, sf, "versql")
    return made.sql("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")


@query("table_catalog", "SELECT 'customer' AS \"table\", CAST(2 AS BIGINT) AS version FROM (SELECT count(*) FROM customer)")
def table_catalog(spark, sf):
    """All tables with their version, as one frame."""
    return with_history(spark, sf, "catalog").store.catalog().select("table", "version")


@query("primary_keys", "SELECT c_custkey FROM customer")
def primary_keys(spark, sf):
    return with_customers(spark, sf, "keys").store.primary_keys("customer")


@query(
    "commit_history",
    "SELECT json_extract_string(_metadata, '$.timestamp') AS committed_at, count(*) AS n, "
    "count(*) AS logged FROM hist GROUP BY 1",
    COMMIT_SQL,
)
def commit_history(spark, sf):
    made = with_history(spark, sf, "log")
    per_commit = (
        made.store.history("customer")
        .groupBy(committed_at().alias("committed_at"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    log = made.store.commit_log("customer").select(
        F.col("last_updated").alias("committed_at"), F.col("rows").alias("logged")
    )
    return per_commit.join(log, "committed_at")


@query(
    "csv_export",
    'SELECT "Row" AS row_no, trim(id) AS id, segment FROM raw WHERE "Row" NOT IN (SELECT "Row" FROM errors)',
    STAGED_SQL,
)
def csv_export(spark, sf):
    marked = reject_error_rows(with_errors(staged(spark, sf), TableSchema(STAGED)))
    out = marked.select("*", F.col("Row").alias("row_no"))
    path = write_csv(out.withColumn("id", F.trim("id")), scratch_dir(spark, "export"))
    return read_csv_source(spark, path).select(
        F.col("row_no").cast("long").alias("row_no"), "id", "segment"
    )


@query("parquet_commit", "SELECT * FROM orders")
def parquet_commit(spark, sf):
    made = project(spark, "commit", {"nation": NATION})
    made.store.commit_table("orders", table(spark, sf, "orders"), commit_time=T1)
    return made.store.read_table("orders")


@query(
    "backup_snapshot",
    f"{ROWS} FROM cust WHERE c_custkey NOT IN (SELECT c_custkey FROM batch) UNION ALL {ROWS} FROM batch",
    COMMIT_SQL,
)
def backup_snapshot(spark, sf):
    made = with_customers(spark, sf, "backup", backup_policy=BackupPolicy.TIMESTAMPED_COPIES)
    made.store.commit_table("customer", batch(spark, sf), commit_time=T2)
    return spark.read.parquet(made.store.backups("customer")[-1])


# -- shaping -------------------------------------------------------------------


@query("schema_order", "SELECT c_mktsegment, c_custkey, c_name FROM customer")
def schema_order_query(spark, sf):
    schema = TableSchema({"properties": {"c_custkey": {}, "c_name": {}}})
    df = table(spark, sf, "customer").select("c_name", "c_mktsegment", "c_custkey")
    return schema_order(df, schema, prepend=["c_mktsegment"])


@query("pad_missing", "SELECT c_custkey, c_name, CAST(NULL AS DOUBLE) AS risk_score FROM customer")
def pad_missing_query(spark, sf):
    schema = TableSchema(
        {
            "properties": {
                "c_custkey": {"type": "integer"},
                "c_name": {"type": "string"},
                "risk_score": {"type": "number"},
            }
        }
    )
    df = table(spark, sf, "customer").select("c_custkey", "c_name")
    return pad_missing(df, schema.struct())


@query("conform_to_schema", "SELECT id, nation, bal, flag FROM typed", STAGED_SQL)
def conform_to_schema(spark, sf):
    """The whole batch, bad cells included: what coercion refuses turns null."""
    return conform(staged(spark, sf), TableSchema(STAGED), on_error="null").select(
        "id", "nation", "bal", "flag"
    )


@query(
    "union_by_name",
    "SELECT c_custkey, c_name, CAST(NULL AS VARCHAR) AS tag FROM cust "
    "UNION ALL SELECT c_custkey, c_name, 'new' FROM batch",
    COMMIT_SQL,
)
def union_by_name_query(spark, sf):
    old = table(spark, sf, "customer").select("c_custkey", "c_name")
    new = batch(spark, sf).select(F.lit("new").alias("tag"), "c_name", "c_custkey")
    return union_by_name(old, new)


@query("drop_helper_columns", f"{ROWS} FROM hist", COMMIT_SQL)
def drop_helper_columns(spark, sf):
    history = with_history(spark, sf, "helpers").store.history("customer")
    for name in [*STAGING_COLUMNS, "source_valid"]:
        history = history.withColumn(name, F.lit(1))
    return drop_helpers(history, "source_valid")


@query(
    "row_number_stage",
    'SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS "Row", '
    "false AS _delete FROM orders",
)
def row_number_stage(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return stage(df, order_by=["o_totalprice", "o_orderkey"]).select("o_orderkey", "Row", "_delete")


# -- commits -------------------------------------------------------------------


@query(
    "commit_multi",
    "SELECT 'customer' AS tbl, count(*) + (SELECT count(*) FROM supplier) AS n FROM customer "
    "UNION ALL SELECT 'nation', count(*) FROM nation",
)
def commit_multi(spark, sf):
    """Three frames for two tables: both frames of one table count."""
    made = project(spark, "multi", {"customer": CUSTOMER, "nation": NATION})
    arrivals = batch(spark, sf).filter("c_custkey < 0")  # the suppliers
    frames = [table(spark, sf, "customer"), table(spark, sf, "nation"), arrivals]
    made.store.commit_tables(["customer", "nation", "customer"], frames)
    names = ["customer", "nation"]
    counts = [
        made.store.read_table(n).agg(F.lit(n).alias("tbl"), F.count(F.lit(1)).alias("n"))
        for n in names
    ]
    return counts[0].unionByName(counts[1])


@query("first_write", f"{ROWS} FROM cust", COMMIT_SQL)
def first_write(spark, sf):
    return with_customers(spark, sf, "first").store.read_table("customer")


@query(
    "append_no_key",
    "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem "
    "UNION ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'",
)
def append_no_key(spark, sf):
    lines = table(spark, sf, "lineitem")
    made = project(spark, "lines", {"lines": LINES})
    made.store.commit_table("lines", lines)
    made.store.commit_table("lines", lines.filter("l_returnflag = 'R'"))
    return made.store.read_table("lines")


@query(
    "append_by_key",
    f"{ROWS} FROM cust UNION ALL {ROWS} FROM batch WHERE c_custkey NOT IN (SELECT c_custkey FROM cust)",
    COMMIT_SQL,
)
def append_by_key(spark, sf):
    made = with_customers(spark, sf, "append", write_policy=WritePolicy.APPEND)
    made.store.commit_table("customer", batch(spark, sf))
    return made.store.read_table("customer")


@query(
    "upsert_by_key",
    f"{ROWS} FROM cust WHERE c_custkey NOT IN (SELECT c_custkey FROM batch) UNION ALL {ROWS} FROM batch",
    COMMIT_SQL,
)
def upsert_by_key(spark, sf):
    made = with_customers(spark, sf, "upsert")
    made.store.commit_table("customer", batch(spark, sf))
    return made.store.read_table("customer")


@query(
    "append_ignore_sql",
    f"{ROWS} FROM cust UNION ALL {ROWS} FROM dupbatch "
    "WHERE ord = 1 AND c_custkey NOT IN (SELECT c_custkey FROM cust)",
    COMMIT_SQL,
)
def append_ignore_sql(spark, sf):
    made = with_customers(
        spark, sf, "ignore", backend=Backend.SQL, write_policy=WritePolicy.APPEND
    )
    made.store.commit_table("customer", dupbatch(spark, sf), order_by="ord")
    return made.store.read_table("customer")


@query(
    "upsert_partial_sql",
    "SELECT coalesce(c.c_custkey, b.c_custkey) AS c_custkey, c.c_name, "
    "CASE WHEN b.c_custkey IS NULL THEN c.c_acctbal ELSE b.c_acctbal END AS c_acctbal "
    "FROM cust c FULL JOIN (SELECT c_custkey, arg_max(c_acctbal, ord) AS c_acctbal "
    "FROM dupbatch GROUP BY 1) b ON c.c_custkey = b.c_custkey",
    COMMIT_SQL,
)
def upsert_partial_sql(spark, sf):
    made = with_customers(spark, sf, "partial", backend=Backend.SQL)
    supplied = dupbatch(spark, sf).select("c_custkey", "c_acctbal", "ord")
    made.store.commit_table("customer", supplied, order_by="ord")
    return made.store.read_table("customer").select("c_custkey", "c_name", "c_acctbal")


@query("empty_commit", f"{ROWS} FROM cust", COMMIT_SQL)
def empty_commit(spark, sf):
    made = with_customers(spark, sf, "empty")
    nothing = table(spark, sf, "customer").filter("c_mktsegment = 'no such segment'")
    made.store.commit_table("customer", nothing)
    return made.store.read_table("customer")


@query("key_presence_gate", f"{ROWS} FROM cust", COMMIT_SQL)
def key_presence_gate(spark, sf):
    """A batch without the key column is refused and changes nothing."""
    made = with_customers(spark, sf, "keygate")
    try:
        made.store.commit_table("customer", batch(spark, sf).drop("c_custkey"))
    except ValueError:
        return made.store.read_table("customer")
    raise AssertionError("a batch without its key was committed")


@query("policy_gate", f"{ROWS} FROM cust", COMMIT_SQL)
def policy_gate(spark, sf):
    """An unknown policy is refused and changes nothing."""
    made = with_customers(spark, sf, "policygate")
    try:
        made.store.commit_table("customer", batch(spark, sf), policy="replace")
    except ValueError:
        return made.store.read_table("customer")
    raise AssertionError("an unknown write policy was accepted")


# -- versions ------------------------------------------------------------------


@query(
    "ver_first_write",
    "SELECT c_custkey, _version, _deleted, _metadata FROM hist WHERE _metadata LIKE '%2024-01-01%'",
    COMMIT_SQL,
)
def ver_first_write(spark, sf):
    made = with_customers(spark, sf, "ver1", **VERSIONED)
    return made.store.history("customer").select("c_custkey", "_version", "_deleted", "_metadata")


@query(
    "ver_append", "SELECT c_custkey, _version, _metadata FROM hist WHERE _version = 1", COMMIT_SQL
)
def ver_append(spark, sf):
    made = with_customers(spark, sf, "verappend", write_policy=WritePolicy.APPEND, **VERSIONED)
    made.store.commit_table("customer", batch(spark, sf), commit_time=T2)
    return made.store.history("customer").select("c_custkey", "_version", "_metadata")


@query(
    "ver_current_view",
    f"{ROWS} FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY _version DESC) rn "
    "FROM hist WHERE NOT _deleted) WHERE rn = 1",
    COMMIT_SQL,
)
def ver_current_view(spark, sf):
    return with_history(spark, sf, "verview").store.read_table("customer")


@query("ver_upsert", f"{ROWS}, _version, _deleted, _metadata FROM hist", COMMIT_SQL)
def ver_upsert(spark, sf):
    return with_history(spark, sf, "verupsert").store.history("customer")


@query(
    "ver_change_detect",
    "SELECT b.c_custkey, CASE WHEN c.c_custkey IS NULL THEN 'new' "
    "WHEN b.c_acctbal IS DISTINCT FROM c.c_acctbal THEN 'changed' ELSE 'unchanged' END AS status "
    "FROM batch b LEFT JOIN cust c ON b.c_custkey = c.c_custkey",
    COMMIT_SQL,
)
def ver_change_detect(spark, sf):
    history = with_customers(spark, sf, "verdiff", **VERSIONED).store.history("customer")
    update = conform(batch(spark, sf), TableSchema(CUSTOMER))
    marked = compare_with_latest(history, update, "c_custkey")
    return marked.select("c_custkey", F.col("__status").alias("status"))


@query("ver_as_of", f"{ROWS} FROM cust", COMMIT_SQL)
def ver_as_of(spark, sf):
    return with_history(spark, sf, "verasof").store.read_as_of("customer", T1)


@query(
    "ver_history",
    "SELECT c_custkey, _version, lag(c_acctbal) OVER (PARTITION BY c_custkey ORDER BY _version) AS prev_acctbal, "
    "count(*) OVER (PARTITION BY c_custkey) AS n_versions FROM hist",
    COMMIT_SQL,
)
def ver_history(spark, sf):
    made = with_history(spark, sf, "verhistory")
    return made.store.version_history("customer", ["c_acctbal"]).select(
        "c_custkey", "_version", F.col("prev_c_acctbal").alias("prev_acctbal"), "n_versions"
    )


@query(
    "ver_tombstone",
    "SELECT c_custkey, c_acctbal FROM (SELECT *, row_number() OVER "
    "(PARTITION BY c_custkey ORDER BY _version DESC) rn FROM hist) WHERE rn = 1 AND c_custkey NOT IN "
    "(SELECT c_custkey FROM cust WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD'))",
    COMMIT_SQL,
)
def ver_tombstone(spark, sf):
    made = with_history(spark, sf, "verdelete")
    doomed = table(spark, sf, "customer").filter("c_mktsegment IN ('BUILDING', 'HOUSEHOLD')")
    made.store.delete_keys("customer", doomed, commit_time=T3)
    return made.store.read_table("customer").select("c_custkey", "c_acctbal")


@query(
    "only_new_rows",
    f"{ROWS} FROM batch WHERE c_custkey NOT IN (SELECT c_custkey FROM cust)",
    COMMIT_SQL,
)
def only_new_rows(spark, sf):
    made = with_customers(spark, sf, "newrows")
    fresh = unseen(batch(spark, sf), made.store.primary_keys("customer"), ["c_custkey"])
    return conform(fresh, TableSchema(CUSTOMER))


# -- streaming -----------------------------------------------------------------


@query(
    "stream_commit",
    f"{ROWS} FROM cust WHERE c_custkey NOT IN (SELECT c_custkey FROM batch) UNION ALL {ROWS} FROM batch",
    COMMIT_SQL,
)
def stream_commit_query(spark, sf):
    """The batch arrives through file streams and is merged per micro-batch. A
    second checkpoint under the same name delivers the other half of it."""
    made = with_customers(spark, sf, "stream")

    def stream(name):
        layout = table(spark, sf, name).schema
        reader = spark.readStream.schema(layout).option("pathGlobFilter", f"{name}.parquet")
        return reader.parquet(sf)

    whole = batch_of(stream("customer"), stream("supplier"))
    for half in (whole.filter("c_custkey < 0"), whole.filter("c_custkey >= 0")):
        run = stream_commit(
            half,
            made.store,
            "customer",
            scratch_dir(spark, "checkpoint"),
            name=f"customers-{made.root[-8:]}",
        )
        run.awaitTermination()
    return made.store.read_table("customer")
