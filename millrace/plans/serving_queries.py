"""Queries over stored data: profiles, reports, chart data, SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import charts, reports
from millrace.operators.asof import asof_join
from millrace.operators.profile import common_values, data_dictionary
from millrace.operators.ranges import range_join
from millrace.operators.sql import sql_query
from millrace.plans.registry import query
from millrace.plans.relations import project, table

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _dictionary_sql() -> str:
    kinds = {"doc_id": "integer", "n_chars": "integer"}
    return " UNION ALL ".join(
        f"SELECT '{c}' AS field, '{kinds.get(c, 'string')}' AS type, count(*) AS n, "
        f"count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, "
        f"CAST(min({c}) AS VARCHAR) AS lo, CAST(max({c}) AS VARCHAR) AS hi, "
        f"CASE WHEN '{c}' = 'lang' THEN 'language' END AS description, "
        f"coalesce((SELECT string_agg(val, ',' ORDER BY n DESC, val) FROM (SELECT CAST({c} AS VARCHAR) AS val, "
        f"count(*) AS n FROM documents WHERE {c} IS NOT NULL GROUP BY {c} "
        f"HAVING count(*) >= 0.05 * (SELECT count(*) FROM documents))), '') AS common_values FROM documents"
        for c in DOC_COLUMNS
    )


@query("data_dictionary", _dictionary_sql())
def data_dictionary_query(spark, sf):
    profile = data_dictionary(table(spark, sf, "documents"), descriptions={"lang": "language"})
    # texts are long and nearly unique: no common ones
    listed = F.array_join("common_values", ",").alias("common_values")
    return profile.select("field", "description", "type", "n", "n_null", "n_distinct", "lo", "hi", listed)


@query(
    "common_values",
    " UNION ALL ".join(
        f"SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS val, count(*) AS n FROM documents "
        f"WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) >= 0.05 * (SELECT count(*) FROM documents)"
        for c in DOC_COLUMNS
    ),
)
def common_values_query(spark, sf):
    return common_values(table(spark, sf, "documents"), min_share=0.05)


# -- reports -------------------------------------------------------------------


@query(
    "report_bind",
    "SELECT n.n_name, count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1",
)
def report_bind(spark, sf):
    made = project(spark, "report", {})
    made.store.commit_tables({n: table(spark, sf, n) for n in ("customer", "nation")})

    @made.reports.report("customers per nation", ["nation", "customer"])
    def per_nation(customer, nation):
        joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
        return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))

    return made.run_report("customers per nation")


@query(
    "report_registry",
    "SELECT r.r_name, count(*) AS n FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1",
)
def report_registry(spark, sf):
    registry = reports.ReportRegistry()

    @registry.report("nations per region", ["region", "nation"])
    def per_region(region, nation):
        joined = nation.join(region, nation.n_regionkey == region.r_regionkey)
        return joined.groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))

    return registry.run(
        "nations per region", ["nation", "region"], lambda name: table(spark, sf, name)
    )


@query(
    "report_series",
    "SELECT date_trunc('month', o_orderdate) AS date, o_orderstatus AS category, "
    "CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS value FROM orders GROUP BY 1, 2",
)
def report_series(spark, sf):
    orders = table(spark, sf, "orders").withColumn(
        "price", F.col("o_totalprice").cast("decimal(18,2)")
    )
    out = reports.series(orders, "o_orderdate", "o_orderstatus", "price", unit="month")
    return out.select(
        F.col("date").cast("timestamp_ntz").alias("date"),
        "category",
        F.col("value").cast("double").alias("value"),
    )


@query(
    "report_summary",
    "SELECT c_mktsegment, count(*) AS n, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1",
)
def report_summary(spark, sf):
    measures = {"lo": "min(c_acctbal)", "hi": "max(c_acctbal)"}
    return reports.summary(table(spark, sf, "customer"), ["c_mktsegment"], measures)


# -- chart data ----------------------------------------------------------------


@query("chart_line", "SELECT event_id AS x, value AS y FROM events")
def chart_line(spark, sf):
    return charts.line(table(spark, sf, "events"), "event_id", "value")


@query(
    "chart_histogram",
    "SELECT CAST(floor(p_size / 10.0) AS BIGINT) AS bin, count(*) AS n FROM part GROUP BY 1",
)
def chart_histogram(spark, sf):
    return charts.histogram(table(spark, sf, "part"), "p_size", width=10)


@query("chart_scatter", "SELECT p_size AS x, p_retailprice AS y FROM part")
def chart_scatter(spark, sf):
    return charts.scatter(table(spark, sf, "part"), "p_size", "p_retailprice")


@query(
    "chart_bar",
    "SELECT l_returnflag AS x, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS y FROM lineitem GROUP BY 1",
)
def chart_bar(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn(
        "quantity", F.col("l_quantity").cast("decimal(18,2)")
    )
    bars = charts.bar(lines, "l_returnflag", "quantity")
    return bars.select("x", F.col("y").cast("double").alias("y"))


@query(
    "chart_pie",
    "SELECT o_orderpriority AS name, count(*) AS value, "
    "CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM orders GROUP BY 1",
)
def chart_pie(spark, sf):
    orders = table(spark, sf, "orders").withColumn("one", F.lit(1))
    return charts.pie(orders, "one", "o_orderpriority")


@query(
    "chart_bubble",
    "SELECT s_nationkey AS x, count(*) AS y, max(s_acctbal) AS size FROM supplier GROUP BY 1",
)
def chart_bubble(spark, sf):
    per_nation = reports.summary(
        table(spark, sf, "supplier"), ["s_nationkey"], {"top": "max(s_acctbal)"}
    )
    return charts.bubble(per_nation, "s_nationkey", "n", "top")


@query(
    "chart_geo",
    "SELECT n.n_name AS location, max(s.s_acctbal) AS color, count(*) AS size FROM supplier s "
    "JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY 1",
)
def chart_geo(spark, sf):
    tables = {n: table(spark, sf, n) for n in ("supplier", "nation")}
    located = sql_query(
        spark,
        "SELECT n_name, max(s_acctbal) AS top, count(*) AS n FROM supplier "
        "JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name",
        tables,
    )
    return charts.geo_iso3(located, "n_name", "top", "n")


@query("chart_dispatch", "SELECT event_type AS x, count(*) AS y FROM events GROUP BY 1")
def chart_dispatch(spark, sf):
    events = table(spark, sf, "events").withColumn("one", F.lit(1))
    return charts.chart_data(events, "'bar(\"event_type\", \"one\")'")


# -- SQL -----------------------------------------------------------------------


def sql(key: str, text: str, *tables: str, oracle: str | None = None):
    """Register a query that is plain SQL on both sides."""

    def run(spark, sf):
        return sql_query(spark, text, {t: table(spark, sf, t) for t in tables})

    query(key, oracle or text)(run)


sql(
    "sql_select_where",
    "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_orderpriority LIKE '1%' "
    "AND o_totalprice BETWEEN 1000 AND 50000 AND o_orderstatus IN ('O', 'F') AND o_orderdate IS NOT NULL",
    "orders",
)
sql(
    "sql_double_quoted",
    'SELECT "c_custkey", "c_name" AS "Customer Name" FROM "customer" WHERE "c_mktsegment" = \'BUILDING\'',
    "customer",
)
sql(
    "sql_explanation",
    "SELECT explanation, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS n "
    "FROM (VALUES ('orders that are filled')) v(explanation)",
    "orders",
)


@query("sql_readonly_guard", "SELECT c_custkey, c_name FROM customer")
def sql_readonly_guard(spark, sf):
    """Statements that change data are refused; the SELECT after them works."""
    tables = {"customer": table(spark, sf, "customer")}
    for text in (
        "DROP VIEW customer",
        "INSERT INTO customer VALUES (1)",
        "SELECT 1; DROP VIEW customer",
        "SELECT 1) ; DROP VIEW customer --",
        "SELECT TRANSFORM(c_name) USING 'cat' AS (x) FROM customer",
        "SELECT reflect('java.lang.System', 'lineSeparator') FROM customer",
        f"SELECT * FROM parquet.`{sf}/customer.parquet`",
        "SELECT * FROM customer WHERE EXISTS (SELECT 1 FROM text.`/etc/hosts`)",
        "SELECT * FROM somebody_elses_view",
        "SELECT * FROM IDENTIFIER('text.`/etc/hostname`')",
        "SELECT * FROM IDENTIFIER('text.' || '`/etc/hostname`')",
        "SELECT IDENTIFIER('refl' || 'ect')('java.lang.System', 'getProperty', 'user.home') FROM customer",
    ):
        try:
            sql_query(spark, text, tables)
        except Exception:
            continue
        raise AssertionError(f"was run: {text}")
    return sql_query(spark, "```sql\nSELECT c_custkey, c_name FROM customer -- all;\n;\n```", tables)


sql(
    "sql_group_having",
    "SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, "
    "min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY o_custkey HAVING count(*) > 5",
    "orders",
)
sql(
    "sql_distinct",
    "SELECT event_type, count(DISTINCT user_id) AS users FROM (SELECT DISTINCT event_type, user_id FROM events) e "
    "GROUP BY event_type",
    "events",
)
sql(
    "sql_join_inner",
    "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey",
    "orders",
    "customer",
)
sql(
    "sql_join_outer",
    "SELECT c.c_custkey, o.o_orderkey FROM customer c FULL JOIN "
    "(SELECT * FROM orders WHERE o_orderstatus = 'F') o ON o.o_custkey = c.c_custkey",
    "orders",
    "customer",
)
sql(
    "sql_join_theta",
    "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c "
    "ON o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 50",
    "orders",
    "customer",
)
@query(
    "range_join",
    "SELECT o.o_orderkey, c.c_custkey FROM orders o JOIN customer c "
    "ON o.o_totalprice BETWEEN c.c_acctbal * 40 AND c.c_acctbal * 40 + 20",
)
def range_of_prices(spark, sf):
    """A join by a range alone: no key is equal."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    low = F.col("c_acctbal") * 40
    customers = table(spark, sf, "customer").select("c_custkey", low.alias("low"), (low + 20).alias("high"))
    met = range_join(orders, customers, ("o_totalprice", "o_totalprice"), ("low", "high"))
    return met.select("o_orderkey", "c_custkey")


sql(
    "sql_semi_anti",
    "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey "
    "AND o.o_orderstatus = 'F' AND o.o_orderpriority = '1-URGENT') "
    "AND c_custkey IN (SELECT o_custkey FROM orders)",
    "orders",
    "customer",
)
sql(
    "sql_window_rank",
    "SELECT o_orderkey, rank() OVER w AS rk, row_number() OVER w AS rn, dense_rank() OVER w AS dr, "
    "ntile(4) OVER w AS quarter FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)",
    "orders",
    oracle="SELECT o_orderkey, CAST(rank() OVER w AS INTEGER) AS rk, CAST(row_number() OVER w AS INTEGER) AS rn, "
    "CAST(dense_rank() OVER w AS INTEGER) AS dr, CAST(ntile(4) OVER w AS INTEGER) AS quarter FROM orders "
    "WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)",
)
sql(
    "sql_window_frame",
    "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id "
    "ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m3, "
    "lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous, "
    "lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following, "
    "first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS earliest FROM events",
    "events",
)
sql(
    "sql_topk",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5",
    "orders",
)
sql(
    "sql_set_ops",
    "SELECT k, src FROM (SELECT o_custkey AS k, 'both' AS src FROM orders WHERE o_orderstatus = 'F' "
    "INTERSECT SELECT o_custkey, 'both' FROM orders WHERE o_orderstatus = 'O') b "
    "UNION ALL (SELECT c_custkey, 'none' FROM customer EXCEPT SELECT o_custkey, 'none' FROM orders) "
    "UNION SELECT s_suppkey, 'supplier' FROM supplier",
    "orders",
    "customer",
    "supplier",
)
sql(
    "sql_cte",
    "WITH RECURSIVE q AS (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY c_mktsegment), "
    "steps AS (SELECT seg, n, 1 AS depth FROM q UNION ALL "
    "SELECT seg, n, depth + 1 FROM steps WHERE depth < 3) SELECT seg, n, depth FROM steps",
    "customer",
)
sql(
    "sql_subquery",
    "SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(x.o_totalprice) FROM orders x "
    "WHERE x.o_custkey = o.o_custkey) AND o_totalprice > (SELECT avg(o_totalprice) FROM orders)",
    "orders",
)
sql(
    "sql_grouping_sets",
    "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "orders",
)


@query(
    "sql_asof",
    "SELECT e.event_id, p.event_id AS last_purchase FROM e ASOF JOIN "
    "(SELECT user_id, ts, event_id FROM e WHERE event_type = 'purchase') p "
    "ON e.user_id = p.user_id AND e.ts >= p.ts",
    "WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 11 <> 0 THEN user_id END AS user_id, "
    "CASE WHEN event_id % 13 <> 0 THEN ts END AS ts FROM events)",
)
def sql_asof(spark, sf):
    """Some keys and times are missing, on both sides: they match nothing."""
    number = F.col("event_id")
    events = table(spark, sf, "events").select(
        "event_id",
        "event_type",
        F.when(number % 11 != 0, F.col("user_id")).alias("user_id"),
        F.when(number % 13 != 0, F.col("ts")).alias("ts"),
    )
    purchases = events.filter("event_type = 'purchase'")
    found = asof_join(events.drop("event_type"), purchases, "user_id", "ts", ["event_id"])
    return found.select("event_id", F.col("right_event_id").alias("last_purchase"))


sql(
    "sql_string",
    "SELECT c_custkey, upper(c_name) AS u, substr(c_mktsegment, 1, 3) AS s3, length(c_name) AS ln, "
    "replace(c_name, '#', '-') AS r, concat(trim(c_mktsegment), '/', lower(c_name)) AS c FROM customer",
    "customer",
    oracle="SELECT c_custkey, upper(c_name) AS u, substr(c_mktsegment, 1, 3) AS s3, "
    "CAST(length(c_name) AS INTEGER) AS ln, replace(c_name, '#', '-') AS r, "
    "concat(trim(c_mktsegment), '/', lower(c_name)) AS c FROM customer",
)
sql(
    "sql_string_agg",
    "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names, "
    "max(instr(n_name, '_')) AS at FROM nation GROUP BY n_regionkey",
    "nation",
    oracle="SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, "
    "CAST(max(instr(n_name, '_')) AS INTEGER) AS at FROM nation GROUP BY n_regionkey",
)
sql(
    "sql_date",
    "SELECT o_orderkey, extract(YEAR FROM o_orderdate) AS y, "
    "CAST(date_trunc('MONTH', o_orderdate) AS TIMESTAMP_NTZ) AS m, "
    "datediff(DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS days FROM orders",
    "orders",
    oracle="SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS INTEGER) AS y, "
    "CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, "
    "CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS INTEGER) AS days FROM orders",
)
sql(
    "sql_math",
    "SELECT p_partkey, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c, "
    "p_size % 7 AS r, abs(p_size - 25) AS d, sqrt(CAST(p_size AS DOUBLE)) AS q, "
    "power(CAST(p_size AS DOUBLE), 2) AS p, p_size div 3 AS third FROM part",
    "part",
    oracle="SELECT p_partkey, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c, "
    "p_size % 7 AS r, abs(p_size - 25) AS d, sqrt(CAST(p_size AS DOUBLE)) AS q, "
    "pow(CAST(p_size AS DOUBLE), 2) AS p, CAST(p_size // 3 AS BIGINT) AS third FROM part",
)
sql(
    "sql_conditional",
    "SELECT doc_id, CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END AS len, NULLIF(lang, 'en') AS other_lang, "
    "COALESCE(NULLIF(source, 'web'), lang) AS origin, CAST(n_chars AS DOUBLE) AS chars FROM documents",
    "documents",
)
sql(
    "sql_json",
    "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events",
    "events",
    oracle="SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
)
