"""Queries over staged batches: mapping, coercion, validation, review."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.cells import array_to_text, nan_to_null, parse_array
from millrace.operators import mapping as maps
from millrace.operators import review
from millrace.operators.coerce import clean_text, coerce_types, trim_text, typed
from millrace.operators.coerce import stored_form
from millrace.operators.mapping import FieldMap
from millrace.operators.pages import OrderIndex
from millrace.operators.validate import (
    error_log,
    error_summary,
    has_errors,
    validate,
    with_errors,
)
from millrace.plans.ingest import stage_table
from millrace.plans.registry import query
from millrace.plans.relations import (
    STAGED,
    STAGED_SQL,
    edits,
    project,
    raw,
    staged,
    table,
)
from millrace.schema import TableSchema

SCHEMA = TableSchema(STAGED)


def checked(spark, sf):
    return with_errors(staged(spark, sf), SCHEMA, clean=True)


def errors_of(spark, sf, keyword):
    found = validate(staged(spark, sf), SCHEMA)
    return found.filter(F.col("keyword") == keyword).select("Row", "path")


# -- mapping -------------------------------------------------------------------


@query(
    "map_rename", "SELECT c_custkey AS cust_id, c_name AS name, c_mktsegment AS segment FROM customer"
)
def map_rename(spark, sf):
    rules = {"cust_id": "c_custkey", "name": "c_name", "segment": "c_mktsegment"}
    return maps.apply_mapping(table(spark, sf, "customer"), rules)


@query(
    "map_values",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Filled' "
    "ELSE o_orderstatus END AS status, CASE o_orderstatus WHEN 'O' THEN 'Open' "
    "WHEN 'F' THEN 'Filled' END AS strict FROM orders",
)
def map_values(spark, sf):
    values = {"O": "Open", "F": "Filled"}
    return maps.apply_mapping(
        table(spark, sf, "orders"),
        {
            "o_orderkey": "o_orderkey",
            "status": FieldMap("o_orderstatus", values),
            "strict": FieldMap("o_orderstatus", values, keep_unmatched=False),
        },
    )


@query(
    "map_values_table",
    "SELECT c.c_custkey, n.n_name AS nation FROM customer c LEFT JOIN nation n "
    "ON c.c_nationkey = n.n_nationkey",
)
def map_values_table(spark, sf):
    """A dictionary too large for the plan, given as a table."""
    nations = table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("string").alias("value"), F.col("n_name").alias("replacement")
    )
    customers = table(spark, sf, "customer").select(
        "c_custkey", F.col("c_nationkey").cast("string").alias("nation")
    )
    return maps.map_values_table(customers, "nation", nations)


@query(
    "map_multi_table",
    "SELECT 'orders' AS target, count(*) AS n, sum(o_orderkey)::BIGINT AS checksum FROM orders "
    "UNION ALL SELECT 'people', count(*), sum(o_custkey)::BIGINT FROM orders "
    "UNION ALL SELECT 'people', count(*), sum(o_orderkey + 1)::BIGINT FROM orders",
)
def map_multi_table(spark, sf):
    """Two of three frames go to one target, and both are there."""
    mapper = maps.multi_table(
        [
            ("orders", {"key": "o_orderkey", "status": "o_orderstatus"}),
            ("people", {"key": "o_custkey"}),
            ("people", {"key": "next"}),
        ]
    )
    orders = table(spark, sf, "orders").withColumn("next", F.col("o_orderkey") + 1)
    parts = [
        df.agg(
            F.lit(target).alias("target"),
            F.count(F.lit(1)).alias("n"),
            F.sum("key").alias("checksum"),
        )
        for target, df in mapper(orders)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("map_project_only", "SELECT o_orderkey, o_totalprice FROM orders")
def map_project_only(spark, sf):
    rules = {"o_orderkey": "o_orderkey", "o_totalprice": "o_totalprice"}
    return maps.apply_mapping(table(spark, sf, "orders"), rules)


@query(
    "map_date_format",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_day, "
    "strftime(o_orderdate, '%Y-%m-%d') AS order_moment FROM orders",
)
def map_date_format(spark, sf):
    """Also with letters that stand for themselves, a T between date and time."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("moment"),
    )
    rules = {
        "o_orderkey": "o_orderkey",
        "order_day": FieldMap("day", date_format="%d/%m/%Y"),
        "order_moment": FieldMap("moment", date_format="%Y-%m-%dT%H:%M:%S"),
    }
    return maps.apply_mapping(orders, rules)


MAPPING_SQL = """WITH mapping AS (
  SELECT CASE WHEN l_linestatus = 'O' THEN NULL ELSE 'part_' || l_partkey END AS target_field,
         CASE WHEN l_returnflag = 'R' THEN l_linestatus ELSE '   ' END AS source_field
    FROM lineitem
)"""


def mapping_table(spark, sf):
    """A mapping table as large as the line items: which parts have a source."""
    return table(spark, sf, "lineitem").select(
        F.when(
            F.col("l_linestatus") != "O", F.concat(F.lit("part_"), F.col("l_partkey"))
        ).alias("target_field"),
        F.when(F.col("l_returnflag") == "R", F.col("l_linestatus"))
        .otherwise("   ")
        .alias("source_field"),
    )


@query(
    "mapping_clean",
    "SELECT target_field, NULLIF(trim(source_field), '') AS source_field FROM mapping "
    "WHERE target_field IS NOT NULL",
    MAPPING_SQL,
)
def mapping_clean(spark, sf):
    return maps.mapping_clean(mapping_table(spark, sf))


@query(
    "unmapped_fields",
    "SELECT 'part_' || p_partkey AS target_field, 'source_field' AS path, 'part_' || p_partkey || ' has not been mapped' AS message "
    "FROM part WHERE 'part_' || p_partkey NOT IN (SELECT target_field FROM mapping "
    "WHERE target_field IS NOT NULL AND trim(source_field) <> '')",
    MAPPING_SQL,
)
def unmapped_fields(spark, sf):
    fields = table(spark, sf, "part").select(
        F.concat(F.lit("part_"), F.col("p_partkey")).alias("field")
    )
    return maps.unmapped_fields(fields, mapping_table(spark, sf))


@query(
    "description_gate",
    "SELECT doc_id AS field, source AS description FROM documents",
)
def description_gate(spark, sf):
    dictionary = table(spark, sf, "documents").select(
        F.col("doc_id").alias("field"), F.col("source").alias("description")
    )
    return maps.require_descriptions(dictionary)


@query(
    "mapping_from_table",
    "SELECT c_custkey AS cust_id, c_name AS name, "
    "CASE c_mktsegment WHEN 'BUILDING' THEN 'Bau' ELSE c_mktsegment END AS segment FROM customer",
)
def mapping_from_table(spark, sf):
    made = project(spark, "mapping", {})
    rules = {
        "cust_id": "c_custkey",
        "name": "c_name",
        "segment": FieldMap("c_mktsegment", {"BUILDING": "Bau"}),
        "unused": "   ",
    }
    made.save_mapping("customers", {"cust_id": "c_nationkey"})
    made.save_mapping("customers", rules)  # a later edition replaces the first
    return made.run_mapper("customers", table(spark, sf, "customer"))["table"]


@query(
    "mapper_registry",
    "SELECT c_custkey AS cust_id, c_mktsegment AS segment FROM customer WHERE c_acctbal >= 0",
)
def mapper_registry(spark, sf):
    made = project(spark, "mappers", {})

    @made.mapper("solvent")
    def solvent(df):
        rules = {"cust_id": "c_custkey", "segment": "c_mktsegment"}
        return [{"table": "solvent", "data": maps.apply_mapping(df.filter("c_acctbal >= 0"), rules)}]

    return made.run_mapper("solvent", table(spark, sf, "customer"))["solvent"]


# -- coercion ------------------------------------------------------------------


@query("coerce_types", 'SELECT "Row", id, nation, bal, flag FROM typed', STAGED_SQL)
def coerce_types_query(spark, sf):
    names = ["id", "nation", "bal", "flag"]
    df = coerce_types(staged(spark, sf), SCHEMA)
    return df.select("Row", *[typed(c).alias(c) for c in names])


@query("coerce_trim", 'SELECT "Row", trim(id) AS id FROM raw', STAGED_SQL)
def coerce_trim(spark, sf):
    return trim_text(raw(spark, sf)).select("Row", "id")


@query("coerce_number", 'SELECT "Row", bal, bal IS NULL AS kept_as_text FROM typed', STAGED_SQL)
def coerce_number(spark, sf):
    df = coerce_types(raw(spark, sf), SCHEMA)
    kept = F.col("bal").isNotNull() & typed("bal").isNull()
    return df.select("Row", typed("bal").alias("bal"), kept.alias("kept_as_text"))


@query("coerce_integer", 'SELECT "Row", id FROM typed', STAGED_SQL)
def coerce_integer(spark, sf):
    return coerce_types(raw(spark, sf), SCHEMA).select("Row", typed("id").alias("id"))


@query("coerce_boolean", 'SELECT "Row", flag FROM typed', STAGED_SQL)
def coerce_boolean(spark, sf):
    return coerce_types(raw(spark, sf), SCHEMA).select("Row", typed("flag").alias("flag"))


@query("coerce_null", "SELECT \"Row\", NULLIF(flag, '') AS flag, trim(id) AS id FROM raw", STAGED_SQL)
def coerce_null(spark, sf):
    """Empty text is null only where the schema allows null."""
    return clean_text(raw(spark, sf), SCHEMA).select("Row", "flag", "id")


@query(
    "parse_array",
    "SELECT \"Row\", CASE WHEN tags LIKE '[%]' OR tags LIKE '%,%' "
    "THEN CAST(len(string_split(tags, ',')) AS INTEGER) END AS n_tags FROM raw",
    STAGED_SQL,
)
def parse_array_query(spark, sf):
    tags = parse_array(F.col("tags"))
    return raw(spark, sf).select("Row", F.when(tags.isNotNull(), F.size(tags)).alias("n_tags"))


@query(
    "remove_quotes",
    "SELECT \"Row\", trim(unnest(string_split(replace(replace(replace(replace(tags, '[', ''), ']', ''), "
    "'\"', ''), '''', ''), ','))) AS tag FROM raw",
    STAGED_SQL,
)
def remove_quotes(spark, sf):
    tags = F.coalesce(parse_array(F.col("tags")), F.array("tags"))
    return raw(spark, sf).select("Row", F.explode(tags).alias("tag"))


@query(
    "array_to_text",
    "SELECT \"Row\", CASE \"Row\" % 3 WHEN 1 THEN '[a, b, c]' WHEN 2 THEN '[a, b]' ELSE 'a' END AS tags FROM raw",
    STAGED_SQL,
)
def array_to_text_query(spark, sf):
    text = array_to_text(parse_array(F.col("tags")))
    return raw(spark, sf).select("Row", F.coalesce(text, F.col("tags")).alias("tags"))


@query(
    "nan_to_null",
    "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events",
)
def nan_to_null_query(spark, sf):
    broken = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    events = table(spark, sf, "events").select("event_id", broken.alias("value"))
    return nan_to_null(events)


# -- validation ----------------------------------------------------------------


@query("val_type", "SELECT \"Row\", path FROM errors WHERE keyword = 'type'", STAGED_SQL)
def val_type(spark, sf):
    return errors_of(spark, sf, "type")


@query("val_enum", "SELECT \"Row\", path FROM errors WHERE keyword = 'enum'", STAGED_SQL)
def val_enum(spark, sf):
    return errors_of(spark, sf, "enum")


@query("val_range", "SELECT \"Row\", path FROM errors WHERE keyword = 'minimum'", STAGED_SQL)
def val_range(spark, sf):
    return errors_of(spark, sf, "minimum")


@query(
    "val_string",
    "SELECT p_partkey, 'maxLength' AS keyword FROM part WHERE length(p_brand) > 7 "
    "UNION ALL SELECT p_partkey, 'pattern' FROM part WHERE NOT regexp_matches(p_brand, '[1-5]$')",
)
def val_string(spark, sf):
    spec = {"type": "string", "maxLength": 7, "pattern": "[1-5]$"}
    schema = TableSchema({"properties": {"p_brand": spec}})
    parts = table(spark, sf, "part").select("p_partkey", "p_brand")
    return validate(parts, schema, row="p_partkey").select("p_partkey", "keyword")


@query(
    "val_array",
    "SELECT \"Row\", 'tags' AS path, 'minItems' AS keyword FROM raw WHERE tags = 'a, b' "
    "UNION ALL SELECT \"Row\", 'tags', 'enum' FROM raw WHERE tags LIKE '[%]' "
    "UNION ALL SELECT \"Row\", 'twins', k FROM raw, (VALUES ('uniqueItems'), ('maxItems'), ('contains')) v(k) "
    "WHERE segment = 'BUILDING' "
    "UNION ALL SELECT \"Row\", 'sums', 'uniqueItems' FROM raw WHERE segment = 'BUILDING'",
    STAGED_SQL,
)
def val_array(spark, sf):
    """Items of one building are equal though quoted or spelled differently."""
    properties = {
        "tags": {"type": ["array", "string"], "minItems": 3, "items": {"enum": ["a", "b"]}},
        "twins": {"type": "array", "uniqueItems": True, "maxItems": 2, "contains": {"const": "z"}},
        "sums": {"type": "array", "uniqueItems": True, "items": {"type": "number"}},
    }
    building = F.col("segment") == "BUILDING"
    batch = staged(spark, sf).select(
        "Row",
        "tags",
        F.when(building, "[a, 'a', b]").otherwise("[z, 'y']").alias("twins"),
        F.when(building, "[1, 1.0]").otherwise("[1, 2]").alias("sums"),
    )
    return validate(batch, TableSchema({"properties": properties})).select("Row", "path", "keyword")


@query("val_required", "SELECT \"Row\", '''email'' is a required property' AS message FROM raw", STAGED_SQL)
def val_required(spark, sf):
    document = {**STAGED, "required": ["id", "email"]}
    found = validate(staged(spark, sf), TableSchema(document))
    return found.filter(F.col("keyword") == "required").select("Row", "message")


@query("val_additional", 'SELECT c_custkey + 1 AS "Row", \'additionalProperties\' AS keyword FROM customer')
def val_additional(spark, sf):
    schema = TableSchema({"properties": {"c_custkey": {}}, "additionalProperties": False})
    customers = table(spark, sf, "customer").select(
        (F.col("c_custkey") + 1).alias("Row"), "c_custkey", "c_name"
    )
    return validate(customers, schema).select("Row", "keyword")


@query(
    "val_combinators",
    "SELECT o_orderkey, 'minimum' AS keyword FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 100000 "
    "UNION ALL SELECT o_orderkey, 'not' FROM orders WHERE o_orderpriority = '5-LOW' "
    "UNION ALL SELECT o_orderkey, 'oneOf' FROM orders WHERE (o_orderstatus = 'O') = (o_totalprice > 200000)",
)
def val_combinators(spark, sf):
    schema = TableSchema(
        {
            "properties": {
                "o_orderstatus": {"type": "string"},
                "o_totalprice": {"type": "number"},
                "o_orderpriority": {"not": {"const": "5-LOW"}},
            },
            "if": {"properties": {"o_orderstatus": {"const": "F"}}},
            "then": {"properties": {"o_totalprice": {"minimum": 100000}}},
            "oneOf": [
                {"properties": {"o_orderstatus": {"const": "O"}}},
                {"properties": {"o_totalprice": {"exclusiveMinimum": 200000}}},
            ],
        }
    )
    orders = table(spark, sf, "orders").drop("o_custkey", "o_orderdate")
    return validate(orders, schema, row="o_orderkey").select("o_orderkey", "keyword")


@query(
    "val_format_ignored",
    "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_errors, count(*) AS n_asserted FROM orders",
)
def val_format_ignored(spark, sf):
    spec = {"type": "string", "format": "date"}
    schema = TableSchema({"properties": {"day": spec}})
    orders = table(spark, sf, "orders").select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"))
    plain = with_errors(orders, schema).select("day", has_errors().alias("fails"))
    asserted = with_errors(plain, schema, assert_format=True)
    return asserted.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("fails").alias("n_errors"),
        F.count_if(has_errors()).alias("n_asserted"),
    )


@query(
    "val_strict_relaxed",
    "SELECT \"Row\", path, CASE WHEN keyword = 'enum' THEN 'warning' ELSE 'error' END AS severity "
    "FROM errors WHERE path IN ('id', 'segment') "
    "UNION ALL SELECT \"Row\", path, 'warning' FROM errors WHERE path = 'id'",
    STAGED_SQL,
)
def val_strict_relaxed(spark, sf):
    fields = {k: STAGED["properties"][k] for k in ("id", "segment")}
    strict = TableSchema({"properties": fields})
    relaxed = TableSchema({"properties": {**fields, "segment": {"type": "string"}}})
    found = validate(staged(spark, sf).select("Row", "id", "segment"), strict, relaxed)
    return found.select("Row", "path", "severity")


@query("error_paths", "SELECT DISTINCT path, keyword FROM errors", STAGED_SQL)
def error_paths(spark, sf):
    return validate(staged(spark, sf), SCHEMA).select("path", "keyword").distinct()


@query(
    "error_log",
    "SELECT \"Row\", 'Row ' || CAST(\"Row\" AS VARCHAR) || ' - ' || string_agg('''' || path || ''': ' || message, "
    "'; ' ORDER BY pos) AS line FROM ("
    "SELECT e.*, CASE path WHEN 'id' THEN 1 WHEN 'nation' THEN 2 WHEN 'bal' THEN 3 WHEN 'segment' THEN 4 "
    "WHEN 'flag' THEN 5 ELSE 6 END AS pos, CASE path "
    "WHEN 'id' THEN 'None is not of type ''integer''' "
    "WHEN 'nation' THEN '-3 is less than the minimum of 0' "
    "WHEN 'bal' THEN '''' || r.bal || ''' is not of type ''number''' "
    "WHEN 'segment' THEN '''RETAIL'' is not one of [''AUTOMOBILE'', ''BUILDING'', ''FURNITURE'', ''HOUSEHOLD'', ''MACHINERY'']' "
    "WHEN 'flag' THEN '''yes'' is not of type ''boolean'', ''null''' "
    "ELSE '''a'' is not of type ''array'', ''null''' END AS message "
    'FROM errors e JOIN raw r USING ("Row")) GROUP BY "Row"',
    STAGED_SQL,
)
def error_log_query(spark, sf):
    return error_log(checked(spark, sf))


@query("error_summary", "SELECT path, keyword, count(*) AS n FROM errors GROUP BY 1, 2", STAGED_SQL)
def error_summary_query(spark, sf):
    return error_summary(checked(spark, sf))


# -- review --------------------------------------------------------------------


@query(
    "only_error_rows",
    'SELECT "Row", segment FROM raw WHERE "Row" IN (SELECT "Row" FROM errors)',
    STAGED_SQL,
)
def only_error_rows(spark, sf):
    return review.only_error_rows(checked(spark, sf)).select("Row", "segment")


@query(
    "reject_empty_ids",
    "SELECT c_custkey, (c_custkey IS NULL OR c_custkey = 0) AS _delete FROM customer",
)
def reject_empty_ids(spark, sf):
    marked = review.reject_empty_ids(table(spark, sf, "customer"), "c_custkey")
    return marked.select("c_custkey", "_delete")


@query(
    "reject_error_rows",
    'SELECT "Row", "Row" IN (SELECT "Row" FROM errors) AS _delete FROM raw',
    STAGED_SQL,
)
def reject_error_rows(spark, sf):
    return review.reject_error_rows(checked(spark, sf)).select("Row", "_delete")


@query("restore_rows", 'SELECT "Row", false AS _delete FROM raw', STAGED_SQL)
def restore_rows(spark, sf):
    marked = review.reject_error_rows(checked(spark, sf))
    return review.restore_rows(marked).select("Row", "_delete")


@query(
    "toggle_row",
    'SELECT "Row", ("Row" IN (SELECT "Row" FROM errors)) <> ("Row" IN (SELECT "Row" FROM edits)) AS _delete FROM raw',
    STAGED_SQL,
)
def toggle_row(spark, sf):
    marked = review.reject_error_rows(checked(spark, sf))
    return review.toggle_rows(marked, edits(spark, sf)).select("Row", "_delete")


@query(
    "review_stats",
    "SELECT count(*) AS total, count(*) FILTER (WHERE segment = 'RETAIL') AS showing, "
    'count(*) FILTER (WHERE segment = \'RETAIL\' AND "Row" IN (SELECT "Row" FROM errors)) AS deleted FROM raw',
    STAGED_SQL,
)
def review_stats(spark, sf):
    marked = review.reject_error_rows(checked(spark, sf))
    return review.review_stats(marked, F.col("segment") == "RETAIL")


@query(
    "overlay_edits",
    'SELECT r."Row", CASE WHEN e."Row" IS NULL THEN r.segment ELSE e.segment END AS segment '
    'FROM raw r LEFT JOIN edits e ON r."Row" = e."Row"',
    STAGED_SQL,
)
def overlay_edits(spark, sf):
    return review.overlay_edits(staged(spark, sf), edits(spark, sf)).select("Row", "segment")


@query(
    "cell_diff",
    "SELECT e.\"Row\", 'segment' AS col, r.segment AS original, e.segment AS edited FROM edits e "
    'JOIN raw r ON r."Row" = e."Row" WHERE e.segment IS DISTINCT FROM r.segment',
    STAGED_SQL,
)
def cell_diff(spark, sf):
    return review.cell_diff(staged(spark, sf), edits(spark, sf))


@query("page_slice", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 75")
def page_slice(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    return review.page_slice(orders, page=3, size=25, order_by="o_orderkey")


@query(
    "page_by_index",
    "SELECT l_shipdate, l_orderkey, l_linenumber FROM lineitem "
    "ORDER BY l_shipdate, l_orderkey, l_linenumber LIMIT 100 OFFSET 2000",
)
def page_by_index(spark, sf):
    """A deep page on a column with ties, from the files that hold it."""
    items = table(spark, sf, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber")
    return OrderIndex.build(items, "l_shipdate").page(20, 100)


@query("page_of_rows", 'SELECT "Row", id, segment FROM raw WHERE "Row" > 40 AND "Row" <= 80', STAGED_SQL)
def page_of_rows(spark, sf):
    """A page of a staged batch by its row numbers, as a range on the stored place."""
    batch = raw(spark, sf).select("Row", "id", "segment")
    return OrderIndex.build(batch, "Row").page(1, 40)


@query(
    "commit_reviewed",
    'SELECT id, nation, bal, segment, flag, CASE "Row" % 3 WHEN 1 THEN \'[a, b, c]\' ELSE \'[a, b]\' END AS tags '
    'FROM typed WHERE "Row" NOT IN (SELECT "Row" FROM errors)',
    STAGED_SQL,
)
def commit_reviewed(spark, sf):
    """The whole flow: clean, validate, number, reject bad rows, commit."""
    made = project(spark, "reviewed", {"batch": STAGED})
    batch = stage_table(made, "batch", staged(spark, sf).drop("Row"))
    good = review.reject_error_rows(batch.rows)
    review.commit_reviewed(made.store, {"batch": good})
    return made.store.read_table("batch")


@query(
    "stored_form",
    'SELECT "Row", CASE "Row" % 3 WHEN 1 THEN \'[a, b, c]\' WHEN 2 THEN \'[a, b]\' ELSE \'a\' END AS tags FROM raw',
    STAGED_SQL,
)
def stored_form_query(spark, sf):
    return stored_form(staged(spark, sf), SCHEMA).select("Row", "tags")
