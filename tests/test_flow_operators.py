"""Mapping, review, staging, profile, chart, report, SQL and as-of operators."""

import random
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from millrace import Project, TableSchema
from millrace.operators import charts, mapping, review
from millrace.operators.asof import asof_join
from millrace.operators.pages import OrderIndex
from millrace.operators.profile import common_values, data_dictionary
from millrace.operators.reports import MissingDataset, ReportRegistry
from millrace.operators.shape import cast_to, conform, pad_missing, schema_order
from millrace.operators.review import page_slice
from millrace.operators.sql import QueryRefused, sql_query
from millrace.operators.staging import stage

# -- shaping -------------------------------------------------------------------


def test_schema_order(spark):
    schema = TableSchema({"properties": {"ward": {}, "beds": {}, "floor": {}}})
    df = spark.createDataFrame([(1, 2, 3)], "floor int, ward int, beds int")
    assert schema_order(df, schema).columns == ["ward", "beds", "floor"]
    assert schema_order(df, None).columns == df.columns
    wide = df.select("*", F.lit(1).alias("Row"), F.lit(1).alias("x"), F.lit(1).alias("last"))
    ordered = schema_order(wide, schema, prepend=["Row"], append=["last"])
    assert ordered.columns == ["Row", "ward", "beds", "floor", "x", "last"]


def test_stored_types():
    kinds = {
        "a": {"type": "string"},
        "b": {"type": ["null", "integer"]},
        "c": {"type": "number"},
        "d": {"type": "boolean"},
        "e": {"type": "array"},
        "f": {"type": "object"},
        "g": {"enum": [1]},
        "h": {"type": "string", "format": "date"},
        "i": {"type": ["integer", "string"]},
    }
    text = TableSchema({"properties": kinds}).struct()
    assert [f.dataType.simpleString() for f in text.fields] == [
        "string", "bigint", "double", "boolean", "string", "string", "string", "string", "string",
    ]
    typed = TableSchema({"properties": kinds}, storage="typed")
    assert typed.spark_type("e").simpleString() == "array<string>"
    assert typed.spark_type("h").simpleString() == "date"


@pytest.mark.parametrize(
    ("spec", "expected"),
    [
        ({"type": "string"}, False),
        ({"type": "string", "nullable": True}, True),
        ({"type": ["string", "null"]}, True),
        ({"type": ["string", None]}, True),
        ({"enum": ["a", None]}, True),
        ({"enum": ["a", "null"]}, True),
        ({}, False),
    ],
)
def test_nullable(spec, expected):
    assert TableSchema({"properties": {"x": spec}}).nullable("x") is expected


def test_pad_and_conform(spark):
    schema = TableSchema({"properties": {"a": {"type": "integer"}, "b": {"type": "number"}}})
    df = spark.createDataFrame([("1", "x")], "a string, z string")
    assert pad_missing(df, schema.struct()).dtypes[-1] == ("b", "double")
    assert rows(conform(df, schema)) == [(1, None)]
    assert conform(df, schema, extra="keep").columns == ["a", "b", "z"]
    with pytest.raises(ValueError):
        conform(df, schema, extra="other")
    with pytest.raises(ValueError):
        cast_to(df, schema.struct(), on_error="other")


# -- mapping -------------------------------------------------------------------


def test_values_without_a_match(spark):
    df = spark.createDataFrame([("M",), ("x",), (None,)], "s string")
    kept = mapping.map_values(F.col("s"), {"M": "Male"})
    strict = mapping.map_values(F.col("s"), {"M": "Male"}, keep_unmatched=False)
    assert [tuple(r) for r in df.select(kept, strict).collect()] == [
        ("Male", "Male"),
        ("x", None),
        (None, None),
    ]


def test_dictionary_table_never_multiplies_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, s string")
    words = spark.createDataFrame([("a", "A"), ("a", "Z")], "value string, replacement string")
    assert rows(mapping.map_values_table(df, "s", words)) == [(1, "A"), (2, "b"), (3, None)]
    strict = mapping.map_values_table(df, "s", words, keep_unmatched=False)
    assert rows(strict) == [(1, "A"), (2, None), (3, None)]


def test_dates(spark):
    df = spark.createDataFrame([("31/12/2023",), ("2023",), (None,)], "d string")
    out = df.select(mapping.map_dates(F.col("d"), "%d/%m/%Y")).collect()
    assert [r[0] for r in out] == ["2023-12-31", None, None]


def test_mapper_results(spark):
    df = spark.range(1)
    assert mapping.as_tables(df, "t") == [("t", df)]
    assert mapping.as_tables({"a": df}) == [("a", df)]
    assert mapping.as_tables({"table": "a", "data": df}) == [("a", df)]
    twice = mapping.as_tables([("a", df), ("a", df), ("b", df)])
    assert len(twice) == 3 and twice["b"] is df
    with pytest.raises(KeyError):
        twice["a"]
    pairs = mapping.as_tables([{"table": "a", "data": df}, {"database": "b", "data": df}])
    assert pairs == [("a", df), ("b", df)]


def test_descriptions_are_required(spark):
    good = spark.createDataFrame([("a", "text")], "field string, description string")
    assert mapping.require_descriptions(good) is good
    for blank in (None, "  "):
        bad = spark.createDataFrame([("a", blank)], "field string, description string")
        with pytest.raises(ValueError, match="description"):
            mapping.require_descriptions(bad)


def test_stored_mapping(spark, tmp_path):
    project = Project(spark, str(tmp_path))
    project.save_mapping("m", {"x": mapping.FieldMap("a", {"1": "one"}), "y": " "})
    df = spark.createDataFrame([("1", "z")], "a string, b string")
    assert rows(project.run_mapper("m", df)["table"]) == [("one",)]
    assert project.mappers() == ["m"]
    with pytest.raises(KeyError):
        project.run_mapper("other", df)
    project.save_mapping("m", {"x": "b"})  # a later edition
    assert rows(project.run_mapper("m", df)["table"]) == [("z",)]
    with pytest.raises(ValueError, match="%Q"):
        project.save_mapping("m", {"x": mapping.FieldMap("a", date_format="%Y %Q")})
    assert rows(project.run_mapper("m", df)["table"]) == [("z",)]


def test_date_formats_quote_letters(spark):
    assert mapping.spark_date_format("%Y-%m-%dT%H:%M:%S") == "yyyy-MM-dd'T'HH:mm:ss"
    assert mapping.spark_date_format("%d of '%y' %%") == "dd 'of' ''yy'' %"
    assert mapping.spark_date_format("dd/MM/yyyy") == "dd/MM/yyyy"
    df = spark.createDataFrame([("2024-03-05T01:02:03", 1), ("March", 2)], "a string, n int")
    rules = {"d": mapping.FieldMap("a", date_format="%FT%T"), "n": mapping.FieldMap("n", {"1": "one"})}
    assert rows(mapping.apply_mapping(df, rules)) == [("2024-03-05", "one"), (None, "2")]


# -- staging and review --------------------------------------------------------


def test_row_numbers_follow_the_order_even_with_one_dominant_value(spark):
    data = [(i, 7 if i % 3 else i) for i in range(3000)]
    df = spark.createDataFrame(data, "id int, v int").repartition(7)
    out = stage(df, order_by=["v"]).collect()
    assert sorted(r.Row for r in out) == list(range(1, 3001))
    values = [r.v for r in sorted(out, key=lambda r: r.Row)]
    assert values == sorted(values)
    assert {r._delete for r in out} == {False}


def test_row_numbers_in_input_order(spark):
    out = stage(spark.range(1000, numPartitions=5)).collect()
    assert all(r.Row == r.id + 1 for r in out)


def test_marks(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "0"), (4, "a")], "Row long, k string")
    marked = review.reject_empty_ids(df, "k")
    assert rows(marked, "Row", "_delete") == [(1, True), (2, True), (3, False), (4, False)]
    ids = spark.createDataFrame([(1,), (4,), (4,)], "Row long")
    toggled = review.toggle_rows(marked, ids)
    assert rows(toggled, "Row", "_delete") == [(1, False), (2, True), (3, False), (4, True)]
    assert rows(review.restore_rows(toggled).filter("_delete")) == []
    assert rows(review.review_stats(toggled, F.col("Row") > 2)) == [(4, 2, 1)]
    numbers = spark.createDataFrame([(0,), (1,)], "k int")
    assert rows(review.reject_empty_ids(numbers, "k"), "_delete") == [(False,), (True,)]
    kept = review.reject_empty_ids(numbers, "k", zero_is_empty=False)
    assert rows(kept, "_delete") == [(False,), (False,)]


def test_last_edit_of_a_row_counts(spark):
    base = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "Row long, x string, y string")
    edits = spark.createDataFrame([(1, "p", 1), (1, None, 2)], "Row long, x string, at int")
    out = review.overlay_edits(base, edits, order_by="at")
    assert rows(out) == [(1, None, "b"), (2, "c", "d")]


def test_pages(spark):
    df = spark.range(100).select((F.col("id") + 1).alias("Row"), (-F.col("id")).alias("k"))
    assert rows(review.page_slice(df, 2, 10), "Row") == [(i,) for i in range(21, 31)]
    assert [r.k for r in review.page_slice(df, 1, 3, "k").collect()] == [-96, -95, -94]
    with pytest.raises(ValueError):
        review.page_slice(df, -1, 10)


# -- profile -------------------------------------------------------------------


def test_dictionary(spark):
    long = "y" * 200
    data = [
        (1, "1", "true", long, None),
        (2, "2.5", "FALSE", long, None),
        (3, None, "true", "z" * 200, None),
        (3, "3", "true", "short", None),
    ]
    df = spark.createDataFrame(data, "a int, b string, c string, d string, e string")
    out = {r.field: r for r in data_dictionary(df, min_share=0.5, descriptions={"a": "A"}).collect()}
    assert [out[c].type for c in "abcde"] == ["integer", "number", "boolean", "string", "null"]
    assert [out[c].n_null for c in "abcde"] == [0, 1, 0, 0, 4]
    assert [out[c].n_distinct for c in "abcde"] == [3, 3, 2, 3, 0]
    assert [out[c].common_values for c in "abcde"] == [["3"], [], ["true"], [long], []]
    assert (out["a"].description, out["b"].description) == ("A", None)
    assert (out["a"].lo, out["a"].hi, out["e"].lo) == ("1", "3", None)


def test_frequent_values_are_found_without_counting_all(spark, monkeypatch):
    from millrace.operators import profile

    rng = random.Random(2)
    long = "a text of more than forty-eight bytes, found in many of the rows "
    data = []
    for i in range(4000):
        a = rng.choice(["hot"] * 6 + [None, f"v{i}", f"v{rng.randrange(19)}", str(rng.randrange(9))])
        data.append((i, a, long + str(rng.randrange(25) if i % 2 else i), rng.choice([0.5, float(i)]), [i % 3, 1]))
    df = spark.createDataFrame(data, "id long, `a b` string, t string, d double, l array<long>").repartition(7)
    texts = {
        "id": [str(r[0]) for r in data], "a b": [r[1] for r in data], "t": [r[2] for r in data],
        "d": [str(r[3]) for r in data], "l": [f"[{r[4][0]},1]" for r in data],
    }
    monkeypatch.setattr(profile, "value_counts", lambda *a: 1 / 0)
    for share in (0.05, 0.01, 0.3):
        wanted = {(f, v, n) for f, vs in texts.items() for v, n in Counter(vs).items() if v is not None and n >= share * 4000}
        assert set(map(tuple, common_values(df, min_share=share).collect())) == wanted and len(wanted) > 2
    assert common_values(df.limit(0)).count() == 0
    monkeypatch.undo()
    assert common_values(df, ["a b"], min_share=1e-7).count() == len(set(texts["a b"])) - 1  # every value


def test_common_values_are_limited_per_column(spark):
    df = spark.createDataFrame([(v,) for v in "aabbbcd"], "x string")
    found = common_values(df, min_share=0.0, k=3)
    assert rows(found) == [("x", "a", 2), ("x", "b", 3), ("x", "c", 1)]


# -- charts and reports ----------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ('bar("a", "b")', ("bar", ["a", "b"])),
        ("'line(a, b)'", ("line", ["a", "b"])),
        ('"histogram(\'Case ID\')"', ("histogram", ["Case ID"])),
        ('bar("Recovery days (n)", "a, b")', ("bar", ["Recovery days (n)", "a, b"])),
        ("pie('it (x)', b)", ("pie", ["it (x)", "b"])),
        ("none", ("none", [])),
        ("none()", ("none", [])),
        (None, ("none", [])),
        ("", ("none", [])),
    ],
)
def test_chart_specs(text, expected):
    assert charts.parse_chart(text) == expected


def test_chart_data(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 3, 4), ("b", 4, 1)], "k string, v int, w int")
    assert rows(charts.chart_data(df, "bar(k, v)")) == [("a", 4), ("b", 4)]
    assert rows(charts.chart_data(df, "pie(v, k)")) == [("a", 4, 0.5), ("b", 4, 0.5)]
    assert rows(charts.chart_data(df, "histogram(v)", width=2)) == [(0, 1), (1, 1), (2, 1)]
    assert rows(charts.chart_data(df, "histogram(k)")) == [("a", 2), ("b", 1)]
    assert charts.chart_data(df, "bubble(k, v, w)").columns == ["x", "y", "size"]
    assert charts.chart_data(df, "geo_iso3(k, v, w)").columns == ["location", "color", "size"]
    assert charts.chart_data(df, "radar(k)") is None
    assert charts.chart_data(df, None) is None
    with pytest.raises(ValueError, match="2 columns"):
        charts.chart_data(df, "line(k)")


def test_reports_bind_by_name(spark):
    registry = ReportRegistry()

    @registry.report("r", ["b", "a"])
    def report(a, b):
        return a.select("x").union(b.select("x"))

    frames = {"a": spark.createDataFrame([(1,)], "x int"), "b": spark.createDataFrame([(2,)], "x int")}
    out = registry.run("r", ["a", "b", "c"], frames.get)
    assert [r.x for r in out.collect()] == [1, 2]
    with pytest.raises(MissingDataset, match="available"):
        registry.run("r", ["a"], frames.get)
    with pytest.raises(KeyError):
        registry.run("other", [], frames.get)


# -- SQL -------------------------------------------------------------------------


def test_sql_reads_quoted_names_and_leaves_the_session_alone(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "`Case ID` int, s string")
    before = spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers")
    out = sql_query(spark, 'SELECT "Case ID" FROM t WHERE s = \'b\' -- done\n;', {"t": df})
    assert rows(out) == [(2,)]
    assert spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers") == before
    assert rows(sql_query(spark, "SELECT * FROM (VALUES ('no such data'))")) == [("no such data",)]


@pytest.mark.parametrize(
    "text",
    ["DROP VIEW t", "INSERT INTO t VALUES (1)", "SELECT 1; DROP VIEW t", "SELECT 1) ; DROP VIEW t --"],
)
def test_sql_only_reads(spark, text):
    with pytest.raises(Exception, match="PARSE_SYNTAX_ERROR|Syntax error"):
        sql_query(spark, text, {"t": spark.range(1)})


@pytest.mark.parametrize(
    "text",
    [
        "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM t",
        "SELECT reflect('java.lang.Math', 'random') FROM t",
        "SELECT id FROM t WHERE EXISTS (SELECT java_method('java.lang.Math', 'random'))",
        "SELECT * FROM text.`/etc/hosts`",
        "SELECT (SELECT max(value) FROM text.`/etc/hosts`) FROM t",
        "WITH w AS (SELECT * FROM theirs) SELECT * FROM w",
        "SELECT * FROM theirs",
        "SELECT 1 WHERE 1 IN (SELECT id FROM theirs)",
        "SELECT * FROM IDENTIFIER('text.`/etc/hostname`')",
        "SELECT * FROM IDENTIFIER('text.' || '`/etc/hostname`')",
        "SELECT IDENTIFIER('refl' || 'ect')('java.lang.System', 'getProperty', 'user.home')",
        "SELECT id FROM t WHERE id IN (SELECT IDENTIFIER('id') FROM IDENTIFIER('theirs'))",
    ],
)
def test_sql_reaches_nothing_but_its_tables(spark, text):
    spark.range(5).createOrReplaceTempView("theirs")
    with pytest.raises(QueryRefused):
        sql_query(spark, text, {"t": spark.range(1)})


def test_sql_is_checked_again_once_names_are_known(spark, monkeypatch):
    from millrace.operators import sql

    monkeypatch.setattr(sql, "_check", lambda *a: None)  # as if a spelling got past the parsed plan
    spark.range(5).write.mode("overwrite").saveAsTable("stored_theirs")
    for text in (
        "SELECT value FROM IDENTIFIER('text.`/etc/hostname`')",
        "SELECT id FROM t WHERE id IN (SELECT id FROM stored_theirs)",
        "SELECT upper(IDENTIFIER('refl' || 'ect')('java.lang.System', 'getProperty', 'user.home')) FROM t",
    ):
        with pytest.raises(QueryRefused):
            sql_query(spark, text, {"t": spark.range(1)})
    spark.sql("DROP TABLE stored_theirs")
    own = spark.range(3).selectExpr("id", "reflect('java.lang.Math', 'abs', -1) AS one")
    assert sql_query(spark, "SELECT one FROM t JOIN (VALUES (1)) v(id) USING (id)", {"t": own}).count() == 1


def test_sql_leaves_views_alone_and_takes_fences_off(spark):
    spark.range(5).createOrReplaceTempView("t")
    out = sql_query(spark, "```sql\nWITH w AS (SELECT id FROM t) SELECT * FROM w\n```\n", {"t": spark.range(1)})
    assert out.count() == 1 and spark.table("t").count() == 5
    assert sql_query(spark, "SELECT id FROM t").count() == 5
    assert sql_query(spark, "SELECT 'x' AS \"reflect text\" FROM \"a b\"", {"a b": spark.range(2)}).count() == 2


# -- as-of -----------------------------------------------------------------------


@pytest.mark.parametrize("how", ["inner", "left"])
def test_asof_join_against_brute_force(spark, how):
    rng = random.Random(3)

    def events(n):
        # One key holds most rows; times repeat and buckets stay empty.
        return [(0 if rng.random() < 0.6 else rng.randrange(5), rng.randrange(60), i) for i in range(n)]

    def frame(data, value):
        df = spark.createDataFrame(data, f"k int, s int, {value} int")
        return df.withColumn("t", F.timestamp_seconds(F.col("s") * 50)).drop("s")

    left, right = events(200), events(60)
    out = asof_join(frame(left, "a"), frame(right, "b"), "k", "t", ["b"], how)
    want = []
    for k, s, a in left:
        earlier = [(s2, b) for k2, s2, b in right if k2 == k and s2 <= s]
        if earlier:
            want.append((a, max(earlier)[1]))
        elif how == "left":
            want.append((a, None))
    assert rows(out, "a", "right_b") == sorted(want, key=repr)


def test_asof_join_with_nulls(spark):
    left = spark.createDataFrame([(1, 10, "a"), (None, 10, "b"), (1, None, "c"), (2, 5, "d")], "k int, s int, l string")
    right = spark.createDataFrame([(1, None, "p"), (None, 1, "q"), (1, 3, "r"), (2, None, "s")], "k int, s int, v string")
    left, right = (x.withColumn("t", F.timestamp_seconds("s")) for x in (left, right))
    found = asof_join(left, right, "k", "t", ["v"]).select("l", "right_v")
    assert rows(found) == [("a", "r")]
    everyone = asof_join(left, right, "k", "t", ["v"], how="left").select("l", "right_v")
    assert rows(everyone) == [("a", "r"), ("b", None), ("c", None), ("d", None)]


def test_pages_of_equal_values_neither_overlap_nor_skip(spark):
    df = spark.range(50).select((F.col("id") % 2).alias("v"), F.col("id").alias("x")).repartition(7)
    pages = [[r.x for r in page_slice(df, k, 7, "v").collect()] for k in range(8)]
    assert sorted(x for p in pages for x in p) == list(range(50))
    assert [len(p) for p in pages] == [7] * 7 + [1]


def test_order_index_pages(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 3).alias("v"), F.col("id").alias("x y"), F.lit(None).cast("int").alias("z"))
    index = OrderIndex.build(df.repartition(6), "v", str(tmp_path / "a"))
    whole = sorted((i % 3, i) for i in range(100))
    for size in (7, 40, 300):
        pages = [index.page(k, size, "Row").collect() for k in range(-(-100 // size))]
        assert [(r.v, r["x y"]) for p in pages for r in p] == whole
        assert [r.Row for p in pages for r in p] == list(range(1, 101))
    assert index.page(100, 7).count() == 0 and index.page(100, 7).columns == df.columns
    assert index.count() == 100
    again = OrderIndex(spark, str(tmp_path / "a"))
    assert again.page(3, 7).collect() == index.page(3, 7).collect()
    with pytest.raises(ValueError):
        index.page(-1, 7)


def test_order_index_reads_a_pages_files_only(spark, tmp_path):
    df = spark.range(0, 4000, 1, 8).select(F.lit("same").alias("v"), F.col("id"))
    index = OrderIndex.build(df, (), str(tmp_path / "a"))  # its own order
    assert index.files.count() == 8
    page = index.page(70, 50)
    assert len(page.inputFiles()) == 1 and [r.id for r in page.collect()] == list(range(3500, 3550))
    assert len(index.page(0, 600).inputFiles()) == 2
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(__at), GreaterThanOrEqual(__at" in plan


def test_order_index_of_nothing_and_of_equal_rows(spark, tmp_path):
    none = OrderIndex.build(spark.range(0), "id", str(tmp_path / "a"))
    assert none.page(0, 5, "Row").collect() == [] and none.count() == 0
    equal = spark.range(60).select(F.lit(1).alias("v"))
    index = OrderIndex.build(equal, "v", str(tmp_path / "b"))
    assert sum(index.page(k, 7).count() for k in range(9)) == 60
