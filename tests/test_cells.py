import pytest
from pyspark.sql import functions as F

from millrace.functions.cells import (
    array_to_text,
    boolean_of,
    integer_of,
    nan_to_null,
    number_of,
    parse_array,
    trimmed,
    unquoted,
)
from millrace.operators.coerce import clean_text, coerce_types, typed
from millrace.schema import TableSchema


def one(spark, function, value, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(function(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("text", "expected"),
    [("'1'", "1"), ('"1"', "1"), ("1", "1"), ("", ""), (None, None), ('"', ""), ("'a\"", "'a\"")],
)
def test_unquoted(spark, text, expected):
    assert one(spark, unquoted, text) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("1", 1.0),
        ("-3", -3.0),
        ("+4", 4.0),
        ("1.0", 1.0),
        ("1.", 1.0),
        (".5", 0.5),
        ("1.5e3", 1500.0),
        ("1e5", None),
        ("1.1.1", None),
        ("nan", None),
        ("abc", None),
        ("", None),
    ],
)
def test_number(spark, text, expected):
    assert one(spark, number_of, text) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [("1", 1), ("001", 1), ("-7", -7), ("10.0", None), ("x", None), ("9" * 30, None)],
)
def test_integer(spark, text, expected):
    assert one(spark, integer_of, text) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [("True", True), ("FALSE", False), ("yes", None), ("1", None), ("t", None)],
)
def test_boolean(spark, text, expected):
    assert one(spark, boolean_of, text) is expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("[7,8]", ["7", "8"]),
        ("[fever]", ["fever"]),
        ("[ fever ,cough ]", ["fever", "cough"]),
        ('["fever", "dry cough"]', ["fever", "dry cough"]),
        ("'fever', rash", ["fever", "rash"]),
        ("fever,rash,", ["fever", "rash", ""]),
        ("fever", None),
        ("[]", [""]),
    ],
)
def test_array(spark, text, expected):
    assert one(spark, parse_array, text) == expected


def test_array_to_text(spark):
    assert one(spark, array_to_text, ["a", "", None, "b"], "array<string>") == "[a, b]"
    assert one(spark, array_to_text, [1, 2], "array<int>") == "[1, 2]"
    assert one(spark, array_to_text, None, "array<int>") is None


def test_trim_strips_all_whitespace(spark):
    assert one(spark, trimmed, "\t  a b \n") == "a b"


def test_nan_to_null(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.0), (3, None)], "k int, x double")
    assert [r.x for r in nan_to_null(df).orderBy("k").collect()] == [None, 1.0, None]


SCHEMA = TableSchema(
    {
        "properties": {
            "n": {"type": ["number", "null"]},
            "b": {"type": ["boolean", "null"]},
            "s": {"type": "string"},
            "t": {"type": ["string", "null"]},
            "a": {"type": ["array", "null"]},
        }
    }
)


def test_coercion_keeps_text_that_does_not_fit(spark):
    df = spark.createDataFrame(
        [("0", "False", " ", " ", "x, y"), ("zero", "no", " a ", "", "x")],
        "n string, b string, s string, t string, a string",
    )
    out = coerce_types(df, SCHEMA)
    first, second = out.select("n", "b", "s", "t", "a", "_typed").collect()
    assert first[:5] == ("0", "False", "", None, "x, y")
    assert first._typed.asDict() == {"n": 0.0, "b": False, "s": "", "t": None, "a": ["x", "y"]}
    assert second[:5] == ("zero", "no", "a", None, "x")
    assert second._typed.n is None and second._typed.b is None and second._typed.a is None


def test_typed_column_is_reached_by_name(spark):
    schema = TableSchema({"properties": {"Case ID": {"type": "integer"}}})
    df = spark.createDataFrame([(" 007 ",)], "`Case ID` string")
    assert coerce_types(df, schema).select(typed("Case ID")).first()[0] == 7
    assert clean_text(df, schema).first()[0] == "007"
