"""Typed columns beside the raw text of a staged batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.cells import (
    array_to_text,
    boolean_of,
    integer_of,
    number_of,
    parse_array,
    trimmed,
)
from millrace.functions.names import named
from millrace.schema import TableSchema

TYPED = "_typed"


def _value_type(schema: TableSchema, name: str) -> T.DataType:
    """The Spark type of a column's coerced value: arrays stay arrays here."""
    declared = schema.json_types(name)
    for json_type, spark_type in (
        ("array", T.ArrayType(T.StringType())),
        ("number", T.DoubleType()),
        ("integer", T.LongType()),
        ("boolean", T.BooleanType()),
    ):
        if json_type in declared and "string" not in declared:
            return spark_type
    return T.StringType()


def _value(text: Column, want: T.DataType) -> Column:
    if isinstance(want, T.ArrayType):
        return parse_array(text)
    if isinstance(want, T.DoubleType):
        return number_of(text)
    if isinstance(want, T.LongType):
        return integer_of(text)
    if isinstance(want, T.BooleanType):
        return boolean_of(text)
    return text


def trim_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Strip whitespace around text cells."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    chosen = set(texts if columns is None else columns)
    return df.select(
        *[
            trimmed(named(c)).alias(c) if c in chosen else named(c)
            for c in df.columns
        ]
    )


def clean_text(df: DataFrame, schema: TableSchema) -> DataFrame:
    """Raw columns after cleaning: trimmed, empty text null where null is allowed."""
    out = []
    for f in df.schema.fields:
        column = named(f.name)
        if isinstance(f.dataType, T.StringType):
            column = trimmed(column)
            if "null" in schema.json_types(f.name):
                column = F.when(column != "", column)
        out.append(column.alias(f.name))
    return df.select(*out)


def coerce_types(df: DataFrame, schema: TableSchema) -> DataFrame:
    """Clean the raw columns and add the struct ``_typed`` of coerced values.

    A value that does not fit is null in ``_typed`` and keeps its text in the
    raw column. Everything is one projection: unused members are pruned.
    """
    cleaned = clean_text(df, schema)
    members = []
    for f in df.schema.fields:
        if f.name not in schema.fields:
            continue
        want = _value_type(schema, f.name)
        column = named(f.name)
        if isinstance(f.dataType, T.StringType):
            column = _value(column, want)
        members.append(column.alias(f.name))
    return cleaned.select("*", F.struct(*members).alias(TYPED))


def stored_form(df: DataFrame, schema: TableSchema | None) -> DataFrame:
    """Array columns as they are stored: ``[a, b]`` text, or real arrays when
    the schema stores typed values. Text that is no array stays as it is."""
    if schema is None:
        return df
    out = []
    for f in df.schema.fields:
        column = named(f.name)
        if isinstance(f.dataType, T.StringType) and "array" in schema.json_types(f.name):
            items = parse_array(trimmed(column))
            if isinstance(schema.spark_type(f.name), T.ArrayType):
                column = items
            else:
                column = F.coalesce(array_to_text(items), column)
        out.append(column.alias(f.name))
    return df.select(*out)


def typed(name: str) -> Column:
    """A coerced value of a frame made by ``coerce_types``."""
    return F.col(TYPED).getField(name)


def typed_rows(df: DataFrame, schema: TableSchema, *keep: str) -> DataFrame:
    """Coerced values under their own names, with ``keep`` columns in front."""
    names = [c for c in df.columns if c in schema.fields]
    return df.select(
        *[named(c) for c in keep], *[typed(c).alias(c) for c in names]
    )
