"""Column layout: ordering, padding, conforming, uniting."""

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

# Helper columns used while staging and in version history.
STAGING_COLUMNS = ["Row", "_delete"]
HISTORY_COLUMNS = ["_version", "_deleted", "_metadata"]


def schema_order(
    df: DataFrame,
    schema: TableSchema | None,
    prepend: Sequence[str] = (),
    append: Sequence[str] = (),
) -> DataFrame:
    """Columns in schema order, unknown ones after; the overrides come first/last."""
    if schema is None or not schema.columns:
        return df
    first = [c for c in prepend if c not in schema.columns]
    last = [c for c in append if c not in schema.columns and c not in first]
    known = [*first, *schema.columns]
    unknown = [c for c in df.columns if c not in known and c not in last]
    order = [c for c in [*known, *unknown, *last] if c in df.columns]
    return df.select(*[named(c) for c in order])


def pad_missing(df: DataFrame, layout: T.StructType) -> DataFrame:
    """Add the layout's absent columns as typed nulls."""
    have = set(df.columns)
    missing = [f for f in layout.fields if f.name not in have]
    return df.select(
        "*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing]
    )


def _cast(column: Column, have: T.DataType, want: T.DataType, name: str, on_error: str):
    if have == want:
        return column
    if isinstance(have, T.NullType):
        return column.cast(want)
    if isinstance(have, T.ArrayType) and isinstance(want, T.StringType):
        return array_to_text(column)
    text = isinstance(have, T.StringType)
    if text and isinstance(want, T.ArrayType):
        tried = parse_array(column).cast(want)
    elif text and isinstance(want, T.BooleanType):
        tried = boolean_of(trimmed(column))
    elif text and isinstance(want, T.IntegralType):
        tried = integer_of(trimmed(column)).try_cast(want)
    elif text and isinstance(want, T.FractionalType) and not isinstance(want, T.DecimalType):
        tried = number_of(trimmed(column)).cast(want)
    else:
        tried = column.try_cast(want)
    if isinstance(have, T.FractionalType) and isinstance(want, T.IntegralType):
        tried = F.when(column == F.floor(column), tried)
        if isinstance(have, (T.DoubleType, T.FloatType)):
            column = F.nanvl(column, F.lit(None).cast(have))
    if on_error == "null":
        return tried
    message = F.concat(
        F.lit(f"column '{name}': "),
        column.cast("string"),
        F.lit(f" is not a {want.simpleString()}"),
    )
    return F.when(
        column.isNotNull() & tried.isNull(), F.raise_error(message).cast(want)
    ).otherwise(tried)


def cast_to(df: DataFrame, layout: T.StructType, on_error: str = "fail") -> DataFrame:
    """Cast the layout's columns; others pass through. Text becomes a number or a
    truth value by the spellings that coercion accepts, and by no others."""
    if on_error not in ("fail", "null"):
        raise ValueError(f"unknown on_error {on_error!r}")
    want = {f.name: f.dataType for f in layout.fields}
    return df.select(
        *[
            _cast(named(f.name), f.dataType, want[f.name], f.name, on_error).alias(
                f.name
            )
            if f.name in want
            else named(f.name)
            for f in df.schema.fields
        ]
    )


def conform(
    df: DataFrame,
    schema: TableSchema | None,
    on_error: str = "fail",
    extra: str = "drop",
) -> DataFrame:
    """Cast to the declared types, pad absent columns, drop or keep extra ones.

    A cell that cannot be cast fails the job (``on_error="fail"``) or turns
    null. Without a schema the batch keeps its own columns and types.
    """
    if extra not in ("drop", "keep"):
        raise ValueError(f"unknown extra {extra!r}")
    if schema is None or not schema.columns:
        return df
    layout = schema.struct()
    full = pad_missing(cast_to(df, layout, on_error), layout)
    others = [c for c in df.columns if c not in schema.columns]
    keep = schema.columns + (others if extra == "keep" else [])
    return full.select(*[named(c) for c in keep])


def union_by_name(old: DataFrame, new: DataFrame) -> DataFrame:
    """All columns of both sides, absent cells null."""
    return old.unionByName(new, allowMissingColumns=True)


def drop_helpers(df: DataFrame, *extra: str) -> DataFrame:
    """Remove staging and history columns, and ``extra`` ones such as the
    validity flags a source tool adds."""
    return df.drop(*STAGING_COLUMNS, *HISTORY_COLUMNS, *extra)
