"""Cells: text coerced towards the types a schema declares.

A source column arrives as text. ``read_cell`` turns it into a ``Cell``: one
Column per JSON kind (null, array, number, boolean, text), of which exactly
one is set per row. Types are tried in the order array, number, integer,
boolean, null; text that fits none stays text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.names import named

# The characters stripped from both ends of a cell.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Accepted number spellings. A number without a point has to be
# a whole number, so '1e5' stays text while '1.5e3' parses.
INTEGER = r"^[+-]?[0-9]+$"
NUMBER = r"^[+-]?([0-9]+|([0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)$"


def trimmed(text: Column) -> Column:
    """Strip whitespace. Only text that starts or ends in something else than
    a printable ASCII character goes through the character set."""
    first, last = F.ascii(text), F.ascii(F.right(text, F.lit(1)))
    suspect = (first < 33) | (first > 126) | (last < 33) | (last > 126)
    return F.when(suspect, F.btrim(text, F.lit(WHITESPACE))).otherwise(text)


def integer_of(text: Column) -> Column:
    return F.when(text.rlike(INTEGER), text.try_cast("long"))


def number_of(text: Column) -> Column:
    """Double value of a whole or decimal number spelling, else null."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def boolean_of(text: Column) -> Column:
    """Only true/false in any case."""
    low = F.lower(text)
    return F.when(low == "true", F.lit(True)).when(low == "false", F.lit(False))


def unquoted(text: Column) -> Column:
    """Strip one matching pair of single or double quotes."""
    inner = F.substr(text, F.lit(2), F.length(text) - 2)
    wrapped = (text.startswith('"') & text.endswith('"')) | (
        text.startswith("'") & text.endswith("'")
    )
    return (
        F.when(wrapped & (F.length(text) >= 2), inner)
        .when(wrapped, F.lit(""))
        .otherwise(text)
    )


def looks_like_array(text: Column) -> Column:
    return (text.startswith("[") & text.endswith("]")) | text.contains(",")


def array_items(text: Column) -> Column:
    """Items of ``[a, b]`` or ``a, b`` text: trimmed, still quoted, else null."""
    bracketed = text.startswith("[") & text.endswith("]")
    inner = F.when(
        bracketed, F.substr(text, F.lit(2), F.length(text) - 2)
    ).otherwise(text)
    return F.when(
        looks_like_array(text), F.transform(F.split(inner, ","), lambda x: trimmed(x))
    )


def parse_array(text: Column) -> Column:
    """Items as unquoted text; null when the text has neither brackets nor comma."""
    return F.transform(array_items(text), lambda x: unquoted(x))


def array_to_text(items: Column) -> Column:
    """``[x, y]``, empty items left out."""
    shown = F.transform(items, lambda x: x.cast("string"))
    kept = F.filter(shown, lambda x: x.isNotNull() & (x != ""))
    return F.when(
        items.isNotNull(),
        F.concat(F.lit("["), F.array_join(kept, ", "), F.lit("]")),
    )


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN cells of float columns as null."""
    return df.select(
        *[
            F.nanvl(named(f.name), F.lit(None).cast(f.dataType)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else named(f.name)
            for f in df.schema.fields
        ]
    )


@dataclass(frozen=True)
class Cell:
    """One value as Columns by JSON kind. ``None`` means the kind cannot occur."""

    is_null: Column
    shown: Column  # the value as text, for messages
    text: Column | None = None
    number: Column | None = None  # long or double
    boolean: Column | None = None
    items: Column | None = None  # array of text, still quoted
    typed_items: T.DataType | None = None  # set when items are native values

    def item(self, element: Column) -> "Cell":
        """An array element as a cell of its own (any type may come out)."""
        if self.typed_items is not None:
            return typed_cell(element, self.typed_items)
        number = number_of(element)
        boolean = boolean_of(element)
        empty = (element == "") | element.isNull()
        return Cell(
            is_null=empty,
            shown=element,
            text=F.when(number.isNull() & boolean.isNull() & ~empty, unquoted(element)),
            number=number,
            boolean=boolean,
        )


def typed_cell(column: Column, data_type: T.DataType) -> Cell:
    """A column that already has a Spark type."""
    shown = column.cast("string")
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        value = F.nanvl(column, F.lit(None).cast(data_type))
        return Cell(value.isNull(), shown, number=value)
    if isinstance(data_type, T.NumericType):
        return Cell(column.isNull(), shown, number=column)
    if isinstance(data_type, T.BooleanType):
        return Cell(column.isNull(), shown, boolean=column)
    if isinstance(data_type, T.ArrayType):
        return Cell(
            column.isNull(),
            array_to_text(column),
            items=column,
            typed_items=data_type.elementType,
        )
    return Cell(column.isNull(), shown, text=shown)


def text_cell(text: Column, json_types: Sequence[str]) -> Cell:
    """Trimmed text read towards the declared JSON types."""
    left = text  # what earlier kinds did not take
    items = number = boolean = None
    is_null = text.isNull()
    if "array" in json_types:
        items = array_items(text)
        left = F.when(items.isNull(), left)
    if "number" in json_types:
        number = number_of(left)
    elif "integer" in json_types:
        number = integer_of(left)
    if number is not None:
        left = F.when(number.isNull(), left)
    if "boolean" in json_types:
        boolean = boolean_of(left)
        left = F.when(boolean.isNull(), left)
    if "null" in json_types:
        is_null = is_null | (text == "")
        left = F.when(text != "", left)
    return Cell(is_null, text, text=left, number=number, boolean=boolean, items=items)


def read_cells(
    df: DataFrame, json_types: dict[str, Sequence[str]]
) -> tuple[DataFrame, dict[str, Cell]]:
    """Cells of the named columns, each kind computed once.

    Kinds become helper columns (``__cell...``) in projections of their own.
    Catalyst keeps such projections apart as long as their results are used
    more than once, so checks read ready values instead of repeating the
    trimming, matching and casting in every keyword.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    texts = [
        c for c in json_types if isinstance(kinds[c], (T.StringType, T.NullType))
    ]
    position = {c: i for i, c in enumerate(json_types)}
    df = df.select(
        "*",
        *[
            trimmed(named(c).cast("string")).alias(f"__cell{position[c]}")
            for c in texts
        ],
    )
    helpers: list[Column] = []
    cells: dict[str, Cell] = {}
    for c, declared in json_types.items():
        if c not in texts:
            cells[c] = typed_cell(named(c), kinds[c])
            continue
        base = f"__cell{position[c]}"
        cell = text_cell(F.col(base), declared)
        parts = {}
        for kind in ("number", "boolean", "items", "text", "is_null"):
            column = getattr(cell, kind)
            if column is not None:
                helpers.append(column.alias(f"{base}_{kind}"))
                column = F.col(f"{base}_{kind}")
            parts[kind] = column
        cells[c] = Cell(shown=F.col(base), **parts)
    return df.select("*", *helpers), cells
