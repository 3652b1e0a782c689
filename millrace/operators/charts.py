"""Data behind charts: each function returns the frame a plot would draw."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.names import named


def line(df: DataFrame, x: str, y: str, ordered: bool = False) -> DataFrame:
    """Points (x, y). Ordering is a global sort, left to the caller's choice."""
    out = df.select(named(x).alias("x"), named(y).alias("y"))
    return out.orderBy("x") if ordered else out


def histogram(df: DataFrame, column: str, width: float, start: float = 0) -> DataFrame:
    """Row count per bin: bin ``i`` covers [start + i*width, start + (i+1)*width)."""
    bin_no = F.floor((named(column) - F.lit(start)) / F.lit(float(width)))
    return df.groupBy(bin_no.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_of_values(df: DataFrame, column: str) -> DataFrame:
    """Row count per distinct value, for text columns."""
    return df.groupBy(named(column).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def scatter(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(named(x).alias("x"), named(y).alias("y"))


def bar(df: DataFrame, x: str, y: str) -> DataFrame:
    """Bars over the same x stack up."""
    return df.groupBy(named(x).alias("x")).agg(F.sum(named(y)).alias("y"))


def pie(df: DataFrame, values: str, names: str) -> DataFrame:
    """Sum per name and its share of the total."""
    parts = df.groupBy(named(names).alias("name")).agg(F.sum(named(values)).alias("value"))
    # The total is a scalar subquery; no window over all rows.
    total = parts.agg(F.sum("value").alias("total")).scalar()
    return parts.select("name", "value", (F.col("value") / total).alias("share"))


def bubble(df: DataFrame, x: str, y: str, size: str) -> DataFrame:
    return df.select(named(x).alias("x"), named(y).alias("y"), named(size).alias("size"))


def geo_iso3(df: DataFrame, location: str, color: str, size: str) -> DataFrame:
    return df.select(
        named(location).alias("location"),
        named(color).alias("color"),
        named(size).alias("size"),
    )


# Chart names and how many columns each takes.
CHARTS = {
    "line": (line, 2),
    "histogram": (None, 1),
    "scatter": (scatter, 2),
    "bar": (bar, 2),
    "pie": (pie, 2),
    "bubble": (bubble, 3),
    "geo_iso3": (geo_iso3, 3),
}


# Inside quotes, commas and brackets belong to a column's name.
_ARGUMENT = re.compile(r"""\s*(?:"[^"]*"|'[^']*'|[^,"'()])+""")
_SPEC = re.compile(r"""\s*(\w+)\s*\(((?:"[^"]*"|'[^']*'|[^"'()])*)\)""")


def _unquote(text: str) -> str:
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    return text


def parse_chart(spec: str | None) -> tuple[str, list[str]]:
    """``bar("a", "b")`` as a name and its columns; ``("none", [])`` otherwise."""
    match = _SPEC.match(_unquote(spec or ""))
    if match is None or match[1] == "none":
        return "none", []
    return match[1], [_unquote(a) for a in _ARGUMENT.findall(match[2]) if a.strip()]


def chart_data(df: DataFrame, spec: str | None, width: float | None = None) -> DataFrame | None:
    """The frame a chart spec asks for, or None for ``none`` or unknown charts."""
    name, columns = parse_chart(spec)
    if name not in CHARTS:
        return None
    function, arity = CHARTS[name]
    if len(columns) < arity:
        raise ValueError(f"{name} takes {arity} columns, got {columns}")
    if name == "histogram":
        if width is None:
            return histogram_of_values(df, columns[0])
        return histogram(df, columns[0], width)
    return function(df, *columns[:arity])
