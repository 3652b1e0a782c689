"""Schema validation of staged batches.

``with_errors`` adds one array column of errors per row; all review steps read
that column, so none of them joins or shuffles. ``validate`` is its long form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.cells import read_cells
from millrace.functions.checks import error_array, evaluated, no_errors, record_checks
from millrace.functions.names import named
from millrace.operators.coerce import TYPED
from millrace.operators.shape import STAGING_COLUMNS
from millrace.schema import TableSchema

ERRORS = "_errors"
WARNINGS = "_warnings"
_HELPERS = {*STAGING_COLUMNS, TYPED, ERRORS, WARNINGS}


def with_errors(
    df: DataFrame,
    schema: TableSchema | None,
    relaxed: TableSchema | None = None,
    assert_format: bool = False,
    clean: bool = False,
) -> DataFrame:
    """Add ``_errors`` and ``_warnings``.

    With a relaxed schema, that one gives the errors and the base schema the
    warnings. Without a base schema nothing is validated. Cells are read
    towards the types of the base schema in both cases. ``clean`` also puts
    the cleaned text into the columns themselves (as ``clean_text`` does).

    A filter on these columns makes Catalyst compute the checks once more below
    the filter, so a batch that is reviewed in several steps should be written
    after this step (``stage`` does so).
    """
    if schema is None:
        return df.select("*", no_errors().alias(ERRORS), no_errors().alias(WARNINGS))
    names = [c for c in df.columns if c not in _HELPERS]
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    columns = df.columns
    df, cells = read_cells(df, {c: schema.json_types(c) for c in names})
    kept = []
    for c in columns:
        column = named(c)
        if clean and c in texts and c in names:
            column = cells[c].shown
            if "null" in schema.json_types(c):
                column = F.when(column != "", column)
        kept.append(column.alias(c))
    df, errors = evaluated(
        df, record_checks(relaxed or schema, cells, assert_format=assert_format), "__error"
    )
    warnings = []
    if relaxed is not None:
        df, warnings = evaluated(
            df, record_checks(schema, cells, assert_format=assert_format), "__warning"
        )
    return df.select(
        *kept, error_array(errors).alias(ERRORS), error_array(warnings).alias(WARNINGS)
    )


def _exploded(df: DataFrame, array: Column, *keep: Column) -> DataFrame:
    """One row per array item. The outer form, since the plain one would be
    given a filter on the array's size that computes the whole array again."""
    out = df.select(*keep, F.explode_outer(array).alias("e"))
    return out.filter(F.col("e").isNotNull())


def error_rows(checked: DataFrame, row: str = "Row") -> DataFrame:
    """Long form of ``with_errors``: Row, severity, path, keyword, message."""

    def tag(array: str, severity: str) -> Column:
        return F.transform(
            F.col(array),
            lambda e: F.struct(
                F.lit(severity).alias("severity"),
                e["path"].alias("path"),
                e["keyword"].alias("keyword"),
                e["message"].alias("message"),
            ),
        )

    everything = F.concat(tag(ERRORS, "error"), tag(WARNINGS, "warning"))
    return _exploded(checked, everything, named(row)).select(
        named(row), "e.severity", "e.path", "e.keyword", "e.message"
    )


def validate(
    df: DataFrame,
    schema: TableSchema | None,
    relaxed: TableSchema | None = None,
    row: str = "Row",
    assert_format: bool = False,
) -> DataFrame:
    """Errors and warnings of a batch, one row each, in a single scan."""
    return error_rows(with_errors(df, schema, relaxed, assert_format), row)


def has_errors() -> Column:
    return F.size(F.col(ERRORS)) > 0


def error_log(checked: DataFrame, row: str = "Row") -> DataFrame:
    """``Row N - 'path': message; ...`` for each failing row."""
    parts = F.transform(
        F.col(ERRORS),
        lambda e: F.concat(F.lit("'"), e["path"], F.lit("': "), e["message"]),
    )
    line = F.concat(
        F.lit("Row "), named(row).cast("string"), F.lit(" - "), F.array_join(parts, "; ")
    )
    return checked.filter(has_errors()).select(named(row), line.alias("line"))


def error_summary(checked: DataFrame) -> DataFrame:
    """Error count per path and keyword."""
    return (
        _exploded(checked, F.col(ERRORS))
        .groupBy(F.col("e.path").alias("path"), F.col("e.keyword").alias("keyword"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def verdict(checked: DataFrame) -> DataFrame:
    """One row: rows, rows with errors, rows with warnings, passed."""
    bad = F.count_if(has_errors())
    warned = F.count_if(F.size(F.col(WARNINGS)) > 0)
    return checked.agg(
        F.count(F.lit(1)).alias("n_rows"),
        bad.alias("rows_with_errors"),
        warned.alias("rows_with_warnings"),
        ((bad == 0) & (warned == 0)).alias("passed"),
    )
