"""Review of a staged batch: filters, marks, edits, commit.

Works on frames with ``Row``, ``_delete`` and, where errors matter, the
``_errors`` array of ``with_errors``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.cells import array_to_text
from millrace.functions.names import key_list, named, row_of
from millrace.operators.coerce import stored_form
from millrace.operators.merge import unseen
from millrace.operators.validate import ERRORS, has_errors


def only_error_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(has_errors())


def only_new_rows(batch: DataFrame, stored_keys: DataFrame, key) -> DataFrame:
    """Rows whose key the stored table lacks."""
    return unseen(batch, stored_keys, key_list(key))


def _mark(df: DataFrame, value: Column) -> DataFrame:
    return df.withColumn("_delete", value)


def _marked(df: DataFrame) -> Column:
    return F.col("_delete") if "_delete" in df.columns else F.lit(False)


def empty_id(column: Column, data_type: T.DataType, zero_is_empty: bool = True) -> Column:
    """Null, empty text, false, or a numeric zero (text '0' is not empty)."""
    if isinstance(data_type, T.StringType):
        blank = column == ""
    elif isinstance(data_type, T.NumericType):
        blank = column == 0 if zero_is_empty else F.lit(False)
    elif isinstance(data_type, T.BooleanType):
        blank = ~column
    else:
        blank = F.lit(False)
    return column.isNull() | F.coalesce(blank, F.lit(False))


def reject_empty_ids(df: DataFrame, key: str, zero_is_empty: bool = True) -> DataFrame:
    empty = empty_id(named(key), df.schema[key].dataType, zero_is_empty)
    return _mark(df, _marked(df) | empty)


def reject_error_rows(checked: DataFrame) -> DataFrame:
    return _mark(checked, _marked(checked) | has_errors())


def restore_rows(df: DataFrame) -> DataFrame:
    return _mark(df, F.lit(False))


def toggle_rows(df: DataFrame, row_ids: DataFrame) -> DataFrame:
    """Flip ``_delete`` for the given ``Row`` values."""
    ids = row_ids.select(F.col("Row").alias("__row")).distinct()
    return (
        df.join(ids, F.col("Row") == F.col("__row"), "left")
        .withColumn("_delete", _marked(df) != F.col("__row").isNotNull())
        .drop("__row")
    )


def review_stats(df: DataFrame, showing: Column | None = None) -> DataFrame:
    """One row: total, showing and deleted (among the shown rows)."""
    shown = F.lit(True) if showing is None else showing
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(shown).alias("showing"),
        F.count_if(shown & F.col("_delete")).alias("deleted"),
    )


def overlay_edits(
    base: DataFrame,
    edits: DataFrame,
    columns: Sequence[str] | None = None,
    order_by: str | None = None,
) -> DataFrame:
    """Replace staged rows by edited rows on ``Row``; an edited null wins.

    ``order_by`` settles several edits of one row: the last one counts.
    Without it each ``Row`` may occur once in ``edits``.
    """
    chosen = [c for c in columns or edits.columns if c not in ("Row", order_by)]
    if order_by:
        edits = edits.groupBy("Row").agg(
            F.max_by(row_of(chosen), named(order_by)).alias("__edit")
        )
    else:
        edits = edits.select("Row", row_of(chosen).alias("__edit"))
    edits = edits.withColumnRenamed("Row", "__row")
    return base.join(edits, F.col("Row") == F.col("__row"), "left").select(
        *[
            F.when(F.col("__row").isNotNull(), F.col("__edit").getField(c))
            .otherwise(named(c))
            .alias(c)
            if c in chosen
            else named(c)
            for c in base.columns
        ]
    )


def cell_diff(
    original: DataFrame, edited: DataFrame, columns: Sequence[str] | None = None
) -> DataFrame:
    """Cells whose text changed: Row, col, original, edited."""
    chosen = [
        c
        for c in columns or edited.columns
        if c in original.columns and c not in ("Row", "_delete", ERRORS)
    ]

    def as_text(df: DataFrame, name: str) -> Column:
        column = named(name)
        if isinstance(df.schema[name].dataType, T.ArrayType):
            column = array_to_text(column)
        return column.cast("string").alias(name)

    before = original.select(
        "Row", F.struct(*[as_text(original, c) for c in chosen]).alias("__before")
    )
    after = edited.select(
        F.col("Row").alias("__row"),
        F.struct(*[as_text(edited, c) for c in chosen]).alias("__after"),
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("col"),
                F.col("__before").getField(c).alias("original"),
                F.col("__after").getField(c).alias("edited"),
            )
            for c in chosen
        ]
    )
    changed = F.filter(cells, lambda x: ~x["original"].eqNullSafe(x["edited"]))
    return (
        before.join(after, F.col("Row") == F.col("__row"))
        .select("Row", F.explode(changed).alias("x"))
        .select("Row", "x.col", "x.original", "x.edited")
    )


def _sortable(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.MapType, T.VariantType))


def page_slice(df: DataFrame, page: int, size: int, order_by: str = "Row") -> DataFrame:
    """Page ``page`` (from 0) of ``size`` rows.

    On ``Row``, which is contiguous, a range filter. On any other column, rows with
    equal values follow each other by the whole row, so pages neither overlap nor
    skip. A deep page sorts all rows before it: number a large batch once with
    ``stage(df, order_by=...)`` and page by ``Row`` instead.
    """
    if page < 0 or size < 1:
        raise ValueError("page counts from 0 and size from 1")
    if order_by == "Row":
        row = F.col("Row")
        return df.filter((row > page * size) & (row <= (page + 1) * size))
    rest = [named(c) for c in df.columns if c != order_by and _sortable(df.schema[c].dataType)]
    order = [named(order_by), *rest]
    return df.orderBy(*order).offset(page * size).limit(size)


def kept_rows(df: DataFrame, *helpers: str) -> DataFrame:
    """Rows of a staged batch not marked for deletion, without helper columns. A
    frame that is not staged comes back whole: there such names are data."""
    if "_delete" not in df.columns:
        return df
    return df.filter(~_marked(df)).drop("_delete", ERRORS, "_warnings", "_typed", *helpers)


def commit_reviewed(store, staged, update_existing: bool = True, **options):
    """Commit the kept rows of every staged table; ``Row`` orders repeats.

    ``staged`` is a mapping or (table, frame) pairs; a table may occur again.
    ``update_existing`` chooses upsert over append.
    """
    from millrace.sources.store import WritePolicy

    policy = WritePolicy.UPSERT if update_existing else WritePolicy.APPEND
    store.set_write_policy(policy)
    pairs = staged.items() if isinstance(staged, Mapping) else staged
    ready = [(table, stored_form(kept_rows(df), store.schema(table))) for table, df in pairs]
    return store.commit_tables(ready, order_by="Row", policy=policy, **options)
