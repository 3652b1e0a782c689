"""Data dictionary of an unknown source."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.cells import INTEGER, NUMBER, trimmed
from millrace.functions.names import named
from millrace.session import scratch_dir

# Values of more bytes than this are counted by digest, so that long texts are
# not shuffled; the few frequent ones are looked up again afterwards. A digest
# has 64 characters, so it cannot be taken for a short value.
_SHORT = 48


def _fields(df: DataFrame, columns: Sequence[str] | None) -> list[T.StructField]:
    wanted = df.columns if columns is None else columns
    fields = [df.schema[c] for c in wanted]
    return [f for f in fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]


def _is_nested(f: T.StructField) -> bool:
    return isinstance(f.dataType, (T.ArrayType, T.StructType))


def _as_text(f: T.StructField) -> Column:
    if _is_nested(f):
        return F.to_json(named(f.name))
    return named(f.name).cast("string")


def _is_long() -> Column:
    return F.octet_length("text") > _SHORT


def _digest() -> Column:
    return F.when(_is_long(), F.sha2("text", 256)).otherwise(F.col("text"))


def _melt(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """(field, text) per non-null cell."""
    texts = df.select(*[_as_text(f).alias(f.name) for f in fields])
    cells = texts.unpivot([], [named(f.name) for f in fields], "field", "text")
    return cells.filter(F.col("text").isNotNull())


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(field, digest, n, long): exact frequency of every value of every column.

    One scan and one shuffle, combined on the map side: a value filling a third
    of a column leaves each task as a single row. ``long`` tells digests from
    plain values.
    """
    cells = _melt(df, _fields(df, columns))
    keyed = cells.select("field", _digest().alias("digest"), _is_long().alias("long"))
    return keyed.groupBy("field", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("long").alias("long")
    )


def _written(df: DataFrame) -> DataFrame:
    path = scratch_dir(df.sparkSession, "profile")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Values that a frequent-items summary can track.
_MOST_TRACKED = 1_000_000


def _candidates(df: DataFrame, fields: Sequence[T.StructField], tracked: int) -> DataFrame:
    """(field, digest) of all values that can fill 8 / ``tracked`` of the rows.

    One mergeable frequent-items summary a column, so that a task sends its summaries
    and no values. A count in it is too high by 3.5 / ``tracked`` of the rows at most
    and never too low: the values wanted are among the first ``tracked`` / 4."""
    texts = df.select(*[_as_text(f).alias(f.name) for f in fields])
    short = lambda c: F.when(F.octet_length(c) > _SHORT, F.sha2(c, 256)).otherwise(c)
    first = lambda c: F.call_function("approx_top_k", short(c), F.lit(tracked // 4), F.lit(tracked))
    tops = texts.agg(*[first(named(f.name)).alias(f"__{i}") for i, f in enumerate(fields)])

    def named_items(i: int, f: T.StructField) -> Column:
        return F.transform(F.col(f"__{i}"), lambda t: F.struct(F.lit(f.name).alias("field"), t["item"].alias("digest")))

    each = [named_items(i, f) for i, f in enumerate(fields)]
    found = tops.select(F.explode(F.concat(*each)).alias("c")).select("c.field", "c.digest")
    return found.filter(F.col("digest").isNotNull())


def common_values(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    min_share: float = 0.05,
    k: int | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Frequent values: (field, val, n), those filling at least ``min_share``
    of the rows, at most the first ``k`` of a column (ties by value).

    Two scans: summaries of the columns give the values that can be frequent, a few
    for each column, and only these are counted, exactly. Where ``min_share`` asks for
    more values than a summary tracks, or ``counts`` brings counts that exist already,
    all values count."""
    fields = _fields(df, columns)
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    tracked = max(64, math.ceil(8 / min_share)) if min_share > 0 else _MOST_TRACKED + 1
    if not fields:
        candidates = value_counts(df, columns)
    elif counts is not None:
        candidates = _written(counts.filter(F.col("n") >= F.lit(min_share) * total))
    elif tracked > _MOST_TRACKED:
        candidates = _written(value_counts(df, columns).filter(F.col("n") >= F.lit(min_share) * total))
    else:
        candidates = F.broadcast(_written(_candidates(df, fields, tracked)))  # tracked / 4 rows a column at most
    candidates = candidates.select(F.col("field").alias("__field"), F.col("digest").alias("__digest"))
    cells = _melt(df, fields)
    found = (
        cells.join(candidates, (F.col("field") == F.col("__field")) & (_digest() == F.col("__digest")))
        .groupBy("field", "__digest")
        .agg(F.min("text").alias("val"), F.count(F.lit(1)).alias("n"))
    )
    out = found.filter(F.col("n") >= F.lit(min_share) * total).select("field", "val", "n")
    if k is not None:
        order = W.partitionBy("field").orderBy(F.desc("n"), "val")
        out = (
            out.withColumn("__rank", F.row_number().over(order))
            .filter(F.col("__rank") <= k)
            .drop("__rank")
        )
    return out


def _known_type(data_type: T.DataType) -> str | None:
    """JSON type of columns that are not text."""
    if isinstance(data_type, T.IntegralType):
        return "integer"
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.ArrayType):
        return "array"
    if isinstance(data_type, T.StructType):
        return "object"
    return None if isinstance(data_type, T.StringType) else "string"


def inferred_type(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(field, n, n_null, lo, hi, type): one aggregate over one scan, without a
    shuffle beyond a row per task. A text column gets the narrowest type all
    its non-null values can be read as."""
    fields = _fields(df, columns)
    # Text is trimmed once, for all tests.
    df = df.select(
        *[named(f.name) for f in fields],
        *[
            trimmed(named(f.name)).alias(f"__text{i}")
            for i, f in enumerate(fields)
            if isinstance(f.dataType, T.StringType)
        ],
    )
    aggs = []
    for i, f in enumerate(fields):
        column = named(f.name)
        bounds = [F.lit(None).cast("string")] * 2
        if not _is_nested(f):
            bounds = [F.min(column).cast("string"), F.max(column).cast("string")]
        filled = F.count(column)
        kind = F.lit(_known_type(f.dataType))
        if _known_type(f.dataType) is None:
            text = F.col(f"__text{i}")
            short = F.octet_length(text) <= len("false")
            kind = (
                F.when(F.count_if(short & F.lower(text).isin("true", "false")) == filled, "boolean")
                .when(F.count_if(text.rlike(INTEGER)) == filled, "integer")
                .when(F.count_if(text.rlike(NUMBER)) == filled, "number")
                .otherwise("string")
            )
        aggs.append(
            F.struct(
                F.lit(f.name).alias("field"),
                F.count(F.lit(1)).alias("n"),
                F.count_if(column.isNull()).alias("n_null"),
                bounds[0].alias("lo"),
                bounds[1].alias("hi"),
                F.when(filled == 0, "null").otherwise(kind).alias("type"),
            ).alias(f"s{i}")
        )
    wide = df.agg(*aggs)
    return wide.select(
        F.explode(F.array(*[F.col(f"s{i}") for i in range(len(fields))])).alias("s")
    ).select("s.*")


def data_dictionary(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    min_share: float = 0.05,
    k: int | None = None,
    descriptions: dict[str, str] | None = None,
) -> DataFrame:
    """One row per column: field, description, type, n, n_null, n_distinct,
    lo, hi, common_values (listed whole, so ``min_share`` or ``k`` bounds them)."""
    if min_share <= 0 and k is None:
        raise ValueError("give a min_share above 0 or a k")
    stats = inferred_type(df, columns)
    counts = _written(value_counts(df, columns))  # two uses, one count
    distinct = counts.groupBy("field").agg(F.count(F.lit(1)).alias("n_distinct"))
    common = common_values(df, columns, min_share, k, counts)
    # At most 1/min_share values per column are gathered here.
    listed = common.groupBy("field").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col("val")))),
            lambda x: x["val"],
        ).alias("common_values")
    )
    described = F.lit(None).cast("string")
    for name, text in (descriptions or {}).items():
        described = F.when(F.col("field") == name, F.lit(text)).otherwise(described)
    return (
        stats.join(distinct, "field", "left")
        .join(listed, "field", "left")
        .select(
            "field",
            described.alias("description"),
            "type",
            "n",
            "n_null",
            F.coalesce("n_distinct", F.lit(0).cast("long")).alias("n_distinct"),
            "lo",
            "hi",
            F.coalesce("common_values", F.array().cast("array<string>")).alias("common_values"),
        )
    )
