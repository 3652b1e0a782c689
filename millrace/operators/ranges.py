"""Joins on overlapping ranges, without an equality to join on."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.names import named

#: Rows that a bin should hold, and bins at most.
_BIN_ROWS, _MOST_BINS = 4096, 4096


def _ends(df: DataFrame, bounds: tuple[str, str]) -> tuple[str, str]:
    for name in bounds:
        kind = df.schema[name].dataType
        if not isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            raise TypeError(f"'{name}' of type {kind.simpleString()} is not a number, date or time")
    return bounds


def _as_double(df: DataFrame, name: str):
    """A number that grows with the value; equal for close values, never reversed."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(named(name)).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return named(name).cast("timestamp").cast("double")
    return named(name).cast("double")


def _bounds(sides: list[DataFrame]) -> list[float]:
    """Where bins begin: quantiles of the starts of both sides, so that a crowded span
    has narrow bins."""
    starts = sides[0].select("__lo")
    for side in sides[1:]:
        starts = starts.unionByName(side.select("__lo"))
    n = starts.count()
    bins = min(_MOST_BINS, -(-n // _BIN_ROWS))
    if bins < 2:
        return []
    shares = [i / bins for i in range(1, bins)]
    found = starts.agg(F.percentile_approx("__lo", shares, 10 * _MOST_BINS)).first()[0]
    return sorted(set(found or []))


def range_join(
    left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str]
) -> DataFrame:
    """Pairs of rows whose ranges (first and last value, both included) overlap; a point
    is a range whose two names are the same column.

    Both sides are cut into bins by quantiles of all starts. A row goes to each bin its
    range touches, the sides meet by bin in an equi-join (which AQE can split where one
    value is crowded), and a pair comes from the bin in which its overlap begins, so
    none is found twice. Values compare exactly; bins only decide where they meet.

    Null or NaN bounds and ranges that end before they start match nothing. Columns of
    ``left`` are followed by those of ``right``; names should differ.
    """
    sides = []
    for df, bounds, key in ((left, left_range, "l"), (right, right_range, "r")):
        lo, hi = _ends(df, bounds)
        row = F.struct(*[named(c).alias(c) for c in df.columns]).alias(f"__{key}")
        side = df.filter(named(lo) <= named(hi)).select(row, _as_double(df, lo).alias("__lo"), _as_double(df, hi).alias("__hi"))
        sides.append(side.filter(~F.isnan("__lo") & ~F.isnan("__hi")))
    splits = [-float("inf"), *_bounds(sides), float("inf")]
    binned = []
    for side, key in zip(sides, "lr", strict=True):
        cut = Bucketizer(splitsArray=[splits] * 2, inputCols=["__lo", "__hi"], outputCols=["__first", "__last"])
        out = cut.transform(side) if len(splits) > 2 else side.withColumns({"__first": F.lit(0), "__last": F.lit(0)})
        first, last = F.col("__first").cast("int"), F.col("__last").cast("int")
        binned.append(out.select(f"__{key}", first.alias(f"__first_{key}"), F.explode(F.sequence(first, last)).alias("__bin")))
    cell = lambda key, name: F.col(f"__{key}").getField(name)
    overlap = (cell("l", left_range[0]) <= cell("r", right_range[1])) & (cell("r", right_range[0]) <= cell("l", left_range[1]))
    begins = F.col("__bin") == F.greatest("__first_l", "__first_r")
    met = binned[0].join(binned[1], "__bin").filter(begins & overlap)
    return met.select(*[cell("l", c).alias(c) for c in left.columns], *[cell("r", c).alias(c) for c in right.columns])
