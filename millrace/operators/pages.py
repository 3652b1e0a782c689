"""Pages of large frames through an order index: one sort, then only a page's files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.names import key_list, named
from millrace.operators.review import _sortable
from millrace.session import scratch_dir

_AT = "__at"  # stored position: writing task above, place in the task below
_BITS = 33
_INDEX = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("at", T.LongType()),
        T.StructField("first", T.LongType()),
        T.StructField("n", T.LongType()),
    ]
)


class OrderIndex:
    """A frame written in order, with the number of rows before each of its files.

    ``build`` sorts once, by range over all tasks; ``page`` then looks the page's
    files up in the index (one row a file) and reads these alone, however deep the
    page. A position is a range on the stored place, which reaches the Parquet scan.
    The driver gets the index rows of the page's own files.
    """

    def __init__(self, spark: SparkSession, location: str):
        self.spark, self.location = spark, location
        stored = spark.read.parquet(f"{location}/rows").schema
        self.layout = stored
        self.columns = [c for c in stored.fieldNames() if c != _AT]
        self.files = spark.read.schema(_INDEX).parquet(f"{location}/index")

    @classmethod
    def build(
        cls, df: DataFrame, order_by: str | Sequence[str] = (), location: str | None = None
    ) -> OrderIndex:
        """Order ``df`` by the given columns (nulls first), or keep its own order.

        Rows equal in these follow each other by the whole row, as in
        ``page_slice``; rows equal in all columns are interchangeable and spread
        over tasks like any others.
        """
        names, keys = df.columns, key_list(order_by)
        if _AT in names:
            raise ValueError(f"column name {_AT!r} is taken by the index")
        if keys:
            rest = [c for c in names if c not in keys and _sortable(df.schema[c].dataType)]
            order = [named(c) for c in [*keys, *rest]]
            tie = F.col("__tie")
            df = df.withColumn("__tie", F.monotonically_increasing_id())
            df = df.repartitionByRange(*order, tie).sortWithinPartitions(*order, tie)
        spark = df.sparkSession
        location = location or scratch_dir(spark, "ordered")
        placed = df.select(*[named(c) for c in names], F.monotonically_increasing_id().alias(_AT))
        placed.write.parquet(f"{location}/rows")
        written = spark.read.schema(placed.schema).parquet(f"{location}/rows")
        sizes = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(
            F.min(_AT).alias("at"), F.count(F.lit(1)).alias("n")
        )
        # one row a file; a task that wrote several has them in the order of its rows
        before = W.orderBy("at").rowsBetween(W.unboundedPreceding, -1)
        first = F.coalesce(F.sum("n").over(before), F.lit(0))
        index = sizes.withColumn("first", first).select("file", "at", "first", "n")
        index.coalesce(1).write.parquet(f"{location}/index")
        return cls(spark, location)

    def count(self) -> int:
        return self.files.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def page(self, page: int, size: int, position: str | None = None) -> DataFrame:
        """Page ``page`` (from 0) of ``size`` rows, in order; ``position`` names a
        column for each row's number, from 1. A page beyond the end is empty."""
        if page < 0 or size < 1:
            raise ValueError("page counts from 0 and size from 1")
        low, high = page * size, (page + 1) * size
        met = self.files.filter((F.col("first") < high) & (F.col("first") + F.col("n") > low))
        parts = sorted(met.collect(), key=lambda r: r.first)
        out = [*[named(c) for c in self.columns]]
        if not parts:
            empty = self.spark.createDataFrame([], self.layout).select(*out)
            return empty.withColumn(position, F.lit(None).cast("long")) if position else empty
        rows = self.spark.read.schema(self.layout).parquet(*[r.file for r in parts])
        # files of a page follow each other, and so do the places inside a file
        start, last = parts[0], parts[-1]
        from_at = start.at + max(0, low - start.first)
        to_at = last.at + min(last.n, high - last.first)
        rows = rows.filter((F.col(_AT) >= from_at) & (F.col(_AT) < to_at)).orderBy(_AT)
        if position:
            shift = F.lit(parts[0].first - parts[0].at)
            for r in parts[1:]:
                shift = F.when(F.col(_AT) >= r.at, r.first - r.at).otherwise(shift)
            out.append((F.col(_AT) + shift + 1).alias(position))
        return rows.select(*out)
