"""Helpers the operators share: row packing, word splitting, materialising."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import scratch_dir

#: White space of the word and line rules: space and \x09-\x0D. ``bytes.split()``
#: and ``bytes.strip()`` use the same six characters.
SPACE = " \t\n\x0b\x0c\r"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"


def column(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, **parts: Column) -> DataFrame:
    """The whole input row as one struct ``row`` beside the named parts, so that
    no working column can clash with a column of the input."""
    row = F.struct(*[column(c).alias(c) for c in df.columns])
    return df.select(row.alias("row"), *[c.alias(n) for n, c in parts.items()])


def unpacked(df: DataFrame, *added: str, **renamed: Column) -> DataFrame:
    """Input columns again, followed by the added ones. An added column takes the
    place of an input column of the same name (case is ignored)."""
    new = {**{a: F.col(a) for a in added}, **renamed}
    taken = {n.lower() for n in new}
    kept = [f.name for f in df.schema["row"].dataType.fields if f.name.lower() not in taken]
    return df.select(
        *[F.col("row").getField(c).alias(c) for c in kept],
        *[c.alias(n) for n, c in new.items()],
    )


def ascii_lower(c: Column) -> Column:
    """A-Z to lower case, every other character as it is."""
    return F.translate(c, _UPPER, _UPPER.lower())


def word_count(c: Column) -> Column:
    """Number of words (runs without white space); null has none."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def saved(df: DataFrame, label: str) -> DataFrame:
    """The frame written to the cluster's shared scratch folder and read again:
    it is computed once, its size is known, and no executor holds the only copy."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def portions(texts: pa.Array, size: int = 4_000_000) -> Iterator[slice]:
    """Row ranges of a batch with about ``size`` bytes of text each; a longer text
    is a range of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(texts):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + size, "right")))
        yield slice(begin, end)
        begin = end


def own_copy(texts: pa.Array) -> pa.Array:
    """The texts in buffers of their own: some of Arrow's text functions misread an
    array that is a slice of another."""
    return texts.take(pa.array(np.arange(len(texts))))


# Archives by application; they are served as long as the interpreter lives.
_shipped: dict[str, tempfile.TemporaryDirectory] = {}


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that jobs run
    on clusters where it is not installed."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        folder = _shipped[context.applicationId] = tempfile.TemporaryDirectory()
        archive = f"{folder.name}/{package.name}"
        context.addPyFile(shutil.make_archive(archive, "zip", package.parent, package.name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table, with the package at hand on the executors."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
