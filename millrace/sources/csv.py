"""CSV in and out."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.cells import array_to_text
from millrace.functions.names import named
from millrace.operators.review import kept_rows
from millrace.sources import files

# Cell texts that mean "missing" in a source file. Lower-case
# 'none' is not among them.
MISSING = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]


def missing_to_null(df: DataFrame, tokens: Sequence[str] = MISSING) -> DataFrame:
    """Cells that spell a missing value as null. Whole cells only, no trimming."""
    tokens = list(tokens)
    return df.select(
        *[
            F.when(~named(f.name).isin(tokens), named(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else named(f.name)
            for f in df.schema.fields
        ]
    )


_RECORD = "__record"  # the text of a record with another number of cells
#: Up to so many files are looked at one by one; the lines of more in one parallel pass.
_FEW = 64
_OPTIONS = {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _RECORD}


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Raw lines with their file and the byte range (of a task) they were read in."""
    return spark.read.option("lineSep", "\n").text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def _quotes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))


def _verdicts() -> list[Column]:
    """Of a file's lines: whether some has an odd number of quotes, so that a record
    may span lines; whether some has a quote inside a cell without quotes, so that
    quotes do not tell records."""
    line = F.col("value")
    quoted = line.contains('"')
    return [
        F.bool_or(quoted & (_quotes(line) % 2 == 1)).alias("spans"),
        F.bool_or(quoted & line.rlike(r'[^",]"[^",\r]')).alias("stray"),
    ]


def _largest_whole(spark: SparkSession, total: int) -> int:
    """Bytes up to which Spark does not split a file of a scan of ``total`` bytes."""
    conf = spark._jsparkSession.sessionState().conf()
    spread = int(spark.sparkContext.defaultParallelism)
    return min(int(conf.filesMaxPartitionBytes()), max(int(conf.filesOpenCostInBytes()), total // max(1, spread)))


def _kinds(spark: SparkSession, paths: str | list[str], multi_line: bool | None) -> list[tuple[list[str], str, bool]]:
    """Files grouped by their header line, with whether it ends in a carriage return, and by how they are read: ``whole`` (a file
    is one task, records may span lines), ``lines`` (split, no record spans lines) or
    ``cut`` (split, lines are put together to records).

    A file that is one task anyway is read whole, unseen. Larger ones are split: their
    lines are looked through first, unless ``multi_line`` tells what is in them."""
    names = sorted(unquote(n) for n in spark.read.text(paths).inputFiles())
    if len(names) > _FEW:
        lines = _lines(spark, paths).withColumn("at", F.monotonically_increasing_id())
        first = F.when((F.col("block") == 0) & (F.trim("value") != ""), F.struct("block", "at"))
        head = F.min_by("value", first)
        seen = lines.groupBy("file").agg(
            head.alias("head"), F.max("block").alias("last"), *_verdicts()
        )
        found = [(unquote(r.file), r.head or "", r.last > 0, r.spans, r.stray) for r in seen.orderBy("file").collect()]
    else:
        sizes = {n: files.length(spark, n) for n in names}
        whole = _largest_whole(spark, sum(sizes.values()))
        large = [n for n in names if sizes[n] > whole and not files.is_compressed(spark, n)]
        spans, stray = set(), set()
        if large and multi_line is not False:
            seen = _lines(spark, large).groupBy("file").agg(*_verdicts())
            at = {_bare(quote(n)): n for n in large}
            for row in seen.collect():
                spans |= {at[_bare(row.file)]} if row.spans else set()
                stray |= {at[_bare(row.file)]} if row.stray else set()
        heads = [(n, files.first_line(spark, n)) for n in names if sizes[n]]
        found = [(n, head or "", n in large, n in spans, n in stray) for n, head in heads]
    groups: dict[tuple[str, str], list[str]] = {}
    for file, head, split, spans, stray in found:
        if multi_line is False or (split and not spans):
            how = "lines"
        else:
            plain = not stray and "\r" not in head[:-1] and head.count('"') % 2 == 0
            how = "cut" if split and plain else "whole"
        groups.setdefault((head, how), []).append(file)
    return [(group, how, head.endswith("\r")) for (head, how), group in groups.items()]


def _bare(name: str) -> str:
    """A file's decoded name; Spark gives it with one slash or three after ``file:``."""
    return re.sub(r"^(\w+:)/+", r"\1/", unquote(name))


def _records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of files in which they may span lines, one row ``record`` each, without
    the first of each file, its header.

    Whether a byte range begins inside quotes follows from the number of quotes before
    it: one row a range is summed up and comes back beside the lines. A task then puts
    lines together until their quotes are even. What a range does not hold whole, at
    most its first and its last record, meets by record in a shuffle of these pieces.
    """
    lines = _lines(spark, paths)
    ranges = lines.groupBy("file", "block").agg(F.sum(_quotes(F.col("value"))).alias("quotes"))
    before = F.sum("quotes").over(Window.partitionBy("file").orderBy("block")) - F.col("quotes")
    inside = ranges.select("file", "block", (before % 2 == 1).alias("inside"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Nested, and without names of this module, so that tasks need no package.
        range_of, open_, carry, fresh, header = None, False, [], False, False

        def rows(texts, kind):
            file, block = range_of
            n = len(texts)
            columns = [pa.array([file] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array([kind] * n, pa.int32())]
            return pa.record_batch([*columns, pa.array(texts, pa.string())], ["file", "block", "kind", "record"])

        for batch in batches:
            file = batch.column(0).dictionary_encode()
            codes, blocks = file.indices.to_numpy(), batch.column(1).to_numpy()
            starts = np.flatnonzero(np.append(True, (np.diff(codes) != 0) | (np.diff(blocks) != 0))) if len(batch) else []
            for begin, end in zip(starts, [*starts[1:], len(batch)], strict=True):
                here = (file[int(begin)].as_py(), int(blocks[begin]))
                if here != range_of:
                    if carry:
                        yield rows(["\n".join(carry)], 1 if fresh else 2)
                    range_of, carry = here, []
                    open_ = batch.column(2)[int(begin)].as_py()
                    fresh = not open_
                    header = here[1] == 0
                values = batch.column(3).slice(int(begin), int(end - begin))
                odd = (np.cumsum(pc.count_substring(values, '"').to_numpy()) + open_) % 2
                stops = np.flatnonzero(odd == 0) + 1
                if not len(stops):
                    carry += values.to_pylist()
                    open_ = True
                    continue
                first, rest = int(stops[0]), int(stops[-1])
                text = "\n".join([*carry, *values.slice(0, first).to_pylist()])
                if not header:
                    yield rows([text], 0 if fresh else 2)
                header, fresh = header and not text.strip(), True
                while header and first < rest:  # blank lines before the header
                    first, stops = int(stops[1]), stops[1:]
                    header = not values[first - 1].as_py().strip()
                lists = pa.ListArray.from_arrays(pa.array(stops - first, pa.int32()), values.slice(first, rest - first))
                yield rows(pc.binary_join(lists, "\n"), 0)
                carry = values.slice(rest).to_pylist()
                open_ = bool(carry)
        if carry:
            yield rows(["\n".join(carry)], 1 if fresh else 2)

    placed = lines.join(F.broadcast(inside), ["file", "block"]).select("file", "block", "inside", "value")
    parts = placed.mapInArrow(cut, "file string, block long, kind int, record string")
    whole = parts.filter("kind = 0").select("record")
    order = Window.partitionBy("file").orderBy("block", F.desc("kind"))
    pieces = parts.filter("kind > 0").withColumn("number", F.sum((F.col("kind") == 1).cast("long")).over(order))
    at = F.array_sort(F.collect_list(F.struct("block", -F.col("kind"), "record")))
    joined = pieces.groupBy("file", "number").agg(
        F.array_join(F.transform(at, lambda p: p["record"]), "\n").alias("record")
    )
    return whole.unionByName(joined.select("record"))


def _cut_rows(spark: SparkSession, paths: list[str], layout: T.StructType, windows: bool) -> DataFrame:
    record = F.regexp_replace("record", r"\r$", "")
    if windows:  # as when such a file is read whole
        record = F.replace(record, F.lit("\r\n"), F.lit("\n"))
    records = _records(spark, paths).withColumn("record", record)
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` string" for f in layout.fields)
    cells = F.from_csv("record", ddl, _OPTIONS).alias("cells")
    return records.filter(F.trim("record") != "").select(cells).select(*[F.col("cells").getField(f.name).alias(f.name) for f in layout.fields])


def _no_surplus(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Fail on records with more cells than there are names."""
    single = F.replace(F.col(_RECORD), F.lit('""'), F.lit(""))  # cells have no quotes inside them now
    unquoted = F.regexp_replace(single, '"[^"]*+"?', "")
    cells = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(","), F.lit(""))) + 1
    refused = F.raise_error(
        F.concat(F.lit(f"more than {len(names)} cells in the record: "), F.col(_RECORD))
    ).cast("boolean")
    # a data column is named beside the record, since Spark refuses to read the latter alone
    surplus = (cells > len(names)) & F.coalesce(named(names[0]) == named(names[0]), F.lit(True))
    return rows.filter(F.when(surplus, refused).otherwise(F.lit(True))).drop(_RECORD)


def read_csv_source(
    spark: SparkSession,
    path: str | Sequence[str],
    multi_line: bool | None = None,
    missing: Sequence[str] = MISSING,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """CSV files with a header, all columns as text, missing tokens as null.

    Types come later from the target schema, not from sampling the file. Several
    files are brought together by the names in their headers, whatever their
    order; a column that a file lacks is null there. A record with fewer cells
    than the header is filled up with nulls, one with more fails the job.

    Files larger than a task's share are split, also where records span lines
    (quotes stand around cells and doubled inside them; a file with other quotes, or
    with a header over several lines, is read whole). ``multi_line=None`` looks
    through the lines of such files first; ``False`` promises that no record spans
    lines and ``True`` that some may. With ``columns`` every header has to give these
    names in this order.
    """
    paths = path if isinstance(path, str) else list(path)
    out = None
    for group, how, windows in _kinds(spark, paths, multi_line):
        reader = (
            spark.read.options(**_OPTIONS)
            .option("header", True)
            .option("inferSchema", False)
            .option("multiLine", how == "whole")
            .option("columnPruning", False)  # else cells left out are not counted
        )
        names = reader.csv(group[:1]).columns
        if columns is not None and names != list(columns):
            raise ValueError(f"{group[0]} has the columns {names}, expected {list(columns)}")
        layout = T.StructType([T.StructField(c, T.StringType()) for c in [*names, _RECORD]])
        if how == "cut":
            rows = _cut_rows(spark, group, layout, windows)
        else:
            rows = reader.schema(layout).csv(group)
        rows = _no_surplus(rows, names)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:  # no lines at all
        layout = [T.StructField(c, T.StringType()) for c in columns or []]
        return spark.createDataFrame([], T.StructType(layout))
    return missing_to_null(out, missing)


def write_csv(df: DataFrame, path: str, keep_helpers: bool = False) -> str:
    """Export a table, or a staged batch without rejected rows and helpers.

    Executors write one file each; arrays become ``[a, b]`` text.
    """
    out = df if keep_helpers else kept_rows(df, "Row")
    out = out.select(
        *[
            array_to_text(named(f.name)).alias(f.name)
            if isinstance(f.dataType, T.ArrayType)
            else named(f.name)
            for f in out.schema.fields
        ]
    )
    out.write.option("header", True).option("escape", '"').csv(path)
    return path
