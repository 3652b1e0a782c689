"""Source-to-target mapping.

A ``Mapping`` says, per target column, which source column feeds it, which
values are replaced and which date spelling is rewritten. It is applied as one
projection. Mappings are kept as tables and can be checked for gaps.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping as MappingType, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.names import named

# Strftime directives and their Spark spelling.
DATE_DIRECTIVES = {
    "%d": "dd",
    "%m": "MM",
    "%Y": "yyyy",
    "%y": "yy",
    "%H": "HH",
    "%M": "mm",
    "%S": "ss",
    "%b": "MMM",
    "%B": "MMMM",
    "%I": "hh",
    "%p": "a",
    "%j": "DDD",
    "%f": "SSSSSS",
    "%T": "HH:mm:ss",
    "%F": "yyyy-MM-dd",
}

MAPPING_LAYOUT = T.StructType(
    [
        T.StructField("target_field", T.StringType()),
        T.StructField("source_field", T.StringType()),
        T.StructField("values", T.MapType(T.StringType(), T.StringType())),
        T.StructField("keep_unmatched", T.BooleanType()),
        T.StructField("date_format", T.StringType()),
    ]
)


@dataclass(frozen=True)
class FieldMap:
    source: str
    values: MappingType[str, str] = field(default_factory=dict)
    keep_unmatched: bool = True
    date_format: str | None = None


def spark_date_format(fmt: str) -> str:
    """Accept strftime spelling as well as Spark's."""
    if "%" not in fmt:
        return fmt
    out = []
    for part in re.findall(r"%.?|[^%]+", fmt, re.S):
        if part == "%%":
            out.append("%")
        elif part[0] == "%":
            if part not in DATE_DIRECTIVES:
                raise ValueError(
                    f"unknown date directive {part!r} in {fmt!r}; known: {' '.join(DATE_DIRECTIVES)}"
                )
            out.append(DATE_DIRECTIVES[part])
        else:  # letters stand for themselves, so they are quoted
            out.append(re.sub(r"[A-Za-z]+", r"'\g<0>'", part.replace("'", "''")))
    return "".join(out)


def map_dates(column: Column, fmt: str) -> Column:
    """ISO dates from text in the given format; unreadable text becomes null."""
    parsed = F.try_to_timestamp(column, F.lit(spark_date_format(fmt)))
    return F.date_format(parsed, "yyyy-MM-dd")


def map_values(
    column: Column, values: MappingType[str, str], keep_unmatched: bool = True
) -> Column:
    """Replace values by a small dictionary, carried in the plan itself."""
    if not values:
        return column
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    text = column.cast("string")
    found = F.element_at(F.create_map(*pairs), text)
    return F.coalesce(found, text) if keep_unmatched else found


def map_values_table(
    df: DataFrame,
    column: str,
    dictionary: DataFrame,
    keep_unmatched: bool = True,
) -> DataFrame:
    """Replace values by a dictionary table (value, replacement), by join.

    The dictionary is reduced to one row per value first, so it cannot
    multiply rows; Catalyst broadcasts it when its size allows.
    """
    value, replacement = dictionary.columns[:2]
    side = dictionary.groupBy(named(value).alias("__value")).agg(
        F.min(named(replacement)).alias("__replacement")
    )
    joined = df.join(side, named(column) == F.col("__value"), "left")
    new = F.col("__replacement")
    if keep_unmatched:
        new = F.coalesce(new, named(column))
    return joined.select(
        *[new.alias(c) if c == column else named(c) for c in df.columns]
    )


def as_field_map(rule: "FieldMap | str") -> FieldMap:
    return FieldMap(rule) if isinstance(rule, str) else rule


def apply_mapping(df: DataFrame, mapping: MappingType[str, "FieldMap | str"]) -> DataFrame:
    """Target columns only, each from its source column."""
    out = []
    for target, rule in mapping.items():
        rule = as_field_map(rule)
        column = map_values(named(rule.source), rule.values, rule.keep_unmatched)
        if rule.date_format:
            column = map_dates(column, rule.date_format)
        out.append(column.alias(target))
    return df.select(*out)


class TableFrames(list):
    """(table, frame) pairs in order. A table may occur several times, and each of
    its frames counts; ``pairs["t"]`` is the frame of a table that occurs once."""

    def __getitem__(self, key):
        if not isinstance(key, str):
            return super().__getitem__(key)
        found = [frame for table, frame in self if table == key]
        if len(found) != 1:
            raise KeyError(f"{len(found)} frames for table '{key}' among {[t for t, _ in self]}")
        return found[0]


Mapper = Callable[[DataFrame], "TableFrames | dict[str, DataFrame] | DataFrame"]


def multi_table(
    mappings: MappingType[str, MappingType] | Sequence[tuple[str, MappingType]],
) -> Mapper:
    """A mapper sending one source to several target tables. Given as pairs, two
    mappings may feed one table."""
    pairs = list(mappings.items() if isinstance(mappings, MappingType) else mappings)

    def mapper(df: DataFrame) -> TableFrames:
        return TableFrames((table, apply_mapping(df, m)) for table, m in pairs)

    return mapper


def as_tables(result, default: str = "table") -> TableFrames:
    """Normalise what a mapper returned: a dict of frames, one frame, pairs, or a
    list of ``{"table": ..., "data": ...}`` (``database`` is an older name)."""
    if isinstance(result, DataFrame):
        return TableFrames([(default, result)])
    if isinstance(result, dict) and "data" in result:
        result = [result]
    if isinstance(result, dict):
        return TableFrames(result.items())
    return TableFrames(
        (item.get("table", item.get("database")), item["data"])
        if isinstance(item, dict)
        else tuple(item)
        for item in result
    )


def mapping_clean(mapping: DataFrame) -> DataFrame:
    """Blank cells as null, rows without a target field removed."""
    cells = [
        F.when(~named(f.name).rlike(r"^\s*$"), named(f.name)).alias(f.name)
        if isinstance(f.dataType, T.StringType)
        else named(f.name)
        for f in mapping.schema.fields
    ]
    cleaned = mapping.select(*cells)
    return cleaned.filter(F.col("target_field").isNotNull())


def unmapped_fields(schema_fields: DataFrame, mapping: DataFrame) -> DataFrame:
    """Schema fields without a source: (target_field, path, message). The path
    names the mapping's column that has to be filled in."""
    mapped = (
        mapping_clean(mapping)
        .filter(F.col("source_field").isNotNull())
        .select(F.col("target_field").alias("__target"))
        .distinct()
    )
    name = schema_fields.columns[0]
    return schema_fields.join(mapped, named(name) == F.col("__target"), "left_anti").select(
        named(name).alias("target_field"),
        F.lit("source_field").alias("path"),
        F.concat(named(name), F.lit(" has not been mapped")).alias("message"),
    )


def require_descriptions(dictionary: DataFrame, column: str = "description") -> DataFrame:
    """Refuse a data dictionary with a missing description."""
    blank = named(column).isNull() | named(column).rlike(r"^\s*$")
    if not dictionary.filter(blank).isEmpty():
        raise ValueError(
            "every field of the data dictionary needs a description before mapping"
        )
    return dictionary


def mapping_frame(spark, mapping: MappingType[str, "FieldMap | str"]) -> DataFrame:
    """A mapping as a table, ready to be stored."""
    rows = []
    for target, rule in mapping.items():
        rule = as_field_map(rule)
        if rule.date_format:
            spark_date_format(rule.date_format)  # refuse unknown directives now
        rows.append(
            (target, rule.source, dict(rule.values), rule.keep_unmatched, rule.date_format)
        )
    return spark.createDataFrame(rows, MAPPING_LAYOUT)


def mapping_from_table(table: DataFrame) -> dict[str, FieldMap]:
    """Read a stored mapping back. It has one row per target column."""
    cleaned = mapping_clean(table).filter(F.col("source_field").isNotNull())
    out = {}
    for row in cleaned.collect():
        item = row.asDict()
        out[item["target_field"]] = FieldMap(
            item["source_field"],
            item.get("values") or {},
            item.get("keep_unmatched") is not False,
            item.get("date_format"),
        )
    return out


def source_columns(mappings: Sequence[MappingType]) -> list[str]:
    """Source columns any of the mappings reads."""
    return list(
        dict.fromkeys(
            as_field_map(r).source for m in mappings for r in m.values()
        )
    )
