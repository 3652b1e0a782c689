"""JSON Schema Draft-7 keywords compiled to Columns.

``record_checks`` walks a schema once on the driver and returns a list of
``Check``: a boolean Column that is true where a row breaks the keyword, with
path, keyword and message. Evaluating a schema is then one projection over the
batch, without any per-row Python.

Records are flat: paths are column names, ``""`` for errors of the whole row.
``format`` is an annotation and is not checked unless asked for.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.cells import Cell, number_of, text_cell, unquoted
from millrace.schema import TableSchema, as_list

ERROR = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("keyword", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)

# Opt-in format checks, as patterns.
FORMAT_PATTERNS = {
    "date": r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$",
    "date-time": (
        r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])[Tt ]"
        r"([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})?$"
    ),
    "time": r"^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})?$",
    "email": r"^[^@]+@[^@]+$",
    "uuid": r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
}


def no_errors() -> Column:
    return F.array().cast(T.ArrayType(ERROR))


@dataclass(frozen=True)
class Check:
    """``fails`` is never null. ``several`` lists errors of array elements when
    one keyword can fail more than once in a cell."""

    fails: Column
    path: str
    keyword: str
    message: Column
    several: Column | None = None

    def when(self, condition: Column) -> "Check":
        several = self.several
        if several is not None:
            several = F.when(condition, several)
        return Check(
            condition & self.fails, self.path, self.keyword, self.message, several
        )

    def error(self) -> Column:
        return F.when(
            self.fails,
            F.struct(
                F.lit(self.path).alias("path"),
                F.lit(self.keyword).alias("keyword"),
                self.message.alias("message"),
            ),
        )


def _true(column: Column | None) -> Column:
    """Null counts as not failing."""
    return F.lit(False) if column is None else F.coalesce(column, F.lit(False))


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def _valid(checks: list[Check]) -> Column:
    return ~_any([c.fails for c in checks])


def _present(column: Column | None) -> Column:
    return F.lit(False) if column is None else column.isNotNull()


def _type_test(cell: Cell, json_type: str) -> Column:
    if json_type in ("null", None):
        return cell.is_null
    if json_type == "string":
        return _present(cell.text)
    if json_type == "boolean":
        return _present(cell.boolean)
    if json_type == "array":
        return _present(cell.items)
    if json_type == "number":
        return _present(cell.number)
    if json_type == "integer":
        if cell.number is None:
            return F.lit(False)
        whole = cell.number == F.floor(cell.number)
        return cell.number.isNotNull() & F.coalesce(whole, F.lit(False))
    return F.lit(False)  # objects cannot occur in a flat record


def _equals(cell: Cell, value: Any) -> Column:
    """Cell equals a JSON value; booleans are not numbers."""
    if value is None:
        return cell.is_null
    if isinstance(value, bool):
        return _true(None if cell.boolean is None else cell.boolean == value)
    if isinstance(value, (int, float)):
        return _true(None if cell.number is None else cell.number == value)
    if isinstance(value, str):
        return _true(None if cell.text is None else cell.text == value)
    if isinstance(value, list) and cell.items is not None:
        same = F.size(cell.items) == len(value)
        for i, member in enumerate(value):
            same = same & _equals(cell.item(F.get(cell.items, F.lit(i))), member)
        return _true(same)
    return F.lit(False)


def _in_values(cell: Cell, values: list) -> Column:
    texts = [v for v in values if isinstance(v, str)]
    numbers = [v for v in values if isinstance(v, (int, float)) and not isinstance(v, bool)]
    others = [v for v in values if v not in texts and v not in numbers or isinstance(v, bool)]
    tests = [_equals(cell, v) for v in others]
    if texts and cell.text is not None:
        tests.append(_true(cell.text.isin(texts)))
    if numbers and cell.number is not None:
        tests.append(_true(cell.number.isin([float(v) for v in numbers])))
    return _any(tests)


def _quoted(cell: Cell) -> Column:
    """The value as messages show it."""
    if cell.text is None:
        return F.coalesce(cell.shown, F.lit("None"))
    return (
        F.when(cell.is_null, F.lit("None"))
        .when(cell.text.isNotNull(), F.concat(F.lit("'"), cell.text, F.lit("'")))
        .otherwise(cell.shown)
    )


def _says(cell: Cell, tail: str) -> Column:
    return F.concat(_quoted(cell), F.lit(" " + tail))


def _number_checks(cell: Cell, spec: Mapping, path: str) -> list[Check]:
    if cell.number is None:
        return []
    n = cell.number
    tests: dict[str, tuple[Callable[[Any], Column], str]] = {
        "minimum": (lambda v: n < v, "is less than the minimum of {}"),
        "maximum": (lambda v: n > v, "is greater than the maximum of {}"),
        "exclusiveMinimum": (
            lambda v: n <= v,
            "is less than or equal to the minimum of {}",
        ),
        "exclusiveMaximum": (
            lambda v: n >= v,
            "is greater than or equal to the maximum of {}",
        ),
        "multipleOf": (
            # A decimal step is compared as a quotient, as 0.3 % 0.1 is not 0.
            lambda v: n % v != 0
            if isinstance(v, int)
            else n / F.lit(float(v)) != F.floor(n / F.lit(float(v))),
            "is not a multiple of {}",
        ),
    }
    return [
        Check(_true(test(spec[k])), path, k, _says(cell, text.format(spec[k])))
        for k, (test, text) in tests.items()
        if k in spec
    ]


def _text_checks(cell: Cell, spec: Mapping, path: str, assert_format: bool) -> list[Check]:
    if cell.text is None:
        return []
    out = []
    if "minLength" in spec:
        out.append(
            Check(
                _true(F.char_length(cell.text) < spec["minLength"]),
                path,
                "minLength",
                _says(cell, "is too short"),
            )
        )
    if "maxLength" in spec:
        out.append(
            Check(
                _true(F.char_length(cell.text) > spec["maxLength"]),
                path,
                "maxLength",
                _says(cell, "is too long"),
            )
        )
    if "pattern" in spec:
        out.append(
            Check(
                _true(~cell.text.rlike(spec["pattern"])),
                path,
                "pattern",
                _says(cell, f"does not match {spec['pattern']!r}"),
            )
        )
    if assert_format and spec.get("format") in FORMAT_PATTERNS:
        out.append(
            Check(
                _true(~cell.text.rlike(FORMAT_PATTERNS[spec["format"]])),
                path,
                "format",
                _says(cell, f"is not a {spec['format']!r}"),
            )
        )
    return out


def _as_value(spec: Mapping):
    """An item as it counts for equality: unquoted, and by its value where the
    schema lets items be numbers, so that 1 equals 1.0."""
    kinds = spec.get("items", {}).get("type", ()) if isinstance(spec.get("items"), Mapping) else ()
    kinds = [kinds] if isinstance(kinds, str) else kinds
    numeric = bool({"number", "integer"} & set(kinds))

    def value(item: Column) -> Column:
        text = unquoted(item)
        number = number_of(text) if numeric else F.lit(None).cast("double")
        return F.struct(
            number.alias("number"), F.when(number.isNull(), text).alias("text")
        )

    return value


def _array_checks(schema, cell: Cell, spec: Mapping, path: str, assert_format) -> list[Check]:
    if cell.items is None:
        return []
    items = cell.items
    size = F.size(items)
    out = []

    def element_errors(element: Column, sub: Any) -> Column:
        checks = cell_checks(schema, cell.item(element), sub, path, assert_format)
        return F.filter(
            F.array(*[c.error() for c in checks]), lambda e: e.isNotNull()
        )

    def over_items(array: Column, sub: Any, keyword: str) -> None:
        sub = schema.resolve(sub)
        if sub is True or sub == {}:
            return
        if not cell_checks(schema, cell.item(F.lit(None).cast("string")), sub, path, assert_format):
            return
        errors = F.flatten(F.transform(array, lambda x: element_errors(x, sub)))
        out.append(
            Check(_true(F.size(errors) > 0), path, keyword, F.lit(""), several=errors)
        )

    if isinstance(spec.get("items"), list):
        for i, sub in enumerate(spec["items"]):
            over_items(F.slice(items, i + 1, 1), sub, "items")
        if "additionalItems" in spec:
            start = len(spec["items"]) + 1
            rest = F.when(
                size >= start, F.slice(items, F.lit(start), F.greatest(size, F.lit(1)))
            )
            over_items(rest, spec["additionalItems"], "additionalItems")
    elif "items" in spec:
        over_items(items, spec["items"], "items")
    if "minItems" in spec:
        out.append(
            Check(_true(size < spec["minItems"]), path, "minItems", _says(cell, "is too short"))
        )
    if "maxItems" in spec:
        out.append(
            Check(_true(size > spec["maxItems"]), path, "maxItems", _says(cell, "is too long"))
        )
    if spec.get("uniqueItems"):
        repeated = F.size(F.array_distinct(F.transform(items, _as_value(spec)))) < size
        out.append(
            Check(_true(repeated), path, "uniqueItems", _says(cell, "has non-unique elements"))
        )
    if "contains" in spec:
        found = F.exists(
            items,
            lambda x: _valid(
                cell_checks(schema, cell.item(x), spec["contains"], path, assert_format)
            ),
        )
        out.append(
            Check(
                _true(~found),
                path,
                "contains",
                _says(cell, "does not contain items matching the given schema"),
            )
        )
    return out


def _combined(parts: Callable[[Any], list[Check]], spec: Mapping, path: str, shown: Column):
    """allOf / anyOf / oneOf / not / if-then-else over sub-schemas."""
    out: list[Check] = []
    for sub in spec.get("allOf", []):
        out.extend(parts(sub))
    if "anyOf" in spec:
        passes = _any([_valid(parts(s)) for s in spec["anyOf"]])
        text = F.concat(shown, F.lit(" is not valid under any of the given schemas"))
        out.append(Check(~passes, path, "anyOf", text))
    if "oneOf" in spec:
        n = reduce(
            lambda a, b: a + b, [_valid(parts(s)).cast("int") for s in spec["oneOf"]]
        )
        text = F.concat(shown, F.lit(" is not valid under exactly one of the given schemas"))
        out.append(Check(n != 1, path, "oneOf", text))
    if "not" in spec:
        text = F.concat(shown, F.lit(" should not be valid under the given schema"))
        out.append(Check(_valid(parts(spec["not"])), path, "not", text))
    if "if" in spec:
        holds = _valid(parts(spec["if"]))
        if "then" in spec:
            out.extend(c.when(holds) for c in parts(spec["then"]))
        if "else" in spec:
            out.extend(c.when(~holds) for c in parts(spec["else"]))
    return out


def cell_checks(
    schema: TableSchema, cell: Cell, spec: Any, path: str, assert_format: bool = False
) -> list[Check]:
    """Checks of one value against one sub-schema."""
    spec = schema.resolve(spec)
    if spec is True:
        return []
    if spec is False:
        return [Check(F.lit(True), path, "false", _says(cell, "is not allowed"))]
    out = []
    if "type" in spec:
        allowed = as_list(spec["type"])
        passes = _any([_type_test(cell, t) for t in allowed])
        names = ", ".join(f"'{t}'" for t in allowed)
        out.append(Check(~passes, path, "type", _says(cell, f"is not of type {names}")))
    if "enum" in spec:
        out.append(
            Check(
                ~_in_values(cell, spec["enum"]),
                path,
                "enum",
                _says(cell, f"is not one of {spec['enum']!r}"),
            )
        )
    if "const" in spec:
        out.append(
            Check(
                ~_equals(cell, spec["const"]),
                path,
                "const",
                F.lit(f"{spec['const']!r} was expected"),
            )
        )
    out += _number_checks(cell, spec, path)
    out += _text_checks(cell, spec, path, assert_format)
    out += _array_checks(schema, cell, spec, path, assert_format)
    out += _combined(
        lambda sub: cell_checks(schema, cell, sub, path, assert_format),
        spec,
        path,
        _quoted(cell),
    )
    return out


def record_checks(
    schema: TableSchema,
    cells: Mapping[str, Cell],
    spec: Any = None,
    assert_format: bool = False,
) -> list[Check]:
    """Checks of a whole row. ``cells`` are the batch's data columns.

    Presence is a property of the frame: ``required`` fails for every row when
    the column is absent, and never for a null cell.
    """
    spec = schema.resolve(schema.document if spec is None else spec)
    if spec is True:
        return []
    whole = F.lit("the row")
    if spec is False:
        return [Check(F.lit(True), "", "false", F.lit("False schema does not allow the row"))]
    out: list[Check] = []
    if "type" in spec and "object" not in as_list(spec["type"]):
        out.append(Check(F.lit(True), "", "type", F.lit("the row is an object")))

    def checks_of(name: str, sub: Any) -> list[Check]:
        return cell_checks(schema, cells[name], sub, name, assert_format)

    properties = spec.get("properties", {})
    patterns = spec.get("patternProperties", {})
    for name, sub in properties.items():
        if name in cells:
            out += checks_of(name, sub)
    matched: set[str] = set()
    for pattern, sub in patterns.items():
        for name in cells:
            if re.search(pattern, name):
                matched.add(name)
                out += checks_of(name, sub)
    extra = [c for c in cells if c not in properties and c not in matched]
    additional = schema.resolve(spec.get("additionalProperties", True))
    if additional is False and extra:
        shown = ", ".join(f"'{c}'" for c in extra)
        verb = "was" if len(extra) == 1 else "were"
        text = f"Additional properties are not allowed ({shown} {verb} unexpected)"
        out.append(Check(F.lit(True), "", "additionalProperties", F.lit(text)))
    elif isinstance(additional, dict):
        for name in extra:
            out += checks_of(name, additional)
    for name in spec.get("required", []):
        if name not in cells:
            text = F.lit(f"'{name}' is a required property")
            out.append(Check(F.lit(True), "", "required", text))
    if len(cells) < spec.get("minProperties", 0):
        out.append(Check(F.lit(True), "", "minProperties", F.lit("too few properties")))
    if "maxProperties" in spec and len(cells) > spec["maxProperties"]:
        out.append(Check(F.lit(True), "", "maxProperties", F.lit("too many properties")))
    if "propertyNames" in spec:
        for name in cells:
            cell = text_cell(F.lit(name), [])
            out += cell_checks(schema, cell, spec["propertyNames"], "", assert_format)
    for name, need in spec.get("dependencies", {}).items():
        if name not in cells:
            continue
        if isinstance(need, list):
            for other in need:
                if other not in cells:
                    text = F.lit(f"'{other}' is a dependency of '{name}'")
                    out.append(Check(F.lit(True), "", "dependencies", text))
        else:
            out += record_checks(schema, cells, need, assert_format)
    out += _combined(
        lambda sub: record_checks(schema, cells, sub, assert_format), spec, "", whole
    )
    return out


def evaluated(df: DataFrame, checks: list[Check], prefix: str) -> tuple[DataFrame, list[Check]]:
    """Compute each check's verdict once, as helper columns.

    Plain verdicts stay inside whole-stage codegen. They leave through a
    one-row generator: Catalyst moves no filter below it, so a later filter on
    errors reads the verdicts instead of computing every check a second time.
    Verdicts over array items, which need lambda functions, form a projection
    of their own.
    """
    if not checks:
        return df, []
    plain = [
        c.fails.alias(f"v{i}") for i, c in enumerate(checks) if c.several is None
    ]
    items = [
        F.coalesce(c.several, no_errors()).alias(f"{prefix}{i}")
        for i, c in enumerate(checks)
        if c.several is not None
    ]
    verdicts = F.array(F.struct(*(plain or [F.lit(False).alias("none")])))
    df = df.select("*", F.explode_outer(verdicts).alias(prefix))
    if items:
        df = df.select("*", *items)
    done = []
    for i, c in enumerate(checks):
        if c.several is None:
            done.append(replace(c, fails=F.col(prefix).getField(f"v{i}")))
        else:
            column = F.col(f"{prefix}{i}")
            done.append(replace(c, fails=F.size(column) > 0, several=column))
    return df, done


def error_array(checks: list[Check]) -> Column:
    """All failing checks of a row as an array of (path, keyword, message).

    Messages are only built for rows where something fails.
    """
    if not checks:
        return no_errors()
    single = [c.error() for c in checks if c.several is None]
    parts = [F.filter(F.array(*single), lambda e: e.isNotNull())] if single else []
    parts += [c.several for c in checks if c.several is not None]
    errors = F.concat(*parts) if len(parts) > 1 else parts[0]
    return F.when(_any([c.fails for c in checks]), errors).otherwise(no_errors())
