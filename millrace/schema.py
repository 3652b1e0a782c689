"""Target-table schemas: JSON Schema documents read as storage rules."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import types as T

# Which JSON types are tried, in this order, for the stored type.
STORED_AS = [
    ("string", T.StringType()),
    ("integer", T.LongType()),
    ("number", T.DoubleType()),
    ("boolean", T.BooleanType()),
    ("array", T.StringType()),
]

# Stored types of string formats under storage="typed".
FORMATS = {
    "date": T.DateType(),
    "date-time": T.TimestampNTZType(),
    "time": T.TimeType(),
}


def as_list(value: Any) -> list:
    return list(value) if isinstance(value, (list, tuple)) else [value]


class TableSchema:
    """One table's JSON Schema.

    ``storage="text"`` keeps dates and arrays as text; ``"typed"`` stores
    dates, timestamps, times and string arrays in their own Spark types.
    """

    def __init__(self, document: dict | str, storage: str = "text"):
        if isinstance(document, str):
            document = json.loads(document)
        if not isinstance(document, dict):
            raise ValueError(
                f"a schema is a dictionary or JSON text, not {type(document).__name__}"
            )
        if storage not in ("text", "typed"):
            raise ValueError(f"unknown storage {storage!r}")
        self.document = document
        self.storage = storage

    @property
    def fields(self) -> dict[str, dict]:
        return self.document.get("properties", {})

    @property
    def columns(self) -> list[str]:
        return list(self.fields)

    @property
    def required(self) -> list[str]:
        return list(self.document.get("required", []))

    @property
    def key(self) -> str | None:
        """The column marked ``PrimaryKey``, if any."""
        marked = [n for n, spec in self.fields.items() if spec.get("PrimaryKey")]
        if len(marked) > 1:
            raise ValueError(f"more than one primary key: {marked}")
        return marked[0] if marked else None

    def resolve(self, spec: Any) -> Any:
        """Follow a local ``$ref`` (``#/definitions/...``)."""
        seen: set[str] = set()
        while isinstance(spec, dict) and "$ref" in spec:
            ref = spec["$ref"]
            if not ref.startswith("#") or ref in seen:
                raise ValueError(f"only acyclic local references work: {ref!r}")
            seen.add(ref)
            spec = self.document
            for part in ref.lstrip("#/").split("/") if ref != "#" else []:
                spec = spec[part.replace("~1", "/").replace("~0", "~")]
        return spec

    def json_types(self, name: str) -> list[str]:
        spec = self.resolve(self.fields.get(name, {}))
        return [
            "null" if t is None else t for t in as_list(spec.get("type", [])) or []
        ]

    def nullable(self, name: str) -> bool:
        spec = self.resolve(self.fields.get(name, {}))
        allowed = self.json_types(name) + as_list(spec.get("enum", []))
        return bool(spec.get("nullable")) or None in allowed or "null" in allowed

    def spark_type(self, name: str) -> T.DataType:
        spec = self.resolve(self.fields.get(name, {}))
        declared = self.json_types(name)
        for json_type, stored in STORED_AS:
            if json_type in declared:
                if self.storage == "typed":
                    if json_type == "string":
                        return FORMATS.get(spec.get("format"), stored)
                    if json_type == "array":
                        return T.ArrayType(T.StringType())
                return stored
        return T.StringType()

    def struct(self, names: Sequence[str] | None = None) -> T.StructType:
        """Stored layout. All columns read back nullable from Parquet, so
        nullability is checked by validation rather than declared here."""
        wanted = self.columns if names is None else names
        return T.StructType(
            [T.StructField(n, self.spark_type(n), True) for n in wanted]
        )
