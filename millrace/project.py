"""A project: one root folder with schemas, tables, mappers and reports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.operators.mapping import (
    Mapper,
    TableFrames,
    apply_mapping,
    as_tables,
    mapping_frame,
    mapping_from_table,
)
from millrace.operators.reports import ReportRegistry
from millrace.operators.sql import sql_query
from millrace.sources import files
from millrace.sources.store import TableStore


class Project:
    def __init__(self, spark: SparkSession, root: str, **store_options):
        self.spark = spark
        self.root = root.rstrip("/")
        self.store = TableStore(spark, root, **store_options)
        self.reports = ReportRegistry()
        self._mappers: dict[str, Mapper] = {}

    # -- mappers: user functions over whole frames -----------------------------

    def mapper(self, name: str) -> Callable[[Mapper], Mapper]:
        def register(function: Mapper) -> Mapper:
            self._mappers[name] = function
            return function

        return register

    def mappers(self) -> list[str]:
        stored = files.names(self.spark, f"{self.root}/mappings")
        return sorted({*self._mappers, *stored})

    def run_mapper(self, name: str, source: DataFrame, table: str = "table"):
        """(table, frame) pairs. Stored mappings are mappers too."""
        if name in self._mappers:
            return as_tables(self._mappers[name](source), table)
        return TableFrames([(table, apply_mapping(source, self.load_mapping(name)))])

    def save_mapping(self, name: str, mapping) -> None:
        """Store a mapping (a dict of rules, or a mapping table), as a new edition:
        readers see the old one until the new one is complete."""
        if isinstance(mapping, DataFrame):
            frame = mapping
        else:
            frame = mapping_frame(self.spark, mapping)
        folder, tag = f"{self.root}/mappings/{name}", uuid.uuid4().hex[:12]
        frame.write.parquet(f"{folder}/edition-{tag}")
        number = len(self._editions(name)) + 1
        while True:
            try:
                entry = f"{folder}/_log/{number:06d}.json"
                files.publish_text(self.spark, entry, json.dumps(f"edition-{tag}"), tag)
                return
            except files.FileExists:  # saved by someone else meanwhile
                number += 1

    def _editions(self, name: str) -> list[str]:
        listed = files.names(self.spark, f"{self.root}/mappings/{name}/_log")
        return [n for n in listed if n[0].isdigit()]

    def load_mapping(self, name: str):
        folder, editions = f"{self.root}/mappings/{name}", self._editions(name)
        if not editions:
            raise KeyError(f"no mapper '{name}'; there are {self.mappers()}")
        part = json.loads(files.read_text(self.spark, f"{folder}/_log/{editions[-1]}"))
        return mapping_from_table(self.spark.read.parquet(f"{folder}/{part}"))

    # -- queries and reports -----------------------------------------------------

    def datasets(self) -> list[str]:
        return self.store.tables()

    def sql(self, query: str, *tables: str) -> DataFrame:
        """Read-only SQL over the named tables, or all of them."""
        wanted = tables or self.store.tables()
        return sql_query(self.spark, query, {t: self.store.read_table(t) for t in wanted})

    def run_report(self, name: str) -> DataFrame:
        return self.reports.run(name, self.store.tables(), self.store.read_table)
