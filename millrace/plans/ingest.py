"""The ingest flow: source file, mapper, validation, staging, review, commit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from millrace.operators.mapping import TableFrames
from millrace.operators.review import commit_reviewed, overlay_edits
from millrace.operators.staging import stage
from millrace.operators.validate import ERRORS, WARNINGS, error_rows, with_errors
from millrace.project import Project
from millrace.session import scratch_dir
from millrace.sources import files
from millrace.sources.csv import read_csv_source


@dataclass
class StagedTable:
    """One target table of a batch: ``Row``, ``_delete``, the cleaned data and
    the error arrays, all read back from a written copy."""

    table: str
    rows: DataFrame
    project: Project
    location: str

    def discard(self) -> None:
        """Delete the written copy, once the batch is committed or dropped."""
        files.delete(self.project.spark, self.location)

    def errors(self) -> DataFrame:
        return error_rows(self.rows)


def _checked(project: Project, table: str, df: DataFrame) -> DataFrame:
    schema = project.store.schema(table)
    relaxed = project.store.schema(table, relaxed=True)
    return with_errors(df, schema, relaxed, clean=True)


def stage_table(
    project: Project, table: str, df: DataFrame, order_by: Sequence[str] = ()
) -> StagedTable:
    """Clean, validate and number a batch in one pass over its source. Review
    steps and the commit then scan the written result."""
    path = scratch_dir(project.spark, "staged")
    rows = stage(_checked(project, table, df), order_by, path)
    return StagedTable(table, rows, project, path)


def apply_edits(staged: StagedTable, edits: DataFrame, order_by: str | None = None) -> StagedTable:
    """Put a reviewer's edited rows in place, then clean and validate again."""
    base = staged.rows.drop(ERRORS, WARNINGS)
    edited = overlay_edits(base, edits, order_by=order_by)
    checked = _checked(staged.project, staged.table, edited)
    path = scratch_dir(staged.project.spark, "edited")
    checked.write.parquet(path)
    rows = staged.project.spark.read.schema(checked.schema).parquet(path)
    return StagedTable(staged.table, rows, staged.project, path)


def ingest(
    project: Project, mapper: str, source: DataFrame | str, table: str = "table"
) -> TableFrames:
    """Stage a source into each target its mapper names: (table, StagedTable)
    pairs, one for every frame of the mapper."""
    if isinstance(source, str):
        source = read_csv_source(project.spark, source)
    targets = project.run_mapper(mapper, source, table)
    return TableFrames((name, stage_table(project, name, df)) for name, df in targets)


def commit(project: Project, staged: TableFrames, **options):
    """Commit the rows that review has left unmarked."""
    return commit_reviewed(project.store, [(name, s.rows) for name, s in staged], **options)
