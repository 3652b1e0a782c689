"""Tabular ingest, validation, merge and query jobs on PySpark."""

from millrace.project import Project
from millrace.schema import TableSchema
from millrace.sources.store import Backend, BackupPolicy, TableStore, WritePolicy

__all__ = [
    "Backend",
    "BackupPolicy",
    "Project",
    "TableSchema",
    "TableStore",
    "WritePolicy",
]
