"""Column references by exact name."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """A column by its exact name; spaces and dots need no care."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_of(names: Iterable[str]) -> Column:
    """The named columns as one struct."""
    return F.struct(*[named(n) for n in names])


def key_list(key: str | Sequence[str] | None) -> list[str]:
    if key is None:
        return []
    return [key] if isinstance(key, str) else list(key)
