"""Reports over stored tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.names import named

Report = Callable[..., DataFrame]


class MissingDataset(ValueError):
    pass


class ReportRegistry:
    """Report functions by name, each with the tables it asks for."""

    def __init__(self):
        self._reports: dict[str, tuple[tuple[str, ...], Report]] = {}

    def report(self, name: str, datasets: Sequence[str]):
        def register(function: Report) -> Report:
            self._reports[name] = (tuple(datasets), function)
            return function

        return register

    def names(self) -> list[str]:
        return sorted(self._reports)

    def run(self, name: str, available: Sequence[str], read: Callable[[str], DataFrame]):
        """Call a report with its tables, bound by name."""
        if name not in self._reports:
            raise KeyError(f"no report '{name}'; there are {self.names()}")
        datasets, function = self._reports[name]
        missing = [d for d in datasets if d not in available]
        if missing:
            raise MissingDataset(
                f"report '{name}' requests {list(datasets)}, available are {list(available)}"
            )
        return function(**{d: read(d) for d in datasets})


def series(
    df: DataFrame, date: str, category: str, value: str | None = None, unit: str | None = None
) -> DataFrame:
    """Value over date per category: a sum, or a row count without ``value``."""
    when = named(date) if unit is None else F.date_trunc(unit, named(date))
    measure = F.count(F.lit(1)) if value is None else F.sum(named(value))
    return df.groupBy(when.alias("date"), named(category).alias("category")).agg(
        measure.alias("value")
    )


def summary(df: DataFrame, by: Sequence[str], measures: Mapping[str, str]) -> DataFrame:
    """Row count plus ``{output: "min(col)"}`` style measures per group."""
    return df.groupBy(*[named(c) for c in by]).agg(
        F.count(F.lit(1)).alias("n"), *[F.expr(m).alias(a) for a, m in measures.items()]
    )
