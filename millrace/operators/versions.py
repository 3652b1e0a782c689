"""Row version history, kept append-only.

A history frame holds the data columns plus ``_version``, ``_deleted``,
``_metadata`` and, in the store, ``_seq`` (row order inside a commit, which
breaks ties between repeats of a key). New versions are only ever added; old
rows are never rewritten. Everything per key is a grouped aggregate or an
equi-join on key. Aggregates of texts sort within tasks, combine there, and sort
again after the shuffle, which carries one row per key and task.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.names import key_list, named, row_of
from millrace.operators.merge import unseen, with_keys

SEQ = "_seq"
HISTORY = ["_version", "_deleted", "_metadata"]


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in HISTORY and c != SEQ]


def row_metadata(commit_time: str, **extra: str) -> str:
    return json.dumps({"timestamp": commit_time, **extra})


def _stamp(df: DataFrame, version: Column, commit_time: str, deleted: bool = False):
    return df.select(
        *[named(c) for c in data_columns(df)],
        version.cast("long").alias("_version"),
        F.lit(deleted).alias("_deleted"),
        F.lit(row_metadata(commit_time)).alias("_metadata"),
        *([F.col(SEQ)] if SEQ in df.columns else []),
    )


def first_versions(batch: DataFrame, commit_time: str) -> DataFrame:
    """Every row as version 1."""
    return _stamp(batch, F.lit(1), commit_time)


def append_versions(history: DataFrame, batch: DataFrame, key, commit_time: str):
    """New rows for keys never seen in any version, even a deleted one."""
    keys = key_list(key)
    fresh = unseen(batch, history, keys) if keys else batch
    return first_versions(fresh, commit_time)


def _order(df: DataFrame) -> Column:
    return row_of(["_version", SEQ] if SEQ in df.columns else ["_version"])


def _latest(history: DataFrame, keys: Sequence[str], columns: Sequence[str]):
    return history.groupBy(*[named(k) for k in keys]).agg(
        F.max("_version").alias("__version"),
        F.max_by(row_of([*columns, "_deleted"]), _order(history)).alias("__last"),
    )


def newest(history: DataFrame, key) -> DataFrame:
    """Of each key the newest row and, where that deletes, the newest live one too:
    what the current view, in either mode, and the next commit need to know.

    Rows without a whole key have no successor and all stay."""
    keys, order = key_list(key), _order(history)
    rest = [c for c in history.columns if c not in keys]
    known = reduce(lambda a, b: a & b, [named(k).isNotNull() for k in keys])
    row, live = row_of(rest), ~F.col("_deleted")
    tops = history.filter(known).groupBy(*[named(k) for k in keys]).agg(
        F.max_by(row, order).alias("__top"), F.max_by(row, F.when(live, order)).alias("__live")
    )
    both = F.when(F.col("__top._deleted") & F.col("__live").isNotNull(), F.array("__top", "__live"))
    kept = tops.select(*[named(k) for k in keys], F.explode(F.coalesce(both, F.array("__top"))).alias("__row"))
    kept = kept.select(*[named(c) if c in keys else F.col("__row").getField(c).alias(c) for c in history.columns])
    return kept.unionByName(history.filter(~known))


def closed(dated: DataFrame, key, start: str, end: str) -> DataFrame:
    """History rows, dated by column ``start``, with ``end``: when the next version of
    their key was committed (null for the newest). The next one is found by an
    equi-join on (key, version), so that no task holds a key's whole history."""
    keys = key_list(key)
    after = dated.groupBy(*[named(k) for k in keys], F.col("_version")).agg(F.min(start).alias(end))
    after = after.select(
        *[named(k).alias(f"__n_{i}") for i, k in enumerate(keys)], (F.col("_version") - 1).alias("__n_version"), end
    )
    same = F.col("_version") == F.col("__n_version")
    for i, k in enumerate(keys):
        same = same & (named(k) == F.col(f"__n_{i}"))
    return dated.join(after, same, "left").select(*[named(c) for c in dated.columns], end)


def compare_with_latest(history: DataFrame, batch: DataFrame, key) -> DataFrame:
    """Batch rows with ``__status`` (new, changed, unchanged) and ``__version``,
    the highest version of the key so far.

    Cells compare by column name, null equal to null. A key repeated inside
    the batch always counts as changed, since one stored row cannot equal
    several. A null key is always new.
    """
    keys = key_list(key)
    shared = [
        c for c in data_columns(batch) if c in history.columns and c not in keys
    ]
    counts = batch.groupBy(*[named(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("__n")
    )
    # Only keys of this batch leave the history scan.
    touched = with_keys(history, counts, keys, null_safe=False)
    state = _latest(touched, keys, shared)
    lookup = counts.join(state, keys, "inner").select(
        *[named(k).alias(f"__key_{i}") for i, k in enumerate(keys)],
        "__n",
        "__version",
        "__last",
    )
    test = F.lit(True)
    for i, k in enumerate(keys):
        test = test & (named(k) == F.col(f"__key_{i}"))
    joined = batch.join(lookup, test, "left")
    live = ~F.col("__last").getField("_deleted")
    same = F.lit(True)
    for c in shared:
        same = same & named(c).eqNullSafe(F.col("__last").getField(c))
    # Columns of the batch the history does not have yet.
    for c in data_columns(batch):
        if c not in history.columns:
            same = same & named(c).isNull()
    status = (
        F.when(F.col("__version").isNull(), "new")
        .when(live & same & (F.col("__n") == 1), "unchanged")
        .otherwise("changed")
    )
    return joined.select(
        *[named(c) for c in batch.columns], status.alias("__status"), "__version"
    )


def upsert_versions(history: DataFrame, batch: DataFrame, key, commit_time: str):
    """New rows for changed keys (highest version + 1) and unseen keys (1)."""
    marked = compare_with_latest(history, batch, key)
    moved = marked.filter(F.col("__status") != "unchanged")
    return _stamp(
        moved.drop("__status"),
        F.coalesce(F.col("__version"), F.lit(0)) + 1,
        commit_time,
    ).drop("__version")


def tombstones(history: DataFrame, doomed: DataFrame, key, commit_time: str):
    """A deleting row, one version up, for each live key in ``doomed``."""
    keys = key_list(key)
    columns = [c for c in data_columns(history) if c not in keys]
    touched = with_keys(history, doomed, keys, null_safe=False)
    state = _latest(touched, keys, columns)
    alive = state.filter(~F.col("__last").getField("_deleted"))
    return alive.select(
        *[
            named(c) if c in keys else F.col("__last").getField(c).alias(c)
            for c in data_columns(history)
        ],
        (F.col("__version") + 1).alias("_version"),
        F.lit(True).alias("_deleted"),
        F.lit(row_metadata(commit_time)).alias("_metadata"),
        *([F.lit(0).cast("long").alias(SEQ)] if SEQ in history.columns else []),
    )


def current_view(history: DataFrame, key, tombstone: str = "hide") -> DataFrame:
    """The latest live row of each key, without history columns.

    ``tombstone="hide"`` ranks first, so a deleted key stays deleted.
    ``"skip"`` drops deleting rows before ranking, which brings the
    version before a deletion back. Without a key: distinct live rows,
    metadata included.
    """
    if tombstone not in ("hide", "skip"):
        raise ValueError(f"unknown tombstone mode {tombstone!r}")
    keys = key_list(key)
    columns = data_columns(history)
    if not keys:
        live = history.filter(~F.col("_deleted")).drop(SEQ)
        return live.distinct().select(*[named(c) for c in columns])
    if tombstone == "skip":
        history = history.filter(~F.col("_deleted"))
    # One aggregate per column: those not asked for later drop out of the plan, so
    # a read of one column scans the key, that column and the history columns.
    order = _order(history)
    latest = history.groupBy(*[named(k) for k in keys]).agg(
        F.max_by("_deleted", order).alias("__deleted"),
        *[F.max_by(named(c), order).alias(c) for c in columns if c not in keys],
    )
    return latest.filter(~F.col("__deleted")).select(*[named(c) for c in columns])


def committed_at(metadata: str = "_metadata") -> Column:
    return F.get_json_object(named(metadata), "$.timestamp")


def as_of(history: DataFrame, key, moment: str, tombstone: str = "hide") -> DataFrame:
    """The current view as it was at ``moment`` (ISO text, inclusive)."""
    return current_view(history.filter(committed_at() <= moment), key, tombstone)


def version_history(
    history: DataFrame, key, columns: Sequence[str] | None = None
) -> DataFrame:
    """Every version with its commit time, the previous version's values
    (``prev_*``) and the number of versions of its key.

    Versions of a key count up by one, so the previous one is found by an
    equi-join on (key, version): no task holds a whole key's history.
    """
    keys = key_list(key)
    if not keys:
        raise ValueError("a version history needs a key")
    columns = [c for c in columns or data_columns(history) if c not in keys]
    prior = (
        history.groupBy(*[named(k) for k in keys], F.col("_version"))
        .agg(F.max_by(row_of(columns), _order(history)).alias("__prior"))
        .select(
            *[named(k).alias(f"__p_{i}") for i, k in enumerate(keys)],
            (F.col("_version") + 1).alias("__p_version"),
            "__prior",
        )
    )
    counts = history.groupBy(*[named(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("n_versions")
    )
    counts = counts.select(
        *[named(k).alias(f"__c_{i}") for i, k in enumerate(keys)], "n_versions"
    )
    same_prior = F.col("_version") == F.col("__p_version")
    same_count = F.lit(True)
    for i, k in enumerate(keys):
        same_prior = same_prior & named(k).eqNullSafe(F.col(f"__p_{i}"))
        same_count = same_count & named(k).eqNullSafe(F.col(f"__c_{i}"))
    return (
        history.join(prior, same_prior, "left")
        .join(counts, same_count, "left")
        .select(
            *[named(c) for c in history.columns if c != SEQ],
            committed_at().alias("committed_at"),
            *[F.col("__prior").getField(c).alias(f"prev_{c}") for c in columns],
            "n_versions",
        )
    )
