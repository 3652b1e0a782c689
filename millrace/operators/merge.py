"""Merge rules for one table and one batch.

Keys compare null-safe (a missing key equals a missing key) unless a function
says otherwise. No rule collects keys: each is a semi or anti join, and the
size of the key side decides between broadcast and shuffle in Catalyst/AQE.
Key sides are reduced to distinct keys first, which combines on the map side,
so a key that repeats in a third of the batch still ships once per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.names import key_list, named, row_of
from millrace.operators.shape import union_by_name


# Stand-ins for a null key, beside a flag that tells them from real values.
_STAND_INS = [
    (T.StringType, ""),
    (T.NumericType, 0),
    (T.BooleanType, False),
    (T.DateType, "1970-01-01"),
    (T.TimestampType, "1970-01-01"),
    (T.TimestampNTZType, "1970-01-01"),
]


def _parts(df: DataFrame, keys: Sequence[str], null_safe: bool) -> list[Column]:
    """Key columns as plain-equality join terms. Null-safe keys become pairs
    of (value or stand-in, is null) on both sides, so that the distinct key
    side and the join share one partitioning."""
    parts = []
    for k in keys:
        column, kind = named(k), df.schema[k].dataType
        stand_in = next((v for t, v in _STAND_INS if isinstance(kind, t)), None)
        if not null_safe:
            parts.append(column)
        elif stand_in is None:
            raise TypeError(f"key '{k}' of type {kind.simpleString()} cannot be matched")
        else:
            parts += [F.coalesce(column, F.lit(stand_in).cast(kind)), column.isNull()]
    return parts


def _match(df: DataFrame, key_rows: DataFrame, keys, null_safe: bool, how: str):
    keys = key_list(keys)
    # Renamed so that both sides may come from the same scan; distinct before
    # the join, so a repeated key leaves each task once.
    side = key_rows.select(
        *[p.alias(f"__key{i}") for i, p in enumerate(_parts(key_rows, keys, null_safe))]
    ).distinct()
    terms = [p == F.col(f"__key{i}") for i, p in enumerate(_parts(df, keys, null_safe))]
    return df.join(side, reduce(lambda a, b: a & b, terms), how)


def with_keys(df, key_rows, keys, null_safe=True) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``key_rows``."""
    return _match(df, key_rows, keys, null_safe, "left_semi")


def without_keys(df, key_rows, keys, null_safe=True) -> DataFrame:
    """Rows of ``df`` whose key does not occur in ``key_rows``."""
    return _match(df, key_rows, keys, null_safe, "left_anti")


def unseen(batch, stored, keys, null_safe=True) -> DataFrame:
    """Batch rows whose key the stored table lacks.

    The stored side is first cut down to keys of the batch (a map-side filter
    when the batch is small), so its key column is not shuffled for a small
    batch and the anti join sees at most one row per batch key.
    """
    keys = key_list(keys)
    hits = with_keys(stored.select(*[named(k) for k in keys]), batch, keys, null_safe)
    return without_keys(batch, hits, keys, null_safe)


def append_rows(old: DataFrame, batch: DataFrame) -> DataFrame:
    """No key: everything stays."""
    return union_by_name(old, batch)


def append_by_key(old: DataFrame, batch: DataFrame, key) -> DataFrame:
    """Old rows, and batch rows with unseen keys (repeats inside the batch stay)."""
    return union_by_name(old, unseen(batch, old, key))


def upsert_by_key(old: DataFrame, batch: DataFrame, key) -> DataFrame:
    """Old rows whose key is not in the batch, and the whole batch."""
    return union_by_name(without_keys(old, batch, key), batch)


def one_per_key(batch: DataFrame, key, order_by: str, keep: str) -> DataFrame:
    """The first or last row of each key; rows with a missing key all stay.

    A grouped max_by/min_by: partial results are formed before the shuffle.
    """
    keys = key_list(key)
    rest = [c for c in batch.columns if c not in keys and c != order_by]
    pick = {"first": F.min_by, "last": F.max_by}[keep]
    any_null = reduce(lambda a, b: a | b, [named(k).isNull() for k in keys])
    best = (
        batch.filter(~any_null)
        .groupBy(*[named(k) for k in keys])
        .agg(pick(row_of([*rest, order_by]), named(order_by)).alias("__best"))
        .select(
            *[named(k) for k in keys],
            *[F.col("__best").getField(c).alias(c) for c in [*rest, order_by]],
        )
    )
    return best.unionByName(batch.filter(any_null)).drop(order_by)


def append_ignore(old: DataFrame, batch: DataFrame, key, order_by: str) -> DataFrame:
    """INSERT OR IGNORE: unseen keys only, the first of repeats wins.

    As in SQL, a null key conflicts with nothing.
    """
    keys = key_list(key)
    first = one_per_key(batch, keys, order_by, "first")
    return union_by_name(old, unseen(first, old, keys, null_safe=False))


def overlay_columns(old: DataFrame, last: DataFrame, key) -> DataFrame:
    """Old rows with the columns ``last`` supplies replaced where keys match."""
    keys = key_list(key)
    supplied = [c for c in last.columns if c not in keys]
    side = last.select(
        *[named(k).alias(f"__key_{i}") for i, k in enumerate(keys)],
        row_of(supplied or keys).alias("__new"),
    )
    tests = [named(k) == F.col(f"__key_{i}") for i, k in enumerate(keys)]
    joined = old.join(side, reduce(lambda a, b: a & b, tests), "left")
    hit = F.col("__new").isNotNull()
    replaced = [
        F.when(hit, F.col("__new").getField(c)).otherwise(named(c)).alias(c)
        if c in supplied
        else named(c)
        for c in old.columns
    ]
    added = [
        F.col("__new").getField(c).alias(c) for c in supplied if c not in old.columns
    ]
    return joined.select(*replaced, *added)


def upsert_partial(old: DataFrame, batch: DataFrame, key, order_by: str) -> DataFrame:
    """ON CONFLICT DO UPDATE: only supplied columns change, the last repeat wins.

    A left join plus an unseen-key insert, not a full outer join, so that a
    small batch can be broadcast against a large table.
    """
    keys = key_list(key)
    last = one_per_key(batch, keys, order_by, "last")
    updated = overlay_columns(old, last, keys)
    inserted = unseen(last, old, keys, null_safe=False)
    return union_by_name(updated, inserted)
