"""Random batches: the merge rules against plain Python over dictionaries."""

import random

import pytest
from conftest import rows

from millrace.operators import merge

NAMES = "k long, a long, b long"


def batch(rng, n, unique=False):
    keys = rng.sample(range(n * 2), n) if unique else [rng.choice([0, 0, *range(n)]) for _ in range(n)]
    values = [(k, rng.randrange(3), rng.choice([None, 1])) for k in keys]
    return [(None if rng.random() < 0.1 else k, a, b) for k, a, b in values]


@pytest.fixture(params=range(3))
def case(request):
    rng = random.Random(request.param)
    return batch(rng, 40, unique=True), batch(rng, 30)


def test_append(spark, case):
    old, new = case
    seen = {r[0] for r in old}
    out = merge.append_by_key(spark.createDataFrame(old, NAMES), spark.createDataFrame(new, NAMES), "k")
    assert rows(out) == sorted(old + [r for r in new if r[0] not in seen], key=repr)


def test_upsert(spark, case):
    old, new = case
    replaced = {r[0] for r in new}
    out = merge.upsert_by_key(spark.createDataFrame(old, NAMES), spark.createDataFrame(new, NAMES), "k")
    assert rows(out) == sorted([r for r in old if r[0] not in replaced] + new, key=repr)


def numbered(spark, new):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(new)], NAMES + ", ord int")


def test_append_ignore(spark, case):
    old, new = case
    table = list(old)
    seen = {r[0] for r in old}
    for r in new:
        if r[0] is None or r[0] not in seen:
            table.append(r)
            seen.add(r[0])
    out = merge.append_ignore(spark.createDataFrame(old, NAMES), numbered(spark, new), "k", "ord")
    assert rows(out) == sorted(table, key=repr)


def test_partial_upsert(spark, case):
    old, new = case
    table = {r[0]: r for r in old if r[0] is not None}
    loose = [r for r in old if r[0] is None]
    for k, a, _ in new:
        if k is None:
            loose.append((None, a, None))
        else:
            table[k] = (k, a, table[k][2] if k in table else None)
    supplied = numbered(spark, new).drop("b")
    out = merge.upsert_partial(spark.createDataFrame(old, NAMES), supplied, "k", "ord")
    assert rows(out) == sorted([*table.values(), *loose], key=repr)
