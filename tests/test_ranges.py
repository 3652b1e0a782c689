import datetime as dt
import random

import pytest
from conftest import rows

from millrace.operators import ranges
from millrace.operators.ranges import range_join


def overlapping(left, right):
    none = lambda r: r[1] is None or r[2] is None or r[1] != r[1] or r[2] != r[2] or r[1] > r[2]
    return sorted(
        ((*a, *b) for a in left for b in right if not none(a) and not none(b) and a[1] <= b[2] and b[1] <= a[2]), key=repr
    )


def some(rng, n, hot):
    out = []
    for i in range(n):
        lo = hot if rng.random() < 0.3 else rng.randrange(1000)
        hi = lo + rng.choice([0, 0, 3, 40, 2000 if rng.random() < 0.02 else 1])
        out.append((i, float(lo), float(hi)))
    return out + [(n, None, 5.0), (n + 1, 5.0, None), (n + 2, 9.0, 5.0), (n + 3, float("nan"), 5.0), (n + 4, -0.0, 0.0)]


@pytest.mark.parametrize("bin_rows", [4, 10**6])
def test_pairs_agree_with_brute_force(spark, monkeypatch, bin_rows):
    monkeypatch.setattr(ranges, "_BIN_ROWS", bin_rows)
    rng = random.Random(bin_rows)
    left, right = some(rng, 150, 400), some(rng, 120, 410)
    a = spark.createDataFrame(left, "i long, `a lo` double, `a.hi` double")
    b = spark.createDataFrame(right, "j long, b_lo double, b_hi double")
    out = range_join(a, b, ("a lo", "a.hi"), ("b_lo", "b_hi"))
    assert out.columns == ["i", "a lo", "a.hi", "j", "b_lo", "b_hi"]
    assert rows(out) == overlapping(left, right)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_points_dates_and_large_numbers(spark, monkeypatch):
    monkeypatch.setattr(ranges, "_BIN_ROWS", 2)
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    points = spark.createDataFrame([(i, day(i)) for i in range(20)], "i long, d date")
    spans = spark.createDataFrame([(day(3), day(5)), (day(19), day(40)), (day(50), day(60))], "s date, e date")
    got = rows(range_join(points, spans, ("d", "d"), ("s", "e")).select("i"))
    assert got == sorted([(3,), (4,), (5,), (19,)], key=repr)
    big = 2**60  # neighbours that are one double
    numbers = spark.createDataFrame([(big + i,) for i in range(6)], "n long")
    span = spark.createDataFrame([(big + 2, big + 3), (big + 5, big + 9)], "s long, e long")
    assert [r[0] - big for r in rows(range_join(numbers, span, ("n", "n"), ("s", "e")).select("n"))] == [2, 3, 5]
    times = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' AS t")
    assert range_join(times, times.selectExpr("t AS s", "t AS e"), ("t", "t"), ("s", "e")).count() == 1


def test_empty_sides_and_other_types(spark):
    a = spark.createDataFrame([], "x long, y long")
    assert range_join(a, a.toDF("u", "v"), ("x", "y"), ("u", "v")).count() == 0
    with pytest.raises(TypeError, match="not a number"):
        range_join(a.selectExpr("'a' AS x"), a, ("x", "x"), ("x", "y"))
