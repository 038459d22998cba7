import random

import pytest

from sightweave.operators.intervals import interval_gaps, interval_periods


def brute(rows, tol):
    by, gaps, periods = {}, set(), set()
    for k, a, b in rows:
        if a is not None and b is not None:
            by.setdefault(k, []).append((min(a, b), max(a, b)))
    for k, spans in by.items():
        spans.sort()
        lo, hi = spans[0]
        for a, b in spans[1:]:
            if a > hi + tol:
                gaps.add((k, hi, a))
                periods.add((k, lo, hi))
                lo, hi = a, b
            hi = max(hi, b)
        periods.add((k, lo, hi))
    return gaps, periods


@pytest.mark.parametrize("key_limit", [200_000, 40])
def test_gaps_and_periods_match_brute_force(spark, key_limit):
    rng = random.Random(5)
    rows = [("hot", s, s + rng.randrange(30)) for s in (rng.randrange(40_000) for _ in range(1500))]
    rows += [(rng.choice("abc"), rng.randrange(500), rng.randrange(500)) for _ in range(60)]
    rows += [("hot", 100, 9000), ("d", None, 4), ("d", 3, None), ("e", 9, 2), ("e", 9, 2), (None, 1, 2), (None, 9, 9)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "k string, a long, b long, part int, los string").repartition(5)
    gaps, periods = brute(rows, 1)
    assert {tuple(r) for r in interval_gaps(df, ["k"], "a", "b", 1, key_limit).collect()} == gaps
    assert {tuple(r) for r in interval_periods(df, ["k"], "a", "b", 1, key_limit).collect()} == periods


def test_empty_and_touching(spark):
    df = spark.createDataFrame([("a", 0, 4), ("a", 5, 6), ("a", 8, 9)], "k string, a long, b long")
    assert [tuple(r) for r in interval_gaps(df, ["k"], "a", "b", 1).collect()] == [("a", 6, 8)]
    assert interval_gaps(df.limit(0), ["k"], "a", "b", 1).count() == 0
    assert interval_periods(df.limit(0), ["k"], "a", "b", 1).count() == 0
