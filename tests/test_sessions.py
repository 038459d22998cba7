import random

from sightweave.operators.sessions import sessionize


def brute(rows, gap):
    by, out = {}, set()
    for a, b, t in rows:
        if None not in (a, b, t):
            by.setdefault((a, b), []).append(t)
    for key, ts in by.items():
        ts.sort()
        start = end = ts[0]
        n = 0
        for t in ts:
            if t - end > gap:
                out.add((*key, start, end, end - start, n))
                start, n = t, 0
            end, n = t, n + 1
        out.add((*key, start, end, end - start, n))
    return out


def test_sessions_match_brute_force_with_a_hot_key(spark):
    rng = random.Random(3)
    rows = [("r", 1, rng.randrange(20_000)) for _ in range(3000)] + [(f"r{rng.randrange(4)}", rng.randrange(5), rng.randrange(3000)) for _ in range(800)]
    rows += [(None, 1, 5), ("r", None, 5), ("r", 1, None), ("r9", 7, 12), ("r9", 7, 12)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "run string, track long, t long, start string, n_events int").repartition(6)
    got = {tuple(r) for r in sessionize(df, ["run", "track"], "t", 10).collect()}
    assert got == brute(rows, 10)


def test_gap_is_inclusive_and_empty_tables_give_nothing(spark):
    df = spark.createDataFrame([("a", 0), ("a", 10), ("a", 21)], "k string, t long")
    assert {(r["start"], r["end"], r["n_events"]) for r in sessionize(df, ["k"], "t", 10).collect()} == {(0, 10, 2), (21, 21, 1)}
    assert sessionize(df.limit(0), ["k"], "t", 10).count() == 0


def test_a_long_session_over_many_tasks_stays_one(spark):
    df = spark.range(20_000).selectExpr("'k' as k", "id * 5 as t").repartition(8)
    assert [tuple(r) for r in sessionize(df, ["k"], "t", 5).collect()] == [("k", 0, 99_995, 99_995, 20_000)]
