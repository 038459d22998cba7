from sightweave.session import latest, latest_of_repeated


def test_only_repeated_rows_are_compared(spark):
    rows = [(i, 1, float(i), "a") for i in range(50)] + [(7, 3, 1.0, "b"), (7, 2, 9.0, "c"), (8, 1, 8.0, "z"), (None, 1, 0.5, "n"), (None, 2, 0.6, "m")]
    df = spark.createDataFrame(rows, "k long, t int, x double, y string").repartition(3)
    got, want = (sorted(map(tuple, d.collect()), key=str) for d in (latest_of_repeated(df, "k", "t", ["x", "y"]), latest(df, ["k"], "t", ["x", "y"])))
    assert got == want and len(got) == 51 and (7, 1.0, "b") in got and (8, 8.0, "z") in got
