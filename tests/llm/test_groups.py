import math
import random

import numpy as np
import pytest

from sightweave.llm import percentiles, topn
from sightweave.llm.packing import Packer, pack_texts, token_counter, token_counts


def test_loser_tree_merge_seeks_past_groups():
    rng = random.Random(2)
    runs = [sorted((rng.randrange(6), rng.randrange(1000)) for _ in range(rng.randrange(60))) for _ in range(7)] + [[]]
    got = list(topn.merge_runs([topn.Run(iter([run[i : i + 7] for i in range(0, len(run), 7)])) for run in runs], 3))
    want = []
    for g in range(6):
        want += [(g, x) for x in sorted({x for run in runs for h, x in run if h == g})[:3]]
    assert got == want


@pytest.mark.parametrize("buckets", [1, 7])
def test_top_n_against_brute_force(spark, monkeypatch, buckets):
    monkeypatch.setattr(topn, "RUN_ROWS", 200)
    rng = random.Random(4)
    names = ["a", "b", "é", "Z", "", "𝒳", "￿"]
    rows = [("r" if rng.random() < 0.6 else None, rng.choice(["h"] * 6 + ["x", "y", None]), rng.choice([0.5, 0.25, -0.5, 0.9, None, float("nan")]), rng.choice(names), i) for i in range(1500)]
    rows += rows[:200] + [("r", "h", 0.9, None, None), ("r", "h", 0.9, None, 99_999)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "run string, h string, s double, name string, i long, place int").repartition(6)
    by = {}
    for run, h, s, name, i in set(rows):
        if s is not None and not math.isnan(s) and i is not None:
            by.setdefault((run, h), set()).add((s, (name or "").encode(), i))
    want = {(*k, x[2]) for k, v in by.items() for x in sorted(v, reverse=True)[:5]}
    got = topn.top_n(df, ["run", "h"], "s", "name", "i", 5, buckets).collect()
    assert {(r["run"], r["h"], r["item"]) for r in got} == want and len(got) == len(want)
    assert topn.top_n(df.limit(0), ["run", "h"], "s", "name", "i", 5).count() == 0


def test_top_n_takes_the_last_version_of_an_item(spark):
    rows = [("a", 0.9, "x", 7, 1), ("a", 0.5, "x", 7, 2), ("a", 0.7, "y", 8, 1), ("a", 0.7, "y", 8, 1), ("b", 0.1, "z", 9, 1), ("a", 0.8, "z", 9, None), ("a", None, "x", 10, 2), ("a", 1.0, "x", 10, 1)]
    df = spark.createDataFrame(rows, "g string, s double, name string, i long, at int").repartition(3)
    got = {(r["g"], r["item"], r["score"], r["place"]) for r in topn.top_n(df, ["g"], "s", "name", "i", 2, version="at").collect()}
    assert got == {("a", 8, 0.7, 1), ("a", 7, 0.5, 2), ("b", 9, 0.1, 1)}


def test_labels_order_downwards_by_code_point():
    names = ["", "a", "ab", "a\x00", "a\x01", "b", "é", "\uffff", "\U0001d4b3", "\x00", "\x00\x00", "\x01"]
    assert sorted(names, key=topn._down) == sorted(names, key=lambda t: t.encode(), reverse=True)


def ranks(values, ps):
    v = sorted(values)
    return {p: v[max(1, math.ceil(round(p * len(v), 9))) - 1] for p in ps}


@pytest.mark.parametrize("finish", [4096, 8])
def test_percentiles_are_exact(spark, monkeypatch, finish):
    monkeypatch.setattr(percentiles, "FINISH", finish)
    monkeypatch.setattr(percentiles, "CHUNK", 64)
    rng = random.Random(9)
    rows = [("hot", rng.choice([rng.random(), 0.5, -1.0])) for _ in range(3000)] + [(g, round(rng.random(), 1)) for g in "abc" for _ in range(40)]
    rows += [("a", None), ("a", float("nan")), ("inf", float("inf")), ("inf", float("-inf")), ("inf", 0.0), (None, 4.0), ("void", None)]
    df = spark.createDataFrame([(*r, 3) for r in rows], "g string, v double, n int").repartition(7)
    ps = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {(r["g"], r["p"]): r["value"] for r in percentiles.multi_select(df, ["g"], "v", ps).collect()}
    by = {}
    for g, v in rows:
        if v is not None and not math.isnan(v):
            by.setdefault(g, []).append(v)
    assert got == {(g, p): x for g, vs in by.items() for p, x in ranks(vs, ps).items()}
    assert percentiles.multi_select(df.limit(0), ["g"], "v", ps).count() == 0


def test_summaries_combine_within_their_error(spark):
    rng = np.random.RandomState(1)
    rows = [("g", day, float(x)) for day, n in (("mon", 4000), ("tue", 300)) for x in rng.randn(n) + (day == "tue")]
    df = spark.createDataFrame(rows, "g string, day string, v double")
    summary = percentiles.percentile_summary(df, ["g", "day"], "v")
    v = np.sort([r[2] for r in rows])
    for r in percentiles.combine_summaries(summary, ["g"], [0.1, 0.5, 0.9]).collect():
        assert r["n"] == len(v)
        assert abs(np.searchsorted(v, r["value"]) / len(v) - r["p"]) <= 0.011


def test_packer_fills_windows():
    rng = random.Random(3)
    p, free, total = Packer(100), {}, 0
    for _ in range(3000):
        s = rng.randrange(1, 101)
        w = p.place(s)
        free[w] = free.get(w, 100) - s
        total += s
        assert free[w] >= 0
    assert len(free) == p.windows and total / (100 * p.windows) > 0.95  # sizes up to the capacity are the hardest
    level = np.bincount([100 - f for f in free.values()], minlength=101)
    assert (level[1:100] == p.level[1:100]).all()


def test_packer_is_about_as_tight_as_best_fit():
    rng = random.Random(7)
    sizes = [rng.randrange(1, 60) for _ in range(4000)]
    p, fit = Packer(100), []
    for s in sizes:
        p.place(s)
        best = min((i for i, f in enumerate(fit) if f >= s), key=lambda i: fit[i], default=None)
        if best is None:
            fit.append(100 - s)
        else:
            fit[best] -= s
    assert p.windows <= 1.01 * len(fit) and sum(sizes) / (100 * p.windows) > 0.98


def test_packs_split_only_long_texts(spark):
    rows = [(i, s) for i, s in enumerate([5, 64, 65, 200, 0, None, 1, 63, 64, 7])] + [(None, 3)]
    df = spark.createDataFrame(rows, "text_id long, n_tokens long")
    got = pack_texts(df, [64, 100], shards=2).toPandas()
    for c, g in got.groupby("capacity"):
        assert (g.groupby("pack")["n_tokens"].sum() <= c).all()
        sums = g.groupby("text_id")["n_tokens"].sum().to_dict()
        assert sums == {i: s for i, s in rows if s and i is not None}
        assert set(g[g["piece"] > 0]["text_id"]) == {i for i, s in rows if s and i is not None and s > c}
    assert pack_texts(df.limit(0), [64]).count() == 0


@pytest.mark.parametrize("file", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_of_whole_texts(spark, file):
    path = f"/opt/tokenizers/{file}"
    long = "lorem <|endoftext|> ipsum ünïcode 数字 " * 4000
    df = spark.createDataFrame([(1, "a small text"), (2, None), (3, ""), (4, long)], "id long, t string")
    got = {r["text_id"]: r["n_tokens"] for r in token_counts(df, "id", "t", path).collect()}
    assert got[2] == got[3] == 0 and 3 <= got[1] <= 5 and got[4] > 20_000
    assert got[4] == token_counter(path)([long])[0]
