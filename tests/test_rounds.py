"""Rounds of mutual best partners: collisions by search, memory of a task, both forms of the rounds."""

import tracemalloc
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sightweave.config import ReconcileConfig
from sightweave.operators import rounds as rnd

CFG = ReconcileConfig(cross_bar=0.75, same_bar=0.85)


def run_of(n, dim, people, noise, seed):
    """Tracklets of a run that are clusters of their own."""
    rng = np.random.RandomState(seed)
    v = rng.randn(people, dim)[np.arange(n) % people] + noise * rng.randn(n, dim)
    first = rng.randint(0, n, n) * 10
    rows = {"run_id": "r", "key": np.arange(n), "cam": [f"c{i}" for i in rng.randint(0, 5, n)], "first_frame": first, "last_frame": first + rng.randint(0, 40, n), "prototype": (v / np.linalg.norm(v, axis=1, keepdims=True)).tolist(), "root": np.arange(n)}
    return pd.DataFrame(rows)


def test_collisions_are_found_by_search():
    rng = np.random.RandomState(1)
    own, cam, start, end = [], [], [], []
    for cluster in range(30):
        for camera in range(3):
            at = rng.randint(0, 50)
            for _ in range(rng.randint(0, 4)):
                at += rng.randint(1, 60)
                own, cam, start = [*own, cluster], [*cam, camera], [*start, at]
                at += rng.randint(0, 20)
                end.append(at)
    own, cam, start, end = (np.array(x) for x in (own, cam, start, end))
    a, b = (x.ravel() for x in np.meshgrid(np.arange(30), np.arange(30)))
    apart = a != b
    a, b = a[apart], b[apart]
    want = [any(cam[i] == cam[j] and not (end[i] < start[j] or end[j] < start[i]) for i in np.flatnonzero(own == x) for j in np.flatnonzero(own == y)) for x, y in zip(a, b)]
    assert rnd.Spans(own, cam, start, end).collide(a, b).tolist() == want and 0 < sum(want) < len(want)


def plain(pdf, cfg):
    """Rounds by the definition: every pair in every round."""
    rows = pdf.to_dict("records")
    groups, told = {r["root"]: [r] for r in rows}, {}
    collide = lambda x, y: any(p["cam"] == q["cam"] and not (p["last_frame"] < q["first_frame"] or q["last_frame"] < p["first_frame"]) for p in x for q in y)
    number = 0
    while True:
        number += 1
        mean = {k: np.sum([r["prototype"] for r in g], axis=0) for k, g in groups.items()}
        best = {}
        for a in groups:
            for b in groups:
                ca, cb = {r["cam"] for r in groups[a]}, {r["cam"] for r in groups[b]}
                if a == b or ca == cb and len(ca) == 1 or collide(groups[a], groups[b]):
                    continue
                s = round(float(mean[a] @ mean[b] / np.linalg.norm(mean[a]) / np.linalg.norm(mean[b])), 12)
                if s >= (max(cfg.bar(c) for c in ca & cb) if ca & cb else cfg.cross_bar):
                    best[a] = max(best.get(a, (-2, -1)), (s, b))
        pairs = [(a, b, s) for a, (s, b) in best.items() if a < b and best[b][1] == a]
        if not pairs:
            return {r["key"]: k for k, g in groups.items() for r in g}, told
        for a, b, s in pairs:
            groups[a] += groups.pop(b)
            told[b] = (round(s, 9), number)


def found(pdf):
    unions = pdf[pdf["merge_score"].notna()]
    return dict(zip(pdf["key"], pdf["final"])), {k: (round(s, 9), r) for k, s, r in zip(unions["key"], unions["merge_score"], unions["merge_round"])}


def test_rounds_are_those_of_the_definition():
    for seed in range(3):
        for cfg in (CFG, replace(CFG, bars={"c1": 0.7, "c3": 0.95}), replace(CFG, cross_bar=-0.5, same_bar=-0.2)):
            pdf = run_of(60, 8, 9, 0.2, seed)
            want = plain(pdf, cfg)
            assert found(rnd.rounds_of_run(pdf, cfg)) == want and want[1]


def test_joined_rounds_of_several_blocks_are_the_same(spark):
    pdf = run_of(60, 8, 9, 0.2, 5)
    got, number = rnd.joined_rounds(spark.createDataFrame(pdf), CFG, 8, block=16)
    want = plain(pdf, CFG)
    assert found(got.toPandas()) == want and number == max(r for _, r in want[1].values()) + 1


def test_joined_rounds_are_the_same_where_keys_are_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(rnd, "FEW", 0)
    pdf = pd.concat([run_of(60, 8, 9, 0.2, 5), run_of(30, 8, 9, 0.2, 6).assign(run_id="s")])
    got = rnd.joined_rounds(spark.createDataFrame(pdf), CFG, 8, block=16)[0].toPandas()
    assert len(got) == 90
    for run, rows in pdf.groupby("run_id"):
        assert found(got[got["run_id"] == run]) == plain(rows, CFG)


def test_estimates_of_size_do_not_grow_over_rounds(spark):
    from sightweave.session import cut

    now = cut(spark.range(20).withColumn("v", F.array("id")))
    for _ in range(5):  # joins multiply them: 3 ** 5 times as many digits
        now = cut(now.join(now.select("id"), "id").join(now.select("id"), "id"))
    assert now._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 64
    assert sorted(r["v"][0] for r in now.collect()) == list(range(20))


def test_joined_rounds_end_in_a_task_when_few_clusters_are_left(spark):
    pdf = pd.concat([run_of(60, 8, 9, 0.2, 5), run_of(30, 8, 9, 0.2, 6).assign(run_id="s")])
    got, number = rnd.joined_rounds(spark.createDataFrame(pdf), CFG, 8, block=16, limit=40)
    got, late = got.toPandas(), 0
    for run, rows in pdf.groupby("run_id"):
        want = plain(rows, CFG)
        assert found(got[got["run_id"] == run]) == want
        late = max(late, *(r for _, r in want[1].values()))
    assert len(got) == 90 and 1 <= number < late


def test_a_pair_just_over_the_bar_is_told_from_one_just_under():
    a = np.zeros((3, 128))
    a[0, 0] = 1
    for k, s in ((1, 0.75 + 1e-10), (2, 0.75 - 1e-10)):
        a[k, 0], a[k, k] = s, np.sqrt(1 - s * s)
    spans = rnd.Spans(np.arange(3), np.arange(3), np.zeros(3), np.zeros(3))
    got = [(i, j, s) for r, c, v in rnd.edges(a, np.eye(3, dtype=bool), spans, CFG, np.full(3, 0.85), np.arange(3), np.arange(3)) for i, j, s in zip(r, c, v)]
    assert sorted(got) == [(0, 1, 0.7500000001), (1, 0, 0.7500000001)]


def test_a_task_holds_no_table_of_all_pairs():
    pdf = run_of(3000, 16, 300, 0.1, 7)
    tracemalloc.start()
    out = rnd.rounds_of_run(pdf, CFG)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out["final"].nunique() < 3000 and peak < 3000 * 3000 * 8  # one table of scores; it held ten


def test_sets_score_as_one_by_one():
    from sightweave.operators.pairs import set_score

    rng = np.random.RandomState(3)
    people = rng.randn(6, 8)
    sets = [(x := people[k % 6] + 0.3 * rng.randn(rng.randint(1, 9), 8)) / np.linalg.norm(x, axis=1, keepdims=True) for k in range(70)]
    u = np.array([x.sum(0) / np.linalg.norm(x.sum(0)) for x in sets])
    for mode, bar in (("max_exemplar", 0.9), ("consensus", 0.8), ("consensus", -0.1)):
        want = {}
        for i, j in zip(*np.triu_indices(70, 1)):
            s = set_score(sets[i], sets[j], mode, 0.25)
            want[i, j] = max(s, u[i] @ u[j]) if mode == "max_exemplar" else s
        got = [(i, j, s) for r in rnd.set_edges(sets, u, mode, 0.25, np.arange(70), np.arange(70), bar, lambda a, b: a < b) for i, j, s in zip(*r)]
        assert {(i, j) for i, j, _ in got} == {k for k, s in want.items() if s >= bar} and got
        assert all(abs(s - want[i, j]) < 1e-12 for i, j, s in got)
