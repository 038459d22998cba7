import random

import numpy as np

from sightweave.functions.scoring import verifier
from sightweave.streaming import service
from sightweave.streaming.service import AssignConfig, Assigner


def unit(x):
    x = np.asarray(x, float)
    return x / np.linalg.norm(x)


def plain(rows, cfg):
    """The rules, written down again without any state but the list of what was decided."""
    done, out = [], []
    for cam, track, frame, u, quality in rows:
        kept = [g for c, t, _, _, g in done if (c, t) == (cam, track)]
        if kept:
            g = kept[0]
        else:
            near = sorted(range(len(done)), key=lambda i: (-float(done[i][3] @ u), i))[: cfg.nearest]
            cands = {done[i][4] for i in near if done[i][:1] + done[i][2:3] != (cam, frame)}
            able = {}
            for g in cands:
                mine = [r for r in done if r[4] == g]
                frames, spans = [r[2] for r in mine if r[0] == cam], []
                for f in frames:
                    if spans and f <= spans[-1][1] + 1:
                        spans[-1] = (min(spans[-1][0], f), max(spans[-1][1], f))
                    else:
                        spans.append((f, f))
                if any(s < frame < e for s, e in spans):
                    continue
                bank = np.stack([r[3] for r in mine[-cfg.bank :]])
                able[g] = max(float(max(b @ u for b in bank)), float(unit(bank.mean(0)) @ u))
                if cfg.verified:
                    last = mine[-1]
                    z = -13.5 + 18.0 * able[g] + 0.6 * np.log1p(len(mine)) - 0.01 * (max(0, frame - last[2]) if last[0] == cam else 0) + quality
                    able[g] = 1 / (1 + np.exp(-z))
            ranked = sorted(((s, g) for g, s in able.items()), reverse=True)
            bar, gap = (cfg.accept, cfg.clear) if cfg.verified else (cfg.bar, cfg.gap)
            good = ranked and ranked[0][0] >= bar and ranked[0][0] - (ranked[1][0] if len(ranked) > 1 else -1) >= gap
            g = ranked[0][1] if good else max([r[4] for r in done], default=0) + 1
        done.append((cam, track, frame, u, g))
        out.append(g)
    return out


def scene(seed):
    rng, people = random.Random(seed), np.random.RandomState(seed).randn(5, 16)
    noise = np.random.RandomState(seed + 50)
    owner, rows = {}, []
    for frame in range(70):
        for cam in "ab":
            for track in {rng.randrange(frame // 12 * 3, frame // 12 * 3 + 3) for _ in range(2)}:
                who = owner.setdefault((cam, track), rng.randrange(5))
                rows.append((cam, track, frame, unit(unit(people[who]) + 0.09 * noise.randn(16)), rng.random()))
    return rows


def test_assignment_against_the_rules():
    events = set()
    for seed in range(4):
        for cfg in (AssignConfig(bar=0.8, bank=5), AssignConfig(verified=True, bank=5)):
            rows, a = scene(seed), Assigner(cfg, 16)
            assert [a.observe(*r)[0] for r in rows] == plain(rows, cfg)
            events |= set(a.counts)
    assert events == {"sticky", "matched", "minted"}


def test_exclusions():
    u = unit([1, 0, 0])
    a = Assigner(AssignConfig(), 3)
    assert a.observe("a", 1, 5, u, 1)[:2] == (1, "minted")
    assert a.observe("a", 2, 5, u, 1)[:2] == (2, "minted")  # same camera and frame: another person
    b = Assigner(AssignConfig(), 3)
    for f in range(5, 9):
        b.observe("a", 1, f, u, 1)
    assert b.observe("a", 2, 7, u, 1)[1] == "minted"  # inside the span
    assert b.observe("a", 3, 30, unit([1, 0.7, 0]), 1)[1] == "minted"  # under the bar
    c = Assigner(AssignConfig(), 3)
    c.observe("a", 1, 1, u, 1)
    assert c.observe("a", 9, 30, u, 1)[:2] == (1, "matched") and c.observe("b", 1, 31, u, 1)[:2] == (1, "matched")


def test_assignment_of_runs(spark):
    rows = [(4000 * s + i, f"r{s}", c, t, f, float(f), [float(x) for x in u], q) for s in (0, 1) for i, (c, t, f, u, q) in enumerate(scene(s))]
    rows += [(9000, "r0", "a", 1, 3, 3.0, None, 0.5), (9001, "r0", "a", None, 3, 3.0, [1.0] * 16, 0.5)]
    df = spark.createDataFrame(rows, "det_id long, run_id string, cam string, track_id long, frame_index long, ts double, unit_vector array<double>, quality double").repartition(4)
    got = {r["det_id"]: r["identity"] for r in service.assign(df, AssignConfig(bar=0.8), 16).collect()}
    for s in (0, 1):
        order = sorted((r for r in rows if r[1] == f"r{s}" and r[0] < 9000), key=lambda r: (r[5], r[2], r[4], r[3], r[0]))
        want = plain([(c, t, f, np.array(u), q) for _, _, c, t, f, _, u, q in order], AssignConfig(bar=0.8))
        assert [got[r[0]] for r in order] == want
    assert 9000 not in got and 9001 not in got and service.assign(df.limit(0), AssignConfig(), 16).count() == 0


def test_the_verifier_is_the_expression(spark):
    from pyspark.sql import functions as F

    a = Assigner(AssignConfig(verified=True), 3)
    a.observe("a", 1, 1, unit([1, 0, 0]), 1.0)
    p = spark.range(1).select(verifier(F.lit(0.8), F.lit(0.8), F.lit(1), F.lit(9.0), F.lit(0.4))).first()[0]
    assert abs(a._probability(1, 0.8, "a", 10, 0.4) - p) < 1e-12


def test_a_gap_of_any_length_is_verified():
    a = Assigner(AssignConfig(verified=True), 3)
    assert a.observe("a", 1, 1, unit([1, 0, 0]), 1.0)[1] == "minted"
    assert a.observe("a", 2, 985_780, unit([1, 0, 0]), 1.0) == (2, "minted", 0.0)
    assert a.observe("b", 3, 985_781, unit([0, 1, 0]), 0.0)[:2] == (3, "minted")
