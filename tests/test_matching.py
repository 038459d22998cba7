"""Queries on matching against brute force, on what their SQL doesn't cover."""

import numpy as np
import pytest

from sightweave.plans import matching as m

DIM = m.DIM


def tracks(spark, tmp_path, sizes, noise=0.6, gap=1):
    """A detections table of tracks in one camera, one after the other (gap 0: each starts with the last one's end); their unit rows and spans."""
    rng = np.random.RandomState(5)
    person, rows, sets, spans, frame = rng.randn(DIM), [], {}, {}, 0
    for t, n in enumerate(sizes):
        v = (person + noise * rng.randn(n, DIM)).astype(np.float32)
        sets[t], spans[t] = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True), (frame, frame + n - 1)
        rows += [(len(rows) + i, "r", "c", t, frame + i, 0, 0, 1, 1, 0.9, None, 1, x.tolist(), 0) for i, x in enumerate(v)]
        frame += n - 1 + gap
    kinds = "det_id long, run_id string, cam string, track_id long, frame_index long, x1 int, y1 int, x2 int, y2 int, confidence double, reid_id long, global_id long, embedding array<float>, ingested_at long"
    spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / "detections.parquet"))
    return sets, spans


def sampled(u, cap=64):
    return u if len(u) <= cap else u[np.linspace(0, len(u) - 1, cap).round().astype(int)]


@pytest.mark.parametrize("gap", [0, 1])
def test_set_scores_of_all_pairs_of_a_camera(spark, tmp_path, gap):
    sets, spans = tracks(spark, tmp_path, [70, 40, 6, 1, 150, 17], gap=gap)
    proto = {t: u.mean(0) / np.linalg.norm(u.mean(0)) for t, u in sets.items()}
    best, top, by_proto = {}, {}, 0
    for a in sets:
        for b in sets:
            if a < b and spans[a][1] < spans[b][0]:
                s = np.sort((sampled(sets[a]) @ sampled(sets[b]).T).ravel())[::-1]
                best[a, b], top[a, b] = max(s[0], proto[a] @ proto[b]), s[: max(1, round(len(s) * 0.25))].mean()
                by_proto += proto[a] @ proto[b] > s[0]
    assert by_proto and len(best) == (15 if gap else 9)
    for query, want in ((m.score_max_exemplar, best), (m.score_consensus, top)):
        got = {(r["track_a"], r["track_b"]): r["score"] for r in query(spark, str(tmp_path)).collect()}
        assert got == pytest.approx(want, abs=1e-6)


def test_even_subsample_takes_as_many_rows_as_the_reconcile(spark, tmp_path):
    from sightweave.plans.identity import even_subsample

    tracks(spark, tmp_path, [70, 40])
    got = {r["det_id"] for r in even_subsample(spark, str(tmp_path)).collect()}
    assert got == {*np.linspace(0, 69, 64).round().astype(int).tolist(), *range(70, 110)}


def views(u, bar=0.75, most=6):
    """Row by row: nearest seed so far, or a new one; medoid and size of each view."""
    s = u @ u.T
    seeds, assign = [], np.full(len(u), -1)
    for i in np.argsort(-np.round(s.sum(1), 9), kind="stable"):
        near = [s[i, k] for k in seeds]
        if seeds and (max(near) >= bar or len(seeds) == most):
            assign[i] = int(np.argmax(near))
        else:
            assign[i] = len(seeds)
            seeds.append(i)
    groups = [np.flatnonzero(assign == c) for c in range(len(seeds))]
    return [(c, int(g[np.round(s[np.ix_(g, g)].sum(1), 9).argmax()]), len(g)) for c, g in enumerate(groups)]


@pytest.mark.parametrize("noise", [0.3, 0.6, 1.2])
def test_medoid_views_of_long_tracks(spark, tmp_path, noise):
    """Tracks of over 64 rows and over six views: every row is in a view."""
    sets, _ = tracks(spark, tmp_path, [150, 64, 1, 90], noise)
    first = {t: sum(len(sets[k]) for k in range(t)) for t in sets}
    got = sorted((r["track_id"], r["view"], r["medoid"] - first[r["track_id"]], r["members"]) for r in m.medoid_views(spark, str(tmp_path)).collect())
    assert got == [(t, *v) for t in sets for v in views(sets[t])]
    assert {t: sum(g[3] for g in got if g[0] == t) for t in sets} == {t: len(u) for t, u in sets.items()}
    assert noise < 1 or max(g[1] for g in got) == 5


def test_match_or_mint_knows_every_label(spark, tmp_path):
    """1,200 identities, the best and second of many queries beyond the thousandth."""
    rng = np.random.RandomState(8)
    people = rng.randn(1200, DIM)
    label = np.concatenate([np.arange(1200), rng.randint(900, 1200, 300)])
    v = (people[label] + 0.5 * rng.randn(len(label), DIM)).astype(np.float32)
    spark.createDataFrame([(i, x.tolist(), int(k)) for i, (x, k) in enumerate(zip(v, label))], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    base = np.flatnonzero(np.arange(len(u)) % 20)
    want = {}
    for q in range(0, len(u), 20):
        each = {}
        for k, s in zip(label[base], u[base] @ u[q]):
            each[int(k)] = max(each.get(int(k), -2), s)
        (s, k), (second, _) = sorted(((s, k) for k, s in each.items()), reverse=True)[:2]
        want[q] = (k, round(s, 5), s >= 0.3 and s - second >= 0.03)
    assert any(k >= 1000 and ok for k, _, ok in want.values())
    got = {r["query"]: (r["best_label"], round(r["best"], 5), r["accepted"]) for r in m.match_or_mint(spark, str(tmp_path)).collect()}
    assert {q: (g[0], g[2]) for q, g in got.items()} == {q: (w[0], w[2]) for q, w in want.items()}
    assert all(abs(got[q][1] - want[q][1]) < 2e-5 for q in want)
    g = spark.read.parquet(str(tmp_path / "embeddings.parquet"))
    one, many = (sorted(map(tuple, m.best_labels(g.filter("vec_id % 20 = 0"), g, "vec_id", "embedding", "label", block=b).select("query", "label").collect())) for b in (8192, 200))
    assert one == many and len(one) == 75
