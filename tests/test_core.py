import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightweave.functions import geometry as geo
from sightweave.functions import scoring
from sightweave.functions.vectors import prototypes, unit
from sightweave.operators import decision_log as log
from sightweave.operators.components import connected_components
from sightweave.operators.pairs import nearest_exact, similar_pairs
from sightweave.operators.topology import shortest_transits, with_transit
from sightweave.operators.tracklets import even_rows
from sightweave.sources.naming import named, resolve, transport_options
from sightweave.sources.store import ObservationStore, latest_log, read_decision_log, write_decision_log
from sightweave.streaming import engine


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randrange(200), 100 + rng.randrange(200)) for _ in range(120)] + [(7, 7), (500, 500)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {x: find(x) for x in list(root)}
    df = spark.createDataFrame([*edges, (None, 3), (3, None)], "a long, b long")
    assert {tuple(r) for r in connected_components(df).collect()} == set(want.items())
    assert connected_components(df.limit(0)).count() == 0


def test_pairs_and_nearest_match_numpy(spark):
    rng = np.random.RandomState(0)
    v = rng.randn(90, 6)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i % 2, i, x.tolist()) for i, x in enumerate(v)], "g long, i long, v array<double>")
    got = {(r["a"], r["b"]) for r in similar_pairs(df, "g", "i", "v", 0.5, block=16).collect()}
    assert got == {(a, b) for a in range(90) for b in range(a + 1, 90) if a % 2 == b % 2 and v[a] @ v[b] >= 0.5}
    near = nearest_exact(df.filter("i < 10"), df, "i", "v", 3, block=20).collect()
    for q in range(10):
        s = v @ v[q]
        s[q] = -2
        assert [r["other"] for r in sorted((r for r in near if r["query"] == q), key=lambda r: r["place"])] == list(np.argsort(-s)[:3])
    p = {r["g"]: r["prototype"] for r in prototypes(df, ["g"], "v", 6).collect()}
    m = v[::2].mean(0)
    assert np.allclose(p[0], m / np.linalg.norm(m))


@pytest.mark.parametrize("n, cap", [(300, 16), (5, 16), (300, 0), (7, 1), (31, 8)])
def test_even_rows(spark, n, cap):
    df = spark.range(n).selectExpr("'g' as g", "id as i")
    kept = sorted(r["i"] for r in even_rows(df, ["g"], ["i"], cap).collect())
    if cap <= 0 or n <= cap:
        assert kept == list(range(n))
    else:
        assert kept == sorted({int(np.rint(x)) for x in np.linspace(0, n - 1, cap)})


def test_unit_and_boxes(spark):
    df = spark.createDataFrame([([3.0, 4.0], 0, 0, 10, 10, 5, 5, 15, 15), ([0.0, 0.0], 0, 0, 0, 0, 0, 0, 0, 0), ([float("nan"), 1.0], -5, 3, 9, 9, 0, 0, 4, 4)], "v array<double>, x1 int, y1 int, x2 int, y2 int, o_x1 int, o_y1 int, o_x2 int, o_y2 int")
    rows = df.select(unit(F.col("v")).alias("u"), geo.iou(geo.box(), geo.box("o_")).alias("iou"), geo.iou(geo.box(), geo.box("o_"), floored=True).alias("fl"), geo.containment(geo.box(), geo.box("o_")).alias("c"), geo.clamped(geo.box(), 8, 8).alias("k")).collect()
    assert rows[0]["u"] == [0.6, 0.8] and rows[1]["u"] is None and rows[2]["u"] is None
    assert rows[0]["iou"] == pytest.approx(25 / 175) and rows[1]["iou"] == 0 and rows[1]["fl"] == 0 and rows[0]["c"] == 0.25
    assert tuple(rows[0]["k"]) == (0, 0, 8, 8) and rows[1]["k"] is None


def test_quality_and_sql_functions(spark):
    df = spark.createDataFrame([(20, 100, 50.0, 100.0), (30, 60, 50.0, 100.0), (30, 70, 50.0, 100.0), (60, 120, 10.0, 100.0), (60, 120, 50.0, 250.0), (60, 120, None, None), (130, 70, 50.0, 100.0)], "w int, h int, b double, l double")
    got = [r[0] for r in df.select(scoring.quality_reason(F.col("w"), F.col("h"), F.lit(640 * 480), F.col("b"), F.col("l"))).collect()]
    assert got == ["too_narrow", "too_short", "too_small", "blurry", "bad_brightness", "ok", "bad_aspect"]
    scoring.register(spark)
    row = spark.sql("select reid_cosine(array(1D, 0D), array(1D, 1D)), reid_unit(array(0D, 0D)), reid_quality(null, null, null), reid_quality(true, 60D, 127.5D), reid_quality(false, 60D, 100D), reid_verify(1D, 1D, 10, 0D, 1D)").first()
    assert row[0] == pytest.approx(0.5**0.5) and row[1] is None and row[2:5] == (0.5, 1.0, 0.0)
    assert row[5] == pytest.approx(1 / (1 + np.exp(-(-13.5 + 11 + 7 + 0.6 * np.log(11) + 1))))


def test_topology(spark):
    edges = spark.createDataFrame([("a", "b", 3.0), ("b", "a", 2.0), ("b", "c", -4.0), ("x", "y", 1.0), (None, "a", 1.0)], "cam_a string, cam_b string, min_transit_sec double")
    t = shortest_transits(edges)
    d = {(r["cam_a"], r["cam_b"]): r["seconds"] for r in t.collect()}
    assert d["a", "c"] == 2 and d["c", "a"] == 2 and d["a", "a"] == 0 and d["a", "x"] is None
    moves = spark.createDataFrame([("a", "c", 2.0), ("a", "c", 1.9), ("a", "x", 1e9), ("a", "q", 0.0), ("a", "a", -5.0)], "s string, t string, g double")
    got = {(r["s"], r["t"], r["g"]): r["allowed"] for r in with_transit(moves, t, "s", "t", F.col("g")).collect()}
    assert got == {("a", "c", 2.0): True, ("a", "c", 1.9): False, ("a", "x", 1e9): False, ("a", "q", 0.0): True, ("a", "a", -5.0): True}
    assert shortest_transits(edges.limit(0)).count() == 0


def test_margins_and_gaps(spark):
    rows = [(1, 1, "a", 0.9, None), (2, 1, "b", 0.8, None), (3, 1, "c", 0.95, "TEMPORAL_CONFLICT_SAME_CAMERA"), (4, 2, "a", 0.5, "BELOW_ABSOLUTE_THRESHOLD"), (5, 3, "a", 0.7, None), (6, 3, "b", None, None)]
    df = spark.createDataFrame(rows, "cand_id long, decision_id long, handle string, score double, excluded_by string")
    m = {r["decision_id"]: r for r in log.top2_margins(df).collect()}
    assert (m[1]["margin_eligible"], m[1]["margin_all_scored"], m[1]["runner_up_differs"]) == (0.1, -0.05, True)
    assert m[2]["best_handle"] is None and m[2]["runner_up_differs"] is None
    assert m[3]["margin_eligible"] is None and m[3]["runner_up_differs"] is False
    g = {r["decision_id"]: (r["gap"], r["lower_edge"]) for r in log.natural_gaps(df).collect()}
    assert g == {1: (0.1, 0.8)}


def test_names_and_options(tmp_path):
    for f in ("b.mp4", "a.MKV", "notes.txt", "c.mpeg", "d.mpg"):
        (tmp_path / f).write_text("")
    assert [n for n, _ in resolve(folder=str(tmp_path))] == ["a", "b", "c", "d"]
    assert [n for n, _ in named(["x/cam_2.mp4", "rtsp://10.0.0.2/s", "rtsp://10.0.1.2/s"])] == ["cam_2", "cam_2_2", "cam_2_3"]
    assert transport_options("udp", 3, fflags="nobuffer") == "rtsp_transport;udp|timeout;3000|stimeout;3000|fflags;nobuffer"
    assert transport_options("", 0) == "" and transport_options(None, None, a=1) == "a;1"
    with pytest.raises(FileNotFoundError):
        resolve(given=["/nowhere/x.mp4"])


def test_store_and_log(spark, tmp_path):
    store = ObservationStore(spark, str(tmp_path / "obs"), dim=2)
    rows = spark.createDataFrame([(1, "r1", [1.0, 0.0]), (2, "r1", [0.0, 1.0]), (3, "r2", [0.6, 0.8])], "obs_id long, run_id string, embedding array<float>")
    assert store.count() == 0
    store.add(rows)
    assert store.count() == 3 and store.rows("r2").count() == 1
    assert [r["other"] for r in store.search(rows.filter("obs_id = 3"), 1).collect()] == [2]
    with pytest.raises(KeyError):
        store.rows("r3")
    with pytest.raises(Exception):
        store.add(spark.createDataFrame([(9, "r1", [1.0])], "obs_id long, run_id string, embedding array<float>"))
    with pytest.raises(PermissionError):
        ObservationStore(spark, str(tmp_path / "obs"), 2, read_only=True).reset()
    store.reset()
    assert store.count() == 0
    for name in ("20240101_000000", "20240102_000000"):
        write_decision_log(str(tmp_path / "logs" / name), rows, rows, rows.limit(1))
    assert latest_log(str(tmp_path / "logs")).endswith("20240102_000000")
    assert read_decision_log(spark, latest_log(str(tmp_path / "logs")), "decision", "obs_id long, run_id string").count() == 3


def observations(spark):
    rng = np.random.RandomState(4)
    people = rng.randn(4, 8)
    rows = []
    for i in range(240):
        who = i % 4
        v = people[who] + 0.1 * rng.randn(8)
        rows.append((i, f"r{who % 2}", f"c{i // 60 % 2}", who + 10 * (i // 120), i, float(i) * 0.4, None if i % 17 == 0 else (v / np.linalg.norm(v)).tolist(), 0.5))
    return spark.createDataFrame(rows, "det_id long, run_id string, cam string, track_id long, frame_index long, ts double, unit_vector array<double>, quality double")


def test_live_stream_equals_replay(spark, tmp_path):
    obs = observations(spark)
    want = {(r["det_id"], r["identity"], r["event"]) for r in engine.replay(obs).collect()}
    assert len({i for _, i, _ in want if i > 0}) == 4 // 2  # two people a run, numbered anew in each run
    for k in range(4):
        obs.filter(f"det_id div 60 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = engine.live(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["det_id"], r["identity"], r["event"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_a_stream_out_of_order_is_decided_as_its_replay(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, "r", "ab"[i % 2], i % 6, i, i * 0.5, [float(x) for x in np.random.RandomState(i % 3).randn(8) + 0.1 * np.random.RandomState(i).randn(8)], 1.0) for i in range(120)]
    rows = [(*r[:6], (np.array(r[6]) / np.linalg.norm(r[6])).tolist(), r[7]) for r in rows]
    kind = "det_id long, run_id string, cam string, track_id long, frame_index long, ts double, unit_vector array<double>, quality double"
    want = {r["det_id"]: (r["identity"], r["event"]) for r in engine.replay(spark.createDataFrame(rows, kind)).collect()}
    late = (500, "r", "a", 0, 0, 0.0, rows[0][6], 1.0)
    mixed = sorted(rows, key=lambda r: r[5] + rng.random() * 4)
    for k in range(0, 120, 30):
        spark.createDataFrame(mixed[k : k + 30] + ([late] if k == 90 else []), kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.createDataFrame(rows, kind).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = engine.live(stream, hold_sec=5.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["det_id"]: (r["identity"], r["event"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got.pop(500) == (None, "late")
    assert len(got) >= 105 and all(want[i] == x for i, x in got.items())  # the newest five seconds are still held


def test_fresh_batches():
    b = engine.FreshBatcher(2, 1.0)
    for cam, frame, ts in (("a", 1, 0.0), ("b", 1, 0.1), ("a", 2, 0.9), ("c", 1, 1.0), ("d", 1, 1.0)):
        b.put(cam, frame, ts)
    assert b.take(1.5) == engine.Batch([("a", 2, 0.9), ("c", 1, 1.0)], 1, 1)
    assert b.take(1.5) == engine.Batch([("d", 1, 1.0)], 0, 0) and b.take(1.5).frames == []
    assert engine.reconnect_delays(4, 2.0, 5.0) == [2.0, 4.0, 5.0, 5.0]


def test_throttle(spark):
    kind = "det_id long, run_id string, cam string, track_id long, frame_index long, accepted boolean"
    rows = spark.createDataFrame([(i, "r", "c", 1, i, True) for i in range(30)] + [(100, "r", "c", 2, 29, True), (101, "r", "c", None, 3, True)], kind)
    none = rows.limit(0)
    due = lambda *a, **kw: sorted(r["det_id"] for r in engine.throttled(*a, **kw).collect() if r["due"])
    assert due(rows, none) == [0, 1, 2, 12, 22, 100]
    assert due(rows, none, 10, 3, cap=4) == [0, 1, 2, 12, 100]
    # Frames without detections are ticks, rejected crops are no embeddings and are tried again, and a track out of sight is forgotten.
    sparse = spark.createDataFrame([(0, "r", "c", 1, 0, True), (1, "r", "c", 1, 2, False), (2, "r", "c", 1, 4, None), (3, "r", "c", 1, 6, True), (4, "r", "c", 1, 8, True), (5, "r", "c", 1, 12, True), (6, "r", "c", 1, 18, True), (7, "r", "c", 1, 200, False), (8, "r", "c", 1, 201, True)], kind)
    frames = spark.createDataFrame([("r", "c", i) for i in range(202)], "run_id string, cam string, frame_index long")
    got = {r["det_id"]: (r["due"], r["vector_of"]) for r in engine.throttled(sparse, frames).collect()}
    assert got == {0: (True, 0), 1: (False, 0), 2: (False, 0), 3: (True, 3), 4: (True, 4), 5: (False, 4), 6: (True, 6), 7: (False, None), 8: (True, 8)}


def test_the_reciprocal_guard_asks_the_candidates_own_bank():
    """A rival whose prototype is closer to the candidate's bank than the track is keeps it from being linked."""
    unit = lambda *x: np.array(x) / np.linalg.norm(x)
    cfg = engine.LiveConfig(min_evidence=1, cross_bar=0.5, margin=0.0)

    def link(rival_seen_here):
        e = engine.Engine(cfg)
        e.observe("a", 1, 0.0, unit(1, 0, 0), 1.0)
        first = e.tracks["a", 1].identity
        other = engine.Identity(engine.deque([unit(1, 0.1, 0)], maxlen=20), unit(1, 0.1, 0), {"b": [[50.0, 150.0]] if rival_seen_here else [[0.0, 1.0]]}, {}, ("b", 1.0))
        e.identities[99] = other
        return e.observe("c" if not rival_seen_here else "b", 7, 100.0, unit(1, 0, 0.6), 1.0)[1], first

    assert link(False)[0] == "minted"  # the rival's prototype is at 0.995, the track at 0.86
    assert link(True)[0] == "linked"  # one that is on screen here can't be the candidate's other half


def test_labels(spark):
    rows = [(None, None, None, None, 0.876), (None, None, None, 3, 0.876), (None, None, -2, 3, 0.5), (None, None, 9, 3, 0.5), (4, 0.7, 9, 3, 0.5), (4, None, None, None, 0.5)]
    df = spark.createDataFrame(rows, "reid long, score double, gid long, track long, conf double")
    got = [tuple(r) for r in df.select(scoring.palette_index(F.coalesce("reid", "gid")), scoring.display_label(*[F.col(c) for c in df.columns])).collect()]
    assert got == [(-1, "person 0.88"), (-1, "ID 3  0.88"), (6, "REID ...  ID3"), (1, "GID 9  ID3"), (4, "REID 4 (0.70)  ID3"), (4, "REID 4")]


def test_a_topology_with_many_parallel_edges(spark, monkeypatch):
    from sightweave.operators import topology

    monkeypatch.setattr(topology, "MAX_CAMERAS", 3)
    edges = spark.createDataFrame([("a", "b", float(9 + i)) for i in range(40)] + [("c", "b", 2.0), ("b", "a", 4.0)], "cam_a string, cam_b string, min_transit_sec double")
    assert {(r[0], r[1]): r[2] for r in topology.shortest_transits(edges).collect()}["a", "c"] == 6.0
    with pytest.raises(ValueError):
        topology.shortest_transits(edges.unionByName(spark.createDataFrame([("d", "a", 1.0)], edges.schema)))


def test_core_needs_no_llm():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "sightweave"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "sightweave.llm" not in p.read_text(), p


def test_components_of_a_dealt_hub(spark, monkeypatch):
    from sightweave.operators import components

    monkeypatch.setattr(components, "HUB", 20)
    edges = [(0, i) for i in range(1, 90)] + [(i, i + 1000) for i in range(1, 60)] + [(5000, 5001)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {0, 5000} and got[1059] == 0 and len(got) == 151


def test_percentiles_over_ranges(spark):
    from sightweave.operators.ranks import counted, linear_percentiles

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0.5, rng.random(), None])) for _ in range(700)] + [("lone", 2.0), ("void", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: (r["n"], r["values"]) for r in linear_percentiles(df, ["g"], "v", [0.0, 0.05, 0.5, 1.0]).collect()}
    for g in ("a", "b", None, "lone"):
        v = [x for h, x in rows if h == g and x is not None]
        assert got[g][0] == len(v) and np.allclose(got[g][1], np.quantile(v, [0.0, 0.05, 0.5, 1.0]))
    assert "void" not in got
    one = linear_percentiles(df, [], "v", [0.3]).first()
    every = [x for _, x in rows if x is not None]
    assert one["n"] == len(every) and abs(one["values"][0] - np.quantile(every, 0.3)) < 1e-12
    low = {r["v"]: r["below_n"] for r in counted(df, [], "v", {"n": F.count(F.lit(1))}).collect()}
    assert all(b == sum(x < v for x in every) for v, b in low.items())
    assert linear_percentiles(df.limit(0), ["g"], "v", [0.5]).count() == 0
