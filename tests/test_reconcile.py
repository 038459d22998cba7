"""Scenes with controlled cosines: how many identities must come out."""

from dataclasses import replace

import numpy as np
import pytest

from sightweave.config import ReconcileConfig, camera_bars
from sightweave.operators import reconcile as rec

DIM = 8


def unit(*c):
    v = np.zeros(DIM)
    v[: len(c)] = c
    return (v / np.linalg.norm(v)).tolist()


def at_cosine(c):
    return unit(c, (1 - c * c) ** 0.5)


def scene(spark, tracks):
    """tracks: (cam, track, first frame, vectors or vector, observations)."""
    rows, det = [], 0
    for cam, track, first, v, n in tracks:
        for i in range(n):
            rows.append((det, "r", cam, track, first + i, None, v[i] if isinstance(v[0], list) else v))
            det += 1
    return spark.createDataFrame(rows, "det_id long, run_id string, cam string, track_id long, frame_index long, gid long, unit_vector array<double>")


def identities(spark, tracks, **cfg):
    out = rec.reconcile(scene(spark, tracks), ReconcileConfig(**cfg), DIM).toPandas()
    return out["identity"].nunique(), (out["state"] == "suppressed").sum()


A, B, C = unit(1), unit(0, 1), unit(0, 0, 1)
FRONT_BACK = [*[unit(1)] * 3, *[unit(0.25, 1)] * 3]

SCENES = {
    "two people, one camera": ([("c1", 1, 0, A, 6), ("c1", 2, 100, B, 6)], {}, 2),
    "one person in fragments": ([("c1", 1, 0, A, 6), ("c1", 2, 100, A, 6)], {}, 1),
    "one person, two cameras": ([("c1", 1, 0, A, 6), ("c2", 1, 0, A, 6)], {}, 1),
    "three people, two cameras": ([("c1", 1, 0, A, 6), ("c2", 1, 0, A, 6), ("c1", 2, 50, B, 6), ("c2", 2, 50, C, 6)], {}, 3),
    "overlap in one camera never merges": ([("c1", 1, 0, A, 6), ("c1", 2, 3, A, 6)], {"same_bar": 0.10}, 2),
    "touching spans collide": ([("c1", 1, 0, A, 6), ("c1", 2, 5, A, 6)], {}, 2),
    "look-alike in a camera of the cluster": ([("c1", 1, 0, A, 6), ("c2", 1, 0, A, 6), ("c2", 2, 100, at_cosine(0.70), 6)], {"cross_bar": 0.63}, 2),
    "genuine fragment in the same setting": ([("c1", 1, 0, A, 6), ("c2", 1, 0, A, 6), ("c2", 2, 100, at_cosine(0.95), 6)], {"cross_bar": 0.63}, 1),
    "cameras apart at the cross bar": ([("c1", 1, 0, A, 6), ("c2", 1, 0, at_cosine(0.70001), 6)], {"cross_bar": 0.70}, 1),
    "below the cross bar": ([("c1", 1, 0, A, 6), ("c2", 1, 0, at_cosine(0.60), 6)], {}, 2),
    "same camera below the general bar": ([("c1", 1, 0, A, 6), ("c1", 2, 100, at_cosine(0.85), 6)], {}, 2),
    "same camera over its own bar": ([("c1", 1, 0, A, 6), ("c1", 2, 100, at_cosine(0.85), 6)], {"bars": {"c1": 0.80}}, 1),
    "own bar of another camera": ([("c1", 1, 0, A, 6), ("c1", 2, 100, at_cosine(0.85), 6)], {"bars": {"c9": 0.80}}, 2),
    "under its own bar": ([("c1", 1, 0, A, 6), ("c1", 2, 100, at_cosine(0.75), 6)], {"bars": {"c1": 0.80}}, 2),
    "single tracklet": ([("c1", 1, 0, A, 6)], {}, 1),
    "single tracklet, compatible": ([("c1", 1, 0, A, 6)], {"compat": True}, 0),
    "front and back, prototype": ([("c1", 1, 0, FRONT_BACK[:3] + FRONT_BACK[:3], 6), ("c2", 1, 0, [unit(1)] + [unit(0.25, 1)] * 5, 6)], {"scoring": "prototype", "cross_bar": 0.72}, 2),
    "front and back, best pair": ([("c1", 1, 0, FRONT_BACK[:3] + FRONT_BACK[:3], 6), ("c2", 1, 0, [unit(1)] + [unit(0.25, 1)] * 5, 6)], {"scoring": "max_exemplar", "cross_bar": 0.72}, 1),
    "one wrong crop, consensus": ([("c1", 1, 0, A, 6), ("c2", 1, 0, [A] + [B] * 5, 6)], {"scoring": "consensus", "top_frac": 0.5, "cross_bar": 0.72}, 2),
}


@pytest.mark.parametrize("name", SCENES)
def test_scene(spark, name):
    tracks, cfg, expected = SCENES[name]
    assert identities(spark, tracks, **cfg)[0] == expected


def test_short_tracklets_are_suppressed(spark):
    assert identities(spark, [("c1", 1, 0, A, 6), ("c1", 2, 50, B, 6), ("c2", 3, 0, C, 2)]) == (2, 1)


def test_joined_rounds_equal_rounds_in_a_task_and_input_order_is_free(spark):
    rng = np.random.RandomState(2)
    people = rng.randn(6, DIM)
    tracks = []
    for t in range(40):
        p = people[t % 6] + 0.25 * rng.randn(DIM)
        tracks.append((f"c{t % 3}", t, int(rng.randint(0, 60)) * 10, (p / np.linalg.norm(p)).tolist(), 4))
    obs = scene(spark, tracks)
    cfg = ReconcileConfig(cross_bar=0.75, same_bar=0.85)
    order = ["cam", "track_id"]
    a = rec.reconcile(obs, cfg, DIM).toPandas().sort_values(order).reset_index(drop=True)
    b = rec.reconcile(obs.orderBy("unit_vector"), cfg, DIM, run_limit=0).toPandas().sort_values(order).reset_index(drop=True)
    assert a.equals(b)
    one = replace(cfg, reciprocal=False)
    greedy = rec.reconcile(obs, one, DIM).toPandas()
    assert greedy["identity"].notna().all()
    # No two tracks that collide share an identity.
    for out in (a, greedy):
        for _, g in out.groupby(["identity", "cam"]):
            g = g.sort_values("first_frame")
            assert (g["first_frame"].to_numpy()[1:] > g["last_frame"].to_numpy()[:-1]).all()


def test_ids_are_reused_and_relabel_keeps_all_boxes(spark):
    obs = scene(spark, [("c1", 1, 0, A, 6), ("c2", 1, 0, A, 6), ("c1", 2, 50, B, 6), ("c1", 3, 90, C, 1)])
    obs = obs.selectExpr("* except (gid)", "case when track_id = 1 and cam = 'c1' then 7L when track_id = 3 then 30L end as gid")
    ids = rec.reconcile(obs, ReconcileConfig(), DIM)
    found = {(r["cam"], r["track_id"]): r["identity"] for r in ids.collect()}
    assert found == {("c1", 1): 7, ("c2", 1): 7, ("c1", 2): 31, ("c1", 3): None}
    assert rec.relabel(obs.select("run_id", "cam", "track_id", "frame_index"), ids).count() == obs.count()


@pytest.mark.parametrize("bad", [5, "x", ["c1"], {"c1": 0.8}, {"c1": {"threshold": 0.8}}, {"c1": {"same_camera_threshold": "0.8"}}, {"c1": {"same_camera_threshold": 1.5}}, {"c1": {"same_camera_threshold": True}}])
def test_bad_camera_settings_are_ignored(bad):
    assert camera_bars(bad) == {}


def test_good_camera_settings():
    assert camera_bars({"c1": {"same_camera_threshold": 0.8}, "c2": {"same_camera_threshold": 1}}) == {"c1": 0.8, "c2": 1.0}
    assert ReconcileConfig(scoring="nonsense").scoring == "prototype"


def test_audit_tells_every_candidate_and_changes_nothing(spark):
    from sightweave.operators.audit import audit, suppressed_records
    from sightweave.operators.tracklets import tracklets

    tracks = [("c1", 1, 0, A, 6), ("c1", 2, 3, A, 6), ("c1", 3, 100, at_cosine(0.95), 6), ("c1", 4, 200, B, 6), ("c2", 1, 0, A, 6), ("c2", 9, 500, C, 1)]
    obs, cfg = scene(spark, tracks), ReconcileConfig()
    before = {tuple(r) for r in rec.reconcile(obs, cfg, DIM).collect()}
    members, _ = rec.cluster_tracklets(obs, cfg, DIM)
    same = {r["handle"]: r for r in audit(members, cfg, "same_camera").collect()}
    assert set(same) == {"U-0000", "U-0001", "U-0002", "U-0003"}  # the only track of c2 has no peers
    first = {c["handle"]: c["excluded_by"] for c in same["U-0000"]["candidates"]}
    assert first == {"U-0001": "TEMPORAL_CONFLICT_SAME_CAMERA", "U-0002": None, "U-0003": "BELOW_ABSOLUTE_THRESHOLD"}
    assert same["U-0000"]["best_handle"] == "U-0002" and same["U-0000"]["eligible_count"] == 1 and same["U-0003"]["gates_failed"] == ["ABSOLUTE_THRESHOLD"]
    assert same["U-0002"]["margin_eligible"] == 0.0 and not same["U-0002"]["candidates_truncated"]
    cut = {r["handle"]: r for r in audit(members, cfg, "same_camera", max_candidates=1).collect()}
    assert len(cut["U-0000"]["candidates"]) == 1 and cut["U-0000"]["candidates_truncated"] and cut["U-0000"]["scored_count"] == 3
    cross = audit(members, cfg, "cross_camera").collect()
    assert all(c["excluded_by"] for r in cross for c in r["candidates"])  # the reconcile has ended: nothing is left to merge
    assert suppressed_records(tracklets(obs), cfg).count() == 1
    assert {tuple(r) for r in rec.reconcile(obs, cfg, DIM).collect()} == before
