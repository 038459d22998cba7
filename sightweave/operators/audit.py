"""Audit records of the reconcile: for every subject its scored candidates, gates and margins.

A subject is a tracklet (phase same_camera, against the tracklets of its camera) or a cluster (phase
cross_camera, against the clusters of its run). Records describe decisions and never change them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightweave.config import ReconcileConfig

#: Candidates listed for a subject at most; a record tells when its list was cut.
MAX_CANDIDATES = 200

RECORD = """run_id string, handle string, phase string, observations long, cameras array<string>, gates_failed array<string>, best_handle string, best_score double, margin_eligible double,
candidates array<struct<handle: string, score: double, excluded_by: string, would_fail_reciprocity: boolean, cluster_size: long, observations: long, pair_similarity_to_best: double>>,
candidates_truncated boolean, scored_count long, eligible_count long"""


def _records(pdf: pd.DataFrame, cfg: ReconcileConfig, phase: str, limit: int) -> pd.DataFrame:
    """Records of one group; memory is one row of scores at a time."""
    pdf = pdf.sort_values("key").reset_index(drop=True)
    v = np.array(pdf["prototype"].tolist(), dtype=np.float64)
    cam, start, end = pdf["cam"].to_numpy(), pdf["first_frame"].to_numpy(), pdf["last_frame"].to_numpy()
    items, own = np.unique(pdf["item"].to_numpy(), return_inverse=True)
    n = len(items)
    sums = np.zeros((n, v.shape[1]))
    np.add.at(sums, own, v)
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    p = sums / np.where(length == 0, 1, length)
    names = sorted(set(cam))
    inside = np.zeros((n, len(names)), bool)
    inside[own, np.searchsorted(names, cam)] = True
    bars = np.array([cfg.bar(c) for c in names])
    size, seen = np.bincount(own, minlength=n), np.bincount(own, pdf["observations"], n).astype(np.int64)
    letter = "U" if phase == "same_camera" else "C"
    handles = pdf.groupby("item")["number"].min().loc[items].map(lambda k: f"{letter}-{k:04d}").tolist()
    single = inside.sum(1) == 1

    def row(i: int):
        score = p @ p[i]
        collide = np.zeros(n, bool)
        for m in np.flatnonzero(own == i):
            hit = (cam == cam[m]) & ~((end < start[m]) | (end[m] < start))
            collide[own[hit]] = True
        both = inside & inside[i]
        shared = both.any(1)
        bar = np.where(shared, np.where(both, bars, -np.inf).max(1), cfg.cross_bar)
        apart = np.ones(n, bool) if phase == "same_camera" else ~(shared & single & single[i])
        reason = np.where(collide, 1, np.where(~apart, 2, np.where(score < bar, 3, 0)))
        reason[i] = -1
        return score, reason, bar

    best = np.full(n, -1)
    for i in range(n):
        score, reason, _ = row(i)
        able = np.flatnonzero(reason == 0)
        if len(able):
            best[i] = able[np.lexsort((able, score[able]))[-1]]
    words = {0: None, 1: "TEMPORAL_CONFLICT_SAME_CAMERA", 2: "NOT_MERGEABLE_CROSS", 3: "BELOW_ABSOLUTE_THRESHOLD"}
    out = []
    for i in range(n):
        if n == 1:
            break  # a subject without peers has no decision
        score, reason, _ = row(i)
        others = np.flatnonzero(reason >= 0)
        order = others[np.lexsort((-others, -score[others]))]
        able = order[reason[order] == 0]
        failed = []
        if not len(able):
            failed.append("ABSOLUTE_THRESHOLD")
        elif cfg.reciprocal and phase == "cross_camera" and best[best[i]] != i:
            failed.append("RECIPROCAL_BEST")
        listed = order[:limit]
        near = p[listed] @ p[best[i]] if best[i] >= 0 else None
        cands = [
            {"handle": handles[j], "score": float(round(score[j], 6)), "excluded_by": words[int(reason[j])], "would_fail_reciprocity": bool(best[j] != i) if reason[j] == 0 else None, "cluster_size": int(size[j]), "observations": int(seen[j]), "pair_similarity_to_best": None if near is None else float(round(near[k], 6))}
            for k, j in enumerate(listed)
        ]
        margin = float(round(score[able[0]] - score[able[1]], 6)) if len(able) > 1 else None
        out.append((pdf["run_id"][0], handles[i], phase, int(seen[i]), [c for c, x in zip(names, inside[i]) if x], failed, handles[best[i]] if best[i] >= 0 else None, float(round(score[best[i]], 6)) if best[i] >= 0 else None, margin, cands, len(order) > limit, len(order), len(able)))
    return pd.DataFrame(out, columns=["run_id", "handle", "phase", "observations", "cameras", "gates_failed", "best_handle", "best_score", "margin_eligible", "candidates", "candidates_truncated", "scored_count", "eligible_count"])


def audit(members: DataFrame, cfg: ReconcileConfig, phase: str, max_candidates: int = MAX_CANDIDATES) -> DataFrame:
    """Records of all subjects, given members as cluster_tracklets() returns them.

    Candidates come best first (ties: the smaller key). Reasons for exclusion in order: spans collide,
    not mergeable across cameras, below the bar. A task holds the tracklets (not the observations) of
    one camera or run.
    """
    same = phase == "same_camera"
    item = F.col("key") if same else F.col("root")
    columns = ["run_id", "cam", "key", "first_frame", "last_frame", "observations", "prototype", item.alias("item"), item.alias("number")]
    keys = ["run_id", "cam"] if same else ["run_id"]
    return members.select(*columns).groupBy(*keys).applyInPandas(lambda pdf: _records(pdf, cfg, phase, max_candidates), RECORD)


def suppressed_records(tracklets: DataFrame, cfg: ReconcileConfig) -> DataFrame:
    """Records of tracklets with too few observations: they fail two gates and have no candidates."""
    short = tracklets.filter(F.col("observations") < cfg.min_observations)
    return short.select("run_id", "cam", "track_id", F.lit("suppressed").alias("phase"), "observations", F.array(F.lit("MIN_OBSERVATIONS"), F.lit("ABSOLUTE_THRESHOLD")).alias("gates_failed"))
