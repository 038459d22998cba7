"""Offline reconcile: tracklets to identities by constrained agglomerative clustering.

Phase 1 joins fragments within a camera, greedily by score. Phase 2 runs rounds over all clusters of
all runs at once: prototypes, pairs over their bar, conflicts, best partners, mutual ones, union.
Mutual best partners are pairwise disjoint, so a round's unions can be made together. The driver
only sees how many unions a round made.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightweave.config import ReconcileConfig
from sightweave.functions.vectors import prototypes
from sightweave.operators.pairs import set_score, similar_pairs
from sightweave.operators.rounds import ROWS, SETTLED, joined_rounds, rounds_of_run, set_edges
from sightweave.operators.tracklets import KEY, even_rows, tracklets, with_prototypes
from sightweave.session import cut

#: Tracklets of a run that one task may hold for all rounds; clusters that it may hold after joined rounds.
RUN_LIMIT = 80_000
#: Observations of a run that one task may hold where rows score.
SET_LIMIT = 200_000


def bar_column(camera: Column, cfg: ReconcileConfig) -> Column:
    """The same-camera bar of a camera."""
    if not cfg.bars:
        return F.lit(cfg.same_bar)
    named = F.create_map(*[F.lit(x) for kv in cfg.bars.items() for x in kv])
    return F.coalesce(named[camera], F.lit(cfg.same_bar))


def _greedy(pdf: pd.DataFrame, cfg: ReconcileConfig) -> pd.DataFrame:
    """Phase 1 of one camera of one run: unions by descending (score, a, b) where no spans collide. Scores count to twelve places."""
    pdf = pdf.sort_values("key").reset_index(drop=True)
    n = len(pdf)
    v = np.array(pdf["prototype"].tolist(), dtype=np.float64)
    start, end = pdf["first_frame"].to_numpy(), pdf["last_frame"].to_numpy()
    bar = cfg.bar(pdf["cam"].iloc[0])
    sets = [np.array([np.asarray(r, dtype=np.float64) for r in rows]) for rows in pdf["rows"]] if "rows" in pdf else None
    free = lambda x, y: (x < y) & ((end[x] < start[y]) | (end[y] < start[x]))
    found = []
    if sets is not None and cfg.scoring != "prototype":
        found = [(np.round(s, 12), x, y) for x, y, s in set_edges(sets, v, cfg.scoring, cfg.top_frac, np.arange(n), np.arange(n), bar, free)]
    else:
        for i in range(0, n, ROWS):
            x, y = np.nonzero((s := v[i : i + ROWS] @ v[i:].T) >= bar)
            keep = free(x + i, y + i)
            found.append((np.round(s[x[keep], y[keep]], 12), x[keep] + i, y[keep] + i))
    score, a, b = (np.concatenate([f[k] for f in found]) for k in range(3))
    order = np.lexsort((b, a, score))[::-1]
    members = {i: [i] for i in range(n)}
    spans = [([x], [y]) for x, y in zip(start.tolist(), end.tolist())]  # of each cluster in order: they don't collide
    root = list(range(n))
    for i, j in zip(a[order].tolist(), b[order].tolist()):
        x, y = root[i], root[j]
        if x == y:
            continue
        few, many = (spans[x], spans[y]) if len(spans[x][0]) <= len(spans[y][0]) else (spans[y], spans[x])
        if any((k := bisect_right(many[0], e)) and many[1][k - 1] >= s for s, e in zip(*few)):
            continue
        x, y = min(x, y), max(x, y)
        for m in members[y]:
            root[m] = x
        members[x] += members.pop(y)
        spans[x] = (sorted(spans[x][0] + spans[y][0]), sorted(spans[x][1] + spans[y][1]))
    pdf["root"] = pdf["key"].to_numpy()[root]
    return pdf[["run_id", "key", "root"]]


def _conflicts(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Of candidate pairs of roots those with two members whose spans collide in one camera: run_id, a, b."""
    left = members.select("run_id", F.col("root").alias("a"), "cam", F.col("first_frame").alias("s1"), F.col("last_frame").alias("e1"))
    right = members.select("run_id", F.col("root").alias("b"), "cam", F.col("first_frame").alias("s2"), F.col("last_frame").alias("e2"))
    both = pairs.select("run_id", "a", "b").join(left, ["run_id", "a"]).join(right, ["run_id", "b", "cam"])
    return both.filter("not (e1 < s2 or e2 < s1)").select("run_id", "a", "b").distinct()


def candidate_edges(members: DataFrame, cfg: ReconcileConfig, dim: int, rows: DataFrame | None = None) -> DataFrame:
    """run_id, a, b, score, bar of the mergeable pairs of clusters that meet their bar.

    A pair without a common camera faces the cross bar, else the strictest bar of the common cameras;
    two clusters of one and the same single camera aren't mergeable here.
    """
    protos = prototypes(members, ["run_id", "root"], "prototype", dim).filter("prototype is not null")
    if rows is not None and cfg.scoring != "prototype":
        sampled = even_rows(members.select("run_id", "root", "key").join(rows, ["run_id", "key"]), ["run_id", "root"], ["key", "frame_index", "det_id"], cfg.cap)
        listed = sampled.groupBy("run_id", "root").agg(F.transform(F.array_sort(F.collect_list(F.struct("key", "frame_index", "det_id", "unit_vector"))), lambda x: x["unit_vector"]).alias("rows"))
        protos = protos.join(listed, ["run_id", "root"])
    least = min([cfg.cross_bar, cfg.same_bar, *cfg.bars.values()])
    pairs = similar_pairs(protos, "run_id", "root", "prototype", least, rows="rows" if "rows" in protos.columns else None, mode=cfg.scoring, top_frac=cfg.top_frac)
    cams = members.groupBy("run_id", "root").agg(F.collect_set("cam").alias("cams"))
    named = pairs.join(cams.select("run_id", F.col("root").alias("a"), F.col("cams").alias("ca")), ["run_id", "a"]).join(cams.select("run_id", F.col("root").alias("b"), F.col("cams").alias("cb")), ["run_id", "b"])
    shared = F.array_intersect("ca", "cb")
    bar = F.when(F.size(shared) == 0, F.lit(cfg.cross_bar)).otherwise(F.array_max(F.transform(shared, lambda c: bar_column(c, cfg))))
    mergeable = ~((F.size("ca") == 1) & (F.size("cb") == 1) & (F.size(shared) == 1))
    over = named.withColumn("bar", bar).filter(mergeable & (F.col("score") >= F.col("bar"))).select("run_id", "a", "b", "score", "bar")
    return over.join(_conflicts(over, members), ["run_id", "a", "b"], "left_anti")


def best_partners(edges: DataFrame) -> DataFrame:
    """run_id, me, partner, score: each cluster's best edge (ties: the larger partner)."""
    both = edges.select("run_id", F.col("a").alias("me"), F.col("b").alias("partner"), "score").unionByName(edges.select("run_id", F.col("b").alias("me"), F.col("a").alias("partner"), "score"))
    return both.groupBy("run_id", "me").agg(F.max(F.struct("score", "partner")).alias("m")).select("run_id", "me", "m.partner", "m.score")


def mutual(best: DataFrame) -> DataFrame:
    """run_id, a, b, score of the pairs that are each other's best."""
    other = best.select("run_id", F.col("me").alias("partner"), F.col("partner").alias("back"))
    return best.join(other, ["run_id", "partner"]).filter("back = me and me < partner").select("run_id", F.col("me").alias("a"), F.col("partner").alias("b"), "score")


def _ordered_unions(edges: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
    """Without mutuality: unions by descending (score, a, b) with the conflicts of the clusters as they are then."""
    spans = {r: list(zip(g["cam"], g["first_frame"], g["last_frame"])) for r, g in members.groupby("root")}
    root = {r: r for r in spans}

    def find(r):
        while root[r] != r:
            r = root[r]
        return r

    done = []
    pairs = {(min(a, b), max(a, b)): s for a, b, s in zip(edges["me"], edges["partner"], edges["score"])}
    for (a, b), score in sorted(pairs.items(), key=lambda kv: (kv[1], *kv[0]), reverse=True):
        x, y = find(a), find(b)
        if x == y or any(c == d and not (e1 < s2 or e2 < s1) for c, s1, e1 in spans[x] for d, s2, e2 in spans[y]):
            continue
        x, y = min(x, y), max(x, y)
        spans[x] += spans.pop(y)
        root[y] = x
        done.append((y, score))
    run = members["run_id"].iloc[0] if len(members) else edges["run_id"].iloc[0]
    return pd.DataFrame({"run_id": run, "old": [y for y, _ in done], "new": [find(y) for y, _ in done], "score": [s for _, s in done]}).astype({"old": "int64", "new": "int64", "score": "float64"})


def numbered(obs: DataFrame, dim: int, min_observations: int, every: DataFrame | None = None) -> DataFrame:
    """Tracklets of enough observations with their prototype and their number in the run (key); every: all tracklets with a prototype or null, if made before."""
    kept = with_prototypes(obs, dim, min_observations) if every is None else every.filter((F.col("observations") >= min_observations) & F.col("prototype").isNotNull())
    key = F.row_number().over(Window.partitionBy("run_id").orderBy("cam", "track_id")) - 1
    return cut(kept.withColumn("key", key.cast("long")))


def cluster_tracklets(obs: DataFrame, cfg: ReconcileConfig, dim: int, run_limit: int = RUN_LIMIT, keyed: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Members (run_id, key, cam, track_id, span, observations, gids, root) of all clusters, and the number of rounds.

    The tracklet that a cluster was called after has merge_score and merge_round of the union in which
    the cluster went up in another one. keyed: what numbered() makes of obs, if made before.
    """
    keyed = numbered(obs, dim, cfg.min_observations) if keyed is None else keyed
    rows = obs.select("det_id", "frame_index", "unit_vector", *KEY).join(keyed.select(*KEY, "key"), KEY).select("run_id", "key", "frame_index", "det_id", "unit_vector") if cfg.scoring != "prototype" else None
    phase1 = keyed
    if rows is not None:
        listed = even_rows(rows, ["run_id", "key"], ["frame_index", "det_id"], cfg.cap).groupBy("run_id", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_index", "det_id", "unit_vector"))), lambda x: x["unit_vector"]).alias("rows"))
        phase1 = keyed.join(listed, ["run_id", "key"])
    columns = ["run_id", "cam", "key", "first_frame", "last_frame", "prototype", *(["rows"] if rows is not None else [])]
    roots = phase1.select(*columns).groupBy("run_id", "cam").applyInPandas(lambda pdf: _greedy(pdf, cfg), "run_id string, key long, root long")
    members = cut(keyed.join(roots, ["run_id", "key"]))
    rounds = 0
    done = None
    if cfg.reciprocal:
        # Runs of up to RUN_LIMIT tracklets take one task each; the joined form begins the larger ones.
        columns = ["run_id", "key", "cam", "first_frame", "last_frame", "prototype", "root"]
        counted = members.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum("observations").alias("m"))
        fits = f"n <= {run_limit}" + ("" if rows is None else f" and m <= {SET_LIMIT}")
        small, large = (counted.filter(test).select("run_id") for test in (fits, f"not ({fits})"))
        within = members.join(small, "run_id", "left_semi").select(*columns)
        if rows is not None:
            listed = rows.groupBy("run_id", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_index", "det_id", "unit_vector"))), lambda x: x["unit_vector"]).alias("rows"))
            within = within.join(listed, ["run_id", "key"])
        settled, rounds = within.groupBy("run_id").applyInPandas(lambda pdf: rounds_of_run(pdf, cfg), SETTLED), 1
        more = not large.isEmpty()
        if more and rows is None:
            joined, rounds = joined_rounds(members.join(large, "run_id", "left_semi").select(*columns), cfg, dim, limit=run_limit)
            settled, more = settled.unionByName(joined), False
        done = cut(members.join(settled, ["run_id", "key"]).withColumn("root", F.col("final")).drop("final"))
        if not more:
            return done, rounds
        members, rounds = members.join(large, "run_id", "left_semi"), 0
    members = members.withColumns({"merge_score": F.lit(None).cast("double"), "merge_round": F.lit(None).cast("int")})
    while True:  # every round but the last makes a union
        rounds += 1
        best = best_partners(candidate_edges(members, cfg, dim, rows))
        if cfg.reciprocal:
            moves = mutual(best).select("run_id", F.col("b").alias("old"), F.col("a").alias("new"), "score")
        else:
            spans = members.select("run_id", "root", "cam", "first_frame", "last_frame")
            moves = best.groupBy("run_id").cogroup(spans.groupBy("run_id")).applyInPandas(_ordered_unions, "run_id string, old long, new long, score double")
        moves = cut(moves)
        if moves.isEmpty():
            break
        joined = members.join(moves.withColumnRenamed("old", "root"), ["run_id", "root"], "left")
        here = F.col("new").isNotNull() & (F.col("key") == F.col("root"))  # a cluster that ends is named on the tracklet it is called after
        told = joined.withColumns({"merge_score": F.when(here, F.col("score")).otherwise(F.col("merge_score")), "merge_round": F.when(here, F.lit(rounds)).otherwise(F.col("merge_round"))})
        members = cut(told.withColumn("root", F.coalesce("new", "root")).drop("new", "score"))
    return (members if done is None else cut(members.unionByName(done.select(*members.columns)))), rounds


def _allot(pdf: pd.DataFrame) -> pd.DataFrame:
    """Ids of one run's clusters in key order: the smallest id of its tracklets not used before, else the next fresh one."""
    used, fresh, out = set(), int(pdf["top"].iloc[0]) + 1, []
    for _, row in pdf.sort_values("root").iterrows():
        own = next((int(g) for g in sorted(row["gids"]) if g > 0 and g not in used), None)
        if own is None:
            own, fresh = fresh, fresh + 1
        used.add(own)
        out.append(own)
    return pd.DataFrame({"run_id": pdf["run_id"].iloc[0], "root": sorted(pdf["root"]), "identity": out})


def reconcile(obs: DataFrame, cfg: ReconcileConfig = ReconcileConfig(), dim: int = 128, run_limit: int = RUN_LIMIT) -> DataFrame:
    """run_id, cam, track_id, state, identity, root, observations, first_frame, last_frame of every tracklet.

    state is resolved or suppressed (too few observations; no identity). Ids are those of the
    cluster's tracklets where possible. In compat mode a run with fewer than two surviving tracklets
    gets no identities at all.
    """
    every = cut(tracklets(obs).join(prototypes(obs, KEY, "unit_vector", dim), KEY, "left"))
    members, _ = cluster_tracklets(obs, cfg, dim, run_limit, numbered(obs, dim, cfg.min_observations, every))
    top = every.groupBy("run_id").agg(F.coalesce(F.max(F.array_max("gids")), F.lit(0)).alias("top"))
    clusters = members.groupBy("run_id", "root").agg(F.array_distinct(F.flatten(F.collect_list("gids"))).alias("gids"), F.count(F.lit(1)).alias("tracklets"))
    named = clusters.join(top, "run_id").groupBy("run_id").applyInPandas(_allot, "run_id string, root long, identity long")
    mapped = members.select(*KEY, "root").join(named, ["run_id", "root"])
    if cfg.compat:
        many = members.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("run_id")
        mapped = mapped.join(many, "run_id", "left_semi")
    out = every.drop("gids", "prototype").join(mapped, KEY, "left")
    state = F.when(F.col("observations") < cfg.min_observations, "suppressed").when(F.col("identity").isNotNull(), "resolved").otherwise("expired_unresolved")
    return out.select(*KEY, state.alias("state"), "identity", "root", "observations", "first_frame", "last_frame")


def relabel(boxes: DataFrame, identity_map: DataFrame) -> DataFrame:
    """Boxes with the final identity of their track; tracks without one keep null."""
    return boxes.join(identity_map.select(*KEY, F.col("identity").alias("final_id")), KEY, "left")


#: A union of clusters of a score below this is doubtful.
CEILING = 0.661


def sweep(obs: DataFrame, configs: dict[str, ReconcileConfig], dim: int = 128, ceiling: float = CEILING) -> DataFrame:
    """Shape of the clusters under each setting: setting, run_id, identities, largest, multi_camera, and of the unions across cameras their number, how many are below the ceiling, and the least score."""
    out, keyed = None, {n: numbered(obs, dim, n) for n in {cfg.min_observations for cfg in configs.values()}}
    for name, cfg in configs.items():
        members, _ = cluster_tracklets(obs, cfg, dim, keyed=keyed[cfg.min_observations])
        merges = [F.count("merge_score").alias("m"), F.count_if(F.col("merge_score") < ceiling).alias("low"), F.min("merge_score").alias("least")]
        ids = members.groupBy("run_id", "root").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cam").alias("cams"), *merges)
        shape = ids.groupBy("run_id").agg(F.count(F.lit(1)).alias("identities"), F.max("n").alias("largest"), F.count_if(F.col("cams") > 1).alias("multi_camera"), F.sum("m").alias("cross_merges"), F.sum("low").alias("below_ceiling"), F.round(F.min("least"), 6).alias("least_score"))
        shape = shape.select(F.lit(name).alias("setting"), "*")
        out = shape if out is None else out.unionByName(shape)
    return out
