"""Rounds of mutual best partners over clusters: the pairs, in a task for a run or joined by blocks of it.

Only pairs over their bar are looked at beyond their score. A cluster's best partner is kept over
rounds and looked for again only if either of them went into a union; others are compared with the
clusters that are new. So a round costs what changed. Scores count to twelve places.
The joined form gives a run to a task as soon as few enough of its clusters are left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightweave.config import ReconcileConfig
from sightweave.operators.pairs import set_score
from sightweave.session import cut, release

#: Rows of a matrix product; clusters of a block of the joined form; its rows of keys up to which a join takes them to the clusters instead of shuffling these.
ROWS, BLOCK, FEW = 256, 4096, 50_000
#: What rounds_of_run returns.
SETTLED = "run_id string, key long, final long, merge_score double, merge_round int"


class Spans:
    """Spans of clusters by camera; those of one cluster and camera are disjoint, so a sorted search tells a collision."""

    def __init__(self, own: np.ndarray, cam: np.ndarray, start: np.ndarray, end: np.ndarray):
        order = np.lexsort((start, cam, own))
        self.own, self.cam, self.start, self.end = own[order], cam[order].astype(np.int64), start[order], end[order]
        self.cams = int(cam.max(initial=0)) + 1
        self.starts = np.unique(self.start)
        self.width = len(self.starts) + 1
        self.code = (self.own.astype(np.int64) * self.cams + self.cam) * self.width + np.searchsorted(self.starts, self.start) + 1

    def collide(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of pairs of clusters, whether any spans in one camera collide (touching ones do)."""
        first, last = np.searchsorted(self.own, a), np.searchsorted(self.own, a, side="right")
        many = np.searchsorted(self.own, b, side="right") - np.searchsorted(self.own, b) < last - first
        a, b = np.where(many, b, a), np.where(many, a, b)  # the spans of the smaller are looked up in the larger
        first, last = np.searchsorted(self.own, a), np.searchsorted(self.own, a, side="right")
        out, n = np.zeros(len(a), bool), np.cumsum(last - first)
        for s in range(0, len(a), 1 << 18):
            pair = np.arange(s, min(len(a), s + (1 << 18)))
            count = (last - first)[pair]
            of = np.repeat(pair, count)
            row = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[of]
            # The last span of b in this camera that starts by the row's end.
            group = (b[of].astype(np.int64) * self.cams + self.cam[row]) * self.width
            at = np.searchsorted(self.code, group + np.searchsorted(self.starts, self.end[row], side="right"), side="right") - 1
            hit = (at >= 0) & (self.code[at] > group) & (self.end[at] >= self.start[row])
            out[of[hit]] = True
        return out


def even(rows: np.ndarray, cap: int) -> np.ndarray:
    """At most cap rows, as tracklets.even_rows takes them."""
    n = len(rows)
    if cap <= 0 or n <= cap:
        return rows
    return rows[:1] if cap == 1 else rows[np.unique(np.rint(np.arange(cap) * ((n - 1) / float(cap - 1))).astype(np.int64))]


def set_edges(sets: list[np.ndarray], u: np.ndarray, mode: str, top_frac: float, rows: np.ndarray, cols: np.ndarray, least: float, allowed: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, column, score of the allowed pairs of sets of unit rows with a score of at least least (see set_score; with max_exemplar also that of the prototypes u).

    Products in single precision rule out pairs: by their best, and the mean of the best k of n
    numbers is at most sqrt((n - k) / k) deviations over the mean of all. The others' scores are exact.
    """
    count = np.array([len(x) for x in sets])
    near = np.float32(least - 1e-4)

    def parts(of: np.ndarray, many: int) -> list[np.ndarray]:
        return np.split(of, np.flatnonzero(np.diff(np.cumsum(count[of]) // many)) + 1) if len(of) else []

    right = [(c, np.concatenate([sets[k] for k in c]).astype(np.float32).T, np.append(0, np.cumsum(count[c])[:-1])) for c in parts(cols, 8192)]
    for r in parts(rows, 1024):
        left, at = np.concatenate([sets[k] for k in r]).astype(np.float32), np.append(0, np.cumsum(count[r])[:-1])
        for c, there, to in right:
            s = left @ there
            able = np.maximum.reduceat(np.maximum.reduceat(s, at, axis=0), to, axis=1) >= near
            if mode == "max_exemplar":
                proto = u[r] @ u[c].T
                able |= proto >= least
            elif able.any():
                n = count[r][:, None] * count[c][None, :]
                k = np.maximum(1, np.rint(n * top_frac))
                mean = np.add.reduceat(np.add.reduceat(s, at, axis=0), to, axis=1) / n
                s *= s
                square = np.add.reduceat(np.add.reduceat(s, at, axis=0), to, axis=1) / n
                able &= mean + np.sqrt(np.maximum(0, square - mean**2) * (n - k) / k) >= near - 1e-3
            i, j = np.nonzero(able)
            keep = allowed(r[i], c[j])
            i, j = i[keep], j[keep]
            value = np.array([set_score(sets[x], sets[y], mode, top_frac) for x, y in zip(r[i], c[j])], dtype=np.float64)
            if mode == "max_exemplar":
                value = np.maximum(value, proto[i, j])
            keep = value >= least
            yield r[i][keep], c[j][keep], value[keep]


def edges(u: np.ndarray, inside: np.ndarray, spans: Spans, cfg: ReconcileConfig, bars: np.ndarray, rows: np.ndarray, cols: np.ndarray, sets: list[np.ndarray] | None = None, half: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, column, score of the mergeable pairs of rows and columns over their bar. u: unit vectors (zero: none); inside: cameras of each; bars: of the cameras; sets: rows of each, where these score; half: the larger number as column only.

    Products in single precision, which are off by less than 1e-5, rule out pairs; the others' scores are exact.
    """
    least = min(cfg.cross_bar, bars.min(initial=cfg.cross_bar))
    home = np.where(inside.sum(1) == 1, inside.argmax(1), -1)

    def products() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        right, near = u[cols].astype(np.float32).T, np.float32(least - 1e-5)
        for s in range(0, len(rows), ROWS):
            i, j = np.nonzero(u[rows[s : s + ROWS]].astype(np.float32) @ right >= near)
            r, c = rows[s : s + ROWS][i], cols[j]
            keep = able(r, c)
            r, c = r[keep], c[keep]
            for k in range(0, len(r), 1 << 14):
                x, y = r[k : k + (1 << 14)], c[k : k + (1 << 14)]
                value = np.einsum("ij,ij->i", u[x], u[y])
                keep = value >= least
                yield x[keep], y[keep], value[keep]

    able = lambda r, c: ((r < c) if half else (r != c)) & ((home[r] < 0) | (home[r] != home[c]))
    for r, c, value in products() if sets is None else set_edges(sets, u, cfg.scoring, cfg.top_frac, rows, cols, least, able):
        if least <= 0:
            keep = u[r].any(1) & u[c].any(1)
            value, r, c = value[keep], r[keep], c[keep]
        bar, shared = np.full(len(r), cfg.cross_bar), np.zeros(len(r), bool)
        for b in np.unique(bars):  # the strictest bar of the common cameras
            both = (inside[r][:, bars == b] & inside[c][:, bars == b]).any(1)
            bar[both], shared = b, shared | both
        keep = value >= bar
        value, r, c, shared = value[keep], r[keep], c[keep], shared[keep]
        at = np.flatnonzero(shared)
        keep = np.ones(len(r), bool)
        keep[at] = ~spans.collide(r[at], c[at])
        yield r[keep], c[keep], np.round(value[keep], 12)


def better(best: np.ndarray, score: np.ndarray, r: np.ndarray, c: np.ndarray, s: np.ndarray) -> None:
    """Takes these edges into the best partners of r (ties: the larger partner)."""
    order = np.lexsort((c, s, r))
    last = order[np.append(r[order][1:] != r[order][:-1], True)] if len(r) else order
    last = last[(s[last] > score[r[last]]) | ((s[last] == score[r[last]]) & (c[last] > best[r[last]]))]
    best[r[last]], score[r[last]] = c[last], s[last]


def rounds_of_run(pdf: pd.DataFrame, cfg: ReconcileConfig) -> pd.DataFrame:
    """All rounds of a run in a task; memory grows with the number of vectors, and with the rows of tracklets where these score (column rows: all of a tracklet, in order).

    A cluster's vectors are added up: the prototypes of its tracklets, or the sum of all on one of them and null on the others.
    """
    pdf = pdf.sort_values("key").reset_index(drop=True)
    holds = np.flatnonzero(pdf["prototype"].notna())
    v = np.array(pdf["prototype"].iloc[holds].tolist(), dtype=np.float64)
    names, cam = np.unique(pdf["cam"].to_numpy().astype(str), return_inverse=True)
    bars = np.array([cfg.bar(c) for c in names])
    start, end = pdf["first_frame"].to_numpy(), pdf["last_frame"].to_numpy()
    roots, own = np.unique(pdf["root"].to_numpy(), return_inverse=True)
    n = len(roots)
    sums, inside = np.zeros((n, v.shape[1])), np.zeros((n, len(names)), bool)
    np.add.at(sums, own[holds], v)
    inside[own, cam] = True
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    u = sums / np.where(length == 0, 1, length)
    alive, merged, rounds = np.ones(n, bool), {}, 0
    best, score = np.full(n, -1), np.full(n, -np.inf)
    search = fresh = np.arange(n)
    lists = [np.array([np.asarray(x, dtype=np.float64) for x in rows]) for rows in pdf["rows"]] if "rows" in pdf and cfg.scoring != "prototype" else None
    held = [np.flatnonzero(own == k) for k in range(n)] if lists else []
    sets = [even(np.concatenate([lists[k] for k in ks]), cfg.cap) for ks in held] if lists else None
    while True:  # every round but the last makes a union
        rounds += 1
        at, spans = np.flatnonzero(alive), Spans(own, cam, start, end)
        best[search], score[search] = -1, -np.inf
        half = sets is not None and len(search) == len(at)
        for r, c, s in edges(u, inside, spans, cfg, bars, search, at, sets, half):
            better(best, score, r, c, s)
            if half:
                better(best, score, c, r, s)
        if len(fresh) < len(at):
            for r, c, s in edges(u, inside, spans, cfg, bars, fresh, at, sets):
                better(best, score, c, r, s)
        a = at[(best[at] > at) & (best[best[at]] == at)]
        if not len(a):
            break
        b = best[a]
        merged |= {k: (float(x), rounds) for k, x in zip(roots[b], score[a])}
        to = np.arange(n)
        to[b] = a
        own = to[own]
        alive[b] = False
        inside[a] |= inside[b]
        gone = np.zeros(n, bool)
        gone[a] = gone[b] = True
        # Sums of the new clusters from their tracklets in order, so that they don't depend on the rounds.
        sums[a] = 0
        mine = np.flatnonzero(gone[own[holds]])
        np.add.at(sums, own[holds[mine]], v[mine])
        length = np.linalg.norm(sums[a], axis=1, keepdims=True)
        u[a] = sums[a] / np.where(length == 0, 1, length)
        for x, y in zip(a, b) if lists else ():
            held[x] = np.sort(np.append(held[x], held[y]))
            sets[x] = even(np.concatenate([lists[k] for k in held[x]]), cfg.cap)
        fresh = a
        search = np.flatnonzero(alive & (gone | ((best >= 0) & gone[best])))
    at = [merged.get(k, (None, None)) for k in pdf["key"]]
    return pd.DataFrame({"run_id": pdf["run_id"], "key": pdf["key"], "final": roots[own], "merge_score": [m[0] for m in at], "merge_round": pd.array([m[1] for m in at], dtype="Int32")})


def joined_rounds(members: DataFrame, cfg: ReconcileConfig, dim: int, block: int = BLOCK, limit: int = 0) -> tuple[DataFrame, int]:
    """run_id, key, final, merge_score, merge_round of every member, and the number of joined rounds, by tasks that hold two blocks of a run's clusters.

    A cluster is a row with its sum, its spans and the tracklets in it; the clusters to be looked for
    meet the blocks of all. Who is whose partner stands apart (state), so that a round moves only the
    clusters that meet or go into a union. What a round changes is all that later ones compare. As late rounds are
    many and small, a run of which up to limit clusters are left takes one task for the rest of them.
    """
    spans = F.collect_list(F.struct("cam", F.col("first_frame").alias("s"), F.col("last_frame").alias("e"), "key"))
    rows = members.groupBy("run_id", "root").agg(spans.alias("spans"), F.collect_list(F.struct("key", "prototype")).alias("p"))
    rows = rows.select("run_id", "root", "spans", F.transform(F.array_sort("p"), lambda x: x["prototype"]).alias("p"))
    total = F.aggregate("p", F.array_repeat(F.lit(0.0), dim), lambda t, x: F.zip_with(t, x, lambda y, z: y + z))
    none = {"partner": F.lit(None).cast("long"), "score": F.lit(None).cast("double"), "search": F.lit(True)}
    clusters = cut(rows.select("run_id", "root", total.alias("total"), "spans"))
    state = clusters.select("run_id", "root").withColumns(none)  # clusters with a partner, and those to be looked for
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near_if = lambda df, n: F.broadcast(df) if n <= FEW else df
    kind = members.schema["run_id"].dataType
    found = T.StructType([T.StructField("run_id", kind), T.StructField("root", T.LongType()), T.StructField("partner", T.LongType()), T.StructField("score", T.DoubleType())])

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, asks = t.column("root").to_numpy(), t.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        # A cluster may be on both sides; it is one here.
        known, first, back = np.unique(ids, return_index=True, return_inverse=True)
        sums = t.column("total").chunk(0).flatten().to_numpy().reshape(-1, dim)[first]
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        lists = t.column("spans").chunk(0).take(pa.array(first))
        own, flat = np.repeat(np.arange(len(known)), lists.value_lengths().to_numpy()), lists.flatten()
        names, cam = np.unique(flat.field("cam").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        bars, inside = np.array([cfg.bar(c) for c in names]), np.zeros((len(known), len(names)), bool)
        inside[own, cam] = True
        near = Spans(own, cam, flat.field("s").to_numpy(), flat.field("e").to_numpy())
        best, score = np.full(len(known), -1), np.full(len(known), -np.inf)
        for r, c, s in edges(sums / np.where(length == 0, 1, length), inside, near, cfg, bars, back[asks], back[~asks]):
            better(best, score, r, c, s)
            better(best, score, c, r, s)
        at = np.flatnonzero(best >= 0)
        run = t.column("run_id").chunk(0).take(pa.array(np.zeros(len(at), np.int64)))
        return pa.table({"run_id": run, "root": known[at], "partner": known[best[at]], "score": score[at]})

    rounds, told, rests, most = 0, [], [], clusters.count()
    while True:  # every round but the last makes a union
        if limit:
            few = [r[0] for r in clusters.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= limit).collect()]  # runs of over limit tracklets, so not many
            if few:
                one = clusters.filter(F.col("run_id").isin(few)).select("run_id", "root", "total", F.explode("spans").alias("m"))
                one = one.select("run_id", "m.key", "m.cam", F.col("m.s").alias("first_frame"), F.col("m.e").alias("last_frame"), F.when(F.col("m.key") == F.col("root"), F.col("total")).alias("prototype"), "root")
                rest = one.groupBy("run_id").applyInPandas(lambda pdf: rounds_of_run(pdf, cfg), SETTLED)
                rests.append(cut(rest.withColumn("merge_round", F.col("merge_round") + rounds)))
                clusters, state = (cut(df.filter(~F.col("run_id").isin(few))) for df in (clusters, state))
            if clusters.isEmpty():
                break
        rounds += 1
        each_one = clusters.select("run_id", F.lit(False).alias("asks")).unionByName(state.filter("search").select("run_id", F.lit(True).alias("asks")))
        sizes = each_one.groupBy("run_id").agg(F.ceil(F.count_if(~F.col("asks")) / block).cast("int").alias("nx"), F.ceil(F.count_if("asks") / block).cast("int").alias("ny")).filter("ny > 0")
        part = lambda n: F.pmod(F.xxhash64("root"), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        near = clusters.join(F.broadcast(sizes), "run_id")  # a row for each run
        here = near.select("run_id", "root", "total", "spans", F.lit(False).alias("asks"), part("nx").alias("x"), each("ny").alias("y"))
        search = near
        if rounds > 1:
            wanted = state.filter("search").select("run_id", "root")
            search = near.join(near_if(wanted, most if most <= FEW else wanted.count()), ["run_id", "root"], "left_semi")
        asked = search.select("run_id", "root", "total", "spans", F.lit(True).alias("asks"), each("nx").alias("x"), part("ny").alias("y"))
        pairs = here.unionByName(asked)
        if rounds == 1:
            pairs = pairs.filter("x <= y")  # all are asked: a pair of blocks meets once
        new = pairs.groupBy("run_id", "x", "y").applyInArrow(compare, found)
        kept = state.filter("not search and partner is not null").select("run_id", "root", "partner", "score")
        best = new.unionByName(kept).groupBy("run_id", "root").agg(F.max(F.struct("score", "partner")).alias("m")).select("run_id", "root", "m.partner", "m.score")
        best = cut(best)
        ends = [F.least("root", "partner").alias("a"), F.greatest("root", "partner").alias("b")]
        moves = cut(best.groupBy("run_id", *ends).agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("at")).filter("n = 2").drop("n"))
        made_now = moves.count()
        if not made_now:
            break
        most -= made_now
        told.append(moves.select("run_id", F.col("b").alias("key"), F.col("at").alias("merge_score"), F.lit(rounds).alias("merge_round")))
        gone = moves.select("run_id", "a", F.explode(F.array("a", "b")).alias("root"))
        left = near_if(gone.select("run_id", "root"), 2 * made_now)
        lost = near_if(gone.select("run_id", F.col("root").alias("partner"), F.lit(True).alias("lost")), 2 * made_now)
        stay = best.join(left, ["run_id", "root"], "left_anti").join(lost, ["run_id", "partner"], "left")
        stay = stay.select("run_id", "root", "partner", "score", F.col("lost").isNotNull().alias("search"))
        both = clusters.join(near_if(gone, 2 * made_now), ["run_id", "root"]).groupBy("run_id", "a").agg(F.array_sort(F.collect_list(F.struct("root", "total", "spans"))).alias("c"))
        sums = F.zip_with(F.col("c")[0]["total"], F.col("c")[1]["total"], lambda x, y: x + y)
        made = both.select("run_id", F.col("a").alias("root"), sums.alias("total"), F.concat(F.col("c")[0]["spans"], F.col("c")[1]["spans"]).alias("spans"))
        state = cut(stay.unionByName(moves.select("run_id", F.col("a").alias("root")).withColumns(none)))
        clusters = cut(clusters.join(left, ["run_id", "root"], "left_anti").select(*made.columns).unionByName(made).coalesce(parts))
        release(clusters)
    final = clusters.select("run_id", F.col("root").alias("final"), F.explode("spans.key").alias("key"))
    final = final.withColumns({"merge_score": F.lit(None).cast("double"), "merge_round": F.lit(None).cast("int")})
    for rest in rests:
        final = final.unionByName(rest)
    if not told:
        return final, rounds
    unions = told[0]
    for more in told[1:]:
        unions = unions.unionByName(more)
    before = unions.select("run_id", "key", F.col("merge_score").alias("s"), F.col("merge_round").alias("n"))
    joined = final.join(before, ["run_id", "key"], "left")
    return joined.select("run_id", "key", "final", F.coalesce("merge_score", "s").alias("merge_score"), F.coalesce("merge_round", "n").alias("merge_round")), rounds
