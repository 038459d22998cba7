"""Most similar vectors of every vector: a robust-pruned directed graph in every shard, searched by beams.

Each shard inserts its vectors batch by batch: a greedy beam search over the graph so far proposes
neighbours, relaxed pruning (an edge goes only if a kept neighbour is nearer to its end by the
factor alpha) keeps diverse ones, and reverse edges are added under the same rule. A vector is
indexed in one shard and searched by a beam in every shard within a margin, which is set by the true
neighbours of some vectors; the answers of the shards are merged. Vectors searched together are
neighbours in the insertion order, so their beams share one frontier: a node reached by one of them
is scored for all in one product.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sightweave.llm.shards import fit_cells, hot_copies, keys_of, per_shard, to_shards, unit, usable

#: Out-degree after pruning and at most; beam of build and search; nodes a query expands at once; candidates pruned; relaxation; vectors searched together.
DEGREE, DEGREE_MAX, BEAM, WIDTH, CANDIDATES, ALPHA, BATCH = 10, 20, 24, 8, 20, 1.2, 256
#: Entry points: a vector less similar than this to all of them becomes one, up to the count or this part of the shard, whichever is more.
ENTRY_BAR, ENTRIES, SHARE = 0.7, 1024, 8


class Graph:
    """Directed graph over unit vectors."""

    def __init__(self, u: np.ndarray):
        self.u = u
        n = len(u)
        self.adj = np.full((n, DEGREE_MAX), -1, np.int32)
        self.deg = np.zeros(n, np.int32)
        self._entries()
        self._insert_all()

    def _entries(self) -> None:
        """Entry points taken in a mixed order cover the shard; if they'd be over a share of it, the vectors left are reached by edges alone."""
        u, n = self.u, len(self.u)
        limit, entries = max(ENTRIES, n // SHARE), []
        mixed = np.random.RandomState(3).permutation(n)
        for s in range(0, n, 512):
            block = mixed[s : s + 512]
            far = block if not entries else block[(u[block] @ u[entries].T).max(1) < ENTRY_BAR]
            if not len(far):
                continue
            g = u[far] @ u[far].T >= ENTRY_BAR
            open_ = np.ones(len(far), bool)
            for i in range(len(far)):
                if open_[i]:
                    entries.append(int(far[i]))
                    open_ &= ~g[i]
            if len(entries) >= limit:
                break
        self.entries = np.array(entries[:limit])
        self.home, near = self.entry(u)
        near[self.entries] = 2
        self.home[self.entries] = self.entries
        self.order = np.lexsort((-near, self.home))

    def entry(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry point of each vector and its cosine."""
        best, near = np.empty(len(q), np.int64), np.empty(len(q), np.float32)
        for s in range(0, len(q), 4096):
            sim = q[s : s + 4096] @ self.u[self.entries].T
            best[s : s + 4096] = sim.argmax(1)
            near[s : s + 4096] = sim.max(1)
        return self.entries[best], near

    def _insert_all(self) -> None:
        u = self.u
        placed = np.zeros(len(u), bool)
        rank = np.zeros(len(u), np.int64)
        gate = u[self.entries] @ u[self.entries].T
        is_entry = np.full(len(u), -1)
        is_entry[self.entries] = np.arange(len(self.entries))
        for s in range(0, len(u), BATCH):
            ids = self.order[s : s + BATCH]
            rank[ids] = np.arange(len(ids))
            # Start at the batch's own entry points and at the placed ones nearest to them.
            homes = np.unique(self.home[ids])
            start = homes[placed[homes]]
            known = np.flatnonzero(placed[self.entries])
            if len(known):
                close = known[np.unique(np.argsort(-gate[is_entry[homes]][:, known], axis=1)[:, :4])]
                start = np.unique(np.append(start, self.entries[close]))
            if len(start):
                top, sims = self.search(u[ids], start, BEAM)
            else:
                top, sims = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0), np.float32)
            inner = u[ids] @ u[ids].T  # those placed with it are candidates too
            np.fill_diagonal(inner, -np.inf)
            cand = np.concatenate([top, np.tile(ids, (len(ids), 1))], 1)
            sims = np.concatenate([sims, inner], 1)
            kept = self._prune(cand, sims, CANDIDATES)
            self.adj[ids, : kept.shape[1]] = kept
            self.deg[ids] = (kept >= 0).sum(1)
            placed[ids] = True
            self._reverse(ids, kept)

    def _prune(self, cand: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """Robust pruning of each row's candidates; -1 fills up."""
        if cand.shape[1] > width:
            at = np.argpartition(-sims, width - 1, axis=1)[:, :width]
            cand, sims = np.take_along_axis(cand, at, 1), np.take_along_axis(sims, at, 1)
        at = np.argsort(-sims, axis=1, kind="stable")
        cand, sims = np.take_along_axis(cand, at, 1), np.take_along_axis(sims, at, 1)
        alive = np.isfinite(sims)
        v = self.u[cand]
        far = (1 - np.matmul(v, v.transpose(0, 2, 1))) * ALPHA**2  # of squared distances
        own = 1 - sims
        out = np.full((len(cand), DEGREE), -1, np.int32)
        rows = np.arange(len(cand))
        for r in range(DEGREE):
            j = alive.argmax(1)
            has = alive[rows, j]
            if not has.any():
                break
            out[has, r] = cand[rows, j][has]
            alive &= far[rows, j] > own
            alive[rows, j] = False
        return out

    def _reverse(self, ids: np.ndarray, kept: np.ndarray) -> None:
        src = np.repeat(ids, kept.shape[1])
        dst = kept.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        present = (self.adj[dst] == src[:, None]).any(1)
        src, dst = src[~present], dst[~present]
        if not len(dst):
            return
        begin = np.flatnonzero(np.append(True, dst[1:] != dst[:-1]))
        place = np.arange(len(dst)) - np.repeat(begin, np.diff(np.append(begin, len(dst)))) + self.deg[dst]
        fits = place < DEGREE_MAX
        self.adj[dst[fits], place[fits]] = src[fits]
        np.maximum.at(self.deg, dst[fits], place[fits] + 1)
        if fits.all():
            return
        over, where = np.unique(dst[~fits], return_inverse=True)
        extra = np.full((len(over), int(np.bincount(where).max())), -1, np.int64)
        first = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
        extra[where, np.arange(len(where)) - np.repeat(first, np.diff(np.append(first, len(where))))] = src[~fits]
        cand = np.concatenate([self.adj[over].astype(np.int64), extra], 1)
        sims = np.einsum("bcd,bd->bc", self.u[cand], self.u[over])
        sims[cand < 0] = -np.inf
        kept = self._prune(cand, sims, DEGREE_MAX + 16)
        self.adj[over] = -1
        self.adj[over, : kept.shape[1]] = kept
        self.deg[over] = (kept >= 0).sum(1)

    def search(self, q: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of queries that share a frontier: ids and cosines, best first."""
        n = len(self.u)
        scored, expanded = np.zeros(n, bool), np.zeros(n, bool)
        scored[start] = True
        top = np.tile(start, (len(q), 1))
        sims = q @ self.u[start].T
        rows = np.arange(len(q))[:, None]
        while True:
            if top.shape[1] > beam:
                at = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
                top, sims = top[rows, at], sims[rows, at]
            at = np.argsort(-sims, axis=1)
            top, sims = top[rows, at], sims[rows, at]
            fresh = ~expanded[top]
            front = np.unique(top[fresh & (np.cumsum(fresh, 1) <= WIDTH)])
            if not len(front):
                return top, sims
            expanded[front] = True
            near = self.adj[front].ravel()
            near = near[near >= 0]
            near = np.unique(near[~scored[near]])
            if not len(near):
                continue
            scored[near] = True
            new = q @ self.u[near].T
            useful = (new > sims[:, -1:]).any(0) if top.shape[1] >= beam else np.ones(len(near), bool)
            top = np.concatenate([top, np.broadcast_to(near[useful], (len(q), int(useful.sum())))], 1)
            sims = np.concatenate([sims, new[:, useful]], 1)

    def nearest(self, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest others of each of these vectors of the graph; -1 fills up."""
        return self._beams(self.u[rows], self.home[rows], rows, k)

    def nearest_to(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest of each vector from outside."""
        return self._beams(q, self.entry(q)[0], None, k)

    def _beams(self, q: np.ndarray, home: np.ndarray, own: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(q)
        ids, sims = np.full((n, k), -1, np.int64), np.full((n, k), -np.inf, np.float32)
        beam = max(BEAM, 2 * k)
        order = np.argsort(home, kind="stable")
        for s in range(0, n, BATCH):
            rows = order[s : s + BATCH]
            start = home[rows] if own is None else np.append(own[rows], home[rows])
            top, sim = self.search(q[rows], np.unique(start), beam)
            if own is not None:
                sim = np.where(top == own[rows][:, None], -np.inf, sim)
            at = np.argsort(-sim, axis=1, kind="stable")[:, :k]
            top, sim = np.take_along_axis(top, at, 1), np.take_along_axis(sim, at, 1)
            ids[rows, : top.shape[1]] = np.where(np.isfinite(sim), top, -1)
            sims[rows, : top.shape[1]] = sim
        return ids, sims


def exact_cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of raw rows, pair by pair, in double precision."""
    out = np.empty(len(x))
    for s in range(0, len(x), 65536):
        a, b = unit(x[s : s + 65536], np.float64), unit(y[s : s + 65536], np.float64)
        out[s : s + 65536] = np.einsum("nd,nd->n", a, b)
    return out


PAIRS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("other_id", T.LongType()), T.StructField("cosine", T.DoubleType())])


def _runs(at: np.ndarray, take: np.ndarray) -> np.ndarray:
    """at[i], at[i] + 1, .. for each i, take[i] of them."""
    return np.repeat(at - np.cumsum(take) + take, take) + np.arange(take.sum())


def shard_pairs(ids: np.ndarray, x: np.ndarray, ask: np.ndarray, guest: np.ndarray, k: int, floor: float) -> pa.RecordBatch:
    """vec_id, other_id, cosine of the k nearest of every asking row among those at home, with a cosine of at least floor.

    With a floor a guest's pairs are given both ways, so that either end may find the other.
    """
    home = np.flatnonzero(~guest)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(home):
        # Copies stand once in the graph; each answers for the others.
        _, first, back = np.unique(keys_of(x[home]), return_index=True, return_inverse=True)
        first, count = home[first], np.bincount(back)
        members, at = home[np.lexsort((ids[home], back))], np.append(0, np.cumsum(count))
        graph = Graph(unit(x[first]))
        asked = np.flatnonzero(np.bincount(back, ask[home], len(first)) > 0)
        strangers = np.flatnonzero(guest)
        for own, near_sims in ((True, graph.nearest(asked, k)), (False, graph.nearest_to(unit(x[strangers]), k)) if len(strangers) else (False, None)):
            if near_sims is None:
                continue
            near, sims = near_sims
            row, col = np.nonzero((near >= 0) & (sims >= floor - 1e-4))
            a, b = (asked if own else strangers)[row], near[row, col]
            cos = exact_cosine(x[first[a] if own else a], x[first[b]])
            if own and (multi := asked[count[asked] > 1]).size:
                a, b, cos = np.append(a, multi), np.append(b, multi), np.append(cos, np.ones(len(multi)))
            take = np.minimum(count[b], k + 1)  # of many copies the smallest ids suffice
            other = members[_runs(at[b], take)]
            a, cos = np.repeat(a, take), np.repeat(cos, take)
            if count.max(initial=1) > 1:
                order = np.lexsort((ids[other], -cos, a))  # at most k + 1 are needed for any copy of a
                a, other, cos = a[order], other[order], cos[order]
                begin = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, int)
                keep = np.arange(len(a)) - np.repeat(begin, np.diff(np.append(begin, len(a)))) < k + 1
                a, other, cos = a[keep], other[keep], cos[keep]
            if own:
                times = count[a]
                mine, other, cos = members[_runs(at[a], times)], np.repeat(other, times), np.repeat(cos, times)
            else:
                mine = a
            good = (ids[mine] != ids[other]) & (cos >= floor) & ask[mine]
            parts.append((ids[mine][good], ids[other][good], cos[good]))
            if not own and floor > 0:
                good = (ids[mine] != ids[other]) & (cos >= floor) & ask[other]
                parts.append((ids[other][good], ids[mine][good], cos[good]))
    cols = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.float64))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["vec_id", "other_id", "cosine"])


def nearest_vectors(df: DataFrame, vec_id: str, vector: str, dim: int, k: int = 10, floor: float = -1.0, shard_rows: int | None = None, queries: Column | None = None) -> DataFrame:
    """vec_id, other_id, cosine: of every usable vector the k others with the highest cosine of at least floor.

    Usable is a vector of dim finite numbers that aren't all zero, with a non-null id; other rows are
    left out. A row sent again counts once; an id with several different vectors has all of them and
    takes the highest cosine. Equal cosines are ordered by the smaller id. Lengths don't matter. With
    queries (a condition on df, null is no) only those rows are answered, against all. An empty table
    gives an empty result; other columns are ignored. The cosine is exact; which vectors are found is
    approximate (see the README for measured recall).
    """
    size = {"shard_rows": shard_rows} if shard_rows else {}
    vectors = usable(df, vec_id, vector, dim)
    cells = fit_cells(vectors, dim, k=k, floor=floor, **size)
    asking = vectors if queries is None else usable(df.withColumn("_ask", F.coalesce(queries, F.lit(False))), vec_id, vector, dim, "_ask")
    packed = to_shards(asking, cells, dim)
    hot = hot_copies(vectors if queries is None else asking, cells, dim, k + 1)
    if hot:
        cold = replace(cells, hot_keys=np.zeros(0, np.uint64))
        packed = packed.unionByName(to_shards(hot[0].select("vec_id", "vector", "ask"), cold, dim))
    found = per_shard(packed, cells, dim, lambda ids, x, ask, guest: shard_pairs(ids, x, ask, guest, k, floor), PAIRS)
    if hot:
        # The copies beyond those kept: their nearest are the smallest ids of their group.
        kept = F.broadcast(hot[0].select("group", F.col("vec_id").alias("other_id")))
        rest = hot[1].filter("ask").join(F.broadcast(hot[0].select("vec_id").distinct()), "vec_id", "left_anti").join(kept, "group")
        found = found.unionByName(rest.select("vec_id", "other_id", F.lit(1.0).alias("cosine")).filter(F.lit(floor <= 1)))
    best = found.groupBy("vec_id", "other_id").agg(F.max("cosine").alias("cosine"))
    place = Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "other_id")
    return best.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k).drop("place")
