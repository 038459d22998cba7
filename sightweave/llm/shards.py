"""Shards of a vector collection: usable vectors, cells fitted on a bounded sample, packed transfer.

Every row is sent to the shard of its nearest cell, and as a guest to other near cells where it is to
be searched. Rows travel as parts of compressed blocks, so a shuffle moves columns of bytes instead
of rows of arrays, and one task gets one cell at a time. The number of cells follows the number of
rows; beyond MAX_FLAT cells they form a tree of two levels, whose lower one is fitted in tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows of the sample that the upper cells are fitted on; rows of a shard aimed at.
SAMPLE_ROWS, SHARD_ROWS = 24_000, 12_000
#: Sample rows of each cell; cells of one level; cells at most (64 MB of centres of 128 numbers, which are broadcast: beyond them shards grow); upper cells searched for a row, at least.
PER_CELL, MAX_FLAT, MAX_CELLS, TOPS = 20, 1_000, 131_072, 8
#: A direction with this share of the sample is a hot group of copies, and so is one of more than two shards.
HOT_SHARE = 0.01
#: Rows packed at once in a task; rows of a block from which it is compressed.
PACK_ROWS, ZIP_ROWS = 32_768, 48
#: Vectors whose true neighbours tell how far a search must look, and the share of these neighbours to be covered.
PROBES, COVERED = 192, 0.98


def usable(df: DataFrame, vec_id: str, vector: str, dim: int, ask: str | None = None) -> DataFrame:
    """vec_id, vector (and ask) of the rows that may be usable; the finite and non-zero test follows in matrix()."""
    more = [F.col(ask).alias("ask")] if ask else []
    return df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<float>").alias("vector"), *more).filter(F.col("vec_id").isNotNull() & (F.size("vector") == dim))


def matrix(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and raw vectors (float32) of the usable rows (all numbers finite, not all zero), and which rows those are."""
    ids, vec = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    values = vec.flatten()  # every row has dim numbers
    x = values.fill_null(np.float32("nan")).to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)
    ok = np.isfinite(x).all(1) & (x != 0).any(1)
    return ids[ok].astype(np.int64), x[ok], ok


def unit(x: np.ndarray, kind: type = np.float32) -> np.ndarray:
    """Rows of length one, whatever their scale."""
    x = x.astype(np.float64) if kind is np.float64 else x
    top = np.abs(x).max(1, keepdims=True)
    y = x / np.where(top == 0, 1, top)
    return (y / np.linalg.norm(y, axis=1, keepdims=True)).astype(kind)


def _mix(words: np.ndarray) -> np.ndarray:
    odd = np.random.RandomState(7).randint(1, 2**62, size=words.shape[1], dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    with np.errstate(over="ignore"):
        key = (words * odd).sum(1, dtype=np.uint64)
        return key ^ (key >> np.uint64(31))


def keys_of(x: np.ndarray) -> np.ndarray:
    """A 64-bit key of each row's numbers; equal rows have equal keys."""
    return _mix(np.ascontiguousarray(x + np.float32(0)).view(np.uint32).astype(np.uint64))  # -0 becomes 0


def sign_keys(x: np.ndarray) -> np.ndarray:
    """A key of each row's signs: rows of one direction have one key, whatever their lengths."""
    return _mix(np.packbits(np.concatenate([x > 0, x < 0], axis=1), axis=1).astype(np.uint64))


def pack(x: np.ndarray, zip_rows: int = ZIP_ROWS) -> bytes:
    """Lossless: the byte planes of the numbers, compressed; few rows as they are."""
    if len(x) < zip_rows:
        return np.ascontiguousarray(x).tobytes()
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int, dtype: type, dim: int = 1, zip_rows: int = ZIP_ROWS) -> np.ndarray:
    if n < zip_rows:
        out = np.frombuffer(data, dtype)
        return out.reshape(n, dim) if dim > 1 else out
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(data, n * dim * width, codec="zstd"), np.uint8).reshape(width, -1)
    out = np.ascontiguousarray(planes.T).view(dtype)
    return out.reshape(n, dim) if dim > 1 else out.ravel()


@dataclass
class Cells:
    """Centres of the shards, in one level or under upper centres, and the directions of hot groups of copies.

    Cells of upper centre t are centres[at[t] : at[t + 1]].
    """

    centres: np.ndarray
    hot_keys: np.ndarray
    hot: np.ndarray
    rows: int
    tops: np.ndarray | None = None
    at: np.ndarray | None = None
    margin: float = 0.0
    reach: int = TOPS

    def near(self, u: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, cell and similarity of the cells at most margin behind a row's nearest; the nearest of every row."""
        n = len(u)
        if len(self.centres) == 1:
            return np.arange(n), np.zeros(n, np.int64), np.ones(n, np.float32), np.zeros(n, np.int64)
        if self.tops is None:
            sim = u @ self.centres.T
            rows, cells = np.nonzero(sim >= sim.max(1, keepdims=True) - margin)
            return rows, cells, sim[rows, cells], sim.argmax(1)
        upper = u @ self.tops.T
        few = np.argpartition(-upper, min(self.reach, upper.shape[1]) - 1, axis=1)[:, : self.reach]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for t in np.unique(few):
            mine = np.flatnonzero((few == t).any(1))
            sim = u[mine] @ self.centres[self.at[t] : self.at[t + 1]].T
            r, c = np.nonzero(sim >= sim.max(1, keepdims=True) - margin)
            found.append((mine[r], c + self.at[t], sim[r, c]))
        rows, cells, sims = (np.concatenate([f[i] for f in found]) for i in range(3))
        order = np.lexsort((cells, -sims, rows))
        rows, cells, sims = rows[order], cells[order], sims[order]
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        keep = sims >= sims[first][rows] - margin  # every row has cells, so row i is the i-th first
        return rows[keep], cells[keep], sims[keep], cells[first]

    def hot_group(self, x: np.ndarray) -> np.ndarray:
        """The number of the hot group that each row is a copy of (to the precision of its numbers), or -1."""
        out = np.full(len(x), -1)
        if len(self.hot_keys):
            key = sign_keys(x)
            for g, k in enumerate(self.hot_keys):
                mine = np.flatnonzero((key == k) & (out < 0))
                if len(mine):
                    out[mine[unit(x[mine], np.float64) @ self.hot[g] >= 1 - 1e-12]] = g
        return out


def _kmeans(u: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.RandomState(11)
    centres = u[rng.choice(len(u), k, replace=False)]
    for _ in range(rounds):
        best = np.concatenate([np.argmax(u[s : s + 8192] @ centres.T, axis=1) for s in range(0, len(u), 8192)])
        order = np.argsort(best, kind="stable")
        count = np.bincount(best, minlength=k)
        sums = np.zeros((k, u.shape[1]), np.float32)
        at = np.append(0, np.cumsum(count))
        full = np.flatnonzero(count)
        sums[full] = np.add.reduceat(u[order], at[full], axis=0)
        empty = np.flatnonzero(count == 0)
        if len(empty):  # an empty cell restarts inside the fullest
            sums[empty] = u[order[at[count.argmax()] :][: len(empty)]] if count.max() >= len(empty) else u[rng.choice(len(u), len(empty))]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = sums / np.where(norm == 0, 1, norm)
    return centres


def balanced(u: np.ndarray, k: int) -> np.ndarray:
    """About k centres; a cell of more than twice its share is divided again, unless its rows are alike, and one of less than a quarter is given up."""
    k = max(1, min(k, len(u)))
    centres = _kmeans(u, k) if k > 1 else unit(u.mean(0, keepdims=True)) if np.any(u.mean(0)) else u[:1]
    for _ in range(3 if k > 1 else 0):
        best = np.concatenate([np.argmax(u[s : s + 8192] @ centres.T, axis=1) for s in range(0, len(u), 8192)])
        share = len(u) / k
        large = np.flatnonzero(np.bincount(best, minlength=len(centres)) > 2 * share)
        if not len(large):
            break
        parts = []
        for c in large:
            rows = u[best == c]
            parts.append(_kmeans(rows, min(len(rows), int(np.ceil(len(rows) / share)))))
        centres = np.concatenate([np.delete(centres, large, axis=0), *parts])
    if k > 1:
        best = np.concatenate([np.argmax(u[s : s + 8192] @ centres.T, axis=1) for s in range(0, len(u), 8192)])
        centres = centres[np.bincount(best, minlength=len(centres)) * 4 >= len(u) / k]
    return centres


def _hot(x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys and directions of the groups of at least so many copies among the sample rows."""
    keys, count = np.unique(sign_keys(x), return_counts=True)
    found: list[tuple[np.uint64, np.ndarray]] = []
    all_keys = sign_keys(x)
    for k in keys[count >= least]:
        rows = unit(x[all_keys == k], np.float64)
        while len(rows) >= least:
            same = rows @ rows[0] >= 1 - 1e-12
            if same.sum() >= least:
                found.append((k, rows[0]))
            rows = rows[~same]
    return np.array([f[0] for f in found], np.uint64), np.array([f[1] for f in found]).reshape(-1, x.shape[1])


def _sample(vectors: DataFrame, share: float, salt: int) -> DataFrame:
    return vectors if share >= 1 else vectors.filter(F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(1 << 30)) < int(share * (1 << 30)))


def fit_cells(vectors: DataFrame, dim: int, shard_rows: int = SHARD_ROWS, sample_rows: int = SAMPLE_ROWS, k: int = 0, floor: float = -1.0) -> Cells:
    """Cells from a hash sample of at most about sample_rows rows; every row is routed by them later.

    Up to MAX_FLAT cells are fitted on this sample. More of them stand under upper ones and are fitted in tasks, an
    upper cell each, on PER_CELL rows a cell. With k the margin is set that a search for the k
    nearest needs (see covering_margin).
    """
    total = vectors.select("vec_id").count()
    share = min(1.0, sample_rows / max(total, 1))
    parts = [matrix(b, dim) for b in _sample(vectors, share, 3).select("vec_id", "vector").toArrow().to_batches() if b.num_rows]
    ids, x = (np.concatenate([p[i] for p in parts]) for i in (0, 1)) if parts else (np.zeros(0, np.int64), np.zeros((0, dim), np.float32))
    one = Cells(np.zeros((1, dim), np.float32), np.zeros(0, np.uint64), np.zeros((0, dim)), len(x))
    if not len(x):
        return one
    wanted = min(MAX_CELLS, -(-int(total * 1.4) // shard_rows))
    hot_keys, hot = _hot(x, max(PER_CELL, min(HOT_SHARE * len(x), 2 * len(x) / wanted), 51 if wanted == 1 else 0))
    cells = Cells(one.centres, hot_keys, hot, total)
    cold = cells.hot_group(x) < 0
    u, ids = unit(x[cold]), ids[cold]
    rows = int(len(u) / share)
    wanted = min(MAX_CELLS, -(-int(rows * 1.4) // shard_rows))
    if wanted <= 1 or not len(u):
        return cells
    flat = wanted if wanted <= MAX_FLAT else min(MAX_FLAT, 4 * int(np.ceil(np.sqrt(wanted))))
    cells.centres = balanced(u, flat)
    if wanted > flat:
        cells = _lower(vectors, cells, dim, shard_rows, min(1.0, wanted * PER_CELL / total))
    if k and len(cells.centres) > 1:
        cells.margin, cells.reach = covering_margin(vectors, cells, dim, ids, u, k, floor)
    return cells


def _lower(vectors: DataFrame, cells: Cells, dim: int, shard_rows: int, share: float) -> Cells:
    """The lower level: each upper cell fits its own on its part of a sample."""
    schema = T.StructType([T.StructField("top", T.IntegerType()), T.StructField("vector", T.ArrayType(T.FloatType()))])

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x, _ = matrix(batch, dim)
            x = x[cells.hot_group(x) < 0]
            u = unit(x)
            top = cells.near(u, 0.0)[3] if len(u) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(top.astype(np.int32)), _lists(u)], names=schema.names)

    def fit(t: pa.Table) -> pa.Table:
        u = t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        own = balanced(u, -(-int(len(u) / share * 1.4) // shard_rows))
        return pa.table({"top": pa.array(np.full(len(own), t.column("top")[0].as_py(), np.int32)), "vector": _lists(own)})

    got = _sample(vectors, share, 4).select("vec_id", "vector").mapInArrow(home, schema).groupBy("top").applyInArrow(fit, schema).toArrow()
    top = got.column("top").to_numpy()
    own = got.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    order = np.argsort(top, kind="stable")
    named = np.unique(top)
    return Cells(own[order], cells.hot_keys, cells.hot, cells.rows, cells.centres[named], np.searchsorted(top[order], np.append(named, named[-1] + 1)), cells.margin)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel(), pa.float32()))


def covering_margin(vectors: DataFrame, cells: Cells, dim: int, ids: np.ndarray, u: np.ndarray, k: int, floor: float) -> tuple[float, int]:
    """How far behind a vector's nearest cell the cells of its neighbours lie: the margin that covers COVERED of them, and how many upper cells to search for that.

    PROBES sample vectors are compared with every row, in one pass; their true k nearest are known
    then. With a floor only neighbours over it are wanted, and a pair may be found from either end;
    the displacement of nearer neighbours is smaller in proportion, and all but a thousandth of them
    are to be covered.
    """
    pick = np.random.RandomState(5).permutation(len(u))[:PROBES]
    q, q_ids = u[pick], ids[pick]
    q_home = cells.near(q, 0.0)[3]
    q_best = np.einsum("nd,nd->n", q, cells.centres[q_home])
    schema = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("vec_id", T.LongType()), *[T.StructField(c, T.FloatType()) for c in ("cosine", "there", "back", "rank")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, best, held = np.full((len(q), k), -1, np.int64), np.full((len(q), k), -np.inf, np.float32), np.zeros((len(q), k, dim), np.float32)
        for batch in batches:
            got, x, _ = matrix(batch, dim)
            if not len(got):
                continue
            v = unit(x)
            sim = q @ v.T
            sim[q_ids[:, None] == got[None, :]] = -np.inf
            at = np.argpartition(-sim, min(k, sim.shape[1]) - 1, axis=1)[:, :k]
            both, who = np.concatenate([best, np.take_along_axis(sim, at, 1)], 1), np.concatenate([top, got[at]], 1)
            vec = np.concatenate([held, v[at]], 1)
            order = np.argsort(-both, axis=1, kind="stable")[:, :k]
            best, top, held = np.take_along_axis(both, order, 1), np.take_along_axis(who, order, 1), np.take_along_axis(vec, order[:, :, None], 1)
        i, j = np.nonzero(np.isfinite(best))
        if len(i):
            o = held[i, j]
            home = cells.near(o, 0.0)[3]
            there = q_best[i] - np.einsum("nd,nd->n", q[i], cells.centres[home])
            back = np.einsum("nd,nd->n", o, cells.centres[home]) - np.einsum("nd,nd->n", o, cells.centres[q_home[i]])
            rank = np.zeros(len(i))
            if cells.tops is not None:  # how many upper cells are nearer than the neighbour's
                upper = q @ cells.tops.T
                own = np.searchsorted(cells.at, home, side="right") - 1
                rank = (upper[i] > upper[i, own][:, None]).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(top[i, j]), *[pa.array(c.astype(np.float32)) for c in (best[i, j], there, back, rank)]], names=schema.names)

    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "vec_id"))
    near = vectors.select("vec_id", "vector").mapInArrow(run, schema).groupBy("query", "vec_id").agg(*[F.max(c).alias(c) for c in ("cosine", "there", "back", "rank")])
    got = near.withColumn("place", place).filter(F.col("place") <= k).select("cosine", "there", "back", "rank").toArrow()
    if not got.num_rows:
        return 0.0, TOPS
    cos, there, back, rank = (got.column(c).to_numpy().astype(np.float64) for c in ("cosine", "there", "back", "rank"))
    reach = max(TOPS, int(np.quantile(rank, 0.995)) + 1)
    if floor <= 0:
        return float(np.quantile(np.maximum(0, there), COVERED)) + 1e-6, reach
    apart = np.sqrt(np.maximum(1e-6, 2 - 2 * cos))
    need = np.minimum(there, back) * np.minimum(1, np.sqrt(2 - 2 * floor) / apart)
    return float(np.quantile(np.maximum(0, need), 0.999)) + 1e-6, reach


PACKED = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("guest", T.BooleanType()), T.StructField("n", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in ("ids", "asks", "data")]])


def to_shards(vectors: DataFrame, cells: Cells, dim: int, width: int | None = None, margin: float | None = None, code: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Blocks of rows by shard: each row at home in its nearest cell and, if it asks, a guest of those within the margin.

    vectors: vec_id, vector (of width numbers, the first dim of which count for routing) and maybe
    ask; without it every row asks. code: what is sent of the vectors (float32). Rows of hot groups of copies are left out (see hot_copies).
    """
    width, margin = width or dim, cells.margin if margin is None else margin
    columns = ["vec_id", "vector", *(["ask"] if "ask" in vectors.columns else [])]
    hold = min(4 * PACK_ROWS, max(PACK_ROWS, 32 * len(cells.centres)))

    def blocks(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        ids, x, ask = (np.concatenate([h[i] for h in held]) for i in range(3))
        if len(cells.hot_keys):
            cold = cells.hot_group(x[:, :dim]) < 0
            ids, x, ask = ids[cold], x[cold], ask[cold]
        out = []
        for s in range(0, len(x), PACK_ROWS):
            e = slice(s, s + PACK_ROWS)
            rows, cell, _, home = cells.near(unit(x[e, :dim]), margin)
            guest = home[rows] != cell
            keep = ask[e][rows] | ~guest
            out.append((rows[keep] + s, cell[keep], guest[keep]))
        made = []
        if out:
            rows, cell, guest = (np.concatenate([o[i] for o in out]) for i in range(3))
            slot = cell * 2 + guest
            order = np.argsort(slot, kind="stable")
            rows, slot = rows[order], slot[order]
            at = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
            sent = code(x) if code else x
            for s, e in zip(at, np.append(at[1:], len(rows))):
                r = rows[s:e]
                made.append((int(slot[s]) // 2, bool(slot[s] % 2), len(r), pack(ids[r]), np.packbits(ask[r]).tobytes(), pack(sent[r])))
        return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=PACKED.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                ids, x, ok = matrix(batch, width)
                ask = batch.column(2).to_numpy(zero_copy_only=False)[ok].astype(bool) if len(columns) > 2 else np.ones(len(ids), bool)
                held.append((ids, x, ask))
                n += len(ids)
            if n >= hold:
                yield blocks(held)
                held, n = [], 0
        if held:
            yield blocks(held)

    return vectors.select(*columns).mapInArrow(run, PACKED)


def per_shard(packed: DataFrame, cells: Cells, width: int, work: Callable[..., pa.RecordBatch], schema: T.StructType) -> DataFrame:
    """work(ids, raw vectors, asks, guests) for each shard; a repeated id with one and the same vector comes once.

    A task holds one shard at a time. An id that came with several different vectors has all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(blocks: list[tuple]) -> pa.RecordBatch:
            guest = np.repeat([b[0] for b in blocks], [b[1] for b in blocks])
            ids = np.concatenate([unpack(b[2], b[1], np.int64) for b in blocks])
            ask = np.concatenate([np.unpackbits(np.frombuffer(b[3], np.uint8))[: b[1]] for b in blocks]).astype(bool)
            x = np.concatenate([unpack(b[4], b[1], np.float32, width) for b in blocks])
            key = keys_of(x)
            order = np.lexsort((~ask, key, ids))
            keep = order[np.append(True, (ids[order][1:] != ids[order][:-1]) | (key[order][1:] != key[order][:-1]))]
            return work(ids[keep], x[keep], ask[keep], guest[keep])

        now, blocks = None, []
        for batch in batches:
            for i, s in enumerate(batch.column(0).to_pylist()):
                if s != now and blocks:
                    yield done(blocks)
                    blocks = []
                now = s
                blocks.append(tuple(batch.column(c)[i].as_py() for c in range(1, 6)))
        if blocks:
            yield done(blocks)

    spread = packed.repartitionById(max(1, len(cells.centres)), F.col("shard")).sortWithinPartitions("shard")  # a shard, a task
    return spread.mapInArrow(run, schema)


def hot_copies(vectors: DataFrame, cells: Cells, dim: int, keep: int) -> tuple[DataFrame, DataFrame] | None:
    """Of hot groups of copies: the rows that stay in the index (of each group the keep smallest ids), and all ids by group, both with ask.

    None if there are none. A group has a fixed share of the bounded sample at least, so their number
    is bounded and the rows kept are few.
    """
    if not len(cells.hot_keys):
        return None
    with_ask = "ask" in vectors.columns

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x, ok = matrix(batch, dim)
            group = cells.hot_group(x)
            ask = batch.column(2).to_numpy(zero_copy_only=False)[ok].astype(bool) if with_ask else np.ones(len(ids), bool)
            at = group >= 0
            yield pa.RecordBatch.from_arrays([pa.array(group[at].astype(np.int32)), pa.array(ids[at]), pa.array(ask[at])], names=["group", "vec_id", "ask"])

    marked = vectors.select("vec_id", "vector", *(["ask"] if with_ask else [])).mapInArrow(mark, "group int, vec_id long, ask boolean")
    ids = marked.groupBy("group", "vec_id").agg(F.bool_or("ask").alias("ask"))
    place = F.row_number().over(Window.partitionBy("group").orderBy("vec_id"))
    least = ids.withColumn("place", place).filter(F.col("place") <= keep).select("vec_id", "group", "ask").collect()
    rows = vectors.sparkSession.createDataFrame([(v, g, a, cells.hot[g].astype(np.float32).tolist()) for v, g, a in least], "vec_id long, group int, ask boolean, vector array<float>")
    return rows, ids
