"""Percentiles of groups by distributed multi-select, and summaries that can be combined.

Values are written as sorted chunks. In each round every chunk discards what the rounds before have
ruled out for all targets of its group, counts what lies below, at and above the pivot of each open
target and proposes the medians of both remaining sides; the sums say which side goes on, and the
weighted median of its proposals is the next pivot. A target ends when its pivot is hit or so few
values are left that they are sorted at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sightweave.session import cut

#: Values of a chunk; rows a task sorts at once; values left of a target that are sorted directly.
CHUNK, HOLD_ROWS, FINISH = 65_536, 500_000, 4096


def sorted_chunks(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """k0.., n, mid, data, weights: sorted values of a group as bytes; null and NaN values are left out."""
    kinds = {f.name: f.dataType for f in df.schema}
    names = [f"k{i}" for i in range(len(keys))]
    narrow = df.select(*[F.col(k).alias(m) for k, m in zip(keys, names)], F.col(value).cast("double").alias("v"), (F.col(weight).cast("long") if weight else F.lit(1).cast("long")).alias("w")).filter("v is not null and not isnan(v) and w > 0")
    kind = T.StructType([*[T.StructField(m, kinds[k]) for m, k in zip(names, keys)], T.StructField("n", T.LongType()), T.StructField("mid", T.DoubleType()), T.StructField("data", T.BinaryType()), T.StructField("weights", T.BinaryType())])
    schema, n_keys, weighted = to_arrow_schema(kind), len(keys), weight is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            codes = np.zeros(t.num_rows, np.int64)
            for i in range(n_keys):
                d = t.column(i).combine_chunks().dictionary_encode()
                codes = np.unique(codes * (len(d.dictionary) + 1) + d.indices.fill_null(len(d.dictionary)).to_numpy(zero_copy_only=False), return_inverse=True)[1]
            v, w = t.column(n_keys).to_numpy() + 0.0, t.column(n_keys + 1).to_numpy()
            order = np.lexsort((v, codes))
            codes, v, w = codes[order], v[order], w[order]
            begin = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            within = np.arange(len(codes)) - np.repeat(begin, np.diff(np.append(begin, len(codes))))
            at = np.flatnonzero(within % CHUNK == 0)
            spans = list(zip(at, np.append(at[1:], len(codes))))
            rest = [
                pa.array([int(w[s:e].sum()) for s, e in spans], pa.int64()),
                pa.array([v[s + np.searchsorted(np.cumsum(w[s:e]), w[s:e].sum() / 2)] for s, e in spans], pa.float64()),
                pa.array([pa.compress(v[s:e].tobytes(), codec="zstd", asbytes=True) for s, e in spans], pa.binary()),
                pa.array([int(e - s).to_bytes(8, "little") + (pa.compress(w[s:e].tobytes(), codec="zstd", asbytes=True) if weighted else b"") for s, e in spans], pa.binary()),
            ]
            pick = pa.array(order[at])
            return pa.RecordBatch.from_arrays([*[t.column(i).combine_chunks().take(pick).cast(schema.field(i).type) for i in range(n_keys)], *rest], schema=schema)

        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= HOLD_ROWS:
                yield chunks(held)
                held, rows = [], 0
        if held:
            yield chunks(held)

    return narrow.mapInArrow(run, kind)


def chunk_values(data: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Values of a chunk and their running weight, which starts at 0; weights are the count alone if all are 1."""
    n = int.from_bytes(weights[:8], "little")
    v = np.frombuffer(pa.decompress(data, n * 8, codec="zstd"), np.float64)
    if len(weights) == 8:
        return v, np.arange(n + 1)
    return v, np.append(0, np.cumsum(np.frombuffer(pa.decompress(weights[8:], n * 8, codec="zstd"), np.int64)))


def chunk_bytes(v: np.ndarray, w: np.ndarray, like: bytes) -> tuple[bytes, bytes]:
    """Part of a chunk in the form of chunk_values(); like are the weights of the whole."""
    size = len(v).to_bytes(8, "little")
    return pa.compress(v.tobytes(), codec="zstd", asbytes=True), size if len(like) == 8 else size + pa.compress(w.astype(np.int64).tobytes(), codec="zstd", asbytes=True)


def multi_select(df: DataFrame, keys: list[str], value: str, ps: list[float], weight: str | None = None) -> DataFrame:
    """keys, p, n, value: of each group the value of rank ceil(p * n) (the least for p = 0), exactly.

    n is the number of values (or the sum of weights, whole numbers). Null and NaN values and weights
    that are null or not positive are left out; infinite values take part; null keys are a group of
    their own; groups without values and empty tables give no row; ties need no rule, as equal values
    are one value. With each target a round discards a quarter or more of what is left, about half in
    practice; the driver only sees how many targets are open.
    """
    names = [f"k{i}" for i in range(len(keys))]
    kinds = {f.name: f.dataType for f in df.schema}
    chunks = cut(sorted_chunks(df, keys, value, weight))
    start = chunks.groupBy(*names).agg(F.sum("n").alias("n"), _proposals("mid", "n").alias("mids")).select(*names, "n", _weighted_median("mids").alias("pivot"))
    targets = F.explode(F.array(*[F.lit(float(p)) for p in ps]))
    minus, plus = F.lit(float("-inf")), F.lit(float("inf"))
    state = start.select(*names, "n", targets.alias("p"), "pivot").select(
        *names, "n", "p", F.greatest(F.lit(1), F.ceil(F.round(F.col("p") * F.col("n"), 9))).cast("long").alias("rank"), minus.alias("lo"), F.lit(True).alias("lo_open"), plus.alias("hi"), F.lit(True).alias("hi_open"), F.col("n").alias("left"), "pivot", F.lit(None).cast("double").alias("found")
    )
    state = cut(state)
    key_fields = [T.StructField(m, kinds[k]) for m, k in zip(names, keys)]
    held_fields = [T.StructField("data", T.BinaryType()), T.StructField("weights", T.BinaryType())]
    step_type = T.StructType([*key_fields, T.StructField("p", T.DoubleType()), *[T.StructField(c, T.LongType()) for c in ("lt", "eq", "gt")], T.StructField("mid_lt", T.DoubleType()), T.StructField("mid_gt", T.DoubleType()), *held_fields])
    rest_type = T.StructType([*key_fields, T.StructField("p", T.DoubleType()), T.StructField("vs", T.ArrayType(T.DoubleType())), T.StructField("ws", T.ArrayType(T.LongType()))])
    step_schema, rest_schema, n_keys = to_arrow_schema(step_type), to_arrow_schema(rest_type), len(keys)

    def ranges(batch: pa.RecordBatch, i: int):
        """Values, running weights and the open ranges of a chunk's targets: positions from, to."""
        v, run = chunk_values(batch.column(n_keys)[i].as_py(), batch.column(n_keys + 1)[i].as_py())
        t = batch.column(n_keys + 2)[i].as_py()
        lo, hi = np.array([x["lo"] for x in t]), np.array([x["hi"] for x in t])
        a = np.where([x["lo_open"] for x in t], 0, np.searchsorted(v, lo, side="right"))
        b = np.where([x["hi_open"] for x in t], len(v), np.searchsorted(v, hi, side="left"))
        return v, run, t, a, np.maximum(a, b)

    def middle(v, run, a, b):
        """Weighted median of v[a:b]; NaN where there is none."""
        at = np.searchsorted(run, (run[a] + run[b]) / 2, side="left") - 1
        at = np.clip(at, a, np.maximum(a, b - 1))
        return np.where(b > a, v[np.minimum(at, len(v) - 1)], np.nan)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of counts (with p), and the chunks with what may still be wanted (without p)."""
        for batch in batches:
            where, cols, kept = [], [[] for _ in range(6)], []
            for i in range(batch.num_rows):
                v, run, t, a, b = ranges(batch, i)
                going = np.array([x["going"] for x in t])
                wanted = np.zeros(len(v) + 1, np.int64)
                np.add.at(wanted, a, 1)
                np.add.at(wanted, b, -1)
                mask = np.cumsum(wanted)[:-1] > 0
                if mask.any():
                    kept.append((i, *chunk_bytes(v[mask], np.diff(run)[mask], batch.column(n_keys + 1)[i].as_py())))
                if not going.any():
                    continue
                t, a, b = [x for x, g in zip(t, going) if g], a[going], b[going]
                pivot = np.array([x["pivot"] for x in t])
                s = np.clip(np.searchsorted(v, pivot, side="left"), a, b)
                e = np.clip(np.searchsorted(v, pivot, side="right"), a, b)
                for c, x in zip(cols, ([y["p"] for y in t], run[s] - run[a], run[e] - run[s], run[b] - run[e], middle(v, run, a, s), middle(v, run, e, b))):
                    c.extend(x)
                where += [i] * len(t)
            at, none = pa.array(where + [k[0] for k in kept], pa.int64()), len(where)
            counts = [pa.concat_arrays([pa.array(np.asarray(c), step_schema.field(n_keys + j).type, from_pandas=True), pa.nulls(len(kept), step_schema.field(n_keys + j).type)]) for j, c in enumerate(cols)]
            held = [pa.concat_arrays([pa.nulls(none, pa.binary()), pa.array([k[j] for k in kept], pa.binary())]) for j in (1, 2)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(at).cast(step_schema.field(i).type) for i in range(n_keys)], *counts, *held], schema=step_schema)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, ps_, vs, ws = [], [], [], []
            for i in range(batch.num_rows):
                v, run, t, a, b = ranges(batch, i)
                for x, s, e in zip(t, a, b):
                    if e > s:
                        where.append(i)
                        ps_.append(x["p"])
                        vs.append(v[s:e])
                        ws.append(np.diff(run[s : e + 1]))
            at = pa.array(where, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(at).cast(rest_schema.field(i).type) for i in range(n_keys)], pa.array(ps_, pa.float64()), pa.array(vs, pa.list_(pa.float64())), pa.array(ws, pa.list_(pa.int64()))], schema=rest_schema)

    def with_targets(chunks: DataFrame, open_: DataFrame) -> DataFrame:
        going = (F.col("left") > FINISH).alias("going")
        listed = open_.groupBy(*names).agg(F.collect_list(F.struct("p", "lo", "lo_open", "hi", "hi_open", "pivot", going)).alias("t")).select(*[F.col(m).alias(f"_{m}") for m in names], "t")
        return chunks.join(listed, _same(names)).select(*names, "data", "weights", "t")

    while True:
        unfound = state.filter("found is null")
        if unfound.filter(F.col("left") > FINISH).isEmpty():
            break
        done = cut(with_targets(chunks, unfound).mapInArrow(step, step_type))
        chunks = done.filter("p is null").select(*names, "data", "weights")
        sums = done.filter("p is not null").groupBy(*names, "p").agg(*[F.sum(c).alias(c) for c in ("lt", "eq", "gt")], _proposals("mid_lt", "lt").alias("lows"), _proposals("mid_gt", "gt").alias("highs"))
        sums = sums.withColumn("below", _weighted_median("lows")).withColumn("above", _weighted_median("highs"))
        sums = sums.select(*[F.col(m).alias(f"_{m}") for m in names], F.col("p").alias("_p"), "lt", "eq", "gt", "below", "above")
        both = state.join(sums, _same(names) & (F.col("p") == F.col("_p")), "left")
        moved, low = F.col("lt").isNotNull(), F.col("rank") <= F.col("lt")
        hit = moved & ~low & (F.col("rank") <= F.col("lt") + F.col("eq"))
        high = moved & ~low & ~hit
        low = moved & low
        state = cut(
            both.select(
                *names, "n", "p",
                F.when(high, F.col("rank") - F.col("lt") - F.col("eq")).otherwise(F.col("rank")).alias("rank"),
                F.when(high, F.col("pivot")).otherwise(F.col("lo")).alias("lo"), F.when(high, F.lit(False)).otherwise(F.col("lo_open")).alias("lo_open"),
                F.when(low, F.col("pivot")).otherwise(F.col("hi")).alias("hi"), F.when(low, F.lit(False)).otherwise(F.col("hi_open")).alias("hi_open"),
                F.when(low, F.col("lt")).when(high, F.col("gt")).otherwise(F.col("left")).alias("left"),
                F.when(low, F.col("below")).when(high, F.col("above")).otherwise(F.col("pivot")).alias("pivot"),
                F.when(hit, F.col("pivot")).otherwise(F.col("found")).alias("found"),
            )
        )
    few = with_targets(chunks, state.filter("found is null")).mapInArrow(rest, rest_type)
    lists = few.groupBy(*names, "p").agg(F.array_sort(F.flatten(F.collect_list(F.arrays_zip(F.col("vs").alias("v"), F.col("ws").alias("w"))))).alias("all")).select(*[F.col(m).alias(f"_{m}") for m in names], F.col("p").alias("_p"), "all")
    # The first value at which the running weight reaches the rank.
    none = F.lit(None).cast("double")
    walk = F.aggregate("all", F.struct(F.lit(0).cast("long").alias("sum"), none.alias("v")), lambda acc, x: F.struct((acc["sum"] + x["w"]).alias("sum"), F.when(acc["sum"] < F.col("rank"), x["v"]).otherwise(acc["v"]).alias("v")))["v"]
    out = state.join(lists, _same(names) & (F.col("p") == F.col("_p")), "left").select(*[F.col(m).alias(k) for m, k in zip(names, keys)], "p", "n", F.coalesce("found", walk).alias("value"))
    return out


def _proposals(value: str, weight: str) -> Column:
    return F.collect_list(F.when(F.col(value).isNotNull() & (F.col(weight) > 0), F.struct(F.col(value).alias("v"), F.col(weight).alias("w"))))


def _weighted_median(proposals: str) -> Column:
    """The first value at which the running weight reaches half of all; null without proposals."""
    half = F.aggregate(proposals, F.lit(0).cast("long"), lambda s, x: s + x["w"]) / 2
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("double").alias("v"))
    return F.aggregate(F.array_sort(proposals), start, lambda acc, x: F.struct((acc["sum"] + x["w"]).alias("sum"), F.when(acc["sum"] < half, x["v"]).otherwise(acc["v"]).alias("v")))["v"]


def _same(names: list[str]):
    on = F.lit(True)
    for m in names:
        on &= F.col(m).eqNullSafe(F.col(f"_{m}"))
    return on


def percentile_summary(df: DataFrame, keys: list[str], value: str, points: int = 100) -> DataFrame:
    """keys, n, points: a group's values at points + 1 even ranks; any percentile read off is at most 1 / points off in rank."""
    cutoffs = multi_select(df, keys, value, [i / points for i in range(points + 1)])
    return cutoffs.groupBy(*keys).agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("p", "value"))), lambda x: x["value"]).alias("points"))


def combine_summaries(summaries: DataFrame, keys: list[str], ps: list[float]) -> DataFrame:
    """keys, p, n, value: percentiles over all summaries of a group (runs, days, partitions), at most 1 / points off in rank.

    Each of a summary's points stands for its share of the n values; the shares sum to n.
    """
    steps = F.size("points") - 1
    share = F.floor(F.col("n") * (F.col("pos") + 1) / steps) - F.floor(F.col("n") * F.col("pos") / steps)
    middle = summaries.select(*keys, "n", "points", F.posexplode(F.slice("points", F.lit(2), steps)).alias("pos", "v"))
    weighted = middle.select(*keys, "v", share.alias("w"))
    return multi_select(weighted, keys, "v", ps, "w")
