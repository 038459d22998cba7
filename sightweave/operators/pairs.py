"""Pairs of similar vectors within groups, by blocked matrix products that return only pairs over the bar."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vectors of a block.
BLOCK = 1024


def set_score(a: np.ndarray, b: np.ndarray, mode: str, top_frac: float) -> float:
    """Score of two sets of unit rows beyond their prototypes: the best pair, or the mean of the best share of pairs."""
    s = (a @ b.T).ravel()
    if mode == "max_exemplar":
        return float(s.max())
    k = max(1, int(np.rint(len(s) * top_frac)))
    return float(np.sort(np.partition(s, len(s) - k)[len(s) - k :])[::-1].mean())


def similar_pairs(df: DataFrame, group: str, item: str, vector: str, bar: float, block: int = BLOCK, rows: str | None = None, mode: str = "prototype", top_frac: float = 0.25) -> DataFrame:
    """group, a, b (a < b), score: pairs of items of one group whose score is at least bar.

    The items of a group are dealt to blocks, each pair of blocks is one task's matrix product, and
    only pairs over the bar leave it; so no task holds a group, and no list of all pairs exists.
    Items are whole numbers, vectors have length one. mode prototype scores the vectors; with rows
    (an array of unit rows each) max_exemplar takes the best pair of rows if it is better, consensus
    the mean of the best top_frac of them.
    """
    kind = next(f.dataType for f in df.schema if f.name == group)
    base = df.select(F.col(group).alias("g"), F.col(item).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v"), *([F.col(rows).alias("r")] if rows else []))
    sizes = base.groupBy("g").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block)).cast("int").alias("blocks"))
    dealt = base.join(sizes, base["g"].eqNullSafe(sizes["g"])).select(base["*"], "blocks", F.pmod(F.xxhash64("i"), F.col("blocks")).cast("int").alias("own"))
    # A block meets every block of its group once: the pair (small, large) gets the rows of both.
    spread = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    keyed = spread.select("g", "i", "v", *(["r"] if rows else []), "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    schema = T.StructType([T.StructField("g", kind), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("score", T.DoubleType())])

    def score(t: pa.Table) -> pa.Table:
        x, y = t.column("x")[0].as_py(), t.column("y")[0].as_py()
        ids, own = t.column("i").to_numpy(), t.column("own").to_numpy()
        flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        v = flat.reshape(len(ids), -1)
        left = np.flatnonzero(own == x)
        right = left if x == y else np.flatnonzero(own == y)
        if mode == "prototype" or not rows:
            s = v[left] @ v[right].T
        else:
            sets = [np.array(r, dtype=np.float64) for r in t.column("r").to_pylist()]
            s = np.array([[set_score(sets[p], sets[q], mode, top_frac) if ids[p] < ids[q] or x != y else -2.0 for q in right] for p in left]).reshape(len(left), len(right))
            if mode == "max_exemplar":
                s = np.maximum(s, v[left] @ v[right].T)
        p, q = np.nonzero(s >= bar)
        a, b, s = ids[left[p]], ids[right[q]], s[p, q]
        keep = a < b if x == y else np.ones(len(a), bool)
        lo, hi = np.minimum(a, b)[keep], np.maximum(a, b)[keep]
        g = t.column("g").slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(lo), np.int64)))
        return pa.table({"g": g, "a": lo, "b": hi, "score": s[keep]})

    return keyed.groupBy("g", "x", "y").applyInArrow(score, schema).withColumnRenamed("g", group)


def nearest_exact(queries: DataFrame, base: DataFrame, item: str, vector: str, k: int, block: int = 8192) -> DataFrame:
    """query, other, score: the k most similar of base for each query, exactly, other than itself (ties: the smaller id).

    Every query meets every block of base in one matrix product; a block returns its best k for each
    query, and the blocks' lists are merged.
    """
    q = queries.select(F.col(item).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v")).dropna()
    b = base.select(F.col(item).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v")).dropna()
    n_base, n_query = (max(1, -(-x.count() // block)) for x in (b, q))
    left = q.select("*", F.lit(0).alias("side"), F.pmod(F.xxhash64("i"), F.lit(n_query)).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(n_base - 1))).alias("y"))
    right = b.select("*", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))).alias("x"), F.pmod(F.xxhash64("i"), F.lit(n_base)).cast("int").alias("y"))

    def best(t: pa.Table) -> pa.Table:
        ids, side = t.column("i").to_numpy(), t.column("side").to_numpy()
        v = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        p, c = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        c = c[np.argsort(ids[c], kind="stable")]
        for s in range(0, len(p), 512):
            rows = p[s : s + 512]
            if not len(c):
                break
            sim = v[rows] @ v[c].T
            sim[ids[rows][:, None] == ids[c][None, :]] = -np.inf
            at = np.argsort(-np.round(sim, 12), axis=1, kind="stable")[:, :k]
            got = np.take_along_axis(sim, at, 1)
            keep = np.isfinite(got)
            out = [np.append(o, n) for o, n in zip(out, (np.repeat(ids[rows], keep.sum(1)), ids[c][at[keep]], got[keep]))]
        return pa.table({"query": out[0], "other": out[1], "score": out[2]})

    from pyspark.sql.window import Window

    part = left.unionByName(right).groupBy("x", "y").applyInArrow(best, "query long, other long, score double")
    place = Window.partitionBy("query").orderBy(F.desc(F.round("score", 12)), "other")
    return part.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k)


def best_labels(queries: DataFrame, base: DataFrame, item: str, vector: str, label: str, block: int = 8192) -> DataFrame:
    """query, label, score, second: each query's best label and the score of its second, exactly (ties: the larger label).

    A label's score is that of its most similar vector other than the query itself. Blocks meet as in
    nearest_exact; each returns its two best labels of a query, which is enough: in the block that
    gives a label its score, only labels of a higher score can stand before it. Any number of labels
    costs no more rows. Scores count to twelve places; second is null where there is one label.
    """
    kind = next(f.dataType for f in base.schema if f.name == label)
    q = queries.select(F.col(item).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v")).dropna()
    b = base.select(F.col(item).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("l")).dropna(subset=["i", "v"])
    n_base, n_query = (max(1, -(-x.count() // block)) for x in (b, q))
    left = q.select("*", F.lit(None).cast(kind).alias("l"), F.lit(0).alias("side"), F.pmod(F.xxhash64("i"), F.lit(n_query)).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(n_base - 1))).alias("y"))
    right = b.select("*", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))).alias("x"), F.pmod(F.xxhash64("i"), F.lit(n_base)).cast("int").alias("y"))

    def best(t: pa.Table) -> pa.Table:
        ids, side = t.column("i").to_numpy(), t.column("side").to_numpy()
        v = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        labels = t.column("l").combine_chunks()
        p, c = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        # Columns by label, the largest first and null last, as ties go.
        c = c[pc.sort_indices(labels.take(pa.array(c)), sort_keys=[("", "descending")], null_placement="at_end").to_numpy()] if len(c) else c
        codes = labels.take(pa.array(c)).dictionary_encode(null_encoding="encode").indices.to_numpy() if len(c) else c
        at = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(c) else c
        for s in range(0, len(p) if len(c) else 0, 512):
            rows = p[s : s + 512]
            sim = np.round(v[rows] @ v[c].T, 12)
            sim[ids[rows][:, None] == ids[c][None, :]] = -np.inf
            each = np.maximum.reduceat(sim, at, axis=1)
            top = np.argsort(-each, axis=1, kind="stable")[:, :2]
            got = np.take_along_axis(each, top, 1)
            keep = np.isfinite(got)
            out = [np.append(o, n) for o, n in zip(out, (np.repeat(ids[rows], keep.sum(1)), c[at[top[keep]]], got[keep]))]
        return pa.table({"query": out[0], "label": labels.take(pa.array(out[1])), "score": out[2]})

    from pyspark.sql.window import Window

    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("label", kind), T.StructField("score", T.DoubleType())])
    part = left.unionByName(right).groupBy("x", "y").applyInArrow(best, schema).groupBy("query", "label").agg(F.max("score").alias("score"))
    by = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("label"))
    return part.withColumn("second", F.lead("score").over(by)).withColumn("place", F.row_number().over(by)).filter("place = 1").drop("place")
