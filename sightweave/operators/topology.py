"""Least transit times between cameras and the vetoes they give."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cameras of a topology at most; it describes a site, not the data.
MAX_CAMERAS = 5000


def shortest_transits(edges: DataFrame) -> DataFrame:
    """cam_a, cam_b, seconds: the shortest way between all cameras (null: no way), both directions.

    Edges go both ways, parallel ones take the least time, negative times count as 0, rows with a
    null camera or time are left out. The number of cameras is checked before the closure is
    computed in memory.
    """
    given = edges.select("cam_a", "cam_b", "min_transit_sec").dropna()
    if given.select(F.explode(F.array("cam_a", "cam_b")).alias("cam")).distinct().limit(MAX_CAMERAS + 1).count() > MAX_CAMERAS:
        raise ValueError(f"a topology has {MAX_CAMERAS} cameras at most")
    rows = given.groupBy(F.least("cam_a", "cam_b").alias("a"), F.greatest("cam_a", "cam_b").alias("b")).agg(F.min("min_transit_sec").alias("s")).collect()
    cams = sorted({r[i] for r in rows for i in (0, 1)})
    at = {c: i for i, c in enumerate(cams)}
    d = np.full((len(cams), len(cams)), np.inf)
    np.fill_diagonal(d, 0)
    for a, b, s in rows:
        i, j = at[a], at[b]
        d[i, j] = d[j, i] = min(d[i, j], max(0.0, s))
    for k in range(len(cams)):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])
    out = [(a, b, float(d[i, j]) if np.isfinite(d[i, j]) else None) for a, i in at.items() for b, j in at.items()]
    return edges.sparkSession.createDataFrame(out, "cam_a string, cam_b string, seconds double")


def with_transit(moves: DataFrame, transits: DataFrame, source: str, target: str, gap: Column) -> DataFrame:
    """moves with allowed: whether gap seconds suffice from source to target.

    The same camera and cameras outside the topology are allowed, known but unconnected ones never;
    a negative gap counts as 0.
    """
    pairs = F.broadcast(transits.select(F.col("cam_a").alias("_a"), F.col("cam_b").alias("_b"), "seconds", F.lit(True).alias("known")))
    joined = moves.join(pairs, (F.col(source) == F.col("_a")) & (F.col(target) == F.col("_b")), "left")
    allowed = (F.col(source) == F.col(target)) | F.col("known").isNull() | (F.col("seconds").isNotNull() & (F.greatest(F.lit(0.0), gap) >= F.col("seconds")))
    return joined.withColumn("allowed", allowed).drop("_a", "_b", "known")
