"""Observations and tracklets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightweave.functions.vectors import prototypes, unit, usable
from sightweave.session import latest_of_repeated

KEY = ["run_id", "cam", "track_id"]


def observations(detections: DataFrame, dim: int) -> DataFrame:
    """Complete observations: detections counted once, with a track, a frame and a usable vector (as unit_vector)."""
    columns = ["run_id", "cam", "track_id", "frame_index", "x1", "y1", "x2", "y2", "confidence", "reid_id", "global_id", "embedding"]
    rows = latest_of_repeated(detections, "det_id", "ingested_at", columns)
    rows = rows.dropna(subset=["run_id", "cam", "track_id", "frame_index"]).filter(usable(F.col("embedding"), dim))
    return rows.select(*[c for c in ["det_id", *columns] if c not in ("reid_id", "global_id", "embedding")], F.coalesce("reid_id", "global_id").alias("gid"), unit(F.col("embedding")).alias("unit_vector"))


def tracklets(obs: DataFrame) -> DataFrame:
    """One row per track: its span in frames, number of observations and the ids it carried."""
    return obs.groupBy(*KEY).agg(F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"), F.count(F.lit(1)).alias("observations"), F.array_sort(F.collect_set("gid")).alias("gids"))


def with_prototypes(obs: DataFrame, dim: int, min_observations: int = 1) -> DataFrame:
    """Tracklets of enough observations with their prototype; zero prototypes are left out."""
    protos = prototypes(obs, KEY, "unit_vector", dim)
    return tracklets(obs).filter(F.col("observations") >= min_observations).join(protos, KEY).filter("prototype is not null")


def even_rows(rows: DataFrame, keys: list[str], order: list[str], cap: int) -> DataFrame:
    """At most cap rows of each group, evenly spread with both ends; cap <= 0 keeps all.

    Row i of n is kept if it is the half-even rounding of j * (n - 1) / (cap - 1) for a j below cap.
    """
    if cap <= 0:
        return rows
    by = Window.partitionBy(*keys)
    ranked = rows.withColumn("_i", F.row_number().over(by.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(by))
    if cap == 1:
        return ranked.filter("_i = 0").drop("_i", "_n")
    step = (F.col("_n") - 1) / F.lit(float(cap - 1))
    near = F.round(F.col("_i") / step).cast("int")
    hit = F.lit(False)
    for d in (-1, 0, 1):
        j = near + d
        hit |= (j >= 0) & (j < cap) & (F.rint(j * step).cast("long") == F.col("_i"))
    return ranked.filter((F.col("_n") <= cap) | hit).drop("_i", "_n")


def final_ids(obs: DataFrame) -> DataFrame:
    """The id that most observations of a track carry (ties: the smallest)."""
    counts = obs.filter("gid is not null").groupBy(*KEY, "gid").agg(F.count(F.lit(1)).alias("n"))
    place = Window.partitionBy(*KEY).orderBy(F.desc("n"), "gid")
    return counts.withColumn("place", F.row_number().over(place)).filter("place = 1").select(*KEY, F.col("gid").alias("final_id"), "n")
