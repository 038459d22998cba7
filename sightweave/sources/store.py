"""The observation store and the decision log as tables and files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sightweave.operators.pairs import nearest_exact


class ObservationStore:
    """Observations in Parquet, partitioned by run, with vectors of one length."""

    def __init__(self, spark: SparkSession, path: str, dim: int = 512, read_only: bool = False):
        self.spark, self.path, self.dim, self.read_only = spark, path, dim, read_only

    def _writable(self) -> None:
        if self.read_only:
            raise PermissionError("the store is read-only")

    def add(self, df: DataFrame) -> None:
        """Append rows with run_id and embedding; a vector of another length stops the write."""
        self._writable()
        checked = df.withColumn("embedding", F.when(F.size("embedding") == self.dim, F.col("embedding")).otherwise(F.raise_error(F.lit(f"a vector has {self.dim} numbers")).cast("array<float>")))
        checked.write.mode("append").partitionBy("run_id").parquet(self.path)

    def rows(self, run_id: str | None = None) -> DataFrame:
        """All rows, or those of one run (only its folder is read); an unknown run is refused."""
        df = self.spark.read.parquet(self.path)
        if run_id is None:
            return df
        df = df.filter(F.col("run_id") == run_id)
        if df.isEmpty():
            raise KeyError(f"no run {run_id}")
        return df

    def count(self) -> int:
        try:
            return self.rows().count()
        except AnalysisException:
            return 0

    def reset(self) -> None:
        """Empty the store; the schema stays."""
        self._writable()
        self.rows().limit(0).write.mode("overwrite").parquet(self.path)

    def search(self, queries: DataFrame, k: int, item: str = "obs_id") -> DataFrame:
        """The k most similar stored rows of every query, exactly."""
        return nearest_exact(queries, self.rows(), item, "embedding", k)


def write_decision_log(path: str, decisions: DataFrame, outcomes: DataFrame, summary: DataFrame) -> None:
    """JSON lines by type: decision, outcome, summary."""
    for kind, df in (("decision", decisions), ("outcome", outcomes), ("summary", summary)):
        df.write.mode("overwrite").json(os.path.join(path, f"type={kind}"))


def read_decision_log(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """Rows of one type; without a log of that name the caller gets Spark's error."""
    return spark.read.schema(schema).json(os.path.join(path, f"type={kind}"))


def latest_log(folder: str) -> str:
    """The log whose name comes last; run ids sort by time."""
    names = sorted(n for n in os.listdir(folder) if not n.startswith((".", "_")))
    if not names:
        raise FileNotFoundError(f"no log in {folder}")
    return os.path.join(folder, names[-1])


def annotations(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Boxes of annotation sidecars: camera, run_id, frame, box, x1, y1, x2, y2, track_id, confidence."""
    box = "struct<x1:int,y1:int,x2:int,y2:int,track_id:bigint,confidence:double>"
    raw = spark.read.option("multiLine", True).schema(f"camera string, run_id string, clip string, clip_fps double, frames bigint, annotations array<array<{box}>>").json(paths)
    frames = raw.select("camera", "run_id", F.posexplode("annotations").alias("frame", "boxes"))
    return frames.select("camera", "run_id", "frame", F.posexplode("boxes").alias("box", "b")).select("camera", "run_id", "frame", "box", "b.*")


def without_sidecar(clips: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Clips that no sidecar describes."""
    return clips.join(sidecars.select("clip"), "clip", "left_anti")
