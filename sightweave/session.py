"""Session builder, reliable checkpoints and table readers shared by all operators."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bits of an estimated size that no table has.
SIZE_BITS = 64


def build_session(app: str = "sightweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator assumes: UTC, AQE and Arrow transfer."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return builder.config(map=settings).getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Take the shared folder the cluster names; only where none is named (local runs, tests) use an own one."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
        return
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="sightweave-ckpt-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)


def cut(df: DataFrame) -> DataFrame:
    """Materialise reliably and cut the lineage; survives the loss of any executor.

    A checkpoint keeps the planner's estimate of its size, and a join multiplies those of its sides: over
    rounds of joins the numbers get megabytes long. One beyond any size is given up for the default.
    """
    ensure_checkpoint_dir(df.sparkSession)
    done = df.checkpoint(eager=True)
    plan = done._jdf.queryExecution()
    try:
        if plan.optimizedPlan().stats().sizeInBytes().bit_length() < SIZE_BITS:
            return done
    except ValueError:  # more digits than Python takes
        pass
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(plan.toRdd(), done._jdf.schema(), False), df.sparkSession)


def release(df: DataFrame) -> None:
    """Have the shuffle files deleted that nothing refers to any more (after a cut); else they stay until the driver collects its garbage."""
    gc.collect()
    df.sparkSession._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def latest(df: DataFrame, key: list[str], by: str, columns: list[str]) -> DataFrame:
    """One row per key: of rows sent again, the one that arrived last (ties: the greatest values)."""
    newest = df.groupBy(*key).agg(F.max(F.struct(by, *columns)).alias("_row"))
    return newest.select(*key, *[F.col(f"_row.{c}").alias(c) for c in columns])


#: Hash buckets of keys; those with a repeated key are at most so many rows of a broadcast.
BUCKETS = 1 << 20


def latest_of_repeated(df: DataFrame, key: str, by: str, columns: list[str]) -> DataFrame:
    """latest() of one key, for wide rows of which few are sent again: only rows in a bucket with a repeated key are shuffled.

    Where many are sent again all buckets have one, and it is latest() of all rows.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(bucket.alias("bucket_")).distinct()
    told = cut(repeated)
    rows = df.select(key, by, *columns).withColumn("bucket_", bucket)
    once = rows.join(F.broadcast(told), "bucket_", "left_anti").select(key, *columns)
    return once.unionByName(latest(rows.join(F.broadcast(told), "bucket_", "left_semi"), [key], by, columns))
