"""Queries on continuous periods and sessions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightweave.operators.intervals import interval_gaps, interval_periods
from sightweave.operators.sessions import sessionize
from sightweave.session import latest, table

FRAME_STEP, TIME_STEP_MS, SESSION_GAP_US = 1, 1000, 30_000_000


def _ranges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Decisions counted once, as frame ranges of single-camera decisions and as time ranges in ms of all."""
    columns = ["run_id", "assigned_id", "cameras", "frame_range", "time_range"]
    rows = latest(table(spark, sf_dir, "decisions"), ["decision_id"], "logged_at", columns).filter("assigned_id is not null")
    named = F.array_distinct(F.array_compact("cameras"))
    frames = rows.filter(F.size(named) == 1).select("run_id", "assigned_id", named[0].alias("camera"), F.get("frame_range", F.lit(0)).alias("a"), F.get("frame_range", F.lit(1)).alias("b"))
    ms = lambda i: F.round(F.nanvl(F.get("time_range", F.lit(i)), F.lit(None).cast("double")) * 1000).cast("long")
    times = rows.select("run_id", "assigned_id", F.lit("*").alias("camera"), ms(0).alias("a"), ms(1).alias("b"))
    return frames, times


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of each identity: in frames per camera, and in milliseconds over all cameras."""
    frames, times = _ranges(spark, sf_dir)
    keys = ["run_id", "assigned_id", "camera"]
    a = interval_gaps(frames, keys, "a", "b", FRAME_STEP).withColumn("clock", F.lit("frame"))
    b = interval_gaps(times, keys, "a", "b", TIME_STEP_MS).withColumn("clock", F.lit("time"))
    return a.unionByName(b).select("clock", *keys, "gap_from", "gap_to")


def p2_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous periods of each identity, by the same rules."""
    frames, times = _ranges(spark, sf_dir)
    keys = ["run_id", "assigned_id", "camera"]
    a = interval_periods(frames, keys, "a", "b", FRAME_STEP).withColumn("clock", F.lit("frame"))
    b = interval_periods(times, keys, "a", "b", TIME_STEP_MS).withColumn("clock", F.lit("time"))
    return a.unionByName(b).select("clock", *keys, "period_from", "period_to")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each track, by the times of its frames."""
    frames = latest(table(spark, sf_dir, "frames"), ["run_id", "cam", "frame_index"], "received_at", ["ts"]).filter("ts is not null")
    seen = latest(table(spark, sf_dir, "detections"), ["det_id"], "ingested_at", ["run_id", "cam", "frame_index", "track_id"]).filter("track_id is not null")
    timed = seen.join(frames, ["run_id", "cam", "frame_index"]).select("run_id", "cam", "track_id", F.unix_micros("ts").alias("us"))
    out = sessionize(timed, ["run_id", "cam", "track_id"], "us", SESSION_GAP_US)
    return out.select("run_id", "cam", "track_id", F.col("start").alias("start_us"), F.col("end").alias("end_us"), F.col("n_events").alias("n_detections"))


_DECISIONS = "SELECT * FROM decisions QUALIFY row_number() OVER (PARTITION BY decision_id ORDER BY logged_at DESC) = 1"
_RANGES = f"""
WITH d AS ({_DECISIONS}), r AS (
  SELECT 'frame' AS clock, run_id, assigned_id, list_distinct(cameras)[1] AS camera, least(frame_range[1], frame_range[2]) AS a, greatest(frame_range[1], frame_range[2]) AS b, 1 AS tol
  FROM d WHERE assigned_id IS NOT NULL AND len(list_distinct(cameras)) = 1 AND frame_range[1] IS NOT NULL AND frame_range[2] IS NOT NULL
  UNION
  SELECT 'time', run_id, assigned_id, '*', CAST(round(least(time_range[1], time_range[2]) * 1000) AS BIGINT), CAST(round(greatest(time_range[1], time_range[2]) * 1000) AS BIGINT), 1000
  FROM d WHERE assigned_id IS NOT NULL AND time_range[1] IS NOT NULL AND time_range[2] IS NOT NULL
), m AS (
  SELECT *, max(b) OVER (PARTITION BY clock, run_id, assigned_id, camera ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r
)"""
P2_FOUND_SQL = _RANGES + " SELECT clock, run_id, assigned_id, camera, reach AS gap_from, a AS gap_to FROM m WHERE a > reach + tol"
P2_PERIODS_SQL = (
    _RANGES
    + """, i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + tol THEN 1 ELSE 0 END) OVER (PARTITION BY clock, run_id, assigned_id, camera ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT clock, run_id, assigned_id, camera, min(a) AS period_from, max(b) AS period_to FROM i GROUP BY clock, run_id, assigned_id, camera, island"""
)
P4_FOUND_SQL = """
WITH f AS (SELECT * FROM frames QUALIFY row_number() OVER (PARTITION BY run_id, cam, frame_index ORDER BY received_at DESC) = 1),
d AS (SELECT * FROM detections QUALIFY row_number() OVER (PARTITION BY det_id ORDER BY ingested_at DESC) = 1),
t AS (SELECT d.run_id, d.cam, d.track_id, epoch_us(f.ts) AS us, d.det_id FROM d JOIN f ON d.run_id = f.run_id AND d.cam = f.cam AND d.frame_index = f.frame_index WHERE d.track_id IS NOT NULL AND f.ts IS NOT NULL),
g AS (SELECT *, us - lag(us) OVER (PARTITION BY run_id, cam, track_id ORDER BY us, det_id) AS step FROM t),
s AS (SELECT *, sum(CASE WHEN step IS NULL OR step > 30000000 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, cam, track_id ORDER BY us, det_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT run_id, cam, track_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n_detections FROM s GROUP BY run_id, cam, track_id, session"""

QUERIES = {"p2_found": p2_found, "p2_periods": p2_periods, "p4_found": p4_found}
SQL = {"p2_found": P2_FOUND_SQL, "p2_periods": P2_PERIODS_SQL, "p4_found": P4_FOUND_SQL}
