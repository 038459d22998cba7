"""Queries on frames, boxes and queues, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightweave.config import DetectorConfig
from sightweave.functions import geometry as geo
from sightweave.functions import scoring
from sightweave.operators.topology import shortest_transits, with_transit
from sightweave.plans.identity import D, OBS, seen
from sightweave.session import latest, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
WIDTH, HEIGHT = 1920, 1080


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames counted once, with a time."""
    return latest(table(spark, sf_dir, "frames"), ["run_id", "cam", "frame_index"], "received_at", ["ts", "device"]).filter("ts is not null")


FR = "f AS (SELECT * FROM (SELECT * FROM frames QUALIFY row_number() OVER (PARTITION BY run_id, cam, frame_index ORDER BY received_at DESC) = 1) WHERE ts IS NOT NULL)"
PAIRS = D + """, q AS (SELECT x.det_id AS a, y.det_id AS b, x.run_id, x.cam, x.frame_index, greatest(0, least(x.x2, y.x2) - greatest(x.x1, y.x1)) * greatest(0, least(x.y2, y.y2) - greatest(x.y1, y.y1)) AS inter,
  greatest(0, x.x2 - x.x1) * greatest(0, x.y2 - x.y1) AS aa, greatest(0, y.x2 - y.x1) * greatest(0, y.y2 - y.y1) AS ab FROM d x JOIN d y ON x.run_id = y.run_id AND x.cam = y.cam AND x.frame_index = y.frame_index AND x.det_id <> y.det_id)"""


def frame_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered pairs of boxes of one frame; a frame holds a few boxes."""
    rows = seen(spark, sf_dir).select("run_id", "cam", "frame_index", "det_id", "x1", "y1", "x2", "y2")
    other = rows.select("run_id", "cam", "frame_index", *[F.col(c).alias(f"o_{c}") for c in ("det_id", "x1", "y1", "x2", "y2")])
    return rows.join(other, ["run_id", "cam", "frame_index"]).filter("det_id <> o_det_id")


@query(f"WITH {D} SELECT det_id, greatest(0, x1) AS x1, greatest(0, y1) AS y1, least({WIDTH}, x2) AS x2, least({HEIGHT}, y2) AS y2 FROM d WHERE least({WIDTH}, greatest(0, x2)) > least({WIDTH}, greatest(0, x1)) AND least({HEIGHT}, greatest(0, y2)) > least({HEIGHT}, greatest(0, y1))")
def clamp_boxes(spark, sf_dir):
    rows = seen(spark, sf_dir).select("det_id", geo.clamped(geo.box(), WIDTH, HEIGHT).alias("b")).filter("b is not null")
    return rows.select("det_id", "b.x1", "b.y1", "b.x2", "b.y2")


@query(f"WITH {D} SELECT cam, count(*) AS n, count(*) FILTER (class_id = 0 AND confidence >= 0.4) AS kept FROM d GROUP BY cam")
def class_confidence(spark, sf_dir):
    cfg = DetectorConfig()
    return seen(spark, sf_dir).groupBy("cam").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("class_id") == cfg.class_id) & (F.col("confidence") >= cfg.confidence)).alias("kept"))


@query(
    f"""WITH {D}, z AS (SELECT det_id, crop_quality.width AS w, crop_quality.height AS h, crop_quality.blur AS bl, crop_quality.brightness AS br FROM d WHERE crop_quality IS NOT NULL)
SELECT det_id, CASE WHEN w < 24 THEN 'too_narrow' WHEN h < 64 THEN 'too_short' WHEN w * h < 2500 THEN 'too_small' WHEN w * h / 2073600.0 < 0.002 THEN 'too_tiny_in_frame' WHEN w / h < 0.2 OR w / h > 1.2 THEN 'bad_aspect' WHEN bl < 20 THEN 'blurry' WHEN br < 20 OR br > 235 THEN 'bad_brightness' ELSE 'ok' END AS reason FROM z"""
)
def quality_gate(spark, sf_dir):
    q = F.col("crop_quality")
    rows = seen(spark, sf_dir).filter(q.isNotNull())
    return rows.select("det_id", scoring.quality_reason(q["width"], q["height"], F.lit(WIDTH * HEIGHT), q["blur"], q["brightness"]).alias("reason"))


@query(f"WITH {D} SELECT det_id, round(CASE WHEN crop_quality IS NULL THEN 0.5 WHEN NOT crop_quality.accepted THEN 0 ELSE least(1, greatest(0, coalesce(least(1, crop_quality.blur / 60), 1) * coalesce(greatest(0, 1 - abs(crop_quality.brightness - 127.5) / 127.5), 1))) END::DOUBLE, 6) AS quality FROM d")
def quality_scalar(spark, sf_dir):
    return seen(spark, sf_dir).select("det_id", F.round(scoring.quality_scalar(F.col("crop_quality")), 6).alias("quality"))


@query(f"WITH {PAIRS} SELECT run_id, cam, count(*) FILTER (inter / nullif(aa + ab - inter, 0) >= 0.5) AS iou_50, count(*) FILTER (inter / nullif(aa + ab - inter, 0) >= 0.7) AS iou_70, count(*) FILTER (inter / nullif(least(aa, ab), 0) >= 0.8) AS contained_80 FROM q WHERE a < b GROUP BY ALL")
def box_iou_pairs(spark, sf_dir):
    a, b = geo.box(), geo.box("o_")
    pairs = frame_pairs(spark, sf_dir).filter("det_id < o_det_id")
    return pairs.groupBy("run_id", "cam").agg(F.count_if(geo.iou(a, b) >= 0.5).alias("iou_50"), F.count_if(geo.iou(a, b) >= 0.7).alias("iou_70"), F.count_if(geo.containment(a, b, of_smaller=True) >= 0.8).alias("contained_80"))


@query(f"WITH {PAIRS} SELECT a AS det_id, round(max(CASE WHEN aa > 0 THEN inter / aa ELSE 0 END), 6) AS occlusion, max(CASE WHEN aa > 0 THEN inter / aa ELSE 0 END) > 0.5 AS rejected FROM q GROUP BY a")
def occlusion(spark, sf_dir):
    share = geo.containment(geo.box(), geo.box("o_"))
    top = frame_pairs(spark, sf_dir).groupBy("det_id").agg(F.max(share).alias("o"))
    return top.select("det_id", F.round("o", 6).alias("occlusion"), (F.col("o") > scoring.QualityLimits().max_occlusion).alias("rejected"))


@query(
    f"""WITH RECURSIVE {D}, n AS (SELECT *, row_number() OVER (PARTITION BY run_id, cam, frame_index ORDER BY confidence DESC, det_id) AS i, count(*) OVER (PARTITION BY run_id, cam, frame_index) AS m FROM d),
k AS (SELECT run_id, cam, frame_index, i, m, [{{'d': det_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept FROM n WHERE i = 1 UNION ALL
  SELECT n.run_id, n.cam, n.frame_index, n.i, n.m, CASE WHEN len(list_filter(k.kept, lambda y: greatest(0, least(n.x2, y.x2) - greatest(n.x1, y.x1)) * greatest(0, least(n.y2, y.y2) - greatest(n.y1, y.y1)) >= 0.7 * (greatest(1, greatest(0, n.x2 - n.x1) * greatest(0, n.y2 - n.y1)) + greatest(1, greatest(0, y.x2 - y.x1) * greatest(0, y.y2 - y.y1)) - greatest(0, least(n.x2, y.x2) - greatest(n.x1, y.x1)) * greatest(0, least(n.y2, y.y2) - greatest(n.y1, y.y1))))) > 0
    THEN k.kept ELSE list_append(k.kept, {{'d': n.det_id, 'x1': n.x1, 'y1': n.y1, 'x2': n.x2, 'y2': n.y2}}) END FROM k JOIN n ON n.run_id = k.run_id AND n.cam = k.cam AND n.frame_index = k.frame_index AND n.i = k.i + 1)
SELECT run_id, cam, frame_index, m::INTEGER AS boxes, list_transform(kept, lambda x: x.d) AS kept FROM k WHERE i = m"""
)
def box_dedup(spark, sf_dir):
    """Boxes of a frame kept in order of confidence if they overlap none kept before by 0.7 or more."""
    b = F.struct((-F.col("confidence")).alias("c"), "det_id", *["x1", "y1", "x2", "y2"])
    listed = seen(spark, sf_dir).groupBy("run_id", "cam", "frame_index").agg(F.array_sort(F.collect_list(b)).alias("boxes"))
    corners = lambda x: (x["x1"], x["y1"], x["x2"], x["y2"])
    kept = F.aggregate("boxes", F.slice("boxes", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: geo.iou(corners(x), corners(y), floored=True) >= 0.7), acc).otherwise(F.concat(acc, F.array(x))))
    return listed.select("run_id", "cam", "frame_index", F.size("boxes").alias("boxes"), F.transform(kept, lambda x: x["det_id"]).alias("kept"))


@query(
    f"""WITH {PAIRS}, k AS (SELECT a AS outer_id, b AS inner_id, run_id, cam, frame_index FROM q WHERE ab > 0 AND aa > ab AND inter / ab >= 0.8),
n AS (SELECT *, row_number() OVER (PARTITION BY outer_id ORDER BY inner_id) - 1 AS i, count(*) OVER (PARTITION BY outer_id) AS m FROM k)
SELECT outer_id, inner_id, i::INTEGER AS part, d.track_id + 100000 * CASE WHEN i > 0 THEN i + 1 ELSE 0 END AS derived_track FROM n JOIN d ON d.det_id = outer_id WHERE m >= 2"""
)
def box_split(spark, sf_dir):
    """A box that holds two or more others is replaced by them; parts after the first get derived track ids."""
    a, b = geo.box("o_"), geo.box()
    held = frame_pairs(spark, sf_dir).filter((geo.area(geo.box()) > geo.area(geo.box("o_"))) & (geo.containment(a, b) >= 0.8))
    by = Window.partitionBy("det_id")
    parts = held.withColumn("part", F.row_number().over(by.orderBy("o_det_id")) - 1).withColumn("m", F.count(F.lit(1)).over(by)).filter("m >= 2")
    tracks = seen(spark, sf_dir).select("det_id", "track_id")
    shift = F.when(F.col("part") > 0, 100000 * (F.col("part") + 1)).otherwise(0)
    return parts.join(tracks, "det_id").select(F.col("det_id").alias("outer_id"), F.col("o_det_id").alias("inner_id"), "part", (F.col("track_id") + shift).alias("derived_track"))


@query(f"WITH {D}, t AS (SELECT run_id, cam, track_id, count(*) AS n FROM d WHERE track_id IS NOT NULL GROUP BY ALL) SELECT cam, count(*) AS tracks, round(avg(n), 6) AS mean, count(*) FILTER (n >= 5) AS at_least_5, count(*) FILTER (n < 3) AS under_3 FROM t GROUP BY cam")
def track_lengths(spark, sf_dir):
    t = seen(spark, sf_dir).filter("track_id is not null").groupBy("run_id", "cam", "track_id").agg(F.count(F.lit(1)).alias("n"))
    return t.groupBy("cam").agg(F.count(F.lit(1)).alias("tracks"), F.round(F.avg("n"), 6).alias("mean"), F.count_if(F.col("n") >= 5).alias("at_least_5"), F.count_if(F.col("n") < 3).alias("under_3"))


@query(
    f"""WITH {D}, {FR}, n AS (SELECT f.run_id, f.cam, f.frame_index, count(d.det_id) AS n FROM f LEFT JOIN d USING (run_id, cam, frame_index) GROUP BY ALL), m AS (SELECT *, max(n) OVER (PARTITION BY run_id, cam) AS top FROM n)
SELECT run_id, cam, sum(n)::BIGINT AS total, round(avg(n), 6) AS mean, quantile_cont(n, 0.5)::DOUBLE AS median, max(n) AS most, count(*) FILTER (n = top) AS frames_at_most, count(*) FILTER (n = 0) AS empty, min(frame_index) FILTER (n = top) AS first_peak FROM m GROUP BY ALL"""
)
def detections_per_frame(spark, sf_dir):
    """Detections of each camera's frames, empty ones included."""
    counts = seen(spark, sf_dir).groupBy("run_id", "cam", "frame_index").agg(F.count(F.lit(1)).alias("n"))
    n = stamped(spark, sf_dir).join(counts, ["run_id", "cam", "frame_index"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    levels = n.groupBy("run_id", "cam", "n").agg(F.count(F.lit(1)).alias("frames"), F.min("frame_index").alias("first"))
    return levels.groupBy("run_id", "cam").agg(
        F.sum(F.col("n") * F.col("frames")).alias("total"), F.round(F.sum(F.col("n") * F.col("frames")) / F.sum("frames"), 6).alias("mean"), F.expr("percentile(n, 0.5D, frames)").alias("median"), F.max("n").alias("most"), F.max_by("frames", "n").alias("frames_at_most"), F.coalesce(F.sum(F.when(F.col("n") == 0, F.col("frames"))), F.lit(0)).alias("empty"), F.max_by("first", "n").alias("first_peak")
    )


@query(f"WITH {D} SELECT run_id, count(*) AS boxes, count(*) FILTER (x1 < 0 OR y1 < 0 OR x2 > {WIDTH} OR y2 > {HEIGHT}) AS out_of_bounds, count(*) FILTER (track_id IS NULL) AS without_track, count(*) FILTER (global_id < 0) AS provisional FROM d GROUP BY run_id")
def audit_boxes(spark, sf_dir):
    out = (F.col("x1") < 0) | (F.col("y1") < 0) | (F.col("x2") > WIDTH) | (F.col("y2") > HEIGHT)
    return seen(spark, sf_dir).groupBy("run_id").agg(F.count(F.lit(1)).alias("boxes"), F.count_if(out).alias("out_of_bounds"), F.count_if(F.col("track_id").isNull()).alias("without_track"), F.count_if(F.col("global_id") < 0).alias("provisional"))


@query(f"WITH {D}, t AS (SELECT run_id, cam, track_id, count(DISTINCT global_id) AS ids FROM d WHERE track_id IS NOT NULL GROUP BY ALL) SELECT run_id, count(*) AS tracks, count(*) FILTER (ids > 1) AS with_several, count(*) FILTER (ids = 0) AS with_none FROM t GROUP BY run_id")
def audit_tracks(spark, sf_dir):
    t = seen(spark, sf_dir).filter("track_id is not null").groupBy("run_id", "cam", "track_id").agg(F.countDistinct("global_id").alias("ids"))
    return t.groupBy("run_id").agg(F.count(F.lit(1)).alias("tracks"), F.count_if(F.col("ids") > 1).alias("with_several"), F.count_if(F.col("ids") == 0).alias("with_none"))


@query(
    f"""WITH {D}, s AS (SELECT DISTINCT run_id, cam, frame_index, track_id FROM d WHERE track_id IS NOT NULL) SELECT DISTINCT x.run_id, x.cam, x.track_id AS track_a, y.track_id AS track_b FROM s x JOIN s y ON x.run_id = y.run_id AND x.cam = y.cam AND x.frame_index = y.frame_index AND x.track_id < y.track_id"""
)
def cooccurrence_pairs(spark, sf_dir):
    """Tracks seen in one frame: proven to be different people."""
    s = seen(spark, sf_dir).filter("track_id is not null").select("run_id", "cam", "frame_index", "track_id").distinct()
    other = s.withColumnRenamed("track_id", "track_b")
    return s.join(other, ["run_id", "cam", "frame_index"]).filter("track_id < track_b").select("run_id", "cam", F.col("track_id").alias("track_a"), "track_b").distinct()


@query(
    f"""WITH {D}, x AS (SELECT *, CASE WHEN track_id IS NOT NULL THEN '  ID' || track_id ELSE '' END AS own, coalesce(' (' || reid_score::DECIMAL(20,10)::DECIMAL(20,2)::VARCHAR || ')', '') AS suffix, confidence::DECIMAL(20,10)::DECIMAL(20,2)::VARCHAR AS c FROM d)
SELECT det_id, coalesce(((coalesce(reid_id, global_id) % 8) + 8) % 8, -1)::INTEGER AS colour, CASE WHEN coalesce(reid_id, global_id) < 0 THEN 'REID ...' || own WHEN reid_id IS NOT NULL THEN 'REID ' || reid_id || suffix || own WHEN global_id IS NOT NULL THEN 'GID ' || global_id || own WHEN track_id IS NOT NULL THEN 'ID ' || track_id || '  ' || c ELSE 'person ' || c END AS label FROM x"""
)
def palette(spark, sf_dir):
    rows = latest(table(spark, sf_dir, "detections"), ["det_id"], "ingested_at", ["reid_id", "reid_score", "global_id", "track_id", "confidence"])
    label = scoring.display_label(*[F.col(c) for c in ("reid_id", "reid_score", "global_id", "track_id", "confidence")])
    return rows.select("det_id", scoring.palette_index(F.coalesce("reid_id", "global_id")).alias("colour"), label.alias("label"))


_TOGETHER = D + """, s AS (SELECT DISTINCT run_id, cam, frame_index, track_id FROM d WHERE track_id IS NOT NULL), tl AS (SELECT run_id, cam, track_id, count(*) AS n FROM s GROUP BY ALL HAVING count(*) >= 3),
tg AS (SELECT x.run_id, x.cam, x.track_id AS track_a, y.track_id AS track_b FROM s x JOIN s y ON x.run_id = y.run_id AND x.cam = y.cam AND x.frame_index = y.frame_index AND x.track_id < y.track_id GROUP BY ALL)"""


@query(f"WITH {_TOGETHER} SELECT x.run_id, x.cam, x.track_id, count(y.track_id) - count(tg.track_b) AS maybe_same, count(tg.track_b) AS different FROM tl x LEFT JOIN tl y ON x.run_id = y.run_id AND x.cam = y.cam AND x.track_id <> y.track_id LEFT JOIN tg ON tg.run_id = x.run_id AND tg.cam = x.cam AND tg.track_a = least(x.track_id, y.track_id) AND tg.track_b = greatest(x.track_id, y.track_id) GROUP BY ALL")
def distinct_partners(spark, sf_dir):
    """Of each track of three frames or more, the tracks of its camera proven different by a common frame, and the complement; pairs are counted, not listed."""
    s = seen(spark, sf_dir).filter("track_id is not null").select("run_id", "cam", "frame_index", "track_id").distinct()
    long = s.groupBy("run_id", "cam", "track_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3").drop("n")
    kept = s.join(long, ["run_id", "cam", "track_id"])
    other = kept.withColumnRenamed("track_id", "other")
    met = kept.join(other, ["run_id", "cam", "frame_index"]).filter("track_id <> other").groupBy("run_id", "cam", "track_id").agg(F.countDistinct("other").alias("different"))
    total = long.groupBy("run_id", "cam").agg(F.count(F.lit(1)).alias("all_tracks"))
    out = long.join(total, ["run_id", "cam"]).join(met, ["run_id", "cam", "track_id"], "left").withColumn("different", F.coalesce("different", F.lit(0)))
    return out.select("run_id", "cam", "track_id", (F.col("all_tracks") - 1 - F.col("different")).alias("maybe_same"), "different")


@query(f"WITH {FR} SELECT run_id, cam, epoch_us(ts) // 1000000 AS tick, max(frame_index) AS frame_index, count(*) - 1 AS dropped FROM f GROUP BY ALL")
def newest_slot(spark, sf_dir):
    """The newest frame of each camera and second; the others were overwritten."""
    return stamped(spark, sf_dir).groupBy("run_id", "cam", F.floor(F.unix_micros("ts") / 1_000_000).alias("tick")).agg(F.max("frame_index").alias("frame_index"), (F.count(F.lit(1)) - 1).alias("dropped"))


@query(f"WITH {FR} SELECT run_id, cam, epoch_us(ts) // 60000000 AS tick, frame_index FROM f QUALIFY row_number() OVER (PARTITION BY run_id, cam, epoch_us(ts) // 60000000 ORDER BY frame_index DESC) <= 16")
def drop_oldest(spark, sf_dir):
    """What a queue of 16 keeps of each camera and minute."""
    rows = stamped(spark, sf_dir).withColumn("tick", F.floor(F.unix_micros("ts") / 60_000_000))
    place = F.row_number().over(Window.partitionBy("run_id", "cam", "tick").orderBy(F.desc("frame_index")))
    return rows.withColumn("place", place).filter("place <= 16").select("run_id", "cam", "tick", "frame_index")


@query(
    f"""WITH {FR}, r AS (SELECT *, date_trunc('minute', ts) AS tick, row_number() OVER (PARTITION BY run_id, date_trunc('minute', ts), cam ORDER BY frame_index) AS turn FROM f)
SELECT run_id, cam, frame_index, row_number() OVER (PARTITION BY run_id, tick ORDER BY turn, cam) AS place FROM r"""
)
def fair_round_robin(spark, sf_dir):
    """Order of frames of a minute when the cameras take turns."""
    rows = stamped(spark, sf_dir).withColumn("tick", F.date_trunc("minute", "ts"))
    turn = F.row_number().over(Window.partitionBy("run_id", "tick", "cam").orderBy("frame_index"))
    place = F.row_number().over(Window.partitionBy("run_id", "tick").orderBy("turn", "cam"))
    return rows.withColumn("turn", turn).withColumn("place", place.cast("long")).select("run_id", "cam", "frame_index", "place")


@query("WITH k AS (SELECT *, epoch_ms(received_at) - epoch_ms(ts) AS age FROM frames WHERE ts IS NOT NULL) SELECT run_id, cam, count(*) AS frames, count(*) FILTER (age > 100) AS stale FROM k GROUP BY ALL")
def staleness(spark, sf_dir):
    """Frames older than 100 ms when they came in."""
    age = F.unix_millis("received_at") - F.unix_millis("ts")
    return table(spark, sf_dir, "frames").filter("ts is not null").groupBy("run_id", "cam").agg(F.count(F.lit(1)).alias("frames"), F.count_if(age > 100).alias("stale"))


@query(f"WITH {D} SELECT det_id FROM d WHERE track_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id, cam, track_id ORDER BY frame_index, det_id) % 5 = 0")
def sample_stride(spark, sf_dir):
    """Every fifth observation of a track is stored."""
    place = F.row_number().over(Window.partitionBy("run_id", "cam", "track_id").orderBy("frame_index", "det_id"))
    return seen(spark, sf_dir).filter("track_id is not null").withColumn("place", place).filter("place % 5 = 0").select("det_id")


@query(f"WITH {FR}, g AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY run_id, cam ORDER BY ts, frame_index)) AS gap FROM f) SELECT run_id, cam, count(*) FILTER (gap > 10000000) AS offline, coalesce(max(gap), 0) AS longest_us FROM g GROUP BY ALL")
def offline_gaps(spark, sf_dir):
    """Times without a frame of more than ten seconds."""
    us = F.unix_micros("ts")
    gap = us - F.lag(us).over(Window.partitionBy("run_id", "cam").orderBy("ts", "frame_index"))
    return stamped(spark, sf_dir).withColumn("gap", gap).groupBy("run_id", "cam").agg(F.count_if(F.col("gap") > 10_000_000).alias("offline"), F.coalesce(F.max("gap"), F.lit(0)).alias("longest_us"))


@query(
    f"""WITH {FR}, s AS (SELECT run_id, cam, epoch_us(date_trunc('second', ts)) // 1000000 AS tick, max(frame_index) AS fi FROM f GROUP BY ALL), b AS (SELECT run_id, cam, min(tick) AS lo, max(tick) AS hi FROM s GROUP BY ALL), g AS (SELECT run_id, cam, unnest(range(lo, hi + 1)) AS tick FROM b)
SELECT g.run_id, g.cam, g.tick, last_value(fi IGNORE NULLS) OVER (PARTITION BY g.run_id, g.cam ORDER BY g.tick) AS frame_index, fi IS NULL AS repeated FROM g LEFT JOIN s USING (run_id, cam, tick)"""
)
def tick_fill(spark, sf_dir):
    """The newest frame at each second of a camera's time, repeated where none came."""
    s = stamped(spark, sf_dir).groupBy("run_id", "cam", F.floor(F.unix_micros("ts") / 1_000_000).alias("tick")).agg(F.max("frame_index").alias("fi"))
    grid = s.groupBy("run_id", "cam").agg(F.min("tick").alias("lo"), F.max("tick").alias("hi")).select("run_id", "cam", F.explode(F.sequence("lo", "hi")).alias("tick"))
    filled = F.last_value("fi", True).over(Window.partitionBy("run_id", "cam").orderBy("tick"))
    return grid.join(s, ["run_id", "cam", "tick"], "left").select("run_id", "cam", "tick", filled.alias("frame_index"), F.col("fi").isNull().alias("repeated"))


@query(f"WITH {FR}, k AS (SELECT run_id, cam, count(*) AS frames, max(frame_index) - min(frame_index) + 1 AS span, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds FROM f GROUP BY ALL) SELECT run_id, cam, frames, round(frames / nullif(seconds, 0), 6) AS fps, round(100.0 * (span - frames) / span, 6)::DOUBLE AS drop_pct, round(seconds, 6) AS seconds FROM k")
def timeline(spark, sf_dir):
    """Frame rate, dropped share and duration of each camera."""
    seconds = (F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / 1e6
    span = F.max("frame_index") - F.min("frame_index") + 1
    n = F.count(F.lit(1))
    return stamped(spark, sf_dir).groupBy("run_id", "cam").agg(n.alias("frames"), F.round(n / F.nullif(seconds, F.lit(0)), 6).alias("fps"), F.round(100.0 * (span - n) / span, 6).alias("drop_pct"), F.round(seconds, 6).alias("seconds"))


_WAYS = """e AS (SELECT cam_a AS a, cam_b AS b, greatest(0, min_transit_sec) AS s FROM topology UNION ALL SELECT cam_b, cam_a, greatest(0, min_transit_sec) FROM topology), m AS (SELECT a, b, min(s) AS s FROM e GROUP BY ALL), c AS (SELECT DISTINCT a AS x FROM m),
w AS (SELECT x AS a, x AS b, 0.0::DOUBLE AS s, [x] AS way FROM c UNION ALL SELECT w.a, m.b, w.s + m.s, list_append(way, m.b) FROM w JOIN m ON w.b = m.a WHERE NOT list_contains(way, m.b) AND len(way) < 9),
ways AS (SELECT p.x AS cam_a, q.x AS cam_b, round(min(s), 6) AS seconds FROM c p CROSS JOIN c q LEFT JOIN w ON w.a = p.x AND w.b = q.x GROUP BY ALL)"""


@query(f"WITH RECURSIVE {_WAYS} SELECT * FROM ways")
def topology_all_pairs(spark, sf_dir):
    return shortest_transits(table(spark, sf_dir, "topology")).withColumn("seconds", F.round("seconds", 6))


@query(
    f"""WITH RECURSIVE {_WAYS}, {OBS}, {FR}, tm AS (SELECT obs.run_id, gid, obs.cam, epoch_us(ts) AS us, det_id FROM obs JOIN f ON f.run_id = obs.run_id AND f.cam = obs.cam AND f.frame_index = obs.frame_index WHERE gid > 0),
mv AS (SELECT cam, lag(cam) OVER o AS from_cam, (us - lag(us) OVER o) / 1e6 AS gap FROM tm WINDOW o AS (PARTITION BY run_id, gid ORDER BY us, det_id))
SELECT from_cam, cam, count(*) AS moves, count(*) FILTER (cam_a IS NOT NULL AND (seconds IS NULL OR greatest(0, gap) < seconds)) AS vetoed FROM mv LEFT JOIN ways ON cam_a = from_cam AND cam_b = cam WHERE from_cam <> cam GROUP BY from_cam, cam"""
)
def topology_veto(spark, sf_dir):
    """Moves of an identity from camera to camera that are too fast for the site."""
    from sightweave.plans.identity import obs

    timed = obs(spark, sf_dir).filter("gid > 0").join(stamped(spark, sf_dir), ["run_id", "cam", "frame_index"]).select("run_id", "gid", "cam", F.unix_micros("ts").alias("us"), "det_id")
    by = Window.partitionBy("run_id", "gid").orderBy("us", "det_id")
    moves = timed.withColumn("from_cam", F.lag("cam").over(by)).withColumn("gap", (F.col("us") - F.lag("us").over(by)) / 1e6).filter("from_cam <> cam")
    return with_transit(moves, shortest_transits(table(spark, sf_dir, "topology")), "from_cam", "cam", F.col("gap")).groupBy("from_cam", "cam").agg(F.count(F.lit(1)).alias("moves"), F.count_if(~F.col("allowed")).alias("vetoed"))


@query(
    f"""WITH {D}, {FR}, k AS (SELECT d.run_id, d.global_id AS gid, d.cam, epoch_us(f.ts) AS us, d.det_id FROM d JOIN f USING (run_id, cam, frame_index) WHERE d.global_id > 0)
SELECT det_id, last_value(CASE WHEN cam IS NOT NULL THEN cam END IGNORE NULLS) OVER (PARTITION BY run_id, gid ORDER BY us, det_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_cam FROM k"""
)
def last_seen_asof(spark, sf_dir):
    """The camera in which an identity was seen last before each detection."""
    timed = seen(spark, sf_dir).filter("global_id > 0").join(stamped(spark, sf_dir), ["run_id", "cam", "frame_index"]).select("det_id", "run_id", "global_id", "cam", F.unix_micros("ts").alias("us"))
    return timed.select("det_id", F.lag("cam").over(Window.partitionBy("run_id", "global_id").orderBy("us", "det_id")).alias("last_cam"))
