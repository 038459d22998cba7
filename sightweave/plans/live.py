"""Queries on the live engine and sources."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightweave.functions import scoring
from sightweave.functions.vectors import unit
from sightweave.operators.topology import shortest_transits
from sightweave.plans.frames import stamped
from sightweave.plans.identity import _FINAL, CFG, DIM, D, obs, seen
from sightweave.session import latest, table
from sightweave.streaming import engine, service

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def live_rows(spark, sf_dir):
    """What the live engine sees: tracked detections with their time, vector and quality."""
    columns = ["run_id", "cam", "frame_index", "track_id", "embedding", "crop_quality"]
    rows = latest(table(spark, sf_dir, "detections").withColumn("crop_quality", F.struct("crop_quality.accepted", "crop_quality.blur", "crop_quality.brightness")), ["det_id"], "ingested_at", columns).filter("track_id is not null")
    timed = rows.join(stamped(spark, sf_dir).select("run_id", "cam", "frame_index", "ts"), ["run_id", "cam", "frame_index"])
    vector = F.when(F.size("embedding") == 128, unit(F.col("embedding")))
    q = F.when(F.col("crop_quality.accepted").isNotNull(), F.col("crop_quality"))
    return timed.select("det_id", "run_id", "cam", "track_id", "frame_index", (F.unix_micros("ts") / 1e6).alias("ts"), vector.alias("unit_vector"), scoring.quality_scalar(q).alias("quality"))


@query()
def live_engine_replay(spark, sf_dir):
    transits = {(r[0], r[1]): r[2] for r in shortest_transits(table(spark, sf_dir, "topology")).collect()}
    return engine.replay(live_rows(spark, sf_dir), engine.LiveConfig(), transits)


@query(f"{_FINAL} SELECT run_id, count(*) AS tracklets, count(DISTINCT identity) AS identities, count(*) FILTER (state = 'suppressed') AS suppressed, sum(observations)::BIGINT AS observations FROM ri GROUP BY run_id")
def finalize_runs(spark, sf_dir):
    """The figures of each run when it ends."""
    boxes = seen(spark, sf_dir).filter("track_id is not null").select("det_id", "run_id", "cam", "track_id", "frame_index")
    return engine.finalize(boxes, obs(spark, sf_dir), CFG, DIM)[1]


@query()
def sticky_assign(spark, sf_dir):
    """Observations assigned one by one: tracks keep their identity, new ones are matched or minted."""
    return service.assign(live_rows(spark, sf_dir))


@query()
def match_or_mint_verified(spark, sf_dir):
    """The same with the verifier deciding; what happened to each track's first observation."""
    return service.assign(live_rows(spark, sf_dir), service.AssignConfig(verified=True)).filter("event <> 'sticky'")


@query()
def live_counters(spark, sf_dir):
    """Events of the live engine by run and score bin."""
    return live_engine_replay(spark, sf_dir).groupBy("run_id", "event", scoring.score_bin(F.col("score")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH RECURSIVE {D}, e AS (SELECT run_id, cam, frame_index FROM frames UNION SELECT run_id, cam, frame_index FROM d), t AS (SELECT *, row_number() OVER (PARTITION BY run_id, cam ORDER BY frame_index) AS tick FROM e),
r AS (SELECT det_id, run_id, cam, track_id, tick, coalesce(crop_quality.accepted, false) AS ok, row_number() OVER (PARTITION BY run_id, cam, track_id ORDER BY tick, det_id) AS i FROM d JOIN t USING (run_id, cam, frame_index) WHERE track_id IS NOT NULL),
w AS (SELECT run_id, cam, track_id, i, tick, det_id, ok AS due, CASE WHEN ok THEN 1 ELSE 0 END AS done, CASE WHEN ok THEN tick ELSE 0 END AS last, CASE WHEN ok THEN det_id END AS vec FROM r WHERE i = 1
UNION ALL SELECT run_id, cam, track_id, i, tick, det_id, now, done + now::INTEGER, CASE WHEN now THEN tick ELSE last END, CASE WHEN now THEN det_id ELSE vec END FROM
  (SELECT r.*, CASE WHEN r.tick - 1 - w.tick > 90 THEN 0 ELSE w.done END AS done, CASE WHEN r.tick - 1 - w.tick > 90 THEN 0 ELSE w.last END AS last, CASE WHEN r.tick - 1 - w.tick > 90 THEN NULL ELSE w.vec END AS vec,
    r.ok AND (CASE WHEN r.tick - 1 - w.tick > 90 THEN 0 ELSE w.done END < 3 OR r.tick - CASE WHEN r.tick - 1 - w.tick > 90 THEN 0 ELSE w.last END >= 10) AS now FROM w JOIN r ON r.run_id = w.run_id AND r.cam = w.cam AND r.track_id = w.track_id AND r.i = w.i + 1))
SELECT det_id, due, vec AS vector_of FROM w"""
)
def throttle(spark, sf_dir):
    """Which observations are embedded anew, and whose vector the others carry."""
    rows = seen(spark, sf_dir).withColumn("accepted", F.col("crop_quality.accepted"))
    return engine.throttled(rows, table(spark, sf_dir, "frames"))


@query(f"WITH {D} SELECT det_id, row_number() OVER (PARTITION BY run_id, cam, track_id ORDER BY frame_index, det_id) <= 3 AS warmup FROM d WHERE track_id IS NOT NULL")
def throttle_warmup(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("run_id", "cam", "track_id").orderBy("frame_index", "det_id"))
    return seen(spark, sf_dir).filter("track_id is not null").select("det_id", (place <= 3).alias("warmup"))


@query("WITH s AS (SELECT doc_id, i, x.url AS url FROM (SELECT doc_id, unnest(links) AS x, generate_subscripts(links, 1) AS i FROM documents WHERE links IS NOT NULL)), h AS (SELECT doc_id, i, split_part(split_part(split_part(url, '://', 2), '/', 1), ':', 1) AS host FROM s) SELECT doc_id, i::INTEGER - 1 AS pos, host, row_number() OVER (PARTITION BY host ORDER BY doc_id, i) AS occurrence FROM h")
def source_names(spark, sf_dir):
    """Hosts of sources with the number that makes a repeated name distinct."""
    links = table(spark, sf_dir, "documents").select("doc_id", F.posexplode("links").alias("pos", "x"))
    host = links.select("doc_id", "pos", F.expr("try_parse_url(x.url, 'HOST')").alias("host"))
    return host.withColumn("occurrence", F.row_number().over(Window.partitionBy("host").orderBy("doc_id", "pos")).cast("long"))
