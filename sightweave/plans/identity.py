"""Queries on tracklets and identities, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightweave.config import ReconcileConfig
from sightweave.functions.vectors import dot
from sightweave.operators import reconcile as rec
from sightweave.operators import tracklets as trk
from sightweave.operators.intervals import interval_periods
from sightweave.operators.pairs import similar_pairs
from sightweave.operators.tracklets import KEY
from sightweave.plans.reconcile_sql import reconcile_ctes
from sightweave.session import latest, table

DIM = 128
CFG = ReconcileConfig()


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trk.observations(table(spark, sf_dir, "detections"), DIM)


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections counted once, whatever their vector."""
    columns = ["run_id", "cam", "frame_index", "track_id", "x1", "y1", "x2", "y2", "confidence", "class_id", "global_id", "reid_id", "crop_quality"]
    return latest(table(spark, sf_dir, "detections"), ["det_id"], "ingested_at", columns)


#: SQL of detections counted once (d) and of complete observations (obs: u is the vector at length one).
D = "d AS (SELECT * FROM detections QUALIFY row_number() OVER (PARTITION BY det_id ORDER BY ingested_at DESC) = 1)"
OBS = (
    D
    + """,
o AS (SELECT *, coalesce(reid_id, global_id) AS gid, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM d
  WHERE track_id IS NOT NULL AND len(embedding) = 128 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x)))),
obs AS (SELECT det_id, run_id, cam, track_id, frame_index, confidence, gid, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM o WHERE list_dot_product(v, v) > 0),
t AS (SELECT run_id, cam, track_id, min(frame_index) AS first_frame, max(frame_index) AS last_frame, count(*) AS observations FROM obs GROUP BY ALL)"""
)
PROTO = (
    OBS
    + """,
e AS (SELECT run_id, cam, track_id, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM obs),
m AS (SELECT run_id, cam, track_id, i, sum(x) AS x FROM e GROUP BY ALL),
a AS (SELECT run_id, cam, track_id, list(x ORDER BY i) AS w FROM m GROUP BY ALL),
p AS (SELECT a.run_id, a.cam, a.track_id, first_frame, last_frame, observations, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS proto FROM a JOIN t USING (run_id, cam, track_id) WHERE observations >= 3)"""
)
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {OBS} SELECT * FROM t")
def tracklets(spark, sf_dir):
    return trk.tracklets(obs(spark, sf_dir)).drop("gids")


@query(f"WITH {OBS} SELECT *, observations < 3 AS suppressed FROM t")
def tracklet_suppress(spark, sf_dir):
    return trk.tracklets(obs(spark, sf_dir)).drop("gids").withColumn("suppressed", F.col("observations") < CFG.min_observations)


@query(f"WITH {PROTO}, x AS (SELECT run_id, cam, track_id, unnest(proto) AS y, generate_subscripts(proto, 1) - 1 AS pos FROM p) SELECT run_id, cam, track_id, pos::INTEGER AS pos, round(y, 6) AS value FROM x")
def tracklet_prototype(spark, sf_dir):
    rows = trk.with_prototypes(obs(spark, sf_dir), DIM, CFG.min_observations)
    return rows.select(*KEY, F.posexplode("prototype").alias("pos", "value")).withColumn("value", F.round("value", 6))


@query(f"WITH {D} SELECT count(*) AS n, count(*) FILTER (embedding IS NULL) AS missing, count(*) FILTER (len(embedding) <> 128) AS wrong_length, count(*) FILTER (abs(sqrt(list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE))) - 1) <= 0.001) AS unit_length FROM d")
def unit_norm_check(spark, sf_dir):
    from sightweave.functions.vectors import doubles, norm

    rows = latest(table(spark, sf_dir, "detections"), ["det_id"], "ingested_at", ["embedding"])
    e = F.col("embedding")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(e.isNull()).alias("missing"), F.count_if(F.size(e) != DIM).alias("wrong_length"), F.count_if(F.abs(norm(doubles(e)) - 1) <= 0.001).alias("unit_length"))


@query(f"WITH {PROTO} SELECT x.run_id, x.cam, x.track_id AS track_a, y.track_id AS track_b, round(list_dot_product(x.proto, y.proto), 6) AS score FROM p x JOIN p y ON x.run_id = y.run_id AND x.cam = y.cam AND x.track_id < y.track_id AND (x.last_frame < y.first_frame OR y.last_frame < x.first_frame) WHERE list_dot_product(x.proto, y.proto) >= 0.9")
def same_camera_pairs(spark, sf_dir):
    rows = trk.with_prototypes(obs(spark, sf_dir), DIM, CFG.min_observations).withColumn("group", F.concat_ws("|", "run_id", "cam"))
    pairs = similar_pairs(rows, "group", "track_id", "prototype", CFG.same_bar)
    spans = rows.select("group", "run_id", "cam", "track_id", "first_frame", "last_frame")
    a = spans.select("group", "run_id", "cam", F.col("track_id").alias("a"), F.col("first_frame").alias("s1"), F.col("last_frame").alias("e1"))
    b = spans.select("group", F.col("track_id").alias("b"), F.col("first_frame").alias("s2"), F.col("last_frame").alias("e2"))
    free = pairs.join(a, ["group", "a"]).join(b, ["group", "b"]).filter("e1 < s2 or e2 < s1")
    return free.select("run_id", "cam", F.col("a").alias("track_a"), F.col("b").alias("track_b"), F.round("score", 6).alias("score"))


@query(f"WITH {OBS} SELECT x.run_id, x.cam, x.track_id, count(y.track_id) AS conflicts FROM t x LEFT JOIN t y ON x.run_id = y.run_id AND x.cam = y.cam AND x.track_id <> y.track_id AND NOT (x.last_frame < y.first_frame OR y.last_frame < x.first_frame) GROUP BY ALL")
def conflict_counts(spark, sf_dir):
    """Tracks of the same camera whose spans collide, counted by ranks of starts and ends instead of pairs."""
    t = trk.tracklets(obs(spark, sf_dir))
    marks = t.select("run_id", "cam", "track_id", F.explode(F.array(F.struct(F.col("first_frame").alias("at"), F.lit("start").alias("what")), F.struct(F.col("last_frame").alias("at"), F.lit("end").alias("what")))).alias("m")).select("run_id", "cam", "track_id", "m.at", "m.what")
    by = Window.partitionBy("run_id", "cam").orderBy("at")
    ended = F.count_if(F.col("what") == "end").over(by.rangeBetween(Window.unboundedPreceding, -1))
    started = F.count_if(F.col("what") == "start").over(by.rangeBetween(1, Window.unboundedFollowing))
    total = F.count_if(F.col("what") == "start").over(Window.partitionBy("run_id", "cam"))
    counted = marks.withColumn("ended", ended).withColumn("started", started).withColumn("total", total)
    return counted.groupBy("run_id", "cam", "track_id").agg((F.first("total") - 1 - F.max(F.when(F.col("what") == "start", F.col("ended"))) - F.max(F.when(F.col("what") == "end", F.col("started")))).alias("conflicts"))


_ROUND1 = (
    PROTO
    + """,
k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY cam, track_id) - 1 AS key FROM p),
edge AS (SELECT x.run_id, x.key AS a, y.key AS b, list_dot_product(x.proto, y.proto) AS score FROM k x JOIN k y ON x.run_id = y.run_id AND x.key < y.key AND x.cam <> y.cam WHERE list_dot_product(x.proto, y.proto) >= 0.7),
both_ AS (SELECT run_id, a AS me, b AS partner, score FROM edge UNION ALL SELECT run_id, b, a, score FROM edge),
best AS (SELECT * FROM both_ QUALIFY row_number() OVER (PARTITION BY run_id, me ORDER BY score DESC, partner DESC) = 1)"""
)


def _single(spark, sf_dir):
    """Each tracklet as a cluster of its own."""
    kept = trk.with_prototypes(obs(spark, sf_dir), DIM, CFG.min_observations)
    key = (F.row_number().over(Window.partitionBy("run_id").orderBy("cam", "track_id")) - 1).cast("long")
    return kept.withColumn("key", key).withColumn("root", F.col("key"))


@query(f"WITH {_ROUND1} SELECT run_id, a, b, round(score, 6) AS score FROM edge")
def cross_round1_edges(spark, sf_dir):
    return rec.candidate_edges(_single(spark, sf_dir), CFG, DIM).select("run_id", "a", "b", F.round("score", 6).alias("score"))


@query(f"WITH {_ROUND1} SELECT x.run_id, x.me AS a, x.partner AS b, round(x.score, 6) AS score FROM best x JOIN best y ON x.run_id = y.run_id AND x.partner = y.me AND y.partner = x.me AND x.me < x.partner")
def reciprocal_best(spark, sf_dir):
    best = rec.best_partners(rec.candidate_edges(_single(spark, sf_dir), CFG, DIM))
    return rec.mutual(best).select("run_id", "a", "b", F.round("score", 6).alias("score"))


_FINAL = reconcile_ctes(PROTO, CFG.same_bar, CFG.cross_bar)


@query(f"{_FINAL} SELECT * FROM ri")
def reconcile_identities(spark, sf_dir):
    return rec.reconcile(obs(spark, sf_dir), CFG, DIM)


@query(f"{_FINAL} SELECT run_id, identity, count(DISTINCT cam) AS cameras, count(*) AS tracks, sum(observations)::BIGINT AS observations FROM ri WHERE identity IS NOT NULL GROUP BY ALL HAVING count(DISTINCT cam) > 1")
def cross_camera_people(spark, sf_dir):
    """Identities seen in more than one camera, with their tracks."""
    ids = rec.reconcile(obs(spark, sf_dir), CFG, DIM).filter("identity is not null")
    people = ids.groupBy("run_id", "identity").agg(F.countDistinct("cam").alias("cameras"), F.count(F.lit(1)).alias("tracks"), F.sum("observations").alias("observations"))
    return people.filter("cameras > 1")


@query(f"{_FINAL} SELECT * FROM ri")
def reconcile_rounds(spark, sf_dir):
    """The same by joined rounds for every run, however small."""
    return rec.reconcile(obs(spark, sf_dir), CFG, DIM, run_limit=0)


_KEYED = PROTO + ", k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY cam, track_id) - 1 AS key FROM p)"


def _audit_sql(phase: str, listed: bool) -> str:
    """Audit records, or their candidates, of tracklets that are clusters of their own."""
    same = phase == "same_camera"
    letter, bar, near = ("U", 0.9, "AND x.cam = y.cam") if same else ("C", 0.7, "")
    apart = "" if same else "WHEN x.cam = y.cam THEN 'NOT_MERGEABLE_CROSS'"
    handle = lambda key: f"'{letter}-' || lpad({key}::VARCHAR, 4, '0')"
    sql = f"""WITH {_KEYED}, q AS (SELECT x.run_id, x.key AS me, y.key AS you, x.cam AS cam, x.observations AS mine, y.observations AS theirs, list_dot_product(x.proto, y.proto) AS s,
  CASE WHEN x.cam = y.cam AND NOT (x.last_frame < y.first_frame OR y.last_frame < x.first_frame) THEN 'TEMPORAL_CONFLICT_SAME_CAMERA' {apart} WHEN list_dot_product(x.proto, y.proto) < {bar} THEN 'BELOW_ABSOLUTE_THRESHOLD' END AS why FROM k x JOIN k y ON x.run_id = y.run_id AND x.key <> y.key {near}),
b AS (SELECT * FROM q WHERE why IS NULL QUALIFY row_number() OVER (PARTITION BY run_id, me ORDER BY s DESC, you DESC) = 1),
ab AS (SELECT *, row_number() OVER (PARTITION BY run_id, me ORDER BY s DESC, you) AS r FROM q WHERE why IS NULL), g AS (SELECT run_id, me, max(s) FILTER (r = 1) - max(s) FILTER (r = 2) AS margin FROM ab GROUP BY ALL)"""
    if listed:
        return (
            sql
            + f""", od AS (SELECT *, row_number() OVER (PARTITION BY run_id, me ORDER BY s DESC, you) AS place FROM q)
SELECT o.run_id, {handle("o.me")} AS subject, {handle("o.you")} AS handle, o.place::INTEGER - 1 AS pos, round(o.s, 6) AS score, o.why AS excluded_by, CASE WHEN o.why IS NULL THEN c.you IS DISTINCT FROM o.me END AS would_fail_reciprocity, 1 AS cluster_size, o.theirs AS observations, round(CASE WHEN b.you = o.you THEN 1 ELSE list_dot_product(kb.proto, ky.proto) END, 6) AS pair_similarity_to_best
FROM od o LEFT JOIN b ON b.run_id = o.run_id AND b.me = o.me LEFT JOIN b c ON c.run_id = o.run_id AND c.me = o.you LEFT JOIN k kb ON kb.run_id = o.run_id AND kb.key = b.you LEFT JOIN k ky ON ky.run_id = o.run_id AND ky.key = o.you WHERE o.place <= 200"""
        )
    lost = "" if same else "WHEN c.you IS DISTINCT FROM x.me THEN ['RECIPROCAL_BEST']"
    return (
        sql
        + f""", x AS (SELECT run_id, me, any_value(cam) AS cam, any_value(mine) AS observations, count(*) AS scored_count, count(*) FILTER (why IS NULL) AS eligible_count FROM q GROUP BY ALL)
SELECT x.run_id, {handle("x.me")} AS handle, '{phase}' AS phase, x.observations, [x.cam] AS cameras, CASE WHEN b.you IS NULL THEN ['ABSOLUTE_THRESHOLD'] {lost} ELSE [] END AS gates_failed, {handle("b.you")} AS best_handle, round(b.s, 6) AS best_score, round(g.margin, 6) AS margin_eligible, scored_count > 200 AS candidates_truncated, scored_count, eligible_count
FROM x LEFT JOIN b ON b.run_id = x.run_id AND b.me = x.me LEFT JOIN b c ON c.run_id = x.run_id AND c.me = b.you LEFT JOIN g ON g.run_id = x.run_id AND g.me = x.me"""
    )


def _candidates(records: DataFrame) -> DataFrame:
    """One row for each listed candidate of audit records."""
    rows = records.select("run_id", F.col("handle").alias("subject"), F.posexplode("candidates").alias("pos", "c"))
    return rows.select("run_id", "subject", "pos", "c.*")


@query(_audit_sql("same_camera", True))
def audit_candidates_same_camera(spark, sf_dir):
    """The candidates of the records of audit_same_camera, a row each."""
    from sightweave.operators.audit import audit

    return _candidates(audit(_single(spark, sf_dir), CFG, "same_camera"))


@query(_audit_sql("cross_camera", True))
def audit_candidates_cross_camera(spark, sf_dir):
    """The candidates of the records of audit_cross_camera, a row each."""
    from sightweave.operators.audit import audit

    return _candidates(audit(_single(spark, sf_dir), CFG, "cross_camera"))


@query(_audit_sql("same_camera", False))
def audit_same_camera(spark, sf_dir):
    """Every tracklet's candidates in its camera, as the first phase sees them."""
    from sightweave.operators.audit import audit

    return audit(_single(spark, sf_dir), CFG, "same_camera").drop("candidates")


@query(_audit_sql("cross_camera", False))
def audit_cross_camera(spark, sf_dir):
    """Every tracklet's candidates over cameras in the first round."""
    from sightweave.operators.audit import audit

    return audit(_single(spark, sf_dir), CFG, "cross_camera").drop("candidates")


@query(f"WITH {OBS} SELECT run_id, cam, track_id, 'suppressed' AS phase, observations FROM t WHERE observations < 3")
def suppressed_records(spark, sf_dir):
    from sightweave.operators.audit import suppressed_records as records

    return records(trk.tracklets(obs(spark, sf_dir)), CFG).drop("gates_failed")


GRID = {f"same {same:.2f} cross {cross:.2f}": (same, cross) for same, cross in ((0.90, 0.63), (0.90, 0.70), (0.90, 0.75), (0.90, 0.80), (0.85, 0.70))}


def _shape_sql(name: str, same: float, cross: float) -> str:
    sums = "count(ms) AS m, count(*) FILTER (ms < 0.661) AS low, min(ms) AS least"
    return f"""SELECT * FROM ({reconcile_ctes(PROTO, same, cross)} SELECT '{name}' AS setting, run_id, count(*) AS identities, max(n) AS largest, count(*) FILTER (cams > 1) AS multi_camera, sum(m)::BIGINT AS cross_merges, sum(low)::BIGINT AS below_ceiling, round(min(least), 6) AS least_score
FROM (SELECT f.run_id, f.root, count(*) AS n, count(DISTINCT k.cam) AS cams, {sums} FROM final f JOIN k ON k.run_id = f.run_id AND k.key = f.key GROUP BY f.run_id, f.root) GROUP BY run_id)"""


@query(" UNION ALL ".join(_shape_sql(name, *bars) for name, bars in GRID.items()))
def sweep_grid(spark, sf_dir):
    """The shape of the clusters over a grid of bars."""
    from dataclasses import replace

    return rec.sweep(obs(spark, sf_dir), {name: replace(CFG, same_bar=same, cross_bar=cross) for name, (same, cross) in GRID.items()}, DIM)


@query()
def sweep_modes(spark, sf_dir):
    """The same for each way of scoring, with a camera of its own bar."""
    from dataclasses import replace

    from sightweave.session import cut

    settings = {mode: replace(CFG, scoring=mode) for mode in ("prototype", "max_exemplar", "consensus")} | {"cam_01 0.80": replace(CFG, bars={"cam_01": 0.80})}
    return rec.sweep(cut(obs(spark, sf_dir)), settings, DIM)


@query(f"{_FINAL} SELECT det_id, d.run_id, d.cam, d.track_id, d.frame_index, ri.identity AS final_id FROM d LEFT JOIN ri ON ri.run_id = d.run_id AND ri.cam = d.cam AND ri.track_id = d.track_id WHERE d.track_id IS NOT NULL")
def relabel(spark, sf_dir):
    ids = rec.reconcile(obs(spark, sf_dir), CFG, DIM)
    boxes = seen(spark, sf_dir).filter("track_id is not null").select("det_id", *KEY, "frame_index")
    return rec.relabel(boxes, ids)


@query(f"WITH {OBS}, c AS (SELECT run_id, cam, track_id, gid, count(*) AS n FROM obs WHERE gid IS NOT NULL GROUP BY ALL) SELECT run_id, cam, track_id, gid AS final_id, n FROM c QUALIFY row_number() OVER (PARTITION BY run_id, cam, track_id ORDER BY n DESC, gid) = 1")
def final_id_mode(spark, sf_dir):
    return trk.final_ids(obs(spark, sf_dir))


@query(f"WITH {OBS} SELECT run_id, cam, count(*) AS observations, count(DISTINCT gid) AS identities, count(DISTINCT track_id) AS tracks FROM obs GROUP BY ALL")
def run_summary(spark, sf_dir):
    return obs(spark, sf_dir).groupBy("run_id", "cam").agg(F.count(F.lit(1)).alias("observations"), F.countDistinct("gid").alias("identities"), F.countDistinct("track_id").alias("tracks"))


@query(f"WITH {D} SELECT run_id, count(*) AS detections, row_number() OVER (ORDER BY run_id DESC) = 1 AS latest FROM d GROUP BY run_id")
def available_runs(spark, sf_dir):
    runs = seen(spark, sf_dir).groupBy("run_id").agg(F.count(F.lit(1)).alias("detections"))
    return runs.crossJoin(F.broadcast(runs.agg(F.max("run_id").alias("last")))).select("run_id", "detections", (F.col("run_id") == F.col("last")).alias("latest"))


@query(
    f"""WITH {OBS}, f AS (SELECT DISTINCT run_id, gid, cam, frame_index AS a FROM obs WHERE gid IS NOT NULL),
i AS (SELECT *, sum(CASE WHEN a - before <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY run_id, gid, cam ORDER BY a) AS island FROM (SELECT *, lag(a) OVER (PARTITION BY run_id, gid, cam ORDER BY a) AS before FROM f))
SELECT run_id, gid, cam, min(a) AS period_from, max(a) AS period_to FROM i GROUP BY run_id, gid, cam, island"""
)
def spans_islands(spark, sf_dir):
    return interval_periods(obs(spark, sf_dir).filter("gid is not null"), ["run_id", "gid", "cam"], "frame_index", "frame_index", 1)


@query(f"WITH {OBS} SELECT run_id, gid, cam AS primary_cam, n AS frames FROM (SELECT run_id, gid, cam, count(DISTINCT frame_index) AS n FROM obs WHERE gid IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY run_id, gid ORDER BY n DESC, cam) = 1")
def primary_camera(spark, sf_dir):
    counts = obs(spark, sf_dir).filter("gid is not null").groupBy("run_id", "gid", "cam").agg(F.countDistinct("frame_index").alias("frames"))
    return counts.groupBy("run_id", "gid").agg(F.min(F.struct((-F.col("frames")).alias("m"), "cam")).alias("x")).select("run_id", "gid", F.col("x.cam").alias("primary_cam"), (-F.col("x.m")).alias("frames"))


@query(f"WITH {OBS} SELECT gid, run_id, cam, frame_index FROM obs WHERE gid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY gid ORDER BY run_id DESC, frame_index DESC, cam DESC) = 1")
def warm_start_last_seen(spark, sf_dir):
    last = obs(spark, sf_dir).filter("gid is not null").groupBy("gid").agg(F.max(F.struct("run_id", "frame_index", "cam")).alias("x"))
    return last.select("gid", "x.run_id", "x.cam", "x.frame_index")


@query(f"WITH {OBS} SELECT run_id, gid, det_id, (row_number() OVER (PARTITION BY run_id, gid ORDER BY frame_index DESC, det_id DESC))::INTEGER AS place FROM obs WHERE gid IS NOT NULL QUALIFY place <= 20")
def bank_last_n(spark, sf_dir):
    """The last 20 observations of each identity."""
    place = F.row_number().over(Window.partitionBy("run_id", "gid").orderBy(F.desc("frame_index"), F.desc("det_id")))
    return obs(spark, sf_dir).filter("gid is not null").select("run_id", "gid", "det_id", place.alias("place")).filter("place <= 20")


@query(f"WITH {OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id, cam, track_id ORDER BY frame_index, det_id) - 1 AS i, count(*) OVER (PARTITION BY run_id, cam, track_id) AS n FROM obs), j AS (SELECT unnest(range(64)) AS j) SELECT DISTINCT run_id, cam, track_id, det_id FROM r, j WHERE n <= 64 OR i = round_even(j * ((n - 1) / 63.0), 0)::BIGINT")
def even_subsample(spark, sf_dir):
    return trk.even_rows(obs(spark, sf_dir), KEY, ["frame_index", "det_id"], CFG.cap).select(*KEY, "det_id")


@query(f"WITH {OBS} SELECT det_id, round(list_dot_product(u, lag(u) OVER (PARTITION BY run_id, cam, track_id ORDER BY frame_index, det_id)), 6) AS drift FROM obs")
def drift_lag(spark, sf_dir):
    before = F.lag("unit_vector").over(Window.partitionBy(*KEY).orderBy("frame_index", "det_id"))
    return obs(spark, sf_dir).withColumn("before", before).select("det_id", F.round(dot(F.col("unit_vector"), F.col("before")), 6).alias("drift"))


@query(f"WITH {PROTO} SELECT run_id, cam, track_id, round(avg(list_dot_product(u, proto)), 6) AS consistency, round(avg(1 - list_dot_product(u, proto)), 6) AS variance FROM obs JOIN p USING (run_id, cam, track_id) GROUP BY ALL")
def tracklet_consistency(spark, sf_dir):
    o = obs(spark, sf_dir)
    near = o.join(trk.with_prototypes(o, DIM, CFG.min_observations).select(*KEY, "prototype"), KEY).select(*KEY, dot(F.col("unit_vector"), F.col("prototype")).alias("c"))
    return near.groupBy(*KEY).agg(F.round(F.avg("c"), 6).alias("consistency"), F.round(F.avg(1 - F.col("c")), 6).alias("variance"))
