"""Queries on the decision log, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightweave.operators import decision_log as log
from sightweave.operators.ranks import counted, linear_percentiles
from sightweave.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def decs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.decisions(table(spark, sf_dir, "decisions"))


def cands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.candidates(table(spark, sf_dir, "candidates"))


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decs(spark, sf_dir).filter("state <> 'suppressed'")


BASE = """d AS (SELECT * FROM decisions QUALIFY row_number() OVER (PARTITION BY decision_id ORDER BY logged_at DESC) = 1),
live AS (SELECT * FROM d WHERE state <> 'suppressed'),
c AS (SELECT * REPLACE (CASE WHEN score BETWEEN -1 AND 1 THEN score END AS score, CASE WHEN pair_similarity_to_best BETWEEN -1 AND 1 THEN pair_similarity_to_best END AS pair_similarity_to_best)
  FROM candidates QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY logged_at DESC) = 1)"""
MARGIN = (
    BASE
    + """,
el AS (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY score DESC, handle) AS r FROM c WHERE score IS NOT NULL AND excluded_by IS NULL),
b AS (SELECT decision_id, handle AS bh, score AS bs FROM el WHERE r = 1),
s AS (SELECT el.decision_id, arg_min(handle, (-score, handle)) AS sh, max(score) AS ss FROM el JOIN b USING (decision_id) WHERE handle <> bh GROUP BY ALL),
o AS (SELECT c.decision_id, arg_min(handle, (-score, handle)) AS oh, max(score) AS os FROM c LEFT JOIN b USING (decision_id) WHERE score IS NOT NULL AND (excluded_by IS NULL OR excluded_by <> 'BELOW_ABSOLUTE_THRESHOLD') AND (bh IS NULL OR handle <> bh) GROUP BY ALL),
mg AS (SELECT k.decision_id, bh AS best_handle, bs AS best_score, sh AS runner_eligible, oh AS runner_all_scored, round_even(bs - ss, 6) AS margin_eligible, round_even(bs - os, 6) AS margin_all_scored,
  CASE WHEN bh IS NOT NULL THEN sh IS DISTINCT FROM oh END AS runner_up_differs FROM (SELECT DISTINCT decision_id FROM c) k LEFT JOIN b USING (decision_id) LEFT JOIN s USING (decision_id) LEFT JOIN o USING (decision_id))"""
)


@query(f"WITH {MARGIN} SELECT * FROM mg")
def top2_margin(spark, sf_dir):
    return log.top2_margins(cands(spark, sf_dir))


@query(f"WITH {BASE}, g AS (SELECT unnest(gates_failed) AS name FROM d) SELECT e.name, count(g.name) AS n FROM (SELECT unnest({log.GATES}) AS name) e LEFT JOIN g USING (name) GROUP BY ALL")
def gate_failures(spark, sf_dir):
    return log.zero_filled(decs(spark, sf_dir), F.col("gates_failed"), log.GATES)


@query(f"WITH {BASE} SELECT e.name, count(c.excluded_by) AS n FROM (SELECT unnest({log.EXCLUSIONS}) AS name) e LEFT JOIN c ON c.excluded_by = e.name GROUP BY ALL")
def exclusions(spark, sf_dir):
    return log.zero_filled(cands(spark, sf_dir), F.array("excluded_by"), log.EXCLUSIONS)


@query(
    f"""WITH {MARGIN}, x AS (SELECT count(runner_up_differs) AS considered, count(*) FILTER (runner_up_differs) AS differs, count(*) FILTER (runner_up_differs IS NULL) AS no_decision, round(avg(abs(margin_eligible - margin_all_scored)), 4) AS mean_abs_delta FROM mg)
SELECT considered, differs, no_decision, round(coalesce(100.0 * differs / nullif(considered, 0), 0), 2)::DOUBLE AS rate_pct, CASE WHEN considered = 0 THEN 'no margin decisions' WHEN 100.0 * differs / considered < 1 THEN 'not worth maintaining' WHEN 100.0 * differs / considered < 30 THEN 'meaningful choice' ELSE 'constraints reshape the candidates' END AS band, mean_abs_delta FROM x"""
)
def margin_disagreement(spark, sf_dir):
    return log.margin_disagreement(log.top2_margins(cands(spark, sf_dir)))


@query(
    f"""WITH {MARGIN} SELECT accepted_partner IS NOT NULL AS accepted, count(*) AS n, round(quantile_cont(margin_eligible, 0.05), 9) AS p5, round(quantile_cont(margin_eligible, 0.5), 9) AS median, round(quantile_cont(margin_eligible, 0.95), 9) AS p95
FROM live JOIN mg USING (decision_id) WHERE margin_eligible IS NOT NULL GROUP BY ALL"""
)
def accepted_rejected_margins(spark, sf_dir):
    rows = live(spark, sf_dir).join(log.top2_margins(cands(spark, sf_dir)), "decision_id").filter("margin_eligible is not null")
    p = lambda x: F.round(F.percentile("margin_eligible", x), 9)
    return rows.groupBy(F.col("accepted_partner").isNotNull().alias("accepted")).agg(F.count(F.lit(1)).alias("n"), p(0.05).alias("p5"), p(0.5).alias("median"), p(0.95).alias("p95"))


@query(
    """WITH i AS (SELECT run_id, assigned_id, count(*) AS n FROM outcomes WHERE assigned_id IS NOT NULL GROUP BY ALL),
a AS (SELECT run_id, count(*) AS identities, max(n) AS max_tracklets, round(avg(n), 2) AS mean_tracklets FROM i GROUP BY run_id)
SELECT o.run_id, count(*) AS tracklets, count(*) FILTER (state = 'suppressed') AS suppressed, count(*) FILTER (state = 'expired_unresolved') AS unresolved, round(100.0 * coalesce(sum(observations) FILTER (state = 'suppressed'), 0) / sum(observations), 2)::DOUBLE AS suppressed_share_pct,
any_value(identities) AS identities, any_value(max_tracklets) AS max_tracklets, any_value(mean_tracklets) AS mean_tracklets FROM outcomes o LEFT JOIN a ON o.run_id = a.run_id GROUP BY o.run_id"""
)
def fragmentation(spark, sf_dir):
    out = table(spark, sf_dir, "outcomes")
    ids = out.filter("assigned_id is not null").groupBy("run_id", "assigned_id").agg(F.count(F.lit(1)).alias("n"))
    shape = ids.groupBy("run_id").agg(F.count(F.lit(1)).alias("identities"), F.max("n").alias("max_tracklets"), F.round(F.avg("n"), 2).alias("mean_tracklets"))
    lost = F.coalesce(F.sum(F.when(F.col("state") == "suppressed", F.col("observations"))), F.lit(0))
    runs = out.groupBy("run_id").agg(F.count(F.lit(1)).alias("tracklets"), F.count_if(F.col("state") == "suppressed").alias("suppressed"), F.count_if(F.col("state") == "expired_unresolved").alias("unresolved"), F.round(100.0 * lost / F.sum("observations"), 2).alias("suppressed_share_pct"))
    return runs.join(shape, "run_id", "left")


@query("SELECT cam, count(*) AS tracklets, sum(observations)::BIGINT AS total, min(observations) AS least, max(observations) AS most, round(avg(observations), 2) AS mean FROM outcomes GROUP BY cam")
def observations_per_camera(spark, sf_dir):
    o = F.col("observations")
    return table(spark, sf_dir, "outcomes").groupBy("cam").agg(F.count(F.lit(1)).alias("tracklets"), F.sum(o).alias("total"), F.min(o).alias("least"), F.max(o).alias("most"), F.round(F.avg(o), 2).alias("mean"))


@query(
    f"""WITH {BASE}, m AS (SELECT decision_id, accepted_partner, unnest(list_distinct(cameras)) AS mine FROM d WHERE phase = 'cross_camera'), o AS (SELECT decision_id, handle, excluded_by, unnest(list_distinct(cameras)) AS other FROM c)
SELECT least(mine, other) AS cam_a, greatest(mine, other) AS cam_b, count(*) AS considered, count(*) FILTER (accepted_partner = handle) AS merged, count(excluded_by) AS excluded, {", ".join(f"count(*) FILTER (excluded_by = '{x}') AS {x.lower()}" for x in log.EXCLUSIONS)} FROM m JOIN o USING (decision_id) WHERE mine <> other GROUP BY ALL"""
)
def camera_pair_stats(spark, sf_dir):
    return log.camera_pairs(decs(spark, sf_dir), cands(spark, sf_dir))


@query("SELECT run_id, count(*) FILTER (cams > 1) AS multi_camera, count(*) AS identities, max(cams) AS most_cameras FROM (SELECT run_id, assigned_id, count(DISTINCT cam) AS cams FROM outcomes WHERE assigned_id IS NOT NULL GROUP BY ALL) GROUP BY run_id")
def spanning_identities(spark, sf_dir):
    ids = table(spark, sf_dir, "outcomes").filter("assigned_id is not null").groupBy("run_id", "assigned_id").agg(F.countDistinct("cam").alias("cams"))
    return ids.groupBy("run_id").agg(F.count_if(F.col("cams") > 1).alias("multi_camera"), F.count(F.lit(1)).alias("identities"), F.max("cams").alias("most_cameras"))


@query(f"WITH {BASE}, x AS (SELECT decision_id, max(score) AS best FROM c GROUP BY ALL), e AS (SELECT decision_id, unnest(list_distinct(cameras)) AS cam, eligible_count FROM live WHERE phase = 'same_camera') SELECT cam, count(*) AS subjects, count(*) FILTER (eligible_count = 0) AS orphans, count(*) FILTER (eligible_count = 0 AND best > 0.85) AS orphans_over_85 FROM e LEFT JOIN x USING (decision_id) GROUP BY cam")
def orphans(spark, sf_dir):
    subjects = live(spark, sf_dir).filter("phase = 'same_camera'").select("decision_id", F.explode(F.array_distinct("cameras")).alias("cam"), "eligible_count")
    best = cands(spark, sf_dir).groupBy("decision_id").agg(F.max("score").alias("best"))
    none = F.col("eligible_count") == 0
    return subjects.join(best, "decision_id", "left").groupBy("cam").agg(F.count(F.lit(1)).alias("subjects"), F.count_if(none).alias("orphans"), F.count_if(none & (F.col("best") > 0.85)).alias("orphans_over_85"))


@query(f"WITH {BASE}, e AS (SELECT unnest(list_distinct(cameras)) AS cam, eligible_count FROM live WHERE phase = 'same_camera') SELECT cam, round(avg(eligible_count), 6) AS mean, max(eligible_count) AS most, count(*) FILTER (eligible_count = 0) AS zero FROM e GROUP BY cam")
def eligible_set_size(spark, sf_dir):
    e = live(spark, sf_dir).filter("phase = 'same_camera'").select(F.explode(F.array_distinct("cameras")).alias("cam"), "eligible_count")
    return e.groupBy("cam").agg(F.round(F.avg("eligible_count"), 6).alias("mean"), F.max("eligible_count").alias("most"), F.count_if(F.col("eligible_count") == 0).alias("zero"))


@query(f"WITH {BASE}, x AS (SELECT decision_id, max(score) AS m FROM c JOIN live USING (decision_id) WHERE excluded_by = 'BELOW_ABSOLUTE_THRESHOLD' AND phase = 'same_camera' AND score IS NOT NULL GROUP BY ALL) SELECT t AS above, count(*) AS subjects, count(*) FILTER (m > t) AS lost, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.95), 6) AS p95 FROM x, (SELECT unnest([0.75, 0.8, 0.85, 0.88])::DOUBLE AS t) GROUP BY t")
def bar_cut(spark, sf_dir):
    """The highest score the bar rejected, by subject, and the share above each cut."""
    below = cands(spark, sf_dir).filter((F.col("excluded_by") == log.BELOW) & F.col("score").isNotNull())
    top = below.join(live(spark, sf_dir).filter("phase = 'same_camera'").select("decision_id"), "decision_id").groupBy("decision_id").agg(F.max("score").alias("m"))
    cuts = F.explode(F.array(*[F.lit(x) for x in (0.75, 0.80, 0.85, 0.88)]))
    sums = top.select("m", cuts.alias("above")).groupBy("above").agg(F.count(F.lit(1)).alias("subjects"), F.count_if(F.col("m") > F.col("above")).alias("lost"), F.round(F.avg("m"), 6).alias("mean"))
    return sums.crossJoin(F.broadcast(linear_percentiles(top, [], "m", [0.95]).select(F.round(F.col("values")[0], 6).alias("p95"))))  # one row


GAP = BASE + """, st AS (SELECT decision_id, score, lead(score) OVER (PARTITION BY decision_id ORDER BY score DESC, cand_id) AS nx FROM c WHERE score IS NOT NULL),
gap AS (SELECT decision_id, max((round(score - nx, 9), nx, score)) AS x FROM st WHERE nx IS NOT NULL GROUP BY ALL),
ng AS (SELECT decision_id, x[1] AS gap, x[2] AS lower_edge, x[3] AS upper_edge FROM gap)"""


@query(f"WITH {GAP} SELECT * FROM ng")
def natural_gap(spark, sf_dir):
    return log.natural_gaps(cands(spark, sf_dir))


@query(f"WITH {GAP} SELECT count(*) AS subjects, round(quantile_cont(lower_edge, 0.95), 6) AS band_low, round(quantile_cont(upper_edge, 0.05), 6) AS band_high, quantile_cont(lower_edge, 0.95) < quantile_cont(upper_edge, 0.05) AS clean FROM ng JOIN live USING (decision_id) WHERE phase = 'same_camera' AND gap > 0.05")
def clean_band(spark, sf_dir):
    """Whether one bar can part same from different, from the subjects with a clear gap."""
    rows = log.natural_gaps(cands(spark, sf_dir)).filter("gap > 0.05").join(live(spark, sf_dir).filter("phase = 'same_camera'").select("decision_id"), "decision_id")
    edges = rows.select(F.explode(F.array(F.struct(F.lit(0).alias("edge"), F.col("lower_edge").alias("v")), F.struct(F.lit(1).alias("edge"), F.col("upper_edge").alias("v")))).alias("e")).select("e.*")
    cut = linear_percentiles(edges, ["edge"], "v", [0.95, 0.05])
    low, high = F.max(F.when(F.col("edge") == 0, F.col("values")[0])), F.max(F.when(F.col("edge") == 1, F.col("values")[1]))
    return cut.agg(F.coalesce(F.max("n"), F.lit(0)).alias("subjects"), F.round(low, 6).alias("band_low"), F.round(high, 6).alias("band_high"), (low < high).alias("clean"))


@query(f"WITH {GAP} SELECT gate_detail['ABSOLUTE_THRESHOLD'].gate_threshold AS bar, count(*) AS subjects, count(*) FILTER (gate_detail['ABSOLUTE_THRESHOLD'].gate_threshold::DOUBLE > upper_edge) AS above FROM ng JOIN live USING (decision_id) WHERE phase = 'same_camera' AND gap > 0.05 GROUP BY ALL")
def bar_above_cluster(spark, sf_dir):
    """For each bar the subjects that faced it, and of how many it lies above the same-person scores."""
    rows = log.natural_gaps(cands(spark, sf_dir)).filter("gap > 0.05").join(live(spark, sf_dir).filter("phase = 'same_camera'"), "decision_id")
    bar = F.col("gates.ABSOLUTE_THRESHOLD.gate_threshold")
    return rows.groupBy(bar.alias("bar")).agg(F.count(F.lit(1)).alias("subjects"), F.count_if(bar.cast("double") > F.col("upper_edge")).alias("above"))


@query(
    f"""WITH {MARGIN}, nt AS (SELECT mg.decision_id, max(pair_similarity_to_best) AS sim FROM live JOIN mg USING (decision_id) JOIN c ON c.decision_id = mg.decision_id AND c.handle = mg.runner_eligible WHERE margin_eligible <= 0.05 GROUP BY ALL)
SELECT CASE WHEN sim IS NULL THEN 'unknown' WHEN sim > 0.85 THEN 'fragmentation' ELSE 'ambiguity' END AS kind, count(*) AS n FROM nt GROUP BY ALL"""
)
def near_ties(spark, sf_dir):
    m = log.top2_margins(cands(spark, sf_dir)).filter("margin_eligible <= 0.05").join(live(spark, sf_dir).select("decision_id"), "decision_id")
    runner = cands(spark, sf_dir).select("decision_id", F.col("handle").alias("runner_eligible"), "pair_similarity_to_best")
    sim = m.join(runner, ["decision_id", "runner_eligible"]).groupBy("decision_id").agg(F.max("pair_similarity_to_best").alias("sim"))
    kind = F.when(F.col("sim").isNull(), "unknown").when(F.col("sim") > 0.85, "fragmentation").otherwise("ambiguity")
    return sim.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {BASE}, x AS (SELECT context, unnest(list_distinct(cameras)) AS cam, gate_detail['ABSOLUTE_THRESHOLD'].gate_value::DOUBLE AS v FROM live WHERE list_contains(gates_failed, 'RECIPROCAL_BEST')) SELECT context, cam, count(*) AS n, round(avg(v), 6) AS mean, max(v) AS most FROM x GROUP BY ALL")
def reciprocity_losses(spark, sf_dir):
    v = F.col("gates.ABSOLUTE_THRESHOLD.gate_value").cast("double")
    rows = live(spark, sf_dir).filter(F.array_contains("gates_failed", "RECIPROCAL_BEST")).select("context", F.explode(F.array_distinct("cameras")).alias("cam"), v.alias("v"))
    return rows.groupBy("context", "cam").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.max("v").alias("most"))


@query(f"WITH {BASE}, x AS (SELECT gate_detail['ABSOLUTE_THRESHOLD'].gate_value::DOUBLE AS v FROM live WHERE phase = 'cross_camera' AND accepted_partner IS NOT NULL) SELECT count(v) AS n, min(v) AS least, round(avg(v), 6) AS mean, max(v) AS most, count(*) FILTER (v < 0.7) AS under_70, count(*) FILTER (v < 0.66) AS under_66 FROM x")
def accepted_cross_merges(spark, sf_dir):
    v = F.col("gates.ABSOLUTE_THRESHOLD.gate_value").cast("double")
    rows = live(spark, sf_dir).filter("phase = 'cross_camera' and accepted_partner is not null").select(v.alias("v"))
    return rows.agg(F.count("v").alias("n"), F.min("v").alias("least"), F.round(F.avg("v"), 6).alias("mean"), F.max("v").alias("most"), F.count_if(F.col("v") < 0.7).alias("under_70"), F.count_if(F.col("v") < 0.66).alias("under_66"))


@query("SELECT cam, count(*) FILTER (state = 'suppressed') AS suppressed, count(*) AS tracklets, coalesce(sum(observations) FILTER (state = 'suppressed'), 0)::BIGINT AS observations_lost FROM outcomes GROUP BY cam")
def suppression_cost(spark, sf_dir):
    gone = F.col("state") == "suppressed"
    return table(spark, sf_dir, "outcomes").groupBy("cam").agg(F.count_if(gone).alias("suppressed"), F.count(F.lit(1)).alias("tracklets"), F.coalesce(F.sum(F.when(gone, F.col("observations"))), F.lit(0)).cast("long").alias("observations_lost"))


@query("SELECT state, count(*) AS n, count(DISTINCT (run_id, assigned_id)) FILTER (assigned_id IS NOT NULL) AS identities FROM outcomes GROUP BY state")
def outcome_distribution(spark, sf_dir):
    return table(spark, sf_dir, "outcomes").groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.when(F.col("assigned_id").isNotNull(), F.struct("run_id", "assigned_id"))).alias("identities"))


@query(f"WITH {MARGIN} SELECT count(*) AS decisions, count(*) FILTER (abs(gate_detail['TOP2_MARGIN'].gate_value::DOUBLE - margin_eligible) < 0.0000015) AS equal, count(*) FILTER (gate_detail['TOP2_MARGIN'].gate_value IS NOT NULL AND margin_eligible IS NULL) AS not_recomputed FROM d JOIN mg USING (decision_id)")
def verify_margins(spark, sf_dir):
    """The logged margin against the one recomputed from the candidates."""
    v = F.col("gates.TOP2_MARGIN.gate_value")
    both = decs(spark, sf_dir).join(log.top2_margins(cands(spark, sf_dir)), "decision_id")
    return both.agg(F.count(F.lit(1)).alias("decisions"), F.count_if(F.abs(v.cast("double") - F.col("margin_eligible")) < 0.0000015).alias("equal"), F.count_if(v.isNotNull() & F.col("margin_eligible").isNull()).alias("not_recomputed"))


@query(f"WITH {BASE} SELECT context, phase, CASE WHEN score < 0.5 THEN 0 WHEN score < 0.6 THEN 1 WHEN score < 0.7 THEN 2 WHEN score < 0.8 THEN 3 WHEN score < 0.9 THEN 4 ELSE 5 END AS bin, count(*) AS n FROM c JOIN d USING (decision_id) WHERE score IS NOT NULL GROUP BY ALL")
def score_histogram(spark, sf_dir):
    from sightweave.functions.scoring import score_bin

    rows = cands(spark, sf_dir).filter("score is not null").join(decs(spark, sf_dir).select("decision_id", "context", "phase"), "decision_id")
    return rows.groupBy("context", "phase", score_bin(F.col("score")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {BASE}, x AS (SELECT c.*, list_intersect(list_distinct(c.cameras), list_distinct(d.cameras)) AS shared, d.phase FROM c JOIN d USING (decision_id)), y AS (SELECT cand_id, CASE WHEN len(shared) = 0 THEN 0.7 ELSE list_max(list_transform(shared, lambda k: CASE k WHEN 'cam_01' THEN 0.8 WHEN 'cam_05' THEN 0.85 ELSE 0.9 END)) END::DOUBLE AS bar, score FROM x) SELECT bar, count(*) AS pairs, count(*) FILTER (score >= bar) AS over_bar FROM y GROUP BY bar")
def strictest_bar(spark, sf_dir):
    """Candidate pairs by the bar they face under two camera overrides."""
    from sightweave.config import ReconcileConfig
    from sightweave.operators.reconcile import bar_column

    cfg = ReconcileConfig(bars={"cam_01": 0.80, "cam_05": 0.85})
    rows = cands(spark, sf_dir).join(decs(spark, sf_dir).select("decision_id", F.col("cameras").alias("own")), "decision_id")
    shared = F.array_intersect("cameras", "own")
    bar = F.when(F.size(shared) == 0, F.lit(cfg.cross_bar)).otherwise(F.array_max(F.transform(shared, lambda c: bar_column(c, cfg))))
    return rows.select(bar.alias("bar"), "score").groupBy("bar").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("score") >= F.col("bar")).alias("over_bar"))


@query(
    f"""WITH {BASE} SELECT context, count(score) AS n, round(quantile_cont(score, 0.05), 6) AS p5, round(quantile_cont(score, 0.25), 6) AS p25, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.75), 6) AS p75, round(quantile_cont(score, 0.95), 6) AS p95 FROM c JOIN d USING (decision_id) WHERE score IS NOT NULL GROUP BY context"""
)
def percentiles(spark, sf_dir):
    """Linear percentiles of scores by context; equal scores are counted together, so hot groups stay small."""
    rows = cands(spark, sf_dir).filter("score is not null").join(decs(spark, sf_dir).select("decision_id", "context"), "decision_id")
    cuts = (5, 25, 50, 75, 95)
    return linear_percentiles(rows, ["context"], "score", [x / 100 for x in cuts]).select("context", "n", *[F.round(F.col("values")[i], 6).alias(f"p{x}") for i, x in enumerate(cuts)])


@query(f"WITH {BASE} SELECT round(quantile_cont(score, 0.05) FILTER (accepted_partner = c.handle), 6) AS same_p5, round(quantile_cont(score, 0.95) FILTER (accepted_partner IS DISTINCT FROM c.handle), 6) AS other_p95, round(quantile_cont(score, 0.05) FILTER (accepted_partner = c.handle) - quantile_cont(score, 0.95) FILTER (accepted_partner IS DISTINCT FROM c.handle), 6) AS margin FROM c JOIN d USING (decision_id) WHERE score IS NOT NULL")
def separation_margin(spark, sf_dir):
    rows = cands(spark, sf_dir).filter("score is not null").join(decs(spark, sf_dir).select("decision_id", "accepted_partner"), "decision_id")
    same = F.coalesce(F.col("accepted_partner") == F.col("handle"), F.lit(False))
    both = linear_percentiles(rows.withColumn("same", same), ["same"], "score", [0.05, 0.95])
    p5, p95 = F.max(F.when(F.col("same"), F.col("values")[0])), F.max(F.when(~F.col("same"), F.col("values")[1]))
    return both.agg(F.round(p5, 6).alias("same_p5"), F.round(p95, 6).alias("other_p95"), F.round(p5 - p95, 6).alias("margin"))


@query(f"WITH {BASE} SELECT bar, round(avg((score >= bar)::INT) FILTER (accepted_partner = c.handle), 6) AS same_rate, round(avg((score >= bar)::INT) FILTER (accepted_partner IS DISTINCT FROM c.handle), 6) AS other_rate FROM c JOIN d USING (decision_id), (SELECT unnest([0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9])::DOUBLE AS bar) WHERE score IS NOT NULL GROUP BY bar")
def operating_points(spark, sf_dir):
    rows = cands(spark, sf_dir).filter("score is not null").join(decs(spark, sf_dir).select("decision_id", "accepted_partner"), "decision_id")
    same = F.coalesce(F.col("accepted_partner") == F.col("handle"), F.lit(False))
    counts = rows.select(F.col("score"), same.alias("same"), F.explode(F.array(*[F.lit(x) for x in (0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9)])).alias("bar"))
    over = (F.col("score") >= F.col("bar")).cast("int")
    return counts.groupBy("bar").agg(F.round(F.avg(F.when(F.col("same"), over)), 6).alias("same_rate"), F.round(F.avg(F.when(~F.col("same"), over)), 6).alias("other_rate"))


@query(
    f"""WITH {BASE}, x AS (SELECT score, coalesce(accepted_partner = c.handle, false) AS same FROM c JOIN d USING (decision_id) WHERE score IS NOT NULL), v AS (SELECT score, count(*) FILTER (same) AS p, count(*) FILTER (NOT same) AS q FROM x GROUP BY score),
w AS (SELECT *, coalesce(sum(q) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM v) SELECT round(sum(p * (below + q / 2.0))::DOUBLE / (sum(p) * sum(q))::DOUBLE, 6) AS auc, sum(p)::BIGINT AS same_pairs, sum(q)::BIGINT AS other_pairs, round(sum(score * p) / sum(p) - sum(score * q) / sum(q), 6) AS mean_gap FROM w"""
)
def auc(spark, sf_dir):
    """Chance that a same pair outscores another, exactly, from counts of distinct scores, and how far the means of both lie apart."""
    rows = cands(spark, sf_dir).filter("score is not null").join(decs(spark, sf_dir).select("decision_id", "accepted_partner"), "decision_id")
    same = F.coalesce(F.col("accepted_partner") == F.col("handle"), F.lit(False))
    values = counted(rows, [], "score", {"p": F.count_if(same), "q": F.count_if(~same)})
    rate = F.sum(F.col("p") * (F.col("below_q") + F.col("q") / 2)) / (F.sum("p").cast("double") * F.sum("q"))
    mean = lambda n: F.sum(F.col("score") * F.col(n)) / F.sum(n)
    return values.agg(F.round(rate, 6).alias("auc"), F.sum("p").alias("same_pairs"), F.sum("q").alias("other_pairs"), F.round(mean("p") - mean("q"), 6).alias("mean_gap"))
