"""Analysis of the decision log: margins, gates, exclusions, natural gaps, losses and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightweave.session import latest

# The names of the gates and of the reasons for exclusion.
GATES = ["MIN_OBSERVATIONS", "ABSOLUTE_THRESHOLD", "TOP2_MARGIN", "RECIPROCAL_BEST", "TEMPORAL_CONFLICT_SAME_CAMERA", "TEMPORAL_CONFLICT_CROSS_CAMERA"]
EXCLUSIONS = ["TEMPORAL_CONFLICT_SAME_CAMERA", "TEMPORAL_CONFLICT_CROSS_CAMERA", "NOT_MERGEABLE_CROSS", "BELOW_ABSOLUTE_THRESHOLD"]
BELOW = "BELOW_ABSOLUTE_THRESHOLD"


def decisions(raw: DataFrame) -> DataFrame:
    """Decisions counted once."""
    columns = [c for c in raw.columns if c not in ("decision_id", "logged_at", "gate_detail")]
    gates = F.struct(*[F.struct(*[F.col("gate_detail")[g][f].alias(f) for f in ("gate_value", "gate_threshold", "passed")]).alias(g) for g in GATES])
    return latest(raw.withColumn("gates", gates), ["decision_id"], "logged_at", [*columns, "gates"])


def candidates(raw: DataFrame) -> DataFrame:
    """Candidates counted once, with valid scores (null, NaN and out-of-range measures become null)."""
    columns = ["decision_id", "run_id", "subject_handle", "handle", "score", "excluded_by", "would_fail_reciprocity", "cameras", "cluster_size", "observations", "pair_similarity_to_best"]
    once = latest(raw, ["cand_id"], "logged_at", columns)
    valid = lambda c: F.when(F.col(c).between(-1, 1), F.col(c))
    return once.withColumn("score", valid("score")).withColumn("pair_similarity_to_best", valid("pair_similarity_to_best"))


def top2_margins(cands: DataFrame) -> DataFrame:
    """Per decision: best, both runners-up, both margins and whether they differ.

    The best is the eligible candidate (not excluded) with the highest score, the eligible runner-up
    the next of them; the runner-up of all scored is the best other candidate that wasn't excluded
    for being below the bar. Ties go to the smaller handle. Margins have six places; null without a
    runner-up; whether they differ is null without a best. The lists of a decision are bounded by
    the clusters of its round.
    """
    # By decision and handle first, so that the best two of a decision have different handles.
    eligible = F.col("excluded_by").isNull()
    counts = eligible | (F.col("excluded_by") != BELOW)
    by_handle = cands.groupBy("decision_id", "handle").agg(F.max(F.when(eligible, F.col("score"))).alias("own"), F.max(F.when(counts, F.col("score"))).alias("any"))
    rank = lambda c: F.when(F.col(c).isNotNull(), F.struct((-F.col(c)).alias("s"), "handle"))
    two = lambda c: F.slice(F.array_sort(F.collect_list(rank(c))), 1, 2)
    lists = by_handle.groupBy("decision_id").agg(two("own").alias("eligible"), F.array_sort(F.collect_list(rank("any"))).alias("others"))
    best = F.get("eligible", F.lit(0))
    other = F.get(F.filter("others", lambda x: best.isNull() | (x["handle"] != best["handle"])), F.lit(0))
    wide = lists.select("decision_id", best.alias("best"), F.get("eligible", F.lit(1)).alias("second"), other.alias("other"))
    margin = lambda c: F.bround(F.col(f"{c}.s") - F.col("best.s"), 6)
    return wide.select(
        "decision_id",
        F.col("best.handle").alias("best_handle"),
        (-F.col("best.s")).alias("best_score"),
        F.col("second.handle").alias("runner_eligible"),
        F.col("other.handle").alias("runner_all_scored"),
        margin("second").alias("margin_eligible"),
        margin("other").alias("margin_all_scored"),
        F.when(F.col("best").isNotNull(), ~F.col("second.handle").eqNullSafe(F.col("other.handle"))).alias("runner_up_differs"),
    )


def zero_filled(df: DataFrame, value: Column, names: list[str]) -> DataFrame:
    """name, n: counts of an array column's entries, with a row for every name."""
    counts = df.select(F.explode(value).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    enum = df.sparkSession.createDataFrame([(x,) for x in names], "name string")
    return enum.join(counts, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))


def margin_disagreement(margins: DataFrame) -> DataFrame:
    """considered, differs, no_decision, rate_pct, band, mean_abs_delta over all decisions."""
    d = F.col("runner_up_differs")
    sums = margins.agg(F.count_if(d.isNotNull()).alias("considered"), F.count_if(d).alias("differs"), F.count_if(d.isNull()).alias("no_decision"), F.round(F.avg(F.abs(F.col("margin_eligible") - F.col("margin_all_scored"))), 4).alias("mean_abs_delta"))
    rate = F.coalesce(100.0 * F.col("differs") / F.nullif(F.col("considered"), F.lit(0)), F.lit(0.0))
    band = F.when(F.col("considered") == 0, "no margin decisions").when(rate < 1, "not worth maintaining").when(rate < 30, "meaningful choice").otherwise("constraints reshape the candidates")
    return sums.select("considered", "differs", "no_decision", F.round(rate, 2).alias("rate_pct"), band.alias("band"), "mean_abs_delta")


def natural_gaps(cands: DataFrame) -> DataFrame:
    """decision_id, gap, lower_edge, upper_edge: the widest gap in a decision's descending scores (ties: the larger edges)."""
    by = Window.partitionBy("decision_id").orderBy(F.desc("score"), "cand_id")
    steps = cands.filter("score is not null").withColumn("next", F.lead("score").over(by)).filter("next is not null")
    widest = steps.groupBy("decision_id").agg(F.max(F.struct(F.round(F.col("score") - F.col("next"), 9).alias("gap"), F.col("next").alias("lower_edge"), F.col("score").alias("upper_edge"))).alias("x"))
    return widest.select("decision_id", "x.gap", "x.lower_edge", "x.upper_edge")


def camera_pairs(decs: DataFrame, cands: DataFrame) -> DataFrame:
    """cam_a, cam_b, considered, merged, excluded (and how often by each reason) of each unordered pair of cameras in cross-camera decisions."""
    own = decs.filter("phase = 'cross_camera'").select("decision_id", "accepted_partner", F.explode(F.array_distinct("cameras")).alias("mine"))
    theirs = cands.select("decision_id", "handle", "excluded_by", F.explode(F.array_distinct("cameras")).alias("other"))
    both = own.join(theirs, "decision_id").filter("mine <> other")
    keyed = both.groupBy(F.least("mine", "other").alias("cam_a"), F.greatest("mine", "other").alias("cam_b"))
    return keyed.agg(F.count(F.lit(1)).alias("considered"), F.count_if(F.col("accepted_partner") == F.col("handle")).alias("merged"), F.count_if(F.col("excluded_by").isNotNull()).alias("excluded"), *[F.count_if(F.col("excluded_by") == x).alias(x.lower()) for x in EXCLUSIONS])
