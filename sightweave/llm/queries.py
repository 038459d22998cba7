"""Queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightweave.llm.clusters import cluster_profiles, similarity_clusters
from sightweave.llm.knn import nearest_vectors
from sightweave.llm.leaks import leak_report, leaked_items
from sightweave.llm.packing import TOKENIZERS, VOCABULARY, pack_texts, shards_for, token_counts
from sightweave.llm.percentiles import combine_summaries, multi_select, percentile_summary
from sightweave.llm.residue import prepared, residue_paragraphs, train
from sightweave.llm.topn import top_n
from sightweave.session import latest, table

DIM, NEIGHBOURS, NEAR, LINK = 128, 10, 0.97, 0.76


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of detections that are among each other's nearest with a cosine of at least 0.97."""
    near = nearest_vectors(table(spark, sf_dir, "detections"), "det_id", "embedding", DIM, NEIGHBOURS, NEAR)
    return near.select(F.least("vec_id", "other_id").alias("det_a"), F.greatest("vec_id", "other_id").alias("det_b")).distinct()


def p1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar detections of every twentieth id, against all."""
    near = nearest_vectors(table(spark, sf_dir, "detections"), "det_id", "embedding", DIM, NEIGHBOURS, queries=F.col("det_id") % 20 == 0)
    return near.select(F.col("vec_id").alias("det_id"), F.col("other_id").alias("neighbour_id"), F.round("cosine", 6).alias("cosine"))


def _clusters(spark: SparkSession, sf_dir: str, typical: bool = True) -> DataFrame:
    return similarity_clusters(table(spark, sf_dir, "detections"), "det_id", "embedding", DIM, LINK, typical=typical)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of clusters of three or more."""
    return _clusters(spark, sf_dir, typical=False).filter("size >= 3").select("cluster_id", F.col("vec_id").alias("det_id"))


def p3_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cluster with its size and most typical members."""
    return cluster_profiles(_clusters(spark, sf_dir))


TOP, PERCENTILES, HIGH_P, HIGH = 5, [0.05, 0.25, 0.5, 0.75, 0.9, 0.95], 0.9, 0.80


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best candidates of each subject."""
    valid = table(spark, sf_dir, "candidates").withColumn("score", F.when(F.col("score").between(-1, 1), F.col("score")))
    return top_n(valid, ["run_id", "subject_handle"], "score", "handle", "cand_id", TOP, version="logged_at").select("run_id", "subject_handle", F.col("item").alias("cand_id"))


def _measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid measures of candidates counted once, with the context of their decision: run_id, context, measure, value."""
    context = latest(table(spark, sf_dir, "decisions"), ["decision_id"], "logged_at", ["context"])
    once = latest(table(spark, sf_dir, "candidates"), ["cand_id"], "logged_at", ["decision_id", "run_id", "score", "pair_similarity_to_best"])
    named = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in ("score", "pair_similarity_to_best")])
    long = once.join(context, "decision_id").select("run_id", "context", F.explode(named).alias("m")).select("run_id", "context", "m.measure", "m.value")
    return long.filter(F.col("value").between(-1, 1))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of measures whose 90th percentile is at least 0.80."""
    found = multi_select(_measures(spark, sf_dir), ["run_id", "context", "measure"], "value", [HIGH_P])
    return found.filter(F.col("value") >= HIGH).select("run_id", "context", "measure")


def p6_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and other percentiles of each run, context and measure."""
    return multi_select(_measures(spark, sf_dir), ["run_id", "context", "measure"], "value", PERCENTILES)


def p6_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all runs, from the summaries of the runs."""
    summaries = percentile_summary(_measures(spark, sf_dir), ["run_id", "context", "measure"], "value")
    return combine_summaries(summaries, ["context", "measure"], PERCENTILES)


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", os.path.join(TOKENIZERS, VOCABULARY))


def _capacities(spark: SparkSession, sf_dir: str) -> list[int]:
    """The capacities of the fixed table of packs."""
    return sorted(r[0] for r in table(spark, sf_dir, "pack_sizes").select("capacity_tokens").distinct().collect())


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that had to be split for the largest packs."""
    placed = pack_texts(_sizes(spark, sf_dir), _capacities(spark, sf_dir)[-1:], shards_for(table(spark, sf_dir, "documents")))
    return placed.filter("piece = 1").select(F.col("text_id").alias("doc_id")).distinct()


def p7_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the packs of each capacity."""
    return pack_texts(_sizes(spark, sf_dir), _capacities(spark, sf_dir), shards_for(table(spark, sf_dir, "documents"))).withColumnRenamed("text_id", "doc_id")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs, tokens and unused share of each capacity."""
    by_capacity = p7_packs(spark, sf_dir).groupBy("capacity", "pack").agg(F.sum("n_tokens").alias("used")).groupBy("capacity")
    return by_capacity.agg(F.count(F.lit(1)).alias("packs"), F.sum("used").alias("tokens")).withColumn("unused", 1 - F.col("tokens") / (F.col("packs") * F.col("capacity")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that carry passages of held-out items, with the items."""
    items = table(spark, sf_dir, "eval_items").filter(F.col("split_name").isin("test", "validation"))
    return leaked_items(table(spark, sf_dir, "documents"), "doc_id", "text", items, "item_id", "passage")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that leaked, with the number of documents."""
    return leak_report(p8_found(spark, sf_dir))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(table(spark, sf_dir, "documents"), "doc_id", "text", "title", "source", "links")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which residue stands in place of content."""
    docs = _documents(spark, sf_dir)
    return residue_paragraphs(docs, train(docs)).select("doc_id").distinct()


def p9_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the classifier does on sources and on phrases it was not fitted on, against the weak labels."""
    report = train(_documents(spark, sf_dir), validate=True).report
    return spark.createDataFrame([(k, float(v)) for k, v in sorted(report.items())], "figure string, value double")


QUERIES = {"p1_found": p1_found, "p1_nearest": p1_nearest, "p3_found": p3_found, "p3_profiles": p3_profiles, "p5_found": p5_found, "p6_found": p6_found, "p6_percentiles": p6_percentiles, "p6_combined": p6_combined, "p7_found": p7_found, "p7_packs": p7_packs, "p7_fill": p7_fill, "p8_found": p8_found, "p8_report": p8_report, "p9_found": p9_found, "p9_validation": p9_validation}

_MEASURES = """
WITH c AS (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY logged_at DESC) = 1),
d AS (SELECT DISTINCT decision_id, context FROM decisions),
m AS (SELECT c.run_id, d.context, 'score' AS measure, c.score AS value FROM c JOIN d USING (decision_id) WHERE c.score BETWEEN -1 AND 1
  UNION ALL SELECT c.run_id, d.context, 'pair_similarity_to_best', c.pair_similarity_to_best FROM c JOIN d USING (decision_id) WHERE c.pair_similarity_to_best BETWEEN -1 AND 1)"""
_VECTORS = """
WITH RECURSIVE e AS (SELECT DISTINCT det_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM detections WHERE len(embedding) = 128 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
u AS (SELECT det_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM e WHERE list_dot_product(v, v) > 0)"""
SQL: dict[str, str] = {
    "p1_found": _VECTORS + " SELECT DISTINCT x.det_id AS det_a, y.det_id AS det_b FROM u x JOIN u y ON x.det_id < y.det_id WHERE list_dot_product(x.u, y.u) >= 0.97",
    "p3_found": _VECTORS
    + """, l AS (SELECT x.det_id AS a, y.det_id AS b FROM u x JOIN u y ON x.det_id < y.det_id WHERE list_dot_product(x.u, y.u) >= 0.76),
both_ AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT det_id, det_id AS m FROM u UNION SELECT r.det_id, both_.b FROM r JOIN both_ ON r.m = both_.a),
c AS (SELECT det_id, min(m) AS cluster_id, count(*) AS n FROM r GROUP BY det_id) SELECT cluster_id, det_id FROM c WHERE n >= 3""",
    "p3_profiles": _VECTORS
    + """, l AS (SELECT x.det_id AS a, y.det_id AS b FROM u x JOIN u y ON x.det_id < y.det_id WHERE list_dot_product(x.u, y.u) >= 0.76),
both_ AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT det_id, det_id AS m FROM u UNION SELECT r.det_id, both_.b FROM r JOIN both_ ON r.m = both_.a),
c AS (SELECT det_id, min(m) AS cluster_id, count(*) AS size FROM r GROUP BY det_id), k AS (SELECT cluster_id, size, det_id, u.u FROM c JOIN u USING (det_id)),
xs AS (SELECT cluster_id, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM k), s AS (SELECT cluster_id, i, sum(x) AS x FROM xs GROUP BY ALL), w AS (SELECT cluster_id, list(x ORDER BY i) AS w FROM s GROUP BY ALL),
t AS (SELECT cluster_id, size, det_id, round(list_dot_product(k.u, w.w) / sqrt(list_dot_product(w.w, w.w)), 9) AS typical FROM k JOIN w USING (cluster_id) QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY typical DESC, det_id) <= 3)
SELECT cluster_id, any_value(size) AS size, list(det_id ORDER BY typical DESC, det_id) AS medoids FROM t GROUP BY cluster_id""",
    "p5_found": """
SELECT run_id, subject_handle, cand_id FROM (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY logged_at DESC) = 1) WHERE score BETWEEN -1 AND 1
QUALIFY row_number() OVER (PARTITION BY run_id, subject_handle ORDER BY score DESC, handle DESC, cand_id DESC) <= 5""",
    "p6_found": _MEASURES + " SELECT run_id, context, measure FROM m GROUP BY ALL HAVING quantile_disc(value, 0.9) >= 0.8",
    "p6_percentiles": _MEASURES
    + """ SELECT run_id, context, measure, p, n, vs[greatest(1, CAST(ceil(round(p * n, 9)) AS BIGINT))] AS value
FROM (SELECT run_id, context, measure, count(*) AS n, list(value ORDER BY value) AS vs FROM m GROUP BY ALL), (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.9, 0.95])::DOUBLE AS p)""",
}
