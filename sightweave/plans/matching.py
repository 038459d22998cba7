"""Queries on matching, re-ranking and the evaluation of identities, with their SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightweave.functions import scoring
from sightweave.functions.vectors import dot, prototypes, unit
from sightweave.operators import tracklets as trk
from sightweave.operators.pairs import best_labels, nearest_exact, similar_pairs
from sightweave.operators.ranks import linear_percentiles
from sightweave.operators.rerank import reranked
from sightweave.plans.identity import CFG, DIM, OBS, PROTO, obs
from sightweave.session import cut, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def gallery(spark, sf_dir):
    """Labelled vectors at length one."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", unit(F.col("embedding")).alias("u")).filter("u is not null")


G = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), g AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM e)"


@query(f"WITH {G} SELECT q.vec_id AS query, o.vec_id AS other, round(list_dot_product(q.u, o.u), 6) AS score FROM g q JOIN g o ON q.vec_id <> o.vec_id WHERE q.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.u, o.u), 12) DESC, o.vec_id) <= 5")
def knn_join(spark, sf_dir):
    """The five nearest of every twentieth vector, exactly, against all."""
    g = gallery(spark, sf_dir)
    return nearest_exact(g.filter("vec_id % 20 = 0"), g, "vec_id", "u", 5).select("query", "other", F.round("score", 6).alias("score"))


@query(
    f"""WITH {G}, k AS (SELECT q.vec_id, q.label, o.label = q.label AS hit, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.u, o.u), 12) DESC, o.vec_id) AS place FROM g q JOIN g o ON q.vec_id <> o.vec_id WHERE q.vec_id % 20 = 0 QUALIFY place <= 5),
t AS (SELECT vec_id, any_value(label) AS label, bool_or(hit AND place = 1) AS top1, bool_or(hit) AS top5 FROM k GROUP BY vec_id) SELECT label, count(*) AS queries, count(*) FILTER (top1) AS top1, count(*) FILTER (top5) AS top5 FROM t GROUP BY label"""
)
def retrieval_accuracy(spark, sf_dir):
    g = gallery(spark, sf_dir)
    near = nearest_exact(g.filter("vec_id % 20 = 0"), g, "vec_id", "u", 5)
    labels = g.select(F.col("vec_id").alias("query"), "label")
    hits = near.join(labels, "query").join(labels.select(F.col("query").alias("other"), F.col("label").alias("theirs")), "other").withColumn("hit", F.col("label") == F.col("theirs"))
    each = hits.groupBy("query", "label").agg(F.bool_or(F.col("hit") & (F.col("place") == 1)).alias("top1"), F.bool_or("hit").alias("top5"))
    return each.groupBy("label").agg(F.count(F.lit(1)).alias("queries"), F.count_if("top1").alias("top1"), F.count_if("top5").alias("top5"))


@query(
    f"""WITH {OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id, gid ORDER BY frame_index DESC, det_id DESC) AS k FROM obs WHERE gid > 0), q AS (SELECT run_id, gid, det_id, u FROM r WHERE k = 1), b AS (SELECT run_id, gid, det_id, u FROM r WHERE k BETWEEN 2 AND 21),
e AS (SELECT run_id, gid, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM b), m AS (SELECT run_id, gid, i, sum(x) AS x FROM e GROUP BY ALL), a AS (SELECT run_id, gid, list(x ORDER BY i) AS w FROM m GROUP BY ALL),
x AS (SELECT q.run_id, q.gid, max(list_dot_product(q.u, b.u)) AS best FROM q JOIN b ON q.run_id = b.run_id AND q.gid = b.gid GROUP BY ALL)
SELECT run_id, gid, round(greatest(best, list_dot_product(q.u, a.w) / sqrt(list_dot_product(a.w, a.w))), 6) AS score FROM q JOIN a USING (run_id, gid) JOIN x USING (run_id, gid)"""
)
def bank_score(spark, sf_dir):
    """The newest observation of each identity against its bank: the better of prototype and best exemplar."""
    place = F.row_number().over(Window.partitionBy("run_id", "gid").orderBy(F.desc("frame_index"), F.desc("det_id")))
    ranked = obs(spark, sf_dir).filter("gid > 0").select("run_id", "gid", "unit_vector", place.alias("k")).filter("k <= 21")
    newest = ranked.filter("k = 1").select("run_id", "gid", F.col("unit_vector").alias("q"))
    bank = ranked.filter("k > 1")
    best = bank.join(newest, ["run_id", "gid"]).groupBy("run_id", "gid").agg(F.max(dot(F.col("q"), F.col("unit_vector"))).alias("best"))
    return newest.join(prototypes(bank, ["run_id", "gid"], "unit_vector", DIM), ["run_id", "gid"]).join(best, ["run_id", "gid"]).select("run_id", "gid", F.round(F.greatest("best", dot(F.col("q"), F.col("prototype"))), 6).alias("score"))


_HELD = (
    OBS
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY run_id, gid ORDER BY frame_index, det_id) AS i, count(*) OVER (PARTITION BY run_id, gid) AS n FROM obs WHERE gid > 0), q AS (SELECT * FROM r WHERE n >= 4 AND i > n // 2),
bk AS (SELECT run_id, gid, u FROM r WHERE n >= 4 AND i <= n // 2 AND i > n // 2 - 20), xs AS (SELECT run_id, gid, unnest(u) AS x, generate_subscripts(u, 1) AS j FROM bk), sm AS (SELECT run_id, gid, j, sum(x) AS x FROM xs GROUP BY ALL), pt AS (SELECT run_id, gid, list(x ORDER BY j) AS w FROM sm GROUP BY ALL),
ex AS (SELECT q.det_id, list(list_dot_product(q.u, b.u) ORDER BY list_dot_product(q.u, b.u) DESC) AS ds FROM q JOIN bk b ON b.run_id = q.run_id AND b.gid = q.gid GROUP BY q.det_id),
md AS (SELECT q.run_id, q.gid, q.det_id, list_dot_product(q.u, pt.w) / sqrt(list_dot_product(pt.w, pt.w)) AS prototype, ds[1] AS max_exemplar, list_avg(ds[1:greatest(1, round_even(len(ds) * 0.25, 0))::BIGINT]) AS consensus FROM q JOIN pt ON pt.run_id = q.run_id AND pt.gid = q.gid JOIN ex ON ex.det_id = q.det_id)"""
)


def held_out_scores(observations):
    """run_id, gid, det_id and the three scores of the later half of each identity's observations against the last 20 of its earlier half."""
    by = Window.partitionBy("run_id", "gid")
    ranked = observations.filter("gid > 0").withColumn("i", F.row_number().over(by.orderBy("frame_index", "det_id"))).withColumn("n", F.count(F.lit(1)).over(by)).filter("n >= 4")
    half = F.floor(F.col("n") / 2)
    bank = ranked.filter((F.col("i") <= half) & (F.col("i") > half - 20)).select("run_id", "gid", "unit_vector")
    lists = bank.groupBy("run_id", "gid").agg(F.collect_list("unit_vector").alias("bank"))  # 20 at most
    queries = ranked.filter(F.col("i") > half).select("run_id", "gid", "det_id", F.col("unit_vector").alias("q"))
    both = queries.join(lists, ["run_id", "gid"]).join(prototypes(bank, ["run_id", "gid"], "unit_vector", DIM), ["run_id", "gid"])
    scores = F.reverse(F.array_sort(F.transform("bank", lambda b: dot(F.col("q"), b))))
    top = F.greatest(F.lit(1), F.rint(F.size("bank") * CFG.top_frac).cast("int"))
    named = both.select("run_id", "gid", "det_id", dot(F.col("q"), F.col("prototype")).alias("prototype"), scores.alias("s"), top.alias("top"))
    return named.select("run_id", "gid", "det_id", "prototype", F.col("s")[0].alias("max_exemplar"), (F.aggregate(F.slice("s", 1, F.col("top")), F.lit(0.0), lambda a, x: a + x) / F.col("top")).alias("consensus"))


@query(f"WITH {_HELD} SELECT det_id, round(prototype, 6) AS prototype, round(max_exemplar, 6) AS max_exemplar, round(consensus, 6) AS consensus FROM md")
def held_out_bank(spark, sf_dir):
    """Observations against the bank of their identity from before."""
    out = held_out_scores(obs(spark, sf_dir))
    return out.select("det_id", *[F.round(c, 6).alias(c) for c in ("prototype", "max_exemplar", "consensus")])


@query(f"WITH {_HELD}, un AS (SELECT run_id, unnest(['prototype', 'max_exemplar', 'consensus']) AS mode, unnest([prototype, max_exemplar, consensus]) AS s FROM md) SELECT run_id, mode, count(*) AS n, round(quantile_cont(s, 0.05), 6) AS p5, round(quantile_cont(s, 0.5), 6) AS median, round(quantile_cont(s, 0.95), 6) AS p95 FROM un GROUP BY ALL")
def scores_by_mode(spark, sf_dir):
    """Distribution of the held-out scores under each way of scoring."""
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("s")) for m in ("prototype", "max_exemplar", "consensus")])).alias("m")
    long = held_out_scores(obs(spark, sf_dir)).select("run_id", modes).select("run_id", "m.mode", "m.s")
    cuts = linear_percentiles(long, ["run_id", "mode"], "s", [0.05, 0.5, 0.95])
    return cuts.select("run_id", "mode", "n", *[F.round(F.col("values")[i], 6).alias(name) for i, name in enumerate(("p5", "median", "p95"))])


def set_scores(observations, mode):
    """Every two tracks of a camera whose spans are disjoint, on at most CFG.cap even rows a side, as the reconcile scores them."""
    tracks = trk.with_prototypes(observations, DIM, 1)
    rows = trk.even_rows(observations, trk.KEY, ["frame_index", "det_id"], CFG.cap)
    lists = rows.groupBy(*trk.KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_index", "det_id", "unit_vector"))), lambda x: x["unit_vector"]).alias("rows"))
    keyed = tracks.join(lists, trk.KEY).withColumn("group", F.struct("run_id", "cam"))
    pairs = similar_pairs(keyed, "group", "track_id", "prototype", -2.0, block=512, rows="rows", mode=mode, top_frac=CFG.top_frac)  # no cosine is under the bar
    spans = lambda n, i: tracks.select("run_id", "cam", F.col("track_id").alias(n), F.col("first_frame").alias(f"s{i}"), F.col("last_frame").alias(f"e{i}"))
    flat = pairs.select("group.run_id", "group.cam", F.col("a").alias("track_a"), F.col("b").alias("track_b"), "score")
    free = flat.join(spans("track_a", 1), ["run_id", "cam", "track_a"]).join(spans("track_b", 2), ["run_id", "cam", "track_b"]).filter("e1 < s2 or e2 < s1")
    return free.select("run_id", "cam", "track_a", "track_b", F.round("score", 6).alias("score"))


_SETS = (
    OBS
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY run_id, cam, track_id ORDER BY frame_index, det_id) - 1 AS i, count(*) OVER (PARTITION BY run_id, cam, track_id) AS n FROM obs), j AS (SELECT unnest(range(64)) AS j),
s AS (SELECT DISTINCT run_id, cam, track_id, det_id, u FROM r, j WHERE n <= 64 OR i = round_even(j * ((n - 1) / 63.0), 0)::BIGINT),
e AS (SELECT run_id, cam, track_id, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM obs), m AS (SELECT run_id, cam, track_id, i, sum(x) AS x FROM e GROUP BY ALL), a AS (SELECT run_id, cam, track_id, list(x ORDER BY i) AS w FROM m GROUP BY ALL),
p AS (SELECT * FROM a JOIN t USING (run_id, cam, track_id)),
nx AS (SELECT x.run_id, x.cam, x.track_id AS track_a, y.track_id AS track_b, list_dot_product(x.w, y.w) / sqrt(list_dot_product(x.w, x.w) * list_dot_product(y.w, y.w)) AS proto FROM p x JOIN p y ON x.run_id = y.run_id AND x.cam = y.cam AND x.track_id < y.track_id AND (x.last_frame < y.first_frame OR y.last_frame < x.first_frame)),
pr AS (SELECT nx.*, list_dot_product(x.u, y.u) AS d FROM nx JOIN s x ON x.run_id = nx.run_id AND x.cam = nx.cam AND x.track_id = nx.track_a JOIN s y ON y.run_id = nx.run_id AND y.cam = nx.cam AND y.track_id = nx.track_b)"""
)


@query(f"WITH {_SETS} SELECT run_id, cam, track_a, track_b, round(greatest(max(d), any_value(proto)), 6) AS score FROM pr GROUP BY run_id, cam, track_a, track_b")
def score_max_exemplar(spark, sf_dir):
    return set_scores(obs(spark, sf_dir), "max_exemplar")


@query(f"WITH {_SETS}, k AS (SELECT *, row_number() OVER (PARTITION BY run_id, cam, track_a, track_b ORDER BY d DESC) AS p, greatest(1, round_even(count(*) OVER (PARTITION BY run_id, cam, track_a, track_b) * 0.25, 0)) AS k FROM pr) SELECT run_id, cam, track_a, track_b, round(avg(d), 6) AS score FROM k WHERE p <= k GROUP BY run_id, cam, track_a, track_b")
def score_consensus(spark, sf_dir):
    return set_scores(obs(spark, sf_dir), "consensus")


@query(
    """WITH c AS (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY logged_at DESC) = 1)
SELECT cand_id, round(1 / (1 + exp(-(-13.5 + 11.0 * score + 7.0 * coalesce(CASE WHEN pair_similarity_to_best BETWEEN -1 AND 1 THEN pair_similarity_to_best END, 0) + 0.6 * ln(1 + greatest(0, observations)) + 0.5))), 6) AS probability FROM c WHERE score BETWEEN -1 AND 1"""
)
def verifier_prob(spark, sf_dir):
    """The logistic score of candidates, without a time gap and at middling quality."""
    from sightweave.plans.decisions import cands

    rows = cands(spark, sf_dir).filter("score is not null")
    p = scoring.verifier(F.col("score"), F.coalesce("pair_similarity_to_best", F.lit(0.0)), F.col("observations"), F.lit(0.0), F.lit(0.5))
    return rows.select("cand_id", F.round(p, 6).alias("probability"))


_MINT = (
    G
    + """, h AS (SELECT q.vec_id AS query, o.label, max(round(list_dot_product(q.u, o.u), 12)) AS s FROM g q JOIN g o ON q.vec_id <> o.vec_id WHERE q.vec_id % 20 = 0 AND o.vec_id % 20 <> 0 GROUP BY ALL),
b AS (SELECT query, label, s, lead(s) OVER (PARTITION BY query ORDER BY s DESC, label DESC) AS second, row_number() OVER (PARTITION BY query ORDER BY s DESC, label DESC) AS r FROM h)"""
)


@query(f"WITH {_MINT} SELECT query, label AS best_label, round(s, 6) AS best, s >= 0.3 AND s - coalesce(second, -1) >= 0.03 AS accepted FROM b WHERE r = 1")
def match_or_mint(spark, sf_dir):
    """Match or mint each query vector: the best identity over the bar and clear of the second (ties: the larger id)."""
    g = gallery(spark, sf_dir)
    base = g.filter("vec_id % 20 <> 0")
    best = best_labels(g.filter("vec_id % 20 = 0"), base, "vec_id", "u", "label")
    return best.select("query", F.col("label").alias("best_label"), F.round("score", 6).alias("best"), ((F.col("score") >= 0.3) & (F.col("score") - F.coalesce("second", F.lit(-1.0)) >= 0.03)).alias("accepted"))


def _near_sql(name: str, of: str) -> str:
    return f"{name} AS (SELECT x.item AS me, x.cam AS mine, y.item AS other, y.cam AS theirs, list_dot_product(x.proto, y.proto) AS s, row_number() OVER (PARTITION BY x.item ORDER BY round(list_dot_product(x.proto, y.proto), 12) DESC, y.item) AS place FROM tk x JOIN tk y ON x.item <> y.item WHERE {of} AND y.key % 20 <> 0 QUALIFY place <= 12)"


def _mutual_sql(name: str, of: str) -> str:
    return f"{name} AS (SELECT n.me, n.other FROM {of} n LEFT JOIN ow g ON g.me = n.other AND g.place = CASE WHEN n.mine = n.theirs THEN 8 ELSE 12 END WHERE n.place <= CASE WHEN n.mine = n.theirs THEN 8 ELSE 12 END AND (g.s IS NULL OR n.s >= g.s - 1e-9))"


@query(
    f"""WITH {PROTO}, kp AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY cam, track_id) - 1 AS key FROM p), tk AS (SELECT substr(replace(run_id, '_', ''), 3)::BIGINT * 1000000 + key AS item, key, cam, proto FROM kp),
{_near_sql("nb", "x.key % 20 = 0")}, {_near_sql("ow", "x.key % 20 <> 0")}, {_mutual_sql("ri", "ow")}, {_mutual_sql("rf", "nb")},
sq AS (SELECT me, list_distinct(list(o)) AS rq FROM (SELECT me, other AS o FROM rf UNION ALL SELECT rf.me, ri.other FROM rf JOIN ri ON ri.me = rf.other) GROUP BY me), so AS (SELECT me, list(other) AS r FROM ri GROUP BY me),
x AS (SELECT nb.me AS query, nb.other, s, coalesce(rq, []) AS rq, list_distinct(list_append(coalesce(so.r, []), nb.other)) AS ro FROM nb LEFT JOIN sq ON sq.me = nb.me LEFT JOIN so ON so.me = nb.other), y AS (SELECT *, len(list_intersect(rq, ro)) / len(list_distinct(list_concat(rq, ro)))::DOUBLE AS j FROM x)
SELECT query, other, round(s, 6) AS cosine, round(j, 6) AS jaccard, round(0.7 * s + 0.3 * j, 6) AS score FROM y"""
)
def rerank_jaccard(spark, sf_dir):
    """Every twentieth tracklet's nearest others, re-ranked by common neighbours with regard to their cameras."""
    kept = trk.with_prototypes(obs(spark, sf_dir), DIM, CFG.min_observations)
    key = F.row_number().over(Window.partitionBy("run_id").orderBy("cam", "track_id")) - 1
    item = F.substring(F.replace("run_id", F.lit("_"), F.lit("")), 3, 12).cast("long") * 1_000_000 + F.col("key")
    items = cut(kept.withColumn("key", key).select(item.alias("item"), "key", "cam", "prototype"))
    base = items.filter("key % 20 <> 0")
    near = cut(nearest_exact(items.filter("key % 20 = 0"), base, "item", "prototype", 12))
    # Of the gallery only what the queries reach in two steps is searched.
    first = near.select(F.col("other").alias("item")).distinct()
    own = cut(nearest_exact(base.join(first, "item", "left_semi"), base, "item", "prototype", 12))
    second = own.select(F.col("other").alias("item")).distinct().join(first, "item", "left_anti")
    further = nearest_exact(base.join(second, "item", "left_semi"), base, "item", "prototype", 12)
    out = reranked(near, own.unionByName(further).withColumnRenamed("query", "item"), items.select("item", "cam"))
    return out.select("query", "other", *[F.round(c, 6).alias(c) for c in ("cosine", "jaccard", "score")])


@query("WITH x AS (SELECT DISTINCT global_id AS gid, assigned_id AS person, run_id FROM (SELECT DISTINCT d.run_id, d.cam, d.track_id, d.global_id FROM detections d WHERE d.global_id > 0 AND d.track_id IS NOT NULL) JOIN outcomes o USING (run_id, cam, track_id) WHERE assigned_id IS NOT NULL), a AS (SELECT run_id, count(*) AS merged_ids FROM (SELECT run_id, gid FROM x GROUP BY ALL HAVING count(DISTINCT person) > 1) GROUP BY run_id), b AS (SELECT run_id, count(*) AS split_people FROM (SELECT run_id, person FROM x GROUP BY ALL HAVING count(DISTINCT gid) > 1) GROUP BY run_id) SELECT r.run_id, coalesce(merged_ids, 0) AS merged_ids, coalesce(split_people, 0) AS split_people FROM (SELECT DISTINCT run_id FROM x) r LEFT JOIN a USING (run_id) LEFT JOIN b USING (run_id)")
def merge_split_eval(spark, sf_dir):
    """Live ids that hold several reconciled people, and people that hold several live ids."""
    live = table(spark, sf_dir, "detections").filter("global_id > 0 and track_id is not null").select("run_id", "cam", "track_id", "global_id").distinct()
    x = live.join(table(spark, sf_dir, "outcomes").filter("assigned_id is not null").select("run_id", "cam", "track_id", "assigned_id"), ["run_id", "cam", "track_id"]).select("run_id", "global_id", "assigned_id").distinct()
    several = lambda key, value, name: x.groupBy("run_id", key).agg(F.countDistinct(value).alias("n")).groupBy("run_id").agg(F.count_if(F.col("n") > 1).alias(name))
    return several("global_id", "assigned_id", "merged_ids").join(several("assigned_id", "global_id", "split_people"), "run_id")


@query(
    f"""WITH {OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id, cam, track_id ORDER BY frame_index, det_id) AS i, count(*) OVER (PARTITION BY run_id, cam, track_id) AS n FROM obs), h AS (SELECT run_id, cam, track_id, CASE WHEN i <= n // 2 THEN 0 ELSE 1 END AS half, u FROM r WHERE n >= 8),
e AS (SELECT run_id, cam, track_id, half, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM h), m AS (SELECT run_id, cam, track_id, half, i, sum(x) AS x FROM e GROUP BY ALL), a AS (SELECT run_id, cam, track_id, half, list(x ORDER BY i) AS w FROM m GROUP BY ALL)
SELECT p.run_id, p.cam, p.track_id, round(list_dot_product(p.w, q.w) / sqrt(list_dot_product(p.w, p.w) * list_dot_product(q.w, q.w)), 6) AS score FROM a p JOIN a q USING (run_id, cam, track_id) WHERE p.half = 0 AND q.half = 1"""
)
def fragment_halves(spark, sf_dir):
    """Cosine of the two halves of each track of eight observations or more."""
    by = Window.partitionBy(*trk.KEY)
    ranked = obs(spark, sf_dir).withColumn("i", F.row_number().over(by.orderBy("frame_index", "det_id"))).withColumn("n", F.count(F.lit(1)).over(by)).filter("n >= 8")
    halves = prototypes(ranked.withColumn("half", (F.col("i") > F.floor(F.col("n") / 2)).cast("int")), [*trk.KEY, "half"], "unit_vector", DIM)
    a, b = (halves.filter(f"half = {h}").select(*trk.KEY, F.col("prototype").alias(f"p{h}")) for h in (0, 1))
    return a.join(b, trk.KEY).select(*trk.KEY, F.round(dot(F.col("p0"), F.col("p1")), 6).alias("score"))


_NN = (
    PROTO
    + """, k AS (SELECT p.*, (row_number() OVER (PARTITION BY run_id ORDER BY cam, track_id) - 1) AS key FROM p), ga AS (SELECT run_id, cam, track_id, list_distinct(list(gid)) AS gids FROM obs WHERE gid IS NOT NULL GROUP BY ALL),
pa AS (SELECT x.run_id, x.key AS a, y.key AS b, x.cam AS ca, y.cam AS cb, list_dot_product(x.proto, y.proto) AS s FROM k x JOIN k y ON x.run_id = y.run_id AND x.cam <> y.cam WHERE list_dot_product(x.proto, y.proto) >= 0.5),
be AS (SELECT * FROM pa QUALIFY row_number() OVER (PARTITION BY run_id, a ORDER BY s DESC, b DESC) = 1), mu AS (SELECT x.* FROM be x JOIN be y ON x.run_id = y.run_id AND x.b = y.a AND y.b = x.a WHERE x.a < x.b),
fm AS (SELECT mu.run_id, a, b, s, coalesce(list_has_any(g1.gids, g2.gids), false) AS same FROM mu JOIN k k1 ON k1.run_id = mu.run_id AND k1.key = a JOIN k k2 ON k2.run_id = mu.run_id AND k2.key = b LEFT JOIN ga g1 ON g1.run_id = k1.run_id AND g1.cam = k1.cam AND g1.track_id = k1.track_id LEFT JOIN ga g2 ON g2.run_id = k2.run_id AND g2.cam = k2.cam AND g2.track_id = k2.track_id),
rr AS (SELECT *, row_number() OVER (PARTITION BY run_id, cam, track_id ORDER BY frame_index, det_id) - 1 AS i, count(*) OVER (PARTITION BY run_id, cam, track_id) AS n FROM obs), jj AS (SELECT unnest(range(64)) AS j), sr AS (SELECT DISTINCT run_id, cam, track_id, det_id, u FROM rr, jj WHERE n <= 64 OR i = round_even(j * ((n - 1) / 63.0), 0)::BIGINT),
bx AS (SELECT fm.run_id, fm.a, fm.b, any_value(fm.s) AS s, any_value(fm.same) AS same, max(list_dot_product(x.u, y.u)) AS be FROM fm JOIN k k1 ON k1.run_id = fm.run_id AND k1.key = a JOIN k k2 ON k2.run_id = fm.run_id AND k2.key = b JOIN sr x ON x.run_id = k1.run_id AND x.cam = k1.cam AND x.track_id = k1.track_id JOIN sr y ON y.run_id = k2.run_id AND y.cam = k2.cam AND y.track_id = k2.track_id GROUP BY fm.run_id, fm.a, fm.b)"""
)


@query(f"WITH {_NN} SELECT CASE WHEN same THEN 'merged' WHEN s >= 0.7 THEN 'decision' WHEN be >= 0.7 THEN 'averaging' ELSE 'below' END AS mode, count(*) AS n, round(avg(s), 6) AS mean, count(*) FILTER (s < 0.7 AND be >= 0.7) AS flips FROM bx GROUP BY ALL")
def failure_modes(spark, sf_dir):
    """What became of tracks of different cameras that are each other's nearest: one id, over the bar but apart, lost by averaging (only single rows are over the bar), or below it."""
    observed = obs(spark, sf_dir)
    kept = trk.with_prototypes(observed, DIM, CFG.min_observations)
    key = (F.row_number().over(Window.partitionBy("run_id").orderBy("cam", "track_id")) - 1).cast("long")
    keyed = kept.withColumn("key", key)
    pairs = similar_pairs(keyed, "run_id", "key", "prototype", 0.5)
    info = keyed.select("run_id", "key", "cam", "gids")
    side = lambda n, i: info.select("run_id", F.col("key").alias(n), F.col("cam").alias(f"cam{i}"), F.col("gids").alias(f"g{i}"))
    cross = pairs.join(side("a", 1), ["run_id", "a"]).join(side("b", 2), ["run_id", "b"]).filter("cam1 <> cam2")
    from sightweave.operators.reconcile import best_partners, mutual

    pairs_ = mutual(best_partners(cross)).join(cross.select("run_id", "a", "b", "g1", "g2"), ["run_id", "a", "b"])
    rows = trk.even_rows(observed, trk.KEY, ["frame_index", "det_id"], CFG.cap).join(keyed.select(*trk.KEY, "key"), trk.KEY).select("run_id", "key", "unit_vector")
    of = lambda n: rows.select("run_id", F.col("key").alias(n), F.col("unit_vector").alias(f"u{n}"))
    best = pairs_.select("run_id", "a", "b").join(of("a"), ["run_id", "a"]).join(of("b"), ["run_id", "b"]).groupBy("run_id", "a", "b").agg(F.max(dot(F.col("ua"), F.col("ub"))).alias("single"))
    over = lambda c: F.col(c) >= CFG.cross_bar
    mode = F.when(F.coalesce(F.arrays_overlap("g1", "g2"), F.lit(False)), "merged").when(over("score"), "decision").when(over("single"), "averaging").otherwise("below")
    return pairs_.join(best, ["run_id", "a", "b"]).groupBy(mode.alias("mode")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.count_if(~over("score") & over("single")).alias("flips"))


def medoids(pdf: pd.DataFrame, bar: float = 0.75, most: int = 6) -> pd.DataFrame:
    """Views of one track: rows by total similarity join their nearest seed or, below the bar, become one while there are fewer than most; each view with its medoid."""
    pdf = pdf.sort_values(["frame_index", "det_id"]).reset_index(drop=True)
    u = np.stack(pdf["unit_vector"].to_numpy())
    # The sum of a row's similarities is its product with the sum of rows, so no square matrix is made.
    order = np.argsort(-np.round(u @ u.sum(0), 9), kind="stable")
    v = u[order]
    view, best, seed, n = np.zeros(len(v), int), np.full(len(v), -np.inf), 0, 0
    while True:
        s = v[seed:] @ v[seed]
        s[0] = np.inf  # a seed stays in its own view
        nearer = s > best[seed:]
        view[seed:][nearer], best[seed:][nearer] = n, s[nearer]
        n += 1
        far = np.flatnonzero(best[seed:] < bar)
        if n == most or not len(far):
            break
        seed += far[0]
    out = []
    for i in range(n):
        group = np.sort(order[view == i])
        total = np.round(u[group] @ u[group].sum(0), 9)
        out.append((pdf["run_id"][0], pdf["cam"][0], pdf["track_id"][0], i, int(pdf["det_id"][group[total.argmax()]]), len(group)))
    return pd.DataFrame(out, columns=["run_id", "cam", "track_id", "view", "medoid", "members"])


@query()
def medoid_views(spark, sf_dir):
    """At most six views of each track, over all its rows."""
    rows = obs(spark, sf_dir)
    return rows.select(*trk.KEY, "det_id", "frame_index", "unit_vector").groupBy(*trk.KEY).applyInPandas(lambda pdf: medoids(pdf), "run_id string, cam string, track_id long, view int, medoid long, members int")
