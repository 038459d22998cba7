"""Camera-aware k-reciprocal re-ranking of query results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reranked(neighbours: DataFrame, gallery: DataFrame, cams: DataFrame, k1: int = 8, boost: int = 4, lam: float = 0.7) -> DataFrame:
    """query, other, cosine, jaccard, score of every listed neighbour.

    neighbours and gallery hold query (or item), other, score, place: the k1 + boost nearest of the
    queries and of the gallery's items, best first; cams item, cam. A neighbour within k1 places
    (k1 + boost if in another camera than the query) is reciprocal if its own k-th best isn't better
    than the pair's score, or it has fewer than k. The query's set is its reciprocal neighbours and
    theirs; score is lam * cosine + (1 - lam) * the Jaccard overlap of query's and neighbour's sets. With
    fewer than k1 + 1 items in cams the sets say nothing, and score is the cosine. gallery needs the
    items among the neighbours, whose sets are taken, and those among theirs.
    """
    def reciprocal(df: DataFrame, me: str) -> DataFrame:
        own = cams.select(F.col("item").alias(me), F.col("cam").alias("own_cam"))
        theirs = cams.select(F.col("item").alias("other"), F.col("cam").alias("other_cam"))
        k = F.when(F.col("own_cam") == F.col("other_cam"), k1).otherwise(k1 + boost)
        near = df.join(own, me).join(theirs, "other").withColumn("k", k).filter("place <= k")
        kth = gallery.select(F.col("item").alias("other"), F.col("place").alias("k"), F.col("score").alias("kth"))
        return near.join(kth, ["other", "k"], "left").filter("kth is null or score >= kth - 1e-9").select(me, "other")

    item_sets = reciprocal(gallery, "item").groupBy("item").agg(F.array_sort(F.collect_set("other")).alias("r"))
    firsts = reciprocal(neighbours, "query")
    widened = firsts.join(item_sets, firsts["other"] == item_sets["item"], "left").select("query", F.explode(F.array_union(F.array("other"), F.coalesce("r", F.array().cast("array<bigint>")))).alias("o"))
    query_sets = widened.groupBy("query").agg(F.array_sort(F.collect_set("o")).alias("rq"))
    pairs = neighbours.join(query_sets, "query", "left").join(item_sets.select(F.col("item").alias("other"), F.array_union(F.array("item"), "r").alias("ro")), "other", "left")
    none = F.array().cast("array<bigint>")
    rq, ro = F.coalesce("rq", none), F.coalesce("ro", F.array("other"))
    union = F.size(F.array_union(rq, ro))
    jaccard = F.when(union > 0, F.size(F.array_intersect(rq, ro)) / union).otherwise(0.0)
    known = F.broadcast(cams.agg((F.count(F.lit(1)) > k1).alias("enough")))  # one row
    blend = F.when(F.col("enough"), lam * F.col("score") + (1 - lam) * F.col("jaccard")).otherwise(F.col("score"))
    return pairs.withColumn("jaccard", jaccard).crossJoin(known).select("query", "other", F.col("score").alias("cosine"), "jaccard", blend.alias("score"))
