import numpy as np
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from sightweave.llm import clusters, knn, shards

DIM = 16


def collection(n_people=30, per=25, seed=0, noise=0.12):
    rng = np.random.RandomState(seed)
    base = rng.randn(n_people, DIM)
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    v = (base[:, None] + noise * rng.randn(n_people, per, DIM)).reshape(-1, DIM).astype(np.float32)
    v[5] = v[4] * 3  # same direction, another length
    v[20] = v[21] = v[22]
    return v


def frame(spark, v, extra=()):
    rows = [(i, x.tolist(), "x", 0.0) for i, x in enumerate(v)] + [(*e, "x", 0.0) for e in extra]
    return spark.createDataFrame(rows, "id long, e array<float>, vec_id string, cosine double").repartition(5)


BAD = [(9000, None), (9001, [0.0] * DIM), (9002, [float("nan")] + [1.0] * (DIM - 1)), (9003, [1.0] * (DIM - 1)), (9004, [None] + [1.0] * (DIM - 1)), (None, [1.0] * DIM), (9005, [float("inf")] * DIM), (9006, [])]


@pytest.mark.parametrize("shard_rows", [None, 150])
def test_nearest_against_brute_force(spark, shard_rows):
    v = collection()
    df = frame(spark, v, [*BAD, (3, v[3].tolist())])
    got = knn.nearest_vectors(df, "id", "e", DIM, 10, shard_rows=shard_rows).toPandas()
    assert not got.duplicated(["vec_id", "other_id"]).any() and (got["vec_id"] != got["other_id"]).all()
    assert set(got["vec_id"]) == set(range(len(v)))
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    assert np.allclose(got["cosine"], s[got["vec_id"], got["other_id"]], atol=1e-9)
    kth = np.sort(s, axis=1)[:, -10]
    hits = (got["cosine"].to_numpy() >= kth[got["vec_id"]] - 1e-9).sum()
    assert hits / (10 * len(v)) >= 0.95
    assert (got.groupby("vec_id").size() == 10).all()


def test_floor_copies_and_empty(spark):
    v = collection(6, 8)
    df = frame(spark, v)
    near = {(r["vec_id"], r["other_id"]) for r in knn.nearest_vectors(df, "id", "e", DIM, 3, 0.99999).collect()}
    assert {(4, 5), (5, 4)} <= near
    assert knn.nearest_vectors(df.limit(0), "id", "e", DIM).count() == 0
    assert clusters.similarity_clusters(df.limit(0), "id", "e", DIM, 0.8).count() == 0
    assert knn.nearest_vectors(frame(spark, v[:1]), "id", "e", DIM).count() == 0


def test_a_hot_group_of_copies(spark):
    v = collection(10, 12)
    hot = np.tile(v[0] * 2, (200, 1))
    rows = np.concatenate([v, hot])
    out = knn.nearest_vectors(frame(spark, rows), "id", "e", DIM, 4).toPandas()
    copies = list(range(len(v), len(rows)))
    mine = out[out["vec_id"].isin(copies)].groupby("vec_id")["other_id"].apply(sorted)
    # Copies of one vector (and its like of another length) answer with the smallest ids at cosine 1.
    assert len(mine) == 200 and (out[out["vec_id"].isin(copies)]["cosine"] > 0.999999).all()
    got = clusters.similarity_clusters(frame(spark, rows), "id", "e", DIM, 0.8).toPandas()
    assert len(got) == len(rows) and got["vec_id"].is_unique
    assert got[got["vec_id"].isin(copies)]["cluster_id"].nunique() == 1


@pytest.mark.parametrize("shard_rows, noise, seed", [(None, 0.12, 3), (120, 0.12, 3), (120, 0.12, 4), (120, 0.12, 5), (40, 0.12, 3)])
def test_clusters_are_the_components(spark, shard_rows, noise, seed):
    """In one shard and over many, for noisy vectors with borderline links."""
    v = collection(25, 20, seed, noise)
    rng = np.random.RandomState(1)
    # A chain of steps: only neighbours are similar.
    a, b = rng.randn(DIM), rng.randn(DIM)
    a /= np.linalg.norm(a)
    b -= a * (a @ b)
    b /= np.linalg.norm(b)
    v = np.concatenate([v, [np.cos(t) * a + np.sin(t) * b for t in np.arange(0, 3, 0.5)]]).astype(np.float32)
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T >= 0.76
    label = np.arange(len(v))
    while True:
        new = np.array([label[row].min() for row in s])
        if (new == label).all():
            break
        label = new
    got = clusters.similarity_clusters(frame(spark, v, BAD), "id", "e", DIM, 0.76, shard_rows=shard_rows).toPandas().set_index("vec_id").sort_index()
    assert (got["cluster_id"].to_numpy() == label).all()
    assert (got["size"].to_numpy() == np.bincount(label)[label]).all()
    profiles = clusters.cluster_profiles(clusters.similarity_clusters(frame(spark, v), "id", "e", DIM, 0.76)).toPandas()
    assert len(profiles) == len(set(label)) and all(1 <= len(m) <= 3 for m in profiles["medoids"])


def test_pack_is_lossless():
    x = np.random.RandomState(0).randn(50, DIM).astype(np.float32)
    assert (shards.unpack(shards.pack(x), 50, np.float32, DIM) == x).all()
    ids = np.array([-5, 2**60, 0])
    assert (shards.unpack(shards.pack(ids), 3, np.int64) == ids).all()


def test_robust_pruning_keeps_diverse_edges():
    g = knn.Graph(shards.unit(collection(12, 60)))
    assert len(g.nearest(np.arange(3), 5)[0]) == 3
    assert (g.deg > 0).all() and g.adj.max() < len(g.u)
    assert all(i not in g.adj[i] for i in range(len(g.u)))


def test_entry_points_of_scattered_vectors(monkeypatch):
    """More vectors than entry points that no bar brings together: edges reach the rest."""
    monkeypatch.setattr(knn, "ENTRIES", 64)
    u = shards.unit(np.random.RandomState(2).randn(3000, DIM).astype(np.float32))
    g = knn.Graph(u)
    assert len(g.entries) == 3000 // knn.SHARE
    rows = np.arange(0, 3000, 20)
    s = u[rows] @ u.T
    s[np.arange(len(rows)), rows] = -2
    kth = np.sort(s, axis=1)[:, -10]
    near, sims = g.nearest(rows, 10)
    assert (sims >= kth[:, None] - 1e-6).mean() >= 0.95


@pytest.mark.parametrize("shard_rows", [88, 26])
def test_recall_with_hundreds_of_cells(spark, shard_rows):
    """About 400 and 1,200 cells on sf0.1, every twentieth vector against all."""
    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.1/detections.parquet"
    out = knn.nearest_vectors(spark.read.parquet(path), "det_id", "embedding", 128, 10, shard_rows=shard_rows, queries=F.col("det_id") % 20 == 0).toPandas()
    batch = pq.read_table(path, columns=["det_id", "embedding"]).filter(pc.field("embedding").is_valid())
    batch = batch.filter(pc.equal(pc.list_value_length(batch["embedding"]), 128)).combine_chunks().to_batches()[0]
    ids, x, _ = shards.matrix(batch, 128)
    ids, first = np.unique(ids, return_index=True)
    u = shards.unit(x[first])
    rows = np.flatnonzero(ids % 20 == 0)
    s = u[rows] @ u.T
    s[np.arange(len(rows)), rows] = -2
    kth = dict(zip(ids[rows], np.sort(s, axis=1)[:, -10]))
    hits = (out["cosine"] >= out["vec_id"].map(kth) - 1e-6).sum()
    assert set(out["vec_id"]) == set(ids[rows]) and hits / (10 * len(rows)) >= 0.95


def test_two_levels_of_cells(spark, monkeypatch):
    """More cells than one level holds: the lower ones are fitted in tasks, and all still works."""
    monkeypatch.setattr(shards, "MAX_FLAT", 6)
    v = collection(60, 40)
    df = frame(spark, v)
    cells = shards.fit_cells(shards.usable(df, "id", "e", DIM), DIM, shard_rows=100, k=10)
    assert cells.tops is not None and len(cells.centres) > 20 and cells.at[-1] == len(cells.centres)
    out = knn.nearest_vectors(df, "id", "e", DIM, 10, shard_rows=100).toPandas()
    u = shards.unit(v, np.float64)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    kth = np.sort(s, axis=1)[:, -10]
    assert (out["cosine"].to_numpy() >= kth[out["vec_id"]] - 1e-9).sum() / (10 * len(v)) >= 0.95


def test_copies_of_other_lengths_are_one_hot_group(spark):
    rng = np.random.RandomState(4)
    hot = (rng.rand(300, 1) * 9 + 0.1) * rng.randn(1, DIM)
    v = np.concatenate([collection(20, 20), hot.astype(np.float32)])
    cells = shards.fit_cells(shards.usable(frame(spark, v), "id", "e", DIM), DIM)
    assert len(cells.hot) == 1 and (cells.hot_group(v[400:]) == 0).all() and (cells.hot_group(v[:400]) < 0).all()
    out = knn.nearest_vectors(frame(spark, v), "id", "e", DIM, 4).toPandas()
    mine = out[out["vec_id"] >= 400]
    assert len(mine) == 1200 and (mine["cosine"] > 1 - 1e-6).all()
    assert clusters.similarity_clusters(frame(spark, v), "id", "e", DIM, 0.9).filter("vec_id >= 400").select("cluster_id").distinct().count() == 1


def test_an_outlier_is_not_typical(spark):
    """Fifty like vectors, a bridge and an outlier: the outlier is linked by the bridge, but comes last."""
    rng = np.random.RandomState(8)
    base, side = np.eye(DIM)[0], np.eye(DIM)[1]
    v = base + 0.01 * rng.randn(50, DIM)
    turn = lambda t: np.cos(t) * base + np.sin(t) * side
    v = np.concatenate([v, [turn(0.6), turn(1.2)]]).astype(np.float32)
    got = clusters.similarity_clusters(frame(spark, v), "id", "e", DIM, 0.76).toPandas().sort_values(["typical", "vec_id"], ascending=[False, True])
    assert got["cluster_id"].nunique() == 1 and len(got) == 52
    assert list(got["vec_id"][-2:]) == [50, 51]
