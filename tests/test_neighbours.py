"""Neighbour graphs and the coordinates made from them."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from doctopics.operators import embeddings as emb
from doctopics.operators import neighbours


def frame(spark, x, kind="array<double>"):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], f"doc_id long, embedding {kind}")


def brute(x, k):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1)[:, :k], d


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16)) * 3
    x = centres[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 16))
    graph = neighbours.neighbour_graph(frame(spark, x), k=10, cosine=False, leaf_points=128, trees=2)
    rows = {tuple(r["v"]): r["id"] for r in graph.points.collect()}
    at = {rows[tuple(v)]: i for i, v in enumerate(x)}
    true, d = brute(x, 10)
    found = {at[r["id"]]: [(p["d"], at[p["b"]]) for p in r["near"]] for r in graph.lists.collect()}
    assert len(found) == 1500 and graph.trees > 2
    met = np.mean([len(set(true[i]) & {j for _, j in found[i]}) / 10 for i in found])
    assert met >= 0.9 and abs(met - graph.recall) < 0.05
    for i, near in found.items():
        assert len(near) == 10 and near == sorted(near) and all(abs(d[i, j] - x_) < 1e-9 for x_, j in near)


def test_one_leaf_is_exact(spark):
    x = np.random.default_rng(2).normal(size=(120, 4))
    graph = neighbours.neighbour_graph(frame(spark, x), k=5)
    unit = {r["id"]: np.array(r["v"]) for r in graph.points.collect()}
    ids = sorted(unit)
    true, _ = brute(np.array([unit[i] for i in ids]), 5)
    assert graph.recall == 1.0
    for r in graph.lists.collect():
        assert [p["b"] for p in r["near"]] == [ids[j] for j in true[ids.index(r["id"])]]


def test_large_leaves_are_split_and_lose_no_point(spark, monkeypatch):
    """A sample of a few points makes uneven leaves; every point still has neighbours."""
    monkeypatch.setattr(neighbours, "SAMPLE", 5)
    x = np.random.default_rng(3).normal(size=(600, 3)) ** 3
    graph = neighbours.neighbour_graph(frame(spark, x), k=4, cosine=False, leaf_points=32, recall=0.9)
    assert graph.recall >= 0.9
    assert graph.lists.filter(F.size("near") == 4).count() == 600


def rings(n=150):
    rng = np.random.default_rng(4)
    angle = rng.uniform(0, 2 * np.pi, 2 * n)
    radius = np.where(np.arange(2 * n) < n, 1.0, 3.0) + rng.normal(size=2 * n) * 0.05
    return np.c_[radius * np.cos(angle), radius * np.sin(angle)], np.arange(2 * n) < n


def cut_error(values, inner):
    """Share on the wrong side of the best threshold."""
    order = inner[np.argsort(values)]
    left = np.cumsum(order)
    wrong = np.arange(1, len(order) + 1) - left + (order.sum() - left)
    return min(wrong.min(), len(order) - wrong.max()) / len(order)


def test_rings_that_a_projection_mixes(spark):
    x, inner = rings()
    df = frame(spark, x)
    flat = np.array([r["reduced"] for r in emb.reduce_dims(df, k=2, cosine=False).orderBy("doc_id").collect()])
    bent = np.array([r["reduced"] for r in neighbours.reduce_neighbours(df, k=2, cosine=False, neighbours=8, tol=1e-3).orderBy("doc_id").collect()])
    assert min(cut_error(flat[:, j], inner) for j in range(2)) > 0.2
    assert min(cut_error(bent[:, j], inner) for j in range(2)) == 0


def test_coordinates_are_eigenvectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "HUB_EDGES", 7)  # vertices joined in parts give the same
    x = np.random.default_rng(5).normal(size=(90, 3))
    graph = neighbours.neighbour_graph(frame(spark, x), k=6, cosine=False)
    edges = neighbours.weighted_edges(graph.lists)
    found = neighbours.spectral_coordinates(edges, k=3, tol=1e-5, max_rounds=20)
    ids = [r["id"] for r in graph.points.orderBy("id").collect()]
    a = np.zeros((90, 90))
    for r in edges.collect():
        a[ids.index(r["a"]), ids.index(r["b"])] = r["w"]
    assert np.allclose(a, a.T)
    deg = a.sum(1)
    normal = a / np.sqrt(np.outer(deg, deg))
    assert np.allclose(found.values, np.sort(np.linalg.eigvalsh(normal))[::-1][1:4], atol=1e-6)
    z = np.array([r["reduced"] for r in found.coordinates.orderBy("id").collect()])
    assert np.allclose((a / deg[:, None]) @ z, z * found.values, atol=1e-3)
    assert np.allclose(z.T @ (z * deg[:, None]) / deg.sum(), np.eye(3), atol=1e-6)


def test_copies_missing_and_odd_vectors(spark):
    rows = [[1.0, 0.0], [2.0, 0.0], [0.0, 1.0], [1.0, 1.0], None, [], [0.0, 0.0], [float("nan"), 1.0], [None, 1.0], [float("inf"), 0.0]] + [[-1.0, 0.5]] * 40
    df = spark.createDataFrame([(i, v, i) for i, v in enumerate(rows)], "doc_id long, embedding array<double>, n long")
    out = {r["doc_id"]: r for r in neighbours.reduce_neighbours(df, k=2).collect()}
    assert sorted(out) == list(range(len(rows))) and out[3]["n"] == 3
    assert all(out[i]["reduced"] == [0.0, 0.0] for i in range(4, 10))
    assert out[0]["reduced"] == out[1]["reduced"] != out[2]["reduced"]
    assert len({tuple(out[i]["reduced"]) for i in range(10, 50)}) == 1 and any(out[10]["reduced"])


@pytest.mark.parametrize("rows", [[], [[1.0, 2.0]], [[1.0, 2.0], [2.0, 1.0]], [[1.0, 2.0], [2.0, 4.0]]])
def test_hardly_any_points(spark, rows):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "doc_id long, embedding array<double>")
    out = neighbours.reduce_neighbours(df, k=3).collect()
    assert len(out) == len(rows) and all(len(r["reduced"]) == 3 for r in out)
