"""Shared scans: the same sums as separate fits from the same start, and Spark's own silhouette."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from doctopics.operators import embeddings as emb
from doctopics.operators import kmeans


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 5, (6, 4))
    return np.round(np.vstack([centres[k % 6] + rng.normal(0, 1, 4) for k in range(900)]), 6)


@pytest.fixture(scope="module")
def points(spark, data):
    return spark.createDataFrame([(v.tolist(),) for v in data], "v array<double>").repartition(7).persist()


def alone(data, centres, max_iter=300):
    for _ in range(max_iter):
        near = ((data[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        new = np.array([data[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
        moved = ((new - centres) ** 2).sum(1).max()
        centres = new
        if moved <= kmeans.TOLERANCE**2:
            break
    return float(((data[:, None] - centres[None]) ** 2).sum(-1).min(1).sum())


def test_same_as_separate_fits(points, data):
    settings = [(k, r) for k in (2, 3, 6, 9) for r in range(3)]
    sample = np.array(sorted(data.tolist()))
    for f in kmeans.fit_many(points, settings, seed=7):
        start = kmeans.starting_centres(sample, f.k, 7 + 1000 * f.restart + f.k)
        assert f.sse == pytest.approx(alone(data, start), rel=1e-9)


def test_as_good_as_the_library(points, data):
    curve = dict((k, (sse, s)) for k, sse, s in kmeans.elbow_curve(points.withColumnRenamed("v", "x"), "x", range(2, 8), 10, 42, 300))
    df = points.select(array_to_vector("v").alias("features"))
    for k in (3, 6):
        sse = min(KMeans(k=k, seed=s).fit(df).summary.trainingCost for s in range(5))
        assert curve[k][0] <= 1.001 * sse
    assert max(curve, key=lambda k: curve[k][1]) == 6


def test_silhouettes(spark, points):
    fits = kmeans.fit_many(points, [(2, 0), (6, 0)])
    scores = kmeans.silhouettes(points, [f.centres for f in fits])
    scorer = ClusteringEvaluator(featuresCol="features", predictionCol="prediction", distanceMeasure="squaredEuclidean")
    for f, score in zip(fits, scores):
        centres = F.array(*[F.array(*map(F.lit, c.tolist())) for c in f.centres])
        d = F.transform(centres, lambda c: F.aggregate(F.zip_with("v", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
        placed = points.select(array_to_vector("v").alias("features"), (F.array_position(d, F.array_min(d)) - 1).cast("int").alias("prediction"))
        assert score == pytest.approx(scorer.evaluate(placed), abs=1e-9)


def test_few_points(spark):
    for rows in ([], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[0.0, 0.0], [0.0, 0.0], [4.0, 0.0], None]):
        df = spark.createDataFrame([(v,) for v in rows], "embedding array<double>")
        curve = emb.kmeans_elbow(df, max_k=4, restarts=2).orderBy("k").collect()
        assert len(curve) == (3 if any(rows) else 0) and all(r["sse"] >= 0 and -1 <= r["silhouette"] <= 1 for r in curve)
