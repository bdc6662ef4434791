"""Composed topic models on document vectors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctopics.operators import embeddings as emb
from doctopics.operators.density import density_cluster
from doctopics.operators.describe import class_tfidf, reduce_topics, topic_info, topic_words_scored
from doctopics.operators.evaluation import model_metrics
from doctopics.runtime import materialise

OUTLIER = -1


@dataclass(frozen=True)
class TopicJob:
    """``assignments``: split, doc_id, label0, topic (and score); ``topics``: words per topic; ``metrics``: per split."""

    assignments: DataFrame
    topics: DataFrame
    metrics: DataFrame
    hierarchy: DataFrame


def _splits(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter("split = 'train'"), df.filter("split = 'test'")


def bertopic_job(
    df: DataFrame, k: int = 4, dims: int = 5, min_cluster_size: int = 10, min_samples: int = 5, n_words: int = 10
) -> TopicJob:
    """Reduce vectors, cluster by density, describe by class TF-IDF, merge to k topics, place test rows and outliers.

    ``df``: doc_id, split, label0, tokens, embedding; a table, it is read several times.
    """
    train, _ = _splits(df)
    reduced = materialise(emb.reduce_dims(df, k=dims, fit_on=train).drop("embedding"), "reduced")
    train, test = _splits(reduced)
    clustered = materialise(
        density_cluster(train, min_cluster_size=min_cluster_size, min_samples=min_samples), "clustered"
    )
    hierarchy = reduce_topics(class_tfidf(clustered), topic_info(clustered), k + 1).withColumnRenamed("topic", "orig_topic")
    merged = emb.map_reduced_topics(clustered, hierarchy)
    centroids = emb.topic_centroids(merged, "reduced", unit=False).persist()
    topics = [r["topic"] for r in centroids.select("topic").orderBy("topic").collect()]
    # Test rows go to their nearest topic, which is also where an outlier's membership is highest.
    open_rows = merged.unionByName(test.withColumn("topic", F.lit(OUTLIER)))
    placed = emb.assign_outliers(emb.topic_probabilities(open_rows, centroids, "reduced"), topics)
    assigned = materialise(placed.select("split", "doc_id", "label0", "topic", "tokens"), "assigned")
    words = topic_words_scored(class_tfidf(assigned.filter("split = 'train'")), n_words)
    metrics = model_metrics(assigned, by=["split"])
    return TopicJob(assigned.drop("tokens"), words, metrics, hierarchy)


def top2vec_job(
    df: DataFrame,
    words: DataFrame,
    k: int = 4,
    dims: int = 5,
    min_cluster_size: int = 10,
    min_samples: int = 5,
    n_words: int = 10,
    reducer: Callable[..., DataFrame] = emb.reduce_dims,
) -> TopicJob:
    """Density clusters of the training vectors give topic vectors; documents and words join their nearest topic.

    ``df``: doc_id, split, label0, embedding; ``words``: term, vector in the same space. ``reducer`` makes the vectors that are
    clustered: main directions, or ``neighbours.reduce_neighbours``.
    """
    train, _ = _splits(df)
    reduced = reducer(train.select("doc_id", "embedding"), k=dims)
    clusters = density_cluster(reduced, min_cluster_size=min_cluster_size, min_samples=min_samples)
    centroids = emb.topic_centroids(clusters).persist()
    topics = emb.topic_nearest_words(words, centroids, n_words)
    hierarchy = emb.hierarchical_reduction(centroids, k)
    nearest = emb.assign_to_nearest_topic(df, centroids)
    assigned = materialise(
        emb.map_reduced_topics(nearest, hierarchy).select("split", "doc_id", "label0", "topic", "score"), "assigned"
    )
    return TopicJob(assigned, topics, model_metrics(assigned, by=["split"]), hierarchy)


def select_best_encoder(encoders: dict[str, Callable[[], DataFrame]], **options) -> tuple[str | None, dict[str, TopicJob], DataFrame]:
    """Run ``bertopic_job`` on the table of each encoder; best is the highest test NMI, the first on ties."""
    jobs = {name: bertopic_job(build(), **options) for name, build in encoders.items()}
    board = None
    for order, (name, job) in enumerate(jobs.items()):
        rows = job.metrics.withColumns({"encoder": F.lit(name), "encoder_order": F.lit(order)})
        board = rows if board is None else board.unionByName(rows)
    board = materialise(board, "encoders")
    best = (
        board.filter("split = 'test' AND NMI IS NOT NULL").orderBy(F.desc("NMI"), "encoder_order").select("encoder").first()
    )
    return (best["encoder"] if best else None), jobs, board
