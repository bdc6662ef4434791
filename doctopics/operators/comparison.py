"""Voting ensembles and model comparison tables."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doctopics.constants import BEST_MODEL_METRICS, CLUSTER_METRICS
from doctopics.runtime import materialise


def ensemble_vote(
    df: DataFrame,
    id_cols: Sequence[str] = ("doc_id",),
    topic_col: str = "topic",
    order_col: str = "model_order",
    models: int | None = None,
) -> DataFrame:
    """Most frequent topic per document; a tie goes to the model listed first.

    One shuffle by document; a document holds one vote per model, so its group is small.
    Topic ids are compared as they are; pass aligned labels as ``topic_col`` to vote on labels.
    """
    if models is None:
        models = df.select(order_col).distinct().count()
    if models < 2:
        return df.filter(F.lit(False)).select(*id_cols, topic_col)
    votes = df.groupBy(*id_cols).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(topic_col).alias("t")))).alias("votes")
    )
    topics = F.transform("votes", lambda v: v["t"])
    counted = F.transform("_t", lambda t: F.size(F.filter("_t", lambda u: u == t)))
    winner = F.get("_t", F.array_position("_n", F.array_max("_n")).cast("int") - 1)
    return (
        votes.withColumn("_t", topics)
        .withColumn("_n", counted)
        .select(*id_cols, winner.alias(topic_col))
    )


def ensemble_vote_aligned(
    df: DataFrame, label_col: str = "label0", topic_col: str = "topic", model_col: str = "model", **columns
) -> DataFrame:
    """Vote on labels after aligning each model's topics to them; outliers do not vote."""
    from doctopics.operators.evaluation import align_topics, aligned_predictions, contingency, drop_unassigned

    kept = drop_unassigned(df, label_col, topic_col)
    alignment = align_topics(contingency(kept, label_col, topic_col, [model_col]), [model_col])
    aligned = aligned_predictions(kept, alignment, topic_col, [model_col], "_aligned")
    return ensemble_vote(aligned.drop(topic_col).withColumnRenamed("_aligned", topic_col), topic_col=topic_col, **columns)


def leaderboard(metrics: DataFrame, exclude: Sequence[str] = ("Transformer",), digits: int = 4) -> DataFrame:
    """Test metrics per model in long form ``(model, metric, value)`` to one rounded row per model."""
    kept = metrics.filter(~F.col("model").isin(*exclude)) if exclude else metrics
    wide = kept.groupBy("model").pivot("metric", BEST_MODEL_METRICS + ["Macro_F1", "Weighted_F1"]).agg(F.first("value"))
    numbers = [n for n in wide.columns if n != "model"]
    return wide.select("model", *[F.round(f"`{n}`", digits).alias(n) for n in numbers])


def unpivot_metrics(wide: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """One row per model and metric."""
    names = [n for n in wide.columns if n not in keys]
    return wide.unpivot([F.col(k) for k in keys], [F.col(f"`{n}`") for n in names], "metric", "value")


def best_model_per_metric(
    board: DataFrame, metrics: Sequence[str] = BEST_MODEL_METRICS, order_col: str = "model_order"
) -> DataFrame:
    """Model with the highest value of each metric, the one listed first on ties."""
    long = unpivot_metrics(board.select("model", order_col, *[F.col(f"`{m}`") for m in metrics]), ("model", order_col))
    best = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc_nulls_last("value"), order_col))
    return long.filter(F.col("value").isNotNull()).withColumn("_r", best).filter("_r = 1").drop("_r", order_col)


def best_accuracy(results: DataFrame, by: Sequence[str] = ("experiment",)) -> DataFrame:
    return results.groupBy(*by).agg(F.max("Accuracy").alias("Accuracy"))


def accuracy_curves(
    results: DataFrame, x_col: str, series: Sequence[str] = (), classifiers: Sequence[str] | None = None
) -> DataFrame:
    """Accuracy by ``x_col`` with one column per classifier: the data behind an accuracy plot."""
    grouped = results.groupBy(*series, x_col)
    pivoted = grouped.pivot("Classifier", list(classifiers)) if classifiers else grouped.pivot("Classifier")
    return pivoted.agg(F.first("Accuracy")).orderBy(*series, x_col)


FINAL_COLUMNS = ["Model", "Coherence", "Diversity", *CLUSTER_METRICS, "Accuracy", "Runtime (s)"]


def final_comparison(parts: Sequence[DataFrame]) -> DataFrame:
    """All models in one table; null where a model has no such value."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    have = set(out.columns)
    return out.select(
        *[F.col(f"`{n}`") if n in have else F.lit(None).cast("double").alias(n) for n in FINAL_COLUMNS]
    )


def timed(build: Callable[[], DataFrame]) -> tuple[DataFrame, float]:
    """The rows of a job, written once, and the seconds it took."""
    start = time.monotonic()
    rows = materialise(build(), "timed")
    return rows, time.monotonic() - start


def job_runs(spark: SparkSession, jobs: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """Run named jobs to completion without keeping their rows; one row ``(job, rows, seconds)`` each."""
    from pyspark.sql import Observation

    runs = []
    for name, build in jobs.items():
        start = time.monotonic()
        seen = Observation()
        build().observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
        runs.append((name, int(seen.get["n"]), time.monotonic() - start))
    return spark.createDataFrame(runs, "job string, rows long, seconds double")
