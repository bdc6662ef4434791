"""Document vectors, reduction, centroids and nearest topics.

Topic matrices (topics x dimensions) are model state and travel with the task; documents are never
joined with each other. Vector arithmetic runs on whole Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from doctopics.operators.describe import merge_smallest
from doctopics.operators.encoders import WordVectors, fit_pmi, fit_word2vec
from doctopics.operators.kmeans import elbow_curve
from doctopics.operators.terms import top_rows
from doctopics.runtime import counted_broadcast
from doctopics.sources.selection import cut_points

OUTLIER = -1


def _as_matrix(values: pa.Array, width: int) -> np.ndarray:
    """Arrow list column to a 2-D array; a null row becomes zeros."""
    out = np.zeros((len(values), width))
    known = values.is_valid().to_numpy(zero_copy_only=False)
    out[known] = values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
    return out


def _as_lists(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel(), type=pa.float64()))


def _per_topic(matrix: np.ndarray, fn: Callable[[np.ndarray, np.ndarray], np.ndarray], c: Column) -> Column:
    """One number per topic for each document vector."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def compute(values: pa.Array) -> pa.Array:
        return _as_lists(fn(_as_matrix(values, matrix.shape[1]), matrix))

    return compute(c)


def _cosines(rows: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    units = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    return rows @ units.T / np.maximum(lengths, 1e-300)


def _distances(rows: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    squared = (rows**2).sum(1)[:, None] - 2 * rows @ matrix.T + (matrix**2).sum(1)[None, :]
    return np.sqrt(np.maximum(squared, 0))


def _inverse_distance_shares(rows: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    inverse = 1.0 / np.maximum(_distances(rows, matrix), 1e-12)
    return inverse / inverse.sum(axis=1, keepdims=True)


# ---------------------------------------------------------------- encoders


def embed_word2vec(df: DataFrame, tokens_col: str = "tokens", out_col: str = "embedding", **options) -> tuple[DataFrame, DataFrame]:
    """Documents with the mean of their words' vectors, and the trained words ``(term, vector)``, in one space.

    Options are those of ``encoders.fit_word2vec``; words that were not trained have vectors by their parts.
    """
    return _embedded(fit_word2vec(df, tokens_col, **options), df, tokens_col, out_col)


def embed_pmi(df: DataFrame, tokens_col: str = "tokens", out_col: str = "embedding", **options) -> tuple[DataFrame, DataFrame]:
    """The same with vectors from mutual information (``encoders.fit_pmi``)."""
    return _embedded(fit_pmi(df, tokens_col, **options), df, tokens_col, out_col)


def _embedded(vectors: WordVectors, df: DataFrame, tokens_col: str, out_col: str) -> tuple[DataFrame, DataFrame]:
    return vectors.embed(df, tokens_col, out_col), vectors.table(df.sparkSession)


def embed_with(
    df: DataFrame, encoder: Callable[[list[str]], np.ndarray], text_col: str = "text", out_col: str = "embedding"
) -> DataFrame:
    """Apply a user's encoder to batches of texts on the executors."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def encode(texts: pa.Array) -> pa.Array:
        rows = np.asarray(encoder(texts.to_pylist()), dtype=np.float32)
        return pa.array(list(rows), type=pa.list_(pa.float32()))

    return df.withColumn(out_col, encode(F.col(text_col)))


def reduce_dims(
    df: DataFrame, vector_col: str = "embedding", out_col: str = "reduced", k: int = 5, cosine: bool = True, fit_on: DataFrame | None = None
) -> DataFrame:
    """Unit-length vectors projected on their ``k`` main directions; the dims x dims covariance is the only state."""

    def prepared(frame: DataFrame) -> DataFrame:
        frame = frame.withColumn("_v", array_to_vector(F.col(vector_col).cast("array<double>")))
        if not cosine:
            return frame.withColumnRenamed("_v", "_u")
        return Normalizer(p=2.0, inputCol="_v", outputCol="_u").transform(frame).drop("_v")

    model = PCA(k=k, inputCol="_u", outputCol="_p").fit(prepared(df if fit_on is None else fit_on))
    return model.transform(prepared(df)).withColumn(out_col, vector_to_array("_p")).drop("_u", "_p")


# ---------------------------------------------------------------- number of clusters


def kmeans_elbow(
    df: DataFrame, vector_col: str = "embedding", max_k: int = 15, restarts: int = 10, seed: int = 42, max_iter: int = 300
) -> DataFrame:
    """``(k, sse, silhouette)`` for k = 2..max_k, the best of several restarts each; all fits share each scan (``kmeans``)."""
    rows = elbow_curve(df, vector_col, range(2, max_k + 1), restarts, seed, max_iter)
    return df.sparkSession.createDataFrame(rows, "k int, sse double, silhouette double")


def elbow_point(curve: DataFrame) -> DataFrame:
    """k at the largest second difference of the SSE and k of the best silhouette; first on ties."""
    w = Window.orderBy("k")
    second = F.col("sse") - 2 * F.lag("sse", 1).over(w) + F.lag("sse", 2).over(w)
    bends = curve.withColumn("bend", second)
    return bends.agg(
        F.max_by("k", F.when(F.col("bend").isNotNull(), F.struct("bend", -F.col("k")))).alias("elbow_k"),
        F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("best_silhouette_k"),
    )


# ---------------------------------------------------------------- centroids and nearest topics


def topic_centroids(df: DataFrame, vector_col: str = "embedding", topic_col: str = "topic", unit: bool = True) -> DataFrame:
    """Mean vector per topic (outliers left out), scaled to length one. Map-side combined."""
    vector = array_to_vector(F.col(vector_col).cast("array<double>"))
    means = (
        df.filter(F.col(topic_col) != OUTLIER)
        .groupBy(F.col(topic_col).alias("topic"))
        .agg(Summarizer.mean(vector).alias("m"), F.count("*").alias("size"))
    )
    if unit:
        means = Normalizer(p=2.0, inputCol="m", outputCol="u").transform(means).drop("m").withColumnRenamed("u", "m")
    return means.select("topic", "size", vector_to_array("m").alias("vector"))


def _topic_matrix(centroids: DataFrame) -> tuple[list[int], np.ndarray]:
    rows = centroids.select("topic", "vector").orderBy("topic").collect()
    return [r["topic"] for r in rows], np.asarray([r["vector"] for r in rows], dtype=float)


def assign_to_nearest_topic(
    df: DataFrame, centroids: DataFrame, vector_col: str = "embedding", topic_col: str = "topic", score_col: str = "score"
) -> DataFrame:
    """Topic with the highest cosine (lowest id on ties) and the cosine; without topics or vector -1 and 0."""
    topics, matrix = _topic_matrix(centroids)
    if not topics:
        return df.withColumns({topic_col: F.lit(OUTLIER), score_col: F.lit(0.0)})
    scored = df.withColumn("_s", _per_topic(matrix, _cosines, F.col(vector_col)))
    best = F.array_max("_s")
    ids = F.array(*[F.lit(t) for t in topics])
    found = F.col(vector_col).isNotNull()
    return scored.withColumns(
        {
            topic_col: F.when(found, F.get(ids, F.array_position("_s", best).cast("int") - 1)).otherwise(OUTLIER),
            score_col: F.when(found, best).otherwise(0.0),
        }
    ).drop("_s")


def topic_probabilities(
    df: DataFrame, centroids: DataFrame, vector_col: str = "embedding", out_col: str = "probabilities"
) -> DataFrame:
    """Membership over topics (in topic order): inverse distances to the centroids, scaled to sum one."""
    _, matrix = _topic_matrix(centroids)
    return df.withColumn(out_col, _per_topic(matrix, _inverse_distance_shares, F.col(vector_col)))


def assign_outliers(
    df: DataFrame, topics: Sequence[int], topic_col: str = "topic", probabilities_col: str = "probabilities"
) -> DataFrame:
    """Outliers get their most probable topic."""
    ids = F.array(*[F.lit(t) for t in topics])
    best = F.array_position(probabilities_col, F.array_max(probabilities_col)).cast("int") - 1
    return df.withColumn(topic_col, F.when(F.col(topic_col) == OUTLIER, F.get(ids, best)).otherwise(F.col(topic_col)))


def topic_nearest_words(
    words: DataFrame, centroids: DataFrame, n: int = 10, term_col: str = "term", vector_col: str = "vector"
) -> DataFrame:
    """Words closest to each topic vector by cosine."""
    topics, matrix = _topic_matrix(centroids)
    scored = words.select(
        F.col(term_col).alias("term"),
        F.arrays_zip(
            F.array(*[F.lit(t) for t in topics]).alias("topic"),
            _per_topic(matrix, _cosines, F.col(vector_col)).alias("score"),
        ).alias("z"),
    )
    long = scored.select("term", F.inline("z"))
    return top_rows(long, n, [F.desc("score"), "term"], ["topic"]).select("topic", "rank", "term", "score")


# ---------------------------------------------------------------- reduction of topics


def hierarchical_reduction(centroids: DataFrame, num_topics: int) -> DataFrame:
    """Merge topics by size and similarity until ``num_topics`` are left; identity if there are no more."""
    rows = centroids.orderBy("topic").collect()
    matrix = np.asarray([r["vector"] for r in rows], dtype=float)
    groups = merge_smallest(matrix @ matrix.T, [r["size"] for r in rows], num_topics)
    pairs = [(rows[i]["topic"], new) for new, group in enumerate(groups) for i in group]
    return centroids.sparkSession.createDataFrame(pairs, "orig_topic int, reduced_topic int")


def map_reduced_topics(df: DataFrame, hierarchy: DataFrame, topic_col: str = "topic") -> DataFrame:
    """Original topic id replaced by the reduced one; unmatched ids become -1."""
    side = hierarchy.select(F.col("orig_topic").alias(topic_col), F.col("reduced_topic").alias("_reduced"))
    joined = df.join(counted_broadcast(side), topic_col, "left")
    return joined.withColumn(topic_col, F.coalesce("_reduced", F.lit(OUTLIER))).drop("_reduced")


def assignment_quality(df: DataFrame, topic_col: str = "topic", score_col: str = "score") -> DataFrame:
    """Number of assigned documents, mean and exact median of their scores.

    The median is read off a narrowing histogram; scores never meet in one task.
    """
    assigned = df.filter(F.col(topic_col) != OUTLIER).select(F.col(score_col).cast("double").alias("s"))
    counts = df.agg(
        F.count("*").alias("documents"),
        F.count_if(F.col(topic_col) != OUTLIER).alias("assigned"),
        F.avg(F.when(F.col(topic_col) != OUTLIER, F.col(score_col))).alias("mean_score"),
    )
    assigned = assigned.persist()  # the median reads the scores several times
    median = exact_median(assigned, "s")
    assigned.unpersist()
    return counts.withColumn("median_score", F.lit(median).cast("double"))


# Cosines are compared as integers of this resolution.
COSINE_STEPS = 10**15


def exact_median(df: DataFrame, column: str) -> float | None:
    """Median of a cosine column (values in [-1, 1]), to 1e-15."""
    keyed = df.select(F.round(F.col(column) * F.lit(float(COSINE_STEPS))).cast("long").alias("k")).filter("k IS NOT NULL")
    n = keyed.count()
    if n == 0:
        return None
    lower, upper = cut_points(keyed, "k", [(n - 1) // 2, n // 2])
    return (lower + upper) / 2 / COSINE_STEPS
