"""Matrix factorisations of document vectors: NMF, LSA and PCA.

Documents stay distributed; what reaches the driver is terms x topics and topics x topics.
Row arithmetic runs on Arrow batches, densified a few hundred rows at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doctopics.operators.terms import Vectorizer, top_rows
from doctopics.runtime import sized

# Filled cells times topics worked on at once (16 MB).
BLOCK_CELLS = 2_000_000
# Cells of a block, filled or not, for each filled one, up to which it is multiplied with its empty cells.
DENSE_SHARE = 40
# Largest such block (32 MB).
DENSE_CELLS = 4_000_000


@dataclass(frozen=True)
class SparseRows:
    """Some rows of a sparse matrix: positions and values of the filled cells, and where each row starts."""

    at: np.ndarray
    cells: np.ndarray
    offsets: np.ndarray

    def dense(self, width: int) -> np.ndarray | None:
        """The rows with their empty cells, if a matrix product over these costs less than sums over the filled ones."""
        n = len(self.offsets) - 1
        if n * width > min(DENSE_SHARE * len(self.at), DENSE_CELLS):
            return None
        out = np.zeros((n, width))
        np.add.at(out, (np.repeat(np.arange(n), np.diff(self.offsets)), self.at), self.cells)
        return out

    def times(self, matrix: np.ndarray) -> np.ndarray:
        """rows x matrix, from the filled cells only unless few are empty."""
        whole = self.dense(len(matrix))
        if whole is not None:
            return whole @ matrix
        sums = np.zeros((len(self.at) + 1, matrix.shape[1]))
        np.cumsum(matrix[self.at] * self.cells[:, None], axis=0, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def transposed_times(self, left: np.ndarray, width: int) -> np.ndarray:
        """left' x rows, by adding up the filled cells of each column unless few are empty."""
        whole = self.dense(width)
        if whole is not None:
            return left.T @ whole
        row = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))
        return np.stack([np.bincount(self.at, self.cells * left[row, t], width) for t in range(left.shape[1])])


def _sparse_blocks(indices: pa.Array, values: pa.Array, k: int) -> Iterator[SparseRows]:
    """Sparse rows (Arrow lists of positions and values) in blocks of bounded work, in row order."""
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(indices).to_numpy(zero_copy_only=False))]).astype(int)
    at, cells = indices.flatten().to_numpy(), values.flatten().to_numpy()
    start = 0
    while start < len(indices):
        most = offsets[start] + BLOCK_CELLS // max(k, 1)
        stop = max(start + 1, int(np.searchsorted(offsets, most, "right")) - 1)
        lo, hi = offsets[start], offsets[stop]
        yield SparseRows(at[lo:hi], cells[lo:hi], offsets[start : stop + 1] - lo)
        start = stop


def _sparse_parts(vector_col: str) -> tuple[Column, Column]:
    v = F.unwrap_udt(vector_col)
    return v["indices"], v["values"]


def _row_map(df: DataFrame, vector_col: str, matrix: np.ndarray, out_col: str, fn) -> DataFrame:
    """Apply ``fn`` to the products of the document vectors with ``matrix`` (terms x k)."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def compute(indices: pa.Array, values: pa.Array) -> pa.Array:
        parts = [fn(rows.times(matrix)) for rows in _sparse_blocks(indices, values, matrix.shape[1])]
        if not parts:
            return pa.array([], type=pa.list_(pa.float64()))
        rows = np.vstack(parts)
        ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))

    return df.withColumn(out_col, compute(*_sparse_parts(vector_col)))


def _flip(matrix: np.ndarray) -> np.ndarray:
    """Columns with their largest absolute entry positive."""
    top = matrix[np.abs(matrix).argmax(axis=0), np.arange(matrix.shape[1])]
    return matrix * np.where(top < 0, -1.0, 1.0)


# ---------------------------------------------------------------- linear projections


@dataclass(frozen=True)
class Projection:
    """scores = row x directions - offset."""

    directions: np.ndarray
    strengths: np.ndarray
    offset: np.ndarray | None = None

    @property
    def k(self) -> int:
        return self.directions.shape[1]

    def head(self, k: int) -> Projection:
        """The first ``k`` directions: no second fit needed for a smaller k."""
        offset = None if self.offset is None else self.offset[:k]
        return Projection(self.directions[:, :k], self.strengths[:k], offset)

    def transform(self, df: DataFrame, vector_col: str = "features", out_col: str = "scores") -> DataFrame:
        directions, offset = self.directions, 0.0 if self.offset is None else self.offset
        return _row_map(df, vector_col, directions, out_col, lambda product: product - offset)

    def loadings(self, spark) -> DataFrame:
        """``(component, term_id, weight)``."""
        rows = [(c, t, float(w)) for t, row in enumerate(self.directions) for c, w in enumerate(row)]
        return spark.createDataFrame(rows, "component int, term_id int, weight double")


def _gram(df: DataFrame, vector_col: str) -> np.ndarray:
    """X'X, summed over the executors; terms x terms is the model state of both projections."""
    rows = MLUtils.convertVectorColumnsFromML(df.select(F.col(vector_col).alias("v")), "v")
    return RowMatrix(rows).computeGramianMatrix().toArray()


def _top_directions(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(values)[::-1][:k]
    return np.maximum(values[order], 0.0), _flip(vectors[:, order])


def lsa_fit(df: DataFrame, k: int, vector_col: str = "features") -> Projection:
    """Truncated SVD without centring."""
    values, directions = _top_directions(_gram(df, vector_col), k)
    return Projection(directions, np.sqrt(values))


def pca_fit(df: DataFrame, k: int = 4, vector_col: str = "features") -> Projection:
    """Centred PCA."""
    mean, n = df.agg(Summarizer.mean(F.col(vector_col)), F.count("*")).first()
    mean = mean.toArray()
    covariance = (_gram(df, vector_col) - n * np.outer(mean, mean)) / max(n - 1, 1)
    values, directions = _top_directions(covariance, k)
    return Projection(directions, values, mean @ directions)


def pca_topic_terms(loadings: DataFrame, vectorizer: Vectorizer, n: int = 10) -> DataFrame:
    """Terms with the highest signed loading per component."""
    best = top_rows(loadings, n, [F.desc("weight"), F.desc("term_id")], ["component"])
    return vectorizer.with_terms(best).select("component", "rank", "term", "weight")


# ---------------------------------------------------------------- non-negative factorisation


def _nonnegative_rows(target: np.ndarray, gram: np.ndarray, sweeps: int) -> np.ndarray:
    """Cyclic coordinate descent for min ||X - W h||, W >= 0, from X h' and h h'."""
    # a topic a row, so that each step reads whole rows
    w, aim = np.zeros(target.T.shape), np.ascontiguousarray(target.T)
    scale = np.maximum(np.diag(gram), 1e-12)
    for _ in range(sweeps):
        before = w.copy()
        for t in range(len(gram)):
            w[t] = np.maximum(0.0, w[t] - (gram[t] @ w - aim[t]) / scale[t])
        if np.abs(w - before).max(initial=0.0) <= 1e-6 * max(np.abs(w).max(initial=0.0), 1e-12):
            break
    return w.T


@dataclass(frozen=True)
class NmfModel:
    """Topic-term matrix H (k x m) with the objective after each round."""

    h: np.ndarray
    objective: list[float] = field(default_factory=list)

    @property
    def k(self) -> int:
        return len(self.h)

    def transform(self, df: DataFrame, vector_col: str = "features", out_col: str = "scores", sweeps: int = 50) -> DataFrame:
        """Non-negative topic weights per document."""
        h = self.h
        gram = h @ h.T
        return _row_map(df, vector_col, h.T.copy(), out_col, lambda product: _nonnegative_rows(product, gram, sweeps))

    def topic_terms(self, spark) -> DataFrame:
        rows = [(t, i, float(w)) for t, row in enumerate(self.h) for i, w in enumerate(row)]
        return spark.createDataFrame(rows, "topic int, term_id int, weight double")


def nmf_start(svd: Projection, k: int, mean: float) -> np.ndarray:
    """Start from the dominant sign part of each SVD direction; zeros become the mean."""
    v = svd.directions[:, :k].T
    positive, negative = np.maximum(v, 0), np.maximum(-v, 0)
    pick = np.linalg.norm(positive, axis=1) >= np.linalg.norm(negative, axis=1)
    h = np.where(pick[:, None], positive, negative) * np.sqrt(svd.strengths[:k])[:, None]
    return np.where(h <= 1e-12, mean, h)


def nmf_fit(
    df: DataFrame,
    k: int,
    n_terms: int,
    max_iter: int = 500,
    tol: float = 1e-4,
    sweeps: int = 8,
    svd: Projection | None = None,
    vector_col: str = "features",
) -> NmfModel:
    """Alternating non-negative least squares on persisted vectors.

    The document side is solved afresh from the broadcast topic matrix in each round, so no per-document
    state is kept between rounds: nothing to checkpoint, and a lost executor only repeats its blocks.
    Each task sends k rows of partial sums of W'X and W'W, added up by topic.
    """
    indices, values = _sparse_parts(vector_col)
    rows = df.select(indices.alias("indices"), values.alias("values"))
    rows = sized(rows, df.count(), 8 * n_terms).persist()
    square = F.aggregate("values", F.lit(0.0), lambda a, x: a + x * x)
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    norm, mean, n = rows.agg(F.sum(square), F.sum(total), F.count("*")).first()
    norm, mean = float(norm or 0), float(mean or 0) / max(n * n_terms, 1)
    if svd is None:
        svd = lsa_fit(df, min(k, n_terms - 1), vector_col)
    h = nmf_start(svd, k, mean)
    if len(h) < k:
        h = np.vstack([h, np.full((k - len(h), n_terms), mean) * (1 + np.arange(k - len(h))[:, None])])
    objective: list[float] = []
    for _ in range(max_iter):
        wtx, wtw = _partial_sums(rows, h, sweeps)
        for _ in range(sweeps):
            for t in range(k):
                if wtw[t, t] > 1e-12:
                    h[t] = np.maximum(0.0, h[t] + (wtx[t] - wtw[t] @ h) / wtw[t, t])
        objective.append(0.5 * (norm - 2 * float((h * wtx).sum()) + float((wtw * (h @ h.T)).sum())))
        if len(objective) > 1 and objective[-2] - objective[-1] <= tol * max(objective[0], 1e-12):
            break
    rows.unpersist()
    return NmfModel(h, objective)


def _partial_sums(rows: DataFrame, h: np.ndarray, sweeps: int) -> tuple[np.ndarray, np.ndarray]:
    """W'X and W'W for the best W given ``h``."""
    gram, topics, (k, width) = h @ h.T, h.T.copy(), h.shape
    schema = pa.schema([("topic", pa.int32()), ("sums", pa.list_(pa.float64()))])

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = np.zeros((k, width + k)), False
        for batch in batches:
            for block in _sparse_blocks(batch.column("indices"), batch.column("values"), k):
                w = _nonnegative_rows(block.times(topics), gram, sweeps)
                sums += np.hstack([block.transposed_times(w, width), w.T @ w])
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(list(sums))], schema=schema)

    parts = rows.mapInArrow(partials, "topic int, sums array<double>")
    added = parts.groupBy("topic").agg(Summarizer.sum(array_to_vector("sums")).alias("s"))
    out = np.zeros((k, width + k))
    for r in added.select("topic", vector_to_array("s").alias("s")).collect():
        out[r["topic"]] = r["s"]
    return out[:, :width], out[:, width:]


def scores_as_vector(df: DataFrame, k: int | None = None, scores_col: str = "scores", out_col: str = "features") -> DataFrame:
    """Score arrays (or their first ``k`` entries) as a vector column for classifiers."""
    scores = F.slice(scores_col, 1, k) if k else F.col(scores_col)
    return df.withColumn(out_col, array_to_vector(scores))

