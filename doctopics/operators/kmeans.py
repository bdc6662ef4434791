"""Many k-means fits in shared scans: every k and every restart moves its centres in the same pass over the points.

A round ships all centres still moving (fits x k x dimensions numbers, whatever the data), each task adds up the points
nearest to each centre, and sums per centre come back. Fits that have settled drop out. Starting centres are drawn by
k-means++ from a bounded sample, which is the sampling of the start only; every round reads every point. Squared Euclidean
silhouettes of several fits come from one more pass, by the sums of each cluster.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctopics.runtime import materialise, spread

START_SAMPLE = 10_000
SLICE_ROWS = 1024
TOLERANCE = 1e-4
KIND = "fit int, centre int, n long, sse double, sums array<double>, squares double"


@dataclass(frozen=True)
class Fit:
    k: int
    restart: int
    centres: np.ndarray
    sse: float
    rounds: int


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        lists = batch.column(0)
        if batch.num_rows:
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            for start in range(0, len(x), SLICE_ROWS):
                yield x[start : start + SLICE_ROWS]


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None], 0.0)


def _scan(points: DataFrame, centres: list[np.ndarray]) -> dict[tuple[int, int], tuple]:
    """Per fit and centre: points, their squared distance, their sum and the sum of their squares."""
    spark = points.sparkSession
    shared = spark.sparkContext.broadcast((np.vstack(centres), np.cumsum([0, *map(len, centres)])))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, at = shared.value
        n, sse = np.zeros(len(every), np.int64), np.zeros(len(every))
        sums, squares = np.zeros_like(every), np.zeros(len(every))
        for x in _rows(batches):
            d, norms = _squared(x, every), (x**2).sum(1)
            for a, b in zip(at, at[1:]):
                near = d[:, a:b].argmin(1)
                size = b - a
                n[a:b] += np.bincount(near, minlength=size)
                sse[a:b] += np.bincount(near, d[np.arange(len(x)), a + near], size)
                squares[a:b] += np.bincount(near, norms, size)
                own = np.zeros((size, len(x)))
                own[near, np.arange(len(x))] = 1.0
                sums[a:b] += own @ x
        fit = np.repeat(np.arange(len(at) - 1), np.diff(at))
        ends = np.arange(len(every) + 1, dtype=np.int32) * every.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(sums.ravel()))
        columns = [pa.array(fit.astype(np.int32)), pa.array((np.arange(len(every)) - at[fit]).astype(np.int32)), pa.array(n), pa.array(sse), lists, pa.array(squares)]
        yield pa.record_batch(columns, names=["fit", "centre", "n", "sse", "sums", "squares"])

    parts = points.mapInArrow(add, KIND)
    width = centres[0].shape[1]
    total = F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)])
    rows = parts.groupBy("fit", "centre").agg(F.sum("n").alias("n"), F.sum("sse").alias("sse"), total.alias("sums"), F.sum("squares").alias("squares")).collect()
    shared.unpersist()
    return {(r["fit"], r["centre"]): (r["n"], r["sse"], np.array(r["sums"]), r["squares"]) for r in rows}


def starting_centres(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ on the sample; with fewer different rows than ``k``, all of them."""
    rng = np.random.default_rng(seed)
    centres = sample[[rng.integers(len(sample))]]
    while len(centres) < k:
        d = _squared(sample, centres).min(1)
        if d.sum() <= 0:
            break
        centres = np.vstack([centres, sample[rng.choice(len(sample), p=d / d.sum())]])
    return centres


def fit_many(points: DataFrame, settings: Sequence[tuple[int, int]], seed: int = 42, max_iter: int = 300, tolerance: float = TOLERANCE) -> list[Fit]:
    """A fit for each ``(k, restart)`` of ``points(v array<double>)``, a table; one job a round for all of them.

    A fit has settled when no centre moves by more than ``tolerance``; a centre without points stays where it is.
    """
    total = points.count()
    if not total or not settings:
        return []
    every = max(1, total // START_SAMPLE)
    chosen = points.filter(F.pmod(F.xxhash64("v"), F.lit(every)) == 0).limit(4 * START_SAMPLE).toArrow().column("v").to_pylist()
    sample = np.array(sorted(chosen) or [points.first()["v"]], float)
    centres = [starting_centres(sample, k, seed + 1000 * restart + k) for k, restart in settings]
    rounds = [0] * len(settings)
    moving = list(range(len(settings)))
    while moving:
        found = _scan(points, [centres[f] for f in moving])
        still = []
        for place, f in enumerate(moving):
            old = centres[f]
            new = np.array([found[place, c][2] / found[place, c][0] if found[place, c][0] else old[c] for c in range(len(old))])
            rounds[f] += 1
            centres[f] = new
            if ((new - old) ** 2).sum(1).max() > tolerance**2 and rounds[f] < max_iter:
                still.append(f)
        moving = still
    found = _scan(points, centres)
    return [
        Fit(k, restart, centres[f], float(sum(found[f, c][1] for c in range(len(centres[f])))), rounds[f])
        for f, (k, restart) in enumerate(settings)
    ]


def silhouettes(points: DataFrame, centres: list[np.ndarray]) -> list[float]:
    """Mean squared Euclidean silhouette of each fit, all in two passes: the clusters' sums, then the points."""
    found = _scan(points, centres)
    stats = []
    for f, own in enumerate(centres):
        n = np.array([found[f, c][0] for c in range(len(own))], float)
        filled = np.maximum(n, 1)[:, None]
        means = np.array([found[f, c][2] for c in range(len(own))]) / filled
        stats.append((own, n, means, np.array([found[f, c][3] for c in range(len(own))]) / filled[:, 0]))
    shared = points.sparkSession.sparkContext.broadcast(stats)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(len(shared.value)), 0
        for x in _rows(batches):
            seen += len(x)
            norms = (x**2).sum(1)
            for f, (own, n, means, squares) in enumerate(shared.value):
                near = _squared(x, own).argmin(1)
                at = np.arange(len(x))
                apart = np.maximum(norms[:, None] + squares[None] - 2 * x @ means.T, 0.0)  # mean squared distance to a cluster
                size = n[near]
                inside = apart[at, near] * size / np.maximum(size - 1, 1)
                apart[at, near] = np.inf
                apart[:, n == 0] = np.inf
                outside = apart.min(1)
                worth = (size > 1) & np.isfinite(outside)
                most = np.maximum(inside, outside)
                value = np.where(worth & (most > 0), (outside - inside) / np.where(np.isfinite(most) & (most > 0), most, 1.0), 0.0)
                total[f] += np.where(worth, value, 0.0).sum()
        yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array(np.full(len(total), seen))], names=["fit", "total", "n"])

    rows = points.mapInArrow(score, "fit int, total double, n long").groupBy("fit").agg((F.sum("total") / F.sum("n")).alias("s")).collect()
    by = {r["fit"]: r["s"] for r in rows}
    return [float(by.get(f) or 0.0) for f in range(len(centres))]


def elbow_curve(df: DataFrame, vector_col: str, ks: Sequence[int], restarts: int, seed: int, max_iter: int) -> list[tuple[int, float, float]]:
    """``(k, sse, silhouette)`` of the best restart of each k. Null vectors are left out."""
    vectors = df.filter(F.col(vector_col).isNotNull()).select(F.col(vector_col).cast("array<double>").alias("v"))
    points = materialise(spread(vectors), "vectors")
    fits = fit_many(points, [(k, r) for k in ks for r in range(restarts)], seed, max_iter)
    if not fits:
        return []
    best = [min((f for f in fits if f.k == k), key=lambda f: f.sse) for k in ks]
    return [(f.k, f.sse, s) for f, s in zip(best, silhouettes(points, [f.centres for f in best]))]
