"""Nearest-neighbour graphs of document vectors and the coordinates that keep those neighbourhoods.

Candidates come from trees of random projections: each tree deals every point to one leaf, a leaf is compared with itself, and
trees are added until the neighbours of a bounded set of probes, found exactly in one scan, are met. Distances are always
computed from the vectors. The coordinates are the leading eigenvectors of the normalised graph, by subspace iteration with a
Chebyshev filter: each step is one join of the edges with the current values, so only matrices of a few columns reach the
driver. Equal vectors are one point of the graph.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctopics.operators.space import _matrix
from doctopics.runtime import materialise

NEIGHBOURS = 15
LEAF_POINTS = 1024
MAX_DEPTH = 14
SAMPLE = 50_000
PROBES = 256
BLOCK_ROWS = 256
# A vertex with more edges than this is joined in several parts.
HUB_EDGES = 100_000
# Vectors that make up more than this share of the rows are joined apart; there are at most its inverse of them.
HOT_SHARE = 1e-3
NEAR = "array<struct<d:double,b:bigint>>"


# ---------------------------------------------------------------- graph


@dataclass(frozen=True)
class NeighbourGraph:
    """``points``: id, v, n (rows with that vector); ``lists``: id, near (distance and id, nearest first); measured ``recall``."""

    points: DataFrame
    lists: DataFrame
    recall: float
    trees: int


def _prepared(vector_col: str, cosine: bool) -> Column:
    """The vector as doubles, of length one for cosines; null if it is null, empty, not finite or has no direction."""
    v = F.col(vector_col).cast("array<double>")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    # an infinite, missing or undefined element makes the length so
    usable = (F.size(v) > 0) & (length < F.lit(float("inf")))
    if cosine:
        return F.when(usable & (length > 0), F.transform(v, lambda x: x / length))
    return F.when(usable, v)


def _as_near(ids: np.ndarray, d: np.ndarray) -> pa.Array:
    """Rows of neighbour ids and distances as a list column."""
    offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * ids.shape[1])
    pairs = pa.StructArray.from_arrays([pa.array(d.ravel(), pa.float64()), pa.array(ids.ravel(), pa.int64())], ["d", "b"])
    return pa.ListArray.from_arrays(offsets, pairs)


def _nearest(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the ids and distances of its ``k`` nearest other rows, ties in any order."""
    out_ids, out_d = np.empty((len(x), k), np.int64), np.empty((len(x), k))
    squares = (x**2).sum(1)
    for start in range(0, len(x), BLOCK_ROWS):
        rows = np.arange(start, min(start + BLOCK_ROWS, len(x)))
        d = squares[rows, None] - 2 * x[rows] @ x.T + squares[None, :]
        d[rows - start, rows] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        out_ids[rows] = ids[near]
        # the same pair has the same bits in every tree
        out_d[rows] = np.sqrt(((x[rows, None, :] - x[near]) ** 2).sum(-1))
    return out_ids, out_d


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of several lists an id (one a tree)."""
    found = F.array_sort(F.array_distinct(F.flatten(F.collect_list("near"))))
    return lists.groupBy("id").agg(F.slice(found, 1, k).alias("near"))


def _tree_lists(points: DataFrame, sample: np.ndarray, depth: int, trees: range, k: int, leaf_points: int, seed: int) -> DataFrame:
    """``(id, near)`` for every point and tree: neighbours within the point's leaf."""
    directions, cuts = [], []
    for tree in trees:
        rng = np.random.default_rng([seed, tree])
        lines = rng.normal(size=(depth, sample.shape[1]))
        node, values = np.zeros(len(sample), np.int64), []
        for line in lines:
            at = sample @ line
            width = 1 << len(values)
            medians = np.array([np.median(at[node == g]) if (node == g).any() else 0.0 for g in range(width)])
            values.append(medians)
            node = 2 * node + (at >= medians[node])
        directions.append(lines)
        cuts.append(values)

    @F.arrow_udf("array<int>")
    def leaves(v: pa.Array) -> pa.Array:
        x = _matrix(v)
        out = np.zeros((len(x), len(cuts)), np.int32)
        for t, (lines, values) in enumerate(zip(directions, cuts, strict=True)):
            for line, medians in zip(lines, values, strict=True):
                out[:, t] = 2 * out[:, t] + ((x @ line) >= medians[out[:, t]])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(cuts)), pa.array(out.ravel()))

    dealt = points.select("id", "v", leaves("v").alias("leaves")).select("id", "v", F.posexplode("leaves").alias("tree", "leaf"))
    dealt = materialise(dealt, "leaves")
    # A leaf that the sample left too large is split by a hash; at most trees x 2^MAX_DEPTH leaves are counted.
    parts = dealt.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / F.lit(4 * leaf_points)).alias("parts"))
    dealt = dealt.join(F.broadcast(parts), ["tree", "leaf"])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id", "tree"), F.col("parts"))).drop("parts")

    def compare(group: pa.Table) -> pa.Table:
        ids, x = group.column("id").to_numpy(), _matrix(group.column("v"))
        width = min(k, len(ids) - 1)
        near = _nearest(ids, x, width) if width else (np.empty((len(ids), 0), np.int64), np.empty((len(ids), 0)))
        return pa.table({"id": pa.array(ids), "near": _as_near(*near)})

    return dealt.groupBy("tree", "leaf", "part").applyInArrow(compare, f"id bigint, near {NEAR}")


def _exact(points: DataFrame, ids: np.ndarray, x: np.ndarray, k: int) -> dict[int, set[int]]:
    """Neighbours of the probes by one scan of all points; a task keeps ``k`` a probe."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_ids, best_d = np.empty((len(ids), 0), np.int64), np.empty((len(ids), 0))
        for batch in batches:
            other, y = batch.column("id").to_numpy(), _matrix(batch.column("v"))
            for start in range(0, len(y), BLOCK_ROWS):
                block, at = y[start : start + BLOCK_ROWS], other[start : start + BLOCK_ROWS]
                d = np.sqrt(((x[:, None, :] - block[None, :, :]) ** 2).sum(-1))
                d[ids[:, None] == at[None, :]] = np.inf
                all_d = np.hstack([best_d, d])
                all_ids = np.hstack([best_ids, np.broadcast_to(at, d.shape)])
                keep = np.argsort(all_d, axis=1, kind="stable")[:, :k]
                best_d, best_ids = np.take_along_axis(all_d, keep, 1), np.take_along_axis(all_ids, keep, 1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), _as_near(best_ids, best_d)], ["id", "near"])

    found = _merged(points.select("id", "v").mapInArrow(scan, f"id bigint, near {NEAR}"), k)
    return {r["id"]: {p["b"] for p in r["near"] if p["d"] < math.inf} for r in found.collect()}


def neighbour_graph(
    df: DataFrame,
    vector_col: str = "embedding",
    k: int = NEIGHBOURS,
    cosine: bool = True,
    recall: float = 0.95,
    trees: int = 4,
    max_trees: int = 64,
    leaf_points: int = LEAF_POINTS,
    seed: int = 42,
) -> NeighbourGraph:
    """The ``k`` nearest other vectors of each different vector, by cosine or by distance.

    ``trees`` more trees are grown until at least ``recall`` of the true neighbours of up to ``PROBES`` points are found, or
    ``max_trees`` are; ``recall`` of the result is what was measured. Cuts come from a sample of about ``SAMPLE`` points; every
    point is in a leaf of every tree. Vectors without a direction (null, empty, not finite, zero for cosines) are no points.
    With fewer than ``k`` others all are neighbours. Vectors must be of one width.
    """
    counted = df.select(_prepared(vector_col, cosine).alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
    ordered = counted.orderBy("v").select(F.monotonically_increasing_id().alias("id"), "v", "n")
    points = materialise(ordered, "graph-points")
    total = points.count()
    if total < 2:
        return NeighbourGraph(points, points.select("id", F.lit(None).cast(NEAR).alias("near")).limit(0), 1.0, 0)

    def some(wanted: int) -> pa.Table:
        mark = F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(max(1, total // wanted)))
        rows = points.filter(mark == 0).orderBy("id").limit(2 * wanted).select("id", "v").toArrow()
        return rows if len(rows) else points.limit(wanted).select("id", "v").toArrow()

    probes = some(PROBES)
    ids = probes.column("id").to_numpy()
    truth = _exact(points, ids, _matrix(probes.column("v")), k)
    sample = _matrix(some(SAMPLE).column("v"))
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(total / leaf_points))))
    lists, grown, measured = None, 0, 0.0
    while True:
        # one leaf holds all pairs, so one tree is enough
        more = range(grown, grown + trees) if depth else range(1)
        new = _tree_lists(points, sample, depth, more, k, leaf_points, seed)
        lists = materialise(_merged(new if lists is None else lists.unionByName(new), k), "neighbours")
        grown += len(more)
        wanted = points.sparkSession.createDataFrame([(int(i),) for i in ids], "id long")
        got = {r["id"]: {p["b"] for p in r["near"]} for r in lists.join(F.broadcast(wanted), "id").collect()}
        measured = float(np.mean([len(truth[i] & got.get(i, set())) / len(truth[i]) for i in truth]))
        if measured >= recall or grown >= max_trees:
            return NeighbourGraph(points, lists, measured, grown)


def weighted_edges(lists: DataFrame) -> DataFrame:
    """Both directions of every link with a weight that falls with distance, on the scale of the two ends' own neighbourhoods."""
    far = F.greatest(F.element_at("near", -1)["d"], F.lit(1e-12))
    listed = lists.filter(F.size("near") > 0).select(F.col("id").alias("a"), far.alias("sa"), "near")
    links = listed.select("a", "sa", F.inline("near"))
    links = links.join(listed.select(F.col("a").alias("b"), F.col("sa").alias("sb")), "b")
    # never so small that a link vanishes
    links = links.select("a", "b", F.exp(-F.least(F.col("d") * F.col("d") / (F.col("sa") * F.col("sb")), F.lit(30.0))).alias("w"))
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.max("w").alias("w"))


# ---------------------------------------------------------------- coordinates


@dataclass(frozen=True)
class Spectrum:
    """``coordinates``: id and one array a point; the eigenvalues and how far each pair is from the eigen equation."""

    coordinates: DataFrame
    values: np.ndarray
    residuals: np.ndarray


def _sums(state: DataFrame, pairs: list[tuple[str, str]]) -> np.ndarray:
    row = state.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"s{i}") for i, (a, b) in enumerate(pairs)]).first()
    return np.array([row[i] or 0.0 for i in range(len(pairs))])


def _upper(left: list[str], right: list[str]) -> list[tuple[str, str]]:
    return [(left[i], right[j]) for i in range(len(left)) for j in range(i, len(right))]


def _symmetric(sums: np.ndarray, width: int) -> np.ndarray:
    """Matrix whose upper triangle is given row by row."""
    out = np.zeros((width, width))
    out[np.triu_indices(width)] = sums
    return out + np.triu(out, 1).T


def _mix(columns: list[str], weights: np.ndarray) -> Column:
    """Linear combination of columns."""
    out = F.lit(0.0)
    for name, w in zip(columns, weights, strict=True):
        out = out + F.lit(float(w)) * F.col(name)
    return out


def _step(edges: DataFrame, state: DataFrame, x: list[str], y: list[str], scale: float, shift: float, before: list[str] | None) -> DataFrame:
    """``y = scale * A x + shift * x - before`` next to ``x``, by one join and one sum."""
    sent = state.select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("s"), *x)
    got = edges.join(sent, ["b", "s"]).select(
        F.col("a").alias("id"), *[(F.col("w") * scale * F.col(c)).alias(n) for c, n in zip(x, y, strict=True)]
    )
    rest = [F.lit(0.0).alias(c) for c in ["u", *x]]
    own = [(F.col(c) * shift - (F.col(before[i]) if before else 0.0)).alias(y[i]) for i, c in enumerate(x)]
    both = got.select("id", F.lit(0).alias("splits"), *rest, *y).unionByName(state.select("id", "splits", "u", *x, *own))
    summed = both.groupBy("id").agg(F.sum("splits").cast("int").alias("splits"), *[F.sum(c).alias(c) for c in ["u", *x, *y]])
    return materialise(summed, "spectrum")


def spectral_coordinates(
    edges: DataFrame, k: int = 5, extra: int = 4, degree: int = 8, max_rounds: int = 12, tol: float = 1e-2, seed: int = 42
) -> Spectrum:
    """Leading eigenvectors of the symmetrically normalised graph ``(a, b, w)`` (both directions of every edge), without the
    constant one, divided by the root of the degree and scaled to mean square one over the degrees.

    Rounds go on until every pair's residual is at most ``tol``, or for ``max_rounds``. Parts that are not connected differ in the
    first coordinates. With ``n`` points there are at most ``n - 1`` coordinates; the others are zero.
    """
    spark = edges.sparkSession
    names = [f"x{i}" for i in range(k + extra)]
    edges = materialise(edges, "edges")
    degrees = edges.groupBy("a").agg(F.sum("w").alias("deg"), F.ceil(F.count("*") / F.lit(HUB_EDGES)).cast("int").alias("splits"))
    degrees = materialise(degrees.withColumnRenamed("a", "id"), "degrees")
    n, mass = degrees.agg(F.count("*"), F.sum("deg")).first()
    if not n:
        empty = degrees.select("id", F.array().cast("array<double>").alias("reduced"))
        return Spectrum(empty, np.zeros(0), np.zeros(0))
    names = names[: max(1, min(len(names), n - 1))]
    there = degrees.select(F.col("id").alias("b"), F.col("deg").alias("deg_b"), "splits")
    here = degrees.select(F.col("id").alias("a"), F.col("deg").alias("deg_a"))
    normal = edges.join(here, "a").join(there, "b").select(
        "a", "b", F.pmod(F.xxhash64("a"), F.col("splits")).cast("int").alias("s"), (F.col("w") / F.sqrt(F.col("deg_a") * F.col("deg_b"))).alias("w")
    )
    # read by every step: dealt by the joined vertex once, recomputed from the tables if an executor goes
    normal = normal.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "b", "s").persist()

    def noise(i: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(seed + i)), F.lit(2_000_001)) / 1_000_000 - 1

    root = F.sqrt(F.col("deg") / F.lit(mass))
    state = materialise(degrees.select("id", "splits", root.alias("u"), *[noise(i).alias(c) for i, c in enumerate(names)]), "spectrum")
    for round_no in range(max_rounds):
        # orthonormal and orthogonal to the constant one
        sums = _sums(state, [("u", c) for c in names] + _upper(names, names))
        along = sums[: len(names)]
        inner = _symmetric(sums[len(names) :], len(names)) - np.outer(along, along)
        sizes, vectors = np.linalg.eigh(inner)
        kept = sizes > 1e-13 * max(sizes.max(), 1e-300)
        basis = vectors[:, kept] / np.sqrt(sizes[kept])
        mixed = np.vstack([-along @ basis, basis])
        names = [f"x{i}" for i in range(basis.shape[1])]
        images = [f"y{i}" for i in range(len(names))]
        old = [c for c in state.columns if c.startswith("x")]
        state = state.select("id", "splits", "u", *[_mix(["u", *old], mixed[:, i]).alias(c) for i, c in enumerate(names)])
        state = _step(normal, state, names, images, 1.0, 0.0, None)
        # the graph is symmetric, so both matrices are
        sums = _sums(state, _upper(names, images) + _upper(images, images))
        ritz, lengths = (_symmetric(part, len(names)) for part in np.split(sums, 2))
        values, turn = np.linalg.eigh(ritz)
        values, turn = values[::-1], turn[:, ::-1]
        residuals = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", turn, lengths, turn) - values**2, 0))
        wanted = min(k, len(names))
        turned = [_mix(names, turn[:, i]) for i in range(len(names))]
        if residuals[:wanted].max() <= tol or round_no == max_rounds - 1:
            out = [turned[i] / F.col("u") if i < wanted else F.lit(0.0) for i in range(k)]
            done = materialise(state.select("id", F.array(*out).alias("reduced")), "coordinates")
            normal.unpersist()
            return Spectrum(done, values[:wanted], residuals[:wanted])
        # damp everything between -1 and the smallest value found
        middle, half = (values[-1] - 1) / 2, max((values[-1] + 1) / 2, 1e-3)
        first = [(_mix(images, turn[:, i]) - middle * turned[i]) / half for i in range(len(names))]
        before = [f"p{i}" for i in range(len(names))]
        state = state.select("id", "splits", "u", *[c.alias(n) for c, n in zip(first, names, strict=True)], *[c.alias(n) for c, n in zip(turned, before, strict=True)])
        for _ in range(degree - 1):
            state = _step(normal, state, names, images, 2 / half, -2 * middle / half, before)
            state = state.select("id", "splits", "u", *[F.col(y).alias(x) for y, x in zip(images, names, strict=True)], *[F.col(x).alias(p) for x, p in zip(names, before, strict=True)])
        state = state.drop(*before)
    raise ValueError("max_rounds must be positive")


def reduce_neighbours(
    df: DataFrame,
    vector_col: str = "embedding",
    out_col: str = "reduced",
    k: int = 5,
    cosine: bool = True,
    neighbours: int = NEIGHBOURS,
    tol: float = 1e-2,
    **options,
) -> DataFrame:
    """Rows with ``k`` coordinates in which neighbours by cosine (or distance) stay neighbours; equal vectors get equal ones.

    Rows whose vector has no direction get zeros. ``tol`` is that of ``spectral_coordinates``, ``options`` are those of ``neighbour_graph``.
    """
    graph = neighbour_graph(df, vector_col, neighbours, cosine, **options)
    found = spectral_coordinates(weighted_edges(graph.lists), k, tol=tol).coordinates
    placed = materialise(graph.points.join(found, "id").select(F.col("v").alias("_v"), "n", F.col("reduced").alias("_r")), "placed")
    total = placed.agg(F.sum("n")).first()[0] or 0
    keyed = df.withColumn("_v", _prepared(vector_col, cosine))
    many = placed.filter(F.col("n") > HOT_SHARE * total).select("_v", F.col("_r").alias("_hot"))
    few = placed.filter(F.col("n") <= HOT_SHARE * total).select("_v", "_r")
    # rows of frequent vectors and rows without one spread over the second join, which they cannot match
    keyed = keyed.join(F.broadcast(many), "_v", "left")
    spread = F.when(F.col("_hot").isNull(), F.col("_v"))
    keyed = keyed.withColumn("_v", spread).join(few, "_v", "left")
    nothing = F.array(*[F.lit(0.0)] * k)
    return keyed.withColumn(out_col, F.coalesce("_hot", "_r", nothing)).drop("_v", "_hot", "_r")
