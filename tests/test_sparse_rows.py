"""Products of sparse rows: over all cells of a block where few are empty, over the filled ones elsewhere, with one result."""

from __future__ import annotations

import numpy as np

from doctopics.operators.factor import DENSE_CELLS, SparseRows, _nonnegative_rows


def block(n: int, width: int, filled: int) -> tuple[SparseRows, np.ndarray]:
    rng = np.random.default_rng(3)
    at = np.concatenate([rng.choice(width, filled, replace=False) for _ in range(n)])
    rows = SparseRows(at, rng.random(n * filled), np.arange(n + 1) * filled)
    whole = np.zeros((n, width))
    whole[np.repeat(np.arange(n), filled), at] = rows.cells
    return rows, whole


def test_filled_blocks_are_multiplied_whole():
    for n, width, filled, dense in ((50, 100, 10, True), (50, 100, 1, False), (0, 100, 5, True)):
        rows, whole = block(n, width, filled) if n else (SparseRows(np.zeros(0, int), np.zeros(0), np.zeros(1, int)), np.zeros((0, width)))
        assert (rows.dense(width) is not None) == dense
        right, left = np.random.default_rng(4).random((width, 7)), np.random.default_rng(5).random((n, 3))
        np.testing.assert_allclose(rows.times(right), whole @ right, rtol=1e-12, atol=1e-12)
        np.testing.assert_allclose(rows.transposed_times(left, width), left.T @ whole, rtol=1e-12, atol=1e-12)


def test_whole_blocks_are_bounded():
    n = 1 + DENSE_CELLS // 100
    assert SparseRows(np.zeros(10 * n, int), np.ones(10 * n), np.arange(n + 1) * 10).dense(100) is None


def test_weights_are_the_best_non_negative_ones():
    rng = np.random.default_rng(6)
    h, x = rng.random((5, 40)), rng.random((30, 40))
    w = _nonnegative_rows(x @ h.T, h @ h.T, 2000)
    slope = w @ (h @ h.T) - x @ h.T
    assert w.shape == (30, 5) and (w >= 0).all() and (slope > -1e-3).all() and np.abs(slope[w > 1e-9]).max() < 1e-3
