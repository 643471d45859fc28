"""Whitening against an eigendecomposition of the whole table, and its rank-one updates."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest

from textloom.llm import whitening
from textloom.llm.queries import op12_whitening

SCHEMA = "vec_id long, embedding array<double>, n string"


def _numbers(vectors):
    return np.floor(np.array(vectors, float) * 1024).astype(np.int64) + 100_000


def _check(got, rows, components=8):
    """Rows of the operator against numpy over the same vectors; returns the largest deviation from the identity."""
    x = _numbers([v for _, v in rows])
    n, dims = x.shape
    centred = np.array([[float(Fraction(int(n * e - s), n)) for e, s in zip(row, x.sum(axis=0))] for row in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    trace = (centred**2).sum() / n
    expected = centred @ axes / np.sqrt(values)
    ids = [i for i, _ in rows]
    assert len(got) == n * min(components, dims)
    deviation = {i: sum((int(n * e) - int(s)) ** 2 for e, s in zip(row, x.sum(axis=0))) for i, row in zip(ids, x)}
    table = np.full((n, min(components, dims)), np.nan)
    for r in got:
        assert r.n == n and r.deviation == deviation[r.vec_id]
        assert abs(r.explained - values[r.component - 1] / trace) < 1e-9
        table[ids.index(r.vec_id), r.component - 1] = r.whitened
    assert np.isfinite(table).all()
    assert np.allclose(np.abs((table * expected).mean(axis=0)), 1, atol=1e-9)
    assert np.allclose(np.abs(table), np.abs(expected), atol=1e-6)
    error = np.abs(np.cov(table.T, bias=True).reshape(table.shape[1], -1) - np.eye(table.shape[1])).max()
    assert abs(got[0].identity_error - error) < 1e-9
    return error


def test_equals_eigendecomposition_of_the_table(frame):
    random_ = np.random.default_rng(1)
    turn = random_.normal(size=(12, 12))
    rows = [(i, (random_.normal(size=12) @ turn * 0.3 + 5).tolist()) for i in range(400)]
    odd = [(900, None), (901, []), (902, [1.0] * 11 + [None]), (903, [1.0] * 11 + [float("nan")])]
    odd += [(904, [1.0] * 11 + [float("inf")]), (905, [1.0, 2.0]), (906, [-float("inf")] * 12)]
    got = whitening.whiten(frame(SCHEMA, [(*r, "x") for r in rows + odd], 7)).collect()
    assert _check(got, rows) < 1e-9


def test_tree_of_many_partitions(frame, monkeypatch):
    random_ = np.random.default_rng(2)
    rows = [(i, (random_.normal(size=5) * [9, 4, 2, 1, 0.5]).tolist()) for i in range(300)]
    monkeypatch.setattr(whitening, "FAN_IN", 3)
    got = whitening.whiten(frame(SCHEMA, [(*r, "x") for r in rows], 29), components=3).collect()
    assert _check(got, rows, 3) < 1e-9


def test_the_table(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert _check(op12_whitening(spark, small).collect(), rows) < 1e-9


def test_components_without_variance(frame):
    rows = [(i, [float(i % 3), 2.0, 2.0 * (i % 3)], "x") for i in range(30)] + [(1, [1.0, 2.0, 2.0], "x")]
    got = whitening.whiten(frame(SCHEMA, rows)).collect()
    assert len(got) == 93 and got[0].identity_error < 1e-9
    assert all((r.whitened is None) == (r.component > 1) for r in got)
    assert {round(r.explained, 9) for r in got} == {0.0, 1.0}
    same = whitening.whiten(frame(SCHEMA, [(1, [1.0, 2.0], "x"), (2, [1.0, 2.0], "x")])).collect()
    assert len(same) == 4 and all(r.whitened is None and r.explained is None and r.deviation == 0 for r in same)


def test_few_rows_none_and_equal_dimensions(frame):
    assert whitening.whiten(frame(SCHEMA, [])).collect() == []
    assert whitening.whiten(frame(SCHEMA, [(1, None, "x"), (2, [], "x")])).collect() == []
    tied = whitening.whiten(frame(SCHEMA, [(1, [1.0], "x"), (2, [1.0, 2.0], "x")])).collect()
    assert {r.vec_id for r in tied} == {2}


def test_entries_beyond_whole_numbers(frame):
    rows = [(1, [1e300, 0.0], "x"), (2, [-1e300, 0.5], "x"), (None, [0.0, 1e-300], "x")]
    got = whitening.whiten(frame(SCHEMA, rows)).collect()
    assert len(got) == 6 and all(np.isfinite(r.whitened) for r in got if r.component == 1)
    x = [[whitening.LARGEST + 100_000, 100_000], [100_000 - whitening.LARGEST, 100_512], [100_000, 100_000]]
    sums = [sum(c) for c in zip(*x)]
    exact = {i: sum((3 * e - s) ** 2 for e, s in zip(row, sums)) for i, row in zip([1, 2, None], x)}
    assert all(int(r.deviation) == exact[r.vec_id] for r in got)


@pytest.mark.parametrize("seed", range(8))
def test_updates_equal_decomposition(seed):
    random_ = np.random.default_rng(seed)
    for trial in range(25):
        dims, rank = int(random_.integers(1, 20)), int(random_.integers(1, 20))
        rows = random_.normal(size=(int(random_.integers(1, 50)), rank)) @ random_.normal(size=(rank, dims))
        rows = np.round(rows) if trial % 3 == 0 else rows * 10 ** random_.uniform(-3, 5)
        spectrum, other = whitening.Spectrum.none(dims), whitening.Spectrum.none(dims)
        cut = int(random_.integers(1, len(rows) + 1))
        spectrum.with_block(rows[:cut])
        if cut < len(rows):
            other.with_block(rows[cut:])
        spectrum.with_spectrum(other)
        centred = rows - rows.mean(axis=0)
        scatter = centred.T @ centred
        rebuilt = spectrum.vectors * spectrum.values @ spectrum.vectors.T
        assert np.abs(rebuilt - scatter).max() <= 1e-10 * max(np.abs(scatter).max(), 1e-6)
        assert np.allclose(spectrum.vectors.T @ spectrum.vectors, np.eye(dims), atol=1e-10)


def test_roots_lie_between_poles():
    poles, squares = np.array([0.0, 1.0, 1.0 + 1e-9, 5.0]), np.array([1e-12, 1.0, 1.0, 2.0])
    origin, t = whitening.secular_roots(poles, squares)
    roots = poles[origin] + t
    assert (roots >= poles).all() and (roots[:-1] <= poles[1:]).all() and roots[-1] <= 5 + squares.sum()
    expected = np.linalg.eigvalsh(np.diag(poles) + np.outer(np.sqrt(squares), np.sqrt(squares)))
    assert np.allclose(roots, expected, atol=1e-12)
