"""Nearest neighbours against brute force, and what the curves find alone."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from textloom.llm import curves

SCHEMA = "vec_id long, embedding array<double>, score string"


def _expected(rows, k=10, every=100):
    usable = {
        i: np.array(v, float)
        for i, v in rows
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v)
    }
    out = []
    for q, x in usable.items():
        if q % every == 0:
            near = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in usable.items() if i != q and len(y) == len(x))
            out += [(q, n + 1, i, s) for n, (s, i) in enumerate(near[:k])]
    return sorted(out)


def _check(frame, rows, **options):
    got = curves.nearest_neighbours(frame(SCHEMA, [(*r, "x") for r in rows]), **options).collect()
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)
    expected = _expected(rows, options.get("k", 10), options.get("every", 100))
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    assert np.allclose([g[3] for g in got], [e[3] for e in expected])


def test_equals_brute_force(frame, monkeypatch):
    monkeypatch.setattr(curves, "BLOCK_BYTES", 1)
    monkeypatch.setattr(curves, "QUERY_ROWS", 3)
    monkeypatch.setattr(curves, "CENTRES", 2)
    monkeypatch.setattr(curves, "RECALL", 0.5)
    random_ = np.random.default_rng(1)
    rows = [(i, random_.normal(size=16).tolist()) for i in range(500)]
    rows += [(500 + i, (np.array(rows[0][1]) + random_.normal(size=16) * 0.01).tolist()) for i in range(150)]
    rows += [(1000 + i, rows[5][1]) for i in range(150)]  # equal ones, queries among them
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 3.0]]
    rows += [(2000 + 100 * i, v) for i, v in enumerate(odd)] + [(None, rows[0][1])]
    _check(frame, rows)


def test_few_rows_and_none(frame):
    _check(frame, [(0, [1.0, 2.0]), (1, [1.0, 3.0]), (7, [1.0, 3.0])], k=10)
    _check(frame, [(0, [1.0, 2.0])])
    _check(frame, [])


def test_repeated_ids(frame):
    rows = [(0, [1.0, 1.0]), (0, [1.0, 1.0]), (3, [2.0, 1.0]), (3, [2.0, 1.0]), (4, [5.0, 1.0])]
    got = curves.nearest_neighbours(frame(SCHEMA, [(*r, "x") for r in rows])).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 3), (0, 2, 4)]


@pytest.mark.parametrize("partitions", [3, 29])
def test_curves_alone_find_most(spark, frame, monkeypatch, partitions):
    monkeypatch.setattr(curves, "BLOCK_BYTES", 8 * 12 * 128)
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    random_ = np.random.default_rng(2)
    centres = random_.normal(size=(20, 12)) * 3
    rows = [(i, (centres[i % 20] + random_.normal(size=12)).tolist(), "x") for i in range(2000)]
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = curves.nearest_neighbours(frame(SCHEMA, rows), exact=False).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    expected = {e[:3:2] for e in _expected([r[:2] for r in rows])}
    assert len({(r.query_id, r.vec_id) for r in got} & expected) / len(expected) >= 0.9


@pytest.mark.parametrize("axes, bits", [(2, 4), (3, 3)])
def test_hilbert_curve_visits_neighbouring_cells(axes, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    keys = curves.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
