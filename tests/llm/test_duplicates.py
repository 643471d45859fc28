"""Near-duplicates of texts and of vectors, and components, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from textloom.llm import caps, minhash
from textloom.llm.components import connected_components


def _closure(nodes, links) -> dict:
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(frame, kind):
    draw = random.Random(4)
    links = {
        "path": [(i, i + 1) for i in range(70)],
        "star": [(500, i) for i in range(60)] + [(3, 3), (None, 4), (5, None)],
        "random": [(draw.randrange(200), draw.randrange(200)) for _ in range(120)] * 2,
        "none": [],
    }[kind]
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    got = {r.node: r.component for r in connected_components(frame("a long, b long", links)).collect()}
    assert got == _closure({n for link in real for n in link}, real)


def _shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _expected(rows, threshold):
    sets = [(i, _shingles(t)) for i, t in rows if i is not None]
    links = [
        (a, b)
        for n, (a, x) in enumerate(sets)
        for b, y in sets[:n]
        if x and y and 100 * len(x & y) >= threshold * len(x | y)
    ]
    return _closure({i for i, _ in sets}, links)


def _family(draw, words, copies, changes):
    """A text and copies that differ in a few words."""
    base = [f"w{draw.randrange(5000)}" for _ in range(words)]
    texts = [" ".join(base)]
    for _ in range(copies):
        other = list(base)
        for _ in range(changes):
            other[draw.randrange(words)] = f"n{draw.randrange(10**6)}"
        texts.append(" ".join(other))
    return texts


@pytest.mark.parametrize("threshold", [80, 85])
def test_minhash_equals_brute_force(frame, threshold):
    draw = random.Random(5)
    texts = [t for _ in range(6) for t in _family(draw, draw.randrange(40, 300), 8, 2)]
    texts += [t for _ in range(4) for t in _family(draw, 120, 6, 5)]
    texts += _family(draw, 400, 60, 4)  # close to the text, further from each other
    texts += [f"u{i} " * 3 + "one two three" for i in range(10)] + ["A b\tc d E f"] * 9 + ["a B c  d\ne F"]
    texts += [None, None, "", " \n", "only", "only", "four words are here", "Four Words are here", "É d e f g", "é d e f g"]
    draw.shuffle(texts)
    rows = list(enumerate(texts)) + [(None, "only"), (None, None)]
    docs = frame("doc_id long, text string, component_id string, keys int", [(i, t, "x", 1) for i, t in rows])
    got = minhash.near_duplicates(docs, threshold).collect()
    assert len(got) == len(rows)
    expected = _expected(rows, threshold)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert {r.doc_id: r.n_shingles for r in got if r.doc_id is not None} == {i: len(_shingles(t)) for i, t in enumerate(texts)}


def test_minhash_of_long_and_repeated_rows(frame):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "some other words stand here now"), (3, long), (4, "x"), (4, "x")]
    got = sorted(minhash.near_duplicates(frame("doc_id long, text string", rows)).collect())
    assert [(r.doc_id, r.component_id) for r in got] == [(1, 1), (2, 1), (3, 1), (3, 1), (4, 4), (4, 4)]
    assert minhash.near_duplicates(frame("doc_id long, text string", [])).collect() == []


def test_the_rest_joins_what_first_members_miss(frame, monkeypatch):
    """Chains inside one band key: the first member is like few of the others."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    base = [f"w{i}" for i in range(300)]
    rows = [(100 - i, " ".join(base[i * 4 : i * 4 + 220])) for i in range(20)]
    got = minhash.near_duplicates(frame("doc_id long, text string", rows), 85).collect()
    assert {r.doc_id: r.component_id for r in got} == _expected(rows, 85)


def test_common_counts():
    draw = random.Random(7)
    sets = [np.unique(np.array([draw.randrange(60) for _ in range(draw.randrange(1, 50))], np.uint64)) for _ in range(12)]
    one, other = np.arange(5), np.arange(3, 12)
    expected = [[len(set(sets[i]) & set(sets[j])) for j in other] for i in one]
    assert minhash.common_counts(sets, one, other, 7)[:, :].tolist() == [
        [e if i != j else (sets[i][:, None] == sets[j]).sum() for e, j in zip(row, other)] for row, i in zip(expected, one)
    ]


def test_sketch_limits():
    hashes = minhash.WordHashes()
    base = [f"w{i}" for i in range(400)]
    sets = [minhash.shingle_set(" ".join(base[:k] + [f"x{i}" for i in range(400 - k)]), hashes) for k in (400, 372, 200)]
    model = minhash.MinHash(16)
    sketches = model.sketches(np.stack([model.samples(s) for s in sets])).view(np.uint64)
    bits = [int(np.bitwise_count(sketches[0] ^ s).sum()) for s in sketches]
    assert bits[0] == 0 and bits[1] <= minhash.most_differing_bits(85) < bits[2]


def _vectors_expected(rows, threshold=0.93):
    usable = [
        (i, label, np.array(v, float))
        for i, v, label in rows
        if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and any(v)
    ]
    links = []
    for n, (a, la, x) in enumerate(usable):
        for m, (b, lb, y) in enumerate(usable):
            if n != m and la == lb and len(x) == len(y):
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links.append((a, b))
    return links


@pytest.mark.parametrize("dimension", [1, 2, 5, 64, 300])
def test_codes_bound_cosines(dimension):
    random_ = np.random.default_rng(dimension)
    one = random_.normal(size=(200, dimension)) * 10.0 ** random_.integers(-3, 3, (200, dimension))
    other = np.concatenate([one[:100] + random_.normal(size=(100, dimension)) * 0.1, -one[:50], one[:50]])
    one, other = caps.unit(one), caps.unit(other)
    room = caps.cosine_bounds(caps.codes_of(one), caps.codes_of(other)) - one @ other.T
    assert room.min() >= 0 and room.max() < 0.1


def test_caps_equal_brute_force(frame, monkeypatch):
    monkeypatch.setattr(caps, "BLOCK", 16)
    monkeypatch.setattr(caps, "CODE_BLOCK", 24)
    monkeypatch.setattr(caps, "STRIP", 7)
    random_ = np.random.default_rng(6)
    rows, n = [], 0
    for label in (0, 1):
        for _ in range(30):
            centre = random_.normal(size=24)
            for _ in range(random_.integers(1, 6)):
                rows.append((n, (centre + random_.normal(size=24) * 0.25).tolist(), label))
                n += 1
    centre = random_.normal(size=24)
    for _ in range(60):
        rows.append((n, (centre + random_.normal(size=24) * 0.2).tolist(), 1))
        n += 1
    rows += [(n + i, rows[0][1], 0) for i in range(5)] + [(n + 5, rows[0][1], 1), (n + 6, rows[0][1], None)]
    n += 7
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [0.0] * 23, [None] + [1.0] * 23, [1.0, 2.0], [2.0, 4.0]]
    rows += [(n + i, v, 0) for i, v in enumerate(odd)] + [(None, rows[0][1], 0), (None, None, None)]
    docs = frame(
        "vec_id long, embedding array<double>, label int, n_links string, digest int", [(*r, "x", 1) for r in rows]
    )
    got = caps.near_duplicates(docs).collect()
    links = _vectors_expected(rows)
    assert len(got) == len(rows)
    ids = {r[0] for r in rows if r[0] is not None}
    found = {r.vec_id: r for r in got if r.vec_id is not None}
    assert {i: r.component_id for i, r in found.items()} == _closure(ids, links)
    counts = {i: sum(a == i for a, _ in links) for i in ids}
    assert {i: r.n_links for i, r in found.items()} == counts
    assert all(r.n_links == 0 and r.kept and r.component_id is None for r in got if r.vec_id is None)


def test_caps_without_rows_and_with_extreme_sizes(frame):
    schema = "vec_id long, embedding array<float>, label int"
    assert caps.near_duplicates(frame(schema, [])).collect() == []
    tiny, huge = [1e-30, 2e-30, 0.0], [1e30, 2e30, 0.0]
    got = caps.near_duplicates(frame(schema, [(1, tiny, 0), (2, huge, 0), (2, huge, 0), (3, [1.0, -1.0, 5.0], 0)])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 0, 3)]


def test_filters_are_those_beyond_the_threshold():
    code = caps.Filters(12, 5000)
    directions = caps.unit(np.random.default_rng(7).normal(size=(20, 12)))
    whole = np.stack([np.concatenate([a, b]) for a in code.books[0] for b in code.books[1]])
    scores = directions @ code.rotation @ whole.T
    for row, found in zip(scores, code.decode(directions)):
        beyond = np.flatnonzero(row >= code.threshold)
        assert set(beyond) <= set(found) and len(found) >= caps.LEAST_FILTERS
        assert row[found].min() > np.delete(row, found).max(initial=-9)


@pytest.mark.parametrize("count", [10_256, 1_999_999, 2_000_001, 100_000_000])
def test_pairs_at_the_threshold_share_filters_at_every_size(count):
    random_ = np.random.default_rng(8)
    one = caps.unit(random_.normal(size=(3000, 64)))
    across = random_.normal(size=one.shape)
    across -= (across * one).sum(axis=1, keepdims=True) * one
    other = caps.THRESHOLD * one + np.sqrt(1 - caps.THRESHOLD**2) * caps.unit(across)
    code = caps.Filters(64, count)
    lists = zip(code.decode(one), code.decode(other))
    assert sum(not set(a.tolist()) & set(b.tolist()) for a, b in lists) <= 1  # 0.3 expected at one in 10,000


def test_filters_rise_with_the_table():
    needed = [caps.caps_for(64, count)[1] for count in (10_000, 1_000_000, 1_999_999, 2_000_001, 100_000_000)]
    assert needed == sorted(needed) and needed[3] - needed[2] <= 1
    assert all(caps.chance_in_cap(d, *caps.caps_for(d, 10**8)[:1], caps.THRESHOLD) >= caps.LEAST_CHANCE for d in (2, 3, 8, 64))


def test_thresholds_that_the_samples_do_not_reach(frame):
    assert minhash.bands_for(80) == 24 and minhash.bands_for(76) <= minhash.SAMPLES // minhash.BAND_ROWS
    for threshold in (75, 50, 1, 0):
        with pytest.raises(ValueError, match="76"):
            minhash.near_duplicates(frame("doc_id long, text string", [(1, "a")]), threshold=threshold)
