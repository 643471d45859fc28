"""Periodic runs and repeated passages against brute force, and odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from textloom.llm import debruijn, periodic
from textloom.llm.common import word_chunks
from textloom.llm.queries import op11_periodic, op13_debruijn

SCHEMA = "doc_id long, text string, n_words string"


def _runs(words, least=24, times=3):
    """All runs, by trying every lag and every place."""
    found = []
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            smaller = lambda p: all(words[x] == words[x + p] for x in range(i, i + length - p))  # noqa: E731, B023
            if j > i and length >= max(least, times * q) and not any(map(smaller, range(1, q))):
                found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def _collapsed(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def _loopy(random_, most):
    letters = random_.choice([1, 2, 3, 6])
    words = []
    while len(words) < most:
        if random_.random() < 0.5:
            unit = [random_.randrange(letters) for _ in range(random_.randint(1, 30))]
            if random_.random() < 0.4:
                unit += unit + [random_.randrange(letters)]
            words += unit * random_.randint(1, 6) + unit[: random_.randrange(len(unit))]
        else:
            words += [random_.randrange(letters) for _ in range(random_.randint(1, 20))]
    return words[:most]


def test_runs_equal_brute_force():
    random_ = random.Random(3)
    seen = 0
    for _ in range(300):
        words = _loopy(random_, random_.randint(1, 250))
        expected = _runs(words)
        seen += len(expected)
        assert periodic.runs_of(np.array(words), len(words)) == expected
    assert seen > 200


@pytest.mark.parametrize("least, times", [(2, 3), (7, 4), (40, 3), (1000, 5)])
def test_other_lengths_and_times(least, times):
    random_ = random.Random(least)
    for _ in range(60):
        words = _loopy(random_, random_.randint(1, 200))
        assert periodic.runs_of(np.array(words), len(words), least, times) == _runs(words, least, times)


def test_runs_of_documents(frame):
    random_ = random.Random(4)
    texts = [" ".join(f"W{w}" for w in _loopy(random_, random_.randint(1, 150))) for _ in range(60)]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    rows += [(7, texts[7], "x"), (None, "a " * 30, "x"), (70, None, "x"), (71, " \t\n", "x"), (72, "a a " * 24, "x")]
    rows += [(73, "z " * 100_000 + "y", "x"), (74, "é 中\x0b" * 12, "x")]
    got = periodic.find_runs(frame(SCHEMA, rows)).collect()
    assert len(got) == len(rows)
    by_words = {}
    for doc_id, text, _ in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        runs = [(0, 100_000, 1)] if doc_id == 73 else _runs(words)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        by_words[doc_id] = len(words), runs, best, _collapsed(words, runs)
    for row in got:
        strongest = tuple(row.strongest) if row.strongest else None
        assert (row.n_words, [tuple(r) for r in row.runs], strongest, row.collapsed) == by_words[row.doc_id]
    assert periodic.find_runs(frame(SCHEMA, [])).collect() == []
    with pytest.raises(ValueError):
        periodic.find_runs(frame(SCHEMA, []), times=2)


def test_digests_of_the_query(spark, tmp_path):
    random_ = random.Random(5)
    texts = {i: " ".join(f"w{random_.randrange(9)}" for _ in range(random_.randint(0, 120))) for i in range(120)}
    texts[200] = None
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op11_periodic(spark, str(tmp_path)).collect()}
    rewritten = 0
    for doc_id, text in texts.items():
        words = (text or "").split()
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            rewritten += 1
        runs = _runs(words)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        row = got[doc_id]
        assert row.n_runs == len(runs) and row.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(_collapsed(words, runs).encode()).hexdigest()
        assert (row.start, row.length, row.period) == (best or (None, None, None))
        assert row.exponent_milli == (1000 * best[1] // best[2] if best else None)
    assert rewritten > 5 and any(r.n_runs for r in got.values())


def _without_repeats(rows, window):
    first = {}
    cut = [(d, [w.decode() for w in (t or "").encode().split()]) for d, t in rows]
    for d, words in cut:
        for i in range(len(words) - window + 1 if d is not None else 0):
            piece = tuple(words[i : i + window])
            first[piece] = min(first.get(piece, d), d)
    out = []
    for d, words in cut:
        gone = set()
        for i in range(len(words) - window + 1 if d is not None else 0):
            if first[tuple(words[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), kept))
    return sorted(out, key=str)


def _passages(random_, window, letters, n):
    words = [f"w{i}" for i in range(letters)]
    pool = [[random_.choice(words) for _ in range(random_.randint(window - 3, window * 4))] for _ in range(10)]
    rows = []
    for d in range(n):
        text = []
        for _ in range(random_.randint(0, 4)):
            piece = random_.choice(pool)
            if random_.random() < 0.6:
                piece = piece[random_.randint(0, len(piece) // 3) : random_.randint(len(piece) // 2, len(piece))]
                text += piece * random_.choice([1, 1, 1, 2])
            else:
                text += [random_.choice(words) for _ in range(random_.randint(1, window * 2))]
        rows.append((d, " ".join(text)))
    return rows


@pytest.mark.parametrize("window, anchor, letters", [(50, 20, 60), (8, 3, 40), (6, 5, 3), (9, 1, 2)])
def test_repeats_equal_brute_force(frame, window, anchor, letters):
    rows = _passages(random.Random(window), window, letters, 90)
    rows += [(200, rows[3][1]), (200, rows[4][1]), (200, rows[4][1]), (None, rows[5][1]), (None, None), (-5, rows[20][1])]
    rows += [(201, None), (202, ""), (203, "a " * 4000), (204, "a " * 3000), (205, "A " * 300), (206, rows[8][1] + "\x0b" + rows[9][1])]
    got = debruijn.drop_repeats(frame(SCHEMA, [(*r, "x") for r in rows]), window=window, anchor=anchor).collect()
    assert all(r.kept_sha256 == hashlib.sha256(r.kept.encode()).hexdigest() for r in got)
    got = sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got], key=str)
    assert got == _without_repeats(rows, window)
    assert sum(r[2] for r in got) > 1000


def test_no_documents_and_short_ones(frame):
    assert debruijn.drop_repeats(frame(SCHEMA, [])).collect() == []
    got = debruijn.drop_repeats(frame(SCHEMA, [(1, "a b", "x"), (2, "a b", "x")])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (2, 0)]
    with pytest.raises(ValueError):
        debruijn.drop_repeats(frame(SCHEMA, []), window=5, anchor=5)


def test_repeats_of_the_table(spark, small):
    got = {r.doc_id: r for r in op13_debruijn(spark, small).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    expected = _without_repeats(rows, 50)
    assert len(got) == len(expected)
    for doc_id, n_words, n_removed, kept in expected:
        digest = hashlib.sha256(kept.encode()).hexdigest()
        assert (got[doc_id].n_words, got[doc_id].n_removed, got[doc_id].kept_sha256) == (n_words, n_removed, digest)


def test_leftmost_least():
    random_ = np.random.default_rng(1)
    values = random_.integers(0, 6, 200).astype(np.uint64)
    for width in (1, 2, 3, 7, 31, 200):
        expected = [i + int(values[i : i + width].argmin()) for i in range(len(values) - width + 1)]
        assert debruijn.leftmost_least(values, width).tolist() == expected


def test_word_chunks_keep_rows_whole():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3, 4], "text": ["a b c", None, "d", "e f"]})
    chunks = [(c.column("id").to_pylist(), w, e.tolist()) for c, w, e in word_chunks(iter([batch]), least=2)]
    assert chunks == [([1], [b"a", b"b", b"c"], [3]), ([2, 3, 4], [b"d", b"e", b"f"], [0, 1, 3])]
