"""Runs of periodic words in each document, by seeds on diagonals that are extended.

Two words a lag apart lie on that lag's diagonal. A run of period q and length L agrees with itself on L - q places of
the diagonal q: at least ``max(min_length - q, (times - 1) * q)``. So stretches of k words, k being the least of these,
are indexed, and any run of period up to k has such a stretch that recurs q words later; periods in (k, 2k] are found
with stretches of 2k words, and so on. As stretches are no shorter than the lag, the next place of the same stretch is
exactly one smallest period away (otherwise two periods would meet in one stretch, and their greatest common divisor
would be a smaller one), so only pairs of neighbouring places are enumerated, not all pairs. Each is extended both ways,
unless it lies in what the lag has covered so far.

Stretches are named exactly, by pairs of names of half their length, so no hash can join different words; a stretch that
occurs once in its document loses its name and drops out of all longer ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm.common import word_chunks

MIN_LENGTH, TIMES = 24, 3

Order = Callable[[object, int], "np.ndarray | None"]


class Numbers(dict):
    """A number for each distinct word."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def numbered(words: list[bytes], ends: np.ndarray) -> np.ndarray:
    """Words as numbers that no two documents share."""
    ids = np.fromiter(map(Numbers().__getitem__, words), np.int64, len(words))
    return ids + np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)) * (len(words) + 1)


def named(keys: np.ndarray, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Names from 1 for the keys that occur more than once, 0 elsewhere, and the places that have one."""
    _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
    again = count[number] > 1
    names = np.zeros(size, np.int64)
    names[places[again]] = number[again] + 1
    return names, places[again]


def lengthened(names: np.ndarray, places: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the stretches that begin as the named ones do and end ``step`` words later."""
    places = places[: np.searchsorted(places, len(names) - step)]
    places = places[names[places + step] > 0]
    return named(names[places] * (len(names) + 1) + names[places + step], places, len(names))


def agreement(a: np.ndarray, b: np.ndarray) -> int:
    """How many first entries are equal, looked at in growing blocks."""
    done, block, most = 0, 64, min(len(a), len(b))
    while done < most:
        differ = np.flatnonzero(a[done : min(done + block, most)] != b[done : min(done + block, most)])
        if len(differ):
            return done + int(differ[0])
        done, block = done + block, 2 * block
    return most


def extended(ids: np.ndarray, starts: np.ndarray, lags: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """``(start, length, period)`` of the longest stretch around each seed, each stretch once."""
    size = len(ids)
    seeds = np.sort(lags * size + starts)
    i = 0
    while i < len(seeds):
        lag, start = divmod(int(seeds[i]), size)
        left = start - agreement(ids[:start][::-1], ids[lag : lag + start][::-1])
        covered = start + k + agreement(ids[start + k :], ids[start + k + lag :])
        yield left, covered - left + lag, lag
        i = int(np.searchsorted(seeds, lag * size + covered))


def runs_of(ids: np.ndarray, longest: int, min_length: int = MIN_LENGTH, times: int = TIMES) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs in a sequence of numbers, by start and then period.

    ``longest`` is the length of its longest document. Work grows with the words times the logarithm of that.
    """
    k = min(max(min_length - q, (times - 1) * q) for q in range(1, min_length + 1))
    names, places = named(ids, np.arange(len(ids)), len(ids))
    length = 1
    while length < k and len(places):
        names, places = lengthened(names, places, min(length, k - length))
        length += min(length, k - length)
    found, shortest = [], 0
    while len(places) and shortest * times < longest:
        order = places[np.argsort(names[places], kind="stable")]
        lags = np.diff(order)
        seeds = (np.diff(names[order]) == 0) & (lags > shortest) & (lags <= k)
        for run in extended(ids, order[:-1][seeds], lags[seeds], k):
            if run[1] >= max(min_length, times * run[2]):
                found.append(run)
        names, places = lengthened(names, places, k)
        shortest, k = k, 2 * k
    return sorted(found, key=lambda run: (run[0], run[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length over period; of equal ones that which starts first, then has the smaller period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def reordered(keys: list, ends: np.ndarray, order: Order) -> np.ndarray:
    """Which word stands at each place, where documents are read in another order."""
    places = np.arange(ends[-1] if len(ends) else 0)
    for key, start, end in zip(keys, [0, *ends[:-1].tolist()], ends.tolist()):
        other = order(key, end - start) if end > start else None
        if other is not None:
            places[start:end] = start + other
    return places


def find_runs(
    docs: DataFrame, key: str = "doc_id", min_length: int = MIN_LENGTH, times: int = TIMES, order: Order | None = None
) -> DataFrame:
    """``(key, n_words, runs, strongest, collapsed)`` per row of ``docs``, whose column ``text`` is split at white space.

    A run is a stretch of words with smallest period q and at least ``min_length`` and ``times * q`` words (``times``
    from 3) that no neighbouring word extends. ``runs`` are structs of start, length and period, by start and then
    period; ``strongest`` is the one of most periods, null without runs. ``collapsed`` is the text without the words that
    a run holds after its first period, joined by one space. ``order(key, n)`` may give the word numbers to read instead
    of 0 to n - 1. A row's work stays in its task, and nothing is shuffled.

    A null text has no words, and ``collapsed`` is empty then. Rows with equal or null keys are documents of their own;
    no rows give none; other columns are ignored.
    """
    if times < 3 or min_length < 2:
        raise ValueError("times must be 3 or more, and min_length 2 or more")
    struct = "struct<start: long, length: long, period: long>"

    def search(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])
        for rows, words, ends in word_chunks(frames):
            keys = rows.column(0).to_pylist()
            ids = numbered(words, ends)
            places = reordered(keys, ends, order) if order else np.arange(len(ids))
            ids = ids[places]
            sizes = np.diff(ends, prepend=0)
            dropped = np.zeros(len(ids) + 1, np.int64)
            per_row: list[list[tuple[int, int, int]]] = [[] for _ in keys]
            runs = runs_of(ids, int(sizes.max()), min_length, times)
            for (start, length, period), row in zip(runs, np.searchsorted(ends, [r[0] for r in runs], "right").tolist()):
                dropped[start + period] += 1
                dropped[start + length] -= 1
                per_row[row].append((start - int(ends[row] - sizes[row]), length, period))
            kept = np.cumsum(dropped[:-1]) == 0
            texts = [
                b" ".join([words[i] for i in places[start:end][kept[start:end]].tolist()])
                for start, end in zip((ends - sizes).tolist(), ends.tolist())
            ]
            as_entries = lambda found: [dict(zip(("start", "length", "period"), r)) for r in found]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array(sizes),
                    pa.array([as_entries(found) for found in per_row], pa.list_(entry)),
                    pa.array([as_entries([strongest(found)])[0] if found else None for found in per_row], entry),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                ],
                [key, "n_words", "runs", "strongest", "collapsed"],
            )

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_words long, runs array<{struct}>, strongest {struct}, collapsed string"
    return docs.select(key, "text").mapInArrow(search, schema)
