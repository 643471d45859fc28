"""Embedding near-duplicates by spherical-cap filters.

Filters are random directions put together from parts: a vector is cut into parts, each part has its own code book, and
a filter is one entry per book. The filters whose direction a vector exceeds a threshold for are found part by part,
without going through all of them. Vectors that share a filter are compared: first by codes of a byte per component,
which bound the cosine from above, and only vectors with a partner that may be near enough move whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import groups, stored, unit, vectors_of
from textloom.llm.components import connected_components

THRESHOLD = 0.93
FILTERS = 24
LEAST_FILTERS = 12
MISS = 1e-4
DEPENDENCE = 3.0
LEAST_CHANCE = 0.3
OCCUPANCY = 1024
CODE_BLOCK = 4096
BLOCK = 1024
STRIP = 1024


def _angles(dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Angles, and the share of random directions within each angle of a given one."""
    angles = np.linspace(0, math.pi, 20_001)
    density = np.sin(angles) ** max(0, dimension - 2)
    within = np.append(0, np.cumsum((density[1:] + density[:-1]) / 2))
    return angles, within / within[-1]


def cap_cut(dimension: int, share: float) -> float:
    """The cosine that a ``share`` of random directions exceeds."""
    angles, within = _angles(dimension)
    return math.cos(np.interp(share, within, angles))


def chance_in_cap(dimension: int, share: float, cosine: float) -> float:
    """How likely a filter with a direction in its cap of a ``share`` of all has one at ``cosine`` to it as well."""
    cut, cosine = cap_cut(dimension, share), min(cosine, 1 - 1e-9)
    if dimension < 3:
        return max(0.0, 1 - math.acos(cosine) / (2 * math.acos(cut))) if dimension == 2 else 1.0
    to = np.arccos(cut) * (np.arange(1000) + 0.5) / 1000
    weights = (np.sin(to) / math.sin(math.acos(cut))) ** (dimension - 2)
    needed = (cut - cosine * np.cos(to)) / (math.sqrt(1 - cosine * cosine) * np.sin(to))
    angles, within = _angles(dimension - 1)
    return float(weights @ np.interp(np.arccos(np.clip(needed, -1, 1)), angles, within) / weights.sum())


def caps_for(dimension: int, count: int, cosine: float = THRESHOLD, miss: float = MISS) -> tuple[float, int]:
    """Share of all directions in a cap, and the filters per vector with which a pair at ``cosine`` has none in common
    once in 1 / ``miss``, among ``count`` vectors.

    Caps get smaller as tables grow, and a pair's chance in each with them, so the number rises; where the chance falls
    below ``LEAST_CHANCE``, caps get no smaller. ``DEPENDENCE`` allows for filters that share the entries of a book.
    """
    share = min(0.5, OCCUPANCY / max(1, count))
    while (chance := chance_in_cap(dimension, share, cosine)) < LEAST_CHANCE and share < 0.5:
        share = min(0.5, share * 1.25)
    return share, math.ceil(DEPENDENCE * math.log(miss) / math.log1p(-min(chance, 1 - 1e-9)))


class Filters:
    """A product code for one dimension, sized for ``count`` vectors with pairs at a cosine of ``threshold``."""

    def __init__(
        self, dimension: int, count: int, filters: float = FILTERS, seed: int = 1, threshold: float = THRESHOLD
    ):
        parts = 1 if dimension < 8 else 2
        share, needed = caps_for(dimension, count, threshold)
        self.least, filters = max(LEAST_FILTERS, needed), max(filters, needed)
        self.book = max(8, math.ceil(max(64.0, filters / share) ** (1 / parts)))
        random = np.random.default_rng([seed, dimension])
        self.rotation = np.linalg.qr(random.standard_normal((dimension, dimension)))[0]
        self.cuts = np.linspace(0, dimension, parts + 1).astype(int)
        self.books = []
        for begin, end in zip(self.cuts, self.cuts[1:]):
            book = random.standard_normal((self.book, end - begin))
            self.books.append(book / np.sqrt((book * book).sum(axis=1, keepdims=True) * parts))
        self.step = 0.1 / math.sqrt(dimension)
        self.threshold = cap_cut(dimension, min(0.5, filters / self.book**parts))

    def decode(self, directions: np.ndarray) -> list[np.ndarray]:
        """Sorted filters of each direction: all beyond the threshold, which is lowered until there are a few."""
        turned = directions @ self.rotation
        scores = [turned[:, a:b] @ book.T for a, b, book in zip(self.cuts, self.cuts[1:], self.books)]
        return [self._list([s[i] for s in scores]) for i in range(len(directions))]

    def _list(self, scores: list[np.ndarray]) -> np.ndarray:
        least = min(self.least, self.book ** len(scores))
        bound = self.threshold
        while True:
            best = [s.max() for s in scores]
            sums, numbers = np.zeros(1), np.zeros(1, np.int64)
            for k, own in enumerate(scores):
                need = bound - sum(best[k + 1 :])
                entries = np.flatnonzero(own >= need - sums.max())
                total = sums[:, None] + own[entries]
                rows, columns = np.nonzero(total >= need)
                sums, numbers = total[rows, columns], numbers[rows] * self.book + entries[columns]
                if not len(numbers):
                    break
            if len(numbers) >= least:
                return np.sort(numbers)
            bound -= self.step


def _prepared(embeddings: DataFrame, vectors: str) -> DataFrame:
    """``(vec_id, label, digest, dimension, vector)``; a vector that takes part in nothing has a null digest."""

    def prepare(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            found = vectors_of(batch.column(vectors))
            labels = batch.column("label").to_pylist()
            ids = batch.column("vec_id").to_pylist()
            packed = [
                None if v is None or label is None or i is None else v.tobytes() for v, label, i in zip(found, labels, ids)
            ]
            digests = [
                None if p is None else xxhash.xxh3_128_digest(f"{label}:{len(v)}:".encode() + p)
                for p, v, label in zip(packed, found, labels)
            ]
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(digests, pa.binary())]
            columns += [pa.array([None if v is None else len(v) for v in found], pa.int32()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "digest", "dimension", "vector"])

    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", vectors)
    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(prepare, f"vec_id long, label {kind}, digest binary, dimension int, vector binary")


def codes_of(directions: np.ndarray) -> list[bytes]:
    """Each direction as a byte per component, after its scale and the length of what rounding left out."""
    scale = (np.abs(directions).max(axis=1, keepdims=True) / 127).astype(np.float32)
    whole = np.clip(np.rint(directions / scale), -127, 127).astype(np.int8)
    lost = np.sqrt(((directions - whole * scale.astype(np.float64)) ** 2).sum(axis=1, keepdims=True))
    heads = np.concatenate([scale, lost * 1.000001 + 1e-7], axis=1).astype(np.float32)
    return [head.tobytes() + row.tobytes() for head, row in zip(heads, whole)]


def cosine_bounds(one: list[bytes], other: list[bytes]) -> np.ndarray:
    """No less than the cosines between directions, from their codes alone.

    With u = a + e and v = b + f, u.v = a.b + e.v + a.f, which exceeds a.b by |e| + |f| + |e||f| at most.
    """

    def opened(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
        heads = np.ascontiguousarray(flat[:, :8]).view(np.float32)
        return flat[:, 8:].view(np.int8) * heads[:, :1], heads[:, 1:]

    (a, e), (b, f) = opened(one), opened(other)
    return np.hstack([a, e, np.ones_like(e), e]) @ np.hstack([b, np.ones_like(f), f, f]).T + np.float32(1e-5)


def _filtered(classes: DataFrame, dtype: str, count: int, threshold: float) -> DataFrame:
    """``(key, label, dimension, code, filters)`` per class; ``filters`` are all of the class."""

    def decode(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Filters] = {}
        for batch in frames:
            lists: list[np.ndarray] = []
            codes: list[bytes] = []
            for dimension, packed in zip(batch.column("dimension").to_pylist(), batch.column("vector")):
                if dimension not in known:
                    known[dimension] = Filters(dimension, count, threshold=threshold)
                direction = unit(np.frombuffer(packed.as_buffer(), dtype)[None, :])
                lists += known[dimension].decode(direction)
                codes += codes_of(direction)
            ends = np.cumsum([0, *map(len, lists)])
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            arrays = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            kept = [batch.column(c) for c in ("key", "label", "dimension")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(codes, pa.binary()), arrays], names)

    names = ["key", "label", "dimension", "code", "filters"]
    kind = classes.schema["label"].dataType.simpleString()
    schema = f"key long, label {kind}, dimension int, code binary, filters array<long>"
    return classes.select("key", "label", "dimension", "vector").mapInArrow(decode, schema)


def _tasks(rows: DataFrame, size: int) -> DataFrame:
    """Rows once per filter, dealt to ``(label, dimension, filter, i, j)``: blocks i <= j of about ``size`` of a filter's
    classes of one label. Few filters need more than one block, so only those are looked up."""
    keys = ["label", "dimension", "filter"]
    counts = rows.select("label", "dimension", F.explode("filters").alias("filter")).groupBy(*keys).count()
    counts = counts.where(F.col("count") > size)
    counts = stored(counts.select(*keys, F.ceil(F.col("count") / F.lit(float(size))).cast("int").alias("k")), "large")
    each = rows.withColumn("filter", F.explode("filters")).join(counts, keys, "left").withColumn("k", F.coalesce("k", F.lit(1)))
    block = F.pmod(F.xxhash64("key", F.lit(2)), "k").cast("int")
    tasks = F.transform(
        F.sequence(F.lit(0), F.col("k") - 1),
        lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")),
    )
    dealt = each.withColumn("block", block).withColumn("task", F.explode(tasks)).select("*", "task.i", "task.j")
    order = [*keys, "i", "j"]
    return dealt.drop("task", "k").repartition(*order).sortWithinPartitions(*order, "block", "key")


def _promising(threshold: float):
    """``(key, filter)`` of the classes that have another one in the filter which may be within the threshold."""
    size = STRIP

    def sift(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(frames, ["label", "dimension", "filter", "i", "j"]):
            n = group.num_rows
            block, codes = group.column("block").to_numpy(), group.column("code").to_pylist()
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            one, other = np.flatnonzero(block == i), np.flatnonzero(block == j)
            near = np.zeros(n, bool)
            against = [codes[r] for r in other]
            for begin in range(0, len(one) if len(other) else 0, size):
                strip = one[begin : begin + size]
                close = cosine_bounds([codes[r] for r in strip], against) >= threshold
                if i == j:
                    close[np.arange(len(strip)), np.arange(begin, begin + len(strip))] = False
                near[strip] |= close.any(axis=1)
                near[other] |= close.any(axis=0)
            if near.any():
                kept = group.select(["key", "filter"]).filter(pa.array(near))
                yield from kept.combine_chunks().to_batches()

    return sift


def _first_common(filters: pa.ChunkedArray, below: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether pairs of rows (x, y) share no filter below the given one."""
    rows = np.union1d(x, y)
    lists = filters.take(pa.array(rows)).combine_chunks()
    owner = np.repeat(np.arange(len(rows)), np.diff(lists.offsets.to_numpy()))
    flat = lists.flatten().to_numpy()
    owner, flat = owner[flat < below], flat[flat < below]
    _, column, uses = np.unique(flat, return_inverse=True, return_counts=True)
    shared = uses > 1
    places = np.cumsum(shared) - 1
    owner, column = owner[shared[column]], places[column[shared[column]]]
    if not len(owner):
        return np.ones(len(x), bool)
    has = np.zeros((len(rows), int(shared.sum())), np.float32)
    has[owner, column] = 1
    a, b = np.searchsorted(rows, x), np.searchsorted(rows, y)
    return (has @ has.T)[a, b] == 0


def _compare(dtype: str, threshold: float):
    schema = pa.schema([("digest", pa.binary()), ("rep", pa.int64()), ("joins", pa.int64()), ("links", pa.int64())])

    def within(group: pa.Table) -> pa.Table | None:
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        block = group.column("block").to_numpy()
        n, dimension = group.num_rows, group.column("dimension")[0].as_py()
        packed = b"".join(group.column("vector").to_pylist())
        directions = unit(np.frombuffer(packed, dtype).reshape(n, dimension))
        one, other = np.flatnonzero(block == i), np.flatnonzero(block == j)
        x, y = np.nonzero(directions[one] @ directions[other].T >= threshold)
        x, y = one[x], other[y]
        if i == j:
            x, y = x[x < y], y[x < y]
        if not len(x):
            return None
        copies = group.column("copies").to_numpy()
        first = _first_common(group.column("filters"), group.column("filter")[0].as_py(), x, y)
        links = np.bincount(x[first], copies[y[first]], n) + np.bincount(y[first], copies[x[first]], n)
        reps = group.column("rep").to_numpy()
        joins, before = reps.copy(), None
        while before is None or (joins != before).any():
            before = joins.copy()
            np.minimum.at(joins, x, before[y])
            np.minimum.at(joins, y, joins[x])
        rows = np.union1d(x, y)
        columns = [group.column("digest").take(pa.array(rows)), reps[rows], joins[rows], links[rows].astype(np.int64)]
        return pa.table(dict(zip(schema.names, columns)), schema)

    def compare(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(frames, ["label", "dimension", "filter", "i", "j"]):
            found = within(group)
            if found is not None:
                yield from found.combine_chunks().to_batches()

    return compare


def near_duplicates(embeddings: DataFrame, vectors: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row: vectors of one label linked by a cosine of ``threshold`` or more.

    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest id that links reach, and ``kept``
    marks it. Equal vectors of a label are one class, compared once and counted with all its rows. A pair is counted in
    the first of the filters that both have, so tasks give back a row per vector, never a row per pair. Codes say which
    vectors have a partner at all, and in which filters; whole vectors move to those alone.

    Vectors that are null, empty or zero, or hold null or non-finite components, and rows without label link with
    nothing; nor do rows without id, whose ``component_id`` is null and which are kept. Vectors of different dimensions
    are never linked. Rows that share an id count each for itself, and are one in a component. No rows give none, and
    other columns are ignored.
    """
    array = embeddings.schema[vectors].dataType
    dtype = "float32" if array.elementType.simpleString() == "float" else "float64"
    rows = stored(_prepared(embeddings, vectors), "vectors")
    known = rows.where("digest IS NOT NULL")
    classes = known.groupBy("digest", "label", "dimension", "vector").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")
    )
    classes = stored(classes.withColumn("key", F.xxhash64("digest")), "classes")
    filtered = stored(_filtered(classes, dtype, classes.count(), threshold), "filters")
    codes = _tasks(filtered, CODE_BLOCK).select("key", "label", "dimension", "filter", "i", "j", "block", "code")
    promising = codes.mapInArrow(_promising(threshold), "key long, filter long")
    promising = stored(promising.groupBy("key").agg(F.array_sort(F.collect_set("filter")).alias("filters")), "promising")
    whole = stored(classes.join(promising, "key"), "whole")
    schema = "digest binary, rep long, joins long, links long"
    found = stored(_tasks(whole, BLOCK).mapInArrow(_compare(dtype, threshold), schema), "found")
    linked = connected_components(found, "rep", "joins").withColumnRenamed("node", "rep")
    links = found.groupBy("digest").agg(F.sum("links").alias("links"))
    facts = classes.select("digest", "rep", "copies").join(links, "digest", "left").join(linked, "rep", "left")
    facts = facts.select(
        "digest",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "rep").alias("component"),
    )
    joined = rows.select("vec_id", "digest").join(facts, "digest", "left")
    component = F.coalesce("component", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
