"""Nearest neighbours by shifted space-filling curves, completed exactly.

Several Hilbert curves, each over its own rotated and shifted projection, put the vectors into orders, which are cut
into blocks of equal size. A query goes to the blocks around its own on each curve, as many as a sample of queries
needs for the recall asked for. What that leaves open is settled by the blocks of the first curve: a query also goes to
a block unless its centre and radius prove that it holds nothing nearer than what was found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import groups, stored, vectors_of

CURVES = 4
AXES = 8
BITS = 7
BLOCK_BYTES = 1 << 20
QUERY_ROWS = 512
STRIP = 128
CENTRES = 4096
SAMPLE = 8192
RECALL = 0.95
ASKED = 128
WIDTH = 2


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each row of grid coordinates along the Hilbert curve: undo rotations, Gray-decode, interleave bits."""
    axes = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    for bit in range(bits - 1, 0, -1):
        q, p = 1 << bit, (1 << bit) - 1
        for i, axis in enumerate(axes):
            inverted = (axis & q) != 0
            swapped = np.where(inverted, 0, (axes[0] ^ axis) & p)
            axes[0] = axes[0] ^ np.where(inverted, p, swapped)
            if i:
                axes[i] = axis ^ swapped
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turned = np.zeros_like(axes[0])
    for bit in range(bits - 1, 0, -1):
        turned ^= np.where((axes[-1] & (1 << bit)) != 0, (1 << bit) - 1, 0)
    keys = np.zeros_like(turned)
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            keys = (keys << 1) | (((axis ^ turned) >> bit) & 1)
    return keys


class Curve:
    """One projection of one dimension, spread over the grid by the mean and spread of a sample."""

    def __init__(self, dimension: int, number: int, sample: np.ndarray, seed: int = 7):
        random = np.random.default_rng([seed, dimension, number])
        axes = min(AXES, dimension)
        self.axes = np.linalg.qr(random.standard_normal((dimension, axes)))[0]
        placed = sample @ self.axes if len(sample) else np.zeros((1, axes))
        self.mean, self.spread = placed.mean(axis=0), placed.std(axis=0)
        self.spread[self.spread == 0] = 1.0
        self.shift = random.uniform(0, 1, axes)  # in widths of the data, which fill half of the grid

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        level = (vectors @ self.axes - self.mean) / self.spread
        share = 1 / (1 + np.exp(-1.7 * np.clip(level, -20, 20)))  # about the normal distribution function
        cells = np.floor((share + self.shift) / 2 * (1 << BITS)).astype(np.int64)
        return hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1))


def _prepared(embeddings: DataFrame, vectors: str) -> DataFrame:
    def prepare(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            packed = [None if v is None else v.astype(np.float64).tobytes() for v in vectors_of(batch.column(vectors))]
            digests = [None if p is None else xxhash.xxh3_128_digest(p) for p in packed]
            columns = [batch.column("vec_id"), pa.array(digests, pa.binary()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "digest", "vector"])

    rows = embeddings.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), vectors)
    return rows.mapInArrow(prepare, "vec_id long, digest binary, vector binary").where("vector IS NOT NULL")


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """Equal vectors as one row with their ``k + 1`` smallest ids, which are all that can be among anyone's nearest."""
    smallest = Window.partitionBy("digest").orderBy("vec_id")
    few = rows.withColumn("nth", F.row_number().over(smallest)).where(F.col("nth") <= k + 1)
    ids = F.array_sort(F.collect_list("vec_id")).alias("ids")
    return few.groupBy("digest", "vector").agg(ids).withColumn("dimension", (F.octet_length("vector") / 8).cast("int"))


def _curves(classes: DataFrame) -> dict[int, list[Curve]]:
    """Curves per dimension; only means and spreads are fitted, on about ``SAMPLE`` classes taken by hash."""
    share = min(1.0, SAMPLE / max(1, classes.count()))
    fine = 1 << 30
    taken = classes.where(F.pmod(F.xxhash64("digest"), F.lit(fine)) < int(share * fine))
    found = taken.select("digest", "vector").toArrow().sort_by("digest").column("vector").to_pylist()
    by_dimension: dict[int, list[np.ndarray]] = {}
    for packed in found:
        vector = np.frombuffer(packed)
        by_dimension.setdefault(len(vector), []).append(vector)
    return {d: [Curve(d, i, np.array(v)) for i in range(CURVES)] for d, v in by_dimension.items()}


def _keyed(rows: DataFrame, curves: dict[int, list[Curve]], numbers: range) -> DataFrame:
    """Rows once per curve, with ``curve`` and ``key``."""

    def place(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dict(curves)
        for batch in frames:
            dimensions = batch.column("dimension").to_numpy()
            for dimension in np.unique(dimensions).tolist():
                part = batch.filter(pa.array(dimensions == dimension))
                packed = b"".join(part.column("vector").to_pylist())
                matrix = np.frombuffer(packed).reshape(part.num_rows, dimension)
                if dimension not in known:
                    known[dimension] = [Curve(dimension, i, matrix[:0]) for i in range(CURVES)]
                for number in numbers:
                    keys = pa.array(known[dimension][number].keys(matrix))
                    added = [pa.array(np.full(part.num_rows, number, np.int32)), keys]
                    yield pa.RecordBatch.from_arrays([*part.columns, *added], [*part.schema.names, "curve", "key"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", curve int, key long"
    return rows.mapInArrow(place, schema)


def _runs(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
    """Stretches of rows that agree in ``names``, with their values."""
    values = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names], axis=1)
    starts = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1 if len(values) else []
    ends = [*starts, len(values)]
    for begin, end in zip([0, *starts], ends):
        if end > begin:
            yield tuple(values[begin].tolist()), batch.slice(begin, end - begin)


def _placed(classes: DataFrame, curves: dict[int, list[Curve]]) -> DataFrame:
    """``(curve, dimension, digest, block, last)``: the block of each class along each curve, and the curve's last one.

    Only keys are sorted: range-partitioned, numbered within their partition, and moved on by the rows before it. The
    digest tells equal keys apart, so blocks are of one size and do not depend on the partitions.
    """
    order = ["curve", "dimension", "key", "digest"]
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = _keyed(classes.select("digest", "vector", "dimension"), curves, range(CURVES)).select(*order)

    def number(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), dict[tuple[int, ...], int]()
        for batch in frames:
            for place, rows in _runs(batch, ["curve", "dimension"]):
                begin = before.get(place, 0)
                before[place] = begin + rows.num_rows
                at = [pa.array(np.full(rows.num_rows, part, np.int32)), pa.array(np.arange(begin, before[place]))]
                kept = [rows.column(c) for c in ("curve", "dimension", "digest")]
                yield pa.RecordBatch.from_arrays([*kept, *at], ["curve", "dimension", "digest", "part", "at"])

    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = "curve int, dimension int, digest binary, part int, at long"
    numbered = stored(ordered.mapInArrow(number, schema), "numbered")
    along = Window.partitionBy("curve", "dimension").orderBy("part")
    counts = numbered.groupBy("curve", "dimension", "part").agg(F.count(F.lit(1)).alias("n"))
    starts = stored(
        counts.select(
            "curve", "dimension", "part",
            (F.sum("n").over(along) - F.col("n")).alias("before"),
            F.sum("n").over(Window.partitionBy("curve", "dimension")).alias("total"),
        ),
        "starts",
    )
    size = F.greatest(F.lit(64), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dimension")))).cast("long")
    return numbered.join(starts, ["curve", "dimension", "part"]).select(
        "curve", "dimension", "digest",
        F.floor((F.col("at") + F.col("before")) / size).cast("int").alias("block"),
        F.floor((F.col("total") - 1) / size).cast("int").alias("last"),
    )


def _matrix(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("vector").to_pylist())).reshape(rows.num_rows, -1)


def nearest(
    queries: np.ndarray, query_ids: list[int], vectors: np.ndarray, ids: list[list[int]], k: int, bounds=None
) -> list[tuple[int, int, float]]:
    """``(query_id, vec_id, distance)``: the ``k`` nearest of each query, all ties included, none beyond its bound.

    A matrix product finds the candidates, with room for its rounding; the distances are then worked out component by
    component.
    """
    found = []
    norms = (vectors * vectors).sum(axis=1)
    for q, (query, own) in enumerate(zip(queries, query_ids)):
        if q % STRIP == 0:
            products = queries[q : q + STRIP] @ vectors.T
        square = query @ query
        rough = norms - 2 * products[q % STRIP] + square
        room = 1e-9 * (square + norms)
        low = rough - room
        limit = np.inf if len(rough) <= k else np.partition(rough + room, k)[k]
        if bounds is not None:
            limit = min(limit, bounds[q] ** 2 * (1 + 1e-9))
        near = np.flatnonzero(~(low > limit))
        exact = np.sqrt(np.cumsum((vectors[near] - query) ** 2, axis=1)[:, -1])
        rows = sorted((float(s), v) for s, i in zip(exact, near.tolist()) for v in ids[i] if v != own)
        found += [(own, v, s) for s, v in rows[:k]]
    return found


_FOUND = "query_id long, vec_id long, score double"


def _found(rows: list[tuple[int, int, float]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))]
    return pa.RecordBatch.from_arrays(arrays, ["query_id", "vec_id", "score"])


def _searched(asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Nearest rows of each query in the block that it is sent to, none beyond its bound.

    ``asked`` is ``(curve, dimension, block, query_id, vector, bound)``, ``rows`` ``(curve, dimension, block, vector,
    ids)``. A task holds one block, and queries pass by it in batches.
    """

    def search(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, opened = None, [], None
        for batch in frames:
            for (*place, is_query), run in _runs(batch, ["curve", "dimension", "block", "is_query"]):
                if place != at:
                    at, held, opened = place, [], None
                if not is_query:
                    held.append(run)
                    continue
                if opened is None:
                    block = pa.Table.from_batches(held)
                    opened = _matrix(block), block.column("ids").to_pylist()
                ids, bounds = run.column("query_id").to_pylist(), run.column("bound").to_numpy()
                yield _found(nearest(_matrix(run), ids, *opened, k, bounds))

    where = ["curve", "dimension", "block"]
    none = F.lit(None)
    queries = asked.select(*where, F.lit(True).alias("is_query"), "query_id", "bound", "vector", none.cast("array<long>").alias("ids"))
    both = rows.select(
        *where, F.lit(False).alias("is_query"), none.cast("long").alias("query_id"), none.cast("double").alias("bound"),
        "vector", "ids",
    ).unionByName(queries)
    return both.repartition(*where).sortWithinPartitions(*where, "is_query").mapInArrow(search, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each query; cut per task before the shuffle."""
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _widths(classes: DataFrame, placed: DataFrame, queries: DataFrame, k: int) -> dict[int, int]:
    """Blocks to either side per dimension within which, on one curve at least, ``RECALL`` of the true neighbours of
    about ``ASKED`` queries lie. These few are compared with all rows; they fit nothing else."""
    vectors = queries.select("digest", "vector", "dimension").distinct()
    share, fine = min(1.0, ASKED / max(1, vectors.count())), 1 << 30
    taken = vectors.where(F.pmod(F.xxhash64(F.lit(3), "digest"), F.lit(fine)) < int(share * fine)).toArrow()
    asked: dict[int, list[tuple[bytes, np.ndarray]]] = {}
    for row in taken.to_pylist():
        asked.setdefault(row["dimension"], []).append((row["digest"], np.frombuffer(row["vector"])))

    def compare(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            dimensions, digests = batch.column("dimension").to_numpy(), batch.column("digest")
            for dimension, known in asked.items():
                rows = np.flatnonzero(dimensions == dimension)
                if not len(rows):
                    continue
                matrix = _matrix(batch.take(pa.array(rows)))
                for own, vector in known:
                    away = np.sqrt(((matrix - vector) ** 2).sum(axis=1))
                    few = np.argpartition(away, k)[: k + 1] if len(away) > k + 1 else np.arange(len(away))
                    found = [pa.array([own] * len(few), pa.binary()), digests.take(pa.array(rows[few])), pa.array(away[few])]
                    yield pa.RecordBatch.from_arrays(found, ["own", "digest", "away"])

    pairs = classes.select("digest", "vector", "dimension").mapInArrow(compare, "own binary, digest binary, away double")
    order = Window.partitionBy("own").orderBy("away", "digest")
    nearby = pairs.withColumn("nth", F.row_number().over(order)).where((F.col("nth") <= k + 1) & (F.col("own") != F.col("digest")))
    nearby = stored(nearby.select("own", "digest"), "nearby")
    there = nearby.join(placed, "digest")
    here = placed.select(F.col("digest").alias("own"), "curve", F.col("block").alias("from"))
    apart = there.join(here, ["own", "curve"]).groupBy("own", "digest", "dimension")
    apart = apart.agg(F.min(F.abs(F.col("block") - F.col("from"))).alias("apart")).select("dimension", "apart").collect()
    widths: dict[int, list[int]] = {}
    for row in apart:
        widths.setdefault(row.dimension, []).append(row.apart)
    return {d: sorted(w)[math.ceil(RECALL * len(w)) - 1] for d, w in widths.items()}


def nearest_neighbours(
    embeddings: DataFrame, vectors: str = "embedding", k: int = 10, every: int = 100, exact: bool = True
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows by Euclidean distance, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``; a query's own id is no candidate. Rows with equal vectors
    are one class that keeps its ``k + 1`` smallest ids. Each curve's order is cut into blocks, and a query goes to the
    blocks around its own, as many as ``RECALL`` asks for. With ``exact`` the k-th distance so found bounds the search
    of the first curve's other blocks, which ends in the true neighbours; a query goes to those only that centre and
    radius do not rule out. Without it the result is what the curves found.

    Vectors that are null, empty or zero, or hold null or non-finite components, and rows without id take no part.
    Distances are between vectors of one dimension only. A query with fewer than ``k`` candidates gets all of them,
    and one without any no row; so no rows give none. A repeated id with one vector counts once. Other columns are
    ignored.
    """
    classes = stored(_classes(_prepared(embeddings, vectors), k), "classes")
    # a class of copies may hold more queries than the ids it keeps
    queries = stored(
        _prepared(embeddings.where(F.col("vec_id") % every == 0), vectors)
        .select(F.col("vec_id").alias("query_id"), "digest", "vector")
        .distinct()
        .withColumn("dimension", (F.octet_length("vector") / 8).cast("int")),
        "queries",
    )
    placed = stored(_placed(classes, _curves(classes)), "placed")
    widths = [F.lit(n) for pair in _widths(classes, placed, queries, k).items() for n in pair]
    width = F.coalesce(F.create_map(*widths)[F.col("dimension")], F.lit(WIDTH)) if widths else F.lit(WIDTH)
    windows = queries.join(placed.drop("dimension"), "digest").select(
        "query_id", "vector", "dimension", "curve",
        F.greatest(F.lit(0), F.col("block") - width).alias("first"), F.least("last", F.col("block") + width).alias("until"),
    )
    windows = stored(windows, "windows")
    rows = placed.join(classes.select("digest", "vector", "ids"), "digest")
    near = windows.withColumn("block", F.explode(F.sequence("first", "until"))).withColumn("bound", F.lit(float("inf")))
    found = stored(_searched(near, rows, k), "found")
    if exact:
        first = rows.where("curve = 0")
        asked = _open(windows.where("curve = 0"), first, found, k).withColumn("curve", F.lit(0))
        found = found.unionByName(_searched(asked, first, k))
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _centres(rows: DataFrame) -> DataFrame:
    """``(dimension, block, centre, radius)`` of each block."""

    def measure(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in groups(frames, ["dimension", "block"]):
            matrix = _matrix(block)
            centre = matrix.mean(axis=0)
            radius = float(np.sqrt(((matrix - centre) ** 2).sum(axis=1)).max())
            columns = [[block.column(c)[0].as_py()] for c in ("dimension", "block")] + [[centre.tobytes()], [radius]]
            yield pa.RecordBatch.from_pydict(dict(zip(names, columns)), pa.schema(list(zip(names, kinds))))

    names, kinds = ["dimension", "block", "centre", "radius"], [pa.int32(), pa.int32(), pa.binary(), pa.float64()]
    dealt = rows.select("dimension", "block", "vector").repartition("dimension", "block")
    schema = "dimension int, block int, centre binary, radius double"
    return dealt.sortWithinPartitions("dimension", "block").mapInArrow(measure, schema)


def _open(windows: DataFrame, rows: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``(dimension, block, query_id, vector, bound)``: blocks outside a query's window that may hold nearer rows.

    The stated queries meet the centres of blocks, some hundreds of the ones and some thousands of the others at a time.
    """
    bounds = _best(found, k).groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.max("score")).otherwise(float("inf")).alias("bound")
    )
    bounded = windows.join(bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    sets = max(1, math.ceil(windows.count() / QUERY_ROWS))
    fields = ["query_id", "vector", "bound", "first", "until"]
    asked = bounded.withColumn("set", F.pmod(F.xxhash64("query_id"), F.lit(sets))).groupBy("dimension", "set")
    asked = asked.agg(F.collect_list(F.struct(*fields)).alias("asked"))
    chunk = F.floor(F.col("block") / CENTRES).cast("int").alias("chunk")
    chunks = stored(
        _centres(rows).groupBy("dimension", chunk).agg(F.collect_list(F.struct("block", "centre", "radius")).alias("blocks")),
        "centres",
    )
    last = chunks.agg(F.max("chunk")).first()[0] or 0

    def sift(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for dimension, some, blocks in zip(*(batch.column(c) for c in ("dimension", "asked", "blocks"))):
                queries, centres = some.values.flatten(), blocks.values.flatten()
                ids, packed, bound, first, until = queries
                numbers, middles, radius = (c if n == 1 else c.to_numpy() for n, c in enumerate(centres))
                x = np.frombuffer(b"".join(packed.to_pylist())).reshape(len(ids), -1)
                y = np.frombuffer(b"".join(middles.to_pylist())).reshape(len(numbers), -1)
                norms = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)
                away = np.sqrt(np.maximum(norms * (1 - 1e-9) - 2 * x @ y.T, 0))
                limit = bound.to_numpy()[:, None] * (1 + 1e-9) + radius * (1 + 1e-9) + 1e-9
                new = (numbers < first.to_numpy()[:, None]) | (numbers > until.to_numpy()[:, None])
                q, b = np.nonzero(new & ~(away > limit))
                for begin in range(0, len(q), 8192):
                    of, at = pa.array(q[begin : begin + 8192]), b[begin : begin + 8192]
                    columns = [pa.array(np.full(len(at), dimension.as_py(), np.int32)), pa.array(numbers[at])]
                    columns += [ids.take(of), packed.take(of), bound.take(of)]
                    yield pa.RecordBatch.from_arrays(columns, ["dimension", "block", "query_id", "vector", "bound"])

    every = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(last))))
    pairs = every.join(chunks, ["dimension", "chunk"]).select("dimension", "asked", "blocks")
    return pairs.mapInArrow(sift, "dimension int, block int, query_id long, vector binary, bound double")
