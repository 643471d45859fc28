"""MinHash near-duplicates: bands propose pairs, odd sketches drop unlike ones, full shingle sets confirm the rest.

An odd sketch folds the MinHash samples of a document into a bitmap by parity: the XOR of two of them counts the samples
in which the documents differ, so one population count estimates a high similarity well.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import WordHashes, groups, stored, words_of
from textloom.llm.components import connected_components

SAMPLES = 160
BAND_ROWS = 5
SKETCH_WORDS = 8
MISSED = 1e-4
DEVIATIONS = 5.0
BLOCK = 512
ATTEMPTS = 2

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _MIX
        return x ^ (x >> _SHIFT)


def shingle_set(text: str | None, hashes: WordHashes, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words; of all words as one run if there are fewer."""
    words = hashes.of(words_of(text))
    if not len(words):
        return words
    size = min(size, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        total = _mixed(total + words[i : len(words) - size + 1 + i])
    return np.unique(total)


class MinHash:
    """Samples, band keys and sketches for sets of shingle hashes."""

    def __init__(self, bands: int, samples: int = SAMPLES, rows: int = BAND_ROWS):
        random = np.random.default_rng(6)
        self.bands, self.rows = bands, rows
        self.masks = random.integers(0, 1 << 63, samples, np.uint64)
        self.factors = random.integers(0, 1 << 63, samples, np.uint64) * np.uint64(2) + np.uint64(1)

    def samples(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.masks), np.iinfo(np.uint64).max, np.uint64)
        with np.errstate(over="ignore"):
            for start in range(0, len(shingles), 1024):
                part = shingles[start : start + 1024, None]
                np.minimum(least, ((part ^ self.masks) * self.factors).min(axis=0), out=least)
        return least

    def keys(self, samples: np.ndarray) -> np.ndarray:
        """One key per row of samples and band."""
        parts = samples[:, : self.bands * self.rows].reshape(len(samples), self.bands, self.rows)
        keys = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64), parts.shape[:2])
        with np.errstate(over="ignore"):
            for i in range(self.rows):
                keys = _mixed(keys + parts[:, :, i])
        return keys.view(np.int64)

    def sketches(self, samples: np.ndarray) -> np.ndarray:
        """Parity bitmaps as ``SKETCH_WORDS`` longs per row."""
        n, k = samples.shape
        with np.errstate(over="ignore"):
            places = _mixed(samples + np.arange(k, dtype=np.uint64) * _MIX) % np.uint64(64 * SKETCH_WORDS)
        cells = places.astype(np.int64) + np.arange(n)[:, None] * (64 * SKETCH_WORDS)
        odd = (np.bincount(cells.ravel(), minlength=n * 64 * SKETCH_WORDS) & 1).astype(np.uint8)
        return np.packbits(odd.reshape(n, -1), axis=1).view(np.int64)


def bands_for(threshold: int) -> int:
    """Bands of ``BAND_ROWS`` samples so that a pair at the threshold (in percent) is missed once in ``1 / MISSED``.

    A threshold for which the samples do not make so many bands is refused.
    """
    alike = min(0.999, max(threshold, 1) / 100) ** BAND_ROWS
    bands = math.ceil(math.log(MISSED) / math.log(1 - alike))
    if bands > SAMPLES // BAND_ROWS:
        raise ValueError(f"{SAMPLES} samples do not find pairs at {threshold}%: 76 or more")
    return bands


def most_differing_bits(threshold: int) -> int:
    """Differing sketch bits that a pair at the threshold goes beyond by ``DEVIATIONS`` standard deviations at most."""
    least = threshold / 100
    least -= DEVIATIONS * math.sqrt(least * (1 - least) / SAMPLES)
    bits = 64 * SKETCH_WORDS
    return math.ceil(bits / 2 * (1 - math.exp(-2 * 2 * SAMPLES * (1 - least) / bits)))


def signatures(docs: DataFrame, threshold: int) -> DataFrame:
    """``(doc_id, n_shingles, digest, keys, s0..)``: size and digest of the set, band keys, odd sketch."""
    bands = bands_for(threshold)

    def sign(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, minhash = WordHashes(), MinHash(bands)
        for batch in frames:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                sizes = np.zeros(part.num_rows, np.int64)
                digests = []
                samples = np.zeros((part.num_rows, len(minhash.masks)), np.uint64)
                for i, text in enumerate(part.column("text")):
                    shingles = shingle_set(text.as_py(), hashes)
                    sizes[i] = len(shingles)
                    digests.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                    if len(shingles):
                        samples[i] = minhash.samples(shingles)
                sketches = minhash.sketches(samples)
                ends = np.cumsum(np.where(sizes > 0, bands, 0))
                keys = minhash.keys(samples)[sizes > 0].ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(keys))
                columns = [part.column("doc_id"), pa.array(sizes), pa.array(digests, pa.binary()), lists]
                columns += [pa.array(np.ascontiguousarray(sketches[:, i])) for i in range(SKETCH_WORDS)]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_shingles", "digest", "keys", *_sketch()]
    schema = "doc_id long, n_shingles long, digest binary, keys array<long>, "
    schema += ", ".join(f"{s} long" for s in _sketch())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, schema)


def _sketch(prefix: str = "s") -> list[str]:
    return [f"{prefix}{i}" for i in range(SKETCH_WORDS)]


def _alike(one: str, other: str, threshold: int) -> Column:
    """Whether sizes allow the threshold and the sketches do not speak against it."""
    bits = sum(
        (F.bit_count(F.col(f"{one}{s}").bitwiseXOR(F.col(f"{other}{s}"))) for s in _sketch()), start=F.lit(0)
    )
    a, b = F.col(f"{one}n_shingles"), F.col(f"{other}n_shingles")
    return (F.least(a, b) * 100 >= F.greatest(a, b) * threshold) & (bits <= most_differing_bits(threshold))


def _with_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(doc_id, shingles)`` of the wanted ids: the full set as packed 64-bit hashes in ascending order."""

    def sets(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in frames:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                packed = [shingle_set(t.as_py(), hashes).tobytes() for t in part.column("text")]
                digests = pa.array([xxhash.xxh3_128_digest(p) for p in packed], pa.binary())
                columns = [part.column("doc_id"), part.column("digest"), digests, pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "own", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id")
    # repeated rows go without another exchange, as the join has dealt the rows out by doc_id
    texts = texts.select("doc_id", "digest", "text").distinct()
    found = texts.mapInArrow(sets, "doc_id long, digest binary, own binary, shingles binary")
    # a repeated id may stand for several texts; the representative's is the one with its digest
    return found.where("own = digest").select("doc_id", "digest", "shingles")


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Of pairs ``(x, y)`` of digests those with 100 * intersection >= threshold * union of the full sets."""

    def compare(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            kept = []
            for x, y in zip(batch.column("left"), batch.column("right")):
                a, b = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = np.concatenate([a, b])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                kept.append(100 * common >= threshold * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(kept))

    left = sets.select(F.col("digest").alias("x"), F.col("doc_id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("digest").alias("y"), F.col("doc_id").alias("b"), F.col("shingles").alias("right"))
    both = pairs.join(right, "y").join(left, "x").select("a", "b", "left", "right")
    return both.mapInArrow(compare, "a long, b long")


def _members(representatives: DataFrame) -> DataFrame:
    """One row per set and band, for band keys that at least two sets share, with the key's first member and count."""
    exploded = representatives.select(F.explode("keys").alias("key"), "doc_id", "digest", "n_shingles", *_sketch())
    shared = exploded.groupBy("key").agg(F.count(F.lit(1)).alias("n_members"), F.min("digest").alias("first"))
    return exploded.join(shared.where("n_members > 1"), "key")


def _star_pairs(members: DataFrame, threshold: int) -> DataFrame:
    """Pairs of each member with its key's first member."""
    firsts = members.where("digest = first").alias("f")
    others = members.where("digest <> first").alias("m")
    both = others.join(firsts, F.col("m.key") == F.col("f.key")).where(_alike("m.", "f.", threshold))
    return both.select(F.col("m.digest").alias("x"), F.col("f.digest").alias("y")).distinct()


def _with_outsiders(members: DataFrame, components: DataFrame, attempt: int = 0) -> DataFrame:
    """Members of keys that hold several components: ``out`` if not of the key's largest one, which names a delegate.

    The delegate is a member of the largest component that the hash of digest, key and attempt picks; ``n_main`` and
    ``n_out`` count both kinds.
    """
    rows = members.where("n_members > 2").join(
        components.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left"
    )
    rows = rows.select(
        "key", "digest", "doc_id", "n_shingles", *_sketch(), F.coalesce("component", "doc_id").alias("component")
    )
    delegate = F.min_by(
        F.struct("digest", "n_shingles", *_sketch()), F.xxhash64("digest", "key", F.lit(attempt))
    ).alias("delegate")
    per_component = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), delegate)
    largest = F.struct("n", "component")
    per_key = per_component.groupBy("key").agg(
        F.max_by("component", largest).alias("main"),
        F.max_by("delegate", largest).alias("delegate"),
        F.max("n").alias("n_main"),
        (F.sum("n") - F.max("n")).alias("n_out"),
    )
    joined = rows.join(per_key.where("n_out > 0"), "key")
    return joined.withColumn("out", F.col("component") != F.col("main"))


def _delegate_pairs(members: DataFrame, components: DataFrame, attempt: int, threshold: int) -> DataFrame:
    """Pairs of each outsider with its key's delegate; a document in many keys meets as many delegates."""
    out = _with_outsiders(members, components, attempt).where("out")
    pairs = out.where(_alike("", "delegate.", threshold))
    return pairs.select(F.col("digest").alias("x"), F.col("delegate.digest").alias("y")).distinct()


def _rest(members: DataFrame, components: DataFrame, threshold: int) -> DataFrame:
    """Members, by task, that may be linked to others with which they share a key but not yet a component.

    A key's members outside its largest component are compared with each other and with that component's, cut into
    blocks of ``BLOCK``, so work grows with members times outsiders, and no task holds more than two blocks.
    """
    names = ["digest", "doc_id", "n_shingles", *_sketch()]
    blocks = lambda n: F.ceil(F.col(n) / F.lit(float(BLOCK))).cast("int")
    rows = _with_outsiders(members, components).withColumns({"km": blocks("n_main"), "ko": blocks("n_out")})
    block = F.pmod(F.xxhash64("digest"), F.when(F.col("out"), F.col("ko")).otherwise(F.col("km"))).cast("int")
    rows = rows.withColumn("block", block)
    # tasks (i, j): outsiders' block i against outsiders' block j >= i, or, numbered -1 - j, against main block j
    among = F.transform(
        F.sequence(F.lit(0), F.col("ko") - 1),
        lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")),
    )
    against = F.transform(
        F.sequence(F.lit(0), F.col("km") - 1), lambda j: F.struct(F.col("block").alias("i"), (-1 - j).alias("j"))
    )
    of_main = F.transform(
        F.sequence(F.lit(0), F.col("ko") - 1), lambda i: F.struct(i.alias("i"), (-1 - F.col("block")).alias("j"))
    )
    tasks = F.when(F.col("out"), F.concat(among, against)).otherwise(of_main)
    dealt = rows.select(F.explode(tasks).alias("task"), "key", "component", "out", "block", *names)
    dealt = dealt.select("key", F.col("task.i").alias("i"), F.col("task.j").alias("j"), "component", "out", "block", *names)
    ordered = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "out", "block", "digest")
    return ordered.mapInArrow(_with_candidates(threshold), _CANDIDATES)


_CANDIDATES = "key long, i int, j int, digest binary, doc_id long, component long, side int"


def _with_candidates(threshold: int):
    """Of each task the rows that sizes and sketches leave a partner, on side 1, 2 or, within one block, 3."""
    limit = most_differing_bits(threshold)
    names = [c.split()[0] for c in _CANDIDATES.split(", ")]

    def within(group: pa.Table) -> pa.Table:
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        block = group.column("block").to_numpy()
        out = group.column("out").to_numpy(zero_copy_only=False)
        one = np.flatnonzero(out & (block == i))
        other = one if i == j else np.flatnonzero(out & (block == j)) if j >= 0 else np.flatnonzero(~out)
        sketch = np.stack([group.column(s).to_numpy() for s in _sketch()], axis=1).view(np.uint64)
        sizes, component = group.column("n_shingles").to_numpy(), group.column("component").to_numpy()
        side = np.zeros(group.num_rows, np.int32)
        for row in one:
            bits = np.bitwise_count(sketch[other] ^ sketch[row]).sum(axis=1)
            small, large = np.minimum(sizes[other], sizes[row]), np.maximum(sizes[other], sizes[row])
            fits = other[(bits <= limit) & (component[other] != component[row]) & (100 * small >= threshold * large)]
            if len(fits):
                side[row] |= 1
                side[fits] |= 2
        kept = np.flatnonzero(side)
        return group.append_column("side", pa.array(side)).select(names).take(pa.array(kept))

    def compare(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(frames, ["key", "i", "j"]):
            yield from within(group).combine_chunks().to_batches()

    return compare


def common_counts(sets: list[np.ndarray], one: np.ndarray, other: np.ndarray, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of sets ``one`` with sets ``other``: products of their incidence matrices, in parts."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = uses > 1
    number = np.cumsum(shared) - 1
    owner, place = owner[shared[place]], number[place[shared[place]]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    total = np.zeros((len(one), len(other)), np.int64)
    for start in range(0, int(shared.sum()), width):
        begin, end = np.searchsorted(place, [start, start + width])
        has = np.zeros((len(sets), width), np.float32)
        has[owner[begin:end], place[begin:end] - start] = 1
        total += (has[one] @ has[other].T).astype(np.int64)
    return total


def _linked_in_tasks(candidates: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links ``(a, b)`` among the candidates of each task, confirmed on the full sets; a row per document, not per pair."""

    def within(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        one, other = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
        full = [np.frombuffer(s.as_buffer(), np.uint64) for s in group.column("shingles")]
        sizes = np.array([len(s) for s in full])
        common = common_counts(full, one, other)
        x, y = np.nonzero(100 * common >= threshold * (sizes[one][:, None] + sizes[other] - common))
        x, y = one[x], other[y]
        ids = group.column("doc_id").to_numpy()
        joins, before = ids.copy(), None
        while before is None or (joins != before).any():
            before = joins.copy()
            np.minimum.at(joins, x, before[y])
            np.minimum.at(joins, y, joins[x])
        rows = np.flatnonzero(joins != ids)
        return pa.table({"a": ids[rows], "b": joins[rows]})

    def confirm(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(frames, ["key", "i", "j"]):
            yield from within(group).combine_chunks().to_batches()

    rows = candidates.join(sets.select("digest", "shingles"), "digest")
    dealt = rows.select("key", "i", "j", "doc_id", "side", "shingles")
    ordered = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "doc_id")
    return ordered.mapInArrow(confirm, "a long, b long")


def _as_links(components: DataFrame) -> DataFrame:
    return components.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b")


def near_duplicates(docs: DataFrame, threshold: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row: groups of documents linked by similar five-word shingles.

    Two documents are linked if 100 * intersection >= ``threshold`` * union of their whole sets; groups are what links
    reach. ``kept`` marks each group's smallest id. Equal sets are one class from the start; only class representatives
    are compared. Band keys propose pairs. Each member of a key is first tried against the key's first member, and what
    stays outside the key's largest component against ``ATTEMPTS`` delegates of that, so that a group of any size joins
    up in linear work. Pairs that are not connected by then follow in full, in blocks: a task returns what its members
    are joined to, never a row per pair.

    Null, empty and blank texts have no shingles and link with nothing. Fewer words than five make one shingle. Rows
    with the same id are one document for grouping, and each comes back; rows without an id form no groups: their
    ``component_id`` is null and they are kept. A table without rows gives none. Other columns of ``docs`` are ignored.
    """
    signed = stored(signatures(docs, threshold), "signatures")
    sets = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    least = F.min("doc_id").alias("doc_id")
    size = [F.first(c).alias(c) for c in ("n_shingles", *_sketch())]
    classes = stored(sets.groupBy("digest").agg(least, F.first("keys").alias("keys"), *size), "classes")
    same = sets.select(F.col("doc_id").alias("a"), "digest").join(
        classes.select("digest", F.col("doc_id").alias("b")), "digest"
    )
    copies = same.where("a <> b").select("a", "b")
    members = stored(_members(classes), "members")
    wanted = members.select("digest", "doc_id").distinct()
    full = stored(_with_sets(docs, wanted), "sets")
    joined = connected_components(_confirmed(_star_pairs(members, threshold), full, threshold))
    for attempt in range(ATTEMPTS):
        more = _confirmed(_delegate_pairs(members, joined, attempt, threshold), full, threshold)
        joined = connected_components(_as_links(joined).unionByName(more))
    candidates = stored(_rest(members, joined, threshold), "candidates")
    rest = _linked_in_tasks(candidates, full, threshold)
    linked = connected_components(copies.unionByName(_as_links(joined)).unionByName(rest))
    own = signed.select("doc_id", "n_shingles").join(
        linked.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left"
    )
    component = F.coalesce("component", "doc_id")
    return own.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
