"""Repeated passages by a compacted graph of the windows of all documents.

The words of a window are an edge of the de Bruijn graph: it leads from its first to its last words but one. Edges are
never shuffled one by one. Neighbouring windows that have the same least-hashed short word run (the anchor) make up
a stretch (periodic text is one, whatever its length), whose borders follow from its words alone; equal windows have equal anchors, and repeated passages are
made of equal stretches but for their ends. So:

* Anchors that occur in one document only end the matter for all their windows.
* Stretches that occur in several documents compact: where every occurrence of one is followed by the same other one,
  which follows nothing else, the two are one path (a join of each stretch's only successor with its only predecessor).
* A path's words are read again at its coordinates, and their digests have to agree: only then does the document with
  the smallest id keep it, and the others lose it.
* Windows of an anchor with different stretches may agree all the same (the ends of passages). Those in the first document
  of each different stretch are compared one by one, by their digests.

Each link is a grouping by hash or digest that combines before its shuffle, so a passage in a third of all documents is
no hot group; joins on its anchor are split by the skew join.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import WordHashes, stored, word_chunks

WINDOW = 50
ANCHOR = 20
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64, for i below n."""
    factors = np.full(n, base, np.uint64)
    if n:
        factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


def mixed(values: np.ndarray) -> np.ndarray:
    """Each bit of the result depends on all bits of the value."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return values ^ (values >> np.uint64(33))


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each ``width`` neighbouring values is, the first of equal ones; widths are doubled to get there."""
    at, done = np.arange(len(values)), 1
    while done < width:
        step = min(done, width - done)
        left, right = at[:-step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        done += step
    return at


def stretches(hashes: np.ndarray, ends: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """``(row, start, windows, anchor hash, stretch hash)`` of the stretches of neighbouring windows of one anchor.

    ``hashes`` are the word hashes of documents that end at ``ends``. A stretch of r windows has r + window - 1 words.
    """
    n = len(hashes)
    if n < window:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(_INVERSE, n), dtype=np.uint64)])
    powers = _powers(_ODD, n + 1)
    of_run = lambda start, end: mixed((before[end] - before[start]) * powers[start])
    places = np.arange(n - anchor + 1)
    short = of_run(places, places + anchor)
    anchors = leftmost_least(short, window - anchor + 1)
    last = np.repeat(ends, np.diff(ends, prepend=0))  # where the document of each word ends
    starts = np.arange(len(anchors))
    starts = starts[starts + window <= last[: len(anchors)]]
    new = np.ones(len(starts), bool)
    of_window = short[anchors]
    new[1:] = (of_window[starts[1:]] != of_window[starts[:-1]]) | (np.diff(starts) != 1)
    first = np.flatnonzero(new)
    count = np.diff(first, append=len(starts))
    begin = starts[first]
    row = np.searchsorted(ends, begin, "right")
    whole = of_run(begin, begin + count + window - 1)
    begin_of_row = ends[row] - np.diff(ends, prepend=0)[row]
    return row, begin - begin_of_row, count, of_window[begin].view(np.int64), whole.view(np.int64)


def _stretches(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """One row per document row, with the lists of its stretches: narrow, and read more than once."""

    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for rows, words, ends in word_chunks(frames):
            row, *columns = stretches(hashes.of(words), ends, window, anchor)
            offsets = np.searchsorted(row, np.arange(len(ends) + 1)).astype(np.int32)
            types = (np.int32, np.int32, np.int64, np.int64)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(c.astype(t))) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([*rows.columns[:2], *lists], ["doc", "version", "start", "n", "anchor", "hash"])

    kind = docs.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, version long, start array<int>, n array<int>, anchor array<long>, hash array<long>"
    return docs.select("doc", "version", "text").mapInArrow(cut, schema)


def may_match(rows: DataFrame, keys: DataFrame, by: list[str], wanted: bool = True) -> DataFrame:
    """Rows whose columns ``by`` may be among ``keys``, or with ``wanted`` false those that cannot be.

    A bitmap of 2^26 hashes is sent to all tasks: 2^20 numbers at most, however many keys. The more keys, the more rows it
    lets through for nothing, so it only saves shuffling.
    """
    slot = F.pmod(F.xxhash64(*by), F.lit(1 << 26))
    word, bit = F.shiftright(slot, 6).alias("__word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({', '.join(by)}), 64L) as int))")
    bitmap = keys.select(word, bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    marked = rows.select("*", word, bit.alias("__bit")).join(F.broadcast(bitmap), "__word", "left")
    hit = F.coalesce(F.col("__bits").bitwiseAND(F.col("__bit")) != 0, F.lit(False))
    return marked.where(hit if wanted else ~hit).select(*rows.columns)


def _shared(found: DataFrame) -> DataFrame:
    """Stretches whose anchor is in several documents, with those that follow and precede them in their document."""
    each = found.select("doc", "version", F.explode(F.arrays_zip("start", "n", "anchor", "hash")).alias("s"))
    each = each.select("doc", "version", "s.*")
    several = each.groupBy("anchor").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("anchor")
    # joins with stored tables are those whose hot keys the skew join can split
    several = stored(several, "anchors")
    kept = each.join(several, "anchor").repartition("doc", "version").dropDuplicates(["doc", "version", "start"])
    of_doc = Window.partitionBy("doc", "version").orderBy("start")
    follows = F.lead("start").over(of_doc) == F.col("start") + F.col("n")
    preceded = F.lag("start").over(of_doc) + F.lag("n").over(of_doc) == F.col("start")
    following = F.when(follows, F.lead("hash").over(of_doc)).alias("next")
    return kept.select("*", following, F.when(preceded, F.lag("hash").over(of_doc)).alias("previous"))


def _different(shared: DataFrame) -> DataFrame:
    """Each different stretch: its first document, whether others have it, and its only successor and predecessor.

    The only successor of a stretch is one that follows each of its occurrences.
    """
    only = lambda c: F.when((F.min(c) == F.max(c)) & (F.count(c) == F.count(F.lit(1))), F.min(c)).alias(c)
    each = shared.groupBy("anchor", "hash")
    each = each.agg(F.min("doc").alias("first"), F.max("doc").alias("last"), only("next"), only("previous"))
    return each.select("anchor", "hash", "first", (F.col("first") < F.col("last")).alias("repeated"), "next", "previous")


def _spots(shared: DataFrame, each: DataFrame) -> DataFrame:
    """``(doc, version, spots)``: what to read again in a document: paths as wholes, and windows one by one.

    A repeated stretch continues a path if its only predecessor has it as its only successor. This never makes a circle,
    as some occurrence comes last in its document. Where an anchor has several stretches, their windows are read in the
    first document of each.
    """
    repeated = each.where("repeated")
    links = repeated.select(F.col("hash").alias("previous"), F.col("next").alias("hash")).where("hash IS NOT NULL")
    inner = repeated.join(links.distinct(), ["hash", "previous"], "left_semi").select("anchor", "hash", F.lit(True).alias("inner"))
    several = each.groupBy("anchor").agg((F.count(F.lit(1)) > 1).alias("open")).where("open")
    facts = each.select("anchor", "hash", "first", "repeated").join(several, "anchor", "left")
    facts = stored(facts.where("repeated OR open").join(inner, ["anchor", "hash"], "left"), "facts")
    placed = shared.select("doc", "version", "start", "n", "anchor", "hash").join(facts, ["anchor", "hash"])
    placed = placed.select(
        "doc",
        "version",
        "start",
        "n",
        "repeated",
        (F.col("repeated") & F.col("inner").isNull()).cast("int").alias("head"),
        (F.col("open").isNotNull() & (F.col("doc") == F.col("first"))).alias("single"),
    ).where("repeated OR single")
    of_doc = Window.partitionBy("doc", "version").orderBy("start")
    placed = placed.withColumn("path", F.sum("head").over(of_doc))
    paths = placed.groupBy("doc", "version", F.when(F.col("repeated"), F.col("path")).alias("path"))
    spots = paths.agg(
        F.min("start").alias("start"),
        F.sum("n").cast("int").alias("n"),
        F.collect_list(F.when(F.col("single"), F.struct("start", "n"))).alias("singles"),
    )
    path = F.when(F.col("path").isNotNull(), F.array(F.struct("start", "n"))).otherwise(F.array())
    return spots.groupBy("doc", "version").agg(
        F.flatten(F.collect_list(path)).alias("paths"), F.flatten(F.collect_list("singles")).alias("singles")
    )


def _digests(docs: DataFrame, spots: DataFrame, window: int) -> DataFrame:
    """``(doc, version, found)``: digest, start and number of windows of each path and each single window."""

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words, ends in word_chunks(frames):
            begins = (ends - np.diff(ends, prepend=0)).tolist()
            offsets, starts, counts, digests = [0], [], [], bytearray()
            paths, singles = rows.column("paths").to_pylist(), rows.column("singles").to_pylist()
            for begin, paths_, singles_ in zip(begins, paths, singles):
                pieces = [(p["start"], p["n"]) for p in paths_]
                pieces += [(s["start"] + j, 1) for s in singles_ for j in range(s["n"])]
                for start, n in pieces:
                    own = words[begin + start : begin + start + n + window - 1]
                    digests += blake2b(b" ".join(own), digest_size=16).digest()
                    starts.append(start)
                    counts.append(n)
                offsets.append(len(starts))
            halves = np.frombuffer(bytes(digests), np.int64).reshape(-1, 2)
            columns = [halves[:, 0], halves[:, 1], np.array(starts, np.int32), np.array(counts, np.int32)]
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*rows.columns[:2], *lists], ["doc", "version", "h", "l", "start", "n"])

    kind = docs.schema["doc"].dataType.simpleString()
    joined = may_match(docs, spots, ["doc", "version"]).join(spots, ["doc", "version"])
    lists = "h array<long>, l array<long>, start array<int>, n array<int>"
    return joined.select("doc", "version", "text", "paths", "singles").mapInArrow(read, f"doc {kind}, version long, {lists}")


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``(doc, version, spans)``: start and number of neighbouring windows, each of which a smaller ``doc`` holds as well.

    ``docs`` has ``doc``, ``version`` (a hash that tells rows with the same id apart) and ``text``.
    """
    known = docs.where(F.col("doc").isNotNull()).select("doc", "version", "text")
    found = stored(_stretches(known, window, anchor), "windows")
    shared = stored(_shared(found), "shared")
    each = stored(_different(shared), "stretches")
    digests = stored(_digests(known, stored(_spots(shared, each), "spots"), window), "digests")
    digests = digests.select("doc", "version", F.explode(F.arrays_zip("h", "l", "start", "n")).alias("s")).select("doc", "version", "s.*")
    least = digests.groupBy("h", "l").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    lost = digests.join(stored(least.select("h", "l", "least"), "repeats"), ["h", "l"]).where("doc > least")
    return lost.groupBy("doc", "version").agg(F.collect_set(F.struct("start", "n")).alias("spans"))


def drop_repeats(docs: DataFrame, key: str = "doc_id", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``(key, n_words, n_removed, kept, kept_sha256)`` per row of ``docs``, whose column ``text`` is split at white space.

    A window is ``window`` words in a row in one document. A word goes if a window that covers it has the same words as
    a window of a document with a smaller key. Windows are judged as they come in, not on what is left. ``kept`` are the
    words that stay, joined by one space. ``anchor`` words, fewer than a window, are what windows are grouped by.

    A null text has no words. Rows without a key neither lose words nor make others lose any. Rows with equal keys take
    none from one another, but each loses what smaller keys hold. Texts of any length are read whole. No rows give none,
    and other columns are ignored.
    """
    if not 0 < anchor < window:
        raise ValueError("anchor must be shorter than window")
    rows = docs.select(F.col(key).alias("doc"), F.xxhash64("text").alias("version"), "text")
    spans = stored(repeated_spans(rows, window, anchor), "spans")
    by = ["doc", "version"]
    whole = may_match(rows, spans, by, wanted=False).withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    joined = may_match(rows, spans, by).join(spans, by, "left").unionByName(whole).select("doc", "text", "spans")

    def keep(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words, ends in word_chunks(frames):
            sizes = np.diff(ends, prepend=0)
            texts, lost = [], []
            for spans_, end, n in zip(batch.column("spans").to_pylist(), ends.tolist(), sizes.tolist()):
                own = words[end - n : end]
                if spans_:
                    change = np.zeros(n + 1, np.int64)
                    np.add.at(change, [s["start"] for s in spans_], 1)
                    np.add.at(change, [s["start"] + s["n"] + window - 1 for s in spans_], -1)
                    own = [own[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                texts.append(b" ".join(own))
                lost.append(n - len(own))
            columns = [batch.column("doc"), pa.array(sizes), pa.array(lost, pa.int64())]
            columns += [pa.array(texts, pa.binary()).cast(pa.string()), pa.array([sha256(t).hexdigest() for t in texts])]
            yield pa.RecordBatch.from_arrays(columns, [key, "n_words", "n_removed", "kept", "kept_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return joined.mapInArrow(keep, f"`{key}` {kind}, n_words long, n_removed long, kept string, kept_sha256 string")
