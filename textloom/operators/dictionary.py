"""Large vocabularies as dictionary files, which workers map into memory and search a batch of words at a time.

Spark sorts and packs the entries; Spark's file server brings the files to each machine once, where all workers share the
pages they touch. A word is found by the hash it is sorted by and then compared itself, so equal hashes do no harm.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words per range, which the driver takes one after another while it writes the files.
PART_WORDS = 1 << 18
# The files of a dictionary and their entries. Hashes rise, and ``place`` says where in the order of ids the
# word is; ids rise, and ``end`` says where in ``words`` the word's bytes end.
FILES = {"hash": np.dtype("<i8"), "place": np.dtype("<u4"), "id": np.dtype("<i4"), "end": np.dtype("<u8"), "words": np.dtype("u1")}


def _hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word; the same in every worker."""
    return pd.util.hash_array(np.array(words.to_pylist(), dtype=object), categorize=False).view(np.int64)


@dataclass
class Dictionary:
    """The open files of one dictionary, in a worker."""

    hash: np.ndarray
    place: np.ndarray
    id: np.ndarray
    end: np.ndarray
    words: np.ndarray

    @classmethod
    def open(cls, files: str) -> Dictionary:
        """``files`` is what the paths of all its files begin with."""

        def mapped(name: str) -> np.ndarray:
            path = f"{files}-{name}"
            return np.memmap(path, FILES[name], "r") if os.path.getsize(path) else np.zeros(0, FILES[name])

        return cls(**{name: mapped(name) for name in FILES})

    def _bytes(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the words at some places, one after another, and where each ends."""
        ends = self.end[places].astype(np.int64)
        starts = np.where(places > 0, self.end[places - 1], 0).astype(np.int64)
        sizes = ends - starts
        upto = np.cumsum(sizes)
        index = np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts - (upto - sizes), sizes)
        return self.words[index], upto

    def words_at(self, places: np.ndarray) -> pa.Array:
        flat, ends = self._bytes(places)
        offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64))
        return pa.Array.from_buffers(pa.large_string(), len(places), [None, offsets, pa.py_buffer(flat.tobytes())])

    def ids_of(self, words: pa.Array, missing: int) -> np.ndarray:
        """Ids of distinct words, none null. Words with equal hashes are tried one after another."""
        out = np.full(len(words), missing, np.int32)
        if not len(self.hash) or not len(words):
            return out
        hashes = _hashes(words)
        at = np.searchsorted(self.hash, hashes)
        open_ = np.flatnonzero(at < len(self.hash))
        words = words.cast(pa.large_string())
        while len(open_):
            open_ = open_[self.hash[at[open_]] == hashes[open_]]
            places = self.place[at[open_]].astype(np.int64)
            same = pc.equal(self.words_at(places), words.take(pa.array(open_))).to_numpy(zero_copy_only=False)
            out[open_[same]] = self.id[places[same]]
            open_ = open_[~same]
            at[open_] += 1
            open_ = open_[at[open_] < len(self.hash)]
        return out

    def words_of(self, ids: np.ndarray) -> pa.Array:
        """Words of distinct ids; null for those that are not there."""
        if not len(self.id):
            return pa.nulls(len(ids), pa.large_string())
        at = np.searchsorted(self.id, ids)
        known = at < len(self.id)
        known[known] = self.id[at[known]] == ids[known]
        found = self.words_at(at[known].astype(np.int64))
        places = np.full(len(ids), -1, np.int64)
        places[known] = np.arange(known.sum())
        return found.take(pa.array(places, mask=~known))


_open: dict[str, Dictionary] = {}


def _in_order(entries: DataFrame, by: str, parts: int) -> DataFrame:
    """Entries in ranges, the ranges and the entries in them in order; few entries are one range."""
    dealt = entries.repartitionByRange(parts, by) if parts > 1 else entries.coalesce(1)
    return dealt.sortWithinPartitions(by)


def _packed(vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries by hash, and by id, thousands of them to a row, in order."""

    def with_hash(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            yield pa.RecordBatch.from_arrays([frame.column("id"), pa.array(_hashes(frame.column("token")))], ["id", "hash"])

    def pack_hashes(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            blobs = [frame.column("hash").to_numpy().tobytes(), frame.column("id").to_numpy().astype("<i4").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in blobs], ["hash", "id"])

    def pack_words(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts = [t.as_py() for t in frame.column("token").cast(pa.binary())]
            sizes = np.array([len(t) for t in texts], "<u8")
            blobs = [frame.column("id").to_numpy().astype("<i4").tobytes(), sizes.tobytes(), b"".join(texts)]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in blobs], ["id", "size", "words"])

    entries = vocabulary.select(F.col("id").cast("int").alias("id"), F.col("token").cast("string").alias("token"))
    parts = entries.count() // PART_WORDS + 1
    by_hash = _in_order(entries.mapInArrow(with_hash, "id int, hash long"), "hash", parts)
    by_id = _in_order(entries, "id", parts)
    return by_hash.mapInArrow(pack_hashes, "hash binary, id binary"), by_id.mapInArrow(pack_words, "id binary, size binary, words binary")


def ship_dictionary(vocabulary: DataFrame) -> str:
    """Make dictionary files of a vocabulary ``(token, id)`` and give them to Spark to bring to all machines.

    Tokens and ids are unique. The driver writes the files part by part, some megabytes at a time; they take about 30
    bytes a word on the disk of every machine, and workers hold no table in memory. They are added one by one, as Spark
    takes whole folders in local mode only.
    """
    by_hash, by_id = _packed(vocabulary)
    name = f"dictionary-{uuid.uuid4().hex}"
    files = os.path.join(tempfile.mkdtemp(prefix="textloom-"), name)
    with open(f"{files}-id", "wb") as ids, open(f"{files}-end", "wb") as ends, open(f"{files}-words", "wb") as words:
        at = 0
        for row in by_id.toLocalIterator():
            upto = np.cumsum(np.frombuffer(row["size"], "<u8")) + np.uint64(at)
            at += len(row.words)
            ids.write(row.id)
            ends.write(upto.astype("<u8").tobytes())
            words.write(row.words)
    known = np.memmap(f"{files}-id", "<i4", "r") if os.path.getsize(f"{files}-id") else np.zeros(0, "<i4")
    with open(f"{files}-hash", "wb") as hashes, open(f"{files}-place", "wb") as places:
        for row in by_hash.toLocalIterator():
            hashes.write(row.hash)
            places.write(np.searchsorted(known, np.frombuffer(row.id, "<i4")).astype("<u4").tobytes())
    for file in FILES:
        vocabulary.sparkSession.sparkContext.addFile(f"{files}-{file}")
    return name


def opened(name: str) -> Dictionary:
    """The dictionary of that name, in a worker; the latest one stays open."""
    if name not in _open:
        _open.clear()
        _open[name] = Dictionary.open(SparkFiles.get(name))
    return _open[name]
