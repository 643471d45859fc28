"""Words, vectors, stored tables and samples of labelled rows, shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.session import new_dir
from textloom.sources import materialise

# The white space between words, for Spark's and SQL's patterns.
WORD = r"[^\x20\x09-\x0D]+"
FOLDS = 5


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs without ASCII white space, which is where ``bytes.split`` cuts; null has none."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def word_chunks(frames: Iterator[pa.RecordBatch], least: int = 200_000) -> Iterator[tuple[pa.RecordBatch, list[bytes], np.ndarray]]:
    """Rows until they hold ``least`` words, with the words of their column ``text`` one after another, unchanged, and
    the number of words up to the end of each row. A row's words stay together; a null text has none."""
    for frame in frames:
        texts = frame.column("text").cast(pa.binary())
        first, words, ends = 0, [], []
        for i, text in enumerate(texts):
            words += (text.as_py() or b"").split()
            ends.append(len(words))
            if len(words) >= least or i + 1 == len(texts):
                yield frame.slice(first, i + 1 - first), words, np.array(ends, np.int64)
                first, words, ends = i + 1, [], []


class WordHashes(dict):
    """64-bit hash of each word, worked out once per distinct word and forgotten when the table gets big."""

    def __init__(self, normal: Callable[[bytes], bytes] = bytes, most: int = 200_000):
        super().__init__()
        self.normal, self.most = normal, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(self.normal(word))
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and go on from there: lineage ends, and a lost executor costs no earlier work."""
    return materialise(df, new_dir(df.sparkSession, purpose))


def held_out(key: str) -> Column:
    """Rows that no model learns from: remainder 0 of the CRC-32 of the key as text; false without a key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, bound: int, seed: int) -> DataFrame:
    """About ``bound`` labelled documents to learn from, ``(doc_id, text, label)``, or all if there are fewer.

    A document is taken by the hash of its id, so each labelled document is as likely as any other and reruns agree.
    Held-out ids, and rows without id or label, are left out; several labels for one id count as the largest. One id
    counts once, however many rows it has, so the sample stays within its bound, which makes it safe to broadcast.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    share = min(1.0, bound / max(1, known.count()))
    fine = 1 << 30
    chosen = known.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(fine)) < int(share * fine))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label"))


def groups(frames: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows that agree in ``keys``, which the frames are sorted by; a run may span frames."""
    held: pa.Table | None = None
    for batch in frames:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        numbers = [pc.dictionary_encode(held.column(k)).combine_chunks().indices.to_numpy() for k in keys]
        changes = np.zeros(max(0, held.num_rows - 1), bool)
        for n in numbers:
            changes |= n[1:] != n[:-1]
        start = 0
        for end in np.flatnonzero(changes) + 1:
            yield held.slice(start, end - start)
            start = end
        held = held.slice(start)
    if held is not None and held.num_rows:
        yield held


def vectors_of(column: pa.Array) -> list[np.ndarray | None]:
    """Arrays of a list column; None for null, empty, zero, or with null or non-finite components."""
    kind = np.float32 if pa.types.is_float32(column.type.value_type) else np.float64
    found: list[np.ndarray | None] = []
    for item in column:
        values = item.values
        if values is None or len(values) == 0 or values.null_count:
            found.append(None)
            continue
        vector = values.to_numpy(zero_copy_only=False).astype(kind)
        found.append(vector if np.isfinite(vector).all() and vector.any() else None)
    return found


def unit(vectors: np.ndarray) -> np.ndarray:
    """Directions in double precision; scaled first, so that squares neither vanish nor overflow."""
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(axis=-1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(axis=-1, keepdims=True))
