"""Packing documents into token windows by dynamic programming that keeps their order.

The tokens of a partition's documents form one stream. It may be cut at the end of each document, and at one place in
every 16 tokens: the end of a sentence, else the last token. A path of cuts costs the padding of its windows plus a penalty per
cut inside a document; the cheapest predecessor of a place comes from a monotone queue over the last window.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

WINDOW = 2048
END = 1
BUFFER = 128 * WINDOW
CELL = 16
SENTENCE_CUT, WORD_CUT, SHORT_SEQUENCE = 4, 24, 8
# The pieces of a byte-level vocabulary, and the text of its only special token.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"
# White space as patterns have it. Runs of so many letters are cut out before the pattern sees them.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG = 10_000
LONG_BLANKS = re.compile(f"[{WHITE}]{{{LONG},}}")

_loaded: dict[str, tuple[tiktoken.Encoding, np.ndarray]] = {}


def _byte_of() -> dict[str, int]:
    """Byte of each letter in a byte-level vocabulary: printable Latin-1 stands for itself, the rest follow from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def load(path: str | None) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The vocabulary file's encoding, and which ids end a sentence; loaded once per worker, the latest kept.

    ids are ranks in such a file, so a faster encoder of the same algorithm gives the same ids.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _loaded:
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        letters = _byte_of()
        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if t != SPECIAL}
        special = {SPECIAL: vocabulary.get(SPECIAL, len(ranks))}
        ends = np.zeros(max(vocabulary.values()) + 2, bool)
        ends[[i for t, i in ranks.items() if b"\n" in t or t.rstrip().endswith((b".", b"!", b"?"))]] = True
        _loaded.clear()
        encoding = tiktoken.Encoding("packing", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=special)
        _loaded[path] = encoding, ends
    return _loaded[path]


def _with_long_blanks(text: str, encoding: tiktoken.Encoding) -> list[int]:
    """Ids of a text with long runs of white space, which the pattern would look through too deeply.

    The pattern makes one piece of a run, without its last letter if something follows; so the text may be cut there.
    """
    ids, at = [], 0
    for run in LONG_BLANKS.finditer(text):
        end = run.end() - (run.end() < len(text))
        ids += encoding.encode_ordinary(text[at : run.start()])
        ids += encoding._encode_single_piece(text[run.start() : end])
        at = end
    return ids + encoding.encode_ordinary(text[at:])


def token_ids(text: str | None, encoding: tiktoken.Encoding) -> np.ndarray:
    """Ids of a whole text and then the end id; a null text has the end id only."""
    if not text:
        ids = []
    elif len(text) >= LONG and LONG_BLANKS.search(text):
        special = encoding.encode(SPECIAL, allowed_special={SPECIAL})
        parts = [_with_long_blanks(part, encoding) for part in text.split(SPECIAL)]
        ids = parts[0] + [i for part in parts[1:] for i in special + part]
    elif SPECIAL in text:
        ids = encoding.encode(text, allowed_special={SPECIAL}, disallowed_special=())
    else:
        ids = encoding.encode_ordinary(text)
    return np.array([*ids, END], np.uint32)


def cut_places(sentence_ends: np.ndarray, doc_ends: np.ndarray, cell: int = CELL) -> tuple[np.ndarray, np.ndarray]:
    """Places where the stream may be cut, with their penalties: all ends of documents, and the cheapest and then last
    place of each cell."""
    n = len(sentence_ends)
    cost = np.full(n, WORD_CUT)
    cost[sentence_ends] = SENTENCE_CUT
    cost[doc_ends - 1] = 0
    if n % cell:
        cost = np.concatenate([cost, np.full(cell - n % cell, WORD_CUT + 1)])
    cells = cost.reshape(-1, cell)
    best = cell - 1 - cells[:, ::-1].argmin(axis=1)
    places = np.union1d(np.arange(len(cells)) * cell + best + 1, doc_ends)
    return places, cost[places - 1]


def tail_cost(length: int, window: int) -> int:
    """What the last sequences cost: padding, or the powers of two that make up the length."""
    return min(window - length, SHORT_SEQUENCE * length.bit_count())


def best_cuts(places: np.ndarray, penalties: np.ndarray, end: int, window: int, last: bool) -> list[int]:
    """Ends of the cheapest sequences of at most ``window`` tokens from 0 to the end.

    Without ``last`` the stream goes on, and the path ends at the cheapest place in its final window.
    """
    at = [0, *places.tolist()]
    extra = [0, *penalties.tolist()]
    cost = [0] * len(at)
    came = [0] * len(at)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (cost + place, index), costs rising from the front
    for i in range(1, len(at)):
        here = at[i]
        while at[queue[0][1]] < here - window:
            queue.popleft()
        value, came[i] = queue[0]
        cost[i] = value + window - here + extra[i]
        value = cost[i] + here
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, i))
    near = [i for i in range(len(at)) if at[i] >= end - window and (last or i)]
    if not last:
        i = min(near, key=lambda i: (cost[i], -i))
        cuts = []
    else:
        i = min(near, key=lambda i: (cost[i] + tail_cost(end - at[i], window), -i))
        rest = end - at[i]
        cuts = [end]
        if rest and SHORT_SEQUENCE * rest.bit_count() < window - rest:
            while rest & (rest - 1):
                low = rest & -rest
                cuts.append(cuts[-1] - low)
                rest -= low
        if at[i] == end:
            cuts = []
    while i:
        cuts.append(at[i])
        i = came[i]
    return cuts[::-1]


class Stream:
    """Documents of one partition, in order, cut into sequences as they come."""

    def __init__(self, first_id: int, window: int = WINDOW, buffer: int = BUFFER, ends: np.ndarray | None = None):
        self.next_id, self.window, self.buffer, self.ends = first_id, window, buffer, ends
        self.docs: list[tuple[object, np.ndarray, int]] = []  # key, ids that are left, how many went before
        self.held = 0

    def add(self, key: object, ids: np.ndarray) -> Iterator[list[tuple]]:
        self.docs.append((key, ids, 0))
        self.held += len(ids)
        if self.held >= self.buffer:
            yield self._cut(last=False)

    def close(self) -> Iterator[list[tuple]]:
        if self.held:
            yield self._cut(last=True)

    def _cut(self, last: bool) -> list[tuple]:
        """Pieces ``(key, start, length, ids, doc_tokens, sequence_id, offset)`` up to the last cut; keeps what is left."""
        ids = np.concatenate([d[1] for d in self.docs])
        doc_ends = np.cumsum([len(d[1]) for d in self.docs])
        places, penalties = cut_places(self.ends[ids], doc_ends)
        places, penalties = places[places <= len(ids)], penalties[places <= len(ids)]
        cuts = np.array(best_cuts(places, penalties, len(ids), self.window, last))
        done = int(cuts[-1])
        borders = np.union1d(np.append(cuts, 0), doc_ends[doc_ends < done])
        doc_starts = doc_ends - [len(d[1]) for d in self.docs]
        of_doc = np.searchsorted(doc_ends, borders[:-1], "right")
        of_sequence = np.searchsorted(cuts, borders[:-1], "right")
        starts = np.append(0, cuts)
        pieces = []
        for begin, end, d, s in zip(borders[:-1].tolist(), borders[1:].tolist(), of_doc.tolist(), of_sequence.tolist()):
            key, own, before = self.docs[d]
            start = begin - int(doc_starts[d]) + before
            packed = ids[begin:end].astype("<u4").tobytes()
            pieces.append((key, start, end - begin, packed, before + len(own), self.next_id + s, begin - int(starts[s])))
        self.next_id += len(cuts)
        keep = int(np.searchsorted(doc_ends, done, "right"))
        left = self.docs[keep:]
        if left and done > doc_starts[keep]:
            key, own, before = left[0]
            gone = done - int(doc_starts[keep])
            left[0] = key, own[gone:], before + gone
        self.docs, self.held = left, len(ids) - done
        return pieces


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)`` of sequences of up to ``window`` tokens.

    ``ids`` are unsigned 32-bit little-endian token ids. A document's tokens are its whole text's and the end id; each
    lies in one piece. Documents keep the order they have in their partition, so nothing is shuffled; sequences never
    span partitions, and a partition's last tokens go into sequences of powers of two where that pads less. Sequence
    ids start at the partition's number times 2^40.

    A null or empty text has the end id alone. Rows with equal or null ids are documents of their own; a table without
    rows gives none. Columns other than ``doc_id`` and ``text`` are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, ends = load(tokenizer)
        stream = Stream(TaskContext.get().partitionId() << 40, window, ends=ends)
        out = None

        def batch(pieces: list[tuple]) -> pa.RecordBatch:
            types = [out, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*pieces), types)], columns)

        for frame in frames:
            out = frame.schema.field("doc_id").type
            for key, text in zip(frame.column("doc_id").to_pylist(), frame.column("text")):
                yield from map(batch, stream.add(key, token_ids(text.as_py(), encoding)))
        yield from map(batch, stream.close())

    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select("doc_id", "text").mapInArrow(cut, schema)
