"""Quality: histogram gradient-boosted trees over statistics of a document."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import labelled_texts

SAMPLE = 20_000
STATISTICS = (
    "bytes", "words", "word_length", "upper", "lower", "digits", "beyond_ascii", "bars", "exclamations", "symbols",
    "stops", "commas", "spaces", "newlines", "other_marks", "distinct_words", "repeated_neighbours", "distinct_pairs",
    "top_word", "short_words", "long_words", "symbol_ends", "upper_words", "distinct_lines", "line_length",
    "longest_line", "ended_lines", "distinct_windows",
)
_GROUPS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digits": b"0123456789",
    "beyond_ascii": bytes(range(128, 256)), "bars": b"|", "exclamations": b"!", "symbols": b"#$%&*@^~+=<>\\/_",
    "stops": b".?", "commas": b",;:", "spaces": b" \t", "newlines": b"\n\r\x0b\x0c", "other_marks": b"\"'()[]{}-`",
}
_SYMBOL_ENDS = tuple(bytes([c]) for c in b"#$%&*|!@^~")


def _byte_groups() -> np.ndarray:
    table = np.zeros((256, len(_GROUPS)))
    for i, group in enumerate(_GROUPS.values()):
        table[list(group), i] = 1
    return table


def statistics(text: str | None) -> list[float]:
    """The ``STATISTICS`` of the whole text; counts as logarithms, all else as shares; a null text is an empty one."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    size, n = max(1, len(raw)), max(1, len(words))
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _TABLE / size
    counts = Counter(words)
    numbers = dict(zip(counts, range(len(counts))))
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    pairs = ids[:-1] * len(counts) + ids[1:]
    windows = pairs[:-2] * 1_000_003 + pairs[2:]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    m = max(1, len(lines))
    return [
        np.log1p(len(raw)),
        np.log1p(len(words)),
        lengths.sum() / n,
        *shares,
        len(counts) / n,
        float((ids[1:] == ids[:-1]).sum()) / n,
        len(np.unique(pairs)) / n,
        max(counts.values(), default=0) / n,
        float((lengths <= 3).sum()) / n,
        float((lengths > 12).sum()) / n,
        sum(c for w, c in counts.items() if w.endswith(_SYMBOL_ENDS)) / n,
        sum(c for w, c in counts.items() if w.isupper()) / n,
        len(set(lines)) / m,
        np.log1p(sum(map(len, lines)) / m),
        np.log1p(max(map(len, lines), default=0)),
        sum(line.rstrip().endswith((b".", b"!", b"?")) for line in lines) / m,
        len(np.unique(windows)) / n,
    ]


_TABLE = _byte_groups()


@dataclass
class Trees:
    """All trees of a model in flat arrays; a leaf is its own child, so every row takes ``depth`` steps."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(x), -40, 40)))


@dataclass
class Boosting:
    """Second-order boosting of the logistic loss on binned features, grown level by level."""

    trees: int = 120
    depth: int = 4
    bins: int = 64
    rate: float = 0.1
    l2: float = 1.0
    least: float = 2.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        rate = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        nodes: list[list[float]] = []
        roots: list[int] = []
        base = float(np.log(rate / (1 - rate)))
        if len(y) and 0 < y.mean() < 1:
            quantiles = np.linspace(0, 1, self.bins + 1)[1:-1]
            cuts = [np.unique(np.quantile(x[:, f], quantiles)) for f in range(x.shape[1])]
            binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
            raw = np.full(len(y), base)
            for _ in range(self.trees):
                p = 1 / (1 + np.exp(-raw))
                roots.append(len(nodes))
                raw += self._grow(binned, cuts, p - y, p * (1 - p), nodes)
        if not nodes:
            roots, nodes = [0], [[0, np.inf, 0, 0, 0.0]]
        feature, threshold, left, right, value = np.array(nodes, np.float64).T
        whole = [a.astype(np.int64) for a in (feature, left, right)]
        return Trees(whole[0], threshold, whole[1], whole[2], value, np.array(roots), self.depth, base)

    def _grow(self, binned, cuts, gradient, hessian, nodes) -> np.ndarray:
        """Append one tree's nodes; what the tree adds for each row."""
        n, features = binned.shape
        start = len(nodes)
        place = np.zeros(n, np.int64)  # node of each row, among this level's
        level = [start]
        nodes.append([0, np.inf, start, start, 0.0])
        added = np.zeros(n)
        active = np.ones(n, bool)
        offsets = np.arange(features) * self.bins
        for step in range(self.depth + 1):
            k = len(level)
            rows = np.flatnonzero(active)
            cells = (place[rows, None] * (features * self.bins) + offsets + binned[rows]).ravel()
            shape = (k, features, self.bins)
            g = np.bincount(cells, np.repeat(gradient[rows], features), np.prod(shape)).reshape(shape).cumsum(2)
            h = np.bincount(cells, np.repeat(hessian[rows], features), np.prod(shape)).reshape(shape).cumsum(2)
            whole_g, whole_h = g[:, :1, -1:], h[:, :1, -1:]
            part = lambda a, b: a * a / (b + self.l2)
            gain = part(g, h) + part(whole_g - g, whole_h - h) - part(whole_g, whole_h)
            gain[(h < self.least) | (whole_h - h < self.least)] = 0
            best = gain.reshape(k, -1).argmax(1)
            feature, cut = best // self.bins, best % self.bins
            split = (gain.reshape(k, -1)[np.arange(k), best] > 1e-6) & (step < self.depth)
            split &= cut < np.array([len(cuts[f]) for f in feature])
            children = np.full((k, 2), -1)
            following: list[int] = []
            for i, node in enumerate(level):
                leaf = -self.rate * whole_g[i, 0, 0] / (whole_h[i, 0, 0] + self.l2)
                if not split[i]:
                    nodes[node][4] = float(leaf)
                    continue
                both = len(nodes), len(nodes) + 1
                nodes[node][:4] = [int(feature[i]), float(cuts[feature[i]][cut[i]]), *both]
                nodes += [[0, np.inf, b, b, 0.0] for b in both]
                children[i] = len(following), len(following) + 1
                following += both
            where = place[rows]
            leaves = np.array([nodes[node][4] for node in level])
            added[rows[~split[where]]] = leaves[where[~split[where]]]
            going = rows[split[where]]
            at = place[going]
            place[going] = children[at, (binned[going, feature[at]] > cut[at]).astype(int)]
            active = np.zeros(n, bool)
            active[going] = True
            if not following:
                break
            level = following
        return added


def features(text: str | Column) -> Column:
    """The statistics as an array of doubles."""

    @F.arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(t.as_py()) for t in texts], pa.list_(pa.float64()))

    return of(F.col(text) if isinstance(text, str) else text)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 2, learner: Boosting | None = None):
    """Learn from about ``sample`` labelled documents that are not held out.

    Tasks work out the statistics; the driver gets ``sample`` rows of ``len(STATISTICS)`` numbers, some 5 MB, and fits.
    """
    texts = labelled_texts(docs, labels, "quality", sample, seed)
    rows = texts.select("doc_id", "label", features("text").alias("x")).toArrow().sort_by("doc_id")
    flat = rows.column("x").combine_chunks().flatten().to_numpy()
    x = flat.reshape(rows.num_rows, len(STATISTICS))
    return (learner or Boosting()).fit(x, rows.column("label").to_numpy().astype(float))


def score(text: str | Column, model: Trees) -> Column:
    """Probability that a text is worth keeping, from its whole length."""

    @F.arrow_udf("double")
    def quality(texts: pa.Array) -> pa.Array:
        out = [np.empty(0)]
        for start in range(0, len(texts), 2048):
            part = texts.slice(start, 2048)
            out.append(model.probability(np.array([statistics(t.as_py()) for t in part], np.float64)))
        return pa.array(np.concatenate(out))

    return quality(F.col(text) if isinstance(text, str) else text)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; the model is learnt from ``labels`` (doc_id, quality) first.

    Every row of ``docs`` comes back once, in its own columns plus the two (which replace columns of those names). A null
    text counts as an empty one, and gets a score like any other. Without labelled rows, or with one label only, every
    score is the share of label 1, between 0.001 and 0.999, or 0.5. Null ids are scored, not learnt from.
    """
    scored = docs.withColumn("score", score("text", fit(docs, labels, sample)))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
