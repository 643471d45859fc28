"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import WordHashes, labelled_texts, words_of

DIMENSIONS = 1 << 20
SAMPLE = 12_000
MARKS = b".,;:!?\"'()[]{}<>*#$%&|_-~"
_BIGRAM, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _stripped(word: bytes) -> bytes:
    return word.strip(MARKS) or word


def hashed_features(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Places of all words, pairs of neighbours, and pairs with one word between; with repeats."""
    words = hashes.of(words_of(text))
    with np.errstate(over="ignore"):
        pairs = words[:-1] * _BIGRAM + (words[1:] >> np.uint64(7))
        skips = words[:-2] * _SKIP + (words[2:] >> np.uint64(11))
    return (np.concatenate([words, pairs, skips]) >> np.uint64(44)).astype(np.int32)


@dataclass
class Ftrl:
    """Follow-the-regularised-leader with a learning rate per coordinate; each feature counts once per document."""

    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 0.0
    epochs: int = 5

    def fit(self, rows: list[tuple[np.ndarray, int]], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of the weights that are not zero; the last place is the bias."""
        z, n = np.zeros(dimensions + 1), np.zeros(dimensions + 1)
        for _ in range(self.epochs):
            for places, label in rows:
                at = np.append(places, dimensions)
                w = self._weights(z[at], n[at])
                gradient = _sigmoid(w.sum()) - label
                before = n[at]
                after = before + gradient * gradient
                z[at] += gradient - (np.sqrt(after) - np.sqrt(before)) / self.alpha * w
                n[at] = after
        weights = self._weights(z, n)
        kept = np.flatnonzero(weights)
        return kept, weights[kept]

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 9, learner: Ftrl | None = None):
    """Learn from about ``sample`` labelled documents that are not held out; ``(places, values)`` of the weights.

    Features are worked out by all tasks; the learner, which goes through its examples one by one, is one task over the
    bounded sample. Only its weights, at most ``DIMENSIONS`` and in fact a few hundred, come to the driver.
    """
    learner = learner or Ftrl()

    def featurise(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(_stripped)
        for batch in frames:
            found = [np.unique(hashed_features(t.as_py(), hashes)).tobytes() for t in batch.column("text")]
            columns = [batch.column("doc_id"), batch.column("label"), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "places"])

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [
            (np.frombuffer(places, np.int32), int(label))
            for frame in frames
            for places, label in zip(frame["places"], frame["label"])
        ]
        if rows:
            places, values = learner.fit(rows)
            yield pd.DataFrame({"place": places, "value": values})

    texts = labelled_texts(docs, labels, "toxic", sample, seed)
    kind = texts.schema["doc_id"].dataType.simpleString()
    examples = texts.mapInArrow(featurise, f"doc_id {kind}, label int, places binary")
    ordered = examples.repartition(1).sortWithinPartitions(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
    weights = ordered.mapInPandas(learn, "place int, value double").toPandas()
    return weights["place"].to_numpy(np.int64), weights["value"].to_numpy(np.float64)


def score(text: str | Column, weights: tuple[np.ndarray, np.ndarray]) -> Column:
    """Probability that a text is toxic, from its whole length; an empty or null text gets the bias alone."""
    places, values = weights

    @F.arrow_udf("double")
    def toxicity(texts: pa.Array) -> pa.Array:
        dense = np.zeros(DIMENSIONS + 1, np.float32)
        dense[places] = values
        hashes = WordHashes(_stripped)
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            features = hashed_features(text.as_py(), hashes)
            telling = np.unique(features[dense[features] != 0])
            out[i] = dense[telling].sum(dtype=np.float64) + dense[DIMENSIONS]
        return pa.array(_sigmoid(out))

    return toxicity(F.col(text) if isinstance(text, str) else text)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; the model is learnt from ``labels`` (doc_id, toxic) first.

    Every row of ``docs`` comes back once, in its own columns plus the two (which replace columns of those names). Rows
    with null or empty text, and all rows if nothing is labelled, get the bias (0.5 without any example). Null ids are
    scored, not learnt from.
    """
    model = fit(docs, labels, sample)
    scored = docs.withColumn("score", score("text", model))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
