"""Clipped n-gram matches of two token arrays.

Built-in array functions can do this too, by sorting the grams of a row and numbering repeats, but their lambdas are
interpreted per element, which was slower when measured. Exploding the grams and grouping them would send them all over
the network. Both sides of a pair are in one row, so neither is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens worked on at once, at some hundred bytes each; more are handled in parts of whole rows.
TOKENS_AT_ONCE = 200_000


def batch_overlaps(left: pa.ListArray, right: pa.ListArray, orders: Sequence[int]) -> list[np.ndarray]:
    """Per order and row, the sum over distinct n-grams of the smaller of the two counts."""
    rows = len(left)
    sides = [left.flatten(), right.flatten()]
    if sum(map(len, sides)) > TOKENS_AT_ONCE and rows > 1:
        half = rows // 2
        first = batch_overlaps(left.slice(0, half), right.slice(0, half), orders)
        second = batch_overlaps(left.slice(half), right.slice(half), orders)
        return [np.concatenate(parts) for parts in zip(first, second)]
    # one row alone may hold more bytes than 32-bit offsets reach
    tokens = pa.concat_arrays([side.cast(pa.large_string()) for side in sides])
    encoded = pc.dictionary_encode(tokens)
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = pa.concat_arrays([pc.list_value_length(left), pc.list_value_length(right)])
    side = np.repeat(np.arange(2 * rows), pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False))
    found = {}
    grams, at = codes, np.arange(len(codes))
    for n in range(1, max(orders) + 1):
        if n > 1:
            # a gram of n is a gram of n - 1 and one more token of the same text; number the distinct ones anew
            inside = at + n - 1 < len(codes)
            at, grams = at[inside], grams[inside]
            same = side[at] == side[at + n - 1]
            at, grams = at[same], grams[same]
            longer = grams * max(len(encoded.dictionary), 1) + codes[at + n - 1]
            grams = np.unique(longer, return_inverse=True)[1]
        if n in orders:
            found[n] = _common(side[at], grams, rows)
    return [found[n] for n in orders]


def _common(side: np.ndarray, grams: np.ndarray, rows: int) -> np.ndarray:
    width = int(grams.max()) + 1 if len(grams) else 1
    keys = (side % rows) * width + grams
    is_left = side < rows
    left, left_n = np.unique(keys[is_left], return_counts=True)
    right, right_n = np.unique(keys[~is_left], return_counts=True)
    both, i, j = np.intersect1d(left, right, assume_unique=True, return_indices=True)
    return np.bincount(both // width, np.minimum(left_n[i], right_n[j]), rows).astype(np.int64)


def clipped_overlaps(left: Column, right: Column, orders: Sequence[int]) -> Column:
    """Struct with a BIGINT ``m<n>`` for each order n; neither array may be null."""
    orders = tuple(orders)

    @F.arrow_udf(f"struct<{', '.join(f'm{n}: bigint' for n in orders)}>")
    def overlaps(a: pa.Array, b: pa.Array) -> pa.Array:
        counts = batch_overlaps(a, b, orders)
        return pa.StructArray.from_arrays([pa.array(c) for c in counts], [f"m{n}" for n in orders])

    return overlaps(left, right)
