"""Array helpers for token columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate(items: Column, length: int) -> Column:
    return F.slice(items, 1, length)


def pad_right(items: Column, length: Column | int, pad: Column | int) -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    pad = F.lit(pad) if isinstance(pad, int) else pad
    missing = F.greatest(length - F.size(items), F.lit(0)).cast("int")
    return F.concat(items, F.array_repeat(pad, missing))


def attention_mask(n_real: Column, length: Column | int) -> Column:
    """1 for each real position and 0 for padding, from the count of real ones (pad may be a real id too)."""
    length = F.lit(length) if isinstance(length, int) else length
    real = F.least(n_real, length).cast("int")
    return F.concat(F.array_repeat(F.lit(1), real), F.array_repeat(F.lit(0), (length - real).cast("int")))


def up_to_multiple(n: Column, multiple: int = 8) -> Column:
    return (F.ceil(n / F.lit(float(multiple))) * multiple).cast("bigint")


def slices_of(batch: pa.Array, sizes: np.ndarray, at_most: int) -> Iterator[pa.Array]:
    """Parts of an Arrow batch, of whole rows whose sizes come to ``at_most``; a bigger row is a part of its own."""
    upto = np.cumsum(sizes)
    first = 0
    while first < len(batch):
        before = upto[first - 1] if first else 0
        end = max(int(np.searchsorted(upto, before + at_most, "right")), first + 1)
        yield batch.slice(first, end - first)
        first = end
