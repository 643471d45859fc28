"""Longest common subsequence of two token arrays."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


# Positions of the longer side that one pass works on; a pass keeps one mask of so many bits per word it meets.
BLOCK = 4096


def lcs_of_codes(a: list, b: list) -> int:
    """Bit-parallel LCS over blocks of ``a``, one bit per item, carried from block to block along ``b``.

    Equal ends and items that one side lacks are taken off first. Memory is that of a block's masks and one carry bit
    per item of ``b``, so it grows with the lengths, not with their product.
    """
    start, end = 0, 0
    shortest = min(len(a), len(b))
    while start < shortest and a[start] == b[start]:
        start += 1
    while end < shortest - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    common = set(a) & set(b)
    a, b = [x for x in a if x in common], [x for x in b if x in common]
    if len(a) > len(b):
        a, b = b, a
    found = start + end
    carries = bytearray(len(b))
    for begin in range(0, len(a), BLOCK):
        part = a[begin : begin + BLOCK]
        where: dict = {}
        for i, item in enumerate(part):
            where[item] = where.get(item, 0) | (1 << i)
        full = (1 << len(part)) - 1
        row = full
        for j, item in enumerate(b):
            hits = where.get(item, 0)
            both = row & hits
            total = row + both + carries[j]
            carries[j] = total >> len(part)
            row = (total | (row - both)) & full
        found += len(part) - row.bit_count()
    return found


@F.arrow_udf(IntegerType())
def _lcs_udf(left: pa.Array, right: pa.Array) -> pa.Array:
    return pa.array(
        [None if a is None or b is None else lcs_of_codes(a, b) for a, b in zip(left.to_pylist(), right.to_pylist())],
        pa.int32(),
    )


def lcs_size(left: Column, right: Column) -> Column:
    """LCS of whole arrays in Arrow batches; built-in functions would need a table of |left| x |right| per row."""
    return _lcs_udf(left, right)
