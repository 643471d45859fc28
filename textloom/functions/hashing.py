"""Hashes that give the same value in every engine and on every partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_digest(seed: int | str, *keys: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def hash60(*values: Column) -> Column:
    """First 15 hex digits of the md5 of the values, as a non-negative BIGINT.

    Each value is written with its length in front, a null as a mark of its own, so different rows never look alike.
    """
    parts = []
    for v in values:
        text = v.cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("~")))
    digest = F.md5(F.concat(F.lit(""), *parts))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def hash_uniform(*values: Column) -> Column:
    """Uniform in [0, 1) from 13 hex digits (52 bits) of an md5."""
    digest = F.md5(F.concat_ws(":", *[v.cast("string") for v in values]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
