"""Column functions: plain expressions, but for ``lcs_size`` and ``clipped_overlaps``, which work on Arrow batches."""

from textloom.functions.arrays import attention_mask, pad_right, truncate, up_to_multiple
from textloom.functions.hashing import hash60, hash_uniform, seeded_digest
from textloom.functions.lcs import lcs_size
from textloom.functions.overlap import clipped_overlaps
from textloom.functions.text import (
    bigrams,
    is_filled,
    rouge_words,
    strip_text,
    words,
)

__all__ = [
    "attention_mask",
    "bigrams",
    "clipped_overlaps",
    "hash60",
    "hash_uniform",
    "is_filled",
    "lcs_size",
    "pad_right",
    "rouge_words",
    "seeded_digest",
    "strip_text",
    "truncate",
    "up_to_multiple",
    "words",
]
