from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.functions import (
    attention_mask,
    clipped_overlaps,
    hash60,
    is_filled,
    lcs_size,
    pad_right,
    rouge_words,
    strip_text,
    up_to_multiple,
    words,
)
from textloom.functions import overlap
from textloom.functions.lcs import lcs_of_codes


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_strip_is_pythons(spark):
    texts = ["\t a b ", "\u001c x \u001f", "　y\u0085\n", " ", "", " z \r\n", "a\n b", "​q​", "\v\f"]
    assert column(spark, texts, "string", strip_text) == [t.strip() for t in texts]


def test_words(spark):
    texts = ["  a  b\tc\nd ", "", "   ", "one"]
    assert column(spark, texts, "string", words) == [t.split() for t in texts]
    for n in (1, 2, 3, 10):
        assert column(spark, texts, "string", lambda c, n=n: words(c, n)) == [t.split()[:n] for t in texts]


def test_filled(spark):
    assert column(spark, ["a", "", "  ", None], "string", is_filled) == [True, False, True, False]
    assert column(spark, [0, None], "int", is_filled) == [True, False]


def test_rouge_words(spark):
    assert column(spark, ["Hi, you-2 été!", "..."], "string", rouge_words) == [["hi", "you", "2", "t"], []]


def test_padding_and_mask(spark):
    pad = lambda c: pad_right(c, 4, 9)
    assert column(spark, [[1], [], [1, 2, 3, 4], [1, 2, 3, 4, 5]], "array<int>", pad) == [
        [1, 9, 9, 9], [9] * 4, [1, 2, 3, 4], [1, 2, 3, 4, 5],
    ]
    assert column(spark, [0, 2, 7], "int", lambda c: attention_mask(c, 4)) == [[0] * 4, [1, 1, 0, 0], [1] * 4]
    assert column(spark, [0, 1, 8, 9], "int", up_to_multiple) == [0, 8, 8, 16]


def test_hash_is_stable(spark):
    import hashlib

    expected = int(hashlib.md5(b"1:11:a~").hexdigest()[:15], 16)
    df = spark.createDataFrame([(1, "a", None)], "k int, t string, n string")
    assert df.select(hash60(F.col("k"), F.col("t"), F.col("n")).alias("h")).first().h == expected


def lcs_by_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_lcs():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 90))]
        b = [rng.choice("abcde") for _ in range(rng.randint(0, 90))]
        assert lcs_of_codes(a, b) == lcs_by_table(a, b)


def test_lcs_column(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "a", "b"]), ([], ["x"]), (["x"], None)], "a array<string>, b array<string>")
    assert [r.n for r in df.select(lcs_size(F.col("a"), F.col("b")).alias("n")).collect()] == [2, 0, None]


def matches(a, b, n):
    grams = lambda t: Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
    return sum((grams(a) & grams(b)).values())


@pytest.mark.parametrize("at_once", [10, 2_000_000])
def test_overlaps_against_counters(monkeypatch, at_once):
    monkeypatch.setattr(overlap, "TOKENS_AT_ONCE", at_once)
    rng = random.Random(2)
    text = lambda: [rng.choice("abc") for _ in range(rng.randint(0, 12))]
    pairs = [(text(), text()) for _ in range(100)]
    left, right = (pa.array([p[i] for p in pairs], pa.list_(pa.string())) for i in (0, 1))
    for n, counts in zip((1, 2, 4), overlap.batch_overlaps(left, right, (1, 2, 4))):
        assert list(counts) == [matches(a, b, n) for a, b in pairs]


def test_overlap_column(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["a", "b", "b"]), ([], [])], "a array<string>, b array<string>")
    rows = df.select(clipped_overlaps(F.col("a"), F.col("b"), (1, 2)).alias("m")).collect()
    assert [(r.m.m1, r.m.m2) for r in rows] == [(2, 1), (0, 0)]


def test_lcs_in_blocks(monkeypatch):
    import random

    from textloom.functions import lcs

    monkeypatch.setattr(lcs, "BLOCK", 5)
    draw = random.Random(2)
    for _ in range(300):
        a, b = ([draw.randrange(5) for _ in range(draw.randrange(30))] for _ in range(2))
        best = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                here = best[j]
                best[j] = before + 1 if x == y else max(best[j], best[j - 1])
                before = here
        assert lcs.lcs_of_codes(a, b) == best[-1]
