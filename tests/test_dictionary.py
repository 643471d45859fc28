"""Dictionary files: exact whatever the hashes, in many parts, and small in a worker's memory."""

from __future__ import annotations

import os
import resource
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark import SparkFiles
from pyspark.sql import functions as F

from textloom import operators as ops
from textloom.operators import dictionary
from textloom.operators.dictionary import Dictionary, ship_dictionary


def _vocabulary(spark, words):
    return spark.createDataFrame([(w, 2 + 3 * i) for i, w in enumerate(words)], "token string, id int").repartition(3)


@pytest.mark.parametrize("part", [1, 7, 1 << 18])
def test_words_and_ids(spark, monkeypatch, part):
    monkeypatch.setattr(dictionary, "PART_WORDS", part)
    words = [f"w{i}" for i in range(40)] + ["", "é", "中文", "a\x00b", "x" * 3000, "W1"]
    known = Dictionary.open(SparkFiles.get(ship_dictionary(_vocabulary(spark, words))))
    asked = [*words, "unknown", "w", "w40", "É"]
    ids = known.ids_of(pa.array(asked), 1).tolist()
    assert ids == [2 + 3 * i for i in range(len(words))] + [1] * 4
    assert known.words_of(np.array([*ids[:5], 0, 1, 3, 10**9, *ids[40:46]])).to_pylist() == words[:5] + [None] * 4 + words[40:46]


def test_equal_hashes_do_no_harm(spark, monkeypatch):
    hashes = lambda words: np.array([len(w.as_py()) for w in words], np.int64)
    words = [f"{i:03}" for i in range(50)] + ["a", "b", "ccccc"]
    ids, rows = range(2, 55), sorted((len(w), i) for i, w in zip(range(2, 55), words))
    blob = [w.encode() for w in words]
    known = Dictionary(
        np.array([h for h, _ in rows]), np.array([i - 2 for _, i in rows], np.uint32), np.array(ids, np.int32),
        np.cumsum([len(b) for b in blob]).astype(np.uint64), np.frombuffer(b"".join(blob), np.uint8),
    )
    monkeypatch.setattr(dictionary, "_hashes", hashes)
    asked = [*words, "zzz", "c", "dddddd", "ddddd"]
    assert known.ids_of(pa.array(asked), 1).tolist() == [*ids, 1, 1, 1, 1]


def test_an_empty_vocabulary(spark):
    docs = spark.createDataFrame([(1, ["a", None]), (2, None), (3, [])], "k long, w array<string>")
    nothing = _vocabulary(spark, ["a"]).where("false")
    got = {r.k: r.input_ids for r in ops.encode(docs, nothing, "w", lookup="map").collect()}
    assert got == {1: [1, 1], 2: [], 3: []}
    ids = docs.select("k", F.array(F.lit(5)).alias("i"))
    assert {r.decoded for r in ops.decode(ids, nothing, "i", lookup="map").collect()} == {""}


def test_too_many_words_to_ship(spark, monkeypatch):
    from textloom.operators import vocabulary

    monkeypatch.setattr(vocabulary, "MOST_SHIPPED", 3)
    docs = spark.createDataFrame([(1, ["a"])], "k long, w array<string>")
    with pytest.raises(ValueError, match="map"):
        ops.encode(docs, _vocabulary(spark, ["a", "b", "c", "d"]), "w")


def test_memory_of_a_worker(spark):
    """A million words, of which a worker holds no table: what it grows by is far below one."""
    n = 1_000_000
    words = spark.range(n).select(F.concat(F.lit("word-"), F.md5(F.col("id").cast("string"))).alias("token"), (F.col("id") + 2).cast("int").alias("id"))
    name = ship_dictionary(words)

    @F.pandas_udf("array<long>")
    def grown(ids):
        import pandas as pd

        from textloom.operators.dictionary import opened

        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        known = opened(name)
        found = known.words_of(ids.to_numpy())
        back = known.ids_of(found, 1)
        after = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        return pd.Series([[int((back == ids.to_numpy()).all()), after - before]] * len(ids))

    rows = spark.range(0, 20_000, 1, 4).select(grown(F.col("id") * 49 + 2).alias("g")).distinct().collect()
    assert all(r.g[0] == 1 for r in rows) and max(r.g[1] for r in rows) < 120_000  # KB, pages of the files included


CLUSTER = """
from pyspark.sql import functions as F
from textloom import operators as ops
from textloom.session import local_session, ship_package

spark = local_session(**{"spark.master": "local-cluster[2,1,1024]", "spark.driver.host": "127.0.0.1"})
ship_package(spark)
vocabulary = spark.createDataFrame([("a", 2), ("b", 3)], "token string, id int")
docs = spark.range(0, 6, 1, 4).select("id", F.array(F.lit("b"), F.lit("?"), F.lit("a")).alias("w"))
coded = ops.encode(docs, vocabulary, "w", lookup="map")
got = ops.decode(coded, vocabulary, "input_ids", lookup="map").collect()
print(sorted((r.id, r.input_ids, r.decoded) for r in got))
spark.stop()
"""


def test_on_executors_of_their_own():
    """Outside local mode Spark takes files and no folders."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(ops.__file__)))
    found = {**os.environ, "PYTHONPATH": os.path.dirname(root)}
    done = subprocess.run([sys.executable, "-c", CLUSTER], env=found, capture_output=True, text=True, timeout=300)
    assert done.stdout.splitlines()[-1:] == [str([(i, [3, 1, 2], "b a") for i in range(6)])], done.stderr[-2000:]
