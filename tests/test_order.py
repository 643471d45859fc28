"""Positions, batches, seeded order and quantiles, with and without skew."""

from __future__ import annotations

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from textloom import operators as ops
from textloom.operators.ranking import CHUNK, with_chunks


def skewed(spark, n=3000, seed=3):
    """A third of the rows in one group, and a third with one value, some null."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        group = "hot" if rng.random() < 0.34 else rng.choice(["a", "b", None, "c"])
        value = 7 if rng.random() < 0.34 else rng.choice([None, rng.randint(-50, 50), 10**12 + i])
        rows.append((i, group, value))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id bigint, g string, v bigint").repartition(7), rows


def ordered(rows):
    return sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0]))


@pytest.mark.parametrize("partitions", [1, 3, 17])
def test_position_over_table(spark, partitions):
    df, rows = skewed(spark)
    got = ops.add_position(df.repartition(partitions), ["v", "id"], chunks=20).collect()
    expected = {r[0]: i for i, r in enumerate(ordered(rows), 1)}
    assert {r.id: r.position for r in got} == expected


def test_position_in_groups(spark):
    df, rows = skewed(spark)
    got = ops.add_position(df, ["v", "id"], ["g"], chunks=20).collect()
    expected, seen = {}, {}
    for r in ordered(rows):
        seen[r[1]] = seen.get(r[1], 0) + 1
        expected[r[0]] = seen[r[1]]
    assert {r.id: r.position for r in got} == expected


def test_chunks_are_even_and_rising(spark):
    df, rows = skewed(spark)
    chunk = {r.id: r[CHUNK] for r in with_chunks(df, ["v", "id"], 30).collect()}
    numbers = [chunk[r[0]] for r in ordered(rows)]
    assert numbers == sorted(numbers)
    sizes = {}
    nulls = {r[0] for r in rows if r[2] is None}
    for key, number in chunk.items():
        if key not in nulls:
            sizes[number] = sizes.get(number, 0) + 1
    assert max(sizes.values()) <= 4 * len(rows) / 30


def test_position_by_time(spark):
    df = spark.range(500).select(
        "id", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, (id * 7919 % 500) / 1000)").alias("ts")
    )
    got = {r.id: r.position for r in ops.add_position(df, ["ts", "id"]).collect()}
    assert got == {i: i * 7919 % 500 + 1 for i in range(500)}


def test_empty_and_single(spark):
    assert ops.add_position(spark.range(0), ["id"]).count() == 0
    assert ops.add_position(spark.range(1), ["id"]).first().position == 1


def test_position_by_text(spark):
    texts = [f"http://host/{i * 7919 % 1000:05d}" for i in range(1000)] + ["", "http", "z", "é", "http://host/00003x"]
    rows = [(t, i) for i, t in enumerate(texts)] + [(None, -1)]
    df = spark.createDataFrame(rows, "t string, i int").repartition(5)
    got = {(r.t, r.i): r.position for r in ops.add_position(df, ["t", "i"], chunks=20).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1]))
    assert got == {r: n for n, r in enumerate(order, 1)}


def test_text_chunks_are_even(spark):
    rows = [(f"http://host/{i % 500:05d}", i) for i in range(5000)]
    chunked = with_chunks(spark.createDataFrame(rows, "t string, i int"), ["t"], 20)
    assert max(r["count"] for r in chunked.groupBy(CHUNK).count().collect()) <= 2 * 5000 / 20


def test_texts_that_begin_alike_are_cut(spark):
    rows = [("x" * 300 + f"{i * 7919 % 5000:05d}" if i % 3 else "hot", i) for i in range(5000)]
    df = spark.createDataFrame(rows, "t string, i int").repartition(5)
    chunked = with_chunks(df, ["t"], 20)
    assert max(r["count"] for r in chunked.groupBy(CHUNK).count().collect()) <= 2 * 5000 / 20
    got = {r.i: r.position for r in ops.add_position(df, ["t", "i"], chunks=20).collect()}
    assert got == {r[1]: n for n, r in enumerate(sorted(rows), 1)}


def test_position_in_groups_by_text(spark):
    rows = [("hot" if i % 3 else f"g{i % 7}", f"{i * 7919 % 3000:05d}") for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, t string").repartition(5)
    got = {r.t: r.position for r in ops.add_position(df, ["t"], ["g"], chunks=20).collect()}
    seen = {}
    for g, t in sorted(rows, key=lambda r: r[1]):
        seen[g] = seen.get(g, 0) + 1
        assert got[t] == seen[g]


def test_position_by_text_of_nothing(spark):
    assert ops.add_position(spark.createDataFrame([], "t string"), ["t"]).count() == 0


def test_ties_of_a_single_key_are_cut(spark):
    df = spark.createDataFrame([(7 if i % 4 else i, i) for i in range(20_000)], "k bigint, i bigint")
    chunked = with_chunks(df, ["k"], 20)
    assert max(r["count"] for r in chunked.groupBy(CHUNK).count().collect()) <= 2 * 20_000 / 20
    positions = sorted((r.k, r.position) for r in ops.add_position(df, ["k"], chunks=20).collect())
    assert [p for _, p in positions] == list(range(1, 20_001))


@pytest.mark.parametrize("partitions", [1, 17])
def test_batches(spark, partitions):
    keys = [i * i for i in range(83)]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint").repartition(partitions)
    got = {r.k: r.batch_id for r in ops.assign_batches(df, "k", 8).collect()}
    assert got == {k: i // 8 for i, k in enumerate(keys)}
    with pytest.raises(ValueError):
        ops.assign_batches(df, "k", 0)


def test_seeded_order(spark):
    df = spark.range(200).repartition(5)
    digest = lambda i, seed: hashlib.md5(f"{seed}:{i}".encode()).hexdigest()
    for seed in (42, 7):
        got = {r.id: r.shuffled_idx for r in ops.seeded_order(df, "id", seed).collect()}
        assert got == {k: i for i, k in enumerate(sorted(range(200), key=lambda k: digest(k, seed)))}


def test_collate(spark):
    rows = [(i, list(range(1, i % 21 + 1))) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, input_ids array<int>").repartition(3)
    got = {r.k: r for r in ops.collate(df, "k", 8, pad_id=0).collect()}
    for k, ids in rows:
        batch = [r for r in rows if r[0] // 8 == k // 8]
        width = math.ceil(max(len(r[1]) for r in batch) / 8) * 8
        assert got[k].batch_id == k // 8 and got[k].width == width
        assert got[k].input_ids == ids + [0] * (width - len(ids))
        assert got[k].attention_mask == [1] * len(ids) + [0] * (width - len(ids))
        assert got[k].labels == got[k].input_ids


def test_collate_keeps_given_labels_and_mask(spark):
    df = spark.createDataFrame([(1, [5, 6], [1, 0], [9, 9])], "k int, input_ids array<int>, attention_mask array<int>, labels array<int>")
    row = ops.collate(df, "k").first()
    assert row.attention_mask == [1, 0] + [0] * 6 and row.labels == [9, 9] + [0] * 6


def test_collate_keeps_rows_of_null_and_repeated_keys(spark):
    df = spark.createDataFrame([(1, [5]), (1, [6, 7]), (None, [8])], "k int, input_ids array<int>").repartition(2)
    got = ops.collate(df, "k", batch_size=2).collect()
    assert sorted((r.k or 0, [x for x in r.input_ids if x]) for r in got) == [(0, [8]), (1, [5]), (1, [6, 7])]
    assert sorted(r.batch_id for r in got) == [0, 0, 1] and all(len(r.input_ids) == r.width == 8 for r in got)


def test_own_collating(spark):
    batched = ops.assign_batches(spark.range(20).repartition(3), "id", 8)

    def widest(batch):
        return batch.assign(n=len(batch), top=batch["id"].max())

    rows = ops.map_batches(batched, widest, "id bigint, batch_id bigint, n int, top bigint").collect()
    assert {r.id: (r.n, r.top) for r in rows} == {i: (8 if i < 16 else 4, min(i // 8 * 8 + 7, 19)) for i in range(20)}


def test_plan_steps_rounding(spark):
    df = spark.createDataFrame([("train",)] * 33 + [("eval",)] * 2, "split string")
    plan = {r.split: (r.n_batches, r.steps_per_epoch, r.total_steps) for r in ops.plan_steps(df, 16, 4, 2).collect()}
    assert plan == {"train": (3, 1, 2), "eval": (1, 1, 2)}


def test_exact_quantiles(spark):
    df, rows = skewed(spark)
    quantiles = {"a": 0.0001, "b": 0.5, "c": 0.95, "d": 1.0}
    got = {r.g: [r[c] for c in quantiles] for r in ops.exact_quantiles(df, ["g"], "v", quantiles, chunks=15).collect()}
    for group in {r[1] for r in rows}:
        values = sorted(r[2] for r in rows if r[1] == group and r[2] is not None)
        assert got[group] == [values[max(math.ceil(q * len(values)), 1) - 1] for q in quantiles.values()]
