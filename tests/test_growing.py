"""What grows over time: stored versions, metric batches, merged windows, and early stop of runs that go on."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from textloom.operators import early_stop, version_diff
from textloom.operators.monitoring import rank_error, roll_up, window_metrics, window_sketches
from textloom.operators.versions import differing_buckets, store_version, stored_changes
from textloom.sources import append_metrics, read_metrics
from textloom.streaming import append_stream_metrics, read_latest, stopping, stream_early_stop, write_latest


# --- versions


def _version(spark, rows):
    return spark.createDataFrame(rows, "id long, a string, b string").repartition(3)


def _rows(n):
    return [(i, f"a{i}", None if i % 5 == 0 else f"b{i}") for i in range(n)]


@pytest.mark.parametrize("buckets", [1, 2, 64, 256])
def test_changes_equal_the_difference(spark, tmp_path, buckets):
    old = [*_rows(300), (7, "again", "b"), (None, "no key", None)]
    new = [(i, f"{a}!" if i % 40 == 0 else a, b) for i, a, b in _rows(320) if i % 33]
    new += [(7, "again", "b"), (8, "a8", "b8!"), (None, "no key", None)]
    frames = [_version(spark, rows) for rows in (old, new)]
    for df, name in zip(frames, "on"):
        store_version(df, "id", ["a", "b"], f"{tmp_path}/{name}", buckets)
    got = sorted(map(tuple, stored_changes(spark, f"{tmp_path}/o", f"{tmp_path}/n").collect()))
    expected = version_diff(*frames, "id", ["a", "b"]).where("change <> 'same' AND id IS NOT NULL")
    assert got == sorted(map(tuple, expected.collect())) and {c for _, c in got} == {"added", "removed", "changed"}


def test_buckets_that_agree_are_not_read(spark, tmp_path):
    rows = _rows(2000)
    store_version(_version(spark, rows), "id", ["a", "b"], f"{tmp_path}/o", 256)
    rows[17] = (17, "changed", None)
    store_version(_version(spark, rows), "id", ["a", "b"], f"{tmp_path}/n", 256)
    differ, buckets = differing_buckets(spark, f"{tmp_path}/o", f"{tmp_path}/n")
    assert (len(differ), buckets) == (1, 256)
    changes = stored_changes(spark, f"{tmp_path}/o", f"{tmp_path}/n")
    assert [tuple(r) for r in changes.collect()] == [(17, "changed")]
    for other in set(range(256)) - set(differ):  # what is not read may be gone
        for version in "on":
            folder = tmp_path / version / "keys" / f"bucket={other}"
            for file in folder.glob("*.parquet"):
                file.write_bytes(b"not read")
    assert [tuple(r) for r in stored_changes(spark, f"{tmp_path}/o", f"{tmp_path}/n").collect()] == [(17, "changed")]


def test_equal_empty_and_unlike_versions(spark, tmp_path):
    same = _version(spark, _rows(50))
    for name, df, buckets in (("a", same, 16), ("b", same, 16), ("c", same.limit(0), 16), ("d", same, 32)):
        store_version(df, "id", ["a", "b"], f"{tmp_path}/{name}", buckets)
    path = lambda n: f"{tmp_path}/{n}"
    assert differing_buckets(spark, path("a"), path("b"))[0] == []
    assert stored_changes(spark, path("a"), path("b")).collect() == []
    assert {r.change for r in stored_changes(spark, path("c"), path("a")).collect()} == {"added"}
    assert stored_changes(spark, path("a"), path("c")).where("change = 'removed'").count() == 50
    assert stored_changes(spark, path("c"), path("c")).collect() == []
    with pytest.raises(ValueError, match="numbers of buckets"):
        stored_changes(spark, path("a"), path("d"))
    for name, rows in (("x", [(None, "a", None)]), ("y", [(None, "b", None)])):
        store_version(_version(spark, rows), "id", ["a", "b"], path(name), 4)
    assert [tuple(r) for r in stored_changes(spark, path("x"), path("y")).collect()] == [(None, "changed")]
    with pytest.raises(ValueError, match="power of two"):
        store_version(same, "id", ["a"], path("e"), 12)


# --- metrics


def _metrics(spark, n, start=0):
    rows = [(f"run{i % 7}", i, "loss", i / 3) for i in range(start, start + n)]
    return spark.createDataFrame(rows, "run string, step long, metric string, value double").repartition(4)


def test_batches_count_once(spark, tmp_path):
    path = f"{tmp_path}/m"
    append_metrics(_metrics(spark, 70), path, "first")
    append_metrics(_metrics(spark, 70), path, "first")
    name = append_metrics(_metrics(spark, 30, 70), path)
    assert name != "first"
    rows = sorted(map(tuple, read_metrics(spark, path).collect()))
    assert rows == sorted(map(tuple, _metrics(spark, 100).collect()))
    with pytest.raises(ValueError, match="batch"):
        append_metrics(_metrics(spark, 1), path, "a/b")


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/m"
    append_metrics(_metrics(spark, 20), path, "good")
    bad = F.when(F.col("step") == 33, F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("value"))
    with pytest.raises(PySparkException, match="broken"):
        append_metrics(_metrics(spark, 50).withColumn("value", bad), path, "bad")
    assert read_metrics(spark, path).count() == 20
    append_metrics(_metrics(spark, 50), path, "bad")
    assert read_metrics(spark, path).count() == 70


def test_files_hold_ranges_of_runs(spark, tmp_path):
    append_metrics(_metrics(spark, 700), f"{tmp_path}/m")
    files = spark.read.parquet(f"{tmp_path}/m").groupBy(F.col("_metadata.file_name").alias("f"))
    ranges = sorted((r.a, r.b) for r in files.agg(F.min("run").alias("a"), F.max("run").alias("b")).collect())
    assert len(ranges) <= 4 and all(before[1] <= after[0] for before, after in zip(ranges, ranges[1:]))


def test_a_stream_of_metrics_that_is_run_again(spark, tmp_path):
    _metrics(spark, 90).repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("run string, step long, metric string, value double").option("maxFilesPerTrigger", 1)
    for checkpoint in ("c1", "c2"):  # the second run knows nothing of the first one
        query = append_stream_metrics(stream.parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/{checkpoint}", once=True)
        query.awaitTermination()
    assert read_metrics(spark, f"{tmp_path}/out").count() == 90


# --- windows


def test_rolled_up_windows(spark):
    random_ = random.Random(1)
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(seconds=random_.randrange(7200)), random_.choice(["ok", "ok", "error"]), random_.lognormvariate(3, 1)) for _ in range(30_000)]
    rows += [(start + timedelta(hours=5), "error", None)]
    log = spark.createDataFrame(rows, "ts timestamp, status string, latency double")
    k = 200
    sketches = window_sketches(log, k=k)
    assert sketches.count() == 481
    got = {r.window_start: r for r in roll_up(sketches, "1 hour", k).collect()}
    exact = {r.window_start: r for r in window_metrics(log, width="1 hour").collect()}
    assert set(got) == set(exact)
    for window, r in got.items():
        e = exact[window]
        assert (r.requests, r.errors, r.window_end) == (e.requests, e.errors, e.window_end) and abs(r.error_rate - e.error_rate) < 1e-12
        values = sorted(v for t, _, v in rows if v is not None and window <= t < r.window_end)
        for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
            if not values:
                assert r[name] is None
                continue
            rank = sum(v <= r[name] for v in values) / len(values)
            assert abs(rank - q) <= rank_error(k) * 1.5
    assert rank_error(800) < rank_error(200) < 0.02


def test_small_windows_are_exact(spark):
    rows = [(datetime(2024, 1, 1, 0, 0, i), "ok", float(i)) for i in range(40)]
    log = spark.createDataFrame(rows, "ts timestamp, status string, latency double")
    (r,) = roll_up(window_sketches(log), "1 minute").collect()
    (e,) = window_metrics(log, width="1 minute").collect()
    assert (r.p50, r.p95, r.p99) == (e.p50, e.p95, e.p99)


# --- early stop


EVALUATIONS = "run string, step long, loss double"


def _runs(seed, runs=12):
    random_ = random.Random(seed)
    rows = []
    for run in range(runs):
        for step in range(1, random_.randint(1, 25) + 1):
            loss = None if random_.random() < 0.1 else round(random_.uniform(0, 5) / (1 + step / 6), 1)
            rows.append((f"run{run}", step, loss))
    return rows


def _streamed(spark, tmp_path, batches, **options):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EVALUATIONS).coalesce(1).write.json(f"{tmp_path}/made/{i}")
        time.sleep(0.01)
    files = spark.readStream.schema(EVALUATIONS).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", True)
    stopped = stream_early_stop(files.json(f"{tmp_path}/made"), **options)
    query = write_latest(stopped, f"{tmp_path}/out", f"{tmp_path}/checkpoint", once=True, keyed_state=True)
    query.awaitTermination()
    return {r.run: r for r in read_latest(spark, f"{tmp_path}/out", stopped.schema, ["run"]).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_early_stop(spark, tmp_path, seed):
    rows = _runs(seed)
    arriving = rows + random.Random(seed).sample(rows, 20)  # some come twice
    random.Random(seed).shuffle(arriving)
    got = _streamed(spark, tmp_path, [arriving[i::5] for i in range(5)])
    expected = early_stop(spark.createDataFrame(rows, EVALUATIONS), "run", ["step"], "loss").collect()
    assert len(got) == len(expected)
    for e in expected:
        r = got[e.run]
        best = (r.best_step, r.best_loss) if e.best_step is not None else (None, None)
        assert (r.n_steps, r.stop_step, *best, r.held) == (e.n_steps, e.stop_step, e.best_step, e.best_loss, 0)


def test_gaps_are_held(spark, tmp_path):
    got = _streamed(spark, tmp_path, [[("a", 1, 3.0), ("a", 3, 1.0), (None, 1, 2.0)], [("a", 4, 2.0), ("a", None, 0.0), ("b", 2, 1.0)]])
    assert (got["a"].n_steps, got["a"].best_step, got["a"].held) == (1, 1, 2)
    assert (got["b"].n_steps, got["b"].held, got["b"].best_step) == (0, 1, None)
    assert got[None].n_steps == 1


def test_a_gap_is_given_up(spark, tmp_path):
    schema = EVALUATIONS
    rows = [("a", 1, 3.0), ("a", 3, 1.0), ("a", 4, 2.0), ("a", 5, 2.0), ("a", 6, 2.0)]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{tmp_path}/in")
    stopped = stream_early_stop(spark.readStream.schema(schema).json(f"{tmp_path}/in"), hold_seconds=1)
    query = write_latest(stopped, f"{tmp_path}/out", f"{tmp_path}/checkpoint", keyed_state=True)
    try:
        for _ in range(60):
            time.sleep(1)
            try:
                (r,) = read_latest(spark, f"{tmp_path}/out", stopped.schema, ["run"]).collect()
            except (PySparkException, ValueError):
                continue
            if r.n_steps == 6:
                break
    finally:
        query.stop()
    assert (r.n_steps, r.stop_step, r.best_step, r.best_loss, r.held) == (6, 6, 3, 1.0, 0)


def test_what_waits_is_kept_in_blocks():
    """A run of many evaluations that wait writes and reads a block at a time."""
    calls = []

    class Kept(dict):
        def iterator(self):
            return iter(list(self.items()))

        def updateValue(self, key, value):  # noqa: N802
            calls.append(key)
            self[key] = value

        def removeKey(self, key):  # noqa: N802
            calls.append(key)
            del self[key]

    processor = stopping._EarlyStop(3, None)
    processor.early = Kept()
    late = {step: None if step % 5 == 0 else 1.0 / step for step in range(2, 10_001)}
    s = {"n_steps": 0, "gain": 0, "best": None, "stop_step": None, "best_step": None, "best_loss": None, "held": 0}
    processor._release(s, dict(late), set())
    assert s["held"] == 9_999 and len(calls) == 10_000 // stopping.HELD_BLOCK + 1
    assert processor._held(s) == late
    waiting = {step: loss for step, loss in late.items() if step > 1_000}
    calls.clear()
    processor._release(s, dict(waiting), set(late))
    assert calls == [(0,)] and processor._held(s) == waiting
    processor._release(s, {1: 2.0, **{step: None for step in range(2, 1_001)}, **waiting}, set(waiting))
    assert (s["n_steps"], s["held"], s["stop_step"], len(processor.early)) == (10_000, 0, 4, 0)


def test_evaluations_without_a_loss_or_a_number(spark, tmp_path):
    none = float("nan")
    got = _streamed(spark, tmp_path, [[("a", 2, none), ("a", 1, 3.0), ("a", 3, None)], [("a", 5, 9.0), ("a", 4, none)]])
    assert (got["a"].n_steps, got["a"].stop_step, got["a"].best_step, got["a"].best_loss) == (5, 4, 1, 3.0)
