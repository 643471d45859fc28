"""Requests, generation, run histories, versions, monitoring and streams."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from textloom import operators as ops
from textloom.plans import inputs
from textloom.session import new_dir, shared_dir
from textloom.streaming import append_stream_metrics, stream_metrics, write_stream


def test_request_defaults(spark):
    bodies = ['{"prompt": "a"}', '{"prompt": "b", "temperature": 0.5, "top_k": 3, "max_new_tokens": null}']
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    rows = ops.parse_requests(df, "body").orderBy("prompt").collect()
    assert rows[0].asDict() | {"body": 0} == {
        "body": 0, "prompt": "a", "max_new_tokens": 128, "temperature": 1.0, "top_p": 0.9, "top_k": 50,
        "num_return_sequences": 1, "request_error": None,
    }
    assert (rows[1].temperature, rows[1].top_k, rows[1].max_new_tokens) == (0.5, 3, 128)


@pytest.mark.parametrize(
    "body, error",
    [
        ("not json", "body is not a JSON object"), (None, "body is not a JSON object"), ("[1]", "body is not a JSON object"),
        ("{}", "prompt is missing"), ('{"prompt": null}', "prompt is missing"), ('{"prompt": 5}', "prompt is not a text"),
        ('{"prompt": "p", "top_k": "abc"}', "top_k is not a whole number"),
        ('{"prompt": "p", "top_k": 3.7}', "top_k is not a whole number"),
        ('{"prompt": "p", "top_k": true}', "top_k is not a whole number"),
        ('{"prompt": "p", "top_k": 99999999999}', "top_k is not a whole number"),
        ('{"prompt": "p", "max_new_tokens": [1]}', "max_new_tokens is not a whole number"),
        ('{"prompt": "p", "temperature": {}}', "temperature is not a number"),
        ('{"prompt": "p", "top_k": "7", "top_p": 1, "temperature": "0.25", "num_return_sequences": 2.0}', None),
    ],
)
def test_requests_are_checked(spark, body, error):
    row = ops.parse_requests(spark.createDataFrame([(body,)], "body string"), "body").first()
    assert row.request_error == error
    if error is None:
        assert (row.top_k, row.top_p, row.temperature, row.num_return_sequences) == (7, 1.0, 0.25, 2)
    else:
        assert (row.top_k, row.top_p, row.max_new_tokens) == (50, 0.9, 128)


def test_broken_requests_never_reach_the_model(spark):
    bodies = ["not json", '{"prompt": "good", "top_k": 4}', '{"top_k": 4}']
    parsed = ops.parse_requests(spark.createDataFrame([(b, 0.5) for b in bodies], "body string, penalty double"), "body")

    def make():
        return lambda prompts, settings: [[f"{p}{p} {s['top_k']} {s['penalty']}"] for p, s in zip(prompts, settings)]

    rows = {r.body: (r.status, r.error, r.generated_texts) for r in ops.generate(parsed, make, settings=["penalty"]).collect()}
    assert rows[bodies[0]] == ("error", "body is not a JSON object", None)
    assert rows[bodies[1]] == ("ok", None, ["good 4 0.5"])
    assert rows[bodies[2]] == ("error", "prompt is missing", None)


def test_rows_that_differ_never_look_alike(spark):
    old = spark.createDataFrame([(1, None, "x"), (2, "a|b", "c"), (3, "1:a", None), (4, "s", "t")], "k int, a string, b string")
    new = spark.createDataFrame([(1, "x", None), (2, "a", "b|c"), (3, None, "1:a"), (4, "s", "t")], "k int, a string, b string")
    changes = {r.k: r.change for r in ops.version_diff(old, new, "k", ["a", "b"]).collect()}
    assert changes == {1: "changed", 2: "changed", 3: "changed", 4: "same"}


def test_prompt_is_cut_by_length(spark):
    df = spark.createDataFrame([("ab", "abXYZ  "), ("ab", "zz \tq"), ("long", "lo"), ("", " a ")], "p string, full string")
    got = [r.x for r in df.select(ops.without_prompt(F.col("full"), F.col("p")).alias("x")).collect()]
    assert got == ["XYZ", "q", "", "a"]


def make_generator():
    def generator(prompts, settings):
        if "bad" in prompts:
            raise RuntimeError("bad prompt")
        return [[f"{p} {i} of {s['num_return_sequences']}" for i in range(s["num_return_sequences"])] for p, s in zip(prompts, settings)]

    return generator


def test_one_bad_prompt_does_not_spoil_its_batch(spark):
    rows = [(i, "bad" if i == 5 else f"p{i}", i % 3 + 1) for i in range(20)]
    df = spark.createDataFrame(rows, "i int, prompt string, num_return_sequences int").coalesce(1)
    got = {r.i: r for r in ops.generate(df, make_generator, batch_size=8).collect()}
    assert len(got) == 20
    assert got[5].status == "error" and "bad prompt" in got[5].error and got[5].generated_texts is None
    assert all(r.status == "ok" and r.error is None for i, r in got.items() if i != 5)
    assert got[4].generated_texts == ["0 of 2", "1 of 2"]


def test_long_prompts_are_handed_over_cut(spark):
    df = spark.createDataFrame([("a  b c d",), ("a  b",)], "prompt string").coalesce(1)

    def make():
        return lambda prompts, settings: [[f"{p}|{p}"] for p in prompts]

    rows = {r.prompt: r.generated_texts for r in ops.generate(df, make, max_length=2).collect()}
    assert rows == {"a  b c d": ["|a b"], "a  b": ["|a  b"]}


def test_response_shape(spark):
    df = ops.generate(spark.createDataFrame([("hello",)], "prompt string"), make_generator)
    out = ops.to_response(df)
    row = out.first()
    assert row.prompt == "hello" and row.generated_texts == ["0 of 1"]
    assert row.parameters.asDict() == {
        "max_new_tokens": 128, "temperature": 1.0, "top_p": 0.9, "top_k": 50, "num_return_sequences": 1,
    }


def test_sequences_come_back_in_order(spark):
    df = spark.createDataFrame([(1, 12), (2, 1)], "k int, num_return_sequences int")
    texts = ops.expand_sequences(df).withColumn("text", F.col("seq").cast("string")).repartition(5)
    rows = {r.k: r.generated_texts for r in ops.collect_sequences(texts, ["k"]).collect()}
    assert rows == {1: [str(i) for i in range(1, 13)], 2: ["1"]}


def test_predict_column(spark):
    def make():
        import numpy as np

        return lambda texts: np.array([float(len(t)) for t in texts])

    df = spark.createDataFrame([("a",), ("bcd",)], "t string")
    assert [r.n for r in df.select(ops.predict(make, DoubleType(), F.col("t")).alias("n")).collect()] == [1.0, 3.0]


def stop_of(losses, patience):
    best, failed = None, 0
    for i, loss in enumerate(losses, 1):
        if best is None or loss < best:
            best, failed = loss, 0
        else:
            failed += 1
        if failed >= patience:
            return i
    return None


@pytest.mark.parametrize("chunks", [2, 7, 40])
@pytest.mark.parametrize("patience", [1, 3, 10])
def test_early_stop(spark, chunks, patience):
    rng = random.Random(chunks * 100 + patience)
    runs = {r: [rng.choice([1.0, 2.0, 3.0]) + (40 - i if r % 3 == 0 else 0) for i in range(200 if r == 0 else rng.randint(1, 40))] for r in range(12)}
    rows = [(r, i, loss) for r, losses in runs.items() for i, loss in enumerate(losses)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "run int, step int, loss double")
    got = {r.run: tuple(r)[1:] for r in ops.early_stop(df, "run", ["step"], "loss", patience, chunks).collect()}
    for run, losses in runs.items():
        stop = stop_of(losses, patience)
        low = min(losses[:stop])
        assert got[run] == (len(losses), stop, losses.index(low) + 1, low)


def test_best_step_and_every_nth(spark):
    df = spark.createDataFrame([(1, 10, 0.5), (1, 20, 0.2), (1, 30, 0.2), (2, 10, None), (2, 20, 9.0)], "run int, step int, loss double")
    assert {r.run: r.best_step for r in ops.best_step(df).collect()} == {1: 20, 2: 20}
    assert ops.every_nth_step(df, 20).count() == 2
    with pytest.raises(ValueError):
        ops.every_nth_step(df, 0)


def test_compare_runs_with_params(spark):
    df = spark.createDataFrame([(1, 1, "loss", 3.0), (1, 2, "loss", 4.0), (2, 1, "f1", 0.5)], "run int, step int, metric string, value double")
    params = spark.createDataFrame([(1, "0.1")], "run int, lr string")
    rows = {r.run: r for r in ops.compare_runs(df, ["loss", "f1"], params=params).collect()}
    assert (rows[1].loss_min, rows[1].loss_last, rows[1].f1_min, rows[1].lr) == (3.0, 4.0, None, "0.1")
    assert (rows[2].f1_last, rows[2].lr) == (0.5, None)


def test_fingerprint(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, t string")
    first = ops.fingerprint(df, ["k", "t"]).first()
    assert first == ops.fingerprint(df.repartition(3, "t"), ["k", "t"]).first()
    other = ops.fingerprint(df.where("k = 1").unionAll(df.where("k = 1")).unionAll(df.where("k = 1")), ["k", "t"]).first()
    assert (first.n_rows, first.fingerprint) == (other.n_rows, other.fingerprint) and first.hash_sum != other.hash_sum


def test_version_diff_with_copies_of_a_key(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "x"), (3, None)], "k int, t string")
    new = spark.createDataFrame([(1, "b"), (1, "a"), (2, "x"), (2, "x"), (4, "n"), (3, None)], "k int, t string")
    rows = {r.k: r.change for r in ops.version_diff(old, new, "k", ["t"]).collect()}
    assert rows == {1: "same", 2: "changed", 3: "same", 4: "added"}


def test_exact_and_sketched_windows_agree(spark, middle):
    log = inputs.request_log(spark.read.parquet(f"{middle}/events.parquet"))
    exact = ops.window_metrics(log, width="6 hours").orderBy("window_start").collect()
    sketched = ops.sketched_window_metrics(log, width="6 hours").orderBy("window_start").collect()
    assert [r.asDict() for r in exact] == [r.asDict() for r in sketched]
    assert sum(r.requests for r in exact) == 10_000


def test_stream_windows_equal_closed_table_windows(spark, middle, tmp_path):
    schema = spark.read.parquet(f"{middle}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(middle)
    out = str(tmp_path / "out")
    metrics = stream_metrics(inputs.request_log(stream), width="1 hour", delay="1 hour")
    write_stream(metrics, out, str(tmp_path / "checkpoint"), once=True).awaitTermination()
    streamed = {r.window_start: r for r in spark.read.parquet(out).collect()}
    log = inputs.request_log(spark.read.parquet(f"{middle}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    table = {r.window_start: r for r in ops.window_metrics(log, width="1 hour").collect()}
    assert len(table) == 720 and len(streamed) == 718
    assert all(table[w].asDict() == r.asDict() for w, r in streamed.items())


def test_late_rows_are_left_out_of_closed_windows(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    schema = "ts timestamp, status string, latency double"

    def feed(*times):
        rows = spark.createDataFrame([(t,) for t in times], "t string")
        rows.select(F.to_timestamp("t").alias("ts"), F.lit("ok").alias("status"), F.lit(1.0).alias("latency")).coalesce(
            1
        ).write.mode("append").parquet(str(source))
        stream = stream_metrics(spark.readStream.schema(schema).parquet(str(source)))
        write_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"), once=True).awaitTermination()

    feed("2024-01-01 00:00:01", "2024-01-01 00:00:14", "2024-01-01 00:05:00")
    feed("2024-01-01 00:00:02", "2024-01-01 00:05:01", "2024-01-01 00:10:00")
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("window_start").collect()
    assert [r.requests for r in rows] == [2, 2]


def test_stream_metric_sink_replaces_repeated_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(1, 1, "loss", 0.5), (2, 1, "loss", 0.7)]
    schema = "run bigint, step bigint, metric string, value double"
    spark.createDataFrame(rows, schema).write.parquet(source)
    for attempt in ("a", "b"):
        stream = spark.readStream.schema(schema).parquet(source)
        append_stream_metrics(stream, str(tmp_path / "out"), str(tmp_path / f"ck-{attempt}"), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


class FakeSession:
    """Stands in for a session with other settings, which a running one does not take."""

    def __init__(self, folder, master):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app-1"})


def test_shared_folder_is_the_configured_one():
    assert new_dir(FakeSession("hdfs://shared/tmp/", "yarn"), "x").startswith("hdfs://shared/tmp/x-")
    assert shared_dir(FakeSession(None, "local[8]")).endswith("app-1")
    with pytest.raises(ValueError):
        shared_dir(FakeSession(None, "yarn"))


def test_model_is_loaded_once_per_worker(spark, tmp_path):
    log = str(tmp_path / "loads")

    def make():
        import os

        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda prompts, settings: [[p + " done"] for p in prompts]

    df = spark.range(400).select(F.col("id").cast("string").alias("prompt")).repartition(40)
    assert ops.generate(df, make).where("generated_texts[0] = 'done'").count() == 400
    loads = open(log).read().split()
    assert len(loads) == len(set(loads))


def _make_lengths():
    def lengths(prompts, settings):
        if any("!" in p for p in prompts):
            raise ValueError("no shouting")
        return [[f"{p} got {len(p.split())}"] * s["num_return_sequences"] for p, s in zip(prompts, settings)]

    return lengths


def test_batches_by_length_equal_plain_ones(spark):
    draw = random.Random(2)
    prompts = [" ".join("w" for _ in range(draw.choice([1, 2, 3, 3, 3, 40, draw.randint(1, 60)]))) + f" {i}" for i in range(400)]
    prompts[7], prompts[8], prompts[9] = None, "", "stop !"
    df = spark.createDataFrame(list(enumerate(prompts)), "prompt_idx long, prompt string").repartition(5)
    columns = ["prompt_idx", "prompt", "generated_texts", "status", "error"]
    plain = ops.generate(df, _make_lengths).select(columns)
    by_length = ops.generate(df, _make_lengths, token_budget=64)
    rows = by_length.orderBy("prompt_idx").collect()
    assert [tuple(r[c] for c in columns) for r in rows] == [tuple(r) for r in plain.orderBy("prompt_idx").collect()]
    assert all(r.padded_to is None or r.prompt_tokens <= r.padded_to for r in rows)
    report = ops.padding_report(by_length).first()
    assert report.prompts == 399 and report.tokens == sum(len((p or "").split()) for p in prompts)
    in_order = sum(8 * max(len((p or "").split()) for p in prompts[i : i + 8]) for i in range(0, 400, 8))
    assert report.pad_share < 0.5 * (1 - report.tokens / in_order)
    with pytest.raises(ValueError):
        ops.generate(df, _make_lengths, token_budget=0)


def test_length_batches():
    from textloom.operators.generation import length_batches

    assert length_batches([], 10) == []
    assert length_batches([50], 10) == [1]
    assert length_batches([1, 1, 2, 3, 3, 9, 30, 30], 9) == [3, 5, 6, 7, 8]
    assert length_batches([0, 0, 0], 1) == [3]
