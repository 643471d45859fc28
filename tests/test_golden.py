"""Values worked out beforehand for the middle-sized tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textloom import operators as ops
from textloom.functions import rouge_words, words
from textloom.plans import inputs, queries
from textloom.plans.inputs import table


def test_summary(spark, middle):
    row = queries.cls_summary(spark, middle).first()
    assert (row.accuracy, row.recall) == (pytest.approx(0.75188, abs=1e-5), pytest.approx(0.75188, abs=1e-5))
    assert (row.precision, row.f1) == (0.730378, 0.740852)


def test_class_counts(spark, middle):
    rows = {r["class"]: (r.tp, r.predicted, r.support) for r in queries.cls_counts(spark, middle).collect()}
    assert rows == {0: (3, 47, 58), 1: (297, 352, 341)}


def test_bleu_counts(spark, middle):
    row = ops.bleu_counts(inputs.pairs(spark, middle)).first()
    assert [row[f"match_{n}"] for n in range(1, 5)] == [1497, 38, 8, 6]
    assert [row[f"total_{n}"] for n in range(1, 5)] == [37192, 36959, 36726, 36493]
    assert (row.prediction_length, row.reference_length) == (37192, 7497)


def test_rouge(spark, middle):
    row = ops.rouge(inputs.pairs(spark, middle)).first()
    assert row.rouge1 == pytest.approx(0.110936, abs=1e-6)
    assert row.rouge2 == pytest.approx(0.004737, abs=1e-6)
    assert row.rougeL == pytest.approx(0.0721477, abs=1e-6)


def test_tokens(spark, middle):
    docs = table(spark, middle, "documents")
    n = docs.agg(F.sum(F.size(rouge_words(F.col("text")))).alias("n")).first().n
    assert n == 401_751
    assert docs.select(F.explode(words(F.col("text")))).distinct().count() == 93_796


def test_encoded_prefix_sum(spark, middle):
    docs = table(spark, middle, "documents")
    cut = docs.select("doc_id", words(F.col("text"), 128).alias("w"))
    ids = ops.encode(cut, ops.fit_vocabulary(docs), "w")
    assert ids.agg(F.sum(F.aggregate("input_ids", F.lit(0), lambda a, x: a + x)).alias("s")).first().s == 420_808_781


def test_language_model(spark, middle):
    losses = {r.item_id: r.loss for r in queries.lm_score(spark, middle).collect()}
    assert [losses[i] for i in range(4)] == [10.699814, 11.265164, 8.9219, 9.050761]
    by_rows = queries.lm_perplexity(spark, middle).where("weighted_by = 'rows'").first()
    assert by_rows.perplexity == pytest.approx(18137.4543, abs=1e-2)


def test_small_ones(spark, middle):
    assert queries.perplexity(spark, middle).first().perplexity == 11.132514
    assert queries.nucleus_filter(spark, middle).count() == 65
    assert queries.dataset_fingerprint(spark, middle).first()[:2] == (1000, 624576258712397519)
    shuffled = queries.seeded_shuffle(spark, middle).orderBy("shuffled_idx").limit(4).collect()
    assert [r.doc_id for r in shuffled] == [897, 47, 530, 19]
    report = queries.row_report(spark, middle).first()
    assert (report.rows_kept, report.rows_blank_kept) == (779, 60)


def test_versions(spark, middle):
    old = table(spark, middle, "documents").select("doc_id", "text")
    summary = ops.diff_summary(old, inputs.documents_v2(spark, middle), "doc_id", ["text"])
    assert {r.change: r.n_keys for r in summary.collect()} == {"added": 40, "removed": 59, "changed": 48, "same": 893}


def test_runs(spark, middle):
    stops = {r.run: (r.stop_step, r.best_step, r.best_loss) for r in queries.early_stop(spark, middle).collect()}
    assert len(stops) == 150 and stops[0] == (4, 1, 3.1)


def test_steps(spark, middle):
    plan = {r.split: (r.n_rows, r.total_steps) for r in queries.step_plan(spark, middle).collect()}
    assert plan == {"train": (800, 36), "eval": (100, 3), "test": (100, 3)}


def test_stream_outcomes(spark, middle):
    counts = queries.stream_requests(spark, middle).groupBy("status").count().collect()
    assert {r.status: r["count"] for r in counts} == {"ok": 2906, "error": 7094}


def test_bootstrap_of_length_loss(spark, middle):
    losses = queries._length_loss(spark, middle)
    row = ops.bootstrap_mean(losses, "doc_id", "loss", replicas=200).first()
    assert row.mid == pytest.approx(2.390845, abs=1e-5)
    assert (row.low, row.high) == (pytest.approx(2.20602, abs=1e-4), pytest.approx(2.60717, abs=1e-4))
