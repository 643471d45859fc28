"""Classification, generated text, language model, candidates."""

from __future__ import annotations

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom import operators as ops
from textloom.functions.overlap import batch_overlaps

PAIRS = "key int, reference string, prediction string"


def judged(spark, rows):
    return spark.createDataFrame(rows, "label int, prediction int")


def test_classes_never_true_or_never_predicted(spark):
    df = judged(spark, [(0, 0), (0, 2), (1, 0), (1, 0)])
    rows = {r["class"]: r for r in ops.class_report(df).collect()}
    assert (rows[0].precision, rows[0].recall, rows[0].support) == (pytest.approx(1 / 3), 0.5, 2)
    assert (rows[1].precision, rows[1].recall, rows[1].f1, rows[1].support) == (0, 0, 0, 2)
    assert (rows[2].precision, rows[2].f1, rows[2].support) == (0, 0, 0)
    summary = ops.classification_summary(df).first()
    assert summary.accuracy == summary.recall == 0.25
    assert summary.f1 == pytest.approx(0.4 * 2 / 4)


def test_weighted_recall_is_accuracy(spark):
    rng = random.Random(5)
    df = judged(spark, [(rng.randint(0, 6), rng.randint(0, 7)) for _ in range(500)])
    row = ops.classification_summary(df).first()
    assert row.recall == pytest.approx(row.accuracy)


def test_label_names(spark):
    df = judged(spark, [(5, 5), (9, 5), (9, 9)])
    assert {r.name: r["class"] for r in ops.class_report(df, label_names=["five", "nine"]).collect()} == {"five": 5, "nine": 9}
    for names in (["x"], ["x", "y", "z"]):
        with pytest.raises(Exception, match="label names"):
            ops.class_report(df, label_names=names).collect()
    assert [r.name for r in ops.class_report(df, label_names=["five"], strict=False).collect()] == ["five"]


def test_evaluate_classification(spark):
    df = judged(spark, [(0, 0), (1, 1)])
    assert {r.scope for r in ops.evaluate_classification(df).collect()} == {"overall"}
    rows = ops.evaluate_classification(df, label_names=["a", "b"]).collect()
    assert len(rows) == 4 + 8 and all(r.value == 1 for r in rows)


def value(df):
    return {r.metric: r.value for r in df.collect()}


def test_identical_texts_score_one(spark):
    df = spark.createDataFrame([(1, "a b c d e", "a b c d e")], PAIRS)
    assert value(ops.evaluate_generated_text(df)) == {"bleu": 1, "rouge1": 1, "rouge2": 1, "rougeL": 1}


def test_no_common_gram_of_four(spark):
    df = spark.createDataFrame([(1, "a b c d e", "a b c x d e")], PAIRS)
    assert ops.bleu(df).first().bleu == 0


def test_brevity_penalty(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "a b c d e")], PAIRS)
    assert ops.bleu(df).first().bleu == pytest.approx(math.exp(1 - 6 / 5))


def test_clipping(spark):
    df = spark.createDataFrame([(1, "the cat", "the the the the")], PAIRS)
    row = ops.bleu_counts(df).first()
    assert (row.match_1, row.total_1, row.match_2) == (1, 4, 0)


def test_empty_and_null_sides(spark):
    df = spark.createDataFrame([(1, "a", ""), (2, None, "b"), (3, "c d", "c d")], PAIRS)
    rows = {r.key: (r.rouge1, r.rougeL) for r in ops.rouge_scores(df, ["rouge1", "rougeL"], keep=["key"]).collect()}
    assert rows == {1: (0, 0), 2: (0, 0), 3: (1, 1)}
    none = spark.createDataFrame([], PAIRS)
    assert ops.bleu(none).first().bleu is None and ops.rouge(none).first().rouge1 is None


def test_metric_choice(spark):
    df = spark.createDataFrame([(1, "a b", "a c")], PAIRS)
    assert set(value(ops.evaluate_generated_text(df, ["bleu", "meteor"]))) == {"bleu"}
    assert value(ops.evaluate_generated_text(df, ["nothing"])) == {}
    only_bleu = ops.evaluate_generated_text(df, ["bleu"])._jdf.queryExecution().optimizedPlan().toString()
    assert "_lcs_udf" not in only_bleu


def test_bootstrap_middle(spark):
    df = spark.createDataFrame([(i, "a b c", "a b c" if i % 2 else "x") for i in range(200)], PAIRS)
    out = value(ops.evaluate_generated_text(df, ["rouge"], bootstrap_key="key", replicas=100))
    assert out["rouge1"] == pytest.approx(0.5, abs=0.03)
    again = value(ops.evaluate_generated_text(df.repartition(9), ["rouge"], bootstrap_key="key", replicas=100))
    assert again == pytest.approx(out)


def test_pairs_without_partner_fail(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "key int, reference string")
    right = spark.createDataFrame([(1, "x"), (2, "y")], "key int, prediction string")
    assert sorted(map(tuple, ops.align_pairs(left, right, "key").collect())) == [(1, "a", "x"), (2, "b", "y")]
    with pytest.raises(Exception, match="key 2 has 0 references and 1 predictions"):
        ops.align_pairs(left.where("key = 1"), right, "key").collect()
    with pytest.raises(Exception, match="key 2 has 1 references and 0 predictions"):
        ops.align_pairs(left, right.where("key = 1"), "key").collect()
    with pytest.raises(Exception, match="key 1 has 2 references and 2 predictions"):
        ops.align_pairs(left.unionByName(left), right.unionByName(right), "key").where("key = 1").collect()
    nothing = [frame.withColumn("key", F.lit(None).cast("int")).limit(1) for frame in (left, right)]
    with pytest.raises(Exception, match="key null has 1 references and 1 predictions"):
        ops.align_pairs(*nothing, "key").collect()


@pytest.mark.parametrize("stored", [False, True])
def test_language_model_by_hand(spark, tmp_path, stored):
    fit = spark.createDataFrame([("a b a",), ("a",), ("",)], "text string")
    model = ops.fit_bigrams(fit)
    if stored:
        model = model.save(str(tmp_path / "model"))
    texts = spark.createDataFrame([(1, "a b"), (2, "z z"), (3, " ")], "k int, text string")
    rows = {r.k: r for r in ops.score_texts(texts, model, "k").collect()}
    v = 3  # a, b and the unseen
    p = lambda n, c: math.log((n + 0.1) / (c + 0.1 * v))
    assert rows[1].loss == pytest.approx(-(p(2, 2) + p(1, 1)) / 2) and rows[1].n_tokens == 2
    assert rows[2].loss == pytest.approx(-(p(0, 2) + p(0, 0)) / 2)
    assert rows[3].loss is None and rows[3].n_tokens == 0


def test_scores_of_repeated_and_null_keys(spark):
    model = ops.fit_bigrams(spark.createDataFrame([("a b a",), ("a",)], "text string"))
    rows = [(1, "a b"), (1, "z z"), (None, "a b"), (None, None), (2, "a b")]
    got = ops.score_texts(spark.createDataFrame(rows, "k int, text string").repartition(3), model, "k").collect()
    single = {t: ops.score_texts(spark.createDataFrame([(0, t)], "k int, text string"), model, "k").first() for _, t in rows}
    expected = [(k or 0, single[t].n_tokens, round(single[t].loss or 0, 9)) for k, t in rows]
    assert sorted((r.k or 0, r.n_tokens, round(r.loss or 0, 9)) for r in got) == sorted(expected)


def test_bootstrap_shares_its_draws(spark):
    rows = [(i, float(i % 7), 2.0 * (i % 7)) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, a double, b double")
    both = {r.value: r for r in ops.bootstrap_means(df, "k", ["a", "b"], 50).collect()}
    alone = ops.bootstrap_mean(df.repartition(7), "k", "a", 50).first()
    assert (both["a"].low, both["a"].mid, both["a"].high) == pytest.approx(tuple(alone))
    assert both["b"].mid == pytest.approx(2 * both["a"].mid) and both["a"].low < 3 < both["a"].high


def test_perplexity(spark):
    df = spark.createDataFrame([(1.0, 2), (3.0, 6), (None, 9)], "loss double, n int")
    assert ops.perplexity(df).first().perplexity == pytest.approx(math.exp(2))
    assert ops.perplexity(df, weight="n").first().perplexity == pytest.approx(math.exp(20 / 8))
    assert ops.perplexity(df.limit(0)).first().perplexity is None


def test_row_mean_equals_weighted_batch_means(spark):
    df = spark.range(61).select("id", (F.col("id") % 13 / 3).alias("loss"))
    batches = ops.batch_losses(df, "id", batch_size=8)
    assert batches.agg(F.sum("n_rows")).first()[0] == 61
    by_batches = ops.perplexity(batches, weight="n_rows").first().perplexity
    assert by_batches == pytest.approx(ops.perplexity(df).first().perplexity)


def nucleus(scores, temperature, k, p):
    top = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[: k or None]
    weights = [(t, math.exp(s / temperature)) for t, s in top]
    total = sum(w for _, w in weights)
    kept, before = [], 0.0
    for t, w in weights:
        if p >= 1 or before < p:
            kept.append((t, w / total))
        before += w / total
    rest = sum(w for _, w in kept)
    return {t: w / rest for t, w in kept}


@pytest.mark.parametrize("temperature,k,p", [(1.0, 50, 0.9), (0.5, 3, 0.8), (2.0, 0, 0.5), (1.0, None, 1.0), (1.0, 1, 0.9)])
def test_nucleus(spark, temperature, k, p):
    rng = random.Random(6)
    scores = {c: {f"t{i}": rng.uniform(-3, 3) for i in range(60 if c == "hot" else 5)} for c in ("hot", "x", "y")}
    df = spark.createDataFrame([(c, t, s) for c, d in scores.items() for t, s in d.items()], "c string, t string, s double")
    got = {}
    for r in ops.nucleus_filter(df, "c", "t", "s", temperature, k, p).collect():
        got.setdefault(r.c, {})[r.t] = r.probability
    for c, d in scores.items():
        assert got[c] == pytest.approx(nucleus(d, temperature, k, p))
        assert sum(got[c].values()) == pytest.approx(1)


def test_nucleus_limits(spark):
    df = spark.createDataFrame([("c", "t", 900.0), ("c", "u", 1.0)], "c string, t string, s double")
    assert ops.nucleus_filter(df, "c", "t", "s", 0.5).count() == 1
    for bad in ({"temperature": 0}, {"top_p": 0}, {"top_p": 1.5}):
        with pytest.raises(ValueError):
            ops.nucleus_filter(df, "c", "t", "s", **bad)


def test_top_k_is_cut_before_the_shuffle(spark):
    df = spark.createDataFrame([("c", "t", 1.0)], "c string, t string, s double")
    plan = ops.nucleus_filter(df, "c", "t", "s")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("k, p", [(None, 0.9), (0, 1.0), (1500, 0.8), (1200, 1.0)])
def test_nucleus_of_large_contexts(spark, k, p):
    draw = random.Random(6)
    scores = {"big": {f"t{i:05}": round(draw.gauss(0, 2), 1) for i in range(4000)}, "small": {"a": 1.0, "b": 1.0, "c": -3.0}}
    rows = [(c, t, s) for c, d in scores.items() for t, s in d.items()]
    df = spark.createDataFrame(rows, "c string, t string, s double").repartition(4)
    got = {}
    for r in ops.nucleus_filter(df, "c", "t", "s", 0.8, k, p).collect():
        got.setdefault(r.c, {})[r.t] = r.probability
    for c, d in scores.items():
        assert got[c] == pytest.approx(nucleus(d, 0.8, k or len(d), p))


def test_memory_of_overlaps():
    """A batch of a million and a half tokens takes no more than a part of it does."""
    rng = np.random.default_rng(1)
    lists = pa.array([[f"w{i}" for i in row] for row in rng.integers(0, 500, (5_000, 150)).tolist()])
    few = [lists.slice(0, 3), lists.slice(3, 3)]
    tracemalloc.start()
    got = batch_overlaps(lists, lists, [1, 2, 4])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [set(n.tolist()) for n in got] == [{150}, {149}, {147}] and peak < 40e6
    both = batch_overlaps(*few, [1])[0].tolist()
    assert both == [sum((Counter(a) & Counter(b)).values()) for a, b in zip(*[f.to_pylist() for f in few])]


def test_the_texts_pairs_are_sent_to_the_model(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a b"), (2, "b a"), (3, None)], "k int, text string")
    model = ops.fit_bigrams(docs).save(str(tmp_path))
    expected = sorted(ops.score_texts(docs, model, "k").collect())
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, -1)
    try:
        scored = ops.score_texts(docs, model, "k")
        plan = scored._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == 2 and sorted(scored.collect()) == expected
    finally:
        spark.conf.set(key, before)
