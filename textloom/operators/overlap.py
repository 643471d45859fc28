"""BLEU and ROUGE over (reference, prediction) pairs.

Both texts of a pair sit in one row, so n-gram matching is a multiset intersection inside the row: nothing is shuffled
but the sums.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import clipped_overlaps, hash_uniform, lcs_size, rouge_words, words
from textloom.operators.ranking import add_position
from textloom.sources.positions import add_file_position, same_columns

BLEU_ORDER = 4
# Hexadecimal digits of a bootstrap block's number: 4,096 blocks.
BLOCK_DIGITS = 3
BLOCKS = 16**BLOCK_DIGITS


def align_pairs(references: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Join two tables one row to one row on ``key``; a key that is null, repeated or on one side only fails the query.

    Keys are counted on both sides first, in one grouping that combines before its shuffle.
    """
    ones = references.select(key, F.lit(1).alias("__r"), F.lit(0).alias("__p"))
    ones = ones.unionByName(predictions.select(key, F.lit(0).alias("__r"), F.lit(1).alias("__p")))
    counts = ones.groupBy(key).agg(F.sum("__r").alias("__r"), F.sum("__p").alias("__p"))
    found = F.concat(
        F.lit("key "), F.coalesce(F.col(key).cast("string"), F.lit("null")),
        F.lit(" has "), F.col("__r").cast("string"), F.lit(" references and "), F.col("__p").cast("string"),
        F.lit(" predictions"),
    )
    single = F.col(key).isNotNull() & (F.col("__r") == 1) & (F.col("__p") == 1)
    checked = counts.where(F.when(single, F.lit(True)).otherwise(F.raise_error(found).cast("boolean"))).select(key)
    return checked.join(references, key, "left").join(predictions, key, "left")


def align_positions(
    references: DataFrame,
    predictions: DataFrame,
    reference_order: Sequence[str] | None = None,
    prediction_order: Sequence[str] | None = None,
    into: str = "position",
) -> DataFrame:
    """Pair two tables without keys row by row, ``position`` counting from 0; unequal lengths fail with both counts.

    A table's order is that of its files and of the rows in them, however they are cut into tasks, or the columns given,
    which must tell rows apart. Each side is shuffled once, by position.
    """
    clash = same_columns(references, predictions) | ({into.lower()} & {c.lower() for c in references.columns + predictions.columns})
    if clash:
        raise ValueError(f"columns on both sides or named like the position: {sorted(clash)}")
    left, n = _with_position(references, reference_order, into)
    right, m = _with_position(predictions, prediction_order, into)
    if n != m:
        raise ValueError(f"{n} references and {m} predictions")
    return left.join(right, into).select(into, *[F.col(f"`{c}`") for c in references.columns + predictions.columns])


def _with_position(df: DataFrame, order: Sequence[str] | None, into: str) -> tuple[DataFrame, int]:
    if order is None:
        return add_file_position(df, into)
    return add_position(df, list(order), into=into).withColumn(into, F.col(into) - 1), df.count()


def bleu_counts(pairs: DataFrame, reference: str = "reference", prediction: str = "prediction") -> DataFrame:
    """Sums over all pairs: ``match_n``, ``total_n`` for n = 1 to 4, and both lengths."""
    tokens = pairs.select(
        words(F.coalesce(F.col(reference), F.lit(""))).alias("r"),
        words(F.coalesce(F.col(prediction), F.lit(""))).alias("p"),
    )
    orders = range(1, BLEU_ORDER + 1)
    matches = clipped_overlaps(F.col("p"), F.col("r"), orders)
    counted = tokens.select(F.size("r").alias("r_len"), F.size("p").alias("p_len"), matches.alias("m")).select("*", "m.*")
    sums = [F.sum("p_len").alias("prediction_length"), F.sum("r_len").alias("reference_length")]
    for n in range(1, BLEU_ORDER + 1):
        total = F.greatest(F.col("p_len") - (n - 1), F.lit(0))
        sums += [F.sum(f"m{n}").alias(f"match_{n}"), F.sum(total).alias(f"total_{n}")]
    return counted.agg(*sums)


def bleu(pairs: DataFrame, reference: str = "reference", prediction: str = "prediction") -> DataFrame:
    """Corpus BLEU of order 4 without smoothing over whitespace words; 0 if any order has no match."""
    matches = [F.col(f"match_{n}") for n in range(1, BLEU_ORDER + 1)]
    logs = [F.ln(m / F.col(f"total_{n}")) for n, m in enumerate(matches, 1)]
    mean_log = reduce(lambda a, b: a + b, logs) / F.lit(float(BLEU_ORDER))
    c, r = F.col("prediction_length"), F.col("reference_length")
    penalty = F.when(c > r, F.lit(1.0)).otherwise(F.exp(1.0 - r / F.nullif(c, F.lit(0))))
    score = F.when(F.least(*matches) == 0, F.lit(0.0)).when(c.isNotNull(), penalty * F.exp(mean_log))
    return bleu_counts(pairs, reference, prediction).withColumn("bleu", score)


def rouge_scores(
    pairs: DataFrame,
    kinds: Sequence[str] = ("rouge1", "rouge2", "rougeL"),
    reference: str = "reference",
    prediction: str = "prediction",
    keep: Sequence[str] = (),
) -> DataFrame:
    """F-measure of each pair, one column per kind, after ``keep``; 0 if nothing matches or a side is empty."""
    tokens = pairs.select(
        *keep,
        rouge_words(F.coalesce(F.col(reference), F.lit(""))).alias("r"),
        rouge_words(F.coalesce(F.col(prediction), F.lit(""))).alias("p"),
    )

    def f_measure(common: Column, n: int) -> Column:
        sizes = F.greatest(F.size("p") - (n - 1), F.lit(0)) + F.greatest(F.size("r") - (n - 1), F.lit(0))
        return F.when(sizes > 0, 2.0 * common / sizes).otherwise(F.lit(0.0))

    orders = [int(k.removeprefix("rouge")) for k in kinds if k != "rougeL"]
    common = []
    if orders:
        common.append(clipped_overlaps(F.col("p"), F.col("r"), orders).alias("m"))
    if "rougeL" in kinds:
        common.append(lcs_size(F.col("r"), F.col("p")).alias("lcs"))
    counted = tokens.select("*", *common)
    scores = {f"rouge{n}": f_measure(F.col(f"m.m{n}"), n) for n in orders}
    if "rougeL" in kinds:
        scores["rougeL"] = f_measure(F.col("lcs"), 1)
    return counted.select(*keep, *[scores[k].alias(k) for k in kinds])


def rouge(
    pairs: DataFrame,
    kinds: Sequence[str] = ("rouge1", "rouge2", "rougeL"),
    reference: str = "reference",
    prediction: str = "prediction",
) -> DataFrame:
    """Mean F-measure over all pairs, one column per kind."""
    return rouge_scores(pairs, kinds, reference, prediction).agg(*[F.avg(k).alias(k) for k in kinds])


def _poisson_weight(u: Column) -> Column:
    """Poisson(1) by inverse distribution function; 18 steps reach past the 52 bits of ``u``."""
    cumulative, steps = 0.0, []
    for k in range(18):
        cumulative += math.exp(-1.0) / math.factorial(k)
        if cumulative >= 1.0:
            break
        steps.append(F.when(u >= cumulative, 1).otherwise(0))
    return reduce(lambda a, b: a + b, steps)


def bootstrap_means(
    df: DataFrame, key: str, values: Sequence[str], replicas: int = 1000, confidence: float = 0.95
) -> DataFrame:
    """``(value, low, mid, high)``: range and middle of each column's mean over Poisson bootstrap replicas.

    Rows fall into ``BLOCKS`` blocks by a hash of their key, and a block's weight in a replica depends on the two numbers
    alone. So all columns share their draws, and the number of draws does not grow with the rows: blocks are summed up
    before they are drawn.
    """
    block = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, BLOCK_DIGITS), 16, 10)
    sums = [s for v in values for s in (F.sum(v).alias(f"__s_{v}"), F.count(v).alias(f"__n_{v}"))]
    blocks = df.withColumn("__block", block.cast("int")).groupBy("__block").agg(*sums)
    drawn = blocks.withColumn("replica", F.explode(F.sequence(F.lit(1), F.lit(replicas))))
    weighted = drawn.withColumn("w", _poisson_weight(hash_uniform(F.col("replica"), F.col("__block"))))
    means = weighted.groupBy("replica").agg(
        *[
            (F.sum(F.col("w") * F.col(f"__s_{v}")) / F.nullif(F.sum(F.col("w") * F.col(f"__n_{v}")), F.lit(0))).alias(v)
            for v in values
        ]
    )
    tail = (1.0 - confidence) / 2
    return (
        means.unpivot("replica", list(values), "value", "mean")
        .groupBy("value")
        .agg(
            F.percentile("mean", F.lit(tail)).alias("low"),
            F.percentile("mean", F.lit(0.5)).alias("mid"),
            F.percentile("mean", F.lit(1.0 - tail)).alias("high"),
        )
    )


def bootstrap_mean(
    df: DataFrame, key: str, value: str, replicas: int = 1000, confidence: float = 0.95
) -> DataFrame:
    """Low, mid and high of one column's mean; see ``bootstrap_means``."""
    return bootstrap_means(df, key, [value], replicas, confidence).drop("value")


def evaluate_generated_text(
    pairs: DataFrame,
    metrics: Sequence[str] = ("bleu", "rouge"),
    reference: str = "reference",
    prediction: str = "prediction",
    bootstrap_key: str | None = None,
    replicas: int = 1000,
) -> DataFrame:
    """Long table ``(metric, value)`` of the metrics asked for; unknown names are ignored and cost nothing.

    ROUGE is the exact mean over the pairs, or with ``bootstrap_key`` the middle of the bootstrap of that mean.
    """
    parts = []
    if "bleu" in metrics:
        score = bleu(pairs, reference, prediction)
        parts.append(score.select(F.lit("bleu").alias("metric"), F.col("bleu").alias("value")))
    if "rouge" in metrics:
        kinds = ["rouge1", "rouge2", "rougeL"]
        if bootstrap_key is None:
            parts.append(rouge(pairs, kinds, reference, prediction).unpivot([], kinds, "metric", "value"))
        else:
            scores = rouge_scores(pairs, kinds, reference, prediction, keep=[bootstrap_key])
            means = bootstrap_means(scores, bootstrap_key, kinds, replicas)
            parts.append(means.select(F.col("value").alias("metric"), F.col("mid").alias("value")))
    if not parts:
        return pairs.sparkSession.createDataFrame([], "metric string, value double")
    return reduce(DataFrame.unionByName, parts)
