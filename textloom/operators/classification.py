"""Accuracy, precision, recall and F1 from one pass over the labelled rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(part: Column, whole: Column) -> Column:
    """Share as a double, 0 where the whole is 0."""
    return F.coalesce(part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(class, tp, predicted, support)`` for every value seen on either side."""
    n, zero = F.col("n"), F.lit(0).cast("bigint")
    true_side = F.struct(
        F.col("label").alias("class"),
        F.when(F.col("label") == F.col("prediction"), n).otherwise(zero).alias("tp"),
        zero.alias("predicted"),
        n.alias("support"),
    )
    predicted_side = F.struct(
        F.col("prediction").alias("class"), zero.alias("tp"), n.alias("predicted"), zero.alias("support")
    )
    cells = confusion_matrix(df, label, prediction)
    return (
        cells.select(F.inline(F.array(true_side, predicted_side)))
        .groupBy("class")
        .agg(F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"), F.sum("support").alias("support"))
    )


def _with_ratios(counts: DataFrame) -> DataFrame:
    tp, predicted, support = F.col("tp"), F.col("predicted"), F.col("support")
    return (
        counts.withColumn("precision", _ratio(tp, predicted))
        .withColumn("recall", _ratio(tp, support))
        .withColumn("f1", _ratio(2 * tp, predicted + support))
    )


def class_report(
    df: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    label_names: Sequence[str] | None = None,
    strict: bool = True,
) -> DataFrame:
    """Precision, recall, F1 and support per class.

    ``label_names`` go to the classes in sorted order. More names than classes fail when the query runs; fewer names
    fail too unless ``strict=False``, which reports the named classes only.
    """
    report = _with_ratios(class_counts(df, label, prediction))
    columns = ["precision", "recall", "f1", "support"]
    if label_names is None:
        return report.select("class", *columns)
    names = list(label_names)
    table = df.sparkSession.createDataFrame(list(enumerate(names, 1)), "nth int, name string")
    # no more classes than names, and one to tell that there are more, ever meet in one task
    first = report.orderBy("class").limit(len(names) + 1)
    everything = Window.partitionBy(F.lit(0))
    ranked = first.withColumn("nth", F.row_number().over(everything.orderBy("class"))).withColumn(
        "classes", F.count(F.lit(1)).over(everything)
    )
    wrong = F.col("classes") != len(names) if strict else F.col("classes") < len(names)
    message = F.when(F.col("classes") > len(names), "more").otherwise(F.col("classes").cast("string"))
    failure = F.raise_error(F.concat(F.lit(f"{len(names)} label names, but "), message, F.lit(" classes")))
    checked = F.when(wrong, failure.cast("string")).otherwise(F.col("name"))
    # the names are an argument of this call, so their size is known
    joined = ranked.join(F.broadcast(table), "nth", "left" if strict else "inner")
    return joined.select(checked.alias("name"), "class", *columns)


def classification_summary(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: rows, accuracy and the support-weighted means of the class precision, recall and F1."""
    report = _with_ratios(class_counts(df, label, prediction))
    support = F.sum("support")

    def weighted(metric: str) -> Column:
        return (F.sum(F.col(metric) * F.col("support")) / support).alias(metric)

    return report.agg(
        support.alias("n_rows"),
        (F.sum("tp") / support).alias("accuracy"),
        weighted("precision"),
        weighted("recall"),
        weighted("f1"),
    )


def evaluate_classification(
    df: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    label_names: Sequence[str] | None = None,
    strict: bool = True,
) -> DataFrame:
    """Long table ``(scope, class, metric, value)``: overall values, and per class ones if names are given, of which there
    may be fewer than classes with ``strict=False``."""
    overall = classification_summary(df, label, prediction)
    metrics = ["accuracy", "precision", "recall", "f1"]
    long = overall.select(F.lit("overall").alias("scope"), F.lit(None).cast("string").alias("class"), *metrics).unpivot(
        ["scope", "class"], metrics, "metric", "value"
    )
    if not label_names:
        return long
    columns = ["precision", "recall", "f1", "support"]
    per_class = (
        class_report(df, label, prediction, label_names, strict)
        .withColumn("support", F.col("support").cast("double"))
        .select(F.lit("per_class").alias("scope"), F.col("name").alias("class"), *columns)
        .unpivot(["scope", "class"], columns, "metric", "value")
    )
    return long.unionByName(per_class)
