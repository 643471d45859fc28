"""Tables and the inputs derived from them that the queries start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import words
from textloom.operators import add_position, align_pairs
from textloom.sources.readers import load_data

# Common words by which a text's language is guessed, ties going to the earlier one.
STOP_WORDS = {
    "en": ("the", "of", "and", "to"),
    "fr": ("le", "la", "les", "des", "un"),
    "de": ("der", "die", "und", "das"),
    "es": ("el", "los", "que", "una"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load_data(spark, f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*columns)


def documents_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with some texts null, of length zero or blank."""
    key = F.col("doc_id")
    text = (
        F.when(key % 7 == 0, F.lit(None).cast("string"))
        .when(key % 11 == 0, F.lit(""))
        .when(key % 13 == 0, F.lit("   "))
        .otherwise(F.col("text"))
    )
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


def split_name() -> Column:
    last = F.col("doc_id") % 10
    return F.when(last < 8, "train").when(last == 8, "eval").otherwise("test")


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations")
    return talk.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))


def turn_key() -> Column:
    """Conversation and turn as one number, with 32 bits for the turn."""
    return (F.col("conv_id") * (1 << 32) + F.col("turn")).alias("key")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """User turns as references and the assistant turns after them as predictions, by the user turn's key.

    Keys are of conversation and turn, so the turns of one big conversation are dealt out over all tasks.
    """
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    asked = talk.where(F.col("role") == "user").select(turn_key(), F.col("text").alias("reference"))
    answered = talk.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction")
    )
    return asked, answered.select(turn_key(), "prediction")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn as the reference and the assistant turn after it as the prediction."""
    asked, answered = _sides(spark, sf_dir)
    return asked.join(answered, "key")


def aligned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of their own: user turns that are answered, and assistant turns that were asked for."""
    asked, answered = _sides(spark, sf_dir)
    return align_pairs(asked.join(answered, "key", "left_semi"), answered.join(asked, "key", "left_semi"), "key")


def quality_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    guess = F.when(F.col("n_chars") >= 500, 1).otherwise(0)
    docs = table(spark, sf_dir, "documents").select("doc_id", guess.alias("prediction"))
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


def language_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "lang", "text")
    split = docs.select("doc_id", F.col("lang").alias("label"), words(F.lower("text")).alias("w"))
    counted = split.select("doc_id", "label", *[_hits(F.col("w"), lang).alias(lang) for lang in STOP_WORDS])
    best = F.greatest(*STOP_WORDS)
    guess = F.coalesce(*[F.when(F.col(lang) == best, F.lit(lang)) for lang in STOP_WORDS])
    return counted.select("doc_id", "label", guess.alias("prediction"))


def _hits(split: Column, lang: str) -> Column:
    return F.size(F.filter(split, lambda w: w.isin(*STOP_WORDS[lang])))


def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as the evaluations of a run, numbered by time."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return add_position(events, ["ts", "event_id"], ["user_id"], into="step").select(
        F.col("user_id").alias("run"), "step", F.col("event_type").alias("metric"), F.col("value").alias("loss")
    )


def request_log(events: DataFrame) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "error").otherwise("ok")
    return events.select("event_id", "ts", status.alias("status"), F.col("value").alias("latency"))


def request_bodies(events: DataFrame) -> DataFrame:
    """Events as request bodies: some broken in one way or another, the others with a prompt and a ``top_k``."""
    top_k = F.get_json_object("props", "$.k")
    kind = F.col("event_id") % 11
    plain = F.concat(F.lit('{"prompt": "'), F.col("event_type"), F.lit(" "), F.col("user_id").cast("string"), F.lit('"'))
    body = (
        F.when(kind == 0, "not json")
        .when(kind == 1, F.concat(F.lit('{"top_k": '), top_k, F.lit("}")))
        .when(kind == 2, F.concat(plain, F.lit(', "top_k": "abc"}')))
        .when(kind == 3, F.concat(plain, F.lit(', "top_k": 3.7}')))
        .when(kind == 4, F.concat(plain, F.lit(', "temperature": true}')))
        .when(kind == 5, '{"prompt": 5}')
        .when(kind == 6, '["prompt"]')
        .when(kind == 7, F.concat(plain, F.lit(', "top_k": "'), top_k, F.lit('", "max_new_tokens": null}')))
        .otherwise(F.concat(plain, F.lit(', "temperature": 0.5, "top_k": '), top_k, F.lit("}")))
    )
    return events.select("event_id", body.alias("body"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang", "source").agg(F.ln(F.count(F.lit(1))).alias("score"))


def documents_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with two more columns that hold nulls and separators."""
    a = F.when(F.col("doc_id") % 7 > 0, F.col("lang"))
    b = F.when(F.col("doc_id") % 5 > 0, F.concat("source", F.lit("|")))
    return table(spark, sf_dir, "documents").select("doc_id", a.alias("a"), b.alias("b"), "text")


def documents_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next version of the documents: some gone, some changed, some with two values swapped, some new."""
    docs = documents_v1(spark, sf_dir).where(F.col("doc_id") % 17 != 0)
    swapped = F.col("doc_id") % 21 == 0
    changed = docs.select(
        "doc_id",
        F.when(swapped, F.col("b")).otherwise(F.col("a")).alias("a"),
        F.when(swapped, F.col("a")).otherwise(F.col("b")).alias("b"),
        F.when(F.col("doc_id") % 19 == 0, F.upper("text")).otherwise(F.col("text")).alias("text"),
    )
    none = F.lit(None).cast("string")
    new = table(spark, sf_dir, "benchmark").select(
        (F.col("item_id") + 1_000_000_000).alias("doc_id"), none.alias("a"), none.alias("b"), "text"
    )
    return changed.unionByName(new)
