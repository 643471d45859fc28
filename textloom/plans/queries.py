"""One query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom import operators as ops
from textloom.functions import words
from textloom.operators.monitoring import QUANTILES
from textloom.plans import inputs
from textloom.plans.inputs import table
from textloom.session import new_dir
from textloom.sources import (
    append_metrics,
    load_data,
    materialise,
    params_long,
    read_metrics,
    read_prompts,
    union_splits,
    write_results,
)
from textloom.streaming import (
    read_latest,
    stream_early_stop,
    stream_metrics,
    stream_responses,
    write_latest,
    write_stream,
)

Query = Callable[[SparkSession, str], DataFrame]

VOCABULARY_SIZE = 30_000
REPLICAS = 200


def _flat(column: str) -> Column:
    return F.concat_ws(" ", F.col(column).cast("array<string>")).alias(column)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


# --- sources and sinks


def src_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "documents") + ".csv"
    docs = table(spark, sf_dir, "documents")
    plain = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    docs.write.options(**plain).csv(path)
    return load_data(spark, path).select("doc_id", "text", "lang", "source", "n_chars")


def csv_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with line breaks, commas and quotes in a few big files, cut into blocks of 64 KB."""
    path = new_dir(spark, "quoted") + ".csv"
    docs = table(spark, sf_dir, "documents")
    broken = F.concat(F.lit('say "'), F.regexp_replace("text", " the ", ',\n\n"'), F.lit('"\n'))
    quoted = docs.select("doc_id", F.when(F.col("doc_id") % 3 > 0, broken).otherwise(F.col("text")).alias("text"), "lang")
    plain = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    # more input is more files, and a task reads many blocks where there are more of them than a few per core
    quoted.coalesce(max(2, quoted.rdd.getNumPartitions() // 2)).write.options(**plain).csv(path)
    cut = {"spark.sql.files.maxPartitionBytes": 64 << 10, "spark.sql.files.maxPartitionNum": 4 * spark.sparkContext.defaultParallelism}
    before = {key: spark.conf.get(key, None) for key in cut}
    try:
        for key, value in cut.items():
            spark.conf.set(key, value)
        return load_data(spark, path, schema="doc_id bigint, text string, lang string")
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def src_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "conversations") + ".jsonl"
    table(spark, sf_dir, "conversations").write.json(path)
    return load_data(spark, path).select("conv_id", "turn", "role", "text")


def src_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_data(spark, f"{sf_dir}/documents.parquet")


def src_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "documents").createOrReplaceTempView("named_documents")
    return load_data(spark, "named_documents")


def src_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "prompts")
    table(spark, sf_dir, "benchmark").orderBy("item_id").select("text").write.text(path)
    return read_prompts(spark, path, dense=True)


def split_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "splits")
    docs = table(spark, sf_dir, "documents").withColumn("split", inputs.split_name())
    docs.write.partitionBy("split").parquet(path)
    return load_data(spark, path, split="train")


def split_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    held_out = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), "text")
    return union_splits({"train": train, "eval": held_out})


def sink_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = inputs.user_turns(spark, sf_dir)
    texts = F.array(F.concat(F.lit("re: "), "prompt"), F.lower("prompt"))
    results = turns.select(inputs.turn_key().alias("prompt_idx"), "prompt", texts.alias("generated_texts"))
    path = new_dir(spark, "results")
    write_results(results, path, order_by="prompt_idx")
    read = spark.read.schema("prompt_idx bigint, prompt string, generated_texts array<string>").json(path)
    return read.select("prompt_idx", "prompt", F.concat_ws("|", "generated_texts").alias("generated_texts"))


def params_long_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    config = orders.select(
        "o_orderkey",
        F.struct("o_custkey", "o_totalprice").alias("training"),
        F.struct("o_orderdate", "o_orderpriority").alias("data"),
        "o_orderstatus",
    )
    return params_long(config, "o_orderkey")


# --- preparation


def filter_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.drop_empty(inputs.documents_gaps(spark, sf_dir))


def row_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.row_report(inputs.documents_gaps(spark, sf_dir))


def length_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.length_report(inputs.documents(spark, sf_dir, "lang", "text"), "lang")


def _vocabulary(docs: DataFrame) -> DataFrame:
    """Fitted once and stored."""
    return materialise(ops.fit_vocabulary(docs, size=VOCABULARY_SIZE), new_dir(docs.sparkSession, "vocabulary"))


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.fit_vocabulary(inputs.documents(spark, sf_dir, "text"), size=VOCABULARY_SIZE)


def _words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = inputs.documents(spark, sf_dir, "doc_id", "text")
    return docs.select("doc_id", words(F.col("text")).alias("words")), _vocabulary(docs)


def encode_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For vocabularies beyond a worker's memory, which dictionary files meet and no join."""
    split, vocabulary = _words(spark, sf_dir)
    return ops.encode(split, vocabulary, "words", lookup="map").select("doc_id", _flat("input_ids"))


def decode_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    split, vocabulary = _words(spark, sf_dir)
    encoded = ops.encode(split, vocabulary, "words", lookup="map").select("doc_id", "input_ids")
    return ops.decode(encoded, vocabulary, "input_ids", lookup="map").select("doc_id", "decoded")


def encode_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    split, vocabulary = _words(spark, sf_dir)
    return ops.encode(split, vocabulary, "words").select("doc_id", _flat("input_ids"))


def decode_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    split, vocabulary = _words(spark, sf_dir)
    encoded = ops.encode(split, vocabulary, "words").select("doc_id", "input_ids")
    return ops.decode(encoded, vocabulary, "input_ids").select("doc_id", "decoded")


def prep_tokenise(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.documents(spark, sf_dir, "doc_id", "text")
    vocabulary = _vocabulary(docs)
    ready = ops.prepare_text(docs, vocabulary, "doc_id")
    return ready.select("doc_id", "n_tokens", _flat("input_ids"), _flat("attention_mask"))


def tokenise_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words looked up by a tokeniser file that is made from the vocabulary of the same documents."""
    docs = inputs.documents(spark, sf_dir, "doc_id", "text")
    path = new_dir(spark, "tokeniser")
    _word_level_file(ops.fit_vocabulary(docs, size=VOCABULARY_SIZE), path)
    return ops.tokenise_with_file(docs, path).select("doc_id", _flat("input_ids"))


def _word_level_file(vocabulary: DataFrame, path: str) -> None:
    """A word-level definition with the vocabulary's ids, written by Spark as one JSON text."""
    special = F.create_map(F.lit("<pad>"), F.lit(0), F.lit("<unk>"), F.lit(1))
    entries = vocabulary.agg(F.map_from_entries(F.collect_list(F.struct("token", "id"))).alias("m"))
    model = F.struct(
        F.lit("WordLevel").alias("type"), F.map_concat(special, "m").alias("vocab"), F.lit("<unk>").alias("unk_token")
    )
    splitter = F.struct(F.lit("WhitespaceSplit").alias("type"))
    nothing = F.lit(None).cast("string")
    definition = F.struct(
        F.lit("1.0").alias("version"),
        nothing.alias("truncation"),
        nothing.alias("padding"),
        F.array().cast("array<string>").alias("added_tokens"),
        nothing.alias("normalizer"),
        splitter.alias("pre_tokenizer"),
        nothing.alias("post_processor"),
        nothing.alias("decoder"),
        model.alias("model"),
    )
    entries.select(F.to_json(definition, {"ignoreNullFields": "false"})).write.text(path)


# --- batches


def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.assign_batches(table(spark, sf_dir, "documents"), "doc_id")


def batch_assign_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches along a text key, ties going by number."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    positioned = ops.add_position(docs, ["source", "doc_id"])
    return positioned.withColumn("batch_id", F.expr("(position - 1) div 8").cast("bigint"))


def collate_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.documents(spark, sf_dir, "doc_id", "text")
    lengths = docs.select("doc_id", F.transform(words(F.col("text")), lambda w: F.length(w)).alias("input_ids"))
    batches = ops.collate(lengths, "doc_id")
    return batches.select("doc_id", "batch_id", "width", _flat("input_ids"), _flat("attention_mask"), _flat("labels"))


def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.seeded_order(table(spark, sf_dir, "documents"), "doc_id")


def step_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(inputs.split_name().alias("split"))
    return ops.plan_steps(docs, batch_size=16, accumulation=4, epochs=3)


# --- classification


def cls_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.confusion_matrix(inputs.language_predictions(spark, sf_dir))


def cls_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.class_counts(inputs.quality_predictions(spark, sf_dir))


def cls_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = ops.classification_summary(inputs.quality_predictions(spark, sf_dir))
    return _rounded(summary, "accuracy", "precision", "recall", "f1")


def cls_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["German", "English", "Spanish", "French"]
    report = ops.class_report(inputs.language_predictions(spark, sf_dir), label_names=names)
    return _rounded(report, "precision", "recall", "f1")


def cls_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = ops.evaluate_classification(inputs.quality_predictions(spark, sf_dir), label_names=["low", "high"])
    return _rounded(report, "value")


# --- generated text


def pair_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.aligned_pairs(spark, sf_dir)


def align_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and their answers, written to files of different forms and numbers in the same order, paired again."""
    path, pairs = new_dir(spark, "sides"), inputs.aligned_pairs(spark, sf_dir)
    ordered = materialise(pairs.repartitionByRange(7, "key").sortWithinPartitions("key"), f"{path}/pairs")
    in_order = ordered.repartitionByRange(3, "key").sortWithinPartitions("key")
    in_order.select("reference").write.json(f"{path}/references")
    references = spark.read.schema("reference string").json(f"{path}/references")
    return ops.align_positions(references, ordered.select("prediction"))


def bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ops.bleu(inputs.pairs(spark, sf_dir)), "bleu")


def rouge_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ops.rouge(inputs.pairs(spark, sf_dir), ["rouge1", "rouge2"]), "rouge1", "rouge2")


def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = ops.rouge_scores(inputs.pairs(spark, sf_dir), ["rougeL"], keep=["key"])
    return _rounded(scores.withColumnRenamed("rougeL", "rouge_l"), "rouge_l")


def rouge_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = ops.rouge_scores(inputs.pairs(spark, sf_dir), ["rouge1"], keep=["key"])
    return _rounded(ops.bootstrap_mean(scores, "key", "rouge1", REPLICAS), "low", "mid", "high")


def text_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ops.evaluate_generated_text(inputs.pairs(spark, sf_dir)), "value")


# --- language model


def lm_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.fit_bigrams(inputs.documents(spark, sf_dir, "text")).pairs


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = ops.fit_bigrams(inputs.documents(spark, sf_dir, "text")).save(new_dir(spark, "bigrams"))
    return ops.score_texts(table(spark, sf_dir, "benchmark").select("item_id", "text"), model, "item_id")


def lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_scored(spark, sf_dir), "loss")


def lm_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By rows, which is the default, and by tokens."""
    both = ops.perplexities(_scored(spark, sf_dir), {"rows": None, "tokens": "n_tokens"})
    return both.withColumn("perplexity", F.round("perplexity", 3))


def _length_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / F.lit(1000.0)).alias("loss"))


def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ops.perplexity(_length_loss(spark, sf_dir)), "perplexity")


def batch_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ops.batch_losses(_length_loss(spark, sf_dir), "doc_id"), "loss")


# --- requests and models


def request_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = inputs.request_bodies(table(spark, sf_dir, "events"))
    return ops.parse_requests(requests, "body").drop("body")


def response_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = inputs.user_turns(spark, sf_dir)
    asked = turns.withColumn("top_k", F.when(F.col("turn") > 0, F.col("turn").cast("int")))
    answered = ops.with_defaults(asked).withColumn("generated_texts", F.array(F.concat(F.lit("re: "), "prompt")))
    return ops.to_response(answered).select(
        "conv_id", "turn", "prompt", F.concat_ws("|", "generated_texts").alias("generated_texts"), "parameters.*"
    )


def strip_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = F.concat(F.col("reference"), F.lit(" \n"), F.col("prediction"), F.lit("\t"))
    both = inputs.pairs(spark, sf_dir)
    return both.select("key", ops.without_prompt(full, F.col("reference")).alias("generated"))


def expand_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = inputs.user_turns(spark, sf_dir)
    asked = turns.withColumn("num_return_sequences", (F.col("conv_id") % 3 + 1).cast("int"))
    texts = ops.expand_sequences(asked).withColumn("text", F.concat_ws(" #", "prompt", "seq"))
    collected = ops.collect_sequences(texts, ["conv_id", "turn"])
    return collected.select("conv_id", "turn", F.concat_ws("|", "generated_texts").alias("generated_texts"))


def nucleus_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ops.nucleus_filter(inputs.candidates(spark, sf_dir), "lang", "source", "score", temperature=0.7)
    return _rounded(kept, "probability")


def _make_word_length() -> Callable:
    """A batch model: mean word length out of byte classes, a whole batch of texts at a time."""
    blank = np.zeros(256, bool)
    blank[list(b" \t\n\x0b\x0c\r")] = True
    middle = np.zeros(256, bool)
    middle[128:192] = True  # bytes that go on with a character

    def word_length(texts: np.ndarray) -> np.ndarray:
        raw = [t.encode() for t in texts]
        # a blank in front of each text, so that every word begins after one
        flat = np.frombuffer(b" " + b" ".join(raw), np.uint8)
        starts = np.cumsum([0, *(len(r) + 1 for r in raw[:-1])])
        dark = ~blank[flat]
        begins = np.append(False, dark[1:] & ~dark[:-1])
        letters = np.add.reduceat((dark & ~middle[flat]).astype("int64"), starts)
        counts = np.add.reduceat(begins.astype("int64"), starts)
        return letters / np.maximum(counts, 1)

    return word_length


def batch_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.documents(spark, sf_dir, "doc_id", "text")
    score = ops.predict(_make_word_length, T.DoubleType(), F.col("text"), batch_size=64)
    return _rounded(docs.select("doc_id", score.alias("score")), "score")


def _make_echo() -> Callable:
    """A model that numbers its answers and refuses prompts with a question mark."""

    def echo(prompts: list[str], settings: list[dict]) -> list[list[str]]:
        if any("?" in p for p in prompts):
            raise ValueError("no questions")
        return [
            [f"{p}  reply {i + 1} of {len(p)} characters " for i in range(s["num_return_sequences"])]
            for p, s in zip(prompts, settings)
        ]

    return echo


def generate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.when(F.col("conv_id") % 5 == 0, F.concat("prompt", F.lit("?"))).otherwise(F.col("prompt"))
    turns = inputs.user_turns(spark, sf_dir).withColumn("prompt", marked)
    asked = turns.withColumn("num_return_sequences", (F.col("turn") % 2 + 1).cast("int"))
    out = ops.generate(asked, _make_echo)
    return out.select("conv_id", "turn", "status", "error", F.concat_ws("|", "generated_texts").alias("generated_texts"))


def generate_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with prompts of similar length in a batch, and whether that padded less than batches of eight in order."""
    marked = F.when(F.col("conv_id") % 5 == 0, F.concat("prompt", F.lit("?"))).otherwise(F.col("prompt"))
    turns = inputs.user_turns(spark, sf_dir).withColumn("prompt", marked)
    asked = turns.withColumn("num_return_sequences", (F.col("turn") % 2 + 1).cast("int"))
    out = materialise(ops.generate(asked, _make_echo, token_budget=512), new_dir(spark, "generated"))
    share = ops.padding_report(out).select(F.col("pad_share") < 0.2).scalar()
    texts = F.concat_ws("|", "generated_texts").alias("generated_texts")
    return out.select("conv_id", "turn", "status", "error", texts, share.alias("little_padding"))


# --- runs and versions


def steps_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.every_nth_step(inputs.run_history(spark, sf_dir), 10)


def best_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.best_step(inputs.run_history(spark, sf_dir))


def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return ops.early_stop(events, "user_id", ["ts", "event_id"], "value").withColumnRenamed("user_id", "run")


def early_stop_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same while evaluations come in, batch by batch and out of order."""
    path = new_dir(spark, "evaluations")
    history = inputs.run_history(spark, sf_dir).select("run", "step", "loss")
    history.repartition(6, F.xxhash64("run", "step")).write.parquet(f"{path}/in")
    arriving = spark.readStream.schema(history.schema).option("maxFilesPerTrigger", 3).parquet(f"{path}/in")
    stopped = stream_early_stop(arriving)
    write_latest(stopped, f"{path}/out", f"{path}/checkpoint", once=True, keyed_state=True).awaitTermination()
    return read_latest(spark, f"{path}/out", stopped.schema, ["run"]).drop("held")


def runs_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    return ops.compare_runs(
        events, ["click", "view"], run="user_id", metric="event_type", value="value", step="event_id"
    )


def dataset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.fingerprint(table(spark, sf_dir, "documents"), ["doc_id", "text"])


def dataset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several columns with nulls and separators in them; some rows only swap their values."""
    old = inputs.documents_v1(spark, sf_dir)
    return ops.version_diff(old, inputs.documents_v2(spark, sf_dir), "doc_id", ["a", "b", "text"])


def stored_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stored versions, of which only the buckets that differ are read."""
    path = new_dir(spark, "versions")
    for name, docs in (("v1", inputs.documents_v1(spark, sf_dir)), ("v2", inputs.documents_v2(spark, sf_dir))):
        ops.store_version(docs, "doc_id", ["a", "b", "text"], f"{path}/{name}", buckets=64)
    return ops.stored_changes(spark, f"{path}/v1", f"{path}/v2")


# --- monitoring and streams


def monitor_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours merged from stored sketches of 15 seconds, and whether each quantile's rank is as near as is promised."""
    log = inputs.request_log(table(spark, sf_dir, "events"))
    sketches = materialise(ops.window_sketches(log), new_dir(spark, "sketches"))
    hours = ops.roll_up(sketches, "1 hour")
    at_most = [F.avg((F.col("latency") <= F.col(q)).cast("int")).alias(q) for q in QUANTILES]
    below = [F.avg((F.col("latency") < F.col(q)).cast("int")).alias(f"below_{q}") for q in QUANTILES]
    timed = log.withColumn("window_start", F.window("ts", "1 hour")["start"]).where("latency IS NOT NULL")
    ranks = timed.join(hours.select("window_start", *QUANTILES), "window_start").groupBy("window_start").agg(*at_most, *below)
    slack = 2 * ops.rank_error()
    near = F.lit(True)
    for name, q in QUANTILES.items():
        near = near & (F.col(name) >= q - slack) & (F.col(f"below_{name}") <= q + slack)
    checked = ranks.select("window_start", near.alias("near"))
    hours = hours.select("window_start", "window_end", "requests", "errors", "error_rate").join(checked, "window_start", "left")
    return _rounded(hours, "error_rate")


def monitor_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = inputs.request_log(table(spark, sf_dir, "events"))
    return _rounded(ops.window_metrics(log, width="1 hour"), "error_rate")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _finished(df: DataFrame, purpose: str) -> DataFrame:
    """Run the stream over what is there, and read back what it wrote."""
    spark = df.sparkSession
    path = new_dir(spark, purpose)
    write_stream(df, path, path + "-checkpoint", once=True).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows, with those that the watermark has not closed as they stand at the end."""
    log = inputs.request_log(_event_stream(spark, sf_dir))
    windows = stream_metrics(log, width="1 hour", delay="1 hour")
    path = new_dir(spark, "windows")
    write_latest(windows, path, path + "-checkpoint", once=True).awaitTermination()
    latest = read_latest(spark, path, windows.schema, ["window_start", "window_end"])
    local = {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    return _rounded(latest.withColumns(local), "error_rate")


def _make_counter() -> Callable:
    def count(prompts: list[str], settings: list[dict]) -> list[list[str]]:
        if any(p.startswith("error") for p in prompts):
            raise ValueError("not accepted")
        return [[f"{p} top {s['top_k']}"] * s["num_return_sequences"] for p, s in zip(prompts, settings)]

    return count


def stream_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = inputs.request_bodies(_event_stream(spark, sf_dir))
    parsed = ops.parse_requests(requests, "body").drop("body")
    done = _finished(stream_responses(parsed, _make_counter), "responses")
    return done.select(
        "event_id",
        "status",
        "error",
        "prompt",
        F.concat_ws("|", "generated_texts").alias("generated_texts"),
        F.col("parameters.top_k").alias("top_k"),
    )


# --- entries for what other queries only use on the way


def load_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table through each reader that the path picks."""
    talk = table(spark, sf_dir, "conversations")
    base = new_dir(spark, "dispatch")
    plain = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    talk.write.options(**plain).csv(base + "/talk.csv")
    talk.write.json(base + "/talk.jsonl")
    talk.write.parquet(base + "/talk.parquet")
    talk.write.parquet(base + "/folder/plain")
    talk.createOrReplaceTempView("named_conversations")
    paths = {
        "csv": base + "/talk.csv", "jsonl": base + "/talk.jsonl", "parquet": base + "/talk.parquet",
        "directory": base + "/folder/plain", "table": "named_conversations",
    }
    return union_splits(
        {name: load_data(spark, path).select("conv_id", "turn", "role", "text") for name, path in paths.items()}
    )


def cache_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second call reads the copy that the first one made."""
    cache = new_dir(spark, "cache")
    for _ in range(2):
        docs = load_data(spark, f"{sf_dir}/documents.parquet", cache_dir=cache)
    return docs


def cache_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in several files, copied, then some more files and one that is written anew: only those are read again."""
    path, cache = new_dir(spark, "source"), new_dir(spark, "cache")
    docs = table(spark, sf_dir, "documents")
    part = F.pmod("doc_id", F.lit(8))
    for n, rows in ((1, docs.where(part < 5)), (2, docs.where(part >= 4))):
        rows.write.parquet(f"{path}/set={n}")
    load_data(spark, path, cache_dir=cache)
    docs.where(part == 5).write.mode("overwrite").parquet(f"{path}/set=2")
    docs.where(part > 5).write.parquet(f"{path}/set=3")
    return load_data(spark, path, cache_dir=cache).drop("set")


def metrics_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "metrics")
    history = inputs.run_history(spark, sf_dir).select("run", "step", "metric", F.col("loss").alias("value"))
    for batch in ("even", "odd", "odd"):  # a batch that is written again counts once
        append_metrics(history.where(F.col("step") % 2 == int(batch == "odd")), path, batch)
    return read_metrics(spark, path, history.schema)


def metric_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only what is asked for is worked out; unknown names are ignored."""
    return _rounded(ops.evaluate_generated_text(inputs.pairs(spark, sf_dir), metrics=["bleu", "other"]), "value")


def pad_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The padding id of each document, and the end id where there is none."""
    docs = table(spark, sf_dir, "documents")
    pad = F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 3 - 1)
    return docs.select("doc_id", ops.pad_token(pad, F.lit(50_256).cast("bigint")).alias("pad_id"))


def _batch_shape(batch: pd.DataFrame) -> pd.DataFrame:
    sizes = batch["n_chars"]
    return pd.DataFrame({"batch_id": batch["batch_id"].iloc[:1], "n_rows": len(batch), "longest": sizes.max()})


def batch_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    batched = ops.assign_batches(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", 256)
    return ops.map_batches(batched, _batch_shape, "batch_id bigint, n_rows bigint, longest bigint")


def _queries() -> Iterator[tuple[str, Query]]:
    for q in (
        src_csv, src_jsonl, src_parquet, src_table, src_prompts, split_select, split_union, sink_results,
        filter_nonempty, row_report, length_report, vocab, encode_ids, decode_ids, prep_tokenise, tokenise_arrow,
        batch_assign, collate_batches, seeded_shuffle, step_plan,
        cls_confusion, cls_counts, cls_summary, cls_per_class, cls_evaluate,
        pair_align, bleu, rouge_n, rouge_l, rouge_bootstrap, text_evaluate,
        lm_fit, lm_score, lm_perplexity, perplexity, batch_losses,
        request_defaults, response_struct, strip_prompt, expand_sequences, nucleus_filter, batch_predict,
        generate_texts, steps_every, best_step, early_stop, runs_compare, dataset_fingerprint, dataset_diff,
        monitor_windows, stream_windows, stream_requests,
        encode_join, decode_join, batch_assign_text, load_dispatch, cache_copy, cache_files, metrics_append, metric_choice,
        pad_fallback, batch_map,
        align_positions, csv_borders, early_stop_stream, stored_changes, monitor_rollup, generate_by_length,
    ):
        yield q.__name__, q
    yield "params_long", params_long_query


QUERIES: dict[str, Query] = dict(_queries())
