"""The operators over whole tables, with the columns their contracts name."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import (
    caps, curves, debruijn, minhash, mixing, packing, periodic, quality, sharding, toxicity, urls, warc, whitening,
)
from textloom.llm.common import held_out, stored
from textloom.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.score_quality(docs, labels)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = warc.archive(table(spark, sf_dir, "pages"))
    return warc.with_full_payload_facts(warc.read_records(index, folder))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", sharding.row_size("text").alias("size"), crc)
    # texts are read once, and what follows goes over these narrow rows
    return sharding.shard(stored(rows, "sizes")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), threshold=85)


def op7_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def captures_and_lists(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fetch times from the page ids, and dated list entries from the pages' own hosts, domains and folders."""
    day = lambda times, days: F.date_add(F.lit("2020-01-01").cast("date"), (F.col("page_id") * times % days).cast("int"))
    captures = pages.select("page_id", "url", day(37, 1461).cast("timestamp_ntz").alias("fetched"))
    keys = urls.keys_of("url")
    entries = pages.select(
        F.when(F.col("page_id") % 2 == 0, "ads").otherwise("malware").alias("list"),
        F.try_element_at(keys, (F.col("page_id") % 3 + 1).cast("int")).alias("entry"),
        day(13, 1461).alias("since"),
        F.when(F.col("page_id") % 7 < 3, "remove").otherwise("add").alias("action"),
    )
    return captures, entries


def op8_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, entries = captures_and_lists(table(spark, sf_dir, "pages").select("page_id", "url"))
    judged = urls.judge(captures, entries)
    matches = F.array_join("matches", "|").alias("matches")
    return judged.select("page_id", "url", "fetched", F.size("matches").alias("n_matches"), matches)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score_toxicity(docs, labels)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = stored(docs.select("doc_id", "source", mixing.word_count("text").alias("size")), "sizes")
    planned = mixing.curriculum(sized, "size")
    taken = (F.col("size") * F.col("repeats")).alias("taken")
    first = F.round(F.try_element_at("positions", F.lit(1)), 9).alias("first_position")
    rows = planned.select("doc_id", "size", "source_size", "target", taken, first)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # documents that the mix leaves out come first, in order of their ids
    order = [F.col("first_position").asc_nulls_first(), F.col("doc_id")]
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def looped(doc_id: object, n: int) -> np.ndarray | None:
    """Word numbers of a tenth of the documents, by the hash of their ids, whose words from some place on repeat."""
    if doc_id is None:
        return None
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return None
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    return np.concatenate([np.arange(start), start + np.arange(n - start) % period])


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(table(spark, sf_dir, "documents"), order=looped)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "strongest.start",
        "strongest.length",
        "strongest.period",
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    whitened = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return whitened.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.drop_repeats(table(spark, sf_dir, "documents")).drop("kept")


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        op1_caps, op2_quality, op3_warc, op4_packing, op5_sharding, op6_minhash, op7_curves, op8_url_lists, op9_toxicity,
        op10_mixing, op11_periodic, op12_whitening, op13_debruijn,
    )
}
