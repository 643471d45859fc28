"""The queries against their SQL, and the pipeline stage by stage."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from tests.oracle import connect, differences
from textloom.llm import minhash, mixing, packing
from textloom.llm.oracle import ORACLE
from textloom.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, middle, name):
    assert differences(QUERIES[name](spark, middle), connect(middle), ORACLE[name]) == []


def test_all_thirteen_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near duplicates", "mixing", "packing"]


def test_stages(spark, middle, tmp_path):
    docs = spark.read.parquet(f"{middle}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{middle}/labels.parquet").collect()}
    kept = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, middle).write.parquet(f"{tmp_path}/{number}")
        out = spark.read.parquet(f"{tmp_path}/{number}")
        if number < 4:
            assert out.columns == corpus_pipeline.COLUMNS
        kept.append(out)
        docs = out
    toxicity, quality, single, mixed, packed = (k.toPandas() for k in kept)
    for ids, column, wanted in ((set(toxicity.doc_id), "toxic", 0), (set(quality.doc_id), "quality", 1)):
        judged = [r for i, r in labels.items() if column == "toxic" or i in set(toxicity.doc_id)]
        assert np.mean([(r.doc_id in ids) == (r[column] == wanted) for r in judged]) > 0.95
    groups = minhash.near_duplicates(kept[1], 80).where("kept").toPandas()
    assert sorted(single.doc_id) == sorted(groups.doc_id) and set(single.doc_id) < set(quality.doc_id)
    words, again = (t.map(lambda x: len(x.encode().split())) for t in (single.text, mixed.text))
    assert set(mixed.doc_id) <= set(single.doc_id) and mixed.doc_id.value_counts().max() <= 3
    assert abs(again.sum() - words.sum()) < 0.05 * words.sum()
    encoding, _ = packing.load(None)
    expected = sum(len(packing.token_ids(t, encoding)) for t in mixed.text)
    assert packed.length.sum() == expected and len(set(packed.doc_id)) == len(set(mixed.doc_id))


def test_stages_over_no_documents(spark, middle):
    docs = spark.read.parquet(f"{middle}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, middle).collect() == []


def test_stages_over_odd_documents(spark, middle):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, kept int"
    plain = "thing of be the and one by when it is in to other words again here "
    rows = [(i, plain + f"w{i} " * 9 + "end.", "en", None if i % 3 else "a", 5, "x", 1) for i in range(1, 30)]
    rows += [(40, rows[0][1], "en", "a", 5, "x", 1)] * 2 + [(41, None, None, None, None, None, None), (42, "", "en", "b", 0, "x", 1)]
    rows += [(None, rows[1][1], "en", "a", 5, "x", 1), (None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    single = corpus_pipeline.near_duplicate_stage(spark, docs, middle)
    assert single.columns == corpus_pipeline.COLUMNS
    ids = sorted(r.doc_id or -1 for r in single.collect())
    assert ids == sorted([*range(1, 30), 41, 42, -1, -1])
    for stage in (corpus_pipeline.toxicity_stage, corpus_pipeline.quality_stage, corpus_pipeline.mixing_stage):
        out = stage(spark, docs, middle)
        assert out.columns == corpus_pipeline.COLUMNS and out.count() <= 3 * len(rows)
    packed = corpus_pipeline.packing_stage(spark, docs, middle).where("start = 0").count()
    assert packed == len(rows)


def test_sequences_follow_the_training_order(spark, middle, tmp_path):
    # late sources have long texts, so the last files are the largest
    rows = [(i, f"w{i} " * (600 if i % 3 == 2 else 20), "en", "abc"[i % 3], 5) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    sized = docs.select(*corpus_pipeline.COLUMNS, mixing.word_count("text").alias("size"))
    expected = [r.doc_id for r in mixing.in_training_order(mixing.curriculum(sized, "size")).select("doc_id").collect()]
    corpus_pipeline.mixing_stage(spark, docs, middle).write.option("maxRecordsPerFile", 100).parquet(f"{tmp_path}/mixed")
    mixed = spark.read.parquet(f"{tmp_path}/mixed")
    assert len(mixed.inputFiles()) > 8 and [r.doc_id for r in mixed.select("doc_id").collect()] != expected
    for order in (mixed, mixed.select(corpus_pipeline.COLUMNS)):
        packed = corpus_pipeline.packing_stage(spark, order, middle).where("start = 0")
        got = [r.doc_id for r in packed.orderBy("sequence_id", "offset").collect()]
        assert got == expected
