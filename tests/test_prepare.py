from __future__ import annotations

import json
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom import operators as ops
from textloom.functions import words


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(1, "b a a c"), (2, "a  b\n"), (3, "   "), (4, ""), (5, None), (6, "zz " + "a " * 600)]
    return spark.createDataFrame(rows, "k int, text string")


def test_vocabulary_order(spark, texts):
    rows = ops.fit_vocabulary(texts.where("k < 3"), size=10).orderBy("id").collect()
    assert [(r.token, r.n, r.id) for r in rows] == [("a", 3, 2), ("b", 2, 3), ("c", 1, 4)]
    assert [r.token for r in ops.fit_vocabulary(texts.where("k < 3"), size=2).orderBy("id").collect()] == ["a", "b"]


def test_prepare(spark, texts):
    vocabulary = ops.fit_vocabulary(texts.where("k < 3"))
    out = ops.prepare_text(texts.withColumn("other", F.lit(1)), vocabulary, "k", max_length=6)
    assert out.columns == ["k", "text", "input_ids", "attention_mask", "n_tokens"]
    rows = {r.k: r for r in out.collect()}
    assert set(rows) == {1, 2, 3, 6}
    assert rows[1].input_ids == [3, 2, 2, 4, 0, 0] and rows[1].attention_mask == [1, 1, 1, 1, 0, 0]
    assert rows[3].input_ids == [0] * 6 and rows[3].n_tokens == 0
    assert rows[6].input_ids == [1, 2, 2, 2, 2, 2] and rows[6].n_tokens == 6


@pytest.mark.parametrize("partitions", [1, 3, 17])
def test_prepared_lengths(spark, small, partitions):
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(partitions)
    out = ops.prepare_text(docs, ops.fit_vocabulary(docs, size=500), "doc_id", max_length=64)
    n = F.size(words(F.col("text")))
    bad = out.where(
        (F.size("input_ids") != 64)
        | (F.size("attention_mask") != 64)
        | (F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x) != F.least(n, F.lit(64)))
    )
    assert bad.count() == 0 and out.count() == docs.count()


def test_pad_id_may_be_any(spark):
    df = spark.createDataFrame([([5, 7],)], "input_ids array<int>")
    row = ops.pad_and_mask(df, max_length=4, pad_id=7).first()
    assert row.input_ids == [5, 7, 7, 7] and row.attention_mask == [1, 1, 0, 0]
    ids = spark.createDataFrame([(0, 9), (None, 9)], "pad int, eos int")
    assert [r.p for r in ids.select(ops.pad_token(F.col("pad"), F.col("eos")).alias("p")).collect()] == [0, 9]


@pytest.mark.parametrize("lookup", ["map", "join"])
def test_other_lookups_are_the_same(spark, small, lookup):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", words(F.col("text")).alias("w"))
    docs = docs.unionByName(spark.createDataFrame([(-1, [])], "doc_id bigint, w array<string>"))
    vocabulary = ops.fit_vocabulary(spark.read.parquet(f"{small}/documents.parquet"), size=3000)
    shipped = ops.encode(docs, vocabulary, "w")
    texts = ops.decode(shipped, vocabulary, "input_ids").select("doc_id", "input_ids", "decoded").collect()
    joined = ops.encode(docs, vocabulary, "w", lookup=lookup)
    joined_texts = ops.decode(joined, vocabulary, "input_ids", lookup=lookup).select("doc_id", "input_ids", "decoded")
    assert sorted(texts) == sorted(joined_texts.collect())


def test_full_vocabulary_round_trip(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", words(F.col("text")).alias("w"))
    vocabulary = ops.fit_vocabulary(docs, size=1_000_000)
    decoded = ops.decode(ops.encode(docs, vocabulary, "w"), vocabulary, "input_ids")
    assert decoded.where(F.col("decoded") != F.concat_ws(" ", "w")).count() == 0


@pytest.mark.parametrize("lookup", ["ship", "map", "join"])
def test_repeated_and_null_keys_keep_their_rows(spark, lookup):
    vocabulary = spark.createDataFrame([("a", 3, 2), ("b", 2, 3), ("c", 1, 4)], "token string, n bigint, id int")
    rows = [(1, ["a", "b"]), (1, ["c"]), (None, ["a", "a"]), (None, None), (2, ["x", None]), (2, []), (1, ["a", "b"])]
    df = spark.createDataFrame(rows, "k int, w array<string>").repartition(3)
    encoded = ops.encode(df, vocabulary, "w", lookup=lookup)
    got = sorted(((r.k or 0, r.input_ids) for r in encoded.collect()), key=str)
    assert got == sorted([(1, [2, 3]), (1, [4]), (0, [2, 2]), (0, []), (2, [1, 1]), (2, []), (1, [2, 3])], key=str)
    decoded = sorted((r.k or 0, r.decoded) for r in ops.decode(encoded, vocabulary, "input_ids", lookup=lookup).collect())
    assert decoded == sorted([(1, "a b"), (1, "c"), (0, "a a"), (0, ""), (2, ""), (2, ""), (1, "a b")])
    with pytest.raises(ValueError):
        ops.encode(df, vocabulary, "w", lookup="guess")


def test_null_and_empty_arrays(spark):
    vocabulary = spark.createDataFrame([("a", 1, 2)], "token string, n bigint, id int")
    df = spark.createDataFrame([(1, ["a", "x"]), (2, []), (3, ["a"])], "k int, w array<string>").coalesce(1)
    rows = ops.encode(df, vocabulary, "w").orderBy("k").collect()
    assert [r.input_ids for r in rows] == [[2, 1], [], [2]]


def test_tokeniser_file(spark, tmp_path):
    definition = {
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": {"type": "Lowercase"},
        "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "decoder": None,
        "model": {"type": "WordLevel", "vocab": {"<unk>": 0, "a": 1, "b": 2}, "unk_token": "<unk>"},
    }
    path = tmp_path / "tokeniser.json"
    path.write_text(json.dumps(definition))
    df = spark.createDataFrame([(1, "A b c"), (2, ""), (3, None)], "k int, text string").coalesce(1)
    assert [r.input_ids for r in ops.tokenise_with_file(df, str(path)).collect()] == [[1, 2, 0], [], []]
    assert ops.tokenise_with_file(df, str(path), max_length=2).first().input_ids == [1, 2]


def test_counting_on_the_way(spark, texts):
    counted, seen = ops.count_rows(texts, "read")
    kept, after = ops.count_rows(ops.drop_empty(counted), "kept")
    kept.write.format("noop").mode("overwrite").save()
    assert (seen.get["n_rows"], after.get["n_rows"]) == (6, 4)


def test_filter_reaches_the_scan(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plan = ops.drop_empty(docs).select("doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(text)" in plan and "n_chars" not in plan.split("ReadSchema")[1]


def test_a_worker_tokenises_some_texts_at_a_time(monkeypatch):
    from textloom.operators import tokenisers

    class Tokeniser:
        most = 0

        def encode_batch_fast(self, texts):
            self.most = max(self.most, sum(map(len, texts)))
            return [SimpleNamespace(ids=[len(t)]) for t in texts]

    monkeypatch.setattr(tokenisers, "BYTES_AT_ONCE", 100)
    texts = [None, "x" * 30, "", "y" * 150, "z" * 99, None, "u", "v"] * 20
    known = Tokeniser()
    got = pa.concat_arrays(tokenisers._ids(known, iter([pa.array(texts), pa.array([], pa.string())]))).to_pylist()
    assert got == [[len(t or "")] for t in texts] and known.most == 150


def test_a_worker_looks_up_some_rows_at_a_time(spark, monkeypatch):
    from textloom.operators import vocabulary

    monkeypatch.setattr(vocabulary, "ITEMS_AT_ONCE", 10)
    lists = [["a"] * 4, None, [], ["b", "?", None] * 7, ["c"] * 10, ["a", "b"]] * 5
    parts = list(vocabulary._some_at_once(iter([pa.array(lists)])))
    assert [row for part in parts for row in part.to_pylist()] == lists
    assert all(len(p.flatten()) <= 10 or sum(n is not None and len(n) > 0 for n in p.to_pylist()) == 1 for p in parts)
    words = spark.createDataFrame([("a", 2), ("b", 3), ("c", 4)], "token string, id int")
    df = spark.createDataFrame(list(enumerate(lists)), "k long, w array<string>").coalesce(1)
    ids = {"a": 2, "b": 3, "c": 4}
    for lookup in ("ship", "map"):
        coded = ops.encode(df, words, "w", lookup=lookup)
        got = {r.k: (r.input_ids, r.decoded) for r in ops.decode(coded, words, "input_ids", lookup=lookup).collect()}
        for k, items in enumerate(lists):
            assert got[k] == ([ids.get(i, 1) for i in items or []], " ".join(i for i in items or [] if i in ids))
