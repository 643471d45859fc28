"""Rows numbered along their files, tables paired by position, and CSV records cut out of blocks."""

from __future__ import annotations

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from textloom.operators import align_positions
from textloom.sources import borders, load_data, read_csv
from textloom.sources.borders import csv_records, read_records
from textloom.sources.positions import add_file_position


@pytest.fixture
def small_blocks(spark):
    """Blocks of 500 bytes, several of them to a task."""
    keys = {"spark.sql.files.maxPartitionBytes": "500", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _ordered(spark, n, parts):
    return spark.range(n).select(F.col("id"), F.concat(F.lit("text "), "id").alias("reference")).repartitionByRange(parts, "id")


@pytest.mark.parametrize("form", ["parquet", "json", "csv", "orc", "text"])
def test_positions_along_files(spark, tmp_path, small_blocks, form):
    df = _ordered(spark, 997, 13).sortWithinPartitions("id")
    path = f"{tmp_path}/{form}"
    if form == "text":
        df.select("reference").write.text(path)
        read = spark.read.text(path).withColumnRenamed("value", "reference")
    else:
        df.write.format(form).option("header", True).save(path)
        read = spark.read.format(form).option("header", True).load(path)
    placed, total = add_file_position(read)
    assert total == 997
    assert [r.reference for r in placed.orderBy("position").collect()] == [f"text {i}" for i in range(997)]
    assert sorted(r.position for r in placed.collect()) == list(range(997))
    kept, total = add_file_position(read.where(~F.col("reference").endswith("7")))
    assert total == kept.count() and sorted(r.position for r in kept.collect()) == list(range(total))


def test_files_beyond_five_digits_keep_their_order(spark, tmp_path):
    for i, name in enumerate(["part-00009-a-c000", "part-99999-a-c000", "part-100000-a-c000", "part-100000-a-c001"]):
        (tmp_path / f"{name}.json").write_text(f'{{"id": {i}}}\n')
    placed, _ = add_file_position(spark.read.json(str(tmp_path)))
    assert sorted((r.position, r.id) for r in placed.collect()) == [(i, i) for i in range(4)]


def test_two_layouts_give_the_same_pairs(spark, tmp_path, small_blocks):
    _ordered(spark, 500, 7).sortWithinPartitions("id").select("reference").write.json(f"{tmp_path}/r")
    answers = _ordered(spark, 500, 3).sortWithinPartitions("id").select(F.upper("reference").alias("prediction"))
    answers.write.parquet(f"{tmp_path}/p")
    answers.coalesce(1).write.csv(f"{tmp_path}/q")
    references = spark.read.json(f"{tmp_path}/r")
    for predictions in (spark.read.parquet(f"{tmp_path}/p"), spark.read.csv(f"{tmp_path}/q").toDF("prediction")):
        pairs = align_positions(references, predictions).collect()
        assert sorted((r.position, r.reference) for r in pairs) == [(i, f"text {i}") for i in range(500)]
        assert all(r.prediction == r.reference.upper() for r in pairs)


def test_lengths_names_and_tables_without_files(spark, tmp_path):
    spark.range(5).select("id").write.parquet(f"{tmp_path}/a")
    spark.range(6).select(F.col("id").alias("other")).write.parquet(f"{tmp_path}/b")
    spark.range(0).select(F.col("id").alias("other")).write.parquet(f"{tmp_path}/c")
    a, b, c = (spark.read.parquet(f"{tmp_path}/{n}") for n in "abc")
    with pytest.raises(ValueError, match="5 references and 6 predictions"):
        align_positions(a, b)
    with pytest.raises(ValueError, match="5 references and 0 predictions"):
        align_positions(a, c)
    assert align_positions(c, c.withColumnRenamed("other", "id")).collect() == []
    with pytest.raises(ValueError, match="id"):
        align_positions(a, a)
    with pytest.raises(ValueError, match="position"):
        align_positions(a.withColumnRenamed("id", "Position"), b)
    with pytest.raises(ValueError, match="files"):
        align_positions(spark.range(5), b)
    made = spark.range(5).select((F.lit(100) - F.col("id")).alias("k"))
    pairs = align_positions(made, a, reference_order=["k"]).collect()
    assert sorted((r.position, r.k, r.id) for r in pairs) == [(i, 96 + i, i) for i in range(5)]


def _cell(random_):
    kind = random_.random()
    if kind < 0.3:
        return str(random_.randint(0, 999))
    if kind < 0.4:
        return ""
    pieces = ["word", " ", ",", '""', "\n", "\r\n", "é中", "x" * random_.randint(0, 60), "\n\n"]
    text = "".join(random_.choice(pieces) for _ in range(random_.randint(0, 8)))
    return f'"{text}"' if kind < 0.9 or set(text) & set('",\n\r') else text.strip()


def _file(random_, rows, end):
    lines = ["id,text,last"]
    for i in range(rows):
        lines.append(f"{i},{_cell(random_)},{_cell(random_)}")
        if random_.random() < 0.05:
            lines.append("")  # no record
    return end.join(lines) + random_.choice(["", end])


@pytest.mark.parametrize("seed, end", [(1, "\n"), (2, "\r\n"), (3, "\n"), (4, "\n")])
def test_records_equal_multi_line_reading(spark, tmp_path, small_blocks, seed, end):
    random_ = random.Random(seed)
    for i in range(4):
        (tmp_path / f"f{i}.csv").write_bytes(_file(random_, random_.choice([0, 1, 40, 150]), end).encode())
    options = {"header": True, "multiLine": True, "escape": '"', "lineSep": end}
    expected = spark.read.options(**options).csv(str(tmp_path))
    got = read_records(spark, str(tmp_path))
    assert got.columns == expected.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)


def test_a_record_over_many_blocks(spark, tmp_path, small_blocks):
    long = "\n".join(f"line {i}, quoted" for i in range(2000))
    (tmp_path / "a.csv").write_text(f'id,"te\nxt"\n1,"{long}"\n2,"{long}"\n3,plain\n4,"{long}"')
    got = {r[0]: r[1] for r in read_records(spark, str(tmp_path)).collect()}
    assert got == {"1": long, "2": long, "3": "plain", "4": long}
    lines = spark.read.text(f"{tmp_path}/a.csv")
    assert lines.rdd.getNumPartitions() > 50


def test_stray_quotes_fail_where_they_would_join_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,5" pipe\n2,6" pipe\n3,"a ""b"" c"\n')
    with pytest.raises(PySparkException, match="parallel=False"):
        csv_records(spark, str(tmp_path)).collect()
    assert read_csv(spark, str(tmp_path), parallel=False).count() == 3
    (tmp_path / "a.csv").write_text('id,text\n1,5" or 6" pipe\n2,x\n')
    assert [r.text for r in read_csv(spark, str(tmp_path)).orderBy("id").collect()] == ['5" or 6" pipe', "x"]


def test_load_data_types_and_missing_values(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_text('id,x,note\n1,2.5,"a\nb"\n2,NA,none\n3,,"say ""hi"""\n')
    rows = load_data(spark, f"{tmp_path}/a.csv").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 2.5, "a\nb"), (2, None, "none"), (3, None, 'say "hi"')]
    assert [tuple(r) for r in load_data(spark, f"{tmp_path}/a.csv", parallel=False).orderBy("id").collect()] == [tuple(r) for r in rows]
    typed = load_data(spark, f"{tmp_path}/a.csv", schema="id int, x double, note string")
    assert dict(typed.dtypes) == {"id": "int", "x": "double", "note": "string"} and typed.count() == 3
    (tmp_path / "empty.csv").write_text("id,x,note\n")
    assert load_data(spark, f"{tmp_path}/empty.csv").collect() == []


def test_many_blocks_to_a_task(spark, tmp_path, monkeypatch):
    """The query's blocks of 64 KB do not come with a task each, and settings are as before."""
    from textloom.plans import queries

    docs = spark.range(2_000).select(
        F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("all the words "), "id"), 600).alias("text"), F.lit("en").alias("lang")
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    tasks = []
    count = borders._count_quotes
    monkeypatch.setattr(borders, "_count_quotes", lambda lines: tasks.append(lines.rdd.getNumPartitions()) or count(lines))
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.maxPartitionNum"]
    before = [spark.conf.get(k, None) for k in keys]
    read = queries.csv_borders(spark, str(tmp_path))
    assert read.count() == 2_000 and read.where("doc_id % 3 = 0").exceptAll(docs).count() == 0
    # some 20 MB of text
    assert tasks[0] <= 4 * spark.sparkContext.defaultParallelism + 1 < 20e6 / (64 << 10)
    assert [spark.conf.get(k, None) for k in keys] == before
