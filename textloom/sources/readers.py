"""Table readers: one entry point that picks the reader from the path."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The texts a CSV cell may hold for "missing".
NA_VALUES = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Words in a file name that tell which split the file belongs to.
SPLIT_WORDS = {
    "train": ("train", "training"),
    "validation": ("validation", "valid", "dev", "val"),
    "test": ("test", "testing", "eval", "evaluation"),
}

_INTEGER = r"^[+-]?[0-9]+$"
_DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def load_data(
    spark: SparkSession,
    data_path: str,
    split: str | None = None,
    cache_dir: str | None = None,
    schema: T.StructType | str | None = None,
    multi_line: bool = True,
    label_splits: bool = False,
    parallel: bool = True,
) -> DataFrame:
    """Read a table from a file, a directory or the catalog.

    The suffix decides (case-sensitive): ``.csv``, ``.json`` or ``.jsonl``, ``.parquet``; anything else is a directory
    or, failing that, a table or view name. ``split`` selects rows for every source but CSV; None means all rows. Pass
    ``schema`` for big CSV and JSON inputs: finding it costs one more pass. ``cache_dir`` keeps a Parquet copy that
    later jobs read as long as the source files have not changed. Of Parquet files, and of JSON with a ``schema``, only
    new and changed files are copied; others are copied whole, as one file may change the types of all. Big CSV files are cut into tasks, as ``read_csv`` says
    (``multi_line``, ``parallel``). ``label_splits`` adds the column ``split``, told by the names of the
    files, to a directory of files without it.
    """
    if cache_dir is not None:
        from textloom.sources.sinks import cached_copy, cached_files

        build = lambda: load_data(spark, data_path, split, None, schema, multi_line, label_splits, parallel)
        found = _format_of(spark, data_path)
        if found == "parquet" or (found in ("json", "jsonl") and schema is not None):
            return cached_files(spark, data_path, cache_dir, build, split, label_splits)
        return cached_copy(spark, data_path, cache_dir, build, split, schema, multi_line, label_splits)
    if data_path.endswith(".csv"):
        return read_csv(spark, data_path, schema=schema, multi_line=multi_line, parallel=parallel)
    if data_path.endswith(".jsonl"):
        df = _with_schema(spark, schema).json(data_path)
    elif data_path.endswith(".json"):
        # one record or one array per file, over any number of lines
        df = _with_schema(spark, schema).option("multiLine", True).json(data_path)
    elif data_path.endswith(".parquet"):
        df = _with_schema(spark, schema).parquet(data_path)
    elif "/" not in data_path and spark.catalog.tableExists(data_path):
        df = spark.table(data_path)
    else:
        df = _read_directory(spark, data_path, schema, split is not None or label_splits, multi_line, parallel)
    return df if split is None else select_split(df, split)


def _with_schema(spark: SparkSession, schema: T.StructType | str | None):
    return spark.read if schema is None else spark.read.schema(schema)


def select_split(df: DataFrame, split: str) -> DataFrame:
    """Rows of one split; prunes partitions where the table is stored ``partitionBy("split")``.

    A table without a ``split`` column is one split, called ``train``.
    """
    if "split" in df.columns:
        return df.where(F.col("split") == split)
    if split == "train":
        return df
    raise ValueError(f"unknown split {split!r}: the table has no split column, so all of it is 'train'")


def _formats_in(spark: SparkSession, path: str) -> list[str]:
    """Formats of the files below a path, told by their suffixes (listing only, no content is read)."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    suffix = F.regexp_extract("path", r"\.(csv|jsonl|json|parquet)(?:\.[a-z0-9]+)?$", 1)
    return sorted(r[0] for r in listing.select(suffix).distinct().collect() if r[0])


def _format_of(spark: SparkSession, data_path: str) -> str | None:
    """The format that ``load_data`` reads a path as; None for a table, or files of several formats or none."""
    for suffix in ("csv", "jsonl", "json", "parquet"):
        if data_path.endswith(f".{suffix}"):
            return suffix
    if "/" not in data_path and spark.catalog.tableExists(data_path):
        return None
    found = _formats_in(spark, data_path)
    return found[0] if len(found) == 1 else None


def _read_directory(spark: SparkSession, path: str, schema, labelled: bool, multi_line: bool, parallel: bool) -> DataFrame:
    """Directory of files of one format."""
    found = _formats_in(spark, path)
    if len(found) != 1:
        raise ValueError(f"expected files of one format in {path}, found {found or 'none'}")
    if found[0] == "csv":
        # the names of the files, which tell the split, are there for Spark's own readers only
        df = read_csv(spark, path, schema=schema, multi_line=multi_line, parallel=parallel and not labelled)
    elif found[0] == "parquet":
        df = _with_schema(spark, schema).parquet(path)
    else:
        # text written by Spark is one record per line whatever the suffix
        df = _with_schema(spark, schema).json(path)
    if labelled and "split" not in df.columns:
        return df.withColumn("split", _split_of_file(F.col("_metadata.file_name")))
    return df


def _split_of_file(name: Column) -> Column:
    """Split told by a word in the file name, ``train`` where there is none; Spark prunes files by it."""
    result = F.lit("train")
    for split, names in SPLIT_WORDS.items():
        result = F.when(name.rlike(rf"(^|[ ._/0-9-])({'|'.join(names)})([ ._/0-9-]|$)"), F.lit(split)).otherwise(result)
    return result


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    na_values: tuple[str, ...] = NA_VALUES,
    multi_line: bool = True,
    parallel: bool = True,
) -> DataFrame:
    """CSV with a header, doubled quotes, quoted line breaks and NA markers.

    Without a schema, types are found after the NA markers are gone, in one aggregation over the records: whole numbers,
    decimals, booleans, else text.

    Quoted line breaks do not keep big files from being read by many tasks: the records are cut out of blocks and stored
    once in the shared folder. This needs quotes that stand only around cells or doubled inside them, and fails where
    others would join lines; ``parallel=False`` reads each file in one task, as Spark does with ``multiLine``.
    ``multi_line=False`` is for data without quoted line breaks, which Spark cuts by itself.
    """
    if multi_line and parallel:
        from textloom.sources.borders import read_records

        raw = read_records(spark, path)
    else:
        raw = (
            spark.read.option("header", True)
            .option("multiLine", multi_line)
            .option("escape", '"')
            .option("enforceSchema", False)
            .csv(path)
        )
    if schema is not None:
        fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
        types = {f.name: f.dataType for f in fields}
    else:
        types = _find_types(raw, na_values)
    return raw.select(
        [_without_na(F.col(f"`{c}`"), na_values).cast(types.get(c, T.StringType())).alias(c) for c in raw.columns]
    )


def _without_na(value: Column, na_values: tuple[str, ...]) -> Column:
    return F.when(~value.isin(list(na_values)), value)


def _find_types(raw: DataFrame, na_values: tuple[str, ...]) -> dict[str, T.DataType]:
    checks = []
    for i, c in enumerate(raw.columns):
        v = F.trim(_without_na(F.col(f"`{c}`"), na_values))
        checks += [
            F.bool_and(v.rlike(_INTEGER)).alias(f"whole_{i}"),
            F.bool_and(F.when(v.isNotNull(), v.try_cast("bigint").isNotNull())).alias(f"fits_{i}"),
            F.max(F.length(v)).alias(f"width_{i}"),
            F.bool_and(v.rlike(_DECIMAL)).alias(f"decimal_{i}"),
            F.bool_and(F.lower(v).isin("true", "false")).alias(f"boolean_{i}"),
        ]
    if not checks:
        return {}
    row = raw.agg(*checks).first()
    types: dict[str, T.DataType] = {}
    for i, c in enumerate(raw.columns):
        if row[f"whole_{i}"] and row[f"fits_{i}"]:
            types[c] = T.LongType()
        elif row[f"whole_{i}"]:
            # no digit may get lost: a wide decimal, and text beyond that
            types[c] = T.DecimalType(38, 0) if row[f"width_{i}"] <= 38 else T.StringType()
        elif row[f"decimal_{i}"]:
            types[c] = T.DoubleType()
        elif row[f"boolean_{i}"]:
            types[c] = T.BooleanType()
        else:
            types[c] = T.StringType()
    return types


def union_splits(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One table out of several, each row marked with the name of its split; columns are matched by name."""
    result = None
    for name, df in tables.items():
        part = df.withColumn("split", F.lit(name))
        result = part if result is None else result.unionByName(part, allowMissingColumns=True)
    if result is None:
        raise ValueError("no tables given")
    return result

