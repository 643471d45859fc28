"""Dataset versions: fingerprint, difference, and stored versions that are compared by a tree of digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import hash60

# Children of a node of the tree, as a power of two, and buckets at its foot.
FAN_OUT_BITS = 4
BUCKETS = 256


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row that does not depend on the order of rows: count, xor and sum of row hashes.

    Two equal rows cancel out in the xor but not in the sum.
    """
    hashed = df.select(hash60(*[F.col(c) for c in columns]).alias("h"))
    return hashed.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.expr("bit_xor(h)").alias("fingerprint"),
        F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("hash_sum"),
    )


def _per_key(df: DataFrame, key: str, columns: list[str], name: str) -> DataFrame:
    """Count and hash of the rows of each key, combined before the shuffle, so copies of a key never pile up."""
    hashed = df.select(key, hash60(*[F.col(c) for c in columns]).cast("decimal(38,0)").alias("h"))
    return hashed.groupBy(key).agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h")).alias(name))


def version_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``(key, change)`` with change one of added, removed, changed, same."""
    both = _per_key(old, key, columns, "o").join(_per_key(new, key, columns, "n"), key, "full")
    return both.select(key, _change().alias("change"))


def _change() -> Column:
    return (
        F.when(F.col("o").isNull(), "added")
        .when(F.col("n").isNull(), "removed")
        .when(F.col("o") != F.col("n"), "changed")
        .otherwise("same")
    )


def diff_summary(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return version_diff(old, new, key, columns).groupBy("change").agg(F.count(F.lit(1)).alias("n_keys"))


def store_version(df: DataFrame, key: str, columns: list[str], path: str, buckets: int = BUCKETS) -> None:
    """Keep a version's digests at ``path``: one row per key in a folder per bucket, and a tree of digests over them.

    A key's bucket is a hash of it. A bucket's digest covers the number, keys and contents of its keys; a node of the tree
    adds up ``2 ** FAN_OUT_BITS`` digests below it. ``buckets`` is a power of two and has to be the same for versions that
    are to be compared; choose it so that a bucket is a file of some megabytes. The version's shape is written last:
    without it a version is not complete.
    """
    if buckets < 1 or buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")
    digest = hash60(F.col(key).alias(key))
    keys = _per_key(df, key, columns, "d").withColumn("bucket", F.pmod(digest, F.lit(buckets)).cast("int"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.repartition(min(buckets, parts), "bucket").sortWithinPartitions("bucket")
    dealt.write.mode("errorifexists").partitionBy("bucket").parquet(f"{path}/keys")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema.fields)
    stored = df.sparkSession.read.schema(schema).parquet(f"{path}/keys")
    of_key = hash60(F.col(key).alias(key), F.col("d.n"), F.col("d.h")).cast("decimal(38, 0)")
    leaves = stored.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(of_key).alias("h"))
    depth = -(-(buckets.bit_length() - 1) // FAN_OUT_BITS)
    levels = [
        leaves.groupBy(F.shiftright("bucket", FAN_OUT_BITS * (depth - i)).alias("node"))
        .agg(F.sum("n").alias("n"), F.sum(hash60(F.col("bucket"), F.col("n"), F.col("h")).cast("decimal(38, 0)")).alias("h"))
        .withColumn("level", F.lit(i))
        for i in range(depth + 1)
    ]
    tree = reduce(DataFrame.unionByName, levels).coalesce(1).sortWithinPartitions("level", "node")
    tree.write.mode("errorifexists").parquet(f"{path}/tree")
    shape = df.sparkSession.range(1).select(F.lit(buckets).alias("buckets"), F.lit(key).alias("key"), F.lit(schema).alias("schema"))
    shape.write.mode("errorifexists").parquet(f"{path}/shape")


def differing_buckets(spark: SparkSession, old: str, new: str) -> tuple[list[int], int]:
    """Buckets in which two stored versions differ, found from the root of their trees, and the number of buckets.

    Below nodes that agree nothing is looked at. The driver gets nodes that differ, at most as many as there are buckets.
    """
    trees = [spark.read.parquet(f"{path}/tree") for path in (old, new)]
    shapes = [spark.read.parquet(f"{path}/shape").first() for path in (old, new)]
    if shapes[0] != shapes[1]:
        raise ValueError(f"versions of different keys or numbers of buckets: {shapes}")
    buckets = shapes[0].buckets
    depth = -(-(buckets.bit_length() - 1) // FAN_OUT_BITS)
    differ = [0]
    for level in range(depth + 1):
        of_level = (F.col("level") == level) & (F.shiftright("node", FAN_OUT_BITS).isin(differ) | F.lit(level == 0))
        nodes = [t.where(of_level).select("node", F.struct("n", "h").alias(s)) for t, s in zip(trees, "on")]
        unequal = nodes[0].join(nodes[1], "node", "full").where(~F.col("o").eqNullSafe(F.col("n")))
        differ = sorted(r[0] for r in unequal.select("node").collect())
        if not differ:
            break
    return differ, buckets


def stored_changes(spark: SparkSession, old: str, new: str) -> DataFrame:
    """``(key, change)`` for the keys that were added, removed or changed between two stored versions.

    Only the folders of buckets that differ are read. A null is a key like others.
    """
    differ, _ = differing_buckets(spark, old, new)
    shape = spark.read.parquet(f"{new}/shape").first()
    sides = [
        spark.read.schema(shape.schema).parquet(f"{path}/keys").where(F.col("bucket").isin(differ)).withColumnRenamed("d", name)
        for path, name in ((old, "o"), (new, "n"))
    ]
    o, n = sides
    same_key = (o["bucket"] == n["bucket"]) & o[shape.key].eqNullSafe(n[shape.key])
    found = F.when(F.col("o").isNull(), n[shape.key]).otherwise(o[shape.key]).alias(shape.key)
    return o.join(n, same_key, "full").select(found, _change().alias("change")).where("change <> 'same'")
