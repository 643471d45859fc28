"""Vocabulary: fit, token to id, id to text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import words
from textloom.functions.arrays import slices_of
from textloom.operators.dictionary import ship_dictionary
from textloom.operators.ranking import add_position
from textloom.session import new_dir
from textloom.sources.sinks import materialise

PAD_ID = 0
UNKNOWN_ID = 1
FIRST_ID = 2
DEFAULT_SIZE = 30_000
# Words of a vocabulary that is sent to the workers' memory, at most.
MOST_SHIPPED = 2_000_000
# Items that a worker looks up at once; of a batch with more, some rows are taken after another.
ITEMS_AT_ONCE = 1 << 18

# the latest lookup table of this worker, by name
_index: dict[str, dict] = {}


def fit_vocabulary(df: DataFrame, text: str = "text", size: int = DEFAULT_SIZE) -> DataFrame:
    """The ``size`` most frequent words, ``(token, n, id)``; ids from 2 by falling count, then by word.

    Counts combine before the shuffle. How many words have each count tells where the limit falls, and rarer words are
    dropped before anything is sorted; the rest is range-sorted, so no task has more than its range, however many words
    have the lowest count. ``materialise`` the result before encoding with it, which reads it twice.
    """
    counts = df.select(F.explode(words(F.col(text))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts, new_dir(df.sparkSession, "word-counts"))
    # one row per distinct count
    levels = counts.groupBy("n").agg(F.count(F.lit(1)).alias("at_level"))
    higher = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.select("n", F.coalesce(F.sum("at_level").over(higher), F.lit(0)).alias("before"))
    lowest = levels.where(F.col("before") < size).agg(F.min("n")).first()[0]
    if lowest is None:
        return counts.where(F.lit(False)).select("token", "n", F.lit(0).alias("id"))
    falling = counts.where(F.col("n") >= lowest).withColumn("__falling", -F.col("n"))
    ranked = add_position(falling, ["__falling", "token"]).where(F.col("position") <= size)
    return ranked.select("token", "n", (F.col("position") + (FIRST_ID - 1)).cast("int").alias("id"))


def encode(
    df: DataFrame, vocabulary: DataFrame, tokens: str, into: str = "input_ids", lookup: str = "ship"
) -> DataFrame:
    """Replace words by their ids, 1 where the vocabulary does not know the word; a null array gives an empty one.

    Every row comes back, whatever its key. ``lookup="ship"`` sends a vocabulary of up to ``MOST_SHIPPED`` words to the
    workers' memory. ``lookup="map"`` is for larger ones: workers map files of it, which take disk and no memory. No row
    is shuffled either way. ``lookup="join"`` joins the vocabulary, for one that fits no machine's disk.
    """
    return _looked_up(df, vocabulary.select(F.col("token").alias("from"), F.col("id").alias("to")), tokens, into, lookup, UNKNOWN_ID)


def decode(df: DataFrame, vocabulary: DataFrame, ids: str, into: str = "decoded", lookup: str = "ship") -> DataFrame:
    """Words of the ids joined by spaces, special ids (below 2) and unknown ones left out; ``lookup`` as in ``encode``."""
    table = vocabulary.where(F.col("id") >= FIRST_ID).select(F.col("id").alias("from"), F.col("token").alias("to"))
    found = _looked_up(df, table, ids, "__words", lookup, None)
    # concat_ws leaves nulls out
    return found.withColumn(into, F.concat_ws(" ", "__words")).drop("__words")


def _looked_up(df: DataFrame, table: DataFrame, column: str, into: str, lookup: str, missing: object) -> DataFrame:
    if lookup == "ship":
        return _shipped(df, table, column, into, missing)
    if lookup == "map":
        return _mapped(df, table, column, into, missing)
    if lookup == "join":
        return _joined(df, table, column, into, missing)
    raise ValueError(f"lookup is 'ship', 'map' or 'join', not {lookup!r}")


def _shipped(df: DataFrame, table: DataFrame, column: str, into: str, missing: object) -> DataFrame:
    """Look up the distinct items of some rows at a time in an index that a worker builds once."""
    if table.limit(MOST_SHIPPED + 1).count() > MOST_SHIPPED:
        raise ValueError(f"more than {MOST_SHIPPED} words to ship: use lookup='map' or lookup='join'")
    shipped = df.sparkSession.sparkContext.broadcast(table.toArrow().combine_chunks())
    kind = table.schema["to"].dataType.simpleString()
    name = uuid.uuid4().hex

    @F.arrow_udf(f"array<{kind}>")
    def look_up(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # imported here, so that it is the worker's own and outlives the task
        from textloom.operators.vocabulary import _index

        if name not in _index:
            known = shipped.value
            _index.clear()
            _index[name] = dict(zip(known.column("from").to_pylist(), known.column("to").to_pylist()))
        index, to = _index[name], shipped.value.schema.field("to").type
        for lists in _some_at_once(batches):
            coded = pc.dictionary_encode(lists.flatten(), null_encoding="encode")
            yield _as_lists(lists, pa.array([index.get(item, missing) for item in coded.dictionary.to_pylist()], to), coded)

    return df.withColumn(into, look_up(F.col(column)))


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def _some_at_once(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """A batch has a fixed number of rows, however long; its parts have a fixed number of items."""
    for lists in batches:
        yield from slices_of(lists, _sizes(lists), ITEMS_AT_ONCE)


def _as_lists(lists: pa.Array, values: pa.Array, coded: pa.DictionaryArray) -> pa.Array:
    """Lists of the values that the items of ``lists`` were found to have; a null list becomes an empty one."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(_sizes(lists))]), pa.int32())
    return pa.ListArray.from_arrays(offsets, values.take(coded.indices))


def _mapped(df: DataFrame, table: DataFrame, column: str, into: str, missing: object) -> DataFrame:
    """Look up the distinct items of some rows at a time in dictionary files that a worker maps into memory."""
    to_ids = table.schema["to"].dataType.simpleString() != "string"
    names = ("token", "id") if to_ids else ("id", "token")
    name = ship_dictionary(table.toDF(*names))

    @F.arrow_udf("array<int>" if to_ids else "array<string>")
    def look_up(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # imported here, so that the open files are the worker's own and outlive the task
        from textloom.operators.dictionary import opened

        known = opened(name)
        for lists in _some_at_once(batches):
            coded = pc.dictionary_encode(lists.flatten(), null_encoding="encode")
            items = coded.dictionary
            there = np.flatnonzero(items.is_valid().to_numpy(zero_copy_only=False))
            asked = items.take(pa.array(there))
            if to_ids:
                found = np.full(len(items), missing, np.int32)
                found[there] = known.ids_of(asked, missing)
                values = pa.array(found)
            else:
                words = known.words_of(asked.to_numpy(zero_copy_only=False).astype(np.int64))
                places = np.zeros(len(items), np.int64)
                places[there] = np.arange(len(there))
                values = words.take(pa.array(places, mask=~items.is_valid().to_numpy(zero_copy_only=False)))
                values = values.cast(pa.string())
            yield _as_lists(lists, values, coded)

    return df.withColumn(into, look_up(F.col(column)))


def _joined(df: DataFrame, table: DataFrame, column: str, into: str, missing: object) -> DataFrame:
    """The same by a join, one row per distinct item of each distinct array; rows find theirs by the array's digest."""
    kind = table.schema["to"].dataType.simpleString()
    digest: Column = F.sha2(F.to_json(F.struct(F.col(column).alias("a"))), 256)
    marked = df.withColumn("__digest", digest)
    arrays = marked.groupBy("__digest").agg(F.first(column).alias("__items"))
    places = (
        arrays.select("__digest", F.posexplode("__items").alias("pos", "from"))
        .groupBy("__digest", "from")
        .agg(F.collect_list("pos").alias("places"))
    )
    found = places.join(table, "from", "left")
    value = F.coalesce("to", F.lit(missing).cast(kind))
    rows = found.select("__digest", F.explode("places").alias("pos"), value.alias("value"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"])
    results = rows.groupBy("__digest").agg(ordered.alias(into))
    kept = [F.col(f"`{c}`") for c in df.columns if c != into]
    return marked.join(results, "__digest", "left").select(
        *kept, F.coalesce(results[into], F.array().cast(f"array<{kind}>")).alias(into)
    )
