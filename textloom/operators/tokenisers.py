"""User-supplied tokeniser files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.arrays import slices_of

# Bytes of text that a worker tokenises at once: the tokeniser keeps some hundred bytes of notes per token.
BYTES_AT_ONCE = 1 << 20

_loaded: dict[str, object] = {}


def _ids(tokeniser, batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Ids of the texts; a batch has a fixed number of rows, however long, so some of them are taken after another."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False)
        for texts in slices_of(batch, sizes, BYTES_AT_ONCE):
            encodings = tokeniser.encode_batch_fast([t or "" for t in texts.to_pylist()])
            yield pa.array([e.ids for e in encodings], pa.list_(pa.int32()))


def tokenise_with_file(
    df: DataFrame, tokeniser_file: str, text: str = "text", max_length: int | None = None
) -> DataFrame:
    """Add ``input_ids`` by a tokeniser definition (JSON of the ``tokenizers`` package), some texts at a time.

    The definition is read once and shipped to the workers, each of which builds the tokeniser once.
    """
    definition = df.sparkSession.read.text(tokeniser_file, wholetext=True).first()[0]
    shipped = df.sparkSession.sparkContext.broadcast(definition)
    name = uuid.uuid4().hex

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from tokenizers import Tokenizer

        # imported here, so that what is loaded is the worker's own and outlives the task
        from textloom.operators.tokenisers import _ids, _loaded

        if name not in _loaded:
            tokeniser = Tokenizer.from_str(shipped.value)
            tokeniser.no_padding()
            if max_length is None:
                tokeniser.no_truncation()
            else:
                tokeniser.enable_truncation(max_length)
            _loaded.clear()  # a reused worker keeps the latest one only
            _loaded[name] = tokeniser
        yield from _ids(_loaded[name], batches)

    return df.withColumn("input_ids", run(F.col(text).cast("string")))
