"""CSV records with quoted line breaks, cut out of big files by many tasks.

Lines are read in blocks by all tasks. A line begins inside a quoted cell if the quotes before it in its file are odd in
number, so it takes one count per block, and a prefix sum over the blocks, to know where records begin. Each task then
joins the lines of its records; of a record that crosses a block's border the pieces are grouped by the block in which it
begins. What comes out are records for Spark's own CSV parser.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.session import new_dir
from textloom.sources.positions import BLOCK, FILE, MOST_SENT, SERIAL, with_blocks
from textloom.sources.sinks import materialise

MESSAGE = "quotes outside quoted cells hide where records end: read this file with parallel=False: "


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines, in blocks; a carriage return stays where it is."""
    return with_blocks(spark.read.option("lineSep", "\n").text(path))


def _count_quotes(lines: DataFrame) -> DataFrame:
    """Per block: whether it begins inside a quoted cell, and the block in which the record of its first line begins."""
    odd = ((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2).cast("int")
    counted = lines.select(FILE, BLOCK, SERIAL, odd.alias("odd")).groupBy(FILE, BLOCK)
    blocks = counted.agg(F.sum("odd").alias("odd"), F.max_by("odd", SERIAL).alias("last"))
    blocks = materialise(blocks, new_dir(lines.sparkSession, "blocks"))
    along = Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    begins = F.coalesce(F.sum("odd").over(along), F.lit(0)) % 2 == 1
    marked = blocks.select(FILE, BLOCK, begins.alias("inside"), (F.col("odd") - F.col("last") > 0).alias("inner"))
    starts = F.when(~F.col("inside") | F.col("inner"), F.col(BLOCK))
    owner = F.when(F.col("inside"), F.last(starts, True).over(along)).otherwise(F.col(BLOCK))
    return marked.select(FILE, BLOCK, "inside", owner.alias("owner"))


_PIECE = ["record", "header", "file", "owner", "part"]
_KINDS = [pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]


@dataclass
class _Block:
    """What a task knows of the block it goes through."""

    file: int
    start: int
    owner: int  # the block in which the record begins that is open now
    odd: int  # whether the quotes so far are odd in number
    header: bool  # whether that record is the first of its file
    lines: list[str] = field(default_factory=list)  # of that record, so far

    def piece(self, lines: list[str]) -> pa.RecordBatch:
        """A record up to here; ``owner`` is null if all of it is in this block."""
        open_ = self.odd or self.owner != self.start
        row = ["\n".join(lines), self.header, self.file, self.owner if open_ else None, self.start]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _KINDS)], _PIECE)

    def take(self, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        odd = (self.odd + np.cumsum(pc.count_substring(lines, '"').to_numpy())) % 2
        ends = (np.flatnonzero(odd == 0) + 1).tolist()
        if ends:
            self.odd = 0
            yield self.piece(self.lines + lines.slice(0, ends[0]).to_pylist())
            self.owner, self.header = self.start, False
            texts = lines.slice(ends[0], ends[-1] - ends[0])
            if len(texts) >= len(ends):  # some have several lines
                texts = pa.array(["\n".join(lines.slice(i, j - i).to_pylist()) for i, j in zip(ends, ends[1:])], pa.string())
            columns = [texts, pa.array(np.zeros(len(texts), bool)), *[pa.nulls(len(texts), pa.int64())] * 3]
            yield pa.RecordBatch.from_arrays(columns, _PIECE)
        self.lines = (self.lines if not ends else []) + lines.slice(ends[-1] if ends else 0).to_pylist()
        self.odd = int(odd[-1])

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.lines:
            yield self.piece(self.lines)


def _cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records, and pieces of those that cross a border, block by block."""
    block = None
    for frame in frames:
        lines = pc.fill_null(frame.column("value"), "")
        files, starts = (frame.column(c).to_numpy() for c in (FILE, BLOCK))
        changes = np.flatnonzero((files[1:] != files[:-1]) | (starts[1:] != starts[:-1])) + 1
        for first, end in zip([0, *changes.tolist()], [*changes.tolist(), len(lines)]):
            if first == end:
                continue
            if block is None or (block.file, block.start) != (files[first], starts[first]):
                if block is not None:
                    yield from block.close()
                file, start, inside = int(files[first]), int(starts[first]), frame.column("inside")[first].as_py()
                block = _Block(file, start, frame.column("owner")[first].as_py(), int(inside), start == 0)
            yield from block.take(lines.slice(first, end - first))
    if block is not None:
        yield from block.close()


def _well_formed(record: Column) -> Column:
    """Whether all quotes stand around cells or doubled inside them."""
    rest = F.regexp_replace(record, '"[^"]*"', "\x01")  # a quoted cell becomes one mark or several
    return ~rest.contains('"') & ~rest.rlike("[^,\x01]\x01|\x01[^,\x01\r]|\x01\r.")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``(record, header)``: the text of each record of the CSV files, ``header`` marking the first of each file.

    Cells are quoted as RFC 4180 has it: a quote inside a quoted cell is doubled, and there are none elsewhere. Where
    stray quotes would join lines that do not belong together the query fails; those within a line do no harm.
    Blank lines are no records.
    """
    lines = _lines(spark, path)
    blocks = _count_quotes(lines)
    if blocks.count() > MOST_SENT:
        raise ValueError(f"more than {MOST_SENT} blocks: raise spark.sql.files.maxPartitionBytes")
    # a join with a sent table leaves the lines in their order
    pieces = lines.join(F.broadcast(blocks), [FILE, BLOCK]).select("value", FILE, BLOCK, "inside", "owner")
    cut = pieces.mapInArrow(_cut, "record string, header boolean, file long, owner long, part long")
    cut = materialise(cut, new_dir(spark, "records"))
    whole = cut.where("owner IS NULL").select("record", "header")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("part", "record"))), lambda p: p["record"])
    joined = cut.where("owner IS NOT NULL").groupBy("file", "owner")
    joined = joined.agg(F.array_join(texts, "\n").alias("record"), F.bool_or("header").alias("header"))
    records = whole.unionByName(joined.select("record", "header"))
    several = F.col("record").contains("\n")
    sound = F.when(several, F.when(_well_formed(F.col("record")), F.lit(True)).otherwise(_stray(path))).otherwise(F.lit(True))
    return records.where(F.trim("record", F.lit("\r")) != "").where(sound)


def _stray(path: str) -> Column:
    return F.raise_error(F.lit(MESSAGE + path)).cast("boolean")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All columns of the CSV files at ``path`` as text, named by the header of the first file, through Spark's parser."""
    names = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    records = csv_records(spark, path).where("NOT header").select(F.regexp_replace("record", "\r$", "").alias("r"))
    cells = F.from_csv("r", schema.simpleString()[7:-1].replace(":", " "), {"escape": '"'})
    return records.select(cells.alias("c")).select([F.col(f"c.c{i}").alias(name) for i, name in enumerate(names)])
