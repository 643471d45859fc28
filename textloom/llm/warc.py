"""WARC archives with an index: written by all tasks, read back by sorted, coalesced byte ranges.

Archives are files of gzip members, one per record. The index table says where each record lies, so that a selection of
records is read without going through whole archives.
"""

from __future__ import annotations

import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import new_dir, shared_dir
from textloom.sources import materialise

LEAST_BYTES = 100
GAP = 64 << 10
RANGE = 8 << 20
FILE_BYTES = 256 << 20
DATE = "2024-01-01T00:00:00Z"
_INDEX = ("page_id", "url", "record_type", "refers_to", "digest", "file", "offset", "length")


# Names that Spark has for file systems which Arrow calls otherwise, and those that Arrow opens.
RENAMED = {"s3a": "s3", "s3n": "s3"}
KNOWN = ("file", "s3", "gs", "gcs", "hdfs", "viewfs", "abfs", "abfss")


def resolved(spark: SparkSession, folder: str) -> str:
    """The folder with its file system, as Spark's configuration has it, for all tasks alike.

    A folder without one belongs to the default file system, as in Spark. On a cluster it must not be each machine's own
    disk, unless it lies in the shared folder that the cluster names.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    local = spark.sparkContext.master.startswith("local") or not whole.startswith("file:")
    if not local and not folder.startswith(("file:", shared_dir(spark) + "/")):
        raise ValueError(f"{folder} is a folder of each machine's own: name its file system, or leave it to spark.checkpoint.dir")
    arrow_uri(whole)
    return whole


def arrow_uri(path: str) -> str:
    """How Arrow spells a location that Spark has qualified."""
    scheme, _, rest = path.partition(":")
    if scheme == "dbfs":  # mounted on every machine
        return "file:///dbfs/" + rest.lstrip("/")
    scheme = RENAMED.get(scheme, scheme)
    if scheme not in KNOWN:
        raise ValueError(f"archives cannot be written to {scheme}: of {path}; use one of {', '.join(KNOWN)}")
    return f"file:///{rest.lstrip('/')}" if scheme == "file" else f"{scheme}:{rest}"


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(arrow_uri(path))


def decide(pages: DataFrame, html: str = "html") -> DataFrame:
    """``(page_id, url, payload, digest, record_type, refers_to)``: the first of equal payloads answers, others revisit.

    Payloads are the html in UTF-8, empty for null. Of equal ones of at least ``LEAST_BYTES`` the smallest ``page_id`` is
    the response; rows that share that id are all responses, and so are rows with a null id. Only digests that occur
    more than once are joined back, one row each.
    """
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    large = F.octet_length(payload) >= LEAST_BYTES
    shared = pages.where(large).select("page_id", F.sha2(payload, 256).alias("digest")).groupBy("digest")
    shared = shared.agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first")).where("n > 1")
    joined = rows.join(shared.select("digest", "first"), "digest", "left")
    again = F.coalesce(F.col("page_id") > F.col("first"), F.lit(False))
    return joined.select(
        "page_id",
        "url",
        F.when(~again, F.col("payload")).alias("payload"),
        "digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


def _record(page_id, url: str | None, payload: bytes | None, digest: str, kind: str, refers_to) -> bytes:
    """One record; header values cannot break lines."""
    uri = " ".join((url or "").split())
    lines = [
        b"WARC/1.1",
        b"WARC-Type: " + kind.encode(),
        f"WARC-Record-ID: <urn:page:{page_id}>".encode(),
        b"WARC-Date: " + DATE.encode(),
        b"WARC-Target-URI: " + uri.encode("utf-8", "replace"),
        f"WARC-Payload-Digest: sha256:{digest}".encode(),
    ]
    if kind == "revisit":
        lines.append(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>".encode())
    body = payload or b""
    lines += [b"Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}".encode(), b"", body, b"", b""]
    return b"\r\n".join(lines)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def write_archives(decided: DataFrame, folder: str) -> DataFrame:
    """Write the records below ``folder/archives`` and the index to ``folder/index``; the index.

    A task writes files of its own, of about ``FILE_BYTES`` each, under a name that no other attempt uses, and returns
    their index rows. Spark commits the index of one attempt per task, so a repeated attempt leaves at most a file that
    no index row names.
    """
    kind = decided.schema["page_id"].dataType.simpleString()
    folder = resolved(decided.sparkSession, folder)

    def write(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = _opened(f"{folder}/archives")
        files.create_dir(top, recursive=True)
        sink, at, name = None, 0, ""
        try:
            for batch in frames:
                where = []
                for row in batch.select(["page_id", "url", "payload", "digest", "record_type", "refers_to"]).to_pylist():
                    if sink is None or at >= FILE_BYTES:
                        if sink is not None:
                            sink.close()
                        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                        sink, at = files.open_output_stream(posixpath.join(top, name), compression=None), 0
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    packed = packer.compress(_record(*row.values())) + packer.flush()
                    sink.write(packed)
                    where.append((name, at, len(packed)))
                    at += len(packed)
                columns = [batch.column(c) for c in _INDEX[:5]]
                columns += [pa.array(c, t) for c, t in zip(zip(*where), (pa.string(), pa.int64(), pa.int64()))]
                if where:
                    yield pa.RecordBatch.from_arrays(columns, list(_INDEX))
        finally:  # also where the task fails
            if sink is not None:
                sink.close()

    schema = f"page_id {kind}, url string, record_type string, refers_to {kind}, digest string, "
    schema += "file string, offset long, length long"
    return materialise(decided.mapInArrow(write, schema), f"{folder}/index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of the selected index rows: ``(page_id, url, record_type, digest, refers_to, payload)``.

    All but the two ids, which the index knows with their type, come out of the archives; ``digest`` is what the record
    says of its payload, which for a revisit lies in another record. Rows are sorted by file and offset; neighbours no more than ``GAP`` bytes apart are read at once, up to ``RANGE``
    bytes at a time.
    """
    kind = index.schema["page_id"].dataType.simpleString()
    folder = resolved(index.sparkSession, folder)

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = _opened(f"{folder}/archives")
        opened: tuple[str, pa.NativeFile] | None = None
        for batch in frames:
            rows = batch.select(["file", "offset", "length", "page_id", "refers_to"]).to_pylist()
            i = 0
            while i < len(rows):
                j, start = i, rows[i]["offset"]
                end = start + rows[i]["length"]
                while (
                    j + 1 < len(rows)
                    and rows[j + 1]["file"] == rows[i]["file"]
                    and rows[j + 1]["offset"] - end <= GAP
                    and rows[j + 1]["offset"] + rows[j + 1]["length"] - start <= RANGE
                ):
                    j += 1
                    end = max(end, rows[j]["offset"] + rows[j]["length"])
                if opened is None or opened[0] != rows[i]["file"]:
                    if opened is not None:
                        opened[1].close()
                    opened = rows[i]["file"], files.open_input_file(posixpath.join(top, rows[i]["file"]))
                block = opened[1].read_at(end - start, start)
                found = []
                for row in rows[i : j + 1]:
                    begin = row["offset"] - start
                    headers, payload = parse(zlib.decompress(block[begin : begin + row["length"]], 31))
                    said = headers["WARC-Payload-Digest"].partition(":")[2]
                    found.append((headers["WARC-Target-URI"], headers["WARC-Type"], said, payload))
                kinds = (pa.string(), pa.string(), pa.string(), pa.binary())
                columns = [pa.array(c, t) for c, t in zip(zip(*found), kinds)]
                ids, referred = (batch.column(c).slice(i, j + 1 - i) for c in ("page_id", "refers_to"))
                yield pa.RecordBatch.from_arrays([ids, *columns[:3], referred, columns[3]], names)
                i = j + 1
        if opened is not None:
            opened[1].close()

    names = ["page_id", "url", "record_type", "digest", "refers_to", "payload"]
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = index.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    schema = f"page_id {kind}, url string, record_type string, digest string, refers_to {kind}, payload binary"
    return ordered.mapInArrow(read, schema)


def archive(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """Write all pages; the index and the folder, by default a new one in the shared folder.

    ``pages`` has ``page_id``, ``url`` and ``html``, each of which may be null; other columns are ignored. Repeated rows
    each get a record. A table without rows gives an empty index. The folder may be on any file system that Spark and
    Arrow both know, by the name that Spark has for it (``s3a://``); one without a name is on Spark's default one.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or new_dir(spark, "warc")
    return write_archives(decide(pages), folder), folder


def with_full_payload_facts(records: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of what was read, revisits by their response.

    Length and digest are worked out from the payloads as read; a revisit has those of the response that it refers to.
    """
    digest = F.sha2("payload", 256).alias("payload_digest")
    facts = records.select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), digest, "record_type", "refers_to", "digest"
    )
    facts = materialise(facts, new_dir(records.sparkSession, "records"))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = facts.where("record_type = 'response'")
    referred = responses.select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    revisits = facts.where("record_type = 'revisit'").select(
        "page_id", F.col("digest").alias("payload_digest"), "record_type", "refers_to"
    )
    return responses.select(names).unionByName(revisits.join(referred, ["refers_to", "payload_digest"], "left").select(names))
