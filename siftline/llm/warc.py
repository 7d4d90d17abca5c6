"""WARC revisit resolution: archives without repeated payloads, with fresh headers.

1. Headers. Every record is reduced to a header row (id, url, date, payload digest);
   only these are shuffled, by digest.
2. Originals. Of the responses with one digest the first, by date, then id and url,
   is the original; the others become revisit records. Revisit records of the input
   join the original of their digest; where there is none they stay unresolved and
   keep the reference they came with.
3. Payloads. A payload whose digest occurs once goes straight from its scan to its
   archive. Only payloads of repeated digests are combined, one for each digest.
4. Archives. Every task writes gzip archives, one member a record, of at most
   ``max_bytes``: first under a temporary name, then renamed, so that a task that runs
   again replaces its own files. Record ids, lengths, digests and references are written anew.

Defined results
---------------
* payloads are bytes, whatever their encoding; null payloads of responses are empty payloads; equal payloads of any length are one digest group.
* rows that repeat id, url, date and payload are one capture and are written once.
* only responses and resources are originals or become revisits; of captures of one payload the original keeps its type, and a null type is a response. Requests, metadata and all other records pass through with their blocks, repeated ones too.
* null ids, urls and dates: their header lines are left out (dates: ``DEFAULT_DATE``); nulls sort last.
* control characters and blanks in urls and ids are percent-encoded.
* columns other than those named are not archived. An empty table gives no archive and an empty result.
"""

from __future__ import annotations

import gzip
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, durable, file_system, made, qualified, require, shared_dir

DEFAULT_DATE = "1970-01-01T00:00:00Z"
RECORD = "source_id string, type string, url string, date string, digest string, payload binary, refers_to string, refers_to_uri string, refers_to_date string"
_NAMES = [x.split()[0] for x in RECORD.split(", ")]


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date_col: str | None = None) -> DataFrame:
    """Rows of RECORD for a table of pages: each is a response."""
    require(pages, id_col, url_col, payload_col)
    none = F.lit(None).cast("string")
    date = F.date_format(col(date_col).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'") if date_col else none
    given = col(payload_col) if isinstance(pages.schema[payload_col].dataType, T.BinaryType) else F.encode(col(payload_col).cast("string"), "UTF-8")
    payload = F.coalesce(given, F.lit("").cast("binary"))
    return pages.select(
        col(id_col).cast("string").alias("source_id"), F.lit("response").alias("type"), col(url_col).cast("string").alias("url"), date.alias("date"),
        F.concat(F.lit("sha1:"), F.sha1(payload)).alias("digest"), payload.alias("payload"), none.alias("refers_to"), none.alias("refers_to_uri"), none.alias("refers_to_date"),
    )


def record_id(digest: Column, *parts: Column) -> Column:
    """A urn:uuid that depends on the record alone."""
    h = F.md5(F.concat_ws(" ", digest, *[F.coalesce(p, F.lit("")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def resolve(records: DataFrame) -> DataFrame:
    """Rows of RECORD with ``record_id``, in which every payload occurs once and revisits name their originals."""
    require(records, *_NAMES)
    records = records.select(*_NAMES).withColumn("type", F.coalesce("type", F.lit("response"))).withColumn("payload", F.when(F.col("type") != "revisit", F.coalesce("payload", F.lit("").cast("binary"))))
    records = records.withColumn("digest", F.coalesce("digest", F.concat(F.lit("sha1:"), F.sha1("payload"))))
    others = records.where(~F.col("type").isin("response", "resource", "revisit"))
    records = records.where(F.col("type").isin("response", "resource", "revisit"))
    is_revisit = F.col("type") == "revisit"
    key = ["source_id", "url", "date"]
    order = F.struct(*[x for k in ("date", "source_id", "url") for x in (F.col(k).isNull().alias(k + "_none"), F.col(k).alias(k))], "type")
    headers = records.select(*key, "digest", "type", is_revisit.alias("revisit"), "refers_to", "refers_to_uri", "refers_to_date")
    groups = durable(
        headers.where(~F.col("revisit")).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n"))
        .join(headers.where("revisit AND digest IS NOT NULL").select("digest").distinct().withColumn("asked", F.lit(True)), "digest", "left").where("n > 1 OR asked")
        .select("digest", "n", *[F.col("first")[k].alias("o_" + k) for k in [*key, "type"]])
    )
    o_id = record_id(F.col("digest"), F.col("o_source_id"), F.col("o_url"), F.col("o_date"), F.lit("response"))
    originals = groups.select("digest", "n", *["o_" + k for k in [*key, "type"]], o_id.alias("o_id"))

    repeated = originals.where("n > 1").select("digest")
    alone = records.where(~is_revisit).join(repeated, "digest", "left_anti").select(*_NAMES)
    kept = records.where(~is_revisit).select("digest", "payload").join(repeated, "digest", "left_semi").groupBy("digest").agg(F.min("payload").alias("payload"))
    kept = kept.join(originals, "digest").select(
        F.col("o_source_id").alias("source_id"), F.col("o_type").alias("type"), F.col("o_url").alias("url"), F.col("o_date").alias("date"), "digest", "payload", *[F.lit(None).cast("string").alias(c) for c in _NAMES[6:]]
    )
    own = alone.unionByName(kept).withColumn("record_id", record_id(F.col("digest"), *[F.col(k) for k in key], F.lit("response")))

    same = [F.col(k).eqNullSafe(F.col("o_" + k)) for k in key]
    copies = headers.where(~F.col("revisit")).join(originals.where("n > 1"), "digest").where(~(same[0] & same[1] & same[2])).select(*key, "digest", "o_id", "o_url", "o_date").distinct()
    copies = copies.select(*key, "digest", F.col("o_id").alias("refers_to"), F.col("o_url").alias("refers_to_uri"), F.col("o_date").alias("refers_to_date"))
    asked = headers.where("revisit").join(originals, "digest", "left")
    found = F.col("o_id").isNotNull()
    asked = asked.select(
        *key, "digest", F.when(found, F.col("o_id")).otherwise(F.col("refers_to")).alias("refers_to"), F.when(found, F.col("o_url")).otherwise(F.col("refers_to_uri")).alias("refers_to_uri"),
        F.when(found, F.col("o_date")).otherwise(F.col("refers_to_date")).alias("refers_to_date"),
    )
    revisits = copies.unionByName(asked).distinct()
    revisits = revisits.select("source_id", F.lit("revisit").alias("type"), "url", "date", "digest", F.lit(None).cast("binary").alias("payload"), *_NAMES[6:])
    revisits = revisits.withColumn("record_id", record_id(F.coalesce("digest", F.lit("")), *[F.col(k) for k in key], F.lit("revisit"), F.col("refers_to")))
    others = others.withColumn("record_id", record_id(F.col("digest"), *[F.col(k) for k in key], F.col("type")))
    return own.unionByName(revisits).unionByName(others)


def _clean(value: str) -> str:
    return "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def encode_record(row: dict, level: int = 1) -> bytes:
    """One record as a gzip member."""
    lines = ["WARC/1.1", f"WARC-Type: {row['type']}", f"WARC-Record-ID: {row['record_id']}", f"WARC-Date: {row['date'] or DEFAULT_DATE}"]
    fields = [("WARC-Target-URI", "url"), ("WARC-Payload-Digest", "digest"), ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "refers_to_uri"), ("WARC-Refers-To-Date", "refers_to_date"), ("Source-ID", "source_id")]
    lines += [f"{name}: {_clean(row[key])}" for name, key in fields if row[key] is not None]
    payload = row["payload"] or b""
    kind = "application/http;msgtype=response"
    if row["type"] == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        block = b"HTTP/1.1 200 OK\r\n\r\n"
    elif row["type"] == "response":
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    else:
        block, kind = payload, "application/http;msgtype=request" if row["type"] == "request" else "application/octet-stream"
    lines += [f"Content-Type: {kind}", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(level, wbits=31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_archives(records: DataFrame, folder: str, max_bytes: int = 1 << 30) -> DataFrame:
    """Write resolved records as archives under ``folder``; (path, records, bytes) of each archive. The folder must be one that all executors share."""

    folder = qualified(records.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        part, done, number = TaskContext.get().partitionId(), [], 0
        out, path, temp, n, size = None, "", "", 0, 0

        def close() -> None:
            out.close()
            fs.move(temp, f"{root}/{path}")
            done.append((f"{folder}/{path}", n, size))

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = f"part-{part:06d}-{number:04d}.warc.gz"
                    temp, n, size, number = f"{root}/{path}.{uuid.uuid4().hex}.tmp", 0, 0, number + 1
                    out = fs.open_output_stream(temp, compression=None)
                member = encode_record(row)
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= max_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in done], pa.string()), pa.array([m[1] for m in done], pa.int64()), pa.array([m[2] for m in done], pa.int64())], ["path", "records", "bytes"])

    return durable(records.select(*_NAMES, "record_id").mapInArrow(run, "path string, records long, bytes long"))


def parse_archive(stream) -> Iterator[dict]:
    """The records of a decompressed archive stream, one at a time."""
    while line := stream.readline():
        if not line.strip():
            continue
        head = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        length = int(head.get("content-length", 0))
        block = stream.read(length)
        if len(block) < length:
            return  # a truncated last record
        kind, payload = head.get("warc-type"), block
        if kind == "response" and block.startswith(b"HTTP/"):
            payload = block.partition(b"\r\n\r\n")[2]
        yield {
            "record_id": head.get("warc-record-id"), "source_id": head.get("source-id"), "type": kind, "url": head.get("warc-target-uri"), "date": head.get("warc-date"), "digest": head.get("warc-payload-digest"),
            "payload": None if kind == "revisit" else payload, "refers_to": head.get("warc-refers-to"), "refers_to_uri": head.get("warc-refers-to-target-uri"), "refers_to_date": head.get("warc-refers-to-date"),
            "content_length": length,
        }


_READ = pa.schema([(c, pa.binary() if c == "payload" else pa.string()) for c in ["record_id", *_NAMES]] + [("content_length", pa.int64())])


def read_archives(paths: DataFrame, batch_bytes: int = 1 << 22) -> DataFrame:
    """RECORD rows with ``record_id`` and ``content_length`` of the archives named by column ``path``, one task an archive; records are streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, root = file_system(path)
                held, size = [], 0
                with fs.open_input_stream(root, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for row in parse_archive(stream):
                        held.append(row)
                        size += row["content_length"] + 500
                        if size > batch_bytes:
                            yield pa.RecordBatch.from_pylist(held, _READ)
                            held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, _READ)

    shape = f"record_id string, {RECORD}, content_length long"
    return paths.select("path").mapInArrow(run, shape)


def archive_folder(spark: SparkSession) -> str:
    return made(f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}")


def deduplicated_archive(records: DataFrame, folder: str | None = None) -> DataFrame:
    """Resolve ``records``, write them as archives and read these back."""
    folder = folder or archive_folder(records.sparkSession)
    archives = write_archives(resolve(records), folder)
    files = archives.count()
    return read_archives(archives.repartition(max(1, min(files, 10_000))))
