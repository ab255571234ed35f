"""WARC archives written and read as a chunked record table.

A payload is streamed as rows (record, chunk number, bytes): the writer and
the reader see one bounded chunk at a time and carry the record's SHA-1
digest along, so no Python process ever holds a whole payload. A payload of
more than one chunk becomes a segmented record (a first record and its
``continuation`` records, as the standard describes).

Archives are written and read by Spark's text source, so they may lie in
any store Spark reaches, and a lost task is simply run again. The reader
splits a file at line feed + ``WARC/1.1`` + CRLF and checks every
Content-Length. For that, no chunk may hold ``WARC/1.1``: the writer cuts
a payload inside these characters too. Files are gzipped as a whole, so
that one task reads a record's segments in order.

Defined results: a null payload is empty; of records with equal payloads
(of ``min_bytes`` or more), the one with the smallest id is the response
and the others revisit it; among repeated rows with that id, exactly one
is the response; null ids come last; a null URL leaves its header out; an
empty table writes no records; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respondo.llm.common import numbered, stage
from respondo.session import scratch_path

CHUNK = 1 << 18
VERSION = b"WARC/1.1"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def chunks(records: DataFrame, payload: str, chunk: int | None = None) -> DataFrame:
    """Replace ``payload`` by rows ``chunk_no`` (from 0), ``n_chunks`` and
    ``data``; an empty or null payload has one empty chunk."""
    chunk = chunk or CHUNK
    size = F.octet_length("__bytes")
    return (records.withColumn("__bytes", F.coalesce(F.encode(payload, "UTF-8"), F.lit(b""))).drop(payload)
            .withColumn("n_chunks", F.greatest(F.lit(1), F.ceil(size / chunk).cast("int")))
            .withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
            .withColumn("data", F.substring("__bytes", F.col("chunk_no") * chunk + 1, F.lit(chunk)))
            .drop("__bytes"))


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def digests(records: DataFrame, payload: str) -> DataFrame:
    """(row, id, payload_bytes, payload_digest) of each record."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, size = hashlib.sha1(), 0
        for batch in batches:
            out = []
            cols = [batch.column(c) for c in ("row", "id", "chunk_no", "n_chunks")]
            data = batch.column("data")
            for i, (row, rid, k, n) in enumerate(zip(*(c.to_pylist() for c in cols))):
                if k == 0:
                    sha, size = hashlib.sha1(), 0
                part = data[i].as_py()
                sha.update(part)
                size += len(part)
                if k == n - 1:
                    out.append((row, rid, size, base32(sha.digest())))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[j] for o in out], t) for j, t in
                 enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                ["row", "id", "payload_bytes", "payload_digest"])

    return (chunks(records.select("row", "id", payload), payload)
            .select("row", "id", "chunk_no", "n_chunks", "data")
            .mapInArrow(kernel, "row long, id long, payload_bytes long, payload_digest string"))


def decide(found: DataFrame, min_bytes: int) -> DataFrame:
    """Add ``record_type`` and, for revisits, the response's ``refers_row``
    and ``refers_id``. Equal payloads are counted before they are shuffled,
    and only payloads that occur again are joined."""
    same = ["payload_digest", "payload_bytes"]
    first = stage(found.where(F.col("payload_bytes") >= min_bytes).groupBy(*same)
                  .agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("head"),
                       F.count("*").alias("n")).where("n > 1").drop("n"), "first-records")
    later = F.col("head").isNotNull() & (F.col("head.row") != F.col("row"))
    return found.join(first, same, "left").select(
        "row", "id", *same,
        F.when(later, "revisit").otherwise("response").alias("record_type"),
        F.when(later, F.col("head.row")).alias("refers_row"),
        F.when(later, F.col("head.id")).alias("refers_id"))


def record_name(row: int, rid: int | None) -> str:
    return f"<urn:record:{row}:{'' if rid is None else rid}>"


def parts(data: bytes) -> list[bytes]:
    """``data`` cut inside every ``WARC/1.1``."""
    pieces = data.split(VERSION)
    out = []
    for i, p in enumerate(pieces):
        out.append((VERSION[5:] if i else b"") + p + (VERSION[:5] if i < len(pieces) - 1 else b""))
    return out


def write_kernel(date: str):
    def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
        head = [VERSION.decode(), *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
        return "\r\n".join([*head, "", ""]).encode() + block

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, total = 0, 0
        for batch in batches:
            names = [c for c in batch.schema.names if c != "data"]
            rows = batch.select(names).to_pylist()
            data = batch.column("data")
            out = []
            for i, r in enumerate(rows):
                name = record_name(r["row"], r["id"])
                last = r["chunk_no"] == r["n_chunks"] - 1
                pieces = parts(data[i].as_py())
                if r["chunk_no"] == 0:
                    segment, total = 0, 0
                for j, piece in enumerate(pieces):
                    segment += 1
                    end = last and j == len(pieces) - 1
                    if segment == 1:
                        fields = [("WARC-Type", r["record_type"]), ("WARC-Record-ID", name),
                                  ("WARC-Date", date)]
                        if r["url"] is not None:
                            fields.append(("WARC-Target-URI", quote(r["url"], safe=":/?#[]@!$&'()*+,;=%~")))
                        fields += [("WARC-Payload-Digest", "sha1:" + r["payload_digest"]),
                                   ("X-Payload-Length", str(r["payload_bytes"])),
                                   ("Content-Type", "application/http; msgtype=response")]
                        if r["record_type"] == "revisit":
                            fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/"
                                                        "identical-payload-digest"),
                                       ("WARC-Refers-To", record_name(r["refers_row"], r["refers_id"]))]
                        if not end:
                            fields.append(("WARC-Segment-Number", "1"))
                        block = HTTP + piece
                    else:
                        fields = [("WARC-Type", "continuation"),
                                  ("WARC-Record-ID", f"{name[:-1]}:{segment}>"), ("WARC-Date", date),
                                  ("WARC-Segment-Origin-ID", name),
                                  ("WARC-Segment-Number", str(segment))]
                        block = piece
                    total += len(block)
                    if end and segment > 1:
                        fields.append(("WARC-Segment-Total-Length", str(total)))
                    out.append(record(fields, block))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
    return kernel


def write(pages: DataFrame, path: str, id_col: str, url_col: str, payload_col: str,
          min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one record per row of ``pages`` as gzipped WARC files at ``path``."""
    rows, _ = numbered(pages.select(F.col(id_col).cast("long").alias("id"),
                                    F.col(url_col).alias("url"), F.col(payload_col).alias("payload")), "row")
    decided = stage(decide(stage(digests(rows, "payload"), "digests"), min_bytes), "decisions")
    joined = (rows.drop("id").join(decided, "row")
              .withColumn("payload", F.when(F.col("record_type") == "response", F.col("payload"))))
    (chunks(joined, "payload")
     .mapInArrow(write_kernel(date), "value binary")
     .select(F.col("value").cast("string"))
     .write.option("compression", "gzip").option("lineSep", "\r\n\r\n").text(path))


def parse(value: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record as the reader splits them."""
    head, _, rest = value.partition(b"\r\n\r\n")
    fields = {}
    for line in head.removeprefix(VERSION + b"\r\n").split(b"\r\n"):
        k, _, v = line.partition(b": ")
        fields[k.decode()] = v.decode()
    n = int(fields["Content-Length"])
    if len(rest) < n or rest[n:].strip(b"\r\n"):
        raise ValueError(f"{fields.get('WARC-Record-ID')}: block of {len(rest)} bytes, header says {n}")
    return fields, rest[:n]


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The archives' records and segments as rows (``value`` bytes)."""
    return (spark.read.option("lineSep", "\nWARC/1.1\r\n").text(path)
            .select(F.col("value").cast("binary").alias("value")))


def read_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per record, when its last segment has been read."""
    now, sha, size, total, segment = None, hashlib.sha1(), 0, 0, 0
    columns = (("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
               ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()),
               ("intact", pa.bool_()))
    for batch in batches:
        out = []
        for value in batch.column("value"):
            fields, block = parse(value.as_py())
            total = len(block) + (0 if fields["WARC-Type"] != "continuation" else total)
            if fields["WARC-Type"] != "continuation":
                now, sha, size, segment = fields, hashlib.sha1(), 0, 1
                block = block[len(HTTP):]
            else:
                segment += 1
                if (fields["WARC-Segment-Origin-ID"] != now["WARC-Record-ID"]
                        or int(fields["WARC-Segment-Number"]) != segment):
                    raise ValueError(f"{fields['WARC-Record-ID']} does not follow its record")
            sha.update(block)
            size += len(block)
            if "WARC-Segment-Number" in fields and "WARC-Segment-Total-Length" not in fields:
                continue
            whole = int(fields.get("WARC-Segment-Total-Length", total)) == total
            told = now["WARC-Payload-Digest"].removeprefix("sha1:")
            rid = now["WARC-Record-ID"][:-1].split(":")[3]
            to = now.get("WARC-Refers-To", ":::>")[:-1].split(":")[3]
            response = now["WARC-Type"] == "response"
            out.append((int(rid) if rid else None,
                        size if response else int(now["X-Payload-Length"]),
                        base32(sha.digest()) if response else told, now["WARC-Type"],
                        int(to) if to else None, now.get("WARC-Target-URI"),
                        whole and (not response or base32(sha.digest()) == told)))
        yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t)
                                          for j, (_, t) in enumerate(columns)], [c for c, _ in columns])


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: ``page_id``, ``payload_bytes``, ``payload_digest``
    (computed while reading responses; of revisits, the header's),
    ``record_type``, ``refers_to``, ``url`` and ``intact`` (digest and
    lengths agree with the headers)."""
    return segments(spark, path).mapInArrow(
        read_kernel, "page_id long, payload_bytes long, payload_digest string, record_type string, "
                     "refers_to long, url string, intact boolean")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
               payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write the archives into the shared folder and read them back."""
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path, id_col, url_col, payload_col, min_bytes)
    return read(pages.sparkSession, path)
