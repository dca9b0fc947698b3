"""WARC archives through Spark: chunked record tables, incremental digests, no whole record in a Python worker.

A record's payload is rows (record, row, chunk number, bytes), row being unique, of at most CHUNK bytes. The writer takes them in order, one
Arrow batch at a time, and carries the running SHA-1 from chunk to chunk. A payload above one chunk is written as
segments: the first record and `continuation` records, numbered by WARC-Segment-Number, each with the digest of its own
block and the digest of the payload up to there. Equal payloads are written once: the record with the largest id is the
response and the others are `revisit` records that name it.

Each WARC record (or segment) is one gzip member, and archives are written by Spark's text writer, one member per row, so
that tasks commit or retry as any Spark output does, to any file system Spark knows. The row separator is the end of an
empty gzip member that follows each record, hence every file is a valid multi-member .warc.gz stream. For the same reason
Spark's text reader splits archives at records: a reader task holds one segment at a time.

Reading back gives the chunk table again: every segment's own digest is checked where it is read; a payload in several
segments is digested again in order, its chunks sorted by Spark, never joined in memory.

Nulls and edge cases: a null payload is empty; a payload's digest is bare upper-case base32 SHA-1. Rows with equal id
and payload are all the response (or all revisits); a null id is written as an empty target and is the response only if
no row with an id has that payload. Only the id and payload columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm._base import scratch, small_batches, written

CHUNK = 1 << 20
#: Smallest payload, in bytes, that may be written as a revisit.
REVISIT_FROM = 0
#: End of an empty gzip member after its header: a file comment, an empty block, zero checksum and length.
MARK = "quillframe-record-end\0\x03\0" + "\0" * 8
#: The header before it; the fifth flag says that a comment follows.
MARK_HEAD = b"\x1f\x8b\x08\x10\0\0\0\0\0\x03"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def member(data: bytes, level: int = 1) -> bytes:
    """data as one gzip member, without the separator's bytes in it."""
    for n in (level, 0):
        z = zlib.compressobj(n, zlib.DEFLATED, 31)
        out = z.compress(data) + z.flush()
        if MARK.encode() not in out:
            return out
    return member(data[: len(data) // 2]) + member(data[len(data) // 2 :])


def header(kind: str, fields: dict[str, object], length: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields.items() if v is not None), f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def http(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def chunked(records: DataFrame, size: int = CHUNK) -> DataFrame:
    """records(id, payload binary, ...) to rows (..., total, chunk_no, chunk), in order; at least one row per record."""
    total = F.length("payload")
    rows = records.withColumn("total", total.cast("long")).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(total / size).cast("int") - 1, F.lit(0)))))
    return rows.withColumn("chunk", F.expr(f"substring(payload, chunk_no * {size} + 1, {size})")).drop("payload")


def _writer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    running = hashlib.sha1()
    for batch in batches:
        col = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("row", "id", "url", "refers_to", "revisit", "sha", "total", "segments", "chunk_no", "chunk")}
        out = []
        for row, i, url, refers, revisit, sha, total, segments, no, chunk in zip(*col.values()):
            digest = base32(bytes.fromhex(sha))
            if no == 0:
                running = hashlib.sha1()
            running.update(chunk)
            name = f"<urn:quillframe:page:{'' if i is None else i}:{row}>"
            line = re.sub(r"[\r\n]", " ", url or "")
            if revisit:
                fields = {"WARC-Record-ID": name, "WARC-Target-URI": line, "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:quillframe:page:{refers}>", "WARC-Payload-Digest": f"sha1:{digest}"}
                head, block = http(total), b""
            else:
                head, block = (http(total) if no == 0 else b""), chunk
                fields = {"WARC-Record-ID": name if no == 0 else f"{name[:-1]}:segment:{no + 1}>", "WARC-Target-URI": line}
                if segments > 1:
                    fields |= {"WARC-Segment-Number": no + 1, "WARC-Segment-Origin-ID": name if no else None, "WARC-Segment-Total-Length": total if no == segments - 1 else None, "X-Running-Digest": f"sha1:{base32(running.copy().digest())}"}
                if no == 0:
                    fields["WARC-Payload-Digest"] = f"sha1:{digest}"
                if no == segments - 1 and base32(running.digest()) != digest:
                    raise ValueError(f"payload of page {i} changed while it was written")
            whole = hashlib.sha1(head)
            whole.update(block)
            fields["WARC-Block-Digest"] = f"sha1:{base32(whole.digest())}"
            kind = "revisit" if revisit else "response" if no == 0 else "continuation"
            z = header(kind, fields, len(head) + len(block)) + head + block + b"\r\n\r\n"
            out.append(member(z) + MARK_HEAD)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])


def planned(records: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """records(id, url, payload) with digest, revisit and refers_to: equal payloads refer to the largest id."""
    keyed = records.withColumn("sha", F.sha1("payload"))
    groups = keyed.filter(F.length("payload") >= revisit_from).groupBy("sha").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1 and last is not null")
    groups = written(groups.select(F.col("sha").alias("of"), "last"), "warc-groups")
    joined = keyed.join(groups, F.col("sha") == F.col("of"), "left")
    revisit = F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last"))
    return joined.select("id", "url", "payload", "sha", revisit.alias("revisit"), F.when(revisit, F.col("last")).alias("refers_to"))


def write(records: DataFrame, path: str, chunk: int = CHUNK, revisit_from: int = REVISIT_FROM) -> None:
    """records(id, url, payload binary) as archives under path."""
    spark = records.sparkSession
    small_batches(spark)
    rows = chunked(planned(records, revisit_from).withColumn("row", F.monotonically_increasing_id()), chunk)
    rows = rows.filter("not revisit or chunk_no = 0").withColumn("chunk", F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("chunk")))
    rows = rows.withColumn("segments", F.when(F.col("revisit"), F.lit(1)).otherwise(F.greatest(F.ceil(F.col("total") / chunk).cast("int"), F.lit(1))))
    rows = rows.select("row", "id", "url", "refers_to", "revisit", "sha", "total", "segments", "chunk_no", "chunk")
    rows.mapInArrow(_writer, "member binary").select(F.col("member").cast("string")).write.option("lineSep", MARK).text(path)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-cased names) and block of one WARC record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return fields, rest[: int(fields["content-length"])]


def unzip(data: bytes) -> bytes:
    """The content of one or more gzip members."""
    out = []
    while data:
        z = zlib.decompressobj(31)
        out.append(z.decompress(data))
        if not z.eof:
            raise ValueError("a gzip member is cut off")
        data = z.unused_data
    return b"".join(out)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record", "row", "record_type", "refers_to", "chunk_no", "segmented", "payload_bytes", "payload_digest", "chunk"]
    number = re.compile(r"^<urn:quillframe:page:([0-9-]*)(?::([0-9]+))?>$")
    for batch in batches:
        out = []
        for raw in batch.column(0).to_pylist():
            fields, block = parse(unzip(raw.removesuffix(MARK_HEAD)))
            if f"sha1:{base32(hashlib.sha1(block).digest())}" != fields["warc-block-digest"]:
                raise ValueError(f"block digest of {fields['warc-record-id']} doesn't hold")
            no, kind, total = int(fields.get("warc-segment-number", 1)) - 1, fields["warc-type"], None
            if kind != "continuation":
                head, _, block = block.partition(b"\r\n\r\n")
                total = int(re.search(rb"Content-Length: (\d+)", head)[1])
            name, row = number.match(fields.get("warc-segment-origin-id", fields["warc-record-id"])).groups()
            refers = number.match(fields["warc-refers-to"])[1] if kind == "revisit" else None
            digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
            segmented = "warc-segment-number" in fields
            if kind == "response" and not segmented:
                digest, total = base32(hashlib.sha1(block).digest()), len(block)
                if f"sha1:{digest}" != fields["warc-payload-digest"]:
                    raise ValueError(f"payload digest of {name} doesn't hold")
            out.append((int(name) if name else None, int(row), kind, int(refers) if refers else None, no, segmented, total, digest, block))
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Archives under path as a chunk table; block digests are checked."""
    small_batches(spark)
    members = spark.read.option("lineSep", MARK).text(path).select(F.col("value").cast("binary").alias("member"))
    return members.mapInArrow(_reader, "record long, row long, record_type string, refers_to long, chunk_no int, segmented boolean, payload_bytes long, payload_digest string, chunk binary")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks of segmented payloads to one row per record, from a digest that is carried along."""
    now: list | None = None
    for batch in batches:
        out = []
        rows = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("record", "row", "chunk_no", "payload_digest", "chunk")))
        for record, row, no, digest, chunk in rows:
            if no == 0:
                if now:
                    out.append(_closed(now))
                now = [record, hashlib.sha1(), 0, digest, -1, row]
            if now is None or no != now[4] + 1 or row != now[5]:
                raise ValueError(f"segment {no + 1} of page {record} isn't in its place")
            now[1].update(chunk)
            now[2], now[4] = now[2] + len(chunk), no
        if out:
            yield _rows(out)
    if now:
        yield _rows([_closed(now)])


def _closed(now: list) -> tuple[int, int, str]:
    digest = base32(now[1].digest())
    if digest != now[3]:
        raise ValueError(f"payload digest of page {now[0]} doesn't hold")
    return now[0], now[2], digest


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["record", "payload_bytes", "payload_digest"])


def records(chunks: DataFrame) -> DataFrame:
    """A chunk table to (record, payload_bytes, payload_digest, record_type, refers_to), digests taken from the bytes."""
    names = ["record", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    whole = chunks.filter("not segmented").select(*names)
    parts = chunks.filter("segmented").select("record", "row", "chunk_no", "payload_digest", "chunk").repartition("row").sortWithinPartitions("row", "chunk_no")
    joined = parts.mapInArrow(_streamed, "record long, payload_bytes long, payload_digest string")
    return whole.unionByName(joined.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long")}).select(*names))


def archived(pages: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Writes pages(page_id, url, html) to archives and reads them back, a row for each page."""
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write(pages.select(F.col("page_id").alias("id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")), path, chunk)
    return records(read(spark, path)).withColumnRenamed("record", "page_id")
