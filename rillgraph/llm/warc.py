"""WARC archives: writing with revisits, segments and chunked framing, and segment reassembly when reading.

Writing. Payloads of at least ``min_revisit_bytes`` that are equal share one response record, that of the smallest id;
the others become revisit records that name it. HTTP bodies are framed in chunks. A block above ``segment_chars``
characters is cut into segments: the first keeps the record's own type and number 1, the rest are continuation records
with the origin's identifier, their number, and on the last one the total length. Spark's text writer puts one record
on each "line" and ends it with the two line breaks the format asks for, so any file system Spark can write to will do.

Reading. Files are cut into records by their stated lengths. Continuation records are grouped by origin identifier,
ordered by segment number and joined; the numbers must be 1..n and the length must equal the stated total. Then the
HTTP header is taken off and the chunked framing is decoded. Revisits take the length of the payload they refer to.

Defined cases. Null payload: empty. Null id: a response of its own that reads back with a null id and is never referred
to. Rows that share id and payload are written and read back as often as they occur; with another payload they are
records of their own. Line breaks in a URI are percent-encoded, a null URI leaves the header out. A record that is cut
short, lacks a segment, fails its length or states a length that isn't a number has its fault named in ``problem`` and
null length and digest; so has the end of a file that can't be decompressed. Files named ``*.txt*`` and ``*.warc*`` are
read. Extra columns
of the input are ignored. No rows: an empty archive, which reads as an empty table.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX = "urn:page:"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


# --- writing -----------------------------------------------------------------------------------------------------


def framed(payload: str, chunk_chars: int) -> str:
    """``payload`` in chunked transfer framing; chunks end between characters."""
    out = []
    for at in range(0, len(payload), chunk_chars):
        part = payload[at : at + chunk_chars]
        out += [f"{len(part.encode()):x}\r\n", part, "\r\n"]
    return "".join([*out, "0\r\n\r\n"])


def _record(fields: dict[str, object], block: str) -> str:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block.encode())}\r\n\r\n{block}"


def records(name: str, uri: str | None, payload: str, digest: str, refers_to: str | None, segment_chars: int, chunk_chars: int) -> list[str]:
    """The records of one page, without the two line breaks that end each."""
    uri = None if uri is None else uri.replace("\r", "%0D").replace("\n", "%0A")
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{name}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": uri,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is not None:
        return [_record(fields | {"WARC-Refers-To": f"<{refers_to}>", "WARC-Profile": PROFILE}, REVISIT_HEAD)]
    block = HTTP_HEAD + framed(payload, chunk_chars)
    if len(block) <= segment_chars:
        return [_record(fields, block)]
    parts = [block[at : at + segment_chars] for at in range(0, len(block), segment_chars)]
    out = [_record(fields | {"WARC-Segment-Number": 1}, parts[0])]
    for k, part in enumerate(parts[1:], 2):
        more = {"WARC-Type": "continuation", "WARC-Record-ID": f"<{name}:{k}>", "WARC-Date": DATE, "WARC-Target-URI": uri, "WARC-Segment-Origin-ID": f"<{name}>", "WARC-Segment-Number": k}
        out.append(_record(more | ({"WARC-Segment-Total-Length": len(block.encode())} if k == len(parts) else {}), part))
    return out


def record_name(page: Column, digest: Column) -> Column:
    return F.concat(F.lit(PREFIX), F.coalesce(page.cast("string"), F.lit("-")), F.lit(":"), digest)


def assigned(pages: DataFrame, page: str, uri: str, payload: str, min_revisit_bytes: int) -> DataFrame:
    """``name, uri, payload, digest, refers_to``: the record that each page becomes.

    Only digests that occur more than once go into the joined table. A digest that a third of the pages share is split
    by adaptive execution, or the small side is sent to all tasks when its measured size allows that.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(page).cast("long").alias("page"), F.col(uri).alias("uri"), body.alias("payload"), F.sha2(body.cast("binary"), 256).alias("digest"))
    first = rows.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    # short payloads have no partner, and a key of their own keeps equal ones from meeting in one task
    key = F.when(F.octet_length("payload") >= min_revisit_bytes, F.col("digest")).otherwise(F.concat_ws(":", F.lit("short"), "page"))
    known = rows.withColumn("key", key).join(first.withColumnRenamed("digest", "key"), "key", "left")
    refers = F.when(F.col("page") > F.col("first"), record_name(F.col("first"), F.col("digest")))
    return known.select(record_name(F.col("page"), F.col("digest")).alias("name"), "uri", "payload", "digest", refers.alias("refers_to"))


def write_archive(pages: DataFrame, path: str, page: str = "page_id", uri: str = "url", payload: str = "html", *, min_revisit_bytes: int = 100, segment_chars: int = 65_536, chunk_chars: int = 8_192, records_per_file: int = 2_000) -> None:
    """Write the pages as gzip-compressed WARC files below ``path``.

    A file has at most ``records_per_file`` records of at most 4 * ``segment_chars`` bytes and a header, 512 MB before
    compression, so a reader's memory is bounded by bytes too.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = zip(*(c.to_pylist() for c in batch.slice(start, 256).columns), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([r for row in rows for r in records(*row, segment_chars, chunk_chars)], pa.string())], names=["value"])

    out = assigned(pages, page, uri, payload, min_revisit_bytes).mapInArrow(build, "value string")
    out.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", records_per_file).text(path)


# --- reading -----------------------------------------------------------------------------------------------------


def parsed(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """Header fields (names in lower case), block and fault of every record of one file; a broken file ends with a fault."""
    try:
        yield from _parsed(stream)
    except (EOFError, OSError, zlib.error) as e:
        yield {}, b"", f"the file is broken: {e}"


def _parsed(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            yield {}, b"", "no record starts here"
            return
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        stated = fields.get("content-length", "")
        if not (stated.isascii() and stated.isdigit()):
            yield fields, b"", f"content length {stated!r} isn't a number"
            return  # where the next record starts isn't known
        length = int(stated)
        block = stream.read(length)
        yield fields, block, None if len(block) == length else "the record is cut short"


def unframed(body: bytes) -> bytes:
    """The payload of a chunked body; ``ValueError`` if the framing is broken."""
    out, at = [], 0
    while True:
        line_end = body.find(b"\r\n", at)
        if line_end < 0:
            raise ValueError("no chunk size")
        digits = body[at:line_end].split(b";")[0].strip()
        if not digits or digits.strip(b"0123456789abcdefABCDEF"):
            raise ValueError("a chunk size isn't hexadecimal")
        size = int(digits, 16)
        at = line_end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> tuple[bytes | None, str | None]:
    """The payload of a whole HTTP block, or its fault."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None, "no end of the HTTP header"
    if b"transfer-encoding: chunked" in head.lower():
        try:
            return unframed(body), None
        except ValueError as e:
            return None, f"chunked framing: {e}"
    return body, None


_PARSED = T.StructType().add("record_id", "string").add("record_type", "string").add("uri", "string").add("refers_to_id", "string").add("stated_digest", "string").add("origin", "string").add("number", "integer").add("total", "long").add("block", "binary").add("payload", "binary").add("payload_bytes", "long").add("payload_digest", "string").add("problem", "string")


def _bare(x: str | None) -> str | None:
    return None if x is None else x.strip("<>")


def read_archive(spark: SparkSession, path: str, keep, *, with_payload: bool = True) -> DataFrame:
    """One row per logical record: ``record_id, record_type, uri, refers_to_id, payload, payload_bytes, payload_digest, problem``.

    ``keep`` writes and rereads a table (see ``common.saved``); files are parsed once, and only the blocks of segmented
    records go through a shuffle. ``with_payload=False`` leaves payloads null once measured and digested.
    """
    schema = [f.name for f in _PARSED]

    def row(fields: dict[str, str], block: bytes, fault: str | None) -> tuple:
        whole = lambda x: int(x) if x is not None and x.isascii() and x.isdigit() and len(x) < 10 else None
        number = fields.get("warc-segment-number")
        segment = number is not None
        if segment and whole(number) is None:
            fault = fault or f"segment number {number!r} isn't a number"
        kind = fields.get("warc-type", "")
        data = None
        if fault is None and not segment and kind != "revisit":
            data, fault = payload_of(block)
        digest = fields.get("warc-payload-digest")
        return (
            _bare(fields.get("warc-record-id")), kind, fields.get("warc-target-uri"), _bare(fields.get("warc-refers-to")), digest and digest.partition(":")[2],
            _bare(fields.get("warc-segment-origin-id") or (fields.get("warc-record-id") if segment else None)), whole(number),
            whole(fields.get("warc-segment-total-length")), block if segment else None,
            data if with_payload else None, None if data is None else len(data), None if data is None else hashlib.sha256(data).hexdigest(), fault,
        )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 6 + [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.string()]
        target = pa.schema(list(zip(schema, kinds, strict=True)))
        for batch in batches:
            for content in batch.column("content").to_pylist():
                raw = io.BytesIO(content)
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw
                rows = []
                for found in parsed(stream):
                    rows.append(row(*found))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=target)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=target)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,warc}*").load(path).select("content")
    rows = keep(files.mapInArrow(parse, _PARSED), "warc-records")
    final = ["record_id", "record_type", "uri", "refers_to_id", "stated_digest", "payload", "payload_bytes", "payload_digest", "problem"]
    return rows.where("origin is null").select(final).unionByName(_reassembled(rows.where("origin is not null"), with_payload).select(final))


def _reassembled(segments: DataFrame, with_payload: bool) -> DataFrame:
    """Segmented records put together again. A group holds the segments of one record and no more."""
    names = ["record_id", "record_type", "uri", "refers_to_id", "stated_digest"]
    first = F.struct(*(F.col(c) for c in names))
    groups = segments.groupBy("origin").agg(
        F.collect_list(F.struct("number", "total", "block", "problem")).alias("parts"),
        F.min(F.when(F.col("number") == 1, first)).alias("first"),
        F.count_if(F.col("number") == 1).alias("copies"),
    )
    kinds = [pa.string()] * 5 + [pa.binary(), pa.int64(), pa.string(), pa.string()]
    out = T.StructType()
    for name, kind in zip([*names, "payload", "payload_bytes", "payload_digest", "problem"], ["string"] * 5 + ["binary", "long", "string", "string"], strict=True):
        out = out.add(name, kind)

    def joined(parts: list[dict]) -> tuple[bytes | None, str | None]:
        by_number = {p["number"]: p for p in parts}
        if fault := next((p["problem"] for p in parts if p["problem"]), None):
            return None, fault
        if None in by_number or sorted(by_number) != list(range(1, len(by_number) + 1)):
            return None, "a segment is missing"
        block = b"".join(by_number[k]["block"] for k in sorted(by_number))
        total = by_number[len(by_number)]["total"]
        if total != len(block):
            return None, f"total length {total} is stated, {len(block)} found"
        return payload_of(block)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                origin, parts, head, copies = (c[0].as_py() for c in batch.slice(at, 1).columns)
                data, fault = joined(parts)
                head = head or {"record_id": origin, "record_type": "response", "uri": None, "refers_to_id": None, "stated_digest": None}
                line = [head[c] for c in names] + [data if with_payload else None, None if data is None else len(data), None if data is None else hashlib.sha256(data).hexdigest(), fault]
                yield pa.RecordBatch.from_arrays([pa.array([x] * max(1, copies), k) for x, k in zip(line, kinds, strict=True)], names=[f.name for f in out])

    return groups.mapInArrow(work, out)


def digests(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, problem`` of every response and revisit read back.

    A revisit's length and digest are those of the response it names; if that one is absent, ``problem`` says so.
    """
    page = F.nullif(F.split_part(F.substring("record_id", len(PREFIX) + 1, 1 << 20), F.lit(":"), F.lit(1)), F.lit("-")).cast("long")
    rows = records.where(F.col("record_type").isin("response", "revisit"))
    is_revisit = F.col("record_type") == "revisit"
    known = rows.where(~is_revisit).groupBy(F.col("record_id").alias("refers_to_id")).agg(F.max("payload_bytes").alias("b"), F.max("payload_digest").alias("d"))
    bad = F.when(F.col("payload_digest") != F.col("stated_digest"), F.lit("the payload differs from its stated digest"))
    first = rows.where(~is_revisit).select(page.alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), F.coalesce("problem", bad).alias("problem"))
    refers = F.split_part(F.substring("refers_to_id", len(PREFIX) + 1, 1 << 20), F.lit(":"), F.lit(1)).cast("long")
    again = rows.where(is_revisit).join(known, "refers_to_id", "left")
    fault = F.when(F.col("b").isNull(), F.lit("the record it refers to is absent")).when(F.col("d") != F.col("stated_digest"), F.lit("the payload differs from its stated digest"))
    again = again.select(page.alias("page_id"), F.col("b").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", refers.alias("refers_to"), F.coalesce("problem", fault).alias("problem"))
    return first.unionByName(again)
