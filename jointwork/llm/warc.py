"""WARC archives: writing with revisit records, and a salvage reader.

Writing: a gzip member per record.  Of pages with equal payloads the one with
the smallest page_id is a response, the others are revisit records that name
it and keep the size and digest of the payload.

Salvage reading walks a file record by record and checks each one (gzip
checksum, version line, length, block digest).  After a failed check it
searches for the next place where a valid member or version line begins, goes
on there, and logs the bytes in between as a quarantined gap.

Null html counts as empty.  Pages with the smallest page_id of their payload
are responses even if the row is repeated; a page without page_id revisits
the smallest page_id of its payload, and is a response if there is none.  A
null url is left out of the header.  Empty tables give no files and no rows.
Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from jointwork.llm.registry import register, table
from jointwork.operators.skew import shared_dir

VERSION = b"WARC/1.1\r\n"
VERSIONS = (b"WARC/1.0\r\n", VERSION)
HEAD_BYTES = 65_536  # read at a time while the end of headers is sought
STEP = 1 << 20
MANIFEST = "path string, records long, bytes long"
RECORDS = (
    "path string, begin long, end long, problem string, record_id string, record_type string, refers_to string, uri string, "
    "payload_bytes long, payload_digest string, payload binary"
)
FILE_BYTES = 256 << 20


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


def sha1_text(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, uncompressed; ``refers_to`` makes it a revisit without a block."""
    block = payload if refers_to is None else b""
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {page_urn(page_id)}",
        f"WARC-Payload-Digest: sha1:{sha1_text(payload)}", f"WARC-Payload-Length: {len(payload)}", f"WARC-Block-Digest: sha1:{sha1_text(block)}",
        "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.insert(2, "WARC-Target-URI: " + " ".join(url.split()))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {page_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


def with_first(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages with ``first``, the smallest page_id of their payload; null where the page is a response."""
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    repeated = (
        keyed.filter(F.octet_length("html") >= min_bytes).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    )
    joined = keyed.join(repeated, "digest", "left")  # a hot payload is split by adaptive execution
    return joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> DataFrame:
    """Write all pages; a file gets its name when it is whole.  One manifest row per file."""
    spark = pages.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = place(path)
        scheme = path.split(":", 1)[0] + "://" if ":" in path else ""
        task, out, done, size, number = TaskContext.get(), None, 0, 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            store.move(f"{final}.{task.taskAttemptId()}", final)
            return pa.RecordBatch.from_pydict({"path": [scheme + final], "records": [done], "bytes": [size]})

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    store.create_dir(base, recursive=True)
                    final = f"{base}/pages-{task.partitionId():06d}-{number:04d}.warc.gz"
                    out, done, size, number = store.open_output_stream(f"{final}.{task.taskAttemptId()}"), 0, 0, number + 1
                member = gzip_member(record_bytes(row["page_id"], row["url"], row["html"].encode(), row["first"]))
                out.write(member)
                done, size = done + 1, size + len(member)
                if size >= FILE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    with_first(pages, min_bytes).mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


class Damaged(Exception):
    """A failed check; the text says which."""


def _inflate(read: Callable[[int, int], bytes], at: int, size: int, most: int | None = None) -> tuple[bytes, int]:
    """Data of the gzip member at ``at`` and its end; with ``most`` only so many bytes of its beginning."""
    expand, out, pos = zlib.decompressobj(31), io.BytesIO(), at
    try:
        while not expand.eof:
            chunk = read(pos, min(STEP if most is None else 512, size - pos))
            if not chunk:
                raise Damaged("truncated member")
            pos += len(chunk)
            out.write(expand.decompress(chunk, 0 if most is None else most))
            if most is not None and out.tell() >= most:
                return out.getvalue(), pos
    except zlib.error as error:
        raise Damaged(f"gzip: {error}") from None
    return out.getvalue(), pos - len(expand.unused_data)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and length of the record at the start of ``data``."""
    if not data.startswith(VERSIONS):
        raise Damaged("no version line")
    stop = data.find(b"\r\n\r\n")
    if stop < 0:
        raise Damaged("no end of headers")
    headers = {}
    for line in data[10:stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without colon")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not length.isdigit():
        raise Damaged("no length")
    end = stop + 4 + int(length)
    block = data[stop + 4 : end]
    if len(block) < int(length) or data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("length")
    said = headers.get("warc-block-digest")
    if said and said.startswith("sha1:") and said[5:] != sha1_text(block):
        raise Damaged("block digest")
    return headers, block, end + 4


def _head(read: Callable[[int, int], bytes], at: int, size: int) -> bytes:
    """Version line and headers at ``at``, read on in steps until they end or a line is no header."""
    head, line = bytearray(), len(VERSION)
    while True:
        seen = len(head)
        head += read(at + seen, min(HEAD_BYTES, size - at - seen))
        if not head.startswith(VERSIONS):
            raise Damaged("no version line")
        stop = head.find(b"\r\n\r\n", max(seen - 3, 0))
        if stop >= 0:
            return bytes(head[:stop])
        if len(head) == seen:
            raise Damaged("no end of headers")
        last = head.rfind(b"\r\n", line)
        if last >= 0:
            if any(b":" not in x for x in head[line:last].split(b"\r\n")):
                raise Damaged("header line without colon")
            line = last + 2


def _plain(read: Callable[[int, int], bytes], at: int, size: int) -> tuple[dict[str, str], bytes, int]:
    """An uncompressed record: headers first, then as much as they say."""
    head = _head(read, at, size)
    length = next((v.strip() for n, _, v in (x.partition(b":") for x in head.split(b"\r\n")) if n.lower() == b"content-length"), b"")
    if not length.isdigit() or int(length) > size - at:
        raise Damaged("length")
    headers, block, used = parse_record(read(at, len(head) + 8 + int(length)))
    return headers, block, at + used


def record_at(read: Callable[[int, int], bytes], at: int, size: int) -> tuple[dict[str, str], bytes, int]:
    if read(at, 2) == b"\x1f\x8b":
        data, end = _inflate(read, at, size)
        headers, block, used = parse_record(data)
        if used != len(data):
            raise Damaged("more than one record in a member")
        return headers, block, end
    return _plain(read, at, size)


def next_start(read: Callable[[int, int], bytes], at: int, size: int) -> int:
    """The next place from ``at`` on where a member or a version line begins."""
    while at < size:
        block = read(at, min(STEP + 16, size - at))
        found = 0
        while True:
            spots = [p for p in (block.find(b"\x1f\x8b\x08", found), block.find(b"WARC/1.", found)) if p >= 0]
            if not spots or min(spots) >= STEP:
                break
            spot = min(spots)
            if block[spot : spot + 1] == b"W":
                if block[spot + 7 : spot + 10] in (b"0\r\n", b"1\r\n"):
                    return at + spot
            else:
                try:
                    if _inflate(read, at + spot, size, 16)[0].startswith(b"WARC/1."):
                        return at + spot
                except Damaged:
                    pass
            found = spot + 1
        at += STEP
    return size


def salvage(read: Callable[[int, int], bytes], size: int) -> Iterator[tuple[int, int, str | None, dict[str, str], bytes]]:
    """(begin, end, problem, headers, block) of all records (problem None) and gaps, in order; every byte is in one of them."""
    at, gap, problem = 0, None, ""
    while at < size:
        try:
            headers, block, end = record_at(read, at, size)
        except Damaged as error:
            if gap is None:
                gap, problem = at, str(error)
            at = next_start(read, at + 1, size)
            continue
        if gap is not None:
            yield gap, at, problem, {}, b""
            gap = None
        yield at, end, None, headers, block
        at = end
    if gap is not None:
        yield gap, size, problem, {}, b""


def read_archives(files: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and gaps (``problem`` set) of the files in column ``path``; payloads are left out on request."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in RECORDS.split(", ")]
        types = pa.schema([(n, pa.int64() if n in ("begin", "end", "payload_bytes") else pa.binary() if n == "payload" else pa.string()) for n in names])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = place(path)
                with store.open_input_file(name) as file:
                    rows, held = [], 0
                    for begin, end, problem, h, block in salvage(lambda at, n: file.read_at(n, at), file.size()):
                        revisit = h.get("warc-type") == "revisit"
                        digest = h.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else sha1_text(block)
                        length = int(h.get("warc-payload-length", "0")) if revisit else len(block)
                        rows.append((path, begin, end, problem, *(h.get(x) for x in ("warc-record-id", "warc-type", "warc-refers-to", "warc-target-uri")),
                                     *((None, None, None) if problem else (length, digest, block if payloads and not revisit else None))))
                        held += 500 + len(block) * payloads
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.types)], schema=types)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.types)], schema=types)

    return files.select("path").repartition(max(1, files.count())).mapInArrow(read, RECORDS)


def page_of(urn: str):
    return F.regexp_extract(urn, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


@register("op5_warc_salvage")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_archives(table(spark, sf_dir, "pages"), shared_dir(spark, "warc"))
    return read_archives(files, payloads=False).filter("problem is null").select(
        page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to")
    )
