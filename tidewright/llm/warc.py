"""Deduplicated WARC archives: write, resolve revisits, read back.

Records of equal payloads (SHA-1 and length) are one response, that of the
largest page_id, and revisits that refer to it. The largest page_id of each
digest is found by a partially aggregated group-by over headers alone; every
page then meets its digest's original in a join that splits hot digests, and
each task renders its records with fresh headers. Archives are written by
Spark's text sink, whose line separator is the end of a WARC record, so they go
to any file system Spark can write, and appear only when their task commits. A
task begins a new archive, with a warcinfo record of its own, when one has
``file_bytes``; so no file outgrows them by more than a record. Readers inflate
and parse a file piece by piece and hold one record at a time.

Defined cases: a null html counts as empty; payloads under ``least_bytes`` are
all responses; rows that repeat the original's page_id are responses too; a null
page_id stays null and is an original only among its like; a null url leaves the
target header out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE, END = "\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def _name(page: int | None) -> str:
    return f"<urn:x-page:{'' if page is None else page}>"


def _number(name: str) -> int | None:
    digits = name.removeprefix("<urn:x-page:").removesuffix(">")
    return int(digits) if digits else None


def _header(fields: list[tuple[str, str | None]]) -> str:
    clean = lambda v: v.replace("\r", "%0D").replace("\n", "%0A")
    return "WARC/1.1" + LINE + "".join(f"{k}: {clean(v)}{LINE}" for k, v in fields if v is not None) + LINE


def record(page: int | None, url: str | None, html: str, digest: str, size: int, original: int | None, original_url: str | None, date: str, revisit: bool) -> str:
    """One record without the separator after it."""
    block = f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: {size}{END}"
    fields: list[tuple[str, str | None]] = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _name(page)),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if revisit:
        fields += [("WARC-Refers-To", _name(original)), ("WARC-Refers-To-Target-URI", original_url), ("WARC-Refers-To-Date", date), ("WARC-Profile", PROFILE)]
        length = len(block)
    else:
        block, length = block + html, len(block) + size
    return _header([*fields, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(length))]) + block


def write(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 64 << 20) -> None:
    """Write archives of ``pages`` (page_id, url, html) of about ``file_bytes`` at most before compression."""
    html = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    originals = own.groupBy("digest", "size").agg(F.max(F.struct("page_id", "url")).alias("original"))
    joined = own.join(originals, ["digest", "size"]).select("page_id", "url", "html", "digest", "size", F.col("original.page_id").alias("original"), F.col("original.url").alias("original_url"))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about = f"format: WARC File Format 1.1{LINE}"
        task, archive, seq, filled = TaskContext.get().partitionId(), -1, 0, file_bytes
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple[str, str, int]] = []
                for page, url, text, sha, size, original, original_url in zip(*(c.to_pylist() for c in part.columns)):
                    digest = base64.b32encode(bytes.fromhex(sha)).decode()
                    made = record(page, url, text, digest, size, original, original_url, date, size >= least_bytes and page != original)
                    if filled + len(made) > file_bytes:
                        archive, filled = archive + 1, 0
                        info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-info:{task}-{archive}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(about)))]
                        rows.append((_header(info) + about, f"{task:06d}-{archive:06d}", seq))
                        seq += 1
                    rows.append((made, f"{task:06d}-{archive:06d}", seq))
                    seq, filled = seq + 1, filled + len(made.encode()) + len(END)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], names=["value", "archive", "seq"])

    records = joined.mapInArrow(render, "value string, archive string, seq long").sortWithinPartitions("archive", "seq")
    records.select("value", "archive").write.partitionBy("archive").options(lineSep=END, compression="gzip").text(path)


def _inflated(data: bytes, step: int = 1 << 18) -> Iterator[bytes]:
    """Pieces of an archive, compressed (any number of gzip members) or not."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[at : at + step] for at in range(0, len(data), step))
        return
    stream, at = zlib.decompressobj(31), 0
    while at < len(data) or stream.unconsumed_tail:
        piece = stream.unconsumed_tail
        if not piece:
            piece, at = data[at : at + step], min(at + step, len(data))
        yield stream.decompress(piece, 4 * step)
        if stream.eof:
            at -= len(stream.unused_data)
            stream = zlib.decompressobj(31)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of one archive, compressed or not."""
    pieces, held, at, offset = _inflated(data), bytearray(), 0, 0

    def until(found) -> int:
        """Read on until ``found`` gives a place, which is never negative."""
        while (place := found()) < 0:
            more = next(pieces, None)
            if more is None:
                raise ValueError(f"the archive ends within the record at byte {offset + at}")
            held.extend(more)
        return place

    while True:
        while len(held) == at and (more := next(pieces, None)) is not None:
            held.extend(more)
        if len(held) == at:
            return
        end = until(lambda: held.find(b"\r\n\r\n", at))
        lines = held[at:end].decode().split(LINE)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {offset + at}")
        headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
        start = end + 4
        stop = start + int(headers["content-length"])
        until(lambda: stop if len(held) >= stop + 4 else -1)
        yield headers, bytes(held[start:stop])
        if held[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {offset + at} does not end where it says")
        at = stop + 4
        if at > 1 << 20:
            del held[:at]
            offset, at = offset + at, 0


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page record, and whether its payload has that digest."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows: list[tuple] = []
                for headers, block in parse(batch.column(0)[k].as_py()):
                    kind = headers["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(head.rsplit(b"Content-Length: ", 1)[1])
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    intact = kind == "revisit" or size == len(payload) and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest
                    rows.append((_number(headers["warc-record-id"]), size, digest, kind, _number(headers["warc-refers-to"]) if kind == "revisit" else None, intact))
                columns = list(zip(*rows)) or [()] * 6
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(records, READ)
