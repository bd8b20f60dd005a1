"""WARC archives: write records in gzip members, read them back in splits.

The reader is splittable: a task scans its byte range for the gzip magic, takes a candidate for a member
only if its first bytes inflate to a WARC header, and owns the records that start inside its range,
reading past the range's end to complete the last one.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, shared_dir

#: Payloads of fewer bytes are never revisits.
MIN_REVISIT_BYTES = 100
SPLIT_BYTES, STEP, LEVEL = 8 << 20, 1 << 20, 3
DATE = "2000-01-01T00:00:00Z"
MAGIC = b"\x1f\x8b\x08"
#: How a record begins: its version and the name of a first header, whichever that is.
BEGIN = re.compile(rb"WARC/\d+\.\d+\r\n[!-9;-~]+[ \t]*:")
#: Bytes that a member's head is looked for in, and bytes fed to the inflater at a time.
HEAD, PIECE = 4096, 1 << 14
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, archive string, archive_offset long"


def _line(value: str) -> str:
    """A header value on one line: control characters and white space are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) <= 32 or ord(c) == 127 else c for c in value)


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    """The page_id in a record's name; null in names that others gave."""
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record; a revisit keeps the HTTP header, with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _headers(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers up to the first empty line, in whatever order and number, and what follows; folded lines are joined."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}, rest


def write(pages: DataFrame, directory: str, payload: str = "html", url: str = "url", page_id: str = "page_id", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write an archive for each partition of ``pages``; returns a table (archive, size) of what was written.

    Of records with equal payloads of at least ``min_bytes`` bytes, that with the smallest page_id is a
    response, and the others are revisits of it; rows that share the smallest page_id are responses all.
    A null payload is empty; a null page_id counts as larger than any; if all are null, all are responses.
    Archives are renamed into place, so a repeated task replaces its own file. Only digests that occur
    more than once are joined; payloads are shuffled only if those are many.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    groups = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = cut(groups.where("n > 1").select(F.col("digest").alias("of"), "first"), "payloads")
    rows = rows.join(groups, rows.digest == groups.of, "left").drop("of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, base = fs.FileSystem.from_uri(directory)
        store.create_dir(base, recursive=True)
        name = f"part-{context.partitionId():06d}.warc.gz"
        draft, size, out = f"{base}/.{name}.{context.taskAttemptId()}", 0, None
        for batch in batches:
            for i in range(batch.num_rows):
                p, u, data, digest, first = (batch.column(k)[i].as_py() for k in range(5))
                revisit = first is not None and p != first
                if out is None:
                    out = store.open_output_stream(draft)
                packed = _member(record(p, u, data, digest, first, revisit))
                out.write(packed)
                size += len(packed)
        if out is not None:
            out.close()
            store.move(draft, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([f"{directory}/{name}"]), pa.array([size], pa.int64())], names=["archive", "size"])

    return cut(rows.select("page_id", "url", "payload", "digest", "first").mapInArrow(run, "archive string, size long"), "archives")


def _begins_record(data: bytes) -> bool:
    try:
        return bool(BEGIN.match(zlib.decompressobj(31).decompress(data, 512)))
    except zlib.error:
        return False


def members(stream, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, inflated content) of the members that start in [start, end) of an open archive.

    The buffer holds ``STEP`` bytes and is fed to the inflater piece by piece, so time grows in proportion
    to the archive, however long a record is. A member that is cut short raises, and so does anything but a
    record at the archive's begin or after a record, so that none is passed over.
    """
    begin, buffer, known = start, b"", start == 0

    def have(at: int, n: int) -> memoryview:
        nonlocal begin, buffer
        if begin + len(buffer) < min(at + n, size):
            kept = buffer[at - begin :]
            stream.seek(at + len(kept))
            buffer, begin = kept + stream.read(min(STEP, size - at - len(kept))), at
        return memoryview(buffer)[at - begin : at - begin + n]

    at = start
    while at < end:
        head = bytes(have(at, HEAD))
        if not head.startswith(MAGIC) or not _begins_record(head):
            if known:
                raise ValueError(f"no record at byte {at}")
            found = buffer.find(MAGIC, at - begin + 1)
            # no magic in what is here: go on with its last two bytes, which may begin one
            at = begin + found if found > 0 else max(at + 1, begin + len(buffer) - 2)
            continue
        unpacker, out, fed = zlib.decompressobj(31), [], at
        while not unpacker.eof:
            piece = have(fed, PIECE)
            if not len(piece):
                raise ValueError(f"the member at byte {at} is cut short")
            out.append(unpacker.decompress(piece))
            fed += len(piece)
        yield at, b"".join(out)
        at, known = fed - len(unpacker.unused_data), True
    if known and at < size and not _begins_record(bytes(have(at, HEAD))):  # the next split looks for a record and would pass over this
        raise ValueError(f"no record at byte {at}")


def _hex(digest: str | None) -> tuple[str | None, str | None]:
    """(algorithm, hexadecimal digits) of a digest header in hexadecimal or base 32; nulls if it is absent or of an unknown algorithm."""
    name, _, value = (digest or "").partition(":")
    name = name.lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha384", "sha512"):
        return None, None
    if len(value) == 2 * hashlib.new(name).digest_size:
        return name, value.lower()
    try:
        return name, base64.b32decode(value.upper() + "=" * (-len(value) % 8)).hex()
    except ValueError:
        return None, None


def parse(content: bytes) -> tuple[int | None, int | None, str | None, str, int | None, str | None]:
    """page_id, payload bytes, digest, type, refers_to and URI of a record of any type and writer.

    The payload is what follows the HTTP header in blocks of type application/http, else the block; its SHA-256
    is computed, and a digest in the header, of whatever known algorithm, is checked. Revisits have no payload:
    their bytes are those of the HTTP header's Content-Length and their digest the header's if it is a SHA-256,
    else null. page_id and refers_to are null where a name is not one that ``write`` gives.
    """
    head, block = _headers(content)
    name = head.get("warc-record-id")
    if "warc-type" not in head or not head.get("content-length", "").isdigit():
        raise ValueError(f"record {name}: no WARC-Type or Content-Length")
    size = int(head["content-length"])
    if len(block) < size:
        raise ValueError(f"record {name}: {len(block)} bytes of {size}")
    kind, body, http = head["warc-type"].lower(), block[:size], {}
    if head.get("content-type", "").lower().replace(" ", "").startswith("application/http"):
        http, body = _headers(body)
    algorithm, given = _hex(head.get("warc-payload-digest"))
    if kind == "revisit":
        length = http.get("content-length", "")
        return _page(name), int(length) if length.isdigit() else None, given if algorithm == "sha256" else None, kind, _page(head.get("warc-refers-to")), head.get("warc-target-uri")
    if algorithm and (own := hashlib.new(algorithm, body).hexdigest()) != given:
        raise ValueError(f"record {name}: payload digest {own}, header {given}")
    return _page(name), len(body), hashlib.sha256(body).hexdigest(), kind, None, head.get("warc-target-uri")


def read(archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of the archives in a table (archive, size), read in splits of ``split_bytes``; columns as in ``SCHEMA``.

    A record is read by the split it starts in, whole, however long it is. A member that is cut short or a
    response whose payload is not that of its digest raises. No archives give an empty result.
    """
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start")
    splits = archives.where("size > 0").select("archive", "size", starts)
    splits = splits.select("archive", "size", "start", F.least(F.col("start") + split_bytes, F.col("size")).alias("end"))
    # a split to a task: a given number of partitions is not coalesced, though the rows are small
    splits = splits.repartition(max(1, min(splits.count(), 100_000)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(s["archive"])
                with store.open_input_file(path) as stream:
                    rows = [(*parse(content), s["archive"], at) for at, content in members(stream, s["size"], s["start"], s["end"])]
                cols = list(zip(*rows, strict=True)) or [[]] * 8
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return splits.mapInArrow(run, SCHEMA)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    return read(write(pages, f"{shared_dir(pages.sparkSession)}/tidemark/warc-{uuid.uuid4().hex}", **options))
