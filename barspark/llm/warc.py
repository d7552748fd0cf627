"""WARC archives: monolithic gzip files, and their rewriting as one gzip member per record with a sidecar offset index.

``write_monoliths``  every task writes its pages as WARC/1.1 response records into gzip streams of whole files;
``find_revisits``    of records with equal payloads the one with the largest page id stays a response;
``normalise``        each file's stream is inflated once, front to back, every record becomes a gzip member of its own (revisits lose
                     their payload), and a sidecar index says where each member lies;
``read_back``        members are read through the index, each by itself.

Files go through pyarrow's file systems to a folder that all executors share. A task writes under a new random name and
returns it; only the rows of tasks that end well name files that count, so lost or repeated tasks leave files
that nothing reads. Memory is bounded by a record and a piece of compressed stream.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import pick

DATE = "2024-01-01T00:00:00Z"
PIECE = 1 << 20
FILE_BYTES = 256 << 20  # payload bytes after which a task begins another file
REVISIT_BYTES = 1000
LEVEL = 6
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---------------------------------------------------------------- records


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", record)
    return int(m[1]) if m else None


def sha1_name(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def sha1_hex(name: str) -> str:
    return base64.b32decode(name.removeprefix("sha1:")).hex()


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def response(page_id: int | None, url: str | None, payload: bytes, digest: str) -> bytes:
    uri = quote(url or "", safe="!#$%&'()*+,/:;=?@[]~-._")
    return record([("WARC-Type", "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", uri),
                   ("WARC-Payload-Digest", sha1_name(digest)), ("Content-Type", "application/http; msgtype=response")], http_head(len(payload)) + payload)


def revisit(fields: dict[str, str], refers_to: int | None, payload_bytes: int) -> bytes:
    kept = [(k, fields[k]) for k in ("WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Payload-Digest", "Content-Type")]
    return record([("WARC-Type", "revisit"), *kept, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))], http_head(payload_bytes))


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of one whole record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    return fields, rest[:int(fields["Content-Length"])]


def records(stream: Iterator[bytes]) -> Iterator[bytes]:
    """Records of an inflated stream, one at a time."""
    buffer = bytearray()
    need = None
    for part in stream:
        buffer += part
        while True:
            if need is None:
                end = buffer.find(b"\r\n\r\n")
                if end < 0:
                    break
                length = re.search(rb"\r\ncontent-length:\s*(\d+)", buffer[:end], re.I)
                need = end + 4 + int(length[1]) + 4
            if len(buffer) < need:
                break
            yield bytes(buffer[:need])
            del buffer[:need]
            need = None
    if buffer:
        raise ValueError("the archive ends within a record")


def inflated(file: pa.NativeFile) -> Iterator[bytes]:
    """One pass over a gzip file of one or more members."""
    z = zlib.decompressobj(31)
    while part := file.read(PIECE):
        while part:
            yield z.decompress(part, 8 * PIECE)
            part = z.unconsumed_tail
            if z.eof:
                part, z = z.unused_data, zlib.decompressobj(31)
    yield z.flush()


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


# ---------------------------------------------------------------- steps


def write_monoliths(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write every row as a record; (file, ordinal, page_id, payload_bytes, digest) of each. Stage the result before using it twice.

    A null html is an empty payload, a null url an empty one; repeated rows are written one by one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _open(folder)
        store.create_dir(top)
        out = z = None
        name, ordinal, size = "", 0, 0

        def close() -> None:
            if out is not None:
                out.write(z.flush())
                out.close()

        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                page, link, text = (batch.column(c)[i].as_py() for c in range(3))
                if out is None or size >= FILE_BYTES:
                    close()
                    name, ordinal, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, z = store.open_output_stream(f"{top}/{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                payload = (text or "").encode("utf-8")
                digest = hashlib.sha1(payload).hexdigest()
                out.write(z.compress(response(page, link, payload, digest)))
                rows.append((name, ordinal, page, len(payload), digest))
                ordinal += 1
                size += len(payload)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["file", "ordinal", "page_id", "payload_bytes", "digest"])
        close()

    x = pick(pages, page_id=page_id, url=url, html=html).withColumn("page_id", F.col("page_id").cast("long"))
    return x.mapInArrow(run, "file string, ordinal long, page_id long, payload_bytes long, digest string")


def find_revisits(written: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(file, ordinal, refers_to) of the records whose payload, of ``least`` bytes or more, a record with a larger page id has too.

    Rows that repeat that largest id with the same payload stay responses; a null id counts as smaller than any other.
    """
    big = written.where(F.col("payload_bytes") >= least)
    kept = big.groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null").drop("n")
    return big.join(kept, ["digest", "payload_bytes"]).where("page_id is null or page_id <> refers_to").select("file", "ordinal", "refers_to")


def normalise(written: DataFrame, revisits: DataFrame, source: str, folder: str, files: int) -> DataFrame:
    """Rewrite each file under ``folder``, one gzip member per record, with ``<name>.idx``; (file) of each rewritten file.

    ``revisits`` are grouped by file, so a group is as large as a file's records at most.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _open(source)
        target, to = _open(folder)
        target.create_dir(to)
        for batch in batches:
            done = []
            for name, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                refers = {m["ordinal"]: m["refers_to"] for m in marks or ()}
                new, at = f"{uuid.uuid4().hex}.warc.gz", 0
                with store.open_input_stream(f"{top}/{name}", compression=None) as file, target.open_output_stream(f"{to}/{new}", compression=None) as out, target.open_output_stream(f"{to}/{new}.idx", compression=None) as index:
                    for n, raw in enumerate(records(inflated(file))):
                        if n in refers:
                            fields, block = parse(raw)
                            raw = revisit(fields, refers[n], len(block) - block.index(b"\r\n\r\n") - 4)
                        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = z.compress(raw) + z.flush()
                        out.write(member)
                        index.write(json.dumps({"offset": at, "length": len(member)}).encode() + b"\n")
                        at += len(member)
                done.append(new)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["file"])

    marks = revisits.groupBy("file").agg(F.collect_list(F.struct("ordinal", "refers_to")).alias("marks"))
    todo = written.select("file").distinct().join(marks, "file", "left").repartition(max(1, files), "file")
    return todo.mapInArrow(run, "file string")


def read_back(normalised: DataFrame, folder: str, files: int) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, file, offset) of every record, each member read by itself.

    A response's size and digest are those of its payload, and must agree with its fields; a revisit has both from its fields.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _open(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with store.open_input_stream(f"{top}/{name}.idx", compression=None) as index, store.open_input_file(f"{top}/{name}") as file:
                    for line in bytes(index.read()).splitlines():
                        place = json.loads(line)
                        fields, block = parse(zlib.decompress(file.read_at(place["length"], place["offset"]), 31))
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
                        digest = sha1_hex(fields["WARC-Payload-Digest"])
                        if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"{name} at {place['offset']}: payload and digest differ")
                        rows.append((page_of(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], page_of(fields.get("WARC-Refers-To", "")), name, place["offset"]))
                        if len(rows) >= 10_000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    return normalised.repartition(max(1, files), "file").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset"])
