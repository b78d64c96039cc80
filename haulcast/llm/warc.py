"""WARC archives: writing pages with revisit records, and a sequential reader.

Each record is one gzip member. The reader inflates members step by step, frames
records by their Content-Length, and checks the block and payload digests.

Edge cases: a null html is an empty payload. Page ids may be null or repeated: all
rows that hold the largest id of a group of equal payloads are responses. A null
URL is written as an empty target. Payloads under 1000 bytes are never revisits,
however often they occur. An empty table gives no archive and no rows. Columns
besides page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulcast.operators.keyed import KeyedTable
from haulcast.session import materialise, shared_dir

MIN_REVISIT_BYTES = 1_000
ARCHIVE_BYTES = 256 << 20
STEP = 1 << 16
DATE = "2000-01-01T00:00:00Z"
# Fixed value: the profile of revisits found by equal payloads.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that breaks the format or a digest."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def type(self) -> str:
        return self.headers["warc-type"]

    def http(self) -> tuple[dict[str, str], bytes]:
        """HTTP headers (lower-case names) and payload of the block."""
        head, _, payload = self.block.partition(b"\r\n\r\n")
        return _fields(head.split(b"\r\n")[1:]), payload


def _fields(lines: list[bytes]) -> dict[str, str]:
    return {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines)}


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _page_uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_id(uri: str | None) -> int | None:
    number = re.fullmatch(r"<urn:page:(-?\d*)>", uri or "<urn:page:>")
    if number is None:
        raise WarcError(f"unknown record id {uri!r}")
    return int(number[1]) if number[1] else None


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP headers and leaves out the payload."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url or "")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _page_uri(page_id)), ("WARC-Date", DATE),
        ("WARC-Target-URI", target), ("WARC-Payload-Digest", _sha1(payload)), ("WARC-Block-Digest", _sha1(block)),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields[2:2] = [("WARC-Profile", PROFILE), ("WARC-Refers-To", _page_uri(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def _members(stream) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, each as its inflated chunks of at most ``STEP`` bytes."""
    data = stream.read(STEP)

    def inflate() -> Iterator[bytes]:
        nonlocal data
        inflater = zlib.decompressobj(31)
        while not inflater.eof:
            if not data and not (data := stream.read(STEP)):
                raise WarcError("the archive ends inside a gzip member")
            chunk = inflater.decompress(data, STEP)
            data = inflater.unconsumed_tail or inflater.unused_data
            while not inflater.eof and not data and chunk:
                # output may be pending although the input is used up
                yield chunk
                chunk = inflater.decompress(b"", STEP)
            if chunk:
                yield chunk

    while data:
        yield inflate()
        data = data or stream.read(STEP)


def read_records(stream) -> Iterator[Record]:
    """Read an archive from its start to its end, one record in memory at a time."""
    for member in _members(stream):
        held = bytearray()
        while (end := held.find(b"\r\n\r\n")) < 0:
            chunk = next(member, None)
            if chunk is None:
                raise WarcError("a record without an end of its headers")
            held += chunk
        lines = bytes(held[:end]).split(b"\r\n")
        if not lines[0].startswith(b"WARC/1."):
            raise WarcError(f"not a WARC record: {lines[0][:40]!r}")
        headers = _fields(lines[1:])
        block, length = held[end + 4:], int(headers["content-length"])
        for chunk in member:
            block += chunk
        if len(block) != length + 4 or block[length:] != b"\r\n\r\n":
            raise WarcError(f"{headers['warc-record-id']}: {len(block) - 4} bytes of block, {length} declared")
        record = Record(headers, bytes(block[:length]))
        if headers.get("warc-block-digest", _sha1(record.block)) != _sha1(record.block):
            raise WarcError(f"{headers['warc-record-id']}: wrong block digest")
        if record.type == "response" and headers.get("warc-payload-digest") != _sha1(record.http()[1]):
            raise WarcError(f"{headers['warc-record-id']}: wrong payload digest")
        yield record


def _open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri if ":" in uri else f"file://{uri}"))


def plan_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Pages with their payload and ``refers_to``: the largest page id with the same payload, null for responses.

    Only digests, lengths and ids are grouped. Repeated payloads are few rows next
    to the pages, and are attached to them without moving the pages where they fit.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("_digest"))
    repeated = (
        rows.filter(F.octet_length("payload") >= min_bytes).groupBy("_digest")
        .agg(F.count("*").alias("_n"), F.max("page_id").alias("_largest")).filter("_n > 1")
    )
    known = KeyedTable.of(materialise(repeated, "payloads"), "_digest", "_n").attach(rows)
    return known.select("page_id", "url", "payload", F.when(
        F.col("_largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_largest")), F.col("_largest")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write planned pages to ``.warc.gz`` files in a shared folder; returns (archive, records).

    Each attempt of a task writes files of its own name, and only the names in the
    result count, so a repeated or speculative task does no harm.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _open_folder(folder)
        out, name, size, records, done, part = None, "", 0, 0, [], 0
        for batch in batches:
            columns = batch["page_id"].astype("Int64"), batch["url"], batch["payload"], batch["refers_to"].astype("Int64")
            for page_id, url, payload, refers_to in zip(*columns):
                if out is None:
                    name = f"pages-{TaskContext.get().taskAttemptId()}-{part}.warc.gz"
                    out, size, records, part = system.open_output_stream(f"{root}/{name}", compression=None), 0, 0, part + 1
                revisit = not pd.isna(refers_to)
                member = record_bytes(None if pd.isna(page_id) else int(page_id), url, bytes(payload),
                                      int(refers_to) if revisit else None, revisit)
                out.write(member)
                size, records = size + len(member), records + 1
                if size >= archive_bytes:
                    out.close()
                    done.append((name, records))
                    out = None
        if out is not None:
            out.close()
            done.append((name, records))
        yield pd.DataFrame(done, columns=["archive", "records"])

    system, root = _open_folder(folder)
    system.create_dir(root, recursive=True)
    return materialise(pages.mapInPandas(write, "archive string, records long"), "archives")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to; a task per archive."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _open_folder(folder)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for name in (n for batch in batches for n in batch["archive"]):
            rows = []
            with system.open_input_stream(f"{root}/{name}", compression=None) as stream:
                for record in read_records(stream):
                    headers = record.headers
                    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                    rows.append((_page_id(headers["warc-record-id"]), int(record.http()[0]["content-length"]), digest,
                                 record.type, _page_id(headers.get("warc-refers-to"))))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
                        rows = []
            yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    count = max(1, archives.count())
    return archives.repartition(count, "archive").mapInPandas(read, schema)


def archive_round_trip(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(plan_revisits(pages), folder, archive_bytes), folder)
