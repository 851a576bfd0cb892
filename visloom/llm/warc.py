"""WARC archives packaged in ZIP files: written from pages, read by ranges without extraction.

A package holds ``archive/data.warc.gz`` (one gzip member per record) and ``indexes/index.jsonl``
(record id, offset, length), both stored uncompressed by ZIP, so a record is one byte range of the
package. Files are reached through pyarrow's file systems, on whatever store the folder is.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visloom.llm.common import Scratch, ship, texts_as_bytes

RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
PACKAGE_BYTES = 256 << 20  # a package is closed beyond this size
LEAST_PAYLOAD = 1000  # bytes from which equal payloads are stored once
READ_BYTES = 8 << 20  # neighbouring records read at once
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# ZIP structures: signatures and fixed parts as the format has them.
END_SIGNATURE, END = b"PK\x05\x06", struct.Struct("<4s4H2LH")
LOCATOR_SIGNATURE, LOCATOR = b"PK\x06\x07", struct.Struct("<4sLQL")
END64_SIGNATURE, END64 = b"PK\x06\x06", struct.Struct("<4sQ2H2L4Q")
ENTRY_SIGNATURE, ENTRY = b"PK\x01\x02", struct.Struct("<4s6H3L5H2L")
LOCAL_SIGNATURE, LOCAL = b"PK\x03\x04", struct.Struct("<4s5H3L2H")
ZIP64_EXTRA = 1


class Member(NamedTuple):
    """A stored member: its bytes are ``size`` bytes of the package from ``offset``."""

    name: str
    offset: int
    size: int


class BadPackage(ValueError):
    pass


def _range(file, offset: int, size: int) -> bytes:
    file.seek(offset)
    data = file.read(size)
    if len(data) != size:
        raise BadPackage(f"{size} bytes wanted at {offset}, {len(data)} there")
    return data


def _directory(file, total: int) -> tuple[int, int]:
    """Place and size of the central directory, by the ZIP64 records where the package has them."""
    tail_at = max(0, total - (END.size + 0xFFFF))
    tail = _range(file, tail_at, total - tail_at)
    at = tail.rfind(END_SIGNATURE)
    while at >= 0:  # the signature may also stand inside the comment
        if at + END.size <= len(tail) and at + END.size + END.unpack_from(tail, at)[-1] == len(tail):
            break
        at = tail.rfind(END_SIGNATURE, 0, at)
    if at < 0:
        raise BadPackage("no end of central directory")
    end = END.unpack_from(tail, at)
    size, place = end[5], end[6]
    locator_at = tail_at + at - LOCATOR.size
    if locator_at >= 0 and (0xFFFF in end[1:5] or 0xFFFFFFFF in (size, place)):
        signature, _, end64_at, _ = LOCATOR.unpack(_range(file, locator_at, LOCATOR.size))
        if signature == LOCATOR_SIGNATURE:
            end64 = END64.unpack(_range(file, end64_at, END64.size))
            if end64[0] != END64_SIGNATURE:
                raise BadPackage("no ZIP64 end of central directory where the locator points")
            size, place = end64[8], end64[9]
    return place, size


def stored_members(file, total: int) -> list[Member]:
    """The members of a package of ``total`` bytes; a compressed one cannot be read by ranges and is refused."""
    place, size = _directory(file, total)
    data = _range(file, place, size)
    out, at = [], 0
    while at < len(data):
        entry = ENTRY.unpack_from(data, at)
        if entry[0] != ENTRY_SIGNATURE:
            raise BadPackage(f"no central directory entry at {place + at}")
        method, packed, plain, name_size, extra_size, comment_size, local_at = (
            entry[4], entry[8], entry[9], entry[10], entry[11], entry[12], entry[16]
        )
        at += ENTRY.size
        name = data[at : at + name_size].decode("utf-8", "replace")
        extra = data[at + name_size : at + name_size + extra_size]
        at += name_size + extra_size + comment_size
        while len(extra) >= 4:
            kind, length = struct.unpack_from("<2H", extra)
            if kind == ZIP64_EXTRA:
                wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                local_at = next(wide) if local_at == 0xFFFFFFFF else local_at
            extra = extra[4 + length :]
        if name.endswith("/"):
            continue
        if method != zipfile.ZIP_STORED or packed != plain:
            raise BadPackage(f"{name} is compressed")
        local = LOCAL.unpack(_range(file, local_at, LOCAL.size))
        if local[0] != LOCAL_SIGNATURE:
            raise BadPackage(f"no local header of {name} at {local_at}")
        out.append(Member(name, local_at + LOCAL.size + local[9] + local[10], plain))
    return out


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit record (HTTP headers only) if the payload is stored elsewhere."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(block)),
    }
    if url is not None:
        head["WARC-Target-URI"] = "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in url)
    if revisit:
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _headers(text: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in text.decode().split("\r\n")[1:])}


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def read_record(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of one WARC record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _headers(head)
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise BadPackage("a record does not end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(_headers(http)["content-length"])
    told = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    revisit = fields["warc-type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != told):
        raise BadPackage(f"payload of {fields['warc-record-id']} does not match its headers")
    refers = _page(fields["warc-refers-to"]) if revisit else None
    return _page(fields["warc-record-id"]), size, told, fields["warc-type"], refers


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to): pages whose payload another page with a larger page_id stores.

    Only digests, lengths and ids are shuffled. Of equal payloads of LEAST_PAYLOAD bytes or
    more, the largest page_id keeps it; a null page_id is the least.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    narrow = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.sha1(html).alias("digest"), F.octet_length(html).alias("n"))
    narrow = narrow.where(F.col("n") >= LEAST_PAYLOAD).select("page_id", "digest")
    keepers = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("rows"))
    keepers = keepers.where("rows > 1").select("digest", "refers_to")
    again = narrow.join(keepers, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return again.where("refers_to IS NOT NULL").distinct()


def write_packages(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Write every page's record into packages below the shared folder: a table (path, n_records).

    A package's name is unique to the attempt that wrote it and only packages of finished tasks
    are in the table, so a repeated task leaves no half package in it.
    """
    folder = scratch.path("packages")
    narrow = revisits(pages).select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), "refers_to")
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    same = rows["page_id"].eqNullSafe(F.col("__id")) & (F.sha1("html") == F.col("__digest"))
    decided = rows.join(narrow, same, "left").select("page_id", "url", "html", "refers_to")

    def records(batches) -> Iterator[tuple[int | None, bytes]]:
        for batch in batches:
            columns = [batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_as_bytes(batch.column(2)), batch.column(3).to_pylist()]
            for page_id, url, payload, refers_to in zip(*columns, strict=True):
                yield page_id, gzip.compress(warc_record(page_id, url, payload, refers_to), 1, mtime=0)

    def package(store, path: str, first, more) -> int:
        """Write records into one package until it is full; the index comes after them."""
        index, at = [], 0
        with store.open_output_stream(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as packed:
            with packed.open(zipfile.ZipInfo(RECORDS), "w", force_zip64=True) as member:
                record = first
                while record is not None:
                    page_id, data = record
                    member.write(data)
                    index.append(json.dumps({"page_id": page_id, "offset": at, "length": len(data)}))
                    at += len(data)
                    record = next(more, None) if at < PACKAGE_BYTES else None
            packed.writestr(zipfile.ZipInfo(INDEX), "\n".join(index))
        return len(index)

    def write(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        more = records(batches)
        for record in more:
            name = f"{uuid.uuid4().hex}.zip"
            n = package(store, f"{root}/{name}", record, more)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], ["path", "n_records"])

    return scratch.put(decided.mapInArrow(write, "path string, n_records long"), "manifest")


def record_ranges(packages: DataFrame) -> DataFrame:
    """(path, page_id, offset, length): every record's byte range, from the packages' own indexes.

    Only directories and indexes are read. ``packages`` needs a column path.
    """
    ship(packages.sparkSession)

    def locate(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_file(place) as file:
                    members = {m.name: m for m in stored_members(file, file.size())}
                    start = members[RECORDS].offset
                    lines = _range(file, members[INDEX].offset, members[INDEX].size).decode().splitlines()
                entries = [json.loads(line) for line in lines]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * len(entries), pa.string()),
                        pa.array([e["page_id"] for e in entries], pa.int64()),
                        pa.array([start + e["offset"] for e in entries], pa.int64()),
                        pa.array([e["length"] for e in entries], pa.int64()),
                    ],
                    ["path", "page_id", "offset", "length"],
                )

    return packages.select("path").mapInArrow(locate, "path string, page_id long, offset long, length long")


def read_packages(packages: DataFrame) -> DataFrame:
    """Read every record of ``packages`` (path) by its range: one row per record.

    Ranges are dealt out in stretches of READ_BYTES, so a large package is read by many
    tasks; ranges next to each other are fetched together. A revisit's length and digest are
    those its headers keep of the full payload. A record that contradicts its headers is an error.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def stretches(rows):
        """Rows of neighbouring ranges, as (path, offset, size, [(offset, length)])."""
        path, parts = None, []
        for p, offset, length in rows:
            if parts and (p != path or offset != parts[-1][0] + parts[-1][1] or offset + length - parts[0][0] > READ_BYTES):
                yield path, parts
                parts = []
            path = p
            parts.append((offset, length))
        if parts:
            yield path, parts

    def read(batches):
        opened, file = None, None
        for batch in batches:
            out = []
            for path, parts in stretches(zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True)):
                if path != opened:
                    if file is not None:
                        file.close()
                    store, place = fs.FileSystem.from_uri(path)
                    opened, file = path, store.open_input_file(place)
                first = parts[0][0]
                data = _range(file, first, parts[-1][0] + parts[-1][1] - first)
                out += [read_record(gzip.decompress(data[a - first : a - first + n])) for a, n in parts]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            columns = list(zip(*out, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
        if file is not None:
            file.close()

    ranges = record_ranges(packages).select("path", "offset", "length", F.floor(F.col("offset") / READ_BYTES).alias("part"))
    dealt = ranges.repartition("path", "part").sortWithinPartitions("path", "offset").select("path", "offset", "length")
    return dealt.mapInArrow(
        read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to packages and read all records back: one row per page.

    Null html is an empty payload, a null url has no target header, a null page_id stays null and
    is never referred to. Repeated rows are one record each; rows that share the largest page_id of a
    payload are all responses. An empty table gives no rows.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    return read_packages(write_packages(pages, scratch))
