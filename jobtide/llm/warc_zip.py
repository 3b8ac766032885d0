"""WARC records in ZIP archives, read by range.

An archive holds gzipped WARC files as stored (uncompressed) members and one index member, a line of JSON per record
with the member, offset and length. The reader parses the end record, the ZIP64 records and the central directory,
finds the stored members and the index, and reads single records by their byte ranges; nothing is extracted.
"""

from __future__ import annotations

import base64
import binascii
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.llm.common import prepare, staged, staging_path, utf8

#: Payloads under this many bytes never become revisits.
REVISIT_BYTES = 1000
#: Bytes of a WARC member, and of an archive, after which the next one begins.
MEMBER_BYTES, ARCHIVE_BYTES = 16 << 20, 512 << 20
#: Bytes of records that one task row asks for.
RANGE_BYTES = 4 << 20
INDEX = "indexes/index.cdxj"
#: Fixed values of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF
DATE = 0x21  # 1 January 1980


class ZipWriter:
    """Writes stored members to a stream that can't be rewound; ``zip64`` forces the large fields."""

    def __init__(self, stream, zip64: bool = False):
        self.stream, self.zip64 = stream, zip64
        self.at, self.directory = 0, []

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        start, crc, encoded = self.at, binascii.crc32(data), name.encode()
        self._put(LOCAL + struct.pack("<5H3I2H", 45, 0x800, 0, 0, DATE, crc, len(data), len(data), len(encoded), 0) + encoded)
        self._put(data)
        large = self.zip64 or start >= MAX32
        extra = struct.pack("<2H3Q", 1, 24, len(data), len(data), start) if large else b""
        size, offset = (MAX32, MAX32) if large else (len(data), start)
        self.directory.append(
            CENTRAL + struct.pack("<6H3I5H2I", 45, 45, 0x800, 0, 0, DATE, crc, size, size, len(encoded), len(extra), 0, 0, 0, 0, offset)
            + encoded + extra
        )

    def close(self) -> None:
        start, n = self.at, len(self.directory)
        for entry in self.directory:
            self._put(entry)
        size = self.at - start
        if self.zip64 or start >= MAX32 or n >= MAX16:
            at = self.at
            self._put(END64 + struct.pack("<Q2H2I4Q", 44, 45, 45, 0, 0, n, n, size, start))
            self._put(LOCATOR64 + struct.pack("<IQI", 0, at, 1))
            n, size, start = MAX16, MAX32, MAX32
        self._put(END + struct.pack("<4H2IH", 0, 0, n, n, size, start, 0))
        self.stream.close()


def _range(file, offset: int, length: int) -> bytes:
    file.seek(offset)
    data = file.read(length)
    if len(data) < length:
        raise ValueError("archive is cut short")
    return data


def central_directory(file, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (method, local header offset, stored size), out of the directory at the end of the archive."""
    tail_at = max(0, size - 22 - MAX16)
    tail = _range(file, tail_at, size - tail_at)
    end = tail.rfind(END)
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    locator = _range(file, tail_at + end - 20, 20) if tail_at + end >= 20 else b""
    if locator[:4] == LOCATOR64 and (count == MAX16 or MAX32 in (length, start)):
        record = _range(file, struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<3Q", record, 32)
    data, at, members = _range(file, start, length), 0, {}
    for _ in range(count):
        if data[at : at + 4] != CENTRAL:
            raise ValueError("central directory is damaged")
        (method,) = struct.unpack_from("<H", data, at + 10)
        stored, plain = struct.unpack_from("<2I", data, at + 20)
        name_n, extra_n, comment_n = struct.unpack_from("<3H", data, at + 28)
        (offset,) = struct.unpack_from("<I", data, at + 42)
        name = data[at + 46 : at + 46 + name_n].decode()
        extra, x = data[at + 46 + name_n : at + 46 + name_n + extra_n], 0
        while x + 4 <= len(extra):
            tag, n = struct.unpack_from("<2H", extra, x)
            if tag == 1:
                # Only the fields that are full in the fixed part are there, in this order.
                large = iter(struct.unpack_from(f"<{n // 8}Q", extra, x + 4))
                plain = next(large) if plain == MAX32 else plain
                stored = next(large) if stored == MAX32 else stored
                offset = next(large) if offset == MAX32 else offset
            x += 4 + n
        members[name] = (method, offset, stored)
        at += 46 + name_n + extra_n + comment_n
    return members


def member_start(file, offset: int) -> int:
    """Where the bytes of a member begin: its local header has lengths of its own."""
    header = _range(file, offset, 30)
    if header[:4] != LOCAL:
        raise ValueError("no local header")
    return offset + 30 + sum(struct.unpack_from("<2H", header, 26))


def _record(kind: str, page_id, url: str, payload: bytes, size: int, digest: str, refers_to, kept_digest: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    headers = {
        "WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{page_id}>", "WARC-Date": "2024-01-01T00:00:00Z",
        "WARC-Target-URI": url.replace("\r", "%0D").replace("\n", "%0A"), "WARC-Payload-Digest": f"sha1:{kept_digest}",
    }
    if kind == "revisit":
        headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    headers |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of one WARC record; the payload digest of a response is computed anew and checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = base64.b32decode(field["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    page = lambda name: None if (x := field[name][10:-1]) == "None" else int(x)
    kind = field["WARC-Type"]
    if kind == "response":
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        if digest != told:
            raise ValueError(f"payload digest of {field['WARC-Record-ID']} does not match")
    return {
        "page_id": page("WARC-Record-ID"), "url": field["WARC-Target-URI"], "record_type": kind, "payload_bytes": size, "payload_digest": told,
        "refers_to": page("WARC-Refers-To") if kind == "revisit" else None, "payload": payload if kind == "response" else None,
    }


def mark_revisits(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """page_id, url, payload, digest and keeper: the largest id among equal payloads of REVISIT_BYTES or more, if several rows have it."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), utf8(html).alias("payload"))
    rows = rows.withColumns({"digest": F.unhex(F.sha1("payload")), "size": F.length("payload")})
    groups = (
        rows.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size")
        .agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1").drop("n")
    )
    return rows.join(groups, ["digest", "size"], "left").select("page_id", "url", "payload", "digest", "keeper")


def write_archives(marked: DataFrame, folder: str, zip64: bool = False) -> DataFrame:
    """Write the rows of ``mark_revisits`` as archives into a folder that all executors share; (archive, size) of each.

    A task writes archives under names of its own; those of failed attempts are in no result row and never read.
    """
    prepare(marked.sparkSession)

    def write(batches):
        target, at = fs.FileSystem.from_uri(folder)
        target.create_dir(at, recursive=True)
        zipped = None

        def add_member():
            nonlocal member, size
            if size:
                zipped.add(f"archive/data-{len(zipped.directory):05d}.warc.gz", b"".join(member))
            member, size = [], 0

        def close():
            add_member()
            zipped.add(INDEX, "".join(index).encode())
            zipped.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([zipped.at], pa.int64())], names=["archive", "size"])

        member, size, index, name = [], 0, [], ""
        for batch in batches:
            for row in range(batch.num_rows):
                page_id, url, payload, digest, keeper = (c[row].as_py() for c in batch.columns)
                if zipped is None:
                    name = f"pages-{uuid.uuid4().hex}.wacz"
                    zipped, index = ZipWriter(target.open_output_stream(f"{at}/{name}"), zip64), []
                kind = "revisit" if keeper is not None and page_id != keeper else "response"
                data = gzip.compress(
                    _record(kind, page_id, url, payload, len(payload), digest.hex(), keeper, base64.b32encode(digest).decode()), 6, mtime=0
                )
                place = {"filename": f"archive/data-{len(zipped.directory):05d}.warc.gz", "offset": size, "length": len(data)}
                index.append(f"page:{page_id} 20240101000000 {json.dumps(place)}\n")
                member.append(data)
                size += len(data)
                if size >= MEMBER_BYTES:
                    add_member()
                if zipped.at >= ARCHIVE_BYTES:
                    yield close()
                    zipped = None
        if zipped is not None:
            yield close()

    return marked.mapInArrow(write, "archive string, size long")


def locate(archives: DataFrame, folder: str) -> DataFrame:
    """(archive, offset, lengths) of runs of records: member places out of the directories, record places out of the indexes."""

    def find(batches):
        source, at = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for archive, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with source.open_input_file(f"{at}/{archive}") as file:
                    members = central_directory(file, size)
                    # Only stored members can be read by range.
                    starts = {n: member_start(file, offset) for n, (method, offset, _) in members.items() if method == 0}
                    index = _range(file, starts[INDEX], members[INDEX][2]).decode()
                runs, last = [], None
                for line in index.splitlines():
                    place = json.loads(line.split(" ", 2)[2])
                    begin = starts[place["filename"]] + place["offset"]
                    if last != begin or sum(runs[-1][1]) >= RANGE_BYTES:
                        runs.append((begin, []))
                    runs[-1][1].append(place["length"])
                    last = begin + place["length"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([archive] * len(runs), pa.string()), pa.array([r[0] for r in runs], pa.int64()), pa.array([r[1] for r in runs], pa.list_(pa.int64()))],
                    names=["archive", "offset", "lengths"],
                )

    return archives.mapInArrow(find, "archive string, offset long, lengths array<long>")


def read_records(places: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to and, unless left out, payload of every record placed."""
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payload
    kinds = {"payload_bytes": pa.int64(), "page_id": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def read(batches):
        source, at = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for archive, offset, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                with source.open_input_file(f"{at}/{archive}") as file:
                    data = _range(file, offset, sum(lengths))
                records, begin = [], 0
                for n in lengths:
                    records.append(parse_record(zlib.decompress(data[begin : begin + n], 31)))
                    begin += n
                names = [f.split()[0] for f in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in records], kinds.get(c, pa.string())) for c in names], names=names)

    return places.mapInArrow(read, schema)


def archive_pages(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", zip64: bool = False) -> DataFrame:
    """Write every page as a WARC record of ZIP archives in ``folder``; the archives written, as a stored table.

    A null html is an empty payload, a null url an empty one. Among equal payloads of REVISIT_BYTES or more the row with
    the largest id is the response and the others revisit it; rows that tie on that id are responses, null ids rank
    lowest, and equal payloads that all have null ids are responses. Other columns are not read. No pages, no archives.
    """
    return staged(write_archives(mark_revisits(pages, page_id, url, html), folder, zip64), "archives")


def read_archives(archives: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """All records of the archives, spread over tasks by byte ranges."""
    n = prepare(archives.sparkSession)
    return read_records(locate(archives.repartition(n), folder).repartition(n), folder, payload)


def new_folder(spark: SparkSession) -> str:
    path = staging_path(spark, "warc")
    return path if ":" in path else f"file://{path}"
