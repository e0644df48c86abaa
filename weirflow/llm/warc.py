"""Web archives packed in ZIP files: written by tasks, and read by byte ranges without unpacking.

A package holds one stored member of gzipped WARC records, each a gzip stream of its
own, and an index with the place of every record. The reader takes the central directory from the end of the file,
turns index entries into absolute byte ranges, and deals these, not files, to tasks. Files are opened by
pyarrow, so a folder may be anything that it has a file system for; executors must reach it.
"""

from __future__ import annotations

import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.session import materialize, new_folder

# A package is closed and the next one begun at so many records or bytes; bounds the index a task holds.
RECORDS_PER_PACKAGE = 20_000
BYTES_PER_PACKAGE = 256 << 20
SMALLEST_REVISIT = 100
_ARCHIVE, _INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- writing ---------------------------------------------------------------------------------------------------------


def revisits(pages: DataFrame, smallest: int = SMALLEST_REVISIT) -> DataFrame:
    """(page_id, digest, refers_to) for pages whose payload an earlier page_id has too.

    Payloads under ``smallest`` bytes are never revisits. Rows may share a page_id, so a payload is known by both. Only
    digests and ids are shuffled.
    """
    facts = pages.where("page_id is not null").select(
        F.col("page_id").cast("long"), F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("size")
    )
    long = facts.where(F.col("size") >= smallest).select("page_id", "digest")
    first = long.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    first = materialize(first.where("n > 1").select("digest", "refers_to"), "payloads")
    return long.join(first, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, digest: str, date: str) -> bytes:
    """One WARC record; that of a revisit has the HTTP head but no payload."""
    payload = (html or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": quote(url or "", safe=":/?#[]@!$&'()*+,;=%~-._"),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is not None:
        head |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": _PROFILE}
        payload = b""
    block = http.encode() + payload
    head["Content-Length"] = str(len(block))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_packages(pages: DataFrame, folder: str, smallest: int = SMALLEST_REVISIT, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row of pages (page_id, url, html); returns the packages: (path, size, records).

    A null html is an empty payload, a null url an empty address; a row without page_id is a response. Rows that share a page_id
    are records of their own: each revisits the first page with its payload, or is a response. A task writes
    packages under names of its own and reports them when they are closed, so what a lost or repeated task left
    behind is in no list and is never read.
    """
    found = revisits(pages, smallest).select(F.col("page_id").alias("of"), F.col("digest").alias("same"), "refers_to")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    rows = rows.join(found, (F.col("page_id") == F.col("of")) & (F.col("digest") == F.col("same")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        row = next(rows, None)
        while row is not None:
            name, index, at = f"{uuid.uuid4().hex}.wacz", [], 0
            with system.open_output_stream(f"{root}/{name}") as out:
                with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
                    with package.open(_ARCHIVE, "w", force_zip64=True) as member:
                        while row is not None and len(index) < RECORDS_PER_PACKAGE and at < BYTES_PER_PACKAGE:
                            packed = _gzip(record(*row, date))
                            member.write(packed)
                            entry = {"filename": "data.warc.gz", "offset": at, "length": len(packed)}
                            index.append(f"{quote(row[1] or '-', safe=':/')} {date} {json.dumps(entry)}\n")
                            at += len(packed)
                            row = next(rows, None)
                    package.writestr(_INDEX, "".join(index))
            package = (f"{folder}/{name}", system.get_file_info(f"{root}/{name}").size, len(index))
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in package], names=["path", "size", "records"])

    columns = rows.select("page_id", "url", "html", "refers_to", "digest")
    return materialize(columns.mapInArrow(run, "path string, size long, records long"), "packages")


# --- reading ---------------------------------------------------------------------------------------------------------


def members(read, size: int) -> dict[str, tuple[int, int, int, int]]:
    """Members of a ZIP file by name: (method, place of the local header, packed size, size).

    ``read(start, length)`` gives bytes of the file. The end record is sought from the end; where its numbers are at their limit,
    the ZIP64 end record that the locator before it points to has them, and so do ZIP64 fields of entries.
    """
    tail_at = max(0, size - (1 << 16) - 22 - 20)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of a central directory: not a ZIP file, or cut off")
    count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    if (count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF) and tail[end - 20 : end - 16] == b"PK\x06\x07":
        (at,) = struct.unpack("<Q", tail[end - 12 : end - 4])
        wide = read(at, 56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 locator points to something else")
        count, length, start = struct.unpack("<QQQ", wide[32:56])
    directory, found, at = read(start, length), {}, 0
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        (method,) = struct.unpack("<H", directory[at + 10 : at + 12])
        packed, whole, n, e, c = struct.unpack("<IIHHH", directory[at + 20 : at + 34])
        (local,) = struct.unpack("<I", directory[at + 42 : at + 46])
        name = directory[at + 46 : at + 46 + n].decode()
        extra, k = directory[at + 46 + n : at + 46 + n + e], 0
        while k + 4 <= len(extra):
            tag, width = struct.unpack("<HH", extra[k : k + 4])
            if tag == 1:  # only numbers at their limit are in it, in this order
                wide = iter(struct.iter_unpack("<Q", extra[k + 4 : k + 4 + width // 8 * 8]))
                whole = next(wide)[0] if whole == 0xFFFFFFFF else whole
                packed = next(wide)[0] if packed == 0xFFFFFFFF else packed
                local = next(wide)[0] if local == 0xFFFFFFFF else local
            k += 4 + width
        found[name] = (method, local, packed, whole)
        at += 46 + n + e + c
    return found


def _data_at(read, local: int) -> int:
    """Where a member's data begins: its local header has fields of a length of its own."""
    head = read(local, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no member where the directory says")
    n, e = struct.unpack("<HH", head[26:30])
    return local + 30 + n + e


def locate(read, size: int) -> list[tuple[int, int]]:
    """Absolute byte ranges (start, length) of all records of a package, by its indexes."""
    found, ranges = members(read, size), []
    for name, (method, local, packed, _) in found.items():
        if not name.startswith("indexes/"):
            continue
        data = read(_data_at(read, local), packed)
        data = zlib.decompress(data, -15) if method == 8 else data
        starts: dict[str, int] = {}
        for line in data.decode().splitlines():
            entry = json.loads(line[line.index("{") :])
            member = f"archive/{entry['filename']}"
            if member not in starts:
                if found[member][0] != 0:
                    raise ValueError(f"{member} is compressed as a whole, so its records have no byte ranges")
                starts[member] = _data_at(read, found[member][1])
            ranges.append((starts[member] + int(entry["offset"]), int(entry["length"])))
    return ranges


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one unpacked record; field names in lower case."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}, payload


def packages_in(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size) of the packages in a folder, without reading them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wacz").load(folder)
    return files.select("path", F.col("length").alias("size"))


def read_packages(packages: DataFrame) -> DataFrame:
    """One row per record of the packages (path, size).

    record_id, record_type, url, payload (null for a revisit), payload_digest and payload_bytes as the record states them,
    refers_to. First the indexes are read, one package at a time; then the ranges are spread evenly, whatever the size of the packages.
    """

    def opened(path: str):
        system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        return system.open_input_file(inner)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with opened(path) as file:
                    ranges = locate(lambda start, length: file.read_at(length, start), size)
                columns = [pa.array([path] * len(ranges)), *(pa.array([r[k] for r in ranges], pa.int64()) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "start", "length"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "record_type", "url", "payload", "payload_digest", "payload_bytes", "refers_to"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.string()]
        now, file = None, None
        for batch in batches:
            out: list[tuple] = []
            for path, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != now:
                    if file is not None:
                        file.close()
                    now, file = path, opened(path)
                fields, http, payload = parsed(zlib.decompress(file.read_at(length, start), 31))
                kind = fields["warc-type"]
                size = len(payload) if kind == "response" else int(http["content-length"])
                digest = fields["warc-payload-digest"].removeprefix("sha256:")
                body = payload if kind == "response" else None
                out.append((fields["warc-record-id"], kind, fields["warc-target-uri"], body, digest, size, fields.get("warc-refers-to")))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    ranges = packages.select("path", "size").repartition("path").mapInArrow(find, "path string, start long, length long")
    spread = ranges.repartition("path", "start").sortWithinPartitions("path", "start")
    return spread.mapInArrow(
        fetch,
        "record_id string, record_type string, url string, payload binary, payload_digest string, payload_bytes long, refers_to string",
    )


def archive_and_read(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the pages to packages in ``folder`` (else among the session's steps, which ``drop_steps`` deletes) and reads them back."""
    target = folder or new_folder(pages.sparkSession, "packages")
    target = target if "://" in target or target.startswith("file:") else f"file://{target}"
    system, root = fs.FileSystem.from_uri(target)
    system.create_dir(root, recursive=True)
    return read_packages(write_packages(pages, target))
