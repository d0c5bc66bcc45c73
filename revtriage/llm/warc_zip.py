"""WARC records in ZIP packages, read by range without extraction.

A package is a ZIP archive with two stored (uncompressed) members:
``archive/data.warc.gz``, one gzip member per WARC record, and
``indexes/index.jsonl``, one line per record with its offset and length in the
first.  The reader finds the end-of-central-directory record (and the ZIP64
one behind its locator), parses the central directory, skips the local headers
and reads the index and single records by their byte ranges.

Duplicates: of records with equal payloads of at least ``MIN_PAYLOAD`` bytes the
one with the largest id is the response, the others are revisits of it, without
a payload of their own.  Rows are numbered and written down; equal payloads are
found by (SHA-256, length), grouped with partial aggregation that also picks the
one response by (id, number), and joined back by a sort-merge join of narrow
rows that adaptive execution splits when one payload holds a third of them; the
payloads themselves are shuffled once, by number.

Memory: a task holds one package (``PACKAGE_BYTES``, or one longer record) when
it writes and one record when it reads.

Defined results: a null payload is empty; a null URL is left out of its record;
a null id is written as an empty record name and read back as null, and is
smaller than any other; of repeated rows with one id and payload each gets a
record, and of equal payloads all are revisits but for one row of the largest
id (of null, if all ids are null), in whatever partitions they are; an empty table writes no package and reads back empty; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, materialise, scratch
from .files import opened, put

MIN_PAYLOAD = 1000
PACKAGE_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
WARC_MEMBER = "archive/data.warc.gz"
INDEX_MEMBER = "indexes/index.jsonl"

# Fixed values of the ZIP format (APPNOTE 6.3): signatures and record layouts.
LOCAL = struct.Struct("<4s5H3I2H")
CENTRAL = struct.Struct("<4s6H3I5H2I")
END = struct.Struct("<4s4H2IH")
END64 = struct.Struct("<4sQ2H2I4Q")
LOCATOR = struct.Struct("<4sIQI")
LOCAL_SIG, CENTRAL_SIG, END_SIG, END64_SIG, LOCATOR_SIG = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF


# --- ZIP -------------------------------------------------------------------


def zip_package(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP archive of stored members; ZIP64 records where sizes need them or ``zip64`` asks for them."""
    out, directory = bytearray(), bytearray()
    for name, data in members:
        raw, crc, at, size = name.encode(), zlib.crc32(data), len(out), len(data)
        big = zip64 or size >= MAX32 or at >= MAX32
        local_extra = struct.pack("<2H2Q", 1, 16, size, size) if big else b""
        central_extra = struct.pack("<2H3Q", 1, 24, size, size, at) if big else b""
        shown, place, version = (MAX32, MAX32, 45) if big else (size, at, 20)
        out += LOCAL.pack(LOCAL_SIG, version, 0x800, 0, 0, 0x21, crc, shown, shown, len(raw), len(local_extra)) + raw + local_extra + data
        directory += CENTRAL.pack(CENTRAL_SIG, version, version, 0x800, 0, 0, 0x21, crc, shown, shown, len(raw), len(central_extra), 0, 0, 0, 0, place) + raw + central_extra
    start, n = len(out), len(members)
    out += directory
    big = zip64 or start >= MAX32 or n >= MAX16
    if big:
        at = len(out)
        out += END64.pack(END64_SIG, END64.size - 12, 45, 45, 0, 0, n, n, len(directory), start) + LOCATOR.pack(LOCATOR_SIG, 0, at, 1)
    out += END.pack(END_SIG, 0, 0, MAX16 if big else n, MAX16 if big else n, MAX32 if big else len(directory), MAX32 if big else start, 0)
    return bytes(out)


class ZipPackage:
    """Stored members of a ZIP archive, by byte range."""

    def __init__(self, file):
        self.file, self.size = file, file.size()
        tail_at = max(0, self.size - END.size - MAX16)
        tail = self._read(tail_at, self.size - tail_at)
        at = tail.rfind(END_SIG, 0, len(tail) - END.size + len(END_SIG))
        while at >= 0 and at + END.size + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):  # the signature may occur in a comment
            at = tail.rfind(END_SIG, 0, at)
        if at < 0:
            raise ValueError("no ZIP archive: the end record is missing")
        _, disk, _, _, n, size, start, _ = END.unpack_from(tail, at)
        if MAX16 in (disk, n) or MAX32 in (size, start):
            where = tail_at + at - LOCATOR.size
            sig, _, end64, _ = LOCATOR.unpack(self._read(where, LOCATOR.size))
            if sig != LOCATOR_SIG:
                raise ValueError("the ZIP64 locator is missing")
            sig, *_, n, size, start = END64.unpack(self._read(end64, END64.size))
            if sig != END64_SIG:
                raise ValueError("the ZIP64 end record is missing")
        self.members = dict(self._directory(self._read(start, size), n))

    def _read(self, at: int, n: int) -> bytes:
        data = self.file.read_at(n, at)
        if len(data) != n:
            raise ValueError("the archive is cut off")
        return data

    @staticmethod
    def _directory(data: bytes, n: int) -> Iterator[tuple[str, tuple[int, int, int]]]:
        """(name, (local header, size, method)) of each entry."""
        at = 0
        for _ in range(n):
            sig, _, _, _, method, _, _, _, packed, size, n_name, n_extra, n_comment, _, _, _, place = CENTRAL.unpack_from(data, at)
            if sig != CENTRAL_SIG:
                raise ValueError("damaged central directory")
            at += CENTRAL.size
            name, extra = data[at : at + n_name].decode(), data[at + n_name : at + n_name + n_extra]
            at += n_name + n_extra + n_comment
            while len(extra) >= 4:
                kind, length = struct.unpack_from("<2H", extra)
                if kind == 1:  # holds, in this order, what did not fit
                    wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, 4))
                    size, packed, place = (next(wide) if v == MAX32 else v for v in (size, packed, place))
                extra = extra[4 + length :]
            yield name, (place, packed, method)

    def locate(self, name: str) -> tuple[int, int]:
        """(first byte, size) of a stored member's data."""
        place, size, method = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed: its records can't be read by range")
        header = LOCAL.unpack(self._read(place, LOCAL.size))
        if header[0] != LOCAL_SIG:
            raise ValueError("damaged local header")
        return place + LOCAL.size + header[-2] + header[-1], size

    def read(self, name: str, at: int = 0, n: int | None = None) -> bytes:
        start, size = self.locate(name)
        n = size - at if n is None else n
        if at < 0 or at + n > size:
            raise ValueError("range outside of the member")
        return self._read(start + at, n)


# --- WARC ------------------------------------------------------------------


def warc_record(kind: str, name: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, length: int) -> bytes:
    """One gzip member: a WARC/1.1 response or revisit record with an HTTP block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + payload
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n") + packer.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """(WARC headers in lower case, length of the full payload by the HTTP header, payload)."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(x.lower().split(": ", 1) for x in http.decode().split("\r\n")[1:])
    return headers, int(fields["content-length"]), payload


def _name(urn: str | None) -> str | None:
    return urn.removeprefix("<urn:page:").removesuffix(">") if urn else None


# --- Spark -----------------------------------------------------------------


def with_responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """_id, _url, _payload (binary), _revisit, _refers (the response's id for revisits, else null)."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    src = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), payload.alias("_payload"))
    src = src.withColumn("_n", F.octet_length("_payload")).withColumn("_sha", F.when(F.col("_n") >= min_payload, F.sha2("_payload", 256)))
    src = materialise(src.withColumn("_row", F.monotonically_increasing_id()), "numbered-pages", compression="zstd")
    keys = src.where("_sha IS NOT NULL").select("_id", "_row", "_sha", "_n")
    # A null id is the smallest member of a struct.
    groups = keys.groupBy("_sha", "_n").agg(F.max(F.struct("_id", "_row")).alias("_top"), F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    copies = keys.join(groups, ["_sha", "_n"]).where("_row <> _top._row").select("_row", F.col("_top._id").alias("_refers"), F.lit(True).alias("_revisit"))
    out = src.select("_row", "_id", "_url", "_payload").join(materialise(copies, "revisits"), "_row", "left")
    return out.select("_id", "_url", "_payload", F.coalesce("_revisit", F.lit(False)).alias("_revisit"), "_refers")


def write_packages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Writes the packages below ``path``; returns the manifest: file, records."""
    src = with_responses(pages, id_col, url_col, payload_col, min_payload)

    def write(batches):
        partition = TaskContext.get().partitionId()
        records, index, size, number = [], [], 0, 0

        def flush():
            nonlocal records, index, size, number
            name = f"{path}/part-{partition:06d}-{number:06d}.zip"
            put(name, zip_package([(WARC_MEMBER, b"".join(records)), (INDEX_MEMBER, "".join(index).encode())]))
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(records)], pa.int64())], ["file", "records"])
            records, index, size, number = [], [], 0, number + 1
            return row

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, payload, revisit, refers = (batch.column(c)[i].as_py() for c in range(5))
                digest = hashlib.sha1(payload).hexdigest()
                name, target = ("" if v is None else str(v) for v in (page, refers))
                record = warc_record("revisit" if revisit else "response", name, url, b"" if revisit else payload, digest, target if revisit else None, len(payload))
                if records and size + len(record) > PACKAGE_BYTES:
                    yield flush()
                index.append(json.dumps({"id": name, "offset": size, "length": len(record)}) + "\n")
                records.append(record)
                size += len(record)
        if records:
            yield flush()

    return materialise(map_arrow(src, write, "file string, records long"), "warc-manifest")


def read_packages(manifest: DataFrame, id_type: str = "long", id_col: str = "page_id") -> DataFrame:
    """Per record: id, url, record_type, payload_bytes, payload_digest, refers_to and payload (empty for revisits)."""
    n = max(1, manifest.count())
    names = ["_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]

    def read(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                package = ZipPackage(opened(name))
                start, _ = package.locate(WARC_MEMBER)
                rows: list[tuple] = []
                held = 0
                for line in package.read(INDEX_MEMBER).decode().splitlines():
                    entry = json.loads(line)
                    headers, length, payload = parse_record(package._read(start + entry["offset"], entry["length"]))
                    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"damaged record {entry['id']} in {name}")
                    rows.append((_name(headers["warc-record-id"]) or None, headers.get("warc-target-uri"), kind, length, digest, _name(headers.get("warc-refers-to")) or None, payload))
                    held += len(payload)
                    if held > 1 << 22 or len(rows) >= 2000:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    def batch_of(rows):
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary"
    out = map_arrow(manifest.select("file").repartition(min(n, 4096), "file"), read, schema)
    return out.withColumn("_id", F.col("_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type)).withColumnRenamed("_id", id_col)


def warc_round_trip(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes the packages to the shared folder and reads their records back, payloads left out."""
    manifest = write_packages(pages, scratch(spark, "warc"), id_col, url_col, payload_col)
    kind = dict(pages.dtypes)[id_col]
    return read_packages(manifest, kind, id_col).select(id_col, "payload_bytes", "payload_digest", "record_type", "refers_to")
