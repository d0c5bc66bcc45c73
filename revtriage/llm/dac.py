"""Token-id files of directly addressable codes.

Ids are split into chunks of ``CHUNK`` bits.  Level 0 holds the low chunk of
every id; a bitmap marks the ids that go on, and level 1 holds the next chunk
of those only, and so on.  An id's place on the next level is the number of
marks before it, which a rank directory (one count per ``SAMPLE`` marks) and a
few counted bytes answer, so any id of a file is read without decoding others.

File: magic, header (documents, ids, levels), a table of section ends, then the
sections: null-id marks, document ids, first id of each document, and per level
its chunks, bitmap and directory; a CRC-32 of all that ends the file.

Writing: the table is range-partitioned by document id and sorted, each task
encodes its documents and writes files of at most ``FILE_IDS`` ids (a longer
document has a file of its own), named by partition and number.  The manifest
holds a row per file; a file's first global position comes from the sums of
the partitions before it and of the files before it in its partition.

Defined results: null and empty texts have the end id only; null document ids
come first; rows with equal ids stay apart, in any order; an empty table
writes no file and reads back empty; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialise, scratch
from .files import opened, put
from .units import hub_tokenizer, slices

MAGIC = b"DACIDS01"
CHUNK = 8
SAMPLE = 512
FILE_IDS = 1 << 21
END_ID = 1
HEAD = struct.Struct("<8sQQQ")


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per level: chunks (u8), bitmap (packed, little-endian bits), directory (u64 marks before each sample)."""
    levels, rest = [], ids.astype(np.uint64)
    while True:
        more = (rest >> np.uint64(CHUNK)) > 0
        marks = np.add.reduceat(more, np.arange(0, len(more), SAMPLE), dtype=np.uint64) if len(more) else np.empty(0, np.uint64)
        directory = np.concatenate([[0], np.cumsum(marks)[:-1]]).astype("<u8") if len(marks) else marks.astype("<u8")
        levels.append(((rest & np.uint64((1 << CHUNK) - 1)).astype(np.uint8), np.packbits(more, bitorder="little"), directory))
        if not more.any():
            return levels
        rest = rest[more] >> np.uint64(CHUNK)


def encode_file(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    sections = [
        np.packbits([d is None for d in doc_ids], bitorder="little"),
        np.array([d or 0 for d in doc_ids], "<i8"),
        np.cumsum(np.r_[0, counts]).astype("<u8"),
    ]
    levels = encode_levels(ids)
    for level in levels:
        sections.extend(level)
    blobs = [s.tobytes() for s in sections]
    ends = np.cumsum([len(b) for b in blobs]).astype("<u8").tobytes()
    body = b"".join([HEAD.pack(MAGIC, len(doc_ids), len(ids), len(levels)), ends, *blobs])
    return body + struct.pack("<I", zlib.crc32(body))


class DacFile:
    """A file opened for random access; sections are read when asked for."""

    def __init__(self, uri: str):
        self.file = opened(uri)
        magic, self.n_docs, self.n_ids, self.n_levels = HEAD.unpack(self._bytes(0, HEAD.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token-id file")
        n = 3 + 3 * self.n_levels
        base = HEAD.size + 8 * n
        ends = np.frombuffer(self._bytes(HEAD.size, 8 * n), "<u8").astype(np.int64) + base
        self.bounds = list(zip([base, *ends[:-1].tolist()], ends.tolist(), strict=True))
        self.end = int(ends[-1])

    def _bytes(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def section(self, k: int, kind: str) -> np.ndarray:
        start, end = self.bounds[k]
        return np.frombuffer(self._bytes(start, end - start), kind)

    def check(self) -> None:
        (stored,) = struct.unpack("<I", self._bytes(self.end, 4))
        if zlib.crc32(self._bytes(0, self.end)) != stored:
            raise ValueError("damaged token-id file")

    def get(self, i: int) -> int:
        """The id at place ``i``: a byte, a bit and a count per level."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for level in range(self.n_levels):
            chunks, bitmap, directory = (self.bounds[3 + 3 * level + k][0] for k in range(3))
            value |= self._bytes(chunks + i, 1)[0] << (CHUNK * level)
            if not self._bytes(bitmap + i // 8, 1)[0] >> (i % 8) & 1:
                break
            sample = i // SAMPLE
            (before,) = struct.unpack("<Q", self._bytes(directory + 8 * sample, 8))
            part = self._bytes(bitmap + sample * SAMPLE // 8, (i % SAMPLE) // 8 + 1)
            bits = int.from_bytes(part, "little") & ((1 << (i % SAMPLE)) - 1)
            i = before + bits.bit_count()
        return value

    def ids(self) -> np.ndarray:
        """All ids."""
        out = np.zeros(self.n_ids, "<u4")
        places = np.arange(self.n_ids)
        for level in range(self.n_levels):
            out[places] |= self.section(3 + 3 * level, np.uint8).astype(np.uint32) << np.uint32(CHUNK * level)
            more = np.unpackbits(self.section(4 + 3 * level, np.uint8), count=len(places), bitorder="little").astype(bool)
            places = places[more]
        return out

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        null = np.unpackbits(self.section(0, np.uint8), count=self.n_docs, bitorder="little")
        return [None if z else d for d, z in zip(self.section(1, "<i8").tolist(), null, strict=True)], self.section(2, "<u8").astype(np.int64)


def write_token_files(docs: DataFrame, path: str, model: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files below ``path``; returns the manifest: partition, number, file, n_docs, n_ids, start."""
    src = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t"))
    src = src.repartitionByRange("_id").sortWithinPartitions("_id")

    def write(batches):
        tok = hub_tokenizer(model)
        partition = TaskContext.get().partitionId()
        tail = np.array([end_id], "<u4").tobytes()
        doc_ids, blobs, size, number = [], [], 0, 0

        def flush():
            nonlocal doc_ids, blobs, size, number
            counts = np.array([len(b) // 4 for b in blobs], np.int64)
            name = f"{path}/ids-{partition:06d}-{number:06d}.dac"
            put(name, encode_file(doc_ids, counts, np.frombuffer(b"".join(blobs), "<u4")))
            row = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((partition, pa.int32()), (number, pa.int32()), (name, pa.string()), (len(blobs), pa.int64()), (size, pa.int64()))], ["partition", "number", "file", "n_docs", "n_ids"])
            doc_ids, blobs, size, number = [], [], 0, number + 1
            return row

        for batch in batches:
            for first, texts in slices(batch, 1):
                for i, ids in enumerate(tok.encode(texts), first):
                    ids += tail
                    if blobs and size + len(ids) // 4 > FILE_IDS:
                        yield flush()
                    doc_ids.append(batch.column(0)[i].as_py())
                    blobs.append(ids)
                    size += len(ids) // 4
        if blobs:
            yield flush()

    files = materialise(map_arrow(src, write, "partition int, number int, file string, n_docs long, n_ids long"), "dac-manifest")
    # A row per partition in the one window that has no partition key.
    parts = files.groupBy("partition").agg(F.sum("n_ids").alias("_sum"))
    parts = parts.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("partition").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = files.withColumn("_within", within).join(parts.select("partition", "_before"), "partition")
    return materialise(out.withColumn("start", F.col("_before") + F.col("_within")).drop("_within", "_before"), "dac-starts")


def read_token_files(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: id, start, n_tokens, ids (little-endian unsigned 32-bit integers)."""
    n = max(1, manifest.count())
    spread = manifest.select("file", "start").repartition(min(n, 4096), "file")

    def read(batches):
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = DacFile(name)
                f.check()
                doc_ids, bounds = f.documents()
                data = f.ids().tobytes()
                for k in range(0, len(doc_ids), 1000):
                    some, edges = doc_ids[k : k + 1000], bounds[k : k + 1001]
                    blobs = [data[4 * a : 4 * b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some, pa.int64()), pa.array(start + edges[:-1], pa.int64()), pa.array(np.diff(edges), pa.int64()), pa.array(blobs, pa.binary())],
                        ["_id", "start", "n_tokens", "ids"],
                    )

    return map_arrow(spread, read, "_id long, start long, n_tokens long, ids binary").withColumnRenamed("_id", id_col)


def token_files(spark: SparkSession, docs: DataFrame, model: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files to the shared folder and reads them back: id, start, n_tokens, ids_crc32."""
    manifest = write_token_files(docs, scratch(spark, "token-files"), model, id_col=id_col, text_col=text_col)
    return read_token_files(manifest, id_col).select(id_col, "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
