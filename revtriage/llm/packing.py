"""Best-fit packing with a bounded number of open bins.

A document's ids (with the end id) are cut into pieces of the sequence length
only if they are longer; the first piece takes what is left over, so all later
pieces fill a sequence alone.  The other pieces go, one by one, into the open
bin with the least free space that still holds them.  Open bins are kept in a
bitset keyed by their free space (bit f is set while a bin with f free tokens
is open): the best fit is the lowest set bit at or above the piece's length.
At most ``OPEN_BINS`` bins are open; when one more is needed, the fullest
closes first.

Plan: one scan makes the piece table (a few numbers per piece), which is
written down; pieces are dealt at random to tasks of ``PIECES_PER_TASK``
pieces, and each task packs its own, in runs of as many pieces as bins may be
open, sorted longest first, so that long pieces open bins and short ones fill
them before any has to close for want of a place.  Tasks share
nothing, so nothing passes through one task; each leaves at most a few part-full
bins beyond what a packing in one task would have.

Defined results: null and empty texts are one piece with the end id only;
repeated rows are packed one by one; a null id is kept; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise, ship_package
from .units import hub_tokenizer, slices

SEQUENCE = 1024
END_ID = 2
OPEN_BINS = 8192
BLOCK = 65_536
PIECES_PER_TASK = 200_000


def piece_lengths(n: int, limit: int) -> list[int]:
    """Lengths of the pieces of ``n`` ids: the first takes the remainder."""
    full, rest = divmod(n, limit)
    return ([rest] if rest else []) + [limit] * full


def pieces(docs: DataFrame, model: str = "byte_bpe_50k.json", limit: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32 and, if asked for, the ids."""
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    names = ["_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def cut(batches):
        tok = hub_tokenizer(model)
        tail = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for first, texts in slices(batch, 1):
                rows: list[list] = [[], [], [], [], [], []]
                for i, ids in enumerate(tok.encode(texts), first):
                    ids += tail
                    at = 0
                    for k, n in enumerate(piece_lengths(len(ids) // 4, limit)):
                        part = ids[4 * at : 4 * (at + n)]
                        for column, value in zip(rows, (i, k, at, n, zlib.crc32(part), part), strict=True):
                            column.append(value)
                        at += n
                own = batch.column(0).take(pa.array(rows[0], pa.int64()))
                values = [own, pa.array(rows[1], pa.int32()), *[pa.array(r, pa.int64()) for r in rows[2:5]]]
                yield pa.RecordBatch.from_arrays(values + [pa.array(rows[5], pa.binary())] * with_ids, names)

    id_type = src.schema["_id"].dataType.simpleString()
    schema = f"_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return map_arrow(src, cut, schema).withColumnRenamed("_id", id_col)


class OpenBins:
    """Best fit over a bounded number of open bins."""

    def __init__(self, limit: int, most: int):
        self.limit, self.most = limit, most
        self.bits = 0  # bit f: some open bin has f tokens free
        self.by_free: list[list[int]] = [[] for _ in range(limit + 1)]
        self.n_open = self.n_made = 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece."""
        fits = self.bits >> length
        if fits:
            free = length + ((fits & -fits).bit_length() - 1)
            chosen = self._take(free)
        else:
            if self.n_open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, chosen = self.limit, self.n_made
            self.n_made += 1
        left = free - length
        if left:  # a full bin is closed
            self.by_free[left].append(chosen)
            self.bits |= 1 << left
            self.n_open += 1
        return chosen, self.limit - free

    def _take(self, free: int) -> int:
        chosen = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return chosen


def pack(table: DataFrame, limit: int = SEQUENCE, open_bins: int = OPEN_BINS, pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Adds sequence_id and offset to a written piece table with a column ``length``."""
    total = table.count()
    tasks = max(1, -(-total // pieces_per_task))
    mixed = table.repartition(tasks, F.xxhash64(*table.columns))

    def place(frames):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        bins = OpenBins(limit, open_bins)

        def packed(block: list[pd.DataFrame]) -> pd.DataFrame:
            x = pd.concat(block, ignore_index=True)
            x = x.iloc[np.lexsort((-x["length"].to_numpy(), np.arange(len(x)) // open_bins))]
            placed = [bins.place(n) for n in x["length"].tolist()]
            x["sequence_id"] = np.array([base + b for b, _ in placed], np.int64)
            x["offset"] = np.array([o for _, o in placed], np.int64)
            return x

        block, n = [], 0
        for x in frames:
            if not len(x):
                continue
            block.append(x)
            n += len(x)
            if n >= BLOCK:
                yield packed(block)
                block, n = [], 0
        if block:
            yield packed(block)

    schema = ", ".join(f"`{c}` {t}" for c, t in table.dtypes) + ", sequence_id long, offset long"
    ship_package(table.sparkSession)
    return mixed.mapInPandas(place, schema)


def best_fit_packing(docs: DataFrame, model: str = "byte_bpe_50k.json", limit: int = SEQUENCE, open_bins: int = OPEN_BINS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(materialise(pieces(docs, model, limit, id_col=id_col, text_col=text_col), "pieces"), limit, open_bins)


def sequences(packed: DataFrame, ids: DataFrame, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (concatenated), documents; ``ids`` holds the pieces' ids."""
    x = packed.drop("ids").join(ids.select(*keys, "ids"), list(keys))
    rows = F.sort_array(F.collect_list(F.struct("offset", "ids", F.col(keys[0]).alias("id"))))  # at most ``limit`` pieces
    y = x.groupBy("sequence_id").agg(rows.alias("_r"))
    joined = F.unhex(F.array_join(F.transform("_r", lambda r: F.hex(r["ids"])), ""))
    return y.select("sequence_id", joined.alias("ids"), F.col("_r.id").alias("documents"))
