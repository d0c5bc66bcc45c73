"""Token counts by rank-synchronous array merging.

A batch of pre-tokens is held as one ragged numpy array of symbols.  In each
round every sequence merges its own pair of lowest rank (the leftmost on a
tie), all sequences at once; sequences without a mergeable pair leave the
array.  What survives is counted: a symbol of the vocabulary is one token, an
unknown character falls back to its UTF-8 bytes.

Only counts are made, never ids.  Distinct pre-tokens are merged once and
remembered by the worker (a bounded memory, see ``units``).  A pre-token of
more than ``LONG`` symbols, for which rounds over arrays would be quadratic,
takes its merges one by one from a heap, with the same result.

Defined results: null and empty texts have no bytes and no tokens; repeated
rows each get their row; a null id is kept; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .units import SPACE_MARK, Memo, file_of, run_units, slices

LONG = 256
NO_RANK = np.int64(1 << 30)
MAX_TOKENS = 4096


class PairTable:
    """Ranks and results of mergeable symbol pairs in an open-addressing hash table."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray, rank: np.ndarray, n_symbols: int):
        self.n = np.int64(n_symbols)
        keys = left.astype(np.int64) * self.n + right
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.merged = np.zeros(1 << bits, np.int32)
        self.rank = np.full(1 << bits, NO_RANK, np.int64)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot[todo]] < 0
            self.keys[slot[todo[free]]] = keys[todo[free]]  # of several for one slot the last stays
            stays = self.keys[slot[todo]] == keys[todo]
            placed = todo[stays]
            self.merged[slot[placed]], self.rank[slot[placed]] = merged[placed], rank[placed]
            todo = todo[~stays]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, slot) of each pair; NO_RANK where it can't merge."""
        keys = left.astype(np.int64) * self.n + right
        slot = self._slot(keys)
        todo = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            there = self.keys[slot[todo]]
            todo = todo[(there != keys[todo]) & (there >= 0)]
        return np.where(self.keys[slot] == keys, self.rank[slot], NO_RANK), slot


class RankMerger:
    """Counts what a SentencePiece BPE model with byte fallback makes of units."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or not model.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces):
            raise ValueError("a model without normalisation, with dummy prefix and escaped spaces is needed")
        kinds = {p.type for p in model.pieces}
        kind = pb.ModelProto.SentencePiece
        if kinds - {kind.NORMAL, kind.UNKNOWN, kind.CONTROL, kind.BYTE}:
            raise ValueError("user-defined and unused pieces are not supported")
        score = {p.piece: p.score for p in model.pieces if p.type == kind.NORMAL}
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in score):
            raise ValueError("pieces with an inner space mark are not supported")
        # Symbols: the pieces, and characters that only occur inside pieces.
        symbols = dict.fromkeys(score)
        symbols.update(dict.fromkeys(c for p in score for c in p))
        number = {s: i for i, s in enumerate(symbols)}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        splits = [(number[p[:k]], number[p[k:]], number[p], order[score[p]]) for p in score for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        self.unknown = len(number)
        columns = np.array(splits, np.int64).reshape(-1, 4).T
        self.pairs = PairTable(*columns, len(number) + 1)
        self.symbol_of = np.full(0x110000, self.unknown, np.int32)
        for c, i in number.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = i
        self.in_vocabulary = np.zeros(len(number) + 1, bool)
        self.in_vocabulary[[number[p] for p in score]] = True

    def counts(self, units: list[str]) -> list[int]:
        """Tokens of ``' ' + unit`` for each unit."""
        out = np.zeros(len(units), np.int64)
        lengths = np.fromiter(map(len, units), np.int64, len(units)) + 1
        short = np.flatnonzero(lengths <= LONG)
        for block in np.array_split(short, max(1, int(lengths[short].sum()) >> 20)):
            if len(block):
                out[block] = self._merge_together([units[i] for i in block])
        for i in np.flatnonzero(lengths > LONG):
            out[i] = self._merge_one(units[i])
        return out.tolist()

    def _symbols(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the characters, and the tokens each counts as while it stays alone."""
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        symbols = self.symbol_of[codes]
        width = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        return symbols, np.where(self.in_vocabulary[symbols], 1, width)

    def _merge_together(self, units: list[str]) -> np.ndarray:
        marked = [SPACE_MARK + u.replace(" ", SPACE_MARK) for u in units]
        symbols, weight = self._symbols("".join(marked))
        sequence = np.repeat(np.arange(len(units)), np.fromiter(map(len, marked), np.int64, len(units)))
        result = np.zeros(len(units), np.int64)
        while len(symbols):
            same = sequence[:-1] == sequence[1:]
            rank = np.full(len(symbols), NO_RANK)
            slots = np.zeros(len(symbols), np.int64)
            found, slot = self.pairs.find(symbols[:-1][same], symbols[1:][same])
            rank[:-1][same], slots[:-1][same] = found, slot
            starts = np.flatnonzero(np.r_[True, ~same])
            best = np.minimum.reduceat((rank << 32) | np.arange(len(symbols)), starts)
            at = best & 0xFFFFFFFF
            merges = (best >> 32) < NO_RANK
            at = at[merges]
            symbols[at] = self.pairs.merged[slots[at]]
            weight[at] = np.where(self.in_vocabulary[symbols[at]], 1, weight[at] + weight[at + 1])
            weight[at + 1] = 0
            sums = np.add.reduceat(weight, starts)
            done = ~merges
            result[sequence[starts[done]]] = sums[done]
            stay = np.repeat(merges, np.diff(np.r_[starts, len(symbols)]))
            stay[at + 1] = False
            symbols, weight, sequence = symbols[stay], weight[stay], sequence[stay]
        return result

    def _merge_one(self, unit: str) -> int:
        """The same merges for one long unit, one by one from a heap."""
        symbols, weight = (x.tolist() for x in self._symbols(SPACE_MARK + unit.replace(" ", SPACE_MARK)))
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, slot = self.pairs.find(np.array(symbols[:-1]), np.array(symbols[1:]))
        heap = [(int(r), i, symbols[i], symbols[i + 1], int(s)) for i, (r, s) in enumerate(zip(rank, slot, strict=True)) if r < NO_RANK]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, s = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = int(self.pairs.merged[s]), -1
            weight[i] = 1 if self.in_vocabulary[symbols[i]] else weight[i] + weight[j]
            weight[j] = 0
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n:
                    r, s2 = self.pairs.find(np.array([symbols[p]]), np.array([symbols[q]]))
                    if r[0] < NO_RANK:
                        heapq.heappush(heap, (int(r[0]), p, symbols[p], symbols[q], int(s2[0])))
        return sum(weight)


@lru_cache(maxsize=2)
def unit_counts(model: str) -> Memo:
    """One memory per Python worker and model."""
    return Memo(RankMerger(file_of(model)).counts)


def count_texts(texts: list[str | None], memo: Memo) -> list[int]:
    cut = [run_units(t) if t else [] for t in texts]
    known = memo.learn(set().union(*cut))
    return [sum(map(known.__getitem__, units)) for units in cut]


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_TOKENS) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit per row."""
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))

    def count(batches):
        memo = unit_counts(model)
        for batch in batches:
            for first, texts in slices(batch, 1):
                sizes = [len(t.encode()) if t else 0 for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(sizes, pa.int64()), pa.array(count_texts(texts, memo), pa.int64())], ["_id", "n_bytes", "n_tokens"])

    id_type = src.schema["_id"].dataType.simpleString()
    out = map_arrow(src, count, f"_id {id_type}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
