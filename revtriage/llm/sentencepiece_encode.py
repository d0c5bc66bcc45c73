"""SentencePiece encoding with source spans, and decoding.

A text is normalised by longest-prefix matches in the model's compiled
character map (a double-array trie in the model file).  Each match records the
source bytes it came from, so every byte of the normalised text knows its place
in the original; the pieces, laid end to end over the normalised text, are
projected through that alignment to spans of original bytes.

Ids are the library's: a worker asks it once per distinct unit of the text (see
``units``; models for which units are not independent are asked for whole
texts) and remembers a bounded number of answers.  Decoding is the library's
``decode`` of a document's whole list of ids.

Spans: a piece covers the original bytes of its normalised bytes; the space
mark that the model puts before a text covers nothing; a byte piece covers the
original character that it is a byte of.

Defined results: null and empty texts have no ids and decode to an empty text;
repeated rows each get their row; a null id is kept; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .units import SPACE_MARK, Memo, file_of, run_units, slices


class CharMap:
    """Longest-prefix replacement by a compiled character map.

    The map is a 32-bit size, a double-array trie of that many bytes, and the
    replacements, each ended by a zero byte; a key's value is the offset of its
    replacement.  A trie unit holds a label (low byte), an offset to its
    children (from bit 10, scaled by bit 9) and whether a value is among them
    (bit 8).
    """

    def __init__(self, compiled: bytes):
        (size,) = struct.unpack_from("<I", compiled)
        self.trie = np.frombuffer(compiled, "<u4", size // 4, 4).tolist()
        self.texts = compiled[4 + size :]

    @staticmethod
    def _children(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(matched bytes, replacement) of the longest key at ``at``."""
        trie, best = self.trie, None
        node = self._children(trie[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(trie) or trie[node] & 0x800000FF != data[i]:
                break
            unit = trie[node]
            node ^= self._children(unit)
            if unit & 0x100:
                best = (i + 1 - at, trie[node] & 0x7FFFFFFF)
        if best is None:
            return None
        start = best[1]
        return best[0], self.texts[start : self.texts.index(b"\0", start)]

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each its source's (start, end)."""
        out, spans, at = [], [], 0
        while at < len(data):
            hit = self.longest(data, at)
            if hit is None:
                first = data[at]
                size = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                hit = size, data[at : at + size]
            out.append(hit[1])
            spans += [(at, at + hit[0])] * len(hit[1])
            at += hit[0]
        return b"".join(out), np.array(spans, np.int64).reshape(-1, 2)


class SpanEncoder:
    """Ids and source spans by one model."""

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(model_file, "rb") as f:
            data = f.read()
        model = pb.ModelProto()
        model.ParseFromString(data)
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.spec = model.normalizer_spec
        if not self.spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a model with escaped spaces before words is needed")
        self.map = CharMap(self.spec.precompiled_charsmap) if self.spec.precompiled_charsmap else None
        kind = pb.ModelProto.SentencePiece
        self.size = np.array([1 if p.type == kind.BYTE else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.unknown = self.lib.unk_id()
        whole = (
            self.map is not None
            or self.spec.remove_extra_whitespaces
            or not self.spec.add_dummy_prefix
            or model.trainer_spec.model_type != pb.TrainerSpec.BPE
            or not model.trainer_spec.byte_fallback
            or any(p.type in (kind.USER_DEFINED, kind.UNUSED) or SPACE_MARK in p.piece.lstrip(SPACE_MARK) for p in model.pieces)
        )
        self.memo = None if whole else Memo(self._ask)
        self.anchor = None if whole else self.lib.encode("x")

    def _ask(self, units: list[str]) -> list[bytes]:
        out = []
        for u, ids in zip(units, self.lib.encode(units, num_threads=1), strict=True):
            if not u:  # a lone space mark: the library adds none to an empty text
                ids = self.lib.encode("x ")[len(self.anchor) :]
            out.append(np.array(ids, "<i4").tobytes())
        return out

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        if self.memo is None:
            return [np.array(self.lib.encode(t), "<i4") if t else np.empty(0, "<i4") for t in texts]
        cut = [run_units(t) if t else [] for t in texts]
        known = self.memo.learn(set().union(*cut))
        return [np.frombuffer(b"".join(map(known.__getitem__, units)), "<i4") for units in cut]

    def alignment(self, text: str) -> np.ndarray:
        """Source (start, end) per byte of the normalised text as the model sees it."""
        source = text.encode()
        if self.map is None:
            data = np.frombuffer(source, np.uint8)
            starts = (data & 0xC0) != 0x80
            bounds = np.flatnonzero(np.r_[starts, True])
            char = np.cumsum(starts) - 1
            spans = np.stack([bounds[char], bounds[char + 1]], 1)
        else:
            data, spans = self.map.normalise(source)
            data = np.frombuffer(data, np.uint8)
        space = data == 0x20
        if self.spec.remove_extra_whitespaces:
            word = np.flatnonzero(~space)
            keep = ~space | np.r_[False, ~space[:-1]]
            keep &= np.arange(len(data)) <= (word[-1] if len(word) else -1)
            data, spans, space = data[keep], spans[keep], space[keep]
        spans = np.repeat(spans, np.where(space, len(SPACE_MARK.encode()), 1), axis=0)
        if self.spec.add_dummy_prefix and len(spans):
            spans = np.concatenate([np.full((len(SPACE_MARK.encode()), 2), spans[0, 0]), spans])
        return spans

    def spans(self, text: str | None, ids: np.ndarray) -> np.ndarray:
        """(begin, end) in original bytes of each piece."""
        if not len(ids):
            return np.empty((0, 2), np.int64)
        source = self.alignment(text)
        sizes = self.size[ids]
        if (ids == self.unknown).any():  # without byte fallback: as long as the library says
            sizes = np.array([len(p.encode()) for p in self.lib.encode(text, out_type=str)], np.int64)
        ends = np.cumsum(sizes)
        return np.stack([source[ends - sizes, 0], source[ends - 1, 1]], 1)


@lru_cache(maxsize=2)
def span_encoder(model: str) -> SpanEncoder:
    """One per Python worker and model."""
    return SpanEncoder(file_of(model))


def encode_with_spans(docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids, begins, ends (arrays of int) and decoded per row."""
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))

    def encode(batches):
        enc = span_encoder(model)
        for batch in batches:
            for first, texts in slices(batch, 1, max_bytes=1 << 20):
                ids = enc.ids(texts)
                spans = np.concatenate([enc.spans(t, i) for t, i in zip(texts, ids, strict=True)]).astype(np.int32)
                offsets = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                column = lambda values: pa.ListArray.from_arrays(offsets, pa.array(values))
                decoded = [enc.lib.decode(i.tolist()) if len(i) else "" for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), column(np.concatenate(ids).astype(np.int32)), column(spans[:, 0].copy()), column(spans[:, 1].copy()), pa.array(decoded, pa.string())],
                    ["_id", "ids", "begins", "ends", "decoded"],
                )

    id_type = src.schema["_id"].dataType.simpleString()
    out = map_arrow(src, encode, f"_id {id_type}, ids array<int>, begins array<int>, ends array<int>, decoded string")
    return out.withColumnRenamed("_id", id_col)


def span_digest(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of ``encode_with_spans``, plus the spans' count of covered bytes."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.when(F.size("ids") > 0, F.element_at("ends", -1)).otherwise(0).cast("long").alias("n_bytes"),
    )
