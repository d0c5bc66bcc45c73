r"""Alignment of two tokenizers' tokens by interval coalescing.

Tokenizer A (byte-level BPE, tokenizers library) encodes a space and the text,
tokenizer B (SentencePiece BPE, which puts that space there itself) the text;
special tokens' strings are plain text to both.  A token covers the bytes it
stands for.  All tokens of both sides are sorted by start; the running maximum
of their ends tells where a group breaks: at a token that starts where
everything before it has ended.  Within a group each A token is expanded to the
B tokens it overlaps; an overlapping pair whose ranges end together is a link.

Both tokenizers treat the words of a text apart (see ``units``; the cut used
here is one that holds for both), so tokens are made and coalesced once per
distinct word of a worker's memory, many words in one pass over arrays.

Corpus-wide counts without a row per link: a block of about ``BLOCK_BYTES`` of
text writes its documents as numbers of distinct words and, in one row, its
dictionary: the distinct id pairs with their counts, and the pairs of each word.
Pair counts are summed over blocks; the highest count of a B id is a table of at
most B's vocabulary.  Counts go back to the blocks that hold the pair (a pair
has one row per block, however often it occurs there), and each block sums them
per document.  No key holds more rows than there are blocks, and a task holds
one block at a time.

Defined results: null and empty texts, and texts whose tokens do not stand for
exactly the space and the text (B takes a literal U+2581 for a space), have no
tokens: all numbers are zero and the group text is empty; repeated rows each get
their row and count again; a null id is kept; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise, ship_package
from .sentencepiece_encode import SpanEncoder
from .units import _ODD_SPACE, SPACE_MARK, HubTokenizer, byte_alphabet, file_of, slices

MODEL_A = "byte_bpe_50k.json"
MODEL_B = "piece_bpe_32k.model"
#: Text per block (code points); a longer text is a block of its own.
BLOCK_BYTES = 8 << 20

#: Words encoded in one call.
TOGETHER = 1000
#: After an id: the next of its side, the other side, the next group, the next word.
SEPARATORS = ",|;\n"

_CUT = re.compile(rf"(?<=[^ {SPACE_MARK}]) (?=\S)")


def words_of(text: str) -> list[str]:
    """Units of ``' ' + text``, each without its leading space, that neither tokenizer merges across."""
    if text[0] == " " or SPACE_MARK in text or _ODD_SPACE.search(text):
        return _CUT.split(text)
    return text.split(" ")


def coalesce(start: np.ndarray, end: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): the tokens by start and side, and the group of each in that order."""
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.r_[True, start[order][1:] >= reach[:-1]][: len(order)]
    return order, np.cumsum(breaks) - 1


def overlaps(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (A token, B token) whose ranges overlap; both sides are ordered and cover the same bytes without gaps."""
    low = np.searchsorted(end_b, start_a, "right")
    n = np.searchsorted(start_b, end_a, "left") - low
    a = np.repeat(np.arange(len(start_a)), n)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


class Aligner:
    """Tokens, groups and links of words."""

    def __init__(self, model_a: str, model_b: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.a, self.b = HubTokenizer(model_a), SpanEncoder(file_of(model_b))
        self.a.lib.encode_special_tokens = True
        if self.b.memo is None:
            raise ValueError("a model whose words are independent is needed")
        byte_of = {chr(c): b for b, c in byte_alphabet().items()}
        vocabulary = self.a.lib.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(map(byte_of.__getitem__, token)) if all(c in byte_of for c in token) else token.encode()
        model = pb.ModelProto()
        model.ParseFromString(self.b.lib.serialized_model_proto())
        as_byte = pb.ModelProto.SentencePiece.BYTE
        self.bytes_b = [bytes([int(p.piece[3:5], 16)]) if p.type == as_byte else p.piece.replace(SPACE_MARK, " ").encode() for p in model.pieces]
        self.size_a, self.size_b = (np.array([len(t) for t in spelled], np.int64) for spelled in (self.bytes_a, self.bytes_b))
        #: Decimal ids with what may follow them in a group text: at 4 * id + place in SEPARATORS.
        self.texts = [f"{i}{c}" for i in range(max(len(self.bytes_a), len(self.bytes_b))) for c in SEPARATORS]

    def _ids_a(self, text: str) -> list[int]:
        return self.a.lib.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids

    def _tokens(self, words: list[str], data: list[bytes], together: bool, encode: Callable[[str], list[int]], spelled: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words, their number per word, and whether they stand for exactly the word's bytes.

        Words that may stand side by side are encoded together, and the bytes
        of the tokens tell where a word ends; the others are encoded one by one.
        """
        ids: list[np.ndarray] = []
        n, same = np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        length = np.fromiter(map(len, data), np.int64, len(data))
        for k in range(0, len(words), TOGETHER):
            some = slice(k, min(k + TOGETHER, len(words)))
            if together:
                found = np.array(encode(" ".join(words[some])), np.int64)
                ends, want = np.cumsum(size[found]), np.cumsum(length[some])
                place = np.minimum(np.searchsorted(ends, want), len(ends) - 1)
                if (ends[place] == want).all() and ends[-1] == want[-1] and b"".join(map(spelled.__getitem__, found.tolist())) == b"".join(data[some]):
                    n[some], same[some] = np.diff(place, prepend=-1), True
                    ids.append(found)
                    continue
            for i in range(some.start, some.stop):
                found = np.array(encode(words[i]), np.int64)
                n[i], same[i] = len(found), b"".join(map(spelled.__getitem__, found.tolist())) == data[i]
                ids.append(found)
        return np.concatenate(ids), n, same

    def align(self, words: list[str]) -> list[tuple | None]:
        """Per word: (figures, group text, linked id pairs as 64-bit integers a << 32 | b); None if it is not reproduced."""
        if not words:
            return []
        alone = [i for i, w in enumerate(words) if SPACE_MARK in w or w[0].isspace() or w[-1].isspace()]
        if alone and len(alone) < len(words):
            out: list[tuple | None] = [None] * len(words)
            others = sorted(set(range(len(words))).difference(alone))
            for part in (alone, others):
                for i, f in zip(part, self.align([words[i] for i in part]), strict=True):
                    out[i] = f
            return out
        data = [b" " + w.encode() for w in words]
        a, n_a, same_a = self._tokens(words, data, not alone, self._ids_a, self.bytes_a, self.size_a)
        b, n_b, same_b = self._tokens(words, data, not alone, self.b.lib.encode, self.bytes_b, self.size_b)
        whole = same_a & same_b
        a, b = a[np.repeat(whole, n_a)], b[np.repeat(whole, n_b)]
        n_a, n_b = n_a[whole], n_b[whole]
        words = np.arange(len(n_a))
        of_a, of_b = np.repeat(words, n_a), np.repeat(words, n_b)
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        start_a, start_b = end_a - self.size_a[a], end_b - self.size_b[b]
        order, group = coalesce(np.r_[start_a, start_b], np.r_[end_a, end_b], np.repeat([0, 1], [len(a), len(b)]))
        texts = self._group_texts(np.r_[a, b], np.r_[of_a, of_b], len(a), order, group)
        n_groups = np.bincount(np.r_[of_a, of_b][order][np.flatnonzero(np.diff(group, prepend=-1))], minlength=len(words))
        x, y = overlaps(start_a, end_a, start_b, end_b)
        n_overlaps = np.bincount(of_a[x], minlength=len(words))
        linked = end_a[x] == end_b[y]
        x, y = x[linked], y[linked]
        n_links = np.bincount(of_a[x], minlength=len(words))
        pairs = (a[x] << 32 | b[y]).astype("<i8").tobytes()
        upto = (8 * np.cumsum(n_links)).tolist()
        links = [pairs[p:q] for p, q in zip([0, *upto], upto, strict=False)]
        figures = zip(*(c.tolist() for c in (n_a, n_b, n_groups, n_links, n_overlaps)), strict=True)
        found = zip(figures, texts, links, strict=True)
        return [next(found) if w else None for w in whole.tolist()]

    def _group_texts(self, ids: np.ndarray, word: np.ndarray, first_b: int, order: np.ndarray, group: np.ndarray) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` per word."""
        if not len(ids):
            return []
        side = order >= first_b
        order = order[np.lexsort((side, group))]  # a group's tokens of A, then those of B
        side, word = order >= first_b, word[order]
        ends_word = np.r_[word[1:] != word[:-1], True]
        ends_group = np.r_[np.diff(group) > 0, True]
        turns = np.r_[side[1:] > side[:-1], False] & ~ends_group
        follow = np.select([ends_word, ends_group, turns], [3, 2, 1], 0)
        return "".join(map(self.texts.__getitem__, (4 * ids[order] + follow).tolist())).split(SEPARATORS[3])[:-1]


@lru_cache(maxsize=1)
def aligner(model_a: str, model_b: str) -> Aligner:
    """One per Python worker."""
    return Aligner(model_a, model_b)


class Block:
    """Documents as numbers of the block's distinct words."""

    def __init__(self, al: Aligner):
        self.al, self.size = al, 0
        self.number: dict[str, int] = {}
        self.found: list[tuple] = []
        self.strange: set[int] = set()
        self.uses: list[np.ndarray] = []

    def add(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], list[bytes]]:
        """Figures, group text and word numbers of each text."""
        cut = [words_of(t) if t else [] for t in texts]
        new = list(set().union(*cut).difference(self.number))
        first = len(self.number)
        self.number.update(zip(new, range(first, first + len(new)), strict=True))
        for i, f in enumerate(self.al.align(new), first):
            if f is None:
                self.strange.add(i)
            self.found.append(f or ((0,) * len(FIGURES), "", b""))
        numbers = []
        for t, words in zip(texts, cut, strict=True):
            mine = list(map(self.number.__getitem__, words))
            numbers.append([] if self.strange and not self.strange.isdisjoint(mine) else mine)
            self.size += len(t) if t else 0
        groups = [";".join([self.found[i][1] for i in mine]) for mine in numbers]
        sizes = np.fromiter(map(len, numbers), np.int64, len(numbers))
        flat = np.fromiter(chain.from_iterable(numbers), np.int64, int(sizes.sum()))
        self.uses.append(flat)
        used, place = np.unique(flat, return_inverse=True)
        figures = np.array([self.found[i][0] for i in used.tolist()], np.int64).reshape(-1, len(FIGURES))[place]
        upto = np.r_[np.zeros((1, len(FIGURES)), np.int64), np.cumsum(figures, axis=0)]
        ends = np.cumsum(sizes)
        data, edges = flat.astype("<u4").tobytes(), [0, *(4 * ends).tolist()]
        return upto[ends] - upto[ends - sizes], groups, [data[p:q] for p, q in zip(edges[:-1], edges[1:], strict=True)]

    def dictionary(self) -> tuple[bytes, bytes, bytes, bytes]:
        """Distinct pairs, their counts in the block, links per word, and these links as places among the pairs."""
        uses = np.bincount(np.concatenate([*self.uses, np.empty(0, np.int64)]), minlength=len(self.number))
        links = np.frombuffer(b"".join([f[2] for f in self.found]), "<i8")
        sizes = np.array([len(f[2]) // 8 for f in self.found], np.int64)
        pairs, place = np.unique(links, return_inverse=True)
        counts = np.bincount(place, weights=np.repeat(uses, sizes), minlength=len(pairs)).astype("<i8")
        return pairs.tobytes(), counts.tobytes(), sizes.astype("<u4").tobytes(), place.astype("<u4").tobytes()


FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")
_DICTIONARY = ("pairs", "counts", "sizes", "places")


def blocks(docs: DataFrame, model_a: str, model_b: str, id_col: str, text_col: str) -> DataFrame:
    """Rows of documents (``words`` set) and of their blocks' dictionaries (``pairs`` set)."""
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    id_type = src.schema["_id"].dataType.simpleString()
    names = ["_block", "_id", *FIGURES, "groups", "words", *_DICTIONARY]

    def run(batches):
        from pyspark import TaskContext

        al = aligner(model_a, model_b)
        number = TaskContext.get().partitionId() << 32
        block, kind = Block(al), None

        def rows(ids: pa.Array, values: list, tables: list):
            return pa.RecordBatch.from_arrays([pa.array([number] * len(ids), pa.int64()), ids, *values, *tables], names)

        def closed():
            nonlocal block, number
            nothing = [pa.nulls(1, t) for t in (*[pa.int64()] * len(FIGURES), pa.string(), pa.binary())]
            yield rows(pa.nulls(1, kind), nothing, [pa.array([d], pa.binary()) for d in block.dictionary()])
            block, number = Block(al), number + 1

        for batch in batches:
            kind = batch.column(0).type
            for first, texts in slices(batch, 1):
                if block.size >= BLOCK_BYTES:
                    yield from closed()
                figures, groups, words = block.add(texts)
                values = [*[pa.array(c.copy()) for c in figures.T], pa.array(groups, pa.string()), pa.array(words, pa.binary())]
                yield rows(batch.column(0).slice(first, len(texts)), values, [pa.nulls(len(texts), pa.binary())] * len(_DICTIONARY))
        if kind is not None:
            yield from closed()

    figures = ", ".join(f"{c} long" for c in FIGURES)
    tables = ", ".join(f"{c} binary" for c in _DICTIONARY)
    return map_arrow(src, run, f"_block long, _id {id_type}, {figures}, groups string, words binary, {tables}")


def block_pairs(raw: DataFrame) -> DataFrame:
    """_block, place, a, b, n: the distinct pairs of each block."""

    def run(batches):
        for batch in batches:
            for block, pairs, counts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                pairs, counts = np.frombuffer(pairs, "<i8"), np.frombuffer(counts, "<i8")
                for k in range(0, len(pairs), 50_000):
                    some = pairs[k : k + 50_000]
                    columns = [np.full(len(some), block), np.arange(k, k + len(some)), some >> 32, some & 0xFFFFFFFF, counts[k : k + 50_000]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["_block", "place", "a", "b", "n"])

    return map_arrow(raw.where("pairs IS NOT NULL").select("_block", "pairs", "counts"), run, "_block long, place long, a long, b long, n long")


def link_counts(pairs: DataFrame) -> DataFrame:
    """a, b, n, best: links of each id pair, and whether no other pair of that B id has more."""
    total = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))
    top = total.groupBy("b").agg(F.max("n").alias("_top"))
    return total.join(top, "b").select("a", "b", "n", (F.col("n") == F.col("_top")).alias("best"))


def align_documents(
    docs: DataFrame, model_a: str = MODEL_A, model_b: str = MODEL_B, id_col: str = "doc_id", text_col: str = "text", groups: Callable[[Column], Column] = lambda text: text
) -> tuple[DataFrame, DataFrame]:
    """Per document: id, n_a, n_b, n_groups, n_links, n_overlaps, groups (the
    group text, or what ``groups`` makes of it before it is written down),
    n_best and count_sum; and the table of ``link_counts``."""
    ship_package(docs.sparkSession)
    raw = blocks(docs, model_a, model_b, id_col, text_col)
    raw = materialise(raw.withColumn("groups", F.when(F.col("words").isNotNull(), groups(F.col("groups")))), "aligned-blocks", compression="zstd")
    pairs = block_pairs(raw)
    counts = materialise(link_counts(pairs), "link-counts")
    known = pairs.drop("n").join(counts, ["a", "b"]).select("_block", "place", "n", "best")
    names = ["_id", *FIGURES, "groups", "n_best", "count_sum"]

    def sums(key, rows: pa.Table, found: pa.Table) -> pa.Table:
        places = found["place"].to_numpy()
        value = np.zeros((2, len(places)), np.int64)
        value[0, places] = found["best"].to_numpy()
        value[1, places] = found["n"].to_numpy()
        head = rows.filter(pa.compute.is_valid(rows["sizes"])).to_pylist()[0]
        sizes, place = np.frombuffer(head["sizes"], "<u4").astype(np.int64), np.frombuffer(head["places"], "<u4")
        upto = np.c_[np.zeros((2, 1), np.int64), np.cumsum(value[:, place], axis=1)]
        ends = np.cumsum(sizes)
        per_word = upto[:, ends] - upto[:, ends - sizes]
        rows = rows.filter(pa.compute.is_valid(rows["words"]))
        of_doc = [per_word[:, np.frombuffer(w, "<u4")].sum(axis=1).tolist() for w in rows["words"].to_pylist()]
        out = rows.select(names[:-2])
        for k, name in enumerate(names[-2:]):
            out = out.append_column(name, pa.array([s[k] for s in of_doc], pa.int64()))
        return out

    left = raw.drop("pairs", "counts")
    types = dict(left.dtypes)
    schema = ", ".join(f"{c} {types.get(c, 'long')}" for c in names)
    out = left.groupBy("_block").cogroup(known.groupBy("_block")).applyInArrow(sums, schema)
    return out.withColumnRenamed("_id", id_col), counts
