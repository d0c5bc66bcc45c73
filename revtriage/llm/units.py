r"""Cutting texts into units that a tokenizer treats independently, and a
bounded memo of what it makes of each unit.

Natural text repeats its words, so a worker asks the library once per distinct
unit and glues the answers.  That is exact only where no token can span two
units; each cut below states why that holds, and texts where it might not are
given to the library whole.

* Byte-level and word-level BPE split the text by a pattern before any merge.
  A space followed by a character that is no white space always starts a new
  match of that pattern, so the text may be cut before it.
* A SentencePiece BPE model whose pieces never hold a space mark after another
  character never merges across the start of a run of spaces.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space before white space or the end: such texts take the pattern below.
_ODD_SPACE = re.compile(r" (?:\s|\Z)")
_BEFORE_WORD = re.compile(r" (?=\S)")
_LINE_BREAK = re.compile(r"\S+(?:\n\S+)+")
_RUN_START = re.compile(r"(?<=[^ ▁])(?= )")

SPACE_MARK = "▁"
_MARKS = frozenset(".,;:!?")
_MARK_LAST = "[.,;:!?]$"


def word_units(text: str) -> list[str]:
    """First unit as it is; of each later one its leading space is left out."""
    return _BEFORE_WORD.split(text) if _ODD_SPACE.search(text) else text.split(" ")


def run_units(text: str) -> list[str]:
    """Units of ``' ' + text``, each without its leading space; text must not be empty."""
    if "  " not in text and SPACE_MARK not in text and text[0] != " ":
        return text.split(" ")
    return [u[1:] for u in _RUN_START.split(" " + text)]


class Memo:
    """Two generations of at most ``cap`` answers each; what is in use survives a change.

    Only a memory of what the library said: evicted units are asked again.
    """

    def __init__(self, ask: Callable[[list[str]], Iterable], cap: int = 300_000):
        self.ask, self.cap, self.new, self.old = ask, cap, {}, {}

    def answers(self, units: list[str]) -> list:
        """The answer of each unit; units should be distinct."""
        if len(self.new) > self.cap:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        out = list(map(new.get, units))
        missing = [i for i, a in enumerate(out) if a is None]
        unknown = []
        for i in missing:
            u = units[i]
            seen = old.get(u)
            if seen is None:
                unknown.append(u)
            else:
                new[u] = seen
        if unknown:
            new.update(zip(unknown, self.ask(unknown), strict=True))
        for i in missing:
            out[i] = new[units[i]]
        return out

    def learn(self, units: set[str]) -> dict:
        """A dict that holds at least ``units``."""
        if len(self.new) > self.cap:
            self.old, self.new = self.new, {}
        new, old, unknown = self.new, self.old, []
        for u in units.difference(new):
            seen = old.get(u)
            if seen is None:
                unknown.append(u)
            else:
                new[u] = seen
        if unknown:
            new.update(zip(unknown, self.ask(unknown), strict=True))
        return new


def slices(batch: pa.RecordBatch, text_col: int, max_bytes: int = 2 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of runs of rows of about ``max_bytes`` of text; a longer text is a run of its own."""
    texts, size, first = [], 0, 0
    for i, scalar in enumerate(batch.column(text_col)):
        text = scalar.as_py()
        n = len(text) if text else 0
        if texts and size + n > max_bytes:
            yield first, texts
            texts, size, first = [], 0, i
        texts.append(text)
        size += n
    if texts:
        yield first, texts


def file_of(name: str) -> str:
    """The path of a public tokenizer file; a name with a slash is a path already."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


#: Letters below this one are unchanged by NFC and lower-cased one by one.
_LAST_PLAIN = "\u0130"
#: Letters below it, and maybe a punctuation mark.
_PLAIN_WORD = "^[A-Za-zªµºÀ-ÖØ-öø-į]+[.,;:!?]?$"


def byte_alphabet() -> dict[int, int]:
    """Bytes to the printable characters that stand for them in byte-level BPE
    vocabularies: visible Latin-1 characters stand for themselves, the other
    bytes, in order, for the characters from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: b for b in visible} | {b: 256 + i for i, b in enumerate(hidden)}


class HubTokenizer:
    """Ids of the tokenizers library, as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(file_of(name))
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.folds = "Lowercase" in repr(self.lib.normalizer)
        self.alphabet = byte_alphabet()
        self.words = Memo(self._ask, cap=100_000)  # most are asked once, as ``rest`` has them from then on
        self.first = Memo(lambda units: self._simplified("", units), cap=100_000)
        self.rest = Memo(lambda units: self._simplified(" ", units), cap=400_000)

    def _ask(self, texts: list[str]) -> list[bytes]:
        """Ids of each text from the whole chain of the library, or, where the
        text is one plain word, from its BPE model alone: such a word is
        normalised, one match of the pattern and has no added token."""
        out: list = [None] * len(texts)
        whole = []
        tokenize, alphabet, folds, space = self.lib.model.tokenize, self.alphabet, self.folds, chr(self.alphabet[0x20])
        column = pa.array(texts, pa.string())
        plain = pc.match_substring_regex(column, "^ ?[a-z]+$" if folds else "^ ?[A-Za-z]+$")
        symbols = pc.utf8_ltrim(column, " ") if folds else pc.replace_substring(column, " ", space, max_replacements=1)
        for i, symbol in zip(np.flatnonzero(plain).tolist(), symbols.filter(plain).to_pylist(), strict=True):
            out[i] = array("I", [t.id for t in tokenize(symbol)]).tobytes()
        for i in np.flatnonzero(pc.invert(plain)).tolist():
            text = texts[i]
            word = text[1:] if text[:1] == " " else text
            if word.isalpha() and max(word) < _LAST_PLAIN and not (folds and word != word.lower()):
                symbol = (word if folds else text).encode().decode("latin-1").translate(alphabet)
                out[i] = array("I", [t.id for t in tokenize(symbol)]).tobytes()
            else:
                whole.append(i)
        if whole:
            encoded = self.lib.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)
            for i, e in zip(whole, encoded, strict=True):
                out[i] = array("I", e.ids).tobytes()
        return out

    def _simplified(self, lead: str, units: list[str]) -> list[bytes]:
        """Answers for ``lead + unit``, asking once for the forms of a word.

        The patterns of both tokenizers always cut between a letter and a
        punctuation mark, so a mark that ends a word is a match of its own, and
        a line feed between two other characters than white space is a match of
        its own too; a tokenizer that lower-cases gives an ASCII word and its
        lower case the same ids.
        """
        column = pa.array(units, pa.string())
        plain = pc.match_substring_regex(column, _PLAIN_WORD)
        marked = pc.and_(plain, pc.match_substring_regex(column, _MARK_LAST))
        word = pc.if_else(marked, pc.utf8_slice_codeunits(column, 0, -1), column)
        if self.folds:
            word = pc.if_else(pc.and_(plain, pc.string_is_ascii(word)), pc.ascii_lower(word), word)
        words, plain, marked = (c.to_numpy(zero_copy_only=False).tolist() for c in (word, plain, marked))
        others = {i: self._parts(lead, units[i]) for i, simple in enumerate(plain) if not simple}
        known = self.words.learn({lead + w for w, simple in zip(words, plain, strict=True) if simple}.union(_MARKS, *others.values()))
        out = [known[lead + w] + known[u[-1]] if m else known[lead + w] if simple else b"" for u, w, simple, m in zip(units, words, plain, marked, strict=True)]
        for i, parts in others.items():
            out[i] = b"".join([known[w] for w in parts])
        return out

    def _parts(self, lead: str, unit: str) -> list[str]:
        """What a unit that is no plain word is asked as."""
        lines = unit.split("\n") if "\n" in unit and _LINE_BREAK.fullmatch(unit) else (unit,)
        parts = []
        for k, line in enumerate(lines):
            if k:
                parts.append("\n")
                lead = ""
            if line[-1:] in _MARKS and line[:-1].isalpha() and max(line) < _LAST_PLAIN:
                parts += [lead + (line[:-1].lower() if self.folds and line.isascii() else line[:-1]), line[-1]]
            else:
                parts.append(lead + (line.lower() if self.folds and line.isascii() else line))
        return parts

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text; null counts as empty."""
        out: list = [b""] * len(texts)
        straight, odd, alone = [], [], []
        for i, text in enumerate(texts):
            if text:
                if any(a in text for a in self.added):  # added tokens are looked for across units
                    alone.append(i)
                else:
                    (odd if _ODD_SPACE.search(text.replace("\n", " ") if self.folds else text) else straight).append(i)
        for i in alone:
            out[i] = self._ask([texts[i]])[0]
        # All white space is one space to a tokenizer that drops it.
        spaced = (lambda i: texts[i].replace("\n", " ")) if self.folds else texts.__getitem__
        if straight:
            self._glue(straight, pc.split_pattern(pa.array(map(spaced, straight), pa.string()), " "), out)
        if odd:
            self._glue(odd, pa.array([word_units(spaced(i)) for i in odd], pa.list_(pa.string())), out)
        return out

    def _glue(self, places: list[int], cut: pa.ListArray, out: list[bytes]) -> None:
        """Sets the ids of texts from their units; each distinct unit is looked up once."""
        offsets = cut.offsets.to_numpy().astype(np.int64)
        units = cut.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets -= offsets[0]
        coded = units.dictionary_encode()
        firsts = units.take(pa.array(offsets[:-1])).to_pylist()
        rest = coded.indices.to_numpy().astype(np.int64)
        is_rest = np.ones(len(rest), bool)
        is_rest[offsets[:-1]] = False
        used = np.zeros(len(coded.dictionary), bool)
        used[rest[is_rest]] = True
        words = coded.dictionary.filter(pa.array(used)).to_numpy(zero_copy_only=False).tolist()
        rest = (np.cumsum(used) - 1)[rest]
        blobs = self.rest.answers(words)
        first = self.first.learn(set(firsts))
        blobs += [first[w] for w in firsts]
        rest[~is_rest] = len(words) + np.arange(len(firsts))
        size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        data, start = np.frombuffer(b"".join(blobs), "<u4"), np.cumsum(size) - size
        n = size[rest]
        ends = np.r_[0, np.cumsum(n)]
        ids = data[np.repeat(start[rest] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        edges = (4 * ends[offsets]).tolist()
        for i, a, b in zip(places, edges[:-1], edges[1:], strict=True):
            out[i] = ids[a:b]


@lru_cache(maxsize=4)
def hub_tokenizer(name: str) -> HubTokenizer:
    """One per Python worker, which serves many tasks."""
    return HubTokenizer(name)

