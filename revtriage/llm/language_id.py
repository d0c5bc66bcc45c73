r"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, per slot, one bit per language.  The bits that
an n-gram's ``len(SHIFTS)`` slots have in common are all languages that contain
it, found in one look-up.  A text is decided by popcounts: for each language,
how many of the text's n-grams it contains, corrected for the filter's false
positives (with a share f of an absent language's n-grams found by chance, c of
n found mean ``(c - n * f) / (1 - f)`` contained ones).  The language with most
wins; on a tie the first by name.

N-grams are those of the lower-cased letter runs of a text with a space before
and after, of ``SIZES`` characters.  A language contains an n-gram if it makes
up at least ``MIN_RATE`` of the language's n-grams and its rate is at least
``MIN_SHARE`` of its highest rate in any language; so a language has at most
``1 / MIN_RATE`` n-grams whatever the size of the corpus, words of one language
quoted in another do not spread, and the filter (``SLOTS`` masks) has a fixed
size.  It is collected and sent to the tasks: 8 MB per 64 languages.

Plan: learning counts n-grams of all labelled rows in the tasks (one row per
task, language and n-gram leaves them), sums them by n-gram, and sums the masks
by slot; prediction is one narrow pass.  In both, n-grams are made once per
distinct word of about 2 MB of text.

Defined results: a text that is null or has no letter is ``und`` with score 0,
and so is every text if nothing was learned; a row without label or text
teaches nothing; a null id is not held out; repeated rows each get their row; an
empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise
from .units import slices

SIZES = (1, 2, 3, 4)
MIN_RATE = 2.0**-17
MIN_SHARE = 0.25
SLOTS = 1 << 20
SHIFTS = (0, 20, 40)
UNKNOWN = "und"
#: More labels than this are no languages.
MAX_LANGUAGES = 1024
#: N-grams that a task holds before it lets its counts go.
FLUSH_GRAMS = 2_000_000

_LETTERS = re.compile(r"[^\W\d_]+")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63], np.uint64)


def letter_runs(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of the words, each with a space before and after, and the word of each."""
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), "<u4").astype(np.uint64)
    spaces = np.cumsum(codes == 32)
    hashes, owners = [], []
    for n in SIZES:
        last = len(codes) - n + 1
        if last < 1:
            continue
        h = np.full(last, n, np.uint64)
        for k in range(n):
            h += codes[k : k + last] * _ODD[k % 4]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        # A space may only be an n-gram's first or last character.
        inner = spaces[n - 2 : n - 2 + last] == spaces[:last] if n > 2 else codes[:last] != 32 if n == 1 else np.ones(last, bool)
        if n == 2:
            inner[-1:] = codes[last - 1] != 32
        hashes.append(h[inner])
        owners.append(spaces[:last][inner] - 1)
    return np.concatenate(hashes), np.concatenate(owners)


@dataclass(frozen=True)
class LanguageFilters:
    """``masks[w, slot]``: bit i for language 64 * w + i; ``chance[l]``: share of foreign n-grams found in language l."""

    languages: tuple[str, ...]
    masks: np.ndarray
    chance: np.ndarray

    @staticmethod
    def of(languages: tuple[str, ...], masks: np.ndarray) -> LanguageFilters:
        filled = [np.count_nonzero(masks[i // 64] >> np.uint64(i % 64) & np.uint64(1)) / SLOTS for i in range(len(languages))]
        return LanguageFilters(languages, masks, np.array(filled) ** len(SHIFTS))

    def contained(self, hashes: np.ndarray) -> np.ndarray:
        """Masks (one row per 64 languages) of the languages that contain each n-gram."""
        out = None
        for shift in SHIFTS:
            found = self.masks[:, (hashes >> np.uint64(shift)) & np.uint64(SLOTS - 1)]
            out = found if out is None else out & found
        return out

    def word_counts(self, words: list[str]) -> np.ndarray:
        """Per word: its n-grams, then those that each language contains."""
        hashes, owner = grams(words)
        order = np.argsort(owner, kind="stable")
        found, owner = self.contained(hashes[order]), owner[order]
        starts = np.searchsorted(owner, np.arange(len(words)))
        columns = [np.diff(np.r_[starts, len(owner)])]
        for i in range(len(self.languages)):
            columns.append(np.add.reduceat((found[i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(np.int64), starts))
        return np.stack(columns, 1)

    def decide(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score (the corrected share of the n-grams it contains) of each text."""
        runs = [letter_runs(t) for t in texts]
        number: dict[str, int] = {}
        places = [[number.setdefault(w, len(number)) for w in words] for words in runs]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not number or not self.languages:
            return names, scores
        counts = self.word_counts(list(number))
        for k, mine in enumerate(places):
            if mine:
                n, *found = counts[mine].sum(axis=0).tolist()
                share = (np.array(found) / n - self.chance) / (1 - self.chance + 1e-12)
                best = int(np.argmax(share))
                names[k], scores[k] = self.languages[best], float(min(1.0, max(0.0, share[best])))
        return names, scores


def gram_counts(docs: DataFrame, languages: list[str], text_col: str, lang_col: str) -> DataFrame:
    """language, gram, n: one row per task (or ``FLUSH_GRAMS`` n-grams), language and n-gram."""
    src = docs.select(F.col(lang_col).alias("_l"), F.col(text_col).alias("_t"))
    place = {name: i for i, name in enumerate(languages)}

    def run(batches):
        held: dict[int, list] = {}
        size = 0

        def let_go():
            for i, parts in held.items():
                h, n = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), i, np.int32)), pa.array(h.view(np.int64)), pa.array(n)], ["language", "gram", "n"])

        for batch in batches:
            for first, texts in slices(batch, 1):
                words: dict[int, Counter] = {}
                for k, t in enumerate(texts, first):
                    i = place.get(batch.column(0)[k].as_py())
                    if i is not None:
                        words.setdefault(i, Counter()).update(letter_runs(t))
                for i, counter in words.items():
                    if counter:
                        h, owner = grams(list(counter))
                        part = merged([(h, np.fromiter(counter.values(), np.int64, len(counter))[owner])])
                        size += len(part[0])
                        held.setdefault(i, []).append(part)
                if size > FLUSH_GRAMS:
                    held = {i: [merged(parts)] for i, parts in held.items()}
                    size = sum(len(parts[0][0]) for parts in held.values())
                    if size > FLUSH_GRAMS // 2:
                        yield from let_go()
                        held, size = {}, 0
        yield from let_go()

    return map_arrow(src, run, "language int, gram long, n long")


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and their summed counts."""
    h, n = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    order = np.argsort(h)
    h, n = h[order], n[order]
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return h[starts], np.add.reduceat(n, starts)


def learn_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageFilters:
    """The filters of all languages of the labelled rows."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    languages = sorted(r[0] for r in labelled.select(lang_col).distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels")
    width = max(1, -(-len(languages) // 64))
    masks = np.zeros((width, SLOTS), np.uint64)
    if languages:
        counted = gram_counts(labelled, languages, text_col, lang_col).groupBy("language", "gram").agg(F.sum("n").alias("n"))
        counted = materialise(counted, "gram-counts")
        total = {r["language"]: r["n"] for r in counted.groupBy("language").agg(F.sum("n").alias("n")).collect()}  # a row per language
        totals = F.lit([float(total.get(i, 1)) for i in range(len(languages))])
        rate = F.col("n") / totals[F.col("language")]
        rates = counted.select("gram", "language", rate.alias("rate")).where(F.col("rate") >= MIN_RATE)
        of_gram = rates.groupBy("gram").agg(F.collect_list(F.struct("language", "rate")).alias("_r"), F.max("rate").alias("_top"))  # a row per language
        contains = F.filter("_r", lambda r: r["rate"] >= MIN_SHARE * F.col("_top"))
        member = of_gram.select("gram", F.explode(contains).alias("_r")).select("gram", F.col("_r.language").alias("language"))
        slots = F.array(*[F.shiftrightunsigned("gram", s).bitwiseAND(F.lit(SLOTS - 1)) for s in SHIFTS])
        bit = F.lit([1 << k if k < 63 else -(1 << 63) for k in range(64)])[F.col("language") % 64]
        of_slot = member.select(F.explode(slots).alias("slot"), F.floor(F.col("language") / 64).alias("_word"), bit.alias("_bit"))
        words = [F.bit_or(F.when(F.col("_word") == w, F.col("_bit")).otherwise(F.lit(0).cast("long"))).alias(f"m{w}") for w in range(width)]
        filled = of_slot.groupBy("slot").agg(*words).toArrow()  # at most SLOTS rows
        for i in range(width):
            masks[i, filled["slot"].to_numpy()] = filled[f"m{i}"].to_numpy().view(np.uint64)
    return LanguageFilters.of(tuple(languages), masks)


def predict_languages(docs: DataFrame, filters: LanguageFilters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score per row."""
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        for batch in batches:
            for first, texts in slices(batch, 1):
                names, scores = sent.value.decide(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["_id", "lang_pred", "score"])

    id_type = src.schema["_id"].dataType.simpleString()
    return map_arrow(src, run, f"_id {id_type}, lang_pred string, score double").withColumnRenamed("_id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from learning."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred, score: learned from the labelled rows that are not held out."""
    filters = learn_languages(docs.where(~held_out(id_col)), text_col, lang_col)
    out = predict_languages(docs, filters, id_col, text_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
