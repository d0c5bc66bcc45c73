r"""Periodic runs of words by a dictionary of basic factors.

A run is a stretch of words with smallest period q (words q apart are
identical) of at least ``max(MIN_LENGTH, 2 * q)`` words which no neighbouring
word extends with that period.

The dictionary names, for each power of two m, the factors of m words: a factor
is the pair of the names of its halves, and pairs are named by sorting.  Factors
that occur once in their document get no name, and neither do longer factors
that hold one, so ordinary prose is left out after a few levels.

*Proposals.*  A run of period q, with m the power of two in (q/2, q], holds a
factor of m words that occurs again q words later, within 2m.  Occurrences of
one factor at most m/2 apart form an arithmetic progression, whose step is the
factor's own smallest period.  A pair of occurrences q apart can be shifted by
that step, inside its run, until one of the two ends its progression; so it is
enough to propose the distances between the members of one progression and the
ends of those near it, of which fewer than five lie within 2m.  Runs of periods
below ``FIRST`` are long enough to be found by factors of ``FIRST`` words.

*Extension.*  Proposals of one distance that touch are merged; the rest grow
both ways by longest common extensions, read off the dictionary from long
factors to short ones.  Equal stretches are one run, of their smallest period
(two periods of a stretch at least twice as long as either share a divisor that
is a period too, and that one is proposed itself).

Plan: one narrow pass (``mapInArrow``), no shuffle; documents are named together
in batches of about 2 MB, a longer text alone.  Work is n log n in the words of
a batch whatever the texts repeat.

Defined results: null, empty and blank texts have no words, no runs and
collapse to an empty text; repeated rows each get their row; a null id is kept;
an empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, map_arrow
from .units import slices

MIN_LENGTH = 12
#: Shortest factor that proposes: a run of period below it has MIN_LENGTH words, so it holds two such factors.
FIRST = 4


class BasicFactors:
    """Names of the repeated factors of ``words``, integers that are equal for
    equal words of one document and differ between documents."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # places, ascending, and names
        self.occurrences: list[tuple[np.ndarray, np.ndarray]] = []  # places by name, then place; names
        keys, places = words, np.arange(self.n)
        while True:
            places, names = self._named(keys, places)
            if not len(places):
                break
            self.occurrences.append((places, names))
            order = np.argsort(places)
            places, names = places[order], names[order]
            self.levels.append((places, names))
            half = 1 << (len(self.levels) - 1)
            dense = np.full(self.n + half, -1, np.int64)
            dense[places] = names
            right = dense[places + half]
            whole = right >= 0
            places = places[whole]
            keys = names[whole] * self.n + right[whole]

    @staticmethod
    def _named(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the keys that occur twice or more, by key and place, and a number per key."""
        if not len(keys):
            return places, places
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        same = ordered[1:] == ordered[:-1]
        again = np.r_[False, same] | np.r_[same, False]
        fresh = np.r_[True, ~same][again]
        return places[order[again]], np.cumsum(fresh) - 1

    def _name_at(self, level: int, at: np.ndarray) -> np.ndarray:
        places, names = self.levels[level]
        slot = np.minimum(np.searchsorted(places, at), len(places) - 1)
        return np.where(places[slot] == at, names[slot], -1)

    def extension(self, x: np.ndarray, y: np.ndarray, back: bool) -> np.ndarray:
        """Words that agree from x and y on, or, if ``back``, before them."""
        total = np.zeros(len(x), np.int64)
        for level in reversed(range(len(self.levels))):
            step = 1 << level
            shift = -total - step if back else total
            a, b = self._name_at(level, x + shift), self._name_at(level, y + shift)
            total += np.where((a >= 0) & (a == b), step, 0)
        return total

    def proposals(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, period): pairs of equal factors of 2**level words that start the extension."""
        occ, names = self.occurrences[level]
        m = 1 << level
        least = 1 if m == FIRST else m
        linked = (names[1:] == names[:-1]) & (np.diff(occ) <= m // 2)
        group = np.r_[0, np.cumsum(~linked)]
        last = np.flatnonzero(np.r_[~linked, True])
        end, owner = occ[last], names[last]
        first = np.r_[0, last[:-1] + 1]
        at, period = [occ[:0]], [occ[:0]]
        if m == FIRST:  # steps of the progressions themselves are shorter than m
            many = first < last
            at.append(occ[first[many]])
            period.append(occ[first[many] + 1] - occ[first[many]])
        for sign in (1, -1):
            member = np.arange(len(occ))
            for hop in range(1, len(end) + 1):
                other = group[member] + sign * hop
                inside = (other >= 0) & (other < len(end))
                member, other = member[inside], other[inside]
                apart = sign * (end[other] - occ[member])
                near = (owner[other] == names[member]) & (apart < 2 * m)
                member, other, apart = member[near], other[near], apart[near]
                if not len(member):
                    break
                fits = apart >= least
                at.append(occ[member[fits]] if sign > 0 else end[other[fits]])
                period.append(apart[fits])
        at, period = np.concatenate(at), np.concatenate(period)
        order = np.lexsort((at, period))
        at, period = at[order], period[order]
        apart = np.r_[True, (np.diff(period) != 0) | (np.diff(at) > m)][: len(at)]
        return at[apart], period[apart]

    def runs(self, min_length: int = MIN_LENGTH) -> np.ndarray:
        """Rows (start, length, period) of all runs, by start and period."""
        found = [np.empty((0, 3), np.int64)]
        for level in range(FIRST.bit_length() - 1, len(self.levels)):
            at, q = self.proposals(level)
            if not len(at):
                continue
            before = self.extension(at, at + q, back=True)
            length = before + self.extension(at, at + q, back=False) + q
            keep = length >= np.maximum(min_length, 2 * q)
            found.append(np.stack([at - before, length, q], 1)[keep])
        rows = np.concatenate(found)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        fresh = np.r_[True, (np.diff(rows[:, :2], axis=0) != 0).any(axis=1)][: len(rows)]
        rows = rows[fresh]
        return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def word_runs(texts: list[list[bytes]], min_length: int = MIN_LENGTH) -> list[np.ndarray]:
    """Runs (start, length, period) of each list of words."""
    if min_length < MIN_LENGTH:
        raise ValueError(f"runs of fewer than {MIN_LENGTH} words need shorter first factors")
    number: dict[bytes, int] = {}
    for words in texts:
        for w in set(words).difference(number):
            number[w] = len(number)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = [np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for words in texts]
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    rows = BasicFactors(np.concatenate([*flat, np.empty(0, np.int64)]) + owner * max(1, len(number))).runs(min_length)
    of = owner[rows[:, 0]] if len(rows) else np.empty(0, np.int64)
    rows[:, 0] -= starts[of]
    return np.split(rows, np.searchsorted(of, np.arange(1, len(texts))))


def collapsed(words: list[bytes], runs: np.ndarray) -> str:
    """The words without those that some run holds after its first period, joined by spaces."""
    if len(runs):
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
        words = compress(words, (np.cumsum(edge[:-1]) == 0).tolist())
    return b" ".join(words).decode()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """id, n_words, runs (array of start, length, period; by start and period) and collapsed per row."""
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def find(batches):
        for batch in batches:
            for first, texts in slices(batch, 1):
                words = [t.encode().split() if t else [] for t in texts]  # cuts at ASCII white space only
                found = word_runs(words, min_length)
                rows = np.concatenate(found)
                flat = pa.StructArray.from_arrays([pa.array(rows[:, k].copy()) for k in range(3)], fields=list(kind))
                offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(texts)),
                        pa.array([len(w) for w in words], pa.int64()),
                        pa.ListArray.from_arrays(offsets, flat),
                        pa.array([collapsed(w, r) for w, r in zip(words, found, strict=True)], pa.string()),
                    ],
                    ["_id", "n_words", "runs", "collapsed"],
                )

    id_type = src.schema["_id"].dataType.simpleString()
    out = map_arrow(src, find, f"_id {id_type}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return out.withColumnRenamed("_id", id_col)


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text, in which a tenth of the documents (by the crc32 of their id) goes on periodically from some word."""
    words = f"filter(split(`{text_col}`, '[{SPACE_CLASS}]+', -1), w -> w <> '')".replace("\\", "\\\\")
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    # Each array(..)[0] binds a value that is made once a row.
    n = "greatest(size(ws), 1)"
    bound = f"transform(array({words}), ws -> struct(ws, cast(_g % {n} AS int) AS a, cast(1 + ({n} - _g % {n}) div (3 + _g % 8) AS int) AS p))"
    turned = "array_join(transform(x.ws, (w, i) -> CASE WHEN i >= x.a THEN x.ws[x.a + (i - x.a) % x.p] ELSE w END), ' ')"
    rows = docs.select(F.col(id_col), F.col(text_col), h.alias("_h")).withColumn("_g", F.expr("_h div 10"))
    planted = F.expr(f"transform({bound}, x -> {turned})[0]")
    return rows.select(F.col(id_col), F.when(F.col("_h") % 10 == 0, planted).otherwise(F.col(text_col)).alias(text_col))


def run_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of ``periodic_runs``: the number of runs, the longest one, and digests of all runs and of the collapsed text."""
    best = F.expr("array_max(transform(runs, r -> struct(r.length, -r.start AS s, -r.period AS p)))")
    lines = F.expr("array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\n'), '')")
    x = found.withColumn("_best", best)
    return x.select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.s")).alias("start"),
        F.col("_best.length").alias("length"),
        (-F.col("_best.p")).alias("period"),
        F.expr("1000 * _best.length div -_best.p").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
