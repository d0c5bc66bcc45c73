r"""Quality rules as weak supervision (native DataFrame functions only).

Each rule looks at one aspect of a text and votes good (+1) or bad (-1) or
abstains (0).  No rule decides alone: expectation-maximisation over all
documents estimates, without labels, how often each rule votes good or bad on
good texts and on each kind of junk (its accuracies), and a document's votes
then give the posterior probability that it is good.  Documents at ``threshold`` or above
stay, unless the fixed base rules fail.

Plan: the features of a text are computed in its row and written down (a few
numbers per document); the documents are grouped by their vote pattern (at
most ``3 ** len(RULES)`` rows whatever the size of the corpus); each EM step
is one aggregate over the patterns, of which the parameters (one number a
class and rule) come back; the posterior is an expression with the parameters as
literals.

Repeated 5-word windows are found in the row by 64-bit hashes of the windows:
two different windows of a text of n words share one with probability below
n * n / 2**65.

Defined results: null and blank texts have no words and fail the base rules;
an id of any type is kept as it is, null too (a struct of all columns as id
brings whole rows through without a join); repeated rows each get their row; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

SPACES = r"[\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PCT = 20
ITERATIONS = 12
THRESHOLD = 0.5


@dataclass(frozen=True)
class Rule:
    """``bad`` and ``good`` are SQL conditions on the features; neither: abstain."""

    name: str
    bad: str
    good: str


#: Conditions on integers only, so that every SQL engine decides them alike.
RULES = (
    Rule("symbols", "100 * n_symbols > 10 * n_words", "100 * n_symbols <= n_words"),
    Rule("repeats", "100 * n_repeat_words > 20 * n_words", "n_repeat_words = 0"),
    Rule("lines", "100 * n_dup_lines > 30 * n_lines", "n_dup_lines = 0"),
    Rule("word_length", "word_chars < 3 * n_words OR word_chars > 12 * n_words", "word_chars BETWEEN 4 * n_words AND 10 * n_words"),
    # A longer text repeats more of its words: from 1,000 words on, where both bounds meet, the square root decides.
    Rule("variety", "100 * n_distinct < 25 * n_words AND 2 * n_distinct * n_distinct < 125 * n_words", "100 * n_distinct >= 45 * n_words"),
    Rule("capitals", "100 * n_capitals > 40 * word_chars", "100 * n_capitals <= 15 * word_chars"),
    Rule("length", "n_words < 10", "n_words >= 30"),
)


#: A rule's bad condition is written so that at most this share of the good
#: texts it votes on meets it.  EM may find less, never more; without this bound
#: it is free to call the commonest kind of junk good.
MAX_FALSE = 0.01


@dataclass(frozen=True)
class Fit:
    """Class 0 is good; class k > 0 is junk of the kind that rule k - 1 looks
    for.  ``priors`` per class; ``rates[class][rule]`` = P(+1 | the rule votes)."""

    priors: tuple[float, ...]
    rates: tuple[tuple[float, ...], ...]


def start() -> Fit:
    """EM starts from: junk of one kind fails that rule and passes the others nearly as often as good texts."""
    m = len(RULES)
    junk = tuple(tuple(0.05 if j == k else 0.9 for j in range(m)) for k in range(m))
    return Fit((0.8, *[0.2 / m] * m), ((0.995,) * m, *junk))


def _repeat_words(h: str) -> str:
    """SQL: words covered by a window whose hash occurs twice or more in ``h``.

    Sorting (hash, place) brings equal hashes together; the places that have
    an equal neighbour, in order, each add the words up to the next one.
    """
    places = (
        "sort_array(transform(filter(sequence(0, size(s) - 1),"
        " k -> coalesce(get(s, k - 1).h = s[k].h, false) OR coalesce(get(s, k + 1).h = s[k].h, false)), k -> s[k].i))"
    )
    covered = f"aggregate(sequence(0, size(r) - 1), 0L, (n, k) -> n + least({WINDOW}, coalesce(get(r, k + 1) - r[k], {WINDOW})))"
    pairs = f"sort_array(transform({h}, (x, i) -> struct(x AS h, i AS i)))"
    bound = f"transform(transform(array({pairs}), s -> {places}), r -> {covered})[0]"
    return f"CASE WHEN size(array_distinct({h})) = size({h}) THEN 0L ELSE {bound} END"


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_distinct, n_capitals."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    x = docs.select(F.col(id_col).alias("_id"), text.alias("_t"))
    lines = F.filter(F.split("_t", "\n", -1), lambda s: s.rlike(HAS_WORD))
    words = F.filter(F.split("_t", SPACES, -1), lambda w: w != "")
    x = x.select(
        "_id",
        words.alias("_w"),
        lines.alias("_l"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("_t", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
    )
    last = f"size(_w) - {WINDOW - 1}"
    hashes = F.expr(f"CASE WHEN {last} < 2 THEN array() ELSE transform(sequence(1, {last}), i -> xxhash64(slice(_w, i, {WINDOW}))) END")
    x = x.select(
        "_id",
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
        "n_capitals",
        hashes.alias("_h"),
    )
    return x.withColumn("n_repeat_words", F.expr(_repeat_words("_h")).cast("long")).drop("_h")


def votes() -> Column:
    """Array of the rules' votes."""
    return F.array(*[F.expr(f"CASE WHEN n_words > 0 AND ({r.bad}) THEN -1 WHEN n_words > 0 AND ({r.good}) THEN 1 ELSE 0 END") for r in RULES])


def class_weights_sql(votes: str) -> str:
    """SQL: array of P(class, votes) from the arrays _priors and _rates; an abstention is no evidence."""
    m = len(RULES)
    rate = f"_rates[k * {m} + j]"
    product = f"aggregate(sequence(0, {m - 1}), _priors[k], (p, j) -> p * CASE {votes}[j] WHEN 1 THEN {rate} WHEN -1 THEN 1 - {rate} ELSE 1D END)"
    return f"transform(sequence(0, {m}), k -> {product})"


def with_posterior(rows: DataFrame, fit: Fit) -> DataFrame:
    """Adds _post, P(class | votes) per class.  The parameters enter as two
    array literals, so every EM step runs the same compiled code."""
    x = rows.withColumn("_priors", F.lit(list(fit.priors))).withColumn("_rates", F.lit([p for row in fit.rates for p in row]))
    x = x.withColumn("_w", F.expr(class_weights_sql("_votes")))
    x = x.withColumn("_sum", F.expr("aggregate(_w, 0D, (s, w) -> s + w)"))
    return x.withColumn("_post", F.expr("transform(_w, w -> w / _sum)")).drop("_priors", "_rates", "_w", "_sum")


def em_step(patterns: DataFrame, fit: Fit) -> Fit:
    """One EM step: an aggregate over the pattern table, smoothed by one vote of each kind."""
    x = with_posterior(patterns, fit).select("n", "_votes", F.posexplode("_post").alias("k", "_p"))
    mass = F.col("n") * F.col("_p")
    sums = [F.sum(F.when(F.col("_votes")[j] == v, mass).otherwise(0.0)).alias(f"s{j}_{v}") for j in range(len(RULES)) for v in (1, -1)]
    found = {s["k"]: s for s in x.groupBy("k").agg(F.sum(mass).alias("mass"), *sums).collect()}  # a row per class
    classes = range(len(fit.priors))
    total = sum(found[k]["mass"] for k in classes)
    rates = []
    for k in classes:
        row = [(found[k][f"s{j}_1"] + 1) / (found[k][f"s{j}_1"] + found[k][f"s{j}_-1"] + 2) for j in range(len(RULES))]
        rates.append(tuple(max(p, 1 - MAX_FALSE) for p in row) if k == 0 else tuple(row))
    return Fit(tuple((found[k]["mass"] + 1) / (total + len(classes)) for k in classes), tuple(rates))


def fit_rules(rows: DataFrame, iterations: int = ITERATIONS) -> Fit:
    """EM over the vote patterns of all rows; the start where there are none."""
    patterns = materialise(rows.groupBy("_votes").agg(F.count(F.lit(1)).cast("double").alias("n")).coalesce(1), "vote-patterns")
    fit = start()
    if not patterns.isEmpty():
        for _ in range(iterations):
            fit = em_step(patterns, fit)
    return fit


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", iterations: int = ITERATIONS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, the features, base_failed, p_good, kept."""
    rows = materialise(features(docs, id_col, text_col).withColumn("_votes", votes()), "quality", compression="zstd")
    fit = fit_rules(rows, iterations)
    failed = F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words")
    out = with_posterior(rows, fit).select(
        F.col("_id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        F.col("_post")[0].alias("p_good"),
    )
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
