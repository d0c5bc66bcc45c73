"""Weak-label rule scoring as native column expressions.

Phrases are matched as substrings of the rule-cleaned text (no word
boundary), tokens against the text's word set.  A vocabulary is one literal
array of all its phrases and one of all its tokens, whatever the number of
labels: a row's phrases found and tokens present are two small arrays, made
once, and each label's score is the size of their intersection with its own
literal array.  Code size does not grow with the vocabulary, so the generated
methods stay small enough to be compiled, and nothing is joined or shuffled.
``score_rows`` adds the steps as separate projections so that each is computed
once per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RuleSet, TermVocabulary
from .text import rule_clean, token_set


def fence(df: DataFrame, cols: list[str]) -> DataFrame:
    """Emit computed columns through a one-row ``inline`` (a Generate).

    A filter on a projected alias is pushed below the projection by
    substituting the alias, which would repeat an expensive expression (text
    cleaning, word sets) once per reference.  Predicates on generated
    columns stay above the Generate, so the scores are computed once."""
    order = list(df.columns)
    others = [c for c in order if c not in cols]
    out = df.select(*others, F.inline(F.array(F.struct(*[F.col(c) for c in cols]))))
    return out.select(*order)


def _literal(words) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def phrases_found(norm: Column, phrases) -> Column:
    """The distinct phrases that are substrings of the text."""
    return F.filter(_literal(list(dict.fromkeys(phrases))), lambda p: F.contains(norm, p))


def tokens_present(words: Column, tokens) -> Column:
    """The distinct vocabulary tokens in the word set."""
    return F.array_intersect(words, _literal(list(dict.fromkeys(tokens))))


def entry_count(found: Column, entries) -> Column:
    """How many of the list's entries are among ``found``; an entry that the list repeats counts as often."""
    distinct = list(dict.fromkeys(entries))
    out = F.size(F.array_intersect(found, _literal(distinct))) if distinct else F.lit(0)
    for e in distinct:
        if (n := list(entries).count(e)) > 1:
            out = out + F.lit(n - 1) * F.array_contains(found, F.lit(e)).cast("int")
    return out


def term_score(found: Column, present: Column, phrases, tokens, phrase_weight=2, token_weight=1) -> Column:
    """Weight per phrase found + weight per token in the word set."""
    return (F.lit(phrase_weight) * entry_count(found, phrases) + F.lit(token_weight) * entry_count(present, list(dict.fromkeys(tokens)))).cast("int")


def excluded(found: Column, label: Column, ruleset: RuleSet) -> Column:
    """Praise phrase (unless the winner is exempt) or an exclude phrase of the winner."""
    praise = F.arrays_overlap(found, _literal(ruleset.positive_phrases))
    if ruleset.praise_exempt_label is not None:
        praise = praise & (label != F.lit(ruleset.praise_exempt_label))
    own = F.lit(False)
    for r in ruleset.rules:
        own = F.when(label == F.lit(r.label), F.arrays_overlap(found, _literal(r.exclude_phrases))).otherwise(own)
    return praise | own


def score_rows(df: DataFrame, ruleset: RuleSet, text_col: str = "text", prefix: str = "_w") -> DataFrame:
    """X7 over a table: adds suggested_label, rule_score, review_status.

    Decisions in order: top < min_score -> too_weak; top < second + margin
    -> ambiguous_overlap; excluded -> positive_or_resolved; else the label.
    Ties between labels go to the earlier label (I7).
    """
    phrases = [p for r in ruleset.rules for p in (*r.phrases, *r.exclude_phrases)] + list(ruleset.positive_phrases)
    x = _matches(df, text_col, phrases, [t for r in ruleset.rules for t in r.tokens], prefix)
    n, w = F.col(f"{prefix}found"), F.col(f"{prefix}present")
    score_cols = [f"{prefix}s{i}" for i in range(len(ruleset.rules))]
    x = x.withColumns(
        {c: term_score(n, w, r.phrases, r.tokens, ruleset.phrase_weight, ruleset.token_weight) for c, r in zip(score_cols, ruleset.rules)}
    )
    ranked = F.sort_array(
        F.array(*[F.struct((-F.col(c)).alias("neg"), F.lit(i).alias("priority"), F.lit(r.label).alias("label"))
                  for i, (c, r) in enumerate(zip(score_cols, ruleset.rules))])
    )
    x = x.withColumn(f"{prefix}ranked", ranked)
    rk = F.col(f"{prefix}ranked")
    top = (-rk.getItem(0)["neg"]).cast("int")
    second = (-rk.getItem(1)["neg"]).cast("int") if len(ruleset.rules) > 1 else F.lit(None).cast("int")
    x = x.withColumns({f"{prefix}top": top, f"{prefix}second": second, f"{prefix}label": rk.getItem(0)["label"]})
    t, s2, lab = F.col(f"{prefix}top"), F.col(f"{prefix}second"), F.col(f"{prefix}label")
    ambiguous = (t < s2 + F.lit(ruleset.min_margin)) if len(ruleset.rules) > 1 else F.lit(False)
    status = (
        F.when(t < ruleset.min_score, F.lit("too_weak"))
        .when(ambiguous, F.lit("ambiguous_overlap"))
        .when(excluded(n, lab, ruleset), F.lit("positive_or_resolved"))
        .otherwise(F.lit("high_confidence_rule_match"))
    )
    x = x.withColumn("review_status", status)
    x = x.withColumn(
        "suggested_label",
        F.when(F.col("review_status") == "high_confidence_rule_match", lab).otherwise(F.lit(None).cast("string")),
    ).withColumn("rule_score", t)
    out = x.select(*df.columns, "suggested_label", "rule_score", "review_status")
    return fence(out, ["suggested_label", "rule_score", "review_status"])


def _matches(df: DataFrame, text_col: str, phrases, tokens, prefix: str) -> DataFrame:
    """Adds the phrases found and the tokens present."""
    norm = f"{prefix}norm"
    x = df.withColumn(norm, rule_clean(text_col))
    x = x.withColumns({f"{prefix}found": phrases_found(F.col(norm), phrases), f"{prefix}present": tokens_present(token_set(norm), tokens)})
    return x.drop(norm)


def vocabulary_rows(df: DataFrame, vocab: TermVocabulary, text_col: str = "text", prefix: str = "_v") -> DataFrame:
    """X8 over a table: adds ``score`` and ``matched_terms`` (array)."""
    found, present = f"{prefix}found", f"{prefix}present"
    x = _matches(df, text_col, vocab.phrases, vocab.tokens, prefix)
    x = x.withColumn("score", term_score(F.col(found), F.col(present), vocab.phrases, vocab.tokens, vocab.phrase_weight, vocab.token_weight))
    x = x.withColumn("matched_terms", F.sort_array(F.array_union(found, present)))
    return fence(x.drop(found, present), ["score", "matched_terms"])
