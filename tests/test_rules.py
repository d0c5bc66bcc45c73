"""Weak-label rules and candidate scoring (FIXTURES.md §3, default vocabulary)."""

from revtriage import config
from revtriage.operators.labeling import relabel, security_candidates

CASES = [
    ("nice colours", None, 0, "too_weak"),
    (None, None, 0, "too_weak"),
    ("Payment failed at checkout", "payment_failure", 6, "high_confidence_rule_match"),
    ("payment failed and transfer failed", None, 3, "ambiguous_overlap"),
    ("payment failed but good app", None, 3, "positive_or_resolved"),
    ("please add the option to export, not working", None, 6, "positive_or_resolved"),
    ("good app, please add dark mode", "feature_request", 7, "high_confidence_rule_match"),
    ("please add a significant dark mode", None, 7, "positive_or_resolved"),
]


def test_relabel_branches(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_rest) in enumerate(CASES)], "id int, text string")
    got = {r.id: (r.suggested_label, r.rule_score, r.review_status) for r in relabel(df, config.DEFAULT_RULESET).collect()}
    for i, (_, label, score, status) in enumerate(CASES):
        assert got[i] == (label, score, status), CASES[i]


def test_security_score_and_terms(spark):
    df = spark.createDataFrame([(1, "Unauthorized access, this is fraud", 1)], "id int, text string, rating int")
    r = security_candidates(df, min_score=0, max_rating=5, top=0).first()
    assert r.security_score == 4
    assert r.matched_terms == "fraud, unauthorized, unauthorized access"
    assert r.label == "" and r.label_status == "security_candidate"


def test_rating_ceiling_keeps_unparsable(spark):
    rows = [(1, "fraud scam", None), (2, "fraud scam", "abc"), (3, "fraud scam", "3"), (4, "fraud scam", "4")]
    df = spark.createDataFrame(rows, "id int, text string, rating string")
    kept = sorted(r.id for r in security_candidates(df, max_rating=3.0, top=0, id_col="id").collect())
    assert kept == [1, 2, 3]


def test_candidate_top_k_order(spark):
    rows = [(1, "fraud", 1), (2, "fraud scam hack", 5), (3, "fraud scam", None), (4, "fraud scam", 2)]
    df = spark.createDataFrame(rows, "id int, text string, rating int")
    got = [r.id for r in security_candidates(df, min_score=1, max_rating=5, top=3, id_col="id").collect()]
    assert got == [2, 4, 3]


def test_scores_against_plain_python(spark):
    """Overlapping and repeated phrases, phrases inside words, every label of the default rules."""
    import random

    from revtriage.functions.rules import score_rows, vocabulary_rows
    from revtriage.functions.text import rule_clean, token_set

    rng = random.Random(2)
    rules = config.DEFAULT_RULESET
    entries = [e for r in rules.rules for e in (*r.phrases, *r.tokens, *r.exclude_phrases)] + list(rules.positive_phrases)
    texts = [" ".join(rng.sample(entries, rng.randrange(0, 9))) for _ in range(150)] + ["paypay bills payment unsuccessfully", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    x = score_rows(df.withColumns({"n": rule_clean("text")}).withColumn("w", token_set("n")), rules).collect()
    for r in x:
        found = {rule.label: rules.phrase_weight * sum(p in r.n for p in rule.phrases) + rules.token_weight * len(set(r.w) & set(rule.tokens)) for rule in rules.rules}
        assert r.rule_score == max(found.values()), r.text
    v = config.DEFAULT_SECURITY_VOCABULARY
    y = vocabulary_rows(df.withColumns({"n": rule_clean("text")}).withColumn("w", token_set("n")), v).collect()
    for r in y:
        terms = sorted({p for p in v.phrases if p in r.n} | set(r.w) & set(v.tokens))
        assert r.matched_terms == terms
        assert r.score == v.phrase_weight * sum(p in r.n for p in v.phrases) + v.token_weight * len(set(r.w) & set(v.tokens))
