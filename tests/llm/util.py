"""Awkward texts and tables shared by the operator tests."""

import random

WORDS = "the of And IN on é École straße ΑΣ 日本 x1 don't a,b ### $$$ 12".split()


def awkward_texts(seed=3, n=60):
    rng = random.Random(seed)
    texts = [None, "", " ", "\n\t ", "a", "A", "É", "one two three four", "One two three FOUR", "x" * 30_000, "word " * 9_000, "\x1cab\x85c　d", " lead", "trail ", "two  spaces"]
    texts += [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 80))) for _ in range(n)]
    texts += texts[20:30]  # repeated
    return texts


def frame(spark, texts, ids=None, extra=True):
    """documents with null and repeated ids, and columns whose names clash with the operators' own."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "x", None, 7) for i, t in zip(ids, texts, strict=True)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema)
    if extra:
        from pyspark.sql import functions as F

        for c in ("_id", "_t", "kept", "n", "size", "_row", "_rid", "_b", "n_entities", "label", "ids"):
            df = df.withColumn(c, F.lit(1))
    return df


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
