"""Parquet table scans (the internal table format) and review-table views of
the driver's tables.

Every view is a lazy projection over ``spark.read.parquet``: Catalyst prunes
the columns that the caller never uses and pushes filters into the scan.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Labels, RuleSet, TermVocabulary

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# --- review views of the driver tables ------------------------------------


def rating_expr(id_col: str = "doc_id"):
    """Surrogate star rating 1..5 from an integer id."""
    return (F.lit(1) + F.pmod(F.col(id_col), F.lit(5))).cast("int")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a review table: review_id, text, app_id, rating, lang."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("review_id"),
        "text",
        F.col("source").alias("app_id"),
        rating_expr("doc_id").alias("rating"),
        "lang",
    )


# Raw class label of a labelled document and the synonym map that turns it
# into the class names of the surrogate label dimension.
CLASS_SYNONYMS = {
    "q1 t0": "clean",
    "q0 t0": "low_quality",
    "q1 t1": "toxic",
    "q0 t1": "low_quality_toxic",
}
CLASS_LABELS = Labels(
    names=("clean", "low_quality", "toxic", "low_quality_toxic"),
    display={"clean": "Clean", "low_quality": "Low Quality", "toxic": "Toxic", "low_quality_toxic": "Low Quality Toxic"},
    synonyms=CLASS_SYNONYMS,
)
LANG_LABELS = Labels(
    names=("en", "fr", "de", "es"),
    display={"en": "English", "fr": "French", "de": "German", "es": "Spanish"},
    synonyms={"en": "en", "fr": "fr", "de": "de", "es": "es"},
)


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents ⟕ labels with a raw label column (null when unlabelled).

    The raw label is written like a hand-made CSV cell (``' Q1 T0'``): the
    loader has to trim, lower and map it (X3).
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels").select(
        "doc_id",
        F.concat(F.lit(" Q"), F.col("quality").cast("string"), F.lit(" T"), F.col("toxic").cast("string")).alias(
            "category"
        ),
    )
    return d.join(lab, "doc_id", "left")


def language_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with their language as class label (a label with text signal)."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("review_id"), "text", F.col("lang").alias("label"))


# FIXTURES §4 test vocabulary: the default vocabulary never matches the
# invented prose of the driver tables, this one reaches every branch.
TEST_RULES = RuleSet.from_dict(
    {
        "abuse": {"phrases": ["of the", "is the"], "tokens": ["idiot", "moron", "worthless", "clown"],
                  "exclude_phrases": ["that that"]},
        "french": {"phrases": ["de la", "que le"], "tokens": ["les", "des", "une"], "exclude_phrases": ["le la"]},
        "german": {"phrases": ["in die", "und der"], "tokens": ["und", "nicht", "der"], "exclude_phrases": ["die die"]},
        "spanish": {"phrases": ["de el", "que los"], "tokens": ["los", "del", "una"], "exclude_phrases": ["el el"]},
        "request": {"phrases": ["for the", "to be"], "tokens": ["with", "for"], "exclude_phrases": ["was not"]},
    },
    positive_phrases=["and the"],
    praise_exempt_label="request",
)
TEST_RULE_LABELS = Labels(
    names=tuple(TEST_RULES.labels),
    display={},
    synonyms={l: l for l in TEST_RULES.labels},
)
# Minority-class candidate vocabulary for the driver prose.
TEST_CANDIDATE_VOCAB = TermVocabulary(
    phrases=("of the", "in die", "de la", "que los"),
    tokens=("the", "und", "les", "los", "nicht"),
)
