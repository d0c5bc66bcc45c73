"""Aggregations (A1-A3, A5, A7) over review tables.

All are hash aggregates with map-side partial aggregation; the label
dimension joins are against one-row-per-class tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_by(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """A1: count by value, sorted by count desc then value."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), F.asc(col))


def label_dimension(spark, labels) -> DataFrame:
    return spark.createDataFrame([(l, i) for i, l in enumerate(labels)], "label string, label_order int")


def label_counts_fixed(df: DataFrame, labels, label_col: str = "label") -> DataFrame:
    """A2: counts in fixed label order with zeros for absent labels."""
    counts = df.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    dim = label_dimension(df.sparkSession, labels)
    # The label dimension is a fixed list of class names: a tiny broadcast.
    return (
        counts.join(F.broadcast(dim), "label", "right")
        .select("label", "label_order", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))
        .orderBy("label_order")
    )


def class_balance(df: DataFrame, label_col: str = "label") -> DataFrame:
    """A3: minority and majority class size and their ratio (half-even, 2 digits)."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min("n").alias("minority_count"), F.max("n").alias("majority_count")).select(
        "minority_count",
        "majority_count",
        F.when(F.col("minority_count") > 0, F.bround(F.col("majority_count") / F.col("minority_count"), 2))
        .otherwise(F.lit(0.0))
        .alias("imbalance_ratio"),
    )


def split_summary(split: DataFrame, label_col: str = "label", role_col: str = "dataset_role") -> DataFrame:
    """Rows per (role, label) with role totals and the grand total
    (rollup; totals carry ``label`` = null, the grand total also role = null)."""
    return split.rollup(role_col, label_col).agg(F.count(F.lit(1)).alias("n"))


def triage_summary(triaged: DataFrame) -> DataFrame:
    """A5: total, needs_review, positive in one pass."""
    from .. import config

    return triaged.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("sentiment") == config.SENTIMENT_NEEDS_REVIEW).alias("needs_review"),
        F.count_if(F.col("sentiment") == config.SENTIMENT_POSITIVE).alias("positive"),
    )


def map_as_text(col: str, labels) -> F.Column:
    """``label:count,...`` in fixed label order (stable text for comparisons)."""
    parts = [F.concat(F.lit(f"{l}:"), F.coalesce(F.col(col)[l], F.lit(0)).cast("string")) for l in labels]
    return F.concat_ws(",", *parts)


def summary_as_text(summary: DataFrame, labels) -> DataFrame:
    cols = [c for c in summary.columns if c not in ("label_counts_before_balance", "label_counts")]
    return summary.select(
        *cols,
        map_as_text("label_counts_before_balance", labels).alias("label_counts_before_balance"),
        map_as_text("label_counts", labels).alias("label_counts"),
    )

