"""Merge approved rows into a training table (S9 tail, F3, D3, J2, P7, D4, A8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .. import config
from ..functions.text import unicode_trim
from ..session import cut_lineage
from ..sinks.versions import base_table, write_version
from .quality import keep_first, key_digest


def candidate_rows(stacked: DataFrame, labels=config.LABEL_NAMES, order_cols: list[str] | None = None) -> DataFrame:
    """Clean the stacked relabelled inputs: text/label null -> '', trimmed;
    keep non-blank text with a supported label (exact membership); first
    row per (text, label) in input order (``order_cols``, a total order)."""
    if "text" not in stacked.columns or "label" not in stacked.columns:
        raise ValueError(f"an input to merge lacks text or label; it has {stacked.columns}")
    x = stacked.withColumn("text", unicode_trim(F.coalesce(F.col("text").cast("string"), F.lit("")))).withColumn(
        "label", unicode_trim(F.coalesce(F.col("label").cast("string"), F.lit("")))
    )
    x = x.where((F.col("text") != "") & F.col("label").isin(*labels))
    if order_cols:
        return keep_first(x, ["text", "label"], order_cols)
    return x.dropDuplicates(["text", "label"])


def new_pairs(base: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidate rows whose (text, label) is not in the base (base keys
    null -> '' and trimmed)."""
    text = lambda c: unicode_trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    keys = base.select(text("text").alias("text"), text("label").alias("label")).select(key_digest("text", "label").alias("_key")).distinct()
    return candidates.withColumn("_key", key_digest("text", "label")).join(keys, "_key", "left_anti").drop("_key")


def align_to(schema: StructType, df: DataFrame, *extra: Column) -> DataFrame:
    """The base's columns, order and types; a column that ``df`` lacks is
    '' if it holds strings, else null; other columns of ``df`` are dropped."""
    blank = {f.name: F.lit("") if f.dataType == StringType() else F.lit(None) for f in schema}
    return df.select(*[(F.col(f.name) if f.name in df.columns else blank[f.name]).cast(f.dataType).alias(f.name) for f in schema], *extra)


def merge_into(base: DataFrame, new_rows: DataFrame, base_order: str, new_order: str) -> DataFrame:
    """Base ∪ aligned new rows, dedup on raw (text, label), base first.

    ``base_order`` / ``new_order``: numeric columns giving the row order of
    each side (``new_order`` need not be a base column).  With no new rows
    the base is returned as it is, repeated pairs included.  Both sides are read
    more than once: write them down first.
    """
    if new_rows.isEmpty():
        return base
    cols = base.columns
    a = base.select(*cols, F.lit(0).alias("_src"), F.col(base_order).cast("long").alias("_ord"))
    b = align_to(base.schema, new_rows, F.lit(1).alias("_src"), F.col(new_order).cast("long").alias("_ord"))
    out = keep_first(a.unionByName(b), ["text", "label"], ["_src", "_ord"])
    return out.drop("_src", "_ord")


def added_by_label(new_rows: DataFrame) -> DataFrame:
    """A8."""
    return new_rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def merge_table(spark: SparkSession, table_dir: str, candidates: DataFrame, order: str = "review_id") -> tuple[DataFrame, DataFrame]:
    """Merges candidates into the newest version of a base table and
    writes the next one; another writer's commit in between is an error.
    Returns the merged table and the rows that were new."""
    base, number = base_table(spark, table_dir)
    new = cut_lineage(new_pairs(base, candidates))
    write_version(merge_into(base, new, order, order), table_dir, after=number)
    return base_table(spark, table_dir)[0], new
