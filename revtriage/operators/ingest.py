"""Review ingest from landed store dumps.

The reference calls a store API per app; here the reviews are already
landed as files/tables and the same projection, cleanup and per-app cap are
table operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.text import unicode_trim
from ..session import cut_lineage
from .quality import keep_first

RAW_COLUMNS = [
    "review_id", "text", "app_name", "app_id", "store_source", "rating", "review_date",
    "thumbs_up_count", "review_created_version", "app_version",
]


def newest_per_app(df: DataFrame, count: int, key: str = "app_id", date_col: str = "review_date", id_col: str = "review_id") -> DataFrame:
    """The ``count`` newest reviews of each app (ties by id).

    ``row_number() <= constant`` lets Spark insert a per-partition group
    limit before the shuffle, so a hot app never ships all of its rows."""
    w = Window.partitionBy(key).orderBy(F.col(date_col).desc_nulls_last(), F.col(id_col).asc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= count).drop("_rn")


def raw_reviews(landed: DataFrame, targets: DataFrame, order_col: str = "review_id", target_order: str | None = None) -> DataFrame:
    """S6 + J4 + D2: enrich with the app name (of repeated app ids the first
    target by ``target_order``, or the smallest name), trim text (null -> ''),
    constant store source, drop blanks, keep the first row per
    (review_id, text)."""
    name = F.min_by("app_name", target_order) if target_order else F.min("app_name")
    x = landed.join(targets.groupBy("app_id").agg(name.alias("app_name")), "app_id", "inner")
    x = x.withColumn("text", unicode_trim(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    x = x.withColumn("store_source", F.lit(config.STORE_SOURCE))
    for c in RAW_COLUMNS:
        if c not in x.columns:
            x = x.withColumn(c, F.lit(None).cast("string"))
    x = x.select(*RAW_COLUMNS, F.col(order_col).alias("_ord")).where(F.col("text") != "")
    return keep_first(x, ["review_id", "text"], ["_ord"]).drop("_ord")


def label_ready(raw: DataFrame) -> DataFrame:
    """The annotation sheet: blank label after the text, blank notes,
    blank assignee, status ``unlabeled``."""
    return raw.select(
        "text",
        F.lit("").alias("label"),
        "app_name",
        "app_id",
        "store_source",
        "rating",
        "review_date",
        "review_id",
        F.lit("").alias("label_notes"),
        F.lit("").alias("assigned_to"),
        F.lit(config.UNLABELED_STATUS).alias("label_status"),
    )


def live_reviews(landed: DataFrame, app_id: str, count: int, english) -> DataFrame:
    """One app, newest ``count``, five fields, drop blank text, first row
    per (review id, text), English only.  ``english`` is a column predicate
    or a function DataFrame -> DataFrame adding ``is_english``."""
    x = landed.where(F.col("app_id") == app_id)
    x = newest_per_app(x, count)
    x = x.select(
        "review_id", "review_date", "rating",
        unicode_trim(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
        F.col("thumbs_up_count").alias("thumbs_up"),
        *([c for c in ["lang"] if c in landed.columns]),
    ).where(F.col("text") != "")
    # First in fetch order = newest first.
    newest_first = F.coalesce(-F.unix_micros(F.col("review_date").cast("timestamp")), F.lit((1 << 63) - 1))  # no date: last
    x = keep_first(x, ["review_id", "text"], [newest_first])
    if callable(english):
        return english(x).where(F.col("is_english")).drop("is_english")
    return x.where(english)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """V5: an error where a source is empty, raised by one task's look at a row."""
    if df.isEmpty():
        raise ValueError(f"{what}: no rows")
    return df


def collect_live(landed: DataFrame, app_id: str, count: int, english) -> DataFrame:
    """S8 with the reference's two errors: nothing landed for the app, nothing usable in English."""
    require_rows(landed.where(F.col("app_id") == app_id), f"reviews of {app_id}")
    return require_rows(cut_lineage(live_reviews(landed, app_id, count, english)), f"usable English reviews of {app_id}")
