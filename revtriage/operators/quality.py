"""Filters, validation, dedup and anti joins (F*, V*, D*, J1, J2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config



def key_digest(*cols: str) -> Column:
    """256 bits of a row's key; null and every text differ, and so do keys cut
    at other places."""
    parts = [F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in cols]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def keep_first(df: DataFrame, keys: list[str], order_cols: list) -> DataFrame:
    """One row per key, the first by ``order_cols`` (one integer column or
    two, a total order; null last), with its other columns.  Null keys are equal to each other.

    Two steps, neither of which sorts or groups on the key's text: a hash
    aggregate finds the smallest order per 256-bit digest of the key, collapsing
    a key that holds a third of all rows before the shuffle; then the rows meet
    these winners on (digest, order), which spreads such a key's rows over all
    tasks.  Rows that tie in key and order are cut to one.  ``df`` is read
    twice: callers write down what is costly to make.
    """
    order = [(F.col(c) if isinstance(c, str) else c).cast("long") for c in order_cols]
    if len(order) == 1:
        place = F.coalesce(order[0], F.lit((1 << 63) - 1))
    else:  # a rank below 10 ** 17 in size, then the order within it
        rank, within = order
        place = rank.cast("decimal(18,0)") * F.lit(str(10**20)).cast("decimal(21,0)") + F.coalesce(within, F.lit((1 << 63) - 1)).cast("decimal(19,0)")
        place = place.cast("decimal(38,0)")
    x = df.withColumns({"_key": key_digest(*keys), "_place": place})
    winners = x.select("_key", "_place").groupBy("_key").agg(F.min("_place").alias("_place"))
    found = x.join(winners, ["_key", "_place"], "left_semi")
    ties = Window.partitionBy("_key", "_place").orderBy(F.lit(0))
    return found.withColumn("_tie", F.row_number().over(ties)).where("_tie = 1").select(*df.columns)


def mark_keys(df: DataFrame, exclude: DataFrame, keys: list[str], flag: str = "_hit") -> DataFrame:
    """Flag rows whose key occurs in ``exclude`` (left join on the distinct
    256-bit digests of the keys: no text is a join key).  Null keys occur nowhere."""
    k = exclude.dropna(subset=keys).select(key_digest(*keys).alias("_key")).distinct().withColumn(flag, F.lit(True))
    return df.withColumn("_key", key_digest(*keys)).join(k, "_key", "left").drop("_key").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def rating_ceiling(df: DataFrame, max_rating: float, col: str = "rating") -> DataFrame:
    """keep ratings <= max; unparsable or null ratings count as max (kept).
    Applied only when the column exists and ``max_rating`` < 5."""
    if col not in df.columns or max_rating >= 5:
        return df
    r = F.coalesce(F.col(col).try_cast("double"), F.lit(float(max_rating)))
    return df.where(r <= F.lit(float(max_rating)))


def validation_table(label_counts: DataFrame, labels, min_rows: int = config.MIN_DATASET_ROWS) -> DataFrame:
    """V1-V3 as a table (check, ok, detail) computed from the class count table.

    ``label_counts``: (label, n) of the cleaned dataset – one row per class.
    """
    spark = label_counts.sparkSession
    dim = spark.createDataFrame([(l, i) for i, l in enumerate(labels)], "label string, pos int")
    # Both sides hold one row per class.
    joined = label_counts.join(dim, "label", "full")
    missing = F.filter(
        F.array_sort(F.collect_list(F.when(F.col("n").isNull(), F.struct("pos", "label")))), lambda s: s.isNotNull()
    )
    a = joined.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("all_rows"),
        F.array_join(F.transform(missing, lambda s: s["label"]), ", ").alias("missing"),
        F.coalesce(F.min("n"), F.lit(0)).alias("min_n"),
    )
    return a.select(
        F.explode(
            F.array(
                F.struct(F.lit("min_rows").alias("check"), (F.col("all_rows") >= min_rows).alias("ok"),
                         F.concat(F.lit("rows="), F.col("all_rows").cast("string")).alias("detail")),
                F.struct(F.lit("all_labels_present").alias("check"), (F.col("missing") == "").alias("ok"),
                         F.col("missing").alias("detail")),
                F.struct(F.lit("min_rows_per_class").alias("check"), (F.col("min_n") >= 2).alias("ok"),
                         F.concat(F.lit("min="), F.col("min_n").cast("string")).alias("detail")),
            )
        ).alias("c")
    ).select("c.*")
