"""Class balancing, stratified hold-out split and stratified folds.

Draws are by a seeded md5 order of a row key, so they are repeatable and can
be re-computed by any SQL engine.  Per-class quotas come from the label count
table (one row per class); rows are then cut with ``within_quota``, folds
dealt by exact rank with ``hash_rank``: neither puts a whole class into one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from .rank import bucket_counts, hash_order, hash_rank, within_quota


def label_counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    return df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))


def balance_classes(
    df: DataFrame, label_col: str = "label", key_cols: list[str] | None = None, seed: int = config.RANDOM_SEED
) -> DataFrame:
    """I8: draw the minority-class size from every class without replacement."""
    key_cols = key_cols or ["text"]
    x = df.withColumn("_h", hash_order(seed, *key_cols))
    buckets = bucket_counts(x, [label_col], "_h")
    counts = buckets.groupBy(label_col).agg(F.sum("_n").alias("n"))
    # One row per class: the minimum over the class table is a tiny window.
    quota = counts.select(label_col, F.min("n").over(Window.partitionBy(F.lit(1))).alias("quota"))
    return within_quota(x, [label_col], "_h", key_cols, buckets, quota).where("_in").drop("_h", "_in")


def allocate(counts: DataFrame, n_draws_col: str, label_col: str = "label", out: str = "alloc") -> DataFrame:
    """Largest-remainder allocation of ``n_draws`` over classes in proportion
    to ``n``; ties of the remainder go to the earlier label.  ``counts`` holds
    one row per class plus the total ``n_draws`` (the same on every row)."""
    tot = Window.partitionBy(F.lit(1))
    x = counts.withColumn("_N", F.sum("n").over(tot))
    # Exact integer arithmetic: floor and remainder of n * n_draws / N.
    x = x.withColumn("_prod", F.col("n").cast("long") * F.col(n_draws_col).cast("long"))
    x = x.withColumn("_floor", F.expr("_prod div _N")).withColumn("_rem", F.expr("_prod % _N"))
    x = x.withColumn("_need", F.col(n_draws_col) - F.sum("_floor").over(tot))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("_rem"), F.col(label_col))
    x = x.withColumn("_r", F.row_number().over(order))
    x = x.withColumn(out, F.col("_floor") + F.when(F.col("_r") <= F.col("_need"), 1).otherwise(0))
    return x.drop("_N", "_prod", "_floor", "_rem", "_need", "_r")


def split_quotas(counts: DataFrame, test_size: float | int, label_col: str = "label") -> DataFrame:
    """Per-class (n_train, n_test) of a stratified split.

    ``test_size``: int = rows, float = fraction (rounded up).  The training
    allocation is drawn first and the test allocation from what is left,
    as the shuffle-split rule does.  The class table has one row per label.
    """
    tot = Window.partitionBy(F.lit(1))
    x = counts.withColumn("_N", F.sum("n").over(tot))
    if isinstance(test_size, float):
        n_test = F.ceil(F.col("_N") * F.lit(test_size)).cast("long")
    else:
        n_test = F.lit(int(test_size)).cast("long")
    x = x.withColumn("_n_test", n_test).withColumn("_n_train", F.col("_N") - F.col("_n_test"))
    x = allocate(x, "_n_train", label_col, "n_train")
    x = x.withColumn("_left", F.col("n") - F.col("n_train")).withColumn("_n_tot", F.col("_n_test"))
    left = x.select(label_col, F.col("_left").alias("n"), "_n_tot", "n_train")
    left = allocate(left, "_n_tot", label_col, "n_test")
    return left.select(label_col, "n_train", "n_test")


def stratified_split(
    df: DataFrame,
    test_size: float | int = config.TEST_ROWS,
    label_col: str = "label",
    key_cols: list[str] | None = None,
    seed: int = config.RANDOM_SEED,
    train_role: str = "training",
    test_role: str = "testing_manual",
) -> DataFrame:
    """Stratified, disjoint train/test assignment as a ``dataset_role`` column.

    Within each class, rows in seeded hash order go to training up to the
    class's training quota, the rest to testing.
    """
    key_cols = key_cols or ["review_id"]
    x = df.withColumn("_h", hash_order(seed, *key_cols))
    buckets = bucket_counts(x, [label_col], "_h")
    quota = split_quotas(buckets.groupBy(label_col).agg(F.sum("_n").alias("n")), test_size, label_col)  # one row per class
    x = within_quota(x, [label_col], "_h", key_cols, buckets, quota, "n_train")
    return x.withColumn("dataset_role", F.when(F.col("_in"), F.lit(train_role)).otherwise(F.lit(test_role))).drop("_h", "_in")


def validate_split_size(n_rows: int, test_rows: int) -> None:
    """V4: more rows than the requested test size."""
    if n_rows <= test_rows:
        raise ValueError(f"{n_rows} rows are too few for {test_rows} test rows")


def checked_split(df: DataFrame, test_fraction: float, label_col: str, key_cols: list[str], seed: int = config.RANDOM_SEED) -> DataFrame:
    """The split, refused where it would leave no training rows."""
    n = df.count()
    validate_split_size(n, ceil_fraction(n, test_fraction))
    return stratified_split(df, test_fraction, label_col, key_cols, seed)


def stratified_folds(
    df: DataFrame,
    k: int,
    label_col: str = "label",
    key_cols: list[str] | None = None,
    seed: int = config.RANDOM_SEED,
    fold_col: str = "fold",
) -> DataFrame:
    """Fold id 0..k-1, dealt round-robin in seeded hash order per class."""
    key_cols = key_cols or ["text"]
    x = df.withColumn("_h", hash_order(seed, *key_cols))
    x = hash_rank(x, [label_col], "_h", key_cols)
    return x.withColumn(fold_col, F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_h", "_rank")


def fold_count(min_class_count: int, cap: int) -> int:
    """k = min(cap, smallest class); < 2 means no cross-validation."""
    return min(cap, int(min_class_count))


def ceil_fraction(n: int, fraction: float) -> int:
    return int(math.ceil(n * fraction))
