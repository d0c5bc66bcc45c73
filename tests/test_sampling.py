"""Split quotas (published golden), balancing, folds and the bucketed rank."""

from pyspark.sql import Window
from pyspark.sql import functions as F

import pytest

from revtriage.operators.rank import bucket_counts, global_row_number, hash_order, hash_rank, within_quota
from revtriage.operators.sampling import balance_classes, split_quotas, stratified_folds, stratified_split


def test_split_quotas_match_published_split(spark):
    counts = spark.createDataFrame(
        [("account", 1407), ("feature", 1320), ("payment", 1317), ("security", 216), ("transfer", 1707)], "label string, n long"
    )
    got = {r.label: (r.n_train, r.n_test) for r in split_quotas(counts, 800).collect()}
    assert got == {
        "account": (1218, 189), "feature": (1143, 177), "payment": (1141, 176),
        "security": (187, 29), "transfer": (1478, 229),
    }


def skewed(spark, n=3000):
    # One class holds most rows (skew), two small classes.
    return spark.range(n).select(
        F.col("id").alias("review_id"),
        F.when(F.col("id") % 10 < 8, "big").when(F.col("id") % 10 < 9, "mid").otherwise("small").alias("label"),
        F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"),
    )


def test_hash_rank_equals_window(spark):
    df = skewed(spark).withColumn("_h", hash_order(42, "review_id"))
    fast = hash_rank(df, ["label"], "_h", ["review_id"], digits=2).select("review_id", "_rank")
    w = Window.partitionBy("label").orderBy("_h", "review_id")
    slow = df.select("review_id", F.row_number().over(w).alias("_rank"))
    assert fast.exceptAll(slow).count() == 0 and slow.exceptAll(fast).count() == 0


def test_split_is_disjoint_and_stratified(spark):
    s = stratified_split(skewed(spark), 0.2).persist()
    assert s.count() == 3000
    assert s.groupBy("review_id").count().where("count > 1").count() == 0
    test = {r.label: r["count"] for r in s.where("dataset_role = 'testing_manual'").groupBy("label").count().collect()}
    assert sum(test.values()) == 600
    assert test == {"big": 480, "mid": 60, "small": 60}


def test_balance_gives_equal_classes(spark):
    b = balance_classes(skewed(spark), "label", ["text"])
    counts = {r.label: r["count"] for r in b.groupBy("label").count().collect()}
    assert counts == {"big": 300, "mid": 300, "small": 300}


def test_folds_balanced_within_class(spark):
    f = stratified_folds(skewed(spark), 3, "label", ["text"])
    c = f.groupBy("label", "fold").count().collect()
    for r in c:
        assert r["count"] in (100, 800)


def test_global_row_number(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    n = global_row_number(df, ["k"], "rn")
    assert n.where(F.col("rn") != F.col("k") + 1).count() == 0


@pytest.mark.parametrize("quota", [0, 1, 37, 150, 299, 300, 2400, 9999])
def test_cut_by_quota_equals_window(spark, quota):
    """Rows whose order and tiebreak come twice, a null group, and cuts at both ends."""
    df = skewed(spark).withColumn("label", F.when(F.col("review_id") % 50 != 7, F.col("label"))).withColumn("review_id", F.expr("review_id div 2"))
    df = df.withColumn("_h", hash_order(42, "review_id"))
    counts = bucket_counts(df, ["label"], "_h", digits=1)
    quotas = counts.select("label").distinct().withColumn("quota", F.lit(quota))
    found = within_quota(df, ["label"], "_h", ["review_id"], counts, quotas, digits=1)
    w = Window.partitionBy("label").orderBy("_h", "review_id")
    slow = df.where("label IS NOT NULL").withColumn("_in", F.row_number().over(w) <= quota).select("label", "review_id", "_in")
    fast = found.select("label", "review_id", "_in")
    assert fast.exceptAll(slow).count() == 0 and slow.exceptAll(fast).count() == 0


def test_split_and_balance_move_one_bucket_of_a_class(spark):
    """No text goes through a shuffle but those of the bucket that a quota cuts."""
    for out in (stratified_split(skewed(spark), 0.2), balance_classes(skewed(spark), "label", ["text"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert len(moved) == 1 and "Union" in plan
