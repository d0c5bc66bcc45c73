"""Dedup, decontamination, merge, funnel, metrics (FIXTURES.md §3)."""

import datetime

from pyspark.sql import functions as F

from revtriage.config import Labels
from revtriage.operators.ingest import live_reviews, raw_reviews
from revtriage.operators.merge import merge_into, new_pairs
from revtriage.operators.metrics import confusion_matrix, per_class_report, summary_metrics
from revtriage.operators.quality import keep_first
from revtriage.plans.dataset import load_labelled_dataset
from revtriage.plans.scoring import triage
from revtriage.sources.files import read_csv_any_encoding, read_files_with_lineage
from revtriage.operators.aggregate import class_balance, triage_summary


def test_keep_first_null_keys_equal(spark):
    rows = [(0, "1", "a", "v1"), (1, "1", "a", "v2"), (2, None, "b", "w1"), (3, None, "b", "w2")]
    df = spark.createDataFrame(rows, "o int, id string, text string, v string")
    got = sorted(r.v for r in keep_first(df, ["id", "text"], ["o"]).collect())
    assert got == ["v1", "w1"]


def test_decontamination_removes_clean_text_overlap(spark):
    labels = Labels(names=("a",), display={}, synonyms={"a": "a"})
    train = spark.createDataFrame([("a", t) for t in ["Pay!", "pay", "top up"] + [f"row {i}" for i in range(20)]], "label string, text string")
    test = spark.createDataFrame([("a", "PAY", "pay")], "label string, text string, clean_text string")
    out = load_labelled_dataset(train, labels, apply_balancing=False, exclude_clean=test)
    assert out.summary["overlap_rows_removed"] == 2
    assert "top up" in [r.text for r in out.data.collect()]


def test_merge_base_wins_and_duplicates_collapse(spark):
    base = spark.createDataFrame([(1, "x", "l"), (2, "x", "l")], "review_id int, text string, label string")
    cand = spark.createDataFrame([(9, "y", "l"), (8, "x", "l")], "review_id int, text string, label string")
    new = new_pairs(base, cand)
    assert [r.text for r in new.collect()] == ["y"]
    merged = merge_into(base, new, "review_id", "review_id")
    assert sorted((r.review_id, r.text) for r in merged.collect()) == [(1, "x"), (9, "y")]


def test_funnel_and_ratio(spark):
    labels = Labels(names=("p", "q"), display={}, synonyms={"p": "p", "q": "q"})
    rows = [("p", f"text {i}") for i in range(30)] + [("q", f"other {i}") for i in range(4)]
    rows += [("p", "text 1"), (None, "x"), ("zzz", "y"), ("q", "   "), ("q", "!!!")]
    df = spark.createDataFrame(rows, "label string, text string")
    s = load_labelled_dataset(df, labels, apply_balancing=True).summary
    assert (s["original_rows"], s["rows_after_null_drop"], s["rows_after_label_clean"], s["rows_after_text_clean"]) == (39, 38, 37, 36)
    assert s["rows_after_dedup"] == 35 and s["final_rows"] == 34 and s["duplicates_removed"] == 1
    assert s["balanced_rows"] == 8 and s["imbalance_ratio"] == 7.5
    cb = class_balance(spark.createDataFrame([("a",)] * 1478 + [("b",)] * 187, "label string")).first()
    assert cb.imbalance_ratio == 7.9


def test_macro_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "c"), ("b", "b")], "label string, prediction string")
    m = summary_metrics(df).first()
    assert abs(m.accuracy - 2 / 3) < 1e-9 and abs(m.precision - 2 / 3) < 1e-9
    assert abs(m.recall - 0.5) < 1e-9 and abs(m.f1 - 5 / 9) < 1e-9


def test_confusion_and_report_zero_filled(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a")], "label string, prediction string")
    cm = {r.actual: (r.p_a, r.p_b, r.p_c) for r in confusion_matrix(df, ["a", "b", "c"]).collect()}
    assert cm == {"a": (1, 0, 0), "b": (1, 0, 0), "c": (0, 0, 0)}
    rep = {r.category: r.support for r in per_class_report(df, ["a", "b", "c"], {}).collect()}
    assert rep == {"A": 1, "B": 1, "C": 0}


def test_triage_scores_only_complaints(spark):
    reviews = spark.createDataFrame([(1, 1, "payment failed"), (2, 3, "okay app"), (3, 5, "great app"), (4, None, "x")],
                                    "review_id int, rating int, text string")
    seen = []

    def stub(df):
        seen.append(df)
        return df.withColumn("prediction", F.lit("payment_failure")).withColumn("confidence", F.lit(0.9))

    out = {r.review_id: r for r in triage(reviews, stub).collect()}
    assert [out[i].predicted_issue for i in (1, 2, 3, 4)] == ["Payment Failure", "Payment Failure", "", ""]
    assert out[1].action == "Classified for follow-up" and out[3].action == "Left unchanged"
    assert out[3].confidence is None and out[1].confidence == 0.9
    assert seen[0].count() == 2
    s = triage_summary(triage(reviews, stub)).first()
    assert (s.total, s.needs_review, s.positive) == (4, 2, 2)


def test_sinks_roundtrip(spark, tmp_path):
    from revtriage.sinks.writers import split_summary_markdown, write_csv, write_split
    from revtriage.sources.files import read_csv

    df = spark.createDataFrame([(1, 'a "quoted"\nline', "x"), (2, "b", "y")], "review_id int, text string, label string")
    write_csv(df, str(tmp_path / "csv"))
    back = read_csv(spark, str(tmp_path / "csv"))
    assert sorted(r.text for r in back.collect()) == ['a "quoted"\nline', "b"]
    split = df.withColumn("dataset_role", F.when(F.col("review_id") == 1, "training").otherwise("testing_manual"))
    write_split(split, str(tmp_path / "split"))
    assert spark.read.parquet(str(tmp_path / "split")).count() == 2
    md = split_summary_markdown(split, "master.csv")
    assert "2 rows" in md and "| `y` | 0 | 1 |" in md and "| all | 1 | 1 |" in md


def test_merge_without_new_rows_keeps_the_base(spark):
    base = spark.createDataFrame([(1, "x", "l"), (2, "x", "l")], "review_id int, text string, label string")
    new = new_pairs(base, base)
    assert merge_into(base, new, "review_id", "review_id").count() == 2


def test_merge_fills_missing_columns_by_type(spark):
    base = spark.createDataFrame([(1, "x", "l", 5, "m")], "review_id int, text string, label string, votes int, method string")
    new = spark.createDataFrame([(9, "y", "l")], "review_id int, text string, label string")
    added = merge_into(base, new, "review_id", "review_id").where("review_id = 9").first()
    assert added.votes is None and added.method == ""


def test_live_reviews_prefer_the_dated_copy(spark):
    rows = [(1, None, 2, "t", 0, "a"), (1, datetime.datetime(2024, 1, 1), 3, "t", 0, "a")]
    df = spark.createDataFrame(rows, "review_id int, review_date timestamp, rating int, text string, thumbs_up_count int, app_id string")
    out = live_reviews(df, "a", 10, F.lit(True)).collect()
    assert [r.rating for r in out] == [3]


def test_first_target_names_the_app(spark):
    landed = spark.createDataFrame([(1, "t", "a", 2, None)], "review_id int, text string, app_id string, rating int, review_date timestamp")
    targets = spark.createDataFrame([("Zed", "a", 0), ("Abe", "a", 1)], "app_name string, app_id string, ord int")
    assert raw_reviews(landed, targets, target_order="ord").first().app_name == "Zed"


def test_csv_files_with_other_heading_orders(spark, tmp_path):
    (tmp_path / "a.csv").write_text("text,label\nno money,payment\n")
    (tmp_path / "b.csv").write_bytes("label,text\ntransfer,caf\u00e9\n".encode("latin-1"))
    out = read_csv_any_encoding(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert sorted((r.text, r.label) for r in out.collect()) == [("caf\u00e9", "transfer"), ("no money", "payment")]
    lined = read_files_with_lineage(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], "csv").collect()
    assert sorted((r.label, r.merge_source_file) for r in lined) == [("payment", "a.csv"), ("transfer", "b.csv")]


def test_whole_texts_are_loaded(spark):
    labels = Labels(names=("a",), display={}, synonyms={"a": "a"})
    long = "word " * 900
    rows = [("a", long + "one"), ("a", long + "two")] + [("a", f"row {i}") for i in range(30)]
    out = load_labelled_dataset(spark.createDataFrame(rows, "label string, text string"), labels, apply_balancing=False)
    assert out.summary["final_rows"] == 32


def test_keep_first_against_plain_python(spark):
    import random

    rng = random.Random(3)
    rows = [(i, rng.choice([None, "", "a", "b", "1:a"]), rng.choice([None, "x", "a", ""]), rng.choice([None, *range(4)]), f"v{i}") for i in range(300)]
    rows += [(0, "a", "x", None, "v0"), rows[5]]
    df = spark.createDataFrame(rows, "o int, k1 string, k2 string, rank int, v string").repartition(5)
    best = {}
    for o, a, b, rank, v in rows:
        best[a, b] = min(best.get((a, b), (o, v)), (o, v))
    got = {(r.k1, r.k2): (r.o, r.v) for r in keep_first(df, ["k1", "k2"], ["o"]).collect()}
    assert got == best and keep_first(df, ["k1", "k2"], ["o"]).count() == len(best)
    best = {}
    for o, a, b, rank, v in rows:
        if rank is not None:
            best[a, b] = min(best.get((a, b), (rank, o)), (rank, o))
    got = {(r.k1, r.k2): (r.rank, r.o) for r in keep_first(df.where("rank IS NOT NULL"), ["k1", "k2"], ["rank", "o"]).collect()}
    assert got == best


def test_first_row_dedup_sorts_no_text(spark):
    df = spark.createDataFrame([(1, "x", "l")], "review_id long, text string, label string")
    plan = keep_first(df, ["text", "label"], ["review_id"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "hashpartitioning(text" not in plan


def test_versions_are_numbered_commits(spark, tmp_path):
    """The largest number counts, whatever the files' times; an unfinished entry is no version; a late writer is told."""
    import os

    import pytest

    from revtriage.sinks.versions import VersionConflict, base_table, versions, write_version

    path = str(tmp_path / "tbl")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "review_id long, text string")
    with pytest.raises(FileNotFoundError):
        base_table(spark, path)
    for n in range(5):
        assert write_version(df.where(f"review_id > {n % 2}"), path, after=n) == n + 1
    for folder, _, names in os.walk(path):
        for name in names:
            os.utime(os.path.join(folder, name), (1, 1))
    os.utime(f"{path}/_log/{1:020d}")  # the oldest version has the newest time
    table, number = base_table(spark, path)
    assert number == 5 and table.count() == 2 and base_table(spark, path, 2)[0].count() == 1
    with pytest.raises(VersionConflict):
        write_version(df, path, after=4)
    open(f"{path}/_log/{6:020d}", "w").close()
    assert max(versions(spark, path)) == 5
    with pytest.raises(FileNotFoundError):
        base_table(spark, path, 6)


def test_merge_into_a_versioned_table(spark, tmp_path):
    from revtriage.operators.merge import merge_table
    from revtriage.sinks.versions import base_table, write_version

    path = str(tmp_path / "tbl")
    write_version(spark.createDataFrame([(1, "x", "l"), (2, "x", "l")], "review_id long, text string, label string"), path)
    merged, new = merge_table(spark, path, spark.createDataFrame([(9, "y", "l"), (8, " x ", "l")], "review_id long, text string, label string"))
    assert sorted(r.review_id for r in merged.collect()) == [1, 8, 9] or sorted(r.review_id for r in merged.collect()) == [1, 9]
    assert base_table(spark, path)[1] == 2 and new.count() in (1, 2)


def test_empty_sources_are_errors(spark, tmp_path):
    import pytest

    from revtriage.operators.ingest import collect_live
    from revtriage.operators.sampling import checked_split
    from revtriage.sources.files import app_targets, read_uploaded_file

    landed = spark.createDataFrame([(1, None, 2, "bonjour", 0, "a")], "review_id int, review_date timestamp, rating int, text string, thumbs_up_count int, app_id string")
    with pytest.raises(ValueError, match="reviews of b: no rows"):
        collect_live(landed, "b", 5, F.lit(True))
    with pytest.raises(ValueError, match="usable English"):
        collect_live(landed, "a", 5, F.lit(False))
    assert collect_live(landed, "a", 5, F.lit(True)).count() == 1
    with pytest.raises(ValueError, match="lack app_id"):
        app_targets(spark, df=spark.createDataFrame([("x",)], "app_name string"))
    with pytest.raises(ValueError, match="no row has both"):
        app_targets(spark, df=spark.createDataFrame([("x", " "), (None, "y")], "app_name string, app_id string"))
    assert app_targets(spark).count() == 4
    (tmp_path / "empty.csv").write_text("text\n")
    (tmp_path / "marks.csv").write_text("text\n!!!\n")
    with pytest.raises(ValueError, match="holds no rows"):
        read_uploaded_file(spark, str(tmp_path / "empty.csv"))
    with pytest.raises(ValueError, match="no review text"):
        read_uploaded_file(spark, str(tmp_path / "marks.csv"))
    one = spark.createDataFrame([(1, "a")], "review_id int, label string")
    with pytest.raises(ValueError, match="too few"):
        checked_split(one, 0.9, "label", ["review_id"])


def test_training_modes_have_names():
    import pytest

    from revtriage.functions.text import balance_mode, is_balanced

    assert is_balanced(balance_mode(True)) and not is_balanced(balance_mode(False))
    with pytest.raises(ValueError):
        is_balanced("half")


def test_language_filter_on_the_reference_s_case(spark):
    from revtriage.models import language as LANG

    english = ["The payment has failed and the money is gone", "I have been waiting for two days", "Please add the option to transfer", "The app is slow but the support was good"]
    malay = ["Pembayaran saya gagal dan wang saya hilang", "Saya masih menunggu sudah dua hari", "Tolong tambah pilihan pemindahan", "Aplikasi ini masih perlahan tetapi bagus"]
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(t, "en") for t in english] + [(t, "ms") for t in malay])]
    profile = LANG.fit_profile(spark.createDataFrame(rows, "review_id long, text string, label string"))
    asked = spark.createDataFrame([(1, "The transfer has been pending for two days."), (2, "Pemindahan saya masih tertangguh."), (3, "123 !")], "review_id long, text string")
    got = {r.review_id: r.is_english for r in LANG.english_filter(profile)(asked).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_marked_keys_are_joined_by_digest(spark):
    """No text is a join key; a null key occurs nowhere, in either table."""
    from revtriage.operators.quality import mark_keys

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, ""), (5, "a")], "id long, clean_text string")
    out = mark_keys(df, spark.createDataFrame([("a",), ("a",), (None,), ("",)], "clean_text string"), ["clean_text"])
    assert {r["id"]: r["_hit"] for r in out.collect()} == {1: True, 2: False, 3: False, 4: True, 5: True}
    keys = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    assert keys and all("clean_text" not in line for line in keys)
