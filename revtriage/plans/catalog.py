"""Registered queries: each operator of the inventory run over the driver's
tables (whole tables, whole texts), returning a DataFrame.

Surrogates (see README): review = ``documents`` row (review_id = doc_id,
app = source, rating = 1 + doc_id % 5); class label = ``labels``
(quality, toxic) mapped to four class names; label with text signal =
``documents.lang``; rule vocabulary = the test vocabulary in
``sources.tables``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..session import cut_lineage, scratch_path, written
from ..sinks.versions import base_table, write_version
from ..sources.files import app_targets
from ..functions import text as T
from ..operators import aggregate as A
from ..operators import ingest as ING
from ..operators import labeling as LAB
from ..operators import merge as MRG
from ..operators import report as RPT
from ..operators.quality import keep_first, validation_table
from ..operators.rank import global_row_number
from ..operators.sampling import checked_split, split_quotas, stratified_folds
from ..sources import tables as S
from .dataset import load_labelled_dataset

SEED = config.RANDOM_SEED
SPLIT_TEST_FRACTION = 0.2
CANDIDATE_TOP = config.CANDIDATE_TOP
NEWEST_PER_USER = 5
FOLDS = 3


# --------------------------------------------------------------------- text


def q_p1_trim_cut(spark, d):
    docs = S.table(spark, d, "documents")
    return docs.select("doc_id", T.trim_cut("text").alias("text"))


def q_x1_model_clean(spark, d):
    docs = S.table(spark, d, "documents")
    return docs.select("doc_id", T.model_clean("text").alias("clean_text"))


def q_x2_rule_clean(spark, d):
    docs = S.table(spark, d, "documents")
    norm = T.rule_clean("text")
    return docs.select("doc_id", norm.alias("norm_text"), F.size(T.token_set(norm)).cast("long").alias("n_tokens"))


def q_x7_weak_label(spark, d):
    rev = S.reviews(spark, d).select("review_id", "text")
    return LAB.relabel(rev, S.TEST_RULES).select("review_id", "suggested_label", "rule_score", "review_status")


def q_x7_status_counts(spark, d):
    """Flagship: weak-label status and label counts over all reviews."""
    r = LAB.relabel(S.reviews(spark, d).select("review_id", "text"), S.TEST_RULES)
    return r.groupBy("review_status", "suggested_label").agg(F.count(F.lit(1)).alias("n"))


def q_x7_default_rules(spark, d):
    """X7 with the whole default vocabulary, which has several times the entries of the test one."""
    rev = S.reviews(spark, d).select("review_id", "text")
    return LAB.relabel(rev, config.DEFAULT_RULESET).select("review_id", "suggested_label", "rule_score", "review_status")


def q_k8_relabel_report(spark, d):
    r = LAB.relabel(S.reviews(spark, d).select("review_id", "text"), S.TEST_RULES)
    return LAB.relabel_report(r)


def q_p8_display_name(spark, d):
    r = LAB.relabel(S.reviews(spark, d).select("review_id", "text"), S.TEST_RULES)
    return r.select("review_id", T.display_name("suggested_label", S.TEST_RULE_LABELS.display).alias("display_label"))


def q_x3_label_normalise(spark, d):
    docs = S.labelled_documents(spark, d)
    lab = T.normalize_label("category", S.CLASS_LABELS.synonyms)
    return docs.groupBy(lab.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def q_x10_candidates(spark, d):
    rev = S.reviews(spark, d).select("review_id", "text", "rating")
    c = LAB.security_candidates(rev, S.TEST_CANDIDATE_VOCAB, id_col="review_id")
    return c


def q_i5_top_candidates(spark, d):
    rev = S.reviews(spark, d).select("review_id", "text", "rating")
    return LAB.security_candidates(rev, S.TEST_CANDIDATE_VOCAB, top=CANDIDATE_TOP, id_col="review_id")


def q_x11_app_id(spark, d):
    pages = S.table(spark, d, "pages").select("page_id", "url")
    app = T.app_id_from_reference("url", host_marker="example", key="ref")
    x = pages.select("page_id", app.alias("app_id"))
    return x.withColumn("is_valid", T.app_id_is_valid("app_id"))


def q_p10_row_caption(spark, d):
    docs = S.table(spark, d, "documents").select("doc_id", "text", "lang")
    numbered = global_row_number(docs, ["doc_id"], "row")
    disp = T.display_name("lang", S.LANG_LABELS.display)
    return numbered.select("doc_id", T.row_caption("row", disp, "text").alias("caption"))


# ----------------------------------------------------------- dataset / split


def class_master(spark, d) -> DataFrame:
    """Labelled master rows (review_id = doc_id, text, raw label trimmed);
    the dataset loader maps the raw label later, as in the reference flow."""
    docs = S.labelled_documents(spark, d)
    x = docs.select(
        F.col("doc_id").alias("review_id"),
        T.unicode_trim("text").alias("text"),
        T.unicode_trim("category").alias("label"),
    )
    return x.where(F.col("label").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))


def class_split(spark, d) -> DataFrame:
    return checked_split(class_master(spark, d), SPLIT_TEST_FRACTION, "label", ["review_id"], SEED)


def training_dataset(spark, d, balance: bool):
    split = written(class_split(spark, d), "split")
    test = split.where(F.col("dataset_role") == "testing_manual")
    train = split.where(F.col("dataset_role") == "training")
    held_out = load_labelled_dataset(test, S.CLASS_LABELS, apply_balancing=False)
    return load_labelled_dataset(train, S.CLASS_LABELS, apply_balancing=balance, exclude_clean=held_out.data)


def q_s4_load_dataset(spark, d):
    docs = S.labelled_documents(spark, d).select("doc_id", "text", "category")
    return load_labelled_dataset(docs, S.CLASS_LABELS, apply_balancing=False).data


def q_p9_dataset_preview(spark, d):
    docs = S.labelled_documents(spark, d).select("doc_id", "text", "category")
    return RPT.dataset_preview(load_labelled_dataset(docs, S.CLASS_LABELS, apply_balancing=False).data, S.CLASS_LABELS.display)


def q_m19_mode_figures(spark, d):
    docs = S.labelled_documents(spark, d).select("doc_id", "text", "category")
    before = load_labelled_dataset(docs, S.CLASS_LABELS, apply_balancing=False).data
    after = load_labelled_dataset(docs, S.CLASS_LABELS, apply_balancing=True).data
    return RPT.mode_figures(before, after, saved_balanced=False, balanced=True)


def q_a4_funnel(spark, d):
    docs = S.labelled_documents(spark, d).select("doc_id", "text", "category")
    s = load_labelled_dataset(docs, S.CLASS_LABELS, apply_balancing=True).summary_df
    return A.summary_as_text(s, S.CLASS_LABELS.names)


def q_v_validation(spark, d):
    docs = S.labelled_documents(spark, d).select("doc_id", "text", "category")
    data = load_labelled_dataset(docs, S.CLASS_LABELS, apply_balancing=False, validate=False).data
    counts = data.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return validation_table(counts, S.CLASS_LABELS.names)


def q_a2_label_counts(spark, d):
    docs = S.labelled_documents(spark, d).select("doc_id", "text", "category")
    data = load_labelled_dataset(docs, S.CLASS_LABELS, apply_balancing=False).data
    return A.label_counts_fixed(data, S.CLASS_LABELS.names)


def q_a3_class_balance(spark, d):
    docs = S.labelled_documents(spark, d).select("doc_id", "text", "category")
    data = load_labelled_dataset(docs, S.CLASS_LABELS, apply_balancing=False).data
    return A.class_balance(data)


def q_i1_review_id(spark, d):
    m = class_master(spark, d)
    n = global_row_number(m, ["review_id"], "_n")
    rid = F.format_string(config.REVIEW_ID_PREFIX + "%05d", F.col("_n"))
    return n.select(rid.alias("review_id"), F.col("review_id").alias("doc_id"), "label")


def q_i9_stratified_split(spark, d):
    return class_split(spark, d).select("review_id", "label", "dataset_role")


def q_i9_quotas(spark, d):
    m = class_master(spark, d)
    counts = m.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return split_quotas(counts, SPLIT_TEST_FRACTION, "label")


def q_a7_split_summary(spark, d):
    return A.split_summary(class_split(spark, d))


def q_j1_decontaminate(spark, d):
    return training_dataset(spark, d, balance=False).data


def q_j1_overlap_summary(spark, d):
    s = training_dataset(spark, d, balance=False).summary_df
    return s.select("final_rows", "overlap_rows_removed", "rows_after_dedup")


def q_i8_balance(spark, d):
    return training_dataset(spark, d, balance=True).data


def q_i10_folds(spark, d):
    data = training_dataset(spark, d, balance=False).data
    return stratified_folds(data, FOLDS, "label", ["text"], SEED).select("label", "text", "fold")


def q_d2_keep_first(spark, d):
    """First document (by id) of every (app, text) pair."""
    rev = S.reviews(spark, d).select("review_id", "app_id", "text")
    return keep_first(rev, ["app_id", "text"], ["review_id"]).select("review_id", "app_id")


def q_a1_count_by_app(spark, d):
    return A.count_by(S.reviews(spark, d), "app_id")


# ------------------------------------------------------------ merge / ingest


def relabelled_candidates(spark, d) -> DataFrame:
    rev = S.reviews(spark, d).select("review_id", "text")
    kept = LAB.relabelled_rows(LAB.relabel(rev, S.TEST_RULES))
    # Relabelled rows use the rule labels; merge into a rule-labelled base.
    return MRG.candidate_rows(kept, S.TEST_RULES.labels, ["review_id"])


def rule_base(spark, d) -> DataFrame:
    """Base training table: the weak labels of the training side of the
    split (its rows keep their own ids)."""
    split = class_split(spark, d).where(F.col("dataset_role") == "training").select("review_id", "text")
    r = LAB.relabelled_rows(LAB.relabel(split, S.TEST_RULES))
    return r.select("review_id", "text", "label", "label_method")


def merge_sides(spark, d) -> tuple[DataFrame, DataFrame]:
    """Base and candidates, each written once."""
    return cut_lineage(rule_base(spark, d)), cut_lineage(relabelled_candidates(spark, d))


def q_j2_new_pairs(spark, d):
    base, candidates = merge_sides(spark, d)
    return MRG.new_pairs(base, candidates).select("review_id", "label")


def q_d4_merge(spark, d):
    base, candidates = merge_sides(spark, d)
    new = cut_lineage(MRG.new_pairs(base, candidates))
    return MRG.merge_into(base, new, "review_id", "review_id").select("review_id", "label", "label_method")


def q_d4_merge_nothing_new(spark, d):
    """The base merged with its own rows: nothing is new, the base stays as it is, repeated pairs included."""
    base = cut_lineage(rule_base(spark, d))
    merged = MRG.merge_into(base, MRG.new_pairs(base, base), "review_id", "review_id")
    return merged.select("review_id", "label", "label_method")


def q_k4_versioned_merge(spark, d):
    """The base written as version 1 of a table, the candidates merged into it as version 2; both read back."""
    base, candidates = merge_sides(spark, d)
    path = scratch_path(spark, "training-table")
    write_version(base, path)
    MRG.merge_table(spark, path, candidates)
    parts = [base_table(spark, path, n)[0].select(F.lit(n).alias("version"), "review_id", "label", "label_method") for n in (1, 2)]
    return parts[0].unionByName(parts[1])


def q_k2_routes(spark, d):
    """The weak labels written as two folders and read back."""
    path = scratch_path(spark, "routes")
    LAB.write_routes(LAB.relabel(S.reviews(spark, d).select("review_id", "text"), S.TEST_RULES), path)
    return spark.read.parquet(path).select("review_id", "route", "label", "label_method", "review_status")


def q_k8_term_report(spark, d):
    rev = S.reviews(spark, d).select("review_id", "text", "rating")
    return LAB.term_report(LAB.security_candidates(rev, S.TEST_CANDIDATE_VOCAB, id_col="review_id"))


def q_s9_stack_inputs(spark, d):
    """``documents`` landed as CSV files with two orders of headings, stacked by name."""
    from ..sources.files import read_csv_any_encoding
    from ..sinks.writers import write_csv
    from ..session import scratch_path

    docs = S.table(spark, d, "documents").select("doc_id", "text", "lang")
    base = scratch_path(spark, "s9")
    write_csv(docs.where("doc_id % 2 = 0"), f"{base}/a")
    write_csv(docs.where("doc_id % 2 = 1").select("lang", "text", "doc_id"), f"{base}/b")
    back = read_csv_any_encoding(spark, [f"{base}/a", f"{base}/b"], na_tokens=None)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")


def q_a8_added_by_label(spark, d):
    base, candidates = merge_sides(spark, d)
    return MRG.added_by_label(MRG.new_pairs(base, candidates))


def landed_reviews(spark, d) -> DataFrame:
    """Landed store dump: documents as reviews with a review date taken from
    ``events.ts`` of the same id (the driver tables have no review date)."""
    rev = S.reviews(spark, d)
    ev = S.table(spark, d, "events").select(F.col("event_id").alias("review_id"), F.col("ts").cast("timestamp").alias("review_date"))
    x = rev.join(ev, "review_id", "left")
    return x.select(
        "review_id", "text", "app_id", "rating", "review_date",
        (F.col("review_id") % 7).cast("int").alias("thumbs_up_count"), "lang",
    )


def app_dimension(spark, d) -> DataFrame:
    """App targets from ``nation``: app_id = 'src' || nationkey; a later target of each id must not win."""
    n = S.table(spark, d, "nation")
    first = n.select(F.col("n_name").alias("app_name"), F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("app_id"), F.col("n_nationkey").cast("long").alias("place"))
    again = first.select(F.lit(" A later name").alias("app_name"), "app_id", (F.col("place") + 1000).alias("place"))
    return app_targets(spark, df=first.unionByName(again), order_col="place")


def q_s6_raw_reviews(spark, d):
    raw = ING.raw_reviews(landed_reviews(spark, d), app_dimension(spark, d), target_order="place")
    return raw.select("review_id", "app_name", "app_id", "store_source", "rating")


def q_p4_label_ready(spark, d):
    raw = ING.raw_reviews(landed_reviews(spark, d), app_dimension(spark, d), target_order="place")
    return ING.label_ready(raw).drop("text", "review_date")


def q_s7_newest_per_user(spark, d):
    ev = S.table(spark, d, "events").select("event_id", "user_id", "ts")
    return ING.newest_per_app(ev, NEWEST_PER_USER, key="user_id", date_col="ts", id_col="event_id")


def q_s2_csv_roundtrip(spark, d):
    """``documents`` landed as quoted multi-line CSV in two
    encodings (rows whose text is Latin-1 encodable and not English in
    ISO-8859-1, the rest UTF-8), read back with per-file encoding detection."""
    from ..session import scratch_path
    from ..sinks.writers import write_csv
    from ..sources.files import read_csv_any_encoding

    docs = S.table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    latin = (F.decode(F.encode("text", "ISO-8859-1"), "ISO-8859-1") == F.col("text")) & (F.col("lang") != "en")
    base = scratch_path(spark, "s2_csv")
    write_csv(docs.where(latin), base + "/latin1", encoding="ISO-8859-1")
    write_csv(docs.where(~latin), base + "/utf8")
    back = read_csv_any_encoding(spark, [base + "/latin1", base + "/utf8"])
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")


def registry() -> dict:
    return {
        "p1_trim_cut": q_p1_trim_cut,
        "p9_dataset_preview": q_p9_dataset_preview,
        "m19_mode_figures": q_m19_mode_figures,
        "i5_top_candidates": q_i5_top_candidates,
        "d4_merge_nothing_new": q_d4_merge_nothing_new,
        "s9_stack_inputs": q_s9_stack_inputs,
        "x1_model_clean": q_x1_model_clean,
        "x2_rule_clean": q_x2_rule_clean,
        "x7_weak_label": q_x7_weak_label,
        "x7_status_counts": q_x7_status_counts,
        "x7_default_rules": q_x7_default_rules,
        "k8_relabel_report": q_k8_relabel_report,
        "p8_display_name": q_p8_display_name,
        "x3_label_normalise": q_x3_label_normalise,
        "x10_candidates": q_x10_candidates,
        "x11_app_id": q_x11_app_id,
        "p10_row_caption": q_p10_row_caption,
        "s4_load_dataset": q_s4_load_dataset,
        "a4_funnel": q_a4_funnel,
        "v_validation": q_v_validation,
        "a2_label_counts": q_a2_label_counts,
        "a3_class_balance": q_a3_class_balance,
        "i1_review_id": q_i1_review_id,
        "i9_quotas": q_i9_quotas,
        "i9_stratified_split": q_i9_stratified_split,
        "a7_split_summary": q_a7_split_summary,
        "j1_decontaminate": q_j1_decontaminate,
        "j1_overlap_summary": q_j1_overlap_summary,
        "i8_balance": q_i8_balance,
        "i10_folds": q_i10_folds,
        "d2_keep_first": q_d2_keep_first,
        "a1_count_by_app": q_a1_count_by_app,
        "j2_new_pairs": q_j2_new_pairs,
        "d4_merge": q_d4_merge,
        "k4_versioned_merge": q_k4_versioned_merge,
        "k2_routes": q_k2_routes,
        "k8_term_report": q_k8_term_report,
        "a8_added_by_label": q_a8_added_by_label,
        "s6_raw_reviews": q_s6_raw_reviews,
        "p4_label_ready": q_p4_label_ready,
        "s7_newest_per_user": q_s7_newest_per_user,
        "s2_csv_roundtrip": q_s2_csv_roundtrip,
    }
