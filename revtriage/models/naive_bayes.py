"""Multinomial Naive Bayes on long-form TF-IDF, as DataFrame jobs (M3).

Parameters: feature sums per (class, term), totals per class, class
document counts.  With smoothing alpha and V vocabulary terms,

    log P(t | c) = ln(s_ct + alpha) - ln(S_c + alpha V)

and the joint log likelihood of a document splits into a part that needs
only the document's weight total and a part over the terms the class has
actually seen:

    jll(d, c) = prior_c + (ln alpha - ln(S_c + alpha V)) * sum_t x_dt
                + sum_{t seen in c} x_dt * (ln(s_ct + alpha) - ln alpha)

so a model is one (term, idf, delta per class) table, with 0 where a class has
not seen the term; a document is scored by one join with it and one aggregate.
The per-class constants (one row per class) are folded into literal arrays; the
label is the first class of highest score (classes in sorted order) and the
confidence the highest softmax probability.  The prior is the class frequency,
or uniform.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import NB_ALPHA, TfidfParams
from ..session import written
from . import tfidf as TF


def class_of(scores: Column, classes: list[str]) -> Column:
    """The first class of highest score."""
    return F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position(scores, F.array_max(scores)).cast("int"))


@dataclass
class NaiveBayesModel:
    vectorizer: TF.TfidfModel
    classes: list[str]  # sorted
    prior: list[float]
    base: list[float]  # ln alpha - ln(S_c + alpha V)
    table: DataFrame  # term, idf, coef = [ln(s_ct + alpha) - ln alpha per class]
    alpha: float
    fit_prior: bool

    def predict(self, df: DataFrame, id_col: str, clean_col: str = "clean_text") -> DataFrame:
        """Adds ``prediction`` (class), ``confidence`` (max probability) and
        ``probability`` (array in ``classes`` order) to every row of ``df``."""
        known = TF.linear_scores(df.select(id_col, clean_col), id_col, clean_col, self.vectorizer.params, self.table, len(self.classes))
        out = df.join(known, id_col, "left")
        total = F.coalesce(F.col("_sum"), F.lit(0.0))
        jll = [F.lit(p) + F.lit(b) * total + F.coalesce(F.col("_scores")[k], F.lit(0.0)) for k, (p, b) in enumerate(zip(self.prior, self.base, strict=True))]
        out = out.withColumn("_jll", F.array(*jll))
        out = out.withColumn("_e", F.transform("_jll", lambda v: F.exp(v - F.array_max("_jll"))))
        z = F.aggregate("_e", F.lit(0.0), lambda acc, v: acc + v)
        out = out.withColumn("probability", F.transform("_e", lambda v: v / z))
        out = out.withColumn("prediction", class_of(F.col("_jll"), self.classes)).withColumn("confidence", F.array_max("probability"))
        return out.drop("_sum", "_scores", "_jll", "_e")


def save(model: NaiveBayesModel, path: str) -> None:
    """The fitted model as two tables: terms with idf and class weights, and the parameters."""
    spark = model.table.sparkSession
    model.table.join(model.vectorizer.vocab.select("term", "df"), "term").write.mode("overwrite").parquet(f"{path}/terms")
    row = (
        model.classes, model.prior, model.base, float(model.alpha), model.fit_prior,
        model.vectorizer.n_docs, model.vectorizer.vocab_size, json.dumps(asdict(model.vectorizer.params)),
    )
    schema = "classes array<string>, prior array<double>, base array<double>, alpha double, fit_prior boolean, n_docs long, vocab_size long, vectorizer string"
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/parameters")


def params_of(text: str) -> TfidfParams:
    settings = json.loads(text)
    if settings["stop_words"] is not None:
        settings["stop_words"] = tuple(settings["stop_words"])
    return TfidfParams(**settings)


def load(spark: SparkSession, path: str) -> NaiveBayesModel:
    p = spark.read.parquet(f"{path}/parameters").first()
    terms = spark.read.parquet(f"{path}/terms")
    vectorizer = TF.TfidfModel(terms.select("term", "df", "idf"), p["n_docs"], p["vocab_size"], params_of(p["vectorizer"]))
    return NaiveBayesModel(vectorizer, list(p["classes"]), list(p["prior"]), list(p["base"]), terms.select("term", "idf", "coef"), p["alpha"], p["fit_prior"])


def fit(
    train: DataFrame,
    id_col: str,
    label_col: str = "label",
    clean_col: str = "clean_text",
    params: TfidfParams = TfidfParams(min_df=1, sublinear_tf=True),
    alpha: float = NB_ALPHA,
    fit_prior: bool = True,
    vectorizer: TF.TfidfModel | None = None,
) -> NaiveBayesModel:
    docs = train.select(id_col, F.col(label_col).alias("label"), clean_col)
    rows = {r["label"]: int(r["n"]) for r in docs.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per class
    classes = sorted(rows)
    settings = params if vectorizer is None else vectorizer.params
    lists = TF.ready_lists(docs, id_col, clean_col, settings, keep=["label"])
    vec = vectorizer or TF.fit_counts(TF.each_term(lists.select("_terms")), sum(rows.values()), params)
    # s_ct = idf_t * sum over the documents of c of tf / norm: the norm meets a document, the idf a term's sums.
    norms = TF.document_norms(TF.each_term(lists), vec.vocab, id_col, settings)
    if settings.analyzer == "char":
        x = TF.each_term(TF.join_documents(lists, norms, id_col))
    else:
        x = TF.term_counts(TF.join_documents(docs, norms, id_col), id_col, clean_col, settings, keep=["label", "_norm"])
    share = TF.term_frequency(settings) / F.col("_norm")
    sums = x.groupBy("term").agg(*[F.coalesce(F.sum(F.when(F.col("label") == c, share)), F.lit(0.0)).alias(f"_s{k}") for k, c in enumerate(classes)])
    sums = sums.join(vec.vocab.select("term", "idf"), "term").select("term", "idf", *[(F.col(f"_s{k}") * F.col("idf")).alias(f"_s{k}") for k in range(len(classes))])
    sums = written(sums, "class-sums")
    total = sums.agg(*[F.coalesce(F.sum(f"_s{k}"), F.lit(0.0)) for k in range(len(classes))]).first()
    n_all = sum(rows.values())
    prior = [math.log(rows[c] / n_all) if fit_prior else -math.log(len(classes)) for c in classes]
    base = [math.log(alpha) - math.log(total[k] + alpha * vec.vocab_size) for k in range(len(classes))]
    coef = F.array(*[F.log(F.col(f"_s{k}") + F.lit(alpha)) - F.lit(math.log(alpha)) for k in range(len(classes))])
    return NaiveBayesModel(vec, classes, prior, base, sums.select("term", "idf", coef.alias("coef")), alpha, fit_prior)
