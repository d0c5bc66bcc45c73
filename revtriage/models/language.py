"""L1: English filter as a Spark job.

The reference asks a per-row detector library.  Here a language profile is
learned from a labelled table: character trigrams of the lower-cased
letters, TF-IDF weighted, multinomial Naive Bayes (``naive_bayes``); a text
is English when the profile's best class is the English label.  Text with no
letters is rejected (the detector's error case).  The profile is a
(class, trigram) table, scored by joins like any other model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TfidfParams
from . import naive_bayes as NB
from .tfidf import letters_only

PROFILE_PARAMS = TfidfParams(analyzer="char", char_n=3, min_df=1, max_df=1.0, sublinear_tf=True, stop_words=())


def fit_profile(labelled: DataFrame, id_col: str = "review_id", text_col: str = "text", label_col: str = "label",
                params: TfidfParams = PROFILE_PARAMS) -> NB.NaiveBayesModel:
    return NB.fit(labelled, id_col, label_col, text_col, params, alpha=0.5, fit_prior=False)


def detect(profile: NB.NaiveBayesModel, df: DataFrame, id_col: str = "review_id", text_col: str = "text",
           english: str = "en") -> DataFrame:
    """Adds ``detected_lang`` (null when the text has no letters) and ``is_english``."""
    scored = profile.predict(df, id_col, text_col)
    has_letters = letters_only(text_col) != ""
    out = scored.withColumn("detected_lang", F.when(has_letters, F.col("prediction")))
    out = out.withColumn("is_english", F.coalesce(F.col("detected_lang") == F.lit(english), F.lit(False)))
    return out.drop("prediction", "confidence", "probability")


def english_filter(profile: NB.NaiveBayesModel, id_col: str = "review_id", text_col: str = "text"):
    """A function DataFrame -> DataFrame with ``is_english`` (for live ingest, S8)."""
    def run(df: DataFrame) -> DataFrame:
        return detect(profile, df, id_col, text_col).drop("detected_lang")

    return run
