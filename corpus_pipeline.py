"""Corpus pipeline: documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage
before it kept; its decisions take effect on the rows.  All but the last return
the columns of ``documents``.  Rows are told apart by a number written down with
them, so repeated and null ids do no harm.

Stages: quality rules (rejected documents go), exact dedup (of equal texts the
largest doc_id stays), n-gram Jaccard join (of each group of linked documents one
stays), personal data (replaced by surrogates; ``n_chars`` follows the text),
best-fit packing (rows are pieces).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revtriage.llm.common import by_number, free_name, materialise, scratch_tables, table
from revtriage.llm.exact_dedup import exact_dedup
from revtriage.llm.ngram_join import jaccard_components
from revtriage.llm.packing import best_fit_packing
from revtriage.llm.pii import replace_pii
from revtriage.llm.quality import judge_quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The verdict follows from a row's votes and the fitted rules, so whole rows go through, without a join."""
    row = free_name("_row", docs)
    return judge_quality(docs.select(F.struct(*docs.columns).alias(row), "text"), id_col=row).where("kept").select(f"{row}.*")


def _kept_by(docs: DataFrame, decide) -> DataFrame:
    """The rows that ``decide(numbered rows, number column)`` keeps; it gives each number and whether it is kept.

    Rows are numbered in a written copy; what the decision wrote besides its
    numbers is removed before texts are read again.  They are told by a bitmap of
    the fewer numbers, kept or dropped; only where that would be too large to
    send are texts moved."""
    row = free_name("_row", docs)
    with scratch_tables(docs.sparkSession) as drop_but:
        rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered", compression="zstd")
        decided = materialise(decide(rows, row), "decided")
        drop_but(rows, decided)
    kept, dropped = decided.where("kept").select(row), decided.where("NOT kept").select(row)
    most_go = kept.count() < dropped.count()
    return by_number(rows, row, kept if most_go else dropped, among=most_go).select(*docs.columns)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept_by(docs, lambda rows, row: exact_dedup(rows, carry=row).select(row, "kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept_by(docs, lambda rows, row: jaccard_components(rows, id_col=row).select(row, (F.col(row) == F.col("component_id")).alias("kept")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    count = free_name("n_entities", docs)
    out = replace_pii(docs)
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(dict(docs.dtypes)["n_chars"])
        out = out.withColumn("n_chars", F.when(F.col(count) > 0, length).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote on its way is removed once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch_tables(spark) as drop_but:
            done = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            drop_but(done)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL has no tokenizer and no surrogates; the pipeline is tested against a brute-force version.
ORACLE_SQL = None
