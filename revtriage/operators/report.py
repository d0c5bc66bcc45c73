"""Table parts of the reports: row filters, previews, percentages, dataset figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import display_name, percent


def category_rows(rows: DataFrame, category: str | None = None, col: str = "actual_label") -> DataFrame:
    """the rows of one displayed category, or all; rows keep the numbers they had before."""
    return rows if category is None else rows.where(F.col(col) == category)


def incorrect_rows(rows: DataFrame, col: str = "correct") -> DataFrame:
    """rows whose prediction is wrong."""
    return rows.where(~F.col(col))


def dataset_preview(data: DataFrame, display: dict, label_col: str = "label", text_col: str = "text") -> DataFrame:
    """Displayed label and text of a loaded dataset."""
    return data.select(display_name(label_col, display).alias("label"), F.col(text_col).alias("text"))


def metric_percents(metrics: DataFrame, cols: tuple[str, ...] = ("accuracy", "precision", "recall", "f1")) -> DataFrame:
    """The metric columns as percent text, other columns as they are."""
    return metrics.select(*[percent(c).alias(c) if c in cols else F.col(c) for c in metrics.columns])


def mode_figures(before: DataFrame, after: DataFrame, saved_balanced: bool, balanced: bool, label_col: str = "label") -> DataFrame:
    """Per label the rows before and after balancing, the rows in the
    selected mode, and whether a saved run used the other mode."""
    n = before.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("rows_before"))
    m = after.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("rows_after"))
    x = n.join(m, "label", "full").na.fill(0, ["rows_before", "rows_after"])
    chosen = "rows_after" if balanced else "rows_before"
    return x.withColumn("rows_selected", F.col(chosen)).withColumn("mode_differs", F.lit(saved_balanced != balanced))
