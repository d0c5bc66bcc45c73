"""Sinks (K1-K3, K5, K7).

Every writer is a distributed write of part files; nothing is gathered on
the driver except the few summary rows of K5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.aggregate import split_summary

CSV_WRITE = {
    "header": "true", "escape": '"', "quote": '"',
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    """K1/K7: CSV with header, overwrite; a folder of part files (no BOM)."""
    df.write.mode("overwrite").options(**CSV_WRITE).option("encoding", encoding).csv(path)


def write_split(split: DataFrame, path: str, fmt: str = "parquet", role_col: str = "dataset_role", order_col: str = "review_id") -> None:
    """One folder per role, rows sorted by id inside each file.

    No shuffle by role: a role holds most rows, so every task writes its own
    file per role (sorted within the task) instead of one task per role."""
    split.sortWithinPartitions(role_col, order_col).write.mode("overwrite").partitionBy(role_col).format(fmt).save(path)


def split_summary_markdown(split: DataFrame, source_name: str, label_col: str = "label", role_col: str = "dataset_role",
                           train_role: str = "training", test_role: str = "testing_manual") -> str:
    """K5: the A7 rollup (a row per role and label, and their totals) as a
    Markdown report with one table, a column per role."""
    n = {(r[role_col], r[label_col]): r["n"] for r in split_summary(split, label_col, role_col).collect()}
    roles = (train_role, test_role)
    labels = sorted({label for role, label in n if role in roles and label is not None})
    body = [(f"`{x}`", *(n.get((role, x), 0) for role in roles)) for x in labels]
    body.append(("all", *(n.get((role, None), 0) for role in roles)))
    head = f"Split of `{source_name}`: {n.get((None, None), 0)} rows\n\n| label | {' | '.join(roles)} |\n|---|---:|---:|\n"
    return head + "\n".join("| " + " | ".join(map(str, row)) + " |" for row in body) + "\n"
