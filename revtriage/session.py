"""Session helpers: building a session for tests/bench and finding the shared
checkpoint folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Config for local runs (tests, bench).  On a cluster the session comes from
# the platform; only ``ensure_checkpoint_dir`` is applied to it.
LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
}


def build_session(master: str | None = None, app_name: str = "revtriage", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master or "local[8]").appName(app_name)
    for k, v in {**LOCAL_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``.  Only a session on one
    machine (``local[...]``, as in tests) may go without: it gets a folder of
    its own.  Anywhere else a missing setting is an error, since a folder of
    the driver's disk is not seen by the executors.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="revtriage-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location for written tables."""
    base = ensure_checkpoint_dir(spark)
    import uuid

    return os.path.join(base, "tables", f"{name}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df):
    """Materialise ``df`` into the shared checkpoint folder and return it
    with its lineage cut: later jobs read the written table, executor loss
    does not replay the upstream plan, and plans stay small."""
    ensure_checkpoint_dir(df.sparkSession)
    # A reliable checkpoint runs the plan once for the eager count and once
    # more to write the files unless the rows are cached: cache, write, drop.
    cached = df.persist()
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out


def written(df, name: str):
    """``df`` written once as Parquet and read back, for tables that are large
    next to the input (a row per document and term): no cached copy in memory,
    and readers take the columns they need."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Gives the Python workers this package, once per application, whatever their import path is."""
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_revtriage_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="revtriage-code-"), "revtriage-code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in sorted(os.walk(top)):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(target)
    sc._revtriage_shipped = True
