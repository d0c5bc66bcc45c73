"""A table that is updated by jobs that read it.

Spark cannot overwrite a path it is reading, so every write goes to a folder of
its own.  A version exists once the commit log names its folder: entry n of the
log is a small file that is created only if no entry n is there, so of two
writers that start from version n - 1 one succeeds and the other is told.
Readers take the largest number; file times play no part.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

LOG = "_log"


class VersionConflict(RuntimeError):
    """Another writer has committed the next version."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, table_dir: str) -> dict[int, str]:
    """Folder of each committed version; an entry that its writer has not finished is none yet."""
    fs, log = _fs(spark, f"{table_dir}/{LOG}")
    if not fs.exists(log):
        return {}
    out = {}
    for status in fs.listStatus(log):
        name = status.getPath().getName()
        if name.isdigit() and status.getLen():
            stream = fs.open(status.getPath())
            out[int(name)] = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
    return out


def write_version(df: DataFrame, table_dir: str, after: int = 0, fmt: str = "parquet") -> int:
    """Writes ``df`` as the version that follows ``after`` (the one that was read; 0: none) and returns its number."""
    spark = df.sparkSession
    folder = f"v-{uuid.uuid4().hex[:12]}"
    df.write.format(fmt).save(f"{table_dir}/{folder}")
    fs, entry = _fs(spark, f"{table_dir}/{LOG}/{after + 1:020d}")
    try:
        out = fs.create(entry, False)
    except Py4JJavaError as e:
        if fs.exists(entry):
            raise VersionConflict(f"version {after + 1} of {table_dir} is there already") from e
        raise
    out.write(bytearray(folder.encode()))
    out.close()
    return after + 1


def base_table(spark: SparkSession, table_dir: str, number: int | None = None, fmt: str = "parquet") -> tuple[DataFrame, int]:
    """The newest version, or the one asked for, and its number; an error where there is none."""
    known = versions(spark, table_dir)
    number = max(known, default=0) if number is None else number
    if number not in known:
        raise FileNotFoundError(f"no version {number or ''} of a table at {table_dir}")
    return spark.read.format(fmt).load(f"{table_dir}/{known[number]}"), number
