"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: ASCII white space as the contracts of the operators define it.
SPACE_CLASS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder named in ``spark.checkpoint.dir``."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"


def ship_package(spark: SparkSession) -> None:
    """Gives the Python workers this package, once per application, whatever their import path is."""
    sc = spark.sparkContext
    if getattr(sc, "_revtriage_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="revtriage-code-"), "revtriage-code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in sorted(os.walk(top)):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(target)
    sc._revtriage_shipped = True


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with this package on the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


#: Rows of 64 bits of the bitmap by which rows are told apart: some 10 MB when sent.
BITMAP_WORDS = 1 << 18

#: Tables that ``materialise`` wrote, innermost ``scratch_tables`` block last.
_BLOCKS: list[list[tuple[str, DataFrame]]] = []


def materialise(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: later jobs read the written table, so a lost executor
    never replays what made it, and values that depend on the order of rows
    in a partition (``monotonically_increasing_id``) are fixed once.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    if _BLOCKS:
        _BLOCKS[-1].append((path, out))
    return out


def remove_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch_tables(spark: SparkSession):
    """Collects the tables written inside; calling what it gives with the
    tables still needed removes the others, and lets Spark free the shuffle
    files of jobs that are over."""
    made: list[tuple[str, DataFrame]] = []
    _BLOCKS.append(made)

    def drop_but(*needed: DataFrame) -> None:
        for path, df in made:
            if not any(df is n for n in needed):
                remove_folder(spark, path)
        made[:] = [m for m in made if any(m[1] is n for n in needed)]
        free_shuffles(spark)

    try:
        yield drop_but
    finally:
        _BLOCKS.remove(made)
        if _BLOCKS:
            _BLOCKS[-1].extend(made)


def free_shuffles(spark: SparkSession) -> None:
    """Spark removes a shuffle's files once the driver has collected the plans that used it."""
    gc.collect()
    spark._jvm.System.gc()


def free_name(name: str, df: DataFrame) -> str:
    """``name`` with as many underscores as it takes to clash with no column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def told_apart(rows: DataFrame, col: str, wanted: DataFrame, wanted_col: str) -> tuple[DataFrame, DataFrame]:
    """(maybe, not): the rows whose ``col`` may be among the wanted values and
    those whose is not, by a bitmap of hashed values.  The bitmap has about 64
    bits per value and at most ``BITMAP_WORDS`` rows of 64 bits, which is what
    is sent to the tasks; beyond that size more rows are in the first part, and
    a join on the value decides as before."""
    n = wanted.count()
    words = min(BITMAP_WORDS, 1 << max(4, (n - 1).bit_length()))
    word_col, bits_col = free_name("_word", rows), free_name("_bits", rows)
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(64 * words))
    word = lambda c: F.floor(place(c) / 64)
    bit = lambda c: F.lit([1 << k if k < 63 else -(1 << 63) for k in range(64)])[(place(c) % 64).cast("int")]
    bitmap = wanted.select(word(wanted_col).alias(word_col), bit(wanted_col).alias("_bit")).groupBy(word_col).agg(F.bit_or("_bit").alias(bits_col))
    looked_up = rows.withColumn(word_col, word(col)).join(F.broadcast(bitmap), word_col, "left")
    hit = F.col(bits_col).bitwiseAND(bit(col)) != 0
    return looked_up.where(hit).select(*rows.columns), looked_up.where(F.coalesce(~hit, F.lit(True))).select(*rows.columns)


def by_number(rows: DataFrame, row: str, few: DataFrame, among: bool) -> DataFrame:
    """The rows whose number is among those of ``few``, or is not.  Both have a
    column ``row`` of numbers as ``monotonically_increasing_id`` gives.  A bitmap
    of these numbers is sent to the tasks, so no row moves and their order
    stays; if it has more than ``BITMAP_WORDS`` rows, only rows that ``told_apart``
    takes for them are joined."""
    word_col, bits_col = free_name("_word", rows), free_name("_bits", rows)
    bit = F.expr(f"shiftleft(1L, cast(`{row}` & 63 AS int))")
    bitmap = few.groupBy(F.shiftright(row, 6).alias(word_col)).agg(F.bit_or(bit).alias(bits_col))
    if bitmap.count() <= BITMAP_WORDS:
        looked_up = rows.withColumn(word_col, F.shiftright(row, 6)).join(F.broadcast(bitmap), word_col, "left")
        hit = F.coalesce(F.col(bits_col).bitwiseAND(bit) != 0, F.lit(False))
        return looked_up.where(hit if among else ~hit).select(*rows.columns)
    maybe, others = told_apart(rows, row, few, row)
    return maybe.join(few, row, "left_semi") if among else maybe.join(few, row, "left_anti").unionByName(others)


def az_lower(text: Column) -> Column:
    """Lower-cases A-Z only: ``lower`` (a byte loop) where the text is ASCII, else ``translate``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sorted_names(df: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """Distinct rows get integer names in the order of ``keys``.

    Range partitions and sorts; the name is the partition number and the row's
    place in it, so names rise with the keys and no task sees the whole table.
    ``keys`` must be unique in ``df``.  The caller writes the result down
    before using it.
    """
    n = shuffle_partitions(df.sparkSession)
    return df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn(name, F.monotonically_increasing_id())
