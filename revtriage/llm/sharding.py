"""Sharding by Hilbert-curve order (native DataFrame functions only).

Several metadata dimensions of a row (size of the text, language, source, id)
are quantised to ``BITS`` bits each, the row's place on the Hilbert curve
through that grid is computed in its row, the table is sorted by that place,
and the sorted table is cut into runs of equal row counts.  Rows that are near
in all dimensions are near on the curve, so a shard covers a small box of the
metadata and readers skip shards by the minima and maxima in its manifest.

Law ``rows``: shard sizes differ by one row at most, whatever the data.

Plan: one scan makes the small key table (id, size, checksum, codes), which is
written down; text columns get their code as the ordinal of their value among
the distinct values (a range sort over distinct values, joined back by a
sort-merge join that adaptive execution can split when one value holds a third
of all rows); the global order is a range-partitioned sort with one offset per
partition.  No window or task sees more than its range: a full cell of the grid
is split by id, which follows the place in the sort key.

Defined results: a null text has size 1 and the checksum of the empty text;
null dimensions get code 0; ties on the curve go by id, then checksum; repeated
rows are placed one by one; an empty table gives an empty result; columns
other than those named are ignored, and ``carry`` columns must not clash with
the result's names (ValueError).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rank import global_row_number
from .common import materialise

BITS = 8
SHARDS = 16


def log_code(x: Column, bits: int) -> Column:
    """Log-scale code of a positive long: its bit length, then its next three bits."""
    length = F.char_length(F.bin(x))
    fine = F.call_function("shiftright", x * 8, length - 1).bitwiseAND(F.lit(7))
    return F.least(length * 8 + fine, F.lit((1 << bits) - 1)).cast("long")


def linear_code(df: DataFrame, col: str, bits: int) -> Column:
    """Linear code between the column's minimum and maximum; null: 0."""
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    if lo is None:
        return F.lit(0).cast("long")
    scaled = ((F.col(col) - F.lit(lo)).cast("decimal(38,0)") * (1 << bits) / F.lit(hi - lo + 1)).cast("decimal(38,6)")
    return F.coalesce(F.floor(scaled).cast("long"), F.lit(0).cast("long"))


def with_ordinal_code(df: DataFrame, col: str, code: str, bits: int) -> DataFrame:
    """Adds ``code``: the ordinal of the value among the distinct values, scaled; null: 0."""
    values = df.select(col).where(F.col(col).isNotNull()).distinct()
    ranked = materialise(global_row_number(values, [col], "_ord"), f"ordinals-{col.strip('_')}")
    n = ranked.count()
    scaled = ranked.select(col, F.expr(f"cast(_ord * {(1 << bits) - 1} div {max(n, 1)} as long)").alias(code))
    return df.join(scaled, col, "left").withColumn(code, F.coalesce(code, F.lit(0).cast("long")))


def hilbert_index(codes: list[Column], bits: int) -> tuple[list[tuple[str, Column]], Column]:
    """Columns to add one after the other, and the place on the curve (bits * dimensions bits).

    Works from the coarsest bit down: where a coordinate's bit is set, the
    lower bits of the first coordinate are inverted, else they are exchanged
    with that coordinate's; the turned coordinates, Gray-coded, are the curve's
    digits (Skilling 2004).
    """
    n = len(codes)
    steps = ", ".join(f"struct({1 << b} AS q, {i} AS i)" for b in range(bits - 1, 0, -1) for i in range(n))
    turn = (
        f"aggregate(array({steps}), _x, (x, s) -> transform(x, (v, j) -> CASE"
        " WHEN (x[s.i] & s.q) <> 0 THEN IF(j = 0, v ^ (s.q - 1), v)"
        " WHEN j = 0 OR j = s.i THEN v ^ ((x[0] ^ x[s.i]) & (s.q - 1)) ELSE v END))"
    )
    gray = "array(" + ", ".join(" ^ ".join(f"_x[{j}]" for j in range(i + 1)) for i in range(n)) + ")"
    flip = " ^ ".join(f"IF((_x[{n - 1}] & {1 << b}) <> 0, {(1 << b) - 1}L, 0L)" for b in range(bits - 1, 0, -1))
    digits = " | ".join(f"shiftleft(shiftright(_x[{i}] ^ _f, {b}) & 1L, {b * n + n - 1 - i})" for b in range(bits) for i in range(n))
    stages = [("_x", F.array(*codes)), ("_x", F.expr(turn)), ("_x", F.expr(gray)), ("_f", F.expr(flip))]
    return stages, F.expr(digits)


def hilbert_shards(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    value_cols: tuple[str, ...] = ("lang", "source"),
    n_shards: int = SHARDS,
    bits: int = BITS,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard, hilbert, and ``carry``."""
    own = [id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard", "hilbert"]
    if set(own) & set(carry):
        raise ValueError(f"carried columns {sorted(set(own) & set(carry))} clash with the result's")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    values = {f"_v{i}": c for i, c in enumerate(value_cols)}
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + 1).cast("long").alias("_size"),
        F.crc32(text).alias("_crc"),
        *[F.col(c).cast("string").alias(v) for v, c in values.items()],
        *[F.col(c).alias(f"_c_{c}") for c in carry],
    )
    rows = materialise(rows, "shard-keys")
    total = rows.count()
    x = rows
    for v in values:
        x = with_ordinal_code(x, v, f"{v}_code", bits)
    codes = [log_code(F.col("_size"), bits), *[F.col(f"{v}_code") for v in values], linear_code(rows, "_id", bits)]
    stages, place = hilbert_index(codes, bits)
    for name, expr in stages:
        x = x.withColumn(name, expr)
    x = x.select("_id", "_size", "_crc", place.alias("_h"), *[f"_c_{c}" for c in carry])
    x = global_row_number(x, ["_h", "_id", "_crc"], "_r")
    base, rest = divmod(total, n_shards)
    cut, r = rest * (base + 1), "(_r - 1)"
    shard = f"CASE WHEN {r} < {cut} THEN {r} div {base + 1} ELSE {rest} + ({r} - {cut}) div {max(base, 1)} END"
    slot = f"CASE WHEN {r} < {cut} THEN {r} % {base + 1} ELSE ({r} - {cut}) % {max(base, 1)} END"
    return x.select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.expr(shard).cast("int").alias("shard"),
        F.expr(slot).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("_h").alias("hilbert"),
        *[F.col(f"_c_{c}").alias(c) for c in carry],
    )


def write_shards(shards: DataFrame, path: str) -> None:
    """One folder per shard, its rows in slot order."""
    shards.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def manifest(shards: DataFrame, dims: list[str]) -> DataFrame:
    """Per shard: rows, bytes, and the minimum and maximum of each dimension, for pruning."""
    bounds = [f(c).alias(f"{k}_{c}") for c in dims for k, f in (("min", F.min), ("max", F.max))]
    return shards.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), *bounds)
