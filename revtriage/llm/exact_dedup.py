"""Exact dedup by deterministic block naming (native DataFrame functions only).

A text is lower-cased (A-Z only), taken as UTF-8 bytes and cut into blocks of
a fixed size.  The distinct blocks of the corpus are sorted and numbered: equal
blocks have one integer name.  Then adjacent names of a document are paired,
the distinct pairs are sorted and numbered, and so on, until each document is
one integer: after ``k`` rounds ``2**k`` blocks have one name.  Two documents
are equal exactly when they end in the same round with the same name.

Blocks travel through one shuffle (to find the distinct ones).  Everything
else moves a 128-bit key per block; the run proves on its own data that no two
distinct blocks share a key and takes another seed if they do, so the identity
is free of collisions, not just likely to be.

Memory: no aggregate holds more than fixed-width values; a hot block (a third
of all rows) is one row of the dictionary, and its join is a sort-merge join
whose large partitions adaptive execution splits.

Defined results: a null text counts as empty; equal texts keep the row with
the largest id; of repeated rows with that id one stays; a null id is smaller
than any other; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import az_lower, materialise, sorted_names

BLOCK_BYTES = 8192
MAX_SEEDS = 8


def normalised(text: Column) -> Column:
    return az_lower(F.coalesce(text, F.lit("")))


def _fingerprints(block: Column, seed: int, bits: int) -> list[Column]:
    """128-bit key of a block; ``bits`` (for tests) keeps only the low bits of one half."""
    a, b = F.xxhash64(F.lit(2 * seed), block), F.xxhash64(F.lit(2 * seed + 1), block)
    if bits < 64:
        a, b = a.bitwiseAND(F.lit((1 << bits) - 1)), F.lit(0).cast("long")
    return [a.alias("f1"), b.alias("f2")]


def _blocks(block_bytes: int) -> Column:
    return F.expr(
        f"transform(sequence(0, greatest(0, cast((octet_length(_b) - 1) div {block_bytes} as int))),"
        f" i -> substring(_b, i * {block_bytes} + 1, {block_bytes}))"
    )


def name_documents(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES, bits: int = 64, carry: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, names): ``rows`` has _rid, _id, _sha and _carry per input row; ``names`` has _rid, _level, _name."""
    src = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).cast("binary").alias("_b"), (F.col(carry) if carry else F.lit(0)).alias("_carry"))
    for seed in range(MAX_SEEDS):
        block = F.col("_block")
        distinct = src.select(F.explode(_blocks(block_bytes)).alias("_block")).select(*_fingerprints(block, seed, bits), block).distinct()
        keys = distinct.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("_n"))
        names = materialise(sorted_names(keys, ["f1", "f2"]), "block-names")
        if (names.agg(F.max("_n")).first()[0] or 0) <= 1:
            break
    else:
        raise RuntimeError("distinct blocks kept sharing keys")
    fps = F.transform(_blocks(block_bytes), lambda x: F.struct(*_fingerprints(x, seed, bits)))
    rows = materialise(src.select(F.monotonically_increasing_id().alias("_rid"), "_id", "_carry", F.sha2("_b", 256).alias("_sha"), fps.alias("_fps")), "rows")

    named = rows.select("_rid", F.size("_fps").alias("_n"), F.posexplode("_fps").alias("_pos", "_f"))
    named = named.select("_rid", "_n", "_pos", "_f.f1", "_f.f2").join(names.select("f1", "f2", "name"), ["f1", "f2"]).select("_rid", "_n", "_pos", "name")
    named = materialise(named, "level-0")
    done = named.where("_n = 1").select("_rid", F.lit(0).alias("_level"), F.col("name").alias("_name"))
    longest = named.agg(F.max("_n")).first()[0] or 0
    level = 0
    while longest > 1:
        level += 1
        odd = F.col("_pos") % 2 == 1
        pairs = (
            named.where("_n > 1")
            .groupBy("_rid", "_n", F.shiftright("_pos", 1).alias("_pos"))
            .agg(F.max(F.when(~odd, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-1)).alias("b"))
        )
        pairs = materialise(pairs, f"pairs-{level}")
        names = materialise(sorted_names(pairs.select("a", "b").distinct(), ["a", "b"]), f"pair-names-{level}")
        named = pairs.join(names, ["a", "b"]).select("_rid", F.expr("cast((_n + 1) div 2 as int)").alias("_n"), "_pos", "name")
        named = materialise(named, f"level-{level}")
        done = done.unionByName(named.where("_n = 1").select("_rid", F.lit(level).alias("_level"), F.col("name").alias("_name")))
        longest = (longest + 1) // 2
    return rows.drop("_fps"), done


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, bits: int = 64, carry: str | None = None) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256 (of the normalised text), and the column ``carry`` if named."""
    rows, names = name_documents(docs, id_col, text_col, block_bytes, bits, carry)
    x = materialise(names.join(rows, "_rid"), "named-rows")
    least = F.lit(-(1 << 63)) if dict(docs.dtypes)[id_col] in ("bigint", "int") else F.lit("")
    groups = x.groupBy("_level", "_name").agg(
        F.max("_id").alias("keep_id"),
        F.count(F.lit(1)).alias("group_size"),
        F.max_by("_rid", F.coalesce(F.col("_id"), least)).alias("_keeper"),
    )
    out = x.join(groups, ["_level", "_name"])
    return out.select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("_rid") == F.col("_keeper")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
        *([F.col("_carry").alias(carry)] if carry else []),
    )
