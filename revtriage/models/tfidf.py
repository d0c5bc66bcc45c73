"""TF-IDF in long form: (doc, term, weight) rows (M1, M1b-M1e).

Semantics of the vectoriser the reference configures: tokens are words of
two or more word characters of the cleaned text; stop words are removed
before n-grams; the vocabulary keeps terms whose document frequency lies in
[min_df, max_df] (int = count, float = fraction of documents); the weight is
tf (or 1 + ln tf) times ln((1 + n) / (1 + df)) + 1, then L2-normalised per
document over the kept terms.

Plan shape: documents are partitioned and sorted by id while they are still
texts, and an Arrow function counts each one's terms (rows of one id are one
document), so there is no exchange of term rows; document frequencies are a
partial aggregate by term, so a term present in a third of all documents is
pre-summed before its shuffle.  A document's terms are one list: what is known
per document (its norm) meets them by one row, not by one per term.
``fit_transform`` exchanges no term rows either: some documents at a time are one
row with their entries and own terms, packed and compressed; the own terms go to
term buckets, which send back the frequency of each, and weights and norms are
made where the documents are (``weigh_groups``).
Elsewhere the vocabulary is joined by a shuffle, or broadcast when adaptive execution
finds its bytes below the session's limit.  A linear model is scored by one
join with its (term, idf, coefficients) table and one aggregate per document:
the norm divides sums, so no weight has to be normed before.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..config import STOP_WORDS, TfidfParams
from ..session import scratch_path, ship_package, written

#: Terms that leave the counting function in one batch, about.
BATCH_TERMS = 1 << 17
#: Entries (a term in a document) of the documents that ``fit_transform`` packs into one row, about.
GROUP_ENTRIES = 1 << 20


def stop_words_of(params: TfidfParams) -> tuple[str, ...]:
    return STOP_WORDS if params.stop_words is None else tuple(params.stop_words)


def kept_words(clean_col, stop_words) -> Column:
    """The words of a cleaned text ([a-z0-9] words, single spaces) without
    one-character words and stop words: each word is looked up in a hash set,
    whatever the number of stop words."""
    c = F.col(clean_col) if isinstance(clean_col, str) else clean_col
    drop = sorted({"", *string.ascii_lowercase, *string.digits, *stop_words})
    return F.filter(F.split(c, " "), lambda w: ~w.isin(*drop))


def ngrams_of(words: Column, n: int) -> Column:
    """The n-grams of a list of words: the list zipped with itself, one place on."""
    grams, places = words, F.size(words)
    for k in range(1, n):
        size = F.greatest(places - k, F.lit(0))
        grams = F.zip_with(F.slice(grams, F.lit(1), size), F.slice(words, F.lit(k + 1), size), lambda a, b: F.concat(a, F.lit(" "), b))
    return grams


def terms_of(words: Column, ngram_max: int) -> Column:
    """Unigrams, then 2..n-grams of a list of words."""
    return F.concat(*[ngrams_of(words, n) for n in range(1, ngram_max + 1)])


def letters_only(text_col) -> Column:
    """Lower-cased letters with every run of non-letters as one space."""
    c = F.col(text_col) if isinstance(text_col, str) else text_col
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}]+", " "))


def char_terms(kept: Column, n: int) -> Column:
    """All character n-grams (windows of n characters) of a text."""
    return F.regexp_extract_all(kept, F.lit("(?=(.{%d}))" % n), F.lit(1))


def dropped_words(stop_words) -> frozenset[str]:
    """What ``kept_words`` leaves out."""
    return frozenset({"", *string.ascii_lowercase, *string.digits, *stop_words})


def terms_in(text: str, params: TfidfParams, drop: frozenset[str]) -> list[str]:
    """The terms of one cleaned text, as ``terms_of`` and ``char_terms`` give them."""
    if params.analyzer == "char":
        return [text[i : i + params.char_n] for i in range(len(text) - params.char_n + 1)]
    words = [w for w in text.split(" ") if w not in drop]
    out = words
    for n in range(2, params.ngram_max + 1):
        out = out + [" ".join(g) for g in zip(*[words[k:] for k in range(n)])]
    return out


def count_lists(params: TfidfParams, width: int):
    """The Arrow function of ``term_lists``: rows of ``width`` key columns and a
    text, equal keys next to each other, to one list of counted terms per key."""
    drop = dropped_words(stop_words_of(params))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, key, found = None, None, Counter()
        keys, lists, size = [], [], 0

        def made() -> pa.RecordBatch:
            offsets = pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
            terms = pa.array([t for c in lists for t in c], pa.string())
            counts = pa.array([n for c in lists for n in c.values()], pa.int64())
            columns = [pa.array([k[i] for k in keys], schema.field(i).type) for i in range(width)]
            columns.append(pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([terms, counts], ["term", "tf"])))
            return pa.RecordBatch.from_arrays(columns, [*schema.names[:width], "_terms"])

        for batch in batches:
            schema = batch.schema
            for *mine, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if mine != key:
                    if found:
                        keys.append(key)
                        lists.append(found)
                        size += len(found)
                    key, found = mine, Counter()
                    if size >= BATCH_TERMS:
                        yield made()
                        keys, lists, size = [], [], 0
                if text is not None:
                    found.update(terms_in(text, params, drop))
        if found:
            keys.append(key)
            lists.append(found)
        if keys:
            yield made()

    return run


def term_lists(df: DataFrame, id_col: str, clean_col: str, params: TfidfParams, keep: list[str] | None = None) -> DataFrame:
    """(id, *keep, _terms): the terms of every document with their counts, a
    list of (term, tf); documents without a term have no row."""
    x, schema = cleaned_texts(df, id_col, clean_col, params, keep)
    return x.mapInArrow(count_lists(params, len(schema) - 1), schema)


def cleaned_texts(df: DataFrame, id_col: str, clean_col: str, params: TfidfParams, keep: list[str] | None = None) -> tuple[DataFrame, ST.StructType]:
    """What ``count_lists`` reads, (id, *keep, text) by id, and the schema of what it makes."""
    ship_package(df.sparkSession)
    key = [id_col, *(keep or [])]
    x = df.select(*key, F.col(clean_col).alias("_c")).repartition(id_col)
    if params.analyzer == "char":
        x = x.select(*key, letters_only("_c").alias("_c"))
    x = x.sortWithinPartitions(*key)
    counted = ST.ArrayType(ST.StructType([ST.StructField("term", ST.StringType()), ST.StructField("tf", ST.LongType())]))
    return x, ST.StructType([ST.StructField(f.name, f.dataType) for f in x.schema.fields[: len(key)]] + [ST.StructField("_terms", counted)])


def ready_lists(df: DataFrame, id_col: str, clean_col: str, params: TfidfParams, keep: list[str] | None = None) -> DataFrame:
    """``term_lists`` for two or three readers.  Words are counted again by each,
    in less time than a list of them takes to be written; character n-grams, which are many
    and have few different values, are written."""
    lists = term_lists(df, id_col, clean_col, params, keep)
    return written(lists, "term-lists") if params.analyzer == "char" else lists


def each_term(lists: DataFrame) -> DataFrame:
    """Term lists as rows: the other columns, term, tf."""
    return lists.select(*[c for c in lists.columns if c != "_terms"], F.inline("_terms"))


def term_counts(df: DataFrame, id_col: str, clean_col: str, params: TfidfParams, keep: list[str] | None = None) -> DataFrame:
    """(id, *keep, term, tf) for every term occurrence of every document."""
    return each_term(term_lists(df, id_col, clean_col, params, keep))


@dataclass
class TfidfModel:
    vocab: DataFrame  # term, df, idf
    n_docs: int
    vocab_size: int
    params: TfidfParams

    def transform(self, df: DataFrame, id_col: str, clean_col: str = "clean_text", keep: list[str] | None = None) -> DataFrame:
        """Long form (id, *keep, term, weight) over the fitted vocabulary."""
        return self.weights(term_counts(df, id_col, clean_col, self.params, keep), id_col, keep)

    def weights(self, tf: DataFrame, id_col: str, keep: list[str] | None = None) -> DataFrame:
        """Long-form weights from term counts (id, *keep, term, tf)."""
        keep = keep or []
        x = tf.join(self.vocab, "term", "inner")
        x = x.withColumn("w", term_weight(self.params))
        if self.params.norm:
            norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
            x = x.withColumn("weight", F.col("w") / norm)
        else:
            x = x.withColumn("weight", F.col("w"))
        return x.select(id_col, *keep, "term", "weight")


def term_frequency(params: TfidfParams) -> Column:
    """What a row (tf) counts for."""
    return (F.lit(1.0) + F.log(F.col("tf"))) if params.sublinear_tf else F.col("tf").cast("double")


def term_weight(params: TfidfParams) -> Column:
    """Weight of a row (tf, idf) before the document's norm."""
    return term_frequency(params) * F.col("idf")


def document_norms(tf: DataFrame, vocab: DataFrame, id_col: str, params: TfidfParams) -> DataFrame:
    """id, _norm: the norm of every document with a term of ``vocab``, from term counts."""
    rows = tf.select(id_col, "term", "tf").join(vocab.select("term", "idf"), "term")
    norm = F.sqrt(F.sum(term_weight(params) * term_weight(params))) if params.norm else F.lit(1.0)
    return rows.groupBy(id_col).agg(norm.alias("_norm"))


def join_documents(df: DataFrame, of_documents: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``df`` with the columns of the one row per id of ``of_documents``; a null id is an id."""
    more = [c for c in of_documents.columns if c != id_col]
    return df.alias("_l").join(of_documents.alias("_r"), F.col(f"_l.{id_col}").eqNullSafe(F.col(f"_r.{id_col}"))).select("_l.*", *more)


def linear_scores(df: DataFrame, id_col: str, clean_col: str, params: TfidfParams, table: DataFrame, width: int) -> DataFrame:
    """id, _sum (of weights) and _scores (sum of weight * coefficient, per
    column of the model) for the documents with a known term; ``table`` holds
    term, idf and coef (array of ``width`` numbers)."""
    x = term_counts(df, id_col, clean_col, params).join(table.select("term", "idf", "coef"), "term")
    x = x.select(id_col, term_weight(params).alias("_w"), "coef")
    sums = x.groupBy(id_col).agg(
        F.sum(F.col("_w") * F.col("_w")).alias("_q"), F.sum("_w").alias("_sum"), *[F.sum(F.col("_w") * F.col("coef")[k]).alias(f"_s{k}") for k in range(width)]
    )
    norm = F.sqrt("_q") if params.norm else F.lit(1.0)
    return sums.select(id_col, (F.col("_sum") / norm).alias("_sum"), F.array(*[F.col(f"_s{k}") / norm for k in range(width)]).alias("_scores"))


def df_bounds(n_docs: int, params: TfidfParams) -> tuple[float, float]:
    """The document frequencies of the vocabulary."""
    lo = params.min_df * n_docs if isinstance(params.min_df, float) else params.min_df
    hi = params.max_df * n_docs if isinstance(params.max_df, float) else params.max_df
    if hi < lo:
        raise ValueError("max_df corresponds to < documents than min_df")
    return lo, hi


def fit_counts(tf: DataFrame, n_docs: int, params: TfidfParams) -> TfidfModel:
    """Vocabulary and idf from term counts (one row per document and term)."""
    return fit_frequencies(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")), n_docs, params)


def fit_frequencies(dfreq: DataFrame, n_docs: int, params: TfidfParams) -> TfidfModel:
    """Vocabulary and idf from document frequencies (term, df)."""
    lo, hi = df_bounds(n_docs, params)
    vocab = dfreq.where((F.col("df") >= F.lit(lo)) & (F.col("df") <= F.lit(hi)))
    vocab = vocab.withColumn("idf", F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0))
    vocab = written(vocab.select("term", "df", "idf"), "vocabulary")
    vocab_size = vocab.count()
    if vocab_size == 0:
        raise ValueError("After pruning, no terms remain. Try a lower min_df or a higher max_df.")
    return TfidfModel(vocab, n_docs, vocab_size, params)


# ------------------------------------------- documents and their terms, packed


GROUPS = "gid long, keys binary, entries binary, terms binary"
PARTS = "gid long, bucket int, entries binary, terms binary"
FREQUENCIES = "kind string, gid long, bucket int, entries binary, terms binary"


def packed(**columns) -> bytes:
    t = pa.table(columns)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    return out.getvalue().to_pybytes()


def unpacked(blob) -> pa.Table:
    return pa.ipc.open_stream(blob.as_buffer()).read_all().combine_chunks()


def column(t: pa.Table, name: str):
    """A column as one array."""
    c = t[name].combine_chunks()
    return pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c


def buckets_of(terms: pa.Array, buckets: int) -> np.ndarray:
    return (pd.util.hash_array(terms.to_numpy(zero_copy_only=False).astype(object), categorize=False) % np.uint64(buckets)).astype(np.int32)


def record(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*[c.split() for c in schema.split(", ")], strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(zip(*rows, strict=True), types, strict=True)], list(names))


def group_lists(width: int):
    """Term lists, rows of an id next to each other, to groups of whole ids: keys,
    entries (numbers of terms, as steps up within a document) and the terms in order."""

    def made(t: pa.Table, gid: int) -> pa.RecordBatch:
        lists = column(t, "_terms")
        flat, n = lists.flatten(), pc.list_value_length(lists)
        coded = flat.field("term").dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        place = np.repeat(np.arange(len(n)) * len(order), n.to_numpy()) + number[coded.indices.to_numpy()]
        by = np.argsort(place)
        step = np.diff(place[by], prepend=0)
        keys = {f"k{i}": column(t, t.schema.names[i]) for i in range(width)}
        tf = flat.field("tf").to_numpy()[by].astype(np.int32)
        return record(GROUPS, [(gid, packed(**keys, n=n), packed(step=step, tf=tf), packed(term=coded.dictionary.take(pa.array(order))))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gid, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            held.append(batch)
            size += pc.sum(pc.list_value_length(batch["_terms"])).as_py() or 0
            if size >= GROUP_ENTRIES:
                t = pa.Table.from_batches(held)
                ids, cut = t[t.schema.names[0]], t.num_rows - 1
                last = ids[cut].as_py()
                while cut and ids[cut - 1].as_py() == last:
                    cut -= 1
                if cut:
                    yield made(t.slice(0, cut), gid)
                    rest = t.slice(cut).combine_chunks()
                    gid, held, size = gid + 1, rest.to_batches(), pc.sum(pc.list_value_length(column(rest, "_terms"))).as_py()
        if held and size:
            yield made(pa.Table.from_batches(held), gid)

    return run


def entries_of(blob, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A group's entries: document, term and count."""
    t = unpacked(blob)
    place = np.cumsum(column(t, "step").to_numpy())
    return place // terms, place % terms, column(t, "tf").to_numpy()


def bucket_parts(buckets: int):
    """Per group and bucket: the group's terms there, with their frequency in the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gid, entries, blob in zip(batch["gid"].to_pylist(), batch["entries"], batch["terms"], strict=True):
                term = column(unpacked(blob), "term")
                df, bucket = np.bincount(entries_of(entries, len(term))[1], minlength=len(term)).astype(np.int32), buckets_of(term, buckets)
                parts = [(b, bucket == b) for b in np.unique(bucket)]
                yield record(PARTS, [(gid, int(b), packed(df=df[mine]), packed(term=term.filter(pa.array(mine)))) for b, mine in parts])

    return run


def add_frequencies(table: pa.Table) -> pa.Table:
    """One bucket's parts of all groups: back to each group the whole frequencies of its terms, and the bucket's terms."""
    parts = [(unpacked(e), unpacked(t)) for e, t in zip(table["entries"], table["terms"], strict=True)]
    coded = pa.concat_arrays([column(t, "term") for _, t in parts]).dictionary_encode()
    index = coded.indices.to_numpy()
    df = np.bincount(index, np.concatenate([column(e, "df").to_numpy() for e, _ in parts])).astype(np.int64)
    cuts = np.cumsum([e.num_rows for e, _ in parts])[:-1]
    back = [packed(df=v) for v in np.split(df[index], cuts)]
    n, bucket = len(back), table["bucket"][0].as_py()
    return pa.table({
        "kind": ["group"] * n + ["vocabulary"], "gid": pa.array([*table["gid"].to_pylist(), None], pa.int64()), "bucket": pa.array([bucket] * (n + 1), pa.int32()),
        "entries": pa.array([*back, packed(df=df)], pa.binary()), "terms": pa.array([None] * n + [packed(term=coded.dictionary)], pa.binary()),
    })


def each_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for e, t in zip(batch["entries"], batch["terms"], strict=True):
            yield pa.RecordBatch.from_arrays([column(unpacked(t), "term"), column(unpacked(e), "df")], ["term", "df"])


def weigh_groups(names: list[str], buckets: int, n_docs: int, lo: float, hi: float, params: TfidfParams):
    """A group's documents and its terms' frequencies to rows (*names, term, weight)."""

    def run(docs: pa.Table, frequencies: pa.Table) -> pa.Table:
        keys, term = unpacked(docs["keys"][0]), column(unpacked(docs["terms"][0]), "term")
        bucket, df = buckets_of(term, buckets), np.zeros(len(term), np.int64)
        for b, blob in zip(frequencies["bucket"].to_pylist(), frequencies["entries"], strict=True):
            df[bucket == b] = column(unpacked(blob), "df").to_numpy()
        doc, index, tf = entries_of(docs["entries"][0], len(term))
        kept = ((df >= lo) & (df <= hi))[index]
        index, tf, doc = index[kept], tf[kept], doc[kept]
        weight = (1.0 + np.log(tf) if params.sublinear_tf else tf.astype(float)) * (np.log((1.0 + n_docs) / (1.0 + df)) + 1.0)[index]
        if params.norm:
            ids = keys["k0"].to_pylist()
            of_id = np.cumsum([a != b for a, b in zip(ids, [ids[0], *ids], strict=False)])[doc]
            weight = weight / np.sqrt(np.bincount(of_id, weight * weight))[of_id]
        columns = [column(keys, f"k{i}").take(pa.array(doc)) for i in range(len(names))]
        return pa.table([*columns, term.take(pa.array(index)), pa.array(weight)], names=[*names, "term", "weight"])

    return run


def fit(df: DataFrame, id_col: str, clean_col: str = "clean_text", params: TfidfParams = TfidfParams()) -> TfidfModel:
    """Vocabulary and idf from the documents of ``df`` (the training side)."""
    return fit_counts(term_counts(df, id_col, clean_col, params), df.count(), params)


def fit_transform(df: DataFrame, id_col: str, clean_col: str = "clean_text", params: TfidfParams = TfidfParams(),
                  keep: list[str] | None = None) -> tuple[TfidfModel, DataFrame]:
    """Fit on ``df`` and weight the same documents."""
    spark, names = df.sparkSession, [id_col, *(keep or [])]
    texts, lists = cleaned_texts(df, id_col, clean_col, params, keep)
    count, group = count_lists(params, len(names)), group_lists(len(names))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, n_docs = scratch_path(spark, "term-frequencies"), df.count()
    groups = written(texts.mapInArrow(lambda batches: group(count(batches)), GROUPS), "term-groups")
    parts = groups.select("gid", "entries", "terms").mapInArrow(bucket_parts(buckets), PARTS)
    # The rows of a bucket are one per group of documents.
    found = parts.groupBy("bucket").applyInArrow(add_frequencies, FREQUENCIES)
    found.write.partitionBy("kind").parquet(path)
    found = spark.read.schema(FREQUENCIES).parquet(path)
    vocabulary = found.where("kind = 'vocabulary'").select("entries", "terms")
    model = fit_frequencies(vocabulary.mapInArrow(each_frequency, "term string, df long"), n_docs, params)
    lo, hi = df_bounds(n_docs, params)
    schema = ST.StructType([ST.StructField(f.name, f.dataType) for f in lists.fields[: len(names)]] + [ST.StructField("term", ST.StringType()), ST.StructField("weight", ST.DoubleType())])
    mine = found.where("kind = 'group'").select("gid", "bucket", "entries")
    return model, groups.groupBy("gid").cogroup(mine.groupBy("gid")).applyInArrow(weigh_groups(names, buckets, n_docs, lo, hi, params), schema)


def top_terms(weights: DataFrame, id_col: str, k: int = 5, digits: int = 9) -> DataFrame:
    """The k strongest terms per document, weight desc then term.

    ``row_number() <= k`` with a constant k lets Spark cut each document's
    group before the shuffle (group limit)."""
    w = Window.partitionBy(id_col).orderBy(F.desc(F.round("weight", digits)), F.asc("term"))
    top = weights.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k)
    return top.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_rk").alias("rank"), "term", F.col("weight").alias("score")))).alias("top_terms")
    )
