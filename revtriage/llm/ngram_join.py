r"""Self-join of documents by Jaccard similarity of their word n-grams, by
vertical partitioning.

A document's set holds its distinct n-grams (64-bit hashes of them: two of a
pair's n-grams share one with probability below |x| * |y| / 2**64).  Documents
with equal sets are one class (128-bit digest of the sorted set), so copies are
never compared.  Then, over classes:

1. *Shared counts.*  The n-gram space is cut into fragments.  Documents are
   taken in runs; a run sends each fragment its n-grams there (32 bits of each,
   and the place of its class in the run), all of a run in one row, and one row
   that names its documents and classes.  A fragment finds by itself which of its
   n-grams occur in two classes or more and sends each run the places of those;
   the run adds them up.  A class of which less than the threshold's share is
   shared can have no partner.  In this step n-grams are compared by fewer bits,
   which may only count too many as shared, and classes by 64 bits of their
   digest.
   Texts of other classes are left behind by a bitmap of bounded size before
   the few that are needed are moved.
2. *Order and segments.*  For the classes left, n-grams are ordered by document
   frequency, rare ones first, and this global order is cut into fragments at
   pivots; a class is a segment per fragment.
3. *Candidates.*  Two similar sets share an n-gram within their prefixes of that
   order, and at the first one enough n-grams follow it in both (positional and
   length filters).  First each class is tried with one hub, the most central
   class that most of its prefix n-grams point to, so a group of k near copies
   costs k pairs; then, with the components so far, only pairs across components
   are tried, from the members outside a prefix n-gram's largest component.
   A place in the order bounds the size of a partner that enough n-grams can
   follow in, so the join is on the n-gram and a band of sizes, and classes that
   share a long passage but are too unlike meet nowhere; an n-gram of many
   classes is cut into tiles.
   A pair inside one component need not be counted, as it can't change it.
4. *Overlaps.*  Partial overlaps are counted per pair and fragment, separately,
   and summed per pair; the sum decides.

Links are exact: nothing is sampled or capped.  Components come from minimum
labels passed along the links with pointer jumping.

Skew: copies are collapsed in their run, so a class has at most one row per run
in any join, however many copies it has; a fragment holds about
``FRAGMENT_GRAMS`` n-grams however often one of them occurs, since a class counts
once a run; joins on n-grams and pairs are sort-merge joins whose large
partitions adaptive execution splits, besides the tiles.

Defined results: null, empty and blank texts have an empty set and are linked
with nothing, not with each other; a text of fewer words than n is one n-gram;
of repeated ids each row is a document; a null id is no component's smallest
unless all are null; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_shuffles, map_arrow, materialise, scratch_tables, ship_package, told_apart
from .units import hub_tokenizer, slices

N = 5
PERCENT = 75
SEGMENTS = 8
FRAGMENT_GRAMS = 4_000_000
#: Bytes of text per n-gram, at least; only sets the number of fragments.
BYTES_PER_GRAM = 6
FLUSH_GRAMS = 2_000_000
#: Documents per run at most; places of classes take 16 bits.
FLUSH_DOCUMENTS = 50_000
HUB_ROUNDS = 2
#: Sizes of classes in one band of the join differ by this factor at most.
BAND = 1.05
#: Classes of one n-gram that a tile tries against the others.
TILE = 2000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)
_WORDS: dict[bytes, int] = {}


def _hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    if len(_WORDS) > 500_000:
        _WORDS.clear()
    for w in set(words).difference(_WORDS):
        _WORDS[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def _forget_words() -> None:
    """A worker serves other operators next: the memo and unused buffers are let go."""
    _WORDS.clear()
    pa.default_memory_pool().release_unused()


def gram_set(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the text's n-grams.  ``bytes.lower`` folds A-Z
    only and ``bytes.split`` cuts at ASCII white space only."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = _hashes(words)
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, len(w) if k < n else 0, np.uint64)
    for i in range(k):
        h += w[i : len(w) - k + 1 + i] * _ODD[i % 5] + np.uint64(i // 5)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def digest(grams: np.ndarray) -> tuple[int, int]:
    """128 bits of a set as two signed 64-bit integers."""
    import xxhash

    return tuple(int(x) for x in np.frombuffer(xxhash.xxh3_128_digest(grams.tobytes()), "<i8"))


_RUN_COLUMNS = ("fragment", "run", "ids", "slots", "keys", "sizes", "grams", "owners")


def run_pieces(docs: DataFrame, id_col: str, text_col: str, n: int, fragments: int) -> DataFrame:
    """Per run of documents a head (fragment below 0: ids, class place of each
    or -1, class digests and set sizes) and a piece per fragment (n-grams, 32
    bits each, with the places of their classes, and 64 bits of the digest of
    each class in it)."""
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    id_type = src.schema["_id"].dataType.simpleString()

    def batch_of(fragment, run, ids, slots, keys, sizes, grams, owners):
        values = [pa.array([fragment], pa.int64()), pa.array([run], pa.int64()), ids, *[pa.array([v], pa.binary()) for v in (slots, keys, sizes, grams, owners)]]
        return pa.RecordBatch.from_arrays(values, list(_RUN_COLUMNS))

    def cut(run: int, parts: list, slots: list[int], sets: dict[bytes, int], grams: list[np.ndarray]):
        ids = pa.concat_arrays(parts)
        sizes = np.array([len(g) for g in grams], "<u4")
        keys = b"".join(sets)
        yield batch_of(-1 - run, run, pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), np.array(slots, "<i4").tobytes(), keys, sizes.tobytes(), None, None)
        if not grams:
            return
        none = pa.nulls(1, pa.list_(ids.type))
        flat, owner = np.concatenate(grams), np.repeat(np.arange(len(grams), dtype="<u2"), sizes)
        low, tags = flat.astype("<u4"), np.frombuffer(keys, "<u8")[::2]
        flat >>= np.uint64(32)
        flat *= np.uint64(fragments)
        flat >>= np.uint64(32)
        part = flat.astype(np.uint16 if fragments <= 1 << 16 else np.uint32)
        del flat
        order = np.argsort(part, kind="stable")
        bounds = np.r_[0, np.cumsum(np.bincount(part, minlength=fragments))]
        for f in range(fragments):
            mine = order[bounds[f] : bounds[f + 1]]
            if len(mine):
                of = owner[mine]
                yield batch_of(f, run, none, None, tags[of[np.r_[True, of[1:] != of[:-1]]]].tobytes(), None, low[mine].tobytes(), of.tobytes())

    def run(batches):
        from pyspark import TaskContext

        hub_tokenizer.cache_clear()  # of packing or token files that this worker served before
        number = TaskContext.get().partitionId() << 32
        parts, slots, sets, grams, held = [], [], {}, [], 0
        for batch in batches:
            for first, texts in slices(batch, 1):
                parts.append(batch.column(0).take(pa.array(np.arange(first, first + len(texts)))))  # a slice would hold the texts
                for t in texts:
                    s = gram_set(t, n)
                    slot = -1
                    if len(s):
                        key = np.array(digest(s), "<i8").tobytes()
                        slot = sets.setdefault(key, len(sets))
                        if slot == len(grams):
                            grams.append(s)
                            held += len(s)
                    slots.append(slot)
                if held > FLUSH_GRAMS or len(slots) > FLUSH_DOCUMENTS:
                    yield from cut(number, parts, slots, sets, grams)
                    number += 1
                    parts, slots, sets, grams, held = [], [], {}, [], 0
        if parts:
            yield from cut(number, parts, slots, sets, grams)
        _forget_words()

    return map_arrow(src, run, f"fragment long, run long, ids array<{id_type}>, slots binary, keys binary, sizes binary, grams binary, owners binary")


def shared_in_fragment(pieces: pa.Table) -> pa.Table:
    """Of a fragment, per run: the places of classes that share n-grams there
    with another class (``owners``), and how many (``grams``).  Heads pass."""
    if pieces["fragment"][0].as_py() < 0:
        return pieces
    grams = [np.frombuffer(g.as_buffer(), "<u4") for g in pieces["grams"]]
    owners = [np.frombuffer(o.as_buffer(), "<u2") for o in pieces["owners"]]
    keys = [np.frombuffer(k.as_buffer(), "<u8") for k in pieces["keys"]]
    # Each n-gram with the number of its class, sorted: one after another with another class is shared.
    _, numbers = np.unique(np.concatenate(keys), return_inverse=True)
    ends = np.cumsum([len(k) for k in keys])
    held, at = np.empty(sum(map(len, grams)), np.uint64), 0
    for g, o, end, k in zip(grams, owners, ends, keys, strict=True):
        mine = held[at : at + len(g)]
        mine[:] = g
        mine <<= np.uint64(32)
        mine |= np.repeat(numbers[end - len(k) : end], np.diff(np.flatnonzero(np.r_[True, o[1:] != o[:-1], True]))).astype(np.uint64)
        at += len(g)
    held.sort()
    gram = (held >> np.uint64(32)).astype("<u4")
    several = np.unique(gram[1:][(gram[1:] == gram[:-1]) & (held[1:] != held[:-1])])
    del held, gram
    kept, counts = [], []
    for g, o in zip(grams, owners, strict=True):
        place = np.searchsorted(several, g)
        place[place == len(several)] = 0
        shared = several[place] == g if len(several) else np.zeros(len(g), bool)
        found, n = np.unique(o[shared], return_counts=True)
        kept.append(found.astype("<u2").tobytes())
        counts.append(n.astype("<u4").tobytes())
    out = {c: pa.nulls(len(pieces), pieces.schema.field(c).type) for c in _RUN_COLUMNS}
    out |= {"fragment": pieces["fragment"], "run": pieces["run"], "owners": pa.array(kept, pa.binary()), "grams": pa.array(counts, pa.binary())}
    return pa.table(out).filter(pa.array([len(k) > 0 for k in kept]))


def classes_of_runs(heads: DataFrame) -> DataFrame:
    """run, slot, s1, s2: the classes of each run."""

    def run(batches):
        for batch in batches:
            for r, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k = np.frombuffer(keys, "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), r)), pa.array(np.arange(len(k))), pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy())], ["run", "slot", "s1", "s2"])

    return map_arrow(heads.select("run", "keys"), run, "run long, slot long, s1 long, s2 long")


def likely_in_run(percent: int):
    """Of a run's head and the counts that fragments sent it: s1, s2 of the classes that can have a partner."""

    def run(key, heads: pa.Table, counts: pa.Table) -> pa.Table:
        head = heads.to_pylist()[0]
        sizes = np.frombuffer(head["sizes"], "<u4").astype(np.int64)
        shared = np.zeros(len(sizes), np.int64)
        for owners, n in zip(counts["owners"].to_pylist(), counts["grams"].to_pylist(), strict=True):
            shared[np.frombuffer(owners, "<u2")] += np.frombuffer(n, "<u4")
        k = np.frombuffer(head["keys"], "<i8").reshape(-1, 2)[100 * shared >= percent * sizes]
        return pa.table({"s1": k[:, 0].copy(), "s2": k[:, 1].copy()})

    return run


def documents_of_runs(heads: DataFrame) -> DataFrame:
    """_id, n, s1, s2 of the documents that have n-grams."""
    id_type = heads.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                slots, keys, sizes = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in ((1, "<i4"), (2, "<i8"), (3, "<u4")))
                has = np.flatnonzero(slots >= 0)
                of = slots[has]
                k = keys.reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values.take(pa.array(has)), pa.array(sizes[of].astype(np.int64)), pa.array(k[of, 0]), pa.array(k[of, 1])], ["_id", "n", "s1", "s2"])

    return map_arrow(heads.select("ids", "slots", "keys", "sizes"), run, f"_id {id_type}, n long, s1 long, s2 long")


def component_of_documents(key, heads: pa.Table, classes: pa.Table) -> pa.Table:
    """_id, n, component, class_size of a run's documents, from those of its classes."""
    head = heads.combine_chunks()
    ids = head["ids"].chunk(0)[0].values
    slots = np.frombuffer(head["slots"][0].as_py(), "<i4")
    sizes = np.frombuffer(head["sizes"][0].as_py(), "<u4").astype(np.int64)
    place = np.full(len(sizes) + 1, -1, np.int64)  # the last one for documents without n-grams
    place[classes["slot"].to_numpy()] = np.arange(len(classes))
    at, none = place[slots], slots < 0
    take = pa.array(np.where(none, 0, at), mask=none)
    component = pa.compute.if_else(pa.array(none), ids, classes["component"].combine_chunks().take(take))
    class_size = pa.compute.fill_null(classes["class_size"].combine_chunks().take(take), 1)
    return pa.table({"_id": ids, "n": np.where(none, 0, np.r_[sizes, 0][slots]), "component": component, "class_size": class_size})


def gram_rows(holders: DataFrame, n: int) -> DataFrame:
    """_class, n, grams (array of long) of classes, from rows _class, s1, s2, _t."""

    def run(batches):
        for batch in batches:
            for first, texts in slices(batch, 3):
                rows = []
                for i, t in enumerate(texts, first):
                    s = gram_set(t, n)
                    if len(s) and digest(s) == (batch.column(1)[i].as_py(), batch.column(2)[i].as_py()):  # else another text of that id
                        rows.append((batch.column(0)[i].as_py(), len(s), s.astype(np.int64)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["_class", "n", "grams"])
        _forget_words()

    return map_arrow(holders.select("_class", "s1", "s2", "_t"), run, "_class long, n long, grams array<long>").dropDuplicates(["_class"])


def segments(sets: DataFrame, parts: int = SEGMENTS) -> DataFrame:
    """_class, n, segment, before, grams: the class's n-grams of one fragment of
    the global order, in that order; ``before`` is the place of the first of
    them in the whole set, of which the n-grams of no other class come first."""
    rows = sets.select("_class", "n", F.explode("grams").alias("gram"))
    df = materialise(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "frequencies")
    free_shuffles(sets.sparkSession)
    place = F.col("df") + (F.col("gram") / F.lit(2.0**64) + 0.5)  # order: frequency, then n-gram
    pivots = df.agg(F.percentile_approx(place, [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    part = sum((F.when(place > p, 1).otherwise(0) for p in sorted(set(pivots))), F.lit(0))
    x = rows.join(df, "gram").select("_class", "n", part.alias("segment"), "df", "gram").repartition("_class")
    x = x.groupBy("_class", "n", "segment").agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "gram"))), lambda s: s["gram"]).alias("grams"))
    mine = Window.partitionBy("_class")
    total = F.sum(F.size("grams")).over(mine)
    earlier = F.coalesce(F.sum(F.size("grams")).over(mine.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return materialise(x.withColumn("before", F.col("n") - total + earlier), "segments")


def links(pairs: DataFrame, segs: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose overlap, summed over fragments, reaches the threshold."""
    a = segs.select(F.col("_class").alias("x"), F.col("n").alias("nx"), "segment", F.col("grams").alias("gx"))
    b = segs.select(F.col("_class").alias("y"), F.col("n").alias("ny"), "segment", F.col("grams").alias("gy"))
    partial = pairs.join(a, "x").join(b, ["y", "segment"]).select("x", "y", "nx", "ny", F.size(F.array_intersect("gx", "gy")).alias("part"))
    total = partial.groupBy("x", "y", "nx", "ny").agg(F.sum("part").alias("both"))
    return total.where(100 * F.col("both") >= percent * (F.col("nx") + F.col("ny") - F.col("both"))).select("x", "y")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable; minimum labels along edges, with pointer jumping."""
    both = materialise(edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    ends = both.select(F.col("x").alias("node")).distinct()
    labels = materialise(ends.withColumn("label", F.col("node")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("_near"))
        new = labels.join(near, "node").select("node", F.col("label").alias("_old"), F.least("label", "_near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("_jump"))
        new = new.join(jump, "label").select("node", "_old", F.least("label", "_jump").alias("label"))
        new = materialise(new, "labels")
        labels = new.select("node", "label")
        if new.where("label <> _old").isEmpty():
            return nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def class_components(segs: DataFrame, percent: int) -> DataFrame:
    """node, label over the classes of ``segs``: label is the smallest class linked, however indirectly."""
    spark = segs.sparkSession
    # Prefix: places 0 .. n - ceil(percent% of n) of the global order.
    last = f"(n - ({percent} * n + 99) div 100)"
    first_grams = F.expr(f"slice(grams, 1, cast(least(size(grams), {last} - before + 1) AS int))")
    prefix = segs.where(f"before <= {last}").select("_class", "n", "before", F.posexplode(first_grams).alias("_k", "gram"))
    alone = F.col("n") - F.col("n0")
    own = segs.groupBy("_class").agg(F.sum(F.size("grams")).alias("n0"))
    prefix = prefix.join(own, "_class").select("gram", "_class", "n", (F.col("before") + F.col("_k")).alias("place"), (1 - alone / F.col("n")).alias("central"))
    prefix = materialise(prefix, "prefixes")
    free_shuffles(spark)
    nodes = segs.select(F.col("_class").alias("node")).distinct()
    found = None
    labels = nodes.withColumn("label", F.col("node"))
    for _ in range(HUB_ROUNDS):
        at = prefix.join(labels.select(F.col("node").alias("_class"), "label"), "_class")
        # Per n-gram: its most central class, and the most central one of another component.
        hubs = at.groupBy("gram").agg(F.max_by("_class", "central").alias("h1"), F.max_by("label", "central").alias("l1"), F.count(F.lit(1)).alias("_m")).where("_m > 1")
        other = at.join(hubs, "gram").where("label <> l1").groupBy("gram").agg(F.max_by("_class", "central").alias("h2"))
        tried = at.join(hubs.join(other, "gram", "left"), "gram").select("_class", F.when(F.col("label") == F.col("l1"), F.col("h2")).otherwise(F.col("h1")).alias("hub"))
        votes = tried.where("hub IS NOT NULL AND hub <> _class").groupBy("_class", "hub").agg(F.count(F.lit(1)).alias("votes"))
        best = votes.groupBy(F.col("_class").alias("x")).agg(F.max_by("hub", "votes").alias("y"))
        new = materialise(links(best, segs, percent), "hub-links")
        found = new if found is None else found.unionByName(new)
        free_shuffles(spark)
        labels = materialise(components(nodes, found), "hub-components")
    at = materialise(prefix.join(labels.select(F.col("node").alias("_class"), "label"), "_class").drop("central"), "labelled-prefixes")
    free_shuffles(spark)
    sizes = at.groupBy("gram", "label").agg(F.count(F.lit(1)).alias("_m"))
    major = sizes.groupBy("gram").agg(F.max_by("label", "_m").alias("major"), F.count(F.lit(1)).alias("_l")).where("_l > 1").drop("_l")
    mixed = at.join(major, "gram")
    # With r of a class's n n-grams at or after the shared one, a partner of m has r >= percent * (n + m) / (100 + percent), on both sides.
    most = F.floor(((100 + percent) * (F.col("n") - F.col("place"))) / F.lit(percent)) - F.col("n")
    band = lambda size: F.floor(F.log(size) / F.lit(math.log(BAND)))
    low, high = F.ceil(F.col("n") * percent / F.lit(100)), F.least(most, F.floor(F.col("n") * F.lit(100) / percent))
    mixed = mixed.withColumn("most", most)
    outside = mixed.where("label <> major")
    tiles = outside.groupBy("gram").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE)).alias("_tiles"))
    a = outside.where(high >= low).join(tiles, "gram").withColumn("band", F.explode(F.sequence(band(low), band(high))))
    a = a.select("gram", "band", F.pmod(F.xxhash64("_class"), "_tiles").alias("tile"), F.col("_class").alias("a"), F.col("n").alias("na"), F.col("most").alias("ma"), F.col("label").alias("la"))
    b = mixed.join(tiles, "gram").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    b = b.select("gram", band(F.col("n")).alias("band"), "tile", F.col("_class").alias("b"), F.col("n").alias("nb"), F.col("most").alias("mb"), F.col("label").alias("lb"))
    fits = (F.col("la") != F.col("lb")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.col("nb") <= F.col("ma")) & (F.col("na") <= F.col("mb"))
    pairs = a.join(b, ["gram", "band", "tile"]).where(fits).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    rest = materialise(links(pairs, segs, percent), "cross-links")
    free_shuffles(spark)
    return components(nodes, found.unionByName(rest))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row per document: id, n_shingles, component_id, class_size (documents with an equal set)."""
    spark = docs.sparkSession
    ship_package(spark)
    with scratch_tables(spark) as drop_but:
        size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        fragments = max(8, math.ceil(size / BYTES_PER_GRAM / FRAGMENT_GRAMS))
        pieces = run_pieces(docs, id_col, text_col, n, fragments)
        counted = materialise(pieces.groupBy("fragment").applyInArrow(shared_in_fragment, pieces.schema), "runs")
        free_shuffles(spark)
        heads, counts = counted.where("fragment < 0"), counted.where("fragment >= 0").select("run", "owners", "grams")
        likely = heads.select("run", "keys", "sizes").groupBy("run").cogroup(counts.groupBy("run")).applyInArrow(likely_in_run(percent), "s1 long, s2 long").distinct()
        classes = documents_of_runs(heads).groupBy("s1", "s2").agg(F.min("_id").alias("_rep"), F.max("n").alias("n"), F.count(F.lit(1)).alias("class_size"))
        classes = materialise(classes, "classes")
        likely = materialise(classes.join(likely, ["s1", "s2"]).withColumn("_class", F.monotonically_increasing_id()), "likely-classes")
        texts, _ = told_apart(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")), "_id", likely, "_rep")
        holders = likely.join(texts, F.col("_rep").eqNullSafe(F.col("_id")))
        sets = materialise(gram_rows(holders, n), "gram-sets")
        free_shuffles(spark)
        segs = segments(sets)
        drop_but(counted, classes, likely, segs)
        labels = class_components(segs, percent)
        smallest = likely.join(labels, F.col("_class") == F.col("node")).select("s1", "s2", "_rep", "label")
        groups = smallest.groupBy("label").agg(F.min("_rep").alias("_component"))
        of_class = materialise(smallest.join(groups, "label").select("s1", "s2", "_component"), "class-components")
        drop_but(counted, classes, of_class)
    known = classes.join(of_class, ["s1", "s2"], "left").select("s1", "s2", F.coalesce("_component", "_rep").alias("component"), "class_size")
    by_run = classes_of_runs(heads).join(known, ["s1", "s2"]).select("run", "slot", "component", "class_size")
    id_type = classes.schema["_rep"].dataType.simpleString()
    heads = heads.select("run", "ids", "slots", "sizes")
    out = heads.groupBy("run").cogroup(by_run.groupBy("run")).applyInArrow(component_of_documents, f"_id {id_type}, n long, component {id_type}, class_size long")
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "class_size")
