"""N-gram join, WARC packages and the pipeline against brute force."""

import hashlib
import io
import math
import random
import re
import tracemalloc
import zipfile
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from revtriage.llm import ngram_join, warc_zip
from revtriage.llm.common import scratch

from .util import awkward_texts, frame

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, n=5):
    w = WORD.findall((text or "").encode().lower())
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(texts, percent=75):
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                label[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_copies(rng, n_groups=6, size=9):
    vocabulary = [f"w{i}" for i in range(400)]
    texts, passage = [], [rng.choice(vocabulary) for _ in range(30)]
    for _ in range(n_groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(12, 120))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy + passage * rng.randrange(2)))
    for _ in range(25):
        texts.append(" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randrange(1, 14))]))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_brute_force(spark, seed):
    texts = near_copies(random.Random(seed)) + awkward_texts()[:25]
    out = ngram_join.jaccard_components(frame(spark, texts)).collect()
    want = brute_components(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == dict(enumerate(want)) and len(out) == len(texts)


def test_components_over_many_runs_and_fragments(spark, monkeypatch):
    """Classes spread over many runs, pieces of a few n-grams, and tiles of two classes give the same components."""
    for name, value in (("FLUSH_DOCUMENTS", 7), ("FRAGMENT_GRAMS", 200), ("TILE", 2)):
        monkeypatch.setattr(ngram_join, name, value)
    texts = near_copies(random.Random(8), 5, 6) + awkward_texts()[:20] * 2
    out = ngram_join.jaccard_components(frame(spark, texts).repartition(4)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == dict(enumerate(brute_components(texts)))
    sets = [shingles(t) for t in texts]
    assert all(r["class_size"] == (sets.count(sets[r["doc_id"]]) if sets[r["doc_id"]] else 1) for r in out)


def test_classes_that_share_a_passage_but_are_unlike_form_no_pairs(spark):
    """The band of sizes keeps them apart before any pair is made."""
    passage = " ".join(f"p{i}" for i in range(100))
    texts = [passage + " " + " ".join(f"d{k}x{i}" for i in range(20)) for k in range(300)]
    classes = [ngram_join.gram_set(t) for t in texts]
    n, place = len(classes[0]), 20
    most = (100 + 75) * (n - place) // 75 - n
    assert most < n and int(math.log(most) / math.log(ngram_join.BAND)) < int(math.log(n) / math.log(ngram_join.BAND))
    out = ngram_join.jaccard_components(frame(spark, texts, extra=False)).collect()
    assert all(r["component_id"] == r["doc_id"] for r in out)


def test_ids_that_are_texts(spark):
    t = "one two three four five six seven"
    df = spark.createDataFrame([("b", t), ("a", t + " eight"), (None, "x")], "doc_id string, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(df, percent=70).collect()}
    assert got == {"b": "a", "a": "a", None: None}


def test_repeated_and_null_ids(spark):
    t = "one two three four five six seven"
    out = ngram_join.jaccard_components(frame(spark, [t, t.upper(), None, "", "a b", "A b"], ids=[9, None, 3, 3, 4, 4])).collect()
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=repr)
    assert got == sorted([(9, 3, 9), (None, 3, 9), (3, 0, 3), (3, 0, 3), (4, 1, 4), (4, 1, 4)], key=repr)


def test_empty_join(spark):
    assert ngram_join.jaccard_components(frame(spark, [])).count() == 0
    assert ngram_join.jaccard_components(frame(spark, [None, ""])).count() == 2


# --- WARC ------------------------------------------------------------------


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_is_read_by_both_sides(zip64):
    members = [("a/b.bin", b"0123456789" * 50), ("empty", b""), ("ü.txt", b"x")]
    data = warc_zip.zip_package(members, zip64)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and [(n, z.read(n)) for n in z.namelist()] == members
    package = warc_zip.ZipPackage(pa.BufferReader(data))
    assert {n: package.read(n) for n in package.members} == dict(members)
    assert package.read("a/b.bin", 5, 7) == b"5678901"
    with pytest.raises(ValueError):
        package.read("a/b.bin", 499, 2)


def test_foreign_zip_with_comment():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        z.writestr("x", b"data")
        z.writestr(zipfile.ZipInfo("packed"), b"data" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 in a comment"
    package = warc_zip.ZipPackage(pa.BufferReader(raw.getvalue()))
    assert package.read("x") == b"data"
    with pytest.raises(ValueError):
        package.locate("packed")
    with pytest.raises(ValueError):
        warc_zip.ZipPackage(pa.BufferReader(b"no archive"))


def test_warc_round_trip(spark):
    big, other = "é" * 600, "y" * 1000
    pages = [(1, "http://a", big), (2, None, big), (3, "u\r\nX: y", None), (4, "u", "small"), (5, "u", "small"), (6, "u", other), (9, "u", big), (9, "u", big), (7, "u", "y" * 999), (8, "u", "y" * 999)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("_id", F.lit(1)).withColumn("_sha", F.lit(1))
    out = warc_zip.read_packages(warc_zip.write_packages(df, scratch(spark, "w"))).collect()
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or 0, bytes(r["payload"])) for r in out)
    want = []
    for page, _, html in pages:
        body = (html or "").encode()
        revisit = html == big and page != 9
        want.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", 9 if revisit else 0, b"" if revisit else body))
    want[7] = (9, 1200, want[7][2], "revisit", 9, b"")  # the repeated row
    assert got == sorted(want)
    assert warc_zip.warc_round_trip(spark, df.limit(0)).count() == 0


def test_one_response_of_repeated_rows_in_many_files(spark, tmp_path):
    big = "z" * 1500
    for k in range(6):
        spark.createDataFrame([(5, f"u{k}", big)], "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
    out = warc_zip.warc_round_trip(spark, spark.read.parquet(str(tmp_path / "p"))).collect()
    assert sorted((r["record_type"], r["refers_to"]) for r in out if r["record_type"] == "revisit") == [("revisit", 5)] * 5 and len(out) == 6


def test_equal_payloads_of_null_ids(spark):
    big, other = "z" * 1500, "y" * 1500
    rows = [(None, "a", big), (None, "b", big), (None, "c", big), (None, "d", other), (3, "e", other)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    found = warc_zip.warc_round_trip(spark, df).collect()
    digest = hashlib.sha1(big.encode()).hexdigest()
    of_big = [(r["record_type"], r["refers_to"]) for r in found if r["payload_digest"] == digest]
    assert sorted(of_big, key=repr) == [("response", None), ("revisit", None), ("revisit", None)]
    of_other = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in found if r["payload_digest"] != digest}
    assert of_other == {3: ("response", None), None: ("revisit", 3)}


# --- pipeline --------------------------------------------------------------


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    rng = random.Random(5)
    texts = near_copies(rng, 3, 4) + [None, "", "short", "spam " * 60, "buy### now***$$$ " * 30]
    texts += [texts[0].upper(), texts[1], " ".join(f"v{i}" for i in range(40)) + " mail bob@x.example.com"]
    df = frame(spark, texts, extra=False)
    docs, kept = df, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, ""), "t")
        assert docs.columns == df.columns, name
        kept.append(sorted(r["doc_id"] for r in docs.collect()))
    from revtriage.llm.quality import judge_quality

    good = sorted(r["doc_id"] for r in judge_quality(df).where("kept").collect())
    assert kept[0] == good and not {len(texts) - 8, len(texts) - 7, len(texts) - 6, len(texts) - 5} & set(good)
    last = {}
    for i in good:
        last[texts[i].lower()] = i
    assert kept[1] == sorted(last.values())
    parts = brute_components([texts[i] for i in kept[1]])
    assert len(kept[2]) == len({c for _, c in parts})
    assert {parts[kept[1].index(i)][1] for i in kept[2]} == {c for _, c in parts}
    assert kept[3] == kept[2]
    assert not docs.where(F.col("text").contains("bob@x")).count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert sorted({r["doc_id"] for r in packed}) == kept[3]


def test_pipeline_on_repeated_rows_null_ids_and_other_columns(spark):
    import corpus_pipeline

    rng = random.Random(9)
    prose = [" ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(3, 8))) for _ in range(40)) for _ in range(4)]
    texts = [prose[0], prose[0], prose[0], prose[1], prose[1] + " more", None, prose[2], prose[3]]
    ids = [7, 7, None, None, None, None, 9, 9]
    df = frame(spark, texts, ids).repartition(3)
    docs = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, ""), "t")
        assert docs.dtypes == df.dtypes
    assert sorted(r["text"].lower()[:30] for r in docs.collect()) == sorted(p[:30] for p in prose)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 4


def test_run_removes_what_its_stages_wrote(spark, tmp_path):
    import os

    import corpus_pipeline

    texts = near_copies(random.Random(5), 2, 3)
    frame(spark, texts, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    base = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(f"{base}/llm")) if os.path.isdir(f"{base}/llm") else set()
    n = corpus_pipeline.run(spark, str(tmp_path)).count()
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(f"{base}/llm")) - before}
    assert n > 0 and left == {name.replace(" ", "-") for name, _ in corpus_pipeline.STAGES[:-1]} | {"pieces"}


def test_pipeline_on_an_empty_table(spark):
    import corpus_pipeline

    docs = frame(spark, [], extra=False)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_texts_of_kept_rows_are_not_moved(spark):
    """Where few rows go, the others stay in the order of the table; a join of all of them deals them out anew."""
    import corpus_pipeline

    rng = random.Random(3)
    prose = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randrange(1, 9) for _ in range(30)) for _ in range(300)]
    df = frame(spark, prose + prose[:5]).coalesce(1)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for stage in (corpus_pipeline.exact_duplicates, corpus_pipeline.near_duplicates):
            found = stage(spark, df, "")
            got = [r["doc_id"] for r in found.collect()]
            assert found.columns == df.columns and len(got) == len(set(got)) == 300
            assert got == sorted(got)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("words", [1 << 18, 1])
def test_rows_are_kept_whether_few_or_most_go(spark, monkeypatch, words):
    import corpus_pipeline

    from revtriage.llm import common

    monkeypatch.setattr(common, "BITMAP_WORDS", words)
    numbers = list(range(500))
    df = frame(spark, [f"t{i}" for i in numbers]).repartition(5)
    for share in (0, 3, 40, 97, 100):
        found = corpus_pipeline._kept_by(df, lambda rows, row, share=share: rows.select(row, (F.col("doc_id") % 100 < share).alias("kept")))
        assert sorted(r["doc_id"] for r in found.collect()) == [i for i in numbers if i % 100 < share]


def _fragment(rng, runs, n, n_grams, n_classes):
    """Pieces of one fragment, as runs send them, and their (class, n-gram) by run."""
    rows, plain = [], []
    for run in range(runs):
        owner = np.unique(rng.integers(0, n // 20 + 1, n), return_inverse=True)[1]
        owner.sort()
        keys, grams = rng.choice(n_classes, owner[-1] + 1, replace=False).astype("<u8"), rng.integers(0, n_grams, n).astype("<u4")
        rows.append({"fragment": 0, "run": run, "keys": keys.tobytes(), "grams": grams.tobytes(), "owners": owner.astype("<u2").tobytes()})
        plain.append(list(zip(owner.tolist(), keys[owner].tolist(), grams.tolist(), strict=True)))
    schema = pa.schema([(c, pa.int64() if c in ("fragment", "run") else pa.list_(pa.int64()) if c == "ids" else pa.binary()) for c in ngram_join._RUN_COLUMNS])
    return pa.Table.from_pylist(rows, schema=schema), plain


@pytest.mark.parametrize("runs, n, n_grams, n_classes", [(1, 30, 5, 40), (3, 200, 300, 60), (4, 50, 2**32 - 1, 90), (5, 1, 2, 3)])
def test_shared_in_fragment_against_plain_counts(runs, n, n_grams, n_classes):
    table, plain = _fragment(np.random.default_rng(5), runs, n, n_grams, n_classes)
    holders = {}
    for key, gram in ((k, g) for p in plain for _, k, g in p):
        holders.setdefault(gram, set()).add(key)
    want = {}
    for run, p in enumerate(plain):
        for slot, _, gram in p:
            if len(holders[gram]) > 1:
                want.setdefault(run, Counter())[slot] += 1
    got = {}
    for r in ngram_join.shared_in_fragment(table).to_pylist():
        got[r["run"]] = dict(zip(np.frombuffer(r["owners"], "<u2").tolist(), np.frombuffer(r["grams"], "<u4").tolist(), strict=True))
    assert got == want


def test_fragment_takes_few_bytes_per_gram():
    table, _ = _fragment(np.random.default_rng(6), 10, 40_000, 10**7, 10**5)
    ngram_join.shared_in_fragment(table.slice(0, 1))
    tracemalloc.start()
    ngram_join.shared_in_fragment(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * 400_000
