"""Periodic runs, token alignment and language filters against brute force and held-out labels."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from revtriage.llm import alignment, language_id, periodic_runs, queries
from revtriage.llm.units import file_of

from .util import awkward_texts, frame


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_runs(words, least=12):
    out, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def brute_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone).decode()


def periodic_words(rng, n):
    letters = [b"a", b"b", b"c"][: rng.randrange(1, 4)]
    words = [rng.choice(letters) for _ in range(rng.randrange(1, 9))]
    while len(words) < n:
        kind = rng.random()
        if kind < 0.5:
            words = words * rng.randrange(1, 4) + words[: rng.randrange(len(words) + 1)]
        elif kind < 0.75:
            words = words + [rng.choice(letters) for _ in range(rng.randrange(1, 6))]
        else:
            words = [rng.choice(letters) for _ in range(rng.randrange(1, 6))] + words
    return words[: 2 * n]


def test_runs_are_all_runs():
    rng = random.Random(7)
    for _ in range(60):
        texts = [periodic_words(rng, rng.randrange(0, 160)) for _ in range(15)] + [[]]
        for words, runs in zip(texts, periodic_runs.word_runs(texts), strict=True):
            want = brute_runs(words)
            assert [tuple(r) for r in runs.tolist()] == want
            assert periodic_runs.collapsed(words, runs) == brute_collapsed(words, want)


def test_progressions_that_meet_inside_a_run():
    """The period is neither the distance of the progressions' starts nor of their ends."""
    words = [c.encode() for c in "ab" + "abababa" * 2 + "bababab"]
    assert [tuple(r) for r in periodic_runs.word_runs([words])[0].tolist()] == brute_runs(words)


def test_long_repetitive_texts_take_no_quadratic_time():
    for words, want in (([b"a"] * 200_000, [(0, 200_000, 1)]), ([str(i).encode() for i in range(1000)] * 200, [(0, 200_000, 1000)])):
        assert [tuple(r) for r in periodic_runs.word_runs([words])[0].tolist()] == want


def brute_planted(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    return words


def test_run_query_s_digests(spark, tmp_path):
    texts = awkward_texts(n=150)
    ids = [None, 5, 5, *range(100, 97 + len(texts))]
    frame(spark, texts, ids).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(map(tuple, queries.op11_periodic_runs(spark, str(tmp_path)).collect()))
    want = Counter()
    for i, t in zip(ids, texts, strict=True):
        words = brute_planted(i, t)
        runs = brute_runs(words) if len(words) < 1000 else [tuple(r) for r in periodic_runs.word_runs([words])[0].tolist()]
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want[(i, len(runs), *figures, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(brute_collapsed(words, runs)))] += 1
    assert got == want
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in ids if i is not None) > 5


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    hub = Tokenizer.from_file(file_of(alignment.MODEL_A))
    hub.encode_special_tokens = True
    return hub, sentencepiece.SentencePieceProcessor(model_file=file_of(alignment.MODEL_B)), alignment.Aligner(alignment.MODEL_A, alignment.MODEL_B)


def brute_alignment(text, libraries):
    """(A tokens, B tokens, groups, links) of a whole text."""
    hub, pieces, al = libraries
    if not text:
        return 0, 0, [], []
    a, b = hub.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
    data = (" " + text).encode()
    if b"".join(al.bytes_a[i] for i in a) != data or b"".join(al.bytes_b[i] for i in b) != data:
        return 0, 0, [], []
    end_a, end_b = (np.cumsum([len(spelled[i]) for i in ids]).tolist() for ids, spelled in ((a, al.bytes_a), (b, al.bytes_b)))
    groups, links, p, q = [], [], 0, 0
    for x, end in enumerate(end_a):
        if end in set(end_b):
            y = end_b.index(end)
            groups.append(f"{','.join(map(str, a[p : x + 1]))}|{','.join(map(str, b[q : y + 1]))}")
            links.append((a[x], b[y]))
            p, q = x + 1, y + 1
    return len(a), len(b), groups, links


ODD = ["a<|endoftext|> b  <|endoftext|>", "<s> </s> x", "a ▁b", "İ. Σ. 'S don'T", "a \x1c! \x85 b", " \n x", "x \n", "\x00a b", "<0x41> é 日本語 word"]


def test_alignment_query_is_the_libraries(spark, tmp_path, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 2000)  # several blocks a task
    texts = [t if t is None or len(t) < 5000 else t[:2000] for t in awkward_texts(n=80)] + ODD
    ids = [None, 5, 5, *range(100, 97 + len(texts))]
    frame(spark, texts, ids).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op12_cross_tokenizer_alignment(spark, str(tmp_path))
    assert sorted(out.columns) == sorted(["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
    of = {t: brute_alignment(t, libraries) for t in set(texts)}
    count = Counter(link for t in texts for link in of[t][3])
    top = {}
    for (_, b), n in count.items():
        top[b] = max(n, top.get(b, 0))
    want = Counter()
    for i, t in zip(ids, texts, strict=True):
        n_a, n_b, groups, links = of[t]
        digest = sha(";".join(groups)) if groups else ""
        want[(i, n_a, n_b, len(groups), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), digest)] += 1
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, out.select(*names).collect())) == want


def test_coalescing_and_overlaps():
    start_a, end_a = np.array([0, 2, 5, 6]), np.array([2, 5, 6, 9])
    start_b, end_b = np.array([0, 3, 6, 7]), np.array([3, 6, 7, 9])
    order, group = alignment.coalesce(np.r_[start_a, start_b], np.r_[end_a, end_b], np.repeat([0, 1], 4))
    of = dict(zip(order.tolist(), group.tolist(), strict=True))
    assert [of[k] for k in range(8)] == [0, 0, 0, 1, 0, 0, 1, 1]
    x, y = alignment.overlaps(start_a, end_a, start_b, end_b)
    want = [(i, j) for i in range(4) for j in range(4) if start_a[i] < end_b[j] and start_b[j] < end_a[i]]
    assert list(zip(x.tolist(), y.tolist(), strict=True)) == want


def test_alignment_of_an_empty_table(spark):
    rows, counts = alignment.align_documents(frame(spark, []))
    assert rows.count() == 0 and counts.count() == 0


VOICES = {"aa": "rivolen mati sorune kalp".split(), "bb": "schrund worteg hafst ölmig".split(), "cc": "żyta brzeg część łąka".split()}


def voices(seed=4, n=120):
    rng = random.Random(seed)
    labels = [rng.choice(sorted(VOICES)) for _ in range(n)]
    return labels, [" ".join("".join(rng.sample(VOICES[v], 2)) for _ in range(30)) for v in labels]


def test_languages_are_learned_from_documents_that_are_not_held_out(spark, tmp_path):
    labels, texts = voices()
    rows = [(i, t, v) for i, (t, v) in enumerate(zip(texts, labels, strict=True))]
    rows = [(i, t, v if zlib.crc32(str(i).encode()) % 4 != 2 else "zz") for i, t, v in rows]  # held-out labels must not be seen
    odd = [(None, texts[0], labels[0]), (1000, None, "aa"), (1001, "", None), (1002, "12 + 3 = 15!", "bb"), (1003, texts[1].upper(), None), (1003, texts[1].upper(), None), (1004, "語" * 50_000, None)]
    spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op13_language_filters(spark, str(tmp_path)).collect()
    assert len(out) == len(rows) + len(odd)
    found = {r["doc_id"]: r for r in out}
    for i, v in enumerate(labels):
        assert found[i]["lang_pred"] == v and found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert all(0 <= r["score"] <= 1 for r in out)
    assert all((found[i]["lang_pred"], found[i]["score"]) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert found[1003]["lang_pred"] == labels[1] and not found[None]["held_out"] and found[1004]["lang_pred"] in VOICES


def test_predictions_without_labels_and_on_an_empty_table(spark):
    docs = frame(spark, ["some text", None])
    unlabelled = docs.withColumn("lang", docs["source"])
    assert {r["lang_pred"] for r in language_id.identify_languages(unlabelled).collect()} == {"und"}
    assert language_id.identify_languages(frame(spark, [])).count() == 0


def test_filters_hold_every_ngram_of_many_languages():
    """No n-gram of a language is missed, in every word of the bitmask; the false-positive rate is as predicted."""
    rng = np.random.default_rng(3)
    members = [rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) for _ in range(70)]
    masks = np.zeros((2, language_id.SLOTS), np.uint64)
    for i, hashes in enumerate(members):
        for shift in language_id.SHIFTS:
            np.bitwise_or.at(masks[i // 64], (hashes >> np.uint64(shift)) & np.uint64(language_id.SLOTS - 1), np.uint64(1 << i % 64))
    filters = language_id.LanguageFilters.of(tuple(f"l{i:02d}" for i in range(70)), masks)
    for i in (0, 63, 64, 69):
        assert (filters.contained(members[i])[i // 64] >> np.uint64(i % 64) & np.uint64(1)).all()
    foreign = rng.integers(0, 1 << 63, 2_000_000, dtype=np.uint64)
    by_chance = (filters.contained(foreign)[1] >> np.uint64(3) & np.uint64(1)).mean()
    assert abs(by_chance - filters.chance[67]) < 5e-5


def test_grams_are_those_of_each_word_with_its_spaces():
    words = ["ab", "ç", "日本語"]
    hashes, owner = language_id.grams(words)
    for k, w in enumerate(words):
        alone, _ = language_id.grams([w])
        assert sorted(hashes[owner == k].tolist()) == sorted(alone.tolist())
        padded = f" {w} "
        assert len(alone) == sum(max(0, len(padded) - n + 1) for n in language_id.SIZES) - 2
