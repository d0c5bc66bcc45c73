"""Token operators against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from revtriage.llm import dac, packing, sentencepiece_encode, token_counts
from revtriage.llm.common import scratch
from revtriage.llm.units import HubTokenizer, Memo, file_of

from .util import awkward_texts, frame

HUB = ("word_bpe_49k.json", "byte_bpe_50k.json")
PIECE = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=file_of(PIECE))


@pytest.mark.parametrize("name", HUB)
def test_units_give_the_library_s_ids(name):
    tok = HubTokenizer(name)
    tok.words.cap = tok.rest.cap = 20
    texts = awkward_texts(n=300) + ["a<|endoftext|> b  <|endoftext|>", "İ. Σ. ΑΣ, é. 'S don'T", "a \x1c! \x85 b"]
    for _ in range(2):
        got = [np.frombuffer(b, "<u4").tolist() for b in tok.encode(texts)]
        assert got == [tok.lib.encode(t, add_special_tokens=False).ids if t else [] for t in texts]


def test_counts_are_the_library_s(pieces):
    texts = awkward_texts(n=200) + ["ab" * 3000 + "é", "日" * 400, "<s> </s> ▁x ▁"]
    memo = Memo(token_counts.RankMerger(file_of(PIECE)).counts, cap=50)
    assert token_counts.count_texts(texts, memo) == [len(pieces.encode(t)) if t else 0 for t in texts]


def test_token_counts_table(spark, pieces):
    texts = awkward_texts()
    out = token_counts.token_counts(frame(spark, texts), limit=50).collect()
    want = {(i, len((t or "").encode()), n, n > 50) for i, t in enumerate(texts) for n in [len(pieces.encode(t)) if t else 0]}
    assert {tuple(r) for r in out} == want and len(out) == len(texts)


def test_spans_and_ids_are_the_library_s(pieces):
    enc = sentencepiece_encode.SpanEncoder(file_of(PIECE))
    texts = awkward_texts(n=100)
    for t, ids in zip(texts, enc.ids(texts), strict=True):
        assert ids.tolist() == (pieces.encode(t) if t else [])
        spans = enc.spans(t, ids)
        if t:
            proto = pieces.encode(t, return_type="proto")
            for p, (begin, end) in zip(proto.pieces, spans.tolist(), strict=True):
                if not p.piece.startswith("<0x"):
                    assert (p.begin, p.end) == (begin, end)


def test_long_units_merge_as_short_ones(pieces):
    merger = token_counts.RankMerger(file_of(PIECE))
    rng = random.Random(5)
    units = ["x" * 700, "É日本x1" * 80, *["".join(rng.choice("aeioutnrshl") for _ in range(n)) for n in (3, 40, 255, 256, 257, 900)]]
    together = merger._merge_together(units).tolist()
    assert together == [merger._merge_one(u) for u in units] == merger.counts(units) == [len(pieces.encode(u)) for u in units]


def test_character_map_is_the_library_s():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    lib = sentencepiece.SentencePieceNormalizer(rule_name="nfkc", add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
    model = pb.ModelProto()
    model.ParseFromString(lib.serialized_model_proto())
    chars = sentencepiece_encode.CharMap(model.normalizer_spec.precompiled_charsmap)
    for t in [*awkward_texts(n=20), "ﬁne ㌔ ①② Ａｂｃ が é ½"]:
        if t:
            data, spans = chars.normalise(t.encode())
            assert data.decode() == lib.normalize(t) and len(spans) == len(data)
            assert all(a <= b for a, b in spans)
    data, spans = chars.normalise("a①b".encode())
    assert data == b"a1b" and spans.tolist() == [[0, 1], [1, 4], [4, 5]]


def test_encode_decode_table(spark, pieces):
    texts = awkward_texts()
    out = sentencepiece_encode.span_digest(sentencepiece_encode.encode_with_spans(frame(spark, texts))).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(out) == len(texts)
    for r in out:
        ids = pieces.encode(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(pieces.decode(ids) if ids else ""))


@pytest.mark.parametrize("top", [1, 200, 70_000, 1 << 31])
def test_dac_random_access(spark, tmp_path, top):
    rng = np.random.default_rng(top)
    ids = rng.integers(0, top, 3000, dtype=np.uint64).astype("<u4")
    (tmp_path / "a.dac").write_bytes(dac.encode_file([3, None], np.array([0, 3000]), ids))
    f = dac.DacFile(f"file://{tmp_path}/a.dac")
    f.check()
    assert (f.ids() == ids).all()
    assert [f.get(i) for i in range(0, 3000, 7)] == ids[::7].tolist()
    docs, starts = f.documents()
    assert docs == [3, None] and starts.tolist() == [0, 0, 3000]
    with pytest.raises(IndexError):
        f.get(3000)


def test_token_files_round_trip(spark, monkeypatch):
    texts = awkward_texts()
    ids = [None if i == 4 else 1000 - i for i in range(len(texts))]
    manifest = dac.write_token_files(frame(spark, texts, ids), scratch(spark, "t"), HUB[0])
    out = sorted(dac.read_token_files(manifest).collect(), key=lambda r: r["start"])
    tok = HubTokenizer(HUB[0])
    order = sorted(range(len(texts)), key=lambda i: (ids[i] is not None, ids[i] or 0))
    at = 0
    for r, i in zip(out, order, strict=True):
        want = (tok.lib.encode(texts[i], add_special_tokens=False).ids if texts[i] else []) + [1]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (ids[i], at, len(want))
        assert np.frombuffer(r["ids"], "<u4").tolist() == want
        at += len(want)


def test_packing(spark):
    texts = awkward_texts()
    df = frame(spark, texts)
    table = packing.pieces(df, limit=64, with_ids=True)
    out = packing.pack(packing.materialise(table, "t"), limit=64, open_bins=4).collect()
    tok = HubTokenizer(HUB[1])
    want = [(tok.lib.encode(t, add_special_tokens=False).ids if t else []) + [2] for t in texts]
    bins = {}
    for r in out:
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert r["length"] == 64 or r["piece"] == 0
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(r["length"] for r in out) == sum(map(len, want))
    joined = packing.sequences(spark.createDataFrame(out), packing.materialise(table, "t")).collect()
    assert sum(len(r["ids"]) // 4 for r in joined) == sum(map(len, want))


def test_open_bins_against_plain_search():
    rng = np.random.default_rng(1)
    bins, plain, made = packing.OpenBins(100, 5), {}, 0
    for n in rng.integers(1, 101, 2000).tolist():
        chosen, offset = bins.place(n)
        fits = [f for f in plain.values() if f >= n]
        if fits:
            assert plain[chosen] == min(fits)
        else:
            if len(plain) >= 5:
                del plain[_closed(plain, bins)]
            assert chosen == made
            made += 1
            plain[chosen] = 100
        assert offset == 100 - plain[chosen]
        plain[chosen] -= n
        if not plain[chosen]:
            del plain[chosen]
        assert len(plain) <= 5


def _closed(plain, bins):
    """The bin that the operator closed; it must be among the fullest."""
    still = {b for free in bins.by_free for b in free}
    (gone,) = [b for b in plain if b not in still]
    assert plain[gone] == min(plain.values())
    return gone


def test_packing_of_many_long_pieces_in_one_task(spark):
    table = spark.range(60_000).selectExpr("id AS doc_id", "0 AS piece", "1 + pmod(xxhash64(id), 1024) AS length")
    out = packing.pack(packing.materialise(table, "many"))
    pieces, total, made, over = out.selectExpr("count(*)", "sum(length)", "count(DISTINCT sequence_id)", "sum(int(offset + length > 1024))").first()
    assert (pieces, over) == (60_000, 0)
    assert made <= 1.01 * -(-total // 1024)


@pytest.mark.parametrize("run", [token_counts.token_counts, sentencepiece_encode.encode_with_spans, packing.best_fit_packing])
def test_empty_tables(spark, run):
    assert run(frame(spark, [])).count() == 0


def test_empty_token_files(spark):
    assert dac.token_files(spark, frame(spark, [])).count() == 0


def test_words_asked_once_are_not_kept_for_long():
    tok = HubTokenizer("byte_bpe_50k.json")
    letters = "abcdefghijklmnop"
    for k in range(12):
        words = ["".join(letters[(i >> s) & 15] for s in (0, 4, 8, 12)) + letters[k] * 3 for i in range(25_000)]
        assert tok.encode([" ".join(words)]) == tok.encode([" ".join(words)])
    assert len(tok.words.new) + len(tok.words.old) < 260_000
