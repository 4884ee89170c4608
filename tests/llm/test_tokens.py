import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import odd
from feedloom.llm import bpe, packing, tokens

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def tokenizer(path):
    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def test_counts_as_the_library(spark):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=PIECES)
    rows = tokens.token_counts(odd.documents(spark), PIECES, keep=("doc_id", "text", "n_tokens", "odd name.x")).collect()
    assert len(rows) == len(odd.texts()) + 4
    for r in rows:
        assert r.n_tokens == len(model.encode(r.text or ""))
        assert r.n_bytes == len((r.text or "").encode())
        assert r["odd name.x"] == 1
    assert odd.BIG in {r.doc_id for r in rows}


def test_pieces_of_long_runs():
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=PIECES)
    texts = [" " * k for k in range(70)] + ["x" + " " * k + end for k in range(70) for end in ("the", "漢", "")]
    texts += ["a" * 3000, "ab" * 2000, "▁" * 50 + "x", "!" * 999]
    assert tokens.merger(PIECES).counts(texts) == [len(model.encode(t)) for t in texts]


def test_memo_forgets_without_harm():
    model = tokens.PieceMerger(PIECES)
    model.memo.size = 3
    texts = [f"word{i} other{i % 7} the" for i in range(50)]
    assert model.counts(texts) == tokens.merger(PIECES).counts(texts)
    assert [model.counts([t])[0] for t in texts] == tokens.merger(PIECES).counts(texts)


def test_round_trip_as_the_library(spark):
    library = tokenizer(BYTES)
    rows = bpe.round_trip(odd.documents(spark), BYTES, keep=("doc_id", "text")).collect()
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_encode_then_decode(spark):
    docs = odd.documents(spark)
    encoded = bpe.encode(docs, BYTES, keep=("doc_id", "text"))
    back = bpe.decode(encoded, BYTES, keep=("text", "n_tokens", "ids"))
    for r in back.collect():
        assert r.decoded == (r.text or "") and r.n_tokens == len(r.ids)
    odd_ids = spark.createDataFrame([(1, None), (2, []), (3, [None, 262])], "doc_id long, ids array<int>")
    assert [r.decoded for r in bpe.decode(odd_ids, BYTES).collect()] == ["", "", bpe.codec(BYTES).strings[262].decode()]


def test_every_white_space(spark):
    """Of all code points, alone and between letters."""
    library, model = tokenizer(BYTES), bpe.codec(BYTES)
    points = [chr(c) for c in [*range(0x300), *range(0x1680, 0x1682), *range(0x2000, 0x2070), 0x3000, 0xFEFF]]
    texts = [f"a{c}{c}b {c} {c}c" for c in points]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in model.encode(texts)] == want


def test_pack(spark):
    library = tokenizer(WORDS)
    docs = odd.documents(spark)
    want = defaultdict(int)
    for r in docs.collect():
        want[r.doc_id, tuple([*library.encode(r.text or "", add_special_tokens=False).ids, 2])] += 1
    rows = packing.pack(docs, WORDS, size=64).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    pieces = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.sequence_id):
        assert r.length == len(r.ids) == 1 << r.bucket and r.offset == 0 and r.length <= 64
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces[r.doc_id].append(r)
    got = defaultdict(int)
    for doc_id, own in pieces.items():
        at = 0
        while at < len(own):
            n, ids = own[at].doc_tokens, []
            while len(ids) < n:
                assert own[at].start == len(ids)
                ids += own[at].ids
                at += 1
            got[doc_id, tuple(ids)] += 1
    assert got == want


def test_piece_lengths():
    for n in range(0, 300):
        found = packing.piece_lengths(n, 32)
        assert sum(found) == n and found == sorted(found, reverse=True)
        assert len([x for x in found if x < 32]) == len({x for x in found if x < 32})


def test_empty_tables(spark):
    none = odd.empty(spark)
    assert tokens.token_counts(none, PIECES).collect() == []
    assert bpe.round_trip(none, BYTES).collect() == []
    assert packing.pack(none, WORDS).collect() == []
