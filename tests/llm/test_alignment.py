import hashlib
from collections import Counter

import odd
import public_tokenizers
import pytest
from feedloom.llm import alignment

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")


def brute_force(texts):
    """Whole texts by the libraries, each byte's tokens, every pair that shares a byte."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, decoders

    first = Tokenizer.from_file(A)
    first.no_truncation()
    first.no_padding()
    first.encode_special_tokens = True
    second = SentencePieceProcessor(model_file=B)
    to_bytes = {c: b for b, c in alignment.byte_letters().items()}
    assert isinstance(first.decoder, decoders.ByteLevel)
    rows = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        a_bytes = [bytes(to_bytes[c] for c in first.id_to_token(i)) for i in a]
        b_bytes = [
            bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()
            for i in b
        ]
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            rows.append(None)
            continue
        owner_a = [i for i, x in enumerate(a_bytes) for _ in x]
        owner_b = [i for i, x in enumerate(b_bytes) for _ in x]
        pairs = list(dict.fromkeys(zip(owner_a, owner_b)))
        groups, i, j = [], 0, 0
        for k in range(len(whole)):
            end = k + 1 == len(whole)
            if end or (owner_a[k] != owner_a[k + 1] and owner_b[k] != owner_b[k + 1]):
                groups.append((a[i : owner_a[k] + 1], b[j : owner_b[k] + 1]))
                i, j = owner_a[k] + 1, owner_b[k] + 1
        rows.append((a, b, groups, [(a[x], b[y]) for x, y in pairs]))
    counts = Counter(p for r in rows if r for p in set(r[3]))
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, "", 0, 0))
            continue
        a, b, groups, pairs = r
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        best = sum(counts[p] == most[p[0]] for p in pairs)
        out.append((len(a), len(b), len(groups), len(pairs), text, best, sum(counts[p] for p in pairs)))
    return out, counts


def texts():
    more = ["Plain words, and more.\nA line; another: end!\n", "docido$$$ CIÓN!! Жук, чай.", "x ▁ y", "▁", "a\0b \0, c", "<|endoftext|> </s>, <0x41>"]
    more += ["don't we'll, it's \r\n\t tab ", "  two  spaces ", "\n", "\n\n a", "1234 5678, 9"] + ["the cat, the dog."] * 3
    return odd.texts() + more


def rows_of(found):
    names = ("n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum")
    return sorted((r.doc_id, *(r[n] for n in names)) for r in found.collect())


@pytest.mark.parametrize("held, remembered", [(None, None), (0, None), (40, 5), (10**6, 5)])
def test_against_brute_force(spark, monkeypatch, held, remembered):
    if remembered:
        monkeypatch.setattr(alignment, "REMEMBERED", remembered)
    own = texts()
    want, _ = brute_force(own)
    df = spark.createDataFrame([(odd.BIG + i, t) for i, t in enumerate(own)], "doc_id long, text string")
    found = alignment.align(df.repartition(3), A, B, held_pairs=held)
    assert rows_of(found) == sorted((odd.BIG + i, *w) for i, w in enumerate(want))
    for r in found.collect():
        assert r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "")


def test_pairs_of_the_corpus(spark):
    """Only the counts of frequent pairs go to every task, and never more than asked for."""
    own = texts()
    _, counts = brute_force(own)
    df = spark.createDataFrame([(p, n) for p, n in enumerate(counts.values())], "pair long, n long")
    for held in (0, 1, 10, 200, 10**6):
        frequent, others = alignment._frequent(df, held)
        n = frequent.count()
        assert n <= held and n + others == len(counts)
        if n:
            least = min(r.n for r in frequent.collect())
            assert sum(c >= least for c in counts.values()) == n


def test_repeats_clashes_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b", 7, "x"), (1, "a b", 7, "x"), (None, None, 7, "x")], "doc_id long, text string, n_a int, `__rare` string")
    for held in (None, 0):
        rows = alignment.align(df, A, B, keep=("doc_id", "text", "n_a"), held_pairs=held).collect()
        assert sorted(map(str, (tuple(r[c] for c in ("doc_id", "text", "n_a", "n_best", "count_sum")) for r in rows))) == sorted(
            map(str, [(1, "a b", 2, 2, 4)] * 2 + [(None, None, 0, 0, 0)])
        )
        assert alignment.align(odd.empty(spark), A, B, held_pairs=held).collect() == []


def test_groups_and_links():
    assert alignment.cuts([1, 3, 6], [2, 3, 6]) == ([3, 6], [2, 3], [2, 3])
    assert alignment.links([1, 3], [2, 3], range(2), range(2)) == [(0, 0), (1, 0), (1, 1)]
    assert alignment.links([3], [1, 2, 3], range(1), range(3)) == [(0, 0), (0, 1), (0, 2)]
