"""Packing without padding: documents cut into pieces of power-of-two length."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from feedloom.llm.common import Memo, map_arrow

#: Words that a memo holds at least where it lasts for one task only.
SMALL_MEMO = 60_000
#: Words that the library encodes in one call.
GROUP = 64
#: A word of plain Latin letters and marks after it: two tokens of the pre-tokenizer, in
#: any case and in normal form already.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|%$&*#]*)").fullmatch
#: What ``str.split`` takes for white space and the vocabulary does not.
_ODD = re.compile("[\x1c-\x1f]")
_RUN = re.compile("[^\t-\r ]+")


class Words:
    """Ids of texts by a tokenizer that drops white space and lowers the case.

    Words are encoded by the library, equal words once. Letters of plain words go to it in
    groups, lowered, with the normaliser and splitter off: they have nothing left to do.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.letters = Tokenizer.from_file(path)
        self.letters.no_truncation()
        self.letters.no_padding()
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.Split(" ", "removed"),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ]
        )
        suffix = self.whole.model.end_of_word_suffix
        vocab = self.whole.get_vocab(with_added_tokens=True)
        self.last = np.zeros(1 + max(vocab.values()), bool)
        self.last[[i for w, i in vocab.items() if w.endswith(suffix)]] = True
        self.plain = Memo(self.encode_plain, 250_000)
        self.marks = Memo(self.encode_whole, 50_000)
        self.memo = Memo(self.encode_words, 250_000)

    def encode_plain(self, words: list[str]) -> list[bytes]:
        """Ids of words of lower-case letters; a word's last token has the end-of-word mark."""
        out: list[bytes] = []
        lines = [" ".join(words[k : k + GROUP]) for k in range(0, len(words), GROUP)]
        for e in self.letters.encode_batch_fast(lines, add_special_tokens=False):
            ids = np.array(e.ids, "<u4")
            ends = (4 * (1 + np.flatnonzero(self.last[ids]))).tolist()
            packed = ids.tobytes()
            out += [packed[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        out: list = [None] * len(words)
        plain, other = [], []
        for k, word in enumerate(words):
            m = _PLAIN(word)
            if m:
                plain.append((k, m[1].lower(), m[2]))
            else:
                other.append(k)
        ids = self.plain.values([[w for _, w, _ in plain]])[0]
        marks = self.marks.values([[m for _, _, m in plain]])[0]
        for (k, _, _), x, mark in zip(plain, ids, marks):
            out[k] = x + mark
        texts = [words[k] for k in other]
        for k, x in zip(other, self.encode_whole(texts)):
            out[k] = x
        return out

    def encode_whole(self, words: list[str]) -> list[bytes]:
        found = self.whole.encode_batch_fast(words, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        cut = [_RUN.findall(t) if _ODD.search(t) else t.split() for t in texts]
        return [b"".join(found) for found in self.memo.values(cut)]


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are parallel already
    return Words(path)


def piece_lengths(n: int, largest: int) -> list[int]:
    """Pieces of a document of ``n`` ids: as many of the largest length as fit, then the
    powers of two of what is left, the longest first."""
    rest = n % largest
    return [largest] * (n // largest) + [1 << b for b in range(largest.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(
    df: DataFrame,
    path: str,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    size: int = 4096,
    end_id: int | None = 2,
    with_ids: bool = True,
    at_once: int = 2000,
    lasting: bool = True,
) -> DataFrame:
    """One row per piece: kept columns, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``bucket`` (its length's logarithm), ``ids``, ``sequence_id`` and ``offset``.

    A document's ids (and ``end_id`` after them) are cut into pieces whose lengths are powers
    of two up to ``size``, itself one; each piece is a sequence of its own, so none
    crosses documents and none is padded. Batches are drawn from one bucket at a time.
    A NULL or empty text is a document of ``end_id`` alone, or without one has no piece.
    Repeated rows are documents of their own; kept columns named as an output give way.
    ``sequence_id`` numbers the rows within their input split; it is the same in each run
    over the same files. ``at_once`` documents are worked on together: fewer take less memory;
    what a worker has learnt outlives a task unless ``lasting`` is False.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    tail = b"" if end_id is None else end_id.to_bytes(4, "little")

    def rows(batches: Iterator[list]):
        model = words(path)
        if not lasting:
            model.plain.size = model.memo.size = SMALL_MEMO
        for texts, first in ((t.slice(k, at_once), k) for (t,) in batches for k in range(0, len(t), at_once)):
            origin, start, length, crc, total, ids = [], [], [], [], [], []
            for k, packed in enumerate(model.encode([t or "" for t in texts.to_pylist()]), first):
                packed += tail
                at, n = 0, len(packed) // 4
                for piece in piece_lengths(n, size):
                    own = packed[4 * at : 4 * (at + piece)]
                    origin.append(k)
                    start.append(at)
                    length.append(piece)
                    crc.append(zlib.crc32(own))
                    total.append(n)
                    if with_ids:
                        ids.append(np.frombuffer(own, "<i4"))
                    at += piece
            bucket = [n.bit_length() - 1 for n in length]
            yield [start, length, crc, total, bucket, *[ids] * with_ids], origin
        if not lasting:
            words.cache_clear()

    outputs = "start long, length long, ids_crc32 long, doc_tokens long, bucket int"
    keep = tuple(c for c in keep if c not in ("sequence_id", "offset"))
    pieces = map_arrow(df, [text], list(keep), outputs + ", ids array<int>" * with_ids, rows)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
