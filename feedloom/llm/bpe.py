"""Byte-level BPE: a queue of merge ranks over a linked list of symbols, and back."""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from feedloom.llm.common import Memo, map_arrow

#: The pre-token pattern of this family of vocabularies, and white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = "\t-\r \x85\xa0  -     　"
_PATTERN = regex.compile(
    PATTERN.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")
)
#: A run of white space and what follows; no pre-token reaches across its start.
_CHUNK = regex.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+$")
_BEFORE_SPACE = regex.compile(f"[{WHITE}] ")


def byte_letters() -> dict[int, str]:
    """The letter by which such a vocabulary writes each byte: printable ones stand for
    themselves, the others follow from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class ByteBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        letters = byte_letters()
        byte_of = {c: b for b, c in letters.items()}
        vocab = model["vocab"]
        self.first = [vocab[letters[b]] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.strings = [b""] * size
        for word, i in vocab.items():
            self.strings[i] = bytes(byte_of[c] for c in word)
        for word, i in self.special.items():
            self.strings[i] = word.encode()
        longest = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None
        self.words = Memo(lambda words: [self.pack(w) for w in words], 150_000)
        self.memo = Memo(self.encode_chunks, 250_000)

    def pack(self, word: str) -> bytes:
        return array("I", self.encode_word(word.encode())).tobytes()

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks as little-endian 32-bit integers."""
        return [b"".join(w) for w in self.words.values(list(map(_PATTERN.findall, chunks)))]

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of a pre-token.

        The queue holds (rank, left position, ids of the pair); an entry is stale when one
        of its two symbols was merged since, which its ids tell.
        """
        symbol: list[int] = [self.first[b] for b in word]
        n = len(symbol)
        if n == 1:
            return symbol
        after = [*range(1, n + 1)]
        before = [*range(-1, n - 1)]
        merges = self.merges
        queue = []
        for i in range(n - 1):
            hit = merges.get((symbol[i], symbol[i + 1]))
            if hit:
                queue.append((hit[0], i, symbol[i], symbol[i + 1], hit[1]))
        heapify(queue)
        while queue:
            _, i, left, right, new = heappop(queue)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue
            symbol[i], symbol[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                hit = merges.get((new, symbol[k]))
                if hit:
                    heappush(queue, (hit[0], i, new, symbol[k], hit[1]))
            h = before[i]
            if h >= 0:
                hit = merges.get((symbol[h], new))
                if hit:
                    heappush(queue, (hit[0], h, symbol[h], new, hit[1]))
        return [s for s in symbol if s >= 0]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        parts: list[str] = []  # texts without special strings, and those strings
        ends = []
        for text in texts:
            if self.cut is not None and any(s in text for s in self.special):
                parts += self.cut.split(text)
            else:
                parts.append(text)
            ends.append(len(parts))
        special = self.special
        packed = self.memo.values([[] if p in special else _chunks(p) for p in parts])
        ids = [
            special[p].to_bytes(4, "little") if p in special else b"".join(found)
            for p, found in zip(parts, packed)
        ]
        return [b"".join(ids[a:b]) for a, b in zip([0, *ends], ends)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: their vocabulary strings, one after the other."""
        return b"".join(map(self.strings.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _chunks(text: str) -> list[str]:
    """The text in pieces that pre-tokens do not cross."""
    if not text or _BEFORE_SPACE.search(text):
        return _CHUNK.findall(text)
    head, *rest = text.split(" ")  # each space begins a run of white space
    chunks = [" " + w for w in rest]
    return [head, *chunks] if head else chunks


@lru_cache(maxsize=2)
def codec(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode(
    df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Kept columns, ``ids`` (array) and ``n_tokens`` of every text.

    A NULL or empty text has no ids; strings of special tokens inside a text become those
    tokens; repeated rows are encoded each; a kept column named as an output gives way.
    """

    def rows(batches: Iterator[list]):
        model = codec(path)
        for (texts,) in batches:
            packed = model.encode([t or "" for t in texts.to_pylist()])
            counts = [len(p) // 4 for p in packed]
            yield [_lists(packed, counts), counts], None

    return map_arrow(df, [text], list(keep), "ids array<int>, n_tokens long", rows)


def decode(
    df: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Kept columns and ``decoded``, the text of the ids in column ``ids``.

    NULL or no ids give an empty text, NULL elements are skipped, bytes that are not UTF-8
    become U+FFFD; an id beyond the vocabulary is an error.
    """

    def rows(batches: Iterator[list]):
        model = codec(path)
        for (lists,) in batches:
            yield [[model.decode(_ids(x)) for x in lists.to_pylist()]], None

    return map_arrow(df, [ids], list(keep), "decoded string", rows)


def round_trip(
    df: DataFrame,
    path: str,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    with_text: bool = True,
    with_ids: bool = True,
) -> DataFrame:
    """Encode and decode in one pass: ``ids``, ``decoded``, ``n_tokens`` and the SHA-256 of
    the ids (little-endian unsigned 32-bit) and of the decoded text. What the caller does
    not ask for never leaves the task. NULLs, repeats and names as in ``encode``."""

    def rows(batches: Iterator[list]):
        model = codec(path)
        for (texts,) in batches:
            packed = model.encode([t or "" for t in texts.to_pylist()])
            back = [model.decode(np.frombuffer(p, "<u4")) for p in packed]
            counts = [len(p) // 4 for p in packed]
            columns = [
                counts,
                [hashlib.sha256(p).hexdigest() for p in packed],
                [hashlib.sha256(t.encode()).hexdigest() for t in back],
            ]
            if with_ids:
                columns.append(_lists(packed, counts))
            if with_text:
                columns.append(back)
            yield columns, None

    outputs = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    outputs += ", ids array<int>" * with_ids + ", decoded string" * with_text
    return map_arrow(df, [text], list(keep), outputs, rows)


def _lists(packed: list[bytes], counts: list[int]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(packed), "<i4")))


def _ids(values: list | None) -> np.ndarray:
    return np.array([i for i in values or () if i is not None], np.int64)
