"""Token counts by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from feedloom.llm.common import Memo, map_arrow

SPACE = "▁"  # what the vocabulary writes for a space
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+$")
_NONE = np.iinfo(np.int32).max
#: Longest vocabulary entry of spaces only; such entries share one rank, the last.
RUN = 16


class PieceMerger:
    """Counts the symbols that piece merging leaves of a text.

    The vocabulary's entries are merged by score, ties from the left; no entry has a space
    after another character, so a text falls into chunks of spaces and a word, and equal
    chunks are counted once.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [
            i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
        ]
        piece = {model.id_to_piece(i): i for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in piece):
            raise ValueError("entries that join words are not supported")
        order = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in plain}, reverse=True))}
        rank = {p: order[model.get_score(i)] for p, i in piece.items()}
        chars = {c for p in piece for c in p}
        self.known = {c for c in chars if c in piece}
        number = {p: n for n, p in enumerate(sorted(chars | set(piece)))}
        self.base = len(number) + 1  # the last number stands for any other character
        self.symbol = np.full(0x110000, self.base - 1, np.int32)
        for c in chars:
            self.symbol[ord(c)] = number[c]
        pairs = sorted(
            (number[p[:k]] * self.base + number[p[k:]], rank[p], number[p])
            for p in piece
            for k in range(1, len(p))
            if p[:k] in number and p[k:] in number
        )
        self.keys = np.array([x[0] for x in pairs], np.int64)
        self.ranks = np.array([x[1] for x in pairs], np.int32)
        self.merged = np.array([x[2] for x in pairs], np.int32)
        self.memo = Memo(self.count_chunks)

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or _NONE) and merged symbol of pairs."""
        key = left.astype(np.int64) * self.base + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), self.merged[at]

    def count_chunks(self, chunks: list[str]) -> list[int]:
        """Symbols left of each chunk, a space before it if it has none; unknown characters
        count their bytes."""
        extra = np.zeros(len(chunks), np.int64)
        parts = []
        for i, chunk in enumerate(chunks):
            if chunk[0] != SPACE:
                chunk = SPACE + chunk
            spaces = len(chunk) - len(chunk.lstrip(SPACE))
            if spaces > 2 * RUN:  # spaces merge from the left, RUN at a time
                blocks = (spaces - 1) // RUN
                extra[i] += blocks
                chunk = chunk[blocks * RUN :]
            odd = set(chunk) - self.known
            if odd:
                extra[i] += sum(len(c.encode()) - 1 for c in chunk if c in odd)
            parts.append(chunk)
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        return (extra + self.merge(self.symbol[codes], sizes)).tolist()

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Symbols left of each sequence of a ragged array.

        Each round merges, in every sequence at once, the occurrences of its lowest-rank
        pair. Where a merge makes a pair of no higher rank, that pair comes first, so the
        sequence's later occurrences wait for the next round.
        """
        left_over = sizes.copy()
        where = np.flatnonzero(sizes > 1)
        keep = np.repeat(sizes > 1, sizes)
        symbols, sizes = symbols[keep], sizes[where]
        ranks = news = None
        while len(where):
            starts = np.cumsum(sizes) - sizes
            if ranks is None:
                ranks = np.full(len(symbols), _NONE, np.int32)
                news = np.zeros(len(symbols), np.int32)
                ranks[:-1], news[:-1] = self.look(symbols[:-1], symbols[1:])
                ranks[starts[1:] - 1] = _NONE
            low = np.minimum.reduceat(ranks, starts)
            done = low == _NONE
            if done.any():
                left_over[where[done]] = sizes[done]
                keep = np.repeat(~done, sizes)
                symbols, ranks, news = symbols[keep], ranks[keep], news[keep]
                where, sizes, low = where[~done], sizes[~done], low[~done]
                if not len(where):
                    break
                starts = np.cumsum(sizes) - sizes
            owner = np.repeat(np.arange(len(sizes)), sizes)
            at = np.flatnonzero(ranks == low[owner])
            # of overlapping occurrences every second one, from the left
            first = np.ones(len(at), bool)
            first[1:] = np.diff(at) != 1
            begin = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
            at = self.in_turn(symbols, news, owner, low, at)
            symbols[at] = news[at]
            gone = np.ones(len(symbols), bool)
            gone[at + 1] = False
            sizes = sizes - np.bincount(owner[at], minlength=len(sizes))
            now = np.cumsum(gone) - 1
            at = now[at]
            symbols, ranks, news, owner = symbols[gone], ranks[gone], news[gone], owner[gone]
            stale = np.concatenate([at, at[at > 0] - 1])
            last = stale == len(symbols) - 1
            ranks[stale[last]] = _NONE
            stale = stale[~last]
            rank, new = self.look(symbols[stale], symbols[stale + 1])
            ranks[stale] = np.where(owner[stale] == owner[stale + 1], rank, _NONE)
            news[stale] = new
        return left_over

    def in_turn(self, symbols, news, owner, low, at) -> np.ndarray:
        """The occurrences up to the first, in each sequence, after which another pair is due."""
        new = news[at]
        last = len(symbols) - 1
        before = symbols[np.maximum(at - 1, 0)]
        follows = np.zeros(len(at), bool)
        follows[1:] = at[1:] - at[:-1] == 2
        before[follows] = new[:-1][follows[1:]]
        own = owner[at]
        has_left = (at > 0) & (owner[np.maximum(at - 1, 0)] == own)
        after = np.minimum(at + 2, last)
        has_right = (at + 2 <= last) & (owner[after] == own)
        due = has_left & (self.look(before, new)[0] <= low[own])
        due |= has_right & (self.look(new, symbols[after])[0] <= low[own])
        if not due.any():
            return at
        stop = np.full(len(low), len(symbols), np.int64)
        np.minimum.at(stop, own[due], at[due])
        return at[at <= stop[own]]

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        return [sum(values) for values in self.memo.values([_chunks(t) for t in texts])]


def _chunks(text: str) -> list[str]:
    """Words, each standing for a space and itself, or chunks of spaces and words."""
    if not text:
        return []
    if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
        return _CHUNK.findall(SPACE + text.replace(" ", SPACE))
    return text.split(" ")


@lru_cache(maxsize=2)
def merger(path: str) -> PieceMerger:
    return PieceMerger(path)


def token_counts(
    df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Kept columns, ``n_bytes`` (UTF-8) and ``n_tokens`` of every text, row by row.

    ``path`` names a sentence-piece model of merge type whose normaliser changes nothing.
    A NULL or empty text has no bytes and no tokens; repeated rows are counted each; an
    empty table gives an empty one; a kept column named as an output gives way to it.
    Spaces, tabs and line ends count; strings like ``</s>`` are ordinary text.
    """

    def rows(batches: Iterator[list]):
        model = merger(path)
        for (texts,) in batches:
            yield [model.counts([t or "" for t in texts.to_pylist()])], None

    source = df.withColumn("n_bytes", F.coalesce(F.octet_length(f"`{text}`"), F.lit(0)).cast("long"))
    return map_arrow(source, [text], [*[c for c in keep if c != "n_bytes"], "n_bytes"], "n_tokens long", rows)


def over_limit(limit: int) -> Column:
    return F.col("n_tokens") > limit
