"""Tokens by a dictionary of any size: longest entry first, from the left."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from operator import add
from typing import Union

import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Characters of all entries together, at most: what every worker holds.
MOST_CHARACTERS = 64 << 20
#: Up to so many entries that begin alike are sought one by one in a text that has their beginning.
FEW_ALIKE = 4

_HAN = r"\p{Han}"
_WORD_CLASS = rf"[[\p{{L}}\p{{N}}]--{_HAN}]"
_WORD = regex.compile(_WORD_CLASS + "+", regex.V1)
_WORD_CHAR = regex.compile(_WORD_CLASS, regex.V1)
_HAN_CHAR = regex.compile(_HAN)


def _alphabetic(ch: str) -> bool:
    return ch.isalnum() and not "⺀" <= ch


class Trie:
    """Entries by their first characters: ``pairs`` by the first two, ``singles`` of one.

    The lists are the leaves of a trie of depth two, the longest entry first, so a place in
    a text looks at the few entries that begin as it does, however many there are.
    """

    def __init__(self, entries: Iterable[str]):
        self.pairs: dict[str, list[str]] = {}
        self.singles: set[str] = set()
        for entry in set(entries):
            if len(entry) == 1:
                self.singles.add(entry)
            elif entry:
                self.pairs.setdefault(entry[:2], []).append(entry)
        for own in self.pairs.values():
            own.sort(key=lambda w: (-len(w), w))
        # of many that begin alike: themselves and their lengths
        self.alike = {
            at: (set(own), sorted({len(w) for w in own})) for at, own in self.pairs.items() if len(own) > FEW_ALIKE
        }
        heads = {e[0] for e in (*self.pairs, *self.singles)}
        # places where a token can begin: a word, a Han character, an entry
        odd = "".join(sorted(c for c in heads if not (_WORD_CHAR.match(c) or _HAN_CHAR.match(c))))
        start = rf"[\p{{L}}\p{{N}}{_HAN}{regex.escape(odd, special_only=False, literal_spaces=False)}]"
        self.start = regex.compile(start).search

    def entry_at(self, text: str, at: int) -> str | None:
        """The longest entry at a place; its alphabetic ends must not continue a word."""
        for entry in self.pairs.get(text[at : at + 2], ()):
            if text.startswith(entry, at) and _whole(text, at, at + len(entry)):
                return entry
        ch = text[at]
        return ch if ch in self.singles and _whole(text, at, at + 1) else None

    def found(self, text: str) -> set[str]:
        """All entries that the text contains, wherever they stand."""
        hits = {c for c in self.singles if c in text}
        for at in self.pairs.keys() & set(map(add, text, text[1:])):
            if at not in self.alike:
                hits.update(e for e in self.pairs[at] if e in text)
                continue
            own, lengths = self.alike[at]
            i = text.find(at)
            while i >= 0:
                hits.update(own.intersection([text[i : i + n] for n in lengths]))
                i = text.find(at, i + 1)
        return hits

    def tokens(self, text: str, bigrams: bool) -> list[str]:
        out: list[str] = []
        at, run = 0, -1  # where a run of Han characters outside entries began

        def end_run(end: int) -> None:
            nonlocal run
            if run >= 0:
                if bigrams and end - run > 1:
                    out.extend(text[i : i + 2] for i in range(run, end - 1))
                else:
                    out.extend(text[run:end])
                run = -1

        while m := self.start(text, at):
            if m.start() > at:
                end_run(at)
                at = m.start()
            entry = self.entry_at(text, at)
            if entry:
                end_run(at)
                out.append(entry)
                at += len(entry)
            elif _HAN_CHAR.match(text, at):
                run = at if run < 0 else run
                at += 1
            else:
                end_run(at)
                word = _WORD.match(text, at)
                if word:
                    out.append(word[0])
                at = word.end() if word else at + 1
        end_run(at)
        return out


def _whole(text: str, begin: int, end: int) -> bool:
    if _alphabetic(text[begin]) and begin and _WORD_CHAR.match(text, begin - 1):
        return False
    return not (_alphabetic(text[end - 1]) and end < len(text) and _WORD_CHAR.match(text, end))


def _entries(spark: SparkSession, entries: Union[Iterable[str], DataFrame]) -> list[str]:
    if isinstance(entries, DataFrame):
        name = entries.columns[0]
        listed = entries.select(F.col(name).cast("string").alias("w")).where(F.length("w") > 0).distinct()
        size = listed.agg(F.coalesce(F.sum(F.length("w")), F.lit(0))).first()[0]
        if size > MOST_CHARACTERS:
            raise ValueError(f"a dictionary of {size} characters is too large for every worker")
        return [r.w for r in listed.collect()]  # MOST_CHARACTERS at most
    listed = [w for w in dict.fromkeys(entries) if w]
    if sum(map(len, listed)) > MOST_CHARACTERS:
        raise ValueError("the dictionary is too large for every worker")
    return listed


def with_dictionary(
    spark: SparkSession, entries: Union[Iterable[str], DataFrame], han: str = "char"
) -> Callable[[Column], Column]:
    """A tokenizer (``tokenizer=`` of the word operators) that knows the entries of a list or
    of a table's first column: the tokens that ``functions.text.tokens`` gives with them as
    custom words, at any size of the dictionary.

    Entries are broadcast once and become a trie once a worker; the plan holds none of them.
    They win over words and Han runs, the longest from the left, unless an alphabetic end
    continues in a word. A NULL text has no tokens.
    """
    if han not in ("char", "bigram"):
        raise ValueError(f"unknown Han mode {han!r}")
    shared = spark.sparkContext.broadcast(_entries(spark, entries))
    bigrams = han == "bigram"

    def segment(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie = _trie(shared)
        for texts in batches:
            yield texts.map(lambda t: [] if t is None else trie.tokens(t, bigrams))

    def tokenizer(c: Column) -> Column:
        return F.pandas_udf(segment, "array<string>")(c)

    segment.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return tokenizer


def containing(spark: SparkSession, keywords: DataFrame) -> Callable[[Column], Column]:
    """For ``keywords(source_keyword, needle, pos)`` a function of a text column: the keywords
    whose needle the text contains, by ``pos`` (needles are compared as they are).

    The needles are broadcast once, within MOST_CHARACTERS, and looked up in a trie.
    """
    _entries(spark, keywords.select("needle"))  # the bound
    rows = [(r.needle, r.pos, r.source_keyword) for r in keywords.collect()]
    by_needle: dict[str, list[tuple]] = {}
    for needle, pos, keyword in rows:
        by_needle.setdefault(needle, []).append((pos, keyword))
    needles, named = spark.sparkContext.broadcast(list(by_needle)), spark.sparkContext.broadcast(by_needle)

    def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie, names = _trie(needles), named.value
        for texts in batches:
            yield texts.map(
                lambda t: [] if t is None else [k for _, k in sorted(x for n in trie.found(t) for x in names[n])]
            )

    look.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return lambda c: F.pandas_udf(look, "array<string>")(c)


_HELD: list[tuple[list[str], Trie]] = []


def _trie(shared: Broadcast) -> Trie:
    """The trie of a broadcast list, built once a worker; the one before it is dropped."""
    entries = shared.value
    if not _HELD or _HELD[0][0] is not entries:
        _HELD[:] = [(entries, Trie(entries))]
    return _HELD[0][1]
