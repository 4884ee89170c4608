"""Alignment of two tokenizers' tokens over the same bytes, and a corpus table of linked ids."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, count
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from feedloom.llm.bpe import PATTERN, WHITE, byte_letters
from feedloom.llm.common import map_arrow, written

SPACE = "▁"  # what the piece vocabulary writes for a space
#: Chunks that a worker remembers; beyond them it forgets all, which costs time only.
REMEMBERED = 300_000
#: Most pairs of ids whose counts every task holds; the counts of rarer pairs are joined.
HELD_PAIRS = 1 << 20
#: Words that the libraries encode in one call.
GROUP = 256

#: Where a chunk begins: at a line end or a space after another character. Spaces that end
#: the text stay with the word before them.
_CUT = re.compile(f"(?<=[^{WHITE}])(?=\n| [{WHITE}]*[^{WHITE}])")
_LINE = re.compile(f"(?<=[^{WHITE}])(?=\n)")
#: White space beyond single spaces and line ends, and the character that marks parts.
_ODD = re.compile(f"[\0\t\x0b-{WHITE[2]}{WHITE[4:]}]")
#: Letters that no pre-token joins with a mark after them, and such marks.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏЀ-ҁҊ-ӿ"
MARKS = ".,;:!?$*#%&|)"


def cuts(a_ends: list[int], b_ends: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The byte offsets where a token of both ends, and the A and B tokens before each."""
    at_a = dict(zip(a_ends, count(1)))
    at_b = dict(zip(b_ends, count(1)))
    ends = sorted(at_a.keys() & at_b.keys())
    return ends, list(map(at_a.__getitem__, ends)), list(map(at_b.__getitem__, ends))


def links(a_ends: list[int], b_ends: list[int], a: range, b: range) -> list[tuple[int, int]]:
    """(A token, B token) of every overlap in a group: of the two tokens that reach an offset
    the one that ends first gives way to the next."""
    if len(a) == 1 or len(b) == 1:
        return [(i, j) for i in a for j in b]
    out = []
    i, j = a.start, b.start
    while i < a.stop and j < b.stop:
        out.append((i, j))
        x, y = a_ends[i], b_ends[j]
        i += x <= y
        j += y <= x
    return out


class Aligner:
    """Tokens of both vocabularies for chunks of a text, cut into groups and linked.

    A text is taken with a space before it. It falls into chunks at spaces and line ends
    that follow another character: no pre-token of the byte vocabulary crosses the start of
    a run of white space, and no piece holds a space after another character or a line end
    beside one. So tokens of both end there, and equal chunks have equal tokens anywhere.
    The same holds between a word of letters and marks that no piece holds after a letter.
    """

    def __init__(self, byte_path: str, piece_path: str):
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        byte_of = {c: b for b, c in byte_letters().items()}
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (1 + max(vocab.values()))
        for w, i in vocab.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in w if c in byte_of)
        ids = {w: i for i, w in enumerate(self.a_bytes) if w}
        with open(byte_path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        # entries numbered in the order of their merges can be merged by number
        self.quick = None
        if made == sorted(made) and len(ids) == 1 + max(ids.values()):
            self.quick = Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ids, special_tokens={})
        self.b = SentencePieceProcessor(model_file=piece_path)
        self.b_bytes = []
        marks = set(MARKS)
        letter = re.compile(f"[{LETTERS}]").match
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.b_bytes.append(bytes([int(piece[1:-1], 16)]))
                continue
            if SPACE in piece.lstrip(SPACE) or ("\n" in piece and len(piece) > 1):
                raise ValueError("pieces that join words or lines are not supported")
            marks -= {y for x, y in zip(piece, piece[1:]) if y in marks and letter(x)}
            self.b_bytes.append(piece.replace(SPACE, " ").encode())
        self.marked = re.compile(f"(\n?[{LETTERS}]+)([{re.escape(''.join(sorted(marks)))}]+)").fullmatch
        self.a_size, self.b_size = ([len(w) for w in x] for x in (self.a_bytes, self.b_bytes))
        self.a_bar = [f"{i}|" for i in range(len(self.a_bytes))]
        self.b_name = [str(i) for i in range(len(self.b_bytes))]
        self.first = self.b.encode("a")
        self.known: Known | None = None  # outlives a task, not a worker

    def chunks(self, text: str) -> list[str]:
        """The text's chunks; the space before a word is left out, so a chunk that starts
        with no white space begins with one more space than it shows. Line ends of plain
        text stay inside its words until they are learnt."""
        if not text:
            return []
        if text[0] in " \n" or text[-1] == " " or "  " in text or " \n" in text or "\n " in text or _ODD.search(text):
            return _CUT.split(" " + text)
        return text.split(" ")

    def parts(self, chunk: str) -> list[str]:
        """What a chunk is made of: chunks themselves, or marks after ``\0``."""
        m = self.marked(chunk)
        if m:
            return [m[1], "\0" + m[2]]
        if "\n" not in chunk:
            return [chunk]
        lines = _LINE.split(chunk)
        return lines if len(lines) == 1 else [p for line in lines for p in self.parts(line)]

    def work_out(self, parts: list[str]) -> Iterator[tuple[list[str], "Aligned | None"]]:
        """Lots of the parts with what ``align`` finds; a lot of one whose tokens do not spell
        it comes with None. Words, and line ends with a word, are encoded many at once."""
        words, lines, other = [], [], []
        for p in parts:
            if p[0] in " \0" or SPACE in p or p[-1] == "\n" or "\n" in p[1:]:
                other.append(p)
            else:
                (lines if p[0] == "\n" else words).append(p)
        for lot in _lots(words, GROUP):
            yield from self.joined(lot, [" " + w for w in lot], True)
        for lot in _lots(lines, GROUP):
            yield from self.joined(lot, lot)
        for p in other:
            whole = p[1:] if p[0] == "\0" else p if p[0] in " \n" else " " + p
            yield from self.joined([p], [whole])

    def joined(
        self, parts: list[str], whole: list[str], words: bool = False
    ) -> Iterator[tuple[list[str], "Aligned | None"]]:
        text = "".join(whole)
        if words and self.quick:
            a = self.quick.encode_ordinary(text)
        else:
            a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        if text[0] == " ":  # the library puts a space before what it is given
            b = self.b.encode(text[1:])
        else:
            b = self.b.encode("a" + text)
            b = b[len(self.first) :] if b[: len(self.first)] == self.first else []
        raw = text.encode()
        if b"".join([self.a_bytes[i] for i in a]) == raw == b"".join([self.b_bytes[i] for i in b]):
            sizes = list(map(len, whole)) if len(raw) == len(text) else [len(w.encode()) for w in whole]
            yield parts, self.align(sizes, a, b)
        elif len(parts) == 1:
            yield parts, None
        else:
            for p, w in zip(parts, whole):
                yield from self.joined([p], [w])

    def align(self, sizes: list[int], a: list[int], b: list[int]) -> "Aligned":
        """Groups and links of a text of parts, of so many bytes, where tokens of both end."""
        a_ends = list(accumulate(map(self.a_size.__getitem__, a)))
        b_ends = list(accumulate(map(self.b_size.__getitem__, b)))
        ends, before_a, before_b = cuts(a_ends, b_ends)
        p, q = np.array([0, *before_a]), np.array([0, *before_b])
        x, y = np.array(a)[p[:-1]], np.array(b)[q[:-1]]
        names = list(map(add, map(self.a_bar.__getitem__, x.tolist()), map(self.b_name.__getitem__, y.tolist())))
        simple = (np.diff(p) == 1) & (np.diff(q) == 1)
        pairs, at = [], []
        for g in np.flatnonzero(~simple).tolist():
            i, j, to_i, to_j = p[g], q[g], p[g + 1], q[g + 1]
            own = links(a_ends, b_ends, range(i, to_i), range(j, to_j))
            pairs += [a[m] << 32 | b[n] for m, n in own]
            at += [g] * len(own)
            names[g] = f"{','.join(map(str, a[i:to_i]))}|{','.join(map(str, b[j:to_j]))}"
        pairs = np.concatenate([(x.astype(np.int64) << 32 | y)[simple], np.array(pairs, np.int64)])
        at = np.concatenate([np.flatnonzero(simple), np.array(at, np.int64)])
        bounds = np.concatenate([[0], 1 + np.searchsorted(ends, np.cumsum(sizes))])
        texts = [";".join(names[m:n]) for m, n in zip(bounds.tolist(), bounds[1:].tolist())]
        part = np.searchsorted(bounds, at, side="right") - 1
        n_links = np.bincount(part, minlength=len(sizes))
        zero = np.zeros(len(sizes), np.int64)
        facts = np.stack([zero, np.diff(p[bounds]), np.diff(q[bounds]), np.diff(bounds), n_links])
        return texts, facts, pairs[np.argsort(part, kind="stable")]


#: Of the parts of a text: groups as text, facts (a column a part), links part by part.
Aligned = tuple[list[str], np.ndarray, np.ndarray]


@lru_cache(maxsize=2)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are parallel already
    return Aligner(byte_path, piece_path)


#: Of each chunk: whether tokens spell something else, numbers of tokens, groups and links.
FACTS = ("differs", "n_a", "n_b", "n_groups", "n_links")


class Codes(dict):
    """A number for each chunk, in the order met; ``new`` holds those met since it was taken."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.new.append(chunk)
        return n


class Known:
    """What a worker has worked out: a number for each chunk and pair, and facts by number."""

    def __init__(self, model: Aligner):
        self.model = model
        self.code = Codes()
        self.pair: dict[int, int] = {}
        self.texts: list[str] = []
        self.facts = np.zeros((len(FACTS), 1024), np.int32)
        self.start = np.zeros(1024, np.int64)  # of a chunk's links; their number is its last fact
        self.links = np.zeros(4096, np.int32)  # numbers of their pairs
        self.used = 0

    def codes(self, chunks: list[str]) -> np.ndarray:
        found = np.array(list(map(self.code.__getitem__, chunks)), np.int64)
        if self.code.new:
            self.learn()
        return found

    def taken(self) -> list[str]:
        new, self.code.new = self.code.new, []
        return new

    def learn(self) -> None:
        """Parts first; a chunk of several is put together from theirs."""
        simple, made = [], []
        for chunk in self.taken():
            parts = self.model.parts(chunk)
            if len(parts) == 1:
                simple.append(chunk)
            else:
                made.append((self.code[chunk], list(map(self.code.__getitem__, parts))))
        simple += self.taken()  # parts that were not met as chunks
        n = len(self.code)
        self.texts += [""] * (n - len(self.texts))
        if n > len(self.start):
            self.start = np.concatenate([self.start, np.zeros(n, np.int64)])
            self.facts = np.concatenate([self.facts, np.zeros((len(FACTS), n), np.int32)], axis=1)
        for parts, found in self.model.work_out(simple):
            at = list(map(self.code.__getitem__, parts))
            if found is None:
                self.facts[0, at] = 1
                continue
            texts, facts, pairs = found
            for k, text in zip(at, texts):
                self.texts[k] = text
            pairs, place = np.unique(pairs, return_inverse=True)
            pairs = pairs.tolist()
            for pair in pairs:
                if pair not in self.pair:
                    self.pair[pair] = len(self.pair)
            numbers = np.array(list(map(self.pair.__getitem__, pairs)), np.int32)
            self.put(at, facts, numbers[place])
        if made:
            sizes = np.array([len(own) for _, own in made])
            flat = np.array([k for _, own in made for k in own])
            for k, own in made:
                self.texts[k] = ";".join([self.texts[p] for p in own])
            facts = np.add.reduceat(self.facts[:, flat], np.cumsum(sizes) - sizes, axis=1)
            self.put([k for k, _ in made], facts, self.links[self.spread(flat)[0]])

    def put(self, at: list[int], facts: np.ndarray, pairs: np.ndarray) -> None:
        self.facts[:, at] = facts
        self.start[at] = self.used + np.cumsum(facts[-1]) - facts[-1]
        if self.used + len(pairs) > len(self.links):
            self.links = np.concatenate([self.links, np.zeros(self.used + len(pairs), np.int32)])
        self.links[self.used : self.used + len(pairs)] = pairs
        self.used += len(pairs)

    def spread(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``links`` of the links of chunks, and the index in ``codes`` of each."""
        sizes = self.facts[-1, codes].astype(np.int64)
        owner = np.repeat(np.arange(len(codes)), sizes)
        ahead = np.cumsum(sizes) - sizes
        return np.arange(len(owner)) + (self.start[codes] - ahead)[owner], owner


def _lots(items: list, size: int) -> Iterator[list]:
    return (items[k : k + size] for k in range(0, len(items), size))


#: Columns of the rows of texts, and of pairs, in one table; the latter have no ``__pairs``.
_FOUND = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_COUNTED = "__pairs array<long>, __times array<int>, __pair long, __n long"


def _aligned(
    df: DataFrame, byte_path: str, piece_path: str, text: str, keep: tuple[str, ...], with_groups: bool
) -> DataFrame:
    """A row a text, with its pairs and how often each is linked; and, of each task, rows of
    pairs with the number of its texts that hold them."""

    def rows(batches: Iterator[list]):
        model = aligner(byte_path, piece_path)
        known, sums = model.known or Known(model), np.zeros(0, np.int64)
        model.known = known

        def counted():
            at = np.flatnonzero(sums)
            pairs = np.fromiter(known.pair, np.int64, len(known.pair))[at]
            none = [None] * len(at)
            lists = [pa.nulls(len(at), pa.list_(t)) for t in (pa.int64(), pa.int32())]
            return [none] * (5 + with_groups) + [*lists, pairs, sums[at]], none

        for (texts,) in batches:
            parts = [model.chunks(t or "") for t in texts.to_pylist()]
            ends = np.cumsum([0, *map(len, parts)])
            codes = known.codes([c for p in parts for c in p])
            facts = np.zeros((len(FACTS), len(codes) + 1), np.int64)
            np.cumsum(known.facts[:, codes], axis=1, out=facts[:, 1:])
            facts = facts[:, ends[1:]] - facts[:, ends[:-1]]
            fine = facts[0] == 0
            numbers = codes.tolist()
            name = known.texts.__getitem__
            groups = [
                ";".join(map(name, numbers[a:b])) if ok and b > a else ""
                for a, b, ok in zip(ends.tolist(), ends[1:].tolist(), fine)
            ]
            new = [*(facts[1:] * fine), [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]]
            if with_groups:
                new.append(groups)
            doc = np.repeat(np.arange(len(parts)), np.diff(ends))
            codes, doc = codes[fine[doc]], doc[fine[doc]]
            places, owner = known.spread(codes)
            width = max(len(known.pair), 1)
            both, times = np.unique(doc[owner] * width + known.links[places], return_counts=True)
            doc, pair = np.divmod(both, width)
            sums = np.concatenate([sums, np.zeros(len(known.pair) - len(sums), np.int64)])
            sums += np.bincount(pair, minlength=len(sums))
            offsets = np.searchsorted(doc, np.arange(len(parts) + 1)).astype(np.int32)
            pairs = np.fromiter(known.pair, np.int64, len(known.pair))[pair]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (pairs, times.astype(np.int32))]
            none = pa.nulls(len(parts), pa.int64())
            yield [*new, *lists, none, none], None
            if len(known.code) > REMEMBERED:
                yield counted()
                model.known = known = Known(model)
                sums = np.zeros(0, np.int64)
        if sums.any():
            yield counted()

    outputs = _FOUND + ", groups string" * with_groups + ", " + _COUNTED
    return map_arrow(df, [text], list(keep), outputs, rows)


def _frequent(counts: DataFrame, held: int) -> tuple[DataFrame, int]:
    """The pairs with the largest counts, ``held`` at most, and how many others there are."""
    digits = F.length(F.bin("n"))
    # at most 64 rows
    sizes = dict(counts.groupBy(digits.alias("d")).agg(F.count("*").alias("n")).collect())
    taken, least = 0, 65
    while least > 1 and taken + sizes.get(least - 1, 0) <= held:
        least -= 1
        taken += sizes.get(least, 0)
    return counts.filter(digits >= least), sum(sizes.values()) - taken


def align(
    df: DataFrame,
    byte_path: str,
    piece_path: str,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    with_groups: bool = True,
    held_pairs: int | None = None,
) -> DataFrame:
    """Kept columns, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256``, ``groups``,
    ``n_best`` and ``count_sum`` of every text, row by row.

    Byte offsets where tokens of both vocabularies end cut a text (with a space before it)
    into groups, written ``a1,a2|b1;a3|b2,b3``; tokens of a group whose bytes overlap are
    linked. ``count_sum`` adds up, over the links, the documents of the table that hold the
    link's pair of ids; ``n_best`` counts links whose pair no other pair of the same A id
    exceeds in that. NULL and empty texts, and texts that the tokens of either vocabulary do
    not spell (U+2581 inside), have zeros and empty strings. Repeated rows are documents of
    their own; an empty table gives an empty one; kept columns named as an output give way.

    A worker aligns a chunk once while it remembers it. Texts and their pairs are written once. The
    counts of at most ``held_pairs`` pairs, the most frequent, go to every task; those of the
    others, of which none has more documents than any of these, are joined by pair.
    """
    held_pairs = HELD_PAIRS if held_pairs is None else held_pairs
    keep = tuple(c for c in keep if c not in ("n_best", "count_sum"))
    both = written(_aligned(df, byte_path, piece_path, text, keep, with_groups), "aligned")
    counts = both.filter("__pairs is null").groupBy(F.col("__pair").alias("pair")).agg(F.sum("__n").alias("n"))
    counts = written(counts, "pair-counts", narrow=True)
    own = F.shiftright("pair", 32)
    most = counts.groupBy(own.alias("a")).agg(F.max("n").alias("most"))  # at most the A vocabulary
    counts = counts.withColumn("a", own).join(F.broadcast(most), "a")
    counts = counts.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    frequent, others = _frequent(counts, held_pairs)
    table = frequent.toArrow()  # at most held_pairs rows
    order = np.argsort(table["pair"].to_numpy(), kind="stable")
    shared = df.sparkSession.sparkContext.broadcast(
        tuple(table[c].to_numpy()[order].astype(np.int64) for c in ("pair", "n", "best"))
    )

    def rows(batches: Iterator[list]):
        keys, n, best = shared.value
        for pairs, times in batches:
            offsets = pairs.offsets.to_numpy()
            pairs, times = pairs.flatten().to_numpy(), times.flatten().to_numpy()
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            held = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            at, weight = at[held], times * held
            found = []
            for value in (best, n):
                each = np.zeros(len(pairs) + 1, np.int64)
                each[1:][held] = value[at] * weight[held]
                sums = np.cumsum(each)
                found.append(sums[offsets[1:] - offsets[0]] - sums[offsets[:-1] - offsets[0]])
            if others:
                rest = np.r_[0, np.cumsum(~held)][offsets - offsets[0]].astype(np.int32)
                rare = pa.StructArray.from_arrays([pa.array(pairs[~held]), pa.array(times[~held])], names=["pair", "times"])
                found.append(pa.ListArray.from_arrays(rest, rare))
            yield found, None

    texts = both.filter("__pairs is not null")
    kept = [c for c in both.columns if not c.startswith("__")]
    outputs = "n_best long, count_sum long"
    if not others:
        return map_arrow(texts, ["__pairs", "__times"], kept, outputs, rows)
    outputs += ", __rare array<struct<pair: long, times: int>>"
    found = map_arrow(texts, ["__pairs", "__times"], kept, outputs, rows)
    found = written(found.withColumn("__row", F.monotonically_increasing_id()), "counted")
    rare = found.select("__row", F.explode("__rare").alias("r")).select("__row", "r.pair", "r.times")
    rare = rare.join(counts, "pair").groupBy("__row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("__best"),
        F.sum(F.col("n") * F.col("times")).alias("__sum"),
    )
    added = {
        "n_best": F.col("n_best") + F.coalesce("__best", F.lit(0)),
        "count_sum": F.col("count_sum") + F.coalesce("__sum", F.lit(0)),
    }
    joined = found.drop("__rare").join(rare, "__row", "left").withColumns(added)
    return joined.drop("__row", "__best", "__sum")
