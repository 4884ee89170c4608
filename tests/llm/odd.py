"""Small tables with everything awkward in them, and plain references."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BIG = 9007199254740993  # beyond the integers of a double


def texts() -> list[str | None]:
    rng = random.Random(7)
    letters = [*"abcdeth  \n\t'.,s!#12é漢😀́\xa0\x85 　\x1c\x00ß▁ΣΑςİ"]
    letters += ["<|endoftext|>", "<|startoftext|>", "</s>", "<0x41>", "the ", "    ", "\n\n", "'ll", "ing", "aaaa"]
    out: list[str | None] = [None, "", " ", "\n", "a", "The the.", "x" * 70_000, "ab " * 5_000, " " * 100 + "the"]
    out += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    return out


def documents(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """doc_id and text with NULL, large and repeated ids, and columns that clash."""
    if rows is None:
        found = texts()
        rows = [(BIG + i, t) for i, t in enumerate(found)]
        rows += [rows[5], rows[5], (None, "no id here"), (None, None)]
    schema = "doc_id long, text string, n_tokens string, `odd name.x` int, score string, kept int"
    return spark.createDataFrame([(*r, "clash", 1, "clash", 2) for r in rows], schema)


def empty(spark: SparkSession) -> DataFrame:
    return documents(spark, []).select("doc_id", "text")


def shingles(text: str | None) -> frozenset:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) >= 5:
        return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return frozenset({tuple(words)} if words else ())
