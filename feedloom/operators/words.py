"""Word frequencies of a text column."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import Optional, Union

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from feedloom.functions.nested import ColumnOrName
from feedloom.functions.text import strip, tokens

Segmenter = Callable[[str], list]
STOP_LITERALS = 1000  # longer stop lists are joined, not written into the plan


def with_segmenter(segment: Segmenter) -> Callable[[Column], Column]:
    """A user segmenter (text -> words) as a Column function, run on Arrow batches."""

    def batch(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else list(segment(t)))

    return lambda c: F.pandas_udf(batch, "array<string>")(c)


def drop_stopwords(
    words: DataFrame, stop: Union[Iterable[str], DataFrame], column: str = "word"
) -> DataFrame:
    """Remove blank tokens and stop words (exact match)."""
    return _without(words.where(F.length(strip(column)) > 0), stop, column)


def _without(words: DataFrame, stop: Union[Iterable[str], DataFrame], column: str) -> DataFrame:
    if not isinstance(stop, DataFrame):
        listed = sorted(set(stop))
        if not listed:
            return words
        if len(listed) <= STOP_LITERALS:
            return words.where(~F.col(column).isin(*listed))
        stop = words.sparkSession.createDataFrame([(w,) for w in listed], f"{column} string")
    stop = stop.select(F.col(stop.columns[0]).alias(column)).distinct()
    return words.join(stop, [column], "left_anti")


_POSITIONS = 1 << 32


def _appearance(words: DataFrame, doc_order: str) -> Column:
    """Smallest (document, position). Whole numbers are packed into one decimal, which
    keeps the aggregate a hash aggregate; other orders need a struct and a sort."""
    if words.schema[doc_order].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        packed = F.col(doc_order).cast("decimal(19,0)") * F.lit(_POSITIONS).cast("decimal(11,0)")
        return F.min((packed + F.col("pos").cast("decimal(10,0)")).cast("decimal(31,0)"))
    return F.min(F.struct(F.col(doc_order).alias("first_doc"), F.col("pos").alias("first_pos")))


def _with_appearance(freq: DataFrame, keep: Sequence[str]) -> DataFrame:
    if freq.schema["_first"].dataType.simpleString().startswith("struct"):
        return freq.select(*keep, "_first.*")
    doc = F.floor(F.col("_first") / F.lit(_POSITIONS).cast("decimal(11,0)")).cast("bigint")
    pos = F.pmod("_first", F.lit(_POSITIONS).cast("decimal(11,0)")).cast("int")
    return freq.select(*keep, doc.alias("first_doc"), pos.alias("first_pos"))


def word_freq(
    df: DataFrame,
    text_col: ColumnOrName,
    stop: Union[Iterable[str], DataFrame] = (),
    custom: Union[Iterable[str], Mapping[str, str]] = (),
    by: Sequence[str] = (),
    doc_order: Optional[str] = None,
    tokenizer: Optional[Callable[[Column], Column]] = None,
    han: str = "char",
    with_group: bool = False,
) -> DataFrame:
    """``by..., word, n``: how often each word occurs.

    Counting is partial before the shuffle. A stop list small enough to broadcast is
    applied before it; a larger one afterwards, to distinct words. ``doc_order`` (a unique column) adds
    ``first_doc`` and ``first_pos``, the word's first appearance. ``custom`` may map
    words to groups; ``with_group`` adds the group of a word.
    """
    split = tokenizer or (lambda c: tokens(c, [w for w in custom if w.strip()], han))
    text = F.col(text_col) if isinstance(text_col, str) else text_col
    aggregates = [F.count(F.lit(1)).alias("n")]
    if doc_order is None:
        words = df.select(*by, F.explode(split(text)).alias("word"))
    else:
        words = df.select(*by, doc_order, F.posexplode(split(text)).alias("pos", "word"))
        aggregates.append(_appearance(words, doc_order).alias("_first"))
    freq = words.groupBy(*by, "word").agg(*aggregates)
    # The built-in tokens are never blank; a check would only cost time per token.
    freq = _without(freq, stop, "word") if tokenizer is None else drop_stopwords(freq, stop)
    if doc_order is not None:
        freq = _with_appearance(freq, [*by, "word", "n"])
    if with_group:
        groups = dict(custom) if isinstance(custom, Mapping) else {}
        pairs = [F.lit(x) for kv in groups.items() for x in kv]
        label = F.try_element_at(F.create_map(*pairs), F.col("word")) if pairs else F.lit(None)
        freq = freq.withColumn("word_group", label.cast("string"))
    return freq


def top_words(freq: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` most frequent words; ties by first appearance, else by word."""
    tie = [c for c in ("first_doc", "first_pos") if c in freq.columns] or ["word"]
    return freq.orderBy(F.desc("n"), *tie).limit(k)
