"""Row filters, routing by type, keyword search, valid/rejected splits."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from typing import Optional, Union

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType, StructType

from feedloom.functions.codes import KIND_CODES, PUBLISH_WINDOWS, WINDOW_CODES
from feedloom.functions.nested import ColumnOrName, col, present
from feedloom.functions.times import check_days, day_begin
from feedloom.operators.bloom import semi_filtered
from feedloom.operators.dictionary import containing
from feedloom.operators.skew import balanced_join

# Up to this many keywords are tested in one projection, without any join.
INLINE_KEYWORDS = 200
# Up to so many characters of all keywords every worker holds them, and texts stay where they are.
TRIE_CHARACTERS = 1 << 20
# Up to so many the keywords are sent to the texts, not both to each other.
SENT_CHARACTERS = 8 << 20
GRAM = 3
# Counters of the sketch of gram frequencies, and of how many texts one is counted.
GRAM_COUNTERS = 1 << 15
SAMPLED = 64


# --- by type --------------------------------------------------------------


def select_cards(df: DataFrame, card_type: int = 9) -> DataFrame:
    """Cards of one type, at the top level and inside ``card_group``.

    Each result row has the card's fields, its ``card_pos`` (0 = the outer card,
    then group order) and the input's other columns.
    """
    keep = [c for c in df.columns if c not in ("card_type", "mblog", "card_group")]
    outer = F.array(F.struct("card_type", "mblog"))
    cards = F.concat(outer, F.coalesce(F.col("card_group"), F.slice(outer, 1, 0)))
    return (
        df.select(*keep, F.posexplode(cards).alias("card_pos", "_card"))
        .where(F.col("_card.card_type") == card_type)
        .select(*keep, "card_pos", "_card.card_type", "_card.mblog")
    )


def drop_types(df: DataFrame, column: ColumnOrName, types: Iterable[str]) -> DataFrame:
    """Drop rows of the given types; a NULL type stays."""
    return df.where(~F.coalesce(col(column).isin(*types), F.lit(False)))


def keep_types(df: DataFrame, column: ColumnOrName, types: Iterable[str]) -> DataFrame:
    return df.where(col(column).isin(*types))


def route_by_type(
    df: DataFrame, column: str, routes: Mapping[str, Sequence[Column]], keep: Sequence[str] = ()
) -> DataFrame:
    """Project each type in its own way; rows of other types are dropped.

    ``routes`` gives the output columns per type (a column one type lacks is NULL
    there). One pass: a type's expressions are evaluated on its rows only.
    """
    kinds: dict[str, DataType] = {}
    named = {}
    for name, columns in routes.items():
        fields = df.select(*columns).schema.fields
        kinds.update({f.name: f.dataType for f in fields if f.name not in kinds})
        named[name] = dict(zip([f.name for f in fields], columns))
    routed = F.lit(None)
    for name, columns in named.items():
        row = F.struct(
            *[
                (columns[n] if n in columns else F.lit(None)).cast(kind).alias(n)
                for n, kind in kinds.items()
            ]
        )
        routed = F.when(F.col(column) == name, row).otherwise(routed)
    return df.select(*keep, F.inline(present(routed)))


def of_kind(df: DataFrame, platform: str, code: str, column: str = "content_type") -> DataFrame:
    """Keep the kinds a platform's filter code stands for."""
    kinds = KIND_CODES[(platform, code)]
    return df if kinds is None else keep_types(df, column, kinds)


# --- by emptiness and consistency -----------------------------------------


def drop_empty(df: DataFrame, *keys: str) -> DataFrame:
    """Drop rows whose key is NULL or ''."""
    present = [F.length(F.col(k).cast("string")) > 0 for k in keys]
    return df.where(reduce(lambda a, b: a & b, present))


def with_children(df: DataFrame, count: ColumnOrName = "sub_comment_count") -> DataFrame:
    return df.where(col(count).try_cast("bigint") > 0)


def consistent_children(
    df: DataFrame, parent: ColumnOrName, requested: ColumnOrName
) -> tuple[DataFrame, DataFrame]:
    """Children of the parent they were requested for, and the others."""
    same = col(parent).eqNullSafe(col(requested))
    return df.where(same), df.where(~same)


def split_valid(
    df: DataFrame, rules: Mapping[str, Column]
) -> tuple[DataFrame, DataFrame]:
    """Rows that pass every rule, and the rest with the names of the failed rules.

    The two outputs are disjoint and together are the input.
    """
    failed = F.array_compact(
        F.array(
            *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
        )
    )
    every = reduce(lambda a, b: a & b, [F.coalesce(ok, F.lit(False)) for ok in rules.values()])
    return df.where(every), df.where(~every).withColumn("failed_rules", failed)


def conform(
    df: DataFrame, schema: StructType, defaults: Optional[Mapping[str, object]] = None
) -> DataFrame:
    """Columns of ``schema``, coerced; a missing or bad value becomes the default."""
    defaults = defaults or {}

    def coerced(field) -> Column:
        if field.name in df.columns:
            value = F.col(field.name).try_cast(field.dataType)
        else:
            value = F.lit(None).cast(field.dataType)
        if field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]).cast(field.dataType))
        return value.alias(field.name)

    return df.select(*[coerced(f) for f in schema.fields])


# --- by time --------------------------------------------------------------


def in_day_range(df: DataFrame, ts: ColumnOrName, start: str, end: str, zone: str = "UTC") -> DataFrame:
    """Rows of the days from start to end, both whole, as days of a zone.

    Bounds fold to typed literals, so the predicate reaches the scan. Zone-less timestamps
    are read as UTC.
    """
    check_days(start, end)
    kind = _timestamp_type(df, ts)

    def bound(day: Column) -> Column:
        return F.timestamp_seconds(day_begin(day, zone)).cast(kind)

    low, high = bound(F.lit(start).cast("date")), bound(F.date_add(F.lit(end).cast("date"), 1))
    return df.where((col(ts) >= low) & (col(ts) < high))


def published_within(
    df: DataFrame,
    ts: ColumnOrName,
    window: Union[str, tuple[str, str]],
    as_of: Union[str, Column],
) -> DataFrame:
    """Rows published in the window that ends at ``as_of``.

    ``window`` is a name of PUBLISH_WINDOWS or a (platform, window code) pair.
    """
    span = PUBLISH_WINDOWS[WINDOW_CODES[window] if isinstance(window, tuple) else window]
    if span is None:
        return df
    months, days = span
    kind = _timestamp_type(df, ts)
    until = (F.lit(as_of) if isinstance(as_of, str) else as_of).cast(kind)
    since = until - F.make_interval(months=F.lit(months), days=F.lit(days))
    return df.where((col(ts) >= since) & (col(ts) <= until))


def _timestamp_type(df: DataFrame, ts: ColumnOrName) -> str:
    return df.select(col(ts).alias("t")).schema["t"].dataType.simpleString()


# --- by keyword -----------------------------------------------------------


def split_keywords(keywords: Union[str, Sequence[str]]) -> list[str]:
    """Keywords of a list or a comma-separated text, in order, without repeats."""
    parts = keywords.split(",") if isinstance(keywords, str) else list(keywords)
    return list(dict.fromkeys(k for k in parts if k))


def keyword_search(
    df: DataFrame,
    keywords: Union[str, Sequence[str], DataFrame],
    text_cols: Sequence[str],
    mode: str = "all",
    key: Optional[Sequence[str]] = None,
) -> DataFrame:
    """Rows whose text contains a keyword (any case), tagged with ``source_keyword``.

    ``mode='all'`` gives one row per hit, ``mode='last'`` one row per input row with
    the last keyword that hits; either way the input's columns and the keyword. A short
    list is tested inside one projection: no join, no shuffle. A longer list or a DataFrame
    (columns ``source_keyword`` and, for 'last', ``keyword_pos``) goes through a trie that every
    worker holds: no shuffle either. Above TRIE_CHARACTERS it goes, at any size, through an
    equi-join on character grams, but not on a stream, where that would be state. The rows are
    the same: repeated rows are rows each, and ``key``, the columns that identify a row, is not
    needed for either.
    """
    if mode not in ("all", "last"):
        raise ValueError(f"unknown keyword mode {mode!r}")
    if not isinstance(keywords, DataFrame):
        listed = split_keywords(keywords)
        if len(listed) <= INLINE_KEYWORDS:
            return _inline_search(df, listed, text_cols, mode)
        rows = [(k, i) for i, k in enumerate(listed)]
        keywords = df.sparkSession.createDataFrame(rows, "source_keyword string, keyword_pos int")
    if mode == "last" and "keyword_pos" not in keywords.columns:
        raise ValueError("mode 'last' needs keyword_pos, the keywords' order")
    unique = _unique(keywords)
    if df.isStreaming or _characters(unique) <= TRIE_CHARACTERS:
        return _trie_search(df, unique, text_cols, mode)
    return _gram_search(df, unique, text_cols, mode)


def _characters(unique: DataFrame) -> int:
    return unique.agg(F.coalesce(F.sum(F.length("source_keyword")), F.lit(0))).first()[0]


def _haystack(text_cols: Sequence[str]) -> Column:
    if len(text_cols) == 1:
        return F.lower(F.col(text_cols[0]))
    # Texts are joined by a control character that no keyword holds.
    return F.lower(F.concat_ws("\x00", *text_cols))


def _inline_search(
    df: DataFrame, keywords: list[str], text_cols: Sequence[str], mode: str
) -> DataFrame:
    if not keywords:
        return df.withColumn("source_keyword", F.lit(None).cast("string")).where(F.lit(False))
    spotted = df.withColumn("_text", _haystack(text_cols))
    hit = [
        F.when(F.contains(F.col("_text"), F.lower(F.lit(k))), F.lit(k)) for k in keywords
    ]
    if mode == "last":
        tagged = spotted.withColumn("source_keyword", F.coalesce(*reversed(hit)))
        return tagged.where(F.col("source_keyword").isNotNull()).drop("_text")
    every = F.explode(F.array_compact(F.array(*hit)))
    return spotted.withColumn("source_keyword", every).drop("_text")


def _unique(keywords: DataFrame) -> DataFrame:
    """Each keyword once, with its last place in the list if it has any."""
    if "keyword_pos" in keywords.columns:
        unique = keywords.groupBy("source_keyword").agg(F.max("keyword_pos").alias("keyword_pos"))
    else:
        unique = keywords.select("source_keyword").distinct()
    return unique.where(F.length("source_keyword") > 0)


def _trie_search(df: DataFrame, unique: DataFrame, text_cols: Sequence[str], mode: str) -> DataFrame:
    """Keywords looked up text by text: no join, no state."""
    if mode == "last":
        unique = unique.where(F.col("keyword_pos").isNotNull())
    pos = F.col("keyword_pos") if mode == "last" else F.lit(0)
    found = containing(
        df.sparkSession, unique.select("source_keyword", F.lower("source_keyword").alias("needle"), pos.alias("pos"))
    )
    spotted = df.withColumn("_hits", found(_haystack(text_cols)))
    if mode == "last":
        tagged = spotted.withColumn("source_keyword", F.try_element_at("_hits", F.lit(-1)))
        return tagged.where(F.col("source_keyword").isNotNull()).drop("_hits")
    return spotted.withColumn("source_keyword", F.explode("_hits")).drop("_hits")


def _gram_counts(body: DataFrame) -> Column:
    """How often grams occur in a sample of the texts, by GRAM_COUNTERS counters: one bounded
    value. It serves to choose grams only; results do not depend on it."""
    sample = body.where(F.pmod(F.xxhash64("_text"), F.lit(SAMPLED)) == 0)
    cut = F.regexp_extract_all("_text", F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))
    grams = sample.select(F.explode(cut).alias("g"))
    counts = grams.groupBy(_counter(F.col("g")).alias("c")).agg(F.count("*").alias("n"))
    every = body.sparkSession.range(GRAM_COUNTERS).select(F.col("id").alias("c"))
    dense = every.join(counts, "c", "left").select("c", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
    listed = dense.agg(F.array_sort(F.collect_set(F.struct("c", "n"))).alias("l"))
    return listed.select(F.transform("l", lambda x: x["n"]).alias("n")).scalar()


def _counter(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(GRAM_COUNTERS))


def _rarest_gram(needle: Column, counts: Column) -> Column:
    """The gram of a keyword that the sampled texts hold least often, the first of equals; all
    of a keyword shorter than a gram."""
    places = F.sequence(F.lit(1), F.greatest(F.length(needle) - GRAM + 1, F.lit(1)))

    def weighed(i: Column) -> Column:
        gram = F.substring(needle, i, F.lit(GRAM))
        return F.struct(F.element_at(counts, (_counter(gram) + 1).cast("int")).alias("n"), i.alias("i"), gram.alias("g"))

    return F.array_min(F.transform(places, weighed))["g"]


def _gram_search(df: DataFrame, unique: DataFrame, text_cols: Sequence[str], mode: str) -> DataFrame:
    """A text that holds a keyword holds each of its grams, also the one that texts hold least.

    Each row meets the keywords once for each of its grams that stands for one, and is
    checked where it meets them: texts are not joined back. A Bloom filter of those grams,
    a bounded value, drops the others before they are exchanged. Up to SENT_CHARACTERS the
    keywords are sent to the rows instead, which are not exchanged.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    body = df.select(row.alias("_row"), _haystack(text_cols).alias("_text"))
    if mode == "last":
        body = body.withColumn("_id", F.monotonically_increasing_id())
    named = unique.withColumn("_needle", F.lower("source_keyword"))
    # a column first: a subquery cannot stand inside a lambda
    counted = named.withColumn("_counts", _gram_counts(body))
    needles = counted.withColumn("_gram", _rarest_gram(F.col("_needle"), F.col("_counts"))).drop("_counts")
    grams_of = needles.agg(F.count("*").alias("n"), F.collect_set(F.length("_gram")).alias("lengths")).first()
    lengths = [n for n in range(1, GRAM + 1) if n in grams_of.lengths]  # GRAM at most
    if not lengths:
        return df.withColumn("source_keyword", F.lit(None).cast("string")).where(F.lit(False))

    # A look-ahead matches at every character: one pass gives overlapping grams. Lengths
    # that no keyword needs are not cut at all.
    cuts = [F.regexp_extract_all("_text", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in lengths]
    grams = F.array_distinct(F.concat(*cuts) if len(cuts) > 1 else cuts[0])
    met = body.withColumn("_gram", F.explode(grams))
    met = semi_filtered(met, needles.select("_gram").distinct(), ["_gram"], grams_of.n)
    if _characters(unique) <= SENT_CHARACTERS:
        joined = met.join(F.broadcast(needles), ["_gram"])
    else:
        joined = balanced_join(met, needles, ["_gram"])
    checked = joined.where(F.contains(F.col("_text"), F.col("_needle")))
    if mode == "last":
        checked = checked.groupBy("_id").agg(
            F.max_by("_row", "keyword_pos").alias("_row"),
            F.max_by("source_keyword", "keyword_pos").alias("source_keyword"),
        )
    return checked.select(*[F.col("_row").getField(c).alias(c) for c in df.columns], "source_keyword")
