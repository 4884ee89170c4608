"""Quality rules, lines first: built-in expressions only, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WHITE = r"[\x20\x09-\x0D]+"
_TRIM = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
#: How a sentence ends, what parts the entries of menus and tables.
SENTENCE_END = "[.!?…。！？:;][\"'”’»)\\]]*\\z"
SEPARATOR = "^[|·•»›>/–—-]+\\z"
#: Phrases of page furniture, in lower case.
BOILERPLATE = (
    "all rights reserved|terms of (use|service)|privacy policy|cookie (policy|settings)|"
    "use[sd]? cookies|enable javascript|lorem ipsum|click here|read more|sign (in|up)|log ?in|"
    "subscribe (now|to)|share (this|on)|follow us|back to top|skip to (main )?content"
)
WINDOW = 8


def split_words(text: Column) -> Column:
    """Runs of characters that are not ASCII white space."""
    trimmed = F.trim(text, F.lit(_TRIM))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE))


def _removed(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def line_fails(
    line: Column,
    words: Column,
    min_words: int = 5,
    max_symbols: float = 0.3,
    max_shouts: float = 0.3,
    max_capitals: float = 0.7,
    max_stutter: float = 0.3,
    max_separators: float = 0.15,
    boilerplate_words: int = 15,
) -> Column:
    """Whether a line with words is to go.

    Punctuation: fewer than ``min_words`` words and no end of a sentence; more symbols or
    doubled exclamation and question marks a word than given; mostly capitals; many words
    equal to the one before. Navigation: at least three separators standing alone that make
    up ``max_separators`` of the words. Boilerplate: a phrase of page furniture in a line of
    up to ``boilerplate_words`` words.
    """
    n = F.size(words)
    separators = F.size(F.filter(words, lambda w: w.rlike(SEPARATOR)))
    shouts = F.length(line) - F.length(F.regexp_replace(line, "[!?]{2,}", "!"))
    pairs = F.zip_with(words, F.slice(words, 2, 1 << 30), lambda a, b: a == b)
    return (
        ((n < min_words) & ~F.rtrim(line).rlike(SENTENCE_END))
        | (line.rlike(SYMBOLS) & (_removed(line, SYMBOLS) > max_symbols * n))
        | (line.rlike("[!?]{2}") & (shouts > max_shouts * n))
        | ((n >= min_words) & (F.size(F.filter(pairs, lambda same: same)) > max_stutter * n))
        | (
            (n >= min_words)
            & line.rlike(r"\p{Lu}{2}")
            & (_removed(line, r"\p{Lu}") > max_capitals * _removed(line, r"\p{L}"))
        )
        | (line.rlike("[|·•»›>/–—-]") & (separators >= 3) & (separators >= max_separators * n))
        | ((n <= boilerplate_words) & F.lower(line).rlike(BOILERPLATE))
    )


def _repeated_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Words in windows of WINDOW words found twice or more in the row.

    Windows are compared by 64-bit hashes, within one text only. Where two are equal they
    are sorted, and the starts of equal ones cover up to WINDOW words each.
    """
    n = F.size(words)
    hashes = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW))),
    )
    df = df.withColumn("__h", hashes)
    repeats = F.size(F.array_distinct("__h")) < F.size("__h")
    df = df.withColumn(
        "__s", F.when(repeats, F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    )
    last = F.size("__s") - 1
    at = lambda k: F.get("__s", k)["h"]
    equal = F.filter(
        F.sequence(F.lit(0), last),
        lambda k: F.coalesce(at(k) == at(k - 1), F.lit(False)) | F.coalesce(at(k) == at(k + 1), F.lit(False)),
    )
    df = df.withColumn("__e", F.when(F.col("__s").isNotNull(), equal))
    df = df.withColumn("__p", F.array_sort(F.transform("__e", lambda k: F.get("__s", k)["i"])))
    gaps = F.zip_with(F.slice("__p", F.lit(2), F.size("__p")), "__p", lambda b, a: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(0), lambda s, g: s + g)  # the last start has no next: a whole window
    df = df.withColumn(out, F.coalesce(covered, F.lit(0)).cast("long"))
    return df.drop("__h", "__s", "__e", "__p")


def assess(
    df: DataFrame,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    max_loss: float = 0.5,
    min_words: int = 20,
    max_repeat_percent: int = 30,
) -> DataFrame:
    """Kept columns, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``clean_text`` and ``kept`` for every text.

    First each line stands or falls by itself (``line_fails``); blank lines stay.
    ``clean_text`` is what stands, and a document that loses more than ``max_loss`` of its
    word characters is rejected, as is one of fewer than ``min_words`` words or with more
    than ``max_repeat_percent`` of its words in repeated windows. NULL and empty texts have
    no words and are rejected; their clean text is empty. Repeated rows are judged each
    alike; kept columns named as an output give way to it.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text", "kept")
    keep = [c for c in dict.fromkeys(keep) if c not in made]
    df = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__t"))
    cut = F.transform(F.split("__t", "\n"), lambda x: F.struct(x.alias("l"), split_words(x).alias("w")))
    df = df.withColumn("__l", cut)
    df = df.withColumns(
        {
            "__w": F.flatten(F.transform("__l", lambda x: x["w"])),
            "__f": F.transform(F.filter("__l", lambda x: F.size(x["w"]) > 0), lambda x: x["l"]),
        }
    )
    stands = lambda x: (F.size(x["w"]) == 0) | ~line_fails(x["l"], x["w"])
    df = df.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "word_chars": F.length(F.concat_ws("", "__w")).cast("long"),
            "n_symbols": _removed(F.col("__t"), SYMBOLS).cast("long"),
            "n_dup_lines": (F.size("__f") - F.size(F.array_distinct("__f"))).cast("long"),
            "clean_text": F.concat_ws("\n", F.transform(F.filter("__l", stands), lambda x: x["l"])),
        }
    )
    df = _repeated_words(df, "__w", "n_repeat_words")
    df = df.withColumn(
        "base_failed",
        (F.col("n_words") < min_words)
        | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")),
    )
    left = F.length(F.regexp_replace("clean_text", WHITE, ""))
    kept = ~F.col("base_failed") & (left >= (1 - max_loss) * F.col("word_chars"))
    return df.withColumn("kept", kept).select(*[F.col(f"`{c}`") for c in keep], *made)


def clean(df: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The documents that are kept, with their own columns: the text without the lines that
    fell, and ``n_chars``, if there is such a column, counted anew."""
    held = df.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    judged = assess(held, text, ("__row",), **limits)
    # a filter would be pushed below the projections and repeat them
    once = F.when(F.col("kept"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    judged = judged.withColumn("__once", F.explode(once))
    columns = {c: F.col("__row").getField(c) for c in df.columns} | {text: F.col("clean_text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("clean_text").cast(df.schema["n_chars"].dataType)
    return judged.select(*[c.alias(n) for n, c in columns.items()])
