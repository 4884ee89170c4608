"""Personal data, and terms that disclose it: built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.llm.common import bounded, written

KINDS = ("email", "ip", "card", "phone", "term")
#: A start inside a run of a pattern's first class cannot match where the run's start does
#: not, so it is tried at the run's start and after a match only; quantifiers that can give
#: nothing back are possessive. Both keep matching linear and off the stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PLACEHOLDERS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
GENERAL = "[WORD]"
_WORD = r"\p{L}{2,}"
#: A word that can be a term: shorter ones (Kim, Li) where they do not begin in lower case.
_TERM = r"^(?:\p{L}{4}|[^\p{Ll}])"
#: Characters on each side of a span that tell copies of one passage from other evidence.
CONTEXT = 160
SPAN = "array<struct<start:int,kind:int,end:int,value:string,action:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether 12 to 19 digits pass the check sum."""
    d = F.reverse(_digits(value))

    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(x > 9, x - 9).otherwise(x)

    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add)
    return F.length(d).between(12, 19) & (total % 10 == 0)


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"),
    "card": luhn,
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}
#: A cheap sign that a text can hold the kind at all.
SIGN = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    "phone": lambda t: t.contains("+"),
}


def _located(text: Column, pattern: Column, kind: int, action: Column) -> Column:
    """Matches with their places in code points: what lies between them, added up."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("m"))
    parts = F.filter(parts, lambda p: p["m"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        a = acc["at"] + F.length(p["gap"])
        b = a + F.length(p["m"])
        span = F.struct(
            a.alias("start"), F.lit(kind).alias("kind"), b.alias("end"), p["m"].alias("value"), action.alias("action")
        )
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def _valid(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: VALID[kind](s["value"]))


def with_base_spans(df: DataFrame, text: str, out: str) -> DataFrame:
    """The spans of the four kinds that pass their tests, by start and kind."""
    none = F.array().cast(SPAN)
    t = F.col(text)
    columns = {}
    for k, kind in enumerate(KINDS[:4]):
        spans = _located(t, F.lit(PATTERNS[kind]), k, F.lit(None).cast("string"))
        columns[f"__{kind}"] = F.when(SIGN[kind](t), _valid(spans, kind)).otherwise(none)
    df = df.withColumns(columns)
    return df.withColumn(out, F.array_sort(F.concat(*columns))).drop(*columns)


def _holdings(df: DataFrame) -> DataFrame:
    """One row per value and text: ``entity``, the text's ``key``, its rows ``n``, and ``place``,
    a hash of the letters around the value (of the smallest hash, if it stands there often)."""
    rows = df.select("t", "key", F.monotonically_increasing_id().alias("row"), F.explode("base").alias("s"))
    start, end = F.col("s.start"), F.col("s.end")
    a = F.greatest(start - CONTEXT, F.lit(0))
    before = F.substring(F.col("t"), a + 1, start - a)
    before = F.when(a > 0, F.regexp_replace(before, r"^\p{L}+", "")).otherwise(before)
    after = F.substring(F.col("t"), end + 1, F.lit(CONTEXT))
    after = F.when(F.length(F.col("t")) > end + CONTEXT, F.regexp_replace(after, r"\p{L}+$", "")).otherwise(after)
    around = F.lower(F.concat_ws(" ", before, after))
    entity = F.concat_ws(":", F.col("s.kind").cast("string"), "s.value").alias("entity")
    rows = rows.select(entity, "key", "row", F.xxhash64(around).alias("place"))
    # a text may hold a value more than once, and repeated rows have one key
    rows = rows.groupBy("entity", "key", "row").agg(F.min("place").alias("place"))
    return rows.groupBy("entity", "key").agg(F.count("*").alias("n"), F.min("place").alias("place"))


def sanitise(
    df: DataFrame,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    generalise_at: float = 0.8,
    remove_at: float = 0.95,
) -> DataFrame:
    """Kept columns, ``base_spans`` and ``all_spans`` (start, kind, end, value, action; places
    in code points), and ``clean_text`` for every text, row by row.

    Base spans are e-mail addresses, IP addresses, card and phone numbers, each kind by
    itself from the left; they become placeholders. A word anywhere in a text with such a value
    (of four letters, or two that do not begin in lower case) is measured against it over the
    whole table: its pointwise mutual information with the value, by
    counts of documents, as a share of the value's own information log(N / n(value)), is what
    it discloses: 1 if it never occurs without. The share counts as far as chance does not
    explain it (``_certain``). In the documents that hold the value, such a word becomes
    ``[WORD]`` from ``generalise_at`` and goes from ``remove_at``. Documents with equal
    surroundings of the value are one piece of evidence, and the first piece is where the pair
    was found: copies of one passage disclose nothing. Of overlapping spans the first is
    replaced.

    NULL and empty texts have no spans and an empty clean text. Repeated rows count as
    documents each and get equal results. A kept column named as an output gives way.
    """
    made = ("base_spans", "all_spans", "clean_text")
    keep = [c for c in dict.fromkeys(keep) if c not in made]
    docs = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    docs = docs.withColumn("key", F.xxhash64("t"))
    holders = with_base_spans(docs.select("t", "key"), "t", "base").filter(F.size("base") > 0)
    held = written(_holdings(holders), "pii-values")
    flagged = written(_flagged(docs.select("t", "key"), held, generalise_at, remove_at), "pii-terms")
    by_key = held.select("key", "entity").join(bounded(flagged), "entity")
    # a term has one action a text: the stronger
    acts = by_key.groupBy("key", "term").agg(F.max("action").alias("action"))
    acts = acts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("term", "action"))).alias("acts"))
    acts = written(acts, "pii-acts")
    out = with_base_spans(docs, "t", "base_spans").join(bounded(acts), "key", "left")
    pattern = F.concat(
        F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.transform("acts", lambda a: a["term"]), "|"), F.lit(r")(?!\p{L})")
    )
    terms = _located(F.col("t"), pattern, len(KINDS) - 1, F.lit(None).cast("string"))
    free = F.filter(
        terms,
        lambda s: ~F.exists("base_spans", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    action = lambda s: F.filter("acts", lambda a: a["term"] == F.lower(s["value"]))[0]["action"]
    acted = F.transform(free, lambda s: s.withField("action", action(s)))
    out = out.withColumn("all_spans", F.when(F.col("acts").isNull(), F.col("base_spans")).otherwise(
        F.array_sort(F.concat("base_spans", acted))
    ))
    out = out.withColumn("clean_text", F.when(F.size("all_spans") == 0, F.col("t")).otherwise(_replaced()))
    return out.select(*[F.col(f"`{c}`") for c in keep], *made)


def _flagged(texts: DataFrame, held: DataFrame, generalise_at: float, remove_at: float) -> DataFrame:
    """``entity``, ``term``, ``action``: the terms that give a value away."""
    total = float(max(texts.count(), 1))
    # one place is no evidence: its weight is 0
    entities = held.groupBy("entity").agg(F.sum("n").alias("n_e"), F.count_distinct("place").alias("places_e"))
    entities = written(entities.filter("places_e > 1"), "pii-repeated", narrow=True)
    held = written(held.join(bounded(entities.select("entity")), "entity", "left_semi"), "pii-held", narrow=True)
    keys = written(held.select("key", "n").distinct(), "pii-keys", narrow=True)
    words = F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(_WORD), F.lit(0))))
    words = texts.join(bounded(keys.select("key")), "key", "left_semi").select("key", words.alias("w"))
    words = words.groupBy("key", F.lower("w").alias("term")).agg(F.max(F.col("w").rlike(_TERM)).alias("named"))
    words = written(words, "pii-words")
    # documents that have the term beside any value: as many have it at least
    near = words.join(bounded(keys), "key").groupBy("term").agg(
        F.sum("n").alias("least"), F.count("*").alias("texts"), F.max("named").alias("named")
    )
    # told falls with n_e and is largest where all documents of the value have the term
    most = float(entities.agg(F.max("n_e")).first()[0] or 1)
    if most < total:
        near = near.filter(F.log(total / F.col("least")) >= generalise_at * F.log(F.lit(total / most)))
    near = written(near.filter("named and texts > 1").select("term", "least"), "pii-near")
    pairs = words.select("key", "term").join(bounded(near.select("term")), "term", "left_semi").join(held, "key")
    pairs = pairs.groupBy("entity", "term", "place").agg(F.sum("n").alias("n"))
    pairs = pairs.groupBy("entity", "term").agg(F.sum("n").alias("n_te"), F.count("*").alias("places"))
    pairs = pairs.filter("places > 1").join(bounded(entities), "entity").join(bounded(near), "term")
    pairs = written(pairs.filter(_weighted("least", total) >= generalise_at).drop("least"), "pii-pairs")
    terms = written(pairs.select("term").distinct(), "pii-candidates")
    words = F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(_WORD), F.lit(0)))
    words = texts.select(F.explode(words).alias("term")).join(bounded(terms), "term", "left_semi")
    n_t = words.groupBy("term").agg(F.count("*").alias("n_t"))
    told = pairs.join(n_t, "term").withColumn("told", _weighted("n_t", total))
    action = F.when(F.col("told") >= remove_at, F.lit("remove")).otherwise(F.lit("generalise"))
    return told.filter(F.col("told") >= generalise_at).select("entity", "term", action.alias("action"))


def _told(n_t: str, total: float) -> Column:
    """What a term in ``n_t`` documents tells of a value: NULL for one that all have."""
    information = F.when(F.col("n_e") < total, F.log(total / F.col("n_e")))
    return F.log(F.col("n_te") * total / (F.col(n_t) * F.col("n_e"))) / information


def _certain(n_t: str, total: float) -> Column:
    """How sure it is that a term does not stand in ``places`` of the value's ``places_e``
    places by chance: 1 less the Chernoff bound of a binomial tail. The first place is where
    the pair was found, so it does not count; a pair of one place has certainty 0."""
    tries, p = F.col("places_e") - 1, F.col(n_t) / total
    q = (F.col("places") - 1) / F.when(tries > 0, tries)
    rest = F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0.0)
    return F.when(q > p, 1 - F.exp(-tries * (q * F.log(q / p) + rest))).otherwise(0.0)


def _weighted(n_t: str, total: float) -> Column:
    """What a term tells of a value, as far as it is certain; falls with ``n_t``."""
    return _told(n_t, total) * _certain(n_t, total)


def _replaced() -> Column:
    """The text with its spans replaced."""
    t = F.col("t")

    def substitute(s: Column) -> Column:
        out = F.when(s["action"] == "remove", F.lit("")).otherwise(F.lit(GENERAL))
        for k, kind in enumerate(KINDS[:4]):
            out = F.when(s["kind"] == k, F.lit(PLACEHOLDERS[kind])).otherwise(out)
        return out

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(t, acc["at"] + 1, s["start"] - acc["at"])
        put = F.concat(acc["out"], F.array(gap, substitute(s)))
        free = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), F.when(free, put).otherwise(acc["out"]).alias("out")
        )

    return F.aggregate(
        "all_spans",
        start,
        step,
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(t, acc["at"] + 1, F.length(t))),
    )


def joined(spans: str) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def digest(df: DataFrame) -> DataFrame:
    """Counts of base spans by kind, a digest of them, and all spans as text."""
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    columns = {f"n_{kind}": count(k) for k, kind in enumerate(KINDS[:4])}
    columns["base_sha256"] = F.sha2(joined("base_spans"), 256)
    columns["spans"] = joined("all_spans")
    return df.withColumns(columns)


def clean(df: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The documents with their own columns, the text sanitised and ``n_chars``, if there is
    such a column, counted anew. A NULL text stays NULL."""
    held = df.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    found = sanitise(held, text, ("__row",), **limits)
    row = F.col("__row")
    null = row.getField(text).isNull()
    columns = {c: row.getField(c) for c in df.columns}
    columns[text] = F.when(~null, F.col("clean_text"))
    if "n_chars" in columns:
        n = F.length("clean_text").cast(df.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(null, columns["n_chars"]).otherwise(n)
    return found.select(*[c.alias(n) for n, c in columns.items()])
