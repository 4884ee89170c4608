"""Dictionary tokens: those of the pattern at any list, for lists of any size."""

import random

import pytest
from feedloom.functions.text import tokens
from feedloom.operators import dictionary
from feedloom.operators.words import word_freq
from pyspark.sql import functions as F

LETTERS = [*"ab Aé1.+-#的世界和\n", "世界", "ab", "C++", " b"]


def text(rng, n):
    return "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, n)))


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("han", ["char", "bigram"])
def test_as_the_pattern(spark, seed, han):
    rng = random.Random(seed)
    entries = [w for w in {text(rng, 4) for _ in range(rng.choice([1, 5, 30]))} if w]
    rows = [(i, text(rng, 30)) for i in range(150)] + [(150, None), (151, "")]
    df = spark.createDataFrame(rows, "id int, t string")
    own = dictionary.with_dictionary(spark, entries, han)
    for r in df.select("t", tokens("t", entries, han).alias("want"), own(F.col("t")).alias("got")).collect():
        assert r.got == (r.want or []), (r.t, entries)


def test_a_large_dictionary(spark):
    """A hundred thousand entries: the plan holds none, and each is found."""
    entries = [f"词{i}条 {i % 7}" for i in range(100_000)]
    table = spark.createDataFrame([(e,) for e in entries], "entry string").repartition(4)
    own = dictionary.with_dictionary(spark, table)
    few = dictionary.with_dictionary(spark, entries[:3])
    df = spark.createDataFrame([(e + " x " + entries[-1],) for e in entries[::5000]], "t string")
    size = lambda tokenizer: len(df.select(tokenizer(F.col("t")))._jdf.queryExecution().toString())
    assert abs(size(own) - size(few)) < 200
    for r in df.select("t", own(F.col("t")).alias("w")).collect():
        assert r.w == [r.t.split(" x ")[0], "x", entries[-1]]
    counts = {r.word: r.n for r in word_freq(df, "t", tokenizer=own).select("word", "n").collect()}
    assert counts[entries[-1]] == 20 and counts["x"] == 20


def test_limits(spark, monkeypatch):
    monkeypatch.setattr(dictionary, "MOST_CHARACTERS", 5)
    for entries in (["abc", "def"], spark.createDataFrame([("abc",), ("def",)], "w string")):
        with pytest.raises(ValueError):
            dictionary.with_dictionary(spark, entries)
    with pytest.raises(ValueError):
        dictionary.with_dictionary(spark, [], "word")
    none = dictionary.with_dictionary(spark, spark.createDataFrame([], "w string"))
    assert spark.createDataFrame([("a 的b",)], "t string").select(none(F.col("t"))).first()[0] == ["a", "的", "b"]


@pytest.mark.parametrize("seed", range(4))
def test_found_everywhere(seed):
    """Entries that a text contains, few and many that begin alike, overlapping ones too."""
    rng = random.Random(seed)
    entries = {text(rng, 5) for _ in range(400)} - {""}
    trie = dictionary.Trie(entries)
    assert trie.alike and len(trie.alike) < len(trie.pairs)
    for t in [text(rng, 60) for _ in range(200)] + ["", "a", "aaaa"]:
        assert trie.found(t) == {e for e in entries if e in t}
