import re
from collections import Counter

import odd
import pytest
from feedloom.llm import rules
from pyspark.sql import functions as F

OTHER = "Then comes another line, quite unlike what stood before it, and with enough to say."
GOOD = "The first sentence of a page that has some words. And a second one, as is fit for prose."


def reference(text):
    text = text or ""
    words = odd.WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if odd.WORD.search(x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
        len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words),
    )


def test_base_columns(spark):
    more = ["a b c d e f g h " * 3, "a b c d e f g h\ti\n" * 2 + "x " * 40, GOOD + "\n" + GOOD, "one " * 8 + "two " * 9 + GOOD * 3]
    rows = [(i, t) for i, t in enumerate([*odd.texts(), *more])]
    docs = odd.documents(spark, [*rows, rows[5], (None, None)])
    got = rules.assess(docs, keep=("doc_id", "text", "kept", "odd name.x")).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == reference(r.text)
        assert not (r.base_failed and r.kept)
    assert rules.assess(odd.empty(spark)).collect() == []


@pytest.mark.parametrize(
    "line, falls",
    [
        (GOOD, False), ("Home", True), ("Yes.", False), ("All rights reserved.", True), ("a | b | c | d | e | f", True),
        ("word*** other### third%%% and$$$ more&&&", True), ("THIS IS ALL IN CAPITALS NOW.", True), ("LOUD!! VERY!! LOUD!! WORDS!! HERE!!", True),
        ("again again again again again again", True), ("He paid 5% & left the town.", False), ("a-b - c and d over there today.", False),
        ("Read more", True), ("They read more of the book, as all who had come to the reading of that long evening did.", False),
    ],
)
def test_lines(spark, line, falls):
    row = spark.createDataFrame([(line,)], "l string").select(rules.line_fails(F.col("l"), rules.split_words(F.col("l"))))
    assert row.first()[0] is falls


def test_lines_fall_before_documents(spark):
    text = "\n".join(["Home | News | Sport | Shop | Help", GOOD, "All rights reserved.", "", OTHER])
    mostly = "\n".join([GOOD] + [f"menu{i} | {i}x | y{i} | z{i}z | w" for i in range(30)])
    docs = odd.documents(spark, [(1, text), (2, mostly), (3, None), (4, GOOD + " " + GOOD.upper()[:20])])
    got = {r.doc_id: r for r in rules.assess(docs).collect()}
    assert got[1].kept and got[1].clean_text == "\n".join([GOOD, "", OTHER])
    assert not got[2].kept and not got[2].base_failed
    assert not got[3].kept and got[3].clean_text == ""
    kept = rules.clean(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1, 4]


def test_no_python_and_no_shuffle(spark):
    plan = rules.assess(odd.documents(spark).filter("doc_id > 0"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|InArrow|Exchange", plan)
