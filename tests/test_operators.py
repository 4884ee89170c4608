"""Operators: properties, skew paths, edge cases."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from feedloom.functions.codes import CommentOrder
from feedloom.operators import aggregates as ag
from feedloom.operators import filters as fl
from feedloom.operators import joins as jn
from feedloom.operators import orders as od
from feedloom.operators import ranking as rk
from feedloom.operators import sets as st
from feedloom.operators import words as wd
from feedloom.operators.skew import balanced_join, hot_keys


@pytest.fixture(scope="module")
def skewed(spark):
    """9000 rows; a third of them under key 0."""
    rows = [(0 if i % 3 == 0 else i % 700, i, f"t{i}") for i in range(9000)]
    random.Random(7).shuffle(rows)
    return spark.createDataFrame(rows, "k bigint, id bigint, t string").repartition(6)


def expected_first(rows, n):
    groups = {}
    for r in sorted(rows, key=lambda r: r.id):
        groups.setdefault(r.k, []).append(r.id)
    return {i for ids in groups.values() for i in ids[:n]}


@pytest.mark.parametrize("n", [3, 60, 1200])
def test_first_n_each_way(skewed, n):
    rows = skewed.collect()
    got = rk.first_n(skewed, ["k"], [F.col("id")], n)
    assert {r.id for r in got.collect()} == expected_first(rows, n)
    assert got.columns == skewed.columns


def test_first_n_zero_is_no_cap(skewed):
    assert rk.first_n(skewed, ["k"], [F.col("id")], 0).count() == 9000


def test_caps_are_pruned_before_the_shuffle(skewed):
    plan = rk.first_n(skewed, ["k"], [F.col("id")], 5)._jdf.queryExecution().executedPlan().toString()
    partial, exchange = plan.rfind("WindowGroupLimit"), plan.rfind("hashpartitioning(k")
    assert plan.count("WindowGroupLimit") >= 2 and partial > exchange > 0


def test_numbered_matches_row_number(skewed):
    rows = rk.numbered(skewed, ["k"], [F.col("id").desc()], "n").collect()
    seen = {}
    for r in sorted(rows, key=lambda r: -r.id):
        seen[r.k] = seen.get(r.k, 0) + 1
        assert r.n == seen[r.k]
    assert len(rows) == 9000


def test_numbered_over_the_whole_table(skewed):
    rows = rk.numbered(skewed, [], [F.col("id")], "n").collect()
    assert all(r.n == r.id + 1 for r in rows)


def test_numbered_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "k bigint, id bigint")
    assert {(r.id, r.n) for r in rk.numbered(df, ["k"], [F.col("id")], "n").collect()} == {(1, 1), (2, 2), (3, 1)}


def test_children_use_up_the_cap(spark):
    df = spark.createDataFrame([("p", i, c) for i, c in enumerate([0, 3, 0, 0, None])], "p string, id int, sub int")
    kept = rk.first_n(df, ["p"], [F.col("id")], 5, children="sub").collect()
    assert sorted(r.id for r in kept) == [0, 1]  # 1 + (1 + 3) = 5 before the third
    assert sorted(r.id for r in rk.first_n(df, ["p"], [F.col("id")], 6, children="sub").collect()) == [0, 1, 2]


def test_pages(spark):
    df = spark.range(100).withColumn("k", F.lit("a"))
    def pages(n, size, start=1):
        got = rk.first_pages(df, ["k"], [F.col("id")], size, n, start).collect()
        return sorted(r.id for r in got), sorted({r.page for r in got})

    assert pages(5, 20) == (list(range(20)), [1])       # never less than a page
    assert pages(45, 20) == (list(range(40)), [1, 2])   # whole pages only
    assert pages(40, 20, 3) == (list(range(40, 80)), [3, 4])


def test_page_slices_agree(spark, monkeypatch):
    df = spark.range(500)
    near = [r.id for r in rk.page(df, [F.desc("id")], 4, 30).collect()]
    monkeypatch.setattr(rk, "TOP_ROWS", 10)
    deep = sorted((r.id for r in rk.page(df, [F.desc("id")], 4, 30).collect()), reverse=True)
    assert near == deep == list(range(409, 379, -1))


def test_daily_quota_needs_an_ordered_range(spark):
    df = spark.createDataFrame([("k", 1)], "k string, id int").withColumn("ts", F.current_timestamp())
    with pytest.raises(ValueError):
        rk.daily_quota(df, ["k"], "ts", [F.col("id")], "2024-01-02", "2024-01-01")


# --- joins ------------------------------------------------------------------


def test_hot_keys_are_found(skewed):
    hot = skewed.select(hot_keys(skewed, ["k"], 0.05).alias("h"), F.xxhash64(F.lit(0).cast("bigint")).alias("zero"))
    row = hot.first()
    assert list(row.h) == [row.zero]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, skewed, how):
    small = spark.createDataFrame([(k, f"s{k}") for k in range(0, 700, 2)], "k bigint, s string")
    plain = skewed.join(small, ["k"], how)
    salted = balanced_join(skewed, small, ["k"], how, always=True, share=0.05, scatter_by=["id"])
    assert sorted(map(tuple, salted.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_salted_join_spreads_null_keys(spark):
    big = spark.createDataFrame([(None if i % 2 else i, i) for i in range(400)], "k bigint, id bigint")
    small = spark.createDataFrame([(0, "a"), (2, "b")], "k bigint, s string")
    out = balanced_join(big, small, ["k"], "left", always=True, share=0.1)
    assert out.count() == 400 and out.where("s is not null").count() == 2


def test_salted_join_scatters_rows_with_maps(spark):
    big = spark.range(300).select(F.lit(1).alias("k"), "id", F.create_map(F.lit("a"), "id").alias("m"), F.struct(F.create_map(F.lit("a"), "id")).alias("s"))
    small = spark.createDataFrame([(1, "x")], "k int, v string")
    assert balanced_join(big, small, ["k"], always=True).where("v = 'x'").count() == 300


def test_salted_join_refuses_outer(skewed):
    with pytest.raises(ValueError):
        balanced_join(skewed, skewed, ["k"], "full_outer")


def test_attach_parent(spark):
    df = spark.createDataFrame(
        [("x", "c", "1", None, "u1"), ("x", "c", "2", "1", "u2"), ("x", "c", "3", "9", "u3")],
        "platform string, content_id string, comment_id string, parent_comment_id string, author string",
    )
    got = {r.comment_id: r.parent_author for r in jn.attach_parent(df, ["author"]).collect()}
    assert got == {"1": None, "2": "u1", "3": None}


def test_prefer(spark):
    a = spark.createDataFrame([(1, "a", None), (2, None, "y")], "id int, p string, q string")
    b = spark.createDataFrame([(2, "b"), (3, "c")], "id int, p string")
    got = sorted(map(tuple, jn.prefer(a, b, ["id"]).collect()))
    assert got == [(1, "a", None), (2, "b", "y"), (3, "c", None)]


def test_contents_of_needs_an_order_for_a_cap(skewed):
    with pytest.raises(ValueError):
        jn.contents_of(skewed, skewed, "k", "k", limit=3)


# --- filters ----------------------------------------------------------------


def test_types_with_null(spark):
    df = spark.createDataFrame([("rec_query",), ("note",), (None,)], "t string")
    assert {r.t for r in fl.drop_types(df, "t", ["rec_query", "hot_query"]).collect()} == {"note", None}
    assert {r.t for r in fl.keep_types(df, "t", ["note"]).collect()} == {"note"}


def test_split_valid_is_a_partition(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, None)], "n int, s string")
    good, bad = fl.split_valid(df, {"n": F.col("n") > 0, "s": F.col("s").isNotNull()})
    assert good.count() + bad.count() == 3
    assert {tuple(r.failed_rules) for r in bad.collect()} == {("n",), ("s",)}


def test_conform(spark):
    df = spark.createDataFrame([("12", "x"), ("bad", None)], "n string, s string")
    schema = StructType.fromDDL("n INT, s STRING, extra STRING")
    got = list(map(tuple, fl.conform(df, schema, {"n": 0, "s": ""}).collect()))
    assert got == [(12, "x", None), (0, "", None)]


@pytest.mark.parametrize("mode", ["all", "last"])
def test_long_keyword_lists_agree_with_short_ones(spark, monkeypatch, mode):
    texts = ["Ab cd", "xxAByy", "z", "éa 手机壳", "", None, "a\nb", "CDcd ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    words = ["ab", "cd", "a", "手机", "cd ab", "a\nb", "nope", "手机壳x"]
    short = fl.keyword_search(df, words, ["t"], mode)
    monkeypatch.setattr(fl, "INLINE_KEYWORDS", 2)
    long = fl.keyword_search(df, words, ["t"], mode, key=["id"])
    pairs = [sorted((r.id, r.source_keyword) for r in f.collect()) for f in (short, long)]
    assert pairs[0] == pairs[1] and pairs[0]


def test_keyword_search_checks_its_input(spark):
    df = spark.createDataFrame([(1, "a")], "id int, t string")
    assert fl.keyword_search(df, "", ["t"]).count() == 0
    with pytest.raises(ValueError):
        fl.keyword_search(df, "a", ["t"], mode="first")
    with pytest.raises(ValueError):
        fl.keyword_search(df, df.select(F.col("t").alias("source_keyword")), ["t"], mode="last")


def test_day_filter_reaches_the_scan(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = fl.in_day_range(events, "ts", "2024-01-05", "2024-01-06")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


# --- aggregates, words, sets, orders -----------------------------------------


def test_word_freq_counts_before_stop_words(spark):
    df = spark.createDataFrame([(1, "b a a"), (2, "c b the")], "id int, t string")
    freq = wd.word_freq(df, "t", ["the"], doc_order="id")
    top = [(r.word, r.n, r.first_doc, r.first_pos) for r in wd.top_words(freq, 3).collect()]
    assert top == [("b", 2, 1, 0), ("a", 2, 1, 1), ("c", 1, 2, 0)]
    by_text = wd.word_freq(df.withColumn("id", F.col("id").cast("string")), "t", ["the"], doc_order="id")
    assert [r.word for r in wd.top_words(by_text, 3).collect()] == ["b", "a", "c"]


def test_long_stop_lists_are_joined(spark):
    df = spark.createDataFrame([("w1 w2 keep",)], "t string")
    stop = [f"w{i}" for i in range(1500)]
    assert [r.word for r in wd.word_freq(df, "t", stop).collect()] == ["keep"]


def test_run_ordinal(spark):
    names = spark.createDataFrame([("3_search_x.csv",), ("12_a.csv",), ("readme",)], "name string")
    assert ag.next_run_ordinal(names).first().ordinal == 13
    assert ag.next_run_ordinal(names, strict=True).first().ordinal == 1
    assert ag.next_run_ordinal(names.where("false")).first().ordinal == 1


def test_latest_unexpired_last_set_wins(spark):
    rows = [("a", "old", 0, 100), ("a", "new", 50, 10), ("b", "v", 55, 10), ("c", "late", 99, 10)]
    df = spark.createDataFrame(rows, "k string, v string, s long, ttl long").select(
        "k", "v", F.timestamp_seconds("s").alias("ts"), F.make_dt_interval(secs="ttl").alias("ttl")
    )
    got = ag.latest_unexpired(df, ["k"], "v", "ts", F.col("ttl"), F.timestamp_seconds(F.lit(61)))
    assert [(r.k, r.v) for r in got.collect()] == [("b", "v")]  # a's last set ran out, c is not set yet
    assert {r.k for r in ag.keys_like(df, "k", "*").collect()} == {"a", "b", "c"}
    assert {r.k for r in ag.keys_like(df, "k", "a*").collect()} == {"a"}


def test_contact_edges_are_unique_and_stable(spark):
    schema = "up_id int, fan_id int, up_name string"
    fans = spark.createDataFrame([(1, 2, "x"), (1, 2, "y")], schema)
    followings = spark.createDataFrame([(1, 2, "a"), (2, 1, "z")], schema)
    assert sorted(map(tuple, st.contact_edges(fans, followings).collect())) == [(1, 2, "a"), (2, 1, "z")]


def test_flatten_comments(spark):
    schema = "note string, id string, subs array<struct<id: string, x: int>>"
    df = spark.createDataFrame([("n", "1", [("1a", 0), ("1b", 0)]), ("n", "2", []), ("n", "3", None)], schema)
    got = sorted(map(tuple, st.flatten_comments(df, "subs", ["note"]).collect()))
    assert got == [("n", 1, "1"), ("n", 1, "2"), ("n", 1, "3"), ("n", 2, "1a"), ("n", 2, "1b")]


def test_comment_orders(spark):
    df = spark.createDataFrame([("a", 1, 5), ("b", 9, 1), ("c", 9, 2)], "comment_id string, like_count int, created_ts int")
    def ids(how):
        return [r.comment_id for r in od.order_comments(df, how).collect()]

    assert ids(CommentOrder.HEAT) == ["b", "c", "a"]
    assert ids(CommentOrder.HEAT_THEN_TIME) == ["c", "b", "a"]
    assert ids(CommentOrder.TIME) == ["a", "c", "b"]


def test_sort_codes_of_platforms(spark):
    df = spark.createDataFrame([("a", 1, 5), ("b", 9, 1)], "content_id string, like_count int, created_ts int")
    first = {code: od.order_content(df, code).first().content_id for code in (("xhs", "popularity_descending"), ("tieba", "1"), ("tieba", "0"))}
    assert first == {("xhs", "popularity_descending"): "b", ("tieba", "1"): "a", ("tieba", "0"): "b"}


@pytest.mark.parametrize("mode", ["all", "last"])
def test_many_keywords_on_batch_and_stream(spark, tmp_path, mode):
    """More keywords than one projection tests: the same rows from grams and from the trie."""
    import random

    from feedloom.operators import filters as fl
    from feedloom.streaming import ingest

    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdé的 ") for _ in range(rng.randint(1, n)))
    keywords = list(dict.fromkeys(word(6).upper() for _ in range(400)))
    rows = [(i, word(40)) for i in range(300)] + [(300, None), (301, "")]
    df = spark.createDataFrame(rows, "id int, text string")
    path = str(tmp_path / "in")
    df.repartition(3).write.parquet(path)
    want = []
    for i, t in rows:
        hits = [k for k in keywords if t and k.lower() in t.lower()]
        want += [(i, k) for k in (hits if mode == "all" else hits[-1:])]
    assert len([k for k in keywords if k]) > fl.INLINE_KEYWORDS
    batch = fl.keyword_search(df, keywords, ["text"], mode).select("id", "source_keyword")
    assert sorted(map(tuple, batch.collect())) == sorted(want)
    stream = ingest.read_stream(spark, path, "id int, text string", files_per_trigger=1)
    found = []
    tagged = fl.keyword_search(stream, keywords, ["text"], mode).select("id", "source_keyword")
    ingest.stream_ingest(tagged, lambda b, _: found.extend(map(tuple, b.collect())), str(tmp_path / "cp")).awaitTermination()
    assert sorted(found) == sorted(want)


@pytest.mark.parametrize("mode", ["all", "last"])
@pytest.mark.parametrize("held, sent", [(1 << 20, 0), (0, 1 << 20), (0, 0)])
def test_many_keywords_do_not_move_texts(spark, monkeypatch, mode, held, sent):
    """Held by the workers, sent to the texts, or met by gram: the same rows; texts are exchanged
    by gram the last way only, which keywords without bound need."""
    from feedloom.operators import filters as fl

    monkeypatch.setattr(fl, "TRIE_CHARACTERS", held)
    monkeypatch.setattr(fl, "SENT_CHARACTERS", sent)
    texts = ["ab No 7 cd", "AB", None, "", "ab No 7 cd", "z no 12"]
    df = spark.createDataFrame([(i % 4 or None, t) for i, t in enumerate(texts)], "id int, t string")
    words = [f"No {i}" for i in range(250)] + ["ab", "Ab", "zz", "d"]
    hits = fl.keyword_search(df, words, ["t"], mode).select("id", "source_keyword")
    want = []
    for i, t in enumerate(texts):
        found = [w for w in words if t and w.lower() in t.lower()]
        want += [(i % 4 or None, w) for w in (found if mode == "all" else found[-1:])]
    assert sorted(map(tuple, hits.collect()), key=str) == sorted(want, key=str)
    if held or sent:
        tree = hits._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [_gram" not in tree
        assert not held or "Exchange" not in tree


def test_very_many_keywords(spark):
    """Two hundred thousand keywords: one exchange by gram, and the sketch's size is fixed."""
    from feedloom.operators import filters as fl

    keywords = spark.range(200_000).select(F.concat(F.lit("the key "), F.hex(F.col("id") * 7919)).alias("source_keyword"))
    texts = spark.range(400).select("id", F.concat(F.lit("x the key "), F.hex(F.col("id") * 7919 * 400), F.lit(" end")).alias("text"))
    hits = fl.keyword_search(texts, keywords, ["text"])
    got = {(r.id, r.source_keyword) for r in hits.select("id", "source_keyword").collect()}
    names = {f"the key {i * 7919:X}" for i in range(200_000)}
    want = set()
    for i in range(400):
        code = f"{i * 7919 * 400:X}"
        want |= {(i, f"the key {code[:n]}") for n in range(1, len(code) + 1) if f"the key {code[:n]}" in names}
    assert got == want
