"""Responses, embedded state, HTML pages, seeds."""

import time

import pytest

from feedloom.normalize import tieba, xhs, zhihu
from feedloom.plans.detail import zhihu_details
from feedloom.sources import responses as rs
from feedloom.sources import tables as tb
from feedloom.sources.embedded import embedded_json, xhs_note_payload
from feedloom.sources.pages import PageSpec, Step, Take, at, page_records, parse_html
from pyspark.sql import functions as F

ENVELOPES = {
    "xhs": ('{"success":true,"data":{"a":1}}', '{"success":false,"code":1,"msg":"m"}', '{"success":true,"da'),
    "bili": ('{"code":0,"data":{"a":1}}', '{"code":-1,"message":"m"}', '{"code":0'),
    "ks": ('{"data":{"a":1}}', '{"errors":["e"]}', "[1"),
    "wb": ('{"ok":1,"data":{"a":1}}', '{"ok":0,"msg":"m"}', "x"),
    "zhihu": ('{"data":[]}', '{"error":{"message":"m"}}', '{"data":['),
    "dy": ('{"a":1}', "blocked", ""),
    "tieba": ("<html>", "blocked", ""),
}


@pytest.mark.parametrize("platform", ENVELOPES)
def test_envelopes(spark, platform):
    bodies = [(i, b) for i, b in enumerate(ENVELOPES[platform])] + [(3, None)]
    df = spark.createDataFrame(bodies, "i int, body string")
    ok, failed = rs.unwrap_envelope(df, platform)
    assert [r.i for r in ok.collect()] == [0]
    assert sorted(r.i for r in failed.collect()) == [1, 2, 3]
    assert all(r.error is not None for r in failed.collect())


def test_read_responses(spark, tmp_path):
    (tmp_path / "a.txt").write_text('{"x":1}\n{"x":2}\n')
    lines = rs.read_responses(spark, str(tmp_path), "xhs", "note")
    assert lines.columns == ["platform", "kind", "path", "fetched_at", "body"]
    assert lines.count() == 2 and rs.read_responses(spark, str(tmp_path), "xhs", "note", per_file=True).count() == 1
    with pytest.raises(ValueError):
        rs.read_responses(spark, str(tmp_path), "nowhere", "note")


def test_embedded_state(spark):
    page = '<script>window.__INITIAL_STATE__={"note":{"noteDetailMap":{"n1":{"note":{"noteId":"n1","title":"题"}}}},"x":undefined}</script><script>var b={};</script>'
    df = spark.createDataFrame([(page,), ("<p>captcha</p>",), ("<script>window.__INITIAL_STATE__={}</script>",)], "html string")
    assert [r[0] for r in df.select(xhs_note_payload("html", F.lit("n1"))).collect()] == ['{"noteId":"n1","title":"题"}', None, None]
    wb = 'a\nvar $render_data = [{"status":\n{"id":"7"}}][0] || {};'
    assert spark.range(1).select(embedded_json(F.lit(wb), "wb")).first()[0] == '[{"status":\n{"id":"7"}}]'


def test_page_walker_on_broken_markup():
    spec = PageSpec(blocks=((at("ul", id="x"), at("li", child=True)),), fields={
        "text": Take((at("a"),)), "href": Take((at("a"),), "href"), "cls": Take((), "class"), "html": Take((at("b"),), "html"),
    })
    page = '''<!DOCTYPE html><!-- <ul id="x"><li>no</li></ul> --><script>if (a<b) "<ul id='x'>"</script>
      <UL id=x><LI class="a  "><a href='p?a=1&amp;b=2' title="a>b">A &amp; <i>i</i>tail</a></b><b>x<i>y</b>
      <li class=c><p>z</ul><li>out</li>'''
    rows = page_records(page, spec)
    assert [(r["text"], r["href"], r["cls"]) for r in rows] == [("A & ", "p?a=1&b=2", "a  "), ("", "", "c")]
    assert rows[0]["html"] == "<b>x<i>y</b>"
    assert page_records("", spec) == [] and page_records("<<<a <", spec) == []


def test_page_walker_is_linear_on_bad_nesting():
    import time

    spec = PageSpec(blocks=((at("em"),),), fields={"t": Take(())})
    start = time.time()
    page_records("<b>" * 20000 + "</i>" * 20000, spec)
    assert time.time() - start < 5


def test_nth_child_paths():
    spec = PageSpec(blocks=((at("div", cls="t"), at("a", child=True, nth=1)),), fields={"href": Take((), "href")})
    page = '<div class="t"><a href="1"></a><a href="2"></a></div><div class="t"><i><a href="3"></a></i><a href="4"></a></div>'
    assert [r["href"] for r in page_records(page, spec)] == ["1", "4"]


def test_parse_html_keeps_columns_and_skips_null(spark):
    df = spark.createDataFrame([(1, None), (2, "<a href=x>t</a><a>u</a>"), (3, "none")], "id bigint, html string")
    spec = PageSpec(blocks=((at("a"),),), fields={"text": Take(()), "href": Take((), "href")})
    got = sorted(map(tuple, parse_html(df, spec).collect()))
    assert got == [(2, 0, "t", "x"), (2, 1, "u", "")]


def test_tieba_creator_needs_two_relation_nodes(spark):
    def page(n):
        nodes = "".join(f'<span class="concern_num">(<a href="#">{i + 4}</a>)</span>' for i in range(n))
        return f'<p class="space"><a href="/home/main?un=a&id=7">x</a></p>{nodes}'

    df = spark.createDataFrame([(page(n),) for n in (1, 2, 3)], "html string")
    assert [(r.follows, r.fans, r.user_id) for r in tieba.normalize_creator(df).collect()] == [(0, 0, "7"), (4, 5, "7"), (0, 0, "7")]


def test_tieba_replies_first_block_first(spark):
    page = ('<li class="lzl_single_post j_lzl_s_p " data-field="{&quot;spid&quot;:&quot;2&quot;}"><span class="lzl_content_main">b</span></li>'
            '<li class="lzl_single_post j_lzl_s_p first_no_border" data-field="{\'spid\':\'1\'}"></li>'
            '<li class="lzl_single_post j_lzl_s_p first_no_border" data-field=\'{"spid":"1","showname":"某"}\'><span class="lzl_content_main">a<br>x</span></li>')
    parent = {c: "p" for c in tieba.INHERITED}
    df = spark.createDataFrame([("c", *parent.values(), page)], ", ".join(f"{c} string" for c in ["parent_comment_id", *parent, "html"]))
    got = [(r.comment_id, r.content, r.user_nickname, r.note_id) for r in tieba.normalize_reply(df).collect()]
    assert got == [("1", "ax", "某", "p"), ("2", "b", "", "p")]


def test_seeds(spark):
    assert [r.source_keyword for r in tb.seeds(spark, "a,b,,a", "keyword").collect()] == ["a", "b"]
    assert tb.seeds(spark, ["https://h/p/9?x=1"], "url").first().id == "9"
    note = tb.seeds(spark, ["https://h/explore/n1?xsec_token=t"], "note_url").first()
    assert (note.note_id, note.xsec_token, note.xsec_source) == ("n1", "t", "")
    z = tb.seeds(spark, ["https://www.zhihu.com/question/5/answer/6?a=1"], "zhihu_url").first()
    assert (z.id, z.content_type, z.question_id) == ("6", "answer", "5")
    with pytest.raises(ValueError):
        tb.seeds(spark, ["x"], "planet")


def test_json_array_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n {"id": "1", "n": 2},\n {"id": "2"}\n]')
    (tmp_path / "b.json").write_text('[{"id": "3", "n": 4}]')
    assert sorted(map(tuple, tb.read_json_array(spark, str(tmp_path), "id string, n int").collect())) == [("1", 2), ("2", None), ("3", 4)]
    assert {r.name for r in tb.file_names(spark, str(tmp_path)).collect()} == {"a.json", "b.json"}


def test_detail_flow(spark):
    state = '<script id="js-initialData" type="text/json">{"initialState":{"entities":{"answers":{"6":{"id":"6","type":"answer","question":{"id":"5"},"content":"<p>hi</p>"}}}}}</script>'
    pages = spark.createDataFrame([("https://www.zhihu.com/question/5/answer/6", state)], "url string, html string")
    seeds = spark.createDataFrame([("https://www.zhihu.com/question/5/answer/6?from=x",), ("https://zhuanlan.zhihu.com/p/9",)], "url string")
    result = zhihu_details(seeds, pages)
    assert [(r.content_id, r.content_text) for r in result.content.collect()] == [("6", "hi")]
    assert [r.url for r in result.not_found.collect()] == ["https://zhuanlan.zhihu.com/p/9"]


def test_payload_items(spark):
    ok, _ = rs.unwrap_envelope(spark.createDataFrame([('{"success":true,"data":{"items":[{"id":"1","pictures":[]},{"id":"2"}]}}',)], "body string"), "xhs")
    comments = xhs.normalize_comment(rs.explode_payload(ok, "items"))
    assert [r.comment_id for r in comments.collect()] == ["1", "2"]


def test_zhihu_creator_of_other_page(spark):
    page = '<script id="js-initialData">{"initialState":{"entities":{"users":{"a":{"id":"1","name":"n"}}}}}</script>'
    df = spark.createDataFrame([("a", page), ("b", page), ("c", "<p>")], "url_token string, html string")
    assert [(r.user_id, r.url_token) for r in zhihu.normalize_creator(df).collect()] == [("1", "a")]


def test_page_notes_fill_gaps_of_the_api(spark):
    from feedloom.plans.detail import xhs_details

    state = ('{"note":{"noteDetailMap":{"n1":{"note":{"noteId":"n1","title":"页","desc":"d","xsecToken":"t","user":{"userId":"u","nickname":"k"},'
             '"interactInfo":{"likedCount":"5"},"imageList":[{"urlDefault":"i"}],"tagList":[{"name":"x","type":"topic"}]}}}},"a":undefined}')
    page = f"<script>window.__INITIAL_STATE__={state}</script>"
    pages = spark.createDataFrame([("n1", page), ("n2", "captcha")], "note_id string, html string")
    notes = xhs.normalize_note(xhs.page_notes(pages)).collect()
    assert [(n.note_id, n.title, n.user_id, n.liked_count, n.image_list, n.tag_list, n.xsec_token) for n in notes] == [("n1", "页", "u", "5", "i", "x", "t")]
    api = spark.createDataFrame([('{"note_id":"n1","title":"api"}',), ('{"note_id":"n3"}',)], "payload string")
    got = {r.note_id: (r.title, r.user_id) for r in xhs_details(api, pages).collect()}
    assert got == {"n1": ("api", "u"), "n3": ("", None)}


def test_zhihu_page_names_in_either_case(spark):
    state = ('{"initialState":{"entities":{"answers":{"6":{"id":"6","type":"answer","question":{"id":"5"},"voteupCount":3,"created_time":8,'
             '"author":{"id":"u","urlToken":"tok","name":"n"}}}}}}')
    pages = spark.createDataFrame([(f'<script id="js-initialData">{state}</script>',)], "html string")
    r = zhihu.normalize_content(zhihu.page_records(pages, "answer")).first()
    assert (r.voteup_count, r.created_time, r.user_url_token, r.user_id) == (3, 8, "tok", "u")


def test_wb_search_cards_and_pages(spark):
    from feedloom.normalize import wb

    cards = spark.createDataFrame([('{"card_type":9,"mblog":{"id":"1","text":"a"},"card_group":[{"card_type":9,"mblog":{"id":"2"}}]}', "kw")], "payload string, source_keyword string")
    rows = wb.normalize_note(wb.search_records(cards)).collect()
    assert sorted((r.note_id, r.source_keyword) for r in rows) == [("1", "kw"), ("2", "kw")]
    page = 'var $render_data = [{"status":{"id":"7","text":"<b>x</b>"}}][0] || {};'
    pages = spark.createDataFrame([(page,), ("none",)], "html string")
    assert [(r.note_id, r.content) for r in wb.normalize_note(wb.page_notes(pages)).collect()] == [("7", "x")]


def test_xhs_creator_pages(spark):
    page = '<script>window.__INITIAL_STATE__={"x":undefined,"user":{"userPageData":{"basicInfo":{"nickname":"名","gender":1},"interactions":[{"type":"fans","count":"3"}]}}}</script>'
    pages = spark.createDataFrame([("u1", page), ("u2", "captcha")], "user_id string, html string")
    rows = xhs.normalize_creator(xhs.page_creators(pages)).collect()
    assert [(r.user_id, r.nickname, r.gender, r.fans) for r in rows] == [("u1", "名", "F", "3")]


def test_ids_of_pages_keep_every_bit(spark):
    spec = PageSpec(blocks=((Step("p"),),), fields={"t": Take(())})
    rows = [(9007199254740993, "<p>a</p><p>b</p>"), (None, "<p>c</p>"), (9007199254740995, None)]
    got = parse_html(spark.createDataFrame(rows, "page_id long, html string"), spec).select("page_id", "record_pos", "t")
    assert sorted(map(tuple, got.collect()), key=str) == [(9007199254740993, 0, "a"), (9007199254740993, 1, "b"), (None, 0, "c")]


@pytest.mark.parametrize("part", ["<a ", "<!", "</b", "<a \"x"])
def test_unclosed_pages_are_linear(part):
    def seconds(n):
        start = time.process_time()
        page_records(part * n, PageSpec(blocks=((Step("p"),),), fields={}))
        return time.process_time() - start

    seconds(1000)
    assert seconds(40_000) < 8 * seconds(10_000) + 0.2


def test_pages_as_field_by_field():
    """Fields whose paths begin alike are read together: as each field alone, on pages of any shape."""
    import random

    from feedloom.normalize import tieba

    rng = random.Random(5)
    specs = [tieba.SEARCH_PAGE, tieba.DETAIL_PAGE, tieba.POSTS_PAGE, tieba.REPLIES_PAGE, tieba.CREATOR_PAGE]
    steps = [s for spec in specs for path in (*spec.blocks, *(t.path for t in spec.fields.values())) for s in path]
    values = [' %s="%s"' % a for s in steps for a in s.attrs] + [" class=p_title", ' class="a&amp;b" href="/home/main?x"', " /", ""]
    tags = [s.tag for s in steps if s.tag] + ["br", "script", "b"]

    def piece():
        tag = rng.choice(tags)
        return rng.choice([f"<{tag}{rng.choice(values)}>", f"<{tag}{rng.choice(values)}{rng.choice(values)}>", f"</{tag}>", "x &amp; ", "<!-- <a> -->"])

    for _ in range(400):
        page = "".join(piece() for _ in range(rng.randint(0, 60)))
        for spec in specs:
            got = page_records(page, spec)
            for name, take in spec.fields.items():
                alone = page_records(page, PageSpec(spec.blocks, {name: take}))
                assert [r[name] for r in got] == [r[name] for r in alone]


def test_a_lone_attribute_is_read_as_any():
    """The short way for an element with one attribute finds what the long way finds."""
    for value in ("a b", "a&b", 'a"b', "ü", ""):
        step = at("p", cls=value)
        for raw in (f'<p class="{value}">', f"<p class='{value}'>", f'<p id=x class="{value}">', f'<p CLASS="{value}">'):
            got = page_records(raw + "t</p>", PageSpec(blocks=((step,),), fields={"c": Take((), "class")}))
            assert [r["c"] for r in got] in ([value], []) and (got or '"' in value)


def test_a_page_is_read_in_time():
    """Paths that begin alike are sought once, whatever the number of fields."""
    from feedloom.sources import pages as pg

    calls = []
    plain = pg._step
    path = (at("div"), at("span", cls="x"))
    spec = PageSpec(blocks=((),), fields={f"f{i}": Take(path, index=i) for i in range(20)})
    pg._step = lambda *a: calls.append(1) or plain(*a)
    try:
        row = page_records("<div>" + '<span class="x">y</span>' * 20 + "</div>", spec)[0]
    finally:
        pg._step = plain
    assert set(row.values()) == {"y"} and len(calls) == 2
