"""Scalar functions on hand-made values."""

import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from feedloom.functions import codes, nested, times
from feedloom.functions import text as tx

lit = F.lit


def test_strip_html(one):
    page = "<p> a<b>b</b></p>\n<script>x<y</script><STYLE>s</STYLE><style\n>q</style>&amp; 　"
    assert one(tx.strip_html(lit(page))) == "ab\ns&amp;"
    assert one(tx.strip_html(lit(None).cast("string"))) == ""
    assert one(tx.strip_html(lit(""))) == ""


def test_strip_tags_short_stays_on_a_line(one):
    assert one(tx.strip_tags_short(lit("a<b>c<d\n>e<f\r>g"))) == "ac<d\n>eg"


@pytest.mark.parametrize("raw,want", [("1.2万", 1), ("赞 35", 35), ("x", 0), ("", 0), (None, 0), ("9" * 30, 0)])
def test_first_int(one, raw, want):
    assert one(tx.first_int(lit(raw).cast("string"))) == want


def test_url_params(one):
    url = lit("https://h/p?x=1&y=%20z+k&x=3&e=&lone&b=c=d&bad=%zz#f?q=1")
    assert one(tx.url_params(url)) == {"x": "3", "y": " z k", "b": "c=d", "bad": "%zz"}
    assert one(tx.url_params(lit("no query"))) == {}
    assert one(tx.url_params(lit(None).cast("string"))) == {}


def test_note_ref_ignores_slashes_in_the_query(one):
    ref = one(tx.note_ref(lit("https://h/explore/abc?xsec_token=A/B=&xsec_source=pc")))
    assert tuple(ref) == ("abc", "A/B=", "pc")


def test_url_kind(one):
    urls = ["/question/1/answer/2", "/p/3", "/zvideo/4", "/people/x"]
    assert one(*[tx.url_kind(lit(u)) for u in urls]) == ("answer", "article", "zvideo", "")


def test_kv_text(one):
    raw = "a1=x000101360; webId=1190c4d3cxxxx125xxx; "
    assert one(tx.kv_to_map(lit(raw))) == {"a1": "x000101360", "webId": "1190c4d3cxxxx125xxx"}
    assert one(tx.kv_to_map(lit("a=1=2;;b;c=3;c=4"))) == {"c": "4"}
    assert one(tx.map_to_kv(F.create_map(lit("a"), lit("1"), lit("b"), lit("2")))) == "a=1;b=2"


def test_asset_urls(one):
    plain, spectrum = lit("https://h/abc-1"), lit("https://h/spectrum/abc-1")
    assert one(tx.trace_id(plain), tx.trace_id(spectrum)) == ("abc-1", "spectrum/abc-1")
    assert one(tx.image_urls(tx.trace_id(plain)))[0] == "https://sns-img-qc.xhscdn.com/abc-1?imageView2/format/png"
    assert len(one(tx.image_urls(lit("a")))) == 4


def test_mail_times(one):
    raw = lit("Sat Dec 23 17:12:54 +0800 2023")
    assert one(times.mail_instant(raw), times.mail_wallclock_epoch(raw), times.mail_china_text(raw)) == (
        1703322774, 1703351574, "2023-12-23 17:12:54+08:00",
    )
    assert one(times.mail_instant(lit("nonsense"))) is None


def test_epochs(one):
    assert one(times.epoch_text(lit(1701493264)), times.epoch_text(lit(1701493264496))) == (
        "2023-12-02 05:01:04", "2023-12-02 05:01:04",
    )
    assert one(times.epoch_text(lit(1701493264), "+08:00")) == "2023-12-02 13:01:04"
    assert one(times.epoch_day(lit(1701493264))) == "2023-12-02"
    assert one(times.text_epoch(lit("2023-12-02 05:01:04")), times.text_epoch(lit("x"))) == (1701493264, 0)


def test_day_bounds_and_series(one):
    day = lit("2024-01-05")
    assert one(times.day_begin(day), times.day_end(day)) == (1704412800, 1704499199)
    assert len(one(times.day_series("2024-02-27", "2024-03-01"))) == 4
    with pytest.raises(ValueError):
        times.day_series("2024-03-01", "2024-02-27")


def test_now_is_injected(one):
    assert one(times.now_ms(5)) == 5
    assert one(times.now_ms()) > 1_700_000_000_000


def test_largest(one):
    def streams(*pairs):
        return F.array(*[F.struct(lit(a).cast("bigint").alias("size"), lit(u).alias("url")) for a, u in pairs])

    assert one(nested.largest(streams((1, "a"), (5, "b"), (5, "c")))) == "b"
    assert one(nested.largest(streams((None, "a")))) == ""
    assert one(nested.largest(F.filter(streams((1, "a")), lambda x: lit(False)))) == ""


def test_array_picks(one):
    a = F.array(lit("x"), lit("y"), lit("z"))
    none = F.array().cast("array<string>")
    assert one(nested.second(a), nested.last_of_many(a), nested.last_of_many(F.array(lit("x")))) == ("y", "z", None)
    assert one(nested.first_filled(none, lit(None).cast("array<string>"), a)) == ["x", "y", "z"]
    assert one(nested.take(a, 2)) == ["x", "y"]
    assert one(nested.join_list(F.array(lit("a"), lit(None), lit("b")))) == "a,,b"
    assert one(nested.join_list(lit(None).cast("array<string>"))) == ""


def test_snake_names():
    names = ["noteDetailMap", "IPLocation", "ipLocation", "note_id", "userID", "h264Url"]
    assert [nested.snake_case(n) for n in names] == [
        "note_detail_map", "ip_location", "ip_location", "note_id", "user_id", "h264url",  # no split after a digit
    ]
    deep = StructType.fromDDL("aB ARRAY<STRUCT<cD: MAP<STRING, STRUCT<eF: INT>>>>")
    assert nested.snake_schema(deep).simpleString() == "struct<a_b:array<struct<c_d:map<string,struct<e_f:int>>>>>"


def test_default_chains(one):
    assert one(nested.text_or(lit(""), lit(None).cast("string"), lit("c"))) == "c"
    assert one(nested.text_or(lit("a"), lit("c"))) == "a"
    assert one(nested.first_nonzero(lit(0).cast("bigint"), lit(7).cast("bigint"))) == 7
    assert one(nested.number_or_zero(lit("abc")), nested.number_or_zero(lit("12"))) == (0, 12)


def test_gender_codes(one):
    assert one(codes.gender("xhs", lit(1)), codes.gender("xhs", lit(9)), codes.gender("dy", lit(9))) == ("F", None, "unknown")
    assert one(codes.gender("ks", lit(None).cast("string"))) == "M"


def test_tokens(one):
    assert one(tx.tokens(lit("Hello, 世界 42x é"))) == ["Hello", "世", "界", "42x", "é"]
    assert one(tx.tokens(lit("我爱世界和平"), han="bigram")) == ["我爱", "爱世", "世界", "界和", "和平"]
    assert one(tx.tokens(lit("界"), han="bigram")) == ["界"]
    assert one(tx.tokens(lit("我爱世界和平 abc"), ["世界", "世界和"])) == ["我", "爱", "世界和", "平", "abc"]
    assert one(tx.tokens(lit("c++ or xc++ in c"), ["c++"])) == ["c++", "or", "xc", "in", "c"]
    assert one(tx.tokens(lit("零跑 foobar foo"), ["foo"])) == ["零", "跑", "foobar", "foo"]
    with pytest.raises(ValueError):
        tx.tokens(lit("x"), han="word")


def test_html_unescape(one):
    assert one(tx.html_unescape(lit("&lt;a&gt; &amp;amp; &#20013;"))) == "<a> &amp; 中"
    assert one(tx.html_unescape(lit(None).cast("string"))) is None


def test_repair_undefined(one):
    assert one(tx.repair_undefined(lit('{"a":undefined}'), True)) == '{"a":""}'
    assert one(tx.repair_undefined(lit('{"a":undefined,"b":"undefined"}'), False)) == '{"a":null,"b":"undefined"}'


def test_bad_markup_costs_linear_time(one):
    import time

    cases = ["<" * 300_000, "a<b\n" * 50_000, "x" + " " * 300_000 + "y", "<>" * 100_000, "<" * 300_000 + ">"]
    start = time.time()
    got = [one(tx.strip_html(lit(c)), tx.strip_tags_short(lit(c))) for c in cases]
    assert time.time() - start < 20
    assert [len(a) for a, _ in got] == [300_000, 199_999, 300_002, 200_000, 0]
    assert [len(b) for _, b in got] == [300_000, 200_000, 300_002, 0, 0]


def test_unclosed_tags_are_kept(one):
    assert one(tx.strip_html(lit("a<b>c<d"))) == "ac<d"
    assert one(tx.strip_html(lit("a<>b<c<d>e"))) == "a<>be"
    assert one(tx.strip_tags_short(lit("a<>b<c<d>e<f\n>g"))) == "abe<f\n>g"


def test_long_han_runs(one):
    text = lit("世界和" * 40_000)
    assert one(F.size(tx.tokens(text, ["世界"]))) == 80_000
    assert one(F.size(tx.tokens(text, ["无"], han="bigram"))) == 119_999


@pytest.mark.parametrize("part", ["<script>", "<script", "<style>", "<a ", "</script>", "<script>x</script>"])
def test_markup_that_never_closes_is_linear(one, part):
    def seconds(n):
        start = time.perf_counter()
        one(tx.strip_html(F.repeat(lit(part), (F.col("id") + n).cast("int"))))
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(60_000) < 8 * seconds(15_000) + 1


def test_script_and_style_bodies_go(one):
    page = "a<script x>b<p></script>c<style>d</style>e</style><script>f"
    assert one(tx.strip_html(lit(page))) == "acef"


def test_undefined_in_text_stays(one):
    raw = '{"a":undefined,"t":"is undefined, here","l":[undefined,undefined]}'
    assert one(tx.repair_undefined(lit(raw), True)) == '{"a":"","t":"is undefined, here","l":["",""]}'
