"""Normalisers on hand-written records: missing, empty, wrong type, non-ASCII."""

import json

import pytest

from feedloom.normalize import bili, canonical, dy, ks, wb, xhs, zhihu
from feedloom.operators.filters import select_cards
from feedloom.normalize.common import opened
from feedloom.normalize import payloads
from feedloom.schemas import CANONICAL, NATURAL_KEYS, struct


@pytest.fixture
def land(spark):
    """Records as landed JSON texts, with the same context for each."""

    def make(*records, **context):
        names = ["payload", *context]
        rows = [(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False), *context.values()) for r in records]
        return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))

    return make


def row(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_xhs_note_empty_record(land):
    r = row(xhs.normalize_note(land({"note_id": "1"}), 9))
    assert r["title"] == "" and r["image_list"] == "" and r["tag_list"] == "" and r["video_url"] == ""
    assert r["last_update_time"] == 0 and r["liked_count"] is None and r["ip_location"] == ""
    assert r["last_modify_ts"] == 9 and r["source_keyword"] is None


def test_xhs_note_image_falls_back_to_its_url(land):
    images = [{"url": "u", "url_default": ""}, {"url": "u2"}, {"url": "u3", "url_default": "d3"}, {}]
    r = row(xhs.normalize_note(land({"note_id": "1", "image_list": images, "desc": "长" * 300})))
    assert r["image_list"] == "u,u2,d3,"
    assert r["title"] == "长" * 255 and len(r["desc"]) == 300


def test_xhs_video_urls(land):
    def url(video, kind="video"):
        return row(xhs.normalize_note(land({"note_id": "1", "type": kind, "video": video})))["video_url"]

    streams = {"stream": {"h264": [{"master_url": "a"}, {"master_url": "b"}]}}
    assert url({"consumer": {"origin_video_key": "k"}}) == "http://sns-video-bd.xhscdn.com/k"
    assert url({"consumer": {"origin_video_key": "", "originVideoKey": "c"}}) == "http://sns-video-bd.xhscdn.com/c"
    assert url({"consumer": {"origin_video_key": "", "originVideoKey": ""}, "media": streams}) == "a,b"
    assert url({"consumer": {"origin_video_key": "k"}}, "normal") == ""
    assert url({}) == ""


def test_xhs_creator_last_interaction_wins(land):
    record = {
        "basicInfo": {"nickname": "名", "gender": 3},
        "interactions": [{"type": "fans", "count": "1"}, {"type": "fans", "count": "2"}],
        "tags": [{"tagType": "a", "name": "x"}, {"tagType": "a", "name": "猫"}],
    }
    r = row(xhs.normalize_creator(land(record, user_id="u1")))
    assert (r["user_id"], r["fans"], r["follows"], r["gender"]) == ("u1", "2", "0", None)
    assert r["tag_list"] == '{"a":"猫"}'
    assert row(xhs.normalize_creator(land({}, user_id="u")))["tag_list"] == "{}"


def test_bili_counters(land):
    r = row(bili.normalize_video(land({"View": {"aid": 7, "title": "t" * 600, "stat": {"like": 5, "coin": "bad"}}})))
    assert (r["video_id"], r["liked_count"], r["video_coin_count"], r["video_danmaku"]) == ("7", "5", "", "")
    assert len(r["title"]) == 500 and r["desc"] == ""
    assert r["video_url"] == "https://www.bilibili.com/video/av7"


def test_bili_activity_without_text(land):
    r = row(bili.normalize_activity(land({"id_str": "1", "type": "DYNAMIC_TYPE_AV", "modules": {}}, creator_id="3")))
    assert (r["text"], r["type"], r["user_id"], r["total_liked"]) == ("", "AV", "3", None)


def test_bili_edges_are_swapped(land):
    creator = dict(creator_id="1", creator_name="me", creator_sign="s", creator_avatar="a")
    contact = {"mid": 2, "uname": "other"}
    fan = row(bili.normalize_fans(land(contact, **creator)))
    following = row(bili.normalize_followings(land(contact, **creator)))
    assert (fan["up_id"], fan["fan_id"], fan["fan_name"]) == ("1", "2", "other")
    assert (following["up_id"], following["fan_id"], following["up_name"]) == ("2", "1", "other")


def test_dy_urls(land):
    def post(**fields):
        return row(dy.normalize_post(land({"aweme_id": "1", **fields})))

    two = {"url_list": ["a", "b", "c"]}
    assert post(video={"play_addr_h264": two, "play_addr": {"url_list": ["x", "y"]}})["video_download_url"] == "c"
    assert post(video={"play_addr_h264": {"url_list": []}, "play_addr_256": {"url_list": ["lone"]}, "play_addr": two})["video_download_url"] == ""
    assert post(video={"raw_cover": two})["cover_url"] == "b"
    assert post(video={"origin_cover": {"url_list": ["x"]}})["cover_url"] == ""
    assert post(images=[{"url_list": ["a", "z"]}, {"url_list": []}, {}])["note_download_url"] == "z"
    assert post(images=None)["note_download_url"] == ""
    assert post()["liked_count"] is None and post()["avatar"] == ""


def test_dy_search_takes_the_mix(land):
    hits = land({"aweme_info": {"aweme_id": "1"}}, {"aweme_mix_info": {"mix_items": [{"aweme_id": "2"}, {"aweme_id": "3"}]}}, {}, {"aweme_mix_info": {"mix_items": []}})
    assert sorted(r.aweme_id for r in dy.search_records(hits).collect()) == ["1", "2"]


def test_dy_comment(land):
    record = {"cid": "c", "aweme_id": "a", "digg_count": None, "user": {"avatar_thumb": {"url_list": ["t"]}},
              "image_list": [{"origin_url": {"url_list": ["1", "2"]}}, {"origin_url": {"url_list": ["1"]}}, {}]}
    r = row(dy.normalize_comment(land(record)))
    assert (r["avatar"], r["like_count"], r["parent_comment_id"], r["pictures"], r["sub_comment_count"]) == ("t", 0, "0", "2", "0")


def test_ks_drops_records_without_id(land):
    rows = ks.normalize_video(land({"photo": {"id": "k", "realLikeCount": 3}}, {"photo": {"id": ""}}, {"photo": {}}, {}, "broken {")).collect()
    assert [(r.video_id, r.liked_count, r.title) for r in rows] == [("k", "3", "")]


def test_wb_note(land):
    record = {"id": "5", "text": "a<b>c</b>", "created_at": "Sat Dec 23 17:12:54 +0800 2023", "region_name": "发布于 北京", "user": {"id": 7}}
    r = row(wb.normalize_note(land(record)))
    assert (r["content"], r["create_time"], r["create_date_time"]) == ("ac", 1703351574, "2023-12-23 17:12:54+08:00")
    assert (r["ip_location"], r["user_id"], r["liked_count"], r["nickname"]) == ("北京", "7", "0", "")


def test_wb_cards_outer_first(land):
    card = {"card_type": 9, "mblog": {"id": "1"}, "card_group": [{"card_type": 9, "mblog": {"id": "2"}}, {"card_type": 4}]}
    cards = select_cards(opened(land(card, {"card_type": 11, "card_group": []}, {"card_type": 9, "mblog": {"id": "3"}}), payloads.WB_CARD))
    assert sorted((r.card_pos, r.mblog.id) for r in cards.collect()) == [(0, "1"), (0, "3"), (1, "2")]


def test_zhihu_kinds(land):
    rows = zhihu.normalize_content(land(
        {"type": "answer", "id": 1, "question": {"id": 2}, "content": "<p>x</p>", "description": "", "excerpt": "<i>e</i>"},
        {"type": "article", "id": 3, "created_time": 0, "created": 8, "updated": 9},
        {"type": "zvideo", "id": 4, "video": {"a": 1}, "published_at": 5, "updated_at": 6},
        {"type": "zvideo", "id": 5, "video_url": "u", "created_at": 7},
        {"type": "pin", "id": 6},
    )).collect()
    got = {r.content_id: (r.content_url, r.desc, r.created_time, r.updated_time) for r in rows}
    assert got == {
        "1": ("https://www.zhihu.com/question/2/answer/1", "e", 0, 0),
        "3": ("https://zhuanlan.zhihu.com/p/3", "", 8, 9),
        "4": ("https://www.zhihu.com/zvideo/4", "", 5, 6),
        "5": ("u", "", 7, 0),
    }


def test_zhihu_author_of_blocked_user(land):
    def user(author):
        return row(zhihu.normalize_content(land({"type": "article", "id": 1, "author": author})))

    member = {"id": "m", "url_token": "t", "name": "n"}
    assert user({"id": "", "member": member})["user_id"] == "m"
    assert user({"member": member})["user_link"] == "https://www.zhihu.com/people/t"
    assert user(None)["user_id"] == "" and user({})["user_link"] == ""


def test_zhihu_comment_location(land):
    tags = [{"type": "x", "text": "no"}, {"type": "ip_info", "text": "广东"}]
    rows = zhihu.normalize_comment(land({"id": 1, "type": "comment", "comment_tag": tags}, {"id": 2, "type": "ad"}, content_id="c")).collect()
    assert [(r.comment_id, r.ip_location, r.content_id, r.like_count) for r in rows] == [("1", "广东", "c", 0)]


def test_canonical_comment_parents(land):
    self_root = wb.normalize_comment(land({"id": "5", "rootid": "5", "created_at": "Sat Dec 23 17:12:54 +0800 2023"}, requested_id="n"))
    r = row(canonical.canonical_comment(self_root, "wb"))
    assert r["parent_comment_id"] is None and r["content_id"] == "n"
    assert str(r["created_ts"]).startswith("2023-12-23 09:12:54")
    assert row(canonical.canonical_comment(xhs.normalize_comment(land({"id": "1"}, requested_id="n")), "xhs"))["parent_comment_id"] is None


def test_canonical_schemas(land):
    content = canonical.canonical_content(xhs.normalize_note(land({"note_id": "1", "interact_info": {"liked_count": "1.2万"}, "xsec_token": "t"})), "xhs")
    assert content.schema.names == struct(CANONICAL["content"][0]).names
    r = row(content)
    assert r["like_count"] is None and r["extra"]["xsec_token"] == "t" and r["tags"] == []


def test_natural_keys_exist():
    assert len(NATURAL_KEYS) == 22 and NATURAL_KEYS["bilibili_contact_info"] == ("up_id", "fan_id")
