"""Normaliser queries: payload texts are built from the driver tables, landed as JSON or
HTML, and normalised; the SQL gives the flat rows directly."""

from pyspark.sql import functions as F

from catalog.base import SEEN, landed, query, record, table, text
from feedloom.normalize import bili, canonical, dy, ks, tieba, wb, xhs, zhihu
from feedloom.operators.sets import contact_edges, union_platforms
from feedloom.session import spread


def urls(*parts):
    return record(url_list=F.array(*[p if not isinstance(p, str) else F.lit(p) for p in parts]))


def c(name):
    return F.col(name)


def every(n, rest=0):
    """True on each n-th document."""
    return (F.col("doc_id") % n) == rest


def docs(spark, d):
    return spread(table(spark, d, "documents"))


# --- xhs --------------------------------------------------------------------


def xhs_notes(spark, d):
    video = record(
        consumer=record(
            origin_video_key=F.when(every(2), "").otherwise(text("k", c("doc_id"))),
            originVideoKey=F.when(every(4), "").otherwise("camel"),
        ),
        media=record(stream=record(h264=F.array(
            record(master_url=text("m", c("doc_id"))), record(master_url=F.lit("m2"))
        ))),
    )
    images = F.array(
        record(url=text("a", c("doc_id")), url_default=F.when(every(2), "").otherwise("dflt")),
        record(url=F.lit("b"), url_default=F.lit(None).cast("string")),
    )
    tags = F.array(
        record(name=c("lang"), type=F.lit("topic")),
        record(name=c("source"), type=F.lit("brand")),
        record(name=F.lit("话题"), type=F.lit("topic")),
    )
    return landed(
        docs(spark, d).withColumn("source_keyword", c("lang")), "source_keyword",
        note_id=text("n", c("doc_id")),
        type=F.when(every(3), "video").otherwise("normal"),
        title=F.when(every(2), "").otherwise(c("source")),
        desc=c("text"),
        time=c("doc_id") * 1000,
        last_update_time=F.when(~every(5), c("doc_id")),
        ip_location=F.when(c("lang") != "de", c("lang")),
        xsec_token=c("source"),
        user=record(user_id=text("u", c("source")), nickname=c("source"), avatar=F.lit("av")),
        interact_info=record(
            liked_count=c("n_chars").cast("string"), collected_count=F.lit("1.2万"),
            comment_count=F.when(every(7), F.lit(None)).otherwise("3"),
        ),
        image_list=F.when(~every(11), images),
        tag_list=F.when(~every(13), tags),
        video=F.when(every(3), video),
    )


@query(
    "normalize_xhs_note",
    f"""SELECT 'n' || doc_id AS note_id, CASE WHEN doc_id % 3 = 0 THEN 'video' ELSE 'normal' END AS type,
      CASE WHEN doc_id % 2 = 0 THEN left(text, 255) ELSE source END AS title, text AS "desc",
      CASE WHEN doc_id % 3 <> 0 THEN '' WHEN doc_id % 2 <> 0 THEN 'http://sns-video-bd.xhscdn.com/k' || doc_id
           WHEN doc_id % 4 <> 0 THEN 'http://sns-video-bd.xhscdn.com/camel' ELSE 'm' || doc_id || ',m2' END AS video_url,
      doc_id * 1000 AS time, CASE WHEN doc_id % 5 <> 0 THEN doc_id ELSE 0 END AS last_update_time,
      'u' || source AS user_id, source AS nickname, 'av' AS avatar, n_chars::VARCHAR AS liked_count,
      '1.2万' AS collected_count, CASE WHEN doc_id % 7 <> 0 THEN '3' END AS comment_count,
      NULL::VARCHAR AS share_count, CASE WHEN lang <> 'de' THEN lang ELSE '' END AS ip_location,
      CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 2 = 0 THEN 'a' || doc_id || ',b' ELSE 'dflt,b' END AS image_list,
      CASE WHEN doc_id % 13 = 0 THEN '' ELSE lang || ',话题' END AS tag_list, {SEEN}::BIGINT AS last_modify_ts,
      'https://www.xiaohongshu.com/explore/n' || doc_id || '?xsec_token=' || source || '&xsec_source=pc_search' AS note_url,
      lang AS source_keyword, source AS xsec_token FROM documents""",
)
def xhs_note(spark, d):
    return xhs.normalize_note(xhs_notes(spark, d), SEEN)


@query(
    "normalize_xhs_comment",
    f"""SELECT conv_id || '-' || turn AS comment_id, turn * 60 AS create_time, NULL::VARCHAR AS ip_location,
      conv_id::VARCHAR AS note_id, text AS content, 'u' || role AS user_id, role AS nickname, 'img' AS avatar,
      CASE WHEN turn = 0 THEN '0' ELSE turn::VARCHAR END AS sub_comment_count,
      CASE WHEN turn % 2 = 0 THEN 'p1,' ELSE '' END AS pictures,
      CASE WHEN turn > 0 THEN conv_id || '-0' ELSE '0' END AS parent_comment_id,
      {SEEN}::BIGINT AS last_modify_ts, '0' AS like_count FROM conversations""",
)
def xhs_comment(spark, d):
    turn = c("turn")
    pictures = F.array(record(url_default=F.lit("p1")), record(url_default=F.lit(None).cast("string")))
    payload = landed(
        table(spark, d, "conversations").withColumn("requested_id", c("conv_id")), "requested_id",
        id=text(c("conv_id"), "-", turn), note_id=F.lit("other"), create_time=turn * 60, content=c("text"),
        sub_comment_count=F.when(turn > 0, turn.cast("string")),
        user_info=record(user_id=text("u", c("role")), nickname=c("role"), image=F.lit("img")),
        pictures=F.when(turn % 2 == 0, pictures),
        target_comment=F.when(turn > 0, record(id=text(c("conv_id"), "-0"))),
    )
    return xhs.normalize_comment(payload, SEEN)


@query(
    "normalize_xhs_creator",
    f"""SELECT c_custkey::VARCHAR AS user_id, c_name AS nickname,
      CASE c_nationkey WHEN 1 THEN 'F' WHEN 0 THEN 'M' END AS gender, 'img' AS avatar, c_mktsegment AS "desc",
      'n' || c_nationkey AS ip_location, '7' AS follows, c_custkey::VARCHAR AS fans, '0' AS interaction,
      '{{"job":"' || c_mktsegment || '","城市":"n' || c_nationkey || '"}}' AS tag_list, {SEEN}::BIGINT AS last_modify_ts
      FROM customer""",
)
def xhs_creator(spark, d):
    payload = landed(
        table(spark, d, "customer").withColumn("user_id", c("c_custkey")), "user_id",
        basicInfo=record(
            nickname=c("c_name"), gender=c("c_nationkey"), images=F.lit("img"), desc=c("c_mktsegment"),
            ipLocation=text("n", c("c_nationkey")),
        ),
        interactions=F.array(
            record(type=F.lit("fans"), count=F.lit("old")), record(type=F.lit("follows"), count=F.lit("7")),
            record(type=F.lit("fans"), count=c("c_custkey").cast("string")),
        ),
        tags=F.array(
            record(tagType=F.lit("job"), name=c("c_mktsegment")),
            record(tagType=F.lit("城市"), name=text("n", c("c_nationkey"))),
        ),
    )
    return xhs.normalize_creator(payload, SEEN)


# --- bili -------------------------------------------------------------------


def bili_videos(spark, d):
    doc = c("doc_id")
    return landed(
        docs(spark, d).withColumn("source_keyword", c("lang")), "source_keyword",
        View=record(
            aid=doc, title=c("text"), desc=F.when(~every(3), c("text")), pubdate=doc + 1700000000,
            pic=F.when(~every(4), text("pic", doc)), owner=record(mid=doc + 7, name=c("source"), face=F.lit("f")),
            stat=record(like=c("n_chars"), view=doc, favorite=doc + 1, share=doc + 2, coin=doc + 3, reply=doc + 4),
        ),
        Card=record(
            like_num=doc * 2,
            card=record(
                mid=doc + 7, name=c("source"), sex=F.lit("保密"), sign=c("lang"), face=F.lit("f"), fans=c("n_chars"),
                level_info=record(current_level=(doc % 7).cast("int")),
                official_verify=record(type=F.when(every(5), -1).otherwise(0)),
            ),
        ),
    )


@query(
    "normalize_bili_video",
    f"""SELECT doc_id::VARCHAR AS video_id, 'video' AS video_type, left(text, 500) AS title,
      CASE WHEN doc_id % 3 = 0 THEN '' ELSE left(text, 500) END AS "desc", doc_id + 1700000000 AS create_time,
      (doc_id + 7)::VARCHAR AS user_id, source AS nickname, 'f' AS avatar, n_chars::VARCHAR AS liked_count,
      '' AS disliked_count, doc_id::VARCHAR AS video_play_count, (doc_id + 1)::VARCHAR AS video_favorite_count,
      (doc_id + 2)::VARCHAR AS video_share_count, (doc_id + 3)::VARCHAR AS video_coin_count, '' AS video_danmaku,
      (doc_id + 4)::VARCHAR AS video_comment, {SEEN}::BIGINT AS last_modify_ts,
      'https://www.bilibili.com/video/av' || doc_id AS video_url,
      CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'pic' || doc_id END AS video_cover_url, lang AS source_keyword
      FROM documents""",
)
def bili_video(spark, d):
    return bili.normalize_video(bili_videos(spark, d), SEEN)


@query(
    "normalize_bili_creator",
    f"""SELECT (doc_id + 7)::VARCHAR AS user_id, source AS nickname, '保密' AS sex, lang AS sign, 'f' AS avatar,
      {SEEN}::BIGINT AS last_modify_ts, n_chars AS total_fans, doc_id * 2 AS total_liked,
      (doc_id % 7)::INTEGER AS user_rank, CASE WHEN doc_id % 5 = 0 THEN -1 ELSE 0 END::INTEGER AS is_official
      FROM documents""",
)
def bili_creator(spark, d):
    return bili.normalize_creator(bili_videos(spark, d), SEEN)


@query(
    "normalize_bili_comment",
    f"""SELECT (conv_id * 1000 + turn)::VARCHAR AS comment_id, CASE WHEN turn = 0 THEN '0' ELSE
        (conv_id * 1000)::VARCHAR END AS parent_comment_id, turn * 60 AS create_time, conv_id::VARCHAR AS video_id,
      text AS content, 'm' || role AS user_id, role AS nickname, '男' AS sex, NULL::VARCHAR AS sign, 'av' AS avatar,
      turn::VARCHAR AS sub_comment_count, CASE WHEN turn % 2 = 0 THEN turn ELSE 0 END AS like_count,
      {SEEN}::BIGINT AS last_modify_ts FROM conversations""",
)
def bili_comment(spark, d):
    turn = c("turn")
    payload = landed(
        table(spark, d, "conversations").withColumn("requested_id", c("conv_id")), "requested_id",
        rpid=c("conv_id") * 1000 + turn, parent=F.when(turn > 0, c("conv_id") * 1000), ctime=turn * 60,
        like=F.when(turn % 2 == 0, turn), rcount=turn, content=record(message=c("text")),
        member=record(mid=text("m", c("role")), uname=c("role"), sex=F.lit("男"), avatar=F.lit("av")),
    )
    return bili.normalize_comment(payload, SEEN)


def bili_relations(spark, d):
    """Lines as relations: a supplier's fans are parts, its followings are parts too."""
    return landed(
        table(spark, d, "lineitem").select(
            c("l_suppkey").alias("creator_id"), text("s", c("l_suppkey")).alias("creator_name"),
            F.lit("sign").alias("creator_sign"), F.lit("face").alias("creator_avatar"), "l_partkey",
        ).distinct(),
        "creator_id", "creator_name", "creator_sign", "creator_avatar",
        mid=c("l_partkey"), uname=text("p", c("l_partkey")), face=F.lit("pf"),
    )


@query(
    "normalize_bili_contacts",
    f"""WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), a AS (
      SELECT s::VARCHAR AS up_id, 's' || s AS up_name, 'sign' AS up_sign, 'face' AS up_avatar,
        p::VARCHAR AS fan_id, 'p' || p AS fan_name, NULL::VARCHAR AS fan_sign, 'pf' AS fan_avatar FROM e
      UNION ALL SELECT p::VARCHAR, 'p' || p, NULL, 'pf', s::VARCHAR, 's' || s, 'sign', 'face' FROM e)
      SELECT *, {SEEN}::BIGINT AS last_modify_ts FROM (SELECT *, row_number() OVER (PARTITION BY up_id, fan_id
        ORDER BY up_name DESC) AS rn FROM a) WHERE rn = 1""".replace("SELECT *, 17", "SELECT * EXCLUDE (rn), 17"),
)
def bili_contacts(spark, d):
    relations = bili_relations(spark, d)
    fans, followings = bili.normalize_fans(relations, SEEN), bili.normalize_followings(relations, SEEN)
    return contact_edges(fans, followings, [F.desc("up_name")])


@query(
    "normalize_bili_activity",
    f"""SELECT event_id::VARCHAR AS dynamic_id, user_id::VARCHAR AS user_id, 'u' || user_id AS user_name,
      CASE WHEN event_type = 'view' THEN '' ELSE props END AS text, upper(event_type) AS type,
      epoch(date_trunc('second', ts))::BIGINT AS pub_ts, event_id AS total_comments, NULL::BIGINT AS total_forwards,
      user_id AS total_liked, {SEEN}::BIGINT AS last_modify_ts FROM events""",
)
def bili_activity(spark, d):
    payload = landed(
        table(spark, d, "events").withColumns(
            {"creator_id": c("user_id"), "creator_name": text("u", c("user_id"))}
        ),
        "creator_id", "creator_name",
        id_str=c("event_id").cast("string"), type=text("DYNAMIC_TYPE_", F.upper("event_type")),
        modules=record(
            module_dynamic=record(desc=F.when(c("event_type") != "view", record(text=c("props")))),
            module_author=record(pub_ts=F.unix_seconds(c("ts").cast("timestamp"))),
            module_stat=record(
                comment=record(count=c("event_id")), forward=record(count=F.lit(None).cast("bigint")),
                like=record(count=c("user_id")),
            ),
        ),
    )
    return bili.normalize_activity(payload, SEEN)


# --- dy ---------------------------------------------------------------------


def dy_fields():
    doc = c("doc_id")
    return dict(
        aweme_id=doc.cast("string"), aweme_type=F.lit(68), desc=c("text"), create_time=doc + 1700000000,
        ip_label=F.when(c("lang") != "es", c("lang")),
        author=record(
            uid=text("u", c("source")), sec_uid=F.lit("sec"), short_id=F.lit("sh"), unique_id=F.lit("un"),
            signature=c("lang"), nickname=c("source"),
            avatar_thumb=F.when(~every(3), urls(text("t", doc), "t2")),
        ),
        statistics=record(digg_count=c("n_chars"), collect_count=doc, comment_count=F.when(~every(4), doc)),
        images=F.when(every(5), F.array(urls("i1", text("i", doc)), urls("only"))),
        music=record(play_url=record(uri=F.when(~every(6), text("mu", doc)))),
        video=record(
            raw_cover=F.when(every(2), urls("c1", text("c", doc))),
            origin_cover=F.when(every(3), urls("o1", text("o", doc))),
            play_addr_h264=F.when(every(7), urls("h1", text("h", doc))),
            play_addr_256=F.when(every(8), urls("one")),
            play_addr=urls("p1", "p2", text("p", doc)),
        ),
    )


_DY_SQL = f"""SELECT doc_id::VARCHAR AS aweme_id, '68' AS aweme_type, text AS title, text AS "desc",
      doc_id + 1700000000 AS create_time, 'u' || source AS user_id, 'sec' AS sec_uid, 'sh' AS short_user_id,
      'un' AS user_unique_id, lang AS user_signature, source AS nickname,
      CASE WHEN doc_id % 3 = 0 THEN '' ELSE 't' || doc_id END AS avatar, n_chars::VARCHAR AS liked_count,
      doc_id::VARCHAR AS collected_count, CASE WHEN doc_id % 4 <> 0 THEN doc_id::VARCHAR END AS comment_count,
      NULL::VARCHAR AS share_count, CASE WHEN lang <> 'es' THEN lang ELSE '' END AS ip_location,
      {SEEN}::BIGINT AS last_modify_ts, 'https://www.douyin.com/video/' || doc_id AS aweme_url,
      CASE WHEN doc_id % 2 = 0 THEN 'c' || doc_id WHEN doc_id % 3 = 0 THEN 'o' || doc_id ELSE '' END AS cover_url,
      CASE WHEN doc_id % 7 = 0 THEN 'h' || doc_id WHEN doc_id % 8 = 0 THEN '' ELSE 'p' || doc_id END AS video_download_url,
      CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'mu' || doc_id END AS music_download_url,
      CASE WHEN doc_id % 5 = 0 THEN 'i' || doc_id || ',only' ELSE '' END AS note_download_url, lang AS source_keyword
      FROM documents"""


@query("normalize_dy_post", _DY_SQL)
def dy_post(spark, d):
    payload = landed(docs(spark, d).withColumn("source_keyword", c("lang")), "source_keyword", **dy_fields())
    return dy.normalize_post(payload, SEEN)


@query("normalize_dy_search", _DY_SQL + " WHERE doc_id % 9 <> 0")
def dy_search(spark, d):
    """Search hits: the post itself, the first of a mix, or nothing usable."""
    post = record(**dy_fields())
    payload = landed(
        docs(spark, d).withColumn("source_keyword", c("lang")), "source_keyword",
        aweme_info=F.when(~every(2) & ~every(9), post),
        aweme_mix_info=F.when(every(2) & ~every(9), record(mix_items=F.array(post, post))),
    )
    return dy.normalize_post(dy.search_records(payload), SEEN)


@query(
    "normalize_dy_comment",
    f"""SELECT conv_id || '-' || turn AS comment_id, turn * 60 AS create_time, CASE WHEN role = 'user' THEN 'here' ELSE ''
        END AS ip_location, conv_id::VARCHAR AS aweme_id, text AS content, 'u' || role AS user_id,
      NULL::VARCHAR AS sec_uid, NULL::VARCHAR AS short_user_id, NULL::VARCHAR AS user_unique_id,
      NULL::VARCHAR AS user_signature, role AS nickname,
      CASE WHEN turn % 3 = 0 THEN 'm1' WHEN turn % 3 = 1 THEN 'x1' ELSE '' END AS avatar,
      turn::VARCHAR AS sub_comment_count, CASE WHEN turn % 2 = 0 THEN turn ELSE 0 END AS like_count,
      {SEEN}::BIGINT AS last_modify_ts, CASE WHEN turn = 0 THEN '0' ELSE conv_id || '-0' END AS parent_comment_id,
      CASE WHEN role = 'user' THEN 'second' ELSE '' END AS pictures FROM conversations""",
)
def dy_comment(spark, d):
    turn = c("turn")
    payload = landed(
        table(spark, d, "conversations"),
        cid=text(c("conv_id"), "-", turn), aweme_id=c("conv_id").cast("string"), create_time=turn * 60,
        ip_label=F.when(c("role") == "user", "here"), text=c("text"), reply_comment_total=turn,
        digg_count=F.when(turn % 2 == 0, turn), reply_id=F.when(turn > 0, text(c("conv_id"), "-0")),
        user=record(
            uid=text("u", c("role")), nickname=c("role"),
            avatar_medium=F.when(turn % 3 == 0, urls("m1")), avatar_168x168=F.when(turn % 3 == 1, urls("x1")),
            avatar_thumb=F.when(turn % 3 == 1, urls("t1")),
        ),
        image_list=F.when(
            c("role") == "user",
            F.array(record(origin_url=urls("first", "second")), record(origin_url=urls("lone"))),
        ),
    )
    return dy.normalize_comment(payload, SEEN)


@query(
    "normalize_dy_creator",
    f"""SELECT c_custkey::VARCHAR AS user_id, c_name AS nickname,
      CASE c_nationkey WHEN 1 THEN 'M' WHEN 2 THEN 'F' ELSE 'unknown' END AS gender,
      'https://p3-pc.douyinpic.com/img/u' || c_custkey || '~c5_300x300.jpeg?from=2956013662' AS avatar,
      c_mktsegment AS "desc", NULL::VARCHAR AS ip_location, c_custkey AS follows, 0::BIGINT AS fans,
      c_custkey * 2 AS interaction, 0::BIGINT AS videos_count, {SEEN}::BIGINT AS last_modify_ts FROM customer""",
)
def dy_creator(spark, d):
    key = c("c_custkey")
    payload = landed(
        table(spark, d, "customer").withColumn("user_id", key), "user_id",
        user=record(
            nickname=c("c_name"), gender=c("c_nationkey"), avatar_300x300=record(uri=text("u", key)),
            signature=c("c_mktsegment"), following_count=key, total_favorited=key * 2,
        ),
    )
    return dy.normalize_creator(payload, SEEN)


# --- ks ---------------------------------------------------------------------


@query(
    "normalize_ks_video",
    f"""SELECT 'k' || doc_id AS video_id, '1' AS video_type, left(text, 500) AS title, left(text, 500) AS "desc",
      doc_id * 1000 AS create_time, 'u' || source AS user_id, source AS nickname, '' AS avatar,
      n_chars::VARCHAR AS liked_count, doc_id || '万' AS viewd_count, {SEEN}::BIGINT AS last_modify_ts,
      'https://www.kuaishou.com/short-video/k' || doc_id AS video_url, 'cov' AS video_cover_url,
      CASE WHEN doc_id % 2 = 0 THEN 'play' || doc_id ELSE '' END AS video_play_url, lang AS source_keyword
      FROM documents WHERE doc_id % 10 NOT IN (3, 4)""",
)
def ks_video(spark, d):
    key = F.when(every(10, 3), "").when(~every(10, 4), text("k", c("doc_id")))
    payload = landed(
        docs(spark, d).withColumn("source_keyword", c("lang")), "source_keyword",
        type=F.lit(1), author=record(id=text("u", c("source")), name=c("source")),
        photo=record(
            id=key, caption=c("text"), timestamp=c("doc_id") * 1000, realLikeCount=c("n_chars"),
            viewCount=text(c("doc_id"), "万"), coverUrl=F.lit("cov"),
            photoUrl=F.when(every(2), text("play", c("doc_id"))),
        ),
    )
    return ks.normalize_video(payload, SEEN)


@query(
    "normalize_ks_comment",
    f"""SELECT conv_id || '-' || turn AS comment_id, turn * 60 AS create_time, conv_id::VARCHAR AS video_id,
      text AS content, 'u' || role AS user_id, role AS nickname, 'h' AS avatar,
      CASE WHEN turn = 0 THEN '0' ELSE turn::VARCHAR END AS sub_comment_count, {SEEN}::BIGINT AS last_modify_ts
      FROM conversations""",
)
def ks_comment(spark, d):
    turn = c("turn")
    payload = landed(
        table(spark, d, "conversations").withColumn("requested_id", c("conv_id")), "requested_id",
        commentId=text(c("conv_id"), "-", turn), authorId=text("u", c("role")), authorName=c("role"),
        content=c("text"), headurl=F.lit("h"), timestamp=turn * 60, subCommentCount=F.when(turn > 0, turn),
    )
    return ks.normalize_comment(payload, SEEN)


@query(
    "normalize_ks_creator",
    f"""SELECT c_custkey::VARCHAR AS user_id, c_name AS nickname, CASE WHEN c_nationkey = 2 THEN 'F' ELSE 'M' END AS gender,
      'h' AS avatar, c_mktsegment AS "desc", '' AS ip_location, c_custkey AS follows, c_custkey + 1 AS fans,
      NULL::BIGINT AS interaction, {SEEN}::BIGINT AS last_modify_ts FROM customer""",
)
def ks_creator(spark, d):
    payload = landed(
        table(spark, d, "customer").withColumn("user_id", c("c_custkey")), "user_id",
        ownerCount=record(fan=c("c_custkey") + 1, follow=c("c_custkey")),
        profile=record(
            user_name=c("c_name"), gender=F.when(c("c_nationkey") == 2, "F").otherwise("M"), headurl=F.lit("h"),
            user_text=c("c_mktsegment"),
        ),
    )
    return ks.normalize_creator(payload, SEEN)


# --- wb ---------------------------------------------------------------------

_WB_TIME = """epoch(date_trunc('second', ts))::BIGINT AS create_time,
      strftime(ts - INTERVAL 1 HOUR + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') || '+08:00' AS create_date_time"""
_WB_USER = """user_id::VARCHAR AS user_id, 'n' || user_id AS nickname, CASE WHEN user_id % 2 = 0 THEN 'f' ELSE 'm' END
      AS gender, '' AS profile_url, 'img' AS avatar"""


def wb_account():
    return record(
        id=c("user_id"), screen_name=text("n", c("user_id")),
        gender=F.when(c("user_id") % 2 == 0, "f").otherwise("m"), profile_image_url=F.lit("img"),
    )


def wb_time():
    return F.concat(F.date_format("ts", "EEE MMM dd HH:mm:ss"), F.lit(" +0100 "), F.date_format("ts", "yyyy"))


@query(
    "normalize_wb_note",
    f"""SELECT event_id::VARCHAR AS note_id, 'on ' || event_type || ' ' || props AS content, {_WB_TIME},
      event_id::VARCHAR AS liked_count, '0' AS comments_count, '0' AS shared_count, {SEEN}::BIGINT AS last_modify_ts,
      'https://m.weibo.cn/detail/' || event_id AS note_url, CASE WHEN event_type = 'view' THEN '' ELSE event_type END
      AS ip_location, {_WB_USER}, event_type AS source_keyword FROM events""",
)
def wb_note(spark, d):
    payload = landed(
        table(spark, d, "events").withColumn("source_keyword", c("event_type")), "source_keyword",
        id=c("event_id").cast("string"), text=text('on <a href="x">', c("event_type"), "</a> ", c("props")),
        created_at=wb_time(), attitudes_count=c("event_id"),
        region_name=F.when(c("event_type") != "view", text("发布于 ", c("event_type"))), user=wb_account(),
    )
    return wb.normalize_note(payload, SEEN)


@query(
    "normalize_wb_comment",
    f"""SELECT event_id::VARCHAR AS comment_id, {_WB_TIME}, event_type AS note_id, props || E'<b\\n>' AS content,
      '0' AS sub_comment_count, event_id::VARCHAR AS comment_like_count, {SEEN}::BIGINT AS last_modify_ts,
      event_type AS ip_location, CASE WHEN event_id % 2 = 0 THEN 'r' || event_id ELSE '' END AS parent_comment_id,
      {_WB_USER} FROM events""",
)
def wb_comment(spark, d):
    payload = landed(
        table(spark, d, "events").withColumn("requested_id", c("event_type")), "requested_id",
        id=c("event_id"), text=text("<i>", c("props"), "<b\n>"), created_at=wb_time(), like_count=c("event_id"),
        source=text("来自", c("event_type")), rootid=F.when(c("event_id") % 2 == 0, text("r", c("event_id"))),
        user=wb_account(),
    )
    return wb.normalize_comment(payload, SEEN)


@query(
    "normalize_wb_creator",
    f"""SELECT c_custkey::VARCHAR AS user_id, c_name AS nickname, CASE WHEN c_nationkey = 2 THEN 'F' ELSE 'M' END AS gender,
      'hd' AS avatar, c_mktsegment AS "desc", 'n' || c_nationkey AS ip_location, c_custkey::VARCHAR AS follows,
      '' AS fans, '' AS tag_list, {SEEN}::BIGINT AS last_modify_ts FROM customer""",
)
def wb_creator(spark, d):
    payload = landed(
        table(spark, d, "customer").withColumn("user_id", c("c_custkey")), "user_id",
        screen_name=c("c_name"), gender=F.when(c("c_nationkey") == 2, "f").otherwise("m"), avatar_hd=F.lit("hd"),
        description=c("c_mktsegment"), source=text("来自n", c("c_nationkey")), follow_count=c("c_custkey"),
    )
    return wb.normalize_creator(payload, SEEN)


# --- zhihu ------------------------------------------------------------------


def zhihu_fields():
    doc = c("doc_id")
    kind = F.when(every(4), "answer").when(every(4, 1), "article").when(every(4, 2), "zvideo").otherwise("column")
    person = record(id=text("u", c("source")), url_token=c("source"), name=c("lang"), avatar_url=F.lit("av"))
    return dict(
        id=doc, type=kind, title=text("<em>", c("lang"), "</em> title"), content=text("<p>", c("text"), "</p>"),
        description=F.when(every(8), "").otherwise(text("d<br>", c("lang"))), excerpt=text("e", c("lang")),
        question=record(id=doc + 5), created_time=F.when(every(3), 0).otherwise(doc), created=doc + 100,
        updated_time=doc + 1, updated=doc + 101, published_at=doc + 2, updated_at=doc + 3, created_at=doc + 4,
        voteup_count=c("n_chars"), comment_count=F.when(~every(5), doc), video_url=text("v", doc),
        video=F.when(every(3), record(playlist=F.lit("x"))),
        author=F.when(~every(7), _author(person)),
    )


def _author(person):
    """Every sixth author is nested one level deeper, under an empty id."""
    own = [F.when(~every(6), person[f]).alias(f) for f in ("url_token", "name", "avatar_url")]
    return F.struct(
        F.when(every(6), "").otherwise(person["id"]).alias("id"), *own,
        F.when(every(6), person).alias("member"),
    )


def zhihu_sql(where="doc_id % 4 <> 3"):
    return rf"""WITH t AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'answer' WHEN 1 THEN 'article' WHEN 2 THEN 'zvideo' END AS k
        FROM documents WHERE {where})
      SELECT doc_id::VARCHAR AS content_id, k AS content_type,
      CASE WHEN k = 'zvideo' THEN '' ELSE regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g') END
        AS content_text,
      CASE k WHEN 'answer' THEN 'https://www.zhihu.com/question/' || (doc_id + 5) || '/answer/' || doc_id
        WHEN 'article' THEN 'https://zhuanlan.zhihu.com/p/' || doc_id
        ELSE CASE WHEN doc_id % 3 = 0 THEN 'https://www.zhihu.com/zvideo/' || doc_id ELSE 'v' || doc_id END END AS content_url,
      CASE WHEN k = 'answer' THEN (doc_id + 5)::VARCHAR ELSE '' END AS question_id, lang || ' title' AS title,
      CASE WHEN k = 'article' OR (k = 'answer' AND doc_id % 8 = 0) THEN 'e' || lang
           WHEN doc_id % 8 = 0 THEN '' ELSE 'd' || lang END AS "desc",
      CASE k WHEN 'answer' THEN CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id END
        WHEN 'article' THEN CASE WHEN doc_id % 3 = 0 THEN doc_id + 100 ELSE doc_id END
        ELSE CASE WHEN doc_id % 3 = 0 THEN doc_id + 2 ELSE doc_id + 4 END END AS created_time,
      CASE k WHEN 'zvideo' THEN CASE WHEN doc_id % 3 = 0 THEN doc_id + 3 ELSE 0 END ELSE doc_id + 1 END AS updated_time,
      n_chars AS voteup_count, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE doc_id END AS comment_count, lang AS source_keyword,
      CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'u' || source END AS user_id,
      CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'https://www.zhihu.com/people/' || source END AS user_link,
      CASE WHEN doc_id % 7 = 0 THEN '' ELSE lang END AS user_nickname,
      CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'av' END AS user_avatar,
      CASE WHEN doc_id % 7 = 0 THEN '' ELSE source END AS user_url_token, {SEEN}::BIGINT AS last_modify_ts FROM t"""


@query("normalize_zhihu_content", zhihu_sql())
def zhihu_content(spark, d):
    payload = landed(docs(spark, d).withColumn("source_keyword", c("lang")), "source_keyword", **zhihu_fields())
    return zhihu.normalize_content(payload, SEEN)


@query("normalize_zhihu_search", zhihu_sql("doc_id % 4 <> 3 AND doc_id % 5 <> 0 AND doc_id % 9 <> 0"))
def zhihu_search(spark, d):
    payload = landed(
        docs(spark, d).withColumn("source_keyword", c("lang")), "source_keyword",
        type=F.when(every(5), "hot_list").when(every(2), "search_result").otherwise("zvideo"),
        object=F.when(~every(9), record(**zhihu_fields())),
    )
    return zhihu.normalize_content(zhihu.search_records(payload), SEEN)


@query(
    "normalize_zhihu_comment",
    rf"""SELECT conv_id || '-' || turn AS comment_id, CASE WHEN turn > 0 THEN conv_id || '-0' ELSE '' END AS parent_comment_id,
      regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g') AS content,
      turn * 60 AS publish_time, CASE WHEN turn % 2 = 0 THEN 'place' || turn ELSE '' END AS ip_location,
      turn AS sub_comment_count, CASE WHEN turn % 3 = 0 THEN turn ELSE 0 END AS like_count, 0::BIGINT AS dislike_count,
      conv_id::VARCHAR AS content_id, 'answer' AS content_type, 'u' || role AS user_id,
      'https://www.zhihu.com/people/t' || role AS user_link, role AS user_nickname, '' AS user_avatar,
      {SEEN}::BIGINT AS last_modify_ts FROM conversations WHERE role <> 'system'""",
)
def zhihu_comment(spark, d):
    turn = c("turn")
    tags = F.array(
        record(type=F.lit("hot"), text=F.lit("no")), record(type=F.lit("ip_info"), text=text("place", turn)),
        record(type=F.lit("ip_info"), text=F.lit("later")),
    )
    payload = landed(
        table(spark, d, "conversations").withColumns(
            {"content_id": c("conv_id"), "content_type": F.lit("answer")}
        ),
        "content_id", "content_type",
        id=text(c("conv_id"), "-", turn), type=F.when(c("role") == "system", "note").otherwise("comment"),
        reply_comment_id=F.when(turn > 0, text(c("conv_id"), "-0")), content=text("<p>", c("text"), "</p>"),
        created_time=turn * 60, comment_tag=F.when(turn % 2 == 0, tags), child_comment_count=turn,
        like_count=F.when(turn % 3 == 0, turn),
        author=record(id=text("u", c("role")), url_token=text("t", c("role")), name=c("role")),
    )
    return zhihu.normalize_comment(payload, SEEN)


def state_page(entities):
    state = F.to_json(record(initialState=record(entities=entities)))
    return text('<html><body><script id="js-initialData" type="text/json">', state, "</script></body></html>")


@query(
    "normalize_zhihu_creator",
    f"""SELECT 'u' || c_custkey AS user_id, 'https://www.zhihu.com/people/t' || c_custkey AS user_link, c_name AS user_nickname,
      'av' AS user_avatar, 't' || c_custkey AS url_token,
      CASE c_nationkey WHEN 1 THEN 'M' WHEN 0 THEN 'F' ELSE 'unknown' END AS gender, c_mktsegment AS ip_location,
      c_custkey AS follows, c_custkey + 1 AS fans, 0::BIGINT AS anwser_count, 0::BIGINT AS video_count,
      0::BIGINT AS question_count, 0::BIGINT AS article_count, 0::BIGINT AS column_count, c_custkey + 2 AS get_voteup_count,
      {SEEN}::BIGINT AS last_modify_ts FROM customer WHERE c_custkey % 10 <> 0""",
)
def zhihu_creator(spark, d):
    key = c("c_custkey")
    owner = F.when(key % 10 != 0, text("t", key)).otherwise("somebody-else")
    user = record(
        id=text("u", key), name=c("c_name"), avatarUrl=F.lit("av"), gender=c("c_nationkey"),
        ipInfo=c("c_mktsegment"), followingCount=key, followerCount=key + 1, voteupCount=key + 2,
    )
    pages = table(spark, d, "customer").select(
        text("t", key).alias("url_token"),
        state_page(record(users=F.create_map(owner, user))).alias("html"),
    )
    return zhihu.normalize_creator(pages, as_of=SEEN)


@query(
    "zhihu_page_records",
    f"""SELECT doc_id::VARCHAR AS content_id, 'zvideo' AS content_type, lang AS title, 'u' || source AS user_id,
      'https://www.zhihu.com/people/' || source AS user_link, n_chars AS voteup_count FROM documents""",
)
def zhihu_pages(spark, d):
    """Videos embedded in pages; the author is a key into the page's users."""
    video = record(
        id=c("doc_id"), type=F.lit("zvideo"), title=c("lang"), voteup_count=c("n_chars"), author=c("source"),
    )
    user = record(id=text("u", c("source")), name=c("lang"), urlToken=c("source"))
    entities = record(
        users=F.create_map(c("source"), user), zvideos=F.create_map(c("doc_id").cast("string"), video)
    )
    pages = docs(spark, d).select(state_page(entities).alias("html"))
    found = zhihu.normalize_content(zhihu.page_records(pages, "zvideo"), SEEN)
    return found.select("content_id", "content_type", "title", "user_id", "user_link", "voteup_count")


# --- tieba ------------------------------------------------------------------

_Q = "&quot;"


def attr_json(**fields):
    """A JSON object as an escaped attribute value."""
    return F.replace(F.to_json(record(**fields)), F.lit('"'), F.lit(_Q))


@query(
    "normalize_tieba_search",
    f"""SELECT 't' || o_orderkey AS note_id, o_orderpriority AS title, 'about & ' || o_orderstatus AS "desc",
      'https://tieba.baidu.com/p/' || o_orderkey || '?fid=1&x=2' AS note_url, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS publish_time,
      'https://tieba.baidu.com/home/main?un=' || o_custkey AS user_link, 'u' || o_custkey AS user_nickname, '' AS user_avatar,
      'bar' || o_orderstatus AS tieba_name, 'https://tieba.baidu.com/f?kw=bar' AS tieba_link, 0::BIGINT AS total_replay_num,
      0::BIGINT AS total_replay_page, '' AS ip_location, '' AS source_keyword, {SEEN}::BIGINT AS last_modify_ts FROM orders
      UNION ALL SELECT '', '', '', 'https://tieba.baidu.com', '', 'https://tieba.baidu.com', '', '', '',
        'https://tieba.baidu.com', 0, 0, '', '', {SEEN} FROM orders WHERE o_orderstatus = 'P'""",
)
def tieba_search(spark, d):
    block = text(
        '<div class="s_post"><span class="p_title"><a data-tid="t', c("o_orderkey"), '" href="/p/', c("o_orderkey"),
        '?fid=1&amp;x=2"> ', c("o_orderpriority"), '</a></span><div class="p_content">about &amp; ', c("o_orderstatus"),
        '<em>!</em></div><a class="p_forum" href="/f?kw=bar"><font class="p_violet">bar', c("o_orderstatus"),
        '</font></a><a href="/home/main?un=', c("o_custkey"), '"><font>u', c("o_custkey"),
        '</font></a><font class="p_green p_date">', F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"), "</font></div>",
    )
    empty = F.when(c("o_orderstatus") == "P", '<div class="s_post"><br></div>').otherwise(
        '<div class="s_post other"><span class="p_title"></span></div>'
    )
    pages = table(spark, d, "orders").select(text("<html><body>", block, empty, "</body></html>").alias("html"))
    return tieba.normalize_search(pages, as_of=SEEN)


@query(
    "normalize_tieba_forum",
    f"""SELECT c_custkey::VARCHAR AS note_id, 'T ' || c_name AS title, c_mktsegment AS "desc",
      'https://tieba.baidu.com/p/' || c_custkey AS note_url, '' AS publish_time,
      'https://tieba.baidu.com/home/main?un=' || c_custkey AS user_link,
      CASE WHEN c_custkey % 2 = 0 THEN 'nick' ELSE c_name END AS user_nickname, '' AS user_avatar, 'thebar' AS tieba_name,
      'https://tieba.baidu.com/f?kw=thebar' AS tieba_link, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey END AS total_replay_num,
      0::BIGINT AS total_replay_page, '' AS ip_location, '' AS source_keyword, {SEEN}::BIGINT AS last_modify_ts FROM customer""",
)
def tieba_forum(spark, d):
    key = c("c_custkey")
    info = attr_json(
        id=key, author_name=c("c_name"), authoer_nickname=F.when(key % 2 == 0, "nick").otherwise(""),
        reply_num=F.when(key % 3 != 0, key),
    )
    page = text(
        '<a class="card_title_fname" href="/f?kw=thebar"> thebar </a><!--<ul id="thread_list">',
        '<li data-field="', info, '"><a class="j_th_tit ">T ', c("c_name"),
        '</a><div class="threadlist_abs threadlist_abs_onlyline "> ', c("c_mktsegment"),
        ' </div><a class="frs-author-name j_user_card " href="/home/main?un=', key, '">x</a>',
        '<li data-field="{}"><a class="j_th_tit ">advert</a><li>no field<li data-field="{broken">bad</ul>-->',
    )
    return tieba.normalize_forum(table(spark, d, "customer").select(page.alias("html")), as_of=SEEN)


def _tail(place, posted):
    return text(
        '<div class="post-tail-wrap"><span>IP属地:', place, '</span><span class="tail-info">1楼</span>',
        '<span class="tail-info">', posted, "</span></div>",
    )


@query(
    "normalize_tieba_detail",
    f"""SELECT o_orderkey::VARCHAR AS note_id, o_orderpriority AS title, 'desc ' || o_orderstatus AS "desc",
      'https://tieba.baidu.com/p/' || o_orderkey AS note_url, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS publish_time,
      'https://tieba.baidu.com/home/main?id=' || o_custkey AS user_link, 'u' || o_custkey AS user_nickname, 'a.png' AS user_avatar,
      'bar' AS tieba_name, 'https://tieba.baidu.com/f?kw=bar' AS tieba_link, o_custkey AS total_replay_num,
      7::BIGINT AS total_replay_page, o_orderstatus || '州' AS ip_location, '' AS source_keyword, {SEEN}::BIGINT AS last_modify_ts
      FROM orders""",
)
def tieba_detail(spark, d):
    posted = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")
    page = text(
        "<html><head><title>", c("o_orderpriority"), "【bar】_百度贴吧</title>",
        '<meta name="description" content=" desc ', c("o_orderstatus"), '"></head><body>',
        '<a class="card_title_fname" href="/f?kw=bar"> bar</a><a id="lzonly_cntn" href="/p/', c("o_orderkey"),
        '?see_lz=1">x</a><div id="thread_theme_5"><ul><li class="l_reply_num"><span class="red">', c("o_custkey"),
        '</span>, <span class="red">7</span></li></ul></div><div class="p_postlist"><div>',
        '<a class="p_author_face " href="/home/main?id=', c("o_custkey"), '"><img src="a.png"></a>',
        '<a class="p_author_name j_user_card">u', c("o_custkey"), "</a></div>",
        _tail(text(c("o_orderstatus"), "州"), posted), "</div></body></html>",
    )
    return tieba.normalize_detail(table(spark, d, "orders").select(page.alias("html")), as_of=SEEN)


@query(
    "normalize_tieba_comment",
    rf"""SELECT 'p' || doc_id AS comment_id, '' AS parent_comment_id,
      regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g') AS content,
      'https://tieba.baidu.com/home/main?id=' || doc_id AS user_link, source AS user_nickname, 'a.png' AS user_avatar,
      '2024-05-06 07:08' AS publish_time, lang AS ip_location, n_chars AS sub_comment_count, doc_id::VARCHAR AS note_id,
      'https://tieba.baidu.com/p/' || doc_id AS note_url, 'f' || lang AS tieba_id, 'bar' AS tieba_name,
      'https://tieba.baidu.com/f?kw=bar' AS tieba_link, {SEEN}::BIGINT AS last_modify_ts FROM documents""",
)
def tieba_comment(spark, d):
    doc = c("doc_id")
    info = F.replace(F.replace(attr_json(content=record(
        post_id=text("p", doc), comment_num=c("n_chars"), content=text("<p>", c("text"), "</p>"), forum_id=text("f", c("lang")),
    )), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = text(
        '<a class="card_title_fname">bar</a><div class="l_post l_post_bright j_l_post clearfix  " data-field="', info,
        '"><a class="p_author_face " href="/home/main?id=', doc, '"><img src="a.png"></a>',
        '<a class="p_author_name j_user_card"> ', c("source"), " </a>", _tail(c("lang"), F.lit("2024-05-06 07:08")), "</div>",
        '<div class="l_post l_post_bright j_l_post clearfix  " data-field="{}">empty</div>',
    )
    pages = docs(spark, d).select(doc.alias("note_id"), page.alias("html"))
    return tieba.normalize_comment(pages, as_of=SEEN)


@query(
    "normalize_tieba_reply",
    f"""SELECT conv_id || '-' || turn || 'a' AS comment_id, conv_id || '-' || turn AS parent_comment_id, 'hi ' || role AS content,
      '/home/main?un=' || role AS user_link, 'show' || role AS user_nickname, 'x.png' AS user_avatar,
      '2024-5-6 07:08' AS publish_time, '' AS ip_location, 0::BIGINT AS sub_comment_count, conv_id::VARCHAR AS note_id,
      'https://tieba.baidu.com/p/' || conv_id AS note_url, 'f1' AS tieba_id, 'bar' AS tieba_name, 'link' AS tieba_link,
      {SEEN}::BIGINT AS last_modify_ts FROM conversations
      UNION ALL SELECT conv_id || '-' || turn || 'b', conv_id || '-' || turn, 'second', '', '', '', '', '', 0, conv_id::VARCHAR,
        'https://tieba.baidu.com/p/' || conv_id, 'f1', 'bar', 'link', {SEEN} FROM conversations""",
)
def tieba_reply(spark, d):
    key = text(c("conv_id"), "-", c("turn"))
    first = attr_json(spid=text(key, "a"), showname=text("show", c("role")))
    second = attr_json(spid=text(key, "b"))
    page = text(
        '<ul><li class="lzl_single_post j_lzl_s_p " data-field="', second,
        '"><span class="lzl_content_main">second</span></li>',
        '<li class="lzl_single_post j_lzl_s_p first_no_border" data-field="', first,
        '"><a class="j_user_card lzl_p_p" href="/home/main?un=', c("role"), '"><img src="x.png"></a>',
        '<span class="lzl_content_main">hi <b>', c("role"), '</b> </span><span class="lzl_time"> 2024-5-6 07:08 </span></li>',
        '<li class="lzl_more" data-field="{}">more</li></ul>',
    )
    pages = table(spark, d, "conversations").select(
        key.alias("parent_comment_id"), c("conv_id").cast("string").alias("note_id"),
        text("https://tieba.baidu.com/p/", c("conv_id")).alias("note_url"), F.lit("f1").alias("tieba_id"),
        F.lit("bar").alias("tieba_name"), F.lit("link").alias("tieba_link"), page.alias("html"),
    )
    return tieba.normalize_reply(pages, as_of=SEEN)


@query(
    "normalize_tieba_creator",
    f"""SELECT 'i' || c_custkey AS user_id, c_name || ' 名' AS user_name, c_mktsegment AS nickname,
      CASE c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE 'unknown' END AS gender, 'h.png' AS avatar,
      'n' || c_nationkey AS ip_location, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_custkey END AS follows,
      CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_nationkey END::BIGINT AS fans, '1.9年' AS registration_duration,
      {SEEN}::BIGINT AS last_modify_ts FROM customer""",
)
def tieba_creator(spark, d):
    key = c("c_custkey")
    css = F.when(key % 3 == 0, "sex_male").when(key % 3 == 1, "sex_female").otherwise("none")
    extra = F.when(key % 4 == 0, '<span class="concern_num">(<a>1</a>)</span>').otherwise("")
    page = text(
        '<p class="space"><a href="/home?un=', F.replace("c_name", F.lit("#"), F.lit("%23")), "%20%E5%90%8D&amp;id=i", key,
        '&amp;e=">x</a></p><span class="userinfo_username "> ', c("c_mktsegment"), "</span>",
        '<div class="userinfo_left_head"><a><img src="h.png"></a></div><div class="userinfo_userdata"><i class="', css,
        '"></i><span>IP属地:n', c("c_nationkey"), "</span><span>吧龄:1.9年</span></div>",
        '<span class="concern_num">(<a href="/f">', key, '</a>)</span><span class="concern_num">(<a>', c("c_nationkey"),
        "</a>)</span>", extra,
    )
    return tieba.normalize_creator(table(spark, d, "customer").select(page.alias("html")), as_of=SEEN)


@query(
    "tieba_creator_threads",
    """SELECT c_custkey, 0::BIGINT AS record_pos, 'a' || c_custkey AS note_id FROM customer
       UNION ALL SELECT c_custkey, 1, 'c' || c_custkey FROM customer""",
)
def tieba_threads(spark, d):
    def entry(x):
        return text('<li><div class="thread_name"><a href="/p/', F.lit(x), c("c_custkey"), '?pid=1#2">t</a><a href="/f">f</a></div></li>')

    page = text('<ul class="new_list clearfix">', entry("a"), entry("c"), '</ul><div class="thread_name"><a href="/p/z">z</a></div>')
    return tieba.creator_threads(table(spark, d, "customer").select("c_custkey", page.alias("html")))


# --- canonical --------------------------------------------------------------


@query(
    "canonical_union",
    r"""SELECT 'xhs' AS platform, 'n' || doc_id AS content_id, n_chars AS like_count, NULL::BIGINT AS collect_count,
         CASE WHEN doc_id % 2 = 0 THEN left(text, 255) ELSE source END AS title, 'u' || source AS author_id,
         CASE WHEN doc_id > 0 THEN CASE WHEN doc_id * 1000 > 1000000000000 THEN make_timestamp(doc_id * 1000000)
              ELSE make_timestamp(doc_id * 1000 * 1000000) END END AS created_ts,
         CASE WHEN doc_id % 13 = 0 THEN '' ELSE lang || ',话题' END AS tags, source AS extra_token FROM documents
       UNION ALL SELECT 'bili', doc_id::VARCHAR, n_chars, doc_id + 1, left(text, 500), (doc_id + 7)::VARCHAR,
         make_timestamp((doc_id + 1700000000) * 1000000), NULL, NULL FROM documents
       UNION ALL SELECT 'dy', doc_id::VARCHAR, n_chars, doc_id, text, 'u' || source,
         make_timestamp((doc_id + 1700000000) * 1000000), NULL, NULL FROM documents""",
)
def canonical_union(spark, d):
    dy_payload = landed(docs(spark, d), **dy_fields())
    content = union_platforms(
        canonical.canonical_content(xhs.normalize_note(xhs_notes(spark, d), SEEN), "xhs"),
        canonical.canonical_content(bili.normalize_video(bili_videos(spark, d), SEEN), "bili"),
        canonical.canonical_content(dy.normalize_post(dy_payload, SEEN), "dy"),
    )
    return content.select(
        "platform", "content_id", "like_count", "collect_count", "title", "author_id",
        c("created_ts").cast("timestamp_ntz").alias("created_ts"), F.array_join("tags", ",").alias("tags"),
        F.try_element_at("extra", F.lit("xsec_token")).alias("extra_token"),
    )


@query(
    "canonical_comments",
    """SELECT 'wb' AS platform, event_id::VARCHAR AS comment_id, CASE WHEN event_id % 2 = 0 THEN 'r' || event_id END
         AS parent_comment_id, event_type AS content_id, event_id AS like_count,
         date_trunc('second', ts) - INTERVAL 1 HOUR AS created_ts FROM events
       UNION ALL SELECT 'ks', conv_id || '-' || turn, NULL, conv_id::VARCHAR, NULL,
         CASE WHEN turn > 0 THEN make_timestamp(turn * 60 * 1000000) END FROM conversations""",
)
def canonical_comments(spark, d):
    wb_part = canonical.canonical_comment(wb_comment.__wrapped__(spark, d), "wb")
    ks_part = canonical.canonical_comment(ks_comment.__wrapped__(spark, d), "ks")
    return union_platforms(wb_part, ks_part).select(
        "platform", "comment_id", "parent_comment_id", "content_id", "like_count",
        c("created_ts").cast("timestamp_ntz").alias("created_ts"),
    )


@query(
    "canonical_creators",
    """SELECT 'xhs' AS platform, c_custkey::VARCHAR AS user_id, c_custkey AS fans, 7::BIGINT AS follows,
         CASE c_nationkey WHEN 1 THEN 'F' WHEN 0 THEN 'M' END AS gender, c_mktsegment AS job FROM customer
       UNION ALL SELECT 'ks', c_custkey::VARCHAR, c_custkey + 1, c_custkey,
         CASE WHEN c_nationkey = 2 THEN 'F' ELSE 'M' END, NULL FROM customer
       UNION ALL SELECT 'zhihu', 'u' || c_custkey, c_custkey + 1, c_custkey,
         CASE c_nationkey WHEN 1 THEN 'M' WHEN 0 THEN 'F' ELSE 'unknown' END, NULL FROM customer WHERE c_custkey % 10 <> 0""",
)
def canonical_creators(spark, d):
    everyone = union_platforms(
        canonical.canonical_creator(xhs_creator.__wrapped__(spark, d), "xhs"),
        canonical.canonical_creator(ks_creator.__wrapped__(spark, d), "ks"),
        canonical.canonical_creator(zhihu_creator.__wrapped__(spark, d), "zhihu"),
    )
    return everyone.select(
        "platform", "user_id", "fans", "follows", "gender", F.try_element_at("tags", F.lit("job")).alias("job")
    )


@query(
    "canonical_keeps_lists",
    r"""SELECT 'xhs' AS platform, 'n' || doc_id AS content_id, lang || ', ' || source || '|话题' AS tags,
         CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'https://h/a,' || doc_id || '.jpg|b' END AS image_urls, '' AS media_urls,
         CASE WHEN doc_id % 2 = 0 THEN n_chars END AS like_count,
         CASE WHEN doc_id % 2 = 1 THEN n_chars || '.2万' END AS raw_likes FROM documents
       UNION ALL SELECT 'dy', doc_id::VARCHAR, NULL, 'https://h/i,' || doc_id || '.jpg|j', 'https://v/a,' || doc_id || '.mp4',
         n_chars, NULL FROM documents
       UNION ALL SELECT 'ks', doc_id::VARCHAR, NULL, NULL, 'https://v/k,' || doc_id || '.mp4',
         CASE WHEN doc_id % 3 > 0 THEN n_chars END, CASE WHEN doc_id % 3 = 0 THEN n_chars || '万+' END FROM documents""",
)
def canonical_keeps_lists(spark, d):
    """Tags and URLs that hold commas, and counters that are no numbers, in canonical rows."""
    doc = c("doc_id")
    tags = F.array(
        record(name=text(c("lang"), ", ", c("source")), type=F.lit("topic")), record(name=F.lit("话题"), type=F.lit("topic"))
    )
    images = F.array(
        record(url=F.lit(""), url_default=text("https://h/a,", doc, ".jpg")), record(url=F.lit("b"), url_default=F.lit("")),
        record(url=F.lit(""), url_default=F.lit("")),
    )
    likes = F.when(every(2), c("n_chars").cast("string")).otherwise(text(c("n_chars"), ".2万"))
    notes = landed(
        docs(spark, d), note_id=text("n", doc), tag_list=tags, image_list=F.when(~every(4), images),
        interact_info=record(liked_count=likes),
    )
    links = lambda *urls: record(url_list=F.array(*urls))
    posts = landed(
        docs(spark, d), aweme_id=doc, statistics=record(digg_count=c("n_chars")),
        images=F.array(links(F.lit("x"), text("https://h/i,", doc, ".jpg")), links(F.lit("y"), F.lit("j"))),
        video=record(play_addr=links(F.lit("x"), text("https://v/a,", doc, ".mp4"))),
    )
    likes = F.when(every(3), text(c("n_chars"), "万+")).otherwise(c("n_chars").cast("string"))
    videos = landed(
        docs(spark, d), photo=record(id=doc, viewCount=likes, photoUrl=text("https://v/k,", doc, ".mp4"))
    )
    content = union_platforms(
        canonical.canonical_content(xhs.normalize_note(notes, SEEN, extras=True), "xhs"),
        canonical.canonical_content(dy.normalize_post(posts, SEEN, extras=True), "dy"),
        canonical.canonical_content(ks.normalize_video(videos, SEEN), "ks"),
    )
    count = F.when(c("platform") == "ks", c("view_count")).otherwise(c("like_count"))
    raw = F.coalesce(
        F.try_element_at("extra", F.lit("liked_count")), F.try_element_at("extra", F.lit("viewd_count"))
    )
    return content.select(
        "platform", "content_id", *[F.array_join(x, "|").alias(x) for x in ("tags", "image_urls", "media_urls")],
        count.alias("like_count"), raw.alias("raw_likes"),
    )


@query(
    "canonical_genders",
    """SELECT 'bili' AS platform, c_custkey::VARCHAR AS user_id,
         CASE c_nationkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE 'unknown' END AS gender,
         CASE c_nationkey % 3 WHEN 0 THEN '男' WHEN 1 THEN '女' ELSE '保密' END AS gender_code FROM customer
       UNION ALL SELECT 'dy', c_custkey::VARCHAR, CASE c_nationkey % 3 WHEN 1 THEN 'M' WHEN 2 THEN 'F' ELSE 'unknown' END,
         (c_nationkey % 3)::VARCHAR FROM customer
       UNION ALL SELECT 'wb', c_custkey::VARCHAR, CASE WHEN c_nationkey % 3 = 1 THEN 'F' ELSE 'M' END,
         CASE WHEN c_nationkey % 3 = 1 THEN 'f' ELSE 'm' END FROM customer""",
)
def canonical_genders(spark, d):
    """Genders decoded, and the platforms' own codes beside them."""
    rows = table(spark, d, "customer").withColumn("user_id", c("c_custkey"))
    kind = c("c_nationkey") % 3
    sex = F.when(kind == 0, "男").when(kind == 1, "女").otherwise("保密")
    cards = landed(rows, Card=record(card=record(mid=c("c_custkey"), sex=sex)))
    everyone = union_platforms(
        canonical.canonical_creator(bili.normalize_creator(cards, SEEN), "bili"),
        canonical.canonical_creator(
            dy.normalize_creator(landed(rows, "user_id", user=record(gender=kind)), SEEN, extras=True), "dy"
        ),
        canonical.canonical_creator(
            wb.normalize_creator(landed(rows, "user_id", gender=F.when(kind == 1, "f").otherwise("m")), SEEN, extras=True), "wb"
        ),
    )
    return everyone.select(
        "platform", "user_id", "gender", F.try_element_at("extra", F.lit("gender_code")).alias("gender_code")
    )


@query(
    "canonical_activity",
    """SELECT 'bili' AS platform, event_id::VARCHAR AS activity_id, user_id::VARCHAR AS user_id,
         date_trunc('second', ts) AS pub_ts, user_id AS total_liked FROM events""",
)
def canonical_activity(spark, d):
    rows = canonical.canonical_activity(bili_activity.__wrapped__(spark, d))
    return rows.select(
        "platform", "activity_id", "user_id", c("pub_ts").cast("timestamp_ntz").alias("pub_ts"), "total_liked"
    )
