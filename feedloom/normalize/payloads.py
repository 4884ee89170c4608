"""Declared shapes of the raw payloads, as Spark DDL.

Only fields that some normaliser reads are declared, so ``from_json`` skips the rest.
"""

_NAMES = "uid: STRING, sec_uid: STRING, short_id: STRING, unique_id: STRING, signature: STRING, nickname: STRING"
_URLS = "STRUCT<url_list: ARRAY<STRING>>"

XHS_NOTE = """note_id STRING, type STRING, title STRING, desc STRING, time BIGINT,
last_update_time BIGINT, ip_location STRING, xsec_token STRING,
user STRUCT<user_id: STRING, nickname: STRING, avatar: STRING>,
interact_info STRUCT<liked_count: STRING, collected_count: STRING, comment_count: STRING, share_count: STRING>,
image_list ARRAY<STRUCT<url: STRING, url_default: STRING>>,
tag_list ARRAY<STRUCT<name: STRING, type: STRING>>,
video STRUCT<consumer: STRUCT<origin_video_key: STRING, originVideoKey: STRING>,
  media: STRUCT<stream: STRUCT<h264: ARRAY<STRUCT<master_url: STRING>>>>>"""

_XHS_COMMENT = """id STRING, note_id STRING, create_time BIGINT, ip_location STRING, content STRING,
sub_comment_count STRING, like_count STRING,
user_info STRUCT<user_id: STRING, nickname: STRING, image: STRING>,
pictures ARRAY<STRUCT<url_default: STRING>>, target_comment STRUCT<id: STRING>"""
XHS_COMMENT = _XHS_COMMENT

XHS_CREATOR = """basicInfo STRUCT<nickname: STRING, gender: INT, images: STRING, desc: STRING, ipLocation: STRING>,
interactions ARRAY<STRUCT<type: STRING, count: STRING>>,
tags ARRAY<STRUCT<tagType: STRING, name: STRING>>"""

BILI_VIDEO = """View STRUCT<aid: BIGINT, cid: BIGINT, title: STRING, desc: STRING, pubdate: BIGINT, pic: STRING,
  owner: STRUCT<mid: BIGINT, name: STRING, face: STRING>,
  stat: STRUCT<like: BIGINT, dislike: BIGINT, view: BIGINT, favorite: BIGINT, share: BIGINT,
    coin: BIGINT, danmaku: BIGINT, reply: BIGINT>>,
Card STRUCT<like_num: BIGINT, card: STRUCT<mid: BIGINT, name: STRING, sex: STRING, sign: STRING,
  face: STRING, fans: BIGINT, level_info: STRUCT<current_level: INT>,
  official_verify: STRUCT<type: INT>>>"""

BILI_COMMENT = """rpid BIGINT, parent BIGINT, ctime BIGINT, like BIGINT, rcount BIGINT,
content STRUCT<message: STRING>,
member STRUCT<mid: STRING, uname: STRING, sex: STRING, sign: STRING, avatar: STRING>"""

BILI_CONTACT = "mid BIGINT, uname STRING, sign STRING, face STRING"

BILI_DYNAMIC = """id_str STRING, type STRING, modules STRUCT<
  module_dynamic: STRUCT<desc: STRUCT<text: STRING>>, module_author: STRUCT<pub_ts: BIGINT>,
  module_stat: STRUCT<comment: STRUCT<count: BIGINT>, forward: STRUCT<count: BIGINT>,
    like: STRUCT<count: BIGINT>>>"""

DY_AWEME = f"""aweme_id STRING, aweme_type INT, desc STRING, create_time BIGINT, ip_label STRING,
author STRUCT<{_NAMES}, avatar_thumb: {_URLS}>,
statistics STRUCT<digg_count: BIGINT, collect_count: BIGINT, comment_count: BIGINT, share_count: BIGINT>,
images ARRAY<{_URLS}>, music STRUCT<play_url: STRUCT<uri: STRING>>,
video STRUCT<raw_cover: {_URLS}, origin_cover: {_URLS}, play_addr_h264: {_URLS},
  play_addr_256: {_URLS}, play_addr: {_URLS}>"""

DY_SEARCH = (
    f"aweme_info STRUCT<{DY_AWEME}>, "
    f"aweme_mix_info STRUCT<mix_items: ARRAY<STRUCT<{DY_AWEME}>>>"
)

DY_COMMENT = f"""cid STRING, aweme_id STRING, create_time BIGINT, ip_label STRING, text STRING,
reply_comment_total BIGINT, digg_count BIGINT, reply_id STRING,
user STRUCT<{_NAMES}, avatar_medium: {_URLS}, avatar_300x300: {_URLS}, avatar_168x168: {_URLS},
  avatar_thumb: {_URLS}>,
image_list ARRAY<STRUCT<origin_url: {_URLS}>>"""

DY_CREATOR = """user STRUCT<nickname: STRING, gender: INT, avatar_300x300: STRUCT<uri: STRING>,
signature: STRING, ip_location: STRING, following_count: BIGINT, max_follower_count: BIGINT,
total_favorited: BIGINT, aweme_count: BIGINT>"""

KS_VIDEO = """type INT, author STRUCT<id: STRING, name: STRING, headerUrl: STRING>,
photo STRUCT<id: STRING, caption: STRING, timestamp: BIGINT, realLikeCount: BIGINT,
  viewCount: STRING, coverUrl: STRING, photoUrl: STRING>"""

_KS_COMMENT = """commentId STRING, authorId STRING, authorName STRING, content STRING,
headurl STRING, timestamp BIGINT, subCommentCount BIGINT"""
KS_COMMENT = _KS_COMMENT

KS_CREATOR = """ownerCount STRUCT<fan: BIGINT, follow: BIGINT, photo_public: BIGINT>,
profile STRUCT<user_name: STRING, gender: STRING, headurl: STRING, user_text: STRING>"""

_WB_USER = """STRUCT<id: STRING, screen_name: STRING, gender: STRING, profile_url: STRING,
  profile_image_url: STRING>"""
WB_NOTE = f"""id STRING, text STRING, created_at STRING, attitudes_count BIGINT, comments_count BIGINT,
reposts_count BIGINT, region_name STRING, user {_WB_USER}, pics ARRAY<STRUCT<pid: STRING, url: STRING>>"""
WB_CARD = (
    f"card_type INT, mblog STRUCT<{WB_NOTE}>, "
    f"card_group ARRAY<STRUCT<card_type: INT, mblog: STRUCT<{WB_NOTE}>>>"
)

_WB_COMMENT = f"""id STRING, text STRING, created_at STRING, total_number BIGINT, like_count BIGINT,
source STRING, rootid STRING, user {_WB_USER}"""
WB_COMMENT = _WB_COMMENT

WB_CREATOR = """screen_name STRING, gender STRING, avatar_hd STRING, description STRING, source STRING,
follow_count STRING, followers_count STRING"""

# Level-1 comments that carry their replies inline.
XHS_COMMENT_TREE = f"{_XHS_COMMENT}, sub_comments ARRAY<STRUCT<{_XHS_COMMENT}>>"
KS_COMMENT_TREE = f"{_KS_COMMENT}, subComments ARRAY<STRUCT<{_KS_COMMENT}>>"
WB_COMMENT_TREE = f"{_WB_COMMENT}, comments ARRAY<STRUCT<{_WB_COMMENT}>>"

_ZHIHU_PERSON = "id: STRING, url_token: STRING, name: STRING, avatar_url: STRING"
_ZHIHU_AUTHOR = f"STRUCT<{_ZHIHU_PERSON}, member: STRUCT<{_ZHIHU_PERSON}>>"
ZHIHU_CONTENT = f"""id STRING, type STRING, title STRING, content STRING, description STRING,
excerpt STRING, question STRUCT<id: STRING>, created_time BIGINT, created BIGINT,
updated_time BIGINT, updated BIGINT, published_at BIGINT, updated_at BIGINT, created_at BIGINT,
voteup_count BIGINT, comment_count BIGINT, video_url STRING, video STRING,
author {_ZHIHU_AUTHOR}"""
ZHIHU_ITEM = f"type STRING, object STRUCT<{ZHIHU_CONTENT}>"

ZHIHU_COMMENT = f"""id STRING, type STRING, reply_comment_id STRING, content STRING,
created_time BIGINT, comment_tag ARRAY<STRUCT<type: STRING, text: STRING>>,
child_comment_count BIGINT, like_count BIGINT, dislike_count BIGINT, author {_ZHIHU_AUTHOR}"""

# Users of the embedded page state use camel case.
_ZHIHU_USER = """STRUCT<id: STRING, name: STRING, avatarUrl: STRING, urlToken: STRING, gender: INT,
ipInfo: STRING, followingCount: BIGINT, followerCount: BIGINT, answerCount: BIGINT,
zvideoCount: BIGINT, questionCount: BIGINT, articlesCount: BIGINT, columnsCount: BIGINT,
voteupCount: BIGINT>"""
ZHIHU_STATE = (
    "initialState STRUCT<entities: STRUCT<"
    f"users: MAP<STRING, {_ZHIHU_USER}>, "
    "answers: MAP<STRING, STRING>, articles: MAP<STRING, STRING>, zvideos: MAP<STRING, STRING>>>"
)

TIEBA_THREAD_FIELD = "id STRING, author_name STRING, authoer_nickname STRING, reply_num BIGINT"
TIEBA_POST_FIELD = "content STRUCT<post_id: STRING, comment_num: BIGINT, content: STRING, forum_id: STRING>"
TIEBA_REPLY_FIELD = "spid STRING, showname STRING, user_name STRING, portrait STRING"
