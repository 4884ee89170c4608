"""One query per operator over its whole table, at production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from feedloom import configure
from feedloom.llm import (
    alignment,
    bpe,
    centroids,
    html,
    jaccard,
    language,
    packing,
    pii,
    quality,
    rules,
    sharding,
    tokens,
    topk,
)
from feedloom.llm.common import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TOKEN_LIMIT = 4096
SEQUENCE = 4096


def held_out(id: str = "doc_id"):
    """One document in five, by its id; none without an id."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % 5 == 0, F.lit(False))


def learned(id: str = "doc_id"):
    """The other four in five."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % 5 != 0, F.lit(False))


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(configure(spark))
        return fn(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

    QUERIES[fn.__name__] = run
    return run


@query
def op1_token_counts(table) -> DataFrame:
    counts = tokens.token_counts(table("documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", tokens.over_limit(TOKEN_LIMIT))


@query
def op2_bpe_codec(table) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.round_trip(table("documents"), path, with_ids=False, with_text=False)


@query
def op3_html_main_text(table) -> DataFrame:
    return html.extract(table("pages"))


@query
def op4_pii(table) -> DataFrame:
    found = pii.digest(pii.sanitise(table("documents")))
    return found.drop("base_spans", "all_spans", "clean_text")


@query
def op5_top_k(table) -> DataFrame:
    return topk.search(table("embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


SQL["op5_top_k"] = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM scored
) WHERE rank <= 5
"""


@query
def op6_language_id(table) -> DataFrame:
    found = language.identify(table("documents"), learn_from=learned())
    return found.withColumn("held_out", held_out())


@query
def op7_quality_rules(table) -> DataFrame:
    return rules.assess(table("documents")).drop("clean_text")


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = f"CASE WHEN trim(%s, {_WS}) = '' THEN [] ELSE string_split_regex(trim(%s, {_WS}), '{rules.WHITE}') END"
_END, _SEPARATOR = (p.replace("'", "''") for p in (rules.SENTENCE_END, rules.SEPARATOR))
SQL["op7_quality_rules"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), l AS (
  SELECT r, n, x, len(w) AS c, w FROM (
    SELECT r, n, x, {_WORDS % ("x", "x")} AS w
    FROM (SELECT r, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM d))
), judged AS (
  SELECT *, c > 0 AND (
      (c < 5 AND NOT regexp_matches(rtrim(x), '{_END}'))
      OR length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) > 0.3::DOUBLE * c
      OR length(x) - length(regexp_replace(x, '[!?]{{2,}}', '!', 'g')) > 0.3::DOUBLE * c
      OR (c >= 5 AND len(list_filter(range(1, c), lambda i: w[i] = w[i + 1])) > 0.3::DOUBLE * c)
      OR (c >= 5 AND regexp_matches(x, '\p{{Lu}}{{2}}') AND
          length(x) - length(regexp_replace(x, '\p{{Lu}}', '', 'g'))
          > 0.7::DOUBLE * (length(x) - length(regexp_replace(x, '\p{{L}}', '', 'g'))))
      OR (len(list_filter(w, lambda v: regexp_matches(v, '{_SEPARATOR}'))) >= greatest(3, 0.15::DOUBLE * c))
      OR (c <= 15 AND regexp_matches(lower(x), '{rules.BOILERPLATE}'))
    ) AS falls FROM l
), lines AS (
  SELECT r, (count(*) FILTER (c > 0) - count(DISTINCT x) FILTER (c > 0))::BIGINT AS n_dup_lines,
    coalesce(sum(length(array_to_string(w, ''))) FILTER (NOT falls), 0) AS left_over
  FROM judged GROUP BY r
), words AS (
  SELECT r, doc_id, t, {_WORDS % ("t", "t")} AS w FROM d
), windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, win) AS times FROM (
    SELECT r, i, array_to_string(w[i : i + 7], ' ') AS win
    FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM words))
), covered AS (
  SELECT r, count(DISTINCT p)::BIGINT AS n FROM (
    SELECT r, unnest(range(i, i + 8)) AS p FROM windows WHERE times > 1) GROUP BY r
), base AS (
  SELECT words.r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words, left_over
  FROM words JOIN lines ON words.r = lines.r LEFT JOIN covered ON words.r = covered.r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND left_over >= 0.5::DOUBLE * word_chars AS kept
FROM base
"""


@query
def op8_ngram_jaccard(table) -> DataFrame:
    return jaccard.near_duplicates(table("documents"), percent=75)


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL["op8_ngram_jaccard"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS % ("t", "t")} AS w FROM (SELECT doc_id, {_LOWERED} AS t FROM documents)
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS i FROM w)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM met JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) LEFT JOIN n USING (doc_id)
"""


@query
def op9_packing(table) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(table("documents"), path, size=SEQUENCE, with_ids=False)


@query
def op10_quality_classifier(table) -> DataFrame:
    scored = quality.classify(table("documents"), table("labels"), learn_from=learned())
    return scored.withColumn("held_out", held_out())


@query
def op11_centroid_clusters(table) -> DataFrame:
    return centroids.cluster(table("embeddings"), k=16, rounds=3, scale=64, size=64, seed=1)


def _cluster_sql(k: int, rounds: int, scale: int, size: int, seed: int) -> str:
    apart = "list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS (
  SELECT r, vec_id, e, c, d FROM (
    SELECT v.*, c.c, {apart} AS d, row_number() OVER (PARTITION BY r ORDER BY {apart}, c.c) AS k FROM v, c{n} c
  ) WHERE k = 1
)""")
        if n < rounds:
            steps.append(f"""c{n + 1} AS (
  SELECT old.c, coalesce(new.e, old.e) AS e FROM c{n} old LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM (
      SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n
      FROM (SELECT c, unnest(e) AS x, unnest(range({size})) AS i FROM a{n}) GROUP BY c, i
    ) GROUP BY c
  ) new USING (c)
)""")
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), vec_id, e) - 1)::INTEGER AS c, e FROM v QUALIFY c < {k}
), {", ".join(steps)}
SELECT vec_id, c AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia,
  sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(l.e, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} l USING (c)
"""


SQL["op11_centroid_clusters"] = _cluster_sql(k=16, rounds=3, scale=64, size=64, seed=1)


@query
def op12_histogram_shards(table) -> DataFrame:
    return sharding.shard(table("documents"), shards=40)


@query
def op13_tokenizer_alignment(table) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(table("documents"), *paths, with_groups=False)
