"""Text functions against DuckDB on random markup, URLs and key=value texts."""

import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedloom.functions import text as tx

PIECES = ["<", ">", "</", "script", "style", "<script>", "</script>", "<style x>", "</style>", "<b>", "é", " ", "\n", "\t", "中文", "a", "<>", "/", "&amp;", "x9"]
QUERY = ["?", "&", "=", "a", "b", "page", "1", "%20", "+", "#", "/", "http://h/p"]

# function -> DuckDB expression over column t
CASES = {
    "strip_html": (
        PIECES,
        tx.strip_html,
        r"""regexp_replace(regexp_replace(regexp_replace(t, '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'gs'),
            '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g')""",
    ),
    "strip_tags_short": (PIECES, tx.strip_tags_short, "regexp_replace(t, '<.*?>', '', 'g')"),
    "query_string": (QUERY, tx.query_string, r"regexp_extract(t, '^[^?#]*\?([^#]*)', 1)"),
    "last_segment": (QUERY, tx.last_segment, "string_split(string_split(t, '?')[1], '/')[-1]"),
    "first_int": (PIECES, lambda c: tx.first_int(c).cast("string"), "coalesce(nullif(regexp_extract(t, '[0-9]+', 0), ''), '0')::BIGINT::VARCHAR"),
    "tokens": (
        [p for p in PIECES if p != "中文"],
        lambda c: F.array_join(tx.tokens(c), "|"),
        r"array_to_string(regexp_extract_all(t, '([\p{L}\p{N}]+)', 1), '|')",
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_random_texts(spark, name):
    pieces, function, sql = CASES[name]
    rng = random.Random(name)
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(3000)]
    rows = pa.table({"i": list(range(len(texts))), "t": texts})
    con = duckdb.connect()
    con.register("rows", rows)
    want = dict(con.execute(f"SELECT i, {sql} FROM rows").fetchall())
    df = spark.createDataFrame(list(enumerate(texts)), "i bigint, t string")
    got = {r.i: r.o for r in df.select("i", function(F.col("t")).alias("o")).collect()}
    wrong = [(texts[i], got[i], want[i]) for i in got if got[i] != want[i]]
    assert not wrong, wrong[:5]
