"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default: all) choose data
and cores. Every query is run to its end with all of its columns (the ``noop`` sink),
once to compile its code and once for the clock; ``first_run`` is the total of the former.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

import catalog  # noqa: E402
from feedloom.session import ROCKSDB_PROVIDER  # noqa: E402

HEADLINE = [
    "top_words",
    "word_freq_by_lang",
    "html_text",
    "url_params",
    "html_records",
    "keyword_hits_all",
    "keyword_hits_table",
    "first_n_comments",
    "first_n_with_children",
    "first_n_large",
    "first_pages_per_keyword",
    "daily_quota",
    "contents_of_creator",
    "comments_of_content",
    "comments_of_hot_content",
    "comments_with_parent",
    "contact_edges",
    "dedupe",
    "first_last_seen",
    "upsert_events",
    "latest_unexpired",
    "normalize_xhs_note",
    "normalize_dy_post",
    "normalize_zhihu_content",
    "normalize_tieba_detail",
    "canonical_union",
    "envelope_ok",
    "media_xhs",
    "search_words",
    "creator_contents",
    "detail_contents",
    "stream_upsert",
    "stream_word_freq",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    def timed(name: str) -> float:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    first = {name: timed(name) for name in names}
    seconds = {name: timed(name) for name in names}
    sf = Path(sf_dir).name.removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "first_run": round(sum(first.values()), 3),
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
