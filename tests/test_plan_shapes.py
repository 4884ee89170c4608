"""Plans of all batch queries: nothing that meets every pair, runs Python row by row, or
brings whole tables into one task."""

import pytest

import catalog
from compare import DATA

# Global aggregates (a maximum, a count, a merged sketch, the keywords' leading grams).
ONE_ROW = {
    "next_run_ordinal", "run_ordinal_of_files", "update_affected", "keyword_hits_table",
    "keyword_hits_many", "keyword_hits_many_last",
    "comments_with_parent_salted", "comments_of_hot_content",
}
# Top-k reports and the first row of a lookup.
TOP_K = {"top_words", "top_words_first_seen", "page_slice", "top_relevant_page", "first_row"}
BATCH = [n for n in catalog.QUERIES if not n.startswith(("stream", "expiring"))]


@pytest.mark.parametrize("name", BATCH)
def test_plan(spark, name):
    df = catalog.QUERIES[name](spark, f"{DATA}/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "collect_list"):
        assert node not in plan
    if name not in ONE_ROW:
        assert "Exchange SinglePartition" not in plan
    if name not in TOP_K:
        assert not any(node in plan for node in ("TakeOrdered", "CollectLimit", "GlobalLimit"))
