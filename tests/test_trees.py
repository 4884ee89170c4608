"""Reply trees against a walk in plain Python."""

import random

import pytest
from feedloom.operators.trees import reply_tree


def walk(rows):
    up = {}
    for scope, i, p in rows:
        if i is None:
            continue
        p = None if p in ("", "0", i) else p
        old = up.get((scope, i))
        up[scope, i] = min(x for x in (old, p) if x is not None) if (old or p) else None
    out = []
    for scope, i, p in rows:
        if i is None:
            out.append((scope, i, None, None, None, None))
            continue
        path, at, seen = [], i, set()
        while at is not None and at not in seen:
            seen.add(at)
            path.append(at)
            at = up[scope, at] if (scope, up[scope, at]) in up else None
        orphan = up[scope, i] is not None and (scope, up[scope, i]) not in up
        out.append((scope, i, None, None, None, orphan) if at is not None else (scope, i, path[-1], len(path), path[::-1], orphan))
    return sorted(map(str, out))


def found(spark, rows):
    df = spark.createDataFrame(rows, "content_id string, comment_id string, parent_comment_id string")
    got = reply_tree(df, scope=["content_id"])
    return sorted(map(str, [(r.content_id, r.comment_id, r.root_id, r.depth, r.path, r.orphan) for r in got.collect()]))


@pytest.mark.parametrize("seed", range(4))
def test_random_forests(spark, seed):
    rng = random.Random(seed)
    rows = []
    for scope in ("x", "y", None):
        n = rng.randrange(1, 60)
        for i in range(n):
            parent = rng.choice([None, "", "0", "gone", *[str(k) for k in range(max(0, i - 4), min(n, i + (seed > 1)))]])
            rows.append((scope, str(i), parent))
    rows += [rows[0], rows[0], ("x", None, "1"), ("x", "5", "2")]  # repeats, no id, another parent
    assert found(spark, rows) == walk(rows)


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    from feedloom.operators import trees

    cuts, cut = [], trees.stored
    monkeypatch.setattr(trees, "stored", lambda df, path: cuts.append(1) or cut(df, path))
    rows = [("x", str(i), str(i - 1) if i else None) for i in range(300)]
    assert found(spark, rows) == walk(rows)
    assert len(cuts) <= 11


def test_rings_and_what_hangs_below(spark):
    rows = [("x", str(i), str((i + 1) % 7)) for i in range(7)] + [("x", "a", "3"), ("x", "b", "a"), ("x", "s", "s")]
    assert found(spark, rows) == walk(rows)
    assert found(spark, []) == []
