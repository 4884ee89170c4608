import random
from collections import defaultdict

import numpy as np
import odd
import pyarrow as pa
from feedloom.llm import jaccard, shingles


def reference(rows, percent=75):
    sets = [odd.shingles(t) for _, t in rows]
    part = list(range(len(rows)))

    def find(x):
        while part[x] != x:
            part[x] = part[part[x]]
            x = part[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                part[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)].append(doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [x for x in least[find(i)] if x is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=repr)


def corpus(seed=5):
    """Copies, near copies around the bound, shared passages, short and odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(8, 120))]
        for _ in range(rng.randint(1, 14)):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = word()
            if rng.random() < 0.3:
                own += passage[: rng.randint(5, 30)]
            texts.append(rng.choice([" ", "\n", "  "]).join(own))
    texts += [" ".join(passage)] * 3 + [" ".join(passage[:k]) for k in range(1, 30, 3)] + odd.texts()[:60]
    texts += ["One two", "one TWO", "ÉA b", "éa b", "a\x0bb", "a b"]
    rng.shuffle(texts)
    return [(odd.BIG + 3 * i, t) for i, t in enumerate(texts)]


def test_against_brute_force(spark):
    rows = corpus()
    rows += [rows[0], rows[1], (None, rows[2][1]), (None, None), (None, "alone and without an id here now")]
    got = sorted(map(tuple, jaccard.near_duplicates(odd.documents(spark, rows)).collect()), key=repr)
    assert got == reference(rows)


def test_sketch_and_prefixes_lose_nothing(spark, monkeypatch):
    """With few counters and one neighbour all tokens look alike and the second round does the work."""
    monkeypatch.setattr(jaccard, "SKETCH_BITS", 4)
    monkeypatch.setattr(jaccard, "FIRST_TOKENS", 1)
    monkeypatch.setattr(shingles, "NARROW", 20)
    rows = corpus(9)
    got = sorted(map(tuple, jaccard.near_duplicates(odd.documents(spark, rows)).collect()), key=repr)
    assert got == reference(rows)


def test_representatives(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, ""), (5, "x y"), (None, "q"), (6, "X y")]
    docs = odd.documents(spark, rows)
    got = jaccard.representatives(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in got.collect()))) == ["1", "3", "4", "5", "None"]
    assert jaccard.near_duplicates(odd.empty(spark)).collect() == []


def test_representatives_are_rows(spark):
    """Ids that repeat and rows without one: each group keeps one row, and no clean text is lost."""
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (2, "another clean text of id two"), (1, "a b c d e f")]
    rows += [(None, "copies without an id at all"), (None, "Copies without an id at all"), (7, None), (7, None)]
    rows += [(None, "first in the table but without id"), (9, "first in the table but without id")]
    got = jaccard.representatives(odd.documents(spark, rows)).collect()
    found = sorted((str(r.doc_id), (r.text or "").lower()) for r in got)
    assert found == sorted([
        ("1", "a b c d e f"), ("2", "another clean text of id two"), ("None", "copies without an id at all"),
        ("7", ""), ("7", ""), ("9", "first in the table but without id"),
    ])


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    nodes = rng.sample(range(10**6), 300)
    edges = list(zip(nodes[:200], nodes[1:200])) + [(nodes[200], x) for x in nodes[201:]]
    got = dict(map(tuple, jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {n: min(nodes[:200]) for n in nodes[:200]} | {n: min(nodes[200:]) for n in nodes[200:]}


def test_sets():
    texts = [t for _, t in corpus()] + [None, "x" * 70_000 + " b c d e f", "y" * 70_000]
    got = list(shingles.sets(pa.array(texts)))
    want = [odd.shingles(t) for t in texts]
    assert [len(x) for x in got] == [len(x) for x in want]
    assert len(set(np.concatenate(got).tolist())) == len(set().union(*want))
    parts = [next(shingles.sets(pa.array([t], pa.string()))) for t in texts]
    assert all((a == b).all() for a, b in zip(got, parts))


def test_coarse_never_says_no_wrongly():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 300), np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, rng.integers(1, 20), np.uint64)]))
        if shingles.linked(a, b, 75):
            assert shingles.may_link(shingles.coarse(a), shingles.coarse(b), 75)


def test_near_copies_cost_their_number(spark, monkeypatch):
    """Rows of the join that pairs members grow with a group of near copies, not its square."""
    rows_met = []
    met = jaccard._met

    def counted(buckets, percent):
        found = met(buckets, percent)
        rows_met.append(found.count())
        return found

    monkeypatch.setattr(jaccard, "_met", counted)
    for n in (200, 400, 800):
        rng = random.Random(n)
        word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
        base = [word() for _ in range(150)]
        rows = []
        for i in range(n):
            own = list(base)
            for _ in range(rng.randint(0, 12)):
                own[rng.randrange(len(own))] = word()
            rows.append((i, " ".join(own)))
        got = sorted(map(tuple, jaccard.near_duplicates(odd.documents(spark, rows)).collect()), key=repr)
        if n <= 400:
            assert got == reference(rows)
    assert rows_met[2] <= 3 * max(rows_met[1], n) <= 9 * max(rows_met[0], n)
