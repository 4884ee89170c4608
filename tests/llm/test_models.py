import zlib

import numpy as np
import odd
import public_tokenizers
import pytest
from feedloom.llm import language, quality
from feedloom.llm.queries import QUERIES, held_out, learned
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.01"


def out_of_sample(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = language.identify(docs, learned(), keep=("doc_id", "lang")).withColumn("held_out", held_out()).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and {r.doc_id for r in held} == {r.doc_id for r in got if out_of_sample(r.doc_id)}
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_gradients():
    """Backpropagation through time against differences."""
    net = language.Network(["a", "b", "c"], hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data = np.array([[1, 2, 3, 1], [3, 3, 2, 0]], np.uint8)
    target = np.array([0, 2])
    loss = lambda: -np.log(net.labels(data)[:, np.arange(2), target]).mean()
    grads = net.gradients(data, target)
    rng = np.random.default_rng(0)
    for name, g in grads.items():
        for _ in range(8):
            at = tuple(rng.integers(0, n) for n in g.shape)
            if name[0] == "x":
                at = (int(rng.integers(0, 4)), *at[1:])
            kept, step = net.p[name][at], 1e-4
            net.p[name][at] = kept + step
            up = loss()
            net.p[name][at] = kept - step
            down = loss()
            net.p[name][at] = kept
            assert abs((up - down) / (2 * step) - g[at]) < 1e-3, name


def test_language_of_odd_texts(spark):
    docs = odd.documents(spark).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "xx").otherwise("yy"))
    rows = language.identify(docs, learned(), keep=("doc_id", "text", "score")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        letters = any(map(str.isalpha, r.text or ""))
        assert (r.lang_pred == "und") == (not letters)
        assert (r.score == 0) == (not letters)
    unknown = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(unknown, learned()).collect()} == {"und"}
    assert language.identify(docs.limit(0), learned()).collect() == []
    single = docs.withColumn("lang", F.lit("zz"))
    assert {r.lang_pred for r in language.identify(single, learned()).collect()} == {"und", "zz"}
    kept = language.keep_known(docs, learned())
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_pooling_covers_whole_texts():
    net = language.Network(["a", "b"])
    labeller = language.Labeller(net)
    words = [f"word{i}".translate({48 + d: 97 + d for d in range(10)}) for i in range(500)]
    whole = labeller.pool([" ".join(words)])[0]
    parts = [labeller.pool([w])[0] * len(w) for w in words]
    assert np.allclose(whole, sum(parts) / sum(map(len, words)), atol=1e-5)


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels, learned()).withColumn("held_out", held_out()).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert np.mean([r.quality == r.predicted for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_quality_of_odd_tables(spark):
    docs = odd.documents(spark)
    labels = spark.createDataFrame([(odd.BIG + i, i % 2, 0) for i in range(60)] + [(odd.BIG, None, 0), (None, 1, 0), (5, 7, 0), (odd.BIG + 2, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, labels, learned(), keep=("text", "score")).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.classify(docs, labels.limit(0), learned()).collect()} == {0.5}
    assert {r.score for r in quality.classify(docs, labels.filter("quality = 1"), learned()).collect()} == {1.0}
    assert {r.score for r in quality.classify(docs, labels.filter("quality = 0"), learned()).collect()} == {0.0}
    assert quality.classify(odd.empty(spark), labels, learned()).collect() == []


def test_discriminant_is_the_density_ratio():
    rng = np.random.default_rng(0)
    d = len(quality.FEATURES)
    x = {0: rng.normal(0, 2, (400, d)), 1: rng.normal(0.5, 1, (700, d))}
    sums = {k: (len(v), v.sum(0), v.T @ v) for k, v in x.items()}
    model = quality.Discriminant(sums, shrinkage=0.0, ridge=0.0)
    point = rng.normal(0, 1, (5, d))
    lam = {k: d / (len(v) + d) for k, v in x.items()}
    pooled = sum(len(v) / 1100 * np.cov(v.T, bias=True) for v in x.values())
    log = {}
    for k, v in x.items():
        cov = (1 - lam[k]) * np.cov(v.T, bias=True) + lam[k] * pooled
        diff = point - v.mean(0)
        log[k] = np.log(len(v) / 1100) - 0.5 * (np.linalg.slogdet(cov)[1] + np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff))
    assert np.allclose(model.score(point), 1 / (1 + np.exp(log[0] - log[1])), atol=1e-8)


@pytest.fixture(scope="module")
def pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    from feedloom.llm.common import written

    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SMALL), f"test-{name}"))
    return out


def test_pipeline_stages(spark, pipeline):
    docs, clean, known, single, private, packed = pipeline
    for frame in (clean, known, single, private):
        assert frame.columns == docs.columns
    counts = [f.count() for f in pipeline[:5]]
    assert counts == sorted(counts, reverse=True) and counts[3] == counts[4] and counts[4] > 0.5 * counts[0]
    assert known.filter("lang is null").count() == 0
    sets = {}
    for r in single.collect():
        own = odd.shingles(r.text)
        assert own not in sets, "copies stayed"
        sets[own] = r.doc_id
    import test_pii

    assert all(test_pii.base(r.text) == "" for r in private.collect())
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    want = {r.doc_id: [*library.encode(r.text, add_special_tokens=False).ids, 2] for r in private.collect()}
    got = {}
    for r in packed.orderBy("doc_id", "start").collect():
        got.setdefault(r.doc_id, []).extend(r.ids)
    assert got == want


def test_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(names)


def test_top_k_sql(spark):
    from compare import arrow, difference, oracle
    from feedloom.llm.queries import SQL

    con = oracle("0.01")
    for name, sql in SQL.items():
        assert difference(QUERIES[name](spark, SMALL).toArrow(), arrow(con, sql)) == "", name
