"""Documents through the training-data operators, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from feedloom import configure
from feedloom.llm import jaccard, language, packing, pii, rules
from feedloom.llm.common import prepare, written
from feedloom.llm.queries import learned


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that failed. NULL texts and texts
    without words are rejected; repeated rows are judged each; no documents give none."""
    return rules.clean(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told. NULL texts and texts without a letter have none
    and go, as do all where no language can be learnt; repeated rows stay each."""
    return language.keep_known(docs, learned())


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id; of rows that repeat
    it one. Texts without words, NULL too, are copies of none and stay."""
    return jaccard.representatives(docs)


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data and what discloses it. All documents stay; a NULL text
    stays NULL, and repeated rows count once as evidence."""
    return pii.clean(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two length, with their ids. A NULL or empty text is a sequence of
    the end id alone; repeated rows are documents each; no documents give no sequence."""
    # one application runs all stages, so each leaves little behind in its workers
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), at_once=400, lasting=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("pii", sanitised),
    ("packing", packed),
]

#: A network tells the languages and a tokenizer cuts the sequences: no SQL for these.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage reads what the one before it wrote."""
    prepare(configure(spark))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
