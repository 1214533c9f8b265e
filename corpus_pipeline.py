"""Corpus pipeline over ``documents``: the stages run in order, each on all that its predecessor kept.

Language ID drops texts without a language; the n-gram Jaccard join keeps one document of each group of
near copies (five words, 0.8); decontamination drops texts that overlap with a test item; mixing drops
or repeats documents as the rates decide that press toxic text to 0 and poor text to its share; the last
stage writes the rest as token ids and reads them back. All but the last return the columns of ``documents``.

Defined results, of every stage: a null text counts as empty; a null id stays null and never joins rows; rows
that share an id are judged by id and text; further columns are carried along, whatever their names; an empty
table gives an empty result, an empty ``benchmark`` or ``labels`` drops nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftlog.llm import decontaminate, jaccard_join, langid, mixing, token_store
from driftlog.llm.queries import TARGETS, tokenizer_path
from driftlog.llm.shared import delete_path, new_path, read


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language; empty texts and texts without letters go. Rows are judged one by one."""
    return langid.with_language(docs, langid.learn(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 0.8 over five words connect: that with the smallest id. Repeated rows
    (id and text) are one document, also if their id is the smallest; rows with a null id and rows without words all stay."""
    return jaccard_join.one_of_each(docs, jaccard_join.join_groups(docs, width=5, percent=80, texts=True))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text overlaps with no test item. Rows are judged one by one; of equal overlaps any one is enough."""
    return decontaminate.without_leaks(docs, read(spark, sf_dir, "benchmark"), trimmed=False, least_item=5)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its rate says: never, once, or repeated. Rows with equal id and text share a decision."""
    return mixing.sampled(docs, mixing.mix(docs, read(spark, sf_dir, "labels"), TARGETS), sure=1.0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each row, from the files; repeated rows are written one after another."""
    return token_store.read_tokens(token_store.write_tokens(docs, tokenizer_path(), end_id=0))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_copies", near_copies),
    ("leaks", leaks),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: SQL cannot express trained models and a tokenizer; the tests compare the pipeline with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            delete_path(spark, last)  # it has served
        last = path
    return docs
