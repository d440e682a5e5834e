"""A corpus pipeline of five stages, each a table written and read again by the next.

Every stage works on all rows its predecessor kept. The first four return the
columns of documents; the last returns each document's token ids and their digests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphmill.llm import bpe, decontaminate, minhash, queries, suffix, toxicity
from graphmill.llm.common import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go; its lexicon is learnt from the labels of docs.

    Null and empty texts stay, repeated rows are judged alike, a null doc_id is judged but
    never learnt; without toxic labels, or rows, nothing goes.
    """
    return toxicity.without_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id.

    Rows without words or with a null doc_id all stay; of rows that repeat a kept id one stays.
    """
    return minhash.without_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that also start earlier are cut out; documents left with nothing go.

    Null and empty texts stay; a null doc_id comes before all others, equal rows are one document.
    """
    return suffix.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none, repeated rows are judged alike."""
    return decontaminate.without_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the remaining texts by the BPE automaton, with the digests of ids and decoded text.

    A row for each row, repeated and null ids too; a null text counts as empty.
    """
    return bpe.round_trip(docs, queries.vocabulary_path(), keep_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", tokenize),
]

#: SQL can't express the automata and the learnt lexicon; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the table documents."""
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = table(docs, f"pipeline-{name}")
    return docs
