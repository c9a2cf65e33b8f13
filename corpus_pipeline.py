"""A training corpus from documents: five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the next
one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard, mixing, packing, substring, toxicity
from tidemark.llm.common import cut, drop_cut, prepare, read
from tidemark.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier scores under 0.5. It learns from every label that says toxic.

    Null and empty texts have nothing toxic and stay; rows that repeat fare alike, null ids too; an empty table stays empty.
    """
    prepare(spark)
    return toxicity.clean(docs, toxicity.train(docs, read(spark, sf_dir, "labels"), F.lit(True)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of five-word shingle sets linked at a similarity of 0.8.

    Texts without words and rows without an id stay; of rows that repeat an id one does. An empty table stays empty.
    """
    prepare(spark)
    return jaccard.one_of_each(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier document, or they themselves, hold already. Every row stays, if only empty.

    Rows that repeat id and text are one document and fare alike; null ids come last.
    """
    prepare(spark)
    return substring.without_repeats(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: weights 5, 2, 1 in turn, 150 % of all words, at most twice a source.

    Null texts and texts without words have nothing to take and go as their source's share falls; a null source is a
    source, and rows that repeat are rows.
    """
    prepare(spark)
    return mixing.mixed_rows(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, packed by sum of squares; ids are little-endian uint32.

    Every row is a document, a null or empty text that of its end alone; null and repeated ids are kept as they are.
    """
    prepare(spark)
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("source_mixing", mix_sources),
    ("packing", pack_windows),
]

#: Training a classifier and tokenising can't be said in SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        drop_cut(before)
    return STAGES[-1][1](spark, docs, sf_dir)
