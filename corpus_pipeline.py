"""A training corpus in five stages, each an operator of sparkpipe.llm over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpipe.llm import decontaminate, line_dedup, minhash, sentencepieces, toxicity
from sparkpipe.llm.util import read_table, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the ordinal regression, fitted on the labels of sf_dir, calls toxic go; null and empty texts stay."""
    return toxicity.keep_clean(docs, toxicity.fit_toxicity(docs, read_table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go, and rows of which nothing is left; null and empty texts stay."""
    cleaned = line_dedup.drop_repeated_lines(docs)
    return cleaned.where("n_removed = 0 OR trim(text) <> ''").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of five-word-shingle similarity 0.8 stays, that of the smallest id; rows without words all stay."""
    return minhash.one_of_each(docs, shingle_words=5, threshold=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text leaks a benchmark item go, with or without an id; other rows of their id stay."""
    return decontaminate.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, scores, decoded_crc32 (of the text decoded from ids) and n_pieces of each row that is left."""
    encoded = sentencepieces.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), decoded=True)
    return encoded.withColumn("n_pieces", F.size("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("sentencepiece", encode)
]
#: The fitted regression and the lattice search are beyond SQL; tests/llm holds run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
