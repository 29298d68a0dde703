"""From raw documents to token ids: quality rules, line dedup, near-dedup, source mixing, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the columns of
documents. SQL can't express the mix's draws nor the encoder, so that ORACLE_SQL is None and tests compare with brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import line_dedup, mixing, near_dedup, pieces, quality
from corpusloom.llm.common import cut

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no rule."""
    return quality.accepted(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines found in 10 documents or more; of each text that would lose all of its lines, one stays whole."""
    return line_dedup.apply_bitmaps(docs, 10, spare=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles with a similarity of 0.8 or more."""
    return near_dedup.one_of_each(docs, size=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: pieces of documents, by shard, in shuffled order."""
    return mixing.Mix(docs).texts()


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, and whether they decode to the text again."""
    return pieces.sequences(docs, public_tokenizers.path("piece_bpe_32k.model"), ("doc_id", "source"))


STAGES = [("quality rules", quality_rules), ("line dedup", drop_lines), ("near-dedup", drop_near_copies), ("source mixing", mix_sources), ("sentencepiece", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
