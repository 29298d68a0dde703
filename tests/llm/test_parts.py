"""Checkpoints of few documents that are dealt over many partitions are few files."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import common, line_dedup, near_dedup

MANY = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def many(spark):
    before = {k: spark.conf.get(k, None) for k in MANY}
    for k, v in MANY.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_checkpoints_of_a_small_table_are_few_files(spark, documents, many, monkeypatch):
    docs = documents.selectExpr("doc_id", "text", "lang", "source", "n_chars")
    files = []

    def counted(df, *args):
        files.append((out := common.cut(df, *args)).rdd.getNumPartitions())
        return out

    for module in (line_dedup, near_dedup):
        monkeypatch.setattr(module, "cut", counted)
    found = []
    for rows in (20, 1_000_000):
        monkeypatch.setattr(common, "PART_ROWS", rows, raising=False)
        monkeypatch.setattr(common, "CORE_PARTS", 0 if rows == 20 else 1000, raising=False)
        n, start = docs.count(), len(files)
        lines = corpus_pipeline.drop_lines(spark, docs, "")
        kept = corpus_pipeline.drop_near_copies(spark, lines, "")
        found.append(sorted(map(repr, kept.collect())))
        most = max(files[start:])
        assert most <= -(-n // 20) if rows == 20 else most == 24
        assert lines.rdd.getNumPartitions() <= -(-n // 20) or rows != 20
    assert found[0] == found[1] and 0 < len(found[0]) < docs.where(F.col("text").isNotNull()).count()


def test_accepted_rows_of_a_small_table_are_few_parts(spark, documents, many, monkeypatch):
    docs = documents.repartition(24)
    monkeypatch.setattr(common, "PART_ROWS", 100_000)
    whole = sorted(map(repr, corpus_pipeline.quality_rules(spark, docs, "").collect()))
    monkeypatch.setattr(common, "CORE_PARTS", 1)
    kept = corpus_pipeline.quality_rules(spark, docs, "")
    assert kept.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism and sorted(map(repr, kept.collect())) == whole != []
