"""Queries on tables made for a case, against their SQL."""

import duckdb
from conftest import rows_of

from corpusloom.plans.queries import oracle_sql, queries


def same(spark, name, folder, **tables):
    c = duckdb.connect()
    for table, sql in tables.items():
        c.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = queries()[name](spark, str(folder))
    found = c.execute(f"SELECT {', '.join(df.columns)} FROM ({oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert found and rows_of(got, df.columns) == rows_of(found, df.columns)
    return df


def test_names_on_most_pages_stay(spark, tmp_path):
    # A name on four of six pages or more went like the line that starts them.
    same(spark, "page_texts", tmp_path, part="SELECT i AS p_partkey, CASE WHEN i < 6 THEN 'hot ring' WHEN i % 6 < 4 THEN 'red bolt' ELSE 'part ' || i END AS p_name FROM range(18) r(i)")


def test_expected_values_over_cores(spark, tmp_path):
    df = same(spark, "matches_expected", tmp_path, part="SELECT i AS p_partkey, (i % 50)::INTEGER AS p_size, 'Brand#' || i % 12 AS p_brand FROM range(100) r(i)")
    # One scan of few partitions was one task, and took each expected value apart for each row.
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert "regexp_extract" not in df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_empty_texts_are_files_too(spark, tmp_path):
    # Spark's file sources pass over files of no bytes, so that rows were missing.
    docs = "SELECT i AS doc_id, CASE WHEN i % 5 = 0 THEN '' WHEN i % 5 = 1 THEN NULL ELSE 'text ' || i END AS text, 'en' AS lang, 'src' AS source, 5 AS n_chars FROM range(60) r(i)"
    for name in ("folder_texts", "markdown_corpus"):
        same(spark, name, tmp_path, documents=docs, labels="SELECT 1 AS doc_id, 1 AS quality, 0 AS toxic")
