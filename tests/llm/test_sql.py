import pytest

from corpusloom.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_gives_the_rows_of_its_sql(same, name):
    same(queries()[name], oracle_sql()[name])


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))


def test_odd_rows_through_queries_and_sql(spark, tmp_path, alike):
    """White space of all kinds, repeated rows and ids, nulls, many copies of a line."""
    import random

    import duckdb

    rng = random.Random(12)
    odd = ["a\rb c\x0bd e\x0cf g h i j k l m", "x\x0by\rz " * 12, None, "", " \x0c\n\r\n\x0b", "One\r\none\n ONE\x0b\n\x1cone", "\x1c \x85 \u00a0 \u2003 q"]
    rows = [(i, t) for i, t in enumerate(odd)] + [(50, "shared line\nown one")] * 12 + [(60 + i, f"Hot\x0b\n \rhot {i}\nhot") for i in range(10)] + [(None, "Hot"), (7, "p q r s t u v"), (7, "other words of one id"), (3, "other words of one id")]
    rows += [(100 + i, " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 40)))) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("op1_line_dedup", "op3_quality_rules", "op7_minhash_near_dedup"):
        alike(queries()[name](spark, str(tmp_path)), con.sql(oracle_sql()[name]))


def test_odd_urls_through_query_and_sql(spark, tmp_path, alike):
    import duckdb

    urls = [None, "", "no scheme/en/", "://", "http://Example.COM/en/x", "http://example.com/EN/x", "https://www.example.com/en/", "http://a.b.net/es/?q#f", "http://net/fr/", "http://x.com?u=http://y.net/es/", "x://casino.org/a", "http://adult-education.org/", "http://spam-filter.org", "http://free-download.io", "http://free--download.io", "http://a.net\n/es/", "http://x.com#a?b", "http://netx/es/"]
    spark.createDataFrame([*enumerate(urls), (4, urls[4])], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    alike(queries()["op4_url_filter"](spark, str(tmp_path)), con.sql(oracle_sql()["op4_url_filter"]))


def test_clashing_columns_of_bitmaps(spark):
    from corpusloom.llm import line_dedup

    df = spark.createDataFrame([(i, "same\nx", 1, 2, 3, 4, 5) for i in range(12)], "doc_id long, text string, bitmap int, n_covered int, n_dropped int, doc int, doc2 int")
    assert all(r.n_dropped == 2 for r in line_dedup.with_bitmaps(df, 10).collect())


def test_a_byte_level_vocabulary_is_counted_whole(spark, documents, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    from corpusloom.llm import token_counts

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    assert not token_counts.splits_at_spaces(t) and token_counts.splits_at_spaces(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    for r in token_counts.count_tokens(documents, path, ("text",)).collect():
        assert r.n_tokens == len(t.encode(r.text or "", add_special_tokens=False).ids)
