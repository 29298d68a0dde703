"""The pipeline's line dedup and near-dedup on large groups of exact copies."""

from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import near_dedup


def test_one_of_many_exact_copies_stays(spark):
    text = lambda k: "\n".join(f"{k} line {i} of a text with words of its own number {i * 7 + k}" for i in range(6))
    rows = [(i, text(1)) for i in range(12)] + [(100 + i, text(2) + "\n \n") for i in range(25)] + [(200 + i, f"{text(3 + i)}\nshared by all") for i in range(15)]
    rows += [(300, None), (301, ""), (302, " \n"), (None, text(1)), (3, text(1))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    lines = corpus_pipeline.drop_lines(spark, docs, "")
    assert lines.count() == len(rows)
    got = corpus_pipeline.drop_near_copies(spark, lines, "").where(F.col("text").rlike(r"\S")).distinct().collect()
    texts = [r.text for r in got]
    assert texts.count(text(1)) == 1 and texts.count(text(2) + "\n \n") == 1
    assert sorted(t for t in texts if t not in (text(1), text(2) + "\n \n")) == sorted(text(3 + i) for i in range(15))
    assert all(r.n_chars == len(r.text) for r in got)


def test_rows_that_share_an_id_are_one_document(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(7, a), (7, b), (3, b), (9, a), (9, ""), (20, ""), (20, None), (21, "alone here"), (21, "elsewhere too"), (None, a), (8, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, 2, 80).collect())
    want = sorted((d is None, d or 0, {7: 3, 3: 3, 9: 3, 20: 20, 21: 21, 8: 8, None: None}[d], d in (3, 20, 21, 8, None)) for d, _ in rows)
    assert got == want
    docs = df.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "0L AS n_chars")
    assert sorted(r.doc_id or 0 for r in near_dedup.one_of_each(docs, 2).collect()) == [0, 3, 8, 20, 20, 21, 21]


def test_many_pairs_of_one_row(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "HEAD_PAIRS", 3)
    rows = [(i, " ".join(f"w{k}" for k in range(60) if k != i)) for i in range(25)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 2, 80).collect()
    assert {r.component_id for r in got} == {0}
