import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.spans import Terms, runs
from corpusloom.operators import lexical, matches


def corpus(spark, repeat=False):
    rows = [("a", f"n-{i}", f"f{i}", f"pumps leaking {i % 3}", " ".join(["alpha"] * (i % 4) + ["beta", "re-use.d", "gamma"][: i % 3 + 1] + ["delta"] * 5)) for i in range(40)]
    rows += [("b", "n-1", "f1", "alpha", None), ("b", "n-2", "f2", None, "beta beta alpha")]
    rows += [("a", "n-1", "f1", "pumps", "alpha")] * repeat
    return spark.createDataFrame(rows, "corpus string, name string, file string, description string, body string")


def asked(spark):
    return spark.createDataFrame([(1, "alpha beta pumps"), (2, "re-use.d gamma nothing"), (3, ""), (4, "absent"), (5, "delta")], "query_id long, query string")


def rows(df):
    return {(r["query_id"], r["corpus"], r["name"]): round(r["raw"], 9) for r in df.collect()}


@pytest.mark.parametrize("repeat", (False, True))
def test_counts_by_document_give_the_scores_of_postings(spark, repeat):
    docs, q = corpus(spark, repeat), asked(spark)
    whole, own = lexical.build_model(docs), lexical.build_model(docs, q)
    # The model of asked terms had postings of its own before, and pairs of documents and queries were shuffled.
    assert (own.postings is None) == (not repeat)
    got = rows(lexical.keyword_scores(own, q))
    assert got == rows(lexical.keyword_scores(whole, q)) and len(got) > 80
    key = lambda m: sorted(map(tuple, lexical.term_statistics(m, q).select("query_id", "corpus", F.round("ideal", 9), F.round("orphan_share", 9), "present", "absent").collect()))
    assert key(own) == key(whole)


def test_the_best_rows_and_those_on_the_absolute_scale_are_all_there(spark):
    docs, q = corpus(spark).repartition(3), asked(spark)
    m = lexical.build_model(docs, q)
    every = rows(lexical.keyword_scores(m, q))
    best = rows(lexical.keyword_scores(m, q, best=4, digits=4))
    for key in {k[:2] for k in every}:
        wanted = sorted((-round(s, 4), k[2]) for k, s in every.items() if k[:2] == key)[:4]
        assert {n for _, n in wanted} <= {k[2] for k in best if k[:2] == key}
    stats = lexical.term_statistics(m, q)
    absolute = lambda s: {(r["query_id"], r["corpus"], r["name"], r["keyword"]) for r in lexical.absolute_scores(s, stats).collect()}
    assert absolute(lexical.keyword_scores(m, q, stats)) == absolute(lexical.keyword_scores(m, q))
    relative = lambda *x: {(r["query_id"], r["corpus"], r["name"], r["keyword"]) for r in lexical.relative_scores(*x).collect()}
    assert relative(lexical.keyword_scores(m, q), lexical.keyword_scores(m, q, best=1)) == relative(lexical.keyword_scores(m, q))


def test_equal_documents_have_equal_scores(spark):
    # Their sums ran in the order in which a shuffle brought the terms, so that ties went by the last bit instead of by name.
    words = [f"w{i}x" for i in range(9)]
    docs = spark.createDataFrame([("a", f"n{i:04}", "", " ".join(words)) for i in range(600)] + [("a", f"m{i}", "", w) for i, w in enumerate(words)], "corpus string, name string, description string, body string").repartition(7)
    q = spark.createDataFrame([(1, " ".join(words))], "query_id int, query string")
    got = lexical.keyword_scores(lexical.build_model(docs, q), q).where("name like 'n%'")
    assert got.select("raw").distinct().count() == 1 and got.count() == 600


def test_terms_in_python_are_those_of_columns(spark):
    texts = ["Re-use.d PUMPS a/b.c +x- ... İstanbul Kelvin [[x]] it's", "", None, "classes boxes flies using-the e.g. v1.2/3 STRASSE ß", "--- a -b- c++ q/ /r"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for i, got in d.select("i", T.tokenize("t")).collect():
        every = Terms()
        assert [t for run in runs(texts[i]) for t in every[run]] == got


def test_running_best_keeps_ties_by_name():
    import numpy as np

    b = matches._Best(1, 2, 4)
    for names in (("d", "b"), ("c", "a"), ("e",)):
        raw = np.full((1, len(names)), 1.00004)
        i, j = np.nonzero(b.may(np.array([0]), raw))
        b.add(i, np.array(names, dtype=object)[j], raw[i, j])
        b.settle()
    assert b.name.tolist() == ["a", "b"]


def test_chunks_are_counted_without_being_made(spark):
    d = spark.createDataFrame([(" ".join("w" * n),) for n in (0, 1, 199, 200, 201, 360, 361, 1000)] + [(None,)], "t string")
    assert all(a == b for a, b in d.select(T.chunk_count("t"), F.size(T.chunks("t"))).collect())
    plan = d.select(T.chunks("t").alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1  # once for each window of a text before
