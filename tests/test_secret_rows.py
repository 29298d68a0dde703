"""Documents with keys and tokens are rows of the queries that are about them."""

from corpusloom.plans.queries import queries


def test_documents_with_keys_are_reported_and_refused(spark, tmp_path):
    long = " and more words, so that the text is not too short to be imported"
    texts = ["nothing" + long, "AKIA" + "A" * 16 + long, "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----" + long, "ghp_" + "a1" * 10 + long, "password = hunter22 AKIA" + "B" * 16 + long, "the words PRIVATE KEY alone" + long, None]
    spark.createDataFrame([(200 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    classes = {r.doc_id: r.classes for r in queries()["secrets"](spark, str(tmp_path)).collect()}
    assert {k - 200: v for k, v in classes.items()} == {0: "", 1: "aws-key", 2: "private-key", 3: "token", 4: "aws-key|assignment", 5: "", 6: ""}
    got = {r.doc_id: (r.reason, r.decision) for r in queries()["import_decisions"](spark, str(tmp_path)).collect()}
    got = {k - 200: v for k, v in got.items()}
    assert got == {**{i: ("credential", "refused") for i in range(1, 5)}, **{i: (None, "accepted") for i in (0, 5)}, 6: ("short", "skipped")}
