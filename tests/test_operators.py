import datetime as dt

from pyspark.sql import functions as F

from corpusloom.operators import claims, lexical, ranking, recall, structure, upkeep

NOW = dt.datetime(2024, 7, 1)


def docs(spark, rows):
    return spark.createDataFrame(rows, "corpus string, name string, description string, body string")


def test_statistics_stay_in_their_corpus_and_queries_without_terms_give_nothing(spark):
    d = docs(spark, [("a", "one", "pump seal", "the pump leaks"), ("a", "two", "rota", None), ("b", "one", "pump", "pump pump")])
    model = lexical.build_model(d)
    q = spark.createDataFrame([(1, "pump seals"), (2, ""), (3, None), (4, "unheard")], "query_id int, query string")
    rows = {(r.query_id, r.corpus, r.name): r.raw for r in lexical.keyword_scores(model, q).collect()}
    assert set(rows) == {(1, "a", "one"), (1, "b", "one")}
    stats = {(r.query_id, r.corpus): r for r in lexical.term_statistics(model, q).collect()}
    assert stats[(4, "a")].orphan_share == 1 and stats[(4, "a")].orphans == ["unheard"]
    assert stats[(1, "a")].present == ["pump", "seal"]


def test_sections_count_as_one_file(spark):
    rows = [("a", f"p#{i}", "f.md", "pump", "x") for i in range(5)] + [("a", "q", "q.md", "rota", "y")]
    d = spark.createDataFrame(rows, "corpus string, name string, file string, description string, body string")
    m = lexical.build_model(d)
    assert m.stats.first().n_docs == 2 and m.df.where("term = 'pump'").first().df == 1


def test_archive_rows_get_room_only_at_the_end(spark):
    rows = [(1, "c", f"n{i}", "archive" if i < 6 else "hot", i + 1) for i in range(8)]
    page = ranking.cap_archive_share(spark.createDataFrame(rows, "query_id int, corpus string, name string, tier string, rank int"), 4).orderBy("place").collect()
    assert [r.name for r in page] == ["n0", "n1", "n6", "n7"]
    page = ranking.cap_archive_share(spark.createDataFrame(rows[:5], "query_id int, corpus string, name string, tier string, rank int"), 4).orderBy("place").collect()
    assert [r.name for r in page] == ["n0", "n1", "n2", "n3"]


def test_spread_pays_linked_rows_once(spark):
    rows = [(1, "c", "a", 0.9, 0.5, 1), (1, "c", "b", 0.5, 0.5, 2), (1, "c", "d", 0.4, 0.1, 3)]
    s = spark.createDataFrame(rows, "query_id int, corpus string, name string, score double, semantic double, rank int")
    e = spark.createDataFrame([("c", "a", "b"), ("c", "b", "a"), ("c", "a", "d"), ("c", "a", "a")], "corpus string, src string, dst string")
    got = {r.name: (round(r.score, 4), r.givers) for r in ranking.spread(s, e).collect()}
    assert got == {"a": (0.99, ["b", "d"]), "b": (0.59, ["a"]), "d": (0.4, None)}


def test_verdicts(spark):
    scored = spark.createDataFrame([(1, "c", "a", 0.6, 0.0, 1), (2, "c", "a", 0.1, 0.0, 1)], "query_id int, corpus string, name string, score double, phrase double, rank int")
    scores = spark.createDataFrame([(1, "c", "a", 9.0), (2, "c", "a", 0.1)], "query_id int, corpus string, name string, raw double")
    stats = spark.createDataFrame([(1, "c", 10.0, 10.0, 0.0, []), (2, "c", 10.0, 10.0, 0.0, []), (3, "c", 0.0, 5.0, 1.0, ["x"])], "query_id int, corpus string, ideal double, ideal_full double, orphan_share double, orphans array<string>")
    got = {r.query_id: (r.confidence, r.no_strong_match) for r in ranking.verdict(scored, scores, stats).collect()}
    assert got == {1: ("high", False), 2: ("low", True), 3: ("none", True)}
    assert {r.confidence for r in ranking.verdict(scored, scores, stats, hybrid=False).collect()} == {"unrated", "none"}


def test_semantic_text_is_the_best_chunks_even_if_the_summary_wins(spark):
    v = spark.createDataFrame([("c", "a", 0, [0.6, 0.8], "chunk"), ("c", "a", None, [1.0, 0.0], "summary"), ("c", "b", None, [0.9, 0.1], "only")], "corpus string, name string, chunk_ix int, vec array<double>, text string")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vec array<double>")
    assert {r.name: r.text for r in ranking.semantic_scores(v, q).collect()} == {"a": "chunk", "b": "only"}


def test_large_documents_split_into_sections(spark):
    body = "# T\n" + "".join(f"## Part v{i}\n" + "word " * 1500 + "\n" for i in (1, 2, 3, 4))
    d = spark.createDataFrame([("c", "big", "big.md", "memory", "d", body, "hot"), ("c", "small", "s.md", "memory", "d", "## x\ny", "hot"), ("c", "m", "MEMORY.md", "memory", "d", body, "hot")], "corpus string, name string, file string, type string, description string, body string, tier string")
    got = {r.name: r for r in structure.with_section_docs(d).collect()}
    assert set(got) == {"big", "small", "m", "big#part-v1", "big#part-v2", "big#part-v3", "big#part-v4"}
    assert got["big"].is_section_parent and got["big"].body.startswith("## Part v1\n## Part v2")
    assert got["big#part-v1"].tier == "archive" and got["big#part-v4"].tier == "hot" and got["big#part-v2"].parent_name == "big"


def test_outline_section_and_view(spark):
    d = docs(spark, [("c", "a", None, "# A\nx\n## B b\ny\n# C\nz")])
    o = structure.outline(d).orderBy("heading_no").collect()
    assert [(r.level, r.heading, r.char_start, r.char_end) for r in o] == [(1, "A", 0, 15), (2, "B b", 6, 15), (1, "C", 15, 20)]
    assert structure.section_of(structure.outline(d), "b").first().heading == "B b"
    assert tuple(structure.view(d, 2, 3).first())[2:] == ("A\nx", 20, True)


def test_listing_lifts_archived_documents(spark):
    d = spark.createDataFrame([("c", "a", "a.md", "archive"), ("c", "b", "b.md", "archive"), ("c", "x", "x.md", "hot")], "corpus string, name string, file string, tier string")
    m = spark.createDataFrame([("c", "[[a]] and [t](b.md)")], "corpus string, body string")
    assert {r.name: (r.in_memory_index, r.tier) for r in structure.listed(d, m).collect()} == {"a": (True, "hot"), "b": (True, "hot"), "x": (False, "hot")}


def test_versions_and_moves(spark):
    d = spark.createDataFrame([("c", f"alpha-v{i}", "hot", False, False) for i in range(1, 7)] + [("c", "beta-v1", "hot", False, True), ("c", "beta-v2", "hot", True, False)], "corpus string, name string, tier string, read_only boolean, in_memory_index boolean")
    assert {r.name for r in structure.version_tiers(d).where("tier = 'archive'").collect()} == {"alpha-v1", "alpha-v2", "alpha-v3"}
    got = {r.name: (r.tier, r.refused) for r in structure.move_tier(d, ["alpha-v1", "beta-v1", "beta-v2"], "archive").where("name like 'beta%' or name = 'alpha-v1'").collect()}
    assert got == {"alpha-v1": ("archive", False), "beta-v1": ("hot", True), "beta-v2": ("hot", True)}


def test_latest_relaxes_only_for_several_terms(spark):
    d = spark.createDataFrame([("c", "n1", None, "alpha beta", dt.datetime(2024, 1, 1)), ("c", "n2", None, "alpha", dt.datetime(2024, 2, 1)), ("c", "n3", None, None, None)], "corpus string, name string, description string, body string, modified timestamp")
    q = spark.createDataFrame([(1, "alpha beta"), (2, "alpha zeta"), (3, "zeta"), (4, "a")], "query_id int, query string")
    page = recall.latest(recall.term_hits(d, q)).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.name, r.relaxed) for r in page] == [(1, "n1", False), (2, "n2", True), (2, "n1", True)]


def test_threads_in_order_of_time_when_names_are_mixed(spark):
    rows = [("s", "x-0a1b2c3d-0001", dt.datetime(2024, 1, 2)), ("s", "x-0a1b2c3d-20240101T000000000Z", dt.datetime(2024, 1, 1))]
    p = recall.thread_positions(spark.createDataFrame(rows, "session_id string, name string, ts timestamp"))
    assert [r.name[-4:] for r in p.orderBy("position").collect()] == ["000Z", "0001"]


def test_probes(spark):
    p = spark.createDataFrame(
        [("a", "file_exists f", None, None), ("b", "file_exists g", "true", None), ("c", "grep_count f :: one", ">=2", None), ("d", "date_past 2020-01-01", None, None), ("e", "port_listening 80", None, None), ("f", "grep_count f :: one", "7", None), ("g", "", None, None), ("h", "date_past 2020-01-01", None, dt.datetime(2021, 1, 1))],
        "name string, probe string, expected string, valid_until timestamp",
    )
    f = spark.createDataFrame([("f", "one\ntwo one\nx")], "path string, text string")
    got = {r.name: r.verdict for r in upkeep.probe_verdicts(p, f, F.lit(NOW)).collect()}
    assert got == {"a": "FRESH", "b": "STALE", "c": "FRESH", "d": "FRESH", "e": "UNKNOWN", "f": "STALE", "g": "UNPROVABLE", "h": "UNPROVABLE"}
    page = spark.createDataFrame([("a",), ("b#part",), ("z",)], "name string")
    assert {r.name: r.verdict for r in upkeep.attach_verdicts(page, spark.createDataFrame(list(got.items()), "name string, verdict string")).collect()} == {"a": "FRESH", "b#part": "STALE", "z": None}


def test_cited_commits_first_repository_wins(spark):
    c = spark.createDataFrame([("abcdef1234567", "r2", "s2"), ("abcdef1299999", "r1", "s1")], "sha string, repo string, subject string")
    r = spark.createDataFrame([("r1", 0), ("r2", 1)], "repo string, place int")
    cited = spark.createDataFrame([("n", "abcdef12"), ("n", "0000000")], "name string, sha string")
    assert [tuple(x) for x in upkeep.verified_shas(cited, c, r).collect()] == [("n", "abcdef12", "abcdef1299999", "r1", "s1")]


def test_curation_due_and_claims(spark):
    t = lambda *a: F.lit(dt.datetime(*a))
    row = spark.range(1).select(
        upkeep.curation_due(t(2024, 1, 3), t(2024, 1, 1), F.lit(25)).alias("a"), upkeep.curation_due(t(2024, 1, 3), t(2024, 1, 1), F.lit(24)).alias("b"), upkeep.curation_due(t(2024, 1, 3), F.lit(None).cast("timestamp"), F.lit(0)).alias("c"),
        upkeep.claim_share(F.array(*map(F.lit, ("aa", "bb", "cc", "dd"))), F.lit("AA bb")).alias("d"), upkeep.claim_share(F.array(F.lit("aa")), F.lit("aa")).alias("e"),
        recall.route(F.lit("what did we decide last week")).alias("f"), recall.looks_technical(F.lit("run lib/x.py")).alias("g"), recall.looks_technical(F.lit("who signs off")).alias("h"),
    ).first()
    assert tuple(row) == (True, False, True, 0.5, None, "all", True, False)


def test_empty_tables(spark):
    d = docs(spark, [])
    q = spark.createDataFrame([(1, "x y")], "query_id int, query string")
    assert lexical.keyword_scores(lexical.build_model(d), q).count() == 0
    assert structure.sections(d).count() == 0 and structure.link_edges(d).count() == 0 and structure.outline(d).count() == 0


def test_claims(spark):
    one = lambda v, f: spark.createDataFrame([(v,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]
    assert one("**Asked:** what is wrong?\n\nI was wrong about the pump.", claims.corrects)
    assert not one("**Asked:** I was wrong, right?\n\nNo.", claims.corrects)
    assert not one("I misread it; the memory says 5.", claims.corrects) and not one("Scratch that, let me check first.", claims.corrects)
    assert one("Scratch that. Let me check first.", claims.corrects) and not one("Nothing here.", claims.corrects) and not one("The memory does record it: I was wrong.", claims.corrects)
    long = "Before. So my earlier claim on it was wrong and " + "x" * 500
    assert one(long, lambda c: claims.correction_sentence(c)) == (" So my earlier claim on it was wrong" + " and " + "x" * 500)[:265]
    assert one("**Asked:** x", claims.assistant_half) == "" and one("plain", claims.assistant_half) == "plain"
    assert one("a-b-c-d-e", claims.project_label) == "c-d-e"
    w = spark.createDataFrame([("s", "/r/notes/long-file-name.md"), ("s", "/tmp/x"), ("s", "/r/a.py")], "session_id string, path string")
    p = spark.createDataFrame([("s", "wrote long-file-name.md and a.py")], "session_id string, text string")
    assert {(r.path, r.kind, r.named) for r in claims.durable_writes(w, p).collect()} == {("/r/notes/long-file-name.md", "doc", True), ("/r/a.py", "code", False)}


def test_probe_drafts(spark):
    body = "Tagged macwin-v12 at abc1234 run 1234567\nhttp://localhost:80/x, and http://example.com/ and http://192.168.1.9:8080.\n```\n`/a/b/no.md`\n```\n> `/quoted/a/b.md`\nsee `/a/b/c.md` and\nOrigin: http://localhost:9\nalso `/d/e/f.py` `/tmp/x/y.py` `/share/a/b.md` `/one.html`"
    d = spark.createDataFrame([("c", "n", body, None), ("c", "m", body, "x")], "corpus string, name string, body string, probe string")
    got = [(r.place, r.probe, r.expected) for r in claims.probe_proposals(d, "/repo", 9).orderBy("place").collect()]
    assert got == [(1, "git_rev_parse /repo :: macwin-v12^{}", "~abc1234"), (2, "http_status http://localhost:80/x", "200"), (3, "http_status http://192.168.1.9:8080", "200"), (4, "file_exists /a/b/c.md", "true"), (5, "file_exists /d/e/f.py", "true")]
    assert [r.place for r in claims.probe_proposals(d).collect()] == [1, 2, 3] and "git_rev_parse" not in str(claims.probe_proposals(d).collect())
    row = spark.range(1).select(claims.vacuous(F.lit("grep_count f :: NAME"), F.lit(">= 1")).alias("a"), claims.vacuous(F.lit("grep_count f :: 'x: 1'"), F.lit(">=1")).alias("b"), claims.vacuous(F.lit("grep_count f :: NAME"), F.lit("2")).alias("c")).first()
    assert tuple(row) == (True, False, False)


def test_queues_plans_and_warnings(spark):
    t = lambda *n: spark.createDataFrame([(x, "d") for x in n], "name string, detail string")
    q = claims.curation_queue(t("b"), t("a"), t(), t("c"), t(*"pqrstuv")).collect()
    assert [r.name for r in q] == ["b", "a", "c", "p", "q", "r", "s", "t"]
    plan = spark.createDataFrame([("a", "x", "s", 1), ("b", "x", "s", 2), ("c", "z", "t", 1), ("d", "y", "t", 2)], "old string, new string, session_id string, position int")
    assert {r.old: r.problem for r in claims.migration_plan(plan).collect()} == {"a": "not unique", "b": "not unique", "c": "order", "d": "order"}
    d = spark.createDataFrame([("x",), ("y",), (None,)], "account string")
    assert claims.label_warning(d, "account", ["z"]).first().known == ["x", "y"] and claims.label_warning(d, "account", ["x"]).count() == 0
    f = spark.createDataFrame([("notes.md", "alpha beta", 10), ("z.md", "alpha", 10)], "file string, text string, size int")
    terms = spark.createDataFrame([("alpha",), ("no",)], "term string")
    assert claims.probe_file_terms(terms, f).first().files == ["notes.md", "z.md"]
    r = claims.probe_file_terms(terms, f, budget=15).collect()
    assert [(x.term, x.files, x.truncated) for x in r] == [("alpha", ["notes.md"], True), ("no", ["notes.md"], True)] or [(x.term, x.files, x.truncated) for x in r] == [("alpha", ["notes.md"], True)]
    page = spark.createDataFrame([(1, "a"), (1, "b")], "query_id int, name string")
    kept, gone = claims.live_secrets_out(page, spark.createDataFrame([("b",)], "name string"))
    assert [x.name for x in kept.collect()] == ["a"] and gone.first().withheld == 1
    s = spark.createDataFrame([("a", "1"), ("b", "2")], "name string, hash string")
    assert [x.name for x in claims.accepted_secrets(s, spark.createDataFrame([("a", "1"), ("b", "1")], "name string, hash string")).collect()] == ["b"]
