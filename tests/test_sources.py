import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import markdown, sinks, transcripts
from corpusloom.streaming import capture


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        f.write(text)


NOTE = "---\nname: note-{0}\ndescription: \"About {0}\"\nmetadata:\n  type: rule\n  tier: archive\n  modified: 2024-01-02T03:04:05Z\n---\n# Head {0}\n\nBody [[note-a]]\n"


def test_corpus_from_files(spark, tmp_path):
    d = str(tmp_path / "notes")
    write(f"{d}/a.md", NOTE.format("a"))
    write(f"{d}/b.md", "﻿" + NOTE.format("b").replace("\n", "\r\n"))
    write(f"{d}/c.md", "just text\n\nmore")
    write(f"{d}/d.md", NOTE.format("d").replace("  type: rule", "  secret: true"))
    write(f"{d}/e.md", "token = abcdefgh12345\n")
    write(f"{d}/sub/f.md", "deeper")
    write(str(tmp_path / "outside.md"), "out")
    os.symlink(str(tmp_path / "outside.md"), f"{d}/g.md")
    files = markdown.list_files(spark, [{"corpus": "curated", "dir": d}, {"corpus": "x", "dir": str(tmp_path / "absent")}])
    kept, excluded = markdown.load_corpus(files)
    got = {r.file: r for r in kept.collect()}
    assert set(got) == {"a.md", "b.md", "c.md"}
    for k in "ab":
        r = got[f"{k}.md"]
        assert (r.name, r.description, r.type, r.tier, r.headings, r.links) == (f"note-{k}", f"About {k}", "rule", "archive", [f"Head {k}"], ["note-a"])
        assert r.modified == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert (got["c.md"].name, got["c.md"].description, got["c.md"].type, got["c.md"].tier) == ("c", "just text", "memory", "hot")
    assert {r.file: r.reason for r in excluded.collect()} == {"d.md": "marked secret", "e.md": "secret: assignment"}
    assert markdown.list_files(spark, [{"corpus": "c", "dir": d, "match": ["^a"]}]).count() == 1


def test_reading_folders_pages_and_chapters(spark, tmp_path):
    d = str(tmp_path / "in")
    write(f"{d}/one.txt", "# Title\ntext")
    write(f"{d}/x/two.html", "<h1>T</h1><p>p</p>")
    write(f"{d}/x/three.pdf", "%PDF")
    write(f"{d}/.hid/four.txt", "no")
    got = {r.file: (r.title, r.skipped) for r in markdown.read_texts(spark, d).collect()}
    assert got == {"one.txt": ("Title", None), "x/two.html": ("T", None), "x/three.pdf": ("three", "no reader for .pdf")}
    t = spark.createDataFrame([("b", "\f".join(f"HEAD\ntext {i}\n{i}" for i in range(4)))], "name string, text string")
    assert markdown.pages_to_headings(t).first().text.startswith("## p.1\n\ntext 0\n0\n\n## p.2")
    long = "h" * 81
    pages = ["  top  \nsub\nbody\nfoot\n1", "top\nsub\n  kept\nfoot\n2", f"{long}\ntop\nx\nfoot\n3", "\n \n", f"{long}\ntop\nsub\ny\nfoot\n4", f"{long}\nz"]
    t = spark.createDataFrame([("p", "\f".join(pages)), ("one", " a\nb "), ("few", "top\na\ftop\nb\ftop\nc")], "name string, text string")
    got = {r.name: r.text for r in markdown.pages_to_headings(t).collect()}
    assert got == {"one": " a\nb ", "few": "## p.1\n\ntop\na\n\n## p.2\n\ntop\nb\n\n## p.3\n\ntop\nc", "p": f"## p.1\n\nsub\nbody\n1\n\n## p.2\n\nsub\n  kept\n2\n\n## p.3\n\n{long}\nx\n3\n\n## p.5\n\n{long}\nsub\ny\n4\n\n## p.6\n\n{long}\nz"}, got
    t = spark.createDataFrame([("b", "Chapter 1 a\nChapter 2 b\nChapter 3 c\nx\nChapter 1 a\ny\nChapter 2 b\nChapter 3 c"), ("c", "Chapter 1\nx")], "name string, text string")
    got = {r.name: r.text for r in markdown.chapters_to_headings(t).collect()}
    assert got["b"] == "Chapter 1 a\nChapter 2 b\nChapter 3 c\nx\n## Chapter 1 a\ny\n## Chapter 2 b\n## Chapter 3 c" and got["c"] == "Chapter 1\nx"
    t = spark.createDataFrame([("b", "BOOK One.\nPART II\n    Canto IV\nCanto IV: the fall\nchapter 9\nChapter Two x"), ("h", "# Head\nPart 1\nPart 2\nPart 3")], "name string, text string")
    got = {r.name: r.text for r in markdown.chapters_to_headings(t).collect()}
    assert got == {"b": "## BOOK One.\n## PART II\n    Canto IV\n## Canto IV: the fall\nchapter 9\n## Chapter Two x", "h": "# Head\nPart 1\nPart 2\nPart 3"}, got


def test_turns_that_no_person_typed(spark):
    texts = ["", "hello", "see <system-reminder>x</system-reminder> here and many more words to make it long enough for all", "a long enough text that holds a <task-notification> somewhere in it, with words", " <cross-session-message from=x>hi there, and many words more than tags</cross-session-message>", "[SYSTEM NOTIFICATION - x", "Caveat: The messages below", "Caveat: other", "<bash-input>ls -la and a lot of words so that tags are few of all</bash-input>", "<b>x</b>", "many words and one <b>tag</b> in a long line of text that a person typed by hand", "[Request interrupted by user]"]
    want = [True, False, True, True, True, True, True, False, True, True, False, False]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(transcripts.is_machine_turn(F.col("t")).alias("m")).collect()
    assert [r.m for r in got] == want
    rows = [("queue-operation", "remove", None, "x", True), ("queue-operation", "remove", "absorbed_mid_turn", "x", True), ("queue-operation", "remove", "delivered_to_agent", "x", True), ("queue-operation", "remove", "cancelled", "x", False), ("queue-operation", "enqueue", None, "x", False), ("queue-operation", "remove", None, " ", False), ("user", "remove", None, "x", False), (None, None, None, None, False)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, want boolean")
    assert all(r.got == r.want for r in df.select("want", transcripts.is_interjection(*map(F.col, "abcd")).alias("got")).collect())

def test_orphan_handoffs(spark):
    p = spark.createDataFrame([("/r/p/HANDOFF.md",), ("/r/HANDOFF.md",), ("/r/p/q/HANDOFF.md",), ("/r/dist/handoff.md",), ("/r/p/notes.md",)], "path string")
    assert [r.path for r in markdown.orphan_handoffs(p, ["/r"]).collect()] == ["/r/p/HANDOFF.md"]


def test_transcripts_become_exchanges(spark, tmp_path):
    say = lambda role, text, s: json.dumps({"type": role, "timestamp": f"2024-01-01T00:00:{s:02}.000Z", "sessionId": "abcdefgh-1", "message": {"role": role, "content": text}})
    report = "<task-notification><result>" + "found it " * 8 + "</result></task-notification>"
    lines = [say("user", "First ask. More", 1), "{torn", say("assistant", [{"type": "text", "text": "r" * 150}, {"type": "tool_use", "text": "no"}], 2), say("user", report, 3), say("assistant", "s" * 60, 4), say("user", "Second", 5), say("assistant", "short", 6)]
    write(str(tmp_path / "t/one.jsonl"), "\n".join(lines) + "\n")
    t = transcripts.read_transcripts(spark, str(tmp_path / "t"))
    assert t.count() == 6
    kind = F.when((F.col("role") == "user") & ~transcripts.is_machine_turn(F.col("text")), "human").when(F.col("role") == "user", "machine").otherwise("assistant")
    ex = transcripts.pair_turns(t.withColumn("kind", kind))
    rows = ex.orderBy("exchange").collect()
    assert [r.ask for r in rows] == ["First ask. More", "Second"]
    assert rows[0].reply.split("\n")[0] == "r" * 150 and rows[0].reply.split("\n")[1].startswith("found it") and rows[0].reply.endswith("s" * 60)
    docs = transcripts.to_documents(transcripts.exchange_names(ex)).collect()
    assert [d.name for d in docs] == ["x-abcdefgh-20240101T000001000Z"]
    assert transcripts.defer_last(ex).count() == 1
    assert transcripts.origin_task(t).first().task == "First ask" and transcripts.last_prompt(t).first().prompt == "Second"


def test_interjections_and_states(spark):
    t = spark.createDataFrame([("s", 1, "human", "a"), ("s", 2, "interjection", "b"), ("s", 3, "human", "b"), ("s", 4, "interjection", "c")], "session_id string, line_no int, kind string, text string")
    assert [r.line_no for r in transcripts.fold_interjections(t).orderBy("line_no").collect()] == [1, 3, 4]
    a = spark.createDataFrame([("x", "s", "1"), ("y", "s", "2"), ("z", "s", "3")], "name string, session_id string, body string")
    b = spark.createDataFrame([("x", "s", "1"), ("y", "s", "9"), ("w", "s", "3")], "name string, session_id string, body string")
    assert {r.name: r.state for r in transcripts.write_states(a, b).collect()} == {"x": "unchanged", "y": "rewritten", "z": "orphan", "w": "new"}
    assert [r.name for r in transcripts.prunable(a, b).collect()] == ["z"]


def test_equal_exchange_names_fail(spark):
    e = spark.createDataFrame([("s", 1, "a", None), ("s", 2, "a", None)], "session_id string, line_no int, ask string, ts timestamp")
    with pytest.raises(Exception, match="two exchanges"):
        transcripts.exchange_names(e).collect()


def test_exports(spark, tmp_path):
    m = lambda role, text, at: {"message": {"author": {"role": role}, "create_time": at, "content": {"parts": [text]}}}
    write(str(tmp_path / "e.json"), json.dumps([{"title": "T", "create_time": 1.0, "mapping": {"a": m("assistant", "yes", 2.0), "b": m("user", "is it?", 1.0), "c": m("system", "s", 0.0), "d": {"message": None}}}]))
    assert [tuple(r)[::2] for r in transcripts.read_export(spark, str(tmp_path / "e.json")).collect()] == [("T", "**user:** is it?\n\n**assistant:** yes")]


def test_index_is_guarded_and_atomic(spark, tmp_path):
    p = str(tmp_path / "idx")
    d = spark.createDataFrame([("c", f"n{i}", "b") for i in range(5)], "corpus string, name string, body string")
    ch = spark.createDataFrame([("c", "n0", 0, "t", [1.0, 0.0])], "corpus string, name string, chunk_ix int, text string, vec array<float>")
    assert sinks.write_index(d, ch, p, 1, 2)["after"] == 5
    with pytest.raises(sinks.Refused):
        sinks.write_index(d, ch, p, 0, 2)
    with pytest.raises(sinks.Refused):
        sinks.write_index(d.limit(0), ch, p, 1, 2)
    with pytest.raises(sinks.Refused):
        sinks.write_index(d, ch, p, 1, 3)
    with pytest.raises(sinks.Refused):
        sinks.write_index(d, ch.withColumn("vec", F.lit(None).cast("array<float>")), p, 1, 2)
    assert sinks.write_index(d.where("name < 'n2'"), ch, p, 1, 2, "now") == {"before": 5, "after": 2, "dropped_half": True}
    assert spark.read.json(p + ".vanished").count() == 3
    docs, chunks, problems = sinks.read_index(spark, p, 2)
    assert docs.count() == 2 and not problems and chunks.first().vec == [1.0, 0.0]
    assert sinks.read_index(spark, p, 9)[2] and sinks.read_index(spark, p, 9)[1].first().vec is None
    assert sorted(x for x in os.listdir(tmp_path) if "build" in x or "new" in x) == []


def test_logs_caches_and_names(spark, tmp_path):
    p = str(tmp_path / "log")
    sinks.append_log(spark.createDataFrame([(1, "a")], "n int, q string"), p)
    with open(os.path.join(p, "part-torn.json"), "w") as f:
        f.write('{"n": 2, "q": "b"}\n{"n": 3, "q')
    assert sorted(r.n for r in sinks.read_log(spark, p, "n int, q string").collect()) == [1, 2]
    sinks.append_log(spark.createDataFrame([(9, "z")], "n int, q string"), p, roll_bytes=1)
    assert [r.n for r in sinks.read_log(spark, p, "n int, q string").collect()] == [9] and os.path.isdir(p + ".1")
    v = spark.createDataFrame([("k", [1.0])], "key string, vec array<float>")
    for _ in range(2):
        sinks.flush_vectors(v, str(tmp_path / "cache"), "m1")
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 1
    items = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "key int, name string")
    got = sinks.import_names(items, spark.createDataFrame([("a",)], "name string"))
    assert sorted(r.file_name for r in got.collect()) == ["a-2", "a-3", "b"]
    before = spark.createDataFrame([("c", "n", "x", "hot")], "corpus string, name string, body string, tier string")
    assert sinks.rewrite_metadata(before, before.withColumn("tier", F.lit("archive"))).first().tier == "archive"
    with pytest.raises(Exception, match="would change"):
        sinks.rewrite_metadata(before, before.withColumn("body", F.lit("y"))).collect()
    snaps = spark.createDataFrame([("n", i) for i in range(9)], "name string, at int")
    assert sinks.newest_snapshots(snaps, 0).count() == 5 and sinks.newest_snapshots(snaps, -3).count() == 1


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "turns"), str(tmp_path / "table")
    os.makedirs(src)
    turn = lambda n, kind, text, s: json.dumps({"session_id": "s", "line_no": n, "kind": kind, "text": text, "ts": f"2024-01-01T00:{s:02}:00Z"})
    write(f"{src}/1.json", "\n".join([turn(1, "human", "one", 0), turn(2, "assistant", "r1", 1)]))
    closed = capture.closed_exchanges(capture.turn_stream(spark, src))
    ck = str(tmp_path / "ck")
    capture.upsert_stream(closed, out, ck, "exchange", "ts").awaitTermination()
    assert not sinks.exists(spark, out) or spark.read.parquet(out).count() == 0
    write(f"{src}/2.json", "\n".join([turn(3, "human", "two", 2), turn(4, "assistant", "r2", 3)]))
    capture.upsert_stream(capture.closed_exchanges(capture.turn_stream(spark, src)), out, ck, "exchange", "ts").awaitTermination()
    assert [(r.exchange, r.ask, r.reply) for r in spark.read.parquet(out).collect()] == [(1, "one", "r1")]
    rows = spark.createDataFrame([(1, "new")], "k int, v string")
    capture.upsert(rows.withColumn("o", F.lit(1)), str(tmp_path / "u"), "k", "o")
    capture.upsert(rows.withColumn("v", F.lit("newer")).withColumn("o", F.lit(0)), str(tmp_path / "u"), "k", "o")
    assert spark.read.parquet(str(tmp_path / "u")).first().v == "newer"


def test_plans_gaps_and_debounce(spark):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    beats = spark.createDataFrame([("a", t(0)), ("a", t(60)), ("a", t(500))], "source string, ts timestamp")
    assert capture.gaps(beats).count() == 1
    touched = spark.createDataFrame([("p", 10, t(700)), ("q", 10, t(700)), ("r", 5, t(1))], "path string, size int, mtime timestamp")
    seen = spark.createDataFrame([("p", 10, t(650)), ("q", 9, t(650))], "path string, size int, at timestamp")
    assert [r.path for r in capture.due(touched, seen).collect()] == ["q", "r"]
    s = spark.createDataFrame([(f"f{i}", "changed") for i in range(9)] + [("g", "removed"), ("h", "same")], "file_id string, state string")
    got = {r.action for r in capture.repair_plan(s).collect()}
    assert got == {"stale", "drop"} and {r.action for r in capture.repair_plan(s, built=False).collect()} == {"repair", "drop"}


def test_a_long_log_keeps_what_was_appended(spark, tmp_path):
    p = f"{tmp_path}/long.jsonl"
    sinks.append_log(spark.sql("SELECT 1 AS n, repeat('x', 21000000) AS q"), p)
    sinks.append_log(spark.createDataFrame([(2, "b")], "n int, q string"), p)
    assert sorted(r.n for r in sinks.read_log(spark, p, "n int").collect()) == [1, 2]  # the log of over 20 MB was put aside before
