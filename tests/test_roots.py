import json
import os
import subprocess
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import scopes
from corpusloom.sources import files, roots, sinks


def test_roots_and_indexes(tmp_path):
    for d in ("store", "staging", "projects/p1/memory", "projects/p2", "x/y/memory", "notes", "lib/books", "lib/bad name", "lib/curated"):
        os.makedirs(tmp_path / d)
    t = str(tmp_path)
    s = roots.Settings(f"{t}/store", t, f"{t}/staging", f"{t}/projects", (f"{t}/x/y/memory", f"{t}/projects/p1/memory", f"{t}/none"), (f"{t}/notes",), f"{t}/lib", {"handoff": "FALSE", "staging": "/else"})
    assert [(r["corpus"], r.get("project")) for r in roots.roots(s)] == [("curated", None), ("staging", None), ("projects", "p1"), ("projects", "y"), ("handoff", None), ("books", None)]
    assert roots.index_path(s, "handoff") is None and roots.index_path(s, "staging") == "/else"
    assert roots.index_path(s, "curated") != roots.index_path(s, "unknown") and "library-unknown" in roots.index_path(s, "unknown")
    assert roots.index_path(roots.Settings("a", "b", indexes={"library": "0"}), "books") is None


def test_sources_of_any_shape(spark, tmp_path):
    export = [{"title": "T", "create_time": 1.0, "mapping": {"a": {"message": {"author": {"role": "user"}, "create_time": 1.0, "content": {"parts": ["hi"]}}}}}]
    (tmp_path / "e.json").write_text(json.dumps(export))
    (tmp_path / "o.json").write_text('{"a": 1}')
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("conversations.json", json.dumps(export))
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("a.txt", "text")
        z.writestr("../out.txt", "no")
    shape = lambda name, scratch=None: roots.read_source(spark, str(tmp_path / name), scratch and str(tmp_path / scratch))
    assert [shape("e.json")[0], shape("o.json")[0], shape("e.zip", "s1")[0]] == ["chat export", "JSON as text", "chat export (zip)"]
    kind, rows = shape("f.zip", "s2")
    assert kind == "zip of files" and [r.file for r in rows.collect()] == ["a.txt"] and not os.path.exists(tmp_path / "out.txt")
    with pytest.raises(ValueError):
        shape("f.zip")


def test_locks_memories_and_jobs(spark, tmp_path):
    path = str(tmp_path / "lock")
    a, b = roots.Lock(path), roots.Lock(path)
    assert a.acquire() and not b.acquire()
    a.release()
    dead = subprocess.Popen(["true"])
    dead.wait()
    (tmp_path / "lock").write_text(str(dead.pid))
    assert b.acquire()
    now, calls = [0.0], []
    memo = roots.Memo(lambda k: calls.append(k) or len(calls), 3, lambda: now[0])
    assert [memo("x"), memo("x")] == [1, 1]
    now[0] = 3.0
    assert memo("x") == 2
    m, p = roots.FileMemo(), tmp_path / "j.json"
    assert m(str(p)) is None
    p.write_text("[1]")
    assert m(str(p)) == [1] and m(str(p)) == [1]
    jobs = roots.Jobs(lambda: now[0])
    first = jobs.begin("i")
    assert jobs.begin("i")["joined"] and not jobs.begin("k")["joined"]
    jobs.end(first["id"], {"n": 1})
    assert jobs.status(first["id"])["state"] == "done" and jobs.start("i", lambda: 1 / 0)["state"] == "failed" and jobs.status(99)["state"] == "unknown"
    idx = str(tmp_path / "idx")
    d = spark.createDataFrame([("c", "n", "b")], "corpus string, name string, body string")
    ch = spark.createDataFrame([("c", "n", 0, "t", [1.0])], "corpus string, name string, chunk_ix int, text string, vec array<float>")
    sinks.write_index(d, ch, idx, 1, 1, "2024-01-01")
    loaded = roots.Loaded(spark, idx, 1)
    old = loaded.get()
    assert loaded.get() is old
    sinks.write_index(d.union(spark.createDataFrame([("c", "m", "b")])), ch, idx, 1, 1, "2024-01-02")
    assert loaded.get()[0].count() == 2


def test_vectors_batches_and_files(spark, tmp_path):
    with pytest.raises(Exception, match="not of 3 values"):
        spark.createDataFrame([("AACAPw==",)], "c string").select(scopes.decode_vector(F.col("c"), 3)).collect()
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(40)], "id int, text string").coalesce(1)
    got = scopes.embedded(rows, lambda texts: [[float(len(texts)), float(len(t))] if t != "q: t3" else [1.0] for t in texts], 2, "q: ").orderBy("id").collect()
    assert [r.vec for r in got[:4]] == [[16.0, 5.0], [16.0, 5.0], [16.0, 5.0], None] and got[39].vec == [8.0, 6.0]
    assert files.write_files(spark.createDataFrame([("a/b.txt", "x"), ("c.txt", None)], "file string, text string"), str(tmp_path / "out")) == 2
    assert (tmp_path / "out/a/b.txt").read_text() == "x" and (tmp_path / "out/c.txt").read_text() == ""
