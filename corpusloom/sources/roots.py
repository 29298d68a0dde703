"""Where corpora lie: their folders and indexes by settings, sources of any shape, locks, memories of files, and index jobs."""

from __future__ import annotations

import json
import os
import time
import zipfile
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.scopes import CORPORA
from corpusloom.sources import markdown, sinks, transcripts
from corpusloom.sources.markdown import HANDOFF_PATTERNS, valid_corpus_name, within

#: What switches a corpus off.
OFF = ("0", "false")


@dataclass(frozen=True)
class Settings:
    """store: the curated folder. base: where indexes lie unless `indexes` names another place for a corpus, or one of OFF. projects: a
    folder whose children may hold a memory folder. library: a folder of categories. switches: off-values by corpus."""

    store: str
    base: str
    staging: str | None = None
    projects: str | None = None
    extra_projects: tuple[str, ...] = ()
    handoff: tuple[str, ...] = ()
    library: str | None = None
    indexes: dict[str, str] = field(default_factory=dict)


def categories(s: Settings) -> list[str]:
    """Library categories: folders with a sound name."""
    if not s.library or not os.path.isdir(s.library):
        return []
    return sorted(n for n in os.listdir(s.library) if os.path.isdir(os.path.join(s.library, n)) and valid_corpus_name(n) and n not in CORPORA)


def roots(s: Settings) -> list[dict]:
    """All roots {corpus, dir, project?, match?}: curated, staging, other projects' memory folders (found and named, each once), handoff
    notes by their names, and library categories. Folders that aren't there are left out."""
    out = [{"corpus": "curated", "dir": s.store}]
    if s.staging:
        out.append({"corpus": "staging", "dir": s.staging})
    found = []
    if s.projects and os.path.isdir(s.projects):
        found = [os.path.join(s.projects, n, "memory") for n in sorted(os.listdir(s.projects))]
    seen = {os.path.realpath(s.store)}
    for d in (*found, *s.extra_projects):
        if os.path.isdir(d) and os.path.realpath(d) not in seen:
            seen.add(os.path.realpath(d))
            out.append({"corpus": "projects", "dir": d, "project": os.path.basename(os.path.dirname(os.path.abspath(d)))})
    out += [{"corpus": "handoff", "dir": d, "match": ["|".join(f"(?:{p})" for p in HANDOFF_PATTERNS)]} for d in s.handoff]
    out += [{"corpus": c, "dir": os.path.join(s.library, c)} for c in categories(s)]
    return [r for r in out if os.path.isdir(r["dir"])]


def index_path(s: Settings, corpus: str) -> str | None:
    """Where a corpus's index lies; None if it is switched off. An unknown name is a library's, never the curated one."""
    own = s.indexes.get(corpus)
    if own is not None:
        return None if own.lower() in OFF else own
    if corpus not in CORPORA and s.indexes.get("library", "").lower() in OFF and "library" in s.indexes:
        return None
    return os.path.join(s.base, f"index-{corpus}" if corpus in CORPORA else f"index-library-{corpus}")


def read_source(spark: SparkSession, path: str, scratch: str | None = None) -> tuple[str, DataFrame]:
    """(shape, rows): a chat export (title, text) from a .json or a .zip that holds one, else files (file, title, text, skipped).

    A zip is unpacked into `scratch`; members that would lie outside of it, and links, are left out.
    """
    if os.path.isfile(path) and path.lower().endswith(".zip"):
        if scratch is None:
            raise ValueError("a zip needs a folder to be unpacked into")
        with zipfile.ZipFile(path) as z:
            for m in z.infolist():
                linked = (m.external_attr >> 16) & 0o170000 == 0o120000
                if not linked and not m.is_dir() and os.path.realpath(os.path.join(scratch, m.filename)).startswith(os.path.realpath(scratch) + os.sep):
                    z.extract(m, scratch)
        talk = os.path.join(scratch, "conversations.json")
        if os.path.isfile(talk) and within(scratch, talk):
            return "chat export (zip)", transcripts.read_export(spark, talk)
        return "zip of files", markdown.read_texts(spark, scratch)
    if os.path.isfile(path) and path.lower().endswith(".json"):
        rows = transcripts.read_export(spark, path)
        if not rows.isEmpty():
            return "chat export", rows
        return "JSON as text", spark.read.text(path, wholetext=True).select(F.lit(os.path.basename(path)).alias("file"), F.lit(os.path.basename(path)).alias("title"), F.col("value").alias("text"), F.lit(None).cast("string").alias("skipped"))
    return ("folder of files" if os.path.isdir(path) else "single file"), markdown.read_texts(spark, path)


class Lock:
    """One writer at a time: a file with the writer's process id; that of a dead process is taken over."""

    def __init__(self, path: str):
        self.path, self.held = path, False

    def acquire(self) -> bool:
        for _ in range(2):
            try:
                with os.fdopen(os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY), "w") as f:
                    f.write(str(os.getpid()))
                self.held = True
                return True
            except FileExistsError:
                try:
                    with open(self.path) as f:
                        pid = int(f.read() or 0)
                    if pid > 0:
                        os.kill(pid, 0)
                    return False
                except PermissionError:
                    return False
                except (ProcessLookupError, ValueError):
                    try:
                        os.unlink(self.path)
                    except FileNotFoundError:
                        pass
        return False

    def release(self) -> None:
        if self.held:
            os.unlink(self.path)
            self.held = False


class Memo:
    """What `make` gives for a key, for `seconds`. clock: for tests."""

    def __init__(self, make: Callable, seconds: float, clock: Callable[[], float] = time.time):
        self.make, self.seconds, self.clock, self.held = make, seconds, clock, {}

    def __call__(self, key):
        now = self.clock()
        if key not in self.held or now - self.held[key][0] >= self.seconds:
            self.held[key] = (now, self.make(key))
        return self.held[key][1]


class FileMemo:
    """A JSON file's content, read again when its time or size changes; that it isn't there is remembered too."""

    def __init__(self):
        self.held: dict = {}

    def __call__(self, path: str):
        try:
            st = os.stat(path)
            mark = (st.st_mtime_ns, st.st_size)
        except FileNotFoundError:
            mark = None
        if self.held.get(path, (0,))[0] != mark or path not in self.held:
            value = None
            if mark is not None:
                with open(path, encoding="utf-8") as f:
                    value = json.load(f)
            self.held[path] = (mark, value)
        return self.held[path][1]


class Loaded:
    """An index that is read again when the one on disk is newer than the one loaded."""

    def __init__(self, spark: SparkSession, path: str, dimensions: int):
        self.spark, self.path, self.dimensions, self.at, self.value = spark, path, dimensions, None, None

    def get(self):
        head = sinks.header(self.spark, self.path)
        at = head["built_at"] if head else None
        if self.value is None or (at is not None and (self.at is None or at > self.at)):
            self.value, self.at = sinks.read_index(self.spark, self.path, self.dimensions), at
        return self.value


class Jobs:
    """Index builds by output: one in flight for each, and what became of the last. `start` runs a build and keeps its outcome."""

    def __init__(self, clock: Callable[[], float] = time.time):
        self.clock, self.jobs, self.n = clock, {}, 0

    def begin(self, output: str) -> dict:
        running = next((j for j in self.jobs.values() if j["output"] == output and j["state"] == "running"), None)
        if running:
            return running | {"joined": True}
        self.n += 1
        job = {"id": self.n, "output": output, "state": "running", "began": self.clock()}
        self.jobs[self.n] = job
        return job | {"joined": False}

    def end(self, job_id: int, result: dict | None = None, error: str | None = None) -> None:
        self.jobs[job_id] |= {"state": "failed" if error else "done", "seconds": self.clock() - self.jobs[job_id]["began"], "result": result, "error": error}

    def start(self, output: str, build: Callable[[], dict]) -> dict:
        job = self.begin(output)
        if not job["joined"]:
            try:
                self.end(job["id"], build())
            except Exception as e:  # a failed build is an outcome
                self.end(job["id"], error=str(e))
        return self.status(job["id"])

    def status(self, job_id: int) -> dict:
        return dict(self.jobs.get(job_id, {"id": job_id, "state": "unknown"}))
