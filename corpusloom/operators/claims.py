"""Claims in documents: drafts of probes, corrections, durable writes, migrations, and what goes beside a page of results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import constants as K
from corpusloom.operators.sizes import small
from corpusloom.operators.structure import lines

# Phrases that take back a claim; that confirm what was noted; that only announce a look.
CORRECTION = r"(?i)\b(i was wrong|i were wrong|i got .{0,20}wrong|that was wrong|(my|the|that|my earlier|my last) [a-z ]{0,24}(claim|comment|answer|statement|note|advice|reading|assumption)[a-z ]{0,12} was wrong|correction:|i owe you a correction|i misread|i misremembered|i was mistaken|no longer (true|the case|accurate)|scratch that)\b"
CONFIRMATION = r"(?i)\b(the )?memor(y|ies)( note| file)? (says|said|does record|records|has|is right|was right)\b|\bmemory does record\b"
PREAMBLE = r"(?i)\b(let me (check|verify|look|re-?read|confirm)|before I answer|i'll check|going to check)\b"

# Places that don't last, in order; kinds of files by folder and ending.
PASSING = (
    r"^/tmp(/|$)",
    r"^/private/tmp(/|$)",
    r"(?i)(^|/)scratchpad(/|$)",
    r"(^|/)node_modules(/|$)",
    r"(^|/)\.git(/|$)",
    r"/\.claude/projects/[^/]+/(tasks|scratchpad)(/|$)",
    r"(?i)\.memory-index\.json$|\.staging-index\.json$|\.zip$",
)
KINDS = (
    ("kb", r"(?i)/knowledge-base/"),
    ("memory", r"/memory/|/MEMORY\.md$|(?i:/\.claude/.*memory)"),
    ("doc", r"(?i)\.(md|txt|rst)$"),
    ("code", r"(?i)\.(js|mjs|cjs|ts|tsx|jsx|py|sh|bash|zsh|rb|go|rs|c|h|cpp|java|swift|html|css|scss|json|yml|yaml|toml|xml|sql|ipynb)$"),
)


def assistant_half(body: Column) -> Column:
    """What follows the paragraph of the **Asked:** mark; the whole body without one; nothing if nothing follows."""
    at = F.locate("**Asked:**", body)
    rest = F.substring(body, at, F.length(body))
    gap = F.instr(rest, "\n\n")
    return F.when(F.coalesce(at, F.lit(0)) == 0, F.coalesce(body, F.lit(""))).when(gap == 0, "").otherwise(F.substr(rest, gap + 2))


def correction_sentence(text: Column) -> Column:
    """Where a text takes something back: from the full stop before the phrase to the one after it (or 260 characters on), 400 at most;
    null if it doesn't."""
    phrase = F.regexp_extract(text, CORRECTION, 0)
    at = F.instr(F.regexp_replace(text, CORRECTION, "\u0001"), "\u0001")
    before = F.substring(text, F.lit(1), at - 1)
    kept = F.length(F.regexp_extract(before, r"(?s)([^.]*)$", 1))
    behind = F.substr(text, at + F.length(phrase))
    stop = F.instr(behind, ".")
    tail = F.when(stop > 0, F.substring(behind, F.lit(1), stop)).otherwise(F.substring(behind, F.lit(1), F.greatest(F.lit(0), 261 - F.length(phrase))))
    return F.when(text.rlike(CORRECTION), F.substring(F.concat(F.substr(before, F.length(before) - kept + 1), phrase, tail), 1, 400))


def corrects(body: Column) -> Column:
    """Whether the reply in a body takes something back in a sentence that neither confirms what was noted nor announces a look."""
    sentence = correction_sentence(assistant_half(body))
    return F.coalesce(~sentence.rlike(CONFIRMATION) & ~sentence.rlike(PREAMBLE), F.lit(False))


def is_durable(path: Column) -> Column:
    """Whether a path names a place that lasts."""
    passing = reduce(Column.__or__, (path.rlike(p) for p in PASSING))
    return F.coalesce((path != "") & ~passing, F.lit(False))


def kind_of(path: Column) -> Column:
    """kb, memory, doc, code or other; the first that fits."""
    return F.coalesce(*(F.when(path.rlike(p), kind) for kind, p in KINDS), F.lit("other"))


def durable_writes(writes: DataFrame, prose: DataFrame, shortest: int = 12) -> DataFrame:
    """session_id, path, kind, named: each durable path written in a session, and whether the session's prose names it: in full, or by a
    base name of `shortest` characters that only this path of the session has. writes: session_id, path. prose: session_id, text."""
    own = writes.where(is_durable(F.col("path"))).select("session_id", "path").distinct().withColumn("base", F.regexp_extract("path", r"([^/]+)$", 1))
    own = own.withColumn("alike", F.count("*").over(Window.partitionBy("session_id", "base")))
    held = F.contains("text", F.col("path")) | ((F.length("base") >= shortest) & (F.col("alike") == 1) & F.contains("text", F.col("base")))
    named = own.join(prose, "session_id").where(held).select("session_id", "path").distinct().withColumn("named", F.lit(True))
    return own.join(named, ["session_id", "path"], "left").select("session_id", "path", kind_of(F.col("path")).alias("kind"), F.coalesce("named", F.lit(False)).alias("named"))


# Ship tags, commits, addresses of this machine and its network, files in backquotes, and places that don't last.
TAG = r"(^|[\s`(\[{|,])((?:macwin|universal|windows|mac)-v\d+)\b"
TAG_SHA = r"(?:^|[\s`(\[{|,*])([0-9a-f]{7,40})\b"
URL = r"\bhttps?://[A-Za-z0-9.:_-]+(?::\d+)?(?:/[A-Za-z0-9._~:/?#@!$&'()*+,;=%-]*)?"
BACKQUOTED = r"`([^`]+)`"
FILE_PATH = r"^/(?:[^\s`]+/)+[^\s`/]+\.[A-Za-z0-9]{1,6}$"
LOCAL_HOST = r"^(?:localhost|127\.0\.0\.1|\[?::1\]?|10\.\d+\.\d+\.\d+|192\.168\.\d+\.\d+|172\.(?:1[6-9]|2\d|3[01])\.\d+\.\d+)$"
EPHEMERAL = r"^/(?:tmp|var|private/tmp|private/var|dev|proc)/"
UNREACHABLE = ("/share/", "/Volumes/")


def probe_proposals(docs: DataFrame, repo: str = "<repo>", most: int = 3) -> DataFrame:
    """corpus, name, place, probe, expected, evidence: up to `most` drafts from each document that has no probe and is no section: a line's
    one ship tag beside its one commit, local addresses, and files in backquotes, outside fences and quotes.

    Drafts that a ruling vetoes are left out: a <repo> that isn't resolved, a path of another machine, an address after "Origin:", and a
    count of a bare name. docs: corpus, name, body, probe, and parent_name if there are sections.
    """
    whole = docs.where("probe is null")
    whole = whole.where("parent_name is null") if "parent_name" in docs.columns else whole
    rows = lines(whole).where(~F.col("fenced") & (F.trim("line") != "") & ~F.col("line").rlike(r"^\s*>"))
    every = lambda p, g: F.regexp_extract_all("line", F.lit(p), F.lit(g))
    tags, shas = every(TAG, 2), F.filter(every(TAG_SHA, 1), lambda x: ~x.rlike("^[0-9]+$"))
    pair = F.when((F.size(tags) == 1) & (F.size(shas) == 1), F.array(F.struct(F.concat(F.lit(f"git_rev_parse {repo} :: "), F.get(tags, F.lit(0)), F.lit("^{}")).alias("probe"), F.concat(F.lit("~"), F.get(shas, F.lit(0))).alias("expected"))))
    urls = F.filter(F.transform(every(URL, 0), lambda u: F.regexp_replace(u, r"[.,;:)\]]+$", "")), lambda u: F.regexp_extract(u, r"^https?://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1).rlike(LOCAL_HOST))
    urls = F.when(~F.col("line").rlike(r"(?i)origin\s*:"), F.transform(urls, lambda u: F.struct(F.concat(F.lit("http_status "), u).alias("probe"), F.lit("200").alias("expected"))))
    inner = F.transform(every(BACKQUOTED, 1), lambda x: F.trim(x))
    files = F.filter(inner, lambda x: x.rlike(FILE_PATH) & ~x.rlike(EPHEMERAL) & ~x.rlike("[<>*?]") & ~reduce(Column.__or__, (x.startswith(r) for r in UNREACHABLE)))
    files = F.transform(files, lambda x: F.struct(F.concat(F.lit("file_exists "), x).alias("probe"), F.lit("true").alias("expected")))
    none = F.array().cast("array<struct<probe: string, expected: string>>")
    drafts = F.concat(*(F.coalesce(x, none) for x in (pair, urls, files)))
    found = rows.select("corpus", "name", "line_no", F.col("line").alias("evidence"), F.posexplode(drafts).alias("k", "d")).select("corpus", "name", "line_no", "evidence", "k", "d.probe", "d.expected")
    found = found.where(~F.contains("probe", F.lit("<repo>")) & ~vacuous(F.col("probe"), F.col("expected")))
    found = found.groupBy("corpus", "name", "probe", "expected").agg(F.min_by("evidence", F.struct("line_no", "k")).alias("evidence"), F.min(F.struct("line_no", "k")).alias("at"))
    place = F.row_number().over(Window.partitionBy("corpus", "name").orderBy("at", "probe"))
    return found.withColumn("place", place).where(F.col("place") <= most).select("corpus", "name", "place", "probe", "expected", "evidence")


def vacuous(probe: Column, expected: Column) -> Column:
    """A count of a bare name in a file that only has to be there: it stays fresh however the name's value changes."""
    literal = F.trim(F.regexp_extract(probe, r"^\s*grep_count\s.*?\s+::\s+(.*?)(?:\s+::\s.*)?$", 1))
    return F.coalesce(expected.rlike(r"^\s*(>=\s*1|>\s*0)\s*$"), F.lit(False)) & literal.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$")


def curation_queue(secrets: DataFrame, collisions: DataFrame, superseded: DataFrame, undescribed: DataFrame, proposals: DataFrame, most: int = 200, drafts: int = 5) -> DataFrame:
    """kind, name, detail: one queue of all kinds in a fixed order, `most` in all and `drafts` proposals. Each has name and detail."""
    kinds = (("secret-review", secrets), ("name-collision", collisions), ("supersession-candidate", superseded), ("write-description", undescribed), ("probe-proposal", proposals.orderBy("name", "detail").limit(drafts)))
    every = reduce(DataFrame.unionByName, (df.select(F.lit(i).alias("_k"), F.lit(kind).alias("kind"), "name", "detail") for i, (kind, df) in enumerate(kinds)))
    return every.orderBy("_k", "name", "detail").limit(most).drop("_k")


def accepted_secrets(found: DataFrame, accepted: DataFrame) -> DataFrame:
    """Findings (name, hash) that weren't accepted for the very text: a changed hash opens them again. accepted: name, hash."""
    return found.join(accepted.select("name", "hash").distinct(), ["name", "hash"], "left_anti")


def migration_plan(names: DataFrame) -> DataFrame:
    """old, new, problem of a renaming (old, new, session_id, position): new names that meet, or that change a session's order."""
    meets = F.count("*").over(Window.partitionBy("new")) > 1
    w = Window.partitionBy("session_id")
    moved = F.row_number().over(w.orderBy("new")) != F.row_number().over(w.orderBy("position"))
    return names.withColumn("problem", F.when(meets, "not unique").when(moved, "order")).select("old", "new", "problem")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """file, change, held: added, modified and deleted files by hash; deletions are held back for a decision."""
    a, b = before.select("file", F.col("hash").alias("_a")), after.select("file", F.col("hash").alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(F.col("_a") != F.col("_b"), "modified")
    return a.join(b, "file", "full_outer").select("file", change.alias("change")).where("change is not null").withColumn("held", F.col("change") == "deleted")


def label_warning(docs: DataFrame, column: str, wanted: list[str], most: int = 6) -> DataFrame:
    """known: up to `most` labels that the corpus has, if none of its rows has a wanted one; else no row."""
    found = docs.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    known = found.agg(F.slice(F.array_sort(F.collect_set(column)), 1, most).alias("known"), F.max(F.col(column).isin(*wanted)).alias("hit"))
    return known.where(~F.coalesce("hit", F.lit(False))).select("known")


def recency_void(files: DataFrame, page: DataFrame) -> DataFrame:
    """query_id, void: whether an unread changed file is newer than the newest row of the page. files: file_id, state, mtime."""
    newest = files.where(F.col("state").isin("changed", "added")).agg(F.max("mtime").alias("unread"))
    return page.groupBy("query_id").agg(F.max("when").alias("newest")).join(F.broadcast(newest)).select("query_id", F.coalesce(F.col("unread") > F.col("newest"), F.lit(False)).alias("void"))  # one row


def identifier_check(asked: DataFrame, known: DataFrame, timed_out: DataFrame | None = None, most: int = 4) -> DataFrame:
    """query_id, identifier, found (true, false, or null for unknown): the first `most` identifiers of a query against those of repositories."""
    first = asked.select("query_id", F.posexplode(F.slice("identifiers", 1, most)).alias("at", "identifier"))
    k = known.select("identifier").distinct().withColumn("found", F.lit(True))
    rows = first.join(k, "identifier", "left")
    if timed_out is not None:
        rows = rows.join(timed_out.select("identifier").distinct().withColumn("_late", F.lit(True)), "identifier", "left")
    else:
        rows = rows.withColumn("_late", F.lit(None).cast("boolean"))
    return rows.select("query_id", "identifier", F.when(F.col("found"), True).when(F.col("_late"), F.lit(None)).otherwise(F.lit(False)).alias("found"))


def live_secrets_out(page: DataFrame, secrets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(page without rows that are secret by now, query_id and withheld)."""
    kept = page.join(secrets.select("name").distinct(), "name", "left_anti")
    gone = page.join(secrets.select("name").distinct(), "name", "left_semi").groupBy("query_id").agg(F.count("*").alias("withheld"))
    return kept, gone


def without_pool_sessions(turns: DataFrame, scheduled: str) -> DataFrame:
    """Turns of sessions whose first user turn doesn't start a scheduled task (a pattern)."""
    first = turns.where("role = 'user'").groupBy("session_id").agg(F.min_by("text", "line_no").alias("t")).where(F.col("t").rlike(scheduled)).select("session_id")
    return turns.join(first, "session_id", "left_anti")


def with_key_facts(docs: DataFrame, facts: DataFrame, most: int = 3) -> DataFrame:
    """docs with key_facts: facts (name, facts array) of their own name, 3 to 400 characters each, `most` at most."""
    good = F.slice(F.filter(F.transform("facts", lambda x: F.trim(x)), lambda x: F.length(x).between(3, 400)), 1, most)
    return docs.join(facts.select("name", good.alias("key_facts")), "name", "left").withColumn("key_facts", F.coalesce("key_facts", F.array().cast("array<string>")))


def probe_file_terms(terms: DataFrame, files: DataFrame, shortest: int = 3, most: int = 4, budget: int | None = None) -> DataFrame:
    """term, files: unmatchable terms (term) against names or texts of stale files (file, text, size): up to `most` each.

    budget: bytes of files read in order of name; what lies beyond isn't read, and `truncated` says so.
    """
    if budget is not None:
        upto = F.sum("size").over(Window.orderBy("file"))  # stale files of one check: a short list
        files = files.withColumn("_u", upto)
        cut = files.agg((F.max("_u") > budget).alias("truncated"))
        files = files.where(F.col("_u") <= budget)
    t = small(terms.where(F.length("term") >= shortest).select("term").distinct())
    hits = files.join(t, F.contains(F.lower("file"), F.col("term")) | F.contains(F.lower("text"), F.col("term")))
    out = hits.groupBy("term").agg(F.slice(F.array_sort(F.collect_set("file")), 1, most).alias("files"))
    return out.join(F.broadcast(cut)) if budget is not None else out  # one row


def account_of(meta: Column, root: Column, path: Column) -> Column:
    """A document's own account; else its root's; else the folder after /accounts/ in its path."""
    return F.coalesce(meta, root, F.nullif(F.regexp_extract(path, r"/accounts/([^/]+)/", 1), F.lit("")))


def project_label(folder: Column) -> Column:
    """The last three dash-separated parts of a project's folder name, 40 characters at most."""
    return F.substring(F.substring_index(folder, "-", -3), 1, 40)


def domain_advice(override: Column, asked: Column, profile: Column) -> Column:
    """struct(domain, basis): what to advise by: the setting, else a query that looks technical, else the corpus's profile."""
    return F.struct(
        F.coalesce(override, F.when(asked, F.lit("code")), profile).alias("domain"),
        F.when(override.isNotNull(), "override").when(F.coalesce(asked, F.lit(False)), "query").otherwise("profile").alias("basis"),
    )


def report(log: DataFrame) -> DataFrame:
    """A query log's summary, a row for each caller: questions, misses, and the share of misses (4 decimals). log: as for questions(), with caller."""
    key = F.coalesce("query_id", F.concat(F.lit("legacy:"), "q"))
    each = log.groupBy("caller", key.alias("question")).agg(F.bool_and("failed").alias("failed"))
    return each.groupBy("caller").agg(F.count("*").alias("questions"), F.count_if("failed").alias("misses")).withColumn("miss_share", F.round(F.col("misses") / F.col("questions"), 4))


def rescore_due(docs: DataFrame, as_of: Column) -> DataFrame:
    """Curated documents that haven't changed since, and were last scored more than a week ago. docs: hash, curated_hash, curated_at."""
    return docs.where((F.col("hash") == F.col("curated_hash")) & (F.unix_seconds(as_of) - F.unix_seconds("curated_at") > K.RESCORE_DAYS * 86400))
