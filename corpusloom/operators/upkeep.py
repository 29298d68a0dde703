"""Upkeep of a store: staleness, reuse, audits, query logs, probes, curation and commit joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import constants as K
from corpusloom.functions.scoring import matches_expected
from corpusloom.functions.text import proseness, slug
from corpusloom.operators.sizes import small


def staleness(indexed: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, state (changed, added, removed, same): index rows (file_id, hash) against files (file_id, hash)."""
    a, b = indexed.select("file_id", F.col("hash").alias("_a")), files.select("file_id", F.col("hash").alias("_b"))
    state = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed").otherwise("same")
    return a.join(b, "file_id", "full_outer").select("file_id", state.alias("state"))


def stale_report(states: DataFrame, most: int = 8) -> DataFrame:
    """state, n, some: counts, and `most` names of each."""
    return states.where("state <> 'same'").groupBy("state").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("file_id")), 1, most).alias("some"))


def vanished(before: DataFrame, now: DataFrame) -> DataFrame:
    """Names that were indexed and are no more."""
    return before.select("name").distinct().join(now.select("name"), "name", "left_anti")


def reuse(docs: DataFrame, indexed: DataFrame) -> DataFrame:
    """docs with reused: whether an index row agrees in name, hash and mtime and has chunks."""
    known = indexed.where("n_chunks > 0").select("name", "hash", "mtime").distinct().withColumn("reused", F.lit(True))
    return docs.join(known, ["name", "hash", "mtime"], "left").withColumn("reused", F.coalesce("reused", F.lit(False)))


def cached_vectors(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """chunks (.., text) with key and vec from the cache (key, vec); a null vec is to be computed."""
    return chunks.withColumn("key", F.sha2("text", 256)).join(cache.select("key", "vec"), "key", "left")


def new_vectors(computed: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows of computed (key, vec) that the cache lacks, each key once."""
    return computed.join(cache.select("key"), "key", "left_anti").groupBy("key").agg(F.first("vec").alias("vec"))


def duplicates(docs: DataFrame) -> DataFrame:
    """name, file, kind: shadowed (a name seen before, by file order) or duplicate-body (a body seen before in its session)."""
    by_name = F.row_number().over(Window.partitionBy("corpus", "name").orderBy("file"))
    by_body = F.row_number().over(Window.partitionBy("session_id", F.sha2("body", 256)).orderBy("file"))
    rows = docs.withColumns({"_a": by_name, "_b": by_body})
    return rows.where("_a > 1").select("name", "file", F.lit("shadowed").alias("kind")).union(rows.where("_b > 1 and session_id is not null").select("name", "file", F.lit("duplicate-body").alias("kind")))


def store_audit(stored: DataFrame, extracted: DataFrame) -> DataFrame:
    """kind, name: missing, orphan, dangling-previous, no-session, order (names and times disagree), duplicate-body.

    stored: name, session_id, ts, previous, body. extracted: name.
    """
    parts = [
        extracted.join(stored, "name", "left_anti").select(F.lit("missing").alias("kind"), "name"),
        stored.join(extracted, "name", "left_anti").select(F.lit("orphan").alias("kind"), "name"),
        stored.where("previous is not null").join(stored.select(F.col("name").alias("previous")), "previous", "left_anti").select(F.lit("dangling-previous").alias("kind"), "name"),
        stored.where("session_id is null").select(F.lit("no-session").alias("kind"), "name"),
    ]
    w = Window.partitionBy("session_id")
    ranked = stored.where("session_id is not null and ts is not null").withColumns({"_a": F.row_number().over(w.orderBy("name")), "_b": F.row_number().over(w.orderBy("ts", "name"))})
    parts.append(ranked.where("_a <> _b").select(F.lit("order").alias("kind"), "name"))
    again = F.row_number().over(Window.partitionBy("session_id", F.sha2("body", 256)).orderBy("name"))
    parts.append(stored.where("session_id is not null").withColumn("_n", again).where("_n > 1").select(F.lit("duplicate-body").alias("kind"), "name"))
    return reduce(DataFrame.union, parts)


def questions(log: DataFrame) -> DataFrame:
    """A question for each query_id, or for each asked text without one: failed if every row of it failed.

    log: ts, query_id, scope, q, failed.
    """
    key = F.coalesce("query_id", F.concat(F.lit("legacy:"), "q"))
    return log.groupBy(key.alias("question")).agg(F.bool_and("failed").alias("failed"), F.count("*").alias("n_rows"), F.min("ts").alias("ts"), F.min("q").alias("q"))


def without_benchmark(log: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows whose question isn't one of the benchmark's."""
    return log.withColumn("_k", F.lower("q")).join(benchmark.select(F.lower("q").alias("_k")).distinct(), "_k", "left_anti").drop("_k")


def retries(log: DataFrame, seconds: int = K.RETRY_SECONDS) -> DataFrame:
    """row_id, retried, recovered of each failed row: whether the same caller asks again within `seconds` with a term in common,
    and whether such a retry succeeds. log: row_id, caller, ts, terms, failed.

    Retries are looked up by caller and time slot, so that a busy caller isn't paired with all of its own rows.
    """
    log = log.withColumn("ts", F.col("ts").cast("timestamp"))
    slot = F.floor(F.unix_seconds("ts") / seconds)
    failed = log.where("failed").select("row_id", "caller", "ts", "terms", F.explode(F.array(slot, slot + 1)).alias("slot"))
    later = log.select(F.col("row_id").alias("row2"), "caller", F.col("ts").alias("ts2"), F.col("terms").alias("terms2"), F.col("failed").alias("failed2"), slot.alias("slot"))
    gap = F.unix_micros("ts2") - F.unix_micros("ts")
    after = (F.col("ts2") > F.col("ts")) | ((F.col("ts2") == F.col("ts")) & (F.col("row2") > F.col("row_id")))
    pairs = failed.join(later, ["caller", "slot"]).where(after & (gap <= seconds * 1_000_000) & F.arrays_overlap("terms", "terms2"))
    found = pairs.groupBy("row_id").agg(F.max(~F.col("failed2")).alias("recovered"))
    return log.where("failed").select("row_id").join(found, "row_id", "left").select("row_id", F.col("recovered").isNotNull().alias("retried"), F.coalesce("recovered", F.lit(False)).alias("recovered"))


def failure_shapes(log: DataFrame, most: int = K.FAILURE_SHAPES) -> DataFrame:
    """shape (sorted terms), n: the most common among failed rows."""
    shape = F.array_join(F.array_sort(F.array_distinct("terms")), " ")
    return log.where("failed").groupBy(shape.alias("shape")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "shape").limit(most)


def dead_terms(log: DataFrame, most: int = K.DEAD_TERMS, least: int = K.DEAD_TERM_FAILURES) -> DataFrame:
    """term, failures: terms of `least` failed rows or more and of no successful one."""
    t = log.select(F.explode(F.array_distinct("terms")).alias("term"), "failed").groupBy("term").agg(F.count_if("failed").alias("failures"), F.count_if(~F.col("failed")).alias("successes"))
    return t.where((F.col("failures") >= least) & (F.col("successes") == 0)).select("term", "failures").orderBy(F.desc("failures"), "term").limit(most)


def mode_split(log: DataFrame) -> DataFrame:
    """mode, n, percent (one decimal)."""
    n = log.groupBy("mode").agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))


def telemetry(log: DataFrame) -> DataFrame:
    """name, hits, worst_rank, weak_hits of documents in the log's top lists. log: top array of name and score, no_strong_match."""
    rows = log.select("no_strong_match", F.posexplode("top").alias("at", "t"))
    return rows.groupBy("t.name").agg(F.count("*").alias("hits"), F.max(F.col("at") + 1).alias("worst_rank"), F.count_if("no_strong_match").alias("weak_hits"))


def work_queue(docs: DataFrame, seen: DataFrame, most: int = K.QUEUE_LIMIT) -> DataFrame:
    """name, hits, worst_rank, priority: documents that were never curated or changed since, most wanted first.

    docs: name, hash, curated_hash. seen: telemetry().
    """
    rows = docs.where("curated_hash is distinct from hash").join(seen, "name", "left")
    hits, worst = F.coalesce("hits", F.lit(0)), F.coalesce("worst_rank", F.lit(0))
    return rows.select("name", hits.alias("hits"), worst.alias("worst_rank"), (hits * worst).alias("priority")).orderBy(F.desc("priority"), "name").limit(most)


def curation_due(now: Column, last_run: Column, new_docs: Column) -> Column:
    """Whether a curation run is due: a day has passed and enough documents are new; the first run always is."""
    passed = F.unix_seconds(now) - F.unix_seconds(last_run) >= K.CURATION_HOURS * 3600
    return F.when(last_run.isNull(), F.lit(True)).otherwise(passed & (new_docs >= K.CURATION_DOCS))


def superseded(scores: DataFrame, docs: DataFrame, least: float = K.SUPERSEDE_SIMILARITY) -> DataFrame:
    """newer, older, similarity: similar documents of which one was written before the other. scores: name, neighbour, similarity."""
    d = docs.select("name", "modified")
    rows = scores.where(F.col("similarity") >= least).join(d, "name").join(d.select(F.col("name").alias("neighbour"), F.col("modified").alias("m2")), "neighbour")
    return rows.where("m2 < modified").select(F.col("name").alias("newer"), F.col("neighbour").alias("older"), "similarity")


def claim_share(claim_terms: Column, body: Column) -> Column:
    """The share of a claim's terms that a body holds; null with too few terms."""
    held = F.size(F.filter(claim_terms, lambda t: F.contains(F.lower(body), t)))
    return F.when(F.size(claim_terms) >= K.CLAIM_TERMS, held / F.size(claim_terms))


# Marks of code in a document, and their weights.
CODE_SIGNALS = {
    "fence": "```",
    "path": r"\b[\w.-]+/[\w./-]+\.(js|ts|py|json|md|sh|yml|yaml|html|css|go|rs|java)\b",
    "const": r"\b[A-Z][A-Z0-9]+(?:_[A-Z0-9]+)+\b",
    "sha": r"\b[0-9a-f]{7,10}\b",
    "flag": r"(?:^|\s)--[a-z][a-z0-9-]{2,}\b",
    "call": r"\b[a-zA-Z_$][\w$]*\([^)]{0,40}\)",
}
CODE_WEIGHTS = {"fence": 0.30, "path": 0.25, "const": 0.15, "sha": 0.15, "flag": 0.10, "call": 0.05}


def corpus_profile(docs: DataFrame) -> DataFrame:
    """corpus, code_score, mean proseness (3 decimals both), domain and confidence (2): the weighted shares of documents with each mark
    of code, over all documents."""
    body = F.coalesce("body", F.lit(""))
    shares = docs.groupBy("corpus").agg(*(F.round(F.avg(body.rlike(p).cast("double")), 3).alias(n) for n, p in CODE_SIGNALS.items()), F.round(F.coalesce(F.avg(proseness("body")), F.lit(0.0)), 3).alias("proseness"))
    code = reduce(Column.__add__, (F.col(n) * w for n, w in CODE_WEIGHTS.items()))
    rows = shares.withColumn("code_score", F.round(code, 3))
    domain = F.when(F.col("code_score") >= 0.08, "code").when(F.col("code_score") <= 0.03, "prose").otherwise("mixed")
    sure = F.when(F.col("code_score") >= 0.08, F.least(F.lit(1.0), 0.5 + F.col("code_score"))).when(F.col("code_score") <= 0.03, F.least(F.lit(1.0), 0.6 + 0.4 * F.col("proseness"))).otherwise(0.45)
    return rows.select("corpus", "code_score", "proseness", domain.alias("domain"), F.round(sure, 2).alias("confidence"))


def commits_asof(commits: DataFrame, asks: DataFrame, tail_minutes: int = K.COMMIT_TAIL_MINUTES, keep: int = K.COMMITS_KEPT) -> DataFrame:
    """session_id, name, sha: each commit goes to the last exchange asked at or before it, until the tail after the session's last one.

    commits: session_id, sha, at. asks: session_id, name, ts. One pass over both in time order; no pairing.
    """
    a = asks.where("ts is not null").select("session_id", F.col("ts").cast("timestamp").alias("at"), F.lit(0).alias("kind"), "name", F.lit(None).cast("string").alias("sha"))
    c = commits.select("session_id", F.col("at").cast("timestamp").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("name"), "sha")
    order = Window.partitionBy("session_id").orderBy("at", "kind", "name", "sha").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("session_id")
    rows = a.union(c).withColumns({"last": F.last("name", True).over(order), "end": F.max(F.when(F.col("kind") == 0, F.col("at"))).over(whole)})
    rows = rows.where((F.col("kind") == 1) & F.col("last").isNotNull() & (F.unix_seconds("at") <= F.unix_seconds("end") + tail_minutes * 60))
    n = F.row_number().over(Window.partitionBy("session_id", "last").orderBy("at", "sha"))
    return rows.withColumn("_n", n).where(F.col("_n") <= keep).select("session_id", F.col("last").alias("name"), "sha", "at")


def commits_between(commits: DataFrame, since: Column, until: Column) -> DataFrame:
    """repo, n, newest of commits in a closed interval."""
    return commits.where(F.col("at").between(since, until)).groupBy("repo").agg(F.count("*").alias("n"), F.max("at").alias("newest"))


def commits_since(commits: DataFrame, docs: DataFrame) -> DataFrame:
    """repo, n: commits after the newest document."""
    newest = docs.agg(F.max(F.coalesce("ts", "modified")).alias("newest"))
    return commits.join(F.broadcast(newest), F.col("at") > F.col("newest")).groupBy("repo").agg(F.count("*").alias("n"))


def verified_shas(cited: DataFrame, commits: DataFrame, repos: DataFrame, per_row: int = 12) -> DataFrame:
    """name, sha, repo, subject: citations by prefix; of several repositories the first in repos (repo, place) wins."""
    known = commits.join(small(repos), "repo").withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(7), F.lit(10)), lambda n: F.substring(F.col("sha"), F.lit(1), n))))
    hits = cited.select("name", F.col("sha").alias("prefix")).join(known, "prefix")
    first = F.row_number().over(Window.partitionBy("name", "prefix").orderBy("place", "sha"))
    rows = hits.withColumn("_n", first).where("_n = 1")
    rows = rows.withColumn("_m", F.row_number().over(Window.partitionBy("name").orderBy("prefix"))).where(F.col("_m") <= per_row)
    return rows.select("name", F.col("prefix").alias("cited"), "sha", "repo", "subject")


def parse_probe(probe: Column) -> Column:
    """struct(predicate, args): the first word, and the rest split on " :: "."""
    p = F.trim(probe)
    rest = F.trim(F.regexp_replace(p, r"^\S+", ""))
    return F.struct(F.regexp_extract(p, r"^(\S+)", 1).alias("predicate"), F.when(rest == "", F.array().cast("array<string>")).otherwise(F.split(rest, r"\s+::\s+")).alias("args"))


#: Predicates that can be told from loaded tables. Those of networks, ports, commands and databases are never run: UNKNOWN.
PREDICATES = ("date_past", "file_exists", "file_hash_span", "grep_count")


def probe_verdicts(probes: DataFrame, files: DataFrame, as_of: Column) -> DataFrame:
    """name, verdict (FRESH, STALE, UNKNOWN, UNPROVABLE) of probes (name, probe, expected, valid_until) over files (path, text)."""
    p = probes.withColumn("p", parse_probe(F.col("probe"))).select("name", "expected", "valid_until", "p.predicate", "p.args")
    f = files.select(F.col("path"), "text")
    rows = p.join(f, F.get("args", F.lit(0)) == F.col("path"), "left")
    count = F.when((F.col("predicate") == "grep_count") & (F.coalesce(F.get("args", F.lit(1)), F.lit("")) != ""), F.size(F.filter(F.split("text", "\n"), lambda x: F.contains(x, F.get("args", F.lit(1))))).cast("string"))
    span = F.transform(F.split(F.coalesce(F.get("args", F.lit(1)), F.lit("1-1")), "-"), lambda x: x.try_cast("int"))
    held = F.array_join(F.slice(F.split("text", "\n"), F.greatest(F.lit(1), F.coalesce(F.get(span, F.lit(0)), F.lit(1))), F.greatest(F.lit(0), F.coalesce(F.get(span, F.lit(1)) - F.get(span, F.lit(0)) + 1, F.lit(1)))), "\n")
    actual = (
        F.when(F.col("predicate") == "file_exists", F.col("path").isNotNull().cast("string"))
        .when((F.col("predicate") == "grep_count") & F.col("path").isNotNull(), count)
        .when((F.col("predicate") == "file_hash_span") & F.col("path").isNotNull(), F.substring(F.sha2(held, 256), 1, 12))
        .when(F.col("predicate") == "date_past", (F.get("args", F.lit(0)).try_cast("timestamp") < as_of).cast("string"))
    )
    rows = rows.withColumn("actual", actual)
    wanted = F.coalesce("expected", F.lit("true"))
    verdict = (
        F.when((F.coalesce("predicate", F.lit("")) == "") | (F.col("valid_until") < as_of), "UNPROVABLE")
        .when(~F.col("predicate").isin(*PREDICATES) | F.col("actual").isNull(), "UNKNOWN")
        .when(F.coalesce(matches_expected(F.col("actual"), wanted), F.lit(False)), "FRESH")
        .otherwise("STALE")
    )
    return rows.select("name", "actual", verdict.alias("verdict"))


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """verdict, n: how many probes of a sweep came to each."""
    return verdicts.groupBy("verdict").agg(F.count("*").alias("n"))


def attach_verdicts(page: DataFrame, verdicts: DataFrame) -> DataFrame:
    """page with verdict, by name, else by the parent of a section's name; the page's order stays."""
    v = verdicts.select("name", "verdict")
    own = page.join(v.withColumnRenamed("verdict", "_own"), "name", "left")
    parent = v.select(F.col("name").alias("_parent"), F.col("verdict").alias("_up"))
    return own.join(parent, F.substring_index("name", "#", 1) == F.col("_parent"), "left").withColumn("verdict", F.coalesce("_own", "_up")).drop("_own", "_up", "_parent")


def floors(scores: DataFrame, base_score: float = K.SCORE_FLOOR, base_coverage: float = K.VERDICT_COVERAGE, reference: str = "curated") -> DataFrame:
    """corpus, score_floor, coverage_floor: the base floors scaled by medians of self-queries against the reference corpus's."""
    m = scores.groupBy("corpus").agg(F.median("top_score").alias("score"), F.median("coverage").alias("cover"))
    ref = m.where(F.col("corpus") == reference).select(F.col("score").alias("s0"), F.col("cover").alias("c0"))
    return m.join(F.broadcast(ref)).select(  # one row
"corpus", F.round(base_score * F.col("score") / F.col("s0"), 4).alias("score_floor"), F.round(base_coverage * F.col("cover") / F.col("c0"), 4).alias("coverage_floor"))


def even_sample(rows: DataFrame, key: str, n: int, group: str) -> DataFrame:
    """n rows of each group at places floor(i * size / n) of the order of key."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(key)) - 1
    size = F.count("*").over(Window.partitionBy(group))
    r = rows.withColumns({"_p": place, "_s": size})
    i = F.ceil(F.col("_p") * n / F.col("_s"))
    return r.where((F.col("_s") <= n) | ((i < n) & (F.floor(i * F.col("_s") / n) == F.col("_p")))).drop("_p", "_s")


def distribution(values: DataFrame, column: str, group: str) -> DataFrame:
    """group, n, min, p10, median, p90, max: values at place floor(q * (n - 1)) of the order, never interpolated.

    Counts by value come first, so that a group's rows meet as distinct values.
    """
    n = values.where(F.col(column).isNotNull()).groupBy(group, column).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(group).orderBy(column))
    total = F.sum("_c").over(Window.partitionBy(group))
    rows = n.withColumns({"_u": upto, "_t": total})
    at = lambda q: F.min(F.when(F.col("_u") >= F.floor(q * (F.col("_t") - 1)) + 1, F.col(column)))
    return rows.groupBy(group).agg(F.sum("_c").alias("n"), F.min(column).alias("min"), at(0.1).alias("p10"), at(0.5).alias("median"), at(0.9).alias("p90"), F.max(column).alias("max"))


def separation(values: DataFrame, column: str, group: str, thresholds: list[float]) -> DataFrame:
    """group, threshold, share of rows at or above it (4 decimals)."""
    t = F.explode(F.array(*map(F.lit, thresholds)))
    return values.where(F.col(column).isNotNull()).select(group, column, t.alias("threshold")).groupBy(group, "threshold").agg(F.round(F.avg((F.col(column) >= F.col("threshold")).cast("double")), 4).alias("share"))


# How a question asks for a whole document.
READ_VERB = r"(?i)^\s*(?:summari[sz]e|(?:give\s+me\s+)?(?:an?\s+)?(?:summary|overview)\s+of)\b[:,]?\s*"


def read_task(queries: DataFrame, titles: DataFrame) -> DataFrame:
    """query_id, read_task, title: whether a query asks to read a document: by its verb, or as it is a document's name, by slugs of 8
    characters or more, without the verb and an article before it. titles: title, and parent_name for sections, which don't count."""
    rest = F.regexp_replace(F.regexp_replace("query", READ_VERB, ""), r"(?i)^\s*(?:the|a|an)\s+", "")
    q = queries.withColumn("slug", slug(rest, None, ""))
    whole = titles.where("parent_name is null") if "parent_name" in titles.columns else titles
    t = whole.select(slug("title", None, "").alias("slug"), "title").where(F.length("slug") >= 8).groupBy("slug").agg(F.min("title").alias("title"))
    return q.join(t, "slug", "left").select("query_id", (F.coalesce(F.col("query").rlike(READ_VERB), F.lit(False)) | F.col("title").isNotNull()).alias("read_task"), "title")


def silent_share(writes: DataFrame) -> DataFrame:
    """kind (null: all), durable, named, silent_share (4 decimals): durable writes that no text names. writes: kind, named."""
    n = writes.rollup("kind").agg(F.count("*").alias("durable"), F.count_if("named").alias("named"))
    return n.withColumn("silent_share", F.round(1 - F.col("named") / F.col("durable"), 4))


# What in a text may go out of date. A version is a word; the others are lines.
CURRENCY = {
    "version_token": r"\b(?:v\d{2,3}|Mac v\d+|Win v\d+)\b",
    "status_flag": r"(?m)^.*(?:🟥|✅|⚠️).*$",
    "dated_correction": r"(?im)^.*\b(?:corrected|fixed|superseded|updated|changed|ruled|shipped|landed|as of)\b.*\b20\d\d-\d\d(?:-\d\d)?\b.*$",
    "count_claim": r"(?im)^.*\b\d{1,6}\s+(?:files?|docs?|documents?|memories|entries|commits?|chunks?|tests?|cases?|rows?|models?|dirs?|directories|roots?|probes?|barges?)\b.*$",
    "port_or_flag": r"(?m)^.*\b(?:port\s+\d{4,5}|:\d{4,5}\b|MEMORY_[A-Z_]+|EB_[A-Z_]+|QSB_[A-Z_]+).*$",
}
CURRENCY_HITS = 8


def currency_markers(docs: DataFrame) -> DataFrame:
    """corpus, name, the hits of each family in the body (8 at most each), their sum, and up to ten distinct versions; documents without a
    hit are left out."""
    body = F.coalesce("body", F.lit(""))
    rows = docs.select("corpus", "name", *(F.least(F.regexp_count(body, F.lit(p)), F.lit(CURRENCY_HITS)).alias(n) for n, p in CURRENCY.items()), F.slice(F.array_distinct(F.regexp_extract_all(body, F.lit(r"\bv\d{2,3}\b"), F.lit(0))), 1, 10).alias("versions"))
    return rows.withColumn("markers", reduce(Column.__add__, map(F.col, CURRENCY))).where("markers > 0")


#: Bytes of all texts of one import that need no category, and endings of books.
UNCATEGORISED_BYTES, BOOK_ENDINGS = 200 * 1024, ("pdf", "epub", "mobi")


def import_decision(items: DataFrame) -> DataFrame:
    """items (import_id, name, text, category, and source: a file's ending) with decision and reason: accepted, skipped (short) or refused
    (large or book: the whole import, if it has no category; credential: the one text)."""
    from corpusloom.functions.text import secret_hits

    text = F.coalesce("text", F.lit(""))
    whole = Window.partitionBy("import_id")
    total = F.sum(F.when(F.col("category").isNull(), F.octet_length(text))).over(whole)
    books = F.max(F.col("category").isNull() & F.coalesce(F.lower("source").isin(*BOOK_ENDINGS), F.lit(False))).over(whole)
    loose = F.col("category").isNull()
    reason = F.when(loose & books, "book").when(loose & (total > UNCATEGORISED_BYTES), "large").when(F.length(F.trim(text)) < 40, "short").when(F.size(secret_hits("text")) > 0, "credential")
    rows = items.withColumn("reason", reason)
    return rows.withColumn("decision", F.when(F.col("reason").isNull(), "accepted").when(F.col("reason") == "short", "skipped").otherwise("refused"))
