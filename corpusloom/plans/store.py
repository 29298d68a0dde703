"""Registered queries on the structure and upkeep of a store, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import constants as K
from corpusloom.functions import scoring as S
from corpusloom.functions import text as T
from corpusloom.operators import claims, ranking, recall, structure, upkeep
from corpusloom.plans.registry import query
from corpusloom.plans.views import EPOCH, SQL_DOCS, SQL_NOTED, SQL_WORDS, documents, noted, spread, sql_text, table


def ts(x: str):
    return F.lit(x).cast("timestamp")


SQL_CH = rf"""WITH {SQL_DOCS}, w AS (SELECT doc_id, {SQL_WORDS.format('body')} AS w FROM docs),
ch AS (SELECT doc_id, i AS chunk_ix, array_to_string(w[i * 160 + 1:i * 160 + 200], ' ') AS text FROM (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 200 THEN 1 ELSE 1 + ceil((len(w) - 200) / 160.0)::BIGINT END)) AS i FROM w))"""


@query("chunks", SQL_CH + " SELECT doc_id, chunk_ix::INTEGER AS chunk_ix, sha256(text) AS digest FROM ch")
def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of 200 words that overlap by 40."""
    return documents(spark, sf).select("doc_id", F.posexplode(T.chunks("body")).alias("chunk_ix", "text")).select("doc_id", "chunk_ix", F.sha2("text", 256).alias("digest"))


@query("unchunked", rf"WITH {SQL_DOCS} SELECT doc_id, sha256(array_to_string({SQL_WORDS.format('body')}, ' ')) AS digest FROM docs")
def unchunked(spark: SparkSession, sf: str) -> DataFrame:
    """P5: chunks put together again give the words of the body."""
    return documents(spark, sf).select("doc_id", F.sha2(T.unchunk(T.chunks("body")), 256).alias("digest"))


@query("reference_chunks", SQL_CH + ", n AS (SELECT docs.doc_id, account AS corpus, count(chunk_ix) AS n FROM docs LEFT JOIN ch USING (doc_id) GROUP BY ALL) SELECT corpus, greatest(1, list_sort(list(n))[floor(0.9 * (count(*) - 1))::BIGINT + 1])::INTEGER AS reference FROM n GROUP BY corpus")
def reference_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The number of chunks at the ninth decile of each corpus, by index."""
    return ranking.reference_chunks(documents(spark, sf).select(F.col("account").alias("corpus"), F.size(T.chunks("body")).alias("n_chunks"))).select("corpus", F.col("reference").cast("int").alias("reference"))


@query("chunk_shares", SQL_CH + ", n AS (SELECT project AS file, count(chunk_ix) AS n_chunks FROM docs LEFT JOIN ch USING (doc_id) GROUP BY ALL) SELECT file, n_chunks, round(n_chunks / sum(n_chunks) OVER (), 4) AS share, n_chunks >= 200 AND n_chunks / sum(n_chunks) OVER () >= 0.25 AS large FROM n")
def chunk_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of each file, and whether one file is too large a share."""
    rows = documents(spark, sf).select("corpus", "name", F.col("project").alias("file"), F.size(T.chunks("body")).alias("n_chunks"))
    return structure.chunks_per_file(rows).select("file", "n_chunks", F.round("share", 4).alias("share"), "large")


MD = "concat('# Title ', doc_id, '\n\nIntro of ', name, '\n\n## Part v', doc_id % 5, ' one\n', repeat('alpha beta. ', 20), '\n```\n## not a heading\n```\n### Deep ', doc_id % 3, '\n', repeat('gamma ', 10), '\n## Part v', doc_id % 5, ' one\n', repeat('delta ', 40 * (doc_id % 2)::int), '\n## STALE notes\n', repeat('epsilon ', 30), '\nsee [[doc-', doc_id + 7, ']] and [[ missing-', doc_id % 3, '|label]] and [[doc-', doc_id, ']]')"


def _md(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a few headings, fences and links before their whole texts."""
    made = F.expr(MD.replace("(doc_id % 2)::int", "cast(doc_id % 2 as int)").replace("\n", "\\n"))
    return documents(spark, sf).withColumn("body", F.concat(made, F.lit("\n"), F.coalesce("body", F.lit("")))).withColumn("type", F.lit("memory"))


SQL_MD = f"WITH {SQL_DOCS}, md AS (SELECT corpus, doc_id, name, tier, " + MD.replace("'\n\nIntro of '", "chr(10) || chr(10) || 'Intro of '").replace("\n", "' || chr(10) || '") + " || chr(10) || coalesce(body, '') AS body FROM docs)"


@query("headings", SQL_MD + r" SELECT doc_id, array_to_string(list_transform(regexp_extract_all(body, '(?m)^#{1,6}[ \t]+(.*)$', 1), lambda x: trim(x)), '|') AS headings FROM md")
def headings(spark: SparkSession, sf: str) -> DataFrame:
    """P1."""
    return _md(spark, sf).select("doc_id", F.array_join(T.headings("body"), "|").alias("headings"))


@query("wikilinks", SQL_MD + r" SELECT doc_id, array_to_string(list_transform(regexp_extract_all(body, '\[\[([^\]|]+)(?:\|[^\]]*)?\]\]', 1), lambda x: trim(x)), '|') AS links FROM md")
def wikilinks(spark: SparkSession, sf: str) -> DataFrame:
    """P2."""
    return _md(spark, sf).select("doc_id", F.array_join(T.wikilinks("body"), "|").alias("links"))


SQL_LINKS = SQL_MD + r", l AS (SELECT DISTINCT name AS src, unnest(list_transform(regexp_extract_all(body, '\[\[([^\]|]+)(?:\|[^\]]*)?\]\]', 1), lambda x: trim(x))) AS slug FROM md), e AS (SELECT src, slug, m.name AS dst FROM l LEFT JOIN md m ON m.name = slug WHERE m.name IS NULL OR m.name <> src)"


@query("link_edges", SQL_LINKS + " SELECT src, slug, dst FROM e")
def link_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Links resolved to documents, or not."""
    return structure.link_edges(_md(spark, sf)).select("src", "slug", "dst")


@query("neighbours", SQL_LINKS + ", o AS (SELECT src, array_to_string(list_sort(list(dst) FILTER (WHERE dst IS NOT NULL)), '|') AS outbound, array_to_string(list_sort(list(slug) FILTER (WHERE dst IS NULL)), '|') AS unresolved FROM e GROUP BY src), i AS (SELECT dst, array_to_string(list_sort(list(src)), '|') AS inbound FROM e WHERE dst IS NOT NULL GROUP BY dst) SELECT name, coalesce(outbound, '') AS outbound, coalesce(inbound, '') AS inbound, coalesce(unresolved, '') AS unresolved FROM md LEFT JOIN o ON o.src = name LEFT JOIN i ON i.dst = name")
def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """V9: links of each document, in and out and unresolved."""
    return structure.neighbours(_md(spark, sf)).select("name", *(F.array_join(c, "|").alias(c) for c in ("outbound", "inbound", "unresolved")))


SQL_LINES = SQL_MD + r""", li AS (SELECT doc_id, i AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(body, chr(10)) AS l FROM md))),
f AS (SELECT *, sum((line LIKE '```%')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) % 2 = 1 OR line LIKE '```%' AS fenced, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start FROM li)"""
SQL_SECTIONS = SQL_LINES + r""", s AS (SELECT *, sum((NOT fenced AND regexp_matches(line, '^##\s+\S'))::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS section_no FROM f),
g AS (SELECT doc_id, section_no, string_agg(line, chr(10) ORDER BY line_no) AS text, min(char_start) AS char_start, max(char_start + length(line) + 1) AS char_end FROM s WHERE section_no > 0 GROUP BY ALL HAVING length(string_agg(line, chr(10) ORDER BY line_no)) >= 200),
h AS (SELECT *, trim(regexp_extract(text, '^##\s+([^\n]*)', 1)) AS heading FROM g), u AS (SELECT *, left(trim(regexp_replace(lower(heading), '[^a-z0-9]+', '-', 'g'), '-'), 60) AS slug FROM h),
sec AS (SELECT doc_id, section_no, heading, CASE WHEN row_number() OVER w > 1 THEN slug || '-' || row_number() OVER w ELSE slug END AS slug, text, char_start, char_end FROM u WINDOW w AS (PARTITION BY doc_id, slug ORDER BY section_no))"""


@query("sections", SQL_SECTIONS + " SELECT 'doc-' || doc_id AS name, section_no::BIGINT AS section_no, heading, slug, sha256(text) AS digest, char_start::BIGINT AS char_start, char_end::BIGINT AS char_end FROM sec")
def sections(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks under ## outside fences."""
    return structure.sections(_md(spark, sf)).select("name", "section_no", "heading", "slug", F.sha2("text", 256).alias("digest"), "char_start", "char_end")


@query("section_tiers", SQL_SECTIONS + r", v AS (SELECT doc_id, section_no, heading, try_cast(nullif(regexp_extract(heading, '(?i)\bv(\d{1,4})\b', 1), '') AS INTEGER) AS version FROM sec) SELECT 'doc-' || doc_id AS name, section_no::BIGINT AS section_no, version, CASE WHEN regexp_matches(heading, '\bSTALE\b') OR (version IS NOT NULL AND dense_rank() OVER (PARTITION BY doc_id ORDER BY version DESC NULLS LAST) > 3) THEN 'archive' ELSE 'hot' END AS tier FROM v")
def section_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Versions of sections and which of them are archived."""
    return structure.section_tiers(structure.sections(_md(spark, sf))).select("name", "section_no", "version", "tier")


@query("outline", SQL_LINES + r""", h AS (SELECT doc_id, line_no, char_start, length(regexp_extract(line, '^(#+)', 1)) AS level, trim(regexp_extract(line, '^#+\s+(.*)$', 1)) AS heading FROM f WHERE NOT fenced AND regexp_matches(line, '^#{1,6}\s+\S'))
SELECT 'doc-' || h.doc_id AS name, row_number() OVER (PARTITION BY h.doc_id ORDER BY line_no)::INTEGER AS heading_no, level::INTEGER AS level, heading, char_start::BIGINT AS char_start, coalesce((SELECT min(n.char_start) FROM h n WHERE n.doc_id = h.doc_id AND n.line_no > h.line_no AND n.level <= h.level), length(body))::BIGINT AS char_end FROM h JOIN md USING (doc_id)""")
def outline(spark: SparkSession, sf: str) -> DataFrame:
    """P10: headings with the places where their sections end."""
    return structure.outline(_md(spark, sf)).select("name", "heading_no", "level", "heading", "char_start", F.col("char_end").cast("long").alias("char_end"))


@query("version_tiers", "WITH p AS (SELECT p_brand || '-' || p_size || '-v' || p_partkey % 10000 AS name, p_brand, p_size, p_partkey % 10000 AS v FROM part) SELECT name, CASE WHEN count(*) OVER (PARTITION BY p_brand, p_size) >= 3 AND row_number() OVER (PARTITION BY p_brand, p_size ORDER BY v DESC, name) > 3 THEN 'archive' ELSE 'hot' END AS tier FROM p")
def version_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """The newest three versions of a name stay hot."""
    p = table(spark, sf, "part").selectExpr("'c' AS corpus", "concat(p_brand, '-', p_size, '-v', p_partkey % 10000) AS name", "'hot' AS tier")
    return structure.version_tiers(p).select("name", "tier")


@query("slugs", r"SELECT p_partkey, left(trim(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '-'), 20) AS slug FROM part")
def slugs(spark: SparkSession, sf: str) -> DataFrame:
    """C24, P7."""
    return table(spark, sf, "part").select("p_partkey", T.slug(F.concat_ws(" / ", "p_name", "p_type"), 20).alias("slug"))


@query("staleness", f"WITH {SQL_DOCS}, i AS (SELECT name AS file_id, CASE WHEN doc_id % 11 = 0 THEN 'old' ELSE sha256(body) END AS h FROM docs WHERE doc_id % 7 <> 0), f AS (SELECT name AS file_id, sha256(body) AS h FROM docs WHERE doc_id % 13 <> 0) SELECT coalesce(i.file_id, f.file_id) AS file_id, CASE WHEN i.h IS NULL THEN 'added' WHEN f.h IS NULL THEN 'removed' WHEN i.h <> f.h THEN 'changed' ELSE 'same' END AS state FROM i FULL JOIN f ON i.file_id = f.file_id")
def staleness(spark: SparkSession, sf: str) -> DataFrame:
    """An index against the files it was made from."""
    return upkeep.staleness(*_index_and_files(spark, sf))


def _index_and_files(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = documents(spark, sf).select("doc_id", F.col("name").alias("file_id"), F.sha2("body", 256).alias("hash"))
    return d.where("doc_id % 7 <> 0").withColumn("hash", F.when(F.col("doc_id") % 11 == 0, "old").otherwise(F.col("hash"))), d.where("doc_id % 13 <> 0")


@query("stale_report", f"WITH {SQL_DOCS}, i AS (SELECT name AS file_id, CASE WHEN doc_id % 11 = 0 THEN 'old' ELSE sha256(body) END AS h FROM docs WHERE doc_id % 7 <> 0), f AS (SELECT name AS file_id, sha256(body) AS h FROM docs WHERE doc_id % 13 <> 0), s AS (SELECT coalesce(i.file_id, f.file_id) AS file_id, CASE WHEN i.h IS NULL THEN 'added' WHEN f.h IS NULL THEN 'removed' WHEN i.h <> f.h THEN 'changed' ELSE 'same' END AS state FROM i FULL JOIN f ON i.file_id = f.file_id) SELECT state, count(*) AS n, array_to_string(list_sort(list(file_id))[1:8], '|') AS some FROM s WHERE state <> 'same' GROUP BY state")
def stale_report(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of stale files with eight names."""
    return upkeep.stale_report(upkeep.staleness(*_index_and_files(spark, sf))).withColumn("some", F.array_join("some", "|"))


@query("vanished", f"WITH {SQL_DOCS} SELECT name FROM docs WHERE doc_id % 7 = 0")
def vanished(spark: SparkSession, sf: str) -> DataFrame:
    """Names no longer there."""
    d = documents(spark, sf)
    return upkeep.vanished(d, d.where("doc_id % 7 <> 0"))


@query("reused_rows", f"WITH {SQL_DOCS} SELECT name, doc_id % 11 <> 0 AND doc_id % 5 <> 0 AND doc_id % 3 <> 0 AS reused FROM docs")
def reused_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of an index that an incremental build can keep."""
    d = documents(spark, sf).select("doc_id", "name", F.sha2("body", 256).alias("hash"), F.col("doc_id").alias("mtime"))
    old = d.select("name", F.when(F.col("doc_id") % 11 == 0, "x").otherwise(F.col("hash")).alias("hash"), (F.col("mtime") - (F.col("doc_id") % 5 == 0).cast("int")).alias("mtime"), (F.col("doc_id") % 3 != 0).cast("int").alias("n_chunks"))
    return upkeep.reuse(d, old).select("name", "reused")


@query("cached_vectors", SQL_CH + ", c AS (SELECT DISTINCT sha256(text) AS key FROM ch WHERE doc_id % 2 = 0) SELECT count(*) AS n, count(c.key) AS hits, count(DISTINCT sha256(text)) FILTER (WHERE c.key IS NULL) AS to_do FROM ch LEFT JOIN c ON c.key = sha256(text)")
def cached_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks whose vectors a cache holds by the hash of their text."""
    ch = documents(spark, sf).select("doc_id", F.explode(T.chunks("body")).alias("text"))
    cache = ch.where("doc_id % 2 = 0").select(F.sha2("text", 256).alias("key")).distinct().withColumn("vec", F.array(F.lit(1.0)))
    rows = upkeep.cached_vectors(ch, cache)
    return rows.agg(F.count("*").alias("n"), F.count("vec").alias("hits"), F.count_distinct(F.when(F.col("vec").isNull(), F.col("key"))).alias("to_do"))


@query("corpus_hash", f"WITH {SQL_DOCS} SELECT account AS corpus, sha256(string_agg(name || ':' || sha256(body), '|' ORDER BY name || ':' || sha256(body))) AS hash FROM docs GROUP BY account")
def corpus_hash(spark: SparkSession, sf: str) -> DataFrame:
    """One hash for a corpus of files."""
    return structure.corpus_hash(documents(spark, sf).select(F.col("account").alias("corpus"), "file", F.sha2("body", 256).alias("hash")))


@query("duplicate_bodies", f"WITH {SQL_DOCS} SELECT name, file, kind FROM (SELECT name, name AS file, 'duplicate-body' AS kind, row_number() OVER (PARTITION BY project, body ORDER BY name) AS n FROM docs) WHERE n > 1")
def duplicate_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """A26."""
    return upkeep.duplicates(documents(spark, sf).withColumn("session_id", F.col("project")))


SQL_X = "x AS (SELECT conv_id::VARCHAR AS session_id, 'x-' || conv_id || '-' || lpad(turn::VARCHAR, 4, '0') AS name, turn, role, text FROM conversations)"


def _exchanges(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("session_id"), F.concat(F.lit("x-"), F.col("conv_id").cast("string"), F.lit("-"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("name"), "turn", "role", F.col("text").alias("body"), F.lit(None).cast("timestamp").alias("ts"))


@query("thread_positions", f"WITH {SQL_X} SELECT name, row_number() OVER w::INTEGER AS position, count(*) OVER (PARTITION BY session_id) AS total, max(name) OVER (PARTITION BY session_id) AS last_name, lag(name) OVER w AS previous FROM x WINDOW w AS (PARTITION BY session_id ORDER BY name)")
def thread_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Where each turn stands in its conversation."""
    return recall.thread_positions(_exchanges(spark, sf)).select("name", "position", "total", "last_name", "previous")


@query("thread_window", f'WITH {SQL_X}, p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY name) AS pos, count(*) OVER (PARTITION BY session_id) AS total FROM x) SELECT a.name AS anchor, p.name, (p.pos - a.pos)::INTEGER AS "offset", greatest(0, p.total - a.pos - 3) AS remaining FROM p a JOIN p USING (session_id) WHERE a.turn = 2 AND p.pos - a.pos BETWEEN -1 AND 3')
def thread_window(spark: SparkSession, sf: str) -> DataFrame:
    """Turns around an anchor."""
    p = recall.thread_positions(_exchanges(spark, sf))
    return recall.thread(p, p.where("turn = 2"), 3, 1).select("anchor", "name", "offset", "remaining")


@query("reply_pairs", f"WITH {SQL_X}, e AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY session_id ORDER BY turn) AS exchange FROM x), g AS (SELECT session_id, exchange, min(name) FILTER (WHERE role = 'user') AS ask, string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'assistant') AS reply FROM e WHERE exchange > 0 GROUP BY ALL) SELECT ask, sha256(reply) AS reply FROM g WHERE length(reply) >= {K.REPLY_CHARS}")
def reply_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each user turn with the replies until the next one, if they are long enough."""
    from corpusloom.sources.transcripts import pair_turns

    rows = _exchanges(spark, sf).select("session_id", F.col("turn").alias("line_no"), F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("kind"), F.col("body").alias("text"), "name")
    return pair_turns(rows).where(F.length("reply") >= K.REPLY_CHARS).select(F.col("ask_name").alias("ask"), F.sha2("reply", 256).alias("reply"))


SQL_LOG = "lg AS (SELECT event_id AS row_id, user_id AS caller, ts, event_type = 'error' AS failed, event_type AS mode, [event_type, 'u' || user_id % 5] AS terms FROM events)"


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr("event_id AS row_id", "user_id AS caller", "ts", "event_type = 'error' AS failed", "event_type AS mode", "array(event_type, concat('u', user_id % 5)) AS terms", "cast(user_id as string) as q")


@query("retries", f"WITH {SQL_LOG}, p AS (SELECT a.row_id, bool_or(NOT b.failed) AS recovered FROM lg a JOIN lg b ON a.caller = b.caller AND (b.ts > a.ts OR (b.ts = a.ts AND b.row_id > a.row_id)) AND b.ts <= a.ts + INTERVAL {K.RETRY_SECONDS} SECOND AND list_has_any(a.terms, b.terms) WHERE a.failed GROUP BY a.row_id) SELECT row_id, p.recovered IS NOT NULL AS retried, coalesce(p.recovered, false) AS recovered FROM lg LEFT JOIN p USING (row_id) WHERE failed")
def retries(spark: SparkSession, sf: str) -> DataFrame:
    """Failed rows and whether they are asked again in time."""
    return upkeep.retries(_log(spark, sf))


@query("failure_shapes", f"WITH {SQL_LOG} SELECT array_to_string(list_sort(terms), ' ') AS shape, count(*) AS n FROM lg WHERE failed GROUP BY shape ORDER BY n DESC, shape LIMIT 10")
def failure_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """A18."""
    return upkeep.failure_shapes(_log(spark, sf))


@query("dead_terms", f"WITH {SQL_LOG}, t AS (SELECT unnest(terms) AS term, failed FROM lg) SELECT term, count(*) FILTER (WHERE failed) AS failures FROM t GROUP BY term HAVING count(*) FILTER (WHERE failed) >= 3 AND count(*) FILTER (WHERE NOT failed) = 0 ORDER BY failures DESC, term LIMIT 12")
def dead_terms(spark: SparkSession, sf: str) -> DataFrame:
    """A19."""
    return upkeep.dead_terms(_log(spark, sf))


@query("mode_split", f"WITH {SQL_LOG} SELECT mode, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS percent FROM lg GROUP BY mode")
def mode_split(spark: SparkSession, sf: str) -> DataFrame:
    """A20."""
    return upkeep.mode_split(_log(spark, sf))


@query("questions", f"WITH {SQL_LOG} SELECT CASE WHEN caller % 2 = 0 THEN 'q' || caller ELSE 'legacy:' || caller END AS question, bool_and(failed) AS failed, count(*) AS n_rows FROM lg GROUP BY question")
def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a question; it failed if all of them did."""
    log = _log(spark, sf).withColumn("query_id", F.when(F.col("caller") % 2 == 0, F.concat(F.lit("q"), "q")))
    return upkeep.questions(log).select("question", "failed", "n_rows")


@query("without_benchmark", "SELECT count(*) AS n FROM documents WHERE lower(text) NOT IN (SELECT lower(text) FROM benchmark)")
def without_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that aren't benchmark questions."""
    return upkeep.without_benchmark(table(spark, sf, "documents").select(F.col("text").alias("q")), table(spark, sf, "benchmark").select(F.col("text").alias("q"))).agg(F.count("*").alias("n"))


@query("commits_asof", f"WITH a AS (SELECT user_id % 20 AS s, ts, event_id AS name FROM events WHERE event_type <> 'purchase'), c AS (SELECT user_id % 20 AS s, ts AS c_at, event_id AS sha FROM events WHERE event_type = 'purchase'), e AS (SELECT s, max(ts) AS last_ts FROM a GROUP BY s), j AS (SELECT c.s, c.sha, c.c_at, (SELECT arg_max(a.name, (a.ts, lpad(a.name::VARCHAR, 9, '0'))) FROM a WHERE a.s = c.s AND a.ts <= c.c_at) AS name FROM c), k AS (SELECT j.*, row_number() OVER (PARTITION BY j.s, name ORDER BY c_at, lpad(sha::VARCHAR, 9, '0')) AS n FROM j JOIN e USING (s) WHERE name IS NOT NULL AND c_at <= last_ts + INTERVAL {K.COMMIT_TAIL_MINUTES} MINUTE) SELECT sha, name FROM k WHERE n <= {K.COMMITS_KEPT}")
def commits_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Each commit goes to the last question before it."""
    e = table(spark, sf, "events").withColumn("session_id", (F.col("user_id") % 20).cast("string")).withColumn("id", F.lpad(F.col("event_id").cast("string"), 9, "0"))
    asks = e.where("event_type <> 'purchase'").select("session_id", F.col("id").alias("name"), "ts")
    commits = e.where("event_type = 'purchase'").select("session_id", F.col("id").alias("sha"), F.col("ts").alias("at"))
    return upkeep.commits_asof(commits, asks).select(F.col("sha").cast("long").alias("sha"), F.col("name").cast("long").alias("name"))


@query("commits_between", "SELECT o_orderpriority AS repo, count(*) AS n, max(o_orderdate) AS newest FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-06-30' GROUP BY repo")
def commits_between(spark: SparkSession, sf: str) -> DataFrame:
    """J16."""
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("repo"), F.col("o_orderdate").alias("at"))
    return upkeep.commits_between(o, ts("1995-01-01 00:00:00"), ts("1996-06-30 00:00:00"))


@query("commits_since", "SELECT o_orderpriority AS repo, count(*) AS n FROM orders WHERE o_orderdate > (SELECT max(l_shipdate) - INTERVAL 400 DAY FROM lineitem) GROUP BY repo")
def commits_since(spark: SparkSession, sf: str) -> DataFrame:
    """J17."""
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("repo"), F.col("o_orderdate").alias("at"))
    d = table(spark, sf, "lineitem").select(F.expr("l_shipdate - interval 400 days").alias("modified"), F.lit(None).cast("timestamp").alias("ts"))
    return upkeep.commits_since(o, d)


@query("html_text", None)
def html_text(spark: SparkSession, sf: str) -> DataFrame:
    """P21; tested against a plain function on pages of all kinds."""
    return spread(table(spark, sf, "pages")).select("page_id", F.sha2(T.html_to_markdownish("html"), 256).alias("digest"))


_ADDRESS = T.ADDRESS.replace("'", "''")


@query("scrubbed_emails", rf"""WITH {SQL_NOTED}, a AS (SELECT doc_id, string_split_regex(text, '{_ADDRESS}') AS b, regexp_extract_all(text, '{_ADDRESS}') AS f FROM noted)
SELECT doc_id, sha256(array_to_string(list_transform(range(1, len(b) + 1), lambda i: b[i] || CASE WHEN i > len(f) THEN '' WHEN string_split(lower(f[i]), '@')[2] IN ('gmail.com', 'yahoo.com', 'hotmail.com', 'outlook.com', 'aol.com', 'icloud.com', 'me.com', 'msn.com', 'live.com', 'comcast.net', 'protonmail.com', 'proton.me', 'gmx.com') THEN '[email]' WHEN ends_with(lower(f[i]), '@acme.org') OR ends_with(lower(f[i]), '.acme.org') THEN f[i] ELSE '[email@' || string_split(lower(f[i]), '@')[2] || ']' END), '')) AS digest FROM a""")
def scrubbed_emails(spark: SparkSession, sf: str) -> DataFrame:
    """Every text."""
    return noted(spark, sf).select("doc_id", F.sha2(T.scrub_emails("text", ("acme.org",)), 256).alias("digest"))


_SECRETS = ", ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), {sql_text(p)}) THEN '{n}' END" for n, p in T.SECRET_PATTERNS)


@query("secrets", rf"SELECT doc_id, array_to_string(list_filter([{_SECRETS}], lambda x: x IS NOT NULL), '|') AS classes FROM documents")
def secrets(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of secrets in each text, all four."""
    d = table(spark, sf, "documents").select("doc_id", T.secret_hits("text").alias("c"))
    return d.select("doc_id", F.array_join("c", "|").alias("classes"))


SQL_PROSE = SQL_NOTED + r""", s AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[.!?]+\s'), lambda x: length(trim(x)) > 20) AS s FROM noted),
prose AS (SELECT doc_id, text, CASE WHEN length(text) < 100 THEN NULL WHEN len(s) = 0 THEN 0 ELSE greatest(0, least(1, list_avg(list_transform(s, lambda x: len(string_split_regex(x, '\s+')))) / 25 * (1 - least(1, 40 * length(regexp_replace(text, '[^{}()\[\]<>|=;$#]', '', 'g')) / length(text)::DOUBLE)))) END AS proseness FROM s)"""


@query("proseness", "WITH " + SQL_PROSE + " SELECT doc_id, round(proseness, 4) AS proseness FROM prose")
def proseness(spark: SparkSession, sf: str) -> DataFrame:
    """C16."""
    return noted(spark, sf).select("doc_id", F.round(T.proseness("text"), 4).alias("proseness"))


@query("corpus_profile", "WITH " + SQL_PROSE + r""", m AS (SELECT doc_id % 5 AS corpus, contains(text, '```')::INT AS f, regexp_matches(text, '\b[\w.-]+/[\w./-]+\.(js|ts|py|json|md|sh|yml|yaml|html|css|go|rs|java)\b')::INT AS p, regexp_matches(text, '\b[A-Z][A-Z0-9]+(?:_[A-Z0-9]+)+\b')::INT AS c, regexp_matches(text, '\b[0-9a-f]{7,10}\b')::INT AS s, regexp_matches(text, '(?:^|\s)--[a-z][a-z0-9-]{2,}\b')::INT AS g, regexp_matches(text, '\b[a-zA-Z_$][\w$]*\([^)]{0,40}\)')::INT AS l, proseness FROM prose),
a AS (SELECT corpus, round(round(avg(f), 3) * 0.3 + round(avg(p), 3) * 0.25 + round(avg(c), 3) * 0.15 + round(avg(s), 3) * 0.15 + round(avg(g), 3) * 0.1 + round(avg(l), 3) * 0.05, 3) AS code_score, round(coalesce(avg(proseness), 0), 3) AS proseness FROM m GROUP BY corpus)
SELECT corpus::VARCHAR AS corpus, code_score, proseness, CASE WHEN code_score >= 0.08 THEN 'code' WHEN code_score <= 0.03 THEN 'prose' ELSE 'mixed' END AS domain FROM a""")
def corpus_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Marks of code and of prose by corpus."""
    d = noted(spark, sf).select((F.col("doc_id") % 5).cast("string").alias("corpus"), F.col("text").alias("body"))
    return upkeep.corpus_profile(d).select("corpus", "code_score", "proseness", "domain")


@query("shas_and_identifiers", rf"""WITH {SQL_NOTED}, t AS (SELECT doc_id, text, CASE WHEN len(string_split(text, '---')) > 2 THEN array_to_string(string_split(text, '---')[3:], '---') ELSE text END AS scan FROM noted)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(scan, '\b[0-9a-f]{{7,10}}\b'), lambda x: regexp_matches(x, '[a-f]')))), '|') AS shas,
  array_to_string(list_sort(list_distinct(list_concat(list_concat(regexp_extract_all(text, '\b[A-Z][A-Z0-9]+(?:_[A-Z0-9]+)+\b'), regexp_extract_all(text, '--[a-z][a-z0-9-]{{2,}}\b')), regexp_extract_all(text, '\b[\w.-]+/[\w./-]+\.[a-z]{{2,4}}\b')))), '|') AS identifiers FROM t""")
def shas_and_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    """In whole texts, sorted."""
    return noted(spark, sf).select("doc_id", F.array_join(F.array_sort(T.extract_shas("text")), "|").alias("shas"), F.array_join(F.array_sort(T.extract_identifiers("text")), "|").alias("identifiers"))


_EXPECTED = ("~AB", ">=25", "<=10", ">40", "< 5", "7", "~ brand", "BRAND#1", "> -1", ">=x", "")


@query("matches_expected", f"""WITH e AS (SELECT unnest([{', '.join(map(sql_text, _EXPECTED))}]) AS expected), v AS (SELECT p_partkey, unnest([p_size::VARCHAR, upper(p_brand), ' ab ']) AS actual FROM part),
n AS (SELECT *, try_cast(actual AS DOUBLE) AS x FROM v, e)
SELECT p_partkey, actual, expected, coalesce(CASE expected WHEN '~AB' THEN contains(lower(actual), 'ab') WHEN '>=25' THEN x >= 25 WHEN '<=10' THEN x <= 10 WHEN '>40' THEN x > 40 WHEN '< 5' THEN x < 5 WHEN '> -1' THEN x > -1 WHEN '~ brand' THEN contains(lower(actual), 'brand') ELSE trim(actual) = expected END, FALSE) AS ok FROM n""")
def matches_expected(spark: SparkSession, sf: str) -> DataFrame:
    """C19."""
    v = F.explode(F.array(F.col("p_size").cast("string"), F.upper("p_brand"), F.lit(" ab ")))
    # What is expected is a literal for each row of the list, so that it is taken apart once, not for each row of the table.
    each = F.array(*(F.struct(F.lit(e).alias("expected"), S.matches_expected(F.col("actual"), F.lit(e)).alias("ok")) for e in _EXPECTED))
    return spread(table(spark, sf, "part")).select("p_partkey", v.alias("actual")).select("p_partkey", "actual", F.inline(each))


@query("count_hits", "SELECT doc_id, ((length(text) - length(replace(text, 'th', ''))) / 2)::BIGINT AS hits FROM documents")
def count_hits(spark: SparkSession, sf: str) -> DataFrame:
    """A15."""
    return table(spark, sf, "documents").select("doc_id", T.count_hits(F.col("text"), F.lit("th")).alias("hits"))


@query("snippets", r"WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, sha256(CASE WHEN length(t) <= 320 THEN t ELSE regexp_replace(left(t, 320), '\s\S*$', '') || '…' END) AS digest FROM t")
def snippets(spark: SparkSession, sf: str) -> DataFrame:
    """P14, P15."""
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.trim_snippet("text"), 256).alias("digest"))


@query("summary_texts", f"WITH {SQL_DOCS} SELECT doc_id, replace(name, '-', ' ') || '. ' || description AS summary FROM docs")
def summary_texts(spark: SparkSession, sf: str) -> DataFrame:
    """P24."""
    return documents(spark, sf).select("doc_id", T.summary_text("name", "description").alias("summary"))


SQL_TEL = "pos AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem), tel AS (SELECT l_partkey AS name, count(*) AS hits, max(r)::INTEGER AS worst_rank, count(*) FILTER (WHERE o_orderstatus = 'F') AS weak_hits FROM pos JOIN orders ON o_orderkey = l_orderkey GROUP BY l_partkey)"


def _top_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as log rows whose top lists are their parts by line number."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    top = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.struct(x["l_partkey"].alias("name"), x["l_linenumber"].alias("n"))).alias("top"))
    return top.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("o_orderstatus") == "F").alias("no_strong_match"), "top")


@query("telemetry", f"WITH {SQL_TEL} SELECT name, hits, worst_rank, weak_hits FROM tel")
def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    """How often each document is in a page, and how far down."""
    return upkeep.telemetry(_top_lists(spark, sf)).withColumn("worst_rank", F.col("worst_rank").cast("int"))


@query("work_queue", f"WITH {SQL_TEL} SELECT p_partkey AS name, coalesce(hits, 0) AS hits, coalesce(worst_rank, 0) AS worst_rank, coalesce(hits * worst_rank, 0) AS priority FROM part LEFT JOIN tel ON name = p_partkey WHERE p_partkey % 4 <> 1 ORDER BY priority DESC, p_partkey LIMIT 40")
def work_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Documents changed since they were curated, or never curated, most wanted first."""
    docs = table(spark, sf, "part").select(F.col("p_partkey").alias("name"), F.col("p_name").alias("hash"), F.when(F.col("p_partkey") % 4 == 1, F.col("p_name")).when(F.col("p_partkey") % 4 == 2, "old").alias("curated_hash"))
    return upkeep.work_queue(docs, upkeep.telemetry(_top_lists(spark, sf))).withColumn("worst_rank", F.col("worst_rank").cast("int")).withColumn("priority", F.col("priority").cast("long"))


@query("superseded", "WITH d AS (SELECT 'doc-' || vec_id AS name, vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.name AS x, b.name AS y, a.vec_id AS i, b.vec_id AS j, round(list_dot_product(a.e, b.e), 4) AS s, row_number() OVER (PARTITION BY a.name ORDER BY round(list_dot_product(a.e, b.e), 4) DESC, b.name) AS r FROM d a JOIN d b ON a.name <> b.name) SELECT x AS newer, y AS older, s AS similarity FROM p WHERE r <= 3 AND s >= 0.1 AND j > i")
def superseded(spark: SparkSession, sf: str) -> DataFrame:
    """Alike documents of which one is older (here, has the larger id)."""
    v = table(spark, sf, "embeddings").select(F.lit("c").alias("corpus"), F.concat(F.lit("doc-"), F.col("vec_id").cast("string")).alias("name"), F.col("embedding").alias("vec"), (-F.col("vec_id")).alias("modified"))
    return upkeep.superseded(ranking.nearest(v, v), v, 0.1)


SQL_VALS = "vals AS (SELECT o_orderpriority AS corpus, o_totalprice AS top_score, o_custkey::DOUBLE AS coverage FROM orders)"


@query("floors", f"WITH {SQL_VALS}, m AS (SELECT corpus, median(top_score) AS s, median(coverage) AS c FROM vals GROUP BY corpus), r AS (SELECT s AS s0, c AS c0 FROM m WHERE corpus = '1-URGENT') SELECT corpus, round(0.38 * s / s0, 4) AS score_floor, round(0.20 * c / c0, 4) AS coverage_floor FROM m, r")
def floors(spark: SparkSession, sf: str) -> DataFrame:
    """Floors of other corpora from medians."""
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("corpus"), F.col("o_totalprice").alias("top_score"), F.col("o_custkey").cast("double").alias("coverage"))
    return upkeep.floors(o, reference="1-URGENT")


@query("distribution", "WITH s AS (SELECT o_orderpriority AS grp, list_sort(list(o_totalprice)) AS l, count(*) AS n FROM orders GROUP BY grp) SELECT grp, n, l[1] AS min, l[floor(0.1 * (n - 1))::BIGINT + 1] AS p10, l[floor(0.5 * (n - 1))::BIGINT + 1] AS median, l[floor(0.9 * (n - 1))::BIGINT + 1] AS p90, l[n] AS max FROM s")
def distribution(spark: SparkSession, sf: str) -> DataFrame:
    """A23."""
    return upkeep.distribution(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("grp"), "o_totalprice"), "o_totalprice", "grp")


@query("separation", "SELECT o_orderpriority AS grp, t.threshold, round(avg((o_totalprice >= t.threshold)::INT), 4) AS share FROM orders, (VALUES (1000.0::DOUBLE), (100000.0), (200000.0)) t(threshold) GROUP BY ALL")
def separation(spark: SparkSession, sf: str) -> DataFrame:
    """A24."""
    return upkeep.separation(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("grp"), "o_totalprice"), "o_totalprice", "grp", [1000.0, 100000.0, 200000.0])


@query("even_sample", "WITH r AS (SELECT o_orderkey, o_orderpriority AS grp, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS p, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders), i AS (SELECT DISTINCT grp, floor(i * n / 40.0)::BIGINT AS p FROM r, range(40) t(i)) SELECT o_orderkey, grp FROM r JOIN i USING (grp, p)")
def even_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Evenly placed rows of each group, the same each time."""
    return upkeep.even_sample(table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("grp")), "o_orderkey", 40, "grp")


@query("corpus_clock", "SELECT o_orderpriority AS corpus, CASE WHEN count(*) FILTER (WHERE o_orderkey % 3 <> 0) * 2 > count(*) THEN 'ts' ELSE 'modified' END AS clock, max(o_orderdate) AS newest, count(*) AS n FROM orders GROUP BY corpus")
def corpus_clock(spark: SparkSession, sf: str) -> DataFrame:
    """A12, A13."""
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("corpus"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("ts"), F.col("o_orderdate").alias("modified"))
    return recall.corpus_clock(o)


@query("silent_share", "SELECT o_orderpriority AS kind, count(*) AS durable, count(*) FILTER (WHERE o_orderstatus = 'F') AS named, round(1 - count(*) FILTER (WHERE o_orderstatus = 'F') / count(*)::DOUBLE, 4) AS silent_share FROM orders GROUP BY ROLLUP (o_orderpriority)")
def silent_share(spark: SparkSession, sf: str) -> DataFrame:
    """A27."""
    return upkeep.silent_share(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("kind"), (F.col("o_orderstatus") == "F").alias("named")))


_ASKS = ("Summarise the ", "summarize ", "give me an overview of a ", "Summary of: ", "Open ", "the ", "")
_SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"


@query("read_tasks", rf"""WITH q AS (SELECT p_partkey, ([{', '.join(map(sql_text, _ASKS))}])[p_partkey % 7 + 1] || p_name AS query, p_partkey % 7 < 4 AS verb, CASE WHEN p_partkey % 7 = 4 THEN 'Open ' ELSE '' END || p_name AS rest FROM part),
t AS (SELECT DISTINCT {_SLUG.format('p_name')} AS slug FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 4 <> 0)
SELECT p_partkey AS query_id, verb OR t.slug IS NOT NULL AS read_task, t.slug IS NOT NULL AS titled FROM q LEFT JOIN t ON t.slug = {_SLUG.format('rest')} AND length(t.slug) >= 8""")
def read_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """F16: by verb, or as a document's name; sections don't count."""
    p = table(spark, sf, "part")
    ask = F.element_at(F.array(*map(F.lit, _ASKS)), (F.col("p_partkey") % 7 + 1).cast("int"))
    q = p.select(F.col("p_partkey").alias("query_id"), F.concat(ask, "p_name").alias("query"))
    titles = p.where("p_partkey % 3 = 0").select(F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 4 == 0, "x").alias("parent_name"))
    return upkeep.read_task(q, titles).select("query_id", "read_task", F.col("title").isNotNull().alias("titled"))


_LINES_WITH = "len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{0}')))"


@query("currency_markers", rf"""WITH {SQL_NOTED}, m AS (SELECT doc_id, least(8, len(regexp_extract_all(text, '\b(?:v\d{{2,3}}|Mac v\d+|Win v\d+)\b')))::INT AS version_token, least(8, {_LINES_WITH.format('🟥|✅|⚠️')})::INT AS status_flag,
  least(8, {_LINES_WITH.format(r'(?i)\b(?:corrected|fixed|superseded|updated|changed|ruled|shipped|landed|as of)\b.*\b20\d\d-\d\d(?:-\d\d)?\b')})::INT AS dated_correction,
  least(8, {_LINES_WITH.format(r'(?i)\b\d{1,6}\s+(?:files?|docs?|documents?|memories|entries|commits?|chunks?|tests?|cases?|rows?|models?|dirs?|directories|roots?|probes?|barges?)\b')})::INT AS count_claim,
  least(8, {_LINES_WITH.format(r'\b(?:port\s+\d{4,5}|:\d{4,5}\b|MEMORY_[A-Z_]+|EB_[A-Z_]+|QSB_[A-Z_]+)')})::INT AS port_or_flag FROM noted)
SELECT *, version_token + status_flag + dated_correction + count_claim + port_or_flag AS markers FROM m WHERE version_token + status_flag + dated_correction + count_claim + port_or_flag > 0""")
def currency_markers(spark: SparkSession, sf: str) -> DataFrame:
    """Five families of what may go out of date."""
    d = noted(spark, sf).select(F.lit("c").alias("corpus"), F.col("doc_id").alias("name"), F.col("text").alias("body"))
    return upkeep.currency_markers(d).drop("corpus", "versions").withColumnRenamed("name", "doc_id")


@query("import_decisions", rf"""WITH c AS (SELECT doc_id, text, source, doc_id // 40 AS i, CASE WHEN doc_id % 3 = 0 THEN 'books' END AS category, CASE WHEN doc_id % 97 = 1 THEN 'PDF' WHEN doc_id % 53 = 3 THEN 'epub' ELSE 'md' END AS ending FROM documents),
w AS (SELECT *, sum(CASE WHEN category IS NULL THEN strlen(coalesce(text, '')) END) OVER (PARTITION BY i) AS total, coalesce(bool_or(category IS NULL AND lower(ending) IN ('pdf', 'epub', 'mobi')) OVER (PARTITION BY i), FALSE) AS book,
  len(list_filter([{_SECRETS}], lambda x: x IS NOT NULL)) > 0 AS secret FROM c),
r AS (SELECT doc_id, CASE WHEN category IS NULL AND book THEN 'book' WHEN category IS NULL AND total > 204800 THEN 'large' WHEN length(trim(coalesce(text, ''))) < 40 THEN 'short' WHEN secret THEN 'credential' END AS reason FROM w)
SELECT doc_id, reason, CASE WHEN reason IS NULL THEN 'accepted' WHEN reason = 'short' THEN 'skipped' ELSE 'refused' END AS decision FROM r""")
def import_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """every document, in imports of 40."""
    d = table(spark, sf, "documents")
    ending = F.when(F.col("doc_id") % 97 == 1, "PDF").when(F.col("doc_id") % 53 == 3, "epub").otherwise("md")
    items = d.select("doc_id", "text", F.floor(F.col("doc_id") / 40).alias("import_id"), F.when(F.col("doc_id") % 3 == 0, "books").alias("category"), ending.alias("source"))
    return upkeep.import_decision(items).select("doc_id", "reason", "decision")


_QUESTIONS = ("what did we decide about {}", "how should {} be set", "yesterday, is {} policy", "where did we leave {}", "phase 2 of {}", "handoff of {}", "{}", "does go() of {} run")


@query("technical_queries", rf"""WITH {SQL_NOTED} SELECT doc_id, regexp_matches(text, '\b[0-9a-f]{{7,40}}\b') OR regexp_matches(text, '\b[\w.-]+/[\w./-]+\.[a-z]{{1,5}}\b') OR regexp_matches(text, '\b[A-Z][A-Z0-9]+(?:_[A-Z0-9]+)+\b') OR regexp_matches(text, '(?:^|\s)--[a-z][a-z0-9-]{{2,}}\b') OR regexp_matches(text, '\b[a-z][\w$]*\(\)') AS technical FROM noted""")
def technical_queries(spark: SparkSession, sf: str) -> DataFrame:
    """F14."""
    return noted(spark, sf).select("doc_id", recall.looks_technical(F.col("text")).alias("technical"))


@query("routes", f"""WITH q AS (SELECT p_partkey, replace(([{', '.join(map(sql_text, _QUESTIONS))}])[p_partkey % 8 + 1], '{{}}', p_name) AS q FROM part) SELECT p_partkey, CASE WHEN p_partkey % 8 IN (0, 3, 4, 5) THEN 'all' ELSE 'curated' END AS scope FROM q""")
def routes(spark: SparkSession, sf: str) -> DataFrame:
    """the scope of questions that name none."""
    ask = F.element_at(F.array(*map(F.lit, _QUESTIONS)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", recall.route(F.replace(ask, F.lit("{}"), F.col("p_name"))).alias("scope"))


@query("page_guidance", f"WITH {SQL_X}, p AS (SELECT session_id::INT % 9 AS query_id, name, session_id, row_number() OVER (PARTITION BY session_id ORDER BY name) AS pos, count(*) OVER (PARTITION BY session_id) AS total, row_number() OVER (PARTITION BY session_id::INT % 9 ORDER BY name) AS rank FROM x) SELECT query_id, count(*) AS exchanges, count(DISTINCT session_id) AS sessions, count(*) FILTER (WHERE pos < total) AS mid_thread, arg_min(name, rank) FILTER (WHERE pos < total) AS anchor, count(*) FILTER (WHERE pos = total) AS terminal FROM p WHERE rank <= 8 GROUP BY query_id")
def page_guidance(spark: SparkSession, sf: str) -> DataFrame:
    """D1."""
    from pyspark.sql import Window

    p = recall.thread_facts(recall.thread_positions(_exchanges(spark, sf))).withColumn("query_id", F.col("session_id").cast("int") % 9)
    page = p.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("name"))).where("rank <= 8").withColumns({"type": F.lit("exchange"), "corpus": F.lit("staging")})
    return recall.guidance(page).drop("corpus")


@query("store_audit", f"WITH {SQL_X}, s AS (SELECT *, CASE WHEN turn % 3 = 1 THEN 'x-none' ELSE lag(name) OVER (PARTITION BY session_id ORDER BY turn) END AS previous FROM x WHERE turn <> 2) SELECT 'missing' AS kind, name FROM x WHERE turn = 2 UNION ALL SELECT 'orphan', name FROM s WHERE turn = 0 UNION ALL SELECT 'dangling-previous', name FROM s WHERE previous = 'x-none' UNION ALL SELECT 'duplicate-body', name FROM (SELECT name, row_number() OVER (PARTITION BY session_id, text ORDER BY name) AS n FROM s) WHERE n > 1")
def store_audit(spark: SparkSession, sf: str) -> DataFrame:
    """V16, J24."""
    from pyspark.sql import Window

    x = _exchanges(spark, sf)
    stored = x.where("turn <> 2").withColumn("previous", F.lag("name").over(Window.partitionBy("session_id").orderBy("turn"))).withColumn("previous", F.when(F.col("turn") % 3 == 1, "x-none").otherwise(F.col("previous")))
    return upkeep.store_audit(stored, x.where("turn <> 0").select("name"))


@query("scope_names", f"WITH {SQL_DOCS}, w AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN upper(name) WHEN 1 THEN ' Team/' || upper(name) || '.MD' WHEN 2 THEN 'file-' || doc_id ELSE upper(replace(name, '-', ' ')) END AS wanted FROM docs) SELECT wanted, 'doc-' || doc_id AS name FROM w")
def scope_names(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by name, by file with its folder, by file alone, or by letters and digits; whatever the case."""
    from corpusloom.sources.markdown import resolve_names

    d = documents(spark, sf)
    place = F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("team/"), "name", F.lit(".md"))).otherwise(F.concat(F.lit("team/file-"), "doc_id", F.lit(".md")))
    d = d.withColumn("file", place)
    k = F.col("doc_id") % 4
    wanted = d.select(F.when(k == 0, F.upper("name")).when(k == 1, F.concat(F.lit(" Team/"), F.upper("name"), F.lit(".MD"))).when(k == 2, F.concat(F.lit("file-"), "doc_id")).otherwise(F.upper(F.replace("name", F.lit("-"), F.lit(" ")))).alias("wanted"))
    return resolve_names(d, wanted).select("wanted", "name")


@query("recency_epoch", f"WITH {SQL_DOCS} SELECT account, max(modified) AS newest, TIMESTAMP '{EPOCH}' - max(modified) > INTERVAL 48 HOUR AS old FROM docs GROUP BY account")
def recency_epoch(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the newest row is more than two days old."""
    d = documents(spark, sf).select(F.lit(1).alias("query_id"), F.col("account").alias("corpus"), F.col("modified").alias("when"))
    return recall.last_word(d, ts(EPOCH)).select(F.col("corpus").alias("account"), "newest", "old")


_PLACES = ("/tmp/{}", "/r/memory/{}", "{}.md", "/r/src/{}.py", "/r/node_modules/{}", "/u/.claude/projects/p/tasks/{}.js", "/u/.claude/x/my-Memory-{}", "/r/Scratchpad/{}", "/a/{}.memory-index.json", "/a/{}.ZIP", "/r/knowledge-base/{}.md", "/r/.git/{}", "/u/.claude/projects/p/notes/{}.txt", "/tmp2/{}", "/x/MEMORY.md", "")
_LASTS = (False, True, True, True, False, False, True, False, False, False, True, False, True, True, True, False)
_KINDS = ("other", "memory", "doc", "code", "other", "code", "memory", "other", "code", "other", "kb", "other", "doc", "other", "memory", "other")


@query("write_kinds", f"SELECT page_id, ([{', '.join(map(str, _LASTS))}])[page_id % 16 + 1] AS durable, ([{', '.join(map(sql_text, _KINDS))}])[page_id % 16 + 1] AS kind FROM pages")
def write_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """paths that last, and what is written there; the SQL holds the answers for each form of a path."""
    form = F.element_at(F.array(*map(F.lit, _PLACES)), (F.col("page_id") % 16 + 1).cast("int"))
    path = F.replace(form, F.lit("{}"), F.col("page_id").cast("string"))
    return table(spark, sf, "pages").select("page_id", claims.is_durable(path).alias("durable"), claims.kind_of(path).alias("kind"))


@query("log_report", f"WITH {SQL_LOG} SELECT caller % 10 AS caller, count(DISTINCT caller) AS questions, count(DISTINCT caller) FILTER (WHERE f) AS misses, round(count(DISTINCT caller) FILTER (WHERE f) / count(DISTINCT caller)::DOUBLE, 4) AS miss_share FROM (SELECT caller, bool_and(failed) AS f FROM lg GROUP BY caller) GROUP BY caller % 10")
def log_report(spark: SparkSession, sf: str) -> DataFrame:
    """Questions and misses of each caller."""
    log = _log(spark, sf).withColumn("query_id", F.lit(None).cast("string")).withColumn("caller", F.col("caller") % 10)
    return claims.report(log)


@query("file_changes", f"WITH {SQL_DOCS} SELECT name AS file, CASE WHEN doc_id % 7 = 0 THEN 'added' WHEN doc_id % 13 = 0 THEN 'deleted' ELSE 'modified' END AS change, doc_id % 7 <> 0 AND doc_id % 13 = 0 AS held FROM docs WHERE NOT (doc_id % 7 = 0 AND doc_id % 13 = 0) AND (doc_id % 7 = 0 OR doc_id % 13 = 0 OR doc_id % 11 = 0)")
def file_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What changed between two states of a store."""
    a, b = _index_and_files(spark, sf)
    return claims.changes(a.withColumnRenamed("file_id", "file"), b.withColumnRenamed("file_id", "file"))


@query("identifier_check", "WITH a AS (SELECT p_partkey AS query_id, unnest([p_brand, p_type, p_name]) AS identifier FROM part), k AS (SELECT DISTINCT p_brand AS identifier FROM part WHERE p_size < 20) SELECT query_id, a.identifier, k.identifier IS NOT NULL AS found FROM a LEFT JOIN k ON k.identifier = a.identifier")
def identifier_check(spark: SparkSession, sf: str) -> DataFrame:
    """Identifiers of each query that no repository has."""
    p = table(spark, sf, "part")
    return claims.identifier_check(p.select(F.col("p_partkey").alias("query_id"), F.array("p_brand", "p_type", "p_name").alias("identifiers")), p.where("p_size < 20").select(F.col("p_brand").alias("identifier")))


@query("key_facts", f"WITH {SQL_DOCS} SELECT name, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN length(account) >= 3 THEN account || '|' ELSE '' END || project || '|' || name ELSE '' END AS facts FROM docs")
def key_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts joined to their documents; those too short go."""
    d = documents(spark, sf)
    rows = claims.with_key_facts(d, d.where("doc_id % 2 = 0").select("name", F.array("account", "project", "name").alias("facts")))
    return rows.select("name", F.array_join("key_facts", "|").alias("facts"))
