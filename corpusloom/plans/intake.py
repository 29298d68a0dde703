"""Registered queries of sources, sinks and capture: the tables go through files of the kinds that are read, and come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.plans.registry import query
from corpusloom.plans.store import _SECRETS
from corpusloom.plans.views import EPOCH, SQL_DOCS, documents, table
from corpusloom.sources import markdown, sinks, transcripts
from corpusloom.sources.files import scratch, write_files
from corpusloom.streaming import capture

_HIT = f"len(list_filter([{_SECRETS.replace('text', 'body')}], lambda x: x IS NOT NULL)) > 0"


def _notes(spark: SparkSession, sf: str) -> DataFrame:
    """(file, text): every document as a Markdown note; some with a byte order mark and CRLF, some without front matter, some marked secret."""
    d = documents(spark, sf).select("doc_id", F.coalesce("body", F.lit("")).alias("body"), "tier", "modified")
    front = F.concat(F.lit("---\nname: note-"), "doc_id", F.lit("\ndescription: \"About it\"\nmetadata:\n  type: rule\n  tier: "), "tier", F.lit("\n  modified: "), F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.when(F.col("doc_id") % 11 == 0, F.lit("\n  secret: true")).otherwise(F.lit("")), F.lit("\n---\n"))
    text = F.when(F.col("doc_id") % 4 == 3, F.col("body")).otherwise(F.concat(front, "body"))
    text = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("﻿"), F.regexp_replace(text, "\n", "\r\n"))).otherwise(text)
    return d.select(F.concat(F.lit("f-"), "doc_id", F.when(F.col("doc_id") % 2 == 0, F.lit(".md")).otherwise(F.lit(".MD"))).alias("file"), text.alias("text"))


def _corpus(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    path = scratch(spark, "notes")
    write_files(_notes(spark, sf), path)
    return markdown.load_corpus(markdown.list_files(spark, [{"corpus": "curated", "dir": path}, {"corpus": "none", "dir": f"{path}/absent"}]))


SQL_NOTES = f"""WITH {SQL_DOCS}, n AS (SELECT doc_id, regexp_replace(coalesce(body, ''), '\\r\\n?', chr(10), 'g') AS body, tier, modified, doc_id % 4 <> 3 AS front, 'f-' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.MD' END AS file FROM docs),
m AS (SELECT *, CASE WHEN front AND doc_id % 11 = 0 THEN 'marked secret' WHEN {_HIT} THEN 'secret' END AS reason FROM n)"""


@query("markdown_corpus", SQL_NOTES + " SELECT file, CASE WHEN front THEN 'note-' || doc_id ELSE 'f-' || doc_id END AS name, front AS has_front_matter, CASE WHEN front THEN 'rule' ELSE 'memory' END AS type, CASE WHEN front THEN tier ELSE 'hot' END AS tier, CASE WHEN front THEN modified END AS stamped, sha256(body) AS digest FROM m WHERE reason IS NULL")
def markdown_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Notes written as files, listed and read again."""
    kept, _ = _corpus(spark, sf)
    stamped = F.when(F.col("has_front_matter"), F.col("modified"))
    return kept.select("file", "name", "has_front_matter", "type", "tier", stamped.alias("stamped"), F.sha2("body", 256).alias("digest"))


@query("excluded_notes", SQL_NOTES + " SELECT file, reason FROM m WHERE reason IS NOT NULL")
def excluded_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Notes left out, and why."""
    return _corpus(spark, sf)[1].select("file", F.when(F.col("reason").startswith("secret"), "secret").otherwise(F.col("reason")).alias("reason"))


@query("folder_texts", r"""WITH f AS (SELECT doc_id, text, CASE doc_id % 6 WHEN 0 THEN 'a/b/t-' || doc_id || '.txt' WHEN 1 THEN 'h-' || doc_id || '.html' WHEN 2 THEN 'a/.hid/x-' || doc_id || '.txt' WHEN 3 THEN 'p-' || doc_id || '.pdf' WHEN 4 THEN '1/2/3/4/5/deep-' || doc_id || '.md' ELSE 'a/m-' || doc_id || '.md' END AS file FROM documents)
SELECT file, CASE doc_id % 6 WHEN 1 THEN 'html' WHEN 3 THEN NULL ELSE sha256(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g')) END AS digest, CASE WHEN doc_id % 6 = 3 THEN 'no reader for .pdf' END AS skipped FROM f WHERE doc_id % 6 NOT IN (2, 4)""")
def folder_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Folders of files of several kinds; hidden and deep ones are passed over, others skipped with a reason."""
    k, i = F.col("doc_id") % 6, F.col("doc_id").cast("string")
    file = F.when(k == 0, F.concat(F.lit("a/b/t-"), i, F.lit(".txt"))).when(k == 1, F.concat(F.lit("h-"), i, F.lit(".html"))).when(k == 2, F.concat(F.lit("a/.hid/x-"), i, F.lit(".txt"))).when(k == 3, F.concat(F.lit("p-"), i, F.lit(".pdf"))).when(k == 4, F.concat(F.lit("1/2/3/4/5/deep-"), i, F.lit(".md"))).otherwise(F.concat(F.lit("a/m-"), i, F.lit(".md")))
    path = scratch(spark, "folder")
    write_files(table(spark, sf, "documents").select(file.alias("file"), "text"), path)
    rows = markdown.read_texts(spark, path)
    digest = F.when(F.col("file").endswith(".html"), "html").otherwise(F.sha2("text", 256))
    return rows.select("file", F.when(F.col("skipped").isNull(), digest).alias("digest"), "skipped")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as transcript lines (file, line_no, line), with a torn line in each, and block contents for replies."""
    c = table(spark, sf, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    content = F.when(F.col("role") == "assistant", F.to_json(F.array(F.struct(F.lit("text").alias("type"), "text"), F.struct(F.lit("tool_use").alias("type"), F.lit("no").alias("text"))))).otherwise(F.col("text"))
    stamp = F.date_format(F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(conv_id % 300 as int), 0, cast(turn as int), 0)"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    message = F.concat(F.lit('{"type":"'), "role", F.lit('","timestamp":"'), stamp, F.lit('","sessionId":"'), F.lpad(F.col("conv_id").cast("string"), 8, "0"), F.lit('","message":{"role":"'), "role", F.lit('","content":'), F.when(F.col("role") == "assistant", content).otherwise(F.get(F.split(F.to_json(F.struct(F.col("text").alias("t"))), '^\\{"t":', 2), F.lit(1)).substr(F.lit(1), F.length(F.to_json(F.struct(F.col("text").alias("t")))) - 6)), F.lit("}}"))
    return c.select(F.concat(F.lit("s-"), (F.col("conv_id") % 50).cast("string"), F.lit(".jsonl")).alias("file"), "conv_id", "turn", message.alias("line"))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "transcripts")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "turn", "line"))), lambda x: x["line"]), "\n")
    write_files(_lines(spark, sf).groupBy("file").agg(F.concat(whole, F.lit('\n{"type":"user","torn')).alias("text")), path)
    return transcripts.read_transcripts(spark, path)


SQL_TURNS = "WITH t AS (SELECT lpad(conv_id::VARCHAR, 8, '0') AS session_id, turn, role, coalesce(text, '') AS text, TIMESTAMP '2024-01-01' + to_days((conv_id % 300)::INTEGER) + to_minutes(turn) AS ts FROM conversations)"


@query("transcript_turns", SQL_TURNS + " SELECT session_id, role, ts, sha256(text) AS digest FROM t")
def transcript_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Transcripts of JSON lines; torn lines are left out, blocks other than text too."""
    return _turns(spark, sf).select("session_id", "role", "ts", F.sha2("text", 256).alias("digest"))


SQL_PAIRS = SQL_TURNS + """, k AS (SELECT *, CASE role WHEN 'user' THEN 'human' ELSE role END AS kind FROM t), e AS (SELECT *, sum((kind = 'human')::INT) OVER (PARTITION BY session_id ORDER BY turn) AS exchange FROM k),
p AS (SELECT session_id, exchange, max(text) FILTER (WHERE kind = 'human') AS ask, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE kind = 'assistant'), '') AS reply, max(ts) FILTER (WHERE kind = 'human') AS ts FROM e WHERE exchange > 0 GROUP BY ALL)"""


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("role") == "user", "human").otherwise(F.col("role"))
    return transcripts.pair_turns(_turns(spark, sf).withColumn("kind", kind))


@query("exchange_pairs", SQL_PAIRS + " SELECT session_id, exchange::BIGINT AS exchange, 'x-' || session_id || '-' || strftime(ts, '%Y%m%dT%H%M%S') || '000Z' AS name, sha256(ask) AS ask, sha256(reply) AS reply FROM p")
def exchange_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Asks with their replies, named by session and time."""
    rows = transcripts.exchange_names(_pairs(spark, sf))
    return rows.select("session_id", "exchange", "name", F.sha2("ask", 256).alias("ask"), F.sha2("reply", 256).alias("reply"))


@query("deferred_exchanges", SQL_PAIRS + ", d AS (SELECT *, max(exchange) OVER (PARTITION BY session_id) AS last FROM p) SELECT session_id, exchange::BIGINT AS exchange, ts IS NULL OR TIMESTAMP '2024-10-01' - ts <= INTERVAL 200 DAY AS recent FROM d WHERE exchange < last")
def deferred_exchanges(spark: SparkSession, sf: str) -> DataFrame:
    """All but the last exchange of each session, and which of them are recent."""
    rows = transcripts.defer_last(_pairs(spark, sf))
    recent = transcripts.since(rows, F.lit("2024-10-01").cast("timestamp"), 200 * 1440).select("session_id", "exchange", F.lit(True).alias("recent"))
    return rows.select("session_id", "exchange").join(recent, ["session_id", "exchange"], "left").withColumn("recent", F.coalesce("recent", F.lit(False)))


@query("origin_tasks", SQL_TURNS + r""", h AS (SELECT session_id, arg_min(text, turn) AS first, arg_max(text, turn) AS last FROM t WHERE role = 'user' AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' GROUP BY session_id)
SELECT session_id, left(trim(regexp_extract(first, '(?s)^(.*?)(?:[.!?](?:\s|$)|\n|$)', 1)), 80) AS task, sha256(last) AS prompt FROM h""")
def origin_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """What each session began with, and its last prompt."""
    turns = _turns(spark, sf)
    return transcripts.origin_task(turns).join(transcripts.last_prompt(turns), "session_id").select("session_id", "task", F.sha2("prompt", 256).alias("prompt"))


@query("scheduled_sessions", SQL_TURNS + ", f AS (SELECT session_id, arg_min(text, turn) AS t FROM t WHERE role = 'user' GROUP BY session_id) SELECT session_id, count(*) AS turns FROM t WHERE session_id NOT IN (SELECT session_id FROM f WHERE regexp_matches(t, '^[A-M]')) GROUP BY session_id")
def scheduled_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """sessions whose first ask doesn't start a scheduled task."""
    from corpusloom.operators import claims

    return claims.without_pool_sessions(_turns(spark, sf), "^[A-M]").groupBy("session_id").agg(F.count("*").alias("turns"))


@query("chat_exports", "WITH c AS (SELECT conv_id, string_agg('**' || role || ':** ' || trim(text), chr(10) || chr(10) ORDER BY turn) AS t FROM conversations WHERE role <> 'system' AND trim(coalesce(text, '')) <> '' GROUP BY conv_id) SELECT 'c' || conv_id AS title, sha256(t) AS digest FROM c")
def chat_exports(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as chat exports, written and read again."""
    c = table(spark, sf, "conversations")
    node = F.struct(F.struct(F.struct(F.col("role").alias("role")).alias("author"), F.col("turn").cast("double").alias("create_time"), F.struct(F.array(F.coalesce("text", F.lit(""))).alias("parts")).alias("content")).alias("message"))
    conv = c.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("turn").cast("string"), node))).alias("mapping"))
    conv = conv.select("conv_id", F.struct(F.concat(F.lit("c"), "conv_id").alias("title"), F.col("conv_id").cast("double").alias("create_time"), "mapping").alias("c"))
    path = scratch(spark, "exports")
    write_files(conv.groupBy((F.col("conv_id") % 40).alias("k")).agg(F.to_json(F.collect_list("c")).alias("text")).select(F.concat(F.lit("e-"), "k", F.lit(".json")).alias("file"), "text"), path)
    return transcripts.read_export(spark, path).select("title", F.sha2("text", 256).alias("digest"))


def _index(spark: SparkSession, sf: str) -> tuple[str, DataFrame, DataFrame]:
    docs = documents(spark, sf).select("corpus", "name", "description", "body")
    chunks = table(spark, sf, "embeddings").select(F.lit("curated").alias("corpus"), F.concat(F.lit("doc-"), "vec_id").alias("name"), F.lit(0).alias("chunk_ix"), F.lit("t").alias("text"), F.col("embedding").cast("array<float>").alias("vec"))
    return scratch(spark, "index"), docs, chunks


@query("index_round_trip", f"WITH {SQL_DOCS} SELECT 'curated' AS corpus, name, sha256(coalesce(body, '')) AS digest, vec_id IS NOT NULL AS dense FROM docs LEFT JOIN embeddings ON vec_id = doc_id")
def index_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """An index written, checked and read again."""
    path, docs, chunks = _index(spark, sf)
    size = len(chunks.select("vec").first()[0])
    sinks.write_index(docs, chunks, path, 1, size)
    d, c, problems = sinks.read_index(spark, path, size)
    if problems or sinks.header(spark, path)["docs"] != docs.count():
        raise AssertionError(problems)
    return d.join(c.select("name", F.col("vec").isNotNull().alias("dense")), "name", "left").select("corpus", "name", F.sha2(F.coalesce("body", F.lit("")), 256).alias("digest"), F.coalesce("dense", F.lit(False)).alias("dense"))


@query("vanished_report", "SELECT 'doc-' || doc_id AS name, n AS docs_before, n - gone AS docs_after FROM documents, (SELECT count(*) AS n, count(*) FILTER (WHERE doc_id % 9 = 4) AS gone FROM documents) WHERE doc_id % 9 = 4")
def vanished_report(spark: SparkSession, sf: str) -> DataFrame:
    """K5: names that a new index lacks are reported."""
    path, docs, chunks = _index(spark, sf)
    size = len(chunks.select("vec").first()[0])
    sinks.write_index(docs, chunks, path, 1, size)
    sinks.write_index(docs.where("cast(substring(name, 5) as long) % 9 <> 4"), chunks, path, 1, size, "now")
    return spark.read.json(path + ".vanished").select("name", "docs_before", "docs_after")


@query("query_log", "SELECT event_id, user_id, event_type FROM events")
def query_log(spark: SparkSession, sf: str) -> DataFrame:
    """Rows appended to a log in two parts, and read again without its torn lines."""
    path = scratch(spark, "log")
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    sinks.append_log(e.where("event_id % 2 = 0"), path)
    sinks.append_log(e.where("event_id % 2 <> 0"), path)
    spark.createDataFrame([('{"event_id": 1, "us',)], "value string").write.mode("append").text(path)
    return sinks.read_log(spark, path, "event_id long, user_id long, event_type string")


def _states(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = documents(spark, sf).select("doc_id", "name", F.col("account").alias("session_id"), F.coalesce("body", F.lit("")).alias("body"))
    stored = d.where("doc_id % 7 <> 0").select("name", "session_id", F.when(F.col("doc_id") % 11 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")).alias("body"))
    renamed = F.when(F.col("doc_id") % 17 == 0, F.concat("name", F.lit("-new"))).otherwise(F.col("name"))
    return stored, d.where("doc_id % 13 <> 0").select(renamed.alias("name"), "session_id", "body")


SQL_STATES = f"""WITH {SQL_DOCS}, a AS (SELECT name, account AS session_id, coalesce(body, '') || CASE WHEN doc_id % 11 = 0 THEN '!' ELSE '' END AS body FROM docs WHERE doc_id % 7 <> 0), b AS (SELECT name || CASE WHEN doc_id % 17 = 0 THEN '-new' ELSE '' END AS name, account AS session_id, coalesce(body, '') AS body FROM docs WHERE doc_id % 13 <> 0)"""


@query("write_states", SQL_STATES + " SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'new' WHEN b.name IS NULL THEN 'orphan' WHEN a.body = b.body THEN 'unchanged' ELSE 'rewritten' END AS state FROM a FULL JOIN b ON a.name = b.name")
def write_states(spark: SparkSession, sf: str) -> DataFrame:
    """What a writer does with each file."""
    return transcripts.write_states(*_states(spark, sf))


@query("prunable", SQL_STATES + " SELECT name FROM a WHERE name NOT IN (SELECT name FROM b) AND (session_id, body) IN (SELECT (session_id, body) FROM b)")
def prunable(spark: SparkSession, sf: str) -> DataFrame:
    """Orphans whose text lives on under another name."""
    return transcripts.prunable(*_states(spark, sf))


@query("upserts", "SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def upserts(spark: SparkSession, sf: str) -> DataFrame:
    """T5: two batches upserted by key; of equal keys the latest stays."""
    path = scratch(spark, "upsert")
    e = table(spark, sf, "events").select("user_id", "event_id", "value")
    half = e.agg(F.percentile("event_id", 0.5)).first()[0]
    capture.upsert(e.where(F.col("event_id") <= half), path, "user_id", "event_id")
    capture.upsert(e.where(F.col("event_id") > half), path, "user_id", "event_id")
    return spark.read.parquet(path)


@query("heartbeat_gaps", "WITH g AS (SELECT event_type AS source, ts AS until, lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS since FROM events) SELECT source, since, until FROM g WHERE floor(epoch(until)) - floor(epoch(since)) > 3600")
def heartbeat_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches of more than an hour without an event of a kind."""
    return capture.gaps(table(spark, sf, "events").select(F.col("event_type").alias("source"), "ts"), 3600)


@query("captures_due", f"WITH d AS (SELECT 'doc-' || doc_id AS path, n_chars AS size, TIMESTAMP '{EPOCH}' - to_seconds((doc_id % 1500)::INTEGER) AS mtime, n_chars + doc_id % 3 AS seen, doc_id % 5 <> 0 AS known FROM documents) SELECT path FROM d WHERE NOT (known AND epoch(mtime) - epoch(TIMESTAMP '{EPOCH}' - INTERVAL 20 MINUTE) < 600 AND size = seen)")
def captures_due(spark: SparkSession, sf: str) -> DataFrame:
    """Transcripts to capture: grown, or not seen for ten minutes."""
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("doc-"), "doc_id").alias("path"), F.col("n_chars").alias("size"), F.expr(f"timestamp'{EPOCH}' - make_interval(0, 0, 0, 0, 0, 0, cast(doc_id % 1500 as int))").alias("mtime"))
    seen = d.where("doc_id % 5 <> 0").select("path", (F.col("size") + F.col("doc_id") % 3).alias("size"), F.expr(f"timestamp'{EPOCH}' - interval 20 minutes").alias("at"))
    return capture.due(d.drop("doc_id"), seen).select("path")


@query("snapshots_kept", "SELECT user_id::VARCHAR AS name, ts AS at FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) <= 5")
def snapshots_kept(spark: SparkSession, sf: str) -> DataFrame:
    """The newest five of each."""
    return sinks.newest_snapshots(table(spark, sf, "events").select(F.col("user_id").cast("string").alias("name"), F.col("ts").alias("at")), 5)


@query("held_scrub", f"SELECT doc_id, sha256({'regexp_replace(' * len(T.SECRET_PATTERNS)}coalesce(text, '')" + "".join(f", '{p.replace(chr(39), chr(39) * 2)}', '[REDACTED:{n}]', 'g')" for n, p in T.SECRET_PATTERNS) + ") AS digest FROM documents")
def held_scrub(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with their secrets taken out; the job fails if one is left."""
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("body"))
    return sinks.held_scrub(d).select("doc_id", F.sha2("body", 256).alias("digest"))
