"""Chat transcripts and exports: from lines to exchanges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom import constants as K
from corpusloom.functions.text import first_words

_BLOCKS = "array<struct<type: string, text: string>>"
_LINE = "type string, operation string, reason string, timestamp string, sessionId string, content string, message struct<role: string, content: string>"
_EXPORT = "array<struct<title: string, create_time: double, mapping: map<string, struct<message: struct<author: struct<role: string>, create_time: double, content: struct<parts: array<string>>>>>>>"


def text_of(content: Column) -> Column:
    """The text of a message: a string, or the text blocks of an array."""
    blocks = F.from_json(content, _BLOCKS)
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    return F.when(F.ltrim(content).startswith("[") & blocks.isNotNull(), joined).otherwise(content)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """session_id, line_no, type, operation, reason, ts, role, text of JSONL files; lines that aren't JSON are left out.

    session_id is a line's own, else its file's name. line_no follows the file's order.
    """
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.jsonl)?$", 1).alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    j = raw.withColumn("j", F.from_json("line", _LINE, {"mode": "PERMISSIVE"})).where("j.type is not null")
    return j.select(F.coalesce("j.sessionId", "file").alias("session_id"), "line_no", "j.type", "j.operation", "j.reason", F.try_to_timestamp("j.timestamp").alias("ts"), F.coalesce("j.message.role", "j.type").alias("role"), text_of(F.coalesce("j.message.content", "j.content", F.lit(""))).alias("text"))


# What turns hold or start with that no person typed, and reasons of queued asks that were taken up.
MACHINE_HOLDS = ("<system-reminder>", "<task-notification>")
MACHINE_STARTS = (r"^\s*<cross-session-message\b", r"^\[SYSTEM NOTIFICATION", "^Caveat: The messages below", "^<(command-name|local-command|command-message|bash-input|bash-stdout)")
TAKEN_UP = ("absorbed_mid_turn", "delivered_to_agent")


def is_machine_turn(text: Column) -> Column:
    """Turns that no person typed: reminders and notifications anywhere in them, messages of other sessions, commands and their output, and
    turns of which more than 15 % is markup."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    tags = F.aggregate(F.regexp_extract_all(t, F.lit("(?i)</?[a-z][a-z0-9-]*>"), F.lit(0)), F.lit(0), lambda a, x: a + F.length(x))
    out = (t == "") | (tags > 0.15 * F.length(t))
    for x in MACHINE_HOLDS:
        out = out | F.contains(t, F.lit(x))
    for p in MACHINE_STARTS:
        out = out | t.rlike(p)
    return out


def is_interjection(type_: Column, operation: Column, reason: Column, content: Column) -> Column:
    """Queued asks with a text that were taken up while a reply was under way; the reason may be missing."""
    told = F.coalesce(F.regexp_replace(content, r"\s+", "") != "", F.lit(False))
    return F.coalesce((type_ == "queue-operation") & (operation == "remove"), F.lit(False)) & told & (reason.isNull() | reason.isin(*TAKEN_UP))


def agent_report(text: Column) -> Column:
    """What a notification reports: from the first <result> to the last </result>, inner envelopes off, links made harmless; null if short."""
    inner = F.regexp_extract(text, r"(?s)<result>(.*)</result>", 1)
    inner = F.trim(F.regexp_replace(F.regexp_replace(inner, r"(?s)<(task-notification|system-reminder)>.*?</\1>", ""), r"\[\[", "[ ["))
    return F.when(F.length(inner) >= 40, inner)


def pair_turns(turns: DataFrame) -> DataFrame:
    """session_id, exchange, ask_name, ask, reply, ts: each human turn with what is said until the next human turn.

    turns: session_id, line_no, kind (human, assistant, or others), text, and optionally name and ts. Other turns are skipped, but a
    report in one is added to the reply.
    """
    order = Window.partitionBy("session_id").orderBy("line_no")
    human = F.col("kind") == "human"
    rows = turns.withColumn("exchange", F.sum(human.cast("int")).over(order)).where("exchange > 0")
    said = F.when(F.col("kind") == "assistant", F.col("text")).when(~human, agent_report(F.col("text")))
    parts = F.filter(F.array_sort(F.collect_list(F.struct("line_no", said.alias("t")))), lambda x: x["t"].isNotNull())
    extra = [F.max(F.when(human, F.col("name"))).alias("ask_name")] if "name" in turns.columns else []
    extra += [F.max(F.when(human, F.col("ts"))).alias("ts")] if "ts" in turns.columns else []
    return rows.groupBy("session_id", "exchange").agg(F.max(F.when(human, F.col("text"))).alias("ask"), F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("reply"), F.min("line_no").alias("line_no"), *extra)


def fold_interjections(turns: DataFrame, reach: int = 3) -> DataFrame:
    """Turns without interjections that the next `reach` human turns repeat. turns: session_id, line_no, kind (human, interjection, ...), text."""
    rank = F.sum((F.col("kind") == "human").cast("int")).over(Window.partitionBy("session_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    rows = turns.withColumn("_n", rank)
    humans = rows.where("kind = 'human'").select("session_id", F.col("_n").alias("_m"), F.trim("text").alias("_t"))
    doubled = rows.where("kind = 'interjection'").select("session_id", "line_no", F.trim("text").alias("_t"), F.explode(F.sequence(F.col("_n") + 1, F.col("_n") + reach)).alias("_m")).join(humans, ["session_id", "_m", "_t"]).select("session_id", "line_no").distinct()
    return rows.drop("_n").join(doubled, ["session_id", "line_no"], "left_anti")


def exchange_names(exchanges: DataFrame) -> DataFrame:
    """name: x-<8 of session>-<UTC time>; without a time <day>Tx<8 of the ask's hash>, the day being the last known one."""
    order = Window.partitionBy("session_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    day = F.coalesce(F.last(F.date_format("ts", "yyyyMMdd"), True).over(order), F.lit("00000000"))
    stamp = F.when(F.col("ts").isNotNull(), F.date_format("ts", "yyyyMMdd'T'HHmmssSSS'Z'")).otherwise(F.concat(day, F.lit("Tx"), F.substring(F.sha2("ask", 256), 1, 8)))
    named = exchanges.withColumn("name", F.concat(F.lit("x-"), F.substring("session_id", 1, 8), F.lit("-"), stamp))
    n = F.count("*").over(Window.partitionBy("name"))
    return named.withColumn("name", F.when(n == 1, F.col("name")).otherwise(F.raise_error(F.concat(F.lit("two exchanges would be named "), "name")).cast("string")))


def to_documents(exchanges: DataFrame, least: int = K.REPLY_CHARS) -> DataFrame:
    """Exchanges (named) as documents, with the link to the one before; those with short replies go."""
    rows = exchanges.where(F.length("reply") >= least)
    previous = F.lag("name").over(Window.partitionBy("session_id").orderBy("line_no"))
    rows = rows.withColumn("previous", previous)
    body = F.concat_ws("\n\n", F.concat(F.lit("## Ask\n"), "ask"), F.concat(F.lit("## Reply\n"), "reply"), F.concat(F.lit("Previous: [["), "previous", F.lit("]]")))
    return rows.select("session_id", "name", first_words("ask", K.DESCRIPTION_WORDS).alias("description"), body.alias("body"), "ts", "previous", F.lit("exchange").alias("type"))


def defer_last(exchanges: DataFrame) -> DataFrame:
    """All but the last exchange of each session, which may still go on."""
    later = F.lead("exchange").over(Window.partitionBy("session_id").orderBy("exchange"))
    return exchanges.withColumn("_later", later).where("_later is not null").drop("_later")


def since(exchanges: DataFrame, as_of: Column, minutes: int) -> DataFrame:
    """Exchanges of the last minutes; those without a time stay."""
    return exchanges.where(F.col("ts").isNull() | (F.unix_seconds(as_of) - F.unix_seconds("ts") <= minutes * 60))


def write_states(stored: DataFrame, extracted: DataFrame) -> DataFrame:
    """name, state (new, unchanged, rewritten, orphan): stored against newly extracted documents, by the hash of their bodies."""
    a, b = stored.select("name", F.sha2("body", 256).alias("_a")), extracted.select("name", F.sha2("body", 256).alias("_b"))
    state = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "orphan").when(F.col("_a") == F.col("_b"), "unchanged").otherwise("rewritten")
    return a.join(b, "name", "full_outer").select("name", state.alias("state"))


def prunable(stored: DataFrame, extracted: DataFrame) -> DataFrame:
    """name of stored orphans whose body another document of the same session now has."""
    orphans = stored.join(extracted, "name", "left_anti").select("name", "session_id", F.sha2("body", 256).alias("h"))
    return orphans.join(extracted.select("session_id", F.sha2("body", 256).alias("h")), ["session_id", "h"], "left_semi").select("name")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """title, text of each conversation of a chat export: messages in time order, without system and blank ones."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", _EXPORT)).alias("c"))
    messages = F.filter(F.transform(F.map_values("c.mapping"), lambda n: n["message"]), lambda m: m.isNotNull() & (m["author"]["role"] != "system"))
    said = F.transform(messages, lambda m: F.struct(F.coalesce(m["create_time"], F.lit(0.0)).alias("at"), m["author"]["role"].alias("role"), F.trim(F.array_join(F.coalesce(m["content"]["parts"], F.array().cast("array<string>")), "\n")).alias("t")))
    lines = F.transform(F.filter(F.array_sort(said), lambda m: m["t"] != ""), lambda m: F.concat(F.lit("**"), m["role"], F.lit(":** "), m["t"]))
    return raw.select(F.coalesce("c.title", F.lit("untitled")).alias("title"), F.col("c.create_time").alias("create_time"), F.array_join(lines, "\n\n").alias("text")).where("text <> ''")


def _typed(turns: DataFrame) -> DataFrame:
    """Turns that a person typed. turns: session_id, line_no, role, text."""
    return turns.where((F.col("role") == "user") & ~is_machine_turn(F.col("text")))


def origin_task(turns: DataFrame) -> DataFrame:
    """session_id, task: the first sentence (80 characters at most) of the first human turn."""
    rows = _typed(turns).groupBy("session_id").agg(F.min_by("text", "line_no").alias("t"))
    return rows.select("session_id", F.substring(F.trim(F.regexp_extract("t", r"(?s)^(.*?)(?:[.!?](?:\s|$)|\n|$)", 1)), 1, 80).alias("task"))


def last_prompt(turns: DataFrame) -> DataFrame:
    """session_id, prompt: the last human turn."""
    return _typed(turns).groupBy("session_id").agg(F.max_by("text", "line_no").alias("prompt"))
