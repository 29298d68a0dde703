"""Time-ordered recall: term filters newest first, threads of exchanges, and facts about a page of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import constants as K
from corpusloom.operators.sizes import small


def query_words(query: Column) -> Column:
    """Terms of a query as they stand: three characters or more of a-z, 0-9, dot, dash and underscore; repeats stay."""
    return F.regexp_extract_all(F.lower(query), F.lit(r"([a-z0-9][a-z0-9._-]{2,})"), F.lit(1))


def is_summary(description: Column, body: Column) -> Column:
    """Whether a document is a compaction summary by its own words."""
    head = F.concat_ws(" ", description, F.substring(body, 1, 400))
    return F.contains(head, F.lit("This session is being continued from a previous conversation"))


def term_hits(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, corpus, name, ..., matched (terms the document holds as substrings), n: rows with one term or more."""
    q = queries.select("query_id", query_words(F.col("query")).alias("terms")).where(F.size("terms") > 0)
    hay = F.lower(F.concat_ws("\n", "name", "description", "body"))
    rows = docs.withColumn("_hay", hay).join(small(q))  # documents meet the asked queries, not each other
    rows = rows.withColumn("matched", F.filter("terms", lambda t: F.contains(F.col("_hay"), t))).where(F.size("matched") > 0)
    words = F.filter("matched", lambda t: F.regexp_like(F.col("_hay"), F.concat(F.lit("(?<![a-z0-9_])"), F.regexp_replace(t, r"([.\-])", r"\\$1"), F.lit("(?![a-z0-9_])"))))
    return rows.withColumns({"whole": words, "n": F.size("matched")}).drop("_hay")


def latest(hits: DataFrame, limit: int = 5, include_summaries: bool = True) -> DataFrame:
    """Rows with all terms of their query, newest first, summaries last; where no row has all, those with the most, marked relaxed.

    hits: term_hits() with modified (and ts). Ties by name.
    """
    per = Window.partitionBy("query_id", "corpus")
    rows = hits.withColumn("summary", is_summary(F.col("description"), F.col("body")))
    if not include_summaries:
        rows = rows.where("not summary")
    rows = rows.withColumn("most", F.max("n").over(per)).where("n = most").withColumn("relaxed", F.col("most") < F.size("terms"))
    rows = rows.where("not relaxed or size(terms) > 1")
    when = F.coalesce("ts", "modified") if "ts" in hits.columns else F.col("modified")
    order = per.orderBy("summary", F.desc_nulls_last("when"), "name")
    return rows.withColumn("when", when).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("most")


def term_frequencies(hits: DataFrame) -> DataFrame:
    """query_id, corpus, term, df, df_whole: documents that hold each term, and those that hold it as a word."""
    rows = hits.select("query_id", "corpus", "name", F.explode(F.array_distinct("matched")).alias("term"), "whole")
    return rows.groupBy("query_id", "corpus", "term").agg(F.count("*").alias("df"), F.sum(F.array_contains("whole", F.col("term")).cast("long")).alias("df_whole"))


def term_warnings(frequencies: DataFrame) -> DataFrame:
    """Terms found only, or mostly, inside longer words."""
    kind = F.when(F.col("df_whole") == 0, "inside-only").when(F.col("df_whole") * 4 < F.col("df"), "mostly-inside")
    return frequencies.withColumn("warning", kind).where("warning is not null")


def unmatchable(queries: DataFrame, frequencies: DataFrame, corpora: DataFrame) -> DataFrame:
    """query_id, corpus, unmatchable (sorted terms no document holds), rarest (of those held, the one in the fewest)."""
    asked = queries.select("query_id", F.explode(F.array_distinct(query_words(F.col("query")))).alias("term")).join(small(corpora.select("corpus").distinct()))
    known = asked.join(frequencies, ["query_id", "corpus", "term"], "left")
    return known.groupBy("query_id", "corpus").agg(F.array_sort(F.collect_list(F.when(F.col("df").isNull(), F.col("term")))).alias("unmatchable"), F.min_by(F.when(F.col("df").isNotNull(), F.col("term")), F.when(F.col("df").isNotNull(), F.struct("df", "term"))).alias("rarest"))


def dropped_terms(page: DataFrame) -> DataFrame:
    """query_id, corpus, dropped (sorted terms that some kept row lacks), premise_supported (rows, and not relaxed)."""
    rows = page.select("query_id", "corpus", "relaxed", F.explode(F.array_distinct("terms")).alias("term"), "matched")
    each = rows.groupBy("query_id", "corpus", "term").agg(F.min(F.array_contains("matched", F.col("term"))).alias("always"), F.max("relaxed").alias("relaxed"))
    return each.groupBy("query_id", "corpus").agg(F.array_sort(F.collect_list(F.when(~F.col("always"), F.col("term")))).alias("dropped"), (~F.max("relaxed")).alias("premise_supported"))


def thread_positions(exchanges: DataFrame) -> DataFrame:
    """position, total, last name and previous name of each exchange in its session.

    Sessions are in the order of names, but in that of ts where names are of both kinds (old ordinals and timestamps) and every ts is
    known.
    """
    own = Window.partitionBy("session_id")
    old = F.col("name").rlike(r"^x-[0-9a-f]{8}-\d{1,6}$")
    mixed = (F.max(old.cast("int")).over(own) == 1) & (F.min(old.cast("int")).over(own) == 0) & (F.count("ts").over(own) == F.count("*").over(own))
    rows = exchanges.withColumn("_key", F.when(mixed, F.date_format("ts", "yyyyMMddHHmmssSSSSSS")).otherwise(F.col("name")))
    order = own.orderBy("_key", "name")
    full = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumns({"position": F.row_number().over(order), "total": F.count("*").over(own), "last_name": F.last("name").over(full), "previous": F.lag("name").over(order)}).drop("_key")


def thread_facts(positions: DataFrame) -> DataFrame:
    """position_text ("k of n"), later_in_thread, thread_last (null on the last itself)."""
    return positions.withColumns({
        "position_text": F.concat_ws(" of ", F.col("position").cast("string"), F.col("total").cast("string")),
        "later_in_thread": F.col("total") - F.col("position"),
        "thread_last": F.when(F.col("name") != F.col("last_name"), F.col("last_name")),
    })


def thread(positions: DataFrame, anchors: DataFrame, forward: int = 8, back: int = 0) -> DataFrame:
    """The exchanges around each anchor (name): offset from it, and how many of the session come after the window."""
    a = positions.join(anchors.select("name"), "name", "left_semi").select("session_id", F.col("name").alias("anchor"), F.col("position").alias("at"))
    rows = positions.join(a, "session_id").withColumn("offset", F.col("position") - F.col("at")).where(F.col("offset").between(-back, forward))
    return rows.withColumn("remaining", F.greatest(F.lit(0), F.col("total") - F.col("at") - forward)).drop("at")


def corpus_clock(docs: DataFrame) -> DataFrame:
    """corpus, clock (ts if more than half have one, else modified), newest, n."""
    return docs.groupBy("corpus").agg(F.when(F.count("ts") * 2 > F.count("*"), "ts").otherwise("modified").alias("clock"), F.max(F.coalesce("ts", "modified")).alias("newest"), F.count("*").alias("n"))


def last_word(page: DataFrame, as_of: Column, hours: int = 48) -> DataFrame:
    """query_id, corpus, newest, old: whether the newest hit is more than `hours` before as_of."""
    return page.groupBy("query_id", "corpus").agg(F.max("when").alias("newest")).withColumn("old", F.unix_micros(as_of) - F.unix_micros("newest") > hours * 3_600_000_000)


def guidance(page: DataFrame) -> DataFrame:
    """query_id, corpus: exchanges, sessions, mid_thread (rows with later ones), anchor (the best of those), terminal rows of a page."""
    x = F.col("type") == "exchange"
    mid = x & (F.col("later_in_thread") > 0)
    return page.groupBy("query_id", "corpus").agg(
        F.count_if(x).alias("exchanges"), F.count_distinct(F.when(x, F.col("session_id"))).alias("sessions"), F.count_if(mid).alias("mid_thread"),
        F.min_by(F.when(mid, F.col("name")), F.when(mid, F.col("rank"))).alias("anchor"), F.count_if(x & (F.col("later_in_thread") == 0)).alias("terminal"),
    )


def brief(page: DataFrame, rows: int = K.BRIEF_ROWS) -> DataFrame:
    """Few rows a corpus with short texts, as for a view of everything."""
    from corpusloom.functions.text import trim_snippet

    return page.where(F.col("rank") <= rows).select("query_id", "corpus", "rank", "name", trim_snippet("body", K.BRIEF_SNIPPET).alias("snippet"), F.substring("description", 1, K.BRIEF_DESCRIPTION).alias("description"))


def rollup(verdicts: DataFrame) -> DataFrame:
    """query_id: over corpora, whether any is stale, none matched strongly, and the number of candidates."""
    return verdicts.groupBy("query_id").agg(F.bool_or("stale").alias("stale"), F.bool_and("no_strong_match").alias("no_strong_match"), F.sum("candidates").alias("candidates"))


# Wordings of questions about an event, about a rule, and about what was handed over; shapes of code.
EVENT = r"(?i)\b(that night|last night|yesterday|earlier|this morning|when we|what did we|did we ever|we decided|we said|at the time|back then|during (the|that))\b"
RULE = r"(?i)\b(what is the rule|how do I|how should|what should I|the rule about|policy|convention|always|never)\b"
HANDOFF = r"(?i)\b(hand-?off|handed over|handing over|phase\s*\d|where (did|do) (we|i) leave|picking (this|it) up|next session|state of (the|this) (project|campaign|work|effort))\b"
CODE_SHAPES = (r"\b[0-9a-f]{7,40}\b", r"\b[\w.-]+/[\w./-]+\.[a-z]{1,5}\b", r"\b[A-Z][A-Z0-9]+(?:_[A-Z0-9]+)+\b", r"(?:^|\s)--[a-z][a-z0-9-]{2,}\b", r"\b[a-z][\w$]*\(\)")


def route(query: Column, projects: bool = False) -> Column:
    """The scope for a question that names none: all if its wording asks for a handoff or, more than for a rule, for an event, or if other
    projects have folders; else curated."""
    q = F.coalesce(query, F.lit(""))
    wide = q.rlike(HANDOFF) | (q.rlike(EVENT) & ~q.rlike(RULE)) | F.lit(projects)
    return F.when(wide, "all").otherwise("curated")


def looks_technical(query: Column) -> Column:
    """Whether a query names things of code: a commit, a path, a constant, a flag or a call."""
    out = F.lit(False)
    for s in CODE_SHAPES:
        out = out | F.coalesce(query, F.lit("")).rlike(s)
    return out
