"""The engine's entities over the driver's tables, in DataFrames and in the same terms in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import constants as K
from corpusloom.functions.text import first_words, space_words

AS_OF = "2024-07-01 00:00:00"
EPOCH = "2024-06-01 00:00:00"
QUERIES = ((1, "the edation of thonre with ingly"), (2, "stupid clown thing about that-thing"), (3, "kubernetes queeau les enfants"), (4, "erheit der ungsch"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """A scan of fewer partitions than cores, dealt out to all cores; larger scans stay as they are."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(n) if rows.rdd.getNumPartitions() < n else rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a corpus: a name, a description of 12 words, a tier from labels, a date by id."""
    d, labels = spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = d.join(labels, "doc_id", "left")
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    return rows.select(
        F.lit("curated").alias("corpus"), "doc_id", name.alias("name"), name.alias("file"), first_words("text", 12).alias("description"), F.col("text").alias("body"),
        F.col("source").alias("project"), F.col("lang").alias("account"), F.when(F.col("quality") == 0, "archive").otherwise("hot").alias("tier"), (F.col("doc_id") % 7 == 0).alias("in_memory_index"),
        F.expr(f"timestamp'{EPOCH}' - make_interval(0, 0, 0, cast(doc_id % 900 as int))").alias("modified"), F.lit(None).cast("string").alias("session_id"),
    )


SQL_WORDS = r"list_filter(string_split_regex(coalesce({0}, ''), '\s+'), lambda x: x <> '')"

SQL_DOCS = rf"""
docs AS (SELECT 'curated' AS corpus, d.doc_id, 'doc-' || d.doc_id AS name, array_to_string(({SQL_WORDS.format('d.text')})[1:12], ' ') AS description, d.text AS body,
  source AS project, lang AS account, CASE WHEN quality = 0 THEN 'archive' ELSE 'hot' END AS tier, d.doc_id % 7 = 0 AS in_memory_index, TIMESTAMP '{EPOCH}' - to_days((d.doc_id % 900)::INTEGER) AS modified
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


#: Of the documents, one in SAMPLED gives a query: six words of its text, with the vector of its own id.
SAMPLED = 50


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query: QUERIES, and one of each SAMPLED documents; as a small table of its own, since it is read many times."""
    own = table(spark, sf_dir, "documents").where(F.col("doc_id") % SAMPLED == 7).select(F.col("doc_id").cast("int").alias("query_id"), F.array_join(F.slice(space_words("text"), 5, 6), " ").alias("query"))
    return spark.createDataFrame(list(QUERIES), "query_id int, query string").union(own)


SQL_QUERIES = "asked(query_id, query) AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in QUERIES) + f") UNION ALL SELECT doc_id::INTEGER, array_to_string(({SQL_WORDS.format('text')})[5:10], ' ') FROM documents WHERE doc_id % {SAMPLED} = 7)"


def sql_stem(t: str) -> str:
    return f"""CASE WHEN length({t}) < 5 OR NOT regexp_full_match({t}, '[a-z]+') THEN {t} WHEN {t} LIKE '%ies' AND length({t}) > 5 THEN left({t}, -3) || 'y'
 WHEN {t} LIKE '%sses' OR {t} LIKE '%shes' OR {t} LIKE '%ches' THEN left({t}, -2) WHEN {t} LIKE '%ing' AND length({t}) > 6 THEN left({t}, -3)
 WHEN {t} LIKE '%ed' AND length({t}) > 5 THEN left({t}, -2) WHEN {t} LIKE '%es' AND length({t}) > 5 THEN left({t}, -1) WHEN {t} LIKE '%s' AND {t} NOT LIKE '%ss' THEN left({t}, -1) ELSE {t} END"""


def sql_tokens(text: str) -> str:
    parts = r"list_filter(string_split_regex(c, '[.\-/]'), lambda p: length(p) > 1)"
    stop = ", ".join(f"'{w}'" for w in K.STOP_WORDS)
    raw = rf"list_filter(list_transform(string_split_regex(regexp_replace(lower(coalesce({text}, '')), '[`*_~>#|]', ' ', 'g'), '[^a-z0-9.+/-]+'), lambda x: regexp_replace(x, '^[.\-/+]+|[.\-/+]+$', '', 'g')), lambda x: x <> '')"
    every = f"flatten(list_transform({raw}, lambda c: CASE WHEN len({parts}) > 1 THEN list_concat([c], {parts}) ELSE [c] END))"
    return f"list_transform(list_filter({every}, lambda x: length(x) > 1 AND x NOT IN ({stop})), lambda t: {sql_stem('t')})"


#: BM25F in SQL: terms asked, raw scores, and what the queries' terms say.
SQL_BM25 = rf"""
WITH {SQL_DOCS}, {SQL_QUERIES},
tok AS (SELECT name, 0 AS g, unnest({sql_tokens("replace(replace(name, '-', ' '), '_', ' ') || ' ' || name")}) AS term, {K.NAME_WEIGHT} AS w FROM docs
  UNION ALL SELECT name, 0, unnest({sql_tokens('description')}), {K.DESCRIPTION_WEIGHT} FROM docs UNION ALL SELECT name, 2, unnest({sql_tokens('body')}), {K.BODY_WEIGHT} FROM docs),
tf AS (SELECT name, g, term, sum(w)::DOUBLE AS tf FROM tok GROUP BY ALL),
len AS (SELECT name, coalesce(sum(tf) FILTER (WHERE g = 0), 0) AS l0, coalesce(sum(tf) FILTER (WHERE g = 2), 0) AS l2 FROM tf GROUP BY name),
st AS (SELECT (SELECT count(*) FROM docs) AS n, sum(l0) / (SELECT count(*) FROM docs) AS a0, sum(l2) / (SELECT count(*) FROM docs) AS a2 FROM len),
post AS (SELECT name, term, sum(tf / (1 - {K.B} + {K.B} * CASE g WHEN 0 THEN l0 / a0 ELSE l2 / a2 END)) AS w FROM tf JOIN len USING (name), st GROUP BY name, term),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
qt AS (SELECT DISTINCT query_id, unnest({sql_tokens('query')}) AS term FROM asked),
raw AS (SELECT query_id, name, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * w * ({K.K1} + 1) / ({K.K1} + w)) AS raw FROM qt JOIN post USING (term) JOIN df USING (term), st GROUP BY query_id, name),
qs AS (SELECT query_id, qt.term, df, n FROM qt LEFT JOIN df USING (term), st),
orph AS (SELECT a.query_id, a.term FROM qs a WHERE a.df IS NULL AND NOT EXISTS (SELECT 1 FROM qs b WHERE b.query_id = a.query_id AND b.df IS NOT NULL AND (contains(a.term, b.term) OR contains(b.term, a.term)))),
stats AS (SELECT query_id, coalesce(sum(ln(1 + (n - df + 0.5) / (df + 0.5))) FILTER (WHERE df IS NOT NULL), 0) * ({K.K1} + 1) AS ideal, count(*) FILTER (WHERE df IS NULL) AS n_absent,
  count(*) FILTER (WHERE df IS NOT NULL) AS n_present, max(ln(1 + (n + 0.5) / 0.5)) * ({K.K1} + 1) AS missing FROM qs GROUP BY query_id),
stat AS (SELECT query_id, ideal, ideal + n_absent * missing AS ideal_full, n_present, n_absent, (SELECT count(*) FROM orph o WHERE o.query_id = s.query_id) AS n_orphans,
  CASE WHEN ideal + n_absent * missing > 0 THEN (SELECT count(*) FROM orph o WHERE o.query_id = s.query_id) * missing / (ideal + n_absent * missing) ELSE 0 END AS orphan_share FROM stats s),
kw AS (SELECT query_id, name, raw, least(1, greatest(0, (raw - least({K.KEYWORD_FLOOR}, {K.COVERAGE_FLOOR} * ideal)) / (least({K.KEYWORD_FULL}, {K.COVERAGE_FULL} * ideal) - least({K.KEYWORD_FLOOR}, {K.COVERAGE_FLOOR} * ideal)))) * least(1, raw / ideal / {K.COVERAGE_FLOOR}) AS keyword
  FROM raw JOIN stat USING (query_id) WHERE ideal > 0 AND raw > least({K.KEYWORD_FLOOR}, {K.COVERAGE_FLOOR} * ideal))"""


#: What texts may hold, by doc_id; the tables at hand hold little of it. Appended to the whole texts.
NOTES = (
    "Shipped v112 on 2024-03-02. The port 8080 is open.\nSee lib/git-join.js and --shadow-all, MEMORY_CURRENCY_REPOS at 1a2b3c4d.",
    "We have 12 documents and 3 tests now.\n✅ done\nMail Ann@GMAIL.com, bob@Corp.Example.com or x@me.com, a.b@sub.acme.org.",
    "corrected on 2023-11: no longer true\nWin v9 and Mac v10, run(x) and go() at :4321",
    "summary of the year---front 7fffffff---back abcdef1 1234567",
    "That is \u26a0\ufe0f fine. One two three four five six seven. " * 4,
    "src/x.verylong flag --ab and --abc, A_B and AB_C; {x} = [y]; #1 $2 <z>",
    "",
)


def noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents (doc_id, text), each text with one of NOTES after it."""
    note = F.element_at(F.array(*map(F.lit, NOTES)), (F.pmod("doc_id", F.lit(len(NOTES))) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), note).alias("text"))


def sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


SQL_NOTED = "noted AS (SELECT doc_id, coalesce(text, '') || chr(10) || ([" + ", ".join(map(sql_text, NOTES)) + f"])[(doc_id % {len(NOTES)} + {len(NOTES)}) % {len(NOTES)} + 1] AS text FROM documents)"
