"""Registered queries of ranked search, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import constants as K
from corpusloom.functions import scoring as S
from corpusloom.functions import text as T
from corpusloom.operators import lexical, ranking, recall
from corpusloom.operators.sizes import small
from corpusloom.plans.registry import query
from corpusloom.plans.views import AS_OF, QUERIES, SQL_BM25, SQL_DOCS, SQL_QUERIES, SQL_WORDS, asked, documents, sql_tokens, table
from corpusloom.sources.files import scratch

DAYS = "(epoch_us({a}) - epoch_us({b})) / 86400000000.0"


@query("tokens", rf"WITH {SQL_DOCS}, t AS (SELECT doc_id, {sql_tokens('body')} AS t FROM docs) SELECT doc_id, len(t)::INTEGER AS n_tokens, sha256(array_to_string(t, ' ')) AS digest FROM t")
def tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's search terms."""
    t = lexical.tokenize("body")
    return documents(spark, sf).select("doc_id", F.size(t).alias("n_tokens"), F.sha2(F.array_join(t, " "), 256).alias("digest"))


@query("bm25_top", SQL_BM25 + f"SELECT query_id, name, round(raw, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 4) DESC, name)::INTEGER AS rank FROM raw QUALIFY rank <= {K.LIMIT}")
def bm25_top(spark: SparkSession, sf: str) -> DataFrame:
    """The best documents of each query by BM25F."""
    queries = asked(spark, sf)
    scores = lexical.keyword_scores(lexical.build_model(documents(spark, sf), queries), queries, best=K.LIMIT, digits=4).withColumn("score", F.round("raw", 4))
    ranked = scores.selectExpr("query_id", "name", "score", "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) AS rank")
    return ranked.where(F.col("rank") <= K.LIMIT)


@query("query_term_stats", SQL_BM25 + "SELECT query_id, round(ideal, 4) AS ideal, round(ideal_full, 4) AS ideal_full, round(orphan_share, 4) AS orphan_share, n_present::INTEGER AS n_present, n_absent::INTEGER AS n_absent, n_orphans::INTEGER AS n_orphans FROM stat")
def query_term_stats(spark: SparkSession, sf: str) -> DataFrame:
    """A5: what each query's own terms say."""
    s = lexical.term_statistics(lexical.build_model(documents(spark, sf), asked(spark, sf)), asked(spark, sf))
    return s.select("query_id", *(F.round(c, 4).alias(c) for c in ("ideal", "ideal_full", "orphan_share")), *(F.size(c).alias(f"n_{c}") for c in ("present", "absent", "orphans")))


@query("keyword_absolute", SQL_BM25 + "SELECT query_id, name, round(keyword, 4) AS keyword FROM kw")
def keyword_absolute(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword scores on the absolute scale."""
    model = lexical.build_model(documents(spark, sf), asked(spark, sf))
    stats = lexical.term_statistics(model, asked(spark, sf))
    rows = lexical.absolute_scores(lexical.keyword_scores(model, asked(spark, sf), stats), stats)
    return rows.select("query_id", "name", F.round("keyword", 4).alias("keyword"))


@query("keyword_relative", SQL_BM25 + "SELECT query_id, name, round(raw / max(raw) OVER (PARTITION BY query_id), 4) AS keyword FROM raw")
def keyword_relative(spark: SparkSession, sf: str) -> DataFrame:
    """Scores by the query's best."""
    queries = asked(spark, sf)
    model = lexical.build_model(documents(spark, sf), queries)
    return lexical.relative_scores(lexical.keyword_scores(model, queries), lexical.keyword_scores(model, queries, best=1)).select("query_id", "name", F.round("keyword", 4).alias("keyword"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.lit("curated").alias("corpus"), F.concat(F.lit("doc-"), F.col("vec_id").cast("string")).alias("name"), F.lit(None).cast("int").alias("chunk_ix"), F.col("embedding").alias("vec"), F.lit("summary").alias("text"))


def _query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Each query's own vector: that of the document it was taken from."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").cast("int").alias("query_id"), F.col("embedding").alias("vec"))
    return e.join(small(asked(spark, sf).select("query_id")), "query_id")


SQL_SEM = f"sem AS (SELECT query_id, name, semantic FROM (SELECT query_id, 'doc-' || c.vec_id AS name, least(1, greatest(0, (list_dot_product(c.embedding::DOUBLE[], q.embedding::DOUBLE[]) - {K.SEMANTIC_FLOOR}) / {K.SEMANTIC_SPAN})) AS semantic FROM asked JOIN embeddings q ON q.vec_id = query_id, embeddings c) WHERE semantic > 0)"


@query("dense_scores", f"WITH {SQL_QUERIES}, {SQL_SEM} SELECT query_id, name, round(semantic, 4) AS semantic FROM sem")
def dense_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity of each document to each query's vector."""
    return ranking.semantic_scores(_vectors(spark, sf), _query_vectors(spark, sf)).select("query_id", "name", F.round("semantic", 4).alias("semantic"))


@query("nearest", "WITH p AS (SELECT 'doc-' || t.vec_id AS name, 'doc-' || c.vec_id AS neighbour, round(list_dot_product(c.embedding::DOUBLE[], t.embedding::DOUBLE[]), 4) AS similarity FROM embeddings t JOIN embeddings c ON t.vec_id <> c.vec_id WHERE TRUE) SELECT name, neighbour, similarity, row_number() OVER (PARTITION BY name ORDER BY similarity DESC, neighbour)::INTEGER AS rank FROM p QUALIFY rank <= 3")
def nearest(spark: SparkSession, sf: str) -> DataFrame:
    """Three nearest neighbours of each document."""
    v = _vectors(spark, sf)
    return ranking.nearest(v, v).select("name", "neighbour", "similarity", "rank")


def store(spark: SparkSession, sf: str, path: str) -> None:
    """Builds what searches read: a model's tables, documents with their numbers of chunks, the reference of these, and vectors."""
    docs = documents(spark, sf).withColumn("n_chunks", T.chunk_count("body"))
    lexical.save_model(lexical.build_model(docs), path)
    docs.write.mode("overwrite").parquet(f"{path}/documents")
    ranking.reference_chunks(spark.read.parquet(f"{path}/documents")).write.mode("overwrite").parquet(f"{path}/reference")
    _vectors(spark, sf).write.mode("overwrite").parquet(f"{path}/vectors")


def search_store(spark: SparkSession, path: str, queries: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, keyword scores with the best of each query, term statistics) of queries (query_id, query) with vectors (query_id, vec) on a stored index. Bodies are read
    of the rows that are ranked again alone."""
    model = lexical.load_model(spark, path, queries)
    stats = lexical.term_statistics(model, queries)
    scores = lexical.keyword_scores(model, queries, best=1)
    found = ranking.candidates(lexical.absolute_scores(lexical.keyword_scores(model, queries, stats), stats), ranking.semantic_scores(spark.read.parquet(f"{path}/vectors"), vectors))
    docs = spark.read.parquet(f"{path}/documents").select("corpus", "name", "file", "body", "tier", "in_memory_index", "modified", "n_chunks")
    rows = ranking.fuse(found, docs, spark.read.parquet(f"{path}/reference"), F.lit(AS_OF).cast("timestamp"), matched=stats.select("query_id", "corpus", "present"))
    return rows, scores, stats


def _fused(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = documents(spark, sf).withColumn("n_chunks", T.chunk_count("body"))
    queries = asked(spark, sf)
    model = lexical.build_model(docs, queries)
    stats = lexical.term_statistics(model, queries)
    scores = lexical.keyword_scores(model, queries, best=1)
    found = ranking.candidates(lexical.absolute_scores(lexical.keyword_scores(model, queries, stats), stats), ranking.semantic_scores(_vectors(spark, sf), _query_vectors(spark, sf)))
    rows = ranking.fuse(found, docs.select("corpus", "name", "file", "body", "tier", "in_memory_index", "modified", "n_chunks"), ranking.reference_chunks(docs), F.lit(AS_OF).cast("timestamp"), matched=stats.select("query_id", "corpus", "present"))
    return rows, scores, stats


SQL_CHUNKS = f"CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= {K.CHUNK_WORDS} THEN 1 ELSE 1 + ceil((len(w) - {K.CHUNK_WORDS}) / {K.CHUNK_WORDS - K.CHUNK_OVERLAP}::DOUBLE)::BIGINT END"
SQL_FUSED = SQL_BM25 + f""", {SQL_SEM},
nc AS (SELECT name, {SQL_CHUNKS} AS n_chunks FROM (SELECT name, {SQL_WORDS.format('body')} AS w FROM docs)),
ref AS (SELECT greatest(1, list_sort(list(n_chunks))[floor({K.LONG_QUANTILE} * (count(*) - 1))::BIGINT + 1]) AS reference FROM nc),
cand AS (SELECT coalesce(k.query_id, s.query_id) AS query_id, coalesce(k.name, s.name) AS name, coalesce(keyword, 0) AS keyword, coalesce(semantic, 0) AS semantic0
  FROM kw k FULL JOIN sem s ON k.query_id = s.query_id AND k.name = s.name),
ldf AS (SELECT query_id, name, keyword, tier, in_memory_index, modified, semantic0 * CASE WHEN n_chunks <= reference THEN 1 ELSE pow(reference / n_chunks::DOUBLE, {K.LONG_ALPHA}) + (1 - pow(reference / n_chunks::DOUBLE, {K.LONG_ALPHA})) * least(1, keyword / {K.LONG_WAIVER}) END AS semantic
  FROM cand JOIN docs USING (name) JOIN nc USING (name), ref),
sc AS (SELECT *, {K.FUSE_KEYWORD} * keyword + {K.FUSE_SEMANTIC} * semantic AS base1 FROM ldf WHERE {K.FUSE_KEYWORD} * keyword + {K.FUSE_SEMANTIC} * semantic > 0),
b30 AS (SELECT query_id, name FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY base1 DESC, name) <= {K.RERANK}),
ptok AS (SELECT name, unnest(t) AS term, generate_subscripts(t, 1) AS i FROM (SELECT name, {sql_tokens('body')} AS t FROM docs WHERE name IN (SELECT name FROM b30))),
phit AS (SELECT b.query_id, p.name, p.i, p.term, q.n FROM b30 b JOIN ptok p USING (name) JOIN (SELECT query_id, term, count(*) OVER (PARTITION BY query_id) AS n FROM qs WHERE df IS NOT NULL) q ON q.query_id = b.query_id AND q.term = p.term),
pwin AS (SELECT a.query_id, a.name, a.i AS l, b.i AS r, a.n FROM phit a JOIN phit b ON a.query_id = b.query_id AND a.name = b.name AND b.i BETWEEN a.i AND a.i + 60),
psw AS (SELECT w.query_id, w.name, w.l, w.r, w.n, count(DISTINCT h.term) AS k FROM pwin w JOIN phit h ON h.query_id = w.query_id AND h.name = w.name AND h.i BETWEEN w.l AND w.r GROUP BY ALL),
phr AS (SELECT query_id, name, max(pow(k / n::DOUBLE, 2) * k / (r - l + 1)) AS phrase FROM psw WHERE n >= 2 GROUP BY query_id, name),
scp AS (SELECT sc.*, coalesce(phrase, 0) AS phrase FROM sc LEFT JOIN phr USING (query_id, name)),
scored AS (SELECT *, round((base1 + {K.FUSE_PHRASE} * greatest(0, (phrase - {K.PHRASE_FLOOR}) / (1 - {K.PHRASE_FLOOR}))) * CASE WHEN tier = 'archive' THEN {K.BOOST_ARCHIVE} WHEN in_memory_index THEN {K.BOOST_INDEXED} ELSE {K.BOOST_HOT} END
  * ({K.RECENCY_FLOOR} + (1 - {K.RECENCY_FLOOR}) * exp(-greatest(0, {DAYS.format(a="TIMESTAMP '" + AS_OF + "'", b='modified')}) / {K.RECENCY_DAYS})), 4) AS score,
  CASE WHEN keyword > 0 AND semantic > 0.35 THEN 'both' WHEN keyword > 0 THEN 'keyword' WHEN phrase > 0.2 THEN 'phrase' ELSE 'semantic' END AS provenance FROM scp),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, base1 DESC, name)::INTEGER AS rank FROM scored)"""


@query("fused_search", SQL_FUSED + "SELECT query_id, name, score, provenance, rank FROM ranked WHERE rank <= 30")
def fused_search(spark: SparkSession, sf: str) -> DataFrame:
    """V1 on all three legs: J2, C7, C9, C10, C12, C14, O1, P16, P17."""
    return _fused(spark, sf)[0].where("rank <= 30").select("query_id", "name", "score", "provenance", "rank")


@query("stored_search", SQL_FUSED + "SELECT query_id, name, score, provenance, rank FROM ranked WHERE rank <= 30")
def stored_search(spark: SparkSession, sf: str) -> DataFrame:
    """The same search on an index that was written and is read again."""
    path = scratch(spark, "store")
    store(spark, sf, path)
    return search_store(spark, path, asked(spark, sf), _query_vectors(spark, sf))[0].where("rank <= 30").select("query_id", "name", "score", "provenance", "rank")


@query("archive_capped_page", SQL_FUSED + f""", h AS (SELECT *, tier = 'archive' AND sum((tier = 'archive')::INT) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) > {int(K.LIMIT * K.ARCHIVE_SHARE)} AS held FROM ranked)
SELECT query_id, name, rank, row_number() OVER (PARTITION BY query_id ORDER BY held, rank)::INTEGER AS place FROM h QUALIFY place <= {K.LIMIT}""")
def archive_capped_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page with at most its share of archived rows."""
    return ranking.cap_archive_share(ranking.cap_per_file(_fused(spark, sf)[0])).select("query_id", "name", "rank", "place")


@query("absence_verdict", SQL_FUSED + f""", top AS (SELECT query_id, arg_min(score, rank) AS top_score, max(phrase) AS top_phrase FROM ranked GROUP BY query_id),
best AS (SELECT query_id, max(raw) AS best FROM raw GROUP BY query_id),
v AS (SELECT query_id, top_score, top_phrase, CASE WHEN ideal_full > 0 THEN coalesce(best, 0) / ideal_full ELSE 0 END AS coverage, orphan_share FROM stat LEFT JOIN top USING (query_id) LEFT JOIN best USING (query_id)),
e AS (SELECT *, top_phrase * least(1, coverage / {K.VERDICT_COVERAGE}) < {K.VERDICT_PHRASE} AS weak FROM v),
r AS (SELECT *, (orphan_share >= {K.ORPHAN_FLOOR} AND weak) OR (top_score < {K.SCORE_FLOOR} AND weak AND coverage < {K.VERDICT_COVERAGE}) AS refused FROM e)
SELECT query_id, CASE WHEN top_score IS NULL THEN 'none' WHEN refused THEN 'low' WHEN top_score >= {K.SCORE_FLOOR} THEN 'high' ELSE 'medium' END AS confidence, top_score IS NULL OR refused AS no_strong_match, round(coverage, 4) AS coverage, round(orphan_share, 4) AS orphan_share FROM r""")
def absence_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Whether anything matches at all."""
    rows, scores, stats = _fused(spark, sf)
    return ranking.verdict(rows, scores, stats).select("query_id", "confidence", "no_strong_match", "coverage", "orphan_share")


@query("graph_spread", SQL_FUSED + f""", e AS (SELECT name AS src, 'doc-' || (doc_id + 7) AS dst FROM docs UNION SELECT name, neighbour FROM (SELECT 'doc-' || t.vec_id AS name, 'doc-' || c.vec_id AS neighbour, round(list_dot_product(c.embedding::DOUBLE[], t.embedding::DOUBLE[]), 4) AS s FROM embeddings t JOIN embeddings c ON t.vec_id <> c.vec_id) QUALIFY row_number() OVER (PARTITION BY name ORDER BY s DESC, neighbour) = 1),
b AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst),
g AS (SELECT t.query_id, t.name, round(sum({K.SPREAD_ALPHA} * d.score), 4) AS gain FROM ranked d JOIN b ON b.src = d.name JOIN ranked t ON t.name = b.dst AND t.query_id = d.query_id WHERE d.rank <= {K.SPREAD_FROM} AND d.score > 0 AND t.semantic >= {K.SPREAD_GATE} GROUP BY ALL)
SELECT query_id, name, round(score + coalesce(gain, 0), 4) AS score, coalesce(gain, 0) AS gain, row_number() OVER (PARTITION BY query_id ORDER BY round(score + coalesce(gain, 0), 4) DESC, rank)::INTEGER AS rank FROM ranked LEFT JOIN g USING (query_id, name)""")
def graph_spread(spark: SparkSession, sf: str) -> DataFrame:
    """Linked rows gain from the best ones."""
    docs = documents(spark, sf)
    v = _vectors(spark, sf)
    near = ranking.nearest(v, v).where("rank = 1").select("corpus", F.col("name").alias("src"), F.col("neighbour").alias("dst"))
    edges = docs.select("corpus", F.col("name").alias("src"), F.concat(F.lit("doc-"), F.col("doc_id") + 7).alias("dst")).union(near)
    return ranking.spread(_fused(spark, sf)[0], edges).select("query_id", "name", "score", "gain", "rank")


@query("phrase_scores", SQL_BM25 + f""", hit AS (SELECT doc_id, i, term, q.query_id, q.n FROM (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, {sql_tokens('body')} AS t FROM docs)) x
  JOIN (SELECT query_id, term, count(*) OVER (PARTITION BY query_id) AS n FROM qs WHERE df IS NOT NULL AND query_id <= {len(QUERIES)}) q USING (term)),
win AS (SELECT a.query_id, a.doc_id, a.i AS l, b.i AS r, a.n FROM hit a JOIN hit b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 220),
sw AS (SELECT w.query_id, w.doc_id, w.l, w.r, w.n, count(DISTINCT h.term) AS k FROM win w JOIN hit h ON h.query_id = w.query_id AND h.doc_id = w.doc_id AND h.i BETWEEN w.l AND w.r GROUP BY ALL)
SELECT query_id, doc_id, round(max(pow(k / n::DOUBLE, 2) * k / (r - l + 1)), 4) AS phrase FROM sw WHERE n >= 2 GROUP BY query_id, doc_id""", heavy=True)
def phrase_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The densest window of a query's terms in each document; the oracle is a relational self-join."""
    docs = documents(spark, sf)
    few = asked(spark, sf).where(F.col("query_id") <= len(QUERIES))
    stats = lexical.term_statistics(lexical.build_model(docs, few), few)
    pairs = docs.select("doc_id", "body").join(small(stats.select("query_id", F.col("present").alias("terms"))))
    return lexical.phrase_scores(pairs).where("phrase > 0").select("query_id", "doc_id", F.round("phrase", 4).alias("phrase"))


LATEST = ((1, "thing stupid"), (2, "clown nonexistentword"), (3, "queeau"), (4, "zzzqqq"), (5, "thonre edation thing clown"))
SQL_LATEST = "lq(query_id, query) AS (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in LATEST) + ")"
SQL_HITS = f"""WITH {SQL_DOCS}, {SQL_LATEST}, q AS (SELECT query_id, regexp_extract_all(lower(query), '([a-z0-9][a-z0-9._-]{{2,}})', 1) AS terms FROM lq),
h AS (SELECT query_id, name, modified, terms, list_filter(terms, lambda t: contains(lower(concat_ws(chr(10), name, description, body)), t)) AS matched, lower(concat_ws(chr(10), name, description, body)) AS hay FROM docs, q),
m AS (SELECT *, len(matched) AS n, max(len(matched)) OVER (PARTITION BY query_id) AS most FROM h WHERE len(matched) > 0)"""


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return recall.term_hits(documents(spark, sf), spark.createDataFrame(list(LATEST), "query_id int, query string"))


@query("latest", SQL_HITS + "SELECT query_id, name, most < len(terms) AS relaxed, n::INTEGER AS n, row_number() OVER (PARTITION BY query_id ORDER BY modified DESC, name)::INTEGER AS rank FROM m WHERE n = most AND (most = len(terms) OR len(terms) > 1) QUALIFY rank <= 5")
def latest(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with all terms, newest first, or with the most of them."""
    return recall.latest(_hits(spark, sf)).select("query_id", "name", "relaxed", "n", "rank")


@query("term_frequencies", SQL_HITS + r", e AS (SELECT query_id, unnest(list_distinct(matched)) AS term, hay FROM m) SELECT query_id, term, count(*) AS df, count(*) FILTER (WHERE regexp_matches(hay, '\b' || term || '\b')) AS df_whole FROM e GROUP BY ALL")
def term_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold each term as a substring and as a word. (SQL counts ASCII word ends, as the data have them.)"""
    return recall.term_frequencies(_hits(spark, sf)).drop("corpus")


@query("unmatchable_terms", SQL_HITS + ", e AS (SELECT query_id, unnest(list_distinct(matched)) AS term FROM m), f AS (SELECT query_id, term, count(*) AS df FROM e GROUP BY ALL), a AS (SELECT DISTINCT query_id, unnest(terms) AS term FROM q) SELECT query_id, array_to_string(list_sort(coalesce(list(term) FILTER (WHERE df IS NULL), [])), ' ') AS unmatchable, arg_min(term, (df, term)) FILTER (WHERE df IS NOT NULL) AS rarest FROM a LEFT JOIN f USING (query_id, term) GROUP BY query_id")
def unmatchable_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Terms that no document holds, and the rarest of the others."""
    q = spark.createDataFrame(list(LATEST), "query_id int, query string")
    out = recall.unmatchable(q, recall.term_frequencies(_hits(spark, sf)), documents(spark, sf).select("corpus"))
    return out.select("query_id", F.array_join("unmatchable", " ").alias("unmatchable"), "rarest")


@query("dropped_terms", SQL_HITS + ", p AS (SELECT query_id, terms, matched, most < len(terms) AS relaxed, row_number() OVER (PARTITION BY query_id ORDER BY modified DESC, name) AS rank FROM m WHERE n = most AND (most = len(terms) OR len(terms) > 1) QUALIFY rank <= 5), t AS (SELECT query_id, relaxed, unnest(list_distinct(terms)) AS term, matched FROM p), e AS (SELECT query_id, term, bool_and(list_contains(matched, term)) AS always, bool_or(relaxed) AS relaxed FROM t GROUP BY ALL) SELECT query_id, array_to_string(list_sort(coalesce(list(term) FILTER (WHERE NOT always), [])), ' ') AS dropped, NOT bool_or(relaxed) AS premise_supported FROM e GROUP BY query_id")
def dropped_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Terms that some row of the page lacks."""
    return recall.dropped_terms(recall.latest(_hits(spark, sf))).select("query_id", F.array_join("dropped", " ").alias("dropped"), "premise_supported")


@query("label_filters", f"WITH {SQL_DOCS} SELECT name FROM (SELECT *, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE account END AS acc FROM docs) WHERE tier <> 'archive' AND (acc IS NULL OR acc IN ('fr', 'de')) AND project IN ('src0', 'src1', 'src2') AND modified BETWEEN TIMESTAMP '2022-06-01' AND TIMESTAMP '2024-05-01'")
def label_filters(spark: SparkSession, sf: str) -> DataFrame:
    """archive, accounts (null passes), projects and dates."""
    docs = documents(spark, sf).withColumn("account", F.when(F.col("doc_id") % 10 != 0, F.col("account")))
    import datetime as dt

    return ranking.allowed(docs, False, accounts=["fr", "de"], projects=["src0", "src1", "src2"], after=dt.datetime(2022, 6, 1), before=dt.datetime(2024, 5, 1)).select("name")


@query("time_factors", f"WITH {SQL_DOCS}, f AS (SELECT name, {DAYS.format(a=f'''TIMESTAMP '{AS_OF}' ''', b='modified')} AS age, {DAYS.format(a='modified', b='''TIMESTAMP '2023-01-01' ''')} AS near FROM docs) SELECT name, round({K.RECENCY_FLOOR} + {1 - K.RECENCY_FLOOR} * exp(-greatest(0, age) / {K.RECENCY_DAYS}), 4) AS recency, round({K.RECENCY_FLOOR} + {1 - K.RECENCY_FLOOR} * pow(0.5, abs(near) / {K.RECENCY_DAYS}), 4) AS near FROM f")
def time_factors(spark: SparkSession, sf: str) -> DataFrame:
    """C12, C13."""
    ts = lambda x: F.lit(x).cast("timestamp")
    return documents(spark, sf).select("name", F.round(S.recency_factor(F.col("modified"), ts(AS_OF)), 4).alias("recency"), F.round(S.near_factor(F.col("modified"), ts("2023-01-01 00:00:00")), 4).alias("near"))
