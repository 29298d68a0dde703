"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import html_text, line_dedup, mixing, near_dedup, pieces, quality, token_counts, topk, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in 10 documents or more go; doc_id, n_lines, n_dropped, kept_sha256."""

    def digest(batches):
        for b in batches:
            kept = [line_dedup.kept_text(*x) for x in zip(*(b.column(c).to_pylist() for c in ("text", "n_covered", "bitmap")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([n for _, n in kept], pa.int64()), b.column("n_dropped"), pa.array([hashlib.sha256(t.encode()).hexdigest() for t, _ in kept], pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    rows = line_dedup.with_bitmaps(_table(spark, sf_dir, "documents").select("doc_id", "text"), 10)
    rows = rows.select("doc_id", "text", "n_covered", F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), "bitmap")
    return rows.mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, dense_rank() OVER (ORDER BY doc_id, text) AS own, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT r, own, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM d),
k AS (SELECT r, own, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
hot AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT own) >= 10),
m AS (SELECT r, pos, line, key IN (SELECT key FROM hot) AS gone FROM k),
g AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN g USING (r)
"""


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, with its source's size and target."""
    mix = mixing.Mix(_table(spark, sf_dir, "documents"))
    known = spark.createDataFrame([(s.name, s.size, s.target) for s in mix.sources], "name string, source_size long, target double")
    rows = mix.taken()
    return rows.join(F.broadcast(known), rows["source"].eqNullSafe(known["name"])).select("doc_id", "size", "source_size", "target", "taken")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's counts, base verdict and the verdict with the limits on repeated substrings."""
    return quality.judge(_table(spark, sf_dir, "documents")).drop("longest_repeat", "n_long_repeat_words")


def _windows(name: str, size: int) -> str:
    """Words that lie in windows of `size` words found twice or more in their row."""
    return f"""
{name}_w AS (SELECT r, i, array_to_string(w[i:i + {size - 1}], chr(32)) AS g FROM (SELECT r, w, unnest(range(1, len(w) - {size - 2})) AS i FROM t WHERE len(w) >= {size})),
{name}_r AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM {name}_w) WHERE n > 1),
{name} AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + {size})) AS j FROM {name}_r) GROUP BY r)"""


OP3_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D ]+') AS w FROM documents),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x09-\x0D ]') GROUP BY r),{_windows("short", 5)},{_windows("long", 10)},{_windows("longest", 51)},
c AS (SELECT t.r, doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x09-\x0D ]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(short.n, 0)::BIGINT AS n_repeat_words,
  coalesce(long.n, 0) AS covered, longest.r IS NOT NULL AS too_long
  FROM t LEFT JOIN dup USING (r) LEFT JOIN short USING (r) LEFT JOIN long USING (r) LEFT JOIN longest USING (r)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * covered <= 20 * n_words AND NOT too_long AS kept FROM v
"""


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's host, path, the place rule that fits, and the verdict."""
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def _op4_sql() -> str:
    """Hosts by their ends, paths by their beginnings, words by their places among the parts of a url: none of the engine's patterns."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    places = ", ".join(f"({quote(r.name.split('/', 1)[0])}, {quote('/' + r.name.split('/', 1)[1])}, {quote(r.verdict)})" for r in url_filter.PLACES)
    words = ", ".join(f"([{', '.join(map(quote, r.tokens))}], {quote(r.verdict)})" for r in url_filter.WORDS)
    lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return rf"""
WITH places(h, p, verdict) AS (VALUES {places}), words(w, verdict) AS (VALUES {words}),
u AS (SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS spot FROM pages),
v AS (SELECT r, page_id, url, CASE WHEN spot > 0 THEN string_split(string_split(substr(url, spot + 3), '?')[1], '#')[1] ELSE '' END AS rest FROM u),
p AS (SELECT r, page_id, string_split_regex(translate(url, {lower}), '[^a-z0-9]') AS parts, translate(string_split(rest, '/')[1], {lower}) AS host, substr(rest, length(string_split(rest, '/')[1]) + 1) AS path FROM v),
b AS (SELECT r, arg_max(h || places.p, (length(h || places.p), h || places.p)) AS rule, arg_max(verdict, (length(h || places.p), h || places.p)) AS verdict FROM p, places WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, places.p) GROUP BY r),
f AS (SELECT r, words.verdict FROM p, words WHERE len(list_filter(range(1, len(parts) - len(w) + 2), lambda i: parts[i:i + len(w) - 1] = w)) > 0),
s AS (SELECT r, bool_or(verdict = 'block') AND NOT bool_or(verdict = 'allow') AS blocked FROM f GROUP BY r)
SELECT page_id, host, path, rule, coalesce(b.verdict, CASE WHEN s.blocked THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN b USING (r) LEFT JOIN s USING (r)
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every whole text with a model fitted on the labelled rows that aren't held out."""
    documents = _table(spark, sf_dir, "documents")
    model = toxicity.train(documents, _table(spark, sf_dir, "labels"))
    return toxicity.score(documents, model).select("doc_id", (toxicity.held_out_remainder() == 0).alias("held_out"), "score", "predicted")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 2-word shingles have a Jaccard similarity of 0.8 or more."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), size=2, percent=80)


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x09-\x0D ]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM d),
n AS (SELECT r, doc_id, len(g) AS n FROM s),
e AS (SELECT r, unnest(g) AS g FROM s WHERE doc_id IS NOT NULL),
c AS (SELECT a.r AS x, b.r AS y, count(*) AS shared FROM e a JOIN e b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n p ON p.r = x JOIN n q ON q.r = y WHERE 100 * shared >= 80 * (p.n + q.n - shared) UNION SELECT a.r, b.r FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.r < b.r),
u AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT r AS a, r AS b FROM d UNION SELECT r.a, u.y FROM r JOIN u ON r.b = u.x),
m AS (SELECT a, min(doc_id) AS component_id FROM r JOIN d ON r.b = d.r GROUP BY a)
SELECT doc_id, n::BIGINT AS n_shingles, component_id, coalesce(doc_id = component_id, TRUE) AS kept FROM n JOIN m ON a = r
"""


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text under the word-level BPE vocabulary."""
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and what they decode to, as counts and digests."""
    return pieces.digests(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all vectors for each vector whose id is divisible by 50."""
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.search(vectors.where("vec_id % 50 = 0"), vectors, 5)


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_source_mixing": op2_source_mixing,
        "op3_quality_rules": op3_quality_rules,
        "op4_url_filter": op4_url_filter,
        "op5_toxicity": op5_toxicity,
        "op6_html_extraction": op6_html_extraction,
        "op7_minhash_near_dedup": op7_minhash_near_dedup,
        "op8_token_counts": op8_token_counts,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_exact_top_k": op10_exact_top_k,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op3_quality_rules": OP3_SQL, "op4_url_filter": _op4_sql(), "op7_minhash_near_dedup": OP7_SQL, "op10_exact_top_k": OP10_SQL}
