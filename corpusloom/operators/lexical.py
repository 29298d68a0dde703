"""The keyword leg: a BM25F model of a corpus, query term statistics, scores, and phrase windows.

Statistics are taken over whole corpora, before any filter of a query, and never shared between corpora. Queries are rows, so
one job answers many of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from corpusloom import constants as K
from corpusloom.functions.scoring import absolute_keyword, idf
from corpusloom.functions.spans import Terms, positions, runs, snippet_around
from corpusloom.functions.text import tokenize
from corpusloom.operators.matches import COUNTS, SCORES, Asked, counter, held_by, scorer
from corpusloom.operators.sizes import small


#: Buckets of a stored model's terms.
BUCKETS = 64
#: Asked terms up to which a model is built for these terms alone.
ASKED = 1000


@dataclass(frozen=True)
class Model:
    """postings: corpus, term, name, file, w (weights over length norms); df: corpus, term, df (distinct files); stats: corpus, n_docs,
    average lengths.

    counted: the persisted tokens that all three derive from, so that a corpus is tokenised once. release() gives them up. With asked terms
    counted holds how often each document has them, and there are no other postings; fields: (group, weight) of the fields counted.
    """

    postings: DataFrame | None
    df: DataFrame
    stats: DataFrame
    counted: DataFrame | None = None
    asked: tuple[str, ...] | None = None
    fields: tuple[tuple[int, float], ...] = ()

    def release(self) -> None:
        if self.counted is not None:
            self.counted.unpersist()


def save_model(model: Model, path: str) -> None:
    """Writes a model's tables under path. Postings lie by hash of their term, so that a search reads the buckets of its terms alone; they are
    dealt out by ranges of (bucket, term, name), so that a frequent term is spread over tasks."""
    bucketed = model.postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
    bucketed.repartitionByRange("bucket", "term", "name").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    model.df.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/df")
    model.stats.write.mode("overwrite").parquet(f"{path}/stats")
    model.release()


def load_model(spark: SparkSession, path: str, queries: DataFrame | None = None) -> Model:
    """A stored model. With queries of few terms only their buckets and terms are read: both are filters that reach the scan."""
    tables = {t: spark.read.parquet(f"{path}/{t}") for t in ("postings", "df", "stats")}
    if queries is not None:
        asked = query_terms(queries).select("term", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket")).distinct().limit(ASKED + 1).collect()
        if len(asked) <= ASKED:
            for t in ("postings", "df"):
                tables[t] = tables[t].where(F.col("bucket").isin(*{r["bucket"] for r in asked}) & F.col("term").isin(*{r["term"] for r in asked})) if asked else tables[t].limit(0)
    return Model(tables["postings"].drop("bucket"), tables["df"].drop("bucket"), tables["stats"])


def _fields(docs: DataFrame) -> list[tuple[int, float, Column]]:
    """(group, weight, text) of the fields: title 0, headings and key facts 1, body 2."""
    out = [(0, K.NAME_WEIGHT, F.concat_ws(" ", F.regexp_replace("name", "[-_]", " "), "name")), (0, K.DESCRIPTION_WEIGHT, F.col("description")), (2, K.BODY_WEIGHT, F.col("body"))]
    for name, weight in (("headings", K.HEADING_WEIGHT), ("key_facts", K.FACT_WEIGHT)):
        if name in docs.columns:
            out.append((1, weight, F.array_join(name, " \n ")))
    return out


def _averages(counted: DataFrame) -> DataFrame:
    """corpus, n_docs, average lengths of the groups."""
    sums = counted.groupBy("corpus").agg(F.count("*").alias("n"), F.count_distinct("file").alias("n_docs"), *(F.sum(f"len{g}").alias(f"len{g}") for g in range(3)))
    return sums.select("corpus", "n_docs", *(F.when(F.col(f"len{g}") > 0, F.col(f"len{g}") / F.col("n")).otherwise(1.0).alias(f"avg{g}") for g in range(3)))


def build_model(docs: DataFrame, queries: DataFrame | None = None) -> Model:
    """docs: corpus, name, description, body, and optionally file, headings, key_facts.

    With queries, only their terms are counted, document by document and without postings; statistics are of the whole corpora either way. A
    corpus in which names or files repeat gets postings: a term's weight in a document is a sum over its tokens, so one aggregation makes them.
    """
    file = F.coalesce("file", "name") if "file" in docs.columns else F.col("name")
    fields = _fields(docs)
    if queries is not None:
        asked = tuple(sorted(r[0] for r in query_terms(queries).select("term").distinct().collect()))
        shared = docs.sparkSession.sparkContext.broadcast(list(asked))
        texts = docs.select(F.col("corpus").cast("string").alias("corpus"), F.col("name").cast("string").alias("name"), file.cast("string").alias("file"), *(text.alias(f"t{i}") for i, (_, _, text) in enumerate(fields)))
        weights = [(g, w) for g, w, _ in fields]
        counted = texts.mapInArrow(counter(shared, weights), COUNTS).persist()
        alone = counted.select("corpus", "name").union(counted.select("corpus", F.concat(F.lit("file "), "file"))) if "file" in docs.columns else counted.select("corpus", "name")
        if alone.groupBy("corpus", "name").count().where("count > 1").isEmpty():
            held = counted.select("corpus", "ids").mapInArrow(held_by, "corpus string, id int, n long").groupBy("corpus", "id").agg(F.sum("n").alias("n")).collect()
            df = docs.sparkSession.createDataFrame([(r["corpus"], asked[r["id"]], r["n"]) for r in held], "corpus string, term string, df long")
            return Model(None, df, _averages(counted), counted, asked, tuple(weights))
        counted.unpersist()
    rows = docs.select("corpus", "name", file.alias("file"), *(tokenize(text).alias(f"t{i}") for i, (_, _, text) in enumerate(fields)))
    length = lambda g: sum((F.size(f"t{i}") * w for i, (group, w, _) in enumerate(fields) if group == g), F.lit(0.0))
    lengths = [length(g).alias(f"len{g}") for g in range(3)]
    counted = rows.select("corpus", "name", "file", *lengths, *(F.col(f"t{i}").alias(f"k{i}") for i in range(len(fields)))).persist()
    stats = _averages(counted)
    share = {g: 1 / (1 - K.B + K.B * F.col(f"len{g}") / F.col(f"avg{g}")) for g in range(3)}

    def weigh(i: int, weight: Column) -> Column:
        return F.transform(f"k{i}", lambda t: F.struct(t.alias("term"), weight.alias("x")))

    weighed = F.flatten(F.array(*(weigh(i, F.col(f"w{g}") * w) for i, (g, w, _) in enumerate(fields))))
    normed = counted.join(small(stats), "corpus").withColumns({f"w{g}": share[g] for g in range(3)})
    postings = normed.select("corpus", "name", "file", F.inline(weighed)).groupBy("corpus", "term", "name", "file").agg(F.sum("x").alias("w"))
    return Model(postings, postings.groupBy("corpus", "term").agg(F.count_distinct("file").alias("df")), stats, counted)


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term: each query's distinct terms."""
    return queries.select("query_id", F.explode(F.array_distinct(tokenize("query"))).alias("term"))


def keyword_scores(model: Model, queries: DataFrame, statistics: DataFrame | None = None, best: int | None = None, digits: int | None = None) -> DataFrame:
    """query_id, corpus, name, raw: BM25F scores of documents with at least one term of the query.

    best: of each query and corpus, only so many rows of each task, by score (rounded to digits) and name: all that can be among so many
    of the whole. statistics (of term_statistics): rows that absolute_scores would leave out may be missing.
    """
    sc, kind = queries.sparkSession.sparkContext, queries.schema["query_id"].dataType
    of: dict = {}
    for r in queries.select("query_id", F.array_distinct(tokenize("query")).alias("terms")).collect():
        of.setdefault(r["query_id"], []).extend(r["terms"])
    terms = list(model.asked) if model.asked is not None else sorted({t for q in of.values() for t in q})
    place = {t: n for n, t in enumerate(terms)}
    n_docs = {r["corpus"]: r for r in model.stats.collect()}
    idfs = {c: np.zeros(len(terms) + 1) for c in n_docs}
    known = model.df if model.asked is not None else model.df.join(small(queries.sparkSession.createDataFrame([(t,) for t in terms], "term string"), 1_000_000), "term")
    for r in known.select("corpus", "term", "df").collect():
        n = n_docs[r["corpus"]]["n_docs"]
        idfs[r["corpus"]][place[r["term"]]] = math.log(1 + (n - r["df"] + 0.5) / (r["df"] + 0.5))
    floors: dict = {}
    if statistics is not None:
        number = {q: n for n, q in enumerate(of)}
        floors = {c: np.full(len(of), np.inf) for c in n_docs}
        for r in statistics.select("query_id", "corpus", "ideal").collect():
            if r["ideal"] > 0:
                floors[r["corpus"]][number[r["query_id"]]] = min(K.KEYWORD_FLOOR, K.COVERAGE_FLOOR * r["ideal"]) - 1e-6
    asked = Asked(terms, idfs, {c: tuple(r[f"avg{g}"] for g in range(3)) if model.asked is not None else () for c, r in n_docs.items()}, pa.array(list(of), to_arrow_type(kind)), [[place[t] for t in q if t in place] for q in of.values()], list(model.fields), floors, best, digits)
    schema = StructType([StructField("query_id", kind), *StructType.fromDDL(SCORES).fields])
    if model.asked is not None:
        return model.counted.mapInArrow(scorer(sc.broadcast(asked), True), schema)
    hits = model.postings.join(small(queries.sparkSession.createDataFrame([(t,) for t in terms], "term string"), 1_000_000), "term")
    lists = hits.groupBy("corpus", "name").agg(F.array_sort(F.collect_list(F.struct("term", "file", "w"))).alias("x"))
    return lists.select("corpus", "name", F.col("x.term").alias("terms"), F.col("x.w").alias("w")).mapInArrow(scorer(sc.broadcast(asked), False), schema)


def term_statistics(model: Model, queries: DataFrame) -> DataFrame:
    """query_id, corpus, ideal, ideal_full, orphan_share, present, absent, orphans (sorted): one row for each query and corpus."""
    terms = query_terms(queries)
    grid = terms.join(small(model.stats.select("corpus", "n_docs")))  # a row for each corpus, not for each document
    known = grid.join(model.df, ["corpus", "term"], "left")
    both = F.col("df").isNotNull()
    every = known.groupBy("query_id", "corpus", "n_docs").agg(
        F.sum(F.when(both, idf(F.col("n_docs"), F.col("df"))).otherwise(0.0)).alias("found"),
        F.array_sort(F.collect_list(F.when(both, F.col("term")))).alias("present"),
        F.array_sort(F.collect_list(F.when(~both, F.col("term")))).alias("absent"),
    )
    missing = idf(F.col("n_docs"), F.lit(0))
    orphans = F.filter("absent", lambda t: ~F.exists("present", lambda o: F.contains(t, o) | F.contains(o, t)))
    out = every.withColumn("orphans", orphans).withColumn("ideal", F.col("found") * (K.K1 + 1)).withColumn("ideal_full", F.col("ideal") + F.size("absent") * missing * (K.K1 + 1))
    share = F.when(F.col("ideal_full") > 0, F.size("orphans") * missing * (K.K1 + 1) / F.col("ideal_full")).otherwise(0.0)
    return out.withColumn("orphan_share", share).select("query_id", "corpus", "ideal", "ideal_full", "orphan_share", "present", "absent", "orphans")


def absolute_scores(scores: DataFrame, statistics: DataFrame) -> DataFrame:
    """query_id, corpus, name, raw, keyword: scores on a scale that compares across queries; rows without evidence go."""
    return scores.join(statistics.select("query_id", "corpus", "ideal"), ["query_id", "corpus"]).withColumn("keyword", absolute_keyword(F.col("raw"), F.col("ideal"))).where("keyword is not null").drop("ideal")


def relative_scores(scores: DataFrame, best: DataFrame | None = None) -> DataFrame:
    """keyword: the score by the query's best one in its corpus, for rankings without vectors. best: rows that hold the best of each query, if known."""
    top = (scores if best is None else best).groupBy("query_id", "corpus").agg(F.max("raw").alias("top"))
    rows = scores.join(small(top, 100_000), ["query_id", "corpus"])
    return rows.withColumn("keyword", F.when(F.col("top") > 0, F.col("raw") / F.col("top"))).where("keyword is not null").drop("top")


def best_window(tokens: list[str], wanted: set[str]) -> tuple[float, float, int, int, int, int] | None:
    """(phrase, coverage, distinct, span, first token, last token) of the window with the most wanted terms packed closest.

    phrase = (distinct / wanted)^2 * distinct / span. Null for fewer than two wanted terms or no hit. Of equals the window with the
    smallest right end wins, then the one with the nearest left end.
    """
    if len(wanted) < 2:
        return None
    at = [i for i, t in enumerate(tokens) if t in wanted]
    best: tuple | None = None
    reach = min(len(at), 4 * len(wanted) + 24)
    for r, right in enumerate(at):
        seen: set[str] = set()
        for left in reversed(at[max(0, r - reach + 1) : r + 1]):
            seen.add(tokens[left])
            span, n = right - left + 1, len(seen)
            score = (n / len(wanted)) ** 2 * n / span
            if best is None or score > best[0]:
                best = (score, n / len(wanted), n, span, left, right)
            if len(wanted) / span <= best[0]:
                break
    return best


def phrase_scores(pairs: DataFrame) -> DataFrame:
    """pairs (body, terms: array of matched terms, and other columns) with phrase (0 if there is no window) and its token span."""

    def over(batches):
        every = Terms()
        for pdf in batches:
            found, last, tokens = [], None, []
            for body, terms in zip(pdf["body"], pdf["terms"], strict=True):
                if body is not last:
                    if body != last:
                        tokens = [t for run in runs(body) for t in every[run]]
                    last = body
                found.append(best_window(tokens, set(terms)))
            pdf = pdf.drop(columns="body")
            pdf["phrase"] = np.array([f[0] if f else 0.0 for f in found])
            pdf["first_token"] = pd.array([f[4] if f else None for f in found], dtype="Int32")
            pdf["last_token"] = pd.array([f[5] if f else None for f in found], dtype="Int32")
            yield pdf

    schema = ", ".join(f"`{c}` {t}" for c, t in pairs.dtypes if c != "body") + ", phrase double, first_token int, last_token int"
    return pairs.mapInPandas(over, schema)


def phrase_snippets(pairs: DataFrame) -> DataFrame:
    """pairs (body, terms, and other columns) with snippet: the text around the densest window of the terms, null without one.

    For the rows of a page, after ranking: bodies are read whole in Python.
    """

    def around(body: str | None, terms) -> str | None:
        at = positions(body)
        found = best_window([t for t, _, _ in at], set(terms))
        return snippet_around(body, at[found[4]][1], at[found[5]][2]) if found else None

    def over(batches):
        for pdf in batches:
            pdf["snippet"] = [around(b, t) for b, t in zip(pdf["body"], pdf["terms"], strict=True)]
            yield pdf.drop(columns="body")

    schema = ", ".join(f"`{c}` {t}" for c, t in pairs.dtypes if c != "body") + ", snippet string"
    return pairs.mapInPandas(over, schema)
