"""Scopes and their order, guards of probe arguments, provenance of queries, states of sources, and vectors as text."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import constants as K

#: Corpora of work, in the order in which answers show them.
CORPORA = ("curated", "staging", "handoff", "projects")

# Characters that no argument of a probe may hold; forms of git references.
META = r"[;&|`$<>(){}\\\n\r\"']"
GIT_REF = r"^[A-Za-z0-9._^~/-]+(\.\.\.?[A-Za-z0-9._^~/-]+)?$"
GIT_PEEL = r"\^\{(commit|tag|tree|blob|object)?\}$"
GIT_SINCE = r"^--since=[0-9T:.Z+-]+$"


def expand_scope(parts: Column, libraries: tuple[str, ...] = ()) -> Column:
    """The corpora that a list of scopes names, each once: all is every corpus of work, everything the libraries too. Corpora of work come
    first, in their order, then others as named."""
    work, every = F.array(*map(F.lit, CORPORA)), F.array(*map(F.lit, (*CORPORA, *libraries)))
    named = F.array_distinct(F.flatten(F.transform(parts, lambda s: F.when(s == "all", work).when(s == "everything", every).otherwise(F.array(s)))))
    return F.concat(F.filter(work, lambda c: F.array_contains(named, c)), F.filter(named, lambda c: ~F.array_contains(work, c)))


def refused_argument(arg: Column) -> Column:
    """Whether a probe's argument holds a character that a shell would act on."""
    return F.coalesce(arg, F.lit("")).rlike(META)


def allowed_git_ref(ref: Column) -> Column:
    """Whether a text is a git reference, a range, or a --since; only the peel mark may hold braces."""
    t = F.trim(F.coalesce(ref, F.lit("")))
    return F.regexp_replace(t, GIT_PEEL, "").rlike(GIT_REF) | F.regexp_replace(t, GIT_PEEL, "").rlike(GIT_SINCE)


def best_weak(page: DataFrame, refused: DataFrame, most: int = K.WEAK_ROWS) -> DataFrame:
    """The first rows of pages whose query was refused (query_id): neighbours, not answers."""
    return page.join(refused.select("query_id"), "query_id", "left_semi").where(F.col("rank") <= most)


def for_statistics(query: Column, read_task: Column) -> Column:
    """A query as its term statistics see it: without the verb, where it asks to read a document."""
    from corpusloom.operators.upkeep import READ_VERB

    return F.when(F.coalesce(read_task, F.lit(False)), F.regexp_replace(query, READ_VERB, "")).otherwise(query)


def last_ingest(stamps: DataFrame) -> DataFrame:
    """at: the newest of all stamps (at: milliseconds as text or number), null without a sound one."""
    at = F.col("at").cast("string").try_cast("double")
    sound = F.when(~F.isnan(at) & (F.abs(at) < float("inf")) & (at > 0), at)
    return stamps.agg(F.timestamp_millis(F.max(sound).cast("long")).alias("at"))


def source_stats(files: DataFrame) -> DataFrame:
    """corpus, files, newest: how many files each corpus has, and when the newest was changed. files: corpus, mtime."""
    return files.groupBy("corpus").agg(F.count("*").alias("files"), F.max("mtime").alias("newest"))


def latest_scope(asked: Column, staging_docs: Column) -> Column:
    """struct(scope, fallback): where a question about the latest looks: as asked, else staging, else curated if staging is empty."""
    empty = F.coalesce(staging_docs, F.lit(0)) == 0
    return F.struct(F.coalesce(asked, F.when(empty, "curated").otherwise("staging")).alias("scope"), (asked.isNull() & empty).alias("fallback"))


def with_provenance(log: DataFrame, run_id: str | None, source: str | None = None, serving: bool = False) -> DataFrame:
    """log with source (as set, else live where a server asks, else unknown) and run_id, the writer's own."""
    return log.withColumns({"source": F.lit(source or ("live" if serving else "unknown")), "run_id": F.lit(run_id).cast("string")})


def encode_vector(vec: Column | str) -> Column:
    """A vector as base64 of its float32 values, little-endian; null stays null."""

    @F.pandas_udf("string")
    def encoded(vecs: pd.Series) -> pd.Series:
        return vecs.map(lambda v: None if v is None else base64.b64encode(np.asarray(v, dtype="<f4").tobytes()).decode())

    return encoded(vec)


def decode_vector(text: Column, dimensions: int) -> Column:
    """The vector of encode_vector's text; a job fails on a text of another length, since a short vector would score wrongly."""

    @F.pandas_udf("array<float>")
    def decoded(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            raw = base64.b64decode(t)
            if len(raw) != 4 * dimensions:
                raise ValueError(f"a vector of {len(raw)} bytes, not of {dimensions} values")
            return np.frombuffer(raw, dtype="<f4")

        return texts.map(one)

    return decoded(text)


def embedded(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], dimensions: int, prefix: str = "", batch: int = 16) -> DataFrame:
    """rows (text) with vec: what `embed` gives for `batch` texts at a time, prefix before each (for queries); null for vectors of a wrong
    length, which turns the dense leg off for them. The model comes from the caller."""

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made: list = []
            for at in range(0, len(pdf), batch):
                made += embed([prefix + (t or "") for t in pdf["text"][at : at + batch]])
            pdf["vec"] = [v if v is not None and len(v) == dimensions else None for v in made]
            yield pdf

    return rows.mapInPandas(over, ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), "vec array<float>"]))
