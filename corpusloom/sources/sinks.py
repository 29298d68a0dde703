"""Sinks: guarded, atomic index tables, append-only logs, caches and file writers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom import constants as K


class Refused(ValueError):
    """A write that would harm what is there."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.exists(p)


def publish(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Writes df beside path and puts it in its place by renaming. Readers never see a part of a table; between the two renames there is none
    at path for a moment, and one that failed is put back."""
    spark = df.sparkSession
    fs, target, make = _fs(spark, path)
    mark = uuid.uuid4().hex[:12]
    staged, old = make(f"{path}.new-{mark}"), make(f"{path}.old-{mark}")
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(staged.toString())
    if fs.exists(target):
        fs.rename(target, old)
    if not fs.rename(staged, target):
        fs.rename(old, target)
        raise OSError(f"can't publish {path}")
    fs.delete(old, True)


def write_index(docs: DataFrame, chunks: DataFrame, path: str, roots: int, dimensions: int = K.DIMENSIONS, built_at: str | None = None) -> dict:
    """Publishes documents, chunks and a one-row header by corpus; {before, after, dropped_half}.

    Refused: no roots; no documents where there were some; chunks with a vector of a wrong length, or with none where the index has
    vectors. dropped_half: more than half of the documents are gone, which is only reported.
    """
    spark = docs.sparkSession
    if roots < 1:
        raise Refused("no roots")
    before = header(spark, path)
    n = docs.count()
    if n == 0 and before and before["docs"] > 0:
        raise Refused(f"0 documents would replace {before['docs']}")
    sizes = chunks.agg(F.count_if(F.col("vec").isNotNull() & (F.size("vec") != dimensions)).alias("bad"), F.count("vec").alias("dense"), F.count("*").alias("all")).first()
    if sizes["bad"]:
        raise Refused(f"{sizes['bad']} vectors don't have {dimensions} dimensions")
    if before and before["dense"] and sizes["all"] and not sizes["dense"]:
        raise Refused("an index without vectors would replace one with vectors")
    gone = None
    if before:
        gone = spark.read.parquet(f"{path}/docs").select("corpus", "name").join(docs, ["corpus", "name"], "left_anti")
        gone = gone.select("corpus", "name", F.lit(built_at).cast("string").alias("at"), F.lit(before["docs"]).alias("docs_before"), F.lit(n).alias("docs_after"))
        if not gone.isEmpty():
            gone.write.mode("append").json(f"{path}.vanished")
    mark = f"{path}.build-{uuid.uuid4().hex[:12]}"
    docs.write.partitionBy("corpus").parquet(f"{mark}/docs")
    chunks.write.partitionBy("corpus").parquet(f"{mark}/chunks")
    spark.createDataFrame([(1, dimensions, n, sizes["dense"] > 0, built_at)], "version int, dimensions int, docs long, dense boolean, built_at string").coalesce(1).write.parquet(f"{mark}/header")
    fs, target, make = _fs(spark, path)
    old = make(f"{mark}.old")
    if fs.exists(target):
        fs.rename(target, old)
    if not fs.rename(make(mark), target):
        fs.rename(old, target)
        raise OSError(f"can't publish {path}")
    fs.delete(old, True)
    return {"before": before["docs"] if before else 0, "after": n, "dropped_half": bool(before and n * 2 < before["docs"])}


def header(spark: SparkSession, path: str) -> dict | None:
    """The one-row header of an index, without reading its tables; None if there is no index."""
    if not exists(spark, f"{path}/header"):
        return None
    return spark.read.parquet(f"{path}/header").first().asDict()


def read_index(spark: SparkSession, path: str, dimensions: int = K.DIMENSIONS) -> tuple[DataFrame, DataFrame, list[str]]:
    """(documents, chunks, problems). A header that doesn't fit turns the vectors off; it never fails."""
    h = header(spark, path)
    problems = []
    if h is None:
        problems.append("no header")
    else:
        if h["version"] != 1:
            problems.append(f"version {h['version']}")
        if h["dimensions"] != dimensions:
            problems.append(f"{h['dimensions']} dimensions, not {dimensions}")
    docs, chunks = spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/chunks")
    return docs, chunks.withColumn("vec", F.lit(None).cast("array<float>")) if problems else chunks, problems


def append_log(rows: DataFrame, path: str, roll_bytes: int | None = None) -> None:
    """Appends JSON lines. With roll_bytes a log of more bytes first becomes the one kept older generation, and read_log has it no more; without,
    every row stays, however long the log gets."""
    fs, p, make = _fs(rows.sparkSession, path)
    if roll_bytes is not None and fs.exists(p) and fs.getContentSummary(p).getLength() > roll_bytes:
        older = make(f"{path}.1")
        fs.delete(older, True)
        fs.rename(p, older)
    rows.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON log; torn and malformed lines are left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def flush_vectors(computed: DataFrame, path: str, contract: str) -> None:
    """Adds vectors (key, vec) that a cache of the contract lacks."""
    from corpusloom.operators.upkeep import new_vectors

    spark = computed.sparkSession
    if exists(spark, path):
        computed = new_vectors(computed, spark.read.parquet(path).where(F.col("contract") == contract))
    computed.select("key", "vec", F.lit(contract).alias("contract")).write.mode("append").partitionBy("contract").parquet(path)


def overwrite_verdicts(verdicts: DataFrame, path: str) -> None:
    """Publishes probe verdicts; an empty sweep doesn't replace others."""
    spark = verdicts.sparkSession
    if verdicts.isEmpty() and exists(spark, path) and not spark.read.parquet(path).isEmpty():
        raise Refused("no probes, but there are verdicts")
    publish(verdicts, path)


def rewrite_metadata(before: DataFrame, after: DataFrame) -> DataFrame:
    """after, row by row, if no body differs from before's; a changed body fails the job."""
    old = before.select("corpus", "name", F.sha2("body", 256).alias("_old"))
    rows = after.join(old, ["corpus", "name"], "left")
    same = F.col("_old").isNull() | (F.col("_old") == F.sha2("body", 256))
    return rows.withColumn("body", F.when(same, F.col("body")).otherwise(F.raise_error(F.concat(F.lit("the body would change: "), "name")).cast("string"))).drop("_old")


def newest_snapshots(snapshots: DataFrame, keep: int | None = None) -> DataFrame:
    """The newest `keep` snapshots (name, at) of each document: 5 for none or 0, 1 for negative numbers."""
    n = 5 if not keep else max(1, keep)
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("at")))
    return snapshots.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")


def import_names(items: DataFrame, taken: DataFrame) -> DataFrame:
    """file_name for each item (name): its own, or with -2, -3, ... after those taken (name) and equal ones before it."""
    base = taken.select(F.regexp_replace("name", r"-\d+$", "").alias("name")).groupBy("name").agg(F.count("*").alias("there"))
    n = F.row_number().over(Window.partitionBy("name").orderBy("key"))
    rows = items.join(base, "name", "left").withColumn("_n", F.coalesce("there", F.lit(0)) + n)
    return rows.withColumn("file_name", F.when(F.col("_n") > 1, F.concat_ws("-", "name", F.col("_n").cast("string"))).otherwise(F.col("name"))).drop("_n", "there")


def replace_category(current: DataFrame, incoming: DataFrame, at: Column) -> DataFrame:
    """current documents of the incoming categories become archived, with the time they were replaced at, beside the incoming ones."""
    cats = incoming.select("category").distinct().withColumn("_hit", F.lit(True))
    old = current.join(cats, "category", "left")
    gone = F.coalesce("_hit", F.lit(False)) & F.col("superseded_at").isNull()
    old = old.withColumn("tier", F.when(gone, "archive").otherwise(F.col("tier"))).withColumn("superseded_at", F.when(gone, at).otherwise(F.col("superseded_at"))).drop("_hit")
    return old.unionByName(incoming.withColumn("superseded_at", F.lit(None).cast("timestamp")), allowMissingColumns=True)


def held_scrub(rows: DataFrame, column: str = "body") -> DataFrame:
    """rows with secrets redacted; a row in which one is still found fails the job."""
    from corpusloom.functions.text import redact, secret_hits

    clean = redact(column)
    left = F.filter(secret_hits(clean), lambda c: c != "assignment")
    return rows.withColumn(column, F.when(F.size(left) == 0, clean).otherwise(F.raise_error(F.lit("a secret is left")).cast("string")))
