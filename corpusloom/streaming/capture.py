"""Incremental capture with Structured Streaming: transcripts to exchanges, upserts, and retries in a log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom import constants as K
from corpusloom.sources.sinks import exists, publish

TURNS = "session_id string, line_no long, kind string, text string, ts timestamp"
_OUT = "session_id string, exchange long, ask string, reply string, ts timestamp, closed_by string"
_STATE = "exchange long, ask string, reply string, ts timestamp, line_no long"


def turn_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Turns of JSON files as they arrive."""
    return spark.readStream.schema(TURNS).option("maxFilesPerTrigger", max_files).json(path)


def _close(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    session = key[0]
    n, ask, reply, ts, at = state.get if state.exists else (0, None, "", None, -1)
    out = []
    if state.hasTimedOut:
        if ask is not None:
            out.append((session, n, ask, reply, ts, "timeout"))
        state.remove()
    else:
        rows = pd.concat(list(batches)).sort_values("line_no")
        for line, kind, text, when in rows[["line_no", "kind", "text", "ts"]].itertuples(index=False):
            if line <= at:
                continue  # seen before
            at = int(line)
            if kind == "human":
                if ask is not None:
                    out.append((session, n, ask, reply, ts, "next ask"))
                n, ask, reply, ts = n + 1, text, "", None if pd.isna(when) else when.to_pydatetime()
            elif kind == "assistant" and ask is not None:
                reply = f"{reply}\n{text}" if reply else text
        state.update((n, ask, reply, ts, at))
        last = rows["ts"].max()
        if not pd.isna(last):
            state.setTimeoutTimestamp(max(int(last.timestamp() * 1000), state.getCurrentWatermarkMs() + 1) + 1)
    yield pd.DataFrame(out, columns=["session_id", "exchange", "ask", "reply", "ts", "closed_by"])


def closed_exchanges(turns: DataFrame, idle: str = "10 minutes") -> DataFrame:
    """Each exchange once: when the next human turn of its session arrives, or when event time has passed it by `idle`."""
    stream = turns.withWatermark("ts", idle)
    return stream.groupBy("session_id").applyInPandasWithState(_close, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def upsert(batch: DataFrame, path: str, key: str, order: str) -> None:
    """Publishes the table at path with the batch's rows in place of those of equal key; the latest of equal keys wins."""
    spark = batch.sparkSession
    rows = batch.withColumn("_new", F.lit(1))
    if exists(spark, path):
        rows = spark.read.parquet(path).withColumn("_new", F.lit(0)).unionByName(rows)
    best = rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in batch.columns if c != key)), F.struct("_new", order)).alias("v"))
    publish(best.select(key, "v.*"), path)


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, key: str, order: str):
    """Starts a query that upserts each micro-batch, once for what is there."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: upsert(df, path, key, order)).trigger(availableNow=True).start()


def retry_stream(failed: DataFrame, later: DataFrame, seconds: int = K.RETRY_SECONDS) -> DataFrame:
    """Pairs of a failed row and a later one of the same caller within `seconds`: a stream-stream interval join with watermarks."""
    a = failed.select("caller", F.col("ts").alias("failed_at"), F.col("row_id").alias("failed_row")).withWatermark("failed_at", f"{seconds} seconds")
    b = later.select(F.col("caller").alias("caller2"), F.col("ts").alias("asked_at"), F.col("row_id").alias("asked_row"), "failed").withWatermark("asked_at", f"{seconds} seconds")
    within = (F.col("caller") == F.col("caller2")) & (F.col("asked_at") > F.col("failed_at")) & (F.col("asked_at") <= F.col("failed_at") + F.expr(f"interval {seconds} seconds"))
    return a.join(b, within).drop("caller2")


def gaps(beats: DataFrame, seconds: int = 300) -> DataFrame:
    """source, since, until: stretches without a heartbeat longer than `seconds`. beats: source, ts."""
    from pyspark.sql import Window

    before = F.lag("ts").over(Window.partitionBy("source").orderBy("ts"))
    rows = beats.withColumn("since", before)
    return rows.where(F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.col("since").cast("timestamp")) > seconds).select("source", "since", F.col("ts").alias("until"))


def due(touched: DataFrame, seen: DataFrame, seconds: int = 600) -> DataFrame:
    """Transcripts (path, size, mtime) to capture: grown or shrunk since last time, or last seen (path, size, at) `seconds` before mtime."""
    rows = touched.join(seen.select("path", F.col("size").alias("_s"), "at"), "path", "left")
    recent = F.unix_seconds("mtime") - F.unix_seconds("at") < seconds
    return rows.where(F.col("at").isNull() | ~(recent & (F.col("_s") == F.col("size")))).drop("_s", "at").orderBy(F.desc("mtime"))


def repair_plan(states: DataFrame, inline: int = 8, first: int = 40, built: bool = True) -> DataFrame:
    """states (file_id, state) with action: repair while they are few, else report as stale; removed files are always dropped."""
    n = states.agg(F.count_if(F.col("state").isin("changed", "added")).alias("_n"))
    rows = states.where("state <> 'same'").join(F.broadcast(n))
    return rows.withColumn("action", F.when(F.col("state") == "removed", "drop").when(F.col("_n") <= (inline if built else first), "repair").otherwise("stale")).drop("_n")
