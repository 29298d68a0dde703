"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: space and \x09-\x0D. bytes.split() splits on just these.
SPACE = " \t\n\x0b\x0c\r"
#: Rows of an Arrow batch. A row is a whole document, so that Spark's default of 10,000 would hold tens of MB a worker.
ARROW_ROWS = 1000
#: The share of its largest size up to which the driver's heap grows before what earlier jobs left is collected.
FULL = 0.4
#: Documents for each part of a checkpoint, at least, and parts for each core up to which there is no such bound.
PART_ROWS, CORE_PARTS = 4000, 2


def tune(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole documents small, unless the session already has a limit of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one on a local master where none is set."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Writes df into the shared folder and reads it back, so that a lost executor costs no recomputation of what is above.

    parts: the most files that it is written into; partitions beyond that share tasks, without a shuffle.
    """
    shared_dir(df.sparkSession)
    release(df.sparkSession)
    return few(df, parts).checkpoint()


def few(df: DataFrame, parts: int | None) -> DataFrame:
    """df in `parts` partitions at most, without a shuffle; as it is if that is None."""
    return df if parts is None else df.coalesce(parts)


def most_parts(documents: DataFrame) -> int | None:
    """How many parts what is made of these documents needs at most: one for each PART_ROWS of them, CORE_PARTS for each core at
    least; None if shuffles make no more anyway. Without Hadoop's native library a local file system starts a process or more
    for each file it writes, so that small tables dealt over many partitions cost processes instead of bytes."""
    spark = documents.sparkSession
    least = CORE_PARTS * spark.sparkContext.defaultParallelism
    if int(spark.conf.get("spark.sql.shuffle.partitions")) <= least:
        return None
    return max(least, -(-documents.count() // PART_ROWS))


def release(spark: SparkSession) -> None:
    """Lets the driver drop what earlier jobs left once its heap has grown to FULL of what it may be: plans, compiled classes, and by
    Spark's cleaner their shuffles and checkpoints. Left alone, the JVM's memory grows with the number of jobs and tasks."""
    run = spark.sparkContext._jvm.Runtime.getRuntime()
    if run.totalMemory() > FULL * run.maxMemory():
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def words(text: str | None) -> list[bytes]:
    """The maximal runs of characters other than [\\x20\\x09-\\x0D], as UTF-8; null has none."""
    return text.encode().split() if text else []


def row_key(*cols: str | Column) -> Column:
    """A 64-bit key of a row's own values, the same wherever and however often the row is read."""
    return F.xxhash64(*cols)


def runs(batches: Iterable[list], limit: int, size) -> Iterator[list]:
    """Cuts a stream of lists into lists whose items' sizes add up to limit at most, or hold one item."""
    held, total = [], 0
    for batch in batches:
        for item in batch:
            n = size(item)
            if held and total + n > limit:
                yield held
                held, total = [], 0
            held.append(item)
            total += n
    if held:
        yield held
