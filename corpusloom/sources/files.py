"""Scratch folders, and a sink that writes one file for each row."""

from __future__ import annotations

import atexit
import datetime
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's place under spark.checkpoint.dir; on a local master without one, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def write_files(rows: DataFrame, path: str) -> int:
    """Writes rows (file, text) as UTF-8 files under path, each task its own, and returns how many. A file written twice by a repeated
    task is the same file; a file name may hold folders. Null texts give empty files."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        made: set[str] = set()
        for b in batches:
            for file, text in zip(b.column("file").to_pylist(), b.column("text").to_pylist(), strict=True):
                target = f"{root.rstrip('/')}/{file}"
                folder = target.rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(target) as out:
                    out.write((text or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return rows.select("file", "text").mapInArrow(put, "n long").groupBy().sum("n").first()[0] or 0


def with_empty(rows: DataFrame) -> DataFrame:
    """rows of the binaryFile source (path, modificationTime, length, content), and those of files of no bytes, over which Spark's file sources
    pass. What was listed is compared with what is read by paths alone; the times of empty files are asked for one by one."""
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    listed = jvm.org.apache.hadoop.util.StringUtils.join("\n", rows._jdf.inputFiles())  # encoded, so that no path holds a line feed
    if not listed:
        return rows
    same = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    paths = spark.createDataFrame(pa.table({"value": listed.split("\n")})).select(same(F.url_decode(F.replace("value", F.lit("+"), F.lit("%2B")))).alias("path"))
    empty = []
    for r in paths.join(rows.select(same(F.col("path")).alias("path")), "path", "left_anti").collect():
        at = jvm.org.apache.hadoop.fs.Path(r["path"])
        state = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at)
        if state.getLen() == 0:
            empty.append((r["path"], datetime.datetime.fromtimestamp(state.getModificationTime() / 1000, datetime.timezone.utc), 0, bytearray()))
    return rows.unionByName(spark.createDataFrame(empty, rows.schema)) if empty else rows
