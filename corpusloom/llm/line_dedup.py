"""Line dedup: range-partitioned line hashes, streamed in order, give each document a bitmap of the lines to keep.

Lines travel as 128-bit hashes. They are dealt out by ranges of (hash, document), so that even a line found in a third of all
documents is spread over many tasks, and sorted by (hash, document, position) within a task. One pass over a task holds a
bounded state: the rows of the group at hand until `min_docs` documents are seen. Only a task's first and last groups can go
on in another task; their undecided rows and their counts (a few rows for each task) meet in a second, small step.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from corpusloom.llm.common import cut, few, most_parts, row_key, tune

_MARK = "doc long, doc2 long, pos int, h1 long, h2 long, docs long, first boolean"
#: The two halves of a document's key.
KEY = ["doc", "doc2"]


def _keyed(documents: DataFrame, *cols: str) -> DataFrame:
    """cols with doc and doc2, 128 bits that tell (doc_id, text) from any other."""
    return documents.select(row_key("doc_id", "text").alias("doc"), row_key(F.lit(1), "doc_id", "text").alias("doc2"), *cols)


def line_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, doc2, text) to (h1, h2, doc, doc2, pos) of every line whose key isn't empty.

    A key is the line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased: what strip() and lower() do to bytes.
    """
    for b in batches:
        keys = [[x.strip().lower() for x in t.encode().split(b"\n")] if t else [] for t in b.column("text").to_pylist()]
        pos = [[k for k, x in enumerate(ks) if x] for ks in keys]
        h = np.frombuffer(b"".join([xxh3_128_digest(x) for ks in keys for x in ks if x]), dtype=np.int64).reshape(-1, 2)
        flat = np.fromiter((k for ps in pos for k in ps), dtype=np.int32, count=len(h))
        yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), *(pa.array(np.repeat(b.column(c).to_numpy(), [len(x) for x in pos])) for c in KEY), pa.array(flat)], names=["h1", "h2", *KEY, "pos"])


def _stream(min_docs: int, keep: str):
    """Over one sorted range: marks of lines to drop, and the undecided rows and counts of the first and last group."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        group, docs, last, held, first_row, edge, rows_of = None, 0, None, [], None, True, 0

        def close(is_last: bool):
            """The group at hand is over. Inner groups are decided here; edge groups leave what a later step needs."""
            nonlocal held
            if group is None:
                return
            if edge or is_last:
                for x in held:  # fewer than min_docs documents here, or none are held
                    out.append((*x, group[0], group[1], 0, x == first_row))
                if docs >= min_docs and keep == "first":
                    out.append((*first_row, group[0], group[1], 0, True))
                out.append((None, None, None, group[0], group[1], docs, False))
            held = []

        for batch in batches:
            for h1, h2, d, d2, p in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", *KEY, "pos")), strict=True):
                row = (d, d2, p)
                if (h1, h2) != group:
                    before = group
                    close(False)
                    edge = before is None
                    group, docs, last, held, first_row = (h1, h2), 0, None, [], row
                elif row == rows_of:
                    continue  # the same row twice
                rows_of = row
                if row[:2] != last:
                    docs, last = docs + 1, row[:2]
                    if docs == min_docs:
                        out.extend((*x, None, None, None, None) for x in held if keep == "none" or x != first_row)
                        held = []
                if docs < min_docs:
                    held.append(row)
                elif keep == "none" or row != first_row:
                    out.append((*row, None, None, None, None))
            yield _rows(out)
            out = []
        close(True)
        yield _rows(out)

    return go


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    cols = zip(*out, strict=True) if out else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[*KEY, "pos", "h1", "h2", "docs", "first"])


def dropped_lines(documents: DataFrame, min_docs: int = 10, keep: str = "none", parts: int | None = None) -> DataFrame:
    """(doc, doc2, pos): the lines to drop. doc and doc2 are a key of (doc_id, text), pos counts lines from 0.

    keep: "none" drops every line of a key found in min_docs documents or more; "first" spares the first occurrence, in the
    order of (doc, doc2, pos). parts: as in cut().
    """
    if keep not in ("none", "first") or min_docs < 1:
        raise ValueError("keep is none or first, min_docs 1 or more")
    spark = documents.sparkSession
    tune(spark)
    lines = _keyed(documents, "text").mapInArrow(line_hashes, "h1 long, h2 long, doc long, doc2 long, pos int")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = lines.repartitionByRange(n, "h1", "h2", *KEY).sortWithinPartitions("h1", "h2", *KEY, "pos")
    marks = cut(ordered.mapInArrow(_stream(min_docs, keep), _MARK), parts)
    decided = marks.where("h1 is null").select(*KEY, "pos")
    edge = marks.where("h1 is not null")
    totals = edge.groupBy("h1", "h2").agg(F.sum("docs").alias("all_docs"), F.min(F.when(F.col("first"), F.struct(*KEY, "pos"))).alias("head"))
    settled = edge.where("doc is not null").join(totals, ["h1", "h2"]).where(F.col("all_docs") >= min_docs)
    if keep == "first":
        settled = settled.where(F.struct(*KEY, "pos") != F.col("head"))
    return decided.union(settled.select(*KEY, "pos"))


def pack(positions: list[int], n: int) -> bytes:
    """A compressed bitmap of n lines, 1 for those that stay."""
    bits = np.ones(n, dtype=bool)
    bits[positions] = False
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def unpack(bitmap: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), count=n).astype(bool)


def keep_bitmaps(documents: DataFrame, min_docs: int = 10, keep: str = "none", parts: int | None = None) -> DataFrame:
    """(doc, doc2, n_covered, n_dropped, bitmap) for each document that loses a line; every other document keeps all of its lines.

    A document is a row; rows that agree in doc_id and text are one document. A null or empty text is one empty line, and an
    empty key is never dropped. Other columns are not read. parts: as in cut().
    """

    def packed(batches):
        for b in batches:
            pos = [np.unique(p) for p in b.column("pos").to_pylist()]
            n = [int(p[-1]) + 1 for p in pos]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in KEY), pa.array(n, pa.int64()), pa.array([len(p) for p in pos], pa.int64()), pa.array([pack(p, k) for p, k in zip(pos, n, strict=True)], pa.binary())], names=[*KEY, "n_covered", "n_dropped", "bitmap"])

    lost = dropped_lines(documents, min_docs, keep, parts).groupBy(*KEY).agg(F.collect_list("pos").alias("pos"))
    return lost.mapInArrow(packed, "doc long, doc2 long, n_covered long, n_dropped long, bitmap binary")


def kept_text(text: str | None, n_covered: int | None, bitmap: bytes | None) -> tuple[str, int]:
    """The text without its dropped lines, and the number of its lines. The bitmap covers the lines up to the last dropped one."""
    lines = (text or "").split("\n")
    if bitmap is None:
        return text or "", len(lines)
    bits = unpack(bitmap, n_covered)
    return "\n".join([*compress(lines, bits.tolist()), *lines[n_covered:]]), len(lines)


def with_bitmaps(documents: DataFrame, min_docs: int = 10, keep: str = "none") -> DataFrame:
    """documents with n_covered, n_dropped and bitmap of keep_bitmaps(), null where nothing is dropped. Columns of documents that have
    one of these names, or that of a key's half, are left out."""
    tune(documents.sparkSession)
    own = [f"`{c}`" for c in documents.columns if c not in (*KEY, "n_covered", "n_dropped", "bitmap")]
    return _keyed(documents, *own).join(keep_bitmaps(documents.select("doc_id", "text"), min_docs, keep), KEY, "left")


def _one_of_emptied(documents: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc, doc2): of the documents of each text that would lose all of its lines, the one with the smallest key."""
    n_keys = F.regexp_count("text", F.lit(r"[^ \t\n\x0b\f\r][^\n]*"))
    texts = _keyed(documents, F.sha2("text", 256).alias("digest"), n_keys.alias("n_keys"))
    least = texts.join(bitmaps, KEY).where("n_dropped = n_keys").groupBy("digest").agg(F.min(F.struct(*KEY)).alias("least"))
    return least.select("least.*")


def apply_bitmaps(documents: DataFrame, min_docs: int = 10, keep: str = "none", spare: bool = False) -> DataFrame:
    """documents (doc_id, text, lang, source, n_chars) with the lines dropped from text, and n_chars set anew.

    spare: of the documents of each text that would lose all of its lines, one keeps them all.
    """
    tune(documents.sparkSession)
    rows = documents.select("doc_id", "text", "lang", "source")
    parts = most_parts(documents)
    bitmaps = keep_bitmaps(rows, min_docs, keep, parts)
    if spare:
        bitmaps = cut(bitmaps, parts)
        bitmaps = bitmaps.join(_one_of_emptied(rows, bitmaps), KEY, "left_anti")
    rows = few(_keyed(rows, *rows.columns).join(bitmaps, KEY, "left"), parts)

    def texts(batches):
        for b in batches:
            kept = [kept_text(*x)[0] for x in zip(*(b.column(c).to_pylist() for c in ("text", "n_covered", "bitmap")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(kept, pa.string()), b.column("lang"), b.column("source"), pa.array(map(len, kept), pa.int64())], names=["doc_id", "text", "lang", "source", "n_chars"])

    return rows.select("doc_id", "text", "lang", "source", "n_covered", "bitmap").mapInArrow(texts, "doc_id long, text string, lang string, source string, n_chars long")
