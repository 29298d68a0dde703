"""Exact top-k inner products from an impact-ordered index, a score at a time.

Vectors are packed into blocks. A block has a posting list for each dimension: (vector, quantised impact) for every component other
than zero, in descending order of impact, the part of the absolute value that STEP resolves. Posting segments of all lists are
processed by descending impact: every query's scores grow by its own component times the postings' values. What a vector has not yet
contributed, the errors of quantisation included, is at most |query| times the norm of the rest (Cauchy-Schwarz). A query's k-th best exact score
so far, of the blocks before, is the threshold: a block is left as soon as these bounds prove that few of its vectors can still
be among the k best of a query, or when its segments end. Those that can are scored exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cut

BLOCK, QUERY_BLOCK = 4096, 256
#: Shares of a block's postings that end a segment, and the step to which impacts are rounded.
SEGMENTS, STEP = (0.15, 0.35, 0.6, 1.0), 4
#: A block is left early when possible members are this few times k a query.
FEW = 4
#: Query blocks that a task holds running results of; more are dealt out to other tasks, which read the vectors again.
HELD_BLOCKS = 128

_PAIRS = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}


class Index:
    """Impact-ordered postings of one block. values: integers, a row for each vector.

    segments: for each one, the lists of its dimensions (dimension, vectors, quantised values, by descending impact), and the norm
    of what each vector has left after it.
    """

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        size = np.abs(values)
        at, dim = np.nonzero(values)
        impact = size[at, dim]
        self.kind = np.float32 if values.size and float(size.max(initial=0)) ** 2 * values.shape[1] < 1 << 22 else np.float64
        rounded = np.where(impact < STEP, values[at, dim], np.sign(values[at, dim]) * (impact // STEP * STEP + STEP // 2))
        level = np.maximum(impact // STEP, impact < STEP)
        order = np.argsort(-impact, kind="stable")
        left = values.astype(np.float64)
        self.norm = np.sqrt((left * left).sum(axis=1)) * (1 + 1e-6) + 1e-6
        self.segments: list[tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray]] = []
        start = 0
        for share in SEGMENTS:
            end = min(len(order), int(np.ceil(share * len(order))))
            while 0 < end < len(order) and level[order[end]] == level[order[end - 1]]:
                end += 1  # postings of one impact stay together
            own = order[start:end]
            start = end
            if not len(own):
                continue
            left[at[own], dim[own]] -= rounded[own]
            by = np.argsort(dim[own], kind="stable")
            own = own[by]
            cuts = np.flatnonzero(np.diff(dim[own])) + 1
            lists = [(int(dim[x[0]]), at[x], rounded[x].astype(self.kind)) for x in np.split(own, cuts)]
            self.segments.append((lists, np.sqrt((left * left).sum(axis=1)) * (1 + 1e-6) + 1e-6))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query_id, vec_id, score) of each query's k best in the block, fewer if it has fewer, or none below the query's floor.
        Rows with the query's id are left out."""
        n, m = len(self.ids), len(query_ids)
        own = query_ids[None, :] == self.ids[:, None]
        norm = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        need = np.full(m, -np.inf) if floor is None else floor.astype(np.float64)
        possible = (np.outer(self.norm, norm) * (1 + 1e-5) >= need[None, :]) & ~own
        if possible.sum() > FEW * k * m:
            q = np.ascontiguousarray(queries.T.astype(self.kind))
            score = np.zeros((n, m), dtype=self.kind)
            for lists, rest in self.segments:
                for d, rows, impact in lists:
                    score[rows] += impact[:, None] * q[d][None, :]
                slack = np.outer(rest, norm) + 1e-5 * np.abs(score)
                if n > k:
                    low = np.where(own, -np.inf, score - slack)
                    need = np.maximum(need, np.partition(low, n - k, axis=0)[n - k])
                possible = (score + slack >= need[None, :]) & ~own
                if possible.sum() <= FEW * k * m:
                    break
        b, a = np.nonzero(possible)
        exact = _products(queries, self.values, a, b)
        order = np.lexsort((self.ids[b], -exact, a))
        a, b, exact = a[order], b[order], exact[order]
        use = np.arange(len(a)) - np.searchsorted(a, a) < k
        return query_ids[a[use]], self.ids[b[use]], exact[use]


class Best:
    """Running results of one block of queries: k best at most of each."""

    def __init__(self, query_ids: np.ndarray, k: int):
        self.k, self.order = k, np.argsort(query_ids, kind="stable")
        self.sorted = query_ids[self.order]
        self.found = [np.zeros(0, dtype=np.int64)] * 3
        self.floor = np.full(len(query_ids), -np.inf)

    def add(self, *more: np.ndarray) -> None:
        q, v, s = (np.concatenate(x) for x in zip(self.found, more, strict=True))
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        use = rank < self.k
        self.found = [q[use], v[use], s[use]]
        last = rank == self.k - 1
        self.floor[self.order[np.searchsorted(self.sorted, q[last])]] = s[last]


def _products(queries: np.ndarray, values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a), dtype=np.int64)
    for at in range(0, len(a), 1 << 16):
        s = slice(at, at + (1 << 16))
        out[s] = np.einsum("ij,ij->i", queries[a[s]].astype(np.int64), values[b[s]].astype(np.int64))
    return out


def integers(embedding: str) -> Column:
    """floor(256 * x) of each component x as double; null for a vector that is null or holds a null or non-finite component."""
    x = F.col(embedding).cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(F.coalesce(sound, F.lit(False)), F.transform(x, lambda v: F.floor(v * 256)))


def _blocks(most: int):
    """Packs the rows of a partition into blocks of `most` vectors."""

    def pack(ids, rows, number):
        from pyspark import TaskContext

        dim = max(map(len, rows))
        values = np.zeros((len(rows), dim), dtype=np.int64)
        for i, r in enumerate(rows):
            values[i, : len(r)] = r
        kind = np.int16 if np.abs(values).max(initial=0) < 1 << 15 else np.int64
        block = (TaskContext.get().partitionId() << 32) + number
        cols = [[block], [len(rows)], [kind().itemsize], [np.array(ids, dtype=np.int64).tobytes()], [values.astype(kind).tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["block", "n", "width", "ids", "vals"])

    def go(batches):
        ids, rows, number = [], [], 0
        for b in batches:
            for i, r in zip(b.column("id").to_pylist(), b.column("v").to_pylist(), strict=True):
                ids.append(i)
                rows.append(r)
                if len(rows) == most:
                    yield pack(ids, rows, number)
                    ids, rows, number = [], [], number + 1
        if rows:
            yield pack(ids, rows, number)

    return go


def _unpack(n: int, width: int, ids: bytes, vals: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, dtype=np.int64), np.frombuffer(vals, dtype=np.int16 if width == 2 else np.int64).reshape(n, -1)


def _pairs_of(best: Best) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(best.found, _PAIRS.values(), strict=True)], names=list(_PAIRS))


def search(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k vectors with the highest integer inner products, ties to the smaller vec_id.

    queries and vectors: (vec_id, embedding). Rows with a null id, or whose vector integers() makes null, take no part. A vector
    isn't its own result: rows with the query's id are left out. A query id with several vectors takes the smallest. Repeated
    vectors are found as often as they are there. Vectors of different lengths are filled up with zeros. Query blocks meet vector
    blocks by slot, each pair once; a task carries each query's best from block to block.
    """
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    kinds = "block long, n long, width long, ids binary, vals binary"
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    wanted = queries.select(F.col("vec_id").alias("id"), integers("embedding").alias("v")).where("id is not null and v is not null").groupBy("id").agg(F.min("v").alias("v"))
    packed = wanted.mapInArrow(_blocks(QUERY_BLOCK), kinds)
    packed = cut(packed)
    groups = max(1, -(-packed.count() // HELD_BLOCKS))
    q = packed.select("block", "n", "width", "ids", "vals", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("group")).withColumnRenamed("block", "qblock")
    q = q.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    rows = vectors.select(F.col("vec_id").alias("id"), integers("embedding").alias("v")).where("id is not null and v is not null")
    c = rows.mapInArrow(_blocks(BLOCK), kinds).select(F.col("block"), F.col("n").alias("cn"), F.col("width").alias("cwidth"), F.col("ids").alias("cids"), F.col("vals").alias("cvals"), F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int").alias("slot"))
    c = c.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def score(batches):
        held, index, best = None, None, {}
        for b in batches:
            for r in zip(*(b.column(x).to_pylist() for x in ("block", "cn", "cwidth", "cids", "cvals", "n", "width", "ids", "vals", "qblock", "slot", "group")), strict=True):
                if r[0] != held:
                    held, index = r[0], Index(*_unpack(*r[1:5]))
                ids, values = _unpack(*r[5:9])
                d = max(values.shape[1], index.values.shape[1])
                if values.shape[1] < d:
                    values = np.pad(values, ((0, 0), (0, d - values.shape[1])))
                elif index.values.shape[1] < d:
                    index = Index(index.ids, np.pad(index.values, ((0, 0), (0, d - index.values.shape[1]))))
                own = best.get(r[9])
                if own is None:
                    if len(best) >= 2 * HELD_BLOCKS:  # another group's results go on first
                        yield from (_pairs_of(x) for x in best.values())
                        best = {}
                    own = best[r[9]] = Best(ids, k)
                own.add(*index.search(ids, values, k, own.floor))
        yield from (_pairs_of(x) for x in best.values())

    found = c.join(q, ["slot", "group"]).mapInArrow(score, "query_id long, vec_id long, score long")
    ranked = found.selectExpr("query_id", "vec_id", "score", "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank")
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
