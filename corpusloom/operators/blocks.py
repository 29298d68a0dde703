"""Products of all vectors with all others, in pairs of blocks: what a task holds doesn't grow with the tables, and no pair is shuffled."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.files import scratch

#: Rows of a block, and bytes of its matrix, at most; one row's items stay together. Blocks that one task of a join holds.
ROWS, BYTES, HELD = 4096, 1 << 22, 16
#: Rows of a block that meet another block at once.
STEP = 512


def _matrix(vecs: pa.Array) -> np.ndarray:
    """Vectors of one length as rows; null components are NaN."""
    flat = vecs.flatten().cast(pa.float64())
    return flat.to_numpy(zero_copy_only=False).reshape(len(vecs), -1)


def _packer(together: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (corpus, name, dim, vec, and with together: ix, text) become blocks of equal corpora and lengths. together: equal names follow
    each other in the rows, and no block is cut between them."""

    def block(corpus: str | None, dim: int, rows: pa.Table) -> pa.RecordBatch:
        lists = {"names": ("name", pa.string())} | ({"ix": ("ix", pa.int32()), "texts": ("text", pa.string())} if together else {})
        m = np.concatenate([_matrix(c) for c in rows.column("vec").chunks if len(c)])
        row = {"id": pa.array([uuid.uuid4().hex]), "corpus": pa.array([corpus], pa.string()), "dim": pa.array([dim], pa.int32()), "m": pa.array([m.tobytes()], pa.binary())}
        return pa.RecordBatch.from_pydict(row | {c: pa.array([rows.column(x).to_pylist()], pa.list_(kind)) for c, (x, kind) in lists.items()})

    def place(rows: pa.Table, most: int) -> int:
        """Where to cut rows that are more than a block's, 0 if that can't be told yet."""
        if not together:
            return most
        names = np.asarray(rows.column("name").to_pylist(), dtype=object)
        cuts = np.flatnonzero(names[1:] != names[:-1]) + 1
        return int(max(cuts[cuts <= most], default=min(cuts, default=0)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], pa.Table] = {}
        for b in batches:
            size, corpora = b.column("dim").to_numpy(), np.asarray(b.column("corpus").to_pylist(), dtype=object)
            for key in dict.fromkeys(zip(corpora.tolist(), size.tolist(), strict=True)):
                own = pa.Table.from_batches([b.filter(pa.array((corpora == key[0]) & (size == key[1]), pa.bool_()))])
                rows = pa.concat_tables([held[key], own]) if key in held else own
                most = max(1, min(ROWS, BYTES // (8 * key[1])))
                while rows.num_rows > most and (cut := place(rows, most)):
                    yield block(*key, rows.slice(0, cut))
                    rows = rows.slice(cut)
                held[key] = rows
        for key, rows in held.items():
            if rows.num_rows:
                yield block(*key, rows)

    return pack


def packed(vectors: DataFrame, together: bool) -> DataFrame:
    """Blocks (id, corpus, dim, m, names, and with together: ix, texts) of vectors (corpus, name, vec, and with together: chunk_ix, text), written to
    the scratch folder. together: all rows of a name are in one block, in the order of their names."""
    spark = vectors.sparkSession
    rows = vectors.where("vec is not null and size(vec) > 0").select("corpus", F.col("name").cast("string").alias("name"), F.size("vec").alias("dim"), F.col("vec").cast("array<double>").alias("vec"), *([F.col("chunk_ix").cast("int").alias("ix"), F.col("text").alias("text")] if together else []))
    if together:
        rows = rows.repartition("corpus", "name").sortWithinPartitions("corpus", "dim", "name")
    schema = "id string, corpus string, dim int, m binary, names array<string>" + (", ix array<int>, texts array<string>" if together else "")
    path = scratch(spark, "blocks")
    rows.mapInArrow(_packer(together), schema).write.parquet(path)
    return spark.read.parquet(path)


def meet(left: DataFrame, right: DataFrame, each: Callable, schema: str, same_corpus: bool) -> DataFrame:
    """each() over the pairs of blocks of equal lengths: all right blocks that a task holds follow each other for a left one."""
    spark = left.sparkSession
    n = max(1, left.count())
    other = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns)).coalesce(max(1, -(-right.count() // HELD)))
    # Two comparisons instead of one for equality: an equality would send all blocks of a corpus to one task.
    equal = ~(F.col("dim") < F.col("r_dim")) & ~(F.col("dim") > F.col("r_dim"))
    if same_corpus:
        equal = equal & ~(F.col("corpus") < F.col("r_corpus")) & ~(F.col("corpus") > F.col("r_corpus"))
    pairs = left.repartition(min(n, 4 * spark.sparkContext.defaultParallelism)).join(other, equal)
    return pairs.mapInArrow(each, schema)


def read(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray]:
    """(names, matrix) of a block."""
    return np.asarray(row[f"{prefix}names"].values.to_pylist(), dtype=object), np.frombuffer(row[f"{prefix}m"].as_buffer(), dtype=np.float64).reshape(-1, row[f"{prefix}dim"].as_py())


def products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the rows i of a and j of b, summed from the first component on, so that they don't depend on a row's place."""
    out = np.zeros(len(i))
    for at in range(0, len(i), 1 << 15):
        x, y, s = a[i[at : at + (1 << 15)]], b[j[at : at + (1 << 15)]], out[at : at + (1 << 15)]
        for k in range(a.shape[1]):
            s += x[:, k] * y[:, k]
    return out


def rounded(x: np.ndarray) -> np.ndarray:
    """To four decimals, halves away from zero, as SQL does."""
    return np.sign(x) * np.floor(np.abs(x) * 1e4 + 0.5) / 1e4


def _few_alike(names: np.ndarray, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows without those of equal vectors beyond the k + 1 first names: they tie, so that no others can be among k."""
    order = np.argsort(names, kind="stable")
    names, m = names[order], m[order]
    _, group = np.unique(np.ascontiguousarray(m).view(np.dtype((np.void, m.shape[1] * 8))).ravel(), return_inverse=True)
    by = np.lexsort((np.arange(len(group)), group))
    g, nm = group[by], names[by]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (nm[1:] != nm[:-1])])
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    distinct = np.cumsum(new)
    nth = distinct - np.repeat(distinct[first], np.diff([*first, len(g)]))
    keep = np.sort(by[new & (nth <= k)])
    return names[keep], m[keep]


class _Best:
    """The k best neighbours so far of each row of a left block."""

    def __init__(self, names: np.ndarray, m: np.ndarray, k: int):
        self.names, self.m, self.k = names, m, k
        self.small, self.norm = m.astype(np.float32), np.sqrt((m * m).sum(axis=1))
        self.floor = np.full(len(names), -np.inf)
        self.at, self.who, self.sim = np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)

    def add(self, names: np.ndarray, m: np.ndarray) -> None:
        names, m = _few_alike(names, m, self.k)
        small, norm = m.astype(np.float32), float(np.sqrt((m * m).sum(axis=1)).max(initial=0))
        most = int(np.unique(names, return_counts=True)[1].max(initial=1))
        enough = (self.k + 1) * most  # among so many rows are k names besides the row's own
        got = []
        for at in range(0, len(self.names), STEP):
            s = self.small[at : at + STEP] @ small.T
            # What 32 bits may be off, and less than a step of rounding.
            slack = 1.1e-4 + 4e-7 * (8 + m.shape[1]) * self.norm[at : at + STEP] * norm
            low = self.floor[at : at + STEP]
            if enough < s.shape[1] and np.isneginf(low).any():
                low = np.maximum(low, np.partition(s, s.shape[1] - enough, axis=1)[:, s.shape[1] - enough] - slack)
            i, j = np.nonzero(s >= (low - slack)[:, None])
            i += at
            other = self.names[i] != names[j]
            i, j = i[other], j[other]
            got.append((i, names[j], rounded(products(self.m, m, i, j))))
        at, who, sim = (np.concatenate([x, *y]) for x, y in zip((self.at, self.who, self.sim), zip(*got, strict=True), strict=True))
        order = np.lexsort((np.unique(who, return_inverse=True)[1] if len(who) else who, -sim, at))
        at, who, sim = at[order], who[order], sim[order]
        # Of a neighbour with several vectors the best one stays: its rows needn't follow each other.
        seen = np.zeros(len(at), bool)
        pairs: set = set()
        if most > 1 or len(self.at):
            for n, key in enumerate(zip(at.tolist(), who.tolist(), strict=True)):
                seen[n] = key in pairs
                pairs.add(key)
        at, who, sim = at[~seen], who[~seen], sim[~seen]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        use = rank < self.k
        self.at, self.who, self.sim = at[use], who[use], sim[use]
        last = rank[use] == self.k - 1
        self.floor[self.at[last]] = self.sim[last]


def best_neighbours(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """corpus, name, neighbour, similarity (4 decimals) over pairs of blocks: each left row's k best names of the right blocks of a task."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, key, corpus = None, None, ""

        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"corpus": pa.array([corpus] * len(best.at), pa.string()), "name": pa.array(best.names[best.at].tolist(), pa.string()), "neighbour": pa.array(best.who.tolist(), pa.string()), "similarity": pa.array(best.sim, pa.float64())})

        for b in batches:
            for n in range(b.num_rows):
                row = {c: b.column(c)[n] for c in b.schema.names}
                now = row["id"].as_py()
                if now != key:
                    if best is not None:
                        yield result()
                    best, key, corpus = _Best(*read(row), k), now, row["corpus"].as_py()
                best.add(*read(row, "r_"))
        if best is not None:
            yield result()

    return go


def above(floor: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """query_id, corpus, name, cosine, text over pairs of blocks of documents and of queries: names whose best vector lies above the floor, with
    the text of the best chunk (of equals the first), that of the summary only if there is no chunk."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in range(b.num_rows):
                row = {c: b.column(c)[n] for c in b.schema.names}
                names, m = read(row)
                ids, q = read(row, "r_")
                starts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
                ends = np.concatenate([starts[1:], [len(names)]])
                ix, texts = row["ix"].values.to_numpy(zero_copy_only=False).astype(float), np.asarray(row["texts"].values.to_pylist(), dtype=object)
                for at in range(0, len(ids), STEP):
                    # A first product tells where to look; what it finds is summed in a fixed order.
                    s = np.fmax.reduceat(m @ q[at : at + STEP].T, starts, axis=0)
                    i, j = np.nonzero(s > floor - 1e-9)
                    j += at
                    one = starts[i]
                    cos = products(m, q, one, j)
                    text = texts[one]
                    for x in np.flatnonzero(ends[i] - one > 1).tolist():
                        own = np.arange(one[x], ends[i[x]])
                        sims = products(m, q, own, np.full(len(own), j[x]))
                        cos[x] = np.nanmax(sims)
                        chunk = own[~np.isnan(ix[own]) & ~np.isnan(sims)]
                        if len(chunk):
                            got = texts[max(chunk.tolist(), key=lambda c: (sims[c - own[0]], -ix[c]))]  # noqa: B023
                        else:
                            got = None
                        rest = [t for t in texts[own[np.isnan(ix[own])]] if t is not None]
                        text[x] = got if got is not None else max(rest, default=None)
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array(ids[j].tolist(), pa.string()), "corpus": pa.array([row["corpus"].as_py()] * len(i), pa.string()), "name": pa.array(names[one].tolist(), pa.string()), "cosine": pa.array(cos, pa.float64()), "text": pa.array(text.tolist(), pa.string())})

    return go
