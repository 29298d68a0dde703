"""Keyword scores a block of documents at a time: a document's scores need its own terms and the statistics of its corpus alone, so that
pairs of documents and queries are never shuffled. Sums run in the order of a query's terms: equal documents have equal scores."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpusloom import constants as K
from corpusloom.functions.spans import Terms, runs

#: Cells of a block of terms and documents, and documents of one, at most; queries that meet a block at once; rows put into order at once.
CELLS, DOCS, QUERIES, KEPT = 1 << 22, 256, 1024, 1 << 20

COUNTS = "corpus string, name string, file string, len0 double, len1 double, len2 double, ids binary, fields binary, ns binary"
SCORES = "corpus string, name string, raw double"


def binaries(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())


def values(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(all values of a column of binaries, how many each row has)."""
    size = np.dtype(kind).itemsize
    n = pc.binary_length(column).to_numpy(zero_copy_only=False) // size if len(column) else np.zeros(0)
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind), n.astype(np.int64)


def counter(terms, weights: list[tuple[int, float]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents with the texts of their fields (t0, t1, ...) become COUNTS: the weighted lengths of the groups, and how often each of the
    shared terms is in each field. weights: of the fields, with their groups."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: n for n, t in enumerate(terms.value)}
        every = Terms()
        known: dict[str, tuple[int, tuple[int, ...]]] = {}
        for b in batches:
            lengths, keys, ns, ends = np.zeros((3, b.num_rows)), [], [], []
            texts = [b.column(f"t{f}").to_pylist() for f in range(len(weights))]
            for n in range(b.num_rows):
                found: dict[int, int] = {}
                for f, (group, weight) in enumerate(weights):
                    size = 0
                    for run, times in Counter(runs(texts[f][n])).items():
                        got = known.get(run)
                        if got is None:
                            own = every[run]
                            if len(every) <= 1:  # begun anew
                                known.clear()
                            got = known[run] = (len(own), tuple(place[t] * len(weights) for t in own if t in place))
                        size += got[0] * times
                        for key in got[1]:
                            found[key + f] = found.get(key + f, 0) + times
                    lengths[group, n] += size * weight
                own = sorted(found)
                keys += own
                ns += [found[k] for k in own]
                ends.append(len(keys))
            key = np.array(keys, dtype=np.int64)
            parts = {"ids": (key // len(weights)).astype(np.int32), "fields": (key % len(weights)).astype(np.int8), "ns": np.array(ns, dtype=np.int32)}
            same = {c: b.column(c) for c in ("corpus", "name", "file")} | {f"len{g}": pa.array(lengths[g]) for g in range(3)}
            yield pa.RecordBatch.from_pydict(same | {c: binaries(np.split(x, ends[:-1]) if b.num_rows else []) for c, x in parts.items()})

    return count


def held_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """corpus, id, n over COUNTS: of how many documents each corpus holds a term."""
    got: dict[str, np.ndarray] = {}
    for b in batches:
        corpora = np.asarray(b.column("corpus").to_pylist(), dtype=object)
        ids, n = values(b.column("ids"), np.int32)
        row = np.repeat(np.arange(b.num_rows), n)
        new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (row[1:] != row[:-1])])[: len(ids)]
        for corpus in dict.fromkeys(corpora.tolist()):
            more = np.bincount(ids[new & (corpora[row] == corpus)])
            old = got.get(corpus, np.zeros(0, np.int64))
            size = max(len(more), len(old))
            got[corpus] = np.pad(more, (0, size - len(more))) + np.pad(old, (0, size - len(old)))
    for corpus, n in got.items():
        ids = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"corpus": pa.array([corpus] * len(ids), pa.string()), "id": pa.array(ids.astype(np.int32)), "n": pa.array(n[ids].astype(np.int64))})


@dataclass
class Asked:
    """Queries on a model. terms: known ones; idf: by corpus, over terms; avg: by corpus, average lengths; ids: Arrow array of query ids; at:
    places of each query's terms, sorted by their number; weights: of the fields, with their groups; floors: by corpus, scores below which
    a query's rows are left out; best: how many rows of each query and corpus a task gives, all if None; digits: those by which they are ranked."""

    terms: list[str]
    idf: dict[str, np.ndarray]
    avg: dict[str, tuple[float, ...]]
    ids: pa.Array
    at: list[list[int]]
    weights: list[tuple[int, float]]
    floors: dict[str, np.ndarray] = field(default_factory=dict)
    best: int | None = None
    digits: int | None = None

    def weighed(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, weight) of COUNTS."""
        ids, n = values(b.column("ids"), np.int32)
        fields, ns = values(b.column("fields"), np.int8)[0], values(b.column("ns"), np.int32)[0]
        row = np.repeat(np.arange(b.num_rows), n)
        corpora = b.column("corpus").to_pylist()
        avg = np.array([self.avg[c] for c in corpora]).reshape(b.num_rows, 3)
        share = np.stack([1 / (1 - K.B + K.B * b.column(f"len{g}").to_numpy() / avg[:, g]) for g in range(3)])
        group, weight = np.array([g for g, _ in self.weights]), np.array([w for _, w in self.weights])
        x = share[group[fields], row] * weight[fields] * ns
        if not len(x):
            return row, ids, x
        first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (row[1:] != row[:-1])]))
        return row[first], ids[first], np.add.reduceat(x, first)

    def listed(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, weight) of rows with lists of terms and weights w."""
        ids = pc.index_in(b.column("terms").flatten(), value_set=pa.array(self.terms, pa.string()))
        row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("terms")).to_numpy(zero_copy_only=False))
        held = ids.is_valid().to_numpy(zero_copy_only=False)
        return row[held], ids.drop_null().to_numpy(), b.column("w").flatten().to_numpy(zero_copy_only=False)[held]


class _Best:
    """The best rows so far of each query in one corpus: by score, then by name."""

    def __init__(self, queries: int, k: int, digits: int | None):
        self.k, self.digits, self.waiting, self.n = k, digits, [], 0
        self.floor = np.zeros(queries)
        # A row is worth a look if its score, rounded, may equal the last one's.
        self.slack = 0 if digits is None else 1.01 * 10.0**-digits
        self.q, self.name, self.raw = np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)

    def may(self, q: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """Which scores (a row for each query, a column for each document) may be among the best."""
        found = (raw > 0) & (raw >= self.floor[q][:, None])
        if self.k < raw.shape[1] and found.sum() > 2 * self.k * len(q):
            self.floor[q] = np.maximum(self.floor[q], np.partition(raw, raw.shape[1] - self.k, axis=1)[:, raw.shape[1] - self.k] - self.slack)
            found &= raw >= self.floor[q][:, None]
        return found

    def add(self, q: np.ndarray, name: np.ndarray, raw: np.ndarray) -> None:
        self.waiting.append((q, name, raw))
        self.n += len(q)
        if self.n > KEPT:
            self.settle()

    def settle(self) -> None:
        q, name, raw = (np.concatenate([x, *y]) for x, y in zip((self.q, self.name, self.raw), zip(*self.waiting, strict=True), strict=True)) if self.waiting else (self.q, self.name, self.raw)
        self.waiting, self.n = [], 0
        score = raw if self.digits is None else np.floor(raw * 10**self.digits + 0.5)
        order = np.lexsort((np.unique(name, return_inverse=True)[1] if len(name) else name, -score, q))
        q, name, raw = q[order], name[order], raw[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        use = rank < self.k
        self.q, self.name, self.raw = q[use], name[use], raw[use]
        last = rank[use] == self.k - 1
        self.floor[self.q[last]] = np.maximum(self.floor[self.q[last]], self.raw[last] - self.slack)


def scorer(shared, counted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """query_id and SCORES of documents with a term of a query, over COUNTS or rows of lists."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: Asked = shared.value
        used = sorted({t for q in a.at for t in q})
        slot = np.full(len(a.terms) + 1, -1)
        slot[used] = np.arange(len(used))
        order = sorted(range(len(a.at)), key=lambda n: len(a.at[n]))
        groups = []
        for s in range(0, len(order), QUERIES):
            own = order[s : s + QUERIES]
            most = max(len(a.at[n]) for n in own)
            if most:
                groups.append((np.array(own), np.array([[*(slot[t] for t in a.at[n]), *[len(used)] * (most - len(a.at[n]))] for n in own])))
        wide = max(16, min(DOCS, CELLS // (len(used) + 1)))
        best: dict[str, _Best] = {}

        def rows(corpus: str, q: np.ndarray, name: np.ndarray, raw: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"query_id": a.ids.take(pa.array(q)), "corpus": pa.array([corpus], pa.string()).take(pa.array(np.zeros(len(q), np.int32))), "name": pa.array(name, pa.string()), "raw": pa.array(raw, pa.float64())})

        for b in batches:
            if not b.num_rows:
                continue
            row, term, w = a.weighed(b) if counted else a.listed(b)
            held = slot[term] >= 0
            row, term, w = row[held], term[held], w[held]
            corpora, names = np.asarray(b.column("corpus").to_pylist(), dtype=object), np.asarray(b.column("name").to_pylist(), dtype=object)
            for corpus in dict.fromkeys(corpora.tolist()):
                docs = np.flatnonzero(corpora == corpus)
                place = np.full(b.num_rows, -1)
                place[docs] = np.arange(len(docs))
                own = place[row] >= 0
                at, t = place[row[own]], term[own]
                x = a.idf[corpus][t] * (w[own] * (K.K1 + 1) / (K.K1 + w[own]))
                by = np.argsort(at, kind="stable")
                at, t, x = at[by], slot[t[by]], x[by]
                if a.best is not None and corpus not in best:
                    best[corpus] = _Best(len(a.at), a.best, a.digits)
                for d in range(0, len(docs), wide):
                    lo, hi = np.searchsorted(at, (d, d + wide))
                    n = min(wide, len(docs) - d)
                    block = np.zeros((len(used) + 1, n))
                    np.add.at(block, (t[lo:hi], at[lo:hi] - d), x[lo:hi])
                    block[len(used)] = 0
                    label = names[docs[d : d + n]]
                    for q, places in groups:
                        raw = block[places[:, 0]]
                        for k in range(1, places.shape[1]):
                            raw += block[places[:, k]]
                        if a.best is not None:
                            i, j = np.nonzero(best[corpus].may(q, raw))
                            if len(i):
                                best[corpus].add(q[i], label[j], raw[i, j])
                            continue
                        floor = a.floors[corpus][q][:, None] if corpus in a.floors else 0.0
                        i, j = np.nonzero((raw > 0) & (raw >= floor))
                        if len(i):
                            yield rows(corpus, q[i], label[j], raw[i, j])
                if a.best is not None:
                    best[corpus].settle()
        for corpus, x in best.items():
            x.settle()
            yield rows(corpus, x.q, x.name, x.raw)

    return go
