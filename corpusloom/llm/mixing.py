"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents form a stream in the order of a seeded hash. The stream is cut into blocks of equally many words; a
source's quota is the number of its blocks that the mix takes, whole rounds of the stream and part of another one. A binary tree
over the output shards splits the quotas: at each node a multivariate hypergeometric draw says how many blocks of each source go to the left
half. So every shard holds an exact random share, without any shard knowing another's blocks: position p of a source's permuted
blocks belongs to the shard that the tree's splits lead p to. Within a shard, pieces are ordered by a seeded hash.

A node's draw depends on the seed and the node alone, so any worker can repeat it, and a lost one costs nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, tune

#: Words of a block, unless the source is so small that it would have fewer than LEAST_BLOCKS.
BLOCK_WORDS, LEAST_BLOCKS = 1024, 250
#: Blocks of all sources, at most (the draws' own bound); blocks grow with the corpus beyond that.
MOST_BLOCKS = 400_000_000
#: Words of an output shard, about: shards grow in number with the mix, not in size.
SHARD_WORDS = 4_000_000
#: Documents of a source that are put in order together, about.
BUCKET = 2000
#: Sources, at most: a row for each is held by the driver and broadcast.
MOST_SOURCES = 200_000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    docs: int
    target: float
    block: int
    blocks: int
    quota: int


def targets(sizes: list[int], weights: list[float], total: float, most: float = 2.0) -> list[float]:
    """Shares of total by weight; none over most times its size, whose excess is shared by weight among the rest, until none is."""
    out, free, left = [0.0] * len(sizes), list(range(len(sizes))), total
    while free:
        whole = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / whole > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / whole
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def plan(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> list[Source]:
    """The sources by code point, null last, with cycled weights."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError("too many sources")
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    size = [r["size"] for r in rows]
    total = sum(size)
    target = targets(size, [float(weights[i % len(weights)]) for i in range(len(rows))], share * total, most)
    least = -(-2 * total // MOST_BLOCKS)
    out = []
    for r, t in zip(rows, target, strict=True):
        block = max(1, least, min(BLOCK_WORDS, r["size"] // LEAST_BLOCKS))
        blocks = -(-r["size"] // block)
        out.append(Source(r["source"], r["size"], r["docs"], t, block, blocks, min(round(t / block), int(most * blocks))))
    return out


class Tree:
    """Which shard takes which position of each source's permuted blocks."""

    def __init__(self, quotas: list[int], shards: int, seed: int):
        self.quotas, self.shards, self.seed = np.array(quotas, dtype=np.int64), shards, seed
        self.total = int(self.quotas.sum())
        self.left = lru_cache(maxsize=4096)(self._left)
        self.quota = lru_cache(maxsize=4096)(self._quota)

    def _quota(self, low: int, high: int) -> np.ndarray:
        """Blocks of each source that shards low up to high take together."""
        if (low, high) == (0, self.shards):
            return self.quotas
        a, b = 0, self.shards
        while True:
            mid = (a + b) // 2
            if (low, high) == (a, mid):
                return self.left(a, b)
            if (low, high) == (mid, b):
                return self.quota(a, b) - self.left(a, b)
            a, b = (a, mid) if high <= mid else (mid, b)

    def _left(self, low: int, high: int) -> np.ndarray:
        """The draw of node [low, high): what its left half takes."""
        have = self.quota(low, high)
        mid = (low + high) // 2
        n = self.total * mid // self.shards - self.total * low // self.shards
        rng = np.random.default_rng([self.seed, low, high])
        return rng.multivariate_hypergeometric(have, min(n, int(have.sum())), method="marginals") if len(have) else have

    def shard(self, source: int, position: int) -> int:
        low, high = 0, self.shards
        while high - low > 1:
            mid, n = (low + high) // 2, int(self.left(low, high)[source])
            if position < n:
                high = mid
            else:
                position -= n
                low = mid
        return low


def permuted(n: int, x: int, key: int) -> int:
    """Where a seeded permutation of range(n) takes x: four Feistel rounds over the next power of four, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = x >> half, x & mask
        for i in range(4):
            a, b = b, a ^ ((((b + 1) * 0x9E3779B97F4A7C15 ^ (key + i) * 0xC2B2AE3D27D4EB4F) * 0xFF51AFD7ED558CCD & 0xFFFFFFFFFFFFFFFF) >> 29 & mask)
        x = a << half | b
        if x < n:
            return x


def word_counts(documents: DataFrame, *cols: str) -> DataFrame:
    """cols and size, the number of words of text, for each row."""
    tune(documents.sparkSession)
    rows = documents.select(*cols, "text")
    kinds = dict(rows.dtypes)

    def go(batches):
        for b in batches:
            n = [len(t.encode().split()) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array(n, pa.int64())], names=[*cols, "size"])

    return rows.mapInArrow(go, ", ".join([*(f"`{c}` {kinds[c]}" for c in cols), "size long"]))


def _keyed(documents: DataFrame, seed: int) -> DataFrame:
    return documents.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "source", "text"))


class Mix:
    """A drawn mix of documents. sources: what each one gives.

    A document is taken `most` times at most. A null text has no words and is never taken; a null source is a source of its own,
    the last one. The same rows, in whatever order or partitions, give the same mix. Repeated rows are drawn one by one.
    """

    def __init__(self, documents: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, shards: int | None = None, seed: int = 1):
        self.spark, self.documents, self.seed = documents.sparkSession, documents, seed
        sized = cut(word_counts(_keyed(documents, seed), "doc_id", "key", "source"))
        self.sources = plan(sized, weights, share, most)
        self.shards = shards or max(8, -(-int(sum(s.target for s in self.sources)) // SHARD_WORDS))
        known = self._table([(s.name, i, max(1, s.docs // BUCKET)) for i, s in enumerate(self.sources)], "source string, number int, buckets long")
        rows = sized.join(F.broadcast(known), sized["source"].eqNullSafe(known["source"])).drop(known["source"])
        unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "key"), 11) / float(1 << 53)
        rows = rows.withColumn("unit", unit).withColumn("bucket", F.floor(F.col("unit") * F.col("buckets")))
        ahead = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = rows.groupBy("number", "bucket").agg(F.sum("size").alias("words")).select("number", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
        within = Window.partitionBy("number", "bucket").orderBy("unit", "key").rowsBetween(Window.unboundedPreceding, -1)
        self.placed = rows.join(sums, ["number", "bucket"]).withColumn("start", F.col("ahead") + F.coalesce(F.sum("size").over(within), F.lit(0))).select("doc_id", "key", "source", "number", "size", "start")

    def _table(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def _each_row(self):
        """For each row of a batch: its pieces (shard, position, first_word, n_words)."""
        facts = self.spark.sparkContext.broadcast([(s.block, s.blocks, s.quota) for s in self.sources])
        shards, seed = self.shards, self.seed

        def go(tree: Tree, own: list, i: int, size: int, start: int):
            block, blocks, quota = own[i]
            for k in range(start // block, -(-(start + size) // block) if size else 0):
                low, high = max(start, k * block), min(start + size, (k + 1) * block)
                for position in range(permuted(blocks, k, seed * 1_000_003 + i), quota, blocks):
                    yield tree.shard(i, position), position, low - start, high - low

        def over(b: pa.RecordBatch):
            own = facts.value
            tree = Tree([q for _, _, q in own], shards, seed)
            for i, size, start in zip(*(b.column(c).to_pylist() for c in ("number", "size", "start")), strict=True):
                yield list(go(tree, own, i, size, start))

        return over

    def taken(self) -> DataFrame:
        """(doc_id, source, size, taken), one row for each row of documents: its words, and how many the mix takes, repeats counted."""
        over = self._each_row()

        def go(batches):
            for b in batches:
                n = [sum(x[3] for x in pieces) for pieces in over(b)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("size"), pa.array(n, pa.int64())], names=["doc_id", "source", "size", "taken"])

        return self.placed.mapInArrow(go, f"doc_id {self._id()}, source string, size long, taken long")

    def pieces(self) -> DataFrame:
        """(doc_id, key, size, shard, slot, first_word, n_words), one row for each piece; slot orders a shard. key finds the text."""
        over = self._each_row()
        names = ["doc_id", "key", "source", "size", "shard", "position", "first_word", "n_words"]
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64())

        def go(batches):
            for b in batches:
                found = list(over(b))
                at = pa.array(np.repeat(np.arange(b.num_rows), [len(x) for x in found]), pa.int64())
                cols = zip(*(y for x in found for y in x), strict=True) if len(at) else [[]] * 4
                shard, position, first, n = (pa.array(c, t) for c, t in zip(cols, types, strict=True))
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in names[:4]), shard, position, first, n], names=names)

        made = self.placed.mapInArrow(go, f"doc_id {self._id()}, key long, source string, size long, shard int, position long, first_word long, n_words long")
        slot = F.xxhash64(F.lit(self.seed), "shard", "source", "position", "first_word")
        return made.select("doc_id", "key", "size", "shard", slot.alias("slot"), "first_word", "n_words")

    def _id(self) -> str:
        return dict(self.documents.dtypes)["doc_id"]

    def texts(self) -> DataFrame:
        """The mix as documents (doc_id, text, lang, source, n_chars), a row for each piece, dealt out by shard and shuffled within.

        A piece that is not the whole document runs from its first word to where the next piece's first word starts.
        """
        tune(self.spark)
        texts = _keyed(self.documents.select("doc_id", "text", "lang", "source"), self.seed).dropDuplicates(["key"]).select("key", "text", "lang", "source")
        rows = self.pieces().join(texts, "key")

        def go(batches):
            for b in batches:
                part = [cut_words(*x) for x in zip(*(b.column(c).to_pylist() for c in ("text", "size", "first_word", "n_words")), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(part, pa.string()), b.column("lang"), b.column("source"), pa.array(map(len, part), pa.int64()), b.column("shard"), b.column("slot")], names=["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"])

        made = rows.select("doc_id", "text", "lang", "source", "size", "first_word", "n_words", "shard", "slot").mapInArrow(go, f"doc_id {self._id()}, text string, lang string, source string, n_chars long, shard int, slot long")
        dealt = made.repartition(self.shards, "shard").sortWithinPartitions("shard", "slot", "doc_id")
        return dealt.select("doc_id", "text", "lang", "source", "n_chars")


def cut_words(text: str, size: int, first: int, n: int) -> str:
    """n words of text from word `first`, with the white space after each; the text's ends go with its first and last words."""
    if n == size:
        return text
    at = [m.start() for m in _WORD.finditer(text)]
    return text[at[first] if first else 0 : at[first + n] if first + n < size else len(text)]
