"""MinHash near-dedup with an LSH forest: sorted signature orders, common prefixes as candidates, depth adapted to the region.

1. Every row gets its set of word shingles as 64-bit hashes, a digest of the set, and a MinHash signature. Rows with the same set
   collapse to the smallest doc_id before anything else, so thousands of exact copies cost no more than one.
2. A tree of the forest is one order of the signature's values. All trees' rows are dealt out by ranges of (tree, order) and
   sorted, so a region of alike documents may span many tasks. A region is a run of rows with DEPTH first values in common;
   one with more than SMALL rows is split by further values, as deep as the key goes, until its parts are small or end.
3. First each row of a region is held against the region's smallest id: a star, as many pairs as rows. After those links
   are joined into components, only rows of one part (SMALL rows at most) whose components still differ are paired.
4. Rows of a region of more than SMALL rows are paired by prefix filter if their components differ: of two sets as alike as
   asked, the rarest shingles meet. This is exact, whatever signatures say, so that the depth of a region loses no pair.
5. Every pair is confirmed on the full sets; a link is never assumed from signatures.
6. Rows that share a doc_id are one document: their sets are joined whatever they hold.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from corpusloom.llm.common import cut, few, most_parts, tune

#: Values of a signature, trees, values between the starts of two trees' orders, values of a key, and of a region.
VALUES, TREES, STRIDE, KEY, DEPTH = 128, 24, 5, 8, 4
#: A region with more rows is split by further values.
SMALL = 64

#: Pairs of one row that a copy of its text serves in confirmation.
HEAD_PAIRS = 1000
#: Such rows up to this number are broadcast as ids (about 2 MB); more meet their pairs by a shuffle.
MOST_HEADS = 100_000

#: Links up to this number are joined into components by one task, in some 30 bytes each and their sort; more go round by round.
MOST_LINKS = 4_000_000

#: Keys that the driver samples for the ranges of the forest, some three times as many at most, whatever the number of partitions.
RANGE_KEYS = 20_000

#: Cells of the counts by which shingles are ranked, rarest first. Any ranking is right; a better one gives fewer pairs.
CELLS, SUMS = 1 << 18, 16

#: Cells of a set's parities.
ODD = 1024

_rng = np.random.default_rng(20)
_A = _rng.integers(1, 1 << 63, VALUES, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_PLACES = (np.arange(TREES)[:, None] * STRIDE + np.arange(KEY)[None, :]) % VALUES
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """64-bit hashes of words, within a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        found = self[word] = xxh3_64_intdigest(word)
        return found


_hashes = _Hashes()


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of `size` words, A-Z lower-cased; one of all words if there are fewer; else none."""
    found = text.encode().lower().split() if text else []
    if not found:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, found), dtype=np.uint64, count=len(found))
    size = min(size, len(h))
    out = h[: len(h) - size + 1].copy()
    for k in range(1, size):
        out ^= out >> np.uint64(29)
        out *= _ODD
        out += h[k : len(h) - size + 1 + k]
    out ^= out >> np.uint64(32)
    out *= _ODD
    return np.unique(out)


def signature(found: np.ndarray) -> bytes:
    """The smallest of each of VALUES hashes over the set, big-endian so that bytes sort as numbers do."""
    least = np.full(VALUES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(found), 2048):
        h = ((found[at : at + 2048, None] * _A + _B) >> np.uint64(32)).astype(np.uint32)
        np.minimum(least, h.min(axis=0), out=least)
    return least.astype(">u4").tobytes()


def parities(found: np.ndarray) -> np.ndarray:
    """ODD bits, each the parity of the members that a hash puts there, as 64-bit integers."""
    cells = np.bincount(((found * _ODD) >> np.uint64(54)).astype(np.int64), minlength=ODD) & 1
    return np.packbits(cells.astype(np.uint8)).view(np.int64)


def sketches(documents: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, digest, sig, odd) for each row of documents."""
    rows = documents.select("doc_id", "text")

    def go(batches):
        for b in batches:
            n, digest, sig, odd = [], [], [], []
            for text in b.column("text").to_pylist():
                found = shingles(text, size)
                n.append(len(found))
                digest.append(xxh3_128_digest(found.tobytes()))
                sig.append(signature(found) if len(found) else b"")
                odd.append(parities(found))
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * (ODD // 64)), pa.array(np.concatenate([*odd, np.zeros(0, dtype=np.int64)])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), cells], names=["doc_id", "n", "digest", "sig", "odd"])

    return rows.mapInArrow(go, "doc_id long, n long, digest binary, sig binary, odd array<long>")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), dtype=">u4").reshape(-1, VALUES)
        ids = b.column("id").to_numpy()
        keys = sig[:, _PLACES].reshape(-1, KEY)
        data = pa.Array.from_buffers(pa.binary(4 * KEY), len(keys), [None, pa.py_buffer(np.ascontiguousarray(keys).tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(ids))), data.cast(pa.binary()), pa.array(np.repeat(ids, TREES))], names=["tree", "key", "id"])


STAR, HEAD, MEMBER, REGION = 0, 1, 2, 3


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over one sorted range: (STAR, id, smallest id of its run), (HEAD, region, smallest id) of the first and last run, which
    may go on in another range, (MEMBER, part, id), and (REGION, region, id) of regions that are split
    here or, as the first and last run, perhaps in another range."""
    tree, key, ids = np.zeros(0, dtype=np.int32), np.zeros((0, KEY), dtype=">u4"), np.zeros(0, dtype=np.int64)
    first = True

    def named(t: int, prefix: np.ndarray) -> int:
        return xxh3_64_intdigest(bytes([t, len(prefix)]) + prefix.tobytes()) - (1 << 63)

    def parts(k: np.ndarray, at: np.ndarray, depth: int):
        if len(at) <= SMALL:
            if len(at) > 1:
                yield at, depth
            return
        if depth == KEY:
            return  # its rows are REGION rows too, and meet by prefix filter
        cuts = np.flatnonzero(k[at[1:], depth] != k[at[:-1], depth]) + 1
        for part in np.split(at, cuts):
            yield from parts(k, part, depth + 1)

    def made(t, k, i, is_first: bool, is_last: bool) -> pa.RecordBatch:
        kinds, a, b = [], [], []
        if len(i):
            new = np.append(True, (t[1:] != t[:-1]) | (k[1:, :DEPTH] != k[:-1, :DEPTH]).any(axis=1))
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(i))
            some = np.flatnonzero(ends - starts > 1).tolist()
            for r in some:
                s, e = starts[r], ends[r]
                head = int(i[s:e].min())
                for x in i[s:e].tolist():
                    if x != head:
                        kinds.append(STAR)
                        a.append(x)
                        b.append(head)
                for at, depth in parts(k, np.arange(s, e), DEPTH):
                    name = named(int(t[s]), k[at[0], :depth])
                    kinds += [MEMBER] * len(at)
                    a += [name] * len(at)
                    b += i[at].tolist()
                if e - s > SMALL:
                    kinds += [REGION] * (e - s)
                    a += [named(int(t[s]), k[s, :DEPTH])] * (e - s)
                    b += i[s:e].tolist()
            for r in {*([0] if is_first else []), *([len(starts) - 1] if is_last else [])}:
                kinds.append(HEAD)
                a.append(named(int(t[starts[r]]), k[starts[r], :DEPTH]))
                b.append(int(i[starts[r] : ends[r]].min()))
                if ends[r] - starts[r] <= SMALL:
                    kinds += [REGION] * (ends[r] - starts[r])
                    a += [a[-1]] * (ends[r] - starts[r])
                    b += i[starts[r] : ends[r]].tolist()
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"])

    for batch in batches:
        tree = np.concatenate([tree, batch.column("tree").to_numpy()])
        key = np.concatenate([key, np.frombuffer(b"".join(batch.column("key").to_pylist()), dtype=">u4").reshape(-1, KEY)])
        ids = np.concatenate([ids, batch.column("id").to_numpy()])
        if not len(ids):
            continue
        new = (tree[1:] != tree[:-1]) | (key[1:, :DEPTH] != key[:-1, :DEPTH]).any(axis=1)
        last = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0  # the last run may go on
        if last:
            yield made(tree[:last], key[:last], ids[:last], first, False)
            first = False
            tree, key, ids = tree[last:], key[last:], ids[last:]
    yield made(tree, key, ids, first, True)


def forest(reps: DataFrame) -> DataFrame:
    """(kind, a, b) of _regions() for reps (id, sig)."""
    rows = reps.select("id", "sig").mapInArrow(_keys, "tree int, key binary, id long")
    n = max(int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartitionByRange(n, "tree", "key", "id").sortWithinPartitions("tree", "key", "id").mapInArrow(_regions, "kind int, a long, b long")


def few_range_keys(spark: SparkSession, run: Callable[[], DataFrame]) -> DataFrame:
    """run(), where a range exchange samples fewer keys a partition if there are many partitions: the sample goes to the driver, and
    ranges need only be about even."""
    name = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    before, n = spark.conf.get(name, None), max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    spark.conf.set(name, str(min(int(before or 100), max(RANGE_KEYS // n, 10))))
    try:
        return run()
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int, bounded: bool = False, parts: int | None = None) -> DataFrame:
    """Those of pairs (lo, hi; bounded: no row is in many) whose full shingle sets, from texts (id, text), have 100 * intersection >= percent * union. parts: as in cut()."""

    def go(batches):
        held, left = None, None
        for b in batches:
            keep = []
            for lo, x, y in zip(*(b.column(c).to_pylist() for c in ("lo", "x", "y")), strict=True):
                if (lo, x) != held:
                    held, left = (lo, x), shingles(x, size)
                right = shingles(y, size)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([b.column("lo"), b.column("hi")], names=["lo", "hi"]).filter(pa.array(keep, pa.bool_()))

    # A row that is held against many others is copied, once for each HEAD_PAIRS of them, so that no task gets all its pairs.
    right, left = texts.select(F.col("id").alias("hi"), F.col("text").alias("y")), texts.select(F.col("id").alias("lo"), F.col("text").alias("x"))
    heavy = None if bounded else cut(pairs.groupBy("lo").agg(F.count("*").alias("n")).where(F.col("n") > HEAD_PAIRS).select("lo", F.ceil(F.col("n") / HEAD_PAIRS).cast("int").alias("copies")), parts)
    n = heavy.count() if heavy is not None else 0
    if n == 0:
        rows = pairs.join(right, "hi").join(left, "lo")
    else:
        heavy = F.broadcast(heavy) if n <= MOST_HEADS else heavy
        salted = pairs.join(heavy, "lo", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("hi"), F.col("copies")), F.lit(0)).cast("int")).drop("copies")
        left = left.join(heavy, "lo", "left").select("lo", "x", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("copies"), F.lit(1)) - 1)).alias("salt"))
        rows = salted.join(right, "hi").join(left, ["lo", "salt"])
    return rows.select("lo", "hi", "x", "y").mapInArrow(go, "lo long, hi long")


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links (lo, hi) to (id, label). Roots hook onto smaller roots, until no link joins two."""
    both = [[np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]]
    for b in batches:
        for x, col in zip(both, ("lo", "hi"), strict=True):
            x.append(b.column(col).to_numpy())
    ids, ends = np.unique(np.stack([np.concatenate(x) for x in both]), return_inverse=True)
    lo, hi = ends.reshape(2, -1)
    label = np.arange(len(ids))
    while True:
        a, b = label[lo], label[hi]
        open_links = a != b
        if not open_links.any():
            break
        lo, hi = lo[open_links], hi[open_links]
        np.minimum.at(label, np.maximum(a, b)[open_links], np.minimum(a, b)[open_links])
        while (label[label] != label).any():
            label = label[label]
    for at in range(0, len(ids), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 100_000]), pa.array(ids[label[at : at + 100_000]])], names=["id", "label"])


def components(links: DataFrame, most: int = MOST_LINKS) -> DataFrame:
    """(id, label): the smallest id that links (lo, hi) reach from each id they hold. One task joins up to `most` links, so that the
    driver plans one job; of more, labels spread and then jump, round by round."""
    if links.count() <= most:
        return cut(links.select("lo", "hi").repartition(1).mapInArrow(_united, "id long, label long"))
    both = cut(links.union(links.select("hi", "lo")).toDF("src", "dst").distinct())
    labels = cut(both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.col("id")).alias("label")))
    while True:
        near = both.join(labels, both["dst"] == labels["id"]).groupBy("src").agg(F.min("label").alias("low"))
        spread = labels.join(near, labels["id"] == near["src"]).select("id", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        onward = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        now = cut(spread.join(onward, "label", "left").select("id", "old", F.least("label", "far").alias("label")))
        if now.where("label <> old").isEmpty():
            return now.select("id", "label")
        labels = now.select("id", "label")


def _pairs(df: DataFrame, a: Column, b: Column) -> DataFrame:
    return df.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo <> hi").distinct()


def _prefixes(percent: int, size: int, ranks):
    """(id, label, text) to the rarest shingles of each set, as many as must meet one of any other set that is alike.

    ranks.value has counts by cell. `short` marks those that suffice of the smaller of two sets. A shingle of one set is left out.
    """

    def go(batches):
        counts = ranks.value
        for b in batches:
            out: list[list[np.ndarray]] = [[np.zeros(0, dtype=np.int64)] for _ in range(6)]
            for i, label, text in zip(*(b.column(c).to_pylist() for c in ("id", "label", "text")), strict=True):
                found = shingles(text, size)
                n = len(found)
                count = counts[_cells(found)]
                pos = np.lexsort((found, count))[: n + 1 - -(-percent * n // 100)]
                at = np.flatnonzero(count[pos] > 1)
                short = at < n + 1 - -(-2 * percent * n // (100 + percent))
                for x, col in zip(out, (found[pos[at]].view(np.int64), np.full(len(at), i), np.full(len(at), label), np.full(len(at), n), at, short), strict=True):
                    x.append(col)
            cols = [np.concatenate(x) for x in out]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols[:5]), pa.array(cols[5].astype(bool))], names=["shingle", "id", "label", "n", "pos", "short"])

    return go


def _cells(found: np.ndarray) -> np.ndarray:
    return (found % np.uint64(CELLS)).astype(np.int64)


def _ranks(rows: DataFrame, size: int) -> np.ndarray:
    """How many sets of rows (text) have a shingle of each cell: CELLS counts, whatever the number of rows. Each task sums up its own
    rows, SUMS tasks sum up these, and the driver those: 1 MB each at most."""

    def go(batches):
        counts = np.zeros(CELLS, dtype=np.int64)
        for b in batches:
            for text in b.column("text").to_pylist():
                np.add.at(counts, _cells(shingles(text, size)), 1)
        yield pa.RecordBatch.from_arrays([pa.array([_packed_counts(counts)], pa.binary())], names=["counts"])

    def merged(batches):
        counts = np.zeros(CELLS, dtype=np.int64)
        for b in batches:
            for packed in b.column("counts"):
                counts += _unpacked_counts(packed.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([_packed_counts(counts)], pa.binary())], names=["counts"])

    parts = rows.select("text").mapInArrow(go, "counts binary").repartition(SUMS).mapInArrow(merged, "counts binary")
    total = np.zeros(CELLS, dtype=np.int64)
    for packed in parts.toArrow().column("counts"):
        total += _unpacked_counts(packed.as_py())
    return np.minimum(total, np.iinfo(np.int32).max).astype(np.int32)


def _packed_counts(counts: np.ndarray) -> bytes:
    return zlib.compress(np.minimum(counts, np.iinfo(np.int32).max).astype(np.int32).tobytes(), 1)


def _unpacked_counts(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), dtype=np.int32).astype(np.int64)


def set_apart(found: DataFrame, labels: DataFrame, reps: DataFrame, texts: DataFrame, size: int, percent: int, parts: int | None = None) -> DataFrame | None:
    """Pairs (lo, hi) of different labels (id, label) that may be alike, among rows of regions that were split and have more than
    one label: all that are alike, by prefix filter, and few others. None if there are no such rows. parts: as in cut()."""
    members = found.where(F.col("kind") == REGION).select(F.col("a").alias("region"), F.col("b").alias("id"))
    members = members.join(labels, "id", "left").select("region", "id", F.coalesce("label", "id").alias("label"))
    open_regions = members.groupBy("region").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("region")
    ids = cut(members.join(open_regions, "region", "left_semi").select("id", "label").distinct(), parts)
    if ids.isEmpty():
        return None
    rows = cut(texts.join(ids, "id").select("id", "label", "text"), parts)
    ranks = rows.sparkSession.sparkContext.broadcast(_ranks(rows, size))
    x = cut(rows.mapInArrow(_prefixes(percent, size, ranks), "shingle long, id long, label long, n long, pos long, short boolean"), parts)
    y = x.select("shingle", *(F.col(c).alias(f"{c}2") for c in ("id", "label", "n", "pos")))
    most = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))  # shingles in common, if this is the first
    fits = (F.struct("n", "id") < F.struct(F.col("n2").alias("n"), F.col("id2").alias("id"))) & (F.col("label") != F.col("label2")) & ((100 + percent) * most >= percent * (F.col("n") + F.col("n2")))
    pairs = _pairs(x.where("short").join(y, "shingle").where(fits), F.col("id"), F.col("id2"))
    odd = reps.select("id", "n", "odd")
    rows = pairs.join(odd.toDF("lo", "n", "odd"), "lo").join(odd.toDF("hi", "n2", "odd2"), "hi")
    return rows.where(_alike(percent)).select("lo", "hi").distinct()


def _alike(percent: int) -> Column:
    """Whether sets of n and n2 members with parities odd and odd2 may be alike."""
    apart = sum((F.bit_count(F.col("odd")[k].bitwiseXOR(F.col("odd2")[k])) for k in range(ODD // 64)), F.lit(0))
    return (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")) & ((100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("n2")))


def _same_document(all_rows: DataFrame, reps: DataFrame) -> DataFrame:
    """(doc_id, id, low) for each set of a doc_id that has several: the set's representative, null if it is empty, and the smallest
    representative of the doc_id's sets."""
    rows = all_rows.where("doc_id is not null").select("doc_id", "digest").distinct()
    several = rows.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("doc_id")
    found = rows.join(several, "doc_id", "left_semi").join(reps.select("digest", "id"), "digest", "left")
    return found.join(found.groupBy("doc_id").agg(F.min("id").alias("low")), "doc_id").select("doc_id", "id", "low")


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of documents.

    A null or empty text, or one of white space, has an empty set and is linked with nothing. A document is known by its doc_id:
    rows that share one are one document, linked with what either is linked with. A row whose doc_id is null takes no part: its
    component is null and it is kept. Other columns are not read.
    """
    tune(documents.sparkSession)
    all_rows = cut(sketches(documents, size))
    parts = most_parts(all_rows)
    sets = all_rows.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("odd").alias("odd"))
    reps = cut(sets, parts)
    found = few_range_keys(reps.sparkSession, lambda: cut(forest(reps), parts))
    heads = found.where(F.col("kind") == HEAD)
    across = heads.join(heads.groupBy("a").agg(F.min("b").alias("low")), "a").select(F.col("b"), "low")
    stars = cut(_pairs(found.where(F.col("kind") == STAR).select("a", "b").union(across.toDF("a", "b")), F.col("a"), F.col("b")), parts)
    wanted = found.where(F.col("kind") == MEMBER).select(F.col("b").alias("id")).union(stars.select("lo")).union(stars.select("hi")).distinct()
    texts = cut(documents.select(F.col("doc_id").alias("id"), "text").join(wanted, "id"), parts)
    same = cut(_same_document(all_rows, reps), parts)
    several = not same.isEmpty()
    links = cut(confirmed(stars, texts, size, percent, parts=parts), parts)
    if several:
        links = links.union(same.where("id is not null").select(F.col("low").alias("lo"), F.col("id").alias("hi")).where("lo <> hi"))
    labels = components(links)
    members = found.where(F.col("kind") == MEMBER).select(F.col("a").alias("part"), F.col("b").alias("id"))
    members = members.join(labels, "id", "left").select("part", "id", F.coalesce("label", "id").alias("label"))
    open_parts = members.groupBy("part").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("part")
    rest = cut(members.join(open_parts, "part", "left_semi").join(reps.select("id", "n", "odd"), "id").select("part", "id", "label", "n", "odd"), parts)
    other = rest.toDF("part", "id2", "label2", "n2", "odd2")
    more = rest.join(other, (rest["part"] == other["part"]) & (F.col("id") < F.col("id2")) & (F.col("label") != F.col("label2")) & _alike(percent)).select(F.col("id").alias("lo"), F.col("id2").alias("hi")).distinct()
    more = cut(more.join(stars, ["lo", "hi"], "left_anti"), parts)
    if not more.isEmpty():
        links = links.union(cut(confirmed(more, texts, size, percent, bounded=True), parts))  # at most SMALL - 1 in each tree
        labels = components(links)
    far = set_apart(found, labels, reps, texts, size, percent, parts)
    if far is not None:
        far = cut(far.join(stars, ["lo", "hi"], "left_anti").join(more, ["lo", "hi"], "left_anti"), parts)
        if not far.isEmpty():
            labels = components(links.union(cut(confirmed(far, texts, size, percent, parts=parts), parts)))
    classes = reps.join(labels, "id", "left").select("digest", F.coalesce("label", "id").alias("class"))
    out = all_rows.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(classes, "digest", "left")
    whole = F.lit(None).cast("long")
    if several:  # a row without words of a document that has other rows goes where those go
        others = same.where("id is not null").select("doc_id", F.col("low").alias("id")).distinct().join(labels, "id", "left").select("doc_id", F.coalesce("label", "id").alias("whole"))
        out, whole = out.join(others, "doc_id", "left"), F.col("whole")
    component = F.coalesce(F.col("class"), whole, F.col("doc_id"))
    return few(out, parts).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """documents (doc_id, text, lang, source, n_chars) with one row of each component: that of its smallest doc_id.

    Of repeated rows of a kept doc_id all stay alike; rows without a doc_id stay.
    """
    gone = near_duplicates(documents, size, percent).where("not kept").select("doc_id").distinct()
    return few(documents.select("doc_id", "text", "lang", "source", "n_chars").join(gone, "doc_id", "left_anti"), most_parts(documents))
