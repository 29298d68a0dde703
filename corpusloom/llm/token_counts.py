"""Token counts by a two-tier lookup on the map side; no pre-token is ever shuffled.

Words between spaces and line feeds are the unit of lookup: white space never lies inside a pre-token of the tokenizer, so a
text has as many tokens as its words have. A first pass over all documents keeps a bounded sketch of each partition's most
frequent words (counts that may be too low, never too high); the sketches are merged in a tree, `SKETCH` words at most at every step.
The tokens of the words that stay are counted once, on the driver, and broadcast as a hash table from word to length. Any other
word goes to the worker's own bounded memory, or at last to the tokenizer itself. The table changes the cost, never a result.
"""

from __future__ import annotations

import pickle
from collections import Counter
from heapq import nlargest

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.common import tune

#: Words of a sketch, and so of the broadcast table (about 1 MB). Counters a task holds before it forgets the rarest ones.
SKETCH, HELD = 16_384, 300_000
#: Entries of a worker's memory; it starts anew when full.
MEMORY = 600_000
#: A longer word isn't kept in any table, only counted.
LONGEST = 64


def split(text: str | None) -> list[str]:
    """The words between spaces and line feeds; some may be empty."""
    return text.replace("\n", " ").split(" ") if text else []


def _bounded(counts: Counter, most: int) -> Counter:
    return counts if len(counts) <= most else Counter(dict(nlargest(most, counts.items(), key=lambda x: (x[1], x[0]))))


def _sketch(batches):
    counts: Counter = Counter()
    for b in batches:
        for text in b.column("text").to_pylist():
            counts.update(split(text))
            if len(counts) > HELD:
                counts = _bounded(counts, HELD // 4)
    counts = Counter({w: n for w, n in _bounded(counts, SKETCH + 1).items() if 0 < len(w) <= LONGEST and n > 1})
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(dict(_bounded(counts, SKETCH)))], pa.binary())], names=["sketch"])


def _merge(a: bytes, b: bytes) -> bytes:
    both = Counter(pickle.loads(a))
    both.update(pickle.loads(b))
    return pickle.dumps(dict(_bounded(both, SKETCH)))


def frequent_words(documents: DataFrame) -> list[str]:
    """The most frequent words, SKETCH at most, by merging the partitions' sketches in a tree of three levels."""
    tune(documents.sparkSession)
    sketches = documents.select("text").mapInArrow(_sketch, "sketch binary").rdd.map(lambda r: bytes(r[0]))
    return sorted(pickle.loads(sketches.treeReduce(_merge, 3)) if sketches.getNumPartitions() else ())


def splits_at_spaces(tokenizer) -> bool:
    """Whether no pre-token of a tokenizer, and nothing that stands for it, holds a space or line feed, so that words can be looked up alone."""
    probe = " a  b1 \n c,d \ne's  F  "
    if tokenizer.pre_tokenizer is None:
        return False
    text = tokenizer.normalizer.normalize_str(probe) if tokenizer.normalizer else probe
    if "".join(p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)) != "".join(text.split()):
        return False
    alone = [i for w in split(probe) if w for i in tokenizer.encode(w, add_special_tokens=False).ids]
    return tokenizer.encode(probe, add_special_tokens=False).ids == alone


class Lengths(dict):
    """The number of tokens of a word."""

    def __init__(self, tokenizer: str, table: dict[str, int]):
        from tokenizers import Tokenizer

        super().__init__(table)
        self.table = table
        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()

    def __missing__(self, word: str) -> int:
        n = len(self.tokenizer.encode(word, add_special_tokens=False).ids) if word else 0
        if len(word) <= LONGEST:
            self[word] = n
        return n

    def learn(self, words: set[str]) -> None:
        """Counts new words, many at a time."""
        if len(self) + len(words) > MEMORY + len(self.table):
            self.clear()
            self.update(self.table)
        new = [w for w in words if w and w not in self]
        for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self[w] = len(e.ids)
        self[""] = 0


_made: dict[int, Lengths] = {}


def count_tokens(documents: DataFrame, tokenizer_path: str, carry: tuple[str, ...] = ("doc_id",), limit: int = 2048) -> DataFrame:
    """The columns of `carry`, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit), one row for each row of documents.

    tokenizer_path: a .json file of the tokenizers library (64 MB at most). Where its pre-tokens may hold white space, as in byte-level
    vocabularies, the library counts whole texts, since no word can be looked up alone; no begin, end
    or other special tokens are added, special strings inside a text count as the library counts them. A null or empty text has 0
    bytes and tokens. Repeated rows are counted one by one; other columns are not read.
    """
    spark = documents.sparkSession
    tune(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        model = f.read()
    if len(model) > 64_000_000:
        raise ValueError("the tokenizer is larger than 64 MB")
    table = Lengths(model, {})
    by_word = splits_at_spaces(table.tokenizer)
    if by_word:
        table.learn(set(frequent_words(documents)))
    shared = spark.sparkContext.broadcast((model, dict(table)))
    rows = documents.select(*dict.fromkeys((*carry, "text")))
    kinds = dict(rows.dtypes)
    key = hash((tokenizer_path, id(shared), len(table)))

    def go(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if key not in _made:
            _made.clear()
            _made[key] = Lengths(*shared.value)
        lengths = _made[key]
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                texts = part.column("text").to_pylist()
                if by_word:
                    split_texts = [split(t) for t in texts]
                    lengths.learn({w for s in split_texts for w in s if w not in lengths})
                    n = [sum(map(lengths.__getitem__, s)) for s in split_texts]
                else:
                    n = [len(e.ids) for e in lengths.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
                size = [len(t.encode()) if t else 0 for t in texts]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[*carry, "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(go, ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "n_bytes long, n_tokens long, over_limit boolean"]))
