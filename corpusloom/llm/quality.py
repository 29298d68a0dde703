"""Quality rules on repetition: a suffix array over words, its common prefixes, and limits on what repeats.

Suffixes of all documents of a batch are sorted together by prefix doubling; a word's first rank holds its document too, so
suffixes of different documents never compare equal. Where neighbours in the suffix array share min_words words or more, they
lie in one longest-common-prefix interval, that of a repeated substring. The union of the spans of all such intervals is what a
document repeats. Only positions that still share their rank are sorted again, so a batch costs little more than one sort of it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.common import few, most_parts, runs, tune, words

SYMBOLS = "#*$%&|<>"
#: UTF-8 bytes of text that are sorted together. A longer document is a batch of its own.
BATCH_BYTES = 2_000_000


@dataclass(frozen=True)
class Rules:
    """Limits. A document is kept if it breaks none of them.

    min_n_words: words it has at least. max_repeat_percent: words in windows of `window` words that occur twice or more.
    max_longest_repeat: words of its longest repeated substring. max_covered_percent: words under repeated substrings of
    `long_window` words or more.
    """

    window: int = 5
    min_n_words: int = 10
    max_repeat_percent: int = 20
    long_window: int = 10
    max_covered_percent: int = 20
    max_longest_repeat: int = 50


def suffix_ranks(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of the words `ids` (doc: ascending document numbers), and the ranks of prefixes of 1, 2, 4, ... words.

    A suffix ends with its document. Equal ranks at level k: the first 2**k words agree and none is missing.
    """
    n = len(ids)
    pair = doc.astype(np.int64) * (int(ids.max(initial=0)) + 1) + ids
    order = np.argsort(pair, kind="stable")
    key = pair[order]
    new = np.ones(n, dtype=bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]  # the place of the first of its equals
    levels, step = [rank], 1
    shared = ~(new & np.append(new[1:], True))  # places whose rank is shared
    while shared.any():
        at = np.flatnonzero(shared)
        here = order[at]
        there = here + step
        inside = there < n
        inside[inside] = doc[there[inside]] == doc[here[inside]]
        second = np.full(len(here), -1, dtype=np.int64)
        second[inside] = rank[there[inside]]
        second[~inside] = -1 - here[~inside]  # a suffix that ends is unlike any other
        group = rank[here]
        by = np.lexsort((second, group))
        here, group, second = here[by], group[by], second[by]
        fresh = np.ones(len(here), dtype=bool)
        fresh[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        order[at] = here
        rank = rank.copy()
        rank[here] = at[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        levels.append(rank)
        step *= 2
        shared = np.zeros(n, dtype=bool)
        shared[at] = ~(fresh & np.append(fresh[1:], True))
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours in the suffix array that share `least` words or more: both positions, and the number of words shared."""
    top = least.bit_length() - 1
    if top >= len(levels):
        return (np.zeros(0, dtype=np.int64),) * 3
    a, b = order[:-1], order[1:]
    alike = levels[top][a] == levels[top][b]
    a, b = a[alike], b[alike]
    i, j, lcp = a.copy(), b.copy(), np.zeros(len(a), dtype=np.int64)
    n = len(order)
    for k in range(len(levels) - 1, -1, -1):
        while True:  # the top level can hold more than once
            ok = (i < n) & (j < n)
            ok[ok] = levels[k][i[ok]] == levels[k][j[ok]]
            if not ok.any():
                break
            i[ok] += 1 << k
            j[ok] += 1 << k
            lcp[ok] += 1 << k
    enough = lcp >= least
    return a[enough], b[enough], lcp[enough]


def repetition(docs: list[list], windows: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each w of windows (ascending), each document's words under substrings of w words or more that occur twice or more in
    it; and the words of its longest one, 0 if none has windows[0] words.
    """
    size = np.fromiter(map(len, docs), dtype=np.int64, count=len(docs))
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for d in docs for w in d), dtype=np.int64, count=int(size.sum()))
    longest = np.zeros(len(docs), dtype=np.int64)
    if not len(ids):
        return [longest.copy() for _ in windows], longest
    doc = np.repeat(np.arange(len(docs)), size)
    a, b, lcp = common_prefixes(*suffix_ranks(ids, doc), windows[0])
    np.maximum.at(longest, doc[a], lcp)
    covered = []
    for w in windows:
        use = lcp >= w
        edge = np.zeros(len(ids) + 1, dtype=np.int64)
        for start in (a[use], b[use]):
            np.add.at(edge, start, 1)
            np.add.at(edge, start + lcp[use], -1)
        covered.append(np.bincount(doc, weights=np.cumsum(edge[:-1]) > 0, minlength=len(docs)).astype(np.int64))
    return covered, longest


def measures(texts: list[str | None], rules: Rules) -> dict[str, list | np.ndarray]:
    """The counts of each text, and the verdicts."""
    split = [words(t) for t in texts]
    n = np.fromiter(map(len, split), dtype=np.int64, count=len(texts))
    (repeat, long), longest = repetition(split, (rules.window, rules.long_window))
    chars, symbols, dup = [], [], []
    for t in texts:
        t = t or ""
        chars.append(len(t) - sum(map(t.count, " \t\n\x0b\x0c\r")))
        symbols.append(sum(map(t.count, SYMBOLS)))
        lines = [x for x in t.split("\n") if x.strip(" \t\x0b\x0c\r")]
        dup.append(len(lines) - len(set(lines)))
    failed = (n < rules.min_n_words) | (100 * repeat > rules.max_repeat_percent * n)
    kept = ~failed & (100 * long <= rules.max_covered_percent * n) & (longest <= rules.max_longest_repeat)
    return {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "longest_repeat": longest, "n_long_repeat_words": long, "base_failed": failed, "kept": kept}


_KINDS = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "longest_repeat": pa.int64(), "n_long_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_()}


def judge(documents: DataFrame, rules: Rules = Rules(), carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each row of documents: the columns of `carry`, the counts of the whole text, base_failed and kept.

    A null or empty text has no words and fails. Repeated rows are judged one by one; other columns are not read. No shuffle.
    """
    tune(documents.sparkSession)
    rows = documents.select(*dict.fromkeys((*carry, "text")))
    names = [*carry, *_KINDS]

    def go(batches):
        for b in batches:
            start = 0
            for texts in runs([b.column("text").to_pylist()], BATCH_BYTES, lambda t: 4 * len(t or "")):
                found = measures(texts, rules)
                part = b.slice(start, len(texts))
                start += len(texts)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), *(pa.array(found[k], kind) for k, kind in _KINDS.items())], names=names)

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), *(f"{k} {'boolean' if v == pa.bool_() else 'long'}" for k, v in _KINDS.items())])
    return rows.mapInArrow(go, schema)


def accepted(documents: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """documents (doc_id, text, lang, source, n_chars) without those that a rule rejects."""
    cols = ("doc_id", "text", "lang", "source", "n_chars")
    return few(judge(documents, rules, cols), most_parts(documents)).where("kept").select(*cols)
