"""The mix against a plain version: what each document gives, and which shard each piece goes to."""

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import mixing

SEED = 1


def plain_targets(sizes, weights, total, most=2.0):
    capped = set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(most * sizes[i] for i in capped)
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if share[i] > most * sizes[i]}
        if not over:
            return [most * sizes[i] if i in capped else share[i] for i in range(len(sizes))]
        capped |= over


def plain_mix(rows):
    """(doc_id, source, words taken) and words by source and block, from rows (doc_id, source, text, key, order)."""
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    words = lambda r: len((r.text or "").encode().split())
    sizes = [sum(map(words, by[s])) for s in names]
    want = plain_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(sizes))
    taken, quotas = [], []
    for i, (s, size, target) in enumerate(zip(names, sizes, want)):
        block = max(1, min(1024, size // 250))
        blocks = -(-size // block)
        quota = min(round(target / block), 2 * blocks)
        quotas.append(quota)
        times = Counter(p % blocks for p in range(quota)) if blocks else Counter()
        start = 0
        for r in sorted(by[s], key=lambda r: ((r.order % (1 << 64)) >> 11, r.key)):
            n = words(r)
            # word by word, without any arithmetic on blocks' ends
            taken.append((r.doc_id, s, sum(times[mixing.permuted(blocks, w // block, SEED * 1_000_003 + i)] for w in range(start, start + n))))
            start += n
    return taken, quotas


def test_each_document_gives_what_a_plain_mix_takes(spark, documents):
    cols = documents.select("doc_id", "source", "text", F.xxhash64(F.lit(SEED), "doc_id", "source", "text").alias("key"))
    rows = cols.withColumn("order", F.xxhash64(F.lit(SEED), "key")).collect()
    want, quotas = plain_mix(rows)
    mix = mixing.Mix(documents, shards=5)
    assert [s.quota for s in mix.sources] == quotas
    got = [(r.doc_id, r.source, r.taken) for r in mix.taken().collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_shards_are_those_of_a_plain_tree():
    quotas, shards, seed = [40, 3, 0, 17], 5, 9
    total = sum(quotas)

    def deal(low, high, have):
        if high - low == 1:
            return {low: have}
        mid = (low + high) // 2
        n = total * mid // shards - total * low // shards
        left = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(np.array(have), n, method="marginals").tolist()
        return deal(low, mid, left) | deal(mid, high, [a - b for a, b in zip(have, left)])

    want = deal(0, shards, quotas)
    tree = mixing.Tree(quotas, shards, seed)
    for i, q in enumerate(quotas):
        assert Counter(tree.shard(i, p) for p in range(q)) == Counter({s: have[i] for s, have in want.items() if have[i]})
