"""Near-dedup of all documents of sf0.1 against all pairs that an exact search finds."""

import os
import random
from collections import defaultdict

import pytest

from corpusloom.llm import near_dedup

BIG = "/root/testdata/sf0.1"


def exact_links(rows, size, percent):
    """All pairs of rows with 100 * intersection >= percent * union, by prefix filter over plain sets."""
    sets, count = {}, defaultdict(int)
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + min(size, len(w))]) for i in range(max(1, len(w) - size + 1))} if w else set()
        for g in sets[d]:
            count[g] += 1
    held, pairs = defaultdict(list), set()
    for d, s in sorted(sets.items(), key=lambda x: len(x[1])):
        n = len(s)
        for g in sorted(s, key=lambda g: (count[g], g))[: n + 1 - -(-percent * n // 100)]:
            if count[g] > 1:
                pairs.update((o, d) for o in held[g] if 100 * len(sets[o]) >= percent * n)
                held[g].append(d)
    return [(a, b) for a, b in pairs if 100 * (both := len(sets[a] & sets[b])) >= percent * (len(sets[a]) + len(sets[b]) - both)]


@pytest.mark.skipif(not os.path.isdir(BIG), reason="needs sf0.1")
@pytest.mark.parametrize("size", [2, 5])
def test_no_link_is_lost(spark, size, capsys):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, size, 80).collect()}
    links = exact_links([tuple(r) for r in docs.collect()], size, 80)
    lost = sum(got[a] != got[b] for a, b in links)
    up = {d: d for d in got}

    def root(d):
        while up[d] != d:
            up[d] = up[up[d]]
            d = up[d]
        return d

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    with capsys.disabled():
        print(f"\nsf0.1, {size}-word shingles: {lost} of {len(links)} links lost", end="")
    assert len(links) > 100 and lost == 0 and all(got[d] == root(d) for d in got)


@pytest.mark.parametrize("most", [0, near_dedup.MOST_LINKS])
def test_components_of_chains_rings_and_stars(spark, most):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(100, 108)] + [(7, 90), (8, 90), (8, 91), (7, 91), (7, 91)] + [(200, k) for k in range(201, 210)] + [(k, -k) for k in (300, 301)]
    ids = list({x for link in links for x in link})
    name = dict(zip(ids, rng.sample(range(-(1 << 61), 1 << 61), len(ids)), strict=True))
    links = [tuple(sorted((name[a], name[b]))) for a, b in links]
    want = {name[x]: name[x] for x in ids}
    while any(want[a] != want[b] for a, b in links):
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    rows = spark.createDataFrame(rng.sample(links, len(links)), "lo long, hi long").repartition(4)
    assert {r.id: r.label for r in near_dedup.components(rows, most).collect()} == want
    assert near_dedup.components(rows.limit(0), most).collect() == []


def test_the_driver_plans_few_jobs_and_samples_few_keys(spark):
    sc, name = spark.sparkContext, "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    rows = spark.createDataFrame([(i, i + 1) for i in range(60)], "lo long, hi long")
    sc.setJobGroup("chain", "chain")
    assert {r.label for r in near_dedup.components(rows).collect()} == {0}
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("chain")) <= 6
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "600")
    try:
        assert int(near_dedup.few_range_keys(spark, lambda: spark.conf.get(name))) * 600 <= near_dedup.RANGE_KEYS
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert spark.conf.get(name, "100") == "100"
