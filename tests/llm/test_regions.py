"""Near-dedup of documents that share most of their text with many others."""

import random

from corpusloom.llm import near_dedup


def template_rows(pairs, seed=3):
    """Documents of 100 words, 85 of a template: two of a pair share 4 words more (similarity 89 / 111), others none (85 / 115)."""
    rng, rows = random.Random(seed), []
    for p in range(pairs):
        for k in range(2):
            words = [f"t{i}" for i in range(85)] + [f"p{p}x{i}" for i in range(4)] + [f"d{p}x{k}x{i}" for i in range(11)]
            rng.shuffle(words)
            rows.append((2 * p + k, " ".join(words)))
    rng.shuffle(rows)
    return rows


def test_pairs_in_regions_of_a_template_are_found(spark):
    rows = template_rows(1500)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 1, 80).collect()}
    lost = [d for d, _ in rows if got[d] != d - d % 2]
    assert not lost, len(lost)
