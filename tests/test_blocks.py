import time

import numpy as np

from corpusloom.operators import blocks, ranking


def test_nearest_of_more_vectors_than_were_held_at_once(spark):
    # 10,001 vectors and more met in one task before, by a join on the corpus, and took minutes.
    rng = np.random.default_rng(5)
    n = 10_500
    v = rng.normal(size=(n, 4)).astype(np.float32)
    v[100:400] = v[100]  # alike: ties go by name
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    names = np.array([f"n{i}" if i % 10 else f"n{i // 20}" for i in range(n)])  # some names have several vectors
    rows = spark.createDataFrame([("c", a, x.tolist()) for a, x in zip(names.tolist(), v, strict=True)], "corpus string, name string, vec array<float>")
    began = time.time()
    got = {}
    for r in ranking.nearest(rows, rows).collect():
        got.setdefault(r["name"], {})[r["rank"]] = (r["similarity"], r["neighbour"])
    assert time.time() - began < 90
    assert len(got) == len(set(names))
    wide = v.astype(np.float64)
    for name in ("n100", "n250", "n1", "n0", "n7777", names[-1]):
        sims = blocks.rounded(wide[names == name] @ wide.T).max(axis=0)
        best = {}
        for s, o in zip(sims.tolist(), names.tolist(), strict=True):
            if o != name:
                best[o] = max(s, best.get(o, -2))
        wanted = sorted((-s, o) for o, s in best.items())[:3]
        assert [(-s, o) for s, o in (got[name][k] for k in (1, 2, 3))] == wanted


def test_nearest_keeps_to_corpora_and_lengths(spark):
    rows = spark.createDataFrame([("a", "x", [1.0, 0.0]), ("a", "y", [0.9, 0.1]), ("b", "z", [1.0, 0.0]), ("a", "w", [1.0]), ("a", "q", None)], "corpus string, name string, vec array<double>")
    assert {(r["name"], r["neighbour"]) for r in ranking.nearest(rows, rows).collect()} == {("x", "y"), ("y", "x")}


def test_text_of_the_best_chunk_even_below_the_floor(spark):
    v = spark.createDataFrame([("c", "a", None, [1.0, 0.0], "summary"), ("c", "a", 0, [0.1, 0.9], "far"), ("c", "a", 1, [0.2, 0.9], "near"), ("c", "b", None, [0.0, 1.0], "no"), ("c", "d", None, [0.8, None], "null")], "corpus string, name string, chunk_ix int, vec array<double>, text string")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "query_id int, vec array<double>")
    assert [(r["query_id"], r["name"], r["cosine"], r["text"]) for r in ranking.semantic_scores(v, q).collect()] == [(1, "a", 1.0, "near")]


def test_every_vector_of_a_name_lies_in_one_block(spark):
    n = blocks.ROWS + 100
    rows = spark.range(n).selectExpr("'c' AS corpus", "concat('n', id div 7) AS name", "cast(id % 7 AS int) AS chunk_ix", "array(1d, 0d) AS vec", "'t' AS text").coalesce(1)
    got = [r["names"] for r in blocks.packed(rows, True).collect()]
    assert sum(map(len, got)) == n and sum(len(set(x)) for x in got) == len({y for x in got for y in x})
