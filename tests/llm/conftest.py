import random

import pytest

COLS = "doc_id long, text string, lang string, source string, n_chars long, doc string, sig string, kind string, token string, size string"


@pytest.fixture(scope="session")
def corpus(spark):
    """Rows with nulls, empty and long texts, copies, near copies, repeated rows, repeated lines, and columns whose names clash."""
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma,", "délta", "ε", "zeta.", "eta", "theta", "iota", "kappa", "<|endoftext|>", "the", "of"]
    made = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(1, None, "en", "s1"), (2, "", "en", "s1"), (3, " \n\t ", None, None), (4, "\n".join(made(9) for _ in range(400)), "en", "s2"), (None, made(30), "fr", None), (None, None, None, "s1")]
    for i in range(5, 60):
        text = made(rng.choice([1, 2, 5, 40, 80]))
        rows.append((i, text, "en", f"s{i % 4}"))
        if i % 6 == 0:
            rows.append((i + 1000, text, "en", "s9"))
        if i % 7 == 0:
            rows.append((i + 2000, text.upper() if i % 2 else text + " extra", "en", "s9"))
        if i % 3 == 0:
            rows.append((i + 3000, text + "\n  Shared LINE \t\n" + made(12) + "\nshared line\n", "de", "s2"))
    base = made(120).split()
    for i in range(30):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(["x", "y", "z"])
        rows.append((i + 5000, " ".join(w), "en", "s3"))
    rows += [rows[10], rows[10], rows[11]]
    rng.shuffle(rows)
    return [(*r, len(r[1] or ""), "d", "s", "k", "t", "z") for r in rows]


@pytest.fixture(scope="session")
def documents(spark, corpus):
    return spark.createDataFrame(corpus, COLS).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLS)


@pytest.fixture(scope="session")
def alike():
    """Whether a DataFrame has the rows of a DuckDB relation."""

    def check(df, found):
        assert sorted(df.columns) == sorted(found.columns)
        order = sorted(df.columns)
        rows = lambda all_rows, cols: sorted(repr(tuple(dict(zip(cols, r))[c] for c in order)) for r in all_rows)
        assert rows(map(tuple, df.collect()), df.columns) == rows(found.fetchall(), found.columns)

    return check
