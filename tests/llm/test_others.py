"""URL filter, toxicity, HTML, near-dedup, top-k and the pipeline against brute force."""

import itertools
import random
import re

import numpy as np
import pytest

from corpusloom.llm import html_text, near_dedup, topk, toxicity, url_filter


def test_urls(spark):
    urls = [None, "", "no scheme/en/", "http://Example.COM/en/x", "http://example.com/EN/x", "https://www.example.com/en/", "http://a.b.net/es/?q#f", "http://net/fr/", "http://x.com", "http://x.com?u=http://y.net/es/", "x://casino.org/a", "http://adult-education.org/", "http://adultx.org/", "http://examplexcom/en/", "http://a.net\n/es/", "ftp://é.net/es/é", "http://spam-filter.org", "http://free-download.io"]
    df = spark.createDataFrame([(i, u, "t", "k") for i, u in enumerate(urls)] + [(3, urls[3], "t", "k")], "page_id int, url string, token string, kind string").repartition(3)
    rows = url_filter.judge(df).collect()
    assert len(rows) == len(urls) + 1
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}

    def want(u):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(str.maketrans(url_filter._UPPER, url_filter._LOWER)), m[2]) if m else ("", "")
        best = None
        for rule in url_filter.PLACES:
            h, p = rule.name.split("/", 1)
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule.name) > len(best.name)):
                best = rule
        if best:
            return host, path, best.name, best.verdict
        words = [r for r in url_filter.WORDS if u and re.search(r.pattern, u.lower())]
        return host, path, None, "block" if words and all(r.verdict == "block" for r in words) else "allow"

    for i, u in enumerate(urls):
        assert got[i] == want(u), u
    plan = url_filter.judge(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("PythonRDD", ""))
    assert url_filter.judge(df.limit(0)).count() == 0


def test_rules_without_whole_tokens_are_tried_on_every_url(spark):
    rules = (url_filter.place("block", "é", ""), url_filter.Rule("any", "url", "block", "x+y", ()), url_filter.place("block", "a.com", "/sec"))
    assert rules[2].tokens == ("a", "com")
    df = spark.createDataFrame([(1, "http://b.é/q"), (2, "http://axxy.io/"), (3, "http://a.com/secret"), (4, "http://ok.io")], "page_id int, url string")
    assert {r.page_id: r.verdict for r in url_filter.judge(df, rules).collect()} == {1: "block", 2: "block", 3: "block", 4: "allow"}


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1><a href=x>Home</a></header><nav><ul><li><a href=a>One</a></ul></nav>
<div id="sidebar"><p>Some long sidebar text that goes on. It really does.</p></div><div class="cookie-notice">We use cookies. Accept them now, please.</div>
<div class="ad">Buy now!</div><article><h1>Real &amp; title</h1><p><b>First</b> paragraph of&nbsp;real
 text, with a <a href=y>link</a>.<br>More<p>Second &lt;one&gt;<script>var t="</p>";</script> here.</p><!-- <p>no</p> --><form><label>Mail</label></form></article>
<div class=comments><p>Nice post! I like it a lot, really.</p></div><aside>x</aside><footer>&copy; 2020</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Real & title First paragraph of real text, with a link. More Second <one> here."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<script>x") == html_text.main_text("<nav>a</nav>") == ""
    assert html_text.main_text("Plain words of some length, without any markup at all.").startswith("Plain")
    assert len(html_text.main_text("<article>" + "<p>word word word.</p>" * 5000)) == 5000 * 16 - 1


def test_cuts_are_minimal():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randint(1, 7)
        a, b = [[rng.randint(0, 9) for _ in range(n)] for _ in range(2)]
        edges = [(i, j, rng.randint(0, 5)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
        cost = lambda side: sum(a[i] if side[i] else b[i] for i in range(n)) + sum(w for i, j, w in edges if side[i] != side[j])
        assert cost(html_text.minimum_cut(a, b, edges)) == min(map(cost, itertools.product([False, True], repeat=n)))


def test_pages_keep_their_articles(spark):
    from tests_paths import SF

    def article(h):
        a = re.search(r"<article>(.*?)</article>", h, re.S)[1]
        a = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1)>", "\0", a.replace("<br>", " ")))
        return " ".join(x for x in (" ".join(html_text.unescape(p).split()) for p in a.split("\0")) if x)

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = html_text.extract(pages, ("page_id", "url", "html")).collect()
    assert len(rows) == pages.count() and all(r.text == article(r.html) and r.n_chars == len(r.text) for r in rows)
    assert html_text.extract(pages.limit(0)).count() == 0


def components(rows, size, percent):
    sets = []
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + min(size, len(w))]) for i in range(max(1, len(w) - size + 1))} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if rows[i][0] is None or rows[j][0] is None:
            continue
        both = len(sets[i] & sets[j])
        if rows[i][0] == rows[j][0] or both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), None if d is None else least[root(i)], d is None or least[root(i)] == d) for i, (d, t) in enumerate(rows)]


@pytest.mark.parametrize(("size", "percent"), [(2, 80), (5, 80), (1, 60)])
def test_components(spark, documents, corpus, size, percent):
    want = components([r[:2] for r in corpus], size, percent)
    got = [tuple(r) for r in near_dedup.near_duplicates(documents, size, percent).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_large_groups_of_copies(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(80)] = f"v{rng.randrange(99)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base)) for i in range(300)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 2, 80).collect()
    want = components(rows, 2, 80)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_nothing_to_link(spark, nothing):
    assert near_dedup.near_duplicates(nothing, 2).count() == 0 and near_dedup.one_of_each(nothing).count() == 0


def test_parities_differ_at_most_as_sets_do():
    rng = np.random.default_rng(1)
    for _ in range(100):
        a, b = (np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        apart = sum(int(x).bit_count() for x in (near_dedup.parities(a) ^ near_dedup.parities(b)).view(np.uint64))
        assert apart <= len(np.setxor1d(a, b))


def test_top_k(spark):
    rng = np.random.default_rng(2)
    vecs = [(i, rng.normal(0, 0.1, 16).round(2).tolist()) for i in range(400)]
    vecs += [(500, None), (550, [0.1, None]), (600, [float("nan")] * 16), (650, [float("inf")] * 16), (700, []), (750, [1.0, 2.0, 3.0] * 6), (50, [9.0] * 16), (801, vecs[3][1]), (802, vecs[3][1]), (None, vecs[1][1])]
    df = spark.createDataFrame([(*v, "x") for v in vecs], "vec_id long, embedding array<double>, id string").repartition(5)
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in vecs if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = []
    asked = {}
    for i, v in sorted(good):
        if i % 50 == 0:
            asked.setdefault(i, v)
    for i, v in asked.items():
        best = sorted((-dot(v, w), j) for j, w in good if j != i)[:5]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    got = [tuple(r) for r in topk.search(df.where("vec_id % 50 = 0"), df, 5).collect()]
    assert sorted(got) == sorted(want)
    assert topk.search(df.limit(0), df, 5).count() == 0 and topk.search(df, df.limit(0), 5).count() == 0
    assert {r.rank for r in topk.search(df.where("vec_id = 0"), df.where("vec_id < 3"), 5).collect()} == {1, 2}


def test_index_is_exact_for_alike_vectors():
    rng = np.random.default_rng(3)
    values = rng.integers(-256, 257, (3000, 8))
    values[::7] = values[0]
    ids = rng.permutation(3000).astype(np.int64)
    q = rng.integers(-256, 257, (20, 8))
    a, b, s = topk.Index(ids, values).search(np.arange(20, dtype=np.int64), q, 5)
    for i in range(20):
        want = sorted((-int(x), int(j)) for x, j in zip(values @ q[i], ids) if j != i)[:5]
        assert [(-int(x), int(j)) for x, j in zip(s[a == i], b[a == i])] == want


def toxic_corpus(n):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        lang, words = rng.choice(list(toxicity.STOPWORDS.items()))
        w = [rng.choice(words.split()) if rng.random() < 0.4 else f"{lang}{rng.randrange(300)}" for _ in range(rng.randint(20, 120))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["Nasty,", "awful", "rotten.", "vile"]))
        rows.append((i, " ".join(w), lang, "s"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxic_texts_are_told_apart(spark):
    rows, labels = toxic_corpus(3000)
    d = spark.createDataFrame([*rows, (-1, None, None, None), (-2, "", None, None)], "doc_id long, text string, lang string, source string")
    y = spark.createDataFrame([*labels, (5, 1, None), (None, 1, 1), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(d, y)
    got = {r.doc_id: r for r in toxicity.score(d, model).withColumn("held", toxicity.held_out_remainder() == 0).collect()}
    assert len(got) == 3002 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [(got[i].predicted, t) for i, _, t in labels if got[i].held]
    assert sum(p == t for p, t in held) / len(held) > 0.97
    assert got[-1].score == got[-2].score and got[-1].predicted == 0
    again = toxicity.train(d.repartition(3), y)
    assert all(np.allclose(a.out, b.out) and np.allclose(a.table, b.table) for a, b in zip(again.nets, model.nets, strict=True))


def test_a_model_without_labels_still_scores(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    y = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(d, toxicity.train(d, y)).count() == 2
    assert toxicity.score(d.limit(0), toxicity.train(d, y)).count() == 0


def test_the_pipeline_keeps_to_its_stages(spark, documents, corpus):
    import corpus_pipeline
    from corpusloom.llm.common import cut
    from test_texts import deduped, repeated

    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    docs, seen = documents.select(*cols), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = cut(stage(spark, docs, ""))
        seen[name] = (before, docs)
        if name != "sentencepiece":
            assert docs.columns == cols
    kept = [r for r in corpus if len(w := (r[1] or "").encode().split()) >= 10 and 100 * repeated(w, 5) <= 20 * len(w)]
    assert sorted(repr(tuple(r)) for r in seen["quality rules"][1].collect()) == sorted(repr(r[:5]) for r in kept)
    want = deduped([r[:2] for r in kept], 10)
    lines = [tuple(r)[:2] for r in seen["line dedup"][1].collect()]
    assert sorted(map(repr, lines)) == sorted(repr((r[0], want[r[:2]])) for r in kept)
    alone = {d for d, _, _, k in components(lines, 5, 80) if k}
    assert {r.doc_id for r in seen["near-dedup"][1].collect()} == alone
    mixed = seen["source mixing"][1].collect()
    assert {r.doc_id for r in mixed} <= alone
    last = seen["sentencepiece"][1].collect()
    assert len(last) == len(mixed) and all(r.exact and r.n_tokens == len(r.ids) for r in last)
