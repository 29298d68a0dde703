import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import scoring as S
from corpusloom.functions import text as T
from corpusloom.functions.spans import positions, snippet_around
from corpusloom.operators.lexical import best_window, phrase_snippets


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f("x").alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("The escalates of policies", ["escalate", "policy"]),
        ("v1.2.0 bge-small", ["v1.2.0", "bge-small", "bge", "small"]),
        ("running walked classes glass `code` [x]", ["runn", "walk", "class", "glass", "code"]),
        ("...-a-... / +", []),
        (None, []),
        ("", []),
        ("café naïve", ["caf", "na", "ve"]),
        ("go/do it/again", ["go/do", "go", "it/again", "again"]),
    ],
)
def test_tokens(spark, text, tokens):
    assert one(spark, text, T.tokenize) == tokens


def test_headings_links_and_slugs(spark):
    body = "# One \n```\n## Two\n```\n####### no\n[[a]] [[ b |c]] [[a]]"
    assert one(spark, body, T.headings) == ["One", "Two"]
    assert one(spark, body, T.wikilinks) == ["a", "b"]
    assert one(spark, "Hello,  World! " + "x" * 80, lambda c: T.slug(c, 20)) == "hello-world-xxxxxxxx"
    assert one(spark, "!!", T.slug) == "section"
    assert [one(spark, x, T.version_of) for x in ("Plan v12 x", "v12345", "none", None)] == [12, None, None, None]


@pytest.mark.parametrize("n", [0, 1, 199, 200, 201, 360, 361, 1000])
def test_chunks_come_together_again(spark, n):
    words = [f"w{i}" for i in range(n)]
    chunks = one(spark, " ".join(words), T.chunks)
    assert len(chunks) == (0 if n == 0 else 1 if n <= 200 else 1 + -(-(n - 200) // 160))
    assert all(len(c.split()) <= 200 for c in chunks)
    assert one(spark, " ".join(words), lambda c: T.unchunk(T.chunks(c))) == " ".join(words)


def test_descriptions_snippets_and_scrubs(spark):
    assert one(spark, "# T\n\nline one\nline two\n\nlater", T.synth_description) == "T — line one line two"
    assert one(spark, "", T.synth_description) == "(no description)" == one(spark, " \n\n", T.synth_description)
    assert one(spark, "intro\n# T\nmore", T.synth_description) == "intro" and one(spark, "\n \n## A  b ##\n# C\n\nx\n" + "y\n" * 9, T.synth_description) == "A b ## — x y y y y y"
    assert one(spark, "# T", T.synth_description) == "T" and one(spark, "a" * 500, T.synth_description) == "a" * 400
    assert one(spark, "aa  bb\ncc dd", lambda c: T.trim_snippet(c, 7)) == "aa bb…"
    assert one(spark, "me@gmail.com you@corp.example.com", T.scrub_emails) == "[email] [email@corp.example.com]"
    assert one(spark, "A@GMAIL.COM, b@Corp.Example.COM; c@me.com d@yahoo.co.uk e@x.acme.org f@acme.org g@notacme.org", lambda c: T.scrub_emails(c, ("acme.org",), ("g@NOTACME.org",))) == "[email], [email@corp.example.com]; [email] [email@yahoo.co.uk] e@x.acme.org f@acme.org g@notacme.org"
    assert one(spark, "password = hunter22 AKIA" + "A" * 16, T.secret_hits) == ["aws-key", "assignment"]
    assert one(spark, "x AKIA" + "A" * 16, T.redact) == "x [REDACTED:aws-key]"
    assert one(spark, "abc1234 12345678 abc1234 deadbeef99", T.extract_shas) == ["abc1234", "deadbeef99"]
    assert one(spark, "MAX_SIZE --dry-run lib/a.py", T.extract_identifiers) == ["MAX_SIZE", "--dry-run", "lib/a.py"]
    assert one(spark, "a.py --ab x/y.toolong A_B MAX", T.extract_identifiers) == [] and one(spark, "x---y abcdef1---1234abc 7654321", T.extract_shas) == ["1234abc"]
    assert one(spark, "<h2 class=x>T</h2><script>x</script><p>a&amp;b</p>", T.html_to_markdownish) == "## T\n\n  a&b"


HTML = ["<h1>A <b>b</b>\n c</h1>x<h3>D</h3>y", "<head><title>t</title></head><p>one<p>two</p>three<br>four<hr/>five", "<ul><li>a</li><li>b</li></ul><blockquote>q</blockquote>z", "&amp;nbsp; &lt;b&gt; &quot;q&#39;&#039; &NBSP;x", "<script>a<b</script>s<STYLE>x</style>t", "<h2>no end", "<H2 class='a'>Up</H2>\n\n\n\nend \t\n", "", "plain"]


@pytest.mark.parametrize("html", HTML)
def test_html_is_that_of_a_plain_function(spark, html):
    import re

    t = re.sub(r"(?is)<(script|style|head).*?</\1>", " ", html)
    t = re.sub(r"(?is)<h([1-6])[^>]*>(.*?)</h\1>", lambda m: "\n\n" + "#" * int(m[1]) + " " + " ".join(re.sub("<[^>]+>", " ", m[2]).split()) + "\n\n", t)
    t = re.sub(r"(?i)</(p|div|li|tr|table|ul|ol|blockquote|section|article)>", "\n\n", t)
    t = re.sub(r"<[^>]+>", " ", re.sub(r"(?i)<(br|hr)\s*/?>", "\n", t))
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#0?39;", "'")):
        t = re.sub(f"(?i){a}", b, t)
    want = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", t)).strip()
    assert one(spark, html, T.html_to_markdownish) == want


def test_counts_do_not_overlap(spark):
    assert one(spark, "aaaa", lambda c: T.count_hits(F.col(c), F.lit("aa"))) == 2


def test_scales(spark):
    row = spark.range(1).select(
        S.rescale_cosine(F.lit(0.55)).alias("a"), S.phrase_contribution(F.lit(0.35)).alias("b"), S.phrase_contribution(F.lit(1.0)).alias("c"),
        S.long_doc_factor(F.lit(4), F.lit(1), F.lit(0.0)).alias("d"), S.long_doc_factor(F.lit(4), F.lit(1), F.lit(0.9)).alias("e"),
        S.absolute_keyword(F.lit(1.0), F.lit(100.0)).alias("f"), S.absolute_keyword(F.lit(17.0), F.lit(20.0)).alias("g"), S.section_chunks(F.lit(2), F.lit(8), 0.5).alias("h"),
        S.recency_factor(F.lit(None).cast("timestamp"), F.lit(dt.datetime(2024, 1, 1))).alias("i"), S.tier_boost(F.lit("archive"), F.lit(True)).alias("j"),
        S.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0))).alias("k"),
    ).first()
    assert row["a"] == pytest.approx(0.5) and row["b"] == 0 and row["c"] == pytest.approx(1) and row["d"] == pytest.approx(0.25**0.35) and row["e"] == pytest.approx(1)
    assert row["f"] is None and row["g"] == pytest.approx(1) and row["h"] == pytest.approx(4) and row["i"] == 1 and row["j"] == 1 and row["k"] is None


@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from("abcdx"), max_size=25), st.sets(st.sampled_from("abcd"), min_size=2, max_size=4))
def test_best_window_is_the_best_of_all(tokens, wanted):
    found = best_window(tokens, wanted)
    scores = [(len({t for t in tokens[i : j + 1] if t in wanted}), j - i + 1) for i in range(len(tokens)) for j in range(i, len(tokens)) if tokens[i] in wanted and tokens[j] in wanted]
    if not scores:
        assert found is None
    else:
        assert found[0] == pytest.approx(max((k / len(wanted)) ** 2 * k / s for k, s in scores))


def test_a_phrase_needs_two_words():
    assert best_window(["a", "a"], {"a"}) is None
    assert best_window([], {"a", "b"}) is None


def test_positions_are_the_tokens_in_place(spark):
    texts = ["The v1.2.0 bge-small policies, `GLASS` classes! -a.b- walked/running", "Café it/again\n#one *two*", "", None, "...", "shes dishes misses goes pies es ss 12s abc-def.ghi"]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", T.tokenize("x").alias("t")).collect()
    for r in rows:
        assert [t for t, _, _ in positions(r.x)] == r.t
        assert all(r.x[a:b].lower() for _, a, b in positions(r.x))


def test_snippets_hold_the_match():
    text = " ".join(f"Sentence number {i} is here." for i in range(100))
    at = text.index("number 57")
    s = snippet_around(text, at, at + 9)
    assert "Sentence number 57 is here." in s and s.startswith("…") and s.endswith("…") and len(s) <= 322
    assert snippet_around("short  text\n", 0, 5) == "short text" and snippet_around(None, 0, 0) == ""
    assert snippet_around(text, 0, 400, 320).startswith("Sentence number 0") and snippet_around(text, len(text) - 5, len(text)).startswith("…Sentence number 88")


def test_phrase_snippets(spark):
    body = "filler " * 200 + "the light oil goes on the pawls " + "filler " * 200
    p = spark.createDataFrame([(1, body, ["light", "oil", "pawl"]), (2, "no", ["light", "oil"]), (3, None, ["a"])], "id int, body string, terms array<string>")
    got = {r.id: r.snippet for r in phrase_snippets(p).collect()}
    assert "light oil goes on the pawls" in got[1] and got[2] is None and got[3] is None
