"""What marks of elements do to article text."""

import itertools

import pytest

from corpusloom.llm import html_text, practice

P = "<p>A first paragraph of the article, with words enough.</p><p>And a second one that ends it, as it should.</p>"
TEXT = "A first paragraph of the article, with words enough. And a second one that ends it, as it should."


@pytest.mark.parametrize("page", [
    f'<body class="single has-sidebar"><article>{P}</article></body>',
    f'<body class="sidebar-right modal-open"><div>{P}</div></body>',
    f'<body><div id="main" class="with-sidebar"><article>{P}</article></div></body>',
    f'<body><div id="main" class="with-sidebar">{P}</div></body>',
    f'<body><div class="content comments-open">{P}</div></body>',
    f'<body><div class="left-sidebar"><article>{P}</article></div></body>',
    f'<div style="overflow:hidden"><article>{P}</article></div>',
    f'<article><div title="hidden costs" data-hidden="false">{P}</div></article>',
    f'<article><div data-url="/the-hidden-cost" aria-hidden="false">{P}</div></article>',
    f'<article data-class="ads sidebar">{P}</article>',
])
def test_articles_stay(page):
    assert html_text.main_text(page) == TEXT


@pytest.mark.parametrize("other", [
    '<div hidden>Some long words that nobody sees. Really, nobody.</div>',
    '<div class="x" aria-hidden="true">Some long words that nobody sees. Really, nobody.</div>',
    '<div class="comments"><article class="comment-body"><p>I like it a lot, really. Thank you.</p></article></div>',
    '<div class="post-comments"><p>I like it a lot, really. Thank you.</p></div>',
    '<div class=entry-meta><p>Written by someone on some day in May.</p></div>',
])
def test_what_is_no_article_goes(other):
    assert html_text.main_text(f"<body><article>{P}{other}</article>{other}</body>") == TEXT


@pytest.mark.parametrize("page", [
    f"<article><p title=it's>{P[3:]}</article>",
    f'<article><p title="hidden gem">{P[3:]}</article>',
    f"<article><p data-x='unclosed>{P[3:]}</article>",
    f'<article><div hidden><div>inner</div>not seen by anyone, ever.</div>{P}</article>',
    f'<article><span hidden>a<span>b</span>c</span>{P}</article>',
    f'<article><p hidden>not seen{P}</article>',
    f'<article><div style="display: none"><p>Not seen. Not at all, never.</p></div>{P}</article>',
    f'<article><div hidden><span>never closed</article><article>{P}</article>',
    f'<div class="post comments-open"><article>{P}</article></div>',
    f'<div class="adverb gradient sharepoint"><article>{P}</article></div>',
])
def test_odd_markup_leaves_the_article_whole(page):
    assert html_text.main_text(page) == TEXT


def test_no_attribute_is_quadratic():
    import time

    began = time.time()
    html_text.main_text("<article>" + "<p title=it's \"x>word word word, word.</p>" * 20000)
    assert time.time() - began < 20


def test_the_classifier_is_right_on_pages_it_never_saw():
    wrong = total = 0
    for html, is_content in practice.pages(150, seed=77):
        found = html_text.blocks(html)
        keep = html_text.minimum_cut(*html_text.costs(found, html_text.classifier()), html_text.smoothness(found))
        wrong += sum(k != is_content(b.text) for b, k in zip(found, keep, strict=True))
        total += len(found)
    assert total > 1000 and wrong / total < 0.02


def test_whole_pages_are_cut_at_least_cost():
    n = 0
    for html, _ in practice.pages(400, seed=5):
        found = html_text.blocks(html)
        if not 1 < len(found) <= 11:
            continue
        n += 1
        a, b = html_text.costs(found, html_text.classifier())
        edges = html_text.smoothness(found)
        cost = lambda side: sum(x if s else y for x, y, s in zip(a, b, side)) + sum(w for i, j, w in edges if side[i] != side[j])  # noqa: E731, B023
        best = min(itertools.product([False, True], repeat=len(found)), key=cost)
        assert cost(html_text.minimum_cut(a, b, edges)) == pytest.approx(cost(best))
        assert html_text.main_text(html) == " ".join(x.text for x, k in zip(found, html_text.minimum_cut(a, b, edges)) if k)
    assert n > 10
