"""Made-up web pages with known labels, on which html_text trains its block classifier.

Layouts are drawn by a seeded generator: where the article lies (article, main, a div with a telling name, a bare body), what it holds
(headings, paragraphs of all lengths, lists, quotes, tables), what lies around and within it (menus, adverts, notices, sidebars, forms,
footers, links to other pages, readers' comments), and marks of layout that say nothing. Words of the article begin with k, others with b.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

PAGES = 500

_SYLLABLES = "an el in or tra mi so lu ven der ka po".split()
_NOISE = ("", "", "", "has-sidebar", "no-js", "single", "layout", "sidebar-right", "row wide", "wrapper", "comments-open", "modal-open with-sidebar")
_CUES = ("We use cookies.", "Subscribe to our newsletter", "© 2020", "All rights reserved", "Sign up", "Read more", "Share this", "Advertisement", "Leave a comment", "Log in")


class _Maker:
    def __init__(self, rng: random.Random):
        self.rng = rng

    def text(self, mark: str, low: int, high: int, end: bool) -> str:
        rng = self.rng
        out = []
        for i in range(rng.randint(low, high)):
            word = mark + "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4)))
            out.append(word + ("," if rng.random() < 0.08 else "." if rng.random() < 0.08 else ""))
        return " ".join(out).rstrip(",.") + ("." if end else "")

    def links(self, n: int) -> str:
        return "".join(f"<li><a href='/x'>{self.text('b', 1, 3, False)}</a></li>" for _ in range(n))

    def content(self) -> str:
        rng = self.rng
        kind = rng.random()
        if kind < 0.62:
            words = self.text("k", *rng.choice([(1, 4), (8, 30), (20, 120)]), rng.random() < 0.9)
            if rng.random() < 0.08:
                words = f"k {rng.choice(_CUES)} {words}" if rng.random() < 0.5 else f"k {rng.choice(_CUES)}."  # articles may say so too
            if rng.random() < 0.2:
                words = f"{words} <a href='/y'>{self.text('k', 1, 6, False)}</a>"
            return rng.choice([f"<p>{words}</p>", f"<p>{words}</p>", f"<p><b>{words}</b></p>", f"<div>{words}</div>", f"<section><p>{words}</p></section>"])
        if kind < 0.72:
            return f"<h{rng.randint(2, 4)}>{self.text('k', 1, 9, False)}</h2>"
        if kind < 0.84:
            return "<ul>" + "".join(f"<li>{self.text('k', 1, 20, rng.random() < 0.5)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.9:
            return f"<blockquote>{self.text('k', 5, 40, True)}</blockquote>"
        if kind < 0.95:
            return f"<figure><figcaption>{self.text('k', 3, 15, True)}</figcaption></figure>"
        return "<table>" + "".join(f"<tr><td>{self.text('k', 1, 3, False)}</td><td>{self.text('k', 1, 5, False)}</td></tr>" for _ in range(3)) + "</table>"

    def boilerplate(self) -> str:
        """A part of a page that is no article, whatever its length."""
        rng = self.rng
        words = self.text("b", *rng.choice([(1, 5), (5, 20), (15, 60)]), rng.random() < 0.7)
        if rng.random() < 0.25:
            words = f"b{words} {rng.choice(_CUES)}"
        name = rng.choice("ad ads advert banner cookie-notice cookie-banner consent sidebar left-sidebar widget related related-posts share social-share newsletter signup-box promo sponsored breadcrumbs pagination popup disclaimer author-bio entry-meta post-tags toc".split())
        inner = rng.choice([words, f"<p>{words}</p>", f"<h3>{self.text('b', 1, 4, False)}</h3><p>{words}</p>", f"<ul>{self.links(rng.randint(1, 6))}</ul>"])
        mark = rng.choice(["class", "class", "id"])
        return rng.choice([
            f"<div {mark}='{name}'>{inner}</div>", f"<div {mark}='{name}'>{inner}</div>", f"<section class='{name} x{rng.randint(0, 9)}'>{inner}</section>", f"<aside>{inner}</aside>",
            f"<nav><ul>{self.links(rng.randint(1, 8))}</ul></nav>", f"<form><label>{words}</label><button>{self.text('b', 1, 2, False)}</button></form>",
        ])

    def comments(self) -> str:
        one = lambda: self.rng.choice(["<div class='comment'>{}</div>", "<article class='comment-body'>{}</article>", "<li class='reply'>{}</li>", "{}"]).format(f"<p>{self.text('b', 3, 60, True)}</p>")
        name = self.rng.choice("comments comment-list post-comments disqus respond".split())
        return f"<div {self.rng.choice(['class', 'id'])}='{name}'>" + "".join(one() for _ in range(self.rng.randint(1, 5))) + "</div>"

    def page(self) -> str:
        rng = self.rng
        title = f"<h1>{self.text('k', 1, 12, False)}</h1>"
        title = title if rng.random() < 0.75 else f"<header>{title}</header>" if rng.random() < 0.6 else ""
        kind = rng.random()
        main = "article" if kind < 0.45 else "main" if kind < 0.6 else ""
        if not main and "<header>" in title:
            title = ""
        body = [title] + [self.content() for _ in range(rng.randint(1, 14))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            body.insert(rng.randint(1, len(body)), self.boilerplate())
        if rng.random() < 0.15:
            body.append(self.comments())
        whole = "".join(body)
        if main:
            whole = f"<{main} class='{rng.choice(_NOISE)}'>{whole}</{main}>"
        elif kind < 0.85:
            whole = f"<div class='{rng.choice(['content', 'post', 'entry-content', 'post-body', 'story', 'article-text', 'main'])} {rng.choice(_NOISE)}'>{whole}</div>"
        elif kind < 0.95:
            whole = f"<div>{whole}</div>"
        if rng.random() < 0.4:
            whole = f"<div id='{rng.choice(['main', 'page', 'wrap'])}' class='{rng.choice(_NOISE)}'>{whole}</div>"
        before = [self.boilerplate() for _ in range(rng.randint(0, 2))]
        if rng.random() < 0.6:
            before.insert(0, f"<header><a href='/'>{self.text('b', 1, 4, False)}</a><p>{self.text('b', 1, 10, rng.random() < 0.5)}</p></header>")
        after = [self.boilerplate() for _ in range(rng.randint(0, 3))]
        if rng.random() < 0.4:
            after.append(self.comments())
        if rng.random() < 0.8:
            after.append(f"<footer>{self.text('b', 1, 30, rng.random() < 0.6)} <a href='/t'>{self.text('b', 1, 3, False)}</a></footer>")
        head = f"<head><title>{self.text('b', 1, 9, False)}</title></head>" if rng.random() < 0.8 else ""
        return f"<html>{head}<body class='{rng.choice(_NOISE)}'>{''.join(before)}{whole}{''.join(after)}</body></html>"


def pages(n: int = PAGES, seed: int = 11) -> Iterator[tuple[str, Callable[[str], bool]]]:
    """n pages, each with what tells whether a block's text is content."""
    maker = _Maker(random.Random(seed))
    for _ in range(n):
        yield maker.page(), lambda text: text.startswith("k")
