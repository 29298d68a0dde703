"""Tokens with their places in the text, and snippets around a match: plain Python for the few rows of a page."""

from __future__ import annotations

import re

from corpusloom.constants import SNIPPET_CHARS, STOP_WORDS

_RUN = re.compile(r"[A-Za-z0-9.+/-]+")
_STOP = frozenset(STOP_WORDS)
#: (ending, least length, characters cut, what is put in their place), in the order in which they are tried.
_ENDINGS = (("ies", 6, 3, "y"), ("sses", 5, 2, ""), ("shes", 5, 2, ""), ("ches", 5, 2, ""), ("ing", 7, 3, ""), ("ed", 6, 2, ""), ("es", 6, 1, ""), ("s", 5, 1, ""))
#: How far before the cut a sentence may start to be shown from its start.
_BACK = 120


def stem(word: str) -> str:
    """As functions.text.stem."""
    if len(word) >= 5 and word.isascii() and word.isalpha():
        for ending, least, cut, put in _ENDINGS:
            if word.endswith(ending) and len(word) >= least and not (ending == "s" and word.endswith("ss")):
                return word[:-cut] + put
    return word


_LOW_RUN = re.compile(r"[a-z0-9.+/-]+")
#: Runs whose terms are remembered.
_KNOWN = 1_000_000


def runs(text: str | None) -> list[str]:
    """The runs of characters of a lower-cased text that terms are made of."""
    return _LOW_RUN.findall((text or "").lower())


class Terms(dict):
    """The terms of each run, as functions.text.tokenize gives them: the compound and its parts, without stop words and single characters,
    stemmed. A word's terms are found once."""

    def __missing__(self, run: str) -> tuple[str, ...]:
        whole = run.strip(".-/+")
        parts = [p for p in re.split(r"[.\-/]", whole) if len(p) > 1]
        got = tuple(stem(x) for x in ((whole, *parts) if len(parts) > 1 else (whole,)) if len(x) > 1 and x not in _STOP)
        if len(self) >= _KNOWN:
            self.clear()
        self[run] = got
        return got


def positions(text: str | None) -> list[tuple[str, int, int]]:
    """(term, start, end): the tokens of functions.text.tokenize in order; a part carries the span of its compound."""
    out = []
    for m in _RUN.finditer(text or ""):
        whole = m[0].strip(".-/+")
        if whole:
            start = m.start() + m[0].index(whole)
            low = whole.lower()
            parts = [p for p in re.split(r"[.\-/]", low) if len(p) > 1]
            for form in (low, *parts) if len(parts) > 1 else (low,):
                if len(form) > 1 and form not in _STOP:
                    out.append((stem(form), start, start + len(whole)))
    return out


def snippet_around(text: str | None, start: int, end: int, most: int = SNIPPET_CHARS) -> str:
    """`most` characters with the match in the middle, from a near sentence start and between whole words; an ellipsis marks each cut."""
    text = text or ""
    if len(text) <= most:
        return " ".join(text.split())
    low = start if end - start >= most else max(0, start - (most - (end - start)) // 2)
    low = max(0, min(low, len(text) - most)) if end - start < most else low
    base = max(0, low - _BACK)
    stops = [base + m.end() - (m[0] != "\n") for m in re.finditer(r"[.!?] |\n", text[base:low])]
    if stops and stops[-1] < start:
        low = stops[-1]
    high = min(len(text), low + most)
    cut = text[low:high]
    if low > 0:
        cut = re.sub(r"^\S*\s", "", cut)
    if high < len(text):
        cut = re.sub(r"\s\S*$", "", cut)
    return ("…" if low > 0 else "") + " ".join(cut.split()) + ("…" if high < len(text) else "")
