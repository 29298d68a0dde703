"""Text functions on columns: tokens, headings, links, chunks, slugs, snippets. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom import constants as K


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stem(t: Column) -> Column:
    """Light suffix stripping of words of letters only, five or more; the first rule that fits."""
    n = F.length(t)
    return (
        F.when((n < 5) | ~t.rlike("^[a-z]+$"), t)
        .when(t.endswith("ies") & (n > 5), F.concat(F.substring(t, F.lit(1), n - 3), F.lit("y")))
        .when(t.endswith("sses") | t.endswith("shes") | t.endswith("ches"), F.substring(t, F.lit(1), n - 2))
        .when(t.endswith("ing") & (n > 6), F.substring(t, F.lit(1), n - 3))
        .when(t.endswith("ed") & (n > 5), F.substring(t, F.lit(1), n - 2))
        .when(t.endswith("es") & (n > 5), F.substring(t, F.lit(1), n - 1))
        .when(t.endswith("s") & ~t.endswith("ss"), F.substring(t, F.lit(1), n - 1))
        .otherwise(t)
    )


def tokenize(text: Column | str) -> Column:
    """Search terms in order: compounds and their parts, without stop words and single characters, stemmed. Null has none."""
    clean = F.regexp_replace(F.lower(F.coalesce(_col(text), F.lit(""))), "[`*_~>#|]", " ")
    raw = F.transform(F.split(clean, "[^a-z0-9.+/-]+"), lambda t: F.btrim(t, F.lit(".-/+")))

    def with_parts(t: Column) -> Column:
        parts = F.filter(F.split(t, r"[.\-/]"), lambda p: F.length(p) > 1)
        return F.when(~t.rlike(r"[.\-/]"), F.array(t)).when(F.size(parts) > 1, F.concat(F.array(t), parts)).otherwise(F.array(t))

    every = F.flatten(F.transform(F.filter(raw, lambda t: t != ""), with_parts))
    return F.transform(F.filter(every, lambda t: (F.length(t) > 1) & ~t.isin(*K.STOP_WORDS)), stem)


def headings(body: Column | str) -> Column:
    """The text of lines that start with one to six # and white space."""
    return F.transform(F.regexp_extract_all(F.coalesce(_col(body), F.lit("")), F.lit(r"(?m)^#{1,6}[ \t]+(.*)$"), F.lit(1)), lambda x: F.trim(x))


def wikilinks(body: Column | str) -> Column:
    """Targets of [[target]] and [[target|label]], trimmed, each once, in order."""
    found = F.regexp_extract_all(F.coalesce(_col(body), F.lit("")), F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != ""))


def space_words(text: Column | str) -> Column:
    return F.filter(F.split(F.coalesce(_col(text), F.lit("")), r"\s+"), lambda w: w != "")


def _bound(x: Column, body) -> Column:
    """body(x) where x is worked out once, however often and wherever in lambdas body asks for it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def chunk_count(body: Column | str, size: int = K.CHUNK_WORDS, overlap: int = K.CHUNK_OVERLAP) -> Column:
    """How many chunks() there are."""
    return _bound(F.size(space_words(body)), lambda n: F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / (size - overlap)) + 1).cast("int"))


def chunks(body: Column | str, size: int = K.CHUNK_WORDS, overlap: int = K.CHUNK_OVERLAP) -> Column:
    """Windows of `size` words that start every size - overlap words, up to the first that reaches the end."""
    step = size - overlap

    def windows(w: Column) -> Column:
        n = F.size(w)
        last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step))
        starts = F.transform(F.sequence(F.lit(0).cast("long"), last.cast("long")), lambda i: i * step + 1)
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda s: F.array_join(F.slice(w, s.cast("int"), size), " ")))

    return _bound(space_words(body), windows)


def unchunk(parts: Column | str, overlap: int = K.CHUNK_OVERLAP) -> Column:
    """The words of chunks() again, joined by spaces."""
    def rest(c: Column, i: Column) -> Column:
        w = F.split(c, " ")
        return F.when(i == 0, w).otherwise(F.slice(w, F.lit(overlap + 1), F.greatest(F.size(w) - overlap, F.lit(0))))

    return F.array_join(F.flatten(F.transform(_col(parts), rest)), " ")


def slug(text: Column | str, most: int | None = 60, default: str = "section") -> Column:
    """Lower-case runs of a-z and 0-9 joined by -, cut to `most` characters; default if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(_col(text), F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    s = F.substring(s, 1, most) if most else s
    return F.when(s == "", default).otherwise(s)


def version_of(heading: Column | str) -> Column:
    """The number of the first v<1 to 4 digits> that stands alone, else null."""
    return F.expr("try_cast(nullif('', '') AS int)") if heading is None else F.regexp_extract(F.coalesce(_col(heading), F.lit("")), r"(?i)\bv(\d{1,4})\b", 1).try_cast("int")


def trim_snippet(text: Column | str, most: int = K.SNIPPET_CHARS) -> Column:
    """White space collapsed; a longer text is cut before the last word that doesn't fit whole, and gets an ellipsis."""
    t = F.trim(F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"\s+", " "))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, most), r"\s\S*$", ""), F.lit("…")))


def count_hits(haystack: Column, needle: Column) -> Column:
    """Occurrences that don't overlap; an empty needle has none."""
    return F.when(F.length(needle) > 0, ((F.length(haystack) - F.length(F.replace(haystack, needle, F.lit("")))) / F.length(needle)).cast("long")).otherwise(F.lit(0).cast("long"))


def summary_text(name: Column | str, description: Column | str) -> Column:
    """What stands for a document in its summary vector."""
    return F.concat(F.regexp_replace(_col(name), "[-_]", " "), F.lit(". "), F.coalesce(_col(description), F.lit("")))


def first_words(text: Column | str, n: int) -> Column:
    return F.array_join(F.slice(space_words(text), 1, n), " ")


def synth_description(body: Column | str) -> Column:
    """The heading on the first line that isn't blank, if that is one, and the first paragraph after it (six lines at most), joined
    by a dash, 400 characters at most; (no description) for nothing."""
    b = F.coalesce(_col(body), F.lit(""))
    every = F.split(b, "\n")
    empty = F.array().cast("array<string>")
    lead = F.aggregate(every, F.lit(0), lambda n, x: F.when((n < 0) | (F.trim(x) != "") , F.when(n < 0, n).otherwise(-n - 1)).otherwise(n + 1))
    first = F.when(lead < 0, -lead - 1)  # place of the first line that isn't blank
    line = F.get(every, first.cast("int"))
    titled = F.coalesce(line.rlike(r"^#{1,6}\s+"), F.lit(False))
    head = F.when(titled, F.trim(F.regexp_replace(line, r"^#{1,6}\s+", ""))).otherwise(F.lit(""))
    start = F.coalesce(first + F.when(titled, 1).otherwise(0), F.size(every))
    rest = F.slice(every, (start + 1).cast("int"), F.greatest(F.lit(0), F.size(every) - start).cast("int"))
    para = F.aggregate(
        F.transform(rest, lambda x: F.trim(x)),
        F.struct(empty.alias("got"), F.lit(False).alias("over")),
        lambda acc, x: F.when(acc["over"], acc)
        .when((x == "") | x.rlike(r"^#{1,6}\s"), F.struct(acc["got"].alias("got"), (F.size(acc["got"]) > 0).alias("over")))
        .otherwise(F.struct(F.concat(acc["got"], F.array(x)).alias("got"), (F.size(acc["got"]) >= 5).alias("over"))),
        lambda acc: F.array_join(acc["got"], " "),
    )
    both = F.array_join(F.filter(F.array(head, para), lambda x: x != ""), " — ")
    both = F.substring(F.regexp_replace(both, r"\s+", " "), 1, 400)
    return F.when(both == "", "(no description)").otherwise(both)


# Shapes of commits and of names of code.
SHA = r"\b[0-9a-f]{7,10}\b"
IDENTIFIERS = (r"\b[A-Z][A-Z0-9]+(?:_[A-Z0-9]+)+\b", r"--[a-z][a-z0-9-]{2,}\b", r"\b[\w.-]+/[\w./-]+\.[a-z]{2,4}\b")


def extract_shas(text: Column | str) -> Column:
    """Distinct words of 7 to 10 hex digits that aren't all decimal digits; in a text with two or more --- only what follows the second."""
    t = F.coalesce(_col(text), F.lit(""))
    parts = F.split(t, "---")
    scan = F.when(F.size(parts) > 2, F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), "---")).otherwise(t)
    found = F.regexp_extract_all(scan, F.lit(SHA), F.lit(0))
    return F.array_distinct(F.filter(found, lambda x: ~x.rlike("^[0-9]+$")))


def extract_identifiers(text: Column | str) -> Column:
    """Distinct CONSTANT_CASE names, --flags of three letters or more and paths with a slash and an ending, in that order."""
    t = F.coalesce(_col(text), F.lit(""))
    return F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(t, F.lit(k), F.lit(0)) for k in IDENTIFIERS))))


# What an address looks like, and hosts of free mail.
ADDRESS = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
FREE_MAIL = ("gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com", "icloud.com", "me.com", "msn.com", "live.com", "comcast.net", "protonmail.com", "proton.me", "gmx.com")


def scrub_emails(text: Column | str, keep_domains: tuple[str, ...] = (), keep_addresses: tuple[str, ...] = ()) -> Column:
    """Addresses of free mail hosts become [email], others [email@host] in lower case; those kept, or of kept domains and their
    subdomains, stay."""
    t = F.coalesce(_col(text), F.lit(""))

    def hidden(full: Column) -> Column:
        addr = F.lower(full)
        dom = F.substring_index(addr, "@", -1)
        stay = addr.isin(*(a.lower() for a in keep_addresses)) if keep_addresses else F.lit(False)
        for d in keep_domains:
            stay = stay | (dom == d.lower()) | dom.endswith("." + d.lower())
        return F.when(stay, full).when(dom.isin(*FREE_MAIL), "[email]").otherwise(F.concat(F.lit("[email@"), dom, F.lit("]")))

    between, found = F.split(t, ADDRESS), F.regexp_extract_all(t, F.lit(ADDRESS), F.lit(0))
    return F.array_join(F.zip_with(between, F.transform(found, hidden), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


# Closed classes of secrets.
SECRET_PATTERNS = (
    ("private-key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"),
    ("aws-key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("token", r"\b(?:ghp|gho|ghs|sk|pk|xoxb|xoxp)[-_][A-Za-z0-9_-]{16,}\b"),
    ("assignment", r"(?i)\b(?:api[_-]?key|password|passwd|secret|token)\b\s*[:=]\s*[\"']?[^\s\"']{6,}[\"']?"),
)


def redact(text: Column | str) -> Column:
    """Every match of a secret pattern becomes [REDACTED:<class>]."""
    t = F.coalesce(_col(text), F.lit(""))
    for name, pattern in SECRET_PATTERNS:
        t = F.regexp_replace(t, pattern, f"[REDACTED:{name}]")
    return t


def secret_hits(text: Column | str) -> Column:
    """Classes found, in order."""
    t = F.coalesce(_col(text), F.lit(""))
    return F.filter(F.array(*(F.when(t.rlike(p), F.lit(n)) for n, p in SECRET_PATTERNS)), lambda x: x.isNotNull())


def html_to_markdownish(html: Column | str) -> Column:
    """Scripts, styles and head go; headings become # lines, block ends blank lines, br and hr line ends, tags vanish, six entities are
    decoded in order."""
    t = F.regexp_replace(F.coalesce(_col(html), F.lit("")), r"(?is)<(script|style|head).*?</\1>", " ")
    for level in range(1, 7):
        whole = rf"(?is)<h{level}[^>]*>(.*?)</h{level}>"
        between, inner = F.split(t, whole), F.regexp_extract_all(t, F.lit(whole), F.lit(1))
        head = F.transform(inner, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), r"\s+", " ")))  # noqa: B023
        marked = F.transform(head, lambda x: F.concat(F.lit("\n\n" + "#" * level + " "), x, F.lit("\n\n")))  # noqa: B023
        t = F.array_join(F.zip_with(between, marked, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    t = F.regexp_replace(t, r"(?i)</(?:p|div|li|tr|table|ul|ol|blockquote|section|article)>", "\n\n")
    t = F.regexp_replace(t, r"(?i)<(?:br|hr)\s*/?>", "\n")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    for entity, letter in (("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'), ("&#0?39;", "'")):
        t = F.regexp_replace(t, entity, letter)
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def proseness(text: Column | str) -> Column:
    """Mean words of sentences longer than 20 characters, by 25, damped by the share of symbols, from 0 to 1; null below 100 characters."""
    t = F.coalesce(_col(text), F.lit(""))
    sentences = F.filter(F.split(t, r"[.!?]+\s"), lambda s: F.length(F.trim(s)) > 20)
    counts = F.transform(sentences, lambda s: F.size(F.split(s, r"\s+")).cast("double"))
    mean = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) / F.size(counts)
    share = F.length(F.regexp_replace(t, r"[^{}()\[\]<>|=;$#]", "")) / F.length(t)
    value = (mean / 25) * (1 - F.least(F.lit(1.0), 40 * share))
    return F.when(F.length(t) < 100, F.lit(None).cast("double")).when(F.size(sentences) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))
