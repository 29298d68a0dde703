"""URL filter: pattern rules indexed by their rarest literal token, with DataFrame functions only.

A rule whose pattern can only match a URL that holds certain whole tokens ([a-z0-9]+ after lower-casing A-Z) is filed under that
one of them which the fewest URLs hold; a rule without such a token is filed under the empty token, which every URL has. A URL's
tokens fetch the rules filed under them, and only those run their regular expressions.

The index is one broadcast row: an array of cells by hash of the token, so that a token finds its rules in a step and no page is
shuffled. Rules are a table; load_rules() reads one from a file.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import cut

#: Rules that go to the workers at a time (about 20 MB). More are tried in turns of as many, each turn on the result of the one before.
BROADCAST_RULES = 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SCHEMA = "array<struct<name: string, kind: string, verdict: string, pattern: string, tokens: array<string>>>"


@dataclass(frozen=True)
class Rule:
    """kind place: pattern is found in host and path joined; kind url: in the url with A-Z lower-cased.

    tokens: tokens that any such text holds in whole.
    """

    name: str
    kind: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", text)


def place(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host, its subdomains, and paths that start with path. The host is in lower case; path starts with / or is empty."""
    found = _tokens(host + path)
    if path[-1:].isalnum() and found:
        found.pop()  # the URL may go on with the same token
    return Rule(host + path, "place", verdict, rf"^(?:[^/]*\.)?{_quoted(host + path)}{'' if path else '(?:/|$)'}", tuple(dict.fromkeys(found)))


def words(verdict: str, *literal: str) -> Rule:
    """A rule for URLs in which these words follow each other, with one other character between them."""
    return Rule(" ".join(literal), "url", verdict, "(^|[^a-z0-9])" + "[^a-z0-9]".join(map(_quoted, literal)) + "([^a-z0-9]|$)", literal)


def _tokens(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.translate(str.maketrans(_UPPER, _LOWER)))


PLACES = (place("allow", "com", "/"), place("block", "example.com", "/en/"), place("allow", "www.example.com", "/en/"), place("block", "net", "/es/"), place("block", "net", "/fr/"))
#: Where no place rule fits: blocked if one of these says so and none that allows fits.
WORDS = (*(words("block", x) for x in ("ads", "adult", "bets", "casino", "gambling", "malware", "phishing", "pills", "poker", "porn", "spam", "warez", "xxx")), words("block", "free", "download"), words("allow", "adult", "education"), words("allow", "spam", "filter"))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if url is null or has no ://."""
    whole = r"(?s)://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, whole, 1), _UPPER, _LOWER), F.regexp_extract(text, whole, 2)


def _url_tokens(url: Column) -> Column:
    """Distinct tokens, the empty one included."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER), "[^a-z0-9]+")))


def rule_table(spark: SparkSession, rules: tuple[Rule, ...] | DataFrame) -> DataFrame:
    """(name, kind, verdict, pattern, tokens), whatever the rules came as."""
    if isinstance(rules, DataFrame):
        return rules
    data = json.dumps([asdict(r) for r in rules])
    return spark.range(1).select(F.inline(F.from_json(F.lit(data), _SCHEMA)))


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a file of JSON lines: {"verdict": allow or block, "host": ..., "path": ...} for a place, {"verdict": ..., "words":
    [...]} for words that follow each other. Lines that are neither, or whose verdict is another, are an error.
    """

    raw = spark.read.schema("verdict string, host string, path string, words array<string>").json(path)
    wrong = raw.where("verdict is null or verdict not in ('allow', 'block') or (host is null) = (words is null) or exists(words, w -> w is null or not w rlike '^[a-z0-9]+$') or size(words) = 0")
    if not wrong.isEmpty():
        raise ValueError(f"not a rule: {wrong.first()}")
    quoted = lambda c: F.regexp_replace(c, "([^A-Za-z0-9/])", r"\\$1")
    whole = F.concat(F.translate("host", _UPPER, _LOWER), F.coalesce("path", F.lit("")))
    found = F.filter(F.split(F.translate(whole, _UPPER, _LOWER), "[^a-z0-9]+"), lambda t: t != "")
    last = F.when(F.regexp_like("path", F.lit("[A-Za-z0-9]$")), 1).otherwise(0)  # the URL may go on with the same token
    place_rows = raw.where("host is not null").select(
        whole.alias("name"), F.lit("place").alias("kind"), "verdict", F.concat(F.lit(r"^(?:[^/]*\.)?"), quoted(whole), F.when(F.coalesce("path", F.lit("")) == "", "(?:/|$)").otherwise("")).alias("pattern"),
        F.array_distinct(F.slice(found, F.lit(1), F.greatest(F.size(found) - last, F.lit(0)))).alias("tokens"),
    )
    word_rows = raw.where("words is not null").select(
        F.array_join("words", " ").alias("name"), F.lit("url").alias("kind"), "verdict",
        F.concat(F.lit("(^|[^a-z0-9])"), F.array_join("words", "[^a-z0-9]"), F.lit("([^a-z0-9]|$)")).alias("pattern"), F.array_distinct("words").alias("tokens"),
    )
    return place_rows.union(word_rows)


def index(urls: DataFrame, table: DataFrame) -> DataFrame:
    """The rules, each with the token that it is filed under. Counts the rules' tokens over all urls."""
    wanted = table.select(F.explode("tokens").alias("token")).distinct()
    held = urls.select(F.explode(_url_tokens(F.col("url"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    n = wanted.join(held, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))
    each = table.withColumn("token", F.explode_outer("tokens")).join(n, "token", "left")
    rare = each.groupBy("name", "kind", "verdict", "pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token")).alias("rare"))
    return rare.select("name", "kind", "verdict", "pattern", F.coalesce("rare.token", F.lit("")).alias("token"))


def _cell(token: Column, cells: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(cells)).cast("int")


def _packed(filed: DataFrame, cells: int) -> DataFrame:
    """One row: cells, an array whose place c holds the tokens of that hash with their rules; and _one, 0, by which every url finds it."""
    rule = F.struct("name", "kind", "verdict", "pattern")
    by_token = filed.groupBy("token").agg(F.collect_list(rule).alias("rules"))
    by_cell = by_token.groupBy(_cell(F.col("token"), cells).alias("c")).agg(F.collect_list(F.struct("token", "rules")).alias("held"))
    every = filed.sparkSession.range(cells).select(F.col("id").cast("int").alias("c")).join(by_cell, "c", "left")
    ordered = every.groupBy().agg(F.min(F.col("c") * 0).alias("_one"), F.sort_array(F.collect_list(F.struct("c", F.coalesce("held", F.array()).alias("held")))).alias("all"))
    return ordered.select("_one", F.transform("all", lambda x: x["held"]).alias("_cells"))


def _fetch(cells: int):
    """A token's rules, by its cell."""
    return lambda t: F.flatten(F.transform(F.filter(F.element_at("_cells", _cell(t, cells) + 1), lambda e: e["token"] == t), lambda e: e["rules"]))


def judge(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame = PLACES + WORDS, carry: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns of `carry`, host, path, rule and verdict, one row for each row of pages.

    rule: the longest place rule that fits (of equals, the last by name), else null. verdict: that rule's; without one, block if a
    url rule blocks and none allows, else allow. A null url, or one without ://, has an empty host and path and is judged by url
    rules. Repeated rows are judged one by one; other columns are not read. No page is shuffled.
    """
    host, path = split_url(F.col("url"))
    filed = cut(index(pages.select("url"), rule_table(pages.sparkSession, rules)))
    n = filed.count()
    turns = max(1, -(-n // BROADCAST_RULES))
    out = pages.select(*dict.fromkeys((*carry, "url"))).withColumns({"_host": host, "_path": path, "_tokens": _url_tokens(F.col("url")), "_one": F.pmod(F.length(F.coalesce("url", F.lit(""))), F.lit(1)).cast("int")})
    out = out.withColumns({"_best": F.lit(None).cast("struct<size: int, name: string, verdict: string>"), "_said": F.lit(0)})
    for turn in range(turns):
        if turn:
            out = cut(out)
        part = filed if turns == 1 else filed.where(F.pmod(F.xxhash64("name", "kind", "pattern"), F.lit(turns)) == turn)
        cells = max(16, 2 * min(n, BROADCAST_RULES))
        out = out.join(F.broadcast(_packed(part, cells)), "_one")
        place_text, url_text = F.concat("_host", "_path"), F.translate(F.coalesce("url", F.lit("")), _UPPER, _LOWER)

        hits = F.filter(F.flatten(F.transform("_tokens", _fetch(cells))), lambda r: F.regexp_like(F.when(r["kind"] == "place", place_text).otherwise(url_text), r["pattern"]))
        out = out.withColumn("_hits", hits)
        places = F.transform(F.filter("_hits", lambda r: r["kind"] == "place"), lambda r: F.struct(F.length(r["name"]).alias("size"), r["name"].alias("name"), r["verdict"].alias("verdict")))
        said = F.array_max(F.transform(F.filter("_hits", lambda r: r["kind"] == "url"), lambda r: F.when(r["verdict"] == "allow", 2).otherwise(1)))
        out = out.withColumns({"_best": F.greatest(F.col("_best"), F.array_max(places)), "_said": F.greatest(F.col("_said"), F.coalesce(said, F.lit(0)))}).drop("_cells", "_hits")
    verdict = F.coalesce(F.col("_best.verdict"), F.when(F.col("_said") == 1, "block").otherwise("allow"))
    return out.select(*carry, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_best.name").alias("rule"), verdict.alias("verdict"))
