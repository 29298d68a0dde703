"""What documents are made of: chunks, sections, outlines, links, tiers and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import constants as K
from corpusloom.functions.text import chunks, slug, version_of, wikilinks


def chunk_table(docs: DataFrame) -> DataFrame:
    """corpus, name, chunk_ix, text."""
    return docs.select("corpus", "name", F.posexplode(chunks("body")).alias("chunk_ix", "text"))


def lines(docs: DataFrame) -> DataFrame:
    """corpus, name, line_no (from 0), line, fenced: whether the line is in a ``` fence or opens or closes one, and char_start."""
    rows = docs.select("corpus", "name", F.posexplode(F.split(F.coalesce("body", F.lit("")), "\n")).alias("line_no", "line"))
    order = Window.partitionBy("corpus", "name").orderBy("line_no")
    fence = F.when(F.col("line").rlike(r"^\s*(```|~~~)"), 1).otherwise(0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_fences": F.sum(fence).over(order), "_mark": fence, "char_start": F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0))})
    return rows.withColumn("fenced", (F.col("_fences") % 2 == 1) | (F.col("_mark") == 1)).drop("_fences", "_mark")


def sections(docs: DataFrame, least: int = K.SECTION_CHARS) -> DataFrame:
    """corpus, name, section_no, heading, slug, text, char_start, char_end: blocks that start with ## outside fences, `least` characters or more.
    char_end is where the next line would start.

    Equal slugs of a document get -2, -3, ... in order.
    """
    rows = lines(docs).withColumn("opens", F.when(~F.col("fenced") & F.col("line").rlike(r"^##\s+\S"), 1).otherwise(0))
    order = Window.partitionBy("corpus", "name").orderBy("line_no")
    rows = rows.withColumn("section_no", F.sum("opens").over(order)).where("section_no > 0")
    made = rows.groupBy("corpus", "name", "section_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"),
        F.min("char_start").alias("char_start"),
        F.max(F.col("char_start") + F.length("line") + 1).alias("char_end"),
    ).where(F.length("text") >= least)
    made = made.withColumn("heading", F.trim(F.regexp_extract("text", r"^##\s+([^\n]*)", 1))).withColumn("slug", slug("heading"))
    again = F.row_number().over(Window.partitionBy("corpus", "name", "slug").orderBy("section_no"))
    made = made.withColumn("_n", again)
    return made.withColumn("slug", F.when(F.col("_n") > 1, F.concat_ws("-", "slug", "_n")).otherwise(F.col("slug"))).select("corpus", "name", "section_no", "heading", "slug", "text", "char_start", "char_end")


def section_tiers(parts: DataFrame, keep: int = K.KEPT_VERSIONS) -> DataFrame:
    """tier of each section: archive if its heading says STALE, or if its version isn't one of the newest `keep` of its parent."""
    v = version_of("heading")
    rank = F.dense_rank().over(Window.partitionBy("corpus", "name").orderBy(F.desc_nulls_last("version")))
    rows = parts.withColumn("version", v).withColumn("_r", rank)
    stale = F.col("heading").rlike(r"\bSTALE\b") | (F.col("version").isNotNull() & (F.col("_r") > keep))
    return rows.withColumn("tier", F.when(stale, "archive").otherwise("hot")).drop("_r")


def with_section_docs(docs: DataFrame, chars: int = K.SECTION_PARENT_CHARS, count: int = K.SECTION_COUNT) -> DataFrame:
    """Documents, with those of `chars` or more and `count` sections or more cut into section rows beside a stub of headings.

    docs: corpus, name, file, type, description, body, tier. Adds parent_name, heading, is_section, is_section_parent.
    """
    able = (F.length("body") >= chars) & (F.coalesce("file", "name") != "MEMORY.md") & (F.coalesce("type", F.lit("")) != "exchange")
    parts = section_tiers(sections(docs.where(able)))
    parents = parts.groupBy("corpus", "name").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("section_no", "heading"))).alias("list")).where(F.col("n") >= count)
    base = ["corpus", "name", "file", "type", "description", "body", "tier"]
    children = parts.drop("tier").join(parents.select("corpus", "name"), ["corpus", "name"], "left_semi").join(section_tiers(parts.drop("tier", "version")).select("corpus", "name", "section_no", "tier"), ["corpus", "name", "section_no"])
    children = children.join(docs.select("corpus", "name", "file", "type", F.col("tier").alias("parent_tier")), ["corpus", "name"])
    child = children.select(
        "corpus", F.concat_ws("#", "name", "slug").alias("name"), "file", "type", F.col("heading").alias("description"), F.col("text").alias("body"),
        F.when(F.col("parent_tier") == "archive", "archive").otherwise(F.col("tier")).alias("tier"), F.col("name").alias("parent_name"), "heading", F.lit(True).alias("is_section"), F.lit(False).alias("is_section_parent"),
    )
    own = docs.join(parents, ["corpus", "name"], "left")
    stub = F.array_join(F.transform("list", lambda x: F.concat(F.lit("## "), x["heading"])), "\n")
    own = own.select(*base[:5], F.when(F.col("n").isNotNull(), stub).otherwise(F.col("body")).alias("body"), "tier", F.lit(None).cast("string").alias("parent_name"), F.lit(None).cast("string").alias("heading"), F.lit(False).alias("is_section"), F.col("n").isNotNull().alias("is_section_parent"))
    return own.unionByName(child)


def outline(docs: DataFrame) -> DataFrame:
    """corpus, name, heading_no, level, heading, char_start, char_end: a section ends at the next heading of its level or above."""
    heads = lines(docs).where(~F.col("fenced") & F.col("line").rlike(r"^#{1,6}\s+\S"))
    order = Window.partitionBy("corpus", "name").orderBy("line_no")
    heads = heads.select("corpus", "name", "line_no", "char_start", F.length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), F.trim(F.regexp_extract("line", r"^#+\s+(.*)$", 1)).alias("heading")).withColumn("heading_no", F.row_number().over(order))
    after = order.rowsBetween(1, Window.unboundedFollowing)
    later = F.collect_list(F.struct("level", "char_start")).over(after)
    ends = F.array_min(F.transform(F.filter(later, lambda x: x["level"] <= F.col("level")), lambda x: x["char_start"]))
    total = docs.select("corpus", "name", F.length("body").alias("_size"))
    return heads.withColumn("_end", ends).join(total, ["corpus", "name"]).select("corpus", "name", "heading_no", "level", "heading", "char_start", F.coalesce("_end", "_size").alias("char_end"))


def section_of(heads: DataFrame, wanted: str) -> DataFrame:
    """The heading of each document that wanted names: equal to it, else starting with it, else holding it; the first of equals."""
    h, w = F.lower("heading"), wanted.strip().lower()
    rank = F.when(h == w, 1).when(h.startswith(w), 2).when(F.contains(h, F.lit(w)), 3)
    return heads.withColumn("_r", rank).where("_r is not null").groupBy("corpus", "name").agg(F.min_by(F.struct("heading_no", "level", "heading", "char_start", "char_end"), F.struct("_r", "heading_no")).alias("s")).select("corpus", "name", "s.*")


def view(docs: DataFrame, offset: int = 0, most: int = 20_000) -> DataFrame:
    """corpus, name, text, total, truncated: `most` characters of each body from `offset`."""
    return docs.select("corpus", "name", F.substring("body", offset + 1, most).alias("text"), F.length("body").alias("total"), ((F.length("body") > offset + most) | F.lit(offset > 0)).alias("truncated"))


def link_edges(docs: DataFrame) -> DataFrame:
    """corpus, src, slug, dst: each link resolved by name, else by file name without .md; dst null if neither exists. No links to self."""
    found = docs.select("corpus", F.col("name").alias("src"), F.explode(wikilinks("body")).alias("slug"))
    names = docs.select("corpus", F.col("name").alias("slug"), F.col("name").alias("by_name"))
    file = F.coalesce("file", "name") if "file" in docs.columns else F.col("name")
    files = docs.select("corpus", F.regexp_replace(file, r"\.md$", "").alias("slug"), "name").groupBy("corpus", "slug").agg(F.min("name").alias("by_file"))
    edges = found.join(names, ["corpus", "slug"], "left").join(files, ["corpus", "slug"], "left").select("corpus", "src", "slug", F.coalesce("by_name", "by_file").alias("dst"))
    return edges.where("dst is null or dst <> src")


def neighbours(docs: DataFrame) -> DataFrame:
    """corpus, name, outbound, inbound, unresolved: sorted lists."""
    e = link_edges(docs)
    out = e.groupBy("corpus", F.col("src").alias("name")).agg(F.array_sort(F.collect_set("dst")).alias("outbound"), F.array_sort(F.collect_set(F.when(F.col("dst").isNull(), F.col("slug")))).alias("unresolved"))
    back = e.where("dst is not null").groupBy("corpus", F.col("dst").alias("name")).agg(F.array_sort(F.collect_set("src")).alias("inbound"))
    empty = F.array().cast("array<string>")
    joined = docs.select("corpus", "name").join(out, ["corpus", "name"], "left").join(back, ["corpus", "name"], "left")
    return joined.select("corpus", "name", *(F.coalesce(c, empty).alias(c) for c in ("outbound", "inbound", "unresolved")))


def listed(docs: DataFrame, listing: DataFrame) -> DataFrame:
    """in_memory_index, and tier hot for archived documents that the listing (corpus, body) names by [[link]] or ](file.md)."""
    md = F.regexp_extract_all("body", F.lit(r"\]\(([^)\s]+)\.md\)"), F.lit(1))
    wanted = listing.select("corpus", F.explode(F.array_union(wikilinks("body"), md)).alias("key")).distinct()
    base = F.regexp_replace(F.coalesce("file", "name"), r"\.md$", "")
    keyed = docs.select("corpus", "name", F.explode(F.array_distinct(F.array(F.col("name"), base))).alias("key")).join(wanted, ["corpus", "key"], "left_semi").select("corpus", "name").distinct()
    rows = docs.drop("in_memory_index").join(keyed.withColumn("in_memory_index", F.lit(True)), ["corpus", "name"], "left")
    return rows.withColumn("in_memory_index", F.coalesce("in_memory_index", F.lit(False))).withColumn("tier", F.when(F.col("in_memory_index"), "hot").otherwise(F.col("tier")))


def version_tiers(docs: DataFrame, keep: int = K.KEPT_VERSIONS) -> DataFrame:
    """tier archive for all but the newest `keep` of three or more names that differ only in one v<number>."""
    n = F.size(F.regexp_extract_all("name", F.lit(r"(?i)(?<![a-z0-9])v\d{1,4}(?![a-z0-9])"), F.lit(0)))
    stem = F.when(n == 1, F.regexp_replace("name", r"(?i)(?<![a-z0-9])v\d{1,4}(?![a-z0-9])", "v"))
    v = F.regexp_extract("name", r"(?i)(?<![a-z0-9])v(\d{1,4})(?![a-z0-9])", 1).try_cast("int")
    rows = docs.withColumns({"_stem": stem, "_v": v})
    w = Window.partitionBy("corpus", F.coalesce("_stem", F.concat(F.lit("\x01"), "name")))
    old = F.col("_stem").isNotNull() & (F.count("*").over(w) >= 3) & (F.row_number().over(w.orderBy(F.desc("_v"), "name")) > keep)
    return rows.withColumn("_old", old).withColumn("tier", F.when(F.col("_old"), "archive").otherwise(F.col("tier"))).drop("_stem", "_v", "_old")


def corpus_hash(files: DataFrame) -> DataFrame:
    """corpus, hash: of its sorted file:hash entries."""
    entry = F.concat_ws(":", "file", "hash")
    return files.groupBy("corpus").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), "|"), 256).alias("hash"))


def move_tier(docs: DataFrame, names: list[str], tier: str) -> DataFrame:
    """Demotes or promotes documents; read-only ones, and listed ones on demotion, stay as they are and are marked refused."""
    wanted = F.col("name").isin(*names)
    refused = wanted & (F.coalesce("read_only", F.lit(False)) | (F.lit(tier == "archive") & F.coalesce("in_memory_index", F.lit(False))))
    return docs.withColumn("refused", refused).withColumn("tier", F.when(wanted & ~refused, tier).otherwise(F.col("tier")))


def chunks_per_file(docs: DataFrame) -> DataFrame:
    """corpus, file, n_chunks, share: and whether one file holds a quarter or more of 200 or more chunks."""
    n = docs.groupBy("corpus", F.coalesce("file", "name").alias("file")).agg(F.sum("n_chunks").alias("n_chunks"))
    share = F.col("n_chunks") / F.sum("n_chunks").over(Window.partitionBy("corpus"))
    return n.withColumn("share", share).withColumn("large", (F.col("n_chunks") >= 200) & (F.col("share") >= 0.25))


def alone(word: Column) -> Column:
    """A pattern for a word that stands alone."""
    return F.concat(F.lit("(?<![a-z0-9_])\\Q"), word, F.lit("\\E(?![a-z0-9_])"))
