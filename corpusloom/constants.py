"""Fixed values of the engine's definitions. SQL twins read the same values, so that the two can't drift apart."""

from __future__ import annotations

# Words that are no search terms.
STOP_WORDS = tuple(
    "a an and are as at be but by do does for from how i if in into is it its my of on or that the then there these this to was "
    "what when where which who will with you your me we can should would about use using".split()
)

# BM25F.
K1, B = 1.2, 0.75
NAME_WEIGHT, DESCRIPTION_WEIGHT, HEADING_WEIGHT, BODY_WEIGHT, FACT_WEIGHT = 3.0, 2.0, 1.5, 0.3, 2.5

# Fusion of the legs, and how each is scaled.
FUSE_KEYWORD, FUSE_SEMANTIC, FUSE_PHRASE, PHRASE_FLOOR = 0.42, 0.42, 0.16, 0.35
RERANK, SNIPPET_CHARS, LIMIT = 30, 320, 8
SEMANTIC_FLOOR, SEMANTIC_SPAN = 0.40, 0.30
KEYWORD_FLOOR, KEYWORD_FULL, COVERAGE_FLOOR, COVERAGE_FULL = 8.0, 20.0, 0.60, 0.85
LONG_ALPHA, LONG_WAIVER, LONG_QUANTILE = 0.35, 0.45, 0.90
ARCHIVE_SHARE, ROWS_PER_FILE = 0.5, 1
BOOST_ARCHIVE, BOOST_HOT, BOOST_INDEXED = 1.0, 1.15, 1.25
RECENCY_FLOOR, RECENCY_DAYS = 0.85, 180.0

# When nothing in a corpus matches.
SCORE_FLOOR, VERDICT_PHRASE, VERDICT_COVERAGE, ORPHAN_FLOOR, WEAK_ROWS = 0.38, 0.40, 0.20, 0.40, 3

# Chunks and sections.
CHUNK_WORDS, CHUNK_OVERLAP = 200, 40
SECTION_PARENT_CHARS, SECTION_COUNT, SECTION_CHARS, KEPT_VERSIONS = 20_000, 3, 200, 3

# Graph spreading.
SPREAD_ALPHA, SPREAD_GATE, SPREAD_FROM = 0.10, 0.20, 10

# Transcripts.
REPLY_CHARS, DESCRIPTION_WORDS, COMMIT_TAIL_MINUTES, COMMITS_KEPT = 200, 40, 30, 12

# Query log and curation.
RETRY_SECONDS, FAILURE_SHAPES, DEAD_TERMS, DEAD_TERM_FAILURES = 180, 10, 12, 3
QUEUE_LIMIT, CLAIM_TERMS, CLAIM_SHARE, SUPERSEDE_SIMILARITY = 40, 3, 0.34, 0.55
CURATION_HOURS, CURATION_DOCS, RESCORE_DAYS = 24, 25, 7

# Vectors and views.
DIMENSIONS = 384
BRIEF_ROWS, BRIEF_SNIPPET, BRIEF_DESCRIPTION = 2, 160, 140
WORK_CORPORA = ("curated", "projects", "staging", "handoff")
