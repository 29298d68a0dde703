"""Scoring functions on columns. The clock is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom import constants as K


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def saturated(weight: Column) -> Column:
    """A term's weighted frequency on BM25's scale."""
    return weight * (K.K1 + 1) / (K.K1 + weight)


def dot(a: Column, b: Column) -> Column:
    """Inner product; the cosine of unit vectors. Null for vectors of different lengths."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x))


def rescale_cosine(cos: Column) -> Column:
    return clamp((cos - K.SEMANTIC_FLOOR) / K.SEMANTIC_SPAN)


def absolute_keyword(raw: Column, ideal: Column) -> Column:
    """The raw score between a noise floor and a full match, times the share of the query that matched; null if that is nothing."""
    low = F.least(F.lit(K.KEYWORD_FLOOR), K.COVERAGE_FLOOR * ideal)
    high = F.least(F.lit(K.KEYWORD_FULL), K.COVERAGE_FULL * ideal)
    magnitude = clamp((raw - low) / (high - low))
    return F.when((ideal > 0) & (magnitude > 0), magnitude * clamp(raw / ideal / K.COVERAGE_FLOOR))


def phrase_contribution(phrase: Column) -> Column:
    return F.when(phrase > K.PHRASE_FLOOR, (phrase - K.PHRASE_FLOOR) / (1 - K.PHRASE_FLOOR)).otherwise(0.0)


def long_doc_factor(n_chunks: Column, reference: Column, keyword: Column) -> Column:
    """Shrinks the dense score of documents with more chunks than the reference; keyword evidence waives it."""
    raw = F.pow(reference / n_chunks, F.lit(K.LONG_ALPHA))
    return F.when(n_chunks <= reference, 1.0).otherwise(raw + (1 - raw) * clamp(keyword / K.LONG_WAIVER))


def section_chunks(own: Column, parent: Column, beta: float = 1.0) -> Column:
    """Between a section's own number of chunks and its parent's, on a logarithmic scale."""
    if beta <= 0:
        return own.cast("double")
    if beta >= 1:
        return parent.cast("double")
    return F.exp((1 - beta) * F.log(F.greatest(F.lit(1), own)) + beta * F.log(F.greatest(F.lit(1), parent)))


def _days(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 86_400_000_000.0


def recency_factor(modified: Column, as_of: Column) -> Column:
    """1 for an unknown date; falls to a floor with age."""
    age = F.greatest(F.lit(0.0), _days(as_of, modified))
    return F.when(modified.isNull(), 1.0).otherwise(K.RECENCY_FLOOR + (1 - K.RECENCY_FLOOR) * F.exp(-age / K.RECENCY_DAYS))


def near_factor(modified: Column, anchor: Column) -> Column:
    """Halves towards a floor with each 180 days from the anchor; 1 without an anchor or a date."""
    days = F.abs(_days(modified, anchor))
    return F.when(modified.isNull() | anchor.isNull(), 1.0).otherwise(K.RECENCY_FLOOR + (1 - K.RECENCY_FLOOR) * F.pow(F.lit(0.5), days / K.RECENCY_DAYS))


def tier_boost(tier: Column, indexed: Column) -> Column:
    return F.when(tier == "archive", K.BOOST_ARCHIVE).when(indexed, K.BOOST_INDEXED).otherwise(K.BOOST_HOT)


def provenance(keyword: Column, semantic: Column, phrase: Column) -> Column:
    return F.when((keyword > 0) & (semantic > 0.35), "both").when(keyword > 0, "keyword").when(phrase > 0.2, "phrase").otherwise("semantic")


def matches_expected(actual: Column, expected: Column) -> Column:
    """~text: contains, whatever the case; >=N, <=N, >N, <N: compares numbers, false where there is none; else equality. Both are trimmed."""
    a, e = F.trim(F.coalesce(actual, F.lit(""))), F.trim(F.coalesce(expected, F.lit("")))
    compares = r"^(>=|<=|>|<)\s*(-?[0-9]+(?:\.[0-9]+)?)$"
    sign, bound = F.regexp_extract(e, compares, 1), F.regexp_extract(e, compares, 2).try_cast("double")
    number = F.when(a == "", 0.0).otherwise(a.try_cast("double"))  # nothing counts as 0
    number = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    holds = F.when(sign == ">=", number >= bound).when(sign == "<=", number <= bound).when(sign == ">", number > bound).otherwise(number < bound)
    return (
        F.when(e.startswith("~"), F.contains(F.lower(a), F.lower(F.trim(F.substr(e, F.lit(2))))))
        .when(sign != "", F.coalesce(holds, F.lit(False)))
        .otherwise(a == e)
    )
