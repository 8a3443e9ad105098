"""Text expressions: tokens, similarity, URL normalisation, percentages, timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns.
TOKEN = "([a-z0-9]+)"
PERCENTAGE = r"([-+]?\d*\.?\d+\s*%)"
UTC_OFFSET = r"(Z|z|[+-]\d{2}:?\d{2})$"


def tokens(text: Column) -> Column:
    """Distinct ASCII word tokens of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))),
                                                 F.lit(TOKEN), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Token-set similarity; 0 when either side is empty."""
    shared = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - shared
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / total).otherwise(F.lit(0.0))


def url_key(url: Column, query_first: bool = False) -> Column:
    """Lower-cased URL without trailing slashes, query and fragment.

    Slashes are stripped before the query by default; ``query_first`` strips the query first so
    that ``/a/?q`` and ``/a`` agree.
    """
    def no_slash(c): return F.regexp_replace(c, "/+$", "")
    def no_query(c): return F.regexp_replace(c, "[?#].*$", "")
    low = F.lower(F.coalesce(url, F.lit("")))
    return no_slash(no_query(low)) if query_first else no_query(no_slash(low))


def percentages(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PERCENTAGE), F.lit(1))


def utc_timestamp(text: Column) -> Column:
    """Parsed instant, NULL when unparsable or without an explicit offset."""
    padded = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(text.rlike(UTC_OFFSET), F.try_to_timestamp(padded))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def minutes_since(received: Column, decision: Column) -> Column:
    """Minutes from receipt to decision, never negative."""
    return F.greatest(F.lit(0.0), (micros(decision) - micros(received)) / 60e6)


def parse_surprise(text: Column) -> Column:
    """Surprise struct from a stated beat or miss such as "beat revenue estimates by 5%".

    NULL when the text states no figure; nothing is inferred.
    """
    pattern = r"(?i)(beat|beats|missed|misses)\s+(\w+)\s+(?:estimates|expectations)\s+by\s+(\d*\.?\d+)\s*%"
    verb = F.lower(F.regexp_extract(text, pattern, 1))
    size = F.try_to_number(F.regexp_extract(text, pattern, 3), F.lit("999999.999999")).cast("double")
    sign = F.when(verb.startswith("miss"), -1.0).otherwise(1.0)
    return F.when(verb != "", F.struct(
        F.lower(F.regexp_extract(text, pattern, 2)).alias("metric"),
        F.lit(None).cast("double").alias("expected"), F.lit(None).cast("double").alias("actual"),
        (sign * size).alias("surprise_pct"), F.lit("article_text").alias("expectation_source")))
