"""URL filters by a temporal list join.

A list is a log of dated entries: at some time a host, a domain with everything below it, or a URL
prefix was put on the list or taken off. The log becomes validity intervals, and an as-of join
holds every capture against the entries that were active when it was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, unpacked

# Kinds of entries, the most specific last: the latter wins where several are active.
DOMAIN, HOST, PREFIX = "domain", "host", "prefix"
# Intervals are cut at such spans, so that a capture meets few intervals of a key.
SPAN_SECONDS = 30 * 86400


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and trailing dot; empty where there is none."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(rest, r"^.*@", ""), r"\.?(:[0-9]*)?$", ""))


def path_of(url: Column) -> Column:
    """Path without query and fragment, beginning with a slash."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(rest == "", "/").otherwise(rest)


def keys_of(url: Column) -> Column:
    """Every entry key that could match a URL, as ``struct<kind, key>``.

    Domains: the host and all its parents. Prefixes: host plus every leading run of path segments.
    """
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(
        F.lit(DOMAIN).alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key")))
    steps = F.split(F.regexp_replace(path, "^/|/$", ""), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.struct(
        F.lit(PREFIX).alias("kind"),
        F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")).alias("key")))
    own = F.array(F.struct(F.lit(HOST).alias("kind"), host.alias("key")))
    return F.when(host == "", F.array().cast("array<struct<kind:string,key:string>>")).otherwise(
        F.array_distinct(F.concat(domains, own, prefixes)))


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals of ``entries (kind, key, action, listed_at)``; action is add or remove.

    An entry holds until the next one of its key; of several at one time the removal counts. Rows
    with a NULL or an unknown action count for nothing. Result: ``kind, key, valid_from, valid_to``
    (exclusive, NULL: open).
    """
    known = entries.filter("kind is not null and key is not null and listed_at is not null "
                           "and action in ('add', 'remove')")
    once = known.groupBy("kind", "key", "listed_at").agg(F.max("action").alias("action"))
    log = Window.partitionBy("kind", "key").orderBy("listed_at")
    return (once.withColumn("valid_to", F.lead("listed_at").over(log)).filter("action = 'add'")
            .select("kind", "key", F.col("listed_at").alias("valid_from"), "valid_to"))


def span_of(at: Column) -> Column:
    return F.floor(F.unix_timestamp(at) / SPAN_SECONDS)


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """``captures`` plus ``blocked, match_kind, match_key, listed_since``.

    The most specific active entry is reported: prefix before host before domain, then the longer
    key. A NULL or malformed URL and a NULL time match nothing. Rows are kept as they are, repeated
    rows too; columns of these names are replaced. Captures are never gathered by key: the list is
    the side that is dealt, and a key meets only the intervals of the capture's span. Runs one small
    job while it is called.
    """
    new = ["blocked", "match_kind", "match_key", "listed_since"]
    own = captures.select(packed(captures), F.col(url).alias("_u"), F.col(at).alias("_t"))
    active = intervals(entries)
    # An open interval reaches to the last capture.
    last = F.lit(captures.agg(F.max(span_of(F.col(at)))).first()[0]).cast("long")
    cut = (active
           .withColumn("from_span", span_of(F.col("valid_from")))
           .withColumn("to_span", F.coalesce(span_of(F.col("valid_to")), last))
           .filter("from_span <= to_span")
           .select("kind", "key", "valid_from", "valid_to", F.explode(F.sequence("from_span", "to_span")).alias("span")))
    probes = (captures.select(F.col(url).alias("_url"), F.col(at).alias("_at")).filter("_url is not null and _at is not null")
              .distinct()
              .select("_url", "_at", F.explode(keys_of(F.col("_url"))).alias("k"))
              .select("_url", "_at", F.col("k.kind").alias("kind"), F.col("k.key").alias("key"),
                      span_of(F.col("_at")).alias("span")))
    hits = (probes.join(cut, ["kind", "key", "span"])
            .filter((F.col("valid_from") <= F.col("_at"))
                    & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to")))))
    rank = F.when(F.col("kind") == PREFIX, 2).when(F.col("kind") == HOST, 1).otherwise(0)
    best = (hits.groupBy("_url", "_at")
            .agg(F.max(F.struct(rank.alias("rank"), F.length("key").alias("size"), "kind", "key", "valid_from")).alias("m"))
            .select("_url", "_at", F.col("m.kind").alias("match_kind"), F.col("m.key").alias("match_key"),
                    F.col("m.valid_from").alias("listed_since")))
    return (own.join(best, (F.col("_u") == F.col("_url")) & (F.col("_t") == F.col("_at")), "left")
            .select(*unpacked(captures, *new), F.col("match_key").isNotNull().alias("blocked"), *new[1:]))


def list_from_captures(captures: DataFrame) -> DataFrame:
    """A list for data that brings none: entries about the hosts, domains and sections seen.

    Every key of every host goes on the list and off again at times that its hash gives, and some
    come back, so all cases of the join occur and the list grows with the table.
    """
    kinds = {DOMAIN: 11, HOST: 7, PREFIX: 5}
    keys = (captures.filter("url is not null").select(F.explode(keys_of(F.col("url"))).alias("k"))
            .select("k.kind", "k.key").distinct()
            .withColumn("h", F.conv(F.substring(F.md5(F.concat_ws("|", "kind", "key").cast("binary")), 1, 7), 16, 10).cast("long")))
    chosen = keys.filter(" or ".join(f"(kind = '{k}' and h % {n} = 0)" for k, n in kinds.items()))
    day = F.lit(START).cast("timestamp")
    log = F.array(
        F.struct(F.lit("add").alias("action"), (F.col("h") % 1000).alias("day")),
        F.struct(F.lit("remove").alias("action"), (F.col("h") % 1000 + 30 + F.col("h") % 300).alias("day")),
        F.struct(F.when(F.col("h") % 2 == 0, "add").otherwise("remove").alias("action"),
                 (F.col("h") % 1000 + 400 + F.col("h") % 200).alias("day")))
    return (chosen.select("kind", "key", F.explode(log).alias("e"))
            .select("kind", "key", "e.action", F.timestamp_add("DAY", F.col("e.day").cast("int"), day).alias("listed_at")))


# The tables of this package have no fetch times: page n was fetched n * FETCH_MINUTES minutes,
# taken modulo about four years, after START.
START = "2021-01-01 00:00:00"
FETCH_MINUTES = 997
FETCH_CYCLE = 4 * 365 * 24 * 60


def fetched_at(page_id: Column) -> Column:
    minutes = F.pmod(page_id * FETCH_MINUTES, F.lit(FETCH_CYCLE)).cast("int")
    return F.timestamp_add("MINUTE", minutes, F.lit(START).cast("timestamp"))
