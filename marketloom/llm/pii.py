"""Personal data by base patterns and bootstrapped contextual extraction, in DataFrame functions.

The base patterns find e-mail addresses, IP addresses, card numbers and phone numbers. Those are
the seeds. Words beside a seed make lexical patterns (the word before, the word after, both), and
patterns and instances form a graph: an instance is a base find or any other word with a digit or
an at sign. In each round a pattern's confidence for a kind is the part of its distinct instances
that are known to be of that kind, and an instance's score combines the confidences of the trusted
patterns around it; instances above the bar become known and teach the next round.

Patterns and instances are only ever counted: a frequent context word is pre-aggregated where it
lies, and no context's instances are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

KINDS = ("email", "ip", "card", "phone")
SPACE = r"\x20\x09-\x0D"
LOCAL, DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
# Each finds what its plain form finds, leftmost and without overlaps, in time linear in the text:
# an attempt starts at the beginning of a run only (or where the match before ended), and runs are
# not given back where that cannot help.
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{DOMAIN}++(?:\.{DOMAIN}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Words that may be identifiers: with a digit or an at sign.
CANDIDATE = rf"(?:^|(?<=[{SPACE}]))[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+"
CONTEXT_CHARS = 64
SPAN = "array<struct<start:bigint,stop:bigint,surface:string,before:string,after:string>>"


def luhn(digits: Column) -> Column:
    def value(at: Column) -> Column:
        d = F.substring(F.reverse(digits), at + 1, F.lit(1)).cast("int") * (at % 2 + 1)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda t, i: t + value(i))
    return total % 10 == 0


def holds(kind: str, surface: Column) -> Column:
    """What a match of a base pattern must satisfy besides."""
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return surface.rlike(rf"^{part}(?:\.{part}){{3}}$")
    digits = F.regexp_replace(surface, "[^0-9]", "")
    if kind == "card":
        # The check sum is worked out for numbers of a fit length only.
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def spans(found: Column, parts: Column) -> Column:
    """Places of the matches ``found`` from the texts between them, with the words around."""
    n = F.size(found)
    rows = F.arrays_zip(found.alias("m"), F.slice(parts, F.lit(1), n).alias("p"), F.slice(parts, F.lit(2), n).alias("q"))

    def add(state: Column, row: Column) -> Column:
        start = state["at"] + F.length(row["p"])
        stop = start + F.length(row["m"])
        one = F.struct(start.alias("start"), stop.alias("stop"), row["m"].alias("surface"),
                       F.substring(row["p"], -CONTEXT_CHARS, CONTEXT_CHARS).alias("before"),
                       F.substring(row["q"], 1, CONTEXT_CHARS).alias("after"))
        return F.struct(stop.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("out"))
    return F.aggregate(rows, start, add)["out"]


def context(side: str) -> Column:
    """The word beside an instance: lower case, digits as 0; NULL where none is near."""
    text = F.col(side)
    word = (F.regexp_extract(text, rf"([^{SPACE}]+)[{SPACE}]+$", 1) if side == "before"
            else F.regexp_extract(text, rf"^[^{SPACE}]*[{SPACE}]+([^{SPACE}]+)", 1))
    return F.nullif(F.regexp_replace(F.lower(word), "[0-9]+", "0"), F.lit(""))


def found_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, email, ip, card, phone, other``: arrays of places per row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    hint = {"email": text.contains("@"), "phone": text.contains("+")}
    digits = text.rlike("[0-9]")
    patterns = PATTERNS | {"other": CANDIDATE}
    none = F.array().cast("array<string>")
    cols = []
    for kind, pattern in patterns.items():
        if_any = hint.get(kind, digits | text.contains("@") if kind == "other" else digits)
        cols += [F.when(if_any, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none).alias(f"{kind}_m"),
                 F.when(if_any, F.split(text, pattern, -1)).otherwise(none).alias(f"{kind}_p")]
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_key"), *cols)
    def fit(kind: str) -> Column:
        at = spans(F.col(f"{kind}_m"), F.col(f"{kind}_p"))
        return (F.filter(at, lambda s: holds(kind, s["surface"])) if kind in PATTERNS else at).alias(kind)

    rows = rows.select("doc_id", "text_key", *map(fit, patterns))
    base = F.concat(*[F.col(k) for k in KINDS])
    free = F.filter("other", lambda c: ~F.exists(base, lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"])))
    return rows.withColumn("other", free)


def instances(found: DataFrame) -> DataFrame:
    """One row per seed or candidate: ``doc_id, text_key, kind, start, stop, surface`` and contexts.

    ``kind`` is NULL for candidates; marks around a candidate word are not part of it.
    """
    def tag(kind: str) -> Column:
        name = F.lit(kind if kind in KINDS else None).cast("string").alias("kind")
        return F.transform(kind, lambda s: F.struct(name, s.alias("s")))

    tagged = F.concat(*map(tag, (*KINDS, "other")))
    rows = found.select("doc_id", "text_key", F.explode(tagged).alias("t")).select("doc_id", "text_key", "t.kind", "t.s.*")
    lead = F.length(F.regexp_extract("surface", r"^[\"'(\[<{]*", 0))
    bare = F.regexp_replace(F.col("surface"), r"^[\"'(\[<{]+|[.,;:!?\"')\]>}]+$", "")
    loose = F.col("kind").isNull()
    return (rows.select("doc_id", "text_key", "kind",
                        F.when(loose, F.col("start") + lead).otherwise(F.col("start")).alias("start"),
                        F.when(loose, F.col("start") + lead + F.length(bare)).otherwise(F.col("stop")).alias("stop"),
                        F.when(loose, bare).otherwise(F.col("surface")).alias("surface"),
                        context("before").alias("left"), context("after").alias("right"))
            .filter("surface <> ''"))


def bootstrap(found: DataFrame, rounds: int, support: int, trust: float, accept: float) -> DataFrame:
    """``surface, kind`` of the identifiers that contexts reveal beyond the base patterns."""
    both = F.when(F.col("left").isNotNull() & F.col("right").isNotNull(), F.concat_ws(" _ ", "left", "right"))
    patterns = F.filter(F.array(F.concat(F.col("left"), F.lit(" _")), F.concat(F.lit("_ "), F.col("right")), both),
                        lambda p: p.isNotNull())
    # The graph: each distinct pair of pattern and instance once.
    edges = cut_lineage(found.select(F.explode(patterns).alias("pattern"), "surface", "kind").distinct())
    known = edges.filter("kind is not null").select("surface", "kind").distinct()
    for _ in range(rounds):
        of_pattern = edges.groupBy("pattern").agg(F.count_distinct("surface").alias("all"))
        conf = (edges.select("pattern", "surface").distinct().join(known, "surface").groupBy("pattern", "kind")
                .agg(F.count("*").alias("hits")).filter(F.col("hits") >= support)
                .join(of_pattern, "pattern")
                .withColumn("conf", F.col("hits") / (F.col("all") + 1)).filter(F.col("conf") >= trust)
                .select("pattern", F.col("kind").alias("k"), "conf"))
        scores = (edges.filter("kind is null").select("pattern", "surface").distinct().join(conf, "pattern")
                  .groupBy("surface", "k").agg(F.sum(F.log1p(-F.col("conf"))).alias("miss"))
                  .filter(F.col("miss") <= F.log(F.lit(1.0 - accept))))
        best = (scores.groupBy("surface").agg(F.min(F.struct("miss", "k")).alias("b"))
                .select("surface", F.col("b.k").alias("kind")))
        fresh = best.join(known.select("surface"), "surface", "left_anti")
        known = cut_lineage(known.unionByName(fresh))
    seeds = edges.filter("kind is not null").select("surface")
    return known.join(seeds, "surface", "left_anti")


def personal_data(docs: DataFrame, rounds: int = 3, support: int = 3, trust: float = 0.6,
                  accept: float = 0.8) -> DataFrame:
    """``doc_id, base, added`` per row of ``docs (doc_id, text)``.

    Both are arrays of ``struct<kind, start, stop>`` in order of kind (as in ``KINDS``) and start,
    in code points, end exclusive. ``base`` holds the base patterns' finds and ``added`` those of
    the contexts. A pattern is trusted with ``support`` distinct known instances of a kind that are
    at least the part ``trust`` of all its instances plus one; an instance is taken when the chance
    that all its trusted patterns are wrong is at most 1 - ``accept``. NULL text counts as empty.
    Repeated rows give repeated results. Runs jobs while it is called.
    """
    found = cut_lineage(found_spans(docs))
    seen = cut_lineage(instances(found))
    revealed = bootstrap(seen, rounds, support, trust, accept)
    # Names of their own, so that the joins below do not meet columns of both sides.
    extra = (seen.filter("kind is null").drop("kind").join(revealed, "surface")
             .groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("kind", "start", "stop")).alias("added"))
             .select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), "added"))

    def place(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"),
                                                    s["stop"].alias("stop")))

    base = F.concat(*map(place, KINDS))
    rows = (found.select("doc_id", "text_key", base.alias("base"))
            .join(extra, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_k")), "left"))
    empty = F.array().cast("array<struct<kind:string,start:bigint,stop:bigint>>")
    return rows.select("doc_id", "base", in_order(F.coalesce("added", empty)).alias("added"))


def in_order(found: Column) -> Column:
    """Spans by kind as listed, then start."""
    place = F.map_from_arrays(F.array(*map(F.lit, KINDS)), F.array(*map(F.lit, range(len(KINDS)))))
    keyed = F.transform(found, lambda s: F.struct(place[s["kind"]].alias("o"), s["start"].alias("start"),
                                                  s["stop"].alias("stop"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"),
                                                               s["stop"].alias("stop")))


def printed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["stop"].cast("string"))), ",")
