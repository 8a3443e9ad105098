"""Near-duplicate articles: verified similarity links and ordered leader clustering.

Two articles match when they were received within ``horizon`` of each other and have the same
non-empty URL key or headline token sets with Jaccard similarity at or above the threshold.

Articles are never compared one by one. Those with the same token set form a group per
horizon-wide time slot, and so do those with the same URL key; copies are counted, not paired.
Distinct token sets are linked once: two sets with n tokens and a needed overlap of ⌈threshold·n⌉
share a token among the first n − ⌈threshold·n⌉ + 1 in any common order (prefix filter, rarest
first); sizes and positions of the shared token bound the overlap (length and position filter),
and only ids of pairs that are left meet their tokens again to be verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard, tokens, url_key
from ..session import cut_lineage

THRESHOLD = 0.85
HORIZON_SECONDS = 86_400


# ----------------------------------------------------------- linked token sets

def set_id(ordered: Column) -> Column:
    """128 bits that stand for a sorted token set."""
    return F.md5(F.array_join(ordered, " ").cast("binary"))


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """``sid, size, at, token``: prefix tokens of each distinct set, from rare to frequent."""
    words = sets.select("sid", F.explode("tokens").alias("token"))
    counts = words.groupBy("token").agg(F.count("*").alias("n"))
    ranked = (words.join(counts, "token").groupBy("sid")
              .agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("w")))
    size = F.size("w")
    need = F.ceil(size * threshold - 1e-9).cast("int")
    return (ranked.select("sid", size.alias("size"), F.posexplode(F.slice("w", F.lit(1), size - need + 1)).alias("at", "w"))
            .select("sid", "size", "at", F.col("w.token").alias("token")))


def linked_sets(groups: DataFrame, threshold: float) -> DataFrame:
    """``left, right, score, rising``: both directions of every pair of unlike sets that match.

    ``groups``: sid, slot, tokens. Only sets that occur in the same or in neighbouring slots are
    looked at. ``rising``: the left set comes first as text.
    """
    sets = groups.groupBy("sid").agg(F.first("tokens").alias("tokens"))
    seen = groups.select("sid", "slot").join(prefixes(sets, threshold), "sid")
    early = seen.select(F.col("sid").alias("a"), F.col("size").alias("a_size"), F.col("at").alias("a_at"), "token",
                        F.col("slot").alias("a_slot"), F.explode(F.array("slot", F.col("slot") + 1)).alias("slot"))
    late = seen.select(F.col("sid").alias("b"), F.col("size").alias("b_size"), F.col("at").alias("b_at"), "token", "slot")
    total = F.col("a_size") + F.col("b_size")
    overlap = 1 + F.least(F.col("a_size") - F.col("a_at") - 1, F.col("b_size") - F.col("b_at") - 1)
    pairs = (early.join(late, ["token", "slot"])
             .filter((F.col("a") < F.col("b")) | ((F.col("a") != F.col("b")) & (F.col("a_slot") < F.col("slot"))))
             .filter((F.col("a_size") >= F.col("b_size") * threshold - 1e-9) & (F.col("b_size") >= F.col("a_size") * threshold - 1e-9)
                     & (overlap * (1 + threshold) >= total * threshold - 1e-9))
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    text = lambda name: sets.select(F.col("sid").alias(name), F.col("tokens").alias(f"{name}_tokens"))
    scored = (pairs.join(text("a"), "a").join(text("b"), "b")
              .withColumn("score", jaccard(F.col("a_tokens"), F.col("b_tokens"))).filter(F.col("score") >= threshold)
              .withColumn("up", F.array_join("a_tokens", " ") < F.array_join("b_tokens", " ")))
    both = F.explode(F.array(F.struct(F.col("a").alias("left"), F.col("b").alias("right"), "score", F.col("up").alias("rising")),
                             F.struct(F.col("b").alias("left"), F.col("a").alias("right"), "score", (~F.col("up")).alias("rising"))))
    return scored.select(both.alias("_l")).select("_l.*")


def _prepared(events: DataFrame, width: int, *more: str) -> DataFrame:
    """``id, t, slot, tokens, sid, url`` (NULL: none) and ``more`` columns per article version."""
    words = F.array_sort(tokens(F.col("headline")))
    return (events.select(F.concat_ws("#", "event_id", F.col("version").cast("string")).alias("id"),
                          F.unix_micros("received_at").alias("t"), words.alias("tokens"),
                          F.nullif(url_key(F.col("url")), F.lit("")).alias("url"), *more)
            .withColumns({"slot": F.floor(F.col("t") / width), "sid": F.when(F.size("tokens") > 0, set_id(F.col("tokens")))}))


# ------------------------------------------------------------------ edges

def near_dup_edges(events: DataFrame, threshold: float = THRESHOLD,
                   horizon_seconds: int = HORIZON_SECONDS) -> DataFrame:
    """Similarity edges between groups of copies.

    Articles with the same token set (or URL key) received in the same horizon-wide slot form one
    group, represented by its smallest ``event_id#version``, so copies are never paired with each other. Two
    groups are linked when some member pair lies within the horizon: always in the same slot, and
    in neighbouring slots exactly when the later group's first is near the earlier group's last.
    """
    width = horizon_seconds * 1_000_000
    rows = cut_lineage(_prepared(events, width))
    stats = [F.min("id").alias("rep"), F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t")]
    urls = rows.filter("url IS NOT NULL").groupBy(F.col("url").alias("g"), "slot").agg(*stats)
    sets = cut_lineage(rows.filter("sid IS NOT NULL").groupBy(F.col("sid").alias("g"), "slot").agg(
        F.first("tokens").alias("tokens"), *stats))
    links = linked_sets(sets.select(F.col("g").alias("sid"), "slot", "tokens"), threshold)
    itself = sets.select(F.col("g").alias("left"), F.col("g").alias("right"), F.lit(1.0).alias("score"), F.lit(False).alias("rising")).distinct()

    def paired(groups: DataFrame, links: DataFrame, kind: str) -> DataFrame:
        a = groups.select(F.col("g").alias("left"), F.col("rep").alias("left_id"), F.col("n").alias("left_n"),
                          F.col("slot").alias("a_slot"), F.col("last_t").alias("until"))
        b = groups.select(F.col("g").alias("right"), F.col("rep").alias("right_id"), F.col("n").alias("right_n"),
                          F.col("slot").alias("b_slot"), F.col("first_t").alias("since"))
        ahead = a.join(links, "left").withColumn("b_slot", F.explode(F.array("a_slot", F.col("a_slot") + 1)))
        near = ((F.col("a_slot") == F.col("b_slot")) & F.col("rising")) | (
            (F.col("a_slot") < F.col("b_slot")) & (F.col("since") - F.col("until") <= width))
        return ahead.join(b, ["right", "b_slot"]).filter(near).select(
            F.lit(kind).alias("kind"), "left_id", "right_id", "left_n", "right_n", "score")

    own = urls.select(F.col("g").alias("left"), F.col("g").alias("right"), F.lit(1.0).alias("score"), F.lit(False).alias("rising")).distinct()
    return paired(urls, own, "url").unionByName(paired(sets, links.unionByName(itself), "headline"))


# ------------------------------------------------------------- clustering

def group_links(groups: DataFrame, links: DataFrame, width: int) -> DataFrame:
    """``g, slot, other, at``: groups whose articles may match earlier articles of group (other, at).

    ``groups``: g, slot, n, first_t, last_t. A group looks at itself and its linked groups, in its own
    slot and in the one before as far as the horizon reaches.
    """
    itself = groups.select(F.col("g").alias("left"), F.col("g").alias("right")).distinct()
    sides = groups.join(links.unionByName(itself), F.col("g") == F.col("left")).select(
        "g", "slot", "n", "first_t", F.col("right").alias("other"), F.explode(F.array("slot", F.col("slot") - 1)).alias("at"))
    others = groups.select(F.col("g").alias("other"), F.col("slot").alias("at"), F.col("last_t").alias("until"))
    alone = (F.col("g") == F.col("other")) & (F.col("slot") == F.col("at")) & (F.col("n") == 1)
    return (sides.join(others, ["other", "at"])
            .filter(~alone & ((F.col("slot") == F.col("at")) | (F.col("until") >= F.col("first_t") - width)))
            .select("g", "slot", "other", "at"))


def cluster_articles(events: DataFrame, threshold: float = THRESHOLD,
                     horizon_seconds: int = HORIZON_SECONDS, open_heads: DataFrame | None = None) -> DataFrame:
    """Ordered leader clustering: in receipt order an article joins the first earlier head it
    matches, otherwise it becomes a head; heads are compared with articles, never members.

    The heads are the lexicographically first independent set of the match graph, over links of
    groups that are made and verified once. Articles without any match are heads; the others are
    decided in order of receipt, one pass for each component of linked groups (:func:`leaders`),
    however long a chain of articles waits for each other.

    ``open_heads`` are heads of earlier, already clustered articles (same columns as ``events``):
    with them, batches arriving in receipt order give the same clusters as one large batch.
    """
    width = horizon_seconds * 1_000_000
    columns = events.columns
    keyed = events.withColumn("_open", F.lit(False))
    if open_heads is not None:
        keyed = keyed.unionByName(open_heads.select(*columns).withColumn("_open", F.lit(True)))
    keyed = cut_lineage(keyed)
    items = cut_lineage(_prepared(keyed, width, "event_id", F.col("arrival_seq").alias("seq"), F.col("_open").alias("open")))
    # Set ids are 32 hex digits; a mark in front keeps URLs apart from them.
    keys = F.array_compact(F.array(F.concat(F.lit("t:"), "sid"), F.concat(F.lit("u:"), "url")))
    rows = items.select("id", "open", "event_id", "t", "seq", "slot", "sid", "tokens", F.explode(keys).alias("g")).filter("slot IS NOT NULL")
    stats = rows.groupBy("g", "slot").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"),
                                          F.first("sid").alias("sid"), F.first("tokens").alias("tokens"))
    groups = cut_lineage(stats)
    sets = groups.filter("g LIKE 't:%'").select("sid", "slot", "tokens")
    linked = linked_sets(sets, threshold).select(F.concat(F.lit("t:"), "left").alias("left"), F.concat(F.lit("t:"), "right").alias("right"))
    links = cut_lineage(group_links(groups.drop("sid", "tokens"), linked, width))
    touched = links.select("g", "slot").unionByName(links.select(F.col("other").alias("g"), F.col("at").alias("slot"))).distinct()
    me = F.struct("t", "seq", "id")
    linked_rows = cut_lineage(rows.join(touched, ["g", "slot"], "left_semi").select(
        "id", "event_id", "g", "slot", "t", me.alias("me"), "open"))
    state = linked_rows.filter("NOT open")
    if open_heads is not None:
        out = _matched(state, linked_rows.filter("open"), links, width)
        state = cut_lineage(state.join(out, "id", "left_anti"))
    free = items.filter("NOT open").select("id").join(linked_rows.select("id"), "id", "left_anti")
    heads = free.unionByName(leaders(state, links, width))
    heads = cut_lineage(heads)
    # One group and slot holds at most one head: two would match each other.
    shown = linked_rows.join(heads.unionByName(linked_rows.filter("open").select("id")).distinct(), "id", "left_semi").select(
        F.col("g").alias("other"), F.col("slot").alias("at"), F.col("me").alias("head_me"), F.col("event_id").alias("head_event"))
    members = linked_rows.filter("NOT open").join(heads, "id", "left_anti")
    joined = (members.join(links, ["g", "slot"]).join(shown, ["other", "at"])
              .filter((F.col("head_me") < F.col("me")) & (F.col("head_me.t") >= F.col("t") - width))
              .groupBy("id").agg(F.min_by("head_event", "head_me").alias("cluster_id")))
    named = joined.select("id", "cluster_id", F.lit(False).alias("is_head")).unionByName(
        items.join(heads, "id", "left_semi").select("id", F.col("event_id").alias("cluster_id"), F.lit(True).alias("is_head")))
    label = F.concat_ws("#", "event_id", F.col("version").cast("string"))
    return (keyed.filter(~F.col("_open")).withColumn("_id", label).join(named, F.col("_id") == F.col("id"))
            .select(*columns, "cluster_id", "is_head"))


def components(edges: DataFrame) -> DataFrame:
    """``g, root``: the smallest node that each node of ``edges (a, b)`` reaches.

    Each node hands its larger neighbours, then its smaller ones, to the smallest node it knows;
    rounds grow with the logarithm of the longest chain. Runs jobs.
    """
    now = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = cut_lineage(small.filter("a <> b").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("g"), F.col("b").alias("root"))
        before = state


def leaders(waiting: DataFrame, links: DataFrame, width: int) -> DataFrame:
    """Ids of the rows of ``waiting (id, g, slot, t, me)`` that become heads.

    Linked groups, and the two groups of one article, make a component. Its articles pass a task in
    order of receipt, slot by slot behind the links of the slot; a head covers its linked groups up
    to the horizon, and an article of a covered group is no head. A task holds the covered groups
    of one horizon and the links of one slot, not the articles.
    """
    waiting = cut_lineage(waiting)
    live = cut_lineage(links.join(waiting.select(F.col("g").alias("other"), F.col("slot").alias("at")).distinct(), ["other", "at"], "left_semi"))
    items = cut_lineage(waiting.groupBy("me").agg(F.min("slot").alias("slot"), F.array_sort(F.collect_set("g")).alias("gs")))
    edges = live.select(F.col("g").alias("a"), F.col("other").alias("b")).unionByName(
        items.filter(F.size("gs") > 1).select(F.col("gs")[0].alias("a"), F.explode("gs").alias("b")))
    roots = components(edges)

    def rooted(rows: DataFrame, g: Column) -> DataFrame:
        return rows.join(roots.withColumnRenamed("g", "_g"), g == F.col("_g"), "left").withColumn("root", F.coalesce("root", g)).drop("_g")

    none = F.lit(None)
    reach = rooted(live, F.col("other")).select("root", F.col("at").alias("slot"), F.lit(0).alias("kind"), none.cast("long").alias("t"),
                                                none.cast(waiting.schema["me"].dataType["seq"].dataType).alias("seq"), none.cast("string").alias("id"),
                                                F.array("other", "g").alias("gs"))
    told = rooted(items, F.col("gs")[0]).select("root", "slot", F.lit(1).alias("kind"), F.col("me.t").alias("t"),
                                                F.col("me.seq").alias("seq"), F.col("me.id").alias("id"), "gs")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, slot, reaches, covered = None, None, {}, {}
        for batch in batches:
            found = []
            for r, s, kind, t, name, gs in zip(*(batch.column(c).to_pylist() for c in ("root", "slot", "kind", "t", "id", "gs"))):
                if r != root:
                    root, slot, reaches, covered = r, s, {}, {}
                elif s != slot:
                    slot, reaches = s, {}
                    covered = {g: until for g, until in covered.items() if until >= s * width}
                if kind == 0:
                    reaches.setdefault(gs[0], []).append(gs[1])
                elif all(covered.get(g, t - 1) < t for g in gs):
                    found.append(name)
                    for g in gs:
                        for other in reaches.get(g, ()):
                            covered[other] = t + width
            yield pa.RecordBatch.from_pydict({"id": pa.array(found, pa.string())})

    rows = (reach.unionByName(told).repartition("root")
            .sortWithinPartitions("root", "slot", "kind", "t", "seq", "id"))
    return rows.mapInArrow(decide, "id string").distinct()


def _matched(rows: DataFrame, others: DataFrame, links: DataFrame, width: int) -> DataFrame:
    """Ids of ``rows`` that match an earlier row of ``others``."""
    stats = others.groupBy(F.col("g").alias("other"), F.col("slot").alias("at")).agg(F.min("me").alias("first"), F.max("t").alias("last"))
    around = links.join(stats, ["other", "at"]).groupBy("g", "slot").agg(
        F.min(F.when(F.col("slot") == F.col("at"), F.col("first"))).alias("first"),
        F.max(F.when(F.col("slot") > F.col("at"), F.col("last"))).alias("last"))
    return (rows.join(around, ["g", "slot"]).filter((F.col("first") < F.col("me")) | (F.col("last") >= F.col("t") - width))
            .select("id").distinct())
