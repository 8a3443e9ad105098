"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, target / source size. Its whole
part is taken at once; the fractional parts are rounded by the pivotal method: two documents meet,
a random one gives words to the other until one of the two is taken fully or not at all, and the
other one goes on. The direction is drawn such that every expectation stays what it was, and the
expected words of a source never change.

The meetings form a reduction tree: blocks of about ``BLOCK`` documents of one source are folded
where they lie and each leaves one fractional document, and those are folded again, until at most
``BLOCK`` per source are left. No block grows with the source: a source is dealt over as many blocks
as its count asks for. In the last fold every document, from the largest down, meets all smaller
ones together, which leaves the smallest one open: it bounds the words by which a source misses its
target (or the largest, where the others together are too small to make up for it).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, uniform, word_count

BLOCK = 128
# Sources up to this number are broadcast with their targets.
BROADCAST_SOURCES = 100_000
NONE_DONE = "cast(array() as array<struct<doc_id:bigint,text_hash:bigint,size:bigint,extra:int>>)"


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """One row per source: ``source_key, source_size, target``.

    ``sizes`` has ``source, size``. Sources in code-point order (NULL last) get ``weights`` in turn
    and share the total of all sizes. No target exceeds ``cap`` times its source; what is cut off
    is shared anew by weight, which settles at target = least(cap * size, weight * level) for the
    one level at which the targets add up to the total. Windows here run over one row per source.
    """
    whole = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
               .withColumn("weight", weight)
               .withColumn("most", F.col("source_size") * cap))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole)
    filled = F.sum("most").over(upto) - F.col("most")
    return (sources
            .withColumn("level", (total - filled) / F.sum("weight").over(rest))
            .withColumn("level", F.max("level").over(whole))
            .select(source_key("source"), "source_size",
                    F.least(F.col("most"), F.col("weight") * F.col("level")).alias("target")))


def source_key(name: str) -> Column:
    """A key that is never NULL."""
    return F.when(F.col(name).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(name))).alias("source_key")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, seed: int = 7) -> DataFrame:
    """Copies of every document of ``docs (doc_id, text, source)``.

    Returns one row per input row, repeated rows included: ``doc_id, text_hash, source_key, size, source_size,
    target, copies, taken`` where size counts words (NULL or empty text: 0) and taken = copies *
    size. Copies never exceed ``cap``, if that is a whole number. A source without words has target
    0 and no copies; an empty table gives an empty result. The same rows give the same result in
    every run and on every layout, also without ids; of rows that agree in all three columns some
    may get a copy more, whichever. Runs jobs while it is called (one per level of the tree).
    """
    sizes = cut_lineage(docs.select("doc_id", F.xxhash64("text").alias("text_hash"),
                                    F.col("source").cast("string").alias("source"),
                                    word_count(F.col("text")).alias("size")))
    targets = cut_lineage(source_targets(sizes, weights, cap))
    # One row per source: a hot source's rows stay where they are if there are not too many sources.
    near = F.broadcast if targets.count() <= BROADCAST_SOURCES else lambda table: table
    targets = near(targets)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # A rate that is a whole number but for rounding noise has no fraction to round.
    whole = F.floor(rate + 1e-9)
    rows = (sizes.select("doc_id", "text_hash", "size", source_key("source")).join(targets, "source_key")
            .withColumn("p", F.greatest(rate - whole, F.lit(0.0))))
    settled = (F.col("p") < 1e-9) | (F.col("size") == 0)
    extra = rows.filter(settled).select("doc_id", "text_hash", "source_key", "size", F.lit(0).alias("extra"))
    # Equal rows are numbered from their count; the key of a row depends on its content and that number only.
    equal = rows.filter(~settled).groupBy("doc_id", "text_hash", "source_key", "size", "p").agg(F.count("*").alias("n"))
    nth = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
    loose = (equal.select("doc_id", "text_hash", "source_key", "size", "p", nth.alias("nth"))
             .withColumn("key", F.xxhash64("doc_id", "text_hash", "nth")).drop("nth"))
    level = 0
    while True:
        counts = loose.groupBy("source_key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        loose = cut_lineage(loose.join(near(counts), "source_key"))
        if not loose.filter("blocks > 1").limit(1).count():
            break
        done, open_ = fold(loose.filter("blocks > 1"), level, seed)
        extra = extra.unionByName(done)
        loose = loose.filter("blocks = 1").drop("blocks").unionByName(open_)
        level += 1
    extra = extra.unionByName(settle(loose, seed))
    return (extra.join(targets, "source_key")
            .withColumn("copies", (whole + F.col("extra")).cast("long"))
            .withColumn("taken", F.col("copies") * F.col("size")))


def fold(loose: DataFrame, level: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """One level of the tree: rows settled at 0 or 1, and at most one loose row per block. ``loose`` has ``blocks``."""
    block = F.pmod(F.xxhash64("key", F.lit(seed), F.lit(level)), F.col("blocks"))
    folded = (loose
              .withColumn("block", block).groupBy("source_key", "block")
              .agg(sorted_rows(seed).alias("rows"))
              .select("source_key", pivotal(F.col("rows"), level, seed).alias("s")))
    folded = cut_lineage(folded.select("source_key", "s.done", "s.open"))
    done = folded.select("source_key", F.explode("done").alias("d")).select(
        "d.doc_id", "d.text_hash", "source_key", "d.size", "d.extra")
    return done, folded.select("open.doc_id", "open.text_hash", "source_key", "open.size", "open.p", "open.key")


def sorted_rows(seed: int) -> Column:
    """The loose documents of a group, largest first."""
    return F.sort_array(F.collect_list(F.struct(
        (-F.col("size")).alias("order"), F.xxhash64("key", F.lit(seed)).alias("h"), "key", "doc_id", "size", "p",
        "text_hash")))


def settle(loose: DataFrame, seed: int) -> DataFrame:
    """The last fold: at most ``BLOCK`` loose documents of each source, all of which are settled.

    The probability of every document that is still to come is ``scale * p + shift`` with the same
    two numbers, since a document takes from all of them, or gives to them, in proportion.
    """
    rows = F.col("rows")
    start = F.struct(F.expr(NONE_DONE).alias("done"),
                     F.lit(1.0).alias("scale"), F.lit(0.0).alias("shift"),
                     F.aggregate(rows, F.lit(0.0), lambda t, r: t + r["p"] * r["size"]).alias("mass"),
                     F.aggregate(rows, F.lit(0.0), lambda t, r: t + r["size"]).alias("room"))

    def meet(state: Column, row: Column) -> Column:
        size = row["size"].cast("double")
        mass, room = state["mass"] - row["p"] * size, state["room"] - size
        p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), state["scale"] * row["p"] + state["shift"]))
        pool = F.greatest(F.lit(0.0), F.least(room, state["scale"] * mass + state["shift"] * room))
        gain, loss = F.least((1.0 - p) * size, pool), F.least(p * size, room - pool)
        up = uniform(row["key"], F.lit(seed), F.lit("way")) * (gain + loss) < loss
        new_p = p + F.when(up, gain).otherwise(-loss) / size
        sure = F.least(new_p, 1.0 - new_p) < 1e-9
        taken = F.when(sure, new_p > 0.5).otherwise(uniform(row["key"], F.lit(seed), F.lit("end")) < new_p)
        out = F.struct(row["doc_id"].alias("doc_id"), row["text_hash"].alias("text_hash"), row["size"].alias("size"),
                       F.when(taken, 1).otherwise(0).alias("extra"))
        keep = F.when(up, F.when(pool > 0, 1.0 - gain / pool).otherwise(1.0)).otherwise(
            F.when(room > pool, 1.0 - loss / (room - pool)).otherwise(1.0))
        return F.struct(F.concat(state["done"], F.array(out)).alias("done"),
                        (state["scale"] * keep).alias("scale"),
                        (state["shift"] * keep + F.when(up, 0.0).otherwise(1.0 - keep)).alias("shift"),
                        mass.alias("mass"), room.alias("room"))

    grouped = loose.groupBy("source_key").agg(sorted_rows(seed).alias("rows"))
    return (grouped.select("source_key", F.explode(F.aggregate(rows, start, meet)["done"]).alias("d"))
            .select("d.doc_id", "d.text_hash", "source_key", "d.size", "d.extra"))


def pivotal(rows: Column, level: int, seed: int) -> Column:
    """Fold an array of loose documents: those settled at 0 or 1, and the one left open."""
    first = rows[0]
    start = F.struct(F.expr(NONE_DONE).alias("done"),
                     unit(first, first["p"]).alias("open"))

    def meet(state: Column, new: Column) -> Column:
        old = state["open"]
        # Words that can flow to the old one, and from it, before one of the two is settled.
        gain = F.least((1.0 - old["p"]) * old["size"], new["p"] * new["size"])
        loss = F.least(old["p"] * old["size"], (1.0 - new["p"]) * new["size"])
        draw = uniform(old["key"], new["key"], F.lit(seed), F.lit(level)) * (gain + loss)
        # A gain of ``gain`` is drawn with weight ``loss`` and the other way round.
        flow = F.when(draw < loss, gain).otherwise(-loss)
        old_p, new_p = old["p"] + flow / old["size"], new["p"] - flow / new["size"]
        old_done = F.least(old_p, 1.0 - old_p) <= F.least(new_p, 1.0 - new_p)
        gone, gone_p = choose(old_done, old, new), F.when(old_done, old_p).otherwise(new_p)
        stay, stay_p = choose(old_done, new, old), F.when(old_done, new_p).otherwise(old_p)
        out = F.struct(gone["doc_id"].alias("doc_id"), gone["text_hash"].alias("text_hash"), gone["size"].alias("size"),
                       F.when(gone_p > 0.5, 1).otherwise(0).alias("extra"))
        return F.struct(F.concat(state["done"], F.array(out)).alias("done"), unit(stay, stay_p).alias("open"))

    return F.aggregate(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), start, meet)


def unit(row, p: Column) -> Column:
    return F.struct(row["doc_id"].alias("doc_id"), row["text_hash"].alias("text_hash"),
                    row["size"].alias("size"), p.alias("p"), row["key"].alias("key"))


def choose(condition: Column, yes: Column, no: Column) -> dict[str, Column]:
    return {name: F.when(condition, yes[name]).otherwise(no[name]) for name in ("doc_id", "text_hash", "size", "key")}
