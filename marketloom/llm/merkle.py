"""Merkle manifest of a dataset by time-forward processing.

Every node has a label (tree, place); a level is worked off in label order. Children send their
digest to the label of their parent: Spark's sort-based shuffle on that label is the external
priority queue, and a parent takes its at most ``fan`` messages in order of their place. When the
root is known the sweep is reversed: parents send each child the siblings on its way to the root,
and the last message delivers a leaf's whole proof suffix. A source of any size is spread over
all tasks in both sweeps, since nothing is ever gathered by source; a message queue shrinks by
``fan`` from level to level.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import CHUNK_ROWS, equi_depth
from .common import cut_lineage

FAN = 16
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"
# Rows of a file of inner nodes: with their paths these are rows of some kilobytes.
LEVEL_ROWS = 8192
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for NULL, else byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column | None = None, fields: Sequence[str] = FIELDS) -> Column:
    """Digest of a row; ``text`` in place of the column of that name."""
    return digest(*[field(text if text is not None and c == "text" else F.col(c)) for c in fields])


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


@dataclass(frozen=True)
class Manifest:
    """``leaves``: the given columns with tree, place, subroot and ``path`` (siblings up to the root)."""

    leaves: DataFrame
    root: str | None


def numbered(leaves: DataFrame, total: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Adds ``tree`` (place of the source among all), ``idx`` (place of the leaf in it) and ``n``.

    Chunks of equal depth are counted per source; places are taken from those counts, so neither a
    hot source nor a table of very many sources is sorted in one task.
    """
    parts = equi_depth(leaves, ["source", "doc_id", "leaf", "salt"], chunk_rows, "part", total)
    counts = written(parts.groupBy("source", "part").agg(F.count("*").alias("rows")), -(-total // chunk_rows))
    by_source = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("rows").over(by_source), F.lit(0)))
    trees = counts.groupBy("source").agg(F.min("part").alias("head"), F.sum("rows").alias("n"))
    # One row per chunk is ordered in one task, all else inside a chunk.
    heads = trees.groupBy("head").agg(F.count("*").alias("sources")).withColumn("earlier", F.coalesce(F.sum(
        "sources").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    in_head = F.row_number().over(Window.partitionBy("head").orderBy("source"))
    trees = trees.withColumn("_in", in_head).join(heads, "head").select(
        F.col("source").alias("_source"), (F.col("earlier") + F.col("_in") - 1).alias("tree"), "n")
    places = before.join(trees, F.col("source").eqNullSafe(F.col("_source"))).select(
        F.col("source").alias("_source"), F.col("part").alias("_part"), "before", "tree", "n")
    inside = Window.partitionBy("part", "source").orderBy("doc_id", "leaf", "salt")
    ranked = parts.withColumn("_at", F.row_number().over(inside))
    return (ranked.join(places, (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source")))
            .withColumn("idx", F.col("before") + F.col("_at") - 1)
            .drop("part", "salt", "before", "_at", "_part", "_source"))


def written(nodes: DataFrame, rows: int) -> DataFrame:
    """Inner levels are small: few files, whatever the number of shuffle partitions."""
    return cut_lineage(nodes.coalesce(max(1, -(-rows // LEVEL_ROWS))))


def forward(nodes: DataFrame, fan: int) -> list[DataFrame]:
    """Levels of ``tree, idx, n, digest`` up to single nodes; from level 1 on with ``kids``, their digests."""
    levels = [nodes]
    size, rows, trees = nodes.agg(F.max("n"), F.count("*"), F.round(F.sum(1 / F.greatest("n", F.lit(1))))).first()
    size, trees = size or 0, int(trees or 0)
    while size > 1:
        size, rows = -(-size // fan), rows // fan + trees
        sent = levels[-1].filter("n > 1").select(
            "tree", "n", F.floor(F.col("idx") / fan).alias("idx"), F.struct("idx", "digest").alias("message"))
        kids = F.array_join(F.transform(F.array_sort(F.collect_list("message")), lambda m: m["digest"]), "")
        got = sent.groupBy("tree", "idx").agg(F.first("n").alias("n"), kids.alias("kids"))
        levels.append(written(got.select(
            "tree", "idx", F.ceil(F.col("n") / fan).alias("n"), digest(F.col("kids")).alias("digest"), "kids"), rows))
    return levels


def reverse(levels: list[DataFrame], tops: DataFrame, fan: int) -> DataFrame:
    """Level 0 with ``path`` and the columns of ``tops`` (by tree; its ``path`` is that of the tree's top)."""
    carried = [c for c in tops.columns if c not in ("tree", "path")]
    above = None
    for level, nodes in reversed(list(enumerate(levels))):
        down = nodes.filter("n = 1").join(tops, "tree")
        if above is not None:
            at = (F.col("idx") % fan * HEX).cast("int")
            step = F.struct(F.substring("kids", F.lit(1), at).alias("before"),
                            F.substring("kids", at + HEX + 1, F.lit(fan * HEX)).alias("after"))
            parents = above.select(F.col("tree").alias("_tree"), F.col("idx").alias("_idx"), "kids",
                                   F.col("path").alias("_path"), *carried)
            inner = nodes.drop("kids").filter("n > 1").join(
                parents, (F.col("tree") == F.col("_tree")) & (F.floor(F.col("idx") / fan) == F.col("_idx")))
            inner = inner.withColumn("path", F.concat(F.array(step), "_path")).drop("_tree", "_idx", "_path", "kids")
            if level:
                # Each node's own children are wanted one level further down.
                own = nodes.select(F.col("tree").alias("_tree"), F.col("idx").alias("_idx"), "kids")
                inner = inner.join(own, (F.col("tree") == F.col("_tree")) & (F.col("idx") == F.col("_idx"))).drop("_tree", "_idx")
            down = down.unionByName(inner)
        above = down if level == 0 else written(down, nodes.count())
    return above


def build(rows: DataFrame, fan: int = FAN, chunk_rows: int = CHUNK_ROWS) -> Manifest:
    """Manifest of ``rows`` (source, doc_id, leaf, and whatever else is to be carried along).

    Leaves are ordered by doc_id (NULL first) inside their source, rows of one doc_id by their
    digest; rows that agree in both are leaves of their own, side by side. Sources are ordered
    bytewise, NULL first. A lone leaf is its subroot, a lone subroot the root. An empty table has no
    leaves and no root. Runs one small job per level.
    """
    if fan < 2:
        raise ValueError("fan must be at least 2")
    # A row number of the written table keeps rows apart that agree in everything else.
    kept = cut_lineage(rows)
    total = kept.count()
    salted = kept.withColumn("salt", F.monotonically_increasing_id())
    leaves = cut_lineage(numbered(salted, total, chunk_rows).withColumn("digest", F.col("leaf")))
    levels = forward(leaves.select("tree", "idx", "n", "digest"), fan)
    levels[0] = leaves
    single = [level.filter("n = 1").select("tree", F.col("digest").alias("subroot")) for level in levels]
    subroots = single[0]
    for part in single[1:]:
        subroots = subroots.unionByName(part)
    n_trees = subroots.count()
    subroots = written(subroots, n_trees)
    top = forward(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"),
                                  F.lit(n_trees).cast("long").alias("n"), F.col("subroot").alias("digest")), fan)
    crown = top[-1].filter("n = 1").select("digest").first()
    none = top[-1].filter("n = 1").select("tree", F.array().cast(PATH).alias("path"))
    tops = reverse(top, none, fan).select(F.col("idx").alias("tree"), F.col("digest").alias("subroot"), "path")
    return Manifest(reverse(levels, written(tops, n_trees), fan).drop("digest"), crown["digest"] if crown else None)


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level to the root, left to right."""
    return digest(F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), ""))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf digest leads to with the given siblings."""
    return F.aggregate(path, leaf, lambda d, p: F.sha2(F.concat(p["before"], d, p["after"]).cast("binary"), 256))


def audit(docs: DataFrame, changed: Column, text: Column, fan: int = FAN, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` per row of ``docs``.

    Where ``changed`` holds (NULL: not), the leaf is computed again with ``text`` in place of the text
    and folded with the siblings of the original; ``verified`` says whether that gives the root.
    Other columns of ``docs`` are left alone, whatever they are called.
    """
    rows = docs.select("doc_id", "source", leaf_digest().alias("leaf"),
                       F.when(changed, leaf_digest(text)).alias("altered"))
    manifest = build(rows, fan, chunk_rows)
    folded = fold(F.coalesce("altered", "leaf"), F.col("path"))
    root = F.lit(manifest.root).cast("string")
    return manifest.leaves.select(
        "doc_id", "leaf", "subroot", root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"),
        folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def fifth(doc_id: Column) -> Column:
    """One document in five, by the checksum of its decimal id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
