"""Line dedup with a log-template tree.

A line is cut into words; words with a digit are variable from the start. The tree has a fixed
depth: word count, then the first ``depth`` words. In each leaf the words that most of its lines
have at a position form the leaf's template, all other positions are variable fields; a line
follows the template if enough of its positions beyond the branch words agree. Lines that follow
none vote again in finer branches, first with lines that share their last word, then with lines
that share the next word, so that several templates, or a template among many other lines, are
found in one leaf. What still follows none has its own (digit-masked) words as template. Of every
template that recurs across documents, the first line stays and all others are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, packed

VARIABLE = "<*>"
NEW = ("n_lines", "n_dropped")
# A word with a digit: from the start of a word, what is no digit is taken once and never given back.
NUMBERED = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
ODD_SPACE = ("  ", " \n", "\n ", "\t", "\x0b", "\x0c", "\r")
# Kinds of lines, or changed documents, up to this number are sent to where the texts are; more are
# joined by shuffle.
BROADCAST_ROWS = 200_000


def normal(text: Column) -> Column:
    """A text whose words with a digit are masked, with one space between words and none at the ends of lines.

    Line ends stay, so line i of it holds the words of line i. Only texts with digits or with odd
    space are rewritten.
    """
    odd = text.startswith(" ") | text.endswith(" ")
    for space in ODD_SPACE:
        odd = odd | F.contains(text, F.lit(space))
    single = F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " ")
    trimmed = F.btrim(F.replace(F.replace(single, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n")), F.lit(" "))
    spaced = F.when(odd, trimmed).otherwise(text)
    return F.when(text.rlike("[0-9]"), F.regexp_replace(spaced, NUMBERED, VARIABLE)).otherwise(spaced)


def text_key(text: Column) -> Column:
    """Rows with the same doc_id and text are the same document to this operator."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_table(docs: DataFrame, min_words: int, depth: int) -> DataFrame:
    """One row per line of at least ``min_words`` words: place, leaf and own template as hashes."""
    lines = docs.select("doc_id", text_key(F.col("text")).alias("text_key"),
                        F.posexplode(F.split(normal(F.col("text")), "\n", -1)).alias("pos", "line"))
    n = F.octet_length("line") - F.octet_length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1
    return (lines.withColumn("n", n).filter(F.col("n") >= min_words)
            .select("doc_id", "text_key", "pos", "n",
                    F.xxhash64("n", F.substring_index("line", " ", depth)).alias("leaf"),
                    F.xxhash64("line", "n").alias("own")))


def line_templates(docs: DataFrame, lines: DataFrame, min_docs: int, agree: float, depth: int) -> DataFrame:
    """``own, template`` for the lines that follow the template of a branch."""
    place = F.struct("doc_id", "text_key", "pos")
    # Lines without a word beyond the branch have nothing to vote on.
    kinds = lines.filter(F.col("n") > depth).groupBy("leaf", "own").agg(F.count("*").alias("lines"), F.min(place).alias("at"))
    busy = (kinds.groupBy("leaf").agg(F.count("*").alias("kinds"), F.sum("lines").alias("total"))
            .filter((F.col("kinds") > 1) & (F.col("total") >= min_docs)).select("leaf"))
    kinds = cut_lineage(kinds.join(busy, "leaf").select("leaf", "own", "lines", "at.*"))
    # Words of one line of each kind. Lines of one document come back together, so its text is
    # split once.
    wanted = kinds.groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("leaf", "own", "lines", "pos")).alias("wanted"))
    if kinds.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col("doc_id").alias("d"), text_key(F.col("text")).alias("k"), normal(F.col("text")).alias("text"))
    found = (wanted.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")))
             .select(F.split("text", "\n", -1).alias("lines_"), F.explode("wanted").alias("w"))
             .select("w.*", F.element_at("lines_", F.col("w.pos") + 1).alias("line"))
             .dropDuplicates(["own"]))
    rest = cut_lineage(found.select("leaf", "own", "lines", F.split("line", " ").alias("words")))
    last, following = F.size("words"), F.lit(depth + 1)
    settled = None
    for number, (branch, taken) in enumerate((
            (F.xxhash64("leaf"), None),
            (F.xxhash64("leaf", F.element_at("words", last)), last),
            (F.xxhash64("leaf", F.element_at("words", following)), following))):
        follows = cut_lineage(_vote(rest.withColumn("branch", branch), taken, min_docs, agree, depth, number > 0))
        follows = follows.select("own", F.xxhash64("branch", F.lit(number)).alias("template"))
        settled = follows if settled is None else settled.unionByName(follows)
        if number < 2:
            # Written once: a vote reads it several times, and the join would shuffle its words each time.
            rest = cut_lineage(rest.join(follows.select("own"), "own", "left_anti"))
    return settled


def _vote(kinds: DataFrame, taken: Column | None, min_docs: int, agree: float, depth: int, narrow: bool) -> DataFrame:
    """``branch, own`` of the kinds that follow their branch's majority at enough places beyond the leading words.

    ``taken``: place of the word that made a finer branch; it agrees, but at least one other has to. Branches whose followers are fewer than
    ``min_docs`` lines give none.
    """
    if narrow:
        # Few finer branches hold more than one kind.
        several = (kinds.groupBy("branch").agg(F.count("*").alias("kinds"), F.sum("lines").alias("total"))
                   .filter((F.col("kinds") > 1) & (F.col("total") >= min_docs)).select("branch"))
        kinds = kinds.join(several, "branch")
    shared = 0 if taken is None else 1
    taken = F.lit(0) if taken is None else taken
    spread = kinds.select("branch", "own", "lines", (F.size("words") - depth).alias("open"),
                          taken.alias("taken"), F.posexplode("words").alias("at", "word"))
    words = spread.filter((F.col("at") >= depth) & (F.col("at") + 1 != F.col("taken"))).drop("taken")
    votes = words.groupBy("branch", "at", "word").agg(F.sum("lines").alias("votes"))
    fixed = (votes.groupBy("branch", "at").agg(F.max(F.struct("votes", "word")).alias("top"), F.sum("votes").alias("all"))
             .filter(F.col("top.votes") * 2 >= F.col("all"))
             .select("branch", "at", F.col("top.word").alias("word")))
    # Written once, or the words would be shuffled for it and for its branches.
    follows = cut_lineage(words.join(fixed, ["branch", "at", "word"]).groupBy("branch", "own")
                          .agg(F.count("*").alias("same"), F.first("open").alias("open"), F.first("lines").alias("lines"))
                          .filter(F.col("same") + shared >= F.col("open") * agree).select("branch", "own", "lines"))
    strong = follows.groupBy("branch").agg(F.sum("lines").alias("n")).filter(F.col("n") >= min_docs).select("branch")
    return follows.select("branch", "own").join(strong, "branch")


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_words: int = 3, depth: int = 3,
                agree: float = 0.7) -> DataFrame:
    """All columns of ``docs`` with ``text`` cleaned, plus ``n_lines`` and ``n_dropped`` (replaced if there).

    A template recurs if at least ``min_docs`` documents hold a line of it; its first line (in
    order of doc_id, text hash, position) stays. Lines under ``min_words`` words always stay; a line
    follows another template than its own words only if at least one word beyond the branch words
    agrees, and the share ``agree`` of them. Rows
    that repeat doc_id and text count as one document and lose the same lines. NULL text stays
    NULL with 0 lines; text without recurring lines is unchanged. Runs jobs while it is called.
    """
    lines = cut_lineage(line_table(docs, min_words, depth).distinct())
    templates = line_templates(docs, lines, min_docs, agree, depth)
    placed = (lines.join(templates, "own", "left")
              .select("doc_id", "text_key", "pos", F.coalesce("template", "own").alias("template"),
                      F.col("template").isNotNull().alias("general")))
    doc = F.struct("doc_id", "text_key")
    # Once per document and template first, so that a hot template is counted from few rows.
    once = placed.groupBy("template", "general", "doc_id", "text_key").agg(F.min("pos").alias("pos"))
    recurring = (once.groupBy("template", "general")
                 .agg(F.count("*").alias("docs"),
                      F.min(F.struct("doc_id", "text_key", "pos")).alias("first"))
                 .filter(F.col("docs") >= min_docs))
    dropped = (placed.join(recurring, ["template", "general"])
               .filter(~(doc.eqNullSafe(F.struct("first.doc_id", "first.text_key"))
                         & (F.col("pos") == F.col("first.pos"))))
               .groupBy("doc_id", "text_key").agg(F.collect_list("pos").alias("out"))
               .select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), "out"))
    dropped = cut_lineage(dropped)
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    rows = docs.select(packed(docs), F.col("doc_id").alias("_id"), text_key(F.col("text")).alias("_key"))
    # The text is taken out of its row afterwards, so that a shuffle carries it once.
    joined = rows.join(dropped, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left").withColumn("text", F.col("_row.text"))
    split = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("out"))
    kept = F.array_join(F.transform(left, lambda i: F.element_at(split, i + 1)), "\n")
    text = F.when(F.col("out").isNull(), F.col("text")).otherwise(kept).alias("text")
    whole = [text if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in NEW]
    breaks = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(breaks + 1)
    n_dropped = F.when(F.col("out").isNull(), 0).otherwise(F.size("out"))
    return joined.select(*whole, n_lines.cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"))
