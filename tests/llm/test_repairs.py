"""Cases that went wrong once."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import langid, line_dedup, mixing, ngram_join, pieces, syncmers
from marketloom.llm.common import tokenizer_file


def kept(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in line_dedup.dedup_lines(rows).orderBy("doc_id").collect()]


def test_short_lines_with_a_common_opening_stay(spark):
    texts = ["The cat sat down", "The cat sat up", "The cat sat quietly", "one two three"]
    assert kept(spark, texts) == texts


def test_templates_are_found_next_to_other_lines(spark):
    same = [f"session opened for user{c} from host alpha" for c in "ABCD"]
    alone = kept(spark, same)
    assert alone == [same[0], "", "", ""]
    others = [f"session opened for {a} {b} {c} {d}" for a, b, c, d in zip("efghijklmnop", "qrstuvwxyzab", "cdefghijklmn", "opqrstuvwxyz")]
    mixed = kept(spark, same + others)
    assert mixed == alone + others
    # Two templates of one length and opening, one with a variable end.
    login = [f"session opened for admin at console {w}" for w in ("red", "green", "blue")]
    got = kept(spark, same + login + others)
    assert got[:4] == alone and got[4:7] == [login[0], "", ""] and got[7:] == others


def test_masking_is_linear_and_exact(spark):
    lines = ["  a1 b  c2d\te ", "x" * 200_000, "no digits here", "7 8 9", "ab\x0b12 é9é ü"]
    want = ["<*> b <*> e", "x" * 200_000, "no digits here", "<*> <*> <*>", "ab <*> <*> ü"]
    df = spark.createDataFrame([(t,) for t in [*lines, "\n".join(lines), " \n\n  x1 \r\n y \n "]], "t string")
    got = [r[0] for r in df.select(line_dedup.normal(F.col("t"))).collect()]
    assert got == [*want, "\n".join(want), "\n\n<*>\ny\n"]


def test_mix_is_the_same_on_every_layout(spark):
    rows = [(None if i % 2 else i, " ".join(["w"] * (i % 17 + 1)) + (f" {i}" if i % 3 else ""), "abc"[i % 3]) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen = []
    for n in (1, 3, 7):
        got = mixing.mix(df.repartition(n)).collect()
        assert len(got) == 900
        seen.append(Counter((r["doc_id"], r["text_hash"], r["source_key"], r["copies"]) for r in got))
    assert seen[0] == seen[1] == seen[2]


def test_one_repeated_id_is_spread_over_blocks(spark):
    df = spark.createDataFrame([(7, f"{'w ' * (i % 5 + 1)}{i}", "a" if i % 10 else "b") for i in range(3000)], "doc_id long, text string, source string")
    got = mixing.mix(df)
    share = got.groupBy("source_key").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r["t"] - r["g"]) <= 20 for r in share)


def test_odd_piece_lists(spark):
    path = tokenizer_file("piece_bpe_32k.model")
    ids = pieces.encode(spark.createDataFrame([("Hello there",)], "text string"), path).first()["ids"]
    rows = [(ids,), ([ids[0], None, *ids[1:]],), ([None],), ([],), (None,), ([*ids, 999_999],), ([*ids, -5],)]
    got = [r["decoded"] for r in pieces.decode(spark.createDataFrame(rows, "ids array<int>"), path).collect()]
    assert got == ["Hello there", "Hello there", "", "", "", "Hello there�", "Hello there�"]


def plain_likeness(a, b):
    """Over all anchors of both texts."""
    places = []
    for text in (a, b):
        ids, at = syncmers.anchors(text)
        first = {}
        for i, p in zip(ids.tolist(), at.tolist()):
            first.setdefault(i, p)
        places.append(first)
    both = places[0].keys() & places[1].keys()
    shift = [places[0][i] - places[1][i] for i in both]
    near = sum(abs(s - np.median(shift)) <= syncmers.TOLERANCE for s in shift) if shift else 0
    return near / len(places[0].keys() | places[1].keys())


@pytest.mark.parametrize("length", [300, 5_000, 120_000])
def test_fingerprints_resolve_edits_at_every_length(length):
    rng = random.Random(length)
    text = "".join(rng.choice("abcdefghijklmnop     ") for _ in range(length))
    own = syncmers.fingerprint(text)
    assert len(own[0]) >= min(64, len(syncmers.anchors(text)[0])) and syncmers.likeness(own, own) == 1.0
    seen = 0
    for k in range(60):
        at = rng.randrange(length - 4)
        seen += syncmers.printed(syncmers.fingerprint(text[:at] + "####" + text[at + 4:])) != syncmers.printed(own)
    assert seen >= 48
    for share in (0.05, 0.3, 0.7):
        cut = int(length * (1 - share))
        other = text[:cut] + "".join(rng.choice("qrstuvwxyz ") for _ in range(length - cut))
        got, want = syncmers.likeness(own, syncmers.fingerprint(other)), plain_likeness(text, other)
        assert abs(got - want) < (0.01 if length < 1000 else 0.06)
    moved = text[length // 2:] + text[:length // 2]
    assert abs(syncmers.likeness(own, syncmers.fingerprint(moved)) - plain_likeness(text, moved)) < 0.1


def test_short_and_empty_fingerprints():
    empty, one, two = (syncmers.fingerprint(t) for t in ("", "short text", "other text"))
    assert syncmers.likeness(empty, empty) == 1.0 and syncmers.likeness(empty, one) == 0.0
    assert syncmers.likeness(one, one) == 1.0 and syncmers.likeness(one, two) == 0.0
    assert syncmers.printed(empty) == "f" * 16


def test_registered_likeness_is_that_of_the_texts(spark):
    texts = {1: "a b c " * 50, 2: "quite another text " * 30, 5: "", 9: "a b c " * 49 + "end"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    ids = sorted(texts)
    for r in syncmers.compare_with_edits(df).collect():
        text, after = texts[r["doc_id"]], texts[ids[(ids.index(r["doc_id"]) + 1) % 4]]
        edited = text[:len(text) - len(text) // 2] + after[:len(text) // 2]
        if text and edited:
            assert r["near_edited"] == pytest.approx(plain_likeness(text, edited))
        if text and after:
            assert r["near_next"] == pytest.approx(plain_likeness(text, after))


def test_fingerprints_keep_every_anchor():
    """Nothing is left out at any length, and the likeness is the count over all anchors."""
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ijklmno") for _ in range(20_000))
    ids, at = syncmers.anchors(text)
    own = syncmers.fingerprint(text)
    assert set(own[0].tolist()) == set(ids.tolist()) and len(own[0]) > 2500
    assert len(syncmers.printed(own)) == 16 + 24 * len(own[0])
    for other in (text[:15_000] + text[:5_000], text[:10_000], text[:9_000] + "####" + text[9_004:]):
        assert abs(syncmers.likeness(own, syncmers.fingerprint(other)) - plain_likeness(text, other)) < 1e-9


def test_large_sets_are_told_apart_before_they_are_compared(spark):
    """Pairs of large sets leave the candidate join only if they are near; copies are one row of it."""
    words = [f"w{i}" for i in range(9000)]
    # Sizes on both sides of 4096, where a wide sketch doubles; the last two share half of their shingles.
    texts = [words[:4000], words[:4400], words[:8300], words[:8000], words[5000:9000], words[3000:7000]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(90 + i, " ".join(texts[0])) for i in range(9)],
                               "doc_id long, text string")
    classes = spark.sparkContext.broadcast(np.zeros(1 << ngram_join.SKETCH_BITS, dtype=np.uint64))
    rows = ngram_join.signatures(df, 4, 85, 100, classes)
    parts = [F.col("parity")[i].alias(f"s{i}") for i in range(ngram_join.PARITY_WORDS)]
    known = rows.select("doc_id", "g", "n", "wide", *parts).filter("doc_id < 90")
    near = (known.alias("x").join(known.alias("y"), (F.col("x.doc_id") < F.col("y.doc_id")) & ngram_join.may_link("x", "y", 85, 100))
            .select("x.doc_id", "y.doc_id").collect())
    assert sorted(map(tuple, near)) == [(0, 1), (2, 3)]
    assert ngram_join.further_prefixes(rows, rows.select("g").distinct()).count() == len(texts)
    assert ngram_join.wide_bits(4097) == 4096 and ngram_join.wide_bits(4096) == 2048
    a, b = np.arange(5000, dtype=np.uint64), np.arange(3, 4999, dtype=np.uint64)
    pair = spark.createDataFrame([(ngram_join.sketch(a, 4096).tolist(), ngram_join.sketch(b, 2048).tolist())], "a array<long>, b array<long>")
    assert pair.select(ngram_join.wide_apart(F.col("a"), F.col("b"))).first()[0] == 4
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similarity_components(df).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5} | {90 + i: 0 for i in range(9)}


def test_votes_are_written_before_they_are_read_twice(spark):
    kinds = spark.createDataFrame([(1, i, 2, ["a", "b", "c", "d", f"e{i}", "f"]) for i in range(5)],
                                  "branch long, own long, lines long, words array<string>")
    votes = line_dedup._vote(kinds, None, 3, 0.5, 3, False)
    assert sorted(map(tuple, votes.collect())) == [(1, i) for i in range(5)]
    # The words are not spread again for what is read of them.
    assert "Generate" not in votes._jdf.queryExecution().optimizedPlan().toString()


def test_a_long_text_column_is_looked_at_in_small_parts():
    import tracemalloc

    slots = np.zeros((langid.SLOTS, 1), dtype=np.uint64)
    filters = langid.Filters(("a", "b"), slots, np.zeros(2))
    texts = ["some words of a text " * 100] * 1500 + [None, ""]
    tracemalloc.start()
    seen = [x for part in langid.chunks(texts) for x in langid.decide(filters, part)[0]]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(seen) == len(texts) and seen[-2:] == [langid.UNKNOWN] * 2
    assert peak < 64 << 20


def test_grams_are_counted_over_parts_as_over_all(spark):
    texts = [("x", "ab cde " * 30_000), ("y", "ab cde"), ("x", "fgh ij " * 30_000), ("y", None), ("x", "")]
    df = spark.createDataFrame(texts, "lang string, text string").coalesce(1)
    want = Counter()
    for lang, text in texts:
        want.update((lang, int(c)) for c in langid.grams([text or ""])[0])
    assert {(r["lang"], r["gram"]): r["n"] for r in langid.gram_counts(df).collect()} == dict(want)


def test_short_stretches_are_cut_as_in_a_stream():
    import random as rnd

    m = pieces.PieceModel(tokenizer_file("piece_bpe_32k.model"))
    rng = rnd.Random(5)
    letters = [pieces.SPACE, *"etaoinshrdlu019.,-", "é", "ß", "語", "\U0001F600", "\x00", "\n", " "]
    words = ["".join(rng.choices(letters, k=rng.randrange(0, 60))) for _ in range(2000)]
    for w in [*words, pieces.SPACE + "international", "z" * (pieces.COMMIT - 1)]:
        assert m.short(w) == [i for part in m.stream(w) for i in part]
