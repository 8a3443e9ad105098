"""Revisions, clustering and classification on small frames."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketloom.functions import text
from marketloom.operators import neardup, news

BASE = datetime(2024, 1, 1)
RAW = ("id string, headline string, summary string, author string, created_at string, updated_at string, "
       "url string, symbols array<string>, received_at timestamp, arrival_seq long")


def raw(spark, *rows):
    full = []
    for i, r in enumerate(rows):
        r = {"id": f"n{i}", "headline": "h", "summary": "s", "author": "a", "created_at": "2024-01-01T00:00:00Z",
             "updated_at": "", "url": "", "symbols": ["AAA"], "received_at": BASE, "arrival_seq": i, **r}
        full.append(tuple(r[c.split()[0]] for c in RAW.split(", ")))
    return spark.createDataFrame(full, RAW)


def test_normalize_and_quarantine(spark):
    rows = raw(spark, {"symbols": ["ZZZ", "AAA", "BBB", "AAA"]}, {"created_at": None},
               {"created_at": "2024-01-01T00:00:00"}, {"symbols": None}, {"updated_at": "soon+00:00"},
               {"id": None, "headline": None, "created_at": "2024-01-01T02:00:00+0200"})
    good = {r["event_id"]: r for r in news.normalize_articles(rows, ["AAA", "BBB"], "t").collect()}
    assert set(good) == {"n0", "None"}
    assert good["n0"]["symbols"] == ["AAA", "BBB", "AAA"]
    assert good["n0"]["updated_at"] == good["n0"]["created_at"]
    assert good["None"]["created_at"] == BASE and good["None"]["headline"] == ""
    bad = {r["id"]: r["reason"] for r in news.quarantine_articles(rows).collect()}
    assert bad == {"n1": "missing_created_at", "n2": "bad_created_at", "n3": "missing_symbols",
                   "n4": "bad_updated_at"}


def test_versions_out_of_order(spark):
    at = lambda m: f"2024-01-01T00:{m:02d}:00Z"
    rows = raw(spark, *[{"id": "x", "updated_at": at(m)} for m in (5, 3, 9, 9, 7, 12)])
    events = news.normalize_articles(rows, ["AAA"], "t")
    got = [(r["updated_at"].minute, r["version"], r["supersedes"], r["superseded_by"])
           for r in news.version_articles(events).orderBy("version").collect()]
    assert got == [(5, 1, None, "x#v2"), (9, 2, "x", "x#v3"), (12, 3, "x", None)]
    by_edit = news.version_articles(events, "updated").orderBy("version").collect()
    assert [r["updated_at"].minute for r in by_edit] == [3, 5, 7, 9, 12]
    seen = news.newest_visible(news.version_articles(events), ["2024-01-01 00:10:00", "2024-01-01 00:04:00"])
    assert [(r["version"], r["decision_time"].minute) for r in seen.collect()] == [(2, 10)]


def test_first_rule_wins_as_substring(spark):
    rules = spark.createDataFrame([(2, "lawsuit", "negative", "sued"), (1, "eps_surprise", "positive", "eps")],
                                  "ordinal int, event_type string, event_direction string, keyword string")
    rows = raw(spark, {"headline": "Firm STEPS up, is sued"}, {"headline": "Sued again"}, {"headline": "quiet"})
    got = [r["event_type"] for r in news.classify(
        news.normalize_articles(rows, ["AAA"], "t"), rules).orderBy("arrival_seq").collect()]
    assert got == ["eps_surprise", "lawsuit", "unknown"]


def test_text_functions(spark):
    df = spark.createDataFrame([("Up +3.5% and 7 % now", "HTTP://A.com/b/?q=1", "http://a.com/b/")], "t string, u string, v string")
    row = df.select(text.percentages(F.col("t")).alias("p"), text.url_key(F.col("u")).alias("u"),
                    text.url_key(F.col("v")).alias("v"), text.url_key(F.col("u"), True).alias("w"),
                    text.jaccard(text.tokens(F.lit("a b c")), text.tokens(F.lit("B c d"))).alias("j"),
                    text.jaccard(text.tokens(F.lit("")), text.tokens(F.lit("x"))).alias("z")).first()
    assert row["p"] == ["+3.5%", "7 %"] and row["u"] == "http://a.com/b/" and row["v"] == row["w"] == "http://a.com/b"
    assert row["j"] == 0.5 and row["z"] == 0.0


def articles(spark, seed, n, span_hours):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(14)]
    base = [rng.sample(words, 12) for _ in range(4)]
    rows = []
    for i in range(n):
        head = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            head[rng.randrange(12)] = rng.choice(words)
        rows.append((f"e{i}", 1, "" if i % 29 == 7 else " ".join(head),
                     rng.choice(["", "", "", f"http://x/{rng.randrange(6)}?r={i}"]),
                     BASE + timedelta(minutes=rng.randrange(span_hours * 60)), i))
    return rows, spark.createDataFrame(rows, "event_id string, version int, headline string, url string, "
                                             "received_at timestamp, arrival_seq long")


def sequential(rows):
    heads, out = [], {}
    for r in sorted(rows, key=lambda r: (r[4], r[5])):
        words, key = set(r[2].split()), r[3].split("?")[0]
        for h, hw, hk in heads:
            union = len(words | hw)
            alike = words and hw and len(words & hw) / union >= 0.85
            if r[4] - h[4] <= timedelta(hours=24) and ((key and key == hk) or alike):
                out[r[0]] = h[0]
                break
        else:
            heads.append((r, words, key))
            out[r[0]] = r[0]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_equal_the_sequential_scan(spark, seed):
    rows, df = articles(spark, seed, 150, 120)
    got = {r["event_id"]: r["cluster_id"] for r in neardup.cluster_articles(df).collect()}
    assert got == sequential(rows)


def test_cluster_batches_equal_one_batch(spark):
    rows, df = articles(spark, 5, 120, 72)
    cut = BASE + timedelta(hours=30)
    first = neardup.cluster_articles(df.filter(F.col("received_at") < F.lit(cut)))
    heads = first.filter("is_head").select(*df.columns)
    second = neardup.cluster_articles(df.filter(F.col("received_at") >= F.lit(cut)), open_heads=heads)
    got = {r["event_id"]: r["cluster_id"] for r in first.unionByName(second).collect()}
    assert got == sequential(rows)


def test_day_boundary_is_inclusive(spark):
    rows = [(f"e{i}", 1, "same words here", "", BASE + d, i) for i, d in enumerate(
        [timedelta(0), timedelta(hours=24), timedelta(hours=24, seconds=1)])]
    df = spark.createDataFrame(rows, "event_id string, version int, headline string, url string, "
                                     "received_at timestamp, arrival_seq long")
    got = {r["event_id"]: r["cluster_id"] for r in neardup.cluster_articles(df).collect()}
    assert got == {"e0": "e0", "e1": "e0", "e2": "e2"}


def test_hot_copies_do_not_pair_up(spark):
    """A third of all rows are copies: edges stay per group of copies."""
    rows = [(f"e{i}", 1, "one two three four" if i % 3 == 0 else f"solo{i} word{i}", "",
             BASE + timedelta(seconds=i), i) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id string, version int, headline string, url string, "
                                     "received_at timestamp, arrival_seq long")
    assert neardup.near_dup_edges(df).count() == 0
    assert neardup.cluster_articles(df).groupBy("cluster_id").count().filter("count = 200").count() == 1


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.7, 0.85, 1.0])
def test_prefix_keys_lose_no_pair(spark, threshold):
    rng = random.Random(9)
    sets = {" ".join(sorted(rng.sample("abcdefghijkl", rng.randint(1, 8)))) for _ in range(120)}
    rows = [(f"e{i}", 1, s, "", BASE + timedelta(seconds=i), i) for i, s in enumerate(sorted(sets))]
    df = spark.createDataFrame(rows, "event_id string, version int, headline string, url string, "
                                     "received_at timestamp, arrival_seq long")
    got = {frozenset((r["left_id"], r["right_id"])) for r in neardup.near_dup_edges(df, threshold).collect()}
    words = {f"{r[0]}#{r[1]}": set(r[2].split()) for r in rows}
    want = {frozenset((a, b)) for a in words for b in words if a < b
            and len(words[a] & words[b]) / len(words[a] | words[b]) >= threshold}
    assert got == want


def test_rounds_follow_chains_not_block_sizes(spark, monkeypatch):
    """One hot block: a rare token that all share, copies of one headline, and a chain of three."""
    rows = [(f"e{i}", 1, " ".join(["zz", *(f"w{i % 400}x{k}" for k in range(3))]), "", BASE + timedelta(seconds=i), i) for i in range(1200)]
    rows += [(f"c{i}", 1, "one and the same line of words", f"http://u/{i}", BASE + timedelta(seconds=i), 5000 + i) for i in range(800)]
    base = [f"t{k}" for k in range(14)]
    chain = [base, [*base[1:], "n1"], [*base[2:], "n1", "n2"]]
    rows += [(f"k{i}", 1, " ".join(words), "", BASE + timedelta(minutes=i), 9000 + i) for i, words in enumerate(chain)]
    df = spark.createDataFrame(rows, "event_id string, version int, headline string, url string, received_at timestamp, arrival_seq long")
    calls = []
    real = neardup._matched
    monkeypatch.setattr(neardup, "_matched", lambda *a: calls.append(1) or real(*a))
    got = {r["event_id"]: r["cluster_id"] for r in neardup.cluster_articles(df).collect()}
    assert got == sequential(rows)
    assert got["k1"] == "k0" and got["k2"] == "k2" and len(set(got.values())) == 400 + 1 + 2
    assert len(calls) <= 4  # two rounds


def test_long_chains_take_no_rounds(spark, monkeypatch):
    """Hourly copies and variants over two months: every head waits for the one of the day before."""
    base = [f"t{k}" for k in range(14)]
    rows = [(f"e{i}", 1, " ".join(base if i % 3 else [*base[1:], f"v{i % 2}"]), "http://u/x" if i % 50 == 0 else "",
             BASE + timedelta(minutes=61 * i), i) for i in range(1400)]
    df = spark.createDataFrame(rows, "event_id string, version int, headline string, url string, received_at timestamp, arrival_seq long")
    calls = []
    real = neardup._matched
    monkeypatch.setattr(neardup, "_matched", lambda *a: calls.append(1) or real(*a))
    got = {r["event_id"]: r["cluster_id"] for r in neardup.cluster_articles(df).collect()}
    assert got == sequential(rows)
    assert len(set(got.values())) > 50 and len(calls) <= 4
