"""Hard negatives, decontamination and the manifest against plain code; edges of each."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import hard_negatives, merkle, phrase_index
from marketloom.llm.common import benchmark, documents, scratch_path

# --------------------------------------------------------------- manifest

DOC = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree long"


def hexed(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(r, text):
    put = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return hexed("".join(map(put, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text))))


def plain_tree(digests, fan):
    paths, members = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        up, groups = [], []
        for a in range(0, len(digests), fan):
            run = digests[a:a + fan]
            for j, own in enumerate(members[a:a + fan]):
                for i in own:
                    paths[i].append((run[:j], run[j + 1:]))
            up.append(hexed("".join(run)))
            groups.append(sum(members[a:a + fan], []))
        digests, members = up, groups
    return digests[0], paths


def plain_manifest(rows, fan):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    own = []
    for k in order:
        groups[k].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, r["text"])))
        own.append(plain_tree([plain_leaf(r, r["text"]) for r in groups[k]], fan))
    root, tops = plain_tree([d for d, _ in own], fan)
    out = []
    for k, (subroot, paths), top in zip(order, own, tops):
        for r, path in zip(groups[k], paths):
            leaf = plain_leaf(r, r["text"])
            folded = leaf
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None:
                folded = plain_leaf(r, re.sub("[A-Z]", lambda m: m[0].lower(), r["text"]))
            for before, after in path + top:
                folded = hexed("".join(before) + folded + "".join(after))
            proof = hexed("".join("".join(b + a) for b, a in path + top))
            out.append((r["doc_id"], leaf, subroot, root, proof, folded, folded == root))
    return out


def manifest_rows(docs, **kw):
    got = merkle.audit(docs, merkle.fifth(F.col("doc_id")), merkle.lowered(F.col("text")), **kw)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return [tuple(r) for r in got.collect()]


@pytest.mark.parametrize("fan,chunk_rows", [(16, 65536), (2, 7), (3, 40)])
def test_manifest_is_that_of_plain_code(spark, fan, chunk_rows):
    rng = random.Random(fan)
    rows = [(rng.choice([i, i, None]) if i % 41 == 0 else i, rng.choice(["Ab c", "ü É", "", None, "x" * 4000]),
             rng.choice(["en", None]), "hot" if i % 3 == 0 else rng.choice(["a", "Z", "é", None, "zz", f"s{i % 23}"]), i, "l", i)
            for i in range(260)]
    rows += rows[:6] * 3 + [(5, "other", "en", "hot", 5, "l", 0)]
    docs = spark.createDataFrame(rows, DOC).repartition(5)
    want = plain_manifest([dict(zip(["doc_id", "text", "lang", "source", "n_chars"], r)) for r in rows], fan)
    assert sorted(manifest_rows(docs, fan=fan, chunk_rows=chunk_rows), key=repr) == sorted(want, key=repr)


def test_manifest_of_few_rows(spark):
    assert manifest_rows(spark.createDataFrame([], DOC)) == []
    one = [(None, None, None, None, None, None, None)]
    (row,) = manifest_rows(spark.createDataFrame(one, DOC))
    assert row == (None, hexed("-----"), hexed("-----"), hexed("-----"), hexed(""), hexed("-----"), True)


def test_manifest_finds_every_change(spark, root):
    docs = documents(spark, root)
    got = merkle.audit(docs, F.lit(True), F.concat("text", F.lit(" ")))
    assert got.filter("verified").count() == docs.filter("text IS NULL").count()
    assert merkle.audit(docs, F.lit(None).cast("boolean"), F.lit("")).filter("NOT verified").count() == 0


# ---------------------------------------------------------------- phrases

def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, window, slack):
    wins = {}
    for item, text in items:
        ws = plain_words(text)
        if item is None or not ws:
            continue
        n = min(len(ws), window)
        for k in range(len(ws) - n + 1):
            wins.setdefault(tuple(ws[k:k + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        ws, hit, names, near = plain_words(text), set(), set(), set()
        for win, ids in wins.items():
            for p in range(len(ws) - len(win) + 1):
                if tuple(ws[p:p + len(win)]) == win:
                    hit |= set(range(p, p + len(win)))
                    names |= ids
            if any(ws[p] in win and set(win) <= set(ws[p:p + len(win) + slack]) for p in range(len(ws))):
                near |= ids
        out.append((doc, len(ws), len(hit), sorted(names), sorted(near)))
    return sorted(out, key=repr)


def found_rows(df):
    inside = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", inside, "items", "near_items").collect()), key=repr)


def made_up(seed):
    rng = random.Random(seed)
    vocab = ["The", "a", "of", "zug", "Übung", "x1", "99", "term", "rare" + str(seed), "ñ"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "-", "_ "]) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 5, 9, 13]))) for i in range(12)] + [(3, text(6)), (None, text(4)), (77, None), (78, ""), (79, "!?")]
    docs = [(i, text(rng.choice([0, 1, 3, 30, 200]))) for i in range(40)]
    docs += [(100 + i, text(9) + items[i][1] + text(20)) for i in range(12)] + [(None, items[2][1]), (7, None), (7, items[0][1]), (7, items[0][1])]
    # Words of one item in another order, and cut in two by the end of a document.
    docs += [(200, " ".join(reversed(plain_words(items[4][1])))), (201, items[5][1][:9]), (202, items[5][1][9:]), (203, "w" * 200_000 + " " + items[6][1])]
    return docs, items + items[:2]


@pytest.mark.parametrize("shard_words,block_bytes,window,slack", [(1 << 21, 1 << 21, 4, 2), (25, 60, 4, 0), (1, 9, 10, 5), (300, 100, 1, 1)])
def test_phrases_and_proximity(spark, monkeypatch, shard_words, block_bytes, window, slack):
    monkeypatch.setattr(phrase_index, "PIECE", 64)
    docs, items = made_up(window)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns({"items": F.lit(1), "n_words": F.lit("x")})
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    index = phrase_index.build_index(d, scratch_path(spark, "phrases"), shard_words)
    got = phrase_index.search(index, i, window, slack, block_bytes)
    assert found_rows(got) == plain_search(docs, items, window, slack)


def test_steps_of_candidates_lose_nothing(spark, monkeypatch):
    docs, items = made_up(9)
    row = {}
    line, sizes = phrase_index.words([(t or "").encode() for _, t in docs])
    batch = phrase_index._shard("s", [0] * len(docs), [sizes], [line])
    for c in ("n_words", "terms", "counts", "steps"):
        row[c] = phrase_index._values(batch, c, 0)
    wins = phrase_index.Windows.of([t or "" for _, t in items], list(range(len(items))), 3)
    shard = phrase_index.Shard(row, wins.terms)
    whole = [set(zip(*map(np.ndarray.tolist, shard.phrases(r)))) for r in wins.rows.values()]
    near = [set(zip(*map(np.ndarray.tolist, shard.proximities(r, 5)))) for r in wins.rows.values()]
    monkeypatch.setattr(phrase_index, "STEP", 3)
    assert whole == [set(zip(*map(np.ndarray.tolist, shard.phrases(r)))) for r in wins.rows.values()] and any(whole)
    assert near == [set(zip(*map(np.ndarray.tolist, shard.proximities(r, 5)))) for r in wins.rows.values()]


def test_empty_tables_and_settings(spark, root):
    no_docs = spark.createDataFrame([], "doc_id long, text string")
    no_items = spark.createDataFrame([], "item_id long, text string")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    assert phrase_index.decontaminate(no_docs, benchmark(spark, root)).collect() == []
    got = phrase_index.decontaminate(documents(spark, root), no_items)
    assert got.count() == documents(spark, root).count() and got.filter("size(spans) + size(items) + size(near_items) > 0").count() == 0
    assert spark.conf.get(key) == before


def test_index_holds_all_words(spark, root):
    docs = documents(spark, root)
    index = phrase_index.build_index(docs, scratch_path(spark, "phrases"), 5000)
    n = sum(len(plain_words(r["text"])) for r in docs.collect())
    held = index.select(F.sum(F.size("steps")), F.sum(F.size("doc_ids")), F.count("*")).first()
    assert (held[0], held[1]) == (n, docs.count()) and held[2] > 3


# --------------------------------------------------------- hard negatives

VEC = "vec_id long, embedding array<float>, label int, q string, key int"


def plain_mine(rows, every=100, k=5):
    kept = []
    for vec_id, v, label, *_ in rows:
        if label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        kept.append((vec_id, label, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)))
    kept = list(dict.fromkeys(kept))
    last = lambda i: (i is None, i or 0)
    out = []
    for vec_id, label, q in kept:
        if vec_id is None or vec_id % every:
            continue
        scored = [(sum(a * b for a, b in zip(q, o)), i, lab) for i, lab, o in kept if i != vec_id and len(o) == len(q)]
        scored.sort(key=lambda s: (-s[0], last(s[1])))
        for ps, pid, _ in [s for s in scored if s[2] == label][:k]:
            neg = [(s, i) for s, i, lab in scored if lab != label and 80 * ps <= 100 * s <= 100 * ps][:k]
            out += [(vec_id, pid, r, i, ps, s) for r, (s, i) in enumerate(neg, 1)]
    return sorted(out, key=repr)


def vectors(seed, n, dims, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dims))
    rows = []
    for i in range(n):
        v = (centres[i % 4] + spread * rng.normal(size=dims)) * rng.choice([0.05, 0.3, 1.0, 4.0])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(0, 10)), "q", 1))
    return rows


@pytest.mark.parametrize("bucket_values,anchor_rows,dims,spread", [(1 << 20, 2048, 8, 0.3), (60, 2, 6, 0.1), (12, 1, 3, 1.0)])
def test_hard_negatives_are_those_of_plain_code(spark, bucket_values, anchor_rows, dims, spread):
    rows = vectors(dims, 420, dims, spread)
    copy = rows[3][1]
    # Copies over several labels, repeated rows, two vectors under one id, and rows that take no part.
    rows += [(1000 + i, copy, i % 3, "q", 1) for i in range(60)] + rows[:5] + [(100, rows[8][1], 4, "q", 1), (300, None, 1, "q", 1)]
    rows += [(None, rows[9][1], 2, "q", 1), (None, copy, 0, "q", 1), (400, rows[2][1], None, "q", 1), (500, [0.0] * dims, 3, "q", 1)]
    rows += [(600, [float("nan")] + [1.0] * (dims - 1), 3, "q", 1), (700, [None] + [1.0] * (dims - 1), 3, "q", 1), (800, [], 3, "q", 1)]
    rows += [(900, [float("inf")] * dims, 3, "q", 1), (1100, [1.0] * (dims + 1), 3, "q", 1), (1101, [1.0] * (dims + 1), 4, "q", 1)]
    rows += [(1200, [1e6] * dims, 3, "q", 1), (1201, [1e6] * dims, 3, "q", 1), (1202, [0.9e6] * dims, 5, "q", 1)]
    df = spark.createDataFrame(rows, VEC).repartition(4)
    got = hard_negatives.mine(df, bucket_values=bucket_values, anchor_rows=anchor_rows)
    assert sorted((tuple(r) for r in got.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=repr) == plain_mine(rows)


def test_too_long_and_empty(spark):
    rows = [(0, [1e30, 1.0], 1, "q", 1), (100, [1.0, 1.0], 1, "q", 1), (1, [1.0, 1.0], 1, "q", 1), (2, [1.0, 0.9], 2, "q", 1)]
    got = hard_negatives.mine(spark.createDataFrame(rows, VEC))
    assert [tuple(r)[:4] for r in got.collect()] == [(100, 1, 1, 2)]
    assert hard_negatives.mine(spark.createDataFrame([], VEC)).collect() == []
    assert hard_negatives.mine(spark.createDataFrame(rows[2:], VEC)).collect() == []


def test_ranges_prune_and_keep_all_that_qualify():
    rows = np.array([v for _, v, *_ in vectors(5, 600, 8, 0.05)])
    q = np.floor(256 * rows).astype(np.int64)
    bucket = hard_negatives.Bucket(np.arange(len(q)), q)
    fewest = len(q)
    for a in range(0, 600, 37):
        scores = q @ q[a]
        for least in np.quantile(scores, [0.5, 0.9, 0.995]):
            found = bucket.candidates(q[a], float(least), 4)
            assert set(np.flatnonzero(scores >= least)) <= set(found.tolist())
            fewest = min(fewest, len(found))
    assert fewest < 200


def test_buckets_are_bounded(spark):
    copies = [(i, [0.6, 0.8], 1, "q", 1) for i in range(3000)]
    table = hard_negatives.bucketed(hard_negatives.quantized(spark.createDataFrame(copies, VEC)), 400)
    assert table.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 200
    assert table.count() == 3000
