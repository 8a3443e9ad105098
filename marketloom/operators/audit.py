"""Hash-chained ledgers and constraint audits rebuilt from fills."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import chunk_scan, parted, previous_row, rows_chunk, running_sum
from ..session import cut_lineage

GENESIS = "0" * 64
# Ledger record types.
RECORD_TYPES = ("signal", "proposal", "risk_decision", "order", "fill", "position", "benchmark",
                "note")
AUDIT_BLOCK = 256


# ----------------------------------------------------------- hash chains

def canonical_text(prev_hash: Column) -> Column:
    """Hashed text of a record: its JSON with sorted keys, compact, without the hash itself.

    ``body`` already is the canonical JSON of the record's data, ``ts`` is text.
    """
    return F.concat(F.lit('{"data":'), F.col("body"), F.lit(',"prev_hash":"'), prev_hash,
                    F.lit('","seq":'), F.col("seq").cast("string"), F.lit(',"ts":"'), F.col("ts"),
                    F.lit('","type":"'), F.col("type"), F.lit('"}'))


def unknown_types(records: DataFrame) -> DataFrame:
    return records.filter(~F.coalesce(F.col("type").isin(*RECORD_TYPES), F.lit(False)))


def build_chain(records: DataFrame, chain: str = "chain") -> DataFrame:
    """Add ``prev_hash`` and ``hash`` to (chain, seq, ts, type, body) records.

    A hash needs its predecessor's, so one chain is inherently sequential; rows of a chain are
    brought together in order and streamed, with only the running hash kept in memory. Use
    :func:`build_segments` where single chains grow without bound.
    """
    columns = list(records.columns)
    parts = records.withColumn(
        "_head", F.concat(F.lit('{"data":'), F.col("body"), F.lit(',"prev_hash":"'))).withColumn(
        "_tail", F.concat(F.lit('","seq":'), F.col("seq").cast("string"), F.lit(',"ts":"'),
                          F.col("ts"), F.lit('","type":"'), F.col("type"), F.lit('"}')))
    ordered = parts.repartition(chain).sortWithinPartitions(chain, "seq")
    at = columns.index(chain)

    def chain_batches(batches):
        import pyarrow as pa
        current, last = None, GENESIS
        for batch in batches:
            keys = batch.column(at).to_pylist()
            heads, tails = batch.column("_head").to_pylist(), batch.column("_tail").to_pylist()
            before, own = [], []
            for key, head, tail in zip(keys, heads, tails):
                if key != current:
                    current, last = key, GENESIS
                before.append(last)
                last = hashlib.sha256((head + last + tail).encode()).hexdigest()
                own.append(last)
            arrays = [batch.column(c) for c in columns] + [pa.array(before, pa.string()),
                                                           pa.array(own, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "prev_hash", "hash"])

    schema = records.schema.simpleString()[len("struct<"):-1]
    return ordered.mapInArrow(chain_batches, f"{schema},prev_hash:string,hash:string")


def build_segments(records: DataFrame, rows: int = 512, chain: str = "chain") -> DataFrame:
    """Chains cut into segments of ``rows`` records that are hashed independently.

    ``seq`` is dense per chain, so a segment is a bounded group whatever the chain's length. A
    segment starts from the digest of its chain and number instead of the all-zero hash.
    """
    segment = F.floor((F.col("seq") - 1) / rows)
    anchor = F.sha2(F.concat_ws("#", F.col(chain).cast("string"), F.col("segment").cast("string")), 256)
    fields = [c for c in records.columns if c != chain]
    empty = F.array().cast("array<struct<prev_hash:string,hash:string>>")
    grouped = (records.withColumn("segment", segment).groupBy(chain, "segment")
               .agg(F.array_sort(F.collect_list(F.struct("seq", *[f for f in fields if f != "seq"])))
                    .alias("_rows"))
               .withColumn("_anchor", anchor))

    def step(done: Column, r: Column) -> Column:
        before = F.coalesce(F.try_element_at(done, F.lit(-1))["hash"], F.col("_anchor"))
        text = F.concat(F.lit('{"data":'), r["body"], F.lit(',"prev_hash":"'), before,
                        F.lit('","seq":'), r["seq"].cast("string"), F.lit(',"ts":"'), r["ts"],
                        F.lit('","type":"'), r["type"], F.lit('"}'))
        return F.concat(done, F.array(F.struct(before.alias("prev_hash"),
                                               F.sha2(text, 256).alias("hash"))))
    hashed = grouped.withColumn("_h", F.aggregate("_rows", empty, step))
    zipped = hashed.select(chain, "segment", F.explode(F.arrays_zip("_rows", "_h")).alias("_z"))
    return zipped.select(chain, "segment", *[F.col(f"_z._rows.{f}").alias(f) for f in fields],
                         "_z._h.prev_hash", "_z._h.hash")


def chain_problems(ledger: DataFrame, chain: Sequence[str] = ("chain",),
                   genesis: Column | None = None) -> DataFrame:
    """Records whose link or own hash is wrong. Runs in parallel inside every chain."""
    start = F.lit(GENESIS) if genesis is None else genesis
    seen = chunk_scan(ledger, list(chain), rows_chunk("seq"), ["seq"],
                      [previous_row("_before", F.col("hash"))])
    linked = F.col("prev_hash") == F.coalesce(F.col("_before.v"), start)
    intact = F.sha2(canonical_text(F.col("prev_hash")), 256) == F.col("hash")
    return (seen.withColumn("problem", F.when(~F.coalesce(linked, F.lit(False)), "broken_link")
                            .when(~F.coalesce(intact, F.lit(False)), "bad_hash"))
            .filter("problem IS NOT NULL").drop("_before"))


def verify_chain(ledger: DataFrame, chain: Sequence[str] = ("chain",),
                 genesis: Column | None = None) -> DataFrame:
    """Per chain: whether it is intact and the first bad sequence number."""
    bad = chain_problems(ledger, chain, genesis).groupBy(*chain).agg(
        F.min("seq").alias("first_bad_seq"), F.count("*").alias("n_problems"))
    sizes = ledger.groupBy(*chain).agg(F.count("*").alias("n_records"))
    return sizes.join(bad, list(chain), "left").select(
        *chain, "n_records", F.col("first_bad_seq").isNull().alias("ok"), "first_bad_seq",
        F.coalesce("n_problems", F.lit(0)).alias("n_problems"))


def canonical_json(column: str, without: str | None = None) -> Column:
    """Canonical form of foreign JSON text (sorted keys, compact, Python number format).

    ``without`` names a top-level key to leave out.
    """
    @F.pandas_udf("string")
    def rewrite(texts: pd.Series) -> pd.Series:
        import json

        def one(text):
            if text is None:
                return None
            value = json.loads(text)
            if without is not None:
                value.pop(without, None)
            return json.dumps(value, sort_keys=True, separators=(",", ":"))
        return texts.map(one)
    return rewrite(column)


def ledger_tail(ledger: DataFrame, n: int = 20, seq: str = "seq") -> DataFrame:
    """The last ``n`` records in order."""
    return ledger.orderBy(F.desc(seq)).limit(n).orderBy(seq)


# ------------------------------------------------------- fills → positions

def _signed() -> Column:
    return F.when(F.col("side") == "BUY", F.col("qty")).when(F.col("side") == "SELL", -F.col("qty")).otherwise(0.0)


def _short_accounts(fills: DataFrame, rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Fills of the accounts that lie in one chunk of ``rows`` fills, with it as ``_c``, and those of all others (or None).

    Short accounts need no carry from chunk to chunk: one shuffle brings a chunk together, and windows do the rest.
    Accounts that hold more fills than their numbers span repeat numbers and are not bounded by ``rows``: they are others.
    """
    chunk = rows_chunk("seq", rows)
    spread = fills.groupBy("account").agg(F.min(chunk).alias("_from"), F.max(chunk).alias("_to"), F.count("*").alias("_n"),
                                          F.count(chunk).alias("_placed"), (F.max("seq") - F.min("seq") + 1).alias("_span"))
    long = spread.filter((F.col("_placed") < F.col("_n")) | (F.col("_from") < F.col("_to")) | (F.col("_n") > F.col("_span")))
    short, rest = parted(fills, ["account"], long)
    return short.withColumn("_c", chunk).repartition("account", "_c"), rest


def _positions_in_one(fills: DataFrame) -> DataFrame:
    """:func:`running_positions` of accounts that lie in one chunk ``_c``."""
    inner = Window.partitionBy("account", "_c", "symbol").orderBy("seq")
    exclusive = inner.rowsBetween(Window.unboundedPreceding, -1)
    summed = (fills.withColumn("_q", _signed())
              .withColumn("_s", F.sum("_q").over(inner.rowsBetween(Window.unboundedPreceding, 0))))
    low_before = F.least(F.min("_s").over(exclusive), F.lit(0.0))
    return summed.select(*fills.columns, (F.col("_s") - F.col("_q") - low_before).alias("held_before"),
                         (F.col("_s") - F.least(low_before, F.col("_s"))).alias("position"),
                         F.last("fill_price").over(exclusive).alias("previous_price"))


def running_positions(fills: DataFrame, rows: int = 65_536) -> DataFrame:
    """Held quantity before and after each fill; a sell beyond the holding leaves zero.

    With S the running signed quantity, clamping at zero is S − min(0, running min S). One pair
    of chunk summaries (total, lowest prefix) carries both across chunks, for accounts of more than
    one chunk. Fills without account, symbol or number are kept: NULL is a key like any other, and a
    fill without number comes first.
    """
    short, rest = _short_accounts(fills, rows)
    held = _positions_in_one(short)
    held = held.drop("_c")
    return held if rest is None else held.unionByName(_positions_by_chunk(rest, rows))


def _positions_by_chunk(fills: DataFrame, rows: int) -> DataFrame:
    # One struct of key and chunk: structs are equal where their fields are NULL.
    part = F.struct("account", "symbol", rows_chunk("seq", rows).alias("c"))
    inner = Window.partitionBy("_k").orderBy("seq")
    local = (fills.withColumns({"_k": part, "_q": _signed()})
             .withColumn("_s", F.sum("_q").over(inner.rowsBetween(Window.unboundedPreceding, 0))))
    before = Window.partitionBy("_k.account", "_k.symbol").orderBy("_k.c").rowsBetween(Window.unboundedPreceding, -1)
    carry = (local.groupBy("_k").agg(F.sum("_q").alias("_total"), F.min("_s").alias("_low"),
                                     F.max_by("fill_price", F.coalesce("seq", F.lit(-1))).alias("_last"))
             .withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0.0)))
             .withColumns({"_floor": F.min(F.col("_offset") + F.col("_low")).over(before),
                           "_price0": F.last("_last").over(before)})
             .select("_k", "_offset", "_floor", "_price0"))
    joined = local.join(carry, "_k").withColumn("_s", F.col("_s") + F.col("_offset"))
    exclusive = inner.rowsBetween(Window.unboundedPreceding, -1)
    low_before = F.least(F.min("_s").over(exclusive), F.col("_floor"), F.lit(0.0))
    return (joined.withColumns({
        "held_before": F.col("_s") - F.col("_q") - low_before,
        "position": F.col("_s") - F.least(low_before, F.col("_s")),
        "previous_price": F.coalesce(F.last("fill_price").over(exclusive), F.col("_price0"))})
        .select(*fills.columns, "held_before", "position", "previous_price"))


def account_state(fills: DataFrame, start_cash: float, rows: int = 65_536) -> DataFrame:
    """Cash, holdings value and equity of the account after each fill.

    A fill changes only its own symbol's value, so the holdings value is a running sum of those
    changes; no (fill × held symbol) product is formed.
    """
    cash = F.when(F.col("side") == "BUY", -F.col("qty") * F.col("fill_price")) \
        .when(F.col("side") == "SELL", F.col("qty") * F.col("fill_price")).otherwise(0.0)
    value = F.col("position") * F.col("fill_price")
    change = value - F.coalesce(F.col("held_before") * F.col("previous_price"), F.lit(0.0))
    short, rest = _short_accounts(fills, rows)
    held = _positions_in_one(short).withColumns({"symbol_value": value})
    up_to = Window.partitionBy("account", "_c").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    state = held.select("*", *[F.coalesce(F.sum(v).over(up_to), F.lit(0)).alias(out)
                               for out, v in (("_cash", cash), ("gross", change))]).drop("_c")
    if rest is not None:
        held = _positions_by_chunk(rest, rows).withColumns({"symbol_value": value})
        state = state.unionByName(chunk_scan(held, ["account"], rows_chunk("seq", rows), ["seq"],
                                             [running_sum("_cash", cash), running_sum("gross", change)]))
    return (state.withColumn("cash", F.col("_cash") + start_cash).drop("_cash")
            .withColumn("equity", F.col("cash") + F.col("gross")))


def audit_fills(fills: DataFrame, start_cash: float = 100.0, max_position_pct: float = 0.25,
                max_gross_pct: float = 0.95, min_price: float = 5.0,
                block: int = AUDIT_BLOCK) -> DataFrame:
    """All constraint violations as (account, seq, symbol, code)."""
    # Written once: the single-fill rules and every part of the concentration check read it.
    state = cut_lineage(account_state(fills, start_cash))
    c = F.col
    sell = c("side") == "SELL"
    own = F.array_compact(F.array(
        F.when((c("side") == "BUY") & (c("fill_price") < min_price), "PENNY_STOCK"),
        F.when(sell & (c("held_before") <= 0), "SHORT"),
        F.when(sell & (c("held_before") > 0) & (c("qty") > c("held_before") + 1e-9), "OVERSELL"),
        F.when(c("equity") <= 0, "NON_POSITIVE_EQUITY"),
        F.when((c("equity") > 0) & (c("gross") > max_gross_pct * c("equity") + 1e-9),
               "OVER_EXPOSURE")))
    single = state.select("account", "seq", "symbol", F.explode(own).alias("code"))
    heavy = concentrations(state, max_position_pct, block)
    return single.unionByName(heavy.select("account", "seq", "symbol",
                                           F.lit("OVER_CONCENTRATION").alias("code")))


def concentrations(state: DataFrame, max_position_pct: float, block: int = AUDIT_BLOCK) -> DataFrame:
    """(account, seq, symbol) for every held symbol above its share of equity after every fill.

    A symbol's value is constant between its fills. Those intervals are cut at blocks of
    ``block`` fills; an interval that cannot exceed the limit at the lowest equity of its block
    is dropped before it meets the block's fills. A holding that lasts over many blocks is not
    written out block by block: it is first held against the lowest equity of 16^k blocks, and only
    where it may exceed the limit there is it cut 16 times finer.
    """
    rows = state.select("account", "symbol", "seq", "equity", F.col("symbol_value").alias("v"),
                        F.floor(F.col("seq") / block).alias("b"))
    inner = Window.partitionBy("account", "symbol", "b").orderBy("seq")
    end = (F.col("b") + 1) * block
    within = rows.select("account", "symbol", "b", "v", F.col("seq").alias("lo"),
                         F.coalesce(F.lead("seq").over(inner), end).alias("hi"))
    per_block = rows.groupBy("account", "symbol", "b").agg(
        F.min("seq").alias("first_seq"), F.max_by("v", "seq").alias("v"))
    last_block = rows.groupBy("account").agg(F.max("b").alias("_last"))
    over = Window.partitionBy("account", "symbol").orderBy("b")
    carried = (per_block.withColumns({"_nb": F.lead("b").over(over), "_nf": F.lead("first_seq").over(over)})
               .join(last_block, "account").filter("v > 0")
               .withColumn("_to", F.coalesce("_nb", "_last"))
               .filter(F.col("_to") > F.col("b")))
    lowest = (rows.filter("equity > 0").groupBy("account", "b").agg(F.min("equity").alias("_min")))
    carried = (_in_low_blocks(carried, lowest, max_position_pct)
               .select("account", "symbol", "b", "v", (F.col("b") * block).alias("lo"),
                       F.when(F.col("b") == F.col("_nb"), F.col("_nf"))
                       .otherwise((F.col("b") + 1) * block).alias("hi")))
    alive = (within.filter("v > 0").unionByName(carried).join(lowest, ["account", "b"])
             .filter(F.col("v") > F.col("_min") * max_position_pct + 1e-9).drop("_min"))
    fills = rows.filter("equity > 0").select("account", "b", "seq", "equity")
    return (fills.join(alive, ["account", "b"])
            .filter((F.col("seq") >= F.col("lo")) & (F.col("seq") < F.col("hi"))
                    & (F.col("v") > F.col("equity") * max_position_pct + 1e-9))
            .select("account", "seq", "symbol"))


FINER = 16


def _in_low_blocks(holdings: DataFrame, lowest: DataFrame, max_position_pct: float, few: int = 64) -> DataFrame:
    """``holdings`` (account, b, v, _to, …) once per later block ``b`` up to ``_to`` where ``v`` may exceed its share.

    ``lowest``: account, b, ``_min``. Starts with as many blocks taken together as leave at most ``few``
    steps for the longest holding.
    """
    longest = holdings.agg(F.max(F.col("_to") - F.col("b"))).first()[0] or 0
    size = 1
    while longest > few * size:
        size *= FINER
    if size > 1:
        # Read at every level.
        holdings, lowest = cut_lineage(holdings), cut_lineage(lowest)
    out = holdings.withColumns({"_from": F.col("b") + 1, "_first": F.floor((F.col("b") + 1) / size), "_last_": F.floor(F.col("_to") / size)})
    while True:
        low = lowest.groupBy("account", F.floor(F.col("b") / size).alias("_at")).agg(F.min("_min").alias("_low"))
        out = (out.withColumn("_at", F.explode(F.sequence("_first", "_last_"))).join(low, ["account", "_at"])
               .filter(F.col("v") > F.col("_low") * max_position_pct + 1e-9).drop("_low"))
        if size == 1:
            return out.withColumn("b", F.col("_at")).drop("_at", "_from", "_first", "_last_")
        size //= FINER
        out = out.withColumns({"_first": F.greatest(F.col("_at") * FINER, F.floor(F.col("_from") / size)),
                               "_last_": F.least(F.col("_at") * FINER + FINER - 1, F.floor(F.col("_to") / size))}).drop("_at")
