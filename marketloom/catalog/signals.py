"""Panel and signal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panel, signals
from ..plans import views
from ..plans.views import BENCHMARK
from .base import BARS, DAILY_BARS, GRID, big, frame, lag, num, register, truth, when

KEY = f"symbol, {when('ts', 'ts')}"


def _roc(n: int, column: str = "price", key: str = "symbol") -> str:
    return f"{column} / nullif({lag(column, n, key)}, 0) - 1"


MOMENTUM = {
    "momentum_roc20": _roc(20), "momentum_roc60": _roc(60),
    "momentum_ma50": f"price / nullif({frame('avg({})', 'price', 50)}, 0) - 1",
    "momentum_breakout20": truth(f"price >= 0.999 * ({frame('max({})', 'price', 20)}) AND "
                                 f"volume > 1.5 * ({frame('avg({})', 'volume', 20)})")}
REVERSION = {
    "mr_reversal5": f"-({_roc(5)})",
    "mr_zscore20": f"-(price - ({frame('avg({})', 'price', 20)})) / "
                   f"nullif({frame('stddev_samp({})', 'price', 20)}, 0)",
    "mr_dist_vwap20": f"-(price / (({frame('sum({})', 'pv', 20)}) / "
                      f"nullif({frame('sum({})', 'volume', 20)}, 0)) - 1)"}
ZVOL = (f"(volume - ({frame('avg({})', 'volume', 20)})) / "
        f"nullif({frame('stddev_samp({})', 'volume', 20)}, 0)")
VOLUME = {
    "volume_z20": ZVOL,
    "volume_x_ret20": f"coalesce({ZVOL}, 0) * coalesce(sign(price - {lag('price')}), 0)",
    "volume_unusual": truth(f"abs({ZVOL}) > 3")}


def _family(columns: dict[str, str]) -> str:
    body = ", ".join(f"{sql} AS {name}" for name, sql in columns.items())
    return (f"WITH {GRID}, f AS (SELECT symbol, ts, price, {body} "
            f"FROM (SELECT *, price * volume AS pv FROM grid)) "
            f"SELECT {KEY}, {', '.join(num(c, c) for c in columns)} FROM f WHERE price IS NOT NULL")


@register("momentum_features", _family(MOMENTUM))
def _momentum(spark, root):
    return signals.momentum_features(views.bars(spark, root))


@register("mean_reversion_features", _family(REVERSION))
def _reversion(spark, root):
    return signals.mean_reversion_features(views.bars(spark, root))


@register("volume_features", _family(VOLUME))
def _volume(spark, root):
    return signals.volume_features(views.bars(spark, root))


# Realised volatility, then its percentile (brute-force over the last 252 rows) and expansion.
VOL_CTE = f"""lr AS (
  SELECT *, CASE WHEN price / {lag('price')} > 0 THEN ln(price / {lag('price')}) END AS lr FROM grid),
rv AS (SELECT *, ({frame('stddev_samp({})', 'lr', 20)}) * sqrt(252.0) AS rv FROM lr),
hist AS (SELECT *, {frame('list({})', 'rv', 252)} AS h,
         {frame('median({})', 'rv', 20)} AS med FROM rv),
vol AS (SELECT *, len(list_filter(h, lambda x: x <= rv)) / 252.0 AS pct,
        {truth('rv > 1.5 * med')} AS expanding FROM hist)"""


@register("volatility_features", f"""WITH {GRID}, {VOL_CTE}
SELECT {KEY}, {num('rv', 'vol_realized20')}, {num('pct', 'vol_percentile252')},
       {num('expanding', 'vol_expanding')} FROM vol WHERE price IS NOT NULL""")
def _volatility(spark, root):
    return signals.volatility_features(views.bars(spark, root))


@register("xsectional_features", f"""WITH {GRID}, ret AS (
  SELECT symbol, ts, price, {_roc(1)} AS r1, {_roc(20)} AS r20, {_roc(60)} AS r60 FROM grid),
ex AS (
  SELECT r.symbol, r.ts, r.price, r.r1 - b.r1 AS e1, r.r20 - b.r20 AS e20, r.r60 - b.r60 AS e60,
         1 + r.r1 - b.r1 AS g1
  FROM ret r JOIN ret b ON b.ts = r.ts AND b.symbol = '{BENCHMARK}' WHERE r.symbol <> '{BENCHMARK}'),
va AS (SELECT *, (({frame('product({})', 'g1', 60)}) - 1)
              / nullif({frame('stddev_samp({})', 'e1', 60)}, 0) AS v60 FROM ex)
SELECT {KEY}, {num('e20', 'xs_excess20')}, {num('e60', 'xs_excess60')},
       {num('v60', 'xs_voladj60')} FROM va WHERE price IS NOT NULL""")
def _xsectional(spark, root):
    return signals.xsectional_features(views.bars(spark, root), BENCHMARK)


REGIME = f"""{GRID}, {VOL_CTE}, bench AS (
  SELECT ts, pct, {truth(f"price > ({frame('avg({})', 'price', 50)})")}
    + {truth(f"price > ({frame('avg({})', 'price', 200)})")} - 1 AS trend
  FROM vol WHERE symbol = '{BENCHMARK}'),
br AS (SELECT ts, avg(a) AS breadth FROM (
  SELECT ts, {truth(f"price > ({frame('avg({})', 'price', 50)})")} AS a
  FROM grid WHERE symbol <> '{BENCHMARK}') GROUP BY ts),
regime AS (SELECT ts, trend, pct, breadth, {truth('trend > 0 AND pct < 0.7')} AS risk_on
  FROM bench JOIN br USING (ts))"""


@register("regime_features", f"""WITH {REGIME}
SELECT {when('ts', 'ts')}, {num('trend', 'regime_spy_trend')}, {num('pct', 'regime_vol_percentile')},
       {num('breadth', 'regime_breadth')}, {num('risk_on', 'regime_risk_on')} FROM regime""")
def _regime(spark, root):
    return signals.regime_features(views.bars(spark, root), BENCHMARK)


@register("densify_bars", f"""WITH {GRID}, n AS (
  SELECT *, dense_rank() OVER (ORDER BY ts) AS bar_no FROM grid)
SELECT {KEY}, {big('bar_no', 'bar_no')}, {num('price', 'price')}, {num('volume', 'volume')} FROM n""")
def _densify(spark, root):
    return panel.densify(views.bars(spark, root))


@register("forward_filled_panel", f"""WITH {DAILY_BARS},
g AS (SELECT s.symbol, t.ts, b.price FROM (SELECT DISTINCT symbol FROM bars) s
  CROSS JOIN (SELECT DISTINCT ts FROM bars) t
  LEFT JOIN bars b ON b.symbol = s.symbol AND b.ts = t.ts)
SELECT {KEY}, {num('last_value(price IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts)', 'price')}
FROM g""")
def _ffill(spark, root):
    return panel.forward_fill(panel.densify(views.bars(spark, root, "day")), ["price"]).select("symbol", "ts", "price")


@register("gappy_momentum", f"""WITH {DAILY_BARS},
grid AS (SELECT s.symbol, t.ts, b.price, b.volume FROM (SELECT DISTINCT symbol FROM bars) s
  CROSS JOIN (SELECT DISTINCT ts FROM bars) t
  LEFT JOIN bars b ON b.symbol = s.symbol AND b.ts = t.ts),
f AS (SELECT symbol, ts, price, {', '.join(f'{v} AS {k}' for k, v in MOMENTUM.items())} FROM grid)
SELECT {KEY}, {', '.join(num(c, c) for c in MOMENTUM)} FROM f WHERE price IS NOT NULL""")
def _gappy(spark, root):
    return signals.momentum_features(views.bars(spark, root, "day"))


@register("wide_panel", f"""WITH {BARS} SELECT {when('ts', 'ts')},
  {', '.join(num(f"max(price) FILTER (symbol = '{s}')", s.lower()) for s in views.SYMBOLS)}
FROM bars GROUP BY bars.ts""")
def _wide(spark, root):
    wide = panel.to_wide(views.bars(spark, root), "price", views.SYMBOLS)
    return wide.select("ts", *[F.col(s).alias(s.lower()) for s in views.SYMBOLS])


@register("stacked_features", f"""WITH {GRID}, f AS (SELECT symbol, ts, price,
  {', '.join(f'{v} AS {k}' for k, v in MOMENTUM.items())} FROM grid), u AS (
  {' UNION ALL '.join(f"SELECT symbol, ts, price, '{c}' AS feature, {c} AS value FROM f"
                      for c in MOMENTUM)})
SELECT {KEY}, feature, {num('value', 'value')} FROM u WHERE price IS NOT NULL""")
def _stacked(spark, root):
    return panel.stack_features(signals.momentum_features(views.bars(spark, root)), list(MOMENTUM))


@register("cross_sectional_ranks", f"""WITH {GRID}, f AS (
  SELECT symbol, ts, price, {lag('price', 21)} / nullif({lag('price', 252)}, 0) - 1 AS a,
         {_roc(1)} AS b FROM grid)
SELECT {KEY},
  {num('CASE WHEN a IS NOT NULL THEN percent_rank() OVER (PARTITION BY ts, a IS NULL ORDER BY a) END', 'xs_rank_long')},
  {num('CASE WHEN b IS NOT NULL THEN percent_rank() OVER (PARTITION BY ts, b IS NULL ORDER BY -b) END', 'xs_rank_reversal')}
FROM f WHERE price IS NOT NULL""")
def _ranks(spark, root):
    return signals.cross_sectional_ranks(views.bars(spark, root))


@register("sector_relative", f"""WITH {GRID}, f AS (
  SELECT symbol, ts, price, CASE WHEN length(symbol) > 5 THEN 'long' ELSE 'short' END AS sector,
         {_roc(20)} AS r FROM grid)
SELECT {KEY}, sector, {num('r - avg(r) OVER (PARTITION BY sector, ts)', 'sector_excess')}
FROM f WHERE price IS NOT NULL""")
def _sector(spark, root):
    bars = views.bars(spark, root)
    sectors = (views.table(spark, root, "part").select(F.col("p_type").alias("symbol")).distinct()
               .withColumn("sector", F.when(F.length("symbol") > 5, "long").otherwise("short")))
    return signals.sector_relative(bars, sectors)


@register("range_features", f"""WITH b AS (
  SELECT p_type AS symbol, date_trunc('week', l_shipdate) AS ts,
    sum(l_extendedprice) / sum(l_quantity) AS price, max(l_extendedprice / l_quantity) AS hi,
    min(l_extendedprice / l_quantity) AS lo
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
g AS (SELECT s.symbol, t.ts, price, hi, lo FROM (SELECT DISTINCT symbol FROM b) s
  CROSS JOIN (SELECT DISTINCT ts FROM b) t LEFT JOIN b ON b.symbol = s.symbol AND b.ts = t.ts),
t AS (SELECT *, {lag('price')} AS pc FROM g),
r AS (SELECT *, CASE WHEN price IS NOT NULL THEN greatest(hi - lo, abs(hi - pc), abs(lo - pc)) END AS tr FROM t),
a AS (SELECT *, {frame('avg({})', 'tr', 14)} AS atr FROM r)
SELECT {KEY}, {num('atr / price', 'atr_rel')}, {num(truth('tr < 0.5 * atr'), 'contraction')} FROM a
WHERE price IS NOT NULL""")
def _range(spark, root):
    return signals.range_features(views.ohlc(spark, root))


@register("liquidity_screen", f"""WITH {GRID}, v AS (SELECT *, price * volume AS pv FROM grid),
a AS (SELECT *, {frame('avg({})', 'pv', 20)} AS adv FROM v)
SELECT {KEY}, {num('adv', 'adv', 4)}, {num(truth('adv >= 400000'), 'liquid')}
FROM a WHERE price IS NOT NULL""", digits=4)
def _liquidity(spark, root):
    return panel.liquidity_screen(views.bars(spark, root), 400_000)
