"""Point-process queries. Decays are per second and suit the sparse test events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hawkes
from ..plans import views
from ..session import cut_lineage
from ..sources import manifest
from .base import num, register, when

BETAS = tuple(k / 2000 for k in range(1, 11))
# All test events fall into January, so market-local time is UTC minus five hours in the SQL.
HOURS = """hours AS (SELECT user_id % 4 AS session, event_id, ts, ts - INTERVAL 5 HOUR AS local_ts,
    event_type, value AS price FROM events
  WHERE CAST(ts - INTERVAL 5 HOUR AS TIME) BETWEEN TIME '09:30:00' AND TIME '16:00:00')"""
STREAMS = HOURS + """, jumps AS (SELECT session, ts, d FROM (
    SELECT session, ts, price - lag(price) OVER (PARTITION BY session ORDER BY ts, event_id) AS d
    FROM hours WHERE event_type <> 'signup') WHERE d <> 0),
both_dims AS (SELECT session, 0 AS dim, epoch_us(ts) AS us FROM hours WHERE event_type = 'signup'
  UNION ALL SELECT session, 1, epoch_us(ts) FROM jumps),
numbered AS (SELECT session, dim, us - min(us) OVER (PARTITION BY session) AS t,
    row_number() OVER (PARTITION BY session, dim ORDER BY us) AS i FROM both_dims),
streams AS (SELECT session, dim, i + max(t - i) OVER (PARTITION BY session, dim ORDER BY i) AS t_us FROM numbered)"""


def stream_rows(spark, root):
    news = hawkes.trading_hours(views.news_times(spark, root))
    ticks = hawkes.trading_hours(views.ticks(spark, root))
    # The prepared streams are a dataset of their own, read several times by fits and residuals.
    return cut_lineage(hawkes.streams(news, hawkes.price_jumps(ticks)))


@register("trading_hours", f"""WITH {HOURS} SELECT session, event_id, {when('local_ts', 'local_ts')},
  {num('price', 'price')} FROM hours WHERE event_type <> 'signup'""")
def _hours(spark, root):
    return hawkes.trading_hours(views.ticks(spark, root)).select(
        "session", "event_id", "local_ts", "price")


@register("price_jumps", """SELECT session, event_id, round(d, 6) + 0.0 AS price_change FROM (
  SELECT user_id % 4 AS session, event_id, value - lag(value) OVER (
    PARTITION BY user_id % 4 ORDER BY ts, event_id) AS d FROM events WHERE event_type <> 'signup')
WHERE d <> 0""")
def _jumps(spark, root):
    return hawkes.price_jumps(views.ticks(spark, root)).select("session", "event_id", "price_change")


@register("hawkes_streams", f"""WITH {STREAMS} SELECT session, CAST(dim AS BIGINT) AS dim, t_us FROM streams""")
def _streams(spark, root):
    return stream_rows(spark, root)


@register("interarrival_gaps", f"""WITH {STREAMS}, g AS (SELECT session, dim, t_us,
    (t_us - lag(t_us) OVER (PARTITION BY session, dim ORDER BY t_us)) / 1e6 AS gap FROM streams)
SELECT session, CAST(dim AS BIGINT) AS dim, t_us, {num('gap', 'gap')} FROM g WHERE gap IS NOT NULL""")
def _gaps(spark, root):
    return hawkes.interarrivals(stream_rows(spark, root))


SIZE, STEP = 86_400, 21_600


@register("sliding_event_counts", f"""WITH {STREAMS}, x AS (
  SELECT session, min(t_us) AS a, max(t_us) AS z FROM streams GROUP BY session),
w AS (SELECT session, k AS win, a + k * {STEP}000000 AS s, a + k * {STEP}000000 + {SIZE}000000 AS e
  FROM (SELECT session, a, z, unnest(range(CAST((z - a - {SIZE}000000) // {STEP}000000 + 1 AS BIGINT))) AS k
        FROM x WHERE z - a >= {SIZE}000000))
SELECT w.session, win, s AS start_us, e AS end_us, count(*) FILTER (dim = 0) AS news_count,
  count(*) FILTER (dim = 1) AS price_count
FROM w JOIN streams t ON t.session = w.session AND t_us >= s AND t_us < e GROUP BY ALL""")
def _counts(spark, root):
    return hawkes.window_counts(hawkes.sliding_windows(stream_rows(spark, root), SIZE, STEP))


def _moment_ctes(events: str, ends: str, betas, keys: str = "session") -> str:
    """CTE m: brute-force double sums over all event pairs of a key. ``events``: keys, dim, t."""
    decay = "exp(-beta * abs(x.t - y.t))"
    names = keys.split(", ")
    same = " AND ".join(f"y.{k} = x.{k}" for k in names)
    pairs = ", ".join(f"coalesce(sum({decay}) FILTER (x.dim = {j} AND y.dim = {o}), 0) AS x{j}_{o}"
                      for j, o in ((0, 0), (0, 1), (1, 1)))
    sums = ", ".join(f"coalesce(sum(beta * {decay}) FILTER (x.dim = {i} AND y.dim = {j} AND y.t < x.t), 0) AS sum_{i}_{j}"
                     for i in (0, 1) for j in (0, 1))
    out = [keys, "beta", "big_t AS horizon"]
    for j in (0, 1):
        out += [f"n{j}", f"n{j} - f{j} AS int_{j}"] + [f"sum_{i}_{j}" for i in (0, 1)]
        out += [f"beta / 2 * (x{j}_{o} - f{j} * f{o}) AS gram_{j}_{o}" for o in range(j, 2)]
    return f"""ev AS ({events}), ends AS ({ends}),
b AS (SELECT unnest({list(betas)}::DOUBLE[]) AS beta),
one AS (SELECT {keys}, beta, big_t, count(*) FILTER (dim = 0) AS n0, count(*) FILTER (dim = 1) AS n1,
    coalesce(sum(exp(-beta * (big_t - t))) FILTER (dim = 0), 0) AS f0,
    coalesce(sum(exp(-beta * (big_t - t))) FILTER (dim = 1), 0) AS f1
  FROM ev JOIN ends USING ({keys}) CROSS JOIN b GROUP BY ALL),
p AS (SELECT {', '.join(f'x.{k}' for k in names)}, beta, {pairs}, {sums} FROM ev x JOIN ev y ON {same}
  CROSS JOIN b GROUP BY ALL),
m AS (SELECT {', '.join(out)} FROM p JOIN one USING ({keys}, beta))"""


EVENTS = "SELECT session, dim, t_us / 1e6 AS t FROM streams"
LAST = "SELECT session, max(t) AS big_t FROM ev GROUP BY session"
MOMENTS = _moment_ctes(EVENTS, LAST, BETAS)
_NUMBERS = ["int_0", "int_1", "sum_0_0", "sum_0_1", "sum_1_0", "sum_1_1", "gram_0_0", "gram_0_1", "gram_1_1"]


@register("hawkes_moments", f"""WITH {STREAMS}, {MOMENTS}
SELECT session, {num('beta', 'beta')}, {num('horizon', 'horizon')}, n0, n1, {', '.join(num(c, c) for c in _NUMBERS)} FROM m""")
def _moments(spark, root):
    return hawkes.hawkes_moments(stream_rows(spark, root), ["session"], BETAS)


def _fit_ctes(keys: str = "session", penalty: float = 1e-4) -> str:
    """CTE fit: of the solutions on each set of unknowns, the best without a negative one."""
    gram = [["horizon", "int_0", "int_1"], ["int_0", "gram_0_0", "gram_0_1"], ["int_1", "gram_0_1", "gram_1_1"]]
    for k in range(3):
        gram[k][k] = f"({gram[k][k]} + {penalty})"

    def det(m):
        if len(m) == 1:
            return m[0][0]
        if len(m) == 2:
            return f"({m[0][0]} * {m[1][1]} - {m[0][1]} * {m[1][0]})"
        minors = [[row[:k] + row[k + 1:] for row in m[1:]] for k in range(3)]
        return f"({m[0][0]} * {det(minors[0])} - {m[0][1]} * {det(minors[1])} + {m[0][2]} * {det(minors[2])})"

    parts = []
    for i in (0, 1):
        right = [f"n{i}", f"sum_{i}_0", f"sum_{i}_1"]
        for chosen in range(8):
            rows = [k for k in range(3) if chosen >> k & 1]
            w = ["0::DOUBLE"] * 3
            for at, k in enumerate(rows):
                swapped = [[right[a] if j == at else gram[a][c] for j, c in enumerate(rows)] for a in rows]
                w[k] = f"({det(swapped)} / {det([[gram[a][c] for c in rows] for a in rows])})"
            value = " + ".join(f"{w[k]} * {right[k]}" for k in rows) or "0"
            parts.append(f"SELECT {keys}, beta, {i} AS i, {w[0]} AS w0, {w[1]} AS w1, {w[2]} AS w2, {value} AS value FROM m")
    return f"""cand AS ({' UNION ALL '.join(parts)}),
best AS (SELECT * FROM cand WHERE w0 >= 0 AND w1 >= 0 AND w2 >= 0
  QUALIFY row_number() OVER (PARTITION BY {keys}, beta, i ORDER BY value DESC) = 1),
flat AS (SELECT {keys}, beta, max(w0) FILTER (i = 0) AS mu_0, max(w0) FILTER (i = 1) AS mu_1, max(w1) FILTER (i = 0) AS a00,
    max(w2) FILTER (i = 0) AS a01, max(w1) FILTER (i = 1) AS a10, max(w2) FILTER (i = 1) AS a11 FROM best GROUP BY ALL),
fit AS (SELECT *, (a00 + a11 + sqrt((a00 - a11) ** 2 + 4 * a01 * a10)) / 2 AS endogeneity FROM flat)"""


# Baselines are small rates: shown per million seconds.
_FITTED = [num("1e6 * mu_0", "mu_0_e6"), num("1e6 * mu_1", "mu_1_e6"), num("a00", "alpha_0_0"), num("a01", "alpha_0_1"),
           num("a10", "alpha_1_0"), num("a11", "alpha_1_1")]


@register("hawkes_fit", f"""WITH {STREAMS}, {MOMENTS}, {_fit_ctes()},
logs AS (SELECT x.session, f.beta, x.dim, x.t, any_value(CASE x.dim WHEN 0 THEN mu_0 ELSE mu_1 END)
    + coalesce(sum(CASE WHEN x.dim = 0 THEN CASE y.dim WHEN 0 THEN a00 ELSE a01 END ELSE CASE y.dim WHEN 0 THEN a10 ELSE a11 END END
      * f.beta * exp(-f.beta * (x.t - y.t))), 0) AS rate
  FROM ev x JOIN fit f ON f.session = x.session LEFT JOIN ev y ON y.session = x.session AND y.t < x.t GROUP BY x.session, f.beta, x.dim, x.t),
scored AS (SELECT fit.*, m.horizon, m.n0, m.n1, sum(ln(greatest(rate, 1e-300))) - any_value(mu_0 * horizon + mu_1 * horizon
    + (a00 + a10) * int_0 + (a01 + a11) * int_1) AS score
  FROM fit JOIN m USING (session, beta) JOIN logs USING (session, beta) GROUP BY ALL)
SELECT session, {num('beta', 'beta')}, {num('horizon', 'horizon')}, n0, n1, {', '.join(_FITTED)}, {num('endogeneity', 'endogeneity')},
  {num('score', 'score')}, {num('ln(2) / beta', 'half_life')} FROM scored
QUALIFY row_number() OVER (PARTITION BY session ORDER BY score DESC, beta) = 1""")
def _fit(spark, root):
    fit = hawkes.fit_grid(stream_rows(spark, root), ["session"], BETAS)
    rates = [(F.col(f"mu_{i}") * 1e6).alias(f"mu_{i}_e6") for i in (0, 1)]
    return fit.select("session", "beta", "horizon", "n0", "n1", *rates, *[f"alpha_{i}_{j}" for i in (0, 1) for j in (0, 1)],
                      "endogeneity", "score", "half_life")


_WINDOWS = f"""x AS (SELECT session, min(t_us) AS a, max(t_us) AS z FROM streams GROUP BY session),
w AS (SELECT session, k AS win, a + k * {STEP}000000 AS s, a + k * {STEP}000000 + {SIZE}000000 AS e
  FROM (SELECT session, a, z, unnest(range(CAST((z - a - {SIZE}000000) // {STEP}000000 + 1 AS BIGINT))) AS k
        FROM x WHERE z - a >= {SIZE}000000)),
inside AS (SELECT w.*, dim, (t_us - s) / 1e6 AS t FROM w JOIN streams t ON t.session = w.session AND t_us >= s AND t_us < e),
busy AS (SELECT session, win, s, e, count(*) FILTER (dim = 0) AS news_count, count(*) FILTER (dim = 1) AS price_count FROM inside GROUP BY ALL
  HAVING count(*) FILTER (dim = 0) > 2 AND count(*) FILTER (dim = 1) > 5)"""


@register("hawkes_rolling_fit", f"""WITH {STREAMS}, {_WINDOWS},
{_moment_ctes('SELECT session, win, dim, t FROM inside JOIN busy USING (session, win)',
              f'SELECT session, win, {SIZE}.0::DOUBLE AS big_t FROM busy', [0.001], 'session, win')}, {_fit_ctes('session, win')}
SELECT session, win, {num('s / 1e6', 'window_start')}, {num('e / 1e6', 'window_end')}, news_count, price_count,
  {num('1e6 * mu_0', 'baseline_news_e6')}, {num('1e6 * mu_1', 'baseline_price_e6')}, {num('a10', 'alpha_news_to_price')},
  {num('a11', 'alpha_price_to_price')}, {num('endogeneity', 'endogeneity')} FROM fit JOIN busy USING (session, win)""")
def _rolling(spark, root):
    fit = hawkes.rolling_fit(stream_rows(spark, root), SIZE, STEP, 0.001, min_price=5)
    for name in ("baseline_news", "baseline_price"):
        fit = fit.withColumn(f"{name}_e6", F.col(name) * 1e6).drop(name)
    return fit


def residuals(spark, root):
    events = stream_rows(spark, root)
    parameters = events.select("session").distinct().withColumns({
        "beta": F.lit(0.001), "mu_1": F.lit(0.0002), "alpha_1_0": F.lit(0.3), "alpha_1_1": F.lit(0.2)})
    return hawkes.compensator(events, parameters, ["session"])


# Integral over each gap, summed over every earlier event one by one.
RESIDUALS = STREAMS + """, own AS (SELECT session, t_us, t_us / 1e6 AS b,
    lag(t_us) OVER (PARTITION BY session ORDER BY t_us) / 1e6 AS a FROM streams WHERE dim = 1),
res AS (SELECT o.session, o.t_us, 0.0002 * (any_value(b) - any_value(a)) + coalesce(sum(
    CASE e.dim WHEN 0 THEN 0.3 ELSE 0.2 END
    * (exp(-0.001 * (greatest(a, e.t_us / 1e6) - e.t_us / 1e6)) - exp(-0.001 * (b - e.t_us / 1e6)))), 0) AS residual
  FROM own o LEFT JOIN streams e ON e.session = o.session AND e.t_us / 1e6 < b
  WHERE a IS NOT NULL GROUP BY o.session, o.t_us)"""


@register("compensator_residuals", f"""WITH {RESIDUALS}
SELECT session, t_us, {num('residual', 'residual')} FROM res""")
def _residuals(spark, root):
    return residuals(spark, root)


RANKED = RESIDUALS + """, ranked AS (SELECT session, residual, 1 - exp(-greatest(residual, 0)) AS f,
    row_number() OVER (PARTITION BY session ORDER BY residual, t_us) AS i,
    count(*) OVER (PARTITION BY session) AS n FROM res)"""


@register("ks_exp1", f"""WITH {RANKED}, k AS (SELECT session, max(greatest(i / n::DOUBLE - f, f - (i - 1) / n::DOUBLE)) AS ks,
    max(n) AS n FROM ranked GROUP BY session), x AS (SELECT *, sqrt(n) * ks AS x FROM k),
p AS (SELECT *, CASE WHEN x < 0.6 THEN 1 - sqrt(2 * pi()) / x * list_sum(list_transform(range(1, 8),
      lambda j: exp(-((2 * j - 1) ** 2) * pi() ** 2 / (8 * x * x))))
    ELSE list_sum(list_transform(range(1, 40), lambda j: CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * j * j * x * x))) END AS p FROM x)
SELECT session, {num('ks', 'ks')}, n, {num('least(1, greatest(0, p))', 'p_value')}, p > 0.05 AS exponential FROM p""")
def _ks(spark, root):
    return hawkes.ks_exponential(cut_lineage(residuals(spark, root)), ["session"])


@register("qq_exp1", f"""WITH {RANKED} SELECT session, i, {num('residual', 'sample')},
  {num('-ln(1 - CASE WHEN i = n THEN 0.5 ** (1.0 / n) WHEN i = 1 THEN 1 - 0.5 ** (1.0 / n) ELSE (i - 0.3175) / (n + 0.365) END)', 'theoretical')}
FROM ranked""")
def _qq(spark, root):
    return hawkes.qq_exponential(cut_lineage(residuals(spark, root)), ["session"])


# The test events lie within one month.
POINTS, END = 500, 2_678_400.0


@register("impulse_intensity", f"""WITH {STREAMS}, g AS (SELECT session, k AS grid,
    round(k * ({END} / {POINTS - 1}) * 1e6) AS us FROM (SELECT DISTINCT session FROM streams) s
    CROSS JOIN range({POINTS}) r(k))
SELECT g.session, grid, {num('us / 1e6', 't')},
  {num('0.0002 + 0.3 * 0.001 * coalesce(sum(exp(-0.001 * (us - t_us) / 1e6)), 0)', 'intensity')}
FROM g LEFT JOIN streams e ON e.session = g.session AND e.dim = 0 AND e.t_us <= us
  AND e.t_us <= {END} * 1e6 GROUP BY g.session, grid, us""")
def _impulse(spark, root):
    return hawkes.impulse_intensity(stream_rows(spark, root), 0.0002, 0.3, 0.001, 0.0, END, POINTS)


@register("manifest_drift", """WITH e AS (SELECT CAST(page_id AS VARCHAR) AS path, sha256(html) AS expected
  FROM pages),
a AS (SELECT CASE WHEN page_id % 23 = 5 THEN 'moved-' ELSE '' END || page_id AS path,
    sha256(CASE WHEN page_id % 50 = 7 THEN html || '<!-- edited -->' ELSE html END) AS actual
  FROM pages)
SELECT path, expected, actual, CASE WHEN expected IS NULL THEN 'added' WHEN actual IS NULL THEN 'removed'
  ELSE 'changed' END AS status FROM e FULL JOIN a USING (path) WHERE expected IS DISTINCT FROM actual""")
def _drift(spark, root):
    # Some pages are moved and some edited, so that all three kinds of drift occur.
    pages = views.table(spark, root, "pages")
    i = F.col("page_id")
    edited = F.when(i % 50 == 7, F.concat("html", F.lit("<!-- edited -->"))).otherwise(F.col("html"))
    moved = F.concat(F.when(i % 23 == 5, "moved-").otherwise(""), i.cast("string"))
    frozen = manifest.content_manifest(pages, "page_id", "html")
    now = manifest.content_manifest(pages.withColumn("html", edited).withColumn("page_id", moved), "page_id", "html")
    return manifest.drift(frozen, now)
