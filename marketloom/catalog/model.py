"""Ridge, explanation, ablation and walk-forward queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ridge, signals
from ..plans import views
from .base import GRID, num, register, when
from .signals import MOMENTUM, REVERSION, VOLUME

X1, X2, Y = "momentum_roc20", "mr_zscore20", "forward_return"
PAIR = [X1, X2]


def training_rows(spark, root):
    return signals.feature_table(views.bars(spark, root), views.BENCHMARK, label_bars=1)


XY = f"""{GRID}, xy AS (SELECT * FROM (
  SELECT symbol, ts, price, dense_rank() OVER (ORDER BY ts) AS bar_no, {MOMENTUM[X1]} AS x1,
    {REVERSION[X2]} AS x2, {VOLUME['volume_z20']} AS x3,
    lead(price) OVER (PARTITION BY symbol ORDER BY ts) / price - 1 AS y FROM grid)
  WHERE price IS NOT NULL)"""

# Standardised features and the closed form of the two-feature fit with alpha = 1.
FIT = f"""{XY}, st AS (SELECT avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2 FROM xy),
z AS (SELECT xy.*, coalesce((x1 - m1) / s1, 0) AS z1, coalesce((x2 - m2) / s2, 0) AS z2 FROM xy, st),
g AS (SELECT sum(z1 * z1) + 1 AS a, sum(z1 * z2) AS b, sum(z2 * z2) + 1 AS d, sum(z1 * y) AS u,
        sum(z2 * y) AS v, avg(y) AS c0 FROM z WHERE y IS NOT NULL),
w AS (SELECT (d * u - b * v) / (a * d - b * b) AS w1, (a * v - b * u) / (a * d - b * b) AS w2,
        u / a AS o1, v / d AS o2, c0 FROM g)"""


def _moment_sql() -> str:
    out = ["count(y) AS ny", num("sum(y)", "sy"), num("sum(y * y)", "qy")]
    names = ["x1", "x2"]
    for i, x in enumerate(names):
        out += [f"count({x}) AS n_{i}", num(f"sum({x})", f"s_{i}"), num(f"sum({x} * {x})", f"q_{i}"),
                num(f"sum({x} * y)", f"xy_{i}"), num(f"sum(y) FILTER ({x} IS NOT NULL)", f"y_{i}")]
        for j in range(i, 2):
            both = f"y IS NOT NULL AND {x} IS NOT NULL AND {names[j]} IS NOT NULL"
            out += [f"count(*) FILTER ({both}) AS c_{i}_{j}",
                    num(f"sum({x}) FILTER ({both})", f"a_{i}_{j}"),
                    num(f"sum({names[j]}) FILTER ({both})", f"b_{i}_{j}"),
                    num(f"sum({x} * {names[j]}) FILTER ({both})", f"p_{i}_{j}")]
    return ", ".join(out)


@register("ridge_moments", f"WITH {XY} SELECT {_moment_sql()} FROM xy")
def _moments(spark, root):
    return ridge.ridge_moments(training_rows(spark, root), PAIR, Y)


@register("ridge_coefficients", f"""WITH {FIT} SELECT '{X1}' AS feature, {num('m1', 'mean')},
  {num('s1', 'scale')}, {num('w1', 'coef')} FROM st, w
UNION ALL SELECT '{X2}', round(m2, 6) + 0.0, round(s2, 6) + 0.0, round(w2, 6) + 0.0 FROM st, w""")
def _coefficients(spark, root):
    return ridge.fit(training_rows(spark, root), PAIR, Y).coefficients(spark)


@register("ridge_predict", f"""WITH {FIT} SELECT symbol, {when('ts', 'ts')},
  {num('c0 + z1 * w1 + z2 * w2', 'expected_return')} FROM z, w""")
def _predict(spark, root):
    rows = training_rows(spark, root)
    return ridge.fit(rows, PAIR, Y).predict(rows).select("symbol", "ts", "expected_return")


@register("explain_topn", f"""WITH {FIT}, parts AS (
  SELECT symbol, ts, '{X1}' AS feature, z1 * w1 AS c FROM z, w
  UNION ALL SELECT symbol, ts, '{X2}', z2 * w2 FROM z, w)
SELECT symbol, {when('ts', 'ts')}, feature, {num('c', 'contribution')} FROM parts
QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY abs(c) DESC, feature) = 1""")
def _explain(spark, root):
    rows = training_rows(spark, root)
    explained = ridge.fit(rows, PAIR, Y).explain(rows, top_n=1)
    return explained.select("symbol", "ts", F.explode("contributions").alias("_c")).select(
        "symbol", "ts", "_c.feature", "_c.contribution")


@register("ablation_r2", f"""WITH {FIT}, e AS (SELECT
    sum((y - c0 - z1 * o1) ** 2) AS e1, sum((y - c0 - z2 * o2) ** 2) AS e2,
    sum((y - c0 - z1 * w1 - z2 * w2) ** 2) AS e12, var_pop(y) * count(y) AS t
  FROM z, w WHERE y IS NOT NULL)
SELECT 'both' AS model, CAST(2 AS BIGINT) AS n_features, {num('1 - e12 / t', 'r2')} FROM e
UNION ALL SELECT 'momentum', 1, round(1 - e1 / t, 6) + 0.0 FROM e
UNION ALL SELECT 'reversion', 1, round(1 - e2 / t, 6) + 0.0 FROM e""")
def _ablation(spark, root):
    return ridge.ablation(training_rows(spark, root),
                          {"momentum": [X1], "reversion": [X2], "both": PAIR}, Y)


@register("signal_correlations", f"""WITH {XY}
SELECT '{X1}' AS left_feature, '{X2}' AS right_feature, {num('corr(x1, x2)', 'correlation')} FROM xy
UNION ALL SELECT '{X1}', 'volume_z20', round(corr(x1, x3), 6) + 0.0 FROM xy
UNION ALL SELECT '{X2}', 'volume_z20', round(corr(x2, x3), 6) + 0.0 FROM xy""")
def _correlations(spark, root):
    return ridge.signal_correlations(training_rows(spark, root), [X1, X2, "volume_z20"])


BLOCK, EMBARGO = 50, 5
ALPHAS = (0.01, 1.0, 100.0)
# Far off from zero: the fit of standardised features must not notice. The SQL has the plain feature,
# rounded as the offset rounds it.
OFFSET = 1e8
_TERMS = "a + alpha AS a, b, d + alpha AS d, u, v"
FOLDS = f"""{XY}, b AS (SELECT * REPLACE ((x1 + {OFFSET}) - {OFFSET} AS x1), bar_no // {BLOCK} AS block, bar_no % {BLOCK} >= {BLOCK - EMBARGO} AS tail FROM xy),
k AS (SELECT row_number() OVER (ORDER BY block) - 1 AS fold, block AS val, block + 1 AS test
      FROM (SELECT DISTINCT block FROM b) WHERE block >= 2
        AND block < (SELECT max(block) FROM b)),
tr AS (SELECT k.fold, k.val, k.test, x1, x2, y FROM k JOIN b ON b.block < k.val
         AND NOT (b.block = k.val - 1 AND tail)),
st AS (SELECT fold, val, test, avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2 FROM tr GROUP BY ALL),
zt AS (SELECT fold, y, coalesce((x1 - m1) / s1, 0) AS z1, coalesce((x2 - m2) / s2, 0) AS z2 FROM tr JOIN st USING (fold) WHERE y IS NOT NULL),
g AS (SELECT fold, sum(z1 * z1) AS a, sum(z1 * z2) AS b, sum(z2 * z2) AS d, sum(z1 * y) AS u, sum(z2 * y) AS v, avg(y) AS c0
      FROM zt GROUP BY fold),
ws AS (SELECT fold, alpha, c0, (d * u - b * v) / (a * d - b * b) AS w1, (a * v - b * u) / (a * d - b * b) AS w2
  FROM (SELECT fold, c0, alpha, {_TERMS} FROM g CROSS JOIN (SELECT unnest({list(ALPHAS)}::DOUBLE[]) AS alpha))),
cv AS (SELECT ws.*, st.* EXCLUDE (fold), avg((y - c0 - w1 * coalesce((x1 - m1) / s1, 0) - w2 * coalesce((x2 - m2) / s2, 0)) ** 2) AS mse
  FROM ws JOIN st USING (fold) JOIN b ON b.block = st.val AND NOT tail AND y IS NOT NULL GROUP BY ALL),
w AS (SELECT * FROM cv QUALIFY row_number() OVER (PARTITION BY fold ORDER BY mse) = 1),
pr AS (SELECT fold, symbol, ts, y, c0 + coalesce((x1 - m1) / s1, 0) * w1 + coalesce((x2 - m2) / s2, 0) * w2 AS p
       FROM w JOIN b ON b.block = w.test)"""


def _walk(spark, root):
    rows = training_rows(spark, root).select("symbol", "ts", "bar_no", (F.col(X1) + OFFSET).alias(X1), X2, Y)
    return ridge.walk_forward(rows, PAIR, Y, BLOCK, EMBARGO, ALPHAS)


@register("walk_forward_fits", f"""WITH {FOLDS}
SELECT fold, test AS block, val AS n_train_blocks, {num('alpha', 'alpha')}, {num('mse', 'validation_mse')}, {num('c0', 'intercept')},
  {num('m1', 'mean1')}, {num('m2', 'mean2')}, {num('s1', 'scale1')}, {num('s2', 'scale2')}, {num('w1', 'coef1')}, {num('w2', 'coef2')} FROM w""")
def _walk_fits(spark, root):
    _, folds = _walk(spark, root)
    parts = [(F.col(c)[i] - (OFFSET if c == "mean" and i == 0 else 0.0)).alias(f"{c}{i + 1}")
             for c in ("mean", "scale", "coef") for i in range(2)]
    return folds.select("fold", "block", "n_train_blocks", "alpha", "validation_mse", "intercept", *parts)


@register("walk_forward_predictions", f"""WITH {FOLDS}
SELECT fold, symbol, {when('ts', 'ts')}, {num('p', 'prediction')} FROM pr""")
def _walk_predictions(spark, root):
    predictions, _ = _walk(spark, root)
    return predictions.select("fold", "symbol", "ts", "prediction")


@register("walk_forward_folds", f"""WITH {FOLDS}
SELECT fold, count(*) AS n, {num('avg((y - p) ** 2)', 'mse')}, {num('corr(y, p)', 'ic')},
  {num('avg(CASE WHEN sign(y) = sign(p) THEN 1 ELSE 0 END)', 'hit_rate')}
FROM pr WHERE y IS NOT NULL GROUP BY fold""")
def _walk_folds(spark, root):
    predictions, _ = _walk(spark, root)
    return ridge.fold_scores(predictions, Y)


@register("calibration", f"""WITH {FOLDS}
SELECT CAST(CASE WHEN p >= 0.002 THEN 3 WHEN p >= 0 THEN 2 WHEN p >= -0.002 THEN 1 ELSE 0 END AS BIGINT) AS bin,
  count(*) AS n, {num('avg(p)', 'predicted')}, {num('avg(y)', 'realized')}
FROM pr WHERE y IS NOT NULL GROUP BY 1""")
def _calibration(spark, root):
    predictions, _ = _walk(spark, root)
    return ridge.calibration(predictions, Y, [-0.002, 0.0, 0.002])


def _newton(steps: int = 12, alpha: float = 0.001) -> str:
    """CTE nt: coefficients after k Newton steps of the penalised logistic fit with two features."""
    g = [["g00", "g01", "g02"], ["g01", f"(g11 + {alpha})", "g12"], ["g02", "g12", f"(g22 + {alpha})"]]
    right = ["s0", f"(s1 + {alpha} * b1)", f"(s2 + {alpha} * b2)"]

    def det(m):
        a, b, c = m
        return (f"({a[0]} * ({b[1]} * {c[2]} - {b[2]} * {c[1]}) - {a[1]} * ({b[0]} * {c[2]} - {b[2]} * {c[0]})"
                f" + {a[2]} * ({b[0]} * {c[1]} - {b[1]} * {c[0]}))")

    moves = [f"b{k} - {det([[right[i] if j == k else g[i][j] for j in range(3)] for i in range(3)])} / {det(g)}" for k in range(3)]
    return f"""nt(k, b0, b1, b2) AS (SELECT 0, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE UNION ALL
  SELECT k + 1, {', '.join(moves)} FROM (
    SELECT k, b0, b1, b2, avg(p - up) AS s0, avg((p - up) * z1) AS s1, avg((p - up) * z2) AS s2, avg(w) AS g00, avg(w * z1) AS g01,
      avg(w * z2) AS g02, avg(w * z1 * z1) AS g11, avg(w * z1 * z2) AS g12, avg(w * z2 * z2) AS g22
    FROM (SELECT *, p * (1 - p) AS w FROM (SELECT nt.*, z1, z2, CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END AS up,
        1 / (1 + exp(-(b0 + b1 * z1 + b2 * z2))) AS p FROM nt, z WHERE y IS NOT NULL)) GROUP BY k, b0, b1, b2) WHERE k < {steps})"""


@register("rise_probability", f"""WITH RECURSIVE {FIT}, {_newton()}
SELECT symbol, {when('ts', 'ts')}, {num('1 / (1 + exp(-(b0 + b1 * z1 + b2 * z2)))', 'p_up')} FROM z, nt
WHERE k = (SELECT max(k) FROM nt)""")
def _rise(spark, root):
    rows = training_rows(spark, root).select("symbol", "ts", *PAIR, Y)
    return ridge.fit_logistic(rows, PAIR, Y, alpha=0.001).score(rows).select("symbol", "ts", "p_up")
