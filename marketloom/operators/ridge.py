"""Ridge regression from one pass of pairwise moments.

Missing features count as their mean (zero after standardising), scaling uses every row, the fit
only rows with a target. All sums needed for that are additive, so one aggregation serves the
fit, sub-models and correlations; only p×p numbers reach the driver. Walk-forward folds merge
moments that are centred in themselves, block by block.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage


def moment_columns(features: Sequence[str], target: str) -> list[Column]:
    """Aggregates over all rows (n_, s_, q_) and over labelled rows (pairs, target)."""
    y = F.col(target)
    out = [F.count(y).alias("ny"), F.sum(y).alias("sy"), F.sum(y * y).alias("qy")]
    for i, a in enumerate(features):
        x = F.col(a)
        seen = F.when(y.isNotNull(), x)
        out += [F.count(x).alias(f"n_{i}"), F.sum(x).alias(f"s_{i}"), F.sum(x * x).alias(f"q_{i}"),
                F.sum(seen * y).alias(f"xy_{i}"), F.sum(F.when(x.isNotNull(), y)).alias(f"y_{i}")]
        for j in range(i, len(features)):
            z = F.col(features[j])
            both = seen.isNotNull() & z.isNotNull()
            out += [F.count_if(both).alias(f"c_{i}_{j}"),
                    F.sum(F.when(both, x)).alias(f"a_{i}_{j}"),
                    F.sum(F.when(both, z)).alias(f"b_{i}_{j}"),
                    F.sum(F.when(both, x * z)).alias(f"p_{i}_{j}")]
    return out


def ridge_moments(rows: DataFrame, features: Sequence[str], target: str,
                  by: Sequence[str] = ()) -> DataFrame:
    """One row of moments per group (one in all without ``by``)."""
    return rows.groupBy(*by).agg(*moment_columns(features, target))


@dataclass(frozen=True)
class Moments:
    """Collected sums."""

    n: np.ndarray
    s: np.ndarray
    q: np.ndarray
    xy: np.ndarray
    y: np.ndarray
    c: np.ndarray
    a: np.ndarray
    p: np.ndarray
    ny: float
    sy: float
    qy: float

    @staticmethod
    def of(row, size: int) -> Moments:
        get = lambda k: float(row[k] or 0.0)
        vec = lambda k: np.array([get(f"{k}_{i}") for i in range(size)])
        c, a, p = (np.zeros((size, size)) for _ in range(3))
        for i in range(size):
            for j in range(i, size):
                c[i, j] = c[j, i] = get(f"c_{i}_{j}")
                p[i, j] = p[j, i] = get(f"p_{i}_{j}")
                # a[i, j]: sum of feature i where feature j is present too
                a[i, j], a[j, i] = get(f"a_{i}_{j}"), get(f"b_{i}_{j}")
        return Moments(vec("n"), vec("s"), vec("q"), vec("xy"), vec("y"), c, a, p,
                       get("ny"), get("sy"), get("qy"))

    def scaling(self, offset: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Mean and population deviation per feature; a zero deviation becomes 1.

        ``offset`` is what was taken off the columns before: its rounding is no spread.
        """
        n = np.where(self.n == 0, 1.0, self.n)
        mean = self.s / n
        variance = np.maximum(self.q / n - mean**2, 0.0)
        # Cancellation noise of a constant column must not pass for spread.
        variance[variance <= np.maximum(1e-14 * mean**2, (1e-13 * np.abs(offset)) ** 2)] = 0.0
        scale = np.sqrt(variance)
        return mean, np.where(scale == 0, 1.0, scale)

    def normal(self, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gram matrix and target vector of the labelled rows after the given scaling."""
        gram = (self.p - mean[:, None] * self.a.T - self.a * mean[None, :]
                + self.c * np.outer(mean, mean)) / np.outer(scale, scale)
        return gram, (self.xy - mean * self.y) / scale


@dataclass(frozen=True)
class RidgeModel:
    features: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray
    intercept: float

    def standardized(self) -> list[Column]:
        return [F.coalesce((F.col(f) - float(m)) / float(s), F.lit(0.0))
                for f, m, s in zip(self.features, self.mean, self.scale)]

    def prediction(self) -> Column:
        total = F.lit(float(self.intercept))
        for z, c in zip(self.standardized(), self.coef):
            total = total + z * float(c)
        return total

    def predict(self, rows: DataFrame, out: str = "expected_return") -> DataFrame:
        return rows.withColumn(out, self.prediction())

    def explain(self, rows: DataFrame, top_n: int | None = None) -> DataFrame:
        """Prediction, intercept and (feature, contribution) list, largest magnitude first."""
        parts = F.array_sort(F.array(*[
            F.struct((-F.abs(z * float(c))).alias("size"), F.lit(f).alias("feature"),
                     (z * float(c)).alias("contribution"))
            for f, z, c in zip(self.features, self.standardized(), self.coef)]))
        parts = F.transform(parts, lambda p: F.struct(p["feature"].alias("feature"),
                                                      p["contribution"].alias("contribution")))
        if top_n:
            parts = F.slice(parts, 1, top_n)
        return self.predict(rows).withColumns(
            {"intercept": F.lit(float(self.intercept)), "contributions": parts})

    def coefficients(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(f, float(m), float(s), float(c)) for f, m, s, c in
             zip(self.features, self.mean, self.scale, self.coef)],
            "feature string, mean double, scale double, coef double")


def solve(moments: Moments, features: Sequence[str], alpha: float,
          offset: np.ndarray | float = 0.0) -> RidgeModel:
    """``offset``: what was taken off the features before the moments were summed."""
    if alpha < 0:
        raise ValueError("alpha must not be negative")
    mean, scale = moments.scaling(offset)
    gram, vector = moments.normal(mean, scale)
    coef = np.linalg.solve(gram + alpha * np.eye(len(features)), vector)
    intercept = moments.sy / moments.ny if moments.ny else 0.0
    return RidgeModel(tuple(features), mean + offset, scale, coef, intercept)


def centred(rows: DataFrame, features: Sequence[str]) -> tuple[DataFrame, np.ndarray]:
    """Rows with the means taken off the features, and the means: products of what is left do not cancel."""
    means = rows.agg(*[F.avg(f).alias(f) for f in features]).first()
    offset = np.array([float(means[f] or 0.0) for f in features])
    return rows.withColumns({f: F.col(f) - float(m) for f, m in zip(features, offset)}), offset


def fit(rows: DataFrame, features: Sequence[str], target: str, alpha: float = 1.0) -> RidgeModel:
    """Two aggregations over the rows (means, then centred products), one p×p solve on the driver."""
    if alpha < 0:
        raise ValueError("alpha must not be negative")
    rows, offset = centred(rows, features)
    row = ridge_moments(rows, features, target).first()
    return solve(Moments.of(row, len(features)), features, alpha, offset)


def subset(moments: Moments, keep: Sequence[int]) -> Moments:
    """Moments of a sub-model, cut out of the full ones."""
    k = list(keep)
    grid = np.ix_(k, k)
    return Moments(moments.n[k], moments.s[k], moments.q[k], moments.xy[k], moments.y[k],
                   moments.c[grid], moments.a[grid], moments.p[grid],
                   moments.ny, moments.sy, moments.qy)


def squared_error(model: RidgeModel, moments: Moments) -> float:
    """Sum of squared residuals of ``model`` on the rows behind ``moments``."""
    gram, vector = moments.normal(model.mean, model.scale)
    z_sum = (np.diag(moments.a) - model.mean * np.diag(moments.c)) / model.scale
    b, w = model.intercept, model.coef
    return float(moments.qy - 2 * (b * moments.sy + w @ vector)
                 + b * b * moments.ny + 2 * b * (w @ z_sum) + w @ gram @ w)


def ablation(rows: DataFrame, feature_sets: dict[str, Sequence[str]], target: str,
             alpha: float = 1.0) -> DataFrame:
    """In-sample R² of one model per named feature set, all from the same moments."""
    features = sorted({f for fs in feature_sets.values() for f in fs})
    rows, _ = centred(rows, features)
    full = Moments.of(ridge_moments(rows, features, target).first(), len(features))
    total = full.qy - full.sy**2 / full.ny
    out = []
    for name, chosen in feature_sets.items():
        part = subset(full, [features.index(f) for f in chosen])
        model = solve(part, list(chosen), alpha)
        out.append((name, len(chosen), float(1 - squared_error(model, part) / total)))
    return rows.sparkSession.createDataFrame(out, "model string, n_features int, r2 double")


def signal_correlations(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Pairwise-complete correlations, one row per feature pair, one aggregation."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    one = rows.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("left_feature"), F.lit(b).alias("right_feature"),
                 F.col(f"r{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)]))
        .alias("_r")).select("_r.*")


# ---------------------------------------------------- mergeable moments

# Numbers in a table of fitted folds up to which it is broadcast; a larger one is joined by shuffle.
BROADCAST_NUMBERS = 1_000_000
State = tuple[float, float, float, float]
EMPTY: State = (0.0, 0.0, 0.0, 0.0)


def pair_moments(rows: DataFrame, features: Sequence[str], target: str, by: Sequence[str]) -> DataFrame:
    """``by, i, j, n, mean_i, mean_j, product``: one row per group and pair of variables.

    Variables are the features and, as the last, the target. A state holds the rows where both are
    present and the target is known: their number, the two means and the sum of products about
    those means. ``j = -1`` is feature i alone over all rows. One pass; Spark's own centred
    aggregates do not cancel, whatever offset or drift a column has.
    """
    names = [*features, target]
    known = F.col(target).isNotNull()

    def state(i: int, j: int, x: Column, z: Column) -> Column:
        both = x.isNotNull() & z.isNotNull()
        n = F.count_if(both)
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        return F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), n.cast("double").alias("n"),
                        zero(F.avg(F.when(both, x))).alias("mean_i"), zero(F.avg(F.when(both, z))).alias("mean_j"),
                        zero(F.covar_pop(x, z) * n).alias("product"))

    states = [state(i, -1, F.col(f), F.col(f)) for i, f in enumerate(features)]
    seen = [F.when(known, F.col(c)) for c in names]
    states += [state(i, j, seen[i], seen[j]) for i in range(len(names)) for j in range(i, len(names))]
    return rows.groupBy(*by).agg(F.array(*states).alias("_s")).select(*by, F.explode("_s").alias("_m")).select(*by, "_m.*")


def merge(a: State, b: State) -> State:
    """State of the union of two sets of rows (parallel variance rule)."""
    n = a[0] + b[0]
    if not a[0] or not b[0]:
        return a if a[0] else b
    di, dj, share = b[1] - a[1], b[2] - a[2], b[0] / n
    return n, a[1] + di * share, a[2] + dj * share, a[3] + b[3] + di * dj * a[0] * share


def prefix_merges(states: Sequence[State]) -> list[State]:
    """Merge of all states before each place, and of all of them at the end."""
    out = [EMPTY]
    for s in states:
        out.append(merge(out[-1], s))
    return out


def window_merges(states: Sequence[State], width: int) -> list[State]:
    """Merge of each ``width`` neighbouring states: the end of one run of ``width`` with the start of the next.

    Nothing is ever taken off a sum, so a state far away in value leaves no rounding behind.
    """
    if width == 0:
        return [EMPTY] * (len(states) + 1)
    ends: list[State] = []
    starts: list[State] = []
    for a in range(0, len(states), width):
        run = list(states[a:a + width])
        starts += prefix_merges(run)[1:]
        back = [EMPTY]
        for s in reversed(run):
            back.append(merge(s, back[-1]))
        ends += back[:0:-1]
    return [merge(ends[a], starts[a + width - 1]) if a % width else ends[a] for a in range(len(states) - width + 1)]


# ----------------------------------------------------------- walk-forward

def with_blocks(rows: DataFrame, block_bars: int, embargo: int) -> DataFrame:
    """Block number, and whether the row lies in the last ``embargo`` bars of its block."""
    within = F.col("bar_no") % block_bars
    return rows.withColumns({"block": F.floor(F.col("bar_no") / block_bars),
                             "tail": within >= block_bars - embargo})


def fold_states(moments: DataFrame, expanding: bool = True, train_blocks: int = 2) -> DataFrame:
    """States of the training and the validation rows of every fold, one row per fold and pair.

    ``moments``: those of (block, tail). Pairs are scanned side by side, each over its blocks only: one
    state per block, however many rows a block has. Training ends before the embargoed tail of
    its last block, validation before that of its own.
    """
    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = sorted(set(pdf["block"]))
        parts = {(b, t): tuple(s) for b, t, *s in zip(
            pdf["block"], pdf["tail"], pdf["n"], pdf["mean_i"], pdf["mean_j"], pdf["product"])}
        head = [parts.get((b, False), EMPTY) for b in blocks]
        whole = [merge(h, parts.get((b, True), EMPTY)) for b, h in zip(blocks, head)]
        before = prefix_merges(whole) if expanding else window_merges(whole, train_blocks - 1)
        out = []
        for k in range(train_blocks, len(blocks) - 1):
            # Whole blocks up to the last but one; of the last, what lies before its tail.
            known = before[k - 1] if expanding else before[k - train_blocks]
            for role, s in (("train", merge(known, head[k - 1])), ("check", head[k])):
                out.append((k - train_blocks, int(blocks[k + 1]), k if expanding else train_blocks, role,
                            int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0]), *s))
        return pd.DataFrame(out, columns=["fold", "block", "n_train_blocks", "role", "i", "j", "n", "mean_i", "mean_j", "product"])

    return moments.groupBy("i", "j").applyInPandas(
        scan, "fold int, block long, n_train_blocks int, role string, i int, j int, n double, mean_i double, mean_j double, product double")


class Pairs:
    """All states of one set of rows as matrices; the target is the last variable."""

    def __init__(self, pdf: pd.DataFrame, size: int):
        self.alone = np.zeros((3, size))
        self.n, self.mean, self.product = (np.zeros((size + 1, size + 1)) for _ in range(3))
        for i, j, n, mi, mj, c in zip(pdf["i"], pdf["j"], pdf["n"], pdf["mean_i"], pdf["mean_j"], pdf["product"]):
            if j < 0:
                self.alone[:, i] = n, mi, c
            else:
                # mean[i, j]: mean of i where j is present too
                self.n[i, j] = self.n[j, i] = n
                self.product[i, j] = self.product[j, i] = c
                self.mean[i, j], self.mean[j, i] = mi, mj

    def scaling(self, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and population deviation per feature over all rows; a zero deviation becomes 1."""
        n, mean, product = self.alone
        variance = product / np.where(n == 0, 1.0, n)
        # Rounding of a constant column must not pass for spread.
        variance[variance <= (1e-13 * np.maximum(np.abs(mean), np.abs(offset))) ** 2] = 0.0
        scale = np.sqrt(variance)
        return mean, np.where(scale == 0, 1.0, scale)

    def about(self, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """Sums of products of all pairs of (variable - centre) / scale."""
        off = self.mean - centre[:, None]
        return (self.product + self.n * off * off.T) / np.outer(scale, scale)

    def target(self) -> tuple[float, float]:
        return float(self.n[-1, -1]), float(self.mean[-1, -1])


FOLD_SCHEMA = ("fold int, block long, n_train_blocks int, alpha double, validation_mse double, "
               "intercept double, mean array<double>, centred array<double>, scale array<double>, coef array<double>")


def fit_folds(states: DataFrame, size: int, alphas: Sequence[float], offset: Sequence[float]) -> DataFrame:
    """One row per fold: the model of the ``alpha`` with the least squared error on the validation rows.

    ``offset``: what was taken off features and target before the moments, in that order. Of equal
    errors the alpha named first wins.
    """
    if min(alphas) < 0:
        raise ValueError("alpha must not be negative")
    offset = np.asarray(offset, dtype=float)
    alphas = [float(a) for a in alphas]

    def solve_fold(pdf: pd.DataFrame) -> pd.DataFrame:
        train, check = (Pairs(pdf[pdf["role"] == role], size) for role in ("train", "check"))
        mean, scale = train.scaling(offset[:-1])
        n, intercept = train.target()
        one = np.ones(1)
        # The target stays as it is: only features are centred in the normal equations.
        sums = train.about(np.append(mean, -offset[-1]), np.append(scale, one))
        errors = check.about(np.append(mean, intercept if n else -offset[-1]), np.append(scale, one))
        best = None
        for alpha in alphas:
            coef = np.linalg.solve(sums[:-1, :-1] + alpha * np.eye(size), sums[:-1, -1])
            error = errors[-1, -1] - 2 * coef @ errors[:-1, -1] + coef @ errors[:-1, :-1] @ coef
            if best is None or error < best[1]:
                best = alpha, error, coef
        alpha, error, coef = best
        first = pdf.iloc[0]
        return pd.DataFrame([{
            "fold": first["fold"], "block": first["block"], "n_train_blocks": first["n_train_blocks"], "alpha": alpha,
            "validation_mse": error / max(check.target()[0], 1.0), "intercept": intercept + offset[-1] if n else 0.0,
            "mean": mean + offset[:-1], "centred": mean, "scale": scale, "coef": coef}])

    return states.groupBy("fold").applyInPandas(solve_fold, FOLD_SCHEMA)


def walk_forward(rows: DataFrame, features: Sequence[str], target: str, block_bars: int,
                 embargo: int, alphas: Sequence[float] = (1.0,), expanding: bool = True,
                 train_blocks: int = 2) -> tuple[DataFrame, DataFrame]:
    """(test predictions, fold table). ``alpha`` is chosen on the validation block.

    The rows are written once and read three times: for the centre, for the moments per (block,
    tail), and for the predictions. Everything between works on one state per block and pair of
    variables, scanned pair by pair and solved fold by fold in tasks; nothing but the centre, a
    number per variable, comes to the driver.
    """
    marked = cut_lineage(with_blocks(rows, block_bars, embargo))
    names = [*features, target]
    centre = marked.agg(*[F.avg(c) for c in names]).first()
    offset = [float(c or 0.0) for c in centre]
    moved = marked.select("block", "tail", *[(F.col(c) - m).alias(c) for c, m in zip(names, offset)])
    states = fold_states(pair_moments(moved, features, target, ["block", "tail"]), expanding, train_blocks)
    folds = cut_lineage(fit_folds(states, len(features), alphas, offset))
    small = folds.count() * (3 * len(features) + 4) <= BROADCAST_NUMBERS
    tested = marked.join(F.broadcast(folds) if small else folds, "block")
    score = F.col("intercept")
    for i, f in enumerate(features):
        # The offset goes first: the mean of a column far from zero has lost digits.
        z = (F.col(f) - offset[i] - F.col("centred")[i]) / F.col("scale")[i]
        score = score + F.coalesce(z, F.lit(0.0)) * F.col("coef")[i]
    predictions = tested.withColumn("prediction", score).drop("mean", "centred", "scale", "coef", "intercept")
    return predictions, folds.drop("centred")


def fold_scores(predictions: DataFrame, target: str) -> DataFrame:
    """Per fold: rows, error, correlation and sign agreement on the test block."""
    y, p = F.col(target), F.col("prediction")
    return (predictions.filter(y.isNotNull()).groupBy("fold")
            .agg(F.count("*").alias("n"), F.avg((y - p) ** 2).alias("mse"),
                 F.corr(y, p).alias("ic"),
                 F.avg((F.signum(y) == F.signum(p)).cast("double")).alias("hit_rate")))


def calibration(predictions: DataFrame, target: str, bins: Sequence[float]) -> DataFrame:
    """Mean prediction against mean outcome by prediction bin (edges given)."""
    bucket = F.size(F.filter(F.array(*[F.lit(float(b)) for b in bins]),
                             lambda edge: edge <= F.col("prediction")))
    return (predictions.filter(F.col(target).isNotNull()).groupBy(bucket.alias("bin"))
            .agg(F.count("*").alias("n"), F.avg("prediction").alias("predicted"),
                 F.avg(target).alias("realized")))


@dataclass(frozen=True)
class LogisticModel:
    features: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray
    intercept: float
    steps: int

    def probability(self) -> Column:
        total = F.lit(float(self.intercept))
        for f, m, s, c in zip(self.features, self.mean, self.scale, self.coef):
            total = total + F.coalesce((F.col(f) - float(m)) / float(s), F.lit(0.0)) * float(c)
        return 1 / (1 + F.exp(-total))

    def score(self, rows: DataFrame, out: str = "p_up") -> DataFrame:
        return rows.withColumn(out, self.probability())


def fit_logistic(rows: DataFrame, features: Sequence[str], target: str, alpha: float = 0.0,
                 max_steps: int = 100, tolerance: float = 1e-10) -> LogisticModel:
    """Probability that the target is above zero: logistic regression on standardised features.

    Minimises the mean log-loss plus alpha / 2 times the squared coefficients (the intercept goes
    free) by Newton steps. A step needs the Gram matrix of the rows weighted by p(1 - p) and the
    score sums, which is one aggregation of (p + 1)^2 / 2 numbers; a step that does not lower the
    loss is halved. Standardised rows are written once. Raises an error if there is no convergence
    (separable classes without penalty).
    """
    if alpha < 0:
        raise ValueError("alpha must not be negative")
    stats = rows.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(features)
                       for k, f in (("m", F.avg), ("d", F.stddev_pop))]).first()
    mean = np.array([float(stats[f"m{i}"] or 0.0) for i in range(len(features))])
    scale = np.array([float(stats[f"d{i}"] or 1.0) for i in range(len(features))])
    z = [F.coalesce((F.col(f) - float(m)) / float(s), F.lit(0.0)) for f, m, s in zip(features, mean, scale)]
    up = (F.col(target) > 0).cast("double")
    slim = cut_lineage(rows.filter(F.col(target).isNotNull()).select(*[c.alias(f"_z{i + 1}") for i, c in enumerate(z)], up.alias("_up")))
    size = len(features) + 1
    columns = [F.lit(1.0)] + [F.col(f"_z{i}") for i in range(1, size)]
    penalty = alpha * np.diag([0.0] + [1.0] * (size - 1))

    def moments(beta: np.ndarray):
        """Loss, slope and curvature at ``beta``, per row."""
        eta = F.lit(float(beta[0]))
        for c, b in zip(columns[1:], beta[1:]):
            eta = eta + c * float(b)
        p = 1 / (1 + F.exp(-eta))
        # log(1 + e^eta) without overflow.
        loss = F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta))) - F.col("_up") * eta
        weight = p * (1 - p)
        row = slim.agg(F.count("*").alias("n"), F.sum(loss).alias("loss"),
                       *[F.sum((p - F.col("_up")) * c).alias(f"s{i}") for i, c in enumerate(columns)],
                       *[F.sum(weight * columns[i] * columns[j]).alias(f"g{i}_{j}") for i in range(size) for j in range(i, size)]).first()
        n = max(row["n"], 1)
        gram = np.zeros((size, size))
        for i in range(size):
            for j in range(i, size):
                gram[i, j] = gram[j, i] = (row[f"g{i}_{j}"] or 0.0) / n
        slope = np.array([(row[f"s{i}"] or 0.0) / n for i in range(size)]) + penalty @ beta
        return (row["loss"] or 0.0) / n + 0.5 * beta @ penalty @ beta, slope, gram + penalty

    beta = np.zeros(size)
    loss, slope, curve = moments(beta)
    for step in range(1, max_steps + 1):
        move = np.linalg.lstsq(curve, -slope, rcond=None)[0]
        if np.max(np.abs(move)) <= tolerance * max(1.0, np.max(np.abs(beta))):
            return LogisticModel(tuple(features), mean, scale, beta[1:], float(beta[0]), step)
        factor = 1.0
        while True:
            new = moments(beta + factor * move)
            # Near the minimum the loss no longer tells steps apart.
            if new[0] <= loss + 1e-12 * max(1.0, abs(loss)) or factor < 1e-6:
                break
            factor /= 2
        beta, (loss, slope, curve) = beta + factor * move, new
    raise ArithmeticError(f"no convergence after {max_steps} steps: classes may be separable; use alpha > 0")
