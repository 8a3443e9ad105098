"""Mutually exciting point processes with exponential kernels, as DataFrame aggregations.

Intensity of dimension i:  λᵢ(t) = μᵢ + Σⱼ αᵢⱼ gⱼ(t),  gⱼ(t) = Σ_{tₖ∈j, tₖ<t} β e^{−β(t−tₖ)};
αᵢⱼ is the integral of the kernel, so the branching matrix is α itself.

The decayed sum gⱼ at every event is a windowed sum inside time spans of width SPAN/β. What lies
more than one full span back weighs below e^{−SPAN}, far under double precision, so a span needs
only its own events and the decayed total of the span directly before it; a dense span is cut
again into parts bounded in rows. A session of any size therefore splits into bounded chunks, and
fitting, residuals and likelihoods need no Python loop over events. Times are integer
microseconds since the session's first event.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import (MAX_ROWS, chunk_scan, ordinal, previous_row, running_max, running_sum, seconds_chunk,
                             split_heavy)
from ..session import cut_lineage

SPAN = 200.0
SPREAD_CHUNK = 3_600_000_000
# Decay grid of the search.
BETA_GRID = tuple(0.5 * k for k in range(1, 11))


# --------------------------------------------------------- stream building

def trading_hours(rows: DataFrame, ts: str = "ts", zone: str = "America/New_York",
                  start: str = "09:30:00", end: str = "16:00:00") -> DataFrame:
    """Rows whose market-local time of day lies in [start, end], both ends included.

    No weekday or holiday test. ``local_ts`` is the market-local wall time.
    """
    local = F.from_utc_timestamp(F.col(ts), zone)
    micros = F.pmod(F.unix_micros("local_ts"), F.lit(86_400_000_000))

    def seconds(text: str) -> int:
        h, m, s = map(int, text.split(":"))
        return (h * 3600 + m * 60 + s) * 1_000_000
    return rows.withColumn("local_ts", local).filter(micros.between(seconds(start), seconds(end)))


def price_jumps(ticks: DataFrame, keys: Sequence[str] = ("session",), order: Sequence[str] = ("ts", "event_id"),
                chunk_seconds: int = 3600) -> DataFrame:
    """Ticks whose price differs from the one before; a key's first tick is dropped."""
    seen = chunk_scan(ticks, keys, seconds_chunk("ts", chunk_seconds), order,
                      [previous_row("_b", F.col("price"))])
    return (seen.withColumn("price_change", F.col("price") - F.col("_b.v")).drop("_b")
            .filter("price_change <> 0"))


def streams(news: DataFrame, jumps: DataFrame, key: str = "session") -> DataFrame:
    """Both streams as (key, dim, t_us): microseconds since the key's first event of either.

    dim 0 is news, dim 1 is price. Times of one dimension rise strictly: each is at least one
    microsecond after the one before, which moves apart equal times and those they run into. With
    i the position and t the time, that is i + the running maximum of t - i.
    """
    both = news.select(key, F.lit(0).alias("dim"), "ts").unionByName(
        jumps.select(key, F.lit(1).alias("dim"), "ts"))
    epoch = both.groupBy(F.col(key).alias("_key")).agg(F.min(F.unix_micros("ts")).alias("_epoch"))
    timed = both.join(epoch, F.col(key).eqNullSafe(F.col("_key"))).select(key, "dim", (F.unix_micros("ts") - F.col("_epoch")).alias("_t"))
    numbered = chunk_scan(timed, [key, "dim"], F.floor(F.col("_t") / SPREAD_CHUNK), ["_t"], [ordinal("_i")])
    return chunk_scan(numbered, [key, "dim"], F.floor(F.col("_t") / SPREAD_CHUNK), ["_i"],
                      [running_max("_m", F.col("_t") - F.col("_i"))]).select(
        key, "dim", (F.col("_i") + F.col("_m")).alias("t_us"))


def interarrivals(events: DataFrame, keys: Sequence[str] = ("session", "dim"),
                  chunk_seconds: int = 3600) -> DataFrame:
    """Gap in seconds to the previous event of the same stream."""
    width = chunk_seconds * 1_000_000
    seen = chunk_scan(events, keys, F.floor(F.col("t_us") / width), ["t_us"],
                      [previous_row("_b", F.col("t_us"))])
    return (seen.withColumn("gap", (F.col("t_us") - F.col("_b.v")) / 1e6).drop("_b")
            .filter("gap IS NOT NULL"))


# --------------------------------------------------------- sliding windows

def sliding_windows(events: DataFrame, window_seconds: float, step_seconds: float,
                    key: str = "session") -> DataFrame:
    """Events repeated for every full window [start, start+size) they fall in, times re-zeroed.

    Windows start at the key's first event; the last one must end by the key's last event.
    """
    size, step = int(window_seconds * 1_000_000), int(step_seconds * 1_000_000)
    extent = events.groupBy(key).agg(F.min("t_us").alias("_first"), F.max("t_us").alias("_last"))
    offset = F.col("t_us") - F.col("_first")
    lowest = F.greatest(F.lit(0).cast("long"), F.floor((offset - size) / step) + 1)
    highest = F.least(F.floor(offset / step),
                      F.floor((F.col("_last") - F.col("_first") - size) / step))
    spread = (events.join(extent, key).withColumn("_lo", lowest).withColumn("_hi", highest)
              .filter("_hi >= _lo").withColumn("win", F.explode(F.sequence("_lo", "_hi"))))
    start = F.col("_first") + F.col("win") * step
    return spread.select(key, "win", start.alias("start_us"), (start + size).alias("end_us"), "dim",
                         (F.col("t_us") - start).alias("t_us"))


def window_counts(windowed: DataFrame, key: str = "session") -> DataFrame:
    return windowed.groupBy(key, "win", "start_us", "end_us").agg(
        F.count_if(F.col("dim") == 0).alias("news_count"),
        F.count_if(F.col("dim") == 1).alias("price_count"))


# ------------------------------------------------------------ decayed sums

def decayed_sums(events: DataFrame, keys: Sequence[str], beta: Column, dims: int = 2,
                 max_rows: int = MAX_ROWS) -> DataFrame:
    """Σ e^{−β(t−tₖ)} over strictly earlier events, per source dimension, at every event.

    ``beta`` may be a column, e.g. of a decay grid. Adds ``_t`` (seconds), ``s0``, ``s1``, … and
    ``tie0``, ``tie1``, … (events of each dimension at exactly the same time).

    Inside a span all events are scaled to the start of the span, so sums of parts of it simply
    add: a span with more than ``max_rows`` events is cut at sampled times into parts, whose totals
    are scanned and carried into each part. Events of one time stay together. The totals per span
    are written while the call is made.
    """
    keys = list(keys)
    group = [*keys, "_beta", "_c"]
    t = F.col("t_us") / 1e6
    width = SPAN / F.col("_beta")
    rows = (events.withColumn("_beta", beta).withColumn("_t", t)
            .withColumn("_c", F.floor(F.col("_t") / width))
            .withColumn("_up", F.exp(F.col("_beta") * (F.col("_t") - F.col("_c") * width))))
    of = lambda j, c: F.when(F.col("dim") == j, c)
    totals = [F.sum(of(j, F.col("_up"))).alias(f"_sum{j}") for j in range(dims)]
    spans = cut_lineage(rows.groupBy(*group).agg(*totals, F.count("*").alias("n")))
    # Decayed to the end of its span; only the directly preceding span is looked at.
    before = spans.select(*[F.col(k).alias(f"_of_{k}") for k in [*keys, "_beta"]], (F.col("_c") + 1).alias("_of__c"),
                          *[F.col(f"_sum{j}").alias(f"_before{j}") for j in range(dims)])
    parted = split_heavy(rows, group, spans, ["t_us"], max_rows, "_s", untied=False)
    part = []
    if parted is not None:
        part = ["_s"]
        rows = parted
        upto = Window.partitionBy(*group).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
        inner = rows.groupBy(*group, "_s").agg(*totals).select(
            *[F.col(c).alias(f"_in_{c}") for c in [*group, "_s"]], *[F.sum(f"_sum{j}").over(upto).alias(f"_inner{j}") for j in range(dims)])
        rows = rows.join(inner, _same([*group, "_s"], "_in_"), "left").drop(*[f"_in_{c}" for c in [*group, "_s"]])
    joined = rows.join(before, _same(group, "_of_"), "left").drop(*[f"_of_{c}" for c in group])
    inside = Window.partitionBy(*group, *part).orderBy("t_us")
    earlier = inside.rangeBetween(Window.unboundedPreceding, -1)
    same = inside.rangeBetween(0, 0)
    none = F.lit(0.0)
    columns = {}
    for j in range(dims):
        local = F.coalesce(F.sum(of(j, F.col("_up"))).over(earlier), none)
        if part:
            local = local + F.coalesce(F.col(f"_inner{j}"), none)
        carried = F.coalesce(F.col(f"_before{j}"), none) * float(np.exp(-SPAN))
        columns[f"s{j}"] = (local + carried) / F.col("_up")
        columns[f"tie{j}"] = F.count(of(j, F.lit(1))).over(same)
    helpers = [f"_{name}{j}" for j in range(dims) for name in ("before", "inner")]
    return joined.withColumns(columns).drop("_c", "_up", *part, *helpers)


def _same(columns: Sequence[str], prefix: str) -> Column:
    """Equality of columns with their prefixed namesakes; NULL equals NULL."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return out


def horizon(events: DataFrame, keys: Sequence[str], end_us: str | None = None) -> DataFrame:
    """Observation length in seconds per key: the last event, or a given end column."""
    last = F.max("t_us") if end_us is None else F.max(end_us)
    return events.groupBy(*keys).agg((last / 1e6).alias("_length"))


def hawkes_moments(events: DataFrame, keys: Sequence[str], betas: Sequence[float] = BETA_GRID,
                   lengths: DataFrame | None = None, dims: int = 2) -> DataFrame:
    """Sufficient statistics of the least-squares fit per key and decay, in one aggregation.

    For each source pair the integral of gⱼ·gₗ, for each source the integral of gⱼ, and for each
    target i the sum of gⱼ over its events.
    """
    keys = list(keys)
    lengths = horizon(events, keys) if lengths is None else lengths
    spread = events.withColumn("beta", F.explode(F.array(*[F.lit(float(b)) for b in betas])))
    sums = decayed_sums(spread, [*keys, "beta"], F.col("beta"), dims).join(lengths, keys)
    b, fade = F.col("beta"), F.exp(-F.col("beta") * (F.col("_length") - F.col("_t")))
    is_dim = lambda j: F.col("dim") == j
    agg = [F.max("_length").alias("horizon")]
    for j in range(dims):
        agg += [F.count_if(is_dim(j)).alias(f"n{j}"),
                F.sum(F.when(is_dim(j), fade)).alias(f"f{j}")]
        for i in range(dims):
            agg.append(F.sum(F.when(is_dim(i), F.col(f"s{j}") * b)).alias(f"h{i}_{j}"))
        for other in range(j, dims):
            # Σ e^{−β|tₖ−tₘ|} over ordered pairs (k in j, m in other).
            pairs = F.sum(F.when(is_dim(other), F.col(f"s{j}"))) + F.sum(
                F.when(is_dim(j), F.col(f"s{other}") + F.col(f"tie{other}")))
            agg.append(F.coalesce(pairs, F.lit(0.0)).alias(f"x{j}_{other}"))
    base = sums.groupBy(*keys, "beta").agg(*agg)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = [F.col(k) for k in [*keys, "beta", "horizon"]]
    for j in range(dims):
        out += [F.col(f"n{j}"), (F.col(f"n{j}") - zero(f"f{j}")).alias(f"int_{j}")]
        out += [zero(f"h{i}_{j}").alias(f"sum_{i}_{j}") for i in range(dims)]
        out += [(F.col("beta") / 2 * (F.col(f"x{j}_{o}") - zero(f"f{j}") * zero(f"f{o}")))
                .alias(f"gram_{j}_{o}") for o in range(j, dims)]
    return base.select(*out)


# -------------------------------------------------------------------- fit

def _determinant(m: list[list[Column]]) -> Column:
    """Determinant of a small matrix of columns, along its first row."""
    if not m:
        return F.lit(1.0)
    total = None
    for k, head in enumerate(m[0]):
        term = head * _determinant([row[:k] + row[k + 1:] for row in m[1:]])
        total = term if total is None else (total - term if k % 2 else total + term)
    return total


def nonnegative_solution(gram: list[list[Column]], right: list[Column]) -> Column:
    """Array of the w >= 0 that minimises w'Gw/2 - r'w, for a positive definite G of up to four rows.

    The minimum has some set of positive entries and solves the plain normal equations on it. So
    every set is solved by Cramer's rule on the matrix scaled to a unit diagonal, and of those
    without a negative entry the one of least value is taken: exact, without iteration. A set whose
    equations are singular is passed over.
    """
    size = len(right)
    if size > 4:
        raise ValueError("active sets are written out for at most four unknowns")
    unit = [F.sqrt(gram[k][k]) for k in range(size)]
    g = [[F.try_divide(gram[a][b], unit[a] * unit[b]) for b in range(size)] for a in range(size)]
    r = [F.try_divide(right[k], unit[k]) for k in range(size)]
    zero = F.lit(0.0)
    found = [F.struct(zero.alias("value"), F.array(*[zero] * size).alias("w"))]
    for chosen in range(1, 1 << size):
        rows = [k for k in range(size) if chosen >> k & 1]
        m = [[g[a][b] for b in rows] for a in rows]
        whole = _determinant(m)
        w = {}
        for at, k in enumerate(rows):
            swapped = [[r[a] if j == at else m[i][j] for j in range(len(rows))] for i, a in enumerate(rows)]
            w[k] = F.try_divide(_determinant(swapped), whole)
        value = sum((w[k] * r[k] for k in rows), zero)
        entries = F.array(*[F.try_divide(w[k], unit[k]) if k in w else zero for k in range(size)])
        found.append(F.struct(value.alias("value"), entries.alias("w")))
    sound = F.filter(F.array(*found), lambda c: F.forall(c["w"], lambda x: F.coalesce(x >= 0, F.lit(False))))
    return F.array_max(sound)["w"]


def hawkes_parameters(moments: DataFrame, keys: Sequence[str], dims: int = 2,
                      penalty: float = 1e-4) -> DataFrame:
    """mu_i, alpha_i_j and the spectral radius per (key, decay) from :func:`hawkes_moments`.

    Non-negative least squares per target dimension in closed form, as columns of the moment row;
    one or two dimensions. The events are not touched here.
    """
    if dims not in (1, 2):
        raise ValueError("one or two dimensions")
    size = dims + 1
    gram = [[F.col("horizon")] * size for _ in range(size)]
    for j in range(dims):
        gram[0][j + 1] = gram[j + 1][0] = F.col(f"int_{j}")
        for o in range(j, dims):
            gram[j + 1][o + 1] = gram[o + 1][j + 1] = F.col(f"gram_{j}_{o}")
    for k in range(size):
        gram[k][k] = gram[k][k] + penalty
    solved = moments
    for i in range(dims):
        right = [F.col(f"n{i}").cast("double")] + [F.col(f"sum_{i}_{j}") for j in range(dims)]
        solved = solved.withColumn(f"_w{i}", nonnegative_solution(gram, right))
    solved = solved.withColumns({f"mu_{i}": F.col(f"_w{i}")[0] for i in range(dims)} | {
        f"alpha_{i}_{j}": F.col(f"_w{i}")[j + 1] for i in range(dims) for j in range(dims)})
    if dims == 1:
        radius = F.col("alpha_0_0")
    else:
        # A non-negative matrix has its greatest eigenvalue real: that of the 2x2 formula.
        a, b, c, d = (F.col(f"alpha_{k}") for k in ("0_0", "0_1", "1_0", "1_1"))
        radius = (a + d + F.sqrt((a - d) * (a - d) + 4 * b * c)) / 2
    return solved.withColumn("endogeneity", radius).drop(*[f"_w{i}" for i in range(dims)])


def log_likelihood(events: DataFrame, parameters: DataFrame, keys: Sequence[str],
                   dims: int = 2) -> DataFrame:
    """Log-likelihood per (key, decay) of fitted parameters."""
    keys = [*keys, "beta"]
    betas = parameters.select(*keys)
    spread = events.join(betas, [k for k in keys if k != "beta"])
    sums = decayed_sums(spread, keys, F.col("beta"), dims).join(parameters, keys)
    intensity = _intensity(dims)
    terms = sums.groupBy(*keys).agg(F.sum(F.log(F.greatest(intensity, F.lit(1e-300)))).alias("_logs"))
    integral = F.lit(0.0)
    for i in range(dims):
        integral = integral + F.col(f"mu_{i}") * F.col("horizon")
        for j in range(dims):
            integral = integral + F.col(f"alpha_{i}_{j}") * F.col(f"int_{j}")
    return parameters.join(terms, keys).withColumn("score", F.col("_logs") - integral).drop("_logs")


def _intensity(dims: int) -> Column:
    own = lambda pick: F.coalesce(*[F.when(F.col("dim") == i, pick(i)) for i in range(dims)])
    total = own(lambda i: F.col(f"mu_{i}"))
    for j in range(dims):
        total = total + own(lambda i, j=j: F.col(f"alpha_{i}_{j}")) * F.col("beta") * F.col(f"s{j}")
    return total


def fit_grid(events: DataFrame, keys: Sequence[str], betas: Sequence[float] = BETA_GRID,
             dims: int = 2) -> DataFrame:
    """Best decay per key by likelihood over least-squares fits; the smaller decay wins ties."""
    # A few numbers per key and decay; kept so that the solves run once.
    fitted = cut_lineage(hawkes_parameters(hawkes_moments(events, keys, betas, dims=dims), keys, dims))
    scored = log_likelihood(events, fitted, keys, dims)
    rest = [c for c in scored.columns if c not in keys]
    best = scored.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct("score", -F.col("beta"))).alias("_b"))
    return best.select(*keys, "_b.*").withColumn("half_life", F.lit(float(np.log(2))) / F.col("beta"))


def rolling_fit(events: DataFrame, window_seconds: float, step_seconds: float, beta: float,
                key: str = "session", min_news: int = 2, min_price: int = 50) -> DataFrame:
    """Fit per sliding window with more than the minimum events; one row per window."""
    windowed = sliding_windows(events, window_seconds, step_seconds, key)
    counts = window_counts(windowed, key).filter(
        (F.col("news_count") > min_news) & (F.col("price_count") > min_price))
    kept = windowed.join(counts.select(key, "win"), [key, "win"], "left_semi")
    # The window's own length is the observation horizon.
    lengths = counts.select(key, "win", F.lit(float(window_seconds)).alias("_length"))
    fitted = hawkes_parameters(hawkes_moments(kept, [key, "win"], [beta], lengths), [key, "win"])
    return counts.join(fitted, [key, "win"]).select(
        key, "win", (F.col("start_us") / 1e6).alias("window_start"),
        (F.col("end_us") / 1e6).alias("window_end"), "news_count", "price_count",
        F.col("mu_0").alias("baseline_news"), F.col("mu_1").alias("baseline_price"),
        F.col("alpha_1_0").alias("alpha_news_to_price"),
        F.col("alpha_1_1").alias("alpha_price_to_price"), "endogeneity")


# -------------------------------------------------------------- residuals

def compensator(events: DataFrame, parameters: DataFrame, keys: Sequence[str], dim: int = 1,
                dims: int = 2, chunk_seconds: int = 3600, max_rows: int = MAX_ROWS) -> DataFrame:
    """Integrated intensity between consecutive events of ``dim``.

    With Aⱼ(t) = Σ_{tₖ∈j, tₖ≤t} e^{−β(t−tₖ)} and Nⱼ(t) the events up to t, the integral of the
    excitation of j over (a, b] is αⱼ·[Aⱼ(a) + Nⱼ(b⁻) − Nⱼ(a) − Aⱼ(b⁻)].
    parameters: one row per key with beta, mu_i, alpha_i_j.
    """
    keys = list(keys)
    slim = parameters.select(*keys, "beta", *[f"mu_{dim}"], *[f"alpha_{dim}_{j}" for j in range(dims)])
    sums = decayed_sums(events.join(slim, keys), keys, F.col("beta"), dims, max_rows)
    width = chunk_seconds * 1_000_000
    counts = chunk_scan(sums, keys, F.floor(F.col("t_us") / width), ["t_us", "dim"], [
        running_sum(f"_n{j}", F.when(F.col("dim") == j, 1).otherwise(0).cast("long"))
        for j in range(dims)], max_rows)
    # With rows ordered by (time, dim), same-time events of lower dims are already counted.
    own = counts.filter(F.col("dim") == dim)
    for j in range(dims):
        at = F.when(F.lit(j < dim), F.col(f"tie{j}")).otherwise(0)
        own = own.withColumns({
            f"_nb{j}": F.col(f"_n{j}") - (F.lit(1) if j == dim else at),
            f"_na{j}": F.col(f"_n{j}") + (F.lit(0) if j <= dim else F.col(f"tie{j}")),
            f"_aa{j}": F.col(f"s{j}") + F.col(f"tie{j}")})
    # The scan below reads these rows twice; above them lie two passes over all events.
    own = cut_lineage(own.select(*keys, "t_us", f"mu_{dim}", *[
        c for j in range(dims) for c in (f"alpha_{dim}_{j}", f"s{j}", f"_nb{j}", f"_na{j}", f"_aa{j}")]))
    state = F.struct("t_us", *[F.col(f"_na{j}") for j in range(dims)], *[F.col(f"_aa{j}") for j in range(dims)])
    seen = chunk_scan(own, keys, F.floor(F.col("t_us") / width), ["t_us"], [previous_row("_p", state)], max_rows)
    total = F.col(f"mu_{dim}") * (F.col("t_us") - F.col("_p.v.t_us")) / 1e6
    for j in range(dims):
        total = total + F.col(f"alpha_{dim}_{j}") * (
            F.col(f"_p.v._aa{j}") + F.col(f"_nb{j}") - F.col(f"_p.v._na{j}") - F.col(f"s{j}"))
    return (seen.filter("_p IS NOT NULL").withColumn("residual", total)
            .select(*keys, "t_us", "residual"))


# ------------------------------------------------------------ diagnostics

def exponential_ranks(residuals: DataFrame, keys: Sequence[str], buckets: int = 4096) -> DataFrame:
    """Rank of each residual in its group, ranked inside value buckets of the Exp(1) scale."""
    cdf = 1 - F.exp(-F.greatest(F.col("residual"), F.lit(0.0)))
    numbered = chunk_scan(residuals.withColumn("cdf", cdf), keys,
                          F.floor(F.col("cdf") * buckets), ["residual", "t_us"], [ordinal("i")])
    sizes = residuals.groupBy(*keys).agg(F.count("*").alias("n"))
    return numbered.join(sizes, list(keys))


def ks_exponential(residuals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Kolmogorov–Smirnov distance to Exp(1), asymptotic p-value and the 5 % verdict."""
    r = exponential_ranks(residuals, keys)
    gap = F.greatest(F.col("i") / F.col("n") - F.col("cdf"),
                     F.col("cdf") - (F.col("i") - 1) / F.col("n"))
    out = r.groupBy(*keys).agg(F.max(gap).alias("ks"), F.max("n").alias("n"))
    x = F.sqrt(F.col("n").cast("double")) * F.col("ks")
    small, large = F.lit(0.0), F.lit(0.0)
    for k in range(1, 40):
        large = large + F.exp(-2.0 * k * k * x * x) * (2.0 if k % 2 else -2.0)
    for k in range(1, 8):
        small = small + F.exp(-((2 * k - 1) ** 2) * np.pi**2 / (8 * x * x))
    p = F.when(x < 0.6, 1 - small * float(np.sqrt(2 * np.pi)) / x).otherwise(large)
    return (out.withColumn("p_value", F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))
            .withColumn("exponential", F.col("p_value") > 0.05))


def qq_exponential(residuals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ordered residuals against Exp(1) quantiles at Filliben plotting positions."""
    r = exponential_ranks(residuals, keys)
    last = F.pow(F.lit(0.5), F.lit(1.0) / F.col("n"))
    position = (F.when(F.col("i") == F.col("n"), last).when(F.col("i") == 1, 1 - last)
                .otherwise((F.col("i") - 0.3175) / (F.col("n") + 0.365)))
    return r.select(*keys, "i", F.col("residual").alias("sample"),
                    (-F.log(1 - position)).alias("theoretical"))


def impulse_intensity(events: DataFrame, baseline: float, alpha: float, beta: float,
                      start: float, end: float, points: int = 2000,
                      keys: Sequence[str] = ("session",), dim: int = 0) -> DataFrame:
    """Price intensity on an even time grid from the news events inside [start, end].

    λ(t) = μ + Σ αβ e^{−β(t−tₙ)}. Grid points are stacked with the events and take the decayed
    sum of the events at or before them, so no event meets every grid point.
    """
    keys = list(keys)
    step = (end - start) / (points - 1)
    inside = events.filter((F.col("dim") == dim) & F.col("t_us").between(
        int(round(start * 1e6)), int(round(end * 1e6)))).select(
            *keys, F.lit(0).alias("dim"), "t_us", F.lit(None).cast("long").alias("grid"))
    grid = (events.select(*keys).distinct()
            .withColumn("grid", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))))
            .select(*keys, F.lit(1).alias("dim"),
                    F.round((F.lit(start) + F.col("grid") * step) * 1e6).cast("long").alias("t_us"), "grid"))
    sums = decayed_sums(inside.unionByName(grid), keys, F.lit(float(beta)), dims=1)
    return (sums.filter("grid IS NOT NULL")
            .select(*keys, "grid", (F.col("t_us") / 1e6).alias("t"),
                    (F.lit(baseline) + (F.col("s0") + F.col("tie0")) * alpha * beta).alias("intensity")))
