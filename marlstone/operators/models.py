"""Regressions, evaluation, price models, clusters and bootstraps over Gram sums.

A fit needs the sums of products of its columns only: they come from one aggregate, per group where there are groups, and
the small systems are solved on those sums. Data rows never reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order_statistics import exact_quantiles, value_ranks
from ..functions.staging import small_side, written


#: Partitions of points that are read many times.
_DEALT = 12


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1.0 / max(1e-300, 1.0 - (a + b) * x / (a + 1.0)) if 1.0 - (a + b) * x / (a + 1.0) > 0 else 1.0
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1.0 + num * d, 1.0 + num / c
            d, c = 1.0 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return h


def t_p_value(t: float, df: float) -> float:
    """Two-sided p-value of a t statistic, by the incomplete beta function."""
    if not math.isfinite(t) or df <= 0:
        return float("nan")
    x, a, b = df / (df + t * t), df / 2.0, 0.5
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def gram_columns(columns: Sequence[str]) -> list[Column]:
    """Sums of products of each pair of columns, as g_i_j with i <= j, and the number of rows as n."""
    c = list(columns)
    return [F.sum(F.col(c[i]) * F.col(c[j])).alias(f"g_{i}_{j}") for i in range(len(c)) for j in range(i, len(c))] + [F.count("*").alias("n")]


def gram_matrix(row, k: int) -> np.ndarray:
    g = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = row[f"g_{i}_{j}"] or 0.0
    return g


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(" and ".join(f"`{c}` is not null and not isnan(`{c}`)" for c in columns))


@dataclass
class AbsorbedFit:
    """A least-squares fit with absorbed effects: coefficients of `xs`, their covariance, and what was fitted."""

    xs: list[str]
    coef: np.ndarray
    cov: np.ndarray
    known: list[int]  # terms that vary within the effects
    dof: float
    n: int
    k: int  # parameters, effects included
    clusters: int | None
    sse: float
    total: float  # squares about the mean
    within: float  # squares about the effects' means
    means: DataFrame  # (_of, ...) a row for each effect
    level: Column  # its intercept

    def log_likelihood(self) -> float:
        return -self.n / 2 * (math.log(2 * math.pi) + 1 + math.log(max(self.sse / self.n, 1e-15))) if self.n else float("nan")

    def metrics(self) -> dict[str, float]:
        part = lambda whole: 1 - self.sse / whole if whole else float("nan")
        r2, log = part(self.total), self.log_likelihood()
        adjusted = 1 - (1 - r2) * (self.n - 1) / max(self.n - self.k, 1)
        return {"r2": r2, "r2_within": part(self.within), "adj_r2": adjusted, "aic": 2 * self.k - 2 * log, "bic": self.k * math.log(max(self.n, 1)) - 2 * log, "rmse": math.sqrt(max(self.sse, 0.0) / max(self.n, 1))}


def _double(x: float) -> str:
    """A number as SQL has it: long expressions are made as text, which is one call for each."""
    return f"({float(x)!r}D)"


class EffectMoments:
    """Sums of products of columns within effects, from one pass over the rows: any subset of the columns can be fitted.

    Rows are read once, for the moments of each cell of effect and cluster; all sums within the effects follow from the
    cells. Rows with a missing value in any of the columns are left out. With clusters, rows go to their cell before they are
    summed: a task mostly has too few of a cell for partial sums to pay, which are as wide as the square of the columns.
    """

    def __init__(self, df: DataFrame, y: str, columns: Sequence[str], effect: str | None = None, cluster: str | None = None):
        self.columns, self.effect, self.cluster = list(columns), effect, cluster
        names = [*self.columns, y]
        q = len(self.columns)
        by = [F.col(effect).alias("_e") if effect else F.lit(0).alias("_e"), *([F.col(cluster).alias("_k")] if cluster else [])]
        rows = complete_cases(df, names)
        whole = rows.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(names)), F.count("*").alias("n")).first()
        self.n = whole.n
        # about the overall means, so that sums of squares don't lose digits
        self._centre = [float(whole[f"m{i}"] or 0.0) for i in range(q + 1)]
        about = [F.col(c).cast("double") - F.lit(m) for c, m in zip(names, self._centre, strict=True)]
        pairs = [(i, j) for i in range(q + 1) for j in range(i, q + 1)]
        near = rows.select(*by, *(x.alias(f"_x{i}") for i, x in enumerate(about)))
        near = near.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_e", "_k") if cluster else near
        sums = [F.expr(f"sum(_x{i}) AS _s{i}") for i in range(q + 1)] + [F.expr(f"sum(_x{i} * _x{j}) AS _p{i}_{j}") for i, j in pairs]
        cells = written(near.groupBy("_e", *(["_k"] if cluster else [])).agg(*sums, F.count("*").alias("_n")), "fit-cells")  # a row for each cell
        self._means = cells.groupBy(F.col("_e").alias("_of")).agg(*(F.expr(f"sum(_s{i}) / sum(_n) AS _g{i}") for i in range(q + 1)))
        near = cells.join(self._means, F.col("_e").eqNullSafe(F.col("_of")))
        self._near = near.selectExpr("*", *(f"_s{i} / _n AS _a{i}" for i in range(q + 1)), *(f"_s{i} / _n - _g{i} AS _d{i}" for i in range(q + 1)))
        total = [F.expr(f"sum(_p{i}_{i}) AS t{i}") for i in range(q + 1)]
        one = self._near.agg(*(F.expr(f"sum({self._inside(i, j)}) AS g_{i}_{j}") for i, j in pairs), *total, F.count_distinct(F.coalesce(F.col("_e").cast("string"), F.lit("\0"))).alias("effects")).first()
        self._gram, self._total, self._effects = gram_matrix(one, q + 1), [one[f"t{i}"] or 0.0 for i in range(q + 1)], one.effects

    def _inside(self, i: int, j: int) -> str:
        """A cell's sum of products of two columns about their effect's means."""
        i, j = min(i, j), max(i, j)
        return f"(_p{i}_{j} + _n * (_d{i} * _d{j} - _a{i} * _a{j}))"

    def fit(self, xs: Sequence[str], clustered: bool = True) -> AbsorbedFit:
        """Least squares of y on some of the columns; see absorbed_fit()."""
        xs, last = list(xs), len(self.columns)
        at = [self.columns.index(x) for x in xs]
        q, g = len(xs), self._gram[np.ix_([*at, last], [*at, last])]
        k = q + (self._effects if self.effect else 1)
        # a term that doesn't vary within the effects has no coefficient; what absorbing leaves of it is rounding
        known = [i for i in range(q) if g[i, i] > 1e-12 * max(self._total[at[i]], 1e-300)]
        inverse, coef = np.zeros((q, q)), np.zeros(q)
        if known:
            inverse[np.ix_(known, known)] = np.linalg.pinv(g[np.ix_(known, known)])
            coef = inverse @ g[:q, q]
        sse, groups = float(g[q, q] - coef @ g[:q, q]), None
        if self.cluster and clustered:
            score = [" - ".join([self._inside(a, last), *(f"{_double(b)} * {self._inside(a, c)}" for b, c in zip(coef, at, strict=True))]) for a in at]
            scores = self._near.groupBy("_k").agg(*(F.expr(f"sum({s}) AS _score{i}") for i, s in enumerate(score)))
            two = scores.agg(*gram_columns([f"_score{i}" for i in range(q)])).first()
            groups = two.n
            cov = inverse @ gram_matrix(two, q) @ inverse * (groups / max(groups - 1, 1)) * ((self.n - 1) / max(self.n - k, 1))
        else:
            cov = inverse * sse / max(self.n - k, 1)
        level = F.expr(" - ".join([f"_g{last} + {_double(self._centre[last])}", *(f"{_double(b)} * (_g{a} + {_double(self._centre[a])})" for a, b in zip(at, coef, strict=True))]))
        return AbsorbedFit(xs, coef, cov, known, self.n - k if groups is None else groups - 1, self.n, k, groups, sse, self._total[last], float(g[q, q]), self._means, level)


def absorbed_fit(df: DataFrame, y: str, xs: Sequence[str], effect: str | None = None, cluster: str | None = None) -> AbsorbedFit:
    """Least squares of y on xs with fixed effects, which are absorbed.

    The covariance is clustered, with (G/(G-1)) ((N-1)/(N-k)) and G - 1 degrees of freedom, or classical without clusters; k
    counts the effects as parameters. Rows with a missing value are left out; a term without variation within the effects
    has coefficient 0 and isn't `known`.
    """
    return EffectMoments(df, y, xs, effect, cluster).fit(xs)


def with_fits(df: DataFrame, fits: Mapping[str, AbsorbedFit], effect: str | None = None) -> DataFrame:
    """df with the values of fits of one EffectMoments, each under its name. An effect that it hasn't seen counts as its first."""
    out, own = df, F.lit(0) if effect is None else F.col(effect)
    means = next(iter(fits.values())).means
    if any(fit.means is not means for fit in fits.values()):
        raise ValueError("the fits are of different rows")
    levels = written(means.select("_of", *(fit.level.alias(f"_i{i}") for i, fit in enumerate(fits.values()))), "fit-levels")
    first = levels.agg(*(F.min_by(f"_i{i}", "_of").alias(f"_f{i}") for i in range(len(fits))))
    out = out.join(small_side(levels, 8 + 8 * len(fits)), own.eqNullSafe(F.col("_of")), "left").crossJoin(F.broadcast(first))  # one row
    for i, (name, fit) in enumerate(fits.items()):
        slope = sum((F.lit(float(b)) * F.col(x) for b, x in zip(fit.coef, fit.xs, strict=True)), F.lit(0.0))
        out = out.withColumn(name, F.coalesce(f"_i{i}", f"_f{i}") + slope)
    return out.drop("_of", *(f"_{s}{i}" for i in range(len(fits)) for s in "if"))


def with_fit(df: DataFrame, fit: AbsorbedFit, effect: str | None = None, name: str = "fitted") -> DataFrame:
    """df with a fit's values; see with_fits()."""
    return with_fits(df, {name: fit}, effect)


def fixed_effect_ols(df: DataFrame, y: str, xs: Sequence[str], effect: str | None = None, cluster: str | None = None) -> DataFrame:
    """(term, coef, se, t, p, n, clusters, r2, r2_within, adj_r2, aic, bic, rmse) of absorbed_fit().

    r2 and adj_r2 are about the overall mean, so that effects count as explained; r2_within is about the effects' means.
    aic and bic are of the normal log-likelihood. A term without variation within the effects gets nulls.
    """
    fit = absorbed_fit(df, y, xs, effect, cluster)
    m = fit.metrics()
    last = (fit.n, fit.clusters, m["r2"], m["r2_within"], m["adj_r2"], m["aic"], m["bic"], m["rmse"])
    out = []
    for i, x in enumerate(fit.xs):
        se = math.sqrt(max(fit.cov[i, i], 0.0))
        t = float(fit.coef[i]) / se if se else float("nan")
        out.append((x, float(fit.coef[i]), se, t, t_p_value(t, fit.dof), *last) if i in fit.known else (x, None, None, None, None, *last))
    return df.sparkSession.createDataFrame(out, "term string, coef double, se double, t double, p double, n long, clusters long, r2 double, r2_within double, adj_r2 double, aic double, bic double, rmse double")


def percent_effect(coef: Column, se: Column, step: float = 10.0) -> dict[str, Column]:
    """A coefficient on a logarithm as percent a step, with its 95 % interval."""
    f = lambda b: (F.exp(b * step) - 1) * 100
    return {"pct": f(coef), "pct_low": f(coef - 1.96 * se), "pct_high": f(coef + 1.96 * se)}


def likelihood_ratio(n: int, sse_small: float, sse_large: float, added: int) -> tuple[float, float]:
    """(statistic, p) of nested models; p by the chi-square tail of one or two added terms, or a series for more."""
    stat = n * math.log(sse_small / sse_large)
    x, s = stat / 2.0, added / 2.0
    if x <= 0:
        return stat, 1.0
    total = term = 1.0 / s
    for i in range(1, 500):
        term *= x / (s + i)
        total += term
        if term < total * 1e-15:
            break
    return stat, max(0.0, 1.0 - math.exp(-x + s * math.log(x) - math.lgamma(s)) * total)


def evaluate(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = (), log: bool = False) -> DataFrame:
    """(keys, n, rmse, mae, mape, r2, bias, slope, intercept, median_ape) of predictions.

    With `log` values are logarithms: percentage errors are of what they are logarithms of.
    """
    a, p = F.col(actual), F.col(predicted)
    e = p - a
    percent = F.abs(F.exp(e) - 1) if log else F.abs(e / F.nullif(a, F.lit(0.0)))
    return complete_cases(df, [actual, predicted]).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(percent).alias("mape"),
        (1 - F.sum(e * e) / F.nullif(F.var_pop(a) * F.count("*"), F.lit(0.0))).alias("r2"),
        F.avg(e).alias("bias"),
        F.regr_slope(a, p).alias("slope"),
        F.regr_intercept(a, p).alias("intercept"),
        F.percentile(percent, 0.5).alias("median_ape"),
    )


def weighted_rmse(df: DataFrame, actual: str, predicted: str, key: str) -> DataFrame:
    """(groups, rmse): the root of the mean over `key` of each one's mean square, so that each counts the same."""
    e = F.col(predicted) - F.col(actual)
    per = complete_cases(df, [actual, predicted]).groupBy(key).agg(F.avg(e * e).alias("_s"))
    return per.agg(F.count("*").alias("groups"), F.sqrt(F.avg("_s")).alias("rmse"))


def temporal_split(df: DataFrame, when: str, share: float = 0.75) -> DataFrame:
    """df with is_test: later than the given quantile of its dates."""
    days = F.datediff(F.col(when), F.lit("1970-01-01").cast("date"))
    cut = df.agg(F.percentile(days, share).alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).withColumn("is_test", days > F.col("_cut")).drop("_cut")  # one row


def group_holdout(df: DataFrame, key: str, seed: int, percent: int = 20) -> DataFrame:
    """df with is_test for a share of its keys, chosen by a hash."""
    return df.withColumn("is_test", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(100)) < percent)


def linear_fit(df: DataFrame, y: str, xs: Sequence[str], train: Column | None = None, ridge: float = 0.0) -> tuple[np.ndarray, float, Column]:
    """(coefficients, intercept, prediction) of least squares, or ridge with an unpenalised intercept, on training rows."""
    rows = complete_cases(df, [y, *xs])
    rows = rows.where(train) if train is not None else rows
    names = ["_one", *xs, y]
    row = rows.withColumn("_one", F.lit(1.0)).agg(*gram_columns(names)).first()
    g, q = gram_matrix(row, len(names)), len(xs)
    n = g[0, 0]
    centred = g[1:, 1:] - np.outer(g[0, 1:], g[0, 1:]) / max(n, 1)
    coef = np.linalg.pinv(centred[:q, :q] + ridge * np.eye(q)) @ centred[:q, q]
    intercept = float((g[0, q + 1] - coef @ g[0, 1 : q + 1]) / max(n, 1))
    return coef, intercept, sum((F.lit(float(b)) * F.col(x) for b, x in zip(coef, xs, strict=True)), F.lit(intercept))


def robust_scaled(df: DataFrame, columns: Sequence[str], clip: tuple[float, float] | None = None) -> DataFrame:
    """df with scaled_*: (x - median) / interquartile range, after clipping to quantiles if asked for; constants give 0."""
    low, high = clip or (0.0, 1.0)
    one = exact_quantiles(df, [], columns, [low, 0.25, 0.5, 0.75, high]).select(*(F.col(c).alias(f"_q_{c}") for c in columns))
    out = df.join(F.broadcast(one), F.lit(True), "left")  # one row, or none without values
    for c in columns:
        q = F.col(f"_q_{c}")
        x = F.least(F.greatest(F.col(c), q[0]), q[4]) if clip else F.col(c)
        out = out.withColumn(f"scaled_{c}", F.coalesce((x - q[2]) / F.nullif(q[3] - q[1], F.lit(0.0)), F.when(F.col(c).isNotNull(), F.lit(0.0))))
    return out.drop(*(f"_q_{c}" for c in columns))


def leave_one_group_out(df: DataFrame, y: str, xs: Sequence[str], group: str) -> DataFrame:
    """(group, term, coef, n): fits without each group, by taking its Gram sums from the total; solved group by group."""
    names, q = ["_one", *xs, y], len(xs)
    per = complete_cases(df, [y, *xs]).withColumn("_one", F.lit(1.0)).groupBy(group).agg(*gram_columns(names))
    sums = [c for c in per.columns if c != group]
    total = per.agg(*(F.sum(c).alias(f"t_{c}") for c in sums))
    left = per.crossJoin(F.broadcast(total)).select(group, *((F.col(f"t_{c}") - F.col(c)).alias(c) for c in sums))  # one row
    kind = dict(left.dtypes)[group]

    def solve(batches):
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                g = gram_matrix(row, q + 2)
                b = np.linalg.pinv(g[: q + 1, : q + 1]) @ g[: q + 1, q + 1]
                rows += [(row[group], x, float(v), int(row["n"])) for x, v in zip(xs, b[1:], strict=True)]
            yield pd.DataFrame(rows, columns=[group, "term", "coef", "n"])

    return left.mapInPandas(solve, f"`{group}` {kind}, term string, coef double, n long")


def group_models(df: DataFrame, y: str, xs: Sequence[str], group: str, least_rows: int = 30, ridge: float = 0.0) -> DataFrame:
    """(group, coefs, intercept, sigma, n, basis): a model for each group with enough rows, else the global one."""
    names, q = ["_one", *xs, y], len(xs)
    rows = complete_cases(df, [y, *xs]).withColumn("_one", F.lit(1.0))
    per = rows.groupBy(group).agg(*gram_columns(names))
    whole = per.agg(*(F.sum(c).alias(f"w_{c}") for c in per.columns if c != group))
    both = per.crossJoin(F.broadcast(whole))  # one row
    kind = dict(per.dtypes)[group]

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                own = row["n"] >= least_rows
                source = row if own else {c[2:]: v for c, v in row.items() if c.startswith("w_")}
                g = gram_matrix(source, q + 2)
                n = g[0, 0]
                centred = g[1:, 1:] - np.outer(g[0, 1:], g[0, 1:]) / n
                b = np.linalg.pinv(centred[:q, :q] + ridge * np.eye(q)) @ centred[:q, q]
                sse = max(0.0, float(centred[q, q] - 2 * b @ centred[:q, q] + b @ centred[:q, :q] @ b))
                out.append((row[group], b.tolist(), float((g[0, q + 1] - b @ g[0, 1 : q + 1]) / n), math.sqrt(sse / max(n - q - 1, 1)), int(row["n"]), "LOCAL" if own else "GLOBAL"))
            yield pd.DataFrame(out, columns=[group, "coefs", "intercept", "sigma", "n", "basis"])

    return both.mapInPandas(solve, f"`{group}` {kind}, coefs array<double>, intercept double, sigma double, n long, basis string")


def fair_values(df: DataFrame, models: DataFrame, group: str, xs: Sequence[str]) -> DataFrame:
    """df with fair, fair_low, fair_high and width_pct from its group's model of the logarithm."""
    m = models.select(group, "coefs", "intercept", "sigma", "basis")
    log = F.col("intercept") + sum((F.get("coefs", F.lit(i)) * F.col(x) for i, x in enumerate(xs)), F.lit(0.0))
    out = df.join(m, group, "left").withColumn("_log", log)
    return out.withColumns({"fair": F.exp("_log"), "fair_low": F.exp(F.col("_log") - 1.96 * F.col("sigma")), "fair_high": F.exp(F.col("_log") + 1.96 * F.col("sigma"))}).withColumn("width_pct", (F.col("fair_high") - F.col("fair_low")) / F.col("fair") * 100).drop("_log", "coefs", "intercept", "sigma")


def fallback_level(levels: Sequence[tuple[str, Column, Column]], least_rows: int, least_entities: int) -> Column:
    """The first (name, rows, entities) that meets both minima, or GLOBAL."""
    out = F.lit("GLOBAL")
    for name, rows, entities in reversed(levels):
        out = F.when((F.coalesce(rows, F.lit(0)) >= least_rows) & (F.coalesce(entities, F.lit(0)) >= least_entities), name).otherwise(out)
    return out


def spline_basis(x: Column, knots: Sequence[float], degree: int = 3) -> list[Column]:
    """Cubic B-splines at fixed knots, by the Cox-de Boor recursion as expressions; the last interval is closed."""
    t = [knots[0]] * degree + list(knots) + [knots[-1]] * degree
    end = len(t) - 1
    b = [F.when((x >= t[i]) & ((x < t[i + 1]) | ((x == t[-1]) & (t[i + 1] == t[-1]) & (t[i] < t[i + 1]))), 1.0).otherwise(0.0) for i in range(end)]
    for p in range(1, degree + 1):
        nxt = []
        for i in range(end - p):
            out = F.lit(0.0)
            if t[i + p] > t[i]:
                out = out + (x - t[i]) / (t[i + p] - t[i]) * b[i]
            if t[i + p + 1] > t[i + 1]:
                out = out + (t[i + p + 1] - x) / (t[i + p + 1] - t[i + 1]) * b[i + 1]
            nxt.append(out)
        b = nxt
    return b


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
    return h ^ (h >> np.uint64(32))


def hashed_on(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """xxhash64(..., x) of ints below 2 ** 31, where h (unsigned) is the hash of the columns before."""
    h = (h + np.uint64(0x27D4EB2F165667C5 + 4)) ^ (x.astype(np.uint64) * np.uint64(0x9E3779B185EBCA87))
    return _mixed(((h << np.uint64(23)) | (h >> np.uint64(41))) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))


def bootstrap_medians(df: DataFrame, key: str, value: str, replicates: int, seed: int = 1) -> DataFrame:
    """(key, n, positive, low, mid, high, iqr) of medians over resampled values, drawn by xxhash64(key, replicate, draw, seed).

    Values of a key are an array that travels once, or once for each block of replicates where there are very many; a task
    draws a few replicates of a key at a time.
    """
    spark, block = df.sparkSession, 50_000_000
    packed = df.where(F.col(value).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("_v"))
    n = F.size("_v")
    step = F.greatest(F.lit(1), F.floor(F.lit(block) / n)).cast("int")
    dealt = packed.select(F.col(key), "_v", F.xxhash64(key).alias("_h"), F.explode(F.sequence(F.lit(1), F.lit(replicates), F.least(step, F.lit(replicates)))).alias("_b"), step.alias("_step"))
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key, "_b")

    def draws(batches):
        for pdf in batches:
            out = []
            for k, v, h, first, step in zip(pdf[key], pdf["_v"], pdf["_h"], pdf["_b"], pdf["_step"], strict=True):
                v, size = np.asarray(v), len(v)
                reps, js, low = np.arange(first, min(first + step, replicates + 1)), np.arange(1, size + 1), (size - 1) // 2
                medians, at_once = [], max(1, 60_000 // size)
                for i in range(0, len(reps), at_once):
                    own = hashed_on(np.array([h], np.int64).view(np.uint64), reps[i : i + at_once])
                    drawn = hashed_on(hashed_on(own[:, None], js[None, :]), np.array([[seed]])).view(np.int64)
                    drawn = drawn - drawn // size * size
                    drawn.partition((low, size // 2), axis=1)
                    medians.append((v[drawn[:, low]] + v[drawn[:, size // 2]]) / 2)
                out.append((k, size, np.concatenate(medians)))
            yield pd.DataFrame(out, columns=[key, "n", "_m"])

    drawn = dealt.mapInPandas(draws, f"`{key}` {dict(df.dtypes)[key]}, n int, _m array<double>")
    per = drawn.groupBy(key).agg(F.first("n").alias("n"), F.array_sort(F.flatten(F.collect_list("_m"))).alias("_m"))

    def at(p: float) -> Column:
        """percentile() of the medians."""
        place = p * (replicates - 1)
        low, high = (F.get("_m", F.lit(f(place))) for f in (math.floor, math.ceil))
        return F.when(low == high, low).otherwise((math.ceil(place) - place) * low + (place - math.floor(place)) * high)

    return per.select(key, "n", (F.size(F.filter("_m", lambda m: m > 0)) / F.lit(float(replicates))).alias("positive"), *(at(p).alias(name) for p, name in ((0.025, "low"), (0.5, "mid"), (0.975, "high"))), (at(0.75) - at(0.25)).alias("iqr"))


def label_agreement(df: DataFrame, one: str, two: str) -> DataFrame:
    """(n, ari, nmi) of two labelings, from the sums of their contingency table."""
    c = df.where(F.col(one).isNotNull() & F.col(two).isNotNull()).groupBy(one, two).agg(F.count("*").alias("n"))
    pairs = lambda n: n * (n - 1) / 2.0
    row, col = (c.groupBy(k).agg(F.sum("n").alias("n")) for k in (one, two))
    part = lambda t, s: t.agg(F.sum(pairs(F.col("n"))).alias(f"p{s}"), F.sum(F.col("n") * F.ln("n")).alias(f"e{s}"))
    x = part(c, "").crossJoin(part(row, "a")).crossJoin(part(col, "b")).crossJoin(c.agg(F.sum("n").alias("n")))  # one row each
    expected = F.col("pa") * F.col("pb") / F.nullif(pairs(F.col("n")), F.lit(0.0))
    ari = F.coalesce((F.col("p") - expected) / F.nullif((F.col("pa") + F.col("pb")) / 2 - expected, F.lit(0.0)), F.lit(1.0))
    h = lambda s: F.ln("n") - F.col(f"e{s}") / F.col("n")
    nmi = F.coalesce((h("a") + h("b") - h("")) / F.nullif((h("a") + h("b")) / 2, F.lit(0.0)), F.lit(1.0))
    return x.select("n", ari.alias("ari"), nmi.alias("nmi"))


def cluster_range(df: DataFrame, ident: str, columns: Sequence[str], ks: Sequence[int], seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """KMeans for each k: (k, silhouette, calinski_harabasz, davies_bouldin, least) and labels (ident, k, cluster)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    spark = df.sparkSession
    # written, as each step reads them; dealt by ident, as starts are drawn by partition
    points = written(complete_cases(df, columns).select(ident, *columns), "cluster-points").repartition(_DEALT, ident).sortWithinPartitions(ident)
    points = VectorAssembler(inputCols=list(columns), outputCol="features").transform(points).cache()
    n_all, labels, quality = points.count(), None, []
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(points)
        own = model.transform(points)
        silhouette = ClusteringEvaluator(predictionCol="cluster").evaluate(own)
        centres = model.clusterCenters()
        to = lambda c: F.sqrt(sum((F.pow(F.col(x) - float(v), 2) for x, v in zip(columns, c, strict=True)), F.lit(0.0)))
        apart = F.get(F.array(*(to(c) for c in centres)), F.col("cluster"))
        per = {r.cluster: r for r in own.groupBy("cluster").agg(F.count("*").alias("n"), F.avg(apart).alias("s"), F.sum(apart * apart).alias("ss")).collect()}  # a row a cluster
        mean = sum(per[i].n * centres[i] for i in per) / n_all
        between = sum(per[i].n * float(((centres[i] - mean) ** 2).sum()) for i in per)
        within = sum(per[i].ss for i in per)
        ch = between / max(k - 1, 1) / (within / max(n_all - k, 1)) if within else float("nan")
        db = sum(max((per[i].s + per[j].s) / float(np.linalg.norm(centres[i] - centres[j])) for j in per if j != i) for i in per) / len(per) if len(per) > 1 else float("nan")
        quality.append((k, silhouette, ch, db, min(r.n for r in per.values())))
        mine = own.select(ident, F.lit(k).alias("k"), "cluster")
        labels = mine if labels is None else labels.unionByName(mine)
    labels = written(labels, "cluster-labels") if labels is not None else None
    points.unpersist()
    return spark.createDataFrame(quality, "k int, silhouette double, calinski_harabasz double, davies_bouldin double, least long"), labels


def chosen_k(quality: DataFrame, least: int) -> DataFrame:
    """quality with `score`, a sum of ranks (lower is better) of the k that keep their clusters large enough, and `chosen`."""
    w = Window.partitionBy()  # a row for each k
    ok = quality.where(F.col("least") >= least)
    rank = lambda c, desc: F.rank().over(w.orderBy(F.col(c).desc() if desc else F.col(c).asc()))
    scored = ok.withColumn("score", rank("silhouette", True) + rank("calinski_harabasz", True) + rank("davies_bouldin", False))
    return scored.withColumn("chosen", F.row_number().over(w.orderBy("score", "k")) == 1)


def mixture_bic(df: DataFrame, columns: Sequence[str], ks: Sequence[int], seed: int = 7) -> DataFrame:
    """(k, log_likelihood, bic) of Gaussian mixtures."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    # written, as each step reads them
    points = written(complete_cases(df, columns).select(*columns), "mixture-points").repartition(_DEALT, *columns).sortWithinPartitions(*columns)
    points, d, out = VectorAssembler(inputCols=list(columns), outputCol="features").transform(points).cache(), len(columns), []
    n = points.count()
    for k in ks:
        ll = float(GaussianMixture(k=k, seed=seed).fit(points).summary.logLikelihood)
        out.append((k, ll, (k - 1 + k * d + k * d * (d + 1) / 2) * math.log(n) - 2 * ll))
    points.unpersist()
    return df.sparkSession.createDataFrame(out, "k int, log_likelihood double, bic double")


def _poisson_limits(mean: float) -> np.ndarray:
    """Hashes of 32 bits from limits[k - 1] on draw k or more."""
    p, upto, limits = math.exp(-mean), 0.0, []
    for k in range(1, 100):
        upto += p
        p *= mean / k
        if upto * 2**32 >= 2**32 - 1:
            break
        limits.append(math.ceil(upto * 2**32))
    return np.array(limits, np.uint32)


def poisson_draws(h: np.ndarray, times: np.ndarray, seed: int, trees: int, mean: float = 0.8) -> np.ndarray:
    """(trees, rows): how often a tree draws a row, by a hash of the row, which copy of it, the seed and a pair of trees."""
    out, limits = np.zeros((trees, len(h))), _poisson_limits(mean)
    # a look at the upper 16 bits tells all but those that a limit falls within
    known = np.searchsorted(limits, np.arange(2**16, dtype=np.uint32) << np.uint32(16), "right").astype(np.uint8)
    known[limits >> np.uint32(16)] = 255
    for i in np.flatnonzero(times > 16):  # drawn as a whole
        out[:, i] = np.random.Generator(np.random.Philox(key=int(hashed_on(h[i : i + 1], np.array([seed]))[0]))).poisson(mean * times[i], trees)
    copy, left = 0, np.flatnonzero(times <= 16)
    while len(left):
        own = hashed_on(hashed_on(h[left], np.array([copy])), np.array([seed]))
        for i in range(0, trees, 2):
            halves = hashed_on(own, np.array([i])).astype("<u8").view("<u4")
            drawn = known[halves >> np.uint32(16)]
            unclear = np.flatnonzero(drawn == 255)
            drawn[unclear] = np.searchsorted(limits, halves[unclear], "right")
            pair = drawn.reshape(-1, 2).T[: trees - i]
            if len(left) == len(h):
                out[i : i + 2] += pair
            else:
                out[i : i + 2, left] += pair
        copy += 1
        left = left[times[left] > copy]
    return out


def feature_edges(long: DataFrame, bins: int) -> dict[tuple[int, int], list[float]]:
    """Borders of up to `bins` bins of equal frequency for each (_m, _c) of long's values _x, `times` each, halfway between values."""
    at = written(value_ranks(long, "_x", ["_m", "_c"], weight="times"), "feature-ranks")
    few = at.groupBy("_m", "_c").agg((F.count("*") <= bins).alias("_few"))
    share = F.floor((F.col("before") + F.col("ties") / 2) / F.col("rows") * bins)
    # a row for each bin
    per = at.join(F.broadcast(few), ["_m", "_c"]).groupBy("_m", "_c", F.when(F.col("_few"), F.col("before")).otherwise(share).alias("_b")).agg(F.min("_x").alias("low"), F.max("_x").alias("high"))
    edges, last = {}, {}
    for r in sorted(per.collect(), key=lambda r: (r["_m"], r["_c"], r.low)):
        own = (r["_m"], r["_c"])
        if own in last and r.low < math.inf:
            mid = last[own] + (r.low - last[own]) / 2
            # what lies halfway belongs below, and a bin starts with its border
            edges.setdefault(own, []).append(math.nextafter(mid, math.inf) if last[own] < mid < r.low else r.low)
        last[own] = r.high
    return edges


def _looked_at() -> Column:
    """The third of a cell's features that its node may split by, by a hash."""
    drawn = F.transform(F.sequence(F.lit(0), F.size("bins") - 1), lambda f: F.struct(F.xxhash64("m", "tree", "node", f).alias("h"), f.alias("f")))
    return F.transform(F.slice(F.sort_array(drawn), 1, F.ceil(F.size("bins") / 3).cast("int")), lambda x: x["f"])


def _gain(f: str, x: str, least: int) -> Column:
    """(gain, -f, -bin) of a cut behind bin x of feature f, from a of t rows and their sums of y; null if it is none."""
    a, ay, t, ty = map(F.col, ("_a", "_ay", "_t", "_ty"))
    apart = ay / a - (ty - ay) / (t - a)
    return F.when((a >= least) & (t - a >= least) & (apart != 0), F.struct((a * (t - a) / t * apart * apart).alias("gain"), (-F.col(f)).alias("f"), (-F.col(x)).alias("bin")))


def _child(best: str) -> Column:
    beyond = F.get("bins", -F.col(best)["f"]) > -F.col(best)["bin"]
    return F.when(F.col(best).isNull(), F.col("node")).otherwise(F.col("node") * 2 + beyond.cast("long")).alias("node")


def _level_by_sums(cells: DataFrame, least: int) -> DataFrame:
    """Cells with the nodes of the next level, by sums of bins that are made before any shuffle."""
    node = ["m", "tree", "node"]
    looked = cells.select(*node, "bins", "w", "wy", F.explode(_looked_at()).alias("_f"))
    sums = looked.groupBy(*node, "_f", F.get("bins", F.col("_f")).alias("_x")).agg(F.sum("w").alias("w"), F.sum("wy").alias("wy"))
    whole = Window.partitionBy(*node, "_f")  # a row for each bin
    upto = whole.orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    cut = sums.select(*node, "_f", "_x", *(F.sum(c).over(w).alias(n) for w, names in ((upto, ("_a", "_ay")), (whole, ("_t", "_ty"))) for c, n in zip(("w", "wy"), names, strict=True)))
    best = cut.groupBy(*node).agg(F.max(_gain("_f", "_x", least)).alias("_s"))
    return cells.join(best, node).select("m", "tree", "bins", "w", "wy", _child("_s"))


def grown_forests(cells: DataFrame, depth: int, features: int, least: int = 10, largest: int = 100_000) -> DataFrame:
    """(m, bins, p): the mean over trees of what each one predicts for a cell of up to `features` bins.

    `cells` is (m, tree, bins, w, wy): a cell's drawn rows and their sum of y, 0 where a tree has drawn none. All trees of
    all forests grow by a level at a time. A node splits by the bin that lowers its squares most, of a third of the
    features, where both sides have `least` rows; one that hasn't split never does. While a node has more than `largest`
    cells a level is made of sums; after that a node's cells stay in one task, which sorts them.
    """
    now = written(cells.select("m", "tree", "bins", "w", "wy", F.lit(1).cast("long").alias("node")), "forest-level")
    level, before = 0, None
    while level < depth:
        # splitting ends where no node of the large ones has lost cells
        sizes = now.groupBy("m", "tree", "node").agg(F.count("*").alias("n")).where(F.col("n") > largest).agg(F.count("*").alias("nodes"), F.sum("n").alias("cells")).first()
        if not sizes.nodes or sizes == before:
            break
        now, level, before = written(_level_by_sums(now, least), "forest-level"), level + 1, sizes
    root = ["m", "tree", "root"]
    now = now.withColumn("root", F.col("node")).repartition(*root)
    whole = Window.partitionBy(*root, "node")  # up to `largest` cells
    for _ in range(level, depth):
        now, gains = now.withColumn("_looked", _looked_at()), []
        for i in range(-(-features // 3)):
            f = F.get("_looked", F.lit(i))
            now = now.withColumns({"_f": f, "_x": F.get("bins", f)})
            upto = whole.orderBy("_x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
            now = now.withColumns({n: F.sum(c).over(w) for w, names in ((upto, ("_a", "_ay")), (whole, ("_t", "_ty"))) for c, n in zip(("w", "wy"), names, strict=True)})
            now = now.withColumn(f"_g{i}", _gain("_f", "_x", least))
            gains.append(F.col(f"_g{i}"))
        now = now.withColumn("_s", F.max(F.greatest(*gains) if len(gains) > 1 else gains[0]).over(whole))
        now = now.select("m", "tree", "bins", "w", "wy", "root", _child("_s"))
    leaf = F.sum("wy").over(whole) / F.nullif(F.sum("w").over(whole), F.lit(0.0))
    return now.select("m", "bins", leaf.alias("p")).groupBy("m", "bins").agg(F.avg("p").alias("p"))


def forest_comparison(df: DataFrame, y: str, feature_sets: Mapping[str, Sequence[str]], key: str, seeds: Sequence[int], trees: int = 60, depth: int = 12) -> DataFrame:
    """(features, seed, rmse, mae) of random forests over feature sets on group hold-outs.

    Trees see features by up to 32 bins, so a tree needs the rows that it draws (0.8 of them, with replacement) as sums
    of cells of bins only. All forests share one pass that draws, and grow together.
    """
    from pyspark.ml.feature import Bucketizer

    names, seeds = list(feature_sets), [int(s) for s in seeds]
    columns = list(dict.fromkeys(c for f in feature_sets.values() for c in f))
    models = [(i, j) for i in range(len(names)) for j in range(len(seeds))]
    has = [" and ".join(f"x{columns.index(c)} is not null" for c in feature_sets[n]) for n in names]
    told = complete_cases(df, [y]).select(F.col(key).alias("key"), F.col(y).cast("double").alias("y"), *(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"x{k}") for k, c in enumerate(columns)))
    told = told.where(" or ".join(f"({x})" for x in has))
    # equal rows once, with their number, as they are told apart by it alone
    rows = written(told.groupBy(*told.columns).agg(F.count("*").alias("times")), "forest-rows")
    for j, seed in enumerate(seeds):
        rows = group_holdout(rows, "key", seed).withColumnRenamed("is_test", f"t{j}")

    # values with their numbers first, as they are far fewer than rows
    flags = {f"t{j}": F.col(f"t{j}") for j in range(len(seeds))} | {f"has{i}": F.expr(x) for i, x in enumerate(has)}
    long = None
    for k, c in enumerate(columns):
        own = [F.when(F.col(f"has{i}") & ~F.col(f"t{j}"), F.lit(m)) for m, (i, j) in enumerate(models) if c in feature_sets[names[i]]]
        values = rows.groupBy(F.col(f"x{k}").alias("_x"), *(x.alias(n) for n, x in flags.items())).agg(F.sum("times").alias("times"))
        values = values.select("_x", "times", F.lit(k).alias("_c"), F.explode(F.array_compact(F.array(*own))).alias("_m"))
        long = values if long is None else long.unionByName(values)
    edges = feature_edges(long, 32)
    cuts = {(m, k): f"b{m}_{k}" for m, (i, _) in enumerate(models) for k in (columns.index(c) for c in feature_sets[names[i]])}
    splits = [[-math.inf, *edges.get(own, [0.0]), math.inf] for own in cuts]
    binned = Bucketizer(splitsArray=splits, inputCols=[f"x{k}" for _, k in cuts], outputCols=list(cuts.values()), handleInvalid="keep").transform(rows)
    binned = binned.select(F.xxhash64("key", "y", *(f"x{k}" for k in range(len(columns)))).alias("h"), "y", "times", *(f"t{j}" for j in range(len(seeds))), *(F.coalesce(F.col(c).cast("int"), F.lit(-1)).alias(c) for c in cuts.values()), *(F.expr(x).alias(f"has{i}") for i, x in enumerate(has)))
    binned = written(binned, "forest-bins")
    own_bins = [[cuts[m, columns.index(c)] for c in feature_sets[names[i]]] for m, (i, _) in enumerate(models)]

    def sums(batches):
        held: dict[tuple, int] = {}
        room = np.zeros((1024, 2, trees))

        def told():
            cells = list(held)
            return pd.DataFrame({"m": [c[0] for c in cells], "bins": [list(c[1:]) for c in cells], "w": list(room[: len(cells), 0]), "wy": list(room[: len(cells), 1])})

        for pdf in batches:
            h, values, times = pdf["h"].to_numpy().view(np.uint64), pdf["y"].to_numpy(), pdf["times"].to_numpy()
            for j, seed in enumerate(seeds):
                drawn = poisson_draws(h, times, seed, trees) * ~pdf[f"t{j}"].to_numpy()
                for m, (i, of) in enumerate(models):
                    at = np.flatnonzero(pdf[f"has{i}"].to_numpy())
                    if of != j or not len(at):
                        continue
                    own, code = pdf[own_bins[m]].iloc[at], np.zeros(len(at), np.int64)
                    for c in own_bins[m]:
                        code = np.unique(code * 64 + own[c].to_numpy(), return_inverse=True)[1]
                    first = np.unique(code, return_index=True)[1]
                    slots = [held.setdefault((m, *c), len(held)) for c in own.iloc[first].itertuples(index=False, name=None)]
                    while len(held) > len(room):
                        room = np.concatenate([room, np.zeros_like(room)])
                    y_at, part = values[at], np.empty((2, trees, len(first)))
                    for t, w in enumerate(drawn if len(at) == len(pdf) else drawn[:, at]):
                        part[0, t] = np.bincount(code, w, len(first))
                        part[1, t] = np.bincount(code, w * y_at, len(first))
                    room[slots] += part.transpose(2, 0, 1)
            if len(held) > 50_000:
                yield told()
                held.clear()
                room = np.zeros((1024, 2, trees))
        if held:
            yield told()

    each = binned.mapInPandas(sums, "m int, bins array<int>, w array<double>, wy array<double>").select("m", "bins", F.posexplode(F.arrays_zip("w", "wy")).alias("tree", "_s"))
    cells = each.groupBy("m", "tree", "bins").agg(F.sum("_s.w").alias("w"), F.sum("_s.wy").alias("wy"))
    guess = written(grown_forests(cells, depth, max(map(len, own_bins))), "forest-cells")

    tests = [F.when(F.col(f"has{i}") & F.col(f"t{j}"), F.struct(F.lit(m).alias("m"), F.array(*own_bins[m]).alias("bins"))) for m, (i, j) in enumerate(models)]
    tested = binned.select("y", "times", F.explode(F.array_compact(F.array(*tests))).alias("_t")).select("y", "times", "_t.*")
    e = F.col("p") - F.col("y")
    got = tested.join(small_side(guess, 64 + 4 * len(columns)), ["m", "bins"]).where("p is not null").groupBy("m").agg(F.sqrt(F.sum(e * e * F.col("times")) / F.sum("times")).alias("rmse"), (F.sum(F.abs(e) * F.col("times")) / F.sum("times")).alias("mae"))
    named = df.sparkSession.createDataFrame([(m, names[i], seeds[j]) for m, (i, j) in enumerate(models)], "m int, features string, seed int")
    return named.join(got, "m", "left").select("features", "seed", "rmse", "mae")


def selected_model(results: DataFrame, base: str, gain: float = 0.005) -> DataFrame:
    """results (model, rmse, mae, monotone) with chosen: the best monotone model that beats `base` by a share in both errors, else base."""
    b = results.where(F.col("model") == base).select(F.col("rmse").alias("_r"), F.col("mae").alias("_m"))
    scored = results.crossJoin(F.broadcast(b)).withColumn("_ok", F.coalesce(F.col("monotone") & (F.col("rmse") <= F.col("_r") * (1 - gain)) & (F.col("mae") <= F.col("_m") * (1 - gain)), F.lit(False)))  # one row
    order = Window.orderBy((F.col("_ok") & (F.col("model") != base)).desc(), F.when(F.col("_ok"), F.col("rmse")), (F.col("model") == base).desc(), "model")  # a row for each model
    return scored.withColumn("chosen", F.row_number().over(order) == 1).drop("_r", "_m", "_ok")


def partial_dependence(df: DataFrame, predict: Column, columns: Sequence[str], grid: DataFrame) -> DataFrame:
    """(columns, mean): the mean prediction with the columns set to each row of a small grid."""
    fixed = grid.select(*(F.col(c).alias(f"_g_{c}") for c in columns))
    rows = df.drop(*columns).crossJoin(F.broadcast(fixed)).withColumns({c: F.col(f"_g_{c}") for c in columns})  # a grid of fixed size
    return rows.withColumn("_p", predict).groupBy(*columns).agg(F.avg("_p").alias("mean"))


def verdict_of(coef: Column, p: Column, gain: Column) -> Column:
    """STRONG, USEFUL, WEAK or NOT_SUPPORTED, by the sign and significance of a term and its gain out of sample in percent."""
    return F.when((coef > 0) & (p < 0.05) & (gain >= 1.0), "STRONG").when((coef > 0) & (gain >= 0.5), "USEFUL").when((coef > 0) & (gain > 0), "WEAK").otherwise("NOT_SUPPORTED")
