"""Queries of regressions, evaluation, price models and stability."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import models as M
from .registry import ENTITIES, TRADES, entities, query, table, trades


def _sample(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), (F.col("s_nationkey") % 5).alias("grp"), (F.col("s_acctbal") / 100).alias("score"))
    return trades(spark, d).join(s, "entity").select("entity", "grp", "score", "area", "discount", "deal_date", F.ln("unit").alias("y"))


_SAMPLE = f"""{TRADES}, s AS (SELECT entity, s_nationkey % 5 AS grp, s_acctbal / 100 AS score, area, discount, deal_date, LN(unit) AS y FROM t JOIN supplier ON s_suppkey = entity)"""
_FE = f"{_SAMPLE}, d AS (SELECT entity, y AS raw, y - AVG(y) OVER (PARTITION BY grp) AS y, score - AVG(score) OVER (PARTITION BY grp) AS x, grp FROM s)"


@query("fixed_effect_ols", f"WITH {_FE}, b AS (SELECT SUM(x * y) / SUM(x * x) AS b, SUM(x * x) AS xx, COUNT(*) AS n, COUNT(DISTINCT grp) + 1 AS k FROM d), c AS (SELECT entity, SUM(x * (y - b * x)) AS s FROM d, b GROUP BY 1), m AS (SELECT SUM(s * s) AS meat, COUNT(*) AS g FROM c) SELECT 'score' AS term, ROUND(b, 9) AS coef, ROUND(SQRT(meat * g / (g - 1) * (n - 1) / (n - k)) / xx, 9) AS se, n, g AS clusters FROM b, m")
def fixed_effect_ols(spark, d):
    """M1: fixed effects absorbed by demeaning, with clustered errors."""
    return M.fixed_effect_ols(_sample(spark, d), "y", ["score"], "grp", "entity").select("term", F.round("coef", 9).alias("coef"), F.round("se", 9).alias("se"), "n", "clusters")


@query(
    "fit_metrics",
    f"""WITH {_FE}, b AS (SELECT 1 - REGR_SYY(y, x) * (1 - REGR_R2(y, x)) / (VAR_POP(raw) * COUNT(*)) AS r2, REGR_R2(y, x) AS rw, COUNT(*) AS n, COUNT(DISTINCT grp) + 1 AS k,
  REGR_SYY(y, x) * (1 - REGR_R2(y, x)) AS sse, REGR_SLOPE(y, x) AS b FROM d)
SELECT ROUND(r2, 9) AS r2, ROUND(rw, 9) AS r2_within, ROUND(1 - (1 - r2) * (n - 1) / (n - k), 9) AS adj_r2, ROUND(n * (LN(sse / n) + 1 + LN(2 * PI())) + 2 * k, 4) AS aic,
  ROUND(n * (LN(sse / n) + 1 + LN(2 * PI())) + k * LN(n), 4) AS bic, ROUND(SQRT(sse / n), 9) AS rmse, (SELECT ROUND(AVG(ABS(y - b * x)), 9) FROM d, b) AS mae FROM b""",
)
def fit_metrics(spark, d):
    """M2: metrics of a fit."""
    s = _sample(spark, d)
    fit = M.absorbed_fit(s, "y", ["score"], "grp")
    mae = M.with_fit(s, fit, "grp").agg(F.round(F.avg(F.abs(F.col("y") - F.col("fitted"))), 9).alias("mae"))
    digits = {"r2": 9, "r2_within": 9, "adj_r2": 9, "aic": 4, "bic": 4, "rmse": 9}
    return mae.select(*(F.round(F.lit(fit.metrics()[c]), k).alias(c) for c, k in digits.items()), "mae")


@query("percent_effects", f"WITH {_FE}, b AS (SELECT REGR_SLOPE(y, x) AS b, SQRT(REGR_SYY(y, x) * (1 - REGR_R2(y, x)) / (COUNT(*) - COUNT(DISTINCT grp) - 1) / REGR_SXX(y, x)) AS se FROM d) SELECT 'score' AS term, ROUND((EXP(b * 10) - 1) * 100, 6) AS pct, ROUND((EXP((b - 1.96 * se) * 10) - 1) * 100, 6) AS pct_low, ROUND((EXP((b + 1.96 * se) * 10) - 1) * 100, 6) AS pct_high FROM b")
def percent_effects(spark, d):
    """M3, M4: a coefficient as percent a step."""
    fit = M.fixed_effect_ols(_sample(spark, d), "y", ["score"], "grp")
    return fit.select("term", *(F.round(c, 6).alias(name) for name, c in M.percent_effect(F.col("coef"), F.col("se")).items()))


@query("multi_term_ols", f"WITH {_SAMPLE}, m AS (SELECT COVAR_POP(y, area) AS ya, COVAR_POP(y, discount) AS yd, VAR_POP(area) AS aa, VAR_POP(discount) AS dd, COVAR_POP(area, discount) AS ad FROM s) SELECT UNNEST(['area', 'discount']) AS term, ROUND(UNNEST([(ya * dd - yd * ad) / (aa * dd - ad * ad), (yd * aa - ya * ad) / (aa * dd - ad * ad)]), 8) AS coef FROM m")
def multi_term_ols(spark, d):
    """M4: several terms without clusters."""
    return M.fixed_effect_ols(_sample(spark, d), "y", ["area", "discount"]).select("term", F.round("coef", 8).alias("coef"))


@query("temporal_evaluation", f"WITH {_SAMPLE}, c AS (SELECT quantile_cont(DATE_DIFF('day', DATE '1970-01-01', deal_date), 0.75) AS cut FROM s), x AS (SELECT s.*, DATE_DIFF('day', DATE '1970-01-01', deal_date) > cut AS test FROM s, c), f AS (SELECT REGR_SLOPE(y, area) AS b, REGR_INTERCEPT(y, area) AS a FROM x WHERE NOT test), e AS (SELECT a + b * area - y AS e, y, entity, grp FROM x, f WHERE test) SELECT (SELECT ROUND(SQRT(AVG(m)), 8) FROM (SELECT AVG(e * e) AS m FROM e GROUP BY entity)) AS entity_rmse, (SELECT ROUND(SQRT(AVG(m)), 8) FROM (SELECT AVG(e * e) AS m FROM e GROUP BY grp)) AS group_rmse, ROUND(MEDIAN(ABS(EXP(e) - 1)), 8) AS median_ape, COUNT(*) AS n, ROUND(SQRT(AVG(e * e)), 8) AS rmse, ROUND(AVG(ABS(e)), 8) AS mae, ROUND(AVG(ABS(EXP(e) - 1)), 8) AS mape, ROUND(1 - SUM(e * e) / (VAR_POP(y) * COUNT(*)), 8) AS r2 FROM e")
def temporal_evaluation(spark, d):
    """Trained on the earlier dates, judged on the later."""
    s = M.temporal_split(_sample(spark, d), "deal_date")
    _, _, prediction = M.linear_fit(s, "y", ["area"], ~F.col("is_test"))
    test = s.where("is_test").withColumn("p", prediction)
    even = [M.weighted_rmse(test, "y", "p", key).select(F.round("rmse", 8).alias(name)) for key, name in (("entity", "entity_rmse"), ("grp", "group_rmse"))]
    e = M.evaluate(test, "y", "p", log=True).select("n", *(F.round(c, 8).alias(c) for c in ("rmse", "mae", "mape", "r2", "median_ape")))
    return e.crossJoin(even[0]).crossJoin(even[1])  # one row each


@query("leave_one_group_out", f"WITH {_SAMPLE}, g AS (SELECT grp, COUNT(*) AS n, SUM(area) AS x, SUM(y) AS y, SUM(area * area) AS xx, SUM(area * y) AS xy FROM s GROUP BY 1), w AS (SELECT SUM(n) AS n, SUM(x) AS x, SUM(y) AS y, SUM(xx) AS xx, SUM(xy) AS xy FROM g) SELECT grp, ROUND(((w.n - g.n) * (w.xy - g.xy) - (w.x - g.x) * (w.y - g.y)) / ((w.n - g.n) * (w.xx - g.xx) - (w.x - g.x) * (w.x - g.x)), 8) AS coef, CAST(w.n - g.n AS BIGINT) AS n FROM g, w")
def leave_one_group_out(spark, d):
    """Fits without each group, from sums taken away."""
    return M.leave_one_group_out(_sample(spark, d), "y", ["area"], "grp").select("grp", F.round("coef", 8).alias("coef"), "n")


@query("sample_sensitivity", f"WITH {_SAMPLE} SELECT k AS sample, COUNT(*) AS n, ROUND(REGR_SLOPE(y, area), 9) AS slope FROM s, (SELECT UNNEST(['all', 'small', 'plain']) AS k) WHERE k = 'all' OR (k = 'small' AND area <= 25) OR (k = 'plain' AND discount <= 0.02) GROUP BY k")
def sample_sensitivity(spark, d):
    """M9: one fit over nested samples, each row once for every sample it is in."""
    member = F.array_compact(F.array(F.lit("all"), F.when(F.col("area") <= 25, "small"), F.when(F.col("discount") <= 0.02, "plain")))
    return _sample(spark, d).withColumn("sample", F.explode(member)).groupBy("sample").agg(F.count("*").alias("n"), F.round(F.regr_slope("y", "area"), 9).alias("slope"))


@query("group_models", f"WITH {_SAMPLE}, g AS (SELECT grp, COUNT(*) AS n, REGR_SLOPE(y, area) AS b, REGR_INTERCEPT(y, area) AS a, SQRT(REGR_SYY(y, area) * (1 - REGR_R2(y, area)) / (COUNT(*) - 2)) AS sigma FROM s GROUP BY 1), w AS (SELECT COUNT(*) AS n, REGR_SLOPE(y, area) AS b, REGR_INTERCEPT(y, area) AS a, SQRT(REGR_SYY(y, area) * (1 - REGR_R2(y, area)) / (COUNT(*) - 2)) AS sigma FROM s) SELECT grp, g.n, CASE WHEN g.n >= 2000 THEN 'LOCAL' ELSE 'GLOBAL' END AS basis, ROUND(CASE WHEN g.n >= 2000 THEN g.b ELSE w.b END, 8) AS slope, ROUND(CASE WHEN g.n >= 2000 THEN g.a ELSE w.a END, 8) AS intercept, ROUND(CASE WHEN g.n >= 2000 THEN g.sigma ELSE w.sigma END, 8) AS sigma FROM g, w")
def group_models(spark, d):
    """A model for each group with enough rows, else the global one."""
    m = M.group_models(_sample(spark, d), "y", ["area"], "grp", least_rows=2000)
    return m.select("grp", "n", "basis", F.round(F.get("coefs", F.lit(0)), 8).alias("slope"), F.round("intercept", 8).alias("intercept"), F.round("sigma", 8).alias("sigma"))


@query("fair_values", f"WITH {_SAMPLE}, g AS (SELECT grp, REGR_SLOPE(y, area) AS b, REGR_INTERCEPT(y, area) AS a, SQRT(REGR_SYY(y, area) * (1 - REGR_R2(y, area)) / (COUNT(*) - 2)) AS sigma FROM s GROUP BY 1), e AS (SELECT entity, grp, AVG(area) AS area FROM s GROUP BY ALL) SELECT entity, ROUND(EXP(a + b * area), 5) AS fair, ROUND(EXP(a + b * area - 1.96 * sigma), 5) AS fair_low, ROUND(EXP(a + b * area + 1.96 * sigma), 5) AS fair_high FROM e JOIN g USING (grp)")
def fair_values(spark, d):
    """Fair values with an interval from the group's model."""
    s = _sample(spark, d)
    e = s.groupBy("entity", "grp").agg(F.avg("area").alias("area"))
    f = M.fair_values(e, M.group_models(s, "y", ["area"], "grp", least_rows=3), "grp", ["area"])
    return f.select("entity", *(F.round(c, 5).alias(c) for c in ("fair", "fair_low", "fair_high")))


@query("residual_windows", f"WITH {_SAMPLE}, f AS (SELECT REGR_SLOPE(y, area) AS b, REGR_INTERCEPT(y, area) AS a, MAX(deal_date) AS last FROM s), r AS (SELECT entity, y - a - b * area AS r, deal_date > last - INTERVAL 6 MONTH AS w6, deal_date > last - INTERVAL 12 MONTH AS w12 FROM s, f) SELECT entity, ROUND(MEDIAN(r) FILTER (WHERE w6), 9) AS r6, ROUND(MEDIAN(r) FILTER (WHERE w12), 9) AS r12, ROUND(STDDEV_SAMP(r) FILTER (WHERE w12), 9) AS volatility FROM r WHERE w12 GROUP BY 1")
def residual_windows(spark, d):
    """Recent residuals of an entity and their volatility."""
    from ..operators.metrics import anchored, in_window

    s = _sample(spark, d)
    _, _, p = M.linear_fit(s, "y", ["area"])
    r = anchored(s.withColumn("r", F.col("y") - p), "deal_date").where(in_window("deal_date", 12))
    return r.groupBy("entity").agg(F.round(F.percentile(F.when(in_window("deal_date", 6), F.col("r")), 0.5), 9).alias("r6"), F.round(F.percentile("r", 0.5), 9).alias("r12"), F.round(F.stddev_samp("r"), 9).alias("volatility"))


@query("robust_scale", "WITH q AS (SELECT quantile_cont(c_acctbal, 0.05) AS lo, quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.5) AS m, quantile_cont(c_acctbal, 0.75) AS b, quantile_cont(c_acctbal, 0.95) AS hi FROM customer) SELECT c_custkey, ROUND((LEAST(GREATEST(c_acctbal, lo), hi) - m) / (b - a), 8) AS scaled, ROUND(1 / SQRT(COUNT(*) OVER (PARTITION BY c_nationkey)), 8) AS weight FROM customer, q")
def robust_scale(spark, d):
    """Winsorised and robustly scaled values, with weights that balance groups."""
    c = M.robust_scaled(table(spark, d, "customer"), ["c_acctbal"], (0.05, 0.95))
    return c.select("c_custkey", F.round("scaled_c_acctbal", 8).alias("scaled"), F.round(1 / F.sqrt(F.count("*").over(Window.partitionBy("c_nationkey"))), 8).alias("weight"))


@query("label_agreement", "WITH c AS (SELECT p_size % 3 AS a, p_partkey % 3 AS b, COUNT(*) AS n FROM part GROUP BY ALL), r AS (SELECT a, SUM(n) AS n FROM c GROUP BY 1), k AS (SELECT b, SUM(n) AS n FROM c GROUP BY 1), x AS (SELECT (SELECT SUM(n) FROM c) AS n, (SELECT SUM(n * (n - 1) / 2.0) FROM c) AS p, (SELECT SUM(n * (n - 1) / 2.0) FROM r) AS pa, (SELECT SUM(n * (n - 1) / 2.0) FROM k) AS pb) SELECT CAST(n AS BIGINT) AS n, ROUND((p - pa * pb / (n * (n - 1) / 2.0)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2.0)), 9) AS ari FROM x")
def label_agreement(spark, d):
    """Agreement of two labelings from their contingency table."""
    p = table(spark, d, "part").select((F.col("p_size") % 3).alias("a"), (F.col("p_partkey") % 3).alias("b"))
    return M.label_agreement(p, "a", "b").select("n", F.round("ari", 9).alias("ari"))


@query("value_gaps", f"WITH {ENTITIES}, g AS (SELECT entity, (price / AVG(price) OVER () - 1) * 100 AS residual, (price / AVG(price) OVER (PARTITION BY grp) - 1) * 100 AS comparable FROM e WHERE price IS NOT NULL) SELECT entity, ROUND((residual + comparable) / 2, 9) AS observed, SIGN(residual) = SIGN(comparable) AS agree FROM g")
def value_gaps(spark, d):
    """Value gaps from two methods, their mean and agreement."""
    e = entities(spark, d).where("price is not null")
    gap = lambda w: (F.col("price") / F.avg("price").over(w) - 1) * 100
    g = e.select("entity", gap(Window.partitionBy()).alias("a"), gap(Window.partitionBy("grp")).alias("b"))
    return g.select("entity", F.round((F.col("a") + F.col("b")) / 2, 9).alias("observed"), (F.signum("a") == F.signum("b")).alias("agree"))


@query("bootstrap_medians")
def bootstrap_medians(spark, d):
    """Stability of an entity's median under resampling by a hash."""
    t = trades(spark, d).select("entity", (F.col("unit") - 1000).alias("gap"))
    return M.bootstrap_medians(t, "entity", "gap", 500)


@query("cluster_range")
def cluster_range(spark, d):
    """Clusters over a range of k with three measures of quality, and the choice."""
    e = M.robust_scaled(entities(spark, d).where("price is not null"), ["score", "price", "area"])
    quality, _ = M.cluster_range(e, "entity", ["scaled_score", "scaled_price", "scaled_area"], range(3, 16))
    return M.chosen_k(quality, 3)


@query("mixture_bic")
def mixture_bic(spark, d):
    """Gaussian mixtures by their BIC."""
    e = M.robust_scaled(entities(spark, d).where("price is not null"), ["score", "price"])
    return M.mixture_bic(e, ["scaled_score", "scaled_price"], [2, 3])


@query("forest_comparison")
def forest_comparison(spark, d):
    """Random forests over feature sets on group hold-outs."""
    return M.forest_comparison(_sample(spark, d), "y", {"base": ["area"], "with_score": ["area", "score"]}, "entity", [42, 52, 62], trees=60, depth=16)


@query("spline_curve")
def spline_curve(spark, d):
    """A spline fit, and its effect relative to 50 over a grid of scores."""
    knots = [0.0, 25.0, 50.0, 75.0, 100.0]
    names = [f"b{i}" for i in range(len(knots) + 2)]
    basis = lambda x: dict(zip(names, M.spline_basis(x, knots), strict=True))
    s = _sample(spark, d).withColumn("x", F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("score"))))
    _, _, prediction = M.linear_fit(s.withColumns(basis(F.col("x"))), "y", names[1:])
    grid = spark.range(0, 101, 5).select(F.col("id").cast("double").alias("x"))
    curve = grid.withColumns(basis(F.col("x"))).withColumn("p", prediction)
    at = curve.where("x = 50").select(F.col("p").alias("p50"))
    return curve.crossJoin(F.broadcast(at)).select("x", ((F.exp(F.col("p") - F.col("p50")) - 1) * 100).alias("effect_pct"))  # one row


@query("group_performance", f"WITH {_SAMPLE}, f AS (SELECT REGR_SLOPE(y, area) AS b, REGR_INTERCEPT(y, area) AS a FROM s), e AS (SELECT grp, y, a + b * area - y AS e FROM s, f) SELECT grp, COUNT(*) AS n, ROUND(SQRT(AVG(e * e)), 8) AS rmse, ROUND(AVG(e), 8) AS bias, ROUND(1 - SUM(e * e) / (VAR_POP(y) * COUNT(*)), 8) AS r2 FROM e GROUP BY 1")
def group_performance(spark, d):
    """The performance of a model in each group."""
    s = _sample(spark, d)
    _, _, p = M.linear_fit(s, "y", ["area"])
    return M.evaluate(s.withColumn("p", p), "y", "p", ["grp"]).select("grp", "n", *(F.round(c, 8).alias(c) for c in ("rmse", "bias", "r2")))


@query("partial_dependence", f"WITH {_SAMPLE}, m AS (SELECT COVAR_POP(y, area) AS ya, COVAR_POP(y, discount) AS yd, VAR_POP(area) AS aa, VAR_POP(discount) AS dd, COVAR_POP(area, discount) AS ad, AVG(y) AS y, AVG(area) AS a, AVG(discount) AS d FROM s), c AS (SELECT (ya * dd - yd * ad) / (aa * dd - ad * ad) AS b1, (yd * aa - ya * ad) / (aa * dd - ad * ad) AS b2, y, a, d FROM m) SELECT CAST(g AS DOUBLE) AS area, ROUND(y + b1 * (g - a), 8) AS mean FROM c, (SELECT UNNEST([10, 20, 40]) AS g)")
def partial_dependence(spark, d):
    """The mean prediction over a grid of one column."""
    s = _sample(spark, d)
    _, _, p = M.linear_fit(s, "y", ["area", "discount"])
    grid = spark.range(1).select(F.explode(F.array(F.lit(10.0), F.lit(20.0), F.lit(40.0))).alias("area"))
    return M.partial_dependence(s, p, ["area"], grid).select("area", F.round("mean", 8).alias("mean"))


@query("feature_verdict", f"WITH {_FE}, b AS (SELECT REGR_SLOPE(y, x) AS b, REGR_R2(y, x) * 100 AS gain, REGR_SLOPE(y, x) / SQRT(REGR_SYY(y, x) * (1 - REGR_R2(y, x)) / (COUNT(*) - COUNT(DISTINCT grp) - 1) / REGR_SXX(y, x)) AS t FROM d) SELECT CASE WHEN b > 0 AND t > 1.96 AND gain >= 1 THEN 'STRONG' WHEN b > 0 AND gain > 0 AND gain < 0.5 THEN 'WEAK' WHEN b > 0 AND gain >= 0.5 THEN 'USEFUL' ELSE 'NOT_SUPPORTED' END AS verdict FROM b")
def feature_verdict(spark, d):
    """A verdict from a term's sign and gain."""
    fit = M.fixed_effect_ols(_sample(spark, d), "y", ["score"], "grp")
    return fit.select(M.verdict_of(F.col("coef"), F.col("p"), F.col("r2_within") * 100).alias("verdict"))
