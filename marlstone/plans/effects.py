"""Queries of a score's effect on prices: curves, model choice, premiums and value gaps. A group is a supplier's nation."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import written
from ..operators import effects as E
from ..operators import models as M
from ..operators.joins import banded_comparables
from ..operators.metrics import anchored, in_window
from .registry import TRADES, query, table, trades
from .systems import solved

CONTROLS = ["area", "discount"]


def _rows(spark, d) -> DataFrame:
    """Trades with the supplier's nation and score (0 to 100 and a little below), and whether they are of the latest quarter of dates."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("grp"), F.col("s_nationkey").alias("nation"), (F.col("s_acctbal") / 100).alias("score"))
    t = trades(spark, d).select("entity", "deal_date", "area", (F.col("discount") * 100).alias("discount"), "unit", F.ln("unit").alias("y"))
    rows = t.join(s, "entity").withColumn("grp", F.col("nation") % 5)
    return written(M.temporal_split(rows, "deal_date"), "effect-rows")


_SQL_ROWS = f"""{TRADES},
  x AS (SELECT t.entity, s_nationkey % 5 AS grp, s_nationkey AS nation, s_acctbal / 100 AS score, deal_date, area, discount * 100 AS discount, unit, LN(unit) AS y FROM t JOIN supplier ON s_suppkey = t.entity),
  cut AS (SELECT quantile_cont(DATE_DIFF('day', DATE '1970-01-01', deal_date), 0.75) AS cut FROM x)"""


def _part_rows(spark, d) -> DataFrame:
    """Trades with the part as the entity, its brand as the group, and twice its size, 2 to 100, as the score."""
    s = table(spark, d, "part").select(F.col("p_partkey").alias("entity"), F.col("p_brand").alias("grp"), (F.col("p_size") * 2.0).alias("score"))
    t = trades(spark, d).select(F.col("part").alias("entity"), "deal_date", "area", (F.col("discount") * 100).alias("discount"), "unit", F.ln("unit").alias("y"))
    return written(M.temporal_split(t.join(s, "entity"), "deal_date"), "effect-rows")


_SQL_PARTS = f"""{TRADES},
  x AS (SELECT t.part AS entity, p_brand AS grp, p_size * 2.0 AS score, deal_date, area, discount * 100 AS discount, unit, LN(unit) AS y FROM t JOIN part ON p_partkey = t.part),
  cut AS (SELECT quantile_cont(DATE_DIFF('day', DATE '1970-01-01', deal_date), 0.75) AS cut FROM x)"""


def _sql_basis(model: str, x: str) -> dict[str, str]:
    """score_basis() in SQL."""
    if model == "LINEAR":
        return {"score_10": f"(({x}) - 50) / 10.0"}
    if model == "QUADRATIC":
        return {"score_10": f"(({x}) - 50) / 10.0", "score_10_sq": f"(({x}) - 50) / 10.0 * (({x}) - 50) / 10.0"}
    if model == "BINNED":
        return {"bin_0": f"(({x}) < 20)::DOUBLE", "bin_1": f"(({x}) >= 20 AND ({x}) < 40)::DOUBLE", "bin_3": f"(({x}) >= 60 AND ({x}) < 80)::DOUBLE", "bin_4": f"(({x}) >= 80)::DOUBLE"}
    if model == "NONE":
        return {}
    near = f"LEAST(GREATEST(({x}), 0), 100)"

    def cubic(i: int, power: int) -> str:
        return "(" + " + ".join(f"{(-1) ** j * math.comb(4, j)} * pow(GREATEST(({near} - {(i - 3) * 20}) / 20.0 - {j}, 0), {power})" for j in range(5)) + f") / {6 if power == 3 else 2}"

    return {f"spline_{i}": f"{cubic(i, 3)} + (({x}) - {near}) * {cubic(i, 2)} / 20" for i in range(7)}


def _sql_fit(model: str, where: str = "true", name: str = "f", clustered: bool = True) -> str:
    """CTEs that end with `name` (w_0 ..., n, k, sse, yy) and `name`i (grp, intercept); `name`d has the demeaned rows."""
    basis = _sql_basis(model, "score")
    xs = ["area", "discount", *basis]
    q = len(xs)
    made = ", ".join(["area", "discount", *(f"{e} AS {c}" for c, e in basis.items())])
    demeaned = ", ".join(f"{c} - AVG({c}) OVER (PARTITION BY grp) AS z{i}" for i, c in enumerate(xs))
    sums = ", ".join([f"SUM(z{i} * z{j}) AS a_{i}_{j}" for i in range(q) for j in range(i, q)] + [f"SUM(z{i} * u) AS b_{i}" for i in range(q)] + [f"SUM(z{i} * u) AS c_{i}" for i in range(q)])
    fitted = " + ".join(f"w_{i} * z{i}" for i in range(q))
    level = " - ".join(["AVG(y)", *(f"ANY_VALUE(w_{i}) * AVG({c})" for i, c in enumerate(xs))])
    return f"""{name}b AS (SELECT entity, grp, y, {made} FROM x, cut WHERE {where}),
  {name}d AS (SELECT entity, grp, y, y - AVG(y) OVER (PARTITION BY grp) AS u, {demeaned} FROM {name}b),
  {name}n AS (SELECT 1 AS one, COUNT(*) AS n, COUNT(DISTINCT grp) + {q} AS k, SUM(u * u) AS uu, VAR_POP(y) * COUNT(*) AS yy, {sums} FROM {name}d),
  {solved(name + "s", name + "n", "one", q, "n, k, uu, yy")},
  {name} AS (SELECT *, (SELECT SUM((u - ({fitted})) * (u - ({fitted}))) FROM {name}d, {name}s) AS sse FROM {name}s),
  {name}i AS (SELECT grp, {level} AS intercept FROM {name}b, {name}s GROUP BY 1)"""


def _sql_curve(model: str, grid: str, name: str) -> str:
    """CTE `name`: (x, log_effect, error) over `grid` (x), after _sql_fit(model)."""
    here, there = _sql_basis(model, "x"), _sql_basis(model, "50")
    q = 2 + len(here)
    delta = ["0", "0", *(f"({here[c]}) - ({there[c]})" for c in here)]
    pull = " + ".join(f"v.w_{i} * s.s{i}" for i in range(q))
    scores = ", ".join(f"SUM(z{i} * (u - ({' + '.join(f'w_{j} * z{j}' for j in range(q))}))) AS s{i}" for i in range(q))
    clustered = model != "BINNED"
    square = (
        f"(SELECT SUM(({pull}) * ({pull})) * COUNT(*) / (COUNT(*) - 1) * ANY_VALUE(f.n - 1) / ANY_VALUE(f.n - f.k) FROM {name}c s, f)" if clustered
        else "(" + " + ".join(f"v.w_{i} * v.d_{i}" for i in range(q)) + ") * (SELECT sse / (n - k) FROM f)"
    )
    return f"""{name}g AS (SELECT x, {', '.join(f'{e} AS b_{i}, {e} AS d_{i}' for i, e in enumerate(delta))}, {', '.join(f'a_{i}_{j}' for i in range(q) for j in range(i, q))} FROM {grid}, fn),
  {solved(name + "v", name + "g", "x", q, ", ".join(f"d_{i}" for i in range(q)))},
  {name}c AS (SELECT entity, {scores} FROM fd, fs GROUP BY 1),
  {name} AS (SELECT x, {' + '.join(f'f.w_{i} * v.d_{i}' for i in range(q))} AS log_effect, sqrt(GREATEST({square}, 0)) AS error FROM {name}v v, f)"""


def _sql_curves(model: str) -> str:
    return f"""SELECT '{model}' AS model, x AS score, ROUND((EXP(log_effect) - 1) * 100, 5) AS effect_pct, ROUND((EXP(log_effect - 1.96 * error) - 1) * 100, 5) AS low_pct,
  ROUND((EXP(log_effect + 1.96 * error) - 1) * 100, 5) AS high_pct FROM (WITH {_sql_fit(model)}, gr AS (SELECT CAST(i AS DOUBLE) AS x FROM range(0, 101, 5) r(i)), {_sql_curve(model, "gr", "cv")} SELECT * FROM cv)"""


@query("effect_curves", f"WITH {_SQL_PARTS}\n" + "\nUNION ALL ".join(_sql_curves(m) for m in E.MODELS[1:]))
def effect_curves(spark, d):
    """Linear, quadratic, binned and spline curves against a reference score, with intervals by the delta method."""
    rows = _part_rows(spark, d)
    bases = {model: E.score_basis(F.col("score"), model) for model in E.MODELS[1:]}
    columns = {f"{model}_{c}": x for model, basis in bases.items() for c, x in basis.items()}
    moments = M.EffectMoments(written(rows.withColumns(columns), "effect-bases"), "y", [*CONTROLS, *columns], "grp", "entity")  # one pass for all
    grid, out = spark.range(0, 101, 5).select(F.col("id").cast("double").alias("score")), None
    for model, basis in bases.items():
        fit = moments.fit([*CONTROLS, *(f"{model}_{c}" for c in basis)], clustered=model != "BINNED")
        curve = E.effect_curve(replace(fit, xs=[*CONTROLS, *basis]), model, grid).select(F.lit(model).alias("model"), "score", *(F.round(c, 5).alias(c) for c in ("effect_pct", "low_pct", "high_pct")))
        out = curve if out is None else out.unionByName(curve)
    return out


def _sql_model(model: str) -> str:
    """One row of the comparison."""
    basis = _sql_basis(model, "score")
    xs = ["area", "discount", *basis.values()]
    p = lambda f: " + ".join(["COALESCE(i.intercept, (SELECT ARG_MIN(intercept, grp) FROM " + f + "i))", *(f"{f}s.w_{i} * ({e})" for i, e in enumerate(xs))])
    rising = "true"
    more = ""
    if basis:
        here = _sql_basis(model, "x")
        more = f""", lg AS (SELECT x, {' + '.join(f'fs.w_{i + 2} * ({e})' for i, e in enumerate(here.values()))} AS v FROM (SELECT CAST(i AS DOUBLE) AS x FROM range(0, 101) r(i)), fs),
  mo AS (SELECT COALESCE(MIN(v - w) >= -1e-7, true) AS rising FROM (SELECT v, LAG(v) OVER (ORDER BY x) AS w FROM lg))"""
        rising = "(SELECT rising FROM mo)"
    return f"""SELECT '{model}' AS model, CAST(k AS INT) AS parameters, 1 - sse / yy * (n - 1) / (n - k) AS adj_r2, n * (LN(sse / n) + 1 + LN(2 * PI())) + 2 * k AS aic, n * (LN(sse / n) + 1 + LN(2 * PI())) + k * LN(n) AS bic,
  sqrt(sse / n) AS rmse_in, mae_in, lt.rmse, lt.mae, lt.r2, lt.slope, lt.intercept, rising AS monotone FROM (WITH {_sql_fit(model)}, {_sql_fit(model, "DATE_DIFF('day', DATE '1970-01-01', deal_date) <= cut", "g")}{more}
  SELECT f.*, {rising} AS rising, (SELECT AVG(ABS(y - ({p("f")}))) FROM x LEFT JOIN fi i ON i.grp = x.grp, fs) AS mae_in,
    (SELECT {{'rmse': sqrt(AVG((y - p) * (y - p))), 'mae': AVG(ABS(y - p)), 'r2': 1 - SUM((y - p) * (y - p)) / (VAR_POP(y) * COUNT(*)), 'slope': REGR_SLOPE(y, p), 'intercept': REGR_INTERCEPT(y, p)}}
      FROM (SELECT y, {p("g")} AS p FROM x LEFT JOIN gi i ON i.grp = x.grp, gs, cut WHERE DATE_DIFF('day', DATE '1970-01-01', deal_date) > cut)) AS lt FROM f)"""


@query(
    "effect_models",
    f"WITH {_SQL_PARTS},\n  cm AS (" + "\nUNION ALL ".join(_sql_model(m) for m in E.MODELS) + """),
  ok AS (SELECT cm.*, cm.model NOT IN ('NONE', 'LINEAR') AND cm.monotone AND cm.rmse <= l.rmse * 0.995 AND cm.mae <= l.mae * 0.995 AS better FROM cm, cm l WHERE l.model = 'LINEAR'),
  pk AS (SELECT COALESCE((SELECT model FROM ok WHERE better ORDER BY rmse, mae, parameters LIMIT 1), 'LINEAR') AS pick)
SELECT model, parameters, ROUND(adj_r2, 8) AS adj_r2, ROUND(aic, 3) AS aic, ROUND(bic, 3) AS bic, ROUND(rmse_in, 8) AS rmse_in, ROUND(mae_in, 8) AS mae_in, ROUND(rmse, 8) AS rmse, ROUND(mae, 8) AS mae, ROUND(r2, 7) AS r2,
  ROUND(slope, 5) AS slope, ROUND(intercept, 4) AS intercept, monotone, model = pick AS chosen FROM ok, pk""",
)
def effect_models(spark, d):
    """The models of a score's effect in and out of sample, and the choice."""
    compared, _ = E.compared_models(_part_rows(spark, d), "y", CONTROLS, "grp", "entity")
    digits = {"adj_r2": 8, "aic": 3, "bic": 3, "rmse_in": 8, "mae_in": 8, "rmse": 8, "mae": 8, "r2": 7, "slope": 5, "intercept": 4}
    return compared.select("model", "parameters", "monotone", "chosen", *(F.round(c, k).alias(c) for c, k in digits.items()))


def _sql_premiums() -> str:
    """CTEs that end with `pm`: premiums of the linear model over the last year."""
    return f"""{_sql_fit("LINEAR")},
  pr AS (SELECT x.entity, score, EXP(intercept + w_0 * area + w_1 * discount + w_2 * (score - 50) / 10.0) * area AS a, EXP(intercept + w_0 * area + w_1 * discount) * area AS b
    FROM x JOIN fi ON fi.grp = x.grp, fs WHERE deal_date > (SELECT MAX(deal_date) FROM x) - INTERVAL 12 MONTH),
  pe AS (SELECT entity, COUNT(*) AS deals, ANY_VALUE(score) AS score, MEDIAN(b) AS baseline, MEDIAN(a) AS adjusted, LEAST(GREATEST(round_even(ANY_VALUE(score), 0), 0), 100) AS place FROM pr GROUP BY 1),
  gr AS (SELECT DISTINCT CAST(place AS DOUBLE) AS x FROM pe), {_sql_curve("LINEAR", "gr", "cv")},
  pm AS (SELECT entity, deals, score, baseline, adjusted, (adjusted / baseline - 1) * 100 AS premium_pct, adjusted - baseline AS premium_amount,
    (EXP(log_effect + 1.96 * error) - EXP(log_effect - 1.96 * error)) * 50 AS uncertainty_pct FROM pe JOIN cv ON cv.x = place)"""


def _premiums(spark, d, rows: DataFrame) -> DataFrame:
    fit = E.fitted_model(rows, "y", CONTROLS, "LINEAR", "grp", "entity")
    return E.premiums(anchored(rows, "deal_date"), fit, "LINEAR", "grp", "entity", "area", in_window("deal_date", 12))


@query(
    "score_premiums",
    f"""WITH {_SQL_ROWS}, {_sql_premiums()}
SELECT entity, deals, ROUND(baseline, 4) AS baseline, ROUND(adjusted, 4) AS adjusted, ROUND(premium_pct, 6) AS premium_pct, ROUND(premium_amount, 4) AS premium_amount, ROUND(uncertainty_pct, 6) AS uncertainty_pct FROM pm""",
)
def score_premiums(spark, d):
    """An entity's expected price with its own score and with the reference, by one fit, and the premium."""
    p = _premiums(spark, d, _rows(spark, d))
    digits = {"baseline": 4, "adjusted": 4, "premium_pct": 6, "premium_amount": 4, "uncertainty_pct": 6}
    return p.select("entity", "deals", *(F.round(c, k).alias(c) for c, k in digits.items()))


_SQL_GAPS = f"""{_sql_premiums()},
  me AS (SELECT entity, ANY_VALUE(nation) AS nation, ANY_VALUE(grp) AS grp, MEDIAN(unit) AS price, MEDIAN(unit * area) AS amount, AVG(area) AS area FROM x WHERE deal_date > (SELECT MAX(deal_date) FROM x) - INTERVAL 12 MONTH GROUP BY 1),
  pa AS (SELECT a.entity, b.price, a.nation = b.nation AND ABS(b.area / a.area - 1) <= 0.10 AS r1, a.nation = b.nation AND ABS(b.area / a.area - 1) <= 0.20 AS r2, a.nation = b.nation AS r3, ABS(b.area / a.area - 1) <= 0.20 AS r4
    FROM me a JOIN me b ON a.grp = b.grp AND a.entity <> b.entity),
  cp AS (SELECT entity, COUNT(*) FILTER (r1) AS n1, COUNT(*) FILTER (r2) AS n2, COUNT(*) FILTER (r3) AS n3, COUNT(*) FILTER (r4) AS n4,
    MEDIAN(price) FILTER (r1) AS m1, MEDIAN(price) FILTER (r2) AS m2, MEDIAN(price) FILTER (r3) AS m3, MEDIAN(price) FILTER (r4) AS m4 FROM pa GROUP BY 1),
  pc AS (SELECT me.entity, me.price, me.amount, CASE WHEN n1 >= 5 THEN 'STRICT' WHEN n2 >= 5 THEN 'RELAXED' WHEN n3 >= 5 THEN 'ALL_SAME_MARKET' WHEN n4 >= 5 THEN 'DISTRICT' ELSE 'NONE' END AS rule,
    CASE WHEN n1 >= 5 THEN n1 WHEN n2 >= 5 THEN n2 WHEN n3 >= 5 THEN n3 WHEN n4 >= 5 THEN n4 ELSE 0 END AS comparables,
    CASE WHEN n1 >= 5 THEN m1 WHEN n2 >= 5 THEN m2 WHEN n3 >= 5 THEN m3 WHEN n4 >= 5 THEN m4 END AS mid FROM me LEFT JOIN cp ON cp.entity = me.entity),
  vg AS (SELECT pm.entity, score, deals, premium_pct AS expected_pct, (amount / baseline - 1) * 100 AS residual_pct, (price / mid - 1) * 100 AS comparable_pct, rule, comparables, adjusted, amount,
    CASE WHEN score >= 50 THEN 'A' WHEN score >= 10 THEN 'B' ELSE 'C' END AS grade FROM pm JOIN pc ON pc.entity = pm.entity),
  vh AS (SELECT *, expected_pct - residual_pct AS residual_gap, expected_pct - comparable_pct AS comparable_gap, CASE WHEN comparable_pct IS NULL THEN residual_pct ELSE (residual_pct + comparable_pct) / 2 END AS observed_pct,
    COALESCE(SIGN(expected_pct - residual_pct) = SIGN(expected_pct - comparable_pct), false) AS same FROM vg),
  vi AS (SELECT *, expected_pct - observed_pct AS gap, CASE WHEN grade IN ('A', 'B') AND same AND deals >= 3 AND comparables >= 10 THEN 'HIGH' WHEN grade IN ('A', 'B') AND same AND deals >= 1 AND comparables >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
    CASE WHEN comparables < 5 THEN 'INSUFFICIENT_COMPARABLES' WHEN NOT same THEN 'METHOD_DIRECTION_DISAGREEMENT' ELSE 'OK' END AS quality FROM vh)"""


def _gaps(spark, d) -> DataFrame:
    """An entity's expected premium against what residuals and comparables observe."""
    rows = _rows(spark, d)
    recent = anchored(rows, "deal_date").where(in_window("deal_date", 12))
    me = recent.groupBy("entity").agg(F.first("nation").alias("nation"), F.first("grp").alias("grp"), F.first("score").alias("score"), F.percentile("unit", 0.5).alias("price"), F.percentile(F.col("unit") * F.col("area"), 0.5).alias("amount"), F.avg("area").alias("area"))
    me = written(me, "gap-entities")
    rules = [("STRICT", ["nation"], "area", 0.10), ("RELAXED", ["nation"], "area", 0.20), ("ALL_SAME_MARKET", ["nation"], None, 0.0), ("DISTRICT", [], "area", 0.20)]
    found = banded_comparables(me, "entity", "grp", rules, "price", 5, relative=True)
    met = _premiums(spark, d, rows).join(me, "entity").join(found, "entity", "left")
    grade = F.when(F.col("score") >= 50, "A").when(F.col("score") >= 10, "B").otherwise("C")
    told = met.withColumns({
        "expected_pct": F.col("premium_pct"), "residual_pct": (F.col("amount") / F.col("baseline") - 1) * 100, "comparable_pct": (F.col("price") / F.col("comparable") - 1) * 100,
        "grade": grade, "comparables": F.coalesce("matches", F.lit(0).cast("long")), "rule": F.coalesce("rule", F.lit("NONE")),
    })
    return E.value_gaps(told)


@query(
    "x16_value_gaps",
    f"""WITH {_SQL_ROWS}, {_SQL_GAPS}
SELECT entity, grade, rule, comparables, ROUND(expected_pct, 6) AS expected_pct, ROUND(residual_gap, 6) AS residual_gap, ROUND(comparable_gap, 6) AS comparable_gap, ROUND(observed_pct, 6) AS observed_pct, ROUND(gap, 6) AS gap,
  ROUND((adjusted / amount - 1) * 100, 6) AS total_gap, confidence, quality FROM vi""",
)
def x16_value_gaps(spark, d):
    """What a score is expected to be worth against what residuals and comparables show, and how sure that is."""
    g = _gaps(spark, d).withColumn("total_gap", (F.col("adjusted") / F.col("amount") - 1) * 100)
    return g.select("entity", "grade", "rule", "comparables", *(F.round(c, 6).alias(c) for c in ("expected_pct", "residual_gap", "comparable_gap", "observed_pct", "gap", "total_gap")), "confidence", "quality")


_SEGMENTS = {"ALL": "true", "LARGE": "area >= 25", "SMALL": "area < 25", "MIDDLE": "area BETWEEN 15 AND 35", "DISCOUNTED": "discount >= 5"}


@query(
    "residual_relations",
    f"""WITH {_SQL_ROWS}, {_sql_fit("NONE")},
  rs AS (SELECT x.*, y - (intercept + w_0 * area + w_1 * discount) AS r, (score - 50) / 10 AS z FROM x JOIN fi ON fi.grp = x.grp, fs),
  sg AS ({" UNION ALL ".join(f"SELECT '{name}' AS segment, entity, r, z FROM rs WHERE {test}" for name, test in _SEGMENTS.items())}),
  ft AS (SELECT segment, REGR_SLOPE(r, z) AS b, REGR_INTERCEPT(r, z) AS a, AVG(z) AS mz, REGR_SXX(r, z) AS zz, COUNT(*) AS n, COUNT(DISTINCT entity) AS g, REGR_R2(r, z) AS r2 FROM sg GROUP BY 1),
  cl AS (SELECT sg.segment, entity, SUM((z - mz) * (r - a - b * z)) AS s, AVG(z) AS ez, AVG(r) AS er FROM sg JOIN ft ON ft.segment = sg.segment GROUP BY 1, 2),
  me AS (SELECT segment, SUM(s * s) AS m, CORR(ez, er) AS pearson FROM cl GROUP BY 1)
SELECT ft.segment, n AS deals, g AS entities, ROUND(b, 8) AS coef, ROUND(sqrt(m * g / (g - 1) * (n - 1) / (n - 2)) / zz, 8) AS se, ROUND(b / (sqrt(m * g / (g - 1) * (n - 1) / (n - 2)) / zz), 5) AS t,
  ROUND(pearson, 7) AS pearson, ROUND(r2, 8) AS r2 FROM ft JOIN me ON me.segment = ft.segment""",
)
def residual_relations(spark, d):
    """The relation of what a model without the score leaves to the score, in each segment, from one pass."""
    rows = _rows(spark, d)
    fit = E.fitted_model(rows, "y", CONTROLS, "NONE", "grp", "entity")
    left = M.with_fit(rows, fit, "grp").withColumn("r", F.col("y") - F.col("fitted"))
    out = E.residual_relations(left, "r", "score", "entity", {name: F.expr(test) for name, test in _SEGMENTS.items()})
    return out.select("segment", "deals", "entities", F.round("coef", 8).alias("coef"), F.round("se", 8).alias("se"), F.round("t", 5).alias("t"), F.round("pearson", 7).alias("pearson"), F.round("r2", 8).alias("r2"))
