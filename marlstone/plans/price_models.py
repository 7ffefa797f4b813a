"""Queries of local price models with fallback pools, and of fair prices. A market is a nation, a district its region."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.order_statistics import exact_quantiles
from ..functions.staging import small_side, written
from ..operators import models as M
from ..operators import price_models as P
from ..operators.metrics import anchored, in_window
from .registry import TRADES, query, table, trades
from .systems import products, solved

DESIGN = P.Design("y", ("area", "discount", "score"), ("quarter", "flag"), "grp", "entity")
_EFFECTS = ("quarter=Q2", "quarter=Q3", "quarter=Q4", "flag=N", "flag=R")
_MODES = ("G", "L", "F1", "F2", "F3")


def _rows(spark, d) -> DataFrame:
    """Trades with their market, district and features, and whether they are among the latest quarter of dates."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("grp"), (F.col("s_acctbal") / 100).alias("score"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("grp"), F.col("n_regionkey").alias("district"))
    t = trades(spark, d).select("entity", "deal_date", "area", (F.col("discount") * 100).alias("discount"), F.concat(F.lit("Q"), F.quarter("deal_date")).alias("quarter"), "flag", "unit", F.ln("unit").alias("y"))
    return written(M.temporal_split(t.join(s, "entity").join(n, "grp"), "deal_date"), "price-rows")


def _markets(spark, d, counted: DataFrame) -> DataFrame:
    """A row for each market that has entities: recent counts of `counted`, medians of its entities, and where it lies."""
    recent = anchored(counted, "deal_date").where(in_window("deal_date", 12)).groupBy("grp").agg(F.count_distinct("entity").alias("entities"), F.count("*").alias("deals"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("grp"), (F.col("s_acctbal") / 100).alias("p0"), (F.col("s_suppkey") % 7).cast("double").alias("p1"))
    profile = exact_quantiles(s, ["grp"], ["p0", "p1"], [0.5]).select("grp", F.get("p0", F.lit(0)).alias("p0"), F.get("p1", F.lit(0)).alias("p1"))
    n = table(spark, d, "nation").select(
        F.col("n_nationkey").alias("grp"), F.col("n_regionkey").alias("district"), (35 + F.col("n_nationkey") / 50).alias("lat"), (129 + F.col("n_nationkey") % 7 / 20).alias("lon")
    )
    return n.join(profile, "grp").join(recent, "grp", "left")


def _pools(spark, d, counted: DataFrame) -> DataFrame:
    return written(P.market_pools(_markets(spark, d, counted), "grp", "district", "entities", "deals", ["p0", "p1"], "lat", "lon"), "pools")


def _reduced() -> str:
    """Sums of products of `one` and the columns over markets, less what a market's indicator explains; not for the first."""
    names = ["one", *_X]
    less = lambda u, v: f"SUM({u} * {v}) - CASE WHEN grp > (SELECT MIN(grp) FROM {{rows}}) THEN SUM({u}) * SUM({v}) / (COUNT(*) + 1) ELSE 0 END"
    a = [f"{less(names[i], names[j])} AS a_{i}_{j}" for i in range(9) for j in range(i, 9)]
    return ", ".join([*a, *(f"{less(names[i], 'yc')} AS b_{i}" for i in range(9))])


_X = ["xa", "xd", "xs", "q2", "q3", "q4", "fn", "fr"]
_SUMS9 = ", ".join([f"SUM(a_{i}_{j}){' + 1' if i == j and i else ''} AS a_{i}_{j}" for i in range(9) for j in range(i, 9)] + [f"SUM(b_{i}) AS b_{i}" for i in range(9)])
_SQL_ROWS = f"""{TRADES},
  x AS (SELECT t.entity, s_nationkey AS grp, n_regionkey AS district, deal_date, area, discount * 100 AS discount, s_acctbal / 100 AS score,
    'Q' || quarter(deal_date) AS quarter, flag, unit, LN(unit) AS y
    FROM t JOIN supplier ON s_suppkey = t.entity JOIN nation ON n_nationkey = s_nationkey),
  cut AS (SELECT quantile_cont(DATE_DIFF('day', DATE '1970-01-01', deal_date), 0.75) AS cut FROM x),
  tr AS (SELECT x.* FROM x, cut WHERE DATE_DIFF('day', DATE '1970-01-01', deal_date) <= cut),
  te AS (SELECT x.* FROM x, cut WHERE DATE_DIFF('day', DATE '1970-01-01', deal_date) > cut)"""


def _sql_pools(counted: str) -> str:
    """CTEs that end with `rule`: the pool of each market, by the recent trades of `counted`."""
    return f"""rec AS (SELECT grp, COUNT(DISTINCT entity) AS entities, COUNT(*) AS deals FROM {counted} WHERE deal_date > (SELECT MAX(deal_date) FROM {counted}) - INTERVAL 12 MONTH GROUP BY 1),
  prof AS (SELECT s_nationkey AS grp, MEDIAN(s_acctbal / 100) AS p0, MEDIAN(CAST(s_suppkey % 7 AS DOUBLE)) AS p1 FROM supplier GROUP BY 1),
  mk AS (SELECT prof.grp, n_regionkey AS district, 35 + n_nationkey / 50 AS lat, 129 + n_nationkey % 7 / 20 AS lon, p0, p1, COALESCE(entities, 0) AS entities, COALESCE(deals, 0) AS deals,
    COALESCE(entities, 0) >= 5 AND COALESCE(deals, 0) >= 100 AS ok FROM prof JOIN nation ON n_nationkey = prof.grp LEFT JOIN rec ON rec.grp = prof.grp),
  sc AS (SELECT MEDIAN(p0) AS m0, MEDIAN(p1) AS m1, COALESCE(NULLIF(quantile_cont(p0, 0.75) - quantile_cont(p0, 0.25), 0), 1) AS i0,
    COALESCE(NULLIF(quantile_cont(p1, 0.75) - quantile_cont(p1, 0.25), 0), 1) AS i1 FROM mk),
  z AS (SELECT mk.*, (p0 - m0) / i0 AS z0, (p1 - m1) / i1 AS z1 FROM mk, sc),
  pr AS (SELECT a.grp, b.grp AS other, a.ok, a.entities AS e0, a.deals AS r0, b.entities AS e, b.deals AS r, a.district = b.district AS same,
    sqrt(((a.z0 - b.z0) * (a.z0 - b.z0) + (a.z1 - b.z1) * (a.z1 - b.z1)) / 2) AS apart,
    111 * sqrt((b.lat - a.lat) * (b.lat - a.lat) + (b.lon - a.lon) * cos(radians(a.lat)) * (b.lon - a.lon) * cos(radians(a.lat))) AS km FROM z a, z b),
  l1 AS (SELECT grp, other, e0 + SUM(e) OVER w AS se, r0 + SUM(r) OVER w AS sr, ROW_NUMBER() OVER w AS place FROM pr
    WHERE same AND grp <> other AND NOT ok AND apart <= 1.5 WINDOW w AS (PARTITION BY grp ORDER BY apart, other)),
  st AS (SELECT grp, MIN(place) AS stop FROM l1 WHERE se >= 5 AND sr >= 100 GROUP BY 1),
  p1 AS (SELECT l1.grp, LIST(other) AS alike, MAX(se) AS e1, MAX(sr) AS r1 FROM l1 JOIN st USING (grp) WHERE place <= stop GROUP BY 1),
  p2 AS (SELECT grp, LIST(other ORDER BY other) AS pool, SUM(e) AS e2, SUM(r) AS r2 FROM pr WHERE same GROUP BY 1),
  p3 AS (SELECT grp, LIST(other ORDER BY other) AS pool, SUM(e) AS e3, SUM(r) AS r3 FROM pr WHERE km <= 10 AND apart <= 2 GROUP BY 1),
  lv AS (SELECT z.grp, district, z.ok, z.entities, z.deals, p1.alike, e1, r1, p2.pool AS pool2, e2, r2, p3.pool AS pool3, e3, r3,
    CASE WHEN z.ok THEN 0 WHEN alike IS NOT NULL THEN 1 WHEN e2 >= 5 AND r2 >= 100 THEN 2 WHEN r3 >= 100 THEN 3 ELSE 4 END AS level
    FROM z LEFT JOIN p1 USING (grp) LEFT JOIN p2 USING (grp) LEFT JOIN p3 USING (grp)),
  rule AS (SELECT grp, district, CAST(level AS INT) AS level, ok AS sufficient,
    CASE level WHEN 0 THEN [grp] WHEN 1 THEN list_sort(list_append(alike, grp)) WHEN 2 THEN pool2 WHEN 3 THEN pool3 END AS pool,
    CAST(CASE level WHEN 0 THEN entities WHEN 1 THEN e1 WHEN 2 THEN e2 WHEN 3 THEN e3 ELSE (SELECT SUM(entities) FROM mk) END AS BIGINT) AS pool_entities,
    CAST(CASE level WHEN 0 THEN deals WHEN 1 THEN r1 WHEN 2 THEN r2 WHEN 3 THEN r3 ELSE (SELECT SUM(deals) FROM mk) END AS BIGINT) AS pool_deals FROM lv)"""


def _sql_models(rows: str) -> str:
    """CTEs that end with `m`: the model of each market and mode, from `rows` and `rule`."""
    x = "area / ia AS xa, discount / id AS xd, score / isc AS xs"
    on = ", ".join(f"CAST(quarter = '{q}' AND '{q}' > q0 AS INT) AS {q.lower()}" for q in ("Q2", "Q3", "Q4")) + ", " + ", ".join(f"CAST(flag = '{f}' AND '{f}' > f0 AS INT) AS f{f.lower()}" for f in "NR")
    spread = ", ".join(f"COALESCE(NULLIF(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 0), 1) AS {i}" for c, i in (("area", "ia"), ("discount", "id"), ("score", "isc")))
    coefs = "w_0 / ia AS ca, w_1 / id AS cd, w_2 / isc AS cs, w_3 AS e2, w_4 AS e3, w_5 AS e4, w_6 AS en, w_7 AS er"
    fit = " - ".join(["y0", "w_0 * x_0", "w_1 * x_1", "w_2 * x_2", "w_3 * x_3", "w_4 * x_4", "w_5 * x_5", "w_6 * x_6", "w_7 * x_7"])
    means = ", ".join(f"AVG({c}) AS x_{i}" for i, c in enumerate(_X))
    left = "yy - (" + " + ".join(f"w_{i} * c_{i}" for i in range(8)) + ") - (" + " + ".join(f"w_{i} * w_{i}" for i in range(8)) + ")"
    kept = ", ".join(["n", "members", "y0", "yy", "ia", "id", "isc", *(f"x_{i}" for i in range(8)), *(f"c_{i}" for i in range(8))])
    reduced = _reduced().replace("{rows}", "z3")
    shared = "one + w_1 * xa + w_2 * xd + w_3 * xs + w_4 * q2 + w_5 * q3 + w_6 * q4 + w_7 * fn + w_8 * fr".replace("one +", "w_0 +")
    return f"""names AS (SELECT grp, 'L|' || grp AS own, 'F1|' || district AS whole, CASE level WHEN 0 THEN 'L|' || grp WHEN 2 THEN 'F1|' || district WHEN 4 THEN 'G' ELSE 'F2|' || grp END AS near, sufficient FROM rule),
  mem AS (SELECT DISTINCT 'G' AS pool, grp FROM {rows} UNION ALL SELECT own, grp FROM names WHERE sufficient UNION ALL SELECT 'F1|' || district, grp FROM rule
    UNION ALL SELECT 'F2|' || grp, UNNEST(pool) FROM rule WHERE level IN (1, 3)),
  pr0 AS (SELECT pool, {rows}.* FROM {rows} JOIN mem USING (grp)),
  sp AS (SELECT pool, {spread}, MIN(quarter) AS q0, MIN(flag) AS f0, COUNT(DISTINCT entity) AS members FROM pr0 GROUP BY 1),
  dx AS (SELECT pr0.pool, y, members, ia, id, isc, {x}, {on} FROM pr0 JOIN sp USING (pool)),
  ne0 AS (SELECT pool, COUNT(*) AS n, ANY_VALUE(members) AS members, AVG(y) AS y0, COUNT(*) * VAR_POP(y) AS yy, ANY_VALUE(ia) AS ia, ANY_VALUE(id) AS id, ANY_VALUE(isc) AS isc, {means},
    {products(_X, "y", "1")} FROM dx GROUP BY 1),
  ne AS (SELECT *, {', '.join(f'b_{i} AS c_{i}' for i in range(8))} FROM ne0),
  {solved("so", "ne", "pool", 8, kept)},
  mo AS (SELECT pool, n, members, {fit} AS intercept, {coefs}, sqrt(GREATEST(0, {left}) / (n - 1)) AS sigma FROM so),
  y3 AS (SELECT AVG(y) AS ym FROM {rows}),
  z3 AS (SELECT grp, 1 AS one, y - ym AS yc, ia, id, isc, {x}, {on} FROM {rows}, y3, sp WHERE pool = 'G'),
  g3 AS (SELECT grp, {reduced} FROM z3 GROUP BY 1),
  n3 AS (SELECT 1 AS k, {_SUMS9} FROM g3),
  {solved("t3", "n3", "k", 9)},
  r3_ AS (SELECT grp, yc - ({shared}) AS r FROM z3, t3),
  d3 AS (SELECT grp, CASE WHEN grp > (SELECT MIN(grp) FROM z3) THEN SUM(r) / (COUNT(*) + 1) ELSE 0 END AS effect FROM r3_ GROUP BY 1),
  s3 AS (SELECT sqrt(SUM((r - effect) * (r - effect)) / (COUNT(*) - 1)) AS sigma, COUNT(*) AS n FROM r3_ JOIN d3 USING (grp)),
  mo3 AS (SELECT s3.n, sp.members, w_0 + ym AS intercept, w_1 / ia AS ca, w_2 / id AS cd, w_3 / isc AS cs, w_4 AS e2, w_5 AS e3, w_6 AS e4, w_7 AS en, w_8 AS er, sigma FROM t3, s3, y3, sp WHERE pool = 'G'),
  md AS (SELECT grp, UNNEST(['G', 'L', 'F1', 'F2']) AS mode, UNNEST(['G', CASE WHEN sufficient THEN own END, whole, near]) AS pool FROM names),
  m AS (SELECT grp, mode, CASE WHEN mode = 'G' OR own.pool IS NOT NULL THEN mode ELSE 'GLOBAL_FALLBACK' END AS basis, u.* EXCLUDE (pool)
    FROM md LEFT JOIN mo own ON own.pool = md.pool AND own.n >= 30 AND own.members >= 2 JOIN mo u ON u.pool = COALESCE(own.pool, 'G')
    UNION ALL SELECT names.grp, 'F3', 'F3', n, members, intercept + COALESCE(effect, 0), ca, cd, cs, e2, e3, e4, en, er, sigma FROM names LEFT JOIN d3 USING (grp), mo3)"""


@query(
    "fallback_pools",
    f"""WITH {_SQL_ROWS}, {_sql_pools("tr")}
SELECT grp, district, level, CASE level WHEN 0 THEN 'SAME_MARKET_SUFFICIENT' WHEN 1 THEN 'SAME_DISTRICT_SIMILAR_PROFILE' WHEN 2 THEN 'SAME_DISTRICT'
  WHEN 3 THEN 'ADJACENT_COMPATIBLE_MARKET' ELSE 'GLOBAL' END AS reason, COALESCE(array_to_string(pool, ','), '') AS pool, pool_entities, pool_deals, sufficient FROM rule""",
)
def fallback_pools(spark, d):
    """The narrowest pool of markets with enough recent trades, from districts, profiles and distance."""
    rule = _pools(spark, d, _rows(spark, d).where("not is_test"))
    return rule.withColumn("pool", F.concat_ws(",", F.col("pool").cast("array<string>")))


@query(
    "pool_price_models",
    f"""WITH {_SQL_ROWS}, {_sql_pools("tr")}, {_sql_models("tr")}
SELECT grp, mode, basis, CAST(n AS BIGINT) AS n, CAST(members AS BIGINT) AS entities, ROUND(intercept, 7) AS intercept, ROUND(ca, 8) AS c_area, ROUND(cd, 8) AS c_discount, ROUND(cs, 8) AS c_score,
  ROUND(e2, 7) AS q2, ROUND(e3, 7) AS q3, ROUND(e4, 7) AS q4, ROUND(en, 7) AS flag_n, ROUND(er, 7) AS flag_r, ROUND(sigma, 7) AS sigma FROM m""",
)
def pool_price_models(spark, d):
    """The ridge model of each market by pool (G, L, F1, F2) and by partial pooling (F3), from cells of sums."""
    rows = _rows(spark, d).where("not is_test")
    m = P.models_by_mode(rows, _pools(spark, d, rows), DESIGN, "district")
    coef = [F.round(F.get("coefs", F.lit(i)), 8).alias(f"c_{c}") for i, c in enumerate(DESIGN.numbers)]
    effect = [F.round(F.coalesce(F.element_at("effects", e), F.lit(0.0)), 7).alias(name) for e, name in zip(_EFFECTS, ("q2", "q3", "q4", "flag_n", "flag_r"), strict=True)]
    return m.select("grp", "mode", "basis", "n", "entities", F.round("intercept", 7).alias("intercept"), *coef, *effect, F.round("sigma", 7).alias("sigma"))


_SQL_FIT = "intercept + ca * area + cd * discount + cs * score + e2 * (quarter = 'Q2')::INT + e3 * (quarter = 'Q3')::INT + e4 * (quarter = 'Q4')::INT + en * (flag = 'N')::INT + er * (flag = 'R')::INT"
_SQL_OPERATIONAL = """om AS (SELECT grp, mode, m.* EXCLUDE (grp, mode) FROM m UNION ALL
    SELECT m.grp, 'O_' || c, m.* EXCLUDE (grp, mode) FROM m JOIN rule USING (grp), (SELECT UNNEST(['F1', 'F2', 'F3']) AS c) WHERE CASE WHEN sufficient THEN mode = 'L' ELSE mode = c END)"""


@query(
    "pool_model_performance",
    f"""WITH {_SQL_ROWS}, {_sql_pools("tr")}, {_sql_models("tr")}, {_SQL_OPERATIONAL},
  sco AS (SELECT mode, te.grp, entity, y, {_SQL_FIT} AS p FROM te JOIN om ON om.grp = te.grp),
  ev AS (SELECT mode, AVG(s) AS s FROM (SELECT mode, entity, AVG((y - p) * (y - p)) AS s FROM sco GROUP BY ALL) GROUP BY 1),
  mv AS (SELECT mode, AVG(s) AS s FROM (SELECT mode, grp, AVG((y - p) * (y - p)) AS s FROM sco GROUP BY ALL) GROUP BY 1)
SELECT sco.mode, COUNT(*) AS n, COUNT(DISTINCT entity) AS entities, ROUND(SQRT(AVG((y - p) * (y - p))), 7) AS rmse, ROUND(AVG(ABS(y - p)), 7) AS mae, ROUND(AVG(ABS(EXP(p - y) - 1)), 7) AS mape,
  ROUND(1 - SUM((y - p) * (y - p)) / (VAR_POP(y) * COUNT(*)), 7) AS r2, ROUND(REGR_SLOPE(y, p), 5) AS slope, ROUND(REGR_INTERCEPT(y, p), 4) AS intercept,
  ROUND(SQRT(ANY_VALUE(ev.s)), 7) AS entity_rmse, ROUND(SQRT(ANY_VALUE(mv.s)), 7) AS market_rmse FROM sco JOIN ev ON ev.mode = sco.mode JOIN mv ON mv.mode = sco.mode GROUP BY 1""",
)
def pool_model_performance(spark, d):
    """The models of all modes, and a market's own model with each fallback (O_), judged on the later trades."""
    rows = _rows(spark, d)
    train = rows.where("not is_test")
    pools = _pools(spark, d, train)
    m = P.with_operational(P.models_by_mode(train, pools, DESIGN, "district"), pools, "grp")
    p = P.performance(_scored(rows.where("is_test"), m), "y", "p", "entity", "grp", ["mode"])
    digits = {"rmse": 7, "mae": 7, "mape": 7, "r2": 7, "slope": 5, "intercept": 4, "entity_rmse": 7, "market_rmse": 7}
    return p.select("mode", "n", "entities", *(F.round(c, k).alias(c) for c, k in digits.items()))


def _scored(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Rows with each mode's prediction `p` of their market."""
    return rows.join(small_side(models.drop("n", "entities", "sigma", "basis"), 600), "grp").withColumn("p", P.predicted(DESIGN)).drop("intercept", "coefs", "effects")


def _fair_prices(spark, d) -> tuple[DataFrame, DataFrame]:
    """(a row for each entity with its fair price, all trades with their residual): X19 over all trades."""
    rows = _rows(spark, d)
    train = rows.where("not is_test")
    pools = _pools(spark, d, train)
    thin = rows.where("is_test").join(pools.where("not sufficient").select("grp"), "grp", "left_semi")
    models = P.models_by_mode(train, pools, DESIGN, "district").where(F.col("mode").isin("F1", "F2", "F3"))
    fallback = P.chosen_fallback(P.performance(_scored(thin, models), "y", "p", "entity", "grp", ["mode"]))
    now = _pools(spark, d, rows)
    takes = f"O_{fallback}"
    models = P.with_operational(P.models_by_mode(rows, now, DESIGN, "district"), now, "grp", [fallback]).where(F.col("mode") == takes)
    models = written(models, "fair-models")
    residuals = written(_scored(rows, models).withColumn("residual", F.col("y") - F.col("p")), "fair-residuals")
    last = anchored(residuals, "deal_date")
    e = last.groupBy("entity", "grp").agg(
        *(F.avg(c).alias(c) for c in DESIGN.numbers),
        F.max("flag").alias("flag"),
        F.concat(F.lit("Q"), F.quarter(F.max("_last"))).alias("quarter"),
        F.count("*").alias("own_deals"),
        F.count_if(in_window("deal_date", 12)).alias("deals_12m"),
        F.percentile(F.when(in_window("deal_date", 12), F.col("residual")), 0.5).alias("recent_residual"),
        F.percentile(F.when(in_window("deal_date", 6), F.col("residual")), 0.5).alias("residual_6m"),
        F.stddev_samp("residual").alias("volatility"),
        *(F.percentile(F.when(in_window("deal_date", k), F.col("unit")), 0.5).alias(f"price_{k}m") for k in (6, 12)),
    )
    # entities and deals of each market's pool, over all trades
    per = rows.groupBy("grp").agg(F.count_distinct("entity").alias("_e"), F.count("*").alias("_r"))
    whole = per.agg(F.sum("_e").alias("_ae"), F.sum("_r").alias("_ar"))
    inside = now.select("grp", "level", F.explode_outer("pool").alias("_o")).join(per.withColumnRenamed("grp", "_o"), "_o", "left")
    pooled = inside.groupBy("grp", "level").agg(F.sum("_e").alias("_pe"), F.sum("_r").alias("_pr")).crossJoin(F.broadcast(whole))  # one row
    far = F.col("level") == 4
    pooled = pooled.select("grp", "level", F.when(far, F.col("_ae")).otherwise(F.coalesce("_pe", F.lit(0))).alias("_pe"), F.when(far, F.col("_ar")).otherwise(F.coalesce("_pr", F.lit(0))).alias("_pr"))
    met = e.join(models.select("grp", "basis", "intercept", "coefs", "effects", "sigma"), "grp").join(pooled, "grp")
    fair = met.withColumn("_p", P.predicted(DESIGN)).withColumns(
        {"fair": F.exp("_p"), "fair_low": F.exp(F.col("_p") - 1.96 * F.col("sigma")), "fair_high": F.exp(F.col("_p") + 1.96 * F.col("sigma")), "comparable_entities": F.col("_pe") - 1, "comparable_deals": F.col("_pr") - F.col("own_deals")}
    )
    width = (F.col("fair_high") - F.col("fair_low")) / F.col("fair") * 100
    sure = R.first_match([((F.col("level") == 0) & (F.col("comparable_entities") >= 5) & (width <= 100), "HIGH"), ((F.col("level") <= 2) & (F.col("comparable_entities") >= 3) & (width <= 160), "MEDIUM")], "LOW")
    fair = fair.withColumns({"width_pct": width, "confidence": sure, "fallback": F.lit(fallback), "quality": F.when(width > 160, "WIDE_INTERVAL").otherwise("OK")})
    return written(fair.drop("coefs", "effects", "_p", "_pe", "_pr"), "fair-prices"), residuals


_SQL_FAIR = f"""{_SQL_ROWS},
  fp AS (WITH {_sql_pools("tr")}, {_sql_models("tr")}
    SELECT mode, SQRT(AVG((y - ({_SQL_FIT})) * (y - ({_SQL_FIT})))) AS rmse, AVG(ABS(y - ({_SQL_FIT}))) AS mae
    FROM te JOIN m ON m.grp = te.grp JOIN rule ON rule.grp = te.grp WHERE NOT sufficient AND mode IN ('F1', 'F2', 'F3') GROUP BY 1),
  f12 AS (SELECT CASE WHEN b.rmse <= a.rmse * 0.99 AND b.mae < a.mae THEN 'F2' ELSE 'F1' END AS c FROM (SELECT 1) LEFT JOIN fp a ON a.mode = 'F1' LEFT JOIN fp b ON b.mode = 'F2'),
  ch AS (SELECT CASE WHEN b.rmse <= a.rmse * 0.99 AND b.mae < a.mae THEN 'F3' ELSE c END AS c FROM f12 LEFT JOIN fp a ON a.mode = c LEFT JOIN fp b ON b.mode = 'F3'),
  {_sql_pools("x")}, {_sql_models("x")},
  om AS (SELECT m.* FROM m JOIN rule USING (grp), ch WHERE CASE WHEN sufficient THEN mode = 'L' ELSE mode = c END),
  res AS (SELECT x.*, y - ({_SQL_FIT}) AS residual, MAX(deal_date) OVER () AS last FROM x JOIN om ON om.grp = x.grp),
  en AS (SELECT entity, grp, AVG(area) AS area, AVG(discount) AS discount, AVG(score) AS score, MAX(flag) AS flag, 'Q' || quarter(ANY_VALUE(last)) AS quarter, COUNT(*) AS own_deals,
    COUNT(*) FILTER (deal_date > last - INTERVAL 12 MONTH) AS deals_12m, MEDIAN(residual) FILTER (deal_date > last - INTERVAL 12 MONTH) AS recent_residual,
    MEDIAN(residual) FILTER (deal_date > last - INTERVAL 6 MONTH) AS residual_6m, STDDEV_SAMP(residual) AS volatility,
    MEDIAN(unit) FILTER (deal_date > last - INTERVAL 6 MONTH) AS price_6m, MEDIAN(unit) FILTER (deal_date > last - INTERVAL 12 MONTH) AS price_12m FROM res GROUP BY 1, 2),
  pm AS (SELECT grp, COUNT(DISTINCT entity) AS e, COUNT(*) AS r FROM x GROUP BY 1),
  po AS (SELECT rule.grp, level, COALESCE(SUM(e), 0) AS e, COALESCE(SUM(r), 0) AS r FROM rule LEFT JOIN pm ON CASE WHEN level = 4 THEN true ELSE list_contains(pool, pm.grp) END GROUP BY 1, 2),
  fa AS (SELECT en.*, basis, level, sigma, e - 1 AS comparable_entities, r - own_deals AS comparable_deals, {_SQL_FIT} AS p FROM en JOIN om ON om.grp = en.grp JOIN po ON po.grp = en.grp),
  fair AS (SELECT *, EXP(p) AS fair, EXP(p - 1.96 * sigma) AS fair_low, EXP(p + 1.96 * sigma) AS fair_high, (EXP(p + 1.96 * sigma) - EXP(p - 1.96 * sigma)) / EXP(p) * 100 AS width_pct FROM fa),
  fx AS (SELECT *, CASE WHEN level = 0 AND comparable_entities >= 5 AND width_pct <= 100 THEN 'HIGH' WHEN level <= 2 AND comparable_entities >= 3 AND width_pct <= 160 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM fair)"""


@query(
    "x19_local_fair_prices",
    f"""WITH {_SQL_FAIR}
SELECT entity, grp, level, basis, c AS fallback, ROUND(fair, 4) AS fair, ROUND(fair_low, 4) AS fair_low, ROUND(fair_high, 4) AS fair_high, ROUND(width_pct, 4) AS width_pct,
  CAST(comparable_entities AS BIGINT) AS comparable_entities, CAST(comparable_deals AS BIGINT) AS comparable_deals, deals_12m, ROUND(recent_residual, 7) AS recent_residual, ROUND(volatility, 7) AS volatility, confidence,
  CASE WHEN width_pct > 160 THEN 'WIDE_INTERVAL' ELSE 'OK' END AS quality FROM fx, ch""",
)
def x19_local_fair_prices(spark, d):
    """Fair prices with intervals from a market's own model or the chosen fallback, and how far they can be trusted."""
    fair, _ = _fair_prices(spark, d)
    digits = {"fair": 4, "fair_low": 4, "fair_high": 4, "width_pct": 4, "recent_residual": 7, "volatility": 7}
    plain = ("entity", "grp", "level", "basis", "fallback", "comparable_entities", "comparable_deals", "deals_12m", "confidence", "quality")
    return fair.select(*plain, *(F.round(c, k).alias(c) for c, k in digits.items()))
