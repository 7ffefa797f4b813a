"""Composite queries: whole analyses made of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranks as R
from ..functions import rules as P
from ..operators import joins as J
from ..operators import metrics as A
from ..operators import models as M
from .registry import ENTITIES, TRADES, entities, query, table, trades


@query("x1_master_build", "WITH p AS (SELECT l_partkey AS k, CAST(SUM(l_quantity) AS BIGINT) AS units, COUNT(*) AS n FROM lineitem GROUP BY 1), m AS (SELECT p_partkey AS k, p_brand, p_type, p_size * 25 AS registered, units FROM part LEFT JOIN p ON k = p_partkey) SELECT k, COALESCE(units, 0) AS units, CASE WHEN regexp_matches(p_type, 'ECONOMY') THEN 'PENDING' WHEN units IS NULL THEN 'PENDING' WHEN ABS(units - registered) > 100 THEN 'PENDING' ELSE 'VERIFIED' END AS status, CASE WHEN regexp_matches(p_type, 'ECONOMY') THEN 'EXCLUDED_TYPE' WHEN units IS NULL THEN 'NO_UNITS' WHEN ABS(units - registered) > 100 THEN 'SUM_MISMATCH' END AS reason FROM m")
def x1_master_build(spark, d):
    """Units by entity against a registry, routed to verified or pending with the first reason."""
    units = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.sum("l_quantity").cast("long").alias("units"))
    registry = table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_type", (F.col("p_size") * 25).alias("registered"))
    checks = [(~F.col("p_type").rlike("ECONOMY"), "EXCLUDED_TYPE", "drop"), (F.col("units").isNotNull(), "NO_UNITS", "collect"), (F.abs(F.col("units") - F.col("registered")) <= 100, "SUM_MISMATCH", "review")]
    return registry.join(units, "k", "left").withColumn("g", P.gate(checks)).select("k", F.coalesce("units", F.lit(0)).alias("units"), "g.status", "g.reason")


@query("x3_master_audit", "WITH i AS (SELECT 'NEGATIVE' AS code, COUNT(*) AS n FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'ORPHAN', COUNT(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'LARGE', COUNT(*) FROM orders WHERE o_totalprice > 400000) SELECT code, n, CASE WHEN code = 'ORPHAN' AND n > 0 THEN 'FAIL' WHEN n > 0 THEN 'WARN' ELSE 'PASS' END AS verdict FROM i")
def x3_master_audit(spark, d):
    """Audits of a master as an issue table with verdicts."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    lost = o.join(c.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti")
    parts = [("NEGATIVE", c.where("c_acctbal < 0")), ("ORPHAN", lost), ("LARGE", o.where("o_totalprice > 400000"))]
    out = None
    for code, rows in parts:
        one = rows.agg(F.count("*").alias("n")).select(F.lit(code).alias("code"), "n")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("verdict", P.first_match([((F.col("code") == "ORPHAN") & (F.col("n") > 0), "FAIL"), (F.col("n") > 0, "WARN")], "PASS"))


@query("x4_capitalisation_ladder", f"WITH {TRADES}, w AS (SELECT MAX(deal_date) AS last FROM t), m AS (SELECT part AS k, COUNT(*) FILTER (WHERE deal_date > last - INTERVAL 3 MONTH) AS n3, MEDIAN(unit) FILTER (WHERE deal_date > last - INTERVAL 3 MONTH) AS m3, COUNT(*) FILTER (WHERE deal_date > last - INTERVAL 6 MONTH) AS n6, MEDIAN(unit) FILTER (WHERE deal_date > last - INTERVAL 6 MONTH) AS m6, COUNT(*) AS n12, MEDIAN(unit) AS m12 FROM t, w WHERE deal_date > last - INTERVAL 12 MONTH GROUP BY 1), p AS (SELECT p_partkey, p_brand, p_size, CASE WHEN n3 >= 3 THEN m3 WHEN n6 >= 3 THEN m6 WHEN n12 >= 1 THEN m12 END AS price, CASE WHEN n3 >= 3 THEN 1 WHEN n6 >= 3 THEN 2 WHEN n12 >= 1 THEN 3 ELSE 4 END AS g FROM part LEFT JOIN m ON k = p_partkey) SELECT p_brand, ROUND(SUM(p_size * price), 3) AS cap, ROUND(SUM(CASE WHEN price IS NOT NULL THEN p_size ELSE 0 END) / SUM(p_size), 9) AS coverage, CASE MAX(g) WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 3 THEN 'C' ELSE 'INCOMPLETE' END AS grade FROM p GROUP BY 1")
def x4_capitalisation_ladder(spark, d):
    """Capitalisation at ladder prices, with the worst grade of the parts."""
    w = A.adaptive_window(A.multi_window(trades(spark, d).withColumnRenamed("part", "k"), "k", "deal_date", "unit", [3, 6, 12]), [(3, 3, "A"), (6, 3, "B"), (12, 1, "C")])
    p = table(spark, d, "part").join(w.select(F.col("k").alias("p_partkey"), "value", "grade"), "p_partkey", "left").withColumn("grade", F.coalesce("grade", F.lit("INCOMPLETE")))
    cap = A.capitalisation(p, "p_brand", "p_size", "value").join(A.worst_level(p, "p_brand", "grade", ["A", "B", "C", "INCOMPLETE"]), "p_brand")
    return cap.select("p_brand", F.round("cap", 3).alias("cap"), F.round("coverage", 9).alias("coverage"), "grade")


@query("x5_entity_score", "WITH y AS (SELECT o_custkey AS k, CAST(YEAR(o_orderdate) AS INT) AS yr, COUNT(*) AS n, AVG(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END) AS rate FROM orders GROUP BY ALL), s AS (SELECT k, yr, (n * rate + 5 * (SUM(rate * n) OVER (PARTITION BY yr) / SUM(n) OVER (PARTITION BY yr))) / (n + 5) AS shrunk FROM y), w AS (SELECT *, CASE yr WHEN 2001 THEN 0.5 WHEN 2000 THEN 0.3 WHEN 1999 THEN 0.2 END AS w FROM s), r AS (SELECT k, ROUND(SUM(w * shrunk) / SUM(w), 9) AS recent FROM w GROUP BY 1 HAVING SUM(w) IS NOT NULL) SELECT k, recent, ROUND(100.0 * (RANK() OVER (ORDER BY recent) + (COUNT(*) OVER (PARTITION BY recent) - 1) / 2.0) / COUNT(*) OVER (), 9) AS score, RANK() OVER (ORDER BY recent DESC) AS place FROM r")
def x5_entity_score(spark, d):
    """Yearly rates shrunk, weighted by age, ranked."""
    y = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("yr")).agg(F.count("*").alias("n"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("rate"))
    s = A.shrunk_rates(y, "k", "yr", "rate", "n", 5.0)
    r = A.recency_weighted(s, "k", "yr", "shrunk", 2001, [0.5, 0.3, 0.2]).where("recent is not null").select("k", F.round("recent", 9).alias("recent"))
    return r.select("k", "recent", F.round(R.percentile_rank("recent"), 9).alias("score"), R.min_rank_desc("recent").cast("long").alias("place"))


@query("x6_relation_scores", "WITH o AS (SELECT o_orderkey, o_custkey AS k, o_totalprice / 5000 AS score, o_orderstatus AS kind, CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.8 ELSE 0.5 END AS w, CASE o_orderstatus WHEN 'F' THEN 100 WHEN 'O' THEN 85 ELSE 65 END AS q FROM orders), s AS (SELECT k, SUM(score * w) / SUM(w) AS mean, MIN(score) AS low, SUM(q * w) / SUM(w) AS q, LEAST(1, 0.4 * SUM(CASE WHEN kind = 'F' THEN w ELSE 0 END) / SUM(w) + 0.3 / COUNT(DISTINCT o_orderkey) + 0.3 * SUM(CASE WHEN kind <> 'P' THEN w ELSE 0 END) / SUM(w)) AS x FROM o GROUP BY 1), c AS (SELECT k, ROUND(GREATEST(0, LEAST(100, 0.65 * mean + 0.15 * low + 10 * x + 0.1 * q)) + 2e-9, 7) AS composite FROM s) SELECT k, composite, RANK() OVER (ORDER BY composite DESC) AS place, CASE WHEN composite >= 60 THEN 'A' WHEN composite >= 50 THEN 'B' WHEN composite >= 40 THEN 'C' ELSE 'D' END AS grade FROM c")
def x6_relation_scores(spark, d):
    """Relations with weights by type to composite scores, ranks and grades."""
    kinds = {"F": "EXACT", "O": "ELIGIBLE", "P": "CONDITIONAL"}
    kind = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))[F.col("o_orderstatus")]
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("member"), (F.col("o_totalprice") / 5000).alias("score"), kind.alias("kind"))
    o = o.withColumns({"w": A.by_kind(F.col("kind"), A.RELATION_WEIGHTS), "q": A.by_kind(F.col("kind"), A.RELATION_QUALITY)})
    s = A.feeder_scores(o, "k", "member", "kind", "score", "w", "q").select("k", F.round(F.col("composite") + 2e-9, 7).alias("composite"))  # ties of short decimals round alike
    return s.select("k", "composite", R.min_rank_desc("composite").cast("long").alias("place"), P.first_match([(F.col("composite") >= x, g) for x, g in ((60, "A"), (50, "B"), (40, "C"))], "D").alias("grade"))


@query("x7_spatial_assignment", "WITH p AS (SELECT s_suppkey AS k, s_acctbal / 100 AS x, CAST(s_suppkey * 37 % 100 AS DOUBLE) AS y FROM supplier), z AS (SELECT n_nationkey AS zone, (n_nationkey % 5) * 20.0 AS x0, (n_nationkey // 5) * 18.0 AS y0 FROM nation), m AS (SELECT k, COUNT(*) AS zones, MIN(zone) AS first_zone FROM p, z WHERE y >= y0 AND y < y0 + 25 AND x >= x0 AND x < x0 + 25 GROUP BY 1) SELECT k, COALESCE(zones, 0) AS zones, CASE WHEN zones > 1 THEN 'SHARED' WHEN zones = 1 THEN 'MATCHED' ELSE 'OUTSIDE' END AS status FROM p LEFT JOIN m USING (k)")
def x7_spatial_assignment(spark, d):
    """Points assigned to the polygons that hold them, with their status."""
    from .linking import _points, _zones

    points = _points(spark, d)
    m = J.points_in_polygons(points, _zones(spark, d), "k", "zone", 10.0).groupBy("k").agg(F.count("*").alias("zones"))
    out = points.select("k").join(m, "k", "left")
    return out.select("k", F.coalesce("zones", F.lit(0)).alias("zones"), P.first_match([(F.col("zones") > 1, "SHARED"), (F.col("zones") == 1, "MATCHED")], "OUTSIDE").alias("status"))


@query("x8_score_vs_price", f"WITH {ENTITIES}, q AS (SELECT entity, score, price, CAST(GREATEST(1, CEIL(5.0 * (ROW_NUMBER() OVER (ORDER BY score, entity) - 1) / GREATEST(COUNT(*) OVER () - 1, 1))) AS INT) AS q FROM e WHERE price IS NOT NULL AND deals >= 3), p AS (SELECT q, COUNT(*) AS n, MEDIAN(price) AS price FROM q GROUP BY 1), c AS (SELECT CORR(score, price) AS pearson FROM q) SELECT q, n, ROUND(price, 7) AS price, ROUND(price - FIRST_VALUE(price) OVER (ORDER BY q), 7) AS over_first, ROUND(pearson, 9) AS pearson FROM p, c")
def x8_score_vs_price(spark, d):
    """A quintile profile of prices by score, with the overall correlation."""
    e = entities(spark, d).where("price is not null and deals >= 3").withColumn("q", R.row_quantile("score", 5, "entity"))
    p = e.groupBy("q").agg(F.count("*").alias("n"), F.percentile("price", 0.5).alias("p"))
    first, c = p.where("q = 1").select(F.col("p").alias("p1")), e.agg(F.corr("score", "price").alias("r"))
    return p.crossJoin(F.broadcast(first)).crossJoin(F.broadcast(c)).select("q", "n", F.round("p", 7).alias("price"), F.round(F.col("p") - F.col("p1"), 7).alias("over_first"), F.round("r", 9).alias("pearson"))  # one row each


@query("x10_demand_score", "WITH y AS (SELECT o_custkey AS k, YEAR(o_orderdate) AS yr, COUNT(*) AS n FROM orders GROUP BY ALL), f AS (SELECT k, SUM(n) AS total, ROUND(REGR_SLOPE(n, yr), 9) AS slope, ROUND(CAST(ARG_MAX(n, yr) AS DOUBLE) / ARG_MIN(n, yr) - 1, 9) AS growth FROM y GROUP BY k HAVING COUNT(*) >= 2), r AS (SELECT k, 100.0 * (RANK() OVER (ORDER BY slope) + (COUNT(*) OVER (PARTITION BY slope) - 1) / 2.0) / COUNT(*) OVER () AS a, 100.0 * (RANK() OVER (ORDER BY growth) + (COUNT(*) OVER (PARTITION BY growth) - 1) / 2.0) / COUNT(*) OVER () AS b, total FROM f) SELECT k, ROUND(0.6 * a + 0.4 * b, 8) AS score, CASE WHEN total >= 12 THEN 'HIGH' WHEN total >= 6 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM r")
def x10_demand_score(spark, d):
    """Longitudinal features to percentile ranks to a weighted score."""
    y = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("yr")).agg(F.count("*").alias("n"))
    f = A.trend(y, "k", "yr", "n").join(y.groupBy("k").agg(F.sum("n").alias("total")), "k").withColumns({"slope": F.round("slope", 9), "growth": F.round("span_growth", 9)})
    r = f.withColumns({"a": R.percentile_rank("slope"), "b": R.percentile_rank("growth")})
    return r.select("k", F.round(P.weighted_score([(0.6, F.col("a")), (0.4, F.col("b"))]), 8).alias("score"), P.first_match([(F.col("total") >= 12, "HIGH"), (F.col("total") >= 6, "MEDIUM")], "LOW").alias("confidence"))


@query("x11_score_integration", "WITH a AS (SELECT o_custkey AS k, ROUND(AVG(o_totalprice), 6) AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT c_custkey AS k, c_acctbal AS t FROM customer WHERE c_acctbal > 0), j AS (SELECT k, s, t FROM a FULL JOIN b USING (k)), q AS (SELECT quantile_cont(s, 0.7) AS sc, quantile_cont(t, 0.7) AS tc FROM j) SELECT k, CASE WHEN s IS NOT NULL AND t IS NOT NULL THEN 'one+two' WHEN s IS NOT NULL THEN 'one' ELSE 'two' END AS available, CASE WHEN s IS NULL OR t IS NULL THEN 'INCOMPLETE' ELSE CASE WHEN s >= sc THEN 'HIGH' ELSE 'LOW' END || '_' || CASE WHEN t >= tc THEN 'HIGH' ELSE 'LOW' END END AS cell FROM j, q")
def x11_score_integration(spark, d):
    """X11: two scores joined in full, and the two-by-two group of each entity."""
    a = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.round(F.avg("o_totalprice"), 6).alias("s"))
    b = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("t"))
    j = R.with_quantiles(R.with_quantiles(J.join_sources([("one", a), ("two", b)], "k"), "s", sc=0.7), "t", tc=0.7)
    side = lambda v, c: F.when(F.col(v) >= F.col(c), "HIGH").otherwise("LOW")
    cell = F.when(F.col("s").isNull() | F.col("t").isNull(), "INCOMPLETE").otherwise(F.concat_ws("_", side("s", "sc"), side("t", "tc")))
    return j.select("k", "available", cell.alias("cell"))


_SAMPLE = f"""{TRADES}, s AS (SELECT entity, s_nationkey AS grp, s_acctbal / 100 AS score, area, deal_date, LN(unit) AS y FROM t JOIN supplier ON s_suppkey = entity)"""


def _sample(spark, d) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("grp"), (F.col("s_acctbal") / 100).alias("score"))
    return trades(spark, d).join(s, "entity").select("entity", "grp", "score", "area", "deal_date", F.ln("unit").alias("y"))


@query("x14_nested_models", f"WITH {_SAMPLE}, m AS (SELECT COUNT(*) AS n, VAR_POP(y) AS yy, COVAR_POP(y, area) AS ya, COVAR_POP(y, score) AS ys, VAR_POP(area) AS aa, VAR_POP(score) AS ss, COVAR_POP(area, score) AS sa FROM s), f AS (SELECT n, yy - ya * ya / aa AS v1, yy - (ya * ya * ss - 2 * ya * ys * sa + ys * ys * aa) / (aa * ss - sa * sa) AS v2, yy FROM m) SELECT n, ROUND(1 - v1 / yy, 9) AS r2_small, ROUND(1 - v2 / yy, 9) AS r2_large, ROUND(n * LN(v1 / v2), 4) AS lr, n * LN(v1 / v2) > 3.841 AS helps FROM f")
def x14_nested_models(spark, d):
    """Whether a score adds to a model, by a likelihood-ratio test."""
    s = _sample(spark, d)
    moments = M.EffectMoments(s, "y", ["area", "score"])  # one pass serves both fits
    one, two = (moments.fit(xs).metrics()["r2"] for xs in (["area"], ["area", "score"]))
    lr = F.col("n") * F.ln((1 - F.col("a")) / (1 - F.col("b")))
    row = spark.createDataFrame([(moments.n, one, two)], "n long, a double, b double")
    return row.select("n", F.round("a", 9).alias("r2_small"), F.round("b", 9).alias("r2_large"), F.round(lr, 4).alias("lr"), (lr > 3.841).alias("helps"))


@query("x15_premium_index", f"WITH {ENTITIES}, p AS (SELECT entity, deals, score, (price / (SELECT MEDIAN(price) FROM e) - 1) * 100 AS premium FROM e WHERE price IS NOT NULL) SELECT entity, ROUND(premium, 8) AS premium, CASE WHEN deals >= 600 AND score > 0 THEN 'A' WHEN deals >= 560 THEN 'B' ELSE 'C' END AS confidence, ROW_NUMBER() OVER (ORDER BY ROUND(premium, 8) DESC, entity) AS place FROM p QUALIFY place <= 30")
def x15_premium_index(spark, d):
    """Premiums over the median with confidence, the first thirty."""
    e = R.with_quantiles(entities(spark, d).where("price is not null"), "price", mid=0.5)
    e = e.withColumn("premium", F.round((F.col("price") / F.col("mid") - 1) * 100, 8))
    grade = P.first_match([((F.col("deals") >= 600) & (F.col("score") > 0), "A"), (F.col("deals") >= 560, "B")], "C")
    top = e.orderBy(F.col("premium").desc(), "entity").limit(30)
    return top.select("entity", "premium", grade.alias("confidence"), F.row_number().over(Window.orderBy(F.col("premium").desc(), "entity")).cast("long").alias("place"))  # thirty rows


@query("x17_gap_stability", f"WITH {TRADES}, w AS (SELECT MAX(deal_date) AS last FROM t), m AS (SELECT entity, MEDIAN(unit) FILTER (WHERE deal_date > last - INTERVAL 6 MONTH) AS a, MEDIAN(unit) FILTER (WHERE deal_date > last - INTERVAL 12 MONTH) AS b, MEDIAN(unit) AS c FROM t, w WHERE deal_date > last - INTERVAL 24 MONTH GROUP BY 1), g AS (SELECT entity, (a / (AVG(a) OVER ()) - 1) * 100 AS a, (b / (AVG(b) OVER ()) - 1) * 100 AS b, (c / (AVG(c) OVER ()) - 1) * 100 AS c FROM m) SELECT entity, CONCAT(CASE WHEN a IS NULL THEN 'NA' WHEN a > 0.5 THEN '+' WHEN a < -0.5 THEN '-' ELSE '0' END, CASE WHEN b IS NULL THEN 'NA' WHEN b > 0.5 THEN '+' WHEN b < -0.5 THEN '-' ELSE '0' END, CASE WHEN c IS NULL THEN 'NA' WHEN c > 0.5 THEN '+' WHEN c < -0.5 THEN '-' ELSE '0' END) AS pattern, CASE WHEN (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT < 2 THEN 'INSUFFICIENT' WHEN LEAST(a, b, c) > 0.5 THEN 'STABLE_POSITIVE' WHEN GREATEST(a, b, c) < -0.5 THEN 'STABLE_NEGATIVE' ELSE 'MIXED' END AS stability FROM g")
def x17_gap_stability(spark, d):
    """Gaps over three windows, and how stable their signs are."""
    m = A.multi_window(trades(spark, d), "entity", "deal_date", "unit", [6, 12, 24])
    gap = lambda c: (F.col(c) / F.avg(c).over(Window.partitionBy()) - 1) * 100  # noqa: E731  one row an entity
    g = m.select("entity", gap("median_6").alias("a"), gap("median_12").alias("b"), gap("median_24").alias("c"))
    values = [F.col(c) for c in "abc"]
    return g.select("entity", P.sign_pattern(values, 0.5).alias("pattern"), P.sign_stability(values, 0.5).alias("stability"))


@query("x18_local_markets", f"WITH {ENTITIES}, g AS (SELECT grp, COUNT(*) AS members, MEDIAN(price) AS price, AVG(score) AS score FROM e WHERE price IS NOT NULL GROUP BY 1), k AS (SELECT e.grp, entity, ABS(e.price - g.price) AS away, ROW_NUMBER() OVER (PARTITION BY e.grp ORDER BY ABS(e.price - g.price), entity) AS p FROM e JOIN g ON g.grp = e.grp WHERE e.price IS NOT NULL) SELECT g.grp, members, ROUND(g.price, 7) AS price, CASE WHEN members >= 5 THEN 'HIGH' WHEN members >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, entity AS representative FROM g JOIN k ON k.grp = g.grp AND p = 1")
def x18_local_markets(spark, d):
    """M30 in part: given groups with their confidence and the one member nearest to their centre."""
    e = entities(spark, d).where("price is not null")
    g = e.groupBy("grp").agg(F.count("*").alias("members"), F.percentile("price", 0.5).alias("mid"))
    near = e.join(g, "grp").groupBy("grp").agg(F.first("members").alias("members"), F.first("mid").alias("mid"), F.min_by("entity", F.struct(F.abs(F.col("price") - F.col("mid")), "entity")).alias("representative"))
    return near.select("grp", "members", F.round("mid", 7).alias("price"), P.first_match([(F.col("members") >= 5, "HIGH"), (F.col("members") >= 3, "MEDIUM")], "LOW").alias("confidence"), "representative")


@query("x19_fair_price_signals", f"WITH {_SAMPLE}, g AS (SELECT grp, REGR_SLOPE(y, area) AS b, REGR_INTERCEPT(y, area) AS a, SQRT(REGR_SYY(y, area) * (1 - REGR_R2(y, area)) / (COUNT(*) - 2)) AS sigma FROM s GROUP BY 1), e AS (SELECT entity, grp, AVG(area) AS area, EXP(AVG(y)) AS price FROM s GROUP BY ALL), f AS (SELECT entity, price, EXP(a + b * area) AS fair, EXP(a + b * area - 1.96 * sigma) AS lo, EXP(a + b * area + 1.96 * sigma) AS hi FROM e JOIN g USING (grp)), p AS (SELECT entity, (fair / price - 1) * 100 AS point, (lo / price - 1) * 100 AS low, (hi / price - 1) * 100 AS high FROM f) SELECT entity, ROUND(point, 6) AS gap_pct, CASE WHEN low > 0 THEN 'STRONG_UNDER' WHEN high < 0 THEN 'STRONG_OVER' WHEN ABS(point) < 3 THEN 'WITHIN' WHEN point > 0 THEN 'POTENTIAL_UNDER' ELSE 'POTENTIAL_OVER' END AS signal FROM p")
def x19_fair_price_signals(spark, d):
    """Fair prices from local models, gaps in percent, and signals of their intervals."""
    s = _sample(spark, d)
    e = s.groupBy("entity", "grp").agg(F.avg("area").alias("area"), F.exp(F.avg("y")).alias("price"))
    f = M.fair_values(e, M.group_models(s, "y", ["area"], "grp", least_rows=3), "grp", ["area"])
    gap = lambda c: P.percent_gap(F.col(c), F.col("price"))
    return f.select("entity", F.round(gap("fair"), 6).alias("gap_pct"), P.interval_status(gap("fair"), gap("fair_low"), gap("fair_high")).alias("signal"))


@query("x21_final_classification", f"WITH {ENTITIES}, g AS (SELECT entity, grp, deals, score, (price / AVG(price) OVER (PARTITION BY grp) - 1) * 100 AS gap FROM e WHERE price IS NOT NULL), c AS (SELECT *, CASE WHEN deals < 560 THEN 'INSUFFICIENT' WHEN gap < -2 AND score > 5000 THEN 'CORE_VALUE' WHEN gap < -2 THEN 'VALUE' WHEN gap > 2 THEN 'PREMIUM' ELSE 'FAIR' END AS class FROM g) SELECT entity, class, ROW_NUMBER() OVER (PARTITION BY class ORDER BY ROUND(gap, 7), score DESC, entity) AS place, COALESCE(NULLIF(CONCAT_WS(';', CASE WHEN deals < 560 THEN 'FEW_DEALS' END, CASE WHEN ABS(gap) > 5 THEN 'WIDE_GAP' END, CASE WHEN score < 0 THEN 'NEGATIVE_SCORE' END), ''), 'NONE') AS flags FROM c")
def x21_final_classification(spark, d):
    """One class for each entity, a ranking within it, and its flags."""
    e = entities(spark, d).where("price is not null")
    g = e.withColumn("gap", (F.col("price") / F.avg("price").over(Window.partitionBy("grp")) - 1) * 100)
    low = F.col("gap") < -2
    c = g.withColumn("class", P.first_match([(F.col("deals") < 560, "INSUFFICIENT"), (low & (F.col("score") > 5000), "CORE_VALUE"), (low, "VALUE"), (F.col("gap") > 2, "PREMIUM")], "FAIR"))
    by = Window.partitionBy("class").orderBy(F.round("gap", 7), F.col("score").desc(), "entity")
    flags = [("FEW_DEALS", F.col("deals") < 560), ("WIDE_GAP", F.abs("gap") > 5), ("NEGATIVE_SCORE", F.col("score") < 0)]
    return c.select("entity", "class", F.row_number().over(by).cast("long").alias("place"), P.reason_text(flags).alias("flags"))


@query("x22_review_import", "WITH b AS (SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN 'REJECT' WHEN c_nationkey < 3 THEN 'EXACT' END AS decision, c_mktsegment AS seg FROM customer) SELECT k, COALESCE(CASE WHEN decision = 'EXACT' THEN 'CONFIRMED' END, seg) AS value, decision IS NOT NULL AND decision = 'EXACT' AS applied, CASE WHEN decision IS NOT NULL THEN decision = 'REJECT' AND seg = 'BUILDING' END AS invalid FROM b")
def x22_review_import(spark, d):
    """A batch of reviewed corrections, validated and applied."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("value"), F.when(F.col("c_acctbal") < 0, "REJECT").when(F.col("c_nationkey") < 3, "EXACT").alias("decision"))
    fixes = c.where("decision = 'EXACT'").select("k", F.lit("CONFIRMED").alias("value"))
    out = J.overridden(c, fixes, ["k"], ["value"])
    return out.select("k", "value", F.col("override_applied").alias("applied"), (F.when(F.col("decision").isNotNull(), (F.col("decision") == "REJECT") & (F.col("original_value") == "BUILDING"))).alias("invalid"))
