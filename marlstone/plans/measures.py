"""Queries of aggregates over trades, orders and relations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics as A
from ..operators.sets import partition_audit
from .registry import ENTITIES, TRADES, entities, query, table, trades

r11 = lambda df, *names: df.withColumns({c: F.round(c, 11) for c in names})
r9 = lambda df, *names: df.withColumns({c: F.round(c, 9) for c in names})


@query("market_metrics", f"WITH {TRADES}, p(period, months) AS (VALUES ('6m', 6), ('12m', 12), ('24m', 24)), w AS (SELECT MAX(deal_date) AS last FROM t), x AS (SELECT t.*, p.period FROM t, w, p WHERE deal_date > last - TO_MONTHS(months)), s AS (SELECT *, 'ALL' AS segment FROM x UNION ALL SELECT *, flag FROM x) SELECT entity, period, segment, ROUND(MEDIAN(unit), 7) AS median_unit, ROUND(AVG(unit), 7) AS mean_unit, ROUND(MEDIAN(amount), 7) AS median_amount, COUNT(*) AS deals, MEDIAN(area) AS median_size, MIN(deal_date) AS first_date, MAX(deal_date) AS last_date, COUNT(*) < 3 AS low_sample FROM s GROUP BY ALL")
def market_metrics(spark, d):
    """A1, A3: metrics of each entity in several trailing periods and segments."""
    m = A.market_metrics(trades(spark, d), "entity", "deal_date", "unit", "amount", "area", {"6m": 6, "12m": 12, "24m": 24}, "flag")
    return m.withColumns({c: F.round(c, 7) for c in ("median_unit", "mean_unit", "median_amount")})


@query("period_return", f"WITH {TRADES}, m AS (SELECT entity, STRFTIME(deal_date, '%Y-%m') AS month, MEDIAN(unit) AS v FROM t GROUP BY ALL) SELECT entity, COUNT(*) AS months, ROUND(ARG_MAX(v, month) / NULLIF(ARG_MIN(v, month), 0) - 1, 9) AS \"return\" FROM m GROUP BY 1")
def period_return(spark, d):
    """A2: the return between the first and the last monthly median."""
    t = trades(spark, d).withColumn("month", F.date_format("deal_date", "yyyy-MM"))
    return r9(A.period_return(t, "entity", "month", "unit"), "return")


@query("median_ratio", f"WITH {TRADES}, a AS (SELECT entity, MEDIAN(unit) AS m, COUNT(*) AS n FROM t WHERE flag = 'R' GROUP BY 1), b AS (SELECT entity, MEDIAN(unit) AS m, COUNT(*) AS n, SUM(area) AS size FROM t WHERE flag <> 'R' GROUP BY 1) SELECT b.entity, ROUND(a.m / NULLIF(b.m, 0), 9) AS ratio, ROUND(b.n / NULLIF(b.size, 0), 8) AS turnover, COALESCE(a.n, 0) < 150 AS low_sample FROM b LEFT JOIN a USING (entity)")
def median_ratio(spark, d):
    """A3: the ratio of two medians, turnover, and a flag of small samples; one pass with conditions."""
    r = F.col("flag") == "R"
    g = trades(spark, d).groupBy("entity").agg(F.percentile(F.when(r, F.col("unit")), 0.5).alias("a"), F.count_if(r).alias("an"), F.percentile(F.when(~r, F.col("unit")), 0.5).alias("b"), F.count_if(~r).alias("bn"), F.sum(F.when(~r, F.col("area"))).alias("size"))
    return g.where("bn > 0").select("entity", F.round(F.col("a") / F.nullif(F.col("b"), F.lit(0.0)), 9).alias("ratio"), F.round(F.col("bn") / F.nullif(F.col("size"), F.lit(0.0)), 8).alias("turnover"), (F.col("an") < 150).alias("low_sample"))


_WINDOWS = f"""{TRADES}, w AS (SELECT MAX(deal_date) AS last FROM t), m AS (SELECT part AS k, COUNT(*) FILTER (WHERE deal_date > last - INTERVAL 6 MONTH) AS n_6, MEDIAN(unit) FILTER (WHERE deal_date > last - INTERVAL 6 MONTH) AS median_6, COUNT(*) FILTER (WHERE deal_date > last - INTERVAL 12 MONTH) AS n_12, MEDIAN(unit) FILTER (WHERE deal_date > last - INTERVAL 12 MONTH) AS median_12, COUNT(*) AS n_24, MEDIAN(unit) AS median_24 FROM t, w WHERE deal_date > last - INTERVAL 24 MONTH GROUP BY 1)"""


def _windows(spark, d):
    return A.multi_window(trades(spark, d).withColumn("k", F.col("part")), "k", "deal_date", "unit", [6, 12, 24])


@query("multi_window", f"WITH {_WINDOWS} SELECT k, n_6, n_12, n_24, ROUND(median_6, 9) AS median_6, ROUND(median_12, 9) AS median_12, ROUND(median_24, 9) AS median_24 FROM m")
def multi_window(spark, d):
    """A4: counts and medians of several windows in one pass."""
    return r9(_windows(spark, d), "median_6", "median_12", "median_24")


@query("adaptive_window", f"WITH {_WINDOWS} SELECT k, CASE WHEN n_6 >= 3 THEN 6 WHEN n_12 >= 3 THEN 12 WHEN n_24 >= 1 THEN 24 END AS chosen, ROUND(CASE WHEN n_6 >= 3 THEN median_6 WHEN n_12 >= 3 THEN median_12 WHEN n_24 >= 1 THEN median_24 END, 9) AS value, CASE WHEN n_6 >= 3 THEN 'A' WHEN n_12 >= 3 THEN 'B' WHEN n_24 >= 1 THEN 'C' ELSE 'INCOMPLETE' END AS grade FROM m")
def adaptive_window(spark, d):
    """The shortest window with enough deals, with its grade."""
    return r9(A.adaptive_window(_windows(spark, d), [(6, 3, "A"), (12, 3, "B"), (24, 1, "C")]).select("k", "chosen", "value", "grade"), "value")


@query("capitalisation", "WITH p AS (SELECT l_suppkey AS entity, l_quantity AS size, CASE WHEN p_size > 10 THEN p_retailprice END AS price FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT entity, ROUND(SUM(size * price), 2) AS cap, ROUND(SUM(CASE WHEN price IS NOT NULL THEN size ELSE 0 END) / SUM(size), 9) AS coverage, SUM(CASE WHEN price IS NOT NULL THEN size ELSE 0 END) = SUM(size) AS complete FROM p GROUP BY 1")
def capitalisation(spark, d):
    """Size times price over the priced parts, with their share."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.when(F.col("p_size") > 10, F.col("p_retailprice")).alias("price"))
    c = A.capitalisation(trades(spark, d).select("entity", "part", "area").join(p, "part"), "entity", "area", "price")
    return c.select("entity", F.round("cap", 2).alias("cap"), F.round("coverage", 9).alias("coverage"), "complete")


@query("unit_counts", "SELECT p_brand, CAST(CAST(p_retailprice AS DECIMAL(12,6)) AS VARCHAR) AS area, COUNT(*) AS units FROM part WHERE regexp_matches(p_type, 'STEEL|COPPER|NICKEL|STANDARD|PROMO|SMALL') AND NOT regexp_matches(p_type, 'ECONOMY') GROUP BY ALL")
def unit_counts(spark, d):
    """Units by exact decimal area, without those of excluded purposes."""
    p = table(spark, d, "part").select("p_brand", F.col("p_retailprice").alias("area"), "p_type")
    return A.unit_counts(p, "p_brand", "area", "p_type", "STEEL|COPPER|NICKEL|STANDARD|PROMO|SMALL", "ECONOMY").withColumn("area", F.col("area").cast("string"))


@query("precise_groups", "WITH g AS (SELECT p_brand, p_size AS area, CASE WHEN p_size % 2 = 0 THEN 'exact' ELSE 'display' END AS prec, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END AS kind, SUM(p_partkey) AS units, STRING_AGG(DISTINCT p_type, '/' ORDER BY p_type) AS kinds FROM part GROUP BY ALL) SELECT p_brand, area, CAST(units AS BIGINT) AS units, kinds, CASE WHEN COUNT(*) OVER (PARTITION BY p_brand, area) > 1 THEN 'exclusive_' || area || '_' || ROW_NUMBER() OVER (PARTITION BY p_brand, area ORDER BY prec, kind) ELSE 'exclusive_' || area END AS area_group_id FROM g")
def precise_groups(spark, d):
    """Exact areas as one group, displayed ones kept apart by kind."""
    p = table(spark, d, "part").select("p_brand", F.col("p_size").alias("area"), F.when(F.col("p_size") % 2 == 0, "exact").otherwise("display").alias("prec"), F.col("p_type").alias("kind"), F.col("p_partkey").alias("units"))
    return A.precise_groups(p, "p_brand", "area", "kind", "prec", "units").select("p_brand", "area", "units", "kinds", "area_group_id")


@query("weighted_means", f"WITH {TRADES} SELECT entity, flag, ROUND(SUM(unit * area) / NULLIF(SUM(area), 0), 4) AS price FROM t GROUP BY ALL")
def weighted_means(spark, d):
    """A10: means weighted by size."""
    return A.weighted_mean(trades(spark, d), ["entity", "flag"], "unit", "area", "price").withColumn("price", F.round("price", 4))


@query("group_sets", "SELECT o_custkey, ROUND(AVG(o_totalprice), 8) AS mean, MAX(o_totalprice) AS high, MIN(o_totalprice) AS low, COUNT(*) AS n, STRING_AGG(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses, CASE WHEN COUNT(DISTINCT o_orderstatus) = 3 THEN 'FULL' ELSE 'PARTIAL' END AS coverage FROM orders GROUP BY 1")
def group_sets(spark, d):
    """Means, extremes, and sorted distinct sets of a group."""
    s = F.array_sort(F.collect_set("o_orderstatus"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.avg("o_totalprice"), 8).alias("mean"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.count("*").alias("n"), F.concat_ws(",", s).alias("statuses"), F.when(F.size(s) == 3, "FULL").otherwise("PARTIAL").alias("coverage"))


@query("set_statistics", f"WITH {TRADES}, x AS (SELECT DISTINCT entity AS g, part, p_retailprice AS v FROM t JOIN part ON p_partkey = part), q AS (SELECT g, quantile_cont(v, 0.75) AS q FROM x GROUP BY 1) SELECT g, COUNT(*) AS n, ROUND(AVG(v), 9) AS mean, ROUND(MEDIAN(v), 9) AS median, MAX(v) AS high, MIN(v) AS low, ROUND(AVG(v) FILTER (WHERE v >= q), 9) AS top_quarter FROM x JOIN q USING (g) GROUP BY g")
def set_statistics(spark, d):
    """Statistics of the distinct members of a group."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_retailprice").alias("v"))
    return r9(A.set_statistics(trades(spark, d).select(F.col("entity").alias("g"), "part").join(p, "part"), "g", "part", "v"), "mean", "median", "top_quarter")


@query("edges_and_degrees", f"WITH {TRADES}, x AS (SELECT entity, part, COUNT(*) AS n, MAX(discount) AS dmax FROM t GROUP BY ALL), c AS (SELECT *, CASE WHEN n >= 2 THEN 'CONFIRMED' WHEN dmax >= 0.05 THEN 'POSSIBLE' WHEN dmax > 0 THEN 'AMBIGUOUS' ELSE 'EXCLUDED' END AS kind FROM x) SELECT 'entity' AS side, entity AS id, COUNT(*) AS degree, COUNT(*) FILTER (WHERE kind = 'CONFIRMED') AS confirmed, COUNT(*) FILTER (WHERE kind = 'POSSIBLE') AS possible FROM c GROUP BY 2 UNION ALL SELECT 'part', part, COUNT(*), COUNT(*) FILTER (WHERE kind = 'CONFIRMED'), COUNT(*) FILTER (WHERE kind = 'POSSIBLE') FROM c GROUP BY 2")
def edges_and_degrees(spark, d):
    """Classes of the edges of a bipartite graph, and the degrees of its nodes."""
    from ..functions.rules import first_match

    x = trades(spark, d).groupBy("entity", "part").agg(F.count("*").alias("n"), F.max("discount").alias("top"))
    x = x.withColumn("kind", first_match([(F.col("n") >= 2, "CONFIRMED"), (F.col("top") >= 0.05, "POSSIBLE"), (F.col("top") > 0, "AMBIGUOUS")], "EXCLUDED"))
    ends = F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("id")) for s in ("entity", "part")))
    return x.select("kind", F.inline(ends)).groupBy("side", "id").agg(F.count("*").alias("degree"), F.count_if(F.col("kind") == "CONFIRMED").alias("confirmed"), F.count_if(F.col("kind") == "POSSIBLE").alias("possible"))


@query("two_hop", f"WITH {TRADES}, x AS (SELECT DISTINCT t.deal, s_nationkey AS n, s_acctbal AS v, entity FROM t JOIN supplier ON s_suppkey = entity) SELECT deal, COUNT(*) AS options, ROUND(AVG(v), 8) AS mean, MAX(v) AS high, MIN(v) AS low, ROUND(MAX(v) - MIN(v), 8) AS spread, COUNT(DISTINCT n) = 1 AS guaranteed FROM x GROUP BY 1")
def two_hop(spark, d):
    """What an entity reaches over two hops."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("n"), F.col("s_acctbal").alias("v"))
    x = trades(spark, d).select("deal", "entity").distinct().join(s, "entity")
    return x.groupBy("deal").agg(F.count("*").alias("options"), F.round(F.avg("v"), 8).alias("mean"), F.max("v").alias("high"), F.min("v").alias("low"), F.round(F.max("v") - F.min("v"), 8).alias("spread"), (F.min("n") == F.max("n")).alias("guaranteed"))


_FEEDER = """f AS (SELECT l_orderkey AS k, l_suppkey AS m, s_acctbal / 100 AS score, l_returnflag AS kind, CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.8 ELSE 0.5 END AS w, CASE l_returnflag WHEN 'A' THEN 100 WHEN 'N' THEN 85 ELSE 65 END AS q FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
  s AS (SELECT k, SUM(score * w) / SUM(w) AS mean, MIN(score) AS low, MAX(score) AS high, MEDIAN(score) AS median, STDDEV_POP(score) AS deviation, STDDEV_POP(score) / NULLIF(AVG(score), 0) AS variation, SUM(q * w) / SUM(w) AS quality, AVG(w) AS aw,
  LEAST(1, 0.4 * SUM(CASE WHEN kind = 'A' THEN w ELSE 0 END) / SUM(w) + 0.3 / COUNT(DISTINCT m) + 0.3 * SUM(CASE WHEN kind <> 'R' THEN w ELSE 0 END) / SUM(w)) AS exclusivity FROM f GROUP BY 1)"""


def _feeder(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_acctbal") / 100).alias("score"))
    kind = A.by_kind(F.col("l_returnflag"), {"A": "EXACT", "N": "ELIGIBLE", "R": "CONDITIONAL"})
    f = table(spark, d, "lineitem").join(s, "l_suppkey").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("m"), "score", kind.alias("kind"))
    f = f.withColumns({"w": A.by_kind(F.col("kind"), A.RELATION_WEIGHTS), "q": A.by_kind(F.col("kind"), A.RELATION_QUALITY)})
    return A.feeder_scores(f, "k", "m", "kind", "score", "w", "q").where("scored > 0")


@query("feeder_scores", f"WITH {_FEEDER} SELECT k, ROUND(mean + 2e-11, 9) AS mean, ROUND(low + 2e-11, 9) AS low, ROUND(high + 2e-11, 9) AS high, ROUND(median + 2e-11, 9) AS median, ROUND(deviation + 2e-11, 9) AS deviation, ROUND(variation, 7) AS variation, ROUND(quality + 2e-11, 9) AS quality, ROUND(exclusivity + 2e-11, 9) AS exclusivity, ROUND(GREATEST(0, LEAST(100, deviation * 2 + (1 - aw) * 25)) + 2e-11, 9) AS uncertainty, ROUND(GREATEST(0, LEAST(100, 0.65 * mean + 0.15 * low + 10 * exclusivity + 0.1 * quality)) + 2e-11, 9) AS composite FROM s")
def feeder_scores(spark, d):
    """Weighted scores of the entities that relations lead to."""
    names = ["mean", "low", "high", "median", "deviation", "quality", "exclusivity", "uncertainty", "composite"]
    # ties of short decimals round alike after a nudge
    return _feeder(spark, d).select("k", *(F.round(F.col(c) + 2e-11, 9).alias(c) for c in names), F.round("variation", 7).alias("variation"))


@query("scenario_scores", f"WITH {_FEEDER} SELECT k, ROUND(mean, 11) AS base, ROUND(0.5 * mean + 0.5 * low, 11) AS cautious, ROUND(0.5 * mean + 0.5 * high, 11) AS hopeful, CASE WHEN quality >= 90 THEN 'SOLID' WHEN quality >= 80 THEN 'FAIR' ELSE 'WEAK' END AS status FROM s")
def scenario_scores(spark, d):
    """A score under three weightings, with its status."""
    status = F.when(F.col("quality") >= 90, "SOLID").when(F.col("quality") >= 80, "FAIR").otherwise("WEAK")
    s = _feeder(spark, d)
    return s.select("k", F.round("mean", 11).alias("base"), F.round(0.5 * F.col("mean") + 0.5 * F.col("low"), 11).alias("cautious"), F.round(0.5 * F.col("mean") + 0.5 * F.col("high"), 11).alias("hopeful"), status.alias("status"))


_YEARLY = "y AS (SELECT o_custkey AS k, CAST(YEAR(o_orderdate) AS INT) AS yr, COUNT(*) AS n, AVG(o_totalprice) / 10000 AS rate, SUM(o_totalprice) AS total FROM orders GROUP BY ALL)"


def _yearly(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("yr")).agg(F.count("*").alias("n"), (F.avg("o_totalprice") / 10000).alias("rate"), F.sum("o_totalprice").alias("total"))


@query("shrunk_rates", f"WITH {_YEARLY}, b AS (SELECT *, SUM(rate * n) OVER (PARTITION BY yr) / SUM(n) OVER (PARTITION BY yr) AS baseline FROM y) SELECT k, yr, ROUND(baseline, 9) AS baseline, ROUND((n * rate + 10 * baseline) / (n + 10), 9) AS shrunk FROM b")
def shrunk_rates(spark, d):
    """Rates shrunk to the weighted mean of their period."""
    return r9(A.shrunk_rates(_yearly(spark, d), "k", "yr", "rate", "n", 10.0), "baseline", "shrunk")


@query("recency_weighted", f"WITH {_YEARLY}, w AS (SELECT *, CASE yr WHEN 2001 THEN 0.5 WHEN 2000 THEN 0.3 WHEN 1999 THEN 0.2 END AS w FROM y) SELECT k, ROUND(SUM(w * rate) / SUM(w), 11) AS recent, COUNT(*) AS observed, CASE WHEN COUNT(*) > 1 THEN ROUND(GREATEST(0, LEAST(1, 1 - STDDEV_POP(rate) / 50)), 11) END AS stability FROM w GROUP BY k")
def recency_weighted(spark, d):
    """A mean weighted by age, renormalised over the years there are; and stability."""
    return r11(A.recency_weighted(_yearly(spark, d), "k", "yr", "rate", 2001, [0.5, 0.3, 0.2]), "recent", "stability")


@query("latest_rollup", f"WITH {_YEARLY} SELECT k, yr, n, ROUND(rate, 9) AS rate, years, ROUND(best, 9) AS best FROM (SELECT *, COUNT(*) OVER (PARTITION BY k) AS years, MAX(rate) OVER (PARTITION BY k) AS best FROM y) QUALIFY ROW_NUMBER() OVER (PARTITION BY k ORDER BY yr DESC) = 1")
def latest_rollup(spark, d):
    """The latest record of an entity with columns rolled up over all."""
    last = _yearly(spark, d).groupBy("k").agg(F.max_by(F.struct("yr", "n", "rate"), "yr").alias("s"), F.count("*").alias("years"), F.max("rate").alias("best"))
    return r9(last.select("k", "s.yr", "s.n", "s.rate", "years", "best"), "rate", "best")


@query("component_score", "WITH c AS (SELECT c_custkey AS k, CASE WHEN c_acctbal > 0 THEN c_acctbal / 100 END AS a, CASE WHEN c_nationkey % 3 <> 0 THEN c_nationkey * 4.0 END AS b, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 100 END AS c FROM customer) SELECT k, ROUND((COALESCE(0.5 * a, 0) + COALESCE(0.3 * b, 0) + COALESCE(0.2 * c, 0)) / NULLIF((CASE WHEN a IS NOT NULL THEN 0.5 ELSE 0 END) + (CASE WHEN b IS NOT NULL THEN 0.3 ELSE 0 END) + (CASE WHEN c IS NOT NULL THEN 0.2 ELSE 0 END), 0), 9) AS score, CASE WHEN (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT >= 2 THEN ROUND(COALESCE(a, 0) + COALESCE(b, 0) + COALESCE(c, 0), 9) END AS sum_two FROM c")
def component_score(spark, d):
    """Weights renormalised over the components there are; sums with a least number of values."""
    from ..functions.rules import sum_with_least, weighted_score

    c = table(spark, d, "customer")
    a, b, e = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 100), F.when(F.col("c_nationkey") % 3 != 0, F.col("c_nationkey") * 4.0), F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") % 100)
    return c.select(F.col("c_custkey").alias("k"), F.round(weighted_score([(0.5, a), (0.3, b), (0.2, e)]), 9).alias("score"), F.round(sum_with_least([a, b, e], 2), 9).alias("sum_two"))


@query("cohort_growth", f"WITH y AS (SELECT o_custkey % 200 AS k, CAST(YEAR(o_orderdate) AS INT) AS yr, COUNT(*) FILTER (WHERE MONTH(o_orderdate) <= 4) AS g0, COUNT(*) FILTER (WHERE MONTH(o_orderdate) BETWEEN 5 AND 8) AS g1, COUNT(*) FILTER (WHERE MONTH(o_orderdate) >= 9) AS g2 FROM orders GROUP BY ALL), l AS (SELECT k, yr, 0 AS grade, g0 AS n FROM y UNION ALL SELECT k, yr, 1, g1 FROM y UNION ALL SELECT k, yr, 2, g2 FROM y), p AS (SELECT a.k, a.yr, a.grade, a.n, b.n AS n0 FROM l a JOIN l b ON a.k = b.k AND a.yr = b.yr + 1 AND a.grade = b.grade + 1 WHERE b.n > 0), v AS (SELECT yr, grade, SUM(n) AS n FROM l GROUP BY ALL), w AS (SELECT a.yr, a.grade, a.n / b.n - 1 AS w FROM v a JOIN v b ON a.yr = b.yr + 1 AND a.grade = b.grade + 1) SELECT k, ROUND(AVG(n / n0 - 1), 9) AS raw, ROUND(AVG(n / n0 - 1 - w), 9) AS growth FROM p JOIN w USING (yr, grade) GROUP BY k")
def cohort_growth(spark, d):
    """Growth of cohorts against the population's."""
    o, m = table(spark, d, "orders"), F.month("o_orderdate")
    y = o.groupBy((F.col("o_custkey") % 200).alias("k"), F.year("o_orderdate").alias("yr")).agg(F.count_if(m <= 4).alias("g0"), F.count_if(m.between(5, 8)).alias("g1"), F.count_if(m >= 9).alias("g2"))
    return r9(A.cohort_growth(y, "k", "yr", ["g0", "g1", "g2"]), "raw", "growth")


@query("trends", f"WITH {_YEARLY} SELECT k, ROUND(ARG_MAX(n, yr) / ARG_MIN(n, yr) - 1, 9) AS span_growth, ROUND(REGR_SLOPE(n, yr), 9) AS slope, ROUND(REGR_SLOPE(n, yr) / AVG(n), 9) AS slope_rate, COUNT(*) AS periods FROM y GROUP BY k HAVING COUNT(*) >= 2")
def trends(spark, d):
    """Growth over the span, and the slope of a linear trend."""
    return r9(A.trend(_yearly(spark, d), "k", "yr", "n"), "span_growth", "slope", "slope_rate")


@query("structure_index", f"WITH {TRADES} SELECT entity, ROUND((SUM(CASE WHEN flag = 'R' THEN area ELSE 0 END) / SUM(area)) / (SELECT SUM(CASE WHEN flag = 'R' THEN area ELSE 0 END) / SUM(area) FROM t), 9) AS idx FROM t GROUP BY 1")
def structure_index(spark, d):
    """A share relative to the population's."""
    t = trades(spark, d)
    share = F.sum(F.when(F.col("flag") == "R", F.col("area")).otherwise(0.0)) / F.sum("area")
    return t.groupBy("entity").agg(share.alias("own")).crossJoin(F.broadcast(t.agg(share.alias("whole")))).select("entity", F.round(F.col("own") / F.col("whole"), 9).alias("idx"))  # one row


@query("log_trend", f"WITH {TRADES}, m AS (SELECT entity, STRFTIME(deal_date, '%Y-%m') AS month, LN(MEDIAN(unit)) AS v FROM t GROUP BY ALL), i AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY month) - 1 AS i FROM m) SELECT entity, ROUND(REGR_SLOPE(v, i) * 12, 8) AS yearly, COUNT(*) AS months FROM i GROUP BY 1 HAVING COUNT(*) >= 6")
def log_trend(spark, d):
    """The yearly slope of the logarithm of monthly medians."""
    m = trades(spark, d).groupBy("entity", F.date_format("deal_date", "yyyy-MM").alias("month")).agg(F.ln(F.percentile("unit", 0.5)).alias("v"))
    t = A.trend(m, "entity", "month", "v", 6, by_row=True)
    return t.select("entity", F.round(F.col("slope") * 12, 8).alias("yearly"), F.col("periods").alias("months"))


@query("dispersion", "WITH c AS (SELECT c_acctbal + 2000 AS v, LN(c_acctbal + 2000) AS l, c_custkey % 11 AS c, c_nationkey, c_mktsegment FROM customer), r AS (SELECT v, l, c, 'nation' AS definition, CAST(c_nationkey AS VARCHAR) AS g FROM c UNION ALL SELECT v, l, c, 'segment', c_mktsegment FROM c), m AS (SELECT *, l - AVG(l) OVER w AS e, c - AVG(c) OVER w AS ce, v - MEDIAN(v) OVER w AS d FROM r WINDOW w AS (PARTITION BY definition, g)), q AS (SELECT definition, AVG(i) AS iqr, COUNT(*) AS groups FROM (SELECT definition, g, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS i FROM r GROUP BY ALL) GROUP BY 1) SELECT definition, ANY_VALUE(groups) AS groups, COUNT(*) AS n, ROUND(VAR_SAMP(e), 9) AS within, ROUND(VAR_SAMP(e) / (SELECT VAR_SAMP(l) FROM c), 9) AS ratio, ROUND(MEDIAN(ABS(d)), 4) AS mad, ROUND(ANY_VALUE(iqr), 4) AS iqr, ROUND(VAR_SAMP(ce), 7) AS change FROM m JOIN q USING (definition) GROUP BY 1")
def dispersion(spark, d):
    """Dispersion of prices and of their changes under several ways of grouping."""
    c = table(spark, d, "customer").select((F.col("c_acctbal") + 2000).alias("v"), (F.col("c_custkey") % 11).alias("c"), "c_nationkey", "c_mktsegment")
    o = A.dispersion(c, "v", {"nation": "c_nationkey", "segment": "c_mktsegment"}, "c")
    return o.select("definition", "groups", F.col("rows").alias("n"), F.round("within", 9).alias("within"), F.round("ratio", 9).alias("ratio"), F.round("mad", 4).alias("mad"), F.round("iqr", 4).alias("iqr"), F.round("change", 7).alias("change"))


@query("correlation_scopes", f"WITH {ENTITIES}, s AS (SELECT 'all' AS scope, 'ALL' AS member, score, price FROM e WHERE price IS NOT NULL UNION ALL SELECT 'group', CAST(grp AS VARCHAR), score, price FROM e WHERE price IS NOT NULL), k AS (SELECT *, RANK() OVER (PARTITION BY scope, member ORDER BY score) + (COUNT(*) OVER (PARTITION BY scope, member, score) - 1) / 2.0 AS a, RANK() OVER (PARTITION BY scope, member ORDER BY price) + (COUNT(*) OVER (PARTITION BY scope, member, price) - 1) / 2.0 AS b FROM s) SELECT scope, member, CASE WHEN COUNT(*) >= 3 THEN ROUND(CORR(score, price), 9) END AS pearson, CASE WHEN COUNT(*) >= 3 THEN ROUND(CORR(a, b), 9) END AS spearman, COUNT(*) AS n FROM k GROUP BY ALL")
def correlation_scopes(spark, d):
    """Correlations over everything and by group in one table."""
    return r9(A.correlations(entities(spark, d), "score", "price", {"all": None, "group": "grp"}), "pearson", "spearman")


@query("quintile_profile", "WITH q AS (SELECT c_acctbal, c_nationkey, CAST(GREATEST(1, CEIL(5.0 * (ROW_NUMBER() OVER (ORDER BY c_acctbal, c_custkey) - 1) / GREATEST(COUNT(*) OVER () - 1, 1))) AS INT) AS q FROM customer) SELECT q, COUNT(*) AS n, ROUND(AVG(c_acctbal), 4) AS mean, ROUND(MEDIAN(c_acctbal), 4) AS median FROM q GROUP BY 1")
def quintile_profile(spark, d):
    """A profile by quintile."""
    from ..functions.ranks import with_row_quantile

    q = with_row_quantile(table(spark, d, "customer"), "c_acctbal", 5, "c_custkey", "q")
    return q.groupBy("q").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"), F.round(F.percentile("c_acctbal", 0.5), 4).alias("median"))


@query("market_phases", f"WITH {TRADES}, m AS (SELECT STRFTIME(deal_date, '%Y-%m') AS month, MEDIAN(unit) AS mk, MEDIAN(unit) FILTER (WHERE area <= 25) AS lo, MEDIAN(unit) FILTER (WHERE area > 25) AS hi FROM t GROUP BY 1), c AS (SELECT mk / LAG(mk) OVER w - 1 AS mk, lo / LAG(lo) OVER w - 1 AS lo, hi / LAG(hi) OVER w - 1 AS hi FROM m WINDOW w AS (ORDER BY month)) SELECT CASE WHEN mk > 0 THEN 'UP' ELSE 'DOWN' END AS phase, COUNT(*) AS months, ROUND(MEDIAN(lo), 9) AS low_band, ROUND(MEDIAN(hi), 9) AS high_band FROM c WHERE mk IS NOT NULL GROUP BY 1")
def market_phases(spark, d):
    """Returns of bands by the phase of the market."""
    m = trades(spark, d).groupBy(F.date_format("deal_date", "yyyy-MM").alias("month")).agg(F.percentile("unit", 0.5).alias("mk"), F.percentile(F.when(F.col("area") <= 25, F.col("unit")), 0.5).alias("lo"), F.percentile(F.when(F.col("area") > 25, F.col("unit")), 0.5).alias("hi"))
    by = Window.orderBy("month")  # a row for each month
    c = m.select(*((F.col(x) / F.lag(x).over(by) - 1).alias(x) for x in ("mk", "lo", "hi"))).where("mk is not null")
    return c.groupBy(F.when(F.col("mk") > 0, "UP").otherwise("DOWN").alias("phase")).agg(F.count("*").alias("months"), F.round(F.percentile("lo", 0.5), 9).alias("low_band"), F.round(F.percentile("hi", 0.5), 9).alias("high_band"))


@query("cross_tab", "SELECT o_orderpriority, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS F, COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS O, COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def cross_tab(spark, d):
    """A cross-table of two classes."""
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0)


@query("quintile_matrix", f"WITH {ENTITIES}, q AS (SELECT NTILE(5) OVER (ORDER BY score, entity) AS a, NTILE(5) OVER (ORDER BY price, entity) AS b, price FROM e WHERE price IS NOT NULL), g AS (SELECT a, b FROM (SELECT UNNEST([1,2,3,4,5]) AS a), (SELECT UNNEST([1,2,3,4,5]) AS b)) SELECT CAST(g.a AS INT) AS a, CAST(g.b AS INT) AS b, COUNT(q.price) AS n, ROUND(AVG(q.price), 4) AS price FROM g LEFT JOIN q ON q.a = g.a AND q.b = g.b GROUP BY ALL")
def quintile_matrix(spark, d):
    """A matrix of two quintiles with its empty cells."""
    e = entities(spark, d).where("price is not null")
    q = e.select("price", *(F.ntile(5).over(Window.orderBy(c, "entity")).alias(n) for n, c in (("a", "score"), ("b", "price"))))
    five = F.explode(F.sequence(F.lit(1), F.lit(5)))
    grid = spark.range(1).select(five.alias("a")).select("a", five.alias("b"))
    return grid.join(q, ["a", "b"], "left").groupBy("a", "b").agg(F.count("price").alias("n"), F.round(F.avg("price"), 4).alias("price"))


@query("group_vs_base", f"WITH {ENTITIES}, b AS (SELECT AVG(LN(price)) AS base FROM e WHERE grp = 0) SELECT grp, ROUND((EXP(AVG(LN(price)) - ANY_VALUE(base)) - 1) * 100, 9) AS pct FROM e, b WHERE price IS NOT NULL GROUP BY grp")
def group_vs_base(spark, d):
    """Groups against a base group, in percent of the logarithm."""
    e = entities(spark, d).where("price is not null")
    base = e.where("grp = 0").agg(F.avg(F.ln("price")).alias("base"))
    return e.groupBy("grp").agg(F.avg(F.ln("price")).alias("m")).crossJoin(F.broadcast(base)).select("grp", F.round((F.exp(F.col("m") - F.col("base")) - 1) * 100, 9).alias("pct"))  # one row


@query("dominant_value", "WITH c AS (SELECT o_custkey, o_orderpriority AS v, COUNT(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, FIRST(v ORDER BY n DESC, v) AS dominant, ROUND(MAX(n) / SUM(n), 9) AS share FROM c GROUP BY 1")
def dominant_value(spark, d):
    """The most frequent value and its share."""
    return r9(A.dominant(table(spark, d, "orders"), "o_custkey", "o_orderpriority"), "share")


@query("group_spread", "WITH p AS (SELECT s_suppkey AS k, s_nationkey AS g, s_acctbal AS v FROM supplier) SELECT a.g, COUNT(*) AS pairs, ROUND(AVG(ABS(a.v - b.v)), 4) AS mean, ROUND(MAX(ABS(a.v - b.v)), 4) AS high, MAX(ABS(a.v - b.v)) > 8000 AS fragmented FROM p a JOIN p b ON a.g = b.g AND a.k < b.k GROUP BY 1")
def group_spread(spark, d):
    """Distances between the members of a group."""
    from ..operators.joins import pairs_within

    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("g"), F.col("s_acctbal").alias("v"))
    apart = F.abs(F.col("a_v") - F.col("b_v"))
    return pairs_within(p, "k", "g", F.lit(True), ["v"]).groupBy("g").agg(F.count("*").alias("pairs"), F.round(F.avg(apart), 4).alias("mean"), F.round(F.max(apart), 4).alias("high"), (F.max(apart) > 8000).alias("fragmented"))


@query("column_modes", "WITH l AS (SELECT o_custkey AS k, 'o_orderstatus' AS c, o_orderstatus AS v FROM orders UNION ALL SELECT o_custkey, 'o_orderpriority', o_orderpriority FROM orders), n AS (SELECT k, c, v, COUNT(*) AS n FROM l GROUP BY ALL) SELECT k, c AS \"column\", FIRST(v ORDER BY n DESC, v) AS mode FROM n GROUP BY ALL")
def column_modes(spark, d):
    """Modes of several columns in one shuffle."""
    return A.first_source_modes(table(spark, d, "orders").withColumnRenamed("o_custkey", "k"), "k", ["o_orderstatus", "o_orderpriority"])


@query("coverage_audit", "WITH c AS (SELECT c_nationkey AS g, CASE WHEN c_acctbal > 1000 THEN c_acctbal END AS v, c_mktsegment AS why FROM customer), r AS (SELECT g, why, COUNT(*) AS n FROM c WHERE v IS NULL GROUP BY ALL), d AS (SELECT g, FIRST(why ORDER BY n DESC, why) AS main_reason FROM r GROUP BY 1) SELECT g, COUNT(*) AS total, COUNT(v) AS scored, COUNT(*) - COUNT(v) AS unscored, ROUND(COUNT(v) / COUNT(*) * 100, 9) AS pct, ANY_VALUE(main_reason) AS main_reason FROM c LEFT JOIN d USING (g) GROUP BY g")
def coverage_audit(spark, d):
    """How many rows of a group are scored, and why the others are not."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("g"), F.when(F.col("c_acctbal") > 1000, F.col("c_acctbal")).alias("v"), "c_mktsegment")
    return r9(A.coverage_audit(c, "g", "v", F.col("c_mktsegment")), "pct")


@query("pareto_coverage", f"WITH {TRADES}, i AS (SELECT entity, ROW_NUMBER() OVER (ORDER BY COUNT(DISTINCT part) DESC, entity) AS p FROM t GROUP BY 1), b AS (SELECT part, MIN(p) AS p FROM t JOIN i USING (entity) GROUP BY 1) SELECT CAST(k AS INT) AS top, COUNT(*) FILTER (WHERE p <= k) AS covered, ROUND(COUNT(*) FILTER (WHERE p <= k) / COUNT(*) * 100, 9) AS pct FROM b, (SELECT UNNEST([1, 5, 10, 20]) AS k) GROUP BY k")
def pareto_coverage(spark, d):
    """Entities covered by the keys of largest impact."""
    return r9(A.pareto_coverage(trades(spark, d).select("entity", "part"), "entity", "part", [1, 5, 10, 20]), "pct")


@query("metric_table", "SELECT UNNEST(['rows', 'mean', 'median', 'p10', 'p90']) AS metric, ROUND(UNNEST([COUNT(*), AVG(c_acctbal), MEDIAN(c_acctbal), quantile_cont(c_acctbal, 0.1), quantile_cont(c_acctbal, 0.9)]), 4) AS value FROM customer")
def metric_table(spark, d):
    """Scalars as a table of metrics."""
    one = table(spark, d, "customer").agg(F.count("*").cast("double").alias("rows"), F.avg("c_acctbal").alias("mean"), *(F.percentile("c_acctbal", p).alias(n) for p, n in ((0.5, "median"), (0.1, "p10"), (0.9, "p90"))))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), F.round(F.col(c), 4).alias("value")) for c in ("rows", "mean", "median", "p10", "p90")))))


@query("group_audit", f"WITH {ENTITIES}, g AS (SELECT *, (price / AVG(price) OVER () - 1) * 100 AS gap FROM e WHERE price IS NOT NULL) SELECT grp, COUNT(*) AS n, ROUND(AVG(CASE WHEN gap > 0 THEN 1.0 ELSE 0 END), 9) AS positive, ROUND(quantile_cont(gap, 0.25), 9) AS q1, ROUND(quantile_cont(gap, 0.75), 9) AS q3, COUNT(*) FILTER (WHERE ABS(gap) > 2) AS wide FROM g GROUP BY 1")
def group_audit(spark, d):
    """Shares, quartiles and counts of a group's gaps."""
    e = entities(spark, d).where("price is not null").withColumn("gap", (F.col("price") / F.avg("price").over(Window.partitionBy()) - 1) * 100)
    return e.groupBy("grp").agg(F.count("*").alias("n"), F.round(F.avg((F.col("gap") > 0).cast("double")), 9).alias("positive"), F.round(F.percentile("gap", 0.25), 9).alias("q1"), F.round(F.percentile("gap", 0.75), 9).alias("q3"), F.count_if(F.abs("gap") > 2).alias("wide"))


@query("group_bias", f"WITH {ENTITIES}, g AS (SELECT entity, grp, score - 5000 AS gap FROM e), m AS (SELECT grp, MEDIAN(gap) AS m FROM g GROUP BY 1), c AS (SELECT quantile_cont(ABS(m), 0.9) AS gc FROM m), x AS (SELECT quantile_cont(ABS(gap), 0.9) AS ec FROM g) SELECT entity, ABS(m) >= gc AS group_bias, ABS(gap) >= ec AS extreme FROM g JOIN m USING (grp), c, x")
def group_bias(spark, d):
    """Flags of biased groups and of extreme entities."""
    return A.group_bias(entities(spark, d).withColumn("gap", F.col("score") - 5000), "entity", "grp", "gap").select("entity", "group_bias", "extreme")


@query("partition_audit", "WITH a AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 300000), u AS (SELECT c_custkey AS k FROM customer) SELECT k, CONCAT_WS('+', CASE WHEN k IN (SELECT k FROM b) THEN 'big' END, CASE WHEN k IN (SELECT k FROM a) THEN 'rich' END) AS sets, CAST((k IN (SELECT k FROM a))::INT + (k IN (SELECT k FROM b))::INT AS INT) AS n, CASE (k IN (SELECT k FROM a))::INT + (k IN (SELECT k FROM b))::INT WHEN 0 THEN 'LEFTOVER' WHEN 1 THEN 'OK' ELSE 'OVERLAP' END AS status FROM u")
def partition_audit_query(spark, d):
    """Whether each id is in just one of several sets."""
    c = table(spark, d, "customer").withColumn("k", F.col("c_custkey"))
    big = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("k"))
    return partition_audit([("rich", c.where("c_acctbal > 5000")), ("big", big)], c, "k")


@query("bucket_sums", "SELECT l_suppkey, CAST(SUM(CASE WHEN l_quantity <= 10 THEN 1 ELSE 0 END) AS BIGINT) AS b10, CAST(SUM(CASE WHEN l_quantity > 10 AND l_quantity <= 25 THEN 1 ELSE 0 END) AS BIGINT) AS b25, CAST(SUM(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS rest, SUM(CASE WHEN l_quantity <= 10 THEN 1 ELSE 0 END) BETWEEN COUNT(*) * 0.15 AND COUNT(*) * 0.25 AS plausible FROM lineitem GROUP BY 1")
def bucket_sums(spark, d):
    """Counts in buckets, checked against reported ones."""
    q = F.col("l_quantity")
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(q <= 10).alias("b10"), F.count_if((q > 10) & (q <= 25)).alias("b25"), F.count_if(q > 25).alias("rest"), F.count("*").alias("n"))
    return g.select("l_suppkey", "b10", "b25", "rest", F.col("b10").between(F.col("n") * 0.15, F.col("n") * 0.25).alias("plausible"))


@query("as_of_scores", f"WITH {_YEARLY}, a AS (SELECT UNNEST([1997, 1999, 2001]) AS y0) SELECT k, CAST(y0 AS INT) AS \"asof\", CAST(SUM(n) AS BIGINT) AS n, ROUND(SUM(total) / SUM(n), 8) AS mean FROM y, a WHERE yr <= y0 GROUP BY ALL")
def as_of_scores(spark, d):
    """Scores of each year from what was known then."""
    return A.as_of_rows(_yearly(spark, d), "yr", [1997, 1999, 2001]).groupBy("k", "asof").agg(F.sum("n").alias("n"), F.round(F.sum("total") / F.sum("n"), 8).alias("mean"))


@query("crosswalk", "WITH c AS (SELECT p_brand || '-' || p_size AS g, p_type AS c, COUNT(*) AS n FROM part GROUP BY ALL) SELECT g, c, n, ROUND(n / SUM(n) OVER (PARTITION BY g), 9) AS share, CASE WHEN COUNT(*) OVER (PARTITION BY g) = 1 AND COUNT(*) OVER (PARTITION BY c) = 1 THEN 'ONE_TO_ONE' WHEN COUNT(*) OVER (PARTITION BY c) = 1 THEN 'SPLIT' WHEN COUNT(*) OVER (PARTITION BY g) = 1 THEN 'MULTI' ELSE 'MIXED' END AS relation FROM c")
def crosswalk(spark, d):
    """How groups and clusters overlap."""
    return r9(A.crosswalk(table(spark, d, "part").select(F.concat_ws("-", "p_brand", "p_size").alias("g"), F.col("p_type").alias("c")), "g", "c"), "share")


@query("missing_impact", "WITH m AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0) SELECT c_custkey, COUNT(o_orderkey) AS facts, COUNT(DISTINCT o_orderstatus) AS kinds FROM m LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def missing_impact(spark, d):
    """What hangs on keys that lack a source."""
    m = table(spark, d, "customer").where("c_acctbal < 0").select("c_custkey")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    return m.join(o, "c_custkey", "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("facts"), F.count_distinct("o_orderstatus").alias("kinds"))


@query("match_quality", "SELECT o_orderpriority, COUNT(*) AS n, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS matched, ROUND(AVG(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END), 9) AS rate, COUNT(*) FILTER (WHERE o_totalprice > 450000) AS outliers FROM orders GROUP BY 1")
def match_quality(spark, d):
    """Counts, rates and outliers of a matching."""
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("matched"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")), 9).alias("rate"), F.count_if(F.col("o_totalprice") > 450000).alias("outliers"))


@query("worst_level", "SELECT o_custkey, CASE MAX(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END) WHEN 1 THEN 'F' WHEN 2 THEN 'O' ELSE 'P' END AS o_orderstatus FROM orders GROUP BY 1")
def worst_level(spark, d):
    """The worst level of an entity's items, through an order map."""
    return A.worst_level(table(spark, d, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"])
