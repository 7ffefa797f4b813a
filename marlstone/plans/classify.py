"""Queries of filters, classifiers, reason lists and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.order_statistics import exact_quantiles
from ..functions import rules as P
from ..functions import texts as X
from .registry import ENTITIES, TRADES, entities, query, table, trades


@query("facet_filter", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 1000 AND 200000 AND o_custkey >= 100")
def facet_filter(spark, d):
    """A projection under a conjunction of facets; an empty facet filters nothing."""
    facets = [("isin", "o_orderstatus", ["F", "O"]), ("between", "o_totalprice", (1000, 200000)), ("least", "o_custkey", 100), ("isin", "o_orderpriority", [])]
    o = table(spark, d, "orders")
    for kind, name, value in facets:
        if kind == "isin" and value:
            o = o.where(F.col(name).isin(value))
        elif kind == "between":
            o = o.where(F.col(name).between(*value))
        elif kind == "least":
            o = o.where(F.col(name) >= value)
    return o.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("primary_sample", f"WITH {ENTITIES} SELECT entity, grp, deals, ROUND(price, 4) AS price FROM e WHERE area >= 500 AND score IS NOT NULL AND grp IN (0,1,2,3,4,5,6,7,8,9,10,11,12) AND deals >= 3")
def primary_sample(spark, d):
    """The sample that the analyses use."""
    e = entities(spark, d).where((F.col("area") >= 500) & F.col("score").isNotNull() & F.col("grp").isin(*range(13)) & (F.col("deals") >= 3))
    return e.select("entity", "grp", "deals", F.round("price", 4).alias("price"))


@query("trailing_window", f"WITH {TRADES}, w AS (SELECT MAX(deal_date) AS last FROM t) SELECT entity, COUNT(*) FILTER (WHERE deal_date > last - INTERVAL 6 MONTH) AS recent, COUNT(*) FILTER (WHERE deal_date <= last - INTERVAL 6 MONTH) AS previous FROM t, w WHERE deal_date > last - INTERVAL 12 MONTH GROUP BY entity")
def trailing_window(spark, d):
    """The window that ends at the last date of the data, and the one before it."""
    t = trades(spark, d)
    last = t.agg(F.max("deal_date").alias("last"))
    w = t.crossJoin(F.broadcast(last)).where(F.col("deal_date") > F.add_months("last", -12))  # one row
    recent = F.col("deal_date") > F.add_months("last", -6)
    return w.groupBy("entity").agg(F.count_if(recent).alias("recent"), F.count_if(~recent).alias("previous"))


@query("keyword_class", "SELECT p_partkey, CASE WHEN regexp_matches(p_type, 'BRASS|TIN') THEN 'EXCLUDED' WHEN regexp_matches(p_type, 'STEEL|COPPER|ECONOMY|STANDARD') THEN 'INCLUDED' ELSE 'OTHER' END AS scope FROM part")
def keyword_class(spark, d):
    """Include and exclude words, the excluding first."""
    return table(spark, d, "part").select("p_partkey", P.keyword_class(F.col("p_type"), ["BRASS", "TIN"], ["STEEL", "COPPER", "ECONOMY", "STANDARD"]).alias("scope"))


@query("first_match_class", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'LARGE' WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN 'CLOSED' WHEN o_orderpriority LIKE '1%' THEN 'URGENT' ELSE 'OTHER' END AS class FROM orders")
def first_match_class(spark, d):
    """The first rule that holds decides."""
    rules = [(F.col("o_totalprice") > 300000, "LARGE"), ((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000), "CLOSED"), (F.col("o_orderpriority").startswith("1"), "URGENT")]
    return table(spark, d, "orders").select("o_orderkey", P.first_match(rules, "OTHER").alias("class"))


@query("reason_lists", "WITH f AS (SELECT c_custkey, c_acctbal < 0 AS a, c_mktsegment = 'BUILDING' AS b, c_nationkey < 5 AS c FROM customer) SELECT c_custkey, COALESCE(NULLIF(ARRAY_TO_STRING(LIST_FILTER([CASE WHEN a THEN 'NEGATIVE' END, CASE WHEN b THEN 'BUILDING' END, CASE WHEN c THEN 'LOW_NATION' END], lambda x: x IS NOT NULL), ';'), ''), 'NONE') AS why, CASE WHEN a::INT + b::INT + c::INT > 1 THEN 'MULTIPLE' WHEN a THEN 'NEGATIVE' WHEN b THEN 'BUILDING' WHEN c THEN 'LOW_NATION' ELSE 'NONE' END AS flag FROM f")
def reason_lists(spark, d):
    """All reasons that hold as one text, or NONE, or MULTIPLE."""
    flags = [("NEGATIVE", F.col("c_acctbal") < 0), ("BUILDING", F.col("c_mktsegment") == "BUILDING"), ("LOW_NATION", F.col("c_nationkey") < 5)]
    return table(spark, d, "customer").select("c_custkey", P.reason_text(flags).alias("why"), P.reason_text(flags, several="MULTIPLE").alias("flag"))


_GAPS = f"""{ENTITIES}, g AS (SELECT entity, grp, (price / AVG(price) OVER (PARTITION BY grp) - 1) * 100 AS gap, (score / 5000 - 1) * 10 AS other, price, deals FROM e WHERE price IS NOT NULL)"""


def _gaps(spark, d):
    from pyspark.sql import Window

    e = entities(spark, d).where("price is not null")
    return e.select("entity", "grp", ((F.col("price") / F.avg("price").over(Window.partitionBy("grp")) - 1) * 100).alias("gap"), ((F.col("score") / 5000 - 1) * 10).alias("other"), "price", "deals")


@query("sign_and_interval", f"WITH {_GAPS} SELECT entity, CASE WHEN gap > 1 THEN 1 WHEN gap < -1 THEN -1 ELSE 0 END AS sgn, CASE WHEN gap IS NULL THEN 'INSUFFICIENT' WHEN gap - 5 > 0 THEN 'STRONG_UNDER' WHEN gap + 5 < 0 THEN 'STRONG_OVER' WHEN ABS(gap) < 3 THEN 'WITHIN' WHEN gap > 0 THEN 'POTENTIAL_UNDER' ELSE 'POTENTIAL_OVER' END AS status FROM g")
def sign_and_interval(spark, d):
    """Signs with a dead band, and the status of a gap with its interval."""
    g = _gaps(spark, d)
    return g.select("entity", P.sign(F.col("gap"), 1).alias("sgn"), P.interval_status(F.col("gap"), F.col("gap") - 5, F.col("gap") + 5).alias("status"))


@query("sign_patterns", f"WITH {_GAPS}, p AS (SELECT entity, CASE WHEN gap > 0 THEN '+' WHEN gap < 0 THEN '-' ELSE '0' END || CASE WHEN other > 0 THEN '+' WHEN other < 0 THEN '-' ELSE '0' END AS pattern, gap, other FROM g) SELECT entity, pattern, CASE WHEN pattern = '++' THEN 'STABLE_POSITIVE' WHEN pattern = '--' THEN 'STABLE_NEGATIVE' ELSE 'MIXED' END AS stability, CASE WHEN ABS(gap) <= 0.5 OR ABS(other) <= 0.5 THEN 'NEUTRAL_OR_ZERO' WHEN gap > 0 AND other > 0 THEN 'STRONG_POSITIVE' WHEN gap < 0 AND other < 0 THEN 'STRONG_NEGATIVE' WHEN gap > 0 THEN 'MIXED_POSITIVE_RESIDUAL' ELSE 'MIXED_POSITIVE_COMPARABLE' END AS agreement FROM p")
def sign_patterns(spark, d):
    """Patterns of signs over several values, and the agreement of two methods."""
    g, both = _gaps(spark, d), [F.col("gap"), F.col("other")]
    return g.select("entity", P.sign_pattern(both).alias("pattern"), P.sign_stability(both).alias("stability"), P.agreement(*both).alias("agreement"))


@query("signal_classes", f"WITH {_GAPS}, p AS (SELECT *, LEAST(1, GREATEST(0, 0.5 + gap / 20)) AS prob FROM g) SELECT entity, CASE WHEN prob >= 0.9 THEN 'VERY_STABLE_POSITIVE' WHEN prob >= 0.75 THEN 'STABLE_POSITIVE' WHEN prob <= 0.1 THEN 'VERY_STABLE_NEGATIVE' WHEN prob <= 0.25 THEN 'STABLE_NEGATIVE' ELSE 'MIXED' END AS likely, CASE WHEN gap > 2 THEN 'HIGH' WHEN gap < -2 THEN 'LOW' ELSE 'NEUTRAL' END || '_' || CASE WHEN other > 2 THEN 'HIGH' WHEN other < -2 THEN 'LOW' ELSE 'NEUTRAL' END AS quadrant, CASE WHEN (gap > 4)::INT + (other > 4)::INT >= 2 THEN 'UP' WHEN (gap < -4)::INT + (other < -4)::INT >= 2 THEN 'DOWN' ELSE 'NONE' END AS lasting FROM p")
def signal_classes(spark, d):
    """Probability classes, quadrants of two signals, persistent signals."""
    g = _gaps(spark, d)
    prob = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + F.col("gap") / 20))
    return g.select("entity", P.probability_class(prob).alias("likely"), P.quadrant(F.col("gap"), F.col("other"), 2).alias("quadrant"), P.persistent([F.col("gap"), F.col("other")], 4).alias("lasting"))


@query("tiers_and_grades", f"WITH {_GAPS}, f AS (SELECT entity, deals < 600 AS few, ABS(gap) > 10 AS wide, other < 0 AS low FROM g) SELECT entity, CASE WHEN NOT few AND NOT wide AND NOT low THEN 'TIER_1' WHEN few::INT + wide::INT + low::INT = 1 THEN 'TIER_2' ELSE 'TIER_3' END AS tier, COALESCE(NULLIF(ARRAY_TO_STRING(LIST_FILTER([CASE WHEN few THEN 'FEW_DEALS' END, CASE WHEN wide THEN 'WIDE_GAP' END, CASE WHEN low THEN 'LOW_SCORE' END], lambda x: x IS NOT NULL), ';'), ''), 'NONE') AS failed, CASE WHEN NOT few AND NOT wide THEN 'HIGH' WHEN NOT few OR NOT wide THEN 'MEDIUM' ELSE 'LOW' END AS confidence, CASE WHEN wide THEN 'MAJOR' WHEN few OR low THEN 'MINOR' ELSE 'NONE' END AS severity FROM f")
def tiers_and_grades(spark, d):
    """Tiers with the conditions that failed, confidence grades, severity of flags."""
    g = _gaps(spark, d)
    few, wide, low = F.col("deals") < 600, F.abs("gap") > 10, F.col("other") < 0
    failed = P.reasons([("FEW_DEALS", few), ("WIDE_GAP", wide), ("LOW_SCORE", low)])
    tier = P.first_match([(F.size(failed) == 0, "TIER_1"), (F.size(failed) == 1, "TIER_2")], "TIER_3")
    grade = P.first_match([(~few & ~wide, "HIGH"), (~few | ~wide, "MEDIUM")], "LOW")
    return g.select("entity", tier.alias("tier"), P.reason_text([("FEW_DEALS", few), ("WIDE_GAP", wide), ("LOW_SCORE", low)]).alias("failed"), grade.alias("confidence"), P.severity([wide], [few, low]).alias("severity"))


@query("quantile_groups", f"WITH {ENTITIES}, c AS (SELECT CAST(0.2 AS DOUBLE) AS k, quantile_cont(score, 0.8) AS s, quantile_cont(price, 0.8) AS p FROM e WHERE price IS NOT NULL UNION ALL SELECT 0.3, quantile_cont(score, 0.7), quantile_cont(price, 0.7) FROM e WHERE price IS NOT NULL UNION ALL SELECT 0.5, quantile_cont(score, 0.5), quantile_cont(price, 0.5) FROM e WHERE price IS NOT NULL) SELECT k, CASE WHEN score >= s THEN 'HIGH' ELSE 'LOW' END || '_' || CASE WHEN price >= p THEN 'HIGH' ELSE 'LOW' END AS cell, COUNT(*) AS n FROM e, c WHERE price IS NOT NULL GROUP BY 1, 2")
def quantile_groups(spark, d):
    """Two-by-two groups at several cutoffs at once."""
    e = entities(spark, d).where("price is not null")
    shares = [0.2, 0.3, 0.5]
    one = exact_quantiles(e, [], ["score", "price"], [1 - k for k in shares]).select(F.col("score").alias("s"), F.col("price").alias("p"))
    grid = one.select(F.inline(F.arrays_zip(F.array(*map(F.lit, shares)).alias("k"), "s", "p")))
    side = lambda v, c: F.when(F.col(v) >= F.col(c), "HIGH").otherwise("LOW")
    return e.crossJoin(F.broadcast(grid)).groupBy("k", F.concat_ws("_", side("score", "s"), side("price", "p")).alias("cell")).agg(F.count("*").alias("n"))  # a row for each share


@query("bands_and_bins", "SELECT p_partkey, CASE WHEN p_size <= 10 THEN 100 WHEN p_size <= 20 THEN 70 WHEN p_size <= 40 THEN 40 ELSE 10 END AS band_score, CASE WHEN p_retailprice >= 1800 THEN 'A' WHEN p_retailprice >= 1400 THEN 'B' WHEN p_retailprice >= 1000 THEN 'C' ELSE 'D' END AS grade, CASE WHEN p_size > 0 AND p_size <= 15 THEN 'small' WHEN p_size > 15 AND p_size <= 30 THEN 'mid' WHEN p_size > 30 AND p_size <= 50 THEN 'large' END AS right_bin, CASE WHEN p_size >= 0 AND p_size < 15 THEN 'small' WHEN p_size >= 15 AND p_size < 30 THEN 'mid' WHEN p_size >= 30 AND p_size < 50 THEN 'large' END AS left_bin FROM part")
def bands_and_bins(spark, d):
    """Banded scores, grade letters, and bins closed on either side."""
    p, size = table(spark, d, "part"), F.col("p_size")
    grade = P.first_match([(F.col("p_retailprice") >= x, g) for x, g in ((1800, "A"), (1400, "B"), (1000, "C"))], "D")
    edges, labels = [0, 15, 30, 50], ["small", "mid", "large"]
    return p.select("p_partkey", P.band(size, [(10, 100), (20, 70), (40, 40)], 10).alias("band_score"), grade.alias("grade"), P.bin_label(size, edges, labels).alias("right_bin"), P.bin_label(size, edges, labels, right=False).alias("left_bin"))


@query("difference_causes", "WITH a AS (SELECT l_suppkey AS k, COUNT(*) AS n, COUNT(DISTINCT l_orderkey) AS m FROM lineitem GROUP BY 1) SELECT k, m AS listed, n AS registered, CASE WHEN m = n THEN 'EXACT' WHEN ABS(m - n) <= 3 THEN 'MINOR_DIFFERENCE' WHEN n - m IN (15, 32, 46, 48, 64, 71, 75, 80) THEN 'RENTAL_DIFFERENCE' WHEN n - m >= 100 THEN 'SPLIT_OR_UNREGISTERED' ELSE 'DATA_DIFFERENCE' END AS cause FROM a")
def difference_causes(spark, d):
    """Why two counts of one entity differ."""
    o = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count_distinct("l_orderkey").alias("listed"), F.count("*").alias("registered"))
    return o.select("k", "listed", "registered", P.difference_cause(F.col("listed"), F.col("registered")).alias("cause"))


@query("gate_router", "SELECT c_custkey, CASE WHEN NOT COALESCE(c_acctbal > 0, false) THEN 'PENDING' WHEN NOT c_nationkey < 20 THEN 'PENDING' WHEN NOT c_mktsegment <> 'MACHINERY' THEN 'PENDING' ELSE 'VERIFIED' END AS status, CASE WHEN NOT COALESCE(c_acctbal > 0, false) THEN 'NO_BALANCE' WHEN NOT c_nationkey < 20 THEN 'FAR_NATION' WHEN NOT c_mktsegment <> 'MACHINERY' THEN 'SEGMENT' END AS reason, CASE WHEN NOT COALESCE(c_acctbal > 0, false) THEN 'collect' WHEN NOT c_nationkey < 20 THEN 'review' WHEN NOT c_mktsegment <> 'MACHINERY' THEN 'review' END AS action FROM customer")
def gate_router(spark, d):
    """Ordered gates; the first that fails gives the reason and the next action."""
    checks = [(F.col("c_acctbal") > 0, "NO_BALANCE", "collect"), (F.col("c_nationkey") < 20, "FAR_NATION", "review"), (F.col("c_mktsegment") != "MACHINERY", "SEGMENT", "review")]
    return table(spark, d, "customer").select("c_custkey", P.gate(checks).alias("g")).select("c_custkey", "g.*")


@query("tercile_grades", f"WITH {_GAPS}, q AS (SELECT quantile_cont(gap, 1.0/3) AS a, quantile_cont(gap, 2.0/3) AS b FROM g) SELECT entity, CASE WHEN deals < 550 THEN 'NO_BASIS' WHEN gap <= a THEN 'LOW' WHEN gap <= b THEN 'MEDIUM' ELSE 'HIGH' END AS grade FROM g, q")
def tercile_grades(spark, d):
    """P25: grades by terciles, with a special case before them."""
    from ..functions.ranks import with_quantiles

    g = with_quantiles(_gaps(spark, d), "gap", a=1 / 3, b=2 / 3)
    return g.select("entity", P.first_match([(F.col("deals") < 550, "NO_BASIS"), (F.col("gap") <= F.col("a"), "LOW"), (F.col("gap") <= F.col("b"), "MEDIUM")], "HIGH").alias("grade"))


@query("membership_status", "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'MASTER' WHEN c_acctbal < 0 THEN 'EXCLUDED' WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'PENDING' ELSE 'NONE' END AS status, (SELECT COUNT(*) FROM orders o WHERE o.o_custkey = c_custkey) AS rows_n FROM customer")
def membership_status(spark, d):
    """The status of an id by the sets it is in, with its number of rows."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.bool_or(F.col("o_orderstatus") == "F").alias("closed"))
    c = table(spark, d, "customer").join(o, "c_custkey", "left")
    status = P.first_match([(F.col("closed"), "MASTER"), (F.col("c_acctbal") < 0, "EXCLUDED"), (F.col("n") > 0, "PENDING")], "NONE")
    return c.select("c_custkey", status.alias("status"), F.coalesce("n", F.lit(0)).alias("rows_n"))


@query("target_rows", "SELECT 'C' || LPAD(CAST(c_custkey AS VARCHAR), 8, '0') AS code, c_mktsegment AS type_name, 'registry:' || c_mktsegment AS source, '' AS valid_from, CASE WHEN c_acctbal > 0 THEN 'verified' ELSE 'pending' END AS verification_status, TRUE AS is_current FROM customer")
def target_rows(spark, d):
    """Rows of a fixed schema, with provenance and blanks by rule."""
    c = table(spark, d, "customer")
    return c.select(F.concat(F.lit("C"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("code"), F.col("c_mktsegment").alias("type_name"), F.concat(F.lit("registry:"), "c_mktsegment").alias("source"), F.lit("").alias("valid_from"), F.when(F.col("c_acctbal") > 0, "verified").otherwise("pending").alias("verification_status"), F.lit(True).alias("is_current"))


@query("source_mix", "SELECT o_custkey, CASE WHEN BOOL_OR(o_orderstatus = 'F') AND BOOL_OR(o_orderstatus = 'O') THEN 'MIXED' WHEN BOOL_OR(o_orderstatus = 'F') THEN 'OFFICIAL' WHEN BOOL_OR(o_orderstatus = 'O') THEN 'MANUAL' ELSE 'NONE' END AS mix FROM orders GROUP BY 1")
def source_mix(spark, d):
    """Whether a list comes from one source, the other, or both."""
    some = lambda s: F.bool_or(F.col("o_orderstatus") == s)
    return table(spark, d, "orders").groupBy("o_custkey").agg(P.first_match([(some("F") & some("O"), "MIXED"), (some("F"), "OFFICIAL"), (some("O"), "MANUAL")], "NONE").alias("mix"))


@query("name_keys", r"SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(LOWER(p_name), '\([^)]*\)|\[[^\]]*\]', '', 'g'), '[^\p{L}\p{N}]', '', 'g'), '(?:아파트|apartments?|apts?)$', '') AS name_key, LPAD(regexp_extract(p_name, '(\d+)', 1), 4, '0') AS number_key FROM part")
def name_keys(spark, d):
    """Keys from names."""
    number = F.regexp_extract("p_name", r"(\d+)", 1)
    return table(spark, d, "part").select("p_partkey", X.entity_name(F.col("p_name")).alias("name_key"), F.lpad(number, 4, "0").alias("number_key"))


@query("decimal_keys", "SELECT p_partkey, 'exclusive_' || REPLACE(RTRIM(RTRIM(CAST(CAST(p_retailprice AS DECIMAL(18,6)) AS VARCHAR), '0'), '.'), '.', '_') AS group_id FROM part")
def decimal_keys(spark, d):
    """F8: group ids from exact decimals."""
    return table(spark, d, "part").select("p_partkey", X.group_id(F.col("p_retailprice")).alias("group_id"))


@query("transforms", f"WITH {TRADES} SELECT entity, deal, part, (unit / NULLIF(area, 0) - 1) * 100 AS gap_pct, ROUND((EXP(discount) - 1) * 100, 6) AS effect_pct, CASE WHEN discount > 0 THEN amount / NULLIF(discount, 0) END AS rate, YEAR(deal_date) || 'Q' || QUARTER(deal_date) AS quarter, STRFTIME(deal_date, '%Y-%m') AS year_month, CAST((YEAR(deal_date) - 1995) * 12 + MONTH(deal_date) - 1 AS INT) AS month_index FROM t")
def transforms(spark, d):
    """gaps in percent, guarded rates, parts of dates."""
    t = trades(spark, d)
    dates = X.date_parts(F.col("deal_date"), F.to_date(F.lit("1995-01-01")))
    return t.select("entity", "deal", "part", P.percent_gap(F.col("unit"), F.col("area")).alias("gap_pct"), F.round(P.log_to_percent(F.col("discount")), 6).alias("effect_pct"), F.when(F.col("discount") > 0, P.ratio(F.col("amount"), F.col("discount"))).alias("rate"), dates["quarter"].alias("quarter"), dates["year_month"].alias("year_month"), dates["month_index"].alias("month_index"))


@query("address_queries", "SELECT c_custkey, 1 AS priority, c_name || ' ' || c_mktsegment AS query FROM customer UNION ALL SELECT c_custkey, 2, c_name FROM customer")
def address_queries(spark, d):
    """search texts in order of priority, each compact form once."""
    c = table(spark, d, "customer")
    return X.address_candidates(c, "c_custkey", [["c_name", "c_mktsegment"], ["c_name"], ["c_name"]]).select("c_custkey", "priority", "query")


@query("event_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, DAY(ts) AS day_n FROM events")
def event_fields(spark, d):
    """IO5, F24: typed fields from a JSON text."""
    e = table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.dayofmonth("ts").cast("long").alias("day_n"))
