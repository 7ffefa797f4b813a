"""Queries of ranks, quantiles, top lists and window functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ranks as R
from ..functions.order_statistics import ranked
from .registry import ENTITIES, TRADES, entities, query, table, trades


@query("rank_percentile", "SELECT c_custkey, c_nationkey, ROUND(100.0 * (RANK() OVER (ORDER BY c_acctbal) + (COUNT(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0) / COUNT(c_acctbal) OVER (), 6) AS pct, ROUND(100.0 * (RANK() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) + (COUNT(*) OVER (PARTITION BY c_nationkey, c_acctbal) - 1) / 2.0) / COUNT(c_acctbal) OVER (PARTITION BY c_nationkey), 6) AS group_pct FROM customer")
def rank_percentile(spark, d):
    """Tie-averaged percentile ranks, over all rows and by group."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    c = ranked(ranked(c, "c_acctbal", share="pct"), "c_acctbal", ["c_nationkey"], share="group_pct")
    return c.select("c_custkey", "c_nationkey", F.round("pct", 6).alias("pct"), F.round("group_pct", 6).alias("group_pct"))


@query("rank_min_desc", "SELECT p_partkey, p_brand, RANK() OVER (ORDER BY p_size DESC) AS rank_all, RANK() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS rank_brand, ROUND((COUNT(*) OVER () - RANK() OVER (ORDER BY p_size DESC)) * 100.0 / GREATEST(COUNT(*) OVER () - 1, 1), 6) AS reverse_pct FROM part")
def rank_min_desc(spark, d):
    """Minimum ranks from the largest, and the reverse percentile."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    p = ranked(ranked(p, "p_size", descending=True, first="rank_all", rows="n"), "p_size", ["p_brand"], descending=True, first="rank_brand")
    reverse = (F.col("n") - F.col("rank_all")) / F.greatest(F.col("n") - 1, F.lit(1)) * 100
    return p.select("p_partkey", "p_brand", "rank_all", "rank_brand", F.round(reverse, 6).alias("reverse_pct"))


@query("winsorise", "WITH q AS (SELECT quantile_cont(c_acctbal, 0.05) AS lo, quantile_cont(c_acctbal, 0.95) AS hi FROM customer) SELECT c_custkey, ROUND(LEAST(GREATEST(c_acctbal, lo), hi), 4) AS clipped FROM customer, q")
def winsorise(spark, d):
    """Values clipped to their own quantiles."""
    return R.winsorised(table(spark, d, "customer"), "c_acctbal", 0.05, 0.95, "clipped").select("c_custkey", F.round("clipped", 4).alias("clipped"))


@query("group_demean", "SELECT c_custkey, ROUND(c_acctbal - AVG(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS demeaned, COUNT(*) OVER (PARTITION BY c_nationkey) AS members FROM customer QUALIFY COUNT(*) OVER (PARTITION BY c_nationkey) >= 3")
def group_demean(spark, d):
    """Group-demeaned values of groups with at least three members."""
    by = Window.partitionBy("c_nationkey")
    c = table(spark, d, "customer").withColumn("members", F.count("*").over(by)).withColumn("demeaned", F.round(F.col("c_acctbal") - F.avg("c_acctbal").over(by), 4))
    return c.where("members >= 3").select("c_custkey", "demeaned", "members")


@query("row_sequence", "SELECT o_orderkey, o_custkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS seq FROM orders")
def row_sequence(spark, d):
    """The number of a row within its key, from 0."""
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.row_number().over(by) - 1).cast("long").alias("seq"))


@query("class_ranking", "SELECT o_orderkey, o_orderstatus, ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY CAST(SUBSTR(o_orderpriority, 1, 1) AS INT), o_totalprice DESC, o_orderdate, o_orderkey) AS place FROM orders WHERE SUBSTR(o_orderpriority, 1, 1) BETWEEN '1' AND '5'")
def class_ranking(spark, d):
    """Places within a class by several keys, one of them through an order map."""
    o = table(spark, d, "orders").withColumn("p", F.substring("o_orderpriority", 1, 1)).where(F.col("p").between("1", "5"))
    order = F.create_map(*(F.lit(x) for i in range(1, 6) for x in (str(i), i)))[F.col("p")]
    by = Window.partitionBy("o_orderstatus").orderBy(order, F.col("o_totalprice").desc(), "o_orderdate", "o_orderkey")
    return o.select("o_orderkey", "o_orderstatus", F.row_number().over(by).cast("long").alias("place"))


@query("rank_scenarios", f"WITH {ENTITIES}, r AS (SELECT entity, RANK() OVER (ORDER BY score DESC) AS r1, RANK() OVER (ORDER BY price DESC) AS r2, RANK() OVER (ORDER BY score * 0.001 + price DESC) AS r3 FROM e WHERE price IS NOT NULL) SELECT entity, LEAST(r1, r2, r3) AS best, GREATEST(r1, r2, r3) AS worst, GREATEST(r1, r2, r3) - LEAST(r1, r2, r3) AS spread, GREATEST(r1, r2, r3) - LEAST(r1, r2, r3) > 20 AS sensitive FROM r")
def rank_scenarios(spark, d):
    """How far ranks move between scenarios."""
    e = entities(spark, d).where("price is not null")
    e = e.withColumn("third", F.col("score") * 0.001 + F.col("price"))
    rs = [R.min_rank_desc(c).cast("long") for c in ("score", "price", "third")]
    e = e.withColumns({"r1": rs[0], "r2": rs[1], "r3": rs[2]})
    low, high = F.least("r1", "r2", "r3"), F.greatest("r1", "r2", "r3")
    return e.select("entity", low.alias("best"), high.alias("worst"), (high - low).alias("spread"), (high - low > 20).alias("sensitive"))


@query("month_change", f"WITH {TRADES}, m AS (SELECT STRFTIME(deal_date, '%Y-%m') AS month, MEDIAN(unit) AS price FROM t GROUP BY 1), c AS (SELECT month, price, price / LAG(price) OVER (ORDER BY month) - 1 AS change FROM m) SELECT month, ROUND(price, 4) AS price, ROUND(change, 6) AS change, CASE WHEN change > 0 THEN 'RISE' WHEN change < 0 THEN 'DECLINE' WHEN change = 0 THEN 'FLAT' END AS label FROM c")
def month_change(spark, d):
    """Change of the monthly median to the month before."""
    m = trades(spark, d).groupBy(F.date_format("deal_date", "yyyy-MM").alias("month")).agg(F.percentile("unit", 0.5).alias("price"))
    # one row for each month
    m = m.withColumn("change", F.col("price") / F.lag("price").over(Window.orderBy("month")) - 1)
    label = F.when(F.col("change") > 0, "RISE").when(F.col("change") < 0, "DECLINE").when(F.col("change") == 0, "FLAT")
    return m.select("month", F.round("price", 4).alias("price"), F.round("change", 6).alias("change"), label.alias("label"))


@query("latest_row", "SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_row(spark, d):
    """The last row of each key."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    return R.latest_row(o, "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


@query("quintiles", "WITH p AS (SELECT c_custkey, 100.0 * (RANK() OVER (ORDER BY c_acctbal) + (COUNT(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0) / COUNT(*) OVER () AS pct, ROW_NUMBER() OVER (ORDER BY c_acctbal, c_custkey) AS r, COUNT(*) OVER () AS n FROM customer) SELECT c_custkey, CAST(GREATEST(1, CEIL(pct / 20)) AS INT) AS by_rank, CAST(GREATEST(1, CEIL(5.0 * (r - 1) / GREATEST(n - 1, 1))) AS INT) AS by_row FROM p")
def quintiles(spark, d):
    """Quintiles from percentile ranks, and from row numbers."""
    c = ranked(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", share="pct")
    by_rank = F.greatest(F.lit(1), F.ceil(F.col("pct") / 20)).cast("int")
    return R.with_row_quantile(c, "c_acctbal", 5, "c_custkey", "by_row").select("c_custkey", by_rank.alias("by_rank"), "by_row")


@query("row_statistics", "SELECT l_orderkey, l_linenumber, l_partkey, ROUND(LEAST(a, b, c), 6) AS low, ROUND(GREATEST(a, b, c), 6) AS high, ROUND(GREATEST(a, b, c) - LEAST(a, b, c), 6) AS spread, ROUND(a + b + c - LEAST(a, b, c) - GREATEST(a, b, c), 6) AS middle FROM (SELECT *, l_discount AS a, l_tax AS b, l_quantity / 100 AS c FROM lineitem)")
def row_statistics(spark, d):
    """Statistics across the columns of a row."""
    values = F.array(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 100)
    low, high = F.array_min(values), F.array_max(values)
    middle = F.get(F.array_sort(values), F.lit(1))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), F.round(high - low, 6).alias("spread"), F.round(middle, 6).alias("middle"))


@query("outlier_flags", f"WITH {ENTITIES}, g AS (SELECT entity, price - AVG(price) OVER (PARTITION BY grp) AS gap, (price - AVG(price) OVER ()) / STDDEV_SAMP(price) OVER () AS z FROM e WHERE price IS NOT NULL), q AS (SELECT quantile_cont(ABS(gap), 0.9) AS p90 FROM g) SELECT entity, ABS(gap) >= p90 AS large_gap, ABS(z) > 2 AS outlier FROM g, q")
def outlier_flags(spark, d):
    """Flags above the 90th percentile of absolute gaps, and by z-score."""
    e = entities(spark, d).where("price is not null")
    whole = e.agg(F.avg("price").alias("m"), F.stddev_samp("price").alias("s"))
    e = e.crossJoin(F.broadcast(whole))  # one row
    g = e.withColumns({"gap": F.col("price") - F.avg("price").over(Window.partitionBy("grp")), "z": (F.col("price") - F.col("m")) / F.col("s")})
    g = R.with_quantiles(g.withColumn("size", F.abs("gap")), "size", p90=0.9)
    return g.select("entity", (F.col("size") >= F.col("p90")).alias("large_gap"), (F.abs("z") > 2).alias("outlier"))


@query("capital_ranking", "WITH c AS (SELECT o_custkey, c_nationkey, SUM(o_totalprice) AS cap FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2) SELECT o_custkey, ROUND(cap / 1e6, 4) AS cap_m, RANK() OVER (ORDER BY ROUND(cap, 2) DESC) AS rank_all, RANK() OVER (PARTITION BY c_nationkey ORDER BY ROUND(cap, 2) DESC) AS rank_group FROM c")
def capital_ranking(spark, d):
    """Ranks by a total, over all rows and by group."""
    c = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy("o_custkey", "c_nationkey").agg(F.sum("o_totalprice").alias("sum"))
    c = c.withColumn("cap", F.round("sum", 2))
    c = ranked(ranked(c, "cap", descending=True, first="rank_all"), "cap", ["c_nationkey"], descending=True, first="rank_group")
    return c.select("o_custkey", F.round(F.col("sum") / 1e6, 4).alias("cap_m"), "rank_all", "rank_group")


@query("top_lists", "(SELECT 'largest' AS list, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30) UNION ALL (SELECT 'smallest', o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 30) UNION ALL (SELECT 'urgent', o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 30)")
def top_lists(spark, d):
    """Named top and bottom lists, with filters, in one table."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    spec = [("largest", F.lit(True), F.col("o_totalprice").desc()), ("smallest", F.lit(True), F.col("o_totalprice").asc()), ("urgent", F.col("o_orderstatus") == "F", F.col("o_totalprice").desc())]
    parts = [o.where(keep).orderBy(order, "o_orderkey").limit(30).select(F.lit(name).alias("list"), "o_orderkey", "o_totalprice") for name, keep, order in spec]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("top_per_group", "SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")
def top_per_group(spark, d):
    """L2: the first rows of each group."""
    return R.top_per_group(table(spark, d, "customer"), ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 3).select("c_nationkey", "c_custkey", "c_acctbal")


@query("ranking_overlap", f"WITH {ENTITIES}, r AS (SELECT ROW_NUMBER() OVER (ORDER BY score DESC, entity) AS a, ROW_NUMBER() OVER (ORDER BY price DESC, entity) AS b FROM e WHERE price IS NOT NULL) SELECT CAST(SUM(CASE WHEN a <= 20 AND b <= 20 THEN 1 ELSE 0 END) AS BIGINT) AS overlap, ROUND(CORR(a, b), 6) AS rho FROM r")
def ranking_overlap(spark, d):
    """L4: overlap of two top lists and the correlation of their ranks."""
    e = entities(spark, d).where("price is not null")
    place = lambda c: F.row_number().over(Window.orderBy(F.col(c).desc(), "entity"))
    r = e.select(place("score").alias("a"), place("price").alias("b"))
    return r.agg(F.count_if((F.col("a") <= 20) & (F.col("b") <= 20)).alias("overlap"), F.round(F.corr("a", "b"), 6).alias("rho"))


@query("stable_order", "SELECT o_orderkey, o_custkey, o_totalprice, ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate NULLS LAST, o_totalprice DESC NULLS LAST, o_orderkey) AS position FROM orders")
def stable_order(spark, d):
    """A total order that ends with an id, published as positions."""
    by = Window.partitionBy("o_orderstatus").orderBy(F.col("o_orderdate").asc_nulls_last(), F.col("o_totalprice").desc_nulls_last(), "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.row_number().over(by).cast("long").alias("position"))


@query("rank_correlation", f"WITH {ENTITIES}, x AS (SELECT grp, RANK() OVER (PARTITION BY grp ORDER BY score) + (COUNT(*) OVER (PARTITION BY grp, score) - 1) / 2.0 AS a, RANK() OVER (PARTITION BY grp ORDER BY price) + (COUNT(*) OVER (PARTITION BY grp, price) - 1) / 2.0 AS b FROM e WHERE score IS NOT NULL AND price IS NOT NULL) SELECT grp, CASE WHEN COUNT(*) >= 3 AND MIN(a) < MAX(a) AND MIN(b) < MAX(b) THEN ROUND(CORR(a, b), 6) END AS rho, COUNT(*) AS n FROM x GROUP BY grp")
def rank_correlation(spark, d):
    """T5: rank correlation by group over complete rows."""
    return R.spearman(entities(spark, d), "score", "price", ["grp"]).select("grp", F.round("rho", 6).alias("rho"), "n")
