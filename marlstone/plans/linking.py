"""Queries of joins, matching and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import haversine_m, planar_km
from ..operators import joins as J
from ..operators import sets as U
from .registry import ENTITIES, TRADES, entities, query, table, trades


@query("join_validated", "SELECT o_orderkey, c_nationkey, n_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def join_validated(spark, d):
    """Many-to-one joins on checked keys."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return J.join_one(J.join_one(table(spark, d, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey"), n, "c_nationkey").select("o_orderkey", "c_nationkey", "n_name")


@query("join_three_sources", "WITH a AS (SELECT o_custkey AS k, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, COUNT(*) AS m FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), c AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000) SELECT k, n, m, CONCAT_WS('+', CASE WHEN n IS NOT NULL THEN 'closed' END, CASE WHEN m IS NOT NULL THEN 'partial' END, CASE WHEN k IN (SELECT k FROM c) THEN 'rich' END) AS available FROM a FULL JOIN b USING (k) FULL JOIN c USING (k)")
def join_three_sources(spark, d):
    """A full one-to-one join with the sources that have a key."""
    o = table(spark, d, "orders")
    part = lambda s, name: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias(name))
    rich = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k"))
    return J.join_sources([("closed", part("F", "n")), ("partial", part("P", "m")), ("rich", rich)], "k").select("k", "n", "m", "available")


@query("linkage_audit", "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 300000), b AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) SELECT k, CASE WHEN b.k IS NULL THEN 'LEFT_ONLY' WHEN a.k IS NULL THEN 'RIGHT_ONLY' ELSE 'BOTH' END AS link FROM a FULL JOIN b USING (k)")
def linkage_audit(spark, d):
    """Which side of a join a key is on."""
    a = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("k"))
    return J.linkage(a, table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), "k")


@query("join_multi_key", f"WITH {TRADES}, m AS (SELECT entity, STRFTIME(deal_date, '%Y-%m') AS month, flag, COUNT(*) AS n FROM t GROUP BY ALL), p AS (SELECT entity, STRFTIME(deal_date, '%Y-%m') AS month, flag, MEDIAN(unit) AS price FROM t GROUP BY ALL) SELECT entity, month, flag, n, price FROM m LEFT JOIN p USING (entity, month, flag)")
def join_multi_key(spark, d):
    """A join on entity, month and group; both sides share one shuffle."""
    t = trades(spark, d).withColumn("month", F.date_format("deal_date", "yyyy-MM"))
    by = ["entity", "month", "flag"]
    return t.groupBy(*by).agg(F.count("*").alias("n")).join(t.groupBy(*by).agg(F.percentile("unit", 0.5).alias("price")), by, "left")


@query("semi_and_anti", "SELECT c_custkey, TRUE AS active FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) UNION ALL SELECT c_custkey, FALSE FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_and_anti(spark, d):
    """Semi and anti joins, the missing ones as placeholders."""
    big = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    c = table(spark, d, "customer").select("c_custkey")
    active = c.join(big, "c_custkey", "left_semi").withColumn("active", F.lit(True))
    return J.with_placeholders(active, c, "c_custkey").withColumn("active", F.coalesce("active", F.lit(False)))


@query("fill_ids", "WITH f AS (SELECT p_type, p_partkey FROM part QUALIFY ROW_NUMBER() OVER (PARTITION BY p_type ORDER BY p_retailprice, p_partkey) = 1) SELECT p.p_name, CASE WHEN p.p_size > 25 THEN p.p_partkey ELSE f.p_partkey END AS ident FROM part p JOIN f USING (p_type)")
def fill_ids(spark, d):
    """Missing ids filled through a name key."""
    p = table(spark, d, "part")
    known = p.select("p_name", "p_type", F.when(F.col("p_size") > 25, F.col("p_partkey")).alias("ident"))
    return J.fill_by_name(known, p.withColumn("ident", F.col("p_partkey")), "ident", "p_type", [F.col("p_retailprice"), F.col("p_partkey")]).select("p_name", "ident")


@query("resolve_names", "WITH x AS (SELECT p_partkey AS item, p_brand AS k, p_size AS s FROM part), c AS (SELECT p_partkey AS id, p_brand AS k, p_size AS s FROM part), g AS (SELECT item, COUNT(DISTINCT id) AS n, MIN(id) AS one, COUNT(DISTINCT CASE WHEN x.s = c.s THEN id END) AS m, MIN(CASE WHEN x.s = c.s THEN id END) AS two FROM x LEFT JOIN c USING (k) GROUP BY item) SELECT item, CASE WHEN n = 1 THEN one WHEN m = 1 THEN two END AS ident, CASE WHEN n = 1 THEN 'UNIQUE' WHEN m = 1 THEN 'BY_SECOND' WHEN n = 0 THEN 'NO_CANDIDATE' ELSE 'AMBIGUOUS' END AS status FROM g")
def resolve_names(spark, d):
    """The only candidate of a name, or the only one with the same second attribute."""
    p = table(spark, d, "part")
    items = p.select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("k"), F.col("p_size").alias("s"))
    candidates = p.select(F.col("p_partkey").alias("ident"), F.col("p_brand").alias("k"), F.col("p_size").alias("s"))
    return J.resolve_names(items, candidates, "item", "k", "s", "ident")


@query("cascade_match", "WITH r AS (SELECT p_partkey AS item, p_brand AS b, p_type AS t, p_size AS s FROM part), l AS (SELECT p_partkey AS id, p_brand AS b, p_type AS t, p_size AS s FROM part), one AS (SELECT b, t, s, MIN(id) AS id FROM l GROUP BY ALL HAVING COUNT(DISTINCT id) = 1), two AS (SELECT b, s, MIN(id) AS id FROM l GROUP BY ALL HAVING COUNT(DISTINCT id) = 1) SELECT item, COALESCE(one.id, two.id) AS ident, CASE WHEN one.id IS NOT NULL THEN 'exact' WHEN two.id IS NOT NULL THEN 'brand' ELSE 'none' END AS method FROM r LEFT JOIN one USING (b, t, s) LEFT JOIN two USING (b, s)")
def cascade_match(spark, d):
    """Lookups by priority, each used only where it gives one id."""
    p = table(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("b"), F.col("p_type").alias("t"), F.col("p_size").alias("s"))
    lookup = p.select(F.col("p_partkey").alias("ident"), F.col("p_brand").alias("b"), F.col("p_type").alias("t"), F.col("p_size").alias("s"))
    return J.cascade(rows, [("exact", lookup, ["b", "t", "s"]), ("brand", lookup, ["b", "s"])], "item", "ident")


_SCORED = """p AS (SELECT a.p_partkey AS l, b.p_partkey AS r, (CASE WHEN ABS(a.p_size - b.p_size) <= 3 THEN 40.0 ELSE 0 END) + (CASE WHEN ABS(a.p_retailprice - b.p_retailprice) <= 50 THEN 30.0 ELSE 0 END) + (CASE WHEN a.p_size = b.p_size THEN 20.0 ELSE 0 END) AS score, CONCAT_WS(';', CASE WHEN ABS(a.p_size - b.p_size) <= 3 THEN 'size' END, CASE WHEN ABS(a.p_retailprice - b.p_retailprice) <= 50 THEN 'price' END, CASE WHEN a.p_size = b.p_size THEN 'same_size' END) AS reasons FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey <> b.p_partkey)"""


def _sides(spark, d):
    """The parts twice, as a_ and b_ columns beside their block keys."""
    p = table(spark, d, "part")
    return [p.select("p_brand", "p_type", *(F.col(c).alias(f"{s}_{c}") for c in ("p_partkey", "p_size", "p_retailprice"))) for s in ("a", "b")]


def _apart():
    return F.abs(F.col("a_p_size") - F.col("b_p_size"))


def _prices():
    return F.abs(F.col("a_p_retailprice") - F.col("b_p_retailprice"))


@query("scored_matches", f"WITH {_SCORED}, k AS (SELECT *, LEAD(score) OVER w AS second, ROW_NUMBER() OVER w AS place, COUNT(*) OVER (PARTITION BY l) AS candidates FROM p WINDOW w AS (PARTITION BY l ORDER BY score DESC, r)) SELECT l, r, CAST(score AS DOUBLE) AS score, reasons, candidates, COALESCE(score - second < 5, FALSE) AS near_tie, CASE WHEN score >= 80 AND NOT COALESCE(score - second < 5, FALSE) THEN 'HIGH' WHEN score >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM k WHERE place = 1")
def scored_matches(spark, d):
    """Candidates of a block, additive scores with reasons, the best one, near ties."""
    a, b = _sides(spark, d)
    size, price = ("a_p_size", "b_p_size"), ("a_p_retailprice", "b_p_retailprice")
    scores = [("size", J.Within(*size, 3), 40.0), ("price", J.Within(*price, 50), 30.0), ("same_size", J.Within(*size, 0), 20.0)]
    out = J.scored_matches(a, b, ["p_brand", "p_type"], "a_p_partkey", "b_p_partkey", scores)
    return out.withColumnsRenamed({"a_p_partkey": "l", "b_p_partkey": "r"})


@query("first_rule_match", "WITH q AS (SELECT a.p_partkey AS l, b.p_partkey AS r, CASE WHEN a.p_size = b.p_size AND ABS(a.p_retailprice - b.p_retailprice) <= 100 THEN 0 WHEN ABS(a.p_size - b.p_size) <= 1 THEN 1 END AS rule FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey <> b.p_partkey) SELECT l, r, CASE WHEN rule = 0 THEN 'same' ELSE 'alike' END AS rule FROM q WHERE rule IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY l ORDER BY q.rule, r) = 1")
def first_rule_match(spark, d):
    """The candidate of the first rule that holds."""
    a, b = _sides(spark, d)
    rules = [("same", (_apart() == 0) & (_prices() <= 100)), ("alike", _apart() <= 1)]
    return J.first_rule_match(a, b, ["p_brand", "p_type"], "a_p_partkey", "b_p_partkey", rules).withColumnsRenamed({"a_p_partkey": "l", "b_p_partkey": "r"})


@query("parts_to_whole", "WITH s AS (SELECT l_orderkey AS k, COUNT(*) AS parts, SUM(CAST(l_quantity AS BIGINT)) AS parts_size FROM lineitem GROUP BY 1) SELECT k, parts, CAST(parts_size AS BIGINT) AS parts_size, CAST(o_totalprice / 2000 AS BIGINT) AS size, ABS(parts_size - CAST(o_totalprice / 2000 AS BIGINT)) <= 5 AS matched FROM s JOIN orders ON o_orderkey = k")
def parts_to_whole(spark, d):
    """Whether the parts of a whole add up to its size."""
    parts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").cast("long").alias("size"))
    wholes = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.bround(F.col("o_totalprice") / 2000).cast("long").alias("size"))
    return J.parts_to_whole(parts, wholes, "k", "size", 5)


@query("nearest_values", "WITH r AS (SELECT DISTINCT l_partkey AS k, l_quantity AS v FROM lineitem), m AS (SELECT p_partkey AS k, CAST(p_size AS DOUBLE) AS v, p_retailprice AS u FROM part UNION ALL SELECT p_partkey, p_size / 2.0, p_retailprice / 2 FROM part) SELECT r.k, r.v, (SELECT u FROM m WHERE m.k = r.k ORDER BY ABS(r.v - m.v), m.v LIMIT 1) AS u FROM r WHERE r.k IN (SELECT k FROM m)")
def nearest_values(spark, d):
    """The price of the nearest size in a block."""
    r = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_quantity").alias("v")).distinct()
    p = table(spark, d, "part")
    m = p.select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("v"), F.col("p_retailprice").alias("u")).unionByName(p.select(F.col("p_partkey").alias("k"), (F.col("p_size") / 2).alias("v"), (F.col("p_retailprice") / 2).alias("u")))
    rows = r.withColumn("row", F.struct("k", "v"))
    return J.nearest_value(rows, m, "k", ["row"], "v", "u").select("row.k", "row.v", "u")


@query("snap_values", "WITH r AS (SELECT DISTINCT l_partkey AS k, l_extendedprice / 1000 AS v FROM lineitem), m AS (SELECT DISTINCT p_partkey AS k, ROUND(p_retailprice / 100, 1) AS v FROM part), n AS (SELECT r.k, r.v, COUNT(m.v) AS n, MIN(m.v) AS one FROM r LEFT JOIN m ON r.k = m.k AND ABS(r.v - m.v) < 0.5 GROUP BY 1, 2) SELECT k, v, CASE WHEN n = 1 THEN one ELSE FLOOR(v * 100) / 100 END AS snapped FROM n")
def snap_values(spark, d):
    """Values snapped to the only near one of a master, else cut."""
    r = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), (F.col("l_extendedprice") / 1000).alias("v")).distinct()
    m = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.round(F.col("p_retailprice") / 100, 1).alias("v"))
    rows = r.withColumn("row", F.struct("k", "v"))
    return J.snapped(rows, m, "k", ["row"], "v", 0.5).select("k", "v", "snapped")


@query("tolerance_prices", f"WITH {TRADES}, m AS (SELECT p_partkey AS part, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part), x AS (SELECT m.part, COUNT(t.unit) AS n, quantile_cont(t.amount, 0.5) AS mid, quantile_cont(t.amount, 0.25) AS low FROM m LEFT JOIN t ON t.part = m.part AND ABS(t.area - m.size) <= GREATEST(2, 0.03 * m.size) GROUP BY 1), u AS (SELECT part, MEDIAN(unit) AS unit FROM t GROUP BY 1) SELECT m.part, n, ROUND(low, 4) AS low, ROUND(COALESCE(mid, unit * size), 4) AS price, CASE WHEN mid IS NOT NULL THEN 'MATCH' WHEN unit IS NOT NULL THEN 'UNIT' ELSE 'NONE' END AS basis FROM m LEFT JOIN x USING (part) LEFT JOIN u USING (part)")
def tolerance_prices(spark, d):
    """Prices of trades within a size tolerance, else an estimate by unit price."""
    t = trades(spark, d)
    m = table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_size").cast("double").alias("size"))
    near = m.join(t.select("part", "area", "amount"), "part").where(F.abs(F.col("area") - F.col("size")) <= F.greatest(F.lit(2), 0.03 * F.col("size")))
    x = near.groupBy("part").agg(F.count("*").alias("n"), F.percentile("amount", 0.5).alias("mid"), F.percentile("amount", 0.25).alias("low"))
    u = t.groupBy("part").agg(F.percentile("unit", 0.5).alias("unit"))
    basis = F.when(F.col("mid").isNotNull(), "MATCH").when(F.col("unit").isNotNull(), "UNIT").otherwise("NONE")
    return m.join(x, "part", "left").join(u, "part", "left").select("part", F.coalesce("n", F.lit(0)).alias("n"), F.round("low", 4).alias("low"), F.round(F.coalesce("mid", F.col("unit") * F.col("size")), 4).alias("price"), basis.alias("basis"))


@query("pair_search", f"WITH {ENTITIES} SELECT a.grp, a.entity AS a_entity, b.entity AS b_entity, ROUND(ABS(a.price - b.price), 4) AS gap FROM e a JOIN e b ON a.grp = b.grp AND a.entity < b.entity WHERE ABS(a.area - b.area) <= 0.3 * GREATEST(a.area, b.area) AND ABS(a.score - b.score) >= 1000 QUALIFY ROW_NUMBER() OVER (PARTITION BY a.grp ORDER BY ABS(a.price - b.price) DESC, a.entity, b.entity) <= 2")
def pair_search(spark, d):
    """Constrained pairs within a group, the two of largest gap."""
    e = entities(spark, d).select("entity", "grp", "area", "score", "price")
    near = (F.abs(F.col("a_area") - F.col("b_area")) <= 0.3 * F.greatest("a_area", "b_area")) & (F.abs(F.col("a_score") - F.col("b_score")) >= 1000)
    pairs = J.widest_pairs(e, "entity", "grp", near, ["area", "score", "price"], F.abs(F.col("a_price") - F.col("b_price")), 2)
    return pairs.select("grp", "a_entity", "b_entity", F.round("raw", 4).alias("gap"))


@query("relaxed_comparables", "WITH p AS (SELECT a.p_partkey AS k, b.p_retailprice AS v, ABS(a.p_size - b.p_size) <= 2 AND a.p_type = b.p_type AS r1, ABS(a.p_size - b.p_size) <= 5 AND a.p_type = b.p_type AS r2, ABS(a.p_size - b.p_size) <= 10 AS r3 FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey), g AS (SELECT k, COUNT(*) FILTER (WHERE r1) AS n1, COUNT(*) FILTER (WHERE r2) AS n2, COUNT(*) FILTER (WHERE r3) AS n3, quantile_cont(v, 0.5) FILTER (WHERE r1) AS m1, quantile_cont(v, 0.5) FILTER (WHERE r2) AS m2, quantile_cont(v, 0.5) FILTER (WHERE r3) AS m3 FROM p GROUP BY 1) SELECT k, CASE WHEN n1 >= 3 THEN 'tight' WHEN n2 >= 3 THEN 'wide' WHEN n3 >= 3 THEN 'loose' ELSE 'NONE' END AS rule, CASE WHEN n1 >= 3 THEN n1 WHEN n2 >= 3 THEN n2 WHEN n3 >= 3 THEN n3 ELSE 0 END AS matches, ROUND(CASE WHEN n1 >= 3 THEN m1 WHEN n2 >= 3 THEN m2 WHEN n3 >= 3 THEN m3 END, 4) AS comparable FROM g")
def relaxed_comparables(spark, d):
    """Comparables under the first rule of a ladder that finds enough."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_brand", "p_type", "p_size", "p_retailprice")
    rules = [("tight", ["p_type"], "p_size", 2), ("wide", ["p_type"], "p_size", 5), ("loose", [], "p_size", 10)]
    return J.banded_comparables(p, "k", "p_brand", rules, "p_retailprice", 3).withColumn("comparable", F.round("comparable", 4))


@query("nearest_comparables", "SELECT a.p_partkey AS k, b.p_partkey AS other, ROW_NUMBER() OVER w AS place FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey WINDOW w AS (PARTITION BY a.p_partkey ORDER BY SQRT((POW(a.p_size / 10.0 - b.p_size / 10.0, 2) + POW(a.p_retailprice / 100 - b.p_retailprice / 100, 2)) / 2), b.p_partkey) QUALIFY place <= 5")
def nearest_comparables(spark, d):
    """The nearest members of a pool by scaled distance."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_brand", (F.col("p_size") / 10).alias("x"), (F.col("p_retailprice") / 100).alias("y"))
    return J.nearest_in_pool(p, "k", "p_brand", ["x", "y"], 5).select("k", "other", F.col("place").cast("long").alias("place"))


@query("time_aligned", "WITH y AS (SELECT o_custkey AS k, YEAR(o_orderdate) AS y, COUNT(*) AS n FROM orders GROUP BY ALL) SELECT a.k, a.y, a.n, b.n AS next_n FROM y a LEFT JOIN y b ON a.k = b.k AND b.y = a.y + 1")
def time_aligned(spark, d):
    """Facts joined with the features of their year, and with the next year's outcome."""
    y = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").cast("long").alias("y")).agg(F.count("*").alias("n"))
    return y.join(y.select("k", (F.col("y") - 1).alias("y"), F.col("n").alias("next_n")), ["k", "y"], "left")


@query("sequence_join", "WITH a AS (SELECT l_orderkey AS k, l_linenumber AS line, l_quantity AS q, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity, l_partkey, l_suppkey) AS s FROM lineitem), b AS (SELECT l_orderkey AS k, l_linenumber AS line, l_extendedprice AS p, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice, l_partkey, l_suppkey) AS s FROM lineitem) SELECT k, line, q, p FROM a LEFT JOIN b USING (k, line, s)")
def sequence_join(spark, d):
    """Repeats of a key paired by their order."""
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), "l_partkey", "l_suppkey")  # noqa: E741
    return J.sequence_join(l.drop("p"), l, ["k", "line"], ["q", "l_partkey", "l_suppkey"], ["p", "l_partkey", "l_suppkey"], "p").select("k", "line", "q", "p")


@query("overrides", "WITH o AS (SELECT o_custkey AS c_custkey, MAX(o_orderpriority) AS seg FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT c_custkey, COALESCE(seg, c_mktsegment) AS c_mktsegment, c_mktsegment AS original, seg IS NOT NULL AS override_applied FROM customer LEFT JOIN o USING (c_custkey)")
def overrides(spark, d):
    """Corrections applied over base rows, with the originals kept."""
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("c_mktsegment"))
    return J.overridden(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), o, ["c_custkey"], ["c_mktsegment"]).withColumnRenamed("original_c_mktsegment", "original")


@query("merged_evidence", "WITH a AS (SELECT o_custkey AS k, o_orderstatus AS kind FROM orders), b AS (SELECT c_custkey AS k, c_mktsegment AS kind FROM customer WHERE c_acctbal > 2000), u AS (SELECT k, kind FROM a UNION SELECT k, kind FROM b) SELECT k, STRING_AGG(kind, '+' ORDER BY kind) AS kinds, k IN (SELECT k FROM a) AND k IN (SELECT k FROM b) AS cross_validated, CASE WHEN k IN (SELECT k FROM a) AND k IN (SELECT k FROM b) THEN CAST(0.95 AS DOUBLE) ELSE CAST(0.7 AS DOUBLE) END AS confidence FROM u GROUP BY k")
def merged_evidence(spark, d):
    """Two relation tables as one, with the kinds of evidence and cross-validation."""
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("kind"))
    b = table(spark, d, "customer").where("c_acctbal > 2000").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("kind"))
    return J.merged_evidence(a, b, ["k"], "kind")


@query("parameter_grid", f"WITH {ENTITIES}, g AS (SELECT UNNEST([1000, 3000, 5000, 7000]) AS cut) SELECT cut, COUNT(*) FILTER (WHERE score >= cut) AS above, ROUND(AVG(price) FILTER (WHERE score >= cut), 4) AS price FROM e, g GROUP BY cut")
def parameter_grid(spark, d):
    """A sample under a grid of parameters."""
    grid = spark.range(1).select(F.explode(F.array(*map(F.lit, (1000, 3000, 5000, 7000)))).alias("cut"))
    above = F.col("score") >= F.col("cut")
    return entities(spark, d).crossJoin(F.broadcast(grid)).groupBy("cut").agg(F.count_if(above).alias("above"), F.round(F.avg(F.when(above, F.col("price"))), 4).alias("price"))  # four rows


@query("pair_distances", "WITH p AS (SELECT s_suppkey AS k, s_nationkey AS g, 35 + s_acctbal / 10000 AS lat, 129 + (s_suppkey % 100) / 100.0 AS lon FROM supplier) SELECT a.g, a.k AS a_k, b.k AS b_k, ROUND(2 * 6371000.0 * ASIN(SQRT(LEAST(1.0, POW(SIN(RADIANS(b.lat - a.lat) / 2), 2) + COS(RADIANS(a.lat)) * COS(RADIANS(b.lat)) * POW(SIN(RADIANS(b.lon - a.lon) / 2), 2)))), 3) AS metres, ROUND(111.0 * SQRT(POW(b.lat - a.lat, 2) + POW((b.lon - a.lon) * COS(RADIANS((a.lat + b.lat) / 2)), 2)), 6) AS km FROM p a JOIN p b ON a.g = b.g AND a.k < b.k")
def pair_distances(spark, d):
    """Great-circle and planar distances within a group."""
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("g"), (35 + F.col("s_acctbal") / 10000).alias("lat"), (129 + (F.col("s_suppkey") % 100) / 100.0).alias("lon"))
    pairs = J.pairs_within(p, "k", "g", F.lit(True), ["lat", "lon"])
    args = [F.col(c) for c in ("a_lat", "a_lon", "b_lat", "b_lon")]
    return pairs.select("g", "a_k", "b_k", F.round(haversine_m(*args), 3).alias("metres"), F.round(planar_km(*args), 6).alias("km"))


@query("group_expansion", "WITH l AS (SELECT DISTINCT o_custkey AS item, o_orderpriority AS grp FROM orders WHERE o_totalprice > 350000), m AS (SELECT DISTINCT o_orderpriority AS grp, o_orderstatus AS member FROM orders), x AS (SELECT DISTINCT o_custkey AS item, o_orderstatus AS member FROM orders WHERE o_totalprice > 400000) SELECT item, member, CASE WHEN MAX(c) = 2 THEN 'EXPLICIT' ELSE 'GROUP' END AS certainty FROM (SELECT item, member, 1 AS c FROM l JOIN m USING (grp) UNION ALL SELECT item, member, 2 FROM x) GROUP BY 1, 2")
def group_expansion(spark, d):
    """Members of an item's groups, the explicit ones apart."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("item"), F.col("o_orderpriority").alias("grp"), F.col("o_orderstatus").alias("member"), "o_totalprice")
    return J.expanded_groups(o.where("o_totalprice > 350000").select("item", "grp").distinct(), o.select("grp", "member").distinct(), o.where("o_totalprice > 400000").select("item", "member").distinct(), "item", "grp", "member")


@query("points_in_zones", "WITH p AS (SELECT s_suppkey AS k, s_acctbal / 100 AS x, (s_suppkey * 37 % 100) AS y FROM supplier), z AS (SELECT n_nationkey AS zone, (n_nationkey % 5) * 20 AS x0, (n_nationkey // 5) * 18 AS y0 FROM nation) SELECT k, CAST(zone AS INT) AS zone FROM p, z WHERE y >= y0 AND y < y0 + 25 AND x >= x0 AND x < x0 + 25")
def points_in_zones(spark, d):
    """Points and the polygons that hold them; shared zones give several rows."""
    return J.points_in_polygons(_points(spark, d), _zones(spark, d), "k", "zone", 10.0)


def _points(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_acctbal") / 100).alias("x"), (F.col("s_suppkey") * 37 % 100).cast("double").alias("y"))


def _zones(spark, d):
    corner = lambda dx, dy: F.struct((F.col("x0") + dx).alias("x"), (F.col("y0") + dy).alias("y"))
    z = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("zone"), (F.col("n_nationkey") % 5 * 20.0).alias("x0"), (F.floor(F.col("n_nationkey") / 5) * 18.0).alias("y0"))
    return z.select("zone", F.array(corner(0.0, 0.0), corner(25.0, 0.0), corner(25.0, 25.0), corner(0.0, 25.0)).alias("ring"))


@query("nearest_zones", "WITH p AS (SELECT s_suppkey AS k, s_acctbal / 100 AS x, CAST(s_suppkey * 37 % 100 AS DOUBLE) AS y FROM supplier), z AS (SELECT CAST(n_nationkey AS INT) AS zone, (n_nationkey % 5) * 20.0 AS x0, (n_nationkey // 5) * 18.0 AS y0 FROM nation), s AS (SELECT k, zone, CASE WHEN x BETWEEN x0 AND x0 + 25 AND y BETWEEN y0 AND y0 + 25 THEN LEAST(x - x0, x0 + 25 - x, y - y0, y0 + 25 - y) ELSE SQRT(POW(GREATEST(x0 - x, 0, x - x0 - 25), 2) + POW(GREATEST(y0 - y, 0, y - y0 - 25), 2)) END AS dist FROM p, z) SELECT k, zone, ROUND(dist, 6) AS distance FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY k ORDER BY ROUND(dist, 9), zone) = 1")
def nearest_zones(spark, d):
    """The polygon whose border is nearest to each point."""
    return J.nearest_polygons(_points(spark, d), _zones(spark, d), "k", "zone", 16.0).select("k", "zone", F.round("distance", 6).alias("distance"))


@query("union_mixed", "SELECT 'node' AS record_type, c_custkey AS id, NULL::BIGINT AS target FROM customer UNION ALL SELECT 'edge', o_custkey, o_orderkey FROM orders")
def union_mixed(spark, d):
    """Nodes and edges with different columns in one tagged table."""
    return U.tagged_union([("node", table(spark, d, "customer").select(F.col("c_custkey").alias("id"))), ("edge", table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("target")))], "record_type")


@query("keyed_upsert", "SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) UNION ALL SELECT o_custkey, MAX(o_totalprice) FROM orders WHERE o_totalprice > 300000 GROUP BY 1")
def keyed_upsert(spark, d):
    """New rows replace the old ones of the same key."""
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    new = table(spark, d, "orders").where("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    return U.upsert(old, new, ["k"])


@query("insert_only", "WITH old AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_acctbal > 0), new AS (SELECT o_custkey AS k, MAX(o_totalprice) AS v FROM orders GROUP BY 1) SELECT k, v, 'kept' AS how FROM old UNION ALL SELECT k, v, 'inserted' FROM new WHERE k NOT IN (SELECT k FROM old) UNION ALL SELECT k, v, 'conflict' FROM new WHERE k IN (SELECT k FROM old)")
def insert_only(spark, d):
    """Inserts of new keys; the others are conflicts."""
    old = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    new = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    return U.insert_only(old, new, ["k"])


@query("last_good_value", "WITH old AS (SELECT c_custkey AS k, c_acctbal AS v, c_acctbal > 0 AS good, c_mktsegment = 'BUILDING' AS reviewed FROM customer), new AS (SELECT o_custkey AS k, MAX(o_totalprice) AS v, COUNT(*) >= 10 AS good FROM orders GROUP BY 1) SELECT k, CASE WHEN old.k IS NOT NULL AND (new.k IS NULL OR (old.good AND (NOT new.good OR old.reviewed))) THEN old.v ELSE new.v END AS v, CASE WHEN old.k IS NOT NULL AND (new.k IS NULL OR (old.good AND (NOT new.good OR old.reviewed))) THEN 'old' ELSE 'new' END AS source FROM old FULL JOIN new USING (k)")
def last_good_value(spark, d):
    """U4: a bad or unreviewed refresh never replaces a good or reviewed value."""
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), (F.col("c_acctbal") > 0).alias("good"), (F.col("c_mktsegment") == "BUILDING").alias("reviewed"))
    new = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"), (F.count("*") >= 10).alias("good"))
    return U.last_good(old, new, "k", "v", "good", "reviewed")


@query("distinct_by_key", "SELECT o_custkey, o_orderstatus, o_orderkey FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) = 1")
def distinct_by_key(spark, d):
    """The first row of each key in an explicit order."""
    return U.first_by_key(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderstatus", "o_orderkey")


@query("set_differences", "SELECT 'both' AS part, COUNT(*) AS n FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 200000) UNION ALL SELECT 'left_only', COUNT(*) FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0 EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000) UNION ALL SELECT 'right_only', COUNT(*) FROM (SELECT o_custkey FROM orders WHERE o_totalprice > 200000 EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def set_differences(spark, d):
    """Overlap and leftovers of two sets of ids, in one pass."""
    a = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    b = table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("k"))
    return U.set_parts(a, b, "k")


@query("still_pending", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'collect' ELSE 'review' END AS next_action FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AND c_mktsegment <> 'MACHINERY'")
def still_pending(spark, d):
    """The population without the resolved and the excluded, with the next action."""
    c = table(spark, d, "customer")
    done = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    left = U.pending(c, done, c.where("c_mktsegment = 'MACHINERY'"), "c_custkey")
    return left.select("c_custkey", F.when(F.col("c_acctbal") < 0, "collect").otherwise("review").alias("next_action"))


@query("registry_completion", "SELECT o_custkey AS k, 'summary' AS source, COUNT(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY 1 UNION ALL SELECT c_custkey, 'registry', NULL FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def registry_completion(spark, d):
    """Summary rows, and the registry rows that they lack."""
    s = table(spark, d, "orders").where("o_totalprice > 200000").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n")).withColumn("source", F.lit("summary"))
    return J.with_placeholders(s, table(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k").select("k", F.coalesce("source", F.lit("registry")).alias("source"), "n")


@query("clean_records", "SELECT c_custkey, UPPER(TRIM(c_mktsegment)) AS segment, COALESCE(NULLIF(CONCAT_WS(';', CASE WHEN c_acctbal < 0 THEN 'NEGATIVE' END, CASE WHEN c_nationkey > 22 THEN 'FAR' END), ''), 'NONE') AS review, ROUND(((c_acctbal >= 0)::INT + (c_nationkey <= 22)::INT) / 2.0, 6) AS completeness FROM customer")
def clean_records(spark, d):
    """Cleaned records with the reasons to review them, and their completeness."""
    from ..functions.rules import reason_text

    good, near = F.col("c_acctbal") >= 0, F.col("c_nationkey") <= 22
    share = (good.cast("int") + near.cast("int")) / 2.0
    return table(spark, d, "customer").select("c_custkey", F.upper(F.trim("c_mktsegment")).alias("segment"), reason_text([("NEGATIVE", ~good), ("FAR", ~near)]).alias("review"), F.round(share, 6).alias("completeness"))
