"""Queries of guards and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import guards as G
from ..operators.metrics import audit_log
from .registry import ENTITIES, entities, query, table


@query("repeated_keys", "SELECT l_orderkey, l_linenumber, COUNT(*) AS count FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1")
def repeated_keys(spark, d):
    """Keys that occur more than once, after a check of the columns."""
    l = table(spark, d, "lineitem")  # noqa: E741
    G.require_columns(l, ["l_orderkey", "l_linenumber"])
    return G.repeated_keys(l, ["l_orderkey", "l_linenumber"])


@query("row_issues", "SELECT o_orderkey, 'LARGE' AS code FROM orders WHERE o_totalprice > 450000 UNION ALL SELECT o_orderkey, 'OPEN_OLD' FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-01-01' UNION ALL SELECT o_orderkey, 'ODD_PRIORITY' FROM orders WHERE SUBSTR(o_orderpriority, 1, 1) NOT IN ('1', '2', '3')")
def row_issues(spark, d):
    """A row for each check that a row breaks."""
    checks = [("LARGE", F.col("o_totalprice") > 450000), ("OPEN_OLD", (F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp"))), ("ODD_PRIORITY", ~F.substring("o_orderpriority", 1, 1).isin("1", "2", "3"))]
    return G.issues(table(spark, d, "orders"), "o_orderkey", checks)


@query("scope_checks", "SELECT BOOL_AND(l_quantity > 0) AS positive, BOOL_AND(l_discount < 0.05) AS small_discount, BOOL_AND(YEAR(l_shipdate) >= 1995) AS in_years FROM lineitem")
def scope_checks(spark, d):
    """Conditions that must hold for all rows."""
    return G.in_scope(table(spark, d, "lineitem"), positive=F.col("l_quantity") > 0, small_discount=F.col("l_discount") < 0.05, in_years=F.year("l_shipdate") >= 1995)


@query("sum_reconciliation", "WITH s AS (SELECT o_custkey, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS f, COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS o, COUNT(*) AS total FROM orders GROUP BY 1) SELECT o_custkey, f + o - total AS difference, ABS(f + o - total) <= 1 AS reconciled FROM s")
def sum_reconciliation(spark, d):
    """Whether parts add up to their total."""
    part = lambda s: F.count_if(F.col("o_orderstatus") == s)
    s = table(spark, d, "orders").groupBy("o_custkey").agg(part("F").alias("f"), part("O").alias("o"), F.count("*").alias("total"))
    return G.reconciled(s, ["f", "o"], "total", 1).select("o_custkey", "difference", "reconciled")


@query("key_coverage", "WITH n AS (SELECT (SELECT COUNT(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 100000)) AS left_only, (SELECT COUNT(*) FROM (SELECT o_custkey FROM orders WHERE o_totalprice > 100000 EXCEPT SELECT c_custkey FROM customer)) AS right_only) SELECT left_only, right_only, left_only = 0 AND right_only = 0 AS equal FROM n")
def key_coverage(spark, d):
    """Whether two tables have the same keys."""
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return G.coverage(a, table(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("k")), "k")


@query("leakage_check", "SELECT MAX(o_orderdate) FILTER (WHERE YEAR(o_orderdate) < 1999) < MIN(o_orderdate) FILTER (WHERE YEAR(o_orderdate) >= 1999) AS ok FROM orders")
def leakage_check(spark, d):
    """Training ends before testing begins."""
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    return G.no_leakage(o.where("y < 1999"), o.where("y >= 1999"), "o_orderdate").select("ok")


@query("equal_within", "SELECT 'n' AS \"column\", TRUE AS equal UNION ALL SELECT 'total', (SELECT COUNT(*) = 0 FROM orders WHERE o_custkey % 100 = 7)")
def equal_within(spark, d):
    """Whether two tables agree within tolerances; here one total was changed."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    changed = o.withColumn("total", F.when(F.col("o_custkey") % 100 == 7, F.col("total") + 1).otherwise(F.col("total")))
    return G.equal_within(o, changed, "o_custkey", {"n": 0.0, "total": 0.01})


@query("reproduction_check", "SELECT 'orders' AS metric, CAST((SELECT COUNT(*) FROM orders) AS DOUBLE) AS value, TRUE AS ok UNION ALL SELECT 'customers', (SELECT COUNT(*) FROM customer), FALSE")
def reproduction_check(spark, d):
    """Metrics against frozen ones, each with its tolerance."""
    m = lambda name, t: table(spark, d, t).agg(F.count("*").cast("double").alias("value")).select(F.lit(name).alias("metric"), "value")
    metrics = m("orders", "orders").unionByName(m("customers", "customer"))
    frozen = metrics.withColumn("value", F.when(F.col("metric") == "customers", F.col("value") + 5).otherwise(F.col("value")))
    return G.reproduced(metrics, frozen, {"customers": 1.0}).select("metric", "value", "ok")


@query("check_battery", "SELECT 'unique_orders' AS \"check\", (SELECT COUNT(*) = COUNT(DISTINCT o_orderkey) FROM orders) AS passed, CAST((SELECT COUNT(*) FROM orders) AS VARCHAR) AS detail UNION ALL SELECT 'no_orphans', (SELECT COUNT(*) = 0 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)), CAST((SELECT COUNT(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS VARCHAR)")
def check_battery(spark, d):
    """Named checks as a table."""
    o = table(spark, d, "orders")
    unique = o.agg((F.count("*") == F.count_distinct("o_orderkey")).alias("passed"), F.count("*").alias("detail"))
    lost = o.join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti").agg((F.count("*") == 0).alias("passed"), F.count("*").alias("detail"))
    return G.check_table([("unique_orders", unique), ("no_orphans", lost)])


@query("checkpoint_battery", "WITH c AS (SELECT c_custkey, c_acctbal > 0 AS a, c_nationkey < 20 AS b, c_mktsegment <> 'MACHINERY' AS c, c_acctbal, c_nationkey, c_mktsegment FROM customer) SELECT c_custkey, CAST(s.step AS INT) AS step, s.name, s.passed, s.detail, a AND b AND c AS all_passed FROM (SELECT *, UNNEST([{'step': 1, 'name': 'balance', 'passed': a, 'detail': CASE WHEN c_acctbal > 0 THEN 'yes' ELSE 'no' END}, {'step': 2, 'name': 'nation', 'passed': b, 'detail': CAST(c_nationkey AS VARCHAR)}, {'step': 3, 'name': 'segment', 'passed': c, 'detail': c_mktsegment}]) AS s FROM c)")
def checkpoint_battery(spark, d):
    """Ordered checks of each row with their details, and whether all passed."""
    checks = [("balance", F.col("c_acctbal") > 0, F.when(F.col("c_acctbal") > 0, "yes").otherwise("no")), ("nation", F.col("c_nationkey") < 20, F.col("c_nationkey")), ("segment", F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment"))]
    return G.checkpoints(table(spark, d, "customer"), "c_custkey", checks)


@query("audit_log", f"WITH {ENTITIES} SELECT CAST(entity AS VARCHAR) AS subject, 'FEW_DEALS' AS issue, CAST(deals AS VARCHAR) AS detail, 'widen' AS action FROM e WHERE deals < 580 UNION ALL SELECT CAST(entity AS VARCHAR), 'NEGATIVE_SCORE', 'n' || grp, 'review' FROM e WHERE score < 0")
def audit_log_query(spark, d):
    """Issues of several detectors in one table."""
    e = entities(spark, d)
    return audit_log([("FEW_DEALS", e.where("deals < 580"), "entity", F.col("deals"), "widen"), ("NEGATIVE_SCORE", e.where("score < 0"), "entity", F.concat(F.lit("n"), "grp"), "review")])


@query("qa_verdict", "WITH i AS (SELECT l_suppkey AS k, COUNT(*) FILTER (WHERE l_discount > 0.09 AND l_tax > 0.07) AS major, COUNT(*) FILTER (WHERE l_quantity < 2) AS minor FROM lineitem GROUP BY 1) SELECT CASE WHEN major > 8 THEN 'FAIL' WHEN major > 0 OR minor > 0 THEN 'WARN' ELSE 'PASS' END AS verdict, COUNT(*) AS n FROM i GROUP BY 1")
def qa_verdict(spark, d):
    """Verdicts from the severities of issues."""
    from ..functions.rules import first_match

    l = table(spark, d, "lineitem")  # noqa: E741
    i = l.groupBy("l_suppkey").agg(F.count_if((F.col("l_discount") > 0.09) & (F.col("l_tax") > 0.07)).alias("major"), F.count_if(F.col("l_quantity") < 2).alias("minor"))
    return i.groupBy(first_match([(F.col("major") > 8, "FAIL"), ((F.col("major") > 0) | (F.col("minor") > 0), "WARN")], "PASS").alias("verdict")).agg(F.count("*").alias("n"))
