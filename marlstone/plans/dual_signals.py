"""The query of two signals together: local fair prices and what a score is worth."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters as C
from ..operators.metrics import anchored, in_window
from ..operators.signals import dual_signals
from . import effects, price_models
from .registry import query, trades

REPLICATES = 100

_SQL = f"""WITH lf AS (WITH {price_models._SQL_FAIR} SELECT * FROM fx),
  vs AS (WITH {effects._SQL_ROWS}, {effects._SQL_GAPS} SELECT entity, gap AS score_gap, confidence AS score_confidence, expected_pct, residual_pct FROM vi),
  {effects._SQL_ROWS},
  nu AS (SELECT entity, unit AS v, ROW_NUMBER() OVER (PARTITION BY t.entity ORDER BY unit, deal, part) - 1 AS i, COUNT(*) OVER (PARTITION BY t.entity) AS n FROM t WHERE deal_date > (SELECT MAX(deal_date) FROM t) - INTERVAL 12 MONTH),
  dr AS (SELECT rep, entity, n, CAST('0x' || substr(md5('1|' || entity || '|' || rep || '|' || i), 1, 8) AS BIGINT) % n AS d FROM nu, range(0, {REPLICATES}) r(rep)),
  od AS (SELECT rep, entity, n, d, ROW_NUMBER() OVER (PARTITION BY rep, entity ORDER BY d) - 1 AS o FROM dr),
  md AS (SELECT rep, od.entity, AVG(v) AS price FROM od JOIN nu ON nu.entity = od.entity AND nu.i = od.d WHERE o IN ((od.n - 1) // 2, od.n // 2) GROUP BY ALL),
  pp AS (SELECT md.entity, AVG((expected_pct - (md.price / lf.price_12m * (1 + residual_pct / 100) - 1) * 100 > 0)::INT) AS positive FROM md JOIN lf ON lf.entity = md.entity JOIN vs ON vs.entity = md.entity GROUP BY 1),
  g AS (SELECT lf.*, score_gap, score_confidence, positive, (fair / price_6m - 1) * 100 AS gap_6m, (fair / price_12m - 1) * 100 AS local_gap, (fair_low / price_12m - 1) * 100 AS gap_low, (fair_high / price_12m - 1) * 100 AS gap_high
    FROM lf LEFT JOIN vs ON vs.entity = lf.entity LEFT JOIN pp ON pp.entity = lf.entity),
  h AS (SELECT *, CASE WHEN gap_6m IS NULL OR local_gap IS NULL THEN 'INSUFFICIENT' WHEN gap_6m > 0 AND local_gap > 0 THEN 'STABLE_POSITIVE' WHEN gap_6m < 0 AND local_gap < 0 THEN 'STABLE_NEGATIVE' ELSE 'MIXED' END AS stability,
    CASE WHEN local_gap IS NULL THEN 'INSUFFICIENT' WHEN gap_low > 0 THEN 'STRONG_UNDERVALUED_SIGNAL' WHEN gap_high < 0 THEN 'STRONG_OVERVALUED_SIGNAL' WHEN ABS(local_gap) < 3 THEN 'WITHIN_MODEL_RANGE'
      WHEN local_gap > 0 THEN 'POTENTIAL_UNDERVALUED_SIGNAL' ELSE 'POTENTIAL_OVERVALUED_SIGNAL' END AS win, confidence IN ('HIGH', 'MEDIUM') AND local_gap IS NOT NULL AS known FROM g),
  lim AS (SELECT quantile_cont(width_pct, 0.75) FILTER (local_gap IS NOT NULL) AS p75, quantile_cont(width_pct, 0.9) FILTER (local_gap IS NOT NULL) AS p90, quantile_cont(ABS(local_gap), 0.9) FILTER (known) AS far FROM h),
  mk AS (SELECT grp, ABS(MEDIAN(local_gap)) AS mid FROM h WHERE known GROUP BY 1),
  k AS (SELECT h.*, CASE WHEN confidence = 'LOW' OR local_gap IS NULL OR deals_12m < 3 OR width_pct > p90 OR stability = 'MIXED' OR level >= 3 THEN 'LOW'
      WHEN confidence = 'HIGH' AND deals_12m >= 5 AND width_pct <= p75 AND stability LIKE 'STABLE%' AND level = 0 AND comparable_entities >= 5 THEN 'HIGH'
      WHEN confidence IN ('HIGH', 'MEDIUM') AND width_pct <= p90 AND stability <> 'INSUFFICIENT' AND level <= 2 AND comparable_entities >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS local_confidence,
    CASE WHEN local_gap IS NULL THEN 'MISSING' WHEN local_gap > 3 THEN 'POSITIVE' WHEN local_gap < -3 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS local_sign,
    CASE WHEN score_gap IS NULL THEN 'MISSING' WHEN score_gap > 3 THEN 'POSITIVE' WHEN score_gap < -3 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS score_sign,
    COALESCE(known AND ABS(local_gap) >= far, false) AS extreme, COALESCE(mid >= (SELECT quantile_cont(mid, 0.9) FROM mk), false) AS biased, p90 FROM h LEFT JOIN mk ON mk.grp = h.grp, lim),
  c AS (SELECT *, CASE WHEN score_sign = 'POSITIVE' AND local_sign = 'POSITIVE' THEN 'DOUBLE_POSITIVE' WHEN local_sign = 'POSITIVE' AND score_sign IN ('NEUTRAL', 'NEGATIVE') THEN 'LOCAL_ONLY_POSITIVE'
      WHEN score_sign = 'POSITIVE' AND local_sign IN ('NEUTRAL', 'NEGATIVE') THEN 'SCORE_ONLY_POSITIVE' WHEN score_sign = 'NEGATIVE' AND local_sign = 'NEGATIVE' THEN 'DOUBLE_NEGATIVE' ELSE 'MIXED_OR_NEUTRAL' END AS agreement,
    COALESCE(local_gap > 0 AND stability = 'STABLE_POSITIVE' AND local_confidence IN ('HIGH', 'MEDIUM') AND score_gap > 0 AND score_confidence IN ('HIGH', 'MEDIUM') AND positive >= 0.75 AND confidence IN ('HIGH', 'MEDIUM'), false) AS strong FROM k)
SELECT entity, grp, ROUND(local_gap, 6) AS local_gap, ROUND(score_gap, 6) AS score_gap, positive, stability, win AS interval_signal, local_confidence, COALESCE(score_confidence, 'NONE') AS score_confidence, agreement, strong, extreme, biased,
  CASE WHEN strong AND NOT extreme AND NOT biased THEN 'ROBUST_DUAL_POSITIVE' WHEN local_sign = 'POSITIVE' AND local_confidence IN ('HIGH', 'MEDIUM') AND score_sign <> 'POSITIVE' THEN 'LOCAL_VALUE_CANDIDATE'
    WHEN score_sign = 'POSITIVE' AND COALESCE(score_confidence IN ('HIGH', 'MEDIUM'), false) AND local_sign <> 'POSITIVE' THEN 'SCORE_VALUE_CANDIDATE' WHEN agreement = 'DOUBLE_NEGATIVE' OR win = 'STRONG_OVERVALUED_SIGNAL' THEN 'NEGATIVE_OR_FULLY_PRICED' ELSE 'UNCERTAIN' END AS class,
  CASE WHEN NOT extreme THEN 'LOW' WHEN local_confidence IN ('HIGH', 'MEDIUM') AND deals_12m >= 5 AND width_pct <= p90 AND ABS(recent_residual) > 0.15 THEN 'HIGH' WHEN confidence IN ('HIGH', 'MEDIUM') AND deals_12m >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS audit_priority
FROM c"""


@query("x20_dual_signals", _SQL)
def x20_dual_signals(spark, d):
    """Local and score gaps of an entity, how sure they are, what they say together, and what to look at."""
    fair, _ = price_models._fair_prices(spark, d)
    worth = effects._gaps(spark, d).select(F.col("entity").alias("_id"), F.col("gap").alias("score_gap"), F.col("confidence").alias("score_confidence"), "expected_pct", "residual_pct")
    met = fair.join(worth, F.col("entity") == F.col("_id"), "left").drop("_id")
    recent = anchored(trades(spark, d), "deal_date").where(in_window("deal_date", 12)).withColumn("ties", F.struct("deal", "part"))
    drawn = C.resampled_medians(recent, "entity", "unit", "ties", REPLICATES, seed=1)
    positive = F.col("expected_pct") - (F.col("median") / F.col("price_12m") * (1 + F.col("residual_pct") / 100) - 1) * 100 > 0
    share = drawn.join(met.select("entity", "expected_pct", "residual_pct", "price_12m"), "entity").groupBy("entity").agg(F.avg(positive.cast("double")).alias("positive"))
    out = dual_signals(met.join(share, "entity", "left"), "grp")
    plain = ("entity", "grp", "positive", "stability", F.col("interval").alias("interval_signal"), "local_confidence", "agreement", "strong", "extreme", "biased", "class", "audit_priority")
    return out.select(*plain, F.coalesce("score_confidence", F.lit("NONE")).alias("score_confidence"), F.round("local_gap", 6).alias("local_gap"), F.round("score_gap", 6).alias("score_gap"))
