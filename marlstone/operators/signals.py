"""Two signals of an entity's value, a local price gap and a score gap, and what they say together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order_statistics import exact_quantiles
from ..functions.rules import first_match, holds, percent_gap
from ..functions.staging import written

#: Gaps, in percent, that count as none.
NEUTRAL = 3.0


def both_windows(short: Column, long: Column) -> Column:
    """STABLE_POSITIVE or STABLE_NEGATIVE if both windows have that sign, MIXED if not, INSUFFICIENT with one missing."""
    return first_match([(short.isNull() | long.isNull(), "INSUFFICIENT"), ((short > 0) & (long > 0), "STABLE_POSITIVE"), ((short < 0) & (long < 0), "STABLE_NEGATIVE")], "MIXED")


def signed(value: Column, neutral: float = NEUTRAL) -> Column:
    """POSITIVE, NEGATIVE, NEUTRAL or MISSING."""
    return first_match([(value.isNull(), "MISSING"), (value > neutral, "POSITIVE"), (value < -neutral, "NEGATIVE")], "NEUTRAL")


def interval_signal(point: Column, low: Column, high: Column, neutral: float = NEUTRAL) -> Column:
    """Strong if the whole interval lies on one side of zero, else potential, or within the model's range near zero."""
    missing = point.isNull() | low.isNull() | high.isNull()
    return first_match(
        [(missing, "INSUFFICIENT"), (low > 0, "STRONG_UNDERVALUED_SIGNAL"), (high < 0, "STRONG_OVERVALUED_SIGNAL"), (F.abs(point) < neutral, "WITHIN_MODEL_RANGE"), (point > 0, "POTENTIAL_UNDERVALUED_SIGNAL")],
        "POTENTIAL_OVERVALUED_SIGNAL",
    )


def local_confidence(p75: Column, p90: Column) -> Column:
    """How far a local gap can be trusted, from confidence, local_gap, deals_12m, width_pct, stability, level, comparable_entities."""
    sure, gap, width, level, stable = (F.col(c) for c in ("confidence", "local_gap", "width_pct", "level", "stability"))
    low = (sure == "LOW") | gap.isNull() | (F.col("deals_12m") < 3) | (width > p90) | (stable == "MIXED") | (level >= 3)
    high = (sure == "HIGH") & (F.col("deals_12m") >= 5) & (width <= p75) & stable.isin("STABLE_POSITIVE", "STABLE_NEGATIVE") & (level == 0) & (F.col("comparable_entities") >= 5)
    medium = sure.isin("HIGH", "MEDIUM") & (width <= p90) & (stable != "INSUFFICIENT") & (level <= 2) & (F.col("comparable_entities") >= 3)
    return first_match([(low, "LOW"), (high, "HIGH"), (medium, "MEDIUM")], "LOW")


def together(score: Column, local: Column) -> Column:
    """The combination of the signs of the score gap and the local gap."""
    flat = lambda c: c.isin("NEUTRAL", "NEGATIVE")
    return first_match(
        [((score == "POSITIVE") & (local == "POSITIVE"), "DOUBLE_POSITIVE"), ((local == "POSITIVE") & flat(score), "LOCAL_ONLY_POSITIVE"), ((score == "POSITIVE") & flat(local), "SCORE_ONLY_POSITIVE"), ((score == "NEGATIVE") & (local == "NEGATIVE"), "DOUBLE_NEGATIVE")],
        "MIXED_OR_NEUTRAL",
    )


def dual_signals(df: DataFrame, market: str, trusted: Sequence[str] = ("HIGH", "MEDIUM")) -> DataFrame:
    """df with both signals, their confidence and a class.

    Takes market, level, confidence (of the price model), width_pct, fair, fair_low, fair_high, price_6m, price_12m, deals_12m,
    comparable_entities, recent_residual, score_gap, score_confidence, positive (the share of draws with a positive score
    gap) and quality. Gaps are percent of the observed price over a year. A gap is extreme from the 90 % quantile of absolute
    trusted gaps on; a market is biased if the median of its trusted gaps is as far out among markets.
    """
    gap = lambda value, base: F.when(F.col(base) > 0, percent_gap(F.col(value), F.col(base)))
    out = df.withColumns({"gap_6m": gap("fair", "price_6m"), "local_gap": gap("fair", "price_12m"), "gap_low": gap("fair_low", "price_12m"), "gap_high": gap("fair_high", "price_12m")})
    out = written(out.withColumns({"stability": both_windows(F.col("gap_6m"), F.col("local_gap")), "interval": interval_signal(F.col("local_gap"), F.col("gap_low"), F.col("gap_high"))}), "dual-gaps")
    known = F.col("confidence").isin(*trusted) & F.col("local_gap").isNotNull()
    width = exact_quantiles(out.where("local_gap is not null"), [], ["width_pct"], [0.75, 0.9]).select(F.col("width_pct").alias("_widths"))
    far = exact_quantiles(out.where(known).withColumn("_a", F.abs("local_gap")), [], ["_a"], [0.9]).select(F.get("_a", F.lit(0)).alias("_far"))
    per = exact_quantiles(out.where(known), [market], ["local_gap"], [0.5]).select(F.col(market).alias("_m"), F.abs(F.get("local_gap", F.lit(0))).alias("_mid"))
    per = written(per, "dual-markets")
    edge = exact_quantiles(per, [], ["_mid"], [0.9]).select(F.get("_mid", F.lit(0)).alias("_edge"))
    nothing = out.sparkSession.range(1).select(F.lit(0).alias("_zero"))  # a row for the three limits, also where there are none
    limits = nothing.join(width, F.lit(True), "left").join(far, F.lit(True), "left").join(edge, F.lit(True), "left").drop("_zero")
    out = out.crossJoin(F.broadcast(limits)).join(per, F.col(market) == F.col("_m"), "left")  # one row
    p75, p90 = F.get("_widths", F.lit(0)), F.get("_widths", F.lit(1))
    good = lambda c: F.coalesce(F.col(c).isin(*trusted), F.lit(False))
    out = out.withColumns({
        "local_confidence": local_confidence(p75, p90), "local_sign": signed(F.col("local_gap")), "score_sign": signed(F.col("score_gap")),
        "extreme": holds(known & (F.abs("local_gap") >= F.col("_far"))), "biased": holds(F.col("_mid") >= F.col("_edge")),
    })
    strong = holds((F.col("local_gap") > 0) & (F.col("stability") == "STABLE_POSITIVE") & good("local_confidence") & (F.col("score_gap") > 0) & good("score_confidence") & (F.col("positive") >= 0.75) & good("confidence"))
    out = out.withColumns({"agreement": together(F.col("score_sign"), F.col("local_sign")), "strong": strong})
    label = first_match(
        [
            (F.col("quality") == "INSUFFICIENT_MODEL_FEATURES", "UNCERTAIN"),
            (F.col("strong") & ~F.col("extreme") & ~F.col("biased"), "ROBUST_DUAL_POSITIVE"),
            ((F.col("local_sign") == "POSITIVE") & good("local_confidence") & (F.col("score_sign") != "POSITIVE"), "LOCAL_VALUE_CANDIDATE"),
            ((F.col("score_sign") == "POSITIVE") & good("score_confidence") & (F.col("local_sign") != "POSITIVE"), "SCORE_VALUE_CANDIDATE"),
            ((F.col("agreement") == "DOUBLE_NEGATIVE") | (F.col("interval") == "STRONG_OVERVALUED_SIGNAL"), "NEGATIVE_OR_FULLY_PRICED"),
        ],
        "UNCERTAIN",
    )
    lasting = holds(F.abs("recent_residual") > 0.15)
    priority = first_match(
        [
            (~F.col("extreme"), "LOW"),
            (good("local_confidence") & (F.col("deals_12m") >= 5) & (F.col("width_pct") <= p90) & lasting, "HIGH"),
            (good("confidence") & (F.col("deals_12m") >= 3), "MEDIUM"),
        ],
        "LOW",
    )
    return out.withColumns({"class": label, "audit_priority": priority}).drop("_widths", "_far", "_edge", "_m", "_mid")
