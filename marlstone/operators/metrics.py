"""Aggregates: windowed market metrics, ladders, capitalisation, shrinkage, scores, cohorts, dispersion, coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order_statistics import exact_quantiles
from ..functions.rules import first_match, holds
from ..functions.texts import RELATION_WEIGHTS  # noqa: F401


def anchored(df: DataFrame, when: str) -> DataFrame:
    """df with the last date of the data in `_last`."""
    return df.crossJoin(F.broadcast(df.agg(F.max(when).alias("_last"))))  # one row


def in_window(when: str, months: int) -> Column:
    """Whether a date lies in the trailing window (last - months, last] of anchored()."""
    return F.col(when) > F.add_months("_last", -months)


def market_metrics(facts: DataFrame, entity: str, when: str, unit: str, amount: str, size: str, periods: Mapping[str, int], segment: str | None = None, low_sample: int = 3) -> DataFrame:
    """Metrics of each entity, period and segment (with `ALL` for every one), in one pass over the facts.

    Facts before the longest period are filtered out, the others travel once for each segment they count in; the periods
    are conditions of one aggregate: median and mean unit price, median amount, count, median size, first and last date,
    and a flag for fewer than `low_sample` facts.
    """
    rows = anchored(facts, when).where(in_window(when, max(periods.values())))
    rows = rows.withColumn("segment", F.explode(F.array(F.lit("ALL"), F.col(segment).cast("string")))) if segment else rows.withColumn("segment", F.lit("ALL"))

    def metrics(name: str, months: int) -> Column:
        inside = lambda c: F.when(in_window(when, months), F.col(c))
        n = F.count_if(in_window(when, months))
        return F.struct(
            F.lit(name).alias("period"),
            F.percentile(inside(unit), 0.5).alias("median_unit"),
            F.avg(inside(unit)).alias("mean_unit"),
            F.percentile(inside(amount), 0.5).alias("median_amount"),
            n.alias("deals"),
            F.percentile(inside(size), 0.5).alias("median_size"),
            F.min(inside(when)).alias("first_date"),
            F.max(inside(when)).alias("last_date"),
            (n < low_sample).alias("low_sample"),
        )

    per = rows.groupBy(entity, "segment").agg(F.array(*(metrics(name, m) for name, m in periods.items())).alias("_m"))
    return per.select(entity, "segment", F.inline("_m")).where("deals > 0")


def period_return(facts: DataFrame, entity: str, month: str, value: str) -> DataFrame:
    """(entity, months, return): the last over the first monthly median, less one."""
    m = facts.groupBy(entity, month).agg(F.percentile(value, 0.5).alias("_v"))
    return m.groupBy(entity).agg(F.count("*").alias("months"), (F.max_by("_v", month) / F.nullif(F.min_by("_v", month), F.lit(0.0)) - 1).alias("return"))


def multi_window(facts: DataFrame, entity: str, when: str, value: str, windows: Sequence[int]) -> DataFrame:
    """(entity, n_6, median_6, ...): counts and medians of several trailing windows in one pass."""
    rows = anchored(facts, when).where(in_window(when, max(windows)))
    return rows.groupBy(entity).agg(*(x for m in windows for x in (F.count_if(in_window(when, m) & F.col(value).isNotNull()).alias(f"n_{m}"), F.percentile(F.when(in_window(when, m), F.col(value)), 0.5).alias(f"median_{m}"))))


def adaptive_window(windows: DataFrame, ladder: Sequence[tuple[int, int, str]]) -> DataFrame:
    """multi_window() rows with the first (months, least count, grade) that has enough: chosen, value, grade."""
    pick = lambda of, none: first_match([(F.col(f"n_{m}") >= k, of(m, g)) for m, k, g in ladder], none)
    return windows.withColumns({"chosen": pick(lambda m, g: m, None), "value": pick(lambda m, g: F.col(f"median_{m}"), None), "grade": pick(lambda m, g: g, "INCOMPLETE")})


def capitalisation(parts: DataFrame, entity: str, size: str, price: str) -> DataFrame:
    """(entity, cap, coverage, complete): the sum of size times price over priced parts, and their share of all sizes."""
    priced = F.col(price).isNotNull()
    out = parts.groupBy(entity).agg(F.sum(F.when(priced, F.col(size) * F.col(price))).alias("cap"), F.sum(F.when(priced, F.col(size)).otherwise(0)).alias("_p"), F.sum(size).alias("_t"))
    return out.select(entity, "cap", (F.col("_p") / F.nullif(F.col("_t"), F.lit(0))).alias("coverage"), (F.col("_p") == F.col("_t")).alias("complete"))


def weighted_mean(df: DataFrame, keys: Sequence[str], value: str, weight: str, name: str) -> DataFrame:
    """(keys, name) over rows with a value; null if their weights add up to 0."""
    there = F.col(value).isNotNull()
    return df.groupBy(*keys).agg((F.sum(F.when(there, F.col(value) * F.col(weight))) / F.nullif(F.sum(F.when(there, F.col(weight))), F.lit(0))).alias(name))


def precise_groups(rows: DataFrame, entity: str, area: str, kind: str, precision: str, size: str) -> DataFrame:
    """Sizes by area: exact areas are one group each, displayed ones are kept apart by kind; clashing ids get a suffix."""
    from ..functions.texts import group_id

    exact = F.col(precision) == "exact"
    keyed = rows.withColumn("_kind", F.when(~exact, F.col(kind)).otherwise(F.lit("")))
    out = keyed.groupBy(entity, area, precision, "_kind").agg(F.sum(size).alias(size), F.concat_ws("/", F.array_sort(F.collect_set(kind))).alias("kinds")).withColumn("_id", group_id(F.col(area)))
    by = Window.partitionBy(entity, "_id")
    n, place = F.count("*").over(by), F.row_number().over(by.orderBy(precision, "_kind"))
    return out.withColumn("area_group_id", F.when(n > 1, F.concat("_id", F.lit("_"), place.cast("string"))).otherwise(F.col("_id"))).drop("_id", "_kind")


def unit_counts(units: DataFrame, entity: str, area: str, purpose: str, include: str, exclude: str) -> DataFrame:
    """(entity, area, units) of residential units by exact decimal area; purposes by patterns, the excluding first."""
    keep = F.col(purpose).rlike(include) & ~F.col(purpose).rlike(exclude)
    return units.where(holds(keep)).groupBy(entity, F.col(area).cast("decimal(12,6)").alias(area)).agg(F.count("*").alias("units"))


def shrunk_rates(df: DataFrame, entity: str, period: str, rate: str, n: str, k: float) -> DataFrame:
    """(entity, period, baseline, shrunk): rates drawn to the period's weighted mean as (n r + k m) / (n + k)."""
    by = Window.partitionBy(period)
    mean = F.sum(F.col(rate) * F.col(n)).over(by) / F.nullif(F.sum(F.when(F.col(rate).isNotNull(), F.col(n))).over(by), F.lit(0))
    return df.withColumn("baseline", mean).select(entity, period, "baseline", ((F.col(n) * F.col(rate) + k * F.col("baseline")) / (F.col(n) + k)).alias("shrunk"))


def recency_weighted(df: DataFrame, entity: str, period: str, value: str, latest: int, weights: Sequence[float]) -> DataFrame:
    """(entity, recent, observed, stability): a mean weighted by age, over the years there are; 1 - deviation / 50."""
    weight = F.get(F.array(*map(F.lit, weights)), (F.lit(latest) - F.col(period)).cast("int"))
    there = F.col(value).isNotNull() & weight.isNotNull()
    out = df.groupBy(entity).agg(
        (F.sum(F.when(there, weight * F.col(value))) / F.sum(F.when(there, weight))).alias("recent"),
        F.count(value).alias("observed"),
        F.stddev_pop(value).alias("_s"),
    )
    return out.withColumn("stability", F.when(F.col("observed") > 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("_s") / 50)))).drop("_s")


def cohort_growth(df: DataFrame, entity: str, year: str, grades: Sequence[str]) -> DataFrame:
    """(entity, raw, growth): a grade over the grade below it a year before, on average; growth is less the population's.

    The population's growth is the quotient of the sums over all rows of both years, matched or not.
    """
    cells = F.array(*(F.struct(F.lit(i).alias("grade"), F.col(g).alias("n")) for i, g in enumerate(grades)))
    long = df.select(entity, year, F.inline(cells))
    later = lambda rows: rows.withColumns({year: F.col(year) + 1, "grade": F.col("grade") + 1}).withColumnRenamed("n", "n0")
    sums = long.groupBy(year, "grade").agg(F.sum("n").alias("n"))
    whole = sums.join(later(sums), [year, "grade"]).select(year, "grade", (F.col("n") / F.nullif(F.col("n0"), F.lit(0)) - 1).alias("_w"))
    pairs = long.join(later(long), [entity, year, "grade"]).where("n0 > 0 and n is not null")
    change = F.col("n") / F.col("n0") - 1
    return pairs.join(F.broadcast(whole), [year, "grade"]).groupBy(entity).agg(F.avg(change).alias("raw"), F.avg(change - F.col("_w")).alias("growth"))  # a row for each year and grade


def trend(df: DataFrame, entity: str, order: str, value: str, least: int = 2, by_row: bool = False) -> DataFrame:
    """(entity, span_growth, slope, slope_rate, periods) of a series by period, which may have gaps.

    The slope is over `order`, a number, or over the row number where that is wanted.
    """
    rows = df.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(Window.partitionBy(entity).orderBy(order)) - 1 if by_row else F.col(order))
    out = rows.groupBy(entity).agg(
        (F.max_by(value, order) / F.nullif(F.min_by(value, order), F.lit(0)) - 1).alias("span_growth"), F.regr_slope(value, "_i").alias("slope"), (F.regr_slope(value, "_i") / F.nullif(F.avg(value), F.lit(0))).alias("slope_rate"), F.count("*").alias("periods")
    )
    return out.where(F.col("periods") >= least)


def set_statistics(edges: DataFrame, group: str, member: str, value: str) -> DataFrame:
    """(group, n, mean, median, high, low, top_quarter) over distinct members: the last is the mean at and above the upper quartile."""
    d = edges.select(group, member, value).distinct()
    q = d.groupBy(group).agg(F.percentile(value, 0.75).alias("_q"))
    return d.join(q, group).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"), F.max(value).alias("high"), F.min(value).alias("low"), F.avg(F.when(F.col(value) >= F.col("_q"), F.col(value))).alias("top_quarter"))


#: Quality of a relation by its type; parts of a composite and of exclusivity.
RELATION_QUALITY = {"EXACT": 100.0, "ELIGIBLE": 85.0, "CONDITIONAL": 65.0, "GROUP_MEMBERSHIP": 45.0, "UNRESOLVED": 0.0}
COMPOSITE = {"mean": 0.65, "low": 0.15, "exclusivity": 0.10, "quality": 0.10}
EXCLUSIVITY = {"exact": 0.40, "concentration": 0.30, "strong": 0.30}


def by_kind(kind: Column, values: Mapping[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[kind]


def feeder_scores(relations: DataFrame, target: str, member: str, kind: str, score: str, weight: str, quality: str, parts: Mapping[str, float] = COMPOSITE, exclusive: Mapping[str, float] = EXCLUSIVITY) -> DataFrame:
    """Scores of the entities that relations lead to: weighted mean, extremes, spread, exclusivity and a composite in 0 to 100.

    Relations without a score or weight are counted only. Exclusivity is the weight's share of exact relations, the
    inverse number of distinct members, and the share of exact and eligible ones, weighed by `exclusive`; the composite
    weighs the weighted mean, the lowest score, exclusivity (times 100) and the weighted quality by `parts`.
    """
    there = F.col(score).isNotNull() & (F.col(weight) > 0)
    own = lambda c: F.when(there, c)
    total = F.sum(own(F.col(weight)))
    share = lambda *kinds: F.sum(own(F.when(F.col(kind).isin(*kinds), F.col(weight)).otherwise(0.0))) / total
    out = relations.groupBy(target).agg(
        (F.sum(own(F.col(score) * F.col(weight))) / total).alias("mean"),
        F.avg(own(F.col(score))).alias("plain_mean"),
        F.min(own(F.col(score))).alias("low"),
        F.max(own(F.col(score))).alias("high"),
        F.percentile(own(F.col(score)), 0.5).alias("median"),
        F.stddev_pop(own(F.col(score))).alias("deviation"),
        (F.sum(own(F.col(quality) * F.col(weight))) / total).alias("quality"),
        F.avg(own(F.col(weight))).alias("_weight"),
        share("EXACT").alias("_exact"),
        share("EXACT", "ELIGIBLE").alias("_strong"),
        F.size(F.collect_set(own(F.col(member)))).alias("_members"),  # a target's own members
        F.count_if(there).alias("scored"),
        F.count("*").alias("relations"),
    )
    clip = lambda c, top: F.when(F.col("scored") > 0, F.greatest(F.lit(0.0), F.least(F.lit(top), c)))
    alone = exclusive["exact"] * F.col("_exact") + exclusive["concentration"] / F.greatest(F.col("_members"), F.lit(1)) + exclusive["strong"] * F.col("_strong")
    out = out.withColumn("exclusivity", clip(alone, 1.0))
    composite = parts["mean"] * F.col("mean") + parts["low"] * F.col("low") + parts["exclusivity"] * F.col("exclusivity") * 100 + parts["quality"] * F.col("quality")
    out = out.withColumns({"spread": F.col("high") - F.col("low"), "variation": F.col("deviation") / F.nullif(F.col("plain_mean"), F.lit(0)), "uncertainty": clip(F.col("deviation") * 2 + (1 - F.col("_weight")) * 25, 100.0), "composite": clip(composite, 100.0)})
    return out.drop("_weight", "_exact", "_strong", "_members")


def dispersion(df: DataFrame, value: str, definitions: Mapping[str, str], change: str | None = None) -> DataFrame:
    """(definition, rows, groups, within, ratio, mad, iqr, change) of a price under several ways of grouping.

    within is the sample variance of the logarithms about their groups' means, ratio that over their own variance (of the
    rows that have a group under the definition); mad
    the median distance from the groups' medians, iqr the groups' mean interquartile range, change the sample variance
    of `change` about its groups' means.
    """
    price = df.where(F.col(value) > 0).select(F.col(value).alias("_v"), F.ln(value).alias("_l"), (F.col(change) if change else F.lit(None)).cast("double").alias("_c"), *dict.fromkeys(definitions.values()))
    named = F.array(*(F.struct(F.lit(name).alias("definition"), F.col(c).cast("string").alias("_g")) for name, c in definitions.items()))
    rows = price.select("_v", "_l", "_c", F.inline(named)).where("_g is not null")
    per = rows.groupBy("definition", "_g").agg(
        F.percentile("_v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"), (F.var_pop("_l") * F.count("*")).alias("_ss"), (F.var_pop("_c") * F.count("_c")).alias("_cs"), F.count("_c").alias("_cn"), F.count("*").alias("_n")
    )
    sums = per.groupBy("definition").agg(
        F.sum("_n").alias("rows"), F.count("*").alias("groups"), (F.sum("_ss") / F.nullif(F.sum("_n") - 1, F.lit(0))).alias("within"), F.avg(F.col("_q")[2] - F.col("_q")[0]).alias("iqr"), (F.sum("_cs") / F.nullif(F.sum("_cn") - 1, F.lit(0))).alias("change")
    )
    away = rows.join(per.select("definition", "_g", F.col("_q")[1].alias("_m")), ["definition", "_g"]).withColumn("mad", F.abs(F.col("_v") - F.col("_m")))
    mad = exact_quantiles(away, ["definition"], ["mad"], [0.5]).select("definition", F.get("mad", F.lit(0)).alias("mad"))
    total = rows.groupBy("definition").agg(F.var_samp("_l").alias("_t"))
    return sums.join(mad, "definition").join(total, "definition").withColumn("ratio", F.col("within") / F.nullif(F.col("_t"), F.lit(0.0))).drop("_t")


def dominant(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, dominant, share): the most frequent value, ties by the smallest, and its share."""
    per = df.groupBy(key, value).agg(F.count("*").alias("_n"))
    out = per.groupBy(key).agg(F.max(F.col("_n")).alias("_top"), F.sum("_n").alias("_all"), F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias("dominant"))
    return out.select(key, "dominant", (F.col("_top") / F.col("_all")).alias("share"))


def first_source_modes(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, column, mode) of several columns at once: the most frequent non-null value, ties by the smallest."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("_v")) for c in columns))
    per = df.select(key, F.inline(cells)).where("_v is not null").groupBy(key, "column", "_v").agg(F.count("*").alias("_n"))
    return per.groupBy(key, "column").agg(F.min_by("_v", F.struct(-F.col("_n"), F.col("_v"))).alias("mode"))


def coverage_audit(df: DataFrame, group: str, value: str, why: Column) -> DataFrame:
    """(group, total, scored, unscored, pct, main_reason): the most frequent reason of the unscored, ties by the smallest."""
    scored = F.col(value).isNotNull()
    base = df.groupBy(group).agg(F.count("*").alias("total"), F.count_if(scored).alias("scored"))
    reason = dominant(df.where(~scored).withColumn("_r", why), group, "_r").select(group, F.col("dominant").alias("main_reason"))
    return base.join(reason, group, "left").withColumns({"unscored": F.col("total") - F.col("scored"), "pct": F.col("scored") / F.col("total") * 100})


def pareto_coverage(links: DataFrame, key: str, entity: str, tops: Sequence[int]) -> DataFrame:
    """(top, covered, pct): entities linked to the keys of largest impact; an entity counts with its best key."""
    impact = links.groupBy(key).agg(F.count_distinct(entity).alias("_n"))
    # one row for each key passes through the ranking
    placed = impact.withColumn("_p", F.row_number().over(Window.orderBy(F.col("_n").desc(), key)))
    best = links.join(placed, key).groupBy(entity).agg(F.min("_p").alias("_p"))
    one = best.agg(F.count("*").alias("_all"), *(F.count_if(F.col("_p") <= t).alias(f"_{t}") for t in tops))
    return one.select(F.inline(F.array(*(F.struct(F.lit(t).alias("top"), F.col(f"_{t}").alias("covered"), (F.col(f"_{t}") / F.col("_all") * 100).alias("pct")) for t in tops))))


def scoped(df: DataFrame, scopes: Mapping[str, str | None]) -> DataFrame:
    """Each row once for every scope, with (scope, member): the whole (None) or the value of a column."""
    cells = F.array(*(F.struct(F.lit(s).alias("scope"), (F.lit("ALL") if c is None else F.col(c).cast("string")).alias("member")) for s, c in scopes.items()))
    return df.select("*", F.inline(cells))


def correlations(df: DataFrame, x: str, y: str, scopes: Mapping[str, str | None]) -> DataFrame:
    """(scope, member, pearson, spearman, n): correlations of complete rows in every scope."""
    from ..functions.ranks import average_rank, correlation

    rows = scoped(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), scopes)
    by = ["scope", "member"]
    rows = rows.withColumns({"_x": average_rank(x, by), "_y": average_rank(y, by)})
    enough = (F.count("*") >= 3) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return rows.groupBy(*by).agg(F.when(enough, correlation(x, y)).alias("pearson"), F.when(enough, correlation("_x", "_y")).alias("spearman"), F.count("*").alias("n"))


def crosswalk(df: DataFrame, group: str, cluster: str) -> DataFrame:
    """(group, cluster, n, share, relation): how groups and clusters overlap."""
    per = df.groupBy(group, cluster).agg(F.count("*").alias("n"))
    g, c = Window.partitionBy(group), Window.partitionBy(cluster)
    per = per.withColumns({"share": F.col("n") / F.sum("n").over(g), "_g": F.count("*").over(g), "_c": F.count("*").over(c)})
    relation = first_match([((F.col("_g") == 1) & (F.col("_c") == 1), "ONE_TO_ONE"), ((F.col("_g") > 1) & (F.col("_c") == 1), "SPLIT"), ((F.col("_g") == 1) & (F.col("_c") > 1), "MULTI")], "MIXED")
    return per.withColumn("relation", relation).drop("_g", "_c")


def audit_log(detectors: Sequence[tuple[str, DataFrame, str, Column, str]]) -> DataFrame:
    """(subject, issue, detail, action) from several detectors (issue, rows, subject, detail, action)."""
    out = None
    for issue, rows, subject, detail, action in detectors:
        part = rows.select(F.col(subject).cast("string").alias("subject"), F.lit(issue).alias("issue"), detail.cast("string").alias("detail"), F.lit(action).alias("action"))
        out = part if out is None else out.unionByName(part)
    return out


def as_of_rows(df: DataFrame, year: str, years: Sequence[int]) -> DataFrame:
    """Rows repeated for each year that may look back on them, as `asof`."""
    return df.withColumn("asof", F.explode(F.filter(F.array(*map(F.lit, years)), lambda y: y >= F.col(year))))


def group_bias(df: DataFrame, entity: str, group: str, gap: str, share: float = 0.9) -> DataFrame:
    """Rows with group_bias, for groups whose absolute median gap is in the upper tail, and extreme, for own gaps there."""
    medians = df.groupBy(group).agg(F.percentile(gap, 0.5).alias("_m"))
    cut = medians.agg(F.percentile(F.abs("_m"), share).alias("_gc")).crossJoin(df.agg(F.percentile(F.abs(gap), share).alias("_ec")))
    out = df.join(medians, group).crossJoin(F.broadcast(cut))  # one row
    return out.withColumns({"group_bias": F.abs("_m") >= F.col("_gc"), "extreme": F.abs(gap) >= F.col("_ec")}).drop("_m", "_gc", "_ec")


def worst_level(df: DataFrame, key: str, level: str, order: Sequence[str]) -> DataFrame:
    """(key, level): the worst of a key's levels, in the order from best to worst."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(level))
    return df.groupBy(key).agg(F.get(F.array(*map(F.lit, order)), (F.max(at) - 1).cast("int")).alias(level))
