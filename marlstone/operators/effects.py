"""The effect of a score on a price: bases, curves with intervals against a reference, model choice, premiums and value gaps."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import first_match
from ..functions.staging import written
from .models import AbsorbedFit, EffectMoments, absorbed_fit, complete_cases, with_fit, with_fits

#: The score that effects are told against, and the knots of the spline and of the bins.
REFERENCE, KNOTS = 50.0, (0.0, 20.0, 40.0, 60.0, 80.0, 100.0)
MODELS = ("NONE", "LINEAR", "QUADRATIC", "BINNED", "SPLINE")


def _cubic(u: Column, slope: bool = False) -> Column:
    """The cubic B-spline with knots 0, 1, 2, 3, 4 at u, or its derivative."""
    power = 2 if slope else 3
    part = lambda j: F.lit((-1.0) ** j * math.comb(4, j) / (2 if slope else 6)) * F.greatest(u - F.lit(float(j)), F.lit(0.0)) ** power
    return sum((part(j) for j in range(1, 5)), part(0))


def score_basis(x: Column, model: str) -> dict[str, Column]:
    """The columns of a model of a score, by name: in steps of ten from REFERENCE, bins without the middle one, or splines.

    Splines are cubic with evenly spaced KNOTS, the last of them left out, and go on straight beyond the outer knots.
    """
    ten = (x - REFERENCE) / 10.0
    if model == "LINEAR":
        return {"score_10": ten}
    if model == "QUADRATIC":
        return {"score_10": ten, "score_10_sq": ten * ten}
    if model == "BINNED":
        inner = KNOTS[1:-1]
        edges = [None, *inner, None]
        made = {}
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if (a, b) == (40.0, 60.0):
                continue
            inside = (x < b if a is None else x >= a) if a is None or b is None else (x >= a) & (x < b)
            made[f"bin_{i}"] = inside.cast("double")
        return made
    if model == "SPLINE":
        wide = KNOTS[1] - KNOTS[0]
        near = F.least(F.greatest(x, F.lit(KNOTS[0])), F.lit(KNOTS[-1]))
        at = lambda i: (near - F.lit(KNOTS[0] + (i - 3) * wide)) / wide
        return {f"spline_{i}": _cubic(at(i)) + (x - near) * _cubic(at(i), slope=True) / wide for i in range(len(KNOTS) + 1)}
    if model == "NONE":
        return {}
    raise ValueError(model)


def effect_curve(fit: AbsorbedFit, model: str, grid: DataFrame, score: str = "score") -> DataFrame:
    """grid with log_effect, its standard error, and effect_pct, low_pct, high_pct (95 %) against REFERENCE.

    The error is that of the difference of the basis: the root of delta' V delta, V being the fit's covariance.
    """
    here, there = score_basis(F.col(score), model), score_basis(F.lit(REFERENCE), model)
    names = list(here)
    at = [fit.xs.index(c) for c in names]
    grid = grid.withColumns({f"_delta{i}": here[c] - there[c] for i, c in enumerate(names)})  # each is looked at many times
    coef, cov = fit.coef[at], fit.cov[np.ix_(at, at)]
    log = F.expr(" + ".join(["0.0D", *(f"({float(b)!r}D) * _delta{i}" for i, b in enumerate(coef))]))
    square = F.expr(" + ".join(["0.0D", *(f"({float(cov[i, j])!r}D) * _delta{i} * _delta{j}" for i in range(len(at)) for j in range(len(at)))]))
    told = grid.withColumns({"log_effect": log, "error": F.sqrt(F.greatest(square, F.lit(0.0)))})
    percent = lambda s: F.expm1(F.col("log_effect") + s * 1.96 * F.col("error")) * 100
    return told.withColumns({"effect_pct": percent(0), "low_pct": percent(-1), "high_pct": percent(1)}).drop(*(f"_delta{i}" for i in range(len(names))))


def fitted_model(df: DataFrame, y: str, controls: Sequence[str], model: str, effect: str | None, cluster: str | None, score: str = "score") -> AbsorbedFit:
    """The fit of y on the controls and the model's basis of the score."""
    basis = score_basis(F.col(score), model)
    return absorbed_fit(df.withColumns(basis) if basis else df, y, [*controls, *basis], effect, cluster)


def compared_models(df: DataFrame, y: str, controls: Sequence[str], effect: str, cluster: str, score: str = "score", models: Sequence[str] = MODELS) -> tuple[DataFrame, dict[str, AbsorbedFit]]:
    """(a row for each model, the fits of all rows): fitted on rows that are not is_test, judged on those that are.

    model, parameters, adj_r2, aic, bic, rmse_in, mae_in (over all rows), rmse, mae, r2, slope, intercept (over is_test), monotone
    (the curve from 0 to 100 never falls) and chosen: a monotone model beyond LINEAR that is half a percent better than it
    in both errors out of sample, the best by rmse, mae and parameters; else LINEAR.
    """
    bases = {model: score_basis(F.col(score), model) for model in models}
    columns = {f"{model}_{c}": x for model, basis in bases.items() for c, x in basis.items()}
    rows = written(complete_cases(df, [y, score, *controls]).withColumns(columns), "effect-models")
    # one pass over all rows and one over the early ones serve all models
    names = [*controls, *columns]
    every, early = EffectMoments(rows, y, names, effect, cluster), EffectMoments(rows.where("not is_test"), y, names, effect)
    of = {model: [*controls, *(f"{model}_{c}" for c in basis)] for model, basis in bases.items()}
    whole = {model: every.fit(xs, clustered=model != "BINNED") for model, xs in of.items()}
    then = {model: early.fit(xs) for model, xs in of.items()}
    e = lambda name: F.col(y) - F.col(name)
    inside = with_fits(rows, {f"_{m}": f for m, f in whole.items()}, effect).agg(*(F.avg(F.abs(e(f"_{m}"))).alias(m) for m in of)).first()
    judged = []
    for m in of:
        p = f"_{m}"
        judged += [F.sqrt(F.avg(e(p) ** 2)).alias(f"{m}_rmse"), F.avg(F.abs(e(p))).alias(f"{m}_mae"), (1 - F.sum(e(p) ** 2) / F.nullif(F.var_pop(y) * F.count("*"), F.lit(0.0))).alias(f"{m}_r2"), F.regr_slope(F.col(y), F.col(p)).alias(f"{m}_slope"), F.regr_intercept(F.col(y), F.col(p)).alias(f"{m}_intercept")]
    later = with_fits(rows.where("is_test"), {f"_{m}": f for m, f in then.items()}, effect).agg(*judged).first()
    fits = {m: replace(f, xs=[*controls, *bases[m]]) for m, f in whole.items()}
    out = []
    for model, fit in fits.items():
        m, rising = fit.metrics(), True
        if model != "NONE":
            grid = df.sparkSession.range(101).select(F.col("id").cast("double").alias(score))
            effects = [r.log_effect for r in effect_curve(fit, model, grid, score).orderBy(score).collect()]  # 101 rows
            rising = all(b - a >= -1e-7 for a, b in zip(effects, effects[1:], strict=False))
        out.append((model, fit.k, m["adj_r2"], m["aic"], m["bic"], m["rmse"], inside[model], *(later[f"{model}_{c}"] for c in ("rmse", "mae", "r2", "slope", "intercept")), rising))
    base = next((r for r in out if r[0] == "LINEAR"), None)
    better = [r for r in out if base and base[7] is not None and r[0] not in ("NONE", "LINEAR") and r[12] and r[7] <= base[7] * 0.995 and r[8] <= base[8] * 0.995]
    chosen = min(better, key=lambda r: (r[7], r[8], r[1]))[0] if better else "LINEAR"
    table = df.sparkSession.createDataFrame(
        [(*r, r[0] == chosen) for r in out],
        "model string, parameters int, adj_r2 double, aic double, bic double, rmse_in double, mae_in double, rmse double, mae double, r2 double, slope double, intercept double, monotone boolean, chosen boolean",
    )
    return table, fits


def premiums(df: DataFrame, fit: AbsorbedFit, model: str, effect: str, entity: str, size: str, window: Column, score: str = "score") -> DataFrame:
    """(entity, deals, baseline, adjusted, premium_pct, premium_amount, uncertainty_pct) over the rows in a window.

    A row is priced twice by one fit, with its own score and with REFERENCE; medians over an entity's rows are compared. The
    uncertainty is half the curve's interval at the entity's score, rounded to a whole one from 0 to 100.
    """
    here, there = score_basis(F.col(score), model), score_basis(F.lit(REFERENCE), model)
    rows = with_fit(df.where(window).withColumns(here), fit, effect, "_own")
    coef = dict(zip(fit.xs, fit.coef, strict=True))
    less = sum((F.lit(float(coef[c])) * (F.col(c) - there[c]) for c in here), F.lit(0.0))
    rows = rows.withColumns({"_a": F.exp("_own") * F.col(size), "_b": F.exp(F.col("_own") - less) * F.col(size)})
    per = rows.groupBy(entity).agg(F.count("*").alias("deals"), F.first(score).alias("score_of"), F.percentile("_b", 0.5).alias("baseline"), F.percentile("_a", 0.5).alias("adjusted"))
    per = per.withColumn("_at", F.least(F.greatest(F.bround("score_of"), F.lit(0.0)), F.lit(100.0)))
    told = effect_curve(fit, model, per, "_at")
    return told.select(
        entity, "deals", "baseline", "adjusted", ((F.col("adjusted") / F.col("baseline") - 1) * 100).alias("premium_pct"), (F.col("adjusted") - F.col("baseline")).alias("premium_amount"), ((F.col("high_pct") - F.col("low_pct")) / 2).alias("uncertainty_pct")
    )


def value_gaps(df: DataFrame) -> DataFrame:
    """df (expected_pct, residual_pct, comparable_pct, grade, deals, comparables) with gaps and how far to trust them.

    residual_gap and comparable_gap are what is expected less what each method observes; observed_pct is the mean of the
    methods there are, gap the expected less that. confidence is HIGH with grade A or B, 3 deals, 10 comparables and
    methods that agree in direction, MEDIUM with 1 deal and 5 comparables, else LOW.
    """
    e, r, c = (F.col(x) for x in ("expected_pct", "residual_pct", "comparable_pct"))
    there = F.array_compact(F.array(r, c))
    mean = F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there))
    same = F.coalesce(F.signum(e - r) == F.signum(e - c), F.lit(False))
    graded = F.col("grade").isin("A", "B") & same
    level = first_match([(graded & (F.col("deals") >= 3) & (F.col("comparables") >= 10), "HIGH"), (graded & (F.col("deals") >= 1) & (F.col("comparables") >= 5), "MEDIUM")], "LOW")
    flag = first_match([(F.col("score").isNull(), "SCORE_MISSING"), (e.isNull(), "MODEL_PRICE_MISSING"), (F.coalesce("comparables", F.lit(0)) < 5, "INSUFFICIENT_COMPARABLES"), (~same, "METHOD_DIRECTION_DISAGREEMENT")], "OK")
    return df.withColumns({"residual_gap": e - r, "comparable_gap": e - c, "observed_pct": mean, "gap": e - mean, "confidence": level, "quality": flag})


def residual_relations(df: DataFrame, residual: str, score: str, entity: str, segments: Mapping[str, Column]) -> DataFrame:
    """(segment, deals, entities, coef, se, t, pearson, r2) of a residual on (score - REFERENCE) / 10, for each segment.

    All segments come from one pass: moments of each (segment, entity), from which the clustered error follows without
    another look at the rows. A row counts in each segment whose condition it meets; pearson is of entities' means.
    """
    member = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in segments.items())))
    x, y = (F.col(score) - REFERENCE) / 10.0, F.col(residual)
    rows = complete_cases(df, [residual, score]).select(F.col(entity).alias("_k"), x.alias("_x"), y.alias("_y"), F.explode(member).alias("segment"))
    s = {"_n": F.count("*"), "_sx": F.sum("_x"), "_sy": F.sum("_y"), "_sxx": F.sum(F.col("_x") ** 2), "_sxy": F.sum(F.col("_x") * F.col("_y")), "_syy": F.sum(F.col("_y") ** 2)}
    per = rows.groupBy("segment", "_k").agg(*(v.alias(k) for k, v in s.items()))
    whole = per.groupBy(F.col("segment").alias("_seg")).agg(*(F.sum(k).alias(f"t{k}") for k in s), F.count("*").alias("_g"))
    det = F.col("t_n") * F.col("t_sxx") - F.col("t_sx") ** 2
    b = (F.col("t_n") * F.col("t_sxy") - F.col("t_sx") * F.col("t_sy")) / F.nullif(det, F.lit(0.0))
    a = (F.col("t_sy") - b * F.col("t_sx")) / F.col("t_n")
    whole = whole.withColumns({"coef": b, "_a": a, "_det": det})
    met = per.join(whole, F.col("segment") == F.col("_seg"))
    e0 = F.col("_sy") - F.col("_a") * F.col("_n") - F.col("coef") * F.col("_sx")
    e1 = F.col("_sxy") - F.col("_a") * F.col("_sx") - F.col("coef") * F.col("_sxx")
    # the slope's row of the inverse, times an entity's score
    pull = (F.col("t_n") * e1 - F.col("t_sx") * e0) / F.nullif(F.col("_det"), F.lit(0.0))
    mx, my = F.col("_sx") / F.col("_n"), F.col("_sy") / F.col("_n")
    left = F.col("t_syy") - F.col("_a") * F.col("t_sy") - F.col("coef") * F.col("t_sxy")
    last = [F.first(c).alias(c) for c in ("t_n", "_g", "coef", "t_syy", "t_sy", "_a", "t_sxy")]
    out = met.groupBy("segment").agg(*last, F.sum(pull * pull).alias("_m"), (F.covar_pop(mx, my) / F.nullif(F.stddev_pop(mx) * F.stddev_pop(my), F.lit(0.0))).alias("pearson"))
    fix = F.col("_g") / F.greatest(F.col("_g") - 1, F.lit(1)) * (F.col("t_n") - 1) / F.greatest(F.col("t_n") - 2, F.lit(1))
    se = F.sqrt(F.col("_m") * fix)
    return out.select("segment", F.col("t_n").alias("deals"), F.col("_g").alias("entities"), "coef", se.alias("se"), (F.col("coef") / F.nullif(se, F.lit(0.0))).alias("t"), "pearson", (1 - left / F.nullif(F.col("t_syy") - F.col("t_sy") ** 2 / F.col("t_n"), F.lit(0.0))).alias("r2"))
