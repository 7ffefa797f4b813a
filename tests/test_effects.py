"""Effect curves, model choice, premiums, gaps and residual relations, against dense least squares."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import effects as E
from marlstone.operators import models as M


@pytest.fixture(scope="module")
def deals():
    r, out = random.Random(6), []
    for i in range(700):
        e = r.randrange(40)
        score = (e * 37 % 113) - 6.0  # from -6 to 106
        out.append({"e": e, "g": "g" + str(e % 4), "score": score, "area": r.uniform(10, 60), "y": 2 + 0.004 * score + 0.01 * (e % 4) + r.gauss(0, 0.1), "is_test": i % 5 == 0})
    return [*out, {**out[0], "y": None}, {**out[0], "score": None}]


def plain_basis(x, model):
    ten = (x - 50) / 10
    if model == "LINEAR":
        return [ten]
    if model == "QUADRATIC":
        return [ten, ten**2]
    if model == "BINNED":
        return [float(x < 20), float(20 <= x < 40), float(60 <= x < 80), float(x >= 80)]
    t = np.arange(-60, 161, 20.0)

    def spline(i, p, z):
        if p == 0:
            return float(t[i] <= z < t[i + 1])
        return (z - t[i]) / (t[i + p] - t[i]) * spline(i, p - 1, z) + (t[i + p + 1] - z) / (t[i + p + 1] - t[i + 1]) * spline(i + 1, p - 1, z)

    if 0 <= x <= 100:
        return [spline(i, 3, x) for i in range(7)]
    edge, h = (0.0, 1e-5) if x < 0 else (100.0, -1e-5)
    return [spline(i, 3, edge) + (x - edge) * (spline(i, 3, edge + h) - spline(i, 3, edge)) / h for i in range(7)]


def dense(rows, model, clustered):
    """(coefficients of the basis, their covariance, all fitted values, parameters) with an indicator for each group."""
    groups = sorted({r["g"] for r in rows})
    x = np.array([[float(r["g"] == g) for g in groups] + [r["area"]] + (plain_basis(r["score"], model) if model != "NONE" else []) for r in rows])
    y = np.array([r["y"] for r in rows])
    inverse = np.linalg.pinv(x.T @ x)
    b = inverse @ x.T @ y
    e = y - x @ b
    n, k = x.shape
    cov = inverse * (e @ e) / (n - k)
    if clustered:
        ids = np.array([r["e"] for r in rows])
        meat = sum(np.outer(s, s) for s in (x[ids == c].T @ e[ids == c] for c in set(ids.tolist())))
        c = len(set(ids.tolist()))
        cov = inverse @ meat @ inverse * c / (c - 1) * (n - 1) / (n - k)
    at = len(groups) + 1
    return b[at:], cov[at:, at:], x @ b, k, b[:at]


@pytest.mark.parametrize("model", E.MODELS[1:])
def test_curves(spark, deals, model):
    rows = [r for r in deals if r["y"] is not None and r["score"] is not None]
    frame = spark.createDataFrame(deals, "e int, g string, score double, area double, y double, is_test boolean")
    fit = E.fitted_model(frame, "y", ["area"], model, "g", "e")
    coef, cov, fitted, k, _ = dense(rows, model, True)
    assert fit.k == k and fit.sse == pytest.approx(sum((r["y"] - f) ** 2 for r, f in zip(rows, fitted, strict=True)))
    grid = [-5.0, 0.0, 20.0, 33.0, 50.0, 79.9, 100.0, 104.0]
    got = E.effect_curve(fit, model, spark.createDataFrame([(x,) for x in grid], "score double")).orderBy("score").collect()
    for x, r in zip(grid, got, strict=True):
        delta = np.array(plain_basis(x, model)) - np.array(plain_basis(50.0, model))
        se = np.sqrt(max(0.0, delta @ cov @ delta))
        want = [np.expm1(delta @ coef + s * 1.96 * se) * 100 for s in (0, -1, 1)]
        assert np.allclose([r.effect_pct, r.low_pct, r.high_pct], want, rtol=1e-4, atol=1e-6)
    assert next(r for x, r in zip(grid, got, strict=True) if x == 50.0).high_pct == pytest.approx(0.0, abs=1e-9)
    back = M.with_fit(frame.where("y is not null and score is not null").withColumns(E.score_basis(F.col("score"), model)), fit, "g").select("y", "fitted").collect()
    assert sorted(r.fitted for r in back) == pytest.approx(sorted(fitted.tolist()))


def test_compared_models(spark, deals):
    rows = [r for r in deals if r["y"] is not None and r["score"] is not None]
    frame = spark.createDataFrame(deals, "e int, g string, score double, area double, y double, is_test boolean")
    table, _ = E.compared_models(frame, "y", ["area"], "g", "e", models=("NONE", "LINEAR", "QUADRATIC"))
    got = {r.model: r for r in table.collect()}
    for model, row in got.items():
        _, _, fitted, k, _ = dense(rows, model, False)
        y = np.array([r["y"] for r in rows])
        n, sse = len(y), float(((y - fitted) ** 2).sum())
        assert row.parameters == k and row.aic == pytest.approx(n * (np.log(sse / n) + 1 + np.log(2 * np.pi)) + 2 * k) and row.bic - row.aic == pytest.approx(k * (np.log(n) - 2))
        assert row.mae_in == pytest.approx(np.abs(y - fitted).mean()) and row.adj_r2 == pytest.approx(1 - sse / ((y - y.mean()) ** 2).sum() * (n - 1) / (n - k))
        early, late = [r for r in rows if not r["is_test"]], [r for r in rows if r["is_test"]]
        coef, _, _, _, rest = dense(early, model, False)
        groups = sorted({r["g"] for r in early})
        p = np.array([rest[groups.index(r["g"])] + rest[-1] * r["area"] + np.dot(coef, plain_basis(r["score"], model) if model != "NONE" else []) for r in late])
        t = np.array([r["y"] for r in late])
        slope, intercept = np.polyfit(p, t, 1)
        assert [row.rmse, row.mae, row.slope, row.intercept] == pytest.approx([np.sqrt(((t - p) ** 2).mean()), np.abs(t - p).mean(), slope, intercept])
    assert sum(r.chosen for r in got.values()) == 1 and got["NONE"].monotone


def test_premiums(spark, deals):
    rows = [r for r in deals if r["y"] is not None and r["score"] is not None]
    frame = spark.createDataFrame(rows, "e int, g string, score double, area double, y double, is_test boolean")
    fit = E.fitted_model(frame, "y", ["area"], "QUADRATIC", "g", "e")
    got = {r.e: r for r in E.premiums(frame, fit, "QUADRATIC", "g", "e", "area", F.col("is_test")).collect()}
    coef, _, fitted, _, _ = dense(rows, "QUADRATIC", True)
    for e, r in got.items():
        own = [(f, x) for f, x in zip(fitted, rows, strict=True) if x["e"] == e and x["is_test"]]
        a = np.median([np.exp(f) * x["area"] for f, x in own])
        b = np.median([np.exp(f - np.dot(coef, plain_basis(x["score"], "QUADRATIC"))) * x["area"] for f, x in own])
        assert [r.adjusted, r.baseline, r.premium_pct] == pytest.approx([a, b, (a / b - 1) * 100]) and r.deals == len(own) and (r.uncertainty_pct > 0) == (abs(r.premium_pct) > 0)
    assert set(got) == {r["e"] for r in rows if r["is_test"]}


def test_gaps_and_confidence(spark):
    rows = [(1, 60.0, 5.0, 2.0, 1.0, "A", 5, 12), (2, 60.0, 5.0, 2.0, 9.0, "A", 5, 12), (3, 60.0, 5.0, 2.0, 1.0, "B", 1, 6), (4, 60.0, 5.0, 2.0, None, "A", 5, 0), (5, None, None, 2.0, 1.0, "A", 5, 12), (6, 60.0, 5.0, 2.0, 1.0, "C", 9, 99), (7, 60.0, None, 2.0, 3.0, "A", 9, 99)]
    df = spark.createDataFrame(rows, "e int, score double, expected_pct double, residual_pct double, comparable_pct double, grade string, deals int, comparables int")
    got = {r.e: (r.gap, r.confidence, r.quality) for r in E.value_gaps(df).collect()}
    assert got == {1: (3.5, "HIGH", "OK"), 2: (-0.5, "LOW", "METHOD_DIRECTION_DISAGREEMENT"), 3: (3.5, "MEDIUM", "OK"), 4: (3.0, "LOW", "INSUFFICIENT_COMPARABLES"), 5: (None, "LOW", "SCORE_MISSING"), 6: (3.5, "LOW", "OK"), 7: (None, "LOW", "MODEL_PRICE_MISSING")}


def test_residual_relations(spark, deals):
    rows = [r for r in deals if r["y"] is not None and r["score"] is not None]
    frame = spark.createDataFrame(deals, "e int, g string, score double, area double, y double, is_test boolean")
    segments = {"ALL": F.lit(True), "LARGE": F.col("area") > 30, "NEVER": F.col("area") > 1000}
    got = {r.segment: r for r in E.residual_relations(frame, "y", "score", "e", segments).collect()}
    assert set(got) == {"ALL", "LARGE"}
    for name, own in (("ALL", rows), ("LARGE", [r for r in rows if r["area"] > 30])):
        x = np.array([[1.0, (r["score"] - 50) / 10] for r in own])
        y, ids = np.array([r["y"] for r in own]), np.array([r["e"] for r in own])
        inverse = np.linalg.inv(x.T @ x)
        b = inverse @ x.T @ y
        e = y - x @ b
        clusters = sorted(set(ids.tolist()))
        meat = sum(np.outer(s, s) for s in (x[ids == c].T @ e[ids == c] for c in clusters))
        cov = inverse @ meat @ inverse * len(clusters) / (len(clusters) - 1) * (len(y) - 1) / (len(y) - 2)
        mean = np.array([[x[ids == c, 1].mean(), y[ids == c].mean()] for c in clusters])
        r = got[name]
        assert [r.coef, r.se, r.pearson, r.r2] == pytest.approx([b[1], np.sqrt(cov[1, 1]), np.corrcoef(mean.T)[0, 1], 1 - e @ e / ((y - y.mean()) ** 2).sum()])
        assert (r.deals, r.entities) == (len(own), len(clusters))
