"""Pools that markets fall back to, ridge models over cells, order statistics: against plain numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import order_statistics as O
from marlstone.operators import price_models as P

DESIGN = P.Design("y", ("a", "b"), ("c", "d"), "m", "e")


def dense_ridge(rows, numbers, categories, y, alpha=1.0):
    """(prediction function, residuals' standard deviation) of a ridge over scaled numbers and indicators, all rows at once."""
    rows = list(rows)
    wide = [float(np.subtract(*np.percentile([r[n] for r in rows], [75, 25]))) or 1.0 for n in numbers]
    mid = [float(np.median([r[n] for r in rows])) for n in numbers]
    levels = {c: sorted({r[c] for r in rows})[1:] for c in categories}

    def vector(r):
        return [(r[n] - m) / w for n, m, w in zip(numbers, mid, wide, strict=True)] + [float(r[c] == x) for c in categories for x in levels[c]]

    x, t = np.array([vector(r) for r in rows]), np.array([r[y] for r in rows])
    xm, tm = x.mean(0), t.mean()
    w = np.linalg.solve((x - xm).T @ (x - xm) + alpha * np.eye(x.shape[1]), (x - xm).T @ (t - tm))
    fit = lambda r: float(np.dot(np.array(vector(r)) - xm, w) + tm)
    return fit, float(np.std([r[y] - fit(r) for r in rows], ddof=1))


@pytest.fixture(scope="module")
def deals():
    r = random.Random(4)
    out = []
    for i in range(900):
        m = r.choice("ABCDEF") if i % 9 else "G"
        a, b, c, d = r.gauss(100, 30), (5.0 if m == "F" else r.expovariate(0.1)), r.choice(["q1", "q2", "q3"][: 2 if m == "B" else 3]), r.choice("xy")
        out.append({"m": m, "e": f"{m}{r.randrange(1 if m == 'E' else 6)}", "a": a, "b": b, "c": c, "d": d, "y": 3 + 0.01 * a - 0.02 * b + ord(m) / 50 + (c == "q2") * 0.3 + r.gauss(0, 0.2)})
    return out[:880] + [{**out[0], "m": "H", "e": "H1", "y": 9.0}] * 5  # H has one entity and five rows


def test_models_equal_dense_ridges(spark, deals):
    rows = spark.createDataFrame(deals).repartition(5).cache()
    pools = {"A": ("D1", 0, ["A"], True), "B": ("D1", 1, ["A", "B"], False), "C": ("D1", 2, ["A", "B", "C"], False), "D": ("D2", 0, ["D"], True), "E": ("D2", 4, None, True), "F": ("D2", 3, ["A", "F"], False), "G": ("D2", 4, None, False), "H": ("D3", 4, None, False), "I": ("D3", 2, ["H", "I"], False)}
    frame = spark.createDataFrame([(m, *x) for m, x in pools.items()], "m string, district string, level int, pool array<string>, sufficient boolean")
    got = {(r.m, r["mode"]): r for r in P.models_by_mode(rows, frame, DESIGN, "district").collect()}
    of_district = {d: [m for m, x in pools.items() if x[0] == d] for d in ("D1", "D2", "D3")}
    for m, (d, level, pool, ok) in pools.items():
        takes = {"G": list(pools), "L": [m] if ok else [], "F1": of_district[d], "F2": list(pools) if level == 4 else pool}
        for mode, markets in takes.items():
            own = [x for x in deals if x["m"] in markets]
            thin = len(own) < 30 or len({x["e"] for x in own}) < 2
            fit, sigma = dense_ridge(deals if thin else own, DESIGN.numbers, DESIGN.categories, "y")
            row = got[m, mode]
            assert (row.basis == "GLOBAL_FALLBACK") == thin, (m, mode)
            assert math.isclose(row.sigma, sigma, rel_tol=1e-9) and row.n == len(deals if thin else own)
            for x in deals[::97]:
                told = row.intercept + row.coefs[0] * x["a"] + row.coefs[1] * x["b"] + row.effects.get(f"c={x['c']}", 0) + row.effects.get(f"d={x['d']}", 0)
                assert math.isclose(told, fit(x), rel_tol=1e-9, abs_tol=1e-9), (m, mode)
    fit, sigma = dense_ridge(deals, DESIGN.numbers, (*DESIGN.categories, "m"), "y")
    for m in pools:
        row = got[m, "F3"]
        x = {**deals[3], "m": m}
        told = row.intercept + row.coefs[0] * x["a"] + row.coefs[1] * x["b"] + row.effects.get(f"c={x['c']}", 0) + row.effects.get(f"d={x['d']}", 0)
        assert math.isclose(told, fit(x), rel_tol=1e-9) and math.isclose(row.sigma, sigma, rel_tol=1e-9)  # I is unknown: no indicator


def test_the_ladder_of_pools(spark):
    """One market for each level: alone, with its like, its district, its neighbours, all."""
    rows = [
        ("a", "d1", 9, 500, 0.0, 35.0, 129.0),
        ("b", "d1", 2, 60, 0.1, 36.0, 129.0),  # like a, which suffices
        ("c", "d1", 1, 10, 90.0, 37.0, 129.0),  # like none of d1
        ("e", "d2", 1, 30, 0.2, 35.01, 129.01),  # next to a
        ("f", "d3", 1, 5, 0.0, 50.0, 129.0),  # far from all
        ("g", "d3", None, None, None, None, None),
        ("h", "d4", 4, 90, 3.0, 60.0, 10.0), ("i", "d4", 1, 5, 3.0, 60.0, 20.0), ("j", "d4", 1, 5, 3.0, 60.0, 20.0), ("k", "d4", 1, 5, 3.0, 60.0, 30.0),
    ]
    frame = spark.createDataFrame(rows, "m string, d string, n int, r int, p double, lat double, lon double")
    got = {x.m: x for x in P.market_pools(frame, "m", "d", "n", "r", ["p"], "lat", "lon").collect()}
    assert {m: got[m].level for m in "abcefg"} == {"a": 0, "b": 1, "c": 2, "e": 3, "f": 4, "g": 4}
    assert got["b"].pool == ["a", "b"] and got["c"].pool == ["a", "b", "c"] and got["e"].pool == ["a", "e"]
    # h with 90 deals needs two of its like (95, then 100), by their names
    assert got["h"].pool == ["h", "i", "j"] and got["h"].pool_deals == 100 and got["h"].reason == "SAME_DISTRICT_SIMILAR_PROFILE"
    assert got["f"].pool_entities == 21 and not got["f"].sufficient


def test_the_chosen_fallback(spark):
    kind = "mode string, rmse double, mae double"
    pick = lambda *rows: P.chosen_fallback(spark.createDataFrame(list(rows), kind))
    assert pick(("F1", 1.0, 1.0), ("F2", 0.995, 0.9), ("F3", 0.992, 0.5)) == "F1"
    assert pick(("F1", 1.0, 1.0), ("F2", 0.99, 0.9), ("F3", 0.985, 0.5)) == "F2"
    assert pick(("F1", 1.0, 1.0), ("F2", 0.9, 1.1), ("F3", 0.98, 0.99)) == "F3"
    assert P.chosen_fallback(spark.createDataFrame([], kind)) == "F1"


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_exact_quantiles(spark, accuracy):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), r.choice([None, float("nan"), round(r.gauss(0, 3), 1), r.random() * 100]), r.randint(0, 5)) for _ in range(4000)] + [("one", 7.5, None)]
    df = spark.createDataFrame(rows, "k string, x double, y int")
    shares = [0.0, 0.05, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {x.k: (x.x, x.y) for x in O.exact_quantiles(df, ["k"], ["x", "y"], shares, accuracy).collect()}
    want = df.groupBy("k").agg(F.percentile(F.nanvl("x", F.lit(None)), shares).alias("x"), F.percentile("y", shares).alias("y")).collect()
    assert got == {x.k: (x.x, x.y) for x in want}
    assert O.exact_quantiles(df.limit(0), ["k"], ["x"], [0.5]).count() == 0


def test_ranks_over_ranges(spark):
    from marlstone.functions import ranks as R

    r = random.Random(9)
    df = spark.createDataFrame([(i, r.choice(["a", "b", None]), r.choice([None, 1.0, 1.0, r.randint(0, 50) / 2])) for i in range(3000)], "id int, k string, x double").repartition(7)
    for groups in ((), ("k",)):
        of = list(groups)
        got = O.ranked(df, "x", of, first="f", mean="m", share="s", rows="n").select("id", "f", "m", "s")
        want = df.select("id", F.when(F.col("x").isNotNull(), F.rank().over(R._by(of).orderBy(F.col("x").asc_nulls_last()))).alias("f"), R.average_rank("x", of).alias("m"), R.percentile_rank("x", of).alias("s"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        down = O.ranked(df, "x", of, True, first="f").select("id", "f")
        assert sorted(map(tuple, down.collect())) == sorted(map(tuple, df.select("id", R.min_rank_desc("x", of)).collect()))
    assert O.ranked(df.limit(0), "x", first="f").count() == 0
