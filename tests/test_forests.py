"""Forests that grow together from cells of bins."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import models as M


def grown(cells, depth, least):
    """What one tree of a single feature predicts for each bin, the plain way: cells are {bin: (w, wy)}."""
    bins, best = sorted(cells), None
    t, ty = (sum(cells[b][i] for b in bins) for i in (0, 1))
    for cut in bins[:-1] if depth else []:
        a, ay = (sum(cells[b][i] for b in bins if b <= cut) for i in (0, 1))
        if a >= least and t - a >= least:
            gain = ay * ay / a + (ty - ay) ** 2 / (t - a) - ty * ty / t
            if best is None or gain > best[0] + 1e-9:
                best = (gain, cut)
    if best is None or best[0] <= 1e-9:
        return dict.fromkeys(bins, ty / t)
    return grown({b: cells[b] for b in bins if b <= best[1]}, depth - 1, least) | grown({b: cells[b] for b in bins if b > best[1]}, depth - 1, least)


def test_trees_are_those_of_the_plain_way(spark):
    r = random.Random(1)
    trees = {(m, t): {b: (float(w), w * r.gauss(b % 4, 1)) for b in range(20) for w in [r.choice([0, 1, 2, 7])]} for m in range(2) for t in range(3)}
    df = spark.createDataFrame([(m, t, [b], w, wy) for (m, t), cells in trees.items() for b, (w, wy) in cells.items()], "m int, tree int, bins array<int>, w double, wy double")
    plain = {k: grown(v, 4, 3) for k, v in trees.items()}
    want = {(m, b): sum(plain[m, t][b] for t in range(3)) / 3 for m in range(2) for b in range(20)}
    for largest in (0, 8, 100):
        got = {(x.m, x.bins[0]): x.p for x in M.grown_forests(df, 4, 1, least=3, largest=largest).collect()}
        assert got == pytest.approx(want)


def test_levels_of_sums_and_of_sorted_nodes_are_the_same(spark):
    r = random.Random(2)
    rows = [(m, t, [r.randrange(6) for _ in range(4 if m else 2)]) for m in range(2) for t in range(2) for _ in range(80)]
    rows = [(m, t, list(b)) for m, t, b in sorted({(m, t, tuple(b)) for m, t, b in rows})]
    df = spark.createDataFrame([(*x, float(w), w * (sum(x[2]) + r.gauss(0, 1))) for x in rows for w in [r.randrange(4)]], "m int, tree int, bins array<int>, w double, wy double")
    told = [{(x.m, *x.bins): x.p for x in M.grown_forests(df, 5, 4, least=5, largest=k).collect()} for k in (0, 30, 1000)]
    assert told[0] == pytest.approx(told[2]) and told[1] == pytest.approx(told[2])
    assert len({round(p, 9) for p in told[0].values()}) > 10


def test_draws_are_of_a_poisson_law_and_belong_to_the_row():
    h = np.random.default_rng(3).integers(0, 2**63, 20_000).astype(np.uint64)
    times = np.array([1, 1, 1, 3, 40] * 4_000)
    drawn = M.poisson_draws(h, times, 42, 5)
    for k in (1, 3, 40):
        own = drawn[:, times == k]
        assert own.mean() == pytest.approx(0.8 * k, rel=0.02) and own.var() == pytest.approx(0.8 * k, rel=0.04)
    once = drawn[:, times == 1]
    assert (once == 0).mean() == pytest.approx(math.exp(-0.8), abs=0.005) and (once == 4).mean() == pytest.approx(math.exp(-0.8) * 0.8**4 / 24, abs=0.001)
    assert abs(np.corrcoef(once) - np.eye(5)).max() < 0.03
    some = np.arange(7, 20_000, 11)
    assert (M.poisson_draws(h[some], times[some], 42, 5) == drawn[:, some]).all()
    assert (M.poisson_draws(h[some], times[some], 43, 5) != drawn[:, some]).any()


def test_bins_are_of_equal_frequency_with_borders_between_values(spark):
    rows = [(0, 0, float(x), 1) for x in range(100)] + [(1, 0, x, n) for x, n in ((1.0, 500), (2.0, 1), (4.0, 3), (math.inf, 1))] + [(1, 1, 7.0, 9)]
    edges = M.feature_edges(spark.createDataFrame(rows, "_m int, _c int, _x double, times long"), 10)
    assert edges == {(0, 0): [math.nextafter(9.5 + 10 * i, 99) for i in range(9)], (1, 0): [math.nextafter(1.5, 2), math.nextafter(3.0, 4)]}


def test_forests_do_not_depend_on_partitions_and_agree_with_those_of_spark(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    r = random.Random(4)
    rows = [(i % 40, float(a), None if i % 50 == 0 else s, math.sin(a / 5) + s / 40 + r.gauss(0, 0.3)) for i in range(6_000) for a, s in [(r.randrange(50), float(i % 40 * 7 % 40))]]
    df = spark.createDataFrame(rows + rows[:500], "e int, area double, score double, y double")
    sets = {"base": ["area"], "both": ["area", "score"]}
    run = lambda x: {(g.features, g.seed): (g.rmse, g.mae) for g in M.forest_comparison(x, "y", sets, "e", [42, 52], trees=60, depth=6).collect()}
    got = run(df)
    again = run(df.repartition(7).orderBy(F.rand(5)))
    assert got.keys() == again.keys() == {(n, s) for n in sets for s in (42, 52)}
    for (name, seed), told in got.items():
        assert again[name, seed] == pytest.approx(told, rel=1e-9)
        split = M.group_holdout(VectorAssembler(inputCols=sets[name], outputCol="features").transform(M.complete_cases(df, ["y", *sets[name]])), "e", seed)
        model = RandomForestRegressor(labelCol="y", numTrees=60, maxDepth=6, minInstancesPerNode=10, subsamplingRate=0.8, seed=seed).fit(split.where("not is_test"))
        e = M.evaluate(model.transform(split.where("is_test")), "y", "prediction").first()
        assert told == pytest.approx((e.rmse, e.mae), rel=0.01 if name == "base" else 0.05)  # its own seeds differ by 0.02


def test_forests_without_held_out_rows_have_no_errors(spark):
    df = spark.createDataFrame([(1, float(i % 9), i / 50, "x") for i in range(60)], "e int, area double, y double, more string")
    seeds = [s for s in range(1, 30) if not M.group_holdout(df, "e", s).where("is_test").count()][:1] + [s for s in range(1, 30) if M.group_holdout(df, "e", s).where("is_test").count()][:1]
    rows = M.forest_comparison(df, "y", {"base": ["area"]}, "e", seeds, trees=3, depth=3).collect()
    assert sorted(x.seed for x in rows) == sorted(seeds) and all(x.rmse is None and x.mae is None for x in rows)
