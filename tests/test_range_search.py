"""Searches of ranges against looking at everything, and that queries which use them form no pairs of a block's rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions.range_search import BoxTree, places_in_ranges
from marlstone.operators import joins as J


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [1, 15, 16, 17, 400])
def test_first_points_of_boxes(n):
    r = np.random.default_rng(n)
    ranks = [r.permutation(n) for _ in range(3)]
    low, high = (r.integers(0, n + 1, (3, 50)) for _ in range(2))
    low[:, :10], high[:, :10] = 0, n
    for k in (1, 3, 20):
        got = BoxTree(ranks, k).first(list(low), list(high))
        for i in range(50):
            inside = np.flatnonzero(np.all([(a >= low[d, i]) & (a < high[d, i]) for d, a in enumerate(ranks)], axis=0))[:k]
            assert got[i].tolist() == [*inside, *[n] * (k - len(inside))]


@pytest.mark.parametrize("slices", [False, True])
def test_matches_by_bands_are_those_of_pairs(spark, monkeypatch, slices):
    monkeypatch.setattr(J, "_SEARCHED", 7 if slices else J._SEARCHED)
    r = random.Random(1)
    number = lambda *more: r.choice([None, float("nan"), float("inf"), -0.0, 0.0, 0.1, 0.3, *more, *(r.gauss(0, 2) for _ in range(9))])
    rows = [(i, r.choice(["g", "g", "h", None]), r.choice([None, 1, 2, 3, 4, 9]), number()) for i in r.sample(range(500), 120)]
    rows += [(600, "alone", 1, 1.0), (None, "g", 1, 1.0)] + [(700 + i, "two", 1, 0.1 + 0.2 * i) for i in range(2)] + [(800 + i, "same", 3, 1.0) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, g string, s int, p double")
    a, b = (df.select("g", *(F.col(c).alias(f"{x}_{c}") for c in ("id", "s", "p"))) for x in "ab")
    b = b.where("b_id % 5 > 0").unionByName(spark.createDataFrame([(9000 + i, "h", i % 4, i / 9) for i in range(20)], "b_id long, g string, b_s int, b_p double"))
    rules = [("near", "s", 1, 40.0), ("price", "p", 0.2, 42.0), ("same", "s", 0, 20.0), ("nothing", "p", 1, 0.0)]
    plain = [(name, F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= t, p) for name, c, t, p in rules]
    bands = [(name, J.Within(f"a_{c}", f"b_{c}", t), p) for name, c, t, p in rules]
    for some in (slice(0, 4), slice(0, 2), slice(1, 2)):
        want, got = (J.scored_matches(a, b, ["g"], "a_id", "b_id", x[some]) for x in (plain, bands))
        assert "FlatMapCoGroupsInPandas" in plan_of(got)  # which forms no pairs
        assert got.dtypes == want.dtypes and len(want.collect()) > 100
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    empty = J.scored_matches(a.limit(0), b, ["g"], "a_id", "b_id", bands)
    assert empty.count() == 0 and J.scored_matches(a, b.limit(0), ["g"], "a_id", "b_id", bands).count() == 0


@pytest.mark.parametrize("n", [1, 2, 300])
def test_places_in_ranges(n):
    r = np.random.default_rng(n)
    values, weights = r.choice([-1.0, 0.5, 2.0, *r.normal(size=20)], n), r.integers(1, 4, n)
    low, high, places = r.integers(0, n + 1, 90), r.integers(0, n + 1, 90), r.integers(-1, 2 * n, 90)
    for got, a, b, k in zip(places_in_ranges(values, weights, low, high, places), low, high, places, strict=True):
        whole = np.sort(np.repeat(values[a:b], weights[a:b]))
        assert got == whole[max(k, 0)] if k < len(whole) and a < b else np.isnan(got)
    assert np.isnan(places_in_ranges(values[:0], weights[:0], low * 0, high * 0, places)).all()


def test_comparables_of_a_group_form_no_pairs(spark, monkeypatch):
    plans, whole = [], J.written
    monkeypatch.setattr(J, "written", lambda df, what: (plans.append(plan_of(df)), whole(df, what))[1])
    r = random.Random(2)
    rows = [(i, "g", r.choice([0.0, None, float("nan"), -1.0, -1.05, *(r.gauss(25, 1) for _ in range(20))]), r.choice([None, r.gauss(5, 1)])) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, g string, s double, v double")
    for relative, within in ((True, 0.02), (False, 0.5)):
        got = {x.id: tuple(x)[1:] for x in J.banded_comparables(df, "id", "g", [("near", [], "s", within)], "v", 3, relative).collect()}
        for i, _, s, _ in rows:
            own = [w for j, _, z, w in rows if j != i and None not in (s, z, w) and (s or not relative) and (abs(z / s - 1) if relative else abs(z - s)) <= within]
            assert got[i] == (("near", len(own), float(np.median(own))) if len(own) >= 3 else ("NONE", 0, None)), i
    assert any("FlatMapCoGroupsInPandas" in x for x in plans) and not any("unboundedpreceding" in x for x in plans)
