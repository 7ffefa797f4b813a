"""Clusters, their stability, names and markets, against plain loops."""

import hashlib
import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import clusters as C

COLUMNS = ["a", "b"]


@pytest.fixture(scope="module")
def cloud():
    r = random.Random(2)
    return [(i, r.gauss(4 * (i % 3), 1), r.gauss(3 * (i % 3 == 1), 1)) for i in range(90)]


@pytest.fixture(scope="module")
def points(spark, cloud):
    return spark.createDataFrame(cloud, "id int, a double, b double").repartition(4).cache()


def plain_lloyd(x, centres, rounds=15):
    centres = np.array(centres, float)
    for _ in range(rounds):
        label = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([x[label == k].mean(0) if (label == k).any() else c for k, c in enumerate(centres)])
    square = ((x[:, None] - centres[None]) ** 2).sum(2)
    return square.argmin(1), square.min(1), centres


def test_lloyd_and_quality(spark, cloud, points):
    x = np.array([r[1:] for r in cloud])
    centres = C.starting_centres(points, "id", COLUMNS, [2, 3])
    starts = {}
    for r in centres.collect():
        starts.setdefault(r.rep, {})[r.cluster] = (r.a, r.b)
    assert set(starts) == {f"{k}:{o}" for k in (2, 3) for o in ("a", "b", "sum")} and all(tuple(p) in {c[1:] for c in cloud} for s in starts.values() for p in s.values())
    found, ends = C.lloyd(points.crossJoin(centres.select("rep").distinct()), centres, COLUMNS)
    for rep, start in starts.items():
        label, square, last = plain_lloyd(x, [start[k] for k in sorted(start)])
        got = {r.id: (r.cluster, r.square) for r in found.where(F.col("rep") == rep).collect()}
        assert all(got[i][0] == label[i] and got[i][1] == pytest.approx(square[i]) for i in got) and len(got) == 90
        assert {r.cluster: r.members for r in ends.where(F.col("rep") == rep).collect()} == Counter(label.tolist())
        q = C.cluster_quality(found.where(F.col("rep") == rep), COLUMNS).first()
        k, n = len(start), len(x)
        away = ((x[:, None] - x[None]) ** 2).sum(2)
        s = []
        for i in range(n):
            own = [j for j in range(n) if label[j] == label[i] and j != i]
            b = min(away[i, label == c].mean() for c in range(k) if c != label[i])
            s.append((b - away[i, own].mean()) / max(b, away[i, own].mean()) if own else 0.0)
        mean = x.mean(0)
        between = sum((label == c).sum() * ((last[c] - mean) ** 2).sum() for c in range(k))
        spread = [np.sqrt(square[label == c]).mean() for c in range(k)]
        db = np.mean([max((spread[c] + spread[e]) / np.linalg.norm(last[c] - last[e]) for e in range(k) if e != c) for c in range(k)])
        assert q.silhouette == pytest.approx(np.mean(s)) and q.calinski_harabasz == pytest.approx(between / (k - 1) / (square.sum() / (n - k))) and q.davies_bouldin == pytest.approx(db)
    empty, _ = C.lloyd(points.limit(3).withColumn("rep", F.lit(1)), spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 1e9, 1e9)], "rep int, cluster int, a double, b double"), COLUMNS)
    assert {r.cluster for r in empty.collect()} == {0}


def test_the_choice_of_k(spark):
    rows = [(2, 0.5, 10.0, 1.0, 9), (3, 0.6, 12.0, 0.8, 5), (4, 0.9, 99.0, 0.1, 1), (5, 0.6, 11.0, 0.9, 4)]
    table = spark.createDataFrame(rows, "k int, s double, c double, d double, least int")
    got = {r.k: (r.rank_score, r.chosen) for r in C.rank_sum_choice(table, ["s", "c"], ["d"], F.col("least") >= 3).collect()}
    assert got == {2: (9.0, False), 3: (1.5 + 1 + 1, True), 4: (None, False), 5: (1.5 + 2 + 2, False)}


def test_best_assignment():
    r = np.random.default_rng(0)
    for _ in range(300):
        n = int(r.integers(1, 6))
        table = r.integers(0, 9, (n, n))
        worth = lambda p: sum(table[p[j], j] for j in range(n)) * (n + 1) + sum(p[j] == j for j in range(n))  # noqa: B023, E731
        got = C.best_assignment(table)
        assert sorted(got) == list(range(n)) and worth(got) == max(map(worth, permutations(range(n))))


def test_resampled_medians_and_stability(spark, cloud, points):
    r = random.Random(7)
    deals = [(i, n, round(r.gauss(100, 20), 1)) for i in range(12) for n in range(1 + i % 7)] + [(3, 99, None)]
    frame = spark.createDataFrame(deals, "id int, n int, v double").repartition(3)
    got = {(x.rep, x.id): x["median"] for x in C.resampled_medians(frame, "id", "v", "n", 20, seed=4).collect()}
    for i in range(12):
        own = sorted((v, n) for j, n, v in deals if j == i and v is not None)
        for rep in range(20):
            drawn = sorted(int(hashlib.md5(f"4|{i}|{rep}|{j}".encode()).hexdigest()[:8], 16) % len(own) for j in range(len(own)))
            assert got[rep, i] == pytest.approx((own[drawn[(len(own) - 1) // 2]][0] + own[drawn[len(own) // 2]][0]) / 2)
    base = [(i, i % 3) for i in range(90)]
    turned = [(rep, i, (i + rep) % 3 if i % 11 else 0) for rep in range(4) for i in range(90)]
    labels = spark.createDataFrame(turned, "rep int, id int, cluster int")
    aligned = C.aligned_labels(labels, spark.createDataFrame(base, "id int, base int"), "id")
    of = {(x.rep, x.id): x.aligned for x in aligned.collect()}
    assert all(of[rep, i] == i % 3 for rep in range(4) for i in range(90) if i % 11)
    got = {x.id: (x.modal, x.stability) for x in C.assignment_stability(aligned, "id", 4).collect()}
    votes = {i: Counter(of[rep, i] for rep in range(4)) for i in range(90)}
    assert got == {i: (min(k for k in v if v[k] == max(v.values())), max(v.values()) / 4) for i, v in votes.items()}


def test_scales_are_fitted_once(spark):
    r = random.Random(1)
    rows = [(r.gauss(0, 5), r.expovariate(1), None if i % 9 else 3.0) for i in range(500)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    fitted = C.fitted_scale(df, ["a", "b", "c"])
    x = np.array([row[:2] for row in rows])
    low, high = np.percentile(x, [1, 99], axis=0)
    inside = np.clip(x, low, high)
    q = np.percentile(inside, [25, 50, 75], axis=0)
    got = C.scaled(spark.createDataFrame([(100.0, 0.0, None), (-1.0, 2.0, 3.0)], "a double, b double, c double"), fitted, [["a", "b"], ["c"]]).collect()
    want = (np.clip([[100.0, 0.0], [-1.0, 2.0]], low, high) - q[1]) / (q[2] - q[0]) / np.sqrt(2)
    assert np.allclose([[row.a, row.b] for row in got], want) and [row.c for row in got] == [None, 0.0]


def test_names_and_markets(spark):
    labels = spark.createDataFrame([(i, c, v, w) for i, (c, v, w) in enumerate([(0, 1.0, 9.0), (0, 1.0, 9.0), (1, 5.0, 1.0), (2, 9.0, 5.0), (2, 9.0, 5.0), (2, 9.0, 5.0)])], "id int, cluster int, a double, b double")
    rules = (("TOP", {"a": 1.0}, None), ("WIDE", {"b": 1.0}, 0.5), ("NEVER", {"a": 1.0}, 9.0))
    assert {r.cluster: (r.members, r.name) for r in C.named_clusters(labels, COLUMNS, rules, "REST").collect()} == {0: (2, "WIDE"), 1: (1, "REST"), 2: (3, "TOP")}
    rows = [("g", 0, 1, 5)] * 3 + [("g", 1, 1, 5)] * 3 + [("h", 0, 1, 5)] * 4 + [("h", 1, 1, 5)] + [("i", 0, 1, 5)] * 9 + [("j", 0, 1, 60), ("j", 1, 1, 70), ("j", None, 1, 1)]
    got = C.subdivided(spark.createDataFrame(rows, "grp string, k int, x int, w int"), "grp", "k", "w", 3, 50)
    assert Counter((r.market, r.rule) for r in got.collect()) == {
        ("g|C00", "SUBDIVISION"): 3, ("g|C01", "SUBDIVISION"): 3, ("h|ALL", "GROUP"): 5, ("i|ALL", "GROUP"): 9, ("j|C00", "SUBDIVISION"): 1, ("j|C01", "SUBDIVISION"): 1, ("j|ALL", "GROUP"): 1
    }
    near = C.representatives(spark.createDataFrame([("m", i, float(abs(i - 4)), 0.0) for i in range(9)] + [("n", 1, 2.0, 2.0)], "m string, id int, a double, b double"), "m", "id", COLUMNS, 3)
    mean = sum(abs(i - 4) for i in range(9)) / 9
    assert {r.m: r.representatives for r in near.collect()} == {"m": sorted(range(9), key=lambda i: (round((abs(i - 4) - mean) ** 2, 9), i))[:3], "n": [1]}
