"""What keeps large tables within limits, on small ones: what is shuffled, and that results stay those of the plain way."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from marlstone.functions.order_statistics import exact_quantiles
from marlstone.operators import joins as J
from marlstone.operators import models as M


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_of_clusters_are_summed_behind_the_shuffle(spark, monkeypatch):
    plans, whole = {}, M.written
    monkeypatch.setattr(M, "written", lambda df, what: (plans.update({what: plan_of(df)}), whole(df, what))[1])
    r = random.Random(1)
    df = spark.createDataFrame([(i % 7, i % 3, r.random(), r.random()) for i in range(60)], "e int, g int, x double, y double")
    M.absorbed_fit(df, "y", ["x"], "g", "e")
    assert plans["fit-cells"].index("partial_sum") < plans["fit-cells"].index("Exchange hashpartitioning")


def test_bootstrap_draws_are_those_of_the_hash(spark):
    r = random.Random(2)
    rows = [(k, r.gauss(0, 1)) for k in range(5) for _ in range(k * 3 + 1)] + [(9, None)]
    df = spark.createDataFrame(rows, "k long, v double")
    n, hashed = F.size("_v"), F.xxhash64("k", "_r", F.col("_j").cast("int"), F.lit(1))
    packed = df.where("v is not null").groupBy("k").agg(F.array_sort(F.collect_list("v")).alias("_v")).withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(30))))
    drawn = packed.withColumn("_j", F.explode(F.sequence(F.lit(1), n))).select("k", "_r", F.get("_v", F.pmod(hashed, n).cast("int")).alias("x"))
    medians = drawn.groupBy("k", "_r").agg(F.percentile("x", 0.5).alias("m"))
    want = {x.k: x for x in medians.groupBy("k").agg(F.avg((F.col("m") > 0).cast("double")).alias("positive"), F.percentile("m", 0.025).alias("low"), (F.percentile("m", 0.75) - F.percentile("m", 0.25)).alias("iqr")).collect()}
    out = M.bootstrap_medians(df, "k", "v", 30)
    assert "transform(" not in plan_of(out)  # draws are made in arrays of many, not one by one
    got = {x.k: x for x in out.collect()}
    assert got.keys() == want.keys() == set(range(5))
    assert all(got[k][c] == pytest.approx(want[k][c], abs=1e-12) for k in want for c in ("positive", "low", "iqr"))


def test_clusters_and_mixtures_read_written_points(spark, monkeypatch):
    seen, whole = [], M.written
    monkeypatch.setattr(M, "written", lambda df, what: (seen.append(what), whole(df, what))[1])
    r = random.Random(3)
    df = spark.createDataFrame([(i, r.gauss(i % 3 * 9, 1), r.gauss(0, 1)) for i in range(90)], "id int, x double, y double")
    quality, labels = M.cluster_range(df, "id", ["x", "y"], [2, 3])
    assert labels.count() == 180 and [r.least for r in quality.orderBy("k").collect()][1] == 30
    assert M.mixture_bic(df, ["x", "y"], [2]).count() == 1
    assert seen == ["cluster-points", "cluster-labels", "mixture-points"]


def test_polygons_as_near_to_nine_decimals_go_by_id(spark):
    box = lambda x, y: [(x, y), (x + 25.0, y), (x + 25.0, y + 25.0), (x, y + 25.0)]
    # 0.1 and 0.3 - 0.2 apart from the point: the larger id is nearer by rounding errors only
    zones = spark.createDataFrame([(1, box(0.3, 0.0)), (2, box(-25.0 + 0.2 - 0.1, 0.0))], "z int, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 0.2, 9.0)], "k int, x double, y double")
    got = J.nearest_polygons(points, zones, "k", "z", 16.0).first()
    assert (got.z, got.distance) == (1, pytest.approx(0.1))
    far = J.nearest_polygons(points, spark.createDataFrame([(1, box(0.3 + 1e-10, 0.0)), (2, box(-24.9, 0.0))], zones.schema), "k", "z", 16.0).first()
    assert far.z == 1


def test_matches_of_a_block_with_many_copies(spark):
    r = random.Random(4)
    rows = [(i, r.choice("gh"), r.choice([None, 1, 2, 5]), r.choice([1.0, 2.0])) for i in range(60)] + [(100, "alone", 1, 1.0)]
    rows += [(1000 + i, "copies", 3, 1.0) for i in range(3000)]  # nine million pairs
    df = spark.createDataFrame(rows, "id int, g string, s int, p double")
    a, b = (df.select("g", *(F.col(c).alias(f"{x}_{c}") for c in ("id", "s", "p"))) for x in "ab")
    apart = F.abs(F.col("a_s") - F.col("b_s"))
    scores = [("size", apart <= 1, 40.0), ("price", F.col("a_p") == F.col("b_p"), 42.0)]
    got = {x.a_id: tuple(x)[1:] for x in J.scored_matches(a, b, ["g"], "a_id", "b_id", scores).collect()}
    first = {x.a_id: (x.b_id, x.rule) for x in J.first_rule_match(a, b, ["g"], "a_id", "b_id", [("same", (apart == 0) & (F.col("a_p") == F.col("b_p"))), ("near", apart <= 1)]).collect()}
    want, ruled = {}, {}
    for i, g, s, p in rows[:60]:
        told = []
        for j, h, t, q in rows[:60]:
            if h == g and j != i:
                size, price = s is not None and t is not None and abs(s - t) <= 1, p == q
                told.append((-(40.0 * size + 42.0 * price), j, ";".join(["size"] * size + ["price"] * price)))
                if size:
                    ruled[i] = min(ruled.get(i, (9, 0)), (0 if s == t and price else 1, j))
        told.sort()
        score, tie = -told[0][0], told[1][0] - told[0][0] < 5
        want[i] = (told[0][1], score, told[0][2], len(told), tie, "HIGH" if score >= 80 and not tie else "MEDIUM" if score >= 50 else "LOW")
    assert {i: got[i] for i in want} == want and 100 not in got
    assert {i: first[i] for i in first if i < 60} == {i: (j, ("same", "near")[k]) for i, (k, j) in ruled.items()}
    assert got[1000][0] == 1001 and got[1001][0] == 1000 and got[2500] == (1000, 82.0, "size;price", 2999, True, "MEDIUM") and first[2500] == (1000, "same")
    top = J.best_candidates(a, b, ["g"], "a_id", "b_id", [F.lit(0)], 1)
    assert top.count() == 60 + 3000


def test_bounds_of_quantiles_are_broadcast(spark):
    df = spark.createDataFrame([(i % 3, float(i)) for i in range(99)], "g int, x double")
    out = exact_quantiles(df, ["g"], ["x"], [0.25, 0.5])
    assert "SortMergeJoin" not in plan_of(out)  # which would sort a group's rows in one task
    assert {r.g: r.x for r in out.collect()} == {g: [g + 24.0, g + 48.0] for g in range(3)}


def test_widest_pairs_of_a_group(spark):
    r = random.Random(5)
    rows = [(i, r.choice("gh"), r.choice([1.0, 2.0, 5.0, 9.0]), r.choice([0.0, 1.0])) for i in range(50)] + [(100, "two", 1.0, 0.0), (101, "two", 3.0, 1.0)]
    df = spark.createDataFrame(rows, "id int, g string, v double, s double")
    for apart in (0, 1):
        got = {}
        for x in J.widest_pairs(df, "id", "g", F.abs(F.col("a_s") - F.col("b_s")) >= apart, ["v", "s"], F.abs(F.col("a_v") - F.col("b_v")), 2).collect():
            got.setdefault(x.g, set()).add((x.raw, x.a_id, x.b_id))
        for g in ("g", "h", "two"):
            pairs = sorted((-abs(v - w), i, j) for i, a, v, s in rows for j, b, w, t in rows if a == b == g and i < j and abs(s - t) >= apart)
            assert got[g] == {(-d, i, j) for d, i, j in pairs[:2]}
    assert plan_of(J.pairs_within(df, "id", "g", F.lit(True), ["v"])).count("_slice") > 2


def test_comparables_by_shares(spark):
    r = random.Random(6)
    rows = [(i, r.choice("gh"), r.choice("xy"), r.choice([10.0, 11.0, 12.0, 30.0, 8.0]), r.choice([None, 1.0, 2.0, 4.0])) for i in range(60)] + [(99, "alone", "x", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id int, g string, t string, s double, v double")
    rules = [("strict", ["t"], "s", 0.1), ("same", ["t"], None, 0.0), ("wide", [], "s", 0.2)]
    got = {x.id: tuple(x)[1:] for x in J.banded_comparables(df, "id", "g", rules, "v", 7, relative=True).collect()}
    want = {}
    for i, g, t, s, _ in rows[:60]:
        want[i] = ("NONE", 0, None)
        for name, equal, band, within in rules:
            own = [w for j, h, u, z, w in rows if h == g and j != i and w is not None and (not equal or u == t) and (not band or abs(z / s - 1) <= within)]
            if len(own) >= 7:
                want[i] = (name, len(own), statistics.median(own))
                break
    assert got == want


def test_nearest_value_forms_no_pairs(spark):
    rows = spark.createDataFrame([(1, "a", 2.0), (2, "a", 5.0), (3, "b", 1.0), (4, "c", 1.0)], "id int, g string, v double")
    master = spark.createDataFrame([("a", 1.0, "x"), ("a", 3.0, "y"), ("a", None, "z"), ("b", 9.0, "w")], "g string, v double, t string")
    out = J.nearest_value(rows, master, "g", ["id"], "v", "t")
    assert "min_by" not in plan_of(out)
    assert {r.id: r.t for r in out.collect()} == {1: "x", 2: "y", 3: "w"}
