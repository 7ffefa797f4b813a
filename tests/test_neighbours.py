"""Comparables by bands and nearest members of pools against all pairs; relation kinds; dispersion with missing groups."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from marlstone.functions import texts as X
from marlstone.operators import joins as J
from marlstone.operators import metrics as A


@pytest.mark.parametrize("seed", [1, 2])
def test_banded_comparables(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice(["g", "g", "h", None]), r.choice("xyz"), r.choice([None, *range(12)]), r.choice([None, 1.0, 2.5, 2.5, r.random() * 9])) for i in range(150)]
    rows += [(900, "alone", "x", 1, 5.0)] + [(1000 + i, "same", "x", 3, 4.0) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, g string, t string, s int, v double")
    rules = [("tight", ["t"], "s", 1), ("wide", [], "s", 3), ("exact", ["t"], "s", 0)]
    got = {x.id: (x.rule, x.matches, x.comparable) for x in J.banded_comparables(df, "id", "g", rules, "v", 8).collect()}
    want = {}
    for i, g, t, s, v in rows:
        others = [x for x in rows if x[1] == g and x[0] != i]
        if g is None or not others:
            continue
        want[i] = ("NONE", 0, None)
        for name, equal, _, within in rules:
            own = [x[4] for x in others if x[4] is not None and s is not None and x[3] is not None and abs(x[3] - s) <= within and (not equal or x[2] == t)]
            if len(own) >= 8:
                want[i] = (name, len(own), statistics.median(own))
                break
    assert got.keys() == want.keys()
    assert all(got[i][:2] == want[i][:2] and (got[i][2] == want[i][2] or got[i][2] == pytest.approx(want[i][2])) for i in want)
    assert J.banded_comparables(df.limit(0), "id", "g", rules, "v", 8).count() == 0


@pytest.mark.parametrize("spread", [1.0, 1000.0])
def test_nearest_in_pool(spark, spread):
    r = random.Random(3)
    rows = [(i, r.choice(["p", "q"]), r.gauss(0, 1), r.gauss(0, spread)) for i in range(120)]
    rows += [(200 + i, "p", 1e6, 1e6) for i in range(3)] + [(300 + i, "q", 0.5, 0.5) for i in range(40)]  # far away, and one place
    rows += [(400, "r", 1.0, 1.0), (401, "r", 2.0, 1.0), (402, None, 1.0, 1.0), (403, "p", None, 1.0), (404, "s", 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id int, pool string, x double, y double").repartition(3)
    got = {}
    for x in J.nearest_in_pool(df, "id", "pool", ["x", "y"], 4).collect():
        got.setdefault(x.id, []).append((x.place, x.other, x.distance))
    whole = [x for x in rows if x[1] is not None and x[2] is not None]
    for i, pool, x, y in whole:
        near = sorted((math.sqrt(((x - c) ** 2 + (y - d) ** 2) / 2), j) for j, p, c, d in whole if p == pool and j != i)[:4]
        assert [(a, b) for a, b, _ in sorted(got.get(i, []))] == [(k, j) for k, (_, j) in enumerate(near, 1)], i
    assert set(got) == {x[0] for x in whole} - {404}
    assert J.nearest_in_pool(df.limit(0), "id", "pool", ["x", "y"], 4).count() == 0


def test_names_of_relations(spark):
    names = ["exact", " Guaranteed", "official_eligibility", "ELIGIBLE", "preference", "general_priority", "group_only", "GROUP_MEMBERSHIP", "group", "지정", "학교군 내", "what", None]
    kind = X.relation_type(F.col("t"))
    got = [tuple(r) for r in spark.createDataFrame([(n,) for n in names], "t string").select(kind, X.relation_weight(kind), A.by_kind(kind, A.RELATION_WEIGHTS), A.by_kind(kind, A.RELATION_QUALITY)).collect()]
    kinds = ["EXACT", "EXACT", "ELIGIBLE", "ELIGIBLE", "CONDITIONAL", "CONDITIONAL", "GROUP_MEMBERSHIP", "GROUP_MEMBERSHIP", "GROUP_MEMBERSHIP", "EXACT", "GROUP_MEMBERSHIP", "UNRESOLVED", "UNRESOLVED"]
    assert got == [(k, A.RELATION_WEIGHTS[k], A.RELATION_WEIGHTS[k], A.RELATION_QUALITY[k]) for k in kinds]


def test_dispersion_leaves_out_rows_without_a_group(spark):
    r = random.Random(5)
    rows = [(math.exp(r.gauss(0, 1)), r.choice(["a", "b", None]), r.choice("xyz")) for _ in range(60)]
    got = {x.definition: x for x in A.dispersion(spark.createDataFrame(rows, "v double, g string, h string"), "v", {"G": "g", "H": "h"}).collect()}
    for name, at in (("G", 1), ("H", 2)):
        own = [x for x in rows if x[at] is not None]
        logs = {k: [math.log(x[0]) for x in own if x[at] == k] for k in {x[at] for x in own}}
        left = [y - statistics.mean(v) for v in logs.values() for y in v]
        within = sum(y * y for y in left) / (len(own) - 1)
        assert got[name].within == pytest.approx(within) and got[name].ratio == pytest.approx(within / statistics.variance([math.log(x[0]) for x in own]))
        mids = {k: statistics.median([x[0] for x in own if x[at] == k]) for k in logs}
        assert got[name].mad == pytest.approx(statistics.median([abs(x[0] - mids[x[at]]) for x in own]))


def test_an_archive_gives_what_it_has_added(spark, tmp_path):
    from marlstone.sources import sinks as K

    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y")], "k int, c string").repartition(3)
    path = f"file://{tmp_path}/history"
    assert sorted((r.k, r.c) for r in K.archive(df, "c", path).collect()) == [(1, "x"), (2, "y")]
    more = K.archive(df.unionByName(spark.createDataFrame([(9, "z"), (8, "z")], "k int, c string")), "c", path)
    assert [(r.k, r.c) for r in more.collect()] == [(8, "z")] and spark.read.parquet(path).count() == 3


def test_a_name_that_holds_another(spark):
    got = [r[0] for r in spark.createDataFrame([("abcdefgh", "ab"), ("abcd", "abcd"), ("abcdefgh", "abcdefg")], "a string, b string").select(X.similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(0.925), 1.0, pytest.approx(0.9 + 0.1 * 7 / 8)]
