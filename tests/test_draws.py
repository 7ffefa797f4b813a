"""Draws by MD5 against hashlib, that they are made without an entity's values, and quantiles from counts."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from marlstone.functions.draws import middle_draws
from marlstone.functions.order_statistics import counted_quantiles, exact_quantiles, value_counts
from marlstone.operators import clusters as C
from marlstone.operators import price_models as P


def test_draws_are_those_of_md5():
    r = random.Random(1)
    names = ["", "a", "é한", "x" * 30, "x" * 49, "x" * 80, *(10 ** r.randint(0, 9) for _ in range(20))]
    asked = [(f"7|{r.choice(names)}|".encode(), r.choice([1, 2, 3, 11, 101, 700]), *r.choice([(0, 100), (0, 7), (95, 105), (3, 4)])) for _ in range(60)]
    got = list(middle_draws(asked))
    assert len(got) == len(asked)
    for (text, n, first, last), (low, high) in zip(asked, got, strict=True):
        drawn = [sorted(int(hashlib.md5(text + f"{rep}|{i}".encode()).hexdigest()[:8], 16) % n for i in range(n)) for rep in range(first, last)]
        assert (low.tolist(), high.tolist()) == ([d[(n - 1) // 2] for d in drawn], [d[n // 2] for d in drawn])


def test_medians_are_drawn_without_a_hash_for_each_value(spark):
    rows = [("a", 1, 2.0), ("a", 2, 1.0), (None, 1, 5.0), ("b", 1, None)]
    out = C.resampled_medians(spark.createDataFrame(rows, "id string, n int, v double"), "id", "v", "n", 3, seed=2)
    assert "md5" not in out._jdf.queryExecution().executedPlan().toString().lower()
    got = {(x.id, x.rep): x["median"] for x in out.collect()}
    want = {(None, rep): 5.0 for rep in range(3)}
    for rep in range(3):
        d = [int(hashlib.md5(f"2|a|{rep}|{i}".encode()).hexdigest()[:8], 16) % 2 for i in range(2)]
        want["a", rep] = 1.0 + sum(d) / 2
    assert got == want


@pytest.mark.parametrize("many", [False, True])
def test_quantiles_of_counts(spark, many):
    r = random.Random(3)
    value = lambda: r.choice([None, float("nan"), 1.0, 2.0, r.gauss(0, 1) if many else 3.0])
    df = spark.createDataFrame([(r.choice(["g", "h", None]), value(), value()) for _ in range(300)] + [("one", 1.0, None)], "k string, x double, y double")
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    for keys in (["k"], []):
        want = {tuple(x)[:-2]: (x.x, x.y) for x in exact_quantiles(df, keys, ["x", "y"], shares).collect()}
        got = {tuple(x)[:-2]: (x.x, x.y) for x in counted_quantiles(value_counts(df, keys, ["x", "y"]), keys, ["x", "y"], shares).collect()}
        assert got == want and len(got) == (4 if keys else 1)


def test_pools_take_counts_or_rows(spark):
    r = random.Random(4)
    design = P.Design("y", ("a", "b"), ("c",), "m", "e")
    rows = [(r.choice("mno"), r.randint(1, 9), r.choice([1.0, 2.0, 5.0]), r.randint(1, 4) / 2, r.choice("pq"), r.gauss(0, 1)) for _ in range(200)]
    df = spark.createDataFrame(rows, "m string, e int, a double, b double, c string, y double")
    members = spark.createDataFrame([("one", "m"), ("two", "m"), ("two", "n")], "pool string, m string")
    known = P.market_sums(df, design)
    assert known.values is not None and P.market_sums(df.withColumn("a", F.randn(1)), design).values is None
    plain = P.Sums(known.cells, known.shift, None)
    models = [sorted(map(str, P.pool_models(df, members, design, known=x).collect())) for x in (known, plain)]
    assert models[0] == models[1] and len(models[0]) == 3
    assert P.partial_pooling(df, design, known=known)[0].collect() == P.partial_pooling(df, design, known=plain)[0].collect()
