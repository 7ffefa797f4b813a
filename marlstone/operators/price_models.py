"""Price models of local markets, with pools that a market falls back to.

A model is a ridge regression on robustly scaled numbers and indicator columns. Its normal equations are sums over cells of
(market, categories), so a pool's are the sums of its markets' cells: rows are read once, whatever pools there are, and
systems are solved on cells alone, pool by pool. Rows of `rows` are complete cases; see complete_cases().
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order_statistics import counted_quantiles, exact_quantiles, value_counts
from ..functions.staging import small_side, written

#: The pool of all markets.
EVERYWHERE = "G"
_MODEL = "n long, intercept double, coefs array<double>, effects map<string, double>, sigma double"


@dataclass(frozen=True)
class Design:
    """The columns of a model of `y`: numbers, categories (few values each), and who trades where."""

    y: str
    numbers: tuple[str, ...]
    categories: tuple[str, ...]
    market: str
    entity: str


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def market_cells(rows: DataFrame, design: Design) -> tuple[DataFrame, list[float]]:
    """(sums of products of each cell of market and categories, as g_i_j of 1, the numbers and y; what numbers are shifted by)."""
    names = [*design.numbers, design.y]
    one = rows.agg(*(F.avg(c) for c in names)).first()
    shift = [float(x or 0.0) for x in one]  # sums about the means don't lose digits
    column = [F.lit(1.0), *(F.col(c) - F.lit(s) for c, s in zip(names, shift, strict=True))]
    sums = [F.sum(column[i] * column[j]).alias(f"g_{i}_{j}") for i, j in _pairs(len(column))]
    return written(rows.groupBy(design.market, *design.categories).agg(*sums), "market-cells"), shift


@dataclass(frozen=True)
class Sums:
    """What models of any pools take of the rows of markets, from one look at them."""

    cells: DataFrame  # see market_cells()
    shift: list[float]
    values: DataFrame | None  # value_counts() of the numbers by market, if they are few


def market_sums(rows: DataFrame, design: Design) -> Sums:
    cells, shift = market_cells(rows, design)
    values = written(value_counts(rows, [design.market], design.numbers), "market-values")
    n = cells.agg(F.sum("g_0_0")).first()[0] or 0.0
    return Sums(cells, shift, values if values.count() * 4 <= n * len(design.numbers) else None)


def _gram(cells: Sequence[dict], design: Design, levels: list[list[str]]) -> np.ndarray:
    """Sums of products of 1, the numbers, an indicator of each level, and y, over cells."""
    q = len(design.numbers) + 1
    at, k = {}, q
    for c, own in zip(design.categories, levels, strict=True):
        for x in own:
            at[c, x], k = k, k + 1
    g = np.zeros((k + 1, k + 1))
    base = [*range(q), k]
    for cell in cells:
        own = np.zeros((q + 1, q + 1))
        for i, j in _pairs(q + 1):
            own[i, j] = own[j, i] = cell[f"g_{i}_{j}"]
        g[np.ix_(base, base)] += own
        on = [at[c, cell[c]] for c in design.categories if (c, cell[c]) in at]
        for a in on:
            g[a, base] += own[0]
            g[base, a] += own[0]
            for b in on:
                g[a, b] += own[0, 0]
    return g


def _ridge(g: np.ndarray, scale: np.ndarray, alpha: float, n: float) -> tuple[np.ndarray, float, float]:
    """(coefficients, intercept, squares left) from sums of products of 1, the columns and y; columns are divided by `scale`."""
    mean = g[0, 1:] / n
    c = g[1:, 1:] - n * np.outer(mean, mean)
    inner = c[:-1, :-1] / np.outer(scale, scale)
    coef = np.linalg.solve(inner + alpha * np.eye(len(scale)), c[:-1, -1] / scale) / scale
    left = c[-1, -1] - 2 * coef @ c[:-1, -1] + coef @ c[:-1, :-1] @ coef
    return coef, float(mean[-1] - coef @ mean[:-1]), max(0.0, float(left))


def _unshifted(coef: np.ndarray, intercept: float, shift: Sequence[float]) -> float:
    q = len(shift) - 1
    return intercept + shift[-1] - float(np.dot(coef[:q], shift[:q]))


def pool_models(rows: DataFrame, members: DataFrame, design: Design, alpha: float = 1.0, known: Sums | None = None) -> DataFrame:
    """(pool, entities, n, intercept, coefs, effects, sigma): a model for each pool of `members` (pool, market), and for EVERYWHERE.

    Numbers are divided by the interquartile range within the pool (1 if that is 0), each category has an indicator for all
    of its values in the pool but the first, the penalty is alpha times the sum of squared coefficients, and the intercept
    has none. coefs are those of the numbers as they are; effects those of `category=value`. sigma is the residuals'
    standard deviation. Null categories are no value. Pools without rows have no model. `known` are the rows' market_sums().
    """
    known = known or market_sums(rows, design)
    markets = rows.select(design.market).distinct()
    everywhere = markets.select(F.lit(EVERYWHERE).alias("pool"), F.col(design.market).alias("_m"))
    told = written(members.select("pool", F.col(design.market).alias("_m")).where(F.col("pool") != EVERYWHERE).unionByName(everywhere).distinct(), "pool-members")
    inside = small_side(told, 64)
    cells, shift = known.cells, known.shift
    own = F.col(design.market) == F.col("_m")
    q = len(design.numbers)
    sums = [f"g_{i}_{j}" for i, j in _pairs(q + 2)]
    per_cell = cells.join(inside, own).groupBy("pool", *design.categories).agg(*(F.sum(c).alias(c) for c in sums))
    # a pool's cells: as many as there are combinations of categories
    per = per_cell.groupBy("pool").agg(F.collect_list(F.struct(*(F.col(c).cast("string").alias(c) for c in design.categories), *sums)).alias("cells"))
    # a pool's values are its markets'; rows meet their pools only where values hardly repeat
    if known.values is not None:
        quartiles = counted_quantiles(known.values.join(inside, own).select("pool", "_c", "_x", "_n"), ["pool"], design.numbers, [0.25, 0.75])
    else:
        quartiles = exact_quantiles(rows.select(design.market, *design.numbers).join(inside, own), ["pool"], design.numbers, [0.25, 0.75])
    spread = quartiles.select(F.col("pool").alias("_p"), F.array(*(F.get(c, F.lit(1)) - F.get(c, F.lit(0)) for c in design.numbers)).alias("spread"))
    traded = rows.select(design.market, design.entity).distinct().join(inside, own)
    who = traded.select("pool", design.entity).distinct().groupBy(F.col("pool").alias("_e")).agg(F.count(design.entity).alias("entities"))
    ready = per.join(spread, F.col("pool") == F.col("_p")).join(who, F.col("pool") == F.col("_e")).select("pool", "entities", "cells", "spread")

    def solve(batches):
        for pdf in batches:
            out = []
            for pool, entities, cell, wide in zip(pdf["pool"], pdf["entities"], pdf["cells"], pdf["spread"], strict=True):
                cell = [dict(x) for x in cell]
                levels = [sorted({x[c] for x in cell if x[c] is not None})[1:] for c in design.categories]
                g = _gram(cell, design, levels)
                n = g[0, 0]
                wide = np.array([x if x else 1.0 for x in wide], float)
                coef, intercept, left = _ridge(g, np.concatenate([wide, np.ones(sum(map(len, levels)))]), alpha, n)
                names = [f"{c}={x}" for c, some in zip(design.categories, levels, strict=True) for x in some]
                effects = dict(zip(names, coef[q:].tolist(), strict=True))
                out.append((pool, int(entities), round(n), _unshifted(coef, intercept, shift), coef[:q].tolist(), effects, float(np.sqrt(left / max(n - 1, 1)))))
            yield pd.DataFrame(out, columns=["pool", "entities", "n", "intercept", "coefs", "effects", "sigma"])

    return written(ready.mapInPandas(solve, f"pool string, entities long, {_MODEL}"), "pool-models")


def partial_pooling(rows: DataFrame, design: Design, alpha: float = 1.0, known: Sums | None = None) -> tuple[DataFrame, DataFrame]:
    """(one model as pool_models() gives it, for EVERYWHERE; (market, effect) of each market): a ridge with markets as indicators.

    The first market has no indicator. The others are eliminated market by market: an indicator's coefficient is the sum of
    its market's residuals over its rows plus alpha, so each market adds its sums of products less what that explains, and
    only a system of the other columns is solved. `known` are the rows' market_sums().
    """
    spark, known = rows.sparkSession, known or market_sums(rows, design)
    cells, shift = known.cells, known.shift
    q = len(design.numbers)
    sums = [f"g_{i}_{j}" for i, j in _pairs(q + 2)]
    found = cells.select(*(F.collect_set(F.col(c).cast("string")).alias(c) for c in design.categories)).first()  # few values each
    levels = [sorted(found[c])[1:] for c in design.categories]
    first = cells.agg(F.min(design.market)).first()[0]
    per = cells.groupBy(design.market).agg(F.collect_list(F.struct(*(F.col(c).cast("string").alias(c) for c in design.categories), *sums)).alias("cells"))
    whole = exact_quantiles(rows, [], design.numbers, [0.25, 0.75]) if known.values is None else counted_quantiles(known.values.select("_c", "_x", "_n"), [], design.numbers, [0.25, 0.75])
    quartiles = whole.first()
    scale = np.array([(quartiles[c][1] - quartiles[c][0]) or 1.0 for c in design.numbers] + [1.0] * sum(map(len, levels)))
    k = q + 2 + sum(map(len, levels))
    kind = dict(rows.dtypes)[design.market]

    def reduced(batches):
        total, n = np.zeros((k, k)), 0.0
        for pdf in batches:
            for market, cell in zip(pdf[design.market], pdf["cells"], strict=True):
                g = _gram([dict(x) for x in cell], design, levels)
                n += g[0, 0]
                total += g if market == first else g - np.outer(g[0], g[0]) / (g[0, 0] + alpha)
        yield pd.DataFrame({"at": np.arange(k * k), "x": total.ravel()})

    # each task sends one matrix
    row = per.mapInPandas(reduced, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas()
    g = np.zeros(k * k)
    g[row["at"]] = row["x"]
    g = g.reshape(k, k)
    wide = np.concatenate([[1.0], scale])
    inner = g[:-1, :-1] / np.outer(wide, wide)
    penalty = alpha * np.eye(k - 1)
    penalty[0, 0] = 0.0
    theta = np.linalg.solve(inner + penalty, g[:-1, -1] / wide) / wide
    full = np.append(theta, -1.0)

    def effects(batches):
        for pdf in batches:
            out = []
            for market, cell in zip(pdf[design.market], pdf["cells"], strict=True):
                own = _gram([dict(x) for x in cell], design, levels)
                n, total = own[0, 0], -float(own[0] @ full)
                effect = 0.0 if market == first else total / (n + alpha)
                out.append((market, effect, float(full @ own @ full) - 2 * effect * total + n * effect**2, round(n)))
            yield pd.DataFrame(out, columns=[design.market, "effect", "left", "n"])

    each = written(per.mapInPandas(effects, f"`{design.market}` {kind}, effect double, left double, n long"), "market-effects")
    whole = each.agg(F.sum("n").alias("n"), F.sum("left").alias("left")).first()
    names = [f"{c}={x}" for c, some in zip(design.categories, levels, strict=True) for x in some]
    who = rows.select(F.count_distinct(design.entity)).first()[0]
    sigma = float(np.sqrt(max(whole.left or 0.0, 0.0) / max((whole.n or 0) - 1, 1)))
    one = (EVERYWHERE, who, whole.n, _unshifted(theta[1:], float(theta[0]), shift), theta[1 : q + 1].tolist(), dict(zip(names, theta[q + 1 :].tolist(), strict=True)), sigma)
    return spark.createDataFrame([one], f"pool string, entities long, {_MODEL}"), each.select(design.market, "effect")


def market_pools(markets: DataFrame, market: str, district: str, entities: str, deals: str, profile: Sequence[str], lat: str, lon: str, least_entities: int = 5, least_deals: int = 100, alike: float = 1.5, reach_km: float = 10.0, alike_near: float = 2.0) -> DataFrame:
    """(market, district, level, reason, pool, pool_entities, pool_deals, sufficient): the narrowest pool of each market.

    0: the market alone has enough entities and deals. 1: it and the most similar markets of its district, no further than
    `alike`, as few as suffice. 2: its district. 3: markets within reach and `alike_near`, if they have enough deals. 4: all;
    there `pool` is null. Profiles differ by the root mean square of their values over interquartile ranges; missing values
    count as the median. `markets` has a row for each market; ties of similarity go by the market.
    """
    m = markets.select(F.col(market).alias("_m"), F.col(district).alias("_d"), F.coalesce(entities, F.lit(0)).alias("_e"), F.coalesce(deals, F.lit(0)).alias("_r"), F.col(lat).alias("_lat"), F.col(lon).alias("_lon"), *(F.col(c).cast("double").alias(f"_z{i}") for i, c in enumerate(profile)))
    names = [f"_z{i}" for i in range(len(profile))]
    q = exact_quantiles(m, [], names, [0.25, 0.5, 0.75]).select(*(F.col(c).alias(f"_q{c}") for c in names))
    scaled = {c: (F.coalesce(F.col(c), F.get(f"_q{c}", F.lit(1))) - F.get(f"_q{c}", F.lit(1))) / F.coalesce(F.nullif(F.get(f"_q{c}", F.lit(2)) - F.get(f"_q{c}", F.lit(0)), F.lit(0.0)), F.lit(1.0)) for c in names}
    m = m.crossJoin(F.broadcast(q)).withColumns({c: F.coalesce(x, F.lit(0.0)) for c, x in scaled.items()}).drop(*(f"_q{c}" for c in names))  # one row
    m = written(m.withColumn("_ok", (F.col("_e") >= least_entities) & (F.col("_r") >= least_deals)), "pool-markets")
    a, b = (m.select(*(F.col(c).alias(f"{s}{c}") for c in m.columns)) for s in "ab")
    apart = F.sqrt(reduce(Column.__add__, ((F.col(f"a{c}") - F.col(f"b{c}")) ** 2 for c in names)) / len(names)) if names else F.lit(0.0)

    # 1: neighbours of the district by similarity, each with the sums up to it
    other = a.where(~F.col("a_ok")).join(b, (F.col("a_d") == F.col("b_d")) & (F.col("a_m") != F.col("b_m"))).withColumn("_apart", apart).where(F.col("_apart") <= alike)
    upto = Window.partitionBy("a_m").orderBy("_apart", "b_m").rowsBetween(Window.unboundedPreceding, 0)
    other = other.withColumns({"_se": F.col("a_e") + F.sum("b_e").over(upto), "_sr": F.col("a_r") + F.sum("b_r").over(upto), "_place": F.count("*").over(upto)})
    other = written(other.select("a_m", "b_m", "_se", "_sr", "_place"), "pool-similar")
    enough = (F.col("_se") >= least_entities) & (F.col("_sr") >= least_deals)
    stop = other.where(enough).groupBy("a_m").agg(F.min("_place").alias("_stop"))
    similar = other.join(stop, "a_m").where(F.col("_place") <= F.col("_stop")).groupBy("a_m").agg(F.collect_list("b_m").alias("_some"), F.max("_se").alias("_e1"), F.max("_sr").alias("_r1"))
    # 2: the district
    whole = m.groupBy(F.col("_d").alias("_of")).agg(F.sum("_e").alias("_e2"), F.sum("_r").alias("_r2"), F.array_sort(F.collect_list("_m")).alias("_p2"))
    met = m.join(similar, F.col("_m") == F.col("a_m"), "left").join(whole, F.col("_d") == F.col("_of"), "left")
    of_district = (F.col("_e2") >= least_entities) & (F.col("_r2") >= least_deals)
    level = F.when(F.col("_ok"), 0).when(F.col("_some").isNotNull(), 1).when(of_district, 2)
    met = written(met.withColumn("_level", level), "pool-levels")
    # 3: only what is left looks about; markets meet in bands of latitude as wide as the reach
    band = lambda s: F.floor(F.col(f"{s}_lat") * 111.0 / reach_km)
    left = a.join(met.where("_level is null").select(F.col("_m").alias("a_m")), "a_m").withColumn("_band", F.explode(F.array(band("a") - 1, band("a"), band("a") + 1)))
    km = 111.0 * F.sqrt((F.col("b_lat") - F.col("a_lat")) ** 2 + ((F.col("b_lon") - F.col("a_lon")) * F.cos(F.radians("a_lat"))) ** 2)
    near = left.join(b.withColumn("_band", band("b")), "_band").where((km <= reach_km) & (apart <= alike_near))
    near = near.groupBy(F.col("a_m").alias("_n")).agg(F.sum("b_e").alias("_e3"), F.sum("b_r").alias("_r3"), F.array_sort(F.collect_list("b_m")).alias("_p3"))
    total = m.agg(F.sum("_e").alias("_e4"), F.sum("_r").alias("_r4"))
    out = met.join(near, F.col("_m") == F.col("_n"), "left").crossJoin(F.broadcast(total))  # one row
    out = out.withColumn("_level", F.coalesce("_level", F.when(F.col("_r3") >= least_deals, 3).otherwise(4)))
    at = lambda *of: F.element_at(F.array(*of), F.col("_level") + 1)
    none = F.lit(None).cast(f"array<{dict(m.dtypes)['_m']}>")
    pool = at(F.array("_m"), F.array_sort(F.concat(F.array("_m"), F.coalesce("_some", none))), F.col("_p2"), F.col("_p3"), none)
    reason = at(*map(F.lit, ("SAME_MARKET_SUFFICIENT", "SAME_DISTRICT_SIMILAR_PROFILE", "SAME_DISTRICT", "ADJACENT_COMPATIBLE_MARKET", "GLOBAL")))
    sums = [at(F.col(f"_{c}"), *(F.col(f"_{c}{i}") for i in (1, 2, 3, 4))).alias(name) for c, name in (("e", "pool_entities"), ("r", "pool_deals"))]
    return out.select(F.col("_m").alias(market), F.col("_d").alias(district), F.col("_level").alias("level"), reason.alias("reason"), pool.alias("pool"), *sums, F.col("_ok").alias("sufficient"))


def pool_names(pools: DataFrame, market: str, district: str) -> DataFrame:
    """(market, mode, pool): the pool that each mode takes for a market; null where there is none.

    G all markets; L the market itself, if it is sufficient; F1 its district; F2 the pool of market_pools(). Pools of the
    same markets have one name.
    """
    own, whole = F.concat(F.lit("L|"), F.col(market).cast("string")), F.concat(F.lit("F1|"), F.col(district).cast("string"))
    f2 = F.when(F.col("level") == 0, own).when(F.col("level") == 2, whole).when(F.col("level") == 4, EVERYWHERE).otherwise(F.concat(F.lit("F2|"), F.col(market).cast("string")))
    modes = [("G", F.lit(EVERYWHERE)), ("L", F.when(F.col("sufficient"), own)), ("F1", whole), ("F2", f2)]
    named = F.explode(F.array(*(F.struct(F.lit(mode).alias("mode"), name.alias("pool")) for mode, name in modes)))
    return pools.select(market, named.alias("_x")).select(market, "_x.mode", "_x.pool")


def pool_members(pools: DataFrame, market: str, district: str) -> DataFrame:
    """(pool, market) of the pools that pool_names() names, but for EVERYWHERE."""
    own = pools.where("sufficient").select(F.concat(F.lit("L|"), F.col(market).cast("string")).alias("pool"), market)
    whole = pools.select(F.concat(F.lit("F1|"), F.col(district).cast("string")).alias("pool"), market)
    some = pools.where("level in (1, 3)").select(F.concat(F.lit("F2|"), F.col(market).cast("string")).alias("pool"), F.explode("pool").alias(market))
    return own.unionByName(whole).unionByName(some)


def models_by_mode(rows: DataFrame, pools: DataFrame, design: Design, district: str, alpha: float = 1.0, least_rows: int = 30, least_entities: int = 2) -> DataFrame:
    """(market, mode, basis, n, entities, intercept, coefs, effects, sigma) for the modes G, L, F1, F2, F3 of each market.

    A pool of fewer than `least_rows` rows or `least_entities` entities, or none, gives the model of all markets and the
    basis GLOBAL_FALLBACK. F3 is partial_pooling(), with a market's effect in its intercept.
    """
    known = market_sums(rows, design)
    models = pool_models(rows, pool_members(pools, design.market, district), design, alpha, known)
    named = pool_names(pools, design.market, district).withColumnRenamed("pool", "_pool")
    good = models.where((F.col("n") >= least_rows) & (F.col("entities") >= least_entities)).withColumnRenamed("pool", "_p")
    joined = named.join(good, F.col("_pool") == F.col("_p"), "left")
    columns = ["n", "entities", "intercept", "coefs", "effects", "sigma"]
    one = models.where(F.col("pool") == EVERYWHERE).select(*(F.col(c).alias(f"_g_{c}") for c in columns))
    joined = joined.crossJoin(F.broadcast(one))  # one row
    fitted = F.col("_p").isNotNull()
    basis = F.when(fitted | (F.col("mode") == "G"), F.col("mode")).otherwise("GLOBAL_FALLBACK")
    local = joined.select(design.market, "mode", basis.alias("basis"), *(F.when(fitted, F.col(c)).otherwise(F.col(f"_g_{c}")).alias(c) for c in columns))
    model, effects = partial_pooling(rows, design, alpha, known)
    shared = pools.select(design.market).join(effects, design.market, "left").crossJoin(F.broadcast(model.drop("pool")))  # one row
    shared = shared.withColumn("intercept", F.col("intercept") + F.coalesce("effect", F.lit(0.0)))
    return written(local.unionByName(shared.select(design.market, F.lit("F3").alias("mode"), F.lit("F3").alias("basis"), *columns)), "mode-models")


def predicted(design: Design) -> Column:
    """The prediction of rows that carry a model's columns; a category value that the model doesn't know adds nothing."""
    out = F.col("intercept")
    for i, c in enumerate(design.numbers):
        out = out + F.get("coefs", F.lit(i)) * F.col(c)
    for c in design.categories:
        out = out + F.coalesce(F.element_at("effects", F.concat(F.lit(f"{c}="), F.col(c).cast("string"))), F.lit(0.0))
    return out


def with_operational(models: DataFrame, pools: DataFrame, market: str, candidates: Sequence[str] = ("F1", "F2", "F3")) -> DataFrame:
    """models, with O_ modes: a sufficient market's own model, else that of the candidate."""
    ok = pools.select(F.col(market).alias("_m"), "sufficient")
    with_ok = models.join(ok, F.col(market) == F.col("_m")).drop("_m")
    takes = F.when(F.col("mode") == "L", F.when(F.col("sufficient"), F.array(*(F.lit(f"O_{c}") for c in candidates)))).when(F.col("mode").isin(*candidates) & ~F.col("sufficient"), F.array(F.concat(F.lit("O_"), F.col("mode"))))
    more = with_ok.withColumn("_as", F.explode(takes)).withColumn("mode", F.col("_as")).drop("_as", "sufficient")
    return models.unionByName(more)


def performance(scored: DataFrame, y: str, p: str, entity: str, market: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, entities, rmse, mae, mape, r2, entity_rmse, market_rmse, slope, intercept) of predicted logarithms.

    entity_rmse and market_rmse count each entity, or market, the same. One aggregate by (keys, market, entity), from
    whose sums all else follows.
    """
    keys = list(keys)
    e, a, b = F.col(y) - F.col(p), F.col(y), F.col(p)
    sums = {"_n": F.count("*"), "_se": F.sum(e * e), "_ae": F.sum(F.abs(e)), "_pe": F.sum(F.abs(F.exp(b - a) - 1)), "_ma": F.avg(a), "_mb": F.avg(b), "_caa": F.var_pop(a) * F.count("*"), "_cbb": F.var_pop(b) * F.count("*"), "_cab": F.covar_pop(a, b) * F.count("*")}
    per = written(scored.groupBy(*keys, market, entity).agg(*(c.alias(k) for k, c in sums.items())), "performance")
    n, mean = F.sum("_n"), lambda c: F.sum(F.col(c) * F.col("_n")) / F.sum("_n")
    about = lambda s, x, z: F.sum(s) + F.sum(F.col("_n") * F.col(x) * F.col(z)) - mean(x) * mean(z) * n
    whole = per.groupBy(*keys).agg(
        n.alias("n"), F.count_distinct(entity).alias("entities"), F.sqrt(F.sum("_se") / n).alias("rmse"), (F.sum("_ae") / n).alias("mae"), (F.sum("_pe") / n).alias("mape"),
        (1 - F.sum("_se") / F.nullif(about("_caa", "_ma", "_ma"), F.lit(0.0))).alias("r2"), (about("_cab", "_ma", "_mb") / F.nullif(about("_cbb", "_mb", "_mb"), F.lit(0.0))).alias("slope"), mean("_ma").alias("_ya"), mean("_mb").alias("_yb"),
    )
    even = [per.groupBy(*keys, k).agg((F.sum("_se") / F.sum("_n")).alias("_s")).groupBy(*keys).agg(F.sqrt(F.avg("_s")).alias(name)) for k, name in ((entity, "entity_rmse"), (market, "market_rmse"))]
    for more in even:
        whole = whole.join(more, keys) if keys else whole.crossJoin(F.broadcast(more))  # one row
    return whole.withColumn("intercept", F.col("_ya") - F.col("slope") * F.col("_yb")).drop("_ya", "_yb")


def chosen_fallback(results: DataFrame, gain: float = 0.01) -> str:
    """The candidate of `results` (mode, rmse, mae; a row each of F1, F2, F3) that is worth its complexity."""
    at = {r.mode: (r.rmse, r.mae) for r in results.collect()}  # three rows
    best = "F1"
    for c in ("F2", "F3"):
        if c in at and best in at and at[c][0] <= at[best][0] * (1 - gain) and at[c][1] < at[best][1]:
            best = c
    return best
