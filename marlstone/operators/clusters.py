"""Clusters of entities and how far they can be trusted: scaling, choice of k, alignment, resampling, names, markets.

Clusters of many replicates (starts, windows, resamples) are found in one job: a step of Lloyd's method is one aggregate over
(replicate, cluster). Only centres, replicates times clusters in number, come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import middle_draws
from ..functions.order_statistics import exact_quantiles
from ..functions.staging import small_side, written


def fitted_scale(df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99) -> dict[str, tuple[float, float, float, float]]:
    """(lower, upper, median, interquartile range) of each column: bounds from quantiles, the others of the values within."""
    bounds = exact_quantiles(df, [], columns, [low, high]).first()
    if bounds is None:
        return {c: (0.0, 0.0, 0.0, 1.0) for c in columns}
    inside = df.select(*(F.least(F.greatest(F.col(c), F.lit(bounds[c][0])), F.lit(bounds[c][1])).alias(c) for c in columns if bounds[c]))
    q = exact_quantiles(inside, [], [c for c in columns if bounds[c]], [0.25, 0.5, 0.75]).first()
    return {c: (*bounds[c], q[c][1], (q[c][2] - q[c][0]) or 1.0) if bounds[c] else (0.0, 0.0, 0.0, 1.0) for c in columns}


def scaled(df: DataFrame, fitted: Mapping[str, tuple[float, float, float, float]], groups: Sequence[Sequence[str]] = ()) -> DataFrame:
    """df with its columns clipped and scaled as they were fitted; those of a group of n weigh 1 / sqrt(n). Nulls stay null."""
    size = {c: len([x for x in group if x in fitted]) for group in groups for c in group}

    def one(c: str) -> Column:
        lower, upper, mid, wide = fitted[c]
        clipped = F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c).cast("double"), F.lit(lower)), F.lit(upper)))
        return (clipped - F.lit(mid)) / F.lit(wide) / F.lit(math.sqrt(size.get(c, 1)))

    return df.withColumns({c: one(c) for c in fitted})


def starting_centres(points: DataFrame, ident: str, columns: Sequence[str], ks: Sequence[int]) -> DataFrame:
    """(rep, k, cluster, columns): for each k and each order (by a column, or by their sum), k points spread over the order.

    They are the points nearest to the quantiles (2i + 1) / 2k, ties by ident; rep is `k:order`.
    """
    orders = {**{c: F.col(c) for c in columns}, "sum": sum((F.col(c) for c in columns[1:]), F.col(columns[0]))}
    shares = sorted({(2 * i + 1) / (2 * k) for k in ks for i in range(k)})
    by = points.select(ident, *columns, *(value.alias(f"_v_{name}") for name, value in orders.items()))
    at = exact_quantiles(by, [], [f"_v_{name}" for name in orders], shares).first()
    asked = [(name, k, i, at[f"_v_{name}"][shares.index((2 * i + 1) / (2 * k))]) for name in orders for k in ks for i in range(k)] if at else []
    near = [F.min_by(F.struct(*columns), F.struct(F.round(F.abs(F.col(f"_v_{name}") - F.lit(q)), 9), ident)).alias(f"c{n}") for n, (name, _, _, q) in enumerate(asked)]
    row = by.agg(*near).first() if near else ()
    made = [(f"{k}:{name}", k, i, *(float(x) for x in row[n])) for n, (name, k, i, _) in enumerate(asked)]
    return points.sparkSession.createDataFrame(made, "rep string, k int, cluster int, " + ", ".join(f"`{c}` double" for c in columns))


def _nearest(columns: Sequence[str]) -> Column:
    """The (square, cluster) of the nearest of `_centres`; ties go to the lower cluster."""
    square = lambda c: sum(((F.col(x) - c[x]) ** 2 for x in columns[1:]), (F.col(columns[0]) - c[columns[0]]) ** 2)
    return F.array_min(F.transform("_centres", lambda c: F.struct(square(c).alias("square"), c["cluster"].alias("cluster"))))


def lloyd(points: DataFrame, centres: DataFrame, columns: Sequence[str], rounds: int = 15, still: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """((points' columns, cluster, square), (rep, cluster, columns, members)) after at most `rounds` steps from `centres`.

    points (rep, ident, columns) is read once a step; each replicate goes its own way. A cluster that has lost all its points
    keeps its centre. Steps end when no coordinate moves by more than `still`. square is the squared distance to the centre.
    """
    spark, kind = points.sparkSession, {x.split()[0]: x.split()[1] for x in (f"{c} {t}" for c, t in centres.dtypes)}
    names = ["rep", "cluster", *columns]
    now = {(r.rep, r.cluster): [float(r[c]) for c in columns] for r in centres.select(*names).collect()}  # replicates times clusters
    schema = f"rep {kind['rep']}, cluster int, " + ", ".join(f"`{c}` double" for c in columns)

    def labelled() -> DataFrame:
        table = spark.createDataFrame([(rep, cluster, *x) for (rep, cluster), x in now.items()], schema)
        packed = table.groupBy(F.col("rep").alias("_rep")).agg(F.collect_list(F.struct("cluster", *columns)).alias("_centres"))
        near = points.join(F.broadcast(packed), F.col("rep") == F.col("_rep")).withColumn("_near", _nearest(columns))
        return near.select(*points.columns, F.col("_near.cluster").alias("cluster"), F.col("_near.square").alias("square"))

    for _ in range(rounds):
        moved, new = 0.0, dict(now)
        for r in labelled().groupBy("rep", "cluster").agg(*(F.avg(c).alias(c) for c in columns)).collect():  # as many rows as centres
            new[r.rep, r.cluster] = [float(r[c]) for c in columns]
            moved = max(moved, *(abs(a - b) for a, b in zip(new[r.rep, r.cluster], now[r.rep, r.cluster], strict=True)))
        now = new
        if moved <= still:
            break
    found = written(labelled(), "clusters")
    members = found.groupBy("rep", "cluster").agg(F.count("*").alias("members"))
    last = spark.createDataFrame([(rep, cluster, *x) for (rep, cluster), x in now.items()], schema)
    return found, last.join(members, ["rep", "cluster"], "left").fillna({"members": 0})


def best_starts(labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, rep) of the replicate of each key with the least sum of squares; ties to the first by name."""
    per = labels.groupBy(*keys, "rep").agg(F.round(F.sum("square"), 9).alias("_s"))
    return per.groupBy(*keys).agg(F.min_by("rep", F.struct("_s", "rep")).alias("rep"))


def cluster_quality(labels: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(rep, k, silhouette, calinski_harabasz, davies_bouldin, least, most) of each replicate of lloyd()'s labels.

    Silhouettes are of squared distances, which follow from each cluster's means and squares: no pairs of points are formed.
    Points of a cluster of one have 0.
    """
    norm = sum((F.col(c) ** 2 for c in columns[1:]), F.col(columns[0]) ** 2)
    per = labels.groupBy("rep", "cluster").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in columns), F.avg(norm).alias("q"), F.avg(F.sqrt("square")).alias("s"), F.sum("square").alias("ss"))
    per = written(per, "cluster-sums")
    packed = per.groupBy(F.col("rep").alias("_rep")).agg(F.collect_list(F.struct("cluster", "n", "q", "s", "ss", *columns)).alias("_all"))  # a row a cluster
    packed = small_side(written(packed, "cluster-tables"), 64 * 32)
    # mean squared distance of a point to a cluster: |x|^2 - 2 x.mean + mean |y|^2
    away = lambda c: norm - 2 * sum((F.col(x) * c[x] for x in columns[1:]), F.col(columns[0]) * c[columns[0]]) + c["q"]
    met = labels.join(packed, F.col("rep") == F.col("_rep"))
    own = F.filter("_all", lambda c: c["cluster"] == F.col("cluster"))[0]
    inside = away(own) * own["n"] / F.nullif(own["n"] - 1, F.lit(0))
    outside = F.array_min(F.transform(F.filter("_all", lambda c: c["cluster"] != F.col("cluster")), away))
    point = F.when(own["n"] > 1, F.coalesce((outside - inside) / F.nullif(F.greatest(inside, outside), F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    silhouette = met.select("rep", point.alias("p")).groupBy("rep").agg(F.avg("p").alias("silhouette"))
    n, mean = F.sum("n"), lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    between = sum((F.sum(F.col("n") * F.col(c) ** 2) - F.sum("n") * mean(c) ** 2 for c in columns[1:]), F.sum(F.col("n") * F.col(columns[0]) ** 2) - F.sum("n") * mean(columns[0]) ** 2)
    k = F.count("*")
    whole = per.groupBy("rep").agg(k.alias("k"), (between / F.nullif(k - 1, F.lit(0)) / F.nullif(F.sum("ss") / F.nullif(n - k, F.lit(0)), F.lit(0.0))).alias("calinski_harabasz"), F.min("n").alias("least"), F.max("n").alias("most"))
    a, b = (per.select("rep", *(F.col(c).alias(f"{s}_{c}") for c in ("cluster", "s", *columns))) for s in "ab")
    apart = F.sqrt(sum(((F.col(f"a_{c}") - F.col(f"b_{c}")) ** 2 for c in columns[1:]), (F.col(f"a_{columns[0]}") - F.col(f"b_{columns[0]}")) ** 2))
    worst = a.join(b, "rep").where("a_cluster <> b_cluster").groupBy("rep", "a_cluster").agg(F.max((F.col("a_s") + F.col("b_s")) / F.nullif(apart, F.lit(0.0))).alias("w"))  # clusters of a replicate
    return whole.join(silhouette, "rep").join(worst.groupBy("rep").agg(F.avg("w").alias("davies_bouldin")), "rep", "left")


def rank_sum_choice(quality: DataFrame, higher: Sequence[str], lower: Sequence[str], allowed: Column, ties: str = "k") -> DataFrame:
    """quality with rank_score, the sum of mean ranks of the allowed rows (lower is better; null for others), and chosen."""
    table = quality.withColumn("_ok", F.coalesce(allowed, F.lit(False)))  # a row for each k
    score = F.lit(0.0)
    for c, down in [*((c, True) for c in higher), *((c, False) for c in lower)]:
        value = F.round(F.col(c), 9)
        better = F.count_if(F.col("_ok")).over(Window.partitionBy("_ok").orderBy(value.desc_nulls_last() if down else value.asc_nulls_last()).rangeBetween(Window.unboundedPreceding, 0))
        same = F.count("*").over(Window.partitionBy("_ok", value))
        score = score + better - (same - 1) / F.lit(2.0)
    table = table.withColumn("rank_score", F.when(F.col("_ok"), score))
    first = F.row_number().over(Window.partitionBy("_ok").orderBy("rank_score", ties)) == 1
    return table.withColumn("chosen", F.col("_ok") & first).drop("_ok")


def best_assignment(counts: np.ndarray) -> list[int]:
    """The row for each column of a square table so that the sum of the chosen counts is largest; near-ties keep i for i.

    Shortest augmenting paths with potentials, a column at a time.
    """
    n = len(counts)
    cost = -(counts.astype(float) * (n + 1) + np.eye(n))
    u, v, row_of = np.zeros(n + 1), np.zeros(n + 1), np.full(n + 1, -1)  # entry n stands for the column being placed
    for c in range(n):
        row_of[n], here = c, n
        least, way, seen = np.full(n, np.inf), np.full(n, n), np.zeros(n + 1, bool)
        while row_of[here] >= 0:
            seen[here] = True
            slack = cost[:, row_of[here]] - u[row_of[here]] - v[:n]
            better = ~seen[:n] & (slack < least)
            least[better], way[better] = slack[better], here
            step_to = int(np.argmin(np.where(seen[:n], np.inf, least)))
            step = least[step_to]
            u[row_of[seen]] += step
            v[seen] -= step
            least[~seen[:n]] -= step
            here = step_to
        while here != n:
            row_of[here] = row_of[way[here]]
            here = way[here]
    out = [0] * n
    for r in range(n):
        out[int(row_of[r])] = r
    return out


def aligned_labels(labels: DataFrame, reference: DataFrame, ident: str) -> DataFrame:
    """labels (rep, ident, cluster) with `aligned`: clusters renamed to those of `reference` (ident, base) they agree with most.

    The optimal assignment is made on each replicate's contingency table, which is all that a task holds of it. Entities
    without a base label are named alike, but don't count.
    """
    both = labels.join(reference.select(F.col(ident).alias("_id"), "base"), F.col(ident) == F.col("_id"))
    tables = both.groupBy("rep", "base", "cluster").agg(F.count("*").alias("n"))
    kind = dict(labels.dtypes)["rep"]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(max(pdf["base"].max(), pdf["cluster"].max())) + 1
        counts = np.zeros((k, k))
        counts[pdf["base"].astype(int), pdf["cluster"].astype(int)] = pdf["n"]
        return pd.DataFrame({"_rep": pdf["rep"].iloc[0], "_from": np.arange(k), "aligned": best_assignment(counts)})

    names = tables.groupBy("rep").applyInPandas(solve, f"_rep {kind}, _from int, aligned int")  # k * k rows of a replicate
    names = small_side(written(names, "aligned"), 32)
    return labels.join(names, (F.col("rep") == F.col("_rep")) & (F.col("cluster") == F.col("_from")), "left").drop("_rep", "_from").withColumn("aligned", F.coalesce("aligned", "cluster"))


def resampled_medians(rows: DataFrame, ident: str, value: str, ties: str, replicates: int, seed: int = 0) -> DataFrame:
    """(rep, ident, median): of as many draws with replacement as an entity has values, for replicates 0, 1, ...

    Draws depend on the number of values alone: the middle ones of each replicate are found without the values, in blocks of
    replicates where an entity has very many, and looked up in the array of the entity's values in their order.
    """
    kept = rows.where(F.col(value).isNotNull()).select(ident, F.struct(F.col(value).cast("double").alias("v"), F.col(ties).alias("t")).alias("_x"))
    packed = kept.groupBy(ident).agg(F.transform(F.sort_array(F.collect_list("_x")), lambda x: x["v"]).alias("_v"))
    packed = written(packed.withColumn("_n", F.size("_v")), "resampled-values")
    step = F.least(F.lit(replicates), F.greatest(F.lit(1), F.floor(F.lit(5_000_000) / F.col("_n"))).cast("int"))
    text = F.concat(F.concat_ws("|", F.lit(str(seed)), F.col(ident).cast("string")), F.lit("|"))
    asked = packed.select(F.col(ident).alias("_id"), text.alias("text"), F.col("_n").alias("n"), step.alias("step"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), step)).alias("first"))
    asked = asked.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_id", "first")

    def drawn(batches):
        for pdf in batches:
            last = np.minimum(pdf["first"] + pdf["step"], replicates)
            found = list(middle_draws(zip(pdf["text"].str.encode("utf-8"), pdf["n"], pdf["first"], last, strict=True)))
            yield pdf[["_id", "first"]].assign(low=[x for x, _ in found], high=[x for _, x in found])

    places = asked.mapInPandas(drawn, f"_id {dict(rows.dtypes)[ident]}, first int, low array<int>, high array<int>")
    met = packed.join(places, F.col(ident).eqNullSafe(F.col("_id")))
    at = lambda c, i: F.get("_v", F.get(c, i))
    each = F.transform(F.sequence(F.lit(0), F.size("low") - 1), lambda i: F.struct((F.col("first") + i).alias("rep"), ((at("low", i) + at("high", i)) / 2).alias("median")))
    return met.select(ident, F.explode(each).alias("_r")).select("_r.rep", ident, "_r.median")


def assignment_stability(aligned: DataFrame, ident: str, replicates: int) -> DataFrame:
    """(ident, modal, stability): the cluster most often aligned to, the lowest of ties, and its share of the replicates."""
    per = aligned.groupBy(ident, "aligned").agg(F.count("*").alias("_n"))
    best = F.max_by(F.struct("aligned", "_n"), F.struct("_n", -F.col("aligned")))
    return per.groupBy(ident).agg(best.alias("_b")).select(ident, F.col("_b.aligned").alias("modal"), (F.col("_b._n") / F.lit(replicates)).alias("stability"))


def named_clusters(labels: DataFrame, columns: Sequence[str], rules: Sequence[tuple[str, Mapping[str, float], float | None]], other: str) -> DataFrame:
    """(cluster, members, name) of labels (cluster, columns): each rule in turn names the cluster left that scores highest.

    A score is a weighted sum of a cluster's mean z-scores; a rule with a threshold names no cluster below it. What no rule
    names is `other`. Ties go to the lower cluster. A row for each cluster reaches the driver.
    """
    one = labels.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns)).first()
    z = [((F.avg(c) - F.lit(one[f"m_{c}"])) / F.lit(one[f"s_{c}"] or 1.0)).alias(c) for c in columns]
    profile = {r.cluster: r for r in labels.groupBy("cluster").agg(F.count("*").alias("members"), *z).collect()}
    names = dict.fromkeys(profile, other)
    left = set(profile)
    for name, weights, least in rules:
        if not left:
            break
        score = {c: sum(w * profile[c][x] for x, w in weights.items()) for c in left}
        top = min(left, key=lambda c: (-round(score[c], 9), c))
        if least is None or score[top] >= least:
            names[top] = name
            left.remove(top)
    return labels.sparkSession.createDataFrame([(c, profile[c].members, names[c]) for c in profile], "cluster int, members long, name string")


def subdivided(df: DataFrame, group: str, child: str, weight: str, least: int, least_weight: float) -> DataFrame:
    """df with market and rule: a group is divided by `child` only if it has several and each is large enough.

    Large enough are `least` rows, or a sum of `weight` of `least_weight`. Rows without a child stay in the group.
    """
    per = df.where(F.col(child).isNotNull()).groupBy(group, child).agg(((F.count("*") >= least) | (F.coalesce(F.sum(weight), F.lit(0)) >= least_weight)).alias("_ok"))
    ok = per.groupBy(F.col(group).alias("_g")).agg((F.bool_and("_ok") & (F.count("*") > 1)).alias("_divide"))
    out = df.join(ok, F.col(group).eqNullSafe(F.col("_g")), "left")
    divide = F.coalesce("_divide", F.lit(False)) & F.col(child).isNotNull()
    market = F.concat(F.col(group).cast("string"), F.lit("|"), F.when(divide, F.concat(F.lit("C"), F.lpad(F.col(child).cast("string"), 2, "0"))).otherwise("ALL"))
    return out.withColumns({"market": market, "rule": F.when(divide, "SUBDIVISION").otherwise("GROUP")}).drop("_g", "_divide")


def representatives(df: DataFrame, market: str, ident: str, columns: Sequence[str], n: int = 5) -> DataFrame:
    """(market, representatives): the n members nearest to their market's mean, nearest first; ties by ident."""
    mean = df.groupBy(F.col(market).alias("_m")).agg(*(F.avg(c).alias(f"_{c}") for c in columns))
    away = sum(((F.col(c) - F.col(f"_{c}")) ** 2 for c in columns[1:]), (F.col(columns[0]) - F.col(f"_{columns[0]}")) ** 2)
    near = df.join(mean, F.col(market) == F.col("_m")).select(market, ident, F.round(away, 9).alias("_d"))
    top = near.withColumn("_p", F.row_number().over(Window.partitionBy(market).orderBy("_d", ident))).where(F.col("_p") <= n)
    return top.groupBy(market).agg(F.array_sort(F.collect_list(F.struct("_p", ident))).alias("_t")).select(market, F.transform("_t", lambda x: x[ident]).alias("representatives"))
