"""Queries of clusters: their choice, stability, names, and the local markets made of them. A group is a supplier's nation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.staging import written
from ..operators import clusters as C
from ..operators.metrics import anchored, in_window
from ..operators.models import label_agreement
from .registry import TRADES, query, table, trades

COLUMNS = ["price", "size", "score"]
GROUPS = [["price"], ["size", "score"]]
#: Sizes of clusters and markets that are large enough, by entities or by deals of a year.
LEAST, LEAST_DEALS = 3, 200
KS, REPLICATES, ROUNDS = (2, 3, 4, 5), 100, 15


def _features(spark, d) -> DataFrame:
    """Entities with deals in the last year: medians of prices over windows, size and score."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("grp"), (F.col("s_acctbal") / 100).alias("score"))
    t = anchored(trades(spark, d), "deal_date")
    unit = lambda k: F.ln(F.percentile(F.when(in_window("deal_date", k), F.col("unit")), 0.5))
    per = t.groupBy("entity").agg(unit(12).alias("price"), unit(24).alias("price_24"), F.ln(F.percentile("unit", 0.5)).alias("price_all"), F.ln(F.sum("area")).alias("size"), F.count_if(in_window("deal_date", 12)).alias("deals_12m"))
    return written(s.join(per, "entity").where("price is not null and score is not null"), "market-features")


def _labels(spark, features: DataFrame, k: int):
    """(entities with base label, the scale): the best of several starts."""
    fitted = C.fitted_scale(features, COLUMNS)
    points = written(C.scaled(features, fitted, GROUPS), "market-points")
    centres = C.starting_centres(points, "entity", COLUMNS, [k])
    reps = centres.select("rep").distinct()
    found, ends = C.lloyd(points.crossJoin(F.broadcast(reps)), centres, COLUMNS, ROUNDS)  # a few starts
    best = C.best_starts(found, []).first().rep
    return found.where(F.col("rep") == best).withColumn("base", F.col("cluster")), fitted, ends.where(F.col("rep") == best)


def _sql_lloyd(name: str, points: str, centres: str, keys: str = "rep") -> str:
    """CTEs that end with `name`l (labels) and `name`c (centres) after ROUNDS steps. A cluster without points keeps its centre."""
    out, now = [], centres
    square = "(p.price - c.price) * (p.price - c.price) + (p.size - c.size) * (p.size - c.size) + (p.score - c.score) * (p.score - c.score)"
    for i in range(ROUNDS):
        out.append(
            f"{name}{i} AS MATERIALIZED (SELECT c.{keys}, c.cluster, COALESCE(n.price, c.price) AS price, COALESCE(n.size, c.size) AS size, COALESCE(n.score, c.score) AS score FROM {now} c LEFT JOIN "
            f"(SELECT {keys}, cluster, AVG(price) AS price, AVG(size) AS size, AVG(score) AS score FROM (SELECT p.{keys}, p.entity, ANY_VALUE(p.price) AS price, ANY_VALUE(p.size) AS size, "
            f"ANY_VALUE(p.score) AS score, ARG_MIN(c.cluster, {{'s': {square}, 'c': c.cluster}}) AS cluster FROM {points} p JOIN {now} c ON c.{keys} = p.{keys} GROUP BY 1, 2) GROUP BY 1, 2) n "
            f"ON n.{keys} = c.{keys} AND n.cluster = c.cluster)"
        )
        now = f"{name}{i}"
    out.append(f"{name}c AS (SELECT * FROM {now})")
    out.append(
        f"{name}l AS MATERIALIZED (SELECT p.{keys}, p.entity, ANY_VALUE(p.price) AS price, ANY_VALUE(p.size) AS size, ANY_VALUE(p.score) AS score, MIN({square}) AS square, "
        f"ARG_MIN(c.cluster, {{'s': {square}, 'c': c.cluster}}) AS cluster FROM {points} p JOIN {now} c ON c.{keys} = p.{keys} GROUP BY 1, 2)"
    )
    return ",\n  ".join(out)


_SQL_FEATURES = f"""{TRADES}, la AS (SELECT MAX(deal_date) AS last FROM t),
  fe AS (SELECT t.entity, ANY_VALUE(s_nationkey) AS grp, ANY_VALUE(s_acctbal) / 100 AS score, LN(MEDIAN(unit) FILTER (deal_date > last - INTERVAL 12 MONTH)) AS price,
    LN(MEDIAN(unit) FILTER (deal_date > last - INTERVAL 24 MONTH)) AS price_24, LN(MEDIAN(unit)) AS price_all, LN(SUM(area)) AS size,
    COUNT(*) FILTER (deal_date > last - INTERVAL 12 MONTH) AS deals_12m FROM t JOIN supplier ON s_suppkey = t.entity, la GROUP BY 1),
  ft AS (SELECT * FROM fe WHERE price IS NOT NULL AND score IS NOT NULL)"""


def _sql_scale(name: str, source: str, price: str = "price", fit: str = "") -> str:
    """CTEs that end with `name`: `source` scaled as it is itself, or as the CTE `fit` says."""
    columns = {"price": (price, 1), "size": ("size", 2), "score": ("score", 2)}
    out = []
    if not fit:
        fit = f"{name}q"
        out.append(f"{name}b AS (SELECT {', '.join(f'quantile_cont({c}, 0.01) AS {k}_lo, quantile_cont({c}, 0.99) AS {k}_hi' for k, (c, _) in columns.items())} FROM {source})")
        inside = {k: f"LEAST(GREATEST({c}, {k}_lo), {k}_hi)" for k, (c, _) in columns.items()}
        spread = ", ".join(f"ANY_VALUE({k}_lo) AS {k}_lo, ANY_VALUE({k}_hi) AS {k}_hi, MEDIAN({x}) AS {k}_m, COALESCE(NULLIF(quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25), 0), 1) AS {k}_w" for k, x in inside.items())
        out.append(f"{fit} AS (SELECT {spread} FROM {source}, {name}b)")
    made = ", ".join(f"(LEAST(GREATEST({c}, {k}_lo), {k}_hi) - {k}_m) / {k}_w / sqrt({n}) AS {k}" for k, (c, n) in columns.items())
    out.append(f"{name} AS (SELECT entity, {made} FROM {source}, {fit})")
    return ",\n  ".join(out)


def _sql_starts(name: str, points: str, ks: tuple[int, ...]) -> str:
    """CTE `name`: (rep, k, cluster, price, size, score)."""
    orders = {"price": "price", "size": "size", "score": "score", "sum": "price + size + score"}
    of = [(o, v, k, i) for o, v in orders.items() for k in ks for i in range(k)]
    one = [
        f"SELECT '{k}:{o}' AS rep, {k} AS k, {i} AS cluster, ARG_MIN({{'p': price, 's': size, 'c': score}}, {{'d': ROUND(ABS({v} - q), 9), 'e': entity}}) AS x FROM {points}, (SELECT quantile_cont({v}, {(2 * i + 1) / (2 * k)!r}) AS q FROM {points})"
        for o, v, k, i in of
    ]
    return f"{name} AS MATERIALIZED (SELECT rep, k, cluster, x.p AS price, x.s AS size, x.c AS score FROM ({' UNION ALL '.join(one)}))"


def _sql_base(k: int) -> str:
    """CTEs that end with `base`: (entity, base, price, size, score), the labels of the best start."""
    return f"""{_sql_scale("pt", "ft")},
  {_sql_starts("st", "pt", (k,))},
  pts AS (SELECT pt.*, rep FROM pt, (SELECT DISTINCT rep FROM st)),
  {_sql_lloyd("bs", "pts", "st")},
  bb AS (SELECT ARG_MIN(rep, {{'s': s, 'r': rep}}) AS rep FROM (SELECT rep, ROUND(SUM(square), 9) AS s FROM bsl GROUP BY 1)),
  base AS (SELECT entity, cluster AS base, price, size, score FROM bsl WHERE rep = (SELECT rep FROM bb))"""


@query(
    "cluster_selection",
    f"""WITH {_SQL_FEATURES}, {_sql_scale("pt", "ft")},
  {_sql_starts("st", "pt", KS)},
  pts AS (SELECT pt.*, rep FROM pt, (SELECT DISTINCT rep FROM st)),
  {_sql_lloyd("bs", "pts", "st")},
  kb AS (SELECT k, ARG_MIN(rep, {{'s': s, 'r': rep}}) AS rep FROM (SELECT CAST(split_part(rep, ':', 1) AS INT) AS k, rep, ROUND(SUM(square), 9) AS s FROM bsl GROUP BY ALL) GROUP BY 1),
  l AS (SELECT k, bsl.*, price * price + size * size + score * score AS norm FROM bsl JOIN kb USING (rep)),
  c AS (SELECT k, cluster, COUNT(*) AS n, AVG(price) AS price, AVG(size) AS size, AVG(score) AS score, AVG(norm) AS q, AVG(sqrt(square)) AS s, SUM(square) AS ss FROM l GROUP BY ALL),
  aw AS (SELECT l.k, entity, l.cluster, c.cluster AS other, c.n, norm - 2 * (l.price * c.price + l.size * c.size + l.score * c.score) + c.q AS away FROM l JOIN c ON c.k = l.k),
  sp AS (SELECT k, entity, ANY_VALUE(n) FILTER (cluster = other) AS n, ANY_VALUE(away * n / NULLIF(n - 1, 0)) FILTER (cluster = other) AS a, MIN(away) FILTER (cluster <> other) AS b FROM aw GROUP BY ALL),
  si AS (SELECT k, AVG(CASE WHEN n > 1 THEN COALESCE((b - a) / NULLIF(GREATEST(a, b), 0), 0) ELSE 0 END) AS silhouette FROM sp GROUP BY 1),
  w AS (SELECT k, SUM(n) AS n, COUNT(*) AS m, SUM(ss) AS ss, MIN(n) AS least, MAX(n) AS most,
    SUM(n * (price * price + size * size + score * score)) - (SUM(n * price) * SUM(n * price) + SUM(n * size) * SUM(n * size) + SUM(n * score) * SUM(n * score)) / SUM(n) AS between FROM c GROUP BY 1),
  d AS (SELECT k, AVG(w) AS db FROM (SELECT a.k, a.cluster, MAX((a.s + b.s) / NULLIF(sqrt((a.price - b.price) ** 2 + (a.size - b.size) ** 2 + (a.score - b.score) ** 2), 0)) AS w
    FROM c a JOIN c b ON a.k = b.k AND a.cluster <> b.cluster GROUP BY ALL) GROUP BY 1),
  q AS (SELECT w.k, ROUND(silhouette, 9) AS silhouette, ROUND(between / (m - 1) / (ss / (w.n - m)), 9) AS ch, ROUND(db, 9) AS db, least, most, least >= {LEAST} AS ok FROM w JOIN si ON si.k = w.k JOIN d ON d.k = w.k),
  r AS (SELECT *, RANK() OVER (PARTITION BY ok ORDER BY silhouette DESC) + (COUNT(*) OVER (PARTITION BY ok, silhouette) - 1) / 2 + RANK() OVER (PARTITION BY ok ORDER BY ch DESC)
    + (COUNT(*) OVER (PARTITION BY ok, ch) - 1) / 2 + RANK() OVER (PARTITION BY ok ORDER BY db) + (COUNT(*) OVER (PARTITION BY ok, db) - 1) / 2 AS rank_score FROM q)
SELECT k, ROUND(silhouette, 6) AS silhouette, ROUND(ch, 5) AS calinski_harabasz, ROUND(db, 6) AS davies_bouldin, CAST(least AS BIGINT) AS least, CAST(most AS BIGINT) AS most,
  CASE WHEN ok THEN CAST(rank_score AS DOUBLE) END AS rank_score, ok AND ROW_NUMBER() OVER (PARTITION BY ok ORDER BY rank_score, k) = 1 AS chosen FROM r""",
)
def cluster_selection(spark, d):
    """Clusters for a range of k from the best of several starts, three measures of quality, and the choice."""
    features = _features(spark, d)
    points = written(C.scaled(features, C.fitted_scale(features, COLUMNS), GROUPS), "market-points")
    centres = C.starting_centres(points, "entity", COLUMNS, KS)
    found, _ = C.lloyd(points.crossJoin(F.broadcast(centres.select("rep").distinct())), centres, COLUMNS, ROUNDS)  # a few starts
    found = found.withColumn("k", F.split("rep", ":")[0].cast("int"))
    best = C.best_starts(found, ["k"]).select("rep")
    quality = C.cluster_quality(found.join(F.broadcast(best), "rep"), COLUMNS).drop("k").withColumn("k", F.split("rep", ":")[0].cast("int"))
    chosen = C.rank_sum_choice(quality, ["silhouette", "calinski_harabasz"], ["davies_bouldin"], F.col("least") >= LEAST)
    digits = {"silhouette": 6, "calinski_harabasz": 5, "davies_bouldin": 6}
    return chosen.select("k", "least", "most", "rank_score", "chosen", *(F.round(c, n).alias(c) for c, n in digits.items()))


_PERMUTED = "(SELECT [0, 1, 2] AS p UNION ALL SELECT [0, 2, 1] UNION ALL SELECT [1, 0, 2] UNION ALL SELECT [1, 2, 0] UNION ALL SELECT [2, 0, 1] UNION ALL SELECT [2, 1, 0])"


def _sql_aligned(name: str, labels: str) -> str:
    """CTE `name`: labels (rep, entity, cluster) with `aligned`, by the best of the six ways to name three clusters."""
    agree = "SUM((p[cluster + 1] = base.base)::INT)"
    return f"""{name} AS (SELECT l.rep, l.entity, l.cluster, p[l.cluster + 1] AS aligned FROM {labels} l JOIN (SELECT rep, ARG_MAX(p, {{'a': a, 'i': i}}) AS p FROM (
    SELECT rep, p, {agree} AS a, ANY_VALUE((p[1] = 0)::INT + (p[2] = 1)::INT + (p[3] = 2)::INT) AS i FROM {labels} JOIN base USING (entity), {_PERMUTED} GROUP BY ALL) GROUP BY 1) b ON b.rep = l.rep)"""


#: CTEs that end with `mo`: (entity, modal, n), the cluster that an entity most often has in resamples.
_SQL_STABLE = f"""nu AS (SELECT t.entity, unit AS v, ROW_NUMBER() OVER (PARTITION BY t.entity ORDER BY unit, deal, part) - 1 AS i, COUNT(*) OVER (PARTITION BY t.entity) AS n FROM t JOIN ft ON ft.entity = t.entity, la WHERE deal_date > last - INTERVAL 12 MONTH),
  dr AS (SELECT rep, entity, n, CAST('0x' || substr(md5('0|' || entity || '|' || rep || '|' || i), 1, 8) AS BIGINT) % n AS d FROM nu, range(0, {REPLICATES}) r(rep)),
  od AS (SELECT rep, entity, n, d, ROW_NUMBER() OVER (PARTITION BY rep, entity ORDER BY d) - 1 AS o FROM dr),
  md AS (SELECT rep, od.entity, LN(AVG(v)) AS price FROM od JOIN nu ON nu.entity = od.entity AND nu.i = od.d WHERE o IN ((od.n - 1) // 2, od.n // 2) GROUP BY ALL),
  rs AS (SELECT md.rep, ft.entity, md.price, size, score FROM md JOIN ft ON ft.entity = md.entity),
  rp AS (SELECT rep, entity, (LEAST(GREATEST(price, price_lo), price_hi) - price_m) / price_w AS price, (LEAST(GREATEST(size, size_lo), size_hi) - size_m) / size_w / sqrt(2) AS size,
    (LEAST(GREATEST(score, score_lo), score_hi) - score_m) / score_w / sqrt(2) AS score FROM rs, ptq),
  rc AS (SELECT r.rep, c.cluster, c.price, c.size, c.score FROM range(0, {REPLICATES}) r(rep), bsc c WHERE c.rep = (SELECT rep FROM bb)),
  {_sql_lloyd("rl", "rp", "rc")},
  {_sql_aligned("ra", "rll")},
  ct AS (SELECT entity, aligned, COUNT(*) AS n FROM ra GROUP BY ALL),
  mo AS (SELECT entity, ARG_MAX(aligned, {{'n': n, 'a': -aligned}}) AS modal, MAX(n) AS n FROM ct GROUP BY 1)"""


@query(
    "cluster_stability",
    f"""WITH {_SQL_FEATURES}, {_sql_base(3)},
  {_SQL_STABLE}
SELECT base.entity, base.base, modal, n / {REPLICATES} AS stability FROM base JOIN mo ON mo.entity = base.entity""",
)
def cluster_stability(spark, d):
    """How often an entity keeps its cluster when a year's prices are resampled, all replicates in one job."""
    features = _features(spark, d)
    base, fitted, ends = _labels(spark, features, 3)
    aligned = _resampled(spark, d, features, base, fitted, ends)
    return base.select("entity", "base").join(C.assignment_stability(aligned, "entity", REPLICATES), "entity")


def _resampled(spark, d, features: DataFrame, base: DataFrame, fitted, ends: DataFrame) -> DataFrame:
    """Labels of each replicate of resampled prices, aligned to the base."""
    t = anchored(trades(spark, d), "deal_date").where(in_window("deal_date", 12)).withColumn("ties", F.struct("deal", "part"))
    medians = C.resampled_medians(t.join(features.select("entity"), "entity", "left_semi"), "entity", "unit", "ties", REPLICATES)
    again = medians.join(features.drop("price"), "entity").withColumn("price", F.ln("median"))
    points = written(C.scaled(again, fitted, GROUPS).select("rep", "entity", *COLUMNS), "resampled")
    reps = spark.range(REPLICATES).select(F.col("id").cast("int").alias("rep"))
    found, _ = C.lloyd(points, reps.crossJoin(F.broadcast(ends.select("cluster", *COLUMNS))), COLUMNS, ROUNDS)  # a row for each cluster
    return C.aligned_labels(found, base.select("entity", "base"), "entity")


#: CTEs that end with `al`: (rep, entity, cluster, aligned) of each window.
_SQL_WINDOWS = f"""{_sql_scale("w24", "ft", "price_24")},
  {_sql_scale("wall", "ft", "price_all")},
  wp AS (SELECT '12M' AS rep, * FROM pt UNION ALL SELECT '24M', * FROM w24 UNION ALL SELECT 'FULL', * FROM wall),
  wc AS (SELECT r.rep, c.cluster, c.price, c.size, c.score FROM (SELECT DISTINCT rep FROM wp) r, bsc c WHERE c.rep = (SELECT rep FROM bb)),
  {_sql_lloyd("wl", "wp", "wc")},
  {_sql_aligned("al", "wll")}"""


@query(
    "cluster_windows",
    f"""WITH {_SQL_FEATURES}, {_sql_base(3)},
  {_SQL_WINDOWS},
  x AS (SELECT rep, base, aligned, COUNT(*) AS n FROM al JOIN base USING (entity) GROUP BY ALL),
  xa AS (SELECT rep, base, SUM(n) AS n FROM x GROUP BY ALL), xb AS (SELECT rep, aligned, SUM(n) AS n FROM x GROUP BY ALL),
  s AS (SELECT rep, SUM(n) AS n, SUM(n * (n - 1) / 2) AS p, SUM(n * LN(n)) AS e, SUM(n) FILTER (base = aligned) AS agree FROM x GROUP BY 1),
  sa AS (SELECT rep, SUM(n * (n - 1) / 2) AS p, SUM(n * LN(n)) AS e FROM xa GROUP BY 1), sb AS (SELECT rep, SUM(n * (n - 1) / 2) AS p, SUM(n * LN(n)) AS e FROM xb GROUP BY 1)
SELECT s.rep AS win, CAST(s.n AS BIGINT) AS n, ROUND(COALESCE((s.p - sa.p * sb.p / (s.n * (s.n - 1) / 2)) / NULLIF((sa.p + sb.p) / 2 - sa.p * sb.p / (s.n * (s.n - 1) / 2), 0), 1), 8) AS ari,
  ROUND(COALESCE((LN(s.n) - sa.e / s.n + LN(s.n) - sb.e / s.n - (LN(s.n) - s.e / s.n)) / NULLIF((LN(s.n) - sa.e / s.n + LN(s.n) - sb.e / s.n) / 2, 0), 1), 8) AS nmi,
  ROUND(COALESCE(agree, 0) / s.n, 8) AS agreement FROM s JOIN sa ON sa.rep = s.rep JOIN sb ON sb.rep = s.rep""",
)
def cluster_windows(spark, d):
    """Clusters of prices over other windows, aligned to those of a year, and their agreement."""
    base, found = _windows(spark, _features(spark, d))
    both = found.join(base.select("entity", "base"), "entity")
    out = None
    for win in ("12M", "24M", "FULL"):
        own = both.where(F.col("rep") == win)
        share = own.agg(F.avg((F.col("base") == F.col("aligned")).cast("double")).alias("agreement"))
        row = label_agreement(own, "base", "aligned").crossJoin(share).select(F.lit(win).alias("win"), "n", F.round("ari", 8).alias("ari"), F.round("nmi", 8).alias("nmi"), F.round("agreement", 8).alias("agreement"))  # one row
        out = row if out is None else out.unionByName(row)
    return out


def _windows(spark, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the base labels, aligned labels of each window)."""
    base, _, ends = _labels(spark, features, 3)
    points = None
    for win, column in (("12M", "price"), ("24M", "price_24"), ("FULL", "price_all")):
        own = features.withColumn("price", F.col(column))
        own = C.scaled(own, C.fitted_scale(own, COLUMNS), GROUPS).select(F.lit(win).alias("rep"), "entity", *COLUMNS)
        points = own if points is None else points.unionByName(own)
    points = written(points, "window-points")
    centres = points.select("rep").distinct().crossJoin(F.broadcast(ends.select("cluster", *COLUMNS)))  # a row for each cluster
    found, _ = C.lloyd(points, centres, COLUMNS, ROUNDS)
    return base, C.aligned_labels(found, base.select("entity", "base"), "entity")


#: Rules of names, in turn: the score of a cluster's z-scores, and the least that it may be.
NAMES = (("DEAR", {"price": 1.0}, None), ("BUSY_AND_RATED", {"size": 1.0, "score": 1.0}, 0.0), ("SMALL", {"size": -1.0}, 0.25))


@query(
    "cluster_names",
    f"""WITH {_SQL_FEATURES}, {_sql_base(3)},
  o AS (SELECT AVG(price) AS mp, STDDEV_POP(price) AS sp, AVG(size) AS ms, STDDEV_POP(size) AS ss, AVG(score) AS mc, STDDEV_POP(score) AS sc FROM base),
  z AS (SELECT base AS cluster, COUNT(*) AS members, ROUND((AVG(price) - ANY_VALUE(mp)) / ANY_VALUE(sp), 9) AS a, ROUND((AVG(size) - ANY_VALUE(ms)) / ANY_VALUE(ss) + (AVG(score) - ANY_VALUE(mc)) / ANY_VALUE(sc), 9) AS b,
    ROUND(-(AVG(size) - ANY_VALUE(ms)) / ANY_VALUE(ss), 9) AS c FROM base, o GROUP BY 1),
  n1 AS (SELECT ARG_MIN(cluster, {{'x': -a, 'c': cluster}}) AS k FROM z),
  n2 AS (SELECT CASE WHEN MAX(b) >= 0 THEN ARG_MIN(cluster, {{'x': -b, 'c': cluster}}) END AS k FROM z WHERE cluster <> (SELECT k FROM n1)),
  n3 AS (SELECT CASE WHEN MAX(c) >= 0.25 THEN ARG_MIN(cluster, {{'x': -c, 'c': cluster}}) END AS k FROM z WHERE cluster <> (SELECT k FROM n1) AND cluster IS DISTINCT FROM (SELECT k FROM n2))
SELECT cluster, members, CASE WHEN cluster = (SELECT k FROM n1) THEN 'DEAR' WHEN cluster = (SELECT k FROM n2) THEN 'BUSY_AND_RATED' WHEN cluster = (SELECT k FROM n3) THEN 'SMALL' ELSE 'BALANCED' END AS name FROM z""",
)
def cluster_names(spark, d):
    """Clusters named by their profiles, each rule in turn taking what is left."""
    base, _, _ = _labels(spark, _features(spark, d), 3)
    return C.named_clusters(base, COLUMNS, NAMES, "BALANCED")


_SQL_X18 = f"""WITH {_SQL_FEATURES}, {_sql_base(3)},
  {_SQL_STABLE},
  {_SQL_WINDOWS},
  same AS (SELECT entity, COUNT(DISTINCT aligned) = 1 AS same FROM al GROUP BY 1),
  ch AS (SELECT grp, base, COUNT(*) >= {LEAST} OR SUM(deals_12m) >= {LEAST_DEALS} AS ok FROM base JOIN ft USING (entity) GROUP BY ALL),
  dv AS (SELECT grp, BOOL_AND(ok) AND COUNT(*) > 1 AS divide FROM ch GROUP BY 1),
  hy AS (SELECT base.*, ft.grp, ft.price AS log_price, deals_12m, ft.grp || '|' || CASE WHEN divide THEN 'C' || lpad(CAST(base AS VARCHAR), 2, '0') ELSE 'ALL' END AS market,
    CASE WHEN divide THEN 'SUBDIVISION' ELSE 'GROUP' END AS rule, n / {REPLICATES} AS stability, same FROM base JOIN ft ON ft.entity = base.entity JOIN dv ON dv.grp = ft.grp JOIN mo ON mo.entity = base.entity JOIN same ON same.entity = base.entity),
  rv AS (SELECT *, log_price - AVG(log_price) OVER (PARTITION BY grp) AS rg, log_price - AVG(log_price) OVER (PARTITION BY market) AS rm FROM hy),
  dc AS (SELECT 1 - VAR_SAMP(rm) / NULLIF(VAR_SAMP(rg), 0) AS gain, MEDIAN(stability) AS mid FROM rv),
  mn AS (SELECT BOOL_AND(ok) AS ok FROM (SELECT COUNT(*) >= {LEAST} OR SUM(deals_12m) >= {LEAST_DEALS} AS ok FROM hy GROUP BY market)),
  x AS (SELECT rep, base, aligned, COUNT(*) AS n FROM al JOIN base USING (entity) WHERE rep = '24M' GROUP BY ALL),
  ar AS (SELECT (p - pa * pb / (n * (n - 1) / 2)) / NULLIF((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2), 0) AS ari FROM (SELECT (SELECT SUM(n) FROM x) AS n, (SELECT SUM(n * (n - 1) / 2) FROM x) AS p,
    (SELECT SUM(n * (n - 1) / 2) FROM (SELECT SUM(n) AS n FROM x GROUP BY base)) AS pa, (SELECT SUM(n * (n - 1) / 2) FROM (SELECT SUM(n) AS n FROM x GROUP BY aligned)) AS pb)),
  df AS (SELECT CASE WHEN gain >= 0.05 AND COALESCE(ari, 1) >= 0.7 AND mid >= 0.8 AND ok THEN 'HYBRID' ELSE 'GROUP' END AS definition FROM dc, mn, ar),
  fm AS (SELECT hy.*, definition, CASE WHEN definition = 'HYBRID' THEN market ELSE CAST(grp AS VARCHAR) END AS final FROM hy, df),
  ct0 AS (SELECT final, AVG(price) AS p, AVG(size) AS s, AVG(score) AS c FROM fm GROUP BY 1),
  nr AS (SELECT fm.final, entity, ROW_NUMBER() OVER (PARTITION BY fm.final ORDER BY ROUND((price - p) * (price - p) + (size - s) * (size - s) + (score - c) * (score - c), 9), entity) AS place FROM fm JOIN ct0 ON ct0.final = fm.final),
  re AS (SELECT final, string_agg(CAST(entity AS VARCHAR), ',' ORDER BY place) AS representatives FROM nr WHERE place <= 5 GROUP BY 1)
SELECT fm.final AS market, ANY_VALUE(definition) AS definition, COUNT(*) AS members, CAST(SUM(deals_12m) AS BIGINT) AS deals_12m, ROUND(MEDIAN(EXP(log_price)), 5) AS median_price,
  ROUND(quantile_cont(EXP(log_price), 0.75) - quantile_cont(EXP(log_price), 0.25), 5) AS price_iqr, ROUND(AVG(same::INT), 8) AS time_stability, MEDIAN(stability) AS stability,
  CASE WHEN COUNT(*) >= 10 AND MEDIAN(stability) >= 0.9 THEN 'HIGH' WHEN COUNT(*) >= 5 AND MEDIAN(stability) >= 0.75 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  COUNT(*) < {LEAST} AND SUM(deals_12m) < {LEAST_DEALS} AS low_sample, COUNT(*) FILTER (rule = 'SUBDIVISION') AS subdivided, ANY_VALUE(representatives) AS representatives FROM fm JOIN re ON re.final = fm.final GROUP BY 1"""


@query("x18_market_discovery", _SQL_X18)
def x18_market_discovery(spark, d):
    """Local markets from clusters within groups, if they are more alike, stable and large enough; else groups.

    A group is divided by cluster only if every child is large enough. Markets have their stability over resamples and
    windows, their confidence, and the five members nearest to their centre. The reference's second clustering, by Ward's
    method, and spatial spreads are left out.
    """
    features = _features(spark, d)
    base, fitted, ends = _labels(spark, features, 3)
    stable = C.assignment_stability(_resampled(spark, d, features, base, fitted, ends), "entity", REPLICATES)
    _, windows = _windows(spark, features)
    same = windows.groupBy("entity").agg((F.count_distinct("aligned") == 1).alias("same"))
    own = features.select("entity", F.col("price").alias("log_price"))
    hybrid = C.subdivided(base.select("entity", "grp", "base", "deals_12m", *COLUMNS), "grp", "base", "deals_12m", LEAST, LEAST_DEALS)
    hybrid = written(hybrid.join(own, "entity").join(stable, "entity").join(same, "entity"), "hybrid-markets")
    within = [hybrid.groupBy(k).agg(F.count("*").alias("n"), F.var_pop("log_price").alias("v")).agg(F.sum(F.col("n") * F.col("v")).alias("ss")).first().ss for k in ("grp", "market")]
    large = hybrid.groupBy("market").agg(((F.count("*") >= LEAST) | (F.sum("deals_12m") >= LEAST_DEALS)).alias("ok")).agg(F.bool_and("ok").alias("ok")).first().ok
    ari = label_agreement(windows.where("rep = '24M'").join(base.select("entity", "base"), "entity"), "base", "aligned").first().ari
    middle = hybrid.agg(F.percentile("stability", 0.5).alias("m")).first().m
    better = bool(within[0]) and 1 - within[1] / within[0] >= 0.05 and ari >= 0.7 and middle >= 0.8 and bool(large)
    final = hybrid.withColumn("final", F.col("market") if better else F.col("grp").cast("string"))
    near = C.representatives(final, "final", "entity", COLUMNS).withColumnRenamed("final", "_f")
    price, quarter = F.exp("log_price"), lambda p: F.percentile(F.exp("log_price"), p)
    per = final.groupBy("final").agg(
        F.count("*").alias("members"),
        F.sum("deals_12m").alias("deals_12m"),
        F.round(F.percentile(price, 0.5), 5).alias("median_price"),
        F.round(quarter(0.75) - quarter(0.25), 5).alias("price_iqr"),
        F.round(F.avg(F.col("same").cast("double")), 8).alias("time_stability"),
        F.percentile("stability", 0.5).alias("stability"),
        F.count_if(F.col("rule") == "SUBDIVISION").alias("subdivided"),
    )
    sure = R.first_match([((F.col("members") >= 10) & (F.col("stability") >= 0.9), "HIGH"), ((F.col("members") >= 5) & (F.col("stability") >= 0.75), "MEDIUM")], "LOW")
    thin = (F.col("members") < LEAST) & (F.col("deals_12m") < LEAST_DEALS)
    out = per.join(near, F.col("final") == F.col("_f")).drop("_f").withColumnRenamed("final", "market")
    return out.withColumns({"definition": F.lit("HYBRID" if better else "GROUP"), "confidence": sure, "low_sample": thin, "representatives": F.concat_ws(",", F.col("representatives").cast("array<string>"))})
