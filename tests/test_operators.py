"""Fixtures with nulls, ties, zero divisors and repeats for functions and operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from marlstone.functions import ranks as R
from marlstone.functions import rules as P
from marlstone.functions import texts as X
from marlstone.operators import guards as G
from marlstone.operators import joins as J
from marlstone.operators import metrics as A
from marlstone.operators import models as M
from marlstone.operators import sets as U
from marlstone.sources import readers as S
from marlstone.sources import sinks as K


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_percentile_rank_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None), (4, 1.0)], "id int, x double")
    out = dict(rows(df.select("id", R.percentile_rank("x")), "id"))
    assert out[3] is None and out[1] == out[2] == pytest.approx(250 / 3) and out[4] == pytest.approx(100 / 3)


def test_min_rank_and_quintile(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 3.0), (3, 1.0), (4, None)], "id int, x double")
    assert [r[1] for r in rows(df.select("id", R.min_rank_desc("x")), "id")] == [1, 1, 3, None]


def test_spearman_needs_three_rows_and_two_values(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 1.0), ("b", 1.0, 1.0), ("b", 2.0, 1.0), ("b", 3.0, 1.0), ("c", 1.0, 1.0), ("c", 2.0, 4.0), ("c", 3.0, 9.0)], "g string, x double, y double")
    assert rows(R.spearman(df, "x", "y", ["g"]), "g") == [("a", None, 2), ("b", None, 3), ("c", pytest.approx(1.0), 3)]


def test_rules(spark):
    one = spark.range(1)
    status = lambda p, a, b: P.interval_status(F.lit(p), F.lit(a), F.lit(b))
    cases = [((20.0, 1.0, 40.0), "STRONG_UNDER"), ((10.0, -20.0, 30.0), "POTENTIAL_UNDER"), ((2.0, -20.0, 30.0), "WITHIN"), ((-10.0, -30.0, 20.0), "POTENTIAL_OVER"), ((-20.0, -40.0, -1.0), "STRONG_OVER")]
    got = one.select(*(status(*c).alias(str(i)) for i, (c, _) in enumerate(cases))).first()
    assert list(got) == [want for _, want in cases]
    null = F.lit(None).cast("double")
    r = one.select(P.sign(null), P.ratio(F.lit(1.0), F.lit(0.0)), P.first_match([(null > 1, "x")], "none"), P.weighted_score([(1.0, null)]), P.sign_stability([F.lit(1.0), null]), P.reason_text([("a", null > 0)])).first()
    assert list(r) == [None, None, "none", None, "INSUFFICIENT", "NONE"]
    more = one.select(
        status(3.0, -1.0, 9.0), status(-3.0, -9.0, 1.0), P.interval_status(null, F.lit(1.0), F.lit(2.0)), P.sign_stability([F.lit(1.0), null, F.lit(2.0)]), P.sign_pattern([F.lit(1.0), null, F.lit(-2.0), F.lit(0.0)]),
        *(P.agreement(F.lit(a), F.lit(b)) for a, b in ((0.5, 9.0), (1.0, 2.0), (-1.0, -2.0), (1.0, -2.0), (-1.0, 2.0))), P.agreement(null, F.lit(1.0)),
        *(P.probability_class(F.lit(p)) for p in (0.9, 0.75, 0.5, 0.25, 0.1)), P.probability_class(null),
        *(P.difference_cause(F.lit(a), F.lit(b)) for a, b in ((5, 5), (5, 8), (485, 500), (400, 500), (450, 500), (600, 500))),
    ).first()
    assert list(more) == [
        "POTENTIAL_UNDER", "POTENTIAL_OVER", "INSUFFICIENT", "STABLE_POSITIVE", "+NA-0",
        "NEUTRAL_OR_ZERO", "STRONG_POSITIVE", "STRONG_NEGATIVE", "MIXED_POSITIVE_RESIDUAL", "MIXED_POSITIVE_COMPARABLE", "INSUFFICIENT",
        "VERY_STABLE_POSITIVE", "STABLE_POSITIVE", "MIXED", "STABLE_NEGATIVE", "VERY_STABLE_NEGATIVE", "INSUFFICIENT",
        "EXACT", "MINOR_DIFFERENCE", "RENTAL_DIFFERENCE", "SPLIT_OR_UNREGISTERED", "DATA_DIFFERENCE", "DATA_DIFFERENCE",
    ]
    assert one.select(P.shrunk(F.lit(0.5), F.lit(10), F.lit(0.1), 100.0)).first()[0] == pytest.approx(15 / 110)


def test_decimal_group_ids(spark):
    df = spark.createDataFrame([("59.9794",), ("84.0",), ("84",)], "a string")
    assert [r[0] for r in df.select(X.group_id(F.col("a"))).collect()] == ["exclusive_59_9794", "exclusive_84", "exclusive_84"]


def test_clause_numbers(spark):
    df = spark.createDataFrame([("1,3,5통", [1, 3, 5]), ("1~5통 중 3통 제외", [1, 2, 4, 5]), ("2~4통", [2, 3, 4]), ("가나다", [])], "c string, want array<int>")
    assert all(r[0] == r[1] for r in df.select(X.numbers_of_clause(F.col("c")), "want").collect())
    parsed = X.parse_clauses(spark.createDataFrame([(1, "1~2통, 해운대로 (가, 나), 101번지")], "k int, t string"), "k", "t")
    assert [r[3] for r in rows(parsed, "position")] == ["RANGE", "ROAD", "LOT"]
    decided = X.boundary_decision(spark.createDataFrame([(1, "INCLUDE"), (1, "EXCLUDE"), (2, "INCLUDE")], "k int, kind string"), ["k"])
    assert rows(decided, "k") == [(1, "EXCLUDE"), (2, "INCLUDE")]


def test_names_and_lots(spark):
    r = spark.createDataFrame([("Sun (Phase 1) Apartments", "123-4", "산 7", None)], "n string, a string, b string, c string").select(X.entity_name(F.col("n")), X.lot_key(F.col("a")), X.lot_key(F.col("b")), X.lot_key(F.col("c")), X.count_text(F.lit("1,234")), X.count_text(F.lit("x")), X.only_year(F.lit("in 2024 and 2024")), X.only_year(F.lit("2023 or 2024"))).first()
    assert list(r) == ["sun", "01230004", "00070000", None, 1234, None, 2024, None]
    assert spark.range(1).select(X.sections(F.lit("head [a, b] tail"), "[", "]")).first()[0] == "a, b"


def test_guards(spark):
    df = spark.createDataFrame([(1, 2), (1, 3), (None, 4)], "k int, v int")
    with pytest.raises(G.GuardError):
        G.assert_unique(df, ["k"])
    with pytest.raises(G.GuardError):
        G.assert_unique(df.where("v <> 3"), ["k"])
    with pytest.raises(G.GuardError):
        G.require_columns(df, ["x"])
    assert G.require_columns(df, ["k"]) == ["v"]
    assert rows(G.issues(df, "v", [("NULL_KEY", F.col("k").isNull()), ("BIG", F.col("v") > 3)]), "code") == [(4, "BIG"), (4, "NULL_KEY")]
    assert G.coverage(df.where("k is not null"), df.where("k is not null"), "k").first().equal


def test_points_in_polygons_and_nearest(spark):
    square = [(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0)]
    zones = spark.createDataFrame([("a", square), ("b", square)], "zone string, ring array<struct<x: double, y: double>>")
    points = spark.createDataFrame([(1, 50.0, 50.0), (2, 150.0, 50.0), (3, None, 1.0)], "p int, x double, y double")
    assert rows(J.points_in_polygons(points, zones, "p", "zone", 30.0), "p", "zone") == [(1, "a"), (1, "b")]
    assert rows(J.nearest_polygons(points.where("p = 2"), zones, "p", "zone", 40.0), "p") == [(2, "a", 50.0)]


def test_nearest_polygons_at_any_distance(spark):
    """Sparse and crowded squares of many sizes, and points far from all, against each pair."""
    r = random.Random(5)
    spots = [(r.uniform(-40, 40), r.uniform(-40, 40), r.choice([1, 3, 30])) for _ in range(60)] + [(5000.0, 5000.0, 2), (-9000.0, 300.0, 500), (9.5, 9.5, 0.2), (9.5, 0.2, 0.2)]
    zones = [(i, [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]) for i, (x, y, s) in enumerate(spots)]
    points = [(i, r.uniform(-60, 60), r.uniform(-60, 60)) for i in range(60)] + [(100 + i, r.uniform(-20_000, 20_000), r.uniform(-20_000, 20_000)) for i in range(60)]

    def apart(x, y, ring):
        far = []
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            t = min(1, max(0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
            far.append(math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)))
        return min(far)

    polygons = spark.createDataFrame([*zones, (99, [])], "zone int, ring array<struct<x: double, y: double>>")
    table = spark.createDataFrame([*points, (900, None, 1.0), (901, float("nan"), 1.0)], "p int, x double, y double")
    for cell in (1.0, 50.0):
        got = rows(J.nearest_polygons(table, polygons, "p", "zone", cell), "p")
        assert [g[0] for g in got] == [p for p, _, _ in points]
        for (_, zone, distance), (_, x, y) in zip(got, points, strict=True):
            best = min((apart(x, y, ring), i) for i, ring in zones)
            assert distance == pytest.approx(best[0], rel=1e-9) and zone == best[1]
    assert J.nearest_polygons(table, polygons.where("zone = 99"), "p", "zone", 1.0).collect() == []


def test_overrides_keep_originals(spark):
    base = spark.createDataFrame([(1, "A", "x"), (2, "B", "y")], "e int, m string, kind string")
    fix = spark.createDataFrame([(1, "A", "EXACT")], "e int, m string, kind string")
    assert rows(J.overridden(base, fix, ["e", "m"], ["kind"]).select("e", "kind", "original_kind", "override_applied"), "e") == [(1, "EXACT", "x", True), (2, "y", "y", False)]


def test_sequence_join_pairs_repeats(spark):
    left = spark.createDataFrame([(1, 10), (1, 10)], "k int, a int")
    right = spark.createDataFrame([(1, 7), (1, 8)], "k int, b int")
    assert rows(J.sequence_join(left, right, ["k"], ["a"], ["b"], "b").select("b"), "b") == [(7,), (8,)]


def test_recency_weights(spark):
    df = spark.createDataFrame([("a", 2023, 0.1), ("a", 2024, 0.2), ("a", 2025, 0.3), ("b", 2023, 0.1), ("b", 2025, 0.3), ("c", 2022, 0.5)], "e string, y int, v double")
    out = {r.e: r.recent for r in A.recency_weighted(df, "e", "y", "v", 2025, [0.5, 0.3, 0.2]).collect()}
    assert out["a"] == pytest.approx(0.23) and out["b"] == pytest.approx(0.17 / 0.7) and out["c"] is None


def test_capitalisation_without_prices(spark):
    df = spark.createDataFrame([("a", 10, 2.0), ("a", 5, None), ("b", 3, None)], "e string, n int, p double")
    assert rows(A.capitalisation(df, "e", "n", "p"), "e") == [("a", 20.0, pytest.approx(10 / 15), False), ("b", None, 0.0, False)]


def test_precise_groups(spark):
    df = spark.createDataFrame([("k", "84.9912", "A", "exact", 100), ("k", "84.9912", "B", "exact", 50), ("k", "84.99", "A", "display", 1), ("k", "84.99", "B", "display", 2)], "e string, a string, t string, p string, n int")
    out = {(r.a, r.kinds): (r.n, r.area_group_id) for r in A.precise_groups(df, "e", "a", "t", "p", "n").collect()}
    assert out["84.9912", "A/B"] == (150, "exclusive_84_9912") and out["84.99", "A"] == (1, "exclusive_84_99_1") and out["84.99", "B"] == (2, "exclusive_84_99_2")


def test_partition_audit(spark):
    ids = lambda *k: spark.createDataFrame([(x,) for x in k], "k int")
    out = {r.k: r.status for r in U.partition_audit([("a", ids(1, 2)), ("b", ids(2, 5))], ids(1, 2, 3), "k").collect()}
    assert out == {1: "OK", 2: "OVERLAP", 3: "LEFTOVER", 5: "STRANGER"}


def test_fixed_effects_recover_a_slope(spark):
    data = [(f"c{c}", c % 3, float(c), 14 + 0.01 * c + (c % 3) + ((i * 7) % 5 - 2) * 1e-3) for c in range(30) for i in range(10)]
    fit = M.fixed_effect_ols(spark.createDataFrame(data, "cluster string, g int, score double, y double"), "y", ["score"], "g", "cluster").first()
    assert fit.coef == pytest.approx(0.01, abs=1e-4) and fit.n == 300 and fit.clusters == 30 and fit.p < 1e-6


def test_p_values():
    assert M.t_p_value(0.0, 5) == pytest.approx(1.0)
    assert M.t_p_value(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert M.t_p_value(12.706204736, 1) == pytest.approx(0.05, abs=1e-8)
    assert M.likelihood_ratio(100, 1.0, math.exp(-3.841458821 / 100), 1)[1] == pytest.approx(0.05, abs=1e-6)


def test_spline_is_a_partition_of_unity(spark):
    total = sum(M.spline_basis(F.col("x"), [0.0, 50.0, 100.0]), F.lit(0.0))
    got = [r[0] for r in spark.range(0, 101, 10).select(F.col("id").cast("double").alias("x")).select(total).collect()]
    assert got == pytest.approx([1.0] * 11)


def test_bootstrap_is_repeatable(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(9)] + [("b", None)], "k string, v double")
    one, two = (rows(M.bootstrap_medians(df, "k", "v", 40), "k") for _ in range(2))
    assert one == two and one[0][0] == "a" and one[0][3] <= 4.0 <= one[0][5]


def test_label_agreement_of_permuted_labels(spark):
    df = spark.createDataFrame([(0, 2), (0, 2), (1, 0), (1, 0), (2, 1)], "a int, b int")
    r = M.label_agreement(df, "a", "b").first()
    assert r.ari == pytest.approx(1.0) and r.nmi == pytest.approx(1.0)


def test_csv_in_a_legacy_encoding(spark, tmp_path):
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    (tmp_path / "a.csv").write_bytes("이름,값\n부산,1\n,2\n".encode("cp949"))
    df = S.read_csv(spark, f"file://{tmp_path}/a.csv", ["name", "value"], "MS949")
    assert rows(df, "value") == [("부산", "1"), ("", "2")]
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}/a.csv")
    assert S.decoded(files).first().text.startswith("이름")


def test_disclosure_record(spark):
    page = lambda body: f"<table>{body}</table>"
    df = spark.createDataFrame([(1, page("<tr><td>total</td><td>5</td></tr>")), (2, page("<tr><td>x</td></tr>")), (3, page("<tr><td>total</td><td>1</td></tr>" * 2))], "k int, h string")
    assert rows(S.disclosure_record(df, "k", "h", ["n"], "total"), "k") == [(1, "5", "AVAILABLE"), (2, None, "NO_TOTAL"), (3, None, "SEVERAL_TOTALS")]


def test_publish_archive_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "k int, c string")
    folder = f"file://{tmp_path}/out"
    K.publish(df.limit(1), folder)
    K.publish(df, folder)
    assert K.read_published(spark, folder).count() == 3
    K.archive(df, "c", f"file://{tmp_path}/history")
    K.archive(df.unionByName(spark.createDataFrame([(4, "z")], "k int, c string")), "c", f"file://{tmp_path}/history")
    assert spark.read.parquet(f"file://{tmp_path}/history").count() == 3
    m = S.manifest(spark, f"file://{tmp_path}/history")
    assert {r.state for r in S.compared_manifests(m, m).collect()} == {"UNCHANGED"}
    with pytest.raises(ValueError):
        K.release({"t": df}, f"file://{tmp_path}/r", gate=False)
    assert K.release({"t": df}, f"file://{tmp_path}/r", gate=True).count() > 0


def test_relations_and_promotion(spark):
    df = spark.createDataFrame([("exact",), ("조건부",), ("??",), (None,)], "t string")
    assert [tuple(r) for r in df.select(X.relation_type(F.col("t")), X.relation_weight(X.relation_type(F.col("t")))).collect()] == [("EXACT", 1.0), ("CONDITIONAL", 0.5), ("UNRESOLVED", 0.0), ("UNRESOLVED", 0.0)]
    p = spark.createDataFrame([(1, "m", "m", ["m"]), (2, "m", "n", ["m"]), (3, "m", "m", ["m", "n"]), (4, None, None, [])], "k int, b string, g string, o array<string>")
    assert [r.promoted for r in X.promoted(p, "k", "b", "g", "o").orderBy("k").collect()] == [True, False, False, False]


def test_layouts_and_cells(spark):
    lines = spark.createDataFrame([(1, 1, "[1군]"), (1, 2, "가초 - 나중, 다중"), (1, 3, "라초"), (1, 4, " - 마중"), (1, 5, "[2군]"), (1, 6, "바초 - 사중")], "d int, n int, t string")
    got = rows(X.layout_rows(lines, "d", "n", "t", r"^\[(.+)\]$", "-").select("group", "left", "right"), "group", "left", "right")
    assert got == [("1군", "가초", "나중"), ("1군", "가초", "다중"), ("1군", "라초", "마중"), ("2군", "바초", "사중")]
    cells = spark.createDataFrame([(1, "a, b", "c", "x/y"), (2, None, "d", "z")], "k int, coed string, boys string, area string")
    assert len(rows(X.expanded_cells(cells, "k", {"coed": "COED", "boys": "BOYS"}, "area"), "k")) == 7
    heads = X.header_columns(spark.createDataFrame([(["No.", "Name ", "School name"],)], "c array<string>"), "c", spark.createDataFrame([("name", "name"), ("no", "number")], "alias string, column string"))
    assert rows(heads, "column") == [("name", 1), ("number", 0)]


def test_geocodes_and_coordinates(spark):
    schema = "k int, c struct<gu: string, road: string>, d struct<gu: string, road: string>"
    df = spark.createDataFrame([(1, ("a", "r"), ("a", "r")), (2, ("a", "r"), ("b", "r")), (3, ("a", "r"), ("a", None))], schema)
    assert rows(X.geocode_check(df, "c", "d", ["gu", "road"]).select("k", "status", "reasons"), "k") == [(1, "CONFIRMED", ""), (2, "REJECTED", "gu_DIFFERS"), (3, "REVIEW", "road_DIFFERS")]
    at = spark.createDataFrame([(1, 35.1, 129.0, "a"), (2, 35.1, 129.0, "b"), (3, 0.0, 0.0, "a"), (4, None, 1.0, "a")], "k int, lat double, lon double, g string")
    assert rows(X.coordinate_flags(at, "lat", "lon", "g", (34.0, 128.0, 36.0, 130.0)).select("k", "valid", "shared"), "k") == [(1, True, True), (2, True, True), (3, False, False), (4, False, False)]


def test_name_similarity(spark):
    df = spark.createDataFrame([(1, "Sun Park", "Sun Park 2"), (2, "해 1차", "해 2차"), (3, "abcd", "bcde"), (4, None, "x")], "k int, a string, b string")
    got = dict(rows(df.select("k", X.similarity(F.col("a"), F.col("b"))), "k"))
    assert got[1] >= 0.9 and got[2] == 0.0 and got[3] == pytest.approx(0.75) and got[4] is None


def test_selected_model(spark):
    schema = "model string, rmse double, mae double, monotone boolean"
    pick = lambda *r: M.selected_model(spark.createDataFrame(r, schema), "linear").where("chosen").first().model
    assert pick(("linear", 1.0, 1.0, True), ("spline", 0.99, 0.99, True), ("bins", 0.9, 0.9, False)) == "spline"
    assert pick(("linear", 1.0, 1.0, True), ("spline", 0.999, 0.9, True)) == "linear"


def test_cohort_growth_counts_all_rows_of_both_years(spark):
    df = spark.createDataFrame([("a", 1, 10, 0), ("a", 2, 0, 20), ("b", 2, 0, 10), ("c", 1, 30, 0)], "k string, yr int, g0 int, g1 int")
    (r,) = A.cohort_growth(df, "k", "yr", ["g0", "g1"]).collect()
    assert (r.k, r.raw) == ("a", pytest.approx(1.0)) and r.growth == pytest.approx(1.0 - (30 / 40 - 1))


def test_trend_is_over_the_year(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 4, 7.0), ("b", 1, 1.0)], "k string, yr int, n double")
    assert [(r.k, r.slope) for r in A.trend(df, "k", "yr", "n").collect()] == [("a", pytest.approx(2.0))]
    assert [(r.k, r.slope) for r in A.trend(df, "k", "yr", "n", by_row=True).collect()] == [("a", pytest.approx(6.0))]


def test_feeder_composite(spark):
    rel = spark.createDataFrame([("x", 1, "EXACT", 80.0), ("x", 2, "CONDITIONAL", 40.0), ("x", 3, "UNRESOLVED", 99.0), ("y", 1, "EXACT", None)], "k string, m int, kind string, score double")
    rel = rel.withColumns({"w": A.by_kind(F.col("kind"), A.RELATION_WEIGHTS), "q": A.by_kind(F.col("kind"), A.RELATION_QUALITY)})
    got = {r.k: r for r in A.feeder_scores(rel, "k", "m", "kind", "score", "w", "q").collect()}
    mean, alone, quality = (80 + 20) / 1.5, 0.4 / 1.5 + 0.3 / 2 + 0.3 / 1.5, (100 + 32.5) / 1.5
    assert got["x"].composite == pytest.approx(0.65 * mean + 0.15 * 40 + 10 * alone + 0.1 * quality) and got["x"].relations == 3
    assert got["y"].composite is None and got["y"].scored == 0


def test_fixed_effects_count_as_explained(spark):
    data = [(c, c % 3, float(c % 7), 2.0 * (c % 3) + 0.1 * (c % 7)) for c in range(60)]
    fit = M.fixed_effect_ols(spark.createDataFrame([(c, None if g == 2 else g, x, y) for c, g, x, y in data], "c int, g int, x double, y double"), "y", ["x"], "g").first()
    assert fit.coef == pytest.approx(0.1) and fit.r2 == pytest.approx(1.0) and fit.r2_within == pytest.approx(1.0) and fit.n == 60


def test_names_resolve_without_pairs(spark):
    items = spark.createDataFrame([(1, "a", 5), (2, "b", 5), (3, "b", None), (4, "c", 1), (5, None, 1), (6, "b", 6)], "item int, k string, s int")
    candidates = spark.createDataFrame([(10, "a", 9), (10, "a", None), (20, "b", 5), (21, "b", 6), (22, "b", 6), (23, "b", None), (30, None, 1)], "ident int, k string, s int")
    got = {r.item: (r.ident, r.status) for r in J.resolve_names(items, candidates, "item", "k", "s", "ident").collect()}
    assert got == {1: (10, "UNIQUE"), 2: (20, "BY_SECOND"), 3: (None, "AMBIGUOUS"), 4: (None, "NO_CANDIDATE"), 5: (None, "NO_CANDIDATE"), 6: (None, "AMBIGUOUS")}
