"""Signals of value, rule by rule."""

from pyspark.sql import functions as F

from marlstone.operators import signals as S


def told(spark, rows, schema, **columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*(c.alias(k) for k, c in columns.items())).collect()]


def test_signs_and_intervals(spark):
    rows = [(5.0, 5.0, 1.0, 9.0), (-5.0, -4.0, -9.0, -1.0), (2.0, -4.0, -9.0, 9.0), (None, 4.0, None, 9.0), (4.0, 4.0, -1.0, 9.0), (-4.0, 3.0, -9.0, 1.0), (0.0, 1.0, -1.0, 1.0)]
    got = told(spark, rows, "p double, q double, lo double, hi double", sign=S.signed(F.col("p")), both=S.both_windows(F.col("p"), F.col("q")), interval=S.interval_signal(F.col("p"), F.col("lo"), F.col("hi")))
    assert got == [
        ("POSITIVE", "STABLE_POSITIVE", "STRONG_UNDERVALUED_SIGNAL"), ("NEGATIVE", "STABLE_NEGATIVE", "STRONG_OVERVALUED_SIGNAL"), ("NEUTRAL", "MIXED", "WITHIN_MODEL_RANGE"), ("MISSING", "INSUFFICIENT", "INSUFFICIENT"),
        ("POSITIVE", "STABLE_POSITIVE", "POTENTIAL_UNDERVALUED_SIGNAL"), ("NEGATIVE", "MIXED", "POTENTIAL_OVERVALUED_SIGNAL"), ("NEUTRAL", "MIXED", "WITHIN_MODEL_RANGE"),
    ]


def test_combinations(spark):
    rows = [("POSITIVE", "POSITIVE"), ("NEGATIVE", "POSITIVE"), ("POSITIVE", "NEUTRAL"), ("NEGATIVE", "NEGATIVE"), ("MISSING", "POSITIVE"), ("NEUTRAL", "NEUTRAL")]
    got = told(spark, rows, "s string, l string", c=S.together(F.col("s"), F.col("l")))
    assert [x for (x,) in got] == ["DOUBLE_POSITIVE", "LOCAL_ONLY_POSITIVE", "SCORE_ONLY_POSITIVE", "DOUBLE_NEGATIVE", "MIXED_OR_NEUTRAL", "MIXED_OR_NEUTRAL"]


KIND = "id int, m string, level int, confidence string, width_pct double, fair double, fair_low double, fair_high double, price_6m double, price_12m double, deals_12m int, comparable_entities int, recent_residual double, score_gap double, score_confidence string, positive double, quality string"


def test_classes(spark):
    base = ("m1", 0, "HIGH", 40.0, 110.0, 90.0, 130.0, 100.0, 100.0, 9, 9, -0.1, 6.0, "HIGH", 0.9, "OK")

    def row(i, **change):
        names = [x.split()[0] for x in KIND.split(", ")][1:]
        return (i, *(change.get(n, v) for n, v in zip(names, base, strict=True)))

    rows = [
        row(1), row(2, score_gap=None, score_confidence=None, positive=None), row(3, fair=90.0, fair_high=120.0), row(4, fair=80.0, fair_low=70.0, fair_high=90.0, score_gap=-9.0),
        row(5, m="m2", fair=190.0, fair_low=150.0, fair_high=220.0, recent_residual=-0.5), row(6, price_12m=None, price_6m=None), row(7, quality="INSUFFICIENT_MODEL_FEATURES"), row(8, deals_12m=2), row(9, price_6m=115.0), row(10, positive=0.5), row(11, confidence="LOW"),
    ]
    got = {r.id: r for r in S.dual_signals(spark.createDataFrame(rows, KIND), "m").collect()}
    assert {i: r["class"] for i, r in got.items()} == {
        1: "ROBUST_DUAL_POSITIVE", 2: "LOCAL_VALUE_CANDIDATE", 3: "SCORE_VALUE_CANDIDATE", 4: "NEGATIVE_OR_FULLY_PRICED", 5: "UNCERTAIN", 6: "SCORE_VALUE_CANDIDATE", 7: "UNCERTAIN", 8: "UNCERTAIN", 9: "UNCERTAIN", 10: "UNCERTAIN", 11: "UNCERTAIN"
    }
    assert got[5].extreme and got[5].biased and not got[1].biased and got[5].audit_priority == "HIGH" and got[1].audit_priority == "LOW"
    assert got[1].local_confidence == "HIGH" and got[8].local_confidence == "LOW" and got[9].stability == "MIXED" and got[6].local_sign == "MISSING"
    assert S.dual_signals(spark.createDataFrame(rows, KIND).limit(0), "m").count() == 0
    assert S.dual_signals(spark.createDataFrame([row(1, confidence="LOW")], KIND), "m").first()["class"] == "UNCERTAIN"
