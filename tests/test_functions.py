from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from wellspan import functions as fn


def values(df):
    return [r[0] for r in df.collect()]


def test_norm_ppf_matches_the_standard_library(spark):
    ps = [1e-12, 1e-6, 0.003, 0.02, 0.0749, 0.0751, 0.3, 0.5, 0.61, 0.9249, 0.9251, 0.99, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    plain = values(df.select(fn.norm_ppf(F.col("p"))))
    staged = values(fn.with_norm_ppf(df, "p", "z").select("z"))
    for p, a, b in zip(ps, plain, staged):
        want = NormalDist().inv_cdf(p)
        assert a == pytest.approx(want, abs=1e-12, rel=1e-12)
        assert b == a


def test_norm_ppf_is_null_outside_the_open_interval(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (-0.5,), (None,)], "p double")
    assert values(df.select(fn.norm_ppf(F.col("p")))) == [None] * 4


def test_severity_ladder(spark):
    z = [-2.0, -1.5, -1.0, 0.99, 1.0, 1.5, 2.0, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in z], "z double")
    assert values(df.select(fn.severity_label(F.col("z")))) == [
        "Extreme drought", "Severe drought", "Moderate drought", "Normal", "Moderately wet", "Very wet",
        "Extremely wet", None, None,
    ]
    assert values(df.select(fn.severity_color(F.col("z"))))[0] == "#67001f"


def test_skill_and_calibration_labels(spark):
    df = spark.createDataFrame([(0.49,), (0.79,), (0.99,), (1.0,), (None,)], "x double")
    assert values(df.select(fn.skill_label(F.col("x")))) == ["strong", "useful", "weak", "no better than the mean", None]
    df = spark.createDataFrame([(1.2,), (1.5,), (2.0,)], "x double")
    assert values(df.select(fn.blowup_label(F.col("x")))) == [
        "errors uniform", "some large misses", "dominated by big blow-ups",
    ]
    df = spark.createDataFrame([(0.85,), (0.5,), (0.99,)], "x double")
    assert values(df.select(fn.calibration_label(F.col("x"), 0.8))) == ["well calibrated", "overconfident", "too vague"]


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(0.125,), (-0.125,), (2.675,)], "x double")
    assert values(df.select(fn.round_half_even(F.col("x"), 2))) == [0.12, -0.12, 2.68]


def test_day_ring(spark):
    ring = spark.range(1).select(fn.doy_ring(F.lit(1), 15).alias("r")).first()["r"]
    assert set(ring) == set(range(352, 367)) | set(range(1, 17)) and len(ring) == 31


def test_clip_keeps_null_and_ratio_survives_zero(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (2.0,)], "x double")
    assert values(df.select(fn.clip_low(F.col("x")))) == [None, 0.0, 2.0]
    assert values(df.select(fn.ratio(F.col("x"), F.lit(0.0)))) == [None, None, None]


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 9.0)], "a double, b double")
    assert df.agg(fn.corr_safe(F.col("a"), F.col("b"))).first()[0] is None


def test_list_text_and_names(spark):
    df = spark.createDataFrame([("['A','B']",), ("plain",), (None,)], "s string")
    assert values(df.select(fn.join_list_text(F.col("s")))) == ["A, B", "plain", None]
    df = spark.createDataFrame([("77AB12/F4-3",)], "s string")
    assert values(df.select(fn.safe_name(F.col("s")))) == ["77AB12F4-3"]


def test_typed_parameters_drop_unknown_keys(spark):
    df = spark.createDataFrame(
        [({"changepoint_prior_scale": "0.3", "yearly_seasonality": "True", "seasonality_mode": "additive", "evil": "1"},)],
        "p map<string,string>",
    )
    row = df.select(fn.typed_params(F.col("p")).alias("p")).select("p.*").first().asDict()
    assert row["changepoint_prior_scale"] == 0.3 and row["yearly_seasonality"] is True
    assert row["seasonality_mode"] == "additive" and row["interval_width"] is None and "evil" not in row


def test_unparsable_date_is_null(spark):
    df = spark.createDataFrame([("2024-02-29",), ("2024-02-29 13:00:00",), ("junk",)], "s string")
    assert [str(v) for v in values(df.select(fn.as_date("s")))] == ["2024-02-29", "2024-02-29", "None"]
