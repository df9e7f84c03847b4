"""Inverse normal CDF as a pure column expression.

Rational approximation PPND16 published by Wichura (1988), "Algorithm AS 241: The Percentage
Points of the Normal Distribution", Applied Statistics 37(3).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: published coefficients, lowest order first
CENTRAL_NUM = [
    3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
    1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
    3.3430575583588128105e4, 2.5090809287301226727e3,
]
CENTRAL_DEN = [
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
    5.2264952788528545610e3,
]
NEAR_NUM = [
    1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
    3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
    2.27238449892691845833e-2, 7.74545014278341407640e-4,
]
NEAR_DEN = [
    1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
    1.05075007164441684324e-9,
]
FAR_NUM = [
    6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
    2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
    2.71155556874348757815e-5, 2.01033439929228813265e-7,
]
FAR_DEN = [
    1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
    7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
    2.04426310338993978564e-15,
]


def _poly(coefficients: list[float], x: Column) -> Column:
    value = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        value = value * x + F.lit(c)
    return value


def _from_parts(q: Column, tail: Column) -> Column:
    r = F.lit(0.180625) - q * q
    near, far = tail - F.lit(1.6), tail - F.lit(5.0)
    outer = F.when(tail <= 5.0, _poly(NEAR_NUM, near) / _poly(NEAR_DEN, near)).otherwise(
        _poly(FAR_NUM, far) / _poly(FAR_DEN, far)
    )
    return F.when(
        F.abs(q) <= 0.425, q * _poly(CENTRAL_NUM, r) / _poly(CENTRAL_DEN, r)
    ).otherwise(F.signum(q) * outer)


def _parts(p: Column) -> tuple[Column, Column]:
    q = p - F.lit(0.5)
    return q, F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))


def norm_ppf(p: Column) -> Column:
    """Standard normal quantile of ``p``; NULL outside the open interval (0, 1)."""
    return F.when((p > 0) & (p < 1), _from_parts(*_parts(p)))


def with_norm_ppf(df: DataFrame, p: str, out: str) -> DataFrame:
    """:func:`norm_ppf` of a column, with the repeated terms as columns of their own.

    The same numbers with a far smaller expression tree, since each term is written once.
    """
    q, tail = _parts(F.col(p))
    staged = df.withColumns({"_q": q, "_tail": tail})
    z = F.when((F.col(p) > 0) & (F.col(p) < 1), _from_parts(F.col("_q"), F.col("_tail")))
    return staged.withColumn(out, z).drop("_q", "_tail")
