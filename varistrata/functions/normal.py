"""The quantile of the standard normal as a rational function: for numpy arrays, Spark columns and SQL text alike.

Wichura's algorithm AS 241 (Applied Statistics 37, 1988), with about 16 digits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The published coefficients, lowest power first: numerator and denominator near the middle, towards the ends and at the ends.
MIDDLE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
TOWARDS = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
ENDS = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)
SPLIT, CENTRE, FAR, NEAR = 0.425, 0.180625, 5.0, 1.6


def _power_sum(coefficients, x):
    out = coefficients[-1]
    for c in coefficients[-2::-1]:
        out = out * x + c
    return out


def _ratio(parts, x):
    return _power_sum(parts[0], x) / _power_sum(parts[1], x)


def quantile(p: np.ndarray) -> np.ndarray:
    """Infinite at 0 and 1, NaN outside and for NaN."""
    p = np.asarray(p, dtype=float)
    with np.errstate(all="ignore"):
        q = p - 0.5
        r = np.sqrt(-np.log(np.minimum(p, 1 - p)))
        tail = np.where(r <= FAR, _ratio(TOWARDS, r - NEAR), _ratio(ENDS, np.minimum(r, 40.0) - FAR))
        out = np.where(np.abs(q) <= SPLIT, q * _ratio(MIDDLE, CENTRE - q * q), np.where(q < 0, -tail, tail))
    out = np.where(p == 0, -np.inf, np.where(p == 1, np.inf, out))
    return np.where((p >= 0) & (p <= 1), out, np.nan)


def with_quantile(df: DataFrame, p: str, out: str) -> DataFrame:
    """df with the quantile of a column with values between 0 and 1, inside generated code; NULL stays.

    The powers are taken of columns of their own, or the expression would hold its own input some hundred times.
    """
    q = F.col(p) - 0.5
    r = F.sqrt(-F.log(F.least(F.col(p), 1 - F.col(p))))
    staged = df.withColumns({"_q": q, "_r": r}).withColumns({"_centre": CENTRE - F.col("_q") * F.col("_q"), "_near": F.col("_r") - NEAR, "_far": F.col("_r") - FAR})
    tail = F.when(F.col("_near") <= FAR - NEAR, _ratio(TOWARDS, F.col("_near"))).otherwise(_ratio(ENDS, F.col("_far")))
    value = F.when(F.abs("_q") <= SPLIT, F.col("_q") * _ratio(MIDDLE, F.col("_centre"))).otherwise(F.signum("_q") * tail)
    return staged.withColumn(out, value).drop("_q", "_r", "_centre", "_near", "_far")


def sql(p: str) -> str:
    """The same as SQL text; p is a plain column name or a number."""

    def power_sum(coefficients, x: str) -> str:
        out = repr(coefficients[-1])
        for c in coefficients[-2::-1]:
            out = f"({out} * {x} + {c!r})"
        return out

    ratio = lambda parts, x: f"{power_sum(parts[0], x)} / {power_sum(parts[1], x)}"
    r = f"sqrt(-ln(least({p}, 1 - {p})))"
    tail = f"sign({p} - 0.5) * CASE WHEN {r} <= {FAR} THEN {ratio(TOWARDS, f'({r} - {NEAR})')} ELSE {ratio(ENDS, f'({r} - {FAR})')} END"
    return f"CASE WHEN abs({p} - 0.5) <= {SPLIT} THEN ({p} - 0.5) * {ratio(MIDDLE, f'({CENTRE} - ({p} - 0.5) * ({p} - 0.5))')} ELSE {tail} END"
