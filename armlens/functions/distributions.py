"""Tail probabilities that Spark SQL lacks, as column expressions.

The normal and chi-square tails are SQL text and run in the JVM; the F tail needs a continued fraction and is an
Arrow-batched function over whole batches. They are applied to result-sized tables (one row per experiment,
feature or look), never to the log. NULL and NaN in give NULL out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Cody's rational approximations of the error function (Math. Comp. 23, 1969), numerators and
# denominators, highest power first; up to 0.46875, up to 4, and beyond. Errors are a few units in the last place.
_NEAR = ((1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3),
         (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3))
_MIDDLE = ((2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2,
            8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
           (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
            3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3))
_FAR = ((1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1,
         1.60837851487422766e-2, 6.58749161529837803e-4),
        (1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3))
_ROOT_HALF = math.sqrt(0.5)
_ROOT_PI = 1.0 / math.sqrt(math.pi)


def _double(value) -> Column:
    """A column or its name as a double, NULL for NaN."""
    value = F.col(value) if isinstance(value, str) else value
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def _bound(value: Column, body: str) -> Column:
    """SQL text ``body`` of a value ``v`` that is computed once, however often the body mentions it; NULL for NULL.

    Text, because hundreds of operators are slow to build one call at a time.
    """
    once = F.call_function("transform", F.array(value), F.expr(f"v -> {body}"))
    return F.get(once, F.lit(0))


def _polynomial(coefficients: Sequence[float], x: str) -> str:
    out = f"{coefficients[0]!r}D"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}D)"
    return out


def _fraction(parts: tuple[Sequence[float], Sequence[float]], x: str) -> str:
    return f"({_polynomial(parts[0], x)} / {_polynomial(parts[1], x)})"


def _erfc(x: str) -> str:
    """The complementary error function of a value of 0 or more."""
    # exp(-x^2) in two factors, the first exact, so that no digits of a large square are lost.
    head = f"(floor({x} * 16) / 16D)"
    square = f"(exp(-{head} * {head}) * exp(({head} - {x}) * ({head} + {x})))"
    inverse = f"(1D / ({x} * {x}))"
    return (
        f"(CASE WHEN {x} <= 0.46875D THEN 1D - {x} * {_fraction(_NEAR, f'({x} * {x})')} "
        f"WHEN {x} <= 4D THEN {square} * {_fraction(_MIDDLE, x)} "
        f"WHEN {x} < 30D THEN {square} * ({_ROOT_PI!r}D - {inverse} * {_fraction(_FAR, inverse)}) / {x} "
        f"WHEN {x} >= 30D THEN 0D END)"
    )


_TWO_SIDED = _erfc(f"(abs(v) * {_ROOT_HALF!r}D)")
# Mills-ratio expansion: erfc underflows out here but its logarithm does not.
_LOG_FAR = (
    f"({math.log(2.0) - 0.5 * math.log(2.0 * math.pi)!r}D - 0.5D * v * v - ln(abs(v)) + log1p(-1D / (v * v) + 3D / (v * v * v * v)))"
)


def normal_sf(z) -> Column:
    """P(Z > z) for a standard normal."""
    return _bound(_double(z), f"CASE WHEN v >= 0 THEN 0.5D * {_TWO_SIDED} ELSE 1D - 0.5D * {_TWO_SIDED} END")


def two_sided_p(z) -> Column:
    """P(|Z| > |z|) for a standard normal."""
    return _bound(_double(z), _TWO_SIDED)


def log10_two_sided_p(z) -> Column:
    """log10 of the two-sided p-value; finite where the p-value itself underflows."""
    return _bound(_double(z), f"CASE WHEN abs(v) < 30D THEN log10({_TWO_SIDED}) ELSE {_LOG_FAR} / {math.log(10.0)!r}D END")


def chi2_sf(x, df) -> Column:
    """Upper tail of chi-square with an integer number of degrees of freedom.

    A finite sum of terms half^k exp(-half) / Gamma(k + 1), each from the one before by its logarithm.
    """
    df = (F.col(df) if isinstance(df, str) else df).cast("int")
    half, odd = "(v.x / 2D)", "v.df % 2 = 1"
    start = (
        f"named_struct('sum', CASE WHEN {odd} THEN {_erfc(f'sqrt({half})')} ELSE 0D END, "
        f"'term', CASE WHEN {odd} THEN 0.5D * ln({half}) - {half} - {math.lgamma(1.5)!r}D ELSE -{half} END)"
    )
    step = (
        "(s, k) -> named_struct('sum', s.sum + exp(s.term), "
        f"'term', s.term + ln({half}) - ln(k + 1D + CASE WHEN {odd} THEN 0.5D ELSE 0D END))"
    )
    powers = "slice(sequence(0, v.df div 2), 1, CAST(v.df div 2 AS INT))"
    tail = f"CASE WHEN v.x <= 0 THEN 1D WHEN v.x > 0 AND v.df >= 0 THEN least(1D, aggregate({powers}, {start}, {step}, s -> s.sum)) END"
    return _bound(F.struct(_double(x).alias("x"), df.alias("df")), tail)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma of values over 0: Stirling's series after a shift to 12 or more."""
    shift = np.zeros_like(x)
    while (small := x < 12.0).any():
        shift = np.where(small, shift + np.log(np.where(small, x, 1.0)), shift)
        x = np.where(small, x + 1.0, x)
    inverse = 1.0 / (x * x)
    series = (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse * (1 / 1680 - inverse * (1 / 1188 - inverse * 691 / 360360))))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2.0 * math.pi) + series - shift


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz), all values side by side."""
    tiny = 1e-300
    away = lambda v: np.where(np.abs(v) > tiny, v, tiny)
    c, d = np.ones_like(x), 1.0 / away(1.0 - (a + b) * x / (a + 1.0))
    h = d.copy()
    for m in range(1, 2000):
        even = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
        for step in (even, odd):
            d = 1.0 / away(1.0 + step * d)
            c = away(1.0 + step / c)
            h = h * c * d
        if (np.abs(c * d - 1.0) < 1e-15).all():
            break
    return h


def _incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Regularised I_x(a, b), and whether x is inside of (0, 1); ``y`` is 1 - x, passed separately to keep its digits."""
    inside = (x > 0.0) & (y > 0.0)
    x, y = np.where(inside, x, 0.5), np.where(inside, y, 0.5)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log(y))
    low = x < (a + 1.0) / (a + b + 2.0)
    first, second, at = np.where(low, a, b), np.where(low, b, a), np.where(low, x, y)
    part = front * _beta_fraction(first, second, at) / first
    return np.where(low, part, 1.0 - part), inside


@F.pandas_udf(DoubleType())
def f_sf(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    """Upper tail of the F distribution."""
    v, a, b = (s.to_numpy(dtype=float, na_value=np.nan) for s in (f, df1, df2))
    known = ~np.isnan(v) & (a > 0) & (b > 0)
    v, a, b = (np.where(known, s, 1.0) for s in (v, a, b))
    positive = np.where(v > 0, v, 1.0)
    # Divided through by the greater term, so that an infinite F has a tail of 0.
    x, y = 1.0 / (1.0 + a * positive / b), 1.0 / (1.0 + b / (a * positive))
    tail, inside = _incomplete_beta(b / 2.0, a / 2.0, x, y)
    tail = np.where(v <= 0, 1.0, np.where(inside, tail, np.where(x <= 0, 0.0, 1.0)))
    return pd.Series(np.where(known, tail, np.nan), dtype="float64").where(pd.Series(known), None)
