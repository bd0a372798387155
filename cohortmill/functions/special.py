"""Special functions as column expressions, so that distributions stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the rational Chebyshev approximations of erf and erfc published by W. J. Cody in 1969.
ERF_NUMERATOR = (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1)
ERF_DENOMINATOR = (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
MIDDLE_NUMERATOR = (5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8)
MIDDLE_DENOMINATOR = (1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03)
FAR_NUMERATOR = (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2)
FAR_DENOMINATOR = (2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)
ONE_OVER_ROOT_PI = 5.6418958354775628695e-1


def _ratio(x: Column, above: Sequence[float], below: Sequence[float]) -> Column:
    """A quotient of polynomials: the last number above leads, the denominator leads with 1."""
    top, bottom = F.lit(above[-1]), F.lit(1.0)
    for a, b in zip(above[:-1], below):
        top, bottom = top * x + a, bottom * x + b
    return top / bottom


def erfc(x: Column) -> Column:
    """The complementary error function, to about 1e-15 of its value; null for null."""
    y = F.abs(x)
    near = 1 - x * _ratio(x * x, ERF_NUMERATOR, ERF_DENOMINATOR)
    # exp(-y * y) from a part that squares without rounding and a small rest
    part = F.floor(y * 16) / 16.0
    decay = F.exp(-part * part) * F.exp(-(y - part) * (y + part))
    inverse = 1 / (y * y)
    middle = decay * _ratio(y, MIDDLE_NUMERATOR, MIDDLE_DENOMINATOR)
    far = decay * (ONE_OVER_ROOT_PI - inverse * _ratio(inverse, FAR_NUMERATOR, FAR_DENOMINATOR)) / y
    tail = F.when(y <= 4, middle).otherwise(far)
    return F.when(y <= 0.46875, near).when(x < 0, 2 - tail).otherwise(tail)
