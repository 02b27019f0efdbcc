"""Least-squares line expressions, grouped or over a window frame.

The sums are columns of their own, so that each is computed once per row and
the line is plain arithmetic on them.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

SUMS = ["n", "sxx", "sxy", "syy", "x_mean", "y_mean"]


def known(value: Column | str) -> Column:
    """The value, with NaN as NULL: a read that is no number is missing."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(value), value)


def line_sums(x: Column, y: Column, frame: WindowSpec | None = None) -> list[Column]:
    """Centred sums and means over the pairs without NULL or NaN, named as in ``SUMS``."""
    x, y = known(x), known(y)
    functions = [F.regr_count, F.regr_sxx, F.regr_sxy, F.regr_syy, F.regr_avgx, F.regr_avgy]
    terms = [f(y, x) for f in functions]
    return [(t if frame is None else t.over(frame)).alias(name) for t, name in zip(terms, SUMS)]


def slope() -> Column:
    """Slope from the sums; NULL for a constant ``x``."""
    return F.try_divide("sxy", "sxx")


def intercept() -> Column:
    """Intercept from the sums."""
    return F.col("y_mean") - F.try_divide("sxy", "sxx") * F.col("x_mean")


def r_squared() -> Column:
    """R2 from the sums; NULL for a constant ``y``, where it is 0/0."""
    return F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx") * F.col("syy"))


def inverse_prediction(value: Column, b: Column, m: Column) -> Column:
    """Amount whose absorbance is ``value`` on the line ``b + m * amount``."""
    return F.try_divide(value - b, m)
