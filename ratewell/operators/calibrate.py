"""Standard curves: doses, line fits, inverse prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewell import scale
from ratewell.functions import distributions
from ratewell.functions.lines import intercept, inverse_prediction, known, line_sums, r_squared, slope
from ratewell.functions.text import token


def dose_from_label(
    label: Column | str, position: int = -1, sep: str = "_", stock_mm: float = 8.0, well_ul: float = 200.0
) -> dict[str, Column]:
    """Dose columns from the volume written in a standard's label."""
    microlitres = token(label, sep, position).try_cast("double")
    millimolar = microlitres * F.lit(stock_mm / well_ul)
    nanomolar = millimolar * 1e6
    return {"ul": microlitres, "mm": millimolar, "nm": nanomolar,
            "nmol": nanomolar * (1 / 1000) * (1 / 1000) * well_ul}


def fit_line(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least-squares line of ``y`` on ``x`` per key, with its summary statistics.

    One aggregation that combines in the map tasks. Standard errors need three
    points and are NULL below that. ``with_p_values`` adds probabilities.
    """
    fx, fy = known(F.col(x).cast("double")), known(F.col(y).cast("double"))
    paired = fx.isNotNull() & fy.isNotNull()
    sums = df.groupBy(*keys).agg(
        *line_sums(fx, fy),
        F.min(F.when(paired, fx)).alias("x_min"), F.max(F.when(paired, fx)).alias("x_max"),
    )
    freedom = F.when(F.col("n") > 2, F.col("n") - 2)
    off_centre = F.try_divide(F.col("x_mean") * F.col("x_mean"), F.col("sxx"))
    return (
        sums.withColumns({"b": intercept(), "m": slope(), "r2": r_squared()})
        .withColumn("_s2", (F.col("syy") - F.col("m") * F.col("sxy")) / freedom)
        .withColumns({
            "residual_se": F.sqrt("_s2"),
            "se_m": F.sqrt(F.try_divide("_s2", "sxx")),
            "se_b": F.sqrt(F.col("_s2") * (1 / F.col("n") + off_centre)),
        })
        .withColumns({"t_m": F.try_divide("m", "se_m"), "t_b": F.try_divide("b", "se_b")})
        .withColumns({
            "f": F.col("t_m") * F.col("t_m"),
            "adj_r2": 1 - (1 - F.col("r2")) * (F.col("n") - 1) / freedom,
        })
        .drop("syy", "sxy", "y_mean", "_s2")
    )


def with_p_values(fit: DataFrame) -> DataFrame:
    """Lines with ``p_m``, ``p_b``, ``p_f``: how probable t and F at least as extreme are without a slope, intercept or line.

    NULL where there are no degrees of freedom or the line leaves nothing over.
    """
    freedom = F.when(F.col("n") > 2, F.col("n") - 2)
    return fit.withColumns({
        "p_m": distributions.t_two_sided(F.col("t_m"), freedom),
        "p_b": distributions.t_two_sided(F.col("t_b"), freedom),
        "p_f": distributions.f_upper(F.col("f"), freedom)})


def fitted_line(
    fit: DataFrame, points: int = 80, t_critical: float | None = None, level: float | None = None
) -> DataFrame:
    """Fitted values on an even grid over the fitted range, with a confidence band for the line.

    ``level`` (0.95) asks for a band by each line's own degrees of freedom, ``t_critical`` gives the critical value.
    """
    if t_critical is not None and level is not None:
        raise ValueError("give a level or a critical value, not both")
    if level is not None:
        fit = fit.withColumn("_critical", distributions.t_critical(level, F.when(F.col("n") > 2, F.col("n") - 2)))
    step = (F.col("x_max") - F.col("x_min")) / (points - 1)
    grid = (
        fit.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("x", F.col("x_min") + step * F.col("point"))
        .withColumn("fit", F.col("b") + F.col("m") * F.col("x"))
    )
    if t_critical is None and level is None:
        return grid
    critical = F.lit(t_critical) if level is None else F.col("_critical")
    off = F.col("x") - F.col("x_mean")
    half = critical * F.col("residual_se") * F.sqrt(1 / F.col("n") + F.try_divide(off * off, F.col("sxx")))
    return grid.withColumn("lower", F.col("fit") - half).withColumn("upper", F.col("fit") + half).drop("_critical")


def apply_calibration(df: DataFrame, fit: DataFrame, on: list[str], value: str, out: str = "nmol") -> DataFrame:
    """Amount from absorbance with the line of the row's own assay; NULL where the assay has none."""
    line = fit.select(*on, F.col("b").alias("_b"), F.col("m").alias("_m"))
    return (
        scale.join_dimension(df, line, on, "left")
        .withColumn(out, inverse_prediction(F.col(value), F.col("_b"), F.col("_m")))
        .drop("_b", "_m")
    )


def apply_fixed(df: DataFrame, b: float, m: float, value: str, out: str = "nmol") -> DataFrame:
    """Amount from absorbance with coefficients given by the caller."""
    return df.withColumn(out, inverse_prediction(F.col(value), F.lit(b), F.lit(m)))
