"""The three analyses: kinetic assay, condition curve, activity screen.

Assay, plate and condition are columns, so one job covers any number of them.
Reads come in long form: key columns, ``label``, ``minutes``, ``absorbance``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewell import scale
from ratewell.functions.text import token
from ratewell.operators import calibrate, controls, layout, normalize, rates


@dataclass(frozen=True)
class RateSettings:
    """Trim, window and gates of the sliding fit."""

    first_read: int = 1
    last_read: int = 30
    window: int = 5
    min_r2: float | None = 0.9
    min_slope: float | None = 0.0
    last_minute: float | None = None


@dataclass(frozen=True)
class StandardSettings:
    """How standards are named and dosed."""

    pattern: str = "stdcurve"
    exclude: str | None = None
    position: int = -1
    stock_mm: float = 8.0
    well_ul: float = 200.0


@dataclass
class AssayResult:
    """Tables of one analysis. Small tables are settled while the plan is built; the rest is lazy."""

    calibration: DataFrame
    progress: DataFrame
    reads: DataFrame
    fits: DataFrame
    rates: DataFrame
    extra: dict[str, DataFrame] = field(default_factory=dict)


def standard_curve(reads: DataFrame, keys: list[str], settings: StandardSettings) -> DataFrame:
    """Calibration line per key from the standard wells of all reads."""
    wells = reads.where(F.col("label").rlike(settings.pattern))
    if settings.exclude is not None:
        wells = wells.where(~F.col("label").rlike(settings.exclude))
    dose = calibrate.dose_from_label(F.col("label"), settings.position,
                                     stock_mm=settings.stock_mm, well_ul=settings.well_ul)
    return calibrate.fit_line(wells.withColumn("nmol", dose["nmol"]), keys, "nmol", "absorbance")


def steepest(
    progress: DataFrame, keys: list[str], series: str, value: str, settings: RateSettings, then: tuple[str, ...] = ()
):
    """Trimmed reads, all window fits and the best window of every series.

    Reads are in the order of minutes and then of ``then``, which must tell apart reads of
    the same minute.
    """
    if settings.last_minute is not None:
        progress = rates.force_last_minute(progress, keys, "minutes", settings.last_minute)
    by = [*keys, series]
    order, longest = ["minutes", *then], settings.last_read - settings.first_read + 1
    reads = rates.trim_reads(progress, by, order, settings.first_read, settings.last_read)
    fits = rates.sliding_fit(reads, by, order, "minutes", value, settings.window, longest=longest)
    return reads, fits, rates.best_window(fits, by, settings.min_r2, settings.min_slope, longest=longest)


def steepest_by(
    progress: DataFrame, keys: list[str], series: str, value: str, condition: str, own: dict[str, RateSettings],
    rest: RateSettings,
):
    """As ``steepest``, with settings by the value of ``condition``, one of ``keys``; all in one pass over the reads."""
    every = [rest, *own.values()]

    def setting(name: str, kind: str) -> Column:
        values = {of: getattr(each, name) for of, each in own.items()}
        return rates.by_condition(condition, values, getattr(rest, name)).cast(kind)

    if any(each.last_minute is not None for each in every):
        progress = rates.force_last_minute(progress, keys, "minutes", setting("last_minute", "double"))
    by, order = [*keys, series], ["minutes"]
    first, last = min(each.first_read for each in every), max(each.last_read for each in every)
    reads = rates.trim_reads(progress, by, order, first, last, out="_place").where(
        F.col("_place").between(setting("first_read", "bigint"), setting("last_read", "bigint"))).drop("_place")
    widths, longest = {each.window for each in every}, last - first + 1
    window = "_window" if len(widths) > 1 else widths.pop()
    fits = rates.sliding_fit(
        reads.withColumn("_window", setting("window", "int")), by, order, "minutes", value, window,
        widest=max(each.window for each in every), longest=longest).drop("_window")
    min_r2, min_slope = setting("min_r2", "double"), setting("min_slope", "double")
    good = fits.where((min_r2.isNull() | (F.col("r2") >= min_r2)) & (min_slope.isNull() | (F.col("slope") > min_slope)))
    return reads, fits, rates.best_window(good, by, longest=longest)


def kinetic_assay(
    reads: DataFrame,
    keys: list[str],
    standards: StandardSettings = StandardSettings(),
    settings: RateSettings = RateSettings(),
    exclude: str = r"stdcurve|Tris|emptvec|buffer",
    calibration: DataFrame | None = None,
) -> AssayResult:
    """Reads to rates: calibrate, average replicates, trim, slide, pick the steepest window.

    ``calibration`` (keys, b, m) replaces the fitted lines.
    """
    line = standard_curve(reads, keys, standards) if calibration is None else calibration
    samples = reads.where(F.col("label").isNotNull() & ~F.col("label").rlike(exclude))
    amounts = calibrate.apply_calibration(samples, line, keys, "absorbance")
    progress = controls.replicate_stats(amounts, [*keys, "label", "minutes"], "nmol")
    trimmed, fits, best = steepest(progress, keys, "label", "mean", settings)
    return AssayResult(line, progress, trimmed, fits, best)


def condition_assay(
    reads: DataFrame,
    keys: list[str],
    pairs: list[tuple[str, str, str]],
    standards: StandardSettings = StandardSettings(),
    settings: RateSettings = RateSettings(window=4, min_r2=None, min_slope=None),
    exclude: str = r"stdcurve|Tris|emptvec",
    calibration: DataFrame | None = None,
    condition: str | None = None,
    by_condition: dict[str, RateSettings] | None = None,
) -> AssayResult:
    """Rates per condition after subtracting each sample's control series.

    The condition (pH, temperature) is one of ``keys``. ``by_condition`` gives values of the
    column ``condition`` a trim, width and gates of their own; all others take
    ``settings``.
    """
    line = standard_curve(reads, keys, standards) if calibration is None else calibration
    samples = reads.where(F.col("label").isNotNull() & ~F.col("label").rlike(exclude))
    amounts = calibrate.apply_calibration(samples, line, keys, "absorbance")
    progress = controls.subtract_control(amounts, [*keys, "minutes"], "label", "nmol", pairs)
    if by_condition is None:
        return AssayResult(line, progress, *steepest(progress, keys, "id", "mean", settings))
    return AssayResult(line, progress, *steepest_by(progress, keys, "id", "mean", condition, by_condition, settings))


def stability_assay(
    reads: DataFrame,
    keys: list[str],
    replicates: int = 3,
    standards: StandardSettings = StandardSettings(position=-2),
    settings: RateSettings = RateSettings(),
    exclude: str = r"stdcurve|Tris|emptvec|buffer",
) -> AssayResult:
    """Rates of every replicate of heated samples; reads come with ``well_idx``.

    Labels get ``_rep1`` .. ``_repN`` in turn over the wells, so replicates stay apart and the
    dose of a standard is the last token but one.
    """
    tagged = reads.withColumn("label", layout.cyclic_replicate(F.col("label"), F.col("well_idx"), replicates))
    return kinetic_assay(tagged, keys, standards, settings, exclude)


def screen(
    reads: DataFrame,
    keys: list[str],
    calibration: DataFrame,
    settings: RateSettings = RateSettings(first_read=30, last_read=327, window=30, min_r2=None),
    blank: str | None = "rfp",
    reference: str = "wt",
    references: tuple[str, ...] = ("wt", "rfp"),
    protein: DataFrame | None = None,
) -> AssayResult:
    """Directed-evolution screen: blank, calibrate, slide, normalise, fold change over a reference.

    Labels read ``colony_substrate_...``. Reads of the same minute go by ``read_idx``, or
    by their amount if there is no such column. ``blank=None`` skips the blank step,
    ``protein`` (sample, nm_per_od) turns rates into turnover numbers.
    """
    samples = reads.withColumns({
        "colony": token("label", "_", 1), "substrate": F.lower(token("label", "_", 2))})
    value = "absorbance"
    if blank is not None:
        is_blank: Column = F.col("colony") == blank
        samples = controls.subtract_blank(samples, [*keys, "substrate", "minutes"], is_blank, value)
        value = "corrected"
    progress = calibrate.apply_calibration(samples, calibration, keys, value).select(
        *keys, "label", "substrate", "colony", "minutes", "nmol", *[c for c in reads.columns if c == "read_idx"])
    then = ("read_idx", "nmol") if "read_idx" in reads.columns else ("nmol",)
    trimmed, fits, best = steepest(progress, [*keys, "substrate", "colony"], "label", "nmol", settings, then)
    # One row per series, read four times below: cut here, or every table fits all windows again.
    best = scale.settle(best)
    result = best if protein is None else normalize.per_protein(best, protein, "colony", "sample", "nm_per_od")
    by = [*keys, "substrate"]
    change = normalize.fold_change(result, by, F.col("colony") == reference, "max_slope")
    means = normalize.reference_means(result, by, "colony", list(references), "max_slope", "mean_slope")
    change_means = normalize.reference_means(change, by, "colony", list(references), "fold_change", "mean_fc")
    return AssayResult(calibration, progress, trimmed, fits, result, {
        "fold_change": change, "reference_means": means, "reference_fold_changes": change_means})
