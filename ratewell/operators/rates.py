"""Reaction rates: trimming, sliding line fits, the steepest window."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewell import scale
from ratewell.functions.clock import seconds_between, whole_minutes
from ratewell.functions.lines import intercept, known, r_squared, slope
from ratewell.operators.ordering import number_heavy, number_rows, slice_count

CHUNK_ROWS = 100_000
# Most reads put side by side in one row; more would outgrow a generated method.
NARROW = 8
# Largest rank that Spark limits before a shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000
PRODUCTS = [("x", "x"), ("x", "y"), ("y", "y")]


def elapsed_minutes(df: DataFrame, keys: list[str], time: str, out: str = "minutes") -> DataFrame:
    """Whole minutes since the first read of the series."""
    first = df.groupBy(*keys).agg(F.min(time).alias("_first"))
    return (
        scale.join_dimension(df, first, keys)
        .withColumn(out, whole_minutes(seconds_between(F.col("_first"), F.col(time))))
        .drop("_first")
    )


def force_last_minute(
    df: DataFrame, keys: list[str], minutes: str = "minutes", value: float | Column = 60.0
) -> DataFrame:
    """Set the last read time of an assay to a fixed minute; where that is NULL it stays."""
    last = df.groupBy(*keys).agg(F.max(minutes).alias("_last"))
    return (
        scale.join_dimension(df, last, keys)
        .withColumn(minutes, F.coalesce(F.when(F.col(minutes) == F.col("_last"), value), F.col(minutes)))
        .drop("_last")
    )


def trim_reads(
    df: DataFrame, keys: list[str], order: list[str], lo: int, hi: int, out: str | None = None, spread_over: int | None = None
) -> DataFrame:
    """Keep reads ``lo``..``hi`` of each series.

    The upper bound lets Spark drop later reads in every map task, before the
    shuffle, so a long series sends only its first ``hi`` reads per input split. ``spread_over`` says
    how many splits one series may lie in (as many as a shuffle has, if not given); where their first reads
    together are more than a window should sort, groups of splits find theirs first.
    Beyond Spark's limit for that, reads are numbered in slices instead.
    """
    place = out or "_place"
    if hi <= GROUP_LIMIT:
        df = _first_of_splits(df, keys, order, hi, spread_over)
    if hi > GROUP_LIMIT:
        numbered = number_rows(df, keys, order, place)
    else:
        numbered = df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    kept = numbered.where((F.col(place) <= hi) & (F.col(place) >= lo))
    return kept if out else kept.drop(place)


def _first_of_splits(df: DataFrame, keys: list[str], order: list[str], hi: int, spread_over: int | None) -> DataFrame:
    """Reads among the first ``hi`` of a group of splits; a task then gets those of about the root of all splits."""
    splits = spread_over or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if hi * splits <= scale.GROUP_ROWS:
        return df
    group = F.floor(F.spark_partition_id() / math.ceil(math.sqrt(splits)))
    first = Window.partitionBy(*keys, "_splits").orderBy(*order)
    return df.withColumn("_splits", group).withColumn("_nth", F.row_number().over(first)).where(
        F.col("_nth") <= hi).drop("_splits", "_nth")


def sliding_fit(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    x: str,
    y: str,
    window: int | str,
    *,
    widest: int | None = None,
    longest: int | None = None,
    group_rows: int | None = None,
    chunk_rows: int | None = None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Fit ``y ~ x`` over every run of ``window + 1`` reads of a series.

    Gives keys, ``window_start`` (1-based read), ``n``, ``slope``, ``intercept``,
    ``r2``. Series too short for one window give no row. ``window`` may name a column that
    holds the width of the row's series, at most ``widest``; it stays in the result. Windows with the same
    known reads have the same line, to the last bit. ``longest`` is the
    caller's promise on the reads per series, e.g. after ``trim_reads``; without
    it series above ``group_rows`` are found by counting (or from ``sizes``, if
    counted already) and fitted in chunks that overlap by ``window`` reads.
    """
    if isinstance(window, int):
        widest, width = window, []
    elif widest is None:
        raise ValueError("a width per series needs the widest of them")
    else:
        width = [window]
    limit = scale.GROUP_ROWS if group_rows is None else group_rows
    reads = df.select(*dict.fromkeys([*keys, *width, *order, x, y]))
    if longest is not None and longest <= limit:
        return _window_fits(reads, keys, order, x, y, window, widest)
    split = scale.split_heavy(reads, keys, limit, sizes)
    fits = _window_fits(split.light, keys, order, x, y, window, widest)
    if split.heavy is None:
        return fits
    size = max(CHUNK_ROWS if chunk_rows is None else chunk_rows, widest + 1)
    slices = slice_count(split.heavy_rows, limit)
    numbered = number_heavy(split.heavy, keys, order, "_read", slices)
    chunk, place = F.floor((F.col("_read") - 1) / size), (F.col("_read") - 1) % size
    # The reads ahead of a chunk tell whether its first windows know the same reads as the last of the chunk before.
    leads_in, follows = (place < widest) & (F.col("_read") > size), place >= size - widest
    chunks = numbered.withColumn("_chunk", F.explode(F.array_compact(F.array(
        chunk, F.when(leads_in, chunk - 1), F.when(follows, chunk + 1)))))
    chunked = (
        _window_fits(chunks, [*keys, "_chunk"], ["_read"], x, y, window, widest, numbered="_read")
        .where(F.floor((F.col("window_start") - 1) / size) == F.col("_chunk"))
        .drop("_chunk")
    )
    return fits.unionByName(chunked)


def _window_fits(
    df: DataFrame, keys: list[str], order: list[str], x: str, y: str, window: int | str, widest: int, numbered: str | None = None,
) -> DataFrame:
    """Fits of all full windows; ``numbered`` names the read number where it is known.

    Expressions are SQL text: a window has hundreds of terms, and text reaches Spark
    in one call per column.
    """
    over = f"OVER (PARTITION BY {_names(keys)} ORDER BY {_names(order)})"
    width = [] if isinstance(window, int) else [window]
    kept = dict.fromkeys([*keys, *width, *order])
    # A pair with a NULL or NaN is missing.
    paired = " AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in (x, y))
    reads = df.selectExpr(
        *[f"`{c}`" for c in kept],
        f"CAST({f'`{numbered}`' if numbered else f'row_number() {over}'} AS bigint) AS window_start",
        f"CASE WHEN {paired} THEN CAST(`{x}` AS double) END AS _x0",
        f"CASE WHEN {paired} THEN CAST(`{y}` AS double) END AS _y0",
    )
    sums = _side_by_side(reads, over, window + 1) if widest < NARROW and not width else _doubled(reads, over, window, widest)
    lines = sums.selectExpr(
        *[f"`{c}`" for c in kept], "window_start", "n", "_same",
        "n * _sxx - _sx * _sx AS sxx", "n * _sxy - _sx * _sy AS sxy", "n * _syy - _sy * _sy AS syy",
        "_bx + try_divide(_sx, n) AS x_mean", "_by + try_divide(_sy, n) AS y_mean",
    ).withColumns({"slope": slope(), "intercept": intercept(), "r2": r_squared(), "n": F.col("n").cast("bigint")})
    found = [*keys, *width, "window_start", "n"]
    if widest < NARROW and not width:
        return lines.select(*found, "slope", "intercept", "r2")
    up_to_here = f"{over[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    line = f"last(CASE WHEN NOT _same THEN struct(slope, intercept, r2) END, true) {up_to_here} AS _line"
    return lines.selectExpr(*[f"`{c}`" for c in found], line).select(*found, "_line.*")


# Sums over a run of reads, of distances from its first known read (_bx, _by): what lies in a window bounds
# their size, so little cancels, and whole numbers stay whole.
RUN = ["n", "_bx", "_by", "_sx", "_sy", "_sxx", "_sxy", "_syy"]


def _side_by_side(reads: DataFrame, over: str, size: int) -> DataFrame:
    """Sums of short windows: their reads stand in one row, so a sum is plain arithmetic in generated code.

    Missing reads add exactly 0, so windows with the same known reads have the same sums.
    """
    run = range(size)
    rows = reads.selectExpr(
        "*", *[f"lead(_{v}0, {i}) {over} AS _{v}{i}" for i in run[1:] for v in "xy"],
        f"lead(1, {size - 1}) {over} AS _last",
    ).where("_last IS NOT NULL").selectExpr(
        "*", *[f"coalesce({', '.join(f'_{v}{i}' for i in run)}) AS _b{v}" for v in "xy"])
    return rows.selectExpr(
        "*", _sum(f"CASE WHEN _x{i} IS NOT NULL THEN 1D ELSE 0D END" for i in run) + " AS n",
        *[_sum_known(f"_{v}{i} - _b{v}" for i in run) + f" AS _s{v}" for v in "xy"],
        *[_sum_known(f"(_{a}{i} - _b{a}) * (_{b}{i} - _b{b})" for i in run) + f" AS _s{a}{b}" for a, b in PRODUCTS],
        "false AS _same")


def _doubled(reads: DataFrame, over: str, window: int | str, widest: int) -> DataFrame:
    """Sums of windows of any widths from sums of 1, 2, 4, ... reads.

    Sums of twice as many reads are those of a read and of the read that far ahead. A window is
    put together from the powers of two in its size, the smallest last, while these sums grow: its last
    part so far is always the window's end. All steps keep the partitioning and order, so there is one
    shuffle and one sort, however many widths there are. ``_same`` marks a window that knows the same reads as
    the one before: it lost a missing read and got a missing one.
    """
    size = f"({widest} + 1)" if isinstance(window, int) else f"(`{window}` + 1)"
    rows = reads.selectExpr(
        "*", "CASE WHEN _x0 IS NULL THEN 0D ELSE 1D END AS _r_n", "_x0 AS _r_bx", "_y0 AS _r_by",
        *[f"0D AS _r{name}" for name in RUN[3:]], "_x0 IS NULL AS _r_tail",
        f"coalesce(lag(_x0 IS NULL) {over}, false) AS _head",
        *[f"CAST(NULL AS double) AS _w{_own(name)}" for name in RUN], "CAST(NULL AS boolean) AS _w_tail")
    kept = [c for c in reads.columns if c not in ("_x0", "_y0")]
    parts = [_own(name) for name in RUN] + ["_tail"]
    length = 1
    while length <= widest + 1:
        constant = isinstance(window, int)
        has = (widest + 1) & length if constant else None
        grows = length * 2 <= widest + 1
        low = (widest + 1) % length if constant else None
        leads = []
        if grows:
            leads += [f"lead(_r{p}, {length}) {over} AS _next_r{p}" for p in parts]
        if length > 1 and (not constant or (has and low)):
            leads += [f"lead(_w{p}, {length}) {over} AS _next_w{p}" for p in parts]
        if leads:
            rows = rows.selectExpr(*[f"`{c}`" for c in kept], "_head", *[f"_r{p}" for p in parts], *[f"_w{p}" for p in parts], *leads)
        joined = _joined("_r", "_next_w") if length > 1 else {}
        window_now = {}
        for p in parts:
            if constant:
                window_now[p] = f"_w{p}" if not has else (joined[p] if low else f"_r{p}")
            else:
                whole = f"CASE WHEN {size} % {length} = 0 THEN _r{p} ELSE {joined[p]} END" if length > 1 else f"_r{p}"
                window_now[p] = f"CASE WHEN {size} & {length} != 0 THEN {whole} ELSE _w{p} END"
        runs_now = _joined("_r", "_next_r") if grows else {p: f"_r{p}" for p in parts}
        rows = rows.selectExpr(
            *[f"`{c}`" for c in kept], "_head",
            *[f"{runs_now[p]} AS _r{p}" for p in parts if grows], *[f"{window_now[p]} AS _w{p}" for p in parts])
        length *= 2
    return rows.selectExpr(
        *[f"`{c}`" for c in kept], "_head AND _w_tail AS _same", *[f"_w{_own(name)} AS {name}" for name in RUN]).where("n IS NOT NULL")


def _own(name: str) -> str:
    return name if name.startswith("_") else f"_{name}"


def _joined(a: str, b: str) -> dict[str, str]:
    """Sums over two runs, one behind the other, from theirs; NULL where the second does not exist."""
    dx, dy = (f"coalesce({b}_b{v} - {a}_b{v}, 0D)" for v in "xy")
    n = f"{b}_n"
    return {
        "_n": f"{a}_n + {n}",
        "_bx": f"coalesce({a}_bx, {b}_bx)", "_by": f"coalesce({a}_by, {b}_by)",
        "_sx": f"{a}_sx + {b}_sx + {n} * {dx}", "_sy": f"{a}_sy + {b}_sy + {n} * {dy}",
        "_sxx": f"{a}_sxx + {b}_sxx + {dx} * (2D * {b}_sx + {n} * {dx})",
        "_sxy": f"{a}_sxy + {b}_sxy + {dx} * {b}_sy + {dy} * {b}_sx + {n} * {dx} * {dy}",
        "_syy": f"{a}_syy + {b}_syy + {dy} * (2D * {b}_sy + {n} * {dy})",
        "_tail": f"{b}_tail",
    }


def _names(columns: list[str]) -> str:
    return ", ".join(f"`{c}`" for c in columns)


def _sum(terms) -> str:
    return "(" + " + ".join(terms) + ")"


def _sum_known(terms) -> str:
    """Sum in which NULL terms count as 0."""
    return _sum(f"coalesce({t}, 0D)" for t in terms)


def by_condition(condition: str, values: dict[str, object], otherwise: object = None) -> Column:
    """A setting that depends on the value of a column."""
    names: dict[object, list[str]] = {}
    for name, value in values.items():
        names.setdefault(value, []).append(name)
    rest = F.lit(otherwise)
    return reduce(lambda rest, one: F.when(F.col(condition).isin(one[1]), F.lit(one[0])).otherwise(rest), names.items(), rest)


def sliding_fit_by(
    df: DataFrame, condition: str, windows: dict[str, int], keys: list[str], order: list[str],
    x: str, y: str, *, longest: int | None = None,
) -> DataFrame:
    """Sliding fits whose width (``window`` in the result) depends on a condition, all in one pass over the reads."""
    reads = df.where(F.col(condition).isin(list(windows))).withColumn("window", by_condition(condition, windows))
    series = list(dict.fromkeys([condition, *keys]))
    return sliding_fit(reads, series, order, x, y, "window", widest=max(windows.values()), longest=longest)


def best_window(
    fits: DataFrame,
    keys: list[str],
    min_r2: float | None = None,
    min_slope: float | None = None,
    ties: str = "all",
    longest: int | None = None,
) -> DataFrame:
    """The steepest window of each series that passes the R2 gate.

    ``ties="all"`` keeps every window sharing the largest slope, ``"first"`` the
    earliest. ``longest`` is the caller's promise on the reads per series; with it rank 1 is taken by
    a window, and in the map tasks before any shuffle. Without it ties may be many, so the
    largest slope is an aggregate that is joined back.
    """
    good = fits.where(known("slope").isNotNull())
    if min_r2 is not None:
        good = good.where(F.col("r2") >= min_r2)
    if min_slope is not None:
        good = good.where(F.col("slope") > min_slope)
    columns = [*keys, F.col("slope").alias("max_slope"), "r2", "intercept", "window_start"]
    if ties == "first":
        first = F.max_by(F.struct("slope", "r2", "intercept", "window_start"), F.struct("slope", -F.col("window_start")))
        return good.groupBy(*keys).agg(first.alias("_best")).select(*keys, "_best.*").select(*columns)
    if longest is not None and longest <= scale.GROUP_ROWS:
        by_slope = Window.partitionBy(*keys).orderBy(F.col("slope").desc())
        return good.withColumn("_rank", F.rank().over(by_slope)).where(F.col("_rank") == 1).select(*columns)
    good = scale.settle(good)
    top = good.groupBy(*keys).agg(F.max("slope").alias("_top"))
    return scale.join_dimension(good, top, keys).where(F.col("slope") == F.col("_top")).select(*columns)


def attach_rates(reads: DataFrame, rates: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Give each read its series' rate, the earliest of equal ones; series without one are tagged inactive.

    ``n_winners`` says how many windows share the largest slope. There is one row per read.
    """
    first = F.min(F.struct("window_start", "max_slope", "r2", "intercept")).alias("_first")
    lines = rates.groupBy(*keys).agg(first, F.count(F.lit(1)).alias("n_winners")).select(*keys, "n_winners", "_first.*")
    return scale.join_dimension(reads, lines, keys, "left").withColumn(
        "winners", F.when(F.col("max_slope").isNull(), F.lit(" inactive")).otherwise(F.col(label).cast("string"))
    )


def sorted_rates(rates: DataFrame, *tie_break: str) -> DataFrame:
    """Rates from the fastest to the slowest."""
    return rates.orderBy(F.col("max_slope").desc(), *tie_break)
