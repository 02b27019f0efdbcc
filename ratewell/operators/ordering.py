"""Positions and running sums in ordered groups of any size.

A light group is one window partition. A heavy group is range-partitioned on
(keys, order), so it lies in many slices one after the other: each slice is
summed on its own and starts from the total of the slices before it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewell import scale
from ratewell.functions.lines import known

MAX_SLICES = 20_000
#: Parts of a range of values that one pass counts.
BUCKETS = 256


def running_total(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    amount: Column,
    out: str,
    *,
    longest: int | None = None,
    group_rows: int | None = None,
    sizes: DataFrame | None = None,
    total: str | None = None,
) -> DataFrame:
    """Add ``out``: the sum of ``amount`` from the first row of the group up to this one.

    ``order`` must be unique within a group. ``longest`` is the caller's promise on
    the rows per group; with it no size check runs. ``sizes`` are rows per group
    where the caller has counted them. ``total`` adds the sum of the whole group.
    """
    if not keys:
        raise ValueError("running_total needs at least one key column")
    limit = scale.GROUP_ROWS if group_rows is None else group_rows
    df = df.withColumn("_amount", amount.cast("bigint"))
    up_to_here = (Window.partitionBy(*keys).orderBy(*order)
                  .rowsBetween(Window.unboundedPreceding, Window.currentRow))

    def plain(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn(out, F.sum("_amount").over(up_to_here))
        return rows if total is None else rows.withColumn(total, F.sum("_amount").over(Window.partitionBy(*keys)))

    if longest is not None and longest <= limit:
        return plain(df).drop("_amount")
    split = scale.split_heavy(df, keys, limit, sizes)
    result = plain(split.light)
    if split.heavy is not None:
        slices = slice_count(split.heavy_rows, limit)
        result = result.unionByName(_sliced_total(split.heavy, keys, order, out, slices, total))
    return result.drop("_amount")


def slice_count(rows: int, group_rows: int) -> int:
    """Slices for heavy rows: about ``group_rows`` each, but no more than one shuffle carries well."""
    return min(MAX_SLICES, max(2, math.ceil(rows / group_rows)))


def number_heavy(df: DataFrame, keys: list[str], order: list[str], out: str, slices: int) -> DataFrame:
    """Positions for rows already known to be in heavy groups."""
    ones = df.withColumn("_amount", F.lit(1).cast("bigint"))
    return _sliced_total(ones, keys, order, out, slices).drop("_amount")


def previous_value(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: str,
    out: str,
    *,
    longest: int | None = None,
    group_rows: int | None = None,
) -> DataFrame:
    """Add ``out``: the value of the row before in its group, NULL for the first.

    ``order`` must be unique within a group. In a heavy group the first row of a slice gets the last
    value of the slice before, from a table of one row per group and slice.
    """
    limit = scale.GROUP_ROWS if group_rows is None else group_rows
    by_key = Window.partitionBy(*keys).orderBy(*order)
    if longest is not None and longest <= limit:
        return df.withColumn(out, F.lag(value).over(by_key))
    split = scale.split_heavy(df, keys, limit)
    result = split.light.withColumn(out, F.lag(value).over(by_key))
    if split.heavy is None:
        return result
    spread = _slices(split.heavy, [*keys, *order], slice_count(split.heavy_rows, limit))
    borders = spread.groupBy(*keys, "_slice").agg(F.max_by(F.struct(F.col(value).alias("last")), "_pos").alias("_last"))
    carried = F.lag("_last").over(Window.partitionBy(*keys).orderBy("_slice"))
    # At most one entry per heavy key and one per slice.
    borders = F.broadcast(scale.settle(borders.withColumn("_carried", carried).drop("_last")))
    in_slice = Window.partitionBy("_slice", *keys).orderBy("_pos")
    heavy = (
        scale.match_keys(spread, borders, [*keys, "_slice"], "inner")
        .withColumn("_nth", F.row_number().over(in_slice))
        .withColumn(out, F.when(F.col("_nth") == 1, F.col("_carried.last")).otherwise(F.lag(value).over(in_slice)))
        .drop("_pos", "_slice", "_carried", "_nth")
    )
    return result.unionByName(heavy)


def _slices(df: DataFrame, sort: list[str], slices: int) -> DataFrame:
    """Sorted ranges of rows with ``_slice`` and ``_pos``; settled, because these must not change between two uses."""
    return scale.settle(
        df.repartitionByRange(slices, *sort)
        .sortWithinPartitions(*sort)
        .withColumn("_pos", F.monotonically_increasing_id())
        .withColumn("_slice", F.shiftright("_pos", 33))
    )


def _sliced_total(
    df: DataFrame, keys: list[str], order: list[str], out: str, slices: int, total: str | None = None
) -> DataFrame:
    spread = _slices(df, [*keys, *order], slices)
    earlier = (Window.partitionBy(*keys).orderBy("_slice")
               .rowsBetween(Window.unboundedPreceding, -1))
    starts = (
        spread.groupBy(*keys, "_slice").agg(F.sum("_amount").alias("_sum"))
        .withColumn("_start", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .withColumn("_all", F.sum("_sum").over(Window.partitionBy(*keys)))
        .drop("_sum")
    )
    # At most one entry per heavy key and one per slice.
    joined = scale.match_keys(spread, F.broadcast(scale.settle(starts)), [*keys, "_slice"], "inner")
    in_slice = (Window.partitionBy("_slice", *keys).orderBy("_pos")
                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        joined.withColumn(out, F.col("_start") + F.sum("_amount").over(in_slice))
        .withColumnsRenamed({"_all": total} if total else {})
        .drop("_pos", "_slice", "_start", "_all")
    )


def number_rows(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    out: str,
    *,
    longest: int | None = None,
    group_rows: int | None = None,
) -> DataFrame:
    """Add ``out``: the 1-based position of a row in its group."""
    return running_total(df, keys, order, F.lit(1), out, longest=longest, group_rows=group_rows)


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values per group with ``_count``, without NULL and NaN."""
    return df.where(known(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_count"))


def quantile_table(
    df: DataFrame,
    keys: list[str],
    value: str,
    probabilities: dict[str, float],
    *,
    mean: str | None = None,
    count: str | None = None,
    group_rows: int | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Exact quantiles per group with linear interpolation between order statistics.

    Equal values are counted before anything else, so only distinct values are looked
    at. Groups of few distinct values rank them in a window; in heavy groups the wanted ranks are
    closed in on by counting, and no value is sorted. ``mean``
    and ``count`` name further columns. ``counts`` are the settled
    ``value_counts`` where the caller has them.
    """
    limit = scale.GROUP_ROWS if group_rows is None else group_rows
    counts = scale.settle(value_counts(df, keys, value)) if counts is None else counts
    split = scale.split_heavy(counts, keys, limit, scale.group_sizes(counts, keys))
    picked = _ranked_quantiles(split.light, keys, value, probabilities)
    if split.heavy is not None:
        picked = picked.unionByName(_narrowed_quantiles(split.heavy, keys, value, probabilities))
    return picked.select(
        *keys,
        *[F.when(F.col(f"_lo_{n}") == F.col(f"_hi_{n}"), F.col(f"_lo_{n}")).otherwise(
            F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_part_{n}")).cast("double").alias(n)
          for n in probabilities],
        *([F.col("_mean").alias(mean)] if mean else []),
        *([F.col("_n").alias(count)] if count else []),
    )


def _place(total: Column | str, p: float) -> Column:
    """Where a quantile lies among the values numbered from 0."""
    return ((F.col(total) if isinstance(total, str) else total) - 1) * F.lit(float(p))


def _ranked_quantiles(counts: DataFrame, keys: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Values on both sides of each quantile, from running counts in one window per group."""
    up_to_here = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumns({
        "_upto": F.sum("_count").over(up_to_here), "_total": F.sum("_count").over(Window.partitionBy(*keys))})

    def at_rank(rank: Column) -> Column:
        covers = (F.col("_upto") - F.col("_count") <= rank) & (rank < F.col("_upto"))
        return F.max(F.when(covers, F.col(value)))

    picks = [
        F.max("_total").alias("_n"),
        (F.sum(F.col(value).cast("double") * F.col("_count")) / F.max("_total")).alias("_mean"),
    ]
    for name, p in probabilities.items():
        place = _place("_total", p)
        picks += [at_rank(F.floor(place)).alias(f"_lo_{name}"),
                  at_rank(F.ceil(place)).alias(f"_hi_{name}"),
                  F.max(place - F.floor(place)).alias(f"_part_{name}")]
    return ranked.groupBy(*keys).agg(*picks)


def _magnitude(v: Column) -> Column:
    """A number that grows with ``v`` by its magnitude: ranges over many of them are cut evenly too."""
    # Logarithms of doubles lie between -745 and 710.
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.least(F.log(F.abs(v)), F.lit(720.0)) + 746))


def _narrowed_quantiles(counts: DataFrame, keys: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """The same for heavy groups: a wanted rank lies in a range of values that a histogram of the range makes smaller.

    A pass counts the values of every open range in ``BUCKETS`` equal parts (of magnitudes, where these differ much) and goes on with the part that holds the
    rank, from its smallest to its largest value. The largest value of a range has a part of its own, so
    a range loses values in every pass; it is closed once it holds one. Ranks in the same range share its counts.
    Between passes there are only ranges, a few per heavy group.
    """
    totals = scale.settle(counts.groupBy(*keys).agg(
        F.sum("_count").alias("_n"), (F.sum(F.col(value).cast("double") * F.col("_count")) / F.sum("_count")).alias("_mean"),
        F.min(value).alias("_low"), F.max(value).alias("_high")))
    wanted = F.array_distinct(F.flatten(F.array(*[
        F.array(F.floor(_place("_n", p)), F.ceil(_place("_n", p))) for p in probabilities.values()])))
    ranges = totals.select(*keys, F.explode(wanted).alias("_rank"), "_low", "_high", F.lit(0).cast("bigint").alias("_below"))
    closed = None
    while True:
        ranges = scale.settle(ranges)
        done = ranges.where(F.col("_low") == F.col("_high")).select(*keys, "_rank", F.col("_low").alias("_value"))
        closed = done if closed is None else closed.unionByName(done)
        ranges = ranges.where(F.col("_low") != F.col("_high"))
        if ranges.isEmpty():
            break
        # At most as many entries as heavy groups have wanted ranks.
        open_ = F.broadcast(scale.settle(ranges.select(*keys, "_low", "_high").distinct()))
        inside = scale.match_keys(counts, open_, keys, "inner").where(F.col(value).between(F.col("_low"), F.col("_high")))
        v, low, high = (F.col(c).cast("double") for c in (value, "_low", "_high"))
        sizes = F.abs(low), F.abs(high)
        even = (low * high > 0) & (F.greatest(*sizes) <= 4 * F.least(*sizes))
        # Of like size and sign, so the difference of whole numbers is exact and small.
        off, width = F.col(value) - F.col("_low"), F.col("_high") - F.col("_low")
        v, low, high = map(_magnitude, (v, low, high))
        part = F.when(even, off.cast("double") / width.cast("double")).otherwise(F.try_divide(v - low, high - low))
        bucket = F.when(F.col(value) == F.col("_high"), BUCKETS).otherwise(
            F.least(F.coalesce(F.floor(part * BUCKETS), F.lit(0)), F.lit(BUCKETS - 1)))
        parts = inside.groupBy(*keys, "_low", "_high", bucket.alias("_bucket")).agg(
            F.sum("_count").alias("_held"), F.min(value).alias("_least"), F.max(value).alias("_most"))
        before = Window.partitionBy(*keys, "_low", "_high").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("_before", F.coalesce(F.sum("_held").over(before), F.lit(0)))
        at = F.col("_rank") - F.col("_below")
        ranges = (
            scale.match_keys(parts, F.broadcast(ranges), [*keys, "_low", "_high"], "inner")
            .where((F.col("_before") <= at) & (at < F.col("_before") + F.col("_held")))
            .select(*keys, "_rank", F.col("_least").alias("_low"), F.col("_most").alias("_high"),
                    (F.col("_below") + F.col("_before")).alias("_below"))
        )
    found = scale.match_keys(closed, F.broadcast(totals.select(*keys, "_n", "_mean")), keys, "inner")
    picks = [F.max("_n").alias("_n"), F.max("_mean").alias("_mean")]
    for name, p in probabilities.items():
        place = _place("_n", p)
        picks += [F.max(F.when(F.col("_rank") == F.floor(place), F.col("_value"))).alias(f"_lo_{name}"),
                  F.max(F.when(F.col("_rank") == F.ceil(place), F.col("_value"))).alias(f"_hi_{name}"),
                  F.max(place - F.floor(place)).alias(f"_part_{name}")]
    return found.groupBy(*keys).agg(*picks)
