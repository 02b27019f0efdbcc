"""Plate templates: wells, labels, replicates and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewell import scale
from ratewell.operators.ordering import number_rows, running_total


def well_name(well_idx: Column, columns: int) -> Column:
    """``A1`` style name of a 0-based row-major index; rows past Z are AA, AB, ..."""
    row = F.floor(well_idx / columns)
    letter = F.char(F.lit(65) + row % 26)
    prefix = F.when(row >= 26, F.char(F.lit(64) + F.floor(row / 26))).otherwise(F.lit(""))
    return F.concat(prefix, letter, (well_idx % columns + 1).cast("string"))


def flatten_grid(grid: DataFrame, keys: list[str], row: str, labels: list[str]) -> DataFrame:
    """A label grid (one row per plate row, 0-based ``row``) as one row per well."""
    cells = grid.select(*keys, F.col(row).alias("_row"), F.posexplode(F.array(*labels)).alias("_column", "label"))
    index = (F.col("_row") * len(labels) + F.col("_column")).cast("int")
    return cells.select(*keys, index.alias("well_idx"), well_name(index, len(labels)).alias("well"), "label")


def explode_wells(reads: DataFrame, keys: list[str], wells: str = "wells", out: str = "value") -> DataFrame:
    """Wide reads (array of wells) to one row per read and well."""
    return reads.select(*keys, F.posexplode(wells).alias("well_idx", out))


def label_wells(observations: DataFrame, plate_map: DataFrame, keys: list[str]) -> DataFrame:
    """Give every observation the template label at its position; unlabelled wells drop."""
    labelled = plate_map.where(F.col("label").isNotNull()).select(*keys, "well_idx", "label")
    return scale.join_dimension(observations, labelled, [*keys, "well_idx"])


def layout_check(instrument: DataFrame, template: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Pair instrument and template names by position and say what has no partner; NULL keys match NULL keys."""
    left = instrument.select(*keys, position, "instrument_name")
    right = template.select(*keys, position, "template_name")
    state = (F.when(F.col("template_name").isNull(), "no template")
             .when(F.col("instrument_name").isNull(), "no well").otherwise("paired"))
    return scale.match_keys(left, right, [*keys, position], "full").withColumn("state", state)


def unique_labels(
    wells: DataFrame, keys: list[str], label: str, order: list[str], out: str = "unique_label"
) -> DataFrame:
    """Number repeated labels a, a.1, a.2; numbers already in use as labels are left out."""
    by_label = [*keys, label]
    numbered = number_rows(wells, by_label, order, "_nth").withColumn("_repeat", F.col("_nth") - 1)
    pattern = r"^(.+)\.([1-9][0-9]*)$"
    taken = scale.settle(
        wells.where(F.col(label).rlike(pattern))
        .select(*keys, F.regexp_extract(label, pattern, 1).alias("_base"),
                F.regexp_extract(label, pattern, 2).try_cast("bigint").alias("_used"))
        .distinct()
        .withColumnRenamed("_base", label)
    )
    if not taken.isEmpty():
        # A used number moves every later repeat up by one: it counts from the
        # repeat that would otherwise land on it.
        blocks = number_rows(taken, by_label, ["_used"], "_place").select(
            *by_label, "_used", (F.col("_used") - F.col("_place") + 1).alias("_repeat"), F.lit(1).alias("_block"))
        both = numbered.withColumn("_block", F.lit(0)).unionByName(blocks, allowMissingColumns=True)
        shifted = running_total(
            both.withColumn("_after", 1 - F.col("_block")),
            by_label, ["_repeat", "_after", "_used"], F.col("_block"), "_shift")
        numbered = (
            shifted.where(F.col("_block") == 0)
            .withColumn("_nth", F.col("_nth") + F.col("_shift"))
            .drop("_block", "_after", "_used", "_shift")
        )
    name = F.when(F.col("_repeat") == 0, F.col(label)).otherwise(
        F.concat_ws(".", F.col(label), (F.col("_nth") - 1).cast("string")))
    return numbered.withColumn(out, name).drop("_nth", "_repeat")


def cyclic_replicate(label: Column, well_idx: Column, replicates: int = 3) -> Column:
    """``_rep1`` .. ``_repN`` in turn over all wells."""
    return F.concat(label, F.lit("_rep"), (well_idx % replicates + 1).cast("string"))


def tag_matching(
    wells: DataFrame, keys: list[str], label: str, order: list[str], pattern: str, replicates: int = 3
) -> DataFrame:
    """Append ``_1`` .. ``_N`` in turn to the labels that match, in plate order."""
    matches = F.coalesce(F.col(label).rlike(pattern), F.lit(False))
    counted = running_total(wells, keys, order, matches.cast("int"), "_place")
    turn = ((F.col("_place") - 1) % replicates + 1).cast("string")
    return counted.withColumn(label, F.when(matches, F.concat_ws("_", F.col(label), turn))
                              .otherwise(F.col(label))).drop("_place")


def mask_wells(wells: DataFrame, masks: DataFrame, condition: str) -> DataFrame:
    """Drop wells in the 1-based ranges ``(condition, lo, hi)`` set for their condition."""
    mask = scale.settle(masks.select(F.col(condition).alias("_masked"), "lo", "hi"))
    covered = (wells[condition] == mask["_masked"]) & (wells["well_idx"] + 1).between(mask["lo"], mask["hi"])
    return wells.join(F.broadcast(mask) if scale.fits_broadcast(mask, scale.BROADCAST_BYTES) else mask, covered, "left_anti")


def keep_grid_rows(wells: DataFrame, first: int, last: int, columns: int) -> DataFrame:
    """Keep template rows ``first``..``last`` (1-based)."""
    return wells.where(F.floor(F.col("well_idx") / columns).between(first - 1, last - 1))


def wells_near_match(
    wells: DataFrame, keys: list[str], is_match: Column, before: tuple[int, int] = (12, 7), after: int = 3
) -> DataFrame:
    """Wells picked relative to a label match.

    Keeps the matching wells, the wells ``before[0]``..``before[1]`` places ahead of
    the first match, and the wells ``after`` places behind each match. NULL keys are a plate
    like others; a well may have any number of rows.
    """
    flagged = wells.withColumn("_match", F.coalesce(is_match, F.lit(False)))
    matches = flagged.where("_match")
    first = matches.groupBy(*keys).agg(F.min("well_idx").alias("_first"))
    behind = matches.select(*keys, (F.col("well_idx") + after).alias("well_idx"), F.lit(True).alias("_behind")).distinct()
    ahead = F.col("well_idx").between(F.col("_first") - before[0], F.col("_first") - before[1])
    return (
        scale.join_dimension(scale.join_dimension(flagged, first, keys), behind, [*keys, "well_idx"], "left")
        .where(F.col("_match") | ahead | F.coalesce("_behind", F.lit(False)))
        .drop("_match", "_behind", "_first")
    )
