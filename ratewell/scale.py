"""Size checks shared by the operators: heavy groups, small tables, cut lineage.

An operator that must put a whole group in one task first asks how large the
groups are. Groups above ``GROUP_ROWS`` take a path that spreads one group over
many tasks; a table is broadcast only after its bytes were added up.
"""

from __future__ import annotations

import tempfile
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GROUP_ROWS = 2_000_000
BROADCAST_BYTES = 64 * 1024 * 1024
#: Bound for lists of heavy keys, apart from that for tables so that tests may set the latter to 0.
BROADCAST_LIST_BYTES = BROADCAST_BYTES


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; only a local session may make its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="ratewell-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder once and go on from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _fixed_bytes(kind: T.DataType) -> int | None:
    """Bytes of a value whose size its type tells, NULL or not; None for the others."""
    if isinstance(kind, T.StructType):
        parts = [_fixed_bytes(f.dataType) for f in kind.fields]
        return None if None in parts else 24 + sum(parts)
    if isinstance(kind, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.VariantType)):
        return None
    return 24 if isinstance(kind, T.DecimalType) else 8


def _bytes_of(value: Column, kind: T.DataType) -> Column:
    """Upper estimate of the bytes of a value beside its 8 bytes in the row."""
    if _fixed_bytes(kind) is not None:
        return F.lit(_fixed_bytes(kind))
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 8
    if isinstance(kind, T.StructType):
        return reduce(lambda a, b: a + b, [_bytes_of(value.getField(f.name), f.dataType) for f in kind.fields], F.lit(24))
    if isinstance(kind, T.ArrayType) and _fixed_bytes(kind.elementType) is not None:
        return F.coalesce(F.size(value), F.lit(0)) * (8 + _fixed_bytes(kind.elementType)) + 32
    # Anything nested deeper: each character of its JSON may stand for a value of 64 bytes.
    return F.coalesce(F.octet_length(F.to_json(F.struct(value))), F.lit(0)) * 64 + 64


def byte_size(df: DataFrame) -> int:
    """Upper estimate of the bytes of all rows in a hash table: fields, null bits, a table entry."""
    fields = df.schema.fields
    fixed = F.lit(48 + 8 * (len(fields) // 64 + 1) + 8 * len(fields))
    width = reduce(lambda a, b: a + b, [_bytes_of(F.col(f"`{f.name}`"), f.dataType) for f in fields], fixed)
    return int(df.agg(F.sum(width.cast("bigint"))).first()[0] or 0)


def fits_broadcast(df: DataFrame, limit: int) -> bool:
    """Whether the table may be broadcast: the bytes of its rows were added up."""
    return byte_size(df) <= limit


def match_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL; keeps one set of key columns, in a full or right join of either side."""
    other = right.withColumnsRenamed({k: f"_match_{k}" for k in keys})
    same = reduce(
        lambda a, b: a & b,
        [left[k].eqNullSafe(other[f"_match_{k}"]) for k in keys],
    )
    joined = left.join(other, same, how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how in ("full", "right"):
        # A row of the right side alone has NULL in the left keys.
        joined = joined.withColumns({k: F.coalesce(left[k], other[f"_match_{k}"]) for k in keys})
    return joined.drop(*[f"_match_{k}" for k in keys])


class HeavySplit(NamedTuple):
    """Rows of groups above the limit (None if there are none) and all other rows."""

    heavy: DataFrame | None
    light: DataFrame
    heavy_keys: DataFrame
    heavy_rows: int


def group_sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per group; combines in the map tasks, so no group travels whole."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))


def split_heavy(
    df: DataFrame, keys: list[str], group_rows: int | None = None, sizes: DataFrame | None = None
) -> HeavySplit:
    """Split rows by the size of their group.

    ``sizes`` (keys, ``_rows``) may be given where it is known already; it may
    overstate. The list of heavy keys has at most (all rows / ``group_rows``)
    entries, which bounds its broadcast.
    """
    limit = GROUP_ROWS if group_rows is None else group_rows
    sizes = group_sizes(df, keys) if sizes is None else sizes
    large = settle(sizes.where(F.col("_rows") > limit))
    total = large.agg(F.sum("_rows")).first()[0]
    heavy_keys = large.select(*keys)
    heavy_keys = F.broadcast(heavy_keys) if fits_broadcast(heavy_keys, BROADCAST_LIST_BYTES) else heavy_keys
    if total is None:
        return HeavySplit(None, df, heavy_keys, 0)
    return HeavySplit(
        match_keys(df, heavy_keys, keys, "left_semi"),
        match_keys(df, heavy_keys, keys, "left_anti"),
        heavy_keys,
        int(total),
    )


def join_dimension(
    df: DataFrame,
    dimension: DataFrame,
    on: list[str],
    how: str = "inner",
    broadcast_bytes: int | None = None,
    group_rows: int | None = None,
    settled: bool = False,
) -> DataFrame:
    """Join rows to a per-key table computed from data.

    NULL keys match NULL keys. The table is settled once (``settled`` says it is, or is
    a plain scan) and broadcast if its bytes allow. Otherwise rows of heavy keys meet a
    broadcast of just those keys, and all other rows shuffle.
    """
    limit = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    dimension = dimension if settled else settle(dimension)
    if fits_broadcast(dimension, limit):
        return match_keys(df, F.broadcast(dimension), on, how)
    split = split_heavy(df, on, group_rows)
    spread = match_keys(split.light, dimension, on, how)
    if split.heavy is None:
        return spread
    part = settle(match_keys(dimension, split.heavy_keys, on, "left_semi"))
    part = F.broadcast(part) if fits_broadcast(part, limit) else part
    return match_keys(split.heavy, part, on, how).unionByName(spread)


def small_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A parameter table written out by the caller, so its size is the caller's text."""
    return F.broadcast(spark.createDataFrame(rows, schema))
