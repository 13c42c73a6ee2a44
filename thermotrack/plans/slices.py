"""Ordered-series work that never puts a whole series into one task.

A series (one track, one thermometer) may hold a large part of all rows, so a window over the
series key alone would be one huge task. Every series is cut into time slices; windows run per
(series, slice). What must cross a slice border is carried by a per-slice summary, whose size is
bounded by the length of the campaign divided by the slice length, not by the row count.
"""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermotrack.functions.times import epoch_us

SLICE_SECONDS = 3600
_LAST_SLICE = (1 << 62)  # rows without a timestamp sort last


def time_slice(ts: Column, seconds: int = SLICE_SECONDS) -> Column:
    number = F.floor(epoch_us(ts) / F.lit(seconds * 1_000_000))
    return F.coalesce(number, F.lit(_LAST_SLICE)).cast("bigint")


def ascending(columns) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in columns]


def descending(columns) -> list[Column]:
    return [F.col(c).desc_nulls_first() for c in columns]


def join_null_safe(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi-join on keys that may be NULL (NULL equals NULL); still a hash or merge join."""
    others = [c for c in right.columns if c not in keys]
    renamed = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys], *others)
    condition = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])


def with_halo(df: DataFrame, keys, order, slice_col: str, before: int, spread) -> DataFrame:
    """Add to each slice copies of the `before` rows of its series that come just before it.

    Copies carry `_halo` = true and the slice they were copied into. A frame of up to `before`
    preceding rows over (keys, slice_col) is then exact for all rows with `_halo` = false.

    df must be partitioned by the columns `spread`, a part of (keys, slice_col). The copies, at
    most `before` per slice, are brought to the same partitioning, and the union keeps it: windows
    over (keys, slice_col) then need no further shuffle of df itself.
    """
    in_slice = Window.partitionBy(*keys, slice_col).orderBy(*descending(order))
    tails = (
        df.withColumn("_rank", F.row_number().over(in_slice))
        .filter(F.col("_rank") <= before)
        .drop("_rank")
    )
    ahead = Window.partitionBy(*keys).orderBy(*ascending(order)).rowsBetween(1, before)
    targets = F.array_except(F.collect_set(slice_col).over(ahead), F.array(slice_col))
    copies = (
        tails.withColumn("_targets", targets)
        .withColumn(slice_col, F.explode("_targets"))
        .drop("_targets")
        .withColumn("_halo", F.lit(True))
        .repartition(*spread)
    )
    return df.withColumn("_halo", F.lit(False)).unionByName(copies)


def slice_offsets(per_slice: DataFrame, keys, slice_col: str, count_col: str) -> DataFrame:
    """Number of rows of the series before each slice, from the per-slice counts."""
    before = (
        Window.partitionBy(*keys)
        .orderBy(slice_col)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return per_slice.withColumn("_offset", F.coalesce(F.sum(count_col).over(before), F.lit(0)))
