"""Statistics per range of local hours, all ranges and columns in one pass."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermotrack.functions.times import local_time

# Columns in which zero and below mean "no measure".
POSITIVE_ONLY = ("temperature_top", "temperature_bot")


def _in_range(hour: Column, start: int, end: int) -> Column:
    if not (0 <= start <= 24 and 0 <= end <= 24):
        raise ValueError(f"hours must lie between 0 and 24: {start}-{end}")
    if start == end:
        raise ValueError(f"a range needs two different hours: {start}")
    if start < end:
        return (hour >= start) & (hour < end)
    return (hour >= start) | (hour < end)


def hour_range_stats(
    df: DataFrame, columns, ranges, tz: str = "Europe/Paris", ts: str = "timestamp"
) -> DataFrame:
    """One row: distinct local days, lowest and highest local hour, and for each (start, end) range
    max, min and mean of each column and the row count. A range may cross midnight.
    """
    if not columns:
        raise ValueError("no column given")
    unknown = [c for c in (*columns, ts) if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    local = local_time(df, ts, tz)
    timed = df.select(*columns, F.to_date(local).alias("_day"), F.hour(local).alias("_hour"))
    hour = F.col("_hour")
    results = [
        F.countDistinct("_day").alias("nombre_jours"),
        F.min(hour).alias("heure_min"),
        F.max(hour).alias("heure_max"),
    ]
    for start, end in ranges:
        inside = _in_range(hour, start, end)
        label = f"{start:02d}h_{end:02d}h"
        for c in columns:
            counted = inside & (F.col(c) > 0) if c in POSITIVE_ONLY else inside
            value = F.when(counted, F.col(c))
            results += [
                F.max(value).alias(f"max_{c}_{label}"),
                F.min(value).alias(f"min_{c}_{label}"),
                F.avg(value).alias(f"avg_{c}_{label}"),
            ]
        results.append(F.count_if(inside).alias(f"count_{label}"))
    return timed.agg(*results)


def hour_amplitude(stats: DataFrame) -> DataFrame:
    """Add the number of hours from the lowest to the highest, both included."""
    return stats.withColumn("amplitude_horaire", F.col("heure_max") - F.col("heure_min") + 1)
