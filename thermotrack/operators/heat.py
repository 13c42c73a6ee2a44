"""Three-day heat index from daily minimum and maximum temperatures."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thermotrack.functions.times import local_time, round_numeric


def union_sources(*sources: DataFrame, columns=("temperature", "timestamp")) -> DataFrame:
    """UNION ALL of the needed columns of several cleaned tables."""
    for source in sources:
        _require(source, columns)
    return reduce(DataFrame.unionByName, [source.select(*columns) for source in sources])


def biometeo_index(
    df: DataFrame, tz: str = "UTC", ts: str = "timestamp", temp: str = "temperature", by=()
) -> DataFrame:
    """Per day: tn (min), tx (max) and ibm, the mean of (tn+tx)/2 over the row before, the row and
    the row after, to two decimals. Missing days are skipped over, edge days use two rows.

    The window runs over daily rows, so its input is bounded by the days of the campaign.
    """
    _require(df, (temp, ts, *by))
    daily = (
        df.select(*by, F.to_date(local_time(df, ts, tz)).alias("day"), temp)
        .groupBy(*by, "day")
        .agg(F.min(temp).alias("tn"), F.max(temp).alias("tx"))
    )
    three = Window.partitionBy(*by).orderBy(F.col("day").asc_nulls_last()).rowsBetween(-1, 1)
    mean = F.avg((F.col("tn") + F.col("tx")) / 2).over(three)
    return daily.withColumn("ibm", round_numeric(mean))


def index_summary(ibm_df: DataFrame) -> DataFrame:
    """One row over the output of biometeo_index."""
    return ibm_df.agg(
        F.count("*").alias("nb_jours"),
        round_numeric(F.min("tn")).alias("tn_min"),
        round_numeric(F.max("tx")).alias("tx_max"),
        F.round(F.avg("ibm"), 2).alias("ibm_moyen"),
        F.round(F.min("ibm"), 2).alias("ibm_min"),
        F.round(F.max("ibm"), 2).alias("ibm_max"),
    )


def _require(df: DataFrame, columns) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
