"""Cleaning of raw sensor tables: filters, per-second aggregation, duplicates, speed, track keys."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermotrack.functions.geo import distance_m, same_point
from thermotrack.functions.keys import TRACK, track_key
from thermotrack.functions.times import seconds_between, truncate
from thermotrack.plans.slices import ascending, time_slice, with_halo

# Measures of the bike table that are averaged.
METEO_MEASURES = (
    "altitude",
    "vitesse",
    "direction",
    "temperature",
    "humidite",
    "pression",
    "temperature_bot",
    "temperature_top",
    "pm_1_ug_m3",
    "pm_2_5_ug_m3",
    "pm_10_ug_m3",
    "niveau_sonore_db_a",
    "distancegauche",
    "distancedroite",
    "elevation",
)
CAMPAIGN_START = "2025-06-27T06:00:00+02:00"
CAMPAIGN_END = "2025-07-03T23:00:00+02:00"
EXCLUDED_THERMO = "Saint-Jean La Poterie"
REFERENCE_PATTERN = "%reference%"
MAX_ACCURACY_M = 25
SMOOTHING_ROWS = 5


def _instant(value) -> Column:
    return F.lit(value).cast("timestamp") if isinstance(value, str) else F.lit(value)


def clean_meteo(
    df: DataFrame,
    start=CAMPAIGN_START,
    end=CAMPAIGN_END,
    exclude: str = EXCLUDED_THERMO,
    min_speed: float = 1.0,
) -> DataFrame:
    """Bike table: moving rows inside the campaign (bounds excluded), one row per instant and track.

    `vitesse` is in km/h, `min_speed` in m/s and applies to raw rows.
    """
    kept = df.filter(
        (F.col("vitesse") / 3.6 >= min_speed)
        & (F.col("timestamp") > _instant(start).cast(df.schema["timestamp"].dataType))
        & (F.col("timestamp") < _instant(end).cast(df.schema["timestamp"].dataType))
        & (F.col("thermo_name") != exclude)
    )
    means = [F.avg(c).alias(c) for c in ("lon", "lat", *METEO_MEASURES)]
    grouped = kept.groupBy("timestamp", *TRACK).agg(F.max("id").alias("id"), *means)
    return grouped.select(
        "id",
        "id_track",
        "thermo_name",
        "sensor_name",
        "timestamp",
        "lon",
        "lat",
        *METEO_MEASURES,
        (F.col("vitesse") / 3.6).alias("speed_m_s"),
        track_key().alias("unique_id_track"),
    )


def _per_second(df: DataFrame) -> DataFrame:
    measures = ("temperature", "humidity", "lon", "lat", "accuracy", "elevation")
    return (
        df.withColumn("timestamp", truncate(df, "second", "timestamp"))
        .groupBy(*TRACK, "timestamp")
        .agg(F.max("id").alias("id"), *[F.avg(c).alias(c) for c in measures])
        .select("id", *TRACK, "timestamp", *measures)
    )


def aggregate_by_second(
    df: DataFrame, max_accuracy: float = MAX_ACCURACY_M, ref_pattern: str = REFERENCE_PATTERN
) -> DataFrame:
    """Mobile rows with good accuracy, merged per second and track."""
    return _per_second(
        df.filter(
            (F.col("accuracy") <= max_accuracy)
            & ~F.col("thermo_name").ilike(ref_pattern)
            & F.col("temperature").isNotNull()
        )
    )


def clean_reference(df: DataFrame, ref_pattern: str = REFERENCE_PATTERN) -> DataFrame:
    """Reference sensors merged per second; no accuracy filter, no speed."""
    kept = df.filter(F.col("thermo_name").ilike(ref_pattern) & F.col("temperature").isNotNull())
    return _per_second(kept).withColumn("unique_id_track", track_key())


def drop_duplicates_by_position(df: DataFrame) -> DataFrame:
    """Lowest id of the rows one thermometer gave at one place and instant (several tracks)."""
    place = Window.partitionBy("sensor_name", "thermo_name", "lon", "lat", "timestamp")
    return (
        df.withColumn("_rank", F.row_number().over(place.orderBy(F.col("id").asc_nulls_last())))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


# Track windows: rows are partitioned by (unique_id_track, slice). The key is a function of the
# three track columns, so this serves windows over either, and a long track is spread over tasks.
_SPREAD = ("unique_id_track", "_slice")


def _spread(df: DataFrame) -> DataFrame:
    return df.withColumn("_slice", time_slice(F.col("timestamp"))).repartition(*_SPREAD)


def _with_previous(df: DataFrame, keys, before: int) -> DataFrame:
    return with_halo(df, keys, ("timestamp", "id"), "_slice", before, _SPREAD)


def _track_window(keys):
    return Window.partitionBy(*keys, "_slice").orderBy(*ascending(("timestamp", "id")))


def _speed() -> Column:
    seconds = seconds_between(F.col("timestamp"), F.col("prev_timestamp"))
    metres = distance_m(F.col("lon"), F.col("lat"), F.col("prev_lon"), F.col("prev_lat"))
    return F.when(F.col("prev_lon").isNotNull() & (seconds > 0), metres / seconds)


def _lag_point(df: DataFrame, keys) -> DataFrame:
    window = _track_window(keys)
    lagged = {f"prev_{c}": F.lag(c).over(window) for c in ("lon", "lat", "timestamp")}
    return df.withColumns(lagged).withColumn("speed_m_s", _speed())


def _point_speed(spread: DataFrame, keys) -> DataFrame:
    lagged = _lag_point(_with_previous(spread.drop("speed_m_s"), keys, 1), keys)
    return lagged.filter(~F.col("_halo")).drop("_halo")


def point_speed(df: DataFrame) -> DataFrame:
    """Speed in m/s from the previous point of the track; NULL without one or when time stands.

    Keeps `prev_lon`, `prev_lat` and `prev_timestamp`.
    """
    keyed = _spread(df.withColumn("unique_id_track", track_key()))
    result = _point_speed(keyed, ("unique_id_track", *TRACK)).drop("_slice")
    return result if "unique_id_track" in df.columns else result.drop("unique_id_track")


def drop_stationary(df: DataFrame, keep_first: bool = False) -> DataFrame:
    """Drop points equal to their predecessor with zero or unknown speed.

    The first point of a track has no predecessor: the predicate is NULL and the row goes too,
    unless keep_first is set. Input is the output of point_speed.
    """
    still = same_point(F.col("lon"), F.col("lat"), F.col("prev_lon"), F.col("prev_lat")) & (
        (F.col("speed_m_s") == 0) | F.col("speed_m_s").isNull()
    )
    moving = ~F.coalesce(still, F.lit(False)) if keep_first else ~still
    return df.filter(moving).drop("prev_lon", "prev_lat", "prev_timestamp")


def recompute_speed(df: DataFrame) -> DataFrame:
    """Speed again, per unique_id_track, after points were dropped."""
    again = _point_speed(_spread(df), ("unique_id_track",))
    return again.drop("_slice", "prev_lon", "prev_lat", "prev_timestamp")


def smooth_speed(df: DataFrame, n: int = SMOOTHING_ROWS) -> DataFrame:
    """Mean speed over the row and its n-1 predecessors in the track; NULL speeds are skipped."""
    keys = ("unique_id_track",)
    frame = _track_window(keys).rowsBetween(-(n - 1), 0)
    smoothed = _with_previous(_spread(df), keys, n - 1).withColumn(
        "speed_m_s_smooth", F.avg("speed_m_s").over(frame)
    )
    return smoothed.filter(~F.col("_halo")).drop("_halo", "_slice")


def _speed_and_smooth(spread: DataFrame, n: int) -> DataFrame:
    """recompute_speed and smooth_speed over one set of copies.

    The oldest copied row of a slice has no predecessor there and hence no speed, and no frame of
    an own row reaches it: n copied rows give n-1 speeds.
    """
    keys = ("unique_id_track",)
    frame = _track_window(keys).rowsBetween(-(n - 1), 0)
    both = _lag_point(_with_previous(spread.drop("speed_m_s"), keys, n), keys).withColumn(
        "speed_m_s_smooth", F.avg("speed_m_s").over(frame)
    )
    return both.filter(~F.col("_halo")).drop(
        "_halo", "_slice", "prev_lon", "prev_lat", "prev_timestamp"
    )


def clean_mobile(
    df: DataFrame,
    max_accuracy: float = MAX_ACCURACY_M,
    ref_pattern: str = REFERENCE_PATTERN,
    keep_first: bool = False,
    smooth_rows: int = SMOOTHING_ROWS,
) -> DataFrame:
    """Mobile thermometers: per-second rows without duplicates and standstills, with speeds.

    Three shuffles of the rows: per second and track, per place and second, per track and slice.
    """
    unique = drop_duplicates_by_position(aggregate_by_second(df, max_accuracy, ref_pattern))
    keyed = _spread(unique.withColumn("unique_id_track", track_key()))
    moving = drop_stationary(_point_speed(keyed, ("unique_id_track", *TRACK)), keep_first)
    return _speed_and_smooth(moving, smooth_rows)
