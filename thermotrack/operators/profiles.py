"""Data behind the charts: transects, difference classes, minute means and gap filling."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thermotrack.functions.times import epoch_us, local_time
from thermotrack.plans.sided_join import join_summary, shuffled
from thermotrack.plans.slices import (
    ascending,
    descending,
    join_null_safe,
    slice_offsets,
    time_slice,
)

# Bounds and colours of the temperature difference classes, zone labels.
DIFFERENCE_BOUNDS = (-10, -5, -4, -3, -2, -1, 0, 1, 2, 3, 4)
DIFFERENCE_COLOURS = (
    "#30123b",
    "#455bcd",
    "#3e9cfe",
    "#18d7cb",
    "#48f882",
    "#a4fc3c",
    "#fea331",
    "#ef5911",
    "#c22403",
    "#7a0403",
)
ZONES = ("Ville", "Campagne")
DAY_SECONDS = 86400


def select_thermo(df: DataFrame, name: str, ts: str = "timestamp") -> DataFrame:
    """Rows of one thermometer in time order (range-partitioned sort)."""
    return df.filter(F.col("thermo_name") == name).orderBy(F.col(ts).asc_nulls_last())


def transect_profile(
    df: DataFrame, split_ts, thermo=None, tz: str = "Europe/Paris", ts: str = "timestamp"
) -> DataFrame:
    """Rows with time, temperature, difference and elevation, labelled by the side of `split_ts`
    (local time in tz). A row exactly on the split belongs to both zones. All thermometers are
    taken unless one is named.
    """
    rows = df if thermo is None else df.filter(F.col("thermo_name") == thermo)
    rows = rows.dropna(subset=[ts, "temperature", "diff_temperature", "elevation"])
    rows = rows.withColumn("local_timestamp", local_time(df, ts, tz))
    split = F.lit(split_ts).cast("timestamp_ntz")
    zones = F.array(
        F.when(F.col("local_timestamp") <= split, F.lit(ZONES[0])),
        F.when(F.col("local_timestamp") >= split, F.lit(ZONES[1])),
    )
    return rows.withColumn("zone", F.explode(F.array_compact(zones)))


def classify_difference(
    df: DataFrame,
    bounds=DIFFERENCE_BOUNDS,
    colours=DIFFERENCE_COLOURS,
    column: str = "diff_temperature",
) -> DataFrame:
    """Half-open class of the difference and its colour; values outside go to the end classes."""
    if len(colours) != len(bounds) - 1:
        raise ValueError("one colour is needed for each class")
    passed = [(F.col(column) >= float(b)).cast("int") for b in bounds[1:-1]]
    palette = F.array(*[F.lit(c) for c in colours])
    classed = df.withColumn("diff_class", sum(passed, F.lit(0)))
    return classed.withColumn("diff_colour", F.get(palette, F.col("diff_class")))


def transect_summary(profile: DataFrame, by=("thermo_name",), ts: str = "timestamp") -> DataFrame:
    """Per series and zone: row count, timestamp of row n//2 in time order, lowest temperature;
    and per series the range of temperature and time over both zones.

    The middle row is found from counts per time slice, then ranked inside its one slice.
    """
    by = tuple(by)
    keys = (*by, "zone")
    sliced = profile.withColumn("_slice", time_slice(F.col(ts)))
    per_slice = sliced.groupBy(*keys, "_slice").agg(
        F.count("*").alias("_rows"),
        F.min("temperature").alias("_low"),
        F.max("temperature").alias("_high"),
        F.min(ts).alias("_first"),
        F.max(ts).alias("_last"),
    )
    zone_all = Window.partitionBy(*keys)
    series_all = Window.partitionBy(*by)
    located = (
        slice_offsets(per_slice, keys, "_slice", "_rows")
        .withColumn("zone_rows", F.sum("_rows").over(zone_all))
        .withColumn("zone_temperature_min", F.min("_low").over(zone_all))
        .withColumn("temperature_min", F.min("_low").over(series_all))
        .withColumn("temperature_max", F.max("_high").over(series_all))
        .withColumn("timestamp_min", F.min("_first").over(series_all))
        .withColumn("timestamp_max", F.max("_last").over(series_all))
        .withColumn("_middle", F.floor(F.col("zone_rows") / 2) - F.col("_offset"))
        .filter((F.col("_middle") >= 0) & (F.col("_middle") < F.col("_rows")))
        .drop("_rows", "_low", "_high", "_first", "_last", "_offset")
    )
    ordered = Window.partitionBy(*keys, "_slice").orderBy(*ascending(("mid_timestamp", "id")))
    candidates = sliced.select(*keys, "_slice", F.col(ts).alias("mid_timestamp"), "id")
    joined = join_summary(candidates, located, (*keys, "_slice"))
    return (
        joined.withColumn("_rank", F.row_number().over(ordered))
        .filter(F.col("_rank") == F.col("_middle") + 1)
        .select(
            *keys,
            "zone_rows",
            "mid_timestamp",
            "zone_temperature_min",
            "temperature_min",
            "temperature_max",
            "timestamp_min",
            "timestamp_max",
        )
    )


def minute_profile(
    df: DataFrame,
    by=("thermo_name",),
    columns=(("temperature", "sensor_t"), ("t_inter", "meteofrance_t")),
    step_seconds: int = 60,
    ts: str = "timestamp",
) -> DataFrame:
    """Mean of each column per step on a complete grid from the first to the last step of a series.

    The grid is built in two steps, days then steps of a day, so that no long array arises.
    """
    if DAY_SECONDS % step_seconds:
        raise ValueError("the step must divide a day")
    by = tuple(by)
    kind = df.schema[ts].dataType
    step = (F.floor(epoch_us(F.col(ts)) / (step_seconds * 1_000_000)) * step_seconds).cast("bigint")
    means = (
        df.filter(F.col(ts).isNotNull())
        .withColumn("_step", step)
        .groupBy(*by, "_step")
        .agg(*[F.avg(source).alias(name) for source, name in columns])
    )
    span = means.groupBy(*by).agg(F.min("_step").alias("_lo"), F.max("_step").alias("_hi"))
    day = F.floor(F.col("_lo") / DAY_SECONDS), F.floor(F.col("_hi") / DAY_SECONDS)
    days = span.withColumn("_day", F.explode(F.sequence(*day))).withColumn(
        "_day", F.col("_day") * DAY_SECONDS
    )
    first = F.greatest("_lo", "_day")
    last = F.least(F.col("_hi"), F.col("_day") + (DAY_SECONDS - step_seconds))
    grid = days.select(
        *by, F.explode(F.sequence(first, last, F.lit(step_seconds).cast("bigint"))).alias("_step")
    )
    joined = join_null_safe(grid, shuffled(means), (*by, "_step"), "left")
    stamp = F.timestamp_seconds("_step").cast(kind).alias(ts)
    return joined.select(*by, stamp, *[name for _, name in columns])


def fill_linear(
    df: DataFrame,
    columns,
    by=("thermo_name",),
    order: str = "timestamp",
    slice_seconds: int = DAY_SECONDS,
    ties=(),
) -> DataFrame:
    """Fill NULLs on the straight line between the nearest known rows, by row position. Leading
    gaps stay NULL, trailing gaps take the last known value. Rows of one `order` value are placed by
    the columns `ties`, then by the filled columns (NULL last), so every row has a place of its own.

    Known neighbours are searched inside the slice first; those of other slices come from a
    per-slice summary with the first and last known value of each column.
    """
    by = tuple(by)
    sliced = df.withColumn("_slice", time_slice(F.col(order), slice_seconds))
    keys = (*by, "_slice")
    placed = Window.partitionBy(*keys).orderBy(*ascending((order, *ties, *columns)))
    upto = (Window.unboundedPreceding, 0)
    forward = Window.partitionBy(*keys).orderBy("_row").rowsBetween(*upto)
    backward = Window.partitionBy(*keys).orderBy(F.desc("_row")).rowsBetween(*upto)
    numbered = sliced.withColumn("_row", F.row_number().over(placed).cast("bigint"))

    def known(c):
        return F.when(F.col(c).isNotNull(), F.struct(F.col("_row").alias("row"), F.col(c).alias("v")))

    per_slice = numbered.groupBy(*keys).agg(
        F.count("*").alias("_rows"),
        *[F.min(known(c)).alias(f"_first_{c}") for c in columns],
        *[F.max(known(c)).alias(f"_last_{c}") for c in columns],
    )
    offsets = slice_offsets(per_slice, by, "_slice", "_rows")

    def shifted(name):
        part = F.col(name)
        moved = F.struct((part["row"] + F.col("_offset")).alias("row"), part["v"].alias("v"))
        return F.when(part.isNotNull(), moved)

    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    later = (
        Window.partitionBy(*by).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = offsets.select(
        *keys,
        "_offset",
        *[F.last(shifted(f"_last_{c}"), True).over(earlier).alias(f"_carry_prev_{c}") for c in columns],
        *[F.last(shifted(f"_first_{c}"), True).over(later).alias(f"_carry_next_{c}") for c in columns],
    )
    inside = numbered.withColumns(
        {f"_prev_{c}": F.last(known(c), True).over(forward) for c in columns}
        | {f"_next_{c}": F.last(known(c), True).over(backward) for c in columns}
    )
    joined = join_summary(inside, carried, keys)
    position = F.col("_row") + F.col("_offset")

    def filled(c):
        prev = F.coalesce(shifted(f"_prev_{c}"), F.col(f"_carry_prev_{c}"))
        following = F.coalesce(shifted(f"_next_{c}"), F.col(f"_carry_next_{c}"))
        share = (position - prev["row"]) / (following["row"] - prev["row"])
        return (
            F.when(F.col(c).isNotNull(), F.col(c))
            .when(prev.isNotNull() & following.isNull(), prev["v"])
            .when(prev.isNotNull(), prev["v"] + (following["v"] - prev["v"]) * share)
            .alias(c)
        )

    return joined.select(*[filled(c) if c in columns else c for c in df.columns])
