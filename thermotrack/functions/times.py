"""Column expressions for instants, local times and exact rounding."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970. Zone-less timestamps are read in the session zone (UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (epoch_us(later) - epoch_us(earlier)) / F.lit(1e6)


def truncate(df: DataFrame, unit: str, ts: str) -> Column:
    """date_trunc that keeps the type of the column (Spark returns a zoned timestamp)."""
    return F.date_trunc(unit, F.col(ts)).cast(df.schema[ts].dataType)


def local_time(df: DataFrame, ts: str, tz: str) -> Column:
    """Wall-clock time of an instant in zone tz; zone-less input is taken as UTC."""
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return F.convert_timezone(F.lit("UTC"), F.lit(tz), F.col(ts))
    return F.convert_timezone(None, F.lit(tz), F.col(ts).cast("timestamp_ntz"))


def round_numeric(value: Column, digits: int = 2) -> Column:
    """Half-up rounding of a double after its 15 significant digits, as SQL numeric does.

    22.244999999999997 stands for 22.245 and rounds to 22.25.
    """
    return F.round(F.format_string("%.14e", value).cast("decimal(38,15)"), digits)
