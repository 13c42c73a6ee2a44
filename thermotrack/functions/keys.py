"""Track identity."""

from pyspark.sql import Column
from pyspark.sql import functions as F

TRACK = ("sensor_name", "thermo_name", "id_track")


def track_key(id_track="id_track", sensor="sensor_name", thermo="thermo_name") -> Column:
    """md5 hex of the three parts joined by a pipe; NULL as soon as one part is NULL."""
    bar = F.lit("|")
    return F.md5(F.concat(F.col(id_track).cast("string"), bar, F.col(sensor), bar, F.col(thermo)))
