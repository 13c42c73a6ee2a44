"""Mobile-climate analytics as PySpark DataFrame operators.

Python functions of this package travel to the executors by value, so the workers need no copy of
it on their path.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from thermotrack.functions.keys import track_key
from thermotrack.operators.cleaning import (
    aggregate_by_second,
    clean_meteo,
    clean_mobile,
    clean_reference,
    drop_duplicates_by_position,
    drop_stationary,
    point_speed,
    recompute_speed,
    smooth_speed,
)
from thermotrack.operators.heat import biometeo_index, index_summary, union_sources
from thermotrack.operators.interpolation import (
    interpolate_meteo,
    interpolate_mobile,
    interpolate_plane,
    interpolate_reference,
    interpolate_temperature,
    join_station_observations,
    locate_in_triangles,
    pick_one_per_id,
)
from thermotrack.operators.landcover import (
    fraction_by_class,
    intersecting_polygons,
    lcz_fractions,
    overlap_fraction,
    pivot_classes,
    project_points_3857,
    project_rings_3857,
    rank_classes,
)
from thermotrack.operators.profiles import (
    classify_difference,
    fill_linear,
    minute_profile,
    select_thermo,
    transect_profile,
    transect_summary,
)
from thermotrack.operators.stats import hour_amplitude, hour_range_stats
from thermotrack.operators.triangulation import (
    attach_station_id,
    delaunay_triangles,
    triangle_vertices,
)

__all__ = [name for name in dir() if not name.startswith("_")]
