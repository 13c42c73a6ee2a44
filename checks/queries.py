"""One Spark query per operator, over the whole derived tables."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import thermotrack as tt
from checks.inputs import lcz_polygons, spark_table
from checks.oracles import CLEAN_END, CLEAN_START, DIGITS, RADIUS, SPLIT
from thermotrack.functions.keys import TRACK, track_key
from thermotrack.operators.landcover import TOUCH
from thermotrack.plans.checkpoints import checkpointed
from thermotrack.plans.sided_join import BROADCAST_SETTING
from thermotrack.sources.tables import drop_table, index_table_name, replace_table

PER_DEGREE = 111319.49079327358  # EPSG:3857 units per degree on the equator


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to DIGITS decimals, decimals to doubles; adding zero turns -0.0 into 0.0."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            c = (F.round(c, DIGITS) + F.lit(0.0)).alias(field.name)
        elif isinstance(field.dataType, T.DecimalType):
            c = c.cast("double").alias(field.name)
        out.append(c)
    return df.select(*out)


def _table(name):
    return lambda spark, sf: spark_table(spark, sf, name)


_mobile_raw, _meteo_raw, _stations, _obs, _lcz_points = map(
    _table, ("mobile_raw", "meteo_raw", "stations", "station_obs", "lcz_points")
)


def _mobile(spark, sf):
    return tt.clean_mobile(_mobile_raw(spark, sf))


def _meteo(spark, sf):
    return tt.clean_meteo(_meteo_raw(spark, sf), CLEAN_START, CLEAN_END)


def _reference(spark, sf):
    return tt.clean_reference(_mobile_raw(spark, sf))


def _triangles(spark, sf):
    return tt.delaunay_triangles(_stations(spark, sf))


def _mobile_inter(spark, sf):
    """Interpolation reads its points twice, so the cleaned table is saved first."""
    cleaned = checkpointed(_mobile(spark, sf))
    return tt.interpolate_mobile(cleaned, _triangles(spark, sf), _obs(spark, sf))


def _profile(spark, sf):
    return tt.transect_profile(_mobile_inter(spark, sf), SPLIT)


def _hour_range_stats_mobile(spark, sf):
    stats = tt.hour_range_stats(
        _mobile_raw(spark, sf),
        ("temperature", "humidity", "accuracy"),
        ((0, 24), (12, 18), (18, 24), (21, 6)),
    )
    return tt.hour_amplitude(stats)


def _hour_range_stats_meteo(spark, sf):
    stats = tt.hour_range_stats(
        _meteo_raw(spark, sf),
        ("temperature", "humidite", "vitesse", "temperature_bot", "temperature_top"),
        ((12, 18), (18, 24), (21, 6)),
    )
    return tt.hour_amplitude(stats)


def _speeds(spark, sf):
    unique = tt.drop_duplicates_by_position(tt.aggregate_by_second(_mobile_raw(spark, sf)))
    return tt.point_speed(unique)


def _point_speed(spark, sf):
    return _speeds(spark, sf).select(
        "id", *TRACK, "timestamp", "lon", "lat", "prev_lon", "prev_lat", "speed_m_s"
    )


def _drop_stationary(spark, sf):
    moving = tt.drop_stationary(_speeds(spark, sf))
    return moving.select("id", *TRACK, "timestamp", "lon", "lat", "speed_m_s")


def _recomputed(spark, sf):
    keyed = tt.drop_stationary(_speeds(spark, sf)).withColumn("unique_id_track", track_key())
    return tt.recompute_speed(keyed)


def _recompute_speed(spark, sf):
    return _recomputed(spark, sf).select("id", "unique_id_track", "timestamp", "speed_m_s")


def _smooth_speed(spark, sf):
    smoothed = tt.smooth_speed(_recomputed(spark, sf))
    return smoothed.select("id", "unique_id_track", "timestamp", "speed_m_s_smooth")


def _track_keys(spark, sf):
    keyed = _mobile_raw(spark, sf).withColumn("unique_id_track", track_key())
    return keyed.groupBy(*TRACK, "unique_id_track").agg(F.count("*").alias("points"))


def _biometeo_index(spark, sf):
    return tt.biometeo_index(tt.union_sources(_mobile(spark, sf), _meteo(spark, sf)))


def _flat_triangles(spark, sf):
    return _flat(_triangles(spark, sf))


def _flat(triangles):
    return triangles.select(
        "id_triangle",
        *[
            F.col(f"{v}.{field}").alias(name)
            for v in "abc"
            for field, name in (("station", f"sta_{v}"), ("x", f"x{v}"), ("y", f"y{v}"))
        ],
    )


def _tiled_triangles(spark, sf):
    """The same triangles from ten tiles and more, ten stations in each at least."""
    stations = checkpointed(_stations(spark, sf))
    tile = max(10, stations.count() // 10)
    return _flat(tt.delaunay_triangles(stations, tile_points=tile))


def _attach_station_id(spark, sf):
    vertices = tt.triangle_vertices(_triangles(spark, sf), closed=True).drop("numer_insee")
    return tt.attach_station_id(vertices, _stations(spark, sf))


def _located(spark, sf):
    points = _mobile(spark, sf).select("id", "lon", "lat", "timestamp", "elevation")
    return tt.locate_in_triangles(checkpointed(points), _triangles(spark, sf))


def _locate(spark, sf):
    return _located(spark, sf).select(
        "id", "lon", "lat", "id_triangle", "sta_a", "sta_b", "sta_c"
    )


def _pick_one(spark, sf):
    return tt.pick_one_per_id(_located(spark, sf)).select("id", "id_triangle")


def _plane(spark, sf):
    joined = tt.join_station_observations(_located(spark, sf), _obs(spark, sf))
    return tt.interpolate_plane(joined).select("id", "id_triangle", "t_inter")


def _observations(spark, sf):
    return _by_station(tt.join_station_observations(_located(spark, sf), _obs(spark, sf)))


def _by_station(joined):
    vertices = F.array(
        *[
            F.when(
                F.col(f"obs_{v}").isNotNull(),
                F.struct(F.col(f"sta_{v}").alias("numer_sta"), F.col(f"obs_{v}.*")),
            )
            for v in "abc"
        ]
    )
    return joined.select("id", "id_triangle", F.explode(F.array_compact(vertices)).alias("o")).select(
        "id", "id_triangle", "o.*"
    )


def _dense_obs(spark, sf):
    """Reports of every second station twice in six minutes, and of every fifth one doubled as well."""
    obs = _obs(spark, sf)
    moved = obs.filter("numer_sta % 2 = 0").withColumns(
        {"date": F.expr("date + interval 90 seconds"), "t_ground_0": F.col("t_ground_0") + 1}
    )
    doubled = obs.filter("numer_sta % 5 = 0").withColumn("delta_t", F.col("delta_t") + 2)
    return obs.unionByName(moved).unionByName(doubled)


def _observations_all(spark, sf):
    joined = tt.join_station_observations(_located(spark, sf), _dense_obs(spark, sf), latest_only=False)
    return joined.select(
        "id", "id_triangle", "station", "t_ground_0", "delta_t", "time_interp_weight", "weight"
    )


def _observations_dense(spark, sf):
    return _by_station(tt.join_station_observations(_located(spark, sf), _dense_obs(spark, sf)))


def _project_points(spark, sf):
    moved = tt.project_points_3857(_mobile_raw(spark, sf))
    return moved.select("id", F.round("x3857", 3).alias("x3857"), F.round("y3857", 3).alias("y3857"))


def _project_rings(spark, sf):
    def degrees(p):
        return F.struct((p["x"] / PER_DEGREE).alias("x"), (p["y"] / PER_DEGREE).alias("y"))

    rings = F.transform("rings_3857", lambda ring: F.transform(ring, degrees))
    layer = lcz_polygons(spark, sf).withColumn("rings", rings).drop("rings_3857")
    parts = tt.project_rings_3857(layer).select(
        "poly_id", F.posexplode("rings_3857").alias("part", "ring")
    )
    corners = parts.select("poly_id", "part", F.posexplode("ring").alias("corner", "p"))
    return corners.select(
        "poly_id",
        "part",
        (F.col("corner") + 1).alias("corner"),
        F.round("p.x", 3).alias("x3857"),
        F.round("p.y", 3).alias("y3857"),
    )


def _union_sources(spark, sf):
    return tt.union_sources(_mobile_raw(spark, sf), _meteo_raw(spark, sf))


def _intersecting(quad_segs, touch=TOUCH):
    def query(spark, sf):
        return tt.intersecting_polygons(
            _lcz_points(spark, sf), lcz_polygons(spark, sf), RADIUS, quad_segs, touch
        )

    return query


def _overlap(quad_segs):
    def query(spark, sf):
        return tt.overlap_fraction(_lcz_points(spark, sf), lcz_polygons(spark, sf), RADIUS, quad_segs)

    return query


def _rank_classes(spark, sf):
    return tt.rank_classes(tt.fraction_by_class(_overlap(8)(spark, sf)))


def _lcz_fractions(quad_segs, touch=TOUCH):
    def query(spark, sf):
        return tt.lcz_fractions(
            _lcz_points(spark, sf),
            lcz_polygons(spark, sf),
            ["temperature", "timestamp"],
            RADIUS,
            quad_segs,
            touch,
        )

    return query


def _pivot_classes(spark, sf):
    return tt.pivot_classes(_rank_classes(spark, sf))


def _profile_rows(spark, sf):
    return _profile(spark, sf).select(
        "id",
        "thermo_name",
        "zone",
        "timestamp",
        "local_timestamp",
        "temperature",
        "diff_temperature",
        "elevation",
    )


def _classes(spark, sf):
    return tt.classify_difference(_mobile_inter(spark, sf).select("id", "diff_temperature"))


def _minutes(spark, sf):
    return tt.minute_profile(checkpointed(_mobile_inter(spark, sf)))


def _filled(spark, sf):
    return tt.fill_linear(checkpointed(_minutes(spark, sf)), ("sensor_t", "meteofrance_t"))


def _filled_raw(spark, sf):
    """Gaps in points that share their minute: ties are placed by id."""
    points = _mobile_inter(spark, sf).select(
        "id",
        "thermo_name",
        F.date_trunc("minute", "timestamp").cast("timestamp_ntz").alias("timestamp"),
        F.when(F.col("id") % 3 != 0, F.col("temperature")).alias("temperature"),
    )
    return tt.fill_linear(checkpointed(points), ("temperature",), ties=("id",))


def _far(query):
    """The query as it runs when nothing may be broadcast by count."""

    def run(spark, sf):
        spark.conf.set(BROADCAST_SETTING, "0")
        try:
            return query(spark, sf)
        finally:
            spark.conf.unset(BROADCAST_SETTING)

    return run


def _round_trip(spark, sf):
    """A cleaned table written, replaced by a second writing, and read back."""
    name = f"thermotrack_sink_{uuid.uuid4().hex}"
    replace_table(_reference(spark, sf).limit(0), name)
    return replace_table(_reference(spark, sf), name)


def _replaced_from_itself(spark, sf):
    """A cleaned table replaced by a result that reads it."""
    name = f"thermotrack_sink_{uuid.uuid4().hex}"
    table = replace_table(_reference(spark, sf), name)
    warmer = table.withColumn("temperature", F.col("temperature") + 1)
    return replace_table(table.filter("id % 2 = 0").unionByName(warmer.filter("id % 2 = 1")), name)


def _dropped(spark, sf):
    """The index under its default name, and whether the name is gone after the drop."""
    name = index_table_name(f"thermotrack_{uuid.uuid4().hex}")
    saved = replace_table(tt.biometeo_index(_meteo(spark, sf)), name)
    days = saved.agg(F.count("*").alias("days")).first()["days"]
    drop_table(spark, name)
    return _meteo(spark, sf).agg(
        F.count_distinct(F.to_date("timestamp")).alias("days"),
        F.lit(days).cast("bigint").alias("saved_days"),
        F.lit(name.endswith("_ibm")).alias("named"),
        F.lit(spark.catalog.tableExists(name)).alias("left_over"),
    )


def _select_thermo(spark, sf):
    chosen = tt.select_thermo(_mobile(spark, sf), "Thermo 1")
    return chosen.select("id", "timestamp", "temperature", "humidity")


_QUERIES = {
    "hour_range_stats_mobile": _hour_range_stats_mobile,
    "hour_range_stats_meteo": _hour_range_stats_meteo,
    "clean_meteo": _meteo,
    "aggregate_by_second": lambda spark, sf: tt.aggregate_by_second(_mobile_raw(spark, sf)),
    "drop_duplicates_by_position": lambda spark, sf: tt.drop_duplicates_by_position(
        tt.aggregate_by_second(_mobile_raw(spark, sf))
    ),
    "point_speed": _point_speed,
    "drop_stationary": _drop_stationary,
    "recompute_speed": _recompute_speed,
    "smooth_speed": _smooth_speed,
    "clean_mobile": _mobile,
    "clean_reference": _reference,
    "track_keys": _track_keys,
    "union_sources": _union_sources,
    "biometeo_index": _biometeo_index,
    "biometeo_index_by_thermo": lambda spark, sf: tt.biometeo_index(
        _mobile(spark, sf), by=("thermo_name",)
    ),
    "index_summary": lambda spark, sf: tt.index_summary(tt.biometeo_index(_meteo(spark, sf))),
    "delaunay_triangles": _flat_triangles,
    "delaunay_triangles_tiled": _tiled_triangles,
    "triangle_vertices": lambda spark, sf: tt.triangle_vertices(_triangles(spark, sf)),
    "attach_station_id": _attach_station_id,
    "locate_in_triangles": _locate,
    "pick_one_per_id": _pick_one,
    "join_station_observations": _observations,
    "join_station_observations_all": _observations_all,
    "join_station_observations_dense": _observations_dense,
    "interpolate_plane": _plane,
    "interpolate_mobile": _mobile_inter,
    "interpolate_meteo": lambda spark, sf: tt.interpolate_meteo(
        checkpointed(_meteo(spark, sf)), _triangles(spark, sf), _obs(spark, sf)
    ),
    "interpolate_reference": lambda spark, sf: tt.interpolate_reference(
        checkpointed(_reference(spark, sf)), _triangles(spark, sf), _obs(spark, sf)
    ),
    "project_points_3857": _project_points,
    "project_rings_3857": _project_rings,
    "intersecting_polygons": _intersecting(8),
    "intersecting_polygons_touching": _intersecting(8, None),
    "intersecting_polygons_touching_disc": _intersecting(None, None),
    "overlap_fraction": _overlap(8),
    "overlap_fraction_disc": _overlap(None),
    "fraction_by_class": lambda spark, sf: tt.fraction_by_class(_overlap(8)(spark, sf)),
    "rank_classes": _rank_classes,
    "pivot_classes": _pivot_classes,
    "lcz_fractions": _lcz_fractions(8),
    "lcz_fractions_disc": _lcz_fractions(None),
    "lcz_fractions_touching": _lcz_fractions(8, None),
    "transect_profile": _profile_rows,
    "transect_summary": lambda spark, sf: tt.transect_summary(
        checkpointed(_profile(spark, sf))
    ),
    "classify_difference": _classes,
    "minute_profile": _minutes,
    "fill_linear": _filled,
    "fill_linear_raw": _filled_raw,
    "select_thermo": _select_thermo,
    "replace_table": _round_trip,
    "replace_table_from_itself": _replaced_from_itself,
    "drop_table": _dropped,
}
_QUERIES |= {
    f"{name}_shuffled": _far(_QUERIES[name])
    for name in (
        "locate_in_triangles",
        "join_station_observations",
        "join_station_observations_all",
        "overlap_fraction",
        "lcz_fractions",
        "transect_summary",
        "fill_linear",
    )
}


def queries():
    def wrap(query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _rounded(query(spark, sf_dir))

        return run

    return {name: wrap(query) for name, query in _QUERIES.items()}
