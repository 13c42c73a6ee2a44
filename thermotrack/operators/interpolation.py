"""Reference temperature at sensor points: linear over station triangles and between two reports."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermotrack.functions.geo import edge_side
from thermotrack.functions.times import epoch_us
from thermotrack.operators.leaves import LEAF_KEY, LEAF_TRIANGLES, TriangleLeaves
from thermotrack.plans.checkpoints import checkpointed, checkpointed_count
from thermotrack.plans.sided_join import is_small, join_on_cell, shuffled

# Report step of the stations in seconds, temperature change per metre.
REPORT_SECONDS = 360
LAPSE_RATE = 0.0065
# Columns carried to the three output tables.
METEO_CARRY = (
    "unique_id_track",
    "speed_m_s",
    "temperature_bot",
    "temperature_top",
    "elevation",
    "thermo_name",
    "sensor_name",
)
MOBILE_CARRY = ("elevation", "speed_m_s", "thermo_name", "sensor_name", "unique_id_track")
REFERENCE_CARRY = ("thermo_name", "sensor_name", "unique_id_track")

_VERTICES = ("a", "b", "c")

# Fixed values of the filter of reports: rows it has at most, buckets that a row tells apart, and the
# number of buckets that one of its bits stands for, from fine to coarse.
FILTER_ROWS = 1 << 20
FILTER_BITS = 62
FILTER_GRAINS = (1, 16, 256, 4096)


def _edge_side(u: str, v: str, x: Column, y: Column) -> Column:
    return edge_side(*[F.col(f"{axis}_{end}") for end in (u, v) for axis in ("x", "y")], x, y)


def _with_owners(triangles: DataFrame) -> DataFrame:
    """For each vertex and edge, whether this triangle is the lowest-numbered one that has it."""
    corner = {v: F.col(f"sta_{v}") for v in _VERTICES}
    ends = {v: (corner[v], corner[v]) for v in _VERTICES} | {
        u + v: (corner[u], corner[v]) for u, v in (("a", "b"), ("b", "c"), ("a", "c"))
    }
    parts = F.array(
        *[
            F.struct(F.lit(name).alias("part"), u.alias("u"), v.alias("v"))
            for name, (u, v) in ends.items()
        ]
    )
    shared = Window.partitionBy("_p.u", "_p.v")
    owned = triangles.withColumn("_p", F.explode(parts)).withColumn(
        "_own", F.min("id_triangle").over(shared) == F.col("id_triangle")
    )
    return owned.groupBy("id_triangle").agg(
        *[F.first(c).alias(c) for c in triangles.columns if c != "id_triangle"],
        *[F.max(F.when(F.col("_p.part") == name, F.col("_own"))).alias(f"own_{name}") for name in ends],
    )


def locate_in_triangles(
    points: DataFrame,
    triangles: DataFrame,
    one_per_point: bool = False,
    leaf_triangles: int = LEAF_TRIANGLES,
) -> DataFrame:
    """Inner join of points with the triangles that hold them, borders included.

    Adds id_triangle, the stations sta_a/b/c and the linear weights w_a/b/c. A point on a shared
    edge or vertex comes once per triangle, or only with the lowest id_triangle if one_per_point
    is set; the latter is decided inside each row and needs no shuffle.

    Triangles are cut to the leaves of a tree of square cells (`TriangleLeaves`), so a point has one
    key and meets at most leaf_triangles triangles, however thin they are.
    """
    sorted_vertices = F.array_sort(F.array(*_VERTICES))
    ordered = triangles.withColumn("_v", sorted_vertices).select(
        "id_triangle",
        *[
            F.col("_v")[k][field].alias(f"{name}_{v}")
            for k, v in enumerate(_VERTICES)
            for field, name in (("station", "sta"), ("x", "x"), ("y", "y"))
        ],
    )
    if one_per_point:
        ordered = _with_owners(ordered)
    ends = {
        axis: [f(g(*[F.col(v)[axis] for v in _VERTICES])) for f, g in ((F.min, F.least), (F.max, F.greatest))]
        for axis in "xy"
    }
    box = triangles.agg(F.count("*").alias("n"), *[(high - low).alias(a) for a, (low, high) in ends.items()]).first()
    twice = _edge_side("a", "b", F.col("x_c"), F.col("y_c"))
    proper = ordered.withColumn("twice", twice).filter("twice <> 0")
    leaves = TriangleLeaves(proper, box["n"], max(box["x"] or 0.0, box["y"] or 0.0), leaf_triangles)
    keyed = leaves.with_leaf(points, "lon", "lat")
    joined = join_on_cell(keyed, leaves.pieces, LEAF_KEY, "id", leaves.rows)

    def share(u, v, direction):
        return direction * _edge_side(u, v, F.col("lon"), F.col("lat")) / F.col("twice")

    weighted = joined.withColumns(
        {"w_a": share("b", "c", 1), "w_b": share("a", "c", -1), "w_c": share("a", "b", 1)}
    ).filter((F.col("w_a") >= 0) & (F.col("w_b") >= 0) & (F.col("w_c") >= 0))
    if one_per_point:
        zero = {v: F.col(f"w_{v}") == 0 for v in _VERTICES}
        weighted = weighted.filter(
            F.when(zero["b"] & zero["c"], F.col("own_a"))
            .when(zero["a"] & zero["c"], F.col("own_b"))
            .when(zero["a"] & zero["b"], F.col("own_c"))
            .when(zero["a"], F.col("own_bc"))
            .when(zero["b"], F.col("own_ac"))
            .when(zero["c"], F.col("own_ab"))
            .otherwise(True)
        )
    added = [f"{name}_{v}" for name in ("sta", "w") for v in _VERTICES]
    return weighted.select(*points.columns, "id_triangle", *added)


def join_station_observations(
    located: DataFrame,
    obs: DataFrame,
    window_seconds: int = REPORT_SECONDS,
    station: str = "numer_sta",
    date: str = "date",
    ts: str = "timestamp",
    latest_only: bool = True,
) -> DataFrame:
    """Join each located point with the reports of its vertex stations in (ts - window, ts].

    By default one row per located point, with obs_a/b/c: the latest report of each station, or NULL
    (of several at one instant the one with the largest t_ground_0, then delta_t). With
    latest_only=False one row per point and report, with vertex ('a', 'b', 'c'), station, t_ground_0,
    delta_t, time_interp_weight, and weight, the point's linear weight of that vertex. Points without
    any report are dropped.

    Points are not multiplied by vertices. The distinct (triangle, time bucket) pairs that occur meet
    the reports of their three stations in two buckets by an equi-join. For the latest reports, windows
    over a pair turn its reports into segments of time, each with what the three stations said last,
    and a point joins the one segment it lies in. For all reports it joins those of its pair that lie
    in its window. No list of reports is built, however often a station reports. Pairs and what is
    found for them are saved and counted: while they are few they are broadcast, and the points stay
    where they are.
    """
    window_us = window_seconds * 1_000_000
    located = checkpointed(located)  # the join with the triangles is read twice
    bucketed = located.withColumn("_us", epoch_us(F.col(ts))).withColumn(
        "_bucket", F.floor(F.col("_us") / window_us).cast("bigint")
    )
    reports = obs.select(
        F.col(station).cast("bigint").alias("_station"),
        epoch_us(F.col(date)).alias("_at"),
        F.col("t_ground_0").cast("double").alias("t_ground_0"),
        F.col("delta_t").cast("double").alias("delta_t"),
    )
    found = _reports_of_pairs(bucketed, reports, window_us)
    found, rows = checkpointed_count(_segments(found) if latest_only else found)
    joined = join_on_cell(bucketed, found, ("id_triangle", "_bucket"), "id", rows)

    def weight(at) -> Column:
        return (F.col("_us") - at) / window_us

    if not latest_only:
        inside = (F.col("_at") <= F.col("_us")) & (F.col("_at") > F.col("_us") - window_us)
        own = F.element_at(
            F.create_map(*[x for v in _VERTICES for x in (F.lit(v), F.col(f"w_{v}"))]), F.col("vertex")
        )
        return joined.filter(inside).select(
            *located.columns,
            "vertex",
            F.col("_station").alias("station"),
            "t_ground_0",
            "delta_t",
            weight(F.col("_at")).alias("time_interp_weight"),
            own.alias("weight"),
        )
    inside = (F.col("_from") <= F.col("_us")) & (F.col("_us") < F.col("_until"))

    def valid(v) -> Column:
        last = F.col(f"last_{v}")
        in_window = last["at"] > F.col("_us") - window_us
        said = F.struct(
            last["t_ground_0"].alias("t_ground_0"),
            last["delta_t"].alias("delta_t"),
            weight(last["at"]).alias("time_interp_weight"),
        )
        return F.when(in_window, said).alias(f"obs_{v}")

    valued = joined.filter(inside).select(*located.columns, *[valid(v) for v in _VERTICES])
    return valued.filter(F.coalesce("obs_a", "obs_b", "obs_c").isNotNull())


def _reports_of_pairs(bucketed: DataFrame, reports: DataFrame, window_us: int) -> DataFrame:
    """The reports that points of each (id_triangle, _bucket) may need: vertex, _station, _at, values."""
    corners = [
        F.struct(F.lit(v).alias("vertex"), F.col(f"sta_{v}").cast("bigint").alias("_station"))
        for v in _VERTICES
    ]
    pairs, n = checkpointed_count(
        bucketed.select("id_triangle", "_bucket", *[f"sta_{v}" for v in _VERTICES]).distinct()
    )
    wanted = (
        pairs.select("id_triangle", "_bucket", F.explode(F.array(*corners)).alias("_c"))
        .select("id_triangle", "_bucket", "_c.*")
        .withColumn("_report_bucket", F.explode(F.array(F.col("_bucket") - 1, F.col("_bucket"))))
    )
    few = is_small(wanted, 6 * n)
    keyed = reports.withColumn("_report_bucket", F.floor(F.col("_at") / window_us).cast("bigint"))
    return _maybe_wanted(keyed, wanted).join(
        F.broadcast(wanted) if few else shuffled(wanted), ["_station", "_report_bucket"]
    ).drop("_report_bucket")


def _maybe_wanted(reports: DataFrame, wanted: DataFrame, most: int = FILTER_ROWS) -> DataFrame:
    """reports without most of those whose (_station, _report_bucket) is not wanted, so that an archive
    much larger than what the points ask for is not shuffled; none that is wanted is lost.

    Two filters of at most `most` rows each are broadcast, whatever the session's bound for tables says:
    the stations, by a hash of so many values, before anything else is worked out of a report; and for
    each of these and each span of buckets one number with a bit per bucket. Where the spans are too
    many, a bit stands for more buckets; beyond the coarsest grain only the stations count.
    """
    group = F.pmod(F.xxhash64("_station"), F.lit(most)).alias("_group")
    keys = checkpointed(wanted.select(group, "_report_bucket").distinct())
    stations = keys.select("_group").distinct()
    of_station = F.pmod(F.xxhash64(reports["_station"]), F.lit(most)) == stations["_group"]
    kept = reports.join(F.broadcast(stations), of_station, "left_semi")
    for grain in FILTER_GRAINS:
        place = F.floor(F.col("_report_bucket") / grain).cast("bigint")
        span = F.floor(place / FILTER_BITS).cast("bigint").alias("_span")
        bit = F.expr("shiftleft(1L, cast(_bit as int))")
        marked = keys.select("_group", span, F.pmod(place, F.lit(FILTER_BITS)).alias("_bit"))
        spans, n = checkpointed_count(marked.groupBy("_group", "_span").agg(F.bit_or(bit).alias("_bits")))
        if n <= most:
            asked = kept.select("*", group, span, F.pmod(place, F.lit(FILTER_BITS)).alias("_bit"))
            found = asked.join(F.broadcast(spans), ["_group", "_span"]).filter(F.col("_bits").bitwiseAND(bit) != 0)
            return found.select(*reports.columns)
    return kept


def _segments(found: DataFrame) -> DataFrame:
    """Half-open spans [_from, _until) of each pair's time between two instants of reports, with the
    last report of each vertex station so far.
    """
    said = F.struct(F.col("_at").alias("at"), "t_ground_0", "delta_t")
    pair = Window.partitionBy("id_triangle", "_bucket")
    order = pair.orderBy("_at", "t_ground_0", "delta_t")  # nulls first: the largest comes last
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        found.withColumns(
            {
                f"last_{v}": F.last(F.when(F.col("vertex") == v, said), ignorenulls=True).over(so_far)
                for v in _VERTICES
            }
            | {"_until": F.coalesce(F.lead("_at").over(order), F.lit((1 << 63) - 1))}
        )
        .withColumnRenamed("_at", "_from")
        .filter(F.col("_from") < F.col("_until"))
        .select("id_triangle", "_bucket", "_from", "_until", *[f"last_{v}" for v in _VERTICES])
    )


def interpolate_plane(df: DataFrame, lapse: float = LAPSE_RATE) -> DataFrame:
    """Add t_inter, the value at the point of the plane through its three stations, moved to the
    instant and the elevation of the point; NULL unless all three have a report.
    """
    value = F.lit(0.0)
    for v in _VERTICES:
        part = F.col(f"obs_{v}")
        value = value + F.col(f"w_{v}") * (
            part["t_ground_0"] + part["delta_t"] * part["time_interp_weight"]
        )
    return df.withColumn("t_inter", value - lapse * F.col("elevation"))


def pick_one_per_id(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """One row per id: the latest, then the lowest triangle."""
    order = Window.partitionBy("id").orderBy(F.col(ts).desc_nulls_first(), "id_triangle")
    return (
        df.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") == 1).drop("_rank")
    )


def interpolate_temperature(
    points: DataFrame, triangles: DataFrame, obs: DataFrame, carry=(), lapse: float = LAPSE_RATE
) -> DataFrame:
    """Measured and interpolated temperature of each point inside the triangulation.

    Ids of points are taken to be unique.
    """
    base = ("id", "timestamp", "temperature", "lon", "lat", "elevation")
    needed = points.select(*base, *[c for c in carry if c not in base])
    located = locate_in_triangles(needed, triangles, one_per_point=True)
    valued = interpolate_plane(join_station_observations(located, obs), lapse)
    return valued.select(
        "id",
        "timestamp",
        "temperature",
        "t_inter",
        (F.col("temperature") - F.col("t_inter")).alias("diff_temperature"),
        "lon",
        "lat",
        "id_triangle",
        *carry,
    )


def interpolate_meteo(points: DataFrame, triangles: DataFrame, obs: DataFrame) -> DataFrame:
    """interpolate_temperature for the cleaned bike table."""
    return interpolate_temperature(points, triangles, obs, METEO_CARRY)


def interpolate_mobile(points: DataFrame, triangles: DataFrame, obs: DataFrame) -> DataFrame:
    """interpolate_temperature for the cleaned mobile thermometers."""
    return interpolate_temperature(points, triangles, obs, MOBILE_CARRY)


def interpolate_reference(points: DataFrame, triangles: DataFrame, obs: DataFrame) -> DataFrame:
    """interpolate_temperature for the cleaned reference sensors."""
    return interpolate_temperature(points, triangles, obs, REFERENCE_CARRY)
