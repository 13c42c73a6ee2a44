"""Share of each land-cover class in a buffer around each point."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermotrack.functions.clip import clip_ring, ring_area2, rotated
from thermotrack.functions.geo import mercator_x, mercator_y
from thermotrack.functions.overlap import buffer_area, with_edge_area
from thermotrack.plans.checkpoints import checkpointed
from thermotrack.plans.sided_join import is_small, join_on_cell, tasks_for

# Class codes with a column of their own, and their groups.
LCZ_CLASSES = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 101, 102, 103, 104, 105, 106, 107)
LCZ_GROUPS = {
    "lcz_urban": (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 105),
    "lcz_vegetation": (101, 102, 103, 104),
    "lcz_bare": (106,),
    "lcz_water": (107,),
}
RADIUS = 100
QUAD_SEGS = 8  # a buffer drawn with 8 segments per quarter circle
TOUCH = 1e-9  # a share up to this is a polygon that only touches the buffer
RANK_DIGITS = 9
STEPS_PER_SHUFFLE = 4
TASK_POINTS = 50_000  # a point comes with some dozens of edges and the sums of its polygons
_CELL = ("cell_x", "cell_y")


def project_points_3857(points: DataFrame) -> DataFrame:
    """Add x3857, y3857 from lon, lat."""
    return points.withColumns(
        {"x3857": mercator_x(F.col("lon")), "y3857": mercator_y(F.col("lat"))}
    )


def project_rings_3857(polygons: DataFrame) -> DataFrame:
    """Add rings_3857 from rings in degrees."""
    def move(p):
        return F.struct(mercator_x(p["x"]).alias("x"), mercator_y(p["y"]).alias("y"))

    rings = F.transform("rings", lambda ring: F.transform(ring, move))
    return polygons.withColumn("rings_3857", rings)


def _projected(points: DataFrame) -> DataFrame:
    return points if "x3857" in points.columns else project_points_3857(points)


def _along(ring: str, axis: str) -> Column:
    return F.transform(ring, lambda p: p[axis])


def _range(axis: str) -> list[Column]:
    values = _along("ring", axis)
    return [F.array_min(values).alias("lo"), F.array_max(values).alias("hi")]


def _cells_of(ring: str, axis: str, side: float, radius: float) -> list[Column]:
    """First and last cell whose points can have something of the ring in their buffer."""
    values = _along(ring, axis)
    return [
        F.floor((f(values) + shift) / side).cast("bigint")
        for f, shift in ((F.array_min, -radius), (F.array_max, radius))
    ]


def _cell_pieces(rings: DataFrame, kept, side: float, radius: float, reach: float) -> DataFrame:
    """(kept, cell_x, cell_y, ring): rings cut to each cell widened by reach.

    A ring is cut in two across the longer side of its range of cells, its parts again, and so on:
    every step halves what a row holds, and rows are dealt out anew before the first steps and after
    every few, so that a large ring is neither copied once per column of cells nor left to one task.
    """
    tasks = int(rings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = ("x_lo", "x_hi", "y_lo", "y_hi")
    cells = dict(zip(ranges, _cells_of("ring", "x", side, radius) + _cells_of("ring", "y", side, radius), strict=True))
    pieces = rings.withColumns(cells).select(*kept, *ranges, "ring")
    widest = pieces.agg(*[F.max(F.col(f"{a}_hi") - F.col(f"{a}_lo")).alias(a) for a in "xy"]).first()
    steps = sum((widest[a] or 0).bit_length() for a in "xy")
    # Cutting is heavy for its few bytes of input, so the number of tasks is not left to AQE.
    pieces = pieces.repartition(tasks, *kept[:1])
    for step in range(steps):
        if step and step % STEPS_PER_SHUFFLE == 0:
            pieces = pieces.repartition(tasks, *kept[:1], "x_lo", "y_lo")
        pieces = _halved(pieces, kept, ranges, side, radius, reach)
    return pieces.select(*kept, F.col("x_lo").alias("cell_x"), F.col("y_lo").alias("cell_y"), "ring")


def _halved(pieces: DataFrame, kept, ranges, side: float, radius: float, reach: float) -> DataFrame:
    """Both halves of every piece of more than one cell, without those that reach no cell of theirs."""

    def half(axis, above):
        """The cells from the middle on (above) or before it, and where the ring is cut."""
        middle = F.shiftright(F.col(f"{axis}_lo") + F.col(f"{axis}_hi"), 1)
        own = {c: F.col(c) for c in ranges}
        own[f"{axis}_lo" if above else f"{axis}_hi"] = middle + 1 if above else middle
        return F.struct(
            *[v.alias(c) for c, v in own.items()],
            F.lit(f"{axis}{int(above)}").alias("cut"),
            ((middle + 1) * side - reach if above else (middle + 1) * side + reach).alias("bound"),
        )

    spans = [F.col(f"{a}_hi") - F.col(f"{a}_lo") for a in "xy"]
    whole = F.struct(*ranges, F.lit("").alias("cut"), F.lit(0.0).alias("bound"))
    halves = (
        F.when((spans[0] > 0) & (spans[0] >= spans[1]), F.array(half("x", False), half("x", True)))
        .when(spans[1] > 0, F.array(half("y", False), half("y", True)))
        .otherwise(F.array(whole))
    )
    cut = pieces.withColumn("_h", F.explode(halves)).select(*kept, "_h.*", "ring")
    ring = F.col("ring")
    for axis in "xy":
        values = _along("ring", axis)
        for above in (False, True):
            beside = F.array_min(values) >= F.col("bound") if above else F.array_max(values) <= F.col("bound")
            mine = F.col("cut") == f"{axis}{int(above)}"
            ring = F.when(mine & ~beside, clip_ring(F.col("ring"), axis, F.col("bound"), above)).otherwise(ring)
    cut = cut.withColumn("ring", ring).filter(F.size("ring") > 0)
    for axis in "xy":
        first, last = _cells_of("ring", axis, side, radius)
        cut = cut.withColumns(
            {f"{axis}_lo": F.greatest(f"{axis}_lo", first), f"{axis}_hi": F.least(f"{axis}_hi", last)}
        )
    return cut.filter("x_lo <= x_hi and y_lo <= y_hi").select(*pieces.columns)


def _clipped_edges(polygons: DataFrame, radius: float) -> DataFrame:
    """Polygon edges per grid cell: each ring cut to every cell widened by the radius.

    The whole buffer of a point lies in the widened cell of the point, so a point needs only the
    edges under its one cell; a large polygon is never carried around whole. Shells run
    counter-clockwise and holes clockwise. Each edge has the extent of its piece, by which pieces
    beside the buffer are left out before any area is computed.
    """
    shaped = polygons if "rings_3857" in polygons.columns else project_rings_3857(polygons)
    side = 2.0 * radius
    reach = radius * (1 + 2**-10)  # lines that a ring is cut along never touch a buffer
    first_class = ("poly_id", "lcz_primary")
    rings = shaped.select(*first_class, F.posexplode("rings_3857").alias("_nr", "ring")).filter(
        F.size("ring") >= 3
    )
    against = (ring_area2(F.col("ring")) > 0) != (F.col("_nr") == 0)
    turned = rings.select(
        *first_class, F.when(against, F.reverse("ring")).otherwise(F.col("ring")).alias("ring")
    )
    pieces = _cell_pieces(turned, first_class, side, radius, reach)
    ends = F.zip_with(
        "ring", rotated(F.col("ring")), lambda p, q: F.struct(p.alias("p"), q.alias("q"))
    )
    extent = ("x_lo", "x_hi", "y_lo", "y_hi")
    bounds = [c.alias(n) for c, n in zip(_range("x") + _range("y"), extent, strict=True)]
    return (
        pieces.select(*first_class, *_CELL, F.struct(*bounds).alias("b"), "ring")
        .select(*first_class, *_CELL, "b", F.explode(ends).alias("e"))
        .select(
            *first_class,
            *_CELL,
            *[F.col("b")[n].alias(n) for n in extent],
            F.col("e.p.x").alias("x1"),
            F.col("e.p.y").alias("y1"),
            F.col("e.q.x").alias("x2"),
            F.col("e.q.y").alias("y2"),
        )
        .filter((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))
    )


def _edge_areas(points: DataFrame, edges: DataFrame, radius: float, quad_segs) -> DataFrame:
    """One row per point and edge under it.

    For a broadcast join the points are spread by id while they are still one row each: the join
    keeps that, so sums per point need no further shuffle and points of one place are not together
    in one task. A shuffled join spreads by cell and salt, which serves the sums as well. Either way the
    number of tasks follows the number of points and is not left to AQE, as a point is a few bytes
    but much work, and its sums stay in memory until its task ends.
    """
    side = 2.0 * radius
    celled = points.withColumns(
        {
            "cell_x": F.floor(F.col("x3857") / side).cast("bigint"),
            "cell_y": F.floor(F.col("y3857") / side).cast("bigint"),
        }
    )
    rows = edges.count()
    tasks = tasks_for(celled, celled.count(), TASK_POINTS)
    if is_small(edges, rows):
        celled = celled.repartition(tasks, "id")
    joined = join_on_cell(celled, edges, _CELL, "id", rows, tasks).filter(
        (F.col("x3857") + radius >= F.col("x_lo"))
        & (F.col("x3857") - radius <= F.col("x_hi"))
        & (F.col("y3857") + radius >= F.col("y_lo"))
        & (F.col("y3857") - radius <= F.col("y_hi"))
    )
    relative = joined.withColumns(
        {
            "px": F.col("x1") - F.col("x3857"),
            "py": F.col("y1") - F.col("y3857"),
            "qx": F.col("x2") - F.col("x3857"),
            "qy": F.col("y2") - F.col("y3857"),
        }
    ).drop("x1", "y1", "x2", "y2", "x_lo", "x_hi", "y_lo", "y_hi")
    return with_edge_area(relative, radius, quad_segs).drop("px", "py", "qx", "qy")


def _partition_columns(areas: DataFrame) -> tuple[str, ...]:
    """Functions of the point that a shuffled join is partitioned by, to be added to its keys."""
    return (*_CELL, "_salt") if "_salt" in areas.columns else ()


def overlap_fraction(
    points: DataFrame,
    polygons: DataFrame,
    radius: float = RADIUS,
    quad_segs: int | None = QUAD_SEGS,
    touch: float | None = TOUCH,
) -> DataFrame:
    """(id, poly_id, lcz_primary, lcz_fraction) for each polygon that covers a part of the buffer
    of a point. A share up to `touch` counts as touching the buffer only and is left out; 0 keeps
    every polygon with any area in it, and None every one that has a point in common with the closed
    buffer, with a share of 0 if it only touches.
    """
    narrow = _projected(points).select("id", "x3857", "y3857")
    areas = _areas(narrow, polygons, radius, quad_segs)
    shares = _polygon_shares(areas, (*_partition_columns(areas), "id"), radius, quad_segs, touch)
    return shares.select("id", "poly_id", "lcz_primary", "lcz_fraction")


def _areas(located: DataFrame, polygons: DataFrame, radius: float, quad_segs) -> DataFrame:
    return _edge_areas(located, checkpointed(_clipped_edges(polygons, radius)), radius, quad_segs)


def _polygon_shares(areas: DataFrame, keys, radius: float, quad_segs, touch: float | None) -> DataFrame:
    """Shares by polygon. Whether a polygon meets the buffer is told without its area: one of its edges
    does, or its edges wind around the centre. Holes wind backwards, so the middle of a hole is outside.
    """
    grouped = areas.groupBy(*keys, "poly_id", "lcz_primary")
    share = F.sum("area") / buffer_area(radius, quad_segs)
    if touch is not None:
        return grouped.agg(share.alias("lcz_fraction")).filter(F.col("lcz_fraction") > touch)
    around = F.abs(F.sum("turn")) > math.pi  # 2 pi for each time around
    return (
        grouped.agg(
            F.greatest(share, F.lit(0.0)).alias("lcz_fraction"), (F.max("met") | around).alias("_meets")
        )
        .filter("_meets")
        .drop("_meets")
    )


def intersecting_polygons(
    points: DataFrame,
    polygons: DataFrame,
    radius: float = RADIUS,
    quad_segs: int | None = QUAD_SEGS,
    touch: float | None = TOUCH,
) -> DataFrame:
    """Pairs of a point and a polygon under its buffer; with touch=None also those that only touch."""
    return overlap_fraction(points, polygons, radius, quad_segs, touch).drop("lcz_fraction")


def fraction_by_class(overlaps: DataFrame, keys=("id",)) -> DataFrame:
    """Shares summed by class; polygons without a class are a class of their own."""
    return overlaps.groupBy(*keys, "lcz_primary").agg(F.sum("lcz_fraction").alias("lcz_fraction_sum"))


def rank_classes(fractions: DataFrame, keys=("id",)) -> DataFrame:
    """Add rn, 1 for the largest share of the point. Shares equal to RANK_DIGITS decimals are a tie,
    which the lower class code wins; the NULL class comes last.
    """
    share = F.round("lcz_fraction_sum", RANK_DIGITS)
    order = Window.partitionBy(*keys).orderBy(share.desc(), F.col("lcz_primary").asc_nulls_last())
    return fractions.withColumn("rn", F.row_number().over(order))


def pivot_classes(ranked: DataFrame, keys=("id",)) -> DataFrame:
    """One row per point: first and second class, the share of each class and group."""
    share = F.col("lcz_fraction_sum")
    code = F.col("lcz_primary")

    def of(codes):
        return F.coalesce(F.sum(F.when(code.isin(*codes), share)), F.lit(0.0))

    return ranked.groupBy(*keys).agg(
        F.max(F.when(F.col("rn") == 1, code)).alias("lcz_primary_max"),
        F.max(F.when(F.col("rn") == 2, code)).alias("lcz_primary_max_2"),
        *[of((c,)).alias(f"lcz_{c}") for c in LCZ_CLASSES],
        *[of(codes).alias(name) for name, codes in LCZ_GROUPS.items()],
    )


def lcz_fractions(
    points: DataFrame,
    polygons: DataFrame,
    columns,
    radius: float = RADIUS,
    quad_segs: int | None = QUAD_SEGS,
    touch: float | None = TOUCH,
) -> DataFrame:
    """Land cover around each point, with the named columns of the point kept.

    points have id and lon, lat (or x3857, y3857); polygons have poly_id, lcz_primary and rings in
    degrees (or rings_3857), shell first. The buffer is drawn in EPSG:3857 with quad_segs segments
    per quarter; None takes the true disc. A polygon whose share is at most `touch` only touches the
    buffer and is left out; with touch=None it stays, with a share of 0, and can be the second class or
    a point's only one. Points with no polygon in the buffer are left out. Classes other than
    the 17, and polygons without a class, count for the first and second class only.

    Shares per polygon, sums per class, ranks and the pivot all group by the point and what its join
    was partitioned by, so points are shuffled once.
    """
    if points is None or polygons is None or not columns:
        raise ValueError("points, polygons and at least one column are required")
    place = [c for c in ("lon", "lat", "x3857", "y3857") if c in points.columns]
    kept = ["id", *place, *[c for c in columns if c not in ("id", *place)]]
    areas = _areas(_projected(points.select(*kept)), polygons, radius, quad_segs)
    keys = (*_partition_columns(areas), *kept)
    shares = _polygon_shares(areas, keys, radius, quad_segs, touch)
    wide = pivot_classes(rank_classes(fraction_by_class(shares, keys), keys), keys)
    return wide.drop(*_partition_columns(areas))
