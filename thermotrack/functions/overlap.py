"""Area of a buffer around the origin that lies left of polygon edges, edge by edge.

The area of (buffer and polygon) is the sum over the edges p -> q of the polygon of the signed area
of (buffer and triangle(0, p, q)). Each edge is a row with px, py, qx, qy relative to the centre.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


ROUNDING = 1e-12


def _cross(ax, ay, bx, by) -> Column:
    return ax * by - ay * bx


def _dot(ax, ay, bx, by) -> Column:
    return ax * bx + ay * by


def _between(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def buffer_area(radius: float, quad_segs: int | None) -> float:
    if quad_segs is None:
        return math.pi * radius * radius
    sides = 4 * quad_segs
    return sides / 2 * radius * radius * math.sin(2 * math.pi / sides)


def with_edge_area(edges: DataFrame, radius: float, quad_segs: int | None) -> DataFrame:
    """Add `area`, `met` (whether the edge meets the closed buffer) and `turn` (the angle that it is
    seen under from the centre). The buffer is the regular polygon with 4 * quad_segs sides that has a
    vertex on the x axis, or the true disc when quad_segs is None. Edges of no length must be left out.

    For a polygon buffer an edge that crosses its border comes as several rows, one per sector; its
    turn is in one of them.
    """
    px, py, qx, qy = (F.col(c) for c in ("px", "py", "qx", "qy"))
    based = edges.withColumns(
        {
            "_dx": qx - px,
            "_dy": qy - py,
            "_cross": _cross(px, py, qx, qy),
            "_pp": _dot(px, py, px, py),
            "_qq": _dot(qx, qy, qx, qy),
        }
    ).withColumns(
        {
            "_dd": F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"),
            "_pd": px * F.col("_dx") + py * F.col("_dy"),
            "_turn": F.atan2(F.col("_cross"), _dot(px, py, qx, qy)),
        }
    )
    extra = ["_dx", "_dy", "_cross", "_pp", "_qq", "_dd", "_pd", "_turn"]
    based = based.withColumn("met", _meets(radius, quad_segs))
    if quad_segs is None:
        return _disc(based, radius).withColumn("turn", F.col("_turn")).drop(*extra)
    return _regular_polygon(based, radius, 4 * quad_segs).drop(*extra)


def _nearest() -> Column:
    """Squared distance of the centre to the edge."""
    t = _between(-F.col("_pd") / F.col("_dd"))
    return F.col("_pp") + t * (2 * F.col("_pd") + t * F.col("_dd"))


def _meets(radius: float, quad_segs: int | None) -> Column:
    """Whether the edge has a point in the closed buffer, up to rounding. Only an edge between the
    buffer's inner and outer circle is cut by the buffer's sides.
    """
    outer = radius * radius * (1 + ROUNDING)
    if quad_segs is None:
        return _nearest() <= outer
    sides = 4 * quad_segs
    angles = [(k + 0.5) * 2 * math.pi / sides for k in range(sides)]
    reach = radius * math.cos(math.pi / sides)
    normals = F.array(
        *[F.struct(F.lit(math.cos(a)).alias("x"), F.lit(math.sin(a)).alias("y")) for a in angles]
    )

    def cut(span, n):
        room = reach * (1 + ROUNDING) - _dot(n["x"], n["y"], F.col("px"), F.col("py"))
        rise = _dot(n["x"], n["y"], F.col("_dx"), F.col("_dy"))
        at = F.try_divide(room, rise)
        low = F.when(rise < 0, F.greatest(span["low"], at)).otherwise(span["low"])
        high = F.when(rise > 0, F.least(span["high"], at)).otherwise(span["high"])
        # beside a side that the edge runs along there is nothing left
        beside = (rise == 0) & (room < 0)
        return F.struct(F.when(beside, 2.0).otherwise(low).alias("low"), high.alias("high"))

    whole = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    left = F.aggregate(normals, whole, cut, lambda span: span["low"] <= span["high"])
    return F.when(_nearest() <= reach * reach, True).when(_nearest() > outer, False).otherwise(left)


def _disc(edges: DataFrame, radius: float) -> DataFrame:
    px, py, qx, qy = (F.col(c) for c in ("px", "py", "qx", "qy"))
    r2 = radius * radius
    root = F.col("_pd") * F.col("_pd") - F.col("_dd") * (F.col("_pp") - r2)
    cut = edges.withColumn("_root", F.sqrt(F.greatest(root, F.lit(0.0)))).withColumns(
        {
            "_s": _between((-F.col("_pd") - F.col("_root")) / F.col("_dd")),
            "_t": _between((-F.col("_pd") + F.col("_root")) / F.col("_dd")),
        }
    )
    ux, uy = px + F.col("_s") * F.col("_dx"), py + F.col("_s") * F.col("_dy")
    vx, vy = px + F.col("_t") * F.col("_dx"), py + F.col("_t") * F.col("_dy")
    outer = F.atan2(_cross(px, py, ux, uy), _dot(px, py, ux, uy)) + F.atan2(
        _cross(vx, vy, qx, qy), _dot(vx, vy, qx, qy)
    )
    inner = (F.col("_t") - F.col("_s")) * F.col("_cross")
    area = F.when(F.col("_t") > F.col("_s"), (r2 * outer + inner) / 2).otherwise(
        r2 / 2 * F.col("_turn")
    )
    return cut.withColumn("area", area).drop("_root", "_s", "_t")


def _regular_polygon(edges: DataFrame, radius: float, sides: int) -> DataFrame:
    step = 2 * math.pi / sides
    reach = radius * math.cos(step / 2)
    start = F.atan2(F.col("py"), F.col("px"))
    near = _nearest()
    inside = (F.col("_pp") <= reach * reach) & (F.col("_qq") <= reach * reach)
    outside = near >= radius * radius

    def swept(angle: Column) -> Column:
        """Area of the buffer between the x axis and a ray."""
        whole = F.floor(angle / step)
        rest = angle - whole * step
        full = radius * radius * math.sin(step) / 2
        part = radius * reach / 2 * F.sin(rest) / F.cos(rest - step / 2)
        return whole * full + part

    low = F.floor(F.least(F.col("_start"), F.col("_end")) / step).cast("int")
    high = F.floor(F.greatest(F.col("_start"), F.col("_end")) / step).cast("int")
    sectors = (
        edges.withColumn("_start", start)
        .withColumn("_end", F.col("_start") + F.col("_turn"))
        .withColumn("_kind", F.when(inside, 0).when(outside, 1).otherwise(2))
        .withColumns({"_low": low, "_high": high})
        .withColumn(
            "_sector",
            F.explode(
                F.when(F.col("_kind") == 2, F.sequence("_low", "_high")).otherwise(
                    F.array(F.lit(0))
                )
            ),
        )
    )

    def ray(k: Column) -> Column:
        """Where on the edge (0 at p, 1 at q) the ray between sectors k-1 and k is met."""
        ex, ey = F.cos(k * step), F.sin(k * step)
        return _between(
            F.coalesce(
                F.try_divide(
                    -_cross(ex, ey, F.col("px"), F.col("py")),
                    _cross(ex, ey, F.col("_dx"), F.col("_dy")),
                ),
                F.lit(0.5),
            )
        )

    k = F.col("_sector")
    rising = F.col("_turn") >= 0
    at_low = F.when(k == F.col("_low"), F.when(rising, 0.0).otherwise(1.0)).otherwise(ray(k))
    at_high = F.when(k == F.col("_high"), F.when(rising, 1.0).otherwise(0.0)).otherwise(ray(k + 1))
    nx, ny = F.cos((k + 0.5) * step), F.sin((k + 0.5) * step)
    along = _dot(nx, ny, F.col("px"), F.col("py")), _dot(nx, ny, F.col("_dx"), F.col("_dy"))
    parts = (
        sectors.withColumns({"_at_low": at_low, "_at_high": at_high})
        .withColumns(
            {
                "_s": F.when(rising, F.col("_at_low")).otherwise(F.col("_at_high")),
                "_t": F.when(rising, F.col("_at_high")).otherwise(F.col("_at_low")),
                "_np": along[0],
                "_nd": along[1],
            }
        )
        .withColumns(
            {
                "_gu": F.col("_np") + F.col("_s") * F.col("_nd"),
                "_gv": F.col("_np") + F.col("_t") * F.col("_nd"),
            }
        )
    )
    gu, gv = F.col("_gu"), F.col("_gv")
    crossing = F.try_divide(reach - gu, gv - gu)
    factor = (
        F.when((gu <= reach) & (gv <= reach), 1.0)
        .when((gu > reach) & (gv > reach), F.try_divide(F.lit(reach * reach), gu * gv))
        .when(gu <= reach, crossing + (1 - crossing) * F.try_divide(F.lit(reach), gv))
        .otherwise(crossing * F.try_divide(F.lit(reach), gu) + (1 - crossing))
    )
    area = (
        F.when(F.col("_kind") == 0, F.col("_cross") / 2)
        .when(F.col("_kind") == 1, swept(F.col("_end")) - swept(F.col("_start")))
        .otherwise(F.col("_cross") / 2 * (F.col("_t") - F.col("_s")) * factor)
    )
    used = ["_start", "_end", "_kind", "_low", "_high", "_sector", "_at_low", "_at_high"]
    own = F.when((F.col("_kind") != 2) | (F.col("_sector") == F.col("_low")), F.col("_turn"))
    return parts.withColumns({"area": area, "turn": own}).drop(*used, "_s", "_t", "_np", "_nd", "_gu", "_gv")
