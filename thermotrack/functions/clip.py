"""Cutting polygon rings with axis-parallel lines, as array expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def rotated(ring: Column) -> Column:
    """The ring started at its second point, to pair each point with the next one."""
    others = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.concat(F.slice(ring, 2, others), F.slice(ring, 1, 1))


def ring_area2(ring: Column) -> Column:
    """Twice the signed area; positive for counter-clockwise rings."""
    first = ring[0]

    def term(p, q):
        return (p["x"] - first["x"]) * (q["y"] - first["y"]) - (q["x"] - first["x"]) * (
            p["y"] - first["y"]
        )

    return F.aggregate(F.zip_with(ring, rotated(ring), term), F.lit(0.0), lambda s, v: s + v)


def clip_ring(ring: Column, axis: str, bound: Column, keep_above: bool) -> Column:
    """Part of the ring on one side of the line axis = bound. A concave ring may come back with
    doubled edges along the line, which cancel in any signed sum over edges.
    """
    other = "y" if axis == "x" else "x"
    sign = 1 if keep_above else -1

    def piece(p, q):
        here, there = sign * (p[axis] - bound), sign * (q[axis] - bound)
        share = here / (here - there)
        met = {axis: bound, other: p[other] + (q[other] - p[other]) * share}
        crossing = F.struct(met["x"].alias("x"), met["y"].alias("y"))
        return (
            F.when((here >= 0) & (there >= 0), F.array(p))
            .when(here >= 0, F.array(p, crossing))
            .when(there >= 0, F.array(crossing))
            .otherwise(F.slice(F.array(p), 1, 0))
        )

    return F.flatten(F.zip_with(ring, rotated(ring), piece))
