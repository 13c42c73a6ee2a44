"""Delaunay triangulation of the few points of one tile, for use inside a grouped pandas task.

Points are inserted one by one; triangles whose circle holds the new point are removed and the
hole is fanned to it. The outside of the hull is covered by triangles with the vertex None.
Signs are taken from floats where they are certain and from exact integers otherwise, so that
collinear and cocircular points need no tolerance.
"""

import math
from fractions import Fraction


def _cross(o, p, q):
    return (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])


def orientation(p, q, r) -> int:
    left = (q[0] - p[0]) * (r[1] - p[1])
    right = (q[1] - p[1]) * (r[0] - p[0])
    value = left - right
    if abs(value) <= 1e-15 * (abs(left) + abs(right)):
        value = _cross(*[(Fraction(v[0]), Fraction(v[1])) for v in (p, q, r)])
    return (value > 0) - (value < 0)


def _lifted(a, b, c, d):
    rows = [(v[0] - d[0], v[1] - d[1]) for v in (a, b, c)]
    lifts = [u * u + w * w for u, w in rows]
    minors = [
        rows[(i + 1) % 3][0] * rows[(i + 2) % 3][1] - rows[(i + 1) % 3][1] * rows[(i + 2) % 3][0]
        for i in range(3)
    ]
    size = sum(
        lifts[i]
        * (
            abs(rows[(i + 1) % 3][0] * rows[(i + 2) % 3][1])
            + abs(rows[(i + 1) % 3][1] * rows[(i + 2) % 3][0])
        )
        for i in range(3)
    )
    return sum(lift * minor for lift, minor in zip(lifts, minors, strict=True)), size


def in_circle(points, a, b, c, d) -> bool:
    """Is d inside the circle of the counter-clockwise triangle abc?

    Cocircular points are decided as if the point with the lowest id were lifted a little: the
    answer depends on ids only, not on the tile or the order of insertion.
    """
    value, size = _lifted(points[a], points[b], points[c], points[d])
    if abs(value) <= 4e-15 * size:
        exact = [(Fraction(points[i][0]), Fraction(points[i][1])) for i in (a, b, c, d)]
        value, _ = _lifted(*exact)
    if value:
        return value > 0
    lowest = min(a, b, c, d)
    if lowest == d:
        return False
    return orientation(*[points[d if i == lowest else i] for i in (a, b, c)]) > 0


class _Mesh:
    """Triangles as a map from each directed edge to the vertex on its left."""

    def __init__(self, points):
        self.points = points
        self.apex = {}

    def add(self, a, b, c):
        self.apex[a, b], self.apex[b, c], self.apex[c, a] = c, a, b

    def conflicts(self, a, b, c, p) -> bool:
        if None not in (a, b, c):
            return in_circle(self.points, a, b, c, p)
        while c is not None:
            a, b, c = b, c, a
        u, v, q = self.points[a], self.points[b], self.points[p]
        side = orientation(u, v, q)
        if side:
            return side > 0
        return min(u, v) < q < max(u, v)  # on the hull edge itself

    def locate(self, p, start):
        """A triangle that conflicts with p, walking from the directed edge `start`."""
        a, b = start
        for _ in range(4 * len(self.apex)):
            c = self.apex[a, b]
            if c is None:
                return a, b
            target = self.points[p]
            if orientation(self.points[b], self.points[c], target) < 0:
                a, b = c, b
            elif orientation(self.points[c], self.points[a], target) < 0:
                a, b = a, c
            else:
                return a, b
        return next(e for e, c in self.apex.items() if self.conflicts(*e, c, p))

    def insert(self, p, start):
        a, b = self.locate(p, start)
        c = self.apex[a, b]
        removed, border, stack = set(), [], [(a, b, c)]
        if not self.conflicts(a, b, c, p):
            stack = [next((*e, w) for e, w in self.apex.items() if self.conflicts(*e, w, p))]
        while stack:
            a, b, c = stack.pop()
            if (a, b) in removed:
                continue
            removed.update(((a, b), (b, c), (c, a)))
            for u, v in ((a, b), (b, c), (c, a)):
                w = self.apex[v, u]
                if (v, u) in removed:
                    continue
                if self.conflicts(v, u, w, p):
                    stack.append((v, u, w))
                else:
                    border.append((u, v))
        for edge in removed:
            del self.apex[edge]
        for u, v in border:
            self.add(u, v, p)
        return next((u, v) for u, v in border if u is not None and v is not None)


def local_delaunay(ids, xs, ys, with_edges: bool = False):
    """(triangles as id triples, ids on the hull, or with_edges its edges (a, b) with the outside to the
    right); no triangles when all points are collinear, and then the edges run both ways along the line.
    """
    points = dict(zip(ids, zip(xs, ys, strict=True), strict=True))
    order = _curve_order(points)
    third = next((k for k in range(2, len(order)) if _turn(points, order, k)), None)
    if third is None:
        line = sorted(points, key=points.get)
        pairs = list(zip(line, line[1:], strict=False))
        return [], pairs + [(b, a) for a, b in pairs] if with_edges else list(ids)
    a, b, c = order[0], order[1], order[third]
    if _turn(points, order, third) < 0:
        a, b = b, a
    mesh = _Mesh(points)
    mesh.add(a, b, c)
    for u, v in ((a, b), (b, c), (c, a)):
        mesh.add(v, u, None)
    last = (a, b)
    for k, p in enumerate(order[2:], start=2):
        if k != third:
            last = mesh.insert(p, last)
    triangles = [
        (u, v, w) for (u, v), w in mesh.apex.items() if None not in (u, v, w) and u < v and u < w
    ]
    edges = [(v, u) for (u, v), w in mesh.apex.items() if w is None and None not in (u, v)]
    return triangles, edges if with_edges else list({u for e in edges for u in e})


def _turn(points, order, k) -> int:
    return orientation(points[order[0]], points[order[1]], points[order[k]])


def _curve_order(points):
    """Ids along a snake of rows of as many points each, so that the next point lies near the last one,
    also where a few points lie far from all others.
    """
    upwards = sorted(points, key=lambda i: (points[i][1], points[i][0], i))
    width = max(1, math.ceil((2 * len(points)) ** 0.5))
    order = []
    for row, begin in enumerate(range(0, len(upwards), width)):
        order += sorted(upwards[begin : begin + width], key=lambda i: (points[i][0], i), reverse=row % 2 == 1)
    return order
