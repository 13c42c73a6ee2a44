"""Delaunay triangulation of stations, distributed over tiles.

A tile triangulates its own stations together with a halo of others (local_delaunay). What it finds
around its own stations is right if no station at all lies inside the circles of these triangles, nor
beyond the edges on its hull. Circles and edges that reach out of what the tile knows are looked up
among the other tiles by equi-joins; a station found inside joins the tile's halo and the tile
is done again, until nothing is found. No tile ever holds more than its own stations and those that
turned up beside them, and there is no tile over all.
"""

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thermotrack.functions.delaunay import in_circle, local_delaunay, orientation
from thermotrack.plans.checkpoints import checkpointed, checkpointed_count
from thermotrack.plans.sided_join import is_small, shuffled
from thermotrack.plans.slices import slice_offsets

TILE_POINTS = 2000  # at most; few stations are dealt to smaller tiles
LEAST_POINTS = 12
LOOKUP_POINTS = 256  # at most, in a cell in which stations are looked up, however large the tiles are
DEEPEST_LEVEL = 24
LEVEL_STEP = 1
TILE = ("leaf", "tx", "ty")

THIN = 1e-5  # twice the area over squared sides, below which a circle is worked out exactly
DOUBT = 1e-8  # of the radius: stations so near to a circle are tested exactly

_ELEMENT = (
    "leaf int, tx bigint, ty bigint, n bigint, edge boolean, sa bigint, ax double, ay double, sb bigint, bx double, "
    "by double, sc bigint, cxx double, cyy double, own boolean, sure boolean, ox double, oy double, r double"
)


def delaunay_triangles(
    stations: DataFrame,
    key: str = "numer_insee",
    x: str = "lon",
    y: str = "lat",
    tile_points: int | None = None,
) -> DataFrame:
    """Delaunay triangles over all stations: `id_triangle` (1..n in the order of the station ids)
    and the vertices `a`, `b`, `c` as structs (station, x, y) with rising station id.

    Stations at one place count once, under the lowest id; cocircular stations are split by a fixed
    rule on ids. tile_points bounds the own stations of a tile; by default they are dealt evenly to
    twice as many tiles as there are shuffle partitions, of LEAST_POINTS to TILE_POINTS stations. The
    result is a checkpointed table, as later steps read it several times.
    """
    spark = stations.sparkSession
    points = (
        stations.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        .agg(F.min(F.col(key).cast("bigint")).alias("id"))
    )
    extent = points.agg(
        F.count("*").alias("n"),
        F.min("x").alias("x0"),
        F.max("x").alias("x1"),
        F.min("y").alias("y0"),
        F.max("y").alias("y1"),
    ).first()
    if tile_points is None:
        tiles = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
        tile_points = min(TILE_POINTS, max(LEAST_POINTS, -(-extent["n"] // tiles)))
    vertices = [
        F.struct(F.col(s).alias("station"), F.col(px).alias("x"), F.col(py).alias("y")).alias(name)
        for name, s, px, py in (
            ("a", "sa", "ax", "ay"),
            ("b", "sb", "bx", "by"),
            ("c", "sc", "cxx", "cyy"),
        )
    ]
    if not extent["n"]:
        tile_points, extent = 1, {"n": 0, "x0": 0.0, "x1": 0.0, "y0": 0.0, "y1": 0.0}
    found = TileRounds(points, extent, tile_points).triangles()
    return checkpointed(_numbered(found.select(*vertices)))


def _side(extent) -> float:
    return max(extent["x1"] - extent["x0"], extent["y1"] - extent["y0"]) or 1.0


def leaf_tiles(points: DataFrame, extent, tile_points: int) -> DataFrame:
    """Points with their cell and `leaf`, the coarsest level at which their tile holds at most
    tile_points points.
    """
    cells = 1 << DEEPEST_LEVEL
    side = _side(extent)

    def cell(column, low):
        number = F.floor((F.col(column) - F.lit(low)) / F.lit(side) * cells)
        return F.least(number, F.lit(cells - 1)).cast("bigint")

    celled = points.withColumns({"cx": cell("x", extent["x0"]), "cy": cell("y", extent["y0"])})
    levels = F.array(*[F.lit(level) for level in range(0, DEEPEST_LEVEL + 1, LEVEL_STEP)])
    per_level = celled.withColumn("leaf", F.explode(levels)).withColumns(
        {
            "tx": F.expr(f"shiftright(cx, {DEEPEST_LEVEL} - leaf)"),
            "ty": F.expr(f"shiftright(cy, {DEEPEST_LEVEL} - leaf)"),
        }
    )
    fitting = (
        per_level.groupBy("leaf", "tx", "ty")
        .agg(F.count("*").alias("n"))
        .filter((F.col("n") <= tile_points) | (F.col("leaf") == DEEPEST_LEVEL))
    )
    return (
        per_level.join(shuffled(fitting), ["leaf", "tx", "ty"])
        .groupBy("id", "x", "y", "cx", "cy")
        .agg(F.min("leaf").alias("leaf"))
    )


def _in_tiles(points: DataFrame, extent, tile_points: int) -> DataFrame:
    """Points with the tile of `leaf_tiles` that each one lies in."""
    shift = F.lit(DEEPEST_LEVEL) - F.col("leaf")
    tile = {"tx": F.call_function("shiftright", "cx", shift), "ty": F.call_function("shiftright", "cy", shift)}
    return leaf_tiles(points, extent, tile_points).withColumns(tile).select(*TILE, "cx", "cy", "id", "x", "y")


class TileRounds:
    """The rounds of tiles over points (id, x, y); `members` are the stations of the tiles in each round."""

    def __init__(self, points: DataFrame, extent, tile_points: int):
        self.extent, self.side = extent, _side(extent)
        self.stations = checkpointed(_in_tiles(points, extent, tile_points))
        # the cells that circles and edges are held against: as large as a tile, or smaller
        self.lookup = self.stations
        if tile_points > LOOKUP_POINTS:
            self.lookup = checkpointed(_in_tiles(points, extent, LOOKUP_POINTS))
        self.boxes, self.n_boxes = checkpointed_count(self._lookup_boxes())
        self.grain = 1e-14 * max(abs(extent[c]) for c in ("x0", "x1", "y0", "y1"))  # of the coordinates
        self.members: list[DataFrame] = []

    def _lookup_boxes(self) -> DataFrame:
        """Each leaf of the look-up with the box of its stations and the levels under which it is looked
        up: as a part of every cell above it, and as a leaf.
        """
        boxes = self.lookup.groupBy(*TILE).agg(
            F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
        )
        above = F.transform(
            F.sequence(F.lit(0), F.col("leaf")),
            lambda level: F.struct(
                level.alias("level"),
                F.call_function("shiftright", "tx", F.col("leaf") - level).alias("kx"),
                F.call_function("shiftright", "ty", F.col("leaf") - level).alias("ky"),
                F.lit(False).alias("as_leaf"),
            ),
        )
        leaf = F.array(
            F.struct(F.col("leaf").alias("level"), F.col("tx").alias("kx"), F.col("ty").alias("ky"), F.lit(True).alias("as_leaf"))
        )
        other = [F.col(c).alias(f"o_{c}") for c in TILE]
        return boxes.withColumn("_k", F.explode(F.concat(above, leaf))).select(
            "_k.*", *other, "x0", "x1", "y0", "y1"
        )

    def triangles(self) -> DataFrame:
        """(sa, ax, ay, sb, .., cyy) of every triangle, once: in the tile of its lowest station."""
        members = self.stations.select(*TILE, "id", "x", "y", F.lit(True).alias("core"))
        members = members.unionByName(self._first_halo())
        done = None
        while True:
            members = checkpointed(members)
            self.members.append(members)
            found = self._elements(members)
            offenders, n = checkpointed_count(self._offenders(found.filter("not sure")))
            if not n:
                final = found
            else:
                again = offenders.select(*TILE).distinct()
                final = found.join(shuffled(again), list(TILE), "left_anti")
                members = members.join(shuffled(again), list(TILE), "left_semi").unionByName(
                    offenders.withColumn("core", F.lit(False))
                )
            kept = final.filter("own").select(
                "sa", "ax", "ay", "sb", "bx", "by", "sc", "cxx", "cyy"
            )
            done = kept if done is None else done.unionByName(kept)
            if not n:
                return done

    def _first_halo(self) -> DataFrame:
        """For each tile the stations of the cells around its own that lie nearest to it, some along
        its whole border; no more than that, so that a tile beside a town doesn't take in the town.
        """
        levels = F.array(*[F.lit(r["leaf"]) for r in self.stations.select("leaf").distinct().collect()])  # 25 at most
        shift = F.lit(DEEPEST_LEVEL) - F.col("level")
        others = self.stations.select(
            F.explode(levels).alias("level"), "cx", "cy", "id", "x", "y"
        ).select(
            "level",
            F.call_function("shiftright", "cx", shift).alias("kx"),
            F.call_function("shiftright", "cy", shift).alias("ky"),
            "id",
            "x",
            "y",
        )
        around = F.array(
            *[
                F.struct((F.col("tx") + i).alias("kx"), (F.col("ty") + j).alias("ky"))
                for i in (-1, 0, 1)
                for j in (-1, 0, 1)
                if i or j
            ]
        )
        sizes = self.stations.groupBy(*TILE).agg(
            F.count("*").alias("_n"),
            F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
        )
        tiles = sizes.withColumn("_k", F.explode(around)).select(
            "*", F.col("leaf").alias("level"), "_k.kx", "_k.ky"
        )
        met = others.join(shuffled(tiles), ["level", "kx", "ky"])
        beside_x = F.greatest(F.col("x0") - F.col("x"), F.col("x") - F.col("x1"), F.lit(0.0))
        beside_y = F.greatest(F.col("y0") - F.col("y"), F.col("y") - F.col("y1"), F.lit(0.0))
        nearest = Window.partitionBy(*TILE).orderBy(beside_x * beside_x + beside_y * beside_y, "id")
        wanted = (F.lit(16) + 8 * F.sqrt("_n")).cast("int")
        ranked = met.withColumn("_rank", F.row_number().over(nearest)).filter(F.col("_rank") <= wanted)
        return ranked.select(*TILE, "id", "x", "y", F.lit(False).alias("core"))

    def _elements(self, members: DataFrame) -> DataFrame:
        """Of every tile the triangles that have a station of its own, with their circles (r infinite:
        too wide for floats), and the edges of its hull that have one, with the outside to the right of
        (a, b); own: a triangle whose lowest station is the tile's; sure: its circle lies in the tile.
        A lone station has edges to all four sides. Saved.
        """
        x0, y0, whole, grain = self.extent["x0"], self.extent["y0"], self.side, self.grain

        def one_tile(key: tuple, tile: pd.DataFrame) -> pd.DataFrame:
            leaf, tx, ty = (int(k) for k in key)
            tile = tile.drop_duplicates("id")
            ids, xs, ys = (tile[c].tolist() for c in ("id", "x", "y"))
            core = set(tile["id"][tile["core"]].tolist())
            place = {i: (px, py) for i, px, py in zip(ids, xs, ys, strict=True)}
            side = whole / (1 << leaf)
            low, high = (x0 + tx * side, y0 + ty * side), (x0 + (tx + 1) * side, y0 + (ty + 1) * side)
            triangles, hull = local_delaunay(ids, xs, ys, with_edges=True)
            rows = []
            for corners in triangles:
                if core.isdisjoint(corners):
                    continue
                ox, oy, r = circle(*[place[i] for i in corners])
                reach = r * (1 + DOUBT) + grain
                sure = (
                    ox - reach > low[0] and oy - reach > low[1] and ox + reach < high[0] and oy + reach < high[1]
                )
                a, b, c = sorted(corners)
                rows.append((False, a, *place[a], b, *place[b], c, *place[c], a in core, sure, ox, oy, r))
            ends = [(a, place[a], b, place[b]) for a, b in hull if a in core or b in core]
            if len(ids) == 1:
                (px, py), i = place[ids[0]], ids[0]
                ends = [(i, (px, py), i, (px + u * whole, py + v * whole)) for u, v in ((1, 0), (-1, 0), (0, 1), (0, -1))]
            for a, at_a, b, at_b in ends:
                rows.append((True, a, *at_a, b, *at_b, a, *at_a, False, False, 0.0, 0.0, 0.0))
            names = [part.split()[0] for part in _ELEMENT.split(", ")]
            out = pd.DataFrame(rows, columns=names[4:])
            for n, (name, value) in enumerate(zip(names[:4], (leaf, tx, ty, 0), strict=True)):
                out.insert(n, name, value)
            out["n"] = np.arange(len(out))
            return out

        # a tile is few bytes and much work, so the number of tasks is not left to AQE
        tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return checkpointed(members.repartition(tasks, *TILE).groupBy(*TILE).applyInPandas(one_tile, _ELEMENT))

    def _offenders(self, doubtful: DataFrame) -> DataFrame:
        """Of the stations in each circle and beyond each edge the deepest one and those nearest to the
        middles of the sides: (leaf, tx, ty, id, x, y), distinct.

        An element is cut to the few cells of the level that fits its size. It meets the look-up's leaves in
        these cells, and leaves as large as the cells above; of them those whose box it touches, and their
        stations. A leaf is small even if tiles are large: an element never meets a whole tile's stations.
        """
        side, cells = F.lit(self.side), 1 << DEEPEST_LEVEL
        low_x, low_y = F.lit(self.extent["x0"]), F.lit(self.extent["y0"])
        # an edge reaches over the whole square, as a very wide circle may
        room = F.col("r") * DOUBT + self.grain
        reach = F.when(F.col("edge") | (F.col("r") > side), side * 4).otherwise(F.col("r") + room)
        middle = [F.when(reach > side, low + side / 2).otherwise(F.col(o)) for o, low in (("ox", low_x), ("oy", low_y))]
        level = F.least(F.lit(DEEPEST_LEVEL), F.greatest(F.lit(0), F.floor(F.log2(side / reach)).cast("int")))

        def cell(value, low):
            number = F.floor((value - low) / side * cells)
            return F.greatest(F.lit(0), F.least(number, F.lit(cells - 1))).cast("bigint")

        ends = {
            name: cell(middle[i] + sign * reach, low)
            for name, i, sign, low in (
                ("_x0", 0, -1, low_x), ("_x1", 0, 1, low_x), ("_y0", 1, -1, low_y), ("_y1", 1, 1, low_y)
            )
        }
        placed = doubtful.withColumn("_level", level).withColumns(ends)

        def keys(at, as_leaf):
            down = F.lit(DEEPEST_LEVEL) - at
            spans = [
                F.sequence(F.call_function("shiftright", f"_{axis}0", down), F.call_function("shiftright", f"_{axis}1", down))
                for axis in "xy"
            ]
            return F.flatten(F.transform(spans[0], lambda kx: F.transform(spans[1], lambda ky: F.struct(
                at.alias("level"), kx.alias("kx"), ky.alias("ky"), F.lit(as_leaf).alias("as_leaf")))))

        coarser = F.when(F.col("_level") > 0, F.sequence(F.lit(0), F.col("_level") - 1)).otherwise(
            F.array().cast("array<int>")
        )
        looked_up = F.concat(keys(F.col("_level"), False), F.flatten(F.transform(coarser, lambda at: keys(at, True))))
        cut = placed.withColumn("_k", F.explode(looked_up)).select(*doubtful.columns, "_k.*")
        boxes = F.broadcast(self.boxes) if is_small(self.boxes, 8 * self.n_boxes) else shuffled(self.boxes)
        met = cut.join(boxes, ["level", "kx", "ky", "as_leaf"])
        away_x = F.greatest(F.col("x0") - F.col("ox"), F.col("ox") - F.col("x1"), F.lit(0.0))
        away_y = F.greatest(F.col("y0") - F.col("oy"), F.col("oy") - F.col("y1"), F.lit(0.0))
        dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
        # the corner of the box that lies farthest to the right of the edge
        far_x = F.when(dy > 0, F.col("x1")).otherwise(F.col("x0")) - F.col("ax")
        far_y = F.when(dx > 0, F.col("y0")).otherwise(F.col("y1")) - F.col("ay")
        slack = 1e-12 * (F.abs(dx) + F.abs(dy)) * side
        met = met.filter(
            F.when(F.col("edge"), dx * far_y - dy * far_x <= slack).otherwise(
                F.hypot(away_x, away_y) <= F.col("r") + room
            )
        )
        met = met.select(*doubtful.columns, *[f"o_{c}" for c in TILE]).distinct()
        stations = self.lookup.select(*[F.col(c).alias(f"o_{c}") for c in TILE], "id", "x", "y")
        pairs = met.join(shuffled(stations), [f"o_{c}" for c in TILE])
        # how deep a station lies inside, and within what the floats can be wrong
        turn = dx * (F.col("y") - F.col("ay")) - dy * (F.col("x") - F.col("ax"))
        away = F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"))
        endless = F.col("r") == float("inf")
        depth = F.when(F.col("edge"), -turn).when(endless, 0.0).otherwise(F.col("r") - away)
        margin = F.when(F.col("edge"), slack).when(endless, 1.0).otherwise(room)
        pairs = pairs.filter(~F.col("id").isin(F.col("sa"), F.col("sb"), F.col("sc"))).withColumns(
            {"depth": depth, "margin": margin}
        ).filter("depth >= -margin")
        columns = [*doubtful.columns, "id", "x", "y", "depth", "margin"]
        pairs = pairs.select(*columns)
        kind = ", ".join(f"{c} {t}" for c, t in pairs.dtypes)
        inside = pairs.mapInPandas(_exactly_inside, kind)
        station = F.struct("id", "x", "y")
        beside = [
            F.hypot(F.col("x") - (F.col(ux) + F.col(vx)) / 2, F.col("y") - (F.col(uy) + F.col(vy)) / 2)
            for ux, uy, vx, vy in (("ax", "ay", "bx", "by"), ("bx", "by", "cxx", "cyy"), ("ax", "ay", "cxx", "cyy"))
        ]
        best = inside.groupBy(*TILE, "n").agg(
            F.array(
                F.max_by(station, F.struct("depth", "id")),
                *[F.min_by(station, F.struct(b, F.col("id"))) for b in beside],
            ).alias("_o")
        )
        return best.select(*TILE, F.explode("_o").alias("_o")).select(*TILE, "_o.*").distinct()


def circle(a, b, c) -> tuple[float, float, float]:
    """Centre and radius of the circle through three places; the radius is infinite where floats can't
    hold the circle of a thin triangle.
    """
    ux, uy, vx, vy = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
    double_area = 2 * (ux * vy - uy * vx)
    u2, v2 = ux * ux + uy * uy, vx * vx + vy * vy
    if abs(double_area) < THIN * (u2 + v2):
        (ax, ay), (bx, by), (cx, cy) = [[Fraction(w) for w in p] for p in (a, b, c)]
        ux, uy, vx, vy = bx - ax, by - ay, cx - ax, cy - ay
        double_area = 2 * (ux * vy - uy * vx)
        u2, v2 = ux * ux + uy * uy, vx * vx + vy * vy
    ox, oy = float((vy * u2 - uy * v2) / double_area), float((ux * v2 - vx * u2) / double_area)
    r = float(np.hypot(ox, oy))
    if r > 1e6 * float(u2 + v2) ** 0.5:
        return 0.0, 0.0, float("inf")
    return ox + a[0], oy + a[1], r


def _exactly_inside(frames):
    """The pairs whose station lies inside the circle, or beyond the edge or on it. Floats have decided
    where they are certain; elsewhere exact numbers do, and the rule on ids.
    """
    for frame in frames:
        keep = (frame["depth"] > frame["margin"]).to_numpy()
        doubtful = np.flatnonzero(~keep)
        for at, t in zip(doubtful, frame.iloc[doubtful].itertuples(index=False), strict=True):
            a, b, p = (t.ax, t.ay), (t.bx, t.by), (t.x, t.y)
            if t.edge:
                turn = orientation(a, b, p)
                keep[at] = turn < 0 or (turn == 0 and min(a, b) < p < max(a, b))
            else:
                places = {t.sa: a, t.sb: b, t.sc: (t.cxx, t.cyy), t.id: p}
                ahead = orientation(a, b, places[t.sc]) > 0
                keep[at] = in_circle(places, *((t.sa, t.sb) if ahead else (t.sb, t.sa)), t.sc, t.id)
        yield frame[keep]


def _numbered(triangles: DataFrame) -> DataFrame:
    """Add id_triangle = 1..n in the order of the station ids, by ranges of even count that Spark
    samples; the saved table keeps each row's range.
    """
    ids = ("a.station", "b.station", "c.station")
    tasks = int(triangles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = triangles.repartitionByRange(tasks, *ids)
    blocked = checkpointed(ranged.withColumn("_block", F.spark_partition_id()))
    sizes = blocked.groupBy("_block").agg(F.count("*").alias("_n"))
    offsets = slice_offsets(sizes, (), "_block", "_n").drop("_n")
    order = Window.partitionBy("_block").orderBy("a.station", "b.station", "c.station")
    number = F.row_number().over(order) + F.col("_offset")
    return (
        blocked.join(F.broadcast(offsets), "_block")  # a row per task
        .select(number.cast("bigint").alias("id_triangle"), "a", "b", "c")
    )


def triangle_vertices(triangles: DataFrame, closed: bool = False) -> DataFrame:
    """One row per vertex, `id_pt` from 1. With `closed` the first vertex comes again as number 4,
    as in a polygon ring.
    """
    corners = ["a", "b", "c", "a"] if closed else ["a", "b", "c"]
    return triangles.select("id_triangle", F.posexplode(F.array(*corners)).alias("_pos", "_v")).select(
        "id_triangle",
        (F.col("_pos") + 1).alias("id_pt"),
        F.col("_v.station").alias("numer_insee"),
        F.col("_v.x").alias("lon"),
        F.col("_v.y").alias("lat"),
    )


def attach_station_id(vertices: DataFrame, stations: DataFrame) -> DataFrame:
    """Station id of vertices that came without one, by equality of the point."""
    known = stations.groupBy("lon", "lat").agg(F.min("numer_insee").alias("numer_insee"))
    return vertices.drop("numer_insee").join(known, ["lon", "lat"], "left")
