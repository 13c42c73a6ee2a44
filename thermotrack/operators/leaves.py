"""Triangles cut to the leaves of a tree of square cells, so that a point meets few of them."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermotrack.functions.geo import edge_side
from thermotrack.plans.checkpoints import checkpointed_count
from thermotrack.plans.sided_join import is_small, shuffled

LEAF_TRIANGLES = 32
STEP = 2  # a split cell has 4 x 4 parts
DEEPEST = 12  # levels below the first grid: cells of one part in 4096
PIECES = 1024  # rows that a triangle may be cut to, on average
LEAF_KEY = ("leaf_level", "leaf_x", "leaf_y")

_CORNERS = ("a", "b", "c")


def _side(level) -> Column:
    return F.pow(F.lit(2.0), level)


def _cell(value: Column, level) -> Column:
    return F.floor(value / _side(level)).cast("bigint")


def _outside(u: str, v: str) -> Column:
    """Whether the cell lies wholly beyond the edge uv, seen from the triangle. In doubt it doesn't:
    the margin is far above the rounding of the products and far below a cell.
    """
    x0, y0 = (F.col(f"leaf_{axis}") * _side(F.col("leaf_level")) for axis in ("x", "y"))
    side = _side(F.col("leaf_level"))
    ux, uy, vx, vy = (F.col(f"{axis}_{end}") for end in (u, v) for axis in ("x", "y"))
    turn = F.signum(F.col("twice"))
    # the corner of the cell that lies farthest on the inner side
    x = x0 + F.when(turn * (uy - vy) > 0, side).otherwise(0.0)
    y = y0 + F.when(turn * (vx - ux) > 0, side).otherwise(0.0)
    margin = 1e-9 * side * (F.abs(vx - ux) + F.abs(vy - uy))
    size = F.greatest(F.abs(x), F.abs(y), F.abs(ux), F.abs(uy), F.abs(vx), F.abs(vy))
    rounding = 1e-15 * size * (F.abs(vx - ux) + F.abs(vy - uy) + F.abs(x - ux) + F.abs(y - uy))
    return turn * edge_side(ux, uy, vx, vy, x, y) < -(margin + rounding)


def _overlapping(pieces: DataFrame) -> DataFrame:
    beyond = [_outside(u, v) for u, v in (("a", "b"), ("b", "c"), ("c", "a"))]
    return pieces.filter(~(beyond[0] | beyond[1] | beyond[2]))


class TriangleLeaves:
    """Leaves of a tree of cells over triangles (x_a .. y_c, twice: doubled signed area, not 0).

    The first grid has about as many cells as there are triangles. A cell that more than leaf_triangles of them
    overlap is split into 4 x 4, again and again; only the parts that a triangle really overlaps get
    a row of it, so a sliver is cut along its length and not over its box. Splitting ends where
    triangles run together: in cells DEEPEST levels down, beside a vertex of more than
    leaf_triangles triangles, or when they are cut to PIECES rows each on average (parallel slivers
    more than some thousand times longer than they are apart). Every round of splits is one job.

    pieces: the triangles' columns and LEAF_KEY, from saved tables; rows: their number. The split cells
    of each level are saved and counted; a point finds its leaf by one look-up per level that has any.
    """

    def __init__(self, triangles: DataFrame, count: int, extent: float, leaf_triangles: int = LEAF_TRIANGLES):
        """count and extent: the number of triangles and the larger side of their box, to choose the
        first grid."""
        self.first = _first_level(extent, count)
        self.splits: list[tuple[int, DataFrame, int]] = []
        level = F.lit(self.first)
        pieces = triangles.withColumn("leaf_level", level)
        for axis in "xy":
            values = [F.col(f"{axis}_{v}") for v in _CORNERS]
            cells = F.sequence(_cell(F.least(*values), level), _cell(F.greatest(*values), level))
            pieces = pieces.withColumn(f"leaf_{axis}", F.explode(cells))
        pieces, rows = checkpointed_count(_overlapping(pieces))
        done, self.rows, written = None, 0, rows
        for depth in range(DEEPEST // STEP):
            cells = pieces.groupBy(*LEAF_KEY).agg(F.count("*").alias("_n"))
            crowded, n = checkpointed_count(cells.filter(F.col("_n") > leaf_triangles))
            if not n or written > PIECES * count:
                break
            here = self.first - depth * STEP
            crowded_rows = crowded.agg(F.sum("_n")).first()[0]
            crowded = crowded.drop("_n")
            self.splits.append((here, crowded, n))
            sided = F.broadcast(crowded) if is_small(crowded, n) else shuffled(crowded)
            quiet = pieces.join(sided, list(LEAF_KEY), "left_anti")
            done = quiet if done is None else done.unionByName(quiet)
            self.rows += rows - crowded_rows
            parts = pieces.join(sided, list(LEAF_KEY), "left_semi").withColumn("leaf_level", F.lit(here - STEP))
            for axis in "xy":
                own = F.col(f"leaf_{axis}") * (1 << STEP)
                values = [F.col(f"{axis}_{v}") for v in _CORNERS]
                first = F.greatest(own, _cell(F.least(*values), F.lit(here - STEP)))
                last = F.least(own + ((1 << STEP) - 1), _cell(F.greatest(*values), F.lit(here - STEP)))
                cells = F.when(first <= last, F.sequence(first, last))
                parts = parts.withColumn(f"leaf_{axis}", F.explode(cells))
            pieces, rows = checkpointed_count(_overlapping(parts.select(*pieces.columns)))
            written += rows
        self.rows += rows
        self.pieces = pieces if done is None else done.unionByName(pieces)

    def with_leaf(self, points: DataFrame, x: str, y: str) -> DataFrame:
        """points with LEAF_KEY, the leaf that each one lies in; rows are not multiplied."""
        depth = F.lit(0)
        for level, crowded, n in self.splits:
            found = crowded.select(
                F.col("leaf_x").alias(f"_x{level}"),
                F.col("leaf_y").alias(f"_y{level}"),
                F.lit(True).alias(f"_split{level}"),
            )
            at = [_cell(F.col(c), F.lit(level)) == F.col(f"_{axis}{level}") for c, axis in ((x, "x"), (y, "y"))]
            sided = F.broadcast(found) if is_small(found, n) else shuffled(found)
            points = points.join(sided, at[0] & at[1], "left").drop(f"_x{level}", f"_y{level}")
            depth = depth + F.coalesce(F.col(f"_split{level}").cast("int"), F.lit(0))
        keyed = points.withColumn("leaf_level", (F.lit(self.first) - depth * STEP).cast("int"))
        keyed = keyed.withColumns(
            {f"leaf_{axis}": _cell(F.col(c), F.col("leaf_level")) for c, axis in ((x, "x"), (y, "y"))}
        )
        return keyed.drop(*[f"_split{level}" for level, _, _ in self.splits])


def _first_level(extent: float, count: int) -> int:
    """Exponent of the side of the first cells: about as many cells as triangles."""
    return math.ceil(math.log2(extent / math.sqrt(count))) if count and extent > 0 else 0
