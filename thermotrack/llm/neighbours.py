"""Approximate nearest neighbours: stable projections in kd-trees, verified until a chi-square test stops."""

from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thermotrack.llm.common import saved

DIMENSIONS = 12  # of the projection; even, for the closed form of the chi-square distribution
CONFIDENCE = 0.98
CELL_ROWS = 4096
LEAF_ROWS = 32
SAMPLE_ROWS = 20_000
SEED = 7001


def chi_square(x: float, degrees: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    half = x / 2
    return 1 - exp(-half) * sum(half**i / factorial(i) for i in range(degrees // 2))


def chi_square_point(probability: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < probability else (low, middle)
    return high


class Splits:
    """A kd-tree of cells: the median of the widest side of each node, from a sample of projections."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.levels = max(0, (cells - 1).bit_length()) if len(sample) else 0
        self.axis = np.zeros(1 << self.levels, np.int64)
        self.value = np.zeros(1 << self.levels)
        self._split(sample, 1, self.levels)

    def _split(self, points, node, levels):
        if levels == 0:
            return
        if len(points):
            self.axis[node] = axis = int(np.argmax(np.ptp(points, axis=0)))
            self.value[node] = value = float(np.median(points[:, axis]))
        else:
            axis, value = 0, 0.0
        right = points[:, axis] > value if len(points) else np.empty(0, bool)
        self._split(points[~right], 2 * node, levels - 1)
        self._split(points[right], 2 * node + 1, levels - 1)

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.levels):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] > self.value[node])
        return node - (1 << self.levels)


class CellTree:
    """The rows of one cell in kd order: leaves of few rows with their bounding boxes."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.bounds, stack = [], [(0, len(points))]
        while stack:
            begin, end = stack.pop()
            if end - begin <= LEAF_ROWS:
                self.bounds.append((begin, end))
                continue
            own = self.order[begin:end]
            axis = int(np.argmax(np.ptp(points[own], axis=0)))
            middle = (end - begin) // 2
            self.order[begin:end] = own[np.argpartition(points[own, axis], middle)]
            stack += [(begin, begin + middle), (begin + middle, end)]
        leaves = [points[self.order[b:e]] for b, e in self.bounds]
        self.low = np.array([p.min(axis=0) for p in leaves])
        self.high = np.array([p.max(axis=0) for p in leaves])

    def leaves_by_distance(self, point: np.ndarray):
        gaps = box_distance(self.low, self.high, point)
        order = np.argsort(gaps, kind="stable")
        return order, gaps[order]


def box_distance(low, high, point) -> np.ndarray:
    """Squared distance of a point from boxes."""
    return (np.maximum(0, np.maximum(low - point, point - high)) ** 2).sum(axis=-1)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, dimensions: int = DIMENSIONS,
            confidence: float = CONFIDENCE, cell_rows: int = CELL_ROWS, sample_rows: int = SAMPLE_ROWS,
            vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k rows of vectors nearest to each query by cosine: query_id, rank, vec_id, score.

    Unit vectors are projected to a few dimensions by Gaussian (2-stable) vectors, so the squared
    projected distance of a row at distance d is d**2 times a chi-square variable. Rows are dealt to
    the cells of a kd-tree that is fitted on at most sample_rows of the vectors; all rows are indexed,
    each cell in a kd-tree of its own. A query is searched in its own cell first, and then in every
    cell that its best k so far don't rule out. A search verifies leaves in the order of projected
    distance r, until chi-square(r**2 / d_k**2) >= confidence for the k-th best distance d_k so far: a
    nearer row would have shown up by then with that probability.

    Equal vectors are indexed once, with their k + 1 smallest ids, which is all that k results can
    need. Cells that get many more rows than meant (equal directions) are split by hash. The score is
    the cosine of the original vectors in double precision; ties go to the smaller vec_id. A query's
    own row is no candidate. Vectors that are null, zero, of another length than most, or that hold
    null or non-finite components take no part, and neither do null ids. A repeated vec_id counts
    once per different vector. Empty tables give an empty one. Only one box per cell_rows vectors and
    the sample are on the driver.
    """
    good = lambda df: df.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).cast("array<double>").alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0))
    rows, asked = good(vectors), good(queries)
    spark = vectors.sparkSession
    result = "query_id bigint, rank int, vec_id bigint, score double"
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], result)
    length = lengths["n"]
    of_length = F.size("v") == length
    own_order = Window.partitionBy("v").orderBy("id")
    distinct = (rows.filter(of_length).dropDuplicates(["id", "v"]).withColumn("place", F.row_number().over(own_order))
                .filter(F.col("place") <= k + 1)
                .groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    gaussians = np.random.default_rng(SEED).standard_normal((length, dimensions))

    def project(batches):
        for batch in batches:
            v = _matrix(batch.column("v"))
            p = (v / np.sqrt((v * v).sum(axis=1, keepdims=True))) @ gaussians
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * dimensions), pa.array(p.ravel()))
            yield pa.record_batch([*batch.columns, flat], names=[*batch.schema.names, "p"])

    placed = saved(distinct.mapInArrow(project, "v array<double>, ids array<bigint>, p array<double>"))
    count = placed.count()
    picked = placed.select("p", F.xxhash64("v").alias("h")).orderBy("h").limit(sample_rows).collect()
    splits = Splits(np.array([r["p"] for r in picked]).reshape(-1, dimensions), -(-count // cell_rows))

    def with_cell(batches):
        for batch in batches:
            cells = splits.cell(_matrix(batch.column("p"))) if batch.num_rows else np.empty(0, np.int64)
            yield pa.record_batch([*batch.columns, pa.array(cells)], names=[*batch.schema.names, "cell"])

    index = placed.mapInArrow(with_cell, "v array<double>, ids array<bigint>, p array<double>, cell bigint")
    index = saved(index)
    sizes = {r["cell"]: r["count"] for r in index.groupBy("cell").count().collect()}
    large = {c: -(-n // cell_rows) for c, n in sizes.items() if n > 4 * cell_rows}
    part = F.lit(0)
    for c, n in large.items():
        part = F.when(F.col("cell") == c, F.pmod(F.xxhash64("v"), F.lit(n))).otherwise(part)
    index = index.withColumn("part", part.cast("bigint"))
    sides = [f(F.col("p")[i]).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(dimensions)]
    boxes = index.groupBy("cell", "part").agg(*sides).orderBy("cell", "part").collect()
    keys = np.array([(b["cell"], b["part"]) for b in boxes], np.int64)
    low = np.array([[b[f"low{i}"] for i in range(dimensions)] for b in boxes])
    high = np.array([[b[f"high{i}"] for i in range(dimensions)] for b in boxes])
    limit = chi_square_point(confidence, dimensions)

    def search(table_rows: pa.Table, table_queries: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if table_rows.num_rows and table_queries.num_rows:
            v, p = _matrix(table_rows.column("v")), _matrix(table_rows.column("p"))
            ids = table_rows.column("ids").to_pylist()
            smallest = np.array([i[0] for i in ids])
            norms = np.sqrt((v * v).sum(axis=1))
            tree = CellTree(p)
            asks = zip(table_queries.column("id").to_pylist(), _matrix(table_queries.column("v")),
                       _matrix(table_queries.column("p")), table_queries.column("bound").to_pylist(), strict=True)
            for query, q, at, bound in asks:
                for score, found in _search(tree, v, norms, ids, smallest, query, q, at, bound, k, limit):
                    out["query_id"].append(query)
                    out["vec_id"].append(found)
                    out["score"].append(score)
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()),
                         "score": pa.array(out["score"], pa.float64())})

    def first_cells(batches):
        for batch in batches:
            n = batch.num_rows
            near = [keys[int(np.argmin(box_distance(low, high, p)))] for p in _matrix(batch.column("p"))] if n else []
            yield pa.record_batch(
                [*batch.columns, pa.array([int(c) for c, _ in near], pa.int64()), pa.array([int(s) for _, s in near], pa.int64()),
                 pa.array([float("inf")] * n, pa.float64())], names=[*batch.schema.names, "cell", "part", "bound"])

    def other_cells(batches):
        for batch in batches:
            which, cells = [], []
            bounds = batch.column("bound").to_pylist()
            homes = zip(batch.column("cell").to_pylist(), batch.column("part").to_pylist(), strict=True)
            for i, (p, bound, home) in enumerate(zip(_matrix(batch.column("p")), bounds, homes, strict=True) if batch.num_rows else ()):
                for c in np.flatnonzero(box_distance(low, high, p) <= limit * bound):
                    if tuple(keys[c]) != home:
                        which.append(i)
                        cells.append(keys[c])
            taken = batch.select(["id", "v", "p", "bound"]).take(pa.array(which, pa.int32()))
            yield pa.record_batch([*taken.columns, pa.array([int(c) for c, _ in cells], pa.int64()),
                                   pa.array([int(s) for _, s in cells], pa.int64())],
                                  names=["id", "v", "p", "bound", "cell", "part"])

    hits = "query_id bigint, vec_id bigint, score double"
    asked = asked.filter(of_length).dropDuplicates(["id"])
    asked = saved(asked.mapInArrow(project, "id bigint, v array<double>, p array<double>").mapInArrow(
        first_cells, "id bigint, v array<double>, p array<double>, cell bigint, part bigint, bound double"))
    by_cell = index.groupBy("cell", "part")
    home = saved(by_cell.cogroup(asked.groupBy("cell", "part")).applyInArrow(search, hits))
    kth = home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
    bound = F.when(F.col("n") >= k, F.greatest(F.lit(0.0), 2 - 2 * F.col("worst"))).otherwise(float("inf"))
    again = asked.drop("bound").join(kth.select(F.col("query_id").alias("id"), bound.alias("bound")), "id", "left").select(
        "id", "v", "p", "cell", "part", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    spread = again.mapInArrow(
        other_cells, "id bigint, v array<double>, p array<double>, bound double, cell bigint, part bigint")
    rest = by_cell.cogroup(spread.groupBy("cell", "part")).applyInArrow(search, hits)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = home.union(rest).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search(tree, v, norms, ids, smallest, query, q, at, bound, k, limit):
    """Up to k (score, id) of one cell; bound: squared distance of the k-th best found elsewhere."""
    order, gaps = tree.leaves_by_distance(at)
    norm = np.sqrt((q * q).sum())
    rows, scores, done, step = np.empty(0, np.int64), np.empty(0), 0, 2
    best: list = []
    while done < len(order):
        near = done + int(np.searchsorted(gaps[done : done + step], limit * bound, side="right"))
        if near == done:
            break
        new = np.concatenate([tree.order[slice(*tree.bounds[leaf])] for leaf in order[done:near]])
        rows = np.concatenate([rows, new])
        scores = np.concatenate([scores, (v[new] @ q) / (norms[new] * norm)])
        top = np.lexsort((smallest[rows], -scores))[: k + 1]
        rows, scores = rows[top], scores[top]
        best = sorted((-s, i) for r, s in zip(rows.tolist(), scores.tolist(), strict=True) for i in ids[r] if i != query)[:k]
        if len(best) == k:
            bound = min(bound, max(0.0, 2 + 2 * best[-1][0]))
        done, step = near, 2 * step
    return [(-s, i) for s, i in best]
