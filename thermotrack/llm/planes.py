"""Centroid clustering of whole-number vectors by AND-popcounts of bit planes."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermotrack.llm.common import packed, saved, unpacked

COMPONENTS = 64  # one bit of every component fills one uint64
MOST_PLANES = 27  # squared distances then stay below 2**61
SLICE = 4096  # vectors worked on at once


def pack_planes(values: np.ndarray, planes: int) -> np.ndarray:
    """Bit b of all 64 components of a row of whole numbers >= 0, as number b of the row."""
    bits = (values[:, None, :] >> np.arange(planes)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view("<u8").reshape(len(values), planes)


def unpack_planes(planes: np.ndarray) -> np.ndarray:
    """The whole numbers of packed rows."""
    flat = np.ascontiguousarray(planes).view(np.uint8).reshape(len(planes), -1, 8)
    bits = np.unpackbits(flat, axis=2, bitorder="little").astype(np.int64)
    return (bits << np.arange(planes.shape[1])[None, :, None]).sum(axis=1)


def plane_dots(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Dot products of all packed rows with all packed others: popcounts weighted by 2**(b + c)."""
    dots = np.zeros((len(rows), len(others)), np.int64)
    for b in range(rows.shape[1]):
        for c in range(others.shape[1]):
            dots += np.bitwise_count(rows[:, b, None] & others[None, :, c]).astype(np.int64) << (b + c)
    return dots


def plane_squares(rows: np.ndarray) -> np.ndarray:
    """Squared lengths of packed rows."""
    total = np.zeros(len(rows), np.int64)
    for b in range(rows.shape[1]):
        for c in range(b, rows.shape[1]):
            count = np.bitwise_count(rows[:, b] & rows[:, c]).astype(np.int64)
            total += count << (b + c + (b != c))
    return total


def nearest_planes(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller) and its squared distance, for each row."""
    squares = plane_squares(rows)[:, None] + plane_squares(centroids)[None, :] - 2 * plane_dots(rows, centroids)
    best = squares.argmin(axis=1)
    return best, squares[np.arange(len(rows)), best]


def _rows_of(column, planes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, planes)


def plane_kmeans(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, seed: int = 1,
                 vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Columns of vectors and cluster, distance, cluster_inertia, inertia, centroid (array<bigint>).

    Kept are vectors of exactly 64 components, none null or non-finite; a component x counts as
    floor(scale * x). All components are moved up by one common number, so that they are >= 0, and the
    bit planes are packed once; distances don't feel the move. The centroids start as the k kept
    vectors whose sha256 of `seed:vec_id` is smallest (null id: `seed:null`; of one id the smaller
    vector first; repeated rows count as often as they occur). A round assigns every vector to the
    nearest centroid and replaces centroids by the floors of the means; then all are assigned once more.

    A task sends one row of sums per centroid, and the driver holds k centroids. With fewer than k
    kept vectors each one is a centroid; none at all give an empty result. Components that lie
    2**27 or more apart after scaling are an error, as distances would not fit a bigint.
    """
    spark = vectors.sparkSession
    v = F.col(embedding).cast("array<double>")
    whole = packed(vectors, id=F.col(vec_id).cast("string"), v=v).filter(
        (F.size("v") == COMPONENTS)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    ends = whole.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    row_kind = whole.schema["row"].dataType.simpleString()
    if ends[0] is None:
        nothing = spark.createDataFrame([], f"row {row_kind}, cluster int, distance bigint, cluster_inertia bigint, "
                                            "inertia bigint, centroid array<bigint>")
        return unpacked(nothing, **{c: F.col(c) for c in nothing.columns if c != "row"})
    low, high = (int(np.floor(scale * e)) for e in ends)
    planes = max(1, (high - low).bit_length())
    if planes > MOST_PLANES:
        raise ValueError(f"components from {ends[0]} to {ends[1]} lie too far apart for exact distances")

    def pack(batches):
        for batch in batches:
            numbers = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, COMPONENTS)
            whole_numbers = np.floor(scale * numbers).astype(np.int64) - low
            bits = [pack_planes(whole_numbers[i : i + SLICE], planes) for i in range(0, len(numbers), SLICE)]
            out = [r.tobytes() for part in bits for r in part]
            yield pa.record_batch([batch.column("row"), pa.array(out, pa.binary())], names=["row", "planes"])

    table = saved(whole.select("row", "v").mapInArrow(pack, f"row {row_kind}, planes binary"))
    number = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("id", F.lit("null"))), 256)
    first = whole.select(number.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    centroids = np.floor(scale * np.array([r["v"] for r in first])).astype(np.int64) - low

    def sums_of(centroids):
        centers = pack_planes(centroids, planes)

        def run(batches):
            counts, sums = np.zeros(len(centers), np.int64), np.zeros((len(centers), COMPONENTS), np.int64)
            for batch in batches:
                rows = _rows_of(batch.column("planes"), planes)
                for i in range(0, len(rows), SLICE):
                    part = rows[i : i + SLICE]
                    best, _ = nearest_planes(part, centers)
                    counts += np.bincount(best, minlength=len(centers))
                    np.add.at(sums, best, unpack_planes(part))
            used = np.flatnonzero(counts)
            yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(counts[used]),
                                   pa.array(sums[used].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

        return run

    for _ in range(rounds):
        partial = table.select("planes").mapInArrow(sums_of(centroids), "cluster int, n bigint, sums array<bigint>")
        total = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(COMPONENTS)]
        for r in partial.groupBy("cluster").agg(F.sum("n").alias("n"), *total).collect():
            centroids[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(COMPONENTS)]
    centers = pack_planes(centroids, planes)

    def assign(batches):
        for batch in batches:
            rows = _rows_of(batch.column("planes"), planes)
            found = [nearest_planes(rows[i : i + SLICE], centers) for i in range(0, len(rows), SLICE)]
            best, squares = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in (0, 1))
            yield pa.record_batch([batch.column("row"), pa.array(best.astype(np.int32)), pa.array(squares)],
                                  names=["row", "cluster", "distance"])

    assigned = saved(table.mapInArrow(assign, f"row {row_kind}, cluster int, distance bigint"))
    spread = {r["cluster"]: r["d"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    of_cluster = F.array(*[F.lit(spread.get(c, 0)).cast("bigint") for c in range(len(centroids))])
    final = F.array(*[F.array(*[F.lit(x).cast("bigint") for x in (c + low).tolist()]) for c in centroids])
    return unpacked(assigned, cluster=F.col("cluster"), distance=F.col("distance"),
                    cluster_inertia=F.get(of_cluster, F.col("cluster")),
                    inertia=F.lit(sum(spread.values())).cast("bigint"), centroid=F.get(final, F.col("cluster")))
