"""Codes for the parts of vectors, learned by ball k-means on whole numbers."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermotrack.llm.common import BROADCAST_BYTES, null_safe, packed, saved, unpacked

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024


class Balls:
    """A codebook of one part with what the entries' balls need: for every entry the others in the
    order of their distance. moved tells which entries are not where they were a round before.
    """

    def __init__(self, book: np.ndarray, moved: np.ndarray):
        self.book, self.moved = book, moved
        self.squares = (book * book).sum(axis=1)
        gaps = self.squares[:, None] + self.squares[None, :] - 2 * (book @ book.T)
        self.order = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.order, axis=1)

    def assign(self, x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """New codes of the rows x, their squared distances, and the number of distances computed.

        codes are those of the round before, or all 0 with every entry moved. A row at distance d of
        its entry can only go to entries within 2d of that entry, its neighbours:
        - if neither the entry nor any neighbour of its ball (radius: the largest d of its rows) has
          moved, its rows stay;
        - a row with no neighbour within 2d is in the stable core and stays;
        - the others lie in rings by the number of neighbours within 2d, doubling from ring to ring,
          and meet the neighbours of their ring only.
        """
        codes = codes.copy()
        own = x - self.book[codes]
        own = (own * own).sum(axis=1)
        computed = len(x)
        by_entry = np.argsort(codes, kind="stable")
        edges = np.searchsorted(codes[by_entry], np.arange(len(self.book) + 1))
        for entry in np.flatnonzero(np.diff(edges)):
            rows = by_entry[edges[entry] : edges[entry + 1]]
            near = np.searchsorted(self.gaps[entry], 4 * own[rows], side="right")
            if not self.moved[self.order[entry, : near.max()]].any():
                continue
            ring = np.ceil(np.log2(near)).astype(int)  # ring 0: only the entry itself
            for r in np.unique(ring[ring > 0]):
                members = rows[ring == r]
                candidates = np.sort(self.order[entry, : 1 << r])
                part = x[members]
                squares = ((part * part).sum(axis=1)[:, None] + self.squares[candidates][None, :]
                           - 2 * (part @ self.book[candidates].T))
                best = squares.argmin(axis=1)
                codes[members] = candidates[best]
                own[members] = squares[np.arange(len(members)), best]
                computed += squares.size
        return codes, own, computed


def _numbers(column, kind, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), length)


def _codes(column, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u2").reshape(-1, parts)


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
                 scale: int = SCALE, keep=(), vec_id: str = "vec_id", embedding: str = "embedding"):
    """(vec_id, columns of keep, codes array<int>, error bigint) of the kept vectors, and the codebooks
    as an array (parts, entries, components of a part) of whole numbers.

    Dropped are vectors that are null or hold null or non-finite components, and those of another length
    than most (ties: the shorter) or of a length that parts doesn't divide. A component x becomes
    floor(scale * x); vectors are cut into equal consecutive parts. Every part position has a codebook of
    its own, which starts as that part of the vectors with the smallest ids, ascending (null ids last;
    repeated rows count as often as they occur; of one id the smaller vector first). Each round assigns
    all parts to the nearest entry (ties: the lower) by ball k-means (`Balls.assign`) and replaces used
    entries by the floors of the means; at the end parts are assigned once more. The codes of a round are
    saved beside the numbers, so that the next one starts from them.

    A task sends one row of sums for each entry it uses; the driver holds the codebooks. An empty table
    gives no rows and codebooks without entries. Numbers so large that squared distances don't fit a
    bigint are an error.
    """
    assert entries <= 1 << 16
    spark = vectors.sparkSession
    keep = list(keep)
    whole = packed(vectors.select(vec_id, *keep, embedding), id=F.col(vec_id),
                   v=F.col(embedding).cast("array<double>")).filter(
        F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    whole = whole.withColumn("row", F.struct(*[F.col("row")[c].alias(c) for c in (vec_id, *keep)]))
    row_kind = whole.schema["row"].dataType.simpleString()
    found = whole.groupBy(F.size("v").alias("length")).agg(
        F.count("*").alias("n"), F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high")
    ).filter((F.col("length") > 0) & (F.col("length") % parts == 0)).orderBy(F.desc("n"), "length").first()
    if found is None:
        nothing = spark.createDataFrame([], f"row {row_kind}, codes array<int>, error bigint")
        return unpacked(nothing, codes=F.col("codes"), error=F.col("error")), np.empty((parts, 0, 0), np.int64)
    length = found["length"]
    width = length // parts
    most = max(abs(int(np.floor(scale * e))) for e in (found["low"], found["high"]))
    if width * (2 * most) ** 2 >= 1 << 60:
        raise ValueError(f"components from {found['low']} to {found['high']} are too large for exact distances")
    kind = np.float64 if width * (2 * most) ** 2 < 1 << 53 else np.int64  # exact in both
    whole = whole.filter(F.size("v") == length)
    numbers = F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("bigint"))
    first = whole.select("id", "v", numbers.alias("x")).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    books = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    start = F.unhex(F.lit("00" * 2 * parts))
    smaller = "int" if most < 1 << 31 else "bigint"
    table = saved(whole.select("row", numbers.cast(f"array<{smaller}>").alias("x"), start.alias("codes")))
    moved = np.ones(books.shape[:2], bool)

    def assigner(books, moved):
        def run(batches):
            balls = [Balls(book.astype(kind), m) for book, m in zip(books, moved, strict=True)]
            for batch in batches:
                x, codes = _numbers(batch.column("x"), kind, length), _codes(batch.column("codes"), parts).astype(np.int64)
                error = np.zeros(len(x), np.int64)
                for p, ball in enumerate(balls):
                    codes[:, p], own, _ = ball.assign(x[:, p * width : (p + 1) * width], codes[:, p])
                    error += own.astype(np.int64)
                out = pa.array([c.tobytes() for c in codes.astype(">u2")], pa.binary())
                yield pa.record_batch([batch.column("row"), batch.column("x"), out, pa.array(error)],
                                      names=["row", "x", "codes", "error"])

        return run

    def sums(batches):
        counts, totals = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            x, codes = _numbers(batch.column("x"), np.int64, length), _codes(batch.column("codes"), parts)
            for p in range(parts):
                counts[p] += np.bincount(codes[:, p], minlength=counts.shape[1])
                np.add.at(totals[p], codes[:, p], x[:, p * width : (p + 1) * width])
        p, e = np.nonzero(counts)
        yield pa.record_batch([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]),
                               pa.array(totals[p, e].tolist(), pa.list_(pa.int64()))],
                              names=["part", "entry", "n", "sums"])

    def assigned(table):
        schema = f"row {row_kind}, x array<{smaller}>, codes binary, error bigint"
        return saved(table.select("row", "x", "codes").mapInArrow(assigner(books, moved), schema))

    for _ in range(rounds):
        table = assigned(table)
        partial = table.select("x", "codes").mapInArrow(sums, "part int, entry int, n bigint, sums array<bigint>")
        means = partial.groupBy("part", "entry").agg(
            F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]).collect()
        before, books = books, books.copy()
        for r in means:
            books[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
        moved = (books != before).any(axis=2)
    table = assigned(table)
    code = [F.conv(F.hex(F.substring("codes", 2 * p + 1, 2)), 16, 10).cast("int") for p in range(parts)]
    return unpacked(table, codes=F.array(*code), error=F.col("error")), books


def with_group_error(coded: DataFrame, label: str = "label", name: str = "label_error") -> DataFrame:
    """Add the error summed over the rows of an equal label; nulls count as one label. Sums are combined
    before they are shuffled. The sums of few labels are broadcast, by their counted size; else both
    sides are shuffled and Spark splits a hot label's rows."""
    totals = saved(coded.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias("_sum")))
    size = totals.agg(F.count("*"), F.coalesce(F.max(F.octet_length(F.col("_label").cast("string"))), F.lit(0))).first()
    sided = F.broadcast(totals) if size[0] * (64 + size[1]) <= BROADCAST_BYTES else totals.hint("merge")
    joined = null_safe(coded.withColumn("_label", F.col(label)), sided, ["_label"])
    return joined.withColumn(name, F.col("_sum")).drop("_label", "_sum")


def books_digest(books: np.ndarray) -> str:
    """sha256 of all entries' components by part, entry and position, as decimals joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
