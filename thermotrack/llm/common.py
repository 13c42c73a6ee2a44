"""Helpers of the training-data operators: saved tables, rows kept whole, sized joins, components."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_BYTES = 64 << 20


def scratch_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without it gets a temporary folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="thermotrack-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: its lineage ends there."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/thermotrack-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def saved_size(df: DataFrame) -> int:
    """Bytes of memory that the rows of a saved table without strings may take, from its count."""
    width = 16 + 16 * len(df.columns)
    return df.count() * width


def sized(df: DataFrame, extra_width: int = 0) -> DataFrame:
    """Mark a saved table for a broadcast if its counted size allows; else it will be shuffled."""
    size = saved_size(df) if not extra_width else df.count() * (extra_width + 16 * len(df.columns))
    return F.broadcast(df) if size <= BROADCAST_BYTES else df.hint("merge")


def packed(df: DataFrame, **needed: Column) -> DataFrame:
    """The whole row as one struct `row` beside the needed columns, so that no name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                     *[c.alias(name) for name, c in needed.items()])


def unpacked(df: DataFrame, **added: Column) -> DataFrame:
    """The columns of `row`, then the added ones; an added column replaces one of the same name."""
    new = {name.lower() for name in added}
    old = [f for f in df.schema["row"].dataType.fieldNames() if f.lower() not in new]
    return df.select(*[F.col("row").getField(f).alias(f) for f in old],
                     *[c.alias(name) for name, c in added.items()])


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on columns of the same names, where null equals null."""
    other = right.select(*[F.col(c).alias(f"{c}__r") if c in keys else F.col(c)
                           for c in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"{k}__r")) for k in keys]
    return left.join(other, on, how).drop(*[f"{k}__r" for k in keys])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: (id, root), root the smallest id of the component.

    Every round hangs larger neighbours on the smallest one, first those above a vertex and then
    those below it. A round joins the edges with one minimum per vertex, so no list of neighbours is
    ever built and a star with any number of rays is only a skewed join. The edges of a round are
    saved; it ends when a round changes nothing, after a number of rounds that grows with the
    logarithm of the longest path. Vertices without an edge are not in the result; null ids have no
    edges.
    """
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    edges = saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while (now := _digest(edges)) != before and now[0]:
        before = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = saved(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = saved(large.join(least, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
            F.col("m").alias("v")).filter("u <> v").distinct())
    # every vertex but the roots is now the larger end of one edge, to its root
    ids = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return ids.union(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _digest(edges: DataFrame) -> tuple:
    """Count and order-free checksums of the edges, to see whether a round changed them."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")),
                           F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first())
