"""Joining a large side to a small one by the measured size of the small one."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermotrack.plans.checkpoints import checkpointed, checkpointed_count
from thermotrack.plans.slices import join_null_safe

BROADCAST_BYTES = 150 << 20  # of rows in memory, in each executor
BROADCAST_SETTING = "thermotrack.broadcastBytes"


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether so many rows of df, at the default width of their columns, may be broadcast. The
    bound is BROADCAST_BYTES, or the session setting BROADCAST_SETTING when an operator is called.
    """
    most = int(df.sparkSession.conf.get(BROADCAST_SETTING, str(BROADCAST_BYTES)))
    return rows * (16 + df._jdf.schema().defaultSize()) <= most


def join_on_cell(large: DataFrame, small: DataFrame, keys, large_id: str, small_rows: int, tasks: int | None = None):
    """Inner equi-join. A counted small side is broadcast, so the large side does not move and a
    hot key costs nothing. Beyond the bound both sides are shuffled on (key, _salt), where only the
    rows of hot keys have a salt other than 0, see `salted`. The column `_salt` stays, to let later
    groupings by it keep the partitioning. A shuffled join has just so many tasks, if given; else
    their number is left to Spark.
    """
    if is_small(small, small_rows):
        return large.join(F.broadcast(small), list(keys))
    large, small = salted(large, small, keys, large_id, tasks)
    if tasks is not None:
        large, small = (df.repartition(tasks, *keys, "_salt") for df in (large, small))
    return large.join(shuffled(small), [*keys, "_salt"])


def tasks_for(df: DataFrame, rows: int, rows_per_task: int) -> int:
    """Tasks for so many rows: the session's number of shuffle partitions, or as many more as keep a task
    to some rows_per_task, so that what one task holds doesn't grow with the table.
    """
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_task))


def salted(
    large: DataFrame, small: DataFrame, keys, large_id: str, tasks: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column `_salt`, so that an equi-join on (keys, _salt) gives the same rows as one
    on keys, and no (key, _salt) has many more rows of large than an even share of a task.

    The rows of large are counted by key. A key with more than an even share is hot; there are fewer hot
    keys than tasks, so they may be broadcast. Its rows are dealt to as many salts as it has shares, by
    a hash of large_id, and its rows of small are repeated as often. Nothing else is copied.
    """
    tasks = tasks or int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = checkpointed(large.groupBy(*keys).agg(F.count("*").alias("_rows")))
    share = max(1, (counts.agg(F.sum("_rows")).first()[0] or 0) // tasks)
    hot = counts.filter(F.col("_rows") > share).select(
        *keys, F.ceil(F.col("_rows") / share).cast("int").alias("_salts")
    )
    salts = F.coalesce("_salts", F.lit(1))
    own = F.pmod(F.xxhash64(large_id), salts).cast("int")
    spread = F.explode(F.sequence(F.lit(0), salts - 1))
    return tuple(
        df.join(F.broadcast(hot), list(keys), "left").withColumn("_salt", salt).drop("_salts")
        for df, salt in ((large, own), (small, spread))
    )


def shuffled(small: DataFrame) -> DataFrame:
    """Keep Spark from broadcasting a frame whose size it guesses from the small file it came from."""
    return small.hint("merge")


def join_summary(large: DataFrame, summary: DataFrame, keys) -> DataFrame:
    """Null-safe inner join with a per-slice or per-series summary, which is saved and counted: a
    short one is broadcast, so the large side keeps its place; a long one is shuffled.
    """
    saved, rows = checkpointed_count(summary)
    few = is_small(saved, rows)
    return join_null_safe(large, F.broadcast(saved) if few else shuffled(saved), keys)
