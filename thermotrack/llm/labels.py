"""Labels that classifiers may learn from."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDS = 4
HELD_OUT = 2


def is_held_out(doc_id) -> object:
    """Whether crc32 of the doc_id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def learned_labels(labels: DataFrame, label: str) -> DataFrame:
    """(id, label 0 or 1) of the documents that aren't held out; of repeated labels the largest."""
    rows = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label"))
    return rows.filter(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~is_held_out(F.col("id"))).groupBy(
        "id").agg(F.max("label").alias("label"))
