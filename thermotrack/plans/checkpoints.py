"""Cutting lineage with tables in the shared checkpoint folder of the cluster."""

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def scratch_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without it gets a temporary folder of its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="thermotrack-checkpoint-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written as Parquet and read back: computed once, survives the loss of executors, and later
    steps read only the columns they need. The files stay until the folder is cleaned.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/thermotrack-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed_count(df: DataFrame) -> tuple[DataFrame, int]:
    """`checkpointed`, and the number of rows, counted while they are written."""
    seen = Observation()
    saved = checkpointed(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return saved, seen.get["rows"]
