"""Documents in blocks of consecutive ids, for operators that need the order of the documents."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20


def id_chunks(rows: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int, int]:
    """rows (with integer id, and text) with a column chunk, the bytes of all texts, the last chunk.

    Chunks are ranges of the id that hold some chunk_bytes of text, numbered in id order; a null id
    comes after all others, in a chunk of its own. All rows of one id are in one chunk. The cuts are
    approximate quantiles of the ids: the driver holds one number per chunk.
    """
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // chunk_bytes) + 1
    wanted = [i / n for i in range(1, n)]
    cuts = np.unique(np.array(rows.stat.approxQuantile("id", wanted, 0.2 / n) if wanted else [], np.int64))

    @F.pandas_udf("int")
    def chunk(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(np.int64), side="right").astype(np.int32))

    last = len(cuts) + 1
    place = F.when(F.col("id").isNull(), last).otherwise(chunk(F.coalesce("id", F.lit(0).cast("bigint"))))
    return rows.withColumn("chunk", place.cast("int")), total, last
