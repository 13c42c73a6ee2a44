"""A training corpus from documents: toxicity, line dedup, near-dedup, mixing, BPE tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and
read back as the docs of the next one. All but the last return the columns of docs. Null and empty
texts are never toxic, have no lines, link with nothing and have no tokens: they pass. An empty table
passes through all stages. Further columns of docs are kept.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermotrack.llm.bpe import encode
from thermotrack.llm.common import scratch_folder
from thermotrack.llm.lines import dedup_lines
from thermotrack.llm.minhash import drop_near_duplicates
from thermotrack.llm.mixing import mix_sources
from thermotrack.llm.registry import table, vocabulary
from thermotrack.llm.toxicity import fit_toxicity, score_toxicity

ORACLE_SQL = None  # noisy-or training and BPE can't be said in SQL


def _applied(docs: DataFrame, operator, *seen: str) -> DataFrame:
    """operator over the text and the columns `seen` of docs; all others are in one struct `_others`
    that it carries along, so that no name of theirs meets a name of its own."""
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    return operator(docs.select("text", *seen, others.alias("_others")))


def _like(result: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The columns of docs again, from the carried struct but for text and the changed ones."""
    old = {c: F.col("_others").getField(c) for c in docs.columns if c != "text"}
    new = {"text": F.col("text")} | {c: v for c, v in changed.items() if c in old}
    return result.select(*[(old | new)[c].alias(c) for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents that score as toxic; learned from a bounded sample
    of the labelled documents (`fit_toxicity`)."""
    model = fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = _applied(docs, lambda d: score_toxicity(d, model))
    return _like(scored.filter("not is_toxic"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that an earlier kept line equals or nearly equals, and sets n_chars anew; documents
    that lose every line go."""
    result = _applied(docs, dedup_lines, "doc_id")
    if "n_chars" not in docs.columns:
        return _like(result, docs)
    before = F.col("_others").getField("n_chars")
    after = F.length("text").cast(docs.schema["n_chars"].dataType)
    return _like(result, docs, n_chars=F.when(F.col("text").isNull(), before).otherwise(after))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return _like(_applied(docs, drop_near_duplicates, "doc_id"), docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources by weight: a document comes as often as the mix takes it, or not at all."""
    mixed = _applied(docs, mix_sources, "doc_id", "source")
    times = F.explode(F.sequence(F.lit(1), F.col("repeats")))
    return _like(mixed.filter("repeats > 0").withColumn("repeats", times), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Columns of docs, ids array<int> and n_tokens."""
    return encode(docs, vocabulary()).withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order on documents; each one's result is saved in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{scratch_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
