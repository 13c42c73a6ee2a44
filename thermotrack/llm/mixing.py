"""Mixing sources to target weights with hash-threshold histograms, in DataFrame functions only."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thermotrack.llm.common import WORD, null_safe, packed, saved, sized, unpacked

WEIGHTS = (1, 2, 3)
MOST = 3  # a target stops at this many times the size of its source
HASH_BITS = 60
LEVEL_BITS = 12


def document_hash(doc_id):
    """60 bits that order the documents of a source: the first 15 digits of md5 of the id."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, 15)
    return F.conv(digits, 16, 10).cast("bigint")


def source_targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) -> also target.

    Sources in code point order, null last, weigh `weights`, repeating. They share the sum of all
    sizes by weight; a target stops at `most` times its source and the excess is shared again by
    weight among the others. The fixed point is a water level: with sources in the order of
    cap / weight, the capped ones are a prefix, and the level is what is left over the weight that is
    left. The table has one row per source, so its global windows stay small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    number = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sources.withColumn(
        "weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (number + 1).cast("int"))
    ).withColumn("cap", F.col("source_size") * most)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    first, last = Window.unboundedPreceding, Window.unboundedFollowing
    capped, rest = by_cap.rowsBetween(first, -1), by_cap.rowsBetween(0, last)
    every = by_cap.rowsBetween(first, last)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(capped), F.lit(0))
    level = left / F.sum("weight").over(rest)
    leveled = weighed.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    final = F.first("level", ignorenulls=True).over(every) * F.col("weight")
    target = F.least(F.col("cap").cast("double"), F.coalesce(final, F.col("cap").cast("double")))
    return leveled.withColumn("target", target).select("source", "source_size", "target")


def mix_sources(docs: DataFrame, weights=WEIGHTS, most: int = MOST, doc_id: str = "doc_id",
                text: str = "text", source: str = "source") -> DataFrame:
    """Columns of docs, and size, source_size, target, repeats, taken (= size * repeats).

    A source with target = (q + r) * source_size takes each document q times, and documents worth
    r * source_size words once more: those with the smallest hashes. The threshold is found by
    histograms: words by source and leading 12 bits of the hash, the bucket in which the running sum
    passes the budget, then only that bucket by the next 12 bits, until all 60 bits are fixed. The
    document at the threshold is taken if that comes nearer to the budget. Thresholds are nested: a
    larger budget takes the same documents and more. Nothing is sorted but the 4096 sums of a source.

    Size is the number of words (null or empty text: 0, never taken more than counts as 0 words).
    Rows with the same doc_id have the same hash and are taken together; a null doc_id counts as the
    text 'null'. An empty table gives an empty one. Reruns give the same rows.
    """
    whole = packed(docs, id=F.col(doc_id), source=F.col(source),
                   size=F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint"))
    whole = whole.withColumn("hash", document_hash(F.col("id")))
    sizes = saved(whole.select("source", "size", "hash"))
    sources = saved(source_targets(
        sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    plan = saved(_thresholds(sizes, sources))
    joined = null_safe(whole, sized(plan, extra_width=256), ["source"])
    extra = (F.col("hash") < F.col("threshold")) | ((F.col("hash") == F.col("threshold")) & F.col("with_last"))
    repeats = F.least(F.col("full") + F.coalesce(extra, F.lit(False)).cast("int"), F.lit(most))
    return unpacked(joined, size=F.col("size"), source_size=F.col("source_size"), target=F.col("target"),
                    repeats=repeats.cast("int"), taken=F.col("size") * repeats)


def _thresholds(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source: full repeats, threshold hash, whether the threshold's own documents are taken."""
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    state = sources.withColumn("full", F.floor(ratio).cast("int")).withColumn(
        "budget", F.col("target") - F.col("full") * F.col("source_size")
    ).withColumn("prefix", F.lit(0).cast("bigint"))
    for fixed in range(0, HASH_BITS, LEVEL_BITS):
        state = saved(_refined(sizes, state, fixed))  # a row for each source; keeps the plans short
    # what remains of the budget lies within the words of the last hash
    return state.select("source", "source_size", "target", "full", F.col("prefix").alias("threshold"),
                        (2 * F.col("budget") >= F.col("words")).alias("with_last"))


def _refined(sizes: DataFrame, state: DataFrame, fixed: int) -> DataFrame:
    """Fix the next bits: words by bucket below the prefix, and the bucket where the budget ends."""
    left = HASH_BITS - fixed - LEVEL_BITS
    carried = [c for c in state.columns if c != "words"]
    leading = F.shiftright("hash", left)
    found = sizes.select("source", "size", leading.alias("bucket"), F.shiftright("hash", left + LEVEL_BITS).alias("prefix"))
    if fixed:
        found = null_safe(found, state.select("source", "prefix"), ["source", "prefix"], "inner")
    summed = found.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    joined = null_safe(summed, state.select(*carried), ["source"], "inner")
    running = Window.partitionBy("source").orderBy("bucket")
    sums = joined.withColumn("until", F.sum("words").over(running))
    # the first bucket whose running sum passes the budget; if none does, the last bucket
    last = Window.partitionBy("source")
    reached = sums.withColumn("pick", F.coalesce(
        F.min(F.when(F.col("until") > F.col("budget"), F.col("bucket"))).over(last),
        F.max("bucket").over(last)))
    return reached.filter(F.col("bucket") == F.col("pick")).select(
        *[c for c in carried if c not in ("budget", "prefix")],
        (F.col("budget") - (F.col("until") - F.col("words"))).alias("budget"),
        F.col("bucket").alias("prefix"), "words")
