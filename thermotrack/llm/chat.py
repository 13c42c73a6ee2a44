"""Chat formatting in Spark expressions: turns to one marked text with a loss mask, and back."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, MORE, END = "<|turn|>", "<|text|>", "<|more|>", "<|end|>"
LEARNED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    r"""A text without any `<|`: `\` becomes `\s`, then `<|` becomes `\l`."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<|"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    """Inverse of `escaped`: every backslash of an escaped text begins one of the two codes."""
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<|")), F.lit("\\s"), F.lit("\\"))


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text",
                         learned_role: str = LEARNED_ROLE) -> DataFrame:
    """One row per conversation: conv_id, n_turns, n_blocks, formatted, segments.

    The turn structs of a conversation are collected and sorted by turn (null first), ties by role
    and text. Neighbouring turns of one role are merged into one block
    `<|turn|>role<|text|>text<|more|>text<|end|>`; texts and roles are escaped, so they can hold the
    markers themselves. `segments` is the formatted text cut into (text, loss) pieces: loss is true
    on the texts of the learned role alone, so concatenating all pieces gives `formatted`.

    A null text or role counts as the empty one. Rows with a null conv_id form a conversation of
    their own; repeated rows stay repeated turns; an empty table gives an empty one. Other columns
    are ignored.
    """
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"),
                 escaped(F.coalesce(F.col(role), F.lit(""))).alias("role"),
                 escaped(F.coalesce(F.col(text), F.lit(""))).alias("text")).alias("turn"),
    )
    collected = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    ahead = F.transform("turns", lambda t, i: F.struct(
        ((i == 0) | (F.get("turns", i - 1)["role"] != t["role"])).alias("first"),
        ((i == F.size("turns") - 1) | (F.get("turns", i + 1)["role"] != t["role"])).alias("last"),
        t["role"].alias("role"), t["text"].alias("text")))
    marked = collected.withColumn("turns", ahead)
    loss = lambda t: t["role"] == escaped(F.lit(learned_role))
    piece = lambda text, learned: F.struct(text.alias("text"), learned.alias("loss"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        piece(F.when(t["first"], F.concat(F.lit(TURN), t["role"], F.lit(TEXT))).otherwise(MORE), F.lit(False)),
        piece(t["text"], loss(t)),
        piece(F.when(t["last"], END).otherwise(""), F.lit(False)))))
    return (
        marked.withColumn("segments", F.filter(segments, lambda s: s["text"] != ""))
        .select("conv_id", F.size("turns").cast("bigint").alias("n_turns"),
                F.size(F.filter("turns", lambda t: t["first"])).cast("bigint").alias("n_blocks"),
                F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
                "segments")
    )


def parsed_turns(formatted: Column) -> Column:
    """array<struct<role, text>>: the original turns, read back from a formatted text."""
    blocks = F.split(formatted, r"<\|end\|>", -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)  # nothing follows the last end
    halves = F.transform(blocks, lambda b: F.split(F.substr(b, F.lit(len(TURN) + 1)), r"<\|text\|>", -1))
    return F.flatten(F.transform(halves, lambda h: F.transform(
        F.split(h[1], r"<\|more\|>", -1),
        lambda t: F.struct(unescaped(h[0]).alias("role"), unescaped(t).alias("text")))))


def learned_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    learned = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(learned, lambda s: unescaped(s["text"])), "")
