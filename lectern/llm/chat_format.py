"""Chat formatting with Spark expressions only.

Turn structs of a conversation are collected and sorted, adjacent turns of one
role are merged by an array aggregation, and the formatted text is a
concatenation. The template of a block, which is one
run of turns of a role, is

    [[role]]text<+>text</>

Inside texts and roles every one of `\\ [ ] < >` gets a backslash before it, so
no control string, of this template or of a common chat format, can stand in a
text, and removing the backslashes gives the text back.

Defined results: rows are ordered by turn, ties by role and text, a null turn
first; null text is empty; null role is an empty one; repeated rows stay;
conversations with a null id form one conversation; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Control strings: one parts the turns merged in a block, one ends it.
NEXT, CLOSE = "<+>", "</>"
ESCAPED = r"([\\\[\]<>])"
#: A block's opening control string: brackets around a role without an unescaped bracket.
ROLE = r"^\[\[((?:[^\\\[\]<>]|\\[\\\[\]<>])*+)\]\]"


def escape(text: Column) -> Column:
    """Every bracket, angle and backslash gets a backslash, which no control string holds."""
    return F.regexp_replace(text, ESCAPED, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\" + ESCAPED, "$1")


def merge_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, blocks array<struct<role, texts array<string>>>: adjacent turns of one role together."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("turn"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    # Starts of blocks first; each block then is one slice, so the work stays linear in the turns.
    starts = F.filter(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: (i == 1) | (F.element_at("turns", i.cast("int"))["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)).cast("int"))["role"]),
    )
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("turns") + 1))
    return (
        grouped.withColumn("starts", starts)
        .withColumn("ends", ends)
        .select(
            "conv_id",
            F.transform(
                F.arrays_zip("starts", "ends"),
                lambda x: F.struct(
                    F.element_at("turns", x["starts"])["role"].alias("role"),
                    F.transform(F.slice("turns", x["starts"], x["ends"] - x["starts"]), lambda t: t["text"]).alias("texts"),
                ),
            ).alias("blocks"),
        )
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted string, pieces array<struct<text, loss boolean>>: pieces concatenate to formatted;
    loss marks the stretches that training learns from, which are the assistants' texts and no control string."""
    blocks = merge_turns(conversations)

    def pieces(block: Column) -> Column:
        wanted = block["role"] == "assistant"
        plain = lambda s: F.array(F.struct(s.alias("text"), F.lit(False).alias("loss")))
        texts = F.transform(block["texts"], lambda t: F.struct(escape(t).alias("text"), wanted.alias("loss")))
        between = F.flatten(F.transform(texts, lambda t, i: F.when(i == 0, F.array(t)).otherwise(F.concat(plain(F.lit(NEXT)), F.array(t)))))
        return F.concat(plain(F.concat(F.lit("[["), escape(block["role"]), F.lit("]]"))), between, plain(F.lit(CLOSE)))

    return blocks.select("conv_id", F.flatten(F.transform("blocks", pieces)).alias("pieces")).select(
        "conv_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), "pieces"
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns array<struct<role, text>>, loss_text: the turns from the formatted text
    alone, and what stands under the loss mask, unescaped."""
    parts = F.filter(F.split("formatted", r"\Q" + CLOSE + r"\E", -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = unescape(F.regexp_extract(block, ROLE, 1))
        texts = F.split(F.regexp_replace(block, ROLE, ""), r"\Q" + NEXT + r"\E", -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    learned = F.array_join(F.transform(F.filter("pieces", lambda p: p["loss"]), lambda p: unescape(p["text"])), "")
    return formatted.select("conv_id", "formatted", F.flatten(F.transform(parts, turns)).alias("turns"), learned.alias("loss_text"))
