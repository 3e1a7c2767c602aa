"""Writers of small reports and of tables. Reports are rows first; only what a file holds is collected."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, functions as F

from lectern.functions import text as T
from lectern.operators import aggregates as A, windows as W


def coverage_lines(tables: DataFrame) -> DataFrame:
    """K1: (kb, line, text) of the coverage report of A1's table: most pages first, then names."""
    percent = F.format_number("percent", 1)
    row = F.concat(F.lit("| "), F.concat_ws(" | ", F.coalesce("chapter", F.lit("*all*")), F.coalesce("scope", F.lit("*all*")), T.thousands(F.col("pages")), T.thousands(F.col("cited")), T.thousands(F.col("nil")), F.concat(percent, F.lit(" %"))), F.lit(" |"))
    from pyspark.sql import Window

    order = Window.partitionBy("kb").orderBy(F.when(F.col("level") == "kb", 0).when(F.col("level") == "chapter", 1).otherwise(2), F.desc("pages"), "chapter", "scope")
    return tables.select("kb", F.row_number().over(order).alias("line"), row.alias("text"))


def write_report(lines: DataFrame, kb: str, path: str, heading: str) -> bool:
    """K1: write one kb's lines if they differ from the file's, its first (stamp) line aside; whether it was written."""
    rows = [r["text"] for r in lines.where(F.col("kb") == kb).orderBy("line").select("text").toLocalIterator()]
    target = Path(path)
    if target.exists() and target.read_text(encoding="utf-8").split("\n")[1:] == [*rows, ""]:
        return False
    target.write_text("\n".join([heading, *rows, ""]), encoding="utf-8")
    return True


def write_tsv(rows: DataFrame, path: str) -> None:
    """Tab-separated with a header."""
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def read_tsv(spark, path: str, schema: str) -> DataFrame:
    """Tab-separated with a header, by a given schema."""
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line."""
    rows.write.mode("overwrite").json(path)


def action_roll_up(items: DataFrame) -> DataFrame:
    """K5: items by kb and state, and each open item's age order."""
    return A.items_by_state(items)


def concept_inventory(concepts: DataFrame, most: int = 140) -> DataFrame:
    """K7: (kb, line) of each concept: path, title and the start of its description."""
    cut = F.when(F.length("description") > most, F.concat(F.rtrim(F.left("description", F.lit(most - 1))), F.lit("…"))).otherwise(F.col("description"))
    return concepts.select("kb", F.concat_ws("\t", "path", "title", cut).alias("line"))


def attachment_register(registers: DataFrame) -> DataFrame:
    """K8: (kb, name, note) of the bullets of registers' Attachments sections, sorted by name."""
    lines = W.section(W.lines_of(registers.select(F.col("kb").alias("doc"), "text")), "Attachments")
    parts = lines.where(F.col("body").rlike(r"^\s*[-*]\s+`")).select(F.col("doc").alias("kb"), F.regexp_extract("body", r"`([^`]+)`", 1).alias("name"), F.trim(F.regexp_replace("body", r"^\s*[-*]\s+`[^`]+`\s*[-–—:]?", "")).alias("note"))
    return parts.orderBy("kb", "name")


def reading_blocks(concepts: DataFrame, size: int = 50) -> DataFrame:
    """K9: concepts in reading order (most linked, most sources, title) in blocks of 50."""
    return W.batches(concepts.withColumn("a", -F.col("inbound")).withColumn("b", -F.col("n_sources")), ["a", "b", "title"], size, ["kb"]).drop("a", "b")


def batch_plan(pages: DataFrame, size: int = 55) -> DataFrame:
    """(id, scope, n) of batches of unread pages by scope; ids are the scope's slug and a number."""
    cut = W.batches(pages.select("scope", "page"), ["page"], size, ["scope"])
    return cut.groupBy("scope", "batch").agg(F.count(F.lit(1)).alias("n")).select(F.concat_ws("-", T.slug(F.col("scope")), (F.col("batch") + 1).cast("string")).alias("id"), "scope", "n")
