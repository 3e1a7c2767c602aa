"""Window-shaped operators: line states, islands, jumps, packs, first-seen lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window
from pyspark.sql.types import LongType, StructField, StructType


def _lines(doc: str = "doc") -> Window:
    return Window.partitionBy(doc).orderBy("line")


def lines_of(docs: DataFrame, text: str = "text", doc: str = "doc") -> DataFrame:
    """(doc, line, body) with one row a line, from 0."""
    return docs.select(F.col(doc).alias("doc"), F.posexplode(F.split(text, "\n", -1)).alias("line", "body"))


def unfenced(lines: DataFrame) -> DataFrame:
    """Lines inside fences, and the marks, blanked; numbers stay. unclosed tells a fence that never ends."""
    mark = F.col("body").rlike(r"^\s*(```|~~~)").cast("int")
    marked = lines.withColumn("mark", mark)
    running = F.sum("mark").over(_lines().rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("mark").over(Window.partitionBy("doc"))
    inside = (running % 2 == 1) | (F.col("mark") == 1)
    return marked.select("doc", "line", F.when(inside, "").otherwise(F.col("body")).alias("body"), (whole % 2 == 1).alias("unclosed"))


def headed(lines: DataFrame) -> DataFrame:
    """Each line's current heading and its level."""
    is_head = F.col("body").rlike("^#{1,6}\\s")
    title = F.when(is_head, F.trim(F.regexp_replace("body", "^#+", "")))
    level = F.when(is_head, F.length(F.regexp_extract("body", "^(#+)", 1)))
    back = _lines().rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("heading", F.last(title, True).over(back)).withColumn("level", F.last(level, True).over(back))


def section(lines: DataFrame, name: str) -> DataFrame:
    """The lines of a section, to the next heading of the same or a higher level."""
    depth = F.length(F.regexp_extract("body", "^(#+)\\s", 1))
    title = F.trim(F.regexp_replace("body", "^#+", ""))
    opens = (depth > 0) & (title == name)
    back = _lines().rowsBetween(Window.unboundedPreceding, 0)
    at = lines.withColumn("depth", depth).withColumn("start", F.last(F.when(opens, F.col("line")), True).over(back)).withColumn("top", F.last(F.when(opens, F.col("depth")), True).over(back))
    shut = F.max(F.when((F.col("depth") > 0) & (F.col("depth") <= F.col("top")) & (F.col("line") > F.col("start")), 1)).over(Window.partitionBy("doc", "start").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    return at.withColumn("shut", shut).where("start IS NOT NULL AND line > start AND shut IS NULL").select("doc", "line", "body")


def islands(lines: DataFrame, belongs: Column, name: str = "run", dense: bool = False) -> DataFrame:
    """Consecutive lines that belong, with a run number. dense: no line number is left out, so only the lines
    that belong are shuffled, and a gap between them parts two runs."""
    if dense:
        start = F.coalesce(F.lag("line").over(_lines()) < F.col("line") - 1, F.lit(True)).cast("int")
        return lines.where(belongs).withColumn("_start", start).withColumn(name, F.sum("_start").over(_lines())).drop("_start")
    flagged = lines.withColumn("_in", belongs)
    before = F.lag("_in").over(_lines())
    start = (F.col("_in") & ~F.coalesce(before, F.lit(False))).cast("int")
    return flagged.withColumn("_start", start).withColumn(name, F.sum("_start").over(_lines())).where("_in").drop("_in", "_start")


def is_row(body: Column) -> Column:
    """A table's line."""
    return body.rlike(r"^\s*\|.*\|\s*$")


def is_separator(body: Column) -> Column:
    """M8: a header separator has three or more dashes in every cell."""
    return body.rlike(r"^\s*\|(\s*:?-{3,}:?\s*\|)+\s*$")


def row_width(body: Column) -> Column:
    """Cells of a table's line; escaped pipes part nothing."""
    return F.regexp_count(F.regexp_replace(body, r"\\\|", ""), F.lit(r"\|")) - 1


def row_cells(body: Column) -> Column:
    """A table line's cells, trimmed, with escaped pipes as pipes."""
    inner = F.regexp_replace(F.trim(body), r"^\||\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|", -1), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))


def blocks(lines: DataFrame) -> DataFrame:
    """Text blocks: paragraphs, and each table row, list item and footnote definition alone; (doc, first, text)."""
    blank = F.trim("body") == ""
    starts = is_row(F.col("body")) | F.col("body").rlike(r"^\s*([-*+]|[0-9]+[.)])\s") | F.col("body").rlike(r"^\[\^[^\]]+\]:") | F.col("body").rlike("^#{1,6}\\s")
    before = F.lag("body").over(_lines())
    fresh = starts | F.coalesce(F.trim(before) == "", F.lit(True)) | is_row(F.coalesce(before, F.lit(""))) | F.coalesce(before, F.lit("")).rlike("^#{1,6}\\s")
    numbered = lines.where("body IS NOT NULL").withColumn("_fresh", (~blank & fresh).cast("int")).withColumn("_block", F.sum("_fresh").over(_lines()))
    rows = numbered.where(~blank).groupBy("doc", "_block").agg(F.min("line").alias("first"), F.sort_array(F.collect_list(F.struct("line", "body"))).alias("rows"))
    return rows.select("doc", "first", F.array_join(F.transform("rows", lambda r: F.trim(r["body"])), " ").alias("text"))


def _kinds(body: Column) -> dict[str, Column]:
    item = body.rlike(r"^\s*([-*+]|[0-9]+[.)])\s")
    note = body.rlike(r"^\[\^[^\]]+\]:")
    row, head, blank = is_row(body), body.rlike("^#{1,6}\\s"), F.trim(body) == ""
    prose = ~(item | note | row | head | blank | body.rlike(r"^\s*(>|```|~~~|<|---)") | body.rlike(r"^\s{2,}\S"))
    return {"item": item, "note": note, "row": row, "prose": prose, "head": head}


def pair_rules(lines: DataFrame) -> DataFrame:
    """Where two adjacent lines lack a blank between them; (doc, line, rule), line being the second's.

    runon: prose under prose; under_item: prose under a list item; under_note: prose
    under a footnote definition; note_under: a definition under prose; under_table:
    prose under a table row; row_under: a table row under prose.
    """
    here = _kinds(F.col("body"))
    flagged = lines.select("doc", "line", "body", *(c.alias(k) for k, c in here.items()))
    w = _lines()
    was = {k: F.coalesce(F.lag(k).over(w), F.lit(False)) for k in here}
    rule = (
        F.when(F.col("prose") & was["prose"], "runon")
        .when(F.col("prose") & was["item"], "under_item")
        .when(F.col("prose") & was["note"], "under_note")
        .when(F.col("note") & was["prose"], "note_under")
        .when(F.col("prose") & was["row"], "under_table")
        .when(F.col("row") & was["prose"], "row_under")
    )
    return flagged.withColumn("rule", rule).where("rule IS NOT NULL").select("doc", "line", "rule")


def separated(docs: DataFrame) -> DataFrame:
    """Texts (doc, text) with a blank line wherever a pair rule fires."""
    lines = lines_of(docs)
    flags = pair_rules(unfenced(lines).select("doc", "line", "body")).select("doc", "line", F.lit(True).alias("gap"))
    joined = lines.join(flags, ["doc", "line"], "left")
    body = F.when(F.col("gap"), F.concat(F.lit("\n"), F.col("body"))).otherwise(F.col("body"))
    return joined.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("line", body.alias("body")))).alias("rows")).select("doc", F.array_join(F.transform("rows", lambda r: r["body"]), "\n").alias("text"))


def partial_date(text: Column) -> Column:
    """M: struct(y, m, d) of the first ISO-like date in a text, 0 where unstated; null without a year."""
    got = lambda k: F.regexp_extract(text, r"\b([0-9]{4})(?:-([0-9]{2}))?(?:-([0-9]{2}))?\b", k)
    return F.when(got(1) != "", F.struct(got(1).cast("int").alias("y"), F.coalesce(F.when(got(2) != "", got(2).cast("int")), F.lit(0)).alias("m"), F.coalesce(F.when(got(3) != "", got(3).cast("int")), F.lit(0)).alias("d")))


def _before(a: Column, b: Column) -> Column:
    """Whether date a comes before b in the precision that both state."""
    day = (a["d"] > 0) & (b["d"] > 0)
    month = (a["m"] > 0) & (b["m"] > 0)
    return (a["y"] < b["y"]) | ((a["y"] == b["y"]) & month & ((a["m"] < b["m"]) | ((a["m"] == b["m"]) & day & (a["d"] < b["d"]))))


def date_jumps(rows: DataFrame, table: str = "tbl", text: str = "cell") -> DataFrame:
    """Rows (tbl, line, cell) of a date table that step back; undated rows carry the date above."""
    w = Window.partitionBy(table).orderBy("line")
    keyed = rows.withColumn("key", partial_date(F.col(text)))
    carried = keyed.withColumn("key", F.last("key", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return carried.withColumn("above", F.lag("key").over(w)).where(_before(F.col("key"), F.col("above"))).drop("above")


def lone_strays(rows: DataFrame, group: str = "tbl", value: str = "v") -> DataFrame:
    """Rows that dip or spike alone in an otherwise ascending run."""
    w = Window.partitionBy(group).orderBy("line")
    near = rows.withColumn("_a", F.lag(value).over(w)).withColumn("_b", F.lead(value).over(w))
    dip = (F.col(value) < F.col("_a")) & (F.col("_a") <= F.col("_b"))
    spike = (F.col(value) > F.col("_b")) & (F.col("_a") <= F.col("_b"))
    return near.where(dip | spike).drop("_a", "_b")


def batches(rows: DataFrame, order: list[str], size: int = 50, group: list[str] | None = None) -> DataFrame:
    """Batch numbers of `size` rows in order, within the group."""
    w = (Window.partitionBy(*group) if group else Window).orderBy(*order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def packs(rows: DataFrame, group: str, order: str, size: str, most: int) -> DataFrame:
    """Pack numbers; a new pack begins where the bytes would exceed `most`. A group's rows stream through one
    task in order, which holds only the running pack."""
    sized = rows.select(group, order, F.col(size).cast("long").alias(size))

    def numbered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, pack, held = object(), 0, 0
        for frame in frames:
            out = []
            for key, n in zip(frame[group], frame[size], strict=True):
                if key != now:
                    now, pack, held = key, 0, 0
                elif held and held + n > most:
                    pack, held = pack + 1, 0
                held += n
                out.append(pack)
            yield frame.assign(pack=out)

    return sized.repartition(group).sortWithinPartitions(group, order).mapInPandas(numbered, StructType([*sized.schema.fields, StructField("pack", LongType())]))


def line_novelty(docs: DataFrame, least: int = 1) -> DataFrame:
    """(doc, novel, carried, blank) lines in order of doc: a line belongs to the first place it is seen at, also within a document."""
    lines = lines_of(docs).withColumn("key", F.md5(F.trim("body")))
    full = lines.where(F.length(F.trim("body")) >= least)
    owner = full.groupBy("key").agg(F.min(F.struct("doc", "line")).alias("first"))
    marked = full.join(owner, "key").withColumn("novel", (F.col("first.doc") == F.col("doc")) & (F.col("first.line") == F.col("line")))
    counted = marked.groupBy("doc").agg(
        F.sum(F.col("novel").cast("long")).alias("novel"), F.sum((~F.col("novel")).cast("long")).alias("carried"), F.sum(F.when(~F.col("novel"), F.octet_length("body")).otherwise(0)).alias("bytes_saved")
    )
    every = docs.select("doc").distinct()
    return every.join(counted, "doc", "left").na.fill(0)


def collapsed(docs: DataFrame, least_novel: int = 60) -> DataFrame:
    """Texts with runs of carried lines collapsed to a note of their number and first place; a page with few
    novel characters keeps all."""
    lines = lines_of(docs).withColumn("key", F.md5(F.trim("body")))
    owner = lines.where(F.trim("body") != "").groupBy("key").agg(F.min(F.struct("doc", "line")).alias("first"))
    marked = lines.join(owner, "key", "left").withColumn("carried", F.col("first").isNotNull() & ((F.col("first.doc") != F.col("doc")) | (F.col("first.line") != F.col("line"))))
    w = _lines()
    start = F.col("carried") & ~F.coalesce(F.lag("carried").over(w), F.lit(False))
    run = marked.withColumn("_s", start.cast("int")).withColumn("_run", F.sum("_s").over(w)).withColumn("_n", F.sum(F.col("carried").cast("int")).over(Window.partitionBy("doc", "_run")))
    novel = F.sum(F.when(~F.col("carried"), F.length(F.trim("body"))).otherwise(0)).over(Window.partitionBy("doc"))
    run = run.withColumn("_whole", novel < least_novel)
    note = F.concat(F.lit("[+"), F.col("_n").cast("string"), F.lit(" lines carried, first in "), F.col("first.doc").cast("string"), F.lit("]"))
    kept = run.where(F.col("_whole") | ~F.col("carried") | (F.col("_s") == 1)).withColumn("body", F.when(~F.col("_whole") & F.col("carried"), note).otherwise(F.col("body")))
    return kept.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("line", "body"))).alias("rows")).select("doc", F.array_join(F.transform("rows", lambda r: r["body"]), "\n").alias("text"))


def newest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def sorted_insert(listed: DataFrame, added: DataFrame) -> DataFrame:
    """Entries (grp, position, title) with new ones placed by title where the group is already sorted, else at its end."""
    w = Window.partitionBy("grp").orderBy("position")
    ok = listed.withColumn("ok", F.coalesce(F.lag("title").over(w) <= F.col("title"), F.lit(True))).groupBy("grp").agg(F.min("ok").alias("is_sorted"), F.max("position").alias("last"))
    old = listed.join(ok, "grp").select("grp", "title", "is_sorted", F.col("position").alias("place"))
    new = added.join(ok, "grp").select("grp", "title", "is_sorted", (F.col("last") + 1).alias("place"))
    both = old.unionByName(new)
    order = Window.partitionBy("grp").orderBy(F.when(F.col("is_sorted"), F.col("title")), "place", "title")
    return both.withColumn("position", F.row_number().over(order)).select("grp", "position", "title")


def read_set(links: DataFrame, changed: DataFrame, top: int, changed_only: bool = False) -> DataFrame:
    """Documents to read: the most linked (ties by name) and the changed, with reasons."""
    from lectern.operators.aggregates import inbound

    ranked = inbound(links).select(F.col("dst").alias("doc"), "n").orderBy(F.desc("n"), "doc").limit(top)
    why = changed.select("doc", F.lit("changed").alias("reason"))
    if not changed_only:
        why = why.unionByName(ranked.select("doc", F.lit("linked").alias("reason")))
    return why.groupBy("doc").agg(F.array_join(F.array_sort(F.collect_set("reason")), ", ").alias("reasons"))
