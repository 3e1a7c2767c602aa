"""Repairs of texts: pure functions from (doc, text) rows to new texts."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window
from pyspark.sql.types import StringType

from lectern.functions.fixed import CLOSED_STATES
from lectern.operators import windows as W

ONLY_NOTES = r"^\s*(\[\^[^\]]+\]\s*)+$"
END_NOTES = r"((?:\[\^[^\]]+\])+)\s*$"


def _joined(lines: DataFrame, key: list) -> DataFrame:
    """(doc, text) from lines in order of the key."""
    rows = lines.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct(*key, "body"))).alias("rows"))
    return rows.select("doc", F.array_join(F.transform("rows", lambda r: r["body"]), "\n").alias("text"))


def opens_row(body: Column) -> Column:
    """A row is a line that opens on a pipe, with a closing pipe or without."""
    return F.startswith(body, F.lit("|"))


def cell_count(body: Column) -> Column:
    """Cells of a row, with a closing pipe or without one."""
    plain = F.regexp_replace(F.regexp_replace(body, r"\\\|", ""), r"\s+$", "")
    return F.regexp_count(F.regexp_replace(plain, r"\|$", ""), F.lit(r"\|"))


def table_verdicts(lines: DataFrame) -> DataFrame:
    """What is wrong where a table row stands: (doc, line, verdict, home).

    blank: a header under prose, which a blank line mends; hoist: a row under prose
    that continues the nearest table above in its section, of the same width; held:
    a row under a list, a definition or an indented line, an indented row, or an
    orphan without a home; headerless: a table that opens on a data row.
    """
    w = Window.partitionBy("doc").orderBy("line")
    head = F.sum(F.startswith(F.col("body"), F.lit("#")).cast("int")).over(w)
    island = Window.partitionBy("doc", "part").orderBy("line")
    row = opens_row(F.col("body"))
    loose = F.startswith(F.ltrim("body"), F.lit("|"))
    marked = lines.withColumn("part", head).withColumn("width", cell_count(F.col("body"))).withColumn("above", F.coalesce(F.lag("body").over(w), F.lit(""))).withColumn("below", F.coalesce(F.lead("body").over(w), F.lit("")))
    back = island.rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumn("near", F.last(F.when(row, F.struct("line", "width")), True).over(back))
    separator = W.is_separator(F.col("below"))
    above = F.ltrim("above")
    prose = ~above.rlike(r"^([-*+]\s|[0-9]+[.)]\s|\[\^|>|#|\|)") & ~F.col("above").rlike(r"^\s")
    verdict = (
        F.when(~loose, None)
        .when(F.trim("above") == "", F.when(F.startswith(F.ltrim("below"), F.lit("|")) & ~separator, "headerless"))
        .when(above.rlike(r"^(\||#|>|```|~~~|<)"), None)
        .when(~prose | ~row, "held")
        .when(separator, "blank")
        .when(F.col("near.width") == F.col("width"), "hoist")
        .otherwise("held")
    )
    return marked.withColumn("verdict", verdict).withColumn("home", F.when(F.col("verdict") == "hoist", F.col("near.line"))).where("verdict IS NOT NULL").select("doc", "line", "verdict", "home")


def rejoined(docs: DataFrame) -> DataFrame:
    """Orphan runs of rows moved behind the table that they continue. A run's order key is its home's line, so
    nothing else moves; runs with the same home keep their order."""
    lines = W.lines_of(docs)
    plain = W.unfenced(lines).select("doc", "line", F.col("body").alias("plain"))
    verdicts = table_verdicts(plain.withColumnRenamed("plain", "body"))
    all_lines = lines.join(plain, ["doc", "line"]).join(verdicts.where("verdict = 'hoist'").select("doc", "line", F.lit(True).alias("orphan")), ["doc", "line"], "left")
    w = Window.partitionBy("doc").orderBy("line")
    row = opens_row(F.col("plain"))
    fresh = all_lines.withColumn("row", row).withColumn("fresh", (F.col("row") & ~F.coalesce(F.lag("row").over(w), F.lit(False))) | ~F.col("row")).withColumn("run", F.sum(F.col("fresh").cast("int")).over(w))
    moved = fresh.withColumn("moves", F.coalesce(F.bool_or(F.coalesce("orphan", F.lit(False)) & F.col("fresh")).over(Window.partitionBy("doc", "run")), F.lit(False)) & F.col("row"))
    home = F.last(F.when(F.col("row") & ~F.col("moves"), F.col("line")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    keyed = moved.withColumn("home", home).withColumn("k1", F.when(F.col("moves"), F.col("home")).otherwise(F.col("line"))).withColumn("k2", F.when(F.col("moves"), F.col("line")).otherwise(F.lit(-1)))
    return _joined(keyed, ["k1", "k2"])


def headers_once(docs: DataFrame) -> DataFrame:
    """Within a run of rows, a header equal to the run's current one goes with its separator; another header
    gets a blank line before it, which makes it a table of its own."""
    lines = W.lines_of(docs)
    plain = W.unfenced(lines).select("doc", "line", F.col("body").alias("plain"))
    w = Window.partitionBy("doc").orderBy("line")
    every = lines.join(plain, ["doc", "line"])
    row = opens_row(F.col("plain"))
    sep = W.is_separator(F.col("plain"))
    marked = every.withColumn("row", row).withColumn("sep", sep).withColumn("head", F.col("row") & F.coalesce(F.lead("sep").over(w), F.lit(False)))
    marked = marked.withColumn("run", F.sum((F.col("row") & ~F.coalesce(F.lag("row").over(w), F.lit(False))).cast("int")).over(w))
    inside = Window.partitionBy("doc", "run").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    known = F.last(F.when(F.col("head"), F.trim("plain")), True).over(inside)
    marked = marked.withColumn("known", F.when(F.col("row"), known))
    twice = F.col("head") & F.col("known").isNotNull() & (F.col("known") == F.trim("plain"))
    other = F.col("head") & F.col("known").isNotNull() & (F.col("known") != F.trim("plain"))
    marked = marked.withColumn("twice", twice).withColumn("drop", F.col("twice") | (F.col("sep") & F.coalesce(F.lag("twice").over(w), F.lit(False))))
    kept = marked.where("NOT drop").withColumn("body", F.when(other, F.concat(F.lit("\n"), F.col("body"))).otherwise(F.col("body")))
    return _joined(kept, ["line"])


def widths_mended(docs: DataFrame) -> DataFrame:
    """A row one cell too wide whose last cell is only footnotes is folded into the one before; a row one cell too
    narrow under a real header, ending in footnotes, gets them as a cell of their own."""
    lines = W.lines_of(docs)
    plain = W.unfenced(lines).select("doc", "line", F.col("body").alias("plain"))
    w = Window.partitionBy("doc").orderBy("line")
    every = lines.join(plain, ["doc", "line"]).withColumn("row", opens_row(F.col("plain")))
    every = every.withColumn("run", F.sum((F.col("row") & ~F.coalesce(F.lag("row").over(w), F.lit(False))).cast("int")).over(w))
    run = Window.partitionBy("doc", "run", "row").orderBy("line")
    every = every.withColumn("no", F.row_number().over(run)).withColumn("head", F.first("plain").over(run)).withColumn("second", F.max(F.when(F.col("no") == 2, W.is_separator(F.col("plain")))).over(Window.partitionBy("doc", "run", "row")))
    cells = W.row_cells(F.col("body"))
    width, want = cell_count(F.col("plain")), cell_count(F.col("head"))
    line = lambda c: F.concat(F.lit("| "), F.array_join(c, " | "), F.lit(" |"))
    last = F.element_at(cells, -1)
    folded = line(F.concat(F.slice(cells, F.lit(1), F.size(cells) - 2), F.array(F.concat(F.element_at(cells, F.size(cells) - 1), last))))
    split = line(F.concat(F.slice(cells, F.lit(1), F.size(cells) - 1), F.array(F.rtrim(F.regexp_replace(last, END_NOTES, "")), F.regexp_extract(last, END_NOTES, 1))))
    real = F.coalesce(F.col("second"), F.lit(False)) & ~W.row_cells(F.col("head"))[0].rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}")
    body_row = F.col("row") & (F.col("no") > 1) & ~W.is_separator(F.col("plain")) & F.endswith(F.rtrim("plain"), F.lit("|"))
    body = F.when(body_row & (width == want + 1) & (width > 1) & last.rlike(ONLY_NOTES), folded).when(body_row & real & (width == want - 1) & last.rlike(END_NOTES), split).otherwise(F.col("body"))
    return _joined(every.withColumn("body", body), ["line"])


def date_tables_sorted(docs: DataFrame) -> DataFrame:
    """Rows of tables headed Date in order of date; a row without one stays behind the row above it."""
    lines = W.lines_of(docs)
    w = Window.partitionBy("doc").orderBy("line")
    every = lines.withColumn("row", W.is_row(F.col("body"))).withColumn("run", F.sum((F.col("row") & ~F.coalesce(F.lag("row").over(w), F.lit(False))).cast("int")).over(w))
    run = Window.partitionBy("doc", "run", "row").orderBy("line")
    every = every.withColumn("no", F.row_number().over(run)).withColumn("head", F.lower(W.row_cells(F.first("body").over(run))[0])).withColumn("first", F.min("line").over(Window.partitionBy("doc", "run", "row")))
    dated = F.col("row") & (F.col("head") == "date") & (F.col("no") > 2)
    key = F.when(dated, W.partial_date(W.row_cells(F.col("body"))[0]))
    every = every.withColumn("dated", dated).withColumn("key", F.last(key, True).over(Window.partitionBy("doc", "run", "dated").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    place = F.when(F.col("dated"), F.col("first") + 2).otherwise(F.col("line"))
    zero = F.struct(F.lit(0).alias("y"), F.lit(0).alias("m"), F.lit(0).alias("d"))
    keyed = every.withColumn("k1", place).withColumn("k2", F.when(F.col("dated"), F.coalesce("key", zero)).otherwise(zero)).withColumn("k3", F.col("line"))
    return _joined(keyed, ["k1", "k2", "k3"])


def replaced(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """T4, T5: texts with each (doc, old, new) of the changes put in place, longest first."""
    by = changes.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct(F.length("old").alias("n"), "old", "new")), False).alias("edits"))
    fixed = F.aggregate("edits", F.col("text"), lambda t, e: F.replace(t, e["old"], e["new"]))
    return docs.join(by, "doc", "left").select("doc", F.when(F.col("edits").isNotNull(), fixed).otherwise(F.col("text")).alias("text"))


def closed_items(docs: DataFrame, states: tuple[str, ...] = CLOSED_STATES) -> DataFrame:
    """(doc, text, closed): five-cell rows in one of the states leave the text for the closed file, whose links
    go one folder further up."""
    lines = W.lines_of(docs)
    state = F.lower(F.regexp_replace(W.row_cells(F.col("body"))[3], "[*_~]", ""))
    gone = W.is_row(F.col("body")) & (W.row_width(F.col("body")) == 5) & F.regexp_extract(state, "^([a-z]+)", 1).isin(*states)
    marked = lines.withColumn("gone", F.coalesce(gone, F.lit(False)))
    stays = _joined(marked.where("NOT gone"), ["line"])
    moved = _joined(marked.where("gone").withColumn("body", F.regexp_replace("body", r"\]\((?!https?://|/|#)", "](../")), ["line"])
    return docs.select("doc").join(stays, "doc", "left").join(moved.withColumnRenamed("text", "closed"), "doc", "left").select("doc", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("closed", F.lit("")).alias("closed"))


def append_requests(text: DataFrame) -> DataFrame:
    """(writer, pos, target, kind, section, body) of APPEND blocks: `### APPEND path`, then `#### sources`, `#### section name` or `#### footnotes`."""
    blocks = text.select("writer", F.posexplode(F.split("text", r"(?m)^### APPEND ")).alias("pos", "block")).where("pos > 0")
    parts = blocks.select("writer", "pos", F.trim(F.split_part("block", F.lit("\n"), F.lit(1))).alias("target"), F.posexplode(F.split("block", r"(?m)^#### ")).alias("k", "part")).where("k > 0")
    head = F.trim(F.split_part("part", F.lit("\n"), F.lit(1)))
    return parts.select("writer", "pos", "k", "target", F.split_part(head, F.lit(" "), F.lit(1)).alias("kind"), F.trim(F.regexp_replace(head, r"^\S+", "")).alias("section"), F.trim(F.regexp_replace("part", r"^[^\n]*\n?", "")).alias("body"))


def _apply(pdf: pd.DataFrame) -> pd.DataFrame:
    """One target: requests in order of writer and place."""
    text = pdf["text"].iloc[0] or ""
    for r in pdf.sort_values(["writer", "pos", "k"]).itertuples():
        if r.kind == "section":
            at = re.search(rf"(?m)^#+\s+{re.escape(r.section)}\s*$", text)
            if at:
                after = re.search(r"(?m)^(#|\[\^[^\]]+\]:)", text[at.end() :])
                cut = at.end() + (after.start() if after else len(text) - at.end())
                text = text[:cut].rstrip("\n") + "\n\n" + r.body + "\n\n" + text[cut:]
            else:
                first = re.search(r"(?m)^\[\^[^\]]+\]:", text)
                cut = first.start() if first else len(text)
                text = text[:cut].rstrip("\n") + f"\n\n# {r.section}\n\n{r.body}\n\n" + text[cut:]
        elif r.kind == "footnotes":
            have = set(re.findall(r"(?m)^\[\^([^\]]+)\]:", text))
            fresh = [x for x in r.body.splitlines() if (m := re.match(r"\[\^([^\]]+)\]:", x)) and m.group(1) not in have]
            if fresh:
                text = text.rstrip("\n") + "\n" + "\n".join(fresh) + "\n"
        elif r.kind == "sources":
            have = set(re.findall(r"(?m)^\s*- id:\s*(\S+)", text))
            entries = [e for e in re.split(r"(?m)^(?=\s*- id:)", r.body) if (m := re.match(r"\s*- id:\s*(\S+)", e)) and m.group(1) not in have]
            block = re.search(r"(?m)^sources:\n(?:[ -].*\n)*", text)
            if entries and block:
                text = text[: block.end()] + "".join("  " + e.strip("\n") + "\n" for e in entries) + text[block.end() :]
    return pd.DataFrame({"doc": [pdf["doc"].iloc[0]], "text": [text]})


def appended(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """Targets with their requests applied in order: sources once by id, sections above the footnotes, footnotes once by label."""
    both = docs.join(requests.withColumnRenamed("target", "doc"), "doc")
    changed = both.groupBy("doc").applyInPandas(_apply, docs.select("doc", "text").schema)
    return docs.select("doc", "text").join(changed.select("doc"), "doc", "left_anti").unionByName(changed)


def index_text(entries: DataFrame) -> DataFrame:
    """(dir, text) of index entries (dir, position, title, target, gloss, action) without the dropped ones, never reordered."""
    body = F.concat(F.lit("- ["), F.col("title"), F.lit("]("), F.col("target"), F.lit(") - "), F.coalesce("gloss", F.lit("")))
    rows = entries.where("action <> 'drop'").select(F.col("dir").alias("doc"), F.coalesce("position", F.lit(1 << 30)).alias("line"), F.col("title").alias("t"), body.alias("body"))
    return _joined(rows, ["line", "t"]).withColumnRenamed("doc", "dir")


def _inline(t: str) -> str:
    t = html.escape(t, quote=False)
    t = re.sub(r"`([^`]+)`", r"<code>\1</code>", t)
    t = re.sub(r"\*\*([^*]+)\*\*", r"<strong>\1</strong>", t)
    t = re.sub(r"(?<!\*)\*([^*\s][^*]*)\*", r"<em>\1</em>", t)
    return re.sub(r"\[([^\]]+)\]\(((?:https?:|[\w./#-])[^)\s]*)\)", lambda m: f'<a href="{html.escape(m.group(2))}">{m.group(1)}</a>', t)


def _render(text: str | None) -> str | None:
    if text is None:
        return None
    out, para, items, code = [], [], [], None

    def flush() -> None:
        if para:
            out.append(f"<p>{_inline(' '.join(para))}</p>")
            para.clear()
        if items:
            out.append("<ul>" + "".join(f"<li>{_inline(i)}</li>" for i in items) + "</ul>")
            items.clear()

    for line in text.split("\n"):
        if line.startswith("```"):
            if code is None:
                flush()
                code = []
            else:
                out.append("<pre>" + html.escape("\n".join(code)) + "</pre>")
                code = None
        elif code is not None:
            code.append(line)
        elif m := re.match(r"(#{1,6})\s+(.*)", line):
            flush()
            out.append(f"<h{len(m.group(1))}>{_inline(m.group(2))}</h{len(m.group(1))}>")
        elif m := re.match(r"\s*[-*+]\s+(.*)", line):
            if para:
                flush()
            items.append(m.group(1))
        elif line.strip():
            if items:
                flush()
            para.append(line.strip())
        else:
            flush()
    flush()
    return "\n".join(out)


@F.pandas_udf(StringType())
def rendered(texts: pd.Series) -> pd.Series:
    """A body as HTML; nothing in a text becomes markup by itself."""
    return texts.map(_render)
