"""Aggregations over pages, findings, items and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

from lectern.functions.fixed import ITEM_STATES


def coverage_table(marked: DataFrame) -> DataFrame:
    """A1: pages, cited, nil and percent by (kb, chapter, scope), (kb, chapter) and kb; level names the grouping."""
    counts = marked.groupBy("kb", "chapter", "scope", "state").agg(F.count(F.lit(1)).alias("n"))
    sets = counts.groupingSets([["kb", "chapter", "scope"], ["kb", "chapter"], ["kb"]], "kb", "chapter", "scope").agg(
        F.sum("n").alias("pages"),
        F.sum(F.when(F.col("state") == "cited", F.col("n")).otherwise(0)).alias("cited"),
        F.sum(F.when(F.col("state") == "nil", F.col("n")).otherwise(0)).alias("nil"),
        F.grouping_id().alias("level"),
    )
    names = F.when(F.col("level") == 0, "scope").when(F.col("level") == 1, "chapter").otherwise("kb")
    return sets.select("kb", "chapter", "scope", names.alias("level"), "pages", "cited", "nil", (100.0 * (F.col("cited") + F.col("nil")) / F.col("pages")).alias("percent"))


def coverage_state(marked: DataFrame, concepts: DataFrame, citations: DataFrame) -> DataFrame:
    """The struct whose change makes a coverage report stale, by kb."""
    p = marked.groupBy("kb").agg(
        F.count(F.lit(1)).alias("pages"), F.sum(F.when(F.col("is_mirror"), 1).otherwise(0)).alias("mirror_pages"), F.sum(F.when(F.col("state") == "cited", 1).otherwise(0)).alias("covered")
    )
    c = concepts.groupBy("kb").agg(F.count(F.lit(1)).alias("concepts"))
    n = citations.groupBy("kb").agg(F.count(F.lit(1)).alias("citations"))
    return c.join(n, "kb", "left").join(p, "kb", "left").na.fill(0)


def duplicate_groups(fingerprints: DataFrame, least_chars: int = 40) -> DataFrame:
    """A3: (body_md5, n, paths) of pages with equal bodies; thin pages don't count.

    The list of a group is as long as the group; `copies` counts without it.
    """
    groups = copies(fingerprints, least_chars)
    return fingerprints.join(groups.select("body_md5"), "body_md5", "left_semi").groupBy("body_md5").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("path")).alias("paths"))


def copies(fingerprints: DataFrame, least_chars: int = 40) -> DataFrame:
    """A3: (body_md5, n, first_path) of pages with equal bodies."""
    return fingerprints.where(F.col("chars") >= least_chars).groupBy("body_md5").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path")).where("n > 1")


def inbound(links: DataFrame, self_links: bool = False) -> DataFrame:
    """A4: how many links (src, dst) reach each target, repeats counted; self-links count only where asked."""
    rows = links if self_links else links.where("src <> dst")
    return rows.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))


def name_counts(hits: DataFrame) -> DataFrame:
    """Pages by person and name family, and the union over families, of hits (person, family, page)."""
    by = hits.groupBy("person", "family").agg(F.countDistinct("page").alias("pages"))
    union = hits.groupBy("person").agg(F.countDistinct("page").alias("pages")).select("person", F.lit("union").alias("family"), "pages")
    return by.unionByName(union)


def calibration(counts: DataFrame) -> DataFrame:
    """Median and p90 of union / full over people; p90 is the element max(1, floor(.9 n)) of the sorted ratios."""
    wide = counts.groupBy("person").pivot("family", ["full", "union"]).agg(F.first("pages")).where("full > 0")
    ratios = wide.select((F.col("union") / F.col("full")).alias("ratio"))
    n = ratios.count()
    place = max(1, int(n * 0.9))
    ranked = ratios.withColumn("rank", F.row_number().over(Window.orderBy("ratio")))
    return ranked.agg(F.median("ratio").alias("median"), F.max(F.when(F.col("rank") == place, F.col("ratio"))).alias("p90"), F.count(F.lit(1)).alias("people"))


def split_values(citations: DataFrame, value: str, key: str = "page") -> DataFrame:
    """Keys cited with several values, the most first."""
    by = citations.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("values"))
    return by.where(F.size("values") > 1).select(key, F.size("values").cast("long").alias("n"), "values").orderBy(F.desc("n"), key)


def shapes(findings: DataFrame) -> DataFrame:
    """Findings by the shape of their message: quoted parts and numbers out."""
    shape = F.regexp_replace(F.regexp_replace("message", r"'[^']*'|\"[^\"]*\"|`[^`]*`", "…"), r"[0-9]+", "N")
    return findings.groupBy(shape.alias("shape")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "shape")


def item_state(state, known=ITEM_STATES):
    """A10: the state without decoration, or null if it is none of the known ones."""
    plain = F.lower(F.trim(F.regexp_replace(state, r"[*_~`]", "")))
    first = F.regexp_extract(plain, r"^([a-z]+)", 1)
    return F.when(first.isin(*known), first)


def items_by_state(items: DataFrame, states: tuple[str, ...] = ITEM_STATES, group: str = "kb", state: str = "state") -> DataFrame:
    """A10, K5: counts by group, one column a state; a state that is none of them stops the query, so that no item is lost."""
    known = F.when(F.col(state).isin(*states), F.col(state)).otherwise(F.raise_error(F.concat(F.lit("unknown state of an item: "), F.coalesce(F.col(state), F.lit("none")))))
    return items.withColumn(state, known).groupBy(group).pivot(state, list(states)).agg(F.count(F.lit(1))).na.fill(0, list(states))


def item_ages(items: DataFrame, day: str, raised: str = "raised") -> DataFrame:
    """Items with their age in days on a day, oldest first; those without a date last."""
    return items.withColumn("age", F.datediff(F.lit(day).cast("date"), F.try_to_date(raised, "yyyy-MM-dd"))).orderBy(F.col("age").desc_nulls_last())


def queue_lengths(wide: DataFrame, queues: list[str], held_back: tuple[str, ...] = ()) -> DataFrame:
    """One row for each kb and queue, and the total without the queues held back."""
    stack = ", ".join(f"'{q}', `{q}`" for q in queues)
    rows = wide.selectExpr("kb", f"stack({len(queues)}, {stack}) AS (queue, n)")
    total = rows.where(~F.col("queue").isin(*held_back) if held_back else F.lit(True)).groupBy("kb").agg(F.sum("n").alias("n")).select("kb", F.lit("total").alias("queue"), "n")
    return rows.unionByName(total)


def most_common(rows: DataFrame, group: str, value: str, position: str) -> DataFrame:
    """Each group's most frequent value; ties to the one seen first."""
    counts = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first"))
    return counts.groupBy(group).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value), F.max("n").alias("n"))


def postings(tokens: DataFrame) -> DataFrame:
    """(word, doc, tf) from (doc, word) rows."""
    return tokens.groupBy("word", "doc").agg(F.count(F.lit(1)).alias("tf"))


def group_links(links: DataFrame, groups: DataFrame, least: int = 10) -> DataFrame:
    """Links between different groups (doc, grp), by unordered pair, at least `least`, most first."""
    a, b = groups.select(F.col("doc").alias("src"), F.col("grp").alias("ga")), groups.select(F.col("doc").alias("dst"), F.col("grp").alias("gb"))
    both = links.join(a, "src").join(b, "dst").where("ga <> gb")
    return both.groupBy(F.least("ga", "gb").alias("one"), F.greatest("ga", "gb").alias("other")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "one", "other")


def read_arithmetic(all_docs: DataFrame, read: DataFrame) -> DataFrame:
    """How many were scanned, read, and not read."""
    n = all_docs.join(read.select("doc").distinct().withColumn("is_read", F.lit(True)), "doc", "left")
    return n.agg(F.count(F.lit(1)).alias("scanned"), F.count("is_read").alias("read"), (F.count(F.lit(1)) - F.count("is_read")).alias("unread"))


def first_seen(sources: DataFrame) -> DataFrame:
    """Each concept's oldest dated source, also as a day number of 372-day years."""
    y, m, d = (F.substring("last_modified", a, n).cast("int") for a, n in ((1, 4), (6, 2), (9, 2)))
    day = y * 372 + F.coalesce(m, F.lit(1)) * 31 + F.coalesce(d, F.lit(1))
    dated = sources.where(F.col("last_modified").rlike(r"^[0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?$"))
    return dated.groupBy("concept").agg(F.min("last_modified").alias("born"), F.min(day).alias("born_day"))


def largest_scope(marked: DataFrame) -> DataFrame:
    """Each kb's scope with the most uncited pages; ties by name."""
    by = marked.where("state = 'open'").groupBy("kb", "scope").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("kb").agg(F.min_by("scope", F.struct(-F.col("n"), F.col("scope"))).alias("scope"), F.max("n").alias("n"))


def repeated_questions(questions: DataFrame) -> DataFrame:
    """Questions asked more than once, by their words."""
    norm = F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(r"((?U)\w+)"), 1), " ")
    return questions.withColumn("norm", norm).where("norm <> ''").groupBy("norm").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1")


def caught_by(defects: DataFrame) -> DataFrame:
    """Defects (day string, class, by) by quarter, class and who caught them."""
    quarter = F.concat(F.substring("day", 1, 4), F.lit("-Q"), F.ceil(F.substring("day", 6, 2).cast("int") / 3).cast("string"))
    return defects.groupBy(quarter.alias("quarter"), "class", "by").agg(F.count(F.lit(1)).alias("n"))
