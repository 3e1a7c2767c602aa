"""Joins between documents, the pages they cite, and what is known of both.

Every function takes and gives DataFrames; the columns that it reads are named
in its docstring. Ids keep whatever type they come with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window


def unresolved(citations: DataFrame, files: DataFrame, key: str = "page") -> DataFrame:
    """Citations whose target isn't among the files."""
    return citations.join(files.select(key).distinct(), key, "left_anti")


def one_sided(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of left that right lacks (labels without a source, sources without a label)."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti")


def shared_source_pairs(cites: DataFrame, threshold: int = 3, doc: str = "concept", source: str = "page") -> DataFrame:
    """(a, b, overlap) of documents that share at least `threshold` sources.

    An inverted index joined with itself, so only documents with a common source
    meet. Sources cited once are dropped before the join, and documents with too
    few sources left can't reach the threshold.
    """
    edges = cites.select(F.col(doc).alias("doc"), F.col(source).alias("source")).distinct()
    shared = edges.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("source")
    edges = edges.join(shared, "source", "left_semi")
    able = edges.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= threshold).select("doc")
    edges = edges.join(able, "doc", "left_semi")
    pairs = edges.withColumnRenamed("doc", "a").join(edges.withColumnRenamed("doc", "b"), "source").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("overlap")).where(F.col("overlap") >= threshold)


def coupled(cites: DataFrame, fixed: DataFrame, threshold: int = 3, doc: str = "concept", source: str = "page") -> DataFrame:
    """Documents that share at least `threshold` sources with one of the fixed documents (column doc)."""
    edges = cites.select(F.col(doc).alias("doc"), F.col(source).alias("source")).distinct()
    one = edges.join(fixed.select(F.col(doc).alias("doc")).distinct(), "doc", "left_semi").withColumnRenamed("doc", "changed")
    both = one.join(edges, "source").where("changed <> doc")
    return both.groupBy("changed", "doc").agg(F.count(F.lit(1)).alias("overlap")).where(F.col("overlap") >= threshold)


def behind(changes: DataFrame, cites: DataFrame) -> DataFrame:
    """Citations (concept, page, written) older than the page's last change (page, changed)."""
    latest = changes.groupBy("page").agg(F.max("changed").alias("changed"))
    return cites.join(latest, "page").where("written < changed").select("page", "changed", "concept", "written")


def coverage(pages: DataFrame, cited: DataFrame, ledger: DataFrame) -> DataFrame:
    """Pages with a state: cited, else nil (read, nothing to cite), else open."""
    marked = pages.join(cited.select("page").distinct().withColumn("is_cited", F.lit(True)), "page", "left").join(
        ledger.select("page").distinct().withColumn("is_nil", F.lit(True)), "page", "left"
    )
    state = F.when(F.col("is_cited"), "cited").when(F.col("is_nil"), "nil").otherwise("open")
    return marked.withColumn("state", state).drop("is_cited", "is_nil")


def remap(old: DataFrame, new: DataFrame) -> DataFrame:
    """What became of each old page (path, body, strict, title, date) among the new ones, and which are new.

    Verdicts: SAME or EDITED under the old path (by the strict hash), MOVED to the
    only page with its body, or else with its title and date, AMBIGUOUS where
    several have, GONE, and NEW for unseen paths.
    """
    columns = ["path", "body", "strict", "title", "date"]
    o = old.select(*(F.col(c).alias(f"o_{c}") for c in columns))
    n = new.select(*columns)
    bodies = n.groupBy("body").agg(F.count(F.lit(1)).alias("n_body"), F.min("path").alias("body_path"))
    titles = n.where("title IS NOT NULL AND date IS NOT NULL").groupBy("title", "date").agg(F.count(F.lit(1)).alias("n_title"), F.min("path").alias("title_path"))
    here = n.select(F.col("path").alias("here"), F.col("body").alias("here_body"), F.col("strict").alias("here_strict"))
    rows = (
        o.join(bodies, o["o_body"] == bodies["body"], "left")
        .join(here, F.col("o_path") == F.col("here"), "left")
        .join(titles, (F.col("o_title") == titles["title"]) & (F.col("o_date") == titles["date"]), "left")
    )
    n_body, n_title = F.coalesce("n_body", F.lit(0)), F.coalesce("n_title", F.lit(0))
    stays = F.col("here").isNotNull() & ((n_body == 0) | (F.col("here_body") == F.col("o_body")))
    verdict = (
        F.when(stays, F.when(F.col("here_strict") == F.col("o_strict"), "SAME").otherwise("EDITED"))
        .when(n_body == 1, "MOVED")
        .when(n_body > 1, "AMBIGUOUS")
        .when(n_title == 1, "MOVED")
        .when(n_title > 1, "AMBIGUOUS")
        .otherwise("GONE")
    )
    target = F.when(stays, F.col("o_path")).when(n_body == 1, F.col("body_path")).when((n_body == 0) & (n_title == 1), F.col("title_path"))
    found = rows.select(F.col("o_path").alias("old_path"), verdict.alias("verdict"), target.alias("new_path"))
    seen = found.select(F.col("new_path").alias("path")).unionByName(found.select(F.col("old_path").alias("path"))).where("path IS NOT NULL").distinct()
    fresh = n.select("path").join(seen, "path", "left_anti")
    none = F.lit(None).cast(old.schema["path"].dataType)
    return found.unionByName(fresh.select(none.alias("old_path"), F.lit("NEW").alias("verdict"), F.col("path").alias("new_path")))


def swap_first(text: Column) -> Column:
    """The text with its first letter's case swapped."""
    first = F.substring(text, 1, 1)
    other = F.when(first == F.upper(first), F.lower(first)).otherwise(F.upper(first))
    return F.concat(other, F.substring(text, F.lit(2), F.length(text)))


def contained(part: Column, text: Column) -> Column:
    """Whether a text holds a part, give or take the case of its first letter."""
    return F.contains(text, part) | F.contains(text, swap_first(part))


def missing_quotes(quotes: DataFrame, cites: DataFrame, pages: DataFrame) -> DataFrame:
    """Quotations (block, parts array<string>) that no cited page (block, page) holds in all parts.

    pages: page, text; null text is a page that can't be read, and a block that
    cites one isn't judged. A block without any cited page isn't either.
    """
    cited = quotes.join(cites, "block").join(pages, "page", "left")
    holds = F.forall("parts", lambda p: contained(p, F.col("text")))
    judged = cited.groupBy("block").agg(F.bool_or(F.col("text").isNull()).alias("unread"), F.bool_or(F.coalesce(holds, F.lit(False))).alias("found"))
    return quotes.join(judged.where("NOT unread AND NOT found").select("block"), "block", "left_semi")


def without_fate(files: DataFrame, *known: DataFrame, key: str = "file") -> DataFrame:
    """Files that no known relation (each with the key) accounts for."""
    out = files
    for relation in known:
        out = out.join(relation.select(key).distinct(), key, "left_anti")
    return out


def misattributed(claims: DataFrame, actors: DataFrame) -> DataFrame:
    """Claims (claim, page, names array) whose names are none of the page's actors (page, names array)."""
    present = actors.select("page", F.col("names").alias("actor_names"))
    return claims.join(present, "page").where(~F.arrays_overlap("names", "actor_names")).drop("actor_names")


def passed_claims(claims: DataFrame, sources: DataFrame, today: str) -> DataFrame:
    """Claims (concept, text, period_end) older than the concept's newest source (concept, last_modified) up to today. Dates compare as strings."""
    newest = sources.where(F.col("last_modified") <= today).groupBy("concept").agg(F.max("last_modified").alias("newest_source"))
    return claims.join(newest, "concept").where("newest_source > period_end")


def unread(pages: DataFrame, *known: DataFrame) -> DataFrame:
    """Pages outside the union of the known relations (each with page)."""
    seen = known[0].select("page")
    for relation in known[1:]:
        seen = seen.unionByName(relation.select("page"))
    return pages.join(seen.distinct(), "page", "left_anti")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "path", value: str = "digest") -> DataFrame:
    """Key and ADDED, REMOVED or CHANGED between two snapshots."""
    a, b = old.select(key, F.col(value).alias("was")), new.select(key, F.col(value).alias("now"))
    a, b = a.withColumn("in_old", F.lit(True)), b.withColumn("in_new", F.lit(True))
    change = F.when(F.col("in_old").isNull(), "ADDED").when(F.col("in_new").isNull(), "REMOVED").when(~F.col("was").eqNullSafe(F.col("now")), "CHANGED")
    return a.join(b, key, "full_outer").withColumn("change", change).where("change IS NOT NULL").select(key, "change")


def cut_glosses(glosses: DataFrame, concepts: DataFrame, low: int = 100, high: int = 115) -> DataFrame:
    """Glosses (source, target, gloss) that are a strict prefix of the target's description and end within a word."""
    joined = glosses.join(concepts.select(F.col("concept").alias("target"), "description"), "target")
    n = F.length("gloss")
    within = F.substring("description", n, F.lit(2)).rlike(r"(?U)^\w\w$")
    return joined.where(n.between(low, high) & F.startswith(F.col("description"), F.col("gloss")) & (F.length("description") > n) & within)


def alias_hits(bodies: DataFrame, aliases: DataFrame) -> DataFrame:
    """(kb, person, doc, n) of aliases found as whole words in bodies of the same kb; aliases of other kbs don't count."""
    words = bodies.select("kb", "doc", F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower("body"), F.lit(r"((?U)\w+)"), 1), " "), F.lit(" ")).alias("line"))
    wanted = aliases.select("kb", "person", F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower("alias"), F.lit(r"((?U)\w+)"), 1), " "), F.lit(" ")).alias("needle"))
    hits = words.join(wanted, "kb").where(F.contains("line", "needle"))
    return hits.groupBy("kb", "person", "doc").agg(F.count(F.lit(1)).alias("n"))


def pair_packs(pairs: DataFrame, claims: DataFrame, keep: int = 3) -> DataFrame:
    """For each pair (a, b) and each side the first `keep` distinct claims (concept, page, line, claim) about pages that both cite."""
    shared = (
        pairs.join(claims.select(F.col("concept").alias("a"), "page").distinct(), "a")
        .join(claims.select(F.col("concept").alias("b"), "page").distinct(), ["b", "page"])
        .select("a", "b", "page")
    )
    sides = shared.select("a", "b", "page", F.explode(F.array("a", "b")).alias("concept"))
    said = sides.join(claims, ["concept", "page"]).groupBy("a", "b", "page", "concept", "claim").agg(F.min("line").alias("line"))
    order = Window.partitionBy("a", "b", "page", "concept").orderBy("line", "claim")
    return said.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def reanchor(citations: DataFrame, files: DataFrame, moves: DataFrame, depth: int = 7) -> DataFrame:
    """A file for each citation (cite, directory, resource): by the least number of `../` that resolves, else by the move
    chain (old, new), else by a base name that only one file has. how: depth, move, name or null."""
    probes = citations.withColumn("up", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    parts = F.filter(F.split("directory", "/"), lambda p: p != "")
    base = F.when(F.size(parts) >= F.col("up"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - F.col("up")), "/"))
    plain = F.regexp_replace("resource", r"^(\.\./)*", "")
    probes = probes.withColumn("path", F.when(base == "", plain).otherwise(F.concat(base, F.lit("/"), plain)))
    by_depth = probes.join(files.select("path"), "path").groupBy("cite").agg(F.min_by("path", "up").alias("by_depth"))
    by_move = probes.join(moves.select(F.col("old").alias("path"), "new"), "path").groupBy("cite").agg(F.min_by("new", "up").alias("by_move"))
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    names = files.groupBy(name("path").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("by_name")).where("n = 1").drop("n")
    out = citations.join(by_depth, "cite", "left").join(by_move, "cite", "left").withColumn("name", name(F.col("resource"))).join(names, "name", "left")
    how = F.when(F.col("by_depth").isNotNull(), "depth").when(F.col("by_move").isNotNull(), "move").when(F.col("by_name").isNotNull(), "name")
    return out.select("cite", F.coalesce("by_depth", "by_move", "by_name").alias("path"), how.alias("how"))


def lost_writes(writes: DataFrame) -> DataFrame:
    """Targets (writer, target) that more than one writer claims."""
    by = writes.groupBy("target").agg(F.sort_array(F.collect_set("writer")).alias("writers"))
    return by.where(F.size("writers") > 1)


def within(reports: DataFrame, frozen: DataFrame) -> DataFrame:
    """Reports (report, scope array<string>) whose whole scope is frozen (kb)."""
    inside = reports.select("report", F.explode("scope").alias("kb")).join(frozen.select("kb").distinct().withColumn("is_frozen", F.lit(True)), "kb", "left")
    return inside.groupBy("report").agg(F.bool_and(F.coalesce("is_frozen", F.lit(False))).alias("ok")).where("ok").select("report")


def standing_questions(listed: DataFrame, bullets: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listed questions (kb, kind, text) that still stand (exact bullet text, or a row's prefix), and unsorted counts by kb."""
    exact = listed.where("kind = 'bullet'").join(bullets.select("kb", "text").distinct(), ["kb", "text"], "left_semi")
    head = listed.where("kind = 'row'")
    prefix = head.join(rows.select("kb", F.col("text").alias("row")), "kb").where(F.startswith(F.col("row"), F.col("text"))).select(*listed.columns).distinct()
    unsorted = bullets.join(listed.where("kind = 'bullet'").select("kb", "text"), ["kb", "text"], "left_anti").groupBy("kb").agg(F.count(F.lit(1)).alias("unsorted"))
    return exact.select(*listed.columns).unionByName(prefix), unsorted


def unmeasured(citations: DataFrame, files: DataFrame, pages: DataFrame) -> DataFrame:
    """Cited pages that exist as files yet aren't in the page set; a caller fails loudly if there are any."""
    return citations.select("page").distinct().join(files.select("page").distinct(), "page", "left_semi").join(pages.select("page").distinct(), "page", "left_anti")


def guard_empty(rows: DataFrame, message: str) -> DataFrame:
    """A single true, or a failing job if there are rows."""
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.assert_true(F.col("n") == 0, F.concat(F.lit(message + ": "), F.col("n").cast("string"))).alias("checked"), F.lit(True).alias("ok")).select("ok")


def stale_split(concepts: DataFrame, day: str, ahead: int = 30, inclusive: bool = False) -> DataFrame:
    """Concepts (concept, stale_after) past the day, or within `ahead` days of it. Dates compare as strings; by
    default a date of the day itself isn't past (inclusive turns that)."""
    last = F.date_format(F.date_add(F.to_date(F.lit(day)), ahead), "yyyy-MM-dd")
    past = F.col("stale_after") <= day if inclusive else F.col("stale_after") < day
    when = F.when(past, "past").when(F.col("stale_after") <= last, "soon")
    return concepts.where("stale_after IS NOT NULL").withColumn("when", when).where("when IS NOT NULL").select("concept", "stale_after", "when")


def on_topic(items: DataFrame, topic: str, states: tuple[str, ...] = ("open", "deferred")) -> DataFrame:
    """Items (id, item, state) in one of the states that hold every word of the topic."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9]+)"), 1))
    return items.where(F.col("state").isin(*states) & (F.size(F.array_except(words(F.lit(topic)), words(F.col("item")))) == 0))


def listed_against_directory(listed: DataFrame, concepts: DataFrame) -> DataFrame:
    """Index entries (position, target, gloss) beside concepts (target, title, description): keep, refresh, add or drop."""
    a = listed.select("target", "position", "gloss")
    b = concepts.select("target", "title", "description").withColumn("there", F.lit(True))
    action = F.when(F.col("there").isNull(), "drop").when(F.col("position").isNull(), "add").when(~F.col("gloss").eqNullSafe(F.col("description")), "refresh").otherwise("keep")
    return a.join(b, "target", "full_outer").select("target", "position", action.alias("action"), F.coalesce("description", "gloss").alias("gloss"), "title")
