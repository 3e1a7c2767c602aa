"""Composite queries over a vault: name scan, stale claims, attribution, remap, queues, dashboard, tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions import fixed as X, text as T
from lectern.operators import aggregates as A, graph as G, joins as J, search as R, state as S, windows as W
from lectern.plans import audit
from lectern.sources.vault import Vault, page_changes

def fingerprints(pages: DataFrame) -> DataFrame:
    """Q4: path, body_md5, strict_md5, chars, bytes, title, date, head_md5 of pages (kb, path, title, created, body):
    images and their marks, assets, links' targets, addresses and identifiers out, spaces folded; a page with too
    little text left has no body_md5. The strict form only folds spaces."""
    fold = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    plain = F.col("body")
    for pattern, put in (
        (r"!\[[^\]]*\]\([^)]*\)", ""),
        (r"🖼\s*image:\s*`[^`]*`", ""),
        (r"_assets/\S+", ""),
        (r"\[([^\]]{1,120})\]\([^)]*\)", "$1"),
        (r"https?://\S+", ""),
        (r"\{?[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\}?", ""),
    ):
        plain = F.regexp_replace(plain, pattern, put)
    plain = fold(plain)
    return pages.select(
        "kb", "path", F.when(F.length(plain) >= X.LEAST_BODY, F.md5(plain)).otherwise("").alias("body_md5"), F.md5(fold(F.col("body"))).alias("strict_md5"), F.length(plain).alias("chars"),
        F.octet_length("body").alias("bytes"), "title", F.left("created", F.lit(10)).alias("date"), F.md5(F.left(plain, F.lit(X.HEAD))).alias("head_md5"),
    )


def name_scan(pages: DataFrame, people: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Q7: (kb, person, family, page) of names found in pages (kb, page, text), for people (kb, person, first, last).

    Families: full, "Last, First", "F. Last", the first name alone where it is unique
    in the kb, and aliases. Every form is looked for by its own words, so a page meets
    only forms whose first word it holds.
    """
    alone = people.groupBy("kb", "first").agg(F.countDistinct("person").alias("n")).where("n = 1").select("kb", "first", F.lit(True).alias("unique"))
    p = people.join(alone, ["kb", "first"], "left")
    form = lambda family, text, when=None: p.where(when if when is not None else F.lit(True)).select("kb", "person", F.lit(family).alias("family"), text.alias("form"))
    forms = form("full", F.concat_ws(" ", "first", "last")).unionByName(form("outlook", F.concat_ws(", ", "last", "first"))).unionByName(form("initial", F.concat(F.left("first", F.lit(1)), F.lit(". "), F.col("last")))).unionByName(form("first", F.col("first"), F.col("unique")))
    if aliases is not None:
        forms = forms.unionByName(aliases.select("kb", "person", F.lit("alias").alias("family"), F.col("alias").alias("form")))
    key = lambda c: F.element_at(F.regexp_extract_all(c, F.lit(r"((?U)\w+)"), 1), 1)
    forms = forms.withColumn("word", key(F.col("form")))
    words = pages.select("kb", "page", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"((?U)\w+)"), 1))).alias("word"))
    quoted = F.concat(F.lit(r"(?U)\b"), F.regexp_replace(F.regexp_replace("form", r"([.()\[\]{}+*?^$|\\])", r"\\$1"), " ", r"\\s+"), F.lit(r"\b"))
    return words.join(forms, ["kb", "word"]).where(F.regexp(F.col("text"), quoted)).select("kb", "person", "family", "page").distinct()


def stale_claims(v: Vault) -> DataFrame:
    """Q9: (kb, concept, shape, text, newest_source): claims up to a period that a newer source passes, and absence phrases."""
    newest = v.citations.where(F.col("last_modified") <= v.now[:10]).groupBy("kb", "concept").agg(F.max(F.left("last_modified", F.lit(10))).alias("newest_source"))
    prose = v.concepts.where("path NOT LIKE '%/questions.md'").select("kb", F.col("path").alias("concept"), "bare")
    found = prose.select("kb", "concept", F.explode(F.regexp_extract_all("bare", F.lit(X.PERIOD), 1)).alias("text"))
    month = F.create_map(*[x for i, m in enumerate(T.MONTHS[0]) for x in (F.lit(m), F.lit(f"{i + 1:02d}"))])
    dotted = F.concat_ws("-", F.split_part("text", F.lit("."), F.lit(3)), F.lpad(F.split_part("text", F.lit("."), F.lit(2)), 2, "0"), F.lpad(F.split_part("text", F.lit("."), F.lit(1)), 2, "0"))
    # A month's end is always day 31 and a year's 12-31: the strings only need to compare.
    end = F.when(F.col("text").contains("."), dotted).when(F.col("text").rlike("^[A-Z]"), F.concat(F.right("text", F.lit(4)), F.lit("-"), F.try_element_at(month, F.lower(F.split_part("text", F.lit(" "), F.lit(1)))), F.lit("-31"))).when(F.length("text") == 4, F.concat("text", F.lit("-12-31"))).otherwise(F.col("text"))
    dated = found.withColumn("period_end", end).join(newest, ["kb", "concept"]).where("newest_source > period_end").select("kb", "concept", F.lit("date").alias("shape"), "text", "newest_source")
    absent = prose.select("kb", "concept", F.explode(F.regexp_extract_all("bare", F.lit(X.ABSENCE), 1)).alias("text")).join(newest, ["kb", "concept"], "left").select("kb", "concept", F.lit("absence").alias("shape"), "text", "newest_source")
    return dated.unionByName(absent)


def changed_pages(v: Vault) -> DataFrame:
    """Q10: (kb, page, changed, concept, written) of concepts older than a cited page's change."""
    cites = v.citations.join(v.concepts.select("kb", F.col("path").alias("concept"), F.col("generated.at").alias("written")), ["kb", "concept"])
    keyed = J.behind(page_changes(v.changes).select(F.concat_ws("|", "kb", "page").alias("page"), "changed"), cites.select("concept", "written", F.concat_ws("|", "kb", "page").alias("page")))
    return keyed.select(F.split_part("page", F.lit("|"), F.lit(1)).alias("kb"), F.split_part("page", F.lit("|"), F.lit(2)).alias("page"), "changed", "concept", "written")


def attribution(v: Vault) -> DataFrame:
    """Q11: (kb, concept, name, page) of sentences in which someone acts who is none of the cited page's people."""
    claim = rf"(?<![\w`])([A-ZÄÖÜ][a-zäöü]+(?:\s+[A-ZÄÖÜ][a-zäöü]+)?)\s+{X.CLAIM_VERBS}\b[^\n]{{0,400}}?\[\^([A-Za-z0-9_-]+)\]"
    hits = v.concepts.select("kb", F.col("path").alias("concept"), F.explode(F.regexp_extract_all("bare", F.lit(f"({claim})"), 1)).alias("s"))
    said = hits.select("kb", "concept", F.regexp_extract("s", claim, 1).alias("name"), F.regexp_extract("s", claim, 2).alias("id")).where(~F.split_part("name", F.lit(" "), F.lit(1)).isin(X.NO_NAMES))
    people = v.pages.select("kb", F.col("path").alias("page"), T.page_actors(F.col("body")).alias("actors")).where("size(actors) > 0")
    named = people.select("kb", "page", F.flatten(F.transform("actors", lambda a: T.name_words(a))).alias("actor_names"))
    claims = said.join(v.citations.select("kb", "concept", "id", "page"), ["kb", "concept", "id"])
    return claims.join(named, ["kb", "page"]).where(~F.arrays_overlap(T.name_words(F.col("name")), "actor_names")).select("kb", "concept", "name", "page").distinct()


def index_of(v: Vault) -> DataFrame:
    """Q1: the search index of a vault's concepts, by `kb|path`."""
    docs = v.concepts.select(
        F.concat_ws("|", "kb", "path").alias("doc"), T.words(F.coalesce("title", F.lit(""))).alias("title_words"), T.words(F.array_join("tags", " ")).alias("tag_words"),
        T.words(F.coalesce("description", F.lit(""))).alias("desc_words"), T.words(F.regexp_replace("body", r"(?m)^\[\^[^\]]+\]:.*$", "")).alias("body_words"),
    )
    return R.fields(docs)


class Tools:
    """The six lookups over a vault. Paths outside its concepts give no rows."""

    def __init__(self, v: Vault, aliases: DataFrame | None = None) -> None:
        self.v, self.aliases, self.index = v, aliases, index_of(v)

    def search(self, query: str, k: int = 10, of: Column | None = None) -> DataFrame:
        """The k best concepts, of those that `of` (on doc, kb|path) keeps. Aliases (kb, person, alias) name people by
        their concept's path or by its file name."""
        index = self.index.where(of) if of is not None else self.index
        terms = [t for t in _fold(query) if t]
        questions = self.v.concepts.where("path LIKE '%questions.md'").select(F.concat_ws("|", "kb", "path").alias("doc"))
        alias = None
        if self.aliases is not None:
            named = self.aliases.where(F.lower("alias") == query.lower()).select("kb", "person")
            known = self.v.concepts.select("kb", "path", F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("file"))
            alias = known.join(named, "kb").where((F.col("person") == F.col("path")) | (F.col("person") == F.col("file"))).select(F.concat_ws("|", "kb", "path").alias("doc"))
            alias = alias.where(of) if of is not None else alias
        return R.search(index, terms, k, questions, alias)

    def concept(self, path: str, kb: str | None = None) -> DataFrame:
        """The concepts with this path, each with the backlinks of its own kb."""
        own = (F.col("path") == path) & (F.col("kb") == kb if kb else F.lit(True))
        record = self.v.concepts.where(own)
        back = G.backlinks(self.v.links.select(F.concat_ws("|", "kb", "src").alias("src"), F.concat_ws("|", "kb", "dst").alias("dst")))
        return record.join(back, F.concat_ws("|", record["kb"], record["path"]) == back["dst"], "left").drop("dst", "fm", "bare")

    def _who(self, name: str, group: str) -> DataFrame:
        """The three best of a group: it is filtered before anything is ranked."""
        return self.search(name, 3, F.col("doc").contains(f"|Wiki/{group}/"))

    def person(self, name: str) -> DataFrame:
        return self._who(name, "people")

    def project(self, name: str) -> DataFrame:
        return self._who(name, "projects")

    def changed_since(self, day: str, limit: int = 50) -> DataFrame:
        """Newest first; ties by path, last first."""
        return self.v.concepts.select("kb", "path", F.col("generated.at").alias("written")).where(F.col("written") >= day).orderBy(F.desc("written"), F.desc("path")).limit(limit)

    def open_questions(self, items: DataFrame, topic: str = "") -> DataFrame:
        return J.on_topic(items, topic)


def _fold(text: str) -> list[str]:
    import re
    import unicodedata

    text = text.lower()
    for a, b in T.TRANSLITERATION:
        text = text.replace(a, b)
    return re.findall("[a-z0-9]+", unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode())


def queues(v: Vault, items: DataFrame, pairs_unread: DataFrame, attachments: DataFrame | None = None) -> DataFrame:
    """(kb, queue, n) of every queue of each kb, and the librarian's total.

    items (kb, item, state, resolution) in plain states; pairs_unread (kb, a, b); attachments (kb, n) of the
    attachment registers. Bullets are those of the section *Open questions* outside questions.md, held readings the
    unsettled rows of questions.md, a draft counts unless an open or deferred item names its path. A queue that such
    an item raises as `queue: name` waits for the owner and leaves the total.
    """
    kbs = v.files.select("kb").distinct()
    count = lambda rows, name: rows.groupBy("kb").agg(F.count(F.lit(1)).alias(name))
    spread = lambda column: F.explode(column).alias("x")
    standing = items.where("state IN ('open', 'deferred')")
    named = standing.groupBy("kb").agg(F.array_join(F.collect_list(F.concat_ws(" ", "item", "resolution")), " ").alias("named"))
    drafts = v.concepts.where("status = 'draft'").select("kb", F.regexp_replace("path", "^Wiki/", "").alias("rel")).join(named, "kb", "left").where(~F.coalesce(F.contains("named", F.col("rel")), F.lit(False)))
    bullets = W.section(W.lines_of(v.concepts.where(~F.endswith(F.col("path"), F.lit("questions.md"))).select(F.concat_ws("|", "kb", "path").alias("doc"), F.col("body").alias("text"))), "Open questions")
    bullets = bullets.where(F.col("body").rlike(r"^\s*[-*] ") & ~F.col("body").contains("~~")).select(F.split_part("doc", F.lit("|"), F.lit(1)).alias("kb"))
    held = v.files.where("path = 'Wiki/questions.md'").select("kb", spread(T.held_rows(F.col("text"))))
    gauge = lambda check, name: audit.findings(v, [check]).groupBy("kb").agg(F.max(F.regexp_extract("message", "([0-9]+)", 1).cast("long")).alias(name))
    parts = [
        count(pairs_unread, "pairs_unread"), count(audit.raw_fate(v), "raw_without_fate"), count(drafts, "drafts_unnamed"), count(bullets, "open_question_bullets"), count(held, "held_readings"),
        count(stale_claims(v), "stale_claims"), changed_pages(v).groupBy("kb").agg(F.countDistinct("concept").alias("changed_pages")),
        *([attachments.select("kb", F.col("n").cast("long").alias("attachments_pending"))] if attachments is not None else []),
        gauge("C69", "author_splits"), gauge("C75", "date_splits"), gauge("C81", "descriptions_behind"), gauge("C80", "body_after_footnotes"), gauge("C76", "paths_unresolved"),
        count(items.where("state = 'open'"), "items_open"), count(items.where("state = 'deferred'"), "items_deferred"), count(audit.deferred_passed(v), "deferred_passed"),
    ]
    wide = kbs
    names = []
    for part in parts:
        names.append(part.columns[1])
        wide = wide.join(part, "kb", "left")
    rows = A.queue_lengths(wide.na.fill(0, names), names).where("queue <> 'total'")
    raised = standing.select("kb", F.explode(F.regexp_extract_all("item", F.lit(r"queue: ([a-z_]+(?:, [a-z_]+)*)"), 1)).alias("q")).select("kb", F.explode(F.split("q", ", ")).alias("queue")).distinct()
    mine = rows.where(F.col("queue").isin(X.LIBRARIAN_QUEUES)).join(raised, ["kb", "queue"], "left_anti")
    total = kbs.join(mine, "kb", "left").groupBy("kb").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select("kb", F.lit("total").alias("queue"), "n")
    return rows.unionByName(total)


def dashboard(v: Vault, queue_rows: DataFrame, reports: DataFrame) -> DataFrame:
    """Q14, K3: one JSON object for each kb: concepts, citations, stale past and soon, queues, newest report."""
    day = v.now[:10]
    stale = J.stale_split(v.concepts.select(F.concat_ws("|", "kb", "path").alias("concept"), "stale_after"), day)
    by = stale.groupBy(F.split_part("concept", F.lit("|"), F.lit(1)).alias("kb")).pivot("when", ["past", "soon"]).agg(F.count(F.lit(1)))
    counts = v.concepts.groupBy("kb").agg(F.count(F.lit(1)).alias("concepts")).join(v.citations.groupBy("kb").agg(F.count(F.lit(1)).alias("citations")), "kb", "left")
    lengths = queue_rows.groupBy("kb").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("queue", "n")))).alias("queues"))
    newest = reports.groupBy("kb").agg(F.max_by("file", F.struct("day", "version")).alias("report"))
    joined = counts.join(by, "kb", "left").join(lengths, "kb", "left").join(newest, "kb", "left").na.fill(0)
    return joined.select("kb", F.to_json(F.struct("concepts", "citations", "past", "soon", "queues", "report")).alias("object"))


def remeasure_forms(text: DataFrame) -> DataFrame:
    """(item, query, n) of `count: N (query: name)` forms; a name is only ever looked up among known queries."""
    form = r"count:\s*([0-9']+)\s*\(query:\s*([a-z0-9_]+)\)"
    return text.select("item", F.regexp_replace(F.regexp_extract("text", form, 1), "'", "").cast("long").alias("n"), F.regexp_extract("text", form, 2).alias("query")).where("query <> ''")


def should_skip(log: DataFrame) -> DataFrame:
    """Kbs whose newest log entry is itself a health check."""
    return log.groupBy("kb").agg(F.max_by("kind", F.struct("day", "position")).alias("kind")).where("kind = 'health-check'").select("kb")


def passages_shared(v: Vault, path: str) -> DataFrame:
    """Paragraphs of one concept that stand verbatim in others."""
    paras = v.concepts.select("kb", "path", F.explode(T.paragraphs(F.col("bare"))).alias("p")).where("length(p) >= 60").select("kb", "path", F.md5(F.regexp_replace("p", r"\s+", " ")).alias("h"), "p")
    return paras.where(F.col("path") == path).select("h", "p").join(paras.where(F.col("path") != path).select("h", "kb", "path"), "h").drop("h")


def quotation_check(v: Vault) -> DataFrame:
    """Q6: quotations in no cited page."""
    return J.missing_quotes(*audit.quotation_rows(v))


def novelty_packs(docs: DataFrame, most: int = 250_000) -> DataFrame:
    """Q5: packed texts with the pack that each goes to; documents named kb|path are packed by kb, others by their
    folder."""
    packed = W.collapsed(docs)
    name = F.col("doc").cast("string")
    group = F.when(name.contains("|"), F.split_part(name, F.lit("|"), F.lit(1))).otherwise(F.regexp_extract(name, "^(.*)/[^/]*$", 1))
    sized = packed.select("doc", F.octet_length("text").alias("bytes"), group.alias("kb"))
    return packed.join(W.packs(sized, "kb", "doc", "bytes", most).select("doc", "kb", "pack"), "doc")


def read_marks(claims: DataFrame, bodies: DataFrame, readings: DataFrame) -> DataFrame:
    """Q9, ST3: claims still unread."""
    return S.unread_claims(claims, bodies, readings)
