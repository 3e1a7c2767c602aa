"""The audit as queries: a vault written out of the driver tables, read back like any other, and each check with its SQL.

A knowledge base for each nation, a concept for each customer, a page for each order, an item for each supplier.
Remainders of the keys decide which concept has which fault. The files are Markdown with YAML, so a query goes through
the whole ingestion; its SQL says from the driver tables alone what the check has to find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.functions import text as T
from lectern.plans import audit, composites
from lectern.plans.relational import query
from lectern.session import table
from lectern.sources import vault

NOW = "2000-06-30T12:00:00Z"
OPTIONS = {
    "authors_in_form": "", "raw_dates_from_date_added": "", "barred_scopes": r"o-1[0-9]{2}\.md$", "source_rules": r"o-2[0-9]+\.md$ => 1997-01-01",
    "export_loss_claims": "", "draft_needs_reason": "", "forbid": "Order [0-9]*1 came", "require_together": "CHF => EUR", "require_file": "ROADMAP.md",
    "raw_needs_fate": "", "root_index_complete": "", "questions_closed": "", "forbid_in": "CLAUDE.md => base", "house_style": "currently",
}
#: Paragraphs by the customer key's remainder by twelve.
FAULTS = (
    "Then we counted it.", "It was read in this batch.", "The scan was lost in the export.", "One — two — three — four.", "It cost CHF 4,500 then.", "It currently waits.",
    "## # Double", "Prose here\nand another line.", "- item\nglued", "| a | b |\n| --- | --- |\n| 1 | 2 | 3 |",
    "| Date | What |\n| --- | --- |\n| 2000-01-02 | b |\n| 1999-01-02 | a |", "See `Zz_kb/Wiki/a.md` and `Wiki/none.md`.",
)


def files_of(spark: SparkSession, d: str) -> DataFrame:
    """(path, text) of the vault's files."""
    text = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    kb = lambda nation: F.concat(F.char(F.lit(65) + F.col(nation)), F.lit("a_kb"))
    k, o = F.col("k"), F.col("o")
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"), kb("c_nationkey").alias("kb"))
    day, later = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format(F.date_add("o_orderdate", 1), "yyyy-MM-dd")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("k"), day.alias("day"), later.alias("later"), F.col("o_totalprice").cast("long").cast("string").alias("price"))
    key = o.cast("string")
    when = lambda condition, value: F.when(condition, value).otherwise("")
    entry = text(
        "  - id: o", key, "\n    resource: ../../Raw/o-", key, ".md\n    title: Order ", key, "\n", when(o % 50 == 1, "    title: Again\n"),
        "    author: ", F.when(o % 6 == 0, "Clerk Seven").otherwise(text("human:clerk-", (o % 7).cast("string"))), "\n    last_modified: ", F.when(o % 9 == 0, F.col("later")).otherwise(F.col("day")), "\n",
        when(o % 40 == 0, text("  - id: x", key, "\n    resource: ../../Raw/o-", key, ".md\n    last_modified: ", F.col("day"), "\n")),
    )
    join = lambda condition, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct("o", value.alias("t"))))), lambda x: x["t"]), "")
    per = orders.groupBy("k").agg(
        join(o % 8 != 7, entry).alias("sources"),
        join(o % 5 != 0, text("Order ", key, " came to ", F.col("price"), ".[^o", key, "]\n\n")).alias("prose"),
        join(o % 7 != 0, text("[^o", key, "]: Order ", key, ".\n")).alias("notes"),
    )
    c = customers.join(per, "k", "left").na.fill("", ["sources", "prose", "notes"])
    at = F.date_format(F.date_add(F.lit("1996-01-01").cast("date"), (k * 7 % 2000).cast("int")), "yyyy-MM-dd")
    head = text(
        when(k % 11 != 0, "type: Customer\n"), "title: ", F.col("name"), "\ndescription: A customer since ", (k % 8 + 1990).cast("string"), "\nstatus: ", F.when(k % 7 == 0, "draft").otherwise("stable"), "\n",
        F.when(k % 5 == 0, text("stale_after: 2000-0", (k % 9 + 1).cast("string"), "-15\n")).otherwise(when(k % 10 == 6, "stale_after: soon\n")),
        F.when(k % 13 == 0, "generated: someone\n").otherwise(text("generated: {by: \"", F.when(k % 17 == 0, "bob").otherwise("librarian/one"), "\", at: \"", at, "T10:00:00Z\"}\n")),
        when(k % 19 == 0, "verified: {by: \"agent:x\", at: \"2000-01-11\"}\n"), when(k % 19 == 1, "verified:\n  - {by: \"human:a\", at: \"2000-01-11\"}\n"),
        F.when(k % 29 == 0, "sources: none\n").otherwise(text("sources:\n", when(k % 43 == 0, "  - just text\n"), F.col("sources"))),
    )
    faults = F.element_at(F.array(*map(F.lit, FAULTS)), (k % 12 + 1).cast("int"))
    body = text(
        "\n# ", F.col("name"), "\n\n", F.col("prose"), faults, "\n\nSee [next](c-", (k + 25).cast("string"), ".md).\n\n", F.col("notes"),
        when(k % 31 == 0, "\nTrailing text.\n"), when(k % 37 == 0, "\n```\n+++\n"),
    )
    concept = F.when(k % 23 == 1, text("# ", F.col("name"), "\n")).when(k % 23 == 2, "---\ntype: [Customer\n---\ntext\n").when(k % 23 == 3, "---\n- a\n- b\n---\ntext\n").otherwise(text("---\n", head, "---\n", body))
    concepts = c.select(text(F.col("kb"), "/Wiki/customers/c-", k.cast("string"), ".md").alias("path"), concept.alias("text"))
    placed = orders.join(customers.select("k", "kb", "nation"), "k")
    pages = placed.where("o % 10 <> 3").select(
        text(F.col("kb"), "/Raw/o-", key, ".md").alias("path"), text("---\ntitle: Order ", key, "\ncreated: ", F.col("day"), "\nmodified: ", F.col("day"), "\ndate_added: ", F.col("day"), "\n---\n\nCame to ", F.col("price"), ".\n").alias("text")
    )
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), kb("n_nationkey").alias("kb"))
    listed = placed.groupBy("kb").agg(join(o % 3 == 0, text("- `Raw/o-", key, ".md`\n")).alias("register"))
    index = customers.groupBy("kb").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(k % 4 != 0, text("- [c](c-", k.cast("string"), ".md) - x\n")))), "").alias("index"))
    s = F.col("s_suppkey")
    state = F.element_at(F.array(*map(F.lit, ("open", "**actioned**", "deferred", "withdrawn", "sleeping", "open,"))), (s % 6 + 1).cast("int"))
    item = text("| AI-", (s % 6 + 1996).cast("string"), "-01-1", (s % 9).cast("string"), "-", s.cast("string"), " | d | item ", s.cast("string"), " | ", state, " | |\n")
    items = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.array_join(F.array_sort(F.collect_list(item)), "").alias("items"), F.count_if(s % 6 % 5 == 0).alias("live"))
    n = nations.join(listed, "kb", "left").join(index, "kb", "left").join(items, "nation", "left").na.fill("").na.fill(0)
    questions = text(
        "---\ntype: Open Questions\ntitle: Questions\nstatus: stable\ngenerated: {by: \"librarian/one\", at: \"2000-01-01T10:00:00Z\"}\n---\n\n# Items\n\nThere are ", (F.col("live") + F.col("nation") % 2).cast("string"),
        " open items.\n\n| id | raised | item | state | resolution |\n| --- | --- | --- | --- | --- |\n", F.col("items"),
    )
    nation = F.col("nation")
    own = {
        "CLAUDE.md": F.lit("base\n"), "CHANGELOG.md": text("# ", F.when(nation % 2 == 1, "2001-01-05").otherwise("2000-01-05"), "\n\nBegun.\n", when(nation % 5 == 0, "Meeting ID: 123 456 789\n")),
        "memory.md": text("| Concepts | ", (F.col("n") + 1 + (nation % 3 == 0).cast("int")).cast("string"), " |\n"), "Wiki/customers/index.md": text(when(nation % 6 == 0, "---\na: b\n---\n"), F.col("index")),
        "Wiki/index.md": F.when(nation % 2 == 0, "- [Customers](customers/index.md)\n").otherwise("nothing\n"), "Raw/_INGESTED.md": text(F.col("register"), when(nation % 4 == 1, "- `Raw/none.md`\n")), "Wiki/questions.md": questions,
    }
    fixed = n.select("kb", F.explode(F.map_from_arrays(F.array(*map(F.lit, own)), F.array(*own.values()))).alias("name", "text")).select(F.concat_ws("/", "kb", "name").alias("path"), "text")
    return concepts.unionByName(pages).unionByName(fixed)


def vault_of(spark: SparkSession, d: str) -> vault.Vault:
    """The vault, written once for a session and directory."""
    held = spark.sparkContext.__dict__.setdefault("_lectern_vaults", {})
    if d not in held:
        kbs = table(spark, d, "nation").select(F.concat(F.char(F.lit(65) + F.col("n_nationkey")), F.lit("a_kb")).alias("kb"))
        options = kbs.select("kb", F.explode(F.map_from_arrays(F.array(*map(F.lit, OPTIONS)), F.array(*map(F.lit, OPTIONS.values())))).alias("key", "value"))
        held[d] = vault.tables(files_of(spark, d), NOW, options, write=True)
    return held[d]


PRELUDE = """WITH c AS (SELECT c_custkey AS k, c_nationkey AS nation, chr(CAST(65 + c_nationkey AS INTEGER)) || 'a_kb' AS kb, 'Wiki/customers/c-' || c_custkey || '.md' AS path,
  c_custkey % 23 NOT IN (1, 2, 3) AS whole, CASE WHEN c_custkey % 5 = 0 THEN '2000-0' || (c_custkey % 9 + 1) || '-15' WHEN c_custkey % 10 = 6 THEN 'soon' END AS stale,
  strftime(DATE '1996-01-01' + CAST(c_custkey * 7 % 2000 AS INTEGER), '%Y-%m-%d') AS written FROM customer),
o AS (SELECT c.*, o_orderkey AS o, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 9 = 0 THEN strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS dated,
  'Raw/o-' || o_orderkey || '.md' AS page, o_orderkey % 10 <> 3 AS there FROM orders JOIN c ON c.k = o_custkey WHERE whole),
s AS (SELECT *, 'o' || o AS id, CASE WHEN o % 6 = 0 THEN 'Clerk Seven' ELSE 'human:clerk-' || (o % 7) END AS author FROM o WHERE k % 29 <> 0 AND o % 8 <> 7
  UNION ALL SELECT * REPLACE (day AS dated), 'x' || o AS id, NULL AS author FROM o WHERE k % 29 <> 0 AND o % 40 = 0),
n AS (SELECT n_nationkey AS nation, chr(CAST(65 + n_nationkey AS INTEGER)) || 'a_kb' AS kb FROM nation),
i AS (SELECT s_suppkey AS s, n.*, 'AI-' || (s_suppkey % 6 + 1996) || '-01-1' || (s_suppkey % 9) || '-' || s_suppkey AS id, s_suppkey % 6 AS state FROM supplier JOIN n ON n.nation = s_nationkey)
"""
CONCEPTS = "SELECT kb, path, {1} AS message FROM c WHERE {0}"
PROSE = "whole AND k % 12 = {0}"
#: Check -> (name of the query, its SQL behind PRELUDE).
EXPECTED: dict[str, tuple[str, str]] = {
    "C01": ("no_frontmatter", CONCEPTS.format("k % 23 = 1", "'frontmatter missing'")),
    "C02": ("bad_frontmatter", CONCEPTS.format("k % 23 = 2", "'frontmatter unparseable: while parsing a flow sequence'")),
    "C03": ("no_keys", CONCEPTS.format("k % 23 = 3", "'frontmatter is not keys and values'")),
    "C04": ("no_type", CONCEPTS.format("k % 23 = 3 OR whole AND k % 11 = 0", "'type missing'")),
    "C05": ("no_sources", CONCEPTS.format("k % 23 = 3 OR whole AND NOT EXISTS (SELECT 1 FROM s WHERE s.k = c.k)", "'sources missing or not a list'")),
    "C06": ("several_ids", "SELECT kb, path, 'page cited under several ids: ' || string_agg(id, ', ' ORDER BY id) AS message FROM s GROUP BY kb, path, page HAVING count(*) > 1"),
    "C08": ("author_form", "SELECT kb, path, 'author not in actor form: Clerk Seven' AS message FROM s WHERE author = 'Clerk Seven'"),
    "C09": ("raw_dates", "SELECT kb, path, 'source date differs from date_added of ' || page AS message FROM s WHERE there AND dated <> day"),
    "C10": ("verified", "SELECT kb, path, unnest(CASE WHEN k % 19 = 0 THEN ['verified by no human', 'verified without a changelog entry'] ELSE ['verified is not a mapping', 'verified without a changelog entry'] END) AS message FROM c WHERE whole AND k % 19 < 2"),
    "C11": ("repeated_keys", "SELECT kb, path, 'key repeated in one source: title' AS message FROM s WHERE id[1] = 'o' AND o % 50 = 1"),
    "C12": ("malformed_entries", CONCEPTS.format("whole AND k % 43 = 0 AND k % 29 <> 0", "'malformed source entry'")),
    "C13": ("dead_citations", "SELECT kb, path, 'citation does not resolve: ../../' || page AS message FROM s WHERE NOT there"),
    "C14": ("barred_scopes", "SELECT kb, path, 'barred scope cited: ../../' || page AS message FROM s WHERE o BETWEEN 100 AND 199"),
    "C16": ("source_rules", "SELECT kb, path, 'source dated other than its rule: ../../' || page AS message FROM s WHERE CAST(o AS VARCHAR) LIKE '2_%' AND dated <> '1997-01-01'"),
    "C20": ("unknown_labels", "SELECT kb, path, 'footnote has no source: o' || o AS message FROM o WHERE (o % 5 <> 0 OR o % 7 <> 0) AND (o % 8 = 7 OR k % 29 = 0)"),
    "C21": ("never_cited", "SELECT kb, path, 'sources never cited: ' || string_agg(id, ', ' ORDER BY id) AS message FROM s WHERE id[1] = 'x' OR o % 5 = 0 GROUP BY kb, path"),
    "C23": ("bad_stamp", CONCEPTS.format("whole AND k % 13 = 0", "'generated is not a mapping'")),
    "C24": ("older_than_sources", "SELECT kb, path, 'written before its newest source: ' || max(CASE WHEN there THEN least(dated, day) ELSE dated END) AS message FROM s WHERE k % 13 <> 0 GROUP BY kb, path, written HAVING written < max(CASE WHEN there THEN least(dated, day) ELSE dated END)"),
    "C25": ("sources_ahead", "SELECT kb, path, count(*) || ' sources dated after today, newest ' || max(dated) AS message FROM s WHERE dated > '2000-06-30' GROUP BY kb, path"),
    "C26": ("written_ahead", CONCEPTS.format("whole AND k % 13 <> 0 AND written > '2000-06-30'", "'generated in the future: ' || written || 'T10:00:00Z'")),
    "C30": ("first_person", CONCEPTS.format(PROSE.format(0), "'first person: we'")),
    "C31": ("batch_words", CONCEPTS.format(PROSE.format(1), "'compile vocabulary in prose'")),
    "C32": ("undefined_notes", "SELECT kb, path, 'footnote without a definition: o' || o AS message FROM o WHERE o % 5 <> 0 AND o % 7 = 0"),
    "C33": ("double_headings", CONCEPTS.format(PROSE.format(6), "'heading inside a heading'")),
    "C34": ("open_fences", CONCEPTS.format("whole AND k % 37 = 0", "'fence never closes'")),
    "C35": ("glued_paragraphs", CONCEPTS.format(PROSE.format(8), "'paragraph glued under a list item: 1'")),
    "C36": ("export_losses", CONCEPTS.format(PROSE.format(2), "'claim of a loss in the export'")),
    "C39": ("dashes", CONCEPTS.format(PROSE.format(3), "'three or more dashes in a paragraph'")),
    "C40": ("currency", CONCEPTS.format(PROSE.format(4), "'currency with a comma'")),
    "C42": ("date_tables", CONCEPTS.format(PROSE.format(10), "'date table out of order: 1'")),
    "C43": ("stated_counts", "SELECT kb, 'Wiki/questions.md' AS path, 'open items stated other than in the table' AS message FROM n WHERE nation % 2 = 1"),
    "C44": ("drafts", CONCEPTS.format("whole AND k % 7 = 0", "'draft without a reason'")),
    "C45": ("stale", CONCEPTS.format("whole AND (stale = 'soon' OR stale < '2000-06-30')", "CASE WHEN stale = 'soon' THEN 'stale_after is no date: soon' ELSE 'stale since ' || stale END")),
    "C46": ("present_tense", CONCEPTS.format(PROSE.format(5) + " AND stale IS NULL", "'present tense without stale_after'")),
    "C47": ("run_ons", CONCEPTS.format(PROSE.format(7), "'run-on paragraph: 1'")),
    "C49": ("row_widths", CONCEPTS.format(PROSE.format(9), "'rows of another width: 1'")),
    "C51": ("forbidden", "SELECT DISTINCT kb, path, 'forbidden: Order [0-9]*1 came' AS message FROM o WHERE o % 10 = 1"),
    "C52": ("together", CONCEPTS.format(PROSE.format(4), "'missing beside CHF'")),
    "C60": ("entries_ahead", "SELECT kb, 'CHANGELOG.md' AS path, 'entry dated in the future: 2001-01-05' AS message FROM n WHERE nation % 2 = 1"),
    "C60i": ("items_ahead", "SELECT kb, 'Wiki/questions.md' AS path, 'item dated in the future: ' || id AS message FROM i WHERE s % 6 = 5"),
    "C61": ("indexes", "SELECT DISTINCT kb, 'Wiki/customers/index.md' AS path, 'index differs from its folder' AS message FROM c WHERE k % 4 = 0"),
    "C62": ("root_index", "SELECT kb, 'Wiki/index.md' AS path, 'root index lacks customers' AS message FROM n WHERE nation % 2 = 1 AND nation IN (SELECT nation FROM c)"),
    "C63": ("item_states", "SELECT kb, 'Wiki/questions.md' AS path, 'unknown state of an item: sleeping' AS message FROM i WHERE state = 4"),
    "C64": ("closed_items", "SELECT kb, 'Wiki/questions.md' AS path, 'closed row left: ' || id AS message FROM i WHERE state IN (1, 3)"),
    "C66": ("required_files", "SELECT kb, 'ROADMAP.md' AS path, 'required file missing' AS message FROM n"),
    "C67": ("dead_links", "SELECT kb, path, 'dead link: c-' || (k + 25) || '.md' AS message FROM c WHERE whole AND NOT EXISTS (SELECT 1 FROM c t WHERE t.k = c.k + 25 AND t.kb = c.kb)"),
    "C68": ("orphans", CONCEPTS.format("NOT EXISTS (SELECT 1 FROM c f WHERE f.whole AND f.k + 25 = c.k AND f.kb = c.kb)", "'no inbound link'")),
    "C69": ("author_splits", "SELECT kb, '(bundle)' AS path, count(*) || ' pages cited with several authors' AS message FROM (SELECT kb, page FROM s GROUP BY kb, page HAVING count(*) > 1) GROUP BY kb"),
    "C71": ("raw_fates", "SELECT kb, page AS path, 'raw file without a fate' AS message FROM (SELECT chr(CAST(65 + c_nationkey AS INTEGER)) || 'a_kb' AS kb, o_orderkey AS o, 'Raw/o-' || o_orderkey || '.md' AS page FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 10 <> 3 AND o_orderkey % 3 <> 0) p WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.o = p.o)"),
    "C75": ("date_splits", "SELECT kb, '(bundle)' AS path, count(*) || ' pages cited with several dates' AS message FROM (SELECT kb, page FROM s GROUP BY kb, page HAVING count(DISTINCT dated) > 1) GROUP BY kb"),
    "C76": ("unresolved_paths", "SELECT kb, '(bundle)' AS path, count(*) || ' backticked paths resolve to nothing' AS message FROM c WHERE whole AND k % 12 = 11 GROUP BY kb"),
    "C80": ("trailing_text", "SELECT kb, '(bundle)' AS path, count(*) || ' concepts with text behind their footnotes' AS message FROM c WHERE whole AND k % 31 = 0 AND EXISTS (SELECT 1 FROM o WHERE o.k = c.k AND o % 7 <> 0) GROUP BY kb"),
    "C81": ("old_descriptions", "SELECT kb, '(bundle)' AS path, count(*) || ' descriptions two years behind their newest source' AS message FROM (SELECT kb, k FROM s GROUP BY kb, k HAVING CAST(left(max(dated), 4) AS INTEGER) - (k % 8 + 1990) >= 2) GROUP BY kb"),
    "C84": ("memory_counts", "SELECT kb, '(bundle)' AS path, 'memory.md counts other than there are' AS message FROM n WHERE nation % 3 = 0"),
    "C90": ("forbidden_in", "SELECT kb, 'CLAUDE.md' AS path, 'forbidden here: base' AS message FROM n"),
    "C91": ("unknown_bases", CONCEPTS.format(PROSE.format(11), "'names a base that does not exist: Zz_kb'")),
    "C93": ("meeting_codes", "SELECT kb, 'CHANGELOG.md' AS path, 'meeting join code in a tracked file' AS message FROM n WHERE nation % 5 = 0"),
    "C98": ("registers", "SELECT kb, 'Raw/_INGESTED.md' AS path, 'register names a missing file: Raw/o-' || o_orderkey || '.md' AS message FROM orders JOIN c ON c.k = o_custkey WHERE o_orderkey % 3 = 0 AND o_orderkey % 10 = 3 UNION ALL SELECT kb, 'Raw/_INGESTED.md', 'register names a missing file: Raw/none.md' FROM n WHERE nation % 4 = 1"),
    "C101": ("house_style", CONCEPTS.format(PROSE.format(5), "'banned words: currently'")),
    "N10": ("reserved_files", "SELECT kb, 'Wiki/customers/index.md' AS path, 'reserved file with frontmatter' AS message FROM n WHERE nation % 6 = 0"),
    "N11": ("actors", CONCEPTS.format("whole AND k % 13 <> 0 AND k % 17 = 0", "'generated by no valid actor'")),
}


def _register(check: str, name: str, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return audit.findings(vault_of(spark, d), [check]).select("kb", "path", "message")

    run.__name__ = f"{check.lower()}_{name}"
    run.__doc__ = f"{check} over the vault of the driver tables."
    query(PRELUDE + sql)(run)


for _check, (_name, _sql) in EXPECTED.items():
    _register(_check, _name, _sql)


@query(PRELUDE + " UNION ALL ".join(f"SELECT kb, path, '{check}' AS check_id, '{audit.CHECKS[check][0]}' AS severity, message FROM ({sql})" for check, (_, sql) in EXPECTED.items()))
def q15_audit(spark: SparkSession, d: str) -> DataFrame:
    """The findings of all these checks together."""
    return audit.findings(vault_of(spark, d), list(EXPECTED))


@query(PRELUDE + "SELECT kb FROM n")
def s1_knowledge_bases(spark: SparkSession, d: str) -> DataFrame:
    return vault.knowledge_bases(files_of(spark, d))


@query(PRELUDE + """SELECT kb, path, CASE WHEN whole THEN (SELECT c_name FROM customer WHERE c_custkey = k) END AS title, CASE WHEN whole THEN CASE WHEN k % 7 = 0 THEN 'draft' ELSE 'stable' END END AS status FROM c
UNION ALL SELECT kb, 'Wiki/questions.md', 'Questions', 'stable' FROM n""")
def s3_concept_scan(spark: SparkSession, d: str) -> DataFrame:
    return vault_of(spark, d).concepts.select("kb", "path", "title", "status")


@query(PRELUDE + """SELECT kb, path, CASE WHEN k % 11 <> 0 THEN 'Customer' END AS type, CASE WHEN k % 13 = 0 THEN NULL WHEN k % 17 = 0 THEN 'bob' ELSE 'librarian/one' END AS made_by, CASE WHEN k % 13 <> 0 THEN written || 'T10:00:00Z' END AS made_at,
  stale AS stale_after, CAST((k % 19 < 2) AS INTEGER) AS n_verified FROM c WHERE whole""")
def s4_frontmatter(spark: SparkSession, d: str) -> DataFrame:
    rows = vault_of(spark, d).concepts.where("path LIKE 'Wiki/customers/%' AND title IS NOT NULL")
    return rows.select("kb", "path", "type", F.col("generated.by").alias("made_by"), F.col("generated.at").alias("made_at"), "stale_after", F.size("verified").alias("n_verified"))


@query(PRELUDE + "SELECT kb, path AS concept, id, page, dated AS last_modified, coalesce(author, '') AS author FROM s")
def s5_citation_scan(spark: SparkSession, d: str) -> DataFrame:
    return vault_of(spark, d).citations.select("kb", "concept", "id", "page", "last_modified", F.array_join("author", ";").alias("author"))


ALL_ORDERS = "(SELECT chr(CAST(65 + c_nationkey AS INTEGER)) || 'a_kb' AS kb, o_orderkey AS o, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders JOIN customer ON c_custkey = o_custkey)"


@query(f"SELECT kb, 'Raw/o-' || o || '.md' AS path, 'Order ' || o AS title, day AS date_added FROM {ALL_ORDERS} WHERE o % 10 <> 3")
def s7_archive_pages(spark: SparkSession, d: str) -> DataFrame:
    return vault_of(spark, d).pages.select("kb", "path", "title", "date_added")


@query(PRELUDE + f"SELECT kb, 'Raw/o-' || o || '.md' AS page FROM {ALL_ORDERS} WHERE o % 3 = 0 UNION ALL SELECT kb, 'Raw/none.md' FROM n WHERE nation % 4 = 1")
def s9_ledger_scan(spark: SparkSession, d: str) -> DataFrame:
    return vault_of(spark, d).ledger.select("kb", "page")


@query(PRELUDE + "SELECT kb, path AS src, 'Wiki/customers/c-' || (k + 25) || '.md' AS dst FROM c WHERE whole")
def g1_concept_links(spark: SparkSession, d: str) -> DataFrame:
    return vault_of(spark, d).links.select("kb", "src", "dst")


@query(PRELUDE + """SELECT kb, path, CASE WHEN whole AND k % 7 <> 0 THEN 'stable' ELSE 'draft' END AS status, CASE WHEN whole AND k % 19 < 2 THEN 'verified' WHEN EXISTS (SELECT 1 FROM s WHERE s.k = c.k) THEN 'sourced' ELSE 'unsourced' END AS tier,
  coalesce(whole AND stale < '2000-06-30', false) AS stale, CAST((SELECT count(*) FROM s WHERE s.k = c.k) AS INTEGER) AS n_sources FROM c UNION ALL SELECT kb, 'Wiki/questions.md', 'stable', 'unsourced', false, 0 FROM n""")
def p29_trust(spark: SparkSession, d: str) -> DataFrame:
    rows = vault_of(spark, d).concepts.select("kb", "path", F.struct("status", "verified", "sources", "generated", "stale_after").alias("c"))
    return rows.select("kb", "path", T.trust(F.col("c"), NOW[:10]).alias("t")).select("kb", "path", "t.status", "t.tier", "t.stale", F.col("t.n_sources").cast("int").alias("n_sources"))


def _lengths() -> str:
    counted = {"raw_without_fate": "C71", "author_splits": "C69", "date_splits": "C75", "descriptions_behind": "C81", "body_after_footnotes": "C80", "paths_unresolved": "C76"}
    parts = [f"SELECT kb, '{queue}' AS queue, " + ("count(*)" if check == "C71" else "CAST(max(split_part(message, ' ', 1)) AS BIGINT)") + f" AS n FROM ({EXPECTED[check][1]}) GROUP BY kb" for queue, check in counted.items()]
    parts.append("SELECT kb, 'drafts_unnamed', count(*) FROM c WHERE whole AND k % 7 = 0 GROUP BY kb")
    parts += [f"SELECT kb, '{queue}', count(*) FROM i WHERE state IN ({states}) GROUP BY kb" for queue, states in (("items_open", "0, 5"), ("items_deferred", "2"))]
    names = "pairs_unread raw_without_fate drafts_unnamed open_question_bullets held_readings stale_claims changed_pages author_splits date_splits descriptions_behind body_after_footnotes paths_unresolved items_open items_deferred deferred_passed".split()
    return (
        PRELUDE + ", q AS (" + " UNION ALL ".join(parts) + "), w AS (SELECT n.kb, x.queue, coalesce(q.n, 0) AS n FROM n CROSS JOIN (SELECT unnest(" + str(names) + ") AS queue) x LEFT JOIN q ON q.kb = n.kb AND q.queue = x.queue) "
        "SELECT kb, queue, n FROM w UNION ALL SELECT kb, 'total', CAST(sum(n) AS BIGINT) FROM w WHERE queue NOT IN ('items_open', 'items_deferred', 'deferred_passed') GROUP BY kb"
    )


@query(_lengths())
def q13_queues(spark: SparkSession, d: str) -> DataFrame:
    v = vault_of(spark, d)
    items = audit.items_of(v, "/questions\\.md$").select("kb", "item", "state", "resolution")
    unread = spark.createDataFrame([], "kb string, a string, b string")
    return composites.queues(v, items, unread).select("kb", "queue", F.col("n").cast("long").alias("n"))
