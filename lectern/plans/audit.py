"""The audit: every integrity check as a select that gives (kb, path, message).

A check has a severity (D defect, F finding, G gauge on `(bundle)`) and, if
it is optional, the option that switches it on; without that option for a kb
it says nothing there. Dates compare as strings (a bad date is a legal
operand), and the day is a parameter.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F, Window

from lectern.functions import fixed as X, text as T
from lectern.operators import aggregates as A, joins as J, state as S, windows as W
from lectern.session import materialise
from lectern.sources.vault import Vault, action_items, page_changes

#: check id -> (severity, option or None, function of a vault)
CHECKS: dict[str, tuple[str, str | None, Callable[[Vault], DataFrame]]] = {}
#: check id -> (condition, message) of those that judge a concept by its own row
CONDITIONS: dict[str, tuple[str, str]] = {}
#: Checks of one written table: their shuffles are on disk together, and Spark plans them anew at each stage's end.
TOGETHER = 8


def check(name: str, severity: str, option: str | None = None):
    def keep(f):
        CHECKS[name] = (severity, option, f)
        return f

    return keep


def sql(name: str, severity: str, text: str, option: str | None = None) -> None:
    """A check as SQL over the vault's views; :today is the day of the run."""
    CHECKS[name] = (severity, option, lambda v: selected(v, text))


def selected(v: Vault, text: str) -> DataFrame:
    """A select over the vault's views."""
    # Regular expressions hold braces too, so only the views' names are filled in.
    for view in v.NAMES:
        if f"{{{view}}}" in text:
            getattr(v, view).createOrReplaceTempView(f"lectern_{view}")
            text = text.replace(f"{{{view}}}", f"lectern_{view}")
    return v.options.sparkSession.sql(text, args={"today": v.now[:10]})


CONCEPT = "SELECT kb, path, '{1}' AS message FROM {{concepts}} WHERE {0}"


def where(name: str, severity: str, condition: str, message: str, option: str | None = None) -> None:
    CONDITIONS[name] = (condition, message)
    sql(name, severity, CONCEPT.format(condition, message), option)


# Shape and provenance.
where("C01", "D", "fm IS NULL", "frontmatter missing")
sql("C02", "D", "SELECT kb, path, concat('frontmatter unparseable: ', parse_error) AS message FROM {concepts} WHERE parse_error IS NOT NULL")
where("C03", "D", "array_contains(shape, 'frontmatter is not keys and values')", "frontmatter is not keys and values")
where("C04", "D", "fm IS NOT NULL AND parse_error IS NULL AND coalesce(type, '') = ''", "type missing")
where("C05", "D", "fm IS NOT NULL AND parse_error IS NULL AND (array_contains(shape, 'sources is not a list') OR size(sources) = 0) AND path NOT LIKE '%/questions.md'", "sources missing or not a list")
sql("C06", "F", "SELECT kb, concept AS path, concat('page cited under several ids: ', array_join(array_sort(collect_set(id)), ', ')) AS message FROM {citations} GROUP BY kb, concept, page HAVING count(DISTINCT id) > 1")
IN_ARCHIVE = r"resource RLIKE r'^(?:\.\./)*(?:[A-Za-z]+_kb/)?(?:OneNote|folia)/'"
AUTHORS = f"SELECT kb, concept AS path, concat('author not in actor form: ', a) AS message FROM (SELECT *, explode(author) AS a FROM {{citations}}) WHERE NOT a RLIKE r'{X.AUTHOR_FORM}' AND "
sql("C07", "F", AUTHORS + IN_ARCHIVE)
sql("C08", "F", AUTHORS + "NOT (" + IN_ARCHIVE + ")", "authors_in_form")
sql("C09", "D", "SELECT c.kb, c.concept AS path, concat('source date differs from date_added of ', c.page) AS message FROM {citations} c JOIN {pages} p ON p.kb = c.kb AND p.path = c.page WHERE p.layer = 'Raw' AND p.date_added IS NOT NULL AND c.last_modified <> p.date_added", "raw_dates_from_date_added")
sql("C10", "D", """SELECT kb, path, m AS message FROM (SELECT c.kb, c.path, explode(filter(array(
  CASE WHEN array_contains(shape, 'verified is a list') OR array_contains(shape, 'verified is not a mapping') THEN 'verified is not a mapping' END,
  CASE WHEN exists(verified, v -> NOT coalesce(v.by, '') LIKE 'human:%') THEN 'verified by no human' END,
  CASE WHEN size(verified) > 0 AND NOT coalesce(contains(f.text, substring_index(c.path, '/', -1)), false) THEN 'verified without a changelog entry' END), x -> x IS NOT NULL)) AS m
  FROM {concepts} c LEFT JOIN {files} f ON f.kb = c.kb AND f.path = 'CHANGELOG.md')""")


@check("C11", "D")
def repeated_key(v: Vault) -> DataFrame:
    """A key that stands twice in one source entry of the raw YAML."""
    rows = W.lines_of(v.concepts.select(F.concat_ws("|", "kb", "path").alias("doc"), F.coalesce("fm", F.lit("")).alias("text")))
    key = F.regexp_extract("body", r"^\s+(?:-\s+)?([A-Za-z_]+):", 1)
    entry = F.sum(F.col("body").rlike(r"^\s*-\s").cast("int")).over(Window.partitionBy("doc").orderBy("line"))
    seen = rows.withColumn("key", key).withColumn("entry", entry).where("key <> '' AND entry > 0").groupBy("doc", "entry", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return seen.select(F.split_part("doc", F.lit("|"), F.lit(1)).alias("kb"), F.split_part("doc", F.lit("|"), F.lit(2)).alias("path"), F.concat(F.lit("key repeated in one source: "), "key").alias("message"))


sql("C12", "D", "SELECT kb, path, m AS message FROM (SELECT kb, path, explode(array_distinct(filter(shape, s -> s RLIKE 'source (entry|id|resource)'))) AS m FROM {concepts})")
sql("C13", "D", "SELECT c.kb, c.concept AS path, concat('citation does not resolve: ', c.resource) AS message FROM {citations} c LEFT ANTI JOIN {files} f ON f.kb = c.kb AND f.path = c.page WHERE c.resource IS NOT NULL")
sql("C14", "D", "SELECT c.kb, c.concept AS path, concat('barred scope cited: ', c.resource) AS message FROM {citations} c JOIN {options} o ON o.kb = c.kb AND o.key = 'barred_scopes' AND c.resource RLIKE o.value", "barred_scopes")
sql("C17", "F", r"""SELECT kb, concept AS path, concat('date differs from the one in the file name: ', page) AS message FROM {citations}
  WHERE page NOT LIKE 'Raw/%' AND NOT (""" + IN_ARCHIVE + r""") AND regexp_extract(substring_index(page, '/', -1), r'([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) NOT IN ('', coalesce(last_modified, ''))""")
sql("C18", "F", r"""SELECT c.kb, c.concept AS path, concat('page dated other than its title: ', c.page) AS message FROM {citations} c JOIN {pages} p ON p.kb = c.kb AND p.path = c.page
  WHERE p.layer IN ('OneNote', 'folia') AND try_to_date(regexp_extract(p.title, r'([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), 'yyyy-MM-dd') IS NOT NULL AND c.last_modified IS NOT NULL AND regexp_extract(p.title, r'([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) <> c.last_modified""")
sql("C19", "D", r"""SELECT c.kb, c.concept AS path, concat('owner named as author before the date: ', c.page) AS message FROM {citations} c JOIN {options} o ON o.kb = c.kb AND o.key = 'owner_author_not_before'
  WHERE exists(c.author, a -> a RLIKE substring_index(o.value, ' ', -1)) AND c.last_modified < substring_index(o.value, ' ', 1)""", "owner_author_not_before")
sql("C20", "D", "SELECT DISTINCT f.kb, f.concept AS path, concat('footnote has no source: ', f.label) AS message FROM {footnotes} f LEFT ANTI JOIN {citations} c ON c.kb = f.kb AND c.concept = f.concept AND c.id = f.label")
sql("C21", "F", "SELECT c.kb, c.concept AS path, concat('sources never cited: ', array_join(array_sort(collect_set(c.id)), ', ')) AS message FROM {citations} c LEFT ANTI JOIN (SELECT * FROM {footnotes} WHERE kind = 'ref') f ON f.kb = c.kb AND f.concept = c.concept AND f.label = c.id GROUP BY c.kb, c.concept")
sql("C22", "F", r"""SELECT c.kb, c.concept AS path, concat('source id names a year that its page lacks: ', c.id) AS message FROM {citations} c JOIN {pages} p ON p.kb = c.kb AND p.path = c.page
  WHERE regexp_extract(c.id, r'(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])', 1) <> '' AND NOT contains(concat_ws(' ', p.path, p.title, p.created, p.modified, p.date_added, p.date_published, p.body, c.last_modified), regexp_extract(c.id, r'(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])', 1))""")
where("C23", "D", "array_contains(shape, 'generated is not a mapping')", "generated is not a mapping")
sql("C24", "D", """SELECT c.kb, c.path, concat('written before its newest source: ', s.newest) AS message FROM {concepts} c JOIN (SELECT kb, concept, max(least(last_modified, coalesce(p.modified, last_modified))) AS newest FROM {citations} LEFT JOIN (SELECT kb AS pkb, path AS ppath, modified FROM {pages}) p ON pkb = kb AND ppath = page GROUP BY kb, concept) s
  ON s.kb = c.kb AND s.concept = c.path WHERE left(c.generated.at, 10) < left(s.newest, 10)""")
sql("C25", "F", "SELECT kb, concept AS path, concat(count(*), ' sources dated after today, newest ', max(last_modified)) AS message FROM {citations} WHERE last_modified > :today GROUP BY kb, concept")


@check("C26", "D")
def written_ahead(v: Vault) -> DataFrame:
    """generated.at later than today, or more than 60 minutes ahead of the run's instant."""
    at = F.col("generated.at")
    bare = at.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & (at > v.now[:10])
    ahead = minutes_ahead(at, F.lit(v.now)) > 60
    return v.concepts.where(bare | (F.length(at) > 10) & ahead).select("kb", "path", F.concat(F.lit("generated in the future: "), at).alias("message"))


def minutes_ahead(at, now):
    """Whole minutes of an ISO instant after now; null if it is none. Without an offset it is UTC."""
    seconds = F.unix_timestamp(F.try_to_timestamp(at)) - F.unix_timestamp(F.try_to_timestamp(now))
    return F.floor(seconds / 60)


@check("C27", "F")
def source_day(v: Vault) -> DataFrame:
    """A source id that names a day which both the page's title and its file name contradict."""
    named = v.citations.join(v.pages.select("kb", F.col("path").alias("page"), F.col("title").alias("page_title")), ["kb", "page"]).select("kb", "concept", "id", T.dates_in(F.coalesce("id", F.lit(""))).alias("i"), T.dates_in(F.coalesce("page_title", F.lit(""))).alias("t"), T.dates_in(F.col("page")).alias("f"))
    both = (F.size("i") > 0) & (F.size("t") > 0) & (F.size("f") > 0) & ~F.arrays_overlap("i", "t") & ~F.arrays_overlap("i", "f")
    return named.where(both).select("kb", F.col("concept").alias("path"), F.concat(F.lit("source id names another day: "), "id").alias("message"))


# Prose.
@check("C30", "D")
def first_person(v: Vault) -> DataFrame:
    """First person outside quotations, definitions, block quotes, links' texts and enumerations."""
    prose = v.lines.where(~F.col("body").rlike(r"^\s*(>|\[\^|\|)"))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("body", r"`[^`]*`", " "), r"\"[^\"]*\"|“[^”]*”", " "), r"\[[^\]]*\]\([^)]*\)", " ")
    # An I is a pronoun at a clause's start, behind a connector and behind a lower-case word that numbers nothing.
    words = "|".join(X.CONNECTORS)
    opens = rf"(?:^|[.,;:!?—–(\"*|>\['](?:\[\^[^\]]+\])*|\b(?i:{words})|(?<![\w])(?!(?:{'|'.join(X.NUMBERED)})\b)[a-z]\w*)\s*$"
    letters = F.col("bare").rlike(X.LETTER_LIST)
    # What stands before each hit since the one before: splitting is linear in the line, a lazy group before the hit isn't.
    hits = F.regexp_extract_all("bare", F.lit(X.FIRST_PERSON), 1)
    heads = F.slice(F.split("bare", X.FIRST_PERSON, -1), F.lit(1), F.size(hits))
    judged = F.filter(F.arrays_zip(heads.alias("head"), hits.alias("word")), lambda h: ~h["word"].startswith("I ") | (h["head"].rlike(opens) & ~letters))
    told = prose.withColumn("bare", bare).where(F.col("bare").rlike(X.FIRST_PERSON)).withColumn("words", judged).where("size(words) > 0")
    return told.groupBy("kb", "concept").agg(F.min(F.struct("line", F.col("words")[0]["word"].alias("word"))).alias("first")).select("kb", F.col("concept").alias("path"), F.concat(F.lit("first person: "), "first.word").alias("message"))


where("C31", "D", f'bare RLIKE r"{X.BATCH_WORD}"', "compile vocabulary in prose")
sql("C32", "D", "SELECT DISTINCT r.kb, r.concept AS path, concat('footnote without a definition: ', r.label) AS message FROM (SELECT * FROM {footnotes} WHERE kind = 'ref') r LEFT ANTI JOIN (SELECT * FROM {footnotes} WHERE kind = 'def') d ON d.kb = r.kb AND d.concept = r.concept AND d.label = r.label")
sql("C33", "D", r"SELECT DISTINCT kb, concept AS path, 'heading inside a heading' AS message FROM {lines} WHERE body RLIKE r'^#+[ \t]+#'")
sql("C34", "F", "SELECT DISTINCT kb, concept AS path, 'fence never closes' AS message FROM {lines} WHERE unclosed")


def _rules(v: Vault, rules: dict[str, str]) -> DataFrame:
    hits = W.pair_rules(v.lines.select("doc", "line", "body")).where(F.col("rule").isin(*rules))
    names = F.create_map(*[F.lit(x) for k, m in rules.items() for x in (k, m)])
    counted = hits.groupBy("doc", "rule").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.split_part("doc", F.lit("|"), F.lit(1)).alias("kb"), F.split_part("doc", F.lit("|"), F.lit(2)).alias("path"), F.concat(F.element_at(names, F.col("rule")), F.lit(": "), F.col("n").cast("string")).alias("message"))


check("C35", "F")(lambda v: _rules(v, {"under_item": "paragraph glued under a list item", "under_note": "paragraph glued under a footnote definition"}))
where("C36", "F", f'bare RLIKE r"{X.EXPORT_LOSS}"', "claim of a loss in the export", "export_loss_claims")


@check("C37", "F")
def person_has_concept(v: Vault) -> DataFrame:
    """Someone said to have no concept who has one."""
    said = v.concepts.select("kb", "path", F.explode(F.regexp_extract_all("bare", F.lit(X.NO_CONCEPT), 1)).alias("name")).withColumn("slug", T.slug(F.col("name")))
    people = v.concepts.where("path LIKE 'Wiki/people/%'").select("kb", F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("slug"))
    return said.join(people, ["kb", "slug"], "left_semi").select("kb", "path", F.concat(F.lit("said to have no concept: "), "name").alias("message"))


@check("C38", "F")
def repeated_paragraph(v: Vault) -> DataFrame:
    """A paragraph twice in a concept, or one that begins another."""
    paras = v.concepts.select("kb", "path", F.posexplode(T.paragraphs(F.col("bare"))).alias("pos", "p")).withColumn("p", F.regexp_replace("p", r"\s+", " ")).where("length(p) >= 60")
    # Only paragraphs with the same first 60 characters can be equal or begin one another.
    keyed = paras.withColumn("head", F.left("p", F.lit(60)))
    a, b = keyed.select("kb", "path", "head", F.col("pos").alias("i"), F.col("p").alias("one")), keyed.select("kb", "path", "head", F.col("pos").alias("j"), F.col("p").alias("two"))
    same = a.join(b, ["kb", "path", "head"]).where("i <> j AND ((one = two AND i < j) OR (length(one) >= 80 AND length(one) < length(two) AND startswith(two, one)))")
    return same.select("kb", "path", F.lit("paragraph stands twice").alias("message")).distinct()


@check("C39", "F")
def dashes(v: Vault) -> DataFrame:
    paras = v.concepts.select("kb", "path", F.explode(T.paragraphs(F.col("bare"))).alias("p")).withColumn("p", F.regexp_replace("p", r"\"[^\"]*\"|“[^”]*”", ""))
    return paras.where(F.regexp_count("p", F.lit("—")) >= 3).select("kb", "path", F.lit("three or more dashes in a paragraph").alias("message")).distinct()


where("C40", "F", f"bare RLIKE r'{X.CURRENCY_COMMA}'", "currency with a comma")


@check("C42", "F")
def dates_out_of_order(v: Vault) -> DataFrame:
    rows = W.islands(v.lines.select("doc", "line", "body"), W.is_row(F.col("body")), "tbl", dense=True)
    cells = rows.withColumn("cell", W.row_cells(F.col("body"))[0]).withColumn("no", F.row_number().over(Window.partitionBy("doc", "tbl").orderBy("line")))
    dated = cells.where("no = 1 AND lower(cell) = 'date'").select("doc", "tbl")
    keyed = cells.where("no > 2").join(dated, ["doc", "tbl"]).select(F.concat_ws("#", "doc", "tbl").alias("tbl"), "line", "cell", "doc")
    jumps = W.date_jumps(keyed).groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    return jumps.select(F.split_part("doc", F.lit("|"), F.lit(1)).alias("kb"), F.split_part("doc", F.lit("|"), F.lit(2)).alias("path"), F.concat(F.lit("date table out of order: "), F.col("n").cast("string")).alias("message"))


where("C44", "F", r"status = 'draft' AND NOT body RLIKE r'(?i)\bdraft (because|until)\b'", "draft without a reason", "draft_needs_reason")
sql("C45", "F", "SELECT kb, path, CASE WHEN try_to_date(stale_after, 'yyyy-MM-dd') IS NULL THEN concat('stale_after is no date: ', stale_after) ELSE concat('stale since ', stale_after) END AS message FROM {concepts} WHERE stale_after IS NOT NULL AND (try_to_date(stale_after, 'yyyy-MM-dd') IS NULL OR stale_after < :today)")
where("C46", "F", f"stale_after IS NULL AND bare RLIKE r'{X.PRESENT}'", "present tense without stale_after")
check("C47", "F")(lambda v: _rules(v, {"runon": "run-on paragraph"}))
check("C48", "F")(lambda v: _rules(v, {"row_under": "table row under prose", "under_table": "prose under a table row"}))


@check("C49", "F")
def row_widths(v: Vault) -> DataFrame:
    rows = W.islands(v.lines.select("doc", "line", "body"), W.is_row(F.col("body")), "tbl", dense=True).withColumn("width", W.row_width(F.col("body")))
    first = F.first("width").over(Window.partitionBy("doc", "tbl").orderBy("line"))
    odd = rows.withColumn("head", first).where("width <> head").groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    return odd.select(F.split_part("doc", F.lit("|"), F.lit(1)).alias("kb"), F.split_part("doc", F.lit("|"), F.lit(2)).alias("path"), F.concat(F.lit("rows of another width: "), F.col("n").cast("string")).alias("message"))


@check("C50", "F")
def cut_gloss(v: Vault) -> DataFrame:
    gloss = v.lines.select("kb", "concept", F.regexp_extract("body", r"^\s*[-*+]\s+\[[^\]]*\]\(([^)\s]+)\)\s+[-–—]\s+(.+)$", 1).alias("raw"), F.regexp_extract("body", r"^\s*[-*+]\s+\[[^\]]*\]\(([^)\s]+)\)\s+[-–—]\s+(.+)$", 2).alias("gloss")).where("gloss <> ''")
    placed = gloss.withColumn("target", F.concat_ws("|", "kb", T.nfc_path(F.concat(F.regexp_replace("concept", "/[^/]*$", ""), F.lit("/"), "raw"))))
    hits = J.cut_glosses(placed.select(F.col("concept").alias("source"), "kb", "target", "gloss"), v.concepts.select(F.concat_ws("|", "kb", "path").alias("concept"), "description"))
    return hits.select("kb", F.col("source").alias("path"), F.concat(F.lit("gloss cut within a word: "), "gloss").alias("message"))


sql("C51", "D", "SELECT c.kb, c.path, concat('forbidden: ', o.value) AS message FROM {concepts} c JOIN {options} o ON o.kb = c.kb AND o.key = 'forbid' AND c.body RLIKE o.value", "forbid")
sql("C52", "D", "SELECT c.kb, c.path, concat('missing beside ', substring_index(o.value, ' => ', 1)) AS message FROM {concepts} c JOIN {options} o ON o.kb = c.kb AND o.key = 'require_together' AND c.body RLIKE substring_index(o.value, ' => ', 1) AND NOT c.body RLIKE substring_index(o.value, ' => ', -1)", "require_together")

# Bundles.
sql("C60", "D", r"SELECT kb, path, concat('entry dated in the future: ', d) AS message FROM (SELECT kb, path, explode(regexp_extract_all(text, r'(?m)^#+\s+([0-9]{4}-[0-9]{2}-[0-9]{2})', 1)) AS d FROM {files} WHERE path = 'CHANGELOG.md') WHERE d > :today")
sql("C66", "D", "SELECT o.kb, o.value AS path, 'required file missing' AS message FROM {options} o LEFT ANTI JOIN {files} f ON f.kb = o.kb AND f.path = o.value WHERE o.key = 'require_file'", "require_file")
sql("C67", "D", r"""SELECT DISTINCT l.kb, l.src AS path, CASE WHEN l.dst RLIKE r'^\.\./' THEN concat('link into another base is dead: ', l.dst_raw) ELSE concat('dead link: ', l.dst_raw) END AS message FROM {links} l LEFT ANTI JOIN {files} f ON f.kb = l.kb AND f.path = l.dst LEFT ANTI JOIN {files} g ON concat('../', g.kb, '/', g.path) = l.dst WHERE NOT l.is_http AND l.ends_md""")
sql("C68", "F", "SELECT c.kb, c.path, 'no inbound link' AS message FROM {concepts} c LEFT ANTI JOIN (SELECT DISTINCT kb, dst FROM {links}) l ON l.kb = c.kb AND l.dst = c.path LEFT ANTI JOIN (SELECT kb, value FROM {options} WHERE key = 'orphan_ok') o ON o.kb = c.kb AND o.value = c.path WHERE c.path NOT LIKE '%/questions.md'")
sql("C69", "G", "SELECT kb, '(bundle)' AS path, concat(count(*), ' pages cited with several authors') AS message FROM (SELECT kb, page FROM {citations} GROUP BY kb, page HAVING count(DISTINCT array_join(array_sort(author), ';')) > 1) GROUP BY kb")
sql("C75", "G", "SELECT kb, '(bundle)' AS path, concat(count(*), ' pages cited with several dates') AS message FROM (SELECT kb, page FROM {citations} WHERE last_modified IS NOT NULL GROUP BY kb, page HAVING count(DISTINCT last_modified) > 1) GROUP BY kb")


@check("C71", "F", "raw_needs_fate")
def raw_fate(v: Vault) -> DataFrame:
    raw = v.files.where(r"path LIKE 'Raw/%' AND NOT path RLIKE '/_[^/]*$'").select("kb", F.col("path").alias("file"))
    cited = v.citations.select("kb", F.col("page").alias("file"))
    # The register's file names, so that a file meets only its own.
    names = F.regexp_extract_all("text", F.lit(r"([^\s`|/()\[\]]+\.[A-Za-z0-9]+)"), 1)
    listed = v.files.where("path LIKE '%/_INGESTED.md'").select("kb", F.explode(F.array_distinct(names)).alias("name"))
    named = raw.withColumn("name", F.element_at(F.split("file", "/"), -1)).join(listed, ["kb", "name"], "left_semi").select("kb", "file")
    rest = raw.join(cited.distinct(), ["kb", "file"], "left_anti").join(named.distinct(), ["kb", "file"], "left_anti")
    return rest.select("kb", F.col("file").alias("path"), F.lit("raw file without a fate").alias("message"))


@check("C72", "F", "deferred_dates")
def deferred_passed(v: Vault) -> DataFrame:
    rows = v.lines.where(F.col("concept").rlike("questions\\.md$") & F.lower("body").contains("reopens")).select("kb", "concept", T.dates_in(F.regexp_extract("body", r"(?i)(reopens[^.|]*)", 1)).alias("days"))
    return rows.where(F.replace(F.lit(v.now[:10]), F.lit("-"), F.lit("")) > F.array_max("days")).select("kb", F.col("concept").alias("path"), F.concat(F.lit("deferred date passed: "), F.array_max("days")).alias("message"))


@check("C73", "G")
def unread_pairs(v: Vault, threshold: int = 3) -> DataFrame:
    keyed = v.citations.select(F.concat_ws("|", "kb", "concept").alias("concept"), F.concat_ws("|", "kb", "page").alias("page"))
    pairs = J.shared_source_pairs(keyed, threshold).withColumn("kb", F.split_part("a", F.lit("|"), F.lit(1)))
    return pairs.groupBy("kb").agg(F.count(F.lit(1)).alias("n"), F.max("overlap").alias("most")).select("kb", F.lit("(bundle)").alias("path"), F.concat(F.col("n").cast("string"), F.lit(" pairs share sources, at most "), F.col("most").cast("string")).alias("message"))


check("C74", "G")(lambda v: _rules(v, {"note_under": "footnote definition glued under a paragraph"}).groupBy("kb").agg(F.count(F.lit(1)).alias("n")).select("kb", F.lit("(bundle)").alias("path"), F.concat(F.col("n").cast("string"), F.lit(" concepts with glued footnote definitions")).alias("message")))
sql("C76", "G", r"SELECT p.kb, '(bundle)' AS path, concat(count(*), ' backticked paths resolve to nothing') AS message FROM (SELECT kb, explode(regexp_extract_all(body, r'`((?:Wiki|Raw|OneNote|folia)/[^`\s]+\.md)`', 1)) AS t FROM {concepts}) p LEFT ANTI JOIN {files} f ON f.kb = p.kb AND f.path = p.t GROUP BY p.kb")


def quotation_rows(v: Vault) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Q6: (quotes, cites, pages) of a vault for the containment join, in comparison form."""
    blocks = W.blocks(v.lines.select("doc", "line", "body")).where(~F.col("text").rlike(r"^\[\^"))
    found = blocks.select("doc", "first", F.regexp_extract_all("text", F.lit(r"\[\^([^\]]+)\](?!:)"), 1).alias("labels"), F.posexplode(T.quotations(F.regexp_replace("text", "[“”„]", '"'))).alias("k", "quote")).where("size(labels) > 0")
    # The comparison form is a column of its own, since Python can't stand inside a function on arrays.
    plain = found.withColumn("quote", T.comparison_form(F.col("quote")))
    quotes = plain.select(F.concat_ws("#", "doc", "first", "k").alias("block"), "doc", "labels", T.quote_parts(F.col("quote")).alias("parts")).where("size(parts) > 0")
    cites = quotes.select("block", F.split_part("doc", F.lit("|"), F.lit(1)).alias("kb"), F.split_part("doc", F.lit("|"), F.lit(2)).alias("concept"), F.explode("labels").alias("id")).join(v.citations.select("kb", "concept", "id", "page"), ["kb", "concept", "id"]).select("block", F.concat_ws("|", "kb", "page").alias("page"))
    pages = v.pages.select(F.concat_ws("|", "kb", "path").alias("page"), T.comparison_form(F.concat_ws(" ", "title", "body")).alias("text"))
    return quotes.select("block", "parts"), cites, pages


@check("C78", "F", "quotes_in_page")
def misquoted(v: Vault) -> DataFrame:
    lost = J.missing_quotes(*quotation_rows(v))
    return lost.select(F.split_part("block", F.lit("|"), F.lit(1)).alias("kb"), F.split_part(F.split_part("block", F.lit("|"), F.lit(2)), F.lit("#"), F.lit(1)).alias("path"), F.concat(F.lit("quotation in no cited page: "), F.array_join("parts", " … ")).alias("message"))


@check("C79", "G")
def behind_pages(v: Vault) -> DataFrame:
    changes = page_changes(v.changes).select(F.concat_ws("|", "kb", "page").alias("page"), "changed")
    cites = v.citations.join(v.concepts.select("kb", F.col("path").alias("concept"), F.col("generated.at").alias("written")), ["kb", "concept"]).select("concept", "written", F.concat_ws("|", "kb", "page").alias("page"))
    late = J.behind(changes, cites).withColumn("kb", F.split_part("page", F.lit("|"), F.lit(1)))
    return late.groupBy("kb").agg(F.countDistinct("concept").alias("n")).select("kb", F.lit("(bundle)").alias("path"), F.concat(F.col("n").cast("string"), F.lit(" concepts written before a cited page changed")).alias("message"))


sql("C80", "G", r"""SELECT l.kb, '(bundle)' AS path, concat(count(DISTINCT l.concept), ' concepts with text behind their footnotes') AS message FROM {lines} l JOIN (SELECT kb, concept, max(line) AS last FROM {footnotes} WHERE kind = 'def' GROUP BY 1, 2) d ON d.kb = l.kb AND d.concept = l.concept AND l.line > d.last WHERE l.body RLIKE r'^[A-Za-z]' GROUP BY l.kb""")
sql("C81", "G", r"""SELECT c.kb, '(bundle)' AS path, concat(count(*), ' descriptions two years behind their newest source') AS message FROM {concepts} c JOIN (SELECT kb, concept, max(left(last_modified, 4)) AS newest FROM {citations} GROUP BY 1, 2) s ON s.kb = c.kb AND s.concept = c.path
  WHERE size(regexp_extract_all(c.description, r'\b((?:19|20)[0-9]{2})\b', 1)) > 0 AND CAST(s.newest AS INT) - CAST(array_max(regexp_extract_all(c.description, r'\b((?:19|20)[0-9]{2})\b', 1)) AS INT) >= 2 GROUP BY c.kb""")
sql("C84", "G", r"""SELECT f.kb, '(bundle)' AS path, 'memory.md counts other than there are' AS message FROM (SELECT kb, CAST(regexp_extract(text, r'Concepts\s*\|\s*([0-9]+)', 1) AS INT) AS said FROM {files} WHERE path = 'memory.md') f JOIN (SELECT kb, count(*) AS n FROM {concepts} GROUP BY kb) c ON c.kb = f.kb WHERE said <> n""")
sql("C87", "D", "SELECT DISTINCT kb, report AS path, 'change report without complete' AS message FROM {changes} WHERE complete IS NULL")

# The whole vault.
sql("C91", "D", r"SELECT DISTINCT p.kb, p.path, concat('names a base that does not exist: ', p.name) AS message FROM (SELECT kb, path, explode(regexp_extract_all(body, r'`([A-Z][A-Za-z]+_kb)/', 1)) AS name FROM {concepts}) p LEFT ANTI JOIN (SELECT DISTINCT kb FROM {files}) k ON k.kb = p.name")
sql("C93", "D", r"SELECT kb, path, 'meeting join code in a tracked file' AS message FROM {files} WHERE text RLIKE r'(?i)\b(meeting id|besprechungs-id)\s*:\s*[0-9]{3} ?[0-9]{3} ?[0-9]{3}'")


@check("C94", "D")
def credentials(v: Vault) -> DataFrame:
    return v.files.withColumn("token", T.credential_shape(F.col("text"))).where("token IS NOT NULL").select("kb", "path", F.concat(F.lit("credential-shaped token: "), F.left("token", F.lit(4)), F.lit("…")).alias("message"))


sql("N10", "F", r"SELECT kb, path, 'reserved file with frontmatter' AS message FROM {files} WHERE path RLIKE r'^Wiki/.*(index|log)\.md$' AND path <> 'Wiki/index.md' AND text RLIKE r'\A---\n'")
where("N11", "F", f"generated.by IS NOT NULL AND NOT generated.by RLIKE r'^(human|agent|system|org|librarian)[:/]'", "generated by no valid actor")
where("N12", "F", r"NOT path RLIKE r'(^|/)[a-z0-9]+(-[a-z0-9]+)*\.md$'", "file name is not lower-case kebab")


# Items, registers, reports and what needs state.
sql("C16", "D", "SELECT c.kb, c.concept AS path, concat('source dated other than its rule: ', c.resource) AS message FROM {citations} c JOIN {options} o ON o.kb = c.kb AND o.key = 'source_rules' AND c.resource RLIKE substring_index(o.value, ' => ', 1) AND coalesce(c.last_modified, '') <> substring_index(o.value, ' => ', -1)", "source_rules")


@check("C41", "F", "category_page_counts")
def category_counts(v: Vault) -> DataFrame:
    """A stated number of pages of a chapter that isn't the measured one."""
    said = v.concepts.select("kb", "path", F.explode(F.regexp_extract_all("bare", F.lit(r"([0-9']+ pages? in the chapter [\w-]+)"), 1)).alias("s"))
    said = said.select("kb", "path", F.regexp_replace(F.split_part("s", F.lit(" "), F.lit(1)), "'", "").cast("long").alias("said"), F.element_at(F.split("s", " "), -1).alias("chapter"))
    measured = v.pages.groupBy("kb", "chapter").agg(F.count(F.lit(1)).alias("n"))
    wrong = said.join(measured, ["kb", "chapter"], "left").where(F.coalesce("n", F.lit(0)) != F.col("said"))
    return wrong.select("kb", "path", F.concat(F.lit("stated page count of "), "chapter", F.lit(" is "), F.col("said").cast("string"), F.lit(", measured "), F.coalesce("n", F.lit(0)).cast("string")).alias("message"))


def items_of(v: Vault, pattern: str) -> DataFrame:
    """Item rows of files whose path matches, with plain states."""
    rows = v.files.where(F.col("path").rlike(pattern)).select(F.concat_ws("|", "kb", "path").alias("kb"), "text")
    items = action_items(rows).withColumn("path", F.split_part("kb", F.lit("|"), F.lit(2))).withColumn("kb", F.split_part("kb", F.lit("|"), F.lit(1)))
    return items.withColumn("raw_state", F.col("state")).withColumn("state", A.item_state(F.col("state")))


@check("C43", "D")
def stated_counts(v: Vault) -> DataFrame:
    """A number of open items in prose that isn't the table's."""
    said = v.files.where("path LIKE '%/questions.md'").select("kb", "path", T.number(F.regexp_extract("text", rf"(?i)\b({'|'.join(sorted(T.NUMBER_WORDS, key=len, reverse=True))}|[0-9']+) open items?\b", 1)).alias("said")).where("said IS NOT NULL")
    have = items_of(v, "/questions\\.md$").where("state = 'open'").groupBy("kb", "path").agg(F.count(F.lit(1)).alias("n"))
    return said.join(have, ["kb", "path"], "left").where(F.coalesce("n", F.lit(0)) != F.col("said")).select("kb", "path", F.lit("open items stated other than in the table").alias("message"))


@check("C60i", "D")
def items_ahead(v: Vault) -> DataFrame:
    return items_of(v, "/questions\\.md$").where(F.regexp_extract("id", "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1) > v.now[:10]).select("kb", "path", F.concat(F.lit("item dated in the future: "), "id").alias("message"))


@check("C61", "F")
def index_differs(v: Vault) -> DataFrame:
    """An index whose entries aren't the concepts of its folder."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    listed = v.files.where("path LIKE 'Wiki/%/index.md'").select("kb", folder.alias("folder"), F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^\s*[-*]\s+\[[^\]]*\]\(([^)\s/]+\.md)\)"), 1)).alias("name"))
    there = v.concepts.select("kb", folder.alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name")).join(listed.select("kb", "folder").distinct(), ["kb", "folder"], "left_semi")
    both = listed.select("*", F.lit(1).alias("a")).join(there.select("*", F.lit(1).alias("b")), ["kb", "folder", "name"], "full_outer").where("a IS NULL OR b IS NULL")
    return both.select("kb", F.concat("folder", F.lit("/index.md")).alias("path"), F.lit("index differs from its folder").alias("message")).distinct()


@check("C62", "F", "root_index_complete")
def root_index(v: Vault) -> DataFrame:
    """Folders that the root index doesn't link into."""
    folders = v.concepts.select("kb", F.split_part("path", F.lit("/"), F.lit(2)).alias("folder")).where("folder NOT LIKE '%.md'").distinct()
    root = v.files.where("path = 'Wiki/index.md'").select("kb", "text")
    return folders.join(root, "kb", "left").where(~F.coalesce(F.contains("text", F.concat("folder", F.lit("/"))), F.lit(False))).select("kb", F.lit("Wiki/index.md").alias("path"), F.concat(F.lit("root index lacks "), "folder").alias("message"))


@check("C63", "D")
def unknown_state(v: Vault) -> DataFrame:
    return items_of(v, "/questions\\.md$").where("state IS NULL").select("kb", "path", F.concat(F.lit("unknown state of an item: "), "raw_state").alias("message"))


@check("C64", "D", "questions_closed")
def closed_file(v: Vault) -> DataFrame:
    """An id twice or an open item in the closed file, or a closed row left in the open one."""
    closed, still = items_of(v, "/questions-closed\\.md$"), items_of(v, "/questions\\.md$")
    twice = closed.groupBy("kb", "path", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("kb", "path", F.concat(F.lit("closed twice: "), "id").alias("message"))
    live = closed.where("state IN ('open', 'deferred')").select("kb", "path", F.concat(F.lit("open item in the closed file: "), "id").alias("message"))
    left = still.where("state IN ('actioned', 'withdrawn')").select("kb", "path", F.concat(F.lit("closed row left: "), "id").alias("message"))
    return twice.unionByName(live).unionByName(left)


sql("C83", "G", r"SELECT kb, '(bundle)' AS path, concat(count(*), ' undated images whose names carry a date') AS message FROM {citations} WHERE last_modified IS NULL AND page RLIKE r'(?i)\.(png|jpe?g|gif|webp)$' AND page RLIKE r'(?<![0-9])(19|20)[0-9]{2}-?[01][0-9]-?[0-3][0-9](?![0-9])' GROUP BY kb")
sql("C85", "G", "SELECT c.kb, '(bundle)' AS path, concat(count(*), ' citations unverifiable, archive absent') AS message FROM {citations} c LEFT ANTI JOIN (SELECT DISTINCT kb FROM {pages} WHERE layer IN ('OneNote', 'folia')) p ON p.kb = c.kb WHERE " + IN_ARCHIVE + " GROUP BY c.kb")
sql("C90", "D", "SELECT f.kb, f.path, concat('forbidden here: ', substring_index(o.value, ' => ', -1)) AS message FROM {files} f JOIN {options} o ON o.kb = f.kb AND o.key = 'forbid_in' AND f.path = substring_index(o.value, ' => ', 1) AND f.text RLIKE substring_index(o.value, ' => ', -1)", "forbid_in")
sql("C92", "D", r"SELECT kb, path, 'snapshot or meeting note among the files' AS message FROM {files} WHERE path RLIKE r'(^|/)(_snapshots|Meeting Notes)/'")
sql("C96", "D", r"SELECT f.kb, f.path, 'report without a register row' AS message FROM (SELECT kb, path FROM {files} WHERE path RLIKE r'^Outputs/[0-9]{4}-[0-9]{2}-[0-9]{2}[^/]*\.md$') f LEFT JOIN (SELECT kb, concat_ws(' ', collect_list(text)) AS text FROM {files} WHERE path = 'Outputs/REGISTER.md' GROUP BY kb) r ON r.kb = f.kb WHERE NOT coalesce(contains(r.text, substring_index(f.path, '/', -1)), false)")
sql("C96c", "D", "SELECT kb, concept AS path, concat('cites a report: ', page) AS message FROM {citations} WHERE page LIKE 'Outputs/%'")
sql("C98", "D", r"SELECT r.kb, r.path, concat('register names a missing file: ', r.t) AS message FROM (SELECT kb, path, explode(regexp_extract_all(text, r'(?m)^\s*[-*|]\s*`([^`]+\.[a-z]+)`', 1)) AS t FROM {files} WHERE path LIKE '%/_INGESTED.md' OR path = 'Outputs/REGISTER.md') r LEFT ANTI JOIN {files} f ON f.kb = r.kb AND f.path = r.t LEFT ANTI JOIN {files} g ON g.kb = r.kb AND g.path = concat('Outputs/', r.t)")


@check("C99", "D")
def key_figures(v: Vault) -> DataFrame:
    """Rows of a Key figures section have three cells, a number and a defined footnote."""
    reports = v.files.where(F.col("path").startswith("Outputs/") & F.col("text").contains("Key figures")).select(F.concat_ws("|", "kb", "path").alias("doc"), "text")
    lines = W.lines_of(reports)
    rows = W.section(lines, "Key figures").where(W.is_row(F.col("body")) & ~W.is_separator(F.col("body"))).withColumn("no", F.row_number().over(Window.partitionBy("doc").orderBy("line"))).where("no > 1")
    cells = W.row_cells(F.col("body"))
    notes = lines.where(F.col("body").rlike(r"^\[\^[^\]]+\]:")).select("doc", F.regexp_extract("body", r"^\[\^([^\]]+)\]:", 1).alias("label")).distinct()
    judged = rows.select("doc", "line", F.size(cells).alias("n"), F.coalesce(cells[1].rlike("[0-9]"), F.lit(False)).alias("numeric"), F.regexp_extract("body", r"\[\^([^\]]+)\]", 1).alias("label")).join(notes.withColumn("known", F.lit(True)), ["doc", "label"], "left")
    fault = F.when(F.col("n") != 3, "not three cells").when(~F.col("numeric"), "no number").when(F.col("known").isNull(), "no defined footnote")
    return judged.withColumn("fault", fault).where("fault IS NOT NULL").select(F.split_part("doc", F.lit("|"), F.lit(1)).alias("kb"), F.split_part("doc", F.lit("|"), F.lit(2)).alias("path"), F.concat(F.lit("key figures: "), "fault").alias("message"))


@check("C101", "F", "house_style")
def house_style(v: Vault) -> DataFrame:
    """Words that a kb's style bans (option values), in prose."""
    banned = v.options.where("key = 'house_style' AND value <> ''").select("kb", F.lower("value").alias("word"))
    used = v.concepts.select("kb", "path", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("bare"), F.lit(r"((?U)[\w'-]+)"), 1))).alias("word"))
    return used.join(F.broadcast(banned), ["kb", "word"]).groupBy("kb", "path").agg(F.array_join(F.array_sort(F.collect_set("word")), ", ").alias("words")).select("kb", "path", F.concat(F.lit("banned words: "), "words").alias("message"))


def coverage_findings(now: DataFrame, state: DataFrame) -> DataFrame:
    """Kbs whose coverage was never measured or is stale; a change of mirrored pages alone is a gauge."""
    both = now.join(state.select("kb", *(F.col(c).alias(f"was_{c}") for c in ("concepts", "citations", "pages", "mirror_pages", "covered"))), "kb", "left")
    own = (F.col("concepts") != F.col("was_concepts")) | (F.col("citations") != F.col("was_citations")) | (F.col("covered") != F.col("was_covered")) | (F.col("pages") - F.col("mirror_pages") != F.col("was_pages") - F.col("was_mirror_pages"))
    message = F.when(F.col("was_concepts").isNull(), "coverage never measured").when(own, "coverage is stale").when(F.col("mirror_pages") != F.col("was_mirror_pages"), "coverage differs in mirrored pages alone")
    severity = F.when(F.col("was_concepts").isNotNull() & ~own, "G").otherwise("D")
    return both.withColumn("message", message).where("message IS NOT NULL").select("kb", F.lit("COVERAGE.md").alias("path"), F.lit("C65").alias("check_id"), severity.alias("severity"), "message")


def pairs_past_grace(unread: DataFrame, files: DataFrame, day: str, grace: int) -> DataFrame:
    """Unread pairs both of whose concepts (kb, path, modified) have stood longer than the days of grace."""
    a, b = files.select("kb", F.col("path").alias("a"), F.col("modified").alias("ma")), files.select("kb", F.col("path").alias("b"), F.col("modified").alias("mb"))
    old = unread.join(a, ["kb", "a"]).join(b, ["kb", "b"]).where(F.datediff(F.lit(day).cast("date"), F.greatest("ma", "mb")) > grace)
    return old.groupBy("kb").agg(F.count(F.lit(1)).alias("n")).select("kb", F.lit("(bundle)").alias("path"), F.lit("C70").alias("check_id"), F.lit("F").alias("severity"), F.concat(F.col("n").cast("string"), F.lit(" pairs unread past grace")).alias("message"))


def stamps_behind_history(v: Vault, commits: DataFrame) -> DataFrame:
    """How many concepts carry a stamp older than their file's last commit (kb, path, committed)."""
    late = v.concepts.join(commits, ["kb", "path"]).where(F.left("generated.at", F.lit(10)) < F.left("committed", F.lit(10)))
    return late.groupBy("kb").agg(F.count(F.lit(1)).alias("n")).select("kb", F.lit("(bundle)").alias("path"), F.lit("C82").alias("check_id"), F.lit("G").alias("severity"), F.concat(F.col("n").cast("string"), F.lit(" stamps older than the last commit")).alias("message"))


def standing_gauges(gauges: DataFrame, before: DataFrame) -> DataFrame:
    """Gauges that stood in the run before, numbers aside, as findings."""
    shape = lambda d: d.withColumn("shape", T.message_shape(F.col("message")))
    again = shape(gauges).join(shape(before).select("kb", "shape").distinct(), ["kb", "shape"], "left_semi")
    return again.select("kb", "path", F.lit("C86").alias("check_id"), F.lit("F").alias("severity"), F.concat(F.lit("standing: "), "shape").alias("message")).distinct()


def package_drift(source: DataFrame, package: DataFrame) -> DataFrame:
    """Files (path, digest) that a package lacks, has besides, or holds otherwise."""
    return J.snapshot_diff(source, package)


@check("N1", "F")
def never_written(v: Vault, least: int = 3) -> DataFrame:
    """Capitalised two-word names in three or more concepts that have no concept themselves."""
    prose = v.lines.where(~F.col("body").rlike(r"^\s*(#|\||\[\^)"))
    names = prose.select("kb", "concept", F.explode(F.regexp_extract_all("body", F.lit(r"(?U)\b([A-Z][a-z]\w+ [A-Z][a-z]\w+)\b"), 1)).alias("name")).withColumn("slug", T.slug(F.col("name")))
    known = v.concepts.select("kb", F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("slug"))
    months = [m for group in T.MONTHS for m in group]
    words = F.transform(F.split("name", " "), lambda w: F.lower(w))
    often = names.where(~F.arrays_overlap(words, F.array(*map(F.lit, months)))).join(known, ["kb", "slug"], "left_anti").groupBy("kb", "name").agg(F.countDistinct("concept").alias("n")).where(F.col("n") >= least)
    return often.select("kb", F.lit("(bundle)").alias("path"), F.concat(F.lit("mentioned but never written: "), "name").alias("message"))


def findings(v: Vault, only: list[str] | None = None) -> DataFrame:
    """All findings: (kb, path, check_id, severity, message)."""
    names = [name for name in CHECKS if not only or name in only]
    parts = []
    if len(own := [name for name in names if name in CONDITIONS]) > 1:
        parts.append(own_rows(v, own))
        names = [name for name in names if name not in CONDITIONS]
    for name in names:
        severity, option, run = CHECKS[name]
        rows = run(v).select("kb", "path", F.lit(name).alias("check_id"), F.lit(severity).alias("severity"), "message")
        if option:
            rows = rows.join(F.broadcast(v.options.where(F.col("key") == option).select("kb").distinct()), "kb", "left_semi")
        parts.append(rows)
    if len(parts) > TOGETHER:
        groups = [parts[i : i + TOGETHER] for i in range(0, len(parts), TOGETHER)]
        parts = [materialise(reduce(DataFrame.unionByName, group), "findings") for group in groups]
    return reduce(DataFrame.unionByName, parts)


def own_rows(v: Vault, names: list[str]) -> DataFrame:
    """The findings of several checks that judge a concept by its own row, in one scan of the concepts."""
    cases = []
    for name in names:
        (condition, message), (severity, option, _) = CONDITIONS[name], CHECKS[name]
        given = f"'{option}'" if option else "CAST(NULL AS STRING)"
        cases.append(f"CASE WHEN {condition} THEN struct('{name}' AS check_id, '{severity}' AS severity, '{message}' AS message, {given} AS asked) END")
    rows = selected(v, f"SELECT kb, path, inline(filter(array({', '.join(cases)}), one -> one IS NOT NULL)) FROM {{concepts}}")
    given = F.broadcast(v.options.select("kb", F.col("key").alias("asked"), F.lit(True).alias("given")).distinct())
    return rows.join(given, ["kb", "asked"], "left").where("asked IS NULL OR given").select("kb", "path", "check_id", "severity", "message")


def audit(v: Vault, clock: DataFrame, waivers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q15: findings, with those that stand too long as defects unless waived, and the next clock."""
    rows = findings(v)
    audited = v.files.select("kb").distinct()
    after = S.tick(clock, rows.where("severity <> 'D'"), audited, v.now[:10])
    old = S.escalated(after, waivers).where("NOT waived").select("kb", "path", "message", F.lit(True).alias("old"))
    judged = rows.join(old, ["kb", "path", "message"], "left").withColumn("severity", F.when(F.col("old") & (F.col("severity") == "F"), "D").otherwise(F.col("severity"))).drop("old")
    return judged, after


def report(rows: DataFrame, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """The first findings, and the rest by shape."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("kb").orderBy("severity", "path", "message")))
    return ranked.where(F.col("rank") <= most).drop("rank"), A.shapes(ranked.where(F.col("rank") > most))
