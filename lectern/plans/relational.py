"""Queries of the relational operators, over driver tables that carry the same relations.

Documents that cite: suppliers (or customers) with the parts of their line
items. Pages: parts, with brand as chapter and type as scope.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import aggregates as A, graph as G, joins as J, state as S, windows as W
from lectern.session import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def supplies(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("concept"), F.col("l_partkey").alias("page"))


@query("""WITH e AS (SELECT DISTINCT o_custkey AS doc, l_partkey AS source FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT x.doc AS a, y.doc AS b, count(*) AS overlap FROM e x JOIN e y ON x.source = y.source AND x.doc < y.doc GROUP BY ALL HAVING count(*) >= 3""")
def j3_shared_source_pairs(spark, d):
    cites = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("concept"), F.col("l_partkey").alias("page"))
    return J.shared_source_pairs(cites, 3)


@query("""WITH e AS (SELECT DISTINCT o_custkey AS doc, l_partkey AS source FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT x.doc AS changed, y.doc AS doc, count(*) AS overlap FROM e x JOIN e y ON x.source = y.source AND x.doc <> y.doc WHERE x.doc % 50 = 0 GROUP BY ALL HAVING count(*) >= 2""")
def n2_coupled_documents(spark, d):
    cites = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("concept"), F.col("l_partkey").alias("page"))
    return J.coupled(cites, cites.where("concept % 50 = 0"), 2)


@query("SELECT doc_id AS page, quality FROM labels WHERE NOT EXISTS (SELECT 1 FROM documents x WHERE x.doc_id = labels.doc_id AND x.lang = 'en')")
def j1_unresolved_citations(spark, d):
    files = table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("page"))
    return J.unresolved(table(spark, d, "labels").select(F.col("doc_id").alias("page"), "quality"), files)


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def j2_sources_without_label(spark, d):
    return J.one_sided(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"])


@query("""WITH c AS (SELECT l_partkey AS page, max(l_shipdate) AS changed FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT c.page, c.changed, l_orderkey AS concept, o_orderdate AS written FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN c ON c.page = l_partkey WHERE o_orderdate < c.changed""")
def j4_behind_changed_pages(spark, d):
    items = table(spark, d, "lineitem")
    changes = items.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("page"), F.col("l_shipdate").alias("changed"))
    cites = items.join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return J.behind(changes, cites.select(F.col("l_orderkey").alias("concept"), F.col("l_partkey").alias("page"), F.col("o_orderdate").alias("written")))


def marked_parts(spark, d):
    pages = table(spark, d, "part").select(F.col("p_partkey").alias("page"), F.lit("parts").alias("kb"), F.col("p_brand").alias("chapter"), F.col("p_type").alias("scope"))
    cited = table(spark, d, "lineitem").where("l_discount >= 0.05 AND l_quantity > 40").select(F.col("l_partkey").alias("page"))
    return J.coverage(pages, cited, table(spark, d, "part").where("p_size < 20").select(F.col("p_partkey").alias("page")))


MARKED = """WITH m AS (SELECT p_partkey AS page, 'parts' AS kb, p_brand AS chapter, p_type AS scope,
  CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount >= 0.05 AND l_quantity > 40) THEN 'cited' WHEN p_size < 20 THEN 'nil' ELSE 'open' END AS state FROM part)
"""


@query(MARKED + "SELECT page, kb, chapter, scope, state FROM m")
def j5_page_coverage(spark, d):
    return marked_parts(spark, d)


@query(MARKED + """SELECT kb, chapter, scope, CASE grouping(chapter) + grouping(scope) WHEN 0 THEN 'scope' WHEN 1 THEN 'chapter' ELSE 'kb' END AS level, CAST(count(*) AS BIGINT) AS pages,
  CAST(sum(CASE WHEN state = 'cited' THEN 1 ELSE 0 END) AS BIGINT) AS cited, CAST(sum(CASE WHEN state = 'nil' THEN 1 ELSE 0 END) AS BIGINT) AS nil, 100.0::DOUBLE * sum(CASE WHEN state <> 'open' THEN 1 ELSE 0 END) / count(*) AS percent
FROM m GROUP BY GROUPING SETS ((kb, chapter, scope), (kb, chapter), (kb))""")
def a1_coverage_table(spark, d):
    return A.coverage_table(marked_parts(spark, d))


@query(MARKED + """, n AS (SELECT kb, scope, count(*) AS n FROM m WHERE state = 'open' GROUP BY ALL)
SELECT kb, scope, n FROM n QUALIFY row_number() OVER (PARTITION BY kb ORDER BY n DESC, scope) = 1""")
def n5_largest_open_scope(spark, d):
    return A.largest_scope(marked_parts(spark, d))


FINGER = """WITH f AS (SELECT doc_id, md5(regexp_replace(trim(text), '\\s+', ' ', 'g')) AS body, md5(text) AS strict, split_part(text, ' ', 1) AS title, lang AS date FROM documents),
o AS (SELECT CAST(doc_id // 2 AS VARCHAR) AS path, body, strict, title, date FROM f WHERE doc_id % 2 = 0), n AS (SELECT CAST(doc_id // 2 AS VARCHAR) AS path, body, strict, title, date FROM f WHERE doc_id % 2 = 1)
"""


def halves(spark, d):
    f = table(spark, d, "documents").select(
        F.expr("CAST(doc_id DIV 2 AS STRING)").alias("path"), (F.col("doc_id") % 2).alias("half"),
        F.md5(F.regexp_replace(F.trim("text"), r"\s+", " ")).alias("body"), F.md5("text").alias("strict"), F.split_part("text", F.lit(" "), F.lit(1)).alias("title"), F.col("lang").alias("date"),
    )
    return f.where("half = 0").drop("half"), f.where("half = 1").drop("half")


@query(FINGER + """, b AS (SELECT body, count(*) AS nb, min(path) AS bp FROM n GROUP BY 1), t AS (SELECT title, date, count(*) AS nt, min(path) AS tp FROM n GROUP BY 1, 2),
j AS (SELECT o.path AS old_path, h.path IS NOT NULL AND (coalesce(nb, 0) = 0 OR h.body = o.body) AS stays, h.strict = o.strict AS eq, coalesce(nb, 0) AS nb, bp, coalesce(nt, 0) AS nt, tp
  FROM o LEFT JOIN b ON b.body = o.body LEFT JOIN n h ON h.path = o.path LEFT JOIN t ON t.title = o.title AND t.date = o.date),
r AS (SELECT old_path, CASE WHEN stays AND eq THEN 'SAME' WHEN stays THEN 'EDITED' WHEN nb = 1 THEN 'MOVED' WHEN nb > 1 THEN 'AMBIGUOUS' WHEN nt = 1 THEN 'MOVED' WHEN nt > 1 THEN 'AMBIGUOUS' ELSE 'GONE' END AS verdict,
  CASE WHEN stays THEN old_path WHEN nb = 1 THEN bp WHEN nb = 0 AND nt = 1 THEN tp END AS new_path FROM j)
SELECT * FROM r UNION ALL SELECT NULL, 'NEW', path FROM n WHERE path NOT IN (SELECT old_path FROM r) AND path NOT IN (SELECT new_path FROM r WHERE new_path IS NOT NULL)""")
def j6_export_remap(spark, d):
    return J.remap(*halves(spark, d))


@query(FINGER + """SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'ADDED' WHEN n.path IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS change FROM o FULL JOIN n USING (path) WHERE o.strict IS DISTINCT FROM n.strict""")
def j13_snapshot_diff(spark, d):
    old, new = halves(spark, d)
    return J.snapshot_diff(old, new, "path", "strict")


@query("""SELECT item_id AS block FROM benchmark WHERE NOT EXISTS (SELECT 1 FROM documents WHERE (contains(documents.text, benchmark.text)
  OR contains(documents.text, (CASE WHEN left(benchmark.text, 1) = upper(left(benchmark.text, 1)) THEN lower(left(benchmark.text, 1)) ELSE upper(left(benchmark.text, 1)) END) || substr(benchmark.text, 2))))""")
def j7_quotes_in_no_page(spark, d):
    quotes = table(spark, d, "benchmark").select(F.col("item_id").alias("block"), F.array("text").alias("parts"))
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("page"), "text")
    # A document can only hold a passage if it has the longest of its inner words; a passage without one asks all documents.
    words = F.regexp_extract_all("text", F.lit(r"((?U)\w+)"), 1)
    inner = F.transform(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    wanted = table(spark, d, "benchmark").select(F.col("item_id").alias("block"), F.coalesce(F.array_max(inner)["w"], F.lit("")).alias("word"))
    held = pages.select("page", F.explode(F.array_append(F.array_distinct(words), F.lit(""))).alias("word"))
    first = pages.agg(F.min("page").alias("page"))
    cites = wanted.join(held, "word").select("block", "page").unionByName(wanted.select("block").join(F.broadcast(first)).select("block", "page")).distinct()
    return J.missing_quotes(quotes, cites, pages).select("block")


@query("SELECT p_partkey AS file FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AND p_size >= 10 AND p_retailprice < 1500")
def j8_files_without_fate(spark, d):
    part = table(spark, d, "part")
    f = part.select(F.col("p_partkey").alias("file"), "p_size", "p_retailprice")
    return J.without_fate(f.select("file"), table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("file")), f.where("p_size < 10"), f.where("p_retailprice >= 1500"))


@query("""WITH a AS (SELECT o_custkey AS page, list(DISTINCT o_orderpriority) AS names FROM orders GROUP BY 1)
SELECT conv_id AS claim, conv_id % 150 + 1 AS page FROM (SELECT DISTINCT conv_id FROM conversations) JOIN a ON a.page = conv_id % 150 + 1 WHERE NOT list_contains(a.names, '1-URGENT')""")
def j9_misattributed_claims(spark, d):
    claims = table(spark, d, "conversations").select(F.col("conv_id").alias("claim")).distinct().select("claim", (F.col("claim") % 150 + 1).alias("page"), F.array(F.lit("1-URGENT")).alias("names"))
    actors = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("page")).agg(F.collect_set("o_orderpriority").alias("names"))
    return J.misattributed(claims, actors).select("claim", "page")


@query("""WITH s AS (SELECT o_custkey AS concept, max(strftime(o_orderdate, '%Y-%m-%d')) FILTER (strftime(o_orderdate, '%Y-%m-%d') <= '1998-06-30') AS newest_source FROM orders GROUP BY 1)
SELECT c_custkey AS concept, c_name AS text, '1998-01-01' AS period_end, newest_source FROM customer JOIN s ON s.concept = c_custkey WHERE newest_source > '1998-01-01'""")
def j10_passed_claims(spark, d):
    claims = table(spark, d, "customer").select(F.col("c_custkey").alias("concept"), F.col("c_name").alias("text"), F.lit("1998-01-01").alias("period_end"))
    sources = table(spark, d, "orders").select(F.col("o_custkey").alias("concept"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("last_modified"))
    return J.passed_claims(claims, sources, "1998-06-30")


@query("SELECT p_partkey AS page, p_type FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_tax >= 0.08 UNION SELECT p_partkey FROM part WHERE p_size < 5)")
def j11_unread_pages(spark, d):
    part = table(spark, d, "part").withColumnRenamed("p_partkey", "page")
    return J.unread(part.select("page", "p_type"), table(spark, d, "lineitem").where("l_tax >= 0.08").select(F.col("l_partkey").alias("page")), part.where("p_size < 5"))


@query("""WITH w AS (SELECT l_suppkey % 7 AS writer, l_partkey AS target FROM lineitem)
SELECT target, array_to_string(list_sort(list(DISTINCT writer)), ',') AS writers FROM w GROUP BY 1 HAVING count(DISTINCT writer) > 1""")
def j19_lost_writes(spark, d):
    w = table(spark, d, "lineitem").select((F.col("l_suppkey") % 7).alias("writer"), F.col("l_partkey").alias("target"))
    return J.lost_writes(w).select("target", F.array_join(F.transform("writers", lambda x: x.cast("string")), ",").alias("writers"))


@query("""SELECT o_custkey AS report FROM orders GROUP BY 1 HAVING bool_and(o_orderstatus IN ('F', 'P'))""")
def j20_frozen_scopes(spark, d):
    reports = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("report")).agg(F.collect_set("o_orderstatus").alias("scope"))
    return J.within(reports, spark.createDataFrame([("F",), ("P",)], "kb string"))


@query("SELECT DISTINCT l_partkey AS page FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part) AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 2)")
def j22_unmeasured_pages(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("page"), "p_size")
    return J.unmeasured(table(spark, d, "lineitem").select(F.col("l_partkey").alias("page")), part, part.where("p_size > 2"))


@query("""SELECT o_orderkey AS concept, strftime(o_orderdate, '%Y-%m-%d') AS stale_after, CASE WHEN strftime(o_orderdate, '%Y-%m-%d') < '1998-01-01' THEN 'past' ELSE 'soon' END AS "when" FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') <= '1998-01-31'""")
def j23_stale_split(spark, d):
    return J.stale_split(table(spark, d, "orders").select(F.col("o_orderkey").alias("concept"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("stale_after")), "1998-01-01")


@query("""SELECT doc_id AS id FROM documents WHERE lang IN ('en', 'fr') AND list_has_all(regexp_extract_all(lower(text), '[a-z0-9]+'), ['the', 'of', 'and'])""")
def j24_items_on_topic(spark, d):
    items = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("item"), F.when(F.col("lang") == "en", "open").when(F.col("lang") == "fr", "deferred").otherwise("done").alias("state"))
    return J.on_topic(items, "of the and").select("id")


@query("""WITH l AS (SELECT p_partkey AS target, p_name AS gloss FROM part WHERE p_size % 3 <> 0), c AS (SELECT p_partkey AS target, CASE WHEN p_size % 5 = 0 THEN p_type ELSE p_name END AS description FROM part WHERE p_size % 2 = 0)
SELECT target, CASE WHEN c.description IS NULL THEN 'drop' WHEN l.gloss IS NULL THEN 'add' WHEN l.gloss <> c.description THEN 'refresh' ELSE 'keep' END AS action FROM l FULL JOIN c USING (target)""")
def j26_index_against_directory(spark, d):
    part = table(spark, d, "part")
    listed = part.where("p_size % 3 <> 0").select(F.col("p_partkey").alias("target"), F.col("p_size").alias("position"), F.col("p_name").alias("gloss"))
    concepts = part.where("p_size % 2 = 0").select(F.col("p_partkey").alias("target"), F.col("p_brand").alias("title"), F.when(F.col("p_size") % 5 == 0, F.col("p_type")).otherwise(F.col("p_name")).alias("description"))
    return J.listed_against_directory(listed, concepts).select("target", "action")


@query("""SELECT md5(text) AS body_md5, count(*) AS n, min(doc_id) AS first_path FROM documents WHERE n_chars >= 40 GROUP BY 1 HAVING count(*) > 1""")
def a3_duplicate_groups(spark, d):
    return A.copies(table(spark, d, "documents").select(F.md5("text").alias("body_md5"), F.col("doc_id").alias("path"), F.col("n_chars").alias("chars")))


@query("SELECT l_suppkey AS dst, count(*) AS n FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1")
def a4_inbound_links(spark, d):
    return A.inbound(table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))


EDGES = "SELECT l_partkey + 1000000 AS src, l_suppkey AS dst FROM lineitem"


def part_links(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_partkey") + 1000000).alias("src"), F.col("l_suppkey").alias("dst"))


@query(f"""WITH RECURSIVE l AS ({EDGES}), e AS (SELECT src AS a, dst AS b FROM l UNION SELECT dst, src FROM l),
r(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, min(r.component) FROM r JOIN e ON e.a = r.node JOIN recurring.r AS o ON o.node = e.b WHERE r.component < o.component GROUP BY e.b)
SELECT node, component FROM r""")
def g4_connected_components(spark, d):
    return G.connected_components(part_links(spark, d), "src", "dst")


@query(f"WITH l AS ({EDGES}) SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM l WHERE src <> dst")
def g2_undirected_edges(spark, d):
    return G.undirected(part_links(spark, d))


@query(f"WITH l AS ({EDGES}) SELECT s_suppkey AS node FROM supplier WHERE s_suppkey NOT IN (SELECT dst FROM l)")
def g3_isolates(spark, d):
    return G.isolates(table(spark, d, "supplier").select(F.col("s_suppkey").alias("node")), part_links(spark, d))


@query(f"WITH l AS ({EDGES}) SELECT dst, array_to_string(list_sort(list(DISTINCT src)), ',') AS sources FROM l GROUP BY 1")
def g6_backlinks(spark, d):
    return G.backlinks(part_links(spark, d)).select("dst", F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"))


@query(f"""WITH l AS ({EDGES}), n AS (SELECT src AS node FROM l UNION SELECT dst FROM l UNION SELECT s_suppkey FROM supplier), i AS (SELECT dst AS node, count(DISTINCT src) AS k FROM l GROUP BY 1), o AS (SELECT src AS node, count(DISTINCT dst) AS k FROM l GROUP BY 1)
SELECT node, coalesce(i.k, 0) AS inbound, coalesce(o.k, 0) AS outbound, CASE WHEN i.k IS NULL AND o.k IS NULL THEN 'alone' WHEN i.k IS NULL THEN 'unreached' WHEN i.k >= 3 THEN 'hub' ELSE 'plain' END AS shape FROM n LEFT JOIN i USING (node) LEFT JOIN o USING (node)""")
def n4_orphan_shapes(spark, d):
    links = part_links(spark, d)
    nodes = links.select(F.col("src").alias("node")).unionByName(links.select(F.col("dst").alias("node"))).unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("node")))
    return G.orphan_shapes(nodes, links, 3)


@query("""WITH RECURSIVE m AS (SELECT min(l_partkey) AS new, l_suppkey + 100000 AS old FROM lineitem GROUP BY l_suppkey UNION ALL SELECT s_suppkey + 100000, s_suppkey + 200000 FROM supplier),
r AS (SELECT old, new FROM m UNION ALL SELECT r.old, m.new FROM r JOIN m ON m.old = r.new) SELECT old, new FROM r WHERE new NOT IN (SELECT old FROM m)""")
def g5_move_chains(spark, d):
    first = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") + 100000).alias("old")).agg(F.min("l_partkey").alias("new"))
    second = table(spark, d, "supplier").select((F.col("s_suppkey") + 200000).alias("old"), (F.col("s_suppkey") + 100000).alias("new"))
    return G.chain_ends(first.unionByName(second))


@query("""WITH v AS (SELECT DISTINCT l_partkey AS page, l_returnflag AS v FROM lineitem) SELECT page, count(*) AS n, array_to_string(list_sort(list(v)), ',') AS "values" FROM v GROUP BY 1 HAVING count(*) > 1""")
def a8_split_values(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("page"), "l_returnflag")
    return A.split_values(rows, "l_returnflag").select("page", "n", F.array_join("values", ",").alias("values"))


@query("""SELECT c_nationkey AS kb, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def a10_items_by_state(spark, d):
    items = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("kb"), F.col("o_orderstatus").alias("state"))
    return A.items_by_state(items, ("F", "O", "P"))


@query("""WITH w AS (SELECT user_id AS kb, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS "view", count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1)
SELECT kb, 'click' AS queue, click AS n FROM w UNION ALL SELECT kb, 'view', "view" FROM w UNION ALL SELECT kb, 'purchase', purchase FROM w UNION ALL SELECT kb, 'total', click + purchase FROM w""")
def a11_queue_lengths(spark, d):
    wide = table(spark, d, "events").groupBy(F.col("user_id").alias("kb")).pivot("event_type", ["click", "view", "purchase"]).agg(F.count(F.lit(1))).na.fill(0)
    return A.queue_lengths(wide, ["click", "view", "purchase"], ("view",))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2) SELECT user_id, event_type, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1""")
def a13_most_common(spark, d):
    return A.most_common(table(spark, d, "events"), "user_id", "event_type", "event_id")


@query("""WITH h AS (SELECT o_custkey AS person, o_orderpriority AS family, o_orderkey AS page FROM orders)
SELECT person, family, count(DISTINCT page) AS pages FROM h GROUP BY 1, 2 UNION ALL SELECT person, 'union', count(DISTINCT page) FROM h GROUP BY 1""")
def a6_name_counts(spark, d):
    return A.name_counts(table(spark, d, "orders").select(F.col("o_custkey").alias("person"), F.col("o_orderpriority").alias("family"), F.col("o_orderkey").alias("page")))


@query("""WITH h AS (SELECT o_custkey AS person, count(*) AS u, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'F') > 0), r AS (SELECT u / f AS ratio, row_number() OVER (ORDER BY u / f) AS rn, count(*) OVER () AS n FROM h)
SELECT median(ratio) AS median, max(ratio) FILTER (rn = greatest(1, CAST(floor(n * 0.9) AS BIGINT))) AS p90, count(*) AS people FROM r""")
def a7_name_calibration(spark, d):
    orders = table(spark, d, "orders")
    hits = orders.select(F.col("o_custkey").alias("person"), F.when(F.col("o_orderstatus") == "F", "full").otherwise("other").alias("family"), F.col("o_orderkey").alias("page"))
    return A.calibration(A.name_counts(hits))


@query("""SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def w10_newest_per_key(spark, d):
    return W.newest(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")])


@query("""WITH u AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, page_id FROM pages) SELECT host, max(page_id) AS page_id FROM u GROUP BY 1""")
def s11_newest_version(spark, d):
    pages = table(spark, d, "pages").select(F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), "page_id")
    return W.newest(pages, ["host"], [F.desc("page_id")])


@query("""WITH l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents), k AS (SELECT doc, line, body, md5(trim(body)) AS key FROM l WHERE length(trim(body)) >= 1),
m AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc, line) = 1 AS novel FROM k), c AS (SELECT doc, count(*) FILTER (novel) AS novel, count(*) FILTER (NOT novel) AS carried, coalesce(sum(strlen(body)) FILTER (NOT novel), 0) AS bytes_saved FROM m GROUP BY 1)
SELECT doc_id AS doc, coalesce(novel, 0) AS novel, coalesce(carried, 0) AS carried, CAST(coalesce(bytes_saved, 0) AS BIGINT) AS bytes_saved FROM documents LEFT JOIN c ON c.doc = doc_id""")
def w9_line_novelty(spark, d):
    return W.line_novelty(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"))


@query("""SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) - 1) // 50 AS BIGINT) AS batch FROM orders""")
def w8_reading_batches(spark, d):
    return W.batches(table(spark, d, "orders").withColumn("p", -F.col("o_totalprice")), ["p", "o_orderkey"], 50, ["o_orderpriority"]).select("o_orderkey", "batch")


@query("""WITH v AS (SELECT user_id AS tbl, event_id AS line, value AS v, lag(value) OVER w AS a, lead(value) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT tbl, line, v FROM v WHERE a <= b AND (v < a OR v > b)""")
def w7_lone_strays(spark, d):
    return W.lone_strays(table(spark, d, "events").select(F.col("user_id").alias("tbl"), F.col("event_id").alias("line"), F.col("value").alias("v")))


@query("""WITH l AS (SELECT conv_id AS doc, turn AS line, role = 'user' AS m FROM conversations), s AS (SELECT *, CASE WHEN m AND NOT coalesce(lag(m) OVER (PARTITION BY doc ORDER BY line), false) THEN 1 ELSE 0 END AS st FROM l)
SELECT doc, line, CAST(sum(st) OVER (PARTITION BY doc ORDER BY line) AS BIGINT) AS run FROM s QUALIFY m""")
def w3_islands(spark, d):
    lines = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("line"), "role")
    return W.islands(lines, F.col("role") == "user").select("doc", "line", "run")


@query("""WITH h AS (SELECT l_partkey AS dst, count(*) AS n FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY 1 ORDER BY n DESC, dst LIMIT 40), w AS (SELECT dst AS doc, 'linked' AS reason FROM h UNION SELECT p_partkey, 'changed' FROM part WHERE p_size = 7)
SELECT doc, string_agg(reason, ', ' ORDER BY reason) AS reasons FROM w GROUP BY 1""")
def w11_read_set(spark, d):
    links = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return W.read_set(links, table(spark, d, "part").where("p_size = 7").select(F.col("p_partkey").alias("doc")), 40)


DAYS = "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS run FROM events"


@query(f"""WITH s AS ({DAYS}), o AS (SELECT run, row_number() OVER (ORDER BY run) AS no FROM (SELECT DISTINCT run FROM s)), p AS (SELECT *, no - row_number() OVER (PARTITION BY user_id, event_type ORDER BY no) AS isl FROM s JOIN o USING (run))
SELECT user_id, event_type, count(*) AS length, CAST(min(run) AS VARCHAR) AS since FROM p GROUP BY user_id, event_type, isl HAVING max(run) = (SELECT max(run) FROM o)""")
def st1_standing_runs(spark, d):
    seen = table(spark, d, "events").select("user_id", "event_type", F.to_date("ts").alias("run")).distinct()
    return S.standing_runs(seen, seen, ["user_id", "event_type"]).withColumn("since", F.col("since").cast("string"))


@query("""WITH b AS (SELECT user_id AS kb, event_type AS queue, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS was, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS now FROM events GROUP BY 1, 2)
SELECT kb, queue, was, now, CAST(CASE WHEN now = 0 THEN 2 WHEN now < was THEN 0 ELSE 1 END AS INTEGER) AS code FROM b""")
def st6_loop_guard(spark, d):
    events = table(spark, d, "events").select(F.col("user_id").alias("kb"), F.col("event_type").alias("queue"), "ts")
    count = lambda rows: rows.groupBy("kb", "queue").agg(F.count(F.lit(1)).alias("n"))
    return S.loop_guard(count(events.where("ts < timestamp '2024-01-16'")), count(events.where("ts >= timestamp '2024-01-16'")))


@query("""WITH a AS (SELECT o_custkey AS q, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1), b AS (SELECT o_custkey AS q, count(*) FILTER (o_orderstatus = 'O') AS n FROM orders GROUP BY 1)
SELECT q AS item, q AS query, a.n, b.n AS now, CASE WHEN b.n = 0 THEN 'fixed?' WHEN a.n <> b.n THEN 'changed' ELSE 'still holds' END AS verdict FROM a JOIN b USING (q)""")
def st7_remeasured_counts(spark, d):
    orders = table(spark, d, "orders")
    recorded = orders.where("o_orderdate < timestamp '1997-01-01'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).select(F.col("o_custkey").alias("item"), F.col("o_custkey").alias("query"), "n")
    return S.remeasured(recorded, orders.groupBy(F.col("o_custkey").alias("query")).agg(F.count_if(F.col("o_orderstatus") == "O").alias("n"))).drop("rank")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def o4_changed_since(spark, d):
    return table(spark, d, "orders").where("o_orderdate >= timestamp '1998-01-01'").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50)


@query("""WITH g AS (SELECT c_custkey AS doc, c_nationkey AS grp FROM customer), l AS (SELECT a.l_suppkey % 1500 + 1 AS src, a.l_partkey % 1500 + 1 AS dst FROM lineitem a)
SELECT least(x.grp, y.grp) AS one, greatest(x.grp, y.grp) AS other, count(*) AS n FROM l JOIN g x ON x.doc = src JOIN g y ON y.doc = dst WHERE x.grp <> y.grp GROUP BY 1, 2 HAVING count(*) >= 10""")
def a17_group_links(spark, d):
    groups = table(spark, d, "customer").select(F.col("c_custkey").alias("doc"), F.col("c_nationkey").alias("grp"))
    links = table(spark, d, "lineitem").select((F.col("l_suppkey") % 1500 + 1).alias("src"), (F.col("l_partkey") % 1500 + 1).alias("dst"))
    return A.group_links(links, groups)


@query("""SELECT (SELECT count(*) FROM documents) AS scanned, (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS read, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS unread""")
def a18_read_arithmetic(spark, d):
    return A.read_arithmetic(table(spark, d, "documents").select(F.col("doc_id").alias("doc")), table(spark, d, "labels").select(F.col("doc_id").alias("doc")))


@query("""SELECT o_custkey AS concept, min(strftime(o_orderdate, '%Y-%m-%d')) AS born, CAST(min(year(o_orderdate) * 372 + month(o_orderdate) * 31 + day(o_orderdate)) AS INTEGER) AS born_day FROM orders GROUP BY 1""")
def a19_first_seen(spark, d):
    return A.first_seen(table(spark, d, "orders").select(F.col("o_custkey").alias("concept"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("last_modified")))


@query("""SELECT regexp_replace(l_comment, '[0-9]+', 'N', 'g') AS shape, count(*) AS n FROM (SELECT 'order ' || CAST(l_orderkey AS VARCHAR) || ' ships by ' || l_returnflag AS l_comment FROM lineitem) GROUP BY 1""")
def a9_finding_shapes(spark, d):
    return A.shapes(table(spark, d, "lineitem").select(F.concat(F.lit("order "), F.col("l_orderkey").cast("string"), F.lit(" ships by "), F.col("l_returnflag")).alias("message")))


@query("""WITH q AS (SELECT doc_id AS id, array_to_string(regexp_extract_all(lower(text), '[\\pL\\pN_]+'), ' ') AS norm FROM documents) SELECT md5(norm) AS norm, count(*) AS n, min(id) AS first_id FROM q WHERE norm <> '' GROUP BY norm HAVING count(*) > 1""")
def n8_repeated_questions(spark, d):
    return A.repeated_questions(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")).withColumn("norm", F.md5("norm"))


@query("""SELECT CAST(year(ts) AS VARCHAR) || '-Q' || CAST(quarter(ts) AS VARCHAR) AS quarter, event_type AS class, CASE WHEN user_id % 2 = 0 THEN 'owner' ELSE 'audit' END AS "by", count(*) AS n FROM events GROUP BY 1, 2, 3""")
def n7_caught_by(spark, d):
    return A.caught_by(table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("class"), F.when(F.col("user_id") % 2 == 0, "owner").otherwise("audit").alias("by")))
