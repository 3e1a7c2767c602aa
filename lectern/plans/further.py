"""More operators over driver tables: registers, aliases, state, projections, orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import aggregates as A, graph as G, joins as J, search as R, state as S, windows as W
from lectern.plans import composites as C
from lectern.plans.relational import marked_parts, query
from lectern.sources import sinks, vault
from lectern.session import table


@query("""WITH n AS (SELECT conv_id AS note FROM conversations GROUP BY 1) SELECT note FROM n WHERE note NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')""")
def j12_uncited_notes(spark, d):
    c = table(spark, d, "conversations")
    return J.without_fate(c.select(F.col("conv_id").alias("note")).distinct(), c.where("role = 'system'").select(F.col("conv_id").alias("note")), key="note")


@query("""WITH t AS (SELECT doc_id, text, doc_id % 7 AS shift FROM documents), g AS (SELECT doc_id, text, substr(text, 1, 100 + shift) AS gloss FROM t)
SELECT doc_id AS source FROM g WHERE length(gloss) BETWEEN 100 AND 115 AND length(text) > length(gloss) AND regexp_matches(substr(text, length(gloss), 2), '^[\\pL\\pN_]{2}$')""")
def j14_cut_glosses(spark, d):
    docs = table(spark, d, "documents")
    glosses = docs.select(F.col("doc_id").alias("source"), F.col("doc_id").alias("target"), F.substring("text", F.lit(1), 100 + F.col("doc_id") % 7).alias("gloss"))
    return J.cut_glosses(glosses, docs.select(F.col("doc_id").alias("concept"), F.col("text").alias("description"))).select("source")


@query("""WITH w AS (SELECT lang AS kb, doc_id AS doc, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\pL\\pN_]+'), ' ') || ' ' AS line FROM documents), a(kb, person, needle) AS (VALUES ('en', 'p1', ' of the '), ('de', 'p1', ' in der '), ('en', 'p2', ' and of '))
SELECT kb, person, doc, count(*) AS n FROM w JOIN a USING (kb) WHERE contains(line, needle) GROUP BY ALL""")
def j15_alias_hits(spark, d):
    aliases = spark.createDataFrame([("en", "p1", "Of the"), ("de", "p1", "in der"), ("en", "p2", "and of")], "kb string, person string, alias string")
    return J.alias_hits(table(spark, d, "documents").select(F.col("lang").alias("kb"), F.col("doc_id").alias("doc"), F.col("text").alias("body")), aliases)


@query("""WITH c AS (SELECT l_suppkey AS concept, l_partkey AS page, l_orderkey * 10 + l_linenumber AS line, l_returnflag || l_linestatus || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS claim FROM lineitem), e AS (SELECT DISTINCT concept, page FROM c),
p AS (SELECT x.concept AS a, y.concept AS b, count(*) AS n FROM e x JOIN e y ON x.page = y.page AND x.concept < y.concept GROUP BY ALL HAVING count(*) >= 160), s AS (SELECT a, b, x.page FROM p JOIN e x ON x.concept = a JOIN e y ON y.concept = b AND y.page = x.page),
k AS (SELECT a, b, page, unnest([a, b]) AS concept FROM s), f AS (SELECT a, b, page, concept, claim, min(line) AS line FROM k JOIN c USING (concept, page) GROUP BY ALL)
SELECT a, b, page, concept, claim, line, CAST(row_number() OVER (PARTITION BY a, b, page, concept ORDER BY line, claim) AS INTEGER) AS rank FROM f QUALIFY row_number() OVER (PARTITION BY a, b, page, concept ORDER BY line, claim) <= 3""")
def j17_pair_packs(spark, d):
    claims = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("concept"), F.col("l_partkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), F.concat("l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").cast("string")).alias("claim"))
    return J.pair_packs(J.shared_source_pairs(claims, 160), claims)


@query("""SELECT p_partkey AS page, p_brand AS was, 'CHANGED' AS change FROM part WHERE p_partkey % 10 = 3 UNION ALL SELECT p_partkey, p_brand, 'REMOVED' FROM part WHERE p_partkey % 10 = 4""")
def j16_manifest_drift(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("page"), F.col("p_brand").alias("digest"))
    packed = part.where("page % 10 <> 4").withColumn("digest", F.when(F.col("page") % 10 == 3, "other").otherwise(F.col("digest")))
    return J.snapshot_diff(part, packed, "page").join(part, "page").select("page", F.col("digest").alias("was"), "change")


@query("""WITH b AS (SELECT lang AS kb, md5(text) AS text FROM documents), l AS (SELECT DISTINCT kb, text FROM b WHERE text < '8') SELECT kb, count(*) AS unsorted FROM b WHERE (kb, text) NOT IN (SELECT kb, text FROM l) GROUP BY 1""")
def j21_unsorted_questions(spark, d):
    bullets = table(spark, d, "documents").select(F.col("lang").alias("kb"), F.md5("text").alias("text"))
    listed = bullets.where("text < '8'").distinct().select("kb", F.lit("bullet").alias("kind"), "text")
    return J.standing_questions(listed, bullets, bullets.where("false"))[1]


@query("""WITH m AS (SELECT p_partkey, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount >= 0.05 AND l_quantity > 40) THEN 1 ELSE 0 END AS c, p_size % 4 = 0 AS mirror FROM part)
SELECT 'parts' AS kb, (SELECT count(*) FROM supplier) AS concepts, (SELECT count(*) FROM lineitem) AS citations, count(*) AS pages, CAST(sum(mirror::INT) AS BIGINT) AS mirror_pages, CAST(sum(c) AS BIGINT) AS covered FROM m""")
def a2_coverage_state(spark, d):
    mirror = table(spark, d, "part").select(F.col("p_partkey").alias("page"), (F.col("p_size") % 4 == 0).alias("is_mirror"))
    return A.coverage_state(marked_parts(spark, d).join(mirror, "page"), table(spark, d, "supplier").select(F.lit("parts").alias("kb")), table(spark, d, "lineitem").select(F.lit("parts").alias("kb")))


@query("""SELECT word, doc_id AS doc, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY ALL""")
def a14_postings(spark, d):
    words = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("word"))
    return A.postings(words)


@query("""WITH l AS (SELECT DISTINCT l_partkey AS s, l_suppkey + 100000 AS t FROM lineitem), n AS (SELECT s AS node FROM l UNION SELECT t FROM l) SELECT node, (SELECT count(*) FROM l WHERE t = node) AS inbound, (SELECT count(*) FROM l WHERE s = node) AS outbound FROM n""")
def g7_degrees(spark, d):
    links = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 100000).alias("dst"))
    return G.degrees(links.select(F.col("src").alias("node")).unionByName(links.select(F.col("dst").alias("node"))), links, loops=True)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS node, o_orderkey + 1000000 AS nxt FROM orders UNION SELECT DISTINCT l_orderkey + 1000000, l_partkey + 5000000 FROM lineitem), r AS (SELECT c_custkey AS root, c_custkey AS node, 0 AS depth FROM customer UNION ALL SELECT root, nxt, depth + 1 FROM r JOIN e USING (node))
SELECT root, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY ALL""")
def g11_lineage(spark, d):
    up = table(spark, d, "orders").select(F.col("o_custkey").alias("concept"), (F.col("o_orderkey") + 1000000).alias("page"))
    down = table(spark, d, "lineitem").select((F.col("l_orderkey") + 1000000).alias("concept"), (F.col("l_partkey") + 5000000).alias("page"))
    return G.lineage(up.unionByName(down), table(spark, d, "customer").select(F.col("c_custkey").alias("node")))


@query("""SELECT doc_id AS concept FROM documents WHERE doc_id % 3 <> 0 OR n_chars > 2000""")
def st3_unread_claims(spark, d):
    docs = table(spark, d, "documents")
    claims = docs.select(F.lit("k").alias("kb"), F.col("doc_id").alias("concept"), F.col("lang").alias("text"))
    bodies = docs.select(F.lit("k").alias("kb"), F.col("doc_id").alias("doc"), F.col("text").alias("body"))
    readings = docs.where("doc_id % 3 = 0").select(F.lit("k").alias("kb"), F.col("doc_id").alias("concept"), F.col("lang").alias("text"), F.when(F.col("n_chars") > 2000, "old").otherwise(F.sha1("text")).alias("digest"))
    return S.unread_claims(claims, bodies, readings).select("concept")


@query("""WITH a AS (SELECT o_custkey AS kb, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY 1), b AS (SELECT o_custkey AS kb, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders WHERE o_orderdate < TIMESTAMP '1998-06-01' GROUP BY 1) SELECT a.kb FROM a LEFT JOIN b USING (kb) WHERE b.kb IS NULL OR a.n <> b.n OR a.f <> b.f""")
def st4_moved_state(spark, d):
    orders = table(spark, d, "orders")
    state = lambda r: r.groupBy(F.col("o_custkey").alias("kb")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    return S.moved(state(orders.where("o_orderdate < timestamp '1998-06-01'")), state(orders), "kb", ["n", "f"])


@query("""SELECT o_custkey AS kb, o_orderkey AS item, 'old' AS version FROM orders WHERE o_custkey % 5 <> 0 UNION ALL SELECT o_custkey, o_orderkey, 'new' FROM orders WHERE o_custkey % 5 = 0""")
def st5_merged_state(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("kb"), F.col("o_orderkey").alias("item"))
    return S.merge_by(rows.withColumn("version", F.lit("old")), rows.where("kb % 5 = 0").withColumn("version", F.lit("new")))


@query("""SELECT count(*) <> 90 OR max(ts) <> TIMESTAMP '2024-01-01' AS refresh FROM events""")
def st8_needs_refresh(spark, d):
    files = table(spark, d, "events").select(F.col("ts").alias("modified"))
    return S.needs_refresh(files, spark.sql("SELECT 90L AS n, timestamp '2024-01-01' AS newest"))


@query("""SELECT doc_id AS doc FROM documents WHERE doc_id % 4 = 0 AND regexp_replace(trim(text), '\\s+', ' ', 'g') <> regexp_replace(trim(text || ' x'), '\\s+', ' ', 'g')""")
def st9_body_changed(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("body"))
    new = docs.withColumn("body", F.when(F.col("doc") % 4 == 0, F.concat("body", F.lit(" x"))).otherwise(F.regexp_replace("body", " ", "  ")))
    return S.body_changed(docs, new)


@query("""SELECT c_nationkey AS kb, c_custkey AS concept, CAST((row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_acctbal DESC, c_name) - 1) // 50 AS BIGINT) AS batch FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def k9_reading_blocks(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("concept")).agg(F.count(F.lit(1)).alias("inbound"))
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("kb"), F.col("c_custkey").alias("concept"), F.col("c_acctbal").alias("n_sources"), F.col("c_name").alias("title")).join(n, "concept")
    return sinks.reading_blocks(rows).select("kb", "concept", "batch")


@query("""WITH b AS (SELECT p_brand AS scope, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 55 AS batch FROM part) SELECT trim(regexp_replace(lower(scope), '[^a-z0-9]+', '-', 'g'), '-') || '-' || CAST(CAST(batch + 1 AS BIGINT) AS VARCHAR) AS id, scope, count(*) AS n FROM b GROUP BY scope, batch""")
def k12_batch_plan(spark, d):
    return sinks.batch_plan(table(spark, d, "part").select(F.col("p_brand").alias("scope"), F.col("p_partkey").alias("page")))


@query("""SELECT p_partkey AS page, CASE WHEN p_size % 4 = 0 AND p_size > 20 THEN 'rebuild' WHEN p_size % 4 = 2 THEN 'remove' WHEN p_size % 4 = 3 THEN 'investigate' ELSE 'ignore' END AS action FROM part""")
def n9_change_triage(spark, d):
    status = F.when(F.col("p_size") % 4 == 0, "modified").when(F.col("p_size") % 4 == 2, "archived").when(F.col("p_size") % 4 == 3, "moved-or-deleted").otherwise("kept")
    return vault.triage(table(spark, d, "part").select(F.col("p_partkey").alias("page"), status.alias("status"), (F.col("p_size") > 20).alias("content_changed"))).select("page", "action")


@query("""SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber = 1 THEN strftime(l_shipdate, '%Y%m%d') END AS VARCHAR) AS day FROM lineitem""")
def p18_dates_in_text(spark, d):
    written = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("shipped on "), F.date_format("l_shipdate", "d.M.yyyy"), F.lit("."))).otherwise("on 2026-02-31, 99.1.2020 or never")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.try_element_at(T.dates_in(written), F.lit(1)).alias("day"))


@query("""SELECT p_partkey, CAST(CASE WHEN p_partkey % 2 = 0 THEN p_partkey ELSE p_partkey % 100 END AS INTEGER) AS n FROM part""")
def p19_number_words(spark, d):
    words = F.element_at(F.array(*map(F.lit, T.NUMBER_WORDS)), (F.col("p_partkey") % 100 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", T.number(F.when(F.col("p_partkey") % 2 == 0, T.thousands(F.col("p_partkey"))).otherwise(F.initcap(words))).alias("n"))


@query("""SELECT s_suppkey, trim(regexp_replace(replace(lower(s_name), 'ü', 'ue'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM supplier""")
def p26_slugs(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", T.slug(F.col("s_name")).alias("slug"))


@query("""WITH p AS (SELECT doc_id, text, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '_assets/\\S+', '', 'g'), '\\[([^\\]]{1,120})\\]\\([^)]*\\)', '\\1', 'g'),
  'https?://\\S+', '', 'g'), '\\{?[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\\}?', '', 'g'), '\\s+', ' ', 'g')) AS plain FROM documents)
SELECT doc_id, CASE WHEN length(plain) >= 40 THEN md5(plain) ELSE '' END AS body_md5, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS strict_md5, md5(left(plain, 120)) AS head_md5, CAST(length(plain) AS INTEGER) AS chars, CAST(strlen(text) AS INTEGER) AS bytes FROM p""")
def q4_fingerprints(spark, d):
    pages = table(spark, d, "documents").select(F.lit("k").alias("kb"), F.col("doc_id").alias("path"), F.col("lang").alias("title"), F.col("source").alias("created"), F.col("text").alias("body"))
    return C.fingerprints(pages).select(F.col("path").alias("doc_id"), "body_md5", "strict_md5", "head_md5", "chars", F.col("bytes").cast("int").alias("bytes"))


@query("""SELECT user_id AS kb, arg_max(event_id, {'a': CAST(ts AS DATE), 'b': event_id}) AS report FROM events GROUP BY 1""")
def w12_newest_report(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("kb"), F.to_date("ts").alias("day"), "event_id")
    return W.newest(rows, ["kb"], [F.desc("day"), F.desc("event_id")]).select("kb", F.col("event_id").alias("report"))


@query("""WITH v AS (SELECT DISTINCT l_shipdate::DATE AS day, l_returnflag FROM lineitem) SELECT CAST(day AS VARCHAR) AS day FROM v WHERE l_returnflag = 'R' EXCEPT SELECT CAST(day AS VARCHAR) FROM v WHERE l_returnflag = 'N'""")
def u1_one_sided_days(spark, d):
    rows = table(spark, d, "lineitem").select(F.to_date("l_shipdate").cast("string").alias("day"), "l_returnflag")
    return J.one_sided(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag = 'N'"), ["day"])


@query("""SELECT s_suppkey, CAST(row_number() OVER (ORDER BY n DESC, s_acctbal DESC, s_name) AS INTEGER) AS place FROM supplier JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey""")
def o6_reading_order(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("inbound"))
    return R.reading_order(table(spark, d, "supplier").join(n, "s_suppkey").select("s_suppkey", "inbound", F.col("s_acctbal").alias("n_sources"), F.col("s_name").alias("title"))).select("s_suppkey", "place")
