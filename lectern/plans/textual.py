"""Queries of the text, search and state operators, over driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import aggregates as A, graph as G, joins as J, search as R, state as S, windows as W
from lectern.plans.relational import query, supplies
from lectern.session import table

FOLD = "regexp_extract_all(strip_accents(replace(replace(replace(replace(lower({0}), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')), '[a-z0-9]+')"


def search_index(spark, d, terms=None):
    docs = table(spark, d, "documents")
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    return R.fields(docs.select(F.col("doc_id").alias("doc"), T.words(first).alias("title_words"), F.array(F.lower("source")).alias("tag_words"), T.words(F.col("lang")).alias("desc_words"), T.words(F.substring("text", F.length(first) + 2, F.length("text"))).alias("body_words")), terms)


@query(f"""WITH d AS (SELECT doc_id AS doc, {FOLD.format("split_part(text, chr(10), 1)")} AS tw, [lower(source)] AS gw, {FOLD.format("lang")} AS dw, {FOLD.format("substr(text, length(split_part(text, chr(10), 1)) + 2)")} AS bw FROM documents),
b AS (SELECT doc, word, count(*) AS tf FROM (SELECT doc, unnest(bw) AS word FROM d) GROUP BY ALL), w AS (SELECT doc, word FROM b UNION SELECT doc, unnest(tw) FROM d UNION SELECT doc, unnest(gw) FROM d UNION SELECT doc, unnest(dw) FROM d),
i AS (SELECT w.doc, w.word, list_contains(tw, w.word) AS t, list_contains(gw, w.word) AS g, list_contains(dw, w.word) AS e, coalesce(tf, 0) AS tf FROM w JOIN d USING (doc) LEFT JOIN b USING (doc, word)),
x AS (SELECT 'that' AS term, 'that' AS word, 1.0::DOUBLE AS weight UNION ALL SELECT 'other', 'other', 1.0 UNION ALL SELECT 'thin', 'thin', 1.0 UNION ALL SELECT * FROM (SELECT 'thin', word, 0.6 FROM i WHERE word > 'thin' AND word < 'thin{{' GROUP BY word ORDER BY count(*) DESC, word LIMIT 300)),
v AS (SELECT doc, term, max(weight * (10.0 * t::INT + 5.0 * g::INT + 3.0 * e::INT + CASE WHEN t THEN 0 ELSE sqrt(least(tf, 20)) END)) AS value FROM i JOIN x USING (word) GROUP BY ALL)
SELECT doc, round(sum(value) * pow(count(*) / 3.0, 2), 6) AS score FROM v GROUP BY doc ORDER BY sum(value) * pow(count(*) / 3.0, 2) DESC, doc LIMIT 10""")
def q1_search(spark, d):
    terms = ["that", "other", "thin"]
    return R.search(search_index(spark, d, terms), terms).withColumn("score", F.round("score", 6))


@query("""WITH t AS (SELECT doc_id, upper(left(md5(text), 10)) || right(md5(text), 10) AS tok FROM documents) SELECT doc_id, tok AS token FROM t
WHERE regexp_matches(tok, '[a-z]') AND regexp_matches(tok, '[A-Z]') AND regexp_matches(tok, '[0-9]') AND NOT regexp_matches(tok, '[a-z]{6}') AND NOT regexp_matches(tok, '^(19|20)[0-9]{2}')""")
def c94_credential_shapes(spark, d):
    token = F.concat(F.upper(F.left(F.md5("text"), F.lit(10))), F.right(F.md5("text"), F.lit(10)))
    return table(spark, d, "documents").select("doc_id", T.credential_shape(F.concat(F.lit("key: "), token, F.lit(" end"))).alias("token")).where("token IS NOT NULL")


@query("""SELECT page_id, CAST(len(regexp_extract_all(html, 'href="[^"]*"')) AS INTEGER) AS n_links, regexp_extract(html, 'href="([^"]*)"', 1) AS first_link FROM pages""")
def g1_page_links(spark, d):
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return table(spark, d, "pages").select("page_id", F.size(found).alias("n_links"), F.coalesce(F.try_element_at(found, F.lit(1)), F.lit("")).alias("first_link"))


@query("""SELECT doc_id, md5(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '(?i)licen[sc]e')), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')) AS squeezed FROM documents""")
def p16_boilerplate_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.squeeze(F.col("text"), "(?i)licen[sc]e")).alias("squeezed"))


@query("""WITH l AS (SELECT conv_id AS doc, turn AS line, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS above FROM conversations) SELECT doc, line, above || '>' || role AS rule FROM l WHERE above IS NOT NULL""")
def w4_adjacent_turns(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("doc").orderBy("line")
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("line"), "role").withColumn("above", F.lag("role").over(w))
    return rows.where("above IS NOT NULL").select("doc", "line", F.concat("above", F.lit(">"), "role").alias("rule"))


@query("""WITH k AS (SELECT o_custkey AS tbl, o_orderkey AS line, CASE WHEN o_orderkey % 5 <> 0 THEN left(strftime(o_orderdate, '%Y-%m-%d'), CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE 10 END) END AS cell FROM orders),
c AS (SELECT *, last_value(cell IGNORE NULLS) OVER (PARTITION BY tbl ORDER BY line ROWS UNBOUNDED PRECEDING) AS key FROM k), a AS (SELECT *, lag(key) OVER (PARTITION BY tbl ORDER BY line) AS above FROM c)
SELECT tbl, line FROM a WHERE left(key, least(length(key), length(above))) < left(above, least(length(key), length(above)))""")
def w5_date_jumps(spark, d):
    orders = table(spark, d, "orders")
    pattern = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    cell = F.when(F.col("o_orderkey") % 5 != 0, pattern).otherwise("undated")
    return W.date_jumps(orders.select(F.col("o_custkey").alias("tbl"), F.col("o_orderkey").alias("line"), cell.alias("cell"))).select("tbl", "line")


@query("""WITH l AS (SELECT conv_id AS doc, turn AS line, CAST(role = 'system' AS INT) AS mark FROM conversations), r AS (SELECT *, sum(mark) OVER (PARTITION BY doc ORDER BY line) AS s FROM l) SELECT doc, line, s % 2 = 1 OR mark = 1 AS inside FROM r""")
def w1_fence_state(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("line"), F.when(F.col("role") == "system", "```").otherwise("text").alias("body"))
    return W.unfenced(rows).select("doc", "line", (F.col("body") == "").alias("inside"))


@query("""WITH l AS (SELECT conv_id AS doc, turn AS line, CASE WHEN role = 'user' THEN 'u' || CAST(turn AS VARCHAR) END AS head FROM conversations) SELECT doc, line, last_value(head IGNORE NULLS) OVER (PARTITION BY doc ORDER BY line ROWS UNBOUNDED PRECEDING) AS heading FROM l""")
def w2_current_heading(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("line"), F.when(F.col("role") == "user", F.concat(F.lit("# u"), F.col("turn").cast("string"))).otherwise("text").alias("body"))
    return W.headed(rows).select("doc", "line", "heading")


@query("""WITH p AS (SELECT DISTINCT l_suppkey AS doc, l_partkey AS page FROM lineitem), e AS (SELECT DISTINCT a.doc AS a, b.doc AS b, count(*) AS n FROM p a JOIN p b USING (page) WHERE a.doc < b.doc GROUP BY ALL HAVING count(*) >= 140),
d AS (SELECT s_suppkey AS doc, sha1(s_name) AS sha, s_suppkey % 3 = 0 AS stale FROM supplier)
SELECT a, b, n AS overlap FROM e JOIN d x ON x.doc = a JOIN d y ON y.doc = b WHERE x.stale OR y.stale""")
def q3_contradiction_queue(spark, d):
    pairs = J.shared_source_pairs(supplies(spark, d), 140).withColumn("kb", F.lit("k"))
    supplier = table(spark, d, "supplier")
    bodies = supplier.select(F.lit("k").alias("kb"), F.col("s_suppkey").alias("doc"), F.col("s_name").alias("body"))
    digest = supplier.select(F.col("s_suppkey").alias("doc"), F.when(F.col("s_suppkey") % 3 == 0, "old").otherwise(F.sha1("s_name")).alias("sha"))
    readings = pairs.join(digest.select(F.col("doc").alias("a"), F.col("sha").alias("x")), "a").join(digest.select(F.col("doc").alias("b"), F.col("sha").alias("y")), "b").select("kb", "a", "b", F.concat_ws(":", "x", "y").alias("digest"))
    return S.unread_pairs(pairs, bodies, readings).select("a", "b", "overlap")


@query("""WITH l AS (SELECT l_suppkey AS src, l_partkey % 100 + 1 AS dst FROM lineitem WHERE l_partkey % 100 + 1 IN (SELECT s_suppkey FROM supplier)), e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM l WHERE src <> dst), n AS (SELECT count(*) AS nodes FROM supplier)
SELECT nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT dst FROM l WHERE src <> dst)) AS isolates FROM n""")
def q12_link_health(spark, d):
    links = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100 + 1).alias("dst"))
    return G.link_health(table(spark, d, "supplier").select(F.col("s_suppkey").alias("node")), links.where("dst <= 100")).select("nodes", "edges", "isolates")


@query("""SELECT c_custkey AS item, CAST(date_diff('day', max(o_orderdate), TIMESTAMP '2000-01-01') AS INTEGER) AS age FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def n6_item_ages(spark, d):
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("item")).agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("raised"))
    return A.item_ages(last, "2000-01-01").select("item", "age")


@query("""WITH w AS (SELECT doc_id AS doc, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS word FROM documents) SELECT word, count(*) AS df FROM w GROUP BY 1 ORDER BY df DESC, word LIMIT 100""")
def o7_most_common_words(spark, d):
    words = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1))).alias("word"))
    return A.postings(words).groupBy("word").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "word").limit(100)


@query("""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), k AS (SELECT doc_id, md5(trim(line)) AS h FROM p WHERE length(line) >= 60) SELECT x.doc_id AS fixed, y.doc_id AS other, count(DISTINCT x.h) AS shared FROM k x JOIN k y USING (h) WHERE x.doc_id % 50 = 0 AND x.doc_id <> y.doc_id GROUP BY ALL""")
def n3_verbatim_passages(spark, d):
    lines = W.lines_of(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")).where("length(body) >= 60").select("doc", F.md5(F.trim("body")).alias("h")).distinct()
    return lines.where("doc % 50 = 0").withColumnRenamed("doc", "fixed").join(lines.withColumnRenamed("doc", "other"), "h").where("fixed <> other").groupBy("fixed", "other").agg(F.count(F.lit(1)).alias("shared"))
