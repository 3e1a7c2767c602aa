"""Q1: ranked search over documents with titles, tags, descriptions and bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

#: Fixed values of the ranking: weights of a word in a title, tags and description, the cap on a body's count,
#: the weight of a word that the last query word begins and how many of those count, the weight of question
#: lists, and what an alias hit adds.
TITLE, TAGS, DESCRIPTION, CAP = 10.0, 5.0, 3.0, 20
PREFIX_WEIGHT, PREFIXES, QUESTIONS, ALIAS = 0.6, 300, 0.3, 100.0


def asked(terms: list[str]) -> Column:
    """Which words a query of these terms can touch: the terms and what the last one begins."""
    last = terms[-1] if terms else ""
    exact = F.col("word").isin(*dict.fromkeys(terms)) if terms else F.lit(False)
    return exact | F.startswith(F.col("word"), F.lit(last)) if len(last) >= 2 else exact


def fields(docs: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """The index (doc, word, in_title, in_tags, in_desc, tf) of docs (doc, title_words, tag_words, desc_words,
    body_words); with terms only the words that a query of them can touch, left out before anything is shuffled."""
    keep = asked(terms) if terms is not None else F.lit(True)
    flag = lambda c, n: docs.select("doc", F.explode(F.array_distinct(c)).alias("word")).where(keep).withColumn(n, F.lit(True))
    rows = [flag("title_words", "in_title"), flag("tag_words", "in_tags"), flag("desc_words", "in_desc")]
    body = docs.select("doc", F.explode("body_words").alias("word")).where(keep).groupBy("doc", "word").agg(F.count(F.lit(1)).alias("tf"))
    out = body
    for r in rows:
        out = out.unionByName(r, allowMissingColumns=True)
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False)).alias(c)
    return out.groupBy("doc", "word").agg(any_of("in_title"), any_of("in_tags"), any_of("in_desc"), F.coalesce(F.max("tf"), F.lit(0)).alias("tf"))


def expansions(index: DataFrame, terms: list[str]) -> DataFrame:
    """(term, word, weight): each query word, and the most frequent words that the last one begins."""
    spark = index.sparkSession
    exact = spark.createDataFrame([(t, t, 1.0) for t in dict.fromkeys(terms)], "term string, word string, weight double")
    last = terms[-1] if terms else ""
    if len(last) < 2:
        return exact
    # A range on the word, so that a sorted index skips all others.
    longer = index.where((F.col("word") > last) & (F.col("word") < last + "{")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    best = longer.orderBy(F.desc("n"), "word").limit(PREFIXES)
    return exact.unionByName(best.select(F.lit(last).alias("term"), "word", F.lit(PREFIX_WEIGHT).alias("weight")))


def search(index: DataFrame, terms: list[str], k: int = 10, questions: DataFrame | None = None, alias: DataFrame | None = None) -> DataFrame:
    """(doc, score): the k best documents, ties by doc. questions: docs that count less; alias: docs that an alias names."""
    wanted = F.broadcast(expansions(index, terms))
    worth = TITLE * F.col("in_title").cast("int") + TAGS * F.col("in_tags").cast("int") + DESCRIPTION * F.col("in_desc").cast("int") + F.when(F.col("in_title"), 0.0).otherwise(F.sqrt(F.least(F.col("tf"), F.lit(CAP))))
    by_term = index.join(wanted, "word").groupBy("doc", "term").agg(F.max(F.col("weight") * worth).alias("value"))
    n = len(dict.fromkeys(terms))
    scored = by_term.groupBy("doc").agg(F.sum("value").alias("sum"), F.count(F.lit(1)).alias("found")).select("doc", (F.col("sum") * F.pow(F.col("found") / n, F.lit(2.0))).alias("score"))
    if questions is not None:
        less = questions.select("doc").distinct().withColumn("less", F.lit(QUESTIONS))
        scored = scored.join(less, "doc", "left").select("doc", (F.col("score") * F.coalesce("less", F.lit(1.0))).alias("score"))
    if alias is not None:
        hit = alias.select("doc").distinct().withColumn("hit", F.lit(ALIAS))
        scored = scored.join(hit, "doc", "full_outer").select("doc", (F.coalesce("score", F.lit(0.0)) + F.coalesce("hit", F.lit(0.0))).alias("score"))
    return scored.orderBy(F.desc("score"), "doc").limit(k)


def reading_order(docs: DataFrame) -> DataFrame:
    """Docs (doc, inbound, n_sources, title) with their place: most linked, then most sources, then title."""
    return docs.withColumn("place", F.row_number().over(Window.orderBy(F.desc("inbound"), F.desc("n_sources"), "title")))
