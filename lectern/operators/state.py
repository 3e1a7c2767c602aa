"""State across runs: clocks, readings, snapshots. State tables are Parquet, replaced by kb."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

#: Run days that a finding keeps, and from how many on it is a defect.
KEEP_DAYS, ESCALATE = 5, 3


def tick(clock: DataFrame, findings: DataFrame, audited: DataFrame, day: str, keep: int = KEEP_DAYS) -> DataFrame:
    """ST1: the next clock (kb, path, message, days array<string>).

    A finding gains the day once and keeps its last days; one that is absent loses
    its entry; only the audited kbs are replaced. Findings on `(bundle)` are gauges
    without a clock.
    """
    now = findings.where("path <> '(bundle)'").join(audited.select("kb").distinct(), "kb", "left_semi").select("kb", "path", "message").distinct()
    days = F.array_distinct(F.concat(F.coalesce("days", F.expr("CAST(array() AS array<string>)")), F.array(F.lit(day))))
    kept = F.slice("days", F.greatest(F.size("days") - keep + 1, F.lit(1)), keep)
    advanced = now.join(clock, ["kb", "path", "message"], "left").withColumn("days", days).withColumn("days", kept)
    others = clock.join(audited.select("kb").distinct(), "kb", "left_anti")
    return advanced.unionByName(others.select("kb", "path", "message", "days"))


def escalated(clock: DataFrame, waivers: DataFrame, least: int = ESCALATE) -> DataFrame:
    """ST1, Q15: findings with `least` run days or more, and whether a waiver (path pattern as regex, substring) covers them."""
    old = clock.where(F.size("days") >= least)
    waived = old.join(F.broadcast(waivers), F.regexp(old["path"], waivers["pattern"]) & F.contains(old["message"], waivers["part"]), "left_semi").select("kb", "path", "message").withColumn("waived", F.lit(True))
    return old.join(waived.distinct(), ["kb", "path", "message"], "left").withColumn("waived", F.coalesce("waived", F.lit(False)))


def standing_runs(seen: DataFrame, runs: DataFrame, key: list[str], run: str = "run") -> DataFrame:
    """ST1, M14: each key's current streak over consecutive runs (not calendar days) and whether it reaches the last run.

    seen: key and run; runs: all runs. A run that misses a key ends its streak.
    """
    order = runs.select(run).distinct().withColumn("_no", F.row_number().over(Window.orderBy(run)))
    placed = seen.select(*key, run).distinct().join(F.broadcast(order), run)
    w = Window.partitionBy(*key).orderBy("_no")
    streaks = placed.withColumn("_island", F.col("_no") - F.row_number().over(w)).groupBy(*key, "_island").agg(F.count(F.lit(1)).alias("length"), F.min(run).alias("since"), F.max(run).alias("until"))
    last = order.agg(F.max(run).alias("last"))
    return streaks.crossJoin(F.broadcast(last)).where("until = last").select(*key, "length", "since")


def unread_pairs(pairs: DataFrame, bodies: DataFrame, readings: DataFrame) -> DataFrame:
    """ST2, Q3: pairs (kb, a, b) whose reading (kb, a, b, digest) is missing or older than either body (kb, doc, body)."""
    digest = bodies.select("kb", "doc", F.sha1("body").alias("sha"))
    one, two = digest.select("kb", F.col("doc").alias("a"), F.col("sha").alias("sa")), digest.select("kb", F.col("doc").alias("b"), F.col("sha").alias("sb"))
    ordered = readings.select("kb", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("digest").alias("read"))
    now = pairs.join(one, ["kb", "a"]).join(two, ["kb", "b"]).withColumn("digest", F.concat_ws(":", "sa", "sb")).drop("sa", "sb")
    return now.join(ordered, ["kb", "a", "b"], "left").where("read IS NULL OR read <> digest").drop("read")


def mark_read(readings: DataFrame, marks: DataFrame, pairs: DataFrame, bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ST2: readings after marking pairs (kb, a, b, in either order) as read, and the marks that name no pair."""
    ordered = marks.select("kb", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    known = ordered.join(pairs.select("kb", "a", "b"), ["kb", "a", "b"], "left_semi")
    wrong = ordered.join(pairs.select("kb", "a", "b"), ["kb", "a", "b"], "left_anti")
    empty = readings.where("false")
    fresh = unread_pairs(known, bodies, empty).select("kb", "a", "b", "digest")
    kept = readings.join(known, ["kb", "a", "b"], "left_anti")
    return kept.unionByName(fresh), wrong


def unread_claims(claims: DataFrame, bodies: DataFrame, readings: DataFrame) -> DataFrame:
    """ST3: claims (kb, concept, text) whose reading is missing or older than the body."""
    now = claims.join(bodies.select("kb", F.col("doc").alias("concept"), F.sha1("body").alias("digest")), ["kb", "concept"])
    return now.join(readings.select("kb", "concept", "text", F.col("digest").alias("read")), ["kb", "concept", "text"], "left").where("read IS NULL OR read <> digest").drop("read")


def moved(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """ST4, K1: keys whose state struct moved, so that only their reports are written again."""
    hashed = lambda d, n: d.select(key, F.xxhash64(*values).alias(n))
    return hashed(new, "now").join(hashed(old, "was"), key, "left").where("was IS NULL OR was <> now").select(key)


def merge_by(old: DataFrame, new: DataFrame, partition: str = "kb") -> DataFrame:
    """ST5, K4: the state after replacing the partitions that the new rows hold."""
    return old.join(new.select(partition).distinct(), partition, "left_anti").unionByName(new)


def write_state(rows: DataFrame, path: str, partition: str = "kb") -> None:
    """K4: replace only the partitions in `rows`, so two writers of different kbs lose nothing of each other."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def loop_guard(before: DataFrame, after: DataFrame) -> DataFrame:
    """ST6, Q13: for each (kb, queue): 2 done, 0 shrank, 1 not smaller."""
    both = before.select("kb", "queue", F.col("n").alias("was")).join(after.select("kb", "queue", F.col("n").alias("now")), ["kb", "queue"], "full_outer").na.fill(0, ["was", "now"])
    return both.withColumn("code", F.when(F.col("now") == 0, 2).when(F.col("now") < F.col("was"), 0).otherwise(1))


def remeasured(recorded: DataFrame, measured: DataFrame) -> DataFrame:
    """ST7, O9: recorded counts (item, query, n) beside the query's count now: fixed, changed or holds, in that order."""
    both = recorded.join(measured.select("query", F.col("n").alias("now")), "query", "left")
    verdict = F.when(F.col("now").isNull(), "unmeasured").when(F.col("now") == 0, "fixed?").when(F.col("now") != F.col("n"), "changed").otherwise("still holds")
    rank = F.when(verdict == "fixed?", 0).when(verdict == "changed", 1).when(verdict == "unmeasured", 2).otherwise(3)
    return both.select("item", "query", "n", "now", verdict.alias("verdict"), rank.alias("rank")).orderBy("rank", "item")


def needs_refresh(files: DataFrame, state: DataFrame) -> DataFrame:
    """ST8: whether the number of files or their newest time moved since the state (n, newest)."""
    now = files.agg(F.count(F.lit(1)).alias("n"), F.max("modified").alias("newest"))
    same = now.join(state.select(F.col("n").alias("was"), F.col("newest").alias("then")), (F.col("n") == F.col("was")) & F.col("newest").eqNullSafe(F.col("then")))
    return same.agg((F.count(F.lit(1)) == 0).alias("refresh"))


def body_changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """ST9: documents whose body, white space aside, differs between two versions (frontmatter alone doesn't count)."""
    plain = lambda d, n: d.select("doc", F.md5(F.regexp_replace(F.trim("body"), r"\s+", " ")).alias(n))
    return plain(new, "now").join(plain(old, "was"), "doc", "left").where("was IS NULL OR was <> now").select("doc")
