"""Exact top-k inner products by MaxScore, over shards.

A vector's components, floor(SCALE * x), are its terms' weights; a term's
postings in a shard are the rows that have it other than 0, as a column of
their weights, in order of ids. A query's term can add at most its weight
times the postings' highest or lowest one, its bound. The query's terms in
falling order of their bounds are split where the rest's bounds together can't
lift a row over the query's k-th best score so far: the first are essential,
and only rows in their postings are summed. The others are probed one by one
for the rows that remain competitive. Postings are traversed in stretches;
after each the k-th best score, and with it the split, moves. With dense
vectors every row is in an essential posting, so all rows are summed over
their essential terms, but few are probed further.

Each shard gives its k best for each query, and a merge ranks them. Shards are
of a fixed number of rows and meet the queries in blocks, so that no task's
size follows the table's. Sums are in doubles where bounds show that they stay
below 2 ** 53, else in 64-bit integers, and beyond in Python's.

Defined results: vectors that are null, empty or hold a null, NaN or infinite
component take no part, nor do rows without vec_id; of different lengths, the
shorter counts as padded with zeros; a query's own row is no candidate, but
other rows with its vec_id are, and if several queries have one vec_id each
gives its ranks; scores beyond 64 bits are cut to the largest or smallest long;
extra columns are ignored; no query, no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from lectern.session import materialise, ship

SCALE, K, EVERY = 1024, 10, 100
#: Rows of a shard and queries of a block at most, and rows of the first and of later stretches of the postings.
SHARD_ROWS, QUERY_BLOCK = 32_768, 4_096
FIRST, STRETCH = 256, 4_096
#: Competitive rows so few that they are scored in full at once.
FEW = 64


def exact_type(queries: np.ndarray, vectors: np.ndarray) -> type:
    """The cheapest type in which all sums of products are exact."""
    if not queries.size or not vectors.size:
        return np.float64
    largest = [max(abs(int(x.min())), abs(int(x.max()))) for x in (queries, vectors)]
    bound = largest[0] * largest[1] * queries.shape[1]
    return np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object


class Postings:
    """A shard's rows in order of ids, and of each term the rows that have it."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        self.order = np.argsort(ids, kind="stable")
        self.vectors, self.ids = vectors[self.order], ids[self.order]
        self.columns = np.asfortranarray(self.vectors)
        self.low, self.high = self.vectors.min(0), self.vectors.max(0)
        filled = (self.vectors != 0).sum(0)
        # A dense column stands for itself; of others the rows are listed.
        self.rows = [np.flatnonzero(self.columns[:, t]) if 2 * filled[t] < len(ids) else None for t in range(vectors.shape[1])]

    def best(self, weight: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers (in order of ids) and scores of the k best rows but `own`, ties to smaller ids."""
        zero = weight.dtype.type(0) if weight.dtype != object else 0
        bound = np.maximum(np.maximum(weight * self.low, weight * self.high), zero)
        terms = np.argsort(-bound, kind="stable")
        # What the terms from each place on can add at most.
        rest = np.concatenate([np.cumsum(bound[terms][::-1])[::-1], np.zeros(1, weight.dtype)])
        top, score, least = np.zeros(0, np.int64), np.zeros(0, weight.dtype), None
        a, n = 0, len(self.ids)
        while a < n:
            b = min(n, a + (STRETCH if a else FIRST))
            # Rows come in order of ids, so one that only equals the k-th best is behind it.
            split = len(terms) if least is None else int(np.flatnonzero(rest <= least)[0]) if (rest <= least).any() else len(terms)
            dense = [t for t in terms[:split] if self.rows[t] is None]
            if dense:
                sums, alive = self.vectors[a:b, dense] @ weight[dense], np.ones(b - a, bool)
            else:
                # Without an essential term a row can't win, unless nothing is to be beaten yet.
                sums, alive = np.zeros(b - a, weight.dtype), np.full(b - a, least is None)
            for t in terms[:split]:
                if (rows := self.rows[t]) is not None:
                    mine = rows[np.searchsorted(rows, a) : np.searchsorted(rows, b)]
                    sums[mine - a] += weight[t] * self.columns[mine, t]
                    alive[mine - a] = True
            if a <= own < b:
                alive[own - a] = False
            alive = np.flatnonzero(alive)
            sums = sums[alive]
            for place in range(split, len(terms)):
                keep = sums + rest[place] > least
                alive, sums = alive[keep], sums[keep]
                if len(alive) <= FEW:
                    others = terms[place:]
                    sums = sums + self.vectors[a + alive][:, others] @ weight[others]
                    break
                sums = sums + weight[terms[place]] * self.columns[a + alive, terms[place]]
            top, score = np.concatenate([top, a + alive]), np.concatenate([score, sums])
            if len(top) > k:
                first = np.lexsort((top, -score)) if score.dtype != object else sorted(range(len(top)), key=lambda i: (-score[i], top[i]))
                top, score = top[first[:k]], score[first[:k]]
            if len(top) == k:
                least = score.min()
            a = b
        return top, score


def maxscore(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, candidate row, score) of each query's k best; own is the query's row, or -1."""
    kind = exact_type(queries, vectors)
    postings = Postings(vectors.astype(kind), ids)
    place = np.empty(len(ids), np.int64)
    place[postings.order] = np.arange(len(ids))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3]
    for q, weight in enumerate(queries.astype(kind)):
        top, score = postings.best(weight, int(place[own[q]]) if own[q] >= 0 else -1, k)
        if kind is object:
            score = np.array([min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in score], dtype=np.int64)
        out.append((np.full(len(top), q), postings.order[top], score.astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of integers as rows, shorter ones padded with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    lengths, flat = np.diff(offsets), np.asarray(lists.values)[offsets[0] : offsets[-1]]
    out = np.zeros((len(lists), width), np.int64)
    out[np.repeat(np.arange(len(lists)), lengths), np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = flat
    return out


def search(vectors: DataFrame, every: int = EVERY, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row with vec_id divisible by `every`, its k best others."""
    spark = vectors.sparkSession
    ship(spark)
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(F.floor(x * F.lit(float(scale)))).cast("long"))
    fine = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector")).where(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull()))
    # Rows are numbered in the written table, so that repeated ids stay apart.
    fine = materialise(fine.withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = fine.where(F.col("vec_id") % every == 0)
    n_rows, n_asked = fine.count(), asked.count()
    # As many shards as tasks run side by side, and more where they would be too large.
    shards = max(1, min(spark.sparkContext.defaultParallelism, -(-n_rows // 1_024)), -(-n_rows // SHARD_ROWS))
    blocks = max(1, -(-n_asked // QUERY_BLOCK))
    shard = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("row", F.lit(2)), F.lit(blocks)).cast("int")
    held = fine.select("row", "vec_id", "vector", shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    posed = asked.select("row", "vec_id", "vector", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def best(queries: pa.Table, rows: pa.Table) -> pa.Table:
        names = ["row", "query_id", "vec_id", "score"]
        if not queries.num_rows or not rows.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names)
        width = max(int(np.diff(np.asarray(t.column("vector").combine_chunks().offsets)).max()) for t in (queries, rows))
        asked_rows, own_rows, ids = (np.asarray(c) for c in (queries.column("row"), rows.column("row"), rows.column("vec_id")))
        by_row = np.argsort(own_rows, kind="stable")
        at = np.minimum(np.searchsorted(own_rows[by_row], asked_rows), len(by_row) - 1)
        own = np.where(own_rows[by_row[at]] == asked_rows, by_row[at], -1)
        q, r, score = maxscore(matrix(queries.column("vector"), width), own, matrix(rows.column("vector"), width), ids, k)
        return pa.table([asked_rows[q], np.asarray(queries.column("vec_id"))[q], ids[r], score], names)

    found = posed.groupBy("block", "shard").cogroup(held.groupBy("block", "shard")).applyInArrow(best, "row long, query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
