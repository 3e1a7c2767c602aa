"""Graph operators on edge lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lectern.session import discard, materialise

#: Rows that a share of a lineage's level shuffles, and the most shares: each reads its tables once.
SHARE_ROWS, MOST_SHARES = 20_000_000, 8


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) for every node of the undirected edges.

    Alternating large-star and small-star steps: each hangs a node's neighbours on
    its smallest neighbour, which ends in stars after a number of rounds that grows
    with the logarithm of the longest path. Aggregations are partial before they
    shuffle, and each round ends in a written table.
    """
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    ends = materialise(ends, "edges")
    digest = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = digest(ends)
    for _ in range(rounds):
        # Large star: larger neighbours of a node move to its smallest neighbour.
        both = ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = materialise(small.where("u <> v").distinct(), "edges")
        now = digest(after)
        discard(ends)
        ends = after
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    out = ends.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(ends.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out._lectern_parts = [ends]
    return out


def undirected(links: DataFrame) -> DataFrame:
    """Distinct unordered edges (a, b) without self-links, of links (src, dst)."""
    return links.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def isolates(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes (node) that no other node links to."""
    reached = links.where("src <> dst").select(F.col("dst").alias("node")).distinct()
    return nodes.select("node").distinct().join(reached, "node", "left_anti")


def link_health(nodes: DataFrame, links: DataFrame, most_isolated: float = 0.05) -> DataFrame:
    """One row: nodes, edges, edges a node, isolates and their share, the largest component and its share, and whether a linking pass is due."""
    known = nodes.select("node").distinct()
    inside = links.join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi")
    edges = undirected(inside)
    parts = connected_components(edges).groupBy("component").agg(F.count(F.lit(1)).alias("size")).agg(F.max("size").alias("largest"))
    counts = known.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges"))).crossJoin(isolates(known, inside).agg(F.count(F.lit(1)).alias("isolates"))).crossJoin(parts)
    largest = F.coalesce("largest", F.least(F.col("nodes"), F.lit(1)))
    return counts.select(
        "nodes", "edges", (F.col("edges") / F.col("nodes")).alias("density"), "isolates", (F.col("isolates") / F.col("nodes")).alias("isolated_share"),
        largest.alias("largest"), (largest / F.col("nodes")).alias("largest_share"), (F.col("isolates") / F.col("nodes") > most_isolated).alias("pass_due"),
    )


def chain_ends(moves: DataFrame, rounds: int = 40) -> DataFrame:
    """(old, new) with each moved path's final place; a cycle ends where it closes. Pointer doubling, so the
    rounds grow with the logarithm of the longest chain."""
    now = materialise(moves.groupBy("old").agg(F.min("new").alias("new")), "moves")
    for _ in range(rounds):
        onward = now.select(F.col("old").alias("new"), F.col("new").alias("then"))
        stepped = now.join(onward, "new", "left")
        moved = stepped.where("then IS NOT NULL AND then <> old AND then <> new")
        if moved.isEmpty():
            break
        now = materialise(stepped.select("old", F.when(F.col("then").isNotNull() & (F.col("then") != F.col("old")), F.col("then")).otherwise(F.col("new")).alias("new")), "moves")
    return now


def backlinks(links: DataFrame) -> DataFrame:
    """Each target's distinct linking documents, sorted."""
    return links.where("src <> dst").groupBy("dst").agg(F.array_sort(F.collect_set("src")).alias("sources"))


def degrees(nodes: DataFrame, links: DataFrame, loops: bool = False) -> DataFrame:
    """Distinct inbound and outbound links of each node; with loops, a link to itself counts as one of each."""
    edges = (links.where("src IS NOT NULL AND dst IS NOT NULL") if loops else links.where("src <> dst")).select("src", "dst").distinct()
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("outbound"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("inbound"))
    return nodes.select("node").distinct().join(into, "node", "left").join(out, "node", "left").na.fill(0)


def orphan_shapes(nodes: DataFrame, links: DataFrame, hub: int = 10) -> DataFrame:
    """Nodes by shape: alone (no link either way), unreached (links out only), hub, or plain."""
    shape = F.when((F.col("inbound") == 0) & (F.col("outbound") == 0), "alone").when(F.col("inbound") == 0, "unreached").when(F.col("inbound") >= hub, "hub").otherwise("plain")
    return degrees(nodes, links).withColumn("shape", shape)


def dealt(rows: DataFrame, *key: str, share: int, shares: int) -> DataFrame:
    """One of so many shares of the rows, by the hash of their key."""
    return rows.where(F.pmod(F.xxhash64(*key), F.lit(shares)) == share) if shares > 1 else rows


def shares_of(rows: int) -> int:
    """Shares in which so many rows are shuffled."""
    return max(1, min(MOST_SHARES, -(-rows // SHARE_ROWS)))


def lineage(citations: DataFrame, start: DataFrame, depth: int = 100) -> DataFrame:
    """(root, node, depth) of what a document rests on through its sources, each node at its least depth; a
    lineage deeper than `depth` is an error.

    What a level reaches is joined by its node and held against what was seen by (root, node), each a share at a time, so
    that only one share's shuffled rows are on disk; the last level reaches nothing and isn't held against anything."""
    edges = citations.select(F.col("concept").alias("node"), F.col("page").alias("next"))
    n_edges = edges.count()
    front = materialise(start.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth")), "lineage")
    seen, n_front = front, front.count()
    n_seen = n_front
    for level in range(1, depth + 1):
        n, reached = shares_of(n_edges + n_front), []
        for i in range(n):
            # Edges are made distinct where the join needs them, by their start.
            ways = dealt(edges, "node", share=i, shares=n).repartition("node").distinct()
            grown = dealt(front.select("root", "node"), "node", share=i, shares=n).join(ways.hint("merge"), "node")
            reached.append(materialise(grown.select("root", F.col("next").alias("node")), f"reached_{i}"))
        grown = _together(reached)
        n_grown = grown.count()
        n, fresh = shares_of(n_grown + n_seen), []
        for i in range(n if n_grown else 0):
            known = dealt(seen.select("root", "node"), "root", "node", share=i, shares=n).hint("merge")
            new = dealt(grown, "root", "node", share=i, shares=n).distinct().join(known, ["root", "node"], "left_anti")
            fresh.append(materialise(new.withColumn("depth", F.lit(level)), f"lineage_{i}"))
        discard(grown)
        if not n_grown:
            break
        front = _together(fresh)
        n_front = front.count()
        if not n_front:
            discard(front)
            break
        seen, n_seen = seen.unionByName(front), n_seen + n_front
    else:
        raise RuntimeError(f"a lineage is deeper than {depth}")
    return seen


def _together(written: list[DataFrame]) -> DataFrame:
    """The union of written tables, which discard() deletes."""
    out = reduce(DataFrame.unionByName, written)
    if len(written) > 1:
        out._lectern_parts = written
    return out
