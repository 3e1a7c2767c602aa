"""Operators on small made-up rows: the cases that SQL oracles don't reach."""

from lectern.functions import text as T
from lectern.operators import aggregates as A, graph as G, joins as J, state as S, windows as W
import pytest
from pyspark.sql import functions as F


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_pairs_state_machine(spark):
    cites = frame(spark, [("a", p) for p in (1, 2, 3)] + [("b", p) for p in (1, 2, 3, 4)] + [("c", 1)], "concept string, page int")
    assert [tuple(r) for r in J.shared_source_pairs(cites, 3).collect()] == [("a", "b", 3)]
    pairs = frame(spark, [("k", "a", "b")], "kb string, a string, b string")
    bodies = frame(spark, [("k", "a", "one"), ("k", "b", "two")], "kb string, doc string, body string")
    none = frame(spark, [], "kb string, a string, b string, digest string")
    assert S.unread_pairs(pairs, bodies, none).count() == 1
    marks = frame(spark, [("k", "b", "a"), ("k", "x", "y")], "kb string, a string, b string")
    read, wrong = S.mark_read(none, marks, pairs, bodies)
    assert S.unread_pairs(pairs, bodies, read).count() == 0
    assert [(r.a, r.b) for r in wrong.collect()] == [("x", "y")]
    changed = frame(spark, [("k", "a", "one"), ("k", "b", "new")], "kb string, doc string, body string")
    assert S.unread_pairs(pairs, changed, read).count() == 1


def test_match_with_itself_is_same(spark):
    rows = frame(spark, [("p1", "x", "x", "t", "d"), ("p2", "x", "y", "t", "d"), ("p3", "z", "z", None, None)], "path string, body string, strict string, title string, date string")
    assert {r.verdict for r in J.remap(rows, rows).collect()} == {"SAME"}


def test_clock(spark):
    schema = "kb string, path string, message string, days array<string>"
    clock = frame(spark, [("k", "p", "m", ["1", "2", "3", "4", "5"]), ("k", "p", "gone", ["1"]), ("other", "p", "m", ["1"])], schema)
    now = frame(spark, [("k", "p", "m"), ("k", "p", "fresh"), ("k", "(bundle)", "gauge")], "kb string, path string, message string")
    after = S.tick(clock, now, frame(spark, [("k",)], "kb string"), "6")
    assert {(r.kb, r.message): list(r.days) for r in after.collect()} == {("k", "m"): ["2", "3", "4", "5", "6"], ("k", "fresh"): ["6"], ("other", "m"): ["1"]}
    waivers = frame(spark, [("^p$", "m")], "pattern string, part string")
    assert [(r.message, r.waived) for r in S.escalated(after, waivers).collect()] == [("m", True)]


def test_blank_lines(spark):
    docs = frame(spark, [("d", "One\ntwo\n\n- item\nthree\n\n| a |\n| --- |\n| 1 |\nfour\n[^n]: note")], "doc string, text string")
    rules = {(r.line, r.rule) for r in W.pair_rules(W.lines_of(docs)).collect()}
    assert rules == {(1, "runon"), (4, "under_item"), (9, "under_table"), (10, "note_under")}
    once = W.separated(docs)
    assert W.pair_rules(W.lines_of(once)).count() == 0
    assert W.separated(once).first().text == once.first().text


def test_sections_fences_and_novelty(spark):
    docs = frame(spark, [("a", "# X\none\n```\ncode\n```\n## Y\ntwo\n# Z\nthree"), ("b", "one\nfresh line\none")], "doc string, text string")
    lines = W.lines_of(docs)
    assert [r.body for r in W.section(lines, "X").orderBy("line").collect()] == ["one", "```", "code", "```", "## Y", "two"]
    assert [r.body for r in W.unfenced(lines).where("doc = 'a'").orderBy("line").collect()][2:5] == ["", "", ""]
    assert {(r.doc, r.novel, r.carried) for r in W.line_novelty(docs).collect()} == {("a", 8, 1), ("b", 1, 2)}
    heads = {r.line: r.heading for r in W.headed(lines).where("doc = 'a'").collect()}
    assert heads[1] == "X" and heads[6] == "Y" and heads[8] == "Z"


def test_packs_and_inserts(spark):
    rows = frame(spark, [("g", i, s) for i, s in enumerate((4, 4, 4, 9, 1))], "g string, i int, s long")
    assert [r.pack for r in W.packs(rows, "g", "i", "s", 8).orderBy("i").collect()] == [0, 0, 1, 2, 3]
    listed = frame(spark, [("s", 1, "a"), ("s", 2, "c"), ("u", 1, "z"), ("u", 2, "b")], "grp string, position int, title string")
    added = frame(spark, [("s", "b"), ("u", "a")], "grp string, title string")
    got = {}
    for r in W.sorted_insert(listed, added).orderBy("grp", "position").collect():
        got.setdefault(r.grp, []).append(r.title)
    assert got == {"s": ["a", "b", "c"], "u": ["z", "b", "a"]}


def test_quotes(spark):
    quotes = frame(spark, [(1, ["The lamp"]), (2, ["not there"]), (3, ["x"])], "block int, parts array<string>")
    cites = frame(spark, [(1, "p"), (2, "p"), (3, "p"), (3, "q")], "block int, page string")
    pages = frame(spark, [("p", "so the lamp burns"), ("q", None)], "page string, text string")
    assert [r.block for r in J.missing_quotes(quotes, cites, pages).collect()] == [2]


def test_reanchor_and_chains(spark):
    cites = frame(spark, [(1, "a/b", "../r/x.md"), (2, "a", "old.md"), (3, "a", "q/only.md"), (4, "a", "none.md")], "cite int, directory string, resource string")
    files = frame(spark, [("a/r/x.md",), ("new.md",), ("deep/only.md",)], "path string")
    moves = frame(spark, [("old.md", "new.md")], "old string, new string")
    assert {(r.cite, r.path, r.how) for r in J.reanchor(cites, files, moves).collect()} == {(1, "a/r/x.md", "depth"), (2, "new.md", "move"), (3, "deep/only.md", "name"), (4, None, None)}
    chain = frame(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x")], "old string, new string")
    ends = {r.old: r.new for r in G.chain_ends(chain).collect()}
    assert (ends["a"], ends["b"], ends["c"]) == ("d", "d", "d")


def test_components_and_health(spark):
    edges = frame(spark, [(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.component) for r in G.connected_components(edges).collect()} == {(i, 1) for i in range(1, 41)} | {(100, 100), (101, 100)}
    links = frame(spark, [("a", "b"), ("b", "a"), ("a", "a")], "src string, dst string")
    nodes = frame(spark, [("a",), ("b",), ("c",)], "node string")
    row = G.link_health(nodes, links).first()
    assert (row.nodes, row.edges, row.isolates, row.largest, row.pass_due) == (3, 1, 1, 2, True)


def test_text_functions(spark):
    row = frame(spark, [("Größe Übung 12", "a 2026-02-31 b 2026-02-03, 4.5.2026", "1'200", "three", "aB3xK9mQ2zT7pL5wR8")], "a string, d string, n string, w string, t string").select(
        T.slug(F.col("a")).alias("slug"), T.fold_ascii("a").alias("fold"), T.dates_in(F.col("d")).alias("dates"), T.number(F.col("n")).alias("n"), T.number(F.col("w")).alias("w"), T.credential_shape(F.col("t")).alias("t"), T.thousands(F.lit(1234567)).alias("k")
    ).first()
    assert (row.slug, row.fold, list(row.dates), row.n, row.w, row.t, row.k) == ("groesse-uebung-12", "groesse uebung 12", ["20260203", "20260504"], 1200, 3, "aB3xK9mQ2zT7pL5wR8", "1'234'567")


def test_clock_offsets(spark):
    from lectern.plans.audit import minutes_ahead

    rows = frame(spark, [("2026-01-01T12:00:00Z",), ("2026-01-01T13:30:00+00:00",), ("2026-01-01T13:30:00+02:00",), ("nonsense",)], "at string")
    assert [r.m for r in rows.select(minutes_ahead(F.col("at"), F.lit("2026-01-01T12:00:00Z")).alias("m")).collect()] == [0, 90, -30, None]


def test_states_and_guard(spark):
    items = frame(spark, [("k", "**Open**"), ("k", "actioned (2026)"), ("k", "weird")], "kb string, state string").withColumn("state", A.item_state(F.col("state")))
    row = A.items_by_state(items.where("state IS NOT NULL")).first()
    assert (row.open, row.actioned, row.deferred, row.withdrawn) == (1, 1, 0, 0)
    with pytest.raises(Exception, match="unknown state"):
        A.items_by_state(items).collect()
    assert J.guard_empty(items.where("false"), "none").first().ok


def test_degrees_where_key_spaces_meet(spark, tmp_path):
    """with part keys beyond 100000 a part and a supplier may be one node, and the SQL counts its link to itself."""
    import duckdb

    from lectern.plans import registry

    frame(spark, [(100_007, 7), (100_007, 7), (100_007, 8), (5, 7)], "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = {(r.node, r.inbound, r.outbound) for r in registry.QUERIES["g7_degrees"](spark, str(tmp_path)).collect()}
    assert got == set(con.sql(registry.ORACLE["g7_degrees"]).fetchall()) and (100_007, 2, 2) in got
    links = frame(spark, [(1, 1), (1, 2)], "src int, dst int")
    assert {(r.node, r.inbound, r.outbound) for r in G.degrees(frame(spark, [(1,), (2,)], "node int"), links).collect()} == {(1, 0, 1), (2, 1, 0)}


def test_lineage_deals_edges_once_by_their_start(spark, monkeypatch):
    """edges were shuffled to be made distinct and once more to be joined, at each level."""
    import contextlib
    import io
    import re

    held, write = [], G.materialise
    monkeypatch.setattr(G, "materialise", lambda df, name: held.append(df) or write(df, name))
    cites = frame(spark, [(1, 2), (1, 2), (2, 3), (3, 1), (1, 3)], "concept int, page int")
    assert {tuple(r) for r in G.lineage(cites, frame(spark, [(1,)], "node int")).collect()} == {(1, 1, 0), (1, 2, 1), (1, 3, 1)}
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        held[1].explain()
    assert not re.search(r"hashpartitioning\(node#\d+L?, next#", text.getvalue())


def test_lineage_shuffles_a_level_in_shares(spark, monkeypatch):
    """a level's rows were all shuffled at once, and all that was seen once more when nothing was reached."""
    monkeypatch.setattr(G, "SHARE_ROWS", 60, raising=False)
    pairs = [(i, (7 * i + k) % 40) for i in range(40) for k in (1, 5)] + [(i, 100 + i) for i in range(40)] + [(None, 3), (3, None)]
    names, write = [], G.materialise
    monkeypatch.setattr(G, "materialise", lambda df, name: names.append(name) or write(df, name))
    rows = G.lineage(frame(spark, pairs, "concept int, page int"), frame(spark, [(0,), (9,), (500,)], "node int")).collect()
    want = {}
    for root in (0, 9, 500):
        want[root, root], front, depth = 0, {root}, 0
        while front:
            depth += 1
            front = {b for a, b in pairs if a is not None and a in front and (root, b) not in want}
            want |= {(root, b): depth for b in front}
    assert sorted(map(str, rows)) == sorted(f"Row(root={a}, node={b}, depth={d})" for (a, b), d in want.items())
    first = names.index("lineage_0")
    assert names[1:first] == [f"reached_{i}" for i in range(3)]
    names.clear()
    G.lineage(frame(spark, [(1, 2)], "concept int, page int"), frame(spark, [(1,)], "node int"))
    assert names == ["lineage", "reached_0", "lineage_0", "reached_0"]
