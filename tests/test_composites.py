"""Transforms, composites, sinks, streams and layout on small rows."""

import numpy as np
from pyspark.sql import functions as F

from lectern.operators import layout, transforms as X, windows as W
from lectern.plans import composites as Q
from lectern.sources import history, sinks, vault
from lectern.streaming import clock
from tests import vault_fixture as V


def texts(spark, *bodies):
    return spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "doc string, text string")


def out(rows):
    return {r.doc: r.text for r in rows.collect()}


TABLE = "| Date | Event |\n| --- | --- |\n| 2026-01-01 | a |"


def test_table_verdicts(spark):
    docs = texts(spark, f"prose\n{TABLE}", f"{TABLE}\n\nprose\n| 2026-01-02 | b |", f"{TABLE}\n\n# Other\nprose\n| 2026-01-02 | b |", "- item\n| a | b |", "\n| 1 | 2 |\n| 3 | 4 |")
    got = {(r.doc, r.verdict) for r in X.table_verdicts(W.lines_of(docs)).collect()}
    assert got == {("0", "blank"), ("1", "hoist"), ("2", "held"), ("3", "held"), ("4", "headerless")}


def test_rejoin_and_headers(spark):
    docs = texts(spark, f"{TABLE}\n\nprose\n| 2026-01-02 | b |\n| 2026-01-03 | c |\nend", f"{TABLE}\n| Date | Event |\n| --- | --- |\n| 2026-01-02 | b |", f"{TABLE}\n| X | Y |\n| --- | --- |\n| 1 | 2 |")
    back = out(X.rejoined(docs))
    assert back["0"] == f"{TABLE}\n| 2026-01-02 | b |\n| 2026-01-03 | c |\n\nprose\nend"
    once = out(X.headers_once(docs))
    assert once["1"] == f"{TABLE}\n| 2026-01-02 | b |" and once["2"] == f"{TABLE}\n\n| X | Y |\n| --- | --- |\n| 1 | 2 |"


def test_widths_and_dates(spark):
    docs = texts(spark, "| a | b |\n| --- | --- |\n| 1 | 2 | [^n] |", "| a | b | Source |\n| --- | --- | --- |\n| 1 | two [^n] |", "| Date | E |\n| --- | --- |\n| 2026-02-01 | b |\n| undated | c |\n| 2026-01-01 | a |")
    got = out(X.widths_mended(docs))
    assert got["0"].endswith("| 1 | 2[^n] |") and got["1"].endswith("| 1 | two | [^n] |")
    assert out(X.date_tables_sorted(docs))["2"].split("\n")[2:] == ["| 2026-01-01 | a |", "| 2026-02-01 | b |", "| undated | c |"]


def test_items_appends_and_edits(spark):
    row = "| 1 | d | see [x](y.md) | {} | r |"
    docs = texts(spark, "\n".join(["head", row.format("**actioned**"), row.format("open")]))
    got = X.closed_items(docs).first()
    assert got.text == "head\n" + row.format("open") and got.closed == row.format("**actioned**").replace("(y.md)", "(../y.md)")
    target = spark.createDataFrame([("a.md", "---\nsources:\n  - id: old\n    resource: p\n---\n# One\n\ntext\n\n[^old]: n\n")], "doc string, text string")
    request = spark.createDataFrame([("w", "### APPEND a.md\n#### section One\nmore [^new]\n#### footnotes\n[^old]: again\n[^new]: m\n#### sources\n- id: new\n    resource: q\n")], "writer string, text string")
    fixed = X.appended(target, X.append_requests(request)).first().text
    assert fixed.count("[^old]:") == 1 and "[^new]: m" in fixed and fixed.index("more [^new]") < fixed.index("[^old]:") and "  - id: new" in fixed
    swapped = X.replaced(texts(spark, "a ../x b"), spark.createDataFrame([("0", "../x", "../../x")], "doc string, old string, new string"))
    assert swapped.first().text == "a ../../x b"


def test_render(spark):
    got = spark.createDataFrame([("# A <b>\n\ntext **x** `y` [l](a.md)\n\n- i\n- j\n\n```\n<z>\n```",)], "t string").select(X.rendered("t")).first()[0]
    assert "<h1>A &lt;b&gt;</h1>" in got and "<strong>x</strong>" in got and "<code>y</code>" in got and '<a href="a.md">l</a>' in got and "<ul><li>i</li><li>j</li></ul>" in got and "<pre>&lt;z&gt;</pre>" in got


def base(spark, extra=()):
    files = {**V.FILES, **dict(extra)}
    return vault.tables(spark.createDataFrame([(f"Orchard_kb/{p}", t) for p, t in files.items()], "path string, text string"), V.NOW)


def test_composites(spark):
    quince = V.FILES[V.A].replace(V.END, "\nIt has borne fruit to at least 2025. Anna Berg convened the pruning.[^quince-record] The end is not stated anywhere.\n" + V.END)
    page = V.FILES["Raw/quince-record.md"] + "\nFrom: Carl Dorn\n"
    report = '{"generated": "2026-01-20T00:00:00", "complete": true, "changes": [{"path": "Raw/quince-record.md", "status": "modified", "contentChanged": true}]}'
    v = base(spark, [(V.A, quince), ("Raw/quince-record.md", page), ("Raw/_CHANGES-1.json", report)])
    assert {(r.shape, r.text) for r in Q.stale_claims(v).collect()} == {("date", "2025"), ("absence", "is not stated anywhere")}
    assert [(r.name, r.page) for r in Q.attribution(v).collect()] == [("Anna Berg", "Raw/quince-record.md")]
    assert [r.concept for r in Q.changed_pages(v).collect()] == [V.A]
    assert {r.action for r in vault.triage(v.changes).collect()} == {"rebuild"}
    tools = Q.Tools(v)
    assert tools.search("quince").first().doc == f"Orchard_kb|{V.A}"
    assert tools.concept("../secrets").count() == 0 and tools.concept(V.A).first().sources
    assert tools.changed_since("2026-01-01").count() == 3
    items = spark.createDataFrame([("Orchard_kb", "x", "open", "")], "kb string, item string, state string, resolution string")
    lengths = Q.queues(v, items, spark.createDataFrame([], "kb string, a string, b string"))
    assert {r.queue: r.n for r in lengths.collect()}["total"] == 2 + 1
    reports = spark.createDataFrame([("Orchard_kb", "r-v2", "2026-01-01", 2), ("Orchard_kb", "r", "2026-01-01", 1)], "kb string, file string, day string, version int")
    assert '"report":"r-v2"' in Q.dashboard(v, lengths, reports).first().object
    prints = Q.fingerprints(v.pages)
    assert prints.count() == 2 and prints.select("body_md5").distinct().count() == 2


def test_name_scan(spark):
    people = spark.createDataFrame([("k", "p1", "Anna", "Berg"), ("k", "p2", "Anna", "Dorn"), ("k", "p3", "Emil", "Falk")], "kb string, person string, first string, last string")
    pages = spark.createDataFrame([("k", 1, "Anna Berg and Falk, Emil"), ("k", 2, "A. Dorn met Emil"), ("k", 3, "Anna alone; the boss")], "kb string, page int, text string")
    alias = spark.createDataFrame([("k", "p3", "the boss")], "kb string, person string, alias string")
    got = {(r.person, r.family, r.page) for r in Q.name_scan(pages, people, alias).collect()}
    assert got == {("p1", "full", 1), ("p3", "outlook", 1), ("p3", "first", 1), ("p2", "initial", 2), ("p3", "first", 2), ("p3", "alias", 3)}


def test_stream_clock(spark, tmp_path):
    rows = [("k", "p", "m", 1, "d1"), ("k", "p", "m", 2, "d2"), ("k", "p", "m", 3, "d3"), ("k", "p", "gap", 1, "d1"), ("k", "p", "gap", 3, "d3")]
    schema = "kb string, path string, message string, run long, day string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = clock.finding_clock(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    run = stream.writeStream.format("memory").queryName("clocked").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").start()
    run.processAllAvailable()
    run.stop()
    assert {(r.message, tuple(r.days), r.escalated) for r in spark.table("clocked").collect()} == {("m", ("d1", "d2", "d3"), True), ("gap", ("d3",), False)}


def test_layout(spark):
    nodes = spark.createDataFrame([("k", f"n{i}", i) for i in range(12)], "kb string, node string, born int")
    links = spark.createDataFrame([("k", f"n{i}", f"n{i + 1}") for i in range(8)], "kb string, src string, dst string")
    placed = layout.layout(nodes, links)
    at = np.array([(r.x, r.y, r.z) for r in placed.collect()])
    assert at.shape == (12, 3) and np.isfinite(at).all() and len(np.unique(at[:, :2].round(6), axis=0)) == 12
    halo = layout.halos(placed, nodes.select("kb", "node", F.lit("g").alias("grp"))).first()
    assert halo.radius > 0


def test_sinks_and_history(spark, tmp_path):
    v = base(spark)
    sinks.write_tsv(sinks.concept_inventory(v.concepts), f"{tmp_path}/inventory")
    assert sinks.read_tsv(spark, f"{tmp_path}/inventory", "kb string, line string").count() == 3
    rows = spark.createDataFrame([("k", 1, "| a |")], "kb string, line int, text string")
    assert sinks.write_report(rows, "k", f"{tmp_path}/r.md", "stamp 1") and not sinks.write_report(rows, "k", f"{tmp_path}/r.md", "stamp 2")
    plan = sinks.batch_plan(spark.createDataFrame([("Über uns", i) for i in range(60)], "scope string, page int"))
    assert {(r.id, r.n) for r in plan.collect()} == {("ueber-uns-1", 55), ("ueber-uns-2", 5)}
    import subprocess

    for command in (["init", "-q"], ["-c", "user.name=n", "-c", "user.email=e", "commit", "-q", "--allow-empty", "-m", "x"]):
        subprocess.run(["git", "-C", str(tmp_path), *command], check=True)
    history.register(spark)
    assert spark.read.format("git_log").option("root", str(tmp_path)).load().columns == ["path", "revision", "committed", "author"]
