"""Checks that must not compare every row with every file, and what they say all the same."""

import contextlib
import io
import time

import pytest

from lectern.plans import audit
from lectern.sources import vault

CONCEPT = "---\ntype: A\ntitle: T\n---\n\n"
FILES = {
    "A_kb/CLAUDE.md": "base\n",
    "A_kb/Wiki/a.md": CONCEPT + "[b](b.md) [gone](gone.md) [other](../../B_kb/Wiki/a.md) [dead](../../B_kb/Wiki/gone.md) [web](https://x.org/y.md) [x](x.txt)\n",
    "A_kb/Wiki/b.md": CONCEPT + "[root](/Wiki/a.md) [rootless](/Wiki/none.md)\n",
    "A_kb/Raw/_INGESTED.md": "- `Raw/a.md`\n- `Raw/none.md`\n- `2000-01-01.md`\n- `elsewhere.md`\n",
    "A_kb/Raw/a.md": "text\n",
    "A_kb/Outputs/2000-01-01.md": "report\n",
    "B_kb/CLAUDE.md": "base\n",
    "B_kb/Wiki/a.md": CONCEPT + "text\n",
    "B_kb/Raw/elsewhere.md": "text\n",
}


@pytest.fixture(scope="module")
def small(spark):
    return vault.tables(spark.createDataFrame(list(FILES.items()), "path string, text string"), "2000-06-30T12:00:00Z")


def plan(frame):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        frame.explain()
    return text.getvalue()


def said(rows):
    return sorted((r.kb, r.path, r.message) for r in rows.collect())


def test_dead_links_join_by_equality(small):
    """C67 compared every link with every file, and read YAML that it has no use for."""
    rows = audit.findings(small, ["C67"])
    assert said(rows) == [
        ("A_kb", "Wiki/a.md", "dead link: gone.md"),
        ("A_kb", "Wiki/a.md", "link into another base is dead: ../../B_kb/Wiki/gone.md"),
        ("A_kb", "Wiki/b.md", "dead link: /Wiki/none.md"),
    ]
    assert not any(w in plan(rows) for w in ("NestedLoop", "CartesianProduct", "parse_blocks"))


def test_registers_join_by_path(small):
    """C98 compared every register row with all files of its base."""
    rows = audit.findings(small, ["C98"])
    assert said(rows) == [("A_kb", "Raw/_INGESTED.md", "register names a missing file: Raw/none.md"), ("A_kb", "Raw/_INGESTED.md", "register names a missing file: elsewhere.md")]
    joins = [line for line in plan(rows).splitlines() if "LeftAnti" in line]
    assert joins and all("path" in line.split("LeftAnti")[0] for line in joins)


def test_first_person_in_long_lines(spark):
    """C30 looked for a hit from every place of a line, in time that grew with the square of its length."""
    long = "the cat sat on a mat and " * 6_000
    files = {"A_kb/CLAUDE.md": "base\n", "A_kb/Wiki/a.md": CONCEPT + long + "\n", "A_kb/Wiki/b.md": CONCEPT + "Then we saw. " + long + "\n", "A_kb/Wiki/c.md": CONCEPT + "Phase I was long. In this phase I think.\n"}
    v = vault.tables(spark.createDataFrame(list(files.items()), "path string, text string"), "2000-06-30T12:00:00Z")
    began = time.monotonic()
    assert said(audit.findings(v, ["C30"])) == [("A_kb", "Wiki/b.md", "first person: we")]
    assert time.monotonic() - began < 30


def test_own_rows_in_one_scan(spark):
    """each check of a concept's own row scanned all concepts once more."""
    files = {"A_kb/CLAUDE.md": "base\n", "A_kb/Wiki/a.md": "---\nstatus: draft\n---\n\nIt cost CHF 4,500 then.\n", "B_kb/CLAUDE.md": "base\n", "B_kb/Wiki/a.md": "---\nstatus: draft\n---\n\ntext\n"}
    options = spark.createDataFrame([("B_kb", "draft_needs_reason", "")], "kb string, key string, value string")
    v = vault.tables(spark.createDataFrame(list(files.items()), "path string, text string"), "2000-06-30T12:00:00Z", options)
    v.concepts = v.concepts.localCheckpoint()
    rows = audit.findings(v, ["C04", "C40", "C44"])
    assert plan(rows).count("Scan ExistingRDD") == 1 + plan(options).count("Scan ExistingRDD")
    got = sorted((r.kb, r.path, r.check_id, r.severity, r.message) for r in rows.collect())
    assert got == [
        ("A_kb", "Wiki/a.md", "C04", "D", "type missing"),
        ("A_kb", "Wiki/a.md", "C40", "F", "currency with a comma"),
        ("B_kb", "Wiki/a.md", "C04", "D", "type missing"),
        ("B_kb", "Wiki/a.md", "C44", "F", "draft without a reason"),
    ]
