"""The clean fixture says nothing; each edit of it says what it should."""

import pytest

from lectern.plans import audit
from lectern.sources import vault
from tests import vault_fixture as V


def rows(case=None):
    files = dict(V.FILES)
    if case:
        _, path, edit = case
        files[path] = edit(files.get(path, ""))
    return files


@pytest.fixture(scope="module")
def all_findings(spark):
    """One run over a vault with the clean base and a base for each case."""
    data = [(f"Orchard_kb/{p}", t) for p, t in V.FILES.items()]
    options = list(V.OPTIONS)
    for n, case in enumerate(V.CASES):
        kb = f"Case{n}_kb"
        data += [(f"{kb}/{p}", t) for p, t in rows(case).items()]
        options += [(kb, k, v) for _, k, v in V.OPTIONS]
    files = spark.createDataFrame(data, "path string, text string").repartition(4).cache()
    v = vault.tables(files, V.NOW, spark.createDataFrame(options, "kb string, key string, value string"))
    for name in ("concepts", "citations", "pages", "lines", "footnotes", "links"):
        setattr(v, name, getattr(v, name).cache())
    return audit.findings(v).collect()


def test_clean_base_says_nothing(all_findings):
    assert [(r.check_id, r.path, r.message) for r in all_findings if r.kb == "Orchard_kb"] == []


@pytest.mark.parametrize("n", range(len(V.CASES)), ids=[c[0] for c in V.CASES])
def test_case(all_findings, n):
    said = {r.check_id for r in all_findings if r.kb == f"Case{n}_kb"}
    assert V.CASES[n][0] in said


def test_options_off(spark):
    files = spark.createDataFrame([(f"Orchard_kb/{p}", t) for p, t in rows(V.CASES[6]).items()], "path string, text string")
    assert audit.findings(vault.tables(files, V.NOW), ["C08"]).collect() == []
