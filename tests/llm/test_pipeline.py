"""The pipeline's stages, each on its own input, against what brute force says of them."""

import tracemalloc

from pyspark.sql import functions as F

import corpus_pipeline as P
from lectern.llm import jaccard_join, quality_rules
from tests.llm.conftest import prose
from tests.llm.test_operators import base, grams


def test_stages(spark, docs, label_rows, tmp_path):
    path = f"file://{tmp_path}"
    docs.write.parquet(f"{path}/documents.parquet")
    label_rows.write.parquet(f"{path}/labels.parquet")
    rows = spark.read.parquet(f"{path}/documents.parquet")
    whole = {r.doc_id: r.text for r in rows.collect()}
    seen = set(whole)
    for name, stage in P.STAGES[:-1]:
        rows = stage(spark, rows, path)
        assert rows.columns == docs.columns
        out = tmp_path / name.replace(" ", "_")
        rows.write.parquet(f"file://{out}")
        rows = spark.read.parquet(f"file://{out}")
        now = {r.doc_id for r in rows.collect()}
        if name == "quality rules":
            failed = {i for i, t in whole.items() if (c := base(t))[0] < 50 or 100 * c[4] > 50 * c[0]}
            assert not now & failed and set(range(120)) <= now
        elif name == "language ID":
            assert now == seen
        else:
            assert now < seen and 200 in now and not now & {201, 202, 203} and set(range(120)) <= now
            assert all(grams(whole[i]) for i in now)
        seen = now
    packed = P.STAGES[-1][1](spark, rows, path).collect()
    assert {r.doc_id for r in packed} == seen
    assert {r.doc_id for r in P.run(spark, path).collect()} == seen
    assert [n for n, _ in P.STAGES] == ["quality rules", "language ID", "n-gram Jaccard join", "packing"]


def five(text):
    words = text.lower().split()
    return set(zip(*(words[k:] for k in range(5))))


def test_near_copies_between_the_thresholds(spark, tmp_path):
    """Copies under op3's 0.9 of three-word shingles that share 0.8 of their five-word ones."""
    rows = []
    for n, at in enumerate((40, 60, 80, 99)):
        words = prose(7000 + n, 100).split()
        # One changed word in the middle breaks three and five shingles; two far apart break too many.
        rows += [(10 * n, " ".join(words)), (10 * n + 1, " ".join([*words[:at], "changed", *words[at + 1 :]]))]
        rows.append((10 * n + 2, " ".join([*words[:20], "other", *words[21:50], "words", *words[51:]])))
        rows.append((10 * n + 3, " ".join([*words[:12], "far", *words[13:34], "more", *words[35:66], "apart", *words[67:]])))
    parent = {i: i for i, _ in rows}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    between = 0
    for a, x in rows:
        for b, y in rows:
            near = 100 * len(five(x) & five(y)) >= 80 * len(five(x) | five(y))
            between += a < b and near and 100 * len(grams(x) & grams(y)) < 90 * len(grams(x) | grams(y))
            if near:
                p, q = sorted((top(a), top(b)))
                parent[q] = p
    assert between
    want = {i for i, _ in rows if top(i) == i}
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in P.near_duplicate_stage(spark, frame, str(tmp_path)).collect()}
    assert got == want and got != {r.doc_id for r in jaccard_join.jaccard_components(frame).where("doc_id = component_id").collect()}


def test_the_fit_of_the_quality_rules_needs_little_beside_its_ngrams():
    """The driver's memory: a step's arrays are of a block's size, not of the sample's."""
    sample = [(prose(i, 300), i % 2, i % 10) for i in range(600)]
    quality_rules.fit(sample[:150], rounds=1)
    tracemalloc.start()
    try:
        quality_rules.fit(sample, rounds=2)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    distinct = sum(len(set(zip(*(t[k:] for k in range(n))))) for t, _, _ in sample for n in (3, 5)) + sum(2 * len(t.split()) for t, _, _ in sample)
    assert peak < 8 * distinct + (12 << 20)


def test_the_join_leaves_little_on_disk(spark, docs, tmp_path, monkeypatch):
    """buckets, rounds of components, candidates and links stayed until the session's end."""
    from itertools import count

    from lectern import session

    number = count()
    monkeypatch.setattr(session, "shared_dir", lambda spark: f"file://{tmp_path}/{next(number)}")
    for percent in (90, 80):
        found = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs, percent=percent, hot=2).where("doc_id IS NOT NULL").collect()}
        assert found[201] == found[203] == 200 and found[601] == 600
    left = sorted(p.name for p in tmp_path.glob("*/*"))
    assert sorted(set(left)) == ["busy", "parts", "reps"] and len(left) == 6


def test_a_pass_shuffles_its_rows_once(spark):
    """signatures were shuffled once to be counted and once more to be joined with their counts."""
    import contextlib
    import io

    rows = spark.createDataFrame([(1, 5, [1, 2]), (2, 5, [2, 3]), (3, 5, [2, 4])], "rep long, n long, sigs array<long>")
    held, write = [], jaccard_join.materialise
    jaccard_join.materialise = lambda df, name: held.append(df) or write(df, name)
    try:
        out = jaccard_join.buckets(lambda turn, rounds: rows, 1)
    finally:
        jaccard_join.materialise = write
    assert sorted(map(tuple, out.select("sig", "rep", "n", "size").collect())) == [(2, 1, 5, 3), (2, 2, 5, 3), (2, 3, 5, 3)]
    held[0].collect()
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        held[0].explain()
    final = text.getvalue().split("Initial Plan")[0]
    assert "ReusedExchange" in final or final.count("Exchange hashpartitioning(sig") == 1


def test_wide_sketches_keep_links_and_tell_large_sets_apart(spark, monkeypatch):
    """Round 2: 512 bits can't tell large sets apart, so their candidates all had their sets built and shuffled."""
    import numpy as np
    from pyspark.sql import functions as F

    random = np.random.default_rng(5)
    new = lambda n: np.unique(random.integers(1, 1 << 62, n).astype(np.uint64))
    sets = [new(n) for n in (300, 600, 1000, 2047, 2049, 4000, 9000)]
    pairs = [(x, np.unique(np.concatenate([x[random.permutation(len(x))[: int(len(x) * share)]], new(int(len(x) * extra))]))) for x in sets for share, extra in ((0.81, 0), (0.89, 0.1), (1, 0.24), (0.5, 0.5), (0, 1))]
    values, sizes = np.concatenate([s for p in pairs for s in p]), [len(s) for p in pairs for s in p]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    bits, (wide, at) = jaccard_join.sketches(values, offsets).tolist(), jaccard_join.wide_sketches(values, offsets)
    rows = [(k // 2, sizes[k], bits[k], wide[at[k] : at[k + 1]].tolist(), sizes[k + 1], bits[k + 1], wide[at[k + 1] : at[k + 2]].tolist()) for k in range(0, len(sizes), 2)]
    frame = spark.createDataFrame(rows, "pair int, a_n long, a_bits array<long>, a_wide array<long>, b_n long, b_bits array<long>, b_wide array<long>")
    got = {r.pair: (r.narrow, r.wide) for r in frame.select("pair", jaccard_join._may_link("a", "b", 80).alias("narrow"), jaccard_join._wide_may_link("a", "b", 80).alias("wide")).collect()}
    linked = {k for k, (x, y) in enumerate(pairs) if 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))}
    assert {k for k, x in got.items() if all(x)} == linked < {k for k, x in got.items() if x[0]}
    assert any(r[3] and len(r[3]) != len(r[6]) for r in rows)

    # The join uses them: large texts that share words but no set of half their size get no candidate.
    frame = spark.createDataFrame([(i, prose(8000 + i, 2500)) for i in range(6)] + [(9, prose(8000, 2500) + " end")], "doc_id long, text string")
    reps = jaccard_join.keys(frame, 5, sketch=True).select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "h1", "h2", "bits", "wide").cache()
    held, write = [], jaccard_join.materialise
    monkeypatch.setattr(jaccard_join, "materialise", lambda df, name: (held.append((name, df.count())), write(df, name))[1])
    links = jaccard_join.verified(frame, reps, reps.select(F.col("rep").alias("a")).crossJoin(reps.select(F.col("rep").alias("b"))).where("a < b"), 5, 80)
    assert [tuple(r) for r in links.collect()] == [(0, 9)] and ("candidates", 1) in held


def test_the_quality_rules_are_fitted_by_a_task(docs, label_rows, monkeypatch):
    """Round 2: the fit's memory was the driver's, beside that of the later stages."""
    import os

    monkeypatch.setattr(quality_rules, "fit", lambda sample: (os.getpid(), len(sample)))
    worker, n = quality_rules.fitted(docs, label_rows, 3_000)
    assert worker != os.getpid() and n > 100


def test_only_wanted_texts_are_shuffled(spark, docs, monkeypatch):
    """Round 2: all texts were shuffled for each share of candidates."""
    rows = spark.createDataFrame([(i, "x") for i in [*range(2_000), *range(0, 2_000, 3), -7, (1 << 62) - 1, None]], "doc_id long, text string")
    wanted = set(range(0, 2_000, 7)) | {-7, (1 << 62) - 1, 5_000}
    got = [r.doc_id for r in jaccard_join.marked(rows, spark.createDataFrame([(i,) for i in wanted], "doc_id long")).collect()]
    assert wanted - {5_000} <= set(got) and len(got) == len([i for i in [*range(2_000), *range(0, 2_000, 3), -7, (1 << 62) - 1] if i in set(got)])
    assert len(set(got)) < len(wanted) + 20
    assert jaccard_join.marked(rows, spark.createDataFrame([], "doc_id long")).count() == 0
    # Marks that are all set only cost time.
    before = sorted(map(tuple, jaccard_join.jaccard_components(docs, percent=80).collect()), key=str)
    monkeypatch.setattr(jaccard_join, "MARKS", 8)
    assert sorted(map(tuple, jaccard_join.jaccard_components(docs, percent=80).collect()), key=str) == before


def test_only_marked_texts_are_shuffled_for_their_sets(spark, monkeypatch):
    """the semi-join with the wanted ids was pushed below the marks, so all texts were shuffled for every round's sets."""
    docs = spark.range(0, 40).selectExpr("id AS doc_id", "concat('one two three four five six w', id) AS text")
    docs = docs.unionByName(docs.where("doc_id = 3")).unionByName(docs.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    wanted = jaccard_join.keys(docs, 3).where("doc_id IN (3, 5)").distinct().selectExpr("doc_id AS rep", "n_shingles AS n", "h1", "h2")
    held, write = {}, jaccard_join.materialise
    monkeypatch.setattr(jaccard_join, "materialise", lambda df, name: held.__setitem__(name, df) or write(df, name))
    sets = jaccard_join.sets_of(docs, wanted, 3, "sets").collect()
    assert sorted((r.rep, r.n, len(set(r.elements))) for r in sets) == [(3, 5, 5), (5, 5, 5)]
    plan = held["sets"]._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [line for line in plan if "Join" in line and ("doc_id" in line or "bitmap" in line)]
    assert "doc_id" in joins[0] and "bitmap" in joins[1]


def test_few_links_take_no_rounds_of_shuffles(spark, monkeypatch):
    """Round 3: every round of components planned dozens of shuffles for however few links, whose plans and threads filled the driver's memory."""
    import random

    def rows(links):
        return spark.createDataFrame(links, "a long, b long").repartition(3)

    def brute(links):
        least = {x: x for link in links for x in link}
        while any(least[a] != least[b] for a, b in links):
            for a, b in links:
                least[a] = least[b] = min(least[a], least[b])
        return least

    draw = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 300)]
    draw.shuffle(chain)
    nameless = jaccard_join.NAMELESS
    first = [(5, 9), (9, 5), (9, 9 + nameless), (nameless + 1, nameless + 2), (-4, 2), *chain, *((7, i) for i in range(1000, 1400))]
    second = [(draw.randrange(2000), draw.randrange(2000)) for _ in range(700)]
    second = [(a, b) for a, b in second if a != b]

    def found():
        parts = jaccard_join.Parts()
        for links in (first, [], second):
            parts.add(rows(links))
        return {r.rep: r.part for r in parts.rows.collect()}

    # The distributed rounds are for more links; both say the same.
    with monkeypatch.context() as few:
        few.setattr(jaccard_join, "connected_components", lambda links: (_ for _ in ()).throw(AssertionError("rounds of shuffles")))
        assert found() == brute(first + second)
        empty = jaccard_join.Parts()
        empty.add(rows([]))
        assert empty.rows.count() == 0
    monkeypatch.setattr(jaccard_join, "FEW", 3)
    assert found() == brute(first + second)


def test_rounds_of_candidates_count_sets_once(spark, docs, monkeypatch):
    """Round 3: the elements of all sets were summed again for every round, and the driver's garbage stayed until its heap was full."""
    counted, tidied, shares = [], [], []
    count, tidy, compare = jaccard_join.elements, jaccard_join.tidy, jaccard_join.compared
    monkeypatch.setattr(jaccard_join, "elements", lambda sets: counted.append(sets.columns) or count(sets))
    monkeypatch.setattr(jaccard_join, "tidy", lambda session: tidied.append(1) or tidy(session))
    monkeypatch.setattr(jaccard_join, "compared", lambda *a: shares.append(1) or compare(*a))
    found = lambda: sorted(map(tuple, jaccard_join.jaccard_components(docs, percent=80, hot=2).collect()), key=str)
    whole = found()
    assert sum("h1" in columns for columns in counted) == 1 and len(tidied) >= 6
    # More shares of candidates give the same links.
    once = len(shares)
    monkeypatch.setattr(jaccard_join, "ROUNDS", 500)
    assert found() == whole and len(shares) - once > once
