"""Each operator against a brute-force version, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import bpe_codec, chat_format, jaccard_join, language_id, packing, quality_classifier, quality_rules, token_counts, topk_search, toxicity
from lectern.llm.bpe import load
from tests.llm.conftest import corpus

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts() -> list[tuple]:
    return [(r[0], r[1]) for r in corpus()]


def base(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(docs, label_rows, none):
    got = quality_rules.assess(docs, label_rows).collect()
    assert len(got) == len(texts())
    want = defaultdict(set)
    for i, t in texts():
        want[i].add(base(t))
    for r in got:
        counts = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert counts in want[r.doc_id]
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in got if r.kept}
    assert set(range(120)) <= kept
    assert not kept & set(range(430, 450))
    assert quality_rules.assess(none, label_rows).count() == 0
    assert all(r.kept != r.base_failed for r in quality_rules.assess(docs, label_rows.where("false")).collect())


def test_quality_classifier(docs, label_rows, none):
    got = {r.doc_id: r for r in quality_classifier.classify(docs, label_rows).collect()}
    held = [i for i in got if i is not None and got[i].held_out]
    assert set(held) == {i for i in got if i is not None and zlib.crc32(str(i).encode()) % 4 == 2}
    good, bad = [got[i].score for i in held if i < 120], [got[i].score for i in held if 400 <= i < 450]
    assert np.mean([s >= 0.7 for s in good]) > 0.9 and np.mean([s < 0.7 for s in bad]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert quality_classifier.classify(none, label_rows).count() == 0


def test_toxicity(docs, label_rows, none):
    got = {r.doc_id: r for r in toxicity.classify(docs, label_rows).collect()}
    assert {i for i in got if i is not None and got[i].held_out} == {i for i in got if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}
    held = [i for i in got if i is not None and got[i].held_out]
    assert all(got[i].predicted == 1 for i in held if 500 <= i < 530)
    assert np.mean([got[i].predicted == 0 for i in held if i < 120]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert toxicity.classify(none, label_rows).count() == 0
    assert {r.predicted for r in toxicity.classify(docs, label_rows.where("false")).collect()} == {0}


def test_language_id(docs, none):
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    for i in range(120):
        assert got[i].lang_pred == ("en" if i % 3 else "de")
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert {got[i].lang_pred for i in (300, 301, 302, 303)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language_id.identify(none).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def ppm_bits(train: list[bytes], data: bytes, symbols: int, order: int) -> float:
    """Code length by walking contexts one byte at a time."""
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for text in train:
        padded = b" " * order + text
        for i in range(order, len(padded)):
            for k in range(order + 1):
                counts[k][padded[i - k : i]][padded[i]] += 1
    bits, padded = 0.0, b" " * order + data
    for i in range(order, len(padded)):
        for k in range(order, -1, -1):
            seen = counts[k].get(padded[i - k : i])
            if not seen:
                continue
            total, kinds = sum(seen.values()), len(seen)
            if padded[i] in seen:
                bits -= math.log2(seen[padded[i]] / (total + kinds))
                break
            bits -= math.log2(kinds / (total + kinds))
        else:
            bits += math.log2(symbols)
    return bits


def test_language_code_lengths():
    import pyarrow as pa

    from lectern.llm.features import fold_words

    sample = [("the cat sat on the mat", "en"), ("a dog and the cat", "en"), ("le chat est sur le tapis", "fr")]
    model = language_id.train(sample)
    probe = pa.array(["the dog sat", "le chien"])
    bits, _, _ = model.lengths(probe)
    data, at = fold_words(probe)
    for j, name in enumerate(model.names):
        streams = [fold_words(pa.array([t]))[0] for t, lang in sample if lang == name]
        for i in range(2):
            assert abs(bits[i, j] - ppm_bits(streams, data[at[i] : at[i + 1]], model.count, model.order)) < 1e-3


def grams(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset([tuple(words)] if 0 < len(words) < 3 else zip(words, words[1:], words[2:]))


def test_jaccard_components(docs, none):
    rows = [(i, grams(t)) for i, t in texts() if i is not None]
    parent = {i: i for i, _ in rows}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, x in rows:
        for b, y in rows:
            if x and y and 100 * len(x & y) >= 90 * len(x | y):
                p, q = sorted((top(a), top(b)))
                parent[q] = p
    want = sorted((i, len(g), top(i)) for i, g in rows)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs.where("doc_id IS NOT NULL")).collect())
    assert got == want
    assert jaccard_join.jaccard_components(docs).count() == len(texts())
    assert jaccard_join.jaccard_components(none).count() == 0


def test_jaccard_signatures_are_complete():
    """Random small and middling sets at and above the threshold always share a signature."""
    random = np.random.default_rng(3)
    for n in (9, 10, 11, 18, 19, 20, 27, 40, 95, 210):
        for _ in range(60):
            first = np.unique(random.integers(1, 1 << 62, n).astype(np.uint64))
            keep = first[random.permutation(len(first))[: len(first) - random.integers(0, max(2, n // 12))]]
            second = np.unique(np.concatenate([keep, random.integers(1, 1 << 62, random.integers(0, max(2, n // 12))).astype(np.uint64)]))
            a, b = set(first.tolist()), set(second.tolist())
            if a != b and 100 * len(a & b) >= 90 * len(a | b):
                values, offsets = np.concatenate([first, second]), np.array([0, len(first), len(first) + len(second)])
                sigs, at = jaccard_join.signatures(values, offsets, 90)
                assert set(sigs[: at[1]].tolist()) & set(sigs[at[1] :].tolist())
                bits = jaccard_join.sketches(values, offsets)
                assert sum(int(x).bit_count() for x in (bits[0] ^ bits[1]).view(np.uint64)) <= len(a ^ b)


def test_topk_search(spark):
    random = np.random.default_rng(1)
    rows = [(i, [float(x) for x in random.normal(0, 1, 16)]) for i in range(700)] + [(1000 + i, [0.5] * 16) for i in range(300)]
    rows += [(5000, None), (5100, [1.0, float("nan")]), (5200, [float("inf")] * 16), (5300, [None] * 16), (5301, []), (None, [1.0] * 16)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in sorted(i for i in whole if i % 100 == 0):
        best = sorted(((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q))[:10]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in topk_search.search(frame).collect()) == want
    assert topk_search.search(frame.where("false")).count() == 0


def test_bpe_round_trip(docs, none):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in texts():
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in bpe_codec.round_trip(docs).collect()) == want
    encoded = bpe_codec.encode(docs)
    assert Counter((r.doc_id, len(r.ids)) for r in encoded.collect()) == Counter(k[:2] for k in want.elements())
    assert Counter(r.text for r in bpe_codec.decode(encoded).collect()) == Counter(t or "" for _, t in texts())
    assert bpe_codec.round_trip(none).count() == 0


def test_bpe_on_odd_strings():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    bpe = load(public_tokenizers.path("byte_bpe_50k.json"))
    random = np.random.default_rng(4)
    letters = list("abc thE's\n\t 1234'll!!é中🙂ßİΣ́\x1c\x85 ") + ["<|endoftext|>", "  ", "aaaa"]
    for _ in range(1500):
        text = "".join(random.choice(letters, random.integers(0, 25)))
        assert bpe.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_counts(docs, none, tmp_path):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in texts():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[(i, len((t or "").encode()), n, n > 512)] += 1
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        assert Counter(tuple(r) for r in token_counts.count_tokens(docs, cache=cache).collect()) == want
    held = docs.sparkSession.read.parquet(cache)
    assert held.count() == held.select("digest").distinct().count() == len({t or "" for _, t in texts()})
    assert token_counts.count_tokens(none, cache=f"file://{tmp_path}/other").count() == 0


def test_packing(docs, none):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole = docs.where("doc_id IS NOT NULL AND doc_id <> 302")
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(whole).collect():
        assert r.doc_tokens == len(ids[r.doc_id])
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length > 0 and r.ids_crc32 == zlib.crc32(np.array(own, dtype="<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids) - {None, 302}
    for i, parts in pieces.items():
        assert [s for s, _ in sorted(parts)] == list(np.cumsum([0] + [n for _, n in sorted(parts)])[:-1])
        assert sum(n for _, n in parts) == len(ids[i])
    for parts in sequences.values():
        assert [s for s, _ in sorted(parts)] == list(np.cumsum([0] + [n for _, n in sorted(parts)])[:-1])
        size = sum(n for _, n in parts)
        assert size <= 4096 and size & (size - 1) == 0
    assert packing.pack(docs).where("doc_id = 302").count() >= 2
    assert packing.pack(none).count() == 0


def test_packing_neighbours_share_words():
    """A seed's neighbours are the documents with its rare terms, by brute-force BM25 as well."""
    random = np.random.default_rng(2)
    ids = [random.integers(0, 300, random.integers(20, 60)).astype(np.uint32) for _ in range(80)]
    index = packing.Index(ids)
    used = np.zeros(80, bool)
    used[[0, 5]] = True
    mean = np.mean([len(x) for x in ids])
    counts = [Counter(x.tolist()) for x in ids]
    spread = Counter(t for c in counts for t in c)

    def weight(i, t):
        n = counts[i][t]
        return math.log1p((80 - spread[t] + 0.5) / (spread[t] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(ids[i]) / mean)) if n else 0.0

    terms = sorted(counts[0], key=lambda t: -weight(0, t))[: packing.QUERY_TERMS]
    score = {i: sum(weight(i, t) for t in terms) for i in range(80) if not used[i]}
    best = max(score.values())
    got = index.neighbours(0, used)
    assert not used[got].any() and abs(score[int(got[0])] - best) < 1e-9


def test_chat_format(spark):
    rows = [(1, 0, "system", "be [kind] </s> \\"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "user", None), (1, 3, "assistant", "yes <+> </> [[user]]"), (1, 4, "assistant", "more\n"), (2, 0, "assistant", ""), (3, 1, "a]]b\\", "x"), (3, 0, None, "y"), (None, 0, "user", "z"), (4, 0, "user", "same"), (4, 0, "user", "same")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    formatted = chat_format.format_conversations(frame)
    got = {r.conv_id: r for r in chat_format.read_back(formatted).collect()}
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])]
        assert [(t.role, t.text) for t in got[conv].turns] == turns
        assert got[conv].loss_text == "".join(t for role, t in turns if role == "assistant")
    merged = {r.conv_id: [len(b.texts) for b in r.blocks] for r in chat_format.merge_turns(frame).collect()}
    assert merged[1] == [1, 2, 2] and merged[4] == [2]
    assert chat_format.format_conversations(frame.where("false")).count() == 0


def test_word_contexts_cover_all_documents(spark, docs, label_rows):
    """Contexts by walking all tokens one at a time; documents without a label change what a word means."""
    import pyarrow as pa

    C = quality_classifier
    place, sign = C.index_vectors()
    want = np.zeros((C.VOCABULARY, C.DIM))
    for _, t in texts():
        bucket, _ = C.tokens(pa.array([(t or "")[:4000]], pa.string()))
        for i, b in enumerate(bucket):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(bucket):
                    np.add.at(want[b], place[bucket[j]], sign[bucket[j]])
    assert np.array_equal(C.corpus_contexts(docs.withColumn("text", F.substring("text", 1, 4000))), want)
    probe = spark.createDataFrame([(9000, "quokka " * 30)], "doc_id long, text string")
    told = spark.createDataFrame([(9100 + i, "quokka stone") for i in range(20)], "doc_id long, text string")
    few = docs.select("doc_id", "text").where("doc_id < 120 OR doc_id BETWEEN 400 AND 449").unionByName(probe)
    score = [C.classify(rows, label_rows).where("doc_id = 9000").first().score for rows in (few, few.unionByName(told))]
    assert abs(score[0] - score[1]) > 1e-6


def test_packing_meets_across_splits(spark):
    """Documents of one topic, each in another input split, share sequences, whatever the splits."""
    random = np.random.default_rng(8)
    common = ["amber", "birch", "stone", "river", "north", "light", "green", "water"]
    topics = ["quokka", "zeppelin", "marzipan", "bassoon", "glacier", "tungsten", "saffron", "harpoon", "walrus", "monsoon"]
    rows = [(split * 10 + k, " ".join(random.permutation([topic] * 60 + [str(random.choice(common)) for _ in range(440)]))) for split in range(8) for k, topic in enumerate(topics)]
    found = []
    for splits in (8, 3):
        frame = spark.createDataFrame(spark.sparkContext.parallelize(rows, splits), "doc_id long, text string")
        got = packing.pack(frame, shard_tokens=9_000).collect()
        assert {r.doc_id for r in got} == {i for i, _ in rows}
        sequences = defaultdict(set)
        for r in got:
            sequences[r.sequence_id].add(r.doc_id)
        found.append(Counter(map(frozenset, sequences.values())))
        met = {i for docs in sequences.values() for i in docs if any(j != i and j % 10 == i % 10 for j in docs)}
        assert len(met) >= 0.9 * len(rows)
    assert found[0] == found[1]


def test_packing_asks_for_further_neighbours():
    """A seed with more than NEIGHBOURS short related documents fills its window with them, not with the next in order."""
    ids = [np.array([7, 8, 9, 5], np.uint32)] + [np.array([100 + i, 101 + i, 102 + i, 103 + i], np.uint32) for i in range(300)] + [np.array([7, 8, 9, 6], np.uint32)] * 100
    first = next(packing.windows(np.full(len(ids), 4), packing.Index(ids), 4 * 101))
    assert {d for d, _, _ in first} == {0, *range(301, 401)}


def test_toxic_dictionary_is_trained_on_toxic_windows():
    """What recurs in toxic texts alone ends up in the toxic dictionary; chosen windows are windows of toxic texts."""
    from tests.llm.conftest import prose

    rare = [("zyx" + "abcdefgh"[k] * 4 + "qv").encode() for k in range(4)]
    toxic = [b" " + prose(i, 30).encode() + b" " + rare[i % 4] + b" " + prose(5000 + i, 10).encode() + b" " for i in range(200)]
    ordinary = [b" " + prose(10_000 + i, 40).encode() + b" " for i in range(600)]
    windows = toxicity.toxic_windows(toxic, ordinary)
    assert windows and all(len(w) == toxicity.SPAN and any(w in t for t in toxic) for w in windows)
    every = [t[i : i + toxicity.SPAN] for t in toxic for i in range(0, len(t) - toxicity.SPAN + 1, toxicity.STEP)]
    share = lambda found: np.mean([any(r in w for r in rare) for w in found])
    assert share(windows) > 1.5 * share(every)
    plain, dictionary = toxicity.train_dictionaries(toxic, ordinary)
    assert sum(any(w[i : i + 6] in dictionary for i in range(4)) for w in rare) >= 3 and not any(w in plain for w in rare)
    assert toxicity.train_dictionaries([], []) == (b" " * 48, b" ")


def test_toxicity_lengths_by_brute_force():
    """Each window's lengths are those of compressing it alone with either dictionary, and its distances follow from them."""
    import pyarrow as pa
    import zstandard
    from lectern.llm.features import fold_words
    from tests.llm.conftest import prose

    sample = [(prose(i, 40) + (" scoundrelly vermin " if i % 4 == 0 else " "), int(i % 4 == 0), i % 10) for i in range(200)]
    pair = toxicity.fit(sample)
    texts_ = pa.array([prose(999, 30) + " vermin", "", None, prose(998, 50)])
    data, offsets = fold_words(texts_)
    spans, at = toxicity.windows(offsets)
    got = pair.lengths(data, spans)
    way = zstandard.ZstdCompressionParameters(strategy=toxicity.STRATEGY, min_match=toxicity.MIN_MATCH, window_log=17, hash_log=15, chain_log=15, search_log=toxicity.SEARCH, write_content_size=0, write_checksum=0, write_dict_id=0)
    for lengths, content in zip(got, (pair.ordinary, pair.ordinary + pair.toxic + pair.ordinary[-16:])):
        one = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=way)
        assert [len(one.compress(data[a : a + n])) for a, n in spans.tolist()] == lengths.tolist()
    gain = got[0] - got[1]
    assert pair.measures(texts_)[:, 0].tolist() == [max(gain[a:b], default=0) for a, b in zip(at[:-1], at[1:])]


def test_toxicity_on_held_out_rows():
    """Recall and false alarms on the labelled rows of sf0.1 that the fit never sees."""
    import duckdb
    import pyarrow as pa
    import pytest
    from pathlib import Path

    if not Path("/root/testdata/sf0.1").exists():
        pytest.skip("no driver tables here")
    rows = duckdb.sql("SELECT d.doc_id, d.text, l.toxic FROM '/root/testdata/sf0.1/documents.parquet' d JOIN '/root/testdata/sf0.1/labels.parquet' l USING (doc_id) WHERE d.text IS NOT NULL ORDER BY 1").fetchall()
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    pair = toxicity.fit([(t, y, zlib.crc32(b"share%d" % i) % 10) for i, t, y in rows if fold(i) and len(t.encode()) <= toxicity.MOST_BYTES])
    held = [(t, y) for i, t, y in rows if not fold(i)]
    score = np.concatenate([pair.score(pa.array([t for t, _ in held[i : i + 200]])) for i in range(0, len(held), 200)])
    label = np.array([y for _, y in held])
    assert (score >= 0.5)[label == 1].mean() >= 0.65 and (score >= 0.5)[label == 0].mean() <= 0.04


def test_language_order_is_fixed_and_bytes_are_kept_apart():
    """With twelve languages, some beyond Latin, code lengths are still of order 3 over all 256 bytes."""
    import pyarrow as pa

    from lectern.llm.features import fold_words

    lines = "the cat sat|le chat est|der hund und|el gato come|o gato come|il gatto siede|кот сидит тут|кіт сидить тут|η γάτα εδώ|猫在这里坐|חתול יושב כאן|القط يجلس هنا"
    sample = [(t, f"l{i:02d}") for i, t in enumerate(lines.split("|"))]
    model = language_id.train(sample)
    probe = pa.array(["кот и кіт", "猫 cat", "γάτα", None, ""])
    bits, _, _ = model.lengths(probe)
    data, at = fold_words(probe)
    for j, (t, _) in enumerate(sample):
        stream = fold_words(pa.array([t]))[0]
        for i in range(len(probe)):
            assert abs(bits[i, j] - ppm_bits([stream], data[at[i] : at[i + 1]], 256, 3)) < 1e-3
    assert model.predict(pa.array([t for t, _ in sample]))[0] == [lang for _, lang in sample]


def test_bpe_takes_linear_time():
    """Four times the letters of one word take less than six times as long, and long words are exact."""
    import time

    bpe = load(public_tokenizers.path("byte_bpe_50k.json"))
    random = np.random.default_rng(6)
    word = "".join(random.choice(list("abcdefghijklmnopqrstuvwxyz"), 400_000))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert bpe.encode(word[:20_000]).tolist() == library.encode(word[:20_000], add_special_tokens=False).ids
    took = []
    for n in (100_000, 400_000):
        began = time.process_time()
        bpe.encode(word[:n])
        took.append(time.process_time() - began)
    assert took[1] < 6 * took[0] + 0.2


def test_word_tokens_are_the_library_s():
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    bpe = load(public_tokenizers.path("word_bpe_49k.json"))
    random = np.random.default_rng(9)
    letters = list("abc thE's\n\t 1234'll!!éÀ中🙂ßİΣ́\x1c\x85\u00a0 ") + ["<|endoftext|>", "<|ENDOFTEXT|>", "  ", "aaaa", "Word, "]
    for _ in range(800):
        text = "".join(random.choice(letters, random.integers(0, 25)))
        assert bpe.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_texts_larger_than_a_chunk(spark):
    """One text of over two megabytes among short ones, through the encoders and counts."""
    from lectern.llm.arrow import CHUNK_BYTES
    from tests.llm.conftest import prose

    long = " ".join(prose(i, 4000) for i in range(90))
    assert len(long) > 2 * CHUNK_BYTES
    frame = spark.createDataFrame([(1, long), (2, "short"), (3, None), (4, long)], "doc_id long, text string")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = len(library.encode(long, add_special_tokens=False).ids)
    assert {r.doc_id: r.n_tokens for r in bpe_codec.round_trip(frame).collect()} == {1: n, 2: 1, 3: 0, 4: n}
    packed = packing.pack(frame).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert len(packed) == 4 and all(r.n == r.m for r in packed)
    got = {r.doc_id: r for r in jaccard_join.jaccard_components(frame).collect()}
    assert got[4].component_id == 1 and got[1].n_shingles == len(grams(long)) and got[3].component_id == 3


def test_jaccard_links_through_rows_without_an_id(spark):
    """Two documents that only a row without an id connects are one component; such rows alone have none."""
    from tests.llm.conftest import prose

    words = prose(4242, 100).split()
    changed = lambda *at: " ".join("x%d" % i if i in at else w for i, w in enumerate(words))
    rows = [(1, changed(10)), (2, changed(90)), (None, changed()), (3, prose(1, 60)), (None, prose(2, 60)), (None, prose(2, 60))]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), percent=92).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (None, 1), (3, 3), (None, None)}


def test_jaccard_hot_buckets(spark):
    """Documents around one passage change to short postings at once, and lose no link."""
    from tests.llm.conftest import prose

    passage = prose(77, 60)
    rows = [(i, passage + " " + prose(300 + i // 2, 40) + (" end" if i % 2 else "")) for i in range(40)]
    parent = {i: i for i, _ in rows}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, x in rows:
        for b, y in rows:
            if 100 * len(grams(x) & grams(y)) >= 80 * len(grams(x) | grams(y)):
                p, q = sorted((top(a), top(b)))
                parent[q] = p
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (1, 32):
        got = jaccard_join.jaccard_components(frame, percent=80, hot=hot).collect()
        assert {(r.doc_id, r.component_id) for r in got} == {(i, top(i)) for i, _ in rows}


def test_short_signatures_are_complete():
    random = np.random.default_rng(13)
    for percent in (80, 90):
        for short in (False, True):
            for n in (5, 9, 14, 20, 40, 150, 500):
                for _ in range(25):
                    most = max(2, n * (100 - percent) // 100 + 2)
                    first = np.unique(random.integers(1, 1 << 62, n).astype(np.uint64))
                    keep = first[random.permutation(len(first))[: len(first) - random.integers(0, most)]]
                    second = np.unique(np.concatenate([keep, random.integers(1, 1 << 62, random.integers(0, most)).astype(np.uint64)]))
                    a, b = set(first.tolist()), set(second.tolist())
                    if a != b and b and 100 * len(a & b) >= percent * len(a | b):
                        sigs, at = jaccard_join.signatures(np.concatenate([first, second]), np.array([0, len(first), len(first) + len(second)]), percent, short)
                        assert set(sigs[: at[1]].tolist()) & set(sigs[at[1] :].tolist())


def test_maxscore_by_brute_force():
    """Sparse, tied, very large and repeated vectors; doubles, 64-bit integers and beyond."""
    random = np.random.default_rng(21)
    cases = [random.normal(0, 1000, (300, 16)).astype(np.int64), np.abs(random.normal(0, 1000, (5000, 12)).astype(np.int64)) * (random.random((5000, 12)) < 0.2), random.integers(-(10**6), 10**6, (200, 8)), random.integers(-(5 * 10**8), 5 * 10**8, (200, 64)), random.integers(-(10**12), 10**12, (60, 4))]
    for vectors in cases:
        ids = random.integers(0, len(vectors), len(vectors))
        own = np.array([*random.integers(0, len(vectors), 4), -1])
        queries = vectors[own]
        q, r, score = topk_search.maxscore(queries, own, vectors, ids, 10)
        cut = lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1)
        for k in range(len(queries)):
            every = sorted((-sum(int(a) * int(b) for a, b in zip(queries[k], vectors[i])), int(ids[i])) for i in range(len(vectors)) if i != own[k])[:10]
            assert sorted((-int(s), int(ids[i])) for s, i in zip(score[q == k], r[q == k])) == sorted((-cut(-s), i) for s, i in every)


def test_topk_of_repeated_ids(spark):
    """A query's own row is no candidate, another row with its id is."""
    rows = [(100, [1.0, 0.0]), (100, [2.0, 0.0]), (7, [0.5, 0.0])]
    got = sorted(tuple(r) for r in topk_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    two, half = 1024 * 2048, 512
    assert got == sorted([(100, 1, 100, two), (100, 2, 7, 1024 * half), (100, 1, 100, two), (100, 2, 7, 2048 * half)])
    big = [(100, [1e6, 3.0]), (1, [1e6, 1.0]), (2, [1e6 + 1, 1.0])]
    got = [tuple(r) for r in topk_search.search(spark.createDataFrame(big, "vec_id long, embedding array<double>")).collect()]
    q = [1024 * 10**6, 3072]
    assert sorted(got) == [(100, 1, 2, q[0] * 1024 * (10**6 + 1) + q[1] * 1024), (100, 2, 1, q[0] * q[0] + q[1] * 1024)]


def test_character_ngrams():
    """Character n-grams are those of the text's letters, not of its bytes."""
    import pyarrow as pa
    from lectern.llm.features import characters, Chunk

    strings = ["aé中🙂b", "", "ßz", "plain"]
    chunk = Chunk(pa.array(strings))
    codes, at = characters(chunk.data, chunk.offsets)
    assert [[chr(c) for c in codes[a:b]] for a, b in zip(at[:-1], at[1:])] == [list(t) for t in strings]
    kinds = list(quality_rules.ngrams(chunk, chunk.word_hashes()))
    assert np.diff(kinds[2][1]).tolist() == [3, 0, 0, 3] and np.diff(kinds[3][1]).tolist() == [1, 0, 0, 1]
