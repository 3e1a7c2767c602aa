"""Language identification by prediction by partial matching over bytes.

For each language the bytes of its training texts fill a context tree of
depth ORDER. A byte's code length is that of the longest context that knows
it, after the escapes of the longer ones (escape method C, no exclusions),
with a uniform code over all 256 bytes below. The statistics are frozen after
training. A language's tree keeps only the contexts that occur, as sorted keys
with their code lengths, so its order is the same however many languages there
are. A chunk's distinct (context, byte) keys are looked up once; a text's code
length is a sum over all its bytes, and the language with the shortest code wins.

Trained on at most SAMPLE distinct texts of each language outside the held-out
fold, those with the smallest hashes among the texts of at most MOST_BYTES bytes.

Defined results: a text without a letter, an empty and a null one are `und`
with score 0; ties go to the language first in order of names; without any
training text every text is `und`; repeated rows each get a row; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from lectern.llm.arrow import chunks, filtered, over_arrow
from lectern.llm.features import fold_number, fold_words, spans_sum

SAMPLE, MOST_BYTES = 300, 30_000
#: Bytes of context; with the byte itself a key has 32 bits.
ORDER, SYMBOLS = 3, 256
FOLD = (3, 1)
UNKNOWN = "und"
#: A score weighs the evidence of at most so many bytes.
EVIDENCE = 40


class Tree:
    """One language's contexts of each length: sorted keys and code lengths in bits."""

    def __init__(self, place: np.ndarray) -> None:
        self.levels = []
        for k in range(ORDER + 1):
            gram, times = np.unique(tail(place, k), return_counts=True)
            context, start, owner = np.unique(gram >> np.uint32(8), return_index=True, return_inverse=True)
            total, kinds = np.add.reduceat(times, start), np.diff(np.append(start, len(gram)))
            own = -np.log2(times / (total + kinds)[owner])
            self.levels.append((gram, own, context, -np.log2(kinds / (total + kinds))))

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Code lengths of keys of ORDER bytes of context and one byte."""
        bits = np.full(len(keys), np.log2(SYMBOLS))
        for k, (gram, own, context, escape) in enumerate(self.levels):
            key = tail(keys, k)
            at = np.minimum(np.searchsorted(gram, key), len(gram) - 1)
            over = key >> np.uint32(8)
            above = np.minimum(np.searchsorted(context, over), len(context) - 1)
            bits = np.where(gram[at] == key, own[at], bits + np.where(context[above] == over, escape[above], 0.0))
        return bits


def tail(keys: np.ndarray, k: int) -> np.ndarray:
    """The last k bytes of context and the byte itself."""
    return keys & np.uint32(256 ** (k + 1) - 1)


def places(data: bytes, offsets: np.ndarray) -> np.ndarray:
    """Keys of every byte; contexts begin anew, as if behind spaces, with each text."""
    codes = np.frombuffer(data, np.uint8).astype(np.uint32)
    key = codes.copy()
    position = np.arange(len(codes)) - np.repeat(offsets[:-1], np.diff(offsets))
    for back in range(1, ORDER + 1):
        earlier = np.full(len(codes), 32, np.uint32)
        earlier[back:] = np.where(position[back:] >= back, codes[:-back], 32)
        key |= earlier << np.uint32(8 * back)
    return key


class Contexts:
    """The languages' trees."""

    count, order = SYMBOLS, ORDER

    def __init__(self, names: list[str], trees: list[Tree]) -> None:
        self.names, self.trees = names, trees

    def lengths(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code lengths of each text by language, bytes, and whether it has a letter."""
        data, offsets = fold_words(texts)
        bits = np.zeros((len(texts), len(self.names)))
        keys, which = np.unique(places(data, offsets), return_inverse=True)
        for at, tree in enumerate(self.trees):
            bits[:, at] = spans_sum(tree.bits(keys)[which], offsets)
        view = np.frombuffer(data, np.uint8)
        letters = spans_sum(((view >= 97) & (view <= 122)).astype(np.int64), offsets) > 0
        for i in np.flatnonzero(~letters):
            letters[i] = any(map(str.isalpha, texts[int(i)].as_py() or ""))
        return bits, np.diff(offsets), letters

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        bits, size, letters = self.lengths(texts)
        best = np.argmin(bits, 1)
        weight = np.log(2) * np.minimum(1, EVIDENCE / np.maximum(size, 1))
        likely = np.exp((bits.min(1, keepdims=True) - bits) * weight[:, None])
        score = np.where(letters, 1 / likely.sum(1), 0.0)
        return [self.names[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], score


def train(sample: list[tuple[str, str]]) -> Contexts:
    """Context trees from (text, language) rows."""
    names = sorted({lang for _, lang in sample})
    return Contexts(names, [Tree(places(*fold_words(pa.array([t for t, lang in sample if lang == name])))) for name in names])


def training_rows(docs: DataFrame, sample: int = SAMPLE) -> list[tuple[str, str]]:
    """At most `sample` distinct texts of each language outside the held-out fold."""
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (fold_number(F.col("doc_id"), FOLD[0]) != FOLD[1]) & (F.octet_length("text") <= MOST_BYTES))
    hashed = rows.select("lang", F.xxhash64("text").alias("name")).distinct()
    # Copies meet as hashes before the smallest ones of each language are taken; so few are broadcast that texts stay where they are.
    place = F.row_number().over(Window.partitionBy("lang").orderBy("name"))
    smallest = hashed.withColumn("place", place).where(F.col("place") <= sample).select("lang", "name")
    chosen = rows.withColumn("name", F.xxhash64("text")).join(F.broadcast(smallest), ["lang", "name"], "left_semi")
    return sorted((r["text"], r["lang"]) for r in chosen.select("text", "lang").distinct().collect())


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    model = docs.sparkSession.sparkContext.broadcast(train(training_rows(docs, sample)))
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), (fold_number(doc_id, FOLD[0]) == FOLD[1]).alias("held_out"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                names, score = model.value.predict(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return over_arrow(rows, kernel, "doc_id long, held_out boolean, lang_pred string, score double")


def known_documents(docs: DataFrame, least: float, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, with all their columns, whose language is predicted with at least this score."""
    model = docs.sparkSession.sparkContext.broadcast(train(training_rows(docs, sample)))

    def judge():
        def passes(texts: pa.Array) -> np.ndarray:
            names, score = model.value.predict(texts)
            return (score >= least) & np.array([n != UNKNOWN for n in names], dtype=bool)

        return passes

    return filtered(docs, judge)
