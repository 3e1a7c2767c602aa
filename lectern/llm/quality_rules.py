"""Quality rules: base counts and a hashed n-gram logistic regression.

Features are word unigrams and bigrams and character n-grams of 3 and 5, hashed
into 2 ** 16 buckets; a text's value in a bucket is its share of the text's
n-grams of that kind. The regression is fitted by one task on at most
SAMPLE labelled texts of at most MOST_BYTES bytes each, then calibrated on the
tenths 0 to 2 of that sample, which the fit never saw. Every text is scored
whole, in Arrow batches, and kept if its probability of label 1 reaches KEEP.

Defined results: a null text and one without words have zero counts, fail the
base rules and get the model's value for no n-grams; repeated rows and rows
without an id each get a row; labels other than 0 and 1 are ignored; without labels of both kinds the
model says 1 for all; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.arrow import chunks, documents, filtered, over_arrow
from lectern.llm.features import Chunk, characters, fitted_by_a_task, give_back, labelled_sample, mix, platt, sigmoid, spans_sum

SAMPLE, MOST_BYTES = 3_000, 20_000
BUCKETS = 1 << 16
KINDS = 4
#: Texts of a block of the fit.
BLOCK = 100
KEEP = 0.3
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
FOLD = (4, 2)
U = np.uint64


def ngrams(chunk: Chunk, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram its buckets in order of text, and n + 1 offsets."""
    yield ((hashes >> U(48)).astype(np.int64)), chunk.first
    at, pairs = chunk.windows(hashes, 2)
    yield ((mix(pairs + U(2)) >> U(48)).astype(np.int64)), np.searchsorted(chunk.word_doc[at], np.arange(chunk.n + 1))
    wide, at = characters(chunk.data, chunk.offsets)
    for width, factor in ((3, 0x9E3779B1), (5, 0x85EBCA6B)):
        m = max(len(wide) - width + 1, 0)
        value = np.zeros(m, np.uint32)
        for k in range(width):
            value *= np.uint32(257 if width == 3 else 0x01000193)
            value += wide[k : k + m]
        value = (value * np.uint32(factor)) >> np.uint32(16)
        # n-grams that reach into the next text don't count.
        starts = np.minimum(at, m)
        ends = np.maximum(np.minimum(at[1:] - width + 1, m), starts[:-1])
        inside = np.ones(m, bool)
        for a, b in zip(ends, starts[1:], strict=True):
            inside[a:b] = False
        yield value[inside].astype(np.int64), np.concatenate([[0], np.cumsum(ends - starts[:-1])])


class Model:
    """Weights by kind of n-gram and bucket, and a calibration."""

    def __init__(self, weights: np.ndarray, calibration: tuple[float, float]) -> None:
        self.weights, self.calibration = weights.astype(np.float32), calibration

    def raw(self, chunk: Chunk, hashes: np.ndarray) -> np.ndarray:
        total = np.zeros(chunk.n)
        for kind, (buckets, offsets) in enumerate(ngrams(chunk, hashes)):
            total += spans_sum(self.weights[kind][buckets], offsets) / np.maximum(np.diff(offsets), 1)
        return total

    def score(self, chunk: Chunk, hashes: np.ndarray) -> np.ndarray:
        a, b = self.calibration
        return sigmoid(a * self.raw(chunk, hashes) + b)


def fit(sample: list[tuple[str, int, int]], rounds: int = 60) -> Model:
    """Full-batch Adam on class-balanced logistic loss."""
    label = np.array([s[1] for s in sample], dtype=float)
    if len(set(label)) < 2:
        return Model(np.zeros((KINDS, BUCKETS)), (1.0, 10.0))
    # Sparse matrices of BLOCK rows for each kind of n-gram. They stay blocks, so that what a step needs beside them
    # is of a block's size: the task holds six bytes for each distinct n-gram of a text.
    blocks: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []
    for at in range(0, len(sample), BLOCK):
        chunk, kinds = Chunk(pa.array([s[0] for s in sample[at : at + BLOCK]])), []
        for buckets, offsets in ngrams(chunk, chunk.word_hashes()):
            lengths = np.diff(offsets)
            key, count = np.unique(np.repeat(np.arange(chunk.n), lengths) * BUCKETS + buckets, return_counts=True)
            row = key // BUCKETS
            kinds.append(((key % BUCKETS).astype(np.uint16), (count / lengths[row]).astype(np.float32), np.bincount(row, minlength=chunk.n)))
        blocks.append(kinds)
    train = np.array([s[2] > 2 for s in sample])
    balance = np.where(label == 1, 0.5 / max((label[train] == 1).sum(), 1), 0.5 / max((label[train] == 0).sum(), 1)) * train
    w, bias = np.zeros((KINDS, BUCKETS), np.float32), 0.0
    m, v = np.zeros_like(w), np.zeros_like(w)

    def raw() -> np.ndarray:
        return np.concatenate([sum(spans_sum(vals * w[kind][cols], np.concatenate([[0], np.cumsum(sizes)])) for kind, (cols, vals, sizes) in enumerate(kinds)) for kinds in blocks])

    for step in range(1, rounds + 1):
        grad = (balance * (sigmoid(raw() + bias) - label)).astype(np.float32)
        g = np.zeros((KINDS, BUCKETS))
        for at, kinds in enumerate(blocks):
            for kind, (cols, vals, sizes) in enumerate(kinds):
                g[kind] += np.bincount(cols, weights=vals * np.repeat(grad[at * BLOCK : (at + 1) * BLOCK], sizes), minlength=BUCKETS)
        for kind in range(KINDS):
            one = g[kind].astype(np.float32)
            m[kind], v[kind] = 0.9 * m[kind] + 0.1 * one, 0.99 * v[kind] + 0.01 * one * one
        w -= 0.5 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        bias -= float(grad.sum())
    score = raw() + bias
    held = ~train if len(set(label[~train])) == 2 else train
    a, b = platt(score[held], label[held])
    return Model(w, (a, b + a * bias))


def fitted(docs: DataFrame, labels: DataFrame, sample: int) -> Model:
    model = fitted_by_a_task(docs.sparkSession, fit, labelled_sample(docs, labels, "quality", *FOLD, sample, MOST_BYTES))
    give_back()
    return model


def base_counts(chunk: Chunk, hashes: np.ndarray, texts: list[bytes]) -> dict[str, np.ndarray]:
    """The counts of the base rules for each text."""
    n_words = np.diff(chunk.first)
    inside = (~chunk.space & ((chunk.data & 0xC0) != 0x80)).astype(np.int64)
    at, triples = chunk.windows(hashes, 3)
    docs = chunk.word_doc[at]
    key = triples ^ mix(docs.astype(U) + U(1))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    words = np.zeros(len(hashes), np.int64)
    for k in range(3):
        words[at[twice] + k] = 1
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    return {
        "n_words": n_words,
        "word_chars": spans_sum(inside, chunk.offsets).astype(np.int64),
        "n_symbols": spans_sum(SYMBOLS[chunk.data].astype(np.int64), chunk.offsets).astype(np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], dtype=np.int64),
        "n_repeat_words": chunk.per_text(words, chunk.word_doc).astype(np.int64),
    }


def verdicts(model: Model, texts: pa.Array, keep: float) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Counts, base failures, verdicts and scores of some texts."""
    chunk = Chunk(texts)
    hashes = chunk.word_hashes()
    joined = chunk.data.tobytes()
    counts = base_counts(chunk, hashes, [joined[a:b] for a, b in zip(chunk.offsets[:-1], chunk.offsets[1:], strict=True)])
    failed = (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
    score = model.score(chunk, hashes)
    return counts, failed, ~failed & (score >= keep), score


def assess(docs: DataFrame, labels: DataFrame, keep: float = KEEP, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the calibrated score of every row."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, sample))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                counts, failed, kept, score = verdicts(model.value, part.column(1), keep)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c.astype(np.int64)) for c in counts.values()), pa.array(failed), pa.array(kept), pa.array(score)], ["doc_id", *counts, "base_failed", "kept", "score"])

    return over_arrow(documents(docs), kernel, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double")


def kept_documents(docs: DataFrame, labels: DataFrame, keep: float = KEEP, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, with all their columns, that assess() keeps."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, sample))
    return filtered(docs, lambda: lambda texts: verdicts(model.value, texts, keep)[2])
