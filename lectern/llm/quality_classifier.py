"""Quality classifier: random-indexing word vectors and a two-layer network.

Every token (a run of letters, or a run of other marks, with its case) has a
sparse random index vector derived from its hash. A token's word vector is its
own index vector plus the scaled sum of those of its neighbours in all
documents, which needs no label: each task sums its own documents' contexts,
and Spark adds up the VOCABULARY rows of DIM numbers. A text is pooled to the mean and the spread of its tokens'
vectors, and a network of one hidden layer, trained in numpy, scores the pool;
a temperature (and a bias, since the training balances the labels) calibrates it
on texts that the training never saw. Only
the network is fitted on at most SAMPLE labelled texts of at most MOST_BYTES bytes.

Defined results: a null or empty text pools to zeros and gets the network's
value for that; repeated rows each get a row; without labels of both kinds
every score is 0.5; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm.arrow import chunks, documents, over_arrow, raw_bytes
from lectern.llm.features import BASE, fold_number, labelled_sample, mix, platt, powers, sigmoid, spans_sum

SAMPLE, MOST_BYTES = 3_000, 20_000
DIM, VOCABULARY, HIDDEN, NONZERO, REACH = 48, 1 << 15, 32, 4, 2
#: Tokens that the training texts' average counts for in a pool.
PRIOR = 20
FOLD = (4, 2)
THRESHOLD = 0.7
U = np.uint64
#: Classes of bytes: 0 space, 1 letters (and all of UTF-8 beyond ASCII), 2 digits, 3 marks.
CLASS = np.full(256, 3, np.uint8)
CLASS[:33] = 0
CLASS[48:58] = 2
CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary buckets of each text's tokens in order, and n + 1 offsets."""
    data, offsets = raw_bytes(texts)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = CLASS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[1:-1] |= kind[1:] != kind[:-1]
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    full = kind[starts] != 0
    starts, ends = starts[full], ends[full]
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[:-1], out=sums[1:])
    bucket = (mix((sums[ends] - sums[starts]) * down[starts]) >> U(49)).astype(np.int64)
    return bucket, np.searchsorted(starts, offsets)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each bucket NONZERO places and signs."""
    seed = mix(np.arange(VOCABULARY * NONZERO, dtype=U) + BASE)
    return (seed % U(DIM)).astype(np.int64).reshape(-1, NONZERO), np.where(seed >> U(63), 1.0, -1.0).reshape(-1, NONZERO)


def add_contexts(context: np.ndarray, bucket: np.ndarray, offsets: np.ndarray) -> None:
    """Add the neighbours' index vectors of every token to its bucket's row."""
    place, sign = index_vectors()
    flat = context.reshape(-1)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for shift in range(1, REACH + 1):
        same = doc[shift:] == doc[:-shift]
        for word, near in ((bucket[shift:][same], bucket[:-shift][same]), (bucket[:-shift][same], bucket[shift:][same])):
            # Each pair of neighbours once, with its count.
            pair, times = np.unique(word * VOCABULARY + near, return_counts=True)
            word, near = pair // VOCABULARY, pair % VOCABULARY
            for k in range(NONZERO):
                np.add.at(flat, word * DIM + place[near, k], sign[near, k].astype(np.int64) * times)


def corpus_contexts(docs: DataFrame) -> np.ndarray:
    """Summed context rows of all documents, by bucket."""
    names = [f"c{k}" for k in range(DIM)]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = np.zeros((VOCABULARY, DIM), np.int64)
        for batch in batches:
            for part in chunks(batch):
                add_contexts(context, *tokens(part.column(1)))
        seen = np.flatnonzero(context.any(1))
        for i in range(0, len(seen), 4096):
            rows = seen[i : i + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(rows), *(pa.array(c) for c in context[rows].T.copy())], ["bucket", *names])

    sums = over_arrow(documents(docs), kernel, ", ".join(f"{c} long" for c in ("bucket", *names)))
    found = sums.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
    context = np.zeros((VOCABULARY, DIM))
    context[found.column("bucket").to_numpy()] = np.stack([found.column(c).to_numpy() for c in names], 1)
    return context


def word_vectors(context: np.ndarray) -> np.ndarray:
    """Own index vectors plus half of the normalised sum of the neighbours'."""
    place, sign = index_vectors()
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    own = np.zeros((VOCABULARY, DIM))
    for k in range(NONZERO):
        np.add.at(own, (np.arange(VOCABULARY), place[:, k]), sign[:, k] / np.sqrt(NONZERO))
    return (own + 0.5 * context / np.maximum(norm, 1e-9)).astype(np.float32)


def pool(vectors: np.ndarray, bucket: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean and spread of each text's word vectors."""
    n = np.maximum(np.diff(offsets), 1)[:, None]
    out = []
    rows = vectors[bucket]
    mean = spans_sum(rows, offsets) / n
    square = spans_sum(np.square(rows), offsets) / n
    out = [mean, np.sqrt(np.maximum(square - mean**2, 0)), np.log1p(n) / 10]
    return np.concatenate(out, axis=1)


def standardise(pooled: np.ndarray, shift: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standard units, drawn towards the average where a text has few tokens to tell."""
    n = np.expm1(10 * pooled[:, -1:])
    return np.clip((pooled - shift) / scale, -8, 8) * (n / (n + PRIOR))


class Network:
    def __init__(self, vectors, shift, scale, w1, b1, w2, b2, calibration) -> None:
        self.vectors, self.shift, self.scale = vectors, shift, scale
        self.w1, self.b1, self.w2, self.b2, self.calibration = w1, b1, w2, b2, calibration

    def raw(self, pooled: np.ndarray) -> np.ndarray:
        x = standardise(pooled, self.shift, self.scale)
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, texts: pa.Array) -> np.ndarray:
        a, b = self.calibration
        return sigmoid(a * self.raw(pool(self.vectors, *tokens(texts))) + b)


def fit(sample: list[tuple[str, int, int]], contexts: Callable[[], np.ndarray], rounds: int = 300) -> Network:
    label = np.array([s[1] for s in sample], dtype=float)
    width = 2 * DIM + 1
    if len(set(label)) < 2:
        return Network(np.zeros((VOCABULARY, DIM), np.float32), np.zeros(width), np.ones(width), np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, (1.0, 0.0))
    stream = [tokens(pa.array([s[0] for s in sample[i : i + 200]])) for i in range(0, len(sample), 200)]
    vectors = word_vectors(contexts())
    pooled = np.concatenate([pool(vectors, *s) for s in stream])
    train = np.array([s[2] > 2 for s in sample])
    shift, scale = pooled[train].mean(0), pooled[train].std(0) + 1e-3
    x = standardise(pooled, shift, scale)
    balance = (np.where(label == 1, 0.5 / max((label[train] == 1).sum(), 1), 0.5 / max((label[train] == 0).sum(), 1)) * train)
    random = np.random.default_rng(7)
    theta = [random.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN), random.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    moments = [[np.zeros_like(t), np.zeros_like(t)] for t in theta]
    for step in range(1, rounds + 1):
        h = np.tanh(x @ theta[0] + theta[1])
        d = balance * (sigmoid(h @ theta[2] + theta[3]) - label)
        back = d[:, None] * theta[2] * (1 - h * h)
        grads = [x.T @ back + 1e-4 * theta[0], back.sum(0), h.T @ d + 1e-4 * theta[2], np.array([d.sum()])]
        for t, g, mv in zip(theta, grads, moments, strict=True):
            mv[0] = 0.9 * mv[0] + 0.1 * g
            mv[1] = 0.99 * mv[1] + 0.01 * g * g
            t -= 0.02 * (mv[0] / (1 - 0.9**step)) / (np.sqrt(mv[1] / (1 - 0.99**step)) + 1e-8)
    net = Network(vectors, shift, scale, theta[0], theta[1], theta[2], float(theta[3][0]), (1.0, 0.0))
    held = ~train if len(set(label[~train])) == 2 else train
    net.calibration = platt(net.raw(pooled[held]), label[held])
    return net


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    net = docs.sparkSession.sparkContext.broadcast(fit(labelled_sample(docs, labels, "quality", *FOLD, sample, MOST_BYTES), lambda: corpus_contexts(docs)))
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), (fold_number(doc_id, FOLD[0]) == FOLD[1]).alias("held_out"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                score = net.value.score(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return over_arrow(rows, kernel, "doc_id long, held_out boolean, score double, predicted int")
