"""Vectorised views of a chunk of texts: words, their hashes, n-grams, folds.

Everything works on the concatenated UTF-8 bytes of a chunk, so the cost is a
few array passes a byte whatever the texts' lengths.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lectern.llm.arrow import over_arrow, raw_bytes

#: White space: the six bytes that part words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and INVERSE ** i for i < n, modulo 2 ** 64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, factor in enumerate((BASE, INVERSE)):
            line = np.full(size, factor, np.uint64)
            line[0] = 1
            _powers[k] = np.cumprod(line, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of uint64 values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words_between(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each byte is white space, and the starts and ends of the words."""
    space = SPACE[data]
    if not len(data):
        return space, np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[0], before[1:] = True, space[:-1]
    before |= edge[:-1]
    after[-1], after[:-1] = True, space[1:]
    after |= edge[1:]
    return space, np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


class Chunk:
    """Words of the texts in a chunk: starts, ends and texts of the words as arrays."""

    def __init__(self, texts: pa.Array, lower: bool = False) -> None:
        self.data, self.offsets = raw_bytes(texts)
        if lower:
            self.data = LOWER[self.data]
        self.n = len(texts)
        self.space, self.starts, self.ends = words_between(self.data, self.offsets)
        self.word_doc = np.searchsorted(self.offsets, self.starts, side="right") - 1
        # Words of text i are first[i] to first[i + 1].
        self.first = np.searchsorted(self.starts, self.offsets)

    def word_hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return span_hashes(self.data, self.starts, self.ends)

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts (word numbers) and hashes of each run of `width` words in one text."""
        m = len(hashes) - width + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        joined = np.zeros(m, np.uint64)
        for k in range(width):
            joined = mix(joined * np.uint64(31) + hashes[k : k + m] + np.uint64(k + 1))
        at = np.flatnonzero(self.word_doc[:m] == self.word_doc[width - 1 :])
        return at, joined[at]

    def per_text(self, values: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Sums of values by text."""
        return np.bincount(docs, weights=values, minlength=self.n)


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and n + 1 offsets in them."""
    inner = (data & 0xC0) == 0x80
    starts = np.flatnonzero(~inner)
    code = data[starts].astype(np.uint32)
    size = np.ones(len(starts), np.uint8)
    for lead, bits in ((0xC0, 0x1F), (0xE0, 0x0F), (0xF0, 0x07)):
        more = np.flatnonzero(code >= lead) if lead == 0xC0 else np.flatnonzero(data[starts] >= lead)
        size[more] += 1
        code[more] = data[starts[more]] & bits
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        code[more] = (code[more] << np.uint32(6)) | (data[starts[more] + k] & 0x3F)
    return code, np.searchsorted(starts, offsets)


def spans_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i + 1]] (0 where empty)."""
    if not len(values):
        return np.zeros((len(offsets) - 1, *values.shape[1:]))
    out = np.add.reduceat(np.concatenate([values, np.zeros((1, *values.shape[1:]), values.dtype)]), offsets[:-1], axis=0, dtype=np.float64)
    out[offsets[:-1] == offsets[1:]] = 0
    return out


def fold_latin(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin-1 letters in UTF-8 bytes."""
    data = LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1
    upper = lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E) & (data[lead] != 0x97)]
    data[upper] += 0x20
    return data


#: White space and ASCII marks are spaces.
MARK = np.arange(256, dtype=np.uint8)
MARK[[*range(33), *range(33, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = 32


def fold_words(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """Folded bytes of all texts, each with a space before and after, and n + 1 offsets."""
    data, offsets = raw_bytes(texts)
    if len(data):
        data = MARK[fold_latin(data)]
    data = np.insert(data, offsets[:-1], 32)
    starts = offsets[:-1] + np.arange(len(offsets) - 1)
    first = np.zeros(len(data), bool)
    first[starts] = True
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    keep |= first
    total = np.concatenate([[0], np.cumsum(keep)])
    ends = np.concatenate([starts, [len(data)]])
    return data[keep].tobytes(), total[ends]


def fold_number(doc_id: Column, parts: int) -> Column:
    """crc32(doc_id as text) mod parts; of a null id, that of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, most: int, most_bytes: int) -> list[tuple[str, int, int]]:
    """(text, label, share) of at most `most` labelled rows outside the held-out fold, chosen by a hash of
    the id, so that the choice doesn't depend on partitioning, among those whose text has at most `most_bytes`
    bytes. share, 0 to 9, is for splitting off rows to calibrate on. The bounds keep the join's build side and
    what is sent to the driver small at any input size. A doc_id that is labelled more than once counts with its
    largest label.
    """
    doc_id = F.col("doc_id").cast("long")
    chosen = (
        labels.select(doc_id.alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
        .where(fold_number(F.col("doc_id"), parts) != held_out)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .withColumn("rank", F.xxhash64("doc_id"))
        .orderBy("rank", "doc_id")
        .limit(most)
    )
    rows = (
        docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"))
        .where(F.octet_length("text") <= most_bytes)
        .join(F.broadcast(chosen), "doc_id")
        .orderBy("rank", "doc_id", "text")
        .limit(most)
        .select("doc_id", "text", "label")
        .collect()
    )
    return [(r["text"], r["label"], zlib.crc32(b"share%d" % r["doc_id"]) % 10) for r in rows]


def fitted_by_a_task(spark: SparkSession, fit: Callable, sample: list):
    """fit(sample), computed by one task, so that its memory isn't the driver's."""
    held = spark.sparkContext.broadcast(sample)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            model = pickle.dumps(fit(held.value))
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    try:
        return pickle.loads(over_arrow(spark.range(0, 1, 1, 1), kernel, "model binary").first()["model"])
    finally:
        held.destroy()


def give_back() -> None:
    """Return the memory that a fit has freed to the system, where the C library can."""
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def platt(raw: np.ndarray, label: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """a, b so that sigmoid(a * raw + b) is calibrated, by Newton steps with smoothed targets."""
    pos, neg = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = raw.std() or 1.0
    x, theta = np.stack([raw / scale, np.ones_like(raw)], 1), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = sigmoid(x @ theta)
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * (theta - [1.0, 0.0]))
        theta -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return float(theta[0] / scale), float(theta[1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
