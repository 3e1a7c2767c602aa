"""Toxicity by compression distance.

Texts are folded to lower case with every run of white space and ASCII marks
as one space. Two dictionaries are trained by zstandard: one on pieces of
ordinary text, one on short windows of toxic text. Most of a toxic text is
ordinary, so the windows that the second one learns from are themselves chosen
by compression: in FOLDS parts of the toxic texts in turn, those windows that
the other parts' text shortens by LEAST_GAIN bytes more than any of BLOCKS
blocks of ordinary text of that size does. Nothing is chosen by words, labels
of words or frequency; what recurs in those windows zstandard itself finds.

Every window of a text is compressed with the ordinary dictionary and with
that dictionary and the toxic one behind it; how much shorter the second way
is, is the window's distance. A logistic
calibration over a text's distances (the largest ones, and the shares beyond
fixed steps) gives the score. It is fitted on training texts that the
dictionaries never saw. The fit takes at most SAMPLE labelled texts among
those of at most MOST_BYTES bytes.

Defined results: a null or empty text has no window and gets the calibration's
value for distances of 0; repeated rows and rows without an id each get a row;
without labels of both kinds every score is 0; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from lectern.llm.arrow import chunks, over_arrow
from lectern.llm.features import fold_number, fold_words, labelled_sample, sigmoid

SAMPLE, MOST_BYTES = 8_000, 30_000
WINDOW, STRIDE = 48, 36
STRATEGY, MIN_MATCH, SEARCH = zstandard.STRATEGY_BTOPT, 3, 6
#: Gain from which a window's words are compressed alone; measures of a text; bytes of ordinary content behind a word
#: that is compressed alone.
NEAR, MEASURES, TAIL = 2, 17, 24
#: Bytes and stride of the windows that the toxic dictionary may learn from, how they are chosen, and the segment and
#: match lengths of its training: those of words.
SPAN, STEP, LEAST_GAIN, FOLDS, BLOCKS, SEGMENT, MATCH = 20, 4, 3, 4, 4, 12, 8
#: A missed toxic text costs as much as so many false alarms in the calibration.
MISS_COST = 2.0
ORDINARY_BYTES, TOXIC_BYTES = 16_384, 1_024
FOLD = (5, 0)
THRESHOLD = 0.5


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of each window and n + 1 offsets by text."""
    n = np.diff(offsets)
    count = np.maximum(-(-(n - (WINDOW - STRIDE)) // STRIDE), (n > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n)), count)
    start = offsets[doc] + (np.arange(at[-1]) - at[doc]) * STRIDE
    return np.stack([start, np.minimum(start + WINDOW, offsets[doc + 1]) - start], 1), at


def words_in(data: bytes, offsets: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the words that the spans touch, with the spaces around them, and their texts' numbers."""
    if not len(spans):
        return np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    cover = np.zeros(len(data) + 1, np.int64)
    np.add.at(cover, spans[:, 0], 1)
    np.add.at(cover, spans[:, 0] + spans[:, 1], -1)
    cover = np.cumsum(cover)
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    start, end = gaps, np.minimum(np.concatenate([gaps[1:] + 1, [len(data)]]), len(data))
    use = ((cover[start] > 0) | (cover[end - 1] > 0)) & (end - start > 2)
    return np.stack([start[use], end[use] - start[use]], 1), np.searchsorted(offsets, start[use], side="right") - 1


class Pair:
    """The two dictionaries and the calibration."""

    def __init__(self, ordinary: bytes, toxic: bytes, weights: np.ndarray, shift: np.ndarray, scale: np.ndarray) -> None:
        self.ordinary, self.toxic, self.weights, self.shift, self.scale = ordinary, toxic, weights, shift, scale
        self.coders = None

    def __getstate__(self):
        return {**self.__dict__, "coders": None}

    def lengths(self, data: bytes, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Compressed lengths of the windows with either dictionary."""
        if self.coders is None:
            way = zstandard.ZstdCompressionParameters(strategy=STRATEGY, min_match=MIN_MATCH, window_log=17, hash_log=15, chain_log=15, search_log=SEARCH, write_content_size=0, write_checksum=0, write_dict_id=0)
            self.coders = []
            for content in (self.ordinary, self.ordinary + self.toxic + self.ordinary[-16:]):
                own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                own.precompute_compress(compression_params=way)
                self.coders.append(zstandard.ZstdCompressor(dict_data=own, compression_params=way))
        if not len(spans):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        parts = zstandard.BufferWithSegments(data, spans.astype(np.uint64).tobytes())
        return tuple(np.fromiter(map(len, c.multi_compress_to_buffer(parts, threads=1)), np.int64, len(spans)) for c in self.coders)

    def measures(self, texts: pa.Array) -> np.ndarray:
        """A row of distances for each text: three largest, shares and counts beyond steps."""
        data, offsets = fold_words(texts)
        spans, at = windows(offsets)
        plain, toxic = self.lengths(data, spans)
        gain = plain - toxic
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        order = np.lexsort((-gain, doc))
        ranked = np.concatenate([gain[order], [0]])
        out = []
        for k in range(3):
            place = np.where(at[:-1] + k < at[1:], at[:-1] + k, len(gain))
            out.append(ranked[place])
        n = np.maximum(np.diff(at), 1)
        for step in (3, 4, 5):
            beyond = np.bincount(doc, weights=gain >= step, minlength=len(n))
            out += [np.sqrt(beyond / n), np.minimum(beyond, 4)]
        # Windows that the toxic dictionary shortens are looked at again word by word.
        # So is each text's last window, as no match starts in the last 8 bytes of what is compressed.
        final = np.zeros(len(spans), bool)
        final[at[1:][np.diff(at) > 0] - 1] = True
        words, owner = words_in(data, offsets, spans[(gain >= NEAR) | final])
        tail = self.ordinary[-TAIL:]
        ends = np.cumsum(words[:, 1] + TAIL)
        plain, toxic = self.lengths(b"".join([data[a : a + n] + tail for a, n in words.tolist()]), np.stack([ends - words[:, 1] - TAIL, words[:, 1] + TAIL], 1))
        gain = plain - toxic
        best = np.zeros(len(n))
        np.maximum.at(best, owner, gain)
        out.append(best)
        for step in (1, 2, 3):
            beyond = np.bincount(owner, weights=gain >= step, minlength=len(n))
            out += [np.minimum(beyond, 3), np.sqrt(beyond / n)]
        out.append(np.log(n))
        return np.stack(out, 1).astype(float)

    def score(self, texts: pa.Array) -> np.ndarray:
        x = (self.measures(texts) - self.shift) / self.scale
        return sigmoid(x @ self.weights[:-1] + self.weights[-1])


def coder(content: bytes, log: int) -> zstandard.ZstdCompressor:
    """A compressor with a raw dictionary, its tables of 2 ** log entries."""
    way = zstandard.ZstdCompressionParameters(strategy=STRATEGY, min_match=MIN_MATCH, window_log=log + 3, hash_log=log, chain_log=log, search_log=8, write_content_size=0, write_checksum=0, write_dict_id=0)
    own = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    own.precompute_compress(compression_params=way)
    return zstandard.ZstdCompressor(dict_data=own, compression_params=way)


def compressed(by: zstandard.ZstdCompressor, data: bytes, spans: np.ndarray) -> np.ndarray:
    """Compressed lengths of the spans (start, length) of data."""
    if not len(spans):
        return np.zeros(0, np.int64)
    parts = zstandard.BufferWithSegments(data, spans.astype(np.uint64).tobytes())
    return np.fromiter(map(len, by.multi_compress_to_buffer(parts, threads=1)), np.int64, len(spans))


def toxic_windows(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Windows of each part of the toxic texts that the other parts explain better than any block of ordinary text."""
    blocks = [b"".join(ordinary[i::BLOCKS]) for i in range(BLOCKS)]
    chosen: list[bytes] = []
    for fold in range(FOLDS):
        rest = b"".join(t for i, t in enumerate(toxic) if i % FOLDS != fold)
        own = toxic[fold::FOLDS]
        if not own:
            continue
        data = b"".join(own)
        ends = np.cumsum([0, *map(len, own)])
        starts = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b - SPAN + 1, STEP) for a, b in zip(ends[:-1], ends[1:], strict=True))])
        spans = np.stack([starts, np.full(len(starts), SPAN)], 1)
        least = np.min([compressed(coder(b[: 3 * len(rest) // 2], 20), data, spans) for b in blocks], axis=0)
        gain = least - compressed(coder(rest, 20), data, spans)
        chosen += [data[a : a + SPAN] for a in starts[gain >= LEAST_GAIN].tolist()]
    return chosen


def trained(samples: list[bytes], size: int, **way: int) -> bytes:
    """The content of a dictionary that zstandard trains; the samples themselves where they are too few for it."""
    for asked in (2 * size, size):
        try:
            found = zstandard.train_dictionary(asked, samples, **way).as_bytes()
        except zstandard.ZstdError:
            continue
        if len(found) >= size:
            # The most telling content stands at the end, nearest to what is compressed.
            return found[-size:]
    return b"".join(dict.fromkeys(samples))[-size:]


def train_dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary's content."""
    pieces = [t[i : i + 256] for t in ordinary for i in range(0, len(t), 256)]
    plain = trained(pieces, ORDINARY_BYTES, level=3)
    return plain.rjust(2 * TAIL), trained(toxic_windows(toxic, ordinary), TOXIC_BYTES, k=SEGMENT, d=MATCH) or b" "


def fit(sample: list[tuple[str, int, int]]) -> Pair:
    chosen: dict[bytes, tuple[int, int, str]] = {}
    for text, label, share in sample:
        # Copies count once, so that their ordinary words don't look telling.
        chosen.setdefault(fold_words(pa.array([text]))[0], (label, share, text))
    learn = [[d for d, (label, share, _) in chosen.items() if label == kind and share > 3] for kind in (1, 0)]
    pair = Pair(*train_dictionaries(*learn), np.zeros(1), np.zeros(1), np.ones(1))
    rest = [(text, label) for label, share, text in chosen.values() if share <= 3]
    label = np.array([x[1] for x in rest], dtype=float)
    if len(set(label)) < 2:
        pair.shift, pair.scale = np.zeros(MEASURES), np.ones(MEASURES)
        pair.weights = np.array([0.0] * MEASURES + [-40.0])
        return pair
    x = np.concatenate([pair.measures(pa.array([t for t, _ in rest[i : i + 200]])) for i in range(0, len(rest), 200)])
    pair.shift, pair.scale = x.mean(0), x.std(0) + 1e-6
    z = np.concatenate([(x - pair.shift) / pair.scale, np.ones((len(x), 1))], 1)
    weight = np.zeros(z.shape[1])
    ridge = np.diag([*[1e-2] * (z.shape[1] - 1), 1e-6]) * len(z) / 100
    cost = np.where(label == 1, MISS_COST, 1.0)
    for _ in range(50):
        p = sigmoid(z @ weight)
        step = np.linalg.solve(z.T @ (z * (cost * p * (1 - p) + 1e-9)[:, None]) + ridge, z.T @ (cost * (p - label)) + ridge @ weight)
        weight = weight - np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-5:
            break
    pair.weights = weight
    return pair


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    pair = docs.sparkSession.sparkContext.broadcast(fit(labelled_sample(docs, labels, "toxic", *FOLD, sample, MOST_BYTES)))
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), (fold_number(doc_id, FOLD[0]) == FOLD[1]).alias("held_out"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                score = pair.value.score(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return over_arrow(rows, kernel, "doc_id long, held_out boolean, score double, predicted int")
