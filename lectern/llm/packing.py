"""Lexical retrieval packing.

Documents are routed by content before they are packed. A first pass tokenises
them, writes the ids and counts each token's documents over the whole corpus. A
document's heaviest BM25 term by these counts that another document has too is
its route; terms fill shards of about SHARD_TOKENS tokens, and a term with more
is dealt over several shards by its documents' second terms (and a pair with
more, by their ids). So shards depend on the documents alone, not on input
splits, and related documents from anywhere meet in one.

A shard's inverted index has a posting list for each token id, weighed by the
corpus's statistics. The next unused document seeds a window of LENGTH tokens
and its heaviest terms query the index; unused neighbours fill the window in
order of score, whole ones first, and the best one that doesn't fit is cut, its
rest seeding the next window. Where they leave room, the seed asks again with
all its terms for all neighbours. Every window but a task's last is full; that
one is cut into sequences whose lengths are powers of two, which need no padding
either.

A sequence's id holds the number of the task and its place in it, which are the
same when a lost task runs again.

Defined results: a null text is empty and consists of the end token; repeated
rows are each packed; a text longer than a window takes several; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lectern.llm.arrow import chunks, documents, over_arrow
from lectern.llm.bpe import load
from lectern.session import materialise

VOCABULARY = "word_bpe_49k.json"
LENGTH, END = 4096, 2
#: Tokens of a shard; a worker holds about 60 bytes a token of one shard.
SHARD_TOKENS = 1_000_000
#: Terms of a seed that query the index first, and neighbours asked for; where they leave room all terms and all neighbours follow.
QUERY_TERMS, NEIGHBOURS = 12, 48
K1, B = 1.2, 0.75
SEQUENCE_BITS = 36


class Corpus:
    """Documents of each token, number of documents and their mean length, over the whole corpus."""

    def __init__(self, frequency: np.ndarray, n: int, mean: float) -> None:
        self.frequency, self.mean = frequency, mean
        self.idf = np.log1p((n - frequency + 0.5) / (frequency + 0.5))

    def weight(self, term: np.ndarray, times: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.idf[term] * times * (K1 + 1) / (times + K1 * (1 - B + B * length / self.mean))

    def routes(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two heaviest terms of each document that another one has too; the end token where there is none."""
        doc, term, times = terms_of(ids, offsets)
        lengths = np.diff(offsets).astype(np.float64)
        weight = np.where(self.frequency[term] > 1, self.weight(term, times, lengths[doc]), 0.0)
        start = np.searchsorted(doc, np.arange(len(lengths)))
        out = []
        for _ in range(2):
            # Of equally heavy terms the first one, as terms are in order.
            best = np.maximum.reduceat(weight, start)
            place = np.flatnonzero(weight == best[doc])
            place = place[np.searchsorted(doc[place], np.arange(len(lengths)))]
            out.append(np.where(best > 0, term[place], END))
            weight[place] = 0
        return out[0], out[1]


def terms_of(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, times) of the distinct terms, in order."""
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
    key = (doc << 32) | ids
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    times = np.diff(first, append=len(key))
    key = key[first]
    return key >> 32, key & 0xFFFFFFFF, times


class Shards:
    """Shard numbers by route, from the tokens of each term and of the pairs of terms that fill much of a shard."""

    def __init__(self, terms: dict[int, int], pairs: dict[tuple[int, int], int], most: int) -> None:
        self.first: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        shard, held = 0, 0
        for term in sorted(terms):
            if 2 * terms[term] <= most:
                if held >= most:
                    shard, held = shard + 1, 0
                self.first[term] = (shard, 1)
                held += terms[term]
        shard += 1
        for pair in sorted(pairs):
            if 2 * terms[pair[0]] > most and 4 * pairs[pair] > most:
                self.pairs[pair] = (shard, -(-pairs[pair] // most))
                shard += self.pairs[pair][1]
        for term in sorted(terms):
            if 2 * terms[term] > most:
                rest = terms[term] - sum(n for pair, n in pairs.items() if pair[0] == term and pair in self.pairs)
                self.first[term] = (shard, max(1, -(-rest // most)))
                shard += self.first[term][1]

    def of(self, term: int, second: int, name: int | None) -> int:
        if found := self.pairs.get((term, second)):
            return found[0] + zlib.crc32(str(name).encode()) % found[1]
        first, count = self.first[term]
        return first + zlib.crc32(b"%d" % second) % count


class Index:
    """BM25 postings of a shard's documents, by token id; with statistics of the corpus, or else of the shard."""

    def __init__(self, ids: np.ndarray | list[np.ndarray], offsets: np.ndarray | None = None, corpus: Corpus | None = None) -> None:
        if offsets is None:
            ids, offsets = np.concatenate(ids), np.concatenate([[0], np.cumsum(list(map(len, ids)))])
        self.n = len(offsets) - 1
        lengths = np.diff(offsets).astype(np.float64)
        doc, term, times = terms_of(ids, offsets)
        # Terms of document i are those from own[i] to own[i + 1].
        self.own = np.searchsorted(doc, np.arange(self.n + 1))
        frequency = np.bincount(term)
        corpus = corpus or Corpus(frequency, self.n, lengths.mean())
        self.weight = corpus.weight(term, times, lengths[doc]).astype(np.float32)
        self.term = term.astype(np.int32)
        order = np.argsort(self.term, kind="stable")
        self.post_doc, self.post_weight = doc[order].astype(np.int32), self.weight[order]
        self.starts = np.concatenate([[0], np.cumsum(frequency)])

    def neighbours(self, seed: int, used: np.ndarray, further: bool = False) -> np.ndarray:
        """Unused documents that share the seed's heaviest terms, best first, ties in order; further, all that share any."""
        mine = slice(self.own[seed], self.own[seed + 1])
        weight = self.weight[mine]
        top = np.argsort(-weight, kind="stable")[: None if further else QUERY_TERMS]
        score = np.zeros(self.n)
        for t in self.term[mine][top]:
            posts = slice(self.starts[t], self.starts[t + 1])
            score[self.post_doc[posts]] += self.post_weight[posts]
        score[used] = 0
        near = np.flatnonzero(score)
        if len(near) > NEIGHBOURS and not further:
            near = near[np.argpartition(-score[near], NEIGHBOURS)[: NEIGHBOURS + 1]]
        return near[np.lexsort((near, -score[near]))]


def windows(sizes: np.ndarray, index: Index, room: int) -> Iterator[list[tuple[int, int, int]]]:
    """Pieces (document, start, length) of one window after the other; `room` tokens are free in the first."""
    used = np.zeros(len(sizes), bool)
    following, rest, begun = 0, None, []
    while True:
        if rest is None:
            while following < len(sizes) and used[following]:
                following += 1
            if following == len(sizes):
                break
            used[following] = True
            rest = (following, 0)
        seed, start = rest
        rest = None
        take = min(room, int(sizes[seed]) - start)
        begun.append((seed, start, take))
        room -= take
        if start + take < sizes[seed]:
            rest = (seed, start + take)
        elif room:
            for further, whole in ((False, True), (False, False), (True, True), (True, False)):
                if not room:
                    break
                if whole:
                    near = index.neighbours(seed, used, further)
                for n in near:
                    if room and not used[n] and (not whole or sizes[n] <= room):
                        used[n] = True
                        take = min(room, int(sizes[n]))
                        begun.append((int(n), 0, take))
                        room -= take
                        if take < sizes[n]:
                            rest = (int(n), take)
        if not room:
            yield begun
            begun, room = [], LENGTH
    if begun:
        yield begun


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Rows of packed pieces for one task."""

    def __init__(self, task: int, corpus: Corpus) -> None:
        self.task, self.sequence, self.corpus = task, 0, corpus
        self.open: list[tuple] = []
        self.filled = 0

    def add(self, names: list, ids: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        """Rows of the windows that a shard completes; an unfinished one stays open for the next shard."""
        sizes = np.diff(offsets)
        out: list[tuple] = []
        for window in windows(sizes, Index(ids, offsets, self.corpus), LENGTH - self.filled):
            for doc, start, length in window:
                at = offsets[doc] + start
                self.open.append((names[doc], start, length, ids[at : at + length], int(sizes[doc])))
                self.filled += length
            if self.filled == LENGTH:
                out += self.close(self.open)
                self.open, self.filled = [], 0
        # What stays open mustn't hold the shard.
        self.open = [(*x[:3], x[3].copy(), x[4]) for x in self.open]
        return out

    def close(self, pieces: list[tuple]) -> list[tuple]:
        """One sequence's rows."""
        rows, offset = [], 0
        name = self.task << SEQUENCE_BITS | self.sequence
        self.sequence += 1
        for doc, start, length, ids, whole in pieces:
            rows.append((doc, start, length, zlib.crc32(ids.astype("<u4").tobytes()), whole, name, offset))
            offset += length
        return rows

    def finish(self) -> list[tuple]:
        """The last window, as sequences of falling powers of two."""
        out, pieces = [], self.open[::-1]
        left = self.filled
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            taken = []
            while size:
                doc, start, length, ids, whole = pieces.pop()
                take = min(size, length)
                taken.append((doc, start, take, ids[:take], whole))
                if take < length:
                    pieces.append((doc, start + take, length - take, ids[take:], whole))
                size -= take
            out += self.close(taken)
        return out


def tokenised(docs: DataFrame, path: str, kind: np.dtype) -> DataFrame:
    """(doc_id, ids) of every document, and rows (term, count) of each task's documents by token; term -1 counts all
    its documents, -2 all their tokens. Ids take two bytes where the vocabulary allows it."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        counts, n, held = np.zeros(0, np.int64), 0, 0
        for batch in batches:
            for part in chunks(batch):
                found, ends = bpe.encode_texts(part.column(1))
                ids = np.full(len(found) + part.num_rows, END, kind)
                ids[np.arange(len(found)) + np.repeat(np.arange(part.num_rows), np.diff(ends, prepend=0))] = found
                offsets = np.concatenate([[0], ends + 1 + np.arange(part.num_rows)])
                times = np.bincount(terms_of(ids, offsets)[1], minlength=len(counts))
                times[: len(counts)] += counts
                counts, n, held = times, n + part.num_rows, held + len(ids)
                none = pa.nulls(part.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), binary(ids, offsets), none, none], ["doc_id", "ids", "term", "count"])
        terms = np.flatnonzero(counts)
        none = len(terms) + 2
        yield pa.RecordBatch.from_arrays([pa.nulls(none, pa.int64()), pa.nulls(none, pa.binary()), pa.array([*terms, -1, -2], pa.int64()), pa.array([*counts[terms], n, held], pa.int64())], ["doc_id", "ids", "term", "count"])

    return materialise(over_arrow(documents(docs), kernel, "doc_id long, ids binary, term long, count long"), "tokens")


def binary(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    at = (offsets * ids.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(at), pa.py_buffer(ids)])


def ids_in(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All documents' ids, and n + 1 offsets."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind), (at - at[0]) // kind.itemsize


def pack(docs: DataFrame, tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row for each piece of a document in a sequence."""
    path = tokenizer or public_tokenizers.path(VOCABULARY)
    kind = np.dtype("<u2" if len(load(path).decode_offsets) <= 1 << 16 else "<u4")
    tokens = tokenised(docs, path, kind)
    # At most a row a token of the vocabulary.
    counted = {r["term"]: r["count"] for r in tokens.where("term IS NOT NULL").groupBy("term").agg(F.sum("count").alias("count")).collect()}
    n, held = counted.pop(-1, 0), counted.pop(-2, 0)
    frequency = np.zeros(max(counted, default=END) + 1, np.int64)
    frequency[list(counted)] = list(counted.values())
    corpus = tokens.sparkSession.sparkContext.broadcast(Corpus(frequency, n, held / max(n, 1)))
    rows = tokens.where("ids IS NOT NULL").select("doc_id", "ids")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text=1):
                ids, offsets = ids_in(part.column(1), kind)
                one, two = corpus.value.routes(ids, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(np.diff(offsets))], ["one", "two", "n"])

    pairs = materialise(over_arrow(rows, measure, "one long, two long, n long").groupBy("one", "two").agg(F.sum("n").alias("n")), "pairs")
    # At most a row a token of the vocabulary, and few pairs with a quarter of a shard.
    by_term = {r["one"]: r["n"] for r in pairs.groupBy("one").agg(F.sum("n").alias("n")).collect()}
    by_pair = {(r["one"], r["two"]): r["n"] for r in pairs.where(F.col("n") * 4 > shard_tokens).collect()}
    shards = tokens.sparkSession.sparkContext.broadcast(Shards(by_term, by_pair, shard_tokens))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text=1):
                one, two = corpus.value.routes(*ids_in(part.column(1), kind))
                keys = zip(one.tolist(), two.tolist(), part.column(0).to_pylist(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([shards.value.of(*k) for k in keys], pa.int64()), part.column(0), part.column(1)], ["shard", "doc_id", "ids"])

    def rows_to_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId(), corpus.value)
        names: list = []
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held, now = 0, None

        def packed() -> list[tuple]:
            if not names:
                return []
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            out = packer.add(list(names), np.concatenate(parts), offsets)
            for kept in (names, parts, sizes):
                kept.clear()
            return out

        for batch in batches:
            for part in chunks(batch, text=2):
                shard = np.asarray(part.column(0))
                ids, offsets = ids_in(part.column(2), kind)
                start = 0
                while start < len(shard):
                    # Rows of one shard; those that a hash fills far beyond their share are cut, so that a worker's memory is bounded.
                    if names and (shard[start] != now or held >= 2 * shard_tokens):
                        if out := packed():
                            yield rows_to_batch(out)
                        held = 0
                    now = shard[start]
                    end = int(np.searchsorted(shard[start:], now, side="right")) + start
                    end = max(start + 1, min(end, int(np.searchsorted(offsets, offsets[start] + 2 * shard_tokens - held))))
                    names += part.column(1)[start:end].to_pylist()
                    parts.append(ids[offsets[start] : offsets[end]].copy())
                    sizes.append(np.diff(offsets[start : end + 1]))
                    held += int(offsets[end] - offsets[start])
                    start = end
        if out := packed() + packer.finish():
            yield rows_to_batch(out)

    routed = over_arrow(rows, route, "shard long, doc_id long, ids binary")
    return over_arrow(routed.repartition("shard").sortWithinPartitions("shard", "doc_id", "ids"), fill, SCHEMA)
