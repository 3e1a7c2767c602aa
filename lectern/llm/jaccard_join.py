"""N-gram Jaccard self-join by universe partition and pigeonhole.

A text's set is its distinct word shingles as 64-bit hashes. Equal sets form a
class, found by a 128-bit digest, and only one document of a class goes on.

Two sets of sizes a and b with similarity p / q or more differ in at most
D = (a + b) * (q - p) / (q + p) elements. Sizes fall in bands so wide that a
set's smaller partners lie in its own band or the one below. In a band the
universe is hashed into numbered segments, a few more than any D of the band
needs. A set's signatures are its subsets of the first D + 1 segments in which
it has any element, D being that of its largest partner: of the segments up to
the smaller one's last, at most D differ, so one that both have agrees. A set
with too few such segments indexes one-deletion neighbourhoods as well.

Which units a set pays for depends on the postings that are counted. Subsets
are cheap, but a frequent passage's shingle alone in a segment has long
postings. Documents in a bucket of more than HOT members that are not linked
through its hub change to units that cost more signatures and have short
postings: half as many segments, each with its one-deletion neighbourhood, of
which one differs in at most one element. Every pair that only shares long
postings has both documents there, so nothing is lost.

Candidates are compared in rounds, and each round leaves out what the links so
far connect: every document with the most connected one that it shares a bucket
with; then with the most connected one of each of its buckets, which is linear
in the buckets; only then the members of a bucket with one another, where the
join emits only pairs within an exact lower bound on the difference from
512-bit parity sketches. Sets that are large for these have a second sketch that
grows with them, which their candidates must pass. Every candidate is verified on
the sets themselves, which are built for candidates alone. Signatures are made and counted in passes over ranges of
their hashes, a fixed number for a given similarity, so that the shuffled rows
of one pass are on disk at a time.

Defined results: a null text or one without words has the empty set, which
links with nothing; fewer words than the shingle's width form one shingle;
repeated rows each get a row, and count as copies; rows without an id link as
others do, but never name a component (null, if no member has an id); ids are
below 2 ** 62; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lectern.llm.arrow import chunks, documents, over_arrow
from lectern.llm.features import Chunk, mix
from lectern.operators.graph import connected_components
from lectern.session import discard, materialise, tidy

WIDTH, PERCENT = 3, 90
#: A band is so many factors of similarity wide: in wider ones small sets have few elements a segment, in narrower ones
#: more sets need the band below as well.
BAND = 3
#: Members of a bucket from which its documents change to the signatures with short postings.
HOT = 32
#: Ids from here on stand for classes whose documents have none.
NAMELESS = 1 << 62
#: Rounds in which candidates are verified, if their sets are as large as all sets together.
ROUNDS = 4
#: Bits that mark the ids whose texts are wanted.
MARKS = 1 << 23
#: Links of which one task finds the components; more take rounds of shuffles.
FEW = 1 << 18
#: 64-bit words of a parity sketch.
SKETCH = 8
#: Sets of more elements have a wide sketch as well, of two bits an element at least.
WIDE = 512
U = np.uint64


def differ(total, percent: int):
    """The most elements in which two sets of so many elements together may differ."""
    return total * (100 - percent) // (100 + percent)


def passes(percent: int) -> int:
    """Passes over the signatures: about one for each sixteenth of a set's elements that gives one."""
    return max(1, 16 * differ(100 + 10_000 // percent, percent) // 100)


@lru_cache(maxsize=8)
def bands(percent: int, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower edges of the size bands, the largest partner of each band's sets, and the most elements a pair differs in."""
    first = next(n for n in range(1, 10_000) if differ(n + n * 100 // percent, percent) > 0)
    edges = [first]
    while edges[-1] <= largest:
        edges.append(max(edges[-1] * 100 // percent + 1, edges[-1] * 100**BAND // percent**BAND))
    edges.append(edges[-1] * 100**BAND // percent**BAND + 1)
    top = [e - 1 for e in edges[1:]]
    partner = [t * 100 // percent for t in top]
    return np.array(edges), np.array(partner), np.array([differ(t + p, percent) for t, p in zip(top, partner, strict=True)])


def shingles(chunk: Chunk, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text in order, and n + 1 offsets."""
    hashes = chunk.word_hashes()
    at, values = chunk.windows(hashes, width)
    docs = chunk.word_doc[at]
    counts = np.diff(chunk.first)
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        own = hashes[chunk.first[i] : chunk.first[i + 1]]
        value = np.array([counts[i]], U)
        for h in own:
            value = mix(value * U(31) + h + U(7))
        values, docs = np.concatenate([values, value]), np.concatenate([docs, [i]])
    order = np.lexsort((values, docs))
    values, docs = values[order], docs[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (docs[1:] != docs[:-1])
    values, docs = values[fresh], docs[fresh]
    return values, np.searchsorted(docs, np.arange(chunk.n + 1))


def signatures(values: np.ndarray, offsets: np.ndarray, percent: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of each set and n + 1 offsets; short: those with short postings."""
    sizes = np.diff(offsets)
    edges, partner, most = bands(percent, 1 << 40)
    own = np.searchsorted(edges, sizes, side="right") - 1
    out_doc, out_sig = [np.zeros(0, np.int64)], [np.zeros(0, U)]
    spread = mix(values ^ U(0xA5A5A5A5))
    for below in (0, 1):
        band = own - below
        use = (own >= 0) & (band >= 0) & ((below == 0) | (sizes <= partner[np.maximum(band, 0)]))
        docs = np.flatnonzero(use)
        if not len(docs):
            continue
        n = sizes[docs]
        # The largest difference from a partner in this band: of the own band or the next, or at most the band's top.
        d = differ(n + (n * 100 // percent if below == 0 else edges[band[docs] + 1] - 1), percent)
        # A sixth more segments than differences leaves enough with elements.
        m = most[band[docs]] // 2 + 1 if short else most[band[docs]] + 1 + most[band[docs]] // 6 + (most[band[docs]] > 2)
        base = np.concatenate([[0], np.cumsum(m)])
        which = np.repeat(np.arange(len(docs)), n)
        element = np.repeat(offsets[docs] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        key = mix(values[element] + U(0x1234567 + 0x1000000 * short) * (band[docs][which].astype(U) + U(1)))
        segment = base[which] + (key % m[which].astype(U)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        segment, element = segment[order], element[order]
        start = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        filled = segment[start]
        length = np.diff(np.concatenate([start, [len(segment)]]))
        total = np.add.reduceat(spread[element], start)
        owner = np.searchsorted(base, filled, side="right") - 1
        number = filled - base[owner]
        place = mix(band[docs][owner].astype(U) * U(1 << 32) + number.astype(U) + U(short) * U(1 << 62))
        held = np.bincount(owner, minlength=len(docs))
        if short:
            # Of the first d // 2 + 1 segments one differs in at most one element, none included.
            near, some, lone_docs = place, number <= d[owner] // 2, np.flatnonzero(held < m)
            out_doc.append(docs[owner[some]])
            out_sig.append(mix(total[some] ^ near[some]))
        else:
            # The first d + 1 segments with elements.
            rank = np.arange(len(owner)) - (np.cumsum(held) - held)[owner]
            take = rank <= d[owner]
            out_doc.append(docs[owner[take]])
            out_sig.append(mix(total[take] ^ place[take]))
            # Sets with fewer. If two of them agree only where both are empty, in e segments, then of the others, which
            # all differ, at most e - 1 differ in more than one element. So one of the first 2e segments differs in
            # exactly one; a set with E >= e empty ones indexes the neighbourhoods of its first 2E segments.
            empty = np.where(held <= d, m - held, 0)
            near, some, lone_docs = mix(place + U(99)), number < 2 * empty[owner], np.flatnonzero(empty > 0)
            out_doc.append(docs[owner[some]])
            out_sig.append(mix(total[some] ^ near[some]))
        run = np.repeat(np.arange(len(start)), length)
        pick = some[run]
        out_doc.append(docs[owner[run[pick]]])
        out_sig.append(mix((total[run[pick]] - spread[element[pick]]) ^ near[run[pick]]))
        # The difference may be an element against none; and with more than half of the segments
        # empty in both, nothing else may be left: then the empty segments themselves are indexed.
        first = np.cumsum(held) - held
        for k in lone_docs:
            lone = np.setdiff1d(np.arange(m[k]), number[first[k] : first[k] + held[k]])
            lone = lone[lone <= d[k] // 2] if short else lone[(lone < 2 * empty[k]) | (2 * empty[k] > m[k])]
            where = mix(U(band[docs[k]]) * U(1 << 32) + lone.astype(U) + U(short) * U(1 << 62))
            out_doc.append(np.full(len(lone), docs[k]))
            out_sig.append(mix(where if short else mix(where + U(99))))
    docs, sigs = np.concatenate(out_doc), np.concatenate(out_sig)
    order = np.argsort(docs, kind="stable")
    return sigs[order], np.searchsorted(docs[order], np.arange(len(sizes) + 1))


def sketches(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Parity sketches: bit i of a set is the parity of its elements that hash to i."""
    n = len(offsets) - 1
    docs = np.repeat(np.arange(n), np.diff(offsets))
    bit = (mix(values + U(77)) >> U(55)).astype(np.int64)
    parity = (np.bincount(docs * 512 + bit, minlength=n * 512) & 1).astype(np.uint8).reshape(n, 512)
    return np.packbits(parity, axis=1).view(np.int64).reshape(n, SKETCH)


def wide_sketches(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity sketches of the sets of more than WIDE elements and n + 1 offsets; none of the others. A sketch has a
    power of two of words, and the xor of its halves is the sketch of half its length."""
    sizes = np.diff(offsets)
    words = np.where(sizes > WIDE, 1 << np.ceil(np.log2(np.maximum(sizes, 1) / 32)).astype(np.int64), 0)
    out = [np.zeros(0, np.int64)]
    for i in np.flatnonzero(words):
        spread = mix(values[offsets[i] : offsets[i + 1]] + U(78))
        place = (spread & U(words[i] - 1)) << U(6) | spread >> U(58)
        parity = (np.bincount(place.astype(np.int64), minlength=words[i] << 6) & 1).astype(np.uint8)
        out.append(np.packbits(parity).view(np.int64))
    return np.concatenate(out), np.concatenate([[0], np.cumsum(words)])


def digests(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    def total(x: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros(1, U), np.cumsum(x, dtype=U)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64)

    return total(mix(values ^ U(0x5555))), total(mix(values ^ U(0xCCCC)))


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def over_sets(docs: DataFrame, width: int, columns: Callable[[np.ndarray, np.ndarray], dict[str, pa.Array]], schema: str) -> DataFrame:
    """doc_id, n_shingles, the digest h1 and h2, and columns() of every document's set."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                values, offsets = shingles(Chunk(part.column(1), lower=True), width)
                h1, h2 = digests(values, offsets)
                more = columns(values, offsets)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets).astype(np.int64)), pa.array(h1), pa.array(h2), *more.values()], ["doc_id", "n_shingles", "h1", "h2", *more])

    return over_arrow(documents(docs), kernel, "doc_id long, n_shingles long, h1 long, h2 long" + schema)


def keys(docs: DataFrame, width: int, sketch: bool = False) -> DataFrame:
    """doc_id, n_shingles and digest of every document, and the parity sketches of its set."""

    def bits(values: np.ndarray, offsets: np.ndarray) -> dict[str, pa.Array]:
        found = sketches(values, offsets)
        return {"bits": _lists(found.reshape(-1), np.arange(len(found) + 1) * SKETCH), "wide": _lists(*wide_sketches(values, offsets))}

    return over_sets(docs, width, bits, ", bits array<long>, wide array<long>") if sketch else over_sets(docs, width, lambda values, offsets: {}, "")


def buckets(signed: Callable[[int, int], DataFrame], rounds: int) -> DataFrame:
    """(sig, rep, n, size) of the signatures that several classes have, size being their number; signed(turn, rounds)
    gives (rep, n, sigs) with one share of all signatures."""
    found = []
    for turn in range(rounds):
        rows = signed(turn, rounds).where(F.size("sigs") > 0).select("rep", "n", F.explode(F.array_distinct("sigs")).alias("sig")).repartition("sig")
        # Counting reads the columns that the join reads, so one shuffle of the rows serves both.
        size = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.max("n").alias("most")).where("lo <> hi AND most > 0").select("sig", "size")
        found.append(materialise(rows.join(size.hint("merge"), "sig").select("sig", "rep", "n", "size"), f"buckets_{turn}"))
    out = reduce(DataFrame.unionByName, found)
    if rounds > 1:
        out._lectern_parts = found
    return out


def share(values: np.ndarray, offsets: np.ndarray, percent: int, short: bool, turn: int, rounds: int) -> pa.Array:
    """Those signatures of each set whose turn it is."""
    sigs, at = signatures(values, offsets, percent, short)
    mine = sigs % U(rounds) == U(turn)
    return _lists(sigs[mine], np.concatenate([[0], np.cumsum(mine)])[at])


def document_buckets(docs: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """buckets() of all classes, by their cheap signatures."""

    def signed(turn: int, rounds: int) -> DataFrame:
        # Copies meet before their signatures are spread; one document of a class is as good as another.
        rows = over_sets(docs, width, lambda v, o: {"sigs": share(v, o, percent, False, turn, rounds)}, ", sigs array<long>")
        return rows.where(F.size("sigs") > 0).groupBy("h1", "h2").agg(F.first("sigs").alias("sigs")).join(reps.select("h1", "h2", "rep", "n").hint("merge"), ["h1", "h2"])

    return buckets(signed, passes(percent))


def short_buckets(sets: DataFrame, percent: int) -> DataFrame:
    """buckets() of some sets, by their signatures with short postings."""

    def signed(turn: int, rounds: int) -> DataFrame:
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    lists = part.column(1)
                    offsets = np.asarray(lists.offsets, dtype=np.int64)
                    values = np.asarray(lists.values)[offsets[0] : offsets[-1]].view(U)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), share(values, offsets - offsets[0], percent, True, turn, rounds)], ["rep", "n", "sigs"])

        return over_arrow(sets.select("rep", "elements", "n"), kernel, "rep long, n long, sigs array<long>")

    return buckets(signed, passes(percent))


def marked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id has the hash of one of ids (doc_id), modulo MARKS: all of ids' rows and few others. The
    bitmaps that are broadcast are of one size however many ids there are."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS))
    held = ids.withColumn("place", place).groupBy(F.expr("place div 32768").alias("bitmap")).agg(F.expr("bitmap_construct_agg(place % 32768)").alias("marks"))
    found = rows.withColumn("place", place).withColumn("bitmap", F.expr("place div 32768")).join(F.broadcast(held), "bitmap")
    byte = F.expr("cast(conv(hex(substring(marks, cast(place % 32768 div 8 AS int) + 1, 1)), 16, 10) AS int)")
    return found.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(place % 8 AS int))")) != 0).select(*rows.columns)


def sets_of(docs: DataFrame, wanted: DataFrame, width: int, name: str) -> DataFrame:
    """rep, n, elements of the wanted classes (rep, n, h1, h2), as a written table."""
    wanted = materialise(wanted, "wanted")
    # The wanted ids grow with the data, so they are never broadcast.
    ids = wanted.where(F.col("rep") < NAMELESS).select(F.col("rep").alias("doc_id")).distinct()
    rows = documents(docs)
    # Most texts aren't wanted; these stay where they are. A semi-join would be pushed below the marks, and so would shuffle
    # all texts; an inner join isn't.
    rows = marked(rows, ids).join(ids.hint("merge"), "doc_id").unionByName(rows.where("doc_id IS NULL"))
    found = over_sets(rows, width, lambda values, offsets: {"elements": _lists(values, offsets)}, ", elements array<long>")
    # Several rows of one id, or rows without one, may be of a class.
    one = found.groupBy("h1", "h2").agg(F.first("elements").alias("elements"))
    sets = materialise(one.join(wanted.hint("merge"), ["h1", "h2"]).select("rep", "n", "elements"), name)
    discard(wanted)
    return sets


def _sizes_may(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(f"{a}_n", f"{b}_n") >= percent * F.greatest(f"{a}_n", f"{b}_n")


def _may_link(a: str, b: str, percent: int) -> Column:
    """Size filter and sketch bound: the sketches' distance is at most the sets' difference."""
    col = F.col
    apart = sum((F.bit_count(col(f"{a}_bits")[i].bitwiseXOR(col(f"{b}_bits")[i])) for i in range(SKETCH)), F.lit(0))
    return _sizes_may(a, b, percent) & (apart * (100 + percent) <= (col(f"{a}_n") + col(f"{b}_n")) * (100 - percent))


def _wide_may_link(a: str, b: str, percent: int) -> Column:
    """The same bound from the wide sketches, the longer one halved once; true where they don't allow that."""
    col = F.col
    least, most = (f(F.size(f"{a}_wide"), F.size(f"{b}_wide")) for f in (F.least, F.greatest))
    xor = lambda p, q: p.bitwiseXOR(q)
    halved = lambda x: F.when(F.size(x) > least, F.zip_with(F.slice(x, F.lit(1), least), F.slice(x, least + 1, least), xor)).otherwise(col(x))
    apart = F.aggregate(F.zip_with(halved(f"{a}_wide"), halved(f"{b}_wide"), xor), F.lit(0), lambda total, x: total + F.bit_count(x))
    return (least == 0) | (most > 2 * least) | (apart * (100 + percent) <= (col(f"{a}_n") + col(f"{b}_n")) * (100 - percent))


def verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, width: int, percent: int, whole: int | None = None) -> DataFrame:
    """The (a, b) of pairs whose sets are as similar as asked, as a written table. Sets are built for the ends of
    pairs within the sketches' bound, for a share of the pairs at a time, so that the sets of one share are on disk.
    whole: the elements of all sets, if they are counted already."""
    named = lambda p, *names: reps.select(F.col("rep").alias(p), *(F.col(k).alias(f"{p}_{k}") for k in names)).hint("merge")
    # The wide sketches are joined with the pairs that the narrow ones leave.
    close = pairs.join(named("a", "n", "bits"), "a").join(named("b", "n", "bits", "wide"), "b").where(_may_link("a", "b", percent)).drop("a_bits", "b_bits")
    close = close.join(named("a", "wide"), "a").where(_wide_may_link("a", "b", percent)).select("a", "b", (F.col("a_n") + F.col("b_n")).alias("n"))
    close = materialise(close, "candidates")
    # The sets of all pairs' ends, if no two pairs had one in common.
    held = close.agg(F.sum("n")).first()[0]
    if held is None:
        return close
    if whole is None:
        whole = elements(reps)
    if ROUNDS * held > whole:
        ends = close.select(F.col("a").alias("rep")).unionByName(close.select(F.col("b").alias("rep"))).distinct()
        held = elements(reps.select("rep", "n").join(ends.hint("merge"), "rep"))
    rounds = max(1, -(-ROUNDS * held // whole))
    # A hub is an end of many pairs and of every share; the other ends are dealt out.
    turn = F.pmod(F.xxhash64("b"), F.lit(rounds))
    links = [compared(docs, reps, close.where(turn == i) if rounds > 1 else close, width, percent) for i in range(rounds)]
    discard(close)
    out = reduce(DataFrame.unionByName, links)
    if rounds > 1:
        out._lectern_parts = links
    return out


def elements(sets: DataFrame) -> int:
    """The elements of sets of sizes n."""
    return sets.agg(F.sum("n")).first()[0] or 0


def compared(docs: DataFrame, reps: DataFrame, close: DataFrame, width: int, percent: int) -> DataFrame:
    """verified() of one share of the pairs, by their sets."""
    ends = close.select(F.col("a").alias("rep")).unionByName(close.select(F.col("b").alias("rep"))).distinct()
    sets = sets_of(docs, reps.select("rep", "n", "h1", "h2").join(ends.hint("merge"), "rep"), width, "sets")
    one = sets.select(F.col("rep").alias("a"), F.col("elements").alias("x")).hint("merge")
    two = sets.select(F.col("rep").alias("b"), F.col("elements").alias("y")).hint("merge")
    both = close.join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("x", "y")))
    links = materialise(both.where(100 * F.col("common") >= percent * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b"), "links")
    # The links are written, so what they came from can go.
    discard(sets)
    return links


def least_linked(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of links and the smallest end that each is connected with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while True:
        low, high = np.minimum(least[u], least[v]), np.maximum(least[u], least[v])
        if (low == high).all():
            return nodes, nodes[least]
        # Of two roots the larger hangs on the smaller one, then every node on its root.
        np.minimum.at(least, high, low)
        while not np.array_equal(further := least[least], least):
            least = further


def components(links: DataFrame) -> DataFrame:
    """rep, part (the smallest class that it is connected with) of the ends of links (a, b)."""
    if links.count() > FEW:
        found = connected_components(links)
        out = found.select(F.col("node").alias("rep"), F.col("component").alias("part"))
        out._lectern_parts = found._lectern_parts
        return out

    # Each round of shuffles costs the driver as much for a few links as for many.
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((2, 0), np.int64), *(np.stack([np.asarray(c) for c in batch.columns]) for batch in batches)]
        nodes, least = least_linked(*np.concatenate(held, axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], ["rep", "part"])

    return over_arrow(links.coalesce(1), kernel, "rep long, part long")


class Parts:
    """Components of the links so far: the rows (rep, part) of linked classes."""

    def __init__(self) -> None:
        self.rows: DataFrame | None = None

    def add(self, links: DataFrame) -> None:
        added, links = links, links.select("a", "b")
        if self.rows is not None:
            links = links.unionByName(self.rows.where("rep <> part").select(F.col("rep").alias("a"), F.col("part").alias("b")))
        found = components(links)
        before, self.rows = self.rows, materialise(found, "parts")
        # The parts hold all that the links and the parts before said.
        for written in (added, before, found):
            if written is not None:
                discard(written)
        tidy(links.sparkSession)

    def of(self, rows: DataFrame) -> DataFrame:
        """rows (rep, ...) with their parts; a class without links is its own."""
        if self.rows is None:
            return rows.withColumn("part", F.col("rep"))
        return rows.join(self.rows.hint("merge"), "rep", "left").withColumn("part", F.coalesce("part", "rep"))

    def torn(self, found: DataFrame) -> DataFrame:
        """(sig, rep, n, size, part) of the buckets whose members the links don't connect, as a written table; found stays."""
        placed = self.of(found.select("sig", "rep", "n", "size"))
        apart = placed.groupBy("sig").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("sig")
        out = materialise(placed.join(apart.hint("merge"), "sig", "left_semi"), "torn")
        tidy(out.sparkSession)
        return out


def hubs(placed: DataFrame, percent: int) -> DataFrame:
    """(a, b, weight): each bucket's member in the most and largest buckets with each of the others in other parts,
    where their sizes allow a link."""
    weight = placed.groupBy("rep").agg(F.sum("size").alias("weight"))
    hub = placed.join(weight.hint("merge"), "rep").groupBy("sig").agg(F.max(F.struct("weight", (-F.col("rep")).alias("least"), F.col("part").alias("hub_part"), F.col("n").alias("a_n"))).alias("hub"))
    rows = placed.withColumnRenamed("n", "b_n").join(hub.select("sig", "hub.*").hint("merge"), "sig").where((F.col("hub_part") != F.col("part")) & _sizes_may("a", "b", percent))
    return rows.select((-F.col("least")).alias("a"), F.col("rep").alias("b"), "weight")


def first_choice(placed: DataFrame, percent: int) -> DataFrame:
    """Of each class's hubs the most connected one: one pair a class."""
    best = hubs(placed, percent).groupBy("b").agg(F.max(F.struct("weight", (-F.col("a")).alias("least"))).alias("hub"))
    return best.select((-F.col("hub.least")).alias("a"), "b")


def across(apart: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs of one bucket in different parts that pass the sketches' bound, which the join itself applies."""
    held = apart.join(reps.select("rep", "bits").hint("merge"), "rep")
    side = lambda p: held.select(F.col("sig").alias(f"{p}_sig"), F.col("rep").alias(p), F.col("part").alias(f"{p}_part"), F.col("n").alias(f"{p}_n"), F.col("bits").alias(f"{p}_bits")).hint("merge")
    close = (F.col("a_sig") == F.col("b_sig")) & (F.col("a") < F.col("b")) & (F.col("a_part") != F.col("b_part")) & _may_link("a", "b", percent)
    return side("a").join(side("b"), close).select("a", "b").distinct()


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    nameless = F.col("h1").bitwiseAND(F.lit(NAMELESS - 1)).bitwiseOR(F.lit(NAMELESS))
    reps = keys(docs, width, sketch=True).where("n_shingles > 0").groupBy("h1", "h2").agg(F.first("n_shingles").alias("n"), F.min("doc_id").alias("rep"), F.first("bits").alias("bits"), F.first("wide").alias("wide"))
    reps = materialise(reps.withColumn("rep", F.coalesce("rep", nameless)), "reps")
    whole = elements(reps)
    found = document_buckets(docs, reps, width, percent)
    check = lambda pairs: verified(docs, reps, pairs, width, percent, whole)

    # Each class with the most connected one that it meets, then with all its buckets' hubs in other parts, then all
    # members of small buckets that are still in different parts.
    # A table of buckets goes once the next one is written.
    parts = Parts()
    parts.add(check(first_choice(parts.of(found), percent)))
    apart = parts.torn(found)
    discard(found)
    parts.add(check(hubs(apart, percent).select("a", "b").distinct()))
    wide, apart = apart, parts.torn(apart)
    discard(wide)
    parts.add(check(across(apart.where(F.col("size") <= hot), reps, percent)))

    # Classes of long postings that are still apart, by signatures with short ones.
    long = parts.torn(apart.where(F.col("size") > hot))
    busy = materialise(long.select("rep").distinct(), "busy")
    discard(apart)
    discard(long)
    if not busy.isEmpty():
        wanted = reps.select("rep", "n", "h1", "h2").join(busy.hint("merge"), "rep", "left_semi")
        sets = sets_of(docs, wanted, width, "busy_sets")
        found = short_buckets(sets, percent)
        discard(sets)
        apart = parts.torn(found)
        discard(found)
        parts.add(check(hubs(apart, percent).select("a", "b").distinct()))
        wide, apart = apart, parts.torn(apart)
        discard(wide)
        parts.add(check(across(apart, reps, percent)))
        discard(apart)

    classes = parts.of(reps.select("h1", "h2", "rep")).select("h1", "h2", F.when(F.col("part") < NAMELESS, F.col("part")).alias("component_id"))
    # A second pass over the texts costs less than keeping every row's digest and signatures.
    found = keys(docs, width).join(classes.withColumn("named", F.lit(True)), ["h1", "h2"], "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("named"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
