"""Exact byte-level BPE by backtracking over Aho-Corasick matches.

An encoding is the merge rules' result exactly if every two adjacent tokens
could stand beside each other, so the encoder walks from the left, takes the
longest vocabulary entry that may follow the previous one, and steps back
where nothing fits. A position that failed once is never tried again, which
bounds the work by the number of positions. Decoding gathers bytes through an
offset table.

The distinct new words of many texts are encoded together. The automaton is
run from all their positions at once, which needs no failure links, and gives
the longest entry that starts at each; then the words take their steps side by
side, a round being a few array operations over all words that are not done.
Verdicts on pairs of tokens go to a table of fixed size. Entries have a bounded
length, so all of it is linear in the text.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex

from lectern.llm.arrow import ragged_take, raw_bytes
from lectern.llm.features import fold_latin, span_hashes, words_between

#: The pre-tokeniser's pattern; a fixed value of the vocabulary file's kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of Latin-1 without the separators that only Python takes for white space.
LATIN = regex.compile("[\x00-\x1b\x20-\xff]*")
#: ASCII letters; second bytes of Latin-1 letters behind 0xC3; marks that often end a word; bytes that surely aren't white space; white space bytes
#: other than the space; visible ASCII.
LETTER, ACCENTED, MARK_BYTE, CLEAR, GAP = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool), np.ones(256, bool), np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
ACCENTED[0x80:0xC0] = True
ACCENTED[[0x97, 0xB7]] = False
MARK_BYTE[list(b".,!?;:")] = True
CLEAR[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = False
GAP[9:14] = True
INK = np.zeros(256, bool)
INK[33:127] = True
#: Bits of the table of pieces, which begins anew when it is half full: some 10 MB.
TABLE_BITS = 18
#: Symbols that one sweep of the automaton takes; words so few that they are walked one by one; bits of the table of pairs.
SWEEP, FEW, PAIR_BITS = 1 << 18, 24, 18
#: Bytes, bytes that end a word, and a border that no entry has.
SYMBOLS = 513
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def ragged_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated data[a:b] of the spans, and each one's end."""
    lengths = ends - starts
    last = np.cumsum(lengths)
    index = np.repeat(starts - (last - lengths), lengths)
    index += np.arange(len(index))
    return data[index], last


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand_in = {chr(b): b for b in plain}
    stand_in.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return stand_in


class PieceTable:
    """64-bit hashes of pieces -> their token ids, in arrays with open addressing; emptied when it holds ENTRIES."""

    def __init__(self) -> None:
        self.reset()

    def reset(self, bits: int = TABLE_BITS) -> None:
        self.bits, self.size, self.held = bits, 0, 0
        self.place = np.full(1 << bits, -1, np.int32)
        self.hashes, self.first, self.count = np.zeros(1 << (bits - 1), np.uint64), np.zeros(1 << (bits - 1), np.int64), np.zeros(1 << (bits - 1), np.int32)
        self.ids = np.zeros(4 << (bits - 1), np.uint32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry numbers, -1 where there is none."""
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.place[slot]
        left = np.flatnonzero((out >= 0) & (self.hashes[out] != hashes))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            out[left] = self.place[slot[left]]
            left = left[(out[left] >= 0) & (self.hashes[out[left]] != hashes[left])]
        return out

    def add(self, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """New, distinct hashes with their ids, one after the other."""
        a, b = self.size, self.size + len(hashes)
        while b > len(self.hashes):
            self.bits += 1
            self.hashes, self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hashes, self.first, self.count))
            self.place = np.full(1 << self.bits, -1, np.int32)
            a = 0
        if self.held + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)])
        self.ids[self.held : self.held + len(ids)] = ids
        self.hashes[self.size : b], self.count[self.size : b] = hashes, counts
        self.first[self.size : b] = self.held + np.cumsum(counts) - counts
        self.size, self.held = b, self.held + len(ids)
        entries = np.arange(a, b)
        slot = (self.hashes[entries] >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(entries):
            # The first of those that want a free slot gets it; the others try the next one.
            _, first = np.unique(slot, return_index=True)
            first = first[self.place[slot[first]] < 0]
            self.place[slot[first]] = entries[first]
            left = np.ones(len(entries), bool)
            left[first] = False
            entries, slot = entries[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def take(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries' ids, one after the other, and each one's end."""
        counts = self.count[entries].astype(np.int64)
        ends = np.cumsum(counts)
        index = np.repeat(self.first[entries] - (ends - counts), counts)
        index += np.arange(len(index))
        return self.ids[index], ends


class PairMap:
    """A map from pairs of ranks to ranks as two arrays, with open addressing."""

    def __init__(self, pairs: dict[tuple[int, int], int]) -> None:
        self.bits = max(4, (3 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        keys = np.array([a << 20 | b for a, b in pairs], dtype=np.int64)
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        slot = self.slots(keys)
        while len(keys):
            # The first of those that want a free slot gets it; the others try the next one.
            _, first = np.unique(slot, return_index=True)
            first = first[self.keys[slot[first]] < 0]
            self.keys[slot[first]], self.values[slot[first]] = keys[first], values[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The pairs' values, -1 where there is none."""
        keys = a << 20 | b
        slot = self.slots(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], np.int32(-1))
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out


class ByteBPE:
    """A byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, stand_in = spec["model"], byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.suffix = model.get("end_of_word_suffix") or ""

        def symbols(name: str) -> str:
            """An entry as one character a symbol: a byte, or 256 more for a byte that ends its word."""
            if self.suffix and name.endswith(self.suffix):
                name = name[: -len(self.suffix)]
                return "".join(chr(stand_in[c]) for c in name[:-1]) + chr(256 + stand_in[name[-1]])
            return "".join(chr(stand_in[c]) for c in name)

        names = {i: symbols(s) for s, i in model["vocab"].items() if s not in self.special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # Ranks: single symbols first, then merges in order. The walk compares ranks.
        single = sorted(i for i, s in names.items() if len(s) == 1)
        rank_to_id = [*single]
        rank_of = {names[i]: r for r, i in enumerate(single)}
        self.pairs: dict[tuple[int, int], int] = {}
        self.left, self.right = list(range(len(single))), list(range(len(single)))
        for a, b in merges:
            left, right = rank_of[symbols(a)], rank_of[symbols(b)]
            joined = symbols(a) + symbols(b)
            if joined in rank_of:
                raise ValueError(f"two merges make {joined!r}: the pair table needs one")
            rank_of[joined] = rank = len(rank_to_id)
            rank_to_id.append(model["vocab"][a + b])
            self.pairs[(left, right)] = rank
            self.left.append(left)
            self.right.append(right)
        self.ids = np.array(rank_to_id, dtype=np.uint32)
        words = [names[i] for i in rank_to_id]
        self.lengths = np.array([len(w) for w in words], dtype=np.int64)
        self.shorter = np.array([next((rank_of[w[:n]] for n in range(len(w) - 1, 0, -1) if w[:n] in rank_of), -1) for w in words], dtype=np.int64)
        self.build_automaton(words)
        self.lefts, self.rights = np.array(self.left, dtype=np.int64), np.array(self.right, dtype=np.int64)
        self.merges = PairMap(self.pairs)
        self.pair_keys = np.full(1 << PAIR_BITS, -1, np.int64)
        self.pair_fits = np.zeros(1 << PAIR_BITS, bool)
        self.fits: dict[int, bool] = {}
        size = max([*names, *self.special.values()]) + 1
        pieces = [b""] * size
        for i, b in names.items():
            pieces[i] = bytes(ord(c) & 255 for c in b)
        for s, i in self.special.items():
            pieces[i] = s.encode()
        self.decode_offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        self.decode_table = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        digits = [b"%d," % i for i in range(size)]
        self.digit_offsets = np.concatenate([[0], np.cumsum([len(p) for p in digits])]).astype(np.int64)
        self.digit_table = np.frombuffer(b"".join(digits), dtype=np.uint8)
        self.pattern = regex.compile(PATTERN)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.table = PieceTable()

    def build_automaton(self, words: list[str]) -> None:
        """The automaton's states are the entries' openings: state 0 is the empty one, `goto` leads from a state by a
        symbol to the next, `ended` is the longest entry that a state's opening begins with."""
        steps: dict[tuple[int, int], int] = {}
        ended = [-1]
        for rank, word in sorted(enumerate(words), key=lambda x: len(x[1])):
            state = 0
            for symbol in map(ord, word):
                following = steps.get((state, symbol))
                if following is None:
                    steps[(state, symbol)] = following = len(ended)
                    ended.append(ended[state])
                state = following
            ended[state] = rank
        # Shorter entries came first, so a state made by a longer one knows them.
        self.ended = np.array(ended, dtype=np.int64)
        self.goto = PairMap({k: v for k, v in steps.items() if k[0]})
        # The first two steps are a plain table.
        self.opening = np.zeros((SYMBOLS, SYMBOLS), np.int32)
        self.single = np.full(SYMBOLS, -1, np.int64)
        first = {v: k[1] for k, v in steps.items() if k[0] == 0}
        for state, symbol in first.items():
            self.single[symbol] = self.ended[state]
        for (state, symbol), following in steps.items():
            if state in first:
                self.opening[first[state], symbol] = following

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merge rules can leave a and b side by side: no rule joins
        pieces across their border before both are complete."""
        x, y, limit, pairs, result = a, b, len(self.left) + 1, self.pairs, True
        while True:
            joined = pairs.get((x, y))
            if joined is not None and joined < limit:
                result = False
                break
            # Undo the later of the two merges; a piece that can't be undone passes the turn.
            if x > y:
                limit, x = x, self.right[x]
                if x == limit:
                    limit, y = y + 1, self.left[y]
                    if y + 1 == limit:
                        break
            else:
                limit, y = y + 1, self.left[y]
                if y + 1 == limit:
                    limit, x = x, self.right[x]
                    if x == limit:
                        break
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        self.fits[a << 20 | b] = result
        return result

    def compatible_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """compatible() of many pairs."""
        result, left = np.ones(len(a), bool), np.arange(len(a))
        x, y, limit = a.copy(), b.copy(), np.full(len(a), len(self.left) + 1)
        while len(left):
            joined = self.merges.get(x, y)
            bad = (joined >= 0) & (joined < limit)
            result[left[bad]] = False
            nx, ny = self.rights[x], self.lefts[y]
            undo_x = np.where(x > y, nx != x, (ny == y) & (nx != x))
            undo_y = ~undo_x & (ny != y)
            limit = np.where(undo_x, x, y + 1)
            x, y = np.where(undo_x, nx, x), np.where(undo_y, ny, y)
            on = ~bad & (undo_x | undo_y)
            left, x, y, limit = left[on], x[on], y[on], limit[on]
        return result

    def fitting(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """compatible() of many pairs, through the table."""
        keys = a << 20 | b
        slot = ((keys.astype(np.uint64) * SPREAD) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out = self.pair_fits[slot]
        new = np.flatnonzero(self.pair_keys[slot] != keys)
        if len(new):
            out[new] = self.compatible_pairs(a[new], b[new])
            self.pair_keys[slot[new]] = keys[new]
            # Of several pairs with one slot the last key stays, and so must its verdict.
            self.pair_fits[slot[new]] = out[new]
        return out

    def matches(self, symbols: np.ndarray) -> np.ndarray:
        """The rank of the longest entry that starts at each position, -1 where none does."""
        best = self.single[symbols]
        for at in range(0, len(symbols) - 1, SWEEP):
            # All positions of a stretch go through the automaton side by side, so no failure links are needed.
            state = self.opening[symbols[at : at + SWEEP][: len(symbols) - 1 - at], symbols[at + 1 : at + 1 + SWEEP]].astype(np.int64)
            place = np.flatnonzero(state)
            state, place = state[place], place + at
            depth = 2
            while len(place):
                best[place] = self.ended[state]
                more = place + depth < len(symbols)
                state, place = state[more], place[more]
                state = self.goto.get(state, symbols[place + depth])
                more = state >= 0
                state, place = state[more].astype(np.int64), place[more]
                depth += 1
        return best

    def walk(self, best: np.ndarray) -> list[int]:
        """Ranks of one word's tokens, from the longest matches at its positions."""
        size, token = len(best), int(best[0])
        lengths, shorter, compatible, known = self.lengths, self.shorter, self.compatible, self.fits.get
        dead = bytearray(size + 1)
        out: list[int] = []
        pos, last, end = 0, -1, 0
        while pos < size:
            while token >= 0:
                end = pos + int(lengths[token])
                if not dead[end]:
                    if last < 0:
                        break
                    fit = known(last << 20 | token)
                    if compatible(last, token) if fit is None else fit:
                        break
                token = int(shorter[token])
            if token >= 0:
                out.append(token)
                last, pos = token, end
                token = int(best[pos]) if pos < size else -1
            else:
                dead[pos] = 1
                token = out.pop()
                pos -= int(lengths[token])
                token = int(shorter[token])
                last = out[-1] if out else -1
        return out

    def encode_words(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the tokens of all pre-tokens, whose bytes stand one after the other, and n + 1 offsets."""
        n = len(sizes)
        # Each word is followed by a symbol that no entry has.
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        symbols = np.full(int(sizes.sum()) + n, SYMBOLS - 1, np.int64)
        inner = np.arange(int(sizes.sum())) + np.repeat(np.arange(n), sizes)
        symbols[inner] = raw
        ends = starts + sizes
        if self.suffix:
            symbols[ends[sizes > 0] - 1] += 256
        best = self.matches(symbols)
        out, depth = np.zeros(len(symbols), np.int64), np.zeros(n, np.int64)
        dead = np.zeros(len(symbols), bool)
        on = np.flatnonzero(sizes > 0)
        pos, last, token, stop, base = starts[on], np.full(len(on), -1), best[starts[on]], ends[on], starts[on]
        while len(on) > FEW:
            end = pos + self.lengths[token]
            good = (token >= 0) & ~dead[np.minimum(end, stop)]
            check = np.flatnonzero(good & (last >= 0))
            good[check] = self.fitting(last[check], token[check])
            step, back = np.flatnonzero(good), np.flatnonzero(token < 0)
            try_shorter = np.flatnonzero(~good & (token >= 0))
            token[try_shorter] = self.shorter[token[try_shorter]]
            taken = token[step]
            out[base[step] + depth[on[step]]] = taken
            depth[on[step]] += 1
            last[step], pos[step] = taken, end[step]
            token[step] = best[end[step]]
            if len(back):
                dead[pos[back]] = True
                depth[on[back]] -= 1
                level = depth[on[back]]
                undone = out[base[back] + level]
                pos[back] -= self.lengths[undone]
                token[back] = self.shorter[undone]
                last[back] = np.where(level > 0, out[base[back] + level - 1], -1)
            left = pos < stop
            if not left.all():
                on, pos, last, token, stop, base = on[left], pos[left], last[left], token[left], stop[left], base[left]
        for word in on.tolist():
            ranks = self.walk(best[starts[word] : ends[word]])
            out[starts[word] : starts[word] + len(ranks)] = ranks
            depth[word] = len(ranks)
        offsets = np.concatenate([[0], np.cumsum(depth)])
        return out[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], depth)], offsets

    def pieces_in(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of pieces that encode alone.

        A space before anything but white space always starts a pre-token, and so does what follows a lone white space
        byte behind ink; where a byte may begin white space beyond ASCII there is no border.
        """
        border = np.zeros(len(data) + 1, bool)
        clear = CLEAR[data[1:]]
        border[:-2] |= clear & (data[:-1] == 32)
        border[2:-1] |= clear[1:] & GAP[data[1:-1]] & INK[data[:-2]]
        border[offsets[:-1]] = True
        border[-1] = False
        starts = np.flatnonzero(border)
        return starts, np.append(starts[1:], len(data))

    def split(self, piece: str) -> list[str] | None:
        """The pre-tokens of a piece, as they are encoded; None if encode_whole has to."""
        return self.pattern.findall(piece)

    def plain_pieces(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each piece, whether it consists of Latin-1 letters, but for a space before (if the vocabulary has such) and
        a mark behind them; and whether it has the mark."""
        letter = LETTER[raw]
        accented = (raw[:-1] == 0xC3) & ACCENTED[raw[1:]]
        letter[:-1] |= accented
        letter[1:] |= accented
        odd = np.concatenate([[0], np.cumsum(~letter)])
        lead = (raw[starts] == 32) & (not self.suffix)
        mark = MARK_BYTE[raw[ends - 1]] & (ends - starts - lead > 1)
        return (odd[ends - mark] == odd[starts + lead]) & (ends - mark > starts + lead), mark

    def encode_new(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after the other, and their numbers."""
        plain, mark = self.plain_pieces(data, starts, ends)
        # Words are the plain pieces, then their marks, then the pre-tokens of the other pieces.
        at, more = np.flatnonzero(plain), np.flatnonzero(plain & mark)
        body, body_ends = ragged_spans(data, starts[at], ends[at] - mark[at])
        words, whole = [], []
        for i in np.flatnonzero(~plain):
            piece = data[starts[i] : ends[i]].tobytes().decode()
            found = self.split(piece)
            if found is None:
                whole.append((i, self.encode_whole(piece)))
            else:
                words.append((i, [w.encode() for w in found]))
        rest = list(chain.from_iterable(w for _, w in words))
        raw = np.concatenate([self.fold(body), data[ends[more] - 1], np.frombuffer(b"".join(rest), np.uint8)])
        sizes = np.concatenate([np.diff(body_ends, prepend=0), np.ones(len(more), np.int64), np.array(list(map(len, rest)), dtype=np.int64)])
        owner = np.concatenate([at, more, np.repeat(np.array([i for i, _ in words], dtype=np.int64), [len(w) for _, w in words])])
        ranks, offsets = self.encode_words(raw, sizes)
        counts = np.diff(offsets)
        # A stable order by piece puts a mark behind its word.
        order = np.argsort(owner, kind="stable")
        moved, _ = ragged_spans(self.ids[ranks], offsets[:-1][order], offsets[1:][order])
        total = np.bincount(owner, weights=counts, minlength=len(starts)).astype(np.int64)
        if whole:
            parts = np.split(moved, np.cumsum(total)[:-1])
            for i, ids in whole:
                parts[i], total[i] = ids, len(ids)
            moved = np.concatenate(parts).astype(np.uint32)
        return moved, total

    def fold(self, letters: np.ndarray) -> np.ndarray:
        """Latin-1 letters as the vocabulary has them."""
        return letters

    def encode_whole(self, piece: str) -> np.ndarray:
        raise NotImplementedError

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, given as UTF-8 bytes and n + 1 offsets, and each text's end in them."""
        starts, ends = self.pieces_in(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        if self.table.size > 1 << (TABLE_BITS - 1):
            self.table.reset()
        hashes = span_hashes(data, starts, ends)
        entries = self.table.find(hashes)
        new = np.flatnonzero(entries < 0)
        if len(new):
            distinct, first, which = np.unique(hashes[new], return_index=True, return_inverse=True)
            before = self.table.size
            self.table.add(distinct, *self.encode_new(data, starts[new[first]], ends[new[first]]))
            entries[new] = before + which
        ids, piece_ends = self.table.take(entries)
        return ids, np.concatenate([[0], piece_ends])[np.searchsorted(starts, offsets[1:])]

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, one after the other, and each text's end; null texts are empty. Strings of special
        tokens in a text are special tokens."""
        data, offsets = raw_bytes(texts)
        if self.special and (joined := data.tobytes()).find(b"<|") >= 0 and self.special_split.search(joined.decode()):
            # White space at either side of a special token's string is split as at a text's end, so such texts are cut there.
            strings = ["" if t is None else t for t in texts.to_pylist()]
            parts = [self.special_split.split(t) for t in strings]
            flat = pa.array([p for x in parts for p in x], pa.string())
            ids, ends = self.encode_bytes(*raw_bytes(pa.array([None if p in self.special else p for p in flat.to_pylist()], pa.string())))
            own = np.split(ids, ends[:-1])
            for i, p in enumerate(flat.to_pylist()):
                if p in self.special:
                    own[i] = np.array([self.special[p]], np.uint32)
            sizes = [len(x) for x in own]
            last = np.cumsum([len(x) for x in parts])
            return np.concatenate(own), np.concatenate([[0], np.cumsum(sizes)])[last]
        return self.encode_bytes(data, offsets)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_texts(pa.array([text], pa.string()))[0]

    def decode_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All tokens' bytes, and each token's end in them."""
        return ragged_take(self.decode_table, self.decode_offsets, ids)

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids)[0].tobytes().decode("utf-8", "replace")

    def digits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decimal ids, a comma after each, and each one's end."""
        return ragged_take(self.digit_table, self.digit_offsets, ids)


class WordBPE(ByteBPE):
    """A vocabulary with word ends, whose normaliser lowers case and drops white space: words between white space are
    pieces. What its normaliser does beyond Latin-1 is left to the library, word by word."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        with open(path, encoding="utf-8") as file:
            self.pattern = regex.compile(json.load(file)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.path, self.library = path, None

    def pieces_in(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return words_between(data, offsets)[1:]

    def split(self, piece: str) -> list[str] | None:
        # The library splits neither at the separators that Python takes for white space nor inside special tokens.
        if LATIN.fullmatch(piece) and "<|" not in piece:
            return self.pattern.findall(piece.lower())
        return None

    def fold(self, letters: np.ndarray) -> np.ndarray:
        return fold_latin(letters)

    def encode_whole(self, piece: str) -> np.ndarray:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return np.array(self.library.encode(piece, add_special_tokens=False).ids, dtype=np.uint32)

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = raw_bytes(texts)
        # Lower case first makes fewer pieces; strings of special tokens must keep theirs.
        if data.tobytes().find(b"<|") < 0:
            data = fold_latin(data)
        return self.encode_bytes(data, offsets)


@lru_cache(maxsize=4)
def load(path: str) -> ByteBPE:
    """One vocabulary per worker process."""
    with open(path, encoding="utf-8") as file:
        ends = json.load(file)["model"].get("end_of_word_suffix")
    return WordBPE(path) if ends else ByteBPE(path)
