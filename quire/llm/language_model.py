"""Language-model scores: a count baseline over tokens, and logistic mixing of hashed-context bit predictors.

A text is a row of units: white space and the word after it; the last unit is the white space and the
end of the text. A unit is coded as bits: its form (usual white space, case), then its word by a Huffman
code of the frequent training words; a unit that has no such form or word is spelled by a Huffman code
of its bytes. Each bit is predicted from counts after several contexts, hashed with the place in the code.
Those of forms and words are nothing, the last byte and the last three of the unit before, and its whole
word; those of bytes the last two, the last three, all of the unit so far, and that with the word
before. The predictions are mixed in the logistic domain by weights that a gate chooses, and refined by a
table of what came of such predictions. A unit's predictions depend on it and the unit before, so that a
block of texts counts, learns and scores each distinct pair of units once, as often as it occurs.

Counts are those of all training documents. Weights and refinement are learned online, some thousand
bits at a time, over all training documents, too, chunk by chunk, and merged; an occurrence is taken out
of the counts that predict it. Scoring changes nothing, so that a text's score depends on no other
text scored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.exchange import bucket_slices, chunked, pack_counts, pack_keys, parts_of, unpack_counts, unpack_keys
from quire.llm.kernels import U64, LowerSums, blocks, flat, lowered, mix, nonspace, owners, prefix_sums, runs, span_hash
from quire.llm.sampling import remainder
from quire.plans.storage import durable

#: Bytes that UTF-8 never has: the end of a spelled word and the end of a text. Before a unit's first byte stands ``NONE``.
WORD_END, TEXT_END, NONE = 0xFE, 0xFF, 256
#: Contexts; bits of the number of a table's slots, which follows the size of the corpus: one byte a slot and table when scoring, eight when counting.
ORDERS, LEAST_BITS, MOST_BITS = 4, 18, 22
#: Slots of a count table that travel together.
BLOCK = 1 << 15
#: Words that have a code of their own: the most frequent ones of the training texts.
VOCABULARY = 1 << 16
#: Bytes of texts whose pairs of units are put together, symbols that are coded together, and the token of a text's end.
TOGETHER, STEP = 2 << 20, 1 << 16
#: Contexts that few forms and bytes follow, so that each distinct one after them is looked up once a block. Of words so many follow the second that telling them apart takes longer than the look-ups.
NARROW = 2
#: Depths of a code whose slots are neighbours: eight slots, a line of a count table.
NEAR = 3
END_TOKEN = mix(np.array([0xE0F], U64))[0]
#: A slot's state is a level of its zeros and one of its ones: 16 times 16.
LEVELS = np.array([0, 1, 2, 3, 4, 6, 9, 14, 21, 32, 50, 80, 140, 300, 1000, 5000])
#: Forms: white space (none, a space, a newline, two) times case (lower, first letter upper, all upper) times a mark that follows a known word; the end of a text; spelled.
WHITE, CASES, MARKS = (4, 512, 16, 8), (32, 8, 1), {0: 32, ord(","): 8, ord("."): 8, ord(";"): 1, ord(":"): 1, ord("!"): 1, ord("?"): 1}
#: Each mark's number by its byte, and that of white space of one byte.
MARK, AFTER = np.zeros(256, np.int64), np.full(256, -1)
MARK[list(MARKS)], AFTER[[32, 10]] = range(len(MARKS)), (1, 2)
END = len(WHITE) * len(CASES) * len(MARKS)
SPELLED = END + 1
FORM_COUNTS = np.array([*(w * c * m for w in WHITE for c in CASES for m in MARKS.values()), 4096, 32768])
#: Gates: depth in the code times kind, where kinds are those of the byte before, of forms, and of words.
DEPTHS, KINDS, FORM_KIND, WORD_KIND = 8, 6, 4, 5
KIND = np.zeros(257, np.int64)
KIND[[9, 10, 32]] = 1
KIND[33:48] = KIND[58:65] = 2
KIND[128:256] = KIND[NONE] = 3


class Code:
    """A Huffman code of as many symbols as ``counts``."""

    def __init__(self, counts: np.ndarray):
        size = len(counts)
        heap = [(int(c) + 1, s, s) for s, c in enumerate(counts)]
        heapq.heapify(heap)
        children, n = {}, size
        while len(heap) > 1:
            (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            children[n] = (x, y)
            heapq.heappush(heap, (a + b, n, n))
            n += 1
        paths, todo = {}, [(heap[0][2], ())]
        while todo:
            node, path = todo.pop()
            if node < size:
                paths[node] = path
            else:
                todo += [(child, (*path, (node - size, bit))) for bit, child in enumerate(children[node])]
        self.length = np.array([len(paths[s]) for s in range(size)])
        self.depth_rank = (self.length.max() - self.length).astype(np.uint8)
        self.node = np.zeros((size, self.length.max()), np.uint32)
        self.bit = np.zeros((self.length.max(), size), np.uint8)
        for s, path in paths.items():
            for d, (node, bit) in enumerate(path):
                self.node[s, d], self.bit[d, s] = node, bit
        self._places: dict[int, np.ndarray] = {}

    def places(self, bits: int) -> np.ndarray:
        """For each depth and symbol, what turns a context's slot into that of the place in the code, twice, and the bit there.

        ``NEAR`` depths from one node on are neighbours, so that the later ones find their slots in the cache.
        """
        if bits not in self._places:
            out = np.empty(self.bit.shape, np.intp)
            for top in range(0, len(out), NEAR):
                x = (self.node[:, top] + np.uint32(1)) * np.uint32(0x9E3779B1)
                x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - bits) & ~np.uint32((1 << NEAR) - 1)
                path = np.ones(len(x), np.uint32)  # a heap's numbers of the nodes below
                for d in range(top, min(top + NEAR, len(out))):
                    out[d] = (x | path) << np.uint32(1) | self.bit[d]
                    path = path << np.uint32(1) | self.bit[d]
            self._places[bits] = out
        return self._places[bits]


def units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts with an end each, cut into units: (bytes, unit starts, word starts, unit ends, the n+1 offsets of each text's units)."""
    n = len(off) - 1
    own = off + np.arange(n + 1)
    last = own[1:] - 1
    inside = np.ones(len(data) + n, bool)
    inside[last] = False
    out = np.full(len(inside), TEXT_END, np.uint8)
    out[inside] = data
    starts, ends, _ = runs(nonspace(out) & (out != TEXT_END), own)
    at = np.searchsorted(starts, last)
    starts, ends = np.insert(starts, at, last), np.insert(ends, at, last + 1)
    begins = np.empty_like(starts)
    begins[1:] = ends[:-1]
    begins[:1] = 0
    return out, begins, starts, ends, np.searchsorted(starts, own)


def _together(off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``TOGETHER`` bytes, of even sizes."""
    total = int(off[-1])
    cuts = np.searchsorted(off, np.linspace(0, total, max(1, round(total / TOGETHER)) + 1)[1:-1])
    edges = np.unique(np.concatenate([np.zeros(1, np.int64), cuts, np.array([len(off) - 1])]))
    yield from zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def _hash(x: np.ndarray, salt: int) -> np.ndarray:
    """The upper half of a product, which spreads small numbers and keeps hashes spread."""
    return (((x ^ (x >> U64(32))) + U64(salt << 40)) * U64(0x9E3779B97F4A7C15) >> U64(32)).astype(np.uint32)


def _numbered(keys: np.ndarray) -> np.ndarray:
    """Numbers of values as they come, by a hash table that need not grow."""
    return pd.factorize(keys, size_hint=len(keys))[0]


def _firsts(numbers: np.ndarray) -> np.ndarray:
    """First places of values that are numbered as they come."""
    return np.flatnonzero(np.diff(np.maximum.accumulate(numbers), prepend=-1) > 0)


class Units:
    """The units of a block of texts: ``own`` are the n+1 offsets of the texts in them."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.begins, self.starts, self.ends, self.own = units(data, off)
        sums = prefix_sums(self.data)
        self.whole = span_hash(sums, self.begins, self.ends)
        self.low = LowerSums(self.data, sums)
        self.word = self.low.span_hash(self.starts, self.ends)
        self.first = np.zeros(len(self.starts), bool)
        self.first[self.own[:-1]] = True

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs of a unit and the one before, as first places in order, and each unit's pair."""
        before = np.zeros_like(self.whole)
        before[1:] = self.whole[:-1]
        before[self.first] = 0
        pair = _numbered(mix(self.whole ^ mix(before + U64(1))))
        return _firsts(pair), pair

    def forms(self, at: np.ndarray) -> np.ndarray:
        begins, starts, ends = self.begins[at], self.starts[at], self.ends[at]
        white = starts - begins
        one = self.data[np.maximum(starts - 1, 0)]
        space = np.where(white == 1, AFTER[one], np.where(white == 0, 0, -1))
        two = np.flatnonzero((white == 2) & (one == 10))
        space[two[self.data[starts[two] - 2] == 10]] = 3
        upper = self.low.n_upper
        low = upper[starts]
        n_upper = upper[ends] - low
        case, some = np.zeros(len(at), np.int64), np.flatnonzero(n_upper)
        n, size = n_upper[some], (ends - starts)[some]
        case[some] = np.where((n == 1) & (upper[starts[some] + 1] > low[some]), 1, np.where(n == size, 2, -1))
        form = np.where((space < 0) | (case < 0), SPELLED, (space * len(CASES) + case) * len(MARKS))
        last = self.data[starts] == TEXT_END
        return np.where(last, np.where(white == 0, END, SPELLED), form)

    def before(self, at: np.ndarray) -> list[np.ndarray]:
        """What stands before units: nothing, a byte, three bytes, a word."""
        i, none = np.maximum(at - 1, 0), self.first[at]
        ends, size = self.ends[i], self.ends[i] - self.begins[i]
        b = [np.where(none | (size < k), 0, self.data[ends - np.minimum(k, size)].astype(np.int64) + 1).astype(U64) for k in (1, 2, 3)]
        return [np.zeros(len(at), U64), b[0], b[0] | b[1] << U64(9) | b[2] << U64(18), np.where(none, U64(0), self.word[i] | U64(1))]


class Coded:
    """Some symbols with long codes first, so that those that go on to a depth are the first ones: a depth is a slice."""

    def __init__(self, code: Code, bits: int, sym: np.ndarray, ctx: list[np.ndarray], kind: np.ndarray | int):
        self.code, self.order = code, np.argsort(code.depth_rank[sym], kind="stable")
        self.sym, self.kind = sym[self.order], kind if isinstance(kind, int) else kind[self.order]
        self.ctx = [(c.take(self.order) >> np.uint32(32 - bits) << np.uint32(1)).astype(np.intp) for c in ctx]
        self.bits = bits
        self.going = np.cumsum(np.bincount(code.length[sym], minlength=len(code.bit) + 1)[::-1])[::-1]

    def depths(self) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray]]]:
        """(depth, symbols that have it, their bits, their slots of all orders: twice these, and the bit)"""
        for d in range(len(self.code.bit)):
            m = int(self.going[d + 1])
            if not m:
                return
            place = self.code.places(self.bits)[d].take(self.sym[:m])
            yield d, m, place & 1, [c[:m] ^ place for c in self.ctx]


class Part:
    """The symbols of one code in a block of units, ``own`` their places among the units.

    ``narrow`` has each distinct symbol after the first ``NARROW`` contexts once, of words after the first context, which
    is one for all; ``near`` is which of these each symbol is.
    """

    def __init__(self, code: Code, bits: int, own: np.ndarray, sym: np.ndarray, ctx: list[np.ndarray], kind: np.ndarray | int):
        self.code, self.bits, self.own, self.sym, self.kind = code, bits, own, sym, kind
        if isinstance(kind, int) and kind == WORD_KIND:
            found = np.flatnonzero(np.bincount(sym))
            self.narrow = Coded(code, bits, found, [np.full(len(found), ctx[0][0])], kind)
            rank = np.empty(len(code.length), np.intp)
            rank[self.narrow.sym] = np.arange(len(found))
            self.ctx, self.near = ctx[1:], rank[sym]
            return
        key = mix(ctx[0].astype(U64) << U64(32) | ctx[1].astype(U64)) + (sym.astype(U64) << U64(8) | (U64(kind) if isinstance(kind, int) else kind.astype(U64)))
        at = _numbered(key)
        first = _firsts(at)
        self.narrow = Coded(code, bits, sym[first], [x[first] for x in ctx[:NARROW]], kind if isinstance(kind, int) else kind[first])
        rank = np.empty(len(first), np.intp)
        rank[self.narrow.order] = np.arange(len(first))
        self.ctx, self.near = ctx[NARROW:], rank[at]

    def steps(self) -> Iterator[tuple[np.ndarray, np.ndarray, Coded]]:
        """``STEP`` symbols at a time with their further contexts, after their places among the units and in ``narrow``."""
        for i in range(0, len(self.sym), STEP):
            s = slice(i, i + STEP)
            c = Coded(self.code, self.bits, self.sym[s], [x[s] for x in self.ctx], self.kind if isinstance(self.kind, int) else self.kind[s])
            yield self.own[s][c.order], self.near[s][c.order], c


class Coder:
    """Turns units into symbols of three codes: of forms, of frequent words (sorted hashes ``known``), and of bytes."""

    def __init__(self, byte_counts: np.ndarray, known: np.ndarray, known_counts: np.ndarray, bits: int):
        self.form, self.byte, self.bits = Code(FORM_COUNTS), Code(byte_counts), bits
        self.known, self.word = pd.Index(known), Code(known_counts) if len(known) > 1 else None

    def symbols(self, u: Units, at: np.ndarray) -> Iterator[tuple[np.ndarray, Code, np.ndarray, list[np.ndarray], np.ndarray | int]]:
        """(place in ``at``, code, symbols, contexts, kinds or the one kind) of the units ``at``."""
        form, before = u.forms(at), u.before(at)
        if self.word is None:
            form = np.where(form < END, SPELLED, form)
        else:
            word, found = self._known(u.word[at])
            ends = u.ends[at]
            mark = MARK[u.data[ends - 1]]
            mark[found | (ends - u.starts[at] == 1)] = 0
            rest = np.flatnonzero(mark)
            word[rest], found[rest] = self._known(u.low.span_hash(u.starts[at[rest]], ends[rest] - 1))
            form = np.where((form < END) & ~found, SPELLED, np.where(form < END, form + mark, form))
        every = np.arange(len(at))
        yield every, self.form, form, [_hash(x, 8 + k) for k, x in enumerate(before)], FORM_KIND
        coded = np.flatnonzero(form < END)
        if len(coded):
            yield coded, self.word, word[coded], [_hash(x[coded], 16 + k) for k, x in enumerate(before)], WORD_KIND
        spelled = np.flatnonzero(form == SPELLED)
        if len(spelled):
            own, sym, begins = self._spell(u, at[spelled])
            yield spelled[own], self.byte, sym, *self._byte_contexts(sym, begins, mix(before[3][spelled])[own])

    def _known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        word = self.known.get_indexer(h)
        return word, word >= 0

    @staticmethod
    def _spell(u: Units, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of units, with the mark of an end after words: their unit, themselves, and where their unit begins."""
        marked = u.data[u.starts[at]] != TEXT_END
        size = u.ends[at] - u.begins[at] + marked
        off = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        own = np.repeat(np.arange(len(at)), size)
        place = np.arange(off[-1]) - off[own]
        sym = u.data[np.minimum(u.begins[at][own] + place, len(u.data) - 1)].astype(np.int64)
        sym[off[1:][marked] - 1] = WORD_END
        return own, sym, off[:-1][own]

    @staticmethod
    def _byte_contexts(sym: np.ndarray, begins: np.ndarray, before: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        n, place, last = len(sym), (np.arange(len(sym)) - begins).astype(np.int32), []
        for k in range(1, 4):
            x = np.full(n, NONE, U64)
            x[k:] = sym[:-k] if k < n else sym[:0]
            x[place < k] = NONE
            last.append(x)
        two = last[0] | last[1] << U64(9)
        out = [_hash(two, 24), _hash(two | last[2] << U64(18), 25)]
        so_far = span_hash(prefix_sums(sym), begins, np.arange(n))
        return [*out, _hash(so_far, 26), _hash(so_far ^ before, 27)], KIND[last[0].astype(np.intp)]

    def parts(self, u: Units, at: np.ndarray) -> Iterator[Part]:
        """The symbols of the units ``at``, code by code."""
        for own, code, sym, ctx, kind in self.symbols(u, at):
            yield Part(code, self.bits, own, sym, ctx, kind)


def slot_bits(n_bytes: int) -> int:
    """A slot for about 64 bytes of training texts, within bounds that memory sets."""
    return min(MOST_BITS, max(LEAST_BITS, (n_bytes // 64).bit_length()))


def states(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The nearest levels of counts, by ratio, as one byte."""
    edges = np.sqrt((LEVELS[1:] + 0.4) * (LEVELS[:-1] + 0.4)) - 0.4
    return (np.searchsorted(edges, zeros) * 16 + np.searchsorted(edges, ones)).astype(np.uint8)


def _odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + 0.4) / (zeros + 0.4))


_ZEROS, _ONES = LEVELS[np.arange(256) // 16], LEVELS[np.arange(256) % 16]
#: The log odds of a state, and those without one zero and without one one.
STATE_ODDS = _odds(_ZEROS, _ONES).astype(np.float32)
WITHOUT = np.stack([_odds(np.maximum(_ZEROS - 1, 0), _ONES), _odds(_ZEROS, np.maximum(_ONES - 1, 0))]).astype(np.float32)
#: The same of two states at once, as real and imaginary part: a look-up of eight bytes takes no longer than one of four. By bit, second state, first state.
BOTH_WITHOUT = (WITHOUT[:, None, :] + np.complex64(1j) * WITHOUT[:, :, None]).astype(np.complex64).ravel()


#: Log odds are looked up in steps of 1 / ``FINE`` from -``FAR`` to ``FAR``: the same step for both bits, so that their probabilities add up to one.
FINE, FAR = 64, 16
GRID = np.arange(-FAR * FINE, FAR * FINE + 1) / FINE
LOGISTIC = (1 / (1 + np.exp(-GRID))).astype(np.float32)
#: What a bit's probability falls short of the bit: all places for a zero, then for a one.
ERROR = np.concatenate([-LOGISTIC, 1 - LOGISTIC])
#: First places of the cells of the refinement, half a unit of log odds each.
CELL = np.rint(np.clip(GRID, -8, 8) * 2 + 16).astype(np.intp)
CELL_STARTS = _firsts(CELL)


def _on_grid(z: np.ndarray) -> np.ndarray:
    """Places of log odds (float32, which is used up) on the grid."""
    np.clip(z, -FAR, FAR, out=z)
    z *= FINE
    z += FAR * FINE + 0.5
    return z.astype(np.intp)


def _byte_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of training texts with ends of words and texts (0 to 255), and bytes of all texts (256)."""
    total = np.zeros(257, np.int64)
    for batch in batches:
        data, off = flat(batch.column("text"))
        learn = np.array(batch.column("learn").to_pylist(), bool)
        own = np.repeat(learn, np.diff(off))
        total[:256] += np.bincount(data[own], minlength=256)
        total[TEXT_END] += learn.sum()
        total[WORD_END] = total[32] + total[10]
        total[256] += len(data)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(257), pa.int32()), pa.array(total)], names=["symbol", "n"])


def _context_counts(coder: Coder):
    """Counts of zeros and ones in all slots over a task's training texts, in packed blocks."""

    def add(counts: list[np.ndarray], c: Coded, many: np.ndarray) -> None:
        for _, m, _, slots in c.depths():
            for k in range(len(slots)):
                np.add.at(counts[k], slots[k], many[:m])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(2 << coder.bits, np.uint32) for _ in range(ORDERS)]
        for batch in batches:
            data, off = flat(batch.column("text"))
            for a, b in _together(off):
                u = Units(data[off[a] : off[b]], off[a : b + 1] - off[a])
                first, pair = u.pairs()
                each = np.bincount(pair).astype(np.uint32)
                for part in coder.parts(u, first):
                    add(counts[: len(part.narrow.ctx)], part.narrow, np.bincount(part.near, each[part.own], minlength=len(part.narrow.sym)).astype(np.uint32))
                    for own, _, c in part.steps():
                        add(counts[-len(c.ctx) :], c, each[own])
        for k in range(ORDERS):
            for i in range(0, 1 << coder.bits, BLOCK):
                part = counts[k][2 * i : 2 * (i + BLOCK)]
                used = part != 0
                if used.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([i // BLOCK], pa.int32()), pa.array([pack_counts(np.packbits(used))], pa.binary()), pa.array([pack_counts(part[used])], pa.binary())], names=["k", "block", "used", "n"])

    return run


def _merge_counts(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states of one block's slots, from the counts of all tasks, added up one by one."""
    total = np.zeros(2 * BLOCK, np.int64)
    for batch in batches:
        for used, n in zip(batch.column("used"), batch.column("n"), strict=True):
            total[np.unpackbits(unpack_counts(used.as_py(), np.uint8)).view(bool)] += unpack_counts(n.as_py(), np.uint32)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([pack_counts(states(total[::2], total[1::2]))], pa.binary())], names=["k", "block", "states"])


class MixingModel:
    """Tables of states, mixing weights by gate, and the refinement of log odds."""

    BINS = 33

    def __init__(self, coder: Coder, tables: list[np.ndarray]):
        self.coder, self.tables = coder, tables
        self.weights = np.full((DEPTHS * KINDS, ORDERS), 0.4)
        self.refined = np.tile(np.linspace(-8, 8, self.BINS), KINDS * 4)

    def learn(self, blocks_of_units: Iterator[Units], rate: float = 0.005) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Online: each few thousand bits are predicted with the weights learned of those before them, and without their own counts.

        Returns the mean of the weights over all bits, the bits that each gate has seen, and zeros and ones in the cells of the refinement.
        """
        w, power = self.weights.copy(), np.full(self.weights.shape, 1e-6)
        total, seen, size = np.zeros(w.shape), np.zeros(len(w)), len(GRID)
        places = np.zeros((4, KINDS * 2 * size))
        for u in blocks_of_units:
            first, pair = u.pairs()
            each = np.bincount(pair).astype(np.float32)
            for narrow, own, near, c in self._learned_from(u, first):
                every, one = each[own], isinstance(c.kind, int)
                if not one:
                    kinds = np.unique(c.kind).tolist()
                    of = [(c.kind == q).astype(np.float32) for q in kinds]
                    kind_at = c.kind * (2 * size)
                for d, m, bit, slots in c.depths():
                    many, low = every[:m], min(d, DEPTHS - 1) * KINDS
                    odds = narrow[d].take(near[:m]), *self._odds_without(bit, slots, ORDERS - len(slots))
                    x = [y for p in odds for y in ((p.real, p.imag) if p.dtype == np.complex64 else (p,))]
                    if one:
                        v = w[low + c.kind].astype(np.float32)
                    else:
                        v = w[low : low + KINDS].astype(np.float32).view(np.complex128).ravel().take(c.kind[:m]).view(np.float32).reshape(m, ORDERS).T
                    z = v[0] * x[0]
                    for k in range(1, ORDERS):
                        z += v[k] * x[k]
                    at = _on_grid(z)
                    bit *= size
                    at += bit
                    error = ERROR.take(at)
                    error *= many
                    if one:
                        gates, n, g = slice(low + c.kind, low + c.kind + 1), np.array([many.sum()]), np.array([[error @ y for y in x]])
                        places[min(d, 3), c.kind * 2 * size : (c.kind + 1) * 2 * size] += np.bincount(at, many, minlength=2 * size)
                    else:
                        gates, n, g = slice(low, low + KINDS), np.zeros(KINDS), np.zeros((KINDS, ORDERS))
                        for q, mask in zip(kinds, of, strict=True):
                            n[q], mine = mask[:m] @ many, mask[:m] * error
                            g[q] = [mine @ y for y in x]
                        at += kind_at[:m]
                        places[min(d, 3)] += np.bincount(at, many, minlength=KINDS * 2 * size)
                    g = g / np.maximum(n, 1)[:, None]
                    power[gates] = np.where(n[:, None] > 0, 0.95 * power[gates] + 0.05 * g**2, power[gates])
                    w[gates] += rate * g / (np.sqrt(power[gates]) + 1e-3)
                    total[gates] += w[gates] * n[:, None]
                    seen[gates] += n
        cells = np.add.reduceat(places.reshape(4, KINDS, 2, size), CELL_STARTS, 3)
        return np.where(seen[:, None] > 0, total / np.maximum(seen, 1)[:, None], w), seen, cells.transpose(2, 1, 0, 3).reshape(2, -1)

    def _learned_from(self, u: Units, first: np.ndarray) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, Coded]]:
        for part in self.coder.parts(u, first):
            narrow = [self._odds_without(bit, slots, 0)[0] for _, _, bit, slots in part.narrow.depths()]
            for step in part.steps():
                yield narrow, *step

    def _odds_without(self, bit: np.ndarray, slots: list[np.ndarray], order: int) -> list[np.ndarray]:
        """Log odds by the contexts from ``order`` on, without the bits themselves: of one context, if their number is odd, then of two each as real and imaginary part."""
        states = [self.tables[order + k].take(x >> 1) for k, x in enumerate(slots)]
        out = [WITHOUT.ravel().take((bit << 8) + states[0])] if len(states) % 2 else []
        for one, two in zip(states[len(out) :: 2], states[len(out) + 1 :: 2], strict=True):
            at = bit << 16
            at |= two.astype(np.uint16) << np.uint16(8) | one
            out.append(BOTH_WITHOUT.take(at))
        return out

    def adopt(self, weights: np.ndarray, seen: np.ndarray, cells: np.ndarray) -> None:
        """``weights``: sums over chunks of weights by bits seen. Gates and cells without evidence stay as they are."""
        self.weights = np.where(seen[:, None] > 0, weights / np.maximum(seen, 1)[:, None], self.weights)
        start = 1 / (1 + np.exp(-self.refined))  # counts as two bits
        self.refined = _odds(cells[0] + 2 * (1 - start) - 0.4, cells[1] + 2 * start - 0.4)

    def mixed(self) -> np.ndarray:
        """What each state adds to the mix: (depth, order, kind * 256 + state)."""
        return (self.weights.reshape(DEPTHS, KINDS, ORDERS).transpose(0, 2, 1)[:, :, :, None] * STATE_ODDS).reshape(DEPTHS, ORDERS, KINDS * 256).astype(np.float32)

    def log10_of(self, u: Units, chosen: np.ndarray) -> np.ndarray:
        """The log10 probability of each chosen unit after the one before it."""
        total, mixed, costs = np.zeros(len(chosen)), self.mixed(), self.costs()
        for part in self.coder.parts(u, chosen):
            for own, logs in self._logs_of(part, mixed, costs):
                total += np.bincount(own, logs, minlength=len(chosen))
        return total / np.log(10)

    def costs(self) -> np.ndarray:
        """What each bit costs at each place of the grid, refinement included: (kind * 4 + depth up to 3, bit, place), flat."""
        z = (GRID + self.refined.reshape(KINDS * 4, self.BINS)[:, CELL]) / 2
        z = np.stack([z, -z], 1)
        return (np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))).ravel()

    def _logs_of(self, part: Part, mixed: np.ndarray, costs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places among the units and log probabilities of the symbols of a part, step by step."""
        narrow = [self._mix(d, part.narrow.kind, slots, mixed, 0, np.zeros(m, np.float32)) for d, m, _, slots in part.narrow.depths()]
        for own, near, c in part.steps():
            yield own, self._logs(c, near, narrow, mixed, costs)

    def _mix(self, d: int, kind: np.ndarray | int, slots: list[np.ndarray], mixed: np.ndarray, order: int, z: np.ndarray) -> np.ndarray:
        """Adds to ``z`` what the contexts from ``order`` on say."""
        low = kind * 256 if isinstance(kind, int) else kind[: len(z)] * 256
        for k, x in enumerate(slots, order):
            adds, state = mixed[min(d, DEPTHS - 1), k], self.tables[k].take(x >> 1)
            z += adds[low : low + 256].take(state) if isinstance(low, int) else adds.take(low + state)
        return z

    def _logs(self, c: Coded, near: np.ndarray, narrow: list[np.ndarray], mixed: np.ndarray, costs: np.ndarray) -> np.ndarray:
        one, sums, size = isinstance(c.kind, int), np.zeros(len(c.sym)), len(GRID)
        for d, m, bit, slots in c.depths():
            at = _on_grid(self._mix(d, c.kind, slots, mixed, ORDERS - len(slots), narrow[d].take(near[:m])))
            bit *= size
            at += bit
            if one:
                low = (c.kind * 4 + min(d, 3)) * 2 * size
                sums[:m] -= costs[low : low + 2 * size].take(at)
            else:
                at += (c.kind[:m] * 4 + min(d, 3)) * (2 * size)
                sums[:m] -= costs.take(at)
        return sums

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The log10 probability of each text with its end."""
        return self.score_and_tokens(data, off)[0]

    def score_and_tokens(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The log10 probability of each text with its end; ``_chunk_tokens``, which are the words of the units."""
        out, tokens, word_off = np.zeros(len(off) - 1), [np.zeros(0, U64)], np.zeros(len(off), np.int64)
        for a, b in _together(off):
            u = Units(data[off[a] : off[b]], off[a : b + 1] - off[a])
            first, pair = u.pairs()
            out[a:b] = np.bincount(owners(u.own), self.log10_of(u, first)[pair], minlength=b - a)
            tokens.append(np.delete(u.word, u.own[1:] - 1))
            word_off[a + 1 : b + 1] = word_off[a] + u.own[1:] - np.arange(1, b - a + 1)
        return out, np.concatenate(tokens), word_off


#: Sums of weights and bits travel as whole numbers of this part, so that their order does not matter.
PART = 2.0**-16


def _learn(model: MixingModel):
    """What a chunk's training texts teach: (name, place, sum) rows."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        data, off = flat(table.column("text"))
        w, seen, cells = model.learn(Units(data[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in _together(off))
        sums = np.concatenate([(w * seen[:, None]).ravel(), seen, cells.ravel()])
        at = np.flatnonzero(sums)
        return pa.table({"place": pa.array(at, pa.int32()), "sum": pa.array(np.rint(sums[at] / PART).astype(np.int64))})

    return run


def train_model(parts: DataFrame, coder: Coder) -> MixingModel:
    """Counts, weights and refinement from all texts of the chunks ``parts``."""
    counted = parts.select("text").mapInArrow(_context_counts(coder), "k int, block int, used binary, n binary")
    merged = counted.groupBy("k", "block").applyInArrow(_merge_counts, "k int, block int, states binary").toArrow()  # at most ORDERS << MOST_BITS bytes
    tables = [np.zeros(1 << coder.bits, np.uint8) for _ in range(ORDERS)]
    for k, i, x in zip(*(merged.column(c).to_pylist() for c in ("k", "block", "states")), strict=True):
        tables[k][i * BLOCK : (i + 1) * BLOCK] = unpack_counts(x, np.uint8)
    model = MixingModel(coder, tables)
    learned = parts.groupBy("chunk").applyInArrow(_learn(model), "place int, sum long").groupBy("place").agg(F.sum("sum").alias("sum")).toArrow()  # under 2,000 rows
    sums = np.zeros(model.weights.size + len(model.weights) + 2 * len(model.refined))
    sums[learned.column("place").to_numpy()] = learned.column("sum").to_numpy() * PART
    w, seen, cells = np.split(sums, [model.weights.size, model.weights.size + len(model.weights)])
    model.adopt(w.reshape(model.weights.shape), seen, cells.reshape(2, -1))
    return model


def _tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of texts and their offsets, without the ends."""
    low = lowered(data)
    starts, ends, word_off = runs(nonspace(low), off)
    return span_hash(prefix_sums(low), starts, ends), word_off


def _chunk_tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a whole chunk, hashed in blocks."""
    parts, offs = [], [np.zeros(1, np.int64)]
    for a, b in blocks(off):
        h, w = _tokens(data[off[a] : off[b]], off[a : b + 1] - off[a])
        parts.append(h)
        offs.append(w[1:] + offs[-1][-1])
    return np.concatenate(parts) if parts else np.zeros(0, U64), np.concatenate(offs)


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted distinct tokens with the end, each token's place in them, and that of the end."""
    at, keys = pd.factorize(np.append(h, END_TOKEN))
    order = np.argsort(keys)
    rank = np.empty(len(keys), np.intp)
    rank[order] = np.arange(len(keys))
    at = rank[at]
    return keys[order], at[:-1], int(at[-1])


def _count_tokens(buckets: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        h, off = _chunk_tokens(*flat(table.column("text")))
        learn = np.array(table.column("learn").to_pylist(), bool)
        keys, at, end = _distinct(h)
        counts = np.bincount(at, np.repeat(learn, np.diff(off)), minlength=len(keys)).astype(np.uint32)
        counts[end] += np.uint32(learn.sum())
        rows = [(b, key[0].as_py(), pack_keys(keys[s]), pack_counts(counts[s])) for b, s in bucket_slices(keys, buckets)]
        return pa.table(dict(zip(("bucket", "chunk", "keys", "counts"), (pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)), strict=True)))

    return run


def _sum_tokens(frequent: int):
    """Answers each run with the counts over all; one more row, of no chunk, has the bucket's totals and its tokens of so many occurrences."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _bucket_sums(key, table, frequent)

    return run


def _bucket_sums(key: tuple[pa.Scalar, ...], table: pa.Table, frequent: int) -> pa.Table:
    runs = [unpack_keys(x.as_py()) for x in table.column("keys")]
    counts = [unpack_counts(x.as_py(), np.uint32) for x in table.column("counts")]
    every, at = np.unique(np.concatenate(runs), return_inverse=True)
    total = np.bincount(at, np.concatenate(counts)).astype(np.uint64)
    cuts = np.cumsum([len(r) for r in runs])[:-1]
    answers = [pack_counts(total[x]) for x in np.split(at, cuts)]
    n, many = len(runs), total >= frequent
    return pa.table({
        "keys": pa.array([None] * n + [pack_keys(every[many])], pa.binary()), "many": pa.array([None] * n + [pack_counts(total[many])], pa.binary()),
        "bucket": pa.array([key[0].as_py()] * (n + 1), pa.int64()), "chunk": pa.array([*table.column("chunk").to_pylist(), None], pa.int64()), "counts": pa.array([*answers, None], pa.binary()),
        "tokens": pa.array([0] * n + [int(total.sum())], pa.int64()), "distinct": pa.array([0] * n + [int((total > 0).sum())], pa.int64()),
    })


def _score(model: MixingModel):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
        data, off = flat(docs.column("text"))
        score, h, word_off = model.score_and_tokens(data, off)
        keys, at, end = _distinct(h)
        order = np.argsort(answers.column("bucket").to_numpy(), kind="stable")
        got = answers.column("counts").take(pa.array(order))
        c = np.concatenate([unpack_counts(x.as_py(), np.uint64) for x in got]) if len(got) else np.zeros(len(keys), np.uint64)
        n = len(off) - 1
        own, mine = owners(word_off), c[at]
        end = int(c[end])
        return pa.table({
            "doc_id": docs.column("doc_id"), "learn": docs.column("learn"), "n_tokens": pa.array(np.diff(word_off) + 1), "n_known": pa.array(np.bincount(own, mine > 0, minlength=n).astype(np.int64) + (end > 0)),
            "logs": pa.array(np.bincount(own, np.log10(mine + 0.5), minlength=n) + np.log10(end + 0.5)), "score": pa.array(score), "bits_per_byte": pa.array(-score / np.log10(2) / (np.diff(off) + 1)),
        })

    return run


def _vocabulary(sums: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words: sorted hashes and counts."""
    got = sums.where("chunk is null").select("bucket", "keys", "many").orderBy("bucket").toArrow()
    keys = np.concatenate([np.zeros(0, U64), *(unpack_keys(x.as_py()) for x in got.column("keys"))])
    many = np.concatenate([np.zeros(0, U64), *(unpack_counts(x.as_py(), U64) for x in got.column("many"))])
    word = keys != END_TOKEN
    keys, many = keys[word], many[word]
    best = np.sort(np.lexsort((keys, ~many))[:VOCABULARY])
    order = best[np.argsort(keys[best])]
    return keys[order], many[order]


def score_texts(docs: DataFrame, learn) -> DataFrame:
    """Scores of all whole texts by what the rows with ``learn`` (a boolean Column, not null) teach.

    Tokens are words between white space, A-Z lower-cased, and one end a text. ``base_score`` is the sum
    of log10((c+0.5)/(N+0.5*(V+1))) over a text's tokens; ``score`` is the mixing model's log10
    probability of the text, end included, and ``bits_per_byte`` the same by the bytes of the text and its
    end. Null texts are empty: one token, the end. Repeated rows are learned and scored as often as they
    occur; other columns are dropped; without training rows N and V are 0, and the model says what it
    started with. Returns doc_id, learn, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.
    """
    rows = docs.select("doc_id", "text", learn.alias("learn"))
    seen = {r["symbol"]: r["n"] for r in rows.select("text", "learn").mapInArrow(_byte_counts, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect()}
    n_bytes = sum(n for s, n in seen.items() if s < 256)
    chunks, buckets = parts_of(seen.get(256, 0))
    parts = chunked(rows, chunks, "learn")
    runs = parts.groupBy("chunk").applyInArrow(_count_tokens(buckets), "bucket long, chunk long, keys binary, counts binary")
    frequent = max(2, n_bytes >> 22)  # so at most 2**21 tokens reach the driver
    sums = durable(runs.groupBy("bucket").applyInArrow(_sum_tokens(frequent), "keys binary, many binary, bucket long, chunk long, counts binary, tokens long, distinct long"), "lm-counts")
    n, v = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    model = train_model(parts.where("learn"), Coder(np.array([seen.get(s, 0) for s in range(256)]), *_vocabulary(sums), slot_bits(n_bytes)))
    kind = dict(docs.dtypes)["doc_id"]
    scored = parts.groupBy("chunk").cogroup(sums.where("chunk is not null").select("chunk", "bucket", "counts").groupBy("chunk")).applyInArrow(
        _score(model), f"doc_id {kind}, learn boolean, n_tokens long, n_known long, logs double, score double, bits_per_byte double"
    )
    each = float(np.log10(n + 0.5 * (v + 1)))
    return scored.select("doc_id", "learn", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * each).alias("base_score"), "score", "bits_per_byte")


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``score_texts``: null and empty texts are one token, the end; repeated rows score alike; rows of null doc_id are learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(remainder("doc_id", 5) == 1, F.lit(False))
    out = score_texts(docs, ~held_out)
    return out.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
