"""Range coding of token ids in independent blocks, many blocks in step.

Each block starts from empty tables and is coded alone. What drives the coder:

order 2 and 1: tables of the id that last followed the last two ids, or the last one, each
with how often it was right in a row. Both runs, and whether the two agree, say how likely
each is to be right now.
order 0: how often ids come that neither foresaw.

An id is coded as "the order-2 prediction", "the order-1 prediction" or "neither", then in the
last case by its order-0 frequency, both in one step of the coder; ids too rare for a frequency
of their own follow evenly. Tables are learned from the ids before, block by block. The chances
are counted once for the blocks of a call, and a reader needs them (Chances.packed). All arithmetic
is of integers, but for a quotient that doubles give exactly, so every machine decodes what
another wrote.

The blocks of a call are coded in lockstep by numpy: one step codes the next id of each, in
some 40 array operations. Most are of 32 bits and go through all blocks without picking any, as
picked places cost several times as much; what a step looks up lies side by side in one word.
The range coder works in 64 bits and puts out 32-bit words; carries are added up when a block ends.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

from wayfold.llm import _arrays

#: Ids in a block, and blocks coded in step: many, as what numpy's calls cost is shared by them.
BLOCK = 2048
LANES = 4096

U = np.uint64
_SLOTS = 1 << 9
#: Bits of the total frequency of what was right, and of order 0.
_FIRST, _ORDER0 = 12, 16
_BITS = _FIRST + _ORDER0
#: Ids with an order-0 frequency of their own, at most.
_OWN = 1 << 14
_WORD, _LOW = U(1 << 32), U((1 << 32) - 1)
_32 = U(32)
#: A run of 0: never met; then 1 more than it was right in a row, 7 at most.
_RUN, _ONE, _MOST = np.uint32(24), np.uint32(1 << 24), np.uint32(6)
_ID = np.uint32((1 << 24) - 1)
#: A half of a word, what is in the lower one, and a whole order 0: from 0 on, of 2**_ORDER0 (less 1, as in Chances.place).
_HALF, _LOWER, _ALL = np.uint32(16), np.uint32((1 << 16) - 1), np.uint32((1 << _ORDER0) - 1)
#: Chance that a prediction of each run is right, where nothing was counted.
_CHANCE = np.array([0.001, 0.3, 0.5, 0.65, 0.75, 0.82, 0.88, 0.92])


class Writer:
    """The range coder of some blocks. A symbol's place is cum and freq of 2**bits."""

    def __init__(self, lanes: int, room: int):
        self.lanes, self.low, self.range = lanes, np.zeros(lanes, U), np.full(lanes, ~U(0))
        self.out, self.at = np.zeros(room * lanes, U), np.zeros(lanes, np.int64)

    def narrow(self, ix: np.ndarray | None, low: np.ndarray, size: np.ndarray, cum: np.ndarray, freq: np.ndarray, bits) -> np.ndarray:
        """Moves low (of lanes ix, of the first ones if None) in place and returns the new range."""
        unit = size >> bits
        add = cum * unit
        low += add
        over = np.flatnonzero(low < add)
        if len(over):  # a carry goes into the last word
            over = over if ix is None else ix[over]
            self.out[(self.at[over] - 1) * self.lanes + over] += U(1)
        return freq * unit

    def settle(self, ix: np.ndarray | None, low: np.ndarray, size: np.ndarray) -> None:
        go = np.flatnonzero(size < _WORD)
        if len(go):
            lane, l = go if ix is None else ix[go], low[go]
            at = self.at[lane]
            self.out[at * self.lanes + lane] = l >> _32
            self.at[lane] = at + 1
            low[go] = l << _32
            size[go] <<= _32

    def blocks(self) -> list[bytes]:
        lane = np.arange(self.lanes)
        for word in (self.low >> _32, self.low & _LOW):
            self.out[self.at * self.lanes + lane] = word
            self.at += 1
        out = self.out.reshape(-1, self.lanes)[: int(self.at.max())]
        for i in range(len(out) - 1, 0, -1):
            out[i - 1] += out[i] >> _32
            out[i] &= _LOW
        whole = np.ascontiguousarray(out.T.astype(">u4"))
        return [row[:n].tobytes() for row, n in zip(whole, self.at.tolist(), strict=True)]


class Reader:
    """The range coder of some blocks that start at these words; its low is the code less what was taken from it."""

    def __init__(self, words: np.ndarray, start: np.ndarray):
        self.words, self.at = np.append(words, np.zeros(2, np.uint32)), start + 2
        self.low = self._next(start) << _32 | self._next(start + 1)
        self.range = np.full(len(start), ~U(0))

    def _next(self, at: np.ndarray) -> np.ndarray:
        return self.words[np.minimum(at, len(self.words) - 1)].astype(U)

    def point(self, low: np.ndarray, size: np.ndarray, bits) -> np.ndarray:
        """Where the code points, below 2**bits."""
        return np.minimum(low // (size >> bits), (U(1) << bits) - U(1))

    def narrow(self, ix: np.ndarray | None, low: np.ndarray, size: np.ndarray, cum: np.ndarray, freq: np.ndarray, bits) -> np.ndarray:
        unit = size >> bits
        low -= cum * unit
        return freq * unit

    def settle(self, ix: np.ndarray | None, low: np.ndarray, size: np.ndarray) -> None:
        go = np.flatnonzero(size < _WORD)
        if len(go):
            lane = go if ix is None else ix[go]
            at = self.at[lane]
            low[go] = low[go] << _32 | self._next(at)
            size[go] <<= _32
            self.at[lane] = at + 1


def _shares(counts: np.ndarray, total: int) -> np.ndarray:
    """Frequencies of 1 at least that add up to total, nearly as the counts do; what rounding leaves goes to the largest of each row."""
    rows, n = counts.shape
    out = 1 + counts * (total - n) // np.maximum(counts.sum(1, keepdims=True), 1)
    out[np.arange(rows), counts.argmax(1)] += total - out.sum(1)
    return out


@dataclass
class Chances:
    """first: frequencies of order 2, order 1 and neither (rows: the runs of both, and whether they agree); ids and freq: order 0, in order of ids, then one more frequency, of all the others."""

    first: np.ndarray
    ids: np.ndarray
    freq: np.ndarray

    @classmethod
    def even(cls) -> Chances:
        """Where nothing was counted."""
        two, one = np.repeat(_CHANCE, 8), np.tile(_CHANCE, 8)
        apart = np.stack([two, (1 - two) * one, (1 - two) * (1 - one)], 1)
        agree = np.stack([1 - apart[:, 2], np.zeros(64), apart[:, 2]], 1)
        return cls(_shares((np.concatenate([apart, agree]) * 1000).astype(np.int64), 1 << _FIRST), np.zeros(0, np.uint32), np.array([1 << _ORDER0]))

    @classmethod
    def counted(cls, kinds: np.ndarray, rest: np.ndarray) -> Chances:
        """kinds: row of first * 4 + which was right; rest: the ids where neither was."""
        ids, n = _arrays.counted(rest)
        often = np.flatnonzero(n << (_ORDER0 + 1) >= len(rest))
        often = np.sort(often[np.argsort(-n[often], kind="stable")[:_OWN]])
        freq = _shares(np.append(n[often], len(rest) - n[often].sum())[None], 1 << _ORDER0)[0]
        return cls(_shares(np.bincount(kinds, minlength=512).reshape(128, 4)[:, :3], 1 << _FIRST), ids[often].astype(np.uint32), freq)

    def packed(self) -> bytes:
        parts = [_arrays.pack(self.first.astype(np.uint16)), _arrays.pack(np.diff(self.ids, prepend=np.uint32(0))), _arrays.pack(self.freq.astype(np.uint32))]
        return b"".join(len(x).to_bytes(4, "little") + x for x in parts)

    @classmethod
    def unpacked(cls, data: bytes) -> Chances:
        got = []
        for dtype in (np.uint16, np.uint32, np.uint32):
            size = int.from_bytes(data[:4], "little")
            got.append(_arrays.unpack(data[4 : 4 + size], dtype))
            data = data[4 + size :]
        return cls(got[0].astype(np.int64).reshape(128, 3), np.cumsum(got[1], dtype=np.uint32), got[2].astype(np.int64))

    @cached_property
    def kind(self) -> np.ndarray:
        """Of each kind (row of first * 4 + which was right): where it begins, of 2**_FIRST, in the upper half, its frequency in the lower."""
        out = np.zeros((128, 4), np.uint32)
        out[:, :3] = (np.cumsum(self.first, 1) - self.first) << 16 | self.first
        return out.reshape(-1)

    @cached_property
    def bounds(self) -> np.ndarray:
        """Of each row of first: where "neither" begins in the upper half, where "order 1" does in the lower."""
        return ((self.first[:, 0] + self.first[:, 1]) << 16 | self.first[:, 0]).astype(np.uint32)

    @cached_property
    def place(self) -> np.ndarray:
        """Of each id with a frequency of its own, then of all others: where it begins in the upper half, its frequency less 1 in the lower."""
        return ((np.cumsum(self.freq) - self.freq) << 16 | self.freq - 1).astype(np.uint32)

    @cached_property
    def by_id(self) -> np.ndarray:
        """The place of each id up to the largest, and of one above; those without a frequency of their own have the last."""
        out = np.full(int(self.ids[-1]) + 2 if len(self.ids) else 1, self.place[-1], np.uint32)
        out[self.ids] = self.place[:-1]
        return out

    @cached_property
    def rank(self) -> np.ndarray:
        """The number of the id at each place of order 0."""
        return np.repeat(np.arange(len(self.freq), dtype=np.uint16), self.freq)


class Orders:
    """The tables of some blocks."""

    def __init__(self, lanes: int):
        self.base = np.arange(2 * lanes).reshape(2, lanes) * _SLOTS
        self.table = np.zeros(2 * lanes * _SLOTS, np.uint32)
        self.p1 = self.p2 = np.zeros(lanes, np.uint32)

    def guess(self, k: int) -> np.ndarray:
        """The row of Chances.first of the first k lanes; ids: what orders 2 and 1 foresee."""
        p1, p2, last = self.p1[:k], self.p2[:k], np.uint32(_SLOTS - 1)
        h = p1 * np.uint32(40503)
        slots = np.empty((2, k), np.uint32)
        np.bitwise_and(h + p2 * np.uint32(30011) + (p2 >> np.uint32(5)), last, out=slots[0])
        np.bitwise_and(h + (p1 >> np.uint32(7)), last, out=slots[1])
        self.slots = self.base[:, :k] + slots
        met = self.table.take(self.slots, mode="clip")  # spares a check
        self.ids, self.runs = met & _ID, met >> _RUN
        row = self.runs[0] << np.uint32(3)
        row += self.runs[1]
        row += (self.ids[0] == self.ids[1]) * np.uint32(64)
        return row

    def learn(self, k: int, ids: np.ndarray) -> np.ndarray:
        """ids came; returns which orders had foreseen them."""
        hits = self.ids == ids
        new = np.minimum(self.runs, _MOST)
        new *= hits
        new <<= _RUN
        new += _ONE
        new |= ids
        self.table[self.slots] = new
        self.p2, self.p1 = self.p1, ids
        return hits


def nibbles(top: int) -> int:
    """Nibbles of the largest id, 4 at least; ids have 24 bits."""
    if top >= 1 << 24:
        raise ValueError("ids of more than 24 bits")
    return max(4, -(-int(top).bit_length() // 4))


def _blocks(n: int) -> tuple[np.ndarray, np.ndarray]:
    start = np.arange(0, n, BLOCK)
    return start, np.minimum(BLOCK, n - start)


def _encode(ids: np.ndarray, width: int, chances: Chances | None) -> tuple[list[bytes], Chances]:
    """Blocks of ids, the last one with the rest, and what they were coded by (counted here if not given)."""
    _, sizes = _blocks(len(ids))
    lanes, steps = len(sizes), int(sizes[0])
    of = np.zeros((lanes, steps), np.uint32)
    of.reshape(-1)[: len(ids)] = ids
    of = np.ascontiguousarray(of.T)  # a row a step
    orders, kinds = Orders(lanes), np.empty((steps, lanes), np.uint16)
    ks = np.searchsorted(-sizes, -np.arange(steps), "left").tolist()  # blocks longer than each step
    for step, k in enumerate(ks):
        row = orders.guess(k)
        two, one = ~orders.learn(k, of[step, :k])
        row <<= np.uint32(2)
        row += two.view(np.uint8) << one.view(np.uint8)
        kinds[step, :k] = row
    short = int(sizes[-1])
    if chances is None:
        full = lanes - (short < steps)
        some, came = kinds[:, :full].reshape(-1), of[:, :full].reshape(-1)
        if full < lanes:
            some, came = np.append(some, kinds[:short, -1]), np.append(came, of[:short, -1])
        chances = Chances.counted(some, came[(some & np.uint16(2)).view(np.int16).astype(bool)])
        del some, came
    coder = Writer(lanes, room=steps * (4 * width + _BITS) // 32 + 8)
    bits, even, others = U(_BITS), U(4 * width), chances.place[-1]
    for step, k in enumerate(ks):
        low, size, kind, x = coder.low[:k], coder.range[:k], kinds[step, :k], of[step, :k]
        first, known = chances.kind.take(kind, mode="clip"), (kind & np.uint16(2)) == 0
        place = chances.by_id.take(x, mode="clip")
        rare = place == others
        rare &= ~known
        np.copyto(place, _ALL, where=known)
        each = first & _LOWER
        first -= each
        first += each * (place >> _HALF)
        each *= (place & _LOWER) + np.uint32(1)
        size[:] = coder.narrow(None, low, size, first.astype(U), each.astype(U), bits)
        coder.settle(None, low, size)
        rare = np.flatnonzero(rare)
        if len(rare):
            own, span = low[rare], size[rare]
            span = coder.narrow(rare, own, span, x[rare].astype(U), U(1), even)
            coder.settle(rare, own, span)
            low[rare], size[rare] = own, span
    return coder.blocks(), chances


def _decode(words: np.ndarray, begin: np.ndarray, sizes: np.ndarray, width: int, chances: Chances) -> np.ndarray:
    """The ids of blocks of these sizes, the longest first."""
    lanes, steps = len(sizes), int(sizes[0])
    coder, orders = Reader(words, begin), Orders(lanes)
    out = np.zeros((steps, lanes), np.uint32)
    bits, even, ids, end = U(_BITS), U(4 * width), np.append(chances.ids, np.uint32(0)), np.uint32(1 << _BITS)
    for step, k in enumerate(np.searchsorted(-sizes, -np.arange(steps), "left").tolist()):
        low, size = coder.low[:k], coder.range[:k]
        both = chances.bounds.take(orders.guess(k), mode="clip")
        v = coder.point(low, size, bits).astype(np.uint32)
        neither, one = both & ~_LOWER, both << _HALF
        a, c = v >= one, v >= neither
        # below 2**28 by below 2**13: the nearest double is never a whole number too high
        each = (end - neither) >> _HALF
        at = chances.rank.take((((v - neither) * c).view(np.int32) / each.view(np.int32)).astype(np.int64), mode="clip")
        place = chances.place.take(at, mode="clip")
        cum, freq, sym = one * a, one, orders.ids[0].copy()
        np.copyto(freq, neither, where=a)
        freq -= cum
        np.copyto(cum, neither + each * (place >> _HALF), where=c)
        np.copyto(freq, each * ((place & _LOWER) + np.uint32(1)), where=c)
        np.copyto(sym, orders.ids[1], where=a)
        np.copyto(sym, ids.take(at, mode="clip"), where=c)
        size[:] = coder.narrow(None, low, size, cum.astype(U), freq.astype(U), bits)
        coder.settle(None, low, size)
        rare = np.flatnonzero((at == len(chances.ids)) & c)
        if len(rare):
            own, span = low[rare], size[rare]
            last = coder.point(own, span, even)
            span = coder.narrow(rare, own, span, last, U(1), even)
            coder.settle(rare, own, span)
            low[rare], size[rare], sym[rare] = own, span, last
        out[step, :k] = sym
        orders.learn(k, sym)
    return np.ascontiguousarray(out.T).reshape(-1)[: int(sizes.sum())]


def encode(ids: np.ndarray, width: int, counted: list[bytes] | None = None) -> list[bytes]:
    """The coded blocks of BLOCK ids each, the last one with the rest. counted: takes the chances of each LANES blocks, counted from their ids; without it they are coded by even ones."""
    out: list[bytes] = []
    ids = ids.astype(np.uint32, copy=False)
    for lo in range(0, len(ids), LANES * BLOCK):
        blocks, chances = _encode(ids[lo : lo + LANES * BLOCK], width, Chances.even() if counted is None else None)
        out += blocks
        if counted is not None:
            counted.append(chances.packed())
    return out


def decode(data: np.ndarray, ends: np.ndarray, n: int, width: int, counted: list[bytes] | None = None) -> np.ndarray:
    """The n ids of coded blocks, which end at these places of data. counted: as encode() gave it."""
    out = np.zeros(n, np.uint32)
    start, size = _blocks(n)
    begin = np.append(0, ends)[:-1] // 4 if len(ends) else ends
    words = np.frombuffer(data[: len(data) // 4 * 4].tobytes(), ">u4").astype(np.uint32)
    for i, lo in enumerate(range(0, len(start), LANES)):
        s, m = start[lo : lo + LANES], size[lo : lo + LANES]
        out[s[0] : s[-1] + m[-1]] = _decode(words, begin[lo : lo + LANES], m, width, Chances.even() if counted is None else Chances.unpacked(counted[i]))
    return out
