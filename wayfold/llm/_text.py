"""Array kernels over Arrow text columns, shared by the text operators.

A batch of texts is one byte buffer plus offsets. Words, n-grams and GPT-2 style
pre-tokens are found with numpy over that buffer, in spans of SPAN bytes, so that a
very long text costs no more working memory than many short ones. Every hash is
a fixed function of the bytes (no per-process seed): it has the same value on
every executor and on every retry.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes worked on at a time: arrays of 8 bytes for each fit the caches, and what a worker needs at most stays small.
SPAN = 1 << 18


def _give_back() -> None:
    """Let the C library return the memory of large arrays to the system when they are freed: workers are reused, and what one stage needed at most must not stay with the next. Without effect where the library has no such setting."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 2 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 16 << 20)  # M_TRIM_THRESHOLD


_give_back()


def resident() -> int:
    """Bytes of memory that this process holds now; without end where the system doesn't say."""
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
    except (OSError, ValueError):
        return 1 << 62


def release() -> None:
    """Give freed memory back now: called where a task ends, as its worker waits for the next."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, a bijection of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(seed)) * U(0x9E3779B97F4A7C15)) | U(1)


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < SPAN; P is odd."""
    p = 0x5851F42D4C957F2D
    q = pow(p, -1, 1 << 64)
    out = []
    for base in (p, q):
        a = np.full(SPAN, base, U)
        a[:1] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


def sums(codes: np.ndarray, value: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each range the sum of value[code] P**(place in the range): the same wherever it stands. start and end are sorted; whatever the ranges' lengths, working memory is that of SPAN codes."""
    p, q = powers()
    every = (1 << 64) - 1
    step, back = int(p[-1]) * int(p[1]) & every, int(q[-1]) * int(q[1]) & every
    out = np.zeros(len(start), U)
    total, scale = 0, 1
    run = np.zeros(min(SPAN, len(codes)) + 1, U)
    for lo in range(0, max(len(codes), 1), SPAN):
        part = codes[lo : lo + SPAN]
        n = len(part)
        np.cumsum(value[part] * p[:n], out=run[1 : n + 1])
        last = lo + n == len(codes)
        for at, sign in ((start, -1), (end, 1)):
            a, z = np.searchsorted(at, lo), len(at) if last else np.searchsorted(at, lo + n)
            got = run[at[a:z] - lo]
            if lo:
                got = got * U(scale) + U(total)
            out[a:z] += got if sign > 0 else ~got + U(1)
        total, scale = (total + scale * int(run[n])) & every, scale * step & every
    out *= q[start % SPAN]
    if len(codes) > SPAN:
        out *= np.multiply.accumulate(np.append(U(1), np.full(len(codes) // SPAN, back, U)))[start // SPAN]
    return out


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


#: Bytes of words, by rule. "space": [^\x20\x09-\x0D]+; "alnum": [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text.
def _kind(rule: str) -> np.ndarray:
    word = np.ones(256, bool)
    if rule == "space":
        word[[0x20, *range(0x09, 0x0E)]] = False
    elif rule == "alnum":
        word[:0x80] = False
        word[0x30:0x3A] = word[0x61:0x7B] = word[0x41:0x5B] = True
    else:
        raise ValueError(rule)
    return word


WORD_BYTES = {rule: _kind(rule) for rule in ("space", "alnum")}
_VALUE = constants(256, 11)
_LOWER = _VALUE.copy()
_LOWER[0x41:0x5B] = _VALUE[0x61:0x7B]
_LENGTH = U(0xD6E8FEB86659FD93)


@dataclass
class Words:
    """Words of a batch in order: hash and byte range of each, and each text's range of words."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The row number of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def words(data: np.ndarray, at: np.ndarray, rule: str = "space", lower: bool = True) -> Words:
    """The words of each text, found and hashed span by span; a word may reach over spans."""
    word = WORD_BYTES[rule]
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    edges = np.unique(at)
    before = False
    for lo in range(0, len(data), SPAN):
        span = data[lo : lo + SPAN]
        inside = np.empty(len(span) + 1, bool)
        inside[0], inside[1:] = before, word[span]
        before = bool(inside[-1])
        begin = inside[1:] & ~inside[:-1]
        finish = inside[:-1] & ~inside[1:]
        cut = edges[np.searchsorted(edges, lo) : np.searchsorted(edges, lo + len(span))] - lo
        both = cut[inside[cut] & inside[cut + 1]]
        begin[both] = finish[both] = True
        starts.append(np.flatnonzero(begin) + lo)
        ends.append(np.flatnonzero(finish) + lo)
    if before:
        ends.append(np.array([len(data)]))
    start, end = np.concatenate(starts), np.concatenate(ends)
    h = mix(sums(data, _LOWER if lower else _VALUE, start, end) + (end - start).astype(U) * _LENGTH)
    return Words(h, start, end, np.searchsorted(start, at))


_STEP = constants(64, 101)


def grams(w: Words, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n words inside a text, and each text's range of them. short: a text of fewer words, but not none, has its whole sequence as one."""
    count = w.count
    have = np.maximum(count - n + 1, 0)
    if short:
        have = np.where((count > 0) & (count < n), 1, have)
    first = np.concatenate([[0], np.cumsum(have)])
    text = np.repeat(np.arange(len(count)), have)
    at = np.arange(first[-1]) - first[:-1][text] + w.first[:-1][text]
    out = np.full(len(at), n, U) * _LENGTH
    if short and len(at):
        size = np.minimum(count, n)[text]
        out = size.astype(U) * _LENGTH
        last = len(w.hash) - 1
        for k in range(n):
            out += np.where(k < size, w.hash[np.minimum(at + k, last)] * _STEP[k], U(0))
    else:
        for k in range(n):
            out += w.hash[at + k] * _STEP[k]
    return mix(out), first


def gram_at(w: Words, at: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each place on, as grams() has it."""
    out = np.full(len(at), n, U) * _LENGTH
    for k in range(n):
        out += w.hash[at + k] * _STEP[k]
    return mix(out)


def cut(at: np.ndarray, size: int = 4 * SPAN) -> list[tuple[int, int]]:
    """Row ranges whose texts hold about so many bytes; a longer text stands alone."""
    out, lo, n = [], 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        out.append((lo, min(hi, n)))
        lo = hi
    return out


def sum_by(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sum of each range; 0 for an empty one. A range's sum doesn't depend on the others."""
    out = np.zeros(len(first) - 1, values.dtype if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full] = np.add.reduceat(values[: first[-1]], first[:-1][full])
    return out


class Index:
    """Sorted 64-bit hashes with a directory of their leading bits; they may be memory-mapped. Hashes are even, so a look-up takes a step or two."""

    def __init__(self, keys: np.ndarray, table: np.ndarray | None = None, bits: int = 0):
        self.keys = keys
        self.bits = bits or max(1, len(keys).bit_length())
        self.table = self.directory(keys, self.bits) if table is None else table

    @staticmethod
    def directory(keys: np.ndarray, bits: int) -> np.ndarray:
        heads = np.arange(1 << bits, dtype=U) << U(64 - bits)
        return np.searchsorted(keys, heads).astype(np.uint32 if len(keys) < 1 << 32 else np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each hash (0 if absent) and whether it is there."""
        n = len(self.keys)
        if not n or not len(h):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = self.table[h >> U(64 - self.bits)].astype(np.int64)
        np.minimum(at, n - 1, out=at)
        got = self.keys[at]
        late = np.flatnonzero(got < h)
        while len(late):
            late = late[at[late] < n - 1]
            at[late] += 1
            got[late] = self.keys[at[late]]
            late = late[got[late] < h[late]]
        there = got == h
        at[~there] = 0
        return at, there


def spread(keys: np.ndarray) -> Index:
    """An index of sorted keys that aren't hashes: of their mixed values, with their places."""
    mixed = mix(keys)
    order = np.argsort(mixed)
    out = Index(mixed[order])
    out.order = order
    return out


LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3

#: White space of Unicode, as the tokenizers' patterns take \s.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point: letter, number, white space, other."""
    kind = {"L": LETTER, "N": NUMBER}
    kinds = {a + b: kind.get(a, OTHER) for a in "LMNPSZC" for b in "ultmoncdesfikpr"}
    out = np.fromiter(map(kinds.__getitem__, map(unicodedata.category, map(chr, range(0x110000)))), np.uint8, 0x110000)
    out[WHITE] = SPACE
    return out


def points(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and each text's range of them."""
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), lead[at]
