"""Token ids of whole texts through the tokenizers library, each distinct pre-token encoded once.

BPE merges never cross a pre-token, so a text's ids are the ids of its pre-tokens
in order. Pre-tokens are found with numpy (both public patterns below, checked
against the library in the tests), and the library encodes those a worker has
not met yet. Texts that the fast cut doesn't cover (special strings; characters
whose normal form or lower case isn't one character) go to the library whole.
"""

from __future__ import annotations

import contextlib
import os
from array import array
from dataclasses import dataclass
from functools import lru_cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from wayfold.llm._text import LETTER, NUMBER, SPACE, SPAN, Index, U, classes, constants, cut, flat, mix, points, sums

#: Pre-tokens kept by a worker; beyond it starts anew.
KEPT = 1_500_000


def starts(cp: np.ndarray, first: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Where pre-tokens start and end, in code points.

    rule "byte": 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    rule "word": 's|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+ (white space dropped)
    """
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[cp]
    opens = np.zeros(n + 1, bool)
    opens[first] = True
    begin = np.ones(n + 4, bool)
    begin[1:n] = (kind[1:] != kind[:-1]) | opens[1:n]
    if rule == "byte":
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~opens[1:n])
        begin[last] = True
        begin[last[cp[last] == 0x20] + 1] = False
    else:
        begin[:n] |= kind == NUMBER
    quote = np.flatnonzero((cp[:-1] == 0x27) & (kind[1:] == LETTER) & begin[: n - 1] & ~opens[1:n])
    if len(quote):
        a = cp[quote + 1]
        b = np.where((quote + 2 < n) & ~opens[np.minimum(quote + 2, n)], cp[np.minimum(quote + 2, n - 1)], 0)
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = (np.isin(a, [ord("r"), ord("v")]) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        begin[quote[one | two] + 1] = False
        begin[quote[one] + 2] = True
        begin[quote[two] + 3] = True
    at = np.flatnonzero(begin[:n])
    end = np.append(at[1:], n)
    if rule == "word":
        full = kind[at] != SPACE
        at, end = at[full], end[full]
    return at, end


@lru_cache(maxsize=1)
def _values() -> np.ndarray:
    return mix((np.arange(0x110000, dtype=U) + U(77)) * constants(1, 5)[0])


def hashes(cp: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(sums(cp, _values(), at, end) + (end - at).astype(U) * constants(1, 6)[0])


def parts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Offsets with long texts cut further, only after a letter that no letter follows, where both patterns start a pre-token whatever stands around it. A longer run of letters is one pre-token and stays whole."""
    long = np.flatnonzero(np.diff(at) > SPAN)
    if not len(long):
        return at
    out = [at]
    for i in long:
        lo, hi = int(at[i]), int(at[i + 1])
        while hi - lo > SPAN:
            for near in range(lo + SPAN // 2, hi, SPAN // 2):
                from_, to = (k + int(np.flatnonzero((data[k : k + 4] & 0xC0) != 0x80)[0]) if k < hi else hi for k in (near, min(near + SPAN // 2, hi)))
                kind = classes()[points(data[from_:to], np.array([0, to - from_]))[0]]
                ok = np.flatnonzero((kind[:-1] == LETTER) & (kind[1:] != LETTER))
                if len(ok):
                    leads = np.flatnonzero((data[from_:to] & 0xC0) != 0x80)
                    lo = from_ + int(leads[ok[-1] + 1])
                    out.append(np.array([lo]))
                    break
            else:
                break
    return np.sort(np.concatenate(out))


def pretokens(data: np.ndarray, at: np.ndarray, rule: str):
    """By chunk of texts: the chunk's string, and hash, start and end (code points) and byte offset of each pre-token's part."""
    inner = parts(data, at)
    for lo, hi in cut(inner, SPAN):
        piece = data[inner[lo] : inner[hi]]
        cp, first = points(piece, inner[lo : hi + 1] - inner[lo])
        if rule == "word":
            cp = lowered()[cp] if len(cp) else cp
        s, e = starts(cp, first, rule)
        yield inner[lo : hi + 1], cp, s, e, first, hashes(cp, s, e)


@lru_cache(maxsize=1)
def lowered() -> np.ndarray:
    """Lower case of the code points below SIMPLE; those above never get here."""
    out = np.arange(0x110000, dtype=np.uint32)
    out[:SIMPLE] = [ord(chr(c).lower()) for c in range(SIMPLE)]
    return out


#: Below it every code point is its own normal form (NFC) and has one lower-case code point.
SIMPLE = 0x130


@lru_cache(maxsize=1)
def library(path: str):
    """A worker's tokenizer; it is made once, since each one that has encoded something leaves some MB behind when it is freed."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@dataclass
class Coder:
    """The ids of texts by the tokenizer at path. rule: its pre-token pattern, see starts()."""

    path: str
    rule: str

    def __post_init__(self):
        self.tokenizer = library(self.path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.reset()

    def reset(self) -> None:
        #: Levels of known pre-tokens, the larger first: index of their hashes, where their ids start, how many they are.
        self.levels: list[tuple[Index, np.ndarray, np.ndarray]] = []
        self.ids = np.zeros(0, np.uint32)

    @property
    def known(self) -> int:
        return sum(len(x[0].keys) for x in self.levels)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each pre-token start and how many they are; -1 if it isn't known."""
        from_, size = np.zeros(len(h), np.int64), np.full(len(h), -1)
        rest = np.arange(len(h))
        for index, f, n in self.levels:
            at, there = index.find(h[rest])
            from_[rest[there]], size[rest[there]] = f[at[there]], n[at[there]]
            rest = rest[~there]
        return from_, size

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, one after another, and how many each has: the library's model on their byte-level form."""
        tokenize, get = self.tokenizer.model.tokenize, attrgetter("id")
        raw = [x.encode() for x in texts]
        every = byte_letters()[np.frombuffer(b"".join(raw), np.uint8)].tobytes().decode("utf-16-le")
        ids, size, at = array("I"), array("q"), 0
        for x in raw:
            got = tokenize(every[at : at + len(x)])
            ids.extend(map(get, got))
            size.append(len(got))
            at += len(x)
        return np.array(ids, np.uint32), np.array(size, np.int64)

    def learn(self, keys: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """keys: sorted, none known. Where the ids of each start, and how many they are. A level is merged into the one before it when it has grown to a quarter of it."""
        new, size = self.pieces(texts)
        from_ = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, new])
        self.levels.append((Index(keys), from_, size))
        while len(self.levels) > 1 and 4 * len(self.levels[-1][0].keys) > len(self.levels[-2][0].keys):
            (a, *x), (b, *y) = self.levels[-2:]
            keys = np.concatenate([a.keys, b.keys])
            order = np.argsort(keys, kind="stable")
            self.levels[-2:] = [(Index(keys[order]), *(np.concatenate(z)[order] for z in zip(x, y, strict=True)))]
        return from_, size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none), and each text's range of them."""
        data, at = flat(texts)
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        odd = np.zeros(len(texts), bool)
        for s in self.special:
            odd |= np.asarray(pc.fill_null(pc.match_substring(texts, s), False).to_numpy(zero_copy_only=False), bool)
        if self.rule == "word":  # lead bytes from 0xC4 0xB0 on
            high = np.flatnonzero((data > 0xC4) | ((data[:] == 0xC4) & (np.append(data[1:], 0) >= 0xB0)))
            odd[np.unique(np.searchsorted(at, high, "right") - 1)] = True
        counts, out = np.zeros(len(texts), np.int64), []
        lo = 0
        n = len(texts)
        while lo < n:  # runs of plain texts between odd ones
            hi = lo + 1
            if odd[lo]:
                ids = self.whole([texts[lo].as_py()])[0]
                counts[lo] = len(ids)
                out.append(ids)
            else:
                rest = np.flatnonzero(odd[lo:])
                hi = lo + int(rest[0]) if len(rest) else n
                for ids, c in self._plain(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]):
                    out.append(ids)
                    counts[lo:hi] += c
            lo = hi
        return np.concatenate(out) if out else np.zeros(0, np.uint32), np.concatenate([[0], np.cumsum(counts)])

    def _plain(self, data: np.ndarray, at: np.ndarray):
        for bounds, cp, s, e, first, h in pretokens(data, at, self.rule):
            from_, size = self.find(h)
            missing = np.flatnonzero(size < 0)
            if len(missing):
                new, where, back = np.unique(h[missing], return_index=True, return_inverse=True)
                if self.levels and self.known + len(new) > KEPT:
                    self.reset()
                    missing = np.arange(len(h))
                    new, where, back = np.unique(h, return_index=True, return_inverse=True)
                pick = missing[where]
                f, n = self.learn(new, strings(cp, s[pick], e[pick]))
                from_[missing], size[missing] = f[back], n[back]
            run = np.cumsum(size)
            total = int(run[-1]) if len(run) else 0
            ids = self.ids[np.repeat(from_ - run + size, size) + np.arange(total)]
            # a part's tokens lie in its range of code points; parts of a text are summed
            upto = np.concatenate([[0], run])[np.searchsorted(s, first)]
            counts = np.zeros(len(at) - 1, np.int64)
            np.add.at(counts, np.minimum(np.searchsorted(at, bounds[:-1], "right"), len(counts)) - 1, np.diff(upto))
            yield ids, counts


def strings(cp: np.ndarray, s: np.ndarray, e: np.ndarray) -> list[str]:
    text = cp.tobytes().decode("utf-32-le")
    return [text[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]


@lru_cache(maxsize=1)
def byte_letters() -> np.ndarray:
    """The letter (UTF-16 code) that stands for each byte in byte-level vocabularies: itself if it can be printed, else one from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    out = np.arange(256, dtype="<u2")
    out[rest] = 256 + np.arange(len(rest))
    return out


#: A worker's tables for its next task of a stage that asks for them.
_KEPT: dict[tuple[str, str], Coder] = {}


def forget() -> None:
    _KEPT.clear()


@contextlib.contextmanager
def coder(path: str, rule: str, keep: bool = False):
    """A task's coder; its tables are freed with the task, so that a reused worker keeps nothing of them. keep: a worker's next task of the stage has them too (see _arrays.run), as most of its pre-tokens were met before."""
    c = _KEPT.pop((path, rule), None) or Coder(path, rule)
    whole = False
    try:
        yield c
        whole = True
    finally:
        if keep and whole:
            _KEPT[path, rule] = c
        else:
            c.reset()
