"""Bytes that repeat an earlier document's, found by prefix-free parsing.

A string is LENGTH bytes of one document. A rolling hash of K bytes runs over every text; of
the places in a string where K bytes fit, the one with the least hash is the string's trigger.
Strings next to each other that share their trigger make a phrase, so triggers cut each text
into a parse of phrases wherever it stands, copies into the same ones. Phrases overlap by
LENGTH - 1 bytes, not by K alone: every string lies inside one phrase, and the order of the
corpus' strings is that of the dictionary's suffixes. (The ranks of the parse, which order
what reaches over phrases, would tell strings of more than LENGTH bytes apart, and none of
those is asked for.)

1. Triggers are counted by documents. Those of one document can't be in a repeated string,
   and all of the text that only they mark is done with.
2. The dictionary: phrases of shared triggers, each once, with the least id that has it. A
   bucket of triggers is one task; equal strings share their trigger, so they meet there.
   It sorts the suffixes of its phrases (those of LENGTH bytes or more), and each run that
   agrees in LENGTH bytes gives the least id to all its strings. A phrase keeps its least id
   and a bit for each of its strings that an earlier document has.
3. Each document's parse is looked up in the dictionary, memory-mapped from the shared folder.

A trigger of more than HOT documents could gather any number of phrases in a bucket: its
phrases are cut to single strings, which are dealt by their own hash and need no order.
What a task sends is distinct within FLUSH bytes of phrases. Shuffled: a hash for each
trigger (about one in 13 bytes) and the shared phrases' text, compressed; documents stay
where they are. Phrases are told apart by their bytes where they are gathered, by 128 bits
of hash where documents look them up.

Nulls: a null text is empty; a row without an id removes nothing and nothing of it is removed.
Texts under LENGTH bytes stay whole. Rows that repeat an id don't remove each other's bytes,
only those of larger ids. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import _arrays, _shared
from wayfold.llm._text import _VALUE, SPAN, U, constants, flat, mix, powers, sums

LENGTH = 50
#: Documents of a trigger from which its phrases are cut to single strings.
HOT = 50_000
#: Bytes of phrases that a task gathers before it sends them, of a bucket, and suffixes that are sorted at a time.
FLUSH, BUCKET, SORT = 16 << 20, 24 << 20, 1 << 19

_OTHER = constants(256, 47)
_PLACE = SPAN.bit_length() - 1
_SINGLE = 255


def width(length: int) -> int:
    """Bytes of a trigger: a string holds at most 64 of them, so a phrase has at most 64 strings."""
    if not 16 <= length <= 256:
        raise ValueError("strings have 16 to 256 bytes")
    return max(length // 2, length - 63)


@dataclass
class Phrases:
    """Phrases of a batch of texts in order: first byte, number of strings, place and hash of the trigger."""

    start: np.ndarray
    count: np.ndarray
    at: np.ndarray
    trigger: np.ndarray

    def take(self, rows: np.ndarray) -> Phrases:
        return Phrases(self.start[rows], self.count[rows], self.at[rows], self.trigger[rows])


def parse(data: np.ndarray, at: np.ndarray, length: int = LENGTH) -> Phrases:
    """The phrases of texts (their bytes, and where each begins), a span at a time."""
    k = width(length)
    p, q = powers()
    low = U((1 << _PLACE) - 1)
    edges = np.unique(at)
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U))]
    for lo in range(0, len(data) - length + 1, SPAN - length + 1):
        x = data[lo : lo + SPAN]
        n = len(x)
        run = np.zeros(n + 1, U)
        np.cumsum(_VALUE[x] * p[:n], out=run[1:])
        h = mix((run[k:] - run[:-k]) * q[: n - k + 1])
        # the place in the low bits: of equal hashes the first is least
        least = (h & ~low) | np.arange(len(h), dtype=U)
        done, whole = 1, length - k + 1
        while done < whole:
            step = min(done, whole - done)
            least = np.minimum(least[: len(least) - step], least[step:])
            done += step
        anchor = (least & low).astype(np.int64)
        # strings that would reach over a text's end are none
        over = np.zeros(n + 1, np.int32)
        ends = edges[np.searchsorted(edges, lo, "right") : np.searchsorted(edges, lo + n + length)] - lo
        np.add.at(over, np.clip(ends - length + 1, 0, n), 1)
        np.add.at(over, np.clip(ends, 0, n), -1)
        good = np.cumsum(over[: len(anchor)]) == 0
        new = np.append(True, anchor[1:] != anchor[:-1])
        begin = np.flatnonzero(good & (new | np.append(True, ~good[:-1])))
        end = np.flatnonzero(good & np.append(new[1:] | ~good[1:], True)) + 1
        found.append((begin + lo, end - begin, anchor[begin] + lo, h[anchor[begin]]))
    start, count, place, trigger = (np.concatenate(c) for c in zip(*found, strict=True))
    if len(start):  # phrases that two spans share
        first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (start[1:] != (start + count)[:-1])))
        start, count, place, trigger = start[first], np.add.reduceat(count, first), place[first], trigger[first]
    return Phrases(start, count, place, trigger)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = (end - start).astype(U)
    return tuple(mix(sums(data, value, start, end) + size * U(odd)) for value, odd in ((_VALUE, 0xD6E8FEB86659FD93), (_OTHER, 0x9E3779B97F4A7C15)))


def _gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of ranges, one after another."""
    return data[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


@dataclass(frozen=True)
class Dictionary:
    """Where the shared triggers and the phrases are, and how many a bucket has."""

    path: str
    length: int
    hot: int
    trigger_bits: int
    trigger_sizes: tuple[tuple[int, int], ...]
    bits: int
    sizes: tuple[tuple[int, int], ...]


def _shared_phrases(store: _arrays.Arrays, data: np.ndarray, at: np.ndarray, length: int, hot: int) -> tuple[Phrases, np.ndarray]:
    """Phrases whose trigger other documents have too, those of hot triggers string by string; which are such strings."""
    found = parse(data, at, length)
    keys, back = np.unique(found.trigger, return_inverse=True)
    place, counts = store.find(keys)
    counts = np.where(place >= 0, counts, 0)[back]
    found, counts = found.take(np.flatnonzero(counts)), counts[counts > 0]
    single = counts > hot
    if not single.any():
        return found, single
    times = np.where(single, found.count, 1)
    row = np.repeat(np.arange(len(times)), times)
    step = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    return Phrases(found.start[row] + step, np.where(single[row], 1, found.count[row]), found.at[row], found.trigger[row]), single[row]


def fit(docs: DataFrame, length: int = LENGTH, id: str = "doc_id", text: str = "text", hot: int = HOT) -> Dictionary:
    """The dictionary of all strings of docs that more than one document may have."""
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null and text is not null")
    spark = docs.sparkSession
    path = _shared.folder(spark, "phrases")
    k, b = width(length), _arrays.bits(docs)

    def triggers(batches):
        keys, counts, held = [], [], 0
        for batch in _arrays.slices(batches):
            data, at = flat(batch.column("text"))
            found = parse(data, at, length)
            row = np.searchsorted(at, found.start, "right")
            order = np.lexsort((row, found.trigger))
            h, row = found.trigger[order], row[order]
            h = h[np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))[: len(h)]]
            one, n = _arrays.counted(h)
            keys.append(one)
            counts.append(n)
            held += len(one)
            if held > FLUSH >> 3:
                yield _arrays.rows(*_arrays.merged(keys, counts), b)
                keys, counts, held = [], [], 0
        if keys:
            yield _arrays.rows(*_arrays.merged(keys, counts), b)

    stats = _arrays.store(_arrays.run(docs, triggers, _arrays.BLOBS), f"{path}/triggers", b, least=2).select("bucket", "n", "total").collect()  # a row a bucket
    trigger_sizes = tuple(sorted((r["bucket"], r["n"]) for r in stats))
    # as many buckets as the phrases at hand need: each has up to 2 * length bytes, and copies are most of them
    n = max(b, (sum(r["total"] for r in stats) * (3 * length // 2) // BUCKET).bit_length())

    def phrases(batches):
        store = _arrays.arrays(f"{path}/triggers", b, trigger_sizes)
        held, size = [], 0
        for batch in _arrays.slices(batches):
            data, at = flat(batch.column("text"))
            found, single = _shared_phrases(store, data, at, length, hot)
            if not len(found.start):
                continue
            end = found.start + found.count + (length - 1)
            one, two = _hashes(data, found.start, end)
            who = batch.column("id").to_numpy()[np.searchsorted(at, found.start, "right") - 1]
            pick = _least(one, two, who)
            start, bytes_ = found.start[pick], (end - found.start)[pick]
            offset = np.where(single, _SINGLE, found.at - found.start)[pick].astype(np.uint8)
            key = np.where(single, one, found.trigger)[pick]
            held.append((one[pick], two[pick], who[pick], key, offset, bytes_, _gathered(data, start, bytes_)))
            size += int(bytes_.sum())
            if size > FLUSH:
                yield _sent(held, n)
                held, size = [], 0
        if held:
            yield _sent(held, n)

    def sort(batches):
        for i, rows in _arrays.by_bucket(batches):
            one, two, who, mask = _ordered(rows, length, k)
            _arrays.save(f"{path}/phrases", i, keys=one, second=two.view(np.int64), who=who, mask=mask.view(np.int64))
            yield pa.RecordBatch.from_pylist([{"bucket": i, "n": len(one)}])

    sent = _arrays.run(docs, phrases, "bucket long, who binary, offset binary, size binary, text binary, n_bytes long")
    sizes = _arrays.sizes(_arrays.run(sent.repartition(1 << n, "bucket").sortWithinPartitions("bucket"), sort, "bucket long, n long"))
    return Dictionary(path, length, hot, b, trigger_sizes, n, sizes)


def _least(one: np.ndarray, two: np.ndarray, who: np.ndarray) -> np.ndarray:
    """Of each phrase a row with the least id, in the order of hashes."""
    order = np.lexsort((who, two, one))
    a, b = one[order], two[order]
    return order[np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]]


def _sent(held: list[tuple[np.ndarray, ...]], n: int) -> pa.RecordBatch:
    """Distinct phrases, a row a bucket."""
    one, two, who, key, offset, size, text = (np.concatenate(c) for c in zip(*held, strict=True))
    pick = _least(one, two, who)
    b = _arrays.bucket(key[pick], n)
    order = np.argsort(b, kind="stable")
    pick, b = pick[order], b[order]
    at = np.cumsum(size) - size
    first = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
    out: dict[str, list] = {c: [] for c in ("bucket", "who", "offset", "size", "text", "n_bytes")}
    for lo, hi in zip(first.tolist(), np.append(first[1:], len(b)).tolist(), strict=True):
        some = pick[lo:hi]
        raw = _gathered(text, at[some], size[some]).tobytes()
        for name, value in (("bucket", int(b[lo])), ("who", _arrays.pack(who[some])), ("offset", _arrays.pack(offset[some])), ("size", _arrays.pack(size[some].astype(np.uint16))), ("text", pa.compress(raw, codec="zstd", asbytes=True)), ("n_bytes", len(raw))):
            out[name].append(value)
    return pa.RecordBatch.from_pydict(out)


def _ordered(rows: list[dict], length: int, k: int) -> tuple[np.ndarray, ...]:
    """The distinct phrases of a bucket: two hashes (sorted), least id, and a bit for each string that an earlier document has."""
    data = np.frombuffer(b"".join(pa.decompress(r["text"], decompressed_size=r["n_bytes"], codec="zstd", asbytes=True) for r in rows), np.uint8)
    who, offset, size = (np.concatenate([_arrays.unpack(r[c], d) for r in rows]) for c, d in (("who", np.int64), ("offset", np.uint8), ("size", np.uint16)))
    rows.clear()
    size = size.astype(np.int64)
    at = np.append(0, np.cumsum(size))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(data)])
    code = words.dictionary_encode().indices.to_numpy()
    order = np.lexsort((who, code))
    pick = order[np.append(True, code[order][1:] != code[order][:-1])]
    start, size, who, offset = at[pick], size[pick], who[pick], offset[pick].astype(np.int64)
    rank = np.argsort(start)
    start, size, who, offset = start[rank], size[rank], who[rank], offset[rank]
    one, two = _hashes(data, start, start + size)
    trigger = np.where(offset == _SINGLE, one, mix(sums(data, _VALUE, start + np.where(offset == _SINGLE, 0, offset), start + np.where(offset == _SINGLE, 0, offset) + k)))
    mask = np.zeros(len(start), U)
    by = np.argsort(trigger, kind="stable")
    t = trigger[by]
    first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
    times = np.diff(np.append(first, len(t)))
    some = by[np.repeat(times > 1, times)]  # phrases that share a trigger with another
    many = np.cumsum((size - length + 1)[some])
    same = np.append(trigger[some][1:] == trigger[some][:-1], False)
    lo = 0
    while lo < len(some):
        hi = max(lo + 1, int(np.searchsorted(many, (many[lo - 1] if lo else 0) + SORT, "right")))
        while hi < len(some) and same[hi - 1]:  # a trigger's phrases stay together
            hi += 1
        mask[some[lo:hi]] = _earlier(data, start[some[lo:hi]], size[some[lo:hi]] - length + 1, who[some[lo:hi]], length)
        lo = hi
    order = np.lexsort((two, one))
    return one[order], two[order], who[order], mask[order]


def _earlier(data: np.ndarray, start: np.ndarray, count: np.ndarray, who: np.ndarray, length: int) -> np.ndarray:
    """For each phrase a bit for each of its strings that a phrase with a smaller id has, by the order of all their suffixes."""
    row = np.repeat(np.arange(len(start)), count)
    base = np.cumsum(count) - count
    step = np.arange(len(row)) - base[row]
    at = start[row] + step
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)
    words = [np.ascontiguousarray(eight[at + j]).view(">u8").reshape(-1).astype(U) for j in (*range(0, length - 7, 8), *([length - 8] if length % 8 else []))]
    order = np.lexsort(words[::-1])
    new = np.zeros(len(order), bool)
    new[0] = True
    for w in words:
        s = w[order]
        new[1:] |= s[1:] != s[:-1]
    first = np.flatnonzero(new)
    low = np.minimum.reduceat(who[row[order]], first)
    least = np.empty(len(order), np.int64)
    least[order] = np.repeat(low, np.diff(np.append(first, len(order))))
    return np.add.reduceat((least < who[row]).astype(U) << step.astype(U), base)


class _Lookup:
    """A task's view of the phrases."""

    def __init__(self, d: Dictionary):
        self.d, self.sizes, self.open = d, dict(d.sizes), {}

    def column(self, name: str, i: int, dtype: str = "i8") -> np.ndarray:
        if (name, i) not in self.open:
            self.open[name, i] = _arrays.mapped(f"{self.d.path}/phrases", name, i, dtype, self.sizes.get(i, 0))
        return self.open[name, i]

    def find(self, key: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each phrase is there (those of null ids alone aren't), its least id and its bits."""
        there, who, mask = np.zeros(len(key), bool), np.zeros(len(key), np.int64), np.zeros(len(key), U)
        b = _arrays.bucket(key, self.d.bits)
        order = np.lexsort((one, b))
        first = np.flatnonzero(np.append(True, b[order][1:] != b[order][:-1])[: len(order)])
        for lo, hi in zip(first.tolist(), np.append(first[1:], len(order))[: len(first)].tolist(), strict=True):
            at, i = order[lo:hi], int(b[order[lo]])
            keys = self.column("keys", i, "u8")
            if not len(keys):
                continue
            second = self.column("second", i).view(U)
            pos = np.searchsorted(keys, one[at])
            while len(at):  # again only where two phrases share a hash
                ok = pos < len(keys)
                at, pos = at[ok], pos[ok]
                ok = keys[pos] == one[at]
                at, pos = at[ok], pos[ok]
                hit = second[pos] == two[at]
                there[at[hit]] = True
                who[at[hit]], mask[at[hit]] = self.column("who", i)[pos[hit]], self.column("mask", i).view(U)[pos[hit]]
                at, pos = at[~hit], pos[~hit] + 1
        return there, who, mask


def removed(docs: DataFrame, dictionary: Dictionary, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, spans (start and end byte of each maximal removed run) and kept (the other bytes) of every row."""
    length = dictionary.length
    docs = docs.select(F.col(id).alias("id"), F.col(id).cast("long").alias("number"), F.col(text).cast("string").alias("text"))

    def judge(batches):
        store, look = _arrays.arrays(f"{dictionary.path}/triggers", dictionary.trigger_bits, dictionary.trigger_sizes), _Lookup(dictionary)
        for batch in _arrays.slices(batches):
            data, at = flat(batch.column("text"))
            found, single = _shared_phrases(store, data, at, length, dictionary.hot)
            end = found.start + found.count + (length - 1)
            one, two = _hashes(data, found.start, end)
            there, who, mask = look.find(np.where(single, one, found.trigger), one, two)
            row = np.searchsorted(at, found.start, "right") - 1
            known = np.asarray(batch.column("number").is_valid())[row]
            number = batch.column("number").fill_null(0).to_numpy()[row]
            cover = np.zeros(len(data) + 1, np.int32)
            later = there & known & (number > who)
            np.add.at(cover, found.start[later], 1)
            np.add.at(cover, end[later], -1)
            part = np.flatnonzero(there & known & (number == who) & (mask != 0))
            for i in range(int(found.count[part].max()) if len(part) else 0):
                some = found.start[part[(mask[part] >> U(i)) & U(1) == 1]] + i
                np.add.at(cover, some, 1)
                np.add.at(cover, some + length, -1)
            gone = np.cumsum(cover[:-1]) > 0
            total = np.append(0, np.cumsum(gone, dtype=np.int64))
            n_removed = total[at[1:]] - total[at[:-1]]
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for r in np.flatnonzero(n_removed).tolist():
                x = np.diff(gone[at[r] : at[r + 1]].astype(np.int8), prepend=0, append=0)
                spans[r] = [{"start": a, "end": z} for a, z in zip(np.flatnonzero(x == 1).tolist(), np.flatnonzero(x == -1).tolist(), strict=True)]
            left = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(at - total[at]), pa.py_buffer(data[~gone])])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(at)), pa.array(n_removed), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), left.cast(pa.binary())], ["id", "n_bytes", "n_removed", "spans", "kept"])

    schema = f"id {docs.schema['id'].dataType.simpleString()}, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"
    return _arrays.run(docs, judge, schema).withColumnRenamed("id", id)


def forget(spark: SparkSession, dictionary: Dictionary) -> None:
    """Remove the dictionary's files; frames of removed() that weren't written can't be used any more."""
    _shared.remove(spark, dictionary.path)
