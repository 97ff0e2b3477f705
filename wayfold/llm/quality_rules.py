"""Quality rules: counts of words, symbols and repeats, and the perplexity of a character model of the text's language.

The model is an interpolated modified Kneser-Ney model of ORDER characters, one for each
value of the language column, over every text:

    p(w|h) = max(n(hw) - D(n), 0) / N(h) + g(h) p(w|h'),  h' = h without its first character

with counts n at the highest order and, below, the number of distinct characters seen
before hw; at the end a uniform share of the language's characters and one unknown.
Texts are framed by ORDER - 1 start marks and one end mark.

Grams of characters repeat, so map tasks send each distinct one once with its count; the
model is made from these counts by DataFrame joins and aggregates of the grams alone and
written as sorted hash arrays, which scoring tasks memory-map. Its size follows the
number of distinct character grams, not of texts.

A text passes if its perplexity lies in its language's band: log10 perplexity from
Q1 - R to Q3 + R with R = FENCE (Q3 - Q1), at least LEAST. The quartiles are those of the
language's distinct texts (by 64-bit hash) that pass the base rules (percentile_approx
with ACCURACY, over all of them): copies neither narrow the band nor move it.

clean: the model learns from texts that pass the base rules and hold few symbols, not from
what it is to catch, and from each distinct one once, else a text with many copies would leave the band as too
likely. Numbers of copies are counted by hash and mapped; each of n copies adds 1 / n to
its grams, so no text is shuffled and the sums are whole.

Nulls: a null text is empty: no words, so it fails. A null language is a language of its
own (""), a null id is kept. Repeated rows are learned from each, or with clean once, and
judged alike. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm import _arrays, _shared
from wayfold.llm._text import SPAN, WORD_BYTES, Index, U, constants, cut, flat, grams, mix, points, sum_by, sums, words

ORDER = 4
FENCE = 3.0
#: A band reaches at least so far beyond its quartiles, also where a language's texts are few or alike.
LEAST = 0.05
ACCURACY = 10_000
#: Languages whose discounts or bands are broadcast at most (under 10 MB); more are joined by a shuffle.
LANGUAGES = 100_000
SALTS = 64
START, END = 2, 3
#: Characters of texts that count as symbols.
SYMBOLS = "#*$%&|<>"

_STEP = constants(ORDER + 1, 3001)
_CHAR = constants(2, 3002)


def _char_values(cp: np.ndarray) -> np.ndarray:
    return mix(cp.astype(U) * _CHAR[0] + _CHAR[1])


def _seed(lang: str) -> np.uint64:
    return U(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def _framed(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points with start marks and an end mark around each text, and each text's range."""
    cp, first = points(data, at)
    n, extra = len(at) - 1, ORDER
    out = np.full(len(cp) + extra * n, START, np.uint32)
    edge = first + extra * np.arange(n + 1)
    out[np.arange(len(cp)) + extra * np.repeat(np.arange(n), np.diff(first)) + ORDER - 1] = cp
    out[edge[1:] - 1] = END
    return out, edge


def _ends(edge: np.ndarray) -> np.ndarray:
    """Places of the characters that are predicted: all but the start marks."""
    marks = (edge[:-1, None] + np.arange(ORDER - 1)).reshape(-1)
    keep = np.ones(edge[-1], bool)
    keep[marks] = False
    return np.flatnonzero(keep)


def _gram(values: np.ndarray, end: np.ndarray, k: int, seed) -> np.ndarray:
    """Hash of the k characters up to each place."""
    out = np.full(len(end), U(k) * U(2) + U(1), U) * seed
    for j in range(k):
        out += values[end - k + 1 + j] * _STEP[j]
    return mix(out)


def _by_language(batch: pa.RecordBatch):
    lang = np.array([x or "" for x in batch.column("lang").to_pylist()], object)
    for name in sorted(set(lang)):
        yield name, np.flatnonzero(lang == name)


def _copies(docs: DataFrame, path: str, b: int) -> tuple:
    """Store the hashes that several rows have with their counts."""

    def count(batches):
        for batch in batches:
            yield _arrays.rows(*_arrays.counted(batch.column("hash").to_numpy().view(U)), b)

    return _arrays.sizes(_arrays.store(_arrays.run(docs.select("hash"), count, _arrays.BLOBS), path, b, least=2))


def _grams(docs: DataFrame, copies: tuple | None = None, failed: Callable | None = None) -> DataFrame:
    """lang, gram (ORDER characters) and its count. copies (what arrays() takes): of n rows of one hash, each counts 1 / n. failed: of measures, which texts are left out."""

    def count(batches):
        store = copies and _arrays.arrays(*copies)
        held: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def out():
            for name, (_, cps, n) in sorted(held.items()):
                text = np.ascontiguousarray(cps).astype("<u4").tobytes().decode("utf-32-le")
                for lo in range(0, len(n), 50_000):
                    hi = min(lo + 50_000, len(n))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * (hi - lo), pa.string()), pa.array([text[ORDER * i : ORDER * i + ORDER] for i in range(lo, hi)], pa.string()), pa.array(n[lo:hi])], ["lang", "gram", "n"])
            held.clear()

        for batch in _arrays.slices(batches):
            share = 1 / np.maximum(store.find(batch.column("hash").to_numpy().view(U))[1], 1) if copies else np.ones(batch.num_rows)
            if failed:
                use = np.flatnonzero(~failed(measures(*flat(batch.column("text")))))
                batch, share = batch.take(pa.array(use)), share[use]
            for name, rows in _by_language(batch):
                data, at = flat(batch.column("text").take(pa.array(rows)))
                for lo, hi in cut(at, SPAN):
                    cp, edge = _framed(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                    end = _ends(edge)
                    h = _gram(_char_values(cp), end, ORDER, _seed(name))
                    key = _arrays.counted(h)[0]
                    found = Index(key).find(h)[0]
                    n = np.bincount(found, np.repeat(share[rows[lo:hi]], np.diff(edge) - ORDER + 1), len(key))
                    place = np.empty(len(key), np.int64)
                    place[found] = end
                    cps = cp[place[:, None] + np.arange(1 - ORDER, 1)]
                    if name in held:
                        k, c, m = held[name]
                        key, cps, n = np.concatenate([k, key]), np.concatenate([c, cps]), np.concatenate([m, n])
                        order = np.argsort(key, kind="stable")
                        key = key[order]
                        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                        key, cps, n = key[first], cps[order][first], np.add.reduceat(n[order], first)
                    held[name] = key, cps, n
            if sum(len(x[0]) for x in held.values()) > 500_000:
                yield from out()
        yield from out()

    # the shares of a text's copies add up to 1 but for rounding
    return _arrays.run(docs, count, "lang string, gram string, n double").groupBy("lang", "gram").agg(F.round(F.sum("n")).cast("long").alias("n"))


def _discount(n: str) -> F.Column:
    return F.when(F.col(n) >= 3, F.col("d3")).when(F.col(n) == 2, F.col("d2")).when(F.col(n) == 1, F.col("d1")).otherwise(0.0)


def character_model(counts: DataFrame, used: list[DataFrame]) -> DataFrame:
    """used: takes the tables that it wrote and reads. lang, gram (1 to ORDER characters), logp (of its last character after the others) and logg (what it leaves to shorter contexts when it is the context), and gram "" with the unknown character's logp."""

    def written(df, name):
        used.append(_shared.written(df, name))
        return used[-1]

    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = written(levels[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "character-grams")
    few = counts.select("lang").distinct().count() <= LANGUAGES
    table, lower = [], None
    for k in range(1, ORDER + 1):
        c = levels[k]
        of = c.groupBy("lang").agg(*(F.sum((F.col("n") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)))
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        ratio = lambda i, num, den, other: F.when(F.col("n1") == 0, 0.0).when(F.col(den) == 0, other).otherwise(F.least(F.greatest(F.lit(i) - (i + 1) * y * F.col(num) / F.nullif(F.col(den), F.lit(0.0)), F.lit(0.0)), F.lit(float(i))))
        d = of.select("lang", ratio(1, "n2", "n1", 0.0).alias("d1"), ratio(2, "n3", "n2", 1.0).alias("d2"), ratio(3, "n4", "n3", 1.5).alias("d3"))
        c = c.join(F.broadcast(d) if few else d, "lang").withColumn("take", _discount("n"))  # a row a language
        context = c.groupBy("lang", F.substring("gram", 1, k - 1).alias("context")).agg(F.sum("n").alias("total"), (F.sum("take") / F.sum("n")).alias("free"), F.count(F.lit(1)).alias("kinds"))
        c = c.withColumn("context", F.substring("gram", 1, k - 1)).join(context, ["lang", "context"])
        own = (F.col("n") - F.col("take")) / F.col("total")
        if k == 1:
            p = c.select("lang", "gram", (own + F.col("free") / (F.col("kinds") + 1)).alias("p"))
            table.append(context.select("lang", F.lit("").alias("gram"), (F.col("free") / (F.col("kinds") + 1)).alias("p")))
        else:
            p = c.withColumn("suffix", F.substring("gram", 2, k - 1)).join(lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("low")), ["lang", "suffix"]).select("lang", "gram", (own + F.col("free") * F.col("low")).alias("p"))
            free = context.select("lang", F.col("context").alias("gram"), "free")
            table[-1] = table[-1].join(free, ["lang", "gram"], "full").select("lang", "gram", "p", "free")
        p = written(p, f"characters-{k}") if k < ORDER else p  # the last one is read once
        lower = p
        table.append(p)
    table[0] = table[0].withColumn("free", F.lit(None).cast("double")) if "free" not in table[0].columns else table[0]
    table[-1] = table[-1].withColumn("free", F.lit(None).cast("double"))
    out = table[0]
    for t in table[1:]:
        out = out.unionByName(t)
    return out.select("lang", "gram", F.log10("p").alias("logp"), F.coalesce(F.log10("free"), F.lit(0.0)).alias("logg"))


def _stored(model: DataFrame, path: str, b: int) -> tuple:
    def keyed(batches):
        for batch in batches:
            lang, text = batch.column("lang").to_pylist(), batch.column("gram").to_pylist()
            cp = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32)
            size = np.array([len(x) for x in text], np.int64)
            end = np.cumsum(size) - 1
            seeds = {x: _seed(x) for x in set(lang)}
            values, key = _char_values(cp), np.zeros(len(text), U)
            seed = np.array([seeds[x] for x in lang], U)
            for k in np.unique(size).tolist():
                rows = np.flatnonzero(size == k)
                key[rows] = _gram(values, end[rows], k, seed[rows])
            yield pa.RecordBatch.from_arrays([pa.array(_arrays.bucket(key, b).astype(np.int64)), pa.array(key.view(np.int64)), batch.column("logp"), batch.column("logg")], ["bucket", "key", "logp", "logg"])

    def save(batches):
        for i, held in _arrays.by_bucket(batches):
            key = np.array([r["key"] for r in held], np.int64).view(U)
            order = np.argsort(key, kind="stable")
            # a context that ends no gram has no probability of its own
            p = np.array([np.nan if r["logp"] is None else r["logp"] for r in held])
            _arrays.save(path, i, keys=key[order], logp=p[order], logg=np.array([r["logg"] for r in held])[order])
            yield pa.RecordBatch.from_pylist([{"bucket": i, "n": len(key)}])

    rows = _arrays.run(model, keyed, "bucket long, key long, logp double, logg double")
    return _arrays.sizes(_arrays.run(rows.repartition(1 << b, "bucket").sortWithinPartitions("bucket"), save, "bucket long, n long"))


def _score(store: _arrays.Arrays, data: np.ndarray, at: np.ndarray, lang: str) -> np.ndarray:
    """log10 probability of each text and its end."""
    seed = _seed(lang)
    out = np.zeros(len(at) - 1)
    for lo, hi in cut(at, SPAN):
        cp, edge = _framed(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        values, end = _char_values(cp), _ends(edge)

        def get(where, k, column):
            h = _gram(values, where, k, seed)  # noqa: B023
            key = _arrays.counted(h)[0]
            place, value = store.find(key, column)
            value = np.where(place < 0, np.nan, value)
            return value[Index(key).find(h)[0]] if len(h) else np.zeros(0)

        p = get(end, ORDER, "logp")
        missing = np.flatnonzero(np.isnan(p))
        p[missing] = 0
        for k in range(ORDER - 1, -1, -1):  # the longest gram that is known, and what each longer context leaves
            if not len(missing):
                break
            left = get(end[missing] - 1, k, "logg") if k else np.zeros(len(missing))
            p[missing] += np.where(np.isnan(left), 0, left)
            got = get(end[missing], k, "logp")
            found = ~np.isnan(got)
            p[missing[found]] += got[found]
            missing = missing[~found]
        out[lo:hi] = sum_by(np.searchsorted(end, edge), p)
    return out


def _ranges(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each range."""
    return mix(sums(data, constants(256, 12), s, e) + (e - s).astype(U) * _CHAR[0])


_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def measures(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    w = words(data, at, lower=False)
    rows = len(at) - 1
    text = w.text_of()
    own = mix(np.arange(1, rows + 1, dtype=U) * _CHAR[1])  # keeps texts apart
    # lines
    breaks = np.flatnonzero(data == 0x0A)
    start = np.unique(np.concatenate([at[:-1], breaks + 1]))
    start = start[start < len(data)]
    owner = np.searchsorted(at, start, "right") - 1
    end = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, start)], at[owner + 1]) if len(start) else start
    full = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, owner = start[full], end[full], owner[full]
    key = mix(_ranges(data, start, end) ^ own[owner]) if len(start) else np.zeros(0, U)
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[1:] = key[order][1:] == key[order][:-1]
    dup = np.bincount(owner[order][again], minlength=rows)
    # windows of three words
    g, first = grams(w, 3)
    row = np.repeat(np.arange(rows), np.diff(first))
    key = mix(g ^ own[row])
    s = np.sort(key)
    twice = s[1:][s[1:] == s[:-1]]
    twice = twice[np.flatnonzero(np.append(True, twice[1:] != twice[:-1]))] if len(twice) else twice
    hit = np.flatnonzero(Index(twice).find(key)[1])
    place = hit - first[:-1][row[hit]] + w.first[:-1][row[hit]]
    inside = np.zeros(len(w.hash), bool)
    for k in range(3):
        inside[place + k] = True
    lead = (data & 0xC0) != 0x80
    return {
        "n_words": w.count,
        "word_chars": sum_by(at, (WORD_BYTES["space"][data] & lead).astype(np.int64)),
        "n_symbols": sum_by(at, _SYMBOL[data].astype(np.int64)),
        "n_dup_lines": dup.astype(np.int64),
        "n_repeat_words": np.bincount(text[inside], minlength=rows).astype(np.int64),
    }


def _with_bands(measured: DataFrame, bands: DataFrame, few: bool) -> DataFrame:
    """Each row with its language's band. Rows are never gathered by language: few bands are broadcast, of more each is copied SALTS times."""
    if few:
        return measured.join(F.broadcast(bands), "lang", "left")
    salted = bands.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return measured.withColumn("salt", F.pmod("hash", F.lit(SALTS))).join(salted, ["lang", "salt"], "left").drop("salt")


def quality(docs: DataFrame, least_words: int = 50, most_repeated: int = 50, most_symbols: int = 10, fence: float = FENCE, clean: bool = False, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """id, the measures, log_perplexity (log10, a character), lower and upper (its language's band), base_failed (fewer than least_words words, or over most_repeated percent of them in repeated windows) and kept of every row. clean: learn once from each distinct text that passes these rules and has at most most_symbols symbols to 100 words; the band is of such texts too."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang")).withColumn("hash", F.xxhash64("lang", "text"))
    b = _arrays.bits(docs)
    path, again = _shared.folder(spark, "characters"), _shared.folder(spark, "copies")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def failed(m):  # of arrays or Columns
        return (m["n_words"] < least_words) | (100 * m["n_repeat_words"] > most_repeated * m["n_words"])

    def unfit(m):  # to learn from
        return failed(m) | (100 * m["n_symbols"] > most_symbols * m["n_words"])

    counts = _shared.written(_grams(docs, (again, b, _copies(docs, again, b)), unfit) if clean else _grams(docs), "character-grams")
    _shared.remove(spark, again)
    used = [counts]
    sizes = _stored(character_model(counts, used), path, b)
    _shared.drop(*used)

    def measure(batches):
        store = _arrays.arrays(path, b, sizes)
        for batch in _arrays.slices(batches):
            data, at = flat(batch.column("text"))
            m = measures(data, at)
            log, length = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for name, rows in _by_language(batch):
                part, off = flat(batch.column("text").take(pa.array(rows)))
                log[rows] = _score(store, part, off, name)
                length[rows] = sum_by(off, ((part & 0xC0) != 0x80).astype(np.int64)) + 1
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("lang"), batch.column("hash"), *(pa.array(m[x]) for x in names), pa.array(-log / length)], ["id", "lang", "hash", *names, "log_perplexity"])

    schema = f"id {docs.schema['id'].dataType.simpleString()}, lang string, hash long, {', '.join(f'{x} long' for x in names)}, log_perplexity double"
    columns = {x: F.col(x) for x in names}
    measured = _arrays.run(docs, measure, schema).withColumns({"base_failed": failed(columns), "unfit": unfit(columns)})
    measured = _shared.written(measured, "quality")
    _shared.remove(spark, path)
    texts = measured.where(~F.col("unfit" if clean else "base_failed")).groupBy("lang", "hash").agg(F.min("log_perplexity").alias("log_perplexity"))
    q, reach = F.percentile_approx("log_perplexity", [0.25, 0.75], ACCURACY), F.greatest(fence * (F.col("q")[1] - F.col("q")[0]), F.lit(LEAST))
    bands = texts.groupBy("lang").agg(q.alias("q")).select("lang", (F.col("q")[0] - reach).alias("lower"), (F.col("q")[1] + reach).alias("upper"))
    bands = _shared.written(bands, "quality-bands")  # a row a language
    kept = ~F.col("base_failed") & F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(False))
    return _with_bands(measured, bands, bands.count() <= LANGUAGES).select(F.col("id").alias(id), *names, "log_perplexity", "lower", "upper", "base_failed", kept.alias("kept"))
