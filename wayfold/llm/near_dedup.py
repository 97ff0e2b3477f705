"""Near duplicates by bottom-k sketches of one hash function, exact in the end.

1. Each text's set of word shingles is hashed once. Texts with the same set (sums of two
   hashes and its size) are one class.
2. A class keeps the k least hashes of its set. Over all classes the retained values'
   frequencies are counted; each class enters the inverted lists of its rarest values
   only: two sets with similarity t share so many retained values that the rarest
   (1 - t + slack) k of both have one in common. Values of boilerplate that thousands
   share sort last and open no list. slack = 1 opens lists for all retained values.
3. A list's least class is its head. The lists give the overlap of each (head, member)
   pair; the similarity estimated on the k least values of the union drops those that are
   more than slack below t; of the others whole sets are shipped, a head's once for MEMBERS
   members, and their Jaccard is computed exactly. So a group of copies of one text costs
   a comparison a copy.
4. Open are pairs of members of one list that no link so far connects. Such a list is cut
   into blocks by hash, those of its largest component apart, as they need no comparison
   with each other; for each other two blocks the sketches are compared (a pair only in
   the first of its common lists), sets are shipped of classes whose estimate passes, and
   a spanning forest of their exact links comes back. Lists never merge: texts that only
   share single values through others are not compared.
5. Components of these links give each text its least reachable id.

With k = 64 and slack = 0.25 (over 5 standard deviations of an estimate) a linked pair is
missed with a chance below 1e-6. Sets are compared by 64-bit hashes of shingles: in a pair
of sets of 10,000 shingles two different ones agree with a chance of 5e-12.

Nulls: a null or empty text has no set (0 shingles) and is linked with nothing; a row with a
null id is linked with nothing, is kept and has a null component. Rows that repeat an id
are judged each by their own text. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm import _arrays, _shared
from wayfold.llm._text import Index, U, constants, flat, grams, mix, words
from wayfold.llm.components import components

K = 64
#: How much further than expected the share of unshared retained values may lie.
SLACK = 0.25
#: Members compared with one copy of their head's set; classes of an open list, and shingles of these, in a block.
MEMBERS = 256
BLOCK = 512
SHINGLES = 1 << 20

_SALT = constants(1, 4242)[0]
_NONE = ~U(0)


def _sets(batch: pa.RecordBatch, n: int) -> list[np.ndarray]:
    g, first = grams(words(*flat(batch.column("text"))), n, short=True)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        s = np.sort(g[a:b])
        out.append(s[np.flatnonzero(np.append(True, s[1:] != s[:-1]))] if b > a else s)
    return out


def _sums(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array([f(s).sum(dtype=U) for s in sets], U).view(np.int64) for f in (lambda s: s, lambda s: mix(s ^ _SALT)))


def padded(sketches: list[bytes], k: int) -> np.ndarray:
    out = np.full((len(sketches), k), _NONE, U)
    for row, s in zip(out, sketches, strict=True):
        row[: len(s) // 8] = np.frombuffer(s, U)
    return out


def passes(a: np.ndarray, b: np.ndarray, part: int, whole: int, slack: float) -> np.ndarray:
    """Whether the similarity of each two sketches (rows, sorted and padded), estimated on the k least values of their union, is at least part / whole - slack."""
    k = a.shape[1]
    out = np.zeros(len(a), bool)
    for lo in range(0, len(a), 4096):
        both = np.sort(np.concatenate([a[lo : lo + 4096], b[lo : lo + 4096]], axis=1), axis=1)
        twice = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _NONE)
        fresh = both != _NONE
        fresh[:, 1:] &= ~twice
        rank = np.cumsum(fresh, axis=1, dtype=np.int32)
        shared = (twice & (rank[:, 1:] <= k)).sum(1)
        out[lo : lo + 4096] = whole * shared >= (part - slack * whole) * np.minimum(rank[:, -1], k)
    return out


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two sets have in common."""
    n = len(sets)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    uniq, count = _arrays.counted(values)
    uniq, count = uniq[count > 1], count[count > 1]
    out = np.full((n, n), int((count == n).sum()), np.int64)
    uniq = uniq[count < n]
    at, there = Index(uniq).find(values)
    owner, at = owner[there], at[there]
    wide = 4096
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for lo in range(0, len(uniq), wide):
        a, b = np.searchsorted(at, [lo, lo + wide])
        m = np.zeros((n, min(wide, len(uniq) - lo)), np.float32)
        m[owner[a:b], at[a:b] - lo] = 1
        out += (m @ m.T).astype(np.int64)
    return out


def candidates(sketches: list[bytes], sizes: np.ndarray, apart: np.ndarray, part: int, whole: int, k: int, slack: float) -> np.ndarray:
    """Of the pairs that apart (a symmetric matrix) marks, those whose sizes and union sketch allow the similarity."""
    kept = np.minimum(sizes, k)
    near = whole * shared([np.frombuffer(s, U) for s in sketches]) >= (part - slack * whole) * np.minimum(kept[:, None], kept[None, :])
    near &= apart & (np.minimum(sizes[:, None], sizes[None, :]) * whole >= part * np.maximum(sizes[:, None], sizes[None, :]))
    i, j = np.nonzero(np.triu(near, 1))
    rows = padded(sketches, k)
    ok = np.concatenate([passes(rows[i[lo : lo + 65536]], rows[j[lo : lo + 65536]], part, whole, slack) for lo in range(0, max(len(i), 1), 65536)])
    near[:] = False
    near[i[ok], j[ok]] = near[j[ok], i[ok]] = True
    return near


def forest(sets: list[np.ndarray], apart: np.ndarray, part: int, whole: int) -> np.ndarray:
    """For each set the least place in sets that links of similarity part / whole between pairs that apart marks reach."""
    n = len(sets)
    own = np.arange(n)
    some = np.flatnonzero(apart.any(1))
    if not len(some):
        return own
    both, size = shared([sets[i] for i in some.tolist()]), np.array([len(sets[i]) for i in some.tolist()])
    linked = apart[np.ix_(some, some)] & (whole * both >= part * (size[:, None] + size[None, :] - both))
    label = own[some]
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], n).min(1))
        if (least == label).all():
            break
        label = least
    own[some] = label
    return own


def _units(batches, key: list[str]):
    """Rows of each unit (lists by column) of batches sorted by its key."""
    now, held = None, []
    for batch in batches:
        names = batch.schema.names
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = tuple(row[names.index(c)] for c in key)
            if own != now and held:
                yield dict(zip(names, zip(*held, strict=True), strict=True))
                held = []
            now = own
            held.append(row)
    if held:
        yield dict(zip(names, zip(*held, strict=True), strict=True))


def _blocks(df: DataFrame) -> DataFrame:
    """Rows of open lists with their block, once for each block that theirs is compared with: i <= j. Blocks from small on hold the list's largest component and are not compared with each other."""
    away = F.col("root") != F.col("big")
    block = F.when(away, F.pmod(F.xxhash64("node"), "small")).otherwise(F.col("small") + F.pmod(F.xxhash64("node"), "large"))
    last = F.when(away, F.col("small") + F.col("large") - 1).otherwise(F.col("small") - 1)
    df = df.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return df.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "small", "large", "big")


def near_duplicates(docs: DataFrame, part: int = 80, whole: int = 100, n: int = 5, k: int = K, slack: float = SLACK, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, component_id and kept of every row; sets are linked if whole * intersection >= part * union. The id is an integer."""
    spark = docs.sparkSession
    kind = docs.schema[id].dataType
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    b = _arrays.bits(docs)

    def sketch(batches):
        for batch in _arrays.slices(batches):
            sets = _sets(batch, n)
            h1, h2 = _sums(sets)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1), pa.array(h2), pa.array([s[:k].tobytes() for s in sets], pa.binary())], ["id", "n", "h1", "h2", "sketch"])

    every = _shared.written(_arrays.run(docs, sketch, "id long, n long, h1 long, h2 long, sketch binary"), "near-sets")
    # a class has a number of its own, given where it is written: ids may repeat
    grouped = every.where("n > 0 and id is not null").groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.first("sketch").alias("sketch"))
    classes = _shared.written(grouped.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    entries = _lists(classes, b, 1 - part / whole + slack)
    heads = _shared.written(entries.groupBy("value").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1"), "near-heads")
    one = _with_heads(docs, classes, entries, heads, b, n, part, whole, k, slack)
    linked = _joined(one)
    more = _open(docs, classes, entries, heads, linked, b, n, part, whole, k, slack)
    if more is not None:
        again = _joined(one.unionByName(more))
        _shared.drop(linked, more)
        linked = again
    _shared.drop(entries, heads, one)
    roots = _shared.written(classes.select("node", "h1", "h2", "n", "rep").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node"), "near-roots")
    least = _shared.written(roots.groupBy("root").agg(F.min("rep").alias("component")), "near-least")
    reps = _shared.written(roots.join(least, "root").select("h1", "h2", "n", "component"), "near-reps")
    rows = every.select("id", "n", "h1", "h2")
    alone = F.expr("n = 0 or id is null")
    out = rows.where(~alone).join(reps, ["h1", "h2", "n"], "left").select("id", "n", "component").unionByName(rows.where(alone).select("id", "n", F.col("id").alias("component")))
    out = _shared.written(
        out.select(F.col("id").cast(kind).alias(id), F.col("n").alias("n_shingles"), F.col("component").cast(kind).alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept")),
        "near-duplicates",
    )
    _shared.drop(every, classes, linked, roots, least, reps)
    return out


def _joined(links: DataFrame) -> DataFrame:
    """The components of links, written."""
    found = components(links, "near-links")
    out = _shared.written(found, "near-components")
    _shared.drop(found.edges)
    return out


def _lists(classes: DataFrame, b: int, share: float) -> DataFrame:
    """value and node: the inverted lists, written."""

    def count(batches):
        for batch in batches:
            yield _arrays.rows(*_arrays.counted(np.frombuffer(b"".join(batch.column("sketch").to_pylist()), U)), b)

    path = _shared.folder(classes.sparkSession, "near-values")
    sizes = _arrays.sizes(_arrays.store(_arrays.run(classes.select("sketch"), count, _arrays.BLOBS), path, b, least=2))

    def rare(batches):
        frequent = _arrays.arrays(path, b, sizes)
        for batch in batches:
            sketches = batch.column("sketch").to_pylist()
            size = np.array([len(s) // 8 for s in sketches])
            if not len(size):
                continue
            value = np.frombuffer(b"".join(sketches), U)
            row = np.repeat(np.arange(len(size)), size)
            uniq = _arrays.counted(value)[0]
            often = frequent.find(uniq)[1][Index(uniq).find(value)[0]]
            order = np.lexsort((value, often, row))
            value, often = value[order], often[order]
            rank = np.arange(len(value)) - (np.cumsum(size) - size)[row]
            use = (rank < np.ceil(share * size)[row] + 1) & (often > 1)
            yield pa.RecordBatch.from_arrays([pa.array(value[use].view(np.int64)), pa.array(batch.column("node").to_numpy()[row[use]])], ["value", "node"])

    out = _shared.written(_arrays.run(classes.select("node", "sketch"), rare, "value long, node long"), "near-lists")
    _shared.remove(classes.sparkSession, path)
    return out


def _shipped(docs: DataFrame, classes: DataFrame, nodes: DataFrame, b: int, n: int) -> tuple[DataFrame, tuple[str, str]]:
    """node and set of these classes, made again from the texts of their least ids, which are looked up in arrays in the shared folder; and the folders to be removed when the sets have been used."""
    of = _shared.written(classes.select("node", "rep", "h1").join(nodes.select("node").distinct(), "node"), "near-wanted")
    path = _shared.folder(docs.sparkSession, "near-members")

    def ids(batches):
        for batch in batches:
            yield _arrays.rows(*_arrays.counted(batch.column("rep").to_numpy().view(U)), b)

    members = _arrays.sizes(_arrays.store(_arrays.run(of.select("rep"), ids, _arrays.BLOBS), path, b))

    def sets(batches):
        wanted = _arrays.arrays(path, b, members)
        for batch in _arrays.slices(batches):
            key = batch.column("id").fill_null(0).to_numpy().view(U)
            there = (wanted.find(key)[0] >= 0) & ~np.asarray(batch.column("id").is_null())
            if there.any():
                batch = batch.filter(pa.array(there))
                found = _sets(batch, n)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_sums(found)[0]), pa.array([s.tobytes() for s in found], pa.binary())], ["rep", "h1", "set"])

    return _arrays.run(docs, sets, "rep long, h1 long, set binary").join(of, ["rep", "h1"]).select("node", "set"), (path, of.written_to)


def _with_heads(docs, classes, entries, heads, b: int, n: int, part: int, whole: int, k: int, slack: float) -> DataFrame:
    """Links (a, b) between the heads of lists and their members, written."""
    pairs = entries.join(heads.select("value", "head"), "value").where("node != head").groupBy("head", "node").agg(F.count(F.lit(1)).alias("overlap"))
    pairs = _shared.written(pairs, "near-overlaps")
    own = classes.select("node", "n", "sketch")

    def estimate(batches):
        for batch in batches:
            x, y = batch.column("n").to_numpy(), batch.column("m").to_numpy()
            use = np.minimum(x, y) * whole >= part * np.maximum(x, y)
            some = batch.filter(pa.array(use))
            ok = passes(padded(some.column("sketch").to_pylist(), k), padded(some.column("other").to_pylist(), k), part, whole, slack)
            yield some.select(["head", "node"]).filter(pa.array(ok))

    first = pairs.select("head", "node").join(own.select(F.col("node").alias("head"), F.col("n").alias("m"), F.col("sketch").alias("other")), "head")
    passed = _shared.written(_arrays.run(first.join(own, "node").select("head", "node", "n", "m", "sketch", "other"), estimate, "head long, node long"), "near-pairs")
    blocks = _shared.written(passed.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("long").alias("blocks")), "near-blocks")
    members = passed.join(blocks, "head").select("head", F.pmod(F.xxhash64("node"), "blocks").alias("block"), "node", F.lit(1).alias("turn"))
    leads = blocks.select("head", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("head").alias("node"), F.lit(0).alias("turn"))
    units = members.unionByName(leads)
    sets, used = _shipped(docs, classes, units, b, n)

    def verify(batches):
        now, lead = None, None
        for batch in batches:
            a, z = [], []
            columns = [batch.column(c).to_pylist() for c in ("head", "block", "turn", "node")]
            for head, block, turn, node, s in zip(*columns, batch.column("set"), strict=True):
                own = np.frombuffer(s.as_buffer(), U)
                if turn == 0:
                    now, lead = (head, block), own.copy()
                elif (head, block) == now:
                    big, small = (lead, own) if len(lead) > len(own) else (own, lead)
                    both = int((big[np.minimum(np.searchsorted(big, small), len(big) - 1)] == small).sum())
                    if whole * both >= part * (len(big) + len(small) - both):
                        a.append(head)
                        z.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])

    dealt = units.join(sets, "node").repartition(F.col("head"), F.col("block")).sortWithinPartitions("head", "block", "turn")
    out = _shared.written(_arrays.run(dealt.select("head", "block", "turn", "node", "set"), verify, "a long, b long"), "near-links")
    for path in used:
        _shared.remove(docs.sparkSession, path)
    _shared.drop(pairs, passed, blocks)
    return out


def _open(docs, classes, entries, heads, linked, b: int, n: int, part: int, whole: int, k: int, slack: float) -> DataFrame | None:
    """Links between members of one list that linked leaves in different components, written; None if no list has such."""
    rest = entries.join(heads.where("size > 2"), "value").where("node != head").select("value", "node").join(linked, "node", "left").select("value", "node", F.coalesce("root", "node").alias("root"))
    every = rest = _shared.written(rest.join(classes.select("node", "n"), "node"), "near-rest")
    split = lambda c, n: F.greatest(F.ceil(F.col(c) / BLOCK), F.ceil(F.col(n) / SHINGLES), F.lit(1)).cast("long")
    parts = rest.groupBy("value", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    most = F.max(F.struct("c", "n", "root"))
    lists = parts.groupBy("value").agg(most.alias("m"), F.count(F.lit(1)).alias("roots"), F.sum("c").alias("c"), F.sum("n").alias("n")).where("roots > 1")
    lists = lists.select("value", F.col("m.root").alias("big"), F.col("m.c").alias("lc"), F.col("m.n").alias("ln"), (F.col("c") - F.col("m.c")).alias("sc"), (F.col("n") - F.col("m.n")).alias("sn"))
    lists = _shared.written(lists.select("value", "big", split("sc", "sn").alias("small"), split("lc", "ln").alias("large")), "near-open-lists")
    if lists.isEmpty():
        _shared.drop(rest, lists)
        return None
    rest = _shared.written(rest.join(lists, "value"), "near-open-members")
    own = rest.groupBy("node").agg(F.sort_array(F.collect_set("value")).alias("values"))  # at most k
    own = _shared.written(own.join(classes.select("node", "sketch"), "node"), "near-open-sketches")
    dealt = _blocks(rest).join(own, "node").repartition(F.col("value"), F.col("i"), F.col("j")).sortWithinPartitions("value", "i", "j")

    def apart(unit):
        root, block = np.array(unit["root"]), np.array(unit["block"])
        out = root[:, None] != root[None, :]
        return out & (block[:, None] != block[None, :]) if unit["i"][0] != unit["j"][0] else out

    def compare(batches):
        for unit in _units(batches, ["value", "i", "j"]):
            some = apart(unit)
            # a pair belongs to the first of its common open lists
            of: dict[int, list[int]] = {}
            for row, values in enumerate(unit["values"]):
                for v in values:
                    if v < unit["value"][0]:
                        of.setdefault(v, []).append(row)
            for rows in of.values():
                if len(rows) > 1:
                    some[np.ix_(rows, rows)] = False
            if some.any():
                ok = candidates(list(unit["sketch"]), np.array(unit["n"]), some, part, whole, k, slack).any(1)
                yield pa.RecordBatch.from_pydict({c: pa.array([x for x, y in zip(unit[c], ok.tolist(), strict=True) if y], pa.int64()) for c in ("value", "i", "j", "block", "node", "root")})

    names = ["value", "i", "j", "block", "node", "root"]
    found = _shared.written(_arrays.run(dealt.select(*names, "n", "sketch", "values"), compare, ", ".join(f"{c} long" for c in names)), "near-open")
    sets, used = _shipped(docs, classes, found, b, n)

    def verify(batches):
        for unit in _units(batches, ["value", "i", "j"]):
            rows = list({x: i for i, x in enumerate(unit["node"])}.values())  # an id that repeats brings its set again
            unit = {c: [x[i] for i in rows] for c, x in unit.items()}
            sets = [np.frombuffer(s, U) for s in unit["set"]]
            size = np.array([len(s) for s in sets])
            label = forest(sets, apart(unit) & (np.minimum(size[:, None], size[None, :]) * whole >= part * np.maximum(size[:, None], size[None, :])), part, whole)
            node = np.array(unit["node"])
            off = np.flatnonzero(label != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[off]), pa.array(node[label[off]])], ["a", "b"])

    sent = found.join(sets, "node").repartition(F.col("value"), F.col("i"), F.col("j")).sortWithinPartitions("value", "i", "j")
    out = _shared.written(_arrays.run(sent.select(*names, "set"), verify, "a long, b long"), "near-links")
    for path in used:
        _shared.remove(docs.sparkSession, path)
    _shared.drop(every, rest, lists, own, found)
    return out
