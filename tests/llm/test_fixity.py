import hashlib

from wayfold.llm import fixity
from wayfold.llm.fixity import audit, records, tree

SCHEMA = "file long, offset long, hash string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_roots(rows):
    level = {}
    for f, o, h in rows:
        if f is not None and o is not None:
            level.setdefault(f, []).append((o, h or ""))
    top = max(o // fixity.RANGE for v in level.values() for o, _ in v)
    width, first = fixity.RANGE, True
    while first or top:
        top = top // fixity.FANOUT if not first else top
        out = {}
        for f, v in level.items():
            groups = {}
            for o, h in sorted(v):
                groups.setdefault(o // width, []).append(f"{o}:{h};")
            out[f] = [(k, sha("".join(x))) for k, x in groups.items()]
        level, width, first = out, fixity.FANOUT, False
        if top == 0 and all(k == 0 for v in level.values() for k, _ in v):
            break
    return {f: v[0][1] for f, v in level.items()}


def test_finds_exactly_what_differs(spark):
    rows = [(f, i * 997, sha(f"{f} {i}")) for f in range(3) for i in range(0, 4000 * (f == 1) + 70)]
    rows += [(None, 5, "x"), (2, None, "y"), (2, 3, None)]
    other = dict(((f, o), h) for f, o, h in rows if f is not None and o is not None)
    other[0, 997] = "changed"
    del other[1, 997 * 4000]
    other[1, 5] = "added"
    other[1, 997 * 17] = None
    other[2, 3] = "now known"
    other[7, 0] = "a new file"
    one = tree(spark.createDataFrame(rows, SCHEMA))
    two = tree(spark.createDataFrame([(f, o, h) for (f, o), h in other.items()], SCHEMA))
    assert {r.file: r.hash for r in one[-1].collect()} == brute_roots(rows)
    got = {(r.file, r.offset): (r.hash, r.other_hash) for r in audit(one, two).collect()}
    assert set(got) == {(0, 997), (1, 997 * 4000), (1, 5), (1, 997 * 17), (2, 3), (7, 0)}
    assert got[1, 997 * 4000][1] is None and got[1, 5] == (None, "added") and got[7, 0] == (None, "a new file")
    assert audit(one, one).count() == 0


def test_records_nulls_and_empty(spark):
    pages = [(1, "http://a", "é" * 10), (0, None, None), (None, "u", "h"), (1, "http://a", "é" * 10), (1500, "b", "x" * 100_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("hash", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    got = sorted((r.file, r.offset, r.length, r.page_id, r.hash) for r in records(df).collect())
    text = lambda u, h: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {u}\r\nContent-Length: {len(h.encode())}\r\n\r\n{h}\r\n\r\n"
    at, want = {}, []
    for i, u, h in sorted((p for p in pages if p[0] is not None), key=lambda p: p[0]):
        t = text(u or "", h or "")
        f = i // 1000
        want.append((f, at.get(f, 0), len(t.encode()), i, sha(t)))
        at[f] = at.get(f, 0) + len(t.encode())
    assert got == want
    none = tree(records(df).drop("page_id").limit(0))
    assert audit(none, none).count() == 0
