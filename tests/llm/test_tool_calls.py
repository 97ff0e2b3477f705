import json

from wayfold.llm.tool_calls import levels, link

CALLS = "conv_id long, call_id string, position long, name string, arguments string, parents array<string>"


def run(spark, calls, results=()):
    schemas = spark.createDataFrame([("f", "a", "integer", True), ("f", "b", "number", False), ("f", "c", "object", None), (None, "x", "string", True)], "name string, field string, type string, required boolean")
    out = link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(list(results), "conv_id long, call_id string, position long, content string"), schemas)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    return out.collect()


def test_arguments_and_results(spark):
    cases = {
        "ok": ('{"c": {"z": 1, "a": [2, {"y": null, "b": "é\\n"}]}, "a": 3, "b": 1}', []),
        "kinds": ('{"a": "3", "b": true, "c": []}', ["type a", "type b", "type c"]),
        "missing": ('{"d": 1, "b": 1.5}', ["missing a", "unknown d"]),
        "nullfield": ('{"a": null}', ["type a"]),
        "array": ("[1]", ["not an object"]),
        "broken": ('{"a": ', ["not an object"]),
        "none": (None, ["not an object"]),
    }
    calls = [(1, k, i, "f", v[0], None) for i, (k, v) in enumerate(cases.items())] + [(1, "tool", 50, "g", "{}", None), (None, "ok", 51, "f", '{"a":1}', None), (1, None, 52, None, '{"a":1}', None), (2, "ok", 1, "f", '{"a":1}', None), (2, "ok", 1, "f", '{"a":1}', None), (3, "late", 9, "f", '{"a":1}', None)]
    results = [(1, "ok", 90, "second"), (1, "ok", 80, "first"), (2, "other", 1, "x"), (None, "ok", 1, "y"), (3, "late", 4, "early")]
    rows = run(spark, calls, results)
    orphans = {(r.conv_id, r.call_id): (r.n_results, r.result) for r in rows if r.status == "orphan"}
    assert orphans == {(2, "other"): (1, "x"), (None, "ok"): (1, "y")}
    rows = [r for r in rows if r.status != "orphan"]
    assert len(rows) == len(calls)
    got = {(r.conv_id, r.call_id): r for r in rows}
    for k, (text, errors) in cases.items():
        r = got[1, k]
        assert r.errors == errors, k
        assert r.arguments == (None if errors == ["not an object"] else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False))
    assert (got[1, "ok"].status, got[1, "ok"].n_results, got[1, "ok"].result) == ("linked", 2, "first")
    assert got[1, "tool"].errors == ["unknown tool"] and got[1, "missing"].status == "invalid"
    assert got[None, "ok"].status == got[2, "ok"].status == "unanswered" and got[3, "late"].status == "early"


def test_topological_order(spark):
    a = '{"a":1}'
    calls = [(1, "x", 1, "f", a, ["z"]), (1, "y", 2, "f", a, ["x", "z", "gone"]), (1, "z", 3, "f", a, []), (1, "free", 4, "f", a, None)]
    calls += [(2, "p", 1, "f", a, ["q"]), (2, "q", 2, "f", a, ["p"]), (2, "r", 3, "f", a, ["q"]), (2, "s", 4, "f", a, [])]
    calls += [(3, "m", 1, "f", a, []), (3, "n", 2, "f", a, ["m"]), (4, "self", 1, "f", a, ["self"])]
    rows = run(spark, calls)
    got = {r.call_id: (r.level, r.status) for r in rows}
    assert [got[k][0] for k in ("z", "x", "y", "free")] == [0, 1, 2, 0]
    assert all(got[k] == (None, "cyclic") for k in ("p", "q", "r", "self")) and got["s"][0] == 0
    assert (got["m"][0], got["n"][0]) == (0, 1)
    assert {r.call_id: r.missing_parents for r in rows if r.missing_parents} == {"y": 1}


def plain(calls):
    """Longest chains by repeated peeling."""
    parents = {}
    for conv, call, _, _, _, up in calls:
        if conv is not None and call is not None:
            parents.setdefault((conv, call), set()).update((conv, p) for p in up or [])
    parents = {k: {p for p in v if p in parents} for k, v in parents.items()}
    level = {}
    while free := [k for k, v in parents.items() if k not in level and all(p in level for p in v)]:
        level |= {k: max((level[p] + 1 for p in parents[k]), default=0) for k in free}
    return {k: level.get(k) for k in parents}


def test_levels_equal_brute_force_at_every_size(spark):
    import random

    rnd = random.Random(6)
    calls = []
    for conv in range(30):
        n = rnd.randint(1, 14)
        for i in range(n):
            up = [f"c{rnd.randrange(n)}" for _ in range(rnd.choice([0, 1, 1, 2]))] if conv % 3 else [f"c{j}" for j in range(i) if rnd.random() < 0.3]
            calls.append((conv, f"c{i}", rnd.choice([i, i, 5, None]), "f", "{}", up if rnd.random() < 0.9 else None))
    calls += [(31, None, 1, "f", "{}", ["x"]), (None, "a", 1, "f", "{}", ["a"]), (32, "r", 1, "f", "{}", ["s", None]), (32, "r", 2, "f", "{}", []), (32, "s", 0, "f", "{}", [])]
    df = spark.createDataFrame(calls, CALLS)
    want = plain(calls)
    assert len({x for x in want.values()}) > 4 and None in want.values()
    for most in (8192, 6, 0):  # all in rows, some in rounds, all in rounds
        assert {(r.conv_id, r.call_id): r.level for r in levels(df, most).collect()} == want


def test_a_long_chain_takes_bounded_jobs(spark):
    n = 5000
    chain = spark.range(n).selectExpr("1L as conv_id", "concat('c', id) as call_id", "id as position", "array(concat('c', id - 1)) as parents")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    got = {r.call_id: r.level for r in levels(chain).collect()}
    assert got == {f"c{i}": i for i in range(n)}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) - before < 60


def test_empty(spark):
    assert run(spark, []) == []


def test_clashing_columns(spark):
    calls = spark.createDataFrame([(1, "a", 1, "f", '{"a":1}', None, 5, "x", 7)], CALLS + ", level int, status string, calls int")
    results = spark.createDataFrame([(1, "a", 2, "ok", "y", 3)], "conv_id long, call_id string, position long, content string, name string, n_results int")
    schemas = spark.createDataFrame([("f", "a", "integer", True, 1)], "name string, field string, type string, required boolean, position int")
    assert [(r.level, r.status, r.result) for r in link(calls, results, schemas).collect()] == [(0, "linked", "ok")]
