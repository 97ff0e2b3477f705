"""Tool-call linking with DataFrame functions only.

Calls and results are joined by conversation and call identifier. Results are reduced to
the first one and their number before the join, so however often an identifier repeats, a
call stays one row; Spark splits what a frequent identifier holds.

Calls are ordered topologically: by level, then position. A call's level is the longest
chain of parents before it, whatever the positions say. A conversation of up to CALLS calls
is gathered to one row of places and levelled by array functions, in one pass where calls
follow their parents and otherwise in as many as parents stand behind, at most WORK steps;
larger conversations take a round of joins for each level, with the same result. A call on
a cycle, or after one, gets a null level.

Arguments are parsed as VARIANT, checked against the tool's schema (required fields, types,
unknown fields) and written as canonical JSON: keys sorted, no spaces, numbers normalised.

Nulls: a call without identifier or conversation links to nothing; null or broken argument
JSON is "not an object"; a null parent list is empty, a null parent none; parents that don't
exist are ignored and counted. A null position comes last and, like equal ones, changes no
level. Repeated rows of an identifier stay rows, with the level by all their parents. Results
without a call are kept as rows of their own. Empty tables give no rows. Extra columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm import _shared

KEY = ["conv_id", "call_id"]
#: Calls of a conversation that is gathered to a row, and steps (passes times calls and edges) taken there at most.
CALLS = 8192
WORK = 1 << 20


def _peeled(calls: F.Column, passes: F.Column) -> F.Column:
    """Levels of a conversation's calls, an array of structs with parents (places in the array): each pass gives a level to every call whose parents have one, in order, so parents that stand before their calls take no further pass. What a cycle holds back stays null."""

    def once(state):
        def add(done, call):
            of = F.transform(call["parents"], lambda p: F.coalesce(F.get(done, p), F.get(state["levels"], p)))
            own = F.when(F.forall(of, lambda x: x.isNotNull()), F.coalesce(F.array_max(of) + 1, F.lit(0).cast("long")))
            return F.array_append(done, F.coalesce(F.get(state["levels"], F.size(done)), own))

        found = F.aggregate(calls, F.array().cast("array<long>"), add)
        return F.struct(found.alias("levels"), (found == state["levels"]).alias("done"))

    first = F.struct(F.array_repeat(F.lit(None).cast("long"), F.size(calls)).alias("levels"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1).cast("long"), passes), first, lambda s, _: F.when(s["done"] | F.forall(s["levels"], lambda x: x.isNotNull()), s).otherwise(once(s)))["levels"]


def _in_rounds(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Levels of large conversations: a round of joins for each level, each written to the shared folder."""
    todo, edges = _shared.written(ids.select(*KEY), "call-todo"), _shared.written(edges.select(*KEY, "parent"), "call-edges")
    parts, level = [], 0
    while not todo.isEmpty():
        free = _shared.written(todo.join(edges.select(*KEY).distinct(), KEY, "left_anti").withColumn("level", F.lit(level).cast("long")), "call-free")
        if free.isEmpty():
            break
        old = todo, edges
        edges = _shared.written(edges.join(free.select("conv_id", F.col("call_id").alias("parent")), ["conv_id", "parent"], "left_anti"), "call-edges")
        todo = _shared.written(todo.join(free, KEY, "left_anti"), "call-todo")
        _shared.drop(*old)
        parts.append(free)
        level += 1
    out = todo.withColumn("level", F.lit(None).cast("long"))
    for part in parts:
        out = out.unionByName(part)
    return out


def levels(calls: DataFrame, most: int = CALLS) -> DataFrame:
    """conv_id, call_id, level (calls in the longest chain of parents before it; null on a cycle or after one) and missing_parents of every identifier. Conversations of at most `most` calls are gathered to a row each, larger ones take rounds."""
    named = calls.where("conv_id is not null and call_id is not null")
    ids = _shared.written(named.groupBy(*KEY).agg(F.min("position").alias("position")), "call-ids")
    given = named.select(*KEY, F.explode("parents").alias("parent")).where("parent is not null").distinct()
    edges = given.join(ids.select("conv_id", F.col("call_id").alias("parent"), F.col("position").alias("at"), F.lit(True).alias("there")), ["conv_id", "parent"], "left")
    edges = _shared.written(edges.join(ids, KEY), "call-parents")
    missing = edges.where("there is null").groupBy(*KEY).agg(F.count(F.lit(1)).alias("missing_parents"))
    edges = edges.where("there")
    # the order of calls in a row: by position, nulls last, then identifier
    late = F.expr("coalesce(at > position or (at <=> position and parent >= call_id) or (at is null and position is not null), false)")
    n = ids.groupBy("conv_id").agg(F.count(F.lit(1)).alias("calls"))
    e = edges.groupBy("conv_id").agg(F.count(F.lit(1)).alias("edges"), F.sum(late.cast("long")).alias("late"))
    size = n.join(e, "conv_id", "left").select("conv_id", F.coalesce("late", F.lit(0)).alias("late"), (F.coalesce("edges", F.lit(0)) + F.col("calls")).alias("load"), "calls")
    size = size.withColumn("small", (F.col("calls") <= most) & (F.col("load") <= 4 * most) & ((F.col("late") + 1) * F.col("load") <= WORK))
    size = _shared.written(size, "call-sizes")
    few = size.where("small").select("conv_id", (F.col("late") + 1).alias("passes"))
    place = Window.partitionBy("conv_id").orderBy(F.col("position").asc_nulls_last(), "call_id")
    rows = _shared.written(ids.join(few, "conv_id").withColumn("place", (F.row_number().over(place) - 1).cast("int")), "call-places")
    of = edges.join(rows.select("conv_id", F.col("call_id").alias("parent"), F.col("place").alias("up")), ["conv_id", "parent"]).groupBy(*KEY).agg(F.collect_list("up").alias("parents"))
    whole = rows.join(of, KEY, "left").groupBy("conv_id").agg(F.max("passes").alias("passes"), F.array_sort(F.collect_list(F.struct("place", "call_id", F.coalesce("parents", F.array().cast("array<int>")).alias("parents")))).alias("row"))
    whole = whole.withColumn("levels", _peeled(F.col("row"), F.col("passes")))
    out = whole.select("conv_id", F.explode(F.arrays_zip(F.col("row.call_id").alias("call_id"), F.col("levels").alias("level"))).alias("x")).select("conv_id", "x.call_id", "x.level")
    large = size.where("not small").select("conv_id")
    if not large.isEmpty():
        out = out.unionByName(_in_rounds(ids.join(large, "conv_id", "left_semi"), edges.join(large, "conv_id", "left_semi")))
    return out.join(missing, KEY, "left").select(*KEY, "level", F.coalesce("missing_parents", F.lit(0).cast("long")).alias("missing_parents"))


def _kind(v: F.Column) -> F.Column:
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | s.isNull(), F.lit(None))
        .when(s == "VOID", "null")
        .when(s == "BOOLEAN", "boolean")
        .when(s == "STRING", "string")
        .when(s.startswith("ARRAY"), "array")
        .when(s.startswith("OBJECT"), "object")
        .when(s == "BIGINT", "integer")
        .otherwise("number")
    )


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Every call with its result, place and verdict, and every identifier that only results have.

    calls: conv_id, call_id, position, name, arguments (JSON), parents (array of call_id);
    results: conv_id, call_id, position, content; schemas: name, field, type, required.
    Returns conv_id, call_id, position, level, name, arguments (canonical JSON, null if it is no object), errors
    (sorted), missing_parents, n_results, result_position, result (the first one) and status: linked, unanswered (no
    result), early (the first result is not after the call), invalid (errors) or cyclic; the first that holds of cyclic,
    invalid, unanswered, early. Results that answer no call are one row an identifier, with status orphan.
    """
    of = schemas.where("name is not null and field is not null").groupBy("name").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("field", F.struct(F.col("type"), F.coalesce("required", F.lit(False)).alias("required")))))).alias("fields"))
    first = _shared.written(results.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_results"), F.min(F.struct("position", "content")).alias("first")), "call-results")
    order = levels(calls).withColumn("ordered", F.lit(True))
    df = calls.select(*KEY, "position", "name", F.expr("try_parse_json(arguments)").alias("v"))
    df = df.join(of, "name", "left").join(first, KEY, "left").join(order, KEY, "left")
    is_object = F.coalesce(_kind(F.col("v")) == "object", F.lit(False))
    df = df.withColumn("v", F.when(is_object, F.col("v")))
    given = F.coalesce(F.map_keys(F.expr("cast(v as map<string, variant>)")), F.array())
    want = F.coalesce(F.map_keys("fields"), F.array().cast("array<string>"))
    values = F.expr("cast(v as map<string, variant>)")
    df = df.withColumns({"given": given.cast("array<string>"), "want": want, "values": values})
    has = lambda f: F.array_contains(F.col("given"), f)
    missing = F.transform(F.filter("want", lambda f: F.element_at("fields", f)["required"] & ~has(f)), lambda f: F.concat(F.lit("missing "), f))
    unknown = F.transform(F.array_except("given", "want"), lambda f: F.concat(F.lit("unknown "), f))
    fits = lambda f: (F.element_at("fields", f)["type"] == _kind(F.element_at("values", f))) | ((F.element_at("fields", f)["type"] == "number") & (_kind(F.element_at("values", f)) == "integer"))
    wrong = F.transform(F.filter("want", lambda f: has(f) & ~F.coalesce(fits(f), F.lit(False))), lambda f: F.concat(F.lit("type "), f))
    errors = F.when(F.col("fields").isNull(), F.array(F.lit("unknown tool"))).when(F.col("v").isNull(), F.array(F.lit("not an object"))).otherwise(F.array_sort(F.concat(missing, unknown, wrong)))
    cyclic = F.coalesce(F.col("ordered"), F.lit(False)) & F.col("level").isNull()
    df = df.withColumn("errors", errors)
    status = F.when(cyclic, "cyclic").when(F.size("errors") > 0, "invalid").when(F.col("n_results").isNull(), "unanswered").when(F.coalesce(F.col("first.position") <= F.col("position"), F.lit(False)), "early").otherwise("linked")
    linked = df.select(
        *KEY,
        "position",
        "level",
        "name",
        F.to_json("v").alias("arguments"),
        "errors",
        F.coalesce("missing_parents", F.lit(0).cast("long")).alias("missing_parents"),
        F.coalesce("n_results", F.lit(0).cast("long")).alias("n_results"),
        F.col("first.position").alias("result_position"),
        F.col("first.content").alias("result"),
        status.alias("status"),
    )
    orphans = first.join(calls.select(*KEY).distinct(), KEY, "left_anti").select(*KEY, "n_results", F.col("first.position").alias("result_position"), F.col("first.content").alias("result"), F.lit("orphan").alias("status"))
    return linked.unionByName(orphans, allowMissingColumns=True)
