"""The queries of this subpackage: name -> function of (session, folder of the tables), and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _held_out(n: int) -> Column:
    """Whether crc32 of doc_id as text is divisible by n; a row without doc_id is never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n == 0, F.lit(True))


def op1_id_files(spark: SparkSession, sf: str) -> DataFrame:
    from wayfold.llm import _shared
    from wayfold.llm.id_files import read_ids, write_ids

    path = _shared.folder(spark, "ids")
    files = write_ids(_table(spark, sf, "documents"), path, _tokenizer("byte_bpe_50k.json"), end=0).collect()  # a row a file
    return read_ids(spark, path, [(r["file"], r["n_ids"]) for r in files]).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    from wayfold.llm.toxicity import fit, score

    docs = _table(spark, sf, "documents")
    model = fit(docs, _table(spark, sf, "labels").where(~_held_out(5)))
    return score(docs, model).withColumn("held_out", _held_out(5)).select("doc_id", "held_out", "score", "predicted")


def op3_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    from wayfold.llm.token_counts import token_counts

    return token_counts(_table(spark, sf, "documents"), _tokenizer("byte_bpe_50k.json"))


def op4_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    from wayfold.llm import _shared
    from wayfold.llm.lm_scoring import fit, forget, score

    docs = _table(spark, sf, "documents")
    model = fit(docs.where(~_held_out(10)))
    out = _shared.written(score(model, docs).withColumn("held_out", _held_out(10)), "lm-scoring")
    forget(spark, model)
    return out


def op5_fixity(spark: SparkSession, sf: str) -> DataFrame:
    """The audit of a replica made of other bytes: of every page with page_id % 101 = 7 the first character is a "#", and every one with page_id % 499 = 5 can't be read there."""
    from wayfold.llm import _shared
    from wayfold.llm.fixity import audit, records, tree

    pages = _table(spark, sf, "pages")
    here = _shared.written(records(pages), "records")
    damaged = pages.withColumn("html", F.when(F.expr("page_id % 101 = 7"), F.concat(F.lit("#"), F.expr("substring(html, 2)"))).otherwise(F.col("html")))
    there = records(damaged).where("page_id % 499 != 5")
    one, other = tree(here.drop("page_id")), tree(there.drop("page_id"))
    bad = audit(one, other).join(here.select("file", "offset", "page_id"), ["file", "offset"]).groupBy("file").agg(F.count("other_hash").alias("n_damaged"), F.sum(F.col("other_hash").isNull().cast("long")).alias("n_lost"), F.min("offset").alias("first_offset"), F.min("page_id").alias("first_page"))
    files = here.groupBy("file").agg(F.count(F.lit(1)).alias("n_records"), F.sum("length").alias("n_bytes"))
    roots = one[-1].select("file", F.col("hash").alias("root")).join(other[-1].select("file", F.col("hash").alias("other_root")), "file", "left")
    return files.join(roots, "file").join(bad, "file", "left").select("file", "n_records", "n_bytes", "root", F.col("root").eqNullSafe(F.col("other_root")).alias("intact"), F.coalesce("n_damaged", F.lit(0)).alias("n_damaged"), F.coalesce("n_lost", F.lit(0)).alias("n_lost"), "first_offset", "first_page")


def op6_tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Each assistant turn as a call "reply", each user turn as the result of the turn before it (orphans where that is no assistant's). A call depends on the calls 2 and 4 turns before, in conversations whose id is divisible by 3 on those after it, and in every seventh turn on one that doesn't exist."""
    from wayfold.llm.tool_calls import link

    turns = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    name = lambda back: F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    back = F.when(F.expr("conv_id % 3 = 0"), -1).otherwise(1)
    parents = F.filter(F.array(name(2 * back), name(4 * back), F.when(F.expr("turn % 7 = 0"), F.lit("gone"))), lambda x: x.isNotNull())
    calls = turns.where("role = 'assistant'").select("conv_id", name(0).alias("call_id"), F.col("turn").alias("position"), F.lit("reply").alias("name"), F.to_json(F.struct("turn", "text", F.when(F.col("turn") % 3 != 2, F.char_length("text")).alias("chars"))).alias("arguments"), parents.alias("parents"))
    results = turns.where("role = 'user'").select("conv_id", name(1).alias("call_id"), F.col("turn").alias("position"), F.col("text").alias("content"))
    schemas = spark.sql("select * from values ('reply', 'turn', 'integer', true), ('reply', 'text', 'string', true), ('reply', 'chars', 'integer', true) as t(name, field, type, required)")
    return link(calls, results, schemas).select("conv_id", "call_id", "position", "level", "missing_parents", F.array_join("errors", ",").alias("errors"), "n_results", "result_position", F.char_length("result").cast("long").alias("result_chars"), "status", F.sha2("arguments", 256).alias("arguments_sha256"))


def op7_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    from wayfold.llm.quality_rules import quality

    return quality(_table(spark, sf, "documents"), clean=True)


def op8_packing(spark: SparkSession, sf: str) -> DataFrame:
    from wayfold.llm.packing import pack

    pieces = pack(_table(spark, sf, "documents"), _tokenizer("word_bpe_49k.json"), end=2)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op9_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    from wayfold.llm.decontamination import decontaminate

    return decontaminate(_table(spark, sf, "documents"), _table(spark, sf, "benchmark")).drop("spans")


def op10_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from wayfold.llm.near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf, "documents"), part=85, whole=100, n=5)


def op11_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from wayfold.llm import _shared
    from wayfold.llm.suffix_dedup import fit, forget, removed

    docs = _table(spark, sf, "documents")
    dictionary = fit(docs, length=50)
    digest = removed(docs, dictionary).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    out = _shared.written(digest, "suffix-dedup")
    forget(spark, dictionary)
    return out


def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    from wayfold.llm.whitening import fit, whiten

    vectors = _table(spark, sf, "embeddings")
    return whiten(vectors, fit(vectors, components=16))


def op13_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    from wayfold.llm import _shared
    from wayfold.llm.ranked_search import build, forget, search

    index = build(_table(spark, sf, "documents"))
    out = _shared.written(search(index, _table(spark, sf, "benchmark"), k=10), "ranked")
    forget(index)
    return out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_id_files": op1_id_files,
    "op2_toxicity": op2_toxicity,
    "op3_token_counts": op3_token_counts,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_fixity": op5_fixity,
    "op6_tool_calls": op6_tool_calls,
    "op7_quality_rules": op7_quality_rules,
    "op8_packing": op8_packing,
    "op9_decontamination": op9_decontamination,
    "op10_near_dedup": op10_near_dedup,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_whitening": op12_whitening,
    "op13_ranked_search": op13_ranked_search,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op5_fixity": """
WITH p AS (SELECT page_id // 1000 AS file, page_id, replica,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || repeat(chr(13) || chr(10), 2) || coalesce(html, '') || repeat(chr(13) || chr(10), 2) AS record
  FROM (SELECT page_id, url, 0 AS replica, html FROM pages UNION ALL SELECT page_id, url, 1, CASE WHEN page_id % 101 = 7 THEN '#' || substring(html, 2) ELSE html END FROM pages)),
h AS (SELECT replica, file, page_id, sha256(record) AS hash, octet_length(encode(record)) AS length FROM p),
w AS (SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY replica, file ORDER BY page_id, hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM h),
o AS (SELECT * FROM w WHERE replica = 0),
both_ AS (SELECT * FROM w WHERE replica = 0 OR page_id % 499 <> 5),
l1 AS (SELECT replica, file, off // 65536 AS k, sha256(string_agg(off || ':' || hash || ';', '' ORDER BY off, hash)) AS hash FROM both_ GROUP BY ALL),
l2 AS (SELECT replica, file, k // 16 AS k, sha256(string_agg(l1.k || ':' || hash || ';', '' ORDER BY l1.k)) AS hash FROM l1 GROUP BY replica, file, k // 16),
l3 AS (SELECT replica, file, k // 16 AS k, sha256(string_agg(l2.k || ':' || hash || ';', '' ORDER BY l2.k)) AS hash FROM l2 GROUP BY replica, file, k // 16),
top AS (SELECT max(k) AS t FROM l1),
roots AS (SELECT replica, file, hash FROM l1, top WHERE t = 0 UNION ALL SELECT replica, file, hash FROM l2, top WHERE t BETWEEN 1 AND 15 UNION ALL SELECT replica, file, hash FROM l3, top WHERE t BETWEEN 16 AND 255),
bad AS (SELECT file, count(*) FILTER (WHERE page_id % 499 <> 5) AS n_damaged, count(*) FILTER (WHERE page_id % 499 = 5) AS n_lost, min(off) AS first_offset, min(page_id) AS first_page FROM o WHERE page_id % 101 = 7 OR page_id % 499 = 5 GROUP BY file)
SELECT f.file, n_records, n_bytes, a.hash AS root, a.hash IS NOT DISTINCT FROM b.hash AS intact, coalesce(n_damaged, 0) AS n_damaged, coalesce(n_lost, 0) AS n_lost, first_offset, first_page
FROM (SELECT file, count(*) AS n_records, CAST(sum(length) AS BIGINT) AS n_bytes FROM o GROUP BY file) f
JOIN roots a ON a.file = f.file AND a.replica = 0 LEFT JOIN roots b ON b.file = f.file AND b.replica = 1 LEFT JOIN bad ON bad.file = f.file""",
    "op6_tool_calls": """
WITH RECURSIVE calls AS (SELECT *, conv_id || '-' || turn AS call_id FROM conversations WHERE role = 'assistant'),
results AS (SELECT conv_id, conv_id || '-' || (turn - 1) AS call_id, count(*) AS n, min(turn) AS turn, min_by(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY ALL),
given AS (SELECT call_id, conv_id, unnest([conv_id || '-' || (turn - CASE WHEN conv_id % 3 = 0 THEN -2 ELSE 2 END), conv_id || '-' || (turn - CASE WHEN conv_id % 3 = 0 THEN -4 ELSE 4 END), CASE WHEN turn % 7 = 0 THEN 'gone' END]) AS parent FROM calls),
edges AS (SELECT call_id, parent FROM given WHERE parent IN (SELECT call_id FROM calls)),
chains AS (SELECT call_id, CAST(0 AS BIGINT) AS level FROM calls UNION SELECT e.call_id, c.level + 1 FROM chains c JOIN edges e ON e.parent = c.call_id),
levels AS (SELECT call_id, max(level) AS level FROM chains GROUP BY call_id),
gone AS (SELECT call_id, count(*) AS missing_parents FROM given WHERE parent IS NOT NULL AND parent NOT IN (SELECT call_id FROM calls) GROUP BY call_id)
SELECT c.conv_id, c.call_id, c.turn AS position, level, coalesce(missing_parents, 0) AS missing_parents, CASE WHEN c.turn % 3 = 2 THEN 'missing chars' ELSE '' END AS errors,
  coalesce(r.n, 0) AS n_results, r.turn AS result_position, CAST(length(r.text) AS BIGINT) AS result_chars,
  CASE WHEN c.turn % 3 = 2 THEN 'invalid' WHEN r.n IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
  sha256('{' || CASE WHEN c.turn % 3 = 2 THEN '' ELSE '"chars":' || length(c.text) || ',' END || '"text":' || CAST(to_json(c.text) AS VARCHAR) || ',"turn":' || c.turn || '}') AS arguments_sha256
FROM calls c LEFT JOIN results r USING (conv_id, call_id) JOIN levels USING (call_id) LEFT JOIN gone USING (call_id)
UNION ALL
SELECT conv_id, call_id, NULL, NULL, NULL, NULL, n, turn, CAST(length(text) AS BIGINT), 'orphan', NULL FROM results WHERE call_id NOT IN (SELECT call_id FROM calls)""",
    "op10_near_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN least USING (doc_id)""",
    "op9_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT item_id, 13 AS n, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM b WHERE len(w) >= 13)
  UNION SELECT item_id, len(w), array_to_string(w, ' ') FROM b WHERE len(w) BETWEEN 1 AND 12),
hits AS (
  SELECT p.doc_id, p.i, p.n, v.item_id
  FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)) p
  JOIN windows v ON v.n = p.n AND v.k = p.k),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op13_ranked_search": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
c AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS total FROM d WHERE len(t) > 0),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c GROUP BY term, docs),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score FROM q JOIN tf USING (term) JOIN w USING (term), c GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10""",
}
