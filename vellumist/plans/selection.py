"""Queries that choose, complete and name rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import selection as S
from .views import WORDS, table, words


def allowed_types(spark, d):
    o = S.allowed(table(spark, d, "orders"), {"o_orderpriority": ["1-urgent", "2-HIGH"], "o_orderstatus": ["f", "O"], "o_comment": None})
    return o.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


def resolved_tasks(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.array(F.array(F.lit(0), F.lit(0), F.lit(1), F.lit(1)))).otherwise(F.array().cast("array<array<int>>")).alias("boxes"), F.concat(F.lit("Find "), F.when(F.col("event_id") % 3 == 0, F.lit("{text}")).otherwise(F.col("event_type"))).alias("question"))
    return S.resolved(e, "boxes", "question").select("event_id", "question")


def annotated_pages(spark, d):
    t = table(spark, d, "documents").select("lang", F.when(F.col("doc_id") % 5 == 0, F.lit(" ")).otherwise(F.col("text")).alias("t"), F.filter(F.split("text", "\n"), lambda x: F.length(x) > 400).alias("lines"))
    return t.groupBy("lang").agg(F.count_if(S.annotated("lines[]", "t")).alias("n"), F.count_if(S.annotated("lines[]")).alias("n_lines"))


def long_texts(spark, d):
    return S.long_enough(table(spark, d, "documents"), "text", 200).select("doc_id")


def ranked_first_valid(spark, d):
    """The first fifty of a ranking that have a document."""
    ranking = table(spark, d, "embeddings").select("vec_id")
    files = table(spark, d, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("vec_id"))
    return S.first_valid(ranking, files, "vec_id", [F.col("vec_id") % 7, F.col("vec_id")], 50)


def chosen_rows(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return S.chosen(c, "c_custkey", [3, 5, 8]).withColumn("how", F.lit("ids")).unionByName(S.chosen(c, "c_custkey", first=10, start=4).withColumn("how", F.lit("place")))


def crossed_tasks(spark, d):
    catalog = spark.createDataFrame([("reading", "text", "image", 2), ("detection", "box", "image", 3)], "task_type string, output_type string, input_type string, n_questions int")
    return S.crossed(table(spark, d, "customer").select("c_custkey"), catalog).withColumn("question_idx", F.col("question_idx").cast("long"))


def _files(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 == 0, F.concat(F.lit("eq"), "c_custkey", F.lit("_1234567"))).otherwise(F.concat(F.lit("eq"), "c_custkey")).alias("name"))
    return c.select("name", F.lit("pdf").alias("kind")).unionByName(c.where("c_custkey % 5 <> 0").select("name", F.lit("json").alias("kind")))


def file_states(spark, d):
    return S.file_state(_files(spark, d), "name", "kind")


def file_integrity(spark, d):
    return S.integrity(S.file_state(_files(spark, d), "name", "kind"))


def missing_metrics(spark, d):
    """A metric that the table has stays as it is, one that it lacks is added."""
    t = table(spark, d, "documents").select("doc_id", "n_chars")
    return S.write_missing(t, t.columns, {"n_chars": F.lit(0), "twice": F.col("n_chars") * 2})


def split_line_groups(spark, d):
    w = words(spark, d).withColumn("part", F.floor(F.col("j") / 6))
    return S.split_groups(w, ["page_id"], "line", "part", "idx", ("x1", "y1", "x2", "y2")).select("page_id", "line", "part", "n", "x1", "y1", "x2", "y2", F.col("new_group").cast("long").alias("new_group"))


def rolling_shard_manifest(spark, d):
    o = table(spark, d, "orders").withColumn("worker", F.col("o_custkey") % 8)
    return S.shard_entries(S.rolling_shards(o, "worker", "o_orderkey", 64), "worker", "o_orderkey")


def prediction_scores(spark, d):
    k = F.col("event_id") % 4
    raw = F.concat(F.lit('{"'), F.when(k == 0, "score").when(k == 1, "confidence").when(k == 2, "prob").otherwise("other"), F.lit('": '), (F.col("event_id") % 100 / 128).cast("string"), F.lit("}"))
    return table(spark, d, "events").select("event_id", S.prediction_score(F.parse_json(raw)).alias("score"))


def literal_lists(spark, d):
    raw = F.concat(F.lit("[{'text': 'No. "), "s_suppkey", F.lit("', 'ok': True}, {'text': None, 'ok': False}]"))
    v = S.literal_list(raw, "array<struct<text: string, ok: boolean>>")
    return table(spark, d, "supplier").select("s_suppkey", F.size(v).alias("n"), F.get(v, F.lit(0))["text"].alias("first"), F.get(v, F.lit(1))["ok"].alias("second_ok"))


def fallback_texts(spark, d):
    t = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.lit("  "))
    return table(spark, d, "documents").select("doc_id", S.fallback_text(t, F.split("text", "\n")).alias("text"))


def line_labels(spark, d):
    return table(spark, d, "documents").select("doc_id", S.label(F.split("text", "\n")).alias("label"))


def output_names(spark, d):
    return table(spark, d, "documents").select("doc_id", S.output_name(F.concat(F.lit("idl-"), "source", F.lit("-idl-"), "doc_id")).alias("name"))


def iou_single(spark, d):
    """A word's IoU with itself moved, and with itself given backwards, in single precision."""
    a = tuple(F.col(c) for c in ("x1", "y1", "x2", "y2"))
    moved = (a[0] + 4, a[1] + 2, a[2] + 4, a[3] + 2)
    return words(spark, d).select("page_id", "idx", F.round(G.iou_unclamped(a, moved).cast("double"), 4).alias("moved"), F.round(G.iou_unclamped(a, (a[2], a[1], a[0], a[3])).cast("double"), 4).alias("backwards"))


def rotated_boxes(spark, d):
    e = table(spark, d, "events")
    w, h = G.rotated_size((F.col("event_id") % 100 + 1).cast("double"), (F.col("user_id") % 50 + 1).cast("double"), (F.col("event_id") % 360).cast("double"))
    box = G.placed(F.lit(500.0), F.lit(400.0), w, h)
    return e.select("event_id", *(F.round(c, 4).alias(n) for c, n in zip([w, h, *box], ("w", "h", "x1", "y1", "x2", "y2"))))


def quad_boxes(spark, d):
    xs, ys = [F.col("x1"), F.col("x2"), F.col("x2") + 4, F.col("x1") + 4], [F.col("y1"), F.col("y1") + 2, F.col("y2") + 2, F.col("y2")]
    q = G.quad_relative(xs, ys, F.lit(8192.0), F.lit(65536.0))
    return words(spark, d).select("page_id", "idx", *(c.alias(n) for c, n in zip(G.quad_to_box(xs, ys, F.lit(8192.0), F.lit(65536.0)), ("x1", "y1", "x2", "y2"))), *(F.get(q, F.lit(k)).alias(f"q{k}") for k in range(8)))


def round_down(spark, d):
    return table(spark, d, "orders").select("o_orderkey", G.round_down(F.col("o_orderkey"), F.col("o_custkey") % 7).alias("down"))


def ids_of_two_folders(spark, d):
    raw = table(spark, d, "orders").select(F.concat(F.lit("raw/"), "o_custkey", F.lit("_0001.pdf")).alias("p"))
    data = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("data/"), "c_custkey", F.lit("_0002.json")).alias("p"))
    return raw.union(data).select(F.regexp_extract("p", r"/(.+)_[0-9]+\.", 1).alias("id")).distinct().orderBy("id")


def ids_in_both(spark, d):
    """INTERSECT ALL: a key as often as both sides have it."""
    a = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"))
    return a.intersectAll(table(spark, d, "orders").select(F.col("o_custkey").alias("k"))).groupBy("k").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (allowed_types, resolved_tasks, annotated_pages, long_texts, ranked_first_valid, chosen_rows, crossed_tasks, file_states, file_integrity, missing_metrics, split_line_groups, rolling_shard_manifest, prediction_scores, literal_lists, fallback_texts, line_labels, output_names, iou_single, rotated_boxes, quad_boxes, round_down, ids_of_two_folders, ids_in_both)}

_SP = r"[ \t\n\x0b\f\r]+"
_FILES = "c AS (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'eq' || c_custkey || '_1234567' ELSE 'eq' || c_custkey END AS name FROM customer), s AS (SELECT name, c_custkey % 5 <> 0 AS complete, c_custkey % 5 = 0 AS orphan, c_custkey % 9 = 0 AS temporary FROM c)"
_Q = [c for x, y in zip(("x1", "x2", "x2 + 4", "x1 + 4"), ("y1", "y1 + 2", "y2 + 2", "y2")) for c in (f"({x}) / 8192.0::DOUBLE", f"({y}) / 65536.0::DOUBLE")]
_01 = lambda c: f"round(greatest(0.0, least(1.0, {c})), 3)"
_INTER = "(greatest(0, least(x2, x2 + 4) - greatest(x1, x1 + 4)) * greatest(0, y2 - (y1 + 2)))"
SQL = {
    "allowed_types": "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders WHERE lower(o_orderpriority) IN ('1-urgent', '2-high') AND lower(o_orderstatus) IN ('f', 'o') GROUP BY ALL",
    "resolved_tasks": "SELECT event_id, 'Find ' || event_type AS question FROM events WHERE event_id % 4 <> 0 AND event_id % 3 <> 0",
    "annotated_pages": "WITH t AS (SELECT lang, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE text END AS t, len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 400)) > 0 AS l FROM documents) SELECT lang, count(*) FILTER (coalesce(l, false) OR coalesce(trim(t) <> '', false)) AS n, count(*) FILTER (coalesce(l, false)) AS n_lines FROM t GROUP BY lang",
    "long_texts": f"SELECT doc_id FROM documents WHERE length(trim(regexp_replace(coalesce(text, ''), '{_SP}', ' ', 'g'))) >= 200",
    "ranked_first_valid": "SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0) ORDER BY vec_id % 7, vec_id LIMIT 50",
    "chosen_rows": "SELECT c_custkey, c_name, 'ids' AS how FROM customer WHERE c_custkey IN (3, 5, 8) UNION ALL (SELECT c_custkey, c_name, 'place' FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 4)",
    "crossed_tasks": "SELECT c_custkey, task_type, output_type, input_type, unnest(range(n)) AS question_idx FROM customer, (VALUES ('reading', 'text', 'image', 2), ('detection', 'box', 'image', 3)) v(task_type, output_type, input_type, n)",
    "file_states": f"WITH {_FILES} SELECT * FROM s",
    "file_integrity": f"WITH {_FILES}, n AS (SELECT count(*) FILTER (complete) AS complete, count(*) FILTER (orphan) AS orphan, count(*) FILTER (temporary) AS temporary FROM s) SELECT *, CASE WHEN orphan = 0 AND temporary = 0 THEN 'ok' WHEN orphan <= complete * 0.01 THEN 'minor' ELSE 'major' END AS mismatch FROM n",
    "missing_metrics": "SELECT doc_id, n_chars, n_chars * 2 AS twice FROM documents",
    "split_line_groups": f"WITH {WORDS}, g AS (SELECT page_id, line, (j // 6)::BIGINT AS part, count(*) AS n, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, min(idx) AS f FROM words GROUP BY 1, 2, 3) SELECT page_id, line, part, n, x1, y1, x2, y2, row_number() OVER (PARTITION BY page_id ORDER BY line, f) - 1 AS new_group FROM g",
    "rolling_shard_manifest": "WITH s AS (SELECT o_custkey % 8 AS worker, o_orderkey, (row_number() OVER (PARTITION BY o_custkey % 8 ORDER BY o_orderkey) - 1) // 64 AS shard FROM orders) SELECT worker, shard, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM s GROUP BY 1, 2",
    "prediction_scores": "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN (event_id % 100) / 128 END AS score FROM events",
    "literal_lists": "SELECT s_suppkey, 2 AS n, 'No. ' || s_suppkey AS first, false AS second_ok FROM supplier",
    "fallback_texts": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND trim(text) <> '' THEN text ELSE replace(text, chr(10), ' ') END AS text FROM documents",
    "line_labels": f"SELECT doc_id, trim(regexp_replace(replace(text, chr(10), ' '), '{_SP}', ' ', 'g')) AS label FROM documents",
    "output_names": "SELECT doc_id, regexp_replace('idl-' || source || '-idl-' || doc_id, '^idl-', '') AS name FROM documents",
    "iou_single": f"WITH {WORDS} SELECT page_id, idx, round(CASE WHEN 2 * (x2 - x1) * (y2 - y1) - {_INTER} > 0 THEN {_INTER} / (2 * (x2 - x1) * (y2 - y1) - {_INTER}) ELSE 0 END, 4) AS moved, 0.0 AS backwards FROM words",
    "rotated_boxes": "WITH e AS (SELECT event_id, (event_id % 100 + 1)::DOUBLE AS w, (user_id % 50 + 1)::DOUBLE AS h, radians((event_id % 360)::DOUBLE) AS a FROM events), r AS (SELECT event_id, w * abs(cos(a)) + h * abs(sin(a)) AS w, w * abs(sin(a)) + h * abs(cos(a)) AS h FROM e) SELECT event_id, round(w, 4) AS w, round(h, 4) AS h, round(500 - w / 2, 4) AS x1, round(400 - h / 2, 4) AS y1, round(500 + w / 2, 4) AS x2, round(400 + h / 2, 4) AS y2 FROM r",
    "quad_boxes": f"WITH {WORDS} SELECT page_id, idx, {_01('x1 / 8192.0::DOUBLE')} AS x1, {_01('(y1 + 1) / 65536.0::DOUBLE')} AS y1, {_01('(x2 + 4) / 8192.0::DOUBLE')} AS x2, {_01('(y2 + 1) / 65536.0::DOUBLE')} AS y2, " + ", ".join(f"{_01(c)} AS q{k}" for k, c in enumerate(_Q)) + " FROM words",
    "round_down": "SELECT o_orderkey, o_orderkey - o_orderkey % greatest(1, o_custkey % 7) AS down FROM orders",
    "ids_of_two_folders": "SELECT o_custkey::VARCHAR AS id FROM orders UNION SELECT c_custkey::VARCHAR FROM customer WHERE c_custkey % 3 = 0",
    "ids_in_both": "SELECT k, count(*) AS n FROM (SELECT l_suppkey AS k FROM lineitem INTERSECT ALL SELECT o_custkey FROM orders) GROUP BY k",
}
