"""Sharding, splits, diversity, resume, manifests and task queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import diversity, sharding, tasks
from .views import WORDS, table, words


def kcenter_rank5(spark, d):
    r = diversity.k_center(table(spark, d, "embeddings"), 5)
    return r.select("rank", "vec_id", F.round("radius_before", 6).alias("radius_before"), F.round("radius_after", 6).alias("radius_after"))


def kcenter_full(spark, d):
    return diversity.full_order(table(spark, d, "embeddings"))


def _curve(spark, d):
    """Prices of parts by rank, falling: a curve with an elbow."""
    p = table(spark, d, "part").groupBy("p_size").agg(F.max("p_retailprice").alias("y"))
    return p.select(F.col("p_size").cast("double").alias("x"), F.round(2000 / (1 + F.col("p_size")) + F.col("y") / 1000, 6).alias("y"))


_CURVE = "curve AS (SELECT p_size::DOUBLE AS x, round(2000 / (1 + p_size) + max(p_retailprice) / 1000, 6) AS y FROM part GROUP BY p_size)"


def elbow(spark, d):
    return diversity.elbow(_curve(spark, d), "x", "y").select("x", "y", F.round("distance", 6).alias("distance"))


def coverage_rank(spark, d):
    """The first rank at which 50, 80 and 90 percent of a curve's drop is done."""
    c = _curve(spark, d)
    lim = c.agg(F.max("y").alias("hi"), F.min("y").alias("lo"))
    t = c.join(F.broadcast(lim)).select("x", "y", "hi", "lo", F.explode(F.array(F.lit(50), F.lit(80), F.lit(90))).alias("pct"))
    return t.groupBy("pct").agg(F.coalesce(F.min(F.when(F.col("y") <= F.col("hi") - (F.col("hi") - F.col("lo")) * F.col("pct") / 100, F.col("x"))), F.max("x")).alias("rank"))


def assign_tasks(spark, d):
    return sharding.blocks_of(table(spark, d, "documents").select("doc_id"), "doc_id", 100)


def task_counts(spark, d):
    return assign_tasks(spark, d).groupBy("task").count().withColumnRenamed("count", "n")


def hash_split(spark, d):
    return table(spark, d, "documents").select("doc_id", sharding.split(F.col("text"), {"train": 0.8, "validation": 0.1, "test": 0.1}).alias("split"))


def shard_by_rows(spark, d):
    return sharding.by_rows(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 2048)


def shard_by_docs(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return sharding.by_documents(li, "l_orderkey", 1000).groupBy("shard").agg(F.count("*").alias("n_rows"), F.min("l_orderkey").alias("first"), F.max("l_orderkey").alias("last"))


def chunk_workers(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    return sharding.chunks(c, ["c_custkey"], 7, c.count()).groupBy("worker").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"))


def reshard_pairs(spark, d):
    """Complete pairs of events of a user and minute, first of each kind, in four shards."""
    e = table(spark, d, "events").where("event_type in ('click', 'view')").withColumn("key", F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMddHH")))
    first = sharding.first_of(e, ["key", "event_type"], ["event_id"])
    full = first.groupBy("key").agg(F.count("*").alias("n"), F.min("event_id").alias("event_id")).where("n = 2")
    return sharding.numbered(full, ["event_id"], "i").select("key", F.pmod("i", F.lit(4)).alias("shard"))


def rotation_variant(spark, d):
    return table(spark, d, "events").select("event_id", sharding.rotation(F.col("event_id")).alias("rotation"))


def failures_setop(spark, d):
    """Orders without lines, or failed, or of no value."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    done = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    lost = o.select("o_orderkey").join(done, "o_orderkey", "left_anti")
    return lost.union(o.where("o_orderstatus = 'F'").select("o_orderkey")).union(o.where("o_totalprice < 1000").select("o_orderkey")).distinct()


def skip_existing_anti(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


def resume_accounting(spark, d):
    x = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return x.agg(F.count("*").alias("total"), F.count("quality").alias("done"), F.count_if(F.expr("quality is null")).alias("missing"), F.count_if(F.expr("quality = 0")).alias("failed"))


def completeness_having(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.count_distinct("role").alias("roles"), F.count("*").alias("turns")).where("roles = 2 and turns % 2 = 0")


def shard_manifest(spark, d):
    """shard -> names of its documents, as a map and exploded again."""
    s = sharding.by_rows(table(spark, d, "documents").select("doc_id"), ["doc_id"], 256)
    m = s.groupBy("shard").agg(F.array_sort(F.collect_list("doc_id")).alias("files"))
    return m.select("shard", F.posexplode("files").alias("pos", "doc_id"))


def manifest_merge(spark, d):
    """The later of two manifests wins."""
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("v"), F.lit(1).alias("at"))
    late = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("s_suppkey"), (100 + F.col("n_regionkey")).cast("long").alias("v"), F.lit(2).alias("at"))
    return s.union(late).groupBy("s_suppkey").agg(F.max_by("v", "at").alias("v"))


def schema_union_by_name(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("source"), F.col("c_acctbal").alias("balance"))
    b = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("part").alias("source"), F.col("p_size").alias("size"))
    return a.unionByName(b, allowMissingColumns=True)


def batch_status(spark, d):
    """Numbered batches of three splits: done, missing or to do."""
    want = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("batch"), F.explode(F.array(*map(F.lit, ("train", "validation", "test")))).alias("split"))
    have = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("batch"), F.when(F.col("s_suppkey") % 3 == 0, "train").when(F.col("s_suppkey") % 3 == 1, "validation").otherwise("test").alias("split"), "s_acctbal")
    best = have.groupBy("batch", "split").agg(F.max("s_acctbal").alias("b"))
    return want.join(best, ["batch", "split"], "left").select("batch", "split", F.when(F.col("b").isNull(), "MISSING").when(F.col("b") > 5000, "SKIP").otherwise("TODO").alias("status"))


def dry_run_estimate(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("docs"), F.ceil(F.count("*") / 2048).alias("shards"))


def numeric_names(spark, d):
    """Five-digit names from trailing digits."""
    n = F.regexp_extract("url", r"([0-9]+)(?=\?|#|$)", 1)
    return table(spark, d, "pages").select("page_id", F.when(n != "", F.lpad(n, 5, "0")).alias("name"))


def _available(spark, d):
    """Text levels that a document has, by its own text."""
    t = F.col("text")
    has = [(F.lit(True), "text"), (t.contains("\n"), "lines"), (t.contains(" "), "words"), (F.length(t) > 1000, "paragraphs"), (t.contains("%"), "latex"), (F.length(t) % 2 == 0, "text2d")]
    return table(spark, d, "documents").select("doc_id", F.filter(F.array(*(F.when(c, F.lit(n)) for c, n in has)), lambda x: x.isNotNull()).alias("available"))


_PAIRS = """docs AS (SELECT doc_id, list_filter(['text', CASE WHEN contains(text, chr(10)) THEN 'lines' END, CASE WHEN contains(text, ' ') THEN 'words' END, CASE WHEN length(text) > 1000 THEN 'paragraphs' END, CASE WHEN contains(text, '%') THEN 'latex' END, CASE WHEN length(text) % 2 = 0 THEN 'text2d' END], lambda x: x IS NOT NULL) AS available FROM documents),
cat(template, task, required) AS (VALUES (0, 'reading', ['text']), (1, 'reading', ['lines']), (2, 'reading', ['text2d']), (3, 'detection', ['lines']), (4, 'conditional_detection', ['words']), (5, 'localized_reading', ['lines']), (6, 'reading', ['paragraphs']), (7, 'reading', ['latex'])),
pairs AS (SELECT doc_id, template, task FROM docs, cat WHERE list_has_all(available, required))"""


def task_compat_join(spark, d):
    return tasks.compatible(_available(spark, d), tasks.catalog(spark)).select("doc_id", "template", "task")


def task_pick(spark, d):
    return tasks.picked(tasks.compatible(_available(spark, d), tasks.catalog(spark)), "doc_id").select("doc_id", "task", "template")


def question_fill(spark, d):
    p = tasks.picked(tasks.compatible(_available(spark, d), tasks.catalog(spark)), "doc_id")
    return p.select("doc_id", tasks.fill(F.col("question"), F.lit("the page"), F.lit("it"), F.lit("[0, 0, 8, 16]")).alias("question"))


def eligible_items(spark, d):
    items = F.transform(F.split("text", " "), lambda w: F.struct(w.alias("text")))
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(tasks.eligible(items)).alias("n"))


def cond_detection_lookup(spark, d):
    """Boxes of all words of a page that equal its first word."""
    w = words(spark, d, by_page=True)
    first = w.groupBy("page_id").agg(F.min_by("text", "idx").alias("text"))
    r = tasks.same_text(w, first)
    return r.select("page_id", "k", F.size("boxes").alias("n"), F.aggregate(F.flatten("boxes"), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


def checkpoint_order(spark, d):
    n = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("c_name", r"([0-9]+)$", 1), F.lit("")), F.lit("999999999999")).cast("long"), F.lit(0))
    return table(spark, d, "customer").select("c_custkey", n.alias("step"), F.row_number().over(Window.partitionBy("c_nationkey").orderBy(n, "c_custkey")).alias("place"))


QUERIES = {f.__name__: f for f in (kcenter_rank5, kcenter_full, elbow, coverage_rank, assign_tasks, task_counts, hash_split, shard_by_rows, shard_by_docs, chunk_workers, reshard_pairs, rotation_variant, failures_setop, skip_existing_anti, resume_accounting, completeness_having, shard_manifest, manifest_merge, schema_union_by_name, batch_status, dry_run_estimate, numeric_names, task_compat_join, task_pick, question_fill, eligible_items, cond_detection_lookup, checkpoint_order)}

_DOT = "list_sum(list_transform(list_zip(a.embedding, b.v), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


def _kcenter_sql(k: int) -> str:
    s = """WITH m AS (SELECT list(v ORDER BY i) AS v FROM (SELECT i, avg(x::DOUBLE) AS v FROM (SELECT unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY i)),
n AS (SELECT list_transform(m.v, lambda x: x / sqrt(list_sum(list_transform(m.v, lambda y: y * y)))) AS v FROM m),
d0 AS MATERIALIZED (SELECT a.vec_id, a.embedding, greatest(0, 1 - """ + _DOT + """) AS d FROM embeddings a, n b)"""
    for i in range(1, k + 1):
        s += f""",
b{i} AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, d FROM d{i - 1} ORDER BY d DESC, vec_id LIMIT 1),
d{i} AS MATERIALIZED (SELECT a.vec_id, a.embedding, least(a.d, greatest(0, 1 - {_DOT})) AS d FROM d{i - 1} a, b{i} b)"""
    return s + " " + " UNION ALL ".join(f"SELECT {i} AS rank, b{i}.vec_id, round(b{i}.d, 6) AS radius_before, round((SELECT max(d) FROM d{i}), 6) AS radius_after FROM b{i}" for i in range(1, k + 1))


_U = "(('0x' || substr(sha256({}), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)"
_PICK = f""", g AS (SELECT doc_id, list(DISTINCT task ORDER BY task) AS ts FROM pairs GROUP BY 1),
c AS (SELECT doc_id, ts[1 + floor({_U.format("doc_id::VARCHAR || '42task'")} * len(ts))::INT] AS task FROM g),
t AS (SELECT doc_id, c.task, list(template ORDER BY template) AS tpl FROM c JOIN pairs USING (doc_id, task) GROUP BY 1, 2),
pick AS (SELECT doc_id, task, tpl[1 + floor({_U.format("doc_id::VARCHAR || '42template'")} * len(tpl))::INT] AS template FROM t)"""
SQL = {
    "kcenter_rank5": _kcenter_sql(5),
    "elbow": f"WITH {_CURVE}, e AS (SELECT arg_min(x, x) AS ax, arg_min(y, x) AS ay, arg_max(x, x) AS bx, arg_max(y, x) AS ey FROM curve), o AS (SELECT x, y, abs((bx - ax) * (ay - y) - (ey - ay) * (ax - x)) / sqrt((bx - ax) ** 2 + (ey - ay) ** 2) AS d FROM curve, e) SELECT x, y, round(d, 6) AS distance FROM o ORDER BY round(d, 9) DESC, x LIMIT 1",
    "coverage_rank": f"WITH {_CURVE}, l AS (SELECT max(y) AS hi, min(y) AS lo FROM curve), p AS (SELECT unnest([50, 80, 90]) AS pct) SELECT pct, coalesce(min(x) FILTER (y <= hi - (hi - lo) * pct / 100), max(x)) AS rank FROM curve, l, p GROUP BY pct",
    "assign_tasks": "SELECT doc_id, (row_number() OVER (ORDER BY sha256(doc_id::VARCHAR || '42'), doc_id) - 1) // 100 + 1 AS task FROM documents",
    "task_counts": "SELECT task, count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY sha256(doc_id::VARCHAR || '42'), doc_id) - 1) // 100 + 1 AS task FROM documents) GROUP BY 1",
    "hash_split": f"WITH u AS (SELECT doc_id, {_U.format('text')} AS u FROM documents) SELECT doc_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'validation' ELSE 'test' END AS split FROM u",
    "shard_by_rows": "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 2048 AS shard, (row_number() OVER (ORDER BY o_orderkey) - 1) % 2048 AS pos FROM orders",
    "shard_by_docs": "SELECT (r - 1) // 1000 AS shard, count(*) AS n_rows, min(l_orderkey) AS first, max(l_orderkey) AS last FROM (SELECT l_orderkey, dense_rank() OVER (ORDER BY l_orderkey) AS r FROM lineitem) GROUP BY 1",
    "chunk_workers": "SELECT worker, count(*) AS n, min(c_custkey) AS first FROM (SELECT c_custkey, least((row_number() OVER (ORDER BY c_custkey) - 1) // greatest(1, (SELECT count(*) FROM customer) // 7), 6) AS worker FROM customer) GROUP BY 1",
    "reshard_pairs": "WITH e AS (SELECT user_id::VARCHAR || '-' || strftime(ts, '%Y%m%d%H') AS key, event_type, min(event_id) AS event_id FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2), f AS (SELECT key, min(event_id) AS event_id FROM e GROUP BY 1 HAVING count(*) = 2) SELECT key, (row_number() OVER (ORDER BY event_id) - 1) % 4 AS shard FROM f",
    "rotation_variant": "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'small' ELSE ['90', '180', '270'][(event_id - event_id // 4 - 1) % 3 + 1] END AS rotation FROM events",
    "failures_setop": "(SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem) UNION SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_orderkey FROM orders WHERE o_totalprice < 1000",
    "skip_existing_anti": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "resume_accounting": "SELECT count(*) AS total, count(quality) AS done, count(*) FILTER (quality IS NULL) AS missing, count(*) FILTER (quality = 0) AS failed FROM documents LEFT JOIN labels USING (doc_id)",
    "completeness_having": "SELECT conv_id, count(DISTINCT role) AS roles, count(*) AS turns FROM conversations GROUP BY 1 HAVING count(DISTINCT role) = 2 AND count(*) % 2 = 0",
    "shard_manifest": "SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 256 AS shard, ((row_number() OVER (ORDER BY doc_id) - 1) % 256)::INT AS pos, doc_id FROM documents",
    "manifest_merge": "SELECT s_suppkey, arg_max(v, seq) AS v FROM (SELECT s_suppkey, s_nationkey::BIGINT AS v, 1 AS seq FROM supplier UNION ALL SELECT n_nationkey, 100 + n_regionkey, 2 FROM nation) GROUP BY 1",
    "schema_union_by_name": "SELECT c_custkey AS id, 'customer' AS source, c_acctbal AS balance, NULL::INT AS size FROM customer UNION ALL SELECT p_partkey, 'part', NULL, p_size FROM part",
    "batch_status": "WITH w AS (SELECT n_nationkey::BIGINT AS batch, unnest(['train', 'validation', 'test']) AS split FROM nation), h AS (SELECT s_nationkey::BIGINT AS batch, CASE s_suppkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split, max(s_acctbal) AS b FROM supplier GROUP BY 1, 2) SELECT batch, split, CASE WHEN b IS NULL THEN 'MISSING' WHEN b > 5000 THEN 'SKIP' ELSE 'TODO' END AS status FROM w LEFT JOIN h USING (batch, split)",
    "dry_run_estimate": "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_orderkey) AS docs, ceil(count(*) / 2048)::BIGINT AS shards FROM lineitem GROUP BY 1",
    "numeric_names": "SELECT page_id, CASE WHEN n <> '' THEN lpad(n, 5, '0')[1:5] END AS name FROM (SELECT page_id, regexp_extract(url, '([0-9]+)(\\?|#|$)', 1) AS n FROM pages)",
    "task_compat_join": f"WITH {_PAIRS} SELECT doc_id, template, task FROM pairs",
    "task_pick": f"WITH {_PAIRS}{_PICK} SELECT doc_id, task, template FROM pick",
    "eligible_items": "SELECT conv_id, turn, CASE WHEN len(list_filter(w, lambda x: length(x) >= 4)) > 0 THEN len(list_filter(w, lambda x: length(x) >= 4)) ELSE len(w) END::INT AS n FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)",
    "cond_detection_lookup": f"WITH {WORDS}, f AS (SELECT page_id, lower(trim(arg_min(text, idx))) AS k FROM words GROUP BY 1) SELECT page_id, k, count(*)::INT AS n, sum(x1 + y1 + x2 + y2)::BIGINT AS total FROM words JOIN f USING (page_id) WHERE lower(trim(text)) = k GROUP BY 1, 2",
    "checkpoint_order": "WITH c AS (SELECT c_custkey, c_nationkey, coalesce(try_cast(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT), 0) AS step FROM customer) SELECT c_custkey, step, row_number() OVER (PARTITION BY c_nationkey ORDER BY step, c_custkey)::INT AS place FROM c",
}
