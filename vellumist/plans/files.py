"""Queries that write tables as files of each kind and read them back through the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import selection as S
from ..sources import files as X
from ..sources.tar import TarSource
from .views import table


def tar_round_trip(spark, d):
    """Documents as members of tar shards of 64, and back."""
    spark.dataSource.register(TarSource)
    path = X.scratch(spark, "shards").removeprefix("file://")
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), F.lit("txt").alias("ext"), F.coalesce("text", F.lit("")).cast("binary").alias("payload"))
    docs.write.format("tarshards").mode("append").option("rows", "64").save(path)
    back = spark.read.format("tarshards").load(f"{path}/*.tar")
    return back.select(F.col("key").cast("long").alias("doc_id"), F.col("payload").cast("string").alias("text"))


def split_json_round_trip(spark, d):
    path = X.scratch(spark, "splits")
    split = F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "validation").otherwise("train")
    X.write_splits(table(spark, d, "documents").select("doc_id", "text", split.alias("split")), path)
    return spark.read.schema("doc_id long, text string, split string").json(path)


def csv_versions(spark, d):
    """Two versions of a table as CSV; the second is read, the first is still there."""
    root, s = X.scratch(spark, "csv"), table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    first = X.publish(s.withColumn("s_name", F.lit("old")), root, "csv", header="true")
    second = X.publish(s.withColumn("s_name", F.concat("s_name", F.lit(', "x"'))), root, "csv", header="true", escape='"')
    old = spark.read.option("header", "true").csv(first).where("s_name = 'old'").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), F.lit(True).alias("backup"))
    new = spark.read.schema("s_suppkey long, s_name string, s_acctbal double").option("header", "true").option("escape", '"').csv(second)
    return new.join(old, "s_suppkey", "left")


def _nations(spark, d):
    return table(spark, d, "nation").select(F.col("n_regionkey").alias("r"), F.struct(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name").alias("n"))


def json_array_scan(spark, d):
    """A file for each region with one array of its nations."""
    path = X.scratch(spark, "arrays")
    arrays = _nations(spark, d).groupBy("r").agg(F.to_json(F.array_sort(F.collect_list("n"))).cast("binary").alias("payload"))
    X.write_files(arrays.select(F.concat("r", F.lit(".json")).alias("name"), "payload"), path)
    return X.json_array(spark, path, "n_nationkey long, n_name string")


def json_object_scan(spark, d):
    """A file for each region with one object of its nations' names."""
    path = X.scratch(spark, "objects")
    objects = _nations(spark, d).groupBy("r").agg(F.to_json(F.map_from_entries(F.transform(F.array_sort(F.collect_list("n")), lambda n: F.struct(n["n_nationkey"].cast("string"), n["n_name"])))).cast("binary").alias("payload"))
    X.write_files(objects.select(F.concat("r", F.lit(".json")).alias("name"), "payload"), path)
    return X.json_values(spark, path).select(F.col("pos").cast("long").alias("pos"), "key", "value")


def _tree(spark, d):
    """Customers as folders {id} below two characters of a hash: a PDF, JSON for most, page images for some."""
    path = X.scratch(spark, "folders")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.md5(F.col("c_custkey").cast("string").cast("binary")).alias("h"))
    base = F.concat(F.substring("h", 1, 2), F.lit("/"), "k", F.lit("/"))
    kinds = [(F.lit(True), F.concat("k", F.lit(".pdf"))), (F.col("k") % 4 != 0, F.concat("k", F.lit(".json"))), (F.col("k") % 3 == 0, F.lit("p2.png")), (F.col("k") % 3 == 0, F.lit("p1.JPG"))]
    names = F.explode(F.filter(F.array(*(F.when(when, F.concat(base, name)) for when, name in kinds)), lambda x: x.isNotNull()))
    X.write_files(c.select("k", names.alias("name")).withColumn("payload", F.repeat(F.lit("x"), F.length("name")).cast("binary")).repartition("k"), path)
    return path


def document_folder_scan(spark, d):
    f = X.document_folders(X.listing(spark, _tree(spark, d)))
    return f.select(F.col("folder").cast("long").alias("c_custkey"), "pdf", "json", F.array_join("images", ",").alias("images"))


def pdf_tree_scan(spark, d):
    return X.listing(spark, _tree(spark, d), "??/*/*.pdf").select(F.col("stem").cast("long").alias("c_custkey"), "size")


def image_table_scan(spark, d):
    """Images as structs with bytes in one table, as bytes in another."""
    path, p = X.scratch(spark, "images"), table(spark, d, "pages").select("page_id", F.coalesce("html", F.lit("")).cast("binary").alias("b"))
    p.select(F.concat("page_id", F.lit(".png")).alias("file_name"), F.struct(F.col("b").alias("bytes"), F.lit("").alias("path")).alias("image")).write.parquet(f"{path}/structs")
    p.select(F.concat("page_id", F.lit(".png")).alias("filename"), F.col("b").alias("image")).write.parquet(f"{path}/bytes")
    a, b = (X.image_table(spark, f"{path}/{k}").select(F.lit(k).alias("kind"), "name", F.sha2("image", 256).alias("digest")) for k in ("structs", "bytes"))
    return a.unionByName(b)


def page_table_scan(spark, d):
    """Pages with an annotation as a JSON string and a payload column."""
    path, p = X.scratch(spark, "pages"), table(spark, d, "pages")
    p.select("page_id", F.to_json(F.struct("url", F.array(F.struct(F.col("page_id").alias("idx"))).alias("lines"))).alias("annotation"), F.col("html").cast("binary").alias("payload")).write.parquet(path)
    return X.pages_of(spark, path, "url string, lines array<struct<idx: bigint>>").select("page_id", "annotation.url", F.get(F.col("annotation.lines"), F.lit(0))["idx"].alias("idx"), "size")


def log_scan(spark, d):
    """What became of each file, by log lines that say it once or more."""
    path, s = X.scratch(spark, "logs"), table(spark, d, "supplier").select("s_suppkey")
    file = F.concat(F.lit("/in/"), "s_suppkey", F.lit(".pdf"))
    lines = [F.concat(F.lit("INFO start "), file), F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("INFO Successfully processed "), file)), F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("WARN "), file, F.lit(": 0 pages"))), F.when(F.col("s_suppkey") % 7 == 0, F.concat(F.lit("ERROR failed on '"), file, F.lit("': timeout")))]
    s.select(F.explode(F.filter(F.array(*lines), lambda x: x.isNotNull())).alias("value")).write.text(path)
    return S.log_results(X.log_lines(spark, path))


QUERIES = {f.__name__: f for f in (tar_round_trip, split_json_round_trip, csv_versions, json_array_scan, json_object_scan, document_folder_scan, pdf_tree_scan, image_table_scan, page_table_scan, log_scan)}
SQL = {
    "tar_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "split_json_round_trip": "SELECT doc_id, text, CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'validation' ELSE 'train' END AS split FROM documents",
    "csv_versions": "SELECT s_suppkey, s_name || ', \"x\"' AS s_name, s_acctbal, true AS backup FROM supplier",
    "json_array_scan": "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation",
    "json_object_scan": "SELECT row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS pos, n_nationkey::VARCHAR AS key, n_name AS value FROM nation",
    "document_folder_scan": "SELECT c_custkey, true AS pdf, c_custkey % 4 <> 0 AS json, CASE WHEN c_custkey % 3 = 0 THEN 'p1,p2' ELSE '' END AS images FROM customer",
    "pdf_tree_scan": "SELECT c_custkey, length(c_custkey::VARCHAR) * 2 + 8 AS size FROM customer",
    "image_table_scan": "SELECT unnest(['structs', 'bytes']) AS kind, page_id || '.png' AS name, sha256(coalesce(html, '')) AS digest FROM pages",
    "page_table_scan": "SELECT page_id, url, page_id AS idx, strlen(html) AS size FROM pages",
    "log_scan": "SELECT path, state FROM (SELECT '/in/' || s_suppkey || '.pdf' AS path, CASE WHEN s_suppkey % 7 = 0 THEN 'failed' WHEN s_suppkey % 5 = 0 THEN 'empty' WHEN s_suppkey % 3 <> 0 THEN 'processed' END AS state FROM supplier) WHERE state IS NOT NULL",
}
