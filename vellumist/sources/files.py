"""Tables of files: folders of documents, JSON of both shapes, images in Parquet, logs; and sinks that never write in place.

Paths are those of Spark's file systems; only :func:`write_files` and :func:`listing` handle single files themselves,
below a path that all executors mount.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGES = r"(?i)\.(png|jpe?g|tiff?|bmp|webp)$"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names; a temporary one only where the master is this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="vellumist-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _branches(base: str, want: int = 64, most: int = 10_000) -> list[str]:
    """Folders and files below ``base`` that hold all its files: a level with ``want`` folders or more, or the last before ``most``."""
    folders, files = [base], []
    while folders and len(folders) < want:
        below, here = [], []
        for f in folders:
            with os.scandir(f) as it:
                for x in it:
                    (below if x.is_dir() else here).append(x.path)
                    if len(below) + len(here) + len(files) > most:
                        return folders + files
        folders, files = below, files + here
    return folders + files


def _pattern(depth_glob: str) -> re.Pattern:
    """A glob by folders as an expression over a path below the root: as Hadoop's, * and ? stop at /, braces are alternatives."""
    kinds = {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", "[": "[", "]": "]"}
    out, deep, inside = "", 0, False
    for c in depth_glob:
        if inside:
            out, inside = out + ("^" if c == "!" and out.endswith("[") else c), c != "]"
            continue
        inside, deep = c == "[", deep + (c == "{") - (c == "}")
        out += "|" if c == "," and deep else kinds.get(c) or re.escape(c)
    return re.compile(out)


def _walked(spark: SparkSession, base: str, depth_glob: str) -> DataFrame:
    """(path, length) of files, found by the executors a branch of folders at a time; the driver reads the upper folders alone."""
    starts = _branches(base)
    named = _pattern(depth_glob) if depth_glob else None
    # as Spark reads folders: names that begin with _ or . are hidden
    shown = lambda name: not name.startswith((".", "_"))

    def wanted(path: str) -> bool:
        below = os.path.relpath(path, base)
        if named:  # a folder that the glob names stands for the files in it
            return shown(os.path.basename(path)) and any(map(named.fullmatch, (below, os.path.dirname(below))))
        return all(map(shown, below.split("/")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple[str, int]] = []
        for pdf in frames:
            for start in pdf["start"]:
                stack = [start]
                while stack:
                    at = stack.pop()
                    if not os.path.isdir(at):
                        out += [(f"file:{at}", os.path.getsize(at))] if wanted(at) else []
                        continue
                    with os.scandir(at) as it:
                        for x in it:
                            if x.is_dir():
                                stack.append(x.path)
                            elif wanted(x.path):
                                out.append((f"file:{x.path}", x.stat().st_size))
                    if len(out) >= 10_000:
                        yield pd.DataFrame(out, columns=["path", "length"])
                        out = []
        yield pd.DataFrame(out, columns=["path", "length"])

    tasks = max(1, min(len(starts), 64))
    return spark.createDataFrame([(x,) for x in starts], "start string").repartition(tasks).mapInPandas(run, "path string, length long")


def listing(spark: SparkSession, path: str, depth_glob: str = "") -> DataFrame:
    """(path, folder, stem, ext, size) of the files below ``path``, recursive, or of those that a glob such as ??/??/*.pdf names.

    Folders that all executors mount are read by them, as a list of all files may be more than the driver holds; other file systems are
    listed by Spark.
    """
    base = re.sub(r"^file:(//)?(?=/)", "", path).rstrip("/")
    if base.startswith("/") and os.path.isdir(base):
        files = _walked(spark, base, depth_glob)
    else:
        r = spark.read.format("binaryFile")
        files = r.load(f"{path}/{depth_glob}") if depth_glob else r.option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", F.element_at(F.split("path", "/"), -2).alias("folder"), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1).alias("stem"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("ext"), F.col("length").alias("size"))


def document_folders(files: DataFrame) -> DataFrame:
    """(folder, pdf, json, images) of {id}/{id}.pdf with {id}.json, and of page images beside; images in order of name."""
    own = F.col("stem") == F.col("folder")
    page = F.when(F.col("path").rlike(IMAGES), F.col("stem"))
    return files.groupBy("folder").agg(F.bool_or(own & (F.col("ext") == "pdf")).alias("pdf"), F.bool_or(own & (F.col("ext") == "json")).alias("json"), F.array_sort(F.collect_list(page)).alias("images"))


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of files that hold one JSON array each."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def json_values(spark: SparkSession, path: str) -> DataFrame:
    """(pos, key, value) of files that hold one object of strings each, in the object's order."""
    text = spark.read.option("wholetext", "true").text(path)
    return text.select(F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("pos", "e")).select("pos", "e.key", "e.value")


def image_table(spark: SparkSession, path: str) -> DataFrame:
    """(name, image) of Parquet whose image column is bytes or a struct with bytes; a row without a file name is row_{i}.png by its place."""
    df = spark.read.parquet(path)
    image = F.col("image.bytes") if isinstance(df.schema["image"].dataType, T.StructType) else F.col("image")
    names = [F.col(c) for c in ("file_name", "filename") if c in df.columns]
    place = F.concat(F.lit("row_"), F.monotonically_increasing_id().cast("string"), F.lit(".png"))
    return df.select(F.coalesce(*names, place).alias("name"), image.alias("image"))


def pages_of(spark: SparkSession, path: str, page_schema: str) -> DataFrame:
    """Rows of Parquet with a JSON string ``annotation`` and a payload: the annotation parsed, the payload's size beside it."""
    df = spark.read.parquet(path)
    return df.withColumn("annotation", F.from_json("annotation", page_schema)).withColumn("size", F.octet_length("payload").cast("long"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def publish(df: DataFrame, root: str, kind: str = "parquet", **options: str) -> str:
    """A new version below ``root``; what was there stays as the backup. The path of this version."""
    path = f"{root}/version-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").options(**options).format(kind).save(path)
    return path


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """JSON lines in a folder for each split."""
    df.write.mode("append").partitionBy(split).json(path)


def write_files(df: DataFrame, root: str, name: str = "name", payload: str = "payload") -> int:
    """A file for each row, under its name below ``root``: written beside and renamed, so none is ever half there. How many there are."""
    base = root.removeprefix("file://")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for n, data in zip(pdf[name], pdf[payload]):
                target = os.path.join(base, n)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                temp = f"{target}.{uuid.uuid4().hex}.tmp"
                with open(temp, "wb") as f:
                    f.write(bytes(data or b""))
                os.replace(temp, target)
            yield pd.DataFrame({"n": [len(pdf)]})

    return df.select(name, payload).mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
