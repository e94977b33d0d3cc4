"""Folders that all executors share, and scans whose parts can be told apart.

The folder is the one the cluster names in ``spark.checkpoint.dir``; a local one is set only where a session
names none (single-machine tests). Intermediate tables are written there, so a lost executor costs only a reread.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import buffers, slices, trim

BLOCK_BYTES = 16_000_000
_MADE: dict[str, list[str]] = {}  # paths by application


def folder(spark: SparkSession) -> str:
    """The shared folder's URI. A session that names none gets a temporary one if its master is this machine alone, else an error."""
    uri = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not uri:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        uri = "file://" + tempfile.mkdtemp(prefix="vellumist-")
        spark.conf.set("spark.checkpoint.dir", uri)
    return uri.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` hasn't."""
    while name in df.columns:
        name += "_"
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` written once in the shared folder and read from there: a cut in the lineage."""
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """:func:`stored`, and the path: for tables that are removed when what is made of them has been written."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder made by :func:`fresh`."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def filesystem(uri: str):
    """The file system of a URI and the path in it, from a Python worker."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files below ``df``, as the optimizer states them; sizes partitions, never data."""
    return min(1 << 60, int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))


def shards(df: DataFrame, per_shard: int = 16_000_000, least: int = 12) -> int:
    """How many shards a table exchanged by hash is cut into: in proportion to the input, or as many as a shuffle has where its
    size isn't known (a table made in memory)."""
    size = input_bytes(df)
    if size >= 1 << 60:
        return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return int(min(100_000, max(least, size // per_shard)))


def release(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this session; their results must have been written elsewhere by then."""
    while made := _MADE.pop(spark.sparkContext.applicationId, None):
        for path in made:
            remove(spark, path)


def scan(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of docs with _file and _start, which name the file split that each row is read from.

    Where docs are not just read (there is a shuffle, or no file), they are written to the shared folder first.
    """
    plain = docs.select(*columns)
    plan = plain._jdf.queryExecution().sparkPlan().toString()
    if "FileScan" not in plan or any(x in plan for x in ("Exchange", "Join", "Aggregate", "Window", "Sort", "Limit", "Union", "Python", "Generate", "Sample", "Expand")):
        plain = stored(plain, "docs")
    return plain.select(*columns, F.input_file_name().alias("_file"), F.input_file_block_start().alias("_start"))


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.Table]]:
    """(id, rows) of consecutive rows of one file split with about ``limit`` bytes of text.

    A split's rows always come in the same order, so each pass over a table makes the same blocks.
    """
    held: list[pa.RecordBatch] = []
    size, key, serial = 0, None, 0

    def out():
        digest = hashlib.blake2b(f"{key[0]}|{key[1]}|{serial}".encode(), digest_size=8).digest()
        return int.from_bytes(digest, "little", signed=True) >> 1, pa.Table.from_batches(held)

    for batch in batches:
        if not batch.num_rows:
            continue
        files, starts = batch.column("_file").to_numpy(False), batch.column("_start").to_numpy(False)
        edges = np.flatnonzero((files[1:] != files[:-1]) | (starts[1:] != starts[:-1])) + 1
        _, offsets = buffers(batch.column(column))
        for a, b in zip([0, *edges], [*edges, batch.num_rows]):
            now = (files[a], starts[a])
            if now != key:
                if held:
                    yield out()
                held, size, key, serial = [], 0, now, 0
            while a < b:
                to = int(min(b, np.searchsorted(offsets, offsets[a] + limit - size, "left")))
                to = max(to, a + 1)
                held.append(batch.slice(a, to - a))
                size += int(offsets[to] - offsets[a])
                a = to
                if size >= limit:
                    yield out()
                    held, size, serial = [], 0, serial + 1
    if held:
        yield out()
    held = []
    trim()


def over_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str = "text", limit: int = 4_000_000) -> DataFrame:
    """``fn`` over parts of each batch that are bounded by bytes of text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, limit):
                yield fn(part)

    return df.mapInArrow(run, schema)
