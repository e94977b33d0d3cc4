"""A data source of tar shards: members as rows, and rows as shards.

``spark.dataSource.register(TarSource)``, then ``spark.read.format("tarshards").load(pattern)`` with columns shard, key, ext, pos,
payload. A pattern is a list split at , or ; of globs or paths. Options: ext (only these, split at commas). Written rows need key, ext and
payload; a task writes a shard, or several of ``rows`` rows each.
"""

from __future__ import annotations

import glob
import io
import json
import os
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "shard string, key string, ext string, pos long, payload binary"
IMAGES = ("png", "jpg", "jpeg")


def expand(pattern: str) -> list[str]:
    """Sorted paths of a pattern; an error if there are none."""
    out = sorted({p for part in pattern.replace(";", ",").split(",") if part.strip() for p in (glob.glob(part.strip()) or ([part.strip()] if os.path.exists(part.strip()) else []))})
    if not out:
        raise FileNotFoundError(f"no shard matches {pattern}")
    return out


def key_and_ext(name: str) -> tuple[str, str]:
    base = name.rsplit("/", 1)
    stem, dot, ext = base[-1].partition(".")
    return ("/".join([*base[:-1], stem]), ext.lower()) if dot else (name, "")


class _Shard(InputPartition):
    def __init__(self, path: str):
        self.path = path


def members(path: str, wanted: set[str] | None) -> Iterator[tuple]:
    with tarfile.open(path, "r|*") as tar:
        for pos, m in enumerate(tar):
            if m.isfile():
                key, ext = key_and_ext(m.name)
                if not wanted or ext in wanted:
                    yield os.path.basename(path), key, ext, pos, tar.extractfile(m).read()


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.ext = options["path"], {x.strip().lower() for x in options.get("ext", "").split(",") if x.strip()}

    def partitions(self) -> list[InputPartition]:
        return [_Shard(p) for p in expand(self.path)]

    def read(self, partition: _Shard) -> Iterator[tuple]:
        yield from members(partition.path, self.ext)


class _Stream(DataSourceStreamReader):
    """New shards in the order in which they got their names (a rename counts), then by path.

    The offset is the time and path of the last one, so a shard is read once, wherever its name sorts. After a restart, the first batch
    takes all that has come since; later ones keep to maxFilesPerTrigger.
    """

    def __init__(self, options: dict):
        self.reader = _Reader(options)
        self.most = int(options.get("maxfilespertrigger", options.get("maxFilesPerTrigger", 0)) or 0)
        self.last: tuple[int, str] | None = None

    def _found(self) -> list[tuple[int, str]]:
        try:
            return sorted((os.stat(p).st_ctime_ns, p) for p in expand(self.reader.path))
        except FileNotFoundError:
            return []

    def initialOffset(self) -> dict:  # noqa: N802
        self.last = (0, "")  # only asked where there is no checkpoint
        return {"time": 0, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        new = [x for x in self._found() if self.last is None or x > self.last]
        if self.most and self.last is not None:
            new = new[: self.most]
        if new:
            self.last = new[-1]
        time, path = self.last or (0, "")
        return {"time": time, "path": path}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        self.last = max(self.last or high, high)
        return [_Shard(p) for t, p in self._found() if low < (t, p) <= high]

    def read(self, partition: _Shard) -> Iterator[tuple]:
        yield from self.reader.read(partition)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class _Written(WriterCommitMessage):
    paths: list[tuple[str, str, int]]


class _Writer(DataSourceWriter):
    """Shards under other names until all tasks are done; then renamed, with a manifest beside them."""

    def __init__(self, options: dict):
        self.path, self.rows, self.prefix = options["path"], int(options.get("rows", 0) or 0), options.get("prefix", "train")

    def write(self, rows: Iterator) -> _Written:
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        task, out, tar, n, temp = TaskContext.get().partitionId(), [], None, 0, ""
        keys: set = set()

        def close() -> None:
            tar.close()
            out.append((temp, f"{self.prefix}-{task:05d}-{len(out):05d}.tar", n))

        for row in rows:
            if tar is not None and self.rows and len(keys) >= self.rows and row["key"] not in keys:
                close()
                tar = None
            if tar is None:
                temp, n, keys = f"{self.path}/.{uuid.uuid4().hex}.tmp", 0, set()
                tar = tarfile.open(temp, "w")
            info = tarfile.TarInfo(f"{row['key']}.{row['ext']}")
            payload = bytes(row["payload"] or b"")
            info.size = len(payload)
            tar.addfile(info, io.BytesIO(payload))
            keys.add(row["key"])
            n += 1
        if tar is not None:
            close()
        return _Written(out)

    def commit(self, messages: list) -> None:
        names = {}
        for m in messages:
            for temp, name, n in m.paths if m else []:
                os.replace(temp, f"{self.path}/{name}")
                names[name] = n
        with open(f"{self.path}/manifest.json", "w") as f:
            json.dump(names, f, sort_keys=True)

    def abort(self, messages: list) -> None:
        for m in messages:
            for temp, _, _ in m.paths if m else []:
                if os.path.exists(temp):
                    os.remove(temp)


class TarSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tarshards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


def paired(rows: DataFrame, strict: bool = True) -> DataFrame:
    """(shard, key, json, image) of members that belong together, the first of each kind; an image is png, else jpg, else jpeg.

    Without ``strict`` an image without JSON stays, its JSON null; JSON without an image never stays.
    """
    first = lambda ext: F.min_by(F.when(F.col("ext") == ext, F.col("payload")), F.when(F.col("ext") == ext, F.col("pos")))
    got = rows.groupBy("shard", "key").agg(first("json").cast("string").alias("json"), F.coalesce(*(first(e) for e in IMAGES)).alias("image"))
    return got.where(F.col("image").isNotNull() & (F.col("json").isNotNull() if strict else F.lit(True)))


ITEMS = "array<struct<text: string, box: array<double>>>"
PAGE = f"struct<text: struct<lines: {ITEMS}, words: {ITEMS}, paragraphs: {ITEMS}, latex: {ITEMS}, text: string, text2d: string>, image: struct<path: string, width: int, height: int, dpi: int>>"


def pages(pairs: DataFrame) -> DataFrame:
    """Typed pages; missing levels are empty lists, missing texts empty; JSON that can't be read is dropped."""
    p = F.from_json("json", PAGE)
    levels = [F.coalesce(p["text"][x], F.array().cast(ITEMS)).alias(x) for x in ("lines", "words", "paragraphs", "latex")]
    texts = [F.coalesce(p["text"][x], F.lit("")).alias(x) for x in ("text", "text2d")]
    return pairs.where(F.try_parse_json("json").isNotNull()).select("shard", "key", *levels, *texts, p["image"]["width"].alias("width"), p["image"]["height"].alias("height"), p["image"]["dpi"].alias("dpi"), "image")


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, ground_truth) of JSON lines; blank and broken lines, and those without a file name, are left out."""
    rows = spark.read.schema("file_name string, ground_truth string, _bad string").option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(path)
    return rows.where("file_name is not null").select("file_name", "ground_truth")


def samples(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, ground_truth) of a folder of JSON lines or of tar shards, whichever ``path`` is."""
    if path.endswith(".tar"):
        spark.dataSource.register(TarSource)
        rows = spark.read.format("tarshards").option("ext", "json").load(path)
        return rows.select(F.col("key").alias("file_name"), F.col("payload").cast("string").alias("ground_truth"))
    return jsonl(spark, path)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction CSV with its schema; rows of another width are dropped."""
    columns = ("filename", "task_type", "output_type", "question_idx", "question", "expected_answer", "predicted_answer")
    return spark.read.csv(path, header=True, multiLine=True, escape='"', mode="DROPMALFORMED", schema=", ".join(f"{c} string" for c in columns))


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, width, height, format) of image files below a folder, read from their headers."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.lower("path").rlike(r"\.(png|jpe?g)$"))
    return files.select("path", "content", F.inline(F.array(header("content"))))


def header(content: str | Column) -> Column:
    """width, height and format of PNG or JPEG bytes; nulls for anything else."""
    @F.pandas_udf("width int, height int, format string")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([size_of(bytes(x or b"")) for x in s], columns=["width", "height", "format"]).astype({"width": "Int32", "height": "Int32"})

    return run(content)


def size_of(raw: bytes) -> tuple[int | None, int | None, str | None]:
    if raw[:8] == b"\x89PNG\r\n\x1a\n" and len(raw) >= 24:
        return int.from_bytes(raw[16:20], "big"), int.from_bytes(raw[20:24], "big"), "png"
    if raw[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(raw) and raw[at] == 0xFF:
            kind, n = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(raw[at + 7 : at + 9], "big"), int.from_bytes(raw[at + 5 : at + 7], "big"), "jpeg"
            at += 2 + n
    return None, None, None
