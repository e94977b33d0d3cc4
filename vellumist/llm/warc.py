"""6. WARC: archives written as one gzip stream, normalised to a member for each record with a sidecar offset index, and read back.

The normaliser inflates a whole-file stream once, finds record after record in it, and writes each as a gzip member of its own.
The index beside the new file names each record's offset and length, so a reader can begin anywhere.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import filesystem, fresh

LEAST_REVISIT = 100
PART_BYTES = 64_000_000  # a file is closed beyond so many bytes of payload
SALTS = 64
_CHUNK = 1 << 18
_END = b"\r\n\r\n"
_LEVEL = 1


def record(kind: str, page: int | None, url: str | None, payload: bytes, digest: str, size: int, refers: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has no payload; its size is kept beside its digest."""
    body = b"" if kind == "revisit" else payload
    uri = "".join(c for c in url or "" if c.isprintable()).replace(" ", "%20") or f"urn:page:{page}"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{page}>",
        "WARC-Date: 2020-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
        *([f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers is not None else []),
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(lines).encode() + _END + body + _END


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields in lower case, and the block, of one record."""
    head, _, rest = raw.partition(_END)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if len(rest) != n + len(_END):
        raise ValueError("a record's length is wrong")
    return fields, rest[:n]


def _page(name: str | None) -> int | None:
    """The id in <urn:page:ID>; a page without an id has None there."""
    return int(name[10:-1]) if name and name != "<urn:page:None>" else None


def inflate(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, a chunk at a time. A member that is cut off, in its trailer too, is an error, as
    is a wrong checksum."""
    z, begun = zlib.decompressobj(31), False
    while chunk := stream.read(_CHUNK):
        while chunk:
            begun = True
            if out := z.decompress(chunk):
                yield out
            chunk = z.unused_data
            if z.eof:
                z, begun = zlib.decompressobj(31), False
            else:
                break
    if begun:
        raise ValueError("the file ends within a gzip member")


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records out of inflated chunks; no more than one record and one chunk are held."""
    held = bytearray()
    need = None
    for chunk in chunks:
        held += chunk
        while True:
            if need is None:
                at = held.find(_END)
                if at < 0:
                    break
                for line in held[:at].split(b"\r\n"):
                    name, _, value = line.partition(b":")
                    if name.lower() == b"content-length":
                        need = at + 2 * len(_END) + int(value)
                if need is None:
                    raise ValueError("a record has no length")
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("the file ends within a record")


def normalise(source, target) -> list[tuple[int, int, str]]:
    """Rewrites a gzip stream of records as one member a record; (offset, length, record id) of each."""
    index, at = [], 0
    for raw in split_records(inflate(source)):
        z = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
        member = z.compress(raw) + z.flush()
        start = raw.find(b"WARC-Record-ID:") + 15
        index.append((at, len(member), raw[start : raw.find(b"\r\n", start)].decode().strip()))
        target.write(member)
        at += len(member)
    return index


def _digested(pages: DataFrame) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    return pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("long").alias("size"))


def roles(pages: DataFrame) -> DataFrame:
    """Each page with the smallest page_id of its equal payloads as ``first`` (null where there is but one, or it is small).

    Equal payloads are counted within a salt of their digest first, so a payload that a third of the pages have is spread over tasks,
    and only digests that come twice are joined, one row for each salt of theirs.
    """
    d = _digested(pages).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
    big = d.where(F.col("size") >= LEAST_REVISIT)
    part = big.groupBy("digest", "salt").agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
    whole = part.groupBy("digest").agg(F.min("least").alias("first"), F.sum("n").alias("n"), F.collect_set("salt").alias("salts")).where("n > 1")
    twice = whole.select("digest", "first", F.explode("salts").alias("salt"))
    return d.join(twice, ["digest", "salt"], "left")


def write_archives(rows: DataFrame, root: str) -> DataFrame:
    """Writes rows of :func:`roles` as gzip files of one member each under ``root``; (path, records), one row a file.

    A file is named anew in each attempt of a task, so a lost or repeated task leaves nothing that is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(root)
        fs.create_dir(base, recursive=True)
        out, z, path, n, size = None, None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.write(z.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [n]}, pa.schema([("path", pa.string()), ("records", pa.int64())]))

        for batch in batches:
            for r in range(batch.num_rows):
                page, url, html, digest, length, first = (batch.column(c)[r].as_py() for c in ("page_id", "url", "html", "digest", "size", "first"))
                if out is None:
                    path, n, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, z = fs.open_output_stream(path, compression=None), zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
                again = first is not None and first != page
                raw = record("revisit" if again else "response", page, url, html.encode(), digest, length, first if again else None)
                out.write(z.compress(raw))
                n, size = n + 1, size + length
                if size >= PART_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return rows.select("page_id", "url", "html", "digest", "size", "first").mapInArrow(run, "path string, records long")


def normalise_archives(files: DataFrame, root: str) -> DataFrame:
    """Normalises each file once; (path, index, records) of the new ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(root)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                new = f"{path.removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}.members.warc.gz"
                with fs.open_input_stream(path, compression=None) as source, fs.open_output_stream(new, compression=None) as target:
                    index = normalise(source, target)
                with fs.open_output_stream(new + ".idx", compression=None) as side:
                    side.write("".join(f"{a}\t{n}\t{name}\n" for a, n, name in index).encode())
                yield pa.RecordBatch.from_pydict({"path": [new], "index": [new + ".idx"], "records": [len(index)]}, pa.schema([("path", pa.string()), ("index", pa.string()), ("records", pa.int64())]))

    return files.select("path").mapInArrow(run, "path string, index string, records long")


def read_archives(files: DataFrame, root: str) -> DataFrame:
    """A row for each record of normalised files, found by the sidecar index and checked against its digest."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(root)
        for batch in batches:
            for path, side in zip(batch.column("path").to_pylist(), batch.column("index").to_pylist()):
                with fs.open_input_stream(side, compression=None) as s:
                    index = [x.split("\t") for x in s.read().decode().splitlines()]
                rows: list[tuple] = []
                with fs.open_input_file(path) as f:
                    size = 0
                    for at, n, name in index:
                        f.seek(int(at))
                        fields, body = parse(zlib.decompress(f.read(int(n)), 31))
                        kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
                        if fields["warc-record-id"] != name or kind == "response" and hashlib.sha256(body).hexdigest() != digest:
                            raise ValueError(f"record {name} of {path} is damaged")
                        refers = fields.get("warc-refers-to")
                        rows.append((_page(name), int(fields["x-payload-length"]), digest, kind, _page(refers), body.decode()))
                        size += len(body)
                        if size > 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return files.select("path", "index").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string")


def archive(pages: DataFrame) -> DataFrame:
    """Writes, normalises and reads back archives of ``pages`` (page_id, url, html); a row for each record.

    A null or empty html is an empty payload. Of equal payloads of LEAST_REVISIT bytes or more the smallest page_id is a response, the
    others revisit it; a repeated row (same id and payload) is a second response. An empty table gives no rows. Files lie in the
    shared folder; the lists of them are written tables, and the whole-file streams are there until their normalised copies are.
    """
    spark = pages.sparkSession
    root = fresh(spark, "warc")
    first = f"{root}-streams"
    write_archives(roles(pages), f"{root}/data").write.parquet(first)
    streams = spark.read.schema("path string, records long").parquet(first)
    n = max(1, streams.count())
    second = f"{root}-members"
    normalise_archives(streams.repartition(min(n, 100_000), "path"), f"{root}/data").write.parquet(second)
    members = spark.read.schema("path string, index string, records long").parquet(second)
    _drop(streams, f"{root}/data")
    return read_archives(members.repartition(min(n, 100_000), "path"), f"{root}/data")


def _drop(files: DataFrame, root: str) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from contextlib import suppress

        fs, _ = filesystem(root)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with suppress(FileNotFoundError):  # a repeated task finds it gone
                    fs.delete_file(path)
            yield pa.RecordBatch.from_pydict({"n": np.array([batch.num_rows])})

    files.select("path").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def op6_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("payload")


SQL_OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
w AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM w
"""
