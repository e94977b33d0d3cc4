"""Exact totals of any number of keys, asked for by blocks of documents and answered block by block.

A block sends its distinct keys, sorted, with its own counts, cut by key range into shards. A shard adds up all blocks' counts and
answers each block in the order of its keys, so answers need no keys. What is shuffled are packed arrays, pre-aggregated: a key costs
one entry a block however often it occurs, and no shard or block holds more than its share. Answers lie in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import blocks, filesystem, fresh, input_bytes, shards
from .text import distinct

PER_FOLDER = 64_000_000
_ANSWER, _TOP, _GROUP = 0, 1, 2


def shard_edges(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """Where each shard's keys begin among rising ``keys``, and the end of the last."""
    inner = np.searchsorted(keys, (np.arange(1, n_shards, dtype=np.float64) * (2.0**64 / n_shards)).astype(np.uint64))
    return np.concatenate(([0], inner, [len(keys)]))


def ask(docs: DataFrame, of_block: Callable, column: str = "text", n_shards: int = 12, block_bytes: int = 16_000_000) -> DataFrame:
    """of_block(rows of a block) -> (keys sorted and distinct, counts, a small group of each key), packed by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in blocks(batches, column, block_bytes):
            keys, counts, group = of_block(rows)
            edges = shard_edges(keys, n_shards)
            pack = lambda a, f: pa.array([f(a[edges[s] : edges[s + 1]]) for s in range(n_shards)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_shards)), pa.array(np.full(n_shards, block)), pack(keys, packed_keys), pack(counts, packed), pack(group, packed)], ["shard", "block", "keys", "counts", "groups"])

    return docs.mapInArrow(run, "shard long, block long, keys binary, counts binary, groups binary")


def squeezed(raw: bytes) -> bytes:
    """Compressed, behind its length in eight bytes: whether the shuffle compresses is not for this to rely on."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    return pa.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def packed_keys(keys: np.ndarray) -> bytes:
    """Rising keys as differences, byte plane by byte plane: the high planes are nearly all zeros."""
    step = np.diff(keys, prepend=np.zeros(1, np.uint64))
    return squeezed(step.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(unsqueezed(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def packed(values: np.ndarray) -> bytes:
    """Counts in as few bytes as the largest of them needs; the first byte tells which."""
    top = int(values.max()) if len(values) else 0
    kind = next(k for k in "BHIq" if top <= np.iinfo(k).max)
    return kind.encode() + squeezed(values.astype(kind).tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(unsqueezed(raw[1:]), chr(raw[0])).astype(np.int64)


class Answers:
    """Totals by block, the most frequent keys, and the totals of each group."""

    def __init__(self, docs: DataFrame, of_block: Callable, column: str = "text", top: int = 0, block_bytes: int = 16_000_000, shard_bytes: int = 16_000_000, top_below: int = 256):
        spark = docs.sparkSession
        self.path, self.parts = fresh(spark, "totals"), folders(docs)
        parts = self.parts

        def add(table: pa.Table) -> pa.Table:
            keys = [unpacked_keys(x) for x in table.column("keys").to_pylist()]
            counts = np.concatenate([unpacked(x) for x in table.column("counts").to_pylist()])
            groups = np.concatenate([unpacked(x).astype(np.uint8) for x in table.column("groups").to_pylist()])
            every = np.concatenate(keys)
            order = np.argsort(every)
            in_order = every[order]
            heads = distinct(in_order)
            total = np.add.reduceat(counts[order], heads) if len(heads) else np.zeros(0, np.int64)
            answers, at = np.empty(len(every), np.int64), np.cumsum([0, *map(len, keys)])
            answers[order] = np.repeat(total, np.diff(np.append(heads, len(every))))
            data = [packed(answers[a:b]) for a, b in zip(at, at[1:])]
            rows = [(_ANSWER, block, shard, 0, 0, x) for block, shard, x in zip(table.column("block").to_pylist(), table.column("shard").to_pylist(), data)]
            one = order[heads]
            seen = total > 0
            group, key, total = groups[one][seen], every[one][seen], total[seen]
            if top and len(total):
                able = np.flatnonzero(group < top_below)
                best = able[np.argsort(-total[able], kind="stable")[:top]]
                rows += [(_TOP, 0, k, n, g, None) for k, n, g in zip(key[best].view(np.int64).tolist(), total[best].tolist(), group[best].tolist())]
            n, v = np.bincount(group, total, 256), np.bincount(group, minlength=256)
            rows += [(_GROUP, 0, g, int(n[g]), int(v[g]), None) for g in np.flatnonzero(v).tolist()]
            kinds = [("kind", pa.int8()), ("block", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("data", pa.binary())]
            return pa.table([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], schema=pa.schema(kinds)) if rows else pa.schema(kinds).empty_table()

        n_shards = shards(docs, shard_bytes)
        rows = ask(docs, of_block, column, n_shards, block_bytes).repartition(n_shards, "shard").groupBy("shard").applyInArrow(add, "kind byte, block long, a long, b long, c long, data binary")
        part = F.when(F.col("kind") == _ANSWER, F.pmod("block", F.lit(parts))).otherwise(F.lit(-1))
        write_by_block(rows.withColumn("part", part), self.path, parts)
        schema = "kind byte, block long, a long, b long, c long, data binary, part int"
        rest = spark.read.schema(schema).parquet(self.path).where("part = -1")
        #: (key, total, group) of the most frequent keys whose group is less than top_below; ties by key
        self.top = [tuple(r) for r in rest.where(f"kind = {_TOP}").orderBy(F.desc("b"), "a").limit(max(1, top)).select("a", "b", "c").collect()] if top else []
        #: group -> (sum of counts, keys with a count)
        self.groups = {r[0]: (r[1], r[2]) for r in rest.where(f"kind = {_GROUP}").groupBy("a").agg(F.sum("b"), F.sum("c")).collect()}

    def reader(self) -> Callable[[int], np.ndarray]:
        """For workers: block -> totals in the order of its keys."""
        read = block_reader(self.path, self.parts)
        return lambda block: np.concatenate([np.zeros(0, np.int64), *(unpacked(x) for x in read(block))])


def folders(docs: DataFrame) -> int:
    """How many folders the answers to the blocks of ``docs`` are written in."""
    return max(1, min(100_000, input_bytes(docs) // PER_FOLDER))


def write_by_block(rows: DataFrame, path: str, parts: int) -> None:
    """Writes (part, block, a, data): a folder for each part, a block's rows in one file."""
    rows.repartition("part", "block").sortWithinPartitions("part", "block", "a").write.partitionBy("part").parquet(path)


def block_reader(path: str, parts: int) -> Callable[[int], list[bytes]]:
    """For workers: block -> data of the block's rows in the order of a."""

    def read(block: int) -> list[bytes]:
        import pyarrow.dataset as ds
        from pyarrow.fs import FileType

        fs, base = filesystem(f"{path}/part={block % parts}")
        if fs.get_file_info(base).type == FileType.NotFound:
            return []
        t = ds.dataset(base, filesystem=fs, format="parquet").to_table(columns=["a", "data"], filter=ds.field("block") == block)
        return t.sort_by("a").column("data").to_pylist()

    return read


def ranked(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values, the place of each value among them)."""
    order = np.argsort(h)
    in_order = h[order]
    heads = distinct(in_order)
    keys = in_order[heads]
    del in_order
    inverse = np.empty(len(h), np.int32 if len(h) < 1 << 31 else np.int64)
    inverse[order] = np.repeat(np.arange(len(heads), dtype=inverse.dtype), np.diff(np.append(heads, len(h))))
    return keys, inverse


def ranked_hashes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`ranked` of values that differ in their high bits: these are sorted with each value's place in the low bits, which needs no
    index beside them. The few values that differ only below are put in order afterwards; where they aren't few, all are ranked anew."""
    n = len(h)
    bits = np.uint64(max(1, n - 1).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    order = h & ~low
    order |= np.arange(n, dtype=np.uint64)
    order.sort()
    order &= low
    order = order.view(np.int64)
    in_order = np.take(h, order)
    wrong = np.flatnonzero(in_order[1:] < in_order[:-1])
    if len(wrong) > max(64, n >> 12):
        return ranked(h)
    if len(wrong):
        high = in_order >> bits
        for value in np.unique(high[wrong]):
            a, b = np.searchsorted(high, value, "left"), np.searchsorted(high, value, "right")
            order[a:b] = order[a:b][np.argsort(in_order[a:b])]
            in_order[a:b] = h[order[a:b]]
        del high
    head = np.ones(n, bool)
    np.not_equal(in_order[1:], in_order[:-1], out=head[1:])
    keys = in_order[head]
    del in_order
    inverse = np.empty(n, np.int32 if n < 1 << 31 else np.int64)
    rank = np.cumsum(head, dtype=inverse.dtype)
    rank -= 1
    inverse[order] = rank
    return keys, inverse
