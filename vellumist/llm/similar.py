"""3. N-gram Jaccard join by parity sketches.

A document's distinct word shingles are XORed into bits: each flips one, so the Hamming distance of two sketches never exceeds the
symmetric difference of the sets. Sets of one size band that are at least THRESHOLD percent alike differ in at most d shingles;
cut into d + 1 blocks, their sketches agree in one block at least, and equal blocks are what is joined; empty blocks, which sets
share by chance, are joined by what their other blocks must then be like. Candidates are held against whole sketches, then verified on the sets themselves. Equal sets are one class from the start, so copies are never paired.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exchange import components, key_filter, passes
from .shared import free_name, shards, stored
from .text import Words, buffers, distinct, mix, shingles, slices

WIDTH, THRESHOLD = 5, 90
TILE = 512  # classes of one side of a task of pairs
HOT = 32  # a block that more classes share is hot: those are joined into families, whose pairs are compared once
FEW_BLOCKS, MOST_EMPTY = 64, 16  # sketches of fewer blocks name pairs of empty ones; empty blocks whose parities are keys
COMPARED = 4_000_000  # bytes of sketches that are compared at a time
_RATIO = 1.25
_LEAST, _n = [1], 1
while _n < 1 << 40:
    _n = max(_n + 1, int(_n * _RATIO))
    _LEAST.append(_n)
_LEAST = np.array(_LEAST, np.int64)  # the smallest size of each band


def differing(size: np.ndarray | int, threshold: int = THRESHOLD):
    """The largest symmetric difference of two similar sets whose sizes add up to ``size``."""
    return size * (100 - threshold) // (100 + threshold)


def band_blocks(band: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """Blocks for pairs whose smaller set lies in ``band``: one more than they can differ in."""
    most = _LEAST[band + 1] - 1
    return differing(most + most * 100 // threshold, threshold) + 1


def bands(n: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(set, band) of every band that a set may have a smaller or equal partner's in."""
    home = np.searchsorted(_LEAST, n, "right") - 1
    sets, out, at = [np.arange(len(n))], [home], home.copy()
    live = np.arange(len(n))
    while len(live):
        at = at - 1
        ok = (at >= 0) & ((_LEAST[np.maximum(at, 0) + 1] - 1) * 100 >= n[live] * threshold)
        live, at = live[ok], at[ok]
        sets.append(live)
        out.append(at)
    return np.concatenate(sets), np.concatenate(out)


def block_keys(values: np.ndarray, first: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(key, set) of each block of each set's sketches; ``values`` are the sets' shingles, set i's at first[i]:first[i + 1].

    A block's key is the XOR of its shingles' hashes. Empty blocks are equal by chance in about one of a hundred sets of a band, so
    they have other keys: see :func:`_empty_keys`.
    """
    n = np.diff(first)
    some = np.flatnonzero(n)
    which, band = bands(n[some], threshold)
    which = some[which]
    blocks = band_blocks(band, threshold)
    begin = np.cumsum(blocks) - blocks
    size = n[which]
    total = int(size.sum())
    at = np.arange(total) + np.repeat(first[which] - (np.cumsum(size) - size), size)
    h = mix(values[at] + np.uint64(0x5851F42D4C957F2D))
    slot = np.repeat(begin, size) + ((h >> np.uint64(32)) * np.repeat(blocks, size).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    words = np.zeros(int(blocks.sum()), np.uint64)
    np.bitwise_xor.at(words, slot, h)
    count = np.bincount(slot, minlength=len(words))
    owner = np.repeat(np.arange(len(which)), blocks)
    number = np.arange(len(words)) - begin[owner]
    place = mix(number.astype(np.uint64) * np.uint64(1 << 8) + band[owner].astype(np.uint64) + np.uint64(1))
    full = np.flatnonzero(count)
    key, of = _empty_keys(count, begin, blocks, band, owner, place)
    return np.concatenate([mix(words[full] ^ place[full]), key]), which[np.concatenate([owner[full], of])]


def _empty_keys(count: np.ndarray, begin: np.ndarray, blocks: np.ndarray, band: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, sketch) for pairs whose sketches agree in no block but g >= 1 that are empty in both; ``count`` shingles are in each block.

    All other blocks differ in a shingle at least, and all of them in g - 1 more than there are blocks at most, so but for g - 1 of them
    the parities of their counts are opposite. For g = 1 all are: the key is the empty block and the parities, up to their complement.
    For g = 2 it is both blocks and one half of the parities, of which one half is opposite throughout. From g = 3 on (for many blocks
    2) parities agree in 2g - 1 places at most, and one of 2g stretches is opposite. Sketches of more than MOST_EMPTY empty blocks
    may agree in more of them, for which each empty block is a key by itself.
    """
    keys, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    empty = np.flatnonzero(count == 0)
    s = owner[empty]
    n_empty = np.bincount(s, minlength=len(blocks))
    zero = np.zeros(1, np.uint64)
    odd = np.concatenate([zero, np.bitwise_xor.accumulate(np.where(count & 1, place, zero))])
    every = np.concatenate([zero, np.bitwise_xor.accumulate(place)])

    def add(sketch: np.ndarray, low: np.ndarray, high: np.ndarray, without: np.ndarray, tag: np.ndarray) -> None:
        """Keys of the parities of blocks low:high, of those but ``without``, the XOR of their places."""
        low, high = begin[sketch] + low, begin[sketch] + high
        parity, whole = odd[low] ^ odd[high], every[low] ^ every[high] ^ without
        keys.append(mix(mix(np.minimum(parity, parity ^ whole) + tag) ^ mix(band[sketch].astype(np.uint64) + np.uint64(1 << 16))))
        of.append(sketch)

    add(s, np.zeros_like(s), blocks[s], place[empty], mix(place[empty] + np.uint64(1)))
    step, few = 1, blocks < FEW_BLOCKS
    while len(a := np.flatnonzero((s[step:] == s[:-step]) & few[s[:-step]])):
        one, two, sketch = empty[a], empty[a + step], s[a]
        cut = blocks[sketch] // 2
        tag = mix(mix(place[one] + np.uint64(2)) ^ place[two])
        left, right = (begin[sketch] + cut > x for x in (one, two))
        add(sketch, np.zeros_like(cut), cut, np.where(left, place[one], zero) ^ np.where(right, place[two], zero), tag)
        add(sketch, cut, blocks[sketch], np.where(left, zero, place[one]) ^ np.where(right, zero, place[two]), tag + np.uint64(1))
        step += 1
    for g in range(2, min(MOST_EMPTY, int(n_empty.max(initial=0))) + 1):
        sketch = np.flatnonzero((n_empty >= g) & (~few | (g > 2)))
        for k in range(2 * g):
            low, high = blocks[sketch] * k // (2 * g), blocks[sketch] * (k + 1) // (2 * g)
            add(sketch, low, high, zero, mix(np.array([(g << 16) + k], np.uint64)))
    many = np.flatnonzero(n_empty[s] > MOST_EMPTY)
    keys.append(mix(place[empty[many]]))
    of.append(s[many])
    return np.concatenate(keys), np.concatenate(of)


def set_ids(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set, equal for equal sets; 0 for an empty one."""
    n = np.diff(first)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        x = np.bitwise_xor.reduceat(values, first[some])
        s = np.add.reduceat(mix(values), first[some])
        out[some] = mix(mix(x + n[some].astype(np.uint64)) ^ s) | np.uint64(1)
    return out


def sketch_bits(n: int) -> int:
    """Bits of a whole sketch: two or more a shingle, a power of two."""
    return max(64, 1 << (2 * n - 1).bit_length())


def sketch(values: np.ndarray) -> bytes:
    bits = sketch_bits(len(values))
    at = (mix(values) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(sketch_bytes: np.ndarray, size: int) -> np.ndarray:
    """A sketch folded to ``size`` bytes; distances only shrink."""
    return np.bitwise_xor.reduce(sketch_bytes.reshape(-1, size), 0)


def _sets(part: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = buffers(part.column(column))
    w = Words(data, offsets, lower=True)
    return shingles(w.hashes(), w.first, WIDTH)


def describe(df: DataFrame, column: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, class, n, sketch) of each row; a row without words has class 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                values, first = _sets(part, column)
                each = [sketch(values[a:b]) if b > a else None for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column(key).cast(pa.int64()), pa.array(set_ids(values, first).view(np.int64)), pa.array(np.diff(first)), pa.array(each, pa.binary())], [key, "class", "n", "sketch"])

    return df.select(key, column).mapInArrow(run, f"{key} long, class long, n long, sketch binary")


def _packed_keys(df: DataFrame, column: str, n_shards: int, threshold: int) -> DataFrame:
    """Block keys and their classes in a row for each shard and stretch of input, each (key, class) once a stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        classes: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            k, c = np.concatenate(keys), np.concatenate(classes)
            order = np.lexsort((c, k)) if len(k) < 1000 else np.argsort(k, kind="stable")
            k, c = k[order], c[order]
            fresh_ = np.ones(len(k), bool)
            fresh_[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
            k, c = k[fresh_], c[fresh_]
            edges = np.searchsorted(k, (np.arange(n_shards + 1, dtype=np.float64) * (2.0**64 / n_shards)).clip(0, 2.0**64 - 2049).astype(np.uint64))
            edges[0], edges[-1] = 0, len(k)
            some = np.flatnonzero(np.diff(edges))
            return pa.RecordBatch.from_arrays([pa.array(some), pa.array([k[edges[s] : edges[s + 1]].tobytes() for s in some], pa.binary()), pa.array([c[edges[s] : edges[s + 1]].tobytes() for s in some], pa.binary())], ["shard", "keys", "classes"])

        for batch in batches:
            for part in slices(batch, column, 2_000_000):
                values, first = _sets(part, column)
                ids = set_ids(values, first)
                # copies within the part have one row of keys
                n = np.diff(first)
                by = np.argsort(ids, kind="stable")
                one = np.sort(by[distinct(ids[by])])
                one = one[n[one] > 0]
                pick = np.concatenate([values[first[i] : first[i + 1]] for i in one]) if len(one) else values[:0]
                k, which = block_keys(pick, np.concatenate(([0], np.cumsum(n[one]))), threshold)
                keys.append(k)
                classes.append(ids[one][which])
                size += len(k)
                if size > 1_000_000:
                    yield flush()
                    keys, classes, size = [], [], 0
        if size:
            yield flush()

    return df.select(column).mapInArrow(run, "shard long, keys binary, classes binary")


def _tasks(packed: DataFrame) -> DataFrame:
    """(task, side, class): classes that share a block, in tasks of at most TILE a side.

    A task is named by its members, so that the many blocks that the same classes share make one. Near copies share most of their
    blocks, each with others of their family, so hot blocks' classes are joined into families (connected components over their
    blocks), and all pairs of a family are compared once in place of once a block; where a family is so loose that its blocks have fewer
    pairs, they stay. What has more than TILE classes is cut into tiles, and pairs of tiles are made by a later stage, spread over all tasks.
    """

    def run(table: pa.Table) -> pa.Table:
        k = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()])
        c = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("classes").to_pylist()])
        order = np.argsort(k)
        k, c = k[order], c[order]
        heads = distinct(k)
        size = np.diff(np.append(heads, len(k)))
        two = heads[size == 2]
        a, b = np.minimum(c[two], c[two + 1]), np.maximum(c[two], c[two + 1])
        a, b = a[a != b], b[a != b]
        pair = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
        rows: dict[tuple[int, int], tuple[int, int, int, bytes, int]] = {}
        for at, n in zip(heads[size > 2].tolist(), size[size > 2].tolist()):
            m = np.unique(c[at : at + n])
            if len(m) > 1:
                name = int.from_bytes(hashlib.blake2b(m.tobytes(), digest_size=8).digest(), "little", signed=True)
                tiles = -(-len(m) // TILE)
                for t in range(tiles):
                    rows[name, t] = (name, t, tiles, m[t * TILE : (t + 1) * TILE].tobytes(), len(m))
        made = list(rows.values())
        name = [mix(mix(pair[:, 0]) + pair[:, 1]).view(np.int64), np.array([r[0] for r in made], np.int64)]
        one = [np.zeros(len(pair), np.int64), np.array([r[1] for r in made], np.int64)]
        many = [np.ones(len(pair), np.int64), np.array([r[2] for r in made], np.int64)]
        size = [np.full(len(pair), 2), np.array([r[4] for r in made], np.int64)]
        members = [x.tobytes() for x in pair] + [r[3] for r in made]
        return pa.table({"name": np.concatenate(name), "tile": np.concatenate(one), "tiles": np.concatenate(many), "size": np.concatenate(size), "members": pa.array(members, pa.binary())})

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.array([len(x) // 8 for x in batch.column("members").to_pylist()], np.int64)
            owner = pa.array(np.repeat(np.arange(len(n)), n))
            classes = np.frombuffer(b"".join(batch.column("members").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("task").take(owner), batch.column("side").take(owner), pa.array(classes)], ["task", "side", "class"])

    tiles = stored(packed.groupBy("shard").applyInArrow(run, "name long, tile long, tiles long, size long, members binary").dropDuplicates(["name", "tile"]), "tiles")
    small = tiles.where(f"size <= {HOT} and tiles = 1").select(F.col("name").alias("task"), F.lit(0).cast("byte").alias("side"), "members")
    out = small.mapInArrow(unfold, "task long, side byte, class long")
    hot = tiles.where(f"size > {HOT} or tiles > 1")
    if hot.isEmpty():
        return out
    n_parts = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = hot.select(F.col("name").alias("task"), F.lit(0).cast("byte").alias("side"), "members").mapInArrow(unfold, "task long, side byte, class long")
    ends = stored(members.join(members.groupBy("task").agg(F.min("class").alias("least")), "task").select("task", "least", "class"), "hot")
    family = stored(components(ends, "least", "class"), "families")
    blocks_ = ends.groupBy("task").agg(F.count("*").cast("double").alias("size"), F.first("least").alias("node")).join(family, "node")
    classes = family.groupBy("label").agg(F.count("*").alias("classes"))
    whole = blocks_.groupBy("label").agg(F.sum(F.col("size") * F.col("size")).alias("cost")).join(classes, "label")
    whole = stored(whole.where("cast(classes as double) * classes <= cost").select("label", "classes"), "whole")
    once = family.join(whole, "label").select(F.col("label").alias("name"), F.col("node").alias("class"), F.ceil(F.col("classes") / TILE).alias("tiles"))
    loose = blocks_.join(whole, "label", "left_anti").select("task", F.ceil(F.col("size") / TILE).alias("tiles"))
    rest = ends.join(loose, "task").select(F.col("task").alias("name"), "class", "tiles")
    rows = once.unionByName(rest).repartition(n_parts, "name", "class").withColumn("tile", F.pmod(F.xxhash64("class", F.lit(3)), "tiles"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    side = F.when(F.col("tile") <= F.col("other"), 0).otherwise(1).cast("byte").alias("side")
    return out.unionByName(rows.select(F.xxhash64("name", F.least("tile", "other"), F.greatest("tile", "other")).alias("task"), side, "class"))


def _by_task(rows: DataFrame, fn, columns: list[str], schema: str) -> DataFrame:
    """``fn`` over the rows of each task, one task after another within a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        out: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t = batch.column("task").to_numpy(False)
            for a, b in zip(edges := [0, *(np.flatnonzero(t[1:] != t[:-1]) + 1).tolist()], [*edges[1:], len(t)]):
                if held and t[a] != last:
                    out += fn(last, pa.Table.from_batches(held))
                    held = []
                    if len(out) > 10_000:
                        yield batch_of(out)
                        out = []
                held.append(batch.slice(a, b - a))
                last = t[a]
        if held:
            out += fn(last, pa.Table.from_batches(held))
        if out:
            yield batch_of(out)

    names = [x.split()[0] for x in schema.split(", ")]

    def batch_of(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    return rows.repartition("task").sortWithinPartitions("task").select(*columns).mapInArrow(run, schema)


def _near(tasks: DataFrame, described: DataFrame, threshold: int) -> DataFrame:
    """(a, b, task) of the pairs of each task whose sketches are near enough; a < b."""

    def fn(task: int, t: pa.Table) -> list[tuple]:
        cls, side, n = (t.column(c).to_numpy() for c in ("class", "side", "n"))
        raw = [np.frombuffer(x, np.uint8) for x in t.column("sketch").to_pylist()]
        lens = np.array([len(x) for x in raw])
        cross = bool(side.any())
        out = []
        # similar sets have sketches of one length, or of two that are next to each other: then the longer one is folded
        for width in np.unique(lens):
            at = np.flatnonzero((lens == width) | (lens == 2 * width))
            if cross:
                left, right = np.flatnonzero(side[at] == 0), np.flatnonzero(side[at] == 1)
                p, q = np.repeat(left, len(right)), np.tile(right, len(left))
            else:
                p, q = np.triu_indices(len(at), 1)
            i, j = at[p], at[q]
            fits = (np.minimum(lens[i], lens[j]) == width) & (cls[j] != cls[i]) & (np.minimum(n[j], n[i]) * 100 >= np.maximum(n[j], n[i]) * threshold)
            p, q, i, j = p[fits], q[fits], i[fits], j[fits]
            if not len(p):
                continue
            bits = np.stack([raw[x] if lens[x] == width else fold(raw[x], width) for x in at]).view(np.uint64)
            step = max(1, COMPARED // int(width))
            far = np.concatenate([np.bitwise_count(bits[p[k : k + step]] ^ bits[q[k : k + step]]).sum(1, dtype=np.int64) for k in range(0, len(p), step)])
            near = far <= differing(n[i] + n[j], threshold)
            a, b = cls[i[near]], cls[j[near]]
            out += zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), [task] * len(a))
        return out

    rows = tasks.join(described.select("class", "n", "sketch"), "class")
    return _by_task(rows, fn, ["task", "side", "class", "n", "sketch"], "a long, b long, task long")


def _whole_sets(df: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """(class, values) of the sets of ``wanted`` classes. A bitmap of bounded size keeps others from the shuffle."""
    bitmap = df.sparkSession.sparkContext.broadcast(key_filter(wanted, "class"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                values, first = _sets(part, column)
                ids = set_ids(values, first)
                by = np.argsort(ids, kind="stable")
                one = by[distinct(ids[by])]
                one = one[(ids[one] != 0) & passes(bitmap.value, ids[one].view(np.int64))]
                if len(one):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[one].view(np.int64)), pa.array([values[first[i] : first[i + 1]].tobytes() for i in one], pa.binary())], ["class", "values"])

    return df.select(column).mapInArrow(run, "class long, values binary").join(wanted, "class", "left_semi").groupBy("class").agg(F.first("values").alias("values"))


def _verified(near: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(a, b) of the pairs whose sets are similar."""
    pairs = near.groupBy("a", "b").agg(F.min("task").alias("task"))
    members = pairs.select("task", F.explode(F.array("a", "b")).alias("class")).distinct()
    rows = members.join(sets, "class").select("task", F.col("class").alias("a"), F.lit(None).cast("long").alias("b"), "values")
    rows = rows.unionByName(pairs.select("task", "a", "b", F.lit(None).cast("binary").alias("values")))

    def fn(task: int, t: pa.Table) -> list[tuple]:
        a, b, values = (t.column(c).to_pylist() for c in ("a", "b", "values"))
        have = {x: np.frombuffer(v, np.uint64) for x, v in zip(a, values) if v is not None}
        out = []
        for x, y in zip(a, b):
            if y is not None:
                p, q = have[x], have[y]
                both = np.sort(np.concatenate([p, q]))
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= threshold * (len(p) + len(q) - common):
                    out.append((x, y))
        return out

    return _by_task(rows, fn, ["task", "a", "b", "values"], "a long, b long")


def similar(df: DataFrame, column: str = "text", key: str = "doc_id", threshold: int = THRESHOLD) -> DataFrame:
    """(key, class, component, n_shingles, n_similar, component_id) of each row; component is a class of it.

    Links are between all rows whose sets' Jaccard is at least ``threshold`` percent; equal sets are linked with each other. A row
    without text or words has no shingle, links nothing and is its own component. Repeated rows count as documents each. A null key is no smallest key:
    component_id is null where a component has no other. Every
    stage holds at most one task's classes; a set that a third of all rows have is one class after a partial aggregation.
    """
    each = stored(describe(df, column, key), "sets")
    classes = stored(each.where("n > 0").groupBy("class", "n").agg(F.count("*").alias("copies"), F.min(key).alias("least"), F.first("sketch").alias("sketch")), "classes")
    tasks = _tasks(_packed_keys(df, column, shards(df, 8_000_000), threshold))
    near = stored(_near(tasks, classes, threshold), "near")
    wanted = stored(near.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "wanted")
    links = stored(_verified(near, _whole_sets(df, wanted, column), threshold), "links")
    small = classes.select("class", "copies", "least")
    ends = links.union(links.select("b", "a"))
    more = ends.join(small.select(F.col("class").alias("b"), "copies"), "b").groupBy(F.col("a").alias("class")).agg(F.sum("copies").alias("others"))
    labels = components(links).select(F.col("node").alias("class"), "label")
    known = small.join(more, "class", "left").join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    least = known.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("least").alias("component_id"))
    linked = known.where("copies > 1 or others is not null").join(least, "label").select("class", "label", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_similar"), "component_id")
    return each.join(linked, "class", "left").select(key, F.col("class"), F.coalesce("label", "class").alias("component"), F.col("n").alias("n_shingles"), F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"), F.coalesce("component_id", key).alias("component_id"))


def keep_one(df: DataFrame, column: str = "text", key: str = "doc_id", threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``df`` with one document, that of the smallest key, of each component; all columns as they are.

    Only rows that may have to go (a bitmap of bounded size tells) are shuffled, the others are kept where they are read. A key whose
    row comes again with the same text keeps one of them; rows without words all stay. A row without a key is a document of its own:
    it stays where no row with a key is in its component, and then only one of those that are there, whichever is met first.
    """
    found = stored(similar(df, column, key, threshold), "similar").where("n_shingles > 0")
    mark, label = free_name(df, "gone"), free_name(df, "label")
    gone = found.where(f"`{key}` <> component_id").select(key, F.lit(True).alias(mark))
    again = found.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key, F.lit(False).alias(mark))
    special = stored(gone.union(again).groupBy(key).agg(F.max(mark).alias(mark)), "special")
    bitmap = df.sparkSession.sparkContext.broadcast(key_filter(special, key))

    def part_of(hit: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(key)
                ok = passes(bitmap.value, ids.fill_null(0).to_numpy(False)) & ids.is_valid().to_numpy(False)
                yield batch.filter(pa.array(ok if hit else ~ok & ids.is_valid().to_numpy(False)))

        return run

    clear = df.mapInArrow(part_of(False), df.schema)
    doubtful = df.mapInArrow(part_of(True), df.schema).join(special, key, "left")
    kept = doubtful.where(F.col(mark).isNull()).select(*df.columns)
    one = doubtful.where(~F.col(mark)).dropDuplicates([key, column]).select(*df.columns)
    return clear.unionByName(kept).unionByName(one).unionByName(_without_key(df, found, column, key, label))


def _without_key(df: DataFrame, found: DataFrame, column: str, key: str, label: str) -> DataFrame:
    """Rows whose key is null: those without words, and one of each class that no other row is in or linked with."""
    labels = found.where(F.col(key).isNull()).select(F.col("class").alias(label), "component_id", "component").distinct()
    labels = labels.where("component_id is null").groupBy("component").agg(F.min(label).alias(label)).select(label)  # one class a component
    schema = T.StructType([*df.schema.fields, T.StructField(label, T.LongType())])

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                yield part.append_column(label, pa.array(set_ids(*_sets(part, column)).view(np.int64)))

    rows = df.where(F.col(key).isNull()).mapInArrow(classed, schema)
    some = rows.where(F.col(label) != 0).join(labels, label, "left_semi").dropDuplicates([label])
    return rows.where(F.col(label) == 0).select(*df.columns).unionByName(some.select(*df.columns))


def op3_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("class", "component")


SQL_OP3 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')]
    ELSE list_distinct([array_to_string(t[i : i + 4], ' ') FOR i IN range(1, len(t) - 3)]) END AS g FROM w
), n AS (SELECT doc_id, len(g)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
df AS (SELECT g, count(*) AS c FROM e GROUP BY g),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i
  FROM (SELECT e.* FROM e JOIN df USING (g) WHERE c > 1) x JOIN (SELECT e.* FROM e JOIN df USING (g) WHERE c > 1) y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 90 * (p.n + q.n - i)
), reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.b FROM r JOIN links l ON r.b = l.a) SELECT a, min(b) AS component_id FROM r GROUP BY a
)
SELECT n.doc_id, n.n AS n_shingles, coalesce(k.c, 0)::BIGINT AS n_similar, reach.component_id
FROM n JOIN reach ON reach.a = n.doc_id LEFT JOIN (SELECT a, count(*) AS c FROM links GROUP BY a) k ON k.a = n.doc_id
"""
