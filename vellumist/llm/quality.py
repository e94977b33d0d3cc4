"""2. Quality rules: base counts, and the perplexity of a modified Kneser-Ney n-gram model with bands for each language.

The model is over runs of ORDER bytes as they are, of any script and case, counted by Spark over all distinct texts: however many copies
a text has, it counts once in the model and once in its language's band. Discounts, context weights and the lower orders' continuation
counts are aggregations and joins of the counted runs, so the model has no bound in size; it is stored as sorted arrays of 64-bit hashes
with their probabilities, cut by hash range. A block of documents asks each range for its distinct runs, found by binary search, and gets
float32 logarithms back: no worker or driver ever holds the whole model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .counts import Answers, block_reader, folders, packed_keys, ranked, shard_edges, unpacked_keys, write_by_block
from .shared import blocks, fresh, remove, scan, shards, stored, stored_at
from .text import Words, buffers, distinct, hash_pieces, mix, slices, trim

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
LOWER_SPREADS, UPPER_SPREADS = 6.5, 8.0  # of the distance between median and quartile
LEAST_SPREAD = 0.03  # log10 a word: the quartile distance counts as so much at least
SHARED_TEXTS = 20  # texts of all languages together that each language's band is formed with, besides its own
STEADY_WORDS = 400  # from so many words on, longer texts vary no less
BIN = 200  # histogram bins for each unit of log10 perplexity

ORDER = 5  # bytes of a run
BLOCK_BYTES = 4_000_000
HELD = 4_000_000  # runs that a task holds before it sends its counts on


def ngrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The run of ORDER bytes that ends at each byte, as a number; before a text there are spaces."""
    pad = ORDER - 1
    n = len(offsets) - 1
    at = np.arange(len(data)) + np.repeat(pad * np.arange(1, n + 1), np.diff(offsets))
    s = np.full(len(data) + pad * n, 32, np.uint64)
    s[at] = data
    k = s.copy()
    for back in range(1, ORDER):
        k[back:] |= s[:-back] << np.uint64(8 * back)
    return k[at]


def text_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each whole text."""
    return hash_pieces(np.concatenate([data, np.zeros(16, np.uint8)]), offsets[:-1], np.diff(offsets))


def _count_and_ask(docs: DataFrame, column: str, n_shards: int) -> DataFrame:
    """One pass with two kinds of rows: a task's counted runs (shard -1), and each block's distinct runs by shard, as hashes.

    Of a text's copies, each block counts one, as the share of all copies that the block holds; the shares add up to one text. How
    many copies there are comes from ``Answers``, where a block sends each of its texts' hashes once.
    """

    def of_block(rows: pa.Table):
        keys, at = ranked(text_hashes(*buffers(rows.column(column))))
        return keys, np.bincount(at, minlength=len(keys)), np.zeros(len(keys), np.uint8)

    read = Answers(docs, of_block, column, block_bytes=BLOCK_BYTES).reader()
    names = ["shard", "block", "keys", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0)

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([0]), pa.array([packed_keys(keys)], pa.binary()), pa.array([counts.tobytes()], pa.binary())], names)

        for block, rows in blocks(batches, column, BLOCK_BYTES):
            texts, at = ranked(text_hashes(*buffers(rows.column(column))))
            copies = read(block)
            if len(copies) != len(texts):
                raise RuntimeError("a block changed between two passes")
            own, one = np.bincount(at, minlength=len(texts)), np.empty(len(texts), np.int64)
            one[at[::-1]] = np.arange(len(at))[::-1]  # the first copy in the block
            share = own / copies
            asked: list[np.ndarray] = []
            done = 0
            for part in slices(rows.take(pa.array(one)), column, 1_000_000):
                data, offsets = buffers(part.column(column))
                k = ngrams(data, offsets)
                order = np.argsort(k)
                each = np.repeat(share[done : done + part.num_rows], np.diff(offsets))[order]
                done += part.num_rows
                k = k[order]
                heads = distinct(k)
                n = np.add.reduceat(each, heads) if len(heads) else np.zeros(0)
                asked.append(k[heads])
                keys, counts = np.concatenate([keys, k[heads]]), np.concatenate([counts, n])
                order = np.argsort(keys, kind="stable")
                keys, counts = keys[order], counts[order]
                heads = distinct(keys)
                if len(heads):
                    keys, counts = keys[heads], np.add.reduceat(counts, heads)
            if len(keys) > HELD:
                yield counted()
                keys, counts = keys[:0], counts[:0]
            h = np.sort(mix(np.unique(np.concatenate(asked)))) if asked else np.zeros(0, np.uint64)
            edges = shard_edges(h, n_shards)
            some = np.flatnonzero(np.diff(edges))
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), block)), pa.array([packed_keys(h[edges[i] : edges[i + 1]]) for i in some], pa.binary()), pa.array([None] * len(some), pa.binary())], names)
        if len(keys):
            yield counted()

    return docs.mapInArrow(run, "shard long, block long, keys binary, counts binary")


def _unfolded(rows: DataFrame) -> DataFrame:
    """(gram, n): the counts of all tasks added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                k, n = unpacked_keys(keys).view(np.int64), np.frombuffer(counts)
                for a in range(0, len(k), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(k[a : a + 100_000]), pa.array(n[a : a + 100_000])], ["gram", "n"])

    rows = rows.where("shard = -1").select("keys", "counts").mapInArrow(run, "gram long, n double")
    return rows.groupBy("gram").agg(F.round(F.sum("n")).cast("long").alias("n"))


def discounts(counts: dict[int, int]) -> list[float]:
    """What is taken off counts 1, 2 and 3 or more, from how many runs have the counts 1 to 4; fixed shares where those are zero."""
    n = [0, *(counts.get(k, 0) for k in range(1, 5))]
    if not n[1] or not n[2]:
        return [0.5, 0.75, 0.9]
    y = n[1] / (n[1] + 2 * n[2])
    d = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else k * 0.5 for k in range(1, 4)]
    return [min(max(x, 0.1), k * 0.95) for k, x in zip(range(1, 4), d)]


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, p): the interpolated modified Kneser-Ney probability of each counted run's last byte after the bytes before it."""
    return _kneser_ney_at(counts, order)[0]


def _kneser_ney_at(counts: DataFrame, order: int) -> tuple[DataFrame, str]:
    """:func:`kneser_ney`, and where its table lies. Those below it are removed once they aren't read any more."""
    spark = counts.sparkSession
    levels = [stored_at(counts, "runs")]
    for k in range(order - 1, 0, -1):
        short = levels[-1][0].groupBy(F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1)).alias("gram"))
        levels.append(stored_at(short.agg(F.count("*").alias("n")), "runs"))
    below = None
    for k, (t, path) in enumerate(reversed(levels)):
        d = discounts({r[0]: r[1] for r in t.where("n < 5").groupBy("n").count().collect()})  # four rows
        t = t.withColumn("ctx", F.shiftright("gram", 8)).withColumn("d", F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2]))
        of = t.groupBy("ctx").agg(F.sum("n").alias("total"), F.sum("d").alias("left"))
        t = t.join(of, "ctx")
        if below is None:
            under = F.lit(1 / 256)
        else:
            t = t.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1))).join(below[0].select(F.col("gram").alias("suffix"), F.col("p").alias("under")), "suffix")
            under = F.col("under")
        above = stored_at(t.select("gram", ((F.col("n") - F.col("d") + F.col("left") * under) / F.col("total")).alias("p")), "probabilities")
        for read in [path, *([below[1]] if below else [])]:
            remove(spark, read)
        below = above
    return below


class Model:
    """The model's answers to each block of ``docs`` in the shared folder; its sorted hash arrays lie there until all are given."""

    def __init__(self, docs: DataFrame, column: str):
        spark = docs.sparkSession
        n_shards = shards(docs)
        rows, rows_at = stored_at(_count_and_ask(docs, column, n_shards), "ngrams")
        probabilities, probabilities_at = _kneser_ney_at(_unfolded(rows), ORDER)
        arrays, arrays_at = stored_at(self._packed(probabilities, n_shards), "model")
        remove(spark, probabilities_at)
        asked = rows.where("shard >= 0").select("shard", "block", "keys")
        self.path, self.parts = fresh(spark, "answers"), folders(docs)
        answers = arrays.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(look_up, "block long, a long, data binary")
        write_by_block(answers.withColumn("part", F.pmod("block", F.lit(self.parts))), self.path, self.parts)
        for path in (rows_at, arrays_at):  # all that is read from here on are the answers
            remove(spark, path)

    @staticmethod
    def _packed(probabilities: DataFrame, n_shards: int) -> DataFrame:
        """(shard, hashes, logs): a row of sorted hashes and float32 logarithms for each hash range."""

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = mix(batch.column("gram").to_numpy(False).view(np.uint64))
                bounds = (np.arange(1, n_shards, dtype=np.float64) * (2.0**64 / n_shards)).astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, h, "right")), pa.array(h.view(np.int64)), batch.column("p")], ["shard", "h", "p"])

        def pack(t: pa.Table) -> pa.Table:
            h = t.column("h").to_numpy().view(np.uint64)
            by = np.argsort(h)
            logs = np.log10(np.maximum(t.column("p").to_numpy()[by], 1e-30)).astype(np.float32)
            return pa.table({"shard": t.column("shard")[:1], "hashes": pa.array([h[by].tobytes()], pa.binary()), "logs": pa.array([logs.tobytes()], pa.binary())})

        rows = probabilities.select("gram", "p").mapInArrow(hashed, "shard long, h long, p double").repartition(n_shards, "shard")
        return rows.groupBy("shard").applyInArrow(pack, "shard long, hashes binary, logs binary")

    def reader(self) -> Callable[[int], np.ndarray]:
        """For workers: block -> log10 probabilities of its distinct runs, in order of their hashes."""
        read = block_reader(self.path, self.parts)
        return lambda block: np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(x, np.float32) for x in read(block))])


def look_up(arrays: pa.Table, asked: pa.Table) -> pa.Table:
    """A shard's answers: each block's hashes by binary search in the shard's sorted array."""
    block, shard, out = [], [], []
    if asked.num_rows:
        hashes, logs = (np.frombuffer(arrays.column(c)[0].as_py(), k) for c, k in (("hashes", np.uint64), ("logs", np.float32)))
        for s, b, keys in zip(*(asked.column(c).to_pylist() for c in ("shard", "block", "keys"))):
            h = unpacked_keys(keys)
            at = np.searchsorted(hashes, h)
            if not np.array_equal(hashes[np.minimum(at, len(hashes) - 1)], h):
                raise RuntimeError("a block changed between two passes")
            block.append(b)
            shard.append(s)
            out.append(logs[at].tobytes())
    return pa.table({"block": pa.array(block, pa.int64()), "a": pa.array(shard, pa.int64()), "data": pa.array(out, pa.binary())})


_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in "#*$%&|<>"]] = True


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, run length of each value in that order) for values within their own texts."""
    keyed = mix(values ^ mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keyed)
    heads = distinct(keyed[order])
    size = np.diff(np.append(heads, len(keyed)))
    return order, np.repeat(size, size)


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    n = len(offsets) - 1
    w = Words(data, offsets)
    n_words = np.diff(w.first)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    word_chars = _per_text((data & 0xC0) != 0x80, offsets) - _per_text(blank, offsets)
    # lines
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    text_of = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, "right") - 1])
    text_of = text_of[np.argsort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")]
    ends = np.append(breaks, offsets[1:])
    ends.sort()
    some = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends, text_of = starts[some], ends[some], text_of[some]
    h = hash_pieces(w.data, starts, ends - starts)
    keyed = np.sort(mix(h ^ mix(text_of.astype(np.uint64) + np.uint64(1))))
    n_dup = np.zeros(n, np.int64)
    if len(keyed) != len(distinct(keyed)):
        order, size = _repeats(h, text_of)
        extra = np.ones(len(order), bool)
        k2 = mix(h ^ mix(text_of.astype(np.uint64) + np.uint64(1)))[order]
        extra[distinct(k2)] = False
        n_dup = np.bincount(text_of[order][extra], minlength=n)
    # words in windows of three that come again
    hw = w.hashes()
    n_repeat = np.zeros(n, np.int64)
    if len(hw) > 2:
        owner = np.repeat(np.arange(n), n_words)
        whole = np.flatnonzero(owner[2:] == owner[:-2])
        three = mix(mix(mix(hw[whole]) ^ hw[whole + 1]) ^ hw[whole + 2])
        order, size = _repeats(three, owner[whole])
        again = whole[order[size > 1]]
        covered = np.zeros(len(hw), bool)
        for d in range(3):
            covered[again + d] = True
        n_repeat = np.bincount(owner[covered], minlength=n)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": _per_text(_SIGN[data], offsets), "n_dup_lines": n_dup, "n_repeat_words": n_repeat}


def real_words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words of each text that have a letter, a digit or a byte of another script; marks by themselves are none."""
    w = Words(data, offsets)
    total = np.concatenate(([0], np.cumsum(_ALNUM[data], dtype=np.int64)))
    real = np.concatenate(([0], np.cumsum(total[w.starts + w.lens] > total[w.starts])))
    return real[w.first[1:]] - real[w.first[:-1]]


_ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def _sums(rows: pa.Table, column: str, answers: np.ndarray) -> np.ndarray:
    """The sum of each text's logarithms from the block's answers; of 1 MB of text at a time, the runs' places are all that is held."""
    parts = []
    for batch in rows.select([column]).combine_chunks().to_batches():
        for part in slices(batch, column, 1_000_000):
            data, offsets = buffers(part.column(column))
            parts.append((offsets, *ranked(ngrams(data, offsets))))
    keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *(k for _, k, _ in parts)]))
    if len(answers) != len(keys):
        raise RuntimeError("a block changed between two passes")
    logs = np.empty(len(keys), np.float32)
    logs[np.argsort(mix(keys))] = answers
    out = [np.zeros(0)]
    for offsets, k, at in parts:
        total, some = np.zeros(len(offsets) - 1), np.flatnonzero(np.diff(offsets))
        if len(some):  # a text's sum is the same wherever it lies
            total[some] = np.add.reduceat(logs[np.searchsorted(keys, k)][at].astype(np.float64), offsets[some])
        out.append(total)
    return np.concatenate(out)


def _scored(docs: DataFrame, model: Model, column: str, fn: Callable, schema) -> DataFrame:
    """``fn`` over parts of each block: (rows, counts, log10 perplexity a word, null without one) -> rows. No shuffle."""
    read = model.reader()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in blocks(batches, column, BLOCK_BYTES):
            total = _sums(rows, column, read(block))
            data, offsets = buffers(rows.column(column))
            counts = base_counts(data, offsets)
            real = real_words(data, offsets)
            score = np.where(real > 0, -total / np.maximum(real, 1), np.nan)
            counts["text"] = text_hashes(data, offsets).view(np.int64)
            counts["failed"] = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
            yield from fn(rows, counts, score)
            trim()

    return docs.mapInArrow(run, schema)


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def score_quality(docs: DataFrame, model: Model, column: str, key: str, lang: str) -> DataFrame:
    """Base counts and log10 perplexity a word (null without words) of each whole text, and its hash, of a :func:`scan`."""

    def out(rows: pa.Table, counts: dict[str, np.ndarray], score: np.ndarray) -> Iterator[pa.RecordBatch]:
        columns = [rows.column(key).cast(pa.int64()), rows.column(lang).cast(pa.string()), *(pa.array(counts[k].astype(np.int64)) for k in _COUNTS), pa.array(counts["failed"]), pa.array(score, from_pandas=True), pa.array(counts["text"])]
        yield from pa.table(columns, [key, lang, *_COUNTS, "base_failed", "log_perplexity", "_text"]).combine_chunks().to_batches()

    return _scored(docs, model, column, out, f"{key} long, {lang} string, " + "".join(f"{k} long, " for k in _COUNTS) + "base_failed boolean, log_perplexity double, _text long")


def bands(scored: DataFrame, lang: str = "lang") -> list[tuple[str, float, float, float]]:
    """(language, median, lower, upper) of log10 perplexity over the distinct texts that pass the base rules.

    Each language's band is formed of its own texts and SHARED_TEXTS texts' weight of all languages together, so that one with few texts
    has the band of all, and its own more and more as it grows. A text's distance from its language's median is weighed by the root of its length, as short texts vary more; the bands reach a
    number of quartile distances of that. Quartiles come from exact counts in bins of 1 / BIN and a few length classes, so the
    driver gets a bounded histogram for each language. Copies are dropped by hash within each task before they are shuffled.
    """
    rows = (
        scored.where(~F.col("base_failed") & F.col("log_perplexity").isNotNull())
        .select(F.coalesce(lang, F.lit("")).alias("lang"), F.floor(F.col("log_perplexity") * BIN).alias("bin"), F.floor(F.log2(F.least("n_words", F.lit(STEADY_WORDS))) * 4).alias("size"), "_text")
        .distinct()
        .groupBy("lang", "bin", "size")
        .count()
        .collect()
    )
    by: dict[str, dict[tuple[int, int], float]] = {}
    every: dict[tuple[int, int], float] = {}
    total = sum(r["count"] for r in rows)
    for r in rows:
        at = (r["bin"], r["size"])
        by.setdefault(r["lang"], {})[at] = r["count"]
        every[at] = every.get(at, 0) + r["count"] * SHARED_TEXTS / total
    out = []
    for name, own in sorted(by.items()):
        bins = [((b + 0.5) / BIN, 2 ** (size / 8 + 1 / 16) / 10, own.get((b, size), 0) + n) for (b, size), n in every.items()]
        value, weight, n = (np.array(x) for x in zip(*bins))
        median = _quantile(value, n, 0.5)
        off = (value - median) * weight
        low, high = (max(LEAST_SPREAD, abs(_quantile(off, n, q))) for q in (0.25, 0.75))
        out.append((name, median, -LOWER_SPREADS * low, UPPER_SPREADS * high))
    return out


def _quantile(value: np.ndarray, n: np.ndarray, q: float) -> float:
    by = np.argsort(value, kind="stable")
    total = np.cumsum(n[by])
    return float(value[by][np.searchsorted(total, q * total[-1])])


def quality_rules(df: DataFrame, column: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """Counts, perplexity and verdict of each document.

    A null or empty text fails the base rules. Documents without a language are a language of their own. A text of marks alone has no
    perplexity and is rejected; one whose perplexity lies on a band's edge is kept. Texts of any length are scored whole, a very long one
    in a block of its own. Repeated rows are judged each; an empty table gives no rows; other columns are not looked at.
    """
    docs = scan(df.select(F.col(key).cast("long").alias(key), F.col(lang).cast("string").alias(lang), column), [key, lang, column])
    scored = stored(score_quality(docs, Model(docs, column), column, key, lang), "quality")
    limits = df.sparkSession.createDataFrame(bands(scored, lang), "band_lang string, median double, lower double, upper double")
    reach = F.sqrt(F.greatest(F.lit(1), F.least("n_words", F.lit(STEADY_WORDS))) / 100)
    scored = scored.withColumn("_reach", reach)
    return (
        scored.join(limits, F.coalesce(lang, F.lit("")) == F.col("band_lang"), "left")
        .withColumn("lower_band", F.col("median") + F.col("lower") / F.col("_reach"))
        .withColumn("upper_band", F.col("median") + F.col("upper") / F.col("_reach"))
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("log_perplexity").between(F.col("lower_band"), F.col("upper_band")), F.lit(False)))
        .drop("band_lang", "median", "lower", "upper", "_reach", "_text", lang)
    )


def keep_good(df: DataFrame, column: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """The rows of ``df`` that quality_rules keeps, all columns as they are. Texts are scored twice, never shuffled."""
    inner = dict(zip(df.columns, (f"c{i}" for i in range(len(df.columns)))))  # no name of df's can clash with those that blocks need
    docs = scan(df.toDF(*inner.values()), list(inner.values()))
    column, key, lang = inner[column], inner[key], inner[lang]
    model = Model(docs, column)
    limits = {name: rest for name, *rest in bands(stored(score_quality(docs, model, column, key, lang), "quality"), lang)}

    def good(rows: pa.Table, counts: dict[str, np.ndarray], score: np.ndarray) -> Iterator[pa.RecordBatch]:
        median, low, high = (np.array([limits.get(x or "", (0, np.inf, -np.inf))[k] for x in rows.column(lang).to_pylist()]) for k in (0, 1, 2))
        reach = np.sqrt(np.maximum(1, np.minimum(counts["n_words"], STEADY_WORDS)) / 100)
        kept = ~counts["failed"] & (score >= median + low / reach) & (score <= median + high / reach)
        yield from rows.drop_columns(["_file", "_start"]).rename_columns(list(inner)).filter(pa.array(kept)).to_batches()

    return _scored(docs, model, column, good, df.schema)


def op2_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
