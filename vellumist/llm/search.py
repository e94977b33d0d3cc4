"""1. Exact top-k search: BM25 over an inverted index in shards, with block-max WAND dynamic pruning.

A shard indexes a block of documents by word hash; every 2**K_BLOCK documents of a posting list have their maximum kept. For a query,
the maxima of a block's lists add up to a bound for its documents. Blocks are taken in falling order of that bound, in rounds: the k-th
score so far is a threshold that rises from round to round, and the first block whose bound is below it ends the search, as its lists
and those of all blocks behind it are skipped. As in WAND, words whose greatest weights add up to less than the threshold can't lift a
document over it by themselves: within a block the others' postings are read first, and theirs only where a document's sum so far and
the block's maxima of what is left still reach the threshold. Only lists that every block has documents of (over one in DENSE) are not
skipped in, as there is nothing to skip: a matrix product gives their sums for many queries at once, and bounds begin from them.
Documents lie in the shard by their most frequent word, so that blocks are
alike within and bounds tight. Shards are searched in passes, first a few of them: what a query's k-th result of those has, any other
shard's documents must reach, which makes more words weak from the start (MaxScore). Document frequencies and lengths are global and exact, so shards' results merge exactly.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .counts import Answers, ranked
from .memo import places
from .shared import blocks, filesystem, fresh, scan, stored
from .text import Words, buffers, distinct, slices

K1, B, TOP = 1.2, 0.75, 10
FIRST, GROWTH = 8, 8  # blocks in a query's first round, and how many times more each further round takes
K_BLOCK = 5  # documents in a block of a posting list, as a power of two
DENSE = 10  # a list of more than one document in so many of the shard's is dense
TOGETHER = 64  # queries in one matrix product
QUERY_GROUP = 4096  # queries that a task runs against a shard at a time
LOOK_UP = 6  # postings added in the time of looking up one
PASSES, MANY_PASSES, MANY_SHARDS = (0, 4, 64), (0, 1, 8, 64), 256  # shards searched one lot after another, in 64ths; with so many shards the latter
EVERY = 100  # the query set: ids divisible by it
_N, _LENGTH = np.uint64(0x1111111122222222), np.uint64(0x3333333344444444)  # keys that the number and total length of documents are asked by
_SLACK = 1e-5  # bounds are compared with so much to spare, for rounding


def _reordered(n: np.ndarray, first: np.ndarray, at: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths and terms of documents in order of their most frequent term, and that order."""
    code = np.sort(np.repeat(np.arange(len(n)), n) * max(1, n_terms) + at)
    heads = distinct(code)
    tf = np.diff(np.append(heads, len(code)))
    doc, term = code[heads] // max(1, n_terms), code[heads] % max(1, n_terms)
    top = np.full(len(n), -1)
    by = np.lexsort((term, -tf, doc))
    lead = by[distinct(doc[by])]
    top[doc[lead]] = term[lead]
    order = np.lexsort((n, top))
    return n[order], at[places(first[:-1][order], n[order])], order


def postings(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, first, docs, tf, lengths, order): term i's documents are docs[first[i]:first[i + 1]], rising; document d is row order[d]."""
    data, offsets = buffers(column)
    w = Words(data, offsets, lower=True)
    n = np.diff(w.first)
    terms, at = ranked(w.hashes())
    n, at, order = _reordered(n, w.first, at, len(terms))
    code = np.sort(at.astype(np.int64) * max(1, len(n)) + np.repeat(np.arange(len(n)), n))
    heads = distinct(code)
    tf = np.diff(np.append(heads, len(code)))
    code = code[heads]
    term, doc = code // max(1, len(n)), code % max(1, len(n))
    return terms, np.searchsorted(term, np.arange(len(terms) + 1)), doc, tf, n, order


def _with_totals(terms: np.ndarray, counts: np.ndarray, n_docs: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = np.concatenate([terms, [_N, _LENGTH]]).astype(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.concatenate([counts, [n_docs, length]])[order], order


class Shard:
    """An index of some documents; ids may hold None."""

    def __init__(self, ids: list, terms, first, docs, tf, lengths, df, n_docs: int, total: int):
        self.ids, self.terms, self.first, self.docs = ids, terms, first, docs
        average = total / n_docs if total else 1.0
        idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
        self.impact = np.repeat(idf, np.diff(first)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[docs] / average))
        self.n_blocks, self.block_size = (len(ids) >> K_BLOCK) + 1, 1 << K_BLOCK
        n = np.diff(first)
        # lists that every block has documents of can't be skipped: they lie as rows of a matrix, a place for each document
        self.full = np.full(len(terms), -1)
        long = np.flatnonzero(n * DENSE > len(ids))
        self.full[long] = np.arange(len(long))
        self.dense = np.zeros((len(long), self.n_blocks * self.block_size))
        at = places(first[long], n[long])
        self.dense[np.repeat(np.arange(len(long)), n[long]), docs[at]] = self.impact[at]
        self.n = n
        block = docs >> K_BLOCK
        term = np.repeat(np.arange(len(terms)), n)
        new = np.ones(len(docs), bool)
        new[1:] = (block[1:] != block[:-1]) | (term[1:] != term[:-1])
        self.run = np.flatnonzero(new)
        self.run_size = np.diff(np.append(self.run, len(docs)))
        self.run_block = block[self.run]
        self.run_max = np.maximum.reduceat(self.impact, self.run) if len(self.run) else np.zeros(0)
        self.run_first = np.searchsorted(self.run, first)
        self.most = np.maximum.reduceat(self.run_max, self.run_first[:-1]) if len(self.run) else np.zeros(0)  # of each term
        self.code = term * (self.n_blocks * self.block_size) + docs  # rising: a posting is found by its term and document
        self.read = self.listed = 0  # postings read, and postings of the terms asked for

    def _add(self, scores: np.ndarray, runs: np.ndarray) -> None:
        """Adds the weights of the postings of ``runs`` to their documents' scores."""
        at = places(self.run[runs], self.run_size[runs])
        self.read += len(at)
        scores += np.bincount(self.docs[at], self.impact[at], len(scores))

    def known(self, terms: np.ndarray) -> np.ndarray:
        """Places of those terms that the shard has."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        return at[self.terms[at] == terms] if len(self.terms) else at[:0]

    def search_all(self, queries: list[np.ndarray], k: int, least: np.ndarray | None = None) -> Iterator[list[tuple[float, int]]]:
        """:meth:`search` for each query; what the dense lists give all documents is one matrix product for TOGETHER of them. ``least``
        has a score for each query that k documents are known to reach: others are of no use, and 0 where none are known."""
        for a in range(0, len(queries), TOGETHER):
            some = queries[a : a + TOGETHER]
            asked = np.zeros((len(some), len(self.dense)))
            for row, terms in zip(asked, some):
                lists = self.full[terms]
                row[lists[lists >= 0]] = 1
            known = least[a : a + TOGETHER] if least is not None else np.zeros(len(some))
            for terms, scores, low in zip(some, asked @ self.dense, known.tolist()):
                terms = terms[self.full[terms] < 0]
                yield self._above(terms, k, scores, low) if low > 0 else self.search(terms, k, scores)

    def _above(self, terms: np.ndarray, k: int, scores: np.ndarray, least: float) -> list[tuple[float, int]]:
        """:meth:`search` of the documents that reach ``least``, as in MaxScore: one needs a word that isn't weak, so those words'
        postings are read whole, and the weak ones' are looked up for documents that they can still lift, strongest first."""
        least -= _SLACK
        most = self.most[terms]
        by = np.argsort(most, kind="stable")
        reach = np.cumsum(most[by]) + scores.max(initial=0)
        n_weak = int(np.searchsorted(reach, least, "left"))
        self.listed += int(self.n[terms].sum())
        strong, weak = terms[by[n_weak:]], terms[by[:n_weak]][::-1]
        at = places(self.first[strong], self.n[strong])
        self.read += len(at)
        scores = scores + np.bincount(self.docs[at], self.impact[at], len(scores))
        left = np.append(np.cumsum(self.most[weak][::-1])[::-1], 0.0)  # the most that the weak words from each on give
        docs = np.flatnonzero(scores + left[0] >= least)
        total, place, many = scores[docs], 0, 8
        while place < len(weak) and len(docs):
            some = weak[place : place + many]
            n = int(self.n[some].sum())
            if n < LOOK_UP * len(some) * len(docs):  # fewer postings than it takes to look for each document in each list
                at = places(self.first[some], self.n[some])
                total = total + np.bincount(self.docs[at], self.impact[at], len(scores))[docs]
                self.read += n
            else:
                code = (some[:, None] * (self.n_blocks * self.block_size) + docs).ravel()
                at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
                hit = self.code[at] == code
                total = total + np.where(hit, self.impact[at], 0.0).reshape(len(some), -1).sum(0)
                self.read += int(hit.sum())
            place, many = place + len(some), 2 * many
            able = total + left[place] >= least
            docs, total = docs[able], total[able]
        if len(docs) > k:
            able = total >= np.partition(total, -k)[-k] - _SLACK
            docs, total = docs[able], total[able]
        able = (total >= least) & (total > 0)
        return self._best(docs[able], total[able], k)

    def _best(self, docs: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[float, int]]:
        ranking = sorted(zip((-np.round(scores, 6)).tolist(), docs.tolist()), key=lambda x: (x[0], self.ids[x[1]] is None, self.ids[x[1]] or 0, x[1]))
        return [(-s, d) for s, d in ranking[:k]]

    def search(self, terms: np.ndarray, k: int, scores: np.ndarray) -> list[tuple[float, int]]:
        """(score rounded to six places, document) of the best k of this shard. ``terms`` are places in self.terms of words whose lists
        aren't dense, rising; ``scores`` holds what the dense ones gave."""
        begin = self.run_first[terms]
        size = self.run_first[terms + 1] - begin
        runs = places(begin, size)
        self.listed += int(self.n[terms].sum())
        block, run_max = self.run_block[runs], self.run_max[runs]
        so_far = scores.reshape(-1, self.block_size).max(1)
        bound = so_far + np.bincount(block, run_max, self.n_blocks)
        order = np.argsort(-bound, kind="stable")
        falling = -bound[order]
        most = self.most[terms]
        by = np.argsort(most, kind="stable")
        reach = np.cumsum(most[by]) + so_far.max(initial=0)  # a document with no sparse words but a term and weaker ones has less
        in_round, done = np.zeros(self.n_blocks, bool), np.zeros(self.n_blocks, bool)
        best, threshold, at, many = np.zeros(0), 0.0, 0, FIRST
        while at < (end := int(np.searchsorted(falling, -max(threshold - _SLACK, 1e-300), "right"))):
            chosen = order[at : min(end, at + many)]
            in_round[:] = False
            in_round[chosen] = done[chosen] = True
            mine = np.flatnonzero(in_round[block])
            n_weak = int(np.searchsorted(reach, threshold - _SLACK, "left"))
            if n_weak:
                is_weak = np.zeros(len(terms), bool)
                is_weak[by[:n_weak]] = True
                is_weak = np.repeat(is_weak, size)[mine]
                mine, rest = mine[~is_weak], mine[is_weak]
                self._add(scores, runs[mine])
                left = np.bincount(block[rest], run_max[rest], self.n_blocks)[chosen]
                able = scores.reshape(-1, self.block_size)[chosen].max(1) + left >= threshold - _SLACK
                in_round[chosen[~able]] = False
                mine = rest[in_round[block[rest]]]
            self._add(scores, runs[mine])
            best = np.concatenate([best, scores.reshape(-1, self.block_size)[chosen].ravel()])
            best = best[best > 0]
            if len(best) >= k:
                best = np.partition(best, -k)[-k:]
                threshold = float(best.min())
            at, many = at + len(chosen), GROWTH * many
        scores.reshape(-1, self.block_size)[~done] = 0  # whose bounds are below the threshold
        docs = np.flatnonzero(scores >= max(threshold - _SLACK, 1e-300))
        return self._best(docs, scores[docs], k)


def _dump(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def build(docs: DataFrame, root: str) -> DataFrame:
    """Writes a shard file for each block of ``docs`` (_key, text of :func:`scan`); a row with its path for each."""

    def of_block(rows: pa.Table):
        terms, first, _, _, lengths, _ = postings(rows.column("text"))
        keys, counts, _ = _with_totals(terms, np.diff(first), len(lengths), int(lengths.sum()))
        return keys, counts, np.zeros(len(keys), np.uint8)

    read = Answers(docs, of_block).reader()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(root)
        fs.create_dir(base, recursive=True)
        for block, rows in blocks(batches, "text"):
            terms, first, docs_, tf, lengths, rank = postings(rows.column("text"))
            _, _, order = _with_totals(terms, np.diff(first), 0, 0)
            total = np.empty(len(order), np.int64)
            total[order] = read(block)
            ids = rows.column("_key").take(pa.array(rank)).to_pylist()
            path = f"{base}/{uuid.uuid4().hex}.npz"  # new in each attempt
            arrays = {"ids": np.array([0 if i is None else i for i in ids], np.int64), "real": np.array([i is not None for i in ids], bool), "terms": terms, "first": first.astype(np.int64), "docs": docs_.astype(np.uint32 if len(ids) > 65535 else np.uint16), "tf": tf.astype(np.uint32 if len(tf) and tf.max() > 65535 else np.uint16), "lengths": lengths.astype(np.int64), "df": total[:-2], "totals": total[-2:]}
            with fs.open_output_stream(path, compression=None) as f:
                f.write(_dump(arrays))
            yield pa.RecordBatch.from_pydict({"path": [path]}, pa.schema([("path", pa.string())]))

    path = f"{root}-shards"
    docs.mapInArrow(run, "path string").write.parquet(path)
    return docs.sparkSession.read.schema("path string").parquet(path)


def load(fs, path: str) -> Shard:
    with fs.open_input_file(path) as f:
        z = np.load(io.BytesIO(f.read()))
    ids = [int(i) if ok else None for i, ok in zip(z["ids"].tolist(), z["real"].tolist())]
    n, total = z["totals"].tolist()
    return Shard(ids, z["terms"], z["first"], z["docs"].astype(np.int64), z["tf"].astype(np.float64), z["lengths"], z["df"], n, total)


def pack_queries(queries: DataFrame, root: str, column: str, key: str) -> int:
    """Writes groups of about QUERY_GROUP queries, the distinct words of a whole text each, as a folder by number; how many there are."""
    n_groups = queries.count() // QUERY_GROUP + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                data, offsets = buffers(part.column(column))
                w = Words(data, offsets, lower=True)
                h = w.hashes()
                terms = []
                for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
                    t = np.sort(h[a:b])
                    terms.append(t[distinct(t)].tobytes())
                out = pa.RecordBatch.from_arrays([part.column("_group"), part.column("_query"), part.column(key), pa.array(terms, pa.binary())], ["_group", "_query", key, "terms"])
                yield out.filter(pa.array([len(t) > 0 for t in terms]))

    # few beside the documents; each gets a number, which tells repeated rows apart
    rows = queries.select(key, column).withColumn("_query", F.monotonically_increasing_id())
    rows = rows.withColumn("_group", F.pmod(F.xxhash64("_query"), F.lit(n_groups))).repartition(n_groups, "_group")
    rows.mapInArrow(run, f"_group long, _query long, {key} long, terms binary").write.partitionBy("_group").parquet(root)
    return n_groups


def search(df: DataFrame, queries: DataFrame, k: int = TOP, column: str = "text", key: str = "doc_id") -> DataFrame:
    """(query_id, rank, doc_id, score): for each row of ``queries`` the k best rows of ``df`` by BM25 over all words of its text.

    Words are runs of bytes other than white space, A-Z in lower case; a query counts each of its words once. Scores are rounded to six
    places; ties go to the smaller id, null ids last. Only rows that share a word are results, so a query without words has none.
    Repeated rows are results each, and a repeated query row is a query of its own under the same query_id.
    """
    spark = df.sparkSession
    root = fresh(spark, "index")
    docs = scan(df.select(F.col(key).cast("long").alias("_key"), F.col(column).alias("text")), ["_key", "text"])
    shards = build(docs, f"{root}/shards")
    n_groups = pack_queries(queries.select(F.col(key).cast("long").alias(key), column), f"{root}/queries", column, key)
    n = shards.count()
    bounds = MANY_PASSES if n >= MANY_SHARDS else PASSES
    lot = F.pmod(F.xxhash64("path"), F.lit(bounds[-1]))
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found: DataFrame | None = None
    for low, high in zip(bounds, bounds[1:]):
        some = shards.where(lot.between(low, high - 1))
        many = some.count()
        if not many:
            continue
        known = ""
        if found is not None:  # what the k-th of a query's results so far has is the least that any other shard's must reach
            known = f"{root}/known-{low}"
            found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("group", "q", "score").repartition("group").write.partitionBy("group").parquet(known)
        # the query set in groups against all rows; a task has one shard
        tasks = some.select("path", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("group"))
        tasks = tasks.repartitionByRange(many if many >= 64 else many * n_groups, "path", "group")
        more = tasks.mapInArrow(_searcher(root, known, k, key), "q long, group long, query_id long, doc_id long, score double")
        if high < bounds[-1]:
            more = stored(more, "found")
        found = more if found is None else found.unionByName(more)
    if found is None:
        found = spark.createDataFrame([], "q long, group long, query_id long, doc_id long, score double")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


def _searcher(root: str, known: str, k: int, key: str):
    """For workers: (path, group) -> the group's results in the shard; ``known`` is the folder of scores that must be reached, or none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds
        from pyarrow.fs import FileType

        fs, base = filesystem(f"{root}/queries")
        least_at = filesystem(known)[1] if known else ""
        shard, loaded = None, None

        def table(where: str, columns: list[str]) -> pa.Table | None:
            if fs.get_file_info(where).type == FileType.NotFound:
                return None
            return ds.dataset(where, filesystem=fs, format="parquet").to_table(columns=columns)

        for batch in batches:
            for path, group in zip(batch.column("path").to_pylist(), batch.column("group").to_pylist()):
                asked = table(f"{base}/_group={group}", ["_query", key, "terms"])
                if asked is None:
                    continue  # no query has this number
                if path != loaded:
                    shard, loaded = load(fs, path), path
                q, ids, terms = (c.to_pylist() for c in asked.columns)
                scores = table(f"{least_at}/group={group}", ["q", "score"]) if known else None
                reached = dict(zip(*(c.to_pylist() for c in scores.columns))) if scores is not None else {}
                least = np.array([reached.get(x, 0.0) for x in q])
                found = shard.search_all([shard.known(np.frombuffer(x, np.uint64)) for x in terms], k, least)
                out = [(a, group, b, shard.ids[d], s) for a, b, best in zip(q, ids, found) for s, d in best]
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["q", "group", "query_id", "doc_id", "score"])

    return run


def op1_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by EVERY, its whole text, against all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return search(docs, docs.where(F.col("doc_id") % EVERY == 0))


SQL_OP1 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents
), g AS (SELECT count(*) AS n, sum(len(t)) AS total FROM w),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM w) GROUP BY 1, 2),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (
  SELECT q.doc_id AS query_id, p.doc_id, round(sum(ln(1 + (g.n - f.df + 0.5) / (f.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * len(w.t) / (g.total / g.n)))), 6) AS score
  FROM p q JOIN p USING (term) JOIN f USING (term) JOIN w ON w.doc_id = p.doc_id, g
  WHERE q.doc_id % 100 = 0 GROUP BY 1, 2
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
