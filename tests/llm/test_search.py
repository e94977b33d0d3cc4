import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cases import TEXTS, empty, table
from vellumist.llm import search as S


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(texts, queries, k):
    w = [Counter(words(t)) for t in texts]
    n, total = len(w), sum(sum(c.values()) for c in w)
    df = Counter(t for c in w for t in c)
    out = {}
    for q in queries:
        s = []
        for d, c in enumerate(w):
            x = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * (S.K1 + 1) / (c[t] + S.K1 * (1 - S.B + S.B * sum(c.values()) / (total / n))) for t in w[q] if t in c)
            if x:
                s.append((-round(x, 6), d))
        out[q] = [(d, -x) for x, d in sorted(s)[:k]]
    return {q: r for q, r in out.items() if r}


@pytest.mark.parametrize("k", [1, 10])
def test_equals_brute_force(spark, k, tmp_path):
    r = random.Random(k)
    texts = [" ".join("w%d" % int(r.paretovariate(0.6)) for _ in range(r.randint(1, 80))) for _ in range(500)] + TEXTS
    texts[40] = texts[41] = texts[300]
    path = str(tmp_path / "d")
    table(spark, texts).repartition(3).write.parquet(path)
    df = spark.read.parquet(path)
    got = {}
    for x in S.search(df, df.where("doc_id % 7 = 0"), k).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.doc_id, x.score))
    want = brute(texts, range(0, len(texts), 7), k)
    assert set(got) == set(want)
    for q, rows in got.items():
        assert [d for _, d, _ in sorted(rows)] == [d for d, _ in want[q]], q
        assert all(math.isclose(s, w, abs_tol=2e-6) for (_, _, s), (_, w) in zip(sorted(rows), want[q]))


def shard_of(texts):
    terms, first, docs, tf, lengths, order = S.postings(pa.array(texts))
    return S.Shard(order.tolist(), terms, first, docs, tf.astype(float), lengths, np.diff(first), len(texts), int(lengths.sum()))


def ask(shard, text, k):
    h = S.Words(*S.buffers(pa.array([text])), lower=True).hashes()
    return [shard.ids[d] for _, d in next(shard.search_all([shard.known(np.unique(h))], k))]


def test_postings_are_skipped():
    r = random.Random(2)
    texts = ["common " + " ".join("x%d" % r.randint(0, 400) for _ in range(20)) for _ in range(4000)]
    for i in (5, 6, 7, 9):
        texts[i] = "rare special words here common"
    shard = shard_of(texts)
    assert ask(shard, "rare special words here common x1 x2 x3", 4) == [5, 6, 7, 9]
    assert shard.read < 0.25 * shard.listed


def test_every_long_query_skips_postings_and_is_exact():
    """Whole texts as queries, as the registered query has them."""
    r = random.Random(4)
    vocabulary = ["w%d" % i for i in range(3000)]
    texts = []
    for i in range(1500):  # common words of the language and words of one of 30 topics
        texts.append(" ".join(vocabulary[int(r.paretovariate(0.9)) % 100] if r.random() < 0.5 else vocabulary[100 * (i % 30) + r.randint(0, 99)] for _ in range(r.randint(50, 200))))
    shard, every = shard_of(texts), brute(texts, range(0, 1500, 50), 10)
    for q, want in every.items():
        shard.read = shard.listed = 0
        assert ask(shard, texts[q], 10) == [d for d, _ in want]
        assert 0 < shard.read < shard.listed


def test_empty_and_repeated(spark):
    e = empty(spark)
    assert S.search(e, e).collect() == [] and S.search(table(spark), e).collect() == []
    df = table(spark, ["a b", "b c", None, "a b"])
    df = df.union(df.where("doc_id = 0"))
    rows = S.search(df, df.where("doc_id = 0")).collect()
    assert len(rows) == 2 * 4 and {r.doc_id for r in rows} == {0, 1, 3}


def test_known_scores_leave_out_what_is_below(spark, monkeypatch, tmp_path):
    """A shard gives all results from a known score on, for fewer postings; passes over many small shards give what one pass gives."""
    r = np.random.default_rng(4)
    words = ["w%d" % i for i in range(3000)]
    p = 1 / np.arange(1, 3001)
    texts = [" ".join(r.choice(words, r.integers(5, 120), p=p / p.sum())) for _ in range(600)]
    terms, first, docs, tf, lengths, order = S.postings(pa.array(texts))
    shard = S.Shard(order.tolist(), terms, first, docs, tf.astype(float), lengths, np.diff(first), len(texts), int(lengths.sum()))
    queries = [np.unique(shard.known(S.Words(*S.buffers(pa.array([t])), lower=True).hashes())) for t in texts[::20]]
    plain = list(shard.search_all(queries, 10))
    for share in (0.3, 0.8, 1.0, 1.5):
        least = np.array([share * x[-1][0] for x in plain])
        shard.read = shard.listed = 0
        for want, got, low in zip(plain, shard.search_all(queries, 10, least), least):
            assert [(round(s, 5), d) for s, d in got if s >= low] == [(round(s, 5), d) for s, d in want if s >= low]
        assert shard.read < shard.listed or share < 1.5
    df = table(spark, texts).repartition(7).cache()
    asked = df.where("doc_id % 11 = 0")
    ranks = lambda: sorted((x.query_id, x.rank, x.doc_id, round(x.score, 5)) for x in S.search(df, asked).collect())
    monkeypatch.setattr(S, "PASSES", (0, 64))
    one = ranks()
    monkeypatch.setattr(S, "PASSES", (0, 20, 40, 64))
    assert ranks() == one
