import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import TEXTS, empty, table
from vellumist.llm import similar as S
from vellumist.llm.exchange import components


def sets(texts):
    out = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute(texts):
    g = sets(texts)
    n = len(g)
    links = {i: set() for i in range(n)}
    for i in range(n):
        for j in range(i):
            if g[i] and g[j] and 100 * len(g[i] & g[j]) >= 90 * len(g[i] | g[j]):
                links[i].add(j)
                links[j].add(i)
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min([label[i], *(label[j] for j in links[i])])
            changed |= low < label[i]
            label[i] = low
    return {i: (len(g[i]), len(links[i]), label[i]) for i in range(n)}


def corpus(seed, families=12, copies=9, other=60):
    """Documents in families of slightly changed copies, near the threshold on both sides, exact copies among them."""
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    texts = []
    for _ in range(families):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 6, 12, 40, 150, 400]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 60))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            texts.append(" ".join(w) if r.random() < 0.8 else " ".join(w).upper())
    texts += [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 80))) for _ in range(other)]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(S, "TILE", 3)
    texts = corpus(seed) + TEXTS
    rows = S.similar(table(spark, texts).repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.n_similar, r.component_id) for r in rows} == brute(texts)


def test_blocks_never_miss_a_pair():
    r = np.random.default_rng(3)
    for n in [1, 2, 5, 9, 17, 50, 300, 2000]:
        for _ in range(12):
            a = r.integers(0, 2**63, n).astype(np.uint64)
            drop = r.integers(0, n // 19 + 1)
            b = np.unique(np.concatenate([a[drop:], r.integers(0, 2**63, r.integers(0, n // 19 + 1)).astype(np.uint64)]))
            a = np.unique(a)
            common = len(np.intersect1d(a, b))
            if len(b) and 100 * common >= 90 * (len(a) + len(b) - common):
                k, which = S.block_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
                assert set(k[which == 0].tolist()) & set(k[which == 1].tolist())
                x, y = (np.frombuffer(S.sketch(v), np.uint8) for v in (a, b))
                m = min(len(x), len(y))
                assert np.bitwise_count(S.fold(x, m) ^ S.fold(y, m)).sum() <= len(a) + len(b) - 2 * common <= S.differing(len(a) + len(b))


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (5000, 1001), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000, 5000: 1000}


def test_hot_set_and_repeated_rows(spark):
    texts = ["the same text again and again for all"] * 400 + ["another text of some words here", None, ""] + ["the same text again and again for all THE"]
    df = table(spark, texts)
    df = df.union(df.where("doc_id = 400"))
    rows = {r.doc_id: r for r in S.similar(df).collect()}
    assert rows[0].n_similar == 399 and rows[399].component_id == 0 and rows[400].n_similar == 1 and rows[401].n_shingles == 0
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 400, 401, 402, 403]


def test_empty(spark):
    assert S.similar(empty(spark)).collect() == [] and S.keep_one(empty(spark)).collect() == []


def test_null_keys_and_clashing_columns(spark):
    a, b, c = " ".join("a%d" % i for i in range(60)), " ".join("b%d" % i for i in range(60)), " ".join("c%d" % i for i in range(60))
    rows = [(None, a, 1), (None, a, 2), (None, a + " x", 3), (None, b, 4), (7, b, 5), (9, c, 6), (None, None, 7), (None, "", 8), (9, c, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone long").withColumn("label", F.lit(1)).withColumn("_gone", F.lit(2))
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == 5 and (7, b) in got and (9, c) in got and (None, None) in got and (None, "") in got
    assert sum(i is None and t in (a, a + " x") for i, t in got) == 1
    ids = {r.component_id for r in S.similar(df).collect() if r.doc_id is None and r.n_shingles}
    assert ids == {None, 7}


def test_blocks_of_many_classes_are_tiled(spark, monkeypatch):
    """Near copies in more than three tiles: every link, none of them twice."""
    monkeypatch.setattr(S, "TILE", 4)
    words = ["w%d" % i for i in range(200)]
    texts = [" ".join(words + ["tail%d" % i]) for i in range(15)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = S.similar(df).collect()
    assert all((r.n_similar, r.component_id) == (14, 0) for r in rows)


def test_pairs_of_a_family_are_compared_once(spark, monkeypatch):
    """Near copies share nearly all blocks, each block with others: their pairs are no more for it. Tiles give the same."""
    words = ["w%d" % i for i in range(300)]
    texts = [" ".join(words[: 5 * i] + ["own%d" % i] + words[5 * i + 1 :]) for i in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = S.describe(df).select("class", "n", "sketch")
    for tile in (S.TILE, 20):
        monkeypatch.setattr(S, "TILE", tile)
        near = S._near(S._tasks(S._packed_keys(df, "text", 12, 90)), classes, 90)
        assert near.select("a", "b").distinct().count() == 50 * 49 // 2
        assert near.count() < 1.5 * 50 * 49 // 2
        assert all((r.n_similar, r.component_id) == (49, 0) for r in S.similar(df).collect())


def test_empty_blocks():
    """Two sets that agree in empty blocks alone have a key in common; unrelated sets of a band have none."""
    r = np.random.default_rng(7)
    slots = lambda v, blocks: ((S.mix(v + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(int)
    tested = set()
    for n in [8, 9, 11, 15, 40, 300, 2000, 40_000] * 60:
        if n == 40_000 and len(tested) > 40:
            continue
        a = r.integers(0, 2**63, n).astype(np.uint64)
        blocks = int(S.band_blocks(S.bands(np.array([n]))[1][:1])[0])
        if n < 100 and blocks > 2:  # so that some are empty
            a = np.concatenate([a[slots(a, blocks) >= r.integers(1, min(4, blocks))], a[:0]])
        count = np.bincount(slots(a, blocks), minlength=blocks)
        g = int((count == 0).sum())
        if not 0 < g < blocks:
            continue
        more, extra, b = r.integers(0, 2**63, 40 * blocks).astype(np.uint64), g - 1, [a]
        place = slots(more, blocks)
        for j in np.flatnonzero(count):
            two = 1 + int(extra > 0 and r.random() < 0.5)
            extra -= two - 1
            b.append(more[place == j][:two])
        b = np.concatenate(b)
        same = np.searchsorted(S._LEAST, len(a), "right") - 1
        home = np.searchsorted(S._LEAST, n, "right") - 1
        if same != home or same not in S.bands(np.array([len(b)]))[1]:
            continue
        k, which = S.block_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert set(k[which == 0].tolist()) & set(k[which == 1].tolist())
        tested.add((n, g))
    assert len(tested) > 5
    values = r.integers(0, 2**63, 3000 * 100).astype(np.uint64)
    k, _ = S.block_keys(values, np.arange(0, len(values) + 1, 100))
    assert len(np.unique(k)) == len(k)


def test_filter_grows_with_the_ids(spark):
    from vellumist.llm.exchange import key_filter, passes

    ids = spark.range(0, 3_000_000, 2).withColumn("h", F.xxhash64("id"))
    bitmap = key_filter(ids, "h")
    other = np.array([r.h for r in spark.range(1, 20_001, 2).select(F.xxhash64("id").alias("h")).collect()])
    assert passes(bitmap, np.array([r.h for r in ids.limit(1000).collect()])).all() and passes(bitmap, other).mean() < 0.2
