import hashlib
import random
import zlib

import numpy as np
import pytest

from cases import TEXTS, empty, table
from vellumist.llm import tokens as T

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def libraries():
    return [T.tokenizer(T.vocabulary(n)) for n in (T.BYTE_VOCABULARY, T.WORD_VOCABULARY)]


def ids(t, text):
    return t.encode(text or "", add_special_tokens=False).ids


def test_counts_equal_the_library(spark, libraries):
    got = {r.doc_id: r for r in T.count_tokens(table(spark), T.vocabulary(T.BYTE_VOCABULARY)).collect()}
    assert len(got) == len(TEXTS)
    for i, x in enumerate(TEXTS):
        n = len(ids(libraries[0], x))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((x or "").encode()), n, n > 1024)


def test_safe_cuts_on_random_white_space(libraries):
    from vellumist.llm.memo import Memo
    from vellumist.llm.text import buffers
    import pyarrow as pa

    r = random.Random(1)
    texts = ["".join(r.choice(["a", "é", "1", ".", " ", "  ", "\n", " ", "　", "'s", "\t", "日", "<|endoftext|>"]) for _ in range(r.randint(0, 40))) for _ in range(2000)]
    data, offsets = buffers(pa.array(texts))
    starts, lens, first = T.safe_pieces(data, offsets)
    memo = Memo(lambda xs: [e.ids for e in libraries[0].encode_batch(xs, add_special_tokens=False)], lengths_only=True, bound=2000)
    _, size, _ = memo.look_up(np.concatenate([data, np.zeros(16, np.uint8)]), starts, lens)
    for i, x in enumerate(texts):
        assert size[first[i] : first[i + 1]].sum() == len(ids(libraries[0], x)), repr(x)


def test_round_trip_equals_the_library(spark, libraries):
    t = libraries[1]
    for r in T.encode_decode(table(spark), T.vocabulary(T.WORD_VOCABULARY), digests=True).collect():
        e = ids(t, TEXTS[r.doc_id])
        assert r.n_tokens == len(e)
        assert r.ids_sha256 == hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(e, skip_special_tokens=False).encode()).hexdigest()
    for r in T.encode_decode(table(spark), T.vocabulary(T.WORD_VOCABULARY)).collect():
        assert list(r.ids) == ids(t, TEXTS[r.doc_id]) and r.decoded == t.decode(list(r.ids), skip_special_tokens=False)


def test_tree_joins_are_exact(libraries):
    r = random.Random(3)
    e = T.TreeEncoder(T.vocabulary(T.WORD_VOCABULARY), leaf=7)
    alphabets = ["abcdefghij", "thearin", "aaaaab", "日本語学校", "éàü", "ab1.,'\"!", "the" * 3]
    for k in range(800):
        s = "".join(r.choice(r.choice(alphabets)) for _ in range(r.randint(0, 300)))
        if k % 5 == 0:
            s = s[:50] + "<|endoftext|>" + s[50:]
        assert e([s])[0].tolist() == ids(libraries[1], s), s


def test_tree_of_whole_texts_is_exact(libraries):
    """Halves of texts with words, white space of every kind, marks, accents that compose across a cut, and unsplit stretches."""
    r = random.Random(8)
    parts = ["the", "anaesthetic", "don't", "we'll", "e\u0301", "\u0301", "ΑΣ", "İ", "日本語学校", "12345", "!!!", "...", "<|endoftext|>", "x" * 40, "ǅ", "\u0344"]
    spaces = [" ", "  ", "\n", "\t", "\u3000", "\r\n", "\x1c", "\u00a0"]
    for leaf in (4, 32, 150):
        e = T.TreeEncoder(T.vocabulary(T.WORD_VOCABULARY), leaf=leaf)
        texts = ["".join(r.choice(parts) + (r.choice(spaces) if r.random() < 0.8 else "") for _ in range(r.randint(0, 60))) for _ in range(250)]
        assert [x.tolist() for x in e(texts)] == [ids(libraries[1], x) for x in texts]
        assert leaf < 100 or e.joins > 100


def test_documents_go_through_the_tree(spark, libraries):
    """Every document longer than a leaf is encoded by halves, and all ids are the library's."""
    import os

    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        return
    texts = [x.text or "" for x in spark.read.parquet(path).select("text").collect()]
    e = T.TreeEncoder(T.vocabulary(T.WORD_VOCABULARY))
    assert [x.tolist() for x in e(texts)] == [ids(libraries[1], x) for x in texts]
    assert e.joins >= sum(len(x) > e.leaf for x in texts) > len(texts) / 4
    assert e.joins == sum((1 << ((len(x) - 1) // e.leaf).bit_length()) - 1 for x in texts if x)


def check_packing(rows, encoded, capacity):
    documents, sequences = {}, {}
    for r in rows:
        full = encoded[r.doc_id] + [T.END]
        assert r.doc_tokens == len(full) and r.length > 0
        assert zlib.crc32(np.array(full[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        documents.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts, ends in [(documents, {k: len(v) + 1 for k, v in encoded.items()}), (sequences, None)]:
        for k, v in parts.items():
            at = 0
            for a, n in sorted(v):
                assert a == at
                at += n
            assert at == ends[k] if ends else at <= capacity
    assert set(documents) == set(encoded)
    return len(sequences)


def test_packing_covers_every_id_once(spark, libraries):
    encoded = {i: ids(libraries[1], x) for i, x in enumerate(TEXTS)}
    rows = T.pack_documents(table(spark).coalesce(1), T.vocabulary(T.WORD_VOCABULARY)).collect()
    n = check_packing(rows, encoded, T.CAPACITY)
    assert n == -(-sum(len(e) + 1 for e in encoded.values()) // T.CAPACITY)
    assert check_packing(T.pack_documents(table(spark), T.vocabulary(T.WORD_VOCABULARY), group_bytes=1000).collect(), encoded, T.CAPACITY)


def test_packing_balances_costs():
    r = random.Random(5)
    sizes = np.array([r.randint(1, 900) for _ in range(500)])
    pieces = T.pack(sizes)
    cost = {}
    for _, _, n, s, _ in pieces:
        cost[s] = cost.get(s, 0) + n + n * n / 2048
    whole = sorted(cost.values())[1:]
    assert max(whole) < 1.25 * min(whole)


def test_empty_tables(spark):
    for f in (lambda d: T.count_tokens(d, T.vocabulary(T.BYTE_VOCABULARY)), lambda d: T.encode_decode(d, T.vocabulary(T.WORD_VOCABULARY)), lambda d: T.pack_documents(d, T.vocabulary(T.WORD_VOCABULARY))):
        assert f(empty(spark)).collect() == []


def test_null_ids_stay_null(spark):
    df = spark.createDataFrame([(None, "a b"), (2**53 + 1, "c")], "doc_id long, text string")
    for f in (lambda d: T.count_tokens(d, T.vocabulary(T.BYTE_VOCABULARY)), lambda d: T.encode_decode(d, T.vocabulary(T.WORD_VOCABULARY)), lambda d: T.pack_documents(d, T.vocabulary(T.WORD_VOCABULARY))):
        assert {r.doc_id for r in f(df).collect()} == {None, 2**53 + 1}
