import gzip
import hashlib
import io
import zlib

import pytest

from vellumist.llm import warc as W

PAGES = [
    (1, "http://a/x y", "<p>" + "a" * 200),
    (2, "http://b\r\nWARC-Type: evil", "<p>" + "a" * 200),
    (3, None, None),
    (4, "", ""),
    (5, "u", "short"),
    (6, "u", "short"),
    (7, "u", "é" * 50),
    (8, "u", "é" * 50),
    (9, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\n" * 40),
    (10, "u", "<p>" + "a" * 200),
    (11, "u", "x" * 3_000_000),
    (None, None, "no id"),
]


def expected(pages):
    out, first = {}, {}
    for i, _, html in sorted(pages, key=lambda p: (p[0] is None, p[0])):
        raw = (html or "").encode()
        d = hashlib.sha256(raw).hexdigest()
        ref = first.setdefault(d, i) if len(raw) >= 100 else i
        out[i] = (len(raw), d, "response" if ref == i else "revisit", None if ref == i else ref)
    return out


def test_round_trip(spark):
    df = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, digest string")
    rows = W.archive(df).collect()
    assert len(rows) == len(PAGES)
    want, html = expected(PAGES), {p[0]: p[2] or "" for p in PAGES}
    for r in rows:
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == want[r.page_id]
        assert r.payload == ("" if r.record_type == "revisit" else html[r.page_id])


def test_normaliser_makes_members_that_stand_alone():
    records = [W.record("response", i, "u", bytes([i]) * i * 1000, "d", i * 1000, None) for i in range(5)]
    for packed in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records)), gzip.compress(b"".join(records[:3])) + gzip.compress(b"".join(records[3:]))):
        out = io.BytesIO()
        index = W.normalise(io.BytesIO(packed), out)
        assert [zlib.decompress(out.getvalue()[a : a + n], 31) for a, n, _ in index] == records
        assert [name for *_, name in index] == [f"<urn:page:{i}>" for i in range(5)]


def test_damage_is_seen():
    whole = W.record("response", 1, "u", b"abc", "d", 3, None)
    with pytest.raises(ValueError):
        W.normalise(io.BytesIO(gzip.compress(whole[:-3])), io.BytesIO())
    with pytest.raises(ValueError):
        W.parse(whole.replace(b"Content-Length: 3", b"Content-Length: 4"))


def test_hot_payload_and_empty_table(spark):
    df = spark.range(3000).selectExpr("id AS page_id", "'u' AS url", "CASE WHEN id % 3 = 0 THEN repeat('h', 150) ELSE concat('p', id) END AS html")
    rows = W.archive(df).collect()
    assert len(rows) == 3000 and sum(r.record_type == "revisit" for r in rows) == 999
    assert {r.refers_to for r in rows if r.record_type == "revisit"} == {0}
    assert W.archive(df.limit(0)).collect() == []


def test_a_stream_that_is_cut_off_is_an_error():
    import gzip
    import io

    import pytest

    from vellumist.llm.warc import inflate

    raw = gzip.compress(b"one" * 1000) + gzip.compress(b"two")
    assert b"".join(inflate(io.BytesIO(raw))) == b"one" * 1000 + b"two" and b"".join(inflate(io.BytesIO(b""))) == b""
    for cut in (1, 4, 8, 12):
        with pytest.raises(ValueError):
            list(inflate(io.BytesIO(raw[:-cut])))
    with pytest.raises(Exception):
        list(inflate(io.BytesIO(raw[:-6] + b"\0\0" + raw[-4:])))
