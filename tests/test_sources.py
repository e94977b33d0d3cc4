"""Tar shards, JSON lines, image headers and the feed."""

import io
import json
import struct
import tarfile
import zlib

import pytest
from pyspark.sql import functions as F

from vellumist.sources import tar as S
from vellumist.streaming import feed


def shard(path, members):
    with tarfile.open(path, "w") as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))


def page(text):
    return json.dumps({"text": {"lines": [{"text": text, "box": [0, 0, 1, 1]}], "text": text}, "image": {"width": 3, "height": 4}}).encode()


PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480) + b"\x08\x02\x00\x00\x00" + struct.pack(">I", zlib.crc32(b""))
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 20, 30) + b"\x03" + b"\x00" * 12


@pytest.fixture()
def folder(tmp_path, spark):
    spark.dataSource.register(S.TarSource)
    shard(tmp_path / "a.tar", [("x/1.json", page("one")), ("x/1.png", PNG), ("2.json", page("two")), ("2.jpg", JPEG), ("2.png", PNG), ("3.json", page("no image")), ("4.png", PNG)])
    shard(tmp_path / "b.tar", [("5.json", b"{broken"), ("5.jpeg", JPEG)])
    return tmp_path


def test_read_pair_and_type(spark, folder):
    rows = spark.read.format("tarshards").load(f"{folder}/a.tar;{folder}/b*.tar")
    assert rows.count() == 9
    pairs = {r.key: bytes(r.image) for r in S.paired(rows).collect()}
    assert set(pairs) == {"x/1", "2", "5"} and pairs["2"] == PNG
    assert {r.key for r in S.paired(rows, strict=False).collect()} == {"x/1", "2", "4", "5"}
    typed = {r.key: r for r in S.pages(S.paired(rows)).collect()}
    assert set(typed) == {"x/1", "2"} and typed["2"].text == "two" and typed["2"].words == [] and typed["2"].width == 3
    assert spark.read.format("tarshards").option("ext", "json").load(str(folder / "*.tar")).count() == 4
    with pytest.raises(FileNotFoundError):
        S.expand(f"{folder}/none*.tar")


def test_write_and_read_back(spark, folder, tmp_path):
    rows = [(f"k{i:03d}", e, f"{i}{e}".encode()) for i in range(50) for e in ("json", "png")]
    out = str(tmp_path / "out")
    df = spark.createDataFrame(rows, "key string, ext string, payload binary").repartition(3, "key").sortWithinPartitions("key")
    df.write.format("tarshards").mode("append").option("path", out).option("rows", 8).save()
    back = spark.read.format("tarshards").load(f"{out}/*.tar")
    assert {(r.key, r.ext, bytes(r.payload)) for r in back.collect()} == set(rows)
    assert all(r.n <= 8 for r in back.groupBy("shard").agg(F.count_distinct("key").alias("n")).collect())
    assert sum(json.load(open(f"{out}/manifest.json")).values()) == 100


def test_stream_takes_new_shards(spark, folder, tmp_path):
    s = feed.stream(spark, f"{folder}/*.tar", 1)
    q = s.writeStream.format("memory").queryName("members").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    assert spark.sql("select count(*) from members").first()[0] == 9
    shard(folder / "c.tar", [("6.json", b"{}")])
    q.processAllAvailable()
    assert spark.sql("select count(*) from members").first()[0] == 10
    q.stop()


def test_stream_reads_each_shard_once_over_a_restart(spark, tmp_path):
    for name in ("m", "n", "o"):
        shard(tmp_path / f"{name}.tar", [(f"{name}.json", b"{}")])
    out = lambda: sorted(r.shard for r in spark.read.parquet(str(tmp_path / "out")).collect())

    def run():
        s = feed.stream(spark, f"{tmp_path}/*.tar", 2)
        q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()

    run()
    assert out() == ["m.tar", "n.tar", "o.tar"]
    shard(tmp_path / "a.tar", [("a.json", b"{}")])  # sorts before all that were read
    shard(tmp_path / "z.tar", [("z.json", b"{}")])
    run()
    assert out() == ["a.tar", "m.tar", "n.tar", "o.tar", "z.tar"]


def test_tolerant(spark, folder):
    good, bad = feed.tolerant(spark.read.format("tarshards").load(f"{folder}/*.tar"))
    assert {r.key for r in good.collect()} == {"x/1", "2"}
    assert {(r.key, r.reason) for r in bad.collect()} == {("4", "no json"), ("5", "bad json")}


def test_epochs(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    parts = [[r.k for r in feed.epoch(df, "k", 1, 4, i).collect()] for i in range(4)]
    assert sorted(sum(parts, [])) == list(range(103)) and max(map(len, parts)) - min(map(len, parts)) <= 1
    assert parts[0] == [r.k for r in feed.epoch(df.repartition(5), "k", 1, 4, 0).collect()] != sorted(parts[0])
    assert len(feed.epoch(df, "k", 2, 2, 0, size=10).collect()) == 10
    assert feed.steps(100, 10) == 10
    with pytest.raises(ValueError):
        feed.steps(101, 10)


def test_jsonl_csv_images(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"file_name": "a", "ground_truth": "{}"}\n\n{broken\n{"ground_truth": "x"}\n')
    assert [r.file_name for r in S.samples(spark, str(tmp_path)).collect()] == ["a"]
    (tmp_path / "p.csv").write_text('filename,task_type,output_type,question_idx,question,expected_answer,predicted_answer\na,b,c,0,"q, ""x""","line\nbreak",z\n')
    r = S.predictions(spark, str(tmp_path / "p.csv")).first()
    assert (r.question, r.expected_answer) == ('q, "x"', "line\nbreak")
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "a.png").write_bytes(PNG)
    (tmp_path / "i" / "b.jpg").write_bytes(JPEG)
    (tmp_path / "i" / "c.jpg").write_bytes(b"no")
    got = {r.path[-5:]: (r.width, r.height, r.format) for r in S.images(spark, str(tmp_path / "i")).collect()}
    assert got == {"a.png": (640, 480, "png"), "b.jpg": (30, 20, "jpeg"), "c.jpg": (None, None, None)}


def test_listing_is_made_by_executors_as_spark_lists(spark, tmp_path):
    from vellumist.sources import files as X

    names = ["ab/1/1.pdf", "ab/1/1.json", "ab/1/p1.JPG", "cd/22/22.pdf", "cd/22/.hidden.pdf", "cd/_tmp/3.pdf", "top.pdf", "cd/22/deep/x.tar.gz", "cd/22/no_ext", "e f/4/4.pdf"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"x" * len(n))
    (tmp_path / "empty").mkdir()
    r = spark.read.format("binaryFile")
    for glob in ("", "??/*/*.pdf", "*/*/*.{pdf,json}", "{ab,cd}/[0-9]*/*", "[!a]?/*/*.pdf"):
        path = f"file://{tmp_path}"
        want = r.load(f"{path}/{glob}") if glob else spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        got = X.listing(spark, path, glob)
        assert "BatchScan" not in str(got._jdf.queryExecution().executedPlan()) and "FileScan" not in str(got._jdf.queryExecution().executedPlan())
        spell = lambda p: p.replace("%20", " ").replace("file:///", "file:/")
        assert sorted((spell(x.path), x.size) for x in got.collect()) == sorted((spell(x.path), x.length) for x in want.select("path", "length").collect()), glob


def test_upper_folders_stay_few(tmp_path):
    from vellumist.sources import files as X

    for k in range(300):
        (tmp_path / "a" / str(k)).mkdir(parents=True)
    assert X._branches(str(tmp_path), want=64, most=100) == [str(tmp_path / "a")]
    assert len(X._branches(str(tmp_path), want=64, most=1000)) == 300
