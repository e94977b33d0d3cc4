"""Vendor formats as the standard page: words, lines and paragraphs of text and box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CORNERS = ", ".join(f"{c}{k}: double" for k in range(1, 5) for c in "XY")
ITEM = f"struct<Word: string, Confidence: double, {CORNERS}, page: int, `Index`: int, paragraph_id: int>"
VENDOR = f"struct<words_data: array<{ITEM}>, lines_data: array<{ITEM}>, paragraph_data: array<{ITEM}>, success: boolean, error: string, image: struct<width: int, height: int>>"
RESPONSE = "struct<fullTextAnnotation: struct<pages: array<struct<width: int, height: int, blocks: array<struct<paragraphs: array<struct<words: array<struct<symbols: array<struct<text: string>>, confidence: double, boundingBox: struct<vertices: array<struct<x: double, y: double>>>>>>>>>>>>>"
METADATA = "struct<gt_parse: struct<text_lines: array<struct<text: string, bbox: array<double>, line_id: int, block_id: int>>, text_words: array<struct<text: string, bbox: array<double>, word_id: int, line_id: int>>, quality_metrics: map<string, double>>>"


def _hull(i: Column) -> Column:
    xs, ys = ([i[f"{c}{k}"] for k in range(1, 5)] for c in "XY")
    box = F.array(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))
    whole = i["X1"].isNotNull()
    for x in xs[1:] + ys:
        whole = whole & x.isNotNull()
    return F.when(whole, box).otherwise(F.array(*[F.lit(0.0)] * 4))


def from_vendor(df: DataFrame, column: str) -> DataFrame:
    """``df`` with words, lines, paragraphs, width, height and error; a failed response has empty levels and its error."""
    v = F.from_json(column, VENDOR)
    ok = F.coalesce(v["success"], F.lit(True))
    level = lambda n: F.when(ok, F.transform(F.coalesce(v[n], F.array().cast(f"array<{ITEM}>")), lambda i: F.struct(i["Word"].alias("text"), _hull(i).alias("box")))).otherwise(F.array().cast("array<struct<text: string, box: array<double>>>"))
    return df.select("*", level("words_data").alias("words"), level("lines_data").alias("lines"), level("paragraph_data").alias("paragraphs"), v["image"]["width"].alias("width"), v["image"]["height"].alias("height"), F.when(~ok, v["error"]).alias("error"))


def from_response(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, page, block, paragraph, word, text, confidence, vertices): the nested walk of a recognition response, symbols joined."""
    r = df.select(key, F.posexplode(F.from_json(column, RESPONSE)["fullTextAnnotation"]["pages"]).alias("page", "p"))
    r = r.select(key, "page", F.posexplode("p.blocks").alias("block", "b"))
    r = r.select(key, "page", "block", F.posexplode("b.paragraphs").alias("paragraph", "g"))
    r = r.select(key, "page", "block", "paragraph", F.posexplode("g.words").alias("word", "w"))
    return r.select(key, "page", "block", "paragraph", "word", F.array_join(F.transform("w.symbols", lambda s: s["text"]), "").alias("text"), F.col("w.confidence").alias("confidence"), F.col("w.boundingBox.vertices").alias("vertices"))


def from_parallel(df: DataFrame, texts: str, boxes: str) -> Column:
    """Items of two lists of a page by position, cut at the shorter; boxes are x, y, w, h."""
    n = F.least(F.size(texts), F.size(boxes))
    z = F.arrays_zip(F.slice(texts, F.lit(1), n).alias("t"), F.slice(boxes, F.lit(1), n).alias("b"))
    return F.transform(z, lambda i: F.struct(i["t"].alias("text"), F.array(i["b"][0], i["b"][1], i["b"][0] + i["b"][2], i["b"][1] + i["b"][3]).alias("box")))


def scaled(items: Column, factor: float) -> Column:
    """Boxes of a level times a factor, cut toward zero."""
    return F.transform(items, lambda i: F.struct(i["text"].alias("text"), F.transform(i["box"], lambda v: (v * factor).cast("int")).alias("box")))


def page_left_join(pages: DataFrame, annotations: DataFrame, key: str = "doc_id", index: str = "page") -> DataFrame:
    """Every page with its annotation by position; pages beyond the annotations have empty items."""
    items = dict(annotations.dtypes)["items"]
    return pages.join(annotations, [key, index], "left").withColumn("items", F.coalesce("items", F.array().cast(items)))


def decoded(df: DataFrame, column: str = "ground_truth") -> DataFrame:
    """Lines, words and quality metrics of JSON that lies in JSON; what can't be read is empty."""
    m = F.from_json(column, METADATA)["gt_parse"]
    return df.select("*", F.coalesce(m["text_lines"], F.array().cast("array<struct<text: string, bbox: array<double>, line_id: int, block_id: int>>")).alias("lines"), F.coalesce(m["text_words"], F.array().cast("array<struct<text: string, bbox: array<double>, word_id: int, line_id: int>>")).alias("words"), F.coalesce(m["quality_metrics"], F.create_map().cast("map<string, double>")).alias("quality"))


def encoded(*columns: str) -> Column:
    """A ground-truth text of columns, without those that are null."""
    return F.to_json(F.struct(F.struct(*columns).alias("gt_parse")), {"ignoreNullFields": "true"})


def structure_reason(df: DataFrame) -> Column:
    """Why a parallel-list document (pages: array of bbox and text lists) can't be used; null if it can."""
    first = F.get(F.get(F.get("pages", F.lit(0))["bbox"], F.lit(0)), F.lit(3))
    return F.when(F.col("pages").isNull(), "pages is no list").when(F.size("pages") == 0, "no page").when(first.isNull(), "bbox has fewer than four numbers")


def dense_paragraphs(words: DataFrame, key: str = "doc_id") -> DataFrame:
    """Words with ``paragraph_id`` from 0 in order of their path, and ``idx`` in order of reading."""
    w = Window.partitionBy(key).orderBy("page", "block", "paragraph")
    return words.withColumn("paragraph_id", F.dense_rank().over(w) - 1).withColumn("idx", F.row_number().over(Window.partitionBy(key).orderBy("page", "block", "paragraph", "word")) - 1)
