"""Scorers of prediction tables: sample_id, filename, task_type, output_type, question, expected_answer, predicted_answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..functions.output import repair_json
from . import assignment, detection, spatial

ITEMS = "array<struct<text: string, bbox: array<double>>>"


def score_text(df: DataFrame, threshold: float = 0.5, drop_templates: bool = False, key: str = "sample_id") -> DataFrame:
    """Text metrics of each row; null for questions that are unfilled templates (or those rows dropped)."""
    df = df.withColumn("is_template_placeholder", T.has_placeholder(F.col("question")))
    if drop_templates:
        df = df.where("not is_template_placeholder")
    clean = lambda c: T.normalize("NFKC")(F.coalesce(c, F.lit("")))
    columns = df.columns
    df = df.withColumn("_e", clean(F.col("expected_answer"))).withColumn("_p", clean(T.predicted_text(F.col("predicted_answer"))))
    m = T.reading_metrics(F.col("_e"), F.col("_p"), threshold)
    return df.withColumn("_m", F.when(~F.col("is_template_placeholder"), m)).select(*columns, "_m.*")


def text_summary(scored: DataFrame, *by: str) -> DataFrame:
    """Macro means and medians over scored rows, with totals over ``by``."""
    out = [F.count("*").alias("n"), F.sum("exact_match").alias("exact_matches"), F.avg("exact_match").alias("mean_exact_match")]
    for c in ("cer", "wer", "anls"):
        out += [F.avg(c).alias(f"mean_{c}"), F.median(c).alias(f"median_{c}")]
    return (scored.rollup(*by) if by else scored.groupBy()).agg(*out)


def boxes(df: DataFrame, column: str, key: str = "sample_id") -> DataFrame:
    """(key, idx, x1..y2) of boxes in JSON, or else in free text."""
    found = F.coalesce(G.boxes_in_json(F.col(column)), G.boxes_in_text(F.coalesce(F.col(column), F.lit(""))))
    b = df.select(key, F.posexplode(found).alias("idx", "b"))
    return b.select(F.col(key).alias("page_id"), F.col("idx").cast("long").alias("idx"), *(F.get("b", F.lit(k)).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))))


def score_detection(df: DataFrame, thresholds: tuple = detection.WIDE, key: str = "sample_id") -> DataFrame:
    """(key, threshold, tp, fp, fn, mean_iou, precision, recall, f1) of each row and threshold, rows without any box among them."""
    df = df.where(~T.has_placeholder(F.col("question")))
    e, p = boxes(df, "expected_answer", key), boxes(df, "predicted_answer", key)
    pairs = spatial.overlap_join(e, p).select(F.col("l.page_id").alias("page_id"), F.col("l.idx").alias("e"), F.col("r.idx").alias("p"), "iou")
    count = lambda b, n: b.groupBy("page_id").agg(F.count("*").alias(n))
    sizes = df.select(F.col(key).alias("page_id")).join(count(e, "n_expected"), "page_id", "left").join(count(p, "n_predicted"), "page_id", "left").fillna(0, ["n_expected", "n_predicted"])
    matches = None
    for t in thresholds:  # the best matching depends on where pairs stop counting
        one = assignment.assign(pairs, t / 100).withColumn("threshold", F.lit(t))
        matches = one if matches is None else matches.unionByName(one)
    hits = matches.groupBy("page_id", "threshold").agg(F.count("*").alias("tp"), F.avg("iou").alias("mean_iou"))
    full = sizes.select("*", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")).join(hits, ["page_id", "threshold"], "left").fillna(0, ["tp"]).fillna(0.0, ["mean_iou"])
    full = full.withColumn("fp", F.col("n_predicted") - F.col("tp")).withColumn("fn", F.col("n_expected") - F.col("tp"))
    return full.select(F.col("page_id").alias(key), "threshold", "n_expected", "n_predicted", "tp", "fp", "fn", "mean_iou", *detection.rates(F.col("tp"), F.col("n_expected"), F.col("n_predicted"), one_sided=True))


def lines_of(c: Column) -> Column:
    """Items of text and bbox in a model's output, keys normalized; null where it is no list of objects."""
    return F.from_json(repair_json(c), ITEMS)


def score_lines(df: DataFrame, threshold: float = 0.5, key: str = "sample_id") -> DataFrame:
    """Text metrics of all lines in reading order and of matched lines, box rates at ``threshold``, and whether the JSON is valid."""
    df = df.where(~T.has_placeholder(F.col("question"))).select(key, F.coalesce(lines_of(F.col("expected_answer")), F.array().cast(ITEMS)).alias("e"), lines_of(F.col("predicted_answer")).alias("p"))
    df = df.withColumn("valid_json", F.col("p").isNotNull()).withColumn("p", F.coalesce("p", F.array().cast(ITEMS)))
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.transform(c, lambda i: F.struct(F.get(i["bbox"], F.lit(1)).alias("y"), F.get(i["bbox"], F.lit(0)).alias("x"), F.coalesce(i["text"], F.lit("")).alias("t")))), lambda s: s["t"]), " ")
    overall = df.select(key, "valid_json", F.size("e").alias("n_expected"), F.size("p").alias("n_predicted"), T.reading_metrics(ordered(F.col("e")), ordered(F.col("p"))).alias("m"))
    side = lambda c: df.select(F.col(key).alias("page_id"), F.posexplode(c).alias("idx", "i")).select("page_id", F.col("idx").cast("long").alias("idx"), F.col("i.text").alias("text"), *(F.coalesce(F.get("i.bbox", F.lit(k)), F.lit(0.0)).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))))
    e, p = side("e"), side("p")
    near = spatial.overlap_join(e, p).select(F.col("l.page_id").alias("page_id"), F.col("l.idx").alias("e"), F.col("r.idx").alias("p"), "iou")
    match = assignment.assign(near, threshold).join(e.select("page_id", F.col("idx").alias("e"), F.col("text").alias("et")), ["page_id", "e"]).join(p.select("page_id", F.col("idx").alias("p"), F.col("text").alias("pt")), ["page_id", "p"])
    join = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("e", F.coalesce(c, F.lit("")).alias("t")))), lambda s: s["t"]), " ")
    per = match.groupBy("page_id").agg(F.count("*").alias("matched"), F.avg("iou").alias("mean_iou"), T.reading_metrics(join("et"), join("pt")).alias("mm"))
    r = overall.join(per.withColumnRenamed("page_id", key), key, "left").fillna(0, ["matched"])
    rates = detection.rates(F.col("matched"), F.col("n_expected"), F.col("n_predicted"))
    return r.select(key, "valid_json", "n_expected", "n_predicted", "matched", "mean_iou", *(c.alias(f"bbox_{n}") for c, n in zip(rates, ("precision", "recall", "f1"))), *(F.col(f"m.{c}").alias(f"overall_{c}") for c in ("exact_match", "anls", "cer", "wer")), *(F.col(f"mm.{c}").alias(f"matched_{c}") for c in ("exact_match", "anls", "cer", "wer")))


def route(df: DataFrame) -> dict[str, DataFrame]:
    """Rows of a prediction table by the scorer that they need."""
    box_only = F.col("output_type").isin("box", "[box]") | F.col("task_type").isin("detection", "conditional_detection")
    structured = F.col("output_type").contains("box") & ~box_only
    return {"detection": df.where(box_only), "lines": df.where(structured), "text": df.where(~box_only & ~structured)}
