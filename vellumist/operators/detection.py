"""Detection scores from matched boxes. Thresholds are whole percents, so none is lost to binary fractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLDS = tuple(range(50, 100, 5))
WIDE = tuple(range(5, 100, 5))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return _ratio(2 * p * r, p + r)


def rates(tp: Column, n_expected: Column, n_predicted: Column, one_sided: bool = False) -> list[Column]:
    """precision, recall, f1. Both sides empty are perfect. With ``one_sided`` a side without boxes makes no mistake of its kind:
    no expected box has recall 1, no predicted one precision 1; else both are 0."""
    none = (n_expected == 0) & (n_predicted == 0)
    alone = F.lit(1.0 if one_sided else 0.0)
    p = F.when(none, 1.0).when(n_predicted == 0, alone).otherwise(_ratio(tp, n_predicted))
    r = F.when(none, 1.0).when(n_expected == 0, alone).otherwise(_ratio(tp, n_expected))
    return [p.alias("precision"), r.alias("recall"), F.when(none, 1.0).otherwise(f1(p, r)).alias("f1")]


def per_page(matches: DataFrame, sizes: DataFrame, thresholds: tuple = (50,), page: str = "page_id") -> DataFrame:
    """(page, threshold, tp, fp, fn, mean_iou, precision, recall, f1) for one-to-one matches (iou) and sizes (n_expected, n_predicted).

    Each match is counted at all thresholds at once, in one row a page: it is not multiplied by them.
    """
    at = lambda t: F.col("iou") * 100 >= t
    counts = [F.struct(F.lit(t).alias("threshold"), F.count_if(at(t)).alias("tp"), F.avg(F.when(at(t), F.col("iou"))).alias("mean_iou")) for t in thresholds]
    hits = matches.groupBy(page).agg(F.array(*counts).alias("_hits"))
    none = F.array(*(F.struct(F.lit(t).alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(None).cast("double").alias("mean_iou")) for t in thresholds))
    full = sizes.join(hits, page, "left").select(*sizes.columns, F.inline(F.coalesce("_hits", none)))
    full = full.withColumn("fp", F.col("n_predicted") - F.col("tp")).withColumn("fn", F.col("n_expected") - F.col("tp")).withColumn("mean_iou", F.coalesce("mean_iou", F.lit(0.0)))
    return full.select("*", *rates(F.col("tp"), F.col("n_expected"), F.col("n_predicted"), one_sided=True))


def micro(pages: DataFrame) -> DataFrame:
    """Rates over all boxes at each threshold of :func:`per_page`."""
    s = pages.groupBy("threshold").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return s.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f1(p, r))


def average_precision(scored: DataFrame, total: int) -> DataFrame:
    """(ap) of predictions (score, hit 0/1): the area under the precision envelope where recall changes.

    Predictions are added up by score first, so the running sums go over distinct scores.
    """
    return area_under(scored.groupBy("score").agg(F.sum("hit").alias("tp"), F.count("*").alias("n")), total)


def area_under(by: DataFrame, total: int) -> DataFrame:
    """:func:`average_precision` of the hits and predictions of each score: (score, tp, n)."""
    down = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    run = by.withColumn("ctp", F.sum("tp").over(down)).withColumn("cn", F.sum("n").over(down))
    run = run.withColumn("p", F.col("ctp") / F.col("cn")).withColumn("r", _ratio(F.col("ctp"), F.lit(total)))
    best = F.max("p").over(Window.orderBy(F.desc("score")).rowsBetween(0, Window.unboundedFollowing))
    step = F.col("r") - F.coalesce(F.lag("r").over(Window.orderBy(F.desc("score"))), F.lit(0.0))
    return run.withColumn("e", best).withColumn("s", step).agg(F.coalesce(F.sum(F.col("e") * F.col("s")), F.lit(0.0)).alias("ap"))
