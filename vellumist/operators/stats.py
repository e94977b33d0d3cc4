"""Summaries, percentiles and threshold rules over metric columns."""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def unpivoted(df: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, value), blanks and texts that are no numbers as null."""
    return df.select(F.explode(F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c).cast("double"))))).alias("metric", "value"))


def summaries(df: DataFrame, columns: list[str]) -> DataFrame:
    """n, min, max, mean, median and sample deviation of each column; null values don't count."""
    v = F.col("value")
    return unpivoted(df, columns).where(v.isNotNull()).groupBy("metric").agg(F.count("*").alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.round(F.avg(v), 6).alias("mean"), F.round(F.median(v), 6).alias("median"), F.round(F.stddev_samp(v), 6).alias("std"))


def percentiles(df: DataFrame, columns: list[str], at: tuple = (0, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1)) -> DataFrame:
    """(metric, p, value) with linear interpolation."""
    got = unpivoted(df, columns).where("value is not null").groupBy("metric").agg(F.percentile("value", F.array(*map(F.lit, at))).alias("v"))
    return got.select("metric", F.explode(F.arrays_zip(F.array(*(F.lit(float(p)) for p in at)).alias("p"), F.col("v"))).alias("x")).select("metric", "x.p", F.round("x.v", 6).alias("value"))


def violates(rules: list[tuple[str, str, float]]) -> Column:
    """Whether any rule's bad condition holds; a null metric violates none."""
    out = F.lit(False)
    for metric, op, value in rules:
        out = out | F.coalesce(OPS[op](F.col(metric), F.lit(value)), F.lit(False))
    return out


def impact(df: DataFrame, rules: list[tuple[str, str, float]]) -> DataFrame:
    """(rule, n_hit) of each rule by itself over all rows."""
    pairs = [x for m, o, v in rules for x in (F.lit(f"{m} {o} {v:g}"), F.sum(F.coalesce(OPS[o](F.col(m), F.lit(v)), F.lit(False)).cast("long")))]
    return df.agg(F.create_map(*pairs).alias("m")).select(F.explode("m").alias("rule", "n_hit")).select("rule", F.coalesce("n_hit", F.lit(0)).alias("n_hit"))
