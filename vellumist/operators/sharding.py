"""Shards, splits, chunks and samples that depend on keys alone, so they stay when rows or partitions move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: list, name: str = "n") -> DataFrame:
    """``df`` with a global row number from 0 in the given order, without gathering all rows in one task.

    Rows are ranged into partitions by the order and numbered within each; only the partitions' sizes meet, a row each.
    """
    import uuid

    spark = df.sparkSession
    parts = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:  # ranges come from a sample: they are drawn once
        path = f"{root.rstrip('/')}/numbered-{uuid.uuid4().hex}"
        parts.write.parquet(path)
        parts = spark.read.schema(parts.schema).parquet(path)
    else:
        parts = parts.persist()
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_c"))
    base = sizes.withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return parts.withColumn("_r", within).join(base, "_p").withColumn(name, F.col("_b") + F.col("_r")).drop("_p", "_b", "_r")


def by_rows(df: DataFrame, order: list, rows: int, name: str = "shard") -> DataFrame:
    return numbered(df, order, "_n").withColumn(name, F.floor(F.col("_n") / rows)).withColumn("pos", F.col("_n") % rows).drop("_n")


def by_documents(df: DataFrame, document: str, documents: int, name: str = "shard") -> DataFrame:
    """All rows of a document in one shard; documents in order of their key."""
    ids = numbered(df.select(document).distinct(), [document], "_n")
    return df.join(ids.withColumn(name, F.floor(F.col("_n") / documents)).drop("_n"), document)


def chunks(df: DataFrame, order: list, workers: int, total: int, name: str = "worker") -> DataFrame:
    """Contiguous runs of equal length, what is left over to the last."""
    each = max(1, total // workers)
    return numbered(df, order, "_n").withColumn(name, F.least(F.floor(F.col("_n") / each), F.lit(workers - 1))).drop("_n")


def uniform(c: Column, seed: str = "") -> Column:
    """A number from 0 to below 1 by the text of a value: the same in every run and engine."""
    return F.conv(F.substring(F.sha2(F.concat(c.cast("string"), F.lit(seed)).cast("binary"), 256), 1, 12), 16, 10).cast("double") / float(16**12)


def split(c: Column, shares: dict[str, float]) -> Column:
    """The name of the share that the value's number falls into; equal values fall together."""
    u, at, out = uniform(c), 0.0, None
    for name, share in list(shares.items())[:-1]:
        at += share
        out = F.when(u < at, name) if out is None else out.when(u < at, name)
    return out.otherwise(list(shares)[-1]) if out is not None else F.lit(list(shares)[-1])


def shuffled(df: DataFrame, key: str, seed: str = "42") -> list[Column]:
    """An order that a seed mixes; ties by key."""
    return [F.sha2(F.concat(F.col(key).cast("string"), F.lit(seed)).cast("binary"), 256), F.col(key)]


def blocks_of(df: DataFrame, key: str, size: int, seed: str = "42", name: str = "task") -> DataFrame:
    """Labels from 1 for contiguous blocks of ``size`` rows of the mixed order."""
    mixed = df.withColumn("_h", F.sha2(F.concat(F.col(key).cast("string"), F.lit(seed)).cast("binary"), 256))
    return numbered(mixed, ["_h", key], "_n").withColumn(name, F.floor(F.col("_n") / size) + 1).drop("_h", "_n")


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def rotation(i: Column) -> Column:
    """small, or 90, 180, 270 in turn for three of four."""
    turn = F.pmod(i - F.floor(i / 4) - 1, F.lit(3))
    return F.when(i % 4 == 0, "small").when(turn == 0, "90").when(turn == 1, "180").otherwise("270")
