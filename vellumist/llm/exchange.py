"""Bounded filters and connected components, shared by the joins of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh, remove

SALTS = 8
LEAST_BITS, MOST_BITS = 23, 28  # of a filter: 1 MB to 32 MB, which is a memory limit and loses nothing: beyond it, more ids pass


def key_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap with a place for each id's low bits, eight for each id as long as MOST_BITS allow; null ids aren't in it.

    It lets through every id that is in ``ids``, and of the others about one in nine at most, or more of them beyond MOST_BITS.
    """
    n = ids.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (8 * n).bit_length()))
    low = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = (
        ids.where(F.col(column).isNotNull())
        .select(low.alias("low"))
        .groupBy(F.shiftright("low", 6).alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(low & 63 as int))")).alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def passes(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    low = ids.astype(np.int64) & (64 * len(bitmap) - 1)
    return (bitmap[low >> 6] >> (low & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _joined(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (u, v) with m of their u (one row a node). The edges of a node are spread over SALTS keys by the other end's hash."""
    left = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    right = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return left.join(right, ["u", "salt"]).drop("salt")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node that each end of an edge can reach.

    Alternating large and small stars, each an aggregation and a join on one end, so no node's edges meet in one row; a node with many
    edges has its least neighbour sent along under several salts, so that its edges are spread over as many tasks. Each round is
    written to the shared folder; rounds grow with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    path = fresh(spark, "edges")
    edges.select(u, v).where("u <> v").distinct().write.parquet(path)
    schema = "u long, v long"
    seen = None
    while True:
        e = spark.read.schema(schema).parquet(path)
        state = e.agg(F.count("*"), F.expr("coalesce(bit_xor(xxhash64(u, v)), 0)")).first()
        if state == seen:
            break
        seen = state
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _joined(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        middle = fresh(spark, "edges")
        large.write.parquet(middle)
        e = spark.read.schema(schema).parquet(middle)
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        small = _joined(e, least).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        after = fresh(spark, "edges")
        small.write.parquet(after)
        remove(spark, path)
        remove(spark, middle)
        path = after
    labels = spark.read.schema(schema).parquet(path).select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.union(labels.select(F.col("label").alias("node"), "label").distinct())
