"""Samples to a trainer, as a batch epoch or a stream of new shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sharding import numbered
from ..sources.tar import SCHEMA, TarSource, paired


def epoch(df: DataFrame, key: str, number: int, world: int = 1, rank: int = 0, size: int | None = None, seed: int = 42) -> DataFrame:
    """One rank's samples of an epoch in their order: mixed by key, epoch and seed, dealt round, capped at ``size``."""
    mixed = numbered(df.withColumn("_h", F.xxhash64(key, F.lit(number), F.lit(seed))), ["_h", key], "_n")
    mine = mixed.where(F.col("_n") % world == rank).withColumn("_i", F.floor(F.col("_n") / world))
    if size is not None:
        mine = mine.where(F.col("_i") < size)
    return mine.orderBy("_i").drop("_h", "_n", "_i")


def steps(n: int, batch: int) -> int:
    """Steps in an epoch; an error unless batches come out even."""
    if n % batch:
        raise ValueError(f"{n} samples don't divide into batches of {batch}")
    return n // batch


def stream(spark: SparkSession, pattern: str, files_per_trigger: int = 0) -> DataFrame:
    """Members of new shards as they come."""
    spark.dataSource.register(TarSource)
    return spark.readStream.format("tarshards").schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).load(pattern)


def tolerant(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): pairs whose JSON parses, and the keys of those where it doesn't, with the reason."""
    pairs = paired(rows, strict=False)
    reason = F.when(F.col("json").isNull(), "no json").when(F.try_parse_json("json").isNull(), "bad json")
    marked = pairs.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null").select("shard", "key", "reason")
