"""Ranking by embedding diversity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cosine_distance(a, b):
    return F.greatest(F.lit(0.0), 1 - F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x))


def _literal(v) -> "F.Column":
    return F.array(*(F.lit(float(x)) for x in v))


def k_center(df: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(rank, key, radius_before, radius_after): the point farthest from the mean first, then always the one farthest from those chosen.

    The distance to the mean stays in the running minimum. Each step is one aggregation over all rows and brings one vector to the
    driver; ties go to the smaller key. Every 16 steps the distances are written to the shared folder, which keeps plans short.
    """
    spark = df.sparkSession
    base = df.where(F.col(vector).isNotNull()).select(key, vector)
    size = base.select(F.max(F.size(vector))).first()[0]
    if not size:
        return spark.createDataFrame([], f"rank long, {key} long, radius_before double, radius_after double")
    mean = base.select(F.array(*(F.avg(F.get(vector, F.lit(i)).cast("double")) for i in range(size)))).first()[0]
    norm = sum(x * x for x in mean) ** 0.5 or 1.0
    state = base.withColumn("d", cosine_distance(F.col(vector), _literal([x / norm for x in mean])))
    out = []
    top = F.max_by(F.struct(key, vector, "d"), F.struct("d", -F.col(key))).alias("x")
    best = state.select(top).first()["x"]
    for step in range(1, k + 1):
        state = state.withColumn("d", F.least("d", cosine_distance(F.col(vector), _literal(best[vector]))))
        if step % 16 == 0:
            state = _stored(spark, state)
        after = state.select(top).first()["x"]
        out.append((step, best[key], float(best["d"]), float(after["d"])))
        if after["d"] <= 0:
            break
        best = after
    return spark.createDataFrame(out, f"rank long, {key} long, radius_before double, radius_after double")


CANDIDATES = 8192
_BLOCK = 1024


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def full_order(df: DataFrame, key: str = "vec_id", vector: str = "embedding", candidates: int = CANDIDATES) -> DataFrame:
    """The columns and order of ``k_center``, for every row with a vector: copies of chosen rows come last, by key.

    Distances only fall, so of the rows farthest away (``candidates`` of them, on the driver) one is the next as long as it is not
    nearer than the first row left out was. All that were chosen so are centres of the next pass, which brings the distances of all
    rows up to date in blocks and writes them to the shared folder. Vectors have one length. Work grows with the square of the rows.
    """
    spark = df.sparkSession
    kind = f"rank long, {key} long, radius_before double, radius_after double"
    base = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias(vector))
    size = base.select(F.max(F.size(vector))).first()[0]
    if not size:
        return spark.createDataFrame([], kind)
    mean = np.array(base.select(F.array(*(F.avg(F.get(vector, F.lit(i))) for i in range(size)))).first()[0])
    start, fields = mean / (np.linalg.norm(mean) or 1), f"{key} long, {vector} array<double>, d double"

    def nearer(centres: np.ndarray, chosen: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(pa.array(~np.isin(batch.column(key).to_numpy(), chosen)))
                v, d = _matrix(batch.column(vector), size), batch.column("d").to_numpy().copy()
                for a in range(0, len(centres) if len(v) else 0, _BLOCK):
                    d = np.minimum(d, np.maximum(0, 1 - (v @ centres[a : a + _BLOCK].T).max(1)))
                yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(vector), pa.array(d)], [key, vector, "d"])

        return run

    state, path = base.withColumn("d", F.lit(float("inf"))), None
    centres, chosen, keys, radii = start[None], np.zeros(0, np.int64), [], []
    while True:
        state, old = _stored(spark, state.mapInArrow(nearer(centres, chosen), fields)), path
        path = (state.inputFiles() or [""])[0].rpartition("/")[0]
        if old:
            p = spark._jvm.org.apache.hadoop.fs.Path(old)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        far = state.orderBy(F.desc("d"), key).limit(candidates + 1).toArrow()
        if not far.num_rows:
            break
        limit = (far.column("d")[candidates].as_py(), far.column(key)[candidates].as_py()) if far.num_rows > candidates else None
        far = far.slice(0, candidates).sort_by(key)  # the first of equal distances has the smallest key
        k, v, d, picked = far.column(key).to_numpy(), _matrix(far.column(vector), size), far.column("d").to_numpy().copy(), []
        while len(picked) < len(k):
            i = int(np.argmax(d))
            if limit and (d[i], -k[i]) < (limit[0], -limit[1]):
                break
            picked.append(i)
            keys.append(int(k[i]))
            radii.append(float(d[i]))
            d = np.minimum(d, np.maximum(0, 1 - v @ v[i]))
            d[picked] = -1
        if not limit:
            break
        centres, chosen = v[picked], k[picked]
    return spark.createDataFrame(list(zip(range(1, len(keys) + 1), keys, radii, [*radii[1:], 0.0])), kind)


def _stored(spark: SparkSession, df: DataFrame) -> DataFrame:
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        return df
    path = f"{root.rstrip('/')}/kcenter-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def greedy_order(vectors: np.ndarray) -> list[int]:
    """The same order for a matrix in memory."""
    mean = vectors.mean(0)
    d = np.maximum(0, 1 - vectors @ (mean / (np.linalg.norm(mean) or 1)))
    order = []
    for _ in range(len(vectors)):
        i = int(np.argmax(d))
        order.append(i)
        d = np.minimum(d, np.maximum(0, 1 - vectors @ vectors[i]))
        d[i] = -1
    return order


def elbow(points: DataFrame, x: str, y: str) -> DataFrame:
    """The row of a curve that lies farthest from the chord between its ends; ties go to the first."""
    ends = points.agg(F.min_by(F.struct(x, y), x).alias("a"), F.max_by(F.struct(x, y), x).alias("b"))
    dx, dy = F.col(f"b.{x}") - F.col(f"a.{x}"), F.col(f"b.{y}") - F.col(f"a.{y}")
    length = F.sqrt(dx * dx + dy * dy)
    off = F.abs(dx * (F.col(f"a.{y}") - F.col(y)) - dy * (F.col(f"a.{x}") - F.col(x))) / F.nullif(length, F.lit(0.0))
    return points.join(F.broadcast(ends)).withColumn("distance", F.coalesce(off, F.lit(0.0))).orderBy(F.round("distance", 9).desc(), x).limit(1).select(x, y, "distance")


