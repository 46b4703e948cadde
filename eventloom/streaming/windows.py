"""Windowed aggregates on event streams, and a helper that runs a stream to its current end.

Streams carry an event-time column ``ts`` (timestamp). Spark drops rows that are later than
the delay; the caller sets it for a live source. A finite history that is replayed takes no
watermark (None), and nothing is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.session import shared_folder


def _marked(df: DataFrame, delay: str | None) -> DataFrame:
    return df if delay is None else df.withWatermark("ts", delay)


def stream_voxels(df: DataFrame, keys: list[str], bin_len: str, weights: dict, delay: str | None) -> DataFrame:
    """Tumbling voxel bins: weighted sums per (keys, bin, pol, oy, ox)."""
    w = _marked(df, delay).groupBy(F.window("ts", bin_len), *keys, "pol", "oy", "ox")
    return w.agg(*[F.sum(c).alias(n) for n, c in weights.items()]).select(F.col("window.start").alias("bin_start"), *keys, "pol", "oy", "ox", *weights)


def stream_history(df: DataFrame, keys: list[str], length: str, step: str, weights: dict, delay: str | None) -> DataFrame:
    """Sliding history: sums over ``length`` every ``step``."""
    w = _marked(df, delay).groupBy(F.window("ts", length, step), *keys)
    return w.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(n) for n, c in weights.items()]).select(F.col("window.end").alias("window_end"), *keys, "n", *weights)


def stream_latest(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """Newest row per key, for update mode."""
    m = F.max(F.struct(*order, *cols)).alias("_m")
    return df.groupBy(*keys).agg(m).select(*keys, *[F.col(f"_m.{c}").alias(c) for c in dict.fromkeys([*order, *cols])])


def run_available(stream: DataFrame, keys: list[str], mode: str = "update", state_partitions: int | None = None) -> DataFrame:
    """Run to the end of what is available and return the newest emitted row per key.

    A stream keeps the number of state partitions it starts with, so it is set here: by
    default one per core of the cluster.

    Micro-batches are written to the shared folder with their number, overwriting a
    repeated batch, so a restarted batch leaves one copy.
    """
    spark = stream.sparkSession
    out, check = shared_folder(spark, "stream-out"), shared_folder(spark, "stream-state")

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    conf = "spark.sql.shuffle.partitions"
    before = spark.conf.get(conf)
    spark.conf.set(conf, str(state_partitions or spark.sparkContext.defaultParallelism))
    try:
        q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(conf, before)
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
    best = F.max_by(F.struct(*stream.columns), "batch").alias("_r")
    return rows.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(best).select("_r.*")
