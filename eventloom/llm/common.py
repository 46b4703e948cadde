"""Helpers of the training-data operators: reading, pinned tables, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/documents.parquet")


def pin(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    What follows reads files that outlive any executor, and sees one fixed set of rows.
    """
    return cut_lineage(df, name)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod ``n`` (null for a null id)."""
    return F.crc32(doc_id.cast("string")) % n


def batches(spark: SparkSession, rows: int) -> None:
    """Rows of an Arrow batch: bounds what one Python task holds of long texts."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != str(rows):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` as (node, root), root being the least node.

    Alternating large-star and small-star steps: every node hands its neighbours the least
    node it knows. Minima are aggregated before they are joined back, so a hub is never
    gathered in one task. Each round is pinned; it ends when a round changes nothing.
    Null ends and loops are ignored. No edges: no rows.
    """
    e = edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u < v").distinct()
    e = pin(e, "edges")
    mark = _mark(e)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")).select("n", F.least("n", "m").alias("m"))
        # every larger neighbour v of u goes to m(u)
        large = e.join(least, e.u == least.n).select(F.col("v"), F.col("m").alias("u")).filter("u < v").distinct()
        low = large.groupBy(F.col("v").alias("n")).agg(F.min("u").alias("m"))
        # every smaller neighbour of v, and v itself, go to m(v)
        small = large.join(low, large.v == low.n).select(F.col("u").alias("v"), F.col("m").alias("u"))
        small = small.unionByName(low.select(F.col("n").alias("v"), F.col("m").alias("u"))).filter("u < v").distinct()
        e = pin(small.select("u", "v"), "edges")
        now = _mark(e)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = e.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return leaves.unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def _mark(e: DataFrame) -> tuple[int, int, int]:
    h = F.xxhash64("u", "v")
    r = e.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first()
    return r[0], r[1] or 0, r[2] or 0
