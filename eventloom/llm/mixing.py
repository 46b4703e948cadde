"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Slot k draws the golden-ratio point frac(k * phi) and so a source: the one whose stretch of
the cumulated targets holds the point. A slot's rank among the slots of its source says which
block of that source it takes. A source's documents, in shuffled order, form one stream that
repeats; it is cut into blocks of equal numbers of words, the last one ending at the target.

Every running sum is in two levels (inside buckets of bounded size, then over buckets), so a
source with a third of all rows is never in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import WORD, pin

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
BLOCK = 64
SEED = 11
# the golden ratio's fraction as an odd multiple of 2**-31: the points are exact integers
_STEP, _BITS = 1327217885, 31
_CELLS, _CHUNK, _BUCKET = 1024, 8192, 4096


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: the words of each text (null: 0)."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """One row per source: source, sid, n_docs, source_size, weight, target, low, high.

    Sources in code point order, null last, take the weights in turn. Targets are in
    proportion to the weights and add up to ``share`` times all words; none is above
    ``epochs`` times its source's size: what would be is given to the others by weight.
    [low, high) is the source's stretch of [0, 1). No words at all: targets 0. ``share``
    must not be above ``epochs``.

    Sources are filled in the order of cap to weight: a source is full if the level that
    those before it leave is above its own cap.
    """
    if share > epochs:
        raise ValueError("the share of all words cannot be above the number of epochs")
    per = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    by_fill = every.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(0, Window.unboundedFollowing)
    up_to = every.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    return (
        per.withColumn("sid", F.row_number().over(by_name) - 1)
        .withColumn("weight", w)
        .withColumn("cap", F.col("source_size").cast("double") * epochs)
        .withColumn("total", F.sum("source_size").over(every) * share)
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("fits", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "sid", F.col("level").alias("level")))).over(every))
        .withColumn("target", F.least("cap", F.greatest(F.lit(0.0), F.coalesce(F.col("fits.level") * F.col("weight"), F.col("cap")))))
        .withColumn("all", F.sum("target").over(every))
        .withColumn("below", F.coalesce(F.sum("target").over(up_to), F.lit(0.0)))
        .select(
            "source", "sid", "n_docs", "source_size", "weight", "target",
            F.when(F.col("all") > 0, F.col("below") / F.col("all")).otherwise(0.0).alias("low"),
            F.when(F.col("all") > 0, (F.col("below") + F.col("target")) / F.col("all")).otherwise(0.0).alias("high"),
        )
    )


def schedule(targets: DataFrame, slots: int) -> DataFrame:
    """slot, sid, rank: the source of each of ``slots`` slots and its place among that source's slots (from 0)."""
    spark = targets.sparkSession
    point = (F.col("id") % (1 << _BITS)) * _STEP % (1 << _BITS) / float(1 << _BITS)
    slot = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", F.floor(F.col("point") * _CELLS))
    reach = pin(targets.filter("high > low").select("sid", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * _CELLS), F.least(F.lit(_CELLS - 1), F.floor(F.col("high") * _CELLS)))).alias("cell")), "mix-cells")
    # the last stretch ends at 1 up to rounding
    top = reach.agg(F.max("high")).first()[0] or 1.0
    drawn = slot.join(reach, "cell").filter((F.col("point") * top >= F.col("low")) & (F.col("point") * top < F.col("high"))).select("slot", "sid", F.floor(F.col("slot") / _CHUNK).alias("chunk"))
    inside = Window.partitionBy("sid", "chunk").orderBy("slot")
    counts = drawn.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    start = pin(counts.select("sid", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first")), "mix-chunks")
    return drawn.withColumn("r", F.row_number().over(inside) - 1).join(start, ["sid", "chunk"]).select("slot", "sid", (F.col("first") + F.col("r")).alias("rank"))


def _shuffled(sized: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """Each document's ``start`` in its source's stream; (sid, bucket, rn) tells rows apart."""
    key = F.xxhash64(F.lit(seed), "doc_id", "size")
    at = sized.join(targets.drop("low", "high", "weight"), sized.source.eqNullSafe(targets.source)).drop(targets.source)
    at = at.withColumn("key", key).withColumn("bucket", F.pmod("key", F.ceil(F.col("n_docs") / _BUCKET)))
    sums = at.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = pin(sums.select("sid", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first")), "mix-buckets")
    inside = Window.partitionBy("sid", "bucket").orderBy("key", "doc_id", "size")
    run = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return at.withColumn("rn", F.row_number().over(inside)).withColumn("run", run).join(first, ["sid", "bucket"]).withColumn("start", F.col("first") + F.col("run"))


def segments(placed: DataFrame, block: int = BLOCK, epochs: int = EPOCHS) -> DataFrame:
    """``placed`` rows with each ``rank`` (block of the source's stream) that holds words of theirs, and how many (``words``).

    The stream ends at the target, rounded. A document without any gets one row of 0 words.
    """
    end = F.round("target").cast("long")

    def part(e: int) -> Column:
        a = F.col("start") + e * F.col("source_size")
        b = F.least(a + F.col("size"), end)
        first, last = F.floor(a / block), F.floor((b - 1) / block)
        one = lambda j: F.struct(j.alias("rank"), (F.least(b, (j + 1) * block) - F.greatest(a, j * block)).alias("words"))
        return F.when(b > a, F.transform(F.sequence(first, last), one)).otherwise(F.array().cast("array<struct<rank:bigint,words:bigint>>"))

    all_parts = F.concat(*[part(e) for e in range(epochs)])
    # documents without a part get a rank of their own: no slot has it, and they don't meet in one task
    none = F.struct((-F.col("rn").cast("long") - 1).alias("rank"), F.lit(0).cast("long").alias("words"))
    return placed.withColumn("part", F.explode(F.when(F.size(all_parts) > 0, all_parts).otherwise(F.array(none)))).select("*", F.col("part.rank").alias("rank"), F.col("part.words").alias("words")).drop("part")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken.

    ``taken`` counts the words that the mix takes of the document, repeats included, never
    above ``epochs`` times its size. Slots are drawn until every source can reach its
    target: a few more than all words need, as a stretch's share of the points is off by a
    few points; blocks end at the target. Null and empty texts take part with size 0; a null
    source is a source; repeated rows and repeated or null ids are rows of their own; other
    columns are ignored. Reruns agree. An empty table gives no rows.
    """
    sized = pin(sizes(docs), "mix-sizes")
    targets = pin(source_targets(sized, weights, share, epochs), "mix-targets")
    total, sources = targets.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.count("*")).first()
    slots = int(total / block * (1 + 1 / 64)) + 16 * sources + 1 if total else 0
    drawn = schedule(targets, slots).select("sid", "rank", F.lit(1).cast("long").alias("hit"))
    part = segments(_shuffled(sized, targets, seed), block, epochs)
    keys = ["doc_id", "source", "size", "source_size", "target", "sid", "bucket", "rn"]
    return (
        part.select(*keys, "rank", "words")
        .join(drawn, ["sid", "rank"], "left")
        .groupBy(*keys)
        .agg(F.sum(F.col("words") * F.coalesce("hit", F.lit(0).cast("long"))).alias("taken"))
        .select("doc_id", "source", "size", "source_size", "target", "taken")
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mix takes, all columns kept: each as often as the words taken of it, over its size, round to."""
    keys = ["doc_id", "source", "size"]
    taken = mix(docs).groupBy(*keys).agg((F.sum("taken") / F.count("*")).alias("_taken")).withColumnsRenamed({c: f"_{c}" for c in keys})
    times = F.round(F.col("_taken") / F.greatest(F.col("_size"), F.lit(1))).cast("int")
    taken = pin(taken.select("_doc_id", "_source", "_size", times.alias("_times")).filter("_times > 0"), "mix-taken")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_doc"), F.col("source").alias("_from"), size.alias("_words"))
    same = F.col("_doc").eqNullSafe(F.col("_doc_id")) & F.col("_from").eqNullSafe(F.col("_source")) & (F.col("_words") == F.col("_size"))
    return sized.join(taken, same).withColumn("_again", F.explode(F.sequence(F.lit(1), "_times"))).select("_row.*")
