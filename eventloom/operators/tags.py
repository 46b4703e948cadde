"""Ranks, attribute phrases and unique tags of objects that share a scene.

A scene holds a handful of objects, so windows and arrays per scene are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import rotation as rot

# fixed values: phrase templates
FIRST = {
    "height": "the tallest %s",
    "area": "the %s with the largest area",
    "volume": "the %s with the largest volume",
    "position_from_left": "the %s that is closest to the robot's left at the start",
    "position_from_bottom": "the %s closest to the robot mounting edge at the start",
    "distance_from_robot": "the %s closest to the robot at the start",
    "velocity": "the moving %s with the highest initial velocity",
}
LAST = {
    "height": "the shortest %s",
    "area": "the %s with the smallest area",
    "volume": "the %s with the smallest volume",
    "position_from_left": "the %s that is closest to the robot's right at the start",
    "position_from_bottom": "the %s farthest from the robot mounting edge at the start",
    "distance_from_robot": "the %s farthest from the robot at the start",
    "velocity": "the moving %s with the lowest initial velocity",
}
MEDIUM = {
    "height": "the %s of medium height",
    "area": "the %s with medium area",
    "volume": "the %s with medium volume",
    "position_from_left": "the %s in the middle from left to right at the start",
    "position_from_bottom": "the %s with medium distance to the robot mounting edge at the start",
    "distance_from_robot": "the %s with medium distance to the robot at the start",
    "velocity": "the moving %s with medium initial velocity",
}
# fixed values: phrases for the direction of motion, and for none
DIRECTIONS = [
    "the %s moving in the robot's forward direction",
    "the %s moving in the robot's forward-left direction",
    "the %s moving in the robot's left direction",
    "the %s moving in the robot's backward-left direction",
    "the %s moving in the robot's backward direction",
    "the %s moving in the robot's backward-right direction",
    "the %s moving in the robot's right direction",
    "the %s moving in the robot's forward-right direction",
]
STILL = "stationary %s"
# fixed value: slower than this is standing still
MIN_SPEED = 0.01


def attributes(size: list[Column], pos: list[Column], base: list[Column], base_q: list[Column]) -> dict[str, Column]:
    rel = rot.rotate_inv(base_q, rot.sub(pos, base))
    return {
        "height": pos[2],
        "area": size[0] * size[1],
        "volume": size[0] * size[1] * size[2],
        "position_from_left": rel[1],
        "position_from_bottom": -rel[0],
        "distance_from_robot": -rot.norm(rot.sub(pos, base)),
    }


def tolerant_rank(df: DataFrame, keys: list[str], value: str, tie: str, tol: float, out: str = "rank") -> DataFrame:
    """Descending rank that only advances when a value lies further than ``tol`` from the one before it."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value), tie)
    i = F.row_number().over(w)
    gap = F.abs(F.col(value) - F.lag(value).over(w)) > tol
    d = df.withColumn("_i", i).withColumn("_at", F.when((F.col("_i") == 1) | gap, F.col("_i")))
    r = F.last("_at", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn(out, r.cast("int")).drop("_i", "_at")


def rank_phrase(kind: Column, rank: Column, n: Column, name: Column) -> Column:
    """Phrase of a rank among n objects; with two objects superlatives become comparatives."""
    def pick(table):
        e = F.lit(None).cast("string")
        for k, text in table.items():
            e = F.when(kind == k, F.lit(text)).otherwise(e)
        return e

    t = F.when(rank == 1, pick(FIRST)).when(rank == n, pick(LAST)).when((rank == 2) & (n == 3), pick(MEDIUM))
    t = F.replace(t, F.lit("%s"), name)
    return F.when(n == 2, F.replace(t, F.lit("est"), F.lit("er"))).otherwise(t)


def scene_tags(objects: DataFrame, keys: list[str], slot: str, name: Column, attrs: dict[str, Column], vel: list[Column], base_q: list[Column], tols: dict[str, float]) -> DataFrame:
    """All phrases of every object in scenes of two or more: (keys, slot, kind, tag)."""
    c = F.col
    speed = F.sqrt(vel[0] * vel[0] + vel[1] * vel[1] + vel[2] * vel[2])
    seen = rot.rotate_inv(base_q, vel)
    d = objects.select(*keys, slot, name.alias("_name"), speed.alias("_speed"), rot.direction_index(seen[0], seen[1]).alias("_dir"),
                       F.struct(*[v.alias(k) for k, v in attrs.items()]).alias("_a"))
    d = d.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(c("_n") > 1)
    rows = [F.struct(F.lit(k).alias("kind"), c(f"_a.{k}").alias("value"), F.lit(float(tols[k])).alias("tol")) for k in attrs]
    rows.append(F.struct(F.lit("velocity").alias("kind"), c("_speed").alias("value"), F.lit(float(tols["velocity"])).alias("tol")))
    r = d.withColumn("_r", F.explode(F.array(*rows))).select(*keys, slot, "_name", "_r.kind", "_r.value", "_r.tol")
    r = r.where((c("kind") != "velocity") | (c("value") >= MIN_SPEED))
    by = Window.partitionBy(*keys, "kind")
    w = by.orderBy(F.desc("value"), slot)
    r = r.withColumns({"_n": F.count(F.lit(1)).over(by), "_i": F.row_number().over(w), "_gap": F.abs(c("value") - F.lag("value").over(w)) > c("tol")})
    r = r.withColumn("_at", F.when((c("_i") == 1) | c("_gap"), c("_i")))
    r = r.withColumn("_rank", F.last("_at", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = r.select(*keys, slot, "kind", rank_phrase(c("kind"), c("_rank"), c("_n"), c("_name")).alias("tag")).where("tag IS NOT NULL")
    text = F.get(F.array(*[F.lit(t) for t in DIRECTIONS]), c("_dir"))
    text = F.when(c("_speed") < MIN_SPEED, F.lit(STILL)).otherwise(text)
    moving = d.select(*keys, slot, F.lit("direction").alias("kind"), F.replace(text, F.lit("%s"), c("_name")).alias("tag"))
    return ranked.unionByName(moving)


def unique_tags(tags: DataFrame, keys: list[str], slot: str, target: int = 0) -> DataFrame:
    """Tags that only the target object of a scene has."""
    g = tags.groupBy(*keys, "tag").agg(F.bool_or(F.col(slot) == target).alias("_t"), F.bool_or(F.col(slot) != target).alias("_o"))
    return g.where(F.col("_t") & ~F.col("_o")).select(*keys, "tag")


def attach_meta(objects: DataFrame, meta: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left join to object metadata; unknown objects get defaults and a flag."""
    j = objects.join(meta.withColumn("_known", F.lit(True)), key, "left")
    out = j.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})
    return out.withColumn("unknown", F.col("_known").isNull()).drop("_known")


def fastest(df: DataFrame, keys: list[str], speed: Column, pick: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(pick, F.struct(speed, -F.col(pick))).alias(pick), F.max(speed).alias("speed"))


# fixed values: target categories and speed ranges of the stratified plan
CATEGORIES = ["apple", "avocado", "beer", "bottle", "can", "cup", "egg", "kiwi", "lemon", "lime", "onion", "orange", "peach", "potato", "tangerine", "tomato"]
SPEED_BINS = [(0.15, 0.30), (0.30, 0.45), (0.45, 0.60), (0.60, 0.75)]


def stratified_plan(samples: DataFrame, index: str, variants: Column, seed_base: int = 0) -> DataFrame:
    """Category, asset variant, speed range and seed of every sample index."""
    i = F.col(index)
    k = len(CATEGORIES)
    bins = F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in SPEED_BINS])
    b = (i % len(SPEED_BINS)).cast("int")
    return samples.select(
        "*", (i % k).cast("int").alias("category_index"), F.get(F.array(*[F.lit(c) for c in CATEGORIES]), (i % k).cast("int")).alias("category"),
        (F.floor(i / k) % variants).cast("int").alias("variant"), b.alias("speed_bin"), F.get(bins, b)["lo"].alias("speed_lo"), F.get(bins, b)["hi"].alias("speed_hi"),
        (i + seed_base).alias("seed"))


def coverage(plan: DataFrame) -> DataFrame:
    """Counts per category and speed bin with their totals; a missing pair shows aliasing of the two."""
    return plan.cube("category", "speed_bin").agg(F.count(F.lit(1)).alias("n"))


def camera_rank(camera: Column, known: list[str]) -> Column:
    """Fixed cameras first in their order, all others after them (order by name next)."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(k) for k in known]), camera), F.lit(0)), F.lit(len(known) + 1)).cast("int")


def take_from(df: DataFrame, index: str, start: int, limit: int) -> DataFrame:
    """The first ``limit`` rows at or after an index, in order: the limit is the feature."""
    return df.where(F.col(index) >= start).orderBy(index).limit(limit)
