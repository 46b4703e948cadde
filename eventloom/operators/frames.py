"""Trajectory operators on frame tables keyed by (episode, frame_index)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import rotation as rot
from eventloom.functions import vectors as vec
from eventloom.operators import chunked

def _k() -> Column:
    return F.col("frame_index")


# -- selection --------------------------------------------------------------------------

def exclude_failures(samples: DataFrame) -> DataFrame:
    """Drops samples known to have failed; unknown outcomes stay."""
    return samples.where(~F.col("success").eqNullSafe(F.lit(False)))


def only_present(samples: DataFrame, files: DataFrame, key: str) -> DataFrame:
    return samples.join(files.select(key), key, "left_semi")


def assign_split(samples: DataFrame, every: int, mode: str = "index", index: str = "sample_index", width: int = 100_000) -> DataFrame:
    """``ml_split``: an explicit train/test label wins, else every n-th sample is test.

    ``index`` counts by the stable sample index, ``position`` by rank among the given rows
    and ``thousand`` tests ``index % 1000 == 0``.
    """
    i = F.col(index)
    if mode == "position":
        samples = chunked.positions(samples.withColumn("_one", F.lit(1)), ["_one"], [index], width, "_pos").drop("_one")
        i = F.col("_pos")
    is_test = i % 1000 == 0 if mode == "thousand" else (i + 1) % every == 0
    rule = F.when(is_test, "test").otherwise("train")
    if "split" in samples.columns and mode == "index":
        rule = F.when(F.col("split").isin("train", "test"), F.col("split")).otherwise(rule)
    return samples.withColumn("ml_split", rule).drop("_pos")


# -- outcomes ---------------------------------------------------------------------------

def label_outcome(frames: DataFrame, keys: list[str], lift: float = 0.10, fall: float = 0.05) -> DataFrame:
    """Success when the gripper closed and the object was lifted; else the failure reason."""
    closed = F.col("gripper") < 0
    dist = rot.norm(rot.sub(rot.cols("ee_x", "ee_y", "ee_z"), rot.cols("obj_x", "obj_y", "obj_z")))
    a = frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if(closed).alias("close_frames"),
        F.min(F.when(closed, _k())).alias("first_close"),
        F.min(dist).alias("min_distance"),
        F.min_by("obj_z", _k()).alias("z_first"),
        F.max_by("obj_z", _k()).alias("z_last"),
        F.max("obj_z").alias("z_max"),
    )
    raised = F.col("z_max") - F.col("z_first")
    ok = (F.col("close_frames") > 0) & (raised >= lift)
    return a.select(
        "*",
        raised.alias("lift"),
        ok.alias("success"),
        F.when(ok, "grasp_success")
        .when(F.col("z_last") < F.col("z_first") - fall, "object_fell")
        .when(F.col("close_frames") == 0, "missed_object_or_timeout")
        .otherwise("grasp_failed")
        .alias("reason"),
    )


def is_picked(obj, ee, goal, base, base_q, tol: float) -> Column:
    """Object in the gripper and gripper at the goal, seen from the base."""
    at_goal = rot.norm(rot.sub(goal, rot.rotate_inv(base_q, rot.sub(ee, base))))
    return (rot.norm(rot.sub(ee, obj)) < tol) & (at_goal < tol)


def box_axes(size, obj_q, base_q) -> list[list[Column]]:
    """The three edge vectors of a box as seen from the base."""
    zero = F.lit(0.0)
    edges = [[size[0], zero, zero], [zero, size[1], zero], [zero, zero, size[2]]]
    return [rot.rotate_inv(base_q, rot.rotate(obj_q, e)) for e in edges]


def is_placed(pos, box, container_pos, container_box, tol: float = 0.015) -> Column:
    """Object centre within the container's horizontal axes and its bottom below the rim."""
    half = [[c / 2 + tol for c in axis] for axis in container_box]
    rel = rot.sub(pos, container_pos)
    within = []
    for axis in half[:2]:
        length = rot.norm(axis)
        along = (axis[0] * rel[0] + axis[1] * rel[1] + axis[2] * rel[2]) / length
        within.append(F.abs(along) <= length)
    low = pos[2] - reduce(lambda a, b: a + b, [F.abs(e[2] / 2) for e in box])
    rim = container_pos[2] + reduce(lambda a, b: a + b, [F.abs(e[2]) for e in half])
    return within[0] & within[1] & (low <= rim)


def drop_and_reach(objects: DataFrame, keys: list[str], min_height: float, max_reach: float) -> DataFrame:
    """Per scene: did any object fall below a height, is any out of reach (each on its own norm)."""
    r = rot.norm(rot.cols("px", "py", "pz"))
    return objects.groupBy(*keys).agg(F.bool_or(F.col("pz") < min_height).alias("dropped"), F.bool_or(r > max_reach).alias("unreachable"))


def early_motion(frames: DataFrame, keys: list[str], n: int = 25) -> DataFrame:
    """Per episode: did the object stop, or change direction, within the first n frames."""
    vx, vy = F.col("vel_x"), F.col("vel_y")
    speed = F.sqrt(vx * vx + vy * vy)
    f = frames.where(_k() < n).withColumns({"_s": speed, "_d": rot.direction_index(vx, vy)})
    g = f.groupBy(*keys).agg(
        F.min_by("_s", _k()).alias("_s0"), F.min_by("_d", _k()).alias("_d0"), F.min("_s").alias("_smin"),
        F.min("_d").alias("_dmin"), F.max("_d").alias("_dmax"))
    return g.select(*keys, ((F.col("_s0") > 0.01) & (F.col("_smin") < 0.01)).alias("stopped"),
                    ((F.col("_dmin") != F.col("_d0")) | (F.col("_dmax") != F.col("_d0"))).alias("turned"))


def drop_direction_tags(tags: Column, turned: Column) -> Column:
    return F.when(turned, F.filter(tags, lambda t: ~t.endswith(" direction"))).otherwise(tags)


# -- windows over frames ----------------------------------------------------------------

def action_chunk(frames: DataFrame, keys: list[str], horizon: int, action: str, block: int = 4096) -> DataFrame:
    """The next ``horizon`` actions of every frame; the last one repeats, with a padding mask.

    Frames are cut into blocks and the first ``horizon - 1`` of a block are also copied to
    the block before, so no task ever holds a whole episode.
    """
    if block < horizon:
        raise ValueError("block must not be shorter than the horizon")
    b = F.floor(_k() / block).cast("long")
    halo = (_k() % block < horizon - 1) & (b > 0)
    d = frames.withColumn("_b", F.explode(F.when(halo, F.array(b, b - 1)).otherwise(F.array(b))))
    w = Window.partitionBy(*keys, "_b").orderBy("frame_index").rowsBetween(0, horizon - 1)
    d = d.withColumn("_got", F.collect_list(action).over(w)).where(F.col("_b") == b)
    n = F.size("_got")
    return d.select(
        *frames.columns,
        F.concat("_got", F.array_repeat(F.element_at("_got", -1), F.lit(horizon) - n)).alias("chunk"),
        F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda i: i >= n).alias("is_pad"),
    )


def history(frames: DataFrame, keys: list[str], deltas: list[int], cols: list[str]) -> DataFrame:
    """Rows at relative offsets, held inside the episode, with a padding flag.

    Both sides hash on (episode, frame), so a very long episode spreads evenly.
    """
    left = frames.select(*keys, "frame_index")
    if max(deltas) > 0:
        left = left.join(frames.groupBy(*keys).agg(F.max("frame_index").alias("_last")), keys)
        hi = F.col("_last")
    else:
        hi = _k()
    left = left.withColumn("delta", F.explode(F.array(*[F.lit(d) for d in deltas])))
    want = _k() + F.col("delta")
    left = left.withColumn("_at", F.least(F.greatest(want, F.lit(0)), F.greatest(hi, F.lit(0))))
    left = left.withColumn("is_pad", (want < 0) | (want > hi)).drop("_last")
    right = frames.select(*keys, _k().alias("_at"), *cols)
    return left.join(right, [*keys, "_at"]).select(*keys, "frame_index", "delta", F.col("_at").alias("at_frame"), "is_pad", *cols)


def future_pair(k: Column, steps: int, bin_s: float, fps: float, n: Column) -> dict[str, Column]:
    """Left and right frame, blend weight and validity at a horizon between frames."""
    pos = k + F.lit(steps * bin_s * fps)
    lo, hi = F.floor(pos), F.ceil(pos)
    valid = hi < n
    hold = lambda c: F.least(F.greatest(c, F.lit(0)), n - 1).cast("long")
    return {"left": hold(lo), "right": hold(hi), "alpha": F.when(valid, pos - lo).otherwise(F.lit(0.0)), "valid": valid}


def future_blend(frames: DataFrame, keys: list[str], steps: int, bin_s: float, fps: float, value: str) -> DataFrame:
    """Value blended between the two frames around the horizon."""
    n = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    f = frames.select(*keys, "frame_index").join(n, keys)
    f = f.withColumns(future_pair(_k(), steps, bin_s, fps, F.col("_n"))).drop("_n")
    a = frames.select(*keys, _k().alias("left"), F.col(value).alias("_a"))
    b = frames.select(*keys, _k().alias("right"), F.col(value).alias("_b"))
    j = f.join(a, [*keys, "left"]).join(b, [*keys, "right"])
    return j.select(*keys, "frame_index", "left", "right", "alpha", "valid",
                    ((1 - F.col("alpha")) * F.col("_a") + F.col("alpha") * F.col("_b")).alias("blended"))


def match_nearest(wanted: DataFrame, frames: DataFrame, keys: list[str], t: str, fps: float, tol: float) -> DataFrame:
    """Frame nearest to a wanted time, with a flag whether it lies within the tolerance."""
    n = frames.groupBy(*keys).agg(F.max("frame_index").alias("_last"))
    w = wanted.join(n, keys)
    at = F.least(F.greatest(F.rint(F.col(t) * fps).cast("long"), F.lit(0)), F.col("_last"))
    w = w.withColumn("_at", at).drop("_last")
    f = frames.select(*keys, _k().alias("_at"), F.col("timestamp").alias("_ts"))
    return w.join(f, [*keys, "_at"]).withColumns({"matched": F.col("_at"), "within": F.abs(F.col("_ts") - F.col(t)) < tol}).drop("_at", "_ts")


def locate(wanted: DataFrame, episodes: DataFrame, bucket: int = 4096, width: int = 100_000) -> DataFrame:
    """Global row index -> (episode, frame) over episodes laid end to end by ``episode``.

    Running totals come from chunk sums; each episode is listed under the index buckets it
    covers, so the lookup is an equi join.
    """
    e = chunked.running_sum(episodes.withColumn("_one", F.lit(1)), ["_one"], ["episode"], {"_end": F.col("n")}, width)
    e = e.select("episode", (F.col("_end") - F.col("n")).alias("_start"), "_end").where("_end > _start")
    e = e.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_start") / bucket), F.floor((F.col("_end") - 1) / bucket))))
    w = wanted.withColumn("_b", F.floor(F.col("row_index") / bucket))
    j = w.join(e, "_b").where((F.col("row_index") >= F.col("_start")) & (F.col("row_index") < F.col("_end")))
    return j.select(*wanted.columns, "episode", (F.col("row_index") - F.col("_start")).alias("frame_index"))


def step_norm(df: DataFrame, keys: list[str], order: str, pos: list[str], width, out: str = "step") -> DataFrame:
    """Distance to the previous row of the series (NULL on the first)."""
    d = chunked.prev_value(df, keys, [order], {f"_p{i}": F.col(c) for i, c in enumerate(pos)}, width)
    d = d.withColumn(out, rot.norm([F.col(c) - F.col(f"_p{i}") for i, c in enumerate(pos)]))
    return d.drop(*[f"_p{i}" for i in range(len(pos))])


def timebase_ok(frames: DataFrame, keys: list[str], fps: float, width: int = 4096) -> DataFrame:
    """Does frame k carry time k / fps (absolute and relative tolerance)?"""
    d = chunked.positions(frames.select(*keys, "frame_index", "timestamp"), keys, ["frame_index"], width, "_k")
    return d.groupBy(*keys).agg(F.bool_and(vec.allclose(F.col("timestamp"), F.col("_k") / F.lit(float(fps)))).alias("ok"))


# -- statistics -------------------------------------------------------------------------

def vector_stats(df: DataFrame, column: str, dim: int, keys: list[str] | None = None, floor: float | None = 1e-6) -> DataFrame:
    """Per-dimension mean, population std, min, max and count, in one aggregation without exploding."""
    keys = keys or []
    item = lambda i: F.col(column)[i]
    aggs = [
        F.struct(F.lit(i).alias("dim"), F.avg(item(i)).alias("mean"), F.stddev_pop(item(i)).alias("std"),
                 F.min(item(i)).alias("min"), F.max(item(i)).alias("max"), F.count(item(i)).alias("n")).alias(f"s{i}")
        for i in range(dim)
    ]
    out = df.groupBy(*keys).agg(*aggs).select(*keys, F.inline(F.array(*[F.col(f"s{i}") for i in range(dim)])))
    return out if floor is None else out.withColumn("std", F.greatest("std", F.lit(floor)))


def merge_stats(stats: DataFrame) -> DataFrame:
    """Count-weighted merge of per-part statistics (parallel variance)."""
    n, m, s = F.col("n"), F.col("mean"), F.col("std")
    g = stats.groupBy("dim").agg(
        F.sum(n).alias("n"), F.sum(n * m).alias("_s"), F.sum(n * (s * s + m * m)).alias("_q"),
        F.min("min").alias("min"), F.max("max").alias("max"))
    mean = F.col("_s") / F.col("n")
    return g.select("dim", mean.alias("mean"), F.sqrt(F.greatest(F.col("_q") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"), "min", "max", "n")


def fix_zero_std(stats: DataFrame) -> DataFrame:
    """A dimension that is constantly zero gets std 1. Apply before any floor on std."""
    return stats.withColumn("std", F.when((F.abs("mean") < 1e-6) & (F.abs("std") < 1e-6), F.lit(1.0)).otherwise(F.col("std")))


def stat_vectors(stats: DataFrame, dim: int) -> DataFrame:
    """Fold a stats table into one row of mean and std vectors (dim entries, for a scalar subquery)."""
    at = lambda c, i: F.max(F.when(F.col("dim") == i, F.col(c)))
    return stats.agg(F.struct(F.array(*[at("mean", i) for i in range(dim)]).alias("mean"),
                              F.array(*[at("std", i) for i in range(dim)]).alias("std")).alias("s"))


def consistency(a: DataFrame, b: DataFrame, keys: list[str], cols: list[str], by: list[str]) -> DataFrame:
    """Exact equality of two recordings per group; a row missing on one side breaks it.

    Columns are numbers, or arrays of numbers, whose error is the mean over their elements.
    """
    left = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in cols], F.lit(True).alias("_a"))
    right = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in cols], F.lit(True).alias("_b"))
    j = left.join(right, keys, "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    aggs = [F.count_if(~both).alias("unmatched")]
    for c in cols:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        error = F.abs(x - y)
        if a.schema[c].dataType.typeName() == "array":
            error = F.aggregate(F.zip_with(x, y, lambda p, q: F.abs(p - q)), F.lit(0.0), lambda s, d: s + d) / F.size(x)
        aggs += [F.bool_and(both & x.eqNullSafe(y)).alias(f"{c}_exact"), F.avg(error).alias(f"{c}_mae"),
                 F.avg(F.when(both, x.eqNullSafe(y).cast("int"))).alias(f"{c}_equal_share")]
    return j.groupBy(*by).agg(*aggs)


def trial_stats(steps: DataFrame, trials: list[str], env: str, order: str, pos: list[str], action: Column, width) -> DataFrame:
    """Per environment: trials, success rate, mean steps, actions and path length."""
    d = step_norm(steps, trials, order, pos, width, "_move")
    t = d.groupBy(env, *trials).agg(
        F.count(F.lit(1)).alias("steps"), F.count_if(action).alias("actions"),
        F.coalesce(F.sum("_move"), F.lit(0.0)).alias("path"), F.bool_or("success").alias("success"))
    return t.groupBy(env).agg(
        F.count(F.lit(1)).alias("n_tests"), F.avg(F.col("success").cast("int")).alias("success_rate"),
        F.avg("steps").alias("avg_steps"), F.avg("actions").alias("avg_actions"), F.avg("path").alias("avg_path_length"))


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("weighted_mean"))


# -- message logs -----------------------------------------------------------------------

def segments(log: DataFrame, keys: list[str], order: list[str], is_start: Column, is_end: Column, width) -> DataFrame:
    """Rows inside open segments: a start message opens (and belongs to) one, an end message closes it."""
    mark = F.when(is_start, F.lit(1)).when(is_end, F.lit(0))
    d = chunked.with_chunk(log, keys, order, width)
    d = chunked.running_sum(d, keys, order, {"segment": F.when(is_start, 1).otherwise(0)}, width)
    d = chunked.carry_last(d, keys, order, {"_open": mark}, width)
    return d.where(F.col("_open") == 1).drop("_open", chunked.CHUNK)


def usable_steps(seg: DataFrame, keys: list[str], order: list[str], required: list[str], skip: int, width) -> DataFrame:
    """Rows that carry every required input, less the first ``skip`` of each segment."""
    ok = seg.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in required]))
    d = chunked.positions(ok, [*keys, "segment"], order, width, "_n")
    return d.where(F.col("_n") >= skip).drop("_n")


def flatten_steps(records: DataFrame, step: str, envs: str, fields: list[str]) -> DataFrame:
    """Nested step records -> one row per (environment, step); fields absent from a record stay NULL."""
    kinds = records.schema[envs].dataType.elementType
    have = set(kinds.fieldNames())
    e = records.select(step, F.posexplode(envs).alias("env", "_r"))
    return e.select("env", step, *[(F.col(f"_r.{f}") if f in have else F.lit(None)).alias(f) for f in fields])


def replay(frames: DataFrame, keys: list[str], n: int, action: str, state: str) -> DataFrame:
    """Each step uses the chunk asked for at the last multiple of n; state refreshes there too."""
    anchor = (F.floor(_k() / n) * n).cast("long")
    f = frames.select(*keys, "frame_index", anchor.alias("anchor"), (_k() % n).cast("int").alias("offset"), action)
    s = frames.select(*keys, _k().alias("anchor"), F.col(state).alias("_state"))
    return f.join(s, [*keys, "anchor"]).select(*keys, "frame_index", "anchor", "offset", vec.undelta(F.col(action), F.col("_state")).alias("action"))


def merge_chunks(rows: DataFrame, keys: list[str], step: str, chunk: str, value: str) -> DataFrame:
    """Overlapping chunks: per step the newest chunk wins; steps before the chunk was asked for are dropped."""
    return (rows.where(F.col(step) >= F.col(chunk)).groupBy(*keys, step)
            .agg(F.max(chunk).alias("from_chunk"), F.max_by(value, chunk).alias(value)))


def latest_by_key(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    best = F.max(F.struct(*order, *cols)).alias("_m")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_m.{c}").alias(c) for c in dict.fromkeys([*order, *cols])])
