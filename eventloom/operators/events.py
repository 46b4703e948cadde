"""Event-stream operators: time rebasing, voxel keys and histograms, labels, statistics.

Events carry ``episode, camera, event_id, t_us, x, y, p`` and optional quality and label
columns. Times are integer microseconds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators import chunked
from eventloom.session import cut_lineage

SERIES = ["episode", "camera"]
ORDER = ["t_us", "event_id"]


# -- projections and filters ------------------------------------------------------------

def rebase_time(df: DataFrame, *origins: Column, out: str = "t_us") -> DataFrame:
    """Time relative to the first origin that is known, else 0."""
    return df.withColumn(out, F.col("t_us") - F.coalesce(*origins, F.lit(0)))


def frame_of(t_us: Column, frame_us: int, n_frames: Column | int) -> Column:
    """Frame holding an instant, held inside the episode."""
    n = n_frames if isinstance(n_frames, Column) else F.lit(n_frames)
    return F.least(F.greatest(F.floor(t_us / F.lit(frame_us)), F.lit(0)), n - 1).cast("long")


def bin_of(t_us: Column, bin_us: int) -> Column:
    return F.floor(t_us / F.lit(bin_us)).cast("long")


def inside(width: int, height: int) -> Column:
    x, y = F.col("x"), F.col("y")
    return (x >= 0) & (x < width) & (y >= 0) & (y < height)


def finite(*cols: str) -> Column:
    def one(c):
        c = F.col(c)
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))

    return reduce(lambda a, b: a & b, [one(c) for c in cols])


def scaled(c: str, out: int, src: int) -> Column:
    """Integer down-scaling of a coordinate."""
    return F.floor(F.col(c) * out / src).cast("int")


def on(p: str = "p") -> Column:
    return F.col(p) > 0


def event_weight(q_class: str) -> Column:
    keep = F.least(F.greatest(1 - F.col("q_illumination"), F.lit(0.0)), F.lit(1.0))
    return F.col(q_class) * keep


def squash(total: Column, clip: float) -> Column:
    """log1p of the clipped sum, scaled to [0, 1]; the plain sum when clip is 0."""
    if clip <= 0:
        return total
    return F.log1p(F.least(total, F.lit(float(clip)))) / F.log1p(F.lit(float(clip)))


# -- voxel histograms -------------------------------------------------------------------

def bin_sums(events: DataFrame, keys: list[str], bin_us: int, src: tuple[int, int], out: tuple[int, int],
             weights: dict[str, Column], t0_us: int = 0) -> DataFrame:
    """Weighted event sums per (keys, bin, polarity, oy, ox), one pass for all weightings."""
    (h, w), (oh, ow) = src, out
    return (
        events.where(inside(w, h))
        .select(
            *keys,
            bin_of(F.col("t_us") - t0_us, bin_us).alias("bin"),
            on().cast("int").alias("pol"),
            scaled("y", oh, h).alias("oy"),
            scaled("x", ow, w).alias("ox"),
            *[F.when(~F.isnan(v), v).alias(n) for n, v in weights.items()],
        )
        .groupBy(*keys, "bin", "pol", "oy", "ox")
        .agg(*[F.sum(n).alias(n) for n in weights])
    )


def class_weights() -> dict[str, Column]:
    return {"w_static": event_weight("q_static"), "w_dynamic": event_weight("q_dynamic")}


def voxel_history(sums: DataFrame, keys: list[str], bins: int, step: int, n_frames: int, clip: float,
                  weights: list[str], ahead: bool = False) -> DataFrame:
    """Voxels of the ``bins`` bins before (or after) every frame.

    Frame k starts at bin ``k*step``. Events were reduced to bins first, so each bin row is
    only copied to the ``ceil(bins/step)`` frames it belongs to; no join and no further
    aggregation is needed, and the clip stays exact because it applies per bin.
    """
    b = F.col("bin")
    if ahead:   # k*step <= b < k*step + bins
        lo, hi = F.floor((b - bins) / step) + 1, F.floor(b / step)
    else:       # k*step - bins <= b < k*step
        lo, hi = F.floor(b / step) + 1, F.floor((b + bins) / step)
    lo, hi = F.greatest(lo, F.lit(0)).cast("long"), F.least(hi, F.lit(n_frames - 1)).cast("long")
    first = F.col("frame_index") * step - (0 if ahead else bins)
    return (
        sums.where(lo <= hi)
        .withColumn("frame_index", F.explode(F.sequence(lo, hi)))
        .select(*keys, "frame_index", (b - first).cast("int").alias("t_bin"), "pol", "oy", "ox",
                *[squash(F.col(w), clip).alias(w) for w in weights])
    )


def future_activity(sums: DataFrame, keys, bins, step, n_frames) -> DataFrame:
    """Occupied cells after every frame in four channels: static OFF/ON, dynamic OFF/ON."""
    v = voxel_history(sums, keys, bins, step, n_frames, 1.0, ["w_static", "w_dynamic"], ahead=True)
    v = v.select(*keys, "frame_index", "t_bin", "oy", "ox", "pol",
                 F.explode(F.create_map(F.lit(0), F.col("w_static"), F.lit(2), F.col("w_dynamic"))).alias("base", "value"))
    return v.where(F.col("value") > 0).select(
        *keys, "frame_index", "t_bin", (F.col("base") + F.col("pol")).alias("channel"), "oy", "ox")


def patch_density(vox: DataFrame, keys: list[str], patch: int, out: tuple[int, int], value: str) -> DataFrame:
    """Mean absolute activity per full patch; both polarities add up."""
    ph, pw = out[0] // patch, out[1] // patch
    py, px = F.floor(F.col("oy") / patch).cast("int"), F.floor(F.col("ox") / patch).cast("int")
    return (
        vox.where((py < ph) & (px < pw))
        .groupBy(*keys, "t_bin", (py * pw + px).alias("patch_index"))
        .agg((F.sum(F.abs(value)) / (patch * patch)).alias("density"))
    )


def top_patches(dens: DataFrame, keys: list[str], k: int, floor: float = 1e-6) -> DataFrame:
    """The k densest patches per bin (ties: lower index first) with a validity mask."""
    w = Window.partitionBy(*keys, "t_bin").orderBy(F.desc("density"), "patch_index")
    return (
        dens.withColumn("rank", F.row_number().over(w).cast("long"))
        .where(F.col("rank") <= k)
        .withColumn("mask", F.col("density") > floor)
    )


def patch_tokens(dens: DataFrame, frames: DataFrame, keys: list[str], bins: int, k: int,
                 grid: tuple[int, int]) -> DataFrame:
    """Fixed-length rows per frame: one summary row, then ``bins * k`` patch rows.

    Every frame gets all its slots. Empty slots carry the lowest patch indices that are not
    already selected, as a top-k over a dense grid of zeros would, with mask false.
    """
    gh, gw = grid
    n = gh * gw
    sel = top_patches(dens, keys, k).groupBy(*keys, "t_bin").agg(
        F.sort_array(F.collect_list(F.struct("rank", "patch_index", "density", "mask"))).alias("got"))
    spine = frames.select(*keys).withColumn("t_bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = spine.join(sel, [*keys, "t_bin"], "left").withColumn(
        "got", F.coalesce("got", F.expr("filter(array(struct(0 AS rank, 0 AS patch_index, 0D AS density, false AS mask)), x -> false)")))
    rest = F.array_except(F.sequence(F.lit(0), F.lit(n - 1)), F.transform("got", lambda g: g["patch_index"]))
    slots = F.concat(
        F.transform("got", lambda g: F.struct(g["patch_index"].alias("patch_index"), g["density"].alias("density"))),
        F.transform(rest, lambda i: F.struct(i.alias("patch_index"), F.lit(0.0).alias("density"))),
        F.transform(F.array_repeat(F.lit(-1), k), lambda i: F.struct(i.alias("patch_index"), F.lit(0.0).alias("density"))),
    )
    rows = full.select(*keys, "t_bin", F.posexplode(F.slice(slots, 1, k)).alias("slot", "s")).select(
        *keys,
        (1 + F.col("t_bin") * k + F.col("slot")).cast("int").alias("token"),
        F.col("s.patch_index").alias("patch_index"),
        F.col("s.density").alias("density"),
        ((F.greatest(F.col("s.patch_index"), F.lit(0)) % gw + 0.5) / gw).alias("cx"),
        ((F.floor(F.greatest(F.col("s.patch_index"), F.lit(0)) / gw) + 0.5) / gh).alias("cy"),
        (F.col("s.density") > 1e-6).alias("mask"),
    )
    head = frames.select(*keys, F.lit(0).alias("token"), F.lit(-1).alias("patch_index"), F.lit(1.0).alias("density"),
                         F.lit(None).cast("double").alias("cx"), F.lit(None).cast("double").alias("cy"),
                         F.lit(True).alias("mask"))
    return head.unionByName(rows)


# -- range join -------------------------------------------------------------------------

def event_windows(frames: DataFrame, events: DataFrame, keys: list[str], before_us: int, after_us: int,
                  bucket_us: int, frame_t: str = "frame_t_us") -> DataFrame:
    """Frame x event pairs with ``frame_t - before <= t < frame_t + after``.

    Frames are copied to the time buckets they touch and joined by equality on
    (keys, bucket), then filtered exactly: an equi join instead of a nested loop.
    """
    t = F.col(frame_t)
    lo = F.floor((t - before_us) / bucket_us).cast("long")
    hi = F.floor((t + after_us - 1) / bucket_us).cast("long")
    f = frames.withColumn("_bucket", F.explode(F.sequence(lo, hi)))
    e = events.withColumn("_bucket", bin_of(F.col("t_us"), bucket_us))
    return (
        f.join(e, [*keys, "_bucket"])
        .where((F.col("t_us") >= t - before_us) & (F.col("t_us") < t + after_us))
        .drop("_bucket")
    )


# -- labels -----------------------------------------------------------------------------

def label_events(events: DataFrame, maps: DataFrame, frame_us: int, n_frames: int, cols: list[str]) -> DataFrame:
    """Read per-pixel maps at every event; an event outside the raster reads 0.

    Many events may hit one pixel, but (episode, camera, frame, y, x) spreads any hot
    camera over all its pixels, so the equi join needs no salt.
    """
    e = events.withColumn("frame_index", frame_of(F.col("t_us"), frame_us, n_frames))
    at = ["episode", "camera", "frame_index", "y", "x"]
    joined = e.join(maps.select(*at, *[F.col(c).alias(f"_m_{c}") for c in cols]), at, "left")
    return joined.select(*e.columns, *[F.coalesce(f"_m_{c}", F.lit(0)).alias(f"map_{c}") for c in cols])


def seg_class(seg: Column) -> Column:
    """Segmentation id -> class name used by the retention metrics."""
    return (
        F.when(seg.isin(0, 3), "background").when(seg == 1, "robot").when(seg == 2, "target").otherwise("other")
    )


# -- statistics -------------------------------------------------------------------------

def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL unless b > 0."""
    return F.when(b > 0, a / b)


def event_stats(events: DataFrame, keys: list[str], duration_us: int) -> DataFrame:
    t = F.col("t_us")
    n, n_on, n_off = F.count(F.lit(1)), F.count_if(F.col("p") > 0), F.count_if(F.col("p") < 0)
    return events.groupBy(*keys).agg(
        n.alias("events"),
        (n / (duration_us / 1e6)).alias("rate_per_s"),
        n_on.alias("on_events"),
        n_off.alias("off_events"),
        ratio(F.abs(n_on - n_off), n).alias("polarity_imbalance"),
        F.min(t).alias("t_min_us"),
        F.max(t).alias("t_max_us"),
        F.count_if((t >= 0) & (t <= duration_us)).alias("in_window"),
    )


def stream_totals(events: DataFrame, keys: list[str], camera: str, duration_us: int, size: Column) -> DataFrame:
    """Event statistics over all cameras of ``keys``, with bytes of storage per event (``size``: bytes of a row)."""
    n = F.count(F.lit(1))
    # one row per camera first, so that the cameras are counted without gathering them
    per = events.groupBy(*keys, camera).agg(n.alias("n"), F.count_if(F.col("p") > 0).alias("on"), F.sum(size).alias("bytes"))
    total = F.sum("n")
    return per.groupBy(*keys).agg(
        n.alias("cameras"), total.alias("events"), (total / (duration_us / 1e6)).alias("rate_per_s"), F.sum("on").alias("on_events"),
        F.sum("bytes").alias("bytes"), ratio(F.sum("bytes"), total).alias("bytes_per_event"))


def time_histogram(events: DataFrame, keys: list[str], bin_us: int, n_bins: int, series: DataFrame | None = None) -> DataFrame:
    """Counts per fixed bin with empty bins; the last edge is closed.

    ``series`` lists the keys that must appear (default: those with events).
    """
    t = F.col("t_us")
    b = F.when(t == bin_us * n_bins, F.lit(n_bins - 1)).otherwise(F.floor(t / bin_us)).cast("long")
    got = events.withColumn("bin", b).where((F.col("bin") >= 0) & (F.col("bin") < n_bins))
    got = got.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    who = series if series is not None else events.select(*keys).distinct()
    spine = who.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bins - 1).cast("long"))))
    return spine.join(got, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def bin_spread(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Coefficient of variation of bin counts."""
    return hist.groupBy(*keys).agg(ratio(F.stddev_pop("n"), F.avg("n")).alias("count_cv"))


def phase_imbalance(hist: DataFrame, keys: list[str], phases: int = 4) -> DataFrame:
    """Mean count per bin phase and the largest over the smallest of them."""
    m = hist.groupBy(*keys, (F.col("bin") % phases).alias("phase")).agg(F.avg("n").alias("m"))
    return m.groupBy(*keys).agg(
        *[F.max(F.when(F.col("phase") == i, F.col("m"))).alias(f"phase_{i}") for i in range(phases)],
        ratio(F.max("m"), F.min("m")).alias("phase_imbalance"),
    )


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], width: float, levels: int = 2) -> DataFrame:
    """Exact linearly interpolated quantiles of ``value`` per key as columns ``q0, q1, ...``.

    ``percentile`` would hold a key's distinct values in one buffer. Here one pass counts the
    distinct values of each key (combined map-side), and that table of counts, written once,
    stands for the input from then on: its rows are added up per cell of ``width`` to find
    the cell of every wanted rank, then only in those cells per cell 4,096 times finer;
    only what falls into the last cells is ordered. So the input is read once whatever the
    number of levels and of quantiles, and neither a hot key nor a pile-up of values in one
    cell is sorted as a whole.
    """
    names = [f"_c{i}" for i in range(levels)]
    v = F.col(value)
    src = df.where(v.isNotNull() & ~F.isnan(value)).groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
    src = cut_lineage(src, "value-counts").withColumns({n: F.floor(F.col("_v") / F.lit(width / 4096.0**i)).cast("long") for i, n in enumerate(names)})
    c = F.col
    rank = ["_i", "_hi", "_frac", "_r"]
    hist = src.groupBy(*keys, names[0]).agg(F.sum("_k").alias("_k"))
    w = Window.partitionBy(*keys)
    hist = hist.withColumns({"_before": F.sum("_k").over(w.orderBy(names[0]).rowsBetween(Window.unboundedPreceding, 0)) - c("_k"), "_n": F.sum("_k").over(w)})
    ranks = []
    for q, p in enumerate(probs):
        pos = F.lit(p) * (c("_n") - 1)
        ranks += [F.struct(F.lit(q).alias("_i"), F.lit(hi).alias("_hi"), (pos - F.floor(pos)).alias("_frac"), (F.ceil(pos) if hi else F.floor(pos)).alias("_r")) for hi in (False, True)]
    want = hist.withColumn("_w", F.explode(F.array(*ranks))).select(*keys, names[0], "_k", "_before", "_w.*")
    for i in range(1, levels + 1):
        # the cells, at last the values, that hold the wanted ranks; a wanted rank goes its own way, so that each level is used once
        r = c("_r") - c("_before")
        want = want.where((r >= 0) & (r < c("_k"))).select(*keys, *names[:i], "_i", "_hi", "_frac", r.alias("_r"))
        at = names[i] if i < levels else "_v"
        rows = src.select(*keys, *names[:i], at, "_k").join(want, [*keys, *names[:i]])
        if i < levels:
            rows = rows.groupBy(*keys, *names[:i], *rank, at).agg(F.sum("_k").alias("_k"))
        upto = Window.partitionBy(*keys, *names[:i], *rank).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
        want = rows.withColumn("_before", F.sum("_k").over(upto) - c("_k"))
    hit = want.where((c("_r") >= c("_before")) & (c("_r") < c("_before") + c("_k")))
    aggs = []
    for i in range(len(probs)):
        lo, hi = (F.max(F.when((c("_i") == i) & (c("_hi") == F.lit(h)), c("_v"))) for h in (False, True))
        aggs.append((lo + (hi - lo) * F.max(F.when(c("_i") == i, c("_frac")))).alias(f"q{i}"))
    return hit.groupBy(*keys).agg(*aggs)


def label_fractions(events: DataFrame, keys: list[str], thr: float) -> DataFrame:
    """Share of events at or above the threshold per label; share of motion the light gate removed."""
    share = lambda c: F.avg((F.col(c) >= thr).cast("int"))
    motion = F.avg((F.col("q_motion") >= thr).cast("int"))
    lost = F.avg(((F.col("q_motion") >= thr) & ~(F.col("q_dynamic") >= thr)).cast("int"))
    return events.groupBy(*keys).agg(
        motion.alias("motion_fraction"),
        share("q_static").alias("static_fraction"),
        share("q_dynamic").alias("dynamic_fraction"),
        share("q_illumination").alias("illumination_fraction"),
        (lost / F.greatest(motion, F.lit(1e-12))).alias("rejected_motion_fraction"),
    )


def gate_retention(events: DataFrame, keys: list[str], thr: float) -> DataFrame:
    """Per class: candidates and retained share before and after the gate, and the removed share."""
    before, after = F.col("q_motion") >= thr, F.col("q_dynamic") >= thr
    n, cand, kept = F.count(F.lit(1)), F.count_if(before), F.count_if(after)
    one = F.lit(1)
    return events.groupBy(*keys, "cls").agg(
        n.alias("events"),
        (cand / F.greatest(n, one)).alias("candidate_retention"),
        (kept / F.greatest(n, one)).alias("dynamic_retention"),
        ((cand - kept) / F.greatest(cand, one)).alias("removed_from_motion"),
    )


def pixel_counts(events: DataFrame, frame_us: int) -> DataFrame:
    """Events and summed quality per pixel and frame interval."""
    return (
        events.where(F.col("t_us") >= 0)
        .withColumn("frame_index", bin_of(F.col("t_us"), frame_us))
        .groupBy("episode", "camera", "frame_index", "y", "x")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("wq"))
    )


def occupied(events: DataFrame, keys: list[str], px: int, bin_us: int, duration_us: int) -> DataFrame:
    """Distinct occupied (t, y, x, polarity) cells."""
    t = F.col("t_us")
    return (
        events.where((t >= 0) & (t <= duration_us))
        .select(*keys, bin_of(t, bin_us).alias("tb"), F.floor(F.col("y") / px).cast("int").alias("cy"),
                F.floor(F.col("x") / px).cast("int").alias("cx"), on().alias("pol"))
        .distinct()
    )


def voxel_agreement(a: DataFrame, b: DataFrame, keys: list[str], configs: list[tuple[int, int]], duration_us: int) -> DataFrame:
    """Occupied-cell precision, recall and F1 of run b against run a at each resolution.

    Both runs and all resolutions go through one aggregation on the cell key.
    """
    def cells(df, side):
        conf = F.explode(F.array(*[F.struct(F.lit(p).alias("px"), F.lit(u).cast("long").alias("bin_us")) for p, u in configs]))
        t = F.col("t_us")
        d = df.where((t >= 0) & (t <= duration_us)).withColumn("c", conf)
        return d.select(
            *keys, F.col("c.px").alias("px"), F.col("c.bin_us").alias("bin_us"),
            F.floor(t / F.col("c.bin_us")).cast("long").alias("tb"),
            F.floor(F.col("y") / F.col("c.px")).cast("int").alias("cy"),
            F.floor(F.col("x") / F.col("c.px")).cast("int").alias("cx"), on().alias("pol"),
            F.lit(side == "a").alias("in_a"), F.lit(side == "b").alias("in_b"))

    cell = cells(a, "a").unionByName(cells(b, "b")).groupBy(*keys, "px", "bin_us", "tb", "cy", "cx", "pol").agg(
        F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    g = cell.groupBy(*keys, "px", "bin_us").agg(
        F.count_if("in_a").alias("occupied_a"), F.count_if("in_b").alias("occupied_b"),
        F.count_if(F.col("in_a") & F.col("in_b")).alias("common"))
    pr, rc = ratio(F.col("common"), F.col("occupied_b")), ratio(F.col("common"), F.col("occupied_a"))
    g = g.withColumns({"precision": pr, "recall": rc})
    return g.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def stream_checks(events: DataFrame, keys: list[str], width: int, height: int, t_max_us: int) -> DataFrame:
    """One row per stream with the number of violations of each rule."""
    x, y, t = F.col("x"), F.col("y"), F.col("t_us")
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if((x < 0) | (x >= width)).alias("bad_x"),
        F.count_if((y < 0) | (y >= height)).alias("bad_y"),
        F.count_if(t < 0).alias("before_origin"),
        F.count_if(t > t_max_us).alias("after_end"),
        F.count_if(~F.col("p").isin(-1, 1)).alias("bad_polarity"),
        F.count_if((F.col("q") < 0) | (F.col("q") > 1)).alias("bad_quality"),
        F.count_if(x.isNull() | y.isNull() | t.isNull() | F.col("p").isNull()).alias("missing_fields"),
    )


def non_monotonic(events: DataFrame, keys: list[str], by: str, width) -> DataFrame:
    """Per stream: adjacent pairs in ``by`` order whose time steps back."""
    d = chunked.prev_value(events.select(*keys, by, "t_us"), keys, [by], {"prev_t": F.col("t_us")}, width)
    return d.groupBy(*keys).agg(F.count_if(F.col("t_us") < F.col("prev_t")).alias("steps_back"),
                                F.count(F.lit(1)).alias("events"))


def runs(events: DataFrame, keys: list[str], order: list[str], key: Column, width) -> DataFrame:
    """Contiguous runs of equal ``key`` in order: start, end, length."""
    d = chunked.with_chunk(events.select(*keys, *order, key.alias("run_key")), keys, order, width)
    d = chunked.prev_value(d, keys, order, {"_p": F.col("run_key"), "_has": F.lit(True)}, width)
    d = d.withColumn("_new", F.when(F.col("_has").isNull() | ~F.col("_p").eqNullSafe(F.col("run_key")), 1).otherwise(0))
    d = chunked.running_sum(d, keys, order, {"run": F.col("_new")}, width)
    return d.groupBy(*keys, "run").agg(
        F.first("run_key").alias("run_key"), F.min(order[0]).alias("t_first"), F.max(order[0]).alias("t_last"),
        F.count(F.lit(1)).alias("n"))


def harmonic_power(events: DataFrame, keys: list[str], bin_us: int, n_bins: int, bin_s: float, line_hz: float = 25.0,
                   lo_hz: float = 5.0, hi_hz: float = 250.0, band_hz: float = 0.75, near_hz: float = 5.0,
                   guard_hz: float = 1.5) -> DataFrame:
    """Spectral power of the count signal: share on harmonics of ``line_hz`` and the line in dB.

    Spark reduces the events to counts per bin first; what reaches one task is the count
    signal of one series, whose length ``n_bins`` is set by the duration, not by the events.
    """
    t = F.col("t_us")
    b = F.when(t == bin_us * n_bins, F.lit(n_bins - 1)).otherwise(F.floor(t / bin_us)).cast("long")
    hist = events.select(*keys, b.alias("bin")).where((F.col("bin") >= 0) & (F.col("bin") < n_bins))
    hist = hist.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    schema = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in keys)

    def spectrum(pdf):
        import numpy as np
        import pandas as pd

        counts = np.zeros(n_bins)
        counts[pdf["bin"].to_numpy()] = pdf["n"].to_numpy()
        signal = counts - counts.mean()
        share = line_db = 0.0
        if n_bins >= 4 and signal.any():
            power = np.abs(np.fft.rfft(signal * np.hanning(n_bins))) ** 2
            hz = np.arange(power.size) / (n_bins * bin_s)
            band = (hz >= lo_hz) & (hz <= hi_hz)
            k = np.maximum(np.rint(hz / line_hz), 1) * line_hz
            line = band & (np.abs(hz - k) <= band_hz) & (k <= hi_hz)
            share = power[line].sum() / power[band].sum() if power[band].sum() > 0 else np.nan
            d = np.abs(hz - line_hz)
            at, local = power[d <= band_hz], power[(d <= near_hz) & (d >= guard_hz)]
            line_db = 10 * np.log10(((at.mean() if at.size else 0) + 1e-12)
                                    / ((np.median(local) if local.size else 0) + 1e-12))
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in keys},
                             "harmonic_power_ratio": [share], "line_db": [line_db]})

    out = hist.groupBy(*keys).applyInPandas(spectrum, f"{schema}, harmonic_power_ratio double, line_db double")
    return out.withColumn("harmonic_power_ratio", F.when(~F.isnan("harmonic_power_ratio"), F.col("harmonic_power_ratio")))
