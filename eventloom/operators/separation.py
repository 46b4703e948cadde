"""Motion and lighting separation on pixel tables, its calibration and its evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import light
from eventloom.operators import events as ev
from eventloom.operators import pixels as px
from eventloom.session import cut_lineage

RUN, FRAME, PIXEL = px.RUN, px.FRAME, px.PIXEL


# -- calibration ------------------------------------------------------------------------

def motion_candidates(pixels: DataFrame, cams: DataFrame, width: int, height: int, keep: Column | None = None) -> DataFrame:
    """Observed (each offset and sign) against predicted motion on valid, edge-free pixels."""
    e = px.ego_flow(pixels, cams, width, height)
    e = px.depth_edge(e, radii=(1,))
    w = px._series()
    nxt = F.lead(F.struct("frame_index", "mvx", "mvy")).over(w)
    e = e.withColumn("_n", nxt)
    adj = F.col("_n.frame_index") == F.col("frame_index") + 1
    e = e.where(F.col("valid") & ~F.col("edge1"))
    if keep is not None:
        e = e.where(keep)
    here = F.struct(F.lit(0).alias("offset"), F.col("mvx").alias("mx"), F.col("mvy").alias("my"))
    then = F.struct(F.lit(1).alias("offset"), F.when(adj, F.col("_n.mvx")).otherwise(F.col("mvx")).alias("mx"),
                    F.when(adj, F.col("_n.mvy")).otherwise(F.col("mvy")).alias("my"))
    e = e.select(*PIXEL, "ego_x", "ego_y", F.explode(F.array(here, then)).alias("o"))
    e = e.withColumn("sign", F.explode(F.array(F.lit(-1.0), F.lit(1.0))))
    return e.select(*RUN, F.col("o.offset").alias("offset"), "sign", "ego_x", "ego_y",
                    (F.col("sign") * F.col("o.mx")).alias("ox"), (F.col("sign") * F.col("o.my")).alias("oy"))


CAND = [*RUN, "offset", "sign"]


def _error(scale: Column) -> Column:
    dx, dy = scale * F.col("ox") - F.col("ego_x"), scale * F.col("oy") - F.col("ego_y")
    return F.sqrt(dx * dx + dy * dy)


def _best(scored: DataFrame) -> DataFrame:
    best = F.min_by(F.struct("offset", "sign", "scale", "median_error", "p90_error"), F.struct("median_error", "offset", "sign")).alias("b")
    return scored.groupBy(*RUN).agg(best).select(*RUN, "b.*")


def calibrate(cands: DataFrame, rounds: int = 5, trim: float = 0.70, width: float = 0.05) -> DataFrame:
    """Offset, sign and scale of recorded motion per run by trimmed least squares.

    Every round is one job over all runs and candidates: an exact error quantile, then sums
    over the inliers. The candidate rows and the small per-candidate scales are written to
    the shared folder between rounds, so plans stay short and a lost executor costs little.
    """
    rows = cut_lineage(cands.withColumn("power", F.col("ox") * F.col("ox") + F.col("oy") * F.col("oy")), "calibration-rows")
    scales = rows.select(*CAND).distinct().withColumns({"scale": F.lit(1.0), "done": F.lit(False)})
    for _ in range(rounds):
        e = rows.where("power > 1e-6").join(scales.where("not done"), CAND).withColumn("err", _error(F.col("scale")))
        cut = ev.exact_quantiles(e, CAND, "err", [trim], width)
        inl = e.join(cut, CAND).where(F.col("err") <= F.col("q0"))
        s = inl.groupBy(*CAND).agg(F.sum("power").alias("_p"), F.sum(F.col("ox") * F.col("ego_x") + F.col("oy") * F.col("ego_y")).alias("_d"))
        stop = F.coalesce(F.col("_p"), F.lit(0.0)) <= 1e-8
        fit = F.least(F.greatest(F.col("_d") / F.col("_p"), F.lit(0.25)), F.lit(4.0))
        scales = scales.join(s, CAND, "left").select(
            *CAND, F.when(F.col("done") | stop, F.col("scale")).otherwise(fit).alias("scale"), (F.col("done") | stop).alias("done"))
        scales = cut_lineage(scales, "calibration-scales")
    return _best(_scores(rows, scales, width))


def _scores(rows: DataFrame, scales: DataFrame, width: float) -> DataFrame:
    e = rows.join(scales.select(*CAND, "scale"), CAND).withColumn("err", _error(F.col("scale")))
    q = ev.exact_quantiles(e, CAND, "err", [0.5, 0.9], width)
    return q.join(scales, CAND).select(*CAND, "scale", F.col("q0").alias("median_error"), F.col("q1").alias("p90_error"))


def calibrate_labelled(cands: DataFrame, width: float = 0.05) -> DataFrame:
    """One least-squares fit per candidate on pixels known to be static."""
    cands = cut_lineage(cands, "calibration-rows")  # read by the fit and by both quantile passes
    fit = cands.groupBy(*CAND).agg(
        (F.sum(F.col("ox") * F.col("ego_x") + F.col("oy") * F.col("ego_y"))
         / F.greatest(F.sum(F.col("ox") * F.col("ox") + F.col("oy") * F.col("oy")), F.lit(1e-8))).alias("scale"))
    fit = fit.withColumn("scale", F.least(F.greatest("scale", F.lit(0.25)), F.lit(4.0)))
    return _best(_scores(cands, fit, width))


# -- residuals and thresholds -----------------------------------------------------------

def residuals(pixels: DataFrame, cams: DataFrame, gain: float | Column, width: int, height: int, offset: int = 1, keep_last: bool = False) -> DataFrame:
    """Flow, depth, light and colour residuals of every frame against the next one.

    The motion recorded at frame ``k + offset`` describes the step ``k -> k + 1``. The last
    frame has no successor: it is left out, or kept as invalid for ``pad_last`` to fill.
    Validity follows the geometry and the sampled values.
    """
    c = F.col
    p = pixels.withColumns({"glog": light.gray_log(c("r"), c("g"), c("b")),
                            **{f"ch{i}": x for i, x in enumerate(light.chroma(c("r"), c("g"), c("b")))}})
    if offset:
        nxt = F.lead(F.struct("frame_index", "mvx", "mvy")).over(px._series())
        p = p.withColumn("_n", nxt)
        adj = c("_n.frame_index") == c("frame_index") + 1
        p = p.withColumns({m: F.when(adj, c(f"_n.{m}")).otherwise(c(m)) for m in ("mvx", "mvy")}).drop("_n")
    e = px.ego_flow(p, cams, width, height, keep_last)
    e = px.flow_residual(e, gain)
    vals = ["depth", "glog", "ch0", "ch1", "ch2"]
    nxt = pixels.withColumns({"glog": light.gray_log(c("r"), c("g"), c("b")),
                              **{f"ch{i}": x for i, x in enumerate(light.chroma(c("r"), c("g"), c("b")))}})
    s = px.sample_forward(e, nxt, "ego_x", "ego_y", vals)
    s = s.withColumns({
        "depth_error": px.depth_residual(c("fwd_depth"), c("depth_pred")),
        "log_delta": c("fwd_glog") - c("glog"),
        "chroma_error": light.distance([c(f"fwd_ch{i}") for i in range(3)], [c(f"ch{i}") for i in range(3)]),
    })
    s = px.depth_edge(px.by_frame(s), radii=(1, 2), placed=True)
    base = F.coalesce(c("valid") & (c("depth_error") < 0.03) & ~c("edge1"), F.lit(False))
    s = px.light_residual(s, "log_delta", base, "photo_error", placed=True)
    full = c("valid") & c("flow_error").isNotNull() & c("depth_error").isNotNull() & c("photo_error").isNotNull() & c("chroma_error").isNotNull()
    s = s.withColumn("valid", full).withColumn("reliable", c("valid") & ~c("edge2"))
    zero = lambda n: F.when(c("valid"), c(n)).otherwise(F.lit(0.0))
    keep = [x for x in pixels.columns if x not in ("mvx", "mvy")]
    return s.select(*keep, "ego_x", "ego_y", *[zero(n).alias(n) for n in ("flow_error", "flow_error_rel", "depth_error", "photo_error", "chroma_error")], "valid", "reliable")


KINDS = {"flow": "flow_error", "relative": "flow_error_rel", "depth": "depth_error", "photo": "photo_error", "chroma": "chroma_error"}


def _stacked(df: DataFrame, kinds: dict[str, str], probs: list[float], width: float) -> DataFrame:
    """Quantiles of several residuals in one call: ``q0..`` per (run, kind)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(v).alias("value")) for k, v in kinds.items()]))
    return ev.exact_quantiles(df.select(*RUN, pairs.alias("p")).select(*RUN, "p.kind", "p.value"), [*RUN, "kind"], "value", probs, width)


def thresholds(res: DataFrame, quantile: float = 0.95, width: float = 0.02) -> DataFrame:
    """Per run: max(floor, quantile) down the chain flow -> relative flow -> depth -> light, colour."""
    c, fl = F.col, light.FLOORS
    runs = res.select(*RUN).distinct()
    of = lambda kind, q: F.max(F.when(c("kind") == kind, c(q)))
    # every quantile of the chain reads these rows: they are made once
    rel = cut_lineage(res.where("reliable").select(*RUN, *KINDS.values()), "separation-residuals")
    a = _stacked(rel, {"flow": "flow_error", "relative": "flow_error_rel"}, [quantile, 0.80], width).groupBy(*RUN).agg(
        of("flow", "q0").alias("_f"), of("relative", "q1").alias("_r"))
    t = runs.join(a, RUN, "left").select(
        *RUN, F.greatest(F.coalesce("_f", F.lit(fl["flow"])), F.lit(fl["flow"])).alias("t_flow"),
        F.least(F.greatest(2.5 * F.coalesce("_r", F.lit(0.0)), F.lit(fl["relative"])), F.lit(light.RELATIVE_CAP)).alias("t_relative"))
    still = rel.join(t, RUN).where((c("flow_error") <= c("t_flow")) & (c("flow_error_rel") <= c("t_relative"))).select(
        *RUN, "depth_error", "photo_error", "chroma_error")
    d = ev.exact_quantiles(still, RUN, "depth_error", [quantile], width)
    t = t.join(d, RUN, "left").withColumn("t_depth", F.greatest(F.coalesce("q0", F.lit(fl["depth"])), F.lit(fl["depth"]))).drop("q0")
    t = cut_lineage(t, "separation-thresholds")  # one row per run; keeps the last step's plan short
    calm = still.join(t.select(*RUN, "t_depth"), RUN).where(c("depth_error") <= c("t_depth"))
    b = _stacked(calm, {"photo": "photo_error", "chroma": "chroma_error"}, [quantile], width).groupBy(*RUN).agg(
        *[of(k, "q0").alias(f"_{k}") for k in ("photo", "chroma")])
    return t.join(b, RUN, "left").select(
        *RUN, "t_flow", "t_relative", "t_depth",
        *[F.greatest(F.coalesce(f"_{k}", F.lit(fl[k])), F.lit(fl[k])).alias(f"t_{k}") for k in ("photo", "chroma")])


def cue_confidences(res: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """Flow, depth, light and colour evidence, with edges filled and depth and colour widened."""
    c = F.col
    if limits is None:
        d = res.withColumns({f"t_{k}": F.lit(v) for k, v in light.FLOORS.items()})
    else:
        d = res.join(limits, RUN)
    d = px.by_frame(d)
    rel, ok = c("reliable").cast("double"), c("valid").cast("double")
    d = d.withColumns({
        "_flow": F.greatest(light.cue("flow", c("flow_error"), c("t_flow")) * rel, light.cue("relative", c("flow_error_rel"), c("t_relative")) * rel),
        "_depth": light.cue("depth", c("depth_error"), c("t_depth")) * ok,
        "c_photo": light.cue("photo", c("photo_error"), c("t_photo")) * ok,
        "_chroma": light.cue("chroma", c("chroma_error"), c("t_chroma")) * ok,
    })
    d = px.dilate(d, {"_flow2": ("_flow", 2), "_depth2": ("_depth", 2), "_chroma1": ("_chroma", 1)}, placed=True)
    d = d.withColumns({"c_flow": F.when(c("valid") & ~c("reliable"), c("_flow2")).otherwise(c("_flow")),
                       "c_depth": c("_depth2") * ok, "c_chroma": c("_chroma1") * ok})
    return d.drop("_flow", "_depth", "_chroma", "_flow2", "_depth2", "_chroma1", *[f"t_{k}" for k in light.FLOORS])


def persistence(df: DataFrame, flow: str = "c_flow", causal: bool = False) -> DataFrame:
    """Root of the flow evidence times the widened evidence of the neighbouring frames.

    Offline both neighbours count; the causal form looks back only. A frame without a
    neighbour uses itself.
    """
    d = px.dilate(df, {"_wide": (flow, 3)})
    w = px._series()
    k = F.col("frame_index")

    def near(shift, step):
        s = shift(F.struct("frame_index", "_wide")).over(w)
        return F.when(s["frame_index"] == k + step, s["_wide"])

    d = d.withColumn("_back", near(F.lag, -1))
    if not causal:
        d = d.withColumn("_fwd", near(F.lead, 1))
    other = F.col("_back") if causal else F.greatest("_back", "_fwd")
    v = F.col(flow) * F.coalesce(other, F.col(flow))
    return d.withColumn("persistent", F.sqrt(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))).drop("_wide", "_back", "_fwd")


def separate(pixels: DataFrame, cams: DataFrame, gain: float | Column, width: int, height: int, offset: int = 1, causal: bool = False) -> DataFrame:
    """Confidence maps of a whole set of runs.

    Offline: thresholds from the data, both neighbours support a motion. Causal: fixed
    thresholds, only the previous frame counts, and the maps of step k -> k+1 sit on frame
    k + 1, with a neutral (all static) map on frame 0.
    """
    c = F.col
    res = residuals(pixels, cams, gain, width, height, offset, keep_last=not causal)
    cols = ["ego_x", "ego_y", "flow_error", "flow_error_rel", "depth_error", "photo_error", "chroma_error", "valid", "reliable"]
    if causal:
        conf = cue_confidences(res).withColumn("frame_index", c("frame_index") + 1)
    else:
        res = px.pad_last(res, cols)
        res = cut_lineage(res, "separation-residuals")  # read once for thresholds, once for confidences
        conf = cue_confidences(res, thresholds(res))
    conf = persistence(conf, causal=causal)
    maps = light.fuse(c("c_flow"), c("c_depth"), c("c_photo"), c("c_chroma"), c("persistent"), c("valid"))
    hold = lambda e: F.least(F.greatest(e, F.lit(0.0)), F.lit(1.0))
    out = conf.select(*PIXEL, hold(c("c_flow")).alias("q_motion"), *[hold(e).alias(n) for n, e in maps.items()], "valid")
    if causal:
        z, one = F.lit(0.0), F.lit(1.0)
        first = pixels.where("frame_index = 0").select(
            *PIXEL, z.alias("q_motion"), one.alias("q_static"), z.alias("q_dynamic"), z.alias("q_illumination"), z.alias("q_unknown"), F.lit(True).alias("valid"))
        out = out.unionByName(first)
    return out


# -- the older residual-quantile method -------------------------------------------------

def residual_mask(pixels: DataFrame, cams: DataFrame, gain: float | Column, width: int, height: int, quantile: float = 0.99,
                  least: float = 0.35, decay: float = 0.85) -> DataFrame:
    """Dynamic confidence from a quantile of residuals on static labels, plus a decaying target memory."""
    c = F.col
    e = px.flow_residual(px.ego_flow(pixels, cams, width, height, keep_last=True), gain)
    e = px.depth_edge(e, radii=(2,))
    e = e.withColumns({"valid": c("valid") & ~c("edge2"), "is_last": F.lead("frame_index").over(px._series()).isNull()})
    e = e.withColumn("residual", F.when(c("valid"), c("flow_error")).otherwise(0.0))
    e = cut_lineage(e.select(*PIXEL, "seg", "valid", "residual", "is_last"), "residual-mask")  # read by both quantile passes and the mask
    tau = ev.exact_quantiles(e.where(c("valid") & c("seg").isin(0, 3)), RUN, "residual", [quantile], 0.05)
    e = px.pad_last(e, ["valid", "residual"])
    tau = tau.select(*RUN, F.greatest("q0", F.lit(least)).alias("tau"))
    d = e.join(tau, RUN)
    soft = F.greatest(F.lit(0.08), 0.25 * c("tau"))
    d = d.withColumn("q_dyn", light.sigmoid((c("residual") - c("tau")) / soft) * c("valid").cast("double"))
    d = px.decay_memory(d, "q_dyn", c("seg") == 2, decay)
    return d.select(*PIXEL, "seg", "valid", "residual", "tau", "q_dyn", c("memory").alias("q_target_dyn"), "is_last")


def moving_recall(maps: DataFrame, speeds: DataFrame, keys: list[str], q: str, thr: float, speed: float = 0.02) -> DataFrame:
    """Share of moving-target pixels found, last frame of each run excluded."""
    last = maps.groupBy(*RUN).agg(F.max("frame_index").alias("_last"))
    d = maps.where(F.col("seg") == 2).join(last, RUN).where(F.col("frame_index") < F.col("_last")).drop("_last").join(speeds, FRAME).where(F.col("speed") > speed)
    n = F.count_if("valid")
    return d.groupBy(*keys).agg(n.alias("moving_pixels"), ev.ratio(F.count_if(F.col("valid") & (F.col(q) >= thr)), n).alias("recall"))


# -- regions ----------------------------------------------------------------------------

def regions(pairs: DataFrame, target: int = 2, least_moved: int = 10, log_step: float = 0.02) -> DataFrame:
    """Boundary, swept area, halo and static masks per pixel of a frame pair.

    ``pairs`` carries seg, r, g, b and their ``next_`` values. All masks share one placement.
    """
    c = F.col
    d = px.by_frame(pairs).withColumns({"_o0": c("seg") == target, "_o1": c("next_seg") == target})
    d = d.withColumns({"_swept": c("_o0") | c("_o1"), "_moved": c("_o0") != c("_o1")})
    moved = F.count_if("_moved").over(Window.partitionBy(*FRAME))
    d = d.withColumn("active", moved >= least_moved)
    d = px.label_edges(d, {"_e0": "_o0", "_e1": "_o1", "_s0": "seg", "_s1": "next_seg"}, placed=True)
    d = d.withColumns({"_edge": c("_e0") | c("_e1"), "_sedge": c("_s0") | c("_s1")})
    d = px.dilate_ellipse(d, {"_b": ("_edge", 2), "_in": ("_swept", 2), "_out": ("_swept", 8), "_se": ("_sedge", 3)}, placed=True)
    dl = F.abs(light.log_lum(c("next_r"), c("next_g"), c("next_b"), 1.0) - light.log_lum(c("r"), c("g"), c("b"), 1.0))
    background = (c("seg") == 0) & (c("next_seg") == 0)
    return d.select(
        *PIXEL, "active",
        (c("active") & c("_b")).alias("boundary"),
        (c("active") & c("_in")).alias("roi"),
        (c("active") & c("_out") & ~c("_in") & background).alias("halo"),
        ((c("seg") == c("next_seg")) & ~c("_se") & (dl < log_step)).alias("static"))


def region_metrics(masks: DataFrame, counts: DataFrame, frame_s: float, keys: list[str]) -> DataFrame:
    """Event density and coverage proxies per region."""
    c = F.col
    j = masks.join(counts, PIXEL, "left").withColumns({"n": F.coalesce("n", F.lit(0)), "wq": F.coalesce("wq", F.lit(0.0))})
    s = lambda m, v: F.sum(F.when(c(m), v).otherwise(F.lit(0)))
    g = j.groupBy(*keys).agg(
        F.count_distinct(F.when(c("active"), c("frame_index"))).alias("active_intervals"),
        F.count_if("boundary").alias("boundary_pixels"), F.count_if(c("boundary") & (c("n") > 0)).alias("boundary_covered"), s("boundary", c("n")).alias("boundary_events"),
        s("boundary", c("wq")).alias("_bw"), s("roi", c("n")).alias("roi_events"), s("roi", c("wq")).alias("_rw"),
        F.count_if("halo").alias("halo_pixels"), s("halo", c("n")).alias("halo_events"), s("halo", c("wq")).alias("_hw"),
        F.count_if("static").alias("static_pixels"), s("static", c("n")).alias("static_events"), s("static", c("wq")).alias("_sw"))
    r = ev.ratio
    out = g.select(
        *keys, "active_intervals", "boundary_pixels", "boundary_covered", "boundary_events", "roi_events", "halo_pixels", "halo_events", "static_pixels", "static_events",
        r(c("boundary_covered"), c("boundary_pixels")).alias("boundary_coverage"),
        r(c("boundary_events"), c("boundary_pixels")).alias("boundary_density"),
        r(c("_bw"), c("boundary_events")).alias("boundary_mean_q"),
        r(c("_rw"), c("roi_events")).alias("roi_mean_q"),
        r(c("halo_events"), c("halo_pixels")).alias("halo_density"),
        r(c("_hw"), c("halo_events")).alias("halo_mean_q"),
        r(c("static_events") * 1e6, c("static_pixels") * frame_s).alias("static_rate"),
        r(c("_sw") * 1e6, c("static_pixels") * frame_s).alias("static_weighted_rate"),
        r(c("_sw"), c("static_events")).alias("static_mean_q"))
    return out.withColumn("halo_ratio", r(c("halo_density"), c("boundary_density")))
