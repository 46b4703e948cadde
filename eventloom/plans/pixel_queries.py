"""Registered queries over rasters."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from eventloom.functions import light
from eventloom.operators import events as ev
from eventloom.operators import pixels as px
from eventloom.operators import separation as sep
from eventloom.plans import views as v
from eventloom.plans.registry import query
from eventloom.session import cut_lineage, shared_folder
from eventloom.streaming import raster, windows

PIX, FRAME, RUN = px.PIXEL, px.FRAME, px.RUN
N = v.SIDE
KEY = "episode, camera, frame_index, y, x"
SAME = "a.episode = b.episode AND a.camera = b.camera AND a.frame_index = b.frame_index"


def rnd(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def lum(t=""):
    return f"(0.2126::DOUBLE * {t}r + 0.7152::DOUBLE * {t}g + 0.0722::DOUBLE * {t}b)"


def dil(name, src, expr, r, agg="max"):
    """CTE: square neighbourhood aggregate."""
    return f"{name} AS (SELECT a.episode, a.camera, a.frame_index, a.y, a.x, {agg}(b.{expr}) AS m FROM {src} a JOIN {src} b ON {SAME} AND abs(a.y - b.y) <= {r} AND abs(a.x - b.x) <= {r} GROUP BY ALL)"


def ell(name, src, expr, r):
    half = px.ellipse_rows(r)
    rows = "(VALUES " + ", ".join(f"({dy}, {w})" for dy, w in half.items()) + ") f(dy, hw)"
    return f"{name} AS (SELECT a.episode, a.camera, a.frame_index, a.y, a.x, coalesce(bool_or(b.{expr}), false) AS m FROM {src} a CROSS JOIN {rows} LEFT JOIN {src} b ON {SAME} AND b.y = a.y + f.dy AND abs(a.x - b.x) <= f.hw GROUP BY ALL)"


@query("S5 F10 F11", f"""SELECT {KEY}, round(ln({lum()} + 1e-5::DOUBLE), 6) AS log_lum, round(ln({lum()} + 1), 6) AS log_lum1,
  round(ln(1 + round_even(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 0)), 6) AS gray FROM v_pixels""", "v_pixels")
def pixel_light(spark, sf):
    c = [F.col(n) for n in "rgb"]
    p = v.v_pixels(spark, sf).select(*PIX, light.log_lum(*c).alias("log_lum"), light.log_lum(*c, 1.0).alias("log_lum1"), light.gray_log(*c).alias("gray"))
    return rnd(p, "log_lum", "log_lum1", "gray")


@query("P20", f"SELECT episode, camera, frame_index, (y - 2)::INT AS y, (x - 1)::INT AS x, v FROM v_pixels WHERE x >= 1 AND x < {N - 2} AND y >= 2 AND y < {N - 1}", "v_pixels")
def crop(spark, sf):
    return px.crop(v.v_pixels(spark, sf), 1, 2, 2, 1, N, N).select(*PIX, "v")


_NEXT = ("v", "seg", "r", "g", "b", "mvx", "mvy", "depth")
PAIR = f"""pr AS (SELECT * FROM (SELECT *, {', '.join(f'lead({c}) OVER w AS next_{c}' for c in _NEXT)}, lead(frame_index) OVER w AS next_frame FROM v_pixels
  WINDOW w AS (PARTITION BY episode, camera, y, x ORDER BY frame_index)) WHERE next_frame = frame_index + 1)"""


@query("J5", f"{PAIR} SELECT {KEY}, round(next_v - v, 6) AS dv FROM pr", "v_pixels")
def frame_pairs(spark, sf):
    return px.frame_pairs(v.v_pixels(spark, sf), ["v"]).select(*PIX, F.round(F.col("next_v") - F.col("v"), 6).alias("dv"))


@query("J5", f"{PAIR} SELECT episode, camera, frame_index + 1 AS frame_index, y, x, round(v - next_v, 6) AS dv FROM pr", "v_pixels")
def frame_pairs_back(spark, sf):
    return px.frame_pairs(v.v_pixels(spark, sf), ["v"], "end").select(*PIX, F.round(F.col("next_v") - F.col("v"), 6).alias("dv"))


@query("F12", f"""{PAIR} SELECT {KEY}, round(sqrt({' + '.join(f'pow((next_{c} + 1.0::DOUBLE) / (next_r + next_g + next_b + 3) - ({c} + 1.0::DOUBLE) / (r + g + b + 3), 2)' for c in 'rgb')}), 6) AS chroma_change FROM pr""", "v_pixels")
def chroma_change(spark, sf):
    c = F.col
    p = px.frame_pairs(v.v_pixels(spark, sf).select(*PIX, "r", "g", "b"), ["r", "g", "b"])
    d = light.distance(light.chroma(c("next_r"), c("next_g"), c("next_b")), light.chroma(c("r"), c("g"), c("b")))
    return p.select(*PIX, F.round(d, 6).alias("chroma_change"))


EGO = f"""eg0 AS (SELECT p.*, c.fx, c.fy, c.cx, c.cy, (p.x - c.cx) * depth / c.fx + c.tx - n.tx AS rx, (p.y - c.cy) * depth / c.fy AS ry FROM v_pixels p
    JOIN v_cameras c USING (episode, camera, frame_index) JOIN v_cameras n ON n.episode = p.episode AND n.camera = p.camera AND n.frame_index = p.frame_index + 1),
  eg1 AS (SELECT *, fx * rx / depth + cx AS u, fy * ry / depth + cy AS w FROM eg0),
  ego AS (SELECT *, ok AS valid, CASE WHEN ok THEN u - x ELSE 0 END AS ego_x, CASE WHEN ok THEN w - y ELSE 0 END AS ego_y, CASE WHEN ok THEN depth ELSE 0 END AS depth_pred
    FROM (SELECT *, depth > 0.02 AND depth < 100 AND u >= -1e-4 AND u <= {N - 1} + 1e-4 AND w >= -1e-4 AND w <= {N - 1} + 1e-4 AS ok FROM eg1))"""


def ego(spark, sf):
    return px.ego_flow(v.v_pixels(spark, sf), v.v_cameras(spark, sf), N, N)


@query("G1 J19", f"{EGO} SELECT {KEY}, valid, round(ego_x, 6) AS ego_x, round(ego_y, 6) AS ego_y, round(depth_pred, 6) AS depth_pred FROM ego", "v_pixels v_cameras")
def ego_flow(spark, sf):
    return rnd(ego(spark, sf).select(*PIX, "valid", "ego_x", "ego_y", "depth_pred"), "ego_x", "ego_y", "depth_pred")


RES = f"{EGO}, fr AS (SELECT *, sqrt(pow(mvx * 0.5::DOUBLE - ego_x, 2) + pow(mvy * 0.5::DOUBLE - ego_y, 2)) AS flow_error FROM ego)"


@query("G2", f"{RES} SELECT {KEY}, round(flow_error, 6) AS flow_error, round(flow_error / (1 + sqrt(ego_x * ego_x + ego_y * ego_y)), 6) AS flow_error_rel FROM fr", "v_pixels v_cameras")
def flow_residual(spark, sf):
    d = px.flow_residual(ego(spark, sf), 0.5)
    return rnd(d.select(*PIX, "flow_error", "flow_error_rel"), "flow_error", "flow_error_rel")


TAPS = """tp AS (SELECT e.*, t.dy, t.dx, CASE t.dx WHEN 1 THEN x + ego_x - floor(x + ego_x) ELSE 1 - (x + ego_x - floor(x + ego_x)) END * CASE t.dy WHEN 1 THEN y + ego_y - floor(y + ego_y) ELSE 1 - (y + ego_y - floor(y + ego_y)) END AS tw
    FROM ego e CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(dy, dx)),
  sm AS (SELECT a.episode, a.camera, a.frame_index, a.y, a.x, any_value(a.depth) AS depth, any_value(a.depth_pred) AS depth_pred, any_value(a.valid) AS valid, any_value(a.r) AS r, any_value(a.g) AS g, any_value(a.b) AS b,
      CASE WHEN count(*) = count(n.depth) THEN sum(tw * n.depth) END AS fwd_depth,
      CASE WHEN count(*) = count(n.depth) THEN sum(tw * ln(1 + round_even(0.299::DOUBLE * n.r + 0.587::DOUBLE * n.g + 0.114::DOUBLE * n.b, 0))) END AS fwd_glog
    FROM tp a LEFT JOIN v_pixels n ON n.episode = a.episode AND n.camera = a.camera AND n.frame_index = a.frame_index + 1 AND n.y = floor(a.y + ego_y) + dy AND n.x = floor(a.x + ego_x) + dx
    WHERE tw > 0 GROUP BY a.episode, a.camera, a.frame_index, a.y, a.x)"""


def sampled(spark, sf):
    c = F.col
    nxt = v.v_pixels(spark, sf).select(*PIX, "depth", light.gray_log(c("r"), c("g"), c("b")).alias("glog"))
    return px.sample_forward(ego(spark, sf), nxt, "ego_x", "ego_y", ["depth", "glog"])


@query("J6", f"{EGO}, {TAPS} SELECT {KEY}, round(fwd_depth, 6) AS fwd_depth FROM sm", "v_pixels v_cameras")
def sample_forward(spark, sf):
    return rnd(sampled(spark, sf).select(*PIX, "fwd_depth"), "fwd_depth")


@query("G3", f"{EGO}, {TAPS} SELECT {KEY}, round(abs(fwd_depth - depth_pred) / greatest(depth_pred, 0.05::DOUBLE), 6) AS depth_error FROM sm WHERE valid", "v_pixels v_cameras")
def depth_residual(spark, sf):
    d = sampled(spark, sf).where("valid")
    return d.select(*PIX, F.round(px.depth_residual(F.col("fwd_depth"), F.col("depth_pred")), 6).alias("depth_error"))


@query("G4", f"""{EGO}, {TAPS}, ld AS (SELECT *, fwd_glog - ln(1 + round_even(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 0)) AS d, coalesce(valid AND abs(fwd_depth - depth_pred) / greatest(depth_pred, 0.05::DOUBLE) < 0.03::DOUBLE, false) AS base FROM sm),
  md AS (SELECT episode, camera, frame_index, quantile_cont(d, 0.5) FILTER (base) AS med FROM ld GROUP BY ALL)
  SELECT {KEY}, round(abs(d - coalesce(med, 0)), 6) AS light_error FROM ld JOIN md USING (episode, camera, frame_index)""", "v_pixels v_cameras")
def light_residual(spark, sf):
    c = F.col
    d = sampled(spark, sf).withColumn("delta", c("fwd_glog") - light.gray_log(c("r"), c("g"), c("b")))
    base = F.coalesce(c("valid") & (px.depth_residual(c("fwd_depth"), c("depth_pred")) < 0.03), F.lit(False))
    return rnd(px.light_residual(d, "delta", base).select(*PIX, "light_error"), "light_error")


@query("G5", f"{dil('d2', 'v_pixels', 'v', 2)} SELECT {KEY}, m AS wide FROM d2", "v_pixels")
def dilate(spark, sf):
    return px.dilate(v.v_pixels(spark, sf).select(*PIX, "v"), {"wide": ("v", 2)}).select(*PIX, "wide")


EDGE = f"""de AS (SELECT *, greatest(coalesce(abs(depth - lag(depth) OVER (PARTITION BY episode, camera, frame_index, y ORDER BY x)), 0), coalesce(abs(depth - lag(depth) OVER (PARTITION BY episode, camera, frame_index, x ORDER BY y)), 0))
    > 0.03::DOUBLE + 0.04::DOUBLE * least(greatest(depth, 0), 10) AS e FROM v_px2), {dil('ed', 'de', 'e', 1)}"""
PX2 = "v_px2 AS (SELECT * REPLACE (1 + abs(v) / 2 AS depth) FROM v_pixels)"


def shallow(spark, sf):
    return v.v_pixels(spark, sf).withColumn("depth", 1 + F.abs("v") / 2)


@query("G6", f"{PX2}, {EDGE} SELECT {KEY}, m AS edge FROM ed", "v_pixels")
def depth_edge(spark, sf):
    return px.depth_edge(shallow(spark, sf)).select(*PIX, F.col("edge1").alias("edge"))


@query("G7", f"{PX2}, {EDGE}, {dil('wd', 'v_pixels', 'v', 2)} SELECT {KEY}, CASE WHEN ed.m THEN wd.m ELSE p.v END AS filled FROM v_pixels p JOIN ed USING ({KEY}) JOIN wd USING ({KEY})", "v_pixels")
def edge_fill(spark, sf):
    d = px.depth_edge(px.by_frame(shallow(spark, sf)), placed=True)
    d = px.dilate(d, {"_w": ("v", 2)}, placed=True)
    return d.select(*PIX, F.when(F.col("edge1"), F.col("_w")).otherwise(F.col("v")).alias("filled"))


@query("G8", f"""o AS (SELECT dy, dx, CASE WHEN dy = 0 AND dx = 0 THEN 0 ELSE 1 + (dy + 1) * 3 + dx + 1 END AS pref FROM generate_series(-1, 1) a(dy), generate_series(-1, 1) b(dx)),
  c AS (SELECT episode, camera, frame_index, ((y + dy + {N}) % {N})::INT AS y, ((x + dx + {N}) % {N})::INT AS x, pref, mvx, mvy, mvx * mvx + mvy * mvy AS mag FROM v_pixels, o)
  SELECT {KEY}, mvx, mvy FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY mag DESC, pref) AS rn FROM c) WHERE rn = 1""", "v_pixels")
def dilate_motion(spark, sf):
    return px.dilate_motion(v.v_pixels(spark, sf), N, N)


LE = """le AS (SELECT *, coalesce(seg <> lag(seg) OVER r, false) OR coalesce(seg <> lead(seg) OVER r, false) OR coalesce(seg <> lag(seg) OVER c, false) OR coalesce(seg <> lead(seg) OVER c, false) AS e FROM v_pixels
   WINDOW r AS (PARTITION BY episode, camera, frame_index, y ORDER BY x), c AS (PARTITION BY episode, camera, frame_index, x ORDER BY y))"""


@query("G9", f"{LE} SELECT {KEY}, e AS edge FROM le", "v_pixels")
def label_edges(spark, sf):
    return px.label_edges(v.v_pixels(spark, sf).select(*PIX, "seg"), {"edge": "seg"}).select(*PIX, "edge")


@query("G10", f"tg AS (SELECT *, seg = 1 AS t FROM v_pixels), {ell('e3', 'tg', 't', 3)} SELECT {KEY}, m AS wide FROM e3", "v_pixels")
def dilate_ellipse(spark, sf):
    p = v.v_pixels(spark, sf).select(*PIX, (F.col("seg") == 1).alias("t"))
    return px.dilate_ellipse(p, {"wide": ("t", 3)}).select(*PIX, "wide")


def edge_sql(col):
    w = "PARTITION BY episode, camera, frame_index"
    return " OR ".join(f"coalesce({col} <> {f}({col}) OVER ({w}, {a} ORDER BY {b}), false)" for f in ("lag", "lead") for a, b in (("y", "x"), ("x", "y")))


REGIONS = f"""{PAIR}, r0 AS (SELECT *, seg = 2 AS o0, next_seg = 2 AS o1, seg = 2 OR next_seg = 2 AS sw FROM pr),
  r1 AS (SELECT *, ({edge_sql('o0')}) OR ({edge_sql('o1')}) AS ed, ({edge_sql('seg')}) OR ({edge_sql('next_seg')}) AS se, count(*) FILTER (o0 <> o1) OVER (PARTITION BY episode, camera, frame_index) >= 10 AS active FROM r0),
  {ell('b2', 'r1', 'ed', 2)}, {ell('i2', 'r1', 'sw', 2)}, {ell('o8', 'r1', 'sw', 8)}, {ell('s3', 'r1', 'se', 3)},
  rg AS (SELECT {KEY}, active, active AND b2.m AS boundary, active AND i2.m AS roi, active AND o8.m AND NOT i2.m AND seg = 0 AND next_seg = 0 AS halo,
    seg = next_seg AND NOT s3.m AND abs(ln({lum('next_')} + 1) - ln({lum()} + 1)) < 0.02::DOUBLE AS static
    FROM r1 JOIN b2 USING ({KEY}) JOIN i2 USING ({KEY}) JOIN o8 USING ({KEY}) JOIN s3 USING ({KEY}))"""


def masks(spark, sf):
    p = v.v_pixels(spark, sf).select(*PIX, "seg", "r", "g", "b")
    return sep.regions(px.frame_pairs(p, ["seg", "r", "g", "b"]))


@query("G11 G12", f"{REGIONS} SELECT {KEY}, active, boundary, roi, halo, static FROM rg", "v_pixels")
def region_masks(spark, sf):
    return masks(spark, sf)


@query("A14", f"""{REGIONS}, cn AS (SELECT episode, camera, t_us // {v.DAY_US} AS frame_index, y, x, count(*) AS n, sum(q) AS wq FROM v_raster_events WHERE t_us >= 0 GROUP BY ALL),
  j AS (SELECT rg.*, coalesce(n, 0) AS n, coalesce(wq, 0) AS wq FROM rg LEFT JOIN cn USING ({KEY})),
  g AS (SELECT episode, camera, count(DISTINCT frame_index) FILTER (active) AS active_intervals, count(*) FILTER (boundary) AS boundary_pixels, count(*) FILTER (boundary AND n > 0) AS boundary_covered,
    coalesce(sum(n) FILTER (boundary), 0)::BIGINT AS boundary_events, sum(wq) FILTER (boundary) AS bw, coalesce(sum(n) FILTER (roi), 0)::BIGINT AS roi_events, sum(wq) FILTER (roi) AS rw, count(*) FILTER (halo) AS halo_pixels,
    coalesce(sum(n) FILTER (halo), 0)::BIGINT AS halo_events, sum(wq) FILTER (halo) AS hw, count(*) FILTER (static) AS static_pixels, coalesce(sum(n) FILTER (static), 0)::BIGINT AS static_events, coalesce(sum(wq) FILTER (static), 0) AS stw FROM j GROUP BY ALL)
  SELECT episode, camera, active_intervals, boundary_pixels, boundary_covered, boundary_events, roi_events, halo_pixels, halo_events, static_pixels, static_events,
   round(boundary_covered / nullif(boundary_pixels, 0), 6) AS boundary_coverage, round(boundary_events / nullif(boundary_pixels, 0), 6) AS boundary_density, round(bw / nullif(boundary_events, 0), 6) AS boundary_mean_q,
   round(rw / nullif(roi_events, 0), 6) AS roi_mean_q, round(halo_events / nullif(halo_pixels, 0), 6) AS halo_density, round(hw / nullif(halo_events, 0), 6) AS halo_mean_q,
   round(static_events * 1e6 / nullif(static_pixels * 0.04::DOUBLE, 0), 3) AS static_rate, round(stw * 1e6 / nullif(static_pixels * 0.04::DOUBLE, 0), 3) AS static_weighted_rate, round(stw / nullif(static_events, 0), 6) AS static_mean_q,
   round((halo_events / nullif(halo_pixels, 0)) / nullif(boundary_events / nullif(boundary_pixels, 0), 0), 6) AS halo_ratio FROM g""", "v_pixels v_raster_events")
def region_metrics(spark, sf):
    counts = ev.pixel_counts(v.v_raster_events(spark, sf), v.DAY_US)
    d = sep.region_metrics(masks(spark, sf), counts, 0.04, RUN)
    d = rnd(d, "static_rate", "static_weighted_rate", digits=3)
    return rnd(d, "boundary_coverage", "boundary_density", "boundary_mean_q", "roi_mean_q", "halo_density", "halo_mean_q", "static_mean_q", "halo_ratio")


@query("G13", f"SELECT episode, camera, frame_index, (y // 2)::INT AS oy, (x // 4)::INT AS ox, round(avg(v), 6) AS v, round(avg(r), 6) AS r FROM v_pixels GROUP BY ALL", "v_pixels")
def area_pool(spark, sf):
    return rnd(px.area_pool(v.v_pixels(spark, sf), (N, N), (4, 2), ["v", "r"]), "v", "r")


@query("G14", f"""h AS (SELECT *, v * 4 AS diff, abs(v) * 2 AS conf FROM v_pixels), h1 AS (SELECT *, diff >= 0.5::DOUBLE * (1 + 1.5::DOUBLE * (1 - conf)) AS son, -diff >= 0.5::DOUBLE * (1 + 1.5::DOUBLE * (1 - conf)) AS soff FROM h),
  {dil('on2', 'h1', 'son', 2)}, {dil('off2', 'h1', 'soff', 2)}
  SELECT {KEY}, CASE WHEN on2.m THEN floor(greatest(diff, 0) / 0.5::DOUBLE)::BIGINT ELSE 0 END AS n_on, CASE WHEN off2.m THEN floor(greatest(-diff, 0) / 0.5::DOUBLE)::BIGINT ELSE 0 END AS n_off
  FROM h1 JOIN on2 USING ({KEY}) JOIN off2 USING ({KEY})""", "v_pixels")
def hybrid_gate(spark, sf):
    p = v.v_pixels(spark, sf).withColumns({"diff": F.col("v") * 4, "conf": F.abs("v") * 2})
    return px.hybrid_gate(p, "diff", 0.5, 1.5, "conf").select(*PIX, "n_on", "n_off")


SIG = "1 / (1 + exp(-least(greatest({0}, -20), 20)))"


@query("F13", f"SELECT {KEY}, round({SIG.format('v * 200')}, 6) AS s FROM v_pixels", "v_pixels")
def sigmoid(spark, sf):
    return v.v_pixels(spark, sf).select(*PIX, F.round(light.sigmoid(F.col("v") * 200), 6).alias("s"))


FUSED = """fu AS (SELECT *, photo * (1 - greatest(depth_c, chroma_c, 0.25::DOUBLE * pers)) * ok AS li FROM v_cues),
  fq AS (SELECT *, flow * (1 - 0.85::DOUBLE * li) AS dy, (1 - flow) * (1 - li) * ok AS st FROM fu)"""
CUES = "v_cues AS (SELECT *, least(abs(v) * 3, 1) AS flow, least(abs(v) * 2, 1) AS depth_c, r / 255.0::DOUBLE AS photo, g / 510.0::DOUBLE AS chroma_c, b / 255.0::DOUBLE AS pers, CASE WHEN seg <> 1 THEN 1 ELSE 0 END AS ok FROM v_pixels)"


@query("F15", f"{CUES}, {FUSED} SELECT {KEY}, round(st, 6) AS q_static, round(dy, 6) AS q_dynamic, round(li, 6) AS q_illumination, round(greatest(li, 1 - greatest(dy, st)), 6) AS q_unknown FROM fq", "v_pixels")
def fuse(spark, sf):
    c = F.col
    m = light.fuse(F.least(F.abs(c("v")) * 3, F.lit(1.0)), F.least(F.abs(c("v")) * 2, F.lit(1.0)), c("r") / 255.0, c("g") / 510.0, c("b") / 255.0, c("seg") != 1)
    return v.v_pixels(spark, sf).select(*PIX, *[F.round(e, 6).alias(n) for n, e in m.items()])


def s_cue(kind, value, thr):
    lo, k = light.SOFTNESS[kind]
    return SIG.format(f"(({value}) - ({thr})) / greatest({lo}::DOUBLE, {k}::DOUBLE * ({thr}))")


@query("F14", f"""SELECT {KEY}, round(greatest({s_cue('flow', 'abs(v) * 4', '0.35::DOUBLE')}, {s_cue('relative', 'abs(v)', '0.18::DOUBLE')}), 6) AS flow, round({s_cue('depth', 'abs(v) / 5', '0.015::DOUBLE')}, 6) AS depth,
  round({s_cue('photo', 'abs(v) / 3', '0.04::DOUBLE')}, 6) AS photo, round({s_cue('chroma', 'abs(v) / 8', '0.015::DOUBLE')}, 6) AS chroma FROM v_pixels""", "v_pixels")
def cue_confidence(spark, sf):
    a, f = F.abs("v"), light.FLOORS
    q = lambda k, e: light.cue(k, e, F.lit(f[k]))
    return v.v_pixels(spark, sf).select(*PIX, F.round(F.greatest(q("flow", a * 4), q("relative", a)), 6).alias("flow"), F.round(q("depth", a / 5), 6).alias("depth"),
                                        F.round(q("photo", a / 3), 6).alias("photo"), F.round(q("chroma", a / 8), 6).alias("chroma"))


@query("F30", f"""{PAIR}, g AS (SELECT episode, camera, frame_index, quantile_cont(greatest(sqrt(mvx * mvx + mvy * mvy), sqrt(next_mvx * next_mvx + next_mvy * next_mvy)), 0.99) AS m,
   quantile_cont(abs(ln({lum('next_')} + 1e-5::DOUBLE) - ln({lum()} + 1e-5::DOUBLE)), 0.9) AS l FROM pr GROUP BY ALL)
  SELECT episode, camera, frame_index, least(4 * 2, greatest(4, ceil(m / 1), ceil(l / 0.15::DOUBLE)))::INT AS knots FROM g""", "v_pixels")
def knots(spark, sf):
    p = v.v_pixels(spark, sf).select(*PIX, "r", "g", "b", "mvx", "mvy")
    return px.knots(px.frame_pairs(p, ["r", "g", "b", "mvx", "mvy"]), 4)


@query("F31", f"""{PAIR}, m AS (SELECT *, exp(0.75::DOUBLE * ln({lum()} + 1e-5::DOUBLE) + 0.25::DOUBLE * ln({lum('next_')} + 1e-5::DOUBLE)) - 1e-5::DOUBLE AS want, 0.75::DOUBLE * r + 0.25::DOUBLE * next_r AS mr, 0.75::DOUBLE * g + 0.25::DOUBLE * next_g AS mg, 0.75::DOUBLE * b + 0.25::DOUBLE * next_b AS mb FROM pr)
  SELECT {KEY}, """ + ", ".join(f"round(m{c} * want / (0.2126::DOUBLE * mr + 0.7152::DOUBLE * mg + 0.0722::DOUBLE * mb + 1e-5::DOUBLE), 6) AS {c}" for c in "rgb") + " FROM m", "v_pixels")
def log_blend(spark, sf):
    c = F.col
    p = px.frame_pairs(v.v_pixels(spark, sf).select(*PIX, "r", "g", "b"), ["r", "g", "b"])
    m = light.log_blend([c(x) for x in "rgb"], [c(f"next_{x}") for x in "rgb"], F.lit(0.25))
    return p.select(*PIX, *[F.round(e, 6).alias(n) for n, e in zip("rgb", m)])


@query("F32", f"""{PAIR}, w AS (SELECT *, seg <> 1 AS ha, next_seg <> 1 AS hb, sqrt(pow(mvx - next_mvx, 2) + pow(mvy - next_mvy, 2)) AS fe, 1 + 0.25::DOUBLE * greatest(sqrt(mvx * mvx + mvy * mvy), sqrt(next_mvx * next_mvx + next_mvy * next_mvy)) AS ft,
   abs(depth - next_depth) AS de, 0.05::DOUBLE + 0.05::DOUBLE * least(depth, next_depth) AS dt FROM pr)
  SELECT {KEY}, ha AND hb AND de <= dt AS same_surface, round(CASE WHEN ha AND hb THEN 0.5::DOUBLE + 0.5::DOUBLE * sqrt(exp(-de / dt) * sqrt(exp(-fe / ft))) WHEN ha OR hb THEN 0.5::DOUBLE ELSE 0 END, 6) AS confidence FROM w""", "v_pixels")
def warp_quality(spark, sf):
    c = F.col
    p = px.frame_pairs(v.v_pixels(spark, sf).select(*PIX, "seg", "depth", "mvx", "mvy"), ["seg", "depth", "mvx", "mvy"])
    q = px.warp_quality(c("seg") != 1, c("next_seg") != 1, c("depth"), c("next_depth"), [c("mvx"), c("mvy")], [c("next_mvx"), c("next_mvy")])
    return p.select(*PIX, q["same_surface"].alias("same_surface"), F.round(q["confidence"], 6).alias("confidence"))


def s_taps(src, tx, ty, extra):
    return f"""SELECT {extra}, (floor({ty}) + t.dy)::INT AS ty, (floor({tx}) + t.dx)::INT AS tx,
      CASE t.dx WHEN 1 THEN {tx} - floor({tx}) ELSE 1 - ({tx} - floor({tx})) END * CASE t.dy WHEN 1 THEN {ty} - floor({ty}) ELSE 1 - ({ty} - floor({ty})) END AS tw
      FROM {src} CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(dy, dx)"""


@query("J7", f"""t AS ({s_taps('v_pixels', '(x + mvx)', '(y + mvy)', 'episode, camera, frame_index, v, r, depth')})
  SELECT episode, camera, frame_index, ty AS y, tx AS x, round(sum(tw * v / depth) / sum(tw / depth), 6) AS v, round(sum(tw * r / depth) / sum(tw / depth), 6) AS r, round(sum(tw / depth), 6) AS weight
  FROM t WHERE tw > 0 AND tx >= 0 AND tx < {N} AND ty >= 0 AND ty < {N} GROUP BY ALL HAVING sum(tw / depth) >= 1e-4""", "v_pixels")
def splat(spark, sf):
    p = v.v_pixels(spark, sf).withColumns({"tx": F.col("x") + F.col("mvx"), "ty": F.col("y") + F.col("mvy")})
    return rnd(px.splat(p, FRAME, N, N, ["v", "r"], 1 / F.col("depth")), "v", "r", "weight")


CH = ("r", "g", "b", "depth", "mvx", "mvy")
FLAT = ("r", "g", "b", "mvx", "mvy")


def _interpolation(depth: bool) -> str:
    """Two frames between the ends of every pair; without depth the farther-moved pixel wins and motion tells surfaces apart."""
    ch = CH if depth else FLAT
    over = "OVER (PARTITION BY episode, camera, frame_index)"
    rank = {e: f"1 / ({e}depth + 1e-3)" if depth else f"sqrt({e}mvx * {e}mvx + {e}mvy * {e}mvy)" for e in ("", "next_")}
    weight = lambda s, way: f"exp(12.0::DOUBLE * ({way} * r{s} / greatest({way} * m{s}, 1e-6::DOUBLE)))"
    err = "sqrt(pow(a_mvx - b_mvx, 2) + pow(a_mvy - b_mvy, 2))"
    tol = "(1 + 0.25::DOUBLE * greatest(sqrt(pow(a_mvx, 2) + pow(a_mvy, 2)), sqrt(pow(b_mvx, 2) + pow(b_mvy, 2))))"
    far, within = "abs(a_depth - b_depth)", "(0.05::DOUBLE + 0.05::DOUBLE * least(abs(a_depth), abs(b_depth)))"
    same, agree = (f"{far} <= {within}", f"sqrt(exp(-{far} / {within}) * sqrt(exp(-{err} / {tol})))") if depth else (f"{err} <= {tol}", f"exp(-{err} / {tol})")
    side = lambda s, t: f"""s{s} AS (SELECT episode, camera, frame_index, step, ty AS y, tx AS x, sum(tw * imp) AS w, {', '.join(f'sum(tw * imp * {c}) / sum(tw * imp) AS {s}_{c}' for c in ch)} FROM {t} WHERE tw > 0 GROUP BY ALL HAVING sum(tw * imp) >= 1e-4)"""
    return f"""{PAIR}, ia AS (SELECT *, {rank['']} AS ra, {rank['next_']} AS rb, max({rank['']}) {over} AS ma, max({rank['next_']}) {over} AS mb FROM pr),
  fs AS (SELECT ia.*, k.k AS step, k.k / 3.0::DOUBLE AS f FROM ia CROSS JOIN generate_series(1, 2) k(k)),
  ta AS ({s_taps('fs', '(x - f * mvx)', '(y - f * mvy)', f"episode, camera, frame_index, step, {weight('a', '1' if depth else 'f')} AS imp, " + ', '.join(ch))}),
  tb AS ({s_taps('fs', '(x + (1 - f) * next_mvx)', '(y + (1 - f) * next_mvy)', f"episode, camera, frame_index, step, {weight('b', '1' if depth else '(1 - f)')} AS imp, " + ', '.join(f'next_{c} AS {c}' for c in ch))}),
  {side('a', 'ta')}, {side('b', 'tb')},
  q0 AS (SELECT fs.episode, fs.camera, fs.frame_index, fs.step, fs.y, fs.x, f, sa.w IS NOT NULL AS ha, sb.w IS NOT NULL AS hb, sa.* EXCLUDE (episode, camera, frame_index, step, y, x, w), sb.* EXCLUDE (episode, camera, frame_index, step, y, x, w)
     FROM fs LEFT JOIN sa USING (episode, camera, frame_index, step, y, x) LEFT JOIN sb USING (episode, camera, frame_index, step, y, x)),
  q1 AS (SELECT *, coalesce(ha AND hb AND {same}, false) AS same, CASE WHEN ha AND hb THEN 0.5::DOUBLE + 0.5::DOUBLE * {agree} WHEN ha OR hb THEN 0.5::DOUBLE ELSE 0 END AS conf,
     exp((1 - f) * ln({lum('a_')} + 1e-5::DOUBLE) + f * ln({lum('b_')} + 1e-5::DOUBLE)) - 1e-5::DOUBLE AS want, {', '.join(f'(1 - f) * a_{c} + f * b_{c} AS m{c}' for c in 'rgb')} FROM q0),
  q2 AS (SELECT a.episode, a.camera, a.frame_index, a.step, a.y, a.x, bool_or(NOT b.ha AND NOT b.hb) AS near FROM q1 a JOIN q1 b ON {SAME} AND a.step = b.step AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL)
  SELECT {KEY}, step::INT AS step, {', '.join(f'round(CASE WHEN same THEN m{c} * want / (0.2126::DOUBLE * mr + 0.7152::DOUBLE * mg + 0.0722::DOUBLE * mb + 1e-5::DOUBLE) WHEN hb THEN b_{c} WHEN ha THEN a_{c} ELSE 0 END, 5) AS {c}' for c in 'rgb')},
   NOT near AS valid, round(CASE WHEN near THEN 0 ELSE conf END, 6) AS confidence FROM q1 JOIN q2 USING ({KEY}, step)"""


@query("G15 F31 F32 J7", _interpolation(False), "v_pixels")
def interpolate_by_flow(spark, sf):
    """Two-ended interpolation of colour and motion alone."""
    p = v.v_pixels(spark, sf).select(*PIX, *FLAT)
    d = px.interpolate_frames(px.frame_pairs(p, list(FLAT)), 3, N, N)
    return rnd(rnd(d, "r", "g", "b", digits=5), "confidence")


@query("G15 F31 F32 J7", _interpolation(True), "v_pixels")
def interpolate_frames(spark, sf):
    p = v.v_pixels(spark, sf).select(*PIX, *CH)
    d = px.interpolate_frames(px.frame_pairs(p, list(CH)), 3, N, N)
    return rnd(rnd(d, "r", "g", "b", digits=5), "confidence")


@query("J16", f"""tags AS (SELECT * FROM (VALUES (0, 1), (1, 2), (2, 3), (5, 4)) t(tag, seg_id)) SELECT {KEY}, seg_id FROM v_pixels JOIN tags ON tag = r % 7 WHERE seg_id IS NOT NULL""", "v_pixels")
def map_seg(spark, sf):
    """Colour code -> semantic id; codes without an entry are skipped (a fixed table of four rows)."""
    tags = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (5, 4)], "tag int, seg_id int")
    p = v.v_pixels(spark, sf).withColumn("tag", (F.col("r") % 7).cast("int"))
    return p.join(F.broadcast(tags), "tag").select(*PIX, "seg_id")


WS = "WINDOW w AS (PARTITION BY episode, camera, y, x ORDER BY frame_index)"


@query("W6", f"""f AS (SELECT {KEY}, least(abs(v) * 3, 1) AS c FROM v_pixels), {dil('d3', 'f', 'c', 3)}, n AS (SELECT *, lag(m) OVER w AS bk, lead(m) OVER w AS fw, lag(frame_index) OVER w AS bi FROM d3 {WS})
  SELECT {KEY}, round(sqrt(least(greatest(c * coalesce(greatest(bk, fw), c), 0), 1)), 6) AS persistent, round(sqrt(least(greatest(c * coalesce(bk, c), 0), 1)), 6) AS causal FROM f JOIN n USING ({KEY})""", "v_pixels")
def persistence(spark, sf):
    p = v.v_pixels(spark, sf).select(*PIX, F.least(F.abs("v") * 3, F.lit(1.0)).alias("c"))
    d = sep.persistence(p, "c")
    d = sep.persistence(d.withColumnRenamed("persistent", "both"), "c", causal=True)
    return d.select(*PIX, F.round("both", 6).alias("persistent"), F.round("persistent", 6).alias("causal"))


@query("W7", f"""b AS (SELECT {KEY}, least(abs(v) * 3, 1)::DOUBLE AS c, CASE WHEN seg <> 1 THEN 1 ELSE 0 END AS s FROM v_pixels),
  m AS (SELECT {KEY}, c * s AS memory FROM b WHERE frame_index = 0
    UNION ALL SELECT b.episode, b.camera, b.frame_index, b.y, b.x, greatest(b.c * b.s, 0.85::DOUBLE * m.memory) * b.s FROM m JOIN b ON b.episode = m.episode AND b.camera = m.camera AND b.y = m.y AND b.x = m.x AND b.frame_index = m.frame_index + 1)
  SELECT {KEY}, round(memory, 6) AS memory FROM m""", "v_pixels")
def decay_memory(spark, sf):
    """The recurrence in closed form, against a recursive query."""
    p = v.v_pixels(spark, sf).select(*PIX, F.least(F.abs("v") * 3, F.lit(1.0)).alias("c"), "seg")
    return rnd(px.decay_memory(p, "c", F.col("seg") != 1, 0.85).select(*PIX, "memory"), "memory")


@query("W12 T10", f"""SELECT {KEY}, last_value(CASE WHEN seg <> 0 THEN v END IGNORE NULLS) OVER (PARTITION BY episode, camera, y, x ORDER BY frame_index ROWS UNBOUNDED PRECEDING) AS held,
   coalesce(seg <> 0 AND NOT lag(seg <> 0) OVER w, false) AS recovered FROM v_pixels {WS}""", "v_pixels")
def carry_valid(spark, sf):
    p = v.v_pixels(spark, sf).select(*PIX, "v", (F.col("seg") != 0).alias("ok"))
    return px.carry_valid(p, "v", "ok").select(*PIX, "held", "recovered")


@query("W13", f"SELECT {KEY}, CASE WHEN lag(abs(v)) OVER w IS NULL THEN abs(v) ELSE least(lag(abs(v)) OVER w, abs(v)) END AS interval_q FROM v_pixels {WS}", "v_pixels")
def interval_q(spark, sf):
    p = v.v_pixels(spark, sf).select(*PIX, F.abs("v").alias("q"))
    return px.interval_q(p).select(*PIX, "interval_q")


@query("W14", f"SELECT {KEY}, CASE WHEN lead(v) OVER w IS NULL AND lag(v) OVER w IS NOT NULL THEN lag(v) OVER w ELSE v END AS v FROM v_pixels {WS}", "v_pixels")
def pad_last(spark, sf):
    return px.pad_last(v.v_pixels(spark, sf).select(*PIX, "v"), ["v"])


@query("A29", f"""SELECT episode, camera, frame_index // 4 AS exposure, y, x, round(avg(v), 6) AS v, min(abs(v)) AS q, bool_and(seg <> 1) AS ok, count(*) = 4 AS "full" FROM v_pixels GROUP BY ALL""", "v_pixels")
def exposure_mean(spark, sf):
    p = v.v_pixels(spark, sf).select(*PIX, "v", F.abs("v").alias("q"), (F.col("seg") != 1).alias("ok"))
    return rnd(px.exposure_mean(p, 4, ["v"], "q", "ok"), "v")


def speeds(df):
    return df.select(*FRAME, ((F.col("frame_index") % 3) / F.lit(50.0)).alias("speed")).distinct()


@query("A11", f"""l AS (SELECT episode, camera, max(frame_index) AS last FROM v_maps GROUP BY ALL)
  SELECT episode, camera, count(*) FILTER (y > 0) AS moving_pixels, round(count(*) FILTER (y > 0 AND q_dynamic >= 0.5) / nullif(count(*) FILTER (y > 0), 0), 6) AS recall
  FROM v_maps JOIN l USING (episode, camera) WHERE frame_index < last AND seg = 2 AND (frame_index % 3) / 50.0 > 0.02 GROUP BY ALL""", "v_maps")
def moving_recall(spark, sf):
    m = v.v_maps(spark, sf).withColumn("valid", F.col("y") > 0)
    return rnd(sep.moving_recall(m, speeds(v.v_cameras(spark, sf)), RUN, "q_dynamic", 0.5), "recall")


OLD = f"""{RES}, e2 AS (SELECT *, greatest(coalesce(abs(depth - lag(depth) OVER (PARTITION BY episode, camera, frame_index, y ORDER BY x)), 0), coalesce(abs(depth - lag(depth) OVER (PARTITION BY episode, camera, frame_index, x ORDER BY y)), 0))
    > 0.03::DOUBLE + 0.04::DOUBLE * least(depth, 10) AS e FROM fr), {dil('em', 'e2', 'e', 2)},
  o0 AS (SELECT fr.* EXCLUDE (valid), valid AND NOT em.m AS valid, CASE WHEN valid AND NOT em.m THEN flow_error ELSE 0 END AS residual FROM fr JOIN em USING ({KEY})),
  tq AS (SELECT episode, camera, greatest(quantile_cont(residual, 0.95), 0.35::DOUBLE) AS tau, quantile_cont(residual, 0.5) AS r50, quantile_cont(residual, 0.95) AS r95, quantile_cont(residual, 0.99) AS r99 FROM o0 WHERE valid AND seg IN (0, 3) GROUP BY ALL),
  lf AS (SELECT episode, camera, max(frame_index) AS last FROM v_pixels GROUP BY ALL),
  ol AS (SELECT p.episode, p.camera, p.frame_index, p.y, p.x, p.seg, o.valid, o.residual FROM v_pixels p JOIN lf USING (episode, camera) JOIN o0 o ON o.episode = p.episode AND o.camera = p.camera AND o.y = p.y AND o.x = p.x AND o.frame_index = least(p.frame_index, last - 1)),
  om AS (SELECT ol.*, tau, CASE WHEN valid THEN {SIG.format('(residual - tau) / greatest(0.08::DOUBLE, 0.25::DOUBLE * tau)')} ELSE 0 END AS q_dyn FROM ol JOIN tq USING (episode, camera))"""
E_SMALL = (PX2 + ", " + OLD).replace("FROM v_pixels p", "FROM v_px2 p")


def old_maps(spark, sf):
    return sep.residual_mask(shallow(spark, sf), v.v_cameras(spark, sf), 0.5, N, N, quantile=0.95)


@query("X5", f"{E_SMALL} SELECT {KEY}, valid, round(residual, 6) AS residual, round(tau, 6) AS tau, round(q_dyn, 6) AS q_dyn FROM om", "v_pixels v_cameras")
def residual_mask(spark, sf):
    return rnd(old_maps(spark, sf).select(*PIX, "valid", "residual", "tau", "q_dyn"), "residual", "tau", "q_dyn")


@query("A12", f"""{E_SMALL}, s AS (SELECT episode, camera, count(*) AS pixels, avg((q_dyn >= 0.5)::INT) AS dyn, 1 - count(*) FILTER (q_dyn >= 0.5 AND seg IN (0, 3)) / greatest(count(*) FILTER (seg IN (0, 3)), 1) AS bs,
   count(*) FILTER (q_dyn >= 0.5 AND seg = 2) / greatest(count(*) FILTER (seg = 2), 1) AS tr, count(*) FILTER (q_dyn >= 0.5 AND seg = 1) / greatest(count(*) FILTER (seg = 1), 1) AS rr FROM om GROUP BY ALL)
  SELECT episode, camera, pixels, round(dyn, 6) AS dynamic_fraction, round(bs, 6) AS background_suppression, round(tr, 6) AS target_retention, round(rr, 6) AS robot_retention, round(r50, 6) AS residual_median, round(r95, 6) AS residual_p95, round(r99, 6) AS residual_p99
  FROM s JOIN tq USING (episode, camera)""", "v_pixels v_cameras")
def residual_metrics(spark, sf):
    """Suppression, retention and residual quantiles of the residual-quantile method."""
    m = old_maps(spark, sf)
    c = F.col
    hit = c("q_dyn") >= 0.5
    share = lambda on: F.count_if(hit & on) / F.greatest(F.count_if(on), F.lit(1))
    a = m.groupBy(*RUN).agg(F.count(F.lit(1)).alias("pixels"), F.avg(hit.cast("int")).alias("dynamic_fraction"), (1 - share(c("seg").isin(0, 3))).alias("background_suppression"),
                            share(c("seg") == 2).alias("target_retention"), share(c("seg") == 1).alias("robot_retention"))
    q = ev.exact_quantiles(m.where(c("valid") & c("seg").isin(0, 3) & ~c("is_last")), RUN, "residual", [0.5, 0.95, 0.99], 0.05)
    q = q.select(*RUN, *[c(f"q{i}").alias(n) for i, n in enumerate(("residual_median", "residual_p95", "residual_p99"))])
    d = a.join(q, RUN)
    return rnd(d, *[n for n in d.columns if n not in (*RUN, "pixels")])


CANDS = f"""{EGO}, ce AS (SELECT *, greatest(coalesce(abs(depth - lag(depth) OVER (PARTITION BY episode, camera, frame_index, y ORDER BY x)), 0), coalesce(abs(depth - lag(depth) OVER (PARTITION BY episode, camera, frame_index, x ORDER BY y)), 0))
    > 0.03::DOUBLE + 0.04::DOUBLE * least(depth, 10) AS e FROM ego), {dil('cm', 'ce', 'e', 1)},
  cn AS (SELECT {KEY}, lead(mvx) OVER w AS nx, lead(mvy) OVER w AS ny FROM ego {WS}),
  cd AS (SELECT episode, camera, seg, o.o AS "offset", s.s AS sign, ego_x, ego_y, s.s * CASE WHEN o.o = 1 THEN coalesce(nx, mvx) ELSE mvx END AS ox, s.s * CASE WHEN o.o = 1 THEN coalesce(ny, mvy) ELSE mvy END AS oy
    FROM ego JOIN cm USING ({KEY}) JOIN cn USING ({KEY}) CROSS JOIN (VALUES (0), (1)) o(o) CROSS JOIN (VALUES (-1.0::DOUBLE), (1.0::DOUBLE)) s(s) WHERE valid AND NOT cm.m)"""
CAND_SQL = (PX2 + ", " + CANDS).replace("FROM v_pixels p", "FROM v_px2 p")
CK = 'episode, camera, "offset", sign'
ERR = "sqrt(pow(scale * ox - ego_x, 2) + pow(scale * oy - ego_y, 2))"
PICK = f"""sc AS (SELECT {CK}, any_value(scale) AS scale, quantile_cont({ERR}, 0.5) AS med, quantile_cont({ERR}, 0.9) AS p90 FROM {{rows}} JOIN {{fit}} USING ({CK}) GROUP BY ALL)
  SELECT episode, camera, "offset"::INT AS "offset", sign, round(scale, 6) AS scale, round(med, 6) AS median_error, round(p90, 6) AS p90_error FROM
   (SELECT *, row_number() OVER (PARTITION BY episode, camera ORDER BY med, "offset", sign) AS rn FROM sc) WHERE rn = 1"""


@query("X2", f"""{CAND_SQL}, cs AS (SELECT * FROM cd WHERE seg IN (0, 3)), ft AS (SELECT {CK}, least(greatest(sum(ox * ego_x + oy * ego_y) / greatest(sum(ox * ox + oy * oy), 1e-8), 0.25::DOUBLE), 4.0::DOUBLE) AS scale FROM cs GROUP BY ALL), """ + PICK.format(rows="cs", fit="ft"), "v_pixels v_cameras")
def calibrate_labelled(spark, sf):
    c = sep.motion_candidates(shallow(spark, sf), v.v_cameras(spark, sf), N, N, F.col("seg").isin(0, 3))
    return rnd(sep.calibrate_labelled(c), "scale", "median_error", "p90_error")


def _rounds():
    out = [f"cp AS (SELECT *, ox * ox + oy * oy AS power FROM cd), f0 AS (SELECT DISTINCT {CK}, 1.0::DOUBLE AS scale FROM cp)"]
    for i in range(1, 6):
        out.append(f"""x{i} AS (SELECT cp.*, {ERR} AS err FROM cp JOIN f{i - 1} USING ({CK}) WHERE power > 1e-6), c{i} AS (SELECT {CK}, quantile_cont(err, 0.7) AS cut FROM x{i} GROUP BY ALL),
  s{i} AS (SELECT {CK}, sum(power) AS p, sum(ox * ego_x + oy * ego_y) AS d FROM x{i} JOIN c{i} USING ({CK}) WHERE err <= cut GROUP BY ALL),
  f{i} AS (SELECT {CK}, CASE WHEN coalesce(p, 0) <= 1e-8 THEN scale ELSE least(greatest(d / p, 0.25::DOUBLE), 4.0::DOUBLE) END AS scale FROM f{i - 1} LEFT JOIN s{i} USING ({CK}))""")
    return ", ".join(out)


@query("X1 K4", f"{CAND_SQL}, {_rounds()}, " + PICK.format(rows="cp", fit="f5"), "v_pixels v_cameras")
def calibrate(spark, sf):
    c = sep.motion_candidates(shallow(spark, sf), v.v_cameras(spark, sf), N, N)
    return rnd(sep.calibrate(c), "scale", "median_error", "p90_error")


@query("X3", f"""s AS (SELECT episode, camera, frame_index, abs(v) * 3 AS fe, abs(v) AS fr, abs(v - 0.01::DOUBLE) / 4 AS de, abs(v) / 2 AS pe, abs(v) / 5 AS ce, seg <> 1 AS rel FROM v_pixels),
  t1 AS (SELECT episode, camera, greatest(quantile_cont(fe, 0.95), 0.35::DOUBLE) AS t_flow, least(greatest(2.5::DOUBLE * quantile_cont(fr, 0.8), 0.18::DOUBLE), 0.4::DOUBLE) AS t_relative FROM s WHERE rel GROUP BY ALL),
  st AS (SELECT s.*, t_flow, t_relative FROM s JOIN t1 USING (episode, camera) WHERE rel AND fe <= t_flow AND fr <= t_relative),
  t2 AS (SELECT episode, camera, greatest(quantile_cont(de, 0.95), 0.015::DOUBLE) AS t_depth FROM st GROUP BY ALL),
  t3 AS (SELECT episode, camera, greatest(quantile_cont(pe, 0.95), 0.04::DOUBLE) AS t_photo, greatest(quantile_cont(ce, 0.95), 0.015::DOUBLE) AS t_chroma FROM st JOIN t2 USING (episode, camera) WHERE de <= t_depth GROUP BY ALL)
  SELECT episode, camera, round(t_flow, 6) AS t_flow, round(t_relative, 6) AS t_relative, round(t_depth, 6) AS t_depth, round(t_photo, 6) AS t_photo, round(t_chroma, 6) AS t_chroma FROM t1 JOIN t2 USING (episode, camera) JOIN t3 USING (episode, camera)""", "v_pixels")
def separation_thresholds(spark, sf):
    a = F.abs("v")
    p = v.v_pixels(spark, sf).select(*PIX, (a * 3).alias("flow_error"), a.alias("flow_error_rel"), (F.abs(F.col("v") - 0.01) / 4).alias("depth_error"), (a / 2).alias("photo_error"), (a / 5).alias("chroma_error"), (F.col("seg") != 1).alias("reliable"))
    t = sep.thresholds(p)
    return rnd(t, "t_flow", "t_relative", "t_depth", "t_photo", "t_chroma")


def _separation(causal: bool) -> str:
    """The whole separation in one statement, from the formulas of its parts."""
    w = "(PARTITION BY episode, camera, y, x ORDER BY frame_index)"
    fr_ = "PARTITION BY episode, camera, frame_index"
    vals = ["depth", "glog", "ch0", "ch1", "ch2"]
    errs = ["flow_error", "flow_error_rel", "depth_error", "photo_error", "chroma_error"]
    state = ["valid", "reliable", *errs]
    pad = ", ".join(f"CASE WHEN lead(frame_index) OVER w IS NULL AND lag(frame_index) OVER w IS NOT NULL THEN lag({c}) OVER w ELSE {c} END AS {c}" for c in state)
    limits = {"flow": "t_flow", "relative": "t_relative", "depth": "t_depth", "photo": "t_photo", "chroma": "t_chroma"}
    fl = light.FLOORS
    thr = f"""t1 AS (SELECT r.episode, r.camera, greatest(coalesce(f, {fl['flow']}), {fl['flow']}::DOUBLE) AS t_flow, least(greatest(2.5::DOUBLE * coalesce(q, 0), {fl['relative']}::DOUBLE), {light.RELATIVE_CAP}::DOUBLE) AS t_relative
      FROM (SELECT DISTINCT episode, camera FROM res) r LEFT JOIN (SELECT episode, camera, quantile_cont(flow_error, 0.95) AS f, quantile_cont(flow_error_rel, 0.8) AS q FROM res WHERE reliable GROUP BY ALL) a USING (episode, camera)),
  still AS (SELECT res.* FROM res JOIN t1 USING (episode, camera) WHERE reliable AND flow_error <= t_flow AND flow_error_rel <= t_relative),
  t2 AS (SELECT t1.*, greatest(coalesce(d, 0), {fl['depth']}::DOUBLE) AS t_depth FROM t1 LEFT JOIN (SELECT episode, camera, quantile_cont(depth_error, 0.95) AS d FROM still GROUP BY ALL) b USING (episode, camera)),
  t3 AS (SELECT t2.*, greatest(coalesce(f, 0), {fl['photo']}::DOUBLE) AS t_photo, greatest(coalesce(g, 0), {fl['chroma']}::DOUBLE) AS t_chroma FROM t2
    LEFT JOIN (SELECT episode, camera, quantile_cont(photo_error, 0.95) AS f, quantile_cont(chroma_error, 0.95) AS g FROM still JOIN t2 USING (episode, camera) WHERE depth_error <= t_depth GROUP BY ALL) c USING (episode, camera)),
  lim AS (SELECT * FROM res JOIN t3 USING (episode, camera))"""
    if causal:
        thr = "lim AS (SELECT *, " + ", ".join(f"{fl[k]}::DOUBLE AS {c}" for k, c in limits.items()) + " FROM res)"
    near = "greatest(CASE WHEN lag(frame_index) OVER w = frame_index - 1 THEN lag(m) OVER w END" + ("" if causal else ", CASE WHEN lead(frame_index) OVER w = frame_index + 1 THEN lead(m) OVER w END") + ")"
    neutral = f" UNION ALL SELECT {KEY}, 0, 1, 0, 0, 0, true FROM v_pixels WHERE frame_index = 0" if causal else ""
    text = f"""sg AS (SELECT *, ln(1 + round_even(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 0)) AS glog, {', '.join(f'({c} + 1.0::DOUBLE) / (r + g + b + 3) AS ch{k}' for k, c in enumerate('rgb'))} FROM v_pixels),
  sp AS (SELECT *, CASE WHEN lead(frame_index) OVER w = frame_index + 1 THEN lead(mvx) OVER w ELSE mvx END AS ox, CASE WHEN lead(frame_index) OVER w = frame_index + 1 THEN lead(mvy) OVER w ELSE mvy END AS oy FROM sg WINDOW w AS {w}),
  s0 AS (SELECT p.*, c.fx, c.fy, c.cx, c.cy, (p.x - c.cx) * depth / c.fx + c.tx - n.tx AS rx, (p.y - c.cy) * depth / c.fy AS ry FROM sp p JOIN v_cameras c USING (episode, camera, frame_index)
    {'' if causal else 'LEFT'} JOIN v_cameras n ON n.episode = p.episode AND n.camera = p.camera AND n.frame_index = p.frame_index + 1),
  s1 AS (SELECT *, fx * rx / depth + cx AS u, fy * ry / depth + cy AS w FROM s0),
  s2 AS (SELECT *, coalesce(depth > 0.02 AND depth < 100 AND u >= -1e-4 AND u <= {N - 1} + 1e-4 AND w >= -1e-4 AND w <= {N - 1} + 1e-4 AND rx IS NOT NULL, false) AS ok FROM s1),
  s3 AS (SELECT *, CASE WHEN ok THEN u - x ELSE 0 END AS ego_x, CASE WHEN ok THEN w - y ELSE 0 END AS ego_y, CASE WHEN ok THEN depth ELSE 0 END AS depth_pred FROM s2),
  tp AS (SELECT e.*, t.dy, t.dx, CASE t.dx WHEN 1 THEN x + ego_x - floor(x + ego_x) ELSE 1 - (x + ego_x - floor(x + ego_x)) END * CASE t.dy WHEN 1 THEN y + ego_y - floor(y + ego_y) ELSE 1 - (y + ego_y - floor(y + ego_y)) END AS tw
    FROM s3 e CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(dy, dx)),
  sm AS (SELECT a.episode, a.camera, a.frame_index, a.y, a.x, {', '.join(f'CASE WHEN count(*) = count(n.depth) THEN sum(tw * n.{c}) END AS fwd_{c}' for c in vals)}
    FROM tp a LEFT JOIN sg n ON n.episode = a.episode AND n.camera = a.camera AND n.frame_index = a.frame_index + 1 AND n.y = floor(a.y + ego_y) + dy AND n.x = floor(a.x + ego_x) + dx
    WHERE tw > 0 GROUP BY a.episode, a.camera, a.frame_index, a.y, a.x),
  s4 AS (SELECT s3.*, sqrt(pow(ox * 0.5::DOUBLE - ego_x, 2) + pow(oy * 0.5::DOUBLE - ego_y, 2)) AS fe, abs(fwd_depth - depth_pred) / greatest(depth_pred, 0.05::DOUBLE) AS de, fwd_glog - glog AS d,
      sqrt({' + '.join(f'pow(fwd_ch{k} - ch{k}, 2)' for k in range(3))}) AS ce,
      greatest(coalesce(abs(depth - lag(depth) OVER ({fr_}, y ORDER BY x)), 0), coalesce(abs(depth - lag(depth) OVER ({fr_}, x ORDER BY y)), 0)) > 0.03::DOUBLE + 0.04::DOUBLE * least(greatest(depth, 0), 10) AS e FROM s3 JOIN sm USING ({KEY})),
  {dil('e1', 's4', 'e', 1)}, {dil('e2', 's4', 'e', 2)},
  md AS (SELECT episode, camera, frame_index, quantile_cont(d, 0.5) FILTER (ok AND de < 0.03::DOUBLE AND NOT e1.m) AS med FROM s4 JOIN e1 USING ({KEY}) GROUP BY ALL),
  s5 AS (SELECT {KEY}, fe, fe / (1 + sqrt(ego_x * ego_x + ego_y * ego_y)) AS fr, de, abs(d - coalesce(med, 0)) AS pe, ce, e2.m AS edge2, ok AND fe IS NOT NULL AND de IS NOT NULL AND d IS NOT NULL AND ce IS NOT NULL AS valid
    FROM s4 JOIN md USING (episode, camera, frame_index) JOIN e2 USING ({KEY})),
  s6 AS (SELECT {KEY}, valid, valid AND NOT edge2 AS reliable, {', '.join(f'CASE WHEN valid THEN {a} ELSE 0 END AS {b}' for a, b in zip(('fe', 'fr', 'de', 'pe', 'ce'), errs))} FROM s5),
  res AS (SELECT {KEY}, {', '.join(state) if causal else pad} FROM s6 {'' if causal else f'WINDOW w AS {w}'}),
  {thr},
  cu AS (SELECT {KEY if not causal else 'episode, camera, frame_index + 1 AS frame_index, y, x'}, valid, reliable, reliable::INT AS rel, valid::INT AS ok, greatest({s_cue('flow', 'flow_error', 't_flow')}, {s_cue('relative', 'flow_error_rel', 't_relative')}) * reliable::INT AS f,
    {s_cue('depth', 'depth_error', 't_depth')} * valid::INT AS d, {s_cue('photo', 'photo_error', 't_photo')} * valid::INT AS photo, {s_cue('chroma', 'chroma_error', 't_chroma')} * valid::INT AS c FROM lim),
  {dil('wf', 'cu', 'f', 2)}, {dil('wd', 'cu', 'd', 2)}, {dil('wc', 'cu', 'c', 1)},
  cw AS (SELECT cu.*, CASE WHEN valid AND NOT reliable THEN wf.m ELSE f END AS flow, wd.m * ok AS depth_c, wc.m * ok AS chroma_c FROM cu JOIN wf USING ({KEY}) JOIN wd USING ({KEY}) JOIN wc USING ({KEY})),
  {dil('w3', 'cw', 'flow', 3)}, nb AS (SELECT *, {near} AS other FROM w3 WINDOW w AS {w}),
  v_cues AS (SELECT cw.*, sqrt(least(greatest(flow * coalesce(other, flow), 0), 1)) AS pers FROM cw JOIN nb USING ({KEY})), {FUSED}
  SELECT {KEY}, {', '.join(f'round(least(greatest({e}, 0), 1), 6)::DOUBLE AS {n}' for n, e in (('q_motion', 'flow'), ('q_static', 'st'), ('q_dynamic', 'dy'), ('q_illumination', 'li'), ('q_unknown', 'greatest(li, 1 - greatest(dy, st))')))}, valid FROM fq{neutral}"""
    return re.sub(r"(\w+) AS \(SELECT", r"\1 AS MATERIALIZED (SELECT", text)  # each stage once, whatever order joins are taken in


def _maps(d):
    return rnd(d, "q_motion", "q_static", "q_dynamic", "q_illumination", "q_unknown")


@query("X4", _separation(False), "v_pixels v_cameras")
def separate_offline(spark, sf):
    """The whole offline separation; the tests also check it against a NumPy brute force."""
    return _maps(sep.separate(v.v_pixels(spark, sf), v.v_cameras(spark, sf), 0.5, N, N))


@query("T12 X4", _separation(True), "v_pixels v_cameras")
def separate_causal(spark, sf):
    """Causal form: fixed thresholds, previous frame only, neutral first frame."""
    return _maps(sep.separate(v.v_pixels(spark, sf), v.v_cameras(spark, sf), 0.5, N, N, causal=True))


@query("T12", _separation(True), "v_pixels v_cameras")
def stream_separate(spark, sf):
    """The causal form over files that hold every third frame, so that no file has two frames of a step."""
    p, path = cut_lineage(v.v_pixels(spark, sf), "pixels"), shared_folder(spark, "pixel-files")
    for i in (1, 0, 2):
        p.where(F.col("frame_index") % 3 == i).write.mode("append").parquet(path)
    # about six micro-batches, however many files there are: each reads all cameras
    files = len(spark.read.schema(p.schema).parquet(path).inputFiles())
    s = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", max(4, -(-files // 6))).parquet(path)
    d = raster.stream_separate(s, cut_lineage(v.v_cameras(spark, sf), "cameras"), 0.5, N, N, steps=64)
    return _maps(windows.run_available(d, PIX, "append"))
