"""Registered queries over the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import chunked
from eventloom.operators import events as ev
from eventloom.plans import views as v
from eventloom.plans.registry import query

S = ev.SERIES
D, FR, H = v.DAY_US, v.FRAME_US, v.HOUR_US
SRC, OUT = (v.HEIGHT, v.WIDTH), (3, 4)
FINE = (6, 8)

# shared oracle fragments -----------------------------------------------------------------
W_EVENTS = f"""w AS (
  SELECT *, t_us // {D} AS bin, CASE WHEN p > 0 THEN 1 ELSE 0 END AS pol, y * {OUT[0]} // {v.HEIGHT} AS oy,
         x * {OUT[1]} // {v.WIDTH} AS ox, q_static * least(greatest(1 - q_illumination, 0), 1) AS ws,
         q_dynamic * least(greatest(1 - q_illumination, 0), 1) AS wd FROM v_events)"""
CLIP8 = "ln(1 + least({0}, 8.0::DOUBLE)) / ln(9.0::DOUBLE)"
HIST = f"""h AS (
  SELECT s.episode, s.camera, b.b AS bin, coalesce(e.n, 0) AS n
  FROM (SELECT DISTINCT episode, camera FROM v_events) s CROSS JOIN (SELECT k AS b FROM {v.span(H)}) b
  LEFT JOIN (SELECT episode, camera, t_us // {H} AS bin, count(*) AS n FROM v_events WHERE t_us >= 0 GROUP BY ALL) e
    ON e.episode = s.episode AND e.camera = s.camera AND e.bin = b.b)"""
DENS = f"""dens AS (
  SELECT episode, camera, t_bin, (oy // 2) * 4 + ox // 2 AS patch_index, sum(abs(value)) / 4 AS density FROM (
    SELECT episode, camera, t_us // {FR} AS t_bin, y * 6 // {v.HEIGHT} AS oy, x * 8 // {v.WIDTH} AS ox, p > 0 AS pol,
           ln(1 + least(sum(q_dynamic * least(greatest(1 - q_illumination, 0), 1)), 8.0::DOUBLE)) / ln(9.0::DOUBLE) AS value
    FROM v_events WHERE t_us >= 0 GROUP BY ALL) GROUP BY ALL)"""


def sums(spark, sf, out=OUT, weights=None):
    return ev.bin_sums(v.v_events(spark, sf), S, D, SRC, out, weights or ev.class_weights())


def dense(spark, sf):
    """Densities of one window per frame interval, on a 6x8 grid with 2x2 patches."""
    b = ev.bin_sums(v.v_events(spark, sf), S, FR, SRC, FINE, {"value": ev.event_weight("q_dynamic")})
    b = b.where(F.col("bin") >= 0).select(
        *S, F.col("bin").alias("t_bin"), "pol", "oy", "ox", ev.squash(F.col("value"), 8.0).alias("value"))
    return ev.patch_density(b, S, 2, FINE, "value")


@query("S1 P7", f"""SELECT episode, camera, event_id, t_us, x, y, p FROM v_events
  WHERE camera IN ('cam0','cam2') AND t_us >= {5 * D} AND t_us < {9 * D}""", "v_events")
def event_scan(spark, sf):
    """Column- and time-pruned scan; the range on the stored ``ts`` reaches the Parquet reader."""
    day = lambda n: F.expr(f"TIMESTAMP_NTZ '2024-01-01' + INTERVAL {n} DAYS")
    e = v.v_events(spark, sf, (F.col("ts") >= day(5)) & (F.col("ts") < day(9))).where(F.col("camera").isin("cam0", "cam2"))
    return e.where((F.col("t_us") >= 5 * D) & (F.col("t_us") < 9 * D)).select(*S, "event_id", "t_us", "x", "y", "p")


@query("P1", f"""SELECT event_id, CASE WHEN episode = 0 THEN t_us - 1000 WHEN camera = 'cam1' THEN t_us - 500 ELSE t_us END AS rel_us
  FROM v_events""", "v_events")
def event_rebase(spark, sf):
    e = v.v_events(spark, sf)
    root = F.when(F.col("episode") == 0, F.lit(1000))
    group = F.when(F.col("camera") == "cam1", F.lit(500))
    return ev.rebase_time(e, root, group, out="rel_us").select("event_id", "rel_us")


@query("P2", f"""SELECT episode, camera, least(greatest(t_us // {FR}, 0), (SELECT max(t_us) // {FR} - 1 FROM v_events)) AS frame_index, count(*) AS n
  FROM v_events GROUP BY ALL""", "v_events")
def event_frame_index(spark, sf):
    """The last frame but one also takes what comes after it."""
    e = v.v_events(spark, sf)
    e = e.withColumn("frame_index", ev.frame_of(F.col("t_us"), FR, v.units(e, FR) - 1))
    return e.groupBy(*S, "frame_index").agg(F.count(F.lit(1)).alias("n"))


@query("P3 P8", f"""SELECT episode, camera, count(*) AS n, round(sum(q), 6) AS sum_q FROM v_events
  WHERE x - 20 >= 0 AND x - 20 < 400 AND y >= 0 AND y < 300 AND value IS NOT NULL GROUP BY ALL""", "v_events")
def event_valid_filter(spark, sf):
    e = v.v_events(spark, sf).withColumn("x", F.col("x") - 20)
    e = e.where(ev.inside(400, 300) & ev.finite("value", "q"))
    return e.groupBy(*S).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("q"), 6).alias("sum_q"))


@query("P4 P5 A1", f"""{W_EVENTS} SELECT episode, camera, bin, pol, oy, ox, round({CLIP8.format('sum(ws)')}, 6) AS w_static,
  round({CLIP8.format('sum(wd)')}, 6) AS w_dynamic FROM w GROUP BY ALL""", "v_events")
def voxel_bins(spark, sf):
    s = sums(spark, sf)
    return s.select(*S, "bin", "pol", "oy", "ox", *[F.round(ev.squash(F.col(w), 8.0), 6).alias(w) for w in ("w_static", "w_dynamic")])


@query("A1 J3 P2 P4 P5", f"""{W_EVENTS}, b AS (SELECT episode, camera, bin, pol, oy, ox, sum(ws) AS ws, sum(wd) AS wd FROM w GROUP BY ALL)
  SELECT episode, camera, f.k AS frame_index, (bin - (f.k * 4 - 8))::INT AS t_bin, pol, oy, ox,
         round({CLIP8.format('ws')}, 6) AS w_static, round({CLIP8.format('wd')}, 6) AS w_dynamic
  FROM b JOIN {v.span(FR)} f ON bin >= f.k * 4 - 8 AND bin < f.k * 4""", "v_events")
def voxel_history(spark, sf):
    """Flagship: the 8-bin event history before every frame, static and dynamic weights."""
    h = ev.voxel_history(sums(spark, sf), S, 8, 4, v.units(v.v_events(spark, sf), FR), 8.0, ["w_static", "w_dynamic"])
    return h.withColumns({w: F.round(w, 6) for w in ("w_static", "w_dynamic")})


@query("A2", f"""{W_EVENTS}, b AS (SELECT episode, camera, bin, pol, oy, ox, sum(ws) AS ws, sum(wd) AS wd FROM w GROUP BY ALL),
  a AS (SELECT episode, camera, f.k AS frame_index, (bin - f.k * 4)::INT AS t_bin, pol, oy, ox, ws, wd
        FROM b JOIN {v.span(FR)} f ON bin >= f.k * 4 AND bin < f.k * 4 + 10)
  SELECT episode, camera, frame_index, t_bin, pol AS channel, oy, ox FROM a WHERE ws > 0
  UNION ALL SELECT episode, camera, frame_index, t_bin, pol + 2, oy, ox FROM a WHERE wd > 0""", "v_events")
def future_activity(spark, sf):
    return ev.future_activity(sums(spark, sf), S, 10, 4, v.units(v.v_events(spark, sf), FR))


@query("A3", f"{DENS} SELECT episode, camera, t_bin, patch_index, round(density, 6) AS density FROM dens", "v_events")
def patch_density(spark, sf):
    return dense(spark, sf).withColumn("density", F.round("density", 6))


@query("K2", f"""{DENS} SELECT episode, camera, t_bin, rank, patch_index, density, density > 1e-6 AS mask FROM (
  SELECT episode, camera, t_bin, patch_index, round(density, 6) AS density,
         row_number() OVER (PARTITION BY episode, camera, t_bin ORDER BY round(density, 6) DESC, patch_index) AS rank FROM dens)
  WHERE rank <= 3""", "v_events")
def top_patches(spark, sf):
    return ev.top_patches(dense(spark, sf).withColumn("density", F.round("density", 6)), S, 3)


@query("K3", f"""{DENS}, sl AS (
   SELECT s.episode, s.camera, b.b AS t_bin, pi.i AS patch_index, coalesce(round(d.density, 6), 0) AS density, d.density IS NULL AS gap
   FROM (SELECT DISTINCT episode, camera FROM v_events) s CROSS JOIN (SELECT k AS b FROM {v.span(FR)}) b CROSS JOIN generate_series(0, 11) pi(i)
   LEFT JOIN dens d ON d.episode = s.episode AND d.camera = s.camera AND d.t_bin = b.b AND d.patch_index = pi.i),
  r AS (SELECT *, row_number() OVER (PARTITION BY episode, camera, t_bin ORDER BY gap, density DESC, patch_index) AS rank FROM sl)
  SELECT episode, camera, (1 + t_bin * 4 + rank - 1)::INT AS token, patch_index::INT AS patch_index, density,
         round((patch_index % 4 + 0.5::DOUBLE) / 4, 6) AS cx, round((patch_index // 4 + 0.5::DOUBLE) / 3, 6) AS cy, density > 1e-6 AS mask
  FROM r WHERE rank <= 4
  UNION ALL SELECT DISTINCT episode, camera, 0, -1, 1.0, NULL, NULL, true FROM v_events""", "v_events")
def patch_tokens(spark, sf):
    d = dense(spark, sf).withColumn("density", F.round("density", 6))
    e = v.v_events(spark, sf)
    t = ev.patch_tokens(d, e.select(*S).distinct(), S, v.units(e, FR), 4, (3, 4))
    return t.withColumns({"cx": F.round("cx", 6), "cy": F.round("cy", 6)})


@query("P6", "SELECT event_id, q FROM v_events WHERE q >= 0.5", "v_events")
def confidence_gate(spark, sf):
    return v.v_events(spark, sf).where(F.col("q") >= 0.5).select("event_id", "q")


LABELLED = f"""lab AS (
  SELECT e.*, coalesce(m.q_motion, 0) AS map_q_motion, coalesce(m.q_static, 0) AS map_q_static, coalesce(m.q_dynamic, 0) AS map_q_dynamic,
         coalesce(m.q_illumination, 0) AS map_q_illumination, coalesce(m.seg, 0) AS map_seg
  FROM (SELECT *, least(greatest(t_us // {FR}, 0), (SELECT max(t_us) // {FR} FROM v_raster_events)) AS frame_index FROM v_raster_events) e
  LEFT JOIN v_maps m ON m.episode = e.episode AND m.camera = e.camera AND m.frame_index = e.frame_index AND m.y = e.y AND m.x = e.x)"""


def labelled(spark, sf):
    cols = ["q_motion", "q_static", "q_dynamic", "q_illumination", "seg"]
    e = v.v_raster_events(spark, sf)
    return ev.label_events(e, v.v_maps(spark, sf), FR, v.units(e, FR), cols)


def labelled_as_q(spark, sf):
    d = labelled(spark, sf).where(ev.inside(v.SIDE, v.SIDE))
    return d.select(*S, "event_id", *[F.col(f"map_{c}").alias(c) for c in ("q_motion", "q_static", "q_dynamic", "q_illumination")],
                    ev.seg_class(F.col("map_seg")).alias("cls"))


LABEL_Q = f"""{LABELLED}, lq AS (SELECT episode, camera, event_id, map_q_motion AS q_motion, map_q_static AS q_static, map_q_dynamic AS q_dynamic,
   map_q_illumination AS q_illumination, CASE WHEN map_seg IN (0, 3) THEN 'background' WHEN map_seg = 1 THEN 'robot' WHEN map_seg = 2 THEN 'target'
   ELSE 'other' END AS cls FROM lab WHERE x >= 0 AND x < 8 AND y >= 0 AND y < 8)"""


@query("J1", f"""{LABELLED} SELECT event_id, frame_index, round(map_q_static, 6) AS q_static, round(map_q_dynamic, 6) AS q_dynamic,
  round(map_q_illumination, 6) AS q_illumination FROM lab""", "v_raster_events v_maps")
def label_events(spark, sf):
    d = labelled(spark, sf)
    return d.select("event_id", "frame_index", *[F.round(f"map_{c}", 6).alias(c) for c in ("q_static", "q_dynamic", "q_illumination")])


@query("J2", f"{LABEL_Q} SELECT episode, camera, cls, count(*) AS n FROM lq GROUP BY ALL", "v_raster_events v_maps")
def event_class(spark, sf):
    return labelled_as_q(spark, sf).groupBy(*S, "cls").agg(F.count(F.lit(1)).alias("n"))


@query("A9", f"""{LABEL_Q} SELECT episode, camera, round(avg((q_motion >= 0.5)::INT), 6) AS motion_fraction,
  round(avg((q_static >= 0.5)::INT), 6) AS static_fraction, round(avg((q_dynamic >= 0.5)::INT), 6) AS dynamic_fraction,
  round(avg((q_illumination >= 0.5)::INT), 6) AS illumination_fraction,
  round(avg((q_motion >= 0.5 AND NOT q_dynamic >= 0.5)::INT) / greatest(avg((q_motion >= 0.5)::INT), 1e-12), 6) AS rejected_motion_fraction
  FROM lq GROUP BY ALL""", "v_raster_events v_maps")
def label_fractions(spark, sf):
    d = ev.label_fractions(labelled_as_q(spark, sf), S, 0.5)
    return d.select(*S, *[F.round(c, 6).alias(c) for c in d.columns if c not in S])


@query("A10", f"""{LABEL_Q} SELECT episode, camera, cls, count(*) AS events,
  round(count(*) FILTER (q_motion >= 0.5) / greatest(count(*), 1), 6) AS candidate_retention,
  round(count(*) FILTER (q_dynamic >= 0.5) / greatest(count(*), 1), 6) AS dynamic_retention,
  round((count(*) FILTER (q_motion >= 0.5) - count(*) FILTER (q_dynamic >= 0.5)) / greatest(count(*) FILTER (q_motion >= 0.5), 1), 6) AS removed_from_motion
  FROM lq GROUP BY ALL""", "v_raster_events v_maps")
def gate_retention(spark, sf):
    d = ev.gate_retention(labelled_as_q(spark, sf), S, 0.5)
    return d.select(*S, "cls", "events", *[F.round(c, 6).alias(c) for c in ("candidate_retention", "dynamic_retention", "removed_from_motion")])


@query("J3", f"""SELECT e.episode, e.camera, f.k AS frame_index, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id
  FROM v_events e JOIN {v.span(D)} f ON e.t_us >= f.k * {D} + 7 * {H} - {2 * D} AND e.t_us < f.k * {D} + 7 * {H}
  GROUP BY ALL""", "v_events")
def frame_event_windows(spark, sf):
    """Windows that do not sit on bin borders: the general bucketed range join."""
    e = v.v_events(spark, sf).select(*S, "t_us", "event_id")
    f = e.select(*S).distinct().withColumn("frame_index", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(v.units(e, D) - 1).cast("long"))))
    f = f.withColumn("frame_t_us", F.col("frame_index") * D + 7 * H)
    j = ev.event_windows(f, e, S, 2 * D, 0, D)
    return j.groupBy(*S, "frame_index").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("J4", f"""SELECT e.episode, e.camera, f.k AS frame_index, count(*) AS n, count(*) FILTER (p > 0) AS n_on
  FROM v_events e JOIN {v.span(FR)} f ON e.t_us >= f.k * {FR} AND e.t_us < f.k * {FR} + {36 * H} GROUP BY ALL""", "v_events")
def clip_windows(spark, sf):
    e = v.v_events(spark, sf).select(*S, "t_us", "p")
    f = e.select(*S).distinct().withColumn("frame_index", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(v.units(e, FR) - 1).cast("long"))))
    j = ev.event_windows(f.withColumn("frame_t_us", F.col("frame_index") * FR), e, S, 0, 36 * H, D)
    return j.groupBy(*S, "frame_index").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p") > 0).alias("n_on"))


@query("A4 F27", f"""SELECT episode, camera, count(*) AS events, round(count(*) / ((SELECT max(t_us) FROM v_events) / 1e6::DOUBLE), 9) AS rate_per_s,
  count(*) FILTER (p > 0) AS on_events, count(*) FILTER (p < 0) AS off_events,
  round(abs(count(*) FILTER (p > 0) - count(*) FILTER (p < 0)) / count(*), 6) AS polarity_imbalance,
  min(t_us) AS t_min_us, max(t_us) AS t_max_us, count(*) FILTER (t_us >= 0 AND t_us <= (SELECT max(t_us) FROM v_events)) AS in_window
  FROM v_events GROUP BY ALL""", "v_events")
def event_stats(spark, sf):
    e = v.v_events(spark, sf)
    d = ev.event_stats(e, S, v.units(e, 1) - 1)
    return d.withColumns({"rate_per_s": F.round("rate_per_s", 9), "polarity_imbalance": F.round("polarity_imbalance", 6)})


@query("A4", """b AS (SELECT user_id % 4 AS episode, user_id % 3 AS cam, event_type, strlen(props) + 32 AS size FROM events)
  SELECT episode, count(DISTINCT cam) AS cameras, count(*) AS events, round(count(*) / ((SELECT max(t_us) FROM v_events) / 1e6::DOUBLE), 9) AS rate_per_s,
  count(*) FILTER (event_type IN ('click','purchase','signup')) AS on_events, sum(size)::BIGINT AS bytes, round(sum(size) / count(*), 6) AS bytes_per_event FROM b GROUP BY episode""", "v_events")
def stream_totals(spark, sf):
    """A stored event: four numbers of eight bytes and its properties."""
    e = v.table(spark, sf, "events")
    d = e.select((F.col("user_id") % 4).alias("episode"), (F.col("user_id") % 3).alias("cam"), F.when(F.col("event_type").isin("click", "purchase", "signup"), 1).otherwise(-1).alias("p"),
                 (F.octet_length("props") + 32).alias("size"))
    d = ev.stream_totals(d, ["episode"], "cam", v.units(v.v_events(spark, sf), 1) - 1, F.col("size"))
    return d.withColumns({"rate_per_s": F.round("rate_per_s", 9), "bytes_per_event": F.round("bytes_per_event", 6)})


def hist(spark, sf):
    e = v.v_events(spark, sf)
    return ev.time_histogram(e, S, H, v.units(e, H))


@query("A5", f"{HIST} SELECT episode, camera, bin, n FROM h", "v_events")
def time_histogram(spark, sf):
    return hist(spark, sf)


@query("A6", f"{HIST} SELECT episode, camera, round(stddev_pop(n) / avg(n), 6) AS count_cv FROM h GROUP BY ALL", "v_events")
def bin_spread(spark, sf):
    return ev.bin_spread(hist(spark, sf), S).withColumn("count_cv", F.round("count_cv", 6))


@query("A7", f"""{HIST}, m AS (SELECT episode, camera, bin % 4 AS phase, avg(n) AS m FROM h GROUP BY ALL)
  SELECT episode, camera, round(max(m) FILTER (phase = 0), 6) AS phase_0, round(max(m) FILTER (phase = 1), 6) AS phase_1,
  round(max(m) FILTER (phase = 2), 6) AS phase_2, round(max(m) FILTER (phase = 3), 6) AS phase_3,
  round(max(m) / min(m), 6) AS phase_imbalance FROM m GROUP BY ALL""", "v_events")
def phase_imbalance(spark, sf):
    d = ev.phase_imbalance(hist(spark, sf), S)
    return d.select(*S, *[F.round(c, 6).alias(c) for c in d.columns if c not in S])


@query("X6", f"""{HIST}, s AS (SELECT episode, camera, bin, (n - avg(n) OVER (PARTITION BY episode, camera)) * (0.5 - 0.5 * cos(2 * pi() * bin / (max(bin) OVER ())::DOUBLE)) AS s, max(bin) OVER () + 1 AS nb FROM h),
  pw AS (SELECT episode, camera, j.j / (max(nb) * 0.001::DOUBLE) AS hz, pow(sum(s * cos(2 * pi() * ((j.j * bin) % nb) / nb::DOUBLE)), 2) + pow(sum(s * sin(2 * pi() * ((j.j * bin) % nb) / nb::DOUBLE)), 2) AS power
         FROM s CROSS JOIN (SELECT unnest(generate_series(0::BIGINT, (max(t_us) // {H} + 1) // 2)) AS j FROM v_events) j GROUP BY episode, camera, j.j),
  k AS (SELECT *, greatest(round(hz / 25), 1) * 25 AS line FROM pw)
  SELECT episode, camera, round(sum(power) FILTER (hz >= 5 AND hz <= 250 AND abs(hz - line) <= 0.75 AND line <= 250) / sum(power) FILTER (hz >= 5 AND hz <= 250), 6) AS harmonic_power_ratio,
   round(10 * log10((avg(power) FILTER (abs(hz - 25) <= 0.75) + 1e-12) / (quantile_cont(power, 0.5) FILTER (abs(hz - 25) <= 5 AND abs(hz - 25) >= 1.5) + 1e-12)), 6) AS line_db
  FROM k GROUP BY ALL""", "v_events")
def harmonic_power(spark, sf):
    e = v.v_events(spark, sf)
    d = ev.harmonic_power(e, S, H, v.units(e, H), 1e-3)
    return d.select(*S, F.round("harmonic_power_ratio", 6).alias("harmonic_power_ratio"), F.round("line_db", 6).alias("line_db"))


@query("A8", """SELECT episode, camera, round(avg(q), 6) AS mean, min(q) AS min, round(quantile_cont(q, 0.01), 6) AS q01, round(quantile_cont(q, 0.10), 6) AS q10,
  round(quantile_cont(q, 0.5), 6) AS q50, round(quantile_cont(q, 0.9), 6) AS q90, round(quantile_cont(q, 0.99), 6) AS q99,
  round(avg((q <= 0.5001)::INT), 6) AS floor_share, round(avg((q >= 0.9)::INT), 6) AS high_share FROM v_events GROUP BY ALL""", "v_events")
def confidence_stats(spark, sf):
    e = v.v_events(spark, sf).select(*S, "q")
    q = ev.exact_quantiles(e, S, "q", [0.01, 0.1, 0.5, 0.9, 0.99], 0.01, levels=1)
    a = e.groupBy(*S).agg(F.round(F.avg("q"), 6).alias("mean"), F.min("q").alias("min"),
                          F.round(F.avg((F.col("q") <= 0.5001).cast("int")), 6).alias("floor_share"),
                          F.round(F.avg((F.col("q") >= 0.9).cast("int")), 6).alias("high_share"))
    names = ["q01", "q10", "q50", "q90", "q99"]
    return a.join(q, S).select(*S, "mean", "min", *[F.round(f"q{i}", 6).alias(n) for i, n in enumerate(names)], "floor_share", "high_share")


@query("A13", f"""SELECT episode, camera, t_us // {FR} AS frame_index, y, x, count(*) AS n, round(sum(q), 6) AS wq FROM v_raster_events
  WHERE t_us >= 0 GROUP BY ALL""", "v_raster_events")
def pixel_counts(spark, sf):
    return ev.pixel_counts(v.v_raster_events(spark, sf), FR).withColumn("wq", F.round("wq", 6))


CONF = [(40, H * 24), (80, H * 48), (160, H * 120)]


@query("A15 U1", """c AS (SELECT * FROM (VALUES """ + ", ".join(f"({p}, {u})" for p, u in CONF) + f""") t(px, bin_us)),
  a AS (SELECT DISTINCT episode, camera, px, bin_us, t_us // bin_us AS tb, y // px AS cy, x // px AS cx, p > 0 AS pol FROM v_run_a, c WHERE t_us >= 0),
  b AS (SELECT DISTINCT episode, camera, px, bin_us, t_us // bin_us AS tb, y // px AS cy, x // px AS cx, p > 0 AS pol FROM v_run_b, c WHERE t_us >= 0),
  n AS (SELECT episode, camera, px, bin_us, count(a.cy1) AS occupied_a, count(b.cy1) AS occupied_b, count(*) FILTER (a.cy1 IS NOT NULL AND b.cy1 IS NOT NULL) AS common
        FROM (SELECT *, 1 AS cy1 FROM a) a FULL JOIN (SELECT *, 1 AS cy1 FROM b) b USING (episode, camera, px, bin_us, tb, cy, cx, pol) GROUP BY ALL)
  SELECT episode, camera, px, bin_us, occupied_a, occupied_b, common, round(common / occupied_b, 6) AS precision, round(common / occupied_a, 6) AS recall,
   round(2.0::DOUBLE * (common / occupied_b) * (common / occupied_a) / (common / occupied_b + common / occupied_a), 6) AS f1 FROM n""", "v_run_a v_run_b")
def voxel_agreement(spark, sf):
    a, b = v.v_runs(spark, sf)
    d = ev.voxel_agreement(a, b, S, CONF, v.units(b, 1))
    return d.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("U1", f"""SELECT episode, camera, count(*) AS cells FROM (
  SELECT DISTINCT episode, camera, t_us // {D}, y // 40, x // 40, p > 0 FROM v_events WHERE t_us >= 0) GROUP BY ALL""", "v_events")
def occupied_cells(spark, sf):
    e = v.v_events(spark, sf)
    return ev.occupied(e, S, 40, D, v.units(e, 1)).groupBy(*S).agg(F.count(F.lit(1)).alias("cells"))


@query("A30", f"""SELECT episode, camera, count(*) AS events, count(*) FILTER ((x < 0 OR x >= 470) AND event_id % 11 <> 0) AS bad_x, count(*) FILTER (y < 0 OR y >= 355) AS bad_y,
  count(*) FILTER (t_us < 0) AS before_origin, count(*) FILTER (t_us > {29 * D}) AS after_end, count(*) FILTER (p NOT IN (-1, 1)) AS bad_polarity,
  count(*) FILTER (q < 0 OR q > 1) AS bad_quality, count(*) FILTER (event_id % 11 = 0) AS missing_fields FROM v_events GROUP BY ALL""", "v_events")
def stream_checks(spark, sf):
    """Every eleventh event lacks its column."""
    e = v.v_events(spark, sf)
    return ev.stream_checks(e.withColumn("x", F.when(F.col("event_id") % 11 != 0, F.col("x"))), S, 470, 355, 29 * D)


@query("W2", """s AS (SELECT episode, camera, t_us, lag(t_us) OVER (PARTITION BY episode, camera ORDER BY event_id * 7919 % 10007, event_id) AS prev_t FROM v_events)
  SELECT episode, camera, count(*) FILTER (t_us < prev_t) AS steps_back, count(*) AS events FROM s GROUP BY ALL""", "v_events")
def non_monotonic(spark, sf):
    """Checked in a shuffled arrival order, so that there is something to find."""
    e = v.v_events(spark, sf).withColumn("arrival", (F.col("event_id") * 7919 % 10007) * F.lit(2**40) + F.col("event_id"))
    return ev.non_monotonic(e, S, "arrival", chunked.Rows(2_000, 2**43))


@query("W5", f"""s AS (SELECT episode, camera, t_us, event_id, t_us // {FR} AS rk FROM v_events),
  f AS (SELECT *, CASE WHEN lag(rk) OVER w IS NOT DISTINCT FROM rk AND lag(event_id) OVER w IS NOT NULL THEN 0 ELSE 1 END AS nw FROM s WINDOW w AS (PARTITION BY episode, camera ORDER BY t_us, event_id)),
  g AS (SELECT *, sum(nw) OVER (PARTITION BY episode, camera ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM f)
  SELECT episode, camera, run, min(rk) AS run_key, min(t_us) AS t_first, max(t_us) AS t_last, count(*) AS n FROM g GROUP BY episode, camera, run""", "v_events")
def event_runs(spark, sf):
    return ev.runs(v.v_events(spark, sf), S, ev.ORDER, F.floor(F.col("t_us") / FR), v.ROWS)


@query("K1", """SELECT event_id, row_number() OVER (PARTITION BY episode, camera ORDER BY t_us, event_id) - 1 AS pos FROM v_events""", "v_events")
def sorted_events(spark, sf):
    """Stable time order as an explicit position, built from per-chunk sorts."""
    return chunked.positions(v.v_events(spark, sf).select(*S, "t_us", "event_id"), S, ev.ORDER, v.ROWS).select("event_id", "pos")


@query("U2", f"""SELECT episode, camera, t_us // {D} AS bin, pol, count(*) AS n FROM (
  SELECT episode, camera, t_us, 'on' AS pol FROM v_run_a WHERE p > 0 UNION ALL SELECT episode, camera, t_us, 'off' FROM v_run_b WHERE p < 0) GROUP BY ALL""", "v_run_a v_run_b")
def union_polarity(spark, sf):
    a, b = v.v_runs(spark, sf)
    on = a.where("p > 0").select(*S, "t_us", F.lit("on").alias("pol"))
    off = b.where("p < 0").select(*S, "t_us", F.lit("off").alias("pol"))
    return on.unionByName(off).groupBy(*S, ev.bin_of(F.col("t_us"), D).alias("bin"), "pol").agg(F.count(F.lit(1)).alias("n"))


@query("U4", """SELECT DISTINCT camera FROM v_run_a WHERE episode < 2 INTERSECT SELECT DISTINCT camera FROM v_run_b WHERE episode > 1""", "v_run_a v_run_b")
def common_cameras(spark, sf):
    a, b = v.v_runs(spark, sf)
    return a.where("episode < 2").select("camera").intersect(b.where("episode > 1").select("camera"))
