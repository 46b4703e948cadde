"""Registered queries: paired statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import events as ev
from eventloom.operators import frames as fr
from eventloom.operators import pixels as px
from eventloom.operators import separation as sep
from eventloom.operators import statistics as st
from eventloom.plans import views as v
from eventloom.plans.event_queries import CONF
from eventloom.plans.pixel_queries import REGIONS, masks
from eventloom.plans.registry import query

RULES = {"polarity_imbalance": "lower", "mean_q": "higher", "mean_value": "higher"}


def reports(spark, sf):
    """Long metric table of two runs over 14 episodes and three cameras; one metric is empty for one camera."""
    out = None
    for name, e in zip("ab", v.v_runs(spark, sf), strict=True):
        g = e.withColumn("episode", F.col("user_id") % 14).groupBy("episode", "camera").agg(
            F.count(F.lit(1)).cast("double").alias("events"), (F.abs(F.sum("p")) / F.count(F.lit(1))).alias("polarity_imbalance"),
            F.round(F.avg("q"), 9).alias("mean_q"), F.when(F.first("camera") == "cam1", F.lit(float("nan"))).otherwise(F.round(F.avg("value"), 9)).alias("mean_value"))
        r = st.long_metrics(g, ["episode", "camera"], ["events", "polarity_imbalance", "mean_q", "mean_value"], "event", name)
        out = r if out is None else out.unionByName(r)
    return out


def _wide(name):
    return f"""SELECT user_id % 14 AS episode, camera, '{name}' AS version, count(*)::DOUBLE AS events, abs(sum(p)) / count(*) AS polarity_imbalance, round(avg(q), 9) AS mean_q,
      CASE WHEN any_value(camera) = 'cam1' THEN NULL ELSE round(avg(value), 9) END AS mean_value FROM v_run_{name} GROUP BY ALL"""


REP = f"""rw AS ({_wide('a')} UNION ALL {_wide('b')}),
  rp AS ({' UNION ALL '.join(f"SELECT episode, camera, version, 'event' AS kind, '{m}' AS metric, {m}::DOUBLE AS value FROM rw" for m in ('events', 'polarity_imbalance', 'mean_q', 'mean_value'))}),
  em AS (SELECT episode, version, metric, avg(value) AS value FROM rp GROUP BY ALL),
  pr AS (SELECT a.episode, a.metric, a.value AS base, b.value AS cand, b.value - a.value AS delta FROM em a JOIN em b ON a.episode = b.episode AND a.metric = b.metric AND a.version = 'a' AND b.version = 'b' WHERE a.value IS NOT NULL AND b.value IS NOT NULL)"""
SUMM = """ps AS (SELECT metric, count(*) AS pairs, avg(base) AS base_mean, avg(cand) AS cand_mean, avg(delta) AS mean_delta, quantile_cont(delta, 0.5) AS median_delta, avg(delta) / avg(base) AS relative_delta,
   CASE metric WHEN 'polarity_imbalance' THEN 'lower' WHEN 'events' THEN 'neutral' ELSE 'higher' END AS direction, CASE metric WHEN 'polarity_imbalance' THEN count(*) FILTER (delta < 0) WHEN 'events' THEN NULL ELSE count(*) FILTER (delta > 0) END AS improved,
   count(*) FILTER (delta > 0) AS increased, count(*) FILTER (delta < 0) AS decreased FROM pr GROUP BY metric)"""
B = 100_000
BOOT = f"""np AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY episode) - 1 AS i, count(*) OVER (PARTITION BY metric) AS n FROM pr),
  dr AS (SELECT metric, r.r, floor(('0x' || substr(md5('7|boot|' || metric || '|' || r.r || '|' || i), 1, 12))::BIGINT / 281474976710656.0::DOUBLE * n)::BIGINT AS j FROM np CROSS JOIN generate_series(0, {B - 1}) r(r)),
  mb AS (SELECT dr.metric, r, avg(delta) AS m FROM dr JOIN np ON np.metric = dr.metric AND np.i = dr.j GROUP BY ALL),
  ci AS (SELECT metric, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM mb GROUP BY metric)"""
WX = """nz AS (SELECT metric, episode, delta, abs(delta) AS a FROM pr WHERE delta <> 0),
  rk AS (SELECT x.metric, x.episode, x.delta, (SELECT count(*) FROM nz y WHERE y.metric = x.metric AND y.a < x.a) + ((SELECT count(*) FROM nz y WHERE y.metric = x.metric AND y.a = x.a) + 1) / 2.0::DOUBLE AS rank FROM nz x),
  ri AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY episode) - 1 AS bit FROM rk),
  ws AS (SELECT metric, count(*) AS n, sum(rank) FILTER (delta > 0) AS w FROM ri GROUP BY metric),
  nl AS (SELECT ri.metric, g.g, sum(CASE WHEN (g.g >> bit) & 1 = 1 THEN rank ELSE 0 END) AS s FROM ri CROSS JOIN generate_series(0, 16383) g(g) JOIN ws USING (metric) WHERE g.g < (1 << n) GROUP BY ALL),
  wx AS (SELECT nl.metric, any_value(n) AS n, coalesce(any_value(w), 0) AS w_plus, least(1.0::DOUBLE, 2 * least(avg((s <= coalesce(w, 0))::INT), avg((s >= coalesce(w, 0))::INT))) AS p_value FROM nl JOIN ws USING (metric) GROUP BY nl.metric)"""
SUM_COLS = "pairs, round(base_mean, 6) AS base_mean, round(cand_mean, 6) AS cand_mean, round(mean_delta, 6) AS mean_delta, round(median_delta, 6) AS median_delta, round(relative_delta, 6) AS relative_delta, direction, improved, increased, decreased"


def pairs(spark, sf):
    return st.pair_runs(st.episode_mean(reports(spark, sf)), ["episode", "metric"])


def r6(d, skip=()):
    dbl = [n for n, t in d.dtypes if t == "double" and n not in skip]
    return d.withColumns({n: F.round(n, 6) for n in dbl})


@query("A16 P8", f"{REP} SELECT episode, version, metric, round(value, 6) AS value FROM em", "v_run_a v_run_b")
def episode_mean(spark, sf):
    return r6(st.episode_mean(reports(spark, sf)))


@query("J12", f"{REP} SELECT episode, metric, round(base, 6) AS base, round(cand, 6) AS cand, round(delta, 6) AS delta FROM pr", "v_run_a v_run_b")
def pair_runs(spark, sf):
    return r6(pairs(spark, sf))


@query("A17", f"{REP}, {SUMM} SELECT metric, {SUM_COLS} FROM ps", "v_run_a v_run_b")
def paired_summary(spark, sf):
    return r6(st.paired_summary(pairs(spark, sf), ["metric"], RULES))


@query("A18", """SELECT bool_and(e) AS state_exact_all, bool_and(s) AS seg_exact_all FROM (SELECT user_id, bool_and(value >= 0) AS e, bool_and(q > 0.01) AS s FROM v_events GROUP BY user_id)""", "v_events")
def fairness(spark, sf):
    g = v.v_events(spark, sf).groupBy("user_id").agg(F.bool_and(F.col("value") >= 0).alias("state_exact"), F.bool_and(F.col("q") > 0.01).alias("seg_exact"))
    return st.fairness(g, ["state_exact", "seg_exact"])


T_TABLE = "(VALUES " + ", ".join(f"({d + 1}, {st.t_critical(d)!r}::DOUBLE)" for d in range(1, 31)) + ") t(n, tc)"


@query("A19", f"""{REP}, g AS (SELECT metric, count(*) AS n, avg(delta) AS mean, stddev_samp(delta) AS std, min(delta) AS min, max(delta) AS max FROM pr GROUP BY metric)
  SELECT metric, n, round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max, round(mean - tc * std / sqrt(n), 6) AS ci_low, round(mean + tc * std / sqrt(n), 6) AS ci_high FROM g JOIN {T_TABLE} USING (n)""", "v_run_a v_run_b")
def t_summary(spark, sf):
    return r6(st.t_summary(pairs(spark, sf), ["metric"], "delta"))


@query("X7", f"{REP}, {BOOT} SELECT metric, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM ci", "v_run_a v_run_b")
def bootstrap_ci(spark, sf):
    return r6(st.bootstrap_ci(pairs(spark, sf), ["metric"], ["episode"], B, 7))


@query("X8", f"{REP}, {WX} SELECT metric, n, w_plus, round(p_value, 6) AS p_value FROM wx", "v_run_a v_run_b")
def wilcoxon(spark, sf):
    return r6(st.wilcoxon(pairs(spark, sf), ["metric"]))


@query("X10 A16 A17 X7 X8", f"""{REP}, {SUMM}, {BOOT}, {WX} SELECT metric, {SUM_COLS}, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(p_value, 6) AS p_value FROM ps LEFT JOIN ci USING (metric) LEFT JOIN wx USING (metric)""", "v_run_a v_run_b")
def aggregate_pairs(spark, sf):
    return r6(st.aggregate_pairs(reports(spark, sf), [], B, 7, RULES))


@query("X10", f"""{REP}, pc AS (SELECT a.camera, a.metric, a.value AS base, b.value AS cand, b.value - a.value AS delta FROM rp a JOIN rp b ON a.episode = b.episode AND a.camera = b.camera AND a.metric = b.metric AND a.version = 'a' AND b.version = 'b' WHERE a.value IS NOT NULL AND b.value IS NOT NULL),
  {SUMM.replace('SELECT metric', 'SELECT camera, metric').replace('FROM pr GROUP BY metric', 'FROM pc GROUP BY camera, metric')} SELECT camera, metric, {SUM_COLS} FROM ps""", "v_run_a v_run_b")
def paired_summary_by_camera(spark, sf):
    p = st.pair_runs(reports(spark, sf), ["camera", "episode", "metric"])
    return r6(st.paired_summary(p, ["camera", "metric"], RULES))


def _eval_sql(name):
    H = v.HOUR_US
    return f"""{name}e AS (SELECT * FROM v_run_{name}),
  {name}h AS (SELECT s.episode, s.camera, b.b AS bin, coalesce(e.n, 0) AS n FROM (SELECT DISTINCT episode, camera FROM {name}e) s CROSS JOIN (SELECT k AS b FROM {v.span(6 * H, 'both_runs')}) b
     LEFT JOIN (SELECT episode, camera, t_us // {6 * H} AS bin, count(*) AS n FROM {name}e WHERE t_us >= 0 GROUP BY ALL) e ON e.episode = s.episode AND e.camera = s.camera AND e.bin = b.b),
  {name}f AS (SELECT s.episode, s.camera, b.b AS bin, coalesce(e.n, 0) AS n FROM (SELECT DISTINCT episode, camera FROM {name}e) s CROSS JOIN (SELECT k AS b FROM {v.span(H, 'both_runs')}) b
     LEFT JOIN (SELECT episode, camera, t_us // {H} AS bin, count(*) AS n FROM {name}e WHERE t_us >= 0 GROUP BY ALL) e ON e.episode = s.episode AND e.camera = s.camera AND e.bin = b.b),
  {name}m AS (SELECT episode, camera, bin % 4 AS phase, avg(n) AS m FROM {name}h GROUP BY ALL),
  {name}g AS (SELECT episode, camera, bin, (n - avg(n) OVER (PARTITION BY episode, camera)) * (0.5 - 0.5 * cos(2 * pi() * bin / (max(bin) OVER ())::DOUBLE)) AS s, max(bin) OVER () + 1 AS nb FROM {name}f),
  {name}p AS (SELECT episode, camera, j.j / (max(nb) * 0.001::DOUBLE) AS hz, pow(sum(s * cos(2 * pi() * ((j.j * bin) % nb) / nb::DOUBLE)), 2) + pow(sum(s * sin(2 * pi() * ((j.j * bin) % nb) / nb::DOUBLE)), 2) AS power
     FROM {name}g CROSS JOIN (SELECT unnest(generate_series(0::BIGINT, (max(t_us) // {H} + 1) // 2)) AS j FROM both_runs) j GROUP BY episode, camera, j.j),
  {name}k AS (SELECT episode, camera, sum(power) FILTER (hz >= 5 AND hz <= 250 AND abs(hz - greatest(round(hz / 25), 1) * 25) <= 0.75 AND greatest(round(hz / 25), 1) * 25 <= 250) / sum(power) FILTER (hz >= 5 AND hz <= 250) AS hr,
     10 * log10((avg(power) FILTER (abs(hz - 25) <= 0.75) + 1e-12) / (quantile_cont(power, 0.5) FILTER (abs(hz - 25) <= 5 AND abs(hz - 25) >= 1.5) + 1e-12)) AS db FROM {name}p GROUP BY ALL),
  {name}o AS (SELECT episode, camera, 'events' AS metric, count(*)::DOUBLE AS value FROM {name}e GROUP BY ALL UNION ALL SELECT episode, camera, 'polarity_imbalance', abs(sum(p)) / count(*) FROM {name}e GROUP BY ALL
     UNION ALL SELECT episode, camera, 'count_cv', stddev_pop(n) / avg(n) FROM {name}h GROUP BY ALL UNION ALL SELECT episode, camera, 'phase_imbalance', max(m) / min(m) FROM {name}m GROUP BY ALL
     UNION ALL SELECT episode, camera, 'harmonic_power_ratio', hr FROM {name}k UNION ALL SELECT episode, camera, 'line_db', db FROM {name}k)"""


def _regions_sql(name):
    return f"""{name}c AS (SELECT episode, camera, t_us // {v.DAY_US} AS frame_index, y * {v.SIDE} // {v.HEIGHT} AS y, x * {v.SIDE + 1} // {v.WIDTH} AS x, count(*) AS n FROM {name}e WHERE t_us >= 0 GROUP BY ALL),
  {name}rg AS (SELECT rg.*, coalesce(n, 0) AS n FROM rg LEFT JOIN {name}c USING (episode, camera, frame_index, y, x)),
  {name}q AS (SELECT episode, camera, count(*) FILTER (boundary) AS bp, count(*) FILTER (boundary AND n > 0) AS bc, coalesce(sum(n) FILTER (boundary), 0) AS be, count(*) FILTER (halo) AS hp, coalesce(sum(n) FILTER (halo), 0) AS he,
     count(*) FILTER (static) AS sp, coalesce(sum(n) FILTER (static), 0) AS se FROM {name}rg GROUP BY ALL),
  {name}r AS (SELECT episode, camera, 'boundary_coverage' AS metric, bc / nullif(bp, 0) AS value FROM {name}q UNION ALL SELECT episode, camera, 'boundary_density', be / nullif(bp, 0) FROM {name}q
     UNION ALL SELECT episode, camera, 'halo_ratio', (he / nullif(hp, 0)) / nullif(be / nullif(bp, 0), 0) FROM {name}q UNION ALL SELECT episode, camera, 'static_rate', se * 1e6 / nullif(sp * 0.04::DOUBLE, 0) FROM {name}q)"""


@query("X9 A4 A6 A7 A14 A15 J13 X6", f"""both_runs AS (SELECT t_us FROM v_run_a UNION ALL SELECT t_us FROM v_run_b), {_eval_sql('a')}, {_eval_sql('b')}, {REGIONS}, {_regions_sql('a')}, {_regions_sql('b')},
  cf AS (SELECT * FROM (VALUES {', '.join(f'({p}, {u})' for p, u in CONF)}) t(px, bin_us)),
  ca AS (SELECT DISTINCT episode, camera, px, t_us // bin_us AS tb, y // px AS cy, x // px AS cx, p > 0 AS pol FROM ae, cf WHERE t_us >= 0), cb AS (SELECT DISTINCT episode, camera, px, t_us // bin_us AS tb, y // px AS cy, x // px AS cx, p > 0 AS pol FROM be, cf WHERE t_us >= 0),
  na AS (SELECT episode, camera, px, count(*) AS n FROM ca GROUP BY ALL), nb AS (SELECT episode, camera, px, count(*) AS n FROM cb GROUP BY ALL), nc AS (SELECT episode, camera, px, count(*) AS n FROM ca JOIN cb USING (episode, camera, px, tb, cy, cx, pol) GROUP BY ALL),
  vx AS (SELECT episode, camera, px, nc.n / nb.n AS pr, nc.n / na.n AS rc FROM na JOIN nb USING (episode, camera, px) JOIN nc USING (episode, camera, px)),
  cs AS (SELECT episode, camera, avg(CASE WHEN frame_index % 3 = 0 THEN 5.0::DOUBLE ELSE 0 END) AS mae, avg((frame_index % 3 <> 0)::INT) AS share, bool_and(frame_index % 3 <> 0)::INT AS exact FROM v_pixels GROUP BY ALL),
  al AS (SELECT episode, camera, 'a' AS version, 'event' AS kind, metric, value FROM ao UNION ALL SELECT episode, camera, 'b', 'event', metric, value FROM bo
   UNION ALL SELECT episode, camera, 'b', 'voxel', 'precision_' || px, pr FROM vx UNION ALL SELECT episode, camera, 'b', 'voxel', 'recall_' || px, rc FROM vx UNION ALL SELECT episode, camera, 'b', 'voxel', 'f1_' || px, 2.0::DOUBLE * pr * rc / (pr + rc) FROM vx
   UNION ALL SELECT episode, camera, 'a', 'region', metric, value FROM ar UNION ALL SELECT episode, camera, 'b', 'region', metric, value FROM br
   UNION ALL SELECT episode, camera, 'b', 'consistency', 'r_exact', exact FROM cs UNION ALL SELECT episode, camera, 'b', 'consistency', 'r_mae', mae FROM cs UNION ALL SELECT episode, camera, 'b', 'consistency', 'r_equal_share', share FROM cs
   UNION ALL SELECT DISTINCT episode, camera, 'b', 'consistency', t.m, t.val::DOUBLE FROM v_pixels, (VALUES ('seg_exact', 1), ('seg_mae', 0), ('seg_equal_share', 1)) t(m, val))
  SELECT episode, camera, version, kind, metric, round(value, 6) AS value FROM al""", "v_run_a v_run_b v_pixels")
def evaluate_pair(spark, sf):
    """Events, regions, three resolutions of occupied cells, and equality of the recorded rasters (one channel altered)."""
    a, b = v.v_runs(spark, sf)
    n = max(v.units(a, v.HOUR_US), v.units(b, v.HOUR_US))
    keys = ["episode", "camera"]
    where = masks(spark, sf)
    ra, rb = (sep.region_metrics(where, ev.pixel_counts(v.on_raster(e), v.DAY_US), 0.04, keys) for e in (a, b))
    p = v.v_pixels(spark, sf).select(*px.PIXEL, "seg", "r")
    other = p.withColumn("r", F.when(F.col("frame_index") % 3 == 0, F.col("r") + 5).otherwise(F.col("r")))
    same = fr.consistency(p, other, px.PIXEL, ["seg", "r"], keys)
    return r6(st.evaluate_pair(a, b, keys, 6 * v.HOUR_US, -(-n // 6), v.HOUR_US, n, CONF, ra, rb, same))
