"""Registered queries over keyed series, and streams compared with batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import events as ev
from eventloom.operators import series as se
from eventloom.plans import views as v
from eventloom.plans.registry import query
from eventloom.session import shared_folder
from eventloom.streaming import stateful, windows

U = ["user_id"]
TAU = 2 * v.HOUR_US
O = ["t_us", "event_id"]  # noqa: E741


def series(spark, sf):
    e = v.v_events(spark, sf)
    return e.select("user_id", "t_us", "event_id", "value", "q", (F.col("event_id") % 17 == 0).alias("reset"), (F.col("event_id") % 5 != 0).alias("ok"))


ORD = "od AS (SELECT user_id, t_us, event_id, value, q, event_id % 17 = 0 AS reset, event_id % 5 <> 0 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS rn FROM v_events)"


def enc_sql(src, theta=25.0, start="false"):
    """The encoder as a recursion over row numbers."""
    u = f"((o.value - e.v0) / {theta}::DOUBLE)"
    return f"""en AS (SELECT user_id, rn, t_us, event_id, value, q, value AS v0, 0::BIGINT AS k, 0::BIGINT AS kb, NULL::DOUBLE AS pv, NULL::BIGINT AS pt, NULL::DOUBLE AS pq FROM {src} WHERE rn = 1
    UNION ALL SELECT o.user_id, o.rn, o.t_us, o.event_id, o.value, o.q, CASE WHEN {start} THEN o.value ELSE e.v0 END,
      CASE WHEN {start} THEN 0 WHEN {u} >= e.k + 1 THEN floor({u})::BIGINT WHEN {u} <= e.k - 1 THEN ceil({u})::BIGINT ELSE e.k END, CASE WHEN {start} THEN 0 ELSE e.k END,
      CASE WHEN {start} THEN NULL ELSE e.value END, CASE WHEN {start} THEN NULL ELSE e.t_us END, CASE WHEN {start} THEN NULL ELSE e.q END
    FROM en e JOIN {src} o ON o.user_id = e.user_id AND o.rn = e.rn + 1)"""


def cross_sql(extra=""):
    tgt = "(v0 + (kb + sign(k - kb) * i) * 25.0::DOUBLE)"
    return f"""SELECT user_id, t_us, event_id, sign(k - kb)::INT AS p, i::INT AS ordinal,
     round(pt + CASE WHEN abs(value - pv) > 1e-12 THEN least(greatest(({tgt} - pv) / (value - pv), 0), 1) ELSE 1 END * (t_us - pt), 0) AS t_cross{extra}
     FROM en, (SELECT unnest(generate_series(1::BIGINT, max(abs(k - kb)))) AS i FROM en) g WHERE i <= abs(k - kb)"""


@query("T4 F16 F17 W9 W13", f"{ORD}, {enc_sql('od')} {cross_sql(', least(pq, q) AS interval_q')}", "v_events")
def encode_crossings(spark, sf):
    """Send-on-delta in closed form, against a recursive query."""
    d = se.encode_crossings(series(spark, sf), U, O, "value", 25.0, v.ROWS, q="q")
    return d.withColumn("t_cross", F.round("t_cross", 0))


@query("T10 T4", f"{ORD}, {enc_sql('od', start='o.reset')} {cross_sql()}", "v_events")
def encode_with_reset(spark, sf):
    d = se.encode_crossings(series(spark, sf), U, O, "value", 25.0, v.ROWS, reset=F.col("reset"))
    return d.withColumn("t_cross", F.round("t_cross", 0))


@query("W12 T4", f"""{ORD}, pv AS (SELECT *, lag(ok) OVER (PARTITION BY user_id ORDER BY rn) = false AS back FROM od), ov AS (SELECT * REPLACE (row_number() OVER (PARTITION BY user_id ORDER BY rn) AS rn) FROM pv WHERE ok),
  {enc_sql('ov', start='o.back')} {cross_sql()}""", "v_events")
def encode_with_validity(spark, sf):
    d = se.encode_crossings(series(spark, sf), U, O, "value", 25.0, v.ROWS, valid="ok")
    return d.withColumn("t_cross", F.round("t_cross", 0))


UP, DOWN = "(20 + user_id % 5 * 2.5::DOUBLE)", "(35 - user_id % 3 * 4.5::DOUBLE)"


def two_sided_sql(start="false"):
    """The recursion with thresholds of each key's own; counts of rises (a) and falls (b) give the reference."""
    new = "(e.v0 + e.a * up - e.b * down)"
    return f"""ou AS (SELECT *, {UP} AS up, {DOWN} AS down FROM od),
  tw AS (SELECT user_id, rn, t_us, event_id, value, value AS v0, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS n, NULL::DOUBLE AS ref, NULL::DOUBLE AS pv, NULL::BIGINT AS pt FROM ou WHERE rn = 1
    UNION ALL SELECT user_id, rn, t_us, event_id, value, CASE WHEN s THEN value ELSE v0 END, CASE WHEN s THEN 0 ELSE a + r END, CASE WHEN s THEN 0 ELSE b + f END, CASE WHEN s THEN 0 ELSE r - f END, ref, pv, pt FROM (
      SELECT o.user_id, o.rn, o.t_us, o.event_id, o.value, e.v0, e.a, e.b, {start} AS s, {new} AS ref, e.value AS pv, e.t_us AS pt,
        floor(greatest(o.value - {new}, 0) / up + 1e-9::DOUBLE)::BIGINT AS r, floor(greatest({new} - o.value, 0) / down + 1e-9::DOUBLE)::BIGINT AS f
      FROM tw e JOIN ou o ON o.user_id = e.user_id AND o.rn = e.rn + 1)),
  tc AS (SELECT *, ref + CASE WHEN n > 0 THEN i * {UP} ELSE -i * {DOWN} END AS target FROM tw, (SELECT unnest(generate_series(1::BIGINT, max(abs(n)))) AS i FROM tw) g WHERE i <= abs(n))
  SELECT user_id, t_us, event_id, sign(n)::INT AS p, i::INT AS ordinal,
    round(pt + CASE WHEN abs(value - pv) > 1e-12 THEN least(greatest((target - pv) / (value - pv), 0), 1) ELSE 1 END * (t_us - pt), 0) AS t_cross FROM tc"""


def thresholds(d):
    return d.withColumns({"up": 20 + F.col("user_id") % 5 * 2.5, "down": 35 - F.col("user_id") % 3 * 4.5})


@query("T4", f"{ORD}, {two_sided_sql()}", "v_events")
def encode_two_sided(spark, sf):
    """Thresholds of each user's own, other ones up than down, against a recursive query."""
    d = se.two_sided_crossings(thresholds(series(spark, sf)), U, O, "value", "up", "down", v.ROWS)
    return d.withColumn("t_cross", F.round("t_cross", 0))


@query("T4 T10", f"{ORD}, {two_sided_sql('o.reset')}", "v_events")
def encode_two_sided_reset(spark, sf):
    d = se.two_sided_crossings(thresholds(series(spark, sf)), U, O, "value", "up", "down", v.ROWS, reset=F.col("reset"))
    return d.withColumn("t_cross", F.round("t_cross", 0))


@query("F16", "SELECT event_id, floor(greatest(value - 100, 0) / 7.5::DOUBLE)::BIGINT AS n_on, floor(greatest(100 - value, 0) / 7.5::DOUBLE)::BIGINT AS n_off FROM v_events", "v_events")
def crossing_counts(spark, sf):
    d = F.col("value") - 100
    return v.v_events(spark, sf).select("event_id", se.crossings(d, 7.5).alias("n_on"), se.crossings(-d, 7.5).alias("n_off"))


REFR = f"""{ORD}, rf AS (SELECT user_id, rn, event_id, t_us, t_us AS last, true AS kept FROM od WHERE rn = 1
    UNION ALL SELECT o.user_id, o.rn, o.event_id, o.t_us, CASE WHEN o.t_us - r.last >= {TAU * 4} THEN o.t_us ELSE r.last END, o.t_us - r.last >= {TAU * 4} FROM rf r JOIN od o ON o.user_id = r.user_id AND o.rn = r.rn + 1)"""


@query("T5", f"{REFR} SELECT user_id, t_us, event_id FROM rf WHERE kept", "v_events")
def refractory(spark, sf):
    """Greedy minimum gap, split into chunks, against a recursive query."""
    return se.refractory(series(spark, sf).select("user_id", "t_us", "event_id"), U, O, TAU * 4, v.ROWS)


@query("T6", f"""{ORD}, lp AS (SELECT user_id, rn, event_id, t_us, value AS y FROM od WHERE rn = 1
   UNION ALL SELECT o.user_id, o.rn, o.event_id, o.t_us, (1 - least((o.q * greatest(o.t_us - l.t_us, 0)) / {float(TAU * 6)}::DOUBLE, 1)) * l.y + least((o.q * greatest(o.t_us - l.t_us, 0)) / {float(TAU * 6)}::DOUBLE, 1) * o.value
   FROM lp l JOIN od o ON o.user_id = l.user_id AND o.rn = l.rn + 1) SELECT user_id, event_id, round(y, 6) AS smooth FROM lp""", "v_events")
def lowpass(spark, sf):
    d = se.lowpass(series(spark, sf).select("user_id", "t_us", "event_id", "value", "q"), U, O, "value", TAU * 6, v.ROWS, rate=F.col("q"))
    return d.select("user_id", "event_id", F.round("smooth", 6).alias("smooth"))


@query("T13 W9 T5", f"""{ORD}, {enc_sql('od')}, cr AS ({cross_sql()}), oc AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_cross, event_id, ordinal) AS rn FROM cr),
  rf AS (SELECT user_id, rn, event_id, ordinal, p, t_cross, t_cross AS last, true AS kept FROM oc WHERE rn = 1
    UNION ALL SELECT o.user_id, o.rn, o.event_id, o.ordinal, o.p, o.t_cross, CASE WHEN o.t_cross - r.last >= {TAU} THEN o.t_cross ELSE r.last END, o.t_cross - r.last >= {TAU} FROM rf r JOIN oc o ON o.user_id = r.user_id AND o.rn = r.rn + 1)
  SELECT user_id, event_id, ordinal, p FROM rf WHERE kept""", "v_events")
def layered_crossings(spark, sf):
    """Several crossings between two samples, in time order, through the minimum-gap filter."""
    d = se.encode_crossings(series(spark, sf), U, O, "value", 25.0, v.ROWS)
    d = d.select("user_id", F.round("t_cross", 0).alias("t_cross"), "event_id", "ordinal", "p")
    return se.refractory(d, U, ["t_cross", "event_id", "ordinal"], float(TAU), v.ROWS).select("user_id", "event_id", "ordinal", "p")


@query("T3", f"""b AS (SELECT user_id, t_us // {v.DAY_US} AS bin, sum(q) AS s FROM v_events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY bin DESC) AS rn FROM b)
  SELECT user_id, list(round(s, 6) ORDER BY bin) AS ring FROM r WHERE rn <= 8 GROUP BY user_id""", "v_events")
def bin_ring(spark, sf):
    e = v.v_events(spark, sf).select("user_id", ev.bin_of(F.col("t_us"), v.DAY_US).alias("bin"), "q")
    return se.bin_ring(e, U, "bin", "q", 8).withColumn("ring", F.transform("ring", lambda a: F.round(a, 6)))


# -- streams ------------------------------------------------------------------------------

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark, sf):
    return _as_events(spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf))


def _as_events(s):
    k = F.get_json_object("props", "$.k").cast("int")
    i = F.col("event_id")
    return s.select(
        F.col("ts").cast("timestamp").alias("ts"), (v.micros("ts") - F.lit(v.ORIGIN_US)).alias("t_us"), "event_id", "user_id", "value", ((k + 1) / F.lit(100.0)).alias("q"),
        (F.col("user_id") % 4).alias("episode"), F.concat(F.lit("cam"), (F.col("user_id") % 3).cast("string")).alias("camera"),
        F.when(F.col("event_type").isin("click", "purchase", "signup"), 1).otherwise(0).alias("pol"),
        F.floor(((i * 53) % v.HEIGHT) * 3 / v.HEIGHT).cast("int").alias("oy"), F.floor(((i * 37) % v.WIDTH) * 4 / v.WIDTH).cast("int").alias("ox"))


def scattered(spark, sf):
    """The events as a stream of files out of time order, the delay that covers the disorder, a stretch of time to hold,
    and over how many groups to deal the keys.

    A file's times overlap those of the files before and after, and later files come first.
    A last row far ahead (of user -1, in no result) takes the watermark past all others.
    """
    raw, path = v.table(spark, sf, "events"), shared_folder(spark, "scattered")
    t = v.micros("ts")
    lo, hi, n = raw.agg(F.min(t), F.max(t), F.count(F.lit(1))).first()
    lo, hi = lo or 0, hi or 0
    width = (hi - lo) // 4 + 1
    early = F.floor((t - lo + (F.col("event_id") % 8) * width / 16) / width)
    for part in (1, 0, 3, 2):
        raw.where(F.least(early, F.lit(3)) == part).write.mode("append").parquet(path)
    ahead = F.timestamp_micros(F.lit(hi + 3650 * v.DAY_US)).alias("ts")
    end = spark.range(1).select(F.lit(-1).alias("event_id"), ahead, F.lit(-1).alias("user_id"), F.lit("").alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
    end.select([F.col(f.name).cast(f.dataType) for f in raw.schema.fields]).write.mode("append").parquet(path)
    # about eight micro-batches and some 50,000 rows a group, however many files and rows there are
    files = len(spark.read.schema(EVENT_SCHEMA).parquet(path).inputFiles())
    s = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", max(2, -(-files // 8))).parquet(path)
    groups = max(2 * spark.sparkContext.defaultParallelism, -(-n // 50_000))
    return _as_events(s), f"{3 * width // 1_000_000 + 1} seconds", max(width // 2000, 1), groups


@query("T1", f"""SELECT t_us // {v.DAY_US} AS bin, episode, camera, CASE WHEN p > 0 THEN 1 ELSE 0 END AS pol, y * 3 // {v.HEIGHT} AS oy, x * 4 // {v.WIDTH} AS ox, round(sum(q), 6) AS wq FROM v_events GROUP BY ALL""", "v_events")
def stream_voxels(spark, sf):
    """Structured Streaming over the event files, run to the end, equal to the batch result."""
    s = windows.stream_voxels(event_stream(spark, sf), ["episode", "camera"], "1 day", {"wq": F.col("q")}, None)
    d = windows.run_available(s, ["bin_start", "episode", "camera", "pol", "oy", "ox"])
    b = ((F.unix_micros("bin_start") - F.lit(v.ORIGIN_US)) / v.DAY_US).cast("long")
    return d.select(b.alias("bin"), "episode", "camera", "pol", "oy", "ox", F.round("wq", 6).alias("wq"))


@query("T2", f"""SELECT e.episode, e.camera, (8 + 4 * f.k)::BIGINT AS end_day, count(*) AS n, round(sum(q), 6) AS wq FROM v_events e JOIN (SELECT unnest(generate_series(-2::BIGINT, max(t_us) // {4 * v.DAY_US})) AS k FROM v_events) f ON t_us >= (4 * f.k) * {v.DAY_US} AND t_us < (4 * f.k + 8) * {v.DAY_US} GROUP BY ALL""", "v_events")
def stream_history(spark, sf):
    # windows are aligned to the epoch: 19,723 days before the origin, so shift the start by three days
    s = event_stream(spark, sf).withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY"))
    h = windows.stream_history(s, ["episode", "camera"], "8 days", "4 days", {"wq": F.col("q")}, None)
    d = windows.run_available(h, ["window_end", "episode", "camera"])
    end = ((F.unix_micros("window_end") - F.lit(v.ORIGIN_US)) / v.DAY_US - 1).cast("long")
    return d.select("episode", "camera", end.alias("end_day"), "n", F.round("wq", 6).alias("wq"))


@query("T7", "SELECT user_id, max(t_us) AS t_us, arg_max(event_id, (t_us, event_id)) AS event_id, arg_max(value, (t_us, event_id)) AS value FROM v_events GROUP BY user_id", "v_events")
def stream_latest(spark, sf):
    s = windows.stream_latest(event_stream(spark, sf), U, ["t_us", "event_id"], ["value"])
    return windows.run_available(s, U)


@query("T4", f"{ORD}, {enc_sql('od')} {cross_sql()}", "v_events")
def stream_crossings(spark, sf):
    """The online encoder over files out of time order, equal to the batch form."""
    s, delay, span, groups = scattered(spark, sf)
    p = stateful.CrossingEncoder(U, O, "value", 25.0, span=span)
    s = stateful.apply(s.select("ts", *U, *O, "value"), U, p, "user_id bigint, t_us bigint, event_id bigint, p int, ordinal int, t_cross double", event_time=F.col("ts"), delay=delay, groups=groups)
    return windows.run_available(s, ["user_id", "event_id", "ordinal"], "append").withColumn("t_cross", F.round("t_cross", 0))


@query("T4", f"{ORD}, {two_sided_sql()}", "v_events")
def stream_two_sided(spark, sf):
    s, delay, span, groups = scattered(spark, sf)
    p = stateful.TwoSidedEncoder(U, O, "value", "up", "down", span=span)
    s = stateful.apply(thresholds(s.select("ts", *U, *O, "value")), U, p, "user_id bigint, t_us bigint, event_id bigint, p int, ordinal int, t_cross double", event_time=F.col("ts"), delay=delay, groups=groups)
    return windows.run_available(s, ["user_id", "event_id", "ordinal"], "append").withColumn("t_cross", F.round("t_cross", 0))


@query("T5", f"{REFR} SELECT user_id, t_us, event_id FROM rf WHERE kept", "v_events")
def stream_refractory(spark, sf):
    s, delay, span, groups = scattered(spark, sf)
    p = stateful.MinimumGap(O, TAU * 4, ["user_id", "t_us", "event_id"], span)
    s = stateful.apply(s.select("ts", *U, *O), U, p, "user_id bigint, t_us bigint, event_id bigint", event_time=F.col("ts"), delay=delay, groups=groups)
    return windows.run_available(s, ["event_id"], "append")


@query("T3", f"""b AS (SELECT user_id, t_us // {v.DAY_US} AS bin, arg_max(q, (t_us, event_id)) AS s FROM v_events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY bin DESC) AS rn FROM b)
  SELECT user_id, list(s ORDER BY bin) AS ring FROM r WHERE rn <= 8 GROUP BY user_id""", "v_events")
def stream_ring(spark, sf):
    """The newest value of each of the last eight days, kept as state."""
    s = event_stream(spark, sf).select("user_id", ev.bin_of(F.col("t_us"), v.DAY_US).alias("bin"), "t_us", "event_id", "q")
    p = stateful.BinRing(U, "bin", "q", 8, order=["t_us", "event_id"])
    return windows.run_available(stateful.apply(s, U, p, "user_id bigint, ring array<double>"), U, "append")


@query("T6", f"""{ORD}, lp AS (SELECT user_id, rn, event_id, t_us, value AS y FROM od WHERE rn = 1
   UNION ALL SELECT o.user_id, o.rn, o.event_id, o.t_us, l.y + least(greatest(o.t_us - l.t_us, 0) / {float(TAU * 6)}::DOUBLE, 1) * (o.value - l.y)
   FROM lp l JOIN od o ON o.user_id = l.user_id AND o.rn = l.rn + 1) SELECT user_id, event_id, round(y, 6) AS smooth FROM lp""", "v_events")
def stream_lowpass(spark, sf):
    s, delay, span, groups = scattered(spark, sf)
    p = stateful.LowPass(O, "value", TAU * 6, ["user_id", "event_id"], span)
    s = stateful.apply(s.select("ts", *U, *O, "value"), U, p, "user_id bigint, event_id bigint, smooth double", event_time=F.col("ts"), delay=delay, groups=groups)
    return windows.run_available(s, ["event_id"], "append").withColumn("smooth", F.round("smooth", 6))


@query("T8", f"""SELECT user_id, step, max(chunk) AS from_chunk, max(chunk) / 2::DOUBLE AS value FROM (SELECT user_id, t_us // {v.DAY_US} AS step, event_id % 30 AS chunk FROM v_events)
  WHERE step >= chunk GROUP BY ALL""", "v_events")
def stream_merge(spark, sf):
    """Steps proposed by chunks of several ages: the newest wins. A step is handed out, and leaves the state, when its day has passed."""
    e, delay, _, groups = scattered(spark, sf)
    s = e.select("ts", "user_id", ev.bin_of(F.col("t_us"), v.DAY_US).alias("step"), (F.col("event_id") % 30).alias("chunk"), ((F.col("event_id") % 30) / 2).alias("value"))
    p = stateful.ChunkMerge(U, "step", "chunk", "value", v.DAY_US // 1000, v.ORIGIN_US // 1000)
    m = stateful.apply(s, U, p, "user_id bigint, step bigint, from_chunk bigint, value double", event_time=F.col("ts"), delay=delay, groups=groups)
    return windows.run_available(m, ["user_id", "step"], "append")
