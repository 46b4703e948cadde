"""Registered queries over trajectories, samples and trials."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions import rotation as rot
from eventloom.functions import sql as sqlf
from eventloom.functions import vectors as vec
from eventloom.operators import chunked
from eventloom.operators import frames as fr
from eventloom.plans import views as v
from eventloom.plans.registry import query

E = ["episode"]
C = rot.cols
POS, Q = ("ee_x", "ee_y", "ee_z"), ("qw", "qx", "qy", "qz")

# the same formulas as SQL text -----------------------------------------------------------
TP = "(2 * pi())"


def s_mod(e):
    return f"(({e}) - floor(({e}) / {TP}) * {TP})"


ROLL = s_mod("atan2(2 * (qw * qx + qy * qz), 1 - 2 * (qx * qx + qy * qy))")
PITCH = "asin(least(greatest(2 * (qw * qy - qz * qx), -1.0::DOUBLE), 1.0::DOUBLE))"
YAW = s_mod("atan2(2 * (qw * qz + qx * qy), 1 - 2 * (qy * qy + qz * qz))")
STATE = f"st AS (SELECT *, [ee_x, ee_y, ee_z, {ROLL}, {PITCH}, {YAW}] AS state, [ee_x * 1.1::DOUBLE, ee_y * 0.9::DOUBLE, ee_z, {YAW}, {PITCH}, {ROLL}, gripper] AS action FROM v_frames)"
R6 = "list_transform({0}, lambda a: round(a, 6) + 0.0::DOUBLE)"


def s_cross(a, b):
    return [f"(({a[1]}) * ({b[2]}) - ({a[2]}) * ({b[1]}))", f"(({a[2]}) * ({b[0]}) - ({a[0]}) * ({b[2]}))", f"(({a[0]}) * ({b[1]}) - ({a[1]}) * ({b[0]}))"]


def s_rot(q, u):
    t = [f"(2 * {c})" for c in s_cross(q[1:], u)]
    k = s_cross(q[1:], t)
    return [f"(({u[i]}) + ({q[0]}) * {t[i]} + {k[i]})" for i in range(3)]


def s_inv(q, u):
    return s_rot([q[0], *[f"(-{c})" for c in q[1:]]], u)


def s_norm(u):
    return "sqrt(" + " + ".join(f"pow({c}, 2)" for c in u) + ")"


def states(spark, sf):
    f = v.v_frames(spark, sf)
    q = C(*Q)
    roll, pitch, yaw = rot.euler(q)
    return f.withColumns({
        "state": vec.make_state(C(*POS), q),
        "action": F.array(F.col("ee_x") * 1.1, F.col("ee_y") * 0.9, F.col("ee_z"), yaw, pitch, roll, F.col("gripper")),
    })


@query("F1 F7", f"""SELECT episode, frame_index, round({ROLL}, 6) AS roll, round({PITCH}, 6) AS pitch, round({YAW}, 6) AS yaw FROM v_frames""", "v_frames")
def quat_to_euler(spark, sf):
    s = states(spark, sf).select("episode", "frame_index", "state")
    return s.select("episode", "frame_index", *[F.round(F.col("state")[i], 6).alias(n) for i, n in ((3, "roll"), (4, "pitch"), (5, "yaw"))])


@query("F2", """SELECT episode, frame_index, """ + ", ".join(
    f"round(CASE WHEN sqrt(1 - qw * qw) < 1e-8 THEN 0.0 ELSE {a} / sqrt(1 - qw * qw) * 2 * acos(qw) END, 6) AS r{a[1]}" for a in Q[1:]) + " FROM v_frames", "v_frames")
def quat_to_rotvec(spark, sf):
    r = rot.rotvec(C(*Q))
    return v.v_frames(spark, sf).select("episode", "frame_index", *[F.round(c, 6).alias(n) for c, n in zip(r, ("rx", "ry", "rz"))])


@query("F3", """SELECT episode, frame_index, round(qw, 6) AS ew, round(qx, 6) AS ex, round(qy, 6) AS ey, round(qz, 6) AS ez,
  round(qw, 6) AS vw, round(qx, 6) AS vx, round(qy, 6) AS vy, round(qz, 6) AS vz FROM v_frames""", "v_frames")
def to_quat(spark, sf):
    """Through Euler angles and through axis-angle and back: the scalar part is positive here, so both return the input."""
    q = C(*Q)
    a, b = rot.from_euler(rot.euler(q)), rot.from_rotvec(rot.rotvec(q))
    return v.v_frames(spark, sf).select("episode", "frame_index",
        *[F.round(c * F.when(a[0] < 0, -1).otherwise(1), 6).alias(n) for c, n in zip(a, ("ew", "ex", "ey", "ez"))],
        *[F.round(c, 6).alias(n) for c, n in zip(b, ("vw", "vx", "vy", "vz"))])


@query("F4", "SELECT episode, frame_index, " + ", ".join(f"round({c}, 9) AS {n}" for c, n in zip(s_inv(Q, ["obj_x", "obj_y", "obj_z"]), ("rx", "ry", "rz")))
       + ", round(qw * qw - qx * qx - qy * qy - qz * qz, 9) AS sw, round(2 * qw * qx, 9) AS sx, round(2 * qw * qy, 9) AS sy, round(2 * qw * qz, 9) AS sz FROM v_frames", "v_frames")
def relative_pose(spark, sf):
    q = C(*Q)
    r, s = rot.rotate_inv(q, C("obj_x", "obj_y", "obj_z")), rot.mul(q, q)
    return v.v_frames(spark, sf).select("episode", "frame_index", *[F.round(c, 9).alias(n) for c, n in zip([*r, *s], ("rx", "ry", "rz", "sw", "sx", "sy", "sz"))])


WRAPPED = f"list_transform(range(1, 7), lambda i: CASE WHEN i >= 4 THEN {s_mod('action[i] - state[i] + pi()')} - pi() ELSE action[i] - state[i] END)"


@query("F5", f"""{STATE} SELECT episode, frame_index, {R6.format(f'list_append({WRAPPED}, gripper)')} AS delta FROM st""", "v_frames")
def delta_action(spark, sf):
    d = vec.delta_action(F.col("action"), F.col("state"))
    return states(spark, sf).select("episode", "frame_index", vec.rounded(d).alias("delta"))


@query("F6", f"""{STATE} SELECT episode, frame_index, {R6.format('action')} AS action FROM st""", "v_frames")
def undo_delta(spark, sf):
    d = vec.undelta(vec.delta_action(F.col("action"), F.col("state"), wrap=False), F.col("state"))
    return states(spark, sf).select("episode", "frame_index", vec.rounded(d).alias("action"))


@query("A20 F8", f"""{STATE}, s AS (SELECT {', '.join(f'avg(state[{i}]) AS m{i}, greatest(stddev_pop(state[{i}]), 1e-6) AS d{i}' for i in range(1, 7))} FROM st)
  SELECT episode, frame_index, [{', '.join(f'round((state[{i}] - m{i}) / d{i}, 5) + 0.0::DOUBLE' for i in range(1, 7))}] AS z FROM st, s""", "v_frames")
def zscore(spark, sf):
    st = states(spark, sf).select("episode", "frame_index", "state")
    s = fr.stat_vectors(fr.vector_stats(st, "state", 6), 6).scalar()
    z = [F.round((F.col("state")[i] - s["mean"][i]) / s["std"][i], 5) + F.lit(0.0) for i in range(6)]
    return st.select("episode", "frame_index", F.array(*z).alias("z"))


@query("F9", f"""{STATE} SELECT episode, frame_index, {R6.format('list_concat(state, [0.0::DOUBLE, 0, 0, 0])')} AS padded FROM st""", "v_frames")
def pad_vector(spark, sf):
    return states(spark, sf).select("episode", "frame_index", vec.rounded(vec.pad_vector(F.col("state"), 10)).alias("padded"))


@query("A20", f"""{STATE}, x AS (SELECT i - 1 AS dim, state[i] AS v FROM st, generate_series(1, 6) g(i))
  SELECT dim::INT AS dim, round(avg(v), 6) AS mean, round(greatest(stddev_pop(v), 1e-6), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, count(*) AS n FROM x GROUP BY dim""", "v_frames")
def vector_stats(spark, sf):
    s = fr.vector_stats(states(spark, sf), "state", 6)
    return s.select("dim", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")], "n")


@query("A21", f"""{STATE}, x AS (SELECT i - 1 AS dim, state[i] AS v FROM st, generate_series(1, 6) g(i))
  SELECT dim::INT AS dim, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, count(*) AS n FROM x GROUP BY dim""", "v_frames")
def merge_stats(spark, sf):
    """Statistics per part, then merged: equal to the statistics of the whole."""
    part = states(spark, sf).withColumn("part", F.col("episode") % 64)
    s = fr.merge_stats(fr.vector_stats(part, "state", 6, ["part"], floor=None))
    return s.select("dim", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")], F.col("n").cast("long").alias("n"))


@query("A22", f"""{STATE}, x AS (SELECT i - 1 AS dim, CASE WHEN i % 2 = 0 THEN 0 ELSE state[i] END AS v FROM st, generate_series(1, 6) g(i))
  SELECT dim::INT AS dim, round(avg(v), 6) AS mean, round(CASE WHEN abs(avg(v)) < 1e-6 AND stddev_pop(v) < 1e-6 THEN 1.0 ELSE stddev_pop(v) END, 6) AS std FROM x GROUP BY dim""", "v_frames")
def fix_zero_std(spark, sf):
    st = states(spark, sf).withColumn("z", F.transform("state", lambda a, i: F.when(i % 2 == 1, F.lit(0.0)).otherwise(a)))
    s = fr.fix_zero_std(fr.vector_stats(st, "z", 6, floor=None))
    return s.select("dim", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


OUTCOME = f"""oc AS (
  SELECT episode, count(*) AS frames, count(*) FILTER (gripper < 0) AS close_frames, min(frame_index) FILTER (gripper < 0) AS first_close,
   min({s_norm(['ee_x - obj_x', 'ee_y - obj_y', 'ee_z - obj_z'])}) AS min_distance, arg_min(obj_z, frame_index) AS z_first, arg_max(obj_z, frame_index) AS z_last, max(obj_z) AS z_max
  FROM v_frames GROUP BY episode),
  o AS (SELECT *, z_max - z_first AS lift, close_frames > 0 AND z_max - z_first >= 0.1::DOUBLE AS success FROM oc),
  oo AS (SELECT *, CASE WHEN success THEN 'grasp_success' WHEN z_last < z_first - 0.05::DOUBLE THEN 'object_fell' WHEN close_frames = 0 THEN 'missed_object_or_timeout' ELSE 'grasp_failed' END AS reason FROM o)"""


@query("P11 A31", f"""{OUTCOME} SELECT episode, frames, close_frames, first_close, round(min_distance, 9) AS min_distance, round(lift, 9) AS lift, success, reason FROM oo""", "v_frames")
def label_outcome(spark, sf):
    o = fr.label_outcome(v.v_frames(spark, sf), E)
    return o.select("episode", "frames", "close_frames", "first_close", F.round("min_distance", 9).alias("min_distance"), F.round("lift", 9).alias("lift"), "success", "reason")


@query("P12", f"""{OUTCOME} SELECT CASE WHEN success THEN 'success' ELSE 'failure' END AS outcome_split, reason, count(*) AS n FROM oo GROUP BY ALL""", "v_frames")
def route_outcome(spark, sf):
    o = fr.label_outcome(v.v_frames(spark, sf), E)
    return o.groupBy(F.when(F.col("success"), "success").otherwise("failure").alias("outcome_split"), "reason").agg(F.count(F.lit(1)).alias("n"))


@query("P9", "SELECT sample_index, success FROM v_samples WHERE success IS NOT FALSE AND sample_index IN (SELECT l_orderkey FROM lineitem)", "v_samples")
def exclude_failures(spark, sf):
    files = v.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sample_index"))
    return fr.only_present(fr.exclude_failures(v.v_samples(spark, sf)), files, "sample_index").select("sample_index", "success")


@query("P10 W11", """SELECT s.sample_index, CASE WHEN split IN ('train','test') THEN split WHEN (sample_index + 1) % 10 = 0 THEN 'test' ELSE 'train' END AS by_index,
  CASE WHEN (row_number() OVER (ORDER BY sample_index)) % 10 = 0 THEN 'test' ELSE 'train' END AS by_position,
  CASE WHEN sample_index % 1000 = 0 THEN 'test' ELSE 'train' END AS by_thousand FROM v_samples s""", "v_samples")
def assign_split(spark, sf):
    s = v.v_samples(spark, sf)
    a = fr.assign_split(s, 10).withColumnRenamed("ml_split", "by_index")
    a = fr.assign_split(a, 10, "position", width=100_000).withColumnRenamed("ml_split", "by_position")
    a = fr.assign_split(a, 10, "thousand").withColumnRenamed("ml_split", "by_thousand")
    return a.select("sample_index", "by_index", "by_position", "by_thousand")


GOAL, BASE = (0.5, 0.5, 0.4), (0.1, 0.0, 0.0)


@query("P13", f"""SELECT episode, frame_index, {s_norm(['ee_x - obj_x', 'ee_y - obj_y', 'ee_z - obj_z'])} < 0.6::DOUBLE AND
  {s_norm([f'{g}::DOUBLE - {c}' for g, c in zip(GOAL, s_inv(Q, [f'ee_x - {BASE[0]}::DOUBLE', 'ee_y', 'ee_z']))])} < 0.6::DOUBLE AS picked FROM v_frames""", "v_frames")
def is_picked(spark, sf):
    p = fr.is_picked(C("obj_x", "obj_y", "obj_z"), C(*POS), [F.lit(g) for g in GOAL], [F.lit(b) for b in BASE], C(*Q), 0.6)
    return v.v_frames(spark, sf).select("episode", "frame_index", p.alias("picked"))


def _placed_sql():
    size, csize, cpos = ("0.2::DOUBLE", "0.3::DOUBLE", "0.4::DOUBLE"), ("0.8::DOUBLE", "0.6::DOUBLE", "0.5::DOUBLE"), ("0.5::DOUBLE", "0.5::DOUBLE", "0.3::DOUBLE")
    edge = lambda s: [[s[0], "0", "0"], ["0", s[1], "0"], ["0", "0", s[2]]]
    base = ("0.8::DOUBLE", "0", "0", "0.6::DOUBLE")
    box = [s_inv(base, s_rot(Q, e)) for e in edge(size)]
    cbox = [s_inv(base, e) for e in edge(csize)]
    half = [[f"({c} / 2 + 0.015::DOUBLE)" for c in a] for a in cbox]
    rel = [f"({a} - {b})" for a, b in zip(("obj_x", "obj_y", "obj_z"), cpos)]
    w = [f"abs(({a[0]} * {rel[0]} + {a[1]} * {rel[1]} + {a[2]} * {rel[2]}) / {s_norm(a)}) <= {s_norm(a)}" for a in half[:2]]
    low = "obj_z - (" + " + ".join(f"abs({e[2]} / 2)" for e in box) + ")"
    rim = f"{cpos[2]} + " + " + ".join(f"abs({a[2]})" for a in half)
    return f"({w[0]}) AND ({w[1]}) AND ({low} <= {rim})"


@query("P14", f"""SELECT episode, bool_and({_placed_sql()} AND {s_norm([f'{g}::DOUBLE - {c}' for g, c in zip(GOAL, POS)])} < 2) AS placed FROM v_frames GROUP BY episode""", "v_frames")
def is_placed(spark, sf):
    base = [F.lit(0.8), F.lit(0.0), F.lit(0.0), F.lit(0.6)]
    unit = [F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)]
    box = fr.box_axes([F.lit(0.2), F.lit(0.3), F.lit(0.4)], C(*Q), base)
    cbox = fr.box_axes([F.lit(0.8), F.lit(0.6), F.lit(0.5)], unit, base)
    p = fr.is_placed(C("obj_x", "obj_y", "obj_z"), box, [F.lit(0.5), F.lit(0.5), F.lit(0.3)], cbox)
    at_goal = rot.norm(rot.sub([F.lit(g) for g in GOAL], C(*POS))) < 2
    return v.v_frames(spark, sf).groupBy("episode").agg(F.bool_and(p & at_goal).alias("placed"))


@query("P15", """SELECT scene, bool_or(pz < 0.1::DOUBLE) AS dropped, bool_or(sqrt(px * px + py * py + pz * pz) > 1.3::DOUBLE) AS unreachable FROM v_objects GROUP BY scene""", "v_objects")
def drop_and_reach(spark, sf):
    return fr.drop_and_reach(v.v_objects(spark, sf), ["scene"], 0.1, 1.3)


def s_dir(x, y):
    a = f"(degrees(atan2({y}, {x})) - floor(degrees(atan2({y}, {x})) / 360) * 360)"
    steps = " ".join(f"WHEN {a} < {hi} THEN {i}" for i, hi in enumerate((75, 105, 165, 195, 255, 285, 345), 1))
    return f"CASE WHEN {a} >= 345 OR {a} < 15 THEN 0 {steps} END"


@query("P16 P17", f"""f AS (SELECT *, sqrt(vel_x * vel_x + vel_y * vel_y) AS s, {s_dir('vel_x', 'vel_y')} AS d FROM v_frames WHERE frame_index < 25)
  SELECT episode, arg_min(s, frame_index) > 0.01::DOUBLE AND min(s) < 0.01::DOUBLE AS stopped, min(d) <> arg_min(d, frame_index) OR max(d) <> arg_min(d, frame_index) AS turned,
   CASE WHEN min(d) <> arg_min(d, frame_index) OR max(d) <> arg_min(d, frame_index) THEN ['the tallest can'] ELSE ['the tallest can', 'the can moving in the robot''s left direction'] END AS tags
  FROM f GROUP BY episode""", "v_frames")
def early_motion(spark, sf):
    tags = F.array(F.lit("the tallest can"), F.lit("the can moving in the robot's left direction"))
    return fr.early_motion(v.v_frames(spark, sf), E).withColumn("tags", fr.drop_direction_tags(tags, F.col("turned")))


@query("F18", f"SELECT scene, slot, ({s_dir('vx', 'vy')})::INT AS direction FROM v_objects", "v_objects")
def direction_index(spark, sf):
    return v.v_objects(spark, sf).select("scene", "slot", rot.direction_index(F.col("vx"), F.col("vy")).alias("direction"))


@query("P18 P19", """SELECT episode, n_frames, status FROM (SELECT episode, count(*) AS n_frames, max(task_index) % 3 AS status, bool_or(gripper < 0) AS done FROM v_frames GROUP BY episode)
  WHERE done AND n_frames > 1 AND status <> 2""", "v_frames")
def finished_runs(spark, sf):
    g = v.v_frames(spark, sf).groupBy("episode").agg(F.count(F.lit(1)).alias("n_frames"), (F.max("task_index") % 3).alias("status"), F.bool_or(F.col("gripper") < 0).alias("done"))
    return g.where(F.col("done") & (F.col("n_frames") > 1) & (F.col("status") != 2)).drop("done")


@query("P23", """SELECT (i - 1)::INT AS env, vec_id AS step, round(embedding[i]::DOUBLE, 6) AS obj_z, CASE WHEN embedding[i] > 0 THEN round(embedding[i]::DOUBLE * 2, 6) END AS speed, NULL::INT AS absent
  FROM embeddings, generate_series(1, 64) g(i)""")
def flatten_steps(spark, sf):
    e = v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("step"), F.transform(
        "embedding", lambda a: F.struct(F.round(a.cast("double"), 6).alias("obj_z"), F.when(a > 0, F.round(a.cast("double") * 2, 6)).alias("speed"))).alias("envs"))
    return fr.flatten_steps(e, "step", "envs", ["obj_z", "speed", "absent"]).withColumn("absent", F.col("absent").cast("int"))


SEG = """lg AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_type, CASE WHEN value >= 20 THEN value END AS value FROM events),
  s1 AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER w AS segment,
     last_value(CASE WHEN event_type = 'signup' THEN 1 WHEN event_type = 'error' THEN 0 END IGNORE NULLS) OVER w AS open FROM lg
     WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)),
  sg AS (SELECT * FROM s1 WHERE open = 1)"""


def log_segments(spark, sf):
    e = v.table(spark, sf, "events").select("user_id", "event_id", v.micros("ts").alias("t"), "event_type", F.when(F.col("value") >= 20, F.col("value")).alias("value"))
    return fr.segments(e, ["user_id"], ["t", "event_id"], F.col("event_type") == "signup", F.col("event_type") == "error", v.ROWS)


@query("W15", f"WITH {SEG} SELECT event_id, user_id, segment::BIGINT AS segment FROM sg")
def log_segment_rows(spark, sf):
    return log_segments(spark, sf).select("event_id", "user_id", "segment")


@query("P24", f"""WITH {SEG} SELECT event_id, user_id, segment::BIGINT AS segment FROM (SELECT *, row_number() OVER (PARTITION BY user_id, segment ORDER BY t, event_id) AS rn FROM sg WHERE value IS NOT NULL) WHERE rn > 3""")
def usable_steps(spark, sf):
    return fr.usable_steps(log_segments(spark, sf), ["user_id"], ["t", "event_id"], ["value"], 3, v.ROWS).select("event_id", "user_id", "segment")


@query("J8", """n AS (SELECT episode, max(frame_index) AS last FROM v_frames GROUP BY episode),
  w AS (SELECT f.episode, f.frame_index, d.d AS delta, least(greatest(frame_index + d.d, 0), last) AS at_frame, frame_index + d.d < 0 OR frame_index + d.d > last AS is_pad
        FROM v_frames f JOIN n USING (episode) CROSS JOIN (VALUES (-2), (0), (1)) d(d))
  SELECT w.episode, w.frame_index, w.delta, w.at_frame, w.is_pad, f.gripper FROM w JOIN v_frames f ON f.episode = w.episode AND f.frame_index = w.at_frame""", "v_frames")
def history(spark, sf):
    return fr.history(v.v_frames(spark, sf), E, [-2, 0, 1], ["gripper"])


@query("J9", """n AS (SELECT episode, count(*) AS n FROM v_frames GROUP BY episode),
  p AS (SELECT f.episode, frame_index, n, frame_index + 2.5::DOUBLE AS pos FROM v_frames f JOIN n USING (episode)),
  q AS (SELECT episode, frame_index, least(greatest(floor(pos), 0), n - 1)::BIGINT AS "left", least(greatest(ceil(pos), 0), n - 1)::BIGINT AS "right",
        CASE WHEN ceil(pos) < n THEN pos - floor(pos) ELSE 0.0 END::DOUBLE AS alpha, ceil(pos) < n AS valid FROM p)
  SELECT q.*, round((1 - alpha) * a.obj_z + alpha * b.obj_z, 9) AS blended FROM q JOIN v_frames a ON a.episode = q.episode AND a.frame_index = q."left"
  JOIN v_frames b ON b.episode = q.episode AND b.frame_index = q."right" """, "v_frames")
def future_blend(spark, sf):
    return fr.future_blend(v.v_frames(spark, sf), E, 10, 0.01, 25.0, "obj_z").withColumn("blended", F.round("blended", 9))


@query("J10", """n AS (SELECT episode, max(frame_index) AS last FROM v_frames GROUP BY episode),
  w AS (SELECT episode, frame_index, timestamp + CASE WHEN frame_index % 2 = 0 THEN 0.00005 ELSE 0.0005 END::DOUBLE AS want, last FROM v_frames JOIN n USING (episode)),
  m AS (SELECT *, least(greatest(round_even(want * 25, 0)::BIGINT, 0), last) AS at FROM w)
  SELECT m.episode, m.frame_index, m.at AS matched, abs(f.timestamp - want) < 1e-4::DOUBLE AS within FROM m JOIN v_frames f ON f.episode = m.episode AND f.frame_index = m.at""", "v_frames")
def match_nearest(spark, sf):
    f = v.v_frames(spark, sf)
    w = f.select("episode", "frame_index", (F.col("timestamp") + F.when(F.col("frame_index") % 2 == 0, 0.00005).otherwise(0.0005)).alias("want"))
    return fr.match_nearest(w, f, E, "want", 25.0, 1e-4).drop("want")


@query("J11 W11", """e AS (SELECT l_orderkey AS episode, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT *, sum(n) OVER (ORDER BY episode) AS e1 FROM e),
  w AS (SELECT o_orderkey * 3 AS row_index FROM orders)
  SELECT row_index, episode, (row_index - (e1 - n))::BIGINT AS frame_index FROM w JOIN r ON row_index >= e1 - n AND row_index < e1""".replace("e AS (", "WITH e AS (", 1))
def locate(spark, sf):
    e = v.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("episode")).agg(F.count(F.lit(1)).alias("n"))
    w = v.table(spark, sf, "orders").select((F.col("o_orderkey") * 3).alias("row_index"))
    return fr.locate(w, e, 1024)


_EQ = "SELECT episode, frame_index, obj_z, gripper, state FROM st"


@query("J13", f"""{STATE}, a AS ({_EQ}), b AS (SELECT * REPLACE (CASE WHEN episode % 7 = 0 THEN obj_z + 0.01::DOUBLE ELSE obj_z END AS obj_z, CASE WHEN episode % 5 = 0 THEN list_transform(state, lambda x: x * 2) ELSE state END AS state)
    FROM ({_EQ}) WHERE NOT (episode % 11 = 0 AND frame_index = 0))
  SELECT episode, count(*) FILTER (a.obj_z IS NULL OR b.obj_z IS NULL) AS unmatched,
   bool_and(b.obj_z IS NOT NULL AND a.obj_z IS NOT NULL AND a.obj_z = b.obj_z) AS obj_z_exact, round(avg(abs(a.obj_z - b.obj_z)), 6) AS obj_z_mae, round(avg((a.obj_z = b.obj_z)::INT), 6) AS obj_z_equal_share,
   bool_and(b.obj_z IS NOT NULL AND a.obj_z IS NOT NULL AND a.gripper = b.gripper) AS gripper_exact, round(avg(abs(a.gripper - b.gripper)), 6) AS gripper_mae, round(avg((a.gripper = b.gripper)::INT), 6) AS gripper_equal_share,
   bool_and(b.obj_z IS NOT NULL AND a.obj_z IS NOT NULL AND a.state = b.state) AS state_exact, round(avg(({' + '.join(f'abs(a.state[{k}] - b.state[{k}])' for k in range(1, 7))}) / 6), 6) AS state_mae, round(avg((a.state = b.state)::INT), 6) AS state_equal_share
  FROM a FULL JOIN b USING (episode, frame_index) GROUP BY episode""", "v_frames")
def consistency(spark, sf):
    cols = ["obj_z", "gripper", "state"]
    a = states(spark, sf).select("episode", "frame_index", *cols)
    b = a.where(~((F.col("episode") % 11 == 0) & (F.col("frame_index") == 0))).withColumns({
        "obj_z": F.when(F.col("episode") % 7 == 0, F.col("obj_z") + 0.01).otherwise(F.col("obj_z")),
        "state": F.when(F.col("episode") % 5 == 0, F.transform("state", lambda x: x * 2)).otherwise(F.col("state"))})
    d = fr.consistency(a, b, ["episode", "frame_index"], cols, E)
    return d.withColumns({c: F.round(c, 6) for c in d.columns if c.endswith(("_mae", "_share"))})


@query("J18", """SELECT task_index, task, count(*) AS n FROM v_frames JOIN (SELECT item_id AS task_index, left(text, 12) AS task FROM benchmark) USING (task_index) GROUP BY ALL""", "v_frames")
def attach_task(spark, sf):
    t = v.table(spark, sf, "benchmark").select(F.col("item_id").alias("task_index"), F.left("text", F.lit(12)).alias("task"))
    return v.v_frames(spark, sf).join(t, "task_index").groupBy("task_index", "task").agg(F.count(F.lit(1)).alias("n"))


CHUNK = "arr AS (SELECT episode, frame_index, list(gripper * obj_x) OVER (PARTITION BY episode ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS got FROM v_frames)"


@query("W1", f"""{CHUNK} SELECT episode, frame_index, list_transform(range(1, 6), lambda i: got[least(i, len(got))]) AS chunk, list_transform(range(0, 5), lambda i: i >= len(got)) AS is_pad FROM arr""", "v_frames")
def action_chunk(spark, sf):
    f = v.v_frames(spark, sf).select("episode", "frame_index", (F.col("gripper") * F.col("obj_x")).alias("a"))
    return fr.action_chunk(f, E, 5, "a", block=8).drop("a")


@query("W3", """SELECT episode, bool_and(abs(ts - k / 25.0::DOUBLE) <= 1e-6 + 1e-5 * abs(k / 25.0::DOUBLE)) AS ok FROM
  (SELECT episode, timestamp + CASE WHEN episode % 5 = 0 AND frame_index = 1 THEN 0.001 ELSE 0 END::DOUBLE AS ts, row_number() OVER (PARTITION BY episode ORDER BY frame_index) - 1 AS k FROM v_frames) GROUP BY episode""", "v_frames")
def timebase_ok(spark, sf):
    f = v.v_frames(spark, sf).withColumn("timestamp", F.col("timestamp") + F.when((F.col("episode") % 5 == 0) & (F.col("frame_index") == 1), 0.001).otherwise(0.0))
    return fr.timebase_ok(f, E, 25.0)


@query("W4", f"""SELECT episode, frame_index, round({s_norm([f'{c} - lag({c}) OVER w' for c in POS])}, 6) AS step FROM v_frames WINDOW w AS (PARTITION BY episode ORDER BY frame_index)""", "v_frames")
def step_norm(spark, sf):
    f = v.v_frames(spark, sf).select("episode", "frame_index", *POS)
    return fr.step_norm(f, E, "frame_index", list(POS), 16).select("episode", "frame_index", F.round("step", 6).alias("step"))


TRIAL = """st AS (SELECT *, sqrt(pow(px - lag(px) OVER w, 2) + pow(py - lag(py) OVER w, 2) + pow(pz - lag(pz) OVER w, 2)) AS step_len FROM v_trials WINDOW w AS (PARTITION BY trial ORDER BY step)),
  tr AS (SELECT env, trial, count(*) AS steps, count(*) FILTER (role = 'assistant') AS actions, coalesce(sum(step_len), 0) AS path, bool_or(success) AS success FROM st GROUP BY ALL)"""


@query("A25 W8", f"""{TRIAL} SELECT env, count(*) AS n_tests, round(avg(success::INT), 6) AS success_rate, round(avg(steps), 6) AS avg_steps, round(avg(actions), 6) AS avg_actions, round(avg(path), 6) AS avg_path_length FROM tr GROUP BY env""", "v_trials")
def trial_stats(spark, sf):
    d = fr.trial_stats(v.v_trials(spark, sf), ["trial"], "env", "step", ["px", "py", "pz"], F.col("role") == "assistant", 4)
    return d.select("env", "n_tests", *[F.round(c, 6).alias(c) for c in d.columns if c not in ("env", "n_tests")])


@query("W8", f"{TRIAL} SELECT trial, round(path, 6) AS path_length FROM tr", "v_trials")
def path_length(spark, sf):
    d = fr.step_norm(v.v_trials(spark, sf), ["trial"], "step", ["px", "py", "pz"], 4, "move")
    return d.groupBy("trial").agg(F.round(F.coalesce(F.sum("move"), F.lit(0.0)), 6).alias("path_length"))


@query("A27", f"""{TRIAL} SELECT round(avg(sr), 6) AS overall_success, round(avg(st), 6) AS overall_steps FROM (SELECT env, avg(success::INT) AS sr, avg(steps) AS st FROM tr GROUP BY env)""", "v_trials")
def macro_mean(spark, sf):
    d = fr.trial_stats(v.v_trials(spark, sf), ["trial"], "env", "step", ["px", "py", "pz"], F.col("role") == "assistant", 4)
    return d.agg(F.round(F.avg("success_rate"), 6).alias("overall_success"), F.round(F.avg("avg_steps"), 6).alias("overall_steps"))


@query("A28", """SELECT l_returnflag AS part, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS weighted_mean, round(avg(abs(l_discount - l_tax)), 6) AS mae FROM lineitem GROUP BY 1""")
def loss_means(spark, sf):
    li = v.table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "part")
    a = fr.weighted_mean(li, ["part"], "l_extendedprice", "l_quantity").withColumn("weighted_mean", F.round("weighted_mean", 4))
    return a.join(li.groupBy("part").agg(F.round(F.avg(F.abs(F.col("l_discount") - F.col("l_tax"))), 6).alias("mae")), "part")


@query("A23", """SELECT coalesce(split, 'none') AS split, count(*) AS samples, sum(size_bytes)::BIGINT AS bytes, max(lpad(sample_index::VARCHAR, 6, '0')) AS last_sample,
  round(least(100, sum(size_bytes) / 1e9 * 100), 6) AS progress_percent FROM v_samples GROUP BY ALL""", "v_samples")
def dataset_status(spark, sf):
    s = v.v_samples(spark, sf).withColumn("split", F.coalesce("split", F.lit("none")))
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("samples"), F.sum("size_bytes").alias("bytes"), F.max(F.lpad(F.col("sample_index").cast("string"), 6, "0")).alias("last_sample"),
                                  F.round(F.least(F.lit(100.0), F.sum("size_bytes") / 1e9 * 100), 6).alias("progress_percent"))


@query("A24", """SELECT count(*) AS samples, (SELECT count(*) FROM lineitem) AS frames, (SELECT count(*) FROM events) AS events, sum(size_bytes)::BIGINT AS bytes, count(*) FILTER (success) AS success_samples,
  count(*) FILTER (success = false) AS failure_samples FROM v_samples""", "v_samples")
def validation_report(spark, sf):
    n = lambda t: v.table(spark, sf, t).agg(F.count(F.lit(1))).scalar()
    return v.v_samples(spark, sf).agg(F.count(F.lit(1)).alias("samples"), F.sum("size_bytes").alias("bytes"), F.count_if("success").alias("success_samples"),
                                      F.count_if(F.col("success") == F.lit(False)).alias("failure_samples")).select(
        "samples", n("lineitem").alias("frames"), n("events").alias("events"), "bytes", "success_samples", "failure_samples")


@query("T9", f"""{STATE} SELECT a.episode, a.frame_index, a.frame_index // 3 * 3 AS anchor, (a.frame_index % 3)::INT AS "offset",
  {R6.format('list_append([a.action[i] + s.state[i] for i in range(1, 7)], a.action[7])')} AS action FROM st a JOIN st s ON s.episode = a.episode AND s.frame_index = a.frame_index // 3 * 3""", "v_frames")
def replay(spark, sf):
    return fr.replay(states(spark, sf), E, 3, "action", "state").withColumn("action", vec.rounded(F.col("action")))


@query("T8", """c AS (SELECT trial, step AS chunk, step + o.o AS step, round(px + o.o / 100.0::DOUBLE, 6) AS value FROM v_trials CROSS JOIN generate_series(-1, 3) o(o))
  SELECT trial, step, max(chunk) AS from_chunk, arg_max(value, chunk) AS value FROM c WHERE step >= chunk GROUP BY ALL""", "v_trials")
def merge_chunks(spark, sf):
    r = v.v_trials(spark, sf).withColumn("o", F.explode(F.sequence(F.lit(-1), F.lit(3)))).select("trial", F.col("step").alias("chunk"), (F.col("step") + F.col("o")).alias("step"), F.round(F.col("px") + F.col("o") / 100, 6).alias("value"))
    return fr.merge_chunks(r, ["trial"], "step", "chunk", "value")


@query("K8", "SELECT user_id, max(epoch_us(ts)) AS t, arg_max(event_id, (epoch_us(ts), event_id)) AS event_id, arg_max(value, (epoch_us(ts), event_id)) AS value FROM events GROUP BY user_id")
def latest_by_key(spark, sf):
    e = v.table(spark, sf, "events").withColumn("t", v.micros("ts"))
    return fr.latest_by_key(e, ["user_id"], ["t", "event_id"], ["value"])


_QV = ["qx", "qy", "qz"]
S_INVV = s_inv(["qw", *_QV], ["obj_x", "obj_y", "obj_z"])


@query("F2 F4 F5 F6 F8 F9 F12 F14 F18", f"""{STATE} SELECT episode, frame_index, {R6.format(f'[{", ".join(S_INVV)}]')} AS seen,
  {R6.format('[' + ', '.join(f'CASE WHEN sqrt(1 - least(qw * qw, 1)) < 1e-8 THEN 0 ELSE {c} / sqrt(1 - least(qw * qw, 1)) * 2 * acos(least(greatest(qw, -1), 1)) END' for c in _QV) + ']')} AS axis_angle,
  {R6.format(f'[qw * qw - qx * qx - qy * qy - qz * qz, 2 * qw * qx, 2 * qw * qy, 2 * qw * qz]')} AS twice, {R6.format(f'list_append({WRAPPED}, gripper)')} AS delta,
  {R6.format('action')} AS action, {R6.format('[(state[i] - 0.5::DOUBLE) / 2 for i in range(1, 7)]')} AS scaled, {R6.format('list_concat(state, [0.0::DOUBLE, 0])')} AS padded,
  {R6.format('[(ee_x + 1) / (ee_x + ee_y + ee_z + 3), (ee_y + 1) / (ee_x + ee_y + ee_z + 3), (ee_z + 1) / (ee_x + ee_y + ee_z + 3)]')} AS colour,
  round(1 / (1 + exp(-least(greatest((obj_x - 0.35::DOUBLE) / greatest(0.12::DOUBLE, 0.25::DOUBLE * 0.35::DOUBLE), -20), 20))), 6) AS cue, ({s_dir('vel_x', 'vel_y')})::INT AS sector FROM st""", "v_frames")
def sql_vectors(spark, sf):
    """Plain SQL over the registered functions."""
    sqlf.register(spark)
    f = states(spark, sf).withColumn("q", F.array("qw", "qx", "qy", "qz"))
    out = spark.sql("""SELECT episode, frame_index, rotate_inverse(q, array(obj_x, obj_y, obj_z)) AS seen, rotation_vector(q) AS axis_angle, quat_product(q, q) AS twice,
      delta_vector(action, state) AS delta, undelta_vector(concat(transform(sequence(0, 5), i -> action[i] - state[i]), slice(action, -1, 1)), state) AS action,
      zscore_vector(state, array_repeat(0.5D, 6), array_repeat(2D, 6)) AS scaled, pad_vector(state, 8) AS padded, chroma_vector(ee_x, ee_y, ee_z) AS colour,
      round(cue_confidence(obj_x, 0.35D, 0.12D, 0.25D), 6) AS cue, direction_sector(vel_x, vel_y) AS sector FROM {f}""", f=f)
    return out.withColumns({c: vec.rounded(F.col(c)) for c in ("seen", "axis_angle", "twice", "delta", "action", "scaled", "padded", "colour")})


@query("T4 F16 F17", """p AS (SELECT user_id, event_id, t_us, value, lag(value) OVER w AS pv, lag(t_us) OVER w AS pt FROM v_events WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id))
  SELECT event_id, sign(value - pv)::INT AS p, i::INT AS ordinal, round(pt + (i * 30.0::DOUBLE / abs(value - pv)) * (t_us - pt), 0) AS t_cross
  FROM p, generate_series(1, 100) g(i) WHERE i <= floor(abs(value - pv) / 30.0::DOUBLE)""", "v_events")
def sql_crossings(spark, sf):
    """The crossings table function as a lateral join; every sample is the next one's reference."""
    sqlf.register(spark)
    e = v.v_events(spark, sf).select("user_id", "event_id", "t_us", "value")
    e = chunked.prev_value(e, ["user_id"], ["t_us", "event_id"], {"pv": F.col("value"), "pt": F.col("t_us")}, v.ROWS)
    return spark.sql("SELECT e.event_id, c.p, c.ordinal, round(c.t_cross, 0) AS t_cross FROM {e} e, LATERAL crossings(e.pv, e.pv, e.value, 30D, CAST(e.pt AS DOUBLE), CAST(e.t_us AS DOUBLE)) c", e=e.where("pv IS NOT NULL"))
