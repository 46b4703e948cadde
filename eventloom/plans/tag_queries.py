"""Registered queries: object tags, names, texts and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions import rotation as rot
from eventloom.functions import text as tx
from eventloom.operators import tags as tg
from eventloom.plans import views as v
from eventloom.plans.frame_queries import s_dir, s_inv, s_norm
from eventloom.plans.registry import query

BASE, BQ = (0.2, -0.1, 0.0), (0.8, 0.0, 0.0, 0.6)
TOLS = {"height": 0.1, "area": 0.05, "volume": 0.05, "position_from_left": 0.15, "position_from_bottom": 0.15, "distance_from_robot": 0.1, "velocity": 0.05}


def lits(t):
    return [F.lit(x) for x in t]


def s_l(t):
    return [f"{x}::DOUBLE" for x in t]


S_REL = s_inv(s_l(BQ), [f"({p} - {b})" for p, b in zip(("px", "py", "pz"), s_l(BASE))])
S_ATTR = {"height": "pz", "area": "sx * sy", "volume": "sx * sy * sz", "position_from_left": S_REL[1], "position_from_bottom": f"(-{S_REL[0]})",
          "distance_from_robot": "(-" + s_norm([f"({p} - {b})" for p, b in zip(("px", "py", "pz"), s_l(BASE))]) + ")"}


def attrs():
    return {k: F.round(c, 9) for k, c in tg.attributes(rot.cols("sx", "sy", "sz"), rot.cols("px", "py", "pz"), lits(BASE), lits(BQ)).items()}


@query("F19 F4", "SELECT scene, slot, " + ", ".join(f"round({e}, 9) AS {k}" for k, e in S_ATTR.items()) + " FROM v_objects", "v_objects")
def object_attributes(spark, sf):
    return v.v_objects(spark, sf).select("scene", "slot", *[c.alias(k) for k, c in attrs().items()])


def s_rank(src, by, tol):
    return f"""r0 AS (SELECT *, row_number() OVER w AS i, abs(value - lag(value) OVER w) > {tol} AS gap FROM {src} WINDOW w AS (PARTITION BY {by} ORDER BY value DESC, slot)),
  r1 AS (SELECT *, max(CASE WHEN i = 1 OR gap THEN i END) OVER (PARTITION BY {by} ORDER BY value DESC, slot ROWS UNBOUNDED PRECEDING) AS rank FROM r0)"""


@query("W10", f"src AS (SELECT scene, slot, round(pz, 9) AS value FROM v_objects), {s_rank('src', 'scene', '0.3::DOUBLE')} SELECT scene, slot, rank::INT AS rank FROM r1", "v_objects")
def tolerant_rank(spark, sf):
    d = v.v_objects(spark, sf).select("scene", "slot", F.round("pz", 9).alias("value"))
    return tg.tolerant_rank(d, ["scene"], "value", "slot", 0.3).select("scene", "slot", "rank")


def _case(table):
    return "CASE kind " + " ".join("WHEN '" + k + "' THEN '" + t.replace("'", "''") + "'" for k, t in table.items()) + " END"


S_SEEN = s_inv(s_l(BQ), ["vx", "vy", "0.0::DOUBLE"])
TAGS = f"""ob AS (SELECT *, sqrt(vx * vx + vy * vy) AS speed, {s_dir(S_SEEN[0], S_SEEN[1])} AS dir FROM v_objects),
  av AS ({' UNION ALL '.join(f"SELECT scene, slot, category, '{k}' AS kind, round({e}, 9) AS value, {TOLS[k]}::DOUBLE AS tol FROM ob" for k, e in S_ATTR.items())}
    UNION ALL SELECT scene, slot, category, 'velocity', round(speed, 9), {TOLS['velocity']}::DOUBLE FROM ob WHERE round(speed, 9) >= 0.01),
  {s_rank('av', 'scene, kind', 'tol')}, r2 AS (SELECT *, count(*) OVER (PARTITION BY scene, kind) AS n FROM r1),
  r3 AS (SELECT scene, slot, kind, n, replace(CASE WHEN rank = 1 THEN {_case(tg.FIRST)} WHEN rank = n THEN {_case(tg.LAST)} WHEN rank = 2 AND n = 3 THEN {_case(tg.MEDIUM)} END, '%s', category) AS t FROM r2),
  tg AS (SELECT scene, slot, kind, CASE WHEN n = 2 THEN replace(t, 'est', 'er') ELSE t END AS tag FROM r3 WHERE t IS NOT NULL
    UNION ALL SELECT scene, slot, 'direction', replace(CASE WHEN round(speed, 9) < 0.01 THEN 'stationary %s' ELSE ({'CASE dir ' + ' '.join(f"WHEN {i} THEN '" + t.replace("'", "''") + "'" for i, t in enumerate(tg.DIRECTIONS)) + ' END'}) END, '%s', category) FROM ob)"""


def all_tags(spark, sf):
    vel = [F.col("vx"), F.col("vy"), F.lit(0.0)]
    return tg.scene_tags(v.v_objects(spark, sf), ["scene"], "slot", F.col("category"), attrs(), vel, lits(BQ), TOLS)


@query("F20 F18 W10", f"{TAGS} SELECT scene, slot, kind, tag FROM tg", "v_objects")
def scene_tags(spark, sf):
    return all_tags(spark, sf)


@query("U3", f"{TAGS} SELECT DISTINCT scene, tag FROM tg a WHERE slot = 0 AND NOT EXISTS (SELECT 1 FROM tg b WHERE b.scene = a.scene AND b.tag = a.tag AND b.slot <> 0)", "v_objects")
def unique_tags(spark, sf):
    return tg.unique_tags(all_tags(spark, sf), ["scene"], "slot")


@query("J14", """SELECT scene, slot, o.category, coalesce(m.weight, 1.0) AS weight, m.category IS NULL AS unknown FROM v_objects o LEFT JOIN (SELECT split_part(p_name, ' ', 2) AS category, round(avg(p_size), 6) AS weight FROM part
  WHERE p_name NOT LIKE '%ring%' GROUP BY 1) m USING (category)""", "v_objects")
def attach_meta(spark, sf):
    m = v.table(spark, sf, "part").where(~F.col("p_name").contains("ring")).groupBy(F.split("p_name", " ")[1].alias("category")).agg(F.round(F.avg("p_size"), 6).alias("weight"))
    return tg.attach_meta(v.v_objects(spark, sf).select("scene", "slot", "category"), m, "category", {"weight": 1.0})


NAMES = ["er", "tion", "ing", "the", "ment", "eau", "ation", "st"]


@query("J15", f"""SELECT doc_id, (SELECT n FROM (VALUES {', '.join(f"('{n}')" for n in NAMES)}) c(n) WHERE contains(lower(text), n) ORDER BY length(n) DESC, n LIMIT 1) AS category FROM documents""")
def infer_category(spark, sf):
    """Longest listed name in the whole text."""
    return v.table(spark, sf, "documents").select("doc_id", tx.longest_match(F.lower("text"), NAMES).alias("category"))


@query("K5", "SELECT scene, arg_max(slot, (round(sqrt(vx * vx + vy * vy), 9), -slot)) AS slot, max(round(sqrt(vx * vx + vy * vy), 9)) AS speed FROM v_objects GROUP BY scene", "v_objects")
def fastest(spark, sf):
    return tg.fastest(v.v_objects(spark, sf), ["scene"], F.round(F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")), 9), "slot")


@query("K6", "SELECT sample_index, success, size_bytes FROM v_samples WHERE sample_index >= 137 ORDER BY sample_index LIMIT 50", "v_samples")
def take_from(spark, sf):
    return tg.take_from(v.v_samples(spark, sf), "sample_index", 137, 50).select("sample_index", "success", "size_bytes")


@query("K7", """SELECT event_type, row_number() OVER (ORDER BY CASE event_type WHEN 'view' THEN 1 WHEN 'error' THEN 2 ELSE 3 END, event_type) AS pos FROM (SELECT DISTINCT event_type FROM events)""")
def camera_order(spark, sf):
    d = v.table(spark, sf, "events").select("event_type").distinct()
    d = d.withColumn("r", tg.camera_rank(F.col("event_type"), ["view", "error"]))
    # one row per stream name: the position is the count of names sorting at or before it
    names = d.agg(F.sort_array(F.collect_set(F.struct("r", "event_type"))).alias("all")).scalar()
    return d.select("event_type", F.array_position(names, F.struct("r", "event_type")).alias("pos"))


@query("F21", """SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'Place the ' || split_part(p_name, ' ', 2) || ' in the ' || coalesce(CASE WHEN p_size > 10 THEN split_part(p_name, ' ', 1) END, 'container') || '.'
   ELSE 'Pick up the ' || split_part(p_name, ' ', 2) || '.' END AS instruction FROM part""")
def instruction_text(spark, sf):
    p = v.table(spark, sf, "part")
    words = F.split("p_name", " ")
    task = F.when(F.col("p_type") == "ECONOMY", "place").otherwise("pick")
    return p.select("p_partkey", tx.instruction(task, words[1], F.when(F.col("p_size") > 10, words[0])).alias("instruction"))


def _verb(kind, verbs):
    return f"list_element([{', '.join(chr(39) + x + chr(39) for x in verbs)}], 1 + floor(('0x' || substr(md5('3|{kind}|' || p_partkey), 1, 12))::BIGINT / 281474976710656.0::DOUBLE * {len(verbs)})::INT)"


@query("F21", f"""SELECT p_partkey, {_verb('pick', tx.PICK_VERBS)} || ' the ' || split_part(p_name, ' ', 2) || CASE WHEN p_type = 'ECONOMY' THEN ' and ' || {_verb('place', tx.PLACE_VERBS)} || ' the ' || split_part(p_name, ' ', 1) ELSE '' END || '.' AS instruction FROM part""")
def random_instruction(spark, sf):
    words = F.split("p_name", " ")
    task = F.when(F.col("p_type") == "ECONOMY", "place").otherwise("pick")
    return v.table(spark, sf, "part").select("p_partkey", tx.random_instruction(task, words[1], words[0], 3, F.col("p_partkey")).alias("instruction"))


@query("F22", """SELECT event_id, coalesce(json_extract_string(props, '$.k'), '0') AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events""")
def json_get(spark, sf):
    return v.table(spark, sf, "events").select("event_id", tx.json_field("props", "$.k", "0").alias("k"), tx.json_field("props", "$.missing", "none").alias("missing"))


@query("F23", """SELECT page_id, CASE WHEN path LIKE '%demo%' THEN regexp_extract(path, 'demo(\\d+)', 1)::BIGINT END AS demo, folder AS experiment, CASE WHEN page_id % 3 > 0 THEN page_id::INT END AS epoch, stem FROM (
  SELECT page_id, 'runs/demo' || page_id || '/x' AS path, split_part(url, '/', 3) AS folder, 'task_' || page_id AS stem FROM pages)""")
def parse_name(spark, sf):
    p = v.table(spark, sf, "pages")
    i = F.col("page_id").cast("string")
    path = F.concat(F.split("url", "/")[2], F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("/model.epoch"), i, F.lit(".safetensors"))).otherwise(F.lit("/model.safetensors")))
    n = tx.checkpoint_name(path)
    return p.select("page_id", tx.demo_number(F.concat(F.lit("runs/demo"), i, F.lit("/x"))).alias("demo"), n["experiment"].alias("experiment"), n["epoch"].alias("epoch"),
                    tx.strip_suffix(F.concat(F.lit("task_"), i, F.lit("_0a9f"))).alias("stem"))


@query("F24", """SELECT p_partkey, printf('%s_%s_%s%s_O%02d_%08d_%s', 'pick', 'arm', split_part(p_name, ' ', 2), CASE WHEN p_size > 25 THEN 'd' ELSE 's' END, p_size, p_partkey, substr(md5(p_partkey::VARCHAR), 29, 4)) AS name FROM part""")
def episode_name(spark, sf):
    n = tx.episode_name(F.lit("pick"), F.lit("arm"), F.split("p_name", " ")[1], F.col("p_size") > 25, F.col("p_size"), F.col("p_partkey"), F.substring(F.md5(F.col("p_partkey").cast("string")), 29, 4))
    return v.table(spark, sf, "part").select("p_partkey", n.alias("name"))


@query("F25", """SELECT o_orderkey, sha256('{"code":"v1","size":' || o_custkey || ',"source":"' || o_orderpriority || '"}') AS fingerprint FROM orders""")
def fingerprint(spark, sf):
    f = tx.fingerprint({"size": F.col("o_custkey"), "source": F.col("o_orderpriority"), "code": F.lit("v1")})
    return v.table(spark, sf, "orders").select("o_orderkey", f.alias("fingerprint"))


@query("F26", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, CASE WHEN event_id % 7 = 0 THEN [1.0::DOUBLE, NULL] ELSE [1.0::DOUBLE, value] END AS vals FROM events")
def json_safe(spark, sf):
    bad = F.when(F.col("event_id") % 14 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return v.table(spark, sf, "events").select("event_id", tx.json_safe(bad).alias("value"), tx.json_safe_array(F.array(F.lit(1.0), bad)).alias("vals"))


@query("F28", """SELECT o_orderkey, CASE WHEN n < 1000 THEN printf('%.0f', n) WHEN n < 1e6 THEN printf('%.0fK', n / 1e3) WHEN n < 1e9 THEN printf('%.0fM', n / 1e6) ELSE printf('%.0fB', n / 1e9) END AS label
  FROM (SELECT o_orderkey, round(o_totalprice) * CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 997 ELSE 99991 END::DOUBLE AS n FROM orders)""")
def big_number(spark, sf):
    m = F.when(F.col("o_orderkey") % 3 == 0, 1.0).when(F.col("o_orderkey") % 3 == 1, 997.0).otherwise(99991.0)
    return v.table(spark, sf, "orders").select("o_orderkey", tx.big_number(F.round("o_totalprice") * m).alias("label"))


PLAN = f"""pl AS (SELECT sample_index, (sample_index % 16)::INT AS category_index, list_element([{', '.join(chr(39) + c + chr(39) for c in tg.CATEGORIES)}], (sample_index % 16 + 1)::INT) AS category, (sample_index // 16 % 3)::INT AS variant, (sample_index % 4)::INT AS speed_bin FROM v_samples)"""


@query("F29", f"{PLAN} SELECT sample_index, category_index, category, variant, speed_bin, round(0.15::DOUBLE * (speed_bin + 1), 6) AS speed_lo, round(0.15::DOUBLE * (speed_bin + 2), 6) AS speed_hi, sample_index + 1000 AS seed FROM pl", "v_samples")
def stratified_plan(spark, sf):
    return tg.stratified_plan(v.v_samples(spark, sf).select("sample_index"), "sample_index", F.lit(3), 1000)


@query("A26 F29", f"{PLAN} SELECT category, speed_bin, count(*) AS n FROM pl GROUP BY CUBE (category, speed_bin)", "v_samples")
def coverage(spark, sf):
    return tg.coverage(tg.stratified_plan(v.v_samples(spark, sf).select("sample_index"), "sample_index", F.lit(3)))


@query("P21", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'hybrid' WHEN o_orderstatus = 'F' THEN 'adaptive' ELSE 'balanced' END AS mode FROM orders")
def capture_mode(spark, sf):
    gain = F.when(F.col("o_orderkey") % 5 == 0, 0.25).otherwise(0.0)
    mode = F.when(gain > 0, "hybrid").when(F.col("o_orderstatus") == "F", "adaptive").otherwise("balanced")
    return v.table(spark, sf, "orders").select("o_orderkey", mode.alias("mode"))
