"""Domain views over the supplied tables, once as DataFrames and once as DuckDB CTEs.

One bin stands for one day and one frame for four, so that every cell holds a few events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators import chunked

ORIGIN_US = 1_704_067_200_000_000  # 2024-01-01T00:00:00Z
DAY_US = 86_400_000_000
FRAME_US = 4 * DAY_US
HOUR_US = 3_600_000_000
WIDTH, HEIGHT = 480, 360
SIDE = 8  # raster side
ROWS = chunked.Rows(2_000, HOUR_US)  # chunks of a series of events


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def micros(c) -> F.Column:
    return F.unix_micros(F.col(c).cast("timestamp")) if isinstance(c, str) else F.unix_micros(c.cast("timestamp"))


def v_events(spark, sf, stored=None) -> DataFrame:
    """Events; ``stored`` is a condition on the stored columns, for pruning at the reader."""
    e = table(spark, sf, "events")
    e = (e if stored is None else e.where(stored)).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    u, i, k = F.col("user_id"), F.col("event_id"), F.col("k")
    return e.select(
        (u % 4).alias("episode"),
        F.concat(F.lit("cam"), (u % 3).cast("string")).alias("camera"),
        i.alias("event_id"),
        (micros("ts") - F.lit(ORIGIN_US)).alias("t_us"),
        ((i * 37) % WIDTH).cast("int").alias("x"),
        ((i * 53) % HEIGHT).cast("int").alias("y"),
        F.when(F.col("event_type").isin("click", "purchase", "signup"), 1).otherwise(-1).cast("int").alias("p"),
        ((k + 1) / F.lit(100.0)).alias("q"),
        (k / F.lit(100.0)).alias("q_static"),
        (F.lit(1.0) - k / F.lit(100.0)).alias("q_dynamic"),
        ((k % 10) / F.lit(10.0)).alias("q_illumination"),
        F.col("value"),
        u.alias("user_id"),
    )


def units(df: DataFrame, width_us: int) -> int:
    """How many stretches of ``width_us`` from the origin hold the events of ``df``."""
    last = df.agg(F.max("t_us")).first()[0]
    return 0 if last is None else max(0, last // width_us + 1)


def span(width_us: int, source: str = "v_events") -> str:
    """The same as a table of the numbers k of the stretches."""
    return f"(SELECT unnest(generate_series(0::BIGINT, max(t_us) // {width_us})) AS k FROM {source})"


def v_frames(spark, sf) -> DataFrame:
    c = F.col
    li = table(spark, sf, "lineitem").select("*", (micros("l_shipdate") / 86_400_000_000).cast("long").alias("_day"))
    order = ["_day", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
             "l_tax", "l_returnflag", "l_linestatus"]
    li = chunked.positions(li, ["l_orderkey"], order, 366, "frame_index")
    n = F.sqrt(1 + F.pow(c("l_discount") * 10, 2) + F.pow(c("l_tax") * 10, 2) + F.pow(c("l_quantity") / 50, 2))
    return li.select(
        c("l_orderkey").alias("episode"),
        "frame_index",
        (c("frame_index") / F.lit(25.0)).alias("timestamp"),
        (c("l_quantity") / 50).alias("ee_x"),
        (c("l_discount") * 10).alias("ee_y"),
        (c("l_tax") * 10).alias("ee_z"),
        (1 / n).alias("qw"),
        (c("l_discount") * 10 / n).alias("qx"),
        (c("l_tax") * 10 / n).alias("qy"),
        (c("l_quantity") / 50 / n).alias("qz"),
        ((c("l_partkey") % 100) / F.lit(100.0)).alias("obj_x"),
        ((c("l_suppkey") % 100) / F.lit(100.0)).alias("obj_y"),
        (c("l_extendedprice") / 1e5).alias("obj_z"),
        (c("l_discount") - 0.05).alias("vel_x"),
        (c("l_tax") - 0.04).alias("vel_y"),
        F.when(c("l_returnflag") == "R", F.lit(-1.0)).otherwise(F.lit(1.0)).alias("gripper"),
        (c("l_linenumber").cast("long")).alias("task_index"),
    )


def v_pixels(spark, sf) -> DataFrame:
    c = F.col
    e = chunked.positions(table(spark, sf, "embeddings"), ["label"], ["vec_id"], 100_000, "frame_index")
    p = e.select(
        (c("label") % 4).cast("long").alias("episode"),
        F.concat(F.lit("cam"), (c("label") % 3).cast("string")).alias("camera"),
        "frame_index",
        F.posexplode("embedding").alias("i", "f"),
    ).withColumn("v", c("f").cast("double"))

    def level(gain):
        return F.least(F.greatest(F.floor(128 + gain * c("v")), F.lit(0)), F.lit(255)).cast("int")

    return p.select(
        "episode",
        "camera",
        "frame_index",
        F.floor(c("i") / SIDE).cast("int").alias("y"),
        (c("i") % SIDE).cast("int").alias("x"),
        "v",
        (1 + F.abs("v")).alias("depth"),
        (c("v") * 4).alias("mvx"),
        (c("v") * -2).alias("mvy"),
        level(400).alias("r"),
        level(200).alias("g"),
        level(-300).alias("b"),
        F.when(c("v") > 0.15, 2).when(c("v") > 0.1, 3).when(c("v") < -0.2, 1).otherwise(0).cast("int").alias("seg"),
    )


def v_cameras(spark, sf) -> DataFrame:
    """Pose moving 0.1 per frame along x, identity rotation; one row per frame."""
    e = chunked.positions(table(spark, sf, "embeddings").select("label", "vec_id"), ["label"], ["vec_id"],
                          100_000, "frame_index")
    k = F.col("frame_index")
    return e.select(
        (F.col("label") % 4).cast("long").alias("episode"),
        F.concat(F.lit("cam"), (F.col("label") % 3).cast("string")).alias("camera"),
        "frame_index",
        (k * 0.1).alias("tx"), F.lit(0.0).alias("ty"), F.lit(0.0).alias("tz"),
        F.lit(1.0).alias("qw"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.lit(0.0).alias("qz"),
        F.lit(8.0).alias("fx"), F.lit(8.0).alias("fy"), F.lit(3.5).alias("cx"), F.lit(3.5).alias("cy"),
    )


def v_maps(spark, sf) -> DataFrame:
    """Confidence maps on the raster."""
    v = F.col("v")
    return v_pixels(spark, sf).select(
        "episode", "camera", "frame_index", "y", "x", "seg",
        F.least(F.abs(v) * 4, F.lit(1.0)).alias("q_motion"),
        (1 - F.least(F.abs(v) * 4, F.lit(1.0))).alias("q_static"),
        F.least(F.abs(v) * 3, F.lit(1.0)).alias("q_dynamic"),
        F.least(F.greatest(v * 2, F.lit(0.0)), F.lit(1.0)).alias("q_illumination"),
    )


def on_raster(events: DataFrame) -> DataFrame:
    """Events with coordinates on the raster; a few fall outside on purpose."""
    return events.withColumns({
        "x": F.floor(F.col("x") * (SIDE + 1) / WIDTH).cast("int"),
        "y": F.floor(F.col("y") * SIDE / HEIGHT).cast("int"),
    })


def v_raster_events(spark, sf) -> DataFrame:
    return on_raster(v_events(spark, sf))


def v_samples(spark, sf) -> DataFrame:
    c = F.col
    return table(spark, sf, "orders").select(
        c("o_orderkey").alias("sample_index"),
        F.when(c("o_orderstatus") == "F", True).when(c("o_orderstatus") == "O", False).alias("success"),
        F.when(c("o_orderpriority") == "1-URGENT", "test").when(c("o_orderpriority") == "2-HIGH", "train").alias("split"),
        F.floor(c("o_totalprice")).cast("long").alias("size_bytes"),
        c("o_custkey").alias("group_id"),
    )


def v_runs(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Two versions of the whole stream. The second has some events moved, flipped or weighed anew, and echoes of others."""
    e = v_events(spark, sf)
    i = F.col("event_id")
    b = e.withColumns({
        "t_us": F.col("t_us") + (i % 3) * HOUR_US, "p": F.when(i % 5 == 0, -F.col("p")).otherwise(F.col("p")),
        "q": F.least(F.col("q") + (i % 4) / 200, F.lit(1.0)), "value": F.col("value") * (1 + (i % 3) / 10),
    })
    return e, b.unionByName(e.where(i % 7 == 0).withColumn("t_us", F.col("t_us") + 2 * HOUR_US))


def v_objects(spark, sf) -> DataFrame:
    """Objects in scenes of two, three and four by turns: slot 0 of a scene is the target."""
    c = F.col
    place, turn = c("p_partkey") % 9, F.floor(c("p_partkey") / 9) * 3
    scene = turn + F.when(place < 2, 0).when(place < 5, 1).otherwise(2)
    return table(spark, sf, "part").select(
        scene.cast("long").alias("scene"),
        (place - F.when(place < 2, 0).when(place < 5, 2).otherwise(5)).alias("slot"),
        F.split("p_name", " ")[1].alias("category"),
        (c("p_size") / 50).alias("sx"), (c("p_retailprice") / 2000).alias("sy"), ((c("p_partkey") % 7 + 1) / 10).alias("sz"),
        ((c("p_partkey") * 13 % 40) / 20 - 1).alias("px"), ((c("p_partkey") * 29 % 40) / 20 - 1).alias("py"),
        ((c("p_partkey") * 17 % 20) / 20).alias("pz"),
        ((c("p_partkey") * 11 % 21 - 10) / 50).alias("vx"), ((c("p_partkey") * 19 % 21 - 10) / 50).alias("vy"),
    )


def v_trials(spark, sf) -> DataFrame:
    """Step log of trials: one row per (trial, step) with a position."""
    c = F.col
    return table(spark, sf, "conversations").select(
        c("conv_id").alias("trial"), (c("conv_id") % 5).alias("env"), c("turn").alias("step"), c("role"),
        (F.length("text") / 100).alias("px"), ((c("conv_id") * 7 + c("turn") * 3) % 11 / 10).alias("py"),
        (c("turn") / 10).alias("pz"), ((c("conv_id") % 3) != 0).alias("success"),
    )


SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "v_events": ((), f"""
        SELECT user_id % 4 AS episode, 'cam' || (user_id % 3) AS camera, event_id,
               epoch_us(ts) - {ORIGIN_US} AS t_us,
               ((event_id * 37) % {WIDTH})::INT AS x, ((event_id * 53) % {HEIGHT})::INT AS y,
               CASE WHEN event_type IN ('click','purchase','signup') THEN 1 ELSE -1 END::INT AS p,
               (k + 1) / 100.0::DOUBLE AS q, k / 100.0::DOUBLE AS q_static, 1.0::DOUBLE - k / 100.0::DOUBLE AS q_dynamic,
               (k % 10) / 10.0::DOUBLE AS q_illumination, value, user_id
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"""),
    "v_frames": ((), """
        SELECT l_orderkey AS episode, frame_index, frame_index / 25.0::DOUBLE AS timestamp,
               l_quantity / 50 AS ee_x, l_discount * 10 AS ee_y, l_tax * 10 AS ee_z,
               1 / n AS qw, l_discount * 10 / n AS qx, l_tax * 10 / n AS qy, l_quantity / 50 / n AS qz,
               (l_partkey % 100) / 100.0::DOUBLE AS obj_x, (l_suppkey % 100) / 100.0::DOUBLE AS obj_y,
               l_extendedprice / 1e5 AS obj_z, l_discount - 0.05::DOUBLE AS vel_x, l_tax - 0.04::DOUBLE AS vel_y,
               CASE WHEN l_returnflag = 'R' THEN -1.0 ELSE 1.0 END::DOUBLE AS gripper,
               l_linenumber::BIGINT AS task_index
        FROM (SELECT *, sqrt(1 + pow(l_discount * 10, 2) + pow(l_tax * 10, 2) + pow(l_quantity / 50, 2)) AS n,
                     row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey,
                        l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS frame_index
              FROM lineitem)"""),
    "v_emb": ((), """
        SELECT (label % 4)::BIGINT AS episode, 'cam' || (label % 3) AS camera,
               row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_index, embedding
        FROM embeddings"""),
    "v_pixels": (("v_emb",), f"""
        SELECT episode, camera, frame_index, (i // {SIDE})::INT AS y, (i % {SIDE})::INT AS x, v, 1 + abs(v) AS depth,
               v * 4 AS mvx, v * -2 AS mvy,
               least(greatest(floor(128 + 400 * v), 0), 255)::INT AS r,
               least(greatest(floor(128 + 200 * v), 0), 255)::INT AS g,
               least(greatest(floor(128 - 300 * v), 0), 255)::INT AS b,
               CASE WHEN v > 0.15::DOUBLE THEN 2 WHEN v > 0.1::DOUBLE THEN 3 WHEN v < -0.2::DOUBLE THEN 1 ELSE 0 END::INT AS seg
        FROM (SELECT episode, camera, frame_index, i, embedding[i + 1]::DOUBLE AS v
              FROM v_emb, generate_series(0, {SIDE * SIDE - 1}) g(i))"""),
    "v_cameras": (("v_emb",), """
        SELECT episode, camera, frame_index, frame_index * 0.1::DOUBLE AS tx, 0.0::DOUBLE AS ty, 0.0::DOUBLE AS tz,
               1.0::DOUBLE AS qw, 0.0::DOUBLE AS qx, 0.0::DOUBLE AS qy, 0.0::DOUBLE AS qz,
               8.0::DOUBLE AS fx, 8.0::DOUBLE AS fy, 3.5::DOUBLE AS cx, 3.5::DOUBLE AS cy FROM v_emb"""),
    "v_maps": (("v_pixels",), """
        SELECT episode, camera, frame_index, y, x, seg, least(abs(v) * 4, 1.0::DOUBLE) AS q_motion,
               1 - least(abs(v) * 4, 1.0::DOUBLE) AS q_static, least(abs(v) * 3, 1.0::DOUBLE) AS q_dynamic,
               least(greatest(v * 2, 0.0::DOUBLE), 1.0::DOUBLE) AS q_illumination FROM v_pixels"""),
    "v_raster_events": (("v_events",), f"""
        SELECT * REPLACE ((x * {SIDE + 1} // {WIDTH})::INT AS x, (y * {SIDE} // {HEIGHT})::INT AS y) FROM v_events"""),
    "v_samples": ((), """
        SELECT o_orderkey AS sample_index, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS success,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'test' WHEN '2-HIGH' THEN 'train' END AS split,
               floor(o_totalprice)::BIGINT AS size_bytes, o_custkey AS group_id FROM orders"""),
    "v_run_a": (("v_events",), "SELECT * FROM v_events"),
    "v_run_b": (("v_events",), f"""
        SELECT * REPLACE (t_us + (event_id % 3) * {HOUR_US} AS t_us, CASE WHEN event_id % 5 = 0 THEN -p ELSE p END AS p,
               least(q + (event_id % 4) / 200::DOUBLE, 1) AS q, value * (1 + (event_id % 3) / 10::DOUBLE) AS value) FROM v_events
        UNION ALL SELECT * REPLACE (t_us + {2 * HOUR_US} AS t_us) FROM v_events WHERE event_id % 7 = 0"""),
    "v_objects": ((), """
        SELECT (p_partkey // 9 * 3 + CASE WHEN p_partkey % 9 < 2 THEN 0 WHEN p_partkey % 9 < 5 THEN 1 ELSE 2 END)::BIGINT AS scene,
               p_partkey % 9 - CASE WHEN p_partkey % 9 < 2 THEN 0 WHEN p_partkey % 9 < 5 THEN 2 ELSE 5 END AS slot, split_part(p_name, ' ', 2) AS category,
               p_size / 50::DOUBLE AS sx, p_retailprice / 2000 AS sy, (p_partkey % 7 + 1) / 10::DOUBLE AS sz,
               (p_partkey * 13 % 40) / 20::DOUBLE - 1 AS px, (p_partkey * 29 % 40) / 20::DOUBLE - 1 AS py,
               (p_partkey * 17 % 20) / 20::DOUBLE AS pz,
               (p_partkey * 11 % 21 - 10) / 50::DOUBLE AS vx, (p_partkey * 19 % 21 - 10) / 50::DOUBLE AS vy FROM part"""),
    "v_trials": ((), """
        SELECT conv_id AS trial, conv_id % 5 AS env, turn AS step, role, length(text) / 100::DOUBLE AS px,
               (conv_id * 7 + turn * 3) % 11 / 10::DOUBLE AS py, turn / 10::DOUBLE AS pz, (conv_id % 3) <> 0 AS success
        FROM conversations"""),
}


def oracle(use: str, body: str) -> str:
    """Prefix ``body`` with the CTEs of the views it uses, dependencies first."""
    done: list[str] = []

    def add(name):
        if name in done:
            return
        for d in SQL[name][0]:
            add(d)
        done.append(name)

    for n in use.split():
        add(n)
    ctes = ", ".join(f"{n} AS ({SQL[n][1]})" for n in done)
    body = body.strip()
    if not done:
        return body
    if body.upper().startswith("SELECT"):
        return f"WITH RECURSIVE {ctes} {body}"
    return f"WITH RECURSIVE {ctes}, {body}"
