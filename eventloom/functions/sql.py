"""SQL functions for users who work in SQL: temporary functions defined in SQL, inlined by the optimizer."""

from __future__ import annotations

from pyspark.sql import SparkSession

# each body mirrors the column function of the same name
SCALARS = {
    "wrap_angle": "(a DOUBLE) RETURNS DOUBLE RETURN pmod(a + pi(), 2 * pi()) - pi()",
    "clipped_sigmoid": "(v DOUBLE) RETURNS DOUBLE RETURN 1 / (1 + exp(-least(greatest(v, -20D), 20D)))",
    "squash_count": "(total DOUBLE, clip DOUBLE) RETURNS DOUBLE RETURN CASE WHEN clip > 0 THEN log1p(least(total, clip)) / log1p(clip) ELSE total END",
    "luminance": "(r DOUBLE, g DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN 0.2126D * r + 0.7152D * g + 0.0722D * b",
    "log_luminance": "(r DOUBLE, g DOUBLE, b DOUBLE, eps DOUBLE) RETURNS DOUBLE RETURN ln(0.2126D * r + 0.7152D * g + 0.0722D * b + eps)",
    "frame_of_time": "(t_us BIGINT, frame_us BIGINT, n BIGINT) RETURNS BIGINT RETURN least(greatest(floor(t_us / frame_us), 0), n - 1)",
    "crossing_count": "(diff DOUBLE, theta DOUBLE) RETURNS BIGINT RETURN floor(greatest(diff, 0D) / theta)",
    "crossing_instant": """(target DOUBLE, prev DOUBLE, cur DOUBLE, t0 DOUBLE, t1 DOUBLE) RETURNS DOUBLE
        RETURN t0 + CASE WHEN abs(cur - prev) > 1e-12D THEN least(greatest((target - prev) / (cur - prev), 0D), 1D) ELSE 1D END * greatest(t1 - t0, 0D)""",
    "safe_ratio": "(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN CASE WHEN b > 0 THEN a / b END",
    "euler_roll": "(w DOUBLE, x DOUBLE, y DOUBLE, z DOUBLE) RETURNS DOUBLE RETURN pmod(atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)), 2 * pi())",
    "euler_pitch": "(w DOUBLE, x DOUBLE, y DOUBLE, z DOUBLE) RETURNS DOUBLE RETURN asin(least(greatest(2 * (w * y - z * x), -1D), 1D))",
    "euler_yaw": "(w DOUBLE, x DOUBLE, y DOUBLE, z DOUBLE) RETURNS DOUBLE RETURN pmod(atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)), 2 * pi())",
}

V = "ARRAY<DOUBLE>"
# vectors are arrays; quaternions are (w, x, y, z)
SCALARS |= {
    "quat_product": f"""(a {V}, b {V}) RETURNS {V} RETURN array(a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3], a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2],
        a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1], a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0])""",
    "cross_product": f"(a {V}, b {V}) RETURNS {V} RETURN array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])",
    # u - 2 w (v x u) + 2 v x (v x u) with v the vector part
    "rotate_inverse": f"""(q {V}, u {V}) RETURNS {V} RETURN transform(sequence(0, 2), i -> u[i] - 2 * q[0] * cross_product(slice(q, 2, 3), u)[i]
        + 2 * cross_product(slice(q, 2, 3), cross_product(slice(q, 2, 3), u))[i])""",
    "rotation_vector": f"""(q {V}) RETURNS {V} RETURN transform(slice(q, 2, 3), c -> CASE WHEN sqrt(1 - least(q[0] * q[0], 1D)) < 1e-8D THEN 0D
        ELSE c / sqrt(1 - least(q[0] * q[0], 1D)) * 2 * acos(least(greatest(q[0], -1D), 1D)) END)""",
    # all but the last (gripper) component; rotation components 3-5 wrapped
    "delta_vector": f"""(action {V}, state {V}) RETURNS {V} RETURN concat(transform(sequence(0, size(action) - 2), i -> CASE WHEN i BETWEEN 3 AND 5
        THEN pmod(action[i] - state[i] + pi(), 2 * pi()) - pi() ELSE action[i] - state[i] END), slice(action, -1, 1))""",
    "undelta_vector": f"(action {V}, state {V}) RETURNS {V} RETURN concat(transform(sequence(0, size(action) - 2), i -> action[i] + state[i]), slice(action, -1, 1))",
    "zscore_vector": f"(v {V}, mean {V}, std {V}) RETURNS {V} RETURN transform(v, (a, i) -> (a - mean[i]) / std[i])",
    "pad_vector": f"(v {V}, n INT) RETURNS {V} RETURN concat(v, array_repeat(0D, greatest(n - size(v), 0)))",
    "chroma_vector": f"(r DOUBLE, g DOUBLE, b DOUBLE) RETURNS {V} RETURN array((r + 1) / (r + g + b + 3), (g + 1) / (r + g + b + 3), (b + 1) / (r + g + b + 3))",
    "cue_confidence": "(value DOUBLE, threshold DOUBLE, least_soft DOUBLE, factor DOUBLE) RETURNS DOUBLE RETURN 1 / (1 + exp(-least(greatest((value - threshold) / greatest(least_soft, factor * threshold), -20D), 20D)))",
    "direction_sector": """(vx DOUBLE, vy DOUBLE) RETURNS INT RETURN (SELECT CASE WHEN a >= 345 OR a < 15 THEN 0 WHEN a < 75 THEN 1 WHEN a < 105 THEN 2 WHEN a < 165 THEN 3
        WHEN a < 195 THEN 4 WHEN a < 255 THEN 5 WHEN a < 285 THEN 6 ELSE 7 END FROM (SELECT pmod(degrees(atan2(vy, vx)), 360D) AS a))""",
}

# crossings of one step from ``prev`` to ``cur`` with reference value ``ref``
CROSSINGS = """(ref DOUBLE, prev DOUBLE, cur DOUBLE, theta DOUBLE, t0 DOUBLE, t1 DOUBLE)
    RETURNS TABLE (p INT, ordinal INT, t_cross DOUBLE)
    RETURN SELECT CAST(sign(cur - ref) AS INT), i,
        t0 + CASE WHEN abs(cur - prev) > 1e-12D THEN least(greatest((ref + sign(cur - ref) * i * theta - prev) / (cur - prev), 0D), 1D) ELSE 1D END * greatest(t1 - t0, 0D)
      FROM explode(CASE WHEN abs(cur - ref) >= theta THEN sequence(1, CAST(floor(abs(cur - ref) / theta) AS INT)) ELSE CAST(array() AS ARRAY<INT>) END) AS s(i)"""


def register(spark: SparkSession) -> list[str]:
    """Creates the functions for this session and returns their names."""
    for name, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION crossings{CROSSINGS}")
    return [*SCALARS, "crossings"]
