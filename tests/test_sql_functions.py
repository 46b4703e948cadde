import math

import pytest
from pyspark.sql import functions as F

from eventloom.functions import sql
from eventloom.operators import pixels as px


def test_scalars(spark):
    sql.register(spark)
    r = spark.sql("SELECT wrap_angle(6.2D) a, clipped_sigmoid(100D) s, squash_count(3D, 8D) q, frame_of_time(95, 10, 8) f, crossing_count(0.4D, 0.15D) n, safe_ratio(1D, 0D) z, crossing_instant(0.15D, 0D, 0.4D, 0D, 10D) t").first()
    assert r.a == pytest.approx(6.2 - 2 * math.pi) and r.s == pytest.approx(1 / (1 + math.exp(-20))) and r.q == pytest.approx(math.log(4) / math.log(9))
    assert (r.f, r.n, r.z) == (7, 2, None) and r.t == pytest.approx(3.75)


def test_crossings_table(spark):
    sql.register(spark)
    rows = spark.sql("SELECT s.id, c.* FROM VALUES (1, 0D, 0D, 0.4D), (2, 0.3D, 0.4D, 0.1D), (3, 0D, 0D, 0.1D) AS s(id, ref, prev, cur), LATERAL crossings(s.ref, s.prev, s.cur, 0.15D, 0D, 10D) AS c ORDER BY 1, 3").collect()
    assert [(r.id, r.p, r.ordinal) for r in rows] == [(1, 1, 1), (1, 1, 2), (2, -1, 1)]
    assert rows[0].t_cross == pytest.approx(3.75)


def test_interpolator_registry(spark):
    with pytest.raises(ValueError):
        px.register_interpolator("log_blend", None)
    with pytest.raises(ValueError):
        px.interpolate("nothing", None, 2, 2, 2)
    rows = [(1, "c", k, y, x, 1.0, 0.0, 0.0, 10 + k, 20, 30) for k in (0, 1) for y in range(3) for x in range(3)]
    p = spark.createDataFrame(rows, "episode long, camera string, frame_index long, y int, x int, depth double, mvx double, mvy double, r int, g int, b int")
    pairs = px.frame_pairs(p, ["depth", "mvx", "mvy", "r", "g", "b"])
    later = px.interpolate("later_first", pairs, 2, 3, 3)
    mixed = px.interpolate("log_blend", pairs, 2, 3, 3)
    assert later.select(F.min("r"), F.max("r"), F.min("confidence")).first()[:2] == (11.0, 11.0)
    assert 10 < mixed.agg(F.avg("r")).first()[0] < 11
