"""Chunked ordered operators equal plain windows, whatever the chunk width, also for one hot key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from eventloom.operators import chunked
from eventloom.operators import events as ev
from eventloom.operators import series as se


def data(spark, n=3000, seed=1, hot=0.6, span=4000):
    r = np.random.default_rng(seed)
    key = np.where(r.random(n) < hot, 0, r.integers(1, 20, n))
    return spark.createDataFrame(pd.DataFrame({
        "k": key, "t": np.sort(r.integers(0, span, n)), "id": np.arange(n), "v": np.round(np.cumsum(r.normal(0, 1, n)), 3),
        "flag": r.random(n) < 0.05, "ok": r.random(n) < 0.8}))


@pytest.mark.parametrize("width", [1, 37, 10**9, chunked.Rows(50, 3), chunked.Rows(7, 1)])
def test_against_windows(spark, width):
    d = data(spark)
    w = Window.partitionBy("k").orderBy("t", "id")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    want = d.select("id", F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("n"), F.sum(F.col("flag").cast("int")).over(up).alias("s"),
                    (F.row_number().over(w) - 1).cast("long").alias("pos"), F.last(F.when(F.col("flag"), F.col("v")), ignorenulls=True).over(up).alias("c")).orderBy("id").toPandas()
    args = (["k"], ["t", "id"])
    g = chunked.prev_value(d, *args, {"p": F.col("v")}, width)
    g = chunked.next_value(g, *args, {"n": F.col("v")}, width)
    g = chunked.running_sum(g, *args, {"s": F.col("flag").cast("int")}, width)
    g = chunked.positions(g, *args, width)
    g = chunked.carry_last(g, *args, {"c": F.when(F.col("flag"), F.col("v"))}, width)
    got = g.select("id", "p", "n", "s", "pos", "c").orderBy("id").toPandas()
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_chunks_follow_the_rows(spark):
    """Ten times the rows over the same stretch: ten times the chunks, and no larger ones."""
    size = {}
    for n in (3000, 30000):
        d = data(spark, n, hot=0.9, span=100_000)
        c = chunked.with_chunk(d, ["k"], ["t", "id"], chunked.Rows(100, 10))
        size[n] = [r["count"] for r in c.groupBy("k", chunked.CHUNK).count().where("k = 0").collect()]
        assert c.columns == [*d.columns, chunked.CHUNK] and c.count() == n
    assert 9 * len(size[3000]) <= len(size[30000]) <= 11 * len(size[3000])
    assert max(size[30000]) <= 1.1 * max(size[3000]) <= 130


def encode(pdf, theta, reset=None, valid=None):
    """The recursion itself, one key at a time."""
    out = []
    for _, g in pdf.sort_values(["t", "id"]).groupby("k"):
        v0 = None
        lost = False
        for r in g.to_dict("records"):
            if valid and not r[valid]:
                lost = True
                continue
            if v0 is None or lost or (reset and r[reset]):
                v0, k = r["v"], 0
            else:
                u = (r["v"] - v0) / theta
                new = int(np.floor(u)) if u >= k + 1 else int(np.ceil(u)) if u <= k - 1 else k
                s = 1 if new > k else -1
                for i in range(1, abs(new - k) + 1):
                    out.append((r["id"], s, i))
                k = new
            lost = False
    return sorted(out)


@pytest.mark.parametrize("width", [3, 50, 10**9, chunked.Rows(40, 7)])
@pytest.mark.parametrize("mode", ["plain", "reset", "valid", "both"])
def test_encoder_against_recursion(spark, width, mode):
    d = data(spark, 1500, seed=3)
    kw = {}
    if mode in ("reset", "both"):
        kw["reset"] = F.col("flag")
    if mode in ("valid", "both"):
        kw["valid"] = "ok"
    got = se.encode_crossings(d, ["k"], ["t", "id"], "v", 0.75, width, **kw)
    got = sorted((r.id, r.p, r.ordinal) for r in got.collect())
    want = encode(d.toPandas(), 0.75, "flag" if "reset" in kw else None, "ok" if "valid" in kw else None)
    assert got == want


def test_encoder_known_case(spark):
    """0, .4, .1 at theta .15: two ON, then one OFF; the reference ends at .15."""
    d = spark.createDataFrame([(1, 0, 0, 0.0), (1, 10, 1, 0.4), (1, 20, 2, 0.1)], "k long, t long, id long, v double")
    rows = se.encode_crossings(d, ["k"], ["t", "id"], "v", 0.15, 10**6).orderBy("t", "ordinal").collect()
    assert [(r.t, r.p) for r in rows] == [(10, 1), (10, 1), (20, -1)]
    assert rows[0].t_cross == pytest.approx(3.75) and rows[1].t_cross == pytest.approx(7.5)
    s = se.level_steps(d, ["k"], ["t", "id"], "v", 0.15, 7).orderBy("t").collect()
    assert [r.level for r in s] == [0, 2, 1]
    assert all(abs(r.v - r.v_ref0 - 0.15 * r.level) < 0.15 for r in s)


def test_refractory_known_case(spark):
    d = spark.createDataFrame([(1, t) for t in (0, 600, 1200, 1900, 2300)], "k long, t long")
    got = [r.t for r in se.refractory(d, ["k"], ["t"], 1000, 10**6).orderBy("t").collect()]
    assert got == [0, 1200, 2300]


@pytest.mark.parametrize("width", [5, 60, 500, 10**9, chunked.Rows(30, 4)])
@pytest.mark.parametrize("gap", [3, 40, 700])
def test_refractory_dense_hot_key(spark, width, gap):
    d = data(spark, 2500, seed=5, hot=0.9)
    want = []
    for _, g in d.toPandas().sort_values(["t", "id"]).groupby("k"):
        last = -1e18
        for t, i in zip(g.t, g.id):
            if t - last >= gap:
                want.append(i)
                last = t
    got = sorted(r.id for r in se.refractory(d.select("k", "t", "id"), ["k"], ["t", "id"], gap, width).collect())
    assert got == sorted(want)


@pytest.mark.parametrize("width", [11, 10**9, chunked.Rows(25, 9)])
def test_lowpass(spark, width):
    d = data(spark, 1200, seed=7)
    got = {r.id: r.smooth for r in se.lowpass(d, ["k"], ["t", "id"], "v", 25.0, width).collect()}
    for _, g in d.toPandas().sort_values(["t", "id"]).groupby("k"):
        y = pt = None
        for t, i, x in zip(g.t, g.id, g.v):
            y = x if y is None else y + min(1.0, (t - pt) / 25.0) * (x - y)
            pt = t
            assert got[i] == pytest.approx(y, abs=1e-9)


@pytest.mark.parametrize("width", [0.01, 0.5, 1e6])
def test_exact_quantiles(spark, width):
    d = data(spark, 2000, seed=9).withColumn("v", F.when(F.col("id") % 50 != 0, F.col("v")))
    probs = [0.0, 0.013, 0.5, 0.7, 1.0]
    got = {r.k: [r[f"q{i}"] for i in range(5)] for r in ev.exact_quantiles(d, ["k"], "v", probs, width).collect()}
    for k, g in d.toPandas().groupby("k"):
        np.testing.assert_allclose(got[k], np.quantile(g.v.dropna(), probs), atol=1e-12)


def test_refractory_keeps_null_columns_exact(spark):
    big = 2**60 + 1
    d = spark.createDataFrame([(1, 0, big, None), (1, 5, None, "x"), (1, 20, big + 2, "y")], "k long, t long, n long, s string")
    got = sorted((r.t, r.n, r.s) for r in se.refractory(d, ["k"], ["t"], 10, 100).collect())
    assert got == [(0, big, None), (20, big + 2, "y")]
    y = {r.t: (r.n, r.smooth) for r in se.lowpass(d.withColumn("v", F.lit(2.0)), ["k"], ["t"], "v", 10, 7).collect()}
    assert y == {0: (big, 2.0), 5: (None, 2.0), 20: (big + 2, 2.0)}


def two_sided(pdf, reset=None):
    """The recursion itself, thresholds by key."""
    out = []
    for k, g in pdf.sort_values(["t", "id"]).groupby("k"):
        up, down, ref = 0.5 + k % 4 * 0.25, 0.9 - k % 3 * 0.2, None
        for r in g.to_dict("records"):
            if ref is None or (reset and r[reset]):
                v0, a, b = r["v"], 0, 0
            else:
                on, off = int(np.floor(max(r["v"] - ref, 0) / up + 1e-9)), int(np.floor(max(ref - r["v"], 0) / down + 1e-9))
                a, b = a + on, b + off
                out += [(r["id"], 1 if on else -1, i) for i in range(1, on + off + 1)]
            ref = v0 + a * up - b * down
    return sorted(out)


@pytest.mark.parametrize("width", [3, 50, 10**9, chunked.Rows(40, 7)])
@pytest.mark.parametrize("reset", [None, "flag"])
def test_two_sided_encoder_against_recursion(spark, width, reset):
    d = data(spark, 1500, seed=11).withColumns({"up": 0.5 + F.col("k") % 4 * 0.25, "down": 0.9 - F.col("k") % 3 * 0.2})
    got = se.two_sided_crossings(d, ["k"], ["t", "id"], "v", "up", "down", width, F.col(reset) if reset else None)
    assert sorted((r.id, r.p, r.ordinal) for r in got.collect()) == two_sided(d.toPandas(), reset)


@pytest.mark.parametrize(("up", "down"), [(0.5, 0.5), (0.25, 1.0), (1.0, 0.75), (0.3, 3.1)])
def test_transfer_pieces(up, down):
    """A run's pieces tell for any reference what the recursion does, and they are few."""
    r = np.random.default_rng(1)
    for n in (1, 5, 60, 400):
        v = np.round(np.cumsum(r.normal(0, 0.6, n)), 2)
        before = float(v[0]) + 0.05
        ends, da, db = se.transfer_pieces(v, before, up, down)
        assert (np.diff(ends) > 0).all() and len(ends) <= n + 2
        for x in r.uniform(before - up, before + down, 50):
            _, _, (_, a, b) = se.two_sided_steps(v, np.zeros(n, bool), up, down, (float(x), 0, 0))
            i = int(np.searchsorted(ends, x))
            assert (da[i], db[i]) == (a, b)


@pytest.mark.parametrize("kind", ["long", "double", "timestamp"])
def test_one_hot_instant_is_cut(spark, kind):
    """All rows of a key at one time, most rows of another within a few units: chunks stay below twice the target, in order."""
    r = np.random.default_rng(13)
    rows = [(0, 500, int(i)) for i in r.permutation(4000)] + [(1, int(t), 10_000 + i) for i, t in enumerate(r.integers(70, 74, 3000))] + [(2, i * 10**6, i) for i in range(300)] + [(1, 10**9, 50_000)]
    d = spark.createDataFrame(rows, "k long, t long, id long").withColumn("id", F.col("id").cast(kind))
    c = chunked.with_chunk(d, ["k"], ["t", "id"], chunked.Rows(50, 1000))
    got = c.toPandas().sort_values(["k", "t", "id"])
    assert len(got) == len(rows) and c.columns == [*d.columns, chunked.CHUNK]
    sizes = got.groupby(["k", chunked.CHUNK]).size()
    assert sizes.max() < 100
    assert (got.groupby("k")[chunked.CHUNK].diff().dropna() >= 0).all()
    assert {k: len(s) for k, s in sizes.groupby("k")}[0] >= 50


def test_operators_over_a_hot_instant(spark):
    """Positions, encoding and the minimum gap over rows that share their time."""
    r = np.random.default_rng(14)
    pdf = pd.DataFrame({"k": 0, "t": np.where(np.arange(1500) < 1200, 100, np.arange(1500)), "id": np.arange(1500), "v": np.round(np.cumsum(r.normal(0, 1, 1500)), 3)})
    d, w = spark.createDataFrame(pdf).repartition(5), chunked.Rows(40, 500)
    assert [x.pos for x in chunked.positions(d, ["k"], ["t", "id"], w).orderBy("id").collect()] == list(range(1500))
    got = se.encode_crossings(d, ["k"], ["t", "id"], "v", 0.75, w)
    assert sorted((x.id, x.p, x.ordinal) for x in got.collect()) == encode(pdf, 0.75)
    assert [x.id for x in se.refractory(d.select("k", "t", "id"), ["k"], ["t", "id"], 5, w).orderBy("id").collect()][:2] == [0, 1200]


def test_rows_alike_in_all_that_can_cut_stay_together(spark):
    d = spark.createDataFrame([(0, 5, f"n{i:04d}") for i in range(300)], "k long, t long, name string")
    c = chunked.with_chunk(d, ["k"], ["t", "name"], chunked.Rows(50, 10))
    assert c.count() == 300 and c.select(chunked.CHUNK).distinct().count() == 1
