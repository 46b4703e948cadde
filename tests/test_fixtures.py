"""Small cases with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.functions import light
from eventloom.functions import rotation as rot
from eventloom.functions import vectors as vec
from eventloom.operators import events as ev
from eventloom.operators import frames as fr
from eventloom.operators import pixels as px
from eventloom.operators import separation as sep
from eventloom.operators import series as se
from eventloom.operators import statistics as st
from eventloom.operators import tags as tg
from eventloom.sources import readers, writers

S = ev.SERIES


def evs(spark, rows, cols="x int, y int, t_us long, p int, w double"):
    return spark.createDataFrame([(1, "c", i, *r) for i, r in enumerate(rows)], f"episode long, camera string, event_id long, {cols}")


def test_future_pair(spark):
    d = spark.createDataFrame([(4,), (18,)], "k long")
    f = fr.future_pair(F.col("k"), 10, 0.01, 25.0, F.lit(20))
    a, b = d.select("k", *[v.alias(n) for n, v in f.items()]).orderBy("k").collect()
    assert (a["left"], a["right"], a.alpha, a.valid) == (6, 7, 0.5, True)
    assert (b["left"], b["right"], b.alpha, b.valid) == (19, 19, 0.0, False)


def test_voxels_by_hand(spark):
    e = evs(spark, [(0, 0, 1000, -1, 1.0), (31, 31, 11000, 1, 0.5), (16, 16, 19000, 1, 0.5)])
    g = ev.bin_sums(e, S, 10_000, (32, 32), (16, 16), {"v": F.col("w")})
    got = {(r.bin, r.pol, r.oy, r.ox): r.v for r in g.collect()}
    assert got[(0, 0, 0, 0)] == 1.0
    assert sum(v for (b, p, _, _), v in got.items() if b == 1 and p == 1) == 1.0


def test_voxel_pair_is_two_singles_and_sums_hold(spark):
    r = np.random.default_rng(0)
    rows = [(int(x), int(y), int(t), int(p), float(w)) for x, y, t, p, w in zip(r.integers(-3, 484, 5000), r.integers(0, 363, 5000), r.integers(0, 80_000, 5000), r.choice([-1, 1], 5000), r.random(5000))]
    e = evs(spark, rows)
    w1, w2 = F.col("w"), 1 - F.col("w")
    pair = ev.bin_sums(e, S, 10_000, (360, 480), (96, 128), {"a": w1, "b": w2})
    one = ev.bin_sums(e, S, 10_000, (360, 480), (96, 128), {"a": w1})
    key = ["bin", "pol", "oy", "ox"]
    assert {tuple(x[k] for k in key): round(x.a, 9) for x in pair.collect()} == {tuple(x[k] for k in key): round(x.a, 9) for x in one.collect()}
    inside = [x for x in rows if 0 <= x[0] < 480 and 0 <= x[1] < 360]
    assert pair.agg(F.sum("a")).first()[0] == pytest.approx(sum(x[4] for x in inside))


def test_last_cell(spark):
    g = ev.bin_sums(evs(spark, [(479, 359, 0, 1, 1.0)]), S, 10_000, (360, 480), (96, 128), {"v": F.col("w")}).collect()
    assert [(r.oy, r.ox) for r in g] == [(95, 127)]


def test_label_then_voxelize(spark):
    ts, pol = (1000, 2000, 11000, 12000), (-1, 1, -1, 1)
    e = evs(spark, [(i, i, ts[i], pol[i], 1.0) for i in range(4)])
    maps = spark.createDataFrame([(1, "c", 0, y, x, 1.0, 0.5, 1.0 if (y, x) == (3, 3) else 0.0) for y in range(4) for x in range(4)],
                                 "episode long, camera string, frame_index long, y int, x int, q_static double, q_dynamic double, q_illumination double")
    cols = ["q_static", "q_dynamic", "q_illumination"]
    lab = ev.label_events(e, maps, 10**9, 1, cols).select(*e.columns, *[F.col(f"map_{c}").alias(c) for c in cols])
    g = ev.bin_sums(lab, S, 10_000, (4, 4), (2, 2), ev.class_weights())
    got = {(r.bin, r.pol, r.oy, r.ox): (r.w_static, r.w_dynamic) for r in g.collect()}
    assert sum(v[0] for v in got.values()) == 3 and sum(v[1] for v in got.values()) == 1.5
    assert got[(0, 0, 0, 0)][0] == got[(0, 1, 0, 0)][0] == got[(1, 0, 1, 1)][0] == 1 and got[(1, 1, 1, 1)][0] == 0


def test_history_windows_match_brute_force(spark):
    r = np.random.default_rng(3)
    e = evs(spark, [(1, 1, int(t), 1, 1.0) for t in r.integers(0, 400_000, 800)])
    s = ev.bin_sums(e, S, 10_000, (4, 4), (1, 1), {"v": F.col("w")})
    got = {(x.frame_index, x.t_bin): x.v for x in ev.voxel_history(s, S, 8, 4, 11, 0, ["v"]).collect()}
    want = {}
    for t in (x.t_us for x in e.collect()):
        for k in range(11):
            b = t // 10_000 - (4 * k - 8)
            if 0 <= b < 8:
                want[(k, b)] = want.get((k, b), 0) + 1
    assert got == want


def test_range_join_matches_brute_force(spark):
    r = np.random.default_rng(4)
    e = evs(spark, [(1, 1, int(t), 1, 1.0) for t in r.integers(0, 10_000, 300)])
    f = spark.createDataFrame([(1, "c", k, int(t)) for k, t in enumerate(r.integers(0, 12_000, 40))], "episode long, camera string, frame_index long, frame_t_us long")
    for before, after, bucket in ((700, 0, 1000), (0, 333, 100), (50, 60, 7)):
        got = sorted((x.frame_index, x.event_id) for x in ev.event_windows(f, e, S, before, after, bucket).collect())
        ts = [(x.event_id, x.t_us) for x in e.collect()]
        want = sorted((x.frame_index, i) for x in f.collect() for i, t in ts if x.frame_t_us - before <= t < x.frame_t_us + after)
        assert got == want


def test_tokens(spark):
    """3 bins, 16x16, patch 8, k=2: one OFF block in bin 0, one ON block in bin 2; 7 rows, 3 unmasked, summary first."""
    rows = [(1, "c", 0, 0, y, x, 1.0) for y in range(8) for x in range(8)] + [(1, "c", 2, 1, y, x, 1.0) for y in range(8, 16) for x in range(8, 16)]
    v = spark.createDataFrame(rows, "episode long, camera string, t_bin int, pol int, oy int, ox int, value double")
    d = ev.patch_density(v, S, 8, (16, 16), "value")
    t = ev.patch_tokens(d, v.select(*S).distinct(), S, 3, 2, (2, 2)).orderBy("token").collect()
    assert len(t) == 7 and sum(r.mask for r in t) == 3
    assert t[0].patch_index == -1 and t[0].mask and t[0].density == 1
    assert (t[1].patch_index, t[1].density) == (0, 1.0) and (t[5].patch_index, t[5].cx, t[5].cy) == (3, 0.75, 0.75)


def test_tokens_pad_small_grids(spark):
    v = spark.createDataFrame([(1, "c", 0, 0, 0, 0, 1.0)], "episode long, camera string, t_bin int, pol int, oy int, ox int, value double")
    t = ev.patch_tokens(ev.patch_density(v, S, 8, (8, 8), "value"), v.select(*S).distinct(), S, 1, 3, (1, 1)).orderBy("token").collect()
    assert [r.patch_index for r in t] == [-1, 0, -1, -1]


def test_histogram_keeps_empty_bins_and_closes_the_end(spark):
    e = evs(spark, [(1, 1, 0, 1, 1.0), (1, 1, 25, 1, 1.0), (1, 1, 40, 1, 1.0), (1, 1, 41, 1, 1.0)])
    assert [r.n for r in ev.time_histogram(e, S, 10, 4).orderBy("bin").collect()] == [1, 0, 1, 1]


@pytest.mark.parametrize("every,rows,test,train_n", [
    (10, [(i, None, i != 3) for i in range(25)], {9, 19}, 22),
    (2, [(0, "train", True), (1, "test", True), (2, None, None)], {1}, 2),
])
def test_split(spark, every, rows, test, train_n):
    d = fr.assign_split(fr.exclude_failures(spark.createDataFrame(rows, "sample_index long, split string, success boolean")), every).collect()
    assert {r.sample_index for r in d if r.ml_split == "test"} == test
    assert len([r for r in d if r.ml_split == "train"]) == train_n


def test_split_missing_files(spark):
    s = spark.createDataFrame([(0,), (1,), (2,)], "sample_index long")
    assert {r[0] for r in fr.only_present(s, s.where("sample_index <> 1"), "sample_index").collect()} == {0, 2}


def test_outcomes(spark):
    z = {1: (0.0, 0.2, -1), 2: (1.0, 0.9, 1), 3: (0.0, 0.05, 1), 4: (0.0, 0.05, -1), 5: (1.0, 0.9, -1)}
    rows = [(e, k, 0.0, 0.0, 0.0, 0.0, 0.0, v[k], float(v[2])) for e, v in z.items() for k in (0, 1)]
    o = fr.label_outcome(spark.createDataFrame(rows, "episode long, frame_index long, ee_x double, ee_y double, ee_z double, obj_x double, obj_y double, obj_z double, gripper double"), ["episode"])
    assert {r.episode: r.reason for r in o.collect()} == {1: "grasp_success", 2: "object_fell", 3: "missed_object_or_timeout", 4: "grasp_failed", 5: "object_fell"}


def test_wrapped_delta(spark):
    d = spark.createDataFrame([([0.0] * 3 + [3.1, 0.0, 0.0, 1.0], [0.0] * 3 + [-3.1, 0.0, 0.0])], "a array<double>, s array<double>")
    got = d.select(vec.delta_action(F.col("a"), F.col("s"))).first()[0]
    assert got[3] == pytest.approx(6.2 - 2 * math.pi) and got[6] == 1.0


def test_action_chunk_blocks(spark):
    d = spark.createDataFrame([(e, k, e * 100 + k) for e in (1, 2) for k in range(23)], "episode long, frame_index long, a long")
    for block in (5, 7, 4096):
        for r in fr.action_chunk(d, ["episode"], 5, "a", block=block).collect():
            ks = [min(r.frame_index + i, 22) for i in range(5)]
            assert r.chunk == [r.episode * 100 + k for k in ks] and r.is_pad == [r.frame_index + i > 22 for i in range(5)]


def test_newest_chunk_wins(spark):
    rows = [("t", c, c + o, float(100 * c + o)) for c in (0, 2) for o in (-1, 0, 1, 2)]
    m = fr.merge_chunks(spark.createDataFrame(rows, "k string, chunk long, step long, v double"), ["k"], "step", "chunk", "v")
    assert {r.step: r.v for r in m.collect()} == {0: 0.0, 1: 1.0, 2: 200.0, 3: 201.0, 4: 202.0}


def test_tolerant_rank_chain(spark):
    d = spark.createDataFrame([(1, 0, 10.0), (1, 1, 9.95), (1, 2, 9.9), (1, 3, 9.0)], "s long, slot long, v double")
    got = [r["rank"] for r in tg.tolerant_rank(d, ["s"], "v", "slot", 0.1).orderBy("slot").collect()]
    assert got == [1, 1, 1, 4]


def pixels(spark, frames, h, w, fn, run=(1, "c")):
    rows = [(*run, k, y, x, *fn(k, y, x)) for k in range(frames) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "episode long, camera string, frame_index long, y int, x int, depth double, mvx double, mvy double, r int, g int, b int, seg int")


def cameras(spark, frames, step, f, cx, cy, run=(1, "c")):
    return spark.createDataFrame([(*run, k, step * k, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, float(f), float(f), float(cx), float(cy)) for k in range(frames)],
                                 "episode long, camera string, frame_index long, tx double, ty double, tz double, qw double, qx double, qy double, qz double, fx double, fy double, cx double, cy double")


def test_identity_flow(spark):
    p = pixels(spark, 2, 6, 8, lambda k, y, x: (1.0, 0.0, 0.0, 9, 9, 9, 0))
    for r in px.ego_flow(p, cameras(spark, 2, 0.0, 50, 4, 3), 8, 6).where("valid").collect():
        assert abs(r.ego_x) < 1e-5 and abs(r.ego_y) < 1e-5 and r.depth_pred == pytest.approx(1.0)


def test_calibration_recovers_convention(spark):
    p = pixels(spark, 4, 20, 30, lambda k, y, x: (1.0, 4.0 if k > 0 else 0.0, 0.0, 9, 9, 9, 0))
    c = sep.calibrate(sep.motion_candidates(p, cameras(spark, 4, 0.1, 50, 15, 10), 30, 20)).first()
    assert (c.offset, c.sign) == (1, -1.0) and c.scale == pytest.approx(1.25, abs=1e-3)


@pytest.mark.parametrize("depth,lo,hi", [(0.0, 0.9, 1.0), (0.9, 0.0, 0.11)])
def test_fusion(spark, depth, lo, hi):
    m = light.fuse(F.lit(0.9), F.lit(depth), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(True))
    r = spark.range(1).select(*[v.alias(k) for k, v in m.items()]).first()
    assert lo <= r.q_illumination <= hi
    assert (r.q_dynamic < 0.5 and r.q_unknown > 0.9 and r.q_static < 0.1) if depth == 0 else r.q_dynamic > 0.8


def test_same_image_is_static(spark):
    r = np.random.default_rng(2)
    img = r.integers(0, 255, (10, 12, 3))
    p = pixels(spark, 3, 10, 12, lambda k, y, x: (1.0, 0.0, 0.0, *map(int, img[y, x]), 0))
    for causal in (False, True):
        m = sep.separate(p, cameras(spark, 3, 0.0, 10, 6, 5), 1.0, 12, 10, causal=causal)
        assert m.count() == 3 * 10 * 12
        q = m.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("q_static", "q_dynamic", "q_motion", "q_illumination", "q_unknown") for f in (F.min, F.max, F.avg)]).first()
        assert all(0 <= q[f"min_{c}"] and q[f"max_{c}"] <= 1 for c in ("q_static", "q_dynamic", "q_motion", "q_illumination", "q_unknown"))
        assert q.avg_q_static > q.avg_q_dynamic


def test_grid_with_hole_is_reported(spark):
    p = pixels(spark, 1, 4, 4, lambda k, y, x: (1.0, 0.0, 0.0, 9, 9, 9, 0))
    assert px.dense_check(p, 4, 4).count() == 0
    assert px.dense_check(p.where("NOT (x = 2 AND y = 1)"), 4, 4).count() == 1
    # stencils use coordinates, so a hole does not shift its neighbours
    d = px.dilate(p.withColumn("m", F.when((F.col("x") == 3) & (F.col("y") == 1), 1).otherwise(0)).where("NOT (x = 2 AND y = 1)"), {"o": ("m", 1)})
    assert d.where("x = 1 AND y = 1").first().o == 0


def test_ellipse_rows():
    assert px.ellipse_rows(2) == {-2: 0, -1: 2, 0: 2, 1: 2, 2: 0}
    assert px.ellipse_rows(3)[2] == 2 and px.ellipse_rows(8)[8] == 0


def test_rotation_round_trip(spark):
    r = np.random.default_rng(6)
    q = r.normal(size=(200, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    d = spark.createDataFrame([tuple(map(float, row)) for row in q], "w double, x double, y double, z double")
    e = rot.from_euler(rot.euler(rot.cols("w", "x", "y", "z")))
    u = rot.rotate(rot.cols("w", "x", "y", "z"), [F.lit(0.3), F.lit(-0.2), F.lit(0.9)])
    back = rot.rotate_inv(rot.cols("w", "x", "y", "z"), u)
    for row in d.select("w", "x", "y", "z", *[c.alias(f"e{i}") for i, c in enumerate(e)], *[c.alias(f"b{i}") for i, c in enumerate(back)]).collect():
        dot = abs(sum(row[i] * row[4 + i] for i in range(4)))
        assert dot == pytest.approx(1, abs=1e-9)
        assert [row[8], row[9], row[10]] == pytest.approx([0.3, -0.2, 0.9])


def test_t_critical():
    assert st.t_critical(9) == pytest.approx(2.262157162740992, abs=1e-8)
    assert st.t_critical(1) == pytest.approx(12.706204736432095, abs=1e-6)


def test_t_for_every_size(spark):
    got = {r.n: r._t for r in st.with_t(spark.createDataFrame([(n,) for n in (1, 2, 31, 41, 121, 100001)], "n long")).collect()}
    assert got.pop(1) is None
    assert got == pytest.approx({2: 12.7062047364, 31: 2.0422724563, 41: 2.0210753903, 121: 1.9799304051, 100001: 1.9599877077}, abs=1e-8)


def test_wilcoxon_exact_and_large(spark):
    import itertools

    rows = [("a", i, d) for i, d in enumerate([1.0, -2.0, 3.0, 0.0, 3.0, -0.5, 4.0])]
    r = np.random.default_rng(8)
    big = r.normal(0.2, 1, 80)
    rows += [("b", i, float(x)) for i, x in enumerate(big)]
    table = spark.createDataFrame(rows, "metric string, i long, delta double")
    got = {x.metric: x for x in st.wilcoxon(table, ["metric"]).collect()}
    d = [x[2] for x in rows if x[0] == "a" and x[2] != 0]
    a = sorted(map(abs, d))
    rank = {v: np.mean([i + 1 for i, u in enumerate(a) if u == v]) for v in a}
    ranks = [rank[abs(x)] for x in d]
    w = sum(k for k, x in zip(ranks, d) if x > 0)
    sums = [sum(k for k, s in zip(ranks, signs) if s) for signs in itertools.product((0, 1), repeat=len(d))]
    want = min(1.0, 2 * min(np.mean([s <= w for s in sums]), np.mean([s >= w for s in sums])))
    assert got["a"].w_plus == w and got["a"].p_value == pytest.approx(want)
    order = np.argsort(np.abs(big))
    wb = sum(i + 1 for i, j in enumerate(order) if big[j] > 0)
    z = abs(wb - 80 * 81 / 4) / math.sqrt(80 * 81 * 161 / 24)
    normal = st.wilcoxon(table, ["metric"], method="normal").where("metric = 'b'").first()
    assert normal.w_plus == wb and normal.p_value == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-10)
    # the exact distribution of 80 ranks, counted in whole numbers
    ways = [1]
    for k in range(1, 81):
        ways = [(ways[i] if i < len(ways) else 0) + (ways[i - k] if 0 <= i - k < len(ways) else 0) for i in range(len(ways) + k)]
    exact = min(1.0, 2 * min(sum(ways[: wb + 1]), sum(ways[wb:])) / 2**80)
    assert got["b"].w_plus == wb and got["b"].p_value == pytest.approx(exact, rel=1e-12)


def test_normal_tail(spark):
    zs = [0.0, 0.3, 1.0, 2.0, 3.0, 3.6, 5.0, 8.0]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(st._two_sided(F.col("z"))).collect()]
    assert got == pytest.approx([math.erfc(z / math.sqrt(2)) for z in zs], rel=1e-9, abs=1e-18)


def test_wilcoxon_exact_for_thousands_of_pairs(spark):
    """5,000 pairs in blocks of frequencies, near the normal value; with and without ties the sums of all 2^12 signs."""
    import itertools
    import time

    r = np.random.default_rng(8)
    big = r.normal(0.02, 1, 5000)
    small, tied = r.normal(0.3, 1, 12), r.integers(-4, 6, 12).astype(float)
    rows = [("big", float(x)) for x in big] + [("small", float(x)) for x in small] + [("tied", float(x)) for x in tied]
    d = spark.createDataFrame(rows, "metric string, delta double").repartition(4)
    t0 = time.time()
    got = {x.metric: x for x in st.wilcoxon(d, ["metric"]).collect()}
    assert time.time() - t0 < 60
    near = {x.metric: x for x in st.wilcoxon(d, ["metric"], method="normal").collect()}
    assert got["big"].n == 5000 and abs(got["big"].p_value - near["big"].p_value) < 1e-4
    for name, x in (("small", small), ("tied", tied[tied != 0])):
        size = np.abs(x)
        rank = np.array([(size < v).sum() + ((size == v).sum() + 1) / 2 for v in size])
        w = rank[x > 0].sum()
        sums = np.array([rank[np.array(s)].sum() for s in itertools.product([False, True], repeat=len(x))])
        assert got[name].p_value == pytest.approx(min(1, 2 * min((sums <= w).mean(), (sums >= w).mean())), abs=1e-12)


def test_bootstrap_blocks_do_not_change_it(spark, monkeypatch):
    d = spark.createDataFrame([("m", i, float(i * i % 37)) for i in range(50)], "metric string, episode long, delta double")
    whole = st.bootstrap_ci(d, ["metric"], ["episode"], 300, 2).first()
    monkeypatch.setattr(st, "BLOCK", 7)
    monkeypatch.setattr(st, "RESAMPLES", 41)
    cut = st.bootstrap_ci(d, ["metric"], ["episode"], 300, 2).first()
    assert cut.ci_low == pytest.approx(whole.ci_low, abs=1e-12) and cut.ci_high == pytest.approx(whole.ci_high, abs=1e-12)


def test_bootstrap_is_reproducible_and_sane(spark):
    d = spark.createDataFrame([("m", i, float(i % 7) - 2) for i in range(40)], "metric string, episode long, delta double")
    a = st.bootstrap_ci(d, ["metric"], ["episode"], 500, 1).first()
    b = st.bootstrap_ci(d.repartition(7), ["metric"], ["episode"], 500, 1).first()
    x = np.array([i % 7 - 2 for i in range(40)])
    half = 1.96 * x.std() / math.sqrt(40)
    assert (a.ci_low, a.ci_high) == (b.ci_low, b.ci_high)
    assert a.ci_low == pytest.approx(x.mean() - half, abs=0.2) and a.ci_high == pytest.approx(x.mean() + half, abs=0.2)


def test_harmonic_line(spark):
    """Bursts every 40 ms put nearly all power on the 25 Hz harmonics."""
    e = evs(spark, [(1, 1, 40_000 * k + j, 1, 1.0) for k in range(50) for j in range(5)])
    r = ev.harmonic_power(e, S, 1000, 2000, 1e-3).first()
    assert r.harmonic_power_ratio > 0.95 and r.line_db > 20


def test_fingerprint_changes_with_content_and_code(spark):
    d = spark.createDataFrame([(1, "x"), (1, "y")], "k long, h string")
    f = lambda v: {r.fingerprint for r in writers.with_fingerprint(d, {"h": F.col("h")}, v).collect()}
    assert len(f("1")) == 2 and not f("1") & f("2")


def test_round_trip_reports_loss(spark):
    e = evs(spark, [(1, 1, i, 1, 1.0) for i in range(5)])
    assert writers.round_trip(e, e, S).count() == 0
    assert writers.round_trip(e, e.where("event_id > 0"), S).first().reread == 4


def test_checked_export_refuses_early_events(spark, tmp_path):
    e = evs(spark, [(1, 1, -5, 1, 1.0)])
    with pytest.raises(ValueError, match="early"):
        writers.checked_export(e, str(tmp_path / "x"), S, 10, 10)
    good = evs(spark, [(1, 1, 5, 1, 1.0)])
    with pytest.raises(ValueError, match="empty"):
        writers.checked_export(good.where("false"), str(tmp_path / "y"), S, 10, 10)
    with pytest.raises(ValueError, match="empty"):
        writers.checked_export(good, str(tmp_path / "z"), S, 10, 10, good.select(*S).unionByName(good.select((F.col(S[0]) + 1).alias(S[0]), *S[1:])))


def test_json_sources(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"name": "demo1", "event_count": 5, "instruction": {"task": "pick", "objects": ["cup"]}}, {"name": "demo2"}]')
    (tmp_path / "d.json").write_text('{"samples": [{"sample_index": 3, "success": true, "event_counts": {"wrist": 7}}, {"sample_index": 4, "success": null}]}')
    m = readers.read_manifest(spark, str(tmp_path / "m.json")).orderBy("name").collect()
    assert [x.name for x in m] == ["demo1", "demo2"] and m[0].instruction.objects == ["cup"]
    s = readers.read_samples(spark, str(tmp_path / "d.json")).orderBy("sample_index").collect()
    assert s[0].event_counts == {"wrist": 7} and s[1].success is None


def test_sample_index_of_reference_records(spark):
    doc = '{"sample_index": %d, "source_csv": %s, "simulation_seed": 11, "frame_count": 42, "outcome": {"success": false, "termination_reason": "timeout"}, "events": {"wrist": {"event_count": 9, "size_bytes": 3}, "side": {"event_count": 4}}}'
    rows = [(doc % (1, '{"zero_based_row": 5, "source_episode_index": 77}'), "train/part_0/sample_000001/reproduction.json"), (doc % (2, "null"), "sample_000002/reproduction.json")]
    s = writers.sample_index(spark.createDataFrame(rows, "doc string, path string")).orderBy("sample_index").collect()
    assert [(x.split, x.relative_path, x.source_csv_row, x.source_episode_index) for x in s] == [("train", "train/part_0/sample_000001", 5, 77), ("unsplit", "sample_000002", None, None)]
    assert all((x.simulation_seed, x.success, x.termination_reason, x.frame_count, x.event_counts) == (11, False, "timeout", 42, {"wrist": 9, "side": 4}) for x in s)


def test_demo_scan_and_conditions(spark, tmp_path):
    for n in (1, 2, 10):
        (tmp_path / f"demo{n}").mkdir()
        (tmp_path / f"demo{n}" / "a.h5").write_bytes(b"x" * n)
    (tmp_path / "demo2" / "b.h5").write_bytes(b"y")
    rows = readers.scan_demos(spark, str(tmp_path)).orderBy("demo", "path").collect()
    assert [(r.demo, r.files) for r in rows] == [(1, 1), (2, 2), (2, 2), (10, 1)]
    (tmp_path / "c.csv").write_text("episode_index,objects\n7,\"['a', 'cup']\"\n9,\"['b']\"\n")
    r = readers.read_conditions(spark, str(tmp_path / "c.csv"), "episode_index", 1, ("objects",)).collect()
    assert len(r) == 1 and r[0].objects == ["b"]


def test_reports(spark, tmp_path):
    d = spark.createDataFrame([("a", 1.5, 1200), ("b", float("nan"), 3)], "name string, value double, n long")
    writers.write_report(d, str(tmp_path / "md"), "markdown", ["name"])
    lines = [r.value for r in spark.read.text(str(tmp_path / "md")).collect()]
    assert lines == ["| name | value | n |", "| --- | ---: | ---: |", "| a | 1.5000 | 1,200 |", "| b | n/a | 3 |"]
    writers.write_report(d, str(tmp_path / "js"), "json", ["name"])
    assert spark.read.text(str(tmp_path / "js")).orderBy("value").first().value == '{"name":"a","value":1.5,"n":1200}'


def test_parts_of_vanished_inputs_go(spark, tmp_path):
    """Odd names and two keys: only the folders of inputs that are gone are removed."""
    rows = [("a b/ü=1", 1, 5), ("a b/ü=1", 2, 6), ("c%d", 1, 7)]
    t = writers.with_fingerprint(spark.createDataFrame(rows, "name string, part int, n long"), {"n": F.col("n")}, "v1")
    path = str(tmp_path / "t")
    writers.materialize(spark, t, lambda x: x, path, ["name", "part"])
    for keep in ("part = 1 or n = 6", "part = 1", "n = 7"):
        out = writers.materialize(spark, t.where(keep), lambda x: x.withColumn("n", F.lit(-1).cast("long")), path, ["name", "part"])
        want = sorted(tuple(r) for r in t.where(keep).select("name", "part", "n").collect())
        assert sorted(tuple(r) for r in out.select("name", "part", "n").collect()) == want
        assert sorted(tuple(r) for r in spark.read.parquet(path).select("name", "part", "n").collect()) == want


def test_checked_export_evaluates_its_input_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(it):
        for b in it:
            seen.add(b.num_rows)
            yield b

    e = spark.range(100).selectExpr("id % 2 AS episode", "'c' AS camera", "id AS event_id", "id AS t_us", "1 AS x", "1 AS y", "cast(1 AS tinyint) AS p").mapInArrow(count, "episode long, camera string, event_id long, t_us long, x int, y int, p tinyint")
    assert writers.checked_export(e, str(tmp_path / "x"), ["episode", "camera"], 10, 10).count() == 0
    assert seen.value == 100
