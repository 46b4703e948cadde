"""Streams whose files come out of order, in many micro-batches: batch results, and state that stays small."""

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventloom.operators import series as se
from eventloom.operators import separation as sep
from eventloom.streaming import raster, stateful
from tests import test_separation_brute as scene

SCHEMA = "k long, t long, id long, v double, flag boolean"
SPAN = 200  # milliseconds; t is in milliseconds here


def files(path, pdf, parts):
    """Parquet files in the order of ``parts`` (rows of each)."""
    for i, part in enumerate(parts):
        pdf.iloc[part].to_parquet(path / f"part-{i:03d}.parquet")
        os.utime(path / f"part-{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return str(path)


def series(n=900, keys=4, seed=3):
    r = np.random.default_rng(seed)
    return pd.DataFrame({"k": np.where(r.random(n) < 0.6, 0, r.integers(0, keys, n)), "t": np.sort(r.integers(0, 9000, n)), "id": np.arange(n), "v": np.round(np.cumsum(r.normal(0, 1, n)), 3), "flag": r.random(n) < 0.04})


def run(stream, out):
    """All rows handed out, and the progress of the micro-batches."""
    q = stream.writeStream.outputMode("append").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/{i}")).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = stream.sparkSession.read.schema(stream.schema).parquet(*[f"{out}/{p['batchId']}" for p in q.recentProgress if os.path.exists(f"{out}/{p['batchId']}")])
    return rows, [p for p in q.recentProgress]


@pytest.fixture(scope="module")
def disordered(spark, tmp_path_factory):
    """Eight files whose times overlap, two by two in reverse, and a last row far ahead."""
    pdf = series()
    part = np.minimum((pdf.t + np.random.default_rng(5).integers(0, 600, len(pdf))) // 1200, 7)
    end = pd.DataFrame([(-1, 10**7, -1, 0.0, False)], columns=list(pdf))
    order = [1, 0, 3, 2, 5, 4, 7, 6]
    path = files(tmp_path_factory.mktemp("late"), pd.concat([pdf, end], ignore_index=True), [*(np.flatnonzero(part == i) for i in order), [len(pdf)]])
    return path, pdf


def applied(spark, path, processor, schema, delay="3 seconds"):
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    return stateful.apply(s, ["k"], processor, schema, event_time=F.timestamp_millis("t"), delay=delay)


def rows(df, *cols):
    return sorted(tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("kind", ["crossings", "gap", "lowpass"])
def test_out_of_order_files(spark, disordered, tmp_path, kind):
    path, pdf = disordered
    d, args = spark.createDataFrame(pdf, SCHEMA), (["k"], ["t", "id"])
    if kind == "crossings":
        p, schema = stateful.CrossingEncoder(*args, "v", 0.6, reset="flag", span=SPAN), "k long, t long, id long, p int, ordinal int, t_cross double"
        want, cols = se.encode_crossings(d, *args, "v", 0.6, 700, reset=F.col("flag")), ("id", "p", "ordinal", "t_cross")
    elif kind == "gap":
        p, schema = stateful.MinimumGap(["t", "id"], 60, ["k", "t", "id"], SPAN), "k long, t long, id long"
        want, cols = se.refractory(d.select("k", "t", "id"), *args, 60, 900), ("k", "t", "id")
    else:
        p, schema = stateful.LowPass(["t", "id"], "v", 30.0, ["k", "id"], SPAN), "k long, id long, smooth double"
        want, cols = se.lowpass(d, *args, "v", 30.0, 900), ("id", "smooth")
    got, progress = run(applied(spark, path, p, schema), str(tmp_path / "out"))
    assert rows(got, *cols) == rows(want, *cols)
    assert len(progress) >= 9 and sum(p["sink"]["numOutputRows"] > 0 if p["sink"]["numOutputRows"] >= 0 else 1 for p in progress) >= 3


def test_rows_later_than_the_delay_change_nothing(spark, tmp_path):
    # Spark drops by the watermark of the batch before; a row that is too late for one batch only is still taken in order
    pdf = pd.DataFrame([(0, t, t, 1.0, False) for t in range(100, 5100, 100)] + [(0, 150, 10**6, 1.0, False), (-1, 10**7, -1, 0.0, False)], columns=["k", "t", "id", "v", "flag"])
    for name, parts, late in (("late", [range(49), [49], [50], [51]], False), ("just", [range(49), [50], [49], [51]], True)):
        d = tmp_path / name
        d.mkdir()
        files(d, pdf, parts)
        got, _ = run(applied(spark, str(d), stateful.MinimumGap(["t", "id"], 10, ["k", "t", "id"], SPAN), "k long, t long, id long", "1 second"), str(tmp_path / f"{name}-out"))
        assert [r[1] for r in rows(got, "k", "t")] == sorted([*range(100, 5100, 100), *([150] if late else [])])


def test_merge_state_is_bounded(spark, tmp_path):
    """Forty batches, each with proposals for the next five steps: every step once, by its newest chunk, and few in state."""
    plan = [(k, c, c + s, float(100 * c + s), 1000 * c + 10 * s + 1) for c in range(40) for s in range(5) for k in (1, 2)]
    pdf = pd.DataFrame(plan + [(-1, 10**6, 10**6, 0.0, 10**9)], columns=["k", "chunk", "step", "v", "t"])
    d = tmp_path / "in"
    d.mkdir()
    files(d, pdf, [*(np.flatnonzero(pdf.chunk == c) for c in range(40)), [len(pdf) - 1]])
    s = spark.readStream.schema("k long, chunk long, step long, v double, t long").option("maxFilesPerTrigger", 1).parquet(str(d))
    m = stateful.apply(s, ["k"], stateful.ChunkMerge(["k"], "step", "chunk", "v", 1000), "k long, step long, from_chunk long, v double", event_time=F.timestamp_millis("t"), delay="500 milliseconds")
    got, progress = run(m, str(tmp_path / "out"))
    want = sorted((k, s, min(s, 39), 100.0 * min(s, 39) + s - min(s, 39)) for k in (1, 2) for s in range(44))
    assert rows(got, "k", "step", "from_chunk", "v") == want
    held = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in progress]
    assert len(held) >= 40 and max(held) <= 60  # steps and timers of two keys


def test_many_keys_leave_no_rows_behind(spark, disordered, tmp_path):
    path, pdf = disordered
    _, progress = run(applied(spark, path, stateful.LowPass(["t", "id"], "v", 30.0, ["k", "id"], SPAN), "k long, id long, smooth double"), str(tmp_path / "out"))
    # at the end: the running value of each key, and the one stretch of the row far ahead
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= pdf.k.nunique() + 6


def pixels(spark):
    depth, rgb, mv = scene.scene()
    k, y, x = (a.ravel() for a in np.mgrid[: scene.T, : scene.H, : scene.W])
    p = pd.DataFrame({"episode": 1, "camera": "c", "frame_index": k, "y": y.astype("int32"), "x": x.astype("int32"), "depth": depth.ravel(), "mvx": mv[..., 0].ravel(), "mvy": mv[..., 1].ravel(), "r": rgb[..., 0].ravel(), "g": rgb[..., 1].ravel(), "b": rgb[..., 2].ravel()}).astype({c: "int32" for c in "rgb"})
    turn = [(1, "c", i, 0.05 * i, 0.01 * i, 0.0, math.cos(0.01 * i), 0.0, math.sin(0.01 * i), 0.0, scene.FX, scene.FX, scene.CX, scene.CY) for i in range(scene.T)]
    cams = spark.createDataFrame(turn, "episode long, camera string, frame_index long, tx double, ty double, tz double, qw double, qx double, qy double, qz double, fx double, fy double, cx double, cy double")
    return p, cams


PIXELS = "episode long, camera string, frame_index long, y int, x int, depth double, mvx double, mvy double, r int, g int, b int"


def test_separation_of_scattered_pixels(spark, tmp_path):
    """Pixels of all frames mixed over seven files, a turning camera: the batch form, with nothing left but what no frame follows."""
    p, cams = pixels(spark)
    d = tmp_path / "in"
    d.mkdir()
    path = files(d, p, np.array_split(np.random.default_rng(2).permutation(len(p)), 7))
    s = spark.readStream.schema(PIXELS).option("maxFilesPerTrigger", 1).parquet(path)
    got, progress = run(raster.stream_separate(s, cams, scene.GAIN, scene.W, scene.H), str(tmp_path / "out"))
    want = sep.separate(spark.createDataFrame(p, PIXELS), cams, scene.GAIN, scene.W, scene.H, causal=True)
    by = ["frame_index", "y", "x"]
    a, b = (x.toPandas().sort_values(by, ignore_index=True) for x in (got, want.select(*got.columns)))
    assert len(progress) == 7 and len(a) == scene.T * scene.H * scene.W
    pd.testing.assert_frame_equal(a, b, check_dtype=False, atol=1e-9)
    # the steps T - 1 and T wait for frames to come: two parts and one part, of a piece a file each
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 3 * 8


@pytest.mark.parametrize("steps", [1, 2, 64])
def test_separation_in_blocks_of_steps(spark, tmp_path, steps):
    """Steps that share a key, their pixels mixed over four files: the batch form, and few state entries."""
    p, cams = pixels(spark)
    path = files(tmp_path, p, np.array_split(np.random.default_rng(2).permutation(len(p)), 4))
    s = spark.readStream.schema(PIXELS).option("maxFilesPerTrigger", 1).parquet(path)
    got, progress = run(raster.stream_separate(s, cams, scene.GAIN, scene.W, scene.H, steps=steps), str(tmp_path / "out"))
    want = sep.separate(spark.createDataFrame(p, PIXELS), cams, scene.GAIN, scene.W, scene.H, causal=True)
    by = ["frame_index", "y", "x"]
    a, b = (x.toPandas().sort_values(by, ignore_index=True) for x in (got, want.select(*got.columns)))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, atol=1e-9)
    blocks = -(-(scene.T + 1) // steps)
    assert max(q["stateOperators"][0]["numRowsTotal"] for q in progress) <= blocks * 5


def test_a_missing_frame_ends_the_wait(spark, tmp_path):
    """Frames 0, 1, 3, 4: step 3 is handed out without the one before; steps 1 and 2 never."""
    p, cams = pixels(spark)
    more = p[p.frame_index == 1].assign(frame_index=4)
    p = pd.concat([p[p.frame_index != 2], more], ignore_index=True).assign(t=lambda x: 1000 + x.frame_index * 40)
    cams = cams.unionByName(cams.where("frame_index = 3").withColumn("frame_index", F.lit(4).cast("long")))
    end = p.iloc[:1].assign(episode=99, t=10**7)
    p = pd.concat([p, end], ignore_index=True)
    cams = cams.unionByName(cams.where("frame_index = 0").withColumn("episode", F.lit(99).cast("long")))
    d = tmp_path / "in"
    d.mkdir()
    path = files(d, p, [np.flatnonzero((p.frame_index == f) & (p.episode == 1)) for f in (0, 1, 3, 4)] + [[len(p) - 1]])
    s = spark.readStream.schema(PIXELS + ", t long").option("maxFilesPerTrigger", 1).parquet(path)
    got, progress = run(raster.stream_separate(s, cams, scene.GAIN, scene.W, scene.H, F.timestamp_millis("t"), "100 milliseconds", 400), str(tmp_path / "out"))
    a = got.where("episode = 1").toPandas()
    assert sorted(a.frame_index.unique()) == [0, 1, 4] and len(a) == 3 * scene.H * scene.W
    alone = raster.separated(None, *(raster.Frame.of(p[(p.frame_index == f) & (p.episode == 1)].assign(**{c: cams.where(f"episode = 1 and frame_index = {f}").first()[c] for c in raster.CAMERA}), scene.H, scene.W) for f in (3, 4)), scene.GAIN)
    g = np.zeros((scene.H, scene.W))
    four = a[a.frame_index == 4]
    g[four.y, four.x] = four.q_motion
    np.testing.assert_allclose(g, alone["q_motion"], atol=1e-12)


def test_steps_of_one_row_at_a_time():
    """However rows are cut into stretches, a processor hands out the same."""
    pdf = series(300, 1).assign(k=0)
    for make in (lambda: stateful.CrossingEncoder(["k"], ["t", "id"], "v", 0.6, "flag"), lambda: stateful.MinimumGap(["t", "id"], 60, ["id"]), lambda: stateful.LowPass(["t", "id"], "v", 30.0, ["id"]), lambda: stateful.PreviousFrame(["k"], "id", "v")):
        whole, _ = make().advance((0,), pdf, None)
        state, parts = None, []
        for cut in np.split(np.arange(300), [1, 2, 3, 50, 51, 200]):
            out, state = make().advance((0,), pdf.iloc[cut].reset_index(drop=True), state)
            parts.append(out)
        pd.testing.assert_frame_equal(pd.concat(parts, ignore_index=True), whole.reset_index(drop=True), check_dtype=False, atol=1e-9)


KINDS = {
    "crossings": (lambda **span: stateful.CrossingEncoder(["k"], ["t", "id"], "v", 0.6, reset="flag", **span), "k long, t long, id long, p int, ordinal int, t_cross double"),
    "two_sided": (lambda **span: stateful.TwoSidedEncoder(["k"], ["t", "id"], "v", "up", "down", reset="flag", **span), "k long, t long, id long, p int, ordinal int, t_cross double"),
    "gap": (lambda **span: stateful.MinimumGap(["t", "id"], 60, ["k", "t", "id"], **span), "k long, t long, id long"),
    "lowpass": (lambda **span: stateful.LowPass(["t", "id"], "v", 30.0, ["k", "id"], **span), "k long, id long, smooth double"),
}


@pytest.mark.parametrize("kind", list(KINDS))
def test_many_keys_share_groups(spark, tmp_path, kind):
    """Three hundred keys, one of them null and one beyond 2^53, in two groups: what each key gives alone, in few state entries."""
    make, schema = KINDS[kind]
    pdf = series(4000, 300, 8).assign(t=lambda d: d.t + 1)  # the watermark starts at 0
    pdf["k"] = np.where(pdf.k == 7, 2**60 + 1, np.where(pdf.k == 8, 2**60 + 2, pdf.k))
    pdf = pdf.assign(up=0.5 + pdf.k % 3 / 10, down=0.9 - pdf.k % 4 / 10)
    none = pdf.k == 9
    pdf["k"] = pdf.k.astype("Int64").mask(none)
    part = np.minimum((pdf.t + np.random.default_rng(5).integers(0, 600, len(pdf))) // 2400, 3)
    end = pdf.iloc[:1].assign(k=-1, t=10**7, id=-1)
    path = files(tmp_path, pd.concat([pdf, end], ignore_index=True), [*(np.flatnonzero(part == i) for i in (1, 0, 3, 2)), [len(pdf)]])
    s = spark.readStream.schema(SCHEMA + ", up double, down double").option("maxFilesPerTrigger", 1).parquet(path)
    got, progress = run(stateful.apply(s, ["k"], make(span=SPAN * 5), schema, event_time=F.timestamp_millis("t"), delay="6 seconds", groups=2), str(tmp_path / "out"))
    want = pd.concat([make().advance((None if pd.isna(k) else k,), g.reset_index(drop=True), None)[0].astype(object) for k, g in pdf.groupby("k", dropna=False)])
    cols = [c.split()[0] for c in schema.split(", ")]
    number = lambda x: -5 if x is None or x is pd.NA or x != x else int(x) if float(x).is_integer() else round(float(x), 6)
    assert sorted(tuple(map(number, r)) for r in got.select(*cols).collect()) == sorted(tuple(map(number, r)) for r in want[cols].itertuples(index=False))
    # ten stretches of up to four pieces for each of two groups and the null key's, with counts and timers; not 300 keys
    assert max(sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in progress) <= 200


@pytest.mark.parametrize("step_ms", [1000, None])
def test_merges_share_groups(spark, tmp_path, step_ms):
    """Chunks of 200 keys, one null, in two groups: each step's newest chunk, one entry and timer for a group's step."""
    r = np.random.default_rng(6)
    n = 6000
    pdf = pd.DataFrame({"k": pd.array(r.integers(0, 200, n), "Int64"), "chunk": r.integers(0, 12, n), "step": r.integers(0, 20, n)}).assign(v=lambda d: d.chunk / 2, t=lambda d: 1000 * d.step + 1)
    pdf["k"] = pdf.k.mask(pdf.k == 3)
    end = pd.DataFrame([(-1, 10**6, 10**6, 0.0, 10**9)], columns=list(pdf)).astype({"k": "Int64"})
    path = files(tmp_path, pd.concat([pdf, end], ignore_index=True), [*np.array_split(r.permutation(n), 3), [n]])
    s = spark.readStream.schema("k long, chunk long, step long, v double, t long").option("maxFilesPerTrigger", 1).parquet(path)
    timed = dict(event_time=F.timestamp_millis("t"), delay="30 seconds") if step_ms else {}
    got, progress = run(stateful.apply(s, ["k"], stateful.ChunkMerge(["k"], "step", "chunk", "v", step_ms), "k long, step long, from_chunk long, v double", groups=2, **timed), str(tmp_path / "out"))
    want = pdf[pdf.step >= pdf.chunk].groupby(["k", "step"], dropna=False).chunk.max()
    have = [(-5 if x.k is None else x.k, x.step, x.from_chunk, x.v) for x in got.where("step < 1000").collect()]
    newest = sorted((-5 if pd.isna(k) else int(k), int(s), int(c), c / 2) for (k, s), c in want.items())
    if step_ms:
        assert sorted(have) == newest
        assert max(sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in progress) <= 3 * 21 * 2 + 3
    else:  # every change is handed out, the last one last
        assert sorted({x[:2]: x for x in sorted(have, key=lambda x: x[2])}.values()) == newest
