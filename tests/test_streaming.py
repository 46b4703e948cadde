"""Streams in several micro-batches give the batch results."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventloom.operators import frames as fr
from eventloom.operators import series as se
from eventloom.streaming import stateful, windows

SCHEMA = "k long, t long, id long, v double, flag boolean"


@pytest.fixture(scope="module")
def stream_dir(spark, tmp_path_factory):
    """The same series in four files, later times in later files."""
    r = np.random.default_rng(12)
    n = 400
    pdf = pd.DataFrame({"k": r.integers(0, 3, n), "t": np.sort(r.integers(0, 5000, n)), "id": np.arange(n), "v": np.round(np.cumsum(r.normal(0, 1, n)), 3), "flag": r.random(n) < 0.05})
    path = tmp_path_factory.mktemp("stream")
    for i, part in enumerate(np.array_split(np.arange(n), 4)):
        pdf.iloc[part].to_parquet(path / f"part-{i}.parquet")
        import os

        os.utime(path / f"part-{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return str(path), pdf


def source(spark, stream_dir):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(stream_dir[0])


def batch(spark, stream_dir):
    return spark.createDataFrame(stream_dir[1], SCHEMA)


def rows(df, *cols):
    return sorted(tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in cols) for r in df.collect())


def test_crossings(spark, stream_dir):
    p = stateful.CrossingEncoder(["k"], ["t", "id"], "v", 0.6, reset="flag")
    s = stateful.apply(source(spark, stream_dir), ["k"], p, "k long, t long, id long, p int, ordinal int, t_cross double")
    got = windows.run_available(s, ["id", "ordinal"], "append")
    want = se.encode_crossings(batch(spark, stream_dir), ["k"], ["t", "id"], "v", 0.6, 700, reset=F.col("flag"))
    assert rows(got, "id", "p", "ordinal", "t_cross") == rows(want, "id", "p", "ordinal", "t_cross")


def test_minimum_gap(spark, stream_dir):
    s = stateful.apply(source(spark, stream_dir).select("k", "t", "id"), ["k"], stateful.MinimumGap(["t", "id"], 60, ["k", "t", "id"]), "k long, t long, id long")
    got = windows.run_available(s, ["id"], "append")
    want = se.refractory(batch(spark, stream_dir).select("k", "t", "id"), ["k"], ["t", "id"], 60, 900)
    assert rows(got, "id") == rows(want, "id")


def test_lowpass(spark, stream_dir):
    s = stateful.apply(source(spark, stream_dir), ["k"], stateful.LowPass(["t", "id"], "v", 30.0, ["k", "id"]), "k long, id long, smooth double")
    got = windows.run_available(s, ["id"], "append")
    want = se.lowpass(batch(spark, stream_dir), ["k"], ["t", "id"], "v", 30.0, 900)
    assert rows(got, "id", "smooth") == rows(want, "id", "smooth")


def test_ring(spark, stream_dir):
    b = (F.col("t") / 100).cast("long")
    src = source(spark, stream_dir).select("k", b.alias("bin"), "v").groupBy("k", "bin")
    # values per (key, bin) arrive as plain rows here: one row per bin, the first seen value
    del src
    pdf = stream_dir[1].assign(bin=lambda d: d["t"] // 100).groupby(["k", "bin"], as_index=False)["v"].sum()
    import os
    import tempfile

    d = tempfile.mkdtemp(prefix="ring-")
    for i, cut in enumerate(((0, 17), (17, 33), (33, 99))):
        part = pdf[(pdf.bin >= cut[0]) & (pdf.bin < cut[1])]
        part.to_parquet(f"{d}/part-{i}.parquet")
        os.utime(f"{d}/part-{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    s = spark.readStream.schema("k long, bin long, v double").option("maxFilesPerTrigger", 1).parquet(d)
    got = windows.run_available(stateful.apply(s, ["k"], stateful.BinRing(["k"], "bin", "v", 8), "k long, ring array<double>"), ["k"], "append")
    want = se.bin_ring(spark.createDataFrame(pdf), ["k"], "bin", "v", 8)
    r = lambda df: {x.k: [round(v, 6) for v in x.ring] for x in df.collect()}
    assert r(got) == r(want)


def test_chunk_merge(spark, stream_dir):
    pick = lambda d: d.select("k", (F.col("id") % 40).alias("chunk"), (F.col("id") % 40 + F.col("id") % 5 - 1).alias("step"), "v")
    one = lambda d: d.dropDuplicates(["k", "chunk", "step"])
    pdf = one(pick(batch(spark, stream_dir))).toPandas()
    import os
    import tempfile

    d = tempfile.mkdtemp(prefix="merge-")
    for i, part in enumerate(np.array_split(np.random.default_rng(1).permutation(len(pdf)), 3)):
        pdf.iloc[part].to_parquet(f"{d}/part-{i}.parquet")
        os.utime(f"{d}/part-{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    s = spark.readStream.schema("k long, chunk long, step long, v double").option("maxFilesPerTrigger", 1).parquet(d)
    m = stateful.apply(s, ["k"], stateful.ChunkMerge(["k"], "step", "chunk", "v"), "k long, step long, from_chunk long, v double")
    got = windows.run_available(m, ["k", "step"], "append")
    want = fr.merge_chunks(spark.createDataFrame(pdf), ["k"], "step", "chunk", "v")
    assert rows(got, "k", "step", "from_chunk", "v") == rows(want, "k", "step", "from_chunk", "v")


def test_previous_frame(spark, stream_dir):
    src = source(spark, stream_dir).where("k = 0").select("k", F.col("id").alias("frame"), "v")
    s = stateful.apply(src, ["k"], stateful.PreviousFrame(["k"], "frame", "v"), "k long, frame long, v double, previous double")
    got = {r.frame: r.previous for r in windows.run_available(s, ["frame"], "append").collect()}
    vals = {r.id: r.v for r in batch(spark, stream_dir).where("k = 0").collect()}
    assert got == {i: vals.get(i - 1) for i in vals}


def test_latest(spark, stream_dir):
    got = windows.run_available(windows.stream_latest(source(spark, stream_dir), ["k"], ["t", "id"], ["v"]), ["k"])
    want = fr.latest_by_key(batch(spark, stream_dir), ["k"], ["t", "id"], ["v"])
    assert rows(got, "k", "t", "id", "v") == rows(want, "k", "t", "id", "v")


class Held:
    """State in memory, and frames that count how many were read before the last one was let go."""

    def __init__(self, start=()):
        self.rows = dict(start)

    def exists(self):
        return bool(self.rows)

    def get(self):
        return list(self.rows.items())

    def put(self, rows):
        self.rows = dict(rows)

    def containsKey(self, k):  # noqa: N802
        return k in self.rows

    def getValue(self, k):  # noqa: N802
        return self.rows[k]

    def updateValue(self, k, v):  # noqa: N802
        self.rows[k] = v


def one_by_one(pdf, size):
    import gc
    import weakref

    held = []
    for i in range(0, len(pdf), size):
        f = pdf.iloc[i : i + size].copy()
        held.append(weakref.ref(f))
        yield f
        del f
        gc.collect()
        assert sum(r() is not None for r in held) <= 2


@pytest.mark.parametrize("reset", [None, "clear"])
def test_rings_and_merges_hold_no_whole_batch(reset):
    import random

    import pandas as pd

    r = random.Random(4)
    for _ in range(20):
        pdf = pd.DataFrame([(t, r.randrange(30), r.random(), r.random() < 0.03) for t in range(200)], columns=["t", "bin", "v", "clear"])
        have = {1: 0.5, 40: 0.25}
        p = stateful.BinRing(["k"], "bin", "v", 5, reset, ["t"])
        p.ring = Held(have)
        for x in pdf.itertuples():
            have = {} if reset and x.clear else have
            have[x.bin] = x.v
            have = {b: have[b] for b in sorted(have)[-5:]}
        got = list(p.handleInputRows((7,), one_by_one(pdf.sample(frac=1, random_state=r.randrange(99)), 20), None))[0]
        assert got.ring[0] == [v for _, v in sorted(have.items())]
        m = stateful.ChunkMerge(["k"], "bin", "c", "v")
        m.steps = Held({(3,): (2, 0.0), (29,): (28, 0.0)})
        rows = pdf.assign(c=pdf.t % 31, v=(pdf.t % 31) / 2.0)
        got = list(m.handleInputRows((7,), one_by_one(rows, 20), None))[0]
        newest = rows[rows.c <= rows.bin].groupby("bin").c.max().to_dict()
        wanted = {b: c for b, c in newest.items() if c >= {3: 2, 29: 28}.get(b, 0)}
        assert dict(zip(got.bin, got.from_chunk)) == wanted and all(got.v == got.from_chunk / 2)
