"""Physical plans: no nested-loop joins, pruned scans."""

import re

import pytest

from eventloom.operators import pixels as px
from eventloom.operators import statistics as st
from eventloom.plans import registry
from eventloom.sources import readers, writers

SF = "/root/testdata/sf0.001"
STREAMS = {n for n in registry.load() if n.startswith("stream_")} - {"stream_checks", "stream_totals"}  # run to their end when called; what is left to plan is a read


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in registry.load() if n not in STREAMS])
def test_no_nested_loops(spark, name):
    p = plan(registry.load()[name].run(spark, SF))
    assert "BroadcastNestedLoopJoin" not in p
    assert "CartesianProduct" not in p


def test_event_scan_prunes(spark, tmp_path):
    e = spark.range(1000).selectExpr("id % 3 AS episode", "concat('cam', id % 2) AS camera", "id AS event_id", "id * 10 AS t_us", "1 AS x", "1 AS y", "cast(1 AS tinyint) AS p", "0.5D AS q")
    writers.write_events(e, str(tmp_path / "e"))
    d = readers.read_events(spark, str(tmp_path / "e"), episodes=[1], cameras=["cam0"], t0_us=100, t1_us=5000, columns=["event_id", "t_us"])
    p = plan(d)
    assert re.search(r"PartitionFilters: \[[^\]]*episode", p) and "GreaterThanOrEqual(t_us,100)" in p and "LessThan(t_us,5000)" in p
    assert re.search(r"ReadSchema: struct<event_id:bigint,t_us:bigint>", p)
    assert sorted(r.event_id for r in d.collect()) == [i for i in range(1000) if i % 3 == 1 and i % 2 == 0 and 100 <= i * 10 < 5000]


def test_voxel_history_shuffles_once(spark):
    p = plan(registry.load()["voxel_history"].run(spark, SF))
    assert p.count("Exchange") == 1
    assert re.search(r"ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,props:string>", p)


def test_interpolation_moves_frames_once(spark, tmp_path):
    """From a table of pairs: one exchange, by frame, for both ends, all fractions and the borders of holes."""
    cols = ["r", "g", "b", "mvx", "mvy"]
    pairs = spark.range(64).selectExpr("0L AS episode", "'c' AS camera", "0L AS frame_index", "cast(id div 8 as int) AS y", "cast(id % 8 as int) AS x", *[f"1.0D AS {e}{c}" for e in ("", "next_") for c in cols])
    pairs.write.parquet(str(tmp_path / "p"))
    p = plan(px.interpolate_frames(spark.read.parquet(str(tmp_path / "p")), 4, 8, 8))
    assert p.count("Exchange") == 1 and "Join" not in p


def test_interpolation_holds_a_batch_of_frames(spark, tmp_path):
    """No table of all cells of a partition: one sort by frame; frames that end in other batches give the same cells."""
    cols = ["r", "g", "b", "mvx", "mvy"]
    pairs = spark.range(10 * 64).selectExpr("0L AS episode", "'c' AS camera", "id div 64 AS frame_index", "cast(id div 8 % 8 as int) AS y", "cast(id % 8 as int) AS x", *[f"(id * {7 + i} % 23) / 5D - 2 AS {e}{c}" for e in ("", "next_") for i, c in enumerate(cols)])
    pairs.write.parquet(str(tmp_path / "p"))
    d = px.interpolate_frames(spark.read.parquet(str(tmp_path / "p")), 3, 8, 8)
    p = plan(d)
    assert "Aggregate" not in p and "Generate" not in p and len(re.findall(r"(?<!\w)Sort \[", p)) <= 2
    found = []
    for n in ("10000", "50"):
        before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        found.append(sorted(d.collect()))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found[0] == found[1] and len(found[0]) == 2 * 10 * 64


def test_resamples_are_drawn_without_a_lookup(spark):
    d = spark.createDataFrame([("m", 1, 0.5)], "metric string, episode long, delta double")
    p = plan(st.bootstrap_ci(d, ["metric"], ["episode"], 100, 1))
    assert "_i" not in "".join(re.findall(r"Join.*", p))
