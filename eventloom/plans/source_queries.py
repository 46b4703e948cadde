"""Registered queries: scans, sinks, manifests and checks of stored data."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions import text as tx
from eventloom.operators import events as ev
from eventloom.plans import views as v
from eventloom.plans.registry import query
from eventloom.session import shared_folder
from eventloom.sources import readers, writers

S = ev.SERIES


def stored_events(spark, sf):
    return v.v_events(spark, sf).select("episode", "camera", "event_id", "t_us", "x", "y", F.col("p").cast("tinyint").alias("p"), "q")


@query("S8 S1", f"SELECT episode, camera, count(*) AS n, min(t_us) AS t_min, max(t_us) AS t_max, round(sum(q), 6) AS sum_q FROM v_events WHERE episode IN (1, 2) AND t_us >= {3 * v.DAY_US} AND t_us < {20 * v.DAY_US} GROUP BY ALL", "v_events")
def events_write_read(spark, sf):
    """Write the stored layout, then scan a slice of it with partition and row-group pruning."""
    path = shared_folder(spark, "events")
    writers.write_events(stored_events(spark, sf), path)
    d = readers.read_events(spark, path, episodes=[1, 2], t0_us=3 * v.DAY_US, t1_us=20 * v.DAY_US)
    return d.groupBy(*S).agg(F.count(F.lit(1)).alias("n"), F.min("t_us").alias("t_min"), F.max("t_us").alias("t_max"), F.round(F.sum("q"), 6).alias("sum_q"))


@query("S9 C13", """SELECT event_id, round_even((value * 0.0000005::DOUBLE + event_id - 3) * 1e6, 0)::BIGINT AS t_us FROM events""")
def export_us(spark, sf):
    e = v.table(spark, sf, "events").withColumn("t_s", F.col("value") * 0.0000005 + F.col("event_id"))
    return writers.export_us(e, "t_s", F.lit(3)).select("event_id", "t_us")


@query("S9 A30", f"""SELECT episode, camera, count(*) AS event_count, min(t_us) AS t_min_us, max(t_us) AS t_max_us, count(*) FILTER (t_us < 0) AS early, count(*) FILTER (x >= 470 OR y >= 350) AS outside FROM v_events GROUP BY ALL""", "v_events")
def export_report(spark, sf):
    return writers.export_report(v.v_events(spark, sf), S, 470, 350)


@query("S2 S10", """SELECT l_orderkey AS episode, count(*) AS n, round(sum((l_quantity::FLOAT)::DOUBLE + (l_discount::FLOAT)::DOUBLE), 4) AS total FROM lineitem GROUP BY 1""")
def frames_write_read(spark, sf):
    """Frame table in its fixed layout, written with a re-read check and scanned with a layout check."""
    li = v.table(spark, sf, "lineitem")
    a = F.array(F.col("l_quantity").cast("float"), F.col("l_discount").cast("float"))
    k = F.col("l_linenumber").cast("long")
    f = li.select(a.alias("action"), a.alias("state"), a.alias("env_state"), (k / F.lit(25.0)).alias("timestamp"), k.alias("frame_index"), F.col("l_orderkey").alias("episode"), k.alias("index"), k.alias("task_index"))
    path = shared_folder(spark, "frames")
    writers.write_frames(f, path)
    s = readers.read_frames(spark, path)
    return s.groupBy("episode").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("action")[0].cast("double") + F.col("action")[1].cast("double")), 4).alias("total"))


@query("S5", "SELECT episode, camera, frame_index, y, x, v, seg FROM v_pixels", "v_pixels")
def rasters_write_read(spark, sf):
    """Rasters to their array form and back."""
    p = v.v_pixels(spark, sf).select("episode", "camera", "frame_index", "y", "x", "v", "seg")
    return readers.open_rasters(writers.close_rasters(p, v.SIDE, v.SIDE, ["v", "seg"]), ["v", "seg"])


@query("S11 M7", """SELECT episode, camera, frame_index, round(0.04::DOUBLE * frame_index - 1.5::DOUBLE, 6) AS timestamp, round(tx, 6) AS tx, fx FROM v_cameras""", "v_cameras")
def support_write(spark, sf):
    p = v.v_pixels(spark, sf).select("episode", "camera", "frame_index", "y", "x", F.col("depth").cast("float").alias("depth"), F.col("mvx").cast("float").alias("mvx"), F.col("mvy").cast("float").alias("mvy"))
    r = writers.close_rasters(p, v.SIDE, v.SIDE, ["depth", "mvx", "mvy"])
    c = v.v_cameras(spark, sf).withColumn("timestamp", F.col("frame_index") * 0.04)
    path = shared_folder(spark, "support")
    writers.write_support(r, c, path, F.lit(1.5))
    d = spark.read.parquet(path).withColumn("episode", F.col("episode").cast("long"))
    return d.select("episode", "camera", "frame_index", F.round("timestamp", 6).alias("timestamp"), F.round("tx", 6).alias("tx"), "fx")


def provenance(spark, sf):
    """Provenance documents as JSON text with their paths, one per sample."""
    s = v.v_samples(spark, sf)
    i = F.col("sample_index")
    count = lambda n: F.struct((i % n).alias("event_count"))
    csv = F.struct(i.alias("zero_based_row"), i.alias("source_episode_index"))
    doc = F.struct(i.alias("sample_index"), csv.alias("source_csv"), (i + 7).alias("simulation_seed"), (i % 50).alias("frame_count"), F.struct(F.col("success"), F.lit("auto").alias("termination_reason")).alias("outcome"),
                   F.struct(count(100).alias("wrist"), count(10).alias("side")).alias("events"))
    path = F.concat_ws("/", "split", F.format_string("sample_%06d", i), F.lit("reproduction.json"))
    return s.select(F.to_json(doc).alias("doc"), path.alias("path"))


@query("S3", """SELECT sample_index, success, split, size_bytes % 1000 AS frame_count, sample_index % 7 AS wrist FROM v_samples""", "v_samples")
def read_samples(spark, sf):
    """Dataset documents of up to a hundred samples each, written as JSON and scanned back."""
    i = F.col("sample_index")
    row = F.struct("sample_index", "success", "split", (F.col("size_bytes") % 1000).alias("frame_count"), F.create_map(F.lit("wrist"), i % 7).alias("event_counts"))
    path = shared_folder(spark, "documents")
    v.v_samples(spark, sf).groupBy(F.floor(i / 100).alias("part")).agg(F.collect_list(row).alias("samples")).select("samples").write.json(path)
    d = readers.read_samples(spark, path, one_per_file=False)
    return d.select("sample_index", "success", "split", "frame_count", F.col("event_counts")["wrist"].alias("wrist"))


@query("S6", "SELECT episode AS demo, 1::BIGINT AS files FROM v_events GROUP BY episode", "v_events")
def scan_demos(spark, sf):
    """One folder per episode with one file each; only metadata is listed."""
    path = shared_folder(spark, "demos")
    v.v_events(spark, sf).withColumn("demo", F.col("episode")).repartition("demo").write.partitionBy("demo").parquet(path)
    return readers.scan_demos(spark, path, "parquet").select("demo", "files")


@query("S12 F22", """SELECT sample_index, coalesce(split, 'unsplit') AS split, success, 'auto' AS reason, sample_index + 7 AS seed, sample_index % 50 AS frame_count, sample_index % 100 AS wrist, sample_index % 10 AS side FROM v_samples""", "v_samples")
def sample_index(spark, sf):
    d = writers.sample_index(provenance(spark, sf))
    return d.select("sample_index", "split", "success", F.col("termination_reason").alias("reason"), F.col("simulation_seed").alias("seed"), "frame_count", F.col("event_counts")["wrist"].alias("wrist"), F.col("event_counts")["side"].alias("side"))


@query("S12", "SELECT count(*) AS total_samples, count(*) FILTER (success) AS success_samples, count(*) FILTER (success = false) AS failure_samples FROM v_samples", "v_samples")
def index_totals(spark, sf):
    return writers.index_totals(writers.sample_index(provenance(spark, sf)))


@query("S13", """SELECT e.user_id, event_count, event_start_us, event_end_us, frame_count, c_name AS instruction FROM (SELECT user_id, count(*) AS event_count, min(t_us) AS event_start_us, max(t_us) AS event_end_us FROM v_events GROUP BY 1) e
  LEFT JOIN (SELECT o_custkey AS user_id, count(*) AS frame_count FROM orders GROUP BY 1) f USING (user_id) LEFT JOIN customer ON c_custkey = e.user_id""", "v_events")
def build_manifest(spark, sf):
    e = v.v_events(spark, sf)
    f = v.table(spark, sf, "orders").withColumnRenamed("o_custkey", "user_id")
    m = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("instruction"))
    return writers.build_manifest(e, f, m, ["user_id"])


@query("S14", """SELECT episode, n::VARCHAR AS n, '{"cam0":' || a || ',"cam1":' || b || ',"cam2":' || c || '}' AS counts FROM (SELECT episode, count(*) AS n, count(*) FILTER (camera = 'cam0') AS a, count(*) FILTER (camera = 'cam1') AS b, count(*) FILTER (camera = 'cam2') AS c FROM v_events GROUP BY 1)""", "v_events")
def manifest_csv(spark, sf):
    """CSV manifest with the per-camera counts as JSON, written and read back."""
    n = lambda c: F.count_if(F.col("camera") == c)
    m = v.v_events(spark, sf).groupBy("episode").agg(F.count(F.lit(1)).alias("n"), F.create_map(*[x for c in ("cam0", "cam1", "cam2") for x in (F.lit(c), n(c))]).alias("counts"))
    path = shared_folder(spark, "manifest")
    writers.write_manifest_csv(m, path, ["episode"])
    d = spark.read.csv(path, header=True, escape="\\")
    return d.select(F.col("episode").cast("long").alias("episode"), "n", "counts")


@query("S15 F26", r"""SELECT c_custkey, '| ' || c_name || ' | ' || CASE WHEN c_custkey % 5 = 0 THEN 'n/a' ELSE printf('%.4f', c_acctbal) END || ' | ' || c_nationkey || ' |' AS line FROM customer""")
def report_markdown(spark, sf):
    c = v.table(spark, sf, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal")).alias("c_acctbal"), "c_nationkey")
    body = writers.report_markdown(c.select("c_name", "c_acctbal", "c_nationkey"))
    return body.select(F.regexp_extract("value", r"Customer#(\d+)", 1).cast("long").alias("c_custkey"), F.col("value").alias("line"))


@query("S15 F26", r"""SELECT '{"c_custkey":' || c_custkey || ',"c_acctbal":' || CASE WHEN c_custkey % 5 = 0 THEN 'null' ELSE (c_nationkey::DOUBLE)::VARCHAR END || '}' AS value FROM customer""")
def report_json(spark, sf):
    bal = F.when(F.col("c_custkey") % 5 == 0, F.lit(float("inf"))).otherwise(F.col("c_nationkey").cast("double"))
    return writers.report_json(v.table(spark, sf, "customer").select("c_custkey", bal.alias("c_acctbal")))


def files(spark, sf):
    """Documents as files: folder = source, name = id, content = text."""
    return v.table(spark, sf, "documents").select("source", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "doc_id", F.sha2("text", 256).alias("sha256"))


@query("J17", """SELECT doc_id AS sample_index, source || '/' || doc_id AS path, doc_id % 13 = 0 AS absent FROM documents WHERE doc_id % 13 = 0 OR doc_id % 10 = 0""")
def verify_files(spark, sf):
    """Whole-text hashes against an expectation with some wrong and some missing files."""
    f = files(spark, sf)
    want = F.when(F.col("doc_id") % 10 == 0, F.lit("0")).otherwise(F.col("sha256"))
    expected = f.select(F.col("doc_id").alias("sample_index"), F.create_map("path", want).alias("hashes"))
    return readers.verify_files(expected, f.where(F.col("doc_id") % 13 != 0))


@query("A32", """h AS (SELECT source, sha256(source || '/' || doc_id) AS h, sha256(source || '/' || doc_id || chr(0) || sha256(text)) AS d FROM documents),
  l4 AS (SELECT source, substr(h, 1, 4) AS h, sha256(string_agg(d, '' ORDER BY a.h, d)) AS d FROM h a GROUP BY source, substr(a.h, 1, 4)),
  l2 AS (SELECT source, substr(a.h, 1, 2) AS h, sha256(string_agg(d, '' ORDER BY a.h, d)) AS d FROM l4 a GROUP BY source, substr(a.h, 1, 2)),
  l1 AS (SELECT source, substr(a.h, 1, 1) AS h, sha256(string_agg(d, '' ORDER BY a.h, d)) AS d FROM l2 a GROUP BY source, substr(a.h, 1, 1))
  SELECT source, sha256(string_agg(d, '' ORDER BY h, d)) AS digest FROM l1 GROUP BY source""".replace("h AS (", "WITH h AS (", 1))
def tree_digest(spark, sf):
    return writers.tree_digest(files(spark, sf), "source")


@query("S16 F25", """SELECT o_orderkey FROM orders WHERE o_orderkey % 6 = 0 OR o_orderkey % 4 = 1""")
def stale_parts(spark, sf):
    """Parts to rebuild: the input changed (every sixth) or was never stored."""
    o = v.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    f = {"price": F.col("o_totalprice"), "key": F.col("o_orderkey")}
    now = writers.with_fingerprint(o, f, "v1").select("o_orderkey", "fingerprint")
    before = writers.with_fingerprint(o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 6 == 0, F.col("o_totalprice") - 1).otherwise(F.col("o_totalprice"))), f, "v1")
    return writers.stale(now, before.where(F.col("o_orderkey") % 4 != 1), ["o_orderkey"]).select("o_orderkey")


@query("S16", """SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE lang <> 'de' GROUP BY lang""")
def materialize(spark, sf):
    """A derived table built three times: the second run finds every fingerprint stored and rebuilds nothing, the third drops the part whose input is gone."""
    d = v.table(spark, sf, "documents")
    inputs = writers.with_fingerprint(d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")), {"n": F.col("n"), "chars": F.col("chars")}, "v1")
    path = shared_folder(spark, "derived")
    writers.materialize(spark, inputs, lambda t: t, path, ["lang"])
    never = lambda t: t.withColumn("n", F.lit(-1).cast("long"))
    writers.materialize(spark, inputs, never, path, ["lang"])
    out = writers.materialize(spark, inputs.where("lang <> 'de'"), never, path, ["lang"])
    return out.select("lang", "n", "chars")


@query("S17", """SELECT 'runs/' || doc_id || CASE WHEN doc_id % 4 = 0 THEN '.tmp' ELSE '.bin' END AS path FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 300 >= 120 AND doc_id % 5 <> 0""")
def new_files(spark, sf):
    i = F.col("doc_id")
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    path = F.concat(F.lit("runs/"), i.cast("string"), F.when(i % 4 == 0, ".tmp").otherwise(".bin"))
    f = v.table(spark, sf, "documents").select("doc_id", path.alias("path"), F.timestamp_seconds(F.unix_seconds(now) - i % 300).alias("modificationTime"))
    return readers.new_files(f, f.where(i % 5 == 0), ".bin", 120, now, "runs/%").select("path")


@query("U5 S7", """SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def missing_files(spark, sf):
    return readers.missing_files(v.table(spark, sf, "documents").select("doc_id"), v.table(spark, sf, "labels"), "doc_id")


@query("S4 P23", """SELECT page_id, words[1] AS first_word, len(words)::INT AS n FROM (SELECT page_id, ['obj' || page_id, 'cup'] AS words FROM pages)""")
def read_conditions(spark, sf):
    """CSV of initial conditions with a list column, written and read back."""
    p = v.table(spark, sf, "pages").select("page_id", F.concat(F.lit("['obj"), F.col("page_id").cast("string"), F.lit("', 'cup']")).alias("objects"))
    path = shared_folder(spark, "conditions")
    p.write.csv(path, header=True)
    d = readers.read_conditions(spark, path, "page_id", list_columns=("objects",))
    return d.select(F.col("page_id").cast("long").alias("page_id"), F.col("objects")[0].alias("first_word"), F.size("objects").alias("n"))


@query("P22", """m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'balanced' WHEN o_orderkey % 3 = 1 THEN 'adaptive' ELSE 'hybrid' END AS mode, o_orderkey % 2 = 1 AS adaptive, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 2 THEN 0.25 + 1e-9 ELSE 0 END::DOUBLE AS gain FROM orders),
  e AS (SELECT * FROM (VALUES ('balanced', false, 0.0::DOUBLE), ('adaptive', true, 0.0::DOUBLE), ('hybrid', true, 0.25::DOUBLE)) t(mode, ea, eg))
  SELECT o_orderkey, list_filter([CASE WHEN adaptive <> ea THEN 'adaptive_warp' END, CASE WHEN gain IS NULL OR abs(gain - eg) > 1e-8 + 1e-5 * abs(eg) THEN 'gate_gain' END], lambda x: x IS NOT NULL) AS violations FROM m JOIN e USING (mode)""".replace("m AS (", "WITH m AS (", 1))
def validate_meta(spark, sf):
    """Recorded settings against a fixed table of what each mode requires."""
    i = F.col("o_orderkey")
    m = v.table(spark, sf, "orders").select("o_orderkey", F.when(i % 3 == 0, "balanced").when(i % 3 == 1, "adaptive").otherwise("hybrid").alias("mode"), (i % 2 == 1).alias("adaptive"),
                                            F.when(i % 5 == 0, None).when(i % 3 == 2, F.lit(0.25 + 1e-9)).otherwise(F.lit(0.0)).alias("gain"))
    e = spark.createDataFrame([("balanced", False, 0.0), ("adaptive", True, 0.0), ("hybrid", True, 0.25)], "mode string, ea boolean, eg double")
    close = F.abs(F.col("gain") - F.col("eg")) <= 1e-8 + 1e-5 * F.abs("eg")
    bad = F.array_compact(F.array(F.when(F.col("adaptive") != F.col("ea"), "adaptive_warp"), F.when(~F.coalesce(close, F.lit(False)), "gate_gain")))
    return m.join(F.broadcast(e), "mode").select("o_orderkey", bad.alias("violations"))


del tx
