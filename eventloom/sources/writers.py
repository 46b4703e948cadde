"""Table sinks with their checks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from eventloom import schemas
from eventloom.functions import text as tx
from eventloom.session import cut_lineage


def write_events(df: DataFrame, path: str, attributes: DataFrame | None = None, rows_per_file: int = 8_000_000, partitions: int | None = None) -> None:
    """Events in (episode, camera) folders, sorted by time.

    The range shuffle includes the time, so a very large episode spreads over many tasks and
    each file covers a short time span that its row-group statistics describe.
    """
    keys = ["episode", "camera", "t_us", "event_id"]
    n = [partitions] if partitions else []
    d = df.repartitionByRange(*n, *keys).sortWithinPartitions(*keys)
    d.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("episode", "camera").parquet(path)
    if attributes is not None:
        attributes.write.mode("overwrite").parquet(path.rstrip("/") + "_attributes")


def export_us(df: DataFrame, t_s: str, origin: Column) -> DataFrame:
    """Seconds to whole microseconds since an origin, ties to even."""
    return df.withColumn("t_us", F.rint((F.col(t_s) - origin) * 1e6).cast("long"))


def export_report(df: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """Per stream: what an export would refuse (early or out-of-range events) and what it covers."""
    x, y = F.col("x"), F.col("y")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("event_count"), F.min("t_us").alias("t_min_us"), F.max("t_us").alias("t_max_us"), F.count_if(F.col("t_us") < 0).alias("early"),
        F.count_if((x < 0) | (x >= width) | (y < 0) | (y >= height)).alias("outside"))


def checked_export(df: DataFrame, path: str, keys: list[str], width: int, height: int, series: DataFrame | None = None) -> DataFrame:
    """Write an export and compare the re-read counts per stream; refuses bad streams, and those of ``series`` without events.

    ``df`` is evaluated once, into the shared folder; the checks and the export read that.
    """
    df = cut_lineage(df, "export")
    empty = df.limit(1) if series is None else series.select(*keys).join(df.select(*keys), keys, "left_anti")
    if empty.isEmpty() == (series is None):
        raise ValueError(f"empty streams: {[] if series is None else empty.limit(5).collect()}")
    bad = export_report(df, keys, width, height).where("early > 0 OR outside > 0").limit(5).collect()
    if bad:
        raise ValueError(f"streams with early or out-of-range events, among them: {bad}")
    write_events(df, path)
    return round_trip(df, df.sparkSession.read.schema(df.schema).parquet(path), keys)


def round_trip(df: DataFrame, again: DataFrame, keys: list[str]) -> DataFrame:
    """Streams whose row count changed between two tables (empty when all is well)."""
    one = lambda d, a, b: d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, (F.col("n") * a).alias("w"), (F.col("n") * b).alias("r"))
    g = one(df, 1, 0).unionByName(one(again, 0, 1)).groupBy(*keys).agg(F.sum("w").alias("written"), F.sum("r").alias("reread"))
    return g.where("written <> reread")


def write_frames(df: DataFrame, path: str) -> None:
    """Frame table with a re-read check of layout and count."""
    schemas.same_layout(df, schemas.FRAMES)
    written = Observation("frames")
    df.observe(written, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    again = df.sparkSession.read.parquet(path)
    schemas.same_layout(again.select(*schemas.names(schemas.FRAMES)), schemas.FRAMES)
    a, b = written.get["n"], again.count()
    if a != b:
        raise ValueError(f"wrote {a} rows, read {b}")


def write_support(rasters: DataFrame, cams: DataFrame, path: str, origin_s: Column, partitions: int | None = None) -> DataFrame:
    """Geometry subset per frame with time from the episode's origin; one small row group per few frames."""
    d = rasters.select("episode", "camera", "frame_index", "height", "width", "depth", "mvx", "mvy").join(cams, ["episode", "camera", "frame_index"])
    if "timestamp" in d.columns:
        d = d.withColumn("timestamp", F.col("timestamp") - origin_s)
    n = [partitions] if partitions else []
    d = d.repartitionByRange(*n, "episode", "camera", "frame_index").sortWithinPartitions("episode", "camera", "frame_index")
    d.write.mode("overwrite").option("maxRecordsPerFile", 4096).partitionBy("episode").parquet(path)
    return d


def _field(name: str):
    return lambda s: s[name]


def close_rasters(pixels: DataFrame, height: int, width: int, channels: list[str]) -> DataFrame:
    """Pixel rows back to one array per channel and frame (the storage form); a frame is bounded by the camera."""
    cells = F.sort_array(F.collect_list(F.struct("y", "x", *channels)))
    g = pixels.groupBy("episode", "camera", "frame_index").agg(cells.alias("_c"))
    return g.select("episode", "camera", "frame_index", F.lit(height).alias("height"), F.lit(width).alias("width"), *[F.transform("_c", _field(c)).alias(c) for c in channels])


def sample_index(provenance: DataFrame, doc: str = "doc", path: str = "path") -> DataFrame:
    """Sample rows from provenance documents (JSON text, one per row) and their file paths below the root.

    The sample's folder is its relative path; the first folder is the split if there is one above it.
    """
    j = lambda p: F.get_json_object(doc, p)
    folder = F.regexp_replace(path, "/[^/]*$", "")
    events = F.from_json(j("$.events"), "map<string, struct<event_count: bigint>>")
    return provenance.select(
        j("$.sample_index").cast("long").alias("sample_index"), F.when(F.contains(folder, F.lit("/")), F.substring_index(folder, "/", 1)).otherwise("unsplit").alias("split"),
        folder.alias("relative_path"), j("$.source_csv.zero_based_row").cast("long").alias("source_csv_row"), j("$.source_csv.source_episode_index").cast("long").alias("source_episode_index"),
        j("$.simulation_seed").cast("long").alias("simulation_seed"), j("$.outcome.success").cast("boolean").alias("success"), j("$.outcome.termination_reason").alias("termination_reason"),
        j("$.frame_count").cast("long").alias("frame_count"), F.transform_values(events, lambda _, e: e["event_count"]).alias("event_counts"))


def index_totals(samples: DataFrame) -> DataFrame:
    return samples.agg(F.count(F.lit(1)).alias("total_samples"), F.count_if("success").alias("success_samples"), F.count_if(F.col("success") == F.lit(False)).alias("failure_samples"))


def write_index(samples: DataFrame, path: str) -> None:
    """JSON lines of the sample index; many files at scale, readable as one table."""
    samples.write.mode("overwrite").json(path)


def build_manifest(events: DataFrame, frames: DataFrame, meta: DataFrame, keys: list[str]) -> DataFrame:
    """Per episode: event count and time span, frame count and metadata."""
    e = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("event_count"), F.min("t_us").alias("event_start_us"), F.max("t_us").alias("event_end_us"))
    f = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("frame_count"))
    return e.join(f, keys, "left").join(meta, keys, "left")


def manifest_rows(manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Flat text rows of a manifest for CSV: nested columns as JSON."""
    flat = [F.to_json(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("map", "struct", "array") else F.col(f.name) for f in manifest.schema.fields]
    return manifest.select(*flat)


def write_manifest_csv(manifest: DataFrame, path: str, keys: list[str]) -> None:
    manifest_rows(manifest, keys).write.mode("overwrite").csv(path, header=True)


# -- fingerprinted tables ---------------------------------------------------------------------

def with_fingerprint(inputs: DataFrame, fields: dict[str, Column], code_version: str) -> DataFrame:
    return inputs.withColumn("fingerprint", tx.fingerprint({**fields, "code": F.lit(code_version)}))


def stale(inputs: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs whose fingerprint is not stored yet."""
    return inputs.join(stored.select(*keys, "fingerprint"), [*keys, "fingerprint"], "left_anti")


def materialize(spark: SparkSession, inputs: DataFrame, build, path: str, keys: list[str]) -> DataFrame:
    """Recompute only the parts whose inputs or code changed, and return the whole table.

    ``build`` maps stale input rows to output rows that carry ``keys`` and ``fingerprint``.
    Parts are folders; only rewritten folders are replaced, and those of inputs that are
    gone are removed. Keys must not be NULL.
    """
    todo, gone = inputs, []
    try:
        table = spark.read.parquet(path)
        todo = stale(inputs, table.select(*keys, "fingerprint").distinct(), keys)
        same = [F.col(k).cast(inputs.schema[k].dataType).alias(k) for k in keys]
        folder = F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder")
        gone = table.select(*same, folder).distinct().join(inputs.select(*keys), keys, "left_anti").select("folder").distinct()
        gone = [r.folder for r in gone.toLocalIterator()]  # names of folders to drop
    except AnalysisException as e:  # first run: nothing is stored
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    out = build(todo)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    for name in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return spark.read.parquet(path)


# -- digests ------------------------------------------------------------------------------------

def tree_digest(files: DataFrame, root: str, levels: tuple[int, ...] = (4, 2, 1)) -> DataFrame:
    """Content hash of each tree from its (path, sha256) rows.

    Digests fold level by level over prefixes of the path hash, so a tree with very many
    files never has to be listed in one task; any change of a path or a content changes it.
    """
    d = files.select(root, F.sha2("path", 256).alias("_h"), F.sha2(F.concat("path", F.lit("\u0000"), "sha256"), 256).alias("_d"))
    for n in (*levels, 0):
        g = d.groupBy(root, F.substring("_h", 1, n).alias("_h")).agg(F.sort_array(F.collect_list(F.struct("_h", "_d"))).alias("_l"))
        d = g.select(root, "_h", F.sha2(F.concat_ws("", F.transform("_l", lambda s: s["_d"])), 256).alias("_d"))
    return d.select(root, F.col("_d").alias("digest"))


# -- reports --------------------------------------------------------------------------------------

def report_json(df: DataFrame) -> DataFrame:
    """One JSON document per row; NaN and infinities become null."""
    safe = [tx.json_safe(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias("value"))


def markdown_row(df: DataFrame, digits: int = 4) -> Column:
    """A row as a line of a Markdown table; missing numbers print as n/a."""
    def cell(f):
        c = F.col(f.name)
        if f.dataType.typeName() in ("double", "float"):
            return F.when(tx.json_safe(c).isNotNull(), F.format_string(f"%.{digits}f", c)).otherwise("n/a")
        if f.dataType.typeName() in ("integer", "long"):
            return F.when(c.isNotNull(), F.format_number(c, 0)).otherwise("n/a")
        return F.coalesce(c.cast("string"), F.lit("n/a"))

    return F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(f) for f in df.schema.fields]), F.lit(" |"))


def report_markdown(df: DataFrame, digits: int = 4) -> DataFrame:
    """Rows of a Markdown table (without the head)."""
    return df.select(markdown_row(df, digits).alias("value"))


def markdown_head(df: DataFrame) -> list[str]:
    num = ("double", "float", "integer", "long")
    return ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---:" if f.dataType.typeName() in num else "---" for f in df.schema.fields) + " |"]


def write_report(df: DataFrame, path: str, fmt: str = "json", order: list[str] | None = None) -> None:
    """A report table as JSON lines or as one Markdown file, sorted for readers."""
    order = order or []
    if fmt == "json":
        report_json(df.orderBy(*order) if order else df).write.mode("overwrite").text(path)
        return
    if fmt != "markdown":
        raise ValueError(f"unknown report format {fmt}")
    df = cut_lineage(df, "report")  # computed by as many tasks as it takes; one task only puts its rows in order
    head = df.sparkSession.createDataFrame(list(enumerate(markdown_head(df))), "_i int, value string")
    body = df.select(F.lit(2).alias("_i"), markdown_row(df).alias("value"), *order)
    # a report has one row per metric and episode, so it fits one file
    out = head.unionByName(body, allowMissingColumns=True).coalesce(1).sortWithinPartitions("_i", *order)
    out.select("value").write.mode("overwrite").text(path)
