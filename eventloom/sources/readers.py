"""Table scans. Filters use stored columns so that they reach partitions and Parquet row groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom import schemas


def read_events(spark: SparkSession, path: str, episodes: list[int] | None = None, cameras: list[str] | None = None, t0_us: int | None = None,
                t1_us: int | None = None, columns: list[str] | None = None, labelled: bool = False) -> DataFrame:
    """Events of some episodes and cameras in ``[t0, t1)``.

    ``episode`` and ``camera`` are partition folders, ``t_us`` is stored and sorted, so the
    scan opens only the folders and row groups it needs.
    """
    schema = schemas.LABELLED if labelled else schemas.EVENTS
    df = spark.read.schema(schema).parquet(path)
    if episodes is not None:
        df = df.where(F.col("episode").isin(episodes))
    if cameras is not None:
        df = df.where(F.col("camera").isin(cameras))
    if t0_us is not None:
        df = df.where(F.col("t_us") >= t0_us)
    if t1_us is not None:
        df = df.where(F.col("t_us") < t1_us)
    return df.select(*columns) if columns else df


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frame table with a check of the stored layout."""
    df = spark.read.parquet(path)
    want = schemas.names(schemas.FRAMES)
    df = schemas.require(df, want).select(*want)
    schemas.same_layout(df, schemas.FRAMES)
    return df


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per episode from a JSON array of episodes."""
    return spark.read.schema(schemas.MANIFEST).json(path, multiLine=True)


def read_samples(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """One row per entry of ``samples`` in dataset documents (one per file, or one per line)."""
    row = T.StructType.fromDDL(schemas.SAMPLES)
    doc = spark.read.schema(T.StructType([T.StructField("samples", T.ArrayType(row))])).json(path, multiLine=one_per_file)
    return doc.select(F.inline("samples"))


def read_conditions(spark: SparkSession, path: str, key: str, row: int | None = None, list_columns: tuple[str, ...] = ()) -> DataFrame:
    """Initial-condition rows; ``row`` picks by ordinal on a numeric key, list columns become arrays."""
    from eventloom.operators import chunked

    df = spark.read.csv(path, header=True)
    for c in list_columns:
        # lists are written with single or double quotes
        df = df.withColumn(c, F.from_json(F.regexp_replace(c, "'", '"'), "array<string>"))
    if row is None:
        return df
    d = df.withColumns({"_key": F.col(key).cast("double"), "_one": F.lit(1)})
    d = chunked.positions(d, ["_one"], ["_key"], 100_000, "_row")
    return d.where(F.col("_row") == row).drop("_key", "_one", "_row")


def read_pixels(spark: SparkSession, path: str, episodes: list[int] | None = None, frames: tuple[int, int] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rasters stored as one array per frame, opened to one row per pixel; only asked-for frames and channels are read."""
    df = spark.read.schema(schemas.RASTERS).parquet(path)
    if episodes is not None:
        df = df.where(F.col("episode").isin(episodes))
    if frames is not None:
        df = df.where((F.col("frame_index") >= frames[0]) & (F.col("frame_index") < frames[1]))
    channels = columns or ["depth", "mvx", "mvy", "r", "g", "b", "seg"]
    return open_rasters(df, channels)


def open_rasters(df: DataFrame, channels: list[str], width: str = "width") -> DataFrame:
    cells = F.posexplode(F.arrays_zip(*channels)).alias("_i", "_c")
    d = df.select("episode", "camera", "frame_index", F.col(width).alias("_w"), cells)
    return d.select("episode", "camera", "frame_index", F.floor(F.col("_i") / F.col("_w")).cast("int").alias("y"), (F.col("_i") % F.col("_w")).cast("int").alias("x"),
                    *[F.col(f"_c.{c}").alias(c) for c in channels])


def scan_demos(spark: SparkSession, root: str, suffix: str = "h5") -> DataFrame:
    """Episode files in ``demo<N>`` folders in folder order, with the number of files per folder.

    Only file metadata is listed; contents are never read.
    """
    f = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", "true").load(root)
    f = f.select("path", "length", F.regexp_extract("path", r"demo=?(\d+)", 1).alias("_n")).where("_n <> ''")
    f = f.withColumn("demo", F.col("_n").cast("long")).drop("_n")
    n = f.groupBy("demo").agg(F.count(F.lit(1)).alias("files"))
    return f.join(n, "demo")


def new_files(files: DataFrame, seen: DataFrame, suffix: str, min_age_s: int, now, pattern: str | None = None) -> DataFrame:
    """Files of a kind that were not seen before and have been still for a while."""
    ok = F.col("path").endswith(suffix) & (F.unix_seconds(now) - F.unix_seconds("modificationTime") >= min_age_s)
    if pattern:
        ok = ok & F.col("path").like(pattern)
    return files.where(ok).join(seen.select("path"), "path", "left_anti")


def missing_files(expected: DataFrame, present: DataFrame, key: str = "path") -> DataFrame:
    return expected.join(present.select(key), key, "left_anti")


def verify_files(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Expected ``hashes`` map per sample against actual ``(path, sha256)``: rows that differ or are absent."""
    e = expected.select("sample_index", F.explode("hashes").alias("path", "want"))
    j = e.join(present.select("path", "sha256"), "path", "left")
    return j.where(F.col("sha256").isNull() | (F.col("sha256") != F.col("want"))).select("sample_index", "path", F.col("sha256").isNull().alias("absent"))
