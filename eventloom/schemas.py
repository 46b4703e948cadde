"""Column layouts of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

EVENTS = ("episode bigint, camera string, event_id bigint, t_us bigint, x int, y int, p tinyint, q double")
LABELLED = EVENTS + ", q_motion double, q_static double, q_dynamic double, q_illumination double, q_unknown double"
FRAMES = ("action array<float>, state array<float>, env_state array<float>, timestamp double, frame_index bigint, episode bigint, index bigint, task_index bigint")
RASTERS = ("episode bigint, camera string, frame_index bigint, height int, width int, depth array<float>, mvx array<float>, mvy array<float>, r array<int>, g array<int>, b array<int>, seg array<int>")
CAMERAS = ("episode bigint, camera string, frame_index bigint, pose array<double>, fx double, fy double, cx double, cy double")
MANIFEST = ("name string, event_count bigint, event_start_us bigint, event_end_us bigint, frame_count bigint, height int, width int, "
    "instruction struct<task: string, objects: array<string>, containers: array<string>>")
SAMPLES = ("sample_index bigint, relative_path string, split string, success boolean, frame_count bigint, event_counts map<string, bigint>")


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """The table itself, or an error that names what is missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def names(ddl: str) -> list[str]:
    return T.StructType.fromDDL(ddl).fieldNames()


def same_layout(df: DataFrame, ddl: str) -> None:
    """Names and types must agree, in order; nullability is ignored."""
    have = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    want = [(f.name, f.dataType.simpleString()) for f in T.StructType.fromDDL(ddl).fields]
    if have != want:
        raise ValueError(f"layout differs: {[h for h in have if h not in want]} instead of {[w for w in want if w not in have]}")
