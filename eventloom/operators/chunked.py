"""Ordered operators that split a long series instead of giving it to one task.

A plain ``Window.partitionBy(key).orderBy(t)`` puts every row of a key in one task, so a
key with a third of all rows becomes the whole job. Here a series is cut into chunks of
its order column, each (key, chunk) is processed on its own, and only one summary row per
chunk is ordered per key to carry values over the chunk borders. Results are exact.

``keys`` must not be NULL. ``order`` lists column names; the first is numeric and cuts
the chunks, all together give a total order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.session import cut_lineage

CHUNK = "_chunk"


@dataclass(frozen=True)
class Rows:
    """Chunks of about ``target`` rows, less than twice as many.

    Rows are counted by cells of ``cell`` units of the first order column, and a chunk is a
    run of whole cells. A cell of more rows than ``target`` is cut into up to ``PARTS`` parts
    of its own extent, and those again: by the first order column while its rows differ in
    it, then by the next. So rows of one instant are cut too. Only a column that is no number
    or time cannot cut. The counts are made when the operator is called, in one pass, with
    one more pass over the rows of heavy cells for each cut; the number of chunks follows the
    rows, and what is ordered per key is a count per cell.
    """

    target: int
    cell: float


PARTS = 64
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "timestamp", "date", "boolean")


def _number(df: DataFrame, col: str) -> Column | None:
    """A column as a number in its own order; None if it has none."""
    kind = df.schema[col].dataType.simpleString()
    if not kind.startswith(_NUMBERS):
        return None
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(col).cast("timestamp")).cast("double")
    return (F.unix_date(col) if kind == "date" else F.col(col)).cast("double")


def _cut_rows(df: DataFrame, keys: list[str], order: list[str], width: Rows) -> DataFrame:
    """``df`` with chunks of bounded size: the cut table is refined until no cell is heavy."""
    by = {c: n for c in order if (n := _number(df, c)) is not None}
    ends = [f(n).alias(f"_{e}{i}") for i, n in enumerate(by.values()) for e, f in (("lo", F.min), ("hi", F.max))]
    split = lambda e: reduce(lambda a, i: a.when(F.col(f"_hi{i}") > F.col(f"_lo{i}"), e(i)), range(1, len(by)), F.when(F.col("_hi0") > F.col("_lo0"), e(0)))
    path = F.array(F.floor(F.col(order[0]) / F.lit(width.cell)).cast("long"))

    def counted(rows: DataFrame) -> DataFrame:
        return cut_lineage(rows.groupBy(*keys, "_path").agg(F.count(F.lit(1)).alias("_n"), *ends), "cells")

    def finer(rows: DataFrame, table: DataFrame, how: str) -> DataFrame:
        value = reduce(lambda a, i: a.when(F.col("_by") == i, list(by.values())[i]), range(1, len(by)), F.when(F.col("_by") == 0, list(by.values())[0]))
        part = F.least(F.floor((value - F.col("_from")) / F.col("_step")).cast("long"), F.lit(PARTS - 1))
        to = F.when(F.col("_by").isNull(), F.col("_path")).otherwise(F.concat("_path", F.array(part)))
        return rows.join(table, [*keys, "_path"], how).withColumn("_path", to).drop("_by", "_from", "_step")

    rows = part = df.withColumn("_path", path)
    cells = counted(rows)
    done = None
    while True:
        heavy = cells.where((F.col("_n") > width.target) & split(F.lit).isNotNull())
        if heavy.limit(1).count() == 0:
            break
        table = cut_lineage(heavy.select(*keys, "_path", split(F.lit).alias("_by"), split(lambda i: F.col(f"_lo{i}")).alias("_from"), split(lambda i: (F.col(f"_hi{i}") - F.col(f"_lo{i}")) / PARTS).alias("_step")), "cuts")
        light = cells.join(table.select(*keys, "_path"), [*keys, "_path"], "left_anti")
        done = light if done is None else done.unionByName(light)
        part, rows = finer(part, table, "inner"), finer(rows, table, "left")
        cells = counted(part)
    cells = (cells if done is None else done.unionByName(cells)).select(*keys, "_path", "_n")
    before = Window.partitionBy(*keys).orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)
    cuts = cells.select(*keys, "_path", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / width.target).alias(CHUNK))
    return rows.join(cuts, [*keys, "_path"]).select(*df.columns, CHUNK)


def with_chunk(df: DataFrame, keys: list[str], order: list[str], width: float | Rows) -> DataFrame:
    """Adds the chunk number; a no-op when present. ``width``: of a chunk in units of the order column, or :class:`Rows`.

    Add it once before chaining several functions of this module: they keep it, so rows stay
    where they are and only the small edge summaries move.
    """
    if CHUNK in df.columns:
        return df
    if not isinstance(width, Rows):
        return df.withColumn(CHUNK, F.floor(F.col(order[0]) / F.lit(width)).cast("long"))
    return _cut_rows(df, keys, order, width)


def _ord(order: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def _neighbour(df, keys, order, values, width, ahead: bool) -> DataFrame:
    cols = df.columns
    c = with_chunk(df, keys, order, width)
    val = F.struct(*[v.alias(n) for n, v in values.items()])
    w = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    shift = F.lead if ahead else F.lag
    pick = F.min_by if ahead else F.max_by
    edge = c.groupBy(*keys, CHUNK).agg(pick(val, _ord(order)).alias("_edge"))
    over = Window.partitionBy(*keys).orderBy(CHUNK)
    edge = edge.select(*keys, CHUNK, shift("_edge").over(over).alias("_edge"))
    inside = c.withColumn("_near", shift(val).over(w))
    return inside.join(edge, [*keys, CHUNK], "left").select(
        *cols, *[F.coalesce(F.col("_near"), F.col("_edge"))[n].alias(n) for n in values]
    )


def prev_value(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], width) -> DataFrame:
    """Values of the previous row of the same key (NULL on its first row)."""
    return _neighbour(df, keys, order, values, width, False)


def next_value(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], width) -> DataFrame:
    """Values of the next row of the same key (NULL on its last row)."""
    return _neighbour(df, keys, order, values, width, True)


def running_sum(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], width) -> DataFrame:
    """Inclusive running sums per key: chunk-local sums plus the total of earlier chunks."""
    cols = df.columns
    c = with_chunk(df, keys, order, width)
    w = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    base = c.groupBy(*keys, CHUNK).agg(*[F.sum(v).alias(f"_b_{n}") for n, v in values.items()])
    base = base.select(*keys, CHUNK, *[F.sum(f"_b_{n}").over(before).alias(f"_b_{n}") for n in values])
    inside = c.select("*", *[F.sum(v).over(w).alias(f"_s_{n}") for n, v in values.items()])
    joined = inside.join(base, [*keys, CHUNK], "left")
    return joined.select(
        *cols,
        *[
            F.when(F.col(f"_b_{n}").isNull(), F.col(f"_s_{n}"))
            .otherwise(F.coalesce(F.col(f"_s_{n}"), F.lit(0)) + F.col(f"_b_{n}"))
            .alias(n)
            for n in values
        ],
    )


def positions(df: DataFrame, keys: list[str], order: list[str], width, name: str = "pos") -> DataFrame:
    """Zero-based position of each row in its key (``row_number() - 1``)."""
    out = running_sum(df, keys, order, {name: F.lit(1).cast("long")}, width)
    return out.withColumn(name, F.col(name) - 1)


def carry_last(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], width) -> DataFrame:
    """Last non-NULL value up to and including the row, over the whole key."""
    cols = df.columns
    c = with_chunk(df, keys, order, width)
    w = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    seen = c.select(*keys, CHUNK, *order, *[v.alias(f"_v_{n}") for n, v in values.items()])
    edge = seen.groupBy(*keys, CHUNK).agg(
        *[
            F.max_by(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), _ord(order))).alias(f"_e_{n}")
            for n in values
        ]
    )
    edge = edge.select(
        *keys, CHUNK, *[F.last(f"_e_{n}", ignorenulls=True).over(before).alias(f"_e_{n}") for n in values]
    )
    inside = c.select("*", *[F.last(v, ignorenulls=True).over(w).alias(f"_l_{n}") for n, v in values.items()])
    return inside.join(edge, [*keys, CHUNK], "left").select(
        *cols, *[F.coalesce(F.col(f"_l_{n}"), F.col(f"_e_{n}")).alias(n) for n in values]
    )


def _placed(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows placed by ``by`` and sorted, with a flag on the first row of each group."""
    d = df.repartition(*by)
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1
    return d.withColumn("_first", first).sortWithinPartitions(*by, *order)


def blocks(batches) -> Iterator[dict]:
    """The groups of a placed table one after another, as NumPy columns, across Arrow batches."""
    import numpy as np

    held = None
    for pdf in batches:
        cols = {c: pdf[c].to_numpy() for c in pdf.columns}
        first = cols.pop("_first")
        n = len(first)
        edges = np.flatnonzero(first)
        edges = [0, *edges[edges > 0].tolist(), n]
        for lo, hi in zip(edges, edges[1:]):
            part = {c: a[lo:hi] for c, a in cols.items()}
            if held is not None and not first[lo]:
                held = {c: np.concatenate([held[c], part[c]]) for c in part}
                continue
            if held is not None:
                yield held
            held = part
    if held is not None:
        yield held


def _per_block(fn: Callable[[dict], dict], rows: int = 50_000) -> Callable:
    """Maps ``fn`` over blocks and emits its output columns in larger batches."""

    def run(batches):
        import numpy as np
        import pandas as pd

        out, size = [], 0

        def frame():
            return pd.DataFrame({c: np.concatenate([o[c] for o in out]) for c in out[0]})

        for b in blocks(batches):
            o = fn(b)
            out.append(o)
            size += len(next(iter(o.values())))
            if size >= rows:
                yield frame()
                out, size = [], 0
        if out:
            yield frame()

    return run


def chunk_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    width,
    *,
    summary: Callable[[dict], dict],
    summary_schema: str,
    entries: Callable[[dict], dict],
    entry_schema: str,
    replay: Callable[[dict], dict],
    out_schema: str,
) -> DataFrame:
    """Exact sequential recurrence over a chunked series.

    Each function takes and returns a dict of NumPy columns.
    ``summary``: a chunk in order -> what it does to any state that may enter it (a few rows).
    ``entries``: all summaries of one key in chunk order -> the state entering each chunk.
    ``replay``: a chunk in order with its entry state -> output rows.

    Rows are only ever grouped by (key, chunk); the per-key step sees a few rows per chunk,
    so a key with a third of all rows stays small there. Groups stream through a task one
    after another, so many short series cost no more than one long one.
    """
    import numpy as np

    by = [*keys, CHUNK]
    kinds = {k: df.schema[k].dataType.simpleString() for k in keys}
    keycols = ", ".join(f"`{k}` {t}" for k, t in kinds.items()) + f", {CHUNK} long"
    rows = _placed(with_chunk(df, keys, order, width), by, order)

    def with_keys(fn):
        def run(b):
            o = fn(b)
            n = len(next(iter(o.values())))
            return {**{k: np.repeat(b[k][:1], n) for k in by if k not in o}, **o}

        return run

    summ = rows.mapInPandas(_per_block(with_keys(summary)), f"{keycols}, _seq int, {summary_schema}")
    entry = _placed(summ, keys, [CHUNK, "_seq"]).mapInPandas(_per_block(with_keys(entries)), f"{keycols}, {entry_schema}")
    joined = rows.drop("_first").join(entry, by)
    joined = joined.withColumn("_first", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1).sortWithinPartitions(*by, *order)
    return joined.mapInPandas(_per_block(replay), out_schema)
