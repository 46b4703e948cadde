"""SimHash near-dedup: 64-bit fingerprints of word shingles, compared exactly, tile against tile.

Distinct fingerprints are sorted by the population counts of their four 16-bit quarters and
packed into tiles. Two fingerprints differ in at least as many bits as their quarters'
counts do, so a pair of tiles is skipped if the boxes of counts that hold them are more than
the radius apart. What is left is compared in full with exclusive-or and bit counts.

A tile pair reports a forest that connects what it has linked, not every pair, and equal
fingerprints are one: the output of a large group of copies stays small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import batches, components, pin
from eventloom.llm.exact_dedup import only

SHINGLE = 4
RADIUS = 4
TILE = 4096
_SEED = 42


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one UTF-8 text (see :func:`fingerprints`)."""
    words = text.lower().split()  # on bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    flat, n = b" ".join(words), len(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(flat, _SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = [0, *(ends[: n - shingle] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(flat[a:b], _SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        part = h[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, sha: fingerprint (a long) and SHA-256 of the text, one row per input row.

    Words are runs of anything but the six ASCII blanks; A-Z are lower-cased. A bit is set
    if it is in over half the XXH64 values (seed 42) of the shingles, repeats included.
    Fewer words than a shingle are one shingle; no words (null, empty, blank): 0.
    """
    batches(docs.sparkSession, 2000)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = [(t or "").encode() for t in b.column(1).to_pylist()]
            fp = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
            sha = [hashlib.sha256(t).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), pa.array(sha, pa.binary())], ["doc_id", "fp", "sha"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long, sha binary")


def _quarters(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp.view("<u2").reshape(-1, 4)).astype(np.int32)


def tiles(fps: DataFrame, size: int = TILE) -> DataFrame:
    """Distinct ``fp`` in tiles: tile, box (least and most count of each quarter), content.

    Pinned: a tile's number is its partition's and its place there. The number of partitions
    follows the number of fingerprints, so that tiles are nearly full.
    """
    distinct = pin(fps.select("fp").distinct(), "fingerprints")
    n = distinct.count()

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, rest = TaskContext.get().partitionId(), 0, np.empty(0, np.int64)
        for last, fp in _and_last(b.column(0).to_numpy() for b in it):
            rest = np.concatenate([rest, fp])
            while len(rest) >= size or last and len(rest):
                own, rest = np.ascontiguousarray(rest[:size]), rest[size:]
                q = _quarters(own)
                box = [*q.min(axis=0).tolist(), *q.max(axis=0).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([part << 32 | k]), pa.array([box], pa.list_(pa.int32())), pa.array([own.tobytes()], pa.binary())], ["tile", "box", "content"])
                k += 1

    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(4)]
    keyed = distinct.select("fp", *[q.alias(f"q{i}") for i, q in enumerate(quarter)])
    ordered = keyed.repartitionByRange(max(1, n // (8 * size)), "q0", "q1", "q2", "q3", "fp").sortWithinPartitions("q0", "q1", "q2", "q3", "fp")
    return pin(ordered.select("fp").mapInArrow(pack, "tile long, box array<int>, content binary"), "tiles")


def _and_last(arrays: Iterator[np.ndarray]) -> Iterator[tuple[bool, np.ndarray]]:
    """(is the last, array)."""
    held = None
    for a in arrays:
        if held is not None:
            yield False, held
        held = a
    if held is not None:
        yield True, held


def tile_pairs(tiled: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs a <= b of tiles whose boxes are within the radius.

    Tiles meet in the cells (count of quarter 0, count of quarter 1) that one of them holds
    and the other reaches; a pair that meets in several cells is kept once.
    """
    lo, hi = (lambda q: F.col("box")[q]), (lambda q: F.col("box")[q + 4])
    own = tiled.select(F.col("tile").alias("b"), F.col("box").alias("box_b"), F.explode(F.sequence(lo(0), hi(0))).alias("c0"), F.col("box").alias("_x"))
    own = own.select("b", "box_b", "c0", F.explode(F.sequence(F.col("_x")[1], F.col("_x")[5])).alias("c1"))
    reach = tiled.select(F.col("tile").alias("a"), F.col("box").alias("box_a"), F.explode(F.sequence(lo(0) - radius, hi(0) + radius)).alias("c0"))
    left = F.lit(radius) - F.greatest(F.lit(0), F.col("box_a")[0] - F.col("c0"), F.col("c0") - F.col("box_a")[4])
    reach = reach.select("a", "box_a", "c0", F.explode(F.sequence(F.col("box_a")[1] - left, F.col("box_a")[5] + left)).alias("c1"))
    gap = sum((F.greatest(F.lit(0), F.col("box_a")[q] - F.col("box_b")[q + 4], F.col("box_b")[q] - F.col("box_a")[q + 4]) for q in range(4)), F.lit(0))
    return reach.join(own, ["c0", "c1"]).filter((F.col("a") <= F.col("b")) & (gap <= radius)).select("a", "b").distinct()


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least connected node of each of ``n`` nodes, given links i-j."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        if (label == before).all():
            break
    return label


def compare(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (root, member) that connect all fingerprints of two tiles at ``radius`` or fewer differing bits."""
    both = np.concatenate([x, y])
    label = np.arange(len(both))
    rows = max(1, (1 << 17) // len(y))
    for at in range(0, len(x), rows):
        a, b = np.nonzero(np.bitwise_count(x[at : at + rows, None] ^ y[None, :]) <= radius)
        if len(a):
            known = np.flatnonzero(label != np.arange(len(both)))
            label = _forest(len(both), np.concatenate([a + at, known]), np.concatenate([b + len(x), label[known]]))
    moved = np.flatnonzero(label != np.arange(len(both)))
    return both[label[moved]], both[moved]


def links(tiled: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints connected by links within the radius."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                a, b = compare(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), radius)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    batches(tiled.sparkSession, 200)
    left = tiled.select(F.col("tile").alias("a"), F.col("content").alias("x"))
    right = tiled.select(F.col("tile").alias("b"), F.col("content").alias("y"))
    pairs = pin(tile_pairs(tiled, radius), "tile-pairs")
    # some 16 pairs a task, however few bytes they are
    return pairs.join(left, "a").repartition(max(1, pairs.count() // 16), "b").join(right, "b").select("x", "y").mapInArrow(run, "a long, b long").filter("a != b")


def _rooted(prints: DataFrame, radius: int, tile: int) -> DataFrame:
    """The rows of ``prints`` with the least fingerprint of their component (``root``)."""
    prints = pin(prints, "doc-fingerprints")
    found = pin(components(links(tiles(prints, tile), radius)).withColumnsRenamed({"node": "fp"}), "fp-components")
    return prints.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest doc_id that links of ``radius`` or fewer bits reach, the
    document included; null ids count for nothing, and a component of such only is null.
    Texts without words share fingerprint zero and are linked like any other. Repeated rows
    are in one component. An empty table gives no rows; other columns are ignored.
    """
    own = _rooted(fingerprints(docs, shingle), radius, tile)
    least = own.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return own.join(least, "root").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their component, all columns kept (a null id only if no other is there)."""
    own = _rooted(fingerprints(docs, shingle), radius, tile)
    first = own.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "sha")).alias("m"))
    return only(docs, pin(first.select(F.col("m.doc_id").alias("_id"), F.col("m.sha").alias("_sha")), "kept-of-each"))
