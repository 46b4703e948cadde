"""Substring dedup by line hashing: repeated units of text go, the earliest occurrence stays.

A unit is a line, or with ``sentences`` a sentence of a line, so that a passage in the midst
of a line is found too. Units are normalised (case, blanks) and digested; digests are grouped
over all documents; the occurrence of the smallest (doc_id, place) stays and the others are
removed at their original offsets. A short unit recurs by chance, so it counts as the same
only together with the units before it.

Before the shuffle each task keeps only its own earliest occurrence of a digest and marks
the others at once, so that a unit which is everywhere is sent once per batch.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import batches

#: A unit of fewer words is digested with as many units before it as make up that number.
MIN_WORDS = 5
_LINE = re.compile(r"[^\n]+")
_SENTENCE = re.compile(r"[^\n.!?]+[.!?]*|[.!?]+")
_BATCH = 1000


def units(text: str, sentences: bool = True, min_words: int = MIN_WORDS) -> list[tuple[int, int, bytes]]:
    """(start, end, digest) of the units of ``text``; offsets in characters.

    Equal digests (128 bits): equal texts after lower-casing and blanks made one, and for a
    unit of under ``min_words`` words equal units before it too, back to that number of
    words. A short unit with too little before it is none.
    """
    out = []
    before: deque[list[str]] = deque(maxlen=min_words)
    for m in (_SENTENCE if sentences else _LINE).finditer(text):
        words = m.group().lower().split()
        if not words:
            continue
        parts, n = [words], len(words)
        for earlier in reversed(before):
            if n >= min_words:
                break
            parts.insert(0, earlier)
            n += len(earlier)
        before.append(words)
        if n >= min_words:
            out.append((m.start(), m.end(), hashlib.blake2b("\n".join(map(" ".join, parts)).encode(), digest_size=16).digest()))
    return out


def repeated(docs: DataFrame, sentences: bool = True, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, h (xxhash64 of the text), unit: the units that also occur earlier, by their number in the document."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows: list[tuple[int | None, int, int, bytes]] = []
            for doc, h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if text:
                    rows += [(doc, h, i, d) for i, (_, _, d) in enumerate(units(text, sentences, min_words))]
            rank = [(r[0] is None, r[0] or 0, r[1], r[2]) for r in rows]
            least: dict[bytes, tuple] = {}
            for r, k in zip(rows, rank, strict=True):
                if r[3] not in least or k < least[r[3]]:
                    least[r[3]] = k
            later = [k != least[r[3]] for r, k in zip(rows, rank, strict=True)]
            # a marked one needs no group any more: it goes with its own place
            key = [r[3] if not on else b"%x %x" % (r[1] & 0xFFFFFFFFFFFFFFFF, r[2]) for r, on in zip(rows, later, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.binary()), pa.array(later, pa.bool_()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32())],
                ["key", "later", "doc_id", "h", "unit"],
            )

    batches(docs.sparkSession, _BATCH)
    seen = _keyed(docs).mapInArrow(run, "key binary, later boolean, doc_id long, h long, unit int")
    first = Window.partitionBy("key", "later").orderBy(F.col("doc_id").asc_nulls_last(), "h", "unit")
    return seen.withColumn("r", F.rank().over(first)).filter("later or r > 1").select("doc_id", "h", "unit")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text")


def substring_dedup(docs: DataFrame, sentences: bool = True, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per input row: doc_id, n_units, n_removed, spans (start, end of what is removed), kept.

    Units are ranked by doc_id, nulls last, then by place; of equal units the first stays.
    Offsets count characters of the original text; neighbouring spans are apart as their
    units are. ``kept`` is the text without the spans. Null text: no units, ``kept`` null;
    empty text: empty. Repeated rows of one id and text count as one document and have the
    same result. An empty table gives no rows; other columns are ignored.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n, removed, spans, kept = [], [], [], []
            for text, gone in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                own = units(text, sentences, min_words) if text else []
                cut = [own[i][:2] for i in sorted(set(gone or ()))]
                n.append(len(own))
                removed.append(len(cut))
                spans.append([{"start": a, "end": e} for a, e in cut])
                ends = [0, *(e for _, e in cut)]
                kept.append(text if text is None else "".join(text[a:z] for a, z in zip(ends, [*(a for a, _ in cut), len(text)], strict=True)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, _SPANS), pa.array(kept, pa.string())], ["doc_id", "n_units", "n_removed", "spans", "kept"])

    gone = repeated(docs, sentences, min_words).groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.collect_list("unit").alias("gone"))
    both = _keyed(docs).join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left").select("doc_id", "text", "gone")
    return both.mapInArrow(run, "doc_id long, n_units long, n_removed long, spans array<struct<start:int,end:int>>, kept string")


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
