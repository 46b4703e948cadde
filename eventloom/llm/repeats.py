"""Substring dedup by enhanced suffix arrays: maximal repeats from the common-prefix interval tree.

Where could a string of ``least`` bytes come again? Each start of such a string is given to
the short gram in it that has the smallest hash. The choice depends on the string alone, so
equal strings have the same hash, and the starts of a document fall into runs of one gram:
windows, of some 130 bytes each. Only windows whose hash occurs more than once go on.

Equal windows are one: all but the earliest are repeats as a whole (an interval of one
string). Different windows of one hash are put into an enhanced suffix array (suffixes in
order, with common prefix lengths). A stack scan yields the intervals of its tree; those
whose occurrences differ in the byte before are left-maximal, and every occurrence but the
earliest is removed.

A hash with very many different windows would be a large group in one task: its windows
are taken apart into their strings of ``least`` bytes, which are grouped by digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import batches, pin

LEAST = 100
GRAM = 32
#: Different windows of one hash that a suffix array takes, at most; beyond, single strings are grouped.
GROUP = 1024
_BUFFER = 1 << 20
_BATCH = 1000
_SLOT = 7
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = "doc_id long, h int, pos long, len int"


# --- the enhanced suffix array -------------------------------------------------------------


class SuffixArray:
    """The suffixes of several strings, in order, with the common prefix of each with the one before.

    Ranks by 7, 14, 28, ... bytes are kept; two suffixes' common prefix is read from them,
    the longest steps first. Prefixes end with their string.
    """

    def __init__(self, strings: list[bytes]):
        length = np.fromiter(map(len, strings), np.int64, len(strings))
        self.begin = np.cumsum(length) - length
        self.flat = np.frombuffer(b"".join(strings), np.uint8)
        n = len(self.flat)
        self.left = np.repeat(self.begin + length, length) - np.arange(n)  # bytes up to the end of the string
        key = np.zeros(n, np.int64)
        for j in range(_SLOT):
            part = np.zeros(n, np.int64)
            part[: max(0, n - j)] = self.flat[j:].astype(np.int64) + 1
            part[self.left <= j] = 0
            key = key << 9 | part
        self.ranks, self.steps = [np.unique(key, return_inverse=True)[1].astype(np.int64)], [_SLOT]
        while self.steps[-1] < length.max(initial=0):
            rank, k = self.ranks[-1], self.steps[-1]
            if rank.max(initial=0) == n - 1:
                break
            next_ = np.zeros(n, np.int64)
            next_[: max(0, n - k)] = rank[k:] + 1
            next_[self.left <= k] = 0
            self.ranks.append(np.unique(rank * (n + 1) + next_, return_inverse=True)[1].astype(np.int64))
            self.steps.append(2 * k)
        self.order = np.argsort(self.ranks[-1], kind="stable")

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at ``a`` and at ``b``."""
        out = np.zeros(len(a), np.int64)
        top = len(self.flat) - 1
        left = np.minimum(self.left[a], self.left[b])
        for rank, k in zip(reversed(self.ranks), reversed(self.steps), strict=True):
            x, y = np.minimum(a + out, top), np.minimum(b + out, top)
            same = (out + k <= left) & (rank[x] == rank[y])
            out[same] += k
        for _ in range(_SLOT):
            x, y = np.minimum(a + out, top), np.minimum(b + out, top)
            out[(out < left) & (self.flat[x] == self.flat[y])] += 1
        return out


def maximal_repeats(strings: list[bytes], least: int = LEAST) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, string numbers, offsets) of every string of ``least`` or more bytes that occurs
    at least twice and cannot be made longer on either side at all its occurrences.

    All occurrences are given. An occurrence at the begin of a string differs from any other on the left.
    """
    s = SuffixArray(strings)
    for size, at in _intervals(s, least):
        number = np.searchsorted(s.begin, at, side="right") - 1
        yield size, number, at - s.begin[number]


def _intervals(s: SuffixArray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, positions) of the left-diverse common-prefix intervals, inner ones first."""
    order = s.order[s.left[s.order] >= least]
    if len(order) < 2:
        return
    lcp = s.common(order[:-1], order[1:])
    before = np.where(np.isin(order, s.begin), -1 - np.arange(len(order)), s.flat[order - 1])
    differs = np.append(0, np.cumsum(before[1:] != before[:-1]))
    # runs of common prefixes of ``least`` or more; each run is scanned with a stack of open intervals
    deep = np.flatnonzero(lcp >= least)
    if not len(deep):
        return
    cut = np.flatnonzero(np.diff(deep) != 1) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(deep)], strict=True):
        lo = int(deep[a])
        stack: list[tuple[int, int]] = []  # (common prefix, first suffix)
        values = lcp[lo : lo + b - a].tolist()
        for i, v in enumerate([*values, 0], lo):
            first = i
            while stack and stack[-1][0] > v:
                size, first = stack.pop()
                if differs[i] != differs[first]:
                    yield size, order[first : i + 1]
            if v and (not stack or stack[-1][0] < v):
                stack.append((v, first))


# --- windows -------------------------------------------------------------------------------


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def windows(pieces: list[bytes], least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """key, content digest, piece, offset and length of the windows of ``pieces``.

    A window holds neighbouring starts that share the first of their smallest grams, and the
    strings that begin there. So no string occurs twice in one window, and equal strings have equal keys.
    """
    flat = b"".join(pieces)
    length = np.fromiter(map(len, pieces), np.int64, len(pieces))
    begin = np.cumsum(length) - length
    n = len(flat)
    none = np.empty(0, np.int64)
    if n < least:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    up, down = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(flat, np.uint8).astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    low = grams = _mixed((total[gram:] - total[:-gram]) * down[: n - gram + 1])
    span, width = 1, least - gram + 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    # starts whose string is in one piece
    piece = np.repeat(np.arange(len(pieces)), np.maximum(length - least + 1, 0))
    first = np.cumsum(np.maximum(length - least + 1, 0)) - np.maximum(length - least + 1, 0)
    start = np.arange(len(piece)) - first[piece] + begin[piece]
    key = low[start]
    new = np.ones(len(start), bool)
    # the smallest gram is another one: by its hash, or because it began at the start before
    new[1:] = (key[1:] != key[:-1]) | (piece[1:] != piece[:-1]) | (grams[start[:-1]] == key[:-1])
    at = np.flatnonzero(new)
    size = np.diff(at, append=len(start))
    a, size = start[at], size + least - 1
    digest = _mixed((total[a + size] - total[a]) * down[a] + size.astype(np.uint64))
    return key[at], digest, piece[at], a - begin[piece[at]], size


def _pieces(texts: list[bytes], least: int) -> Iterator[tuple[list[bytes], list[int], list[int]]]:
    """Bounded lots of (bytes, text number, offset): long texts are cut, each string of ``least`` bytes in one piece."""
    lot: list[tuple[bytes, int, int]] = []
    size = 0
    for i, t in enumerate(texts):
        for a in range(0, max(0, len(t) - least + 1), _BUFFER):
            piece = t[a : a + _BUFFER + least - 1]
            lot.append((piece, i, a))
            size += len(piece)
            if size >= _BUFFER:
                yield tuple(map(list, zip(*lot, strict=True)))
                lot, size = [], 0
    if lot:
        yield tuple(map(list, zip(*lot, strict=True)))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, h (tells texts of one id apart), the text's bytes."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.hash(F.xxhash64(text)).alias("h"), text.cast("binary").alias("text"))


def _earliest(group: np.ndarray, doc: np.ndarray, h: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """0 for the earliest place of each group (and the same place again), else 1. Null ids are the largest numbers."""
    order = np.lexsort((pos, h, doc, group))
    g = group[order]
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.empty(0, np.int64)
    lead = np.repeat(order[first], np.diff(first, append=len(g)))
    out = np.zeros(len(group), np.int8)
    out[order] = (doc[order] != doc[lead]) | (h[order] != h[lead]) | (pos[order] != pos[lead])
    return out


_NULL_ID = (1 << 63) - 1


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_NULL_ID).to_numpy(zero_copy_only=False)


def candidates(docs: DataFrame, least: int = LEAST, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """doc_id, h, pos, len, key, later, large: windows that repeat as a whole (``later``), and
    the earliest of each content whose hash has other contents too.

    ``large``: the hash has over ``group`` contents. A null id is the largest long.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, hs, texts = _ids(b.column(0)), b.column(1).to_numpy(), b.column(2).to_pylist()
            found = []
            for pieces, text, at in _pieces(texts, least):
                key, digest, piece, offset, size = windows(pieces, least, gram)
                text, at = np.array(text)[piece], np.array(at)[piece]
                found.append((key.view(np.int64), digest.view(np.int64), ids[text], hs[text], at + offset, size))
            if not found:
                continue
            key, digest, doc, h, pos, size = (np.concatenate(c) for c in zip(*found, strict=True))
            same = np.unique(np.stack([key, digest], axis=1).copy().view("i8,i8").ravel(), return_inverse=True)[1].ravel()
            later = _earliest(same, doc, h, pos).astype(bool)
            # what is marked here needs no group: it goes by its own place
            key = np.where(later, _mixed(doc.astype(np.uint64) * _BASE + pos.astype(np.uint64)).view(np.int64), key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(digest), pa.array(doc), pa.array(h, pa.int32()), pa.array(pos), pa.array(size.astype(np.int32)), pa.array(later)],
                ["key", "digest", "doc_id", "h", "pos", "len", "local"],
            )

    batches(docs.sparkSession, _BATCH)
    rows = _keyed(docs).mapInArrow(run, f"key long, digest long, {_PLACE}, local boolean").repartition("key")
    by_content = Window.partitionBy("key", "digest", "local").orderBy("doc_id", "h", "pos")
    ranked = rows.withColumn("r", F.rank().over(by_content)).withColumn("later", F.col("local") | (F.col("r") > 1))
    contents = F.count_if(~F.col("later")).over(Window.partitionBy("key"))
    return ranked.withColumn("contents", contents).filter("later or contents > 1").select("doc_id", "h", "pos", "len", "key", "later", (F.col("contents") > group).alias("large"))


def _compared(docs: DataFrame, firsts: DataFrame, least: int) -> DataFrame:
    """doc_id, h, pos, len: the repeats among different windows of one hash."""

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows: list[tuple] = []
            loose: list[tuple] = []
            for doc, h, text, wins in zip(_ids(b.column(0)).tolist(), *(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                for w in wins:
                    part = text[w["pos"] : w["pos"] + w["len"]]
                    if w["large"]:
                        for i in range(len(part) - least + 1):
                            loose.append((doc, h, w["pos"] + i, hashlib.blake2b(part[i : i + least], digest_size=16).digest()))
                    else:
                        rows.append((w["key"].to_bytes(8, "big", signed=True), doc, h, w["pos"], w["len"], False, part))
            if loose:
                doc, h, pos = (np.array([x[i] for x in loose], np.int64) for i in range(3))
                digest = np.array([x[3] for x in loose], "S16").view("i8,i8")
                later = _earliest(np.unique(digest, return_inverse=True)[1].ravel(), doc, h, pos)
                for x, on in zip(loose, later.tolist(), strict=True):
                    rows.append((x[3] if not on else b"%d %d" % (x[0], x[2]), x[0], x[1], x[2], least, bool(on), None))
            types = (pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["key", "doc_id", "h", "pos", "len", "later", "part"])

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot: list[tuple] = []
        size, key0, digest0, place0 = 0, None, None, None
        for b in it:
            marks: list[tuple] = []
            for key, doc, h, pos, n, later, part in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if part is None:
                    if later or key == digest0 and (doc, h, pos) != place0:
                        marks.append((doc, h, pos, n))
                    elif key != digest0:
                        digest0, place0 = key, (doc, h, pos)
                    continue
                if key != key0 and size >= _BUFFER // 2:
                    yield _places(_marks(lot, least))
                    lot, size = [], 0
                key0 = key
                lot.append((doc, h, pos, part))
                size += len(part)
            yield _places(marks)
        yield _places(_marks(lot, least))

    wins = firsts.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.collect_list(F.struct("key", "pos", "len", "large")).alias("wins"))
    parts = _joined(docs, wins).select("doc_id", "h", "text", "wins").mapInArrow(cut, "key binary, doc_id long, h int, pos long, len int, later boolean, part binary")
    return parts.repartition("key").sortWithinPartitions("key", "doc_id", "h", "pos").mapInArrow(scan, _PLACE)


def _joined(docs: DataFrame, marked: DataFrame, how: str = "inner") -> DataFrame:
    k = _keyed(docs)
    return k.join(marked, (F.coalesce(k.doc_id, F.lit(_NULL_ID)) == F.col("_id")) & (k.h == F.col("_h")), how)


def _marks(lot: list[tuple], least: int) -> list[tuple]:
    """(doc, h, pos, length) of the repeats among the windows ``lot`` of (doc, h, pos, bytes)."""
    if len(lot) < 2:
        return []
    s = SuffixArray([w[3] for w in lot])
    doc, h, pos = (np.array([w[i] for w in lot], np.int64) for i in range(3))
    number = np.repeat(np.arange(len(lot)), np.diff(s.begin, append=len(s.flat)))
    place = pos[number] + np.arange(len(s.flat)) - s.begin[number]
    who = np.unique(np.stack([doc, h], axis=1), axis=0, return_inverse=True)[1].ravel()
    age = (who[number] << 40) + place
    longest = np.zeros(len(s.flat), np.int64)
    for size, at in _intervals(s, least):
        old = age[at]
        later = at[old > old.min()]
        longest[later] = np.maximum(longest[later], size)
    at = np.flatnonzero(longest)
    n = number[at]
    return list(zip(doc[n].tolist(), h[n].tolist(), place[at].tolist(), longest[at].tolist(), strict=True))


def _places(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int32()))], ["doc_id", "h", "pos", "len"])


def spans(docs: DataFrame, least: int = LEAST, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """doc_id, h, pos, len: pieces of documents whose every string of ``least`` bytes starts earlier too; they overlap."""
    found = pin(candidates(docs, least, gram, group), "repeat-windows")
    whole = found.filter("later").select("doc_id", "h", "pos", "len")
    return whole.unionByName(_compared(docs, found.filter("not later"), least))


def remove_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, spans (start, end), kept (bytes).

    A byte goes if a string of ``least`` bytes that covers it starts earlier as well: in a
    document of smaller id (nulls last; of one id by a digest of the text), or before in the
    same. Offsets count UTF-8 bytes; ``spans`` are the maximal removed runs. Null and empty
    texts have nothing to remove. Repeated rows of one id and text count as one document and
    have the same result. An empty table gives no rows; other columns are ignored.
    """

    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sizes, gone, runs, kept = [], [], [], []
            for text, marks in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                out: list[list[int]] = []
                for m in sorted((m["pos"], m["pos"] + m["len"]) for m in marks or ()):
                    if out and m[0] <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], m[1])
                    else:
                        out.append([*m])
                sizes.append(len(text))
                gone.append(sum(z - a for a, z in out))
                runs.append([{"start": a, "end": z} for a, z in out])
                kept.append(b"".join(text[a:z] for a, z in zip([0, *(z for _, z in out)], [*(a for a, _ in out), len(text)], strict=True)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    marks = spans(docs, least, gram, group).groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.collect_list(F.struct("pos", "len")).alias("marks"))
    return _joined(docs, marks, "left").select("doc_id", "text", "marks").mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
