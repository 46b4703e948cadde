"""Fuzzy line dedup: MinHash of character shingles, banding, exact Jaccard, union-find.

A line's content number is a digest of its normalised form, so equal lines are one from the
start. One hash per shingle fills all bins of a signature (one-permutation MinHash; an empty
bin takes the next filled one's value). Lines that share a band are candidates; they are
linked if the exact Jaccard similarity of their shingle sets reaches the threshold, and one
occurrence per connected component stays.

All lines of one band value are compared. Up to ``CAP`` different lines make pairs. More are
dealt into blocks of bounded text, and a task compares the lines of one or two blocks: those
that share a rare shingle of their prefixes, which misses no pair at the threshold. Lines
that are linked already are not compared again, so a task returns a forest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.collocations import BITS_EACH, MAX_BITS, probe
from eventloom.llm.common import batches, components, pin

SHINGLE = 9
#: With 9 characters one changed letter takes a line of under 89 below the threshold; with 4, one of under 39.
#: Lines of up to SHORT_TO characters are compared by the short shingles, from LONG_FROM on by the
#: long ones; lines further apart in length can reach the threshold only if they repeat themselves.
SHORT = 4
LONG_FROM, SHORT_TO = 100, 130
ROWS, BANDS = 4, 12
THRESHOLD = 0.8
#: Lines of fewer characters count as equal only if they are.
MIN_CHARS = 20
#: Up to so many different lines of a band value make pairs; more go to blocks of about ``BLOCK`` shingles.
CAP = 16
BLOCK = 200_000
_BATCH = 1000
_LINES = 100
_CHARS = 1_000_000
#: Multiplications that all pairs of a block may cost; beyond that pairs are found by rare shingles.
_DENSE = 2_000_000_000
#: What a line counts for in a block besides its shingles.
_LINE = 100
_LOW = 0xFFFFFFFF
_ANY = 1 << 62
#: Length of shingles, and the lengths of lines that are compared by them.
Kind = tuple[int, int, int]
_DEALT = (("part", pa.int32()), ("sure", pa.bool_()), ("key", pa.binary()), ("a", pa.binary()))
_DEALT_DDL = "part int, sure boolean, key binary, a binary"
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def normal(line: str) -> str:
    x = line.lower()
    # no other white space is printable
    return x if x.isprintable() and "  " not in x and x[:1] != " " != x[-1:] else " ".join(x.split())


def lines_of(text: str) -> list[tuple[int, str]]:
    """(line number, normalised line) of the lines that are not empty after normalisation."""
    return [(i, x) for i, x in enumerate(map(normal, text.split("\n"))) if x]


def content(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode()) - (1 << 63)


def shingles(line: str, n: int = SHINGLE) -> set[str]:
    """The ``n``-character shingles; a shorter line is one."""
    return {line[i : i + n] for i in range(max(1, len(line) - n + 1))}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def _rolled(codes: np.ndarray, n: int) -> np.ndarray:
    """A polynomial hash of the ``n`` codes from each place on, from those of half as many."""
    if n == 1:
        return codes
    half = _rolled(codes, n // 2)
    out = half.copy()
    part = half[n // 2 :]
    out[: len(part)] *= np.uint64(pow(int(_MIX[0]), n // 2, 1 << 64))
    out[: len(part)] += part
    if n % 2:
        last = codes[n - 1 :]
        out[: len(last)] *= _MIX[0]
        out[: len(last)] += last
    return out


def _hashed(lines: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each shingle's 64-bit hash and the place of its line; a line shorter than ``n`` is one shingle."""
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64)
    end = np.cumsum(length)
    h = _rolled(codes, n)
    # those that leave their line are dropped
    count = np.maximum(length - n + 1, 1)
    short = np.flatnonzero(length < n)
    h[(end - length)[short]] = [xxhash.xxh3_64_intdigest(lines[i].encode()) for i in short]
    inside = np.ones(len(h), bool)
    drop = length - count
    inside[np.repeat(end - drop, drop) + np.arange(drop.sum()) - np.repeat(np.cumsum(drop) - drop, drop)] = False
    return _mixed(h[inside]), np.repeat(np.arange(len(lines)), count)


def band_keys(lines: list[str], n: int = SHINGLE, rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    """[line, band]: a 64-bit key of each band of each line's signature."""
    bins = rows * bands
    if not len(lines):
        return np.empty((0, bands), np.int64)
    if len(lines) > _LINES:  # parts that stay in a processor's cache
        return np.concatenate([band_keys(lines[i : i + _LINES], n, rows, bands) for i in range(0, len(lines), _LINES)])
    h, line = _hashed(lines, n)
    # the upper half says which bin, the lower half is the value there
    slot = line * bins + ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    value = np.full(len(lines) * bins, np.uint64(1 << 32))
    np.minimum.at(value, slot, h & np.uint64(0xFFFFFFFF))
    value = value.reshape(-1, bins)
    empty = value == np.uint64(1 << 32)
    # empty bins: the next filled bin round the circle, and how far it is
    filled = np.where(empty, 4 * bins, np.arange(bins))
    ahead = np.minimum.accumulate(np.concatenate([filled, filled + bins], axis=1)[:, ::-1], axis=1)[:, ::-1][:, :bins]
    value = np.take_along_axis(value, ahead % bins, axis=1) + (ahead - np.arange(bins)).astype(np.uint64) * _MIX[0]
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(lines), bands)).copy()
    for r in range(rows):
        key = _mixed(key * _MIX[0] + value[:, r::rows][:, :bands])
    return key.view(np.int64)


def kinds_of(n: int = SHINGLE, short: int | None = None) -> tuple[Kind, ...]:
    """How lines are compared: all by shingles of ``n``; with ``short`` those of up to ``SHORT_TO`` by shingles of that, those from ``LONG_FROM`` on by ``n``."""
    return ((short, 0, SHORT_TO), (n, LONG_FROM, _ANY)) if short else ((n, 0, _ANY),)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text")


def line_table(docs: DataFrame, min_chars: int, kinds: tuple[Kind, ...]) -> DataFrame:
    """One row per row of ``docs``, of doc_id, h (xxhash64 of the text), ids and lines: content and line numbers of the normalised
    lines that take part; and, with a part, rows as of :func:`dealt` of the lines of ``min_chars`` or more."""
    parts = _parts(docs)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            own, ids, at = {}, [], []
            for t in b.column(2).to_pylist():
                found = lines_of(t) if t else []
                ids.append([content(x) for _, x in found])
                at.append([i for i, _ in found])
                own.update((k, x) for k, (_, x) in zip(ids[-1], found, strict=True) if len(x) >= min_chars)
            none = [pa.nulls(len(b), t) for _, t in _DEALT]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int64())), pa.array(at, pa.list_(pa.int32())), *none], names)
            for r in dealt(own, kinds, parts):
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(r), t) for t in (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()))), *r.columns], names)

    names = ["doc_id", "h", "ids", "lines", *(k for k, _ in _DEALT)]
    batches(docs.sparkSession, _BATCH)
    return _keyed(docs).mapInArrow(run, f"doc_id long, h long, ids array<long>, lines array<int>, {_DEALT_DDL}")


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt(own: dict[int, str], kinds: tuple[Kind, ...], parts: int) -> Iterator[pa.RecordBatch]:
    """The band keys of the lines ``own`` by content number: a row per part of the keys, with its keys (those of a part differ in 32 bits) and
    the line of each, packed as 32-bit and 64-bit integers. A part holds keys of one kind: its number's remainder by the number of kinds. ``sure``: lines past
    the first ``CAP`` + 1 of a key, which tell the others that its value is crowded; the rest needs no meeting.
    """
    for kind, (n, low, high) in enumerate(kinds):
        every = np.sort(np.fromiter((i for i, x in own.items() if low <= len(x) <= high), np.int64))
        for at in range(0, len(every), 10 * _BATCH):
            ids = every[at : at + 10 * _BATCH]
            keys = band_keys([own[i] for i in ids.tolist()], n).ravel().view(np.uint64)
            keys = ((keys >> np.uint64(32)) % np.uint64(parts) * np.uint64(len(kinds)) + np.uint64(kind) << np.uint64(32) | keys & np.uint64(_LOW)).view(np.int64)
            order = np.argsort(keys)
            keys, of = keys[order], np.repeat(ids, BANDS)[order]
            first, size = _runs(keys)
            sure = np.arange(len(keys)) - np.repeat(first, size) > CAP
            for crowded in (False, True):
                k, a = keys[sure == crowded], of[sure == crowded]
                start, _ = _runs(k >> 32)
                ends = np.append(start, len(k)).astype(np.int32)
                packed = (pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends * np.int32(x.itemsize)), pa.py_buffer(x)]) for x in ((k & _LOW).astype(np.uint32), a))
                yield pa.RecordBatch.from_arrays([pa.array((k[start] >> 32).astype(np.int32)), pa.array(np.full(len(start), crowded)), *packed], [c for c, _ in _DEALT])


def candidates(lines: DataFrame, n: int = SHINGLE, short: int | None = None) -> DataFrame:
    """What is to be compared of ``lines(id, text)``: pairs (a, b) of content numbers, a < b, without a key;
    and the lines a of each band value (key) of more than ``CAP`` different lines. Each row comes once for a kind of comparison.
    """
    kinds, parts = kinds_of(n, short), _parts(lines)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield from dealt(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), kinds, parts)

    batches(lines.sparkSession, 10 * _BATCH)
    return met(lines.select("id", "text").mapInArrow(run, _DEALT_DDL), len(kinds))


def met(rows: DataFrame, kinds: int) -> DataFrame:
    """key, a, b, kind: the candidates among rows of :func:`dealt`."""

    def meet(part: pa.Table) -> pa.Table:
        high = part.column("part")[0].as_py()
        key, a = (np.frombuffer(b"".join(part.column(c).to_pylist()), t) for c, t in (("key", np.uint32), ("a", np.int64)))
        order = np.argsort(key)
        key, a = key[order], a[order]
        # a key that comes once pairs nothing
        same = key[1:] == key[:-1]
        more = np.append(False, same) | np.append(same, False)
        key, a = key[more], a[more]
        order = np.lexsort((a, key))
        key, a = key[order], a[order]
        new = np.append(True, (key[1:] != key[:-1]) | (a[1:] != a[:-1]))[: len(key)]
        return _met(key[new].astype(np.int64) | high << 32, a[new], high % kinds)

    def spread(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for high, k, a in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key, of = np.frombuffer(k, np.uint32).astype(np.int64) | high << 32, np.frombuffer(a, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(of), pa.nulls(len(of), pa.int64()), pa.array(np.full(len(of), high % kinds, np.int32))], ["key", "a", "b", "kind"])

    near = rows.filter("NOT sure").select("part", "key", "a").groupBy("part").applyInArrow(meet, "key long, a long, b long, kind int")
    crowd = rows.filter("sure").select("part", "key", "a").mapInArrow(spread, "key long, a long, b long, kind int")
    return near.unionByName(crowd).distinct()


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal keys."""
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ 1)) if len(keys) else np.empty(0, np.int64)
    return first, np.diff(first, append=len(keys))


def _met(key: np.ndarray, a: np.ndarray, kind: int) -> pa.Table:
    """Pairs of the runs of up to ``CAP`` rows; the rows of longer ones with their keys."""
    size = np.repeat(s := _runs(key)[1], s)
    many = size > CAP
    crowd_key, crowd = key[many], a[many]
    key, a = key[~many], a[~many]
    x, y = [a[:0]], [a[:0]]
    for d in range(1, CAP):
        same = np.flatnonzero(key[d:] == key[:-d])
        if not len(same):
            break
        x.append(a[same])
        y.append(a[same + d])
    x, y = _once(np.concatenate(x), np.concatenate(y))
    none = np.append(np.ones(len(x), bool), np.zeros(len(crowd), bool))
    columns = [pa.array(np.append(np.zeros(len(x), np.int64), crowd_key), mask=none), pa.array(np.append(x, crowd)), pa.array(np.append(y, np.zeros(len(crowd), np.int64)), mask=~none)]
    return pa.table([*columns, pa.array(np.full(len(none), kind, np.int32))], ["key", "a", "b", "kind"])


def _once(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs, each with the smaller first."""
    x, y = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))[: len(x)]
    return x[new], y[new]


def forest(lines: list[str], block: np.ndarray, n: int = SHINGLE, threshold: float = THRESHOLD) -> tuple[list[int], list[int]]:
    """Places of pairs at the threshold that connect all ``lines`` which such pairs connect.

    With two blocks only pairs between them count. With shingles ordered from the rarest on,
    two lines at the threshold share one of their first ``size - threshold * size + 1``.
    """
    h, line = _hashed(lines, n)
    _, token, often = np.unique(h, return_inverse=True, return_counts=True)
    if len(lines) ** 2 * (shared := np.count_nonzero(often > 1)) <= _DENSE and len(lines) * shared <= BLOCK * _LINE:
        return _all_pairs(line, token, often > 1, block, threshold)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    flat = np.unique(line * len(often) + rank[token])
    line, token = np.divmod(flat, len(often))
    size = np.bincount(line, minlength=len(lines))
    start = np.cumsum(size) - size
    prefix = size - np.ceil(size * threshold - 1e-9).astype(np.int64) + 1
    root, held, mark = np.arange(len(lines)), {}, np.zeros(len(often), bool)
    between = len(lines) > 0 and block.min() != block.max()
    a, b = [], []
    for i in np.argsort(size, kind="stable").tolist():
        own = token[start[i] : start[i] + size[i]]
        first = own[: prefix[i]].tolist()
        found = np.fromiter(set().union(*(held.get(t, ()) for t in first)), np.int64)
        found = found[size[found] >= threshold * size[i]]
        if between:
            found = found[block[found] != block[i]]
        mark[own] = True
        while len(found := found[root[found] != root[i]]):
            j = found[-1]
            found = found[:-1]
            common = np.count_nonzero(mark[token[start[j] : start[j] + size[j]]])
            if common >= threshold * (size[i] + size[j] - common):
                root[root == root[j]] = root[i]
                a.append(i)
                b.append(int(j))
        mark[own] = False
        for t in first:
            held.setdefault(t, []).append(i)
    return a, b


def _all_pairs(line: np.ndarray, token: np.ndarray, shared: np.ndarray, block: np.ndarray, threshold: float) -> tuple[list[int], list[int]]:
    """:func:`forest` from the numbers of shingles that all pairs have in common; tokens that are not ``shared`` are in one line only."""
    flat = np.sort(line * len(shared) + token)
    flat = flat[np.append(True, flat[1:] != flat[:-1])[: len(flat)]]
    line, token = np.divmod(flat, len(shared))
    size = np.bincount(line, minlength=len(block))
    place, on = np.cumsum(shared) - 1, shared[token]
    has = np.zeros((len(block), np.count_nonzero(shared)), np.float32)
    has[line[on], place[token[on]]] = 1
    common = (has @ has.T).astype(np.int64)
    near = common >= threshold * (size[:, None] + size - common)
    if len(block) and block.min() != block.max():
        near &= block[:, None] != block
    near[np.arange(len(block)), np.arange(len(block))] = False
    new, a, b = near.any(axis=1), [], []
    for i in np.flatnonzero(new).tolist():
        reached = [i] if new[i] else []
        new[i] = False
        for x in reached:
            found = np.flatnonzero(near[x] & new)
            new[found] = False
            a += [x] * len(found)
            b += (found := found.tolist())
            reached += found
    return a, b


def _crowded(crowd: DataFrame, texts: DataFrame, kinds: tuple[Kind, ...], threshold: float, block: int) -> DataFrame:
    """Links (a, b) that connect the lines ``crowd(key, id, kind)`` of each key, by pairs of blocks of its lines."""

    def compare(cell: pa.Table) -> pa.Table:
        ids, n = cell.column("id").to_numpy(), kinds[cell.column("kind")[0].as_py()][0]
        a, b = forest(cell.column("line").to_pylist(), cell.column("block").to_numpy(), n, threshold)
        return pa.table(_once(ids[a], ids[b]) if a else (np.empty(0, np.int64),) * 2, ["a", "b"])

    sizes = crowd.join(texts.select("id", "kind", "n"), ["id", "kind"]).groupBy("key").agg(F.ceil(F.sum(F.col("n") + _LINE) / block).alias("blocks"))
    dealt = crowd.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("id", "key"), "blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    cells = dealt.select("key", "id", "kind", "block", other).join(texts.select("id", "kind", "line"), ["id", "kind"])
    return cells.groupBy("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).applyInArrow(compare, "a long, b long")


def _sizes(lines: list[str], n: int, each: int = 1) -> np.ndarray:
    """How many different shingles each line has, or every ``each`` lines have together."""
    out, at, end = [np.empty(0, np.int64)], 0, 0
    while at < len(lines):
        end, chars = at, 0
        while end < len(lines) and (end == at or end < at + each * _LINES and chars < _CHARS):
            chars += sum(map(len, lines[end : end + each]))
            end += each
        h, line = _hashed(lines[at:end], n)
        own = np.sort((line // each).astype(np.uint64) << np.uint64(57) | h >> np.uint64(7))
        out.append(np.bincount((own[np.append(True, own[1:] != own[:-1])] >> np.uint64(57)).astype(np.int64), minlength=(end - at) // each))
        at = end
    return np.concatenate(out)


def _bits(wanted: DataFrame, n: int) -> np.ndarray:
    """The bit map of ``n`` numbers ``wanted(id)``, by their upper bits: ``BITS_EACH`` bits each, ``MAX_BITS`` at most."""
    log = min(max(12, (BITS_EACH * n).bit_length()), MAX_BITS.bit_length() - 1)
    place = F.shiftrightunsigned("id", 64 - log)
    slot = wanted.select(F.shiftright(place, 6).cast("int").alias("slot"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(id, {64 - log}) & 63 AS int))").alias("bits"))
    t = slot.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()  # 2 ** log / 64 rows at most
    out = np.zeros(1 << log - 6, np.uint64)
    out[t.column("slot").to_numpy()] = t.column("bits").to_numpy().view(np.uint64)
    return out


def links(lines: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, block: int = BLOCK, short: int | None = None) -> DataFrame:
    """Pairs of ``lines(id, text)`` whose shingle sets have a Jaccard similarity of ``threshold`` or more.

    They connect all lines of a band value that such pairs connect; of lines so connected not each pair is named.
    With ``short`` lines are compared as :func:`kinds_of` says.
    """
    return _links(candidates(lines, n, short), lambda bits: lines.select("id", F.col("text").alias("line")), kinds_of(n, short), threshold, block)


def _links(found: DataFrame, read: Callable[[np.ndarray], DataFrame], kinds: tuple[Kind, ...], threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Links among the candidates ``found``. ``read`` gives (id, line) of the lines of a bit map of content numbers at least, repeats allowed."""

    def sized(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, own = b.column(0), b.column(1).to_pylist()
            for kind, (n, low, high) in enumerate(kinds):
                on = [i for i, x in enumerate(own) if low <= len(x) <= high]
                at = pa.array(on, pa.int64())
                yield pa.RecordBatch.from_arrays([ids.take(at), pa.array(np.full(len(on), kind, np.int32)), b.column(1).take(at), pa.array(_sizes([own[i] for i in on], n).astype(np.int32))], ["id", "kind", "line", "n"])

    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x, y, kind = (b.column(i).to_pylist() for i in (2, 3, 6))
            both, kind = [t for pair in zip(x, y, strict=True) for t in pair], np.array(kind, np.int64)
            union = np.empty(len(x), np.int64)
            for k, (n, _, _) in enumerate(kinds):
                on = np.flatnonzero(kind == k)
                union[on] = _sizes([t for i in on.tolist() for t in both[2 * i : 2 * i + 2]], n, 2)
            common = b.column(4).to_numpy().astype(np.int64) + b.column(5).to_numpy() - union
            on = pa.array(common >= threshold * union)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(on), b.column(1).filter(on)], ["a", "b"])

    found = pin(found, "line-pairs")
    wanted = pin(found.select(F.explode(F.array("a", "b")).alias("id")).filter("id IS NOT NULL").distinct(), "line-wanted")
    pairs = found.filter("key IS NULL").select("a", "b", "kind")
    crowd = found.filter("key IS NOT NULL").select("key", F.col("a").alias("id"), "kind")
    lines = read(_bits(wanted, wanted.count()))
    texts = lines.join(wanted, "id", "left_semi").groupBy("id").agg(F.min("line").alias("line"))
    batches(found.sparkSession, _BATCH)
    texts = pin(texts.mapInArrow(sized, "id long, kind int, line string, n int"), "line-texts")
    left, right = (texts.select(F.col("id").alias(i), "kind", F.col("line").alias(t), F.col("n").alias(k)) for i, t, k in (("a", "x", "m"), ("b", "y", "k")))
    # the numbers of shingles alone rule most pairs out
    likely = pairs.join(left, ["a", "kind"]).join(right, ["b", "kind"]).filter(F.least("m", "k") >= threshold * F.greatest("m", "k"))
    near = likely.select("a", "b", "x", "y", "m", "k", "kind").mapInArrow(verify, "a long, b long")
    return near.unionByName(_crowded(crowd, texts, kinds, threshold, block))


def _lines_in(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(id, line): the normalised lines of ``docs`` that the bit map lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            own = {content(x): x for t in b.column(0).to_pylist() if t for _, x in lines_of(t)}
            ids = np.fromiter(own, np.int64, len(own))
            ids = ids[probe(shared.value, ids.view(np.uint64))]
            for at in range(0, len(ids), _BATCH):
                some = ids[at : at + _BATCH]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([own[i] for i in some.tolist()], pa.string())], ["id", "line"])

    return docs.select("text").mapInArrow(run, "id long, line string")


def line_dedup(docs: DataFrame, threshold: float = THRESHOLD, min_chars: int = MIN_CHARS, short: int | None = None) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, removed (line numbers from 0, in order).

    With ``short`` lines are compared as :func:`kinds_of` says, else all by shingles of ``SHINGLE`` characters.
    ``docs`` is read twice: the texts of the lines that are compared are not kept but taken again.

    Of the lines of a component the occurrence of the smallest (doc_id, line number) stays,
    nulls last. ``n_lines`` counts the lines that take part, all that are not empty; those of
    fewer than ``min_chars`` characters are copies only of equal ones.
    Null and empty texts have none; repeated rows of one id and text count as one document
    and have the same result. An empty table gives no rows; other columns are ignored.
    """
    kinds = kinds_of(short=short)
    table = pin(line_table(docs, min_chars, kinds), "lines")
    seen = table.filter("part IS NULL").select("doc_id", "h", "ids", "lines")
    near = _links(met(table.filter("part IS NOT NULL"), len(kinds)), lambda bits: _lines_in(docs, bits), kinds, threshold)
    found = pin(components(near).withColumnsRenamed({"node": "id"}), "line-components")
    flat = seen.select("doc_id", "h", F.explode(F.arrays_zip("ids", "lines")).alias("r")).select("doc_id", "h", F.col("r.ids").alias("id"), F.col("r.lines").alias("line"))
    # a line that comes once and is linked to none stays
    often = flat.groupBy("id").agg(F.count("*").alias("n")).join(found, "id", "left").filter("n > 1 OR root IS NOT NULL").select("id", F.coalesce("root", "id").alias("root"))
    own = pin(flat.join(often, "id").select("doc_id", "h", "line", "root"), "line-copies")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "h", "line")
    first = own.groupBy("root").agg(F.min(place).alias("first"))
    gone = own.join(first, "root").filter(place > F.col("first")).groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("line")).alias("removed"))
    gone = gone.withColumnsRenamed({"doc_id": "_d", "h": "_h"})
    out = seen.select("doc_id", "h", F.size("lines").cast("long").alias("n_lines")).join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def without_lines(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """doc_id, text: the texts of ``docs`` without the lines that ``removed`` (from :func:`line_dedup`) lists."""
    gone = removed.select(F.col("doc_id").alias("_id"), "removed").distinct()
    kept = F.array_join(F.transform(F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: ~F.array_contains("removed", s.i)), lambda s: s.x), "\n")
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept).alias("text"))
