"""Language-model scoring with Elias-Fano n-gram tries.

The model is cut into shards by a digest of the n-gram, so that neither a frequent word nor a
frequent context makes one large. A shard of order k is a trie of two levels in Elias-Fano
form: the contexts in order with monotone pointers to where their successors begin, and the
successors, made monotone by the number of their context, with quantised probabilities. A
look-up finds the context, then searches its successors only, relative to it.

Documents are tokenised in blocks, kept as word numbers in a pinned table. A block asks each
shard once for every different n-gram that it holds; a shard sums the training counts in the
questions, builds its trie, maps it into memory and answers all blocks. So a word that is
everywhere costs one question per block, and no shard is sent to a document.

Probabilities are interpolated from order 1 up: p1(w) = (c(w) - D) / N, the mass D V / N
going to the class of unknown words; pk(w | u) = (c(u w) + M p(k-1)(w)) / (c(u) + M), with
counts of order 2 and above quantised: a trie stores counts, and scoring smooths them.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import batches, pin, remainder

ORDER = 3
DISCOUNT = 0.6
STRENGTH = 200.0
FOLDS, HELD_OUT = 7, 2
#: Tokens of a block, and bytes of text for each shard; they bound a task's memory.
BLOCK_TOKENS = 1_500_000
SHARD_BYTES = 8_000_000
_END, _BEGIN = np.uint64(1), np.uint64(2)
_HALF = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def unmixed(x: np.ndarray) -> np.ndarray:
    """The inverse of :func:`mixed`."""
    back = [np.uint64(pow(int(m), -1, 1 << 64)) for m in _MIX]
    x = (x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))) * back[2]
    x = (x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))) * back[1]
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


# --- Elias-Fano ----------------------------------------------------------------------------

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
#: [byte, r]: the place of its r-th set bit
_SELECT = np.array([[*np.flatnonzero(b), *[0] * (8 - int(b.sum()))] for b in _BITS], np.int64)
_CHUNK = 1 << 17


class EliasFano:
    """A non-decreasing sequence: low half bytes as they are, the rest in unary with a directory of ranks.

    A few places are selected through the directory; for as many as the sequence has words of
    unary, all places of a kind of bit are listed once.
    """

    def __init__(self, blob: memoryview | bytes):
        n, low, words = np.frombuffer(blob, np.int64, 3)
        self.n, self.bytes, self.half = int(n), int(low) // 2, int(low) % 2
        self.bits = np.uint64(4 * low)
        self.words = np.frombuffer(blob, np.uint64, words, 24)
        self.ones = np.frombuffer(blob, np.int64, words // 8 + 1, 24 + 8 * words)
        at = 24 + 8 * words + 8 * (words // 8 + 1)
        self.low = np.frombuffer(blob, np.uint8, self.n * self.bytes, at).reshape(self.n, self.bytes)
        self.halves = np.frombuffer(blob, np.uint8, (self.n + 1) // 2 * self.half, at + self.n * self.bytes)
        self.listed: dict[bool, np.ndarray] = {}
        self.zeros = np.arange(len(self.ones)) * 512 - self.ones

    @staticmethod
    def build(values: np.ndarray, top: int) -> bytes:
        """The sequence of uint64 ``values``, none above ``top``; 8-byte aligned."""
        n = len(values)
        low = min(range(0, 16), key=lambda b: n * 4 * b + min(top >> (4 * b), 1 << 62))
        high = (values >> np.uint64(4 * low)).astype(np.int64) + np.arange(n)
        size = n + (top >> (4 * low)) + 2
        bits = np.zeros(-(-size // 512) * 512, np.uint8)
        bits[high] = 1
        words = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.append(0, np.cumsum(np.bitwise_count(words).reshape(-1, 8).sum(axis=1, dtype=np.int64)))
        planes = np.ascontiguousarray(values).view(np.uint8).reshape(n, 8)
        rest = planes[:, : low // 2].tobytes()
        if low % 2:
            half = np.append(planes[:, low // 2] & 15, np.zeros(n % 2, np.uint8)).reshape(-1, 2)
            rest += (half[:, 0] | (half[:, 1] << 4)).astype(np.uint8).tobytes()
        out = np.array([n, low, len(words)], np.int64).tobytes() + words.tobytes() + ones.tobytes() + rest
        return out + bytes(-len(out) % 8)

    def values(self) -> np.ndarray:
        high = np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))[: self.n] - np.arange(self.n)
        return self._with_low(high.astype(np.uint64), np.arange(self.n))

    def at(self, i: np.ndarray) -> np.ndarray:
        return self._with_low((self._select(i, True) - i).astype(np.uint64), i)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(i), 8), np.uint8)
        wide[:, : self.bytes] = self.low[i]
        if self.half:
            wide[:, self.bytes] = (self.halves[i >> 1] >> ((i & 1) << 2).astype(np.uint8)) & 15
        return wide.view(np.uint64).ravel()

    def _with_low(self, high: np.ndarray, i: np.ndarray) -> np.ndarray:
        return (high << self.bits) | self._lows(i) if self.bits else high

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Place of the k-th (from 0) set or unset bit."""
        if one in self.listed or len(k) >= len(self.words):
            if one not in self.listed:
                bits = np.unpackbits(self.words.view(np.uint8), bitorder="little").view(bool)
                self.listed[one] = np.flatnonzero(bits if one else ~bits)
            return self.listed[one][k]
        out = np.empty(len(k), np.int64)
        ranks = self.ones if one else self.zeros
        for s in range(0, len(k), _CHUNK):
            part = k[s : s + _CHUNK]
            block = np.searchsorted(ranks, part, side="right") - 1
            words = self.words[(block * 8)[:, None] + np.arange(8)]
            words = words if one else ~words
            rank, row = part - ranks[block], np.arange(len(part))
            word, rank = _descend(np.bitwise_count(words), rank)
            byte, rank = _descend(np.bitwise_count(inside := words[row, word].view(np.uint8).reshape(-1, 8)), rank)
            out[s : s + _CHUNK] = block * 512 + word * 64 + byte * 8 + _SELECT[inside[row, byte], rank]
        return out

    def find(self, x: np.ndarray, first: np.ndarray | int = 0, last: np.ndarray | None = None) -> np.ndarray:
        """The place of each ``x`` between ``first`` and ``last``, or -1: the successor of x, if it is x."""
        if not self.n:
            return np.full(len(x), -1)
        high = (x >> self.bits).astype(np.int64)
        known = high <= int(self.zeros[-1]) - 1
        h = np.where(known, high, 0)
        a = np.where(h > 0, self._select(np.maximum(h - 1, 0), False) + 1 - h, 0)
        b = self._select(h, False) - h
        a, b = np.maximum(a, first), np.minimum(b, self.n if last is None else last)
        low = x & ((np.uint64(1) << self.bits) - np.uint64(1))
        end = b.copy()
        while (open_ := np.flatnonzero(a < b)).size:
            mid = (a[open_] + b[open_]) // 2
            less = self._lows(mid) < low[open_]
            a[open_[less]] = mid[less] + 1
            b[open_[~less]] = mid[~less]
        hit = known & (a < end)
        hit[hit] = self._lows(a[hit]) == low[hit]
        return np.where(hit, a, -1)


def _descend(count: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of eight holds the bit of that rank, and its rank there."""
    total = np.cumsum(count, axis=1, dtype=np.int64)
    at = (total <= rank[:, None]).sum(axis=1)
    return at, rank - np.where(at > 0, total[np.arange(len(at)), np.maximum(at - 1, 0)], 0)


# --- the trie of one shard -----------------------------------------------------------------


def quantised(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A code for each count and the codes' values: exact for up to 255 different counts, else even steps of the logarithm."""
    values = np.unique(counts)
    if len(values) > 255:
        values = np.exp(np.linspace(0.0, np.log(values[-1]), 255))
        edge = np.sqrt(values[1:] * values[:-1])
        return np.searchsorted(edge, counts).astype(np.uint8), values
    return np.searchsorted(values, counts).astype(np.uint8), values.astype(float)


class Trie:
    """Contexts, pointers, successors and probabilities of one shard, mapped into memory."""

    def __init__(self, blob: bytes):
        # the file has no name and goes with the task; nothing else reads it
        with tempfile.TemporaryFile() as f:
            f.write(blob)
            f.flush()
            self.map = mmap.mmap(f.fileno(), len(blob), access=mmap.ACCESS_READ)
        view = memoryview(self.map)
        sizes = np.frombuffer(view, np.int64, 5)
        cut = 40 + np.append(0, np.cumsum(sizes))
        part = [view[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        self.contexts, self.pointers, self.successors = (EliasFano(p) for p in part[:3])
        self.book, self.codes = np.frombuffer(part[3], float), np.frombuffer(part[4], np.uint8)

    @staticmethod
    def build(keys: np.ndarray, counts: np.ndarray, total: float = 1.0) -> bytes:
        """Sorted different ``keys`` (context digest, successor digest) with counts; the book holds counts over ``total``."""
        context, number = np.unique(keys >> _HALF, return_inverse=True)
        start = np.searchsorted(number, np.arange(len(context) + 1)).astype(np.uint64)
        codes, book = quantised(counts)
        parts = [
            EliasFano.build(context, 1 << 32), EliasFano.build(start, max(1, len(keys))),
            EliasFano.build((number.astype(np.uint64) << _HALF) | (keys & _LOW), max(1, len(context)) << 32),
            (book / total).tobytes(), codes.tobytes() + bytes(-len(codes) % 8),
        ]
        return np.array([*map(len, parts)], np.int64).tobytes() + b"".join(parts)

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """The code of each key plus one; 0 for a key that is not there."""
        at = np.full(len(keys), -1)
        if not len(self.codes):
            return np.zeros(len(keys), np.int64)
        context = self.contexts.find(keys >> _HALF)
        known = np.flatnonzero(context >= 0)
        if len(known):
            c = context[known]
            a, b = self.pointers.at(c).astype(np.int64), self.pointers.at(c + 1).astype(np.int64)
            at[known] = self.successors.find((c.astype(np.uint64) << _HALF) | (keys[known] & _LOW), a, b)
        return np.where(at >= 0, self.codes[at].astype(np.int64) + 1, 0)


# --- blocks of documents -------------------------------------------------------------------


def _pack(a: np.ndarray) -> bytes:
    """Integers by byte planes, compressed."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes(), 1)


def _unpack(blob: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(size, -1).T).view(dtype).ravel()


def gram_keys(words: np.ndarray, tokens: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """The key of the ``order``-gram that ends at each token; documents are preceded by begin marks."""
    h = words[tokens]
    if order == 1:
        return h
    place = np.arange(len(tokens)) - np.repeat(starts[:-1], np.diff(starts))
    context = np.zeros(len(tokens), np.uint64)
    for back in range(order - 1, 0, -1):
        before = np.roll(h, back)
        before[place < back] = _BEGIN
        context = mixed(context * _MIX[0] + before)
    return (context & ~_LOW) | (mixed(context * _MIX[2] + h) >> _HALF)


def _bounds(shards: int) -> list[int]:
    """Where each shard's stretch of the mixed keys begins, and the end of all."""
    return [-(-(s << 64) // shards) for s in range(shards)] + [1 << 64]


def _asked(words: np.ndarray, tokens: np.ndarray, starts: np.ndarray, order: int, bounds: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys of a block, mixed and in order, which of them each token has, and where each shard's begin."""
    keys, inverse = np.unique(mixed(gram_keys(words, tokens, starts, order)), return_inverse=True)
    return keys, inverse, np.append(np.searchsorted(keys, np.array(bounds[:-1], np.uint64)), len(keys))


_COLUMNS = "kind int, block long, shard int, a binary, b binary, c binary, n long, m long"
_TYPES = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
_NAMES = ["kind", "block", "shard", "a", "b", "c", "n", "m"]


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], names=_NAMES)


def blocks(docs: DataFrame, folds: int, held_out: int) -> DataFrame:
    """A row per block: its documents (a), the digests of its words (b) and its tokens (c)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 24
        own = _Block()
        for b in it:
            for doc, train, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                own.add(doc, train, text)
                if len(own.tokens) >= BLOCK_TOKENS:
                    yield from _table([own.row(block)]).to_batches()
                    own, block = _Block(), block + 1
        if own.docs:
            yield from _table([own.row(block)]).to_batches()

    batches(docs.sparkSession, 500)
    train = F.coalesce(remainder(F.col("doc_id"), folds) != held_out, F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), train.alias("train"), "text").mapInArrow(run, _COLUMNS)


class _Block:
    def __init__(self) -> None:
        from array import array

        self.docs: list[int | None] = []
        self.train: list[bool] = []
        self.starts = [0]
        self.tokens = array("i")
        self.number: dict[bytes, int] = {b"": 0}  # no word is empty: the end

    def add(self, doc: int | None, train: bool, text: str | None) -> None:
        self.docs.append(doc)
        self.train.append(train)
        if text:
            number = self.number
            ws = text.encode().lower().split()
            for w in set(ws):
                if w not in number:
                    number[w] = len(number)
            self.tokens.extend(map(number.__getitem__, ws))
        self.tokens.append(0)
        self.starts.append(len(self.tokens))

    def row(self, block: int) -> tuple:
        words = np.fromiter(map(xxhash.xxh3_64_intdigest, self.number), np.uint64, len(self.number))
        words[0] = _END
        tokens, starts = np.frombuffer(self.tokens, np.int32), np.array(self.starts)
        # frequent words first: small numbers pack well
        rank = np.argsort(-np.bincount(tokens, minlength=len(words)), kind="stable")
        place = np.empty(len(rank), np.int32)
        place[rank] = np.arange(len(rank), dtype=np.int32)
        null = np.array([d is None for d in self.docs])
        ids = np.array([d or 0 for d in self.docs], np.int64)
        head = np.concatenate([ids, np.diff(starts), np.array(self.train) + 2 * null])
        return 0, block, -1, _pack(head), _pack(words[rank]), _pack(place[tokens]), len(ids), 0


def _opened(n: int, a: bytes, b: bytes, c: bytes) -> tuple[np.ndarray, ...]:
    """ids, flags (1: learn from it, 2: no id), starts, words and tokens of a block."""
    head = _unpack(a, np.int64)
    return head[:n], head[2 * n :], np.append(0, np.cumsum(head[n : 2 * n])), _unpack(b, np.uint64), _unpack(c, np.int32)


def questions(kept: DataFrame, order: int, shards: int) -> DataFrame:
    """Rows of kind k: the keys (a) a block asks of one shard of order k, with their training counts (b)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = _bounds(shards)
        for batch in it:
            for block, a, b, c, n in zip(*(batch.column(i) for i in range(5)), strict=True):
                _, flags, starts, words, tokens = _opened(n.as_py(), a.as_py(), b.as_py(), c.as_py())
                train = np.repeat(flags % 2 == 1, np.diff(starts))
                for k in range(1, order + 1):
                    keys, inverse, cut = _asked(words, tokens, starts, k, bounds)
                    count = np.bincount(inverse[train], minlength=len(keys)).astype(np.uint32)
                    rows = []
                    for s in range(shards):
                        lo, hi = cut[s], cut[s + 1]
                        if lo < hi:
                            own = keys[lo:hi] - np.uint64(bounds[s])
                            rows.append((k, block.as_py(), s, EliasFano.build(own, bounds[s + 1] - bounds[s]), _pack(count[lo:hi]), None, int(hi - lo), 0))
                    yield from _table(rows).to_batches()

    batches(kept.sparkSession, 1)
    return kept.select("block", "a", "b", "c", "n").mapInArrow(run, _COLUMNS)


# --- shards --------------------------------------------------------------------------------


def answers(asked: DataFrame, shards: int) -> DataFrame:
    """One row per question: counts of order 1 as they are, above codes (a) and their book (b); and the sums of order 1 (kind -1).

    A shard sums the training counts of its keys, builds its trie, and looks up all that was asked.
    """

    def run(key: tuple, t: pa.Table) -> pa.Table:
        kind, shard = key[0].as_py(), key[1].as_py()
        base = np.uint64(_bounds(shards)[shard])
        lists = [EliasFano(x.as_buffer()).values() for x in t.column("a")]
        cut = np.append(0, np.cumsum([len(x) for x in lists]))
        ask = np.concatenate(lists) + base
        ask = ask if kind == 1 else unmixed(ask)
        count = np.concatenate([_unpack(x.as_py(), np.uint32) for x in t.column("b")]).astype(np.int64)
        keys, count = ask[count > 0], count[count > 0]
        order = np.argsort(keys, kind="stable")
        keys, count = keys[order], count[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
        keys, count = keys[first], np.add.reduceat(count, first) if len(first) else count
        blocks_, rows = t.column("block").to_pylist(), []
        if kind == 1:
            found = np.append(count, 0)[EliasFano(EliasFano.build(keys, (1 << 64) - 1)).find(ask)]
            rows, book = [(-1, -1, shard, None, None, None, int(count.sum()), len(count))], None
        else:
            trie = Trie(Trie.build(keys, count))
            found, book = trie.look_up(ask).astype(np.uint16), trie.book.tobytes()
        rows += [(kind, b, shard, _pack(found[lo:hi]), book, None, int(hi - lo), 0) for b, lo, hi in zip(blocks_, cut, cut[1:], strict=False)]
        return _table(rows)

    return asked.groupBy("kind", "shard").applyInArrow(run, _COLUMNS)


# --- scores --------------------------------------------------------------------------------


def score(docs: DataFrame, order: int = ORDER, discount: float = DISCOUNT, strength: float = STRENGTH, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose crc32 of the id mod ``folds`` is not ``held_out`` and scores
    all. Tokens are the words (A-Z lower-cased, cut at ASCII blanks) and one end, so a null
    or empty text has one token. Rows with a null id are scored, neither learned from nor
    held out. ``base_score`` is the add-one unigram; ``score`` the model's log10 probability.
    No training rows: counts are 0, and the score is the base. Repeated rows are learned from
    and scored one by one; an empty table gives no rows; other columns are ignored. n-grams
    are told apart by 64-bit digests.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-size // SHARD_BYTES))
    kept = pin(blocks(docs, folds, held_out), "lm-blocks")
    replies = pin(answers(questions(kept, order, shards), shards), "lm-answers")
    n, v = replies.filter("kind = -1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first()

    def run(key: tuple, own: pa.Table, replied: pa.Table) -> pa.Table:
        return _scored(own, replied, order, shards, n, v, discount, strength)

    left, right = (x.select("block", "kind", "shard", "a", "b", "c", "n") for x in (kept, replies.filter("kind > 0")))
    out = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"
    found = left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(run, out)
    is_held = F.coalesce(remainder(F.col("doc_id"), folds) == held_out, F.lit(False))
    return found.select("doc_id", is_held.alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def _scored(own: pa.Table, replied: pa.Table, order: int, shards: int, n: int, v: int, discount: float, strength: float) -> pa.Table:
    ids, flags, starts, words, tokens = _opened(*(own.column(c)[0].as_py() for c in "nabc"))
    bounds = _bounds(shards)
    reply: dict[tuple[int, int], tuple] = {}
    for kind, shard, a, b in zip(*(replied.column(c).to_pylist() for c in ("kind", "shard", "a", "b")), strict=True):
        reply[kind, shard] = (a, b)

    def read(k: int) -> np.ndarray:
        """The count of the k-gram at each token."""
        keys, inverse, cut = _asked(words, tokens, starts, k, bounds)
        count = np.zeros(len(keys))
        for s in range(shards):
            if cut[s] < cut[s + 1]:
                a, b = reply[k, s]
                count[cut[s] : cut[s + 1]] = _unpack(a, np.int64) if k == 1 else np.append(0.0, np.frombuffer(b, float))[_unpack(a, np.uint16)]
        return count[inverse]

    c = read(1)
    known = c > 0
    base = np.log10(c + 1) - np.log10(float(n + v + 1))
    first = np.zeros(len(tokens), bool)
    first[starts[:-1]] = True
    if n:
        p = np.where(c > 0, (c - discount) / n, discount * v / n)
        ends = c[starts[1:] - 1]  # as many as documents to learn from: the begin mark's count
        for k in range(2, order + 1):
            before = np.append(0.0, c[:-1])
            before[first] = ends
            c = read(k)
            p = (c + strength * p) / (np.maximum(before, c) + strength)
        log = np.log10(p)
    else:
        log = base
    total = lambda x: np.add.reduceat(x, starts[:-1])
    return pa.table({
        "doc_id": pa.array(ids, pa.int64(), mask=flags >= 2), "train": pa.array(flags % 2 == 1), "n_tokens": pa.array(np.diff(starts)), "n_known": pa.array(total(known.astype(np.int64))),
        "base_score": pa.array(total(base)), "score": pa.array(total(log)),
    })
