"""Collocations: phrases whose words occur together more often than their parts would make likely.

Phrases are counted level by level. Each task counts in a HAT-trie over word ids of its own:
a shallow trie by first words, below it hash containers, which burst into children by the
next word when they grow. When the trie holds too much, its largest subtrees are spilled
whole, as runs sorted by phrase; runs meet by prefix partition (first word and a bucket of
the second, so that a frequent first word is split) and are merged there by adding.

A phrase of k words can only be frequent if both phrases of k - 1 words in it are, so a
level leaves out at once what the level before rules out. Tasks know that level through a
bit map of its hashes, whose size has a bound; what passes wrongly is counted exactly and
goes by its count, so results don't depend on the map.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import batches, pin

#: Entries of a container before it bursts; of all containers of a task before subtrees are spilled; words a task numbers before it starts anew.
BURST, LIMIT, WORDS = 4096, 1_500_000, 1_000_000
#: Tokens handled at once.
STEP = 500_000
#: Bits of the map of a level for each of its phrases, and at most (64 MB).
BITS_EACH, MAX_BITS = 16, 1 << 29
#: Buckets of the second word in a prefix partition; and of the first choice of the best.
SPLIT, SALT = 32, 64
_BATCH = 1000
#: A byte that UTF-8 never has marks the end of a piece.
_END = b"\xff"
_PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", _END * 10 + b" ")
_RUN = "part long, lang string, phrase string, f long"


def tokens(texts: list[bytes]) -> list[bytes]:
    """The words of ``texts`` (UTF-8), A-Z lower-cased, with ``_END`` between pieces."""
    return _END.join(texts).lower().translate(_PIECES).replace(_END, b" " + _END + b" ").split()


def folded(hashes: list[np.ndarray]) -> np.ndarray:
    """One 64-bit hash from those of the words of a phrase, in order."""
    h = np.zeros(len(hashes[0]), np.uint64)
    for w in hashes:
        h = (h ^ w) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _seed(lang: str) -> int:
    return xxhash.xxh32_intdigest(lang)


class HatTrie:
    """Counts of sequences of ``order`` ids, packed into one integer of ``order`` fields of ``bits`` bits.

    The root's children go by first id (of order 1: the root is a container). A child is a
    container, a dict from the packed rest to its count, or after a burst a ``Branch``.
    """

    class Branch:
        __slots__ = ("children",)

        def __init__(self) -> None:
            self.children: dict[int, dict[int, int] | HatTrie.Branch] = {}

    def __init__(self, order: int, burst: int | None = None) -> None:
        self.order, self.bits, self.burst = order, 63 // order, burst or BURST
        self.root, self.size = HatTrie.Branch(), 0

    def add(self, grams: np.ndarray, counts: np.ndarray) -> None:
        """Adds different packed grams in ascending order."""
        if len(grams):
            self._split(self.root, grams, counts, self.order)

    def _split(self, branch: Branch, grams: np.ndarray, counts: np.ndarray, width: int) -> None:
        """Hands grams of ``width`` ids to the children of their first id (of order 1: to child 0)."""
        below = max(width - 1, 1)
        first = grams >> (self.bits * below)
        cuts = [0, *(np.flatnonzero(first[1:] != first[:-1]) + 1).tolist(), len(first)]
        heads, children = first[cuts[:-1]].tolist(), branch.children
        rest, n = (grams & ((1 << (self.bits * below)) - 1)).tolist(), counts.tolist()
        for head, a, z in zip(heads, cuts[:-1], cuts[1:], strict=True):
            at = children.get(head)
            if at is None:
                at = children[head] = dict(zip(rest[a:z], n[a:z], strict=True))
                self.size += z - a
            elif type(at) is dict:
                get, before = at.get, len(at)
                for i in range(a, z):
                    at[rest[i]] = get(rest[i], 0) + n[i]
                self.size += len(at) - before
            else:
                self._split(at, np.array(rest[a:z]), np.array(n[a:z]), below)
                continue
            if width > 2 and len(at) > self.burst:
                keys = np.fromiter(at.keys(), np.int64, len(at))
                by = np.argsort(keys)
                children[head] = HatTrie.Branch()
                self.size -= len(at)
                self._split(children[head], keys[by], np.fromiter(at.values(), np.int64, len(at))[by], below)

    def take(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Takes out whole subtrees of the root, the largest first, until ``most`` entries are left."""
        kids = self.root.children
        sizes = {k: _size(c) for k, c in kids.items()}
        keys: list[int] = []
        counts: list[int] = []
        prefixes: list[tuple[int, int]] = []  # and how many entries each is for
        for k in sorted(sizes, key=sizes.get, reverse=True):
            if self.size <= most:
                break
            self._gather(kids.pop(k), k, max(self.order - 1, 1), keys, counts, prefixes)
            self.size -= sizes[k]
        prefix, times = np.array(prefixes, np.int64).reshape(-1, 2).T
        return np.array(keys, np.int64) | np.repeat(prefix, times), np.array(counts, np.int64)

    def _gather(self, at: dict[int, int] | Branch, prefix: int, width: int, keys: list, counts: list, prefixes: list) -> None:
        if type(at) is dict:
            keys.extend(at.keys())
            counts.extend(at.values())
            prefixes.append((prefix << (self.bits * width), len(at)))
        else:
            for k, c in at.children.items():
                self._gather(c, prefix << self.bits | k, width - 1, keys, counts, prefixes)


def _size(at: dict[int, int] | HatTrie.Branch) -> int:
    return sum(map(_size, at.children.values())) if isinstance(at, HatTrie.Branch) else len(at)


class _Words(dict):
    """Word -> id in the order of appearance; 0 is the end of a piece."""

    def __init__(self) -> None:
        self[_END] = 0

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Counter:
    """The phrases of ``order`` words of one language, as a task counts them."""

    def __init__(self, lang: str, order: int, bits: np.ndarray | None) -> None:
        self.lang, self.order, self.bits = lang, order, bits
        self.clear()

    def clear(self) -> None:
        self.words, self.trie, self.hashes = _Words(), HatTrie(self.order), np.zeros(0, np.uint64)

    def full(self) -> bool:
        return len(self.words) + STEP + self.order >= 1 << self.trie.bits or len(self.words) > WORDS

    def add(self, words: list[bytes], starts: int) -> None:
        """Counts the phrases that begin at one of the first ``starts`` words."""
        k = self.order
        ids = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        n = min(starts, len(ids) - k + 1)
        if n <= 0:
            return
        good = ids > 0
        keep = np.logical_and.reduce([good[i : i + n] for i in range(k)])
        if k > 1:
            fits = self._known(ids, n + 1)
            keep &= fits[:-1] & fits[1:]
        packed = np.zeros(n, np.int64)
        for i in range(k):
            packed = (packed << self.trie.bits) | ids[i : i + n]
        grams, counts = np.unique(packed[keep], return_counts=True)
        self.trie.add(grams, counts)

    def _known(self, ids: np.ndarray, n: int) -> np.ndarray:
        """Whether the map of the level before has the phrases of ``order`` - 1 words at the first ``n`` places."""
        new = len(self.words) - len(self.hashes)
        if new:
            seed, words = _seed(self.lang), list(self.words)[-new:]
            self.hashes = np.concatenate([self.hashes, np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, new)])
        h = self.hashes[ids]
        return probe(self.bits, folded([h[i : i + n] for i in range(self.order - 1)]))

    def run(self, most: int) -> pa.RecordBatch:
        """The largest subtrees, until ``most`` entries are left, as a run sorted by phrase."""
        grams, counts = self.trie.take(most)
        words = list(self.words)
        rank = np.empty(len(words), np.int64)
        rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        mask, b = (1 << self.trie.bits) - 1, self.trie.bits
        at = [(grams >> (b * (self.order - 1 - i))) & mask for i in range(self.order)]
        by = np.lexsort([rank[a] for a in reversed(at)])
        at, known = [a[by] for a in at], pa.array(words, pa.binary())
        phrase = pc.binary_join_element_wise(*[known.take(pa.array(a)) for a in at], b" ") if self.order > 1 else known.take(pa.array(at[0]))
        h = np.fromiter((xxhash.xxh32_intdigest(w) for w in words), np.int64, len(words))
        part = h[at[0]] if self.order == 1 else h[at[0]] * SPLIT + h[at[1]] % SPLIT
        return pa.RecordBatch.from_arrays([pa.array(part), pa.array([self.lang], pa.string()).take(pa.array(np.zeros(len(by), np.int64))), phrase.cast(pa.string()), pa.array(counts[by])], ["part", "lang", "phrase", "f"])


def level(docs: DataFrame, order: int, bits: np.ndarray | None) -> DataFrame:
    """lang, phrase, f: the phrases of ``order`` words of ``docs(lang, text binary)`` that ``bits`` lets through."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bits)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[str, Counter] = {}
        for b in it:
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                c = at.setdefault(lang, Counter(lang, order, shared.value))
                words = tokens(own)
                for i in range(0, len(words), STEP):
                    if c.full():
                        yield c.run(0)
                        c.clear()
                    c.add(words[i : i + STEP + order - 1], STEP)
                    while sum(x.trie.size for x in at.values()) > LIMIT:
                        big = max(at.values(), key=lambda x: x.trie.size)
                        yield big.run(min(big.trie.size // 2, LIMIT // 4))
            while sum(len(x.words) for x in at.values()) > 2 * WORDS:  # many languages
                big = max(at.values(), key=lambda x: len(x.words))
                yield big.run(0)
                big.clear()
        for c in at.values():
            yield c.run(0)

    batches(spark, _BATCH)
    runs = docs.select("lang", "text").mapInArrow(run, _RUN)
    return runs.repartition("part").groupBy("part", "lang", "phrase").agg(F.sum("f").alias("f")).drop("part")


def probe(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    i = h >> np.uint64(64 - (len(bits) * 64 - 1).bit_length())
    return (bits[(i >> np.uint64(6)).astype(np.int64)] >> (i & np.uint64(63))) & np.uint64(1) == 1


def bit_map(phrases: DataFrame, n: int) -> np.ndarray:
    """The bit map of the hashes of ``phrases(lang, phrase)``: 64 bits a slot, ``BITS_EACH`` bits a phrase, ``MAX_BITS`` at most."""
    size = min(max(1 << (BITS_EACH * n - 1).bit_length(), 1 << 12), MAX_BITS) if n else 1 << 12
    shift = np.uint64(64 - (size - 1).bit_length())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            by: dict[str, list[list[bytes]]] = {}
            for lang, phrase in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(phrase.split(b" "))
            hashes = [folded([np.array([xxhash.xxh64_intdigest(w, _seed(lang)) for w in col], np.uint64) for col in zip(*rows, strict=True)]) for lang, rows in by.items()]
            i = np.unique(np.concatenate(hashes)) >> shift if hashes else np.empty(0, np.uint64)
            slot, bit = i >> np.uint64(6), np.uint64(1) << (i & np.uint64(63))
            starts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(i) else np.empty(0, np.int64)
            words = np.bitwise_or.reduceat(bit, starts) if len(i) else bit
            yield pa.RecordBatch.from_arrays([pa.array(slot[starts].astype(np.int32)), pa.array(words.view(np.int64))], ["slot", "bits"])

    found = phrases.select("lang", F.col("phrase").cast("binary").alias("phrase")).mapInArrow(run, "slot int, bits long")
    t = found.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()  # size / 64 rows at most
    out = np.zeros(size // 64, np.uint64)
    out[t.column(0).to_numpy()] = t.column(1).to_numpy().view(np.uint64)
    return out


def _first(phrase: str, a: Column, k: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), a, k), " ")


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    Texts are cut into pieces at ``.,;:!?`` and line ends, pieces into words at blanks; only
    A-Z is lower-cased. a counts a phrase of 2 to ``max_words`` words, at least ``min_count``
    times; l and r its parts at the cut of the lowest score floor(10^6 a^2 / (l r)), of equal
    ones the earliest; n the words of the language. A phrase inside a longer candidate of at
    least ``inside`` per cent of its count is left out. Rank: score, then a, descending, then
    the phrase's bytes. Counts are exact, and scores to 10^15 occurrences of a phrase.

    Null or empty text: no words. Null lang: ``und``. Repeated rows count again. An empty
    table gives no rows; other columns are ignored.
    """
    if max_words < 2:
        raise ValueError("a phrase has two words at least")
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    levels, total, bits = [], None, None
    for k in range(1, max_words + 1):
        found = level(docs, k, bits)
        if k == 1:
            found = pin(found, "words")
            total = found.groupBy("lang").agg(F.sum("f").alias("n"))
        found = pin(found.filter(F.col("f") >= min_count), "phrases")
        levels.append(found.withColumn("m", F.lit(k)))
        if k < max_words:
            bits = bit_map(found, found.count())
    parts, phrases = levels[0], levels[1]
    for x in levels[1:-1]:
        parts = parts.unionByName(x)
    for x in levels[2:]:
        phrases = phrases.unionByName(x)
    left, right = (parts.select("lang", F.col("phrase").alias(c), F.col("f").alias(f)) for c, f in (("_left", "l"), ("_right", "r")))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.withColumns({"_left": _first("phrase", F.lit(1), F.col("k")), "_right": _first("phrase", F.col("k") + 1, F.col("m") - F.col("k"))})
    cuts = cuts.join(left, ["lang", "_left"]).join(right, ["lang", "_right"]).withColumnRenamed("f", "a")
    whole = "cast({} as decimal(15, 0))"
    score = F.expr(f"(1000000 * ({whole.format('a')} * {whole.format('a')})) div ({whole.format('l')} * {whole.format('r')})")
    least = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # the largest count of a longer candidate that holds the phrase
    lengths = F.sequence(F.lit(2), F.col("m") - 1)
    inner = phrases.filter("m > 2").withColumn("k", F.explode(lengths)).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("k") + 1)))
    inner = inner.select("lang", _first("phrase", F.col("i"), F.col("k")).alias("phrase"), F.col("f").alias("_f")).groupBy("lang", "phrase").agg(F.max("_f").alias("_f"))
    kept = least.join(inner, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("_f") < inside * F.col("a"), F.lit(True)))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALT))).orderBy(*best)
    some = kept.withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
