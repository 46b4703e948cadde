"""Conversation prefix trie: which first turns conversations share, and what sharing them saves.

A node is a sequence of first turns. A conversation is one row: the digests of its turns, 16
bytes each, one after the other, so that the conversations below a node lie side by side in
byte order. Splitters from a sample cut that order into shards. Only a node whose sequence
starts a splitter can have members in two shards; these nodes, the skeleton, form a small
trie that every task gets. A shard walks its sorted rows once, with the path to the current
row as its only state, finishes every other node and returns its share of the skeleton
nodes; shares are added up, and sums over the skeleton are differences of running sums in
the order of its nodes.

Copies of one conversation are ordered by conv_id and are split among shards as others are.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import WORD, pin

DIGEST = 16
#: Conversations of a shard, and the number of shards beyond which shards grow instead.
SHARD, MAX_SHARDS = 20_000, 8192
#: A splitter is cut after so many turns. With MAX_SHARDS this bounds the skeleton; what agrees in more turns stays in one shard.
SPLITTER_TURNS = 128
#: Sampled conversations for each splitter.
SAMPLED = 8
#: Ids of one row of ends.
_CHUNK = 8192
_FIRST = -(1 << 63)


def paths(turns: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """c, key (the digests of its turns), words (those of each turn): one row per rebuilt conversation.

    Turns are ordered by turn (null first), ties by role, then text; null role or text is
    empty. Conversation c takes the first crc32(c) mod ``heads`` turns of conversation
    c - c % ``every`` (the remainder has the sign of c, as in SQL) and its own turns after
    as many. Rows of null conv_id take no part.
    """
    t = turns.select(F.col("conv_id").cast("long").alias("c"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).filter("c is not null")
    place = F.row_number().over(Window.partitionBy("c").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    t = t.withColumn("i", place).select("c", F.struct("i", digest.alias("d"), F.regexp_count("text", F.lit(WORD)).alias("w")).alias("turn"))
    own = t.groupBy("c").agg(F.array_sort(F.collect_list("turn")).alias("own"))
    head = own.filter(F.col("c") % every == 0).select(F.col("c").alias("b"), F.slice("own", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("c").cast("string").cast("binary")) % heads).cast("int")
    both = own.withColumns({"b": F.col("c") - F.col("c") % every, "h": h}).join(head, "b", "left")
    start = F.when(F.col("head").isNull(), F.slice("own", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h")))
    path = F.concat(start, F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0))))
    both = both.select("c", path.alias("path"))
    return both.select("c", F.unhex(F.array_join(F.transform("path", lambda x: x.d), "")).alias("key"), F.transform("path", lambda x: x.w).alias("words"))


class Skeleton:
    """The trie of the splitters' turns. Nodes are numbered as a walk meets them: ``last[i]`` is the last one below i."""

    def __init__(self, splitters: list[tuple[bytes, int]]) -> None:
        self.splitters = sorted(set(splitters))
        self.child: dict[tuple[int, bytes], int] = {}
        self.parent, self.last = [-1], [0]
        for key, _ in self.splitters:
            at = 0
            for i in range(0, len(key), DIGEST):
                step = (at, key[i : i + DIGEST])
                if step not in self.child:
                    self.child[step] = len(self.parent)
                    self.parent.append(at)
                    self.last.append(0)
                at = self.child[step]
        for i in reversed(range(len(self.parent))):
            self.last[i] = max(self.last[i], i)
            if i:
                self.last[self.parent[i]] = max(self.last[self.parent[i]], self.last[i])

    def shard(self, key: bytes, c: int) -> int:
        return bisect_right(self.splitters, (key, c))


def splitters(rows: DataFrame, shards: int, n: int) -> list[tuple[bytes, int]]:
    """At most ``shards`` - 1 (key, c) that cut ``rows`` about evenly; the sample follows from the ids, so it is the same each time."""
    if shards < 2:
        return []
    share = min(1.0, SAMPLED * shards / n)
    cut = F.length("key") > SPLITTER_TURNS * DIGEST
    some = rows.filter(F.pmod(F.xxhash64("c", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)))
    # what is cut stands before all that starts with it
    found = some.select(F.substring("key", 1, SPLITTER_TURNS * DIGEST).alias("key"), F.when(cut, F.lit(_FIRST)).otherwise(F.col("c")).alias("c")).toArrow()
    keys = sorted(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True))
    return [(bytes(k), c) for k, c in (keys[len(keys) * i // shards] for i in range(1, shards) if keys)]


_OUT = (
    "kind int, idx int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    "words long, parent int, last int, ends string"
)
_FIELDS = [f.split() for f in _OUT.split(", ")]
_ARROW = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[t]) for n, t in _FIELDS])
#: What a row of the shards' output is.
FINISHED, SHARE, ENDS = 0, 1, 2


class _Node:
    __slots__ = ("idx", "words", "least", "n", "children", "leaves", "saved", "ends", "held")

    def __init__(self, idx: int, words: int) -> None:
        self.idx, self.words = idx, words
        self.least: int | None = None
        self.n = self.children = self.leaves = self.saved = 0
        self.ends: list[int] | hashlib._Hash | None = None  # ids, or their digest so far
        self.held: list[tuple] = []


class Walk:
    """Walks conversations in the order of (key, c). ``rows`` holds what is ready, for the caller to take.

    State: the open nodes from the root to the last conversation, and under each open node
    that is not of the skeleton its closed children, which wait for the node's least member.
    """

    def __init__(self, skeleton: Skeleton) -> None:
        self.skeleton, self.rows, self.last = skeleton, [], b""
        self.open = [_Node(0, 0)]

    def add(self, key: bytes, c: int, words: list[int]) -> None:
        depth = len(key) // DIGEST
        if key != self.last:
            same, most = 0, min(depth, len(self.open) - 1)
            while same < most and key[same * DIGEST : (same + 1) * DIGEST] == self.last[same * DIGEST : (same + 1) * DIGEST]:
                same += 1
            self.close(same + 1)
            for i in range(same, depth):
                up = self.open[-1].idx
                self.open.append(_Node(self.skeleton.child.get((up, key[i * DIGEST : (i + 1) * DIGEST]), -1) if up >= 0 else -1, words[i]))
            self.last = key
        end = self.open[-1]
        end.n += 1
        end.least = c if end.least is None else min(c, end.least)
        if end.idx < 0:
            if end.ends is None:
                end.ends = hashlib.sha256(b"%d" % c)
            else:
                end.ends.update(b",%d" % c)
        else:
            end.ends = end.ends or []
            end.ends.append(c)
            if len(end.ends) >= _CHUNK:
                self._ends(end)

    def _ends(self, node: _Node) -> None:
        self.rows.append((ENDS, node.idx, node.ends[0], *[None] * 10, ",".join(map(str, node.ends))))
        node.ends = None

    def close(self, depth: int) -> None:
        """Closes the open nodes from ``depth`` on (the root has 0)."""
        while len(self.open) > depth:
            node = self.open.pop()
            if node.least is None:
                continue  # a root without members
            at = len(self.open)
            up = self.open[-1] if self.open else None
            if node.idx < 0:
                node.leaves = node.leaves or 1
                node.saved += (node.n - 1) * node.words
                row = (FINISHED, None, node.least, at, None, node.n, node.children, node.leaves, node.saved, (node.ends or hashlib.sha256()).hexdigest(), None, None, None, None)
                self.rows += [(*r[:4], node.least, *r[5:]) for r in node.held]
                if up.idx < 0:
                    up.held.append(row)
                else:
                    self.rows.append((FINISHED, up.idx, *row[2:]))
                up.children += 1
            else:
                if node.ends:
                    self._ends(node)
                self.rows.append((SHARE, node.idx, node.least, at, None, node.n, node.children, node.leaves, node.saved, None, node.words, self.skeleton.parent[node.idx], self.skeleton.last[node.idx], None))
            if up:
                up.n += node.n
                up.least = node.least if up.least is None else min(up.least, node.least)
                up.leaves += node.leaves
                up.saved += node.saved


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)


def nodes(turns: DataFrame, every: int = 20, heads: int = 4, shards: int | None = None) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conv_id is the node's smallest member and parent_conv_id its parent's, null for the root,
    which has depth 0; members are the rebuilt conversations (``paths``) that start with the
    node's turns. n_leaves counts nodes without children in the subtree, the node itself
    included. saved_tokens adds (members - 1) times the words of the node's last turn over
    the subtree. ends_sha256 is of the ids that end here, ascending, joined by commas.

    Nulls, ties and repeated rows: as in ``paths``; a repeated turn is a further turn. An
    empty text counts as a turn of no words. An empty table, or one without conv_id, gives no
    rows. Other columns are ignored. A conversation is held as one record of about 20 bytes a
    turn. The ids that end at one node are hashed by one task, which reads them as a stream.
    """
    spark = turns.sparkSession
    rows = pin(paths(turns, every, heads), "paths")
    n = rows.count()
    if shards is None:
        shards = max(math.ceil(n / SHARD), min(n // 100, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    shards = min(max(shards, 1), MAX_SHARDS)
    skeleton = Skeleton(splitters(rows, shards, max(n, 1)))
    shared = spark.sparkContext.broadcast(skeleton)

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at = [shared.value.shard(k, c) for c, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *b.columns], ["shard", "c", "key", "words"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Walk(shared.value)
        for b in it:
            for c, key, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                walk.add(key, c, words)
                if len(walk.rows) >= 10_000:
                    yield _batch(walk.rows)
                    walk.rows = []
        walk.close(0)
        yield _batch(walk.rows)

    dealt = rows.mapInArrow(deal, "shard int, c long, key binary, words array<int>").repartitionById(shards, "shard")
    found = pin(dealt.sortWithinPartitions("key", "c").select("c", "key", "words").mapInArrow(run, _OUT), "nodes")
    bones = pin(_bones(found), "skeleton")
    at = bones.select(F.col("idx").alias("_idx"), F.col("conv_id").alias("_up"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    done = found.filter(F.col("kind") == FINISHED).join(at, F.col("idx") == F.col("_idx"), "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_up"))
    top = bones.join(at, F.col("parent") == F.col("_idx"), "left").withColumn("parent_conv_id", F.col("_up"))
    return done.select(out).unionByName(top.select(out))


def _bones(found: DataFrame) -> DataFrame:
    """The nodes of the skeleton from their shares; conv_id, parent (by number) and all figures."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx, state = None, None
        for b in it:
            ready = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i == idx:
                    state.update(b"," + text.encode())
                else:
                    if state:
                        ready.append((idx, state.hexdigest()))
                    idx, state = i, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in ready], pa.int32()), pa.array([r[1] for r in ready], pa.string())], ["_idx", "_sha"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([idx], pa.int32()), pa.array([state.hexdigest()], pa.string())], ["_idx", "_sha"])

    add = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    keep = [F.max(c).alias(c) for c in ("depth", "words", "parent", "last")]
    s = pin(found.filter(F.col("kind") == SHARE).groupBy("idx").agg(F.min("conv_id").alias("conv_id"), *add, *keep), "shares")
    sha = found.filter(F.col("kind") == ENDS).select("idx", "conv_id", "ends").repartition("idx").sortWithinPartitions("idx", "conv_id").select("idx", "ends").mapInArrow(run, "_idx int, _sha string")
    kids = s.groupBy(F.col("parent").alias("_idx")).agg(F.count("*").alias("_kids"))
    s = s.join(kids, F.col("idx") == F.col("_idx"), "left").drop("_idx").join(sha, F.col("idx") == F.col("_idx"), "left").drop("_idx")
    s = s.withColumn("n_children", F.col("n_children") + F.coalesce("_kids", F.lit(0))).withColumn("ends_sha256", F.coalesce("_sha", F.sha2(F.lit(""), 256)))
    s = s.withColumns({"_leaf": (F.col("n_children") == 0).cast("long"), "_own": (F.col("n_convs") - 1) * F.col("words")})
    upto = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)  # of the skeleton only, whose size is bounded
    s = pin(s.withColumns({"_leaves": F.sum("_leaf").over(upto), "_saved": F.sum("_own").over(upto)}), "running")
    end = s.select(F.col("idx").alias("_last"), F.col("_leaves").alias("_leaves2"), F.col("_saved").alias("_saved2"))
    s = s.join(end, F.col("last") == F.col("_last"))
    return s.withColumns({
        "n_leaves": F.col("n_leaves") + F.col("_leaf") + F.col("_leaves2") - F.col("_leaves"),
        "saved_tokens": F.col("saved_tokens") + F.col("_own") + F.col("_saved2") - F.col("_saved"),
    }).select("idx", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
