"""The conversation prefix trie against brute force over all prefixes."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from eventloom.llm import prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("c", T.StringType()), T.StructField("key", T.LongType()), T.StructField("idx", T.LongType()),
])


def brute(rows, every=20, heads=4):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    full = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        full[c] = tuple(own.get(c - int(math.fmod(c, every)), [])[:h] + ts[h:])
    members = defaultdict(list)
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members[full[c][:d]].append(c)
    out = []
    for p, cs in members.items():
        subtree = [q for q in members if q[: len(p)] == p]
        kids = [q for q in subtree if len(q) == len(p) + 1]
        leaves = [q for q in subtree if not any(len(z) == len(q) + 1 and z[: len(q)] == q for z in members)]
        saved = sum((len(members[q]) - 1) * len(WORD.findall(q[-1][1])) for q in subtree if q)
        ends = ",".join(str(c) for c in cs if len(full[c]) == len(p))
        out.append((cs[0], len(p), members[p[:-1]][0] if p else None, len(cs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def make(seed, n=70, most=6):
    r = random.Random(seed)
    say = ["", None, "a b", "a  b", "go\non", "x", "ü 日 x y", " "]
    rows = []
    for c in range(n):
        if r.random() < 0.08:
            continue
        for turn in range(r.randrange(1, most)):
            rows.append((c, r.choice([turn, turn, turn, None, 1]), r.choice(["user", "bot", None]), r.choice(say), "clash", 1, 2))
    copies = [(c, t, "user", f"same {t}", None, None, None) for c in range(200, 260) for t in range(4)]
    odd = [(None, 0, "user", "nobody", None, None, None), (-7, 0, "user", "below zero", "k", 0, 0), rows[0], rows[0], (400, 0, "user", "long " * 5000, "", 0, 0)]
    long = [(500 + k, t, "user", f"turn {t}" if t < 300 else f"{k} {t}", None, None, None) for k in range(3) for t in range(305)]
    return rows + copies + odd, long


@pytest.mark.parametrize(("seed", "shards"), [(1, 1), (2, 7), (3, 60), (4, None)])
def test_nodes_against_brute_force(spark, seed, shards):
    rows, _ = make(seed)
    got = prefix_trie.nodes(spark.createDataFrame(rows, SCHEMA).repartition(3), shards=shards)
    assert got.dtypes == [("conv_id", "bigint"), ("depth", "bigint"), ("parent_conv_id", "bigint"), ("n_convs", "bigint"), ("n_children", "bigint"), ("n_leaves", "bigint"), ("saved_tokens", "bigint"), ("ends_sha256", "string")]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_long_conversations_and_cut_splitters(spark, monkeypatch):
    rows, long = make(5, n=10)
    monkeypatch.setattr(prefix_trie, "SPLITTER_TURNS", 3)
    monkeypatch.setattr(prefix_trie, "_CHUNK", 7)
    got = prefix_trie.nodes(spark.createDataFrame(rows[-130:] + long, SCHEMA), shards=40)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows[-130:] + long)


def test_hot_nodes_are_shared_out(spark):
    """Copies of one conversation go to many shards, and all of their nodes are of the skeleton."""
    rows = [(c, t, "user", f"same {t}", None, None, None) for c in range(0, 4000, 20) for t in range(3)]
    p = prefix_trie.paths(spark.createDataFrame(rows, SCHEMA))
    cut = prefix_trie.Skeleton(prefix_trie.splitters(p, 10, p.count()))
    at = [cut.shard(r.key, r.c) for r in p.select("key", "c").collect()]
    assert len(set(at)) >= 9 and max(map(at.count, at)) <= 60
    assert len(cut.parent) == 4 and cut.last[0] == 3


def test_empty_tables(spark):
    assert prefix_trie.nodes(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefix_trie.nodes(spark.createDataFrame([(None, 1, "a", "b", None, None, None)], SCHEMA)).collect() == []


def test_turnless_members_end_at_the_root(spark):
    # conversation 23: h = crc32("23") % 4 turns of the absent conversation 20, then its own after as many
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "user", "only one", None, None, None)]
    got = prefix_trie.nodes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
