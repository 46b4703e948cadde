"""Exact dedup, SimHash, line hashing, fuzzy lines and suffix arrays against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from eventloom import session
from eventloom.llm import common, exact_dedup, fuzzy_lines, repeats, simhash, units

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Sets:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


# --- exact ---------------------------------------------------------------------------------


@pytest.mark.parametrize("block,digest", [(4096, None), (7, None), (5, lambda: F.pmod(F.xxhash64("block"), F.lit(3))), (1 << 20, lambda: F.lit(1))])
def test_exact_dedup(odd, rows, block, digest):
    got = exact_dedup.exact_dedup(odd, block, digest and digest()).collect()
    table = odd.select("doc_id", "text").collect()
    assert len(got) == len(table)
    groups = defaultdict(list)
    for r in table:
        groups[r.text or ""].append(r.doc_id)
    sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = sha[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    for h, ids in sha.items():
        mine = [r for r in got if r.text_sha256 == h]
        assert sorted(str(r.doc_id) for r in mine) == sorted(map(str, ids)) and sum(r.kept for r in mine) == 1
        assert all(r.doc_id == r.keep_id for r in mine if r.kept)


def test_exact_dedup_edges(none, odd):
    assert exact_dedup.exact_dedup(none).collect() == []
    kept = exact_dedup.distinct_texts(odd)
    assert kept.columns == odd.columns
    texts = [r.text or "" for r in kept.collect()]
    assert Counter(texts) == Counter({r.text or "": 1 for r in odd.collect()})


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(64)] + [(5000, 5000 + i) for i in range(200)] + [(7, 7), (None, 3)]
    sets = Sets(range(6000))
    for a, b in edges:
        if a is not None:
            sets.join(a, b)
    got = {x.node: x.root for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {x: sets.find(x) for x in linked}
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- simhash -------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("tile", [4096, 5])
def test_near_duplicates(docs, rows, tile):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs, tile=tile).collect()}
    fps = {r[0]: brute_fingerprint(r[1]) for r in rows}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == fps and all(len(r.fingerprint) == 16 for r in got.values())
    sets = Sets(fps)
    for i in fps:
        for j in fps:
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                sets.join(i, j)
    assert {i: r.component_id for i, r in got.items()} == {i: sets.find(i) for i in fps}


def test_tiles_lose_no_link(spark):
    r = np.random.default_rng(2)
    base = r.integers(0, 2**63, 60, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *(base ^ np.uint64(sum(1 << int(b) for b in r.integers(0, 64, k))) for k in (1, 2, 3, 4, 5, 6))]))
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    sets = Sets(range(len(fps)))
    for i, j in zip(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4), strict=True):
        sets.join(int(i), int(j))
    found = common.components(simhash.links(simhash.tiles(table, 16))).collect()
    index = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    mine = Sets(range(len(fps)))
    for x in found:
        mine.join(index[x.node], index[x.root])
    assert [mine.find(i) for i in range(len(fps))] == [sets.find(i) for i in range(len(fps))]


def test_near_edges(none, odd):
    assert simhash.near_duplicates(none).collect() == []
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    kept = simhash.one_of_each(exact_dedup.distinct_texts(odd))
    assert kept.columns == odd.columns
    # two texts of one id are two components of that name
    assert len({r.component_id for r in got}) + 1 == kept.count()


# --- units of text -------------------------------------------------------------------------


@pytest.mark.parametrize("sentences", [True, False])
def test_line_hashing(docs, rows, sentences):
    got = {r.doc_id: r for r in units.substring_dedup(docs, sentences).collect()}
    seen = set()
    for r in rows:
        text, own = r[1], []
        n = 0
        pattern = r"[^\n.!?]+[.!?]*|[.!?]+" if sentences else r"[^\n]+"
        parts = [(m.span(), m.group().lower().split()) for m in re.finditer(pattern, text or "")]
        parts = [p for p in parts if p[1]]
        for k, (span, _) in enumerate(parts):
            a = k
            while a > 0 and sum(len(w) for _, w in parts[a : k + 1]) < units.MIN_WORDS:
                a -= 1
            if sum(len(w) for _, w in parts[a : k + 1]) >= units.MIN_WORDS:
                key = tuple(tuple(w) for _, w in parts[a : k + 1])
                n += 1
                if key in seen:
                    own.append(span)
                seen.add(key)
        g = got[r[0]]
        assert [(s.start, s.end) for s in g.spans] == own and g.n_removed == len(own) and g.n_units == n
        kept, at = [], 0
        for a, b in own:
            kept.append(text[at:a])
            at = b
        assert g.kept == (None if text is None else "".join(kept) + text[at:])
    assert len(got) == len(rows)


def test_line_hashing_edges(none, odd):
    assert units.substring_dedup(none).collect() == []
    got = units.substring_dedup(odd).collect()
    assert len(got) == odd.count()
    # a repeated row is one document: its first occurrence is not removed by its own copy
    assert len({(r.n_removed, r.kept) for r in got if r.doc_id == 0}) == 1


# --- fuzzy lines ---------------------------------------------------------------------------


def test_fuzzy_lines(spark):
    r = random.Random(5)
    words = [f"w{i}{'abcdefgh'[i % 8] * (i % 5)}" for i in range(400)]
    lines = [" ".join(r.choice(words) for _ in range(r.randrange(8, 25))) for _ in range(120)]
    near = [x.replace(" w", " v", 1) for x in lines[:60]] + [x + " tail" for x in lines[20:50]] + [x.upper() for x in lines[50:60]]
    pool = lines + near
    rows = [(i, "\n".join([*(r.choice(pool) for _ in range(4)), "short", ""])) for i in range(120)] + [(500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    number, shingles, places = {}, [], []
    for i, t in rows:
        for k, x in fuzzy_lines.lines_of(t or ""):
            if x not in number:
                number[x] = len(number)
                shingles.append({x[j : j + 9] for j in range(len(x) - 8)})
            places.append((i, k, number[x]))
    sets = Sets(range(len(number)))
    for a in range(len(shingles)):
        for b in range(a):
            if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                sets.join(a, b)
    first, expected = set(), defaultdict(list)
    for i, k, x in places:
        if sets.find(x) in first:
            expected[i].append(k)
        first.add(sets.find(x))
    got = {x.doc_id: x for x in fuzzy_lines.line_dedup(docs).collect()}
    assert len(got) == len(rows)
    mine = {(i, k) for i, x in got.items() for k in x.removed}
    wanted = {(i, k) for i, ks in expected.items() for k in ks}
    assert not mine - wanted and len(mine) >= 0.99 * len(wanted)
    assert all(x.n_removed == len(x.removed) for x in got.values())
    texts = {x.doc_id: x.text for x in fuzzy_lines.without_lines(docs, fuzzy_lines.line_dedup(docs)).collect()}
    for i, t in rows:
        assert texts[i] == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in got[i].removed))


def test_fuzzy_edges(none, odd):
    assert fuzzy_lines.line_dedup(none).collect() == []
    got = fuzzy_lines.line_dedup(odd).collect()
    assert len(got) == odd.count() and len({tuple(r.removed) for r in got if r.doc_id == 0}) == 1


def test_short_lines_count_when_equal(spark):
    texts = ["Menu\nA first text of its own, long enough.", "Another text, about nothing in particular.\n  MENU \n\nMenv", "\n \nmenu\nMenu"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.n_lines, x.removed) for x in fuzzy_lines.line_dedup(docs).collect()}
    assert got == {0: (2, []), 1: (3, [1]), 2: (2, [2, 3])}


def test_one_changed_letter_in_lines_of_any_length(spark, tmp_path):
    from eventloom.llm import queries

    r = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz    "
    own = lambda k: "x" + "".join(r.choice(letters) for _ in range(k - 2)).replace("  ", " q") + "y"
    lines = [own(k) for k in (*range(42, 140), *range(42, 140))]
    at = [r.randrange(8, len(x) - 8) for x in lines]
    near = [x[:i] + "é" + (x[i + 1 :] if k % 2 else x[i:]) for k, (x, i) in enumerate(zip(lines, at, strict=True))]
    rows = list(enumerate(lines)) + [(1000 + i, x) for i, x in enumerate(near)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x.n_removed for x in queries.op10_fuzzy_lines(spark, str(tmp_path)).collect()}
    assert sum(got[1000 + i] for i in range(len(near))) >= 0.97 * len(near)
    assert not any(got[i] for i in range(len(lines)))


def templated(seed, n):
    """Lines of one template, and for the first hundred a true neighbour far from them in digest order."""
    r = random.Random(seed)
    own = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(42))
    lines = [f"notice: this page is provided under the terms of the general licence of the site, and no warranty is given; {own()}" for _ in range(n)]
    return lines, [x[:-4] + own()[:4] for x in lines[:100]]


def joined(pairs, ids):
    sets = Sets(ids)
    for a, b in pairs:
        sets.join(a, b)
    return [sets.find(i) for i in ids]


@pytest.mark.parametrize("block", [200_000, 1_000_000])
def test_crowded_bands_lose_no_link(spark, block):
    lines, near = templated(8, 3000)
    ids = {x: fuzzy_lines.content(x) for x in lines + near}
    table = spark.createDataFrame([(i, x) for x, i in ids.items()], "id long, text string").repartition(5)
    met = fuzzy_lines.candidates(table).filter("key IS NOT NULL").groupBy("key").count()
    assert met.agg(F.max("count")).first()[0] > 500
    found = Sets(ids.values())
    for x in fuzzy_lines.links(table, block=block).collect():
        found.join(x.a, x.b)
    assert sum(found.find(ids[a]) == found.find(ids[b]) for a, b in zip(lines, near, strict=False)) >= 99
    assert sum(found.find(i) != i for i in ids.values()) <= 101


def test_forest_against_brute_force():
    r = random.Random(9)
    lines, near = templated(10, 60)
    pool = lines + near + [x[: r.randrange(90, len(x))] for x in lines[:30]] + ["a short one", "a short onf"]
    sets = [fuzzy_lines.shingles(x) for x in pool]
    blocks = np.arange(len(pool)) % 2
    for block in (np.zeros(len(pool), np.int64), blocks):
        wanted = [(i, j) for i in range(len(pool)) for j in range(i) if (not block.any() or block[i] != block[j]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        got = list(zip(*fuzzy_lines.forest(pool, block), strict=True))
        assert set(map(frozenset, got)) <= set(map(frozenset, wanted)) and len(wanted) > 30
        assert joined(got, range(len(pool))) == joined(wanted, range(len(pool)))


def test_blocks_by_rare_shingles_and_by_all_pairs_agree(monkeypatch):
    r = random.Random(14)
    lines, near = templated(15, 80)
    pool = lines + near + [x[: r.randrange(90, len(x))] for x in lines[:30]] + ["a", "abc"]
    for block in (np.zeros(len(pool), np.int64), np.arange(len(pool)) % 2):
        monkeypatch.setattr(fuzzy_lines, "_DENSE", 2_000_000_000)
        dense = list(zip(*fuzzy_lines.forest(pool, block), strict=True))
        monkeypatch.setattr(fuzzy_lines, "_DENSE", -1)
        rare = list(zip(*fuzzy_lines.forest(pool, block), strict=True))
        assert len(dense) == len(rare) > 10 and joined(dense, range(len(pool))) == joined(rare, range(len(pool)))


def test_numbers_of_shingles(monkeypatch):
    r = random.Random(16)
    lines = ["a", "ab", "aaaaaaaaaaaaaaaa", "x" * 3000] + ["".join(r.choice("abc é") for _ in range(r.randrange(1, 300))) for _ in range(600)]
    for chars in (1_000_000, 500):
        monkeypatch.setattr(fuzzy_lines, "_CHARS", chars)
        for n in (4, 9):
            sets = [fuzzy_lines.shingles(x, n) for x in lines]
            assert fuzzy_lines._sizes(lines, n).tolist() == [len(x) for x in sets]
            assert fuzzy_lines._sizes(lines, n, 2).tolist() == [len(x | y) for x, y in zip(sets[::2], sets[1::2], strict=True)]


def test_normal_lines():
    for x in ("", " ", "a", " A  b ", "a\tb", "a\u3000b\xa0", "a\x85", "ΟΔΟΣ", "İx", "a\u200bb", "two  spaces", "end ", "a b"):
        assert fuzzy_lines.normal(x) == " ".join(x.lower().split())


def test_texts_of_lines_without_neighbours_are_not_kept(spark, tmp_path, monkeypatch):
    """The texts of all lines were written to the shared folder, and shuffled to find the few that are compared."""
    r = random.Random(17)
    lines = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789 ") for _ in range(500)) for _ in range(1000)]
    docs = spark.createDataFrame([(i, "\n".join(lines[i : i + 10])) for i in range(0, 1000, 10)] + [(2000, lines[3][:-1] + "é")], "doc_id long, text string").repartition(2)
    monkeypatch.setattr(session, "shared_folder", lambda spark, name: f"{tmp_path}/{name}-{r.random()}")
    got = {x.doc_id: x.removed for x in fuzzy_lines.line_dedup(docs, short=4).collect()}
    assert got.pop(2000) == [0] and not any(got.values())
    kept = [f for f in tmp_path.rglob("*.parquet")]
    assert kept and sum(f.stat().st_size for f in kept) < 0.7 * sum(map(len, lines))


# --- suffix arrays -------------------------------------------------------------------------


def test_maximal_repeats():
    r = random.Random(3)
    for t in range(150):
        texts = [bytes(r.choice(b"ab" if t % 2 else b"abc") for _ in range(r.randrange(1, 36))) for _ in range(r.randrange(1, 5))]
        least = r.choice([2, 3, 5, 9])
        occ = defaultdict(list)
        for i, s in enumerate(texts):
            for a in range(len(s)):
                for b in range(a + least, len(s) + 1):
                    occ[s[a:b]].append((i, a))
        expected = {}
        for x, at in occ.items():
            left = {texts[i][a - 1] if a else (-1, i) for i, a in at}
            right = {texts[i][a + len(x)] if a + len(x) < len(texts[i]) else (-1, i) for i, a in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                expected[x] = at
        got = {texts[n[0]][o[0] : o[0] + size]: sorted(zip(n.tolist(), o.tolist(), strict=True)) for size, n, o in repeats.maximal_repeats(texts, least)}
        assert got == expected


def brute_removed(rows, least):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        hit = np.zeros(len(b), bool)
        for a in range(len(b) - least + 1):
            if b[a : a + least] in seen:
                hit[a : a + least] = True
            seen.add(b[a : a + least])
        out[i] = (len(b), int(hit.sum()), int((np.diff(hit.astype(int), prepend=0) == 1).sum()), bytes(np.frombuffer(b, np.uint8)[~hit]))
    return out


@pytest.mark.parametrize("least,gram,group", [(100, 32, 1024), (100, 32, 1), (24, 8, 3), (40, 32, 1024)])
def test_remove_repeats(docs, rows, least, gram, group):
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in repeats.remove_repeats(docs, least, gram, group).collect()}
    assert got == brute_removed([r[:2] for r in rows], least)


def test_long_texts_are_cut_without_loss(monkeypatch, rows):
    monkeypatch.setattr(repeats, "_BUFFER", 150)
    text = rows[3][1].encode() * 3
    seen = [(t, a) for pieces, t, at in repeats._pieces([text, b"x" * 20, text[:140]], 100) for _, t, a in zip(pieces, t, at, strict=True)]
    assert seen == [(0, a) for a in range(0, len(text) - 99, 150)] + [(2, 0)]


def test_remove_edges(none, odd):
    assert repeats.remove_repeats(none).collect() == []
    got = repeats.remove_repeats(odd).collect()
    assert len(got) == odd.count() and len({(r.n_removed, bytes(r.kept)) for r in got if r.doc_id == 0}) == 1
