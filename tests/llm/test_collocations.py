"""Collocations against brute force, and the counting trie by itself."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from eventloom.llm import collocations as co
from tests.llm.conftest import SCHEMA


def brute(rows, most=3, least=10, inside=50, top=2000):
    counts, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, most + 1):
                counts[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            s, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if not any(100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items() if len(q) > len(p)):
                kept.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, le, r, n[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def spoken(seed, n=120):
    """Texts of few words and fixed phrases, with odd blanks, ends of pieces and languages."""
    r = random.Random(seed)
    words = ["New", "york", "CITY", "of", "the", "ünder", "Ü", "日本", "a\x1fb", "x\xa0y", "z ", "end", "up"]
    fixed = ["new york city", "as well as", "in spite of the", "Ü ber alles"]
    rows = []
    for i in range(n):
        t = "".join((r.choice(words) if r.random() < 0.7 else r.choice(fixed)) + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "? ! "]) for _ in range(r.randrange(60)))
        rows.append((i, t, r.choice(["en", "en", "en", "de", None, "und"]), "s", 1, 0.5, 9, "k"))
    return [*rows, (n, None, "en", "s", 1, 0.5, 9, "k"), (n + 1, "", None, None, None, None, None, None), rows[3], (n + 2, "well " * 3000 + "as well" * 2000, "en", "s", 1, 0.5, 1, "k")]


@pytest.mark.parametrize("most", [2, 3, 4])
def test_against_brute_force(spark, monkeypatch, most):
    rows = spoken(most)
    got = co.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), max_words=most)
    assert got.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), *((c, "bigint") for c in "alrn"), ("score", "bigint")]
    want = brute(rows, most)
    assert sorted(map(tuple, got.collect())) == want and len({w[0] for w in want}) == 3


def test_a_level_behind_a_full_map(spark, rows):
    """A map that lets everything through gives all phrases with their whole counts."""
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2).select(co.F.coalesce("lang", co.F.lit("und")).alias("lang"), co.F.coalesce("text", co.F.lit("")).cast("binary").alias("text"))
    every = np.full(64, -1, np.int64).view(np.uint64)  # lets everything through
    got = {(r.lang, r.phrase): r.f for r in co.level(docs, 3, every).collect()}
    words = defaultdict(Counter)
    for _, text, lang, *_ in rows:
        w = co.tokens([(text or "").encode()])
        words[lang or "und"].update(b" ".join(w[i : i + 3]).decode() for i in range(len(w) - 2) if co._END not in w[i : i + 3])
    assert got == {(lang, p): f for lang, c in words.items() for p, f in c.items()}


@pytest.mark.parametrize("order", [1, 2, 3])
def test_counter_in_slices(monkeypatch, order):
    """Slices, bursts, spilled subtrees and renumbered words add up to the plain counts."""
    monkeypatch.setattr(co, "STEP", 7)
    monkeypatch.setattr(co, "BURST", 4)
    monkeypatch.setattr(co, "WORDS", 20)
    r = random.Random(order)
    words = [r.choice([b"a", b"b", b"c", b"d", co._END, b"w%d" % r.randrange(40)]) for _ in range(900)]
    c, got = co.Counter("en", order, np.full(64, -1, np.int64).view(np.uint64)), Counter()

    def take(most):
        b = c.run(most)
        phrases = b.column(2).to_pylist()
        assert phrases == sorted(phrases) and len(phrases) == len(set(phrases))
        for p, f in zip(phrases, b.column(3).to_pylist(), strict=True):
            got[p] += f

    bursts = 0
    for i in range(0, len(words), co.STEP):
        if c.full():
            take(0)
            assert c.trie.size == 0
            c.clear()
        c.add(words[i : i + co.STEP + order - 1], co.STEP)
        bursts += any(isinstance(x, co.HatTrie.Branch) for x in c.trie.root.children.values())
        assert c.trie.size == sum(map(co._size, c.trie.root.children.values()))
        if c.trie.size > 30:
            before = c.trie.size
            take(15)
            assert c.trie.size <= 15 < before
    take(0)
    want = Counter(b" ".join(words[i : i + order]).decode() for i in range(len(words) - order + 1) if co._END not in words[i : i + order])
    assert got == want and (order < 3 or bursts)


def test_scores_past_64_bits(spark):
    a = 10**14 - 7
    x = spark.createDataFrame([(a, a + 1, a + 3)], "a long, l long, r long")
    whole = "cast({} as decimal(15, 0))"
    got = x.selectExpr(f"(1000000 * ({whole.format('a')} * {whole.format('a')})) div ({whole.format('l')} * {whole.format('r')}) s").first().s
    assert got == 10**6 * a * a // ((a + 1) * (a + 3))


def test_nothing_to_count(spark, none):
    assert co.collocations(none).collect() == []
    assert co.collocations(spark.createDataFrame([(1, None, None, None, None, None, None, None), (2, "", "en", "a", 0, 0.0, 0, "")], SCHEMA)).collect() == []
