"""Language, language-model scores, pieces, mixing and top-k against brute force, exact round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from eventloom.llm import language, mixing, ngrams, pieces, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


# --- language ------------------------------------------------------------------------------


def test_forward_sums_all_segmentations(model):
    vocabulary = language.vocabulary(model)
    lattice, r = language.Lattice(vocabulary), np.random.default_rng(1)
    p = r.random((len(vocabulary) + 1, 3)) * 1e-3
    index = {x: i for i, x in enumerate(vocabulary)}

    def brute(w, col):
        if not w:
            return 1.0
        return sum(p[k, col] * brute(w[n:], col) for n in range(1, len(w) + 1) if (k := index.get(w[:n], lattice.other if n == 1 else None)) is not None)

    words = ["▁the", "▁ünder", "▁ß", "▁日本語x", "▁anwhhe", "▁"]
    got = lattice.forward(words, p)
    for w, row in zip(words, got, strict=True):
        assert row == pytest.approx([math.log(brute(w, c)) for c in range(3)], rel=1e-12)


def test_expected_uses(model):
    vocabulary = language.vocabulary(model)
    lattice = language.Lattice(vocabulary)
    p = np.random.default_rng(4).random(len(vocabulary) + 1) * 1e-3
    index = {x: i for i, x in enumerate(vocabulary)}

    def cuts(w):
        if not w:
            yield []
        for n in range(1, len(w) + 1):
            k = index.get(w[:n], lattice.other if n == 1 else None)
            if k is not None:
                for rest in cuts(w[n:]):
                    yield [k, *rest]

    expected = np.zeros(len(p))
    for w, n in (("▁there", 3.0), ("▁ßa", 2.0)):
        all_cuts = list(cuts(w))
        weight = [math.prod(p[k] for k in c) for c in all_cuts]
        for c, x in zip(all_cuts, weight, strict=True):
            for k in c:
                expected[k] += n * x / sum(weight)
    assert lattice.expected(["▁there", "▁ßa"], np.array([3.0, 2.0]), p) == pytest.approx(expected, rel=1e-9)


def test_language_on_held_out_documents(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in told if r.held_out]
    assert all(r.held_out == (crc(r.doc_id, 5) == 0) for r in told) and len(held) > 100
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in told)


def test_language_edges(docs, odd, none, model):
    got = {r.doc_id: r for r in language.identify(docs, model, per_language=20).collect()}
    for r in docs.collect():
        if not r.text or not any(c.isalpha() for c in r.text):
            assert got[r.doc_id].lang_pred == "und" and got[r.doc_id].score == 0
        else:
            assert got[r.doc_id].lang_pred in ("en", "de")
    assert language.identify(none, model).collect() == []
    assert language.identify(odd, model).count() == odd.count()
    kept = language.recognised(odd, model)
    assert kept.columns == odd.columns and kept.schema.simpleString() == odd.schema.simpleString()
    assert 0 < kept.count() < odd.count()
    # nothing to learn from
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", docs.lang.substr(1, 0)).filter("false").union(docs.limit(3)).replace({"en": None, "de": None}, subset=["lang"]), model).collect()} == {"und"}
    assert language.sample(docs, 5).groupBy("lang").count().filter("count > 5").count() == 0


# --- language model ------------------------------------------------------------------------


def tokens(t):
    return [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None]


def test_elias_fano():
    r = np.random.default_rng(1)
    for n, top in ((0, 10), (1, 5), (1000, 2**64 - 1), (5000, 20000), (3000, 2**32), (20000, 2**45)):
        v = np.sort(r.integers(0, top, n, dtype=np.uint64))
        e = ngrams.EliasFano(ngrams.EliasFano.build(v, top))
        assert (e.values() == v).all()
        x = r.integers(0, top, 2000, dtype=np.uint64)
        if n:
            i = r.integers(0, n, 2000)
            assert (e.at(i) == v[i]).all()
            x = np.append(x, v[i])
        at = np.searchsorted(v, x)
        expected = np.where((at < n) & (np.append(v, 0)[at] == x), at, -1)
        assert (e.find(x) == expected).all()


def test_trie():
    r = np.random.default_rng(2)
    keys = np.unique((r.integers(0, 300, 20000).astype(np.uint64) << np.uint64(32)) | r.integers(0, 2**32, 20000).astype(np.uint64))
    counts = r.integers(1, 5000, len(keys))
    trie = ngrams.Trie(ngrams.Trie.build(keys[::2], counts[::2]))
    got = trie.look_up(keys)
    assert (got[::2] > 0).all() and (got[1::2] == 0).all()
    assert np.abs(trie.book[got[::2] - 1] / counts[::2] - 1).max() < 0.02
    assert (trie.look_up(keys | np.uint64(1 << 62)) == 0).all()


@pytest.mark.parametrize("order,shard_bytes,block", [(2, 16_000_000, 3_000_000), (3, 3000, 500)])
def test_scores(docs, rows, monkeypatch, order, shard_bytes, block):
    monkeypatch.setattr(ngrams, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(ngrams, "BLOCK_TOKENS", block)
    got = {r.doc_id: r for r in ngrams.score(docs, order).collect()}
    counts = [Counter() for _ in range(order + 1)]
    texts = {r[0]: tokens(r[1]) for r in rows}
    for i, t in texts.items():
        if crc(i, 7) != 2:
            padded = ["<"] * (order - 1) + t
            for j in range(order - 1, len(padded)):
                for k in range(1, order + 1):
                    counts[k][tuple(padded[j - k + 1 : j + 1])] += 1
    n, v, ends = sum(counts[1].values()), len(counts[1]), counts[1][None,]
    assert set(got) == set(texts)
    for i, t in texts.items():
        base = sum(math.log10((counts[1][w,] + 1) / (n + v + 1)) for w in t)
        total, padded = 0.0, ["<"] * (order - 1) + t
        for j in range(order - 1, len(padded)):
            c = counts[1][padded[j],]
            p = (c - ngrams.DISCOUNT) / n if c else ngrams.DISCOUNT * v / n
            for k in range(2, order + 1):
                gram = tuple(padded[j - k + 1 : j + 1])
                u = ends if set(gram[:-1]) == {"<"} else counts[k - 1][gram[:-1]]
                p = (counts[k][gram] + ngrams.STRENGTH * p) / (max(u, counts[k][gram]) + ngrams.STRENGTH)
            total += math.log10(p)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(i, 7) == 2, len(t), sum(counts[1][w,] > 0 for w in t), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(total, rel=1e-9)


def test_production_order_has_two_words_of_context(docs):
    by = lambda d: {r.doc_id: r.score for r in d.collect()}
    default, two = by(ngrams.score(docs)), by(ngrams.score(docs, 2))
    assert default == by(ngrams.score(docs, 3)) and sum(default.values()) > sum(two.values())


def test_scores_edges(odd, none):
    assert ngrams.score(none).collect() == []
    got = ngrams.score(odd).collect()
    assert len(got) == odd.count() and all(not r.held_out for r in got if r.doc_id is None)
    only_held = odd.filter("crc32(cast(doc_id as string)) % 7 = 2")
    assert all(r.train_tokens == 0 and r.score == r.base_score for r in ngrams.score(only_held).collect())


# --- pieces --------------------------------------------------------------------------------


def awkward():
    r = random.Random(1)
    out = ["", " ", "  a", "a  b ", "a\tb\nc", "▁x", "</s> hi <s>", "\x00a", "ﬁ", "é", "a" * 57, "日本語日本", "<0x41>", "퟿", "a▁b", " " * 100, "x" + " " * 33 + "y" + " " * 3000, "▁▁ ▁", "ab" * 5000, "🙂🙂 x🙂"]
    out += ["".join(r.choice(a) for _ in range(r.randrange(60))) for a in ["ab ", "aeinrst", "  a▁", "abc é🙂日", "ththeinan. "] for _ in range(200)]
    return out + ["".join(r.choice(["the", "in", " ", "  ", "ing", "er", "tion", "▁", "\n", "<s>", "ß", "Ü", "​", "!!"]) for _ in range(r.randrange(40))) for _ in range(600)]


def test_pieces_are_the_librarys(model):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = awkward()
    coder = pieces.Coder(model)
    joined, counts, back = coder.batch(texts)
    for t, j, n, b in zip(texts, joined, counts, back, strict=True):
        ids = p.encode(t, add_eos=True)
        assert (j, n, b) == (" ".join(map(str, ids)), len(ids), p.decode(ids))
    words = [pieces._SPACE + w for t in texts[:200] for w in pieces.words_of(t)]
    assert [i for w in coder.merges.encode(words) for i in w] == [i for t in texts[:200] for i in p.encode(t)]


def test_decode_any_ids(model):
    import sentencepiece

    p, m, r = sentencepiece.SentencePieceProcessor(model_file=model), pieces.Merges(model), random.Random(2)
    for _ in range(4000):
        ids = [r.choice([r.randrange(32000), r.randrange(3, 259), r.choice([0, 1, 2, 28705, 259, 264])]) for _ in range(r.randrange(12))]
        assert m.decode(ids) == p.decode(ids)


def test_piece_tables(docs, rows, odd, none, model):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: r for r in pieces.digests(docs, model).collect()}
    coded = pieces.encode(docs, model)
    ids = {r.doc_id: r for r in coded.collect()}
    back = {r.doc_id: r.text for r in pieces.decode(coded, model).collect()}
    for r in rows:
        expected = p.encode(r[1] or "", add_eos=True)
        g = got[r[0]]
        assert (g.n_tokens, g.ids_sha256, g.decoded_sha256) == (len(expected), sha(" ".join(map(str, expected))), sha(p.decode(expected)))
        assert ids[r[0]].ids == expected and ids[r[0]].decoded_sha256 == g.decoded_sha256 and back[r[0]] == (r[1] or "")
    assert len(got) == len(rows)
    assert pieces.digests(odd, model).count() == odd.count() and pieces.digests(none, model).collect() == []


# --- mixing --------------------------------------------------------------------------------


def fill(sizes, weights, share, epochs):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), list(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = [s for s in open_ if level * w[s] > epochs * sizes[s]]
        for s in full or open_:
            target[s] = float(epochs * sizes[s]) if full else level * w[s]
        left -= sum(target[s] for s in full)
        open_ = [s for s in open_ if s in full and False or s not in target]
    return target


@pytest.mark.parametrize("weights,share", [((3, 1, 2), 1.5), ((1,), 0.3), ((1, 50), 1.9)])
def test_mix(odd, weights, share):
    table = odd.select("doc_id", "source", "text").collect()
    size = [len(WORD.findall(r.text or "")) for r in table]
    sources = defaultdict(int)
    for r, n in zip(table, size, strict=True):
        sources[r.source] += n
    got = mixing.mix(odd, weights, share).collect()
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((r.doc_id, r.source, n) for r, n in zip(table, size, strict=True))
    target, taken = fill(sources, weights, share, 2), defaultdict(int)
    for r in got:
        assert r.source_size == sources[r.source] and r.target == pytest.approx(target[r.source], rel=1e-9)
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sources)
    again = mixing.mix(odd.repartition(7), weights, share).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_schedule_spreads_sources(docs):
    sized = mixing.sizes(docs)
    targets = mixing.source_targets(sized)
    t = {r.sid: r.high - r.low for r in targets.collect()}
    slots = mixing.schedule(targets, 3000).collect()
    assert sorted(r.slot for r in slots) == list(range(3000))
    for sid, share in t.items():
        mine = sorted((r.slot, r["rank"]) for r in slots if r.sid == sid)
        assert [k for _, k in mine] == list(range(len(mine)))
        # at every moment the source is near its share
        assert all(abs(k - slot * share) <= 6 for slot, k in mine)


def test_mix_edges(none, odd, docs):
    assert mixing.mix(none).collect() == []
    assert {r.taken for r in mixing.mix(docs.filter("text is null or text = ''")).collect()} == {0}
    kept = mixing.mixed(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} <= {r.doc_id for r in odd.collect()}
    assert mixing.mixed(none).collect() == []
    with pytest.raises(ValueError):
        mixing.source_targets(mixing.sizes(docs), share=3.0)


# --- top-k ---------------------------------------------------------------------------------


def brute_top(rows, every, k):
    ok = [(i, [math.floor(1024 * float(c)) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = {}
    for q, a in ok:
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ok if i != q and len(a) == len(b))
            out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return out


@pytest.mark.parametrize("shard,block", [(8192, 1024), (40, 3)])
def test_top_k(spark, shard, block):
    r = np.random.default_rng(3)
    vectors = np.round(r.normal(size=(900, 8)) * r.random((900, 1)) + r.integers(0, 3, (900, 1)), 3)
    vectors[::9] = vectors[4]  # ties
    rows = [(int(i), [float(np.float32(c)) for c in v]) for i, v in enumerate(vectors)]
    rows += [(2000, None), (2100, [1.0, None] * 4), (2200, [float("nan")] * 8), (2300, [float("inf")] * 8), (None, [1.0] * 8), (2400, [1.0, 2.0]), (2401, [0.5, -3.0]), (2500, []), (2600, [0.0] * 8), (-100, [0.25] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = defaultdict(list)
    for x in topk.top_k(table, shard=shard, block=block).collect():
        got[x.query_id].append((x["rank"], x.vec_id, x.score))
    expected = {q: v for q, v in brute_top(rows, 100, 10).items() if v}
    assert {q: sorted(v) for q, v in got.items()} == expected


def test_top_k_edges(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>, score int")).collect() == []
    same = spark.createDataFrame([(i % 1200, [1.0, 2.0], i) for i in range(1300)], "vec_id long, embedding array<float>, score int")
    got = topk.top_k(same, k=3).collect()
    # rows of the query's own id are none of its candidates; repeated rows count one by one
    assert [(r["rank"], r.vec_id) for r in got if r.query_id == 0] == [(1, 1), (2, 1), (3, 2)]


def test_tree_skips_nodes(monkeypatch):
    r = np.random.default_rng(5)
    centres = r.integers(-4000, 4000, (20, 6))
    vectors = (centres[r.integers(0, 20, 4000)] + r.integers(-50, 50, (4000, 6))).astype(np.int64)
    tree, seen = topk.MTree(np.arange(4000), vectors, page=64), []
    plain = tree.plain

    class Counted(np.ndarray):
        def __getitem__(self, at):
            seen.append(len(at))
            return plain[at]

    tree.plain = plain.view(Counted)
    for q in range(20):
        seen.clear()
        got = tree.search(vectors[q], 5, q)
        scores = vectors @ vectors[q]
        assert got == [(int(s), int(i)) for s, i in sorted(((-scores[i], i) for i in range(4000) if i != q))[:5] for s in [-s]]
        assert sum(seen) < 2000


def test_elias_fano_selects_in_bulk_and_keeps_to_its_bits():
    """Many places at once are listed once and are those of the directory; lows take half bytes."""
    rng = np.random.default_rng(4)
    for n, top in ((0, 9), (1, 1 << 64), (5001, 1 << 20), (55_000, (1 << 64) // 22), (3000, 4000), (4096, 1 << 51)):
        x = np.sort(rng.integers(0, top - 1, n, np.uint64))
        blob = ngrams.EliasFano.build(x, top)
        few, many = ngrams.EliasFano(blob), ngrams.EliasFano(blob)
        assert (many.values() == x).all() and (many.at(np.arange(n)) == x).all()
        if n < 2:
            continue
        ask = np.concatenate([x, x + np.uint64(1), rng.integers(0, top - 1, 500, np.uint64)])
        part = np.arange(0, len(ask), 997)
        found = many.find(ask)
        assert many.listed and ((found >= 0) == np.isin(ask, x)).all() and (x[found[found >= 0]] == ask[found >= 0]).all()
        assert (few.find(ask[part]) == found[part]).all() and len(few.listed) == (len(part) >= len(few.words))
        # its entropy, one bit of unary each way, up to half a byte of rounding, and a word of ranks in 512 bits
        assert len(blob) * 8 <= n * (max(0, np.log2(top / n)) + 3.2) * 1.03 + 2000
