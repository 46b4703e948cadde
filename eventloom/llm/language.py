"""Language identification by segmentation-marginalised unigrams.

A language is a probability for every piece of a fixed public vocabulary. A word's
probability is the sum over all ways to cut it into pieces of the product of their
probabilities: one forward pass over its characters. The pieces' probabilities are fitted
by expectation-maximisation with the matching backward pass.

Words are runs of letters in lower case with the word mark in front; pieces don't cross
words, so a text's probability is the product over its words, and a word that comes again
is looked up.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import batches, pin, remainder

#: Documents of each language that the model is fitted on, at most.
SAMPLE_DOCS = 1500
ROUNDS = 3
#: Probability mass shared by all pieces before any count; a character outside the vocabulary has OTHER.
SMOOTH = 0.05
OTHER = 1e-7
UNDETERMINED = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_MARK = "▁"
_HOLD = 200_000
_LONG = 32
_TOGETHER = 4096


def vocabulary(model_path: str) -> list[str]:
    """The letter pieces of a SentencePiece model file, with or without the word mark."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]
    return [x for x in pieces if x == _MARK or _LETTERS.fullmatch(x.removeprefix(_MARK)) and x == x.lower()]


class Lattice:
    """All segmentations of many words at once: a trie over the pieces, walked from every position."""

    def __init__(self, pieces: list[str]):
        node = {"": 0}
        for x in pieces:
            for k in range(1, len(x) + 1):
                node.setdefault(x[:k], len(node))
        step = sorted((node[x[:-1]] << 21 | ord(x[-1]), n) for x, n in node.items() if x)
        self.keys = np.array([k for k, _ in step], np.int64)
        self.child = np.array([n for _, n in step], np.int64)
        self.piece = np.full(len(node), -1, np.int64)
        self.piece[[node[x] for x in pieces]] = np.arange(len(pieces))
        self.depth = max(map(len, pieces), default=1)
        self.other = len(pieces)

    def cuts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """piece[length - 1, word, start] (-1: no such piece), and the words' lengths."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.zeros((len(words), int(n.max()) + 1), np.int64)
        codes[np.arange(codes.shape[1]) < n[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        found = np.full((min(self.depth, codes.shape[1]), *codes.shape), -1, np.int64)
        w, start = np.nonzero(codes)
        at = np.zeros(len(w), np.int64)
        for k in range(len(found)):
            key = at << 21 | codes[w, np.minimum(start + k, codes.shape[1] - 1)]
            slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            go = self.keys[slot] == key
            w, start, at = w[go], start[go], self.child[slot[go]]
            found[k, w, start] = self.piece[at]
        alone = (found[0] < 0) & (codes > 0)
        found[0][alone] = self.other
        return found, n

    def forward(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """log probability of every word (rows) under every language (columns of ``p``)."""
        out = np.empty((len(words), p.shape[1]))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for at in range(0, len(order), _TOGETHER):
            part = order[at : at + _TOGETHER]
            found, n = self.cuts([words[i] for i in part])
            out[part] = np.log(_forward(found, p)[n, np.arange(len(n))])
        return out

    def expected(self, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece in ``counts`` times ``words``, for one language."""
        total = np.zeros(len(p))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for at in range(0, len(order), _TOGETHER):
            part = order[at : at + _TOGETHER]
            found, n = self.cuts([words[i] for i in part])
            q = np.append(p, 0.0)
            alpha = _forward(found, p[:, None])[:, :, 0]
            back = np.zeros_like(alpha)
            back[n, np.arange(len(n))] = 1.0
            share = counts[part] / alpha[n, np.arange(len(n))]
            for i in range(len(alpha) - 2, -1, -1):
                for k in range(min(len(found), len(alpha) - 1 - i)):
                    back[i] += q[found[k, :, i]] * back[i + k + 1]
            for k in range(len(found)):
                for i in range(len(alpha) - 1 - k):
                    piece = found[k, :, i]
                    total += np.bincount(piece + 1, alpha[i] * q[piece] * back[i + k + 1] * share, len(p) + 1)[1:]
        return total


def _forward(found: np.ndarray, p: np.ndarray) -> np.ndarray:
    """alpha[position, word, language]; words are short enough for no product to underflow."""
    q = np.concatenate([p, np.zeros((1, p.shape[1]))])
    alpha = np.zeros((found.shape[2], found.shape[1], p.shape[1]))
    alpha[0] = 1.0
    for j in range(1, len(alpha)):
        for k in range(min(len(found), j)):
            piece = found[k, :, j - k - 1]
            some = np.flatnonzero(piece >= 0)
            alpha[j, some] += alpha[j - k - 1, some] * q[piece[some]]
    return alpha


def words_of(text: str) -> list[str]:
    """The words of a text. A run of letters of over 32 is cut there, so that no probability underflows."""
    found = _LETTERS.findall(text.lower())
    return [x for w in found for x in ([w] if len(w) <= _LONG else [w[i : i + _LONG] for i in range(0, len(w), _LONG)])]


def sample(docs: DataFrame, per_language: int = SAMPLE_DOCS, folds: int = 5) -> DataFrame:
    """lang, text of some ``per_language`` documents of each language, never more: those with the smallest digests.

    Only rows with a language, a text, and crc32 of the id not divisible by ``folds``. The
    digests that can be among the smallest follow from the language's number of documents,
    so the others are left out before anything is sent.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), folds) != 0)).select("doc_id", "lang", "text")
    counts = pin(known.groupBy("lang").agg(F.count("*").alias("n")), "language-counts").withColumnRenamed("lang", "_lang")
    digest = F.xxhash64(F.lit(5), "doc_id")
    share = (per_language + 6 * per_language**0.5 + 10) / F.col("n")
    near = known.join(counts, F.col("lang") == F.col("_lang")).filter(F.pmod(digest, F.lit(1 << 40)) < share * float(1 << 40))
    first = Window.partitionBy("lang").orderBy(F.pmod(digest, F.lit(1 << 40)), "doc_id", "text")
    return near.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= per_language).select("lang", "text")


def fit(labelled: DataFrame, model_path: str, rounds: int = ROUNDS) -> DataFrame:
    """lang, piece, p of the pieces met in ``labelled(lang, text)``, and one row with piece -1: p of any other.

    Words are counted in Spark; a language's distinct words, bounded by the sample, are
    fitted in one task each. Languages are fitted apart, so their sizes don't matter.
    """

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            seen: Counter = Counter()
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w, n in Counter(words_of(text)).items():
                    seen[lang, w] += n
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])

    def learn(key: tuple, t: pa.Table) -> pa.Table:
        pieces = vocabulary(model_path)
        lattice = Lattice(pieces)
        words, n = [_MARK + w for w in t.column("word").to_pylist()], t.column("n").to_numpy().astype(float)
        p = np.full(len(pieces) + 1, 1.0 / (len(pieces) + 1))
        p[-1] = OTHER
        for _ in range(rounds):
            use = lattice.expected(words, n, p)
            q = use[:-1] / max(use[:-1].sum(), 1e-300)
            p[:-1] = (1 - SMOOTH) * q + SMOOTH / len(pieces)
        keep = np.flatnonzero(p[:-1] > SMOOTH / len(pieces) * 1.0001)
        ids, ps = [-1, *keep.tolist()], [SMOOTH / len(pieces), *p[keep].tolist()]
        return pa.table({"lang": pa.array([key[0].as_py()] * len(ids), pa.string()), "piece": pa.array(ids, pa.int32()), "p": pa.array(ps, pa.float64())})

    counted = labelled.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return counted.groupBy("lang").applyInArrow(learn, "lang string, piece int, p double")


def predict(docs: DataFrame, model: DataFrame, model_path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score of every row of ``docs(doc_id, text)``, and the columns named in ``keep``.

    The score is the probability of the language given the text if all are as likely before;
    of equal ones the first in code point order wins. Null text, no letter, or a model of no
    language: ``und`` with score 0. The model, of at most (pieces of the vocabulary) rows a
    language, is collected and goes to the tasks with the function.
    """
    rows = model.orderBy("lang", "piece").toArrow()
    names = sorted(set(rows.column("lang").to_pylist()), key=lambda s: s.encode())
    pieces = vocabulary(model_path)
    table = np.zeros((len(pieces) + 1, len(names)))
    lang, piece, p = (rows.column(c).to_pylist() for c in ("lang", "piece", "p"))
    col = np.array([names.index(x) for x in lang], np.int64)
    piece, p = np.array(piece, np.int64), np.array(p, float)
    table[:, col[piece < 0]] = p[piece < 0]
    table[piece[piece >= 0], col[piece >= 0]] = p[piece >= 0]
    table[-1] = OTHER
    sent = docs.sparkSession.sparkContext.broadcast(table)
    batches(docs.sparkSession, 2000)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, probs = Lattice(vocabulary(model_path)), sent.value
        held: dict[str, int] = {}
        scores = np.zeros((0, len(names)))
        for b in it:
            if len(held) > _HOLD:
                held, scores = {}, np.zeros((0, len(names)))
            split = [words_of(t) if t else [] for t in b.column(1).to_pylist()] if names else [[]] * b.num_rows
            new = list({w for ws in split for w in ws if w not in held})
            held.update(zip(new, range(len(held), len(held) + len(new)), strict=True))
            scores = np.concatenate([scores, lattice.forward([_MARK + w for w in new], probs)])
            lengths = np.fromiter(map(len, split), np.int64, len(split))
            pred: list[str] = [UNDETERMINED] * len(split)
            sure = np.zeros(len(split))
            for d in np.flatnonzero(lengths):
                ids = np.fromiter(map(held.__getitem__, split[d]), np.int64, lengths[d])
                s = scores[ids].sum(axis=0)
                best = int(s.argmax())
                pred[d] = names[best]
                sure[d] = 1.0 / np.exp(s - s[best]).sum()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(sure), *b.columns[2:]], ["doc_id", "lang_pred", "score", *keep])

    given = docs.select(F.col("doc_id").cast("long"), "text", *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)])
    out = "doc_id long, lang_pred string, score double" + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return given.mapInArrow(run, out)


def identify(docs: DataFrame, model_path: str, per_language: int = SAMPLE_DOCS, folds: int = 5) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score; learns from ``docs`` what it predicts.

    Held out are the rows whose crc32 of the id is divisible by ``folds`` (false for a null
    id, from which nothing is learned either). Repeated rows are predicted one by one; an
    empty table gives no rows; other columns are ignored.
    """
    model = fit(sample(docs, per_language, folds), model_path)
    out = predict(docs, model, model_path)
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), folds) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def recognised(docs: DataFrame, model_path: str, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is told with a score of ``least`` or more; all columns kept."""
    clash = {"doc_id", "lang_pred", "score"} & set(docs.columns)
    kept = tuple(c for c in docs.columns if c != "doc_id")
    plain = docs.withColumnsRenamed({c: f"__{c}" for c in clash - {"doc_id"}})
    kept = tuple(f"__{c}" if c in clash else c for c in kept)
    told = predict(plain, fit(sample(docs), model_path), model_path, keep=kept)
    told = told.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).drop("lang_pred", "score")
    return told.withColumnsRenamed({f"__{c}": c for c in clash - {"doc_id"}}).select(*docs.columns)
