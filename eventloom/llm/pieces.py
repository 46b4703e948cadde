"""SentencePiece encoding and decoding by vectorised merge rounds.

The words of many texts are encoded together. Their characters lie in one flat array of
symbols. In each round every word finds its best adjacent pair by a segmented minimum over
pair ranks and merges its leftmost occurrences at once; merged symbols are compacted, and
words without a pair leave. A word that comes again is looked up.

Merging all occurrences at once gives what merging them one by one gives, unless a merge
opens a pair that is as good or better; such a word merges only its leftmost pair in that
round. The library is used only to read the vocabulary.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import batches

_SPACE = "▁"
_NONE = np.int64(1 << 40)
_HOLD = 200_000
_LONG = 200
#: A word: blanks, then what is not blank (or blanks at the end). No piece has a blank after another character.
_WORDS = re.compile("▁*[^▁]+|▁+")
_REPLACEMENT = "\N{REPLACEMENT CHARACTER}"
_UNKNOWN = " ⁇ "


class Merges:
    """The vocabulary of one SentencePiece BPE model with byte fallback and no normalisation."""

    def __init__(self, model_path: str):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = p.get_piece_size()
        self.piece = [p.id_to_piece(i) for i in range(n)]
        self.end = p.eos_id()
        special = [p.is_control(i) or p.is_unknown(i) or p.is_byte(i) for i in range(n)]
        self.control = [p.is_control(i) for i in range(n)]
        self.unknown = p.unk_id()
        self.byte = [int(self.piece[i][3:5], 16) if p.is_byte(i) else -1 for i in range(n)]
        self.byte_id = {b: i for i, b in enumerate(self.byte) if b >= 0}
        known = {x: i for i, x in enumerate(self.piece) if not special[i]}
        if any(_SPACE in x.lstrip(_SPACE) for x in known) or p.encode("a  b ", out_type=str)[0] != "▁a":
            raise ValueError("this model joins words or changes blanks; words cannot be encoded apart")
        # characters that only occur inside longer pieces get numbers beyond the vocabulary
        inner = sorted({c for x in known for c in x} - set(known))
        self.symbol = known | {c: n + i for i, c in enumerate(inner)}
        self.text = {i: x for x, i in self.symbol.items()}
        # any other character has the number ``beyond`` plus its code point
        self.beyond = n + len(inner)
        self.of_code = np.arange(0x110000, dtype=np.int64) + self.beyond
        for c, i in self.symbol.items():
            if len(c) == 1:
                self.of_code[ord(c)] = i
        self.id_text = list(map(str, range(n)))
        self.shown = [None if special[i] else x.replace(_SPACE, " ") for i, x in enumerate(self.piece)]
        scores = sorted({p.get_score(i) for i in known.values()}, reverse=True)
        order = {s: r for r, s in enumerate(scores)}
        rank = {i: order[p.get_score(i)] for i in known.values()}
        pairs = sorted(
            (self.symbol[x[:k]] << 21 | self.symbol[x[k:]], rank[i], i)
            for x, i in known.items() for k in range(1, len(x)) if x[:k] in self.symbol and x[k:] in self.symbol
        )
        self.key, self.rank, self.merged = (np.array(c, np.int64) for c in zip(*pairs, strict=True))
        count = np.bincount(list(rank.values()), minlength=len(scores))
        #: ranks that several pieces share: merged one by one, from the left
        self.tied = count > 1

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair (_NONE where there is none)."""
        key = left << 21 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = (self.key[at] == key) & (left < self.beyond) & (right < self.beyond)
        return np.where(hit, self.rank[at], _NONE), self.merged[at]

    def encode(self, words: list[str]) -> list[list[int]]:
        """The ids of each word; the blank is ``▁``."""
        flat, cut = self.symbols(words)
        n = len(self.piece)
        return [[y for x in flat[a:b] for y in ((x,) if x < n else self._bytes(x))] for a, b in zip(cut, cut[1:], strict=False)]

    def _bytes(self, x: int) -> list[int]:
        return [self.byte_id[b] for b in (self.text[x] if x in self.text else chr(x - self.beyond)).encode()]

    def symbols(self, words: list[str]) -> tuple[list[int], list[int]]:
        """The merged symbols of all words, and where each word begins; what is no piece is still to be put as bytes."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.of_code[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        word = np.repeat(np.arange(len(words)), n)
        done_sym, done_word = [], []
        rank, merged = self._pairs(sym, word)
        while len(sym):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.minimum.reduceat(rank, first)
            length = np.diff(first, append=len(sym))
            on = best < _NONE
            if not on.all():
                out = np.repeat(~on, length)
                done_sym.append(sym[out])
                done_word.append(word[out])
                sym, word, rank, merged = sym[~out], word[~out], rank[~out], merged[~out]
                best, length = best[on], length[on]
                if not len(sym):
                    break
                first = np.cumsum(length) - length
            hit = rank == np.repeat(best, length)
            if (tied := np.flatnonzero(self.tied[best])).size:
                sym, word, rank, merged = self._fold(sym, word, first, length, tied)
                continue
            take = self._apart(hit)
            if not self._safe(sym, word, rank, merged, take, first, length, best):
                # in the words concerned only the leftmost
                alone = self._unsafe
                where = np.flatnonzero(take)
                lead = np.zeros(len(sym), bool)
                lead[where[np.flatnonzero(np.diff(word[where], prepend=-1))]] = True
                take = np.where(np.repeat(alone, length), take & lead, take)
            sym, word, rank, merged = self._merge(sym, word, rank, merged, take)
        if done_sym:
            sym, word = np.concatenate([*done_sym, sym]), np.concatenate([*done_word, word])
            order = np.argsort(word, kind="stable")
            sym, word = sym[order], word[order]
        return sym.tolist(), np.searchsorted(word, np.arange(len(words) + 1)).tolist()

    def _pairs(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of every symbol with the next one of its word."""
        rank, merged = np.full(len(sym), _NONE), np.zeros(len(sym), np.int64)
        same = np.flatnonzero(word[1:] == word[:-1])
        rank[same], merged[same] = self._ranks(sym[same], sym[same + 1])
        return rank, merged

    @staticmethod
    def _apart(hit: np.ndarray) -> np.ndarray:
        """Of runs of overlapping pairs every other one, from the left."""
        at = np.flatnonzero(hit)
        start = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        place = np.arange(len(at)) - np.repeat(start, np.diff(start, append=len(at)))
        out = np.zeros(len(hit), bool)
        out[at[place % 2 == 0]] = True
        return out

    def _safe(self, sym, word, rank, merged, take, first, length, best) -> bool:
        """Whether no merge opens a pair as good as the one merged; else ``_unsafe`` names the words."""
        at = np.flatnonzero(take)
        many = np.diff(np.searchsorted(at, np.append(first, len(sym)))) > 1
        at = at[np.repeat(many, length)[at]]
        if not len(at):
            return True
        of = np.repeat(np.arange(len(first)), length)
        new = merged[at]
        bad = np.zeros(len(first), bool)
        after = at + 2
        ok = after < len(sym)
        ok[ok] = word[after[ok]] == word[at[ok]]
        r, _ = self._ranks(new[ok], sym[after[ok]])
        bad[of[at[ok]][r <= best[of[at[ok]]]]] = True
        ok = at > 0
        ok[ok] = word[at[ok] - 1] == word[at[ok]]
        before = np.where(take[np.maximum(at - 2, 0)] & (at >= 2), merged[np.maximum(at - 2, 0)], sym[np.maximum(at - 1, 0)])
        r, _ = self._ranks(before[ok], new[ok])
        bad[of[at[ok]][r <= best[of[at[ok]]]]] = True
        self._unsafe = bad
        return not bad.any()

    def _merge(self, sym, word, rank, merged, take) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(take)
        sym[at] = merged[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        stale = take.copy()
        stale[np.maximum(at - 1, 0)] = True
        stale[np.maximum(at - 2, 0)] = True
        sym, word, rank, merged, stale = sym[keep], word[keep], rank[keep], merged[keep], stale[keep]
        look = np.flatnonzero(stale)
        rank[look] = _NONE
        look = look[look + 1 < len(sym)]
        look = look[word[look] == word[look + 1]]
        rank[look], merged[look] = self._ranks(sym[look], sym[look + 1])
        return sym, word, rank, merged

    def _fold(self, sym, word, first, length, tied) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words whose best rank several pieces share (runs of blanks): merged from the left, one by one.

        Such ranks are the last of all here, so nothing better can open up on the way.
        """
        parts, ids = [], []
        keep = np.ones(len(sym), bool)
        for w in tied.tolist():
            a, b = int(first[w]), int(first[w] + length[w])
            keep[a:b] = False
            done: list[int] = []
            for s in sym[a:b].tolist():
                done.append(s)
                while len(done) > 1 and (m := self.symbol.get(self.text.get(done[-2], "\0") + self.text.get(done[-1], "\0"))) is not None:
                    done[-2:] = [m]
            parts.append(np.array(done, np.int64))
            ids.append(np.full(len(done), word[a]))
        sym, word = np.concatenate([sym[keep], *parts]), np.concatenate([word[keep], *ids])
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
        return (sym, word, *self._pairs(sym, word))

    def decode(self, ids: list[int]) -> str:
        """The text of any list of ids: control ids are nothing, runs of bytes are UTF-8, the first blank goes."""
        out: list[str] = []
        run = bytearray()
        first = True
        for i in ids:
            if self.byte[i] >= 0:
                run.append(self.byte[i])
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run, first = bytearray(), False
            if self.control[i]:
                continue
            if i == self.unknown:
                out.append(_UNKNOWN)
            else:
                x = self.piece[i].replace(_SPACE, " ")
                out.append(x[1:] if first and x[:1] == " " else x)
            first = False
        return "".join(out) + (_utf8(bytes(run)) if run else "")


def _utf8(run: bytes) -> str:
    """Bytes as text; a replacement character for each byte that is in no valid character."""
    return run.decode("utf-8", _EACH)


_EACH = "eventloom.each-byte"
codecs.register_error(_EACH, lambda e: (_REPLACEMENT, e.start + 1))


def words_of(text: str) -> list[str]:
    """The words of ``text`` as the model sees it, each without the blank it starts with.

    The model puts a blank in front of the text, so that every word starts with one.
    """
    if not text:
        return []
    if text[0] != " " and "  " not in text and _SPACE not in text:
        return text.split(" ")
    return [w[1:] for w in _WORDS.findall(_SPACE + text.replace(" ", _SPACE))]


class Coder:
    """Encodes and decodes batches of texts; distinct words are held, and dropped all at once when too many."""

    def __init__(self, model_path: str):
        self.merges = Merges(model_path)
        self.ids: dict[str, str] = {}
        self.back: dict[str, str] = {}

    def learn(self, words: list[str]) -> None:
        """Holds the ids of the words as decimal text, and the text decoded from the ids."""
        m = self.merges
        flat, cut = m.symbols([_SPACE + w for w in words])
        n = len(m.piece)
        for w, a, b in zip(words, cut, cut[1:], strict=False):
            own = flat[a:b]
            if max(own) < n:
                self.ids[w] = " ".join([m.id_text[x] for x in own])
                self.back[w] = "".join([m.shown[x] for x in own])
            else:
                ids = [y for x in own for y in ((x,) if x < n else m._bytes(x))]
                self.ids[w] = " ".join([m.id_text[x] for x in ids])
                # the first blank of all goes, so one more is put in front
                self.back[w] = m.decode([m.symbol[_SPACE], *ids])

    def batch(self, texts: list[str | None]) -> tuple[list[str], list[int], list[str]]:
        """The ids as decimal text, their number, and the text decoded from them."""
        if len(self.ids) > _HOLD:
            self.ids, self.back = {}, {}
        split = [words_of(t) if t else [] for t in texts]
        new = [w for w in set().union(*split) if w not in self.ids]
        for at in range(0, len(new), 20_000):
            self.learn(new[at : at + 20_000])
        end, ids, back = str(self.merges.end), self.ids.__getitem__, self.back.__getitem__
        joined = [" ".join([*map(ids, ws), end]) for ws in split]
        text = ["".join(map(back, ws)).removeprefix(" ") for ws in split]
        for w in [w for w in new if len(w) > _LONG]:
            del self.ids[w], self.back[w]
        return joined, [x.count(" ") + 1 for x in joined], text


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids (array of int, the end id last), decoded_sha256 of every row of ``docs(doc_id, text)``.

    Nulls, empty and long texts, repeated rows: see :func:`digests`.
    """
    batches(docs.sparkSession, 1000)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(model_path)
        for b in it:
            joined, counts, back = coder.batch(b.column(1).to_pylist())
            flat = np.fromstring(" ".join(joined), np.int32, sep=" ")
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), ids, _sha(back)], ["doc_id", "n_tokens", "ids", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")


def _sha(texts: list[str]) -> pa.Array:
    return pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts], pa.string())


def decode(coded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text of every row of ``coded(doc_id, ids)``; null ids: null."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Merges(model_path)
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else m.decode(x) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded with the end id, and decoded again.

    Null and empty texts are the end id alone and decode to the empty text. Long texts are
    encoded whole. Repeated rows are coded one by one; an empty table gives no rows; other
    columns are ignored.
    """
    batches(docs.sparkSession, 1000)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(model_path)
        for b in it:
            joined, counts, back = coder.batch(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), _sha(joined), _sha(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
