"""Language identification by unigram models of subword pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary (the file's path is a parameter; only its content is broadcast). Each
language has a probability for each piece. A word's probability is the sum over all ways to cut it into pieces, by the
forward algorithm, for many words and all languages at once in numpy; a text's is the product over its words. Piece
probabilities come from expectation maximisation (forward and backward) over the word counts of at most ``SAMPLE``
labelled documents, those with the least hash of their id.

Words are lower-cased, split at white space, and begin with the vocabulary's word mark. A character that the vocabulary
lacks is a piece of its own with the probability ``UNKNOWN``. Words of up to ``SHORT`` characters go through
arrays; longer ones are summed position by position, in training as in scoring, however long they are: each language's
sums are scaled for themselves, so that none underflows.

Defined results: null texts and those without words are ``und`` with confidence null and 0 words; ties go to the first
language by name; repeated rows repeat, and rows are judged each for itself, whatever their ids; very long texts and words are
scored whole, with finite scores; columns of other names don't matter; without any labelled row every text is ``und``; empty
tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, doc_rows, pick, slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLE = 1_500
ROUNDS = 3
UNKNOWN = 1e-8
SHORT = 48
MARK = "▁"
#: Scale of a character, so that the sums over ``SHORT`` of them stay within a float's range from UNKNOWN's power to 1.
_SCALE = 1e4
#: Sums below this are scaled up again.
_LOW = 1e-100
#: Words that are fitted at once.
_AT_ONCE = 5_000
_B = U(0x9E3779B97F4A7C15)


def pieces(path: str = VOCABULARY) -> list[str]:
    """The vocabulary's pieces in lower case, without control and byte pieces, each once."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = (i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)))
    return sorted({p for i in ids if (p := sp.id_to_piece(i)) == p.lower() and p.strip()})


class Lattice:
    """All pieces' occurrences in words: a table of the hashes of the pieces and of their beginnings."""

    def __init__(self, vocabulary: list[str]):
        self.n = len(vocabulary)
        self.depth = max(map(len, vocabulary), default=1)
        known: dict[int, int] = {}
        for k, p in enumerate(vocabulary):
            h = 0
            for c in p:
                h = (h * int(_B) + ord(c) + 1) & (2**64 - 1)
                known.setdefault(h, -1)
            known[h] = k
        keys = np.array(list(known), np.uint64)
        order = np.argsort(keys)
        self.keys, self.piece = keys[order], np.array(list(known.values()), np.int64)[order]

    def edges(self, text: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, piece) of all pieces in code points, given how many are left of each place's word."""
        at = np.arange(len(text))
        h = np.zeros(len(text), np.uint64)
        out = []
        for length in range(1, self.depth + 1):
            ok = room[at] >= length
            at, h = at[ok], h[ok]
            if not len(at):
                break
            h = h * _B + text[at + length - 1] + U(1)
            k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            ok = self.keys[k] == h if len(self.keys) else np.zeros(len(at), bool)
            if length == 1:
                lone = np.ones(len(text), bool)
                lone[at[ok]] = self.piece[k[ok]] < 0
                miss = np.flatnonzero(lone)
                out.append((miss, np.ones(len(miss), np.int64), np.full(len(miss), self.n)))
            at, h, k = at[ok], h[ok], k[ok]
            use = self.piece[k] >= 0
            out.append((at[use], np.full(int(use.sum()), length), self.piece[k[use]]))
        return tuple(np.concatenate([o[i] for o in out]) for i in range(3)) if out else (np.zeros(0, np.int64),) * 3


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, first place of each word and the end, places left of each place's word)."""
    raw = "".join(words).encode("utf-32-le", "surrogatepass")
    size = np.array([len(w) for w in words], np.int64)
    first = np.concatenate(([0], np.cumsum(size)))
    room = np.repeat(first[1:], size) - np.arange(first[-1])
    return np.frombuffer(raw, "<u4").astype(np.uint64), first, room


def _by_end(first: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of the edges by their end within the word, bounds of each end, word, start within the word)."""
    word = np.searchsorted(first, at, side="right") - 1
    start = at - first[word]
    end = start + length
    order = np.argsort(end, kind="stable")
    bounds = np.searchsorted(end[order], np.arange(int(end.max(initial=0)) + 2))
    return order, bounds, word, start


class Model:
    """Languages, a matrix of (pieces + 1) x languages with the unknown character last, and log priors."""

    def __init__(self, lattice: Lattice, langs: list[str], p: np.ndarray, prior: np.ndarray):
        self.lattice, self.langs, self.p, self.prior = lattice, langs, p, prior

    def words(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word in each language."""
        out = np.zeros((len(words), len(self.langs)))
        marked = [MARK + w for w in words]
        short = [i for i, w in enumerate(marked) if len(w) <= SHORT]
        if short:
            text, first, room = _points([marked[i] for i in short])
            at, length, piece = self.lattice.edges(text, room)
            order, bounds, word, start = _by_end(first, at, length)
            size = np.diff(first)
            a = np.zeros((len(short), SHORT + 1, len(self.langs)))
            a[:, 0] = 1.0
            for e in range(1, len(bounds) - 1):
                k = order[bounds[e] : bounds[e + 1]]
                k = k[np.argsort(word[k], kind="stable")]
                if not len(k):
                    continue
                terms = a[word[k], start[k]] * self.p[piece[k]] * (_SCALE ** length[k])[:, None]
                cut = np.flatnonzero(np.concatenate(([True], word[k][1:] != word[k][:-1])))
                a[word[k][cut], e] = np.add.reduceat(terms, cut, axis=0)
            whole = a[np.arange(len(short)), size]
            sure = (whole > 1e-290).all(axis=1)
            out[np.array(short)[sure]] = np.log(whole[sure]) - (size[sure] * math.log(_SCALE))[:, None]
            for i in np.array(short)[~sure].tolist():
                out[i] = self._long(marked[i])
        for i, w in enumerate(marked):
            if len(w) > SHORT:
                out[i] = self._long(w)
        return out

    def _long(self, word: str) -> np.ndarray:
        text, first, room = _points([word])
        at, length, piece = self.lattice.edges(text, room)
        order, bounds, _, start = _by_end(first, at, length)
        n, width = len(word), self.lattice.depth + 1
        a = np.zeros((width, len(self.langs)))  # the last positions' sums, each language's scaled by exp(-log)
        a[0] = 1.0
        log = np.zeros(len(self.langs))
        for e in range(1, n + 1):
            k = order[bounds[e] : bounds[e + 1]]
            v = (a[start[k] % width] * self.p[piece[k]]).sum(axis=0)
            a[e % width] = v
            low = v < _LOW
            if low.any():
                a[:, low] /= v[low]
                log[low] += np.log(v[low])
        return np.log(a[n % width]) + log


def _expected(lattice: Lattice, word: str, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, expected number) of a word of any length, by forward and backward sums in logarithms."""
    text, first, room = _points([word])
    at, length, piece = lattice.edges(text, room)
    order, bounds, _, start = _by_end(first, at, length)
    by_start = np.argsort(start, kind="stable")
    n, end, f = len(word), start + length, np.log(q[piece])
    cuts = np.searchsorted(start[by_start], np.arange(n + 1))
    a, b = np.zeros(n + 1), np.zeros(n + 1)

    def total(x: np.ndarray) -> float:
        top = x.max()
        return top + np.log(np.exp(x - top).sum())

    for e in range(1, n + 1):
        k = order[bounds[e] : bounds[e + 1]]
        a[e] = total(a[start[k]] + f[k])
    for s in range(n - 1, -1, -1):
        k = by_start[cuts[s] : cuts[s + 1]]
        b[s] = total(b[end[k]] + f[k])
    return piece, np.exp(a[start] + f + b[end] - a[n])


def _expected_of_all(lattice: Lattice, words: list[str], weight: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Expected numbers of all pieces in words of up to ``SHORT`` characters, each as often as its weight says."""
    text, first, room = _points(words)
    at, length, piece = lattice.edges(text, room)
    order, bounds, word, start = _by_end(first, at, length)
    end, size = start + length, np.diff(first)
    a, b = (np.zeros((len(words), SHORT + 2)) for _ in range(2))
    a[:, 0] = 1.0
    b[np.arange(len(words)), size] = 1.0
    f = q[piece] * _SCALE**length
    for e in range(1, len(bounds) - 1):
        k = order[bounds[e] : bounds[e + 1]]
        a[:, e] = np.bincount(word[k], weights=a[word[k], start[k]] * f[k], minlength=len(words))
    by_start = np.argsort(start, kind="stable")
    cuts = np.searchsorted(start[by_start], np.arange(int(start.max(initial=0)) + 2))
    for s in range(len(cuts) - 2, -1, -1):
        k = by_start[cuts[s] : cuts[s + 1]]
        b[:, s] += np.bincount(word[k], weights=b[word[k], end[k]] * f[k], minlength=len(words))
    whole = a[np.arange(len(words)), size]
    soft = a[word, start] * f * b[word, end] / np.maximum(whole, 1e-300)[word] * weight[word]
    return np.bincount(piece, weights=soft, minlength=lattice.n + 1)


def fit(counts: dict[str, dict[str, int]], vocabulary: list[str], rounds: int = ROUNDS) -> Model:
    """The model of each language's word counts, by expectation maximisation over all segmentations, some words at a time."""
    lattice, langs = Lattice(vocabulary), sorted(counts)
    n = lattice.n
    p = np.full((n + 1, len(langs)), UNKNOWN)
    totals = np.array([sum(counts[g].values()) for g in langs], np.float64)
    for g, lang in enumerate(langs):
        words = [MARK + w for w in counts[lang] if 0 < len(w) < SHORT]
        weight = np.array([c for w, c in counts[lang].items() if 0 < len(w) < SHORT], np.float64)
        longer = [(MARK + w, c) for w, c in counts[lang].items() if len(w) >= SHORT]
        q = np.full(n + 1, 1.0 / max(n, 1))
        for _ in range(rounds if words or longer else 0):
            q[n] = UNKNOWN
            c = np.full(n + 1, 0.01)
            for a in range(0, len(words), _AT_ONCE):
                c += _expected_of_all(lattice, words[a : a + _AT_ONCE], weight[a : a + _AT_ONCE], q)
            for w, times in longer:
                k, soft = _expected(lattice, w, q)
                c += np.bincount(k, weights=soft * times, minlength=n + 1)
            q = c / c[:n].sum()
        p[:n, g] = q[:n]
    return Model(lattice, langs, p, np.log(np.maximum(totals, 1) / max(totals.sum(), 1)))


def train(docs: DataFrame, vocabulary: str = VOCABULARY, sample: int = SAMPLE) -> Model:
    """``fit`` to at most ``sample`` documents that have a ``lang``."""
    rows = pick(docs, doc_id="long", text="string", lang="string").filter("doc_id is not null and lang is not null and lang <> ''")
    ids = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    texts = rows.filter("text is not null").join(F.broadcast(ids), "doc_id")
    counted = texts.select("lang", F.explode(F.split(F.lower("text"), "[ \\t\\n\\r\\f\\x0b]+")).alias("word")).filter("word <> ''").groupBy("lang", "word").count()
    counts: dict[str, dict[str, int]] = {}
    for lang, word, n in counted.collect():  # bounded by the sample
        counts.setdefault(lang, {})[word] = n
    return fit(counts, pieces(vocabulary))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, confidence, words): the likeliest language and its posterior probability."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        known: dict[str, int] = {}
        logs = np.zeros((0, len(m.langs)))
        for b in (s for whole in batches for s in slices(whole, 1)):
            column = b.column(1)
            words = pc.ascii_split_whitespace(pc.utf8_lower(column.fill_null("") if column.null_count else column))
            coded = words.flatten().dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            if len(known) > 300_000:
                known, logs = {}, logs[:0]
            new = [w for w in distinct if w not in known]
            for w in new:
                known[w] = len(known)
            if new and m.langs:
                logs = np.concatenate([logs, *(m.words(new[i : i + 20_000]) for i in range(0, len(new), 20_000))])
            empty = np.array([w == "" for w in distinct] + [True], bool)
            number = np.array([known[w] for w in distinct] + [0], np.int64)
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            off = words.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
            real = ~empty[codes]
            cum = np.concatenate(([0], np.cumsum(real)))
            off = cum[off - off[0]]
            codes = codes[real]
            n_words = np.diff(off)
            lang: list = ["und"] * b.num_rows
            conf: list = [None] * b.num_rows
            some = np.flatnonzero(n_words)
            if len(some) and m.langs:
                total = np.add.reduceat(logs[number[codes]], off[some], axis=0) + m.prior
                best = total.argmax(axis=1)
                post = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                for i, k, c in zip(some.tolist(), best.tolist(), post.tolist()):
                    lang[i], conf[i] = m.langs[k], round(c, 6)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang), pa.array(conf, pa.float64()), pa.array(n_words.astype(np.int32))], names=["doc_id", "lang", "confidence", "words"])

    return doc_rows(docs).mapInArrow(run, "doc_id long, lang string, confidence double, words int")


def detect(docs: DataFrame, vocabulary: str = VOCABULARY, sample: int = SAMPLE) -> DataFrame:
    """Each document's language by the model of the labelled ones."""
    return identify(docs, train(docs, vocabulary, sample))
