"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pre-tokens of many texts that aren't known yet are laid out as one sequence of linked symbols. An inverted
index holds, for the pairs of symbols that a merge joins, the positions where they stand; a heap gives the merges in rank
order. Each is applied to all of its positions at once, in numpy, and only the pairs with the touched neighbours are
indexed anew. Merges from which a pair of lower rank can come go one position of a pre-token at a time, so the result is
that of the merges in rank order, leftmost first, in each pre-token alone. Texts are then looked up in the pool of
encoded pre-tokens, and decoded by the inverse lookup of the tokens' bytes.

The vocabulary is a file of base64 tokens and ranks; its path is a parameter, and only its content is broadcast.

Defined results: a null text has null tokens and is in ``round_trip`` null; an empty text has an empty list; very long
texts are encoded whole; rows are encoded each for itself, whatever their ids, and repeated rows repeat; ties can't occur, as
ranks are distinct, and of equal pairs in a pre-token the leftmost is joined first; other columns don't matter; an empty
table gives an empty result. Decoding null tokens gives null, an id outside of the vocabulary or a null id raises ValueError.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import doc_rows, pick, slices, utf8_buffers

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Encoded pre-tokens that a task keeps, beyond which it starts afresh; bytes of text whose merges are replayed at once.
POOL = 600_000
REPLAY_BYTES = 32 << 20


def load(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def pair_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, tokens): all pairs of tokens, as left << 32 | right, that make a token."""
    rows = []
    for t, r in ranks.items():
        for i in range(1, len(t)):
            a = ranks.get(t[:i])
            if a is not None:
                b = ranks.get(t[i:])
                if b is not None:
                    rows.append((a << 32 | b, r))
    rows.sort()
    keys = np.array(rows, np.int64).reshape(-1, 2)
    return keys[:, 0].copy(), keys[:, 1].copy()


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, pairs: tuple[np.ndarray, np.ndarray] | None = None):
        self.split = regex.compile(pattern).findall
        token = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            token[r] = t
        self.keys, self.makes = pair_table(ranks) if pairs is None else pairs
        byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.byte = byte
        self.byte_pair = self._lookup((byte[:, None] << 32 | byte[None, :]).ravel())
        #: Tokens from which a pair of lower rank can come: their merges go one position of a pre-token at a time.
        self.early = np.zeros(len(token), bool)
        left, right = self.keys >> 32, self.keys & 0xFFFFFFFF
        self.early[left[self.makes < left]] = True
        self.early[right[self.makes < right]] = True
        sizes = np.array([len(t) for t in token], np.int64)
        self.t_off = np.concatenate(([0], np.cumsum(sizes)))
        self.t_raw = np.frombuffer(b"".join(token), np.uint8)
        self._fresh()

    def _fresh(self) -> None:
        self.known: dict[str, int] = {}
        self.off, self.pool = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _lookup(self, keys: np.ndarray) -> np.ndarray:
        """The token that each pair makes, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.makes[at], -1)

    def replay(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, tokens) of the words, all words' merges being applied together in rank order."""
        raws = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.array([len(x) for x in raws], np.int64)
        first = np.concatenate(([0], np.cumsum(sizes)))
        raw = np.frombuffer(b"".join(raws), np.uint8).astype(np.int64)
        size = len(raw)
        ids = self.byte[raw]
        after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
        some = sizes > 0
        after[first[1:][some] - 1] = -1
        before[first[:-1][some]] = -1
        word = np.repeat(np.arange(len(words)), sizes)
        left = np.flatnonzero(after >= 0)
        makes = self.byte_pair[raw[left] * 256 + raw[left + 1]]
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(makes: np.ndarray, places: np.ndarray) -> None:
            order = np.argsort(makes, kind="stable")
            m, q = makes[order], places[order]
            cuts = [0, *(np.flatnonzero(m[1:] != m[:-1]) + 1).tolist(), len(m)]
            for a, b in zip(cuts, cuts[1:]):
                r = int(m[a])
                if r in index:
                    index[r].append(q[a:b])
                else:
                    index[r] = [q[a:b]]
                    heapq.heappush(heap, r)

        def put(places: np.ndarray) -> None:
            """Indexes the pairs that begin at these places."""
            makes = self._lookup(ids[places] << 32 | ids[after[places]])
            on = makes >= 0
            if on.all():
                add(makes, places)
            elif on.any():
                add(makes[on], places[on])

        if (makes >= 0).any():
            add(makes[makes >= 0], left[makes >= 0])
        while heap:
            r = heapq.heappop(heap)
            parts = index.pop(r)
            p = np.unique(np.concatenate(parts))
            n = after[p]
            ok = (n >= 0) & (ids[p] >= 0)
            if not ok.all():
                p, n = p[ok], n[ok]
            ok = self._lookup(ids[p] << 32 | ids[n]) == r
            if not ok.all():
                p, n = p[ok], n[ok]
            if not len(p):
                continue
            if len(p) > 1:
                if self.early[r]:
                    use = np.ones(len(p), bool)
                    use[1:] = word[p[1:]] != word[p[:-1]]
                    if not use.all():
                        add(np.full(len(p) - int(use.sum()), r), p[~use])
                else:
                    # Of pairs that overlap the first is taken, the second isn't, and so on.
                    linked = np.concatenate(([False], n[:-1] == p[1:]))
                    use = None
                    if linked.any():
                        run = np.maximum.accumulate(np.where(linked, 0, np.arange(len(p))))
                        use = (np.arange(len(p)) - run) % 2 == 0
                if use is not None and not use.all():
                    p, n = p[use], n[use]
            ids[p] = r
            ids[n] = -1
            m = after[n]
            after[p] = m
            on = m >= 0
            right = p[on]
            before[m[on]] = right
            b = before[p]
            b = b[b >= 0]
            touched = np.concatenate((right, b))
            if len(touched):
                put(touched)
        alive = ids >= 0
        count = np.bincount(word[alive], minlength=len(words))
        return np.concatenate(([0], np.cumsum(count))), ids[alive].astype(np.int32)

    def number(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(pre-tokens of each text, their numbers); new ones are numbered, to be encoded by ``learn``."""
        known = self.known
        pieces = [self.split(t) if t else [] for t in texts]
        sizes = np.array([len(p) for p in pieces], np.int64)
        numbers = np.fromiter((known.setdefault(w, len(known)) for p in pieces for w in p), np.int32, int(sizes.sum()))
        return sizes, numbers

    def learn(self) -> None:
        """Encodes the pre-tokens that have been numbered since."""
        have = len(self.off) - 1
        new = list(islice(self.known, have, None))
        if new:
            off, tokens = self.replay(new)
            self.off = np.concatenate((self.off, off[1:] + self.off[-1]))
            self.pool = np.concatenate((self.pool, tokens))

    def tokens(self, sizes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, tokens) of numbered texts."""
        start = self.off[numbers]
        lengths = self.off[numbers + 1] - start
        cum = np.concatenate(([0], np.cumsum(lengths)))
        out = self.pool[np.arange(cum[-1]) + np.repeat(start - cum[:-1], lengths)]
        return cum[np.concatenate(([0], np.cumsum(sizes)))], out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, tokens) of the texts."""
        numbered = self.number(texts)
        self.learn()
        return self.tokens(*numbered)

    def decode(self, off: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, bytes) of the texts."""
        tokens = tokens.astype(np.int64)
        if len(tokens) and (tokens.min() < 0 or tokens.max() >= len(self.t_off) - 1):
            raise ValueError("a token id is outside of the vocabulary")
        lengths = self.t_off[tokens + 1] - self.t_off[tokens]
        cum = np.concatenate(([0], np.cumsum(lengths)))
        raw = self.t_raw[np.arange(cum[-1]) + np.repeat(self.t_off[tokens] - cum[:-1], lengths)]
        return cum[off], raw


def same_texts(off: np.ndarray, raw: np.ndarray, off2: np.ndarray, raw2: np.ndarray) -> np.ndarray:
    """Which texts of two batches are equal, byte for byte."""
    size = np.diff(off)
    same = size == np.diff(off2)
    if len(raw) == len(raw2) and same.all():
        wrong = np.flatnonzero(raw != raw2)
        same = np.ones(len(size), bool)
        same[np.searchsorted(off, wrong, side="right") - 1] = False
        return same
    return np.array([bool(s) and raw[a:b].tobytes() == raw2[c:d].tobytes() for s, a, b, c, d in zip(same, off, off[1:], off2, off2[1:])], bool)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, tokens, n_tokens, round_trip): the text's tokens, and whether decoding them gives the text back."""
    ranks = load(vocabulary)
    held = docs.sparkSession.sparkContext.broadcast((ranks, pair_table(ranks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, pairs = held.value
        codec = Codec(ranks, pattern, pairs)
        waiting: list = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            codec.learn()
            for b, numbered in waiting:
                off, tokens = codec.tokens(*numbered)
                ok = same_texts(*utf8_buffers(b.column(1)), *codec.decode(off, tokens))
                null = ~b.column(1).is_valid().to_numpy(zero_copy_only=False)
                starts = pa.array(off.astype(np.int32), mask=np.append(null, False))
                lists = pa.ListArray.from_arrays(starts, pa.array(tokens))
                yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(np.diff(off).astype(np.int32), mask=null), pa.array(ok, mask=null)], names=["doc_id", "tokens", "n_tokens", "round_trip"])
            waiting.clear()
            if len(codec.known) > POOL:
                codec._fresh()

        for b in (s for whole in batches for s in slices(whole, 1)):
            waiting.append((b, codec.number(b.column(1).to_pylist())))
            size += b.nbytes
            if size >= REPLAY_BYTES or len(codec.known) > POOL:
                yield from flush()
                size = 0
        yield from flush()

    return doc_rows(docs).mapInArrow(run, "doc_id long, tokens array<int>, n_tokens int, round_trip boolean")


def decode(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of rows of (doc_id, tokens); bytes that aren't UTF-8 become replacement characters."""
    held = rows.sparkSession.sparkContext.broadcast(load(vocabulary))

    none = np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(held.value, pairs=(none, none))  # merges aren't needed
        for b in batches:
            lists = b.column(1)
            flat = lists.flatten()
            if flat.null_count:
                raise ValueError("a token id is null")
            size = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            off, raw = codec.decode(np.concatenate(([0], np.cumsum(size))), flat.to_numpy(zero_copy_only=False))
            found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(raw)])
            try:
                texts = found.cast(pa.large_string()).cast(pa.string())
            except pa.ArrowInvalid:  # not all of it is UTF-8
                texts = pa.array([x.decode("utf-8", "replace") for x in found.to_pylist()], pa.string())
            texts = pc.if_else(lists.is_valid(), texts, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), texts], names=["doc_id", "text"])

    return pick(rows, doc_id="long", tokens="array<int>").mapInArrow(run, "doc_id long, text string")
