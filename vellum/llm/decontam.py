"""Benchmark decontamination: passages of test items within an edit budget, by pigeonhole pieces and Myers' algorithm.

An item of n bytes may differ by k = floor(``RATE`` n) edits. It is split into k + 1 pieces; one of them is left whole in
any such match. Pieces are looked up by their first 8 bytes (or all, if they are shorter) at every byte of the texts at once:
a bit table, then binary search, then the whole piece. Up to 4 pieces in a row make a group, whose budget is its pieces less
one: if every group had as many edits as pieces, the match would have k + 1; so around each hit the group is verified first,
with Myers' bit-parallel distance in 64-bit lanes of numpy, and only then the whole item with Myers over a Python integer.
Nothing is dropped that the budget allows. Items of fewer than ``MIN_BYTES`` bytes ("yes", a short question) have a budget
of 0: they match where they stand as they are, between word boundaries.

Items are broadcast to the tasks as long as they hold at most ``BROADCAST_BYTES``; a larger table is worked off in as
many passes over the texts, so that what a task holds doesn't grow with it. The tables of a pass are made once in a worker.

Texts and items are compared as UTF-8 in lower case, with runs of white space as one space. Defined results: items that
are null or empty match nothing; null and empty texts match nothing; rows without an id are never reported, but ``clean``
drops them if their text matches; of an item that is held at several places, or several times in the table, the least
distance counts; repeated rows and repeated items give one pair; columns of any name pass through ``clean``; very long texts
and items are matched whole; empty tables give empty results.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, U, doc_rows, index_of, inverse_powers, pick, positional, powers, slices, utf8_buffers

RATE = 0.1
MIN_BYTES = 40
GROUP = 4
BROADCAST_BYTES = 2 << 20
_TABLE_BITS = 22
_ODD = U(0x9E3779B97F4A7C15)


def normal(column: pa.Array) -> pa.Array:
    """Lower case, white space run together, none at the ends."""
    low = pc.utf8_lower(column.cast(pa.large_string()))
    return pc.utf8_trim(pc.replace_substring_regex(low, r"\s+", " "), " ")


def myers(pattern: bytes, text: bytes) -> int:
    """The least edit distance of the pattern to any substring of the text."""
    m = len(pattern)
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best = score
    return best


#: Classes of bytes for the lanes: letters, digits and the space have their own, other bytes share 26. Sharing can only let more
#: hits through to the exact distance.
_CLASS = np.array([c - 96 if 97 <= c <= 122 else c - 20 if 48 <= c <= 57 else 27 if c == 32 else 38 + c % 26 for c in range(256)], np.int64)


class Matcher:
    """The pieces and groups of a set of items."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float = RATE):
        self.items = items
        rows: list[tuple[int, int, int, int]] = []  # item, start, end, group
        groups: list[tuple[int, int, int, int]] = []  # item, start, end, budget
        self.budget = [min(int(rate * len(t)), len(t) - 1) for _, t in items]
        for n, (k, (_, text)) in enumerate(zip(self.budget, items)):
            cuts = [len(text) * j // (k + 1) for j in range(k + 2)]
            for g in range(0, k + 1, GROUP):
                last = min(g + GROUP, k + 1)
                for j in range(g, last):
                    rows.append((n, cuts[j], cuts[j + 1], len(groups)))
                groups.append((n, cuts[g], cuts[last], last - g - 1))
        r = np.array(rows, np.int64).reshape(-1, 4)
        width = np.minimum(r[:, 2] - r[:, 1], 8)
        key = np.array([int.from_bytes(items[n][1][a : min(a + 8, b)], "little") for n, a, b, _ in rows], np.uint64)
        # Pieces lie by the bytes that they are looked up by, 8 first, and by these.
        order = np.lexsort((key, -width))
        self.key, width = key[order], width[order]
        self.item, self.start, self.end, self.group = r[order].T
        #: (bytes, first piece, end, bit table) of each width.
        self.widths: list[tuple[int, int, int, np.ndarray]] = []
        for w in sorted({int(x) for x in width}, reverse=True):
            a, b = int(np.searchsorted(-width, -w)), int(np.searchsorted(-width, -w, "right"))
            table = np.zeros(1 << _TABLE_BITS, bool)
            table[((self.key[a:b] * _ODD) >> U(64 - _TABLE_BITS)).astype(np.int64)] = True
            self.widths.append((w, a, b, table))
        self._flat = np.frombuffer(b"".join(t for _, t in items), np.uint8)
        self._base = np.concatenate(([0], np.cumsum([len(t) for _, t in items], dtype=np.int64)))
        g = np.array(groups, np.int64).reshape(-1, 4)
        item, self.g_start, self.g_end, self.g_budget = g.T
        # Groups as lanes: bits of each class, for patterns of up to 64 bytes (the tail of a longer one is left to the item).
        self.g_bytes = np.minimum(self.g_end - self.g_start, 64)
        cell = np.repeat(np.arange(len(g)), self.g_bytes)
        bit = np.arange(len(cell)) - np.repeat(np.cumsum(self.g_bytes) - self.g_bytes, self.g_bytes)
        byte = self._flat[self._base[item[cell]] + self.g_start[cell] + bit] if len(cell) else np.zeros(0, np.uint8)
        self.peq = np.zeros((len(g), 64), np.uint64)
        np.bitwise_or.at(self.peq, (cell, _CLASS[byte]), U(1) << bit.astype(np.uint64))

    def _hits(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, piece) wherever a whole piece occurs in the bytes."""
        places, pieces = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        data = raw.tobytes() + bytes(16)
        for width, first, end, table in self.widths:
            at, keys = [], []
            mask = U((1 << 8 * width) - 1)
            for shift in range(8):
                x = np.frombuffer(data, "<u8", len(raw) // 8 + 1, shift)
                if width < 8:
                    x = x & mask
                some = np.flatnonzero(table[((x * _ODD) >> U(64 - _TABLE_BITS)).astype(np.int64)])
                at.append(some * 8 + shift)
                keys.append(x[some])
            at, keys = np.concatenate(at), np.concatenate(keys)
            lo, hi = (first + np.searchsorted(self.key[first:end], keys, side) for side in ("left", "right"))
            count = hi - lo
            at = np.repeat(at, count)
            places.append(at)
            pieces.append(np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(len(at)))
        at, piece = np.concatenate(places), np.concatenate(pieces)
        size = self.end - self.start
        if len(at):
            ok = at + size[piece] <= len(raw)
            at, piece = at[ok], piece[ok]
            for i in range(8, int(size.max(initial=8))):
                use = np.flatnonzero(size[piece] > i)
                if not len(use):
                    break
                want = self._byte(piece[use], i)
                bad = use[raw[at[use] + i] != want]
                if len(bad):
                    keep = np.ones(len(at), bool)
                    keep[bad] = False
                    at, piece = at[keep], piece[keep]
        return at, piece

    def _byte(self, piece: np.ndarray, i: int) -> np.ndarray:
        return self._flat[self._base[self.item[piece]] + self.start[piece] + i]

    def _groups_near(self, raw: np.ndarray, at: np.ndarray, piece: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Which hits have their group within its budget around them (bounded by the text's lo and hi)."""
        g = self.group[piece]
        budget = self.g_budget[g]
        begin = at - (self.start[piece] - self.g_start[g])
        a = np.maximum(begin - budget, lo)
        m = self.g_bytes[g]
        # A longer group is cut to 64 bytes; its budget holds for a part of it just as well.
        b = np.minimum(begin + m + budget, hi)
        out = budget == 0
        todo = np.flatnonzero(~out)
        if not len(todo):
            return out
        for part in range(0, len(todo), 1 << 16):
            t = todo[part : part + (1 << 16)]
            gg, mm = g[t], m[t]
            pv, mv = np.full(len(t), 2**64 - 1, np.uint64), np.zeros(len(t), np.uint64)
            score = mm.copy()
            best = mm.copy()
            top = (mm - 1).astype(np.uint64)
            width = b[t] - a[t]
            for i in range(int(width.max(initial=0))):
                live = i < width
                eq = np.where(live, self.peq[gg, _CLASS[raw[np.minimum(a[t] + i, len(raw) - 1)]]], U(0))
                xv = eq | mv
                xh = (((eq & pv) + pv) ^ pv) | eq
                ph = mv | ~(xh | pv)
                mh = pv & xh
                score = score + ((ph >> top) & U(1)).astype(np.int64) - ((mh >> top) & U(1)).astype(np.int64)
                ph, mh = ph << U(1), mh << U(1)
                pv = mh | ~(xv | ph)
                mv = ph & xv
                best = np.where(live, np.minimum(best, score), best)
            out[t] = best <= budget[t]
        return out

    def find(self, off: np.ndarray, raw: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item, distance) of the matches, each pair once."""
        at, piece = self._hits(raw)
        if not len(at):
            return []
        doc = np.searchsorted(off, at, side="right") - 1
        inside = at + (self.end - self.start)[piece] <= off[doc + 1]
        at, piece, doc = at[inside], piece[inside], doc[inside]
        ok = self._groups_near(raw, at, piece, off[doc], off[doc + 1])
        at, piece, doc = at[ok], piece[ok], doc[ok]
        item = self.item[piece]
        size = np.diff(self._base)
        budget = np.array(self.budget, np.int64)
        begin = at - self.start[piece]
        a = np.maximum(begin - budget[item], off[doc])
        b = np.minimum(begin + size[item] + budget[item], off[doc + 1])
        order = np.lexsort((a, item, doc))
        out: dict[tuple[int, int], int] = {}
        data = raw.tobytes()
        spans: list[tuple[int, int, int, int]] = []
        for i in order.tolist():
            d, n, x, y = int(doc[i]), int(item[i]), int(a[i]), int(b[i])
            if spans and spans[-1][0] == d and spans[-1][1] == n and x <= spans[-1][3]:
                spans[-1] = (d, n, spans[-1][2], max(spans[-1][3], y))
            else:
                spans.append((d, n, x, y))
        for d, n, x, y in spans:
            best = out.get((d, n))
            if best == 0:
                continue
            text, pattern = data[x:y], self.items[n][1]
            score = 0 if pattern in text else myers(pattern, text)
            if score <= self.budget[n] and (best is None or score < best):
                out[(d, n)] = score
        return [(d, n, s) for (d, n), s in out.items()]


_WORD = np.zeros(256, bool)
_WORD[[i for i in range(256) if i >= 128 or chr(i).isalnum() or i == ord("_")]] = True


def _hashes(raw: np.ndarray) -> np.ndarray:
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * powers(len(raw)), out=total[1:])
    return total


class Exact:
    """Items found as they are, between word boundaries: by rolling hashes, one pass for each length, then by their bytes."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.items = items
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in sorted({len(t) for _, t in items}):
            n = np.array([i for i, (_, t) in enumerate(items) if len(t) == size])
            key = np.array([_hashes(np.frombuffer(items[i][1], np.uint8))[-1] for i in n], np.uint64)
            order = np.argsort(key, kind="stable")
            self.by_length[size] = key[order], n[order]

    def find(self, off: np.ndarray, raw: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item, 0) of the matches, each pair once."""
        total, inverse, data = _hashes(raw), inverse_powers(len(raw)), raw.tobytes()
        edge = np.ones(len(raw) + 1, bool)
        edge[1:-1] = ~(_WORD[raw[1:]] & _WORD[raw[:-1]])
        edge[off] = True
        starts = np.flatnonzero(edge[:-1])
        ends = off[np.searchsorted(off, starts, side="right")]
        out: set[tuple[int, int, int]] = set()
        for size, (key, item) in self.by_length.items():
            at = starts[starts + size <= ends]
            at = at[edge[at + size]]
            h = (total[at + size] - total[at]) * inverse[at]
            lo, hi = np.searchsorted(key, h, "left"), np.searchsorted(key, h, "right")
            some = np.flatnonzero(hi > lo)
            doc = np.searchsorted(off, at[some], side="right") - 1
            _, first = np.unique(np.stack((doc, lo[some])), axis=1, return_index=True)
            for i in first.tolist():
                a = int(at[some[i]])
                for n in item[lo[some[i]] : hi[some[i]]].tolist():
                    if data[a : a + size] == self.items[n][1]:
                        out.add((int(doc[i]), n, 0))
        return sorted(out)


def _passes(benchmark: DataFrame, low: int = MIN_BYTES, below: int | None = None) -> list[list[tuple[int, bytes]]]:
    """The distinct usable items in lists of at most BROADCAST_BYTES each."""
    items = pick(benchmark, item_id="long", text="string").filter("item_id is not null and text is not null").distinct()
    parts: list[list[tuple[int, bytes]]] = [[]]
    size = 0
    for row in items.orderBy("item_id", "text").toLocalIterator():
        text = normal(pa.array([row["text"]]))[0].as_py().encode()
        if len(text) < low or below is not None and len(text) >= below:
            continue
        if size and size + len(text) > BROADCAST_BYTES:
            parts.append([])
            size = 0
        parts[-1].append((row["item_id"], text))
        size += len(text)
    return [p for p in parts if p]


Pass = tuple[str, list[tuple[int, bytes]], bool]


def _all_passes(benchmark: DataFrame) -> list[Pass]:
    """(a name of its own, items, whether they are short and match as they are)."""
    found = [(items, False) for items in _passes(benchmark)] + [(items, True) for items in _passes(benchmark, 1, MIN_BYTES)]
    return [(uuid.uuid4().hex, items, exact) for items, exact in found]


_made: dict[tuple[str, float], "Matcher | Exact"] = {}


def _finder(held: Pass, rate: float) -> "Matcher | Exact":
    """The pass's tables, made once in a worker; only the last passes' are kept."""
    name, items, exact = held
    found = _made.get((name, rate))
    if found is None:
        while len(_made) > 1:
            _made.pop(next(iter(_made)))
        found = _made[name, rate] = Exact(items) if exact else Matcher(items, rate)
    return found


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, distance): the items that a document holds within the budget, at their least distance."""
    spark = docs.sparkSession
    texts = doc_rows(docs).filter("doc_id is not null and text is not null")
    out = spark.createDataFrame([], "doc_id long, item_id long, distance int")
    for one in _all_passes(benchmark):
        held = spark.sparkContext.broadcast(one)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            m = _finder(held.value, rate)
            for b in (s for whole in batches for s in slices(whole, 1)):
                found = m.find(*utf8_buffers(normal(b.column(1))))
                ids = b.column(0).take(pa.array([d for d, _, _ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([m.items[n][0] for _, n, _ in found], pa.int64()), pa.array([s for _, _, s in found], pa.int32())], names=["doc_id", "item_id", "distance"])

        out = out.unionByName(texts.mapInArrow(run, "doc_id long, item_id long, distance int"))
    return out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item."""
    plain, text = positional(docs), index_of(docs, "text")
    for one in _all_passes(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(one)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            m = _finder(held.value, rate)
            for b in (s for whole in batches for s in slices(whole, text)):
                stay = np.ones(b.num_rows, bool)
                stay[[d for d, _, _ in m.find(*utf8_buffers(normal(b.column(text))))]] = False
                yield b.filter(pa.array(stay))

        plain = plain.mapInArrow(run, plain.schema)
    return plain.toDF(*docs.columns)
