"""Repeated passages: FM-indexes over wavelet matrices give the matching statistics of streamed documents.

A text is a sequence of white-space separated words (exact, by 64-bit hash). Reported are the maximal word intervals
of at least ``MIN_WORDS`` words that are covered by passages of that length which also occur elsewhere, in another
document or in the same.

To search every document against every shard would cost the square of the corpus, so each passage is only searched where a
match can be. K-grams are winnowed: of any ``MIN_WORDS`` words the least k-gram hash is taken, so two equal passages have
the same. Only hashes that are picked twice in the corpus matter. A text is cut into segments, the runs of passages with one
of these hashes; elsewhere nothing repeats, and each passage lies in one segment only. All segments of a hash are in one
shard, so a segment is searched in its own shard and in no other, and the work follows the repeated text, not its square.
Equal segments count once: copies are repeated as a whole, and a hash that only equal segments have needs no search. Where
one hash has more different segments than a shard holds (a short passage in many surroundings), their passages are counted
by a 128-bit hash of all their words instead.

In a shard the index is a suffix array by prefix doubling, the Burrows-Wheeler transform in a wavelet matrix of packed
bits with rank counts, and the LCP array with its nearest smaller values. All regions go through it in lock-step: a
backward-search step where the next word to the left extends the match, else a step to the parent interval.

Defined results: rows without an id or text, and texts of fewer than ``MIN_WORDS`` words, have no intervals; repeated
rows are copies of each other, and each is reported (under one doc_id once); ``remove`` keeps the occurrence with the
least (doc_id, place) and cuts the others out, leaves rows without an id as they are, drops rows of which no word is
left after a cut, and passes other columns on, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U, Words, chars_before, doc_rows, index_of, mix, positional, saved, slices, utf8_buffers

MIN_WORDS = 50
GRAM = 16
#: Words that one shard's index holds at about most; streams are cut to runs of CHUNK words, overlapping by MIN_WORDS.
SHARD_WORDS = 1 << 18
CHUNK = 192
_B = U(0xA24BAED4963EE407)
_MAX = U(2**64 - 1)


# --- the index ------------------------------------------------------------------------------------------------------


class Wavelet:
    """Wavelet matrix of an integer sequence: a packed bit vector with rank counts for each bit of the symbols."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        n = len(seq)
        for b in range(self.bits - 1, -1, -1):
            bit = ((seq >> b) & 1).astype(bool)
            padded = np.zeros((n // 64 + 1) * 64, bool)
            padded[:n] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64))))
            self.zeros.append(n - int(bit.sum()))
            seq = np.concatenate((seq[~bit], seq[bit]))
        self.begin = np.zeros(sigma, np.int64)
        self.begin = self.rank(np.arange(sigma), np.zeros(sigma, np.int64))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position i."""
        at = i
        for level in range(self.bits):
            word, low = at >> 6, (at & 63).astype(np.uint64)
            ones = self.counts[level][word] + np.bitwise_count(self.words[level][word] & ((U(1) << low) - U(1))).astype(np.int64)
            bit = (symbol >> (self.bits - 1 - level)) & 1
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return at - self.begin[symbol]


class FMIndex:
    """Of integer texts; symbols are 1 and up, 0 parts the texts."""

    def __init__(self, texts: list[np.ndarray], sigma: int):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        t = np.zeros(int((sizes + 1).sum()), np.int64)
        for a, x in zip(self.starts, texts):
            t[a : a + len(x)] = x
        self.n = n = len(t)
        longest = int(sizes.max()) if len(sizes) else 0
        ranks, rank, k = [], t.astype(np.int64), 1
        rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
        while True:
            ranks.append(rank.astype(np.int32))
            if k > longest or int(rank.max(initial=0)) == n - 1:
                break
            after = np.zeros(n, np.int64)
            after[:-k] = rank[k:] + 1 if k < n else 0
            key = rank * (n + 2) + after
            order = np.argsort(key)
            s = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(s[1:] != s[:-1])))
            k *= 2
        self.sa = sa = np.argsort(rank, kind="stable")
        to_end = np.repeat(self.starts + sizes, sizes + 1) - np.arange(n)
        a, b = sa[:-1], sa[1:]
        common = np.zeros(n - 1, np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            r, step = ranks[level], 1 << level
            pa_, pb_ = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
            same = (r[pa_] == r[pb_]) & (a + common < n) & (b + common < n)
            common += step * same
        self.lcp = np.full(n + 1, -1, np.int64)
        self.lcp[1:n] = np.minimum(common, np.minimum(to_end[a], to_end[b]))
        self._nearest_smaller()
        bwt = t[sa - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(t, minlength=sigma + 1))))
        self.wavelet = Wavelet(bwt, sigma + 1)
        self.least: list[np.ndarray] | None = None

    def _nearest_smaller(self) -> None:
        lcp = self.lcp.tolist()
        n = len(lcp)
        before, after, stack = [0] * n, [n - 1] * n, [0]
        for i in range(1, n):
            v = lcp[i]
            while stack and lcp[stack[-1]] > v:
                after[stack.pop()] = i
            if stack:
                top = stack[-1]
                before[i] = before[top] if lcp[top] == v else top
            stack.append(i)
        self.psv, self.nsv = np.array(before, np.int64), np.array(after, np.int64)

    def earliest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least text position in each suffix-array range, from a sparse table."""
        if self.least is None:
            self.least = [self.sa.astype(np.int32)]
            while (step := 1 << (len(self.least) - 1)) * 2 <= self.n:
                row = self.least[-1]
                self.least.append(np.minimum(row[:-step], row[step:]))
        out = np.full(len(lo), self.n, np.int64)
        some = np.flatnonzero(hi > lo)
        level = np.frexp((hi[some] - lo[some]).astype(np.float64))[1] - 1
        for lv in np.unique(level):
            at = some[level == lv]
            row = self.least[lv]
            out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << int(lv))])
        return out

    def matches(self, streams: list[np.ndarray], least_count: np.ndarray, before: np.ndarray | None, moves: np.ndarray, length: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(stream, start, end) arrays of the left-maximal matches of at least ``length`` symbols.

        A match counts if its range holds ``least_count`` suffixes or, where ``before`` is given, one that starts before
        that place; for streams with 1 in ``moves`` the match's start is added to it.
        """
        sizes = np.array([len(s) for s in streams], np.int64)
        base = np.concatenate(([0], np.cumsum(sizes)))
        text = np.concatenate(streams) if len(streams) else np.zeros(0, np.int64)
        who = np.flatnonzero(sizes >= length)
        p, m = sizes[who].copy(), np.zeros(len(who), np.int64)
        lo, hi = np.zeros(len(who), np.int64), np.full(len(who), self.n, np.int64)
        found = []
        while len(who):
            symbol = text[base[who] + p - 1]
            known = symbol > 0
            c = np.where(known, symbol, 0)
            r = self.wavelet.rank(np.concatenate((c, c)), np.concatenate((lo, hi)))
            a, b = self.first[c] + r[: len(c)], self.first[c] + r[len(c) :]
            if before is None:
                on = known & (b - a >= least_count[who])
            else:
                on = known & (b > a)
                at = np.flatnonzero(on)
                on[at] = self.earliest(a[at], b[at]) < before[who[at]] + moves[who[at]] * (p[at] - 1)
            stop = ~on & (m >= length)
            if stop.any():
                found.append((who[stop], p[stop], p[stop] + m[stop]))
            k = np.where(self.lcp[lo] >= self.lcp[hi], lo, hi)
            up = np.maximum(self.lcp[k], 0)
            root = up == 0
            parent_lo, parent_hi = np.where(root, 0, self.psv[k]), np.where(root, self.n, self.nsv[k])
            skip = ~on & (m == 0)
            lo = np.where(on, a, np.where(skip, 0, parent_lo))
            hi = np.where(on, b, np.where(skip, self.n, parent_hi))
            p = p - (on | skip)
            m = np.where(on, m + 1, np.where(skip, 0, up))
            done = p == 0
            # What is left of the stream can't hold a match that is long enough.
            late = ~done & (p + m < length)
            if done.any():
                last = done & (m >= length)
                if last.any():
                    found.append((who[last], p[last], p[last] + m[last]))
            go = ~(done | late)
            who, p, m, lo, hi = who[go], p[go], m[go], lo[go], hi[go]
        return found


# --- anchors and regions --------------------------------------------------------------------------------------------


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least (or greatest) of x[i : i + width] for each i, x being padded by its neutral value."""
    fill, f = (_MAX, np.minimum) if least else (U(0), np.maximum)
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        moved = np.full(len(x), fill, np.uint64)
        moved[: max(len(x) - step, 0)] = out[step:]
        out = f(out, moved)
        have += step
    return out


def passages(w: Words, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word the hash of the k-gram, and the least one of the ``length`` words, that begin with it (0 where they don't fit)."""
    # Rolling k-gram hash by doubling; gram is a power of two.
    h, size = w.hash.copy(), 1
    while size < gram:
        moved = np.zeros(len(w), np.uint64)
        moved[: max(len(w) - size, 0)] = h[size:]
        h = mix(h * _B + moved)
        size *= 2
    room = w.room()
    h = np.where(room >= gram, h, _MAX)
    low = _sliding(h, length - gram + 1, True)
    return h, np.where(room >= length, low, U(0))


def anchors(w: Words, length: int, gram: int, held: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of the picked k-grams: the least of every ``length`` words of a text."""
    if len(w) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, low = held or passages(w, length, gram)
    top = _sliding(low[::-1], length - gram + 1, False)[::-1]
    # Windows of the text before begin before its first word; they are none of this text's.
    pos = np.arange(len(w)) - w.first[w.doc]
    near = np.flatnonzero((pos < length - gram) & (pos >= 0))
    if len(near):
        start = w.first[w.doc[near]]
        acc = np.zeros(len(near), np.uint64)
        for back in range(length - gram + 1):
            i = near - back
            ok = i >= start
            acc = np.where(ok, np.maximum(acc, low[np.maximum(i, 0)]), acc)
        top = top.copy()
        top[near] = acc
    at = np.flatnonzero((h == top) & (h != _MAX))
    return at, h[at]


def _anchor_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for whole in batches for s in slices(whole, 1)):
            w = Words(*utf8_buffers(b.column(1)))
            at, h = anchors(w, length, gram)
            ids = b.column(0).take(pa.array(w.doc[at] if len(at) else at))
            yield pa.RecordBatch.from_arrays([ids, pa.array(h.view(np.int64))], names=["doc_id", "h"])

    return texts.mapInArrow(run, "doc_id long, h long")


def _segments(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows of segments of (doc_id, text, shared hashes); at and first are their first character and word in the text.

    h: the hash that all passages of the segment have; twice: whether it is in the segment more than once.
    """
    schema = "doc_id long, at long, first long, chars long, words int, text string, h long, twice boolean, k1 long, k2 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for whole in batches for s in slices(whole, 1)):
            off, raw = utf8_buffers(b.column(1))
            w = Words(off, raw)
            if len(w) < length:
                continue
            h, low = passages(w, length, gram)
            at, picked = anchors(w, length, gram, (h, low))
            lists = b.column(2)
            shared = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            owner = np.repeat(np.arange(b.num_rows), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
            known = np.unique(mix(shared ^ mix(owner.astype(np.uint64))))
            new = np.ones(len(w), bool)
            new[1:] = (low[1:] != low[:-1]) | (w.doc[1:] != w.doc[:-1])
            start = np.flatnonzero(new)
            last = np.append(start[1:], len(w)) - 1
            ok = (low[start] != 0) & np.isin(mix(low[start] ^ mix(w.doc[start].astype(np.uint64))), known)
            start, last = start[ok], last[ok]
            if not len(start):
                continue
            end, d = last + length, w.doc[start]
            pair = np.flatnonzero((picked[1:] == picked[:-1]) & (w.doc[at[1:]] == w.doc[at[:-1]]))
            k = np.searchsorted(at[pair], start)
            twice = np.append(at[pair + 1], len(w) + length)[k] <= last + length - gram
            cb = chars_before(raw)
            bs, be = w.start[start], w.end[end - 1]
            data = raw.tobytes()
            cum = np.cumsum(end - start) - (end - start)
            cells = np.repeat(np.arange(len(start)), end - start)
            words = np.arange(len(cells)) - np.repeat(cum - start, end - start)
            keys = []
            for odd in (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)):
                # Keyed by the words, each with its number and its place in bytes: segments of one key have their words at the
                # same offsets, whatever white space is between. Others of the same words are found by the index.
                v = mix(mix(w.hash[words] + odd * (words - start[cells] + 1).astype(np.uint64)) + (w.start[words] - bs[cells]).astype(np.uint64))
                keys.append(mix(np.add.reduceat(v, cum)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(d)),
                    pa.array(cb[bs] - cb[off[d]]),
                    pa.array(start - w.first[d]),
                    pa.array(cb[be] - cb[bs]),
                    pa.array((end - start).astype(np.int32)),
                    pa.array([data[x:y].decode("utf-8") for x, y in zip(bs, be)], pa.string()),
                    pa.array(low[start].view(np.int64)),
                    pa.array(twice),
                    pa.array(keys[0]),
                    pa.array(keys[1]),
                ],
                names=["doc_id", "at", "first", "chars", "words", "text", "h", "twice", "k1", "k2"],
            )

    return texts.mapInArrow(run, schema)


def _merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    order = np.argsort(start, kind="stable")
    out: list[tuple[int, int]] = []
    for a, b in zip(start[order].tolist(), end[order].tolist()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


class Shard:
    """The index of a shard's segments, given as rows of (doc_id, at, text, asked, k1, k2)."""

    def __init__(self, table: pa.Table, length: int, earlier: bool):
        self.length, self.earlier = length, earlier
        doc = table.column("doc_id").to_numpy(zero_copy_only=False)
        place = table.column("at").to_numpy(zero_copy_only=False)
        self.table = table.take(pa.array(np.lexsort((place, doc))))
        self.off, self.raw = utf8_buffers(self.table.column("text"))
        self.w = w = Words(self.off, self.raw)
        values = np.unique(w.hash)
        self.ids = np.searchsorted(values, w.hash) + 1
        self.index = FMIndex([self.ids[a:b] for a, b in zip(w.first.tolist(), w.first[1:].tolist())], len(values))

    def _found(self) -> dict[int, list[tuple[int, int]]]:
        """Word intervals of each asked segment that match."""
        streams, of, shift = [], [], []
        asked = self.table.column("asked").to_pylist()
        for i, (a, b) in enumerate(zip(self.w.first.tolist(), self.w.first[1:].tolist())):
            for step in range(a, max(b - self.length, a) + 1, CHUNK) if asked[i] else ():
                streams.append(self.ids[step : min(step + CHUNK + self.length, b)])
                of.append(i)
                shift.append(step - a)
        of_, shift_ = np.array(of, np.int64), np.array(shift, np.int64)
        n = len(streams)
        before = self.index.starts[of_] + shift_ if self.earlier else None
        rows: dict[int, tuple[list, list]] = {}
        for who, a, b in self.index.matches(streams, np.full(n, 2), before, np.ones(n, np.int64), self.length):
            for i, x, y in zip(of_[who].tolist(), (a + shift_[who]).tolist(), (b + shift_[who]).tolist()):
                r = rows.setdefault(i, ([], []))
                r[0].append(x)
                r[1].append(y)
        return {i: _merged(np.array(xs), np.array(ys)) for i, (xs, ys) in rows.items()}

    def matches(self) -> pa.RecordBatch:
        """Of the asked segments, what occurs at another place, or with ``earlier`` at one before."""
        w, cb = self.w, chars_before(self.raw)
        hit, starts, ends, words = [], [], [], []
        for i, spans in self._found().items():
            f, base = int(w.first[i]), int(cb[self.off[i]])
            for x, y in spans:
                hit.append(i)
                starts.append(int(cb[w.start[f + x]]) - base)
                ends.append(int(cb[w.end[f + y - 1]]) - base)
                words.append((x, y))
        return _span_rows(self.table.take(pa.array(hit, pa.int64())), starts, ends, words)


def _span_rows(t: pa.Table, start: list[int], end: list[int], words: list[tuple[int, int]]) -> pa.RecordBatch:
    keys = [t.column(c).combine_chunks() for c in ("k1", "k2")]
    bounds = ([a for a, _ in words], [b for _, b in words])
    return pa.RecordBatch.from_arrays([*keys, *(pa.array(x, pa.int64()) for x in (start, end, *bounds))], names=["k1", "k2", *_SPAN])


#: Bounds of a match in its region, in characters and in words.
_SPAN = ["from", "to", "from_word", "to_word"]
_SPAN_TYPES = "`from` long, `to` long, from_word long, to_word long"


def _search(length: int, earlier: bool):
    """Rows of matches of each shard, of rows sorted by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        shard = None
        for b in batches:
            if not b.num_rows:
                continue
            s = b.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), b.num_rows]
            for x, y in zip(cuts, cuts[1:]):
                if held and s[x] != shard:
                    yield Shard(pa.Table.from_batches(held), length, earlier).matches()
                    held = []
                shard = s[x]
                held.append(b.slice(x, y - x))
        if held:
            yield Shard(pa.Table.from_batches(held), length, earlier).matches()

    return run


def _passages(rows: DataFrame, length: int) -> DataFrame:
    """Each passage of the segments, with the key of its words, its first word's place in the text, and its bounds in the segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for whole in batches for s in slices(whole, whole.schema.get_field_index("text"), limit=1 << 20)):
            off, raw = utf8_buffers(b.column("text"))
            w, cb = Words(off, raw), chars_before(raw)
            at = np.flatnonzero(w.room() >= length)
            doc = w.doc[at]
            keys = [np.full(len(at), odd, np.uint64) for odd in (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))]
            for j in range(length):
                keys = [mix(k * _B + w.hash[at + j]) for k in keys]
            t, i = b.take(pa.array(doc)), at - w.first[doc]
            place = t.column("first").to_numpy(zero_copy_only=False) + i
            base = cb[off[doc]]
            cols = [*(t.column(c) for c in ("doc_id", "asked", "k1", "k2")), pa.array(place), *(pa.array(k.view(np.int64)) for k in keys), pa.array(cb[w.start[at]] - base), pa.array(cb[w.end[at + length - 1]] - base), pa.array(i), pa.array(i + length)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "asked", "k1", "k2", "place", "p1", "p2", *_SPAN])

    return rows.mapInArrow(run, f"doc_id long, asked boolean, k1 long, k2 long, place long, p1 long, p2 long, {_SPAN_TYPES}")


# --- the operator ---------------------------------------------------------------------------------------------------


def _searched(segments: DataFrame, earlier: bool) -> tuple[DataFrame, DataFrame, int]:
    """(different segments with their copies; those to be searched, with text and the words of all that have their hash; number of shards).

    Each is searched among those of its hash only. asked: whether its own matches matter; copies that don't lie first are
    repeated as a whole, and so are all where any other place counts.
    """
    spark = segments.sparkSession
    place = F.struct("doc_id", "at", "first")
    unique = segments.groupBy("k1", "k2").agg(F.min(place).alias("p"), F.count(F.lit(1)).alias("copies"), F.first("words").alias("words"), F.first("h").alias("h"), F.max("twice").alias("twice"))
    unique = saved(unique, spark)
    load = unique.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("load"), F.max("twice").alias("again")).filter("n > 1 or again")
    open_ = unique.join(load.select("h", "load"), "h").select("h", "load", "words", "k1", "k2", "copies", "p.doc_id", "p.at", "p.first")
    # One row of each: repeated rows of a doc_id have equal segments at one place.
    texts = segments.select("k1", "k2", "doc_id", "at", "text")
    keys = ["k1", "k2", "doc_id", "at"]
    open_ = saved(open_.join(texts, keys).dropDuplicates(keys).withColumn("asked", F.lit(earlier) | (F.col("copies") == 1)), spark)
    total = open_.filter(F.col("load") <= SHARD_WORDS).agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    return unique, open_, max(1, -(-2 * total // SHARD_WORDS))


def _intervals(docs: DataFrame, earlier: bool, length: int, gram: int) -> DataFrame:
    """(doc_id, start, end): characters of each repeated passage; with ``earlier`` only of what an earlier place holds."""
    spark = docs.sparkSession
    texts = doc_rows(docs).filter("doc_id is not null and text is not null")
    rows = saved(_anchor_rows(texts, length, gram), spark)
    # Counted by partial sums, and joined: however many documents have a hash, none of it is in one task alone.
    often = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    lists = rows.join(often, "h").groupBy("doc_id").agg(F.collect_set("h").alias("shared"))
    segments = saved(_segments(texts.join(lists, "doc_id"), length, gram), spark)
    unique, open_, n_shards = _searched(segments, earlier)
    light = open_.filter(F.col("load") <= SHARD_WORDS).select(F.pmod(F.xxhash64("h"), F.lit(n_shards)).alias("shard"), "doc_id", "at", "asked", "k1", "k2", "text")
    found = light.repartition(n_shards, "shard").sortWithinPartitions("shard").mapInArrow(_search(length, earlier), f"k1 long, k2 long, {_SPAN_TYPES}")
    many = saved(_passages(open_.filter(F.col("load") > SHARD_WORDS), length), spark)
    place = F.struct("doc_id", "place")
    often = many.groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("least")).filter("n > 1").select("p1", "p2", "least")
    again = many.join(often, ["p1", "p2"]).filter(place > F.col("least") if earlier else F.col("asked"))
    found = found.unionByName(again.select("k1", "k2", *_SPAN))
    own = segments.select("doc_id", "at", "first", "chars", "k1", "k2", "words")
    whole = own.join(unique.filter("copies > 1").select("k1", "k2", "p"), ["k1", "k2"])
    if earlier:
        # Of equal segments all but the first lie at a later place; repeated rows of one id and place keep one.
        whole = whole.filter("not (doc_id = p.doc_id and at = p.at)")
    whole = whole.select("doc_id", F.col("at").alias("start"), (F.col("at") + F.col("chars")).alias("end"), F.col("first").alias("start_word"), (F.col("first") + F.col("words")).alias("end_word"))
    part = own.join(found, ["k1", "k2"]).select(
        "doc_id", (F.col("at") + F.col("from")).alias("start"), (F.col("at") + F.col("to")).alias("end"), (F.col("first") + F.col("from_word")).alias("start_word"), (F.col("first") + F.col("to_word")).alias("end_word"),
    )
    return whole.unionByName(part)


def _union(spans: DataFrame) -> DataFrame:
    """(doc_id, start, end): overlapping intervals of a document, and those without a word between, made one."""
    w = Window.partitionBy("doc_id").orderBy("start_word", "end_word")
    s = spans.withColumn("reach", F.max("end_word").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("run", F.sum(F.when(F.col("start_word") <= F.col("reach"), 0).otherwise(1)).over(w))
    return s.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def repeats(docs: DataFrame, length: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """(doc_id, start, end): character intervals that are covered by passages which also occur elsewhere."""
    return _union(_intervals(docs, False, length, gram))


def sql(length: int = MIN_WORDS) -> str:
    """DuckDB's SQL for ``repeats``: runs of ``length`` words, those that occur again, and the intervals that they cover."""
    space = "\\t\\n\\x0b\\x0c\\r "
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(text, '[{space}]*[^{space}]+') AS ts FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT r, doc_id, ts, list_transform(ts, lambda x: ltrim(x, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')) AS ws FROM d),
g AS (SELECT r, i, md5(array_to_string(list_slice(ws, i, i + {length - 1}), ' ')) AS g FROM w, unnest(range(1, len(ws) - {length} + 2)) y(i)),
q AS (SELECT r, i, i - max(i) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS k FROM g) WHERE k > 1),
n AS (SELECT r, i, sum(CASE WHEN gap <= {length} THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS run FROM q),
s AS (SELECT r, min(i) AS a, max(i) + {length - 1} AS b FROM n GROUP BY r, run),
p AS (SELECT r, unnest(range(1, len(ts) + 1)) AS i, unnest(list_transform(ts, lambda x: length(x))) AS size, unnest(list_transform(ws, lambda x: length(x))) AS word FROM w),
e AS (SELECT r, i, word, sum(size) OVER (PARTITION BY r ORDER BY i) AS till FROM p)
SELECT DISTINCT doc_id, CAST(x.till - x.word AS BIGINT) AS start, CAST(y.till AS BIGINT) AS "end"
FROM s JOIN e x ON x.r = s.r AND x.i = s.a JOIN e y ON y.r = s.r AND y.i = s.b JOIN d ON d.r = s.r
"""


def remove(docs: DataFrame, length: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """``docs`` with every repeated passage kept at its first place only; rows left without words are dropped."""
    spans = _union(_intervals(docs, True, length, gram)).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__spans"))
    plain, i, t = positional(docs), f"__c{index_of(docs, 'doc_id')}", index_of(docs, "text")
    joined = plain.join(spans.withColumnRenamed("doc_id", "__id"), F.col(i).cast("long") == F.col("__id"), "left").drop("__id")
    n = len(plain.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, stay = b.column(t).to_pylist(), np.ones(b.num_rows, bool)
            spans_ = b.column(n)
            for k in np.flatnonzero(spans_.is_valid().to_numpy(zero_copy_only=False)).tolist():
                text, out, at = texts[k], [], 0
                if text is None:
                    continue
                for s in spans_[k].as_py():
                    out.append(text[at : s["start"]])
                    at = s["end"]
                out.append(text[at:])
                texts[k] = "\n".join(x for x in (o.strip() for o in out) if x)
                stay[k] = bool(texts[k])
            cols = [pa.array(texts, plain_type) if j == t else b.column(j) for j in range(n)]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:n]).filter(pa.array(stay))

    plain_type = pa.string()
    return joined.mapInArrow(run, plain.schema).toDF(*docs.columns)
