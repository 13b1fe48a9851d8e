"""Repetition coverage: how much of a text lies inside n-grams and lines that it repeats.

Word n-grams of several lengths get rolling polynomial hashes in numpy, for a whole Arrow batch at once; the text's
number is mixed into each hash, so that one sort finds every text's duplicates. Only what repeats something earlier in
the text counts, never a first occurrence. Measured are, as fractions of the characters in words: for n of ``TOP`` the
share of the most repeated n-gram (later occurrences times its length, at most 1), for n of ``COVER`` the share of
characters in the union of the later occurrences of n-grams; and the share of the characters in lines that lie in
lines seen before. The rules reject a text where a measure exceeds its limit.

Defined results: a null or empty text, or one of white space, has only zero measures and is kept (it repeats nothing);
very long texts are measured whole; repeated rows are measured each for itself; null ids are kept as they are; an empty
table gives an empty result; columns besides ``doc_id`` and ``text`` are passed on, whatever their names, by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U, Words, chars_before, doc_rows, index_of, mix, positional, powers, slices, utf8_buffers

TOP = (2, 3, 4)
COVER = (5, 6, 7, 8, 9, 10)
#: Limits of the measures; a text is rejected where one is exceeded.
LIMITS = {"top_2": 0.20, "top_3": 0.25, "top_4": 0.30} | {f"cover_{n}": 0.48 for n in COVER} | {"dup_lines": 0.50}
MEASURES = tuple(LIMITS)
_B = U(0xA24BAED4963EE407)


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Mask of the keys that occur more than once."""
    s = np.sort(keys)
    again = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(again):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(again, keys)
    at[at == len(again)] = 0
    return again[at] == keys


def _firsts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first occurrence, number of occurrences) of each distinct key."""
    _, first, count = np.unique(keys, return_index=True, return_counts=True)
    return first, count


def measure(off: np.ndarray, raw: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of each text of a batch."""
    n_docs = len(off) - 1
    out = {m: np.zeros(n_docs) for m in MEASURES}
    w = Words(off, raw)
    if len(w):
        cb = chars_before(raw)
        chars = (cb[w.end] - cb[w.start]).astype(np.int64)
        cum = np.concatenate(([0], np.cumsum(chars)))
        total = np.bincount(w.doc, weights=chars, minlength=n_docs)
        safe = np.maximum(total, 1)
        room, salt = w.room(), mix(w.doc.astype(np.uint64))
        n_max = max(TOP + COVER)
        rolling = w.hash.copy()
        at = np.arange(len(w))  # starts of n-grams that may repeat
        dup = np.ones(len(w) + 1, bool)
        dup[-1] = False
        for n in range(2, n_max + 1):
            # An n-gram can only repeat where both its (n-1)-grams do.
            at = at[(room[at] >= n) & dup[at] & dup[at + 1]]
            rolling = rolling[: len(w) - n + 1] * _B + w.hash[n - 1 :] if len(w) >= n else rolling[:0]
            keys = mix(rolling[at] ^ salt[at])
            again = _repeated(keys)
            at, keys = at[again], keys[again]
            dup[:] = False
            dup[at] = True
            if not len(at):
                break
            first, count = _firsts(keys)
            if n in TOP:
                i = at[first]
                np.maximum.at(out[f"top_{n}"], w.doc[i], (count - 1) * (cum[i + n] - cum[i]))
            if n in COVER:
                step = np.zeros(len(w) + 1, np.int32)
                later = np.delete(at, first)
                step[later] += 1
                step[later + n] -= 1
                inside = np.cumsum(step[:-1]) > 0
                out[f"cover_{n}"] = np.bincount(w.doc[inside], weights=chars[inside], minlength=n_docs)
        for m in MEASURES[:-1]:
            out[m] = np.minimum(out[m] / safe, 1.0)
        out["dup_lines"] = _lines(off, raw, cb, n_docs)
    return out


def _lines(off: np.ndarray, raw: np.ndarray, cb: np.ndarray, n_docs: int) -> np.ndarray:
    n = len(raw)
    stop = raw == 10
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.ones(n, bool)
    before[1:] = stop[:-1]
    after = np.ones(n, bool)
    after[:-1] = stop[1:]
    start = np.flatnonzero(~stop & (before | edge[:n]))
    end = np.flatnonzero(~stop & (after | edge[1:])) + 1
    if not len(start):
        return np.zeros(n_docs)
    length = end - start
    at = np.flatnonzero(~stop)
    cum = np.concatenate(([0], np.cumsum(length)))
    pos = np.arange(len(at)) - np.repeat(cum[:-1], length)
    terms = mix(raw[at].astype(np.uint64)) * powers(int(length.max()))[pos]
    doc = np.searchsorted(off, start, side="right") - 1
    keys = mix((np.add.reduceat(terms, cum[:-1]) + length.astype(np.uint64)) ^ mix(doc.astype(np.uint64)))
    chars = cb[end] - cb[start]
    later = np.delete(np.arange(len(keys)), _firsts(keys)[0])
    part = np.bincount(doc[later], weights=chars[later], minlength=n_docs)
    return part / np.maximum(np.bincount(doc, weights=chars, minlength=n_docs), 1)


def rejected(measures: dict[str, np.ndarray], limits: dict[str, float]) -> np.ndarray:
    bad = np.zeros(len(measures["dup_lines"]), bool)
    for m, most in limits.items():
        bad |= measures[m] > most
    return bad


def annotate(docs: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """doc_id, the measures (rounded to 6 places) and ``keep`` for every row."""
    limits = dict(LIMITS if limits is None else limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for whole in batches for s in slices(whole, 1)):
            m = measure(*utf8_buffers(b.column(1)))
            cols = [b.column(0), *(pa.array(np.round(m[k], 6)) for k in MEASURES), pa.array(~rejected(m, limits))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *MEASURES, "keep"])

    fields = ", ".join(f"{m} double" for m in MEASURES)
    return doc_rows(docs).mapInArrow(run, f"doc_id long, {fields}, keep boolean")


def keep(docs: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, that no rule rejects."""
    limits = dict(LIMITS if limits is None else limits)
    plain, text = positional(docs), index_of(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for whole in batches for s in slices(whole, text)):
            m = measure(*utf8_buffers(b.column(text)))
            yield b.filter(pa.array(~rejected(m, limits)))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def sql(limits: dict[str, float] | None = None) -> str:
    """DuckDB's SQL for the rows of ``annotate`` that are kept: n-grams with their places, counted and numbered in each text."""
    limits = LIMITS if limits is None else limits
    tops = ", ".join(f"coalesce(max(CASE WHEN n = {n} THEN m END), 0) AS top_{n}" for n in TOP)
    covers = ", ".join(f"coalesce(max(CASE WHEN n = {n} THEN m END), 0) AS cover_{n}" for n in COVER)
    measures = [f"least(coalesce(t.{m}, 0) / greatest(c.total, 1), 1)" for m in MEASURES if m.startswith("top")] + [f"coalesce(v.{m}, 0) / greatest(c.total, 1)" for m in MEASURES if m.startswith("cover")] + ["coalesce(l.again / greatest(l.every, 1), 0)"]
    named = ", ".join(f"CAST({x} AS DOUBLE) AS {m}" for x, m in zip(measures, MEASURES))
    kept = " AND ".join(f"{m} <= {limits[m]}" for m in limits)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(text, '[\\t\\n\\x0b\\x0c\\r ]+'), lambda x: x <> '') AS ws FROM d),
p AS (SELECT r, unnest(range(1, len(ws) + 1)) AS i, length(unnest(ws)) AS size FROM w),
c AS (SELECT r, sum(size) AS total FROM p GROUP BY r),
g AS (SELECT w.r, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS g FROM w, range(2, {max(TOP + COVER) + 1}) x(n), unnest(range(1, len(ws) - n + 2)) y(i)),
q AS (SELECT *, length(g) - n + 1 AS size, count(*) OVER (PARTITION BY r, n, g) AS k, row_number() OVER (PARTITION BY r, n, g ORDER BY i) AS o FROM g),
t AS (SELECT r, {tops} FROM (SELECT r, n, max((k - 1) * size) AS m FROM q GROUP BY r, n) GROUP BY r),
u AS (SELECT DISTINCT r, n, unnest(range(i, i + n)) AS i FROM q WHERE o > 1 AND n >= {min(COVER)}),
v AS (SELECT r, {covers} FROM (SELECT r, n, sum(size) AS m FROM u JOIN p USING (r, i) GROUP BY r, n) GROUP BY r),
y AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
z AS (SELECT r, line, count(*) AS k FROM y WHERE line <> '' GROUP BY r, line),
l AS (SELECT r, sum((k - 1) * length(line)) AS again, sum(k * length(line)) AS every FROM z GROUP BY r),
m AS (SELECT d.doc_id, {named} FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r) LEFT JOIN v USING (r) LEFT JOIN l USING (r))
SELECT doc_id, {", ".join(f"round({m}, 6) AS {m}" for m in MEASURES)}, true AS keep FROM m WHERE {kept}
"""
