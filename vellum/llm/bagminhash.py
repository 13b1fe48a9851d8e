"""Near duplicates by weighted Jaccard similarity of word-shingle multisets, with BagMinHash signatures.

After Ertl, "BagMinHash - Minwise Hashing Algorithm for Weighted Sets". A shingle that occurs w times carries weight w.
Weights are discretised at the integers and covered by dyadic blocks (0,1], (1,2], (2,4], (4,8] ...; each shingle and
block has its own seeded Poisson process whose rate is the block's width, and each point goes down the block's binary
tree, a hash bit a level, to one unit of weight. Points above the shingle's weight are dropped, the others fall into a
random slot of the signature, which keeps the earliest. Processes stop when they pass the time by which all slots are
full, so a text costs O(m log m) points whatever its weights. Two signatures agree in a slot with a probability equal to
the weighted Jaccard similarity of their multisets.

Plan: signatures are made once and written; exact copies collapse on a 128-bit key; bands of the rest are shuffled
as 64-bit keys. Each bucket's texts are first compared with its least id only. Then every pair of a bucket that isn't
already in one group is compared too, so that no candidate is left out, though a group of n alike costs O(n). Each
pair is verified on the real multisets. Groups are connected components, by alternating star contraction.

Groups' and buckets' least ids are partial aggregates, joined back, so that a text or bucket that a third of all rows share
isn't one task's (adaptive execution splits such joins). A text that is compared with more than ``MEETS`` others is sent in
as many copies as it needs for each to meet at most about so many, in different tasks.

Defined results: texts are compared in lower case, split at white space; those of fewer words than a shingle are one
shingle; null texts and texts without words are never duplicates; rows without an id are never grouped, and stay; rows
that share a doc_id are one document in ``duplicates`` (similar if any of their texts is), and ``deduplicate`` keeps of
them the row with the least text; of each group the least doc_id stays; other columns, whatever their names, pass
through; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U, Words, doc_rows, index_of, mix, positional, saved, slices, utf8_buffers

SHINGLE = 2
BANDS, ROWS = 20, 4
THRESHOLD = 0.6
#: Texts that one copy of a text is compared with, about at most.
MEETS = 500
_B1, _B2 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text's index, hash) of each shingle of n words; a text with fewer words has one shingle of all of them."""
    size = np.diff(w.first)
    room = w.room() if len(w) else np.zeros(0, np.int64)
    h = np.zeros(len(w), np.uint64)
    for k in range(n):
        part = np.zeros(len(w), np.uint64)
        part[: max(len(w) - k, 0)] = w.hash[k:]
        part[room <= k] = 0
        h = h * _B1 + part
    short = size[w.doc] < n if len(w) else np.zeros(0, bool)
    use = (room >= n) | (short & (np.arange(len(w)) == w.first[w.doc])) if len(w) else short
    return w.doc[use], mix(h[use])


def weighted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's index, hash, weight) of the distinct shingles of each text."""
    if not len(h):
        return doc, h, np.zeros(0, np.int64)
    _, first, count = np.unique(mix(h ^ mix(doc.astype(np.uint64))), return_index=True, return_counts=True)
    return doc[first], h[first], count


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """n_docs x m earliest points; infinite for texts without weight."""
    sig = np.full(n_docs * m, np.inf)
    blocks = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1, 1)
    rep = np.repeat(np.arange(len(h)), blocks)
    block = np.arange(len(rep)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    width = np.where(block > 0, 1 << np.maximum(block - 1, 0), 1)
    low = np.where(block > 0, width, 0)
    seed = mix(h[rep] ^ mix(block.astype(np.uint64) + U(77)))
    owner, top = doc[rep], weight[rep]
    mass = np.bincount(doc, weights=weight, minlength=n_docs)
    todo = mass > 0
    until = (math.log(m) + 4.0) * m / np.maximum(mass, 1)
    while todo.any():
        at = np.flatnonzero(todo[owner])
        x = np.zeros(len(at))
        step = 0
        while len(at):
            r = mix(seed[at] + U((2 * step * 0xD6E8FEB86659FD93) & (2**64 - 1)))
            x = x - np.log(((r >> U(11)).astype(np.float64) + 1.0) * 2.0**-53) / width[at]
            on = x <= until[owner[at]]
            at, x = at[on], x[on]
            s = mix(r[on] ^ U(0x5851F42D4C957F2D))
            slot = (s >> U(40)) % U(m)
            # Down the block's binary tree: a bit a level picks the unit of weight that holds the point.
            unit = low[at] + 1 + ((s & U(0xFFFFFFFFFF)).astype(np.int64) & (width[at] - 1))
            held = unit <= top[at]
            np.minimum.at(sig, owner[at[held]] * m + slot[held].astype(np.int64), x[held])
            step += 1
        open_ = np.isinf(sig.reshape(n_docs, m)).any(axis=1) & todo
        todo = open_
        until[todo] *= 2
    return sig.reshape(n_docs, m)


def sketch(column: pa.Array, n: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word count, exact key in 2 columns, band keys) of each text."""
    off, raw = utf8_buffers(pc.utf8_lower(column))
    w = Words(off, raw)
    n_docs = len(off) - 1
    size = np.diff(w.first)
    key = np.zeros((n_docs, 2), np.uint64)
    band = np.zeros((n_docs, bands), np.uint64)
    if len(w):
        pos = np.arange(len(w)) - w.first[w.doc]
        filled = np.flatnonzero(size)
        at = w.first[filled]
        for i, salt in enumerate((_B1, _B2)):
            key[filled, i] = mix(np.add.reduceat(mix(w.hash + salt * (pos + 1).astype(np.uint64)), at) + size[filled].astype(np.uint64))
        sig = signatures(*weighted(*shingles(w, n)), n_docs, bands * rows).view(np.uint64)
        for b in range(bands):
            k = np.full(n_docs, b + 1, np.uint64)
            for r in range(rows):
                k = mix(k * _B2 ^ sig[:, b * rows + r])
            band[:, b] = k
    return size, key, band


def sketches(docs: DataFrame, n: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, k1, k2 (exact key) and bands of every row with an id and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for whole in batches for s in slices(whole, 1)):
            size, key, band = sketch(b.column(1), n, bands, rows)
            flat = pa.array(band.view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * bands), flat)
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(key[:, 0].view(np.int64)), pa.array(key[:, 1].view(np.int64)), lists], names=["doc_id", "k1", "k2", "bands"])
            yield out.filter(pa.array(size > 0))

    return docs.filter("doc_id is not null and text is not null").mapInArrow(run, "doc_id long, k1 long, k2 long, bands array<long>")


def overlap(a: pa.Array, b: pa.Array, n: int = SHINGLE) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts."""
    sides = []
    for column in (a, b):
        off, raw = utf8_buffers(pc.utf8_lower(column))
        d, h = shingles(Words(off, raw), n)
        keys, first, count = np.unique(mix(h ^ mix(d.astype(np.uint64))), return_index=True, return_counts=True)
        sides.append((keys, d[first], count, np.bincount(d, minlength=len(column))))
    (ka, da, ca, na), (kb, _, cb, nb) = sides
    both = np.zeros(len(a))
    if len(ka) and len(kb):
        at = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
        hit = kb[at] == ka
        both = np.bincount(da[hit], weights=np.minimum(ca[hit], cb[at[hit]]), minlength=len(a))
    return both / np.maximum(na + nb - both, 1)


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, n: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) whose multisets' similarity reaches the threshold, each once."""
    ta = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for whole in batches for s in slices(whole, 2, 3)):
            yield b.select([0, 1]).filter(pa.array(overlap(b.column(2), b.column(3), n) >= threshold))

    # Texts on side b that many meet are sent in several copies, each of which meets a part of them.
    often = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / MEETS).cast("int").alias("copies"))
    part = F.pmod(F.xxhash64("a"), F.col("copies")).cast("int")
    spread = pairs.join(often.filter("copies > 1"), "b", "left").select("a", "b", F.coalesce(part, F.lit(0)).alias("part"))
    tb = tb.join(often, "b").select("b", "tb", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("part"))
    joined = spread.join(tb, ["b", "part"]).join(ta, "a").select("a", "b", "ta", "tb")
    return joined.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, spark) -> DataFrame:
    """(doc_id, root): the least id of each connected component, for all but the roots; edges are (a, b)."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct().checkpoint()

    def with_least(df: DataFrame) -> DataFrame:
        """With the least v of each u; however often a u occurs, it isn't one task's."""
        return df.join(df.groupBy("u").agg(F.min("v").alias("m")), "u")

    def stamp(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())

    last = stamp(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = with_least(large)
        small = low.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = small.checkpoint()
        now = stamp(e)
        if now == last:
            return e.select(F.col("u").alias("doc_id"), F.col("v").alias("root"))
        last = now


def duplicates(docs: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, duplicate_of): every document that isn't the least of its group, with the least."""
    spark = docs.sparkSession
    texts = doc_rows(docs)
    sk = saved(sketches(texts, n, bands, rows), spark)
    groups = saved(sk.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "bands")).alias("r"), F.count(F.lit(1)).alias("n")), spark)
    # The least id of a group has one of its signatures; exact copies have equal ones.
    copies = groups.filter("n > 1").select("k1", "k2", F.col("r.doc_id").alias("b"))
    exact = sk.select(F.col("doc_id").alias("a"), "k1", "k2").join(copies, ["k1", "k2"]).filter("a <> b").select("a", "b").distinct()
    keys = groups.select("r.doc_id", F.explode("r.bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least <> most").select("key", "least")
    stars = saved(keys.join(shared, "key").select("doc_id", "key", "least"), spark)
    pairs = saved(stars.filter("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b")).distinct(), spark)
    edges = saved(verified(pairs, texts, threshold, n), spark)
    roots = components(edges, spark)
    # The rest of the candidates: pairs of a bucket that are in different groups as yet.
    grouped = saved(stars.join(roots, "doc_id", "left").select("doc_id", "key", F.coalesce("root", "doc_id").alias("root")), spark)
    several = grouped.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    mixed = grouped.join(several, "key", "left_semi")
    left = mixed.select("key", F.col("doc_id").alias("b"), F.col("root").alias("rb"))
    right = mixed.select("key", F.col("doc_id").alias("a"), F.col("root").alias("ra"))
    rest = left.join(right, "key").filter("a > b and ra <> rb").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
    rest = saved(rest, spark)
    more = verified(rest, texts, threshold, n)
    links = roots.select(F.col("doc_id").alias("a"), F.col("root").alias("b")).unionByName(more).unionByName(exact)
    return components(links, spark).select("doc_id", F.col("root").alias("duplicate_of"))


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of ``docs`` without all but one of each group, with all their columns."""
    gone = duplicates(docs, threshold, n, bands, rows).select("doc_id")
    plain, i, t = positional(docs), f"__c{index_of(docs, 'doc_id')}", f"__c{index_of(docs, 'text')}"
    ids = F.col(i).cast("long")
    shared = plain.filter(ids.isNotNull()).groupBy(ids.alias("doc_id")).count().filter("count > 1").select("doc_id")
    rest = plain.join(gone.unionByName(shared).select(F.col("doc_id").alias("__gone")), ids == F.col("__gone"), "left_anti")
    again = plain.join(shared.join(gone, "doc_id", "left_anti").select(F.col("doc_id").alias("__again")), ids == F.col("__again"), "left_semi")
    first = again.withColumn("__rank", F.row_number().over(Window.partitionBy(ids).orderBy(F.col(t).asc_nulls_last()))).filter("__rank = 1").drop("__rank")
    return rest.unionByName(first).toDF(*docs.columns)
