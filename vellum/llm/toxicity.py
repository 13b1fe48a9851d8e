"""Toxicity: Levenshtein automata intersected with a lexicon trie, and scores of the words around each hit.

The lexicon's terms form a trie. The union of their Levenshtein automata (substitution, insertion, deletion and swapped
neighbours; up to 1 edit for terms of ``ONE_EDIT`` letters, 2 from ``TWO_EDITS``) is walked together with the trie as sets
of (node, edits), made deterministic as words are read: each set is a state that is built once and kept. Most words end in
the empty state after a few letters, whatever the lexicon's size.

A hit weighs 1, a misspelt one less. The ``WINDOW`` words to each side then tell abuse from quotation: quotation marks
around it or words of report make it weigh less, address in the second person more. A document is toxic where its hits'
weights come to ``THRESHOLD`` and to ``DENSITY`` of its words, or to ``DENSE_THRESHOLD`` and ``DENSE``.

``learn`` adds terms from labelled documents: of at most ``SAMPLE`` labelled documents (the least by a hash of their id)
it takes the words whose share among toxic documents is significant (log-likelihood ratio); and it lists the words of
clean documents that the automaton would take for misspelt terms, so that they don't count as such.

Defined results: null and empty texts have no hits; texts are read whole, however long; rows are scored each for itself and
repeated rows repeat in the result; a row without an id is scored like any other; of terms that are equally near to a word
the first by name counts (and a term that is listed always goes before a misspelt one); of several labels of one document the
most toxic counts, null ones don't; columns of any other name don't matter; without labels, or where all are of one kind,
the lexicon is the built-in one; empty tables give empty results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_rows, pick, saved, slices

SEED = ("clown", "disgusting", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "scumbag", "stupid", "trash", "worthless")
ONE_EDIT, TWO_EDITS = 5, 9
WINDOW = 6
THRESHOLD, DENSITY = 1.5, 0.001
DENSE_THRESHOLD, DENSE = 1.0, 0.005
MISSPELT = (1.0, 0.6, 0.4)
#: Learnt terms also come about by chance, and weigh a little less.
LEARNT = 0.9
QUOTED, ADDRESSED = 0.25, 1.5
#: Labelled documents that ``learn`` reads at most; limits for a learnt term.
SAMPLE = 20_000
LEAST_G2, LEAST_SHARE = 25.0, 0.7
_REPORT = frozenset("said says say saying called calls call quote quoted quotes quoting word words term terms wrote writes reported reports cited mentioned alleged sagte schrieb zitat wort nannte dit écrit mot cité appelé dijo escribió palabra cita llamó".split())
_ADDRESS = frozenset("you your yours you're ur u youre yourself du dich dir dein deine euch ihr tu toi te ton ta vous votre eres tú usted tus vosotros".split())
_OPEN, _CLOSE = "\"'“„«‹‘‚”", "\"'”“»›’‘"
_LEET = str.maketrans("01345789@$!", "oieastbgasi")


class Automaton:
    """Accepts the words within the edit limits of a set of terms."""

    def __init__(self, terms: tuple[str, ...], clean: frozenset[str] = frozenset()):
        self.child: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.limit: list[int] = [0]  # the most edits of any term below a node
        self.clean = clean
        for t in sorted(terms):
            k = 0 if len(t) < ONE_EDIT else 1 if len(t) < TWO_EDITS else 2
            u = 0
            self.limit[0] = max(self.limit[0], k)
            for c in t:
                v = self.child[u].get(c)
                if v is None:
                    v = self.child[u][c] = len(self.child)
                    self.child.append({})
                    self.term.append(None)
                    self.limit.append(0)
                self.limit[v] = max(self.limit[v], k)
                u = v
            self.term[u] = t
        self.states: dict[frozenset, int] = {}
        self.next: list[dict[str, int]] = []
        self.sets: list[frozenset] = []
        self.accept: list[tuple[str, int] | None] = []
        self.memo: dict[str, tuple[str, int] | None] = {}
        self.start = self._state({(0, "", 0): 0})

    def _state(self, found: dict) -> int:
        """The number of a set of {(node, awaited letter, 0): edits}, closed under deletions."""
        todo = [k for k in found if not k[1]]
        while todo:
            k = todo.pop()
            e = found[k]
            for v in self.child[k[0]].values():
                n = (v, "", 0)
                if e + 1 <= self.limit[v] and e + 1 < found.get(n, 99):
                    found[n] = e + 1
                    todo.append(n)
        key = frozenset((k[0], k[1], e) for k, e in found.items())
        s = self.states.get(key)
        if s is None:
            s = self.states[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            best = None
            for u, wait, e in key:
                t = self.term[u]
                if not wait and t is not None and e <= (0 if len(t) < ONE_EDIT else 1 if len(t) < TWO_EDITS else 2):
                    if best is None or (e, t) < (best[1], best[0]):
                        best = (t, e)
            self.accept.append(best)
        return s

    def _step(self, s: int, c: str) -> int:
        """The next state, -1 for the empty set."""
        found: dict = {}

        def add(u: int, wait: str, e: int) -> None:
            k = (u, wait, 0)
            if e <= self.limit[u] and e < found.get(k, 99):
                found[k] = e

        for u, wait, e in self.sets[s]:
            if wait:
                if c == wait:
                    add(u, "", e)
                continue
            add(u, "", e + 1)
            for a, v in self.child[u].items():
                if a == c:
                    add(v, "", e)
                else:
                    add(v, "", e + 1)
                    w = self.child[v].get(c)
                    if w is not None:
                        add(w, a, e + 1)
        t = self._state(found) if found else -1
        self.next[s][c] = t
        return t

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term within its limit."""
        if word in self.memo:
            return self.memo[word]
        s = self.start
        for c in word:
            t = self.next[s].get(c)
            if t is None:
                t = self._step(s, c)
            if t < 0:
                s = -1
                break
            s = t
        out = self.accept[s] if s >= 0 else None
        if out is not None and out[1] and word in self.clean:
            out = None
        if len(self.memo) > 300_000:
            self.memo.clear()
        self.memo[word] = out
        return out


@lru_cache(maxsize=4)
def automaton(terms: tuple[str, ...], clean: frozenset[str]) -> Automaton:
    return Automaton(terms, clean)


def core(token: str) -> str:
    """A token without the punctuation around it; digits and signs within it read as the letters they look like."""
    if token.isalpha():
        return token
    a, b = 0, len(token)
    while a < b and not token[a].isalnum() and token[a] not in "@$":
        a += 1
    while b > a and not token[b - 1].isalnum():
        b -= 1
    inner = token[a:b]
    return inner if inner.isalpha() or inner.isdigit() else inner.translate(_LEET)


def weigh(tokens: list[str], i: int, term: str, edits: int) -> tuple[float, bool]:
    """(weight, quoted) of the hit at token i on a term."""
    weight = MISSPELT[edits] * (1.0 if term in SEED else LEARNT)
    near = [core(t) for t in tokens[max(0, i - WINDOW) : i + WINDOW + 1]]
    before = tokens[max(0, i - WINDOW) : i + 1]
    after = tokens[i : i + WINDOW + 1]
    opened = any(t[:1] in _OPEN for t in before if t)
    closed = any(t.rstrip(".,;:!?")[-1:] in _CLOSE for t in after if t.rstrip(".,;:!?"))
    quoted = (opened and closed) or any(core(t) in _REPORT for t in tokens[max(0, i - WINDOW) : i])
    if quoted:
        weight *= QUOTED
    elif any(t in _ADDRESS for t in near):
        weight *= ADDRESSED
    return weight, quoted


def verdict(total: float, words: int) -> bool:
    return (total >= THRESHOLD and total >= DENSITY * words) or (total >= DENSE_THRESHOLD and total >= DENSE * words)


def score(column: pa.Array, machine: Automaton) -> list[tuple[float, int, int, int, list[str]] | None]:
    """(score, hits, quoted hits, words, terms) of each text, None for those without hits."""
    words = pc.utf8_split_whitespace(pc.utf8_lower(column.fill_null("") if column.null_count else column))
    coded = words.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    found = {}
    hot = np.zeros(len(distinct) + 1, bool)
    for k, token in enumerate(distinct):
        c = token if token.isalpha() else core(token)
        m = machine.match(c) if c else None
        if m is not None:
            found[k] = m
            hot[k] = True
    out: list = [None] * len(column)
    if not found:
        return out
    codes = coded.indices.to_numpy(zero_copy_only=False)
    off = words.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    off = off - off[0]
    at = np.flatnonzero(hot[codes])
    doc = np.searchsorted(off, at, side="right") - 1
    for d in np.unique(doc).tolist():
        a, b = int(off[d]), int(off[d + 1])
        total, quoted, terms = 0.0, 0, []
        for i in at[doc == d].tolist():
            lo, hi = max(a, i - WINDOW), min(b, i + WINDOW + 1)
            term, edits = found[int(codes[i])]
            weight, q = weigh([distinct[c] for c in codes[lo:hi].tolist()], i - lo, term, edits)
            total += weight
            quoted += q
            terms.append(term)
        out[d] = (total, len(terms), quoted, b - a, terms)
    return out


def learn(docs: DataFrame, labels: DataFrame, seed: tuple[str, ...] = SEED, sample: int = SAMPLE) -> tuple[tuple[str, ...], frozenset[str]]:
    """(terms, clean words that are near a term) from at most ``sample`` labelled documents."""
    marks = pick(labels, doc_id="long", toxic="int").filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = doc_rows(docs).filter("text is not null").join(F.broadcast(marks), "doc_id")
    # The empty word is taken to be in each text, so that one pass over the texts counts these too.
    split = F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.lower("text"), "[^\\p{L}]+")))
    words = texts.select((F.col("toxic") > 0).cast("long").alias("toxic"), F.explode(split).alias("word")).filter("length(word) > 2 or word = ''")
    every = saved(words.groupBy("word").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("m")), docs.sparkSession)
    sums = every.filter("word = ''").first()
    n, t = (sums["m"], sums["a"]) if sums else (0, 0)
    if not t or t == n:
        return tuple(seed), frozenset()
    counts = every.filter("word <> ''")
    share = F.col("a") / F.col("m")
    base = t / n

    def part(x, p, q):
        return F.when(x > 0, x * F.log(p / q)).otherwise(0.0)

    g2 = 2 * (part(F.col("a"), share, F.lit(base)) + part(F.col("m") - F.col("a"), 1 - share, F.lit(1 - base)))
    # Each learnt term needs toxic documents of its own, so the sample bounds their number.
    learnt = [r["word"] for r in counts.filter((share >= LEAST_SHARE) & (g2 >= LEAST_G2)).select("word").collect()]
    terms = tuple(sorted({*seed, *learnt}))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(terms, frozenset())
        for b in batches:
            hit = [(m := machine.match(w)) is not None and m[1] > 0 for w in b.column(0).to_pylist()]
            yield b.filter(pa.array(hit, pa.bool_()))

    clean = counts.filter(share < LEAST_SHARE).select("word").mapInArrow(near, "word string")
    return terms, frozenset(r["word"] for r in clean.collect())


def hits(docs: DataFrame, lexicon: tuple[tuple[str, ...], frozenset[str]] | None = None) -> DataFrame:
    """(doc_id, score, hits, quoted, words, toxic, terms) of every document with a hit."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon or (SEED, frozenset()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(*held.value)
        for b in (s for whole in batches for s in slices(whole, 1)):
            rows = score(b.column(1), machine)
            at = [i for i, r in enumerate(rows) if r is not None]
            got = [rows[i] for i in at]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(at, pa.int64())),
                    pa.array([round(r[0], 4) for r in got], pa.float64()),
                    *(pa.array([r[k] for r in got], pa.int32()) for k in (1, 2, 3)),
                    pa.array([verdict(r[0], r[3]) for r in got], pa.bool_()),
                    pa.array([",".join(sorted(Counter(r[4]))) for r in got], pa.string()),
                ],
                names=["doc_id", "score", "hits", "quoted", "words", "toxic", "terms"],
            )

    return doc_rows(docs).mapInArrow(run, "doc_id long, score double, hits int, quoted int, words int, toxic boolean, terms string")


def toxic(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The documents that are toxic, by the built-in lexicon and what the labels teach."""
    return hits(docs, None if labels is None else learn(docs, labels)).filter("toxic")
